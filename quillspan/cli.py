"""Command line: build a snapshot, show its state, or answer requests from standard input.

    python -m quillspan.cli --root DIR index [--force]
    python -m quillspan.cli --root DIR status
    python -m quillspan.cli --root DIR serve
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from quillspan import build, engine
from quillspan.ingest.chunker import Budget
from quillspan.operators import embed, snapshot
from quillspan.sources import corpus


@dataclass(frozen=True)
class Config:
    """Folders under a root: corpus with its manifest, and the index."""

    root: str

    @staticmethod
    def default() -> Config:
        """QUILLSPAN_ROOT, else the working directory."""
        return Config(os.environ.get("QUILLSPAN_ROOT", os.getcwd()))

    @property
    def corpus(self) -> str:
        return f"{self.root}/corpus"

    @property
    def manifest(self) -> str:
        return f"{self.corpus}/manifest.toml"

    @property
    def index(self) -> str:
        return f"{self.root}/index"


def session() -> SparkSession:
    return SparkSession.builder.appName("quillspan").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def index(spark: SparkSession, config: Config, embedder: embed.Embedder, force: bool = False) -> build.Report:
    archives = corpus.load_manifest(config.manifest)
    return build.build(spark, config.index, corpus.read_corpus(spark, config.corpus, archives), archives, embedder, force=force)


def status(spark: SparkSession, config: Config, embedder: embed.Embedder) -> snapshot.Status:
    """Against the archives as they lie now: one whose file has another checksum than the manifest says is stale."""
    if not Path(config.manifest).exists():
        return snapshot.status(spark, config.index, {})
    archives = corpus.load_manifest(config.manifest)
    found = corpus.checksums(spark, config.corpus, archives)
    now = [a | {"sha256": found.get(a["id"], "")} for a in archives]
    try:
        before = snapshot.Snapshot.current(spark, config.index).manifest["inputs"]
    except Exception:  # missing or damaged, which the status itself tells
        before = {}
    sound = all(found.get(a["id"]) == a["sha256"] for a in archives)
    documents = corpus.read_corpus(spark, config.corpus, archives) if sound else None
    inputs = build.inputs_of(documents, now, embedder, Budget(), True) if sound else before | {"archives": [{k: a[k] for k in ("id", "vendor", "path", "sha256", "entry_count", "uncompressed_bytes") if k in a} for a in now]}
    return snapshot.status(spark, config.index, inputs)


def serve(spark: SparkSession, config: Config, make: object, lines=sys.stdin, out=sys.stdout, status: snapshot.Status | None = None) -> None:
    """A JSON request a line, {"id", "tool", "arguments"}; an answer a line, which says whether the index is stale by ``status``."""
    opened = engine.Engine.open(spark, config.index, make, (lambda: status) if status else None)
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            answer = {"tools": sorted(engine.TOOLS)} if request.get("tool") == "list" else engine.call(opened, request["tool"], request.get("arguments") or {})
        except (ValueError, KeyError, AttributeError):
            request, answer = {}, {"error": {"code": "invalid_request", "message": "a request is a JSON object with a tool"}}
        print(json.dumps({"id": request.get("id")} | answer, default=str, ensure_ascii=False), file=out, flush=True)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspan", description=__doc__.splitlines()[0])
    parser.add_argument("--root", default=None)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("index", help="build the snapshot of the corpus").add_argument("--force", action="store_true")
    commands.add_parser("status", help="show the state of the snapshot")
    commands.add_parser("serve", help="answer requests from standard input")
    given = parser.parse_args(arguments)
    config, spark = Config(given.root) if given.root else Config.default(), session()
    if given.command == "index":
        print(json.dumps(asdict(index(spark, config, embed.HashingEmbedder(), given.force))))
        return 0
    found = status(spark, config, embed.HashingEmbedder())
    if given.command == "status":
        print(json.dumps(asdict(found), indent=2))
        return found.exit_code
    if not found.usable:
        print(f"the snapshot is {found.state}: {'; '.join(found.reasons)}", file=sys.stderr)
        return found.exit_code
    serve(spark, config, embed.HashingEmbedder, status=found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
