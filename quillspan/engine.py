"""Cited retrieval over an opened snapshot: search, typed reads, comparison and context.

Requests are dataclasses, answers are dictionaries of plain values with the
snapshot and the state of the semantic leg. Each request reads what its filters
leave: postings of its own terms, rows of its own ids. Only rows of a bounded
number come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan import build
from quillspan.functions import text as tx
from quillspan.operators import context, embed, lexical, navigate, rank, snapshot, vector
from quillspan.operators.index import Index

#: Candidates of a leg, and limits of requests.
LEG = 100
MOST = {"search": 50, "lookup": 25, "blocks": 100, "outline": 500, "rows": 100, "references": 200, "compare": 25, "depth": 8, "ids": 256}
MODES = ("exact", "lexical", "semantic", "hybrid")
ENTITIES = ("instruction", "msr", "cpuid", "register", "exception", "bitfield", "term")


class InvalidInput(ValueError):
    """A request that cannot be answered as it is."""


def need(holds: bool, message: str) -> None:
    if not holds:
        raise InvalidInput(message)


@dataclass(frozen=True)
class Facets:
    vendors: tuple[str, ...] = ()
    document_ids: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()

    def check(self) -> None:
        """At most 2 vendors, 16 documents and 16 kinds, 64 combinations; none blank or twice."""
        sizes = [len(self.vendors), len(self.document_ids), len(self.kinds)]
        need(all(n <= most for n, most in zip(sizes, (2, 16, 16), strict=True)), "too many filter values")
        need(max(1, sizes[0]) * max(1, sizes[1]) * max(1, sizes[2]) <= 64, "too many combinations of filters")
        for values in (self.vendors, self.document_ids, self.kinds):
            need(len(set(values)) == len(values) and all(v.strip() for v in values), "filter values are blank or repeated")

    @property
    def active(self) -> int:
        return sum(map(bool, (self.vendors, self.document_ids, self.kinds)))

    def holds(self) -> Column:
        out = F.lit(True)
        for name, values in (("vendor", self.vendors), ("document_id", self.document_ids), ("kind", self.kinds)):
            if values:
                out = out & F.col(name).isin(list(values))
        return out


@dataclass(frozen=True)
class Search:
    query: str
    mode: str = "hybrid"
    facets: Facets = field(default_factory=Facets)
    limit: int = 10
    cursor: str | None = None

    def check(self) -> None:
        need(bool(self.query.strip()), "the query is blank")
        need(1 <= self.limit <= MOST["search"], f"limit is 1 to {MOST['search']}")
        need(self.mode in MODES, f"mode is one of {', '.join(MODES)}")
        self.facets.check()


class Engine:
    """Requests over one snapshot. ``embedder`` makes the model when a semantic search first needs it; without one, or when it fails, the other legs go on and the answer says why."""

    def __init__(self, opened: snapshot.Snapshot, embedder: Callable[[], embed.Embedder] | None = None, status: Callable[[], snapshot.Status] | None = None):
        self.opened, self.spark, self._make, self._status = opened, opened.spark, embedder, status
        need(opened.counts["chunks"] == opened.counts["vectors"], "chunks and vectors differ in number")
        self._failed: str | None = None

    @staticmethod
    def open(spark: SparkSession, root: str, embedder: Callable[[], embed.Embedder] | None = None, status: Callable[[], snapshot.Status] | None = None, lease: float = snapshot.LEASE) -> Engine:
        """The current snapshot, held for ``lease`` seconds, with its vectors' rows checked to be 0, 1, 2 and so on, and the status, if one is given, to be its own."""
        out = Engine(snapshot.Snapshot.current(spark, root, lease), embedder, status)
        need(bool(navigate.dense(out.table("vectors"), "vector_row").first()["contiguous"]), "rows of vectors have gaps or repeats")
        need(out.now.snapshot_id in (None, out.opened.id), "the status is of another snapshot")
        return out

    @cached_property
    def now(self) -> snapshot.Status:
        """The state of the snapshot against the corpus when it was opened; ready if nobody looked."""
        return self._status() if self._status else snapshot.Status(snapshot.READY, (), self.opened.id)

    def table(self, name: str) -> DataFrame:
        return self.opened.table(name)

    @cached_property
    def index(self) -> Index:
        return Index(self.spark, f"{self.opened.store.root}/{build.LEXICAL}", self.opened.manifest["index"])

    @cached_property
    def embedder(self) -> embed.Embedder:
        need(self._make is not None, "no embedding model is configured")
        need(self.now.state != snapshot.DEGRADED, "; ".join(self.now.reasons))
        need(self._failed is None, self._failed or "")
        try:
            made = self._make()
        except Exception as error:
            self._failed = str(error).splitlines()[0] if str(error) else type(error).__name__  # it is not loaded again
            raise
        need(made.spec() == self.opened.manifest["inputs"]["model"], "the embedding model is not the snapshot's")
        return made

    def state(self, degraded: str | None = None) -> dict:
        return {"snapshot_id": self.opened.id, "stale": self.now.state == snapshot.STALE, "semantic_degraded_reason": degraded}

    # search

    def search(self, request: Search) -> dict:
        """Legs of at most 100 candidates, fused by reciprocal rank, boosted, at most two of a section, a page of them with citations."""
        request.check()
        words, symbols = self.index.query_words(request.query), lexical.exact_symbols(request.query)
        need(bool(words or symbols), "the query has neither words nor symbols")
        asked = asdict(request) | {"facets": {k: list(v) for k, v in asdict(request.facets).items()}}
        offset, key = (0, None) if request.cursor is None else self._cursor(request.cursor, asked, rank.MOST_FUSED - 1)
        legs, degraded, truncated = self._legs(request, words, symbols)
        ranked = self._ranked(request, legs, symbols)
        if key is not None:
            need(0 < offset <= len(ranked) and ranked[offset - 1]["chunk_id"] == key, "the cursor does not match the present ranking")
        chosen = ranked[offset : offset + request.limit]
        end = offset + len(chosen)
        cursor = rank.encode_cursor(self.opened.id, asked, end, ranked[end - 1]["chunk_id"]) if end < len(ranked) else None
        return {"state": self.state(degraded), "hits": self._hits(chosen), "next_cursor": cursor, "candidate_window_truncated": truncated}

    def _cursor(self, cursor: str, asked: dict, most: int) -> tuple[int, str]:
        try:
            return rank.decode_cursor(cursor, self.opened.id, asked, most)
        except ValueError as error:
            raise InvalidInput(str(error)) from error

    def _legs(self, request: Search, words: list[str], symbols: list[str]) -> tuple[list[DataFrame], str | None, bool]:
        """(chunk_id, leg, rank, score) of each leg that the mode asks for."""
        legs, degraded = {}, None
        if request.mode in ("exact", "hybrid") and symbols:
            legs["exact"] = self._lexical_leg(lexical.scored(self.index, [], symbols), request.facets).collect()
        if request.mode in ("lexical", "hybrid"):
            legs["lexical"] = self._lexical_leg(lexical.scored(self.index, words, symbols), request.facets).collect()
        if request.mode in ("semantic", "hybrid"):
            try:
                query = self.embedder.embed_query(request.query)
                legs["semantic"] = self._semantic_leg(query, request.facets).collect()
            except Exception as error:  # a model or vectors that fail never fail the search
                degraded = str(error).splitlines()[0] if str(error) else type(error).__name__
        # a leg has a hundred rows at most: they are ranked once and kept as literals of the next step
        rows = [(name, r["chunk_id"], i, float(r["score"])) for name, leg in legs.items() for i, r in enumerate(leg, 1)]
        found = self.spark.createDataFrame(rows, "leg string, chunk_id string, rank int, score double")
        sizes = [sum(1 for r in rows if r[0] == name) for name in legs]
        return found, degraded, any(n >= LEG for n in sizes)

    def _lexical_leg(self, scores: DataFrame, facets: Facets) -> DataFrame:
        """The first 400 by score under the filters, then the weight of front matter, then 100."""
        chunks = self.table("chunks").select("chunk_id", "vendor", "document_id", "kind", F.when(F.col("content_class") == "front_matter", 0.35).otherwise(1.0).alias("weight"))
        if facets.active:
            scores = scores.join(chunks.where(facets.holds()).select("chunk_id"), "chunk_id", "left_semi")
        fetched = scores.orderBy(F.desc("score"), "chunk_id").limit(lexical.MOST_FETCHED)
        weighed = chunks.join(F.broadcast(fetched), "chunk_id").select("chunk_id", (F.col("score") * F.col("weight")).alias("score"))
        return weighed.orderBy(F.desc("score"), "chunk_id").limit(LEG)

    def _semantic_leg(self, query: list[float], facets: Facets) -> DataFrame:
        rows = self.table("vectors").select("vector_row", "chunk_id", "embedding")
        if facets.active:
            rows = rows.join(self.table("chunks").where(facets.holds()).select("chunk_id"), "chunk_id", "left_semi")
        top = vector.top_k(rows, "vector_row", "embedding", query, LEG)
        return rows.select("vector_row", "chunk_id").join(F.broadcast(top), "vector_row").select("chunk_id", "score", "vector_row").orderBy(F.desc("score"), "vector_row")

    def _ranked(self, request: Search, legs: DataFrame, symbols: list[str]) -> list[dict]:
        """At most 300 candidates with their scores, in final order, two of a section."""
        fused = legs.groupBy("chunk_id").agg(F.sum(1 / (rank.RRF_K + F.col("rank"))).alias("rrf"), *[F.max(F.when(F.col("leg") == m, F.col(c))).alias(f"{m}_{c}") for m in MODES[:3] for c in ("rank", "score")])
        chunks = self.table("chunks").select("chunk_id", "section_id", "document_id", "text", "symbols", "content_class")
        heading = rank.heading_of(F.col("text"))
        known = F.array(*[F.lit(s) for s in symbols]).cast("array<string>")
        hit = F.arrays_overlap(F.transform("symbols", tx.normalized_symbol), known) if symbols else F.lit(False)
        named = heading.contains(request.query.lower())
        for s in symbols:
            named = named | heading.contains(s.lower())
        factor = rank.boost(hit, named, F.col("content_class"), request.facets.active)
        # three legs of a hundred: the fused table has a bound
        scored = chunks.join(F.broadcast(fused), "chunk_id").withColumn("boost", factor).withColumn("final", F.col("rrf") * F.col("boost"))
        kept = rank.capped(scored.drop("text", "symbols"), "section_id", "final", "chunk_id")
        return sorted((r.asDict() for r in kept.collect()), key=lambda r: (-r["final"], r["chunk_id"]))

    def _hits(self, ranked: list[dict]) -> list[dict]:
        if not ranked:
            return []
        rows = self._chunks([r["chunk_id"] for r in ranked])
        cited = self._citations(rows.values())
        score = lambda r: {"rrf": r["rrf"], "boost": r["boost"], "final": r["final"]} | {k: r[k] for m in MODES[:3] for k in (f"{m}_rank", f"{m}_score")}
        text = lambda t: t if len(t) <= tx.SNIPPET_CHARS else t[: tx.SNIPPET_CHARS] + "…"
        return [{"chunk_id": r["chunk_id"], "snippet": text(rows[r["chunk_id"]]["text"]), "citation": cited[r["chunk_id"]], "scores": score(r)} for r in ranked]

    def _chunks(self, ids: list[str]) -> dict[str, dict]:
        """Chunks of at most 256 ids, by id; missing ones are absent."""
        return {r["chunk_id"]: r.asDict(True) for r in self.opened.with_ids("chunks", "chunk_id", ids).collect()}

    def _document(self, document_id: str) -> dict:
        return self.opened.with_ids("documents", "document_id", [document_id]).first().asDict()

    def _citations(self, rows) -> dict[str, dict]:
        rows = list(rows)
        docs = {d["document_id"]: d for d in self.opened.with_ids("documents", "document_id", sorted({r["document_id"] for r in rows})).collect()}
        return {r["chunk_id"]: cite(docs[r["document_id"]], r["heading_path"], r["section_id"], r["span"]) | {"chunk_id": r["chunk_id"], "block_ids": r["source_block_ids"]} for r in rows}

    def compare(self, query: str, vendors: tuple[str, str] = ("intel", "amd"), mode: str = "hybrid", limit: int = 10) -> dict:
        """The same search for each vendor by itself."""
        need(1 <= limit <= MOST["compare"], f"limit is 1 to {MOST['compare']}")
        sides = {v: self.search(Search(query, mode, Facets(vendors=(v,)), limit)) for v in vendors}
        reasons = [s["state"]["semantic_degraded_reason"] for s in sides.values()]
        return {"state": self.state(next((r for r in reasons if r), None)), "sides": {v: {"hits": s["hits"], "truncated": s["next_cursor"] is not None or s["candidate_window_truncated"]} for v, s in sides.items()}}

    def lookup(self, name: str, kind: str = "term", vendors: tuple[str, ...] = (), limit: int = 10) -> dict:
        """Chunks that have a symbol, and those that are about it without having it."""
        need(bool(name.strip()), "the name is blank")
        need(kind in ENTITIES, f"kind is one of {', '.join(ENTITIES)}")
        need(1 <= limit <= MOST["lookup"], f"limit is 1 to {MOST['lookup']}")
        base = Search(name, "lexical", Facets(vendors=vendors), limit)
        exact = self.search(replace(base, mode="exact")) if kind != "term" else {"hits": [], "next_cursor": None, "candidate_window_truncated": False}
        related = self.search(base)
        held = {h["chunk_id"] for h in exact["hits"]}
        rest = [h for h in related["hits"] if h["chunk_id"] not in held]
        cut = lambda s: s["next_cursor"] is not None or s["candidate_window_truncated"]
        return {"state": self.state(), "entity_state": "found" if exact["hits"] or rest else "not_found", "kind": kind, "exact": exact["hits"], "related": rest, "exact_truncated": cut(exact), "related_truncated": cut(related)}

    # typed reads

    def _page(self, rows: DataFrame, order: list[str], request: dict, offset: int, limit: int) -> tuple[list[dict], str | None]:
        """Rows offset + 1 to offset + limit, and a cursor if there are more: one more row is asked for than is shown."""
        got = [r.asDict(True) for r in rows.orderBy(*order).offset(offset).limit(limit + 1).collect()]
        more = len(got) > limit
        return got[:limit], rank.encode_cursor(self.opened.id, request, offset + limit, "") if more else None

    def _offset(self, cursor: str | None, request: dict) -> int:
        return 0 if cursor is None else self._cursor(cursor, request, 10_000)[0]

    def _missing(self) -> dict:
        return {"state": self.state(), "entity_state": "not_found"}

    def get_section(self, section_id: str, block_limit: int = 20, cursor: str | None = None, neighbours: bool = False) -> dict:
        """A section with a page of its blocks, its direct children and, if asked, the sections before and after it; a block's id gives that block."""
        need(bool(section_id.strip()), "the id is blank")
        need(1 <= block_limit <= MOST["blocks"], f"block_limit is 1 to {MOST['blocks']}")
        request = {"section": section_id, "limit": block_limit}
        offset = self._offset(cursor, request)
        found = self.opened.with_ids("sections", "section_id", [section_id]).first()
        if found is None:
            block = self.opened.with_ids("blocks", "block_id", [section_id]).first()
            if block is None:
                return self._missing()
            return {"state": self.state(), "entity_state": "found", "section": None, "blocks": [block.asDict(True)], "children": [], "next_cursor": None, "citation": self._cite(block)}
        blocks, after = self._page(self.table("blocks").where(F.col("section_id") == section_id), ["ordinal"], request, offset, block_limit)
        of_document = self.table("sections").where(F.col("document_id") == found["document_id"])
        children = [r.asDict(True) for r in of_document.where(F.col("parent_section_id") == section_id).orderBy("span.byte_start").collect()]
        out = {"state": self.state(), "entity_state": "found", "section": found.asDict(True), "blocks": blocks, "children": children, "next_cursor": after, "citation": self._cite(found)}
        if neighbours:
            around = navigate.neighbours(of_document.where(F.col("level") <= MOST["depth"]).select("document_id", "section_id", F.struct("span.byte_start", "level", "ordinal", "section_id").alias("at")), "document_id", "at")
            own = around.where(F.col("section_id") == section_id).first()
            ids = {k: own[k]["section_id"] for k in ("previous", "next") if own[k]}
            near = {r["section_id"]: r.asDict(True) for r in of_document.where(F.col("section_id").isin(list(ids.values()))).collect()}
            out |= {k: near[ids[k]] if k in ids else None for k in ("previous", "next")}
        return out

    def _cite(self, row) -> dict:
        r = row.asDict(True)
        return cite(self._document(r["document_id"]), r.get("heading_path") or [], r.get("section_id"), r["span"])

    def get_outline(self, document_id: str | None = None, root_section_id: str | None = None, depth: int = 3, limit: int = 100, cursor: str | None = None) -> dict:
        """Documents, or the sections of one with their depth below its top or below a section, in order."""
        need(0 <= depth <= MOST["depth"] and 1 <= limit <= MOST["outline"], f"depth is 0 to {MOST['depth']}, limit 1 to {MOST['outline']}")
        need(root_section_id is None or document_id is not None, "a root needs its document")
        request = {"outline": [document_id, root_section_id, depth, limit]}
        offset = self._offset(cursor, request)
        if document_id is None:
            rows, after = self._page(self.table("documents"), ["vendor", "document_id"], request, offset, limit)
            return {"state": self.state(), "entity_state": "found", "documents": rows, "next_cursor": after}
        sections = self.table("sections").where(F.col("document_id") == document_id)
        top = sections.where(F.col("section_id") == root_section_id) if root_section_id else sections
        if not top.take(1):
            return self._missing()
        # roots have no parent: the asked one, or those of the document
        parent = F.when(F.col("section_id") == root_section_id, None).otherwise(F.col("parent_section_id")) if root_section_id else F.col("parent_section_id")
        edges = sections.select(F.col("section_id").alias("node"), parent.alias("parent"))
        if root_section_id:
            edges = edges.where((F.col("node") == root_section_id) | F.col("parent").isNotNull())
        walked = navigate.outline(edges, depth).select(F.col("node").alias("section_id"), F.col("depth").alias("relative_depth"))
        rows, after = self._page(sections.join(walked, "section_id").withColumn("_at", F.col("span.byte_start")), ["_at", "level", "ordinal", "section_id"], request, offset, limit)
        return {"state": self.state(), "entity_state": "found", "sections": [{k: v for k, v in r.items() if k != "_at"} for r in rows], "next_cursor": after}

    def get_table(self, table_id: str, row_filter: str | None = None, limit: int = 50, cursor: str | None = None, include_raw: bool = False) -> dict:
        """A table by its id or its block's, with a page of its rows: all, or those of which any cell has a text, in any case."""
        need(bool(table_id.strip()), "the id is blank")
        need(1 <= limit <= MOST["rows"], f"limit is 1 to {MOST['rows']}")
        request = {"table": [table_id, row_filter, limit]}
        offset = self._offset(cursor, request)
        found = self.table("tables").where((F.col("table_id") == table_id) | (F.col("block_id") == table_id)).first()
        if found is None:
            return self._missing()
        rows = self.table("table_rows").where(F.col("table_id") == found["table_id"])
        if row_filter and row_filter.strip():
            rows = rows.where(F.exists("cells", lambda c: F.lower(c).contains(row_filter.lower())))
        total = rows.count()
        page, after = self._page(rows.select("row_index", "cells"), ["row_index"], request, offset, limit)
        block = self.opened.with_ids("blocks", "block_id", [found["block_id"]]).first()
        return {"state": self.state(), "entity_state": "found", "table": found.asDict(True), "rows": page, "total_rows": total, "next_cursor": after, "raw_source": block["raw_source"] if include_raw else None, "citation": self._cite(block)}

    def get_diagram(self, diagram_id: str, surrounding: bool = False, include_raw: bool = True) -> dict:
        """A diagram by its id or its block's; if asked, with the blocks before and after it in its section."""
        need(bool(diagram_id.strip()), "the id is blank")
        found = self.table("diagrams").where((F.col("diagram_id") == diagram_id) | (F.col("block_id") == diagram_id)).first()
        if found is None:
            return self._missing()
        block = self.opened.with_ids("blocks", "block_id", [found["block_id"]]).first()
        out = {"state": self.state(), "entity_state": "found", "diagram": found.asDict(True) | ({} if include_raw else {"raw_source": None}), "citation": self._cite(block)}
        if surrounding:
            of_section = self.table("blocks").where(F.col("section_id") == block["section_id"])
            w = Window.partitionBy("section_id").orderBy("ordinal")
            near = of_section.withColumns({"_b": F.lag("block_id").over(w), "_a": F.lead("block_id").over(w)})
            out["surrounding"] = [r.asDict(True) for r in near.where((F.col("_b") == block["block_id"]) | (F.col("_a") == block["block_id"])).drop("_b", "_a").orderBy("ordinal").collect()]
        return out

    def get_references(self, entity_id: str, direction: str = "outgoing", limit: int = 50, cursor: str | None = None) -> dict:
        """References from a block, section or document, or to an entity or document, in order of their ids."""
        need(bool(entity_id.strip()), "the id is blank")
        need(direction in ("incoming", "outgoing"), "direction is incoming or outgoing")
        need(1 <= limit <= MOST["references"], f"limit is 1 to {MOST['references']}")
        request = {"references": [entity_id, direction, limit]}
        offset = self._offset(cursor, request)
        refs = self.table("refs")
        if direction == "incoming":
            found = refs.where((F.col("target_id") == entity_id) | (F.col("target_document_id") == entity_id))
        else:
            of = self.table("blocks").where((F.col("block_id") == entity_id) | (F.col("section_id") == entity_id) | (F.col("document_id") == entity_id)).select(F.col("block_id").alias("source_block_id"))
            found = refs.join(of, "source_block_id", "left_semi")
        rows, after = self._page(found, ["reference_id"], request, offset, limit)
        if not rows and not self.exists(entity_id):
            return self._missing()
        return {"state": self.state(), "entity_state": "found", "references": rows, "next_cursor": after}

    def exists(self, entity_id: str) -> bool:
        """Whether a document, section, block, table or diagram has this id."""
        keys = {"documents": "document_id", "sections": "section_id", "blocks": "block_id", "tables": "table_id", "diagrams": "diagram_id"}
        return any(self.opened.with_ids(name, key, [entity_id]).take(1) for name, key in keys.items())

    # context

    def build_context(self, query: str | None = None, chunk_ids: tuple[str, ...] = (), budget: int = 4096, facets: Facets = Facets(), mode: str = "hybrid", vendors: tuple[str, ...] = ()) -> dict:
        """Chunks of a query in a mode, of some vendors if any are named, then those asked for, each once; neighbours in list order are joined, and groups are taken as they fit, passing over those that do not."""
        need(256 <= budget <= 32_768, "budget is 256 to 32768")
        need(len(chunk_ids) <= MOST["ids"], f"at most {MOST['ids']} ids")
        need(bool((query or "").strip() or chunk_ids), "a query or ids are needed")
        facets = replace(facets, vendors=tuple(vendors)) if vendors else facets
        found = self.search(Search(query, mode, facets, MOST["search"])) if (query or "").strip() else None
        ids = list(dict.fromkeys([*[h["chunk_id"] for h in (found["hits"] if found else [])], *chunk_ids]))
        rows = self._chunks(ids) if ids else {}
        listed = [rows[i] for i in ids if i in rows]
        cited = self._citations(listed)
        groups: list[list[dict]] = []
        for r in listed:
            last = groups[-1][-1] if groups else None
            if last and (last["document_id"], last["section_id"], last["vector_row"] + 1) == (r["document_id"], r["section_id"], r["vector_row"]):
                groups[-1].append(r)
            else:
                groups.append([r])
        used, taken, left = 0, [], [{"chunk_ids": [i], "reason": "chunk is not in the snapshot"} for i in ids if i not in rows]
        for group in groups:
            text = context.joined_texts([r["text"] for r in group])
            tokens = (2 * len(text) + 6) // 7
            own = [r["chunk_id"] for r in group]
            if used + tokens > budget:
                left.append({"chunk_ids": own, "reason": f"needs {tokens} of {budget - used} tokens left"})
                continue
            used += tokens
            taken.append({"chunk_ids": own, "text": text, "tokens": tokens, "citations": [cited[i] for i in own]})
        return {"state": found["state"] if found else self.state(), "groups": taken, "omitted": left, "tokens": used, "budget": budget}

    def index_status(self) -> dict:
        """State, counts and manifest of the snapshot."""
        now = self.now
        counts = self.opened.counts
        return {"state": now.state, "reasons": list(now.reasons), "archives": list(now.archives), "snapshot_id": self.opened.id, "counts": {k: counts[k] for k in sorted(counts) if k not in ("parsed", "declarations")}, "manifest": self.opened.manifest}


def cite(document, heading_path: list[str], section_id: str | None, span: dict) -> dict:
    """Where a text stands: document, headings, printed page, bytes and lines."""
    return {"document_id": document["document_id"], "vendor": document["vendor"], "title": document["title"], "revision": document["revision"], "archive_id": document["archive_id"], "archive_sha256": document["archive_sha256"], "entry_path": document["entry_path"], "heading_path": list(heading_path), "section_id": section_id, "printed_page": span["printed_page"], "byte_start": span["byte_start"], "byte_end": span["byte_end"], "line_start": span["line_start"], "line_end": span["line_end"], "source_url": None}


#: The requests by the name that a client calls them by; each reads only, and gives the same answer again.
TOOLS = {name: getattr(Engine, name) for name in ("search", "lookup", "get_section", "get_outline", "get_table", "get_diagram", "get_references", "compare", "build_context", "index_status")}


def call(engine: Engine, tool: str, arguments: dict) -> dict:
    """A request by name with JSON-like arguments: {"result": ...}, or {"error": {"code": "invalid_params" or "internal", "message": ...}}."""
    try:
        need(tool in TOOLS, f"there is no tool {tool!r}")
        given = {k: tuple(v) if isinstance(v, list) else v for k, v in arguments.items()}
        if tool == "search":
            facets = Facets(**{k: given.pop(k, ()) for k in ("vendors", "document_ids", "kinds")})
            return {"result": engine.search(Search(**given, facets=facets))}
        if tool == "build_context" and isinstance(given.get("facets"), dict):
            given["facets"] = Facets(**{k: tuple(v) for k, v in given["facets"].items()})
        return {"result": TOOLS[tool](engine, **given)}
    except (InvalidInput, TypeError) as error:
        return {"error": {"code": "invalid_params", "message": str(error)}}
    except Exception as error:  # the caller gets every failure as an answer
        return {"error": {"code": "internal", "message": str(error).splitlines()[0] if str(error) else type(error).__name__}}
