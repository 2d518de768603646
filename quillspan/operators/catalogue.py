"""Typed reads of an opened snapshot's tables: one entity by its id, ordered lists, and checks of what the tables may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import snapshot

#: Closed vocabularies, by table and column.
VOCABULARIES = {
    ("blocks", "kind"): ("prose", "list", "code", "table", "diagram", "quote", "caption"),
    ("blocks", "content_class"): ("substantive", "front_matter", "contents", "legal", "revision_history", "page_furniture"),
    ("chunks", "kind"): ("prose", "list", "code", "table", "diagram"),
    ("chunks", "content_class"): ("substantive", "front_matter", "contents", "legal", "revision_history", "page_furniture"),
    ("refs", "kind"): ("section", "table", "figure", "document"),
}
#: Numbers that are never negative, by table.
NOT_NEGATIVE = {"documents": ("byte_len",), "sections": ("level", "ordinal", "span.byte_start", "span.byte_end"), "blocks": ("ordinal", "span.byte_start", "span.byte_end"), "chunks": ("token_count", "vector_row", "span.byte_start"), "tables": ("row_count",), "table_rows": ("row_index",)}
MOST_IDS = 256


class Catalogue:
    """Reads by id give a dictionary or None; lists are DataFrames in their order."""

    def __init__(self, opened: snapshot.Snapshot):
        self.opened = opened

    def _one(self, table: str, key: str, value: str) -> dict | None:
        found = self.opened.table(table).where(F.col(key) == value).first()
        return found.asDict(True) if found else None

    def document(self, document_id: str) -> dict | None:
        return self._one("documents", "document_id", document_id)

    def documents(self) -> DataFrame:
        """By vendor as text, then id."""
        return self.opened.table("documents").orderBy("vendor", "document_id")

    def section(self, section_id: str) -> tuple[dict, list[dict]] | None:
        """A section and its blocks in order; a section is of one document and has a bounded number of them."""
        found = self._one("sections", "section_id", section_id)
        if found is None:
            return None
        blocks = self.opened.table("blocks").where((F.col("document_id") == found["document_id"]) & (F.col("section_id") == section_id)).orderBy("ordinal")
        return found, [b.asDict(True) for b in blocks.collect()]

    def document_id_for_section(self, section_id: str) -> str | None:
        found = self._one("sections", "section_id", section_id)
        return found["document_id"] if found else None

    def block(self, block_id: str) -> dict | None:
        return self._one("blocks", "block_id", block_id)

    def chunk(self, chunk_id: str) -> dict | None:
        return self._one("chunks", "chunk_id", chunk_id)

    def chunks_by_ids(self, ids: list[str]) -> list[dict]:
        """Chunks in the order of at most 256 ids; missing ones are passed over, repeated ones given again."""
        if len(ids) > MOST_IDS:
            raise ValueError(f"at most {MOST_IDS} ids")
        found = {r["chunk_id"]: r.asDict(True) for r in self.opened.with_ids("chunks", "chunk_id", ids).collect()} if ids else {}
        return [found[i] for i in ids if i in found]

    def chunks_with_vector_rows(self) -> DataFrame:
        return self.opened.table("chunks").orderBy("vector_row")

    def vector_metadata(self) -> DataFrame:
        """(vector_row, chunk_id, document_id, vendor, kind): what filters need, without texts."""
        return self.opened.table("chunks").select("vector_row", "chunk_id", "document_id", "vendor", "kind").orderBy("vector_row")

    def vector_row(self, chunk_id: str) -> int | None:
        found = self.opened.with_ids("chunks", "chunk_id", [chunk_id]).select("vector_row").first()
        return found[0] if found else None

    def vector_reuse_records(self) -> DataFrame:
        """(content_hash, vector_row), the first row of each content."""
        return self.opened.table("chunks").groupBy("content_hash").agg(F.min("vector_row").alias("vector_row"))

    def parsed_document(self, document_id: str) -> dict | None:
        """A document as it was parsed, with all its parts; ValueError if they differ in number from the tables' rows."""
        found = self._one("parsed", "document_id", document_id)
        if found is None:
            return None
        for part in ("blocks", "tables", "diagrams", "refs", "warnings"):
            rows = self.opened.table(part).where(F.col("document_id") == document_id).count()
            if rows != len(found[part]):
                raise ValueError(f"{part} of {document_id} has {rows} rows, not {len(found[part])}")
        return found

    def counts(self) -> dict[str, int]:
        """Rows of each table, with the number of archives."""
        archives = self.opened.table("documents").agg(F.count_distinct("archive_id")).first()[0]
        return {k: n for k, n in self.opened.counts.items() if k != "parsed"} | {"archives": archives}

    def first_rows(self) -> DataFrame:
        """(document_id, first_row, position): documents in the order of their vectors."""
        first = self.opened.table("chunks").groupBy("document_id").agg(F.min("vector_row").alias("first_row"))
        return first.withColumn("position", F.row_number().over(Window.orderBy("first_row")))

    def invalid_values(self) -> list[str]:
        """Columns with values out of their vocabularies, and numbers below 0: one pass a table."""
        wrong = []
        for table in sorted({t for t, _ in VOCABULARIES} | set(NOT_NEGATIVE)):
            tests = {f"{table}.{c}": ~F.col(c).isin(*values) | F.col(c).isNull() for (t, c), values in VOCABULARIES.items() if t == table}
            tests |= {f"{table}.{c}": F.coalesce(F.col(c) < 0, F.lit(True)) for c in NOT_NEGATIVE.get(table, ())}
            found = self.opened.table(table).agg(*[F.count_if(t).alias(str(i)) for i, t in enumerate(tests.values())]).first()
            wrong += [name for i, name in enumerate(tests) if found[i]]
        return wrong
