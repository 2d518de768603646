"""Analysis of texts into postings, and BM25 over an index by clauses on fields.

A search reads only the postings of its own terms, as their blocks lie sorted by
term, and never the texts. Documents have numbers in it, and their ids again at
the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions import text as tx
from quillspan.functions.stemmer import stem
from quillspan.operators import blocks
from quillspan.operators.blocks import decoded
from quillspan.store import written

if TYPE_CHECKING:
    from quillspan.operators.index import Index

K1, B = 1.2, 0.75
#: Boosts of a query word, and of all words as a phrase, by field.
FIELD_BOOSTS = {"heading": 3.0, "caption": 2.5, "body": 1.0, "code": 1.2}
PHRASE_BOOSTS = {"heading": 4.5, "caption": 3.5, "body": 1.5, "code": 1.7}
#: Boosts of a whole symbol and of a part of one.
SYMBOL_BOOST, COMPONENT_BOOST = 8.0, 2.0
OVERFETCH, MOST_FETCHED = 4, 400
FIELDS = (*FIELD_BOOSTS, "symbol")


@F.pandas_udf(T.StringType())
def stem_of(terms: pd.Series) -> pd.Series:
    return terms.map(stem)


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_all(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda own: None if own is None else [stem(t) for t in own])


def analyzed(text: Column, stemming: bool) -> Column:
    """Lower-cased tokens of queries, by their stems if asked; texts have theirs by ``stems``."""
    return stemmed_all(tx.tokens(text)) if stemming else tx.tokens(text)


def structural_caption(text: Column) -> Column:
    """The caption in the prefix of a table's or diagram's text: its last line, where it has three or more."""
    lines = F.split(F.split(text, "\n\n")[0], "\n")
    return F.when(F.size(lines) >= 3, F.element_at(lines, -1))


def chunk_fields(chunks: DataFrame) -> DataFrame:
    """(chunk_id, heading, caption, body, code, symbols) of a table of chunks."""
    code = F.col("kind") == "code"
    return chunks.select(
        "chunk_id",
        F.array_join("heading_path", " > ").alias("heading"),
        F.when(F.col("kind").isin("table", "diagram"), structural_caption(F.col("text"))).alias("caption"),
        F.when(~code, F.col("text")).alias("body"),
        F.when(code, F.col("text")).alias("code"),
        "symbols",
    )


def field_tokens(fields: DataFrame) -> DataFrame:
    """(doc_no, field, tokens) of each field that a document has; symbols are whole, normalised."""
    own = [F.struct(F.lit(f).alias("field"), tx.tokens(F.col(f)).alias("tokens")) for f in FIELD_BOOSTS if f in fields.columns]
    if "symbols" in fields.columns:
        own.append(F.struct(F.lit("symbol").alias("field"), F.filter(F.transform("symbols", tx.normalized_symbol), lambda s: s != "").alias("tokens")))
    return fields.select("doc_no", F.explode(F.array(*own)).alias("_f")).select("doc_no", "_f.field", "_f.tokens").where(F.size("tokens") > 0)


#: Tokens that a task counts together, each some hundred bytes meanwhile: the runs of a common term are the longer for it.
TOGETHER = 2_000_000
#: The same where runs are opened at once, so that their length is of no use.
OPENED_TOGETHER = 1 << 18


def _counted(held: list[pa.RecordBatch], apart: bool) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()
    for batch in rows:
        number = batch.column("doc_no").to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(~np.isin(np.diff(number), (0, 1))) + 1 if apart else np.empty(0, np.int64)
        for start, end in itertools.pairwise([0, *begins.tolist(), len(number)]):
            part = batch.slice(start, end - start)
            for field in part.column("field").unique().to_pylist():
                own = part.filter(pc.equal(part.column("field"), field))
                tokens = own.column("tokens")
                yield blocks.run_rows(own.column("doc_no").to_numpy(zero_copy_only=False), field, pc.list_value_length(tokens).to_numpy(zero_copy_only=False), tokens.flatten())


def run_batches(batches: Iterator[pa.RecordBatch], apart: bool, together: int) -> Iterator[pa.RecordBatch]:
    """The runs of batches of ``field_tokens``, of ``together`` tokens at a time, or of one text that has more."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        # a batch of long texts is taken in parts
        for part in blocks.portions(batch, pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False), together):
            more = int(pc.sum(pc.list_value_length(part.column("tokens"))).as_py())
            if held and n + more > together:
                yield from _counted(held, apart)
                held, n = [], 0
            held.append(part)
            n += more
    if held:
        yield from _counted(held, apart)


def runs(fields: DataFrame, apart: bool = True) -> DataFrame:
    """Postings of each distinct token of a field, as runs over successive documents, without a shuffle.

    Documents whose numbers follow one another are counted together, as arrays,
    so ranges of runs of one term never cross. Where that does not matter, all
    that a task holds are counted together unless they are to be kept ``apart``.
    """
    return field_tokens(fields).mapInArrow(lambda batches: run_batches(batches, apart, TOGETHER), blocks.RUN)


def postings(fields: DataFrame, stemming: bool = True) -> DataFrame:
    """(field, term, doc_no, tf, length, positions): a row for each distinct token of a field of a document.

    A document's tokens are in one task, so they are counted before the shuffle.
    """
    found = field_tokens(fields).mapInArrow(lambda batches: blocks.of_runs(run_batches(batches, False, OPENED_TOGETHER)), f"{blocks.POSTING}, positions array<int>")
    return by_stem(written(found, "raw-postings")) if stemming else found


def term_counts(fields: DataFrame, stemming: bool) -> DataFrame:
    """(field, term, n_with, n_places) of documents. Without stems these are sums over runs, and no posting is a row."""
    if stemming:
        return postings(fields).groupBy("field", "term").agg(F.count("*").alias("n_with"), F.sum("tf").alias("n_places"))
    return runs(fields, apart=False).groupBy("field", "term").agg(F.sum(F.size("doc_nos")).alias("n_with"), F.sum("n_places").alias("n_places"))


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct term: Python sees each once, however many texts have it."""
    return terms.select("term").distinct().select("term", stem_of("term").alias("stem"))


def by_stem(raw: DataFrame) -> DataFrame:
    """Postings of stems from those of tokens; symbols are as they are."""
    whole = F.col("field") == "symbol"
    named = raw.join(stems(raw.where(~whole)), "term", "left").withColumn("term", F.when(whole, F.col("term")).otherwise(F.col("stem")))
    found = named.groupBy("field", "term", "doc_no", "length").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return found.select("field", "term", "doc_no", "tf", "length", "positions")


def plain_tokens(text: str) -> Iterator[str]:
    """As the column function of tokens, for a query."""
    import regex

    return (m[0] for m in regex.finditer(tx.TOKEN, text.lower()))


def idf(n_docs: Column, n_with: Column) -> Column:
    return F.log(1 + (n_docs - n_with + 0.5) / (n_with + 0.5))


def saturation(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def asked_terms(index: Index, queries: DataFrame, query: str = "query_id", query_text: str = "query", field: str = "body") -> DataFrame:
    """(query_id, field, term, weight, mean): the terms of each query that the field has, by their idf."""
    asked = queries.select(F.col(query).alias("query_id"), F.explode(F.array_distinct(analyzed(F.col(query_text), index.stemming))).alias("term"))
    known = index.terms.where(F.col("field") == field).select("field", "term", idf(F.lit(float(index.n_docs)), F.col("n_with")).alias("weight"))
    return asked.join(known, "term").select("query_id", "field", "term", "weight", F.lit(index.mean_length(field)).alias("mean"))


def bm25(index: Index, queries: DataFrame, query: str = "query_id", query_text: str = "query", binary: bool = True, field: str = "body") -> DataFrame:
    """(query_id, chunk_id, score) for every query of a table and text that share a token of one field.

    The blocks of all terms that are asked for are read once. tf is binary
    unless asked.
    """
    asked = written(asked_terms(index, queries, query, query_text, field), "asked")
    held = index.blocks.where(F.col("field") == field).join(asked.select("term").distinct(), "term", "left_semi")
    rows = index.alive(decoded(held)).join(asked.select("query_id", "term", "weight", "mean"), "term")
    tf = F.lit(1.0) if binary else F.col("tf").cast("double")
    scores = rows.groupBy("query_id", "doc_no").agg(F.sum(F.col("weight") * saturation(tf, F.col("length").cast("double"), F.col("mean"))).alias("score"))
    return index.named(scores).select("query_id", "chunk_id", "score")


def word_clauses(index: Index, words: list[str]) -> DataFrame:
    """(doc_no, clause, score): each word in each field, by the field's boost, occurrences not counted."""
    found = index.of_terms(words, list(FIELD_BOOSTS))
    boost = F.create_map(*[F.lit(x) for pair in FIELD_BOOSTS.items() for x in pair])
    return found.select("doc_no", F.concat_ws(":", "field", "term").alias("clause"), (boost[F.col("field")] * F.col("idf") * saturation(F.lit(1.0), F.col("length").cast("double"), F.col("mean"))).alias("score"))


def phrase_clauses(index: Index, words: list[str]) -> DataFrame:
    """(doc_no, clause, score): all words in a row in a field, by the field's boost; occurrences count, and the words' idf add up."""
    found = index.of_terms(words, list(PHRASE_BOOSTS), positions=True)
    place = F.array_position(F.array(*map(F.lit, words)), F.col("term")).cast("int") - 1
    # where the phrase would begin for each place of each word; it is there if all words say so
    begins = found.select("doc_no", "field", "term", "idf", "length", "mean", F.explode(F.transform("positions", lambda p: p - place)).alias("_at"))
    whole = begins.groupBy("field", "doc_no", "length", "mean", "_at").agg(F.count("*").alias("_n"), F.sum("idf").alias("idf")).where(F.col("_n") == len(words))
    counted = whole.groupBy("field", "doc_no", "length", "mean").agg(F.count("*").cast("double").alias("tf"), F.max("idf").alias("idf"))
    boost = F.create_map(*[F.lit(x) for pair in PHRASE_BOOSTS.items() for x in pair])
    return counted.select("doc_no", F.concat_ws(":", F.lit("phrase"), "field").alias("clause"), (boost[F.col("field")] * F.col("idf") * saturation(F.col("tf"), F.col("length").cast("double"), F.col("mean"))).alias("score"))


def symbol_clauses(index: Index, symbols: list[str]) -> DataFrame:
    """(doc_no, clause, score): each symbol whole, and its parts, among the whole symbols of the texts. A term that two symbols ask for counts for each."""
    whole = [s for s in dict.fromkeys(map(normalized_symbol, symbols)) if s]
    asked = [(t, SYMBOL_BOOST if i == 0 else COMPONENT_BOOST, n) for n, s in enumerate(whole) for i, t in enumerate(symbol_terms(s))]
    found = index.of_terms(sorted({t for t, _, _ in asked}), ["symbol"])
    boosts = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(b).alias("b"), F.lit(n).alias("n")) for t, b, n in asked]).cast("array<struct<t:string,b:double,n:int>>")
    each = found.withColumn("_b", F.explode(F.filter(boosts, lambda x: x["t"] == F.col("term"))))
    return each.select("doc_no", F.concat_ws(":", F.lit("symbol"), F.col("_b.n").cast("string"), "term").alias("clause"), (F.col("_b.b") * F.col("idf") * saturation(F.lit(1.0), F.col("length").cast("double"), F.col("mean"))).alias("score"))


_SYMBOL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789#._:/-[]"


def normalized_symbol(word: str) -> str:
    """As the column function of that name, for a query."""
    at = [i for i, c in enumerate(word) if c in _SYMBOL_CHARS]
    inner = word[at[0] : at[-1] + 1] if at else ""
    return "".join(c.upper() if c.isascii() else c for c in inner.strip("._:/-"))


def symbol_terms(symbol: str) -> list[str]:
    """A normalised symbol and its parts, each once."""
    import re

    return list(dict.fromkeys(t for t in [symbol, *[p.lstrip("#") for p in re.split(r"[._:/\-\[\]]", symbol)]] if t))


def exact_symbols(text: str) -> list[str]:
    """Words of a query that look like symbols: of ASCII, with one of ``#._:[]`` or both a digit and a letter."""
    found = [normalized_symbol(w) for w in text.split()]
    looks = lambda s: s and s.isascii() and (any(c in "#._:[]" for c in s) or (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)))
    return list(dict.fromkeys(s for s in found if looks(s)))


def scored(index: Index, words: list[str], symbols: list[str]) -> DataFrame:
    """(chunk_id, score): the sum over all clauses of a request, whose words and symbols are unique; ValueError if it has neither."""
    parts = []
    if words:
        parts.append(word_clauses(index, words))
    if len(words) >= 2:
        parts.append(phrase_clauses(index, words))
    if symbols:
        parts.append(symbol_clauses(index, symbols))
    if not parts:
        raise ValueError("a request needs words or symbols")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return index.named(out.groupBy("doc_no").agg(F.sum("score").alias("score")))


def phrase_hits(df: DataFrame, key: str, text: str, phrase: str) -> DataFrame:
    """Texts whose tokens hold the phrase's tokens in a row, with the number of places."""
    joined = F.concat(F.lit(" "), F.array_join(tx.tokens(F.col(text)), "  "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.array_join(tx.tokens(F.lit(phrase)), "  "), F.lit(" "))
    found = df.select(F.col(key).alias("chunk_id"), ((F.length(joined) - F.length(F.replace(joined, wanted, F.lit("")))) / F.length(wanted)).cast("long").alias("n_places"))
    return found.where(F.col("n_places") > 0)


def weighted_overfetch(scores: DataFrame, weight: str, limit: int) -> DataFrame:
    """First min(4 * limit, 400) by score, then the weight, then the limit: a weight cannot bring back what the first cut left out."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    fetched = scores.orderBy(F.desc("score"), "chunk_id").limit(min(OVERFETCH * limit, MOST_FETCHED))
    return fetched.withColumn("score", F.round(F.col("score") * F.col(weight), 6)).orderBy(F.desc("score"), "chunk_id").limit(limit)
