"""The registered queries of the engine's own operators, and SQL for DuckDB that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.ingest import chunker, manual
from quillspan.operators import context, lexical, navigate, rank, reuse, snapshot, structure, topk, vector, vectorfile
from quillspan.operators.index import Index
from quillspan.plans import manuals
from quillspan.sources import archives
from quillspan.store import shared_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKEN = tx.TOKEN
QUERY_TEXT = "the onesen erblest that ti inenan"
SYMBOL_QUERY = "THE"
QUERY_VECTOR = [float((7 * i) % 11 - 5) for i in range(64)]


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _lines(spark, sf_dir):
    return structure.numbered_lines(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


# sources and fingerprints


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def doc_fingerprints(spark, sf_dir):
    return reuse.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_duplicates(spark, sf_dir):
    return reuse.duplicates(doc_fingerprints(spark, sf_dir), "doc_id")


@query("SELECT lang || '/' || doc_id || '.md' AS entry_path, CAST(strlen(text) AS BIGINT) AS byte_len, sha256(text) AS sha256 FROM documents WHERE lang = 'en'")
def archive_entries(spark, sf_dir):
    """Documents as entries of eight ZIP archives, of which those of one folder are read: the filter on paths reaches the archives' directories."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    entries = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("archive"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("entry_path"), F.col("text").alias("content"))
    made = archives.write_archives(entries, shared_path(spark, "archives"))
    found = archives.zip_entries(spark, [r["uri"] for r in made.select("uri").collect()], split_bytes=1 << 20)  # a row an archive
    return found.where(F.col("entry_path").startswith("en/")).select("entry_path", "byte_len", F.sha2("content", 256).alias("sha256"))


# text


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents),
n AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS line_no FROM l)
SELECT doc_id, line_no, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start,
CAST(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS byte_end FROM n""")
def line_blocks(spark, sf_dir):
    return _lines(spark, sf_dir)


_BARE = r"regexp_replace(regexp_replace(trim({0}), '^[0-9.]*[ \t]*', ''), '^CHAPTER ', '')"


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), n AS (SELECT doc_id, x[1] AS heading, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS line_no FROM l),
m AS (SELECT trim(line) AS line, lower(trim(line)) AS low, {_BARE.format("line")} AS bare, {_BARE.format("heading")} AS h, CASE WHEN doc_id % 2 = 0 THEN 'front_matter' ELSE 'substantive' END AS inherited FROM n WHERE line_no > 1)
SELECT CASE WHEN line <> '' AND (low IN ('intel logo', 'amd logo') OR (strlen(line) < 48 AND (starts_with(low, 'vol. ') OR starts_with(low, 'volume '))) OR (strlen(line) <= 120 AND regexp_matches(line, '\\p{{L}}') AND NOT regexp_matches(line, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') AND (ends_with(h, bare) OR ends_with(bare, h)))) THEN 'page_furniture'
WHEN inherited = 'front_matter' AND (contains(low, 'all rights reserved') OR contains(low, 'no product or component') OR contains(low, 'warranties') OR contains(low, 'copyright')) THEN 'legal' ELSE inherited END AS content_class, count(*) AS n FROM m GROUP BY 1""")
def block_class(spark, sf_dir):
    """Lines under the first line of their text as a heading; even documents count as front matter."""
    lines = _lines(spark, sf_dir)
    first = lines.where("line_no = 1").select("doc_id", F.col("line").alias("heading"))
    inherited = F.when(F.col("doc_id") % 2 == 0, "front_matter").otherwise("substantive")
    rows = lines.where("line_no > 1").join(first, "doc_id")
    return rows.groupBy(tx.content_class(F.col("line"), inherited, F.array("heading")).alias("content_class")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS collapsed FROM documents")
def whitespace_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.collapsed(F.col("text")).alias("collapsed"))


@query("SELECT doc_id, CAST((2 * length(text) + 6) // 7 AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) > 700 THEN substring(text, 1, 700) || '…' ELSE text END AS snippet FROM documents")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS heading FROM pages""")
def page_headings(spark, sf_dir):
    part = lambda tag: F.regexp_extract("html", rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return table(spark, sf_dir, "pages").select("page_id", part("title").alias("title"), part("h1").alias("heading"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("target"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS content FROM pages""")
def page_text(spark, sf_dir):
    body = F.regexp_replace(F.regexp_extract("html", r"(?s)<article>(.*)</article>", 1), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", tx.collapsed(body).alias("content"))


# lexical analysis and scoring

_TOKENS = rf"toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM documents)"


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_terms FROM toks")
def analyzer_terms(spark, sf_dir):
    toks = tx.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_terms"))


@query(f"WITH {_TOKENS}, p AS (SELECT doc_id, unnest(w) AS term FROM toks) SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places FROM p GROUP BY term")
def term_stats(spark, sf_dir):
    return manuals.document_index(spark, sf_dir).terms.where("field = 'body'").select("term", F.col("n_with").alias("n_docs"), "n_places")


@query(f"""WITH f AS (SELECT doc_id, 'heading' AS field, regexp_extract_all(lower(source), '{TOKEN}') AS w FROM documents UNION ALL SELECT doc_id, 'body', regexp_extract_all(lower(text), '{TOKEN}') FROM documents
UNION ALL SELECT doc_id, 'symbol', list_filter(list_transform(list_distinct(regexp_extract_all(text, '{tx.SYMBOL}')), lambda x: upper(trim(x, '._:/-'))), lambda x: x <> '') FROM documents), p AS (SELECT field, doc_id, unnest(w) AS term FROM f)
SELECT field, count(DISTINCT term) AS n_terms, count(DISTINCT (doc_id, term)) AS n_postings, count(*) AS n_places FROM p GROUP BY field""")
def index_build(spark, sf_dir):
    """The stored index of the documents, by field; the queries below read it."""
    rows = manuals.document_index(spark, sf_dir).terms
    return rows.groupBy("field").agg(F.count("*").alias("n_terms"), F.sum("n_with").alias("n_postings"), F.sum("n_places").alias("n_places"))


@query(f"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{TOKEN}')) AS d, regexp_extract_all(lower(text), '{TOKEN}') AS w FROM benchmark UNION ALL SELECT -1 - conv_id * 1000 - turn, list_distinct(regexp_extract_all(lower(text), '{TOKEN}')), regexp_extract_all(lower(text), '{TOKEN}') FROM conversations WHERE turn % 3 <> 1),
p AS (SELECT item_id, unnest(w) AS term FROM w) SELECT term, count(DISTINCT item_id) AS n_docs, count(*) AS n_places FROM p GROUP BY term""")
def index_segments(spark, sf_dir):
    """Terms after an index of conversations has lost a third of its turns and gained the benchmark's items, as two more states of the same segments."""
    turns = table(spark, sf_dir, "conversations").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("chunk_id"), F.col("text").alias("body"), "turn")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("chunk_id"), F.col("text").alias("body"))
    first = Index.write(turns.where("turn % 3 < 2").drop("turn"), shared_path(spark, "segments"), stemming=False)
    second = first.updated(items.where("chunk_id % 2 = 0"), turns.where("turn % 3 = 1").drop("turn"))
    third = second.updated(items.where("chunk_id % 2 <> 0").unionByName(turns.where("turn % 3 = 2").drop("turn")))
    return third.terms.select("term", F.col("n_with").alias("n_docs"), "n_places")


@query("SELECT n_regionkey, count(*) AS n_rows, n_regionkey % 2 = 1 AS damaged FROM nation GROUP BY n_regionkey")
def snapshot_damage(spark, sf_dir):
    """A snapshot of the nations, a file a region, of which one byte of every odd region's file is changed: what reading all files finds."""
    root = shared_path(spark, "damaged")
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").persist()
    regions = [r[0] for r in nations.select("n_regionkey").distinct().collect()]  # a row a region
    snapshot.publish(spark, root, {"v": 1}, {f"region{k}": nations.where(F.col("n_regionkey") == k).coalesce(1) for k in regions})
    nations.unpersist()
    opened = snapshot.Snapshot.current(spark, root)
    for path, _ in opened.store.files(f"generations/{opened.generation}"):
        if (found := re.search(r"/region(\d+)/.*\.parquet$", path)) and int(found[1]) % 2:
            opened.store.flip(path, 20)
    bad = opened.damaged().select("path", F.lit(True).alias("damaged"))
    key = F.regexp_extract("path", r"/region(\d+)/", 1).cast("int")
    rows = reduce(DataFrame.unionByName, [opened.table(f"region{k}").select("n_regionkey") for k in regions if k % 2 == 0] + [table(spark, sf_dir, "nation", "n_regionkey").where("n_regionkey % 2 = 1")])
    files = opened.files.join(bad, "path", "left").groupBy(key.alias("n_regionkey")).agg(F.coalesce(F.max("damaged"), F.lit(False)).alias("damaged"))
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("n_rows")).join(files, "n_regionkey").select("n_regionkey", "n_rows", "damaged")


@query(f"WITH {_TOKENS} SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_tokens, round(avg(len(w)), 6) AS mean_length FROM toks")
def doc_lengths(spark, sf_dir):
    n = F.size(tx.tokens(F.col("text")))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.sum(n).cast("long").alias("n_tokens"), F.round(F.avg(n), 6).alias("mean_length"))


def _bm25_sql(where: str = "true", queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark", tf: str = "1.0") -> str:
    return rf"""q AS ({queries}),
asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '{TOKEN}')) AS term FROM q),
{_TOKENS},
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM toks),
p AS (SELECT doc_id, len AS length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
d AS (SELECT term, count(*) AS n_with FROM p GROUP BY term),
scores AS (SELECT query_id, doc_id AS chunk_id, sum(ln(1 + (n - n_with + 0.5) / (n_with + 0.5)) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * length / mean))) AS score
FROM asked JOIN p USING (term) JOIN d USING (term), stats WHERE doc_id IN (SELECT doc_id FROM documents WHERE {where}) GROUP BY 1, 2)"""


def _benchmark(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _bm25(spark, sf_dir, k, queries=None, binary=True, where="true"):
    """What may be among the first k by the stored postings; filters do not change the numbers that terms are weighed by."""
    index, allowed = manuals.document_index(spark, sf_dir), None
    if where != "true":
        allowed = index.docs.join(table(spark, sf_dir, "documents").where(where).select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi").select("doc_no")
    asked = lexical.asked_terms(index, _benchmark(spark, sf_dir) if queries is None else queries)
    scores = index.named(topk.best(index, asked, k, binary, allowed))
    return scores.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _first(scores: DataFrame, n: int) -> DataFrame:
    """The first n of each query; the rank filter works before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


_FIRST = "SELECT query_id, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS INT) AS rank FROM scores QUALIFY rank <= "


@query(f"WITH {_bm25_sql()} {_FIRST} 10")
def bm25_topk(spark, sf_dir):
    return _first(_bm25(spark, sf_dir, 10), 10)


@query(f"WITH {_bm25_sql()} {_FIRST} 10")
def bm25_pruned_topk(spark, sf_dir):
    """By the bounds of blocks: those that cannot reach the first ten are not read."""
    index = manuals.document_index(spark, sf_dir)
    found = topk.first(index, lexical.asked_terms(index, _benchmark(spark, sf_dir)), 10)
    return _first(index.named(found.scores).withColumn("score", F.round("score", 6)), 10)


@query(f"WITH {_bm25_sql(tf='tf')} {_FIRST} 5")
def bm25_raw_tf(spark, sf_dir):
    return _first(_bm25(spark, sf_dir, 5, binary=False), 5)


_LANGS = "lang IN ('de', 'fr')"


@query(f"WITH {_bm25_sql(_LANGS)} {_FIRST} 10")
def bm25_filtered(spark, sf_dir):
    return _first(_bm25(spark, sf_dir, 10, where=_LANGS), 10)


_ONE = f"SELECT 0 AS query_id, '{QUERY_TEXT}' AS query"


def _one(spark, text: str = QUERY_TEXT):
    return spark.range(1).select(F.col("id").cast("int").alias("query_id"), F.lit(text).alias("query"))


@query(f"""WITH {_bm25_sql(queries=_ONE)},
fetched AS (SELECT chunk_id, round(score, 6) AS score FROM scores ORDER BY 2 DESC, 1 LIMIT 100),
best AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)
SELECT chunk_id, round(score * CASE WHEN quality = 0 THEN 0.35 ELSE 1.0 END, 6) AS score FROM fetched LEFT JOIN best ON doc_id = chunk_id ORDER BY 2 DESC, 1 LIMIT 25""")
def bm25_weighted_overfetch(spark, sf_dir):
    best = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("chunk_id")).agg(F.max("quality").alias("quality"))
    scores = _bm25(spark, sf_dir, 100, _one(spark)).select("chunk_id", "score").join(best, "chunk_id", "left")
    return lexical.weighted_overfetch(scores.withColumn("weight", F.when(F.col("quality") == 0, 0.35).otherwise(1.0)), "weight", 25).select("chunk_id", "score")


@query(f"""WITH {_TOKENS}, j AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS t FROM toks)
SELECT doc_id AS chunk_id, CAST((length(t) - length(replace(t, ' of  the ', ''))) / 9 AS BIGINT) AS n_places FROM j WHERE contains(t, ' of  the ')""")
def phrase_match(spark, sf_dir):
    return lexical.phrase_hits(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", "Of the")


_FIELDS = f"""f AS (SELECT doc_id, 'heading' AS field, regexp_extract_all(lower(source), '{TOKEN}') AS w FROM documents UNION ALL SELECT doc_id, 'body', regexp_extract_all(lower(text), '{TOKEN}') FROM documents
UNION ALL SELECT doc_id, 'symbol', list_filter(list_transform(list_distinct(regexp_extract_all(text, '{tx.SYMBOL}')), lambda x: upper(trim(x, '._:/-'))), lambda x: x <> '') FROM documents),
n AS (SELECT count(*) AS n FROM documents), means AS (SELECT field, sum(len(w)) / any_value(n) AS mean FROM f, n GROUP BY field),
p AS (SELECT DISTINCT field, doc_id, length, term FROM (SELECT field, doc_id, len(w) AS length, unnest(w) AS term FROM f)),
d AS (SELECT field, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, n GROUP BY field, term)"""
_SATURATED = "{0} * 2.2 / ({0} + 1.2 * (0.25 + 0.75 * length / mean))"
_CLAUSE_QUERY, _PHRASE, _SYMBOL_TEXT = "the source of that 3", ["of", "the"], "THE.AND"


@query(f"""WITH {_FIELDS} SELECT doc_id AS chunk_id, round(sum((CASE field WHEN 'heading' THEN 3.0 ELSE 1.0 END) * idf * {_SATURATED.format("1.0")}), 6) AS score FROM p JOIN d USING (field, term) JOIN means USING (field)
WHERE field <> 'symbol' AND term IN (SELECT unnest(regexp_extract_all(lower('{_CLAUSE_QUERY}'), '{TOKEN}'))) GROUP BY doc_id""")
def bm25_fields(spark, sf_dir):
    """Words in headings and bodies, by their boosts."""
    index = manuals.document_index(spark, sf_dir)
    return index.named(lexical.word_clauses(index, index.query_words(_CLAUSE_QUERY)).groupBy("doc_no").agg(F.round(F.sum("score"), 6).alias("score")))


@query(f"""WITH {_FIELDS}, j AS (SELECT doc_id, len(w) AS length, ' ' || array_to_string(w, '  ') || ' ' AS t FROM f WHERE field = 'body'),
c AS (SELECT doc_id, length, (length(t) - length(replace(t, ' of  the ', ''))) / 9.0 AS tf FROM j WHERE contains(t, ' of  the '))
SELECT doc_id AS chunk_id, round(1.5 * (SELECT sum(idf) FROM d WHERE field = 'body' AND term IN ('of', 'the')) * {_SATURATED.format("tf")}, 6) AS score FROM c, means WHERE field = 'body'""")
def phrase_clause(spark, sf_dir):
    index = manuals.document_index(spark, sf_dir)
    return index.named(lexical.phrase_clauses(index, _PHRASE).select("doc_no", F.round("score", 6).alias("score")))


@query(f"""WITH {_FIELDS}, asked AS (SELECT * FROM (VALUES ('THE.AND', 8.0), ('THE', 2.0), ('AND', 2.0)) AS v(term, boost))
SELECT doc_id AS chunk_id, round(sum(CAST(boost AS DOUBLE) * idf * {_SATURATED.format("1.0")}), 6) AS score FROM asked JOIN p USING (term) JOIN d USING (field, term) JOIN means USING (field) WHERE field = 'symbol' GROUP BY doc_id""")
def symbol_clause(spark, sf_dir):
    index = manuals.document_index(spark, sf_dir)
    return index.named(lexical.symbol_clauses(index, [_SYMBOL_TEXT]).groupBy("doc_no").agg(F.round(F.sum("score"), 6).alias("score")))


# symbols

_SYMBOLS = rf"syms AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{tx.SYMBOL}'))) AS symbol FROM documents)"


@query(f"WITH {_SYMBOLS} SELECT doc_id, symbol FROM syms")
def symbol_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.symbols(F.col("text"))).alias("symbol"))


@query(f"""WITH {_SYMBOLS}, parts AS (SELECT DISTINCT symbol, unnest(list_concat([symbol], list_transform(regexp_split_to_array(symbol, '[._:/\\-\\[\\]]+'), lambda p: ltrim(p, '#')))) AS term FROM syms)
SELECT DISTINCT symbol, term FROM parts WHERE term <> ''""")
def symbol_terms(spark, sf_dir):
    return symbol_extract(spark, sf_dir).select("symbol").distinct().select("symbol", F.explode(tx.symbol_terms(F.col("symbol"))).alias("term"))


@query(f"WITH {_SYMBOLS} SELECT doc_id, 8.0 AS score FROM syms WHERE symbol = '{SYMBOL_QUERY}' ORDER BY doc_id LIMIT 20".replace("8.0", "CAST(8.0 AS DOUBLE)"))
def symbol_exact_topk(spark, sf_dir):
    return _exact(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), "score").orderBy("doc_id").limit(20)


def _exact(spark, sf_dir):
    """Documents that have the symbol, by its postings."""
    index = manuals.document_index(spark, sf_dir)
    return index.named(index.of_terms([SYMBOL_QUERY], ["symbol"]).select("doc_no")).select("chunk_id", F.lit(lexical.SYMBOL_BOOST).alias("score"))


# vectors

_VECTOR = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "]"
_COSINE = f"SELECT vec_id, round(list_dot_product(e, {_VECTOR}) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product({_VECTOR}, {_VECTOR})), 6) AS score, list_dot_product(e, {_VECTOR}) / sqrt(list_dot_product(e, e)) AS exact FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"SELECT vec_id, score FROM ({_COSINE}) ORDER BY exact DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 20)


@query(f"SELECT vec_id, score FROM ({_COSINE} WHERE label IN (1, 3)) ORDER BY exact DESC, vec_id LIMIT 20")
def cosine_topk_filtered(spark, sf_dir):
    return vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 20, F.col("label").isin(1, 3))


@query("""WITH u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS s FROM u AS q, u AS v WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(s, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, vec_id) AS INT) AS rank FROM p QUALIFY rank <= 10""")
def cosine_many_topk(spark, sf_dir):
    """The ten nearest of every vector whose id is divisible by 50, from files of vectors, in one pass over the rows."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = vectorfile.nearest(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), 10, shared_path(spark, "vectors"))
    return found.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


@query("""SELECT count(*) AS n_vectors, count(*) FILTER (len(embedding) <> 64) AS n_wrong_size, CAST(0 AS BIGINT) AS n_not_finite,
count(*) FILTER (abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-4) AS n_not_unit FROM embeddings""")
def vector_norm_check(spark, sf_dir):
    return vector.health(table(spark, sf_dir, "embeddings"), "embedding", 64)


# the search pipeline: an exact leg on a symbol, a lexical one, a semantic one on vectors of the same ids

_LEGS = f"""{_bm25_sql(queries=_ONE)}, {_SYMBOLS},
lex AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 6) DESC, chunk_id) AS r FROM scores QUALIFY r <= 100),
ex AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY doc_id) AS r FROM syms WHERE symbol = '{SYMBOL_QUERY}' QUALIFY r <= 100),
cos AS ({_COSINE}), sem AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY exact DESC, vec_id) AS r FROM cos QUALIFY r <= 100),
fused AS (SELECT chunk_id, sum(1.0 / (60 + r)) AS rrf, count(*) AS n_legs FROM (SELECT * FROM lex UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM sem) GROUP BY chunk_id)"""


def _fused(spark, sf_dir):
    lex = _bm25(spark, sf_dir, 100, _one(spark)).select("chunk_id", "score")
    exact = _exact(spark, sf_dir)
    sem = vector.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", QUERY_VECTOR, 100).select(F.col("vec_id").alias("chunk_id"), "score")
    return rank.fused(rank.ranked(lex, "lexical"), rank.ranked(exact, "exact"), rank.ranked(sem, "semantic"))


@query(f"WITH {_LEGS} SELECT chunk_id, round(rrf, 6) AS rrf, n_legs FROM fused")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("chunk_id", F.round("rrf", 6).alias("rrf"), "n_legs")


_BOOSTED = f"""{_LEGS}, boosted AS (SELECT chunk_id, source, lang, rrf * (CASE WHEN chunk_id IN (SELECT doc_id FROM syms WHERE symbol = '{SYMBOL_QUERY}') THEN 3.0 ELSE 1.0 END)
* (CASE WHEN contains(lower(array_to_string(string_split(text, chr(10))[1:3], ' ')), 'onesen') THEN 1.25 ELSE 1.0 END) * (CASE WHEN coalesce(quality, 1) = 0 THEN 0.35 ELSE 1.0 END) AS f
FROM fused JOIN documents ON doc_id = chunk_id LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
ranked AS (SELECT chunk_id, source, lang, round(f, 6) AS final FROM boosted)"""


def _boosted(spark, sf_dir):
    best = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("chunk_id")).agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents", F.col("doc_id").alias("chunk_id"), "text", "source", "lang")
    # at most 300 fused rows: they go to the scan of the texts
    rows = docs.join(F.broadcast(_fused(spark, sf_dir)), "chunk_id").join(best, "chunk_id", "left")
    kind = F.when(F.col("quality") == 0, "front_matter").otherwise("substantive")
    factor = rank.boost(F.array_contains(tx.symbols(F.col("text")), SYMBOL_QUERY), rank.heading_of(F.col("text")).contains("onesen"), kind)
    return rows.select("chunk_id", "source", "lang", F.round(F.col("rrf") * factor, 6).alias("final"))


@query(f"WITH {_BOOSTED} SELECT chunk_id, final FROM ranked")
def boost_rank(spark, sf_dir):
    return _boosted(spark, sf_dir).select("chunk_id", "final")


_CAPPED = f"{_BOOSTED}, capped AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY source ORDER BY final DESC, chunk_id) <= 2)"


@query(f"WITH {_CAPPED} SELECT chunk_id, source, final FROM capped")
def section_cap(spark, sf_dir):
    return rank.capped(_boosted(spark, sf_dir), "source", "final", "chunk_id").select("chunk_id", "source", "final")


@query(f"WITH {_CAPPED} SELECT chunk_id, final, CAST(row_number() OVER (ORDER BY final DESC, chunk_id) AS INT) AS position FROM capped QUALIFY position BETWEEN 6 AND 15")
def search_page(spark, sf_dir):
    return rank.page(rank.capped(_boosted(spark, sf_dir), "source", "final", "chunk_id"), "final", "chunk_id", 5, 10).select("chunk_id", "final", "position")


@query(f"""WITH {_bm25_sql(queries=_ONE)}, {_SYMBOLS}, ex AS (SELECT doc_id FROM syms WHERE symbol = '{SYMBOL_QUERY}' ORDER BY doc_id LIMIT 25),
rel AS (SELECT chunk_id, round(score, 6) AS score FROM scores ORDER BY 2 DESC, 1 LIMIT 25) SELECT chunk_id, score FROM rel WHERE chunk_id NOT IN (SELECT doc_id FROM ex)""")
def lookup_related(spark, sf_dir):
    hits = _exact(spark, sf_dir).select("chunk_id").orderBy("chunk_id").limit(25)
    related = _bm25(spark, sf_dir, 25, _one(spark)).select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(25)
    return related.join(hits, "chunk_id", "left_anti")


@query(f"""WITH {_bm25_sql(queries=_ONE)} SELECT lang, chunk_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(score, 6) DESC, chunk_id) AS INT) AS rank
FROM scores JOIN documents ON doc_id = chunk_id WHERE lang IN ('en', 'fr') QUALIFY rank <= 10""")
def facet_compare(spark, sf_dir):
    sides = [_bm25(spark, sf_dir, 10, _one(spark), where=f"lang = '{x}'").withColumn("lang", F.lit(x)) for x in ("en", "fr")]
    rows = reduce(DataFrame.unionByName, sides)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), "chunk_id"))).where("rank <= 10").select("lang", "chunk_id", "score", "rank")


# navigation


@query("SELECT conv_id, turn, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_neighbors(spark, sf_dir):
    return navigate.neighbours(table(spark, sf_dir, "conversations", "conv_id", "turn"), "conv_id", "turn")


@query("SELECT conv_id, turn, concat_ws(chr(10) || chr(10), lag(text) OVER w, lead(text) OVER w) AS surrounding FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_surrounding(spark, sf_dir):
    return navigate.surrounding(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "conv_id", "turn", "text").drop("text")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) > 5 AS has_more FROM conversations QUALIFY position BETWEEN 3 AND 5")
def section_page(spark, sf_dir):
    return navigate.section_page(table(spark, sf_dir, "conversations", "conv_id", "turn"), "conv_id", "turn", 2, 3)


@query("""SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def outline_depth(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    return navigate.outline(r.union(n).union(c))


@query("""WITH h AS (SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_brand), 'bolt') OR contains(lower(p_type), 'bolt') OR contains(CAST(p_partkey AS VARCHAR), 'bolt'))
SELECT *, CAST(row_number() OVER (ORDER BY p_partkey) AS INT) AS position, (SELECT count(*) FROM h) AS total FROM h QUALIFY position BETWEEN 11 AND 30""")
def rows_filter_any_cell(spark, sf_dir):
    return navigate.rows_with(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type"), "BOLT", "p_partkey", 10, 20)


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def counts(spark, sf_dir):
    return navigate.counts(**{t: table(spark, sf_dir, t) for t in ("documents", "pages", "benchmark", "embeddings")})


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 50000) GROUP BY l_orderkey")
def integrity_fk(spark, sf_dir):
    return navigate.orphans(table(spark, sf_dir, "lineitem", "l_orderkey"), "l_orderkey", table(spark, sf_dir, "orders").where("o_totalprice > 50000"), "o_orderkey")


@query("SELECT count(vec_id) AS n, count(DISTINCT vec_id) AS n_distinct, min(vec_id) AS least, max(vec_id) AS greatest, count(vec_id) = count(DISTINCT vec_id) AND min(vec_id) = 0 AND max(vec_id) = count(vec_id) - 1 AS contiguous FROM embeddings")
def integrity_rows(spark, sf_dir):
    return navigate.dense(table(spark, sf_dir, "embeddings"), "vec_id")


# structure

@query(rf"""WITH l AS (SELECT doc_id, regexp_extract_all(text, '{manual.REFERENCE}', 1) AS w, regexp_extract_all(text, '{manual.REFERENCE}', 2) AS l FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark UNION ALL SELECT 1000000 + page_id, html FROM pages
UNION ALL SELECT -10000000 - o_orderkey, 'As Section 3.' || (o_custkey % 90) || ' says, Table ' || o_orderkey || '-1 and figure 2-' || (o_custkey % 40) || ' differ; see Appendix B and Chapter ' || (o_orderkey % 70) || '.' FROM orders)),
r AS (SELECT doc_id, unnest(range(0, len(w))) AS ordinal, lower(unnest(w)) AS word, unnest(l) AS label FROM l)
SELECT doc_id, ordinal, CASE WHEN word IN ('table', 'figure') THEN word ELSE 'section' END AS kind, label, word || ':' || lower(label) AS normalized_key FROM r""")
def ref_extract(spark, sf_dir):
    """Over all texts: documents, benchmark items and pages, which hold hardly any, and a sentence for each order, which holds five."""
    texts = table(spark, sf_dir, "documents", "doc_id", "text")
    texts = texts.union(table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), "text")).union(table(spark, sf_dir, "pages").select((1000000 + F.col("page_id")).alias("doc_id"), "html"))
    said = F.concat(F.lit("As Section 3."), (F.col("o_custkey") % 90).cast("string"), F.lit(" says, Table "), F.col("o_orderkey").cast("string"), F.lit("-1 and figure 2-"), (F.col("o_custkey") % 40).cast("string"), F.lit(" differ; see Appendix B and Chapter "), (F.col("o_orderkey") % 70).cast("string"), F.lit("."))
    texts = texts.union(table(spark, sf_dir, "orders").select((-10000000 - F.col("o_orderkey")).alias("doc_id"), said))
    return structure.references(texts, "doc_id", "text")


_EVENT = "SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN event_id END AS label, CAST(event_id * 7 % 4 + 1 AS INT) AS level, CASE WHEN event_id % 5 = 0 THEN 'caption' WHEN event_id % 3 = 0 THEN 'table' ELSE 'prose' END AS kind FROM events"


def _events(spark, sf_dir):
    kind = F.when(F.col("event_id") % 5 == 0, "caption").when(F.col("event_id") % 3 == 0, "table").otherwise("prose")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("label"), (F.pmod(F.col("event_id") * 7, F.lit(4)) + 1).cast("int").alias("level"), kind.alias("kind"))


@query(f"""WITH e AS ({_EVENT}) SELECT event_id, coalesce((SELECT max(label) FROM e b WHERE b.user_id = a.user_id AND b.event_id <= a.event_id), (SELECT min(label) FROM e b WHERE b.user_id = a.user_id)) AS printed_page FROM e a""")
def page_asof(spark, sf_dir):
    return structure.page_labels(_events(spark, sf_dir), "user_id", "event_id", "label").select("event_id", "printed_page")


@query(f"WITH e AS ({_EVENT}) SELECT event_id, (SELECT min(b.event_id) FROM e b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.level <= a.level) AS section_end FROM e a")
def section_end_range(spark, sf_dir):
    return structure.section_ends(_events(spark, sf_dir), "user_id", "event_id", "level").select("event_id", "section_end")


@query(f"WITH e AS ({_EVENT}) SELECT event_id, (SELECT max(b.event_id) FROM e b WHERE b.user_id = a.user_id AND b.event_id < a.event_id AND b.level < a.level) AS parent_id FROM e a")
def heading_parent(spark, sf_dir):
    return structure.section_parents(_events(spark, sf_dir), "user_id", "event_id", "level", "event_id").select("event_id", "parent_id")


@query(f"""WITH e AS ({_EVENT}) SELECT a.event_id, (SELECT b.event_id FROM e b WHERE b.user_id = a.user_id AND b.kind = 'caption' ORDER BY abs(b.event_id - a.event_id), b.event_id LIMIT 1) AS caption_ordinal FROM e a WHERE a.kind = 'table'""")
def nearest_caption(spark, sf_dir):
    return structure.nearest_caption(_events(spark, sf_dir), "user_id", "event_id", "kind").select("event_id", "caption_ordinal")


@query("""WITH m AS (SELECT *, sum(CASE WHEN lag_role IS NULL OR lag_role <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS lag_role FROM conversations))
SELECT conv_id, role, min(turn) AS first, max(turn) AS last, count(*) AS n_rows FROM m GROUP BY conv_id, role, run""")
def prose_runs(spark, sf_dir):
    return structure.runs(table(spark, sf_dir, "conversations", "conv_id", "turn", "role"), "conv_id", "turn", "role")


# context

_TOP = f"WITH {_bm25_sql()}, top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM scores QUALIFY rank <= 50)"


def _listed(spark, sf_dir):
    """The first fifty of each query, written so that Spark knows their size when it joins texts to them."""
    return written(_first(_bm25(spark, sf_dir, 50), 50), "listed")


@query(f"{_TOP} SELECT query_id, rank, chunk_id, CAST(sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS \"group\" FROM (SELECT top.query_id, top.rank, chunk_id, coalesce(lag(lang) OVER w = lang AND lag(chunk_id) OVER w + 1 = chunk_id, false) AS same FROM top JOIN documents ON doc_id = chunk_id WINDOW w AS (PARTITION BY query_id ORDER BY rank))".replace("SELECT query_id, rank, chunk_id, CAST", "SELECT query_id, CAST(rank AS INT) AS rank, chunk_id, CAST"))
def adjacent_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", F.col("doc_id").alias("chunk_id"), "lang")
    rows = _listed(spark, sf_dir).join(docs, "chunk_id")
    return context.adjacent_groups(rows, "query_id", "rank", "lang", "chunk_id").select("query_id", "rank", "chunk_id", F.col("group").cast("long").alias("group"))


@query(_TOP.replace("WITH ", "WITH RECURSIVE ", 1) + """, t AS (SELECT query_id, rank, (2 * length(text) + 6) // 7 AS tokens FROM top JOIN documents ON doc_id = chunk_id),
f AS (SELECT query_id, rank, tokens, tokens <= 2048 AS included, CASE WHEN tokens <= 2048 THEN tokens ELSE 0 END AS used FROM t WHERE rank = 1
UNION ALL SELECT t.query_id, t.rank, t.tokens, f.used + t.tokens <= 2048, CASE WHEN f.used + t.tokens <= 2048 THEN f.used + t.tokens ELSE f.used END FROM f JOIN t ON t.query_id = f.query_id AND t.rank = f.rank + 1)
SELECT query_id, rank, CAST(tokens AS BIGINT) AS tokens, included, CAST(used AS BIGINT) AS used FROM f""")
def context_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", F.col("doc_id").alias("chunk_id"), "text")
    rows = _listed(spark, sf_dir).join(docs, "chunk_id")
    return context.packed(rows, "query_id", "rank", "text", 2048)


# incremental builds

_OLD = "SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0"
_NEW = "SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN text || ' revised' ELSE text END) AS h FROM documents WHERE doc_id % 13 <> 0"


def _versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    new = docs.where("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text")))
    return reuse.fingerprints(docs.where("doc_id % 7 <> 0"), "doc_id", "text"), reuse.fingerprints(new, "doc_id", "text")


@query(f"SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'reused' ELSE 'changed' END AS state FROM ({_OLD}) o FULL JOIN ({_NEW}) n USING (doc_id)")
def freshness(spark, sf_dir):
    return reuse.changes(*_versions(spark, sf_dir), "doc_id")


@query(f"SELECT n.doc_id FROM ({_NEW}) n LEFT JOIN ({_OLD}) o ON n.doc_id = o.doc_id AND n.h = o.h WHERE o.h IS NULL")
def parse_reuse(spark, sf_dir):
    return reuse.changes(*_versions(spark, sf_dir), "doc_id").where(F.col("state").isin("added", "changed")).select("doc_id")


@query("SELECT sha256(text) AS content_hash, count(*) AS n_chunks FROM documents GROUP BY 1")
def embed_dedup(spark, sf_dir):
    chunks = doc_fingerprints(spark, sf_dir).withColumnRenamed("sha256", "content_hash")
    return reuse.embedding_plan(chunks, chunks.withColumn("vector_row", F.col("doc_id")).limit(0)).select("content_hash", "n_chunks")


@query("SELECT c.h AS content_hash, c.n AS n_chunks, s.r AS first_row FROM (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1) c LEFT JOIN (SELECT sha256(text) AS h, min(doc_id) AS r FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) s USING (h)")
def embed_reuse(spark, sf_dir):
    chunks = doc_fingerprints(spark, sf_dir).withColumnRenamed("sha256", "content_hash")
    return reuse.embedding_plan(chunks, chunks.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "vector_row"))


# parsing and packing

# lines to blocks where no block spans lines by other rules than prose does; the given texts have no fences, tags or tables
_BEGINS = r"regexp_matches({0}, '^\s*#{{1,6}}\s') OR regexp_matches({0}, '^\s*([-*+] |[0-9]+[.)] )') OR starts_with(ltrim({0}), '>') OR regexp_matches(ltrim({0}), '^(Figure |Table |Рисунок |Таблица )')"


@query(f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), n AS (SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i, len(x) AS n FROM l),
o AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER w - strlen(line) - 1, 0) AS place, lag(line) OVER w AS before FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, CASE WHEN before IS NULL OR trim(before) = '' OR {_BEGINS.format("line")} THEN 1 ELSE 0 END AS starts FROM o WHERE trim(line) <> ''),
g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b)
SELECT doc_id, CAST(g - 1 AS INT) AS ordinal, CAST(min(place) AS BIGINT) AS byte_start, CAST(max(place + strlen(line) + CASE WHEN i < n THEN 1 ELSE 0 END) AS BIGINT) AS byte_end, CAST(min(i) AS INT) AS line_start, CAST(max(i) AS INT) AS line_end FROM g GROUP BY doc_id, g""")
def markdown_blocks(spark, sf_dir):
    rows = manual.parsed(_manuals(spark, sf_dir), ["document_id", "blocks"]).select(F.col("document_id").cast("long").alias("doc_id"), F.explode("blocks").alias("b"))
    return rows.select("doc_id", "b.ordinal", "b.span.byte_start", "b.span.byte_end", "b.span.line_start", "b.span.line_end")


def _manuals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("vendor"), F.col("source").alias("archive_id"), F.lit("").alias("archive_sha256"), F.format_string("%d.md", "doc_id").alias("entry_path"), F.sha2(text, 256).alias("content_sha256"), F.octet_length(text).cast("long").alias("byte_len"), text.alias("source"))


@query("")
def chunk_pack(spark, sf_dir):
    rows = chunker.chunked(_manuals(spark, sf_dir))
    return rows.select(F.col("document_id").cast("long").alias("doc_id"), "chunk_ordinal", "kind", "token_count", "content_hash")


QUERIES |= manuals.QUERIES
ORACLES |= manuals.ORACLES
