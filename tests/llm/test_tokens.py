"""Token counts, packing and token files against the library, in plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspan.llm import packing, queries, token_count, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    found = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [e.ids for e in found]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts_equal_the_library(spark, sf):
    rows = queries.op7_token_count(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    want = [len(x) for x in library_ids(docs.text)]
    assert rows.loc[docs.doc_id, "n_tokens"].tolist() == want
    assert rows.loc[docs.doc_id, "n_bytes"].tolist() == [len(t.encode()) for t in docs.text]
    assert rows.loc[docs.doc_id, "over_limit"].tolist() == [n > 512 for n in want]


def test_counts_of_awkward_texts(awkward, empty):
    counted = token_count.count_tokens(awkward, "text", PATH)
    rows = counted.collect()
    assert counted.columns == [c for c in awkward.columns if c != "n_tokens"] + ["n_tokens"]
    assert [r.n_tokens for r in rows] == [len(x) for x in library_ids([r.text for r in rows])]
    assert token_count.count_tokens(empty, "text", PATH).count() == 0


def test_rank_files_give_the_same_merges():
    a = token_count.MergeTable.load(PATH)
    b = token_count.MergeTable.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert all(a.merged(w.encode()) == b.merged(w.encode()) for w in ("hello", " antidisestablishment", "aaaaaaaaaa", "é漢字"))
    with pytest.raises(ValueError):
        token_count.MergeTable.load(public_tokenizers.path("piece_bpe_32k.model"))
    with pytest.raises(ValueError):
        token_count.MergeTable.load(public_tokenizers.path("word_bpe_49k.json"))


def whole_documents(pieces):
    """ids by document from pieces, with each sequence's order checked."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and len(own) <= 64
        assert at == 2048 or at & (at - 1) == 0
    return by_doc


def test_packing_loses_no_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {k: [*ids, 1] for k, ids in zip(texts, library_ids(texts.values()), strict=True)}
    by_doc = whole_documents([r.asDict() for r in queries.op5_packing(spark, sf).collect()])
    assert by_doc.keys() == want.keys()
    for k, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want[k])
            assert p["ids_crc32"] == crc(want[k][at : at + p["length"]])
            at += p["length"]
        assert at == len(want[k])


def test_packing_awkward_texts(awkward, empty):
    rows = awkward.collect()
    got = [r.asDict() for r in packing.pack_documents(awkward, PATH).collect()]
    whole_documents(got)
    assert sum(p["length"] for p in got) == sum(len(x) + 1 for x in library_ids([r.text for r in rows]))
    assert packing.pack_documents(empty, PATH).count() == 0


def test_vector_limits_hold_at_once():
    r = random.Random(3)
    packer = packing.VectorPacker(tokens=100, segments=5, loss=40, cut=False, window=16)
    examples = [(i, n := r.randrange(1, 101), r.randrange(0, min(n, 40) + 1)) for i in range(500)]
    sequences = [s for e in examples for s in packer.add(*e)] + list(packer.finish())
    loss = {i: m for i, _, m in examples}
    for s in sequences:
        assert sum(x[2] for x in s) <= 100 and len(s) <= 5 and sum(loss[x[0]] for x in s) <= 40
    assert sorted(x[0] for s in sequences for x in s) == list(range(500))
    with pytest.raises(ValueError):
        list(packer.add(501, 101, 0))


def plain_packing(examples, tokens, segments, loss, window):
    """Keys by sequence: of what waits and fits, always the one with the largest product of its demands with what is left, each by its limit."""
    limits, waiting, out = (tokens, segments, loss), [], []

    def sequence():
        left, placed = list(limits), []
        while left[0] and left[1]:
            fitting = [(sum(x * y / n**2 for x, y, n in zip(left, (size, 1, bearing), limits, strict=True)), key, size, bearing) for key, size, bearing in waiting if size <= left[0] and bearing <= left[2]]
            if not fitting:
                break
            _, key, size, bearing = max(fitting)
            waiting.remove((key, size, bearing))
            placed.append(key)
            left = [left[0] - size, left[1] - 1, left[2] - bearing]
        out.append(placed)

    for example in examples:
        while len(waiting) >= window:
            sequence()
        waiting.append(example)
    while waiting:
        sequence()
    return out


@pytest.mark.parametrize("seed", range(5))
def test_the_piece_with_the_largest_product_is_placed(seed):
    r = random.Random(seed)
    limits = {"tokens": 1_000_000, "segments": r.choice([3, 6, 50]), "loss": r.choice([200_000, 700_000, 1_000_000])}
    examples = [(i, n := r.randrange(1, r.choice([90_000, 999_999])), r.randrange(0, min(n, limits["loss"]) + 1)) for i in range(300)]
    window = r.choice([1, 7, 40])
    packer = packing.VectorPacker(**limits, cut=False, window=window)
    got = [s for e in examples for s in packer.add(*e)] + list(packer.finish())
    assert [[x[0] for x in s] for s in got] == plain_packing(examples, **limits, window=window)


@pytest.mark.parametrize("seed", range(4))
def test_cut_examples_keep_all_tokens(seed):
    r = random.Random(seed)
    packer = packing.VectorPacker(tokens=64, segments=r.choice([2, 3, 8]), loss=r.choice([10, 40, 64]), cut=True, window=8)
    examples = [(i, n := r.randrange(1, 300), r.randrange(0, n + 1)) for i in range(200)]
    sequences = [s for e in examples for s in packer.add(*e)] + list(packer.finish())
    seen = {i: set() for i, _, _ in examples}
    bears = {i: range(n - m, n) for i, n, m in examples}
    for s in sequences:
        assert sum(x[2] for x in s) <= 64 and len(s) <= packer.segments
        assert sum(len(set(range(a, a + n)) & set(bears[k])) for k, a, n, _ in s) <= packer.loss
        for k, a, n, _ in s:
            assert not seen[k] & set(range(a, a + n))
            seen[k] |= set(range(a, a + n))
    assert all(seen[i] == set(range(n)) for i, n, _ in examples)


def test_examples_table(spark):
    df = spark.createDataFrame([(1, 60, 20, "x"), (2, 60, None, "y"), (2, 60, None, "y"), (3, None, 0, "z")], "id bigint, tokens int, loss int, sequence_id string")
    rows = packing.pack_examples(df.coalesce(1), "id", "tokens", "loss", tokens=128, segments=2).collect()
    assert sorted(r.example_id for r in rows) == [1, 2, 2, 3]
    assert packing.pack_examples(df.limit(0), "id", "tokens", "loss").count() == 0


def test_many_examples_under_all_limits(spark):
    """Instruction data of which each limit binds somewhere: answers in some examples only, many short ones, few long ones."""
    r = random.Random(4)
    rows = []
    for i in range(20_000):
        n = r.choice([r.randrange(1, 12), r.randrange(1, 300), r.randrange(1, 2049)])
        rows.append((i, n, r.randrange(0, min(n, 400) + 1), "x"))
    df = spark.createDataFrame(rows, "id bigint, tokens bigint, loss bigint, sequence_id string").repartition(3)
    got = packing.pack_examples(df, "id", "tokens", "loss", tokens=2048, segments=16, loss=512).collect()
    assert sorted((x.example_id, x.length, x.loss_tokens) for x in got) == [row[:3] for row in rows]
    used = defaultdict(lambda: [0, 0, 0])
    at = defaultdict(list)
    for x in got:
        used[x.sequence_id] = [a + b for a, b in zip(used[x.sequence_id], (x.length, 1, x.loss_tokens), strict=True)]
        at[x.sequence_id].append((x.offset, x.length))
    assert all(a <= 2048 and b <= 16 and c <= 512 for a, b, c in used.values())
    for placed in at.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
    least = max(sum(x[1] for x in rows) / 2048, len(rows) / 16, sum(x[2] for x in rows) / 512)
    assert len(used) < 1.1 * least, "near the bound that the tightest limit sets"


def test_token_files_round_trip(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    at = 0
    got = sorted(queries.op10_token_files(spark, sf).collect())
    for row, (doc, _), ids in zip(got, docs, library_ids([t for _, t in docs]), strict=True):
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc, at, len(ids) + 1, crc([*ids, 2]))
        at += len(ids) + 1


def test_token_files_of_awkward_texts(awkward, empty):
    rows = token_files.token_file_table(awkward, PATH).collect()
    assert len(rows) == awkward.count()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_files.token_file_table(empty, PATH).count() == 0


@pytest.mark.parametrize("values", [[-6 * 10**18, 6 * 10**18], [-(2**63), 0, 2**63 - 1], [-(2**63)] * 3, [2**63 - 2, 2**63 - 1], [-(2**63), -(2**63) + 1, *range(300), 2**63 - 1]])
def test_elias_fano_over_all_of_a_long(values):
    coded = token_files.EliasFano(token_files.EliasFano.encode(np.array(values, np.int64)))
    assert np.concatenate(list(coded.blocks())).tolist() == values and [coded.at(i) for i in range(len(values))] == values
    with pytest.raises(ValueError):
        token_files.EliasFano.encode(np.array([6 * 10**18, -6 * 10**18]))


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 3000])
def test_elias_fano(n):
    values = np.sort(np.random.default_rng(n).integers(-9, 10**6, n))
    data = token_files.EliasFano.encode(values)
    coded = token_files.EliasFano(data)
    assert np.concatenate([np.zeros(0), *coded.blocks()]).tolist() == values.tolist()
    assert all(coded.at(i) == values[i] for i in range(n))
    assert len(data) < 64 + n * (2 + np.log2(10**6 / max(n, 1) + 1) + 1) / 8 + 4 * (n / 256 + 1)
    with pytest.raises(IndexError):
        coded.at(n)


def test_a_shard_is_read_by_select(tmp_path):
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (3, 0, 5)]
    data = token_files.shard_bytes([4, 4, 9], [3, 0, 5], ids, 2)
    (tmp_path / "shard").write_bytes(data)
    with token_files.RangeReader(str(tmp_path / "shard")) as file:
        shard = token_files.Shard(file)
        assert [shard.span(i) for i in range(3)] == [(0, 3), (3, 3), (3, 8)]
        assert np.frombuffer(shard.ids(*shard.span(2)), "<u4").tolist() == [0, 1, 2, 3, 4]
        assert [[x.tolist() for x in block] for block in shard.documents()] == [[[4, 4, 9], [0, 3, 3], [3, 3, 8]]]
    (tmp_path / "cut").write_bytes(data[:-1])
    with token_files.RangeReader((tmp_path / "cut").as_uri()) as file, pytest.raises(ValueError):
        token_files.Shard(file)


def test_a_shard_of_many_documents_needs_ranges_only(tmp_path):
    """Documents come from the select samples in blocks, and no range holds more than one block's ids."""
    r = np.random.default_rng(5)
    lengths = r.integers(0, 9, 1000).tolist()
    ids = [r.integers(0, 50_000, n).astype("<u4").tobytes() for n in lengths]
    (tmp_path / "shard").write_bytes(token_files.shard_bytes(list(range(1000)), lengths, ids, 2))
    with token_files.RangeReader(str(tmp_path / "shard")) as file:
        shard = token_files.Shard(file)
        assert len(shard.ends.low) + len(shard.ends.high) + len(shard.ends.samples) * 4 < 8 * 1000 / 8
        got = []
        for keys, starts, ends in shard.documents():
            assert len(keys) <= token_files.SAMPLE
            got += [shard.ids(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert got == ids
