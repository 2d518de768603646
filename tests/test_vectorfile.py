"""Files of vectors: offsets, many queries, filters, damage."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import vectorfile
from quillspan.operators.vectorfile import VectorFiles

DDL = "vector_row bigint, embedding array<float>"


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    values = np.random.default_rng(3).normal(size=(1000, 7)).astype(np.float32)
    values[500:520] = values[3]
    folder = str(tmp_path_factory.mktemp("vec") / "f")
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], DDL).repartition(5)
    return VectorFiles.write(frame, folder, rows=300), values, folder


def plain(values, queries, k, allowed=None):
    u = vectorfile.units(values)
    out = {}
    for i, q in enumerate(vectorfile.units(queries)):
        scored = sorted((-float(np.dot(u[j], q)).__round__(12), j) for j in (range(len(values)) if allowed is None else allowed))
        out[i] = [j for _, j in scored[:k]]
    return out


def test_rows_are_read_by_offset(held):
    files, values, _ = held
    assert (files.n_rows, files.dimension, files.shards.count()) == (1000, 7, 4)
    for n in (0, 299, 300, 999):
        assert files.row(n) == values[n].tolist()
    for n in (-1, 1000):
        with pytest.raises(ValueError):
            files.row(n)
    assert files.damaged().count() == 0


def test_many_queries_at_once(spark, held, tmp_path, monkeypatch):
    files, values, _ = held
    queries = np.vstack([values[[3, 50, 999]], np.random.default_rng(4).normal(size=(40, 7)).astype(np.float32)])
    asked = VectorFiles.write(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], DDL), str(tmp_path / "q"), rows=16)
    got = {}
    for r in files.top_k(asked, 9).orderBy("rank").collect():
        got.setdefault(r.query_row, []).append(r.vector_row)
    assert got == plain(values, queries, 9)
    assert got[0] == [3, *range(500, 508)]  # copies, by their rows
    allowed = spark.range(0, 1000, 3).select(F.col("id").alias("vector_row"))
    got = {}
    for r in files.top_k(asked, 4, allowed).orderBy("rank").collect():
        got.setdefault(r.query_row, []).append(r.vector_row)
    assert got == plain(values, queries, 4, range(0, 1000, 3))
    assert files.top_k(asked, 4, allowed.limit(0)).count() == 0
    assert files.top_k(asked, 2000).count() == 43 * 1000
    for wrong in (lambda: files.top_k(asked, 0), lambda: files.top_k(asked, 1, spark.range(5000).toDF("vector_row"))):
        with pytest.raises(ValueError):
            wrong()
    other = VectorFiles.write(spark.createDataFrame([(0, [1.0, 2.0])], DDL), str(tmp_path / "o"))
    with pytest.raises(ValueError):
        files.top_k(other, 1)


def test_damage_is_refused(spark, tmp_path):
    folder = str(tmp_path / "d")
    files = VectorFiles.write(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], DDL), folder, rows=10)
    path = files.shards.where("first_row = 10").first()["uri"]
    whole = open(path, "rb").read()
    for at in (0, 8, 12, 20):  # mark, dimension, first row, count
        with open(path, "wb") as file:
            file.write(whole[:at] + bytes([whole[at] ^ 1]) + whole[at + 1 :])
        with pytest.raises(Exception, match="vectors|header|listed"):
            VectorFiles.open(spark, folder)
    with open(path, "wb") as file:
        file.write(whole[:-1])
    with pytest.raises(Exception, match="short"):
        VectorFiles.open(spark, folder)
    with open(path, "wb") as file:
        file.write(whole[:-1] + bytes([whole[-1] ^ 1]))
    assert [r.uri for r in VectorFiles.open(spark, folder).damaged().collect()] == [path]
    os.remove(path)
    with pytest.raises(Exception):
        VectorFiles.open(spark, folder)


def test_wrong_tables_are_refused(spark, tmp_path):
    for i, bad in enumerate(([(1, [1.0])], [(0, [1.0]), (2, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, None)], [(0, [float("nan")])])):
        with pytest.raises(Exception, match="rows|sizes"):
            VectorFiles.write(spark.createDataFrame(bad, DDL).coalesce(1), str(tmp_path / str(i)))
    empty = VectorFiles.write(spark.createDataFrame([], DDL), str(tmp_path / "e"))
    assert empty.n_rows == 0 and empty.top_k(empty, 3).count() == 0
    zero = VectorFiles.write(spark.createDataFrame([(0, [0.0])], DDL), str(tmp_path / "z"))
    with pytest.raises(Exception, match="zero"):
        zero.top_k(zero, 1).collect()
