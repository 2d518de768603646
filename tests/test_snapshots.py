"""The commit log and the hash tree of snapshots: crashes, two writers, leases, damage."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillspan.operators import snapshot
from quillspan.operators.snapshot import Snapshot, Store


def rows(spark, n):
    return {"rows": spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).repartition(2)}


class Stopped(Exception):
    """A writer that goes no further."""


@pytest.mark.parametrize("place", range(12))
def test_a_crash_between_any_two_steps_leaves_a_whole_snapshot(spark, tmp_path, monkeypatch, place):
    root = str(tmp_path)
    first, _ = snapshot.publish(spark, root, {"v": 1}, rows(spark, 3))
    second, _ = snapshot.publish(spark, root, {"v": 2}, rows(spark, 4))
    done = []
    for name in ("write", "create", "delete"):
        def step(self, *given, _real=getattr(Store, name)):
            # a process that is gone cleans nothing up either
            if len(done) >= place:
                raise Stopped
            done.append(given[0])
            return _real(self, *given)

        monkeypatch.setattr(Store, name, step)
    third = snapshot.snapshot_id({"v": 3})
    try:
        snapshot.publish(spark, root, {"v": 3}, rows(spark, 5))
    except Stopped:
        pass
    monkeypatch.undo()
    opened = Snapshot.current(spark, root)
    committed = any(str(x).startswith("log/") for x in done)
    assert opened.id == (third if committed else second) and opened.table("rows").count() == (5 if committed else 4)
    assert snapshot.publish(spark, root, {"v": 4}, rows(spark, 6))[1] and Snapshot.current(spark, root).table("rows").count() == 6


def test_an_entry_that_is_cut_short_does_not_count(spark, tmp_path):
    root = str(tmp_path)
    first, _ = snapshot.publish(spark, root, {"v": 1}, rows(spark, 3))
    (tmp_path / "log" / f"{2:020d}.json").write_text((tmp_path / "log" / f"{1:020d}.json").read_text()[:-1])
    assert Snapshot.current(spark, root).id == first
    second, _ = snapshot.publish(spark, root, {"v": 2}, rows(spark, 4))
    assert Snapshot.current(spark, root).id == second and [e.number for e in snapshot.entries(Store(spark, root))] == [3, 1]


def test_two_writers_both_commit(spark, tmp_path):
    root, found, seen = str(tmp_path), [], []
    snapshot.publish(spark, root, {"v": 0}, rows(spark, 1))
    ends = threading.Event()

    def write(v):
        found.append(snapshot.publish(spark, root, {"v": v}, rows(spark, v), keep=9))

    def read():
        while not ends.is_set():
            seen.append(Snapshot.current(spark, root).table("rows").count())

    reader = threading.Thread(target=read)
    writers = [threading.Thread(target=write, args=(v,)) for v in (2, 3)]
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    ends.set()
    reader.join()
    assert len(found) == 2 and all(built for _, built in found)
    assert sorted(e.number for e in snapshot.entries(Store(spark, root))) == [1, 2, 3]
    assert seen and set(seen) <= {1, 2, 3} and Snapshot.current(spark, root).table("rows").count() in (2, 3)


def test_one_number_is_made_once(spark, tmp_path):
    store, won = Store(spark, str(tmp_path)), []
    threads = [threading.Thread(target=lambda i=i: won.append(store.create("log/1.json", str(i)))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won) == [False] * 7 + [True]


def test_what_a_reader_holds_stays(spark, tmp_path):
    root = str(tmp_path)
    snapshot.publish(spark, root, {"v": 1}, rows(spark, 1))
    held = Snapshot.current(spark, root, lease=600)
    brief = Snapshot.current(spark, root, lease=0.01)
    time.sleep(0.05)
    for v in (2, 3, 4):
        snapshot.publish(spark, root, {"v": v}, rows(spark, v), keep=0)
    assert held.table("rows").count() == 1 and brief.generation == held.generation
    assert {e.generation for e in snapshot.entries(Store(spark, root))} == {held.generation, Snapshot.current(spark, root).generation}
    for name in os.listdir(tmp_path / "leases" / held.generation):
        os.remove(tmp_path / "leases" / held.generation / name)
    snapshot.publish(spark, root, {"v": 5}, rows(spark, 5), keep=0)
    assert len(os.listdir(tmp_path / "generations")) == 1


def test_an_older_whole_generation_is_taken_again(spark, tmp_path):
    root = str(tmp_path)
    first, _ = snapshot.publish(spark, root, {"v": 1}, rows(spark, 1))
    generation = Snapshot.current(spark, root).generation
    snapshot.publish(spark, root, {"v": 2}, rows(spark, 2))
    assert snapshot.publish(spark, root, {"v": 1}, rows(spark, 1)) == (first, False)
    assert Snapshot.current(spark, root).generation == generation
    assert snapshot.publish(spark, root, {"v": 1}, rows(spark, 1), force=True) == (first, True)
    assert Snapshot.current(spark, root).generation != generation and Snapshot.current(spark, root).id == first


def one_file(root, generation):
    folder = os.path.join(root, "generations", generation, "rows")
    return next(os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.endswith(".parquet"))


def test_damage_is_named_by_file(spark, tmp_path):
    root = str(tmp_path)
    snapshot.publish(spark, root, {"v": 1}, rows(spark, 100))
    opened = Snapshot.current(spark, root)
    path = one_file(root, opened.generation)
    whole = open(path, "rb").read()
    with open(path, "wb") as file:
        file.write(whole[:50] + bytes([whole[50] ^ 1]) + whole[51:])
    assert [r.path for r in Snapshot.current(spark, root).damaged().collect()] == [os.path.relpath(path, root)]
    assert snapshot.status(spark, root, {"v": 1}).state == "ready"
    deep = snapshot.status(spark, root, {"v": 1}, deep=True)
    assert deep.state == "invalid" and os.path.basename(path) in deep.reasons[0]
    with open(path, "wb") as file:
        file.write(whole[:-1])
    shorter = snapshot.status(spark, root, {"v": 1})
    assert shorter.state == "invalid" and os.path.basename(path) in shorter.reasons[0]
    os.remove(path)
    assert snapshot.status(spark, root, {"v": 1}).state == "invalid"
    with open(path, "wb") as file:
        file.write(whole)
    assert snapshot.status(spark, root, {"v": 1}, deep=True).state == "ready"
    spark.range(1).write.parquet(f"{opened.path}/more")
    assert snapshot.status(spark, root, {"v": 1}).state == "invalid"


def test_the_list_of_files_is_under_the_root_digest(spark, tmp_path):
    root = str(tmp_path)
    snapshot.publish(spark, root, {"v": 1}, rows(spark, 10))
    opened = Snapshot.current(spark, root)
    other = opened.files.withColumn("sha256", F.reverse("sha256")).collect()
    spark.createDataFrame(other, snapshot.FILE).write.mode("overwrite").parquet(f"{opened.path}/_files")
    with pytest.raises(ValueError, match="list"):
        Snapshot.current(spark, root)


def test_shared_files_are_hashed_once(spark, tmp_path, monkeypatch):
    root, hashed = str(tmp_path), []
    real = snapshot.hashed

    def counted(store, files):
        hashed.append([p for p, _ in files])
        return real(store, files)

    monkeypatch.setattr(snapshot, "hashed", counted)
    spark.range(20).write.parquet(f"{root}/lexical/blocks/segment=a")
    snapshot.publish(spark, root, {"v": 1}, rows(spark, 3), shared=["lexical/blocks/segment=a"])
    spark.range(5).write.parquet(f"{root}/lexical/blocks/segment=b")
    snapshot.publish(spark, root, {"v": 2}, rows(spark, 4), shared=["lexical/blocks/segment=a", "lexical/blocks/segment=b"])
    assert sum("segment=a" in p for own in hashed for p in own) == len([n for n in os.listdir(f"{root}/lexical/blocks/segment=a") if n.endswith(".parquet")])
    opened = Snapshot.current(spark, root)
    assert opened.files.where("path LIKE 'lexical/%'").count() == sum(n.endswith(".parquet") for s in "ab" for n in os.listdir(f"{root}/lexical/blocks/segment={s}")) and opened.damaged().count() == 0
    snapshot.publish(spark, root, {"v": 3}, rows(spark, 4), shared=["lexical/blocks/segment=b"], keep=0)
    assert os.listdir(f"{root}/lexical/blocks") == ["segment=b"]


def test_changed_artifacts_degrade(spark, tmp_path):
    root, inputs = str(tmp_path), {"v": 1, "artifacts": {"m": "1"}}
    assert snapshot.status(spark, root, inputs).state == "missing"
    snapshot.publish(spark, root, inputs, rows(spark, 1))
    assert snapshot.status(spark, root, inputs).state == "ready"
    assert snapshot.status(spark, root, inputs | {"artifacts": {"m": "2"}}).state == "degraded_model"
    assert snapshot.status(spark, root, inputs | {"v": 2, "artifacts": {"m": "2"}}).state == "stale"


def test_a_read_by_id_opens_only_files_that_may_have_it(spark, tmp_path):
    held = spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id").repartition(3)
    snapshot.publish(spark, str(tmp_path), {"v": 1}, {"rows": held, "other": held}, ids={"rows": "k"})
    opened = Snapshot.current(spark, str(tmp_path))
    files = len(opened.table("rows").inputFiles())
    assert files > 2
    for r in held.limit(5).collect():
        found = opened.with_ids("rows", "k", [r.k])
        assert len(found.inputFiles()) == 1 and [x.id for x in found.collect()] == [r.id]
    assert opened.with_ids("rows", "k", ["zzz"]).count() == 0 and opened.with_ids("rows", "k", []).count() == 0
    some = [r.k for r in held.limit(40).collect()]
    assert opened.with_ids("rows", "k", some).count() == opened.with_ids("other", "k", some).count() == 40
    assert len(opened.with_ids("other", "k", some[:1]).inputFiles()) == len(opened.table("other").inputFiles())
