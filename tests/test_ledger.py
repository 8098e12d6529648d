"""Changes that write only what changes, two writers at once, and writes that die between any two steps."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperloom.schema import Table
from paperloom.sources.ledger import Conflict, Ledger

PAPERS = Table("papers", "venue string, paper string, n int", ("paper",), partition=("venue",))
LOOSE = Table("loose", "a string, b int")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(folder):
    return {str(p.relative_to(folder)) for p in Path(folder).rglob("*.parquet")}


def papers(spark, items):
    return spark.createDataFrame(items, PAPERS.schema)


def test_changes_touch_their_partition_alone(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.scan(PAPERS).count() == 0 and ledger.version("papers") == 0
    start = [(v, f"{v}{i}", i) for v in ("x", "y", "z/1") for i in range(20)] + [(None, "lost", 1), ("", "blank", 2)]
    ledger.write(PAPERS, papers(spark, start))
    assert rows(ledger.scan(PAPERS)) == sorted(start, key=str) and rows(ledger.scan(PAPERS, "z/1")) == sorted((r for r in start if r[0] == "z/1"), key=str)
    before = files(tmp_path)
    assert ledger.delete_partition(PAPERS, "y").count() == 20 and files(tmp_path) == before  # no file but the commit
    assert ledger.scan(PAPERS).count() == 42

    gone = ledger.delete(PAPERS, spark.createDataFrame([("x3",), ("none",)], "paper string"))
    assert rows(gone) == [("x", "x3", 3)] and ledger.scan(PAPERS).count() == 41
    was = ledger.update(PAPERS, spark.createDataFrame([("x4", 44), ("x5", None), ("new", 1)], "paper string, n int"))
    assert rows(was) == [("x", "x4", 4), ("x", "x5", 5)] and ledger.scan(PAPERS, "x").where("paper = 'x4'").first()["n"] == 44
    assert rows(ledger.replace(PAPERS, papers(spark, [("x", "x6", 66), ("x", "nowhere", 1)]))) == [("x", "x6", 6)]
    written = files(tmp_path) - before
    assert written and all("/_part=x/" in f or "/i-" in f for f in written), written
    want = [r for r in start if r[0] != "y" and r[1] not in ("x3", "x4", "x6")] + [("x", "x4", 44), ("x", "x6", 66)]
    assert rows(ledger.scan(PAPERS)) == sorted(want, key=str)

    before = files(tmp_path)
    assert ledger.compact(PAPERS) == ["x"] and rows(ledger.scan(PAPERS)) == sorted(want, key=str)
    assert all("/_part=x/" in f or "/i-" in f for f in files(tmp_path) - before)
    assert ledger.compact(PAPERS) == [] and ledger.scan(PAPERS, version=1).count() == 62  # older versions are still there
    ledger.insert(PAPERS, papers(spark, [("x", "x3", 333), ("x", "x4", 1), ("w", "w1", 2), ("w", "w1", 1)]), ["n"])
    assert rows(ledger.scan(PAPERS)) == sorted([*want, ("x", "x3", 333), ("w", "w1", 1)], key=str)


def test_tables_without_a_key_and_null_keys(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.add(LOOSE, spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], LOOSE.schema))
    ledger.add(LOOSE, spark.createDataFrame([("b", None)], LOOSE.schema))
    assert ledger.delete(LOOSE, spark.createDataFrame([(1,)], "b int")).count() == 2
    ledger.add(LOOSE, spark.createDataFrame([("a", 1)], LOOSE.schema))  # what comes after a mark stays
    assert rows(ledger.scan(LOOSE)) == [("a", 1), ("b", None), (None, 2)] == [*rows(ledger.scan(LOOSE))]
    ledger.add(PAPERS, papers(spark, [("x", None, 1), ("x", "p", 2)]))
    ledger.delete(PAPERS, spark.createDataFrame([(1,)], "n int"))
    assert rows(ledger.scan(PAPERS)) == [("x", "p", 2)]


def test_two_writers_lose_and_repeat_nothing(spark, tmp_path):
    Ledger(spark, str(tmp_path)).write(PAPERS, papers(spark, [("x", "p0", 0)]))
    errors = []

    def run(k):
        try:
            own = Ledger(spark, str(tmp_path))
            for i in range(4):
                own.insert(PAPERS, papers(spark, [("x", f"p{i}", k * 100 + i), (f"v{k}", f"own{k}-{i}", i)]), ["n"])
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    ledger = Ledger(spark, str(tmp_path))
    got = [r["paper"] for r in ledger.scan(PAPERS).collect()]
    assert sorted(got) == sorted({"p0", "p1", "p2", "p3", *[f"own{k}-{i}" for k in (1, 2) for i in range(4)]})
    log = [p for p in Path(tmp_path, "papers/log").iterdir() if not p.name.endswith(".crc")]
    assert len(log) == ledger.version("papers")  # one file a commit, no draft left


def test_apart_changes_are_taken_in_and_same_keys_are_worked_out_again(spark, tmp_path):
    ledger, other = Ledger(spark, str(tmp_path)), Ledger(spark, str(tmp_path))
    ledger.write(PAPERS, papers(spark, [("x", "a", 1), ("x", "m", 1), ("y", "z", 1)]))
    asked = []

    def add_one(df, key, between):
        def work(old):
            asked.append(key)
            if len(asked) < 3:
                between()
            from paperloom.sources.ledger import Change

            n = old.where(F.col("paper") == key).first()["n"]
            return Change(add=papers(spark, [("x", key, n + 1)]), remove=old.where(F.col("paper") == key))

        return work

    update = lambda key, n: lambda: other.update(PAPERS, spark.createDataFrame([(key, n)], "paper string, n int"))
    ledger.commit(PAPERS, add_one(None, "a", update("z", 5)))  # another partition
    assert asked == ["a"]
    ledger.commit(PAPERS, add_one(None, "a", update("m", 7)))  # another key range
    assert asked == ["a", "a"]
    asked.clear()
    ledger.commit(PAPERS, add_one(None, "a", update("a", 50)))  # the same key: once more, twice beaten
    assert len(asked) == 3 and rows(ledger.scan(PAPERS)) == [("x", "a", 51), ("x", "m", 7), ("y", "z", 5)]
    beaten = Ledger(spark, str(tmp_path), tries=2)
    asked.clear()
    with pytest.raises(Conflict):
        beaten.commit(PAPERS, add_one(None, "m", update("m", 9)))


@pytest.mark.parametrize("step", ["_leaves", "_put"])
@pytest.mark.parametrize("after", [0, 1, 2])
def test_a_write_that_dies_is_not_seen_and_can_run_again(spark, tmp_path, monkeypatch, step, after):
    ledger = Ledger(spark, str(tmp_path))
    ledger.write(PAPERS, papers(spark, [("x", "a", 1), ("y", "b", 1)]))
    before = rows(ledger.scan(PAPERS))
    own, calls = getattr(Ledger, step), []

    def dies(self, *args):
        calls.append(1)
        if len(calls) > after:
            raise OSError("lost")
        return own(self, *args)

    monkeypatch.setattr(Ledger, step, dies)
    change = lambda: ledger.update(PAPERS, spark.createDataFrame([("a", 2)], "paper string, n int"))
    steps = {"_leaves": 2, "_put": 1}[step]
    if after < steps:
        with pytest.raises(OSError, match="lost"):
            change()
        assert rows(ledger.scan(PAPERS)) == before
    monkeypatch.setattr(Ledger, step, own)
    change()
    assert rows(ledger.scan(PAPERS)) == [("x", "a", 2), ("y", "b", 1)]


@pytest.mark.parametrize("n", [1, 100, 10_000])
def test_lookups_read_the_files_that_can_hold_their_keys(spark, tmp_path, n):
    wide = Table("wide", "paper string, n long", ("paper",))
    ledger = Ledger(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        ledger.write(wide, spark.range(100_000).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("paper"), F.col("id").alias("n")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    keys = spark.range(n).select(F.lpad((F.col("id") + 500).cast("string"), 7, "0").alias("paper"))
    found = ledger.lookup(wide, keys)
    total = len(files(tmp_path / "wide"))
    assert found.count() == n and len(found.inputFiles()) <= max(2, 2 + n * 64 // 100_000 + 1) < total
    ledger.delete(wide, keys.where("paper = '0000500'"))
    assert ledger.lookup(wide, keys).count() == n - 1
    assert ledger.lookup(wide, keys.where("paper = 'x'")).count() == 0


@pytest.mark.parametrize("local", [True, False])
def test_a_number_is_given_once(spark, tmp_path, monkeypatch, local):
    """By a link, and by the rename of other file systems."""
    monkeypatch.setattr(Ledger, "_local", staticmethod(lambda system: local))
    ledger = Ledger(spark, str(tmp_path))
    ledger.write(PAPERS, papers(spark, [("x", "a", 1)]))
    state = ledger._state("papers")
    assert not ledger._put("papers", 1, state) and ledger._put("papers", 2, state | {"number": 2}) and not ledger._put("papers", 2, state)
    assert ledger.version("papers") == 2 and rows(ledger.scan(PAPERS)) == [("x", "a", 1)]
    assert sorted(p.name for p in Path(tmp_path, "papers/log").iterdir() if not p.name.endswith(".crc")) == ["000000000001.json", "000000000002.json"]


def test_a_batch_without_new_keys_changes_nothing(spark, tmp_path):
    """As when another writer has brought all of its rows before."""
    ledger = Ledger(spark, str(tmp_path))
    new = papers(spark, [("v", "a", 1), ("w", "b", 2)])
    assert [ledger.insert(PAPERS, new, ["n"]) for _ in range(2)] == [1, 1]
    ledger.delete(PAPERS, spark.createDataFrame([("z",)], "paper string"))
    assert ledger.version("papers") == 1 and rows(ledger.scan(PAPERS)) == [("v", "a", 1), ("w", "b", 2)]
