"""Bucketed neighbourhoods and streamed fingerprints."""

import hashlib
import random
import uuid

from pyspark.sql import functions as F

from paperloom.operators import adjacency, report
from paperloom.schema import Table
from paperloom.sources.ledger import Ledger
from paperloom.streaming import ingest


def test_neighbourhoods_do_not_move_edges(spark, tmp_path):
    rng, name = random.Random(5), f"e_{uuid.uuid4().hex}"
    rows = [(f"p{rng.randrange(400)}", f"a{rng.randrange(50)}", i) for i in range(3000)] + [(f"p{i}", "hub", i) for i in range(1000)] + [("p1", None, 1), (None, "a1", 2), ("p1", "a1", 3), ("p1", "a1", 3)]
    edges = spark.createDataFrame(rows, "paper string, author string, n int")
    adjacency.lay_out(edges, name, ("paper", "author"), str(tmp_path), buckets=8, most=100)
    for keys, end, at in ((["hub", "a1", "none", "hub", None], "author", 1), (["p1", "p7"], "paper", 0)):
        frame = spark.createDataFrame([(k,) for k in keys], f"{end} string")
        for limit in ("10485760", "-1"):  # keys broadcast or sent to the buckets
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            found = adjacency.neighbourhood(spark, name, frame)
            got = sorted((tuple(r) for r in found.select("paper", "author", "n").collect()), key=str)
            assert got == sorted((r for r in rows if r[at] is not None and r[at] in keys), key=str)
        plan = found._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        edge_side = plan.split("SortMergeJoin")[1] if "SortMergeJoin" in plan else plan
        scan = next(line for line in edge_side.splitlines() if f"{name}_{end}[" in line.lower())
        above = edge_side.splitlines()[: edge_side.splitlines().index(scan)]
        assert "Bucketed: true" in scan and not any("Exchange" in line for line in above), plan
    buckets = spark.table(f"{name}_author").where("author = 'hub'").select(F.input_file_name().alias("f")).distinct().count()
    assert buckets > 3  # a hub is spread


def test_fingerprints_of_sets(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, "", "é", *map(str, range(200))])) for _ in range(900)] + [("only null", None)]
    df = spark.createDataFrame(rows, "g string, id string")
    want = lambda ids: hashlib.sha256("|".join(sorted({i for i in ids if i is not None}, key=lambda x: x.encode())).encode()).hexdigest()
    assert {r["g"]: r["fingerprint"] for r in report.fingerprint(df, "id", ["g"]).collect()} == {g: want([i for h, i in rows if h == g]) for g in {h for h, _ in rows}}
    assert report.fingerprint(df, "id").first()["fingerprint"] == want([i for _, i in rows])
    assert [r["fingerprint"] for r in report.fingerprint(df.limit(0), "id").collect()] == [want([])]
    plan = report.fingerprint(df, "id", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "Python" in plan or "MapInArrow" in plan


def test_the_same_row_of_a_key_goes_in_whenever_a_batch_is_played(spark, tmp_path):
    table = Table("t", "id string, title string, published string", ("id",))
    lines = [{"id": "1", "title": t, "published": p} for t, p in (("b", "2024-02-01"), ("a", "2024-02-01"), ("z", "2024-01-01"), ("c", "2024-03-01"))]
    for k, order in enumerate((lines, lines[::-1])):
        folder = tmp_path / str(k)
        spark.createDataFrame(order).repartition(2).write.json(str(folder / "in"))
        ledger = Ledger(spark, str(folder / "store"))
        build = lambda batch: batch.select("id", "title", "published", F.to_date("published").alias("day"))
        ingest.ingest(ingest.papers(spark, str(folder / "in")), ledger, table, build, str(folder / "progress")).awaitTermination()
        assert [tuple(r) for r in ledger.scan(table).collect()] == [("1", "z", "2024-01-01")]
