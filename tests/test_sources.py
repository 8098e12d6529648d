"""Imports, snapshots and streams over files."""

import json

import pytest

from paperloom.schema import PAPER_GRAPH, TABLES, Table, table
from paperloom.sources import exports, imports
from paperloom.sources.tables import Snapshots


def test_registry():
    assert len(TABLES) == 26 and sum(t.edge for t in TABLES.values()) == 14
    assert table("arxiv_citation").name == "arxiv_citations"
    with pytest.raises(KeyError):
        table("unknown")


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('citing_arxiv_id,cited_arxiv_id,bib_title,citing_sections,extra\n0812.4905,,"two\nlines ""q""","[""a"",""b""]",x\n')
    row = imports.read_csv(spark, str(tmp_path / "a.csv"), table("arxiv_citations")).first()
    assert (row["citing_arxiv_id"], row["cited_arxiv_id"], row["bib_title"], row["citing_sections"], row["bib_key"]) == ("0812.4905", None, 'two\nlines "q"', ["a", "b"], None)
    (tmp_path / "b.csv").write_text("bib_title\nx\n")
    with pytest.raises(ValueError, match="citing_arxiv_id"):
        imports.read_csv(spark, str(tmp_path / "b.csv"), table("arxiv_citations"))


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: r[0], lambda r: {"papers": r}])
def test_json_forms(spark, tmp_path, wrap):
    papers = [{"arxiv_id": "0812.4905", "base_arxiv_id": "0812.4905", "title": "t", "metadata": {"a": 1}, "more": 1}]
    (tmp_path / "p.json").write_text(json.dumps(wrap(papers)))
    got = imports.read_json(spark, str(tmp_path / "p.json"), table("arxiv_papers")).collect()
    assert [(r["arxiv_id"], r["title"], json.loads(r["metadata"])) for r in got] == [("0812.4905", "t", {"a": 1})]


def test_dois(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"doi": "10.48550/arXiv.2301.00001v3"}\n{broken\n[{"DOI": "10.48550/arXiv.2301.00002"}, {"paper_doi": "10.1/x"}]\n{"paper_doi": "10.48550/arXiv.2301.00001"}\n')
    assert sorted(r["arxiv_id"] for r in imports.read_dois(spark, str(tmp_path)).collect()) == ["2301.00001", "2301.00002"]


def test_paper_graphs_keep_section_order(spark, tmp_path):
    doc = {"title": "t", "sections": {"Zeta": {"content": "a", "appendix": "false"}, "Alpha": {"content": "b", "appendix": True}}, "citations": {}}
    (tmp_path / "2301.1.json").write_text(json.dumps(doc))
    (tmp_path / "history.json").write_text(json.dumps(doc))
    from paperloom.operators.latex import document_sections

    df = imports.read_paper_graphs(spark, str(tmp_path))
    got = [(r["paper_arxiv_id"], r["section_in_paper_id"], r["title"], r["appendix"]) for r in document_sections(df).orderBy("section_in_paper_id").collect()]
    assert got == [("2301.1", 1, "Zeta", False), ("2301.1", 2, "Alpha", True)]
    assert "sections" in PAPER_GRAPH


def test_snapshots(spark, tmp_path):
    small = Table("small", "venue string, n int", ("n",), partition=("venue",))
    store = Snapshots(spark, str(tmp_path))
    assert store.scan(small).count() == 0
    store.write(small, spark.createDataFrame([("a", 1)], small.schema))
    store.write(small, store.scan(small).union(spark.createDataFrame([("b", 2)], small.schema)))
    assert store.version("small") == 2 and sorted(tuple(r) for r in store.scan(small).collect()) == [("a", 1), ("b", 2)]
    assert store.scan(small).where("venue = 'b'").count() == 1
    for kind in "va":  # writes that died: before the first file, and before the last
        (tmp_path / f"small/{kind}3-{'0' * 32}/_temporary").mkdir(parents=True)
    spark.createDataFrame([("lost", 9)], small.schema).write.partitionBy(*small.partition).parquet(str(tmp_path / f"small/v3-{'1' * 32}"))
    (tmp_path / f"small/v3-{'1' * 32}/_SUCCESS").unlink()
    assert store.version("small") == 2 and store.scan(small).count() == 2
    assert store.add(small, spark.createDataFrame([("c", 3)], small.schema)) == 3
    assert sorted(tuple(r) for r in store.scan(small).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert store.add(small, spark.createDataFrame([("d", 4)], small.schema), most=2) == 5 and store.scan(small).count() == 4
    assert store.write(small, spark.createDataFrame([("e", 5)], small.schema)) == 6 and store.scan(small).count() == 1


def test_csv_round_trip_and_cleaner(spark, tmp_path):
    df = spark.createDataFrame([(1, "a#b", ["x"])], "id int, s string, l array<string>")
    exports.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()["l"] == '["x"]'
    exports.dump({"t": df}, str(tmp_path / "d"), exports.python_cleaner(lambda s: s.upper()))
    assert spark.read.json(str(tmp_path / "d/t")).first()["s"] == "A#B"
