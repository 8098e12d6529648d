"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = Path("/root/testdata/sf0.001")
SOME = (
    "j3_author_edges j5_paragraph_figures j8_fill_global_id j11_as_of_link j17_typed_references j18_resolved_chunks a3_importance a8_citing_paragraphs a11_cited_and_rated w5_adjacent_edges w8_assemble_lines"
    " g1_citation_expansion g2_heterogeneous_graph m1_insert_if_absent m7_surrogate_ids m8_task_states o1_authors_in_order n2_replies_to_reviews t2_latex_citations x1_stream_ingest s2_csv_import"
).split()


def plain(rows):
    def cell(x):
        return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    got = entry.queries()[name](spark, str(FOLDER))
    columns = sorted(got.columns)
    want = connection.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain([tuple(r) for r in got.select(*columns).collect()]) == plain(want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_title_similarity_scores_whole_titles(spark, tmp_path):
    """A letter less in a title of any length, past 1,003 characters too."""
    from paperloom.operators.match import indel_ratio
    from paperloom.queries import QUERIES

    title = "abcd efgh " * 300 + "end"
    spark.createDataFrame([(1, title, "en", "a", len(title))], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES["f31_title_similarity"](spark, str(tmp_path)).first()["score"] == indel_ratio(title, title[:3] + title[4:])


ODD = {  # documents of odd forms: without a text, with an empty first line or none but empty ones, with signs only
    "f6_f12_macros": [(1, "first\n\nthird"), (2, ""), (3, "\u00e9\u00e9\nx y"), (4, None)],
    "t13_base_info": [(1, "\nsecond"), (2, ""), (3, "first"), (4, None), (5, "\u00e9!"), (7, None)],
    "g4_arxiv_build": [(9999, "a\nb"), (99999, "c\nd\ne"), (100000, "f\ng"), (100001, "h\ni"), (1000000, "j\n\nk")],
    "g4_build_content": [(9999, "a\nb"), (99999, "c\nd\ne"), (100000, "f\ng"), (100001, "h\ni"), (1000000, "j\n\nk")],
}


@pytest.mark.parametrize("name", ODD)
def test_odd_documents_equal_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    documents = spark.createDataFrame([(n, text, "en", "a", len(text or "")) for n, text in ODD[name]], "doc_id long, text string, lang string, source string, n_chars int")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "s")], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = connection.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain([tuple(r) for r in got.select(*columns).collect()]) == plain(want)


def test_only_what_differs_is_scored(monkeypatch):
    from paperloom.operators import match

    seen, whole = [], match._lcs
    monkeypatch.setattr(match, "_lcs", lambda a, b: seen.append((a, b)) or whole(a, b))
    title = "abcd efgh " * 3000
    assert match.indel_ratio(title, title[:3] + title[4:]) == 200.0 * (len(title) - 1) / (2 * len(title) - 1)
    assert max(len(a) + len(b) for a, b in seen) == 1
    for a, b in [("", ""), ("a", ""), ("aa", "a"), ("abcab", "acb"), ("xay", "xby"), ("aba", "ababa")]:
        total = len(a) + len(b)
        assert match.indel_ratio(a, b) == (200.0 * whole(a, b) / total if total else 100.0)


def test_grams_of_near_titles_are_not_written(spark, monkeypatch):
    """Of a title's grams only the rarest, as many as its partners need, leave its row."""
    from paperloom.operators import match

    kept = []
    monkeypatch.setattr(match, "checkpoint", lambda df: kept.append(df) or df)
    titles = spark.createDataFrame([("l", 1, "".join(chr(97 + i * i % 23) + str(i) for i in range(200)))], "side string, key long, title string")
    assert match._rare_grams(titles, 97).count() < 250 and not kept
