"""The pipeline on a small fixture, stage by stage against plain Python."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from paperloom.llm import secrets, tokenizer  # noqa: E402

from .test_decontamination import brute_force as contaminated  # noqa: E402
from .test_ngram_join import brute_force as classes  # noqa: E402
from .test_ngram_join import corpus  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    english = "the house of the river and the town is by the sea with a boat and " * 2
    rows = [(i, f"{english} {t}", "en", f"s{i % 3}") for i, t in corpus(4, 15, 4)]
    rows += [(500, None, "en", "s0"), (501, "... 123", None, "s1"), (502, f"{english} password=abcdefabcdef12 end", "en", "s1")]
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows += [(503, f"{english} intro {leak} outro", "en", "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, "never seen at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    encoder = tokenizer.encoding(tokenizer.read_ranks())
    for place, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        if place < 4:
            assert after.columns == docs.columns
            kept = {r["doc_id"]: r["text"] for r in after.collect()}
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        if name == "language_id":
            assert set(before) - set(kept) == {500, 501}
        elif name == "ngram_jaccard_join":
            assert set(kept) == {c for _, c, _ in classes(list(before.items()))}
        elif name == "benchmark_decontamination":
            leaks = {d for d, _, n, _ in contaminated(list(before.items()), [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "never seen at all")]) if n}
            assert leaks == {503} and "alpha" not in kept[503] and kept[503].endswith("intro  outro")
            assert all(kept[d] == t for d, t in before.items() if d not in leaks)
        elif name == "secret_scan":
            assert all(kept[d] == (secrets.redacted(t, secrets.spans(t, encoder)[1], "[secret]")) for d, t in before.items()) and "[secret]" in kept[502]
        else:
            rows = after.collect()
            assert {r["doc_id"] for r in rows} <= set(before) and all(r["taken"] <= 3 * r["size"] and len(r["text"].split()) == r["words"] for r in rows)
            targets = {r["source"]: r["target"] for r in rows}
            assert {s: sum(r["words"] for r in rows if r["source"] == s) for s in targets} == {s: int(t + 0.5) for s, t in targets.items()}
        docs = after
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, docs.collect()))


def written(spark, path, docs, benchmark):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string, words long, key string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows_and_clashing_columns(spark, odd, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the operators use."""
    clashing = odd.selectExpr("*", "'x' AS bucket", "1L AS h", "2 AS shard", "3 AS items", "'y' AS lang_pred", "4.0 AS margin", "5 AS class_id", "array(1) AS draws")
    folder = written(spark, tmp_path, clashing, [(1, "the cat of the house went to the river and the cat", 1, "k"), (2, None, None, None), (None, "", 0, "")])
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        stage(spark, before, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.columns == before.columns, name
        counts.append(docs.count())
    assert counts[0] < odd.count() and counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert not docs.where("bucket <> 'x' OR h <> 1 OR shard <> 2 OR items <> 3 OR class_id <> 5 OR size(draws) <> 1").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    taken = last.groupBy("doc_id").sum("words").count()
    assert 0 < taken <= docs.count() and {"shard", "order_key", "doc_id", "source", "text", "words"} <= set(last.columns)


def test_repeated_rows_stay_or_go_together(spark, tmp_path):
    text = "the house of the river and the town is by the sea with a boat and a long way to go from here to there "
    rows = [(1, text, "en", "a", len(text))] * 3 + [(2, text + "but another end of it that is quite long and has nothing in common with the first one at all " * 2, "en", "b", 5)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = written(spark, tmp_path, docs, [(1, "nothing of the kind is in there at all today", 1, "k")])
    counts = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        counts.append(sorted(r["doc_id"] for r in docs.collect()))
    assert counts == [[1, 1, 1, 2, 2], [1, 2], [1, 2], [1, 2]]


def test_empty_tables(spark, none, tmp_path):
    folder = written(spark, tmp_path, none, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
