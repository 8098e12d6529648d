"""Goldens of the column functions."""

from pyspark.sql import functions as F

from paperloom.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_arxiv_ids(spark):
    cases = {"2301.12345v2": ("2301.12345", 2), "1802.08773": ("1802.08773", None), "math/0301234v1": ("math/0301234", 1), "abc": (None, None)}
    for given, (base, version) in cases.items():
        got = one(spark, X.arxiv_id(F.lit(given)))
        assert (got["base"], got["version"]) == (base, version)


def test_dois_and_urls(spark):
    assert one(spark, X.doi_to_id(F.lit("https://doi.org/10.48550/arXiv.2301.00001v3"))) == "2301.00001"
    assert one(spark, X.doi_to_id(F.lit("10.1000/x"))) is None
    assert one(spark, X.url_to_id(F.lit("http://arxiv.org/pdf/1802.08773v3.pdf?x=1#p"))) == "1802.08773v3"
    assert one(spark, X.url_to_id(F.lit("https://arxiv.org/abs/math.GT/0301234"))) == "math.GT/0301234"
    assert one(spark, X.url_to_id(F.lit("https://example.org/abs/1802.08773"))) is None


def test_macros(spark):
    assert one(spark, X.cites(F.lit(r"a \citep{x, y} b \cite*{z} \citep[see]{k}"))) == ["x", "y", "z"]
    assert one(spark, X.cites(F.lit(r"\citep[see]{k}"), optional_arguments=True)) == ["k"]
    assert one(spark, X.refs(F.lit(r"\ref{fig:a} and \ref{tab:b}"))) == ["fig:a", "tab:b"]
    assert one(spark, X.drop_commands(F.lit(r"a \textbf[x]{y}b"))) == "a b"
    assert one(spark, X.drop_markup(F.lit(r"{\em a} \textbf{b}"))) == "a b"
    assert one(spark, X.reference_type(F.lit("lemma:x"))) is None


def test_sentences(spark):
    last = one(spark, X.last_sentence(F.lit("One. Two. And thr")))
    assert (last["text"], last["complete"]) == ("And thr", True)
    assert one(spark, X.last_sentence(F.lit("One. Two.")))["text"] == ""
    first = one(spark, X.first_sentence(F.lit("tail of it")))
    assert (first["text"], first["complete"]) == ("tail of it", False)


def test_noise_and_blank(spark):
    assert one(spark, X.math_noise(F.lit("1+2=3")))
    assert not one(spark, X.math_noise(F.lit("1+2=3 is a formula")))
    assert one(spark, X.is_blank(F.lit("  ")))
    assert one(spark, X.normalize_title(F.lit(None).cast("string"))) == ""
    assert one(spark, X.lenient_date(F.lit("2024-05"))).isoformat() == "2024-05-01"
    assert one(spark, X.lenient_date(F.lit("2024-13"))) is None
    assert one(spark, X.surname(F.lit("Anderson, Bo and Other, C"))) == "Anderson"


def test_reply_titles(spark):
    fields = F.array(F.lit("summary"))
    assert one(spark, X.reply_title(fields, F.lit("reviewer_a"), F.lit("v2"))) == "Official Review by reviewer_a"
    assert one(spark, X.reply_title(fields, F.lit("Reviewer_a"), F.lit("v1"))) == "Response by Reviewer_a"
    assert one(spark, X.reply_title(F.array(F.lit("decision")), F.lit("Chairs"), F.lit("v2"))) == "Paper Decision"
    assert one(spark, X.era(F.lit("ICLR.cc/2021/Conference"))) == "v1"
    assert one(spark, X.era(F.lit("ICML.cc/2023/Conference"))) == "v2"
