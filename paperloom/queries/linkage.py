"""Joins, aggregations and windows of the link builds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import adjacency, graph, link, match, store
from paperloom.plans.bindings import Bindings
from paperloom.queries.registry import query
from paperloom.schema import METADATA_NAMES, Table
from paperloom.session import shared_folder, written
from paperloom.sources.ledger import Ledger
from paperloom.sources.tables import Snapshots
from paperloom.streaming import ingest

_AUTHORS = "SELECT CAST(l_orderkey AS VARCHAR) AS paper_arxiv_id, CAST(l_suppkey AS VARCHAR) AS author_id, l_linenumber AS author_sequence FROM lineitem"


@query("j1_neighbourhood", f"SELECT a.*, s_name FROM ({_AUTHORS}) a JOIN supplier ON CAST(s_suppkey AS VARCHAR) = author_id WHERE s_acctbal < 1000")
def j1(b: Bindings) -> DataFrame:
    """Papers of many authors at once, with the author's features."""
    authors = b.table("supplier").withColumn("key", F.col("s_suppkey").cast("string"))
    keys = authors.where("s_acctbal < 1000").select(F.col("key").alias("author_id"))
    found = link.neighbourhood(b.authorship(), keys, authors.select("key", "s_name"), "author_id", "key")
    return found.drop("key")


@query("j1_reverse", f"SELECT a.* FROM ({_AUTHORS}) a WHERE paper_arxiv_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT')")
def j1_reverse(b: Bindings) -> DataFrame:
    keys = b.dated().where("venue = '1-URGENT'").select(F.col("paper").cast("string").alias("paper_arxiv_id"))
    return link.neighbourhood(b.authorship(), keys)


@query(
    "j2_category_edges",
    "WITH c AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT lang AS name FROM documents UNION SELECT source FROM documents)), "
    "e AS (SELECT CAST(doc_id AS VARCHAR) AS p, lang AS name FROM documents UNION SELECT CAST(doc_id AS VARCHAR), source FROM documents) SELECT p AS paper_arxiv_id, id AS category_id FROM e JOIN c USING (name)",
)
def j2(b: Bindings) -> DataFrame:
    """Categories get ids, then papers link to them by name."""
    papers = b.table("documents").select(F.col("doc_id").cast("string").alias("paper_arxiv_id"), F.array("lang", "source").alias("categories"))
    names = papers.select(F.explode("categories").alias("name"))
    categories, _ = store.get_or_create(b.spark.createDataFrame([], "id long, name string"), names)
    return link.category_edges(papers, categories)


@query(
    "j3_author_edges",
    "SELECT CAST(o_orderkey AS VARCHAR) AS paper_arxiv_id, CAST(min(s.s_suppkey) AS VARCHAR) AS author_id, 1 AS author_sequence, n_name AS author_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey "
    "LEFT JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000) s ON s.s_nationkey = n_nationkey GROUP BY o_orderkey, n_name",
)
def j3(b: Bindings) -> DataFrame:
    """Papers name their author by nation; the first supplier of the nation is the author, some nations have none."""
    nation = b.table("nation")
    authors = b.table("supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    authors = authors.select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("semantic_scholar_id"), F.col("n_name").alias("name"))
    papers = b.table("orders").join(b.table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return link.author_edges(papers.select(F.col("o_orderkey").cast("string").alias("paper_arxiv_id"), F.array("n_name").alias("authors")), authors)


@query(
    "j4_label_to_id",
    "SELECT o_orderkey AS item, f.id AS figure_id FROM orders o LEFT JOIN (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2) f "
    "ON f.o_custkey = o.o_custkey AND f.o_orderpriority = CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderpriority END",
)
def j4(b: Bindings) -> DataFrame:
    orders = b.table("orders")
    nodes = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("paper_arxiv_id"), F.col("o_orderpriority").alias("label"))
    items = orders.select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("paper_arxiv_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("label"))
    return link.label_edges(items, nodes, "figure_id").select("item", "figure_id")


def _reference_sql(status: str, kind: str) -> str:
    return f"""
SELECT r.id, p.gid AS paragraph_id, f.fid AS {kind}_id, r.paper AS paper_arxiv_id, s.sid AS paper_section_id
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS paper, l_returnflag AS section, l_linenumber AS pid, l_linestatus AS label FROM lineitem WHERE l_linestatus = '{status}') r
JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS paper, l_returnflag AS section, l_linenumber AS pid, min(l_partkey) AS gid FROM lineitem WHERE l_quantity > 10 GROUP BY 1, 2, 3) p USING (paper, section, pid)
JOIN (SELECT CAST(o_orderkey AS VARCHAR) AS paper, o_orderstatus AS label, o_custkey AS fid FROM orders) f USING (paper, label)
JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS paper, l_returnflag AS section, min(l_suppkey) AS sid FROM lineitem GROUP BY 1, 2) s USING (paper, section)"""


def _reference_edges(b: Bindings, kind: str) -> DataFrame:
    line = b.table("lineitem")
    paper = F.col("l_orderkey").cast("string").alias("paper_arxiv_id")
    section, number = F.col("l_returnflag").alias("paper_section"), F.col("l_linenumber").alias("paragraph_id")
    references = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), paper, section, number, F.col("l_linestatus").alias("reference_label"), F.when(F.col("l_linestatus") == "F", "figure").otherwise("table").alias("reference_type")
    )
    paragraphs = line.where("l_quantity > 10").select(F.col("l_partkey").alias("id"), paper, section, number)
    nodes = b.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("paper_arxiv_id"), X.label_for("o_orderstatus").alias("label"))
    sections = line.select(F.col("l_suppkey").alias("id"), paper, F.col("l_returnflag").alias("title"))
    return link.reference_edges(references, paragraphs, nodes, sections, kind)


@query("j5_paragraph_figures", _reference_sql("F", "figure"))
def j5(b: Bindings) -> DataFrame:
    """Reference to paragraph, figure and section at once; every side first reduced to one row a key."""
    return _reference_edges(b, "figure")


@query("j6_paragraph_tables", _reference_sql("O", "table"))
def j6(b: Bindings) -> DataFrame:
    return _reference_edges(b, "table")


def _mentions(b: Bindings) -> DataFrame:
    line = b.table("lineitem")
    blank = F.when(F.col("l_linenumber") == 1, F.lit(" "))
    return line.select(
        F.col("l_orderkey").cast("string").alias("citing_arxiv_id"), F.col("l_returnflag").alias("bib_key"), F.col("l_linestatus").alias("paper_section"), F.col("l_linenumber").alias("paragraph_id"),
        F.when(F.col("l_linenumber") > 4, F.lit("own")).otherwise(blank).alias("bib_title"), F.when(F.col("l_linenumber") > 5, F.lit("c")).otherwise(blank).alias("cited_arxiv_id"), F.lit(None).cast("long").alias("paragraph_global_id"),
    )


def _cited(b: Bindings) -> DataFrame:
    cited = F.when(F.col("l_suppkey") > 50, F.col("l_suppkey").cast("string")).otherwise("")
    return b.table("lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_orderkey").cast("string").alias("citing_arxiv_id"), F.col("l_returnflag").alias("bib_key"), F.concat(F.lit("t"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("bib_title"), cited.alias("cited_arxiv_id")
    )


@query(
    "j7_fill_bib_title",
    "SELECT CAST(l.l_orderkey AS VARCHAR) AS citing, l.l_returnflag AS bib_key, l.l_linenumber AS line, CASE WHEN l.l_linenumber > 4 THEN 'own' ELSE 't' || lpad(CAST(f.p AS VARCHAR), 9, '0') END AS bib_title FROM lineitem l "
    "JOIN (SELECT l_orderkey, l_returnflag, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) f ON f.l_orderkey = l.l_orderkey AND f.l_returnflag = l.l_returnflag",
)
def j7(b: Bindings) -> DataFrame:
    """Blank and null titles are filled from the first citation of that key."""
    filled = link.fill_bib_title(_mentions(b), _cited(b))
    return filled.select(F.col("citing_arxiv_id").alias("citing"), "bib_key", F.col("paragraph_id").alias("line"), "bib_title")


@query(
    "j8_fill_global_id",
    "SELECT CAST(l.l_orderkey AS VARCHAR) AS citing, l.l_linestatus AS section, l.l_linenumber AS line, f.lo AS first_id, f.hi AS last_id FROM lineitem l "
    "LEFT JOIN (SELECT l_orderkey, l_linestatus, l_linenumber, min(l_partkey) AS lo, max(l_partkey) AS hi FROM lineitem WHERE l_quantity > 20 GROUP BY 1, 2, 3) f ON f.l_orderkey = l.l_orderkey AND f.l_linestatus = l.l_linestatus AND f.l_linenumber = l.l_linenumber",
)
def j8(b: Bindings) -> DataFrame:
    """Both variants, the first and the last paragraph of a key."""
    paragraphs = b.table("lineitem").where("l_quantity > 20").select(
        F.col("l_partkey").alias("id"), F.col("l_orderkey").cast("string").alias("paper_arxiv_id"), F.col("l_linestatus").alias("paper_section"), F.col("l_linenumber").alias("paragraph_id"), F.col("l_linenumber").alias("paragraph_in_paper_id")
    )
    rows = link.fill_global_id(_mentions(b), paragraphs).withColumnRenamed("paragraph_global_id", "first_id").withColumn("paragraph_global_id", F.lit(None).cast("long"))
    rows = link.fill_global_id(rows, paragraphs, in_paper=True, last=True)
    return rows.select(F.col("citing_arxiv_id").alias("citing"), F.col("paper_section").alias("section"), F.col("paragraph_id").alias("line"), "first_id", F.col("paragraph_global_id").alias("last_id"))


@query(
    "j9_fill_cited_id",
    "SELECT CAST(l.l_orderkey AS VARCHAR) AS citing, l.l_returnflag AS bib_key, l.l_linenumber AS line, CASE WHEN l.l_linenumber > 5 THEN 'c' WHEN f.s IS NOT NULL THEN f.s WHEN l.l_linenumber = 1 THEN ' ' END AS cited FROM lineitem l "
    "LEFT JOIN (SELECT l_orderkey, l_returnflag, CAST(max(l_suppkey) AS VARCHAR) AS s FROM lineitem WHERE l_suppkey > 50 GROUP BY 1, 2) f ON f.l_orderkey = l.l_orderkey AND f.l_returnflag = l.l_returnflag",
)
def j9(b: Bindings) -> DataFrame:
    """Resolved ids propagate; the last citation (here of the largest id) wins."""
    cited = _cited(b).withColumn("id", F.when(F.col("cited_arxiv_id") != "", F.col("cited_arxiv_id").cast("long")).otherwise(F.lit(0)))
    filled = link.fill_cited_id(_mentions(b), cited)
    return filled.select(F.col("citing_arxiv_id").alias("citing"), "bib_key", F.col("paragraph_id").alias("line"), F.col("cited_arxiv_id").alias("cited"))


@query(
    "j10_citation_contexts",
    "SELECT event_id AS id, event_type AS cited_arxiv_id, user_id AS paragraph_global_id, md5(text) AS content FROM events JOIN documents ON doc_id = user_id WHERE event_type <> 'error' AND trim(text) <> ''",
)
def j10(b: Bindings) -> DataFrame:
    mentions = b.table("events").select(
        F.col("event_id").alias("id"), F.lit(0).alias("paragraph_id"), F.lit("s").alias("paper_section"), F.lit("p").alias("citing_arxiv_id"), F.lit("k").alias("bib_key"),
        F.when(F.col("event_type") != "error", F.col("event_type")).otherwise(" ").alias("cited_arxiv_id"), F.col("user_id").alias("paragraph_global_id"),
    )
    found = link.citation_contexts(mentions, b.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return found.select("id", "cited_arxiv_id", "paragraph_global_id", F.md5("content").alias("content"))


_EVENTS = "SELECT CAST(user_id AS VARCHAR) AS paper, lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, event_type FROM events"


@query(
    "j11_as_of_link",
    f"WITH e AS ({_EVENTS}) SELECT r.paper AS paper_openreview_id, arg_min(v.id, v.time || v.id) AS revision_openreview_id, r.id AS review_openreview_id FROM e r JOIN e v ON v.paper = r.paper AND v.time >= r.time "
    "WHERE r.event_type = 'click' AND v.event_type = 'purchase' GROUP BY r.paper, r.id",
)
def j11(b: Bindings) -> DataFrame:
    return link.as_of(b.reviews(), b.revisions())


def _titles(b: Bindings) -> DataFrame:
    """Titles by paper and part, set once for both sides of a match."""
    part = b.table("part").select(F.col("p_partkey"), F.concat(F.lit("A study of the "), "p_name", F.lit(" in "), F.lower("p_type"), F.lit(" markets and "), "p_brand").alias("name"))
    line = b.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return written(rows.select(F.col("l_orderkey").cast("string").alias("citing_arxiv_id"), "l_partkey", "l_linenumber", "name"))


def _edited(name: str) -> F.Column:
    """By line: equal but for case, one letter less, or another title."""
    kind = F.col("l_linenumber") % 3
    return F.when(kind == 0, F.upper(name)).when(kind == 1, F.concat(F.substring(name, 1, 4), F.substring(name, 6, 1000))).otherwise(F.concat(F.lit("Nothing like this: "), F.reverse(name)))


#: Titles a and edited titles b of each paper o, normalised; the Indel score by a bit for each character of a, as long as these are few.
_EDITED_SQL = (
    "WITH t AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_linenumber) AS n, any_value('A study of the ' || p_name || ' in ' || lower(p_type) || ' markets and ' || p_brand) AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), "
    "e AS (SELECT o, p, lower(name) AS a, lower(CASE n % 3 WHEN 0 THEN name WHEN 1 THEN substr(name, 1, 4) || substr(name, 6) ELSE 'Nothing like this: ' || reverse(name) END) AS b FROM t), "
)
_SCORED_SQL = (
    "near AS (SELECT *, (1::HUGEINT << length(a)) - 1 AS ones FROM pairs WHERE levenshtein(a, b) <= floor(5 * (length(a) + length(b)) / 100)), "
    "masks AS (SELECT *, list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(length(a)), lambda i: CASE WHEN substr(a, i + 1, 1) = c THEN 1::HUGEINT << i ELSE 0::HUGEINT END))) AS masks FROM near), "
    "bits AS (SELECT *, list_reduce(list_concat([ones], list_transform(masks, lambda m: m::HUGEINT)), lambda r, m: ((r + (r & m)) | (r - (r & m))) & ones) AS bits FROM masks), "
    "scored AS (SELECT *, 200e0 * (length(a) - bit_count(bits)) / (length(a) + length(b)) AS score FROM bits WHERE 200 * (length(a) - bit_count(bits)) >= 95 * (length(a) + length(b))) "
)


@query(
    "j12_fuzzy_references",
    _EDITED_SQL + "bib AS (SELECT o, b, max(o * 100000 + p) AS id FROM e GROUP BY 1, 2), pairs AS (SELECT e.o, e.p, e.a, bib.id, bib.b FROM e JOIN bib ON bib.o = e.o), "
    + _SCORED_SQL
    + "SELECT id, arg_max(CAST(p AS VARCHAR), p) AS cited_arxiv_id, arg_max(score, p) AS score FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY o, p ORDER BY score DESC, id) = 1) GROUP BY id",
)
def j12(b: Bindings) -> DataFrame:
    """Unresolved bib rows and known references of the same paper, at 95 or more."""
    rows = _titles(b)
    references = rows.select("citing_arxiv_id", F.col("l_partkey").cast("string").alias("cited_arxiv_id"), F.col("name").alias("cited_paper_name"), F.col("l_partkey").alias("at"))
    bib = rows.select((F.col("citing_arxiv_id").cast("long") * 100000 + F.col("l_partkey")).alias("id"), "citing_arxiv_id", F.lit(None).cast("string").alias("cited_arxiv_id"), _edited("name").alias("bib_title"))
    return match.match_references(references, bib)


@query(
    "j13_fuzzy_bib_titles",
    _EDITED_SQL + "titles AS (SELECT DISTINCT o, b AS a FROM e), pairs AS (SELECT titles.o, titles.a, e.p, e.a AS b FROM titles JOIN e ON e.o = titles.o), " + _SCORED_SQL
    + "SELECT CAST(o AS VARCHAR) AS citing_arxiv_id, a AS title, CAST(p AS VARCHAR) AS cited_arxiv_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY o, a ORDER BY score DESC, p) = 1",
)
def j13(b: Bindings) -> DataFrame:
    """The other way round."""
    rows = _titles(b)
    candidates = rows.select("citing_arxiv_id", F.col("l_partkey").cast("string").alias("cited_arxiv_id"), F.col("name").alias("cited_paper_name"), F.col("l_partkey").alias("at"))
    mentions = rows.select("citing_arxiv_id", F.lit("").alias("cited_arxiv_id"), _edited("name").alias("bib_title"))
    return match.match_bib_titles(mentions, candidates)


_FIRST_LINE = "SELECT doc_id, source, string_split(text, chr(10))[1] AS title FROM documents"


@query(
    "j14_exact_titles",
    f"WITH t AS ({_FIRST_LINE}), c AS (SELECT *, lower(trim(regexp_replace(regexp_replace(title, '[^A-Za-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS clean FROM t) "
    "SELECT source AS venue, CAST(doc_id AS VARCHAR) AS paper_openreview_id, m.arxiv_id, '[' || title || ']!' AS title FROM c JOIN (SELECT clean, min('x' || doc_id) AS arxiv_id FROM c WHERE clean <> '' GROUP BY 1) m USING (clean)",
)
def j14(b: Bindings) -> DataFrame:
    """Submissions in other punctuation meet the papers of the same title."""
    papers = b.papers().select(F.concat(F.lit("https://arxiv.org/abs/x"), "paper_openreview_id").alias("arxiv_id"), "title")
    submissions = b.papers().select("venue", "paper_openreview_id", F.concat(F.lit("["), F.col("title"), F.lit("]!")).alias("title"))
    return link.exact_titles(submissions, papers)


@query("j15_near_titles")
def j15(b: Bindings) -> DataFrame:
    """Near-exact titles of two sources, where the exact ones are left out before."""
    left = b.papers().select("id", "title")
    right = left.select("id", F.concat(F.substring("title", 1, 6), F.substring("title", 8, 100000)).alias("title"))
    return match.near_titles(left, right)


@query("j16_not_stored", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j16(b: Bindings) -> DataFrame:
    return store.not_stored(b.table("documents").select("doc_id", "lang"), b.table("labels"), ["doc_id"])


@query(
    "j17_typed_references",
    "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper, l_returnflag || l_linestatus AS label, CASE WHEN 'A' || o_orderstatus = l_returnflag || l_linestatus THEN 'figure' WHEN 'N' || o_orderstatus = l_returnflag || l_linestatus THEN 'table' END AS type FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
)
def j17(b: Bindings) -> DataFrame:
    """The type follows the paper's own figures and tables."""
    references = b.table("lineitem").select(F.col("l_orderkey").cast("string").alias("paper_arxiv_id"), F.concat("l_returnflag", "l_linestatus").alias("reference_label")).distinct()

    def labelled(prefix: str) -> DataFrame:
        return b.table("orders").select(F.col("o_orderkey").cast("string").alias("paper_arxiv_id"), X.label_for(F.concat(F.lit(prefix), F.col("o_orderstatus"))).alias("label"))

    found = link.typed_references(references, labelled("A"), labelled("N"))
    return found.select(F.col("paper_arxiv_id").alias("paper"), F.col("reference_label").alias("label"), F.col("reference_type").alias("type"))


@query(
    "j19_source_facts",
    "SELECT CAST(d.doc_id AS VARCHAR) AS arxiv_id, d.source AS venue, CASE WHEN quality = 1 THEN 'Accept' WHEN quality = 0 THEN 'Reject' END AS paper_decision, conv_id || '-' || turn AS review "
    "FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN conversations c ON c.conv_id = d.doc_id",
)
def j19(b: Bindings) -> DataFrame:
    docs = b.table("documents").select(F.col("doc_id").cast("string").alias("arxiv_id"), F.col("source").alias("venue"), F.col("lang").alias("title"))
    links = docs.select("arxiv_id", "venue", F.col("arxiv_id").alias("paper_openreview_id"))
    verdict = F.when(F.col("quality") == 1, "Accept").when(F.col("quality") == 0, "Reject")
    submissions = b.table("labels").select(F.col("doc_id").cast("string").alias("paper_openreview_id"), verdict.alias("paper_decision")).join(links.select("paper_openreview_id", "venue"), "paper_openreview_id")
    reviews = b.table("conversations").select(F.col("conv_id").cast("string").alias("paper_openreview_id"), F.concat_ws("-", "conv_id", "turn").alias("review_openreview_id")).join(links.select("paper_openreview_id", "venue"), "paper_openreview_id")
    found = link.source_facts(docs, links, submissions, reviews)
    return found.select("arxiv_id", "venue", "paper_decision", F.col("review_openreview_id").alias("review"))


@query(
    "j20_figure_paths",
    "SELECT CAST(s_suppkey AS VARCHAR) AS paper_arxiv_id, CASE s_suppkey % 4 WHEN 0 THEN 'img/Fig.PDF' WHEN 1 THEN 'other/Fig' WHEN 2 THEN 'Plot.png' ELSE 'none' END AS path, "
    "CASE s_suppkey % 4 WHEN 0 THEN 'img/Fig.PDF' WHEN 1 THEN 'img/Fig.PDF' WHEN 2 THEN 'a/plot.png' END AS found FROM supplier",
)
def j20(b: Bindings) -> DataFrame:
    """Exact path, base name in lower case, base name with an ending, miss."""
    paper = F.col("s_suppkey").cast("string").alias("paper_arxiv_id")
    path = F.element_at(F.array(F.lit("img/Fig.PDF"), F.lit("other/Fig"), F.lit("Plot.png"), F.lit("none")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    listing = b.table("supplier").select(paper, F.explode(F.array(F.lit("img/Fig.PDF"), F.lit("a/plot.png"))).alias("file"))
    return link.figure_paths(b.table("supplier").select(paper, path.alias("path")), listing)


# Aggregations and windows


@query("a1_paragraph_ordinals", "SELECT l_orderkey, l_returnflag, l_linenumber, l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag) AS ordinal FROM lineitem")
def a1(b: Bindings) -> DataFrame:
    rows = link.paragraph_ordinals(b.table("lineitem"), "l_linenumber", "l_orderkey", "l_returnflag")
    return rows.select("l_orderkey", "l_returnflag", "l_linenumber", F.col("paragraph_id").alias("ordinal"))


@query("a2_citing_sections", "SELECT l_orderkey AS paper, l_suppkey AS key, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sections FROM lineitem GROUP BY 1, 2")
def a2(b: Bindings) -> DataFrame:
    rows = b.table("lineitem").select(F.col("l_orderkey").alias("citing_arxiv_id"), F.col("l_suppkey").alias("bib_key"), F.col("l_returnflag").alias("section"))
    return link.citing_sections(rows).select(F.col("citing_arxiv_id").alias("paper"), F.col("bib_key").alias("key"), F.concat_ws(",", "citing_sections").alias("sections"))


@query(
    "a3_importance",
    "WITH m AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l.l_orderkey AS paper, l.l_suppkey AS key, round(sum(1.0 / n), 6) AS importance FROM lineitem l JOIN m ON m.l_orderkey = l.l_orderkey AND m.l_returnflag = l.l_returnflag GROUP BY 1, 2",
)
def a3(b: Bindings) -> DataFrame:
    """A3: one macro a paper and section, with all its keys."""
    macros = b.table("lineitem").groupBy(F.col("l_orderkey").alias("citing_arxiv_id"), "l_returnflag").agg(F.collect_list("l_suppkey").alias("keys"))
    return link.importance(macros).select(F.col("citing_arxiv_id").alias("paper"), F.col("bib_key").alias("key"), F.round("importance_score", 6).alias("importance"))


@query("a5_match_statistics", "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS matched, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unmatched FROM documents")
def a5(b: Bindings) -> DataFrame:
    found = store.exists(b.table("documents").select("doc_id"), b.table("labels"), "hit")
    return match.match_statistics(found, F.col("hit"))


@query("a8_citing_paragraphs", "SELECT o_orderkey AS paper, 'old' || coalesce(',' || (SELECT string_agg(lpad(CAST(l_linenumber AS VARCHAR), 2, '0'), ',' ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS paragraphs FROM orders")
def a8(b: Bindings) -> DataFrame:
    citations = b.table("orders").select(F.col("o_orderkey").alias("citing_arxiv_id"), F.lit("k").alias("bib_key"), F.array(F.lit("old")).alias("citing_paragraphs"))
    mentions = b.table("lineitem").select(F.col("l_orderkey").alias("citing_arxiv_id"), F.lit("k").alias("bib_key"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("paragraph"))
    return link.with_citing_paragraphs(citations, mentions).select(F.col("citing_arxiv_id").alias("paper"), F.concat_ws(",", "citing_paragraphs").alias("paragraphs"))


@query(
    "w4_revision_pairs",
    f"WITH e AS ({_EVENTS}) SELECT * FROM (SELECT paper, lag(id) OVER (PARTITION BY paper ORDER BY time, id) AS original, id AS modified, time FROM e WHERE event_type = 'purchase') WHERE original IS NOT NULL",
)
def w4(b: Bindings) -> DataFrame:
    return link.consecutive(b.revisions().withColumnRenamed("paper_openreview_id", "paper"), "paper", "revision_openreview_id", "time")


_LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


@query(
    "w5_adjacent_edges",
    f"WITH c AS ({_LINES}), p AS (SELECT lag(doc_id || ':' || pos) OVER (PARTITION BY doc_id ORDER BY pos) AS source, doc_id || ':' || pos AS target FROM c) "
    "SELECT source, target, 'adjacent_chunk_edge' AS type FROM p WHERE source IS NOT NULL UNION ALL SELECT target, source, 'adjacent_chunk_edge' FROM p WHERE source IS NOT NULL",
)
def w5(b: Bindings) -> DataFrame:
    rows = b.paragraphs().select(F.col("paper_arxiv_id").alias("paper_id"), F.col("paper_section").alias("section"), "at", F.concat_ws(":", "paper_arxiv_id", "at").alias("chunk_id"))
    return link.adjacent_edges(rows)


@query(
    "w7_contexts",
    f"SELECT doc_id, pos, b AS n_before, n AS n_content, a AS n_after FROM (SELECT doc_id, pos, length(line) AS n, lag(length(line)) OVER w AS b, lead(length(line)) OVER w AS a FROM ({_LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE a IS NOT NULL AND b IS NOT NULL",
)
def w7(b: Bindings) -> DataFrame:
    rows = link.with_contexts(b.paragraphs(), "paper_arxiv_id", "at", "content")
    return rows.select(F.col("paper_arxiv_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("pos"), F.length("before").alias("n_before"), F.length("content").alias("n_content"), F.length("after").alias("n_after"))


@query(
    "w8_assemble_lines",
    f"WITH l AS ({_LINES}) SELECT doc_id, min(pos) AS pos, string_agg(line, '' ORDER BY pos) AS content FROM (SELECT doc_id, pos, pos // 3 AS island, line FROM l WHERE pos % 3 <> 2 AND trim(line) <> '') GROUP BY doc_id, island",
)
def w8(b: Bindings) -> DataFrame:
    """Every third line blanked, and a hyphen put at the end of the others."""
    line = F.when(F.col("at") % 3 == 2, " ").when(F.trim("content") == "", "").otherwise(F.concat("content", F.lit("-")))
    rows = b.paragraphs().where((F.col("at") % 3 == 2) | (F.trim("content") != "")).select(F.col("paper_arxiv_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("at"), line.alias("line"))
    return link.assemble(rows, "doc_id", "at", "line").withColumnRenamed("at", "pos")


@query(
    "w9_heading_carry_forward",
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations",
)
def w9(b: Bindings) -> DataFrame:
    rows = link.carry_heading(b.table("conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")))
    return rows.select("conv_id", "turn", "section")


@query(
    "w10_between_markers",
    f"WITH l AS ({_LINES}), m AS (SELECT doc_id, min(pos) FILTER (WHERE length(line) > 200) AS s, min(pos) FILTER (WHERE length(line) < 5) AS e FROM l GROUP BY 1) SELECT doc_id, pos FROM l JOIN m USING (doc_id) WHERE (s IS NULL OR pos >= s) AND (e IS NULL OR pos < e)",
)
def w10(b: Bindings) -> DataFrame:
    rows = link.between_markers(b.paragraphs(), "paper_arxiv_id", "at", F.length("content") > 200, F.length("content") < 5)
    return rows.select(F.col("paper_arxiv_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("pos"))


# Graph and streams


@query(
    "g1_citation_expansion",
    "WITH RECURSIVE c AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey <> l_partkey), r AS (SELECT DISTINCT c_custkey AS paper, 0 AS hop FROM customer WHERE c_acctbal < -500 UNION "
    "SELECT c.b, r.hop + 1 FROM r JOIN c ON c.a = r.paper JOIN orders ON o_orderkey = c.b AND year(o_orderdate) BETWEEN 1995 AND 1999 WHERE r.hop < 3) SELECT paper, min(hop) AS hop, false AS endpoint FROM r GROUP BY paper",
)
def g1(b: Bindings) -> DataFrame:
    """Three hops under a constraint given as a function."""
    seeds = b.table("customer").where("c_acctbal < -500").select(F.col("c_custkey").alias("paper"))
    return graph.expand(seeds, b.citations(), 3, b.dated().select("paper", "published"), lambda df: X.within_years("published", 1995, 1999))


INGESTED = Table("ingested", "arxiv_id string, title string, published string", ("arxiv_id",), optional=("title", "published"))


def _metadata(b: Bindings) -> DataFrame:
    orders = b.dated()
    names = F.array(F.concat(F.when(F.col("decision") == "F", "cs").otherwise("math"), F.lit(".AI")))
    rows = orders.select(F.col("paper").cast("string").alias("id"), F.col("venue").alias("title"), F.lit("a").alias("abstract"), F.array().cast("array<string>").alias("authors"), F.date_format("published", "yyyy-MM-dd").alias("published"), names.alias("categories"), F.lit("u").alias("url"))
    return rows.select(*METADATA_NAMES)


@query("x1_stream_ingest", "SELECT CAST(o_orderkey AS VARCHAR) AS arxiv_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders WHERE o_orderstatus = 'F'")
def x1(b: Bindings) -> DataFrame:
    """Two drops of files with the same papers, a stream by category, each paper once."""
    folder = f"{shared_folder(b.spark)}/stream-{uuid.uuid4().hex}"
    snapshots = Snapshots(b.spark, f"{folder}/store")
    build = lambda batch: batch.select(F.col("id").alias("arxiv_id"), "title", "published")
    for _ in range(2):
        _metadata(b).write.mode("append").json(f"{folder}/in")
        ingest.ingest(ingest.papers(b.spark, f"{folder}/in", "cs"), snapshots, INGESTED, build, f"{folder}/progress").awaitTermination()
    return snapshots.scan(INGESTED)


@query("x1_two_streams", "SELECT CAST(o_orderkey AS VARCHAR) AS arxiv_id, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders")
def x1_two(b: Bindings) -> DataFrame:
    """Two streams of the same files, one without a category, add to one table at the same time; each paper is there once."""
    folder = f"{shared_folder(b.spark)}/stream-{uuid.uuid4().hex}"
    ledger = Ledger(b.spark, f"{folder}/store")
    build = lambda batch: batch.select(F.col("id").alias("arxiv_id"), "title", "published")
    _metadata(b).write.json(f"{folder}/in")
    streams = [ingest.ingest(ingest.papers(b.spark, f"{folder}/in", category), ledger, INGESTED, build, f"{folder}/progress-{category}") for category in ("cs", None)]
    for stream in streams:
        stream.awaitTermination()
    return ledger.scan(INGESTED)


@query("j1_bucketed_neighbourhood", f"SELECT a.* FROM ({_AUTHORS}) a JOIN supplier ON CAST(s_suppkey AS VARCHAR) = author_id WHERE s_acctbal < 1000")
def j1_bucketed(b: Bindings) -> DataFrame:
    """Edges laid out by both ends in buckets; hubs of over 500 edges are spread."""
    name = f"edges_{uuid.uuid4().hex}"
    adjacency.lay_out(b.authorship(), name, ("paper_arxiv_id", "author_id"), shared_folder(b.spark), buckets=16, most=500)
    keys = b.table("supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").cast("string").alias("author_id"))
    return adjacency.neighbourhood(b.spark, name, keys)


@query("x2_ingest_window", "SELECT o_orderkey AS paper FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' - 31 AND DATE '1998-03-01' - 2")
def x2(b: Bindings) -> DataFrame:
    return ingest.window_of(b.dated(), "published", "1998-03-01", 30, 2).select("paper")


@query("x3_watermark_dedup", "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F'")
def x3(b: Bindings) -> DataFrame:
    """Repeated ids inside the watermark are dropped by the stream itself."""
    folder = f"{shared_folder(b.spark)}/stream-{uuid.uuid4().hex}"
    _metadata(b).union(_metadata(b)).write.json(f"{folder}/in")
    stream = ingest.papers(b.spark, f"{folder}/in", "cs", "3650 days").select("id")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return b.spark.read.schema("id string").parquet(f"{folder}/out")
