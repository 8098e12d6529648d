"""Scans, lookups, predicates, maintenance, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import notes, report, store
from paperloom.plans.bindings import Bindings
from paperloom.queries.registry import query
from paperloom.schema import TASKS, Table
from paperloom.session import shared_folder
from paperloom.sources import exports, imports
from paperloom.sources.ledger import Ledger
from paperloom.sources.tables import Snapshots

ORDERS = Table("orders_as_papers", "paper string, venue string, decision string, note string", ("paper",), narrow=("paper", "venue"), partition=("venue",), optional=("note",))


def _fresh(b: Bindings, name: str) -> str:
    return f"{shared_folder(b.spark)}/{name}-{uuid.uuid4().hex}"


def _orders(b: Bindings) -> DataFrame:
    return b.dated().select(F.col("paper").cast("string").alias("paper"), "venue", "decision")


@query("s1_scan_snapshot", "SELECT CAST(o_orderkey AS VARCHAR) AS paper, o_orderpriority AS venue, o_orderstatus AS decision, CAST(NULL AS VARCHAR) AS note FROM orders")
def s1(b: Bindings) -> DataFrame:
    """Written as a snapshot partitioned by venue, and scanned with the table's types."""
    snapshots = Snapshots(b.spark, _fresh(b, "store"))
    snapshots.write(ORDERS, _orders(b).withColumn("note", F.lit(None).cast("string")))
    return snapshots.scan(ORDERS)


_PAPERS_SQL = "SELECT CAST(o_orderkey AS VARCHAR) AS paper, o_orderpriority AS venue, o_orderstatus AS decision, CAST(NULL AS VARCHAR) AS note FROM orders"


@query("s2_csv_import", _PAPERS_SQL)
def s2(b: Bindings) -> DataFrame:
    """Exported as CSV with an extra column, and imported with the schema check."""
    path = _fresh(b, "csv")
    exports.write_csv(_orders(b).withColumn("extra", F.lit("a\n\"b\"")), path)
    return imports.read_csv(b.spark, path, ORDERS)


@query("s3_json_import", _PAPERS_SQL)
def s3(b: Bindings) -> DataFrame:
    """The same through JSON."""
    path = _fresh(b, "json")
    exports.write_json(_orders(b), path)
    return imports.conform(b.spark.read.schema("paper string, venue string, decision string").json(path), ORDERS)


@query("s4_metadata_dois", "SELECT DISTINCT '2301.' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS arxiv_id FROM supplier")
def s4(b: Bindings) -> DataFrame:
    """NDJSON with DOIs under three names, other DOIs and malformed lines among them."""
    number = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    doi = F.concat(F.lit("https://doi.org/10.48550/arXiv.2301."), number, F.lit("v2"))
    name = F.element_at(F.array(F.lit("doi"), F.lit("DOI"), F.lit("paper_doi")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    line = F.concat(F.lit('{"'), name, F.lit('": "'), doi, F.lit('"}'))
    lines = b.table("supplier").select(F.explode(F.array(line, line, F.lit("{broken"), F.lit('{"doi": "10.1000/x"}'))).alias("value"))
    path = _fresh(b, "dois")
    lines.write.text(path)
    return imports.read_dois(b.spark, path)


@query(
    "s5_paper_graphs",
    "WITH g AS (SELECT doc_id, greatest(1, (len(string_split(text, chr(10))) + 1) // 2) AS n FROM documents) "
    "SELECT CAST(doc_id AS VARCHAR) AS paper_arxiv_id, CAST(n AS INTEGER) AS sections, CAST(n AS INTEGER) AS figures, CAST(n AS INTEGER) AS parts, CAST(n AS INTEGER) AS tables, 4 AS citations, greatest(0, n - 2) AS appendix FROM g",
)
def s5(b: Bindings) -> DataFrame:
    """Nested documents written as JSON lines, with others of the history among them, and read again."""
    path = _fresh(b, "graphs")
    graphs = b.paper_graphs()
    graphs.unionByName(graphs.withColumn("paper_arxiv_id", F.concat("paper_arxiv_id", F.lit("_history")))).write.json(path)
    rows = imports.read_paper_graphs(b.spark, path, lines=True)
    trees = F.col("figure").cast("array<struct<subfigures: array<variant>>>")
    parts = F.aggregate(trees, F.lit(0), lambda n, f: n + F.size(f["subfigures"]))
    appendix = F.size(F.filter(F.map_values("sections"), lambda s: s["appendix"] == "true")).cast("long")
    return rows.select(
        "paper_arxiv_id", F.size("sections").alias("sections"), F.size(trees).alias("figures"), parts.alias("parts"), F.size("table").alias("tables"), F.size("citations").alias("citations"), appendix.alias("appendix")
    )


@query("s6_metadata_required", "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title FROM orders WHERE o_orderstatus <> 'P'")
def s6(b: Bindings) -> DataFrame:
    """Side-car rows without a required field are set apart."""
    path = _fresh(b, "sidecar")
    orders = b.dated()
    rows = orders.select(F.col("paper").cast("string").alias("id"), F.col("venue").alias("title"), F.when(F.col("decision") != "P", "a").alias("abstract"), F.lit("2024").alias("published"))
    exports.write_json(rows, path)
    whole, _ = imports.read_metadata(b.spark, path, lines=True)
    return whole.select("id", "title")


@query("s7_raw_text", "SELECT count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM benchmark")
def s7(b: Bindings) -> DataFrame:
    """One row for each text file."""
    path = _fresh(b, "raw")
    b.table("benchmark").select("text", "item_id").write.partitionBy("item_id").option("lineSep", "\u0001").text(path)
    rows = imports.read_texts(b.spark, path, "*.txt")
    return rows.agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("content") - 1).alias("n_chars"))


@query("s10_graph_jsonl", "SELECT 'node' AS kind, s_name AS a, CAST(s_nationkey AS VARCHAR) AS b FROM supplier UNION ALL SELECT DISTINCT 'edge', CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR) FROM lineitem")
def s10(b: Bindings) -> DataFrame:
    """Nodes and edges as JSON lines, and back."""
    path = _fresh(b, "graph")
    nodes = b.table("supplier").select(F.col("s_name").alias("id"), F.col("s_nationkey").cast("string").alias("nation"), F.lit("authorNode").alias("type"))
    edges = b.authorship().select(F.col("paper_arxiv_id").alias("source"), F.col("author_id").alias("target")).distinct().withColumn("type", F.lit("authored"))
    exports.write_graph(nodes, edges, path)
    back = b.spark.read.schema("id string, nation string").json(f"{path}/nodes").select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("nation").alias("b"))
    links = b.spark.read.schema("source string, target string").json(f"{path}/edges").select(F.lit("edge"), "source", "target")
    return back.union(links)


@query("s11_dump_cleaned", "SELECT s_suppkey, lower(replace(s_name, '#', '')) AS s_name FROM supplier UNION ALL SELECT c_custkey, lower(replace(c_name, '#', '')) FROM customer")
def s11(b: Bindings) -> DataFrame:
    """Several tables dumped with a cleaner on every string column; the second cleaner is Python, in Arrow batches."""
    path = _fresh(b, "dump")
    exports.dump({"supplier": b.table("supplier").select("s_suppkey", "s_name")}, path, lambda c: F.lower(F.replace(c, F.lit("#"), F.lit(""))))
    exports.dump({"customer": b.table("customer").select("c_custkey", "c_name")}, path, exports.python_cleaner(lambda s: s.replace("#", "").lower()))
    first = b.spark.read.schema("s_suppkey long, s_name string").json(f"{path}/supplier")
    return first.union(b.spark.read.schema("c_custkey long, c_name string").json(f"{path}/customer"))


@query("s12_processed_ids", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS arxiv_id FROM orders")
def s12(b: Bindings) -> DataFrame:
    """The list of processed ids, by date window and field."""
    ids = b.table("orders").select(F.col("o_custkey").alias("arxiv_id")).distinct()
    return b.spark.read.text(exports.write_ids(ids, _fresh(b, "ids"), "2024-01-01", "2024-01-02", "cs")).select(F.col("value").alias("arxiv_id"))


# Lookups and predicates


@query("p1_key_lookup", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def p1(b: Bindings) -> DataFrame:
    return store.lookup(b.table("documents").select("doc_id", "lang", "source"), b.table("labels").select("doc_id"))


@query("p2_venue_scan", "SELECT o_orderkey AS paper, o_orderstatus AS decision FROM orders WHERE o_orderpriority = '2-HIGH'")
def p2(b: Bindings) -> DataFrame:
    return b.dated().where(F.col("venue") == "2-HIGH").select("paper", "decision")


@query("p3_composite_key", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F'")
def p3(b: Bindings) -> DataFrame:
    return store.where_all(b.table("lineitem"), "l_orderkey", l_returnflag="A", l_linestatus="F").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("p4_first_match", "SELECT n_name, (SELECT min(c_custkey) FROM customer WHERE c_nationkey = n_nationkey) AS c_custkey FROM nation")
def p4(b: Bindings) -> DataFrame:
    first = store.first_match(b.table("customer").withColumn("n_nationkey", F.col("c_nationkey")), ["n_nationkey"], "c_custkey", "c_custkey")
    return b.table("nation").join(first, "n_nationkey", "left").select("n_name", "c_custkey")


@query("p5_narrow_projection", "SELECT CAST(o_orderkey AS VARCHAR) AS paper, o_orderpriority AS venue FROM orders")
def p5(b: Bindings) -> DataFrame:
    return store.narrow(_orders(b), ORDERS)


@query("p6_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def p6(b: Bindings) -> DataFrame:
    return store.exists(b.table("customer").select("c_custkey"), b.table("orders").select(F.col("o_custkey").alias("c_custkey")), "has_orders")


_LINES = "SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


@query("p7_blank", f"SELECT count(*) AS n, count(*) FILTER (WHERE line IS NULL OR trim(line) = '') AS n_blank FROM ({_LINES})")
def p7(b: Bindings) -> DataFrame:
    return b.paragraphs().agg(F.count(F.lit(1)).alias("n"), F.count_if(X.is_blank("content")).alias("n_blank"))


@query("p8_in_list", "SELECT o_orderkey AS paper FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def p8(b: Bindings) -> DataFrame:
    keys = b.table("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return store.lookup(b.table("orders"), keys).select(F.col("o_orderkey").alias("paper"))


@query("p9_not_withdrawn", "SELECT o_orderkey AS paper, CASE WHEN o_orderstatus = 'F' THEN 'venue text' ELSE 'Rejected_Submission' END AS decision FROM orders WHERE o_orderstatus <> 'P'")
def p9(b: Bindings) -> DataFrame:
    """P9, F27."""
    last = F.when(F.col("decision") == "P", "Withdrawn_Submission").when(F.col("decision") == "F", "Conference").otherwise("Rejected_Submission")
    rows = b.dated().withColumn("venueid", F.concat_ws("/", F.lit("Conf.cc"), F.lit("2024"), last)).where(X.not_withdrawn("venueid"))
    return rows.select("paper", X.decision("venueid", F.lit("venue text")).alias("decision"))


@query("p10_major_category", "SELECT o_orderkey AS paper FROM orders WHERE split_part(o_orderpriority, '-', 1) IN ('1', '4')")
def p10(b: Bindings) -> DataFrame:
    major = F.element_at(F.split("venue", "-"), 1)
    rows = b.dated().withColumn("categories", F.array(F.lit("math.CO"), F.concat(F.when(major.isin("1", "4"), "cs").otherwise("stat"), F.lit("."), major)))
    return rows.where(X.major_category("categories", "cs")).select("paper")


@query("p11_years_and_seeds", "SELECT o_orderkey AS paper FROM orders WHERE o_orderstatus = 'P' OR year(o_orderdate) BETWEEN 1996 AND 1998")
def p11(b: Bindings) -> DataFrame:
    return b.dated().where(X.within_years("published", 1996, 1998, F.col("decision") == "P")).select("paper")


@query("p12_updated_since", "SELECT o_orderkey AS paper, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= DATE '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def p12(b: Bindings) -> DataFrame:
    """The cap is the feature."""
    return store.most_recent(b.dated(), "published", "1998-01-01", 500, "paper").select("paper", F.date_format("published", "yyyy-MM-dd").alias("day"))


@query("p13_environment_chunks", r"SELECT page_id, regexp_matches(html, '(?i)hline|<nav') AS dropped FROM pages")
def p13(b: Bindings) -> DataFrame:
    """Pages set as LaTeX, with the menu as a table environment."""
    return b.table("pages").select("page_id", X.environment_chunk(F.replace("html", F.lit("<nav"), F.lit("\\begin{tabular}"))).alias("dropped"))


@query("p14_math_noise", rf"SELECT count(*) AS n_noise FROM ({_LINES}) WHERE len(regexp_extract_all(line, '[0-9+\-*/=]')) >= 3 AND len(regexp_extract_all(line, '[A-Za-z]')) < 10")
def p14(b: Bindings) -> DataFrame:
    return b.paragraphs().where(X.math_noise("content")).agg(F.count(F.lit(1)).alias("n_noise"))


@query("p15_boilerplate", f"SELECT doc_id, pos FROM ({_LINES}) WHERE contains(line, 'All rights reserved') OR contains(line, 'License') OR contains(line, 'licensed under')")
def p15(b: Bindings) -> DataFrame:
    hit = X.contains_any("content", ["All rights reserved", "License", "licensed under"])
    return b.paragraphs().where(hit).select(F.col("paper_arxiv_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("pos"))


# Maintenance


@query(
    "m1_insert_if_absent",
    "WITH old AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), new AS (SELECT l_orderkey AS id, min(l_extendedprice) AS v FROM lineitem GROUP BY 1) "
    "SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)",
)
def m1(b: Bindings) -> DataFrame:
    """A batch with repeated keys goes into a table; the first (here the cheapest) row of a key wins."""
    old = b.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    new = b.table("lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("v"))
    return store.insert(old, new, ["id"], ["v"])


@query(
    "m2_partial_update",
    "SELECT c_custkey, coalesce(n, c_mktsegment) AS segment, coalesce(p, c_acctbal) AS balance FROM customer LEFT JOIN "
    "(SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS n, max(o_totalprice) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
def m2(b: Bindings) -> DataFrame:
    old = b.table("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    new = b.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("segment"), F.max("o_totalprice").alias("balance"))
    return store.update(old, new, ["c_custkey"])


@query(
    "m3_replace_with_before_image",
    "SELECT 'before' AS image, s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) "
    "UNION ALL SELECT 'after', s_suppkey, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) THEN 'new' ELSE s_name END FROM supplier",
)
def m3(b: Bindings) -> DataFrame:
    old = b.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = b.table("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("id")).distinct().withColumn("name", F.lit("new"))
    after, before = store.replace(old, new, ["id"])
    return before.select(F.lit("before").alias("image"), "id", "name").union(after.select(F.lit("after"), "id", "name"))


@query(
    "m4_delete",
    "SELECT o_orderkey AS paper, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR year(o_orderdate) = 1997 AS deleted FROM orders",
)
def m4(b: Bindings) -> DataFrame:
    """Deleted by endpoint, then by year."""
    orders = b.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    kept, gone = store.delete(orders, b.table("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")))
    kept, more = store.delete_where(kept, X.lenient_year("o_orderdate") == 1997)
    gone = gone.unionByName(more)
    return kept.select(F.col("o_orderkey").alias("paper"), F.lit(False).alias("deleted")).union(gone.select("o_orderkey", F.lit(True)))


@query(
    "m2_m4_merge_on_read",
    "SELECT CAST(o_orderkey AS VARCHAR) AS paper, o_orderpriority AS venue, CASE WHEN o_orderkey % 7 = 0 THEN 'updated' WHEN o_orderkey % 5 = 0 AND o_custkey % 4 = 0 THEN 'again' ELSE o_orderstatus END AS decision, "
    "CASE WHEN o_orderkey % 11 = 0 AND NOT (o_custkey % 4 = 0 AND o_orderkey % 5 = 0) THEN 'replaced' END AS note FROM orders WHERE o_orderpriority <> '1-URGENT' AND (o_custkey % 4 <> 0 OR o_orderkey % 5 = 0)",
)
def m2_merge_on_read(b: Bindings) -> DataFrame:
    """A venue goes, some papers of all venues go, some are replaced, some come again, some are updated; marks and new rows are merged as they are read, after one venue is made compact too."""
    ledger = Ledger(b.spark, _fresh(b, "ledger"))
    orders = b.table("orders").select(F.col("o_orderkey").cast("string").alias("paper"), F.col("o_orderpriority").alias("venue"), F.col("o_orderstatus").alias("decision"), F.lit(None).cast("string").alias("note"), "o_orderkey", "o_custkey")
    ledger.write(ORDERS, orders)
    ledger.delete_partition(ORDERS, "1-URGENT")
    ledger.delete(ORDERS, orders.where("o_custkey % 4 = 0").select("paper"))
    ledger.replace(ORDERS, orders.where("o_orderkey % 11 = 0").select("paper", "venue", "decision", F.lit("replaced").alias("note")))
    ledger.insert(ORDERS, orders.where("o_orderkey % 5 = 0 AND venue <> '1-URGENT'").withColumn("decision", F.lit("again")), ["paper"])
    ledger.update(ORDERS, orders.where("o_orderkey % 7 = 0").select("paper", F.lit("updated").alias("decision")))
    return ledger.scan(ORDERS)


DOCUMENTS = Table("documents_as_papers", "paper string, lang string, source string", ("paper",))


@query("p1_indexed_lookup", "SELECT CAST(doc_id AS VARCHAR) AS paper, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def p1_indexed(b: Bindings) -> DataFrame:
    """By the index of key ranges and the files that can hold a key."""
    ledger = Ledger(b.spark, _fresh(b, "ledger"))
    ledger.write(DOCUMENTS, b.table("documents").select(F.col("doc_id").cast("string").alias("paper"), "lang", "source"))
    return ledger.lookup(DOCUMENTS, b.table("labels").select(F.col("doc_id").cast("string").alias("paper")))


@query("m5_insert_citations", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS citing_arxiv_id, CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey AS VARCHAR) END AS cited_arxiv_id, CASE WHEN l_returnflag = 'R' THEN l_linenumber END AS line FROM lineitem WHERE l_returnflag <> 'R' AND l_orderkey <> l_partkey UNION ALL SELECT CAST(l_orderkey AS VARCHAR), NULL, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def m5(b: Bindings) -> DataFrame:
    """M5: resolved citations are unique, unresolved ones all go in, self-citations are refused."""
    cited = F.when(F.col("l_returnflag") != "R", F.col("l_partkey").cast("string"))
    new = b.table("lineitem").select(F.col("l_orderkey").cast("string").alias("citing_arxiv_id"), cited.alias("cited_arxiv_id"), F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).alias("line"))
    return store.insert_citations(new.limit(0), new, ["line"])


@query("m6_get_or_create", "SELECT p_brand AS name, CAST(row_number() OVER (ORDER BY p_brand) AS BIGINT) AS id FROM (SELECT DISTINCT p_brand FROM part)")
def m6(b: Bindings) -> DataFrame:
    """M6, M7: names without an id get the next ones, densely and in order."""
    empty = b.spark.createDataFrame([], "id long, name string")
    return store.get_or_create(empty, b.table("part").select(F.col("p_brand").alias("name")))[1]


@query("m7_surrogate_ids", "SELECT o_orderkey, o_custkey, 100 + row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS id FROM orders")
def m7(b: Bindings) -> DataFrame:
    return store.with_ids(b.table("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 100)


@query(
    "m8_task_states",
    "WITH t AS (SELECT row_number() OVER (ORDER BY p) AS id, p FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS p FROM orders)) "
    "SELECT id, p AS paper_arxiv_id FROM t WHERE p IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY') ORDER BY id LIMIT 200",
)
def m8(b: Bindings) -> DataFrame:
    """Tasks are initialised and marked; the oldest 200 pending paragraphs (also need a paper graph)."""
    tasks = store.initialize_tasks(b.spark.createDataFrame([], TASKS.schema), b.table("orders").select(F.concat(F.lit(" "), F.col("o_custkey")).alias("paper_arxiv_id")))
    done = b.table("customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("paper_arxiv_id"))
    return store.pending(store.set_states(tasks, done, paper_graph=True), "paragraph", 200).select("id", "paper_arxiv_id")


# Order, limits, sets


@query("o1_authors_in_order", "SELECT CAST(l_orderkey AS VARCHAR) AS paper, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) AS authors FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def o1(b: Bindings) -> DataFrame:
    """Authors of each paper in sequence, each once."""
    first = b.authorship().groupBy("paper_arxiv_id", "author_id").agg(F.min("author_sequence").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.col("author_id").cast("long").alias("author"))))
    return first.groupBy(F.col("paper_arxiv_id").alias("paper")).agg(F.concat_ws(",", F.transform(ordered, lambda x: x["author"].cast("string"))).alias("authors"))


@query("o2_scan_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM orders")
def o2(b: Bindings) -> DataFrame:
    return store.with_ids(b.table("orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 1, "place").select("o_orderkey", "place")


@query("o6_positional_slice", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r > 100 AND r < (SELECT count(*) FROM orders)")
def o6(b: Bindings) -> DataFrame:
    """[100:-1] leaves out the last row."""
    return store.positional(b.table("orders").select("o_orderkey"), ["o_orderkey"], 100, -1)


@query("u2_ordered_distinct", "SELECT trim(o_orderpriority) AS name, min(o_orderkey) AS first_at FROM orders GROUP BY 1")
def u2(b: Bindings) -> DataFrame:
    return store.ordered_distinct(b.table("orders").select(F.concat(F.lit(" "), "o_orderpriority").alias("name"), "o_orderkey"), "name", "o_orderkey")


@query("u3_keep_others", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def u3(b: Bindings) -> DataFrame:
    return store.delete(b.table("documents").select("doc_id", "source"), b.table("labels").select("doc_id"))[0]


# Nested values


@query("n9_lenient_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(event_id % 3 AS BIGINT) AS form FROM events")
def n9(b: Bindings) -> DataFrame:
    """JSON, the same as a Python literal, and free text with the number in it."""
    form = F.col("event_id") % 3
    given = F.when(form == 0, F.col("props")).when(form == 1, F.replace(F.col("props"), F.lit('"'), F.lit("'"))).otherwise(F.concat(F.lit("k = "), F.get_json_object("props", "$.k")))
    parsed = notes.lenient_json(X.printable_json(given))
    k = F.coalesce(F.get_json_object(parsed, "$.k"), F.regexp_extract(F.get_json_object(parsed, "$._raw"), r"(\d+)", 1))
    return b.table("events").select("event_id", k.cast("long").alias("k"), form.cast("long").alias("form"))


@query("n10_json_encode", "SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"tags\":[\"' || c_mktsegment || '\"]}' AS metadata FROM customer")
def n10(b: Bindings) -> DataFrame:
    rows = b.table("customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("tags")).alias("metadata"))
    return notes.encoded(rows)


@query("n1_n3_arrays_to_rows", "SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS paper, CAST(l_suppkey AS VARCHAR) AS author FROM lineitem")
def n1(b: Bindings) -> DataFrame:
    """Arrays of authors, gathered with repeats, to distinct edges."""
    arrays = b.authorship().groupBy(F.col("paper_arxiv_id").alias("id")).agg(F.collect_list("author_id").alias("authorids")).withColumn("venue", F.lit("v"))
    return notes.paper_authors(arrays).select(F.col("paper_openreview_id").alias("paper"), F.col("author_openreview_id").alias("author"))


@query(
    "n2_replies_to_reviews",
    "SELECT CAST(conv_id AS VARCHAR) AS paper, conv_id || '-' || turn AS review, conv_id || '-' || (turn - 1) AS replyto, CASE WHEN role = 'user' THEN 'Official Review by reviewer_a' ELSE 'Response by Authors' END AS title, "
    "strftime(to_timestamp(turn * 60 + conv_id * 3600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS time FROM conversations WHERE turn > 0",
)
def n2(b: Bindings) -> DataFrame:
    """Notes with arrays of replies to review rows."""
    rows = notes.reviews(b.notes())
    return rows.select(F.col("paper_openreview_id").alias("paper"), F.col("review_openreview_id").alias("review"), F.col("replyto_openreview_id").alias("replyto"), "title", "time")


@query("w12_first_decision", "SELECT CAST(conv_id AS VARCHAR) AS paper, (SELECT c.text FROM conversations c WHERE c.conv_id = o.conv_id AND c.turn > 1 AND c.role = 'user' ORDER BY c.turn LIMIT 1) AS decision FROM conversations o GROUP BY conv_id")
def w12(b: Bindings) -> DataFrame:
    """The first reply with a decision; here user turns after the second."""
    turns = b.table("conversations")
    content = F.when((F.col("turn") > 1) & (F.col("role") == "user"), F.create_map(F.lit("decision"), F.col("text"))).otherwise(F.create_map(F.lit("comment"), F.col("text")))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.struct(F.to_json(content).alias("j")).alias("c")))).alias("all"))
    replies = F.transform("all", lambda x: F.struct(F.from_json(x["c"]["j"], "map<string,string>").alias("content")))
    return grouped.select(F.col("conv_id").cast("string").alias("paper"), notes.first_decision(replies).alias("decision"))


# Reports


@query("a4_distinct_ids", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey IS NOT NULL")
def a4(b: Bindings) -> DataFrame:
    return report.distinct_ids(b.table("orders"), "o_custkey")


@query("a6_counts_by_type", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def a6(b: Bindings) -> DataFrame:
    return report.counts_by_type(b.table("events").withColumnRenamed("event_type", "type"))


@query("a7_id_fingerprint", "SELECT o_orderpriority AS venue, sha256(string_agg(id, '|' ORDER BY id)) AS fingerprint FROM (SELECT DISTINCT o_orderpriority, CAST(o_custkey AS VARCHAR) AS id FROM orders) GROUP BY 1")
def a7(b: Bindings) -> DataFrame:
    return report.fingerprint(b.table("orders").withColumnRenamed("o_orderpriority", "venue"), "o_custkey", ["venue"])


@query("a7_whole_fingerprint", "SELECT sha256(string_agg(id, '|' ORDER BY id)) AS fingerprint FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders)")
def a7_whole(b: Bindings) -> DataFrame:
    """A7 without groups: the ranges of a sort, one after another."""
    return report.fingerprint(b.table("orders"), "o_custkey")


@query("a10_review_ratings", "SELECT c_custkey, count(o_orderkey) AS n_reviews, round(avg(o_totalprice), 7) AS mean_rating FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a10(b: Bindings) -> DataFrame:
    found = report.ratings(b.table("customer"), b.table("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_totalprice")
    return found.withColumn("mean_rating", F.round("mean_rating", 7))


@query(
    "a11_cited_and_rated",
    "SELECT p_partkey, coalesce(n, 0) AS n_citations, coalesce(r, 0) AS n_reviews, round(m, 4) AS mean_rating FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1) ON l_partkey = p_partkey "
    "LEFT JOIN (SELECT user_id, count(*) AS r, avg(value) AS m FROM events GROUP BY 1) ON user_id = p_partkey",
)
def a11(b: Bindings) -> DataFrame:
    reviews = b.table("events").select(F.col("user_id").alias("p_partkey"), "value")
    found = report.cited_and_rated(b.table("part"), b.citations(), reviews, "p_partkey", "citing", "cited", "value")
    return found.select("p_partkey", "n_citations", "n_reviews", F.round("mean_rating", 4).alias("mean_rating"))


@query("a12_acceptance", "SELECT o_orderpriority AS venue, count(*) FILTER (WHERE o_orderstatus = 'F') AS accepted, count(*) AS papers, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) AS rate FROM orders GROUP BY 1")
def a12(b: Bindings) -> DataFrame:
    return report.acceptance(b.dated(), "venue", "paper", F.col("decision") == "F")
