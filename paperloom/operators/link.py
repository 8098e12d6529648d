"""Joins that build edges and carry ids from table to table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators.store import first_match
from paperloom.session import written


def neighbourhood(edges: DataFrame, keys: DataFrame, nodes: DataFrame | None = None, far: str | None = None, node_key: str | None = None) -> DataFrame:
    """Edges at the keys (the key column names the end); with nodes, joined with the far node."""
    near = edges.join(keys.distinct(), keys.columns, "left_semi")
    if nodes is None:
        return near
    return near.join(nodes, near[far] == nodes[node_key])


def category_edges(papers: DataFrame, categories: DataFrame) -> DataFrame:
    """(paper_arxiv_id, category_id) from papers with an array of category names."""
    names = papers.select("paper_arxiv_id", F.explode("categories").alias("name"))
    return names.join(categories.select("name", F.col("id").alias("category_id")), "name").select("paper_arxiv_id", "category_id").distinct()


def author_edges(papers: DataFrame, authors: DataFrame) -> DataFrame:
    """Authors of papers in order with their ids; the first author of a name wins, unknown names have no id."""
    listed = papers.select("paper_arxiv_id", F.posexplode("authors").alias("at", "author_name"))
    ids = first_match(authors.withColumnRenamed("name", "author_name"), ["author_name"], "semantic_scholar_id")
    out = listed.join(ids, "author_name", "left")
    return out.select("paper_arxiv_id", F.col("semantic_scholar_id").alias("author_id"), (F.col("at") + 1).alias("author_sequence"), "author_name")


def label_edges(items: DataFrame, nodes: DataFrame, id_name: str) -> DataFrame:
    """(paper, label) rows with the id of the first node of that label; null without one."""
    ids = first_match(nodes.where("label is not null").withColumn(id_name, F.col("id")), ["paper_arxiv_id", "label"], id_name)
    return items.join(ids, ["paper_arxiv_id", "label"], "left")


def reference_edges(references: DataFrame, paragraphs: DataFrame, nodes: DataFrame, sections: DataFrame, kind: str) -> DataFrame:
    """Paragraph-to-figure (or table) edges; paragraph, node and section must all be found.

    Every build side keeps its first match, so a reference makes one edge at most.
    """
    id_name = f"{kind}_id"
    wanted = references.where(F.col("reference_type") == kind).withColumn("label", X.label_for("reference_label"))
    own = first_match(paragraphs.withColumn("global_id", F.col("id")), ["paper_arxiv_id", "paper_section", "paragraph_id"], "global_id")
    node = first_match(nodes.withColumn(id_name, F.col("id")), ["paper_arxiv_id", "label"], id_name)
    section = first_match(sections.withColumn("paper_section_id", F.col("id")).withColumnRenamed("title", "paper_section"), ["paper_arxiv_id", "paper_section"], "paper_section_id")
    out = wanted.join(own, ["paper_arxiv_id", "paper_section", "paragraph_id"]).join(node, ["paper_arxiv_id", "label"]).join(section, ["paper_arxiv_id", "paper_section"])
    return out.select("id", F.col("global_id").alias("paragraph_id"), id_name, "paper_arxiv_id", "paper_section_id")


def fill(df: DataFrame, source: DataFrame, on: list[str], column: str, last: bool = False) -> DataFrame:
    """``column`` where it is null or blank, from the first (or last) non-blank match of the source."""
    known = first_match(source.where(~X.is_blank(F.col(column).cast("string"))), on, column, last=last).withColumnRenamed(column, "_found")
    out = df.join(known, on, "left")
    blank = X.is_blank(F.col(column).cast("string"))
    return out.withColumn(column, F.when(blank, F.coalesce("_found", column)).otherwise(F.col(column))).drop("_found").select(*df.columns)


def fill_bib_title(paragraph_citations: DataFrame, citations: DataFrame) -> DataFrame:
    return fill(paragraph_citations, citations, ["citing_arxiv_id", "bib_key"], "bib_title")


def fill_global_id(paragraph_citations: DataFrame, paragraphs: DataFrame, in_paper: bool = False, last: bool = False) -> DataFrame:
    """paragraph_global_id by paper, section and paragraph, by its number in the section or in the paper."""
    number = "paragraph_in_paper_id" if in_paper else "paragraph_id"
    known = paragraphs.select(
        F.col("paper_arxiv_id").alias("citing_arxiv_id"), "paper_section", F.col(number).alias("paragraph_id"), F.col("id").alias("paragraph_global_id"), "id"
    )
    return fill(paragraph_citations, known, ["citing_arxiv_id", "paper_section", "paragraph_id"], "paragraph_global_id", last)


def fill_cited_id(paragraph_citations: DataFrame, citations: DataFrame) -> DataFrame:
    """Resolved ids go from citations to paragraph citations; the last one wins."""
    return fill(paragraph_citations, citations, ["citing_arxiv_id", "bib_key"], "cited_arxiv_id", last=True)


def citation_contexts(paragraph_citations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Resolved paragraph citations with the text of their paragraph."""
    texts = paragraphs.select(F.col("id").alias("paragraph_global_id"), "content").where(~X.is_blank("content"))
    known = paragraph_citations.where(~X.is_blank("cited_arxiv_id") & F.col("paragraph_global_id").isNotNull())
    return known.join(texts, "paragraph_global_id").select(
        "id", "paragraph_id", "paper_section", "citing_arxiv_id", "bib_key", "cited_arxiv_id", "paragraph_global_id", "content"
    )


def as_of(reviews: DataFrame, revisions: DataFrame) -> DataFrame:
    """Each review goes to the first revision of its paper at its time or later.

    Columns paper_openreview_id, time and the ids; reviews after the last revision have no row. One
    shuffle by paper; equal times are ordered by revision id.
    """
    left = reviews.select("paper_openreview_id", "time", F.lit(0).alias("k"), F.col("review_openreview_id").alias("review"), F.lit(None).cast("string").alias("revision"))
    right = revisions.select("paper_openreview_id", "time", F.lit(1).alias("k"), F.lit(None).cast("string").alias("review"), F.col("revision_openreview_id").alias("revision"))
    ahead = Window.partitionBy("paper_openreview_id").orderBy("time", "k", "revision").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    both = left.unionByName(right).withColumn("linked", F.first("revision", ignorenulls=True).over(ahead))
    return both.where("k = 0 and linked is not null").select("paper_openreview_id", F.col("linked").alias("revision_openreview_id"), F.col("review").alias("review_openreview_id"))


def exact_titles(submissions: DataFrame, papers: DataFrame) -> DataFrame:
    """(venue, paper_openreview_id, arxiv_id, title) by equal cleaned titles, one paper a submission."""
    known = papers.withColumn("clean", X.clean_title("title")).where("clean <> ''").withColumn("arxiv_id", X.strip_abs_url("arxiv_id"))
    known = known.groupBy("clean").agg(F.min("arxiv_id").alias("arxiv_id"))
    return submissions.withColumn("clean", X.clean_title("title")).join(known, "clean").select("venue", "paper_openreview_id", "arxiv_id", "title")


def typed_references(references: DataFrame, figures: DataFrame, tables: DataFrame) -> DataFrame:
    """reference_type by where the paper has the label: among its figures, else its tables, else null."""
    key = ["paper_arxiv_id", "label"]
    fig = figures.select(*key).distinct().withColumn("_figure", F.lit(True))
    tab = tables.select(*key).distinct().withColumn("_table", F.lit(True))
    out = references.withColumn("label", X.label_for("reference_label")).join(fig, key, "left").join(tab, key, "left")
    kind = F.when(F.col("_figure"), "figure").when(F.col("_table"), "table")
    return out.withColumn("reference_type", kind).drop("_figure", "_table", "label")


def resolved_chunks(chunks: DataFrame, citations: DataFrame, labels: DataFrame) -> DataFrame:
    """Text chunks with the cited ids and referenced objects they resolve to within their paper.

    chunks: paper_id, chunk_id, content; citations: paper_id, key, target; labels: paper_id, label, target. ``isolation`` marks
    chunks that resolve nothing.
    """
    named = written(chunks.select("paper_id", "chunk_id", X.cites("content").alias("keys"), X.refs("content").alias("names")))  # contents are searched once
    each = lambda names, name: named.select("paper_id", "chunk_id", F.explode(F.array_distinct(names)).alias(name)).hint("merge")  # noqa: E731  a file of names is far smaller than its rows, which no driver could broadcast
    cited, referred = each("keys", "key").join(citations, ["paper_id", "key"]), each("names", "label").join(labels, ["paper_id", "label"])
    key = ["paper_id", "chunk_id"]
    cites = cited.groupBy(*key).agg(F.array_sort(F.collect_set("target")).alias("cites"))
    refs = referred.groupBy(*key).agg(F.array_sort(F.collect_set("target")).alias("refs"), F.array_sort(F.collect_set("label")).alias("ref_labels"))
    empty = F.array().cast("array<string>")
    out = chunks.join(cites, key, "left").join(refs, key, "left")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("cites", "refs", "ref_labels")})
    return out.withColumn("isolation", (F.size("cites") == 0) & (F.size("refs") == 0))


def source_facts(papers: DataFrame, links: DataFrame, submissions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Papers with their submissions and reviews."""
    both = papers.select("arxiv_id", "title").join(links.select("arxiv_id", "venue", "paper_openreview_id"), "arxiv_id")
    both = both.join(submissions.select("venue", "paper_openreview_id", "paper_decision"), ["venue", "paper_openreview_id"])
    return both.join(reviews.select("venue", "paper_openreview_id", "review_openreview_id"), ["venue", "paper_openreview_id"], "left")


#: Endings tried after the name itself.
IMAGE_ENDINGS = ("pdf", "png", "jpg", "jpeg")


def figure_paths(figures: DataFrame, listing: DataFrame) -> DataFrame:
    """(paper_arxiv_id, path, found) of each figure path against the paper's files.

    Tried in turn: the path, its lower-cased base name, and that with an image ending; misses have null.
    """
    base = F.lower(F.element_at(F.split("path", "/"), -1))
    tries = F.array(F.struct(F.lit(0).alias("p"), F.col("path").alias("n")), F.struct(F.lit(1).alias("p"), base.alias("n")), *[F.struct(F.lit(2 + i).alias("p"), F.concat(base, F.lit(f".{e}")).alias("n")) for i, e in enumerate(IMAGE_ENDINGS)])
    named = F.array_distinct(F.array(F.col("file"), F.lower(F.element_at(F.split("file", "/"), -1))))
    files = listing.select("paper_arxiv_id", "file", F.explode(named).alias("name")).groupBy("paper_arxiv_id", "name").agg(F.min("file").alias("file"))
    wanted = figures.select("paper_arxiv_id", "path").distinct()
    found = wanted.select("paper_arxiv_id", "path", F.explode(tries).alias("t")).select("paper_arxiv_id", "path", "t.p", F.col("t.n").alias("name"))
    found = found.join(files, ["paper_arxiv_id", "name"]).groupBy("paper_arxiv_id", "path").agg(F.min_by("file", "p").alias("found"))
    return wanted.join(found, ["paper_arxiv_id", "path"], "left")


# Aggregations and windows of the link builds


def paragraph_ordinals(df: DataFrame, number: str = "number", paper: str = "paper_arxiv_id", section: str = "paper_section") -> DataFrame:
    return df.withColumn("paragraph_id", F.col(number) - F.min(number).over(Window.partitionBy(paper, section)))


def citing_sections(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("citing_arxiv_id", "bib_key").agg(F.array_sort(F.collect_set("section")).alias("citing_sections"))


def importance(macros: DataFrame) -> DataFrame:
    """(paper, key) rows from macros with an array of keys: the sum of 1 / keys in the macro."""
    each = macros.select("citing_arxiv_id", F.explode("keys").alias("bib_key"), (F.lit(1.0) / F.size("keys")).alias("share"))
    return each.groupBy("citing_arxiv_id", "bib_key").agg(F.sum("share").alias("importance_score"))


def with_citing_paragraphs(citations: DataFrame, mentions: DataFrame) -> DataFrame:
    """Appends to citing_paragraphs the paragraphs that mention the citation, in order."""
    more = mentions.groupBy("citing_arxiv_id", "bib_key").agg(F.array_sort(F.collect_list("paragraph")).alias("_more"))
    empty = F.array().cast("array<string>")
    out = citations.join(more, ["citing_arxiv_id", "bib_key"], "left")
    return out.withColumn("citing_paragraphs", F.concat(F.coalesce("citing_paragraphs", empty), F.coalesce("_more", empty))).drop("_more")


def objects_by_label(objects: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with the objects their labels refer to, only where there are any."""
    known = objects.select("paper_id", "label", "object")
    refs = chunks.select("paper_id", "chunk_id", F.explode_outer(X.refs("content")).alias("label")).where("label is not null").distinct()  # an inner explode searches twice, first whether there are any
    return refs.join(known, ["paper_id", "label"]).groupBy("paper_id", "chunk_id").agg(F.array_sort(F.collect_list("object")).alias("objects"))


def consecutive(revisions: DataFrame, paper: str, revision: str, time: str) -> DataFrame:
    """(paper, original, modified) pairs of neighbouring revisions; papers with one have none."""
    before = F.lag(revision).over(Window.partitionBy(paper).orderBy(time, revision))
    return revisions.select(paper, before.alias("original"), F.col(revision).alias("modified"), time).where("original is not null")


def adjacent_edges(chunks: DataFrame) -> DataFrame:
    """Edges between neighbouring chunks of a section, both ways: (source, target, type)."""
    before = F.lag("chunk_id").over(Window.partitionBy("paper_id", "section").orderBy("at"))
    pairs = chunks.select(before.alias("source"), F.col("chunk_id").alias("target")).where("source is not null")
    both = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return both.withColumn("type", F.lit("adjacent_chunk_edge"))


def with_contexts(paragraphs: DataFrame, paper: str, at: str, content: str) -> DataFrame:
    """Interior paragraphs with the one before and after."""
    order = Window.partitionBy(paper).orderBy(at)
    out = paragraphs.withColumn("before", F.lag(content).over(order)).withColumn("after", F.lead(content).over(order))
    return out.where("before is not null and after is not null")


def carry_heading(lines: DataFrame, paper: str, at: str, heading: Column) -> DataFrame:
    """Each line with the last heading above it."""
    return lines.withColumn("section", F.last(heading, ignorenulls=True).over(Window.partitionBy(paper).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)))


def between_markers(lines: DataFrame, paper: str, at: str, first: Column, last: Column) -> DataFrame:
    """Lines from the first marker up to the last one, of the whole text if a marker is missing."""
    all_lines = Window.partitionBy(paper)
    start, stop = F.min(F.when(first, F.col(at))).over(all_lines), F.min(F.when(last, F.col(at))).over(all_lines)
    out = lines.withColumn("_start", start).withColumn("_stop", stop)
    return out.where((F.col("_start").isNull() | (F.col(at) >= F.col("_start"))) & (F.col("_stop").isNull() | (F.col(at) < F.col("_stop")))).drop("_start", "_stop")


def assemble(lines: DataFrame, paper: str, at: str, line: str) -> DataFrame:
    """Paragraphs from lines: blank lines split, a hyphen at a line's end goes, nothing is put between."""
    blank = F.trim(F.col(line)) == ""
    island = F.sum(blank.cast("int")).over(Window.partitionBy(paper).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.withColumn("island", island).where(~blank).withColumn("part", F.regexp_replace(line, "-$", ""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "part"))), lambda x: x["part"]), "")
    return rows.groupBy(paper, "island").agg(F.min(at).alias("at"), joined.alias("content")).drop("island")
