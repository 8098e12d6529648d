"""All tables from a set of papers or from a venue's notes, as one lazy plan for each table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import latex, link, notes, pdftext
from paperloom.operators.match import resolve_citations
from paperloom.operators.revisions import hunks, located
from paperloom.operators.store import with_ids


def arxiv_tables(documents: DataFrame, metadata: DataFrame, authors: DataFrame, references: DataFrame | None = None) -> dict[str, DataFrame]:
    """Node and edge tables out of paper-graph documents and side-car metadata.

    documents: PAPER_GRAPH columns and paper_arxiv_id; metadata: METADATA columns; authors: arxiv_authors rows;
    references: known references for resolving citations without a cited id.
    """
    parsed = X.arxiv_id("id")
    known = metadata.where(parsed["base"].isNotNull())
    papers = known.select(
        F.col("id").alias("arxiv_id"), parsed["base"].alias("base_arxiv_id"), parsed["version"].cast("string").alias("version"), "title", "abstract",
        F.try_to_timestamp("published").alias("submit_date"), F.to_json(F.struct("authors", "categories", "url")).alias("metadata"),
    )
    listed = known.select(F.col("id").alias("paper_arxiv_id"), "categories", "authors")
    categories = with_ids(listed.select(F.explode("categories").alias("name")).distinct(), ["name"]).withColumn("description", F.lit(None).cast("string"))
    sections = with_ids(latex.document_sections(documents), ["paper_arxiv_id", "section_in_paper_id"])
    parts = sections.withColumn("paper_id", F.col("paper_arxiv_id"))
    pieces = latex.chunks(parts.select("paper_id", "section_in_paper_id", "title", "content"))
    paragraphs = with_ids(pieces, ["paper_id", "at"]).join(sections.select(F.col("paper_arxiv_id").alias("paper_id"), "section_in_paper_id", F.col("id").alias("section_id")), ["paper_id", "section_in_paper_id"])
    paragraphs = paragraphs.select("id", "paragraph_id", "content", F.col("paper_id").alias("paper_arxiv_id"), F.col("section").alias("paper_section"), "section_id", F.col("at").alias("paragraph_in_paper_id"))
    figures = with_ids(latex.document_figures(documents).where("path is not null"), ["paper_arxiv_id", "at"]).withColumn("label", X.label_for(F.regexp_replace("label", r"^\\label\{|\}$", "")))
    tables = with_ids(latex.document_tables(documents), ["paper_arxiv_id", "at"]).withColumn("label", X.label_for(F.regexp_replace("label", r"^\\label\{|\}$", "")))
    citations = with_ids(latex.document_citations(documents), ["citing_arxiv_id", "bib_key"])
    if references is not None:
        citations = resolve_citations(citations, references)
    mentions = paragraphs.select(F.col("id").alias("paragraph_global_id"), "paragraph_id", "paper_section", F.col("paper_arxiv_id").alias("citing_arxiv_id"), F.explode(F.array_distinct(X.cites("content"))).alias("bib_key"))
    mentions = with_ids(mentions, ["paragraph_global_id", "bib_key"]).withColumns({"cited_arxiv_id": F.lit(None).cast("string"), "bib_title": F.lit(None).cast("string")})
    mentions = link.fill_bib_title(link.fill_cited_id(mentions, citations), citations)
    citing = mentions.select("citing_arxiv_id", "bib_key", F.col("paragraph_global_id").cast("string").alias("paragraph"))
    citations = link.with_citing_paragraphs(citations, citing)
    references_ = paragraphs.select("paragraph_id", "paper_section", "paper_arxiv_id", F.explode(F.array_distinct(X.refs("content"))).alias("reference_label"))
    references_ = with_ids(link.typed_references(references_, figures, tables), ["paper_arxiv_id", "paper_section", "paragraph_id", "reference_label"])
    return {
        "arxiv_papers": with_ids(papers, ["arxiv_id"]),
        "arxiv_categories": categories,
        "arxiv_sections": sections,
        "arxiv_paragraphs": paragraphs,
        "arxiv_figures": figures,
        "arxiv_tables": tables,
        "arxiv_citations": citations,
        "arxiv_paper_authors": link.author_edges(listed, authors),
        "arxiv_paper_category": link.category_edges(listed, categories),
        "arxiv_paper_figures": figures.select("paper_arxiv_id", F.col("id").alias("figure_id")),
        "arxiv_paper_tables": tables.select("paper_arxiv_id", F.col("id").alias("table_id")),
        "arxiv_paragraph_citations": mentions,
        "arxiv_paragraph_references": references_,
        "arxiv_paragraph_figures": link.reference_edges(references_, paragraphs, figures, sections, "figure"),
        "arxiv_paragraph_tables": link.reference_edges(references_, paragraphs, tables, sections, "table"),
    }


def _differences(pairs: DataFrame, texts: DataFrame, boilerplate: list[str] | None = None) -> DataFrame:
    """(modified, content): the hunks between the texts of each pair of revisions with their places in the newer one's paragraphs, as a JSON array in order."""
    old = texts.select(F.col("revision_openreview_id").alias("original"), F.col("text").alias("old"))
    new = texts.select(F.col("revision_openreview_id").alias("modified"), F.col("text").alias("new"))
    both = pairs.select("original", "modified").join(old, "original").join(new, "modified").select(F.col("modified").alias("pair"), "old", "new")
    paragraphs = pdftext.paragraphs(both.select(F.col("pair").alias("paper_openreview_id"), F.col("new").alias("text")), boilerplate).withColumnRenamed("paper_openreview_id", "pair")
    names = ["context_before", "context_after", "original_lines", "modified_lines", "section", "paragraph_idx", "before_section", "before_paragraph_idx", "after_section", "after_paragraph_idx"]
    each = F.array_sort(F.collect_list(F.struct("hunk", *names)))
    content = F.to_json(F.transform(each, lambda h: F.struct(*[h[n].alias(n) for n in names])), {"ignoreNullFields": "false"})
    return located(hunks(both), paragraphs).groupBy("pair").agg(content.alias("content")).withColumnRenamed("pair", "modified")


def venue_tables(
    raw: DataFrame, profiles: DataFrame, revisions: DataFrame, papers: DataFrame | None = None, texts: DataFrame | None = None, revision_texts: DataFrame | None = None, boilerplate: list[str] | None = None
) -> dict[str, DataFrame]:
    """Tables of one or many venues out of raw notes, author profiles and revisions.

    revisions: venue, paper_openreview_id, revision_openreview_id, title, time; papers: arXiv rows for the links;
    texts: venue, paper_openreview_id, text, extracted from PDFs, for the paragraphs; revision_texts: revision_openreview_id, text, for
    the contents of openreview_revisions, which are null without.
    """
    submissions = notes.papers(raw)
    edges = notes.paper_reviews(raw)
    pairs = link.consecutive(revisions, "paper_openreview_id", "revision_openreview_id", "time")
    linked = link.as_of(edges, revisions)
    venue = revisions.select("revision_openreview_id", "venue").distinct()
    if revision_texts is None:
        changed = pairs.withColumn("content", F.lit(None).cast("string"))
    else:
        changed = pairs.join(_differences(pairs, revision_texts, boilerplate), "modified", "left")
    out = {
        "openreview_papers": submissions,
        "openreview_authors": notes.profiles(profiles),
        "openreview_reviews": notes.reviews(raw).drop("paper_openreview_id"),
        "openreview_papers_authors": notes.paper_authors(raw),
        "openreview_papers_reviews": edges,
        "openreview_papers_revisions": revisions,
        "openreview_revisions": changed.join(venue.withColumnRenamed("revision_openreview_id", "modified"), "modified").select(
            "venue", F.col("original").alias("original_openreview_id"), F.col("modified").alias("revision_openreview_id"), "content", "time"
        ),
        "openreview_revisions_reviews": linked.join(venue, "revision_openreview_id").select("venue", "revision_openreview_id", "review_openreview_id"),
    }
    if papers is not None:
        out["openreview_arxiv"] = link.exact_titles(submissions, papers)
    if texts is not None:
        venues = texts.select("paper_openreview_id", "venue").distinct()
        found = pdftext.paragraphs(texts.select("paper_openreview_id", "text"), boilerplate).join(venues, "paper_openreview_id")
        out["openreview_paragraphs"] = found.select("venue", "paper_openreview_id", "paragraph_idx", "section", "content")
    return out
