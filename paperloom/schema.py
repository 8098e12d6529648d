"""The 26 tables of the graph: columns, keys, narrow projections, partitions and aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """key: columns that are unique on insert (none if empty); narrow: the short projection."""

    name: str
    ddl: str
    key: tuple[str, ...] = ()
    edge: bool = False
    narrow: tuple[str, ...] = ()
    partition: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    endpoints: tuple[str, str] | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)

    @property
    def names(self) -> list[str]:
        return self.schema.names

    @property
    def required(self) -> list[str]:
        return [c for c in self.names if c not in self.optional and c != "id"]


def _edge(name: str, ddl: str, a: str, b: str, **more) -> Table:
    return Table(name, ddl, edge=True, endpoints=(a, b), **more)


_V = ("venue",)
_ALL = (
    Table(
        "arxiv_papers", "id long, arxiv_id string, base_arxiv_id string, version string, title string, abstract string, submit_date timestamp, metadata string",
        ("arxiv_id",), narrow=("arxiv_id", "title"), optional=("version", "abstract", "submit_date", "metadata"),
    ),
    Table("arxiv_authors", "id long, semantic_scholar_id string, name string, homepage string", ("semantic_scholar_id",), narrow=("semantic_scholar_id", "name"), optional=("homepage",)),
    Table("arxiv_categories", "id long, name string, description string", ("name",), narrow=("id", "name"), optional=("description",)),
    Table("arxiv_sections", "id long, content string, title string, appendix boolean, paper_arxiv_id string, section_in_paper_id int", narrow=("id", "title", "paper_arxiv_id"), optional=("appendix", "section_in_paper_id")),
    Table(
        "arxiv_paragraphs", "id long, paragraph_id int, content string, paper_arxiv_id string, paper_section string, section_id int, paragraph_in_paper_id int",
        ("paragraph_id", "paper_arxiv_id", "paper_section"), narrow=("id", "paragraph_id", "paper_arxiv_id", "paper_section"), optional=("section_id", "paragraph_in_paper_id"),
    ),
    Table("arxiv_figures", "id long, paper_arxiv_id string, path string, caption string, label string, name string", ("name",), narrow=("id", "paper_arxiv_id", "label"), optional=("caption", "label", "name")),
    Table("arxiv_tables", "id long, paper_arxiv_id string, path string, caption string, label string, table_text string", narrow=("id", "paper_arxiv_id", "label"), optional=("path", "caption", "label", "table_text")),
    _edge(
        "arxiv_citations", "id long, citing_arxiv_id string, cited_arxiv_id string, bib_title string, bib_key string, citing_sections array<string>, citing_paragraphs array<string>",
        "citing_arxiv_id", "cited_arxiv_id", key=("citing_arxiv_id", "cited_arxiv_id"), narrow=("citing_arxiv_id", "cited_arxiv_id"), optional=("bib_title", "bib_key", "citing_sections", "citing_paragraphs"),
    ),
    _edge("arxiv_paper_authors", "paper_arxiv_id string, author_id string, author_sequence int, author_name string", "paper_arxiv_id", "author_id", key=("paper_arxiv_id", "author_id"), optional=("author_name",)),
    _edge("arxiv_paper_category", "paper_arxiv_id string, category_id int", "paper_arxiv_id", "category_id", key=("paper_arxiv_id", "category_id")),
    _edge("arxiv_paper_figures", "paper_arxiv_id string, figure_id int", "paper_arxiv_id", "figure_id", key=("paper_arxiv_id", "figure_id")),
    _edge("arxiv_paper_tables", "paper_arxiv_id string, table_id int", "paper_arxiv_id", "table_id", key=("paper_arxiv_id", "table_id")),
    _edge("arxiv_paragraph_references", "id long, paragraph_id int, paper_section string, paper_arxiv_id string, reference_label string, reference_type string", "paragraph_id", "reference_label"),
    _edge(
        "arxiv_paragraph_citations",
        "id long, paragraph_id int, paper_section string, citing_arxiv_id string, bib_key string, cited_arxiv_id string, paragraph_global_id int, bib_title string",
        "paragraph_id", "cited_arxiv_id", optional=("cited_arxiv_id", "paragraph_global_id", "bib_title"),
    ),
    _edge("arxiv_paragraph_figures", "id long, paragraph_id int, figure_id int, paper_arxiv_id string, paper_section_id int", "paragraph_id", "figure_id"),
    _edge("arxiv_paragraph_tables", "id long, paragraph_id int, table_id int, paper_arxiv_id string, paper_section_id int", "paragraph_id", "table_id"),
    Table(
        "openreview_papers", "venue string, paper_openreview_id string, title string, abstract string, paper_decision string, paper_pdf_link string",
        ("venue", "paper_openreview_id"), narrow=("venue", "paper_openreview_id", "title"), partition=_V, optional=("abstract", "paper_decision", "paper_pdf_link"),
    ),
    Table(
        "openreview_authors", "venue string, author_openreview_id string, author_full_name string, email string, affiliation string, homepage string, dblp string",
        ("venue", "author_openreview_id"), narrow=("venue", "author_openreview_id"), partition=_V, optional=("author_full_name", "email", "affiliation", "homepage", "dblp"),
    ),
    Table(
        "openreview_reviews", "venue string, review_openreview_id string, replyto_openreview_id string, writer string, title string, content string, time string",
        ("venue", "review_openreview_id"), narrow=("venue", "review_openreview_id", "title"), partition=_V, optional=("replyto_openreview_id", "writer", "title", "content", "time"),
    ),
    Table(
        "openreview_revisions", "venue string, original_openreview_id string, revision_openreview_id string, content string, time string",
        ("venue", "revision_openreview_id"), narrow=("venue", "original_openreview_id", "revision_openreview_id"), partition=_V, optional=("content", "time"),
    ),
    Table(
        "openreview_paragraphs", "venue string, paper_openreview_id string, paragraph_idx int, section string, content string",
        ("venue", "paper_openreview_id", "paragraph_idx"), narrow=("venue", "paper_openreview_id", "paragraph_idx"), partition=_V, optional=("section", "content"),
    ),
    _edge("openreview_arxiv", "venue string, paper_openreview_id string, arxiv_id string, title string", "paper_openreview_id", "arxiv_id", key=("venue", "paper_openreview_id"), partition=_V, optional=("title",)),
    _edge("openreview_papers_authors", "venue string, paper_openreview_id string, author_openreview_id string", "paper_openreview_id", "author_openreview_id", key=("venue", "paper_openreview_id", "author_openreview_id"), partition=_V),
    _edge(
        "openreview_papers_reviews", "venue string, paper_openreview_id string, review_openreview_id string, title string, time string",
        "paper_openreview_id", "review_openreview_id", key=("venue", "paper_openreview_id", "review_openreview_id"), partition=_V, optional=("title", "time"),
    ),
    _edge(
        "openreview_papers_revisions", "venue string, paper_openreview_id string, revision_openreview_id string, title string, time string",
        "paper_openreview_id", "revision_openreview_id", key=("venue", "paper_openreview_id", "revision_openreview_id"), partition=_V, optional=("title", "time"),
    ),
    _edge("openreview_revisions_reviews", "venue string, revision_openreview_id string, review_openreview_id string", "revision_openreview_id", "review_openreview_id", key=("venue", "revision_openreview_id", "review_openreview_id"), partition=_V),
)

TABLES: dict[str, Table] = {t.name: t for t in _ALL}
#: Other names under which callers know some tables.
ALIASES = {
    "arxiv_citation": "arxiv_citations", "arxiv_paper_citation": "arxiv_citations", "arxiv_paper_citations": "arxiv_citations", "arxiv_paper_author": "arxiv_paper_authors",
    "arxiv_paper_categories": "arxiv_paper_category", "arxiv_paper_figure": "arxiv_paper_figures", "arxiv_paper_table": "arxiv_paper_tables",
}
#: Wrapper fields of JSON files that hold the rows of a table.
WRAPPERS = {"arxiv_papers": "papers", "arxiv_citations": "citations", "arxiv_paragraph_citations": "paragraph_citations"}

#: State of the ingestion pipeline, one flag for each stage.
STAGES = ("downloaded", "paper_graph", "citation", "semantic_scholar", "paragraph")
TASKS = Table("paper_task", "id long, paper_arxiv_id string, " + ", ".join(f"{s} boolean" for s in STAGES), ("paper_arxiv_id",))

CITATION = (
    "struct<bib_key: string, bib_title: string, arxiv_id: string, short_id: string, title: string, author: string, published: string, similar_score: double, importance_score: double,"
    " context: array<struct<section: string, subsection: string, subsubsection: string, prev_context: string, next_context: string>>>"
)
#: One nested document for each paper, as a schema string; figures nest to any depth.
PAPER_GRAPH = (
    "title string, author string, abstract string, published string, primary_category string, summary string, categories array<string>, equations array<string>, algorithm array<string>,"
    " sections map<string, struct<content: string, appendix: string>>,"
    " `table` array<struct<original: string, caption: string, label: string, tabular: string, subtables: array<struct<caption: string, label: string, tabular: string>>>>,"
    f" figure variant, citations map<string, {CITATION}>"
)
#: Side-car metadata of a paper.
METADATA = "id string, title string, abstract string, authors array<string>, published string, categories array<string>, url string"
METADATA_NAMES = ("id", "title", "abstract", "authors", "published", "categories", "url")
REQUIRED_METADATA = ("title", "abstract", "published")


def table(name: str) -> Table:
    """A table by its name or an alias; KeyError if there is none."""
    return TABLES[ALIASES.get(name, name)]
