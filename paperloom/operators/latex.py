"""Tables out of LaTeX, BibTeX and paper-graph documents.

Arguments, options and environments are read by their delimiters, at any depth (``functions.tex``); macros are not expanded;
included files are joined before (see ``with_inputs``).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import tex
from paperloom.functions import text as X
from paperloom.functions.slices import by_slices
from paperloom.operators import link
from paperloom.session import written


def _all(c: Column | str, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.col(c) if isinstance(c, str) else c, F.lit(pattern), F.lit(group))


def _one(c: Column | str, pattern: str, group: int = 1) -> Column:
    got = F.regexp_extract(c, pattern, group)
    return F.when(got != "", got)


def without_comments(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?m)(?<!\\)%.*$", "")


def sections(papers: DataFrame, text: str = "tex", paper: str = "paper_id") -> DataFrame:
    """(paper, section_in_paper_id from 1, title, content, appendix) in document order; of a section with a short title the long one counts."""
    out = papers.select(paper, F.posexplode(tex.items(text, "section", bare="appendix", fields="name value content")).alias("at", "s"))
    out = out.select(paper, "at", F.col("s.name").alias("name"), F.col("s.value").alias("title"), F.trim(F.col("s.content")).alias("content"))
    mark = F.col("name") == "appendix"
    order = Window.partitionBy(paper).orderBy("at")
    out = out.withColumn("appendix", F.max(mark).over(order)).where(~mark)
    return out.withColumn("section_in_paper_id", F.row_number().over(order)).select(paper, "section_in_paper_id", "title", "content", "appendix")


def citations(parts: DataFrame, paper: str = "paper_id") -> DataFrame:
    """One row for each (paper, key): its sections, importance and contexts.

    parts: paper, title, section_in_paper_id, content. A context is the sentence around the macro, before and after it.
    """
    sentences = parts.select(paper, "title", "section_in_paper_id", F.posexplode(F.split("content", X.SENTENCE_END)).alias("sentence_at", "sentence"))
    macro = rf"\\(?:{'|'.join(X.CITE_MACROS)})\*?\{{[^}}]+\}}"
    macros = sentences.select(paper, "title", "section_in_paper_id", "sentence_at", "sentence", F.posexplode(_all("sentence", macro, 0)).alias("macro_at", "macro"))
    keyed = macros.withColumn("keys", X.cites("macro"))
    where = F.expr("locate(macro, sentence)")
    contexts = keyed.select(
        paper, F.explode("keys").alias("bib_key"), (F.lit(1.0) / F.size("keys")).alias("share"),
        F.struct(
            "section_in_paper_id", "sentence_at", "macro_at", F.col("title").alias("section"),
            F.trim(F.expr("substring(sentence, 1, locate(macro, sentence) - 1)")).alias("prev_context"),
            F.trim(F.col("sentence").substr(where + F.length("macro"), F.length("sentence"))).alias("next_context"),
        ).alias("context"),
    )
    ordered = F.array_sort(F.collect_list("context"))
    plain = F.transform(ordered, lambda x: F.struct(x["section"].alias("section"), x["prev_context"].alias("prev_context"), x["next_context"].alias("next_context")))
    return contexts.groupBy(paper, "bib_key").agg(
        F.array_sort(F.collect_set("context.section")).alias("citing_sections"), F.sum("share").alias("importance_score"), plain.alias("context")
    )


_DESCRIBING = "caption label includegraphics subfloat"
_ARGUMENTS = "name option value"


def _described(found: Column) -> list[Column]:
    """First caption (or that of a subfloat's option), last label and image paths among the items of a text."""
    values = lambda name: F.transform(tex.named(found, name), lambda x: x["value"])
    option = F.try_element_at(tex.named(found, "subfloat"), F.lit(1))["option"]
    caption = F.coalesce(F.try_element_at(values("caption"), F.lit(1)), option)
    paths = F.filter(F.transform(values("includegraphics"), lambda p: F.trim(p)), lambda p: p != "")
    return [caption.alias("caption"), F.try_element_at(values("label"), F.lit(-1)).alias("label"), paths.alias("figure_paths")]


def tables(papers: DataFrame, text: str = "tex", paper: str = "paper_id") -> DataFrame:
    """(paper, at, original, caption, label, tabular) of the table environments; the last label wins."""
    rows = papers.select(paper, F.posexplode(tex.items(text, environments="table", fields="whole")).alias("at", "t")).select(paper, "at", F.col("t.whole").alias("original"))
    tabular = F.try_element_at(tex.items("original", environments="tabular tabularx tabulary array", fields="whole"), F.lit(1))["whole"]
    rows = rows.select(paper, "at", "original", tabular.alias("tabular"), tex.items("original", "caption label", fields=_ARGUMENTS).alias("found"))
    return rows.select(paper, "at", "original", *_described(F.col("found"))[:2], "tabular")


def figures(papers: DataFrame, text: str = "tex", paper: str = "paper_id") -> DataFrame:
    """(paper, at, original, caption, label, figure_paths, subfigures) of the figure environments.

    Sub-figures are the outermost subfigure, minipage and subfloat parts that hold an image; the paths, labels and
    captions of such parts do not count for the figure around them.
    """
    rows = papers.select(paper, F.posexplode(tex.items(text, environments="figure", fields="whole")).alias("at", "f")).select(paper, "at", F.col("f.whole").alias("original"))
    split = rows.withColumn("split", tex.parsed("original", "subfloat", "subfigure minipage", fields="whole"))
    parts = F.filter(F.transform("split.items", lambda p: p["whole"]), lambda p: p.contains("\\includegraphics"))
    rows = split.select(paper, "at", "original", parts.alias("parts"), tex.items("split.rest", _DESCRIBING, fields=_ARGUMENTS).alias("own"))
    rows = rows.withColumn("inner", F.arrays_zip("parts", tex.items_of_each("parts", _DESCRIBING, _ARGUMENTS).alias("items")))
    parts = F.transform("inner", lambda p: F.struct(p["parts"].alias("original"), *_described(p["items"])))
    return rows.select(paper, "at", "original", *_described(F.col("own")), parts.alias("subfigures"))


#: Environment families of displayed formulas and algorithms.
BLOCKS = {"equation": "equation align gather multline eqnarray displaymath", "algorithm": "algorithm algorithm2e algorithmic"}


def blocks(papers: DataFrame, text: str = "tex", paper: str = "paper_id") -> DataFrame:
    """(paper, kind, at, content) of equations and algorithms, the outermost of each family."""
    each = [papers.select(paper, F.lit(kind).alias("kind"), F.posexplode(tex.items(text, environments=names, fields="whole")).alias("at", "b")) for kind, names in BLOCKS.items()]
    return each[0].unionByName(each[1]).select(paper, "kind", "at", F.col("b.whole").alias("content"))


def bib_entries(files: DataFrame, text: str = "bib", paper: str = "paper_id") -> DataFrame:
    """(paper, bib_key, title, author, first_author, arxiv_id) of BibTeX entries; braces nest, quoted and joined values and string macros are read."""
    entries = files.select(paper, F.explode(tex.bib_entries(text)).alias("e")).select(paper, F.col("e.key").alias("bib_key"), F.col("e.entry").alias("entry"), F.col("e.fields").alias("fields"))

    def value(name: str) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.try_element_at("fields", F.lit(name)), "[{}]", ""), r"\s+", " "))

    out = entries.select(paper, "bib_key", value("title").alias("title"), value("author").alias("author"), F.coalesce(X.journal_id(value("journal")), X.bib_to_id("entry")).alias("arxiv_id"))
    return out.withColumn("first_author", X.first_author("author"))


def bbl_entries(files: DataFrame, text: str = "bbl", paper: str = "paper_id") -> DataFrame:
    """(paper, bib_key, authors, title) of thebibliography items; the title starts at the first of {, newblock and '."""
    items = files.select(paper, F.explode(F.slice(F.split(F.regexp_replace(text, r"\[.*\]", ""), r"\\bibitem"), 2, 1 << 30)).alias("item"))
    items = items.withColumn("bib_key", _one("item", r"^[^{]*?\{([^}]*)\}")).where("bib_key is not null")
    body = F.trim(F.regexp_replace("item", r"(?s)^[^{]*?\{[^}]*\}", ""))
    split = r"(?s)^(.*?)(?:\{(.*?)\}|\\newblock(.*?)\\newblock|'(.*?)')"
    rows = items.withColumn("body", body)
    title = F.coalesce(*[_one("body", split, g) for g in (2, 3, 4)])
    tidy = lambda c: X.drop_markup(F.replace(c, F.lit("\n"), F.lit(" ")))
    return rows.select(paper, "bib_key", tidy(_one("body", split, 1)).alias("authors"), tidy(title).alias("title")).where("title is not null")


def fill_from_bib(cited: DataFrame, entries: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Cited ids where missing, from the bibliography of the same paper."""
    known = entries.where("arxiv_id is not null").groupBy(paper, "bib_key").agg(F.min("arxiv_id").alias("_found"))
    return cited.join(known, [paper, "bib_key"], "left").withColumn("arxiv_id", F.coalesce("arxiv_id", "_found")).drop("_found")


def chunks(parts: DataFrame, paper: str = "paper_id") -> DataFrame:
    """Section text to paragraph chunks: split at blank lines, trimmed, without table and figure environments.

    chunk_id is text_<n>, counted through the paper; paragraph_id counts from 0 in its section.
    """
    rows = parts.select(paper, "section_in_paper_id", F.col("title").alias("section"), F.posexplode(F.split("content", r"\n\n")).alias("part_at", "chunk"))
    rows = rows.withColumn("content", F.trim(F.regexp_replace("chunk", r"^\s+|\s+$", ""))).where((F.col("content") != "") & ~X.environment_chunk("content"))
    at = F.row_number().over(Window.partitionBy(paper).orderBy("section_in_paper_id", "part_at")) - 1
    numbered = rows.withColumn("at", at).withColumn("chunk_id", F.concat(F.lit("text_"), F.col("at")))
    return link.paragraph_ordinals(numbered, "at", paper, "section_in_paper_id").select(paper, "section", "section_in_paper_id", "at", "chunk_id", "paragraph_id", "content")


def with_inputs(files: DataFrame) -> DataFrame:
    """(paper_id, tex): the main file of each paper with the files that it includes, and those that they include, in their place.

    files: paper_id, file, content. The main file has a document environment (the first by name, if several). Inclusions in comments and verbatim text are none; a
    file may be included many times, but not in itself: inclusions of a file inside it, and of files that are not there, leave nothing. Each file is cut at its inclusions once; a round
    then joins the open inclusions of all papers with the files, until none is open. Rounds are as many as inclusions nest, and are written tables.
    """
    stem = lambda c: F.regexp_replace(F.trim(c), r"^\./|\.tex$", "")
    found = files.select("paper_id", "file", stem("file").alias("name"), tex.parsed("content", "input include", fields="value content").alias("p"), F.col("content").contains("\\begin{document}").alias("main"))
    after = F.transform("p.items", lambda x: F.coalesce(x["content"], F.lit("")))
    head = F.expr("left(p.rest, length(p.rest) - aggregate(p.items, 0, (n, x) -> n + length(coalesce(x.content, ''))))")
    pieces = F.arrays_zip(F.concat(F.array(head), after).alias("text"), F.concat(F.transform("p.items", lambda x: stem(x["value"])), F.array(F.lit(None).cast("string"))).alias("include"))
    cut = written(found.select("paper_id", "file", "name", "main", pieces.alias("pieces")))
    known = cut.groupBy("paper_id", "name").agg(F.min_by("pieces", "file").alias("pieces"))
    start = cut.where("main").groupBy("paper_id").agg(F.min_by(F.struct("name", "pieces"), "file").alias("m"))
    # a row for each piece: its place, as a path of numbers, and the inclusion that follows it, with the files that it is in
    level = start.select("paper_id", F.array(F.col("m.name")).alias("inside"), F.posexplode("m.pieces").alias("at", "piece")).withColumn("path", F.array("at"))
    level = written(level.select("paper_id", "path", "inside", "piece.text", "piece.include"))
    done = level.select("paper_id", "path", "text")
    while True:
        open_ = level.where(F.col("include").isNotNull() & ~F.array_contains("inside", F.col("include")))
        if open_.isEmpty():
            break
        joined = open_.select("paper_id", "path", F.concat("inside", F.array("include")).alias("inside"), F.col("include").alias("name")).join(known, ["paper_id", "name"])
        each = joined.select("paper_id", "path", "inside", F.posexplode("pieces").alias("at", "piece"))
        level = written(each.select("paper_id", F.concat("path", F.array("at")).alias("path"), "inside", "piece.text", "piece.include"))
        done = done.unionByName(level.select("paper_id", "path", "text"))
    ordered = F.array_sort(F.collect_list(F.struct("path", "text")))
    return done.groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("tex"))


def base_info(papers: DataFrame, metadata: DataFrame, text: str = "tex") -> DataFrame:
    """(paper_id, title, author, bibliographies); catalogue values win over those of the LaTeX, where an empty argument is none."""
    names = F.concat(_all(text, r"\\bibliography\{([^}]+)\}"), _all(text, r"\\addbibresource(?:\[[^\]]*\])?\{([^}]+)\}"))
    names = F.filter(F.flatten(F.transform(names, lambda n: F.transform(F.split(n, ","), lambda x: F.regexp_replace(F.trim(x), r"\.bib$", "")))), lambda x: x != "")
    heads = tex.items(text, "title author", fields="name value")
    first = lambda name: F.try_element_at(tex.named(heads, name), F.lit(1))["value"]
    shown = lambda name: F.nullif(X.drop_markup(first(name)), F.lit(""))
    own = papers.select("paper_id", shown("title").alias("_title"), shown("author").alias("_author"), names.alias("bibliographies"))
    out = own.join(metadata.select("paper_id", "title", "author"), "paper_id", "left")
    return out.select("paper_id", F.coalesce("title", "_title").alias("title"), F.coalesce("author", "_author").alias("author"), "bibliographies")


def abstracts(papers: DataFrame, text: str = "tex") -> DataFrame:
    """(paper_id, abstract): the environment's text without commands."""
    body = F.try_element_at(tex.items(text, environments="abstract", fields="content"), F.lit(1))["content"]
    return papers.select("paper_id", F.trim(F.regexp_replace(X.drop_commands(body), r"^\s+|\s+$", "")).alias("abstract"))


# Rows out of paper-graph documents


def document_sections(documents: DataFrame) -> DataFrame:
    rows = documents.select("paper_arxiv_id", F.posexplode(F.map_entries("sections")).alias("at", "s"))
    return rows.select("paper_arxiv_id", F.col("s.key").alias("title"), F.col("s.value.content").alias("content"), X.appendix_flag(F.col("s.value.appendix")).alias("appendix"), (F.col("at") + 1).alias("section_in_paper_id"))


def document_citations(documents: DataFrame) -> DataFrame:
    rows = documents.select("paper_arxiv_id", F.explode(F.map_values("citations")).alias("c"))
    found = F.array_sort(F.array_distinct(F.filter(F.transform("c.context", lambda x: x["section"]), lambda s: s.isNotNull())))
    return rows.select(
        F.col("paper_arxiv_id").alias("citing_arxiv_id"), F.coalesce("c.arxiv_id", "c.short_id").alias("cited_arxiv_id"), F.col("c.bib_title").alias("bib_title"), F.col("c.bib_key").alias("bib_key"),
        found.alias("citing_sections"), F.array().cast("array<string>").alias("citing_paragraphs"),
    )


def document_tables(documents: DataFrame) -> DataFrame:
    rows = documents.select("paper_arxiv_id", F.posexplode("table").alias("at", "t"))
    return rows.select("paper_arxiv_id", "at", F.lit(None).cast("string").alias("path"), F.col("t.caption").alias("caption"), F.col("t.label").alias("label"), F.col("t.tabular").alias("table_text"))


def _nodes(text: str | None) -> list[dict]:
    """The nodes of a figure tree in JSON, a parent before its children, whatever its depth."""
    nodes, waiting = [], [json.loads(text)] if text else []
    while waiting:
        node = waiting.pop()
        if isinstance(node, list):
            waiting += reversed(node)
        elif isinstance(node, dict):
            paths = node.get("figure_paths") or [None]
            nodes.append({"path": paths[0], "caption": node.get("caption"), "label": node.get("label")})
            waiting.append(node.get("subfigures"))
    return nodes


_NODES = pa.list_(pa.struct([(name, pa.string()) for name in ("path", "caption", "label")]))
_figure_nodes = by_slices("array<struct<path: string, caption: string, label: string>>", lambda texts: pa.array([_nodes(t) for t in texts], _NODES))


def document_figures(documents: DataFrame) -> DataFrame:
    """Figure trees of any depth (a VARIANT, or nested structs) to rows: a parent comes before its children; nodes without a path are kept."""
    nodes = _figure_nodes(F.to_json("figure"))
    return documents.select("paper_arxiv_id", F.posexplode(nodes).alias("at", "f")).select("paper_arxiv_id", "at", "f.path", "f.caption", "f.label")
