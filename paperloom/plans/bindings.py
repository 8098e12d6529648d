"""Scholarly-shaped views of the tables at hand, so that the graph operators can run on them."""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.session import read


class Bindings:
    """Views over one folder of tables; every view is lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    def papers(self) -> DataFrame:
        """Documents as papers: the first line is the title, the source the venue, the language the category."""
        return self.table("documents").select(
            F.col("doc_id").cast("string").alias("paper_openreview_id"), F.col("source").alias("venue"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("lang").alias("category"), F.col("doc_id").alias("id")
        )

    def paragraphs(self) -> DataFrame:
        """Lines of documents as paragraphs, the language as the section."""
        rows = self.table("documents").select(F.col("doc_id").cast("string").alias("paper_arxiv_id"), F.col("lang").alias("paper_section"), F.posexplode(F.split("text", "\n")).alias("at", "content"))
        return rows.select("paper_arxiv_id", "paper_section", "at", "content")

    def authorship(self) -> DataFrame:
        line = self.table("lineitem")
        return line.select(F.col("l_orderkey").cast("string").alias("paper_arxiv_id"), F.col("l_suppkey").cast("string").alias("author_id"), F.col("l_linenumber").alias("author_sequence"))

    def dated(self) -> DataFrame:
        """Orders as papers with a date, the priority as the venue and the status as the decision."""
        return self.table("orders").select(F.col("o_orderkey").alias("paper"), F.col("o_orderdate").alias("published"), F.col("o_orderpriority").alias("venue"), F.col("o_orderstatus").alias("decision"), F.col("o_totalprice").alias("rating"))

    def citations(self) -> DataFrame:
        """Orders cite the parts of their lines, as papers cite papers; self-citations are refused."""
        line = self.table("lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))
        return line.where("citing <> cited").distinct()

    def reviews(self) -> DataFrame:
        return self._events("click", "review_openreview_id")

    def revisions(self) -> DataFrame:
        return self._events("purchase", "revision_openreview_id")

    def _events(self, kind: str, name: str) -> DataFrame:
        rows = self.table("events").where(F.col("event_type") == kind)
        return rows.select(F.col("user_id").cast("string").alias("paper_openreview_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias(name), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"))

    def clean_lines(self) -> DataFrame:
        """(doc_id, lines): the lines of documents with ASCII letters, digits and blanks only."""
        docs = self.table("documents")  # characters by name are looked up in one table, ranges are tried one by one
        return docs.select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, f"[^{ascii_letters}{digits} ]+", ""))).alias("lines"))

    def tex(self) -> DataFrame:
        """(paper_id, tex): documents set as LaTeX.

        Two lines make a section, with a figure, a table and an equation each; from the third section on it is the appendix. Each line
        is a paragraph that cites two keys and refers to its section's figure.
        """

        def paragraph(line, i):
            keys = F.concat(F.lit(" \\citep{k"), (i % 3).cast("string"), F.lit(", k"), (i % 5).cast("string"), F.lit("} see \\ref{fig:"), F.floor(i / 2).cast("string"), F.lit("}."))
            head = F.concat(F.when(i == 4, "\\appendix\n").otherwise(""), F.lit("\\section{S"), F.floor(i / 2).cast("string"), F.lit("}\n"))
            g = F.floor(i / 2).cast("string")
            objects = F.concat(
                F.lit("\n\n\\begin{figure}\\includegraphics[width=1]{img/"), g, F.lit(".pdf}\\caption{C"), g, F.lit("}\\label{fig:"), g, F.lit("}\\end{figure}"),
                F.lit("\n\n\\begin{table}\\caption{T"), g, F.lit("}\\label{tab:"), g, F.lit("}\\begin{tabular}{c}"), g, F.lit("\\end{tabular}\\end{table}"),
                F.lit("\n\n\\begin{equation}x="), g, F.lit("\\end{equation}\n\n"),
            )
            return F.concat(F.when(i % 2 == 0, head).otherwise(""), line, keys, F.when(i % 2 == 0, objects).otherwise("\n\n"))

        rows = self.clean_lines()
        body = F.array_join(F.transform("lines", paragraph), "")
        head = F.concat(
            F.lit("\\documentclass{article}% head\n\\bibliography{refs,more.bib}\\title{"), F.element_at("lines", 1), F.lit("}\n\\author{\\textbf{A} "), F.col("doc_id").cast("string"),
            F.lit("}\n\\begin{document}\n\\begin{abstract}\n\\emph{x}"), F.element_at("lines", 1), F.lit("\n\\end{abstract}\n"),
        )
        return rows.select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(head, body, F.lit("\\end{document}\n")).alias("tex"))

    def nested_tex(self) -> DataFrame:
        """(paper_id, tex): a section a line, whose title, captions and parts nest one to six levels deep, among comments, verbatim text and escaped braces."""

        def deep(line, i):
            depth = (i % 6 + 1).cast("int")
            return F.concat(F.repeat(F.lit("\\emph{"), depth), line, F.repeat(F.lit("}"), depth))

        def section(line, i):
            n = i.cast("string")
            return F.concat(
                F.lit("% \\section{hidden} {\n\\section[s"), n, F.lit("]{"), deep(line, i), F.lit("}\nBody \\{ \\% \\begin{verbatim}\\section{no {\\end{verbatim}\n\\begin{figure*}\\begin{center}\\includegraphics[width=2]{img/"), n,
                F.lit(".pdf}\\end{center}\\begin{minipage}{2cm}\\begin{minipage}{1cm}\\includegraphics{p"), n, F.lit(".pdf}\\caption{"), deep(n, i), F.lit("}\\end{minipage}\\end{minipage}\\caption[short]{"), deep(line, i), F.lit("}\\label{fig:"), n,
                F.lit("}\\end{figure*}\n\\begin{table}\\begin{tabular}{c}\\begin{tabular}{l}"), n, F.lit("\\end{tabular}\\end{tabular}\\caption{"), deep(line, i), F.lit("}\\end{table}\n"),
            )

        body = F.array_join(F.transform("lines", section), "")
        return self.clean_lines().select(F.col("doc_id").cast("string").alias("paper_id"), F.concat(F.lit("\\begin{document}"), body, F.lit("\\end{document}\\section{after}")).alias("tex"))

    def nested_bib(self) -> DataFrame:
        """(paper_id, bib): an entry a line; titles in braces or quotes, one to six levels deep, with a macro and an unclosed note among them."""

        def entry(line, i):
            depth = (i % 6).cast("int")
            inner = F.concat(F.repeat(F.lit("{"), depth), line, F.repeat(F.lit("}"), depth))
            title = F.when(i % 2 == 0, F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(F.concat(F.lit('"'), inner, F.lit(' {"q"}"')))
            return F.concat(F.lit("@article{k"), i.cast("string"), F.lit(",\n year = 2020, title = "), title, F.lit(",\n author = who # { and B},\n note = {open\n}\n"))

        body = F.concat(F.lit('@string{who = "Ander, A"}\n'), F.array_join(F.transform("lines", entry), ""))
        return self.clean_lines().select(F.col("doc_id").cast("string").alias("paper_id"), body.alias("bib"))

    def deep_figures(self) -> DataFrame:
        """(paper_arxiv_id, figure): trees of one to fifty levels, each node but the last with a leaf beside the next one."""
        depth = (F.col("doc_id") % 50 + 1).cast("int")
        node = lambda k: F.concat(F.lit('{"caption":"c'), k.cast("string"), F.lit('","label":"l","figure_paths":["'), k.cast("string"), F.lit('.pdf"],"subfigures":['))
        leaf = ',{"caption":"leaf","label":null,"figure_paths":[],"subfigures":[]}]}'
        text = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), depth), node), ""), F.lit("]}"), F.repeat(F.lit(leaf), depth - 1), F.lit("]"))
        return self.table("documents").select(F.col("doc_id").cast("string").alias("paper_arxiv_id"), F.parse_json(text).alias("figure"))

    def bib(self) -> DataFrame:
        """(paper_id, bib, bbl): documents as one-entry bibliographies."""
        rows = self.clean_lines().select(F.col("doc_id").cast("string").alias("paper_id"), F.element_at("lines", 1).alias("title"))
        number = F.lpad(F.col("paper_id"), 5, "0")
        bib = F.concat(F.lit("@article{key"), F.col("paper_id"), F.lit(",\n title = {The {"), F.col("title"), F.lit("}},\n author = \"Ander, A and Other, B\",\n journal = {arXiv preprint arXiv:2301."), number, F.lit("}\n}\n@misc{b, title={x}}"))
        bbl = F.concat(F.lit("\\begin{thebibliography}\n\\bibitem[x]{key"), F.col("paper_id"), F.lit("} A. Ander \\newblock "), F.col("title"), F.lit(" \\newblock end\n\\end{thebibliography}"))
        return rows.select("paper_id", bib.alias("bib"), bbl.alias("bbl"))

    def notes(self) -> DataFrame:
        """Conversations as raw notes: the first turn is the submission, later turns are its replies."""
        turns = self.table("conversations")
        reply = F.struct(
            F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("replyto"), (F.col("turn") * 60000 + F.col("conv_id") * 3600000).cast("long").alias("tmdate"),
            F.array(F.concat(F.lit("Conf.cc/2024/"), F.when(F.col("role") == "user", "Reviewer_a").otherwise("Authors"))).alias("signatures"),
            F.when(F.col("role") == "user", F.create_map(F.lit("summary"), F.col("text"))).otherwise(F.create_map(F.lit("comment"), F.col("text"))).alias("content"),
        )
        gathered = F.collect_list(F.when(F.col("turn") > 0, F.struct("turn", reply.alias("r"))))
        return turns.groupBy("conv_id").agg(F.array_sort(gathered, lambda x, y: (x["turn"] - y["turn"]).cast("int")).alias("all")).select(
            F.lit("Conf.cc/2024/Conference").alias("venue"), F.col("conv_id").cast("string").alias("id"), F.transform("all", lambda x: x["r"]).alias("replies")
        )

    def paper_graphs(self) -> DataFrame:
        """Documents as paper graphs: PAPER_GRAPH columns that the derivations read, and paper_arxiv_id.

        Two lines make a section; each section has a figure with a sub-figure and a table; four keys are cited, one
        without a cited id.
        """
        rows = self.clean_lines()
        n = F.greatest(F.lit(1), F.floor((F.size("lines") + 1) / 2)).cast("int")
        groups = F.sequence(F.lit(0), n - 1)

        def section(g):
            lines = F.slice("lines", g * 2 + 1, 2)
            text = F.concat(F.array_join(lines, "\n\n"), F.lit(" \\cite{k0, k"), (g % 4).cast("string"), F.lit("} \\ref{fig:"), g.cast("string"), F.lit("} \\ref{tab:"), g.cast("string"), F.lit("}"))
            value = F.struct(text.alias("content"), F.when(g > 1, "true").otherwise("false").alias("appendix"))
            return F.struct(F.concat(F.lit("S"), F.lpad(g.cast("string"), 4, "0")).alias("key"), value.alias("value"))

        none = F.array().cast("array<struct<original: string, caption: string, label: string, figure_paths: array<string>>>")

        def figure(g):
            name = g.cast("string")
            path = lambda kind: F.array(F.concat(F.lit(f"img/{kind}"), name, F.lit(".pdf")))
            part = F.struct(F.lit("o").alias("original"), F.lit("part").alias("caption"), F.lit(None).cast("string").alias("label"), path("p").alias("figure_paths"), none.alias("subfigures"))
            return F.struct(F.lit("o").alias("original"), F.concat(F.lit("C"), name).alias("caption"), F.concat(F.lit("fig:"), name).alias("label"), path("f").alias("figure_paths"), F.array(part).alias("subfigures"))

        def table(g):
            name = g.cast("string")
            return F.struct(F.lit("o").alias("original"), F.concat(F.lit("T"), name).alias("caption"), F.concat(F.lit("tab:"), name).alias("label"), name.alias("tabular"))

        def citation(k):
            key = F.concat(F.lit("k"), k.cast("string"))
            context = F.struct(F.concat(F.lit("S"), k.cast("string")).alias("section"))
            value = F.struct(
                key.alias("bib_key"), F.concat(F.lit("title "), key).alias("bib_title"), F.when(k < 3, F.concat(F.lit("2301.0000"), k.cast("string"))).alias("arxiv_id"), F.lit(None).cast("string").alias("short_id"),
                F.array(context, context).alias("context"),
            )
            return F.struct(key.alias("key"), value.alias("value"))

        return rows.select(
            F.col("doc_id").cast("string").alias("paper_arxiv_id"), F.map_from_entries(F.transform(groups, section)).alias("sections"), F.transform(groups, figure).alias("figure"),
            F.transform(groups, table).alias("table"), F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(3)), citation)).alias("citations"),
        )
