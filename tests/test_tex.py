"""LaTeX and BibTeX by delimiters, against a plain recursive parser."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from paperloom.functions import tex
from paperloom.operators import latex

WANTED = ("section", "caption", "label")


def without_comments(t):
    out, i = "", 0
    while i < len(t):
        if t.startswith("\\begin{verbatim}", i):
            j = t.find("\\end{verbatim}", i)
            out, i = out + t[i:j], j
        elif t[i] == "\\":
            out, i = out + t[i : i + 2], i + 2
        elif t[i] == "%":
            while i < len(t) and t[i] != "\n":
                i += 1
        else:
            out, i = out + t[i], i + 1
    return out


def group_end(t, i, close):
    """Where the group that begins before i is closed; braces nest."""
    while i < len(t):
        if t.startswith("\\begin{verbatim}", i):
            i = t.find("\\end{verbatim}", i)
        if t[i] == "\\":
            i += 2
        elif t[i] == close:
            return i
        elif t[i] == "}":
            return None
        elif t[i] == "{":
            i = group_end(t, i + 1, "}")
            if i is None:
                return None
            i += 1
        else:
            i += 1
    return None


def plain(t):
    t, found, i = without_comments(t), [], 0
    while i < len(t):
        if t.startswith("\\begin{verbatim}", i):
            i = t.find("\\end{verbatim}", i)
            continue
        m = re.compile(r"\\([A-Za-z]+)\*?").match(t, i)
        if not m:
            i += 2 if t[i] == "\\" else 1
            continue
        i = m.end()
        if m[1] not in WANTED:
            continue
        j, option = i, None
        while True:
            while j < len(t) and t[j].isspace():
                j += 1
            if j >= len(t) or t[j] not in "[{":
                break
            end = group_end(t, j + 1, "]" if t[j] == "[" else "}")
            if end is None:
                break
            if t[j] == "{":
                found.append((m[1], option, t[j + 1 : end]))
                break
            option, j = option if option is not None else t[j + 1 : end], end + 1
    return found


def written(rng, depth=0):
    part = lambda: written(rng, depth + 1) if depth < 5 else "x"
    kinds = [
        lambda: rng.choice(["word ", "\\%", "\\{", "\\}", "\\\\", "a\nb", "\\[", "é", "[half ", "open) ", "$x$ "]),
        lambda: f"\\section{{{part()}}}", lambda: f"\\section*[{rng.choice(['s', 's{]}t', '{' + part() + '}'])}]{{{part()}}}", lambda: f"\\caption [s]\n {{{part()}}}", lambda: f"\\label{{{part()}}}",
        lambda: f"{{{part()}}}", lambda: f"\\emph{{{part()}}}", lambda: f"% \\section{{{rng.choice(['no', '{'])}}} }}\n", lambda: "\\begin{verbatim}\\section{no} { % \\end{verbatim}", lambda: f"\\begin{{center}}{part()}\\end{{center}}",
    ]
    return "".join(rng.choice(kinds)() for _ in range(rng.randrange(1, 5)))


@pytest.mark.parametrize("seed", range(200))
def test_commands_as_a_recursive_parser_reads_them(seed):
    rng = random.Random(seed)
    text = written(rng)
    if seed % 5 == 0:  # and broken ones
        open_ = rng.choice(["{", "\\section{", "\\section[s]{", "\\section"])
        text = rng.choice([open_ + " " + text, text + open_])
    items, _ = tex.parse(text, frozenset(WANTED), frozenset(), frozenset())
    assert [(i["name"], i.get("option"), i["value"]) for i in items] == plain(text), text


def environments(rng, depth=0):
    """Text with environments, and the outermost ones of name a."""
    out, found = "", []
    for _ in range(rng.randrange(1, 4)):
        name = rng.choice(["a", "a*", "b"])
        inner, inside = environments(rng, depth + 1) if depth < 4 and rng.random() < 0.7 else (rng.choice(["text ", "% \\end{a}\n", "\\{"]), [])
        whole = f"\\begin{{{name}}}{inner}\\end{{{name}}}"
        found += [without_comments(whole)] if name[0] == "a" else inside
        out += "between " + whole
    return out, found


@pytest.mark.parametrize("seed", range(60))
def test_outermost_environments(seed):
    text, want = environments(random.Random(seed))
    items, rest = tex.parse(text, frozenset(), frozenset("a"), frozenset())
    assert [i["whole"] for i in items] == want
    plain_rest = without_comments(text)
    for whole in want:
        plain_rest = plain_rest.replace(whole, "", 1)
    assert rest == plain_rest


def test_what_is_no_latex():
    get = lambda t: [(i["name"], i.get("value")) for i in tex.parse(t, frozenset(["section"]), frozenset(["figure"]), frozenset(["appendix"]))[0]]
    assert get("\\verb|\\section{a}|\\section{b}\\verb*+{+\\section{c}") == [("section", "b"), ("section", "c")]
    assert get("\\\\section{a} \\sectionmark{b} \\section {c} \\appendix{} \\section") == [("section", "c"), ("appendix", None)]
    assert get("\\section{a}\\end{document}\\section{b}") == [("section", "a")]
    assert get("\\\\% \\section{no}\n\\%\\section{yes}") == [("section", "yes")]
    assert get("\\begin{figure} open \\section{a} \\begin{figure}x\\end{figure}") == [("section", "a"), ("figure", None)]
    assert get("\\end{figure}\\begin{figure}\\begin{lstlisting}\\end{figure}\\end{lstlisting}\\end{figure}") == [("figure", None)]
    assert tex.parse(None, frozenset(["section"]), frozenset(), frozenset()) == ([], None)


@pytest.mark.parametrize("part", ["{", "}", "[", "\\section{", "\\section[", "\\caption[x]{", "\\begin{figure}", "\\end{figure}", "\\begin{verbatim}", "%", "\\verb|", "\\section ", "\\begin{a}\\end{b}"])
def test_time_follows_the_length(part):
    took = []
    for n in (20_000, 160_000):
        began = time.process_time()
        tex.parse(part * n, frozenset(["section", "caption"]), frozenset(["figure"]), frozenset())
        took.append(time.process_time() - began)
    assert took[1] < 16 * max(took[0], 0.1), part


TEX = r"""\documentclass{article}\title[Short]{A {\bf deep {one}} here}\author{\textbf{A \emph{B {C}}}}
\begin{document}\begin{abstract}Of \emph{an {inner}} kind % not this
\end{abstract}
\section[short]{On \textbf{B \emph{C}} end}First.\section*{With {{{{{six}}}}} levels}
\begin{figure*}\includegraphics[width={1\textwidth}]{a {b}.pdf}\begin{minipage}{3cm}\begin{minipage}{1cm}\includegraphics{in.pdf}\caption{Inner \textit{c}}\end{minipage}\end{minipage}
\subfloat[Of \emph{sub}]{\includegraphics{sub.pdf}\label{sub}}\caption[List]{See \textbf{x \emph{y}} and \{z}\label{f}\end{figure*}
\begin{table}\begin{center}\begin{tabular}{c}\begin{tabular}{l}1\end{tabular}&\%\end{tabular}\end{center}\caption{Of {two {three}}}\label{t}\end{table}
\begin{align}a\begin{equation}b\end{equation}\end{align}
\appendix\section{Last}Text\end{document}\section{No}"""


def test_tables_of_nested_latex(spark):
    papers = spark.createDataFrame([("p", TEX), ("null", None), ("empty", "")], "paper_id string, tex string")
    got = [tuple(r) for r in latex.sections(papers).orderBy("section_in_paper_id").select("title", "appendix").collect()]
    assert got == [(r"On \textbf{B \emph{C}} end", False), ("With {{{{{six}}}}} levels", False), ("Last", True)]
    figure = latex.figures(papers).first()
    assert (figure["caption"], figure["label"], figure["figure_paths"]) == (r"See \textbf{x \emph{y}} and \{z", "f", ["a {b}.pdf"])
    assert [(s["caption"], s["label"], s["figure_paths"]) for s in figure["subfigures"]] == [(r"Inner \textit{c}", None, ["in.pdf"]), (r"Of \emph{sub}", "sub", ["sub.pdf"])]
    table = latex.tables(papers).first()
    assert (table["caption"], table["label"], table["tabular"]) == ("Of {two {three}}", "t", r"\begin{tabular}{c}\begin{tabular}{l}1\end{tabular}&\%\end{tabular}")
    assert [(r["kind"], r["content"]) for r in latex.blocks(papers).collect()] == [("equation", r"\begin{align}a\begin{equation}b\end{equation}\end{align}")]
    metadata = spark.createDataFrame([], "paper_id string, title string, author string")
    info = {r["paper_id"]: r for r in latex.base_info(papers, metadata).collect()}
    assert (info["p"]["title"], info["p"]["author"]) == ("A  deep one here", "A B C") or info["p"]["title"].split() == "A deep one here".split()
    assert {r["paper_id"]: r["abstract"] for r in latex.abstracts(papers).collect()}["p"].startswith("Of")


BIB = r"""@string{jan = "January"} @string(pub = {Press {of} X})
@Article{a1, title = {The {{Deep}} {T}itle of {a {b {c}}}}, author="A, B and {C "quoted" D}", journal = jan # " arXiv preprint arXiv:" # {2301.00001}, year=2020}
@misc{a2,
  title = "Braces {in " quotes} end",
  note = {never closed,
@book{a3, publisher = pub, title = {With \{ escaped \} and = signs, commas}, eprint = {2302.12345}}
@comment{ignored}
text @inproceedings{a4,title={One line},}"""


def test_bib_entries(spark):
    found = {r["key"]: r for r in tex.bib_parse(BIB)}
    assert list(found) == ["a1", "a2", "a3"]  # the last is within a line of text
    assert found["a1"]["fields"] == {"title": "The {{Deep}} {T}itle of {a {b {c}}}", "author": 'A, B and {C "quoted" D}', "journal": "January arXiv preprint arXiv:2301.00001", "year": "2020"}
    assert found["a2"]["fields"] == {"title": 'Braces {in " quotes} end'}
    assert found["a3"]["fields"] == {"publisher": "Press {of} X", "title": "With \\{ escaped \\} and = signs, commas", "eprint": "2302.12345"}
    rows = latex.bib_entries(spark.createDataFrame([("p", BIB), ("n", None)], "paper_id string, bib string")).orderBy("bib_key").collect()
    assert [(r["bib_key"], r["title"], r["arxiv_id"]) for r in rows] == [("a1", "The Deep Title of a b c", "2301.00001"), ("a2", 'Braces in " quotes end', None), ("a3", "With \\ escaped \\ and = signs, commas", "2302.12345")]


def test_plans_keep_the_rows_where_they_are(spark):
    papers = spark.createDataFrame([("p", TEX)], "paper_id string, tex string")
    plan = latex.figures(papers)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and latex.figures(papers).where(F.size("subfigures") == 2).count() == 1


def test_a_task_holds_a_slice_of_a_batch(spark):
    """Whatever the size of a batch of rows, what is made of them leaves in slices of bounded size."""
    import pyarrow as pa

    from paperloom.functions import slices

    texts = pa.array(["x" * 400_000] * 5 + [None, "y" * 3_000_000, ""] + ["z"] * 2500)
    found = list(slices.cuts([texts]))
    assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]] and found[-1][1] == len(texts)
    assert all(b - a == 1 or b - a <= slices.ROWS and sum(len(t or "") for t in texts[a:b].to_pylist()) <= slices.SLICE for a, b in found)
    lists = pa.array([["x" * 600_000], None, ["x" * 600_000, None], []])
    assert list(slices.cuts([lists])) == [(0, 2), (2, 4)]
    sizes = slices.by_slices("long", lambda rows: pa.array([len(rows)] * len(rows), pa.int64()))
    got = [r[0] for r in spark.range(2500, numPartitions=1).select(sizes(F.lit("t").substr(F.lit(1), F.col("id") % 2 + 1))).collect()]
    assert got == [1000] * 2000 + [500] * 500


def test_coarse_scan_has_the_environments_of_the_whole_one():
    """Where no command of the names can be found, other tokens are passed over; comments, verbatim text and the document's end count all the same."""
    draw = random.Random(3)
    parts = ["\\begin{figure}", "\\end{figure}", "\\begin", "\\end", "\\begin {a*}", "\\end{a}", "\\verb|", "\\verb*|", "|", "\\verbatim", "\\begin{verbatim}", "\\end{verbatim}", "\\end{document}"]
    parts += ["%", "% x\\begin{a}\n", "\n", "\\\\", "\\%", "\\", "{", "}", "[", "]", " ", "x", "*", "\\beginning", "\\endx"]
    for _ in range(5000):
        text = "".join(draw.choices(parts, k=draw.randrange(14)))
        whole, tokens = tex._scan(text)
        assert tex._scan(text, True) == (whole, [t for t in tokens if t[0] in ("begin", "end")])


def test_objects_by_label_reads_figures_and_lines_once(spark, tmp_path):
    """No Python function is left in the plan of the link, and neither lines nor references are searched for a filter before."""
    from paperloom.queries import QUERIES

    spark.createDataFrame([(1, "a\nb\nc"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["a9_objects_by_label"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("regexp_extract_all(") == 1
    assert sorted((r["paper_id"], r["pos"], r["objects"]) for r in found.collect()) == [("1", 0, "C0"), ("1", 1, "C0"), ("1", 2, "C1"), ("2", 0, "C0")]
