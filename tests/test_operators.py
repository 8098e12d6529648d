"""Joins, merges, matches and derivations on hand-made tables."""

import ast
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.functions.literal import to_json
from paperloom.operators import graph, latex, link, match, notes, pdftext, revisions, store


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_as_of(spark):
    reviews = spark.createDataFrame([("p", "1", "r1"), ("p", "3", "r3"), ("p", "9", "r9"), ("q", "1", "o")], "paper_openreview_id string, time string, review_openreview_id string")
    changed = spark.createDataFrame([("p", "2", "v2"), ("p", "5", "v5a"), ("p", "5", "v5b")], "paper_openreview_id string, time string, revision_openreview_id string")
    assert rows(link.as_of(reviews, changed)) == [("p", "v2", "r1"), ("p", "v5a", "r3")]


def test_insert_twice_and_null_keys(spark):
    old = spark.createDataFrame([], "citing_arxiv_id string, cited_arxiv_id string, n int")
    new = spark.createDataFrame([("a", "b", 1), ("a", "b", 2), ("a", None, 3), ("a", None, 4), ("a", "a", 5)], "citing_arxiv_id string, cited_arxiv_id string, n int")
    once = store.insert_citations(old, new, ["n"])
    twice = store.insert_citations(once, new.where("cited_arxiv_id is not null"), ["n"])
    assert rows(once) == rows(twice) == sorted([("a", "b", 1), ("a", None, 3), ("a", None, 4)], key=str)


def test_update_delete_ids(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, v string")
    changes = spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "id int, name string, v string")
    assert rows(store.update(old, changes, ["id"])) == [(1, "a", "x"), (2, "b", "z")]
    kept, gone = store.delete(old, changes.select("id"))
    assert rows(kept) == [(1, "a", "x")] and rows(gone) == [(2, "b", "y")]
    assert rows(store.delete(kept, old.select("id"))[0]) == []
    ids = store.with_ids(spark.range(1000).select((F.lit(999) - F.col("id")).alias("k")), ["k"], 5)
    assert [r["id"] for r in ids.orderBy("k").collect()] == list(range(5, 1005))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_of_wide_rows_written_out(spark, tmp_path, adaptive):
    """Every row arrives with an id of its own, whatever the ranges are when they are computed again."""
    changed = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m"}
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.repeat(F.lit("x"), 256).alias("wide"))
        store.with_ids(df, ["k"], 5).write.parquet(f"{tmp_path}/ids")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.parquet(f"{tmp_path}/ids")
    seen = out.agg(F.count("wide").alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    assert tuple(seen) == (200_000, 200_000, 5, 200_004)
    assert [r["k"] for r in out.orderBy("id").limit(100).collect()] == [r["k"] for r in df.orderBy("k").limit(100).collect()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_indel_ratio():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in "xy")
        total = len(a) + len(b)
        want = 100.0 if not total else 200.0 * lcs(a, b) / total
        assert match.indel_ratio(a, b) == pytest.approx(want)
        assert match.indel_ratio(a, b) == match.indel_ratio(b, a)
    title = "abcdefghijklmnopqrstuvwxyzabcdefghijklmn"
    assert match.indel_ratio(title, "X" + title[1:]) == 97.5
    assert match.indel_ratio(title, "XY" + title[2:]) == 95.0


def test_fuzzy_matching_equals_brute_force(spark):
    rng = random.Random(2)
    letters = "abcdef "
    names = ["".join(rng.choice(letters) for _ in range(30)).strip() or "x" for _ in range(60)]

    def edit(s):
        i = rng.randrange(len(s))
        return s[:i] + s[i + 1 :] if rng.random() < 0.5 else s

    references = [(f"p{i % 5}", f"c{i}", n, i) for i, n in enumerate(names)]
    bib = [(100 + i, f"p{i % 5}", None, edit(n)) for i, n in enumerate(names)] + [(500, "p0", None, None), (501, "p0", "known", names[0])]
    got = match.match_references(
        spark.createDataFrame(references, "citing_arxiv_id string, cited_arxiv_id string, cited_paper_name string, at int"), spark.createDataFrame(bib, "id int, citing_arxiv_id string, cited_arxiv_id string, bib_title string")
    )
    norm = lambda s: " ".join((s or "").lower().split())
    titles = {}
    for i, p, cited, t in bib:
        if cited is None and norm(t):
            titles[p, norm(t)] = max(i, titles.get((p, norm(t)), 0))
    want = {}
    for p, c, n, _ in references:
        best = max(((match.indel_ratio(norm(n), t), -i) for (q, t), i in titles.items() if q == p), default=(0, 0))
        if best[0] >= 95:
            want[-best[1]] = c
    assert {r["id"]: r["cited_arxiv_id"] for r in got.collect()} == want


def test_assembly_and_adjacency(spark):
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(["inter-", "national", "", "x", " ", "y"])], "paper string, at int, line string")
    assert [r["content"] for r in link.assemble(lines, "paper", "at", "line").orderBy("at").collect()] == ["international", "x", "y"]
    chunks = spark.createDataFrame([("p", "s", 0, "a"), ("p", "s", 1, "b"), ("p", "t", 2, "c")], "paper_id string, section string, at int, chunk_id string")
    assert rows(link.adjacent_edges(chunks)) == [("a", "b", "adjacent_chunk_edge"), ("b", "a", "adjacent_chunk_edge")]
    numbers = spark.createDataFrame([("p", "s", n) for n in (7, 8, 10)], "paper_arxiv_id string, paper_section string, number int")
    assert sorted(r["paragraph_id"] for r in link.paragraph_ordinals(numbers).collect()) == [0, 1, 3]


def test_expansion_cap_and_cycles(spark):
    seeds = spark.createDataFrame([("a",)], "paper string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "d"), ("c", "e"), ("a", None)], "citing string, cited string")
    assert rows(graph.expand(seeds, edges, 5).select("paper", "hop")) == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 3)]
    capped = {r["paper"]: r["endpoint"] for r in graph.expand(seeds, edges, 5, cap=2).collect()}
    assert capped == {"a": False, "b": False, "d": True}


TEX = r"""\documentclass{a}
\title{My {\em nice} title}\author{A. B}
\begin{document}
\begin{abstract}Some \emph{x} text\end{abstract}
\section{One {two}} % comment \section{no}
First \cite{k1, k2}. Second \citep{k1} here.

\begin{figure}\begin{subfigure}\includegraphics{a.pdf}\caption{A}\label{fig:a}\end{subfigure}\caption{Whole}\label{fig:w}\end{figure}

Third 50\% part.
\appendix
\section*{Extra}
Last.
\end{document}
"""


def test_latex(spark):
    tex = spark.createDataFrame([("p", TEX)], "paper_id string, tex string")
    parts = latex.sections(tex)
    assert rows(parts.select("section_in_paper_id", "title", "appendix")) == [(1, "One {two}", False), (2, "Extra", True)]
    cited = {r["bib_key"]: r for r in latex.citations(parts).collect()}
    assert cited["k1"]["importance_score"] == 1.5 and cited["k2"]["importance_score"] == 0.5
    assert [c["prev_context"] for c in cited["k1"]["context"]] == ["First", "Second"]
    figure = latex.figures(tex).first()
    assert (figure["caption"], figure["label"], figure["figure_paths"]) == ("Whole", "fig:w", [])
    assert [(s["label"], s["figure_paths"]) for s in figure["subfigures"]] == [("fig:a", ["a.pdf"])]
    contents = [r["content"] for r in latex.chunks(parts).orderBy("at").collect()]
    assert contents == [r"First \cite{k1, k2}. Second \citep{k1} here.", r"Third 50\% part.", "Last."]
    assert latex.abstracts(tex).first()["abstract"] == "Some  text"


def test_figure_tree_order(spark):
    leaf = "struct<original: string, caption: string, label: string, figure_paths: array<string>>"
    mid = f"struct<original: string, caption: string, label: string, figure_paths: array<string>, subfigures: array<{leaf}>>"
    top = f"struct<original: string, caption: string, label: string, figure_paths: array<string>, subfigures: array<{mid}>>"
    tree = ("o", "top", None, [], [("o", "one", None, ["1.pdf"], [("o", "deep", None, ["d.pdf"])]), ("o", "two", None, ["2.pdf"], None)])
    df = spark.createDataFrame([("p", [tree])], f"paper_arxiv_id string, figure array<{top}>")
    assert [(r["caption"], r["path"]) for r in latex.document_figures(df).orderBy("at").collect()] == [("top", None), ("one", "1.pdf"), ("deep", "d.pdf"), ("two", "2.pdf")]


def test_bibliographies(spark):
    bbl = "\\begin{thebibliography}{9}\n\\bibitem[x]{k1} A. One \\newblock A title \\newblock 2020\n\\bibitem{k2} B. Two 'Other title' x\n\\end{thebibliography}"
    got = {r["bib_key"]: (r["authors"], r["title"]) for r in latex.bbl_entries(spark.createDataFrame([("p", bbl)], "paper_id string, bbl string")).collect()}
    assert got == {"k1": ("A. One", "A title"), "k2": ("B. Two", "Other title")}


def test_lenient_json(spark):
    given = ['{"a": 1}', "{'a': None, 'b': True}", "free text", "  ", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").select("i", notes.lenient_json("x").alias("j"))
    got = [r["j"] for r in df.orderBy("i").collect()]
    assert got[0] == '{"a": 1}' and got[1].replace(" ", "") == '{"a":null,"b":true}' and got[2] == '{"_raw":"free text"}' and got[3:] == ["{}", "{}"]


def test_hunks(spark):
    old = "\n".join(f"line {i}" for i in range(20))
    new = old.replace("line 5", "line five").replace("line 15\n", "")
    pairs = spark.createDataFrame([(1, old, new), (2, old, old)], "pair int, old string, new string")
    got = [tuple(r) for r in revisions.hunks(pairs).orderBy("hunk").collect()]
    assert got == [(1, 1, "line 2 line 3 line 4", "line 6 line 7 line 8", "line 5", "line five"), (1, 2, "line 12 line 13 line 14", "line 16 line 17 line 18", "line 15", "")]
    paragraphs = spark.createDataFrame([(1, i, "s", x) for i, x in enumerate(new.split("\n"))], "pair int, paragraph_idx int, section string, content string")
    where = {r["hunk"]: r["paragraph_idx"] for r in revisions.located(revisions.hunks(pairs), paragraphs).collect()}
    assert where == {1: 5, 2: None}


def test_hunks_are_those_of_a_unified_diff(spark):
    """Where each line occurs once and none moves, so that only one alignment is longest; the expected hunks are read from the diff's own text."""
    import difflib

    rng = random.Random(4)
    pairs = [(0, None, "a"), (1, "", ""), (2, "a\nb", None)]
    for i in range(3, 60):
        old = [rng.choice(["x", " y ", "-z", "+w", "@"]) + str(k) for k in range(rng.randrange(40))]
        new = [rng.choice([line, line, line, line, f"new {k}"]) for k, line in enumerate(old) if rng.random() < 0.95]
        pairs.append((i, "\n".join(old), "\n".join(new)))
    want = []
    for i, old, new in pairs:
        n = 0
        for line in list(difflib.unified_diff((old or "").splitlines(), (new or "").splitlines(), lineterm=""))[2:]:
            if line.startswith("@@"):
                n += 1
                want.append([i, n, [], [], [], []])
                continue
            row, text = want[-1], line[1:].strip()
            place = 4 if line[0] == "-" else 5 if line[0] == "+" else 3 if row[4] or row[5] else 2
            row[place].append(text)
    want = [(i, n, *(" ".join(filter(None, part)) for part in parts)) for i, n, *parts in want]
    assert rows(revisions.hunks(spark.createDataFrame(pairs, "pair int, old string, new string"))) == sorted(want, key=str)


def longest(a, b):
    """Length of a longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("cells", [1 << 26, 40])
def test_alignments_are_longest(monkeypatch, cells):
    """Moved blocks, repeated lines and few different ones, to 300 lines; with tables that are halved too."""
    monkeypatch.setattr(revisions, "CELLS", cells)
    rng = random.Random(cells)
    for k in range(60):
        old = [rng.randrange(rng.choice([2, 20, 300])) for _ in range(rng.choice([0, 1, 5, 40, 300]))]
        cut = rng.randrange(len(old) + 1)
        new = old[cut:] + old[:cut] if k % 3 == 0 else [rng.choice([x, x, x, 7]) for x in old if rng.random() < 0.9] + old[:3] if k % 3 == 1 else [rng.randrange(20) for _ in range(rng.randrange(300))]
        pairs = revisions.common_lines(old, new)
        assert all(old[x] == new[y] for x, y in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) == longest(old, new)


def test_places_of_hunks_by_comparing_all(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    diffs, paragraphs = [], []
    for pair in range(6):
        texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8]))) for _ in range(rng.randrange(1, 12))]
        paragraphs += [(pair, i, f"s{i // 3}", t) for i, t in enumerate(texts)]
        for hunk in range(8):
            piece = lambda: rng.choice(texts)[rng.randrange(3) :][: rng.choice([3, 9, 10, 30])] + rng.choice(["", " more"])  # noqa: B023, E731
            diffs.append((pair, hunk, piece(), rng.choice([piece(), ""]), "o", rng.choice([piece(), ""])))
    got = {tuple(r)[:2]: tuple(r)[6:] for r in revisions.located(
        spark.createDataFrame(diffs, "pair int, hunk int, context_before string, context_after string, original_lines string, modified_lines string"),
        spark.createDataFrame(paragraphs, "pair int, paragraph_idx int, section string, content string")).collect()}
    assert len(got) == len(diffs)
    for pair, hunk, before, after, _, modified in diffs:
        own = [(i, s, t) for p, i, s, t in paragraphs if p == pair]
        best = None
        for k, (i, s, t) in enumerate(own):
            if not modified or modified[:10] not in t:
                continue
            place = lambda c, o: (s, i) if c[:10] in t else (own[o][1], own[o][0]) if 0 <= o < len(own) and c[:10] in own[o][2] else (None, None)  # noqa: B023, E731
            b, a = place(before, k - 1), place(after, k + 1)
            key = (-(b[1] is not None) - (a[1] is not None), i)
            if best is None or key < best[0]:
                best = (key, (s, i, *b, *a))
        assert got[pair, hunk] == (best[1] if best else (None,) * 6), (pair, hunk)


def test_pdf_text(spark):
    text = "Title here\n\nHeader\n\nAbstract\n\nWe study.\n\n1 Introduction\n\nA sentence that is\nlong\n\nand goes on.\n\n• a list\n\n3 4 + 5 = 9\n\nFigure 1: x\n\nNext one.\n\nReferences\n\n[1] Y"
    got = [(r["section"], r["content"]) for r in pdftext.paragraphs(spark.createDataFrame([("p", text)], "paper_openreview_id string, text string")).orderBy("paragraph_idx").collect()]
    assert got == [("Abstract", "We study."), ("1 Introduction", "A sentence that islong and goes on. • a list Next one."), ("1 Introduction", "Figure 1: x")]


def test_chunks_resolve_without_broadcasts_of_their_names(spark):
    """Rows of names are many times their file, so that its size must not send them to the driver."""
    rows = spark.range(20000).select(F.lit("p").alias("paper_id"), F.col("id").alias("chunk_id"), F.lit(r"\cite{a, b, a} \ref{x} \ref{y} \ref{x}").alias("content"))
    citations = spark.createDataFrame([("p", "a", "A"), ("p", "a", "A"), ("q", "b", "B")], "paper_id string, key string, target string")
    labels = spark.createDataFrame([("p", "x", "X"), ("p", "y", "Y")], "paper_id string, label string, target string")
    found = link.resolved_chunks(rows, citations, labels)
    assert "Inner, Build" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.select(*map(F.to_json, ["cites", "refs", "ref_labels"]), "isolation").groupBy(*range(1, 5)).count().collect()] == [('["A"]', '["X","Y"]', '["x","y"]', False, 20000)]


def test_near_titles_equal_brute_force(spark):
    """One edit anywhere, in short titles and in the middle of long ones."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9)))
    titles = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 6, 12, 60]))) for _ in range(150)]
    def edited(t):
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + rng.choice(["", "z", "q"]) + t[i + rng.randrange(2) :]
        return t
    left, right = list(enumerate(titles)), [(1000 + i, edited(t)) for i, t in enumerate(titles)]
    got = {r["left_id"]: (r["right_id"], r["score"]) for r in match.near_titles(*(spark.createDataFrame(x, "id int, title string") for x in (left, right))).collect()}
    want = {}
    for i, a in left:
        scores = [(-match.indel_ratio(" ".join(a.split()), " ".join(b.split())), j) for j, b in right if b.strip()]
        best = min(scores)
        if -best[0] >= 97:
            want[i] = (best[1], -best[0])
    assert got == want and len(want) > 50


def test_near_titles_of_any_number_of_edits(spark):
    """Several partners a title, of none to many edits, with ties: of all, the best one, and the least id."""
    rng = random.Random(11)

    def edited(t, n):
        for _ in range(n):
            i = rng.randrange(len(t) + 1)
            t = t[:i] + t[i + 1 :] if rng.random() < 0.5 else t[:i] + rng.choice("abxé") + t[i:]
        return t

    titles = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in [1, 2, 3, 5, 15, 16, 17, 18, 32, 33, 34, 35] * 3 + [60, 90, 150, 200, 280, 400] * 6] + ["ab" * 40, "a" * 50]
    left = list(enumerate(titles))
    right = [(i + 100 * k, edited(t, n)) for i, t in left for k, n in enumerate(rng.choice([[0, 1], [1, 2, 2], [2, 3, 2], [3, 4, 4], [5, 6], [7, 9, 8], [12]]))]
    rng.shuffle(right)
    got = {r["left_id"]: (r["right_id"], r["score"]) for r in match.near_titles(*(spark.createDataFrame(x, "id int, title string") for x in (left, right))).collect()}
    want, edits = {}, set()
    for i, a in left:
        best, j = min((-match.indel_ratio(a, b), j) for j, b in right if b)
        if -best >= 97:
            want[i] = (j, -best)
            edits.add(round((1 + best / 100) * (len(a) + len(dict(right)[j]))))
    assert got == want and edits >= {0, 1, 2, 3} and max(edits) > match.FEW + 1


def test_near_titles_of_few_edits_meet_by_few_grams(spark, monkeypatch):
    """A title's grams follow from the edits of its partner, not from those that its length allows."""
    kept, whole = [], match.checkpoint
    monkeypatch.setattr(match, "checkpoint", lambda df: kept.append(whole(df)) or kept[-1])
    rng = random.Random(5)
    titles = ["".join(rng.choice("abcdefgh") for _ in range(800)) for _ in range(30)]
    left, right = list(enumerate(titles)), [(i, t[:6] + t[7 + i % 3 :]) for i, t in enumerate(titles)]
    got = match.near_titles(*(spark.createDataFrame(x, "id int, title string") for x in (left, right)))
    assert {r["left_id"]: r["right_id"] for r in got.collect()} == {i: i for i, _ in left}
    assert sum(df.count() for df in kept) < 30 * 2 * (5 * match.FEW + 1)  # one edit: none


def test_figure_trees_of_any_depth(spark):
    def tree(depth):
        return {"caption": f"c{depth}", "label": None, "figure_paths": [f"{depth}.pdf"], "subfigures": [tree(depth - 1), {"caption": "leaf", "figure_paths": [], "subfigures": None}] if depth > 1 else []}

    rows_ = [(str(d), json.dumps([tree(d), tree(1)])) for d in (1, 2, 5, 50, 200)] + [("none", None), ("empty", "[]")]
    df = spark.createDataFrame(rows_, "paper_arxiv_id string, text string").select("paper_arxiv_id", F.parse_json("text").alias("figure"))
    got = {}
    for r in latex.document_figures(df).orderBy("at").collect():
        got.setdefault(r["paper_arxiv_id"], []).append((r["caption"], r["path"]))
    assert got == {str(d): [(f"c{k}", f"{k}.pdf") for k in range(d, 0, -1)] + [("leaf", None)] * (d - 1) + [("c1", "1.pdf")] for d in (1, 2, 5, 50, 200)}


def spliced(files, name, inside=()):
    """Plain inclusion: comments gone, files in their place, none in itself."""
    text = re.sub(r"(?m)(?<!\\)%.*$", "", files.get(name, ""))
    if name in inside or name not in files:
        return ""
    return re.sub(r"\\(?:input|include)\{([^}]*)\}", lambda m: spliced(files, m[1].strip().removesuffix(".tex"), (*inside, name)), text)


def test_inclusions_chain_meet_and_turn_back(spark):
    rng = random.Random(8)
    papers = {
        "chain": {"main": "\\begin{document}a\\input{b}z", "b": "b\\input{c.tex}y", "c": "c\\include{d}x", "d": "d"},
        "diamond": {"main": "\\begin{document}\\input{l}-\\input{r}", "l": "l\\input{s}", "r": "\\input{s}r\\input{s}", "s": "s"},
        "cycle": {"main": "\\begin{document}\\input{a}|\\input{main}", "a": "a\\input{b}", "b": "b\\input{a}\\input{main}\\input{none}."},
        "comment": {"main": "\\begin{document}% \\input{a}\n\\%\\input{a}", "a": "yes"},
        "alone": {"main": "\\begin{document}"}, "no main": {"a": "x"},
    }
    for i in range(12):
        names = ["main", *"abcdef"]
        papers[f"r{i}"] = {n: ("\\begin{document}" if n == "main" else "") + "".join(rng.choice([n, "\n", " ", f"\\input{{{rng.choice('abcdefg')}}}", "% x\n"]) for _ in range(rng.randrange(4))) for n in names}
    files = [(p, f"{n}.tex", t) for p, parts in papers.items() for n, t in parts.items()]
    got = {r["paper_id"]: r["tex"] for r in latex.with_inputs(spark.createDataFrame(files, "paper_id string, file string, content string")).collect()}
    assert got == {p: spliced(parts, "main") for p, parts in papers.items() if "main" in parts}


def test_python_literals(spark):
    given = [
        "{'a': 'None of it is True', 'b': \"it's\"}", "{'a': (1, 2), 'b': {1, 2, 1}, 3: [None, True, -.5]}", "['x', 'y']", "{'a': b'x', 'b': r'\\d' 'z', 'c': '\\u00e9\\x41\\n'}", "{'a': {'b': {'c': [[[{}]]]}}}", "{'open': [1, 2}", "{'a': 1+2j}",
        '[1, {"a": null}]', "5", "it's free", "{'a': 0x1f, 'b': 1_000, 'c': 'x' # note\n}",
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string").select("i", notes.lenient_json("x").alias("j"))
    got = [json.loads(r["j"]) for r in df.orderBy("i").collect()]
    assert got == [
        {"a": "None of it is True", "b": "it's"}, {"a": [1, 2], "b": [1, 2], "3": [None, True, -0.5]}, {"_value": ["x", "y"]}, {"a": "x", "b": "\\dz", "c": "éA\n"}, {"a": {"b": {"c": [[[{}]]]}}}, {"_raw": "{'open': [1, 2}"},
        {"_raw": "{'a': 1+2j}"}, [1, {"a": None}], 5, {"_raw": "it's free"}, {"a": 31, "b": 1000, "c": "x"},
    ]


def test_literals_as_python_reads_them():
    def made(rng, depth=0):
        kind = rng.randrange(10 if depth < 5 else 6)
        if kind < 3:
            text = "".join(rng.choice(["a", "None", "True ", "it's", '"', "\\", "\n", "é", "{", "]", ",", "\U0001f600", "\\n"]) for _ in range(rng.randrange(5)))
            return rng.choice([repr(text), json.dumps(text), "'''" + text.replace("\\", "\\\\").replace("'", "\\'") + "'''", "r'x\\d' 'y'", "'\\N{BULLET}\\x41\\101\\q'"])
        if kind < 6:
            return rng.choice(["None", "True", "False", "1", "-2", "+3", "0x1F", "1_000", "1.5", "-.5", "2.", "1e5", "00", "123456789012345678901234567890", "()", "[]", "{}"])
        items, tail = [made(rng, depth + 1) for _ in range(rng.randrange(1, 4))], rng.choice(["", ",", "\n , "])
        if kind == 6:
            return "[" + ", ".join(items) + tail + "]"
        if kind == 7:
            return "(" + ", ".join(items) + tail + ")"
        return "{" + ", ".join(f"{rng.choice([repr('k' + str(i)), str(i), 'None', 'True', '(7)'])} : {x}" for i, x in enumerate(items)) + tail + "}"

    def plain(v):
        if isinstance(v, dict):
            return {k if isinstance(k, str) else json.dumps(k): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list | tuple) else v

    for seed in range(3000):
        rng = random.Random(seed)
        text = made(rng)
        if seed % 3 == 0:  # broken ones
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", "'", ":", "(", "]", "x", "0"]) + text[at + 1 :]
        try:
            want = ast.literal_eval(text.strip())
        except Exception:
            assert to_json(text) is None, text
            continue
        got = to_json(text)
        try:
            expected = plain(want if isinstance(want, dict) else {"_value": want})
            json.dumps(expected)
        except TypeError:  # JSON has no sets, and a broken text may turn out to be one
            continue
        assert got is not None and json.loads(got) == expected, text


def test_marks_bound_the_indel_distance():
    """No more bits differ than characters are put in or taken out, in any script; lengths are of characters."""
    import random

    import pyarrow as pa

    draw, letters = random.Random(5), "abcdefghij 09é漢ß\U0001f600"
    words = ["", "a" * 40, *("".join(draw.choices(letters, k=draw.randrange(40))) for _ in range(60))]
    words += [w[:k] + x + w[k + 1 :] for w in words for k, x in [(3, ""), (5, "a"), (0, "éé")]]
    found = match._marks(pa.array(["cut off", *words, None])[1:]).to_pylist()
    assert [f["length"] for f in found] == [*map(len, words), 0]
    for a, x in zip(words[:70], found, strict=False):
        for b, y in zip(words, found, strict=False):
            flipped = sum(((x[p] ^ y[p]) & (1 << 64) - 1).bit_count() for p in ("low", "high"))
            assert flipped <= len(a) + len(b) - 2 * match._lcs(a, b)


def test_references_meet_by_marks_after_one_move(spark):
    """Pairs cost no edit distance, the marks are computed once a title, and each side moves once before the pairs are made."""
    known = spark.createDataFrame([("p", "c", "A title of some length", 1)], "citing_arxiv_id string, cited_arxiv_id string, cited_paper_name string, at long")
    rows = spark.createDataFrame([(1, "p", None, "a  Title of some lengths"), (2, "p", None, " \t"), (3, "p", None, None)], "id long, citing_arxiv_id string, cited_arxiv_id string, bib_title string")
    found = match.match_references(known, rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and plan.count("_marks_all(") == 2 and plan.count("hashpartitioning(citing_arxiv_id#") - plan.count("at#") <= 2
    assert [(r["id"], r["cited_arxiv_id"]) for r in found.collect()] == [(1, "c")]


def test_bib_titles_meet_by_marks(spark):
    """The other way round, too, pairs cost no edit distance."""
    mentions = spark.createDataFrame([("p", "", "a  Title of some lengths"), ("p", "", "A title of some lengths"), ("p", "", None)], "citing_arxiv_id string, cited_arxiv_id string, bib_title string")
    known = spark.createDataFrame([("p", "c", "A title of some length", 1), ("p", "d", "Another", 2)], "citing_arxiv_id string, cited_arxiv_id string, cited_paper_name string, at long")
    found = match.match_bib_titles(mentions, known)
    assert "levenshtein" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["title"], r["cited_arxiv_id"]) for r in found.collect()] == [("a title of some lengths", "c")]
