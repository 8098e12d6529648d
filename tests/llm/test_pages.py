"""Main text of pages: ordinary layouts, HTML's rules for tags, broken markup, and the style tree against a plain computation."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest
import xxhash

from paperloom.llm import html_tree
from paperloom.llm.html_page import Page, child_node, main_text, name_evidence, style_rows

KIND = "page_id int, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x = "</p>";</script></head><body class="page"><header><h1>Site</h1></header>
<nav><a href="/x">Menu</a></nav><div class="cookie-notice">We use cookies</div><div id="wrap7"><article class="post review"><h1>Title &amp; more</h1><p>First <b>bold</b>
 text&nbsp;here.<p>Second<br>line<div class="ad-slot">Buy</div><ul><li>one<li>two</ul><form><input value="v">Search</form><aside>Side</aside>
<div class="comments"><p>Nice!</p></div></article></div><div class="x9">Same on all pages</div><footer>&copy; x</footer></body></html>"""


def only(text):
    return main_text(Page(text))


def extracted(spark, rows, kind=KIND):
    return {r["page_id"]: r["text"] for r in html_tree.extract(spark.createDataFrame(rows, kind)).collect()}


def test_pages(spark):
    want = "Title & more\nFirst bold text here.\nSecond line\none\ntwo"
    rows = [(1, "http://a.b/c", PAGE), (2, None, None), (3, "bad url", ""), (4, "http://a.b/d", "plain text &lt;b&gt;"), (1, "http://a.b/c", PAGE)]
    df = spark.createDataFrame([(*r, "h", [1], 2, "k") for r in rows], KIND + ", host string, low array<int>, salt int, node string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_tree.extract(df).collect()}
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain text <b>", 14)}
    assert html_tree.extract(df).count() == 5 and html_tree.extract(df.limit(0)).count() == 0


BODY = "<h1>Title</h1><p>First part of the article, of some length.</p><p>Second part, with <a href=x>a link</a>.</p>"
WANT = "Title\nFirst part of the article, of some length.\nSecond part, with a link."


@pytest.mark.parametrize(
    "names",
    ["page has-sidebar", "content with-sidebar", "single-post with-comments", "col-main no-sidebar", "layout-form", "article-follow-up", "review-body", "header-content", "long-form-text", "elementor-widget"]
    + ["post menu-open", "node promo-off teaser-view-full", "site-content ad-free", "l-main js-comments-on", "sidebar", "widget", "entry footer-fixed-page"],
)
def test_wrappers_of_any_name_keep_the_article(names):
    assert only(f'<body><nav><a href=a>A</a><a href=b>B</a></nav><div class="{names}">{BODY}</div><footer>Imprint</footer></body>') == WANT
    assert only(f'<body><div class="{names}"><article>{BODY}</article></div><div class="site-footer">Imprint</div></body>') == WANT
    assert only(f'<body><div class="{names}"><div class="text">{BODY}</div><div class="sidebar">Other things</div><ul class="share-buttons"><li>Share</ul></div></body>') == WANT


def test_ids_of_headings_and_sections_are_titles():
    for name in ("search-algorithms", "rail-transport", "hidden-markov-models", "menu-design", "legal-notice-history", "comments", "social-history"):
        assert only(f'<article><h1>T</h1><h2 id="{name}">Head</h2><p>Text</p></article>') == "T\nHead\nText", name
    for name in ("related-work", "comments-on-the-theory", "social-history", "header-fields"):
        assert only(f'<article><h1>T</h1><section id="{name}"><p>Text</p></section></article>') == "T\nText", name
    assert only('<article><h1>T</h1><p>A text.</p></article><section id="comments"><p>Nice!</p></section>') == "T\nA text."
    assert only('<div class="header-content"><h1>Title</h1></div><div class="body"><p>Text of it</p></div>') == "Title\nText of it"


def test_what_names_say():
    for name in ("sidebar", "site-footer", "leftSidebar", "main-nav", "ad-slot", "ads_top", "comments-area", "related-posts", "widget-area", "cookie-banner", "newsletter-signup", "nav-links", "user-comments", "post-sidebar", "share-buttons", "search", "comment", "post-comment"):
        assert name_evidence(name) == 2, name
    for name in ("site-header", "notice", "legal", "follow", "toc"):
        assert name_evidence(name) == 1, name
    for name in ("has-sidebar", "no-footer", "with-comments", "is-menu", "entry-header", "article-header", "review-body", "long-form-text", "menu-design", "content", "main", "", "42"):
        assert name_evidence(name) == 0, name


#: Layouts as common site builders write them, in their own words, with short and long comments.
LAYOUTS = {
    "wordpress": """<body class="post-template-default single single-post postid-7 has-sidebar"><div id="page" class="hfeed site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">The Site</a></p></div><nav id="site-navigation" class="main-navigation"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/a">About</a></li></ul></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-7" class="post-7 post type-post status-publish format-standard hentry category-news">
<header class="entry-header"><h1 class="entry-title">Title</h1></header><div class="entry-content"><p>First part of the article, of some length.</p><p>Second part, with <a href=x>a link</a>.</p></div><footer class="entry-footer"><span class="cat-links">Posted in News</span></footer></article>
<nav class="navigation post-navigation"><div class="nav-links"><a href="/o">Older</a></div></nav><div id="comments" class="comments-area"><h2 class="comments-title">COMMENTS thoughts</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>COMMENT</p></article></li></ol>
<div id="respond" class="comment-respond"><form class="comment-form"><p>Your mail stays secret</p></form></div></div></main></div><aside id="secondary" class="widget-area"><section class="widget widget_search"><h2>Search</h2></section></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Powered</div></footer></div></body>""",
    "bootstrap": """<body><nav class="navbar navbar-expand-lg"><a class="navbar-brand" href="/">Brand</a><button class="navbar-toggler">Menu</button></nav><div class="container"><div class="row"><div class="col-lg-8"><h1 class="mt-4">Title</h1>
<p class="lead">First part of the article, of some length.</p><p>Second part, with <a href=x>a link</a>.</p><div class="card my-4 comments"><h5>Comments</h5><p>COMMENT</p></div></div><div class="col-md-4 sidebar"><div class="card"><p>Side words</p></div></div></div></div><footer class="py-5 bg-dark"><p>Copyright</p></footer></body>""",
    "classic": """<body><form id="aspnetForm" action="x"><table width="100%"><tr><td colspan=2 class="header"><a href=/>Logo</a></td></tr><tr><td class="leftmenu"><a href=a>A one</a><br><a href=b>B two</a><br><a href=c>C three</a></td>
<td class="body"><h1>Title</h1><p>First part of the article, of some length.<p>Second part, with <a href=x>a link</a>.</td></tr><tr><td colspan=2 id="footer">Imprint</td></tr></table></form></body>""",
    "news": """<body><div class="c-header-ad ad">Buy</div><header role="banner"><h2>Paper</h2><ul><li><a href=1>World</a><li><a href=2>Sport</a></ul></header><main><div class="consent-banner">We use cookies</div><article itemscope><h1>Title</h1><div class="article__body"><p>First part of the article, of some length.</p>
<div class="promo-box"><a href=z>Subscribe now</a></div><p>Second part, with <a href=x>a link</a>.</p></div></article><section class="related-articles"><article class="teaser"><h3>Other story</h3><p>Some words of it</p></article><article class="teaser"><h3>Third story</h3></article></section><section class="comments"><p>COMMENT</p></section></main><footer>Legal</footer></body>""",
    "documentation": """<body><div class="md-container"><aside class="md-sidebar md-sidebar--primary"><ul><li><a href=a>Setup</a><li><a href=b>Use</a></ul></aside><div class="md-content has-toc"><div class="toc"><a href=#a>First</a> <a href=#b>Second</a></div><h1 id="title">Title</h1><p>First part of the article, of some length.</p><p>Second part, with <a href=x>a link</a>.</p></div></div></body>""",
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("comment", ["Nice!", "A comment that is a good deal longer than the article that it speaks of. " * 3])
def test_layouts(layout, comment):
    assert only(LAYOUTS[layout].replace("COMMENT", comment)) == WANT


@pytest.mark.parametrize(
    "page",
    [
        "<div id=header><a href=/>Site</a></div><div role=main>{}</div><div id=footer>Foot text of the site</div>", "<div class=cookie-notice><p>" + "We use cookies to do things. " * 30 + "</p></div><div class=content>{}</div>",
        "<div id=content><div class=post>{}</div><div id=disqus_thread><p>" + "Comments of readers. " * 30 + "</p></div></div><div id=sidebar>Side</div>", "<article>{}<div class=comment>Nice one</div><ul class=comment-list><li>Two</ul></article>",
        "<div role=main><div class=toc><h2>Contents</h2><ul><li><a href=#a>The first one</a><li><a href=#b>The second one</a></ul></div>{}</div>", "<table><tr><td><table class=nav><tr><td>A<td>B</table><td>{}<td class=ads>Buy this</table>",
        "<a class=skip-link href=#c>Skip</a><div class=visually-hidden>Menu</div><div id=c>{}</div><div class=customer-reviews>Great</div>", "<article>{}<aside class=pullquote>Quoted</aside></article>", "<form id=all><div class=header>Logo</div><div class=main>{}</div><div class=footer>ft</div></form>",
        "<div id=page><main><article class='node node--full'>{}</article><section class=comments-wrapper><article class=comment><p>" + "Long comment. " * 50 + "</p></article></section></main><div class='column sidebar'>Side</div></div>",
    ],
)
def test_more_layouts(page):
    assert only("<body>" + page.replace("{}", BODY) + "</body>") == WANT


def test_menus_without_names_and_pages_without_articles():
    menu = "<div><a href=1>Home</a> <a href=2>World news</a> <a href=3>Sport</a> | <a href=4>All of it</a></div>"
    assert only(f"<body>{menu}<div>{BODY}</div>{menu}</body>") == WANT
    assert only("<body><nav><a href=a>A</a></nav><form>Log in</form><footer>Imprint</footer></body>") == ""
    assert only("<div>" + "words of the text " * 40 + "</div><article>Teaser</article>").endswith("Teaser")
    assert only("<div>words outside</div><article>The article is longer</article>") == "The article is longer"


def test_attributes_are_whole_names():
    for attribute in ("style='overflow:hidden'", 'title="hidden gems"', "data-role=search", "data-class=ad", "width=ad", "data-id='menu'"):
        assert only(f"<article><p {attribute}>Kept</p></article>") == "Kept", attribute
    for attribute in ("hidden", "HIDDEN=''", "aria-hidden = true", "role=search", "class=ad", "id='menu'", "x=1 class='cookie'"):
        assert only(f"<article><p>Kept</p><div {attribute}>Not</div></article>") == "Kept", attribute


def test_quotes_open_after_an_equals_sign():
    assert only('<p title="5" tall">one</p><p>two</p><p title="6" tall">three</p>') == "one\ntwo\nthree"
    assert only("<p title=it's>one</p><p>two</p><p title=it's>three</p>") == "one\ntwo\nthree"
    assert only("""<p a='>' b=">" c=>one</p><p/x>two</p><p "x" ' =>three</p>""") == "one\ntwo\nthree"
    assert only('<p>one</p><p title="never closed>two</p><p>three</p>') == "one\ntwo\nthree"
    assert only("<p>1 < 2 and <3</p><p>a</ >b</>c</p>") == "1 < 2 and <3\nabc"
    assert only("<p>one<!-- > -- <p>no --><!-->two<!---> three<!-- x --!> four<? x > five<!doctype x></p>") == "onetwo three four five"
    assert only("<p>one</p><p>two</p><div class='a") == "one\ntwo"
    assert only("<p>one</p><!-- never closed <p>two</p>") == "one"


def test_elements_end_where_html_ends_them():
    assert only("<p>Text</p><script>var a=1; function x(){return 2}") == "Text"
    assert only("<p>Text</p><script src='x'/>var a=1</script><p>More</p><style>p{}") == "Text\nMore"
    assert only("<div><svg/><p>Text</p></div><div><svg><path></div><p>More</p>") == "Text\nMore"
    assert only("<article><noscript><img><p>Text</article>") == ""
    assert only("<p>Text</p><title>never ended <p>x") == "Text"
    assert only("<p>a</p><script>'</scripted>'</script ><p>b") == "a\nb"
    assert only("<p>a<p>b<ul><li>c<ul><li>d</ul><li>e</ul><dl><dt>f<dd>g</dl>") == "a\nb\nc\nd\ne\nf\ng"
    assert only("<div class=ad>x<table><tr><td>y</div>z</td></tr></table>w</div><p>Kept</p>") == "Kept"
    assert only("<span><article><p>one</span> two</p></article></span>") == "one two"


@pytest.mark.parametrize("part", ["<div ", '<div class="a', '<a "', "<a b=\"x' ", "<a b='x\" ", "<!--", "<", "</", "<a =", '<p class="ad"><b>', "<svg><p>", "<script>", "<nav><div class=sidebar>x", "<li><a>x</i></span>", "<td></div>"])
def test_broken_markup_takes_time_in_proportion(part):
    took = []
    for size in (100_000, 800_000):
        text = part * (size // len(part))
        began = time.process_time()
        page = Page(text)
        main_text(page)
        style_rows(page)
        took.append(time.process_time() - began)
    assert took[1] < 16 * max(took[0], 0.05), part


def test_four_megabytes():
    for part in ("<div ", '<div class="a', "words of a text <b>x</b> "):
        began = time.process_time()
        main_text(Page(part * (4_000_000 // len(part))))
        assert time.process_time() - began < 40, part


def tree(rng, depth=0):
    """A random element: (tag, attributes as written, label, children), where a child is an element or a text."""
    tag = rng.choice(["div", "section", "span", "b"] if depth else ["body"])
    name = rng.choice(["", "", "x", "box y", "y box", "row12"])
    label = tag + ("." + ".".join(sorted(name.split())) if name else "")
    children = []
    for _ in range(rng.randrange(4) if depth < 4 else 0):
        children.append(rng.choice(["same words", f"words {rng.randrange(3)}"]) if rng.random() < 0.5 else tree(rng, depth + 1))
    return (tag, f" class='{name}'" if name else "", label, children)


def written(node):
    tag, attributes, _, children = node
    return f"<{tag}{attributes}>" + "".join(c if isinstance(c, str) else written(c) for c in children) + f"</{tag}>"


def plain_rows(node):
    """Of one page: path -> (sequence of child labels without direct repeats, texts below), by recursion."""
    shapes, contents = defaultdict(list), defaultdict(list)

    def walk(node, path):
        _, _, label, children = node
        path = (*path, label)
        below = []
        for child in children:
            if isinstance(child, str):
                below.append(child.strip())
            else:
                below.append(walk(child, path))
        contents[path].append(tuple(below))
        return tuple(below)

    def labels(node, path):
        path = (*path, node[2])
        for child in node[3]:
            if not isinstance(child, str):
                if not shapes[path] or shapes[path][-1] != child[2]:
                    shapes[path].append(child[2])
                labels(child, path)

    walk(node, ())
    labels(node, ())
    has_text = lambda t: any(isinstance(x, str) or has_text(x) for x in t)

    def clean(t):
        return tuple(x if isinstance(x, str) else clean(x) for x in t if isinstance(x, str) or has_text(x))

    return {path: (tuple(shapes[path]), tuple(c for c in map(clean, found) if c)) for path, found in contents.items()}


def numbered(path):
    node = 0
    for label in path:
        node = child_node(label, node)
    return node


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_style_tree_node_by_node(spark, seed):
    rng = random.Random(seed)
    hosts = {f"h{k}.example": [tree(rng) for _ in range(n)] for k, n in enumerate([1, 2, 5, 14])}
    rows, want = [], {}
    for host, pages in hosts.items():
        rows += [(i, f"http://{host}/{i}", written(p)) for i, p in enumerate(pages)] + [(99, f"http://{host}/copy", written(pages[0]))]
        found = defaultdict(lambda: (Counter(), Counter()))
        for p in {written(p): p for p in pages}.values():
            for path, (shape, content) in plain_rows(p).items():
                found[path][0][shape] += 1
                found[path][1][content] += 1
        for path, counts in found.items():
            n = sum(counts[0].values())
            share = lambda c: 1 - sum(x * math.log(x) for x in c.values()) / ((n + 1) * math.log(n + 1))  # noqa: B023, E731
            want[host, numbered(path)] = (n, 0.9 * share(counts[1]) + 0.1 * share(counts[0]))
    got = {(r["host"], r["node"]): (r["pages"], r["importance"]) for r in html_tree.importance(spark.createDataFrame(rows, KIND)).collect()}
    assert got.keys() == want.keys()
    for key, (n, value) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(value), key


def test_style_tree_drops_what_repeats_on_a_host(spark):
    page = lambda i: f"<body><div class='q1'>Repeated words of host</div><div class='q2'>Story number {i} is unlike others {i * 7}</div></body>"
    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(20)] + [(100 + i, f"http://h{i}.example/", page(i)) for i in range(3)]
    for limit in (html_tree.BROADCAST_BYTES, -1):  # broadcast and salted join
        html_tree.BROADCAST_BYTES, old = limit, html_tree.BROADCAST_BYTES
        got = extracted(spark, rows)
        html_tree.BROADCAST_BYTES = old
        assert got[3] == "Story number 3 is unlike others 21" and got[101].startswith("Repeated words of host\n")


def test_copies_of_a_page_count_once(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><div class='post-body'>Story {i} is unlike {i * 7}</div></article></body>"
    got = extracted(spark, [(i, f"http://one.example/{i}", page(max(0, i - 180))) for i in range(200)])
    assert got[3] == "Title 0\nStory 0 is unlike 0" and got[185] == "Title 5\nStory 5 is unlike 35"


def test_importance_decides_inside_articles(spark):
    """Unlabelled elements as well as labelled ones, and elements whose class is a generic word."""
    page = lambda i: f"<body><article><p>Story {i}</p><div class='warning'>Note {i}</div><blockquote>On all pages</blockquote><div class='notice'>On all</div></article></body>"
    got = extracted(spark, [(i, f"http://one.example/{i}", page(i)) for i in range(20)] + [(100, "http://other.example/", page(100))])
    assert got[3] == "Story 3\nNote 3" and got[100] == "Story 100\nNote 100\nOn all pages\nOn all"


@pytest.mark.parametrize("n", [1, 5, 6, 200])
def test_labelled_pages_of_hosts(spark, n):
    """Pages with their main texts on hosts of so many pages: what has no name and is the same on all pages of a host goes from six pages on."""
    rows, want = [], {}
    for k, (name, layout) in enumerate(LAYOUTS.items()):
        for i in range(n):
            page = layout.replace("COMMENT", f"Comment {i * 3}").replace("Title", f"Title {i}").replace("some length", f"some length {i}").replace("Second part", f"Second part {i}")
            text = WANT.replace("Title", f"Title {i}").replace("some length", f"some length {i}").replace("Second part", f"Second part {i}")
            inner = name in ("wordpress", "news")  # what lies outside an article of more text does not count
            rows.append((1000 * k + i, f"https://{name}.example/{i}", page.replace("</body>", "<div class=x1>On each page</div></body>")))
            want[1000 * k + i] = text + ("" if inner or n >= 6 else "\nOn each page")
    assert extracted(spark, rows) == want


def test_deep_pages_of_equal_hash_parts():
    page = Page("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>x</p>" * 3000)
    assert main_text(page).startswith("deep\nx") and len(style_rows(page)) == 3001
    assert xxhash.xxh64_intdigest("div", 0) >> 1 == child_node("div", 0)
