from hypothesis import given, settings
from hypothesis import strategies as st

from devicelens.llm import dom
from devicelens.llm import html_extract as X
from devicelens.llm.queries import QUERIES


def text_of(page):
    return X.main_text(page, X.read_wrapper(""), frozenset())


def test_blocks_entities_and_white_space():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><script>if (a < b) '</p>'</script></head><body><nav><a>Menu</a></nav>"
        "<header>Top</header><article class=post><h1>A &amp; B</h1><p>one\n  two <b>thr</b>ee<p>four&nbsp;five &lt;tag&gt; &#233;&#x41; &copy"
        "<ul><li>x<li>y</ul><div class='ad-box'>Buy</div><aside>side</aside><form>f<input></form><!-- no --><table><tr><td>c1<td>c2</table>"
        "<div id='comments'><p>first!</p></div></article><footer>&copy; us</footer></body></html>"
    )
    assert text_of(page) == "A & B\none two three\nfour five <tag> éA ©\nx\ny\nc1\nc2"


def test_pages_without_main_part_and_broken_ones():
    assert text_of("plain text") == "plain text"
    assert text_of("<div>a</div>b<div>c") == "a\nb\nc"
    assert text_of("<p>a < b and <3 <p>c</q></p></p>") == "a < b and <3\nc"
    assert text_of("<p>cut <a href='x") == "cut"
    assert text_of("<script>var x") == "" and text_of(None) == "" and text_of("   ") == ""
    assert text_of("<header>h</header><main><header>t</header>m</main>") == "t\nm"
    assert text_of("<p hidden>no</p><p>yes<br>line</p>") == "yes line"
    assert text_of("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def brute_match(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    table = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + brute_match(x, y))
    return 1 + table[-1][-1]


trees = st.recursive(
    st.sampled_from("abc"), lambda kids: st.tuples(st.sampled_from("abc"), st.lists(kids, max_size=4)), max_leaves=14
)


def build(tree):
    tag, kids = (tree, []) if isinstance(tree, str) else tree
    node = dom.Node(tag, tag, False)
    node.kids = node.children = [build(k) for k in kids]
    return node


def number(root):
    todo, n = [root], 0
    while todo:
        node = todo.pop()
        node.number = n
        n += 1
        todo.extend(reversed(node.kids))
    return root


@given(trees, trees)
@settings(max_examples=150, deadline=None)
def test_alignment_is_a_largest_match(one, two):
    a, b = number(build(("root", [one]))), number(build(("root", [two])))
    places = dom.align(a, b)
    assert len(places) == brute_match(a, b) == dom.matched(a, b, {}) + (0 if a.kids and b.kids else 0)
    assert sorted(places.values()) == [places[k] for k in sorted(places)] and len(set(places.values())) == len(places)


flat = st.lists(st.sampled_from("aab") | st.tuples(st.sampled_from("ab"), st.lists(st.sampled_from("ab"), max_size=3)), max_size=12)


@given(flat, flat)
@settings(max_examples=150, deadline=None)
def test_arrays_give_the_same_pairs(one, two):
    """The table of long lists and that of short ones put the same children on each other."""
    a, b = number(build(("root", one))), number(build(("root", two)))
    found, width = [], dom.ARRAY_WIDTH
    try:
        for dom.ARRAY_WIDTH in (0, 1000):
            found.append(dom.align(a, b))
    finally:
        dom.ARRAY_WIDTH = width
    assert found[0] == found[1] and len(found[0]) == brute_match(a, b)


def test_long_lists_are_matched_as_short_ones_are():
    """Texts and the length of a list do not choose what its elements are put on."""
    for n in (20, 64, 65, 130):
        a = dom.parse("".join(f"<p>{k}</p><div>{k}</div>" for k in range(n)))
        b = dom.parse("".join(f"<p>{n - k}</p><div>{n - k}</div>" for k in range(n)) + "<h1></h1>")
        dom.blocks(a), dom.blocks(b)
        assert dom.align(a, b) == {k: k for k in range(2 * n + 1)}
        c = dom.parse("".join(f"<p>{k}</p>" for k in range(n)) + "<h1>0</h1>")
        d = dom.parse("<h1>0</h1>" + "".join(f"<p>other {k}</p>" for k in range(n)))
        dom.blocks(c), dom.blocks(d)
        assert dom.align(c, d) == {0: 0, **{k: k + 1 for k in range(1, n + 1)}}


def page(i, body):
    return f"<html><body><div>Site name</div><div>Read our rules</div><div><p>{body}</p><p>more {i}</p></div></body></html>"


def test_constant_elements_are_template(spark):
    rows = [(i, f"http://h.org/{i}", page(i, f"story {i}"), 0) for i in range(12)]
    rows += [(50, "http://h.org/x", page(50, "Site name"), 0), (51, "http://h.org/y", None, 0), (52, "http://h.org/z", "", 0)]
    rows += [(60 + i, "http://few.org/", page(i, "same"), 0) for i in range(2)]
    rows += [(70, None, "<p>a</p>", 0), (None, "no host", "<p>b</p>", 0), (0, "http://h.org/0", page(0, "story 0"), 0)]
    rows += [(80 + i, "http://art.org/", f"<article><p>{i}</p><p>said every day</p></article>", 0) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, wrapper int")
    found = X.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r.text for r in found.collect()}
    assert found.count() == len(rows) and all(r.n_chars == len(r.text) for r in found.collect())
    assert [got[i] for i in range(12)] == [f"story {i}\nmore {i}" for i in range(12)]
    assert (got[50], got[51], got[52]) == ("Site name\nmore 50", "", "")
    assert got[60] == "Site name\nRead our rules\nsame\nmore 0"  # two pages are no evidence
    assert (got[70], got[None]) == ("a", "b")
    assert got[83] == "3\nsaid every day"
    assert X.extract(pages.limit(0)).collect() == []


def texts_of(spark, pages):
    rows = [(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)]
    found = X.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_slots_choose_on_article_pages(spark):
    def page(i, site):
        return f"<body><main><div>{site}</div><div>lead {i}</div><article><p>story {i}</p><p>as always</p></article></main><article class=card>more</article></body>"

    assert texts_of(spark, [page(i, "Site") for i in range(6)]) == [f"lead {i}\nstory {i}\nas always" for i in range(6)]
    assert texts_of(spark, [page(i, f"Site {i}") for i in range(6)])[3] == "Site 3\nlead 3\nstory 3\nas always"


def test_marks_are_whole_names_and_the_wrapper_may_overrule_words(spark):
    keep = (
        "<body class='single has-sidebar comments-open'><div id=content class=no-sidebar><article><h2 id=related-work>a</h2>"
        "<p id=search-methods style='overflow:hidden' data-id=menu>b <a href='/hidden-gems' title='hidden costs'>c</a> <em class=ad>d</em> e</p>"
        "<p aria-hidden=false>f</p></article></div><div class=ad>no</div><p>g <b hidden>no</b> h</p></body>"
    )
    assert text_of(keep) == "a\nb c d e\nf\ng h"
    assert text_of("<div class=menu><form><article>x</article></form></div><div class=menu>no</div>") == "x"

    def page(i):
        return f"<article><p>story {i}</p><section id=notice>note {i}</section><div class=related><a>link {i}</a></div><div class=share>Share</div></article>"

    assert texts_of(spark, [page(i) for i in range(6)])[4] == "story 4\nnote 4"


def test_every_layout_has_its_wrapper_and_lists_are_aligned_whole(spark):
    one = [f"<div class=a><p>story {i}</p></div><div>Menu</div>" for i in range(20)]
    two = [f"<div class=b><h1>t {i}</h1><p>text {i} goes on</p></div><div class=note>Our notice</div><p>Bye</p>" for i in range(3)]
    flat = ["<section>" + "".join(f"<p>{'always' if k in (100, 101) else f'{i} {k}'}</p>" for k in range(190 + i)) + "</section>" for i in range(4)]
    found = texts_of(spark, one + two + flat)
    assert found[:20] == [f"story {i}" for i in range(20)]
    assert found[20:23] == [f"t {i}\ntext {i} goes on" for i in range(3)]
    assert [f.split("\n") for f in found[23:]] == [[f"{i} {k}" for k in range(190 + i) if k not in (100, 101)] for i in range(4)]


def test_shuffled_wrappers_give_the_same(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    one = sorted(map(tuple, X.extract(pages).collect()))
    monkeypatch.setattr(X, "MAX_BROADCAST_BYTES", -1)
    assert sorted(map(tuple, X.extract(pages).collect())) == one


def test_op4_returns_the_articles(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op4_html_extraction"](spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(" ".join(x.split()) for x in parts if x.strip())


def test_very_deep_pages_align_with_very_deep_wrappers(spark):
    deep = "<div>" * 3000
    found = texts_of(spark, [f"{deep}<p>story {i}</p><p>Bye</p>" for i in range(4)])
    assert found == [f"story {i}" for i in range(4)]


def test_copies_of_an_article_are_no_template(spark):
    """One article that a host shows three times under another stamp."""
    body = "<h1>A title that says what follows</h1>" + "".join(f"<p>Paragraph {k} of the story.</p>" for k in range(9))
    pages = [f"<div class=story>{body}</div><div class=stamp>seen {i}</div>" for i in range(3)]
    found = texts_of(spark, pages)
    assert all(f.startswith("A title that says what follows\nParagraph 0") and "Paragraph 8 of the story." in f for f in found)
    short = "<div class=story><h1>Title</h1><p>Body</p></div><div class=stamp>{}</div>"
    assert texts_of(spark, [short.format(f"seen {i}") for i in range(3)]) == [f"Title\nBody\nseen {i}" for i in range(3)]


def test_compound_marks():
    keep = "<p>story</p>"
    for mark in ("user-comments", "commentlist", "google_ad", "cookie-bar-v2", "adunit", "navbar_container"):
        assert text_of(f"<div><section class='{mark}'>no</section>{keep}</div>") == "story", mark
    for name in ("additions", "header-story", "ad-hoc-report", "commentary", "menuetto", "searching"):
        assert text_of(f"<div class='{name}'><p>story</p></div>") == "story", name
    assert text_of("<form action=/page><div><p>a story of some length</p></div><input name=q></form>") == "a story of some length"
    assert text_of("<p>a story of some length</p><form><p>your name</p></form>") == "a story of some length"


def test_wrapper_alone_finds_articles_without_telling_marks(spark, monkeypatch):
    """No article, no nav, no telling class: constant elements can only be known from other pages."""

    def story(host, i):
        return [f"Story {i} of {host} begins.", *[f"It goes on for part {k} of {i}." for k in range(1 + i % 4)]]

    rows, want = [], {}
    for host in range(4):
        for i in range(15):
            said = story(host, i)
            inner = "".join(f"<p>{x}</p>" for x in said)
            site = f"<div class=x{host}><div>Site {host}</div><div>Home</div><div>About us</div></div>"
            tail = f"<div class=z>All rights reserved by {host}</div><div class=z>Write to us</div>"
            side = "<div class=s><div>Weather: fine</div><div>Most read</div></div>"
            body = (site + side + f"<div class=k>{inner}</div>" + tail, f"<div class=k>{inner}</div>" + side + site + tail)[host % 2]
            rows.append((len(rows), f"http://h{host}.org/{i}", f"<html><body>{body}</body></html>"))
            want[rows[-1][0]] = "\n".join(said)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in X.extract(pages).collect()} == want
    monkeypatch.setattr(X, "LEAST_PAGES", 1000)  # an empty template
    found = {r.page_id: r.text for r in X.extract(pages).collect()}
    assert not any(found[k] == want[k] for k in want)
