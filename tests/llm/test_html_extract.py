import html
import random
import re

from chronoframe.llm.entries import QUERIES
from chronoframe.llm.html_extract import TAG, TAG_LEAST, TAG_MOST, _region, extract_main_text, main_text, place_weights

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home menu-open">
<header class="site-header"><a href="/">Brand</a> slogan of the site</header>
<div id="cookie-notice">We use cookies. <button>OK</button></div>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<aside class="sidebar"><p>Side words that nobody asked for, many of them in a row.</p></aside>
<main><article><header><h1>The&nbsp;title &amp; more</h1></header>
<p>First   paragraph with <b>bold</b> and
a <a href="/x">link</a>.</p><script>var t="</p><p>no</p>";</script>
<div class="advert">Buy this now</div>
<form><label>Mail</label><input name="q"><p>Join our list</p></form>
<p>Second &lt;paragraph&gt;<br>after a break<p>Third, unclosed
<ul><li>an item of a list in the text<li>another item of it</ul>
<!-- <p>hidden</p> --><blockquote>Quoted words here.</blockquote>
<section id="comments"><h2>Comments</h2><p>A reader says a lot of things here, more than the text.</p></section>
</article></main><footer>&copy; All rights reserved to the site and others.</footer></body></html>"""


def test_page_with_everything():
    assert main_text(PAGE, {}) == "\n".join(
        ["The title & more", "First paragraph with bold and a link.", "Second <paragraph> after a break", "Third, unclosed", "an item of a list in the text", "another item of it", "Quoted words here."]
    )


TEXT = "Some words of the text that people came to read. " * 6
BODY = f"<h1>Title</h1><p>{TEXT}</p><div class='advert'>Buy this now</div><p>{TEXT}</p>"
WANT = "\n".join(["Title", TEXT.strip(), TEXT.strip()])
THREAD = "<ol class='comment-list'>" + f"<li class='comment'><article class='comment-body'><p>{'A reader talks at length here. ' * 9}</p></article></li>" * 3 + "</ol>"


def test_wrapped_pages():
    for name in ("page has-sidebar", "content-with-comments", "no-sidebar", "sidebar-right", "widget", "page with-share-bar"):
        for tag in ("div", "section", "main"):
            wrapper = f"<body><div class='nav'>Home</div><{tag} class='{name}' id='{name}'>", f"</{tag}><div class='footer'>All rights reserved</div></body>"
            assert main_text(BODY.join(wrapper), {}) == WANT, (tag, name)
            for inner in ("<article>", "<main>", "<div itemprop='articleBody'>", "<article class='post has-comments'>"):
                end = f"</{inner[1:].split()[0].rstrip('>')}>"
                page = f"{inner}{BODY}{end}{THREAD}".join(wrapper)
                assert main_text(page, {}) == WANT, (tag, name, inner)


LINKS = "".join(f"<li><a href='/{i}'>Link number {i} of the list</a></li>" for i in range(25))


def test_whole_main_elements(spark):
    """Lists of links, tables and short ends of a marked article stay, whatever their places score elsewhere."""
    inner = [f"<p>{TEXT}</p>", f"<ul>{LINKS}</ul>", "<table><tr><td>1</td><td>2</td></tr></table>", f"<p>{TEXT}</p>", "<p><a href='/x'>On</a></p>"]
    want = "\n".join([TEXT.strip(), *(f"Link number {i} of the list" for i in range(25)), "1", "2", TEXT.strip(), "On"])
    pages = [(i, "u", f"<nav><ul>{LINKS}</ul></nav><article><h1>t</h1><p>{TEXT}</p></article><ul>{LINKS}</ul>") for i in range(20)]
    learned = place_weights(spark.createDataFrame(pages, "page_id long, url string, html string"))
    for weights in ({}, learned):
        for name in ("article", "main", "div itemprop='articleBody'"):
            page = f"<body><ul>{LINKS}</ul><{name}>{''.join(inner)}<aside>{TEXT}</aside></{name.split()[0]}><footer>{TEXT}</footer></body>"
            assert main_text(page, weights) == want, (name, weights)
            assert main_text(f"<main><ul>{LINKS}</ul>{page}</main>", weights).endswith(want)
    teaser = "<article><h3>Other</h3><p>A teaser.</p></article>"
    assert main_text(f"<article><p>{TEXT}</p><article>A card</article><p>{TEXT}</p></article><ul>{LINKS}</ul>{teaser}", learned) == f"{TEXT.strip()}\nA card\n{TEXT.strip()}"


def test_marks_are_weights():
    assert main_text(f"<div id='comments'>{THREAD}</div>", {}).count("A reader") == 27
    assert main_text(f"<article>{BODY}</article><div id='comments'>{THREAD * 20}</div>", {}) == WANT
    assert main_text(f"<div class='top-bar'>Skip to text</div><div class='login'>{BODY}</div>", {}) == WANT
    assert main_text(f"<div class='site-wide widget'>{BODY}<p style='display:none'>{TEXT}</p><nav>{TEXT}</nav></div>", {}) == WANT
    assert main_text("<div class='ad'>" * 5000 + TEXT, {}) == TEXT.strip()


def test_quotes_open_values_only():
    for attribute in ("title=it's", "title='it' data-x=5\"", "it's", 'a="x>y"', "a = 'x > y' b", "data-class='sidebar'", "title=\"class='ad'\"", "class=a'b"):
        assert main_text(f"<article><p {attribute}>{TEXT}</p><p>{TEXT}</p></article>", {}) == "\n".join([TEXT.strip()] * 2), attribute
    assert main_text(f"<article><section class='related-work'><p>{TEXT}</p></section><p>{TEXT}</p></article>", {}) == "\n".join([TEXT.strip()] * 2)


def test_best_region_against_all_regions():
    """The linear scan against every contiguous region: blocks in one place, no marks."""
    rng = random.Random(7)
    for _ in range(300):
        found = [(" ".join("w" * rng.randint(1, 6)), rng.choice("abc"), False, 0, -1, rng.randint(1, 9)) for _ in range(rng.randint(1, 12))]
        weights = {k: rng.choice([-2.0, -0.5, 0.3, 1.0]) for k in "abc"} | {TAG: -0.3}
        worth = [len(b[0].split()) * weights[b[1]] for b in found]
        total = lambda i, j: sum(worth[i:j]) + weights[TAG] * sum(b[5] for b in found[i + 1 : j])
        best = max([0.0] + [total(i, j) for i in range(len(found)) for j in range(i + 1, len(found) + 1)])
        score, i, j = _region(found, weights, 0)
        assert abs(score - best) < 1e-9 and (best == 0 or abs(total(i, j) - best) < 1e-9)


def test_learned_weights(spark):
    pages = [(i, "u", f"<nav><a href='/'>home</a></nav><div>x</div><div>y</div><article><p>{TEXT}</p></article>") for i in range(30)]
    weights = place_weights(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert weights[">p"] == 3.0 and weights[">div"] < 0 and TAG_LEAST <= weights[TAG] <= TAG_MOST
    assert place_weights(spark.createDataFrame([], "page_id long, url string, html string")) == {}


def test_deep_and_unclosed_pages_take_linear_time():
    page = "<div>" * 60_000 + "</p>" * 60_000 + "<button>x" * 60_000 + TEXT
    assert main_text(page, {}).endswith(TEXT.strip())


def test_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "just words", "x"), (3, "u", "just words", "x"), (4, "u", "<p>open <b attr='", "x"), (5, "u", "<!-- never closed <p>x</p>", "x"), (6, "u", "<p>" + "w " * 200_000, "x")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    texts = sorted((r.page_id, r.text) for r in got)
    assert texts[:4] == [(1, ""), (2, ""), (3, "just words"), (3, "just words")]
    assert texts[4] == (4, "open") and texts[5] == (5, "") and len(texts[6][1]) == 399_999
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_main_text(empty).collect() == []


def test_articles_of_the_tables(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op3_html_text"](spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>|<br>", inner))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)
