"""Main text of pages: hand-labelled pages, the cut against enumeration, and malformed markup."""

import random
import time
from itertools import product

import pytest

from veilframe.llm import html_text
from veilframe.llm.common import table

LONG = "The river rose in the night, and by morning the lower fields, the road and the mill were under water."
MORE = "Nobody in the village could remember such a flood; the oldest of them, asked about it, shook their heads."
THIRD = "On the third day the rain stopped, the water fell, and people went back to see what was left of the harvest."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul>'

#: (name, page, the text that a reader would call the article)
GOLDEN = [
    ("web-forms site", f"<body><form id='aspnetForm' action='/'><div>{MENU}</div><div id='wrap'><h1>Flood</h1><p>{LONG}</p><p>{MORE}</p></div></form></body>", f"Flood {LONG} {MORE}"),
    ("blog classes", f"<div class='post type-post tag-politics category-news'><h2>Flood</h2><p>{LONG}</p><p>{MORE}</p></div><div class='widget'>Archive of 2019</div>", f"Flood {LONG} {MORE}"),
    ("share state", f"<main><div class='article-body share-enabled'><p>{LONG}</p><p>{MORE}</p></div></main>", f"{LONG} {MORE}"),
    ("entry header", f"<header><a href='/'>Site</a></header><div id='content'><header class='entry-header'><h1>Flood</h1></header><article><p>{LONG}</p></article></div>", f"Flood {LONG}"),
    ("short paragraph", f"<div><p>{LONG}</p><p>Why</p><p>{MORE}</p></div>", f"{LONG} Why {MORE}"),
    ("plain menu", f"<div>{MENU}</div><div><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG} {MORE}"),
    ("one long menu item", f"<div><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li><li>Here, you are.</li><li><a href='/b'>Blog</a></li><li><a href='/x'>Shop</a></li></ul></div><section><p>{LONG}</p><p>{MORE}</p></section>", f"{LONG} {MORE}"),
    ("linked paragraph", f"<div><p>{LONG}</p><p><a href='/r'>{THIRD}</a></p><p>{MORE}</p></div>", f"{LONG} {THIRD} {MORE}"),
    ("dates and names", f"<div><h1>Flood</h1><p>3 May</p><p>{LONG}</p><p>{MORE}</p><p>Ann Lee</p></div>", f"Flood 3 May {LONG} {MORE} Ann Lee"),
    ("headings", f"<div><h2>One</h2><p>{LONG}</p><h2>Two</h2><p>{MORE}</p><h3>Three</h3><p>{THIRD}</p></div>", f"One {LONG} Two {MORE} Three {THIRD}"),
    ("weak name on prose", f"<article><p>{LONG}</p><p class='alert'>{MORE} {THIRD}</p><p>{THIRD}</p></article>", f"{LONG} {MORE} {THIRD} {THIRD}"),
    ("advert inside", f"<article><p>{LONG}</p><div class='ad'>Buy a boat now, cheap.</div><p>{MORE}</p></article>", f"{LONG} {MORE}"),
    ("comments of readers", f"<article><p>{LONG}</p></article><section id='comments'><article class='comment'><p>{MORE} {THIRD}</p></article><article class='comment'><p>{THIRD} {MORE}</p></article></section>", LONG),
    ("sidebar", f"<div class='has-sidebar'><div class='main-content'><p>{LONG}</p></div><div class='sidebar'><h3>Related</h3><p>{MORE}</p></div></div>", LONG),
    ("cookie notice", f"<div id='cookie-notice'><p>We use cookies, as everybody does, to see who reads what here.</p></div><div class='story'><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG} {MORE}"),
    ("list in article", f"<article><p>{LONG}</p><ul><li>bread</li><li>milk</li></ul><p>{MORE}</p></article>", f"{LONG} bread milk {MORE}"),
    ("table", f"<article><p>{LONG}</p><table><tr><td>Level<td>4 m<tr><td>Rain<td>90 mm</table></article>", f"{LONG} Level 4 m Rain 90 mm"),
    ("formula and drawing", f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>4</mn></math></p><svg><text>4 m</text></svg><p hidden>{MORE}</p></article>", f"{LONG} x=4 4 m {MORE}"),
    ("deep link and paragraph", f"<div><p>{LONG}</p><p>{MORE}</p></div><div><a href='/x'><span><i><b><u><em>Read on, and on, and on.</em></u></b></i></span></a></div>", f"{LONG} {MORE}"),
    ("form controls and footer", f"<article><p>{LONG}</p><form><label>Mail</label><input><select><option>x</select><button>Send</button></form></article><footer>&copy; us</footer>", LONG),
    ("genesis wrap", f"<div class='content-sidebar-wrap'><main class='content'><p>{LONG}</p><p>{MORE}</p></main><aside>Popular</aside></div>", f"{LONG} {MORE}"),
    ("article in a form with a menu", f"<form><nav>{MENU}</nav><article><h1>Flood</h1><p>{LONG}</p></article></form>", f"Flood {LONG}"),
    ("menu with the page at hand", f"<div><ul><li><a href='/'>Home</a></li><li>Floods of the year</li><li><a href='/b'>Blog</a></li><li><a href='/x'>Shop</a></li></ul></div><div><p>{LONG}</p><p>{MORE}</p></div>", f"{LONG} {MORE}"),
    ("linked headings", f"<div><h2><a href='#1'>One</a></h2><p>{LONG}</p><h2><a href='#2'>Two</a></h2><p>{MORE}</p></div>", f"One {LONG} Two {MORE}"),
    ("linked name in the text", f"<div><p>{LONG}</p><p><a href='/a'>Ann Lee</a></p><p>{MORE}</p><p>{THIRD}</p></div>", f"{LONG} Ann Lee {MORE} {THIRD}"),
    ("one word", "x", "x"),
    ("plain text", "plain &lt;words&gt;, no cues.", "plain <words>, no cues."),
]


@pytest.mark.parametrize("name", [g[0] for g in GOLDEN])
def test_hand_labelled_pages(name):
    _, page, want = next(g for g in GOLDEN if g[0] == name)
    assert html_text.main_text(page, html_text.PRIOR) == want


def test_the_cut_beats_the_costs_alone(spark):
    rows = table(spark, "/root/testdata/sf0.001", "pages").collect()
    for weights in (html_text.PRIOR, html_text.fit(sorted(r.html for r in rows))):
        right = {"cut": 0, "costs": 0}
        changed = 0
        for _, page, want in GOLDEN:
            tree = html_text.tree_of(page)
            lean = html_text.leans(tree, weights)
            kept = html_text.minimum_cut(lean, html_text.smoothness(tree))
            changed += sum((x > 0) != k for x, k in zip(lean, kept, strict=True))
            for how, side in (("cut", kept), ("costs", [x > 0 for x in lean])):
                right[how] += " ".join(b.text for b, k in zip(tree.blocks, side, strict=True) if k) == want
        assert changed >= 5 and right["cut"] == len(GOLDEN) and right["costs"] <= len(GOLDEN) - 4


def cost_of(lean, edges, side):
    return sum(max(x, 0) if not s else max(-x, 0) for x, s in zip(lean, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])


def test_minimum_cut_matches_enumeration():
    rng = random.Random(12)
    for _ in range(60):
        n = rng.randint(1, 8)
        lean = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        best = min(cost_of(lean, edges, s) for s in product((False, True), repeat=n))
        assert cost_of(lean, edges, html_text.minimum_cut(lean, edges)) == pytest.approx(best)


def test_whole_pages_match_enumeration(spark):
    """The text of a page is that of the cheapest of all labellings of its blocks."""
    small = [r.html for r in table(spark, "/root/testdata/sf0.001", "pages").collect()]
    weights = html_text.fit(sorted(small))
    seen = 0
    for page in [g[1] for g in GOLDEN] + small:
        tree = html_text.tree_of(page)
        if len(tree.blocks) <= 13:
            lean, edges = html_text.leans(tree, weights), html_text.smoothness(tree)
            best = min(product((False, True), repeat=len(lean)), key=lambda s: cost_of(lean, edges, s))
            assert html_text.main_text(page, weights) == " ".join(b.text for b, k in zip(tree.blocks, best, strict=True) if k)
            seen += 1
    assert seen > 30


def test_registered_pages_give_their_articles(spark):
    """The pages of the tables hold one article element each, which is what has to be found."""
    rows = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in html_text.extracted(rows).collect()}
    for r in rows.collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert got[r.page_id] == " ".join(b.text for b in html_text.blocks_of(inside))


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div id="cookie-notice"><p>We use cookies.</p></div><header><h1>Site name</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="sidebar"><p>Related things to read, of any length whatsoever.</p></div><!-- <p>no</p> -->
<article><h1>The&nbsp;title &amp; more</h1><p>First <b>bold</b>ly said,
 and so on.<p>Second&#233; one.<br>After a break.<form><p>Your mail</p><input></form><div class="ad">Buy this now.</div></article>
<section id="comments"><p>A reader says that this was good, truly.</p></section><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    want = "The title & more First boldly said, and so on. Secondé one. After a break."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "v", PAGE), (1, "u", PAGE), (4, "w", "<p>plain &lt;words&gt;, no cues.</p>"), (5, "w", "<script>x")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(html_text.extracted(pages).collect(), key=lambda r: (r.page_id or 0, r.text))
    assert [(r.page_id, r.text) for r in got] == [(None, want), (1, want), (1, want), (2, ""), (3, ""), (4, "plain <words>, no cues."), (5, "")]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extracted(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "page,want",
    [
        ("a < b and c <3, d", "a < b and c <3, d"),
        ("x <!-- y > z --> w", "x w"),
        ("x <!--> w", "x w"),
        ("x <!-- never closed", "x"),
        ("it <b and no end, ever", "it <b and no end, ever"),
        ("<p title='a>b'>one, two.</p>", "one, two."),
        ('<p title="open>one, two.</p>', "one, two."),
        ("<p it's>one, two.</p><p>three, it's.</p>", "one, two. three, it's."),
        ("<noscript>x, y.<p>one, two.</p>", "x, y. one, two."),
        ("<style>p{}", ""),
        ("<p>&#" + "9" * 6000 + "; big, &#x41;.</p>", "� big, A."),
        ("</div></p><p>one, two.</p></b></div>", "one, two."),
    ],
)
def test_malformed_markup(page, want):
    assert html_text.main_text(page, html_text.PRIOR) == want


@pytest.mark.parametrize("unit", ['<a "', "<a x", "<a x='", '<a x="', "<p", "<!--", "<!-", "<?", "</", "<p>", "<div>", "<div>a", "<b>", "<div></b>", "<noscript>", "<script", "a<p>b</p>", "<span></p><li>", "&#1", "<b><div><i></b>", "= = ", "<ul><li>x<p>", "<a>a,<div>"])
def test_pages_take_linear_time(unit):
    def seconds(n):
        page = unit * (n // len(unit))
        began = time.process_time()
        html_text.main_text(page, html_text.PRIOR)
        return time.process_time() - began

    assert seconds(800_000) < 20 * seconds(80_000) + 2


def test_a_page_of_five_megabytes_of_unclosed_tags_takes_seconds():
    began = time.process_time()
    text = html_text.main_text(f"<article><p>{LONG}</p></article>" + '<a "' * 600_000 + "<a x" * 600_000, html_text.PRIOR)
    assert text.startswith(LONG) and time.process_time() - began < 20
