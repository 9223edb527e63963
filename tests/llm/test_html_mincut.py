"""HTML extraction: the cut against all labellings, and pages with known main text."""

import itertools
import random

import pytest

from skyseries.llm import html_mincut as H


def test_cut_costs_no_more_than_any_labelling():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(1, 9)
        terminal = [rng.randrange(-9, 10) for _ in range(n)]
        ties = [(i, i + 1, rng.randrange(6)) for i in range(n - 1)] + [(*sorted(rng.sample(range(n), 2)), rng.randrange(4)) for _ in range(n // 3)]

        def price(labels):
            own = sum(max(c, 0) if not keep else max(-c, 0) for c, keep in zip(terminal, labels))
            return own + sum(c for i, j, c in ties if labels[i] != labels[j])

        assert price(H.minimum_cut(terminal, ties)) == min(map(price, itertools.product([True, False], repeat=n)))


LONG = "This is one sentence of the article, and it says a few things about nothing at all."
PAGES = [
    (f"<body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title &amp; all</h1><p>{LONG}</p><p>{LONG}\n  two&nbsp;three<br>four</p></article><footer>&copy; me</footer></body>",
     f"Title & all\n\n{LONG}\n\n{LONG} two three four"),
    (f"<article><h1>T</h1><p><b>Start.<br><p>{LONG}</article><div class=ad>Buy it now, it is good for you and for all.</div>", f"T\n\nStart.\n\n{LONG}"),
    (f"<script>var t='</p>';</script><style>p{{}}</style><main><p>{LONG}</p><form><p>Your name, please, and all that belongs to it.</p></form></main>", LONG),
    (f"<article><p>{LONG}</p></article><div id='cookie-notice'>{LONG}</div><aside>{LONG}</aside><section class='comments'><article><p>{LONG}</p></article></section>", LONG),
    (f"<article><p>{LONG}</p><!-- <p>no</p> --><p>short</p><p>{LONG}</p>", f"{LONG}\n\nshort\n\n{LONG}"),
    (f"<header><h1>Site</h1></header><div><div class='post'><p>{LONG}</p><p>{LONG}</p></div></div><div class='sidebar widget'><p>{LONG}</p></div>", f"{LONG}\n\n{LONG}"),
    ("", ""), ("<nav>only <a href=x>links</a></nav>", ""), ("<", ""), ("<article>", ""), ("<!-- open", ""), ("<script>never closed", ""),
    (f"<article><p>{LONG} a &lt; b &#233; &unknown; &am</p></article>", f"{LONG} a < b é &unknown; &am"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("attribute", [
    'style="overflow:hidden"', "style='visibility: hidden-not'", 'href="/the-hidden-city"', "href=/the-hidden-city", 'title="Hidden gems"', "title='a hidden=b'",
    'data-hidden="1"', "data-hidden", 'aria-hidden="false"', "aria-hidden=false", 'data-aria-hidden="true"', 'data-class="sidebar"', 'title="class=sidebar"', 'alt=""',
])
def test_names_inside_values_and_other_names_are_no_attributes(attribute):
    assert H.main_text(f"<article><div {attribute}><p>{LONG}</p></div></article>") == LONG
    assert H.main_text(f"<article><p>See <a {attribute}>the city</a>. {LONG}</p></article>") == f"See the city. {LONG}"


@pytest.mark.parametrize("attribute", ["hidden", "HIDDEN", 'class="x"hidden', 'hidden=""', "hidden='until-found'", 'aria-hidden="true"', "aria-hidden=true", "title='x' aria-hidden = 'True'"])
def test_hidden_elements_are_left_out(attribute):
    assert H.main_text(f"<article><p>{LONG}</p><div {attribute}><p>{LONG}</p></div></article>") == LONG


WRAPPED = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
WHOLE = f"Title\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize("wrapper", ["div class='no-sidebar'", "div class='content-sidebar-wrap'", "div id='search-results'", "div class='social-story'", "form", "form action='/page.aspx'", "div class='has-comments'"])
def test_a_wrapper_of_the_whole_page_is_no_frame(wrapper):
    end = wrapper.split()[0]
    menu = "<nav><a href='/'>Home</a></nav>"
    side = f"<div class='sidebar'><p>{LONG}</p></div><section class='comments'><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></section>"
    for inner in (WRAPPED, f"<article>{WRAPPED}</article>", f"<main>{WRAPPED}</main>", f"<div><div>{WRAPPED}</div></div>"):
        assert H.main_text(f"<body><{wrapper}>{inner}</{end}></body>") == WHOLE
        assert H.main_text(f"<body><{wrapper}>{menu}{inner}{side}</{end}><footer>{LONG}</footer></body>") == WHOLE


def test_frames_beside_an_article_stay_out():
    for part in (f"<div class='sidebar'><article><p>{LONG}</p></article></div>", f"<div class='related'><div><div><div><p>{LONG}</p></div></div></div></div>",
                 f"<form><div><p>{LONG}</p></div></form>", f"<aside><article><p>{LONG}</p></article></aside>", f"<div class='comments'><div><div><div><div><article><p>{LONG}</p></article></div></div></div></div></div>"):
        assert H.main_text(f"<article>{WRAPPED}</article>{part}") == WHOLE
        assert H.main_text(f"<div class='no-sidebar'><article>{WRAPPED}</article>{part}</div>") == WHOLE


def test_main_and_the_larger_article_end_a_mark_above_them():
    assert H.main_text(f"<div class='overlay'><main>{WRAPPED}</main></div><p>{LONG * 5}</p>").startswith(WHOLE)
    assert H.main_text(f"<div class='story-widget'><article>{WRAPPED}</article></div><div><p>{LONG * 5}</p></div>").startswith(WHOLE)


TWO = "Buy this now, it is good for you. Nobody has ever had more of it than we have here."


@pytest.mark.parametrize("frame", ["div class='ad'", "div id='cookie-notice'", "div class='sidebar'", "form", "div class='promo banner'", "aside"])
@pytest.mark.parametrize("article", ["article", "main"])
def test_a_frame_that_says_more_than_the_article_stays_out(frame, article):
    end = frame.split()[0]
    short = f"<{article}><p>Short one.</p></{article}>"
    for page in (f"<{frame}>{TWO}</{end}>{short}", f"{short}<{frame}><p>{TWO}</p><p>{TWO}</p></{end}>", f"<div class='no-sidebar'><{frame}>{TWO}</{end}>{short}</div>"):
        assert H.main_text(f"<body>{page}</body>") == "Short one."


def test_a_frame_beside_plain_text_stays_out():
    assert H.main_text(f"<body><div class='ad'>{TWO} {TWO}</div><div><p>{LONG}</p></div></body>") == LONG
    assert H.main_text(f"<body><form><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></form><p>Copyright by me.</p></body>").startswith(WHOLE)


def test_links_inside_an_article_are_kept():
    links = "<ul><li><a href='a'>Ref one</a></li><li><a href='b'>Ref two</a></li></ul>"
    for start, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='article'>", "</div>"), ("<div id=content>", "</div>")):
        page = f"<body><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul>{start}<p>{LONG}</p>{links}{end}<footer><a href=z>Imprint</a></footer></body>"
        assert H.main_text(page) == f"{LONG}\n\nRef one\n\nRef two"


def test_bare_text_is_the_main_text():
    assert H.main_text("<body>Hello world and more words here</body>") == "Hello world and more words here"
    assert H.main_text("just text") == "just text"
    assert H.main_text("<nav><a href=x>a</a> b</nav><div>kept words</div><footer>gone</footer>") == "kept words"


@pytest.mark.parametrize("part", ["<a ", "<a x=\"", "<a x='>", "<a x=\">\" ", "<", "<!-- ", "<script>", "</p", "<p a=b ", "a < b ", "<!x ", "<p>&", "<svg/>", "<p " + "y=1 " * 50])
def test_odd_pages_take_time_in_proportion(part):
    import time

    page = (part * (1_000_000 // len(part)))[:1_000_000]
    start = time.process_time()
    H.blocks(page)
    assert time.process_time() - start < 20
    assert LONG in H.main_text(f"<article><p>{LONG}</p></article>" + part * 300)


def test_long_and_odd_pages():
    many = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    assert H.main_text(f"<article>{many}</article>").count("\n\n") == 4999
    mixed = "".join(f"<p>{LONG}</p><div><a href=x>one</a></div>" for _ in range(500))
    assert H.main_text(f"<div>{mixed}</div>").count(LONG) == 500
    assert H.main_text("<div>" * 3000 + LONG + "</div>" * 10) in (LONG, "")
    assert isinstance(H.main_text("<a <b <c>>> x </p></p> <p <p>"), str)


def test_rows(spark):
    rows = [(i, f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)] + [(100, None, None, "x"), (None, "u", PAGES[0][0], None)] + [(101, "u", "<p>&#xD800;</p>", "x")] * 2
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(3)
    found = H.extracted(df).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    for i, (_, text) in enumerate(PAGES):
        assert tuple(by_id[i]) == (i, f"u{i}", text, len(text))
    assert by_id[100].text == "" and by_id[None].text == PAGES[0][1]
    assert H.extracted(df.limit(0)).collect() == []
