import re
import time

import pytest

from reviewloom.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy, now!</div>
<article><h1>Head &amp; shoulders</h1><p>One   <b>bold</b> text, with marks.<br>Next line.<p>Unclosed, second.</p>
<script>var a = "<p>no</p>";</script><div class="comments"><p>I disagree, a lot, really.</p></div></article>
<aside>Side</aside><form><p>Mail</p></form><footer>&copy; x</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "Head & shoulders One bold text, with marks. Next line. Unclosed, second."


def test_without_article_element():
    page = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert main_text(page) == main_text(PAGE)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>x", "<nav>only menu</nav>"])
def test_nothing_to_find(page):
    assert main_text(page) in ("", "<", "<p")


def test_plain_text_and_long_pages():
    assert main_text("just text &lt;b&gt; &am") == "just text <b> &am"
    long = "<article>" + "<p>word, word.</p>" * 20000 + "</article>"
    assert len(main_text(long)) == 20000 * 12 - 1 + 19999 * 0 or main_text(long).count("word") == 40000


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, 3), (2, "v", "", 3)], "page_id long, url string, html string, n_chars int"
    )
    rows = extract(df).collect()
    assert len(rows) == 4 and {r.n_chars for r in rows} == {0, len(main_text(PAGE))}
    assert extract(df.limit(0)).count() == 0


LONG = "A sentence that is long enough, with marks, to be told from a menu. " * 4
PARTS = [
    ("<h1>Head</h1><p>Intro, in short.</p><ul>" + f"<li>{LONG}</li>" * 9 + "</ul><p>The end.</p>"),
    ("<h1>Head</h1><p>Intro, in short.</p><table>" + f"<tr><td>{LONG}</td><td>{LONG}</td></tr>" * 9 + "</table><p>The end.</p>"),
    ("<section id='history'><h2>Then</h2>" + f"<p>{LONG}</p>" * 8 + f"</section><section id='usage'><h2>Now</h2><p>{LONG}</p><p>{LONG}</p></section>"),
]


@pytest.mark.parametrize("body", PARTS)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_all_parts_of_an_article(tag, body):
    page = f"<html><body><nav><a href='/'>Home</a></nav><{tag}>{body}</{tag}><footer>Imprint</footer></body></html>"
    assert main_text(page) == " ".join(re.sub("<[^>]*>", " ", body).split())


@pytest.mark.parametrize(
    "page",
    [
        "<body class='has-sidebar'><article><h2>Head</h2><p>One.</p></article></body>",
        "<body class='search'><main class='notice'><h2>Head</h2><p>One.</p></main></body>",
        "<article class='comment-open'><h2>Head</h2><p>One.</p></article>",
        "<article><h2 id='related-work'>Head</h2><p>One.</p></article>",
        "<article><h2 id='search'>Head</h2><p>One.</p></article>",
        "<article><section id='search-algorithms'><h2>Head</h2><p>One.</p></section></article>",
        "<article><div id='ad-hoc-networks'><h2>Head</h2></div><p class='form-of-government'>One.</p></article>",
    ],
)
def test_names_that_only_contain_a_word(page):
    assert main_text(page) == "Head One."
    for name in ("ad", "x sidebar", "Comments"):
        assert main_text(page.replace("</h2>", f"</h2><div class='{name}'>Not this</div>")) == "Head One."


TEXT = f"<h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
PLAIN = " ".join(re.sub("<[^>]*>", " ", TEXT).split())
NOT_THIS = "<p>I disagree, a lot, with all that was said, and this is why: it is not so.</p>"


@pytest.mark.parametrize(
    "extra",
    [
        f'<ol class="comment-list"><li><article class="comment-body">{NOT_THIS}</article></li></ol>',
        f'<section class="comments">{NOT_THIS * 3}</section>',
        f'<section id="comments">{NOT_THIS * 3}</section>',
        f'<div class="comments-section">{NOT_THIS}</div>',
        f'<div id="cookie_banner">{NOT_THIS}</div>',
        '<div class="share-buttons"><a href="/">Share</a> it</div>',
        f'<div class="related-posts">{NOT_THIS}</div>',
        f'<article class="comment">{NOT_THIS}</article>',
    ],
)
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_comments_and_notices_within_an_article(tag, extra):
    page = f"<body><nav><a href='/'>Home</a></nav><{tag}>{TEXT}{extra}</{tag}><footer>Imprint</footer></body>"
    assert main_text(page) == PLAIN


def test_a_teaser_does_not_win_for_being_an_article():
    page = f'<body><nav>Home</nav><div id="post">{TEXT}</div><article class="card"><p>Read this, too.</p></article></body>'
    assert main_text(page) == PLAIN


def test_small_print_and_links_beside_the_text():
    small = "<div class='x1'><p>All rights, of any kind, are reserved; no part may be copied, sold, or lent.</p></div>"
    links = "<div class='x2'>" + "<p><a href='/'>More of this</a></p>" * 9 + "</div>"
    assert main_text(f"<body>{links}<div id='post'>{TEXT}</div>{small}</body>") == PLAIN
    assert main_text(f"<body>{links}<h1>Head</h1><div id='post'>{TEXT[13:]}</div>{small}</body>") == PLAIN
    assert main_text(f"<body>{links}{TEXT}</body>") == PLAIN


def test_several_articles():
    page = f"<body><nav>Home</nav><article>{TEXT}</article><article>{TEXT}</article><article>{TEXT}</article></body>"
    assert main_text(page) == " ".join([PLAIN] * 3)


HOSTILE = [
    "<a ", '<p title="x" ', "<p title='x\"> ", '<p ">" ', "<!--", "<![x", "</", "<div>x", "<div></b>", "<b>", "<b><div>x</b>", "<ul><div><li>x</li>",
    "<script>", "</script", "&#", "&#99999999", "<b><p>", "<p><b>", '<div class="', "<article>x", "<td><tr>", "<", "<a<a", "<span class=ad>x",
]


@pytest.mark.parametrize("part", HOSTILE)
def test_hostile_markup_takes_time_by_its_size(part):
    for tail in ("", ">", '">', "</div>" * 1000):
        page = (part * (250_000 // len(part))) + tail
        began = time.process_time()
        main_text("<body><p>Text, first.</p>" + page)
        small = time.process_time() - began
        assert small < 4, (part, tail, small)


def test_numbers_of_characters():
    assert main_text(f"<p>{'&#' + '0' * 9000 + '65;'} &#{'9' * 9000}; &#x41;</p>") == "A � A"
