import numpy as np

from peerscope.llm.html_text import extract_main_text, main_text, smoothed

LONG = "Words of a paragraph that tells a long story about nothing at all, " * 4
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>x";</script></head>
<body><header>Site name</header><nav><ul><li><a href="/a">Home</a><li><a href="/b">More</a></ul></nav>
<div class="cookie-notice">We use cookies for everything you do on this page, {LONG}</div>
<article><h1>A &amp; B&nbsp;title</h1><p>{LONG}<p>Second <b>bold</b>
   text<br>after a break.<p>Short.</p><form><label>Mail</label><input></form>
<aside>Related stuff</aside><div id="comments"><p>First! {LONG}</p></div></article>
<div class="sidebar">{LONG}</div><footer>&copy; somebody</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE).split("\n") == [
        "A & B title", " ".join(LONG.split()), "Second bold text after a break.", "Short."]


def test_regions_without_article_element():
    page = PAGE.replace("<article>", "<div class='x'>").replace("</article>", "</div>")
    assert main_text(page).split("\n")[1:] == main_text(PAGE).split("\n")[1:]


def test_text_beside_teaser_cards_is_the_article():
    story = "".join(f"<p>{i} {LONG}</p>" for i in range(6))
    card = "<article><h3><a href='/{0}'>Another story {0}</a></h3><p>A few words on it.</p><a href='/{0}'>More</a></article>"
    cards = "".join(card.format(i) for i in range(8)) + "<article><p>An opinion, in two short lines.</p></article>"
    want = [f"{i} {' '.join(LONG.split())}" for i in range(6)]
    for page in (f"<body><div class='story'>{story}</div><div class='box'>{cards}</div></body>",
                 f"<body><main><div class='box'>{cards}</div><div class='story'>{story}</div></main></body>"):
        assert main_text(page).split("\n") == want


def test_class_words_do_not_hide_the_article():
    story = "".join(f"<p>{i} {LONG}</p>" for i in range(6))
    want = [f"{i} {' '.join(LONG.split())}" for i in range(6)]
    side = f"<div class='sidebar'><p>{LONG}</p></div>"
    for page in (f"<div class='wrap has-sidebar'><div class='text'>{story}</div>{side}</div>",
                 f"<div id='header-less'><div class='share-enabled text'>{story}</div>{side}</div>",
                 f"<article class='post comments-open'>{story}{side}</article>",
                 f"<main id='skip-target'>{story}</main>{side}"):
        assert main_text(f"<html><body>{page}</body></html>").split("\n") == want


def test_a_long_advert_beside_a_short_article_stays_out():
    assert main_text(f"<div class='ad'>{LONG}</div><article><h1>Short</h1><p>news</p></article>") == "Short\nnews"


def test_broken_and_empty_pages():
    assert main_text(None) == main_text("") == main_text("<html><nav>menu</nav>") == ""
    assert main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert main_text("plain text") == "plain text"
    assert main_text("<p>" * 3000 + "deep") == "deep"
    assert len(main_text("<article>" + "<p>x y</p>" * 50_000)) == 50_000 * 4 - 1


def test_smoothing_keeps_a_constant():
    assert np.allclose(smoothed(np.full(7, 3.0)), 3.0) and len(smoothed(np.ones(1))) == 1


def test_frame(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 6), (None, "v", "", 7), (1, "u", PAGE, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    out = extract_main_text(pages).collect()
    assert [r["text"] for r in out] == [main_text(r[2]) for r in rows]
    assert extract_main_text(pages.limit(0)).count() == 0
