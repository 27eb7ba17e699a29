"""HTML extraction on pages of known text, and the cut against all labellings."""

import itertools
import random
import time
import tracemalloc

import numpy as np

from tallyline.llm import html_text

WEIGHTS = np.array([-1.5, 0.8, -1.3, -1.3, 3.0, 1.3, -1.0, -1.3, -1.6])
ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>\n text,&nbsp;and more.</p><p>Second one<br>goes on.</p></article>"
TEXT = "Title & more\nFirst bold text, and more.\nSecond one goes on."


def text(page, weights=WEIGHTS):
    return html_text.main_text(page, weights)


def test_everything_but_the_article_goes():
    around = [
        "<nav><ul><li><a href='/x'>Home</a><li>About</ul></nav>", "<footer>&copy; somebody, all of it.</footer>", "<aside>Read also, too.</aside>",
        "<div class='ad'>Buy this now, please.</div>", "<div id=cookie-notice><p>We use cookies, a lot of them, everywhere.</p></div>",
        "<form><p>Your name, please.</p><input value=x></form>", "<script>var t='</p>';</script>", "<style>p{margin:0}</style>", "<!-- gone -->",
        "<section class='commentList comments'><p>I liked this text, said a reader, very much indeed.</p></section>",
        "<div class=sidebar><p>A long text in the sidebar, which goes on and on, for long.</p></div>", "<header><h2>The site</h2></header>",
        "<noscript>Switch it on.</noscript>", "<div role='navigation'>Menu of things</div>", "<p hidden>Not to be seen.</p>",
    ]
    draw = random.Random(1)
    for _ in range(40):
        some = draw.sample(around, 5)
        page = f"<!DOCTYPE html><html><head><title>T</title></head><body class='no-sidebar'>{''.join(some[:2])}{ARTICLE}{''.join(some[2:])}</body></html>"
        assert text(page) == TEXT
    inside = ARTICLE.replace("</h1>", "</h1>" + around[3] + around[9])
    assert text(f"<body>{inside}</body>") == TEXT


def test_pages_that_do_not_say_what_they_are():
    page = ("<body><div><a href=1>Home</a> <a href=2>About</a></div><div><p>A paragraph of many words, which tells a story, and goes on.</p>"
            "<p>Short one.</p><p>Another paragraph of many words, in the same place, with stops.</p></div><div><ul><li><a href=3>Terms</a></li></ul></div></body>")
    assert text(page).split("\n") == [
        "A paragraph of many words, which tells a story, and goes on.", "Short one.", "Another paragraph of many words, in the same place, with stops."]


def test_broken_markup():
    assert text("<article><p><b>One two<br><p>Three four</article>") == "One two\nThree four"
    assert text("<article><p>One <a href='x>y'>two</a> three</p><p>Fo") == "One two three\nFo"
    assert text("<article><p>One</p><p cla") == "One"
    assert text("<article><p>a < b &lt; c &amp d</p></article>") == "a < b < c & d"
    assert text("<article><p>x</p><script>never closed <p>y</p>") == "x"
    assert text("plain text, without any markup at all, but of some length.") == "plain text, without any markup at all, but of some length."


def test_only_class_and_id_tokens_are_statements():
    for wrapper in (
        '<div style="overflow:hidden">', '<div data-id="search">', '<div data-role="menu" title="class=ad hidden">', '<div class="layout with-sidebar">',
        '<main class="content no-sidebar">', '<div class="post has-social-share">', '<div class="overflow-hidden">', '<div class="layout sidebar-left">',
        '<form id="page">', "<div data-x='a>b' data-hidden>",
    ):
        page = f"<body><nav>Menu</nav>{wrapper}{ARTICLE}</{wrapper[1:].split()[0]}><footer>End</footer></body>"
        assert text(page) == TEXT, wrapper
    assert text(f"<body>{ARTICLE}<div class='related'><article><p>Teaser of another text, in few words.</p></article></div></body>") == TEXT
    assert text(f"<body><aside><article><p>Teaser of another text.</p></article></aside>{ARTICLE}</body>") == TEXT
    assert text(f"<body><div class='post hidden' aria-hidden='TRUE'>x y, z.</div>{ARTICLE}</body>") == TEXT


def test_anchors_inside_an_article_keep_their_text():
    for anchor in ('<h2 id="related-work">', '<h2 id="search">'):
        assert text(ARTICLE.replace("<p>Second", f"{anchor}Related work</h2><p>Second")) == TEXT.replace("\nSecond", "\nRelated work\nSecond")
    part = '<section id="related-work"><h2>Related work</h2><p>Others have said the same, but at greater length.</p></section></article>'
    assert text(ARTICLE.replace("</article>", part)) == TEXT + "\nRelated work\nOthers have said the same, but at greater length."


def test_names_can_be_outvoted():
    long = "<p>" + "A paragraph of many words, which tells a story, and goes on. " * 3 + "</p>"
    page = f"<body><div class='share'><p>Share, all.</p></div><div class='box form'>{long}{long}{long}</div></body>"
    assert text(page).count("\n") == 2


def test_dropped_elements_end_where_they_should():
    for odd in (
        "<svg viewBox='0 0 1 1'/>", "<math/>", "<object data='x'/>", "<svg><path d='M0'/>", "<svg><g><path d='M0'>", "<button>Go", "<select><option>One<option>Two",
        "<canvas>", "<object data=x>", "<noscript>", "<template>", "<div><button>Go</div>", "<div><svg><text>x</text></div>", "<div><object><b>x</b></div>",
        "<object><object>x</object><p>y</p></object>", "<template><div><template>x</template><p>y</p></div></template>", "<svg><title>t</title><text>x</text></svg>",
        "<noscript><p>Switch it on.</p></noscript>", "<select><option>One</select>", "<svg><foreignObject><p>x</p></foreignObject></svg>", "<button/>",
    ):
        assert text(ARTICLE.replace("<p>Second", odd + "<p>Second")) == TEXT, odd
        assert text(f"<body><div>{odd}</div>{ARTICLE}</body>") == TEXT, odd
        assert text(f"<body>{odd}{ARTICLE}{odd}</body>") == TEXT, odd
    assert text(ARTICLE.replace("First", "First <svg><path/></svg><button>Go</button>")) == TEXT
    assert text(ARTICLE.replace("First", "First <button>Go")) == TEXT.replace("First bold text, and more.", "First")
    formula = "<math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi></mrow><annotation>E=m</annotation></semantics></math>"
    assert text(ARTICLE.replace("First", f"First {formula}")) == TEXT.replace("First", "First E=m")


def test_minimum_cut_is_the_cheapest_labelling():
    draw = random.Random(2)
    for _ in range(150):
        n = draw.randrange(1, 8)
        costs = [draw.choice([-3, -2, -1, -0.5, 0.5, 1, 2, 3]) * 1.01 ** i for i in range(n)]
        edges = [(a, b, draw.choice([0.3, 0.7, 1.9])) for a, b in itertools.combinations(range(n), 2) if draw.random() < 0.5]

        def price(kept):
            wrong = sum(max(c, 0) if not k else max(-c, 0) for c, k in zip(costs, kept))
            return wrong + sum(w for a, b, w in edges if kept[a] != kept[b])

        best = min(price(kept) for kept in itertools.product([False, True], repeat=n))
        assert abs(price(html_text.minimum_cut(costs, edges)) - best) < 1e-6


def test_reader_comments_go():
    said = "<p>I liked this text, said a reader, very much indeed.</p>"
    for comments in (
        f'<section id="comments">{said}</section>', f'<section><h2>Comments</h2><article class="reply">{said}</article></section>',
        f'<ol class="commentlist"><li>{said}</li></ol>', f'<div class="responses">{said}{said}</div>', f'<section><article class="reply">{said}</article></section>',
        f"<section><h3>2 Comments</h3><article>{said}</article><article>{said}</article></section>", f'<div id="disqus_thread">{said}</div>',
        f'<div class="comments-area"><article>{said}</article></div>', f'<section id="replies"><article>{said}</article></section>',
    ):
        for page in (ARTICLE.replace("</article>", comments + "</article>"), f"<body>{ARTICLE}{comments}</body>", f"<main>{ARTICLE}{comments}</main>"):
            assert text(page) == TEXT, comments
    part = "<section><h2>Comments on method</h2><p>What others said of it, in their own words.</p></section></article>"
    assert text(ARTICLE.replace("</article>", part)).startswith(TEXT + "\nComments on method\n")


def test_compound_names_do_not_empty_an_article():
    body = "<p>A paragraph of many words, which tells a story, and goes on.</p><p>Another paragraph of many words, with stops, as it were.</p>"
    for open_, close in (
        ('<article class="post-search">', "</article>"), ('<article class="news-banner-free">', "</article>"), ('<div class="promo-story">', "</div>"),
        ('<article class="sponsored">', "</article>"), ('<div class="content ad-container">', "</div>"), ('<main id="login">', "</main>"),
    ):
        page = f"<body><nav>Menu</nav>{open_}{body}{close}<div class='ad-slot'>Buy this now, please.</div><footer>End</footer></body>"
        assert text(page).count("\n") == 1, open_


def test_parts_of_an_article_stay():
    for tag in ("address", "fieldset", "dialog", "figure", "details", "blockquote", "table"):
        part = f"<{tag}>Somebody at work, in some street, of a town.</{tag}>"
        assert text(ARTICLE.replace("<p>Second", part + "<p>Second")) == TEXT.replace("\nSecond", "\nSomebody at work, in some street, of a town.\nSecond")
    assert text(f"<body>{ARTICLE}<address>Somebody, some street.</address><dialog>Log in, please.</dialog></body>") == TEXT


def test_large_pages_take_linear_time_and_memory():
    many = "".join(f"<p>A paragraph of many words, which tells story {n}, and goes on.</p><li><a href=x>Link {n}</a></li>" for n in range(10_000))
    deep = "".join(f"<div>two words {n % 10}" for n in range(40_000))
    for page in (f"<body><div>{many}</div></body>", f"<body>{deep}</body>"):
        tracemalloc.start()
        start = time.process_time()
        text(page)
        took, (_, most) = time.process_time() - start, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert took < 30 and most < 250_000_000


def test_columns(spark):
    page = f"<html><body><nav>Menu</nav>{ARTICLE}</body></html>"
    long = "<article>" + "".join(f"<p>Paragraph {n}, of a long page.</p>" for n in range(4000)) + "</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "", ""), (3, "v", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS mark", "3 AS page")
    got = html_text.extracted(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
    assert [r.text for r in got if r.page_id == 1] == [TEXT] * 2
    assert [r.text for r in got if r.page_id in (None, 2)] == ["", ""]
    assert [r.text.count("\n") for r in got if r.page_id == 3] == [3999]
    assert html_text.extracted(pages.limit(0)).count() == 0
