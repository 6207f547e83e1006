"""Main text of several page layouts: what articles keep and what goes."""

import random

import pytest

from roadweave.llm import html

P = "<p>" + "Some long words of prose that make an article. " * 6 + "</p>"
PROSE = ("Some long words of prose that make an article. " * 6).strip()
LAYOUTS = {
    "article": f"<html><body><nav><a>Home</a></nav><header>Site</header><article>{P}%s{P}</article><footer>f</footer></body></html>",
    "div": f'<body><div class="main-nav">Menu</div><div id="content">{P}%s{P}</div><div class="sidebar">side</div></body>',
    "table": f"<table><tr><td><ul><li><a>Menu</a></ul></td><td>{P}%s{P}</td></tr></table>",
    "nested": f'<body><div><div class="c1"><div class="post">{P}%s{P}</div></div></div><div id="comments"><p>Said.</p></div></body>',
}
KEPT = [
    ("<p><a>Read the full report</a></p>", "Read the full report"), ("<ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>", "One Two"),
    ('<div class="search-results-explained"><p>kept</p></div>', "kept"), ('<div class="warning-box">kept</div>', "kept"), ('<blockquote class="related-work">kept</blockquote>', "kept"),
    ('<h2><a name=x>A head</a></h2>', "A head"), ("<p>a&amp;b &eacute;\n\t c&#33;</p>", "a&b é c!"),
]
GONE = [
    '<div class="share-bar">x</div>', '<div id="comments"><p>x</p></div>', '<div class="ad-slot ad-300x250">x</div>', "<aside>x</aside>", '<div class="comment-list">x</div>',
    '<div class="cookie-notice">x</div>', '<div class="sidebarLeft">x</div>', '<div class="related-posts">x</div>', '<section class="newsletter-signup">x</section>',
    "<form><input><button>x</button></form>", "<script>x</script>", "<style>x</style>", "<!-- x -->", '<div role="navigation">x</div>', '<p hidden>x</p>', '<div style="display: none">x</div>',
]


def text_of(source):
    page = html.Page(source)
    return page.extract(page.vote()[0])


@pytest.mark.parametrize("layout", LAYOUTS)
def test_what_stays_and_what_goes(layout):
    for part, text in KEPT:
        assert text_of(LAYOUTS[layout] % part) == f"{PROSE} {text} {PROSE}"
    for part in GONE:
        assert text_of(LAYOUTS[layout] % part) == f"{PROSE} {PROSE}"


def test_an_article_of_links_keeps_its_text():
    source = "<body><article><p>Short one.</p><p><a href=3>A longer paragraph that is one link as a whole</a></p></article><footer>x</footer></body>"
    assert text_of(source) == "Short one. A longer paragraph that is one link as a whole"
    assert text_of("") == text_of(None) == text_of("<p> </p>") == ""


WRAPPED = {
    "all in one form": f"<body><form id=form1 action=x><input type=hidden name=v><div class=menu><a href=1>Home</a></div><article>{P}%s{P}</article><input name=q><div class=footer>f</div></form></body>",
    "a widget": f'<body><div class="widget Blog"><div class="post-body">{P}%s{P}</div></div><div class="widget links"><a href=1>Other</a></div><div class="footer">foot line</div></body>',
    "several names": f'<body><div class="menu">Menu</div><div class="post social">{P}%s{P}</div><div><p>after it</p></div></body>',
    "an overlay": f'<body><div class="overlay"><div id="content">{P}%s{P}</div></div><div class="cookie-notice">We use cookies</div></body>',
    "a banner beside it": f'<body><div class="banner">Buy now</div><div class="story sidebar">{P}%s{P}</div><div class="sidebar">side</div></body>',
}


@pytest.mark.parametrize("layout", WRAPPED)
def test_parts_that_hold_the_article_stay_whatever_they_are_called(layout):
    for part, text in KEPT:
        assert text_of(WRAPPED[layout] % part) == f"{PROSE} {text} {PROSE}"
    for part in GONE:
        assert text_of(WRAPPED[layout] % part) == f"{PROSE} {PROSE}"


def test_long_comments_and_forms_do_not_pass_for_the_article():
    said = "<p>" + "Nice. " * 300 + "</p>"
    fields = "".join(f"<p>Tell us about your place {i} and more <input name=f{i}></p>" for i in range(40))
    for extra in (f'<div id="comments">{said}</div>', f'<div class="post-comments">{said}</div>', f"<form>{fields}</form>", f'<div class="sidebar">{said}</div>', f'<div class="widget"><div class="comment-list">{said}</div></div>'):
        assert text_of(f'<body><div class="post">{P}</div>{extra}</body>') == PROSE


def test_planted_articles_on_random_pages():
    """Every page has its own order of parts, names and wrapping; the truth is what was planted as article."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    furniture = [
        lambda: f'<nav><ul>{"".join(f"<li><a href=/{i}>{word()}</a></li>" for i in range(6))}</ul></nav>', lambda: f"<header><h2>{prose(4)}</h2></header>", lambda: f'<div class="sidebar">{prose(15)}</div>',
        lambda: f'<div class="widget social"><a href=1>{word()}</a></div>', lambda: f'<form><input name=m><input type=submit> {prose(8)}</form>', lambda: f'<div class="cookie-banner">{prose(10)}</div>',
        lambda: f'<section id="comments"><p>{prose(r.randint(5, 200))}</p></section>', lambda: f"<footer>{prose(9)}</footer>", lambda: f"<script>var a = '{prose(9)}'</script>",
    ]
    wraps = ["<article>%s</article>", '<div class="entry-content">%s</div>', '<div class="widget Blog"><div class="post-body">%s</div></div>', '<div class="post social">%s</div>', '<div id="content" class="text">%s</div>']
    found = planted = right = 0
    for _ in range(300):
        blocks = [prose(r.randint(12, 60)) for _ in range(r.randint(2, 8))]
        inner = "".join(r.choice(["<p>%s</p>", "<h2>%s</h2>", "<ul><li>%s</li></ul>", "<blockquote><p>%s</p></blockquote>", "<p><b>%s</b></p>"]) % b for b in blocks)
        parts = [r.choice(wraps) % inner, *[f() for f in r.sample(furniture, r.randint(2, 7))]]
        r.shuffle(parts)
        page = "".join(parts)
        page = f'<html><body>{page if r.random() < 0.7 else f"<form action=x>{page}</form>"}</body></html>'
        text = text_of(page)
        found += len(text.split())
        planted += sum(len(b.split()) for b in blocks)
        right += sum(len(b.split()) for b in blocks if b in text)
    assert right / planted > 0.99 and right / found > 0.99


def test_pages_without_a_host_do_not_vote_together(spark):
    a = f'<body><div class="a">{P}</div><div class="b"><p>b</p></div></body>'
    b = f'<body><div class="a"><p>a</p></div><div class="b">{P}</div></body>'
    rows = [(1, None, a), (2, "", a), (3, None, b), (4, "not an address", b)]
    got = html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == dict.fromkeys([1, 2, 3, 4], PROSE)
