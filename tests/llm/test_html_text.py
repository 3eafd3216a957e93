import html
import re
import time

import pytest

from termspire.llm.html_text import Page, extract, main_text

SF = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>t, t.</title><style>p{}</style></head><body>
<header class="site"><a href=/>Home</a> Some, site.</header>
<div id=cookie-notice>We use cookies. Accept, please, now, or, later.</div>
<ul class="menu"><li><a href=/a>A, a.</a><li><a href=/b>B</a></ul>
<div class="wrap"><div class="sidebar"><p>Side text, with commas, and. dots. It is long, very long, really long.</div>
<div class="content"><h2>Title</h2><p>First &amp; foremost,\n a  text.&nbsp;More<br>of it.<p>Second <i>para</i>graph, here &lt;ok&gt;.
<ul><li>One, item.<li>Two, item.</ul><script>var x = "<p>no, no.</p>";</script><blockquote>Quoted, text.</blockquote>
<table><tr><td>a<td>b<tr><td>c</table></div>
<section class="comments"><p>Great post, I like it. Very, very much, indeed, so much.</p></section></div>
<form><p>Sign up, now, or never.<input></form><footer>(c) 2020, all. rights, reserved.</footer></body></html>"""


def test_the_article_without_the_rest():
    assert main_text(PAGE).split("\n\n") == [
        "Title", "First & foremost, a text. More of it.", "Second paragraph, here <ok>.", "One, item.", "Two, item.",
        "Quoted, text.", "a", "b", "c",
    ]


def test_odd_sources():
    assert main_text("") == "" and main_text("<div></div> \n") == ""
    assert main_text("plain text") == "plain text"
    assert main_text("a < b and c > d") == "a < b and c > d"
    assert main_text("<p>a<p>b</div></p>") == "a\n\nb"
    assert main_text("<article><h1>Only</h1><p><b>One</article>") == "Only\n\nOne"
    assert main_text("<nav>menu</nav>") == ""
    assert main_text("<p>x" * 3) == "x\n\nx\n\nx"
    assert main_text("<body><script>never closed <p>a") == ""
    assert [b.text for b in Page("<!-- a <p> --><p>b<!-- open").blocks] == ["b"]
    long = "word, " * 100_000
    assert main_text(f"<article><p>{long}</article>") == long.strip()


LONG = "A sentence, with a comma, that is part of the text. " * 40


def test_title_lead_and_last_section_outside_the_body():
    body = "".join(f"<p>{LONG}{n}</p>" for n in range(4))
    title, lead, last = "The title", "A lead, in short.", "The end, at last."
    for middle in ("", "<div class=date>1 May</div>"):
        page = f"<div id=page><h1>{title}</h1><p>{lead}</p>{middle}<div class=body>{body}</div>"
        page += f"<section><h2>Notes</h2><p>{last}</p></section></div>"
        found = main_text(f"<body><ul class=top><li><a href=/>Home</a><li><a href=/b>News</a></ul>{page}").split("\n\n")
        assert found[:2] == [title, lead] and found[-2:] == ["Notes", last]
        assert len(found) == 8 + (middle != "") and "Home" not in found
    for tag, around in (("div", "div"), ("section", "body"), ("article", "main")):
        parts = f"<{tag}>{body}{body}</{tag}><{tag}><p>{LONG}</p></{tag}>"
        assert len(main_text(f"<{around}>{parts}</{around}>").split("\n\n")) == 9


def test_words_of_ids_and_classes_do_not_drop_main_text():
    page = f"""<h1 id=menu>Title</h1><p>{LONG}</p><h2 id=related-work>Related work</h2><p id=share>{LONG}</p>
    <h2 id=navigation>Navigation</h2><section id=search-results><h3>Found</h3><p>{LONG}</p></section>
    <p class=notice-period>Three months</p><div class=share-price>12 EUR</div><p>If <span class=ad>a</span> is
    <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/></math>, so.</p><svg><desc>d</desc><path d="M1"/><text>Label</text></svg>
    <ul class=share><li><a href=/t>Tweet</a><li><a href=/m>Mail</a></ul><div class=widget><a href=/x>More</a> now</div>"""
    expected = ["Title", LONG.strip(), "Related work", LONG.strip(), "Navigation", "Found", LONG.strip(), "Three months"]
    expected += ["12 EUR", "If a is x=2, so.", "Label"]
    for tag in ("article", "main"):
        assert main_text(f"<body><div class=menu>Menu, m.</div><{tag}>{page}</{tag}></body>").split("\n\n") == expected
    heads = f"<div><h1 id=menu>Title</h1><p id=share>{LONG}</p><h2 id=related-work>Related work</h2><p>{LONG}</p></div>"
    assert main_text(heads).split("\n\n") == ["Title", LONG.strip(), "Related work", LONG.strip()]


ASIDES = [
    "<div class=comments><p>Great post, I like it. Very, very much.</p><p>Me too, indeed, so much.</p></div>",
    "<section id=comments><h2>Comments</h2><p>Great post, I like it. Very, very much.</p></section>",
    "<ol class='comment-list'><li>First, of all.</li><li>Second, of all.</li></ol>",
    "<div class=cookie-notice>We use cookies, on this page. Accept, please.</div>",
    "<div class='advert'>Buy this, and that. Now, or never.</div>",
    "<div id=adSlot3>Buy this, and that. Now, or never.</div>",
    "<p class=newsletter>Get our letter, each week, for free.</p>",
    "<div class='box sponsored'><p>Paid for, by someone, who sells. Things, too.</p></div>",
    "<div role=alert>A notice, to all, who read.</div>",
]
KEPT = [
    ("<div class=share-price>12 EUR</div>", "12 EUR"),
    ("<section id=search-results><h3>Found</h3><p>Words, found.</p></section>", "Found\n\nWords, found."),
    ("<p class=notice-period>Three months</p>", "Three months"),
    ("<h2 id=comments>On comments</h2>", "On comments"),
    ("<section class=cookie-recipes><p>Butter, sugar, flour.</p></section>", "Butter, sugar, flour."),
    ("<div class=menu-engineering>Engineering, of menus.</div>", "Engineering, of menus."),
]
BODY = "".join(f"<p>{LONG}{n}</p>" for n in range(3))
TEXT = "\n\n".join(f"{LONG}{n}" for n in range(3))
AROUND = [
    "<body>{}</body>", "<body><div id=page>{}</div></body>", "<article>{}</article>", "<main>{}</main>",
    "<div><div class=post>{}</div><div class=sidebar><p>Side, text.</div></div>",
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("aside", ASIDES)
def test_comments_notices_and_adverts_go_anywhere(around, aside):
    page = around.format(f"<h1>Title</h1>{BODY}{aside}<p>{LONG}end</p>")
    assert main_text(page) == f"Title\n\n{TEXT}\n\n{LONG}end"


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize(("piece", "text"), KEPT)
def test_names_with_other_words_mark_nothing(around, piece, text):
    page = around.format(f"<h1>Title</h1>{BODY}{piece}<p>{LONG}end</p>")
    assert main_text(page) == f"Title\n\n{TEXT}\n\n{text}\n\n{LONG}end"


def test_a_header_with_the_title_stays_and_that_of_the_site_goes():
    site = "<header><h1><a href=/>Site</a></h1><p>A site, of sorts.</p></header>"
    own = "<header><h1>Title</h1><p>By someone, today.</p></header>"
    for page in (
        f"<body>{site}<div class=post>{own}{BODY}</div></body>",
        f"<body>{site}<article>{own}{BODY}</article></body>",
        f"<body><div id=page>{site}<section>{own}{BODY}</section></div></body>",
    ):
        assert main_text(page) == f"Title\n\nBy someone, today.\n\n{TEXT}"
    assert main_text(f"<body><header><h1>Site</h1></header>{BODY}</body>") == TEXT


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 100_000 + "deep" + "</div>" * 100_000,
        "<b>" * 50_000 + "deep" + "</i>" * 50_000,
        "<b>" * 50_000 + "<div>x</div>" * 20_000,
        "<ul><li>" + "<b>" * 30_000 + "<ul><li>x</ul>" * 10_000,
        "<table>" + "<tr><td>x" * 50_000,
        "<div><p>x, y.</p>" * 30_000,
    ],
)
def test_deep_pages_take_time_by_their_length(source):
    began = time.process_time()
    assert main_text(source)
    assert time.process_time() - began < 10


def test_many_elements_in_svg():
    assert main_text("<p>a<svg>" + "<path d='M1'/>" * 50_000 + "</svg>b") == "ab"


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = {r.page_id: r for r in extract(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        blocks = [re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:h1|p)>|<br>", inner)]
        blocks = [" ".join(html.unescape(b).split()) for b in blocks]
        own = found[page.page_id]
        assert own.text == "\n\n".join(b for b in blocks if b)
        assert own.n_chars == len(own.text) and own.url == page.url


def test_awkward_rows(spark):
    rows = [(1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (None, None, None, "x", "y"), (2, "u", "", None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, key string")
    found = sorted(((r.page_id or 0, r.n_chars) for r in extract(pages).collect()))
    assert found == sorted([(1, len(main_text(PAGE)))] * 2 + [(0, 0), (2, 0)])
    assert extract(pages.limit(0)).count() == 0
