import random
import time

from enthyme.llm.html_text import extracted, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The &amp; title</h1><p><b>First   one.<br><p>Second &eacute; <i>two</i>&nbsp;three.</p><div class="ad">Buy!</div>
<script>var t="</p><p>no</p>";</script><p>S.</p><form><input><p>Name</p></form><ul><li>a<li>b</ul><section class="comments"><p>I disagree</p></section></article>
<aside>Related</aside><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "The & title\nFirst one.\nSecond é two three.\nS.\na\nb"


def test_without_article_the_surge_is_kept():
    body = "".join(f"<p>Paragraph {i} of the text, long enough to count as one.</p>" for i in range(6))
    page = f"<body><div class='menu'>Menu</div><div>{body}</div><div id=footer>Imprint</div></body>"
    text = main_text(page)
    assert text.count("\n") == 5 and "Menu" not in text and "Imprint" not in text


def test_short_regions_are_kept():
    body = "".join(f"<p>Paragraph {i} of the text, long enough to count as one.</p>" for i in range(9))
    page = f"<body><section>{body}</section><section><p>Short.</p></section><section>{body}<div class=ad>Buy</div><p>Last.</p></section></body>"
    text = main_text(page)
    assert "\nShort.\n" in text and text.endswith("\nLast.") and "Buy" not in text and text.count("\n") == 19


def test_no_page_is_lost_whole():
    assert main_text("<html><head><title>T</title><meta name=x><body><p>Text.</p></body></html>") == "Text."
    assert main_text("<head><title>T</title><link rel=x><p>Text.<p>More.") == "Text.\nMore." and main_text("<head><title>T</title>Text") == "Text"
    wrapped = "<body><div class='layout has-sidebar'><div class=sidebar>Side</div><{0}><p>Text.</p><div class=ad>Buy</div></{0}>after</div><p>Imprint</p></body>"
    assert main_text(wrapped.format("article")) == main_text(wrapped.format("main")) == "Text."
    assert main_text("<form><main><p>Text.</p></main></form>") == "Text."
    assert main_text("<div class='layout has-sidebar'><nav>Menu</nav><p>Text.</p></div>") == "Text."
    assert main_text("<div hidden><article>no</article></div><p>Text.</p>") == "Text."


def test_odd_pages(spark):
    assert main_text("") == "" and main_text("just text") == "just text" and main_text("<p") == "<p"
    assert main_text("<article><p>a < b &lt; c<p>d") == "a < b < c\nd"
    assert main_text("<script>x") == "" and main_text("<!-- a <p>b") == ""
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", long)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extracted(df).collect()
    assert len(got) == 4 and {r.text for r in got if r.page_id == 2} == {""}
    assert all(r.n_chars == len(r.text) for r in got)
    assert next(r.text for r in got if r.page_id is None).count("\n") == 19_999
    assert extracted(df.limit(0)).collect() == []


def test_pages_without_marks():
    """Menus are links, imprints are short; neither is marked by a name."""
    body = "".join(f"<p>Paragraph {i} of the text, long enough to count as one.</p>" for i in range(4))
    page = f"<div><a href=/>Home</a> <a href=/b>About</a></div><div><h2>Title</h2>{body}<p>See <a href=/c>this page</a> too.</p></div><div>Copyright 2020</div>"
    assert main_text(page).split("\n") == ["Title", *(f"Paragraph {i} of the text, long enough to count as one." for i in range(4)), "See this page too."]
    assert main_text("<div><a>Home</a> <a>About</a></div><div><p>Main text...</p></div><div>Copyright 2020</div>") == "Main text..."
    assert main_text(f"<section>My site</section><section>{body}</section><section>About us</section>").count("\n") == 3


def test_names_inside_an_article_are_whole_names():
    page = '<article><header class="entry-header"><h1>Title</h1></header><p title="unclosed>Text.</p><div class="notice-board">Body text</div><div class="notice">Notice</div></article>'
    assert main_text(page) == "Title\nText.\nBody text"


def test_time_is_linear():
    for page in ("<a '" * 200_000, "<b></i>" * 150_000, "<svg>" * 200_000, "<a =\">\" " * 100_000, "<div>" * 150_000 + "</b>" * 150_000, "<b><div></b>" * 80_000, "<!" * 200_000, "<p" * 200_000 + ">", "<p x='" * 100_001 + ">", "<h1>" * 150_000):
        begin = time.time()
        main_text(page)
        assert time.time() - begin < 15


def test_parts_with_other_names():
    page = """<main><h1>Title</h1><p>One.</p><div class="comment"><p>No.</p></div><section id="comments-section"><p>No.</p></section><div class="promo-box">No.</div>
    <div class="advertisement-block">No.</div><div class="post-comments">No.</div><p>Two.</p><div class="social-history">Kept</div></main><article class="teaser"><p>Another page.</p></article>
    <article class="comment"><p>No.</p></article>"""
    assert main_text(page) == "Title\nOne.\nTwo.\nKept"
    assert main_text('<article class="card"><p>All there is.</p></article>') == "All there is."
    two = "<article><p>First article.</p></article><div>between</div><article><p>Second article</p></article>"
    assert main_text(two) == "First article.\nSecond article" and main_text(two + two).count("First article.") == 2


def test_regions_beside_the_text_belong_to_its_element():
    body = "".join(f"<p>Paragraph {i} of the text, long enough to count as one.</p>" for i in range(4))
    text = main_text(f"<h1>Title</h1><section></section><div>{body}<div class=ad>Buy</div><p>Last.</p></div><section></section><div>Buy our things now.</div>")
    assert text.startswith("Title\n") and text.endswith("Last.") and "Buy" not in text


LAYOUTS = {
    "article": "<article>{}</article>",
    "main": "<main><div>{}</div></main>",
    "content": '<div id="content"><div class="inner">{}</div></div>',
    "sections": "<section>{}</section>",
    "table": "<table><tr><td>{}</td></tr></table>",
    "bare": "{}",
}


def planted(rng, layout):
    """(html, lines of the article): headings, paragraphs of any length, lists, marked and unmarked parts around and inside."""
    say = lambda a, b: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(a, b)))
    links = lambda: "<div>" + " | ".join(f"<a href=/x>{say(1, 3)}</a>" for _ in range(rng.randrange(3, 9))) + "</div>"
    article, lines = "", []
    for k in range(rng.randrange(3, 12)):
        tag, text = ("h2", say(2, 6)) if k % 4 == 0 else ("p", say(15, 90) + ".") if rng.random() < 0.8 else ("p", say(1, 6) + ".")
        article += f"<{tag}>{text}</{tag}>"
        lines.append(text)
        if rng.random() < 0.3:
            article += rng.choice(['<div class="ad">Buy {}!</div>', '<aside>{}</aside>', "<form><label>{}</label></form>", '<div class="share-buttons">{}</div>', "<script>var x='{}'</script>"]).format(say(2, 8))
    before = [links() if rng.random() < 0.5 else f"<nav>{links()}</nav>", f"<header>{say(2, 5)}</header>", f'<div class="cookie-banner">{say(5, 20)}.</div>']
    after = [f"<footer>{say(3, 12)}.</footer>", links(), "<div>Copyright 2020 " + say(1, 3) + "</div>", f'<div class="comments"><p>{say(5, 40)}.</p></div>']
    return "<html><head><title>T</title></head><body>" + "".join(before) + "<section></section>" + LAYOUTS[layout].format(article) + "<section></section>" + "".join(rng.sample(after, 3)) + "</body></html>", lines


def test_recall_and_precision_by_layout():
    rng = random.Random(5)
    for layout in LAYOUTS:
        right = wanted = found = 0
        for _ in range(60):
            page, lines = planted(rng, layout)
            got = main_text(page).split("\n")
            right += len(set(got) & set(lines))
            wanted += len(lines)
            found += len(got)
        assert right >= 0.95 * wanted and right >= 0.95 * found, (layout, right / wanted, right / found)
