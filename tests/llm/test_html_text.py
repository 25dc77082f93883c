import random
import re

from seamstat.llm import html_text
from seamstat.llm.html_text import main_text

PARAGRAPH = "A paragraph of the article with enough words to stand out from the menus around it, and a comma or two."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="home ad">
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <div id="sidebar"><p>{PARAGRAPH.replace('article', 'sidebar')}</p></div><!-- no > comment -->
    <article><header><h1>Title</h1></header><p>{PARAGRAPH}<br>And <b>b</b>old &amp; caf&eacute; &#x41;&nbsp;end.</p><aside>Aside</aside>
    <form><label>Mail</label><input name=x></form><p>No.</p><div class="adBox">Buy</div><p title="a > b">5 < 6</p><div class=comments><p>First!</p></div></article>
    <div class="ad">Advert</div><section id="comments"><article class="comment"><p>{PARAGRAPH}</p></article></section><footer>&copy; x</footer></body></html>"""
    assert main_text(page) == f"Title {PARAGRAPH} And bold & café A end. No. 5 < 6"


def test_page_without_landmarks_uses_the_line_blocks():
    menu = "".join(f'<li><a href="/{i}">Item {i} of the menu</a></li>' for i in range(30))
    page = f"<body><ul>{menu}</ul><div>Short note</div><div class='nav'>x</div><div><h1>Head</h1><p>{PARAGRAPH}</p><p>Yes.</p></div><div class=footer>f</div><p>tail</p></body>"
    assert main_text(page) == f"Head {PARAGRAPH} Yes."
    assert main_text("<p>tiny</p>") == "tiny" and main_text("just text &lt;b&gt;") == "just text <b>"


def test_malformed_pages():
    assert main_text(None) == main_text("") == main_text("<") [:0] == ""
    assert main_text(f'<div class="ad">unclosed <article><p>{PARAGRAPH}') == PARAGRAPH
    assert main_text(f"<article><p>{PARAGRAPH}</article></article></div><nav>") == PARAGRAPH
    assert main_text(f"<article>{PARAGRAPH}</article><script>never closed <p>x</p>") == PARAGRAPH
    assert main_text(f"<article><div><article>inner</article></div>{PARAGRAPH}</article>") == f"inner {PARAGRAPH}"
    assert main_text("<article><p class='a' b=\"unclosed>text</article>" + "<p>" * 3) == "text"
    long = " ".join(f"w{i}" for i in range(100_000))
    assert main_text(f"<article><p>{long}</p></article>") == long


def test_given_pages_equal_their_articles(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for row in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|$)", row["html"], re.DOTALL)[1]
        blocks = re.split(r"<(?!/?b>)[^>]*>", re.sub(r"</?b>", "", inside))
        want = " ".join(" ".join(html.unescape(b).split()) for b in blocks if html.unescape(b).strip())
        found = got[row["page_id"]]
        assert (found["url"], found["text"], found["n_chars"]) == (row["url"], want, len(want))


def test_table_edges(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "x", 1), (None, "u", "", None, None), (2, "u", "<p>a</p>", "x", 1), (2, "u", "<p>a</p>", "x", 1)]
    got = [tuple(r) for r in html_text.extract(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(1, None, "", 0), (None, "u", "", 0), (2, "u", "a", 1), (2, "u", "a", 1)]
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_text_between_adverts_on_unmarked_pages():
    closing = "A closing sentence of about sixty characters after the advert."
    advert = "<div class=ad>Buy now</div>"
    assert main_text(f"<div>{PARAGRAPH}</div>{advert}<p>{closing}</p>") == f"{PARAGRAPH} {closing}"
    inner = f"<form>Mail</form><h2>Head</h2><aside>Aside</aside><p>Short.</p>{advert}"
    assert main_text(f"<div><p>{PARAGRAPH}</p>{advert}{inner}<p>{closing}</p></div>") == f"{PARAGRAPH} Head Short. {closing}"
    assert main_text(f"<p>{PARAGRAPH}</p><nav>n</nav><p>Short.</p><nav>n</nav><p>{PARAGRAPH}</p>") == f"{PARAGRAPH} Short. {PARAGRAPH}"


def test_names_that_only_mention_boilerplate():
    for tag in ('article class="post comments-open"', 'div id="content" class="has-sidebar"', 'main class="menu"', 'div class="no-comments"'):
        assert main_text(f"<{tag}><p>{PARAGRAPH}</p></{tag.split()[0]}>") == PARAGRAPH
    for name in ("sidebar-left", "adBox", "cookie-notice", "post-comments", "ad-300x250", "navBar"):
        assert main_text(f'<p>{PARAGRAPH}</p><div class="{name}"><p>{PARAGRAPH}</p></div>') == PARAGRAPH


def test_marks_weigh_lines_and_do_not_decide_alone():
    story = " ".join([PARAGRAPH] * 3)
    assert main_text(f"<article class=card>Other</article><div>{story}</div>") == story
    assert main_text(f"<article><a href=/x>Read this next</a> and more</article><div><p>{story}</p><p>End.</p></div>") == f"{story} End."
    assert main_text(f"<div>{PARAGRAPH}</div><article><p>{story}</p><p>{story}</p></article><div>Short</div>") == f"{story} {story}"
    assert main_text(f"<article>One.</article><div>junk</div><article>{story}</article>") == f"One. {story}"


def test_links_inside_a_region_stay():
    link = "<a href=/source>The source of all this</a>"
    page = f"<ul><li>{link}</li></ul><div><p>{PARAGRAPH}</p><p>{link}</p><p>{PARAGRAPH}</p><ul><li>{link}</li></ul><p>{PARAGRAPH}</p><p>{link}</p></div>"
    text = "The source of all this"
    assert main_text(page) == f"{PARAGRAPH} {text} {PARAGRAPH} {text} {PARAGRAPH} {text}"


def plainly(blocks):
    """Surge and dive on pages without marks, line by line."""
    lines = []
    for kind, text in blocks:
        lines += [("", 0)] * 3 if kind == "gap" else [(text, 0 if kind == "link" else len(text))]
    n = len(lines)
    sums = [sum(size for _, size in lines[max(i - 2, 0) : i + 1]) for i in range(n + 2)]
    found, i = [], 0
    while i < n + 2:
        if sums[i] == 0:
            i += 1
            continue
        j = i
        while j < n + 2 and sums[j] > 0:
            j += 1
        found.append((i, j - 2, max(sums[i:j])))
        i = j
    if not found:
        return ""
    least = min(86, max(high for _, _, high in found))
    kept = [k for k, (_, _, high) in enumerate(found) if high >= least]
    return " ".join(text for a, b, _ in found[kept[0] : kept[-1] + 1] for text, _ in lines[a:b] if text)


def test_random_pages_without_marks_equal_plain_window_sums():
    draw = random.Random(8)
    for _ in range(400):
        blocks = []
        for _ in range(draw.randint(0, 25)):
            kind = draw.choice(["text", "text", "text", "link", "link", "gap"])
            blocks.append((kind, " ".join(f"{draw.choice('abc')}{k}" for k in range(draw.choice([1, 3, 8, 20])))))
        shapes = {"text": "<div>{}</div>", "link": "<li><a href=/>{}</a></li>", "gap": "<nav>{}</nav>"}
        assert main_text("".join(shapes[kind].format(text) for kind, text in blocks)) == plainly(blocks)
