import pytest

from cloudloom.llm import htmltext as H


@pytest.fixture(scope="module")
def chain():
    return H.trained()


def test_unseen_labelled_pages(chain):
    right = total = 0
    for page, labels in H.labelled_pages(150, seed=12345):
        found = chain.decode(H.featurise(H.leaf_blocks(page)))
        right += sum(a == b for a, b in zip(found, labels, strict=True))
        total += len(labels)
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies.</p></div><header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href=/b>News</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy now.</div><article><h1>Tom &amp; J&eacute;r&#xF4;me</h1><p>First <b>bo</b>ld
  line.<br>Next&nbsp;one, with more words in it.<p>Unclosed &lt;tag&gt; text, and a few words more.</p><script>x()</script><aside><h3>Related</h3><a href="/x">Other story</a></aside>
<p>Last paragraph of the story, with an <a href="/y">inline link</a> in it.</p></article>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Nice article!</p></div></section><form><label>Name</label><input><button>Send</button></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_page(chain):
    assert H.main_text(PAGE, chain) == "Tom & J\u00e9r\u00f4me First bold line. Next one, with more words in it. Unclosed <tag> text, and a few words more. Last paragraph of the story, with an inline link in it."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</p></p>", "<!-- never closed", "<script>x", "<" * 500, "<div>" * 3000, "&amp;&bogus;&#99999999;"])
def test_odd_pages(chain, page):
    assert isinstance(H.main_text(page, chain), str)


def test_long_page(chain):
    text = " ".join(f"word{i}," for i in range(60_000)) + " end."
    assert H.main_text(f"<nav><a>x</a></nav><article><h1>Title here</h1><p>{text}</p></article>", chain) == f"Title here {text}"


def test_table(spark, chain):
    rows = [(1, "u", PAGE, "old"), (2, None, None, None), (3, "v", "", "x"), (1, "u", PAGE, "old")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), chain)
    found = sorted((r.page_id, r.text) for r in got.collect())
    assert [t for _, t in found] == [found[0][1], found[0][1], "", ""] and found[0][1].startswith("Tom") and got.columns == ["page_id", "url", "html", "text"]
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string"), chain).count() == 0


def test_pages(spark, chain):
    """All pages of the table hold one article, whose blocks are known."""
    import html
    import re

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert H.main_text(r.html, chain) == " ".join(b for b in blocks if b)


@pytest.mark.parametrize("head", ["<head>", "<head lang=en><meta charset=utf-8><link href=x><base href=/>", "<HEAD><script>a</script><noscript>no</noscript>", "<head><head>"])
@pytest.mark.parametrize("body", ["<body>", "<BODY class=x>", ""])
def test_open_head(chain, head, body):
    """A head without an end tag ends where what can't stand in it begins."""
    opened = PAGE.replace("<head>", head).replace("</head><body>", body)
    assert "</head>" not in opened and H.main_text(opened, chain) == H.main_text(PAGE, chain) != ""


def test_text_ends_head():
    assert [b[0] for b in H.leaf_blocks("<html><head><title>T</title> \n Plain text.<p>More.")] == ["Plain text.", "More."]
    assert H.leaf_blocks("<head><title>T</title><style>p{}</style></head>") == []


@pytest.mark.parametrize("opened", ["<svg><path d=x>", "<object data=x>", "<canvas>", "<noscript>", "<iframe src=x>", "<select>", "<textarea>", "<template>", "<math>"])
def test_unclosed_silent_elements(chain, opened):
    """They don't swallow what follows."""
    page = PAGE.replace("<p>Unclosed", opened + "<p>Unclosed").replace("</style>", "</style>", 1)
    assert "Last paragraph of the story" in H.main_text(page, chain) and "Unclosed <tag> text" in H.main_text(page, chain)


def test_objects_and_mathematics(chain):
    page = PAGE.replace("<b>bo</b>ld", "<b>bo</b>ld <math><mi>x</mi></math> <object data=f>shown instead</object>")
    assert "x" in H.main_text(page, chain).split() and "shown instead" in H.main_text(page, chain)


def test_deep_pages_are_fast(chain):
    import time

    page = "".join(f'<div class="a{i}"><p>text {i} here</p>' for i in range(20_000))
    start = time.time()
    H.main_text(page, chain)
    assert time.time() - start < 20
