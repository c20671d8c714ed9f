import random
import re

import pytest

from seqspark.llm.pages import extract, main_text

ARTICLE = "<h1>Title &amp; more</h1><p><b>First text,\n  with   spaces.<br><p>Second &eacute;&#233; text.</p><p>Short.</p>"
WANT = "Title & more\nFirst text, with spaces.\nSecond éé text.\nShort."
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Menu</a></li>'
    '</ul></nav><!-- ad <p>x</p> --><div class="ad">Buy this now, it is a very good thing to buy and to own for ever.</div><article>%s</article>'
    "<footer>&copy; someone &middot; A rather long sentence that is only in the footer of the page.</footer></body></html>"
)


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain text only", "plain text only"), (PAGE % ARTICLE, WANT), (PAGE % "", ""), (PAGE % "<p>Of.</p>", "Of."),
    (PAGE % (ARTICLE + '<aside class="related">Other <p>things</p></aside><form><label>Mail</label><input></form><p>End.'), WANT + "\nEnd."),
    (PAGE % (ARTICLE + '<section id="comments"><h2>Comments</h2><p>I liked it a lot, thank you very much for it.</p></section>'), WANT),
    (PAGE % (ARTICLE + '<div class="cookie-notice">We use cookies</div>' * 9 + "<p>End.</p>"), WANT + "\nEnd."),
    ((PAGE % ARTICLE)[: (PAGE % ARTICLE).index("</article>")], WANT), (PAGE % "<p>a &am b &amp c &notit; d</p>", "a &am b & c ¬it; d"),
    (PAGE % "<ul><li>one<li>two</ul><table><tr><td>x<td>y</table>", "one\ntwo\nx\ny"), (PAGE % "<p>1 < 2 <i>and</i><b>so</b> on</p>", "1 < 2 andso on"),
    (PAGE.replace("article", "div") % ("<p>" + "long enough text of a page without any article, " * 3 + "</p><p>And more of it here.</p>"),
     ("long enough text of a page without any article, " * 3).strip() + "\nAnd more of it here."),
    ("<p>" + "w" * 200_000 + "</p>", "w" * 200_000), ("<div hidden>no</div><main><p>yes</p></main>", "yes"), ("<<<>>>&&&", "<<<>>>&&&"),
])
def test_extract(html, text):
    assert extract(html) == text


BODY = "<h1>Title</h1>" + "".join(f"<p>Sentence {i} of the article, which is long enough to be read as text.</p>" for i in range(4))
LINES = "\n".join(["Title", *(f"Sentence {i} of the article, which is long enough to be read as text." for i in range(4))])
REST = '<nav class="menu"><a href="/">Home</a></nav>%s<div class="sidebar">Words beside it.</div><div id="site-footer">Words below the page.</div>'


@pytest.mark.parametrize("wrapper", [
    "<div id=page class='has-sidebar'>%s</div>", "<div class='no-sidebar'>%s</div>", "<div class='layout-with-sidebar'>%s</div>",
    "<div class='nav-open x'>%s</div>", "<form id=aspnetForm>%s</form>", "<div class=sidebar>%s</div>", "<div id=widget><form>%s</form></div>",
])
@pytest.mark.parametrize("inner", ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>"])
def test_an_element_around_the_page_is_read(wrapper, inner):
    assert extract("<body>" + wrapper % (REST % (inner % BODY)) + "</body>") == LINES
    assert extract("<body>" + REST % (wrapper % (inner % BODY)) + "</body>") == LINES
    assert extract("<body>" + REST % (inner % (wrapper % BODY)) + "</body>") == LINES


def test_marked_elements_beside_the_text_stay_unread():
    teaser = "<article><p>A teaser of another page, which is long enough to be read as text.</p></article>"
    remarks = "<article class=comment><p>" + "A long remark on it. " * 100 + "</p></article>"
    for inner in ("<article>%s</article>", "<div>%s</div>"):
        for beside in (f"<aside>{teaser}</aside>", f"<div class=sidebar>{teaser}</div>", f"<div id=comments>{remarks}</div>", f"<div hidden>{remarks}</div>"):
            assert extract("<body>" + REST % (inner % BODY + beside) + "</body>") == LINES
    assert extract(f"<article>{BODY}<section id=comments>{remarks}</section></article>") == LINES
    assert extract(f"<main>{BODY}</main><main hidden>{remarks}</main>") == LINES


HALF = "".join(f"<p>Sentence {i} of the page, which is long enough to be read as text of it.</p>" for i in range(3))
MORE = HALF.replace("Sentence", "Clause")
LINKS = "<ul>" + '<li><a href="/x">See also</a></li>' * 3 + "</ul>"


def texts(html):
    return re.sub(r"<[^>]*>", "", re.sub(r"</(?:p|h1|h2|li)>", "\n", html)).strip().split("\n")


@pytest.mark.parametrize("page,want", [
    (f"<div>{HALF}<script>a</script><script>b</script><script>c</script>{MORE}</div>", HALF + MORE),
    (f"<div>{HALF}{LINKS}{MORE}</div>", HALF + LINKS + MORE), (f"{HALF}{LINKS}{MORE}", HALF + LINKS + MORE),
    (f"<div><section>{HALF}</section>{LINKS}<section>{MORE}</section></div>", HALF + LINKS + MORE),
    (f"<div><h1>Title</h1><p>By A B</p><p>1 May</p>{LINKS}{HALF}</div>", f"<h1>Title</h1><p>By A B</p><p>1 May</p>{LINKS}{HALF}"),
    (f"<h1>Title</h1><p>By A B</p><p>1 May</p><div>{HALF}</div>", f"<h1>Title</h1><p>By A B</p><p>1 May</p>{HALF}"),
    (f"<div><header><h1>Title</h1></header>{HALF}</div>", "<h1>Title</h1>" + HALF),
    (f"<div><header><h1><a href=/>Site</a></h1></header><h1>Title</h1>{HALF}</div>", "<h1>Title</h1>" + HALF),
    (f"<div><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div><h2>Title</h2>{HALF}</div></div>", "<h2>Title</h2>" + HALF),
    (f"<article><p>A teaser of some other page.</p></article><div><h1>Title</h1>{HALF}</div>", "<h1>Title</h1>" + HALF),
    (f"<article>{HALF}<div class='share-buttons'>Tell friends</div><div class=adsbygoogle>Buy now</div>{MORE}</article>", HALF + MORE),
])
def test_no_text_of_the_article_is_lost(page, want):
    for around in ("%s", "<nav><a href=/>Home</a></nav>%s<footer>Words below the page, more than sixty characters of them here.</footer>"):
        assert extract(f"<html><head><title>T</title></head><body>{around % page}</body></html>").split("\n") == texts(want)


def test_generated_pages_without_a_container():
    """Wrappers, scripts, lists and adverts at random places: all blocks of the text come out, none of the rest."""
    for seed in range(300):
        rng = random.Random(seed)
        want, body = ["A title"], ["<h1>A title</h1>"]
        for i in range(rng.randint(3, 12)):
            if rng.random() < 0.3:
                body.append("<script>var a = '<p>';</script>" * rng.randint(1, 5))
            if rng.random() < 0.2:
                body.append('<div class="ad">Buy this now, it is a very good thing to have and to keep.</div>')
            kind = rng.choice(["p", "p", "p", "short", "list", "links", "h2"])
            text = f"Block {i} of the text " + "with some words " * (0 if kind in ("short", "h2") else rng.randint(3, 20))
            lines = [f"{text.strip()} {k}" for k in range(rng.randint(3, 5) if kind in ("list", "links") else 1)]
            if kind in ("list", "links"):
                inner = "".join(f"<li><a href=x>{x}</a></li>" if kind == "links" else f"<li>{x}</li>" for x in lines)
                body.append(f"<ul>{inner}</ul>")
            else:
                body.append("<{0}>{1}</{0}>".format("h2" if kind == "h2" else "p", lines[0]))
            want += lines
        want.append("The last paragraph closes the page with a sentence of more than sixty characters.")
        body.append(f"<p>{want[-1]}</p>")
        page = "".join(body)
        for _ in range(rng.randint(1, 4)):
            page = f'<div class="{rng.choice(["page", "x1", "wrapper", "has-sidebar", "content"])}">{page}</div>'
        page = f'<header><h2>Site</h2></header><nav><a href="/">Home</a></nav>{page}<div class="sidebar">Words beside it.</div><footer>Words below it.</footer>'
        assert extract(f"<html><body>{page}</body></html>").split("\n") == want, seed


def test_every_page_of_the_table(spark):
    """Between the article's tags stand all of its blocks, and nothing else of the page is text."""
    import html as h

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r for r in main_text(pages).collect()}
    for p in pages.collect():
        inner = p["html"].partition("<article>")[2].partition("</article>")[0]
        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(h.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in blocks]
        assert found[p["page_id"]]["text"] == "\n".join(b for b in want if b)
        assert found[p["page_id"]]["n_chars"] == len(found[p["page_id"]]["text"]) and found[p["page_id"]]["url"] == p["url"]


def test_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "<p>x</p>", "clash", "y"), (1, None, "<p>x</p>", "clash", "y")], "page_id long, url string, html string, text string, n_words string")
    assert [r.asDict() for r in main_text(df).collect()] == [{"page_id": 1, "url": None, "n_words": "y", "text": "x", "n_chars": 1}] * 2
    assert main_text(df.limit(0)).collect() == []
