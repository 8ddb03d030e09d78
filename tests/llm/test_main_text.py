import html
import re

import duckdb
from casewatch.llm import main_text as mt

PROSE = "Long prose, with commas, and enough words to count as a paragraph of an article, surely. "


def test_pages_of_the_table():
    for h, in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        inner = h[h.index("<article>") + 9 : h.index("</article>")]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip()
                for b in re.split(r"</?(?:p|h1)>", inner)]
        assert mt.main_text(h) == "\n\n".join(b for b in want if b)


def test_scoring_without_an_article_element():
    page = f"""<body><div id=top><ul class="menu"><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
      <div class="cookie-notice"><p>{PROSE * 3}</p></div>
      <div class="story"><h2>Title</h2><p>{PROSE}</p><p>A &amp; B&nbsp;&#233;, {PROSE}</p><div class="comments"><p>{PROSE * 9}</p></div></div>
      <div class="links"><p><a href=x>{PROSE * 3}</a></p></div><form><p>{PROSE}</p></form><script>var x="<p>no</p>"</script>
      <aside><p>{PROSE * 5}</p></aside><footer><p>{PROSE * 5}</p></footer></body>"""
    assert mt.main_text(page) == "\n\n".join(["Title", PROSE.strip(), f"A & B é, {PROSE.strip()}"])


def test_broken_and_deep_markup():
    assert mt.main_text("") == "" and mt.main_text("<nav>only a menu</nav>") == ""
    assert mt.main_text("<div>" * 3000 + f"<p>{PROSE}") == PROSE.strip()
    assert mt.main_text(f"<article><p>{PROSE}<p>x <b>y<ul><li>z<li>w</ul></article></div></div>") == f"{PROSE.strip()}\n\nx y\n\nz\n\nw"


def test_siblings_of_an_article_stay():
    page = f"<main><h1>Title</h1><p>lead</p><article><p>{PROSE * 4}</p></article><h3>More</h3><p>rest</p><ul><li><a href=x>{PROSE}</a></ul></main>"
    assert mt.main_text(f"<body><nav>Menu</nav>{page}<footer>end</footer>") == "\n\n".join(["Title", "lead", (PROSE * 4).strip(), "More", "rest"])
    parts = [f"Part {i}. {PROSE.strip()}" for i in range(4)] + ["A short last part, too."]
    assert mt.main_text("<div>" + "".join(f"<article><p>{p}</p></article>" for p in parts) + "</div>") == "\n\n".join(parts)


def test_names_of_the_whole_page_and_an_open_head():
    story, want = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>", "\n\n".join(["Title", PROSE.strip(), PROSE.strip()])
    notes = f"<div class='comments'><article><p>{PROSE * 9}</p></article></div><div class='sidebar'><p>{PROSE}</p></div>"
    for name in ("content has-sidebar", "no-comments post", "site sticky-header", "widget"):
        assert mt.main_text(f"<body><div class='{name}'>{story}<div class=ad>Buy {PROSE}</div></div><p>end</p></body>").startswith(want)
        page = f"<body><div id=x class='{name}'><article>{story}</article>{notes}</div></body>"
        assert mt.main_text(page) == want
    assert mt.main_text(f"<html><head><title>T</title><meta charset=utf-8><body>{story}") == want
    assert mt.main_text(f"<head><title>T</title><div>{story}</div>") == want


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{PROSE}</p></article>"), (2, None, None), (None, "u", ""), (1, "u", f"<article><p>{PROSE}</p></article>")]
    pages = spark.createDataFrame([(*r, 3) for r in rows], "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in mt.extract(pages).collect()), key=str)
    good = (1, "u", PROSE.strip(), len(PROSE.strip()))
    assert got == sorted([good, good, (2, None, "", 0), (None, "u", "", 0)], key=str)
    assert mt.extract(pages.limit(0)).count() == 0
