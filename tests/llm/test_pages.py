"""Main text of pages: templates by recurrence, boilerplate by name, tolerant parsing."""

import html as refs
import re

import pytest

from tests.conftest import SF
from tickforge.llm import page_text
from tickforge.llm.page_text import extract

SCHEMA = "page_id long, url string, html string"


def brute(page):
    """Text of the article of the given tables' pages, by splitting at its paragraphs."""
    inside = re.search("<article>(.*?)</article>", page, re.S).group(1)
    blocks = [" ".join(refs.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    got = {r.page_id: r for r in page_text.op13_site_templates(spark, SF.replace("0.001", "0.01")).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) and all(got[r.page_id].text == brute(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) for r in rows)
    assert sum(r.n_templates for r in got.values()) > 0


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<p>a<br>b</p>c", "a b\n\nc"), ("<p>&lt;b&gt; &amp;amp; &#233;&#x1F642;</p>", "<b> &amp; é🙂"),
    ("<div>one<b>two</b> three</div>", "onetwo three"), ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"), ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style>yes", "yes"), ("<script>never closed <p>no", ""), ("<title>t</title><body><p>x&nbsp;\n y</p>", "x y"),
    ("<nav>m</nav><header>h</header><main><h1>T</h1><p>x</p></main><footer>f</footer>", "T\n\nx"),
    ("<article><header><h1>T</h1></header><p>x</p><aside>s</aside><section class='comments'><p>c</p></section><article>reply</article></article><p>out</p>", "T\n\nx"),
    ("<div id='cookie-notice'>c</div><div class='post-body'><p>x</p></div><form>f<input></form><div class='widgetAd'>a</div>", "x"),
    ("<body class='has-sidebar'><div class='layout with sidebar'><article><p>x</p></article></div>", "x"), ("<p hidden>h</p><p style='display: none'>n</p><p>x</p>", "x"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"), ("<p><b>a<p>c</b>d", "a\n\ncd"),
    ("<main><h1>T</h1><article><p>x</p></article></main>", "T\n\nx"), ('<p title="a>b">x</p>', "x"), ("<p class=\"open>x</p><p>y", "x\n\ny"), ("</p></div>x", "x"),
    ("<pre> a\n  b </pre>", "a b"), ("<noscript>on</noscript><svg><text>g</text></svg>x", "x"), ("<a<p>x", "x")])
def test_parsing(source, want):
    assert extract(source) == want


def test_templates_by_recurrence(spark):
    """Nameless blocks that recur with different texts go; copies, shared passages, other hosts and big blocks stay."""
    passage = "a passage that many articles of this host share " * 8
    rows, want = [], {}
    for i in range(40):
        own = " ".join(f"w{i}x{j}" for j in range(80))
        body = f"<div class=x1><span>Latest news</span><ul><li>one<li>two</ul></div><div><p>{own}</p><p>{passage}</p></div><div>Imprint</div>"
        rows.append((i, "http://a.example.com/" + str(i), body))
        want[i] = own + "\n\n" + passage.strip()
    copy = " ".join(f"c{j}" for j in range(80))
    for i in range(100, 130):  # copies of one page, and of one article in differing pages
        rows.append((i, "http://b.example.com/", f"<div>nav</div><div><p>{copy}</p></div>"))
        want[i] = "nav\n\n" + copy
        rows.append((i + 100, "http://c.example.com/", f"<p>{i}</p><article><div><p>{copy}</p></div><div>{i}</div></article>"))
        want[i + 100] = copy + f"\n\n{i}"
    for i in range(300, 340):  # a block inside articles
        own = " ".join(f"v{i}x{j}" for j in range(30))
        rows.append((i, "http://d.example.com/", f"<article><p>{own}</p><p>{passage}</p><div>Read our other pages</div></article>"))
        want[i] = own + "\n\n" + passage.strip()
    rows += [(400, "http://e.example.com/", "<div>Imprint</div><p>x</p>"), (401, None, None), (402, "no host", "")]
    want |= {400: "Imprint\n\nx", 401: "", 402: ""}
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", host int, k1 int")
    # the shared passage of host a is no article's: it would be template there, if it were not half of each page
    got = {r.page_id: r.text for r in page_text.extract_pages(df).collect()}
    assert {k: got[k] for k in want if k >= 100} == {k: v for k, v in want.items() if k >= 100}
    assert all(got[i].startswith(f"w{i}x0 ") and "Imprint" not in got[i] and "news" not in got[i] and "two" not in got[i] for i in range(40))


def test_repeated_rows_empty_and_long(spark):
    long = "<article>" + "<p>" + "word " * 20 + "</p>" * 20_000 + "<div>" * 5_000 + "x"
    rows = [(1, "http://h/", "<p>x</p>")] * 5 + [(None, None, None)] * 3 + [(2, "http://h/", long)]
    got = page_text.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 9 and sorted(r.text for r in got if r.page_id == 1) == ["x"] * 5 and all(r.text == "" for r in got if r.page_id is None)
    assert next(r for r in got if r.page_id == 2).n_chars == 99 + 3
    assert page_text.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0
