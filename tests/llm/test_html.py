import itertools
import random

from recollect.llm import html

PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this, now.</div>
<div id="cookie-notice"><p>We use cookies, dear reader. Please agree.</p></div>
<article><header><h1>The   title &quot;x&quot;</h1></header><p><b>First
 line&nbsp;here.<br><p>Second <a href="x>y">linked</a> wor<i>d</i>, &eacute;&#233;.</p><ul><li>One<li>Two</ul><table><tr><td>c1<td>c2</table>
<aside>Related</aside><form><input name=a><label>Name</label></form><div class="comments"><p>Great article, thanks for it.</p></div></article>
<footer>&copy; nobody</footer>"""


def brute(gains, edges):
    best = None
    for label in itertools.product([False, True], repeat=len(gains)):
        cost = sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gains, label, strict=True)) + sum(c for a, b, c in edges if label[a] != label[b])
        if best is None or cost < best - 1e-9:
            best = cost
    return best


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 9)
        gains = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        for label in (html.minimum_cut(gains, edges), html.max_flow_side(n, gains, edges)):
            cost = sum(max(g, 0) if not x else max(-g, 0) for g, x in zip(gains, label, strict=True)) + sum(c for a, b, c in edges if label[a] != label[b])
            assert abs(cost - brute(gains, edges)) < 1e-6


def test_article():
    assert html.main_text(PAGE).split("\n") == ['The title "x"', "First line here.", "Second linked word, éé.", "One", "Two", "c1", "c2"]


def test_page_without_article():
    body = "".join(f"<p>Sentence {i} of the text, long enough to be read as prose. It goes on and on.</p>" for i in range(5))
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(9))
    text = html.main_text(f"<body><ul>{links}</ul><div>{body}<p>Short.</p>{body}</div><ul>{links}</ul></body>")
    assert "Link" not in text and text.count("Sentence") == 10 and "Short." in text


def test_odd_pages(spark):
    rows = [(1, "u", PAGE, 5, "t"), (2, None, None, 5, "t"), (None, "v", "", 5, "t"), (3, "w", "plain < text > only, without any element at all, and rather long so.", 5, "t"), (3, "w", "<p", 5, "t"), (4, "x", "<article>" + "<p>Word, word. " * 20000, 5, "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()
    assert [(r["page_id"], r["url"]) for r in got] == [(r[0], r[1]) for r in rows]
    assert got[1]["text"] == got[2]["text"] == "" and got[3]["text"].startswith("plain < text")
    assert got[5]["text"].count("\n") == 19999 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
