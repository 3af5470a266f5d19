"""Whole pages: built from an article and what stands around it, so that the text to find is known."""

import html as entities
import random
import time

from recollect.llm import html

WORDS = "river stone garden letter morning window silver harbour quiet story market bridge winter paper music teacher island lantern valley orchard".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + rng.choice([".", "!", "?", ", & so on."])


def paragraph(rng):
    return " ".join(sentence(rng, rng.randint(6, 18)) for _ in range(rng.randint(2, 6)))


def links(rng, n):
    return "<ul>" + "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in rng.sample(WORDS, n)) + "</ul>"


def dressed(rng, text):
    """A paragraph as markup: references, inline elements, odd white space."""
    out = entities.escape(text, quote=False)
    first, _, rest = out.partition(" ")
    if rng.random() < 0.5:
        out = f"<b>{first}</b> <a href='#x'>{rest.split(' ')[0]}</a> {' '.join(rest.split(' ')[1:])}"
    return out.replace(" ", rng.choice([" ", " ", "\n  ", "&#32;", "<!-- c --> "]), 1)


def page(rng):
    blocks = [sentence(rng, 5).rstrip(".!?")] + [paragraph(rng) for _ in range(rng.randint(3, 8))]
    body = f"<h1>{dressed(rng, blocks[0])}</h1>" + "".join(f"<p>{dressed(rng, b)}</p>" if rng.random() < 0.8 else f"<blockquote>{dressed(rng, b)}</blockquote>" for b in blocks[1:])
    shell = rng.choice(["<article>{}</article>", "<main class='page'>{}</main>", '<div class="content no-sidebar">{}</div>', '<div id="post-body">{}</div>', "<div class='entry'><header class='entry-header'></header>{}</div>"])
    before = [f"<nav>{links(rng, 5)}</nav>", '<div class="cookie-notice">We use cookies. <button>Accept</button></div>', f"<header><a href='/'>Home</a> {sentence(rng, 3)}</header>", f'<div id="sidebar">{links(rng, 6)}</div>', "<script>var x = '<p>no</p>';</script>", "<style>p{}</style>"]
    after = [f"<aside>{links(rng, 4)}</aside>", f'<section class="comments"><div class="comment">{paragraph(rng)}</div></section>', f'<div class="ad-banner ads">{sentence(rng, 6)}</div>', "<form><label>Mail</label><input><button>Send</button></form>", f"<footer>Copyright {sentence(rng, 4)} <a href='/i'>Imprint</a></footer>", f'<div class="related">{links(rng, 4)}</div>']
    rng.shuffle(before)
    rng.shuffle(after)
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{''.join(before[: rng.randint(2, 6)])}{shell.format(body)}{''.join(after[: rng.randint(2, 6)])}</body></html>", "\n".join(blocks)


def test_articles_and_nothing_else(spark):
    rng = random.Random(8)
    made = [page(rng) for _ in range(200)]
    rows = [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(made)] + [(500, None, None, "x"), (None, "u", "", "x"), (0, "u0", made[0][0], "y")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(made)] + [(500, None, "", 0), (None, "u", "", 0), (0, "u0", made[0][1], len(made[0][1]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_long_and_broken_pages_are_read_once():
    body = "A long enough line of the article, which says something. "
    began = time.process_time()
    assert html.main_text("<div>" * 30_000 + body + "</div>" * 30_000) == body.strip()
    assert html.main_text("<article>" + "</p>" * 50_000 + f"<p>{body}</p></article>") == body.strip()
    assert html.main_text(f"<article><p>{body}</p>" + "<i title=\"" * 30_000).startswith(body.strip())
    assert html.main_text("<head>" * 30_000 + f"<p>{body}") == body.strip()
    assert len(html.main_text("<article>" + f"<p>{body}</p>" * 20_000 + "</article>").split("\n")) == 20_000
    assert time.process_time() - began < 20
