"""Text of an article is not lost to unclosed elements, to classes of its paragraphs, or to a form around the page."""

import time

import pytest

from recollect.llm import html

PROSE = "A sentence of the text, long enough to be read as prose. It goes on and on, as prose does, for two hundred characters and more, until at last it ends; then another one begins, and that one ends as well, as all of them do."


@pytest.mark.parametrize("odd", ['<iframe src="x"/>', '<iframe src="x">', '<canvas id="c"/>', "<canvas>", "<select><option>One<option>Two", '<select name="a"/>', "<textarea>", "<template>", "<title>"])
def test_unclosed_elements_end_at_the_next_block(odd):
    page = f"<body><article><p>{PROSE} First.</p>{odd}<p>{PROSE} Second.</p><p>{PROSE} Third.</p>{{}}</article></body>"
    for more in ("", "<p><iframe>no</iframe><canvas>no</canvas><select><option>no</select><textarea>no</textarea></p>"):
        assert html.main_text(page.replace("{}", more)).split("\n") == [f"{PROSE} {k}." for k in ("First", "Second", "Third")]


def test_scripts_and_closed_elements_are_left_out():
    page = f'<body><article><p>{PROSE}</p><script>if (a < b) document.write("<p>no</p>");</script><select><option>no<p>no</p></select><style>p</style ><p>{PROSE}</p><script>rest of the page <p>no'
    assert html.main_text(page).split("\n") == [PROSE, PROSE]


def test_hinted_paragraphs_of_an_article():
    hints = ['p class="legal"', 'p class="search-term"', 'p class="social"', 'p id="related-work"', 'p class="share"']
    inside = "".join(f"<{h}>{PROSE} {k}.</p>" for k, h in enumerate(hints)) + f'<section class="related-work"><h2>Related work</h2><p>{PROSE} 5.</p></section>'
    around = f'<div class="related"><a href="/a">Other page of the site</a> <a href="/b">And one more</a></div><div class="share">Share this</div><div class="comments"><p>{PROSE} Great!</p></div><div class="sidebar"><p>{PROSE}</p></div>'
    text = html.main_text(f"<body><article>{inside}{around}</article></body>").split("\n")
    assert [t for t in text if t != "Related work"] == [f"{PROSE} {k}." for k in range(6)]


@pytest.mark.parametrize("shell", ["<article>{}</article>", '<div id="content">{}</div>', "<div>{}</div>"])
def test_a_form_around_the_page(shell):
    text = "".join(f"<p>{PROSE} {k}.</p>" for k in range(4))
    page = f'<body><form id="aspnetForm"><nav><a href="/">Home</a></nav>{shell.format(text)}<footer>Foot</footer></form></body>'
    assert html.main_text(page).split("\n") == [f"{PROSE} {k}." for k in range(4)]


def test_a_form_beside_the_text():
    page = f"<body><div><p>{PROSE} 0.</p><p>{PROSE} 1.</p></div><form><p>{PROSE} Write to us.</p><label>Mail</label></form></body>"
    assert html.main_text(page).split("\n") == [f"{PROSE} 0.", f"{PROSE} 1."]


def test_many_unclosed_elements_are_read_once():
    began = time.process_time()
    assert html.main_text("<article>" + "<select>" * 50_000 + f"<p>{PROSE}</p><select></select></article>") == PROSE
    assert html.main_text("<article>" + "<iframe><p>" * 50_000 + f"{PROSE}</article>") == PROSE
    assert time.process_time() - began < 20
