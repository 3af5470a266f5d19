import pytest

from recollect.llm import html

PROSE = "A sentence of the text, long enough to be read as prose. It goes on and on, as prose does."
FOOT = '<div class="related-posts"><a href="/a">Other page</a></div><div class="sidebar"><p>Ads, ads.</p></div>'


@pytest.mark.parametrize("around", ['div class="content no-sidebar"', 'div class="post with-comments"', 'div id="main" class="search"'])
def test_content_outweighs_other_classes_of_its_element(around):
    text = html.main_text(f"<body><{around}><h1>Name</h1><p>{PROSE}</p><p>{PROSE}</p></div>{FOOT}</body>")
    assert text.split("\n") == ["Name", PROSE, PROSE]


def test_headers_of_content_and_comments():
    page = f'<body><article><header class="entry-header"><h1>Name</h1></header><p>{PROSE}</p><div class="comments"><p>{PROSE} Great!</p></div></article>{FOOT}</body>'
    assert html.main_text(page).split("\n") == ["Name", PROSE]


def test_content_inside_a_hinted_wrapper():
    text = html.main_text(f'<body><div class="page-sidebar-layout sidebar"><div class="content"><p>{PROSE} {PROSE} {PROSE} {PROSE}</p></div></div></body>')
    assert text.count("sentence") == 4


def test_formulas_and_objects_are_text():
    text = html.main_text(f'<body><article><p>{PROSE} So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <svg><text>five</text></svg> and <object data="a">six</object>.</p><noscript><p>Seven.</p></noscript></article></body>')
    assert text.split("\n") == [PROSE + " So x=2 and five and six.", "Seven."]
