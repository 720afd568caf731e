"""Main text that markup around it must not erase."""

import pytest

from lodestone.llm import html_extract

ARTICLE = "<article><h1>On rivers</h1><p>Rivers carry water from the hills to the sea, slowly in summer and fast in spring.</p><p>Their banks move a little in each year.</p></article>"


@pytest.mark.parametrize("tag", ["button", "select", "option", "template"])
def test_unclosed_element_keeps_the_article(tag):
    page = f"<body><{tag}>{ARTICLE}<footer><{tag}>Send</{tag}></footer></body>"
    assert "Rivers carry water" in html_extract.main_text(page)
    beside = f"<body><div><{tag}></div>{ARTICLE}<{tag}>Send</{tag}></body>"
    text = html_extract.main_text(beside)
    assert "Rivers carry water" in text and "Send" not in text


def test_closed_element_is_silent():
    page = ARTICLE.replace("Their", "<template><template>one</template>two</template><button><div>Share</div></button><style>three</style>Their")
    assert html_extract.main_text(page) == html_extract.main_text(ARTICLE)


@pytest.mark.parametrize("tag", ["object", "svg", "video", "audio", "iframe", "noscript", "canvas"])
def test_text_in_media_stays(tag):
    page = ARTICLE.replace("Their", f"See <{tag}>the label</{tag}> here. Their")
    assert "See the label here. Their banks" in html_extract.main_text(page)
    unclosed = f"<body><{tag}>{ARTICLE}<footer><{tag}>Send</{tag}></footer></body>"
    assert "Rivers carry water" in html_extract.main_text(unclosed)


def test_long_and_leading_zero_references():
    page = ARTICLE.replace("Their", f"A &#0000000065; &#x{'0' * 5000}42; &#{'9' * 5000}; &#xFFFFFFFFF; end. Their")
    assert "A A B \ufffd \ufffd end. Their" in html_extract.main_text(page)


def test_formulas_stay():
    assert "energy is m c2 here" in html_extract.main_text(ARTICLE.replace("Their", "The energy is <math><mi>m</mi> <mi>c</mi><mn>2</mn></math> here. Their"))


def test_distance_in_deep_pages():
    deep = "<div>" * 100 + "one<div>two</div>" + "</div>" * 100
    a, b = html_extract.blocks(deep)
    assert html_extract._apart(a, b) == 1
