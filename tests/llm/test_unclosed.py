"""Pages whose hidden elements have no end tag."""

import pytest

from gaugework.llm.html_blocks import blocks


def text(html):
    return [b.text for b in blocks(html)]


@pytest.mark.parametrize("head", ["<head><title>x</title>", "<head><meta charset=a><style>p{}</style>\n", "<head><script>'</head><p>'</script>"])
@pytest.mark.parametrize("body", ["<body><article><p>One</p>", "<article><p>One</p>", "<p>One</p>"])
def test_head_without_its_end(head, body):
    assert text(head + body + "<p>Two</p>") == ["One", "Two"]
    assert text(head + "</head>" + body + "<p>Two</p>") == ["One", "Two"]


@pytest.mark.parametrize("tag", ["object", "noscript", "select", "svg", "template"])
def test_unclosed_element_keeps_the_page(tag):
    assert text(f"<body><{tag}><article><p>One</p><p>Two</p></article>") == ["One", "Two"]
    assert text(f"<body><{tag}>gone</{tag}><p>One</p>") == ["One"]


def test_unclosed_raw_text_is_no_markup():
    assert text("<p>One</p><script>var a = '<p>Two</p>'") == ["One"]
