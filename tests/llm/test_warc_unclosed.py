"""Plain text of pages whose head, svg, noscript or template is not closed."""

import pytest

from tessera.llm import warc

PAGES = [
    ("<html><head><title>t</title><body><p>whole page text</p>", "whole page text"),
    ("<head><meta charset=utf-8><title>t</title><style>p{}</style><p>one</p><p>two", "one\ntwo"),
    ("<head><title>t<body><p>text</p>", "text"),
    ("<p>before</p><svg/><p>after</p>", "before\nafter"),
    ("<p>before</p><svg width='1' /><p>between</p><svg><text>no</text></svg><p>after</p>", "before\nbetween\nafter"),
    ("<p>before</p><svg><p>between</p><svg><svg>no</svg>no</svg><p>after</p>", "before\nbetween\nafter"),
    ("<p>a</p><noscript><p>b</p>", "a\nb"),
    ("<p>a</p><template><p>b</p>", "a\nb"),
    ("<p>a</p><noscript>no</noscript><template>no<template>no</template>no</template><p>b", "a\nb"),
    ("<p>a</p><script>no<p>no", "a"),
    ("<p>a</p><!-- no<p>no", "a"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_unclosed(page, text):
    assert warc.plain_text(page) == text
