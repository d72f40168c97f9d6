"""HTML extraction: linear time, spans, and all visible words in order, against the standard library's parser."""

import random
import time
from html.parser import HTMLParser

import pytest

from graphbi.llm import html_text


@pytest.mark.parametrize("source", ["<div>" * 200_000 + "end", "<b>" * 100_000 + "</p>" * 100_000 + "end", "<p><i>" * 100_000 + "end",
                                    "<table><tr><td>" * 30_000 + "end", "<li>" * 200_000 + "end", "<span></div>" * 100_000 + "end",
                                    "<td><tr>" * 100_000 + "end", "<ul><li>" * 50_000 + "end", "<a b='" * 100_000, "<" * 300_000 + "end"])
def test_time_is_linear(source):
    began = time.time()
    html_text.render(source)
    assert time.time() - began < 20


TABLES = [
    ("<table><tr><td rowspan=2>x<td>y<tr><td>z</table>", "x | y\n  | z"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab |   | c\nd  | e | f"),
    ("<table><tr><td rowspan=0>x<td>1<tr><td>2<tr><td>3</table>", "x | 1\n  | 2\n  | 3"),
    ("<table><tr><td>1<td rowspan=2>2<td>3<tr><td>4<td>5</table>", "1 | 2 | 3\n4 |   | 5"),
    ("<table><tr><td rowspan=2 colspan=2>big<td>3<tr><td>4</table>", "big |  | 3\n    |  | 4"),
    ("<table><tr><td rowspan=2>a<tr></table><table><tr><td>b</table>", "a\n\nb"),
]


@pytest.mark.parametrize(("source", "text"), TABLES)
def test_spans(source, text):
    assert html_text.render(source) == text


class Words(HTMLParser):
    """Words outside hidden elements, as they come."""

    def __init__(self):
        super().__init__()
        self.hidden, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.VOID and (self.hidden or tag in html_text.HIDDEN or "hidden" in dict(attrs)):
            self.hidden += 1

    def handle_endtag(self, tag):
        self.hidden -= bool(self.hidden)

    def handle_data(self, data):
        if not self.hidden:
            self.words += data.split()


def page(rng, depth, count):
    """A random tree with its end tags (but those of paragraphs and items outside hidden parts)."""
    out = []
    for _ in range(rng.randrange(1, 5)):
        if depth == 0 or rng.random() < 0.4:
            out.append(f" w{next(count)} ")
            continue
        tag = rng.choice(["div", "b", "i", "section", "ul", "ol", "h2", "span", "style", "svg", "div hidden", "table", "br", "img"])
        name = tag.split()[0]
        if name in ("br", "img"):
            out.append(f"<{name}>")
        elif name in ("ul", "ol"):
            out.append(f"<{name}>" + "".join(f"<li>{page(rng, depth - 1, count)}" + rng.choice(["", "</li>"]) for _ in range(2)) + f"</{name}>")
        elif name == "table":
            out.append("<table>" + "".join(f"<tr><td>{page(rng, depth - 1, count)}<td>w{next(count)}" for _ in range(2)) + "</table>")
        elif name == "style":
            out.append(f"<style>w{next(count)}</style>")
        else:
            out.append(f"<{tag}>{page(rng, depth - 1, count)}</{name}>")
    return "".join(out)


def test_all_visible_words_in_order():
    for seed in range(300):
        rng = random.Random(seed)
        source = page(rng, 4, iter(range(10**6)))
        hidden_items = source.replace("<li>", " ").replace("</li>", " ").replace("<tr>", " ").replace("<td>", " ")  # end tags of these may be left out
        plain = Words()
        plain.feed(hidden_items)
        plain.close()
        got = [w for w in html_text.render(source).split() if w.startswith("w")]
        assert got == plain.words, source
