"""Blocks and time of the HTML parser, kept and dropped parts of short pages."""

from __future__ import annotations

import time

import pytest

from lexforge.llm import html_main


def blocks(source: str) -> list[str]:
    return [n.text for n in html_main.parse(source) if n.text is not None]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>One half <img src=a> other half</p>", ["One half other half"]),
        ("<p>super<wbr>cali <my-tag>x</my-tag> y</p>", ["supercali x y"]),
        ("<p>a <script>if (b<c) d</script>e <button>f</button>g <input name=q> h</p>", ["a e g h"]),
        ("<p>Price <label>five</label> <math><mi>euro</mi></math></p>", ["Price five euro"]),
        ("<p>x <select><option>a<option>b</select> y <svg><text>n</text></svg>", ["x y"]),
        ("<p>a<div>b</div>c</p>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>e", ["a", "b", "c", "e"]),
        ("<p><b>a<p>b</b>c", ["a", "bc"]),
        ("<a href=\"x>y\" title='>'>q</a> <b x=\">r</b>s", ["q rs"]),
        ("a < b <3 c <x", ["a < b <3 c"]),
        ("a<![CDATA[b<c]]>d<!-- x --> &lt;e&gt; <? f ?>g", ["ab<cd <e> g"]),
        ("<xmp>a<b>c</xmp>z", ["a<b>c", "z"]),
        ("a</", ["a</"]),
        ("<!doctype", []),
    ],
)
def test_blocks(source, want):
    assert blocks(source) == want


def test_implied_ends_close_rows():
    nodes = html_main.parse("<table><tr><td>a<td>b<tr><td>c</table>")
    assert [n.depth for n in nodes if n.tag == "tr"] == [2, 2]


@pytest.mark.parametrize(
    "source",
    [
        "<a " * 333_000 + '"',
        "<a " * 333_000 + '">x',
        '<a x="' * 160_000 + ">",
        "<a '\"" * 200_000 + ">",
        "<b>" * 140_000 + "</x>" * 140_000,
        "<b>" * 140_000 + "</p>" * 140_000,
        "<div>" * 200_000 + "t",
        "<li>a" * 200_000,
        "<p><b>a</i>" * 90_000,
        "<" * 1_000_000,
        "<!-" * 300_000,
        "<script>" * 120_000,
        "<a " + 'class=" ' * 120_000,
    ],
    ids=range(13),
)
def test_hostile_pages_of_a_megabyte(source):
    begun = time.monotonic()
    html_main.parse(source)
    assert time.monotonic() - begun < 30  # seconds when alone; a quadratic parser takes hours


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<html><body><article><h1>A title of it</h1><p>First paragraph of the article, with words.</p><p>Second one follows it here.</p></article><footer><p>Copyright 2020 Example.</p></footer></body></html>", "A title of it\nFirst paragraph of the article, with words.\nSecond one follows it here."),
        ("<html><body><article><p>First paragraph of the article, with words.</p><p>Second one follows it here.</p></article><form><p>Sign up for our newsletter.</p></form></body></html>", "First paragraph of the article, with words.\nSecond one follows it here."),
        ("<html><body><p>Short article.</p><footer>Copyright 2020 by us.</footer></body></html>", "Short article."),
        ("<html><body><nav><a href=/>Home</a></nav><div><p>Tiny.</p></div><footer>Copyright</footer></body></html>", "Tiny."),
        ("<main><p>The article goes on for a while, as it does.</p><section class=related><h2>Related stories</h2><div class=card><h3><a href=x>Other story</a></h3></div></section></main>", "The article goes on for a while, as it does."),
    ],
)
def test_short_pages(source, want):
    assert html_main.main_texts([source], html_main.default_trees()) == [want]


def test_fresh_pages_of_the_generator():
    right = 0
    for source, main in html_main.page_sample(200, 991):
        want = "\n".join(n.text for n in html_main.parse(source) if n.text in main)
        right += want == html_main.main_texts([source], html_main.default_trees())[0]
    assert right >= 186, right
