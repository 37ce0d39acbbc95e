from __future__ import annotations

import math
import random
import time
from html.parser import HTMLParser

import pytest

from sheaf.llm import html


class Tree(HTMLParser):
    """A DOM of well-formed pages, by another parser."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "#", "kids": [], "up": None}
        self.at = self.root
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "kids": [], "up": self.at}
        self.at["kids"].append(node)
        if tag not in ("br", "img", "meta"):
            self.at = node

    def handle_endtag(self, tag):
        self.at = self.at["up"]

    def handle_data(self, data):
        if self.at["tag"] not in ("script", "style", "title"):
            self.at["kids"].append(data)


def _figures(node, linked=False):
    linked = linked or node["tag"] == "a"
    c = t = lc = lt = 0
    for k in node["kids"]:
        if isinstance(k, str):
            n = len("".join(k.split()))
            c, lc = c + n, lc + n * linked
        else:
            x = _figures(k, linked)
            c, t, lc, lt = c + x[0], t + x[1], lc + x[2], lt + x[3]
    node["f"] = (c, t + 1, lc, lt + linked)
    return node["f"]


def _brute(page: str):
    root = Tree(page).root
    _figures(root)
    nodes = []

    def walk(n):
        nodes.append(n)
        for k in n["kids"]:
            if not isinstance(k, str):
                walk(k)

    walk(root)
    body = next(n for n in nodes if n["tag"] == "body")
    share = body["f"][2] / max(1, body["f"][0])
    for n in nodes:
        c, t, lc, lt = n["f"]
        n["d"] = c / t * math.log(c / max(1, lc) * t / max(1, lt)) / max(html.FLOOR, math.log(math.log(c / max(1, c - lc) * lc + share * c + math.e))) if c else 0.0
    inside = nodes[nodes.index(body) :]
    sums = [sum(k["d"] for k in n["kids"] if not isinstance(k, str) and k["tag"] not in html._INLINE) for n in inside]
    best = inside[sums.index(max(sums))]
    path, n, least = [], best, best["d"]
    while n["tag"] != "#":
        path.append(n["tag"])
        least = min(least, n["d"]) if n["tag"] != "html" else least
        n = n["up"]
    def kept(n) -> str:
        if isinstance(n, str):
            return "".join(n.split())
        return "" if n is not best and n["tag"] in html._LAYOUT and n["d"] < least else "".join(map(kept, n["kids"]))

    return "/".join(reversed(path)), max(sums), least, kept(best)


PAGE = """<html><head><title>A &amp; B</title><style>p{}</style></head><body><nav><ul><li><a href="/x">one</a></li><li><a href="/y">two</a></li></ul></nav>
<div><article><h1>Head line of this</h1><p>%s</p><p>Second paragraph with <a href="q">a link</a> and <b>bold</b> words, long enough to count.</p><ul><li><a href="z">related</a></li></ul></article></div>
<script>var t = "</p>";</script><footer>small print</footer></body></html>""" % ("Many words of the first paragraph. " * 12)


def _random(seed: int) -> str:
    """A well-formed page of nested elements that none ends by itself."""
    rng = random.Random(seed)

    def inside(depth: int) -> str:
        parts = []
        for _ in range(rng.randint(1, 5)):
            if depth > 4 or rng.random() < 0.4:
                parts.append(" ".join(rng.choices(["some", "words", "of", "text", "x"], k=rng.randint(1, 30))))
            else:
                tag = rng.choice(["div", "section", "ul", "b", "a", "span", "article", "header"])
                parts.append(f"<{tag}>{inside(depth + 1)}</{tag}>" if tag != "b" else "<b>bold words</b>")
        return " ".join(parts)

    return f"<html><body><div>{inside(0)}</div><div>{inside(0)}</div></body></html>"


@pytest.mark.parametrize("part", ['<b "', "<b '\"", "<b", "<!", "<!x>", "<p><td>", "</i><b>", "<!--", "<ul><hr>", '<b a="', "<li>", "<b>", "<p><b>", "</script ", "<dt><b>", "&amp;"])
def test_time_is_linear(part):
    began = time.process_time()
    html.Dom("<p>x" + part * 40_000).content()
    assert time.process_time() - began < 10  # a quadratic parser takes minutes for some of these


def test_closing_tags_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        page = "".join(rng.choices("<<>\"'ab ", k=40))
        for at in [i for i, c in enumerate(page) if c == "<"]:
            quote, closes = "", False
            for c in page[at + 1 :]:
                if quote:
                    quote = "" if c == quote else quote
                elif c == ">":
                    closes = True
                    break
                elif c in "\"'":
                    quote = c
            assert (at in html._closing(page, 0)) == closes


def test_a_tag_that_does_not_close_is_text():
    assert html.Dom('<p>1 <b "2 <i>3</i> 4').content()["text"] == '1 <b "2 3 4'


def test_against_brute_force():
    for page in (PAGE, PAGE.replace("<article>", "<section>").replace("</article>", "</section>"), "<html><body><div><p>only this text is here</p><p>and that</p></div></body></html>", PAGE.replace("<h1>", "<div><a href='t'>tag</a><a href='u'>tags</a></div><h1>"), _random(1), _random(2), _random(3)):
        path, total, least, text = _brute(page)
        got = html.Dom(page).content()
        assert "".join(got["text"].split()) == text
        assert got["path"] == path and abs(got["density_sum"] - total) < 1e-6 and abs(got["threshold"] - least) < 1e-6


def test_content():
    got = html.Dom(PAGE).content()
    assert got["title"] == "A & B" and got["path"].endswith("div/article")
    assert "Second paragraph with a link and bold words" in got["text"]
    assert not any(x in got["text"] for x in ("one", "small print", "related", "var t"))


def test_malformed_pages():
    for page in ("<p>a<p>b<p>c", "<div><b>x</div>y</b>", "<ul><li>a<li>b</ul>", "text only", "<", "<<>>", "<a href='x", "<!-- never ends", "<script>never ends", "<table><tr><td>a<td>b<tr><td>c</table>", "</div></div>x", "<br/><img src=x>", "&amp;&#x41;&bogus;"):
        html.Dom(page).content()
    assert html.Dom("text only").content()["text"] == "text only"
    assert html.Dom("<p>a<p>b").content()["text"] == "a\nb"
    assert html.Dom("<div>" * 5000 + "deep").content()["text"] == "deep"


def test_hard_cases(spark):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (None, "<p>x</p>"), (4, "<p>" + "word " * 200_000 + "</p>")]
    pages = spark.createDataFrame([(i, h, "u", "t", "p") for i, h in rows], "page_id bigint, html string, url string, text string, path string")
    got = html.extract(pages).collect()
    assert len(got) == 6 and sum(r["text"] is None for r in got) == 2 and [r["text"] for r in got if r["page_id"] is None] == ["x"]
    assert html.extract(pages.where("false")).count() == 0


def test_pages_of_the_tables(spark, sf):
    rows = html.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert len(rows) == 50 and sum(r["path"] == "html/body/article" for r in rows) > 40
