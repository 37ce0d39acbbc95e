"""Main text of web pages by composite text density.

Every DOM node has its characters C, tags T, and characters LC and tags LT within links, all of its subtree.  Its composite
density is C/T * log_b(C/LC * T/LT) with b = ln(C/(C-LC) * LC + LCbody/Cbody * C + e), where divisors of 0 count as 1 and ln b
is at least ``FLOOR``; a node without characters has density 0.  The sum of a node's children's densities says how much dense
content is right below it; inline elements are part of the text that they are in and don't count there.  The node of the greatest sum within the body is selected (of equal ones the first), the threshold
is the least density on the path from it to the body, and subtrees in it of elements of layout (``_LAYOUT``) whose density is
below the threshold are left out: headings, paragraphs and what is inline stay, as a short one isn't clutter for being short.  Pages are parsed in Arrow batches, a scan without a shuffle.

Parsing takes time linear in the page: tags, comments and raw text (script, style and the like are no text) are found by one
regular expression; void elements have no content; ``p``, ``li`` and the like end where the next one begins; an end tag ends
what it names and all within, and is ignored where nothing open has its name.  A tag that doesn't close, or has a quote that
doesn't, is text.

Cases: null and empty pages give a null text; a page without any tag gives its text whole.  Repeated rows are extracted each;
an empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, kernel

FLOOR = 0.5
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul br".split())
_INLINE = frozenset("a abbr b big br cite code del em font i ins kbd label mark q s samp small span strike strong sub sup tt u var wbr".split())
_LAYOUT = frozenset("aside div dl fieldset footer form header nav ol section table ul".split())
#: An element of the key's name ends open ones of these names, up to the nearest of the stops.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_CLOSES_P = _BLOCK - {"body", "br", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}


def _closing(page: str, start: int) -> set[int]:
    """The places from ``start`` on of all ``<`` that a ``>`` outside of quotes follows, in one pass from the end."""
    in_tag = in_double = in_single = False  # whether, read from here on in that state, a tag closes
    out = set()
    for m in reversed(list(re.compile("[<>\"']").finditer(page, start))):
        c = m[0]
        if c == "<":
            if in_tag:
                out.add(m.start())
        elif c == ">":
            in_tag = True
        elif c == '"':
            in_tag, in_double = in_double, in_tag
        else:
            in_tag, in_single = in_single, in_tag
    return out


class Dom:
    """Nodes in document order, a parent before its children; texts belong to nodes.  Node 0 is the document."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.items, self.title = ["#document"], [-1], [[]], ""
        self.stack: list[int] = [0]
        self.open: dict[str, list[int]] = {}  # of each name, where in the stack it is open
        at, size, last = 0, len(page), page.rfind(">")
        closing: set[int] | None = None

        def text(s: str) -> None:
            if s and not s.isspace():
                self.items[self.stack[-1]].append(html.unescape(s) if "&" in s else s)
            elif s:
                self.items[self.stack[-1]].append(" ")

        while at < size:
            m, begin = None, page.find("<", at)
            while begin >= 0:
                comment = page.startswith("<!--", begin)
                if begin > last and not comment:  # nothing closes any more
                    begin = page.find("<!--", begin)
                    continue
                if closing is None or comment or page[begin + 1 : begin + 2] in ("!", "?") or begin in closing:
                    m = _TAG.match(page, begin)
                    if m:
                        break
                    if closing is None and page[begin + 1 : begin + 2].isalpha():
                        closing = _closing(page, begin)
                begin = page.find("<", begin + 1)
            if not m:
                text(page[at:])
                break
            text(page[at:begin])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                if self.open.get(name):
                    self._cut(self.open[name][-1])
                continue
            if name in _CLOSES_P:
                self._end({"p"}, {"td", "th", "div", "article", "section", "body", "li", "blockquote"})
            if name in _ENDS:
                self._end(*_ENDS[name])
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(self.stack[-1])
            self.items.append([])
            self.items[self.stack[-1]].append(node)
            if name in _RAW:
                if m[3].endswith("/"):
                    continue
                end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                if name == "title" and not self.title:
                    self.title = " ".join(html.unescape(page[at : end.start() if end else size]).split())
                at = end.end() if end else size
            elif name not in _VOID and not m[3].endswith("/"):
                self.open.setdefault(name, []).append(len(self.stack))
                self.stack.append(node)

    def _cut(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open[self.tag[node]].pop()
        del self.stack[depth:]

    def _end(self, names: set[str], stops: set[str]) -> None:
        """Ends open elements of the names, down to the nearest of the stops; of a single name only the last one."""
        stop = max((self.open[s][-1] for s in stops if self.open.get(s)), default=0)
        while (depth := max((self.open[n][-1] for n in names if self.open.get(n)), default=0)) > stop:
            self._cut(depth)
            if len(names) == 1:
                return

    def content(self, plain: bool = False) -> dict:
        """The result's columns; with ``plain`` inline elements count in the sums, and any node may be left out."""
        n = len(self.tag)
        chars, tags, linked, links = [0] * n, [1] * n, [0] * n, [0] * n
        inside = [False] * n
        for i in range(n):
            inside[i] = self.tag[i] == "a" or (i > 0 and inside[self.parent[i]])
            chars[i] = sum(len("".join(x.split())) for x in self.items[i] if isinstance(x, str)) if self.tag[i] != "head" else 0
            if inside[i]:
                linked[i], links[i] = chars[i], 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            chars[p] += chars[i]
            tags[p] += tags[i]
            linked[p] += linked[i]
            links[p] += links[i]
        body = next((i for i in range(n) if self.tag[i] == "body"), 0)
        share = linked[body] / max(1, chars[body])
        density = [0.0] * n
        for i in range(n):
            c, lc = chars[i], linked[i]
            if c:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                density[i] = c / tags[i] * math.log(c / max(1, lc) * tags[i] / max(1, links[i])) / max(FLOOR, math.log(base))
        total, under = [0.0] * n, [False] * n
        under[body] = True
        for i in range(body + 1, n):
            under[i] = under[self.parent[i]]
            if under[i] and (plain or self.tag[i] not in _INLINE):
                total[self.parent[i]] += density[i]
        best = max((i for i in range(body, n) if under[i]), key=lambda i: (total[i], -i))
        path, threshold, i = [], density[best], best
        while i >= 0:
            path.append(self.tag[i])
            threshold = min(threshold, density[i]) if under[i] else threshold
            i = self.parent[i]
        out: list[str] = []
        todo: list = [best]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            tag = self.tag[x]
            if x != best and (plain or tag in _LAYOUT) and density[x] < threshold or tag == "head":
                continue
            block = tag in _BLOCK
            if block:
                out.append("\n")
                todo.append("\n")
            todo.extend(reversed([" " + y.replace("\n", " ") if isinstance(y, str) and y[:1].isspace() else y.replace("\n", " ") if isinstance(y, str) else y for y in self.items[x]]))
        lines = (" ".join(s.split()) for s in "".join(out).split("\n"))
        return {"title": self.title or None, "text": "\n".join(s for s in lines if s) or None, "path": "/".join(reversed(path[:-1])) or None, "density_sum": total[best], "threshold": threshold, "nodes": n - 1}


RESULT = "page_id bigint, title string, text string, path string, density_sum double, threshold double, nodes int"
_RESULT = pa.schema([("page_id", pa.int64()), ("title", pa.string()), ("text", pa.string()), ("path", pa.string()), ("density_sum", pa.float64()), ("threshold", pa.float64()), ("nodes", pa.int32())])
_NOTHING = {"title": None, "text": None, "path": None, "density_sum": 0.0, "threshold": 0.0, "nodes": 0}


def extract(pages: DataFrame) -> DataFrame:
    """A row for each page: its title, its main text, where that was found, and the figures that chose it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 500):
                part = b.slice(low, 500)
                rows = [{"page_id": i, **(Dom(page).content() if page else _NOTHING)} for i, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)

    return common.own(pages, "page_id", "html").select(F.col("page_id").cast("bigint"), F.col("html").cast("string")).transform(kernel.arrow, run, RESULT)
