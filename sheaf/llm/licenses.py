"""License scans by ordered signature rules.

A rule has a licence, a priority, keywords and a regular expression.  One pass of an Aho-Corasick automaton over a text finds
its keywords, and only rules of which it has one are tried.  Of the detections those of higher priority come first, then
longer ones, earlier ones, and rules that stand first.  In that order each is kept unless its span holds, or is held by, that of
one that was kept, or overlaps one that was kept and is of the same licence or of higher priority.  A scan of whole texts without a shuffle.

Cases: null and empty texts have no detection.  Repeated rows are scanned each (with equal results); an empty table gives no
rows.  A document without detection has no row.  Spans are in characters.  Other columns are never read.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, kernel
from sheaf.llm.license_rules import TABLE


class Rule(NamedTuple):
    number: int
    license: str
    priority: int
    keywords: tuple[str, ...]
    pattern: re.Pattern


@cache
def rules() -> tuple[Rule, ...]:
    out = []
    for line in filter(None, map(str.strip, TABLE.splitlines())):
        name, priority, keywords, pattern = line.split("; ", 3)
        # A space stands for white space, except where it is repeated or within a class.
        pattern = re.sub(r" \*|\[[^\]]*\]| ", lambda m: r"\s*" if m[0] == " *" else m[0] if m[0] != " " else r"\s+", pattern)
        pattern = pattern.replace(r"\s+?", r"\s*").replace(r"(?<!lesser\s+)(?<!affero\s+)(?<!library\s+)", r"(?<!lesser\s)(?<!affero\s)(?<!library\s)")
        out.append(Rule(len(out), name, int(priority), tuple(keywords.split(",")), re.compile(pattern, re.I | re.A | re.S)))
    return tuple(out)


@cache
def _automaton() -> ahocorasick.Automaton:
    by: dict[str, list[int]] = {}
    for r in rules():
        for k in r.keywords:
            # The longest word of a keyword is sought, as line ends may part the words.
            by.setdefault(max(k.split(), key=len), []).append(r.number)
    a = ahocorasick.Automaton()
    for k, numbers in by.items():
        a.add_word(k, numbers)
    a.make_automaton()
    return a


class Found(NamedTuple):
    start: int
    end: int
    rule: Rule


def matches(text: str, tried: list[Rule] | tuple[Rule, ...]) -> list[Found]:
    return [Found(m.start(), m.end(), r) for r in tried for m in r.pattern.finditer(text) if m.end() > m.start()]


def resolve(found: list[Found]) -> list[Found]:
    """What stays of overlapping detections, by place."""
    kept: list[tuple[int, int, int, Found]] = []  # by start
    longest = 0
    for f in sorted(found, key=lambda f: (-f.rule.priority, f.start - f.end, f.start, f.rule.number)):
        # None that begins as far before this one as the longest is long can overlap it.
        low, high = bisect.bisect_left(kept, (f.start - longest,)), bisect.bisect_left(kept, (f.end,))
        for start, end, _, k in kept[low:high]:
            if f.start < end and start < f.end and (f.rule.license == k.rule.license or f.rule.priority < k.rule.priority or start <= f.start and f.end <= end or f.start <= start and end <= f.end):
                break
        else:
            bisect.insort(kept, (f.start, f.end, f.rule.number, f))
            longest = max(longest, f.end - f.start)
    return [k[3] for k in kept]


def detect(text: str | None) -> list[Found]:
    if not text:
        return []
    numbers = {n for _, ns in _automaton().iter(text.lower()) for n in ns}
    return resolve(matches(text, [rules()[n] for n in sorted(numbers)])) if numbers else []


RESULT = "doc_id bigint, license string, rule int, priority int, start int, end int, matched string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("rule", pa.int32()), ("priority", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("matched", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """A row for each detection that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                rows += [{"doc_id": i, "license": f.rule.license, "rule": f.rule.number, "priority": f.rule.priority, "start": f.start, "end": f.end, "matched": text[f.start : f.end]} for f in detect(text)]
            yield pa.RecordBatch.from_pylist(rows, schema=_RESULT)

    texts = common.own(docs, "doc_id", "text").where(F.col("text").isNotNull())
    return texts.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).transform(kernel.arrow, run, RESULT)
