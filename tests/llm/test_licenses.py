from __future__ import annotations

import random
import time

import pytest

from sheaf.llm import licenses

CASES = {
    "Licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
    "Released under the MIT License.": ["MIT"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"],
    "Licensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"],
    "# SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MIT": ["GPL-2.0-or-later", "MIT"],
    "GNU Lesser General Public License v2.1 and the Mozilla Public License, v. 2.0": ["LGPL-2.1", "MPL-2.0"],
    "see https://creativecommons.org/licenses/by-sa/4.0/ and https://www.apache.org/licenses/LICENSE-2.0": ["CC-BY-SA-4.0", "Apache-2.0"],
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files (the \"Software\"), to deal": ["MIT"],
    "Redistributions: neither the name of the author nor the names of its contributors may be used to endorse or promote products": ["BSD-3-Clause"],
    "Copyright (c) 2019-2021 X. All rights reserved.": ["copyright", "all-rights-reserved"],
    "SPDX-License-Identifier: Foo-1.0": ["spdx-expression"],
    "a permit for the limit of emitted mit": [],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_detections(text):
    assert [f.rule.license for f in licenses.detect(text)] == CASES[text]


def test_rules():
    rules = licenses.rules()
    assert len(rules) >= 300 and all(r.keywords for r in rules)


def test_gate_loses_nothing(spark):
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()] + list(CASES)
    for t in docs[-400:]:
        assert licenses.detect(t) == licenses.resolve(licenses.matches(t, licenses.rules()))


@pytest.mark.parametrize("text", ["Common Public Licence 1.0", "Python Licence", "PHP Licence 3.01", "PHP Licence, version 3.0", "Ruby Licence", "ICU Licence", "Vim Licence", "see the licence for details"])
def test_gate_knows_both_spellings(text):
    for t in (text, text.lower().replace("licence", "license")):
        got = licenses.detect(t)
        assert got and got == licenses.resolve(licenses.matches(t, licenses.rules()))


def test_gate_seeks_no_single_spelling():
    for r in licenses.rules():
        sought = {max(k.split(), key=len) for k in r.keywords}
        assert "licen[sc]e" not in r.pattern.pattern or ("license" in sought) == ("licence" in sought), r


def test_resolution():
    r = licenses.rules()
    high, low = next(x for x in r if x.priority == 90), next(x for x in r if x.priority == 20)
    other = next(x for x in r if x.priority == 90 and x.license != high.license)
    F = licenses.Found
    assert licenses.resolve([F(0, 10, low), F(3, 5, high)]) == [F(3, 5, high)]  # held by one of lower priority
    assert licenses.resolve([F(0, 10, high), F(3, 5, other)]) == [F(0, 10, high)]
    assert licenses.resolve([F(0, 5, high), F(4, 9, low)]) == [F(0, 5, high)]
    assert licenses.resolve([F(0, 5, high), F(4, 9, other)]) == [F(0, 5, high), F(4, 9, other)]
    assert licenses.resolve([F(0, 5, high), F(5, 9, low)]) == [F(0, 5, high), F(5, 9, low)]


def test_hard_cases(spark, hard, empty):
    assert licenses.scan(hard).count() == 0 and licenses.scan(empty).count() == 0
    text = "x " * 100_000 + "Released under the MIT License. " + "y " * 100_000 + "Licensed under the Apache License, Version 2.0."
    d = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (None, "MIT License", "c"), (2, None, "d")], "doc_id bigint, text string, license string")
    got = [(r["doc_id"], r["license"], r["matched"]) for r in licenses.scan(d).collect()]
    assert sorted(got, key=str) == sorted([(1, "MIT", "Released under the MIT License"), (1, "Apache-2.0", "Apache License, Version 2.0")] * 2 + [(None, "MIT", "MIT License")], key=str)


def _plainly(found):
    kept = []
    for f in sorted(found, key=lambda f: (-f.rule.priority, f.start - f.end, f.start, f.rule.number)):
        if not any(f.start < k.end and k.start < f.end and (f.rule.license == k.rule.license or f.rule.priority < k.rule.priority or k.start <= f.start and f.end <= k.end or f.start <= k.start and k.end <= f.end) for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f.start, f.end, f.rule.number))


def test_overlaps_against_brute_force():
    rng = random.Random(8)
    some = rng.sample(licenses.rules(), 12)
    for _ in range(200):
        found = []
        for _ in range(rng.randint(0, 40)):
            start = rng.randrange(120)
            found.append(licenses.Found(start, start + rng.choice([1, 3, 8, 30, 90]), rng.choice(some)))
        found = list(dict.fromkeys(found))
        assert licenses.resolve(found) == _plainly(found)


def test_thousands_of_detections_take_no_quadratic_time():
    began = time.process_time()
    got = licenses.detect("SPDX-License-Identifier: MIT\n\n" * 20_000)
    assert len(got) == 20_000 and time.process_time() - began < 30
