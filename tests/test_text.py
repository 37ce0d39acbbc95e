from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.operators import audit as A
from sheaf.operators import correlate as C
from sheaf.operators import findings as FI
from sheaf.operators import ingest as I
from sheaf.operators import leak as L
from sheaf.operators import memory as M


def value(spark, f, *args):
    return spark.range(1).select(f(*[F.lit(a) for a in args]).alias("x")).first()["x"]


@pytest.mark.parametrize(("f", "arg", "want"), [
    (T.luhn, "4111 1111 1111 1111", True), (T.luhn, "4111 1111 1111 1112", False), (T.luhn, "", False), (T.luhn, "123", False),
    (T.iban, "GB82 WEST 1234 5698 7654 32", True), (T.iban, "GB82WEST12345698765433", False), (T.iban, "DE89370400440532013000", True),
    (T.redact, "abc", "***"), (T.redact, "abcdefgh", "ab****gh"), (T.redact, "a" * 30, "aa********aa"),
    (T.tag_norm, "Data-Sets", "dataset"), (T.tag_norm, "CIS", "cis"), (T.tag_norm_inventory, "CIS", "ci"), (T.kebab_rank, "data-set", 3), (T.kebab_rank, "Data_Set", 0),
    (T.code_key, "sys 12/a", "SYS-12-A"), (T.dedash, "a -- b—c", "a - b - c"), (T.title_from_name, "a -- b -- c", "a: b, c"), (T.title_from_name, "plain", "plain"),
    (T.kebab, "Some NAME of X1", "some-NAME-of-X1"), (T.day, "'2024-05-06T1'", "2024-05-06"), (T.day, "soon", ""), (T.fold, "Ça ßÆ“x”", 'ca ssae"x"'),
    (T.tokens, "The Report's x9 2024 of 'AB&C.'", ["report's", "ab&c"]), (T.name_parts, "Ada Lovelace <ada.lovelace@example.org>", ["lovelace"]),
    (T.lines, "a\r\nb\rc\n", ["a", "b", "c"]), (T.lines, "a\n\nb", ["a", "", "b"]), (T.without_fences, "a ```x``` b", "a  b"),
    (M.stem_tokens, "feedback_the-alpha_beta.md", ["alpha", "beta"]),
])
def test_functions(spark, f, arg, want):
    assert value(spark, f, arg) == want


def test_code_ngrams(spark):
    assert set(value(spark, T.code_ngrams, "the AB-12 plan")) == {"THE-AB", "AB-12", "12-PLAN", "PLAN", "THE-AB-12", "AB-12-PLAN", "THE-AB-12-PLAN"}


def test_pii(spark):
    d = spark.createDataFrame([(1, "mail a.b@example.org, card 4111-1111-1111-1111 or 4111-1111-1111-1112"), (2, "iban GB82WEST12345698765432; password: hunter22"), (3, "+32 470 12 34 56 and 2024 09 16"), (4, "-----BEGIN RSA PRIVATE KEY-----"), (5, None), (6, "")], "k int, t string")
    got = {(r["k"], r["class"], r["n"], r["blocking"]) for r in L.scan(d, "k", "t").collect()}
    assert got == {(1, "email", 1, False), (1, "card", 1, False), (2, "iban", 1, False), (2, "credential", 1, True), (3, "phone", 1, False), (4, "private_key_block", 1, True)}


def test_denylist(spark):
    terms = spark.createDataFrame([("Acme", "error"), ("regex:x{3,}", "note")], "term string, severity string")
    units = spark.createDataFrame([("u1", "an ÀCME here\nacmeology\nACME acme\nxxxx"), ("u2", "")], "unit string, text string")
    assert sorted((r["line"], r["hit"]) for r in L.denied(units, terms).collect()) == [(1, "acme"), (3, "acme"), (4, "xxxx")]
    assert {r["rank"] for r in L.denied(units, terms, cap=1).collect()} == {1, 2}
    known = L.denied(units, terms).where("hit = 'acme'").select("fingerprint")
    assert [r["hit"] for r in L.denied(units, terms, baseline=known).collect()] == ["xxxx"]
    assert [(r["term"], r["state"]) for r in L.liveness(spark.createDataFrame([("abc", "an abc"), ("abd", "abc"), ("x", None)], "term string, example string")).orderBy("term").collect()] == [("abc", "live"), ("abd", "dead"), ("x", "untested")]


def test_phrases_meet_with_and_without_an_inner_word(spark):
    cards = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta gamma"), (3, "gamma delta"), (4, "short"), (5, "alphabet")], "note int, title string")
    items = spark.createDataFrame([(7, None, "xx Alpha beta gammas"), (8, "t", "an alphabetical list"), (9, "", None)], "item int, title string, body string")
    assert sorted((r["item"], r["note"], r["points"]) for r in C.phrases(items, cards).collect()) == [(7, 1, 35), (7, 2, 35), (8, 5, 35)]  # a name within a longer one of another note counts


def test_phrases_of_one_note(spark):
    cards = spark.createDataFrame([("n1", "widget prog", None), ("n2", "widget programme", ["widget prog", "the big widget", "big wid"]), ("n3", None, ["w", "programme plan"])], "note string, title string, aliases array<string>")
    items = spark.createDataFrame([(1, "About", "the big widget programme plans")], "item int, title string, body string")
    assert sorted((r["note"], r["reason"], r["points"]) for r in C.phrases(items, cards).collect()) == [("n1", "widget prog", 35), ("n2", "the big widget", 5), ("n2", "widget programme", 35), ("n3", "programme plan", 35)]


def test_tags_between_word_boundaries(spark):
    cards = spark.createDataFrame([(1, ["data-set", "ab/cd", "two words"]), (2, ["data", "c++x", "(odd)"]), (3, ["sets", "été1", "----"])], "note int, tags array<string>")
    items = spark.createDataFrame([(1, "A Data-Set", "xab/cd and two words"), (2, "datasets", "an ab/cd, ÉTÉ1"), (3, None, None)], "item int, title string, body string")
    import re

    want = set()
    for i, hay in ((1, "a data-set\nxab/cd and two words"), (2, "datasets\nan ab/cd, été1"), (3, "")):
        want |= {(i, n, t) for n, ts in ((1, ["data-set", "ab/cd", "two words"]), (2, ["data", "c++x", "(odd)"]), (3, ["sets", "été1", "----"])) for t in ts if re.search(rf"\b{re.escape(t)}\b", hay)}
    assert {(r["item"], r["note"], r["reason"]) for r in C.tags(items, cards).collect()} == want and len(want) == 5


def test_scores_end_at_a_hundred_and_weak_ones_say_so(spark):
    ev = spark.createDataFrame([(1, n, "c", p, f"{k}") for k, (n, p) in enumerate([("a", 80), ("a", 50), ("b", 90), ("b", 30)])] + [(2, "a", "t", 20, f"{k}") for k in range(6)], "item int, note string, channel string, points int, reason string")
    got = {(r["item"], r["note"]): (r["score"], r["rank"], r["evidence"]) for r in C.ranked(ev).collect()}
    assert got[1, "a"][:2] == (100, 1) and got[1, "b"][:2] == (100, 2)
    assert got[2, "a"] == (69, 1, "t:0,t:1,t:2,t:3,capped: no single signal >= 30")


def test_related_notes(spark):
    cards = spark.createDataFrame([("a", "a", ["X 1"], ["t"], ["B"], "one/x"), ("b", "b", [], [], [], "two"), ("c", "c", ["x-1"], [], [], "three"), ("d", "d", None, ["T"], None, "four"), ("e", "e", [], [], [], "two/y"), ("f", "f", [], [], [], None)], "note string, stem string, codes array<string>, tags array<string>, links array<string>, folder string")
    pairs = spark.createDataFrame([(x, y) for x in "abcdef" for y in "abcdef" if x < y], "a string, b string")
    assert sorted(tuple(r) for r in C.related(cards, pairs).collect()) == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "e")]


def test_token_scores_of_given_pairs(spark):
    cards = spark.createDataFrame([(n, f"title word{n % 3} other{n % 5}") for n in range(20)], "note int, title string")
    items = spark.createDataFrame([(n, f"word{n % 3}", f"some other{n % 5}") for n in range(6)], "item int, title string, body string")
    every = items.select("item").crossJoin(cards.select("note"))
    assert sorted(C.tokens(items, cards, every).collect()) == sorted(C.tokens(items, cards).collect()) != []


def test_contradictions_are_among_feedback_notes(spark):
    f = spark.createDataFrame([("feedback-build.md", "always", None), ("x-build.md", "never", "feedback"), ("project-build.md", "never", "project"), ("y-build.md", "never", None)], "name string, text string, kind string")
    assert [tuple(r) for r in M.contradictions(f).collect()] == [("feedback-build.md", "x-build.md", "always/never")]


def test_gate_weights_are_those_written_down(spark):
    from sheaf.operators import ingest as I

    one = {"body_len": 1000, "n_topics": 1, "score": 0, "n_actions": 0, "n_questions": 0, "n_deadlines": 0, "deadline_state": None, "n_attachments": 0, "n_delegating": 0, "n_parsed": 0, "n_vision": 0, "aside": False, "is_new": False, "group_size": 0}
    cases = [({"body_len": 300, "n_attachments": 1, "n_parsed": 1, "score": 45}, 15), ({"n_vision": 1}, 20), ({"n_delegating": 1}, 15), ({"score": 55, "aside": True}, 10), ({"score": 45, "is_new": True}, 10), ({"n_vision": 1, "body_len": 700}, 5), ({"group_size": 4}, 10), ({"n_questions": 3}, 15)]
    schema = "body_len int, n_topics int, score int, n_actions int, n_questions int, n_deadlines int, deadline_state string, n_attachments int, n_delegating int, n_parsed int, n_vision int, aside boolean, is_new boolean, group_size int, want int"
    d = spark.createDataFrame([(*(one | c).values(), w) for c, w in cases], schema)
    assert all(r["ambiguity"] == r["want"] for r in I.escalation(d).collect())


def test_budgets(spark):
    cards = spark.createDataFrame([(1, ["ann smith", "robert brown"])], "note int, people array<string>")
    items = spark.createDataFrame([(7, ["smith@x.org", "robert.brown@x.org"])], "item int, participants array<string>")
    assert sorted((r["reason"], r["points"]) for r in C.people(items, cards).collect()) == [("brown", 20), ("robert", 5), ("smith", 0)]


@pytest.mark.parametrize(("points", "codes", "want"), [
    ([("n1", "code", 40), ("n1", "phrase", 35)], ["A"], ("anchored", 75)), ([("n1", "code", 40)], [], ("correlated", 40)), ([("n1", "tokens", 25), ("n1", "tag", 20), ("n1", "person", 25)], [], ("weak", 69)),
    ([("n1", "code", 40), ("n2", "code", 40)], [], ("ambiguous", 40)), ([("n1", "code", 40), ("k2", "code", 40)], [], ("correlated", 40)), ([], ["A"], ("topic-known", 0)), ([], [], ("new", 0)),
])
def test_states(spark, points, codes, want):
    ev = spark.createDataFrame([(1, n, c, p, str(k)) for k, (n, c, p) in enumerate(points)], "item int, note string, channel string, points int, reason string")
    items = spark.createDataFrame([(1, codes)], "item int, codes array<string>")
    r = C.states(items, C.ranked(ev), spark.createDataFrame([("k2", "n1")], "a string, b string")).first()
    assert (r["state"], r["score"]) == want


def test_chain(spark):
    import hashlib

    rows, prev = [], "0" * 64
    for i in range(4):
        h = hashlib.sha256((prev + f"r{i}").encode()).hexdigest()
        rows.append(["c", i, prev, f"r{i}", h])
        prev = h
    schema = "chain string, pos int, prev_hash string, record string, hash string"
    assert M.chain_breaks(spark.createDataFrame(rows, schema)).count() == 0
    rows[2][3] = "other"
    assert [r["pos"] for r in M.chain_breaks(spark.createDataFrame(rows, schema)).collect()] == [2]


def test_custody_can_be_in_several_states(spark):
    a = spark.createDataFrame([("f", "encrypted", "f.gpg")], "path string, disposition string, counterpart string")
    f = spark.sql("select 'f' as path, timestamp '2024-01-02' as mtime, false as tracked, false as ignored union all select 'f.gpg', timestamp '2024-01-01', false, false")
    assert sorted(r["state"] for r in A.custody(a, f).collect()) == ["counterpart-stale", "counterpart-untracked", "unignored-gap"]


def test_sarif(spark):
    import json

    d = spark.createDataFrame([("a.md", "t1"), ("b.md", "t2")], "path string, target string")
    doc = json.loads(FI.sarif(FI.findings(d, "graph", "broken", "path", F.col("target"))).first()["sarif"])
    assert doc["version"] == "2.1.0" and len(doc["runs"]) == 1 and doc["runs"][0]["tool"]["driver"]["rules"] == [{"id": "broken"}] and len(doc["runs"][0]["results"]) == 2


def test_questions(spark):
    assert value(spark, I.questions, "Is this a question?\nno\nshort?\nAnd would this be one too?  ") == ["Is this a question?", "And would this be one too?"]
