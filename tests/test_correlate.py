from __future__ import annotations

from sheaf.functions import notes as N
from sheaf.operators import correlate as C
from sheaf.operators import graph as G


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_links_are_parsed_once(spark):
    notes = spark.createDataFrame([("a/n.md", "see [[m]] and [it](m.md) ``` [[x]] ``` [[y"), ("a/m.md", None), ("o.md", "[](n.md) [[n]]")], "path string, text string")
    df = G.resolve(N.all_links(notes), notes.select("path"))
    assert sorted((r["src"], r["target"], r["dst"]) for r in df.collect()) == [("a/n.md", "m", "a/m.md"), ("a/n.md", "m.md", "a/m.md"), ("o.md", "n", "a/n.md"), ("o.md", "n.md", "a/n.md")]
    assert "regexp_extract_all" not in plan(df)


def test_bodies_meet_given_pairs_last(spark):
    rows = [(1, "Harbour Ledger", "the harbour ledger of 1923 and the 1923s"), (2, "Ledger Notes", "HARBOUR. and ledger'"), (3, None, "harbour"), (4, "harbour", None), (5, "1923 the and", "1923")]
    cards = spark.createDataFrame(rows, "note int, title string, body string")
    items = cards.withColumnRenamed("note", "item")
    pairs = items.select("item").crossJoin(cards.select("note"))
    df = C.tokens(items, cards, pairs)
    assert sorted(df.collect()) == sorted(C.tokens(items, cards).collect()) != []
    joins = [x for x in plan(df).partition("array_intersect")[2].splitlines() if "Join" in x]
    assert "item#" in joins[0] and "note#" in joins[1]


def test_texts_stay_where_they_are_for_few_names(spark, monkeypatch):
    cards = spark.createDataFrame([(1, "the old harbour ledger"), (2, "harbour"), (3, "old harbour"), (4, "of the old harbour town"), (5, None)], "note int, title string")
    items = spark.createDataFrame([(7, "Of the old harbour, and the old harbour ledger", None), (8, None, "harbours"), (9, "", "old Harbour"), (9, "the old harbour ledger", ""), (10, None, None)], "item int, title string, body string")
    few = C.phrases(items, cards)
    want = [(7, 1), (7, 2), (7, 3), (8, 2), (9, 1), (9, 2), (9, 3)]
    assert sorted((r["item"], r["note"]) for r in few.collect()) == want
    assert not [x for x in plan(few).splitlines() if "Join" in x and "item#" in x]
    monkeypatch.setattr(C, "SENT", 0, raising=False)
    assert sorted(C.phrases(items, cards).collect()) == sorted(few.collect())
