from __future__ import annotations

import pytest

from sheaf.functions import notes as N
from sheaf.operators import frontmatter as FM
from sheaf.operators import graph as G
from sheaf.operators import register as R
from sheaf.operators import tags as TG


def df(spark, rows, schema="path string, text string"):
    return spark.createDataFrame(rows, schema)


def rows(d, *columns):
    return sorted((tuple(r) for r in (d.select(*columns) if columns else d).collect()), key=repr)


@pytest.mark.parametrize(("link", "want"), [
    ("[[a]]", ("a", "", "", False)),
    ("![[b.png]]", ("b.png", "", "", True)),
    ("[[a|shown]]", ("a", "", "shown", False)),
    ("[[a\\|cell]]", ("a", "", "cell", False)),
    ("[[a#H#x|s]]", ("a", "H#x", "s", False)),
    ("[[dir/a#^b1]]", ("dir/a", "^b1", "", False)),
])
def test_links(spark, link, want):
    assert rows(N.links(df(spark, [("n.md", f"x {link} y")])), "target", "anchor", "alias", "embed") == [want]


def test_links_in_fences_do_not_count(spark):
    assert rows(N.links(df(spark, [("n.md", "[[a]] ```\n[[b]]\n``` [[c]]"), ("m.md", ""), ("o.md", None)])), "target") == [("a",), ("c",)]


def test_front_matter_states(spark):
    d = df(spark, [("a", "no front"), ("b", "---\nk: v\n---\nbody"), ("c", "---\nnever closed"), ("d", "---\n" + "x" * 70_000 + "\n---\n"), ("e", "")])
    assert rows(N.parsed(d), "path", "state") == [("a", "absent"), ("b", "ok"), ("c", "absent"), ("d", "error"), ("e", "absent")]
    assert rows(N.fields(d)) == [("b", "k", "v", 2)]


@pytest.mark.parametrize(("value", "want"), [("a", ["a"]), ("[a, 'b']", ["a", "b"]), ("[]", []), ("null", []), ("[[Note|x]]", ["Note"]), ('"q"', ["q"])])
def test_values(spark, value, want):
    d = spark.createDataFrame([(value,)], "v string")
    assert d.select(N.values(d["v"]).alias("x")).first()["x"] == want


FILES = [("a.md",), ("dir/b.md",), ("dir/sub/b.md",), ("other/c.v1.2.md",), ("img/p.png",), ("x/dir/b.md",)]


@pytest.mark.parametrize(("target", "want"), [
    ("a", "a.md"), ("A", "a.md"), ("b", "dir/b.md"), ("sub/b", "dir/sub/b.md"), ("dir/b", "dir/b.md"), ("c.v1.2", "other/c.v1.2.md"),
    ("p.png", "img/p.png"), ("p", None), ("b.md", "dir/b.md"), ("none", None), ("dir/none", None), ("ir/b", "dir/b.md"),
])
def test_resolution(spark, target, want):
    links = spark.createDataFrame([("a.md", target)], "src string, target string")
    got = G.resolve(links, spark.createDataFrame(FILES, "path string")).first()
    assert got["dst"] == want


def test_graph(spark):
    notes = df(spark, [("a.md", "# Top\n[[b]] [[gone]] [[b#Head one]] [[b#Nope]] [[b#^blk]] ![[p.png]]"), ("b.md", "## Head, one!\ntext ^blk\n"), ("c.md", "alone")])
    files = spark.createDataFrame([("a.md",), ("b.md",), ("c.md",), ("p.png",), ("q.PNG",)], "path string")
    r = G.resolve(N.links(notes), files).cache()
    assert rows(r.where("state = 'broken'"), "src", "target") == [("a.md", "gone")]
    assert rows(G.degrees(files, r)) == [("a.md", 0, 6), ("b.md", 4, 0), ("c.md", 0, 0), ("p.png", 1, 0), ("q.PNG", 0, 0)]
    assert rows(G.broken_anchors(r, notes)) == [("a.md", "b.md", "Nope")]
    assert rows(G.orphan_media(files, r)) == [("q.PNG",)]


def test_tags(spark):
    d = df(spark, [("1", "---\ntags: [Data-Sets, x]\n---\n#data-sets ```\n#no\n```"), ("2", "---\ntags: data_sets, y\n---\n"), ("3", "#data-sets and a#no #1no")])
    t = N.tags(d)
    assert rows(TG.counts(t)) == [("Data-Sets", 1), ("data-sets", 2), ("data_sets", 1), ("x", 1), ("y", 1)]
    assert rows(TG.proposals(TG.counts(t))) == [("dataset", "data-sets", "Data-Sets", 1), ("dataset", "data-sets", "data_sets", 1)]


def test_outbox_statuses_are_allowed_in_outbox_notes_only(spark):
    f = N.fields(df(spark, [("o", "---\nnote_type: outbox\nstatus: queued\n---\n"), ("n", "---\nnote_type: note\nstatus: queued\n---\n")]))
    vocab = spark.createDataFrame([("status", "done")], "field string, value string")
    assert rows(FM.off_vocabulary(f, vocab, ["queued"])) == [("n", "status", "queued")]


def test_date_fix(spark):
    f = N.fields(df(spark, [("same", "---\ndate: '2024-01-01'\ncreated: 2024-01-01T10:00\n---\n"), ("other", "---\ndate: 2024-01-02\ncreated: 2024-01-01\n---\n"), ("alone", "---\ndate: 2024-01-02\n---\n"), ("prose", "---\ndate: soon\n---\n")]))
    assert rows(FM.date_fix(f)) == [("alone", "rename"), ("same", "drop")]


def test_register(spark):
    f = spark.createDataFrame([("p", "system", v) for v in ("S1", "s one", "S1/O1", "S1 + nope", "[]", "typo", "[S1, O1]")], "path string, field string, value string")
    e = spark.createDataFrame([("S1", "system"), ("O1", "org")], "id string, tier string")
    a = spark.createDataFrame([("S One", "S1")], "alias string, id string")
    t = spark.createDataFrame([("system", "system"), ("org", "org")], "tier string, field string")
    assert rows(R.conformance(f, e, a, t), "value", "state") == [("O1", "wrong-category"), ("S1 + nope", "unknown"), ("S1/O1", "compound"), ("s one", "alias"), ("typo", "unknown")]


def test_ancestors_end_at_a_cycle(spark):
    e = spark.createDataFrame([("a", "parent", "b"), ("b", "parent", "c"), ("c", "parent", "a"), ("d", "other", "a"), ("e", "parent", "e")], "src string, type string, dst string")
    assert rows(R.ancestors(e).where("id = 'a'")) == [("a", "b", 1), ("a", "c", 2)]
    assert R.ancestors(e).where("id in ('d', 'e')").count() == 0


def test_ancestors_of_long_chains_and_tails_of_cycles(spark):
    rows_ = [(f"n{i:03}", "parent", f"n{i + 1:03}", i) for i in range(70)] + [("t1", "parent", "t2", 0), ("t2", "parent", "c1", 0), ("c1", "parent", "c2", 0), ("c2", "parent", "c3", 0), ("c3", "parent", "c1", 0), ("n000", "parent", "a", 9), ("t1", "parent", "a", 5)]
    e = spark.createDataFrame(rows_, "src string, type string, dst string, pos int")
    got = R.ancestors(e).collect()
    up = {}
    for s, _, d, p in sorted(rows_, key=lambda r: r[3]):
        up.setdefault(s, d)
    want = []
    for s in up:
        seen, at = [s], s
        while at in up and up[at] not in seen:
            at = up[at]
            seen.append(at)
        want += [(s, x, k) for k, x in enumerate(seen) if k]
    assert sorted(map(tuple, got)) == sorted(want) and max(r["depth"] for r in got) == 70
