from __future__ import annotations

import pytest

from sheaf.functions import notes as N
from sheaf.sources import files as S
from sheaf.sources import yaml as Y
from sheaf.streaming import refresh


@pytest.fixture
def vault(tmp_path):
    for p, text in {"a.md": "[[b]]", "dir/b.md": "---\ntags:\n  - x\n  - y\nn: 3\n---\nbody", ".git/c.md": "no", "dir/.hidden/d.md": "no", "_w.md": "w", "v.canvas": '{"nodes": [{"id": "1", "type": "file", "file": "gone.md"}, {"id": "2", "type": "text"}]}', "bad.canvas": "{", "x.base": 'a: "p.png"', "skip/e.md": "e"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(tmp_path)


def test_listing(spark, vault):
    assert sorted(r["path"] for r in S.notes(spark, vault, exclude=("skip",)).collect()) == ["a.md", "dir/b.md"]
    assert sorted(r["path"] for r in S.local(spark, vault, exclude=("skip",)).collect()) == ["_w.md", "a.md", "dir/b.md"]
    text = S.listing(spark, vault).selectExpr("path", "decode(content, 'UTF-8') as text")
    assert [tuple(r) for r in S.canvas_links(text).collect()] == [("v.canvas", "gone.md")] and [tuple(r) for r in S.base_links(text).collect()] == [("x.base", "p.png")]


def test_yaml(spark, vault):
    pytest.importorskip("yaml")
    bad = spark.createDataFrame([("bad.md", "---\n[unclosed\n---\n"), ("list.md", "---\n- a\n---\n")], "path string, text string")
    got = {r["path"]: (r["state"], r["fields"]) for r in Y.fields(S.notes(spark, vault).unionByName(bad)).collect()}
    assert got["dir/b.md"] == ("ok", {"tags": ["x", "y"], "n": ["3"]}) and got["a.md"][0] == "absent" and got["bad.md"][0] == got["list.md"][0] == "error"
    assert {r["field"] for r in N.fields(S.notes(spark, vault)).collect()} == {"n"}


def test_publishing_is_confined(spark, vault, tmp_path):
    d = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    assert S.publish(vault, d(("new/f.md", "é"))) == 1 and (tmp_path / "new/f.md").read_text() == "é"
    for path in ("../out.md", "zone/x.md"):
        with pytest.raises(ValueError):
            S.publish(vault, d(("ok.md", "x"), (path, "x")), zones=("zone",))
    assert not (tmp_path / "ok.md").exists()


def test_items(spark, tmp_path):
    f = tmp_path / "items.json"
    f.write_text('[{"id": "1", "title": "t", "codes": ["A"]}, {"id": "2"}]')
    assert S.items(spark, str(f)).count() == 2
    f.write_text('{"id": "1", "odd": 1}')
    with pytest.raises(ValueError):
        S.items(spark, str(f))


def test_lists(spark, tmp_path):
    f = tmp_path / "deny.txt"
    f.write_text("# comment\n\nalpha # example: an alpha\nbeta\n")
    assert [tuple(r) for r in S.denylist(spark, str(f)).collect()] == [("alpha", "an alpha"), ("beta", None)]
    S.write_baseline(spark.createDataFrame([("b",), ("a",), ("b",)], "fingerprint string"), str(tmp_path / "base"))
    assert [r["fingerprint"] for r in S.baseline(spark, str(tmp_path / "base")).orderBy("fingerprint").collect()] == ["a", "b"]


def test_snapshot_parses_changed_notes_only(spark):
    seen = []

    def parse(d):
        out = d.select("path", "sig")
        seen.append(sorted(r["path"] for r in out.collect()))
        return out

    d = lambda *rows: spark.createDataFrame(list(rows), "path string, text string").withColumn("sig", refresh.signature(N.F.col("text")))
    none = spark.createDataFrame([], "path string, sig string")
    one = refresh.merged(none, d(("a", "1"), ("b", "1")), parse)
    two = refresh.merged(one, d(("a", "1"), ("c", "1"), ("b", "2")), parse)
    assert seen == [["a", "b"], ["b", "c"]] and two.count() == 3
    three = refresh.merged(two, d(("c", "1")), parse)
    assert [r["path"] for r in three.collect()] == ["c"] and seen[-1] == []


def test_stream(spark, tmp_path):
    schema = "path string, text string, ts timestamp"
    source = lambda rows, n: spark.sql("select * from values " + ", ".join(f"('{p}', '{t}', timestamp '2024-01-{d:02}')" for p, t, d in rows) + " as v(path, text, ts)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    parse = lambda d: d.select("path", "sig", N.F.length("text").alias("n"))

    def run():
        q = refresh.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), parse, str(tmp_path / "check"))
        q.awaitTermination(60)
        assert q.exception() is None
        import json

        v = json.loads((tmp_path / "out/_version").read_text())["batch"]
        return sorted((r["path"], r["n"]) for r in spark.read.parquet(str(tmp_path / f"out/v{v}")).collect())

    source([("a", "x", 1), ("a", "xxx", 2), ("b", "x", 1)], 1)
    assert run() == [("a", 3), ("b", 1)]
    source([("b", "xx", 3), ("c", "x", 3)], 2)
    assert run() == [("a", 3), ("b", 2), ("c", 1)]
