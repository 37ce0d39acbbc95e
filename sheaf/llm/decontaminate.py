"""Benchmark decontamination: documents that contain a benchmark item, by a prefix-filtered set join.

An item of L words has the set S of its shingles (runs of ``n`` words).  A document contains it if some window of L words
has at least ``ceil(threshold * |S|)`` of S.  Shingles are ordered by rarity, counted over all documents; a window that
reaches the threshold has one of the first ``|S| - ceil(threshold * |S|) + 1`` of them, so only documents with such a prefix
shingle are candidates.  Candidates must be long enough (length bound), and have enough of S within an item's length of a
prefix shingle (positional bound); what remains is verified exactly, window by window.

The documents are scanned once, and only runs that occur in the benchmark leave the scan, a row for each document that has
any.  The benchmark's shingles are broadcast up to ``BROADCAST_SHINGLES``; beyond, documents and benchmark meet in a shuffle.

Cases: null and empty texts, and texts without a word, contain nothing and are contained nowhere.  An item of fewer than n
words has one run, of all its words, and is looked for as such.  Items with a null id, or repeated ones, are looked for like
others (a row each for different texts under one id; equal rows count once).  Rows repeated under one document id count once
when their words are equal, and are judged apart when they aren't.  Of equally good windows the first is reported.  Empty
tables give no rows.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import common, kernel

N, THRESHOLD = 3, 0.6
#: Up to so many distinct benchmark shingles (8 bytes each) are broadcast.
BROADCAST_SHINGLES = 2_000_000
#: Up to so many leaking documents are broadcast when they are dropped.
BROADCAST_LEAKS = 200_000

RUNS = "id bigint, name bigint, n_words int, span int, positions array<int>, runs array<bigint>"
_RUNS = pa.schema([("id", pa.int64()), ("name", pa.int64()), ("n_words", pa.int32()), ("span", pa.int32()), ("positions", pa.list_(pa.int32())), ("runs", pa.list_(pa.int64()))])


def _texts(df: DataFrame, key: str) -> DataFrame:
    return common.own(df, key, "text").where(F.col("text").isNotNull()).select(F.col(key).cast("bigint").alias("id"), common.lowered(F.col("text")).alias("text"))


def _names(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A text's name: a hash of its words in their order."""
    count = np.diff(first)
    named = np.concatenate([[np.uint64(0)], np.cumsum(kernel.mix(hashes + kernel.mix(np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], count).astype(np.uint64))), dtype=np.uint64)])
    return kernel.mix((named[first[1:]] - named[first[:-1]]) + count.astype(np.uint64))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (s for batch in batches for s in kernel.slices(batch, "text")):
        hashes, first, _ = kernel.words(*kernel.buffers(b.column(1)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_names(hashes, first).view(np.int64)), b.column(2)], names=["id", "name", "text_hash"])


def _scan(lengths: list[int] | None, n: int, wanted: np.ndarray | None):
    """Rows of a text's runs: of each length in ``lengths`` (None: of n words, or all of a shorter text), those that are
    ``wanted`` (sorted; None: all)."""
    if wanted is not None:
        bits = np.zeros(1 << 22, bool)  # most runs are told apart here, without a search
        bits[wanted & np.uint64((1 << 22) - 1)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in kernel.slices(batch, "text")):
            data, offsets = kernel.buffers(b.column(1))
            hashes, first, _ = kernel.words(data, offsets)
            count = np.diff(first)
            names = _names(hashes, first)
            for length in lengths or [n]:
                runs, start = kernel.shingles(hashes, first, length)
                owner = np.repeat(np.arange(len(count)), np.diff(start))
                if wanted is None:
                    hit = np.arange(len(runs))
                else:
                    hit = np.flatnonzero(bits[runs & np.uint64((1 << 22) - 1)])
                    at = np.minimum(np.searchsorted(wanted, runs[hit]), len(wanted) - 1)
                    hit = hit[wanted[at] == runs[hit]]
                if lengths:  # a text of fewer words has no run of this length
                    hit = hit[count[owner[hit]] >= length]
                bounds = np.searchsorted(owner[hit], np.arange(len(count) + 1))
                rows = np.flatnonzero(np.diff(bounds))
                if not len(rows):
                    continue
                cut = pa.array(np.append(bounds[rows], bounds[-1]).astype(np.int32))
                span = np.full(len(rows), length) if lengths else np.minimum(count[rows], n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(names[rows].view(np.int64)), pa.array(count[rows].astype(np.int32)), pa.array(span.astype(np.int32)), pa.ListArray.from_arrays(cut, pa.array((hit - start[owner[hit]]).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(runs[hit].view(np.int64)))],
                    schema=_RUNS,
                )

    return run


FOUND = pa.schema([("doc_id", pa.int64()), ("name", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("size", pa.int32()), ("containment", pa.float64()), ("position", pa.int32())])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best window of each candidate, if it is good enough."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            inside = {x: k for k, x in enumerate(r["item"])}
            hits = [(p, inside[x]) for p, x in zip(r["positions"], r["runs"], strict=True) if x in inside]
            reach = r["length"] - r["span"]
            # Positional bound: a good window has a prefix shingle, so only hits within its length of one can be in it.
            near = np.array([p for p, k in hits if k < r["prefix"]])
            if not len(near):
                continue
            at = np.array([p for p, _ in hits])
            next_ = np.searchsorted(near, at)
            close = np.minimum(np.abs(near[np.minimum(next_, len(near) - 1)] - at), np.abs(at - near[np.maximum(next_ - 1, 0)])) <= reach
            hits = [h for h, c in zip(hits, close.tolist(), strict=True) if c]
            if len({k for _, k in hits}) < r["need"]:
                continue
            best, where, low, held = 0, 0, 0, {}
            for p, k in hits:
                held[k] = held.get(k, 0) + 1
                while hits[low][0] < p - reach:
                    held[hits[low][1]] -= 1
                    if not held[hits[low][1]]:
                        del held[hits[low][1]]
                    low += 1
                if len(held) > best:
                    best, where = len(held), hits[low][0]
            if best >= r["need"]:
                out.append((r["doc_id"], r["name"], r["item_id"], best, len(inside), best / len(inside), where))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)


def _contaminated(docs: DataFrame, benchmark: DataFrame, n: int, threshold: float) -> DataFrame:
    """What ``contaminated`` returns, and the names of the documents' words."""
    items = common.cut(_texts(benchmark, "item_id").transform(kernel.arrow, _scan(None, n, None), RUNS).withColumn("runs", F.array_sort(F.array_distinct("runs"))).drop("positions").distinct())
    tokens = items.select("span", F.explode("runs").alias("run")).distinct()
    lengths = [r["span"] for r in tokens.select("span").distinct().orderBy("span").collect()]
    texts = _texts(docs, "doc_id")
    if not lengths:
        return texts.where("false").select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("name"), F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("matched"), F.lit(0).alias("size"), F.lit(0.0).alias("containment"), F.lit(0).alias("position"))
    if tokens.count() <= BROADCAST_SHINGLES:
        wanted = np.unique(np.array([r["run"] for r in tokens.select("run").collect()], dtype=np.int64).view(np.uint64))
        scanned = texts.transform(kernel.arrow, _scan(lengths, n, wanted), RUNS)
    else:
        each = texts.transform(kernel.arrow, _scan(lengths, n, None), RUNS).select("id", "name", "n_words", "span", F.explode(F.arrays_zip("positions", "runs")).alias("x"))
        met = each.select("id", "name", "n_words", "span", F.col("x.positions").alias("p"), F.col("x.runs").alias("run")).join(tokens.select("run").distinct(), "run", "left_semi")
        scanned = met.groupBy("id", "name", "n_words", "span").agg(F.array_sort(F.collect_set(F.struct("p", "run"))).alias("x")).select("id", "name", "n_words", "span", F.col("x.p").alias("positions"), F.col("x.run").alias("runs"))
    hits = common.cut(scanned)

    # Without ids: equal words under one id are one document; null ids group like any other.
    distinct = hits.dropDuplicates(["id", "name", "span"])
    seen = distinct.select(F.explode(F.array_distinct("runs")).alias("run"))
    frequency = seen.groupBy("run").agg(F.count("*").alias("df"))
    need = F.ceil(F.size("runs") * F.lit(threshold) - F.lit(1e-9)).cast("int")
    item = items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), F.col("n_words").alias("length"), F.col("span"), need.alias("need"), "runs").withColumn("item_key", F.xxhash64("item_id", "item_name"))
    ranked = item.select("item_key", "item_id", "length", "span", "need", F.explode("runs").alias("run")).join(frequency, "run", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    order = Window.partitionBy("item_key").orderBy("df", "run")
    ranked = common.cut(ranked.withColumn("rank", F.row_number().over(order)).withColumn("prefix", F.count("*").over(Window.partitionBy("item_key")).cast("int") - F.col("need") + 1))
    sets = ranked.groupBy("item_key", "item_id", "length", "span", "need", "prefix").agg(F.array_sort(F.collect_list(F.struct("rank", "run"))).alias("x")).select("item_key", "item_id", "length", "need", "prefix", F.col("x.run").alias("item"))
    keyed = distinct.select(F.col("id").alias("doc_id"), "name", F.xxhash64("id", "name", "span").alias("doc_key"), "n_words", "span", "positions", "runs")
    candidates = (
        keyed.select("doc_key", "n_words", "span", F.explode(F.array_distinct("runs")).alias("run"))
        .join(ranked.where("rank <= prefix").select("item_key", "run", "need", F.col("span").alias("item_span")), "run")
        .where("span = item_span and n_words - span + 1 >= need")
        .select("doc_key", "item_key")
        .distinct()
    )
    return candidates.join(keyed, "doc_key").join(sets, "item_key").select("doc_id", "name", "item_id", "length", "span", "need", "prefix", "item", "positions", "runs").transform(kernel.arrow, _windows, "doc_id bigint, name bigint, item_id bigint, matched int, size int, containment double, position int")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, matched, size, containment, position): documents and the items that they contain."""
    return _contaminated(docs, benchmark, n, threshold).drop("name")


def drop_contaminated_texts(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no benchmark item, all columns as they were; texts under one id, or under null ids, are
    judged apart."""
    found = common.cut(_contaminated(docs, benchmark, n, threshold).select("doc_id", "name").distinct())
    small = found.count() <= BROADCAST_LEAKS
    leaks = found.select(F.col("doc_id").alias("__id"), F.col("name").alias("__name"))
    ids = leaks.select("__id").distinct()
    texts = common.own(docs, "doc_id", "text").where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("id"), common.lowered(F.col("text")).alias("text"), F.xxhash64("text").alias("text_hash"))
    named = texts.join(F.broadcast(ids) if small else ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi").transform(kernel.arrow, _named, "id bigint, name bigint, text_hash bigint")
    gone = named.join(F.broadcast(leaks) if small else leaks, F.col("id").eqNullSafe(F.col("__id")) & (F.col("name") == F.col("__name")), "left_semi")
    gone = common.cut(gone.select(F.col("id").alias("__leaks"), F.col("text_hash").alias("__text")).distinct())
    gone = F.broadcast(gone) if small else gone
    return docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["__leaks"]) & (F.xxhash64(docs["text"]) == gone["__text"]), "left_anti")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose ids have no row that contains a benchmark item, all columns as they were."""
    found = common.cut(contaminated(docs, benchmark, n, threshold).select(F.col("doc_id").alias("__leaks")).distinct())
    small = found.count() <= BROADCAST_LEAKS
    return docs.join(F.broadcast(found) if small else found, docs["doc_id"].cast("bigint").eqNullSafe(found["__leaks"]), "left_anti")
