"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (two and three bytes of its lower-cased UTF-8; everything but letters counts as one
separator), weighted log(1 + tf) * idf and brought to length 1.  Document frequencies are counted over all documents.  The
centroids of a language are clusters (spherical k-means) of at most ``SAMPLE`` of its labelled documents, a documented bound of
the fit.  A document gets the language of the centroid of greatest cosine, unless that cosine is below the radius of
that language: then it is rejected.  The radius is half of what 99 % of the language's sample reach, one for all its centroids.  Classification is a scan; what is sent to executors has a fixed size for each language.

Cases: a text that is null or has no letter has no language and a cosine of 0.  Documents without a language label aren't
learnt from; without any label all are rejected.  Of equally near centroids the one of the least language name wins.  Repeated
rows are classified each; an empty table gives no rows.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import common, kernel

HASHED, SAMPLE, CLUSTERS, QUANTILE, SLACK = 1 << 13, 300, 4, 0.01, 0.5
#: Bytes, and texts, whose n-grams are counted at once.
CHUNK, TEXTS = 1 << 19, 256
_LETTER = np.zeros(256, np.uint8)
for _c in (*range(ord("a"), ord("z") + 1), *range(128, 256)):
    _LETTER[_c] = _c


def counts(data: np.ndarray, offsets: np.ndarray, dims: int = HASHED) -> np.ndarray:
    """How often each hashed n-gram is in each text; an n-gram has at least one letter and lies within one text."""
    n = len(offsets) - 1
    out = np.zeros((n, dims), np.float32)
    size = int(offsets[-1]) if n else 0
    low = 0
    while low < size:
        high = min(size, low + CHUNK)
        part = _LETTER[data[low : high + 2]].astype(np.uint32)
        part = np.concatenate([part, np.zeros(high - low + 2 - len(part), np.uint32)])
        owner = np.searchsorted(offsets, np.arange(low, high), "right") - 1
        left = offsets[owner + 1] - np.arange(low, high)
        one, two, three = part[:-2], part[1:-1], part[2:]
        first, last = int(owner[0]), int(owner[-1])
        at = (owner - first) * dims
        got = np.zeros((last - first + 1) * dims, np.int64)
        for code, ok in (((one << 8 | two) + 1, (left >= 2) & ((one | two) > 0)), ((one << 16 | two << 8 | three) + (1 << 24), (left >= 3) & ((one | two | three) > 0))):
            h = (code * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1)
            got += np.bincount(at[ok] + h[ok], minlength=len(got))
        out[first : last + 1] += got.reshape(-1, dims)
        low = high
    return out


def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for s in kernel.slices(batch, "text", CHUNK):
        for low in range(0, s.num_rows, TEXTS):
            part = s.slice(low, TEXTS)
            yield part, counts(*kernel.buffers(part.column(part.schema.get_field_index("text"))))


@dataclass
class Centroids:
    idf: np.ndarray
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    radius: np.ndarray  # the least cosine that is accepted

    def weigh(self, tf: np.ndarray) -> np.ndarray:
        x = np.log1p(tf) * self.idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)

    def nearest(self, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.languages:
            return np.full(len(tf), -1), np.zeros(len(tf))
        cosine = self.weigh(tf) @ self.vectors.T
        best = cosine.argmax(1)
        return best, cosine[np.arange(len(tf)), best].astype(float)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; fewer than k centroids where there are fewer distinct vectors."""
    chosen = [int((x @ x.mean(0)).argmax())]
    while len(chosen) < min(k, len(x)):
        closest = (x @ x[chosen].T).max(1)
        far = int(closest.argmin())
        if closest[far] > 1 - 1e-6:
            break
        chosen.append(far)
    centers = x[chosen]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        centers = np.stack([x[own == c].sum(0) if (own == c).any() else centers[c] for c in range(len(centers))])
        centers /= np.maximum(np.sqrt((centers * centers).sum(1, keepdims=True)), 1e-9)
    return centers


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(HASHED, np.int64), 0
    for b in batches:
        for part, tf in groups(b):
            df += (tf > 0).sum(0)
            n += part.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(HASHED + 1), pa.int32()), pa.array(np.append(df, n))], names=["key", "n"])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, tf in groups(b):
            there = [np.flatnonzero(r) for r in tf]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k.astype(np.uint16).tobytes() for k in there], pa.binary()), pa.array([r[k].tobytes() for r, k in zip(tf, there, strict=True)], pa.binary())], names=["doc_id", "lang", "k", "v"])


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return common.own(docs, "doc_id", "text", *more).select(F.col("doc_id").cast("bigint"), *[F.col(c).cast("string") for c in more], common.lowered(F.col("text")).alias("text"))


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, clusters: int = CLUSTERS) -> Centroids:
    texts = _texts(docs, label).withColumnRenamed(label, "lang")
    totals = {r["key"]: r["n"] for r in texts.select("text").transform(kernel.arrow, _frequencies, "key int, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    n = totals.get(HASHED, 0)
    idf = np.array([np.log((1 + n) / (1 + totals.get(i, 0))) + 1 for i in range(HASHED)], np.float32)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = common.own(docs, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("bigint"), F.col(label).cast("string").alias("lang")).distinct()
    chosen = chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select("doc_id", "lang")
    got = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", "text").transform(kernel.arrow, _sparse, "doc_id bigint, lang string, k binary, v binary").collect()
    model = Centroids(idf, [], np.zeros((0, HASHED), np.float32), np.zeros(0))
    vectors, radius = [], []
    for lang in sorted({r["lang"] for r in got}):
        rows = sorted(((r["doc_id"], bytes(r["k"]), bytes(r["v"])) for r in got if r["lang"] == lang and r["k"]))
        if not rows:
            continue
        tf = np.zeros((len(rows), HASHED), np.float32)
        for i, (_, k, v) in enumerate(rows):
            tf[i, np.frombuffer(k, np.uint16)] = np.frombuffer(v, np.float32)
        x = model.weigh(tf)
        centers = cluster(x, clusters)
        cosine = x @ centers.T
        least = float(np.quantile(cosine.max(1), QUANTILE)) * SLACK
        for c in centers:
            vectors.append(c)
            radius.append(least)
            model.languages.append(lang)
    if vectors:
        model.vectors, model.radius = np.stack(vectors).astype(np.float32), np.array(radius)
    return model


RESULT = "doc_id bigint, lang_id string, nearest string, cosine double"


def classify(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_id, nearest, cosine): ``lang_id`` is null where the text is rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            for part, tf in groups(b):
                best, cosine = m.nearest(tf)
                some = cosine > 0
                ok = some & (cosine >= m.radius[best]) if m.languages else some
                name = [m.languages[i] if s else None for i, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x if o else None for x, o in zip(name, ok, strict=True)], pa.string()), pa.array(name, pa.string()), pa.array(np.where(some, cosine, 0.0))], names=["doc_id", "lang_id", "nearest", "cosine"])

    return _texts(docs).transform(kernel.arrow, run, RESULT)
