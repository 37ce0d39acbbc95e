"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

It is trained on the driver on at most ``SAMPLE`` labelled documents (a documented bound: the model has a fixed size), a
quarter of which only sets the threshold, and scores each document in time linear in its length.  Scoring is a scan: no
shuffle, and the broadcast model has a fixed size.

Cases: a text that is null or has no word scores 0 and is rejected.  Null metadata are a value of their own.  Without labels
of both classes there is no model: scores are null and every document with a word is kept.  Repeated rows are scored each;
an empty table gives no rows.  Other columns aren't read when scoring, and pass through filtering as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, features, fm, kernel, labelled

SAMPLE, HASHED, FACTORS, METADATA = 4000, 1 << 16, 8, ("lang", "source")


def _features(text: pa.Array, metadata: list[pa.Array]) -> fm.Rows:
    return features.quality(text, metadata, HASHED)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, metadata: tuple[str, ...] = METADATA) -> fm.Machine | None:
    x, y = labelled.sample(docs, labels, "quality", rows, list(metadata), _features)
    if not (y == 1).any() or not (y == 0).any():
        return None
    learn, check = labelled.split(len(y))
    machine = fm.train(x.take(learn), y[learn], HASHED + len(features.STATS) * features.BINS, FACTORS, epochs=8)
    machine.threshold = fm.best_threshold(machine.score(x.take(check)), y[check])
    return machine


def _kept(score: np.ndarray, machine: fm.Machine | None) -> np.ndarray:
    return np.isnan(score) | (score >= (machine.threshold if machine else 0.5))


def score(docs: DataFrame, machine: fm.Machine | None, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """(doc_id, score, keep) of every document."""
    of = labelled.scorer(machine, _features, (1, list(range(2, 2 + len(metadata)))), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in kernel.slices(batch, "text")):
            s = of(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, mask=np.isnan(s)), pa.array(_kept(s, machine))], names=["doc_id", "score", "keep"])

    columns = [F.col("doc_id").cast("bigint"), F.col("text"), *[F.col(c).cast("string") for c in metadata]]
    return common.own(docs, "doc_id", "text", *metadata).select(*columns).transform(kernel.arrow, run, "doc_id bigint, score double, keep boolean")


def keep(docs: DataFrame, machine: fm.Machine | None, metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """The documents that aren't rejected, all columns as they were."""
    at = (docs.columns.index("text"), [docs.columns.index(c) for c in metadata])
    of = labelled.scorer(machine, _features, at, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in kernel.slices(batch, "text")):
            yield b.filter(pa.array(_kept(of(b), machine)))

    return docs.transform(kernel.arrow, run, docs.schema)
