"""Toxicity: a factorisation machine over hashed terms, which learns what pairs of terms say beyond their single weights.

Terms are words and the first four bytes of words (for compounds), each once in a document.  Only terms whose share of toxic
documents in the sample is at least five standard errors off the overall share get a weight, and those of pairs that say what
neither term does (a mild insult with the mention of a group), so that the length of a text says nothing.  Trained on the driver on at most ``SAMPLE`` labelled documents (a documented bound), a quarter of which only
sets the threshold.  Scoring is a scan without a shuffle.

Cases: a text that is null or has no word scores 0 and isn't toxic.  Without labels of both classes, or without
a term that tells them apart, there is no model: scores are null and nothing is toxic.  Repeated rows are scored each; an empty table gives no rows.  Other columns are never
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, features, fm, kernel, labelled

SAMPLE, HASHED, FACTORS, DISTINCTIVE, LEAST = 8000, 1 << 17, 8, 5.0, 5


def _features(text: pa.Array, _: list[pa.Array]) -> fm.Rows:
    return features.terms(text, HASHED)[0]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> fm.Machine | None:
    x, y = labelled.sample(docs, labels, "toxic", rows, [], _features)
    if not (y == 1).any() or not (y == 0).any():
        return None
    learn, check = labelled.split(len(y))
    machine = fm.train(x.take(learn), y[learn], HASHED + 1, FACTORS, epochs=8, rate=0.05, least=LEAST, distinctive=DISTINCTIVE)
    if not machine.linear.any():  # no term tells the classes apart, every score would be the same
        return None
    machine.threshold = fm.best_threshold(machine.score(x.take(check)), y[check])
    return machine


def score(docs: DataFrame, machine: fm.Machine | None) -> DataFrame:
    """(doc_id, score, toxic) of every document."""
    of = labelled.scorer(machine, _features, (1, []), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in kernel.slices(batch, "text")):
            s = of(b)
            toxic = ~np.isnan(s) & (s >= machine.threshold) if machine else np.zeros(len(s), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, mask=np.isnan(s)), pa.array(toxic)], names=["doc_id", "score", "toxic"])

    return common.own(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text").transform(kernel.arrow, run, "doc_id bigint, score double, toxic boolean")
