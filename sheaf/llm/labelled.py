"""What the two classifiers share: a bounded sample of labelled documents, and scoring by a factorisation machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm import common, kernel
from sheaf.llm.fm import Machine, Rows

#: From the text column of a batch and its metadata columns to the rows of features.
Featurise = Callable[[pa.Array, list[pa.Array]], Rows]


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, columns: list[str], featurise: Featurise) -> tuple[Rows, np.ndarray]:
    """Features and labels of at most ``rows`` labelled documents, those whose ids hash lowest.  Null ids and labels don't
    count; of several labels of one id the greatest does, of several texts the least."""
    chosen = (
        common.own(labels, "doc_id", label)
        .where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = common.own(docs, "doc_id", "text", *columns).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    # The bound is one of rows: an id that is repeated ever so often counts once, which begins before the shuffle.
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct("text", *columns)).alias("row")).select("doc_id", "row.*", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for batch in batches for s in kernel.slices(batch, "text")):
            x = featurise(b.column(1), [b.column(i) for i in range(2, 2 + len(columns))])
            cut = list(zip(x.start[:-1], x.start[1:], strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2 + len(columns)), pa.array([x.index[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([x.value[i:j].tobytes() for i, j in cut], pa.binary())], names=["doc_id", "label", "i", "v"])

    got = found.select(F.col("doc_id").cast("bigint"), "text", *[F.col(c).cast("string") for c in columns], "label").transform(kernel.arrow, run, "doc_id bigint, label int, i binary, v binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], bytes(r["i"])))
    index = [np.frombuffer(r["i"], np.int32) for r in got]
    none = np.zeros(0)
    return (
        Rows(np.concatenate([[0], np.cumsum([len(x) for x in index])]).astype(np.int64), np.concatenate(index) if got else none.astype(np.int32), np.concatenate([np.frombuffer(r["v"], np.float32) for r in got]) if got else none.astype(np.float32)),
        np.array([int(r["label"] > 0) for r in got]),
    )


def split(n: int, held_out: float = 0.25, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    order = np.random.default_rng(seed).permutation(n)
    cut = int(n * held_out)
    return np.sort(order[cut:]), np.sort(order[:cut])


def scorer(machine: Machine | None, featurise: Featurise, positions: tuple[int, list[int]], otherwise: float) -> Callable[[pa.RecordBatch], np.ndarray]:
    """A function from a batch to the scores of its rows; ``otherwise`` is the score of texts without a word."""

    def run(batch: pa.RecordBatch) -> np.ndarray:
        text = batch.column(positions[0])
        data, offsets = kernel.buffers(text)
        if machine is None:
            score = np.full(batch.num_rows, np.nan)
        else:
            score = machine.score(featurise(text, [batch.column(i) for i in positions[1]]))
        inside = np.concatenate([[0], np.cumsum(kernel.WORD_BYTE[data], dtype=np.int64)])
        score[np.diff(inside[offsets]) == 0] = otherwise
        return score

    return run
