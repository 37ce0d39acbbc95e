from __future__ import annotations

import random

import pytest

#: Columns that the operators don't know, named like ones that they make.
CLASHING = "bucket digest id name label token score rank item_id keep size tokens doc_a first_id __gone __leaks __digest __digestd run lang_id cosine".split()


def _text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "été", "zeta", "eta", "theta", "iota", "kappa", "x1", "don't"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(3)
    texts = [_text(rng, n) for n in (1, 2, 3, 8, 40, 40, 200, 20_000)]
    near = texts[6].split()
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(100, texts[4]), (101, texts[4]), (102, texts[6]), (103, " ".join(near[:-3] + ["new", "end"])), (104, " ".join(near[4:]))]
    out += [(110, None), (111, ""), (112, ""), (113, " \n\t"), (114, "!!! ---"), (None, texts[5]), (None, texts[5]), (None, None)]
    out += [(100, texts[4]), (120, "one under two texts"), (120, "the other of two texts"), (121, "x" * 300_000), (122, "ü" * 50_000 + " ende"), (123, texts[4].upper())]
    return out


@pytest.fixture(scope="session")
def hard_rows():
    return rows()


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and further columns with clashing names."""
    r = rows()
    data = [(i, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"src{k % 3}", None if t is None else len(t), *[None if k % 2 else f"c{k}"] * len(CLASHING)) for k, (i, t) in enumerate(r)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def empty(spark, hard):
    return spark.createDataFrame([], hard.schema)
