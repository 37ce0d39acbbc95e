"""Front matter as YAML: the one parser that Spark has no expression for."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import notes as N
from sheaf.tables import ship

try:
    import yaml
except ImportError:  # without a YAML parser only flat front matter is read
    yaml = None


def fields(notes: DataFrame) -> DataFrame:
    """(path, state, fields map<string, array<string>>) of notes; each distinct block is parsed once.  A block that isn't a YAML
    mapping, or is too long, has the state error."""
    if yaml is None:
        raise RuntimeError("no YAML parser is installed; sheaf.functions.notes.fields reads flat front matter")
    ship(notes.sparkSession)
    p = N.parsed(notes)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for block in b["block"]:
                try:
                    got = yaml.safe_load(block)
                    ok = got is None or isinstance(got, dict)
                except yaml.YAMLError:
                    ok = False
                values = {str(k): [str(x) for x in v if x is not None] if isinstance(v, list) else [] if v is None else [str(v)] for k, v in (got or {}).items()} if ok else {}
                out.append((block, "ok" if ok else "error", values))
            yield pd.DataFrame(out, columns=["block", "parsed", "fields"])

    blocks = p.where("state = 'ok'").select("block").distinct().mapInPandas(parse, "block string, parsed string, fields map<string,array<string>>")
    return p.join(blocks, "block", "left").select("path", F.coalesce("parsed", "state").alias("state"), "fields")
