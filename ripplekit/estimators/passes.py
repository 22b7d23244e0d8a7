"""One distributed pass that returns named sums: each task adds up NumPy arrays over its Arrow batches, a grouped sum
combines the tasks.  Only the sums (whose size is set by the number of models, never of rows) reach the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def array_sums(df: DataFrame, fn: Callable[[object], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """{name: sum over all batches of fn(batch)[name]}; every batch is a pandas frame, arrays of one name have one shape.
    An empty table gives an empty dict."""
    def run(batches):
        import pandas as pd
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                for name, v in fn(pdf).items():
                    total[name] = total[name] + v if name in total else np.asarray(v, float)
        for name, v in total.items():
            yield pd.DataFrame({"name": name, "shape": ",".join(map(str, v.shape)), "i": np.arange(v.size, dtype=np.int64), "v": v.ravel()})

    rows = (df.mapInPandas(run, "name string, shape string, i long, v double")
            .groupBy("name", "shape", "i").agg(F.sum("v").alias("v")).collect())
    out: dict[str, np.ndarray] = {}
    for r in rows:
        if r["name"] not in out:
            out[r["name"]] = np.zeros([int(s) for s in r["shape"].split(",") if s])
        out[r["name"]].ravel()[r["i"]] = r["v"]
    return out
