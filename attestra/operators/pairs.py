"""Exact search for the best pair of two thresholds, without a table of all pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stretches of each threshold that are bounded first; the result is the same for any number.
GRID = 256
#: Pairs that a task looks at together.
AT_ONCE = 1_000_000


def best_pair(rows: DataFrame, xs: DataFrame | None, counts: list[str], gain: str, allowed: Callable, rank: Callable, x_last: bool = False, grid: int = GRID) -> dict | None:
    """x, y and counts of the first allowed pair by rank; a pair covers the rows with no larger x and no larger y, one at least.

    rows: (x, y, counts), without nulls; counts[0] is the number of rows. xs: (x), if x may be other values than those of rows.
    allowed(low, high): whether counts between low and high can be allowed; exact if both are the same. rank(c): arrays to
    sort by, first -c[gain]. Among pairs that cover the same rows, rank takes the smallest y and the smallest x, or
    with x_last the largest x.

    Totals of at most grid x grid cells bound the counts of the pairs inside each. Only cells that can hold the result
    are searched, by their real values: those at the edge of what is allowed, about one on each diagonal. A task gets a
    cell's rows, and the rows beside and below it added up by value.
    """
    spark = rows.sparkSession
    rows = rows.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in counts]).persist()
    try:
        x_edges, y_edges = (_edges(df, c, grid) for df, c in ((rows.select("x").distinct() if xs is None else xs, "x"), (rows.select("y").distinct(), "y")))
        binned = _binned(_binned(rows, "x", "i", x_edges), "y", "j", y_edges)
        plane = binned.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in counts]).toArrow()  # grid x grid rows at most
        if plane.num_rows == 0:
            return None
        at = plane["i"].to_numpy(), plane["j"].to_numpy()
        high, low = {}, {}
        for c in counts:
            cell = np.zeros((len(x_edges) + 1, len(y_edges) + 1), np.int64)
            cell[at] = plane[c].to_numpy()
            high[c] = cell.cumsum(0).cumsum(1)
            low[c] = np.pad(high[c], ((1, 0), (1, 0)))[:-1, :-1]
        n = high[counts[0]]
        known = allowed(high, high) & (n > 0)  # the pair of a cell's largest values
        least = high[gain][known].max() if known.any() else 0
        left = np.pad(n, ((1, 0), (0, 0)))[:-1]
        right = np.pad(n, ((0, 1), (0, 0)), mode="edge")[1:]
        moves = (right > left) | (np.arange(len(n)) == len(n) - 1)[:, None] if x_last else n > left
        pick = allowed(low, high) & (high[gain] >= least) & moves & (n > np.pad(n, ((0, 0), (1, 0)))[:, :-1])
        base = {(int(i), int(j)): {c: int(low[c][i, j]) for c in counts} for i, j in zip(*np.nonzero(pick))}
        if not base:
            return None
        cells = F.broadcast(spark.createDataFrame(list(base), "ci int, cj int"))
        sums = [F.sum(c).alias(c) for c in counts]
        no = F.lit(None).cast("double")
        parts = binned.join(cells, (F.col("i") == F.col("ci")) & (F.col("j") < F.col("cj"))).groupBy("ci", "cj", "x").agg(*sums).withColumn("y", no)
        parts = parts.unionByName(binned.join(cells, (F.col("j") == F.col("cj")) & (F.col("i") < F.col("ci"))).groupBy("ci", "cj", "y").agg(*sums).withColumn("x", no))
        parts = parts.unionByName(binned.join(cells, (F.col("i") == F.col("ci")) & (F.col("j") == F.col("cj"))).select("ci", "cj", "x", "y", *counts))
        if xs is not None:
            parts = parts.unionByName(_binned(xs, "x", "i", x_edges).join(cells, F.col("i") == F.col("ci")).select("ci", "cj", "x", no.alias("y"), *[F.lit(0).cast("long").alias(c) for c in counts]))
        names, at_once = ["x", "y", *counts], AT_ONCE

        def first(found: dict) -> dict:
            k = np.lexsort(rank(found)[::-1])[0]
            return {c: found[c][k] for c in names}

        def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            start = base[int(key[0]), int(key[1])]
            has_x, has_y = pdf["x"].notna().to_numpy(), pdf["y"].notna().to_numpy()
            x, y = np.unique(pdf["x"][has_x]), np.unique(pdf["y"][has_y])
            xi, yi = np.searchsorted(x, pdf["x"].to_numpy()), np.searchsorted(y, pdf["y"].to_numpy())
            below, beside = {}, {}
            for c in counts:
                v = pdf[c].to_numpy()
                below[c], beside[c] = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                np.add.at(below[c], xi[has_x & ~has_y], v[has_x & ~has_y])
                np.add.at(beside[c], yi[has_y & ~has_x], v[has_y & ~has_x])
                below[c], beside[c] = below[c].cumsum(), beside[c].cumsum()
            order = np.flatnonzero(has_x & has_y)
            order = order[np.argsort(xi[order], kind="stable")]
            ox, oy = xi[order], yi[order]
            value = {c: pdf[c].to_numpy()[order] for c in counts}
            carry = {c: np.zeros(len(y), np.int64) for c in counts}
            best, step = [], max(1, at_once // max(1, len(y)))
            for s in range(0, len(x) if len(y) else 0, step):
                k = min(step, len(x) - s)
                a, b = np.searchsorted(ox, [s, s + k])
                got = {}
                for c in counts:
                    inner = np.zeros((k, len(y)), np.int64)
                    np.add.at(inner, (ox[a:b] - s, oy[a:b]), value[c][a:b])
                    inner = inner.cumsum(0) + carry[c]
                    carry[c] = inner[-1]
                    got[c] = start[c] + below[c][s : s + k, None] + beside[c][None, :] + inner.cumsum(1)
                r, q = np.nonzero(allowed(got, got) & (got[counts[0]] > 0))
                if len(r):
                    most = got[gain][r, q] == got[gain][r, q].max()
                    r, q = r[most], q[most]
                    best.append(first({"x": x[s + r], "y": y[q]} | {c: got[c][r, q] for c in counts}))
            return pd.DataFrame([first({c: np.array([b[c] for b in best]) for c in names})] if best else [], columns=names)

        found = parts.groupBy("ci", "cj").applyInPandas(search, ", ".join(["x double", "y double", *[f"{c} long" for c in counts]])).toPandas()  # a row for each cell
        return first({c: found[c].to_numpy() for c in names}) if len(found) else None
    finally:
        rows.unpersist()


def _edges(df: DataFrame, c: str, grid: int) -> list[float]:
    """Values that part the column in up to grid stretches of about as many distinct values."""
    found = df.agg(F.percentile_approx(c, [k / grid for k in range(1, grid)], 100 * grid)).first()[0]
    return sorted(set(found or []))


def _binned(df: DataFrame, c: str, name: str, edges: list[float]) -> DataFrame:
    """name: how many edges are not over c."""
    if not edges:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=c, outputCol=name, handleInvalid="error")
    return cut.transform(df).withColumn(name, F.col(name).cast("int"))
