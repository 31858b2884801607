"""Prefix counts over a score in [0, 1] that never pull all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of the first level: at most one more than this many rows are ever ordered in one task.
BUCKETS = 1024


def prefix_counts(df: DataFrame, score: str, counts: list[str], descending: bool = True) -> DataFrame:
    """One row for each distinct score: score, counts (their sums at that score) and cum_<count> (sums up to that score).

    counts are numeric columns of df. Rows are added up by distinct score first. Then two levels: totals of BUCKETS
    equal stretches of [0, 1] are ordered in one task, distinct scores only within their stretch. Ties are counted
    together. Null scores are left out; descending: from the largest score on, including the row's own.
    """
    at = df.filter(F.col(score).isNotNull()).groupBy(score).agg(*[F.sum(c).alias(c) for c in counts])
    at = at.withColumn("bucket", F.least(F.floor(F.col(score) * BUCKETS), F.lit(BUCKETS)).cast("int"))
    by = F.desc if descending else F.asc
    totals = at.groupBy("bucket").agg(*[F.sum(c).alias(f"t_{c}") for c in counts])
    before = Window.orderBy(by("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("bucket", *[F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"b_{c}") for c in counts])
    inside = Window.partitionBy("bucket").orderBy(by(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(F.broadcast(totals), "bucket")  # at most BUCKETS + 1 rows
    return out.select(score, *counts, *[(F.sum(c).over(inside) + F.col(f"b_{c}")).alias(f"cum_{c}") for c in counts])
