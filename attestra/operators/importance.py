"""Permutation importance: how much a measure falls when one feature is dealt out anew over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.evaluation import binary_metrics

REPEATS = 8
#: Hexadecimal digits of a digest by which ranks are first counted: 4,096 buckets, about equal since digests are even.
BUCKET_DIGITS = 3

Score = Callable[[DataFrame], DataFrame]


def seeded_digest(seed: int, part: Column | str, key: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), part, F.col(key).cast("string")), 256)


def digest_ranks(rows: DataFrame, digest: Column, name: str, *keys: str) -> DataFrame:
    """rows with name: the rank, from 0, of a hexadecimal digest within keys. Buckets of digests are counted and their
    totals ordered, 4,096 rows for each of keys; rows are ordered within their bucket alone."""
    b = rows.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, BUCKET_DIGITS))
    totals = b.groupBy(*keys, "_bucket").count()
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    ranked = b.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_digest")))
    out = ranked.join(before.hint("merge"), [*keys, "_bucket"])
    return out.withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_digest", "_bucket", "_before", "_inside")


def permutations(rows: DataFrame, key: str, columns: list[str], repeats: int = REPEATS, seed: int = 7) -> DataFrame:
    """Each row once for every repeat from 1 on, with other: the columns of the row whose place it takes in that repeat's
    permutation of all rows. Permutations are orders by a seeded digest of the key, which must be unique."""
    dealt = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats))))
    ranked = digest_ranks(dealt, seeded_digest(seed, F.col("repeat").cast("string"), key), "_rank", "repeat")
    base = ranked.filter("repeat = 0").drop("repeat")
    other = ranked.filter("repeat > 0").select("repeat", "_rank", F.struct(*columns).alias("other"))
    return base.join(other.hint("merge"), "_rank").drop("_rank")


def permutation_importance(rows: DataFrame, key: str, features: list[str], score: Score, threshold: float = 0.5, repeats: int = REPEATS, seed: int = 7) -> DataFrame:
    """(feature, importance, standard_deviation), the largest mean drop of balanced accuracy first.

    rows: key, the features, and the boolean y. score takes a DataFrame with the features and adds the column s; all that
    it is given are scored in one pass: every row, once for each feature and repeat, with that feature's value from
    another row. Rows are shuffled once for all permutations, and measures are counts that are added up before they
    are shuffled. An empty table has drops of 0.
    """
    own = rows.select(key, *features, "y")
    base = binary_metrics(score(own).select("s", "y"), F.lit(threshold)).select(F.col("balanced_accuracy").alias("base"))
    dealt = permutations(own, key, features, repeats, seed)
    changed = [F.struct(F.lit(f).alias("feature"), *[(F.col(f"other.{c}") if c == f else F.col(c)).alias(c) for c in features]) for f in features]
    variants = dealt.select("repeat", "y", F.explode(F.array(*changed)).alias("v")).select("repeat", "y", "v.*")
    measured = binary_metrics(score(variants).select("s", "y", "feature", "repeat"), F.lit(threshold), "feature", "repeat")
    drops = measured.crossJoin(F.broadcast(base)).withColumn("drop", F.col("base") - F.col("balanced_accuracy"))  # one row
    out = drops.groupBy("feature").agg(F.round(F.avg("drop"), 8).alias("importance"), F.round(F.stddev_pop("drop"), 8).alias("standard_deviation"))
    return importance_sorted(out)


def importance_sorted(importances: DataFrame) -> DataFrame:
    """The largest importance first; equal ones by name."""
    return importances.orderBy(F.desc("importance"), "feature")
