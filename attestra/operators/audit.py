"""Leakage between splits, duplicates and near duplicates of fingerprints, lineage."""

from __future__ import annotations

from itertools import combinations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Generators that may be in several splits.
SHARED_GENERATORS = ["authentic", "real", "camera", "unknown"]
# Fields that a manifest row must fill.
REQUIRED = ["path", "sha256", "media_type", "class_label", "source", "license", "generator_or_editor", "source_group", "split"]


def missing_fields(columns: list[str] = REQUIRED) -> Column:
    """Names of the columns that are null or blank, in order."""
    return F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(c)) for c in columns]), lambda x: x.isNotNull())


def leaking_keys(manifest: DataFrame, kind: str, key: str) -> DataFrame:
    """(kind, key, splits) of each key that more than one split holds."""
    by = manifest.filter(F.trim(F.col(key)) != "").groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return by.filter(F.size("splits") > 1).select(F.lit(kind).alias("kind"), "key", "splits")


def manifest_leakage(manifest: DataFrame) -> DataFrame:
    """Violations, one row for each leaking hash, source group and generator (authentic ones may be shared)."""
    own = manifest.filter(~F.lower("generator_or_editor").isin(SHARED_GENERATORS))
    parts = [leaking_keys(manifest, "sha256", "sha256"), leaking_keys(manifest, "source_group", "source_group"), leaking_keys(own, "generator", "generator_or_editor")]
    return reduce(DataFrame.unionByName, parts)


def duplicate_groups(prints: DataFrame, key: str, paths: int = 20) -> DataFrame:
    """(key, splits, count, paths) of keys that more than one split holds; the first paths by name, as a report.

    Paths are thinned to the first few of each key before they are gathered, so a huge group is a short list.
    """
    by_split = prints.groupBy(key, "split").agg(F.count("*").alias("n"))
    out = by_split.groupBy(key).agg(F.array_sort(F.collect_list("split")).alias("splits"), F.sum("n").alias("count")).filter(F.size("splits") > 1)
    named = prints.filter("path IS NOT NULL").select(F.col(key).alias("k"), "path").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("path")))
    named = named.filter(F.col("r") <= paths).groupBy("k").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return out.join(named, F.col(key).eqNullSafe(F.col("k")), "left").select(key, "splits", "count", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def within_split_duplicates(prints: DataFrame, key: str) -> DataFrame:
    """One row, groups: how many (key, split) pairs hold more than one row."""
    return prints.groupBy(key, "split").count().filter("count > 1").agg(F.count("*").alias("groups"))


def split_label_counts(manifest: DataFrame) -> DataFrame:
    """Counts by split and label, with subtotals by split and the total (null keys)."""
    return manifest.withColumn("label", F.coalesce("class_label", F.lit("unlabelled"))).rollup("split", "label").agg(F.count("*").alias("n"))


def hamming_near_prints(prints: DataFrame, max_distance: int = 4) -> DataFrame:
    """(fa, fb, distance), fa <= fb: distinct 64-bit fingerprints that differ in max_distance bits or fewer, each with itself too.

    Bits that differ touch max_distance of 8 bytes at most, so all the others are equal: each choice of 8 - max_distance
    bytes is a key (70 keys of 32 bits for a distance of 4), and two fingerprints meet by chance once in 2**32 for each.
    prints says which paths have a fingerprint; copies are not made into pairs here.
    """
    if not 0 <= max_distance < 8:
        raise ValueError("a distance from 0 to 7 leaves an equal byte")
    masks = [sum(0xFF << 8 * b for b in chosen) for chosen in combinations(range(8), 8 - max_distance)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    fps = prints.filter("fp IS NOT NULL").select("fp").distinct()
    keyed = fps.select("fp", F.posexplode(F.transform(signed, lambda m: F.col("fp").bitwiseAND(m))).alias("mask", "bytes"))
    a, b = keyed.select(F.col("fp").alias("fa"), "mask", "bytes"), keyed.select(F.col("fp").alias("fb"), "mask", "bytes")
    near = a.join(b.hint("merge"), ["mask", "bytes"]).filter("fa < fb").select("fa", "fb", F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))).alias("distance"))
    near = near.filter(F.col("distance") <= max_distance).distinct()
    return near.unionByName(fps.select(F.col("fp").alias("fa"), F.col("fp").alias("fb"), F.lit(0).alias("distance")))


def hamming_near_match(prints: DataFrame, max_distance: int = 4) -> DataFrame:
    """(path_a, path_b, distance): rows of different splits whose fingerprints are near, all pairs of paths. Where many rows share a
    fingerprint, hamming_near_prints says the same in fewer rows."""
    near = hamming_near_prints(prints, max_distance)
    x, y = (prints.select(F.col("path").alias(f"p{s}"), F.col("split").alias(f"s{s}"), F.col("fp").alias(f"f{s}")) for s in "ab")
    out = near.join(x.hint("merge"), "fa").join(y.hint("merge"), "fb").filter((F.col("sa") != F.col("sb")) & ((F.col("fa") != F.col("fb")) | (F.col("pa") < F.col("pb"))))
    return out.select(F.least("pa", "pb").alias("path_a"), F.greatest("pa", "pb").alias("path_b"), "distance").distinct()


def exclude_leakage(samples: DataFrame, prints: DataFrame, key: str, split: str) -> DataFrame:
    """samples of the split without those whose key more than one split of prints holds, or whose path a print of such a
    key has; case and slashes of paths do not count. Groups of any size are excluded whole.
    """
    norm = lambda c: F.lower(F.replace(c, F.lit("/"), F.lit("\\")))
    leaking = prints.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("bad_key")).agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select("bad_key")
    bad = prints.join(leaking, F.col(key) == F.col("bad_key"), "left_semi").select(norm(F.col("path")).alias("bad")).distinct()
    kept = samples.filter(F.col("split") == split).join(leaking, F.col(key) == F.col("bad_key"), "left_anti")
    return kept.join(bad, norm(F.col("path")) == F.col("bad"), "left_anti")


def parent_lineage(manifest: DataFrame) -> DataFrame:
    """(path, parent_media, parent_split, lineage) of derived records: ok, missing, or split where the parent is elsewhere."""
    child = manifest.filter("parent_media IS NOT NULL").select("path", "parent_media", "split")
    parent = manifest.select(F.col("path").alias("parent_media"), F.col("split").alias("parent_split"))
    state = F.when(F.col("parent_split").isNull(), "missing").when(F.col("parent_split") != F.col("split"), "split").otherwise("ok")
    return child.join(parent.hint("merge"), "parent_media", "left").select("path", "parent_media", "parent_split", state.alias("lineage"))


def vector_fingerprint(vector: Column, kind: str) -> Column:
    """A long of 63 bits at most: bit i from v[i] >= mean (average), v[i+1] > v[i] (difference), v[i] >= median of v[1:] (median)."""
    n = F.least(F.size(vector), F.lit(64)) - 1
    d = F.transform(vector, lambda x: x.cast("double"))
    if kind == "difference":
        bit = lambda i: F.get(d, i + 1) > F.get(d, i)
    elif kind == "average":
        mean = F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)
        bit = lambda i: F.get(d, i) >= mean
    elif kind == "median":
        s = F.array_sort(F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))))
        k = F.size(s)
        median = (F.get(s, F.floor((k - 1) / 2).cast("int")) + F.get(s, F.floor(k / 2).cast("int"))) / 2
        bit = lambda i: F.get(d, i) >= median
    else:
        raise ValueError(kind)
    # get() counts from 0; bits are powers of two, summed
    bits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(bit(i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a + x)
