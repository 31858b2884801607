"""Split assignment and sampling by hash: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Borders of the stretches that ordered texts are cut into.
EDGES = 128


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """The first 8 hex digits of the SHA-256, modulo buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_split(key: Column) -> Column:
    b = hash_bucket(key)
    return F.when(b < 70, "train").when(b < 80, "tuning").when(b < 90, "calibration").otherwise("locked_test")


def stable_group(*values: Column) -> Column:
    """24 hex digits that name a group: of the trimmed values joined by a separator that no value holds; null is empty."""
    return F.substring(F.sha2(F.concat_ws("␟", *[F.coalesce(F.trim(v.cast("string")), F.lit("")) for v in values]), 256), 1, 24)


def seeded(seed: int | str, *keys: str) -> Column:
    """The order of a seeded draw: a hash of seed and key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def first_per_group(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def dedup_by_priority(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: test before validation before train, then by path."""
    priority = F.when(F.col("split").isin("test", "locked_test"), 0).when(F.col("split").isin("validation", "tuning", "calibration"), 1).otherwise(2)
    return first_per_group(rows, keys, priority, F.col("path"))


def cap_per_class(rows: DataFrame, keys: list[str], k: int, seed: int) -> DataFrame:
    """At most k rows for each key, by a seeded draw."""
    w = Window.partitionBy(*keys).orderBy(seeded(seed, "path"), F.col("path"))
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def generator_heldout(rows: DataFrame, generator_splits: DataFrame) -> DataFrame:
    """Authentic rows by their group's split; other rows only where their generator's split is their group's."""
    r = rows.join(F.broadcast(generator_splits), rows["generator_or_editor"] == generator_splits["generator"], "left")
    own = F.col("generator_or_editor") == "authentic"
    return r.filter(own | (F.col("generator_split") == F.col("split"))).select(*rows.columns)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight = 1 / rows of their class; null labels have no weight."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col(label).isNotNull())
    return rows.join(F.broadcast(counts), label, "left").withColumn("weight", F.lit(1.0) / F.col("_n")).drop("_n")


def oversample(rows: DataFrame, positive: Column, order: str) -> DataFrame:
    """rows, the positives repeated until both classes are equally many: the first ones in order once more than the rest.

    Ranks come from range-partitioned prefix counts by order's own bucket, not from one global window.
    """
    n = rows.agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_q"))
    pos = rows.filter(positive).withColumn("_b", F.pmod(F.xxhash64(order), F.lit(256)))
    sizes = pos.groupBy("_b").agg(F.count("*").alias("_c"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    inside = Window.partitionBy("_b").orderBy(F.col(order))
    ranked = pos.join(F.broadcast(before), "_b").withColumn("_i", F.col("_before") + F.row_number().over(inside) - 1).crossJoin(F.broadcast(n))
    times = F.greatest(F.lit(1), F.floor(F.col("_q") / F.col("_p")) + F.when(F.col("_i") < F.col("_q") % F.col("_p"), 1).otherwise(0))
    more = ranked.withColumn("repeat", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return rows.filter(~positive).withColumn("repeat", F.lit(1)).unionByName(more.select(*rows.columns, "repeat"))


def fallback_split(rows: DataFrame, key: str, fraction: float, seed: int) -> Column:
    """validation for about `fraction` of the keys by hash, train for the others."""
    return F.when(hash_bucket(F.concat_ws("|", F.lit(str(seed)), F.col(key)), 10_000) < int(fraction * 10_000), "validation").otherwise("train")


def donor_ring(parents: DataFrame) -> DataFrame:
    """(path, split, donor): each parent's donor is the next path of its split, the last one's is the first; paths are unique.

    Paths are ordered within stretches alone, whose EDGES borders are those of a sample of at most 32 times as many rows;
    what follows a stretch is the first path of the next one that has any."""
    sample = parents.filter("path IS NOT NULL").select("path").orderBy(F.xxhash64("path"), "path").limit(EDGES * 32).collect()
    ordered = sorted(r["path"].encode() for r in sample)
    edges = F.array(*[F.lit(e.decode()) for e in ordered[:: max(1, len(ordered) // EDGES)]]) if ordered else F.array(F.lit(""))
    rows = parents.select("path", "split", F.size(F.filter(edges, lambda e: e <= F.col("path"))).alias("_b"))
    starts = rows.groupBy("split", "_b").agg(F.min("path").alias("_start"))  # at most EDGES + 33 rows a split
    by = Window.partitionBy("split").orderBy("_b")
    starts = starts.select("split", "_b", F.coalesce(F.lead("_start").over(by), F.first("_start").over(by)).alias("_after"))
    out = rows.withColumn("_next", F.lead("path").over(Window.partitionBy("split", "_b").orderBy("path"))).join(starts.hint("merge"), ["split", "_b"])
    return out.select("path", "split", F.coalesce("_next", "_after").alias("donor"))


def plan_filter(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Generated rows of a planned (split, source); others stay."""
    keep = rows.filter("class_label = 'ai_generated'").join(F.broadcast(plan), ["split", "source"], "left_semi")
    return keep.select(*rows.columns).unionByName(rows.filter("class_label IS NULL OR class_label <> 'ai_generated'"))


def planned_sample(rows: DataFrame, plan: DataFrame, used_groups: DataFrame, seed: int) -> DataFrame:
    """The first `count` groups of each planned (split, source) by a seeded draw, one row of each group, without used groups."""
    free = rows.join(used_groups.select("source_group").distinct().hint("merge"), "source_group", "left_anti")
    one = first_per_group(free, ["source_group"], seeded(seed, "path"), F.col("path"))
    w = Window.partitionBy("split", "source").orderBy(seeded(seed, "source_group"), F.col("path"))
    return one.join(F.broadcast(plan), ["split", "source"]).withColumn("_rank", F.row_number().over(w)).filter("_rank <= count").drop("_rank")


def derive_pairs(parents: DataFrame, editors: DataFrame) -> DataFrame:
    """Records of each authentic parent: two authentic ones (the parent, a transformed copy) and two manipulated ones, with
    lineage; the editor comes from the split. editors: (split, editor)."""
    p = parents.join(F.broadcast(editors), "split", "left")
    one = lambda suffix, label, editor, how: F.struct(
        F.concat("path", F.lit(suffix)).alias("path"), F.lit(label).alias("class_label"), editor.alias("generator_or_editor"), F.lit(how).alias("transformation")
    )
    records = F.array(
        one("#original", "real_camera", F.lit("authentic"), "none"), one("#recompressed", "real_camera", F.lit("authentic"), "recompressed"),
        one("#edit", "ai_manipulated", F.col("editor"), "none"), one("#edit-recompressed", "ai_manipulated", F.col("editor"), "recompressed"),
    )
    return p.select(F.col("path").alias("parent_media"), "split", "source_group", F.explode(records).alias("r")).select("r.*", "parent_media", "split", "source_group")


def completed_parents(records: DataFrame, listing: DataFrame, version: str, variants: int) -> DataFrame:
    """(parent) of bundles that are done: of that version, with enough variants, every one's file listed."""
    own = records.filter(F.col("version") == version)
    there = own.join(listing.select("path", F.lit(True).alias("_there")).distinct().hint("merge"), "path", "left")
    done = there.groupBy("parent").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("_there", F.lit(False))).alias("whole"))
    return done.filter(F.col("whole") & (F.col("n") >= variants)).select("parent")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ordinal, 0 and on, by the first three hex digits of the key's SHA-256 and then the key. Rows are ordered inside
    these 4,096 buckets, and only the buckets' counts are summed up in order, so no task orders all rows."""
    b = rows.withColumn("_b", F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 3))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = b.groupBy("_b").agg(F.count("*").alias("_c")).select("_b", before.alias("_s"))
    ranked = b.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(key)))
    return ranked.join(F.broadcast(starts), "_b").withColumn("ordinal", F.col("_s") + F.col("_k") - 1).drop("_b", "_s", "_k")


def modulo_pairing(parents: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """parents with `reference`: the i-th parent gets the key of the (i mod n)-th of n references; null if there are none."""
    refs = numbered(references.select(key), key).select(F.col("ordinal").alias("_at"), F.col(key).alias("reference"))
    n = references.agg(F.nullif(F.count("*"), F.lit(0)).alias("_n"))
    own = numbered(parents, key).crossJoin(F.broadcast(n)).withColumn("_at", F.pmod("ordinal", F.col("_n")))
    return own.join(refs.hint("merge"), "_at", "left").drop("_at", "_n", "ordinal")
