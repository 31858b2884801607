"""Putting tables together: masks, listings, bundles, detector lists, errors to look at."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.operators.fusion import robust

# Weights of a video's generation score, and what each kind of evidence adds to the confidence of an analysis.
SUMMARY_WEIGHT, TRAINED_WEIGHT, OTHER_WEIGHT = 1.25, 1.35, 0.55
CONFIDENCE, WITH_MODEL, WITH_DETECTOR, WITH_PROVENANCE, WITH_WEB = 0.45, 0.18, 0.08, 0.10, 0.15


def mask_join(manifest: DataFrame, masks: DataFrame, split: str, positive: Column) -> DataFrame:
    """Rows of a split with their mask, by path, and mask_missing: positives without one, which training must refuse."""
    own = masks.select("path", F.col("mask").alias("mask"))
    rows = manifest.filter(F.col("split") == split).join(own.hint("merge"), "path", "left")
    return rows.withColumn("mask_missing", F.coalesce(positive, F.lit(False)) & F.col("mask").isNull())


def eligible_rows(manifest: DataFrame, listing: DataFrame, split: str, labels: list[str]) -> DataFrame:
    """Rows of a split and of some labels whose file is listed."""
    rows = manifest.filter((F.col("split") == split) & F.col("class_label").isin(labels))
    return rows.join(listing.select("path").hint("merge"), "path", "left_semi")


def misclassified_top(preds: DataFrame, expected: str, predicted: Column, n: int = 40) -> DataFrame:
    """The first n rows by path whose prediction is not the expected label."""
    rows = preds.withColumn("predicted", predicted).filter(F.col("predicted") != F.col(expected))
    return rows.orderBy("path").limit(n)


def label_intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """Labels that both sides know; each side is one column, named label. Null is no label."""
    return left.select("label").intersect(right.select("label")).filter("label IS NOT NULL")


def finalize_union(bundles: list[DataFrame], version: str) -> DataFrame:
    """The bundles' rows of one version, sorted by split and path."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), bundles)
    return every.filter(F.col("version") == version).orderBy("split", "path")


def valid_bundles(bundles: DataFrame, listing: DataFrame, version: str) -> DataFrame:
    """bundles (parent, version, records, localization: an array of structs with path and mask_path) of one version that have a
    localization, all of whose files are listed. parent names a bundle."""
    own = bundles.filter((F.col("version") == version) & (F.coalesce(F.size("localization"), F.lit(0)) > 0))
    both = F.transform("localization", lambda x: F.array(x["path"], x["mask_path"]))
    files = own.select("parent", F.explode(F.flatten(both)).alias("file"))
    there = listing.select(F.col("path").alias("file"), F.lit(True).alias("_there")).distinct()
    lost = files.join(there.hint("merge"), "file", "left").filter("_there IS NULL").select("parent").distinct()
    return own.join(lost.hint("merge"), "parent", "left_anti")


def finalized(bundles: DataFrame, listing: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """The records, and the localization rows, of all valid bundles, each sorted by split and path."""
    good = valid_bundles(bundles, listing, version)
    rows = lambda c: good.select(F.explode(c).alias("r")).select("r.*").orderBy("split", "path")
    return rows("records"), rows("localization")


def frame_summaries(frames: DataFrame, key: str = "video_id") -> DataFrame:
    """Two detector rows for each video (media_id, name, status, label, task, synthetic_probability, manipulation_probability,
    model_version, n): the robust score of its frames' generation scores, and of their manipulation scores. A video without
    any score of a kind has an unavailable row; the manipulation row supports and never decides."""
    p = F.lit(None).cast("double")
    generation, manipulation = robust(F.col("ai_probability")), robust(F.col("manipulation_probability"))
    g = frames.groupBy(F.col(key).alias("media_id")).agg(generation.alias("g"), manipulation.alias("m"), F.count("ai_probability").alias("ng"), F.count("manipulation_probability").alias("nm"))
    state = lambda v: F.when(v.isNull(), "unavailable").otherwise("completed")
    label = F.when(F.col("g") >= 0.65, "likely_synthetic").when(F.col("g") <= 0.35, "lower_signal").when(F.col("g").isNotNull(), "uncertain")
    first = g.select(
        "media_id", F.lit("all_frame_ai_detector_summary").alias("name"), state(F.col("g")).alias("status"), label.alias("label"), F.lit("generation").alias("task"),
        F.col("g").alias("synthetic_probability"), p.alias("manipulation_probability"), F.lit("frame-fusion-v4").alias("model_version"), F.col("ng").alias("n"),
    )
    second = g.select(
        "media_id", F.lit("all_frame_manipulation_screen_summary").alias("name"), state(F.col("m")).alias("status"), F.lit("editing_signal_summary").alias("label"), F.lit("supporting").alias("task"),
        p.alias("synthetic_probability"), F.col("m").alias("manipulation_probability"), F.lit("frame-manipulation-screen-v4").alias("model_version"), F.col("nm").alias("n"),
    )
    return first.unionByName(second)


def model_versions(detectors: DataFrame) -> DataFrame:
    """(media_id, model_versions): the distinct versions (the name where there is none) of a medium's completed deciding rows, in
    the order in which they come first; detectors: media_id, pos, name, model_version, status, task."""
    used = detectors.filter((F.col("status") == "completed") & F.coalesce("task", F.lit("generation")).isin("generation", "manipulation", "temporal"))
    named = used.withColumn("v", F.trim(F.coalesce(F.nullif("model_version", F.lit("")), "name", F.lit("")))).filter("v <> ''")
    first = named.groupBy("media_id", "v").agg(F.min("pos").alias("pos"))
    return first.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("model_versions"))


def detector_union(*frames: DataFrame) -> DataFrame:
    """All detector rows in one table; columns that a list lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def video_fusion(summary: DataFrame, detectors: DataFrame, trained: str) -> DataFrame:
    """(media_id, probability): weighted mean of a video's frame summary (media_id, summary), its trained detector and other
    generation detectors (media_id, name, task, synthetic_probability). A missing task is generation; missing scores count
    nothing, and without any score there is none."""
    weight = F.when(F.col("name") == trained, TRAINED_WEIGHT).otherwise(OTHER_WEIGHT)
    rows = detectors.filter(F.coalesce("task", F.lit("generation")) == "generation").select("media_id", F.col("synthetic_probability").alias("p"), weight.alias("w"))
    every = summary.select("media_id", F.col("summary").alias("p"), F.lit(SUMMARY_WEIGHT).alias("w")).unionByName(rows)
    used = F.when(F.col("p").isNotNull(), F.col("w"))
    return every.groupBy("media_id").agg((F.sum(F.col("p") * F.col("w")) / F.sum(used)).alias("probability"))


def analysis_confidence(models: Column, completed: Column, provenance: Column, web: Column) -> Column:
    """Confidence of an analysis, 0.2 to 0.9: models: completed learned models; completed: whether any detector has."""
    yes = lambda test, value: F.when(test, value).otherwise(0.0)
    learned = F.when(models > 0, WITH_MODEL).when(completed, WITH_DETECTOR).otherwise(0.0)
    total = CONFIDENCE + learned + yes(provenance.isin("verified", "no_manifest"), WITH_PROVENANCE) + yes(web.isin("completed", "no_results"), WITH_WEB)
    return F.round(F.greatest(F.lit(0.2), F.least(F.lit(0.9), total)), 2)


def analysis_mode(web: Column) -> Column:
    return F.when(web.isin("completed", "no_results", "error"), "enhanced_free_hybrid").otherwise("enhanced_free_local")
