"""One score for each medium from its detectors' rows. Only completed rows count as learned scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.scores import clamp, logit, probability, sigmoid

# Names with a part of their own, and the weights of the others.
HEURISTIC, FUSED, TILED, COMMUNITY, PACKAGED = "local_heuristic_synthetic_likelihood", "fusion", ":tiled_pixel_scan", "community-forensics::", "packaged-detector"
WEIGHTS = {TILED: 0.75, COMMUNITY: 1.25, PACKAGED: 0.75}


def generation_weight(name: Column) -> Column:
    return (
        F.when(name.endswith(TILED), WEIGHTS[TILED]).when(name.startswith(COMMUNITY), WEIGHTS[COMMUNITY]).when(F.contains(F.lower(name), F.lit(PACKAGED)), WEIGHTS[PACKAGED]).otherwise(1.0)
    )


def _parts() -> dict[str, Column]:
    task = F.coalesce(F.col("task"), F.lit("generation"))
    done, p = F.col("status") == "completed", F.col("synthetic_probability").cast("double")
    usable = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    return {"task": task, "done": done, "p": p, "usable": usable, "name": F.col("name")}


def generation_fusion(detectors: DataFrame, reused: Column | None = None) -> DataFrame:
    """(media_id, generation_score): the last completed fusion row; else the weighted mean of completed learned rows of the
    generation task, reused tiles left out; else the mean of heuristic rows of that task; else null. Clamped to [0, 1]."""
    x = _parts()
    generation = x["usable"] & (x["task"] == "generation") & (x["name"] != FUSED)
    fused = x["usable"] & x["done"] & (x["name"] == FUSED)
    learned = generation & x["done"] & (x["name"] != HEURISTIC)
    if reused is not None:
        learned = learned & ~(reused & x["name"].endswith(TILED))
    fallback = generation & (x["name"] == HEURISTIC)
    w = generation_weight(x["name"])
    out = detectors.groupBy("media_id").agg(
        F.max_by(F.when(fused, x["p"]), F.when(fused, F.col("pos"))).alias("fused"),
        (F.sum(F.when(learned, x["p"] * w)) / F.sum(F.when(learned, w))).alias("learned"),
        F.avg(F.when(fallback, x["p"])).alias("fallback"),
    )
    return out.select("media_id", clamp(F.coalesce("fused", "learned", "fallback"), 0, 1).alias("generation_score"))


def _learned(field: str, task: str | None) -> Column:
    ok = (F.col("status") == "completed") & (F.col("name") != HEURISTIC)
    if task:
        ok = ok & (F.coalesce(F.col("task"), F.lit("generation")) == task)
    return F.when(ok, probability(field))


def manipulation_fusion(detectors: DataFrame) -> DataFrame:
    """(media_id, manipulation_score): the largest completed score of the manipulation task, else the mean of all tasks'."""
    out = detectors.groupBy("media_id").agg(
        F.max(_learned("manipulation_probability", "manipulation")).alias("d"), F.avg(_learned("manipulation_probability", None)).alias("s")
    )
    return out.select("media_id", F.coalesce("d", "s").alias("manipulation_score"))


def detector_summary(detectors: DataFrame) -> DataFrame:
    """(media_id, max_probability, mean_manipulation, completed_models, generation_range): a range needs two scores."""
    generation = _learned("synthetic_probability", "generation")
    return detectors.groupBy("media_id").agg(
        clamp(F.max(F.when(F.col("status") == "completed", F.col("synthetic_probability"))), 0, 1).alias("max_probability"),
        F.avg(_learned("manipulation_probability", None)).alias("mean_manipulation"),
        F.count_if((F.col("status") == "completed") & (F.coalesce(F.col("task"), F.lit("generation")) == "generation") & (F.col("name") != HEURISTIC)).alias("completed_models"),
        F.when(F.count(generation) >= 2, F.max(generation) - F.min(generation)).alias("generation_range"),
    )


def robust(v: Column, task: str = "generation") -> Column:
    """The aggregate that robust_score gives; null without values."""
    mean, p90, p95, high = F.avg(v), F.percentile(v, 0.9), F.percentile(v, 0.95), F.avg((v >= 0.65).cast("double"))
    if task == "manipulation":
        return clamp(0.15 * mean + 0.20 * p90 + 0.25 * p95 + 0.30 * F.max(v) + 0.10 * high, 0, 1)
    return clamp(0.55 * mean + 0.30 * p90 + 0.15 * high, 0, 1)


def robust_score(df: DataFrame, key: str, value: str, task: str = "generation") -> DataFrame:
    """(key, score): mean, upper percentiles and share of high values of each group, weighted by task."""
    return df.groupBy(key).agg(robust(F.col(value), task).alias("score"))


def tile_rollup(tiles: DataFrame, task: str = "generation") -> DataFrame:
    """One detector row for each medium from its tiles (media_id, tile, score): status, label, score, tiles used, mean,
    percentiles, maximum, share of high tiles, and the highest tiles (see top_tiles). A score that is missing is a tile
    whose labels were not understood; a medium with no other tiles is `unsupported_labels`."""
    v = F.col("score")
    out = tiles.groupBy("media_id").agg(
        robust(v, task).alias("score"), F.count(v).alias("tiles"), F.avg(v).alias("mean"), F.percentile(v, 0.9).alias("p90"), F.percentile(v, 0.95).alias("p95"),
        F.max(v).alias("maximum"), F.avg((v >= 0.65).cast("double")).alias("suspicious_ratio"),
    )
    none = F.col("tiles") == 0
    kind = "manipulated" if task == "manipulation" else "synthetic"
    label = F.when(F.col("score") >= 0.65, f"tiled_regions_likely_{kind}").when(F.col("score") >= 0.35, "tiled_regions_uncertain").otherwise("tiled_regions_lower_signal")
    out = out.withColumns({"status": F.when(none, "unsupported_labels").otherwise("completed"), "label": F.when(~none, label), "score": F.when(~none, F.col("score"))})
    top = top_tiles(tiles).groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tile"))), lambda x: x["tile"]).alias("top"))
    return out.join(top, "media_id", "left").withColumn("top", F.coalesce("top", F.array().cast(top.schema["top"].dataType)))


def video_score_rollup(frames: DataFrame, key: str, value: str) -> DataFrame:
    """(key, score) = 0.70 mean + 0.30 90th percentile."""
    return frames.groupBy(key).agg((0.70 * F.avg(value) + 0.30 * F.percentile(value, 0.9)).alias("score"))


def logit_fusion(detectors: DataFrame, first: str, second: str, bias: float, weights: tuple[float, float]) -> DataFrame:
    """(media_id, fused): a logistic model of two detectors' logits; null unless both have completed."""
    score = lambda name: F.max_by(F.when((F.col("name") == name) & (F.col("status") == "completed"), probability("synthetic_probability")), F.when((F.col("name") == name) & (F.col("status") == "completed") & F.col("synthetic_probability").isNotNull(), F.col("pos")))
    two = detectors.groupBy("media_id").agg(score(first).alias("a"), score(second).alias("b"))
    return two.select("media_id", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), sigmoid(bias + weights[0] * logit("a") + weights[1] * logit("b"))).alias("fused"))


def weighted_score(values: Column, weights: Column) -> Column:
    """Weighted mean of an array of scores from 0 to 100, clamped; a missing score is 50, no weight at all is 50."""
    pairs = F.zip_with(values, weights, lambda v, w: F.struct((F.coalesce(v, F.lit(50.0)) * w).alias("vw"), w.alias("w")))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["w"])
    return clamp(F.when(total == 0, 50.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["vw"]) / F.nullif(total, F.lit(0.0))), 0, 100)


def view_stability(views: DataFrame, limit: float) -> DataFrame:
    """(media_id, original, view_range, force_inconclusive, n) over rows (media_id, view, score)."""
    return views.groupBy("media_id").agg(
        F.max(F.when(F.col("view") == "original", F.col("score"))).alias("original"),
        (F.max("score") - F.min("score")).alias("view_range"),
        ((F.max("score") - F.min("score")) > limit).alias("force_inconclusive"),
        F.count("score").alias("n"),
    )


def robustness_report(variants: DataFrame, low: float, high: float) -> DataFrame:
    """(image, minimum, mean, median, passed, all_passed) over rows (image, expected_ai, score): a variant passes if its
    verdict is the expected one; undecided ones do not."""
    ok = F.when(F.col("expected_ai"), F.col("score") >= high).otherwise(F.col("score") <= low)
    return variants.groupBy("image").agg(
        F.min("score").alias("minimum"), F.avg("score").alias("mean"), F.percentile("score", 0.5).alias("median"), F.count_if(ok).alias("passed"), F.coalesce(F.bool_and(ok), F.lit(False)).alias("all_passed")
    )


def top_tiles(tiles: DataFrame, n: int = 5, minimum: float = 0.65) -> DataFrame:
    """The n highest tiles of each medium that are high enough; a medium of one tile has none."""
    from pyspark.sql import Window

    w = Window.partitionBy("media_id").orderBy(F.desc("score"), "tile")
    count = F.count("*").over(Window.partitionBy("media_id"))
    return tiles.withColumn("rank", F.row_number().over(w)).withColumn("tiles", count).filter((F.col("rank") <= n) & (F.col("score") >= minimum) & (F.col("tiles") > 1))
