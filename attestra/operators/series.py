"""Ordered frame series: one row for each frame, keyed by video_id and frame_index."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.scores import clamp, ratio
from attestra.shipping import ship_package

# What is a scene cut, a duplicate frame, a high frame.
CUT_DELTA, CUT_CORRELATION, DUPLICATE_DELTA, HIGH = 0.18, 0.65, 0.0015, 0.65
FLOW = ("flow_warp_error", "flow_inconsistency")


def _order():
    return Window.partitionBy("video_id").orderBy("frame_index")


def frame_deltas(frames: DataFrame) -> DataFrame:
    """frames with luma_delta, noise_delta, edge_delta, scene_cut, duplicate and anomaly; null and false on first frames."""
    before = lambda c: F.lag(c).over(_order())
    out = frames.withColumns({f"_{c}": before(c) for c in ("luma", "noise", "edge_density")})
    luma = F.abs(F.col("luma") - F.col("_luma"))
    out = out.withColumns(
        {
            "luma_delta": luma,
            "noise_delta": F.abs(F.col("noise") - F.col("_noise")) / F.greatest(F.lit(1.0), F.col("noise"), F.col("_noise")),
            "edge_delta": F.abs(F.col("edge_density") - F.col("_edge_density")),
            "scene_cut": F.coalesce((luma >= CUT_DELTA) & (F.col("hist_correlation") < CUT_CORRELATION), F.lit(False)),
        }
    )
    duplicate = F.coalesce(~F.col("scene_cut") & (F.col("luma_delta") <= DUPLICATE_DELTA), F.lit(False))
    anomaly = 0.72 * F.col("luma_delta") + 0.23 * F.greatest(F.lit(0.0), 1 - F.col("hist_correlation")) + 0.05 * F.col("edge_density")
    anomaly = F.when(F.col("luma_delta").isNotNull(), anomaly)
    return out.withColumns({"duplicate": duplicate, "anomaly": anomaly}).drop("_luma", "_noise", "_edge_density")


def longest_run(frames: DataFrame, hit: Column) -> DataFrame:
    """(video_id, run, n): the longest stretch of frames with hit, and all frames. Gaps and islands: within a stretch the
    frame's rank less its rank among the hits is the same."""
    at = F.row_number().over(_order())
    inside = Window.partitionBy("video_id", "_hit").orderBy("frame_index")
    runs = frames.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_island", at - F.row_number().over(inside))
    sizes = runs.groupBy("video_id", "_island", "_hit").agg(F.count("*").alias("size"))
    return sizes.groupBy("video_id").agg(F.coalesce(F.max(F.when(F.col("_hit"), F.col("size"))), F.lit(0)).alias("run"), F.sum("size").alias("n"))


def longest_run_share(frames: DataFrame, value: str, threshold: float = HIGH) -> DataFrame:
    return longest_run(frames, F.col(value) >= threshold).select("video_id", ratio(F.col("run"), F.col("n")).alias("share"))


def persistent_run(frames: DataFrame, value: str, threshold: float = 0.95, run: int = 3) -> DataFrame:
    """(video_id, persistent): whether `run` frames in a row reach the threshold."""
    return longest_run(frames, F.col(value) >= threshold).select("video_id", (F.col("run") >= run).alias("persistent"))


def frame_states(frames: DataFrame, threshold: float = HIGH) -> DataFrame:
    """What a stream holds of each video when all its frames have come in order: frames, last_index, high_run (the run of high
    frames at its end), longest_run, mean_probability, luma_total. Frame indexes of a video are distinct."""
    high = F.coalesce(F.col("ai_probability") >= threshold, F.lit(False))
    low = frames.groupBy("video_id").agg(F.max(F.when(~high, F.col("frame_index"))).alias("_low"))
    d = frames.withColumn("_d", F.abs(F.col("luma") - F.lag("luma").over(_order()))).join(low.hint("merge"), "video_id")
    out = d.groupBy("video_id").agg(
        F.count("*").alias("frames"), F.max("frame_index").cast("long").alias("last_index"), F.count_if(F.col("_low").isNull() | (F.col("frame_index") > F.col("_low"))).alias("high_run"),
        F.avg("ai_probability").alias("mean_probability"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("luma_total"),
    )
    runs = longest_run(frames, high).select("video_id", F.col("run").alias("longest_run"))
    return out.join(runs.hint("merge"), "video_id")


def video_features(frames: DataFrame) -> DataFrame:
    """One row for each video: mean, deviation, percentiles, shares, runs and pair-based ratios of its series.

    pixel_probability, flow_warp_error and flow_inconsistency may be missing; without any value the first is 0.5 and the others
    are 0. Flow counts between frames that are neither a scene cut nor a duplicate.
    """
    every = frames.withColumns({c: F.lit(None).cast("double") for c in ("pixel_probability", *FLOW) if c not in frames.columns})
    d = frame_deltas(every)
    moving = F.col("luma_delta").isNotNull() & ~F.col("scene_cut") & ~F.col("duplicate")
    d = d.withColumns({c: F.when(moving, F.col(c)) for c in FLOW})
    p = lambda c, q: F.percentile(c, q)
    pairs = F.greatest(F.lit(1), F.count("*") - 1).cast("double")
    ai, truth, luma = "ai_probability", "truth_score", "luma_delta"
    out = d.groupBy("video_id").agg(
        F.coalesce(F.avg(ai), F.lit(0.5)).alias("frame_ai_probability_mean"), F.coalesce(F.stddev_pop(ai), F.lit(0.0)).alias("frame_ai_probability_std"),
        F.coalesce(p(ai, 0.9), F.lit(0.5)).alias("frame_ai_probability_p90"), F.coalesce(p(ai, 0.95), F.lit(0.5)).alias("frame_ai_probability_p95"),
        (F.count_if(F.col(ai) >= HIGH) / F.greatest(F.lit(1), F.count(ai))).alias("frame_ai_high_risk_ratio"),
        F.coalesce(F.avg(truth), F.lit(50.0)).alias("frame_truth_score_mean"), F.coalesce(F.stddev_pop(truth), F.lit(0.0)).alias("frame_truth_score_std"),
        F.coalesce(p(truth, 0.1), F.lit(50.0)).alias("frame_truth_score_p10"),
        F.coalesce(F.avg(luma), F.lit(0.0)).alias("luma_delta_mean"), F.coalesce(F.stddev_pop(luma), F.lit(0.0)).alias("luma_delta_std"), F.coalesce(p(luma, 0.95), F.lit(0.0)).alias("luma_delta_p95"),
        F.coalesce(F.avg("noise_delta"), F.lit(0.0)).alias("noise_delta_mean"), F.coalesce(F.avg("edge_delta"), F.lit(0.0)).alias("edge_density_delta_mean"),
        F.coalesce(F.avg("pixel_probability"), F.lit(0.5)).alias("pixel_forensic_probability_mean"), F.coalesce(p("pixel_probability", 0.95), F.lit(0.5)).alias("pixel_forensic_probability_p95"),
        F.coalesce(F.avg("flow_warp_error"), F.lit(0.0)).alias("flow_warp_error_mean"), F.coalesce(p("flow_warp_error", 0.95), F.lit(0.0)).alias("flow_warp_error_p95"),
        F.coalesce(F.avg("flow_inconsistency"), F.lit(0.0)).alias("flow_inconsistency_mean"),
        (F.count_if("duplicate") / pairs).alias("duplicate_frame_ratio"), (F.count_if("scene_cut") / pairs).alias("scene_cut_ratio"), F.count("*").alias("frames"),
    )
    return out.join(longest_run_share(frames, ai).withColumnRenamed("share", "frame_ai_sustained_ratio"), "video_id")


def temporal_rules(features: DataFrame) -> DataFrame:
    """(video_id, probability, reasons): a rule-based score of the features; 0.35 for under three frames."""
    rules = [
        (F.col("flow_warp_error_mean") > 0.10, 0.10, "warp"), (F.col("flow_warp_error_p95") > 0.18, 0.10, "warp_peaks"), (F.col("flow_inconsistency_mean") > 1.35, 0.08, "flow"),
        (F.col("noise_delta_mean") > 0.38, 0.09, "noise"), (F.col("edge_density_delta_mean") > 0.055, 0.06, "edges"),
        (F.col("duplicate_frame_ratio") > 0.18, 0.07, "duplicates"), (F.col("frame_ai_sustained_ratio") >= 0.35, 0.12, "sustained"),
    ]
    total = F.lit(0.12)
    for condition, weight, _ in rules:
        total = total + F.when(condition, weight).otherwise(0.0)
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, _, name in rules]), lambda x: x.isNotNull())
    few = F.col("frames") < 3
    return features.select(
        "video_id", F.when(few, 0.35).otherwise(clamp(total, 0.03, 0.90)).alias("probability"),
        F.when(few, F.array(F.lit("few_frames"))).when(F.size(reasons) == 0, F.array(F.lit("none"))).otherwise(reasons).alias("reasons"),
    )


def second_order_motion(frames: DataFrame) -> DataFrame:
    """(video_id, mean, p95, label): the change of consecutive luma deltas; 0 for under three frames."""
    motion = frame_deltas(frames).filter("luma_delta IS NOT NULL")
    d = motion.withColumn("_d", F.abs(F.col("luma_delta") - F.lag("luma_delta").over(_order())))
    out = d.groupBy("video_id").agg(F.coalesce(F.avg("_d"), F.lit(0.0)).alias("mean"), F.coalesce(F.percentile("_d", 0.95), F.lit(0.0)).alias("p95"))
    return out.withColumn("label", F.when(F.col("mean") >= 0.20, "elevated").otherwise("ordinary"))


def windowed_range(frames: DataFrame, value: str) -> DataFrame:
    """(video_id, value_range): range of the means of about eight stretches; null for under eight values."""
    rows = frames.filter(F.col(value).isNotNull())
    n = F.count("*").over(Window.partitionBy("video_id"))
    rows = rows.withColumn("_n", n).withColumn("_chunk", F.floor((F.row_number().over(_order()) - 1) / F.greatest(F.lit(2), F.floor(n / 8))))
    means = rows.groupBy("video_id", "_n", "_chunk").agg(F.avg(value).alias("m"))
    return means.groupBy("video_id").agg(F.when(F.max("_n") >= 8, F.max("m") - F.min("m")).alias("value_range"))


def uniform_positions(n: Column, k: Column) -> Column:
    """k whole positions from 0 to n - 1, evenly spaced, half to even, distinct; all of them if k >= n."""
    few = F.least(n, k)
    spread = F.transform(F.sequence(F.lit(0), F.greatest(few, F.lit(1)) - 1), lambda i: F.bround(i * (n - 1).cast("double") / F.greatest(few - 1, F.lit(1)), 0).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).otherwise(F.array_distinct(spread))


def adaptive_positions(frames: DataFrame, limit: int, fps: float = 30.0) -> DataFrame:
    """(video_id, frame_index): frames to look at. Uniform ones, scene boundaries, and the limit / 3 highest anomalies with
    neighbours; beyond the limit, uniform ones first, then by anomaly, then early ones."""
    d = frame_deltas(frames).select("video_id", "frame_index", "scene_cut", "anomaly")
    sizes = d.groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    cap = F.least(F.lit(max(1, limit)), F.col("n"))
    spread = sizes.select("video_id", "n", F.explode(uniform_positions(F.col("n"), F.least(cap, F.greatest(F.lit(16), F.floor(cap / 2).cast("int"))))).alias("frame_index"))
    required = sizes.select("video_id", "n", F.explode(F.array_union(F.array(F.lit(0), F.col("n") - 1), uniform_positions(F.col("n"), F.least(F.lit(16), cap)))).alias("frame_index"))
    ranked = d.filter("anomaly IS NOT NULL").withColumn("_r", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("anomaly"), "frame_index")))
    beside = max(1, round(fps * 0.20))
    peaks = ranked.join(sizes.hint("merge"), "video_id").filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(cap / 3)))
    peaks = peaks.select("video_id", "n", F.explode(F.array(*[F.col("frame_index") + i for i in (0, -1, 1, -beside, beside)])).alias("frame_index"))
    cuts = d.filter("scene_cut").join(sizes.hint("merge"), "video_id").select("video_id", "n", "frame_index")
    every = spread.unionByName(peaks).unionByName(cuts).withColumn("_req", F.lit(0)).unionByName(required.withColumn("_req", F.lit(1)))
    every = every.filter("frame_index >= 0 AND frame_index < n").groupBy("video_id", "n", "frame_index").agg(F.max("_req").alias("_req"), F.min("_req").alias("_any"))
    # required positions that no set selected only count once the limit is exceeded
    chosen = every.withColumn("_selected", F.count_if(F.col("_any") == 0).over(Window.partitionBy("video_id")))
    over = F.col("_selected") > cap
    chosen = chosen.filter((F.col("_any") == 0) | over).join(d.select("video_id", "frame_index", "anomaly").hint("merge"), ["video_id", "frame_index"])
    w = Window.partitionBy("video_id").orderBy(F.desc("_req"), F.desc(F.coalesce("anomaly", F.lit(0.0))), "frame_index")
    return chosen.withColumn("_k", F.row_number().over(w)).filter(~over | (F.col("_k") <= cap)).select("video_id", "frame_index")


def window_scores(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, start_frame, end_frame, generation, manipulation, start_time, end_time, n) of frame intervals.

    windows: (start_frame, end_frame), a short list for every series, which is broadcast; or with video_id, each series' own,
    which are joined by video_id with a range condition beside it."""
    inside = (F.col("frame_index") >= F.col("start_frame")) & (F.col("frame_index") <= F.col("end_frame"))
    if "video_id" in windows.columns:
        own = windows.select(F.col("video_id").alias("_video"), "start_frame", "end_frame")
        j = frames.join(own.hint("merge"), (F.col("video_id") == F.col("_video")) & inside)
    else:
        j = frames.join(F.broadcast(windows), inside)
    at = lambda c: F.when(F.max("fps") > 0, F.col(c) / F.max("fps"))
    return j.groupBy("video_id", "start_frame", "end_frame").agg(
        F.avg("ai_probability").alias("generation"), F.avg("manipulation_probability").alias("manipulation"), F.count("*").alias("n"), at("start_frame").alias("start_time"), at("end_frame").alias("end_time")
    )


def suspicious_frames(frames: DataFrame, n: int = 12) -> DataFrame:
    """The n most suspicious frames of each video: truth under 50, or a high score of either kind."""
    g, m = F.coalesce("ai_probability", F.lit(0.0)), F.coalesce("manipulation_probability", F.lit(0.0))
    kind = F.when((g >= HIGH) & (g >= m), "generation").when(m >= HIGH, "manipulation").otherwise("truth")
    rows = frames.filter((F.col("truth_score") < 50) | (g >= HIGH) | (m >= HIGH)).withColumn("kind", kind).withColumn("score", F.greatest(g, m))
    w = Window.partitionBy("video_id").orderBy(F.desc("score"), F.asc("truth_score"), "frame_index")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("video_id", "frame_index", "kind", "score", "truth_score", "rank")


def analysis_coverage(frames: DataFrame, expected: int) -> DataFrame:
    """(video_id, analysed, coverage, exhaustive, suspicious_ratio)."""
    bad = (F.col("truth_score") < 50) | (F.col("ai_probability") >= HIGH)
    return frames.groupBy("video_id").agg(
        F.count("*").alias("analysed"), F.least(F.lit(1.0), F.count("*") / F.lit(float(max(1, expected)))).alias("coverage"), (F.count("*") >= expected).alias("exhaustive"), F.avg(bad.cast("double")).alias("suspicious_ratio")
    )


def top_messages(frames: DataFrame, n: int = 2) -> DataFrame:
    """(video_id, message, times): the most common messages of each video, the first seen among equals."""
    by = frames.groupBy("video_id", F.col("warning").alias("message")).agg(F.count("*").alias("times"), F.min("frame_index").alias("first"))
    w = Window.partitionBy("video_id").orderBy(F.desc("times"), "first")
    return by.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select("video_id", "message", "times")


def frame_notes(frames: DataFrame) -> DataFrame:
    """(video_id, notes): the messages of the first three frames, in order."""
    rows = frames.withColumn("_r", F.row_number().over(_order())).filter("_r <= 3")
    return rows.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "warning"))), lambda x: x["warning"]).alias("notes"))


def frame_selection(frames: DataFrame, stride: int) -> DataFrame:
    return frames.filter(F.pmod("frame_index", F.lit(stride)) == 0)


def frame_score_summary(frames: DataFrame, value: str) -> DataFrame:
    return frames.groupBy("video_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("minimum"), F.percentile(value, 0.1).alias("p10"), F.max(value).alias("maximum"))


def per_series(rows: DataFrame, key: str, order: str, choose: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """choose over each series of a key, its rows in order; schema: the key's and what choose gives. A series is one pandas group,
    so this is for series that a task can hold, and for choices that depend on one another; give it few columns."""
    ship_package(rows.sparkSession)
    return rows.groupBy(key).applyInPandas(lambda pdf: choose(pdf.sort_values(order, ignore_index=True)), schema)


def temporal_windows(frames: DataFrame, limit: int = 6, fps: float = 30.0) -> DataFrame:
    """(video_id, start_frame, end_frame, reason): windows around anomaly peaks in order of their score, then around uniform
    positions; one that overlaps a chosen window is skipped. Each choice depends on the ones before it, so a series is
    one pandas group: one video's scores, two columns."""
    d = frame_deltas(frames).select("video_id", "frame_index", "anomaly")
    half = max(2, round(fps * 0.75)) if fps > 0 else None

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(pdf)
        reach = half if half is not None else max(2, n // 40)
        peaks = pdf.dropna(subset=["anomaly"]).sort_values(["anomaly", "frame_index"], ascending=[False, True])["frame_index"].tolist()
        k = min(4, limit, n)
        uniform = [round(i * (n - 1) / max(1, k - 1)) for i in range(k)]
        chosen: list[tuple[int, int, str]] = []
        for place, center in enumerate([*peaks, *uniform]):
            if len(chosen) >= limit:
                break
            start, end = max(0, center - reach), min(n - 1, center + reach)
            if all(end < s or start > e for s, e, _ in chosen):
                chosen.append((start, end, "anomaly_peak" if place < len(peaks) else "uniform_coverage"))
        rows = sorted(chosen)
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "start_frame": [r[0] for r in rows], "end_frame": [r[1] for r in rows], "reason": [r[2] for r in rows]})

    return per_series(d, "video_id", "frame_index", choose, "video_id long, start_frame int, end_frame int, reason string")


def video_context_score(frames: DataFrame, width: int, height: int, fps: float = 30.0) -> DataFrame:
    """(video_id, score): the mean frame score, less for suspicious frames, missing metadata, short and small videos."""
    bad = (F.col("truth_score") < 50) | (F.col("ai_probability") >= HIGH) | (F.col("manipulation_probability") >= HIGH)
    v = frames.groupBy("video_id").agg(F.avg("truth_score").alias("mean"), F.avg(bad.cast("double")).alias("share"), F.count("*").alias("n"))
    share = F.col("share")
    left = F.col("mean") - F.when(share >= 0.20, F.least(F.lit(14.0), 5.0 + share * 15.0)).when(share > 0, F.least(F.lit(5.0), share * 20.0)).otherwise(0.0)
    # Each loss is taken off the rest: a sum of losses rounds otherwise, and a score between two whole ones then tips over.
    if fps <= 0:
        left = left - 8
    else:
        left = left - F.when(F.col("n") / fps < 1.5, 5.0).otherwise(0.0)
    if width < 360 or height < 240:
        left = left - 8
    return v.select("video_id", clamp(F.bround(left), 0, 100).cast("int").alias("score"))
