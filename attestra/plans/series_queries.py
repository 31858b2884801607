"""Queries on frame series."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import series
from attestra.plans.registry import query

DELTAS = """, d0 AS (SELECT *, abs(luma - lag(luma) OVER w) AS luma_delta, abs(noise - lag(noise) OVER w) / greatest(1.0, noise, lag(noise) OVER w) AS noise_delta, abs(edge_density - lag(edge_density) OVER w) AS edge_delta
 FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)),
d AS (SELECT *, coalesce(luma_delta >= 0.18 AND hist_correlation < 0.65, false) AS scene_cut, coalesce(NOT (luma_delta >= 0.18 AND hist_correlation < 0.65) AND luma_delta <= 0.0015, false) AS duplicate,
 CASE WHEN luma_delta IS NOT NULL THEN 0.72 * luma_delta + 0.23 * greatest(0, 1 - hist_correlation) + 0.05 * edge_density END AS anomaly FROM d0)
"""
RUNS = """, h AS (SELECT video_id, frame_index, ai_probability >= {t} AS hit FROM frames), g AS (SELECT video_id, frame_index, hit, frame_index - row_number() OVER (PARTITION BY video_id, hit ORDER BY frame_index) AS island FROM h),
runs AS (SELECT video_id, coalesce(max(k) FILTER (hit), 0) AS run, sum(k) AS n FROM (SELECT video_id, hit, island, count(*) AS k FROM g GROUP BY ALL) GROUP BY video_id)
"""
_R = "round({0}, 10) AS {0}"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 10) for c in columns})


@query("frames", DELTAS + f"SELECT video_id, frame_index, {', '.join(_R.format(c) for c in ('luma_delta', 'noise_delta', 'edge_delta', 'anomaly'))}, scene_cut, duplicate FROM d")
def frame_deltas(frames):
    d = series.frame_deltas(frames).select("video_id", "frame_index", "luma_delta", "noise_delta", "edge_delta", "anomaly", "scene_cut", "duplicate")
    return _rounded(d, "luma_delta", "noise_delta", "edge_delta", "anomaly")


@query("frames", RUNS.format(t=0.65) + "SELECT video_id, run / n AS share FROM runs")
def longest_run_share(frames):
    return series.longest_run_share(frames, "ai_probability")


@query("frames", RUNS.format(t=0.5) + "SELECT video_id, run >= 3 AS persistent FROM runs")
def persistent_run(frames):
    return series.persistent_run(frames, "ai_probability", 0.5, 3)


FEATURES = (
    "frame_ai_probability_mean frame_ai_probability_std frame_ai_probability_p90 frame_ai_probability_p95 frame_ai_high_risk_ratio frame_truth_score_mean frame_truth_score_std frame_truth_score_p10 "
    "luma_delta_mean luma_delta_std luma_delta_p95 noise_delta_mean edge_density_delta_mean duplicate_frame_ratio scene_cut_ratio frame_ai_sustained_ratio "
    "pixel_forensic_probability_mean pixel_forensic_probability_p95 flow_warp_error_mean flow_warp_error_p95 flow_inconsistency_mean"
).split()
FEATURE_SQL = (
    DELTAS
    + RUNS.format(t=0.65)
    + """, f AS (SELECT video_id, avg(ai_probability) AS frame_ai_probability_mean, stddev_pop(ai_probability) AS frame_ai_probability_std, quantile_cont(ai_probability, 0.9) AS frame_ai_probability_p90, quantile_cont(ai_probability, 0.95) AS frame_ai_probability_p95,
 count(*) FILTER (ai_probability >= 0.65) / greatest(1, count(ai_probability)) AS frame_ai_high_risk_ratio, avg(truth_score) AS frame_truth_score_mean, stddev_pop(truth_score) AS frame_truth_score_std, quantile_cont(truth_score, 0.1) AS frame_truth_score_p10,
 coalesce(avg(luma_delta), 0) AS luma_delta_mean, coalesce(stddev_pop(luma_delta), 0) AS luma_delta_std, coalesce(quantile_cont(luma_delta, 0.95), 0) AS luma_delta_p95, coalesce(avg(noise_delta), 0) AS noise_delta_mean, coalesce(avg(edge_delta), 0) AS edge_density_delta_mean,
 count(*) FILTER (duplicate) / greatest(1, count(*) - 1) AS duplicate_frame_ratio, count(*) FILTER (scene_cut) / greatest(1, count(*) - 1) AS scene_cut_ratio, count(*) AS frames, any_value(run / n) AS frame_ai_sustained_ratio,
 coalesce(avg(pixel_probability), 0.5) AS pixel_forensic_probability_mean, coalesce(quantile_cont(pixel_probability, 0.95), 0.5) AS pixel_forensic_probability_p95, coalesce(avg(flow_warp_error) FILTER (moving), 0) AS flow_warp_error_mean,
 coalesce(quantile_cont(flow_warp_error, 0.95) FILTER (moving), 0) AS flow_warp_error_p95, coalesce(avg(flow_inconsistency) FILTER (moving), 0) AS flow_inconsistency_mean
 FROM (SELECT *, luma_delta IS NOT NULL AND NOT scene_cut AND NOT duplicate AS moving FROM d) d JOIN runs USING (video_id) GROUP BY video_id)
"""
)


@query("frames", FEATURE_SQL + f"SELECT video_id, frames, {', '.join(_R.format(c) for c in FEATURES)} FROM f")
def video_features(frames):
    return _rounded(series.video_features(frames).select("video_id", "frames", *FEATURES), *FEATURES)


@query(
    "frames",
    FEATURE_SQL
    + """, r AS (SELECT video_id, frames, list_filter([CASE WHEN flow_warp_error_mean > 0.10 THEN 'warp' END, CASE WHEN flow_warp_error_p95 > 0.18 THEN 'warp_peaks' END, CASE WHEN flow_inconsistency_mean > 1.35 THEN 'flow' END, CASE WHEN noise_delta_mean > 0.38 THEN 'noise' END, CASE WHEN edge_density_delta_mean > 0.055 THEN 'edges' END, CASE WHEN duplicate_frame_ratio > 0.18 THEN 'duplicates' END,
 CASE WHEN frame_ai_sustained_ratio >= 0.35 THEN 'sustained' END], lambda x: x IS NOT NULL) AS rs FROM f)
SELECT video_id, round(CASE WHEN frames < 3 THEN 0.35 ELSE greatest(0.03, least(0.9, 0.12 + coalesce(list_sum(list_transform(rs, lambda x: CASE x WHEN 'warp' THEN 0.1 WHEN 'warp_peaks' THEN 0.1 WHEN 'flow' THEN 0.08 WHEN 'noise' THEN 0.09 WHEN 'edges' THEN 0.06 WHEN 'duplicates' THEN 0.07 ELSE 0.12 END)), 0))) END::double, 10) AS probability,
 CASE WHEN frames < 3 THEN ['few_frames'] WHEN len(rs) = 0 THEN ['none'] ELSE rs END AS reasons FROM r""",
)
def temporal_rules(frames):
    return _rounded(series.temporal_rules(series.video_features(frames)), "probability")


@query(
    "frames",
    DELTAS
    + """, m AS (SELECT video_id, abs(luma_delta - lag(luma_delta) OVER (PARTITION BY video_id ORDER BY frame_index)) AS s FROM d WHERE luma_delta IS NOT NULL), r AS (SELECT video_id, coalesce(avg(s), 0) AS mean, coalesce(quantile_cont(s, 0.95), 0) AS p95 FROM m GROUP BY video_id)
SELECT video_id, round(mean, 10) AS mean, round(p95, 10) AS p95, CASE WHEN mean >= 0.20 THEN 'elevated' ELSE 'ordinary' END AS label FROM r""",
)
def second_order_motion(frames):
    return _rounded(series.second_order_motion(frames), "mean", "p95")


@query(
    "frames",
    """, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM frames), c AS (SELECT video_id, n, frame_index // greatest(2, n // 8) AS chunk, avg(ai_probability) AS m FROM n GROUP BY ALL)
SELECT video_id, round(CASE WHEN max(n) >= 8 THEN max(m) - min(m) END, 10) AS value_range FROM c GROUP BY video_id""",
)
def windowed_range(frames):
    return _rounded(series.windowed_range(frames, "ai_probability"), "value_range")


@query(
    "frames",
    """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY video_id), p AS (SELECT video_id, unnest(range(0, least(n, 16))) AS i, n FROM n)
SELECT video_id, list(DISTINCT x ORDER BY x) AS positions FROM (SELECT video_id, round_even(i * (n - 1)::double / greatest(least(n, 16) - 1, 1), 0)::int AS x FROM p) GROUP BY video_id""",
)
def uniform_positions(frames):
    n = frames.groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("video_id", series.uniform_positions(F.col("n"), F.lit(16)).alias("positions"))


@query("frames")
def adaptive_positions(frames):
    return series.adaptive_positions(frames, 24)


@query(
    "frames",
    """, w AS (SELECT unnest([0, 20, 40]) AS start_frame, unnest([9, 34, 49]) AS end_frame)
SELECT video_id, start_frame, end_frame, round(avg(ai_probability), 10) AS generation, round(avg(manipulation_probability), 10) AS manipulation, count(*) AS n, round(start_frame / 30.0::double, 10) AS start_time, round(end_frame / 30.0::double, 10) AS end_time
FROM frames JOIN w ON frame_index BETWEEN start_frame AND end_frame GROUP BY video_id, start_frame, end_frame""",
)
def window_scores(frames):
    windows = frames.sparkSession.createDataFrame([(0, 9), (20, 34), (40, 49)], "start_frame int, end_frame int")
    return _rounded(series.window_scores(windows, frames), "generation", "manipulation", "start_time", "end_time")


@query(
    "frames",
    """, s AS (SELECT *, greatest(ai_probability, manipulation_probability) AS score, CASE WHEN ai_probability >= 0.65 AND ai_probability >= manipulation_probability THEN 'generation' WHEN manipulation_probability >= 0.65 THEN 'manipulation' ELSE 'truth' END AS kind
 FROM frames WHERE truth_score < 50 OR ai_probability >= 0.65 OR manipulation_probability >= 0.65)
SELECT video_id, frame_index, kind, score, truth_score, r::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, truth_score, frame_index) AS r FROM s) WHERE r <= 12""",
)
def suspicious_frames(frames):
    return series.suspicious_frames(frames)


@query(
    "frames",
    """SELECT video_id, count(*) AS analysed, least(1.0, count(*) / 64.0::double) AS coverage, count(*) >= 64 AS exhaustive, round(avg((truth_score < 50 OR ai_probability >= 0.65)::int::double), 10) AS suspicious_ratio FROM frames GROUP BY video_id""",
)
def analysis_coverage(frames):
    return _rounded(series.analysis_coverage(frames, 64), "suspicious_ratio")


@query(
    "frames",
    """, m AS (SELECT video_id, warning AS message, count(*) AS times, min(frame_index) AS f FROM frames GROUP BY ALL)
SELECT video_id, message, times FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY times DESC, f) AS r FROM m) WHERE r <= 2""",
)
def top_messages(frames):
    return series.top_messages(frames)


@query("frames", "SELECT video_id, list(warning ORDER BY frame_index) AS notes FROM frames WHERE frame_index < 3 GROUP BY video_id")
def frame_notes(frames):
    return series.frame_notes(frames)


@query("frames", "SELECT video_id, frame_index FROM frames WHERE frame_index % 7 = 0")
def frame_selection(frames):
    return series.frame_selection(frames, 7).select("video_id", "frame_index")


@query("frames", "SELECT video_id, round(avg(ai_probability), 10) AS mean, round(stddev_pop(ai_probability), 10) AS std, min(ai_probability) AS minimum, round(quantile_cont(ai_probability, 0.1), 10) AS p10, max(ai_probability) AS maximum FROM frames GROUP BY video_id")
def frame_score_summary(frames):
    return _rounded(series.frame_score_summary(frames, "ai_probability"), "mean", "std", "p10")


@query("frames")
def temporal_windows(frames):
    return series.temporal_windows(frames)


@query(
    "frames",
    """, v AS (SELECT video_id, avg(truth_score) AS m, avg((truth_score < 50 OR ai_probability >= 0.65 OR manipulation_probability >= 0.65)::int::double) AS s, count(*) AS n FROM frames GROUP BY video_id)
SELECT video_id, least(100, greatest(0, round_even(m - CASE WHEN s >= 0.2 THEN least(14, 5 + s * 15) WHEN s > 0 THEN least(5, s * 20) ELSE 0 END - CASE WHEN n / 30.0 < 1.5 THEN 5 ELSE 0 END - 8, 0)))::int AS score FROM v""",
)
def video_context_score(frames):
    return series.video_context_score(frames, 320, 480)
