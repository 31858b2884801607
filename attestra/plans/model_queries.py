"""Queries on models: importance by permutation, bundles over features, features of cached frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from attestra.operators import importance, models, series
from attestra.plans.registry import query
from attestra.plans.series_queries import FEATURE_SQL, FEATURES

_LINE = "0.05e0 * {entropy} + 0.003e0 * {blur} - 0.05e0 * {blockiness_ratio}"
_PARTS = ("entropy", "blur", "blockiness_ratio")


def _line(changed: str | None = None) -> str:
    return _LINE.format(**{c: f"o.{c}" if c == changed else f"b.{c}" for c in _PARTS})


@query(
    "image_stats",
    f""", b AS (SELECT media_id, entropy, blur, blockiness_ratio, entropy / 12e0 + blur / 200e0 - near_white_pixel_ratio > 0.62e0 AS y FROM image_stats),
k AS (SELECT media_id, repeat, row_number() OVER (PARTITION BY repeat ORDER BY sha256('7:' || repeat || ':' || media_id)) AS r FROM b CROSS JOIN range(0, 9) AS t(repeat)),
p AS (SELECT x.media_id, z.repeat, z.media_id AS other FROM k x JOIN k z ON x.repeat = 0 AND z.repeat > 0 AND x.r = z.r),
v AS (SELECT f.feature, p.repeat, b.y, CASE f.feature WHEN 'entropy' THEN {_line("entropy")} WHEN 'blur' THEN {_line("blur")} ELSE {_line("blockiness_ratio")} END AS s
      FROM p JOIN b USING (media_id) JOIN b o ON o.media_id = p.other CROSS JOIN (VALUES ('entropy'), ('blur'), ('blockiness_ratio')) AS f(feature)),
w AS (SELECT feature, repeat, y, s FROM v UNION ALL SELECT 'none', 0, y, {_line()} FROM b),
m AS (SELECT feature, repeat, (count(*) FILTER (s >= 0.5 AND y) / greatest(1, count(*) FILTER (y)) + count(*) FILTER (s < 0.5 AND NOT y) / greatest(1, count(*) FILTER (NOT y))) / 2 AS a FROM w GROUP BY feature, repeat)
SELECT m.feature, round(avg(n.a - m.a), 6) AS importance, round(stddev_pop(n.a - m.a), 6) AS standard_deviation FROM m JOIN m n ON n.feature = 'none' AND m.feature <> 'none' GROUP BY m.feature""",
)
def permutation_importance(image_stats):
    y = F.expr("entropy / 12e0 + blur / 200e0 - near_white_pixel_ratio > 0.62e0").alias("y")
    rows = image_stats.select("media_id", *_PARTS, y)
    out = importance.permutation_importance(rows, "media_id", list(_PARTS), lambda d: d.withColumn("s", F.expr(_LINE.format(**{c: c for c in _PARTS}))))
    return out.withColumns({c: F.round(c, 6) for c in ("importance", "standard_deviation")})


#: A logistic bundle over a few video features; one name that no video has counts as 0.
_NAMES = ("frame_ai_probability_mean", "luma_delta_p95", "frame_ai_sustained_ratio", "not_measured")
_WEIGHTS, _BIAS = (6.0, -2.0, 1.5, 9.0), -2.5


def _predict(x: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-(x @ np.array(_WEIGHTS) + _BIAS)))
    return np.column_stack([p, 1 - p])


@query(
    "frames",
    FEATURE_SQL
    + """, s AS (SELECT video_id, 1 / (1 + exp(-(6.0 * frame_ai_probability_mean - 2.0 * luma_delta_p95 + 1.5 * frame_ai_sustained_ratio - 2.5))) AS p FROM f)
SELECT video_id, 'completed' AS status, CASE WHEN p >= 0.5 THEN 'likely_generated' ELSE 'lower_signal' END AS label, round(p, 9) AS score, 4 AS feature_count FROM s""",
)
def feature_model(frames):
    f = series.video_features(frames)
    maps = f.select("video_id", F.create_map(*[x for n in _NAMES[:3] for x in (F.lit(n), F.col(n))]).alias("features"))
    out = models.feature_model(maps, models.FeatureBundle(_NAMES, _predict, classes=("AI_Generated", "real")), "video_id")
    return out.select("video_id", "status", "label", F.round("score", 9).alias("score"), "feature_count")


_HEAD = ([[((i * 5 + 2) % 9 - 4) / 8 for i in range(64)], [((i * 7 + 3) % 11 - 5) / 8 for i in range(64)]], [0.1, -0.2])


def _dot(k: int) -> str:
    step, add, mod, mid = ((5, 2, 9, 4), (7, 3, 11, 5))[k]
    return f"(list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::double * (((i * {step} + {add}) % {mod} - {mid}) / 8.0::double))) + ({_HEAD[1][k]}))"


@query(
    "embeddings",
    f""", frames AS (SELECT concat('train/', CASE WHEN vec_id // 12 % 2 = 0 THEN 'ai_generated' ELSE 'real_camera' END, '/clip_', vec_id // 24) AS video_id, (vec_id % 12)::int AS frame_index,
 1 / (1 + exp({_dot(0)} - {_dot(1)})) AS ai_probability, abs(embedding[1]::double) AS luma, 1 + abs(embedding[2]::double) AS noise, abs(embedding[3]::double) / 10 AS edge_density, abs(embedding[4]::double) AS hist_correlation,
 50.0::double AS truth_score, 0.5::double AS pixel_probability, abs(embedding[5]::double) AS flow_warp_error, abs(embedding[6]::double) * 3 AS flow_inconsistency FROM embeddings)
"""
    + FEATURE_SQL
    + f"SELECT video_id, split_part(video_id, '/', 2) AS label, frames, {', '.join(f'round({c}, 9) AS {c}' for c in FEATURES)} FROM f",
)
def cached_frame_features(embeddings):
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    path = F.concat(
        F.lit("train/"), F.when(F.floor(F.col("vec_id") / 12) % 2 == 0, "ai_generated").otherwise("real_camera"), F.lit("/deep/clip_"), F.floor(F.col("vec_id") / 24), F.lit("_frame_"), F.col("vec_id") % 12, F.lit(".jpg")
    )
    frames = embeddings.select(
        path.alias("path"), "embedding", e(0).alias("luma"), (1 + e(1)).alias("noise"), (e(2) / 10).alias("edge_density"), e(3).alias("hist_correlation"),
        e(4).alias("flow_warp_error"), (e(5) * 3).alias("flow_inconsistency"),
    )
    out = models.features_from_cached_frames(frames, *_HEAD)
    return out.select("video_id", "label", "frames", *[F.round(F.element_at("features", F.lit(c)), 9).alias(c) for c in FEATURES])
