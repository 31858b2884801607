"""Queries on detectors and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions import scores
from attestra.operators import decision, fusion
from attestra.plans.registry import query

_H = "'local_heuristic_synthetic_likelihood'"
FUSED = f""", w AS (SELECT *, coalesce(task, 'generation') AS t, CASE WHEN name LIKE '%:tiled_pixel_scan' THEN 0.75 WHEN name LIKE 'community-forensics::%' THEN 1.25 WHEN name LIKE '%packaged-detector%' THEN 0.75 ELSE 1.0 END::double AS wt FROM detectors),
gf AS (SELECT media_id, coalesce(arg_max(synthetic_probability, pos) FILTER (name = 'fusion' AND status = 'completed' AND synthetic_probability IS NOT NULL),
 sum(synthetic_probability * wt) FILTER (t = 'generation' AND name NOT IN ('fusion', {_H}) AND status = 'completed' AND synthetic_probability IS NOT NULL) / sum(wt) FILTER (t = 'generation' AND name NOT IN ('fusion', {_H}) AND status = 'completed' AND synthetic_probability IS NOT NULL),
 avg(synthetic_probability) FILTER (t = 'generation' AND name = {_H})) AS generation_score,
 coalesce(max(manipulation_probability) FILTER (status = 'completed' AND name <> {_H} AND t = 'manipulation'), avg(manipulation_probability) FILTER (status = 'completed' AND name <> {_H})) AS manipulation_score,
 count(synthetic_probability) FILTER (status = 'completed' AND name <> {_H} AND t = 'generation') AS ng, max(synthetic_probability) FILTER (status = 'completed' AND name <> {_H} AND t = 'generation') - min(synthetic_probability) FILTER (status = 'completed' AND name <> {_H} AND t = 'generation') AS rg,
 count(manipulation_probability) FILTER (status = 'completed' AND name <> {_H}) AS ns, count(manipulation_probability) FILTER (status = 'completed' AND name <> {_H} AND t = 'manipulation') AS nd,
 bool_or(task = 'manipulation' AND status = 'completed' AND has_region) AS localized FROM w GROUP BY media_id)
"""


@query("detectors", FUSED + "SELECT media_id, generation_score FROM gf")
def generation_fusion(detectors):
    return fusion.generation_fusion(detectors)


@query("detectors", FUSED + "SELECT media_id, manipulation_score FROM gf")
def manipulation_fusion(detectors):
    return fusion.manipulation_fusion(detectors)


@query(
    "detectors",
    FUSED
    + f""", s AS (SELECT media_id, max(synthetic_probability) FILTER (status = 'completed') AS max_probability, avg(manipulation_probability) FILTER (status = 'completed' AND name <> {_H}) AS mean_manipulation,
 count(*) FILTER (status = 'completed' AND t = 'generation' AND name <> {_H}) AS completed_models FROM w GROUP BY media_id)
SELECT media_id, max_probability, mean_manipulation, completed_models, CASE WHEN ng >= 2 THEN rg END AS generation_range FROM s JOIN gf USING (media_id)""",
)
def detector_summary(detectors):
    return fusion.detector_summary(detectors)


_ROBUST = "greatest(0, least(1, 0.55 * avg({v}) + 0.30 * quantile_cont({v}, 0.9) + 0.15 * avg(({v} >= 0.65)::int::double)))"


@query(
    "frames",
    f"""SELECT video_id, round(generation, 10) AS generation, round(manipulation, 10) AS manipulation, round(rollup, 10) AS rollup FROM (SELECT video_id, {_ROBUST.format(v="ai_probability")} AS generation, greatest(0, least(1, 0.15 * avg(manipulation_probability) + 0.20 * quantile_cont(manipulation_probability, 0.9) + 0.25 * quantile_cont(manipulation_probability, 0.95)
 + 0.30 * max(manipulation_probability) + 0.10 * avg((manipulation_probability >= 0.65)::int::double))) AS manipulation, 0.7 * avg(ai_probability) + 0.3 * quantile_cont(ai_probability, 0.9) AS rollup FROM frames GROUP BY video_id)""",
)
def robust_score(frames):
    a = fusion.robust_score(frames, "video_id", "ai_probability").withColumnRenamed("score", "generation")
    b = fusion.robust_score(frames, "video_id", "manipulation_probability", "manipulation").withColumnRenamed("score", "manipulation")
    out = a.join(b, "video_id").join(fusion.video_score_rollup(frames, "video_id", "ai_probability").withColumnRenamed("score", "rollup"), "video_id")
    return out.select("video_id", *[F.round(c, 10).alias(c) for c in ("generation", "manipulation", "rollup")])


@query(
    "detectors",
    """, p AS (SELECT media_id, arg_max(least(1, greatest(0, synthetic_probability)), pos) FILTER (name = 'community-forensics::base' AND status = 'completed' AND synthetic_probability IS NOT NULL) AS a,
 arg_max(least(1, greatest(0, synthetic_probability)), pos) FILTER (name = 'packaged-detector' AND status = 'completed' AND synthetic_probability IS NOT NULL) AS b FROM detectors GROUP BY media_id),
l AS (SELECT media_id, least(1 - 1e-6, greatest(1e-6, a)) AS a, least(1 - 1e-6, greatest(1e-6, b)) AS b FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT p.media_id, CASE WHEN p.a IS NOT NULL AND p.b IS NOT NULL THEN 1 / (1 + exp(-(-0.2 + 0.8 * ln(l.a / (1 - l.a)) + 0.4 * ln(l.b / (1 - l.b))))) END AS fused FROM p LEFT JOIN l USING (media_id)""",
)
def logit_fusion(detectors):
    return fusion.logit_fusion(detectors, "community-forensics::base", "packaged-detector", -0.2, (0.8, 0.4))


@query(
    "image_stats",
    """SELECT media_id, greatest(0, least(100, (coalesce(CASE WHEN media_id % 5 <> 0 THEN entropy * 10 END, 50) * 0.5 + blur * 0.3 + 80 * 0.2))) AS score FROM image_stats""",
)
def weighted_score(image_stats):
    v = F.array(F.when(F.col("media_id") % 5 != 0, F.col("entropy") * 10), F.col("blur"), F.lit(80.0))
    return image_stats.select("media_id", fusion.weighted_score(v, F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2))).alias("score"))


@query(
    "detectors",
    """, v AS (SELECT media_id, CASE WHEN pos = 1 THEN 'original' ELSE 'view' END AS view, synthetic_probability AS s FROM detectors)
SELECT media_id, max(s) FILTER (view = 'original') AS original, max(s) - min(s) AS view_range, max(s) - min(s) > 0.18 AS force_inconclusive, count(s) AS n FROM v GROUP BY media_id""",
)
def view_stability(detectors):
    views = detectors.select("media_id", F.when(F.col("pos") == 1, "original").otherwise("view").alias("view"), F.col("synthetic_probability").alias("score"))
    return fusion.view_stability(views, 0.18)


@query(
    "frames",
    """SELECT video_id AS image, min(ai_probability) AS minimum, avg(ai_probability) AS mean, median(ai_probability) AS median, count(*) FILTER (ok) AS passed, bool_and(ok) AS all_passed
FROM (SELECT *, CASE WHEN video_id % 2 = 0 THEN ai_probability >= 0.2 ELSE ai_probability <= 0.9 END AS ok FROM frames) GROUP BY video_id""",
)
def robustness_report(frames):
    v = frames.select(F.col("video_id").alias("image"), (F.col("video_id") % 2 == 0).alias("expected_ai"), F.col("ai_probability").alias("score"))
    return fusion.robustness_report(v, 0.9, 0.2)


@query(
    "frames",
    """SELECT video_id AS media_id, frame_index AS tile, s AS score, rank::int AS rank, tiles FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY s DESC, frame_index) AS rank, count(*) OVER (PARTITION BY video_id) AS tiles FROM (SELECT video_id, frame_index, manipulation_probability AS s FROM frames))
WHERE rank <= 5 AND s >= 0.65 AND tiles > 1""",
)
def top_tiles(frames):
    return fusion.top_tiles(frames.select(F.col("video_id").alias("media_id"), F.col("frame_index").alias("tile"), F.col("manipulation_probability").alias("score")))


@query(
    "frames",
    """, t AS (SELECT video_id AS media_id, frame_index AS tile, CASE WHEN event_id % 5 > 0 THEN manipulation_probability END AS s FROM frames),
a AS (SELECT media_id, count(s) AS tiles, avg(s) AS mean, quantile_cont(s, 0.9) AS p90, quantile_cont(s, 0.95) AS p95, max(s) AS maximum, avg((s >= 0.65)::int::double) AS suspicious_ratio FROM t GROUP BY media_id),
b AS (SELECT *, greatest(0, least(1, 0.15 * mean + 0.20 * p90 + 0.25 * p95 + 0.30 * maximum + 0.10 * suspicious_ratio)) AS v FROM a),
h AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY s DESC NULLS LAST, tile) AS r, count(*) OVER (PARTITION BY media_id) AS k FROM t), l AS (SELECT media_id, list(tile ORDER BY r) AS top FROM h WHERE r <= 5 AND s >= 0.65 AND k > 1 GROUP BY media_id)
SELECT media_id, CASE WHEN tiles > 0 THEN 'completed' ELSE 'unsupported_labels' END AS status, CASE WHEN tiles = 0 THEN NULL WHEN v >= 0.65 THEN 'tiled_regions_likely_manipulated' WHEN v >= 0.35 THEN 'tiled_regions_uncertain' ELSE 'tiled_regions_lower_signal' END AS label,
 CASE WHEN tiles > 0 THEN round(v, 9) END AS score, tiles, round(mean, 9) AS mean, round(p90, 9) AS p90, round(p95, 9) AS p95, maximum, round(suspicious_ratio, 9) AS suspicious_ratio, coalesce(top, []) AS top FROM b LEFT JOIN l USING (media_id)""",
)
def tile_rollup(frames):
    score = F.when(F.col("event_id") % 5 > 0, F.col("manipulation_probability"))
    out = fusion.tile_rollup(frames.select(F.col("video_id").alias("media_id"), F.col("frame_index").alias("tile"), score.alias("score")), "manipulation")
    return out.withColumns({c: F.round(c, 9) for c in ("score", "mean", "p90", "p95", "suspicious_ratio")})


CONTEXT = """SELECT p_partkey AS media_id, CASE WHEN p_partkey % 4 = 0 THEN 'video' ELSE 'image' END AS media_type, CASE WHEN p_partkey % 9 <> 0 THEN 100 + p_size * 40 END AS width, 700 AS height,
 CASE WHEN p_partkey % 12 <> 0 THEN cast(p_partkey % 30 AS int) END AS frames, cast(p_partkey % 40 AS double) / 100e0 AS instability, CASE WHEN p_partkey % 15 = 0 THEN ' SomeTool ' END AS ai_marker, p_partkey % 7 = 0 AS camera_marker, p_partkey % 11 = 0 AS provenance_verified FROM """


def context(part):
    return part.sparkSession.sql(CONTEXT + "{part}", part=part)


EVIDENCE = FUSED + f""", ctx AS ({CONTEXT} part), e AS (SELECT ctx.*, generation_score, manipulation_score, coalesce(ng, 0) > 0 AS ga, CASE WHEN ng >= 2 THEN rg END AS dis, coalesce(ns, 0) > 0 AS sa, coalesce(nd, 0) > 0 AS da, coalesce(localized, false) AS loc, policy.*
 FROM ctx LEFT JOIN gf USING (media_id), policy),
v AS (SELECT *, list_filter([CASE WHEN dis > 0.35 THEN 'disagreement' END, CASE WHEN instability > CASE WHEN media_type = 'video' THEN max_window_range ELSE max_view_range END THEN 'instability' END,
 CASE WHEN generation_score >= generation_upper AND (camera_marker OR provenance_verified) THEN 'provenance' END], lambda x: x IS NOT NULL) AS conflicts,
 CASE WHEN media_type = 'video' THEN coalesce(frames, 0) >= minimum_frames WHEN width IS NOT NULL THEN least(width, height) >= minimum_short_side ELSE true END AS q FROM e),
r AS (SELECT *, CASE WHEN len(conflicts) > 0 THEN 'conflict' WHEN trim(coalesce(ai_marker, '')) <> '' AND (NOT ga OR generation_score IS NULL OR generation_score < generation_upper) THEN 'marker_without_score' WHEN NOT q THEN 'quality'
 WHEN NOT ga OR generation_score IS NULL THEN 'no_generator' WHEN generation_score >= generation_upper THEN 'generated' WHEN manipulation_score >= manipulation_upper THEN CASE WHEN NOT da THEN 'no_specialist' WHEN NOT loc THEN 'not_localized' ELSE 'manipulated' END
 WHEN generation_score <= generation_lower AND (NOT sa OR manipulation_score IS NULL) THEN 'no_manipulation_check' WHEN generation_score <= generation_lower AND manipulation_score <= manipulation_lower THEN 'authentic' ELSE 'between' END AS reason FROM v)
"""


@query(
    "detectors policy part",
    EVIDENCE
    + """SELECT media_id, generation_score, manipulation_score, conflicts, reason, CASE reason WHEN 'generated' THEN 'likely_ai_generated' WHEN 'manipulated' THEN 'likely_ai_manipulated' WHEN 'authentic' THEN 'likely_authentic' ELSE 'inconclusive' END AS verdict,
 CASE WHEN reason IN ('generated', 'manipulated') THEN 'high' WHEN reason IN ('conflict', 'marker_without_score', 'no_specialist', 'not_localized', 'authentic') THEN 'moderate' ELSE 'low' END AS confidence FROM r""",
)
def media_verdict(detectors, policy, part):
    return decision.media_verdict(detectors, context(part), policy)


@query("detectors policy part", EVIDENCE + "SELECT media_id, conflicts FROM r WHERE len(conflicts) > 0")
def verdict_conflicts(detectors, policy, part):
    return decision.media_verdict(detectors, context(part), policy).filter(F.size("conflicts") > 0).select("media_id", "conflicts")


@query("policy part", f", ctx AS ({CONTEXT} part) SELECT media_id, CASE WHEN media_type = 'video' THEN coalesce(frames, 0) >= minimum_frames WHEN width IS NOT NULL THEN least(width, height) >= minimum_short_side ELSE true END AS ok FROM ctx, policy")
def quality_gate(policy, part):
    c = context(part).crossJoin(F.broadcast(policy))
    ok = decision.quality_ok(*[F.col(x) for x in ("media_type", "width", "height", "frames", "minimum_short_side", "minimum_frames")])
    return c.select("media_id", ok.alias("ok"))


def _signal(kind: str) -> str:
    s, u, low = f"{kind}_score", f"{kind}_upper", f"{kind}_lower"
    return f"SELECT doc_id AS media_id, '{kind}' AS source, CASE WHEN {s} IS NULL THEN 'unavailable' ELSE 'completed' END AS status, CASE WHEN {s} IS NULL THEN 'unknown' WHEN {s} >= {u} THEN 'supports_{kind}' WHEN {s} <= {low} THEN 'supports_authentic' ELSE 'neutral' END AS signal, round_even(2 * abs({s} - 0.5), 3) AS confidence FROM preds, policy"


@query("preds policy", f"{_signal('generation')} UNION ALL {_signal('manipulation')}")
def evidence_signals(preds, policy):
    return decision.evidence_signals(preds.select(F.col("doc_id").alias("media_id"), "generation_score", "manipulation_score"), policy)


@query(
    "detectors image_stats",
    "SELECT media_id, pos, name || ':tiled_pixel_scan' AS name, status, synthetic_probability, true AS reused FROM detectors WHERE coalesce(task, 'generation') = 'generation' AND name NOT LIKE '%:tiled_pixel_scan' AND name NOT IN ('local_heuristic_synthetic_likelihood', 'fusion') AND media_id IN (SELECT media_id FROM image_stats WHERE width <= 512 AND height <= 512)",
)
def single_tile_reuse(detectors, image_stats):
    return decision.single_tile_reuse(detectors, image_stats)


@query("detectors", "SELECT status, count(*) AS n, count(*) FILTER (synthetic_probability >= 0.7) AS over_070 FROM detectors GROUP BY status")
def status_tally(detectors):
    return detectors.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("synthetic_probability") >= 0.7).alias("over_070"))


@query(
    "preds",
    """SELECT doc_id, CASE WHEN generation_score >= 0.65 THEN 'high' WHEN generation_score <= 0.30 THEN 'low' ELSE 'medium' END AS label, round_even(2 * abs(generation_score - 0.5), 3) AS confidence,
 CASE WHEN generation_score >= 0.95 THEN 'likely_ai' WHEN generation_score <= 0.15 THEN 'likely_authentic' ELSE 'inconclusive' END AS verdict, ln(least(1 - 1e-6, greatest(1e-6, generation_score)) / (1 - least(1 - 1e-6, greatest(1e-6, generation_score)))) AS logit,
 least(100, greatest(0, round_even(generation_score * 110 - 3, 0)))::int AS whole FROM preds""",
)
def probability_band(preds):
    s = "generation_score"
    return preds.select(
        "doc_id", scores.band(s, 0.65, 0.30, ("high", "medium", "low")).alias("label"), scores.score_confidence(s).alias("confidence"), scores.three_way(s, 0.15, 0.95).alias("verdict"),
        scores.logit(s).alias("logit"), scores.clamp_score(F.col(s) * 110 - 3).alias("whole"),
    )


@query(
    "detectors policy part",
    EVIDENCE
    + """SELECT media_id, CASE reason WHEN 'generated' THEN 'This ' || media_type || ' is likely AI-generated' WHEN 'manipulated' THEN 'This ' || media_type || ' is likely AI-edited or manipulated' WHEN 'authentic' THEN 'This ' || media_type || ' is likely authentic' ELSE 'We cannot tell with enough confidence' END AS headline,
 conflicts[1:8] AS notes FROM r""",
)
def media_feedback(detectors, policy, part):
    c = context(part)
    v = decision.media_verdict(detectors, c, policy).join(c.select("media_id", "media_type"), "media_id")
    none = F.array().cast("array<string>")
    f = decision.media_feedback(F.col("verdict"), F.col("media_type"), none, none, none, F.concat("conflicts", F.array(F.lit(" "))))
    return v.select("media_id", f.alias("f")).select("media_id", "f.headline", "f.notes")


@query(
    "manifest policy",
    "SELECT g AND generation_enabled AS decisive_generation, false AS decisive_manipulation, g AS decisive_authentic, true AS screening, true AS inconclusive_fallback FROM (SELECT count(*) FILTER (path = 'doc/1') > 0 AND count(*) FILTER (path = 'doc/2') > 0 AS g FROM manifest), policy",
)
def capability_report(manifest, policy):
    rows = [("a", "generation", "doc/1"), ("b", "generation", None), ("c", "manipulation", "doc/none"), ("d", "screen", "doc/3"), ("e", "calibration", "doc/2")]
    registry = manifest.sparkSession.createDataFrame(rows, "id string, task string, path string")
    return decision.capability_report(registry, manifest, policy)
