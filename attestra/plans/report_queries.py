"""Queries on reports, policies, registries, capped lists, and the batch twins of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import audit, forensics, models, reports, series
from attestra.plans.claims_queries import FORENSIC_DOUBLE
from attestra.plans.registry import query
from attestra.plans.series_queries import RUNS
from attestra.sources import policies, readers
from attestra.streaming import streams


def _codes(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in pairs) + "], lambda x: x IS NOT NULL)"


_WARNINGS = _codes(
    ("caption_likely", "caption_overlay"), ("s >= 0.62e0", "synthetic_artifacts"), ("m >= 0.58e0 AND NOT caption_likely", "editing_artifacts"), ("mean_residual_noise < 1.2e0", "low_noise"),
    ("spectral_spike_ratio > 7.5e0 AND NOT caption_likely", "periodic_spikes"), ("duplicate_patch_ratio > 0.08e0", "repeated_patches"),
)
_POSITIVES = _codes(
    ("caption_likely", "caption_explains_edges"), ("s <= 0.28e0", "no_synthetic_artifacts"), ("blockiness_ratio <= 1.35e0", "ordinary_blocks"), ("localized_hot_area_ratio <= 0.12e0", "no_hotspot"),
    ("NOT duplicate_patch_ratio > 0.08e0", "no_repeated_patches"),
)


@query(
    "image_stats",
    FORENSIC_DOUBLE
    + f"""SELECT media_id, {_WARNINGS} AS warnings, {_POSITIVES} AS positives, CASE WHEN mean_residual_noise < 1.2e0 THEN 'very_smooth' WHEN block_noise_cv > 1 OR edge_to_flat_noise_ratio > 5.5e0 THEN 'uneven' ELSE 'ordinary' END AS noise,
 CASE WHEN high_frequency_ratio < 0.06e0 THEN 'low_detail' WHEN spectral_spike_ratio > 7.5e0 THEN 'spikes' ELSE 'ordinary' END AS frequency, CASE WHEN blockiness_ratio > 1.45e0 THEN 'strong' WHEN blockiness_ratio < 0.7e0 THEN 'weak' ELSE 'ordinary' END AS blockiness,
 CASE WHEN localized_hot_area_ratio > 0.18e0 THEN 'elevated' WHEN mean_residual_noise < 1 THEN 'very_low' ELSE 'no_hotspot' END AS error_level, CASE WHEN duplicate_patch_ratio > 0.08e0 THEN 'repeated' ELSE 'ordinary' END AS patches FROM f""",
)
def forensic_messages(image_stats):
    said = reports.forensic_messages(forensics.synthetic_probability(), forensics.manipulation_probability()).alias("said")
    meant = reports.forensic_interpretations(F.col("mean_residual_noise")).alias("meant")
    return image_stats.select("media_id", said, meant).select("media_id", "said.*", "meant.*")


@query(
    "detectors",
    """, d AS (SELECT media_id, count(*) AS n, avg(synthetic_probability)::double * 100 AS mean, max(CASE WHEN pos = 2 THEN manipulation_probability END)::double * 100 AS second,
 max(CASE WHEN pos = 1 THEN name END) AS name, max(CASE WHEN pos = 1 THEN status END) AS status, max(CASE WHEN pos = 1 THEN synthetic_probability END)::double AS p FROM detectors GROUP BY media_id),
e AS (SELECT *, CASE WHEN media_id % 2 = 0 THEN 'video' ELSE 'image' END AS kind, sha256(media_id::varchar) AS h, coalesce(status = 'completed' AND name <> 'local_heuristic_synthetic_likelihood', false) AS learned FROM d),
s AS (SELECT *, greatest(0, least(100, coalesce(CASE WHEN kind = 'video' THEN second END, CASE WHEN n > 3 THEN mean END, CASE WHEN learned AND p IS NOT NULL THEN p * 100 END))) AS score FROM e)
SELECT media_id, round(CASE WHEN (kind = 'video' AND second IS NOT NULL) OR (n > 3 AND mean IS NOT NULL) OR (learned AND p IS NOT NULL) THEN score END, 9) AS ai_score, left(h, 12) || '…' || right(h, 8) AS short_hash,
 CASE WHEN n % 3 = 0 THEN 'risk-medium' WHEN NOT learned OR NOT ((kind = 'video' AND second IS NOT NULL) OR (n > 3 AND mean IS NOT NULL) OR (learned AND p IS NOT NULL)) THEN 'risk-low' WHEN score >= 70 THEN 'risk-high' WHEN score > 30 THEN 'risk-medium' ELSE 'risk-trust' END AS risk_class,
 CASE WHEN NOT learned THEN 'Trained detector unavailable' WHEN NOT ((kind = 'video' AND second IS NOT NULL) OR (n > 3 AND mean IS NOT NULL) OR (learned AND p IS NOT NULL)) THEN 'No AI verdict' WHEN score >= 90 THEN 'Likely AI-generated'
 WHEN score >= 70 THEN 'Inconclusive / uncertain' WHEN score > 30 THEN 'Mixed AI signals' WHEN score <= 15 THEN 'Likely camera-made' ELSE 'Lower AI signal' END AS headline,
 ['Dedicated detector AI-class score (not probability)', 'Own Extra Score', 'Video AI-generated likelihood'] AS labels FROM s""",
)
def display_report(detectors):
    first = lambda c: F.max(F.when(F.col("pos") == 1, F.col(c)))
    d = detectors.groupBy("media_id").agg(
        F.count("*").alias("n"), (F.avg(F.col("synthetic_probability").cast("double")) * 100).alias("mean"), (F.max(F.when(F.col("pos") == 2, F.col("manipulation_probability"))).cast("double") * 100).alias("second"),
        first("name").alias("name"), first("status").alias("status"), first("synthetic_probability").cast("double").alias("synthetic_probability"),
    )
    evidence = F.create_map(F.lit("video_ai_generation_score"), F.col("second"), F.lit("ai_generation_score"), F.when(F.col("n") > 3, F.col("mean")), F.lit("own_extra score"), F.lit(1.0))
    rows = d.select(
        "media_id", F.when(F.col("media_id") % 2 == 0, "video").otherwise("image").alias("content_type"), F.when(F.col("n") % 3 == 0, "inconclusive").alias("verdict"), evidence.alias("evidence"),
        F.array(F.struct("name", "status", "synthetic_probability")).alias("detectors"), F.sha2(F.col("media_id").cast("string"), 256).alias("sha256"),
    )
    return reports.display_projection(rows).select("media_id", F.round("ai_score", 9).alias("ai_score"), "short_hash", "risk_class", "headline", "labels")


_MATCHES = "['exact_hash_match', 'not_checked', 'possible_context_match', 'visually_similar_match', 'not_found', 'odd']"


@query(
    "image_stats",
    f""", r AS (SELECT *, CASE WHEN media_id % 4 = 0 THEN 'text post' WHEN media_id % 4 = 1 THEN 'video' ELSE 'image' END AS label, {_MATCHES}[(width + height) // 40 % 6 + 1] AS match FROM image_stats)
SELECT media_id, CASE WHEN blur < 40 THEN 'High-risk ' || label || ' signals found' WHEN blur < 60 THEN 'Several ' || label || ' signals need verification' WHEN blur < 80 THEN 'Mixed ' || label || ' evidence' ELSE 'Mostly reassuring ' || label || ' signals' END AS headline,
 CASE WHEN entropy > 8 THEN 'none' WHEN entropy / 8 >= 0.75e0 THEN 'strong' WHEN entropy / 8 >= 0.45e0 THEN 'uncertain' ELSE 'low' END AS detector,
 CASE WHEN label = 'text post' THEN NULL WHEN match IN ('not_checked', 'odd') THEN 'not_available' ELSE match END AS match_note,
 list_filter([CASE WHEN label <> 'text post' AND match IN ('not_checked', 'possible_context_match', 'visually_similar_match') THEN 'reverse_image_search' END, CASE WHEN caption_likely THEN 'add_search_key' END, 'open_cited_sources', 'find_earliest_uploader'], lambda x: x IS NOT NULL) AS next_steps FROM r""",
)
def score_feedback(image_stats):
    label = F.when(F.col("media_id") % 4 == 0, "text post").when(F.col("media_id") % 4 == 1, "video").otherwise("image")
    match = F.get(F.array(*[F.lit(x.strip(" '")) for x in _MATCHES[1:-1].split(",")]), (F.floor((F.col("width") + F.col("height")) / 40) % 6).cast("int"))
    web = F.when(F.col("caption_likely"), "not_configured")
    said = reports.score_feedback(label, F.col("blur"), F.when(F.col("entropy") <= 8, F.col("entropy") / 8), match, web)
    return image_stats.select("media_id", said.alias("s")).select("media_id", "s.*")


@query(
    "image_stats",
    """, v AS (SELECT media_id, CASE WHEN media_id % 9 <> 0 THEN entropy / 9 END AS p, media_id % 5 <> 0 AS learned, blur > 60 AS sustained, NOT caption_likely AS quiet FROM image_stats)
SELECT media_id, CASE WHEN NOT learned OR p IS NULL THEN 'No reliable AI verdict for this video' WHEN p >= 0.9e0 THEN 'This video may be AI-generated' WHEN p <= 0.15e0 THEN 'This video appears less likely to be AI-generated' ELSE 'We cannot tell with enough confidence' END AS headline,
 list_filter([CASE WHEN learned AND p >= 0.9e0 THEN 'strong_match' END, CASE WHEN learned AND p < 0.9e0 AND p >= 0.5e0 THEN 'partly_alike' END, CASE WHEN sustained THEN 'several_frames' END], lambda x: x IS NOT NULL) AS reasons_ai,
 list_filter([CASE WHEN learned AND p <= 0.15e0 THEN 'little_likeness' END, CASE WHEN learned AND p > 0.15e0 AND p < 0.5e0 THEN 'leans_away' END, CASE WHEN quiet THEN 'no_repeated_pattern' END], lambda x: x IS NOT NULL) AS reasons_not_ai FROM v""",
)
def video_feedback(image_stats):
    warnings = F.when(F.col("blur") > 60, F.array(F.lit("A Sustained share of frames"))).otherwise(F.array(F.lit("other")))
    positives = F.when(~F.col("caption_likely"), F.array(F.lit("Checks did not show strong synthetic-video signals."))).otherwise(F.array(F.lit("other")))
    said = reports.video_feedback(F.when(F.col("media_id") % 9 != 0, F.col("entropy") / 9), F.col("media_id") % 5 != 0, warnings, positives)
    return image_stats.select("media_id", said.alias("s")).select("media_id", "s.*")


@query(
    "documents",
    "SELECT source, rank, doc_id, n_chars, total, greatest(0, total - 8) AS beyond FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE rank <= 8",
)
def capped_lists(documents):
    return reports.capped(documents.select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 8)


@query(
    "manifest",
    """, g AS (SELECT sha256, list(split || '/' || path ORDER BY split || '/' || path)[1:20] AS paths FROM manifest GROUP BY sha256 HAVING count(DISTINCT split) > 1),
r AS (SELECT sha256, generate_subscripts(paths, 1) - 1 AS place, unnest(paths) AS p, len(list_distinct(list_transform(paths, lambda x: split_part(x, '/', 1)))) > 1 AS cross_split FROM g)
SELECT sha256, k.kind, 0 AS "group", place, lower(replace(p, '/', '\\')) AS path, split_part(p, '/', 1) AS split, cross_split FROM r CROSS JOIN (VALUES ('cross_split_exact_duplicates'), ('cross_split_perceptual_near_matches')) AS k(kind)""",
)
def audit_groups_explode(manifest):
    found = audit.duplicate_groups(manifest.select("sha256", "split", F.concat("split", F.lit("/"), "path").alias("path")), "sha256")
    group = F.array(F.struct("paths"))
    body = F.to_json(F.struct(group.alias("cross_split_exact_duplicates"), group.alias("cross_split_perceptual_near_matches"), F.lit("x").alias("other")))
    return readers.audit_group_rows(found.select("sha256", body.alias("body")))


@query(
    "supplier",
    """, m AS (SELECT s_suppkey, unnest([0, 1, 2]) AS place, s_nationkey, s_name FROM supplier)
SELECT s_suppkey, 'v' || s_nationkey AS registry_version, place, s_name || '/' || place AS id, CASE place WHEN 0 THEN 'generation' ELSE 'manipulation' END AS task, place = 0 AND s_nationkey % 2 = 0 AS enabled_by_default, CASE WHEN place = 0 THEN 'MIT' END AS license FROM m WHERE NOT (place = 2 AND s_nationkey % 3 = 0)""",
)
def registry_scan(supplier):
    name = lambda i: F.concat("s_name", F.lit(f"/{i}"))
    first = F.to_json(F.struct(name(0).alias("id"), F.lit("generation").alias("task"), F.lit("MIT").alias("license"), (F.col("s_nationkey") % 2 == 0).alias("enabled_by_default")))
    second = F.to_json(F.struct(name(1).alias("id"), F.lit("manipulation").alias("task")))
    third = F.to_json(F.struct(F.when(F.col("s_nationkey") % 3 != 0, name(2)).alias("id"), F.lit("manipulation").alias("task")))
    body = F.concat(F.lit('{"registry_version": "v'), F.col("s_nationkey").cast("string"), F.lit('", "models": ['), first, F.lit(", "), second, F.lit(", "), third, F.lit("]}"))
    return readers.registry_rows(supplier.select("s_suppkey", body.alias("body"))).select("s_suppkey", "registry_version", "place", "id", "task", "enabled_by_default", "license")


@query(
    "supplier",
    """, p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN ['base', 'n' || s_nationkey] ELSE ['base', 'n' || s_nationkey, 'n1', ' x', 'base'] END AS names FROM supplier),
u AS (SELECT s_suppkey, generate_subscripts(names, 1) AS i, trim(unnest(names)) AS n FROM p), d AS (SELECT s_suppkey, n, min(i) AS i FROM u GROUP BY s_suppkey, n)
SELECT s_suppkey, string_agg(n, '|' ORDER BY i) AS models FROM d GROUP BY s_suppkey""",
)
def configured_models(supplier):
    nation = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    setting = F.when(F.col("s_suppkey") % 4 == 0, " , ").otherwise(F.lit("n1,, x,base"))
    rows = supplier.select("s_suppkey", setting.alias("setting"), F.array(F.lit("base"), nation).alias("packaged"))
    return rows.select("s_suppkey", F.array_join(policies.configured_model_lists(rows, "setting", "packaged", keep_packaged=True), "|").alias("models"))


_OVERRIDE = """CASE WHEN n % 4 = 0 THEN '{broken' WHEN n % 4 = 1 THEN '[1, 2]' ELSE '{"generation": {"upper_threshold": ' || u || ', "extra": {"rows": ' || n || '}}, "stability": ' || CASE WHEN n % 4 = 2 THEN '"off"' ELSE '{"max_view_score_range": 0.25}' END || ', "quality": {"minimum_short_side": ' || (100 + n) || '}}' END"""
_DEFAULTS = '{"generation": {"lower_threshold": 0.15, "upper_threshold": 0.95, "enabled": true}, "manipulation": {"lower_threshold": 0.15, "upper_threshold": 0.95, "enabled": true}, "stability": {"max_view_score_range": 0.18, "max_window_score_range": 0.3}, "quality": {"minimum_short_side": 224, "minimum_video_frames": 8}}'


@query(
    "preds",
    f""", g AS (SELECT generator_or_editor || '/' || transformation AS key, count(*) AS n, (floor(max(generation_score) * 1000) / 1000)::varchar AS u FROM preds GROUP BY generator_or_editor, transformation),
m AS (SELECT key, CASE WHEN n % 4 < 2 THEN '{_DEFAULTS}'::json ELSE json_merge_patch('{_DEFAULTS}'::json, ({_OVERRIDE})::json) END AS p FROM g)
SELECT key, (p->>'$.generation.lower_threshold')::double AS generation_lower, (p->>'$.generation.upper_threshold')::double AS generation_upper, (p->>'$.generation.enabled')::boolean AS generation_enabled,
 (p->>'$.stability.max_view_score_range')::double AS max_view_range, (p->>'$.stability.max_window_score_range')::double AS max_window_range, (p->>'$.quality.minimum_short_side')::int AS minimum_short_side,
 (p->>'$.quality.minimum_video_frames')::int AS minimum_frames, (p->>'$.generation.extra.rows')::int AS extra_rows FROM m""",
)
def policy_deep_merge(preds):
    g = preds.groupBy(F.concat("generator_or_editor", F.lit("/"), "transformation").alias("key")).agg(F.count("*").alias("n"), (F.floor(F.max("generation_score") * 1000) / 1000).cast("string").alias("u"))
    out = policies.merged_policy_table(g.select("key", F.expr(_OVERRIDE).alias("override")), "override")
    extra = F.try_variant_get(F.parse_json("policy"), "$.generation.extra.rows", "int").alias("extra_rows")
    return out.select("key", "generation_lower", "generation_upper", "generation_enabled", "max_view_range", "max_window_range", "minimum_short_side", "minimum_frames", extra)


@query(
    "preds",
    """, c AS (SELECT generator_or_editor AS model, kind, avg(generation_score) AS threshold, avg((generation_score >= 0.5e0)::int) AS balanced_accuracy, max(generation_score) AS auc, avg(generation_score * generation_score) AS brier_score, min(generation_score) AS ece,
 avg(coalesce(manipulation_score, 0)) AS average_precision, max(manipulation_score) AS f1, min(manipulation_score) AS safe_recall FROM preds CROSS JOIN (VALUES ('temporal'), ('frame_head'), ('localizer')) AS k(kind) GROUP BY ALL)
SELECT model, kind, round(CASE kind WHEN 'temporal' THEN balanced_accuracy + 0.08 * auc - 0.05 * brier_score - 0.03 * ece WHEN 'frame_head' THEN balanced_accuracy + 0.08 * auc - 0.04 * brier_score ELSE 0.45 * average_precision + 0.2 * f1 + 0.35 * safe_recall END, 9) AS selection_score FROM c""",
)
def leaderboard(preds):
    g = F.col("generation_score")
    c = preds.groupBy(F.col("generator_or_editor").alias("model")).agg(
        F.avg(g).alias("threshold"), F.avg((g >= 0.5).cast("int")).alias("balanced_accuracy"), F.max(g).alias("auc"), F.avg(g * g).alias("brier_score"), F.min(g).alias("ece"),
        F.avg(F.coalesce("manipulation_score", F.lit(0.0))).alias("average_precision"), F.max("manipulation_score").alias("f1"), F.min("manipulation_score").alias("safe_recall"),
    )
    every = None
    for kind in ("temporal", "frame_head", "localizer"):
        one = c.withColumns({"kind": F.lit(kind), "selection_score": models.selection_score(kind)})
        every = one if every is None else every.unionByName(one)
    return models.leaderboard(every).select("model", "kind", F.round("selection_score", 9).alias("selection_score"))


@query("prints", """, f AS (SELECT DISTINCT fp FROM prints) SELECT a.fp AS fa, b.fp AS fb, bit_count(xor(a.fp, b.fp))::int AS distance FROM f a JOIN f b ON a.fp <= b.fp AND bit_count(xor(a.fp, b.fp)) <= 4""")
def hamming_near_prints(prints):
    return audit.hamming_near_prints(prints)


@query(
    "frames",
    RUNS.format(t=0.65)
    + """, s AS (SELECT *, abs(luma - lag(luma) OVER w) AS d FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame_index)), l AS (SELECT video_id, max(frame_index) FILTER (ai_probability < 0.65) AS below, max(frame_index) AS top FROM frames GROUP BY video_id)
SELECT video_id, count(*) AS frames, max(frame_index)::bigint AS last_index, any_value(top - coalesce(below, -1))::bigint AS high_run, any_value(run) AS longest_run, round(avg(ai_probability), 9) AS mean_probability, round(coalesce(sum(d), 0), 9) AS luma_total
FROM s JOIN l USING (video_id) JOIN runs USING (video_id) GROUP BY video_id""",
)
def frame_states(frames):
    return series.frame_states(frames).withColumns({c: F.round(c, 9) for c in ("mean_probability", "luma_total")})


@query(
    "frames",
    """, w AS (SELECT video_id, ai_probability, unnest(range(0, 4)) AS k, time_bucket(INTERVAL 15 MINUTE, ts::timestamp) AS b FROM frames WHERE ai_probability >= 0.65)
SELECT video_id, b - k * INTERVAL 15 MINUTE AS start, b - k * INTERVAL 15 MINUTE + INTERVAL 1 HOUR AS "end", count(*) AS n, max(ai_probability) AS peak FROM w GROUP BY ALL""",
)
def stream_suspicious_windows(frames):
    out = streams.stream_suspicious_windows(frames)
    return out.withColumns({"start": F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "end": F.to_timestamp_ntz(F.date_format("end", "yyyy-MM-dd HH:mm:ss"))})


@query(
    "frames",
    """, h AS (SELECT video_id, ts::timestamp AS ts FROM frames WHERE ai_probability >= 0.65), m AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL 30 MINUTE IS NOT FALSE AS fresh FROM h WINDOW w AS (PARTITION BY video_id ORDER BY ts)),
k AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY video_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT video_id, count(*) AS n, epoch(min(ts))::bigint AS first_second, epoch(max(ts))::bigint AS last_second FROM k GROUP BY video_id, s""",
)
def stream_sessions(frames):
    out = streams.stream_sessions(frames)
    nearest = lambda c: F.bround(c.cast("double")).cast("long")
    return out.select("video_id", "n", nearest(F.col("start")).alias("first_second"), nearest(F.col("end") - F.expr("INTERVAL 30 MINUTE")).alias("last_second"))
