"""Queries on masks, listings, bundles, detector lists and errors to look at."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import assembly, splits
from attestra.operators.splits import hash_bucket
from attestra.plans.registry import query

_LISTED = "('0x' || substr(sha256(path), 1, 2))::bigint % 3 > 0"


def _listed(manifest):
    return manifest.filter(F.conv(F.substring(F.sha2("path", 256), 1, 2), 16, 10).cast("long") % 3 > 0)


@query("manifest", f"SELECT path, class_label, CASE WHEN {_LISTED} THEN 'mask/' || path END AS mask, coalesce(class_label = 'ai_manipulated', false) AND NOT ({_LISTED}) AS mask_missing FROM manifest WHERE split = 'train'")
def mask_join(manifest):
    masks = _listed(manifest).select("path", F.concat(F.lit("mask/"), "path").alias("mask"))
    return assembly.mask_join(manifest, masks, "train", F.col("class_label") == "ai_manipulated").select("path", "class_label", "mask", "mask_missing")


@query("manifest", f"SELECT path, class_label FROM manifest WHERE split = 'train' AND class_label IN ('real_camera', 'ai_generated') AND {_LISTED}")
def eligible_rows(manifest):
    return assembly.eligible_rows(manifest, _listed(manifest), "train", ["real_camera", "ai_generated"]).select("path", "class_label")


@query(
    "manifest",
    """, p AS (SELECT path, row_number() OVER (ORDER BY substr(sha256(path), 1, 3), path) - 1 AS i FROM manifest WHERE class_label = 'real_camera'),
r AS (SELECT path, row_number() OVER (ORDER BY substr(sha256(path), 1, 3), path) - 1 AS i FROM manifest WHERE class_label = 'ai_generated')
SELECT p.path, r.path AS reference FROM p LEFT JOIN r ON r.i = p.i % (SELECT count(*) FROM r)""",
)
def modulo_pairing(manifest):
    side = lambda label: manifest.filter(F.col("class_label") == label).select("path")
    return splits.modulo_pairing(side("real_camera"), side("ai_generated"), "path")


@query("preds", "SELECT path, label AS expected, CASE WHEN generation_score >= 0.5 THEN 'ai_generated' ELSE 'real_camera' END AS predicted FROM preds WHERE label <> CASE WHEN generation_score >= 0.5 THEN 'ai_generated' ELSE 'real_camera' END ORDER BY path LIMIT 40")
def misclassified_top(preds):
    predicted = F.when(F.col("generation_score") >= 0.5, "ai_generated").otherwise("real_camera")
    return assembly.misclassified_top(preds, "label", predicted).select("path", F.col("label").alias("expected"), "predicted")


@query("manifest preds", "SELECT class_label AS label FROM manifest WHERE class_label IS NOT NULL INTERSECT SELECT label FROM preds")
def label_intersect(manifest, preds):
    return assembly.label_intersect(manifest.select(F.col("class_label").alias("label")), preds.select("label"))


@query("manifest", "SELECT split, path, class_label FROM manifest WHERE split IN ('train', 'tuning') AND license <> ' ' ORDER BY split, path")
def finalize_union(manifest):
    rows = manifest.withColumn("version", F.when(F.col("license") == " ", "v1").otherwise("v2"))
    bundles = [rows.filter(F.col("split") == s).select("split", "path", "class_label", "version") for s in ("train", "tuning")]
    return assembly.finalize_union(bundles, "v2").select("split", "path", "class_label")


@query(
    "detectors frames",
    "SELECT media_id::bigint AS media_id, name, status, round(synthetic_probability::double, 9) AS probability, NULL::bigint AS n_frames FROM detectors UNION ALL SELECT video_id, 'frame_summary', 'completed', round((0.7 * avg(ai_probability) + 0.3 * quantile_cont(ai_probability, 0.9))::double, 9), count(*) FROM frames GROUP BY video_id",
)
def detector_union(detectors, frames):
    summary = frames.groupBy(F.col("video_id").cast("long").alias("media_id")).agg(
        F.round(0.7 * F.avg("ai_probability") + 0.3 * F.percentile("ai_probability", 0.9), 9).alias("probability"), F.count("*").alias("n_frames")
    )
    summary = summary.withColumns({"name": F.lit("frame_summary"), "status": F.lit("completed")})
    rows = detectors.select(F.col("media_id").cast("long").alias("media_id"), "name", "status", F.round(F.col("synthetic_probability").cast("double"), 9).alias("probability"))
    return assembly.detector_union(rows, summary)


@query(
    "detectors",
    "SELECT media_id, round((sum(p * w) / sum(CASE WHEN p IS NOT NULL THEN w END))::double, 9) AS probability FROM (SELECT media_id, synthetic_probability::double AS p, CASE WHEN pos = 1 THEN 1.25::double WHEN name = 'packaged-detector' THEN 1.35::double ELSE 0.55::double END AS w FROM detectors WHERE pos = 1 OR (pos > 1 AND coalesce(task, 'generation') = 'generation')) GROUP BY media_id",
)
def video_fusion(detectors):
    summary = detectors.filter("pos = 1").select("media_id", F.col("synthetic_probability").cast("double").alias("summary"))
    others = detectors.filter("pos > 1").withColumn("synthetic_probability", F.col("synthetic_probability").cast("double"))
    return assembly.video_fusion(summary, others, "packaged-detector").withColumn("probability", F.round("probability", 9))


@query(
    "detectors",
    """, e AS (SELECT media_id, count(*) FILTER (status = 'completed' AND name <> 'local_heuristic_synthetic_likelihood') AS m, bool_or(status = 'completed') AS c,
 CASE media_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'no_manifest' ELSE 'error' END AS p, CASE media_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'no_results' WHEN 2 THEN 'error' END AS w FROM detectors GROUP BY media_id)
SELECT media_id, round(greatest(0.2, least(0.9, 0.45 + CASE WHEN m > 0 THEN 0.18 WHEN c THEN 0.08 ELSE 0 END + CASE WHEN p IN ('verified', 'no_manifest') THEN 0.10 ELSE 0 END + CASE WHEN w IN ('completed', 'no_results') THEN 0.15 ELSE 0 END))::double, 2) AS confidence,
 CASE WHEN w IN ('completed', 'no_results', 'error') THEN 'enhanced_free_hybrid' ELSE 'enhanced_free_local' END AS mode FROM e""",
)
def analysis_confidence(detectors):
    done = F.col("status") == "completed"
    rows = detectors.groupBy("media_id").agg(F.count_if(done & (F.col("name") != "local_heuristic_synthetic_likelihood")).alias("m"), F.bool_or(done).alias("c"))
    p = F.element_at(F.array(*[F.lit(x) for x in ("verified", "no_manifest", "error")]), (F.col("media_id") % 3 + 1).cast("int"))
    w = F.element_at(F.array(F.lit("completed"), F.lit("no_results"), F.lit("error"), F.lit(None).cast("string")), (F.col("media_id") % 4 + 1).cast("int"))
    return rows.select("media_id", assembly.analysis_confidence(F.col("m"), F.col("c"), p, w).alias("confidence"), assembly.analysis_mode(w).alias("mode"))


@query(
    "manifest",
    """, b AS (SELECT * FROM manifest WHERE class_label IS NOT NULL AND license <> ' '),
l AS (SELECT path FROM b WHERE ('0x' || substr(sha256(path), 1, 8))::bigint % 10 > 1), g AS (SELECT b.* FROM b JOIN l USING (path) WHERE split <> 'tuning')
SELECT 'record' AS kind, split, path || s AS path, NULL AS mask_path FROM (SELECT *, unnest(['#a', '#b']) AS s FROM g) UNION ALL SELECT 'localization', split, path, path || '.png' FROM g""",
)
def finalized_bundles(manifest):
    rows = manifest.filter("class_label IS NOT NULL")
    record = lambda s: F.struct("split", F.concat("path", F.lit(s)).alias("path"))
    version = F.when(F.col("license") == " ", "v1").otherwise("v2").alias("version")
    masks = F.array(F.struct("split", "path", F.concat("path", F.lit(".png")).alias("mask_path")))
    bundles = rows.select(F.col("path").alias("parent"), version, F.array(record("#a"), record("#b")).alias("records"), F.when(F.col("split") != "tuning", masks).alias("localization"))
    stored = rows.filter(hash_bucket(F.col("path"), 10) > 1).select(F.explode(F.array("path", F.concat("path", F.lit(".png")))).alias("path"))
    records, localization = assembly.finalized(bundles, stored, "v2")
    return records.select(F.lit("record").alias("kind"), "split", "path", F.lit(None).cast("string").alias("mask_path")).unionByName(localization.select(F.lit("localization").alias("kind"), "split", "path", "mask_path"))


_FRAME_ROBUST = "greatest(0, least(1, 0.55 * avg({v}) + 0.30 * quantile_cont({v}, 0.9) + 0.15 * avg(({v} >= 0.65)::int::double)))"


@query(
    "frames",
    f""", g AS (SELECT video_id AS media_id, CASE WHEN count(pixel_probability) > 0 THEN {_FRAME_ROBUST.format(v="pixel_probability")} END AS g, {_FRAME_ROBUST.format(v="manipulation_probability")} AS m, count(pixel_probability) AS ng, count(manipulation_probability) AS nm FROM frames GROUP BY video_id)
SELECT media_id, 'all_frame_ai_detector_summary' AS name, CASE WHEN g IS NULL THEN 'unavailable' ELSE 'completed' END AS status, 'generation' AS task, round(g, 9) AS synthetic_probability, NULL::double AS manipulation_probability, ng AS n FROM g
UNION ALL SELECT media_id, 'all_frame_manipulation_screen_summary', 'completed', 'supporting', NULL, round(m, 9), nm FROM g""",
)
def frame_summaries(frames):
    out = assembly.frame_summaries(frames.withColumn("ai_probability", F.col("pixel_probability")))
    return out.select("media_id", "name", "status", "task", F.round("synthetic_probability", 9).alias("synthetic_probability"), F.round("manipulation_probability", 9).alias("manipulation_probability"), "n")


@query(
    "detectors",
    """, v AS (SELECT media_id, pos, trim(coalesce(CASE WHEN pos % 3 <> 0 THEN name || '-v' || media_id % 2 END, name)) AS v FROM detectors WHERE status = 'completed' AND coalesce(task, 'generation') IN ('generation', 'manipulation')),
f AS (SELECT media_id, v, min(pos) AS pos FROM v GROUP BY media_id, v) SELECT media_id, list(v ORDER BY pos) AS model_versions FROM f GROUP BY media_id""",
)
def model_versions(detectors):
    version = F.when(F.col("pos") % 3 != 0, F.concat("name", F.lit("-v"), F.col("media_id") % 2)).otherwise("")
    return assembly.model_versions(detectors.withColumn("model_version", version))
