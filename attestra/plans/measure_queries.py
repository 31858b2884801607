"""Queries on measures, boxes, class outputs, models and readers' rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions.scores import is_positive
from attestra.operators import measures, models, splits
from attestra.plans.registry import query
from attestra.sources import readers


@query("documents", "SELECT source AS key, -sum(p * log2(p)) AS entropy FROM (SELECT source, count(*) / sum(count(*)) OVER (PARTITION BY source) AS p FROM documents GROUP BY source, lang) GROUP BY source")
def group_entropy(documents):
    return measures.group_entropy(documents, "source", "lang").withColumnRenamed("source", "key").withColumn("entropy", F.col("entropy") + 0.0)


@query("image_stats", "SELECT round(corr(entropy, blur), 9) AS corr_entropy_blur, round(corr(entropy, blockiness_ratio), 9) AS corr_entropy_blockiness_ratio, round(corr(blur, blockiness_ratio), 9) AS corr_blur_blockiness_ratio FROM image_stats")
def pair_correlation(image_stats):
    out = measures.pair_correlations(image_stats, ["entropy", "blur", "blockiness_ratio"])
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("frames", "SELECT avg((luma <= 0.05)::int::double) AS low_share, avg((luma >= 0.4)::int::double) AS high_share FROM frames")
def extreme_share(frames):
    return measures.extreme_share(frames, "luma", 0.05, 0.4)


_LABELS = "['AI-generated', 'real_photo', 'inpaint.v2', 'other'][(media_id % 4 + 1)::int]"


def _outputs(stats):
    names = F.array(*[F.lit(x) for x in ("AI-generated", "real_photo", "inpaint.v2", "other")])
    one = lambda k, s: F.struct(F.element_at(names, ((F.col("media_id") + k) % 4 + 1).cast("int")).alias("label"), s.alias("score"))
    return stats.select("media_id", F.array(one(0, F.col("entropy")), one(1, F.col("blur")), one(2, F.lit(-1.0)), one(3, F.lit(float("nan")))).alias("o"))


_A = "['AI-generated', 'real_photo', 'inpaint.v2', 'other'][((media_id + {}) % 4 + 1)::int]"


@query(
    "image_stats",
    f"""SELECT media_id, CASE WHEN first = 'real_photo' OR second = 'real_photo' OR first = 'AI-generated' OR second = 'AI-generated' THEN CASE WHEN s + r > 0 THEN s / (s + r) END END AS synthetic, CASE WHEN first = 'inpaint.v2' OR second = 'inpaint.v2' THEN CASE WHEN first = 'inpaint.v2' THEN entropy ELSE blur END / (entropy + blur) END AS manipulation,
 CASE WHEN entropy > blur OR (entropy = blur AND first < second) THEN [first, second] ELSE [second, first] END AS labels
FROM (SELECT *, CASE WHEN first = 'AI-generated' THEN entropy ELSE 0 END + CASE WHEN second = 'AI-generated' THEN blur ELSE 0 END AS s, CASE WHEN first = 'real_photo' THEN entropy ELSE 0 END + CASE WHEN second = 'real_photo' THEN blur ELSE 0 END AS r
 FROM (SELECT media_id, entropy, blur, {_A.format(0)} AS first, {_A.format(1)} AS second FROM image_stats))""",
)
def synthetic_class_mass(image_stats):
    n = _outputs(image_stats).withColumn("n", measures.outputs_normalize(F.col("o")))
    return n.select("media_id", measures.class_mass(F.col("n")).alias("synthetic"), measures.manipulation_mass(F.col("n")).alias("manipulation"), F.transform("n", lambda x: x["label"]).alias("labels"))


@query(
    "image_stats",
    """, x AS (SELECT media_id, width, height, unnest(list_distinct(list_append(range(0, greatest(width - 512, 0) + 1, 384), greatest(width - 512, 0)))) AS l FROM image_stats),
y AS (SELECT *, unnest(list_distinct(list_append(range(0, greatest(height - 512, 0) + 1, 384), greatest(height - 512, 0)))) AS t FROM x)
SELECT media_id, l AS left, t AS top, least(l + 512, width) AS right, least(t + 512, height) AS bottom FROM y""",
)
def tile_grid(image_stats):
    return measures.tile_grid(image_stats)


@query(
    "image_stats",
    "SELECT media_id, [round_even(30 * width / 100.0, 0)::int, round_even(20 * height / 100.0, 0)::int, round_even(70 * width / 100.0, 0)::int, round_even(50 * height / 100.0, 0)::int] AS box, round(CASE WHEN w * h > 0 THEN w * h / (1500 + 1600 - w * h) ELSE 0 END::double, 9) AS overlap FROM (SELECT *, greatest(0, least(60, media_id % 50 + 40) - greatest(10, media_id % 50)) AS w, greatest(0, least(40, 50) - greatest(10, 10)) AS h FROM image_stats)",
)
def box_algebra(image_stats):
    a, b = F.array(*[F.lit(x) for x in (10, 10, 60, 40)]), F.array((F.col("media_id") % 50).cast("int"), F.lit(10), (F.col("media_id") % 50 + 40).cast("int"), F.lit(50))
    return image_stats.select("media_id", measures.scale_box(F.array(*[F.lit(x) for x in (30, 20, 70, 50)]), 100.0, F.col("width"), F.col("height")).alias("box"), F.round(measures.iou(a, b), 9).alias("overlap"))


@query("image_stats", "SELECT sum(tp) / (sum(tp) + sum(fp)) AS precision, sum(tp) / (sum(tp) + sum(fn)) AS recall, 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1, sum(tp) / (sum(tp) + sum(fp) + sum(fn)) AS iou FROM (SELECT media_id % 50 AS tp, media_id % 7 AS fp, media_id % 11 AS fn FROM image_stats)")
def overlap_metrics(image_stats):
    return measures.overlap_metrics(image_stats.select(*[(F.col("media_id") % k).alias(n) for n, k in (("tp", 50), ("fp", 7), ("fn", 11))]))


@query(
    "documents",
    "SELECT doc_id, s AS stem, trim(regexp_replace(lower(s), '[^a-z0-9]+', '-', 'g'), '-') AS slug, doc_id % 9 AS number, regexp_replace(lower(s), '_[0-9]+_[0-9]+to[0-9]+$', '') AS source_group FROM (SELECT doc_id, 'Clip ' || source || '_' || (doc_id % 5) || '_3to' || (doc_id % 9) AS s FROM documents)",
)
def path_keys(documents):
    path = F.concat(F.lit("train/x/Clip "), "source", F.lit("_"), F.col("doc_id") % 5, F.lit("_3to"), F.col("doc_id") % 9, F.lit(".mp4"))
    return documents.select("doc_id", *[c.alias(n) for n, c in measures.path_keys(path).items()])


@query("documents", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'extension' WHEN doc_id % 10 = 0 THEN 'empty' WHEN (doc_id % 4 < 2 AND n_chars * 20000 > 15728640) OR (doc_id % 4 = 2 AND n_chars * 20000 > 83886080) THEN 'size' END AS refused FROM documents")
def upload_gate(documents):
    name = F.concat(F.lit("f."), F.element_at(F.array(*[F.lit(x) for x in ("PNG", "jpg", "mp4", "exe")]), (F.col("doc_id") % 4 + 1).cast("int")))
    return documents.select("doc_id", readers.upload_gate(name, F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("n_chars") * 20000)).alias("refused"))


@query("manifest", "SELECT split, count(*) FILTER (class_label = 'ai_generated') AS positives, count(*) FILTER (class_label IS NULL OR class_label <> 'ai_generated') AS negatives, count(*) FILTER (class_label = 'ai_generated') > 0 AND count(*) FILTER (class_label IS NULL OR class_label <> 'ai_generated') > 0 AS complete FROM manifest GROUP BY split")
def class_presence(manifest):
    return readers.class_presence(manifest, is_positive("class_label", ["ai_generated"]))


@query("manifest", "SELECT path, CASE split WHEN 'tuning' THEN 'validation' ELSE split END AS training_split FROM manifest WHERE split IN ('train', 'tuning')")
def training_view(manifest):
    return readers.training_view(manifest).select("path", "training_split")


@query("manifest", "SELECT path FROM manifest WHERE ('0x' || substr(sha256(path), 1, 8))::bigint % 100 >= 60")
def resume_pending(manifest):
    done = manifest.filter(splits.hash_bucket(F.col("path")) < 60).select("path", F.lit("v1").alias("config"))
    return readers.pending(manifest.select("path"), done, "path", "v1")


@query(
    "preds policy",
    "SELECT g.key, p.* REPLACE (coalesce(g.u, p.generation_upper) AS generation_upper) FROM policy p CROSS JOIN (SELECT generator_or_editor AS key, CASE WHEN count(*) >= 5 THEN max(generation_score) END AS u FROM preds GROUP BY generator_or_editor) g",
)
def policy_merge(preds, policy):
    overrides = preds.groupBy(F.col("generator_or_editor").alias("key")).agg(F.when(F.count("*") >= 5, F.max("generation_score")).alias("generation_upper"))
    return readers.merged_policies(policy, overrides, "key")


@query("preds", "SELECT doc_id, lower(trim(label)) AS label, generation_score FROM preds")
def prediction_scan(preds):
    raw = preds.select("doc_id", F.concat(F.lit(" "), F.upper("label")).alias("label"), F.col("generation_score").cast("string").alias("generation_score"), F.col("manipulation_score").cast("string").alias("manipulation_score"))
    return readers.prediction_rows(raw).select("doc_id", "label", "generation_score")


@query("embeddings", "SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * ((i % 7 - 3) / 10.0::double))) + 0.1))), 9) AS score FROM embeddings")
def linear_head_score(embeddings):
    return embeddings.select("vec_id", F.round(models.linear_head_score(F.col("embedding"), [(i % 7 - 3) / 10 for i in range(1, 65)], 0.1), 9).alias("score"))


@query("frames", "SELECT (SELECT list(DISTINCT warning ORDER BY warning) FROM frames WHERE warning <> 'view') AS names, CASE WHEN min(s) = max(s) THEN min(s) ELSE 'mixed' END AS sampling_policy FROM (SELECT CASE WHEN luma >= 0.1 THEN 'adaptive' ELSE 'uniform' END AS s FROM frames)")
def feature_inventory(frames):
    policy = F.when(F.col("luma") >= 0.1, "adaptive").otherwise("uniform")
    records = frames.filter("warning IS NOT NULL").select(F.create_map("warning", "ai_probability").alias("features"), policy.alias("sampling_policy"))
    return models.feature_inventory(records, ["view"])


@query("image_stats")
def temporal_model_selection(image_stats):
    part = F.when(splits.hash_bucket(F.col("media_id").cast("string")) < 70, "train").otherwise("validation")
    noise = F.pmod(F.xxhash64("media_id"), F.lit(100)) / 100.0
    y = ((F.col("entropy") / 10 + F.col("blur") / 240 + noise * 0.4) > 0.95).cast("int")
    return models.fit_candidates(image_stats.select("entropy", "blur", "blockiness_ratio", y.alias("y"), part.alias("split")), ["entropy", "blur", "blockiness_ratio"])
