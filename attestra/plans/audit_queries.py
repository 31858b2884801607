"""Queries on manifests, fingerprints and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import audit, splits
from attestra.plans.registry import query

_BUCKET = "(('0x' || substr(sha256({}), 1, 8))::bigint % 100)"
_SPLIT = "CASE WHEN b < 70 THEN 'train' WHEN b < 80 THEN 'tuning' WHEN b < 90 THEN 'calibration' ELSE 'locked_test' END"


def _leak(kind: str, key: str, where: str = "true") -> str:
    return f"SELECT '{kind}' AS kind, {key} AS key, list_sort(list(DISTINCT split)) AS splits FROM manifest WHERE {where} AND trim({key}) <> '' GROUP BY {key} HAVING count(DISTINCT split) > 1"


@query("manifest", f"{_leak('sha256', 'sha256')} UNION ALL {_leak('source_group', 'source_group')} UNION ALL " + _leak("generator", "generator_or_editor", "lower(generator_or_editor) NOT IN ('authentic', 'real', 'camera', 'unknown')"))
def manifest_leakage(manifest):
    return audit.manifest_leakage(manifest)


@query(
    "manifest",
    "SELECT path, list_filter([" + ", ".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN '{c}' END" for c in audit.REQUIRED) + "], lambda x: x IS NOT NULL) AS missing FROM manifest",
)
def manifest_missing_fields(manifest):
    return manifest.select("path", audit.missing_fields().alias("missing"))


@query(
    "manifest",
    """SELECT sha256 AS key, list_sort(list(DISTINCT split)) AS splits, count(*) AS count, list_sort(list(path))[1:20] AS paths FROM manifest GROUP BY sha256 HAVING count(DISTINCT split) > 1""",
)
def cross_split_duplicates(manifest):
    return audit.duplicate_groups(manifest, "sha256").withColumnRenamed("sha256", "key")


@query("manifest", "SELECT count(*) AS groups FROM (SELECT 1 FROM manifest GROUP BY sha256, split HAVING count(*) > 1)")
def within_split_duplicates(manifest):
    return audit.within_split_duplicates(manifest, "sha256")


@query("manifest", "SELECT split, coalesce(class_label, 'unlabelled') AS label, count(*) AS n FROM manifest GROUP BY ROLLUP(split, coalesce(class_label, 'unlabelled'))")
def split_label_counts(manifest):
    return audit.split_label_counts(manifest)


@query(
    "prints",
    "SELECT least(a.path, b.path) AS path_a, greatest(a.path, b.path) AS path_b, bit_count(xor(a.fp, b.fp))::int AS distance FROM prints a JOIN prints b ON a.path < b.path AND a.split <> b.split AND bit_count(xor(a.fp, b.fp)) <= 4",
)
def hamming_near_match(prints):
    return audit.hamming_near_match(prints)


@query(
    "manifest",
    """, g AS (SELECT sha256 FROM manifest GROUP BY sha256 HAVING count(DISTINCT split) > 1)
SELECT path, class_label FROM manifest WHERE split = 'locked_test' AND sha256 NOT IN (SELECT sha256 FROM g)""",
)
def leakage_excluded(manifest):
    return audit.exclude_leakage(manifest, manifest, "sha256", "locked_test").select("path", "class_label")


@query(
    "manifest",
    "SELECT c.path, c.parent_media, p.split AS parent_split, CASE WHEN p.path IS NULL THEN 'missing' WHEN p.split <> c.split THEN 'split' ELSE 'ok' END AS lineage FROM manifest c LEFT JOIN manifest p ON p.path = c.parent_media WHERE c.parent_media IS NOT NULL",
)
def parent_lineage(manifest):
    return audit.parent_lineage(manifest)


@query(
    "embeddings",
    """SELECT vec_id, list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i+2] > embedding[i+1] THEN 1::bigint << i ELSE 0 END))::bigint AS difference,
 list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i+1]::double >= list_sum(list_transform(embedding, lambda x: x::double)) / len(embedding) THEN 1::bigint << i ELSE 0 END))::bigint AS average,
 list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i+1]::double >= list_median(list_transform(embedding[2:], lambda x: x::double)) THEN 1::bigint << i ELSE 0 END))::bigint AS median FROM embeddings""",
)
def vector_fingerprint(embeddings):
    return embeddings.select("vec_id", *[audit.vector_fingerprint(F.col("embedding"), k).alias(k) for k in ("difference", "average", "median")])


@query("documents", f"SELECT doc_id, {_SPLIT} AS split, b::int AS bucket FROM (SELECT doc_id, {_BUCKET.format('source')} AS b FROM documents)")
def hash_split(documents):
    return documents.select("doc_id", splits.hash_split(F.col("source")).alias("split"), splits.hash_bucket(F.col("source")).cast("int").alias("bucket"))


@query("documents", "SELECT doc_id, substr(sha256(concat_ws('␟', coalesce(trim(source), ''), coalesce(trim(lang), ''), coalesce(doc_id::varchar, ''))), 1, 24) AS source_group FROM documents")
def stable_group(documents):
    return documents.select("doc_id", splits.stable_group(F.col("source"), F.col("lang"), F.col("doc_id")).alias("source_group"))


_GENSPLIT = "SELECT 'src' || i AS generator, ['train', 'tuning', 'calibration', 'locked_test'][i % 4 + 1] AS generator_split FROM range(20) r(i)"


@query("manifest", f"SELECT path, m.split, generator_or_editor FROM manifest m LEFT JOIN ({_GENSPLIT}) g ON g.generator = m.generator_or_editor WHERE generator_or_editor = 'authentic' OR g.generator_split = m.split")
def generator_heldout(manifest):
    gens = manifest.sparkSession.range(20).select(
        F.concat(F.lit("src"), "id").alias("generator"), F.element_at(F.array(*[F.lit(x) for x in ("train", "tuning", "calibration", "locked_test")]), (F.col("id") % 4 + 1).cast("int")).alias("generator_split")
    )
    return splits.generator_heldout(manifest, gens).select("path", "split", "generator_or_editor")


@query(
    "manifest",
    """SELECT source_group, class_label, path, split FROM (SELECT *, row_number() OVER (PARTITION BY class_label, source_group ORDER BY CASE WHEN split IN ('test', 'locked_test') THEN 0 WHEN split IN ('validation', 'tuning', 'calibration') THEN 1 ELSE 2 END, path) AS r FROM manifest) WHERE r = 1""",
)
def dedup_priority(manifest):
    return splits.dedup_by_priority(manifest, ["class_label", "source_group"]).select("source_group", "class_label", "path", "split")


@query("manifest", "SELECT path, split, class_label FROM (SELECT *, row_number() OVER (PARTITION BY split, class_label ORDER BY sha256('7|' || path), path) AS r FROM manifest) WHERE r <= 5")
def cap_per_class(manifest):
    return splits.cap_per_class(manifest, ["split", "class_label"], 5, 7).select("path", "split", "class_label")


@query("manifest", "SELECT path, class_label, 1.0::double / nullif(count(*) FILTER (class_label IS NOT NULL) OVER (PARTITION BY class_label), 0) AS weight FROM manifest")
def class_weights(manifest):
    return splits.class_weights(manifest.select("path", "class_label"), "class_label").select("path", "class_label", "weight")


@query("manifest", "SELECT path, CASE WHEN ('0x' || substr(sha256('5|' || source_group), 1, 8))::bigint % 10000 < 1500 THEN 'validation' ELSE 'train' END AS part FROM manifest WHERE split = 'train'")
def fallback_split(manifest):
    return manifest.filter("split = 'train'").select("path", splits.fallback_split(manifest, "source_group", 0.15, 5).alias("part"))


@query(
    "manifest",
    """, p AS (SELECT path, split FROM manifest WHERE class_label = 'real_camera')
SELECT path, split, coalesce(lead(path) OVER w, first_value(path) OVER w) AS donor FROM p WINDOW w AS (PARTITION BY split ORDER BY path)""",
)
def donor_ring(manifest):
    return splits.donor_ring(manifest.filter("class_label = 'real_camera'").select("path", "split"))


@query("manifest", "SELECT path, split, source, class_label FROM manifest WHERE class_label IS NULL OR class_label <> 'ai_generated' OR (split, source) IN (('train', 'src1'), ('train', 'src2'), ('tuning', 'src3'), ('locked_test', 'src4'))")
def plan_filter(manifest):
    plan = manifest.sparkSession.createDataFrame([("train", "src1"), ("train", "src2"), ("tuning", "src3"), ("locked_test", "src4")], "split string, source string")
    return splits.plan_filter(manifest, plan).select("path", "split", "source", "class_label")


@query(
    "manifest",
    """, t AS (SELECT path, class_label IN ('ai_generated', 'ai_manipulated') AS y FROM manifest WHERE split = 'train' AND class_label IS NOT NULL), n AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM t)
SELECT count(*) FILTER (NOT y) AS negatives, sum(CASE WHEN y THEN greatest(1, q // p + CASE WHEN i < q % p THEN 1 ELSE 0 END) END)::bigint AS positives FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY path) - 1 AS i FROM t), n""",
)
def oversample_train(manifest):
    rows = manifest.filter("split = 'train' AND class_label IS NOT NULL").select("path", "class_label")
    y = F.col("class_label").isin("ai_generated", "ai_manipulated")
    return splits.oversample(rows, y, "path").agg(F.count_if(~y).alias("negatives"), F.count_if(y).alias("positives"))


@query(
    "manifest",
    """, f AS (SELECT *, row_number() OVER (PARTITION BY source_group ORDER BY sha256('9|' || path), path) AS r FROM manifest WHERE source_group NOT IN (SELECT source_group FROM manifest WHERE split = 'tuning')),
p AS (SELECT f.*, CASE source WHEN 'src1' THEN 3 ELSE 2 END AS k, row_number() OVER (PARTITION BY split, source ORDER BY sha256('9|' || source_group), path) AS q FROM f WHERE r = 1 AND split IN ('train', 'locked_test') AND source IN ('src1', 'src2'))
SELECT path, split, source, source_group FROM p WHERE q <= k""",
)
def planned_sample(manifest):
    plan = manifest.sparkSession.createDataFrame([(s, g, 3 if g == "src1" else 2) for s in ("train", "locked_test") for g in ("src1", "src2")], "split string, source string, count int")
    return splits.planned_sample(manifest, plan, manifest.filter("split = 'tuning'"), 9).select("path", "split", "source", "source_group")


@query(
    "manifest",
    """, e AS (SELECT *, CASE split WHEN 'train' THEN 'editor_a' WHEN 'tuning' THEN 'editor_b' ELSE 'editor_c' END AS editor FROM manifest WHERE class_label = 'real_camera')
SELECT path || s AS path, l AS class_label, CASE WHEN l = 'real_camera' THEN 'authentic' ELSE editor END AS generator_or_editor, t AS transformation, path AS parent_media, split, source_group
FROM (SELECT *, unnest(['#original', '#recompressed', '#edit', '#edit-recompressed']) AS s, unnest(['real_camera', 'real_camera', 'ai_manipulated', 'ai_manipulated']) AS l, unnest(['none', 'recompressed', 'none', 'recompressed']) AS t FROM (SELECT path, split, source_group, editor FROM e))""",
)
def derive_pairs(manifest):
    editors = manifest.sparkSession.createDataFrame([("train", "editor_a"), ("tuning", "editor_b"), ("calibration", "editor_c"), ("locked_test", "editor_c")], "split string, editor string")
    return splits.derive_pairs(manifest.filter("class_label = 'real_camera'"), editors)


@query(
    "manifest",
    """, r AS (SELECT source AS parent, path, CASE WHEN split = 'tuning' THEN 'v1' ELSE 'v2' END AS version FROM manifest WHERE lang_ok), l AS (SELECT 1)
SELECT parent FROM r WHERE version = 'v2' GROUP BY parent HAVING count(*) >= 10 AND bool_and(path NOT LIKE '%77')""".replace(" WHERE lang_ok", ""),
)
def completed_parents(manifest):
    records = manifest.select(F.col("source").alias("parent"), "path", F.when(F.col("split") == "tuning", "v1").otherwise("v2").alias("version"))
    return splits.completed_parents(records, manifest.filter("path NOT LIKE '%77'"), "v2", 10)
