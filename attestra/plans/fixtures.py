"""Views over the given tables that stand for this library's inputs: one definition for Spark and for the SQL check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "preds": """
SELECT t.doc_id, concat('doc/', cast(t.doc_id as string)) AS path, t.label,
       CASE t.label WHEN 'ai_generated' THEN 0.35e0 + 0.65e0*u1 WHEN 'ai_manipulated' THEN 0.55e0*u1 ELSE 0.60e0*u1 END AS generation_score,
       CASE WHEN t.doc_id % 11 = 0 THEN NULL WHEN t.label = 'ai_manipulated' THEN 0.40e0 + 0.60e0*u2 ELSE 0.50e0*u2 END AS manipulation_score,
       0.20e0*u3 AS view_score_range, (0.20e0*u3 > 0.18e0) AS force_inconclusive,
       (t.doc_id % 5 <> 0) AS localized_or_persistent_support, 0.30e0*u2 AS predicted_region_area_ratio,
       CASE WHEN t.label = 'real_camera' THEN 'authentic' ELSE t.source END AS generator_or_editor,
       t.lang AS transformation, CASE WHEN t.doc_id % 13 = 0 THEN '' ELSE t.lang END AS semantic_category
FROM (SELECT d.doc_id, d.lang, d.source,
             CASE WHEN l.toxic = 1 THEN 'ai_manipulated' WHEN l.quality = 1 THEN 'real_camera' ELSE 'ai_generated' END AS label,
             cast((d.doc_id*7919 + 13) % 10007 AS double)/cast(10007 AS double) AS u1,
             cast((d.doc_id*104729 + 7) % 10009 AS double)/cast(10009 AS double) AS u2,
             cast((d.doc_id*15485863 + 3) % 10037 AS double)/cast(10037 AS double) AS u3
      FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id) t""",
    "detectors": """
SELECT l_orderkey AS media_id,
       cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax) AS int) AS pos,
       CASE l_linenumber WHEN 1 THEN 'local_heuristic_synthetic_likelihood' WHEN 2 THEN 'community-forensics::base'
            WHEN 3 THEN 'packaged-detector' WHEN 4 THEN 'manipulation-specialist' WHEN 5 THEN 'generic:tiled_pixel_scan'
            WHEN 6 THEN 'fusion' ELSE 'generic' END AS name,
       CASE WHEN l_linestatus = 'O' OR l_returnflag = 'N' THEN 'completed' WHEN l_returnflag = 'A' THEN 'unavailable' ELSE 'error' END AS status,
       CASE WHEN l_linenumber = 4 THEN 'manipulation' WHEN l_linenumber <> 1 THEN 'generation' WHEN l_partkey % 2 = 0 THEN 'supporting' END AS task,
       CASE WHEN l_linenumber = 4 THEN NULL ELSE l_discount*cast(10 AS double) END AS synthetic_probability,
       CASE WHEN l_linenumber IN (4, 7) THEN l_tax/0.08e0 END AS manipulation_probability,
       (l_linenumber = 4 AND l_partkey % 3 = 0) AS has_region
FROM {lineitem}""",
    "frames": """
SELECT user_id AS video_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS int) AS frame_index, event_id, ts,
       least(1e0, value/200e0) AS ai_probability, value/500e0 AS luma,
       1e0 + cast(event_id % 31 AS double)/10e0 AS noise, cast(event_id % 97 AS double)/485e0 AS edge_density,
       1e0 - cast(event_id % 11 AS double)/20e0 AS hist_correlation, 100e0 - least(100e0, value/2e0) AS truth_score,
       cast(event_id % 101 AS double)/100e0 AS manipulation_probability, event_type AS warning, 30e0 AS fps,
       CASE WHEN event_id % 7 <> 0 THEN cast(event_id % 89 AS double)/100e0 END AS pixel_probability,
       cast(event_id % 53 AS double)/400e0 AS flow_warp_error, 0.8e0 + cast(event_id % 67 AS double)/50e0 AS flow_inconsistency
FROM {events}""",
    "manifest": """
SELECT concat('doc/', cast(d.doc_id as string)) AS path, sha2(d.text,256) AS sha256, 'text' AS media_type,
       CASE WHEN l.toxic = 1 THEN 'ai_manipulated' WHEN l.quality = 1 THEN 'real_camera' WHEN l.quality = 0 THEN 'ai_generated' END AS class_label,
       d.source, CASE WHEN d.doc_id % 17 = 0 THEN ' ' ELSE 'CC-BY-4.0' END AS license,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'authentic' ELSE d.source END AS generator_or_editor,
       CASE WHEN d.doc_id % 4 = 0 AND d.doc_id > 0 THEN concat('doc/', cast(d.doc_id - 1 as string)) END AS parent_media,
       d.lang AS transformation, d.lang AS semantic_category,
       substr(sha2(concat(d.source, d.lang, substr(d.text, 1, 16)),256), 1, 24) AS source_group,
       CASE WHEN b < 70 THEN 'train' WHEN b < 80 THEN 'tuning' WHEN b < 90 THEN 'calibration' ELSE 'locked_test' END AS split
FROM (SELECT *, cast(conv(substr(sha2(concat('doc:', cast(doc_id as string)),256), 1, 8),16,10) as bigint) % 100 AS b FROM {documents}) d
LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "image_stats": """
SELECT p_partkey AS media_id, 100 + p_size*40 AS width, 100 + cast(p_partkey % 50 AS int)*40 AS height,
       2e0 + cast(p_partkey % 70 AS double)/10e0 AS entropy, cast(p_partkey % 120 AS double) AS blur,
       cast(p_partkey % 13 AS double)/10e0 AS block_noise_cv, cast(p_partkey % 41 AS double)/10e0 AS mean_residual_noise,
       cast(p_partkey % 80 AS double)/10e0 AS edge_to_flat_noise_ratio, cast(p_partkey % 15 AS double)/100e0 AS high_frequency_ratio,
       cast(p_partkey % 100 AS double)/10e0 AS spectral_spike_ratio, cast(p_partkey % 18 AS double)/10e0 AS blockiness_ratio,
       cast(p_partkey % 23 AS double)/100e0 AS localized_hot_area_ratio, cast(p_partkey % 19 AS double)/100e0 AS duplicate_patch_ratio,
       cast(p_partkey % 11 AS double)/100e0 AS near_white_pixel_ratio, (p_partkey % 6 = 0) AS caption_likely
FROM {part}""",
    "requests": "SELECT o_orderkey AS request_id, o_custkey AS scan_id, o_orderdate AS ts, o_orderpriority AS kind FROM {orders}",
    "prints": """
WITH f AS (SELECT vec_id, aggregate(transform(sequence(0,62), i -> if(embedding[i+1] > embedding[i], shiftleft(1L, i), 0L)), 0L, (a,x) -> a | x) AS fp
           FROM {embeddings})
SELECT concat('vec/', cast(vec_id AS string)) AS path, 'train' AS split, fp FROM f
UNION ALL
SELECT concat('copy/', cast(vec_id AS string)), CASE WHEN vec_id % 3 = 0 THEN 'train' ELSE 'locked_test' END,
       fp ^ (shiftleft(1L, cast(vec_id % 63 AS int)) | shiftleft(1L, cast((vec_id*7) % 63 AS int))) FROM f""",
    "claims": "SELECT doc_id, text FROM {documents}",
}

#: Where DuckDB has no such function, its own form of a view.
DUCK_ONLY = {
    "prints": """
WITH f AS (SELECT vec_id, list_sum(list_transform(range(63), lambda i: case when embedding[i+2] > embedding[i+1] then (1::bigint << i) else 0 end))::bigint AS fp
           FROM embeddings)
SELECT concat('vec/', cast(vec_id AS varchar)) AS path, 'train' AS split, fp FROM f
UNION ALL
SELECT concat('copy/', cast(vec_id AS varchar)), CASE WHEN vec_id % 3 = 0 THEN 'train' ELSE 'locked_test' END,
       xor(fp, ((1::bigint << (vec_id % 63)) | (1::bigint << ((vec_id*7) % 63)))) FROM f"""
}

#: Decision thresholds of the fixtures: one row.
POLICY = """SELECT 0.15e0 AS generation_lower, 0.55e0 AS generation_upper, 0.15e0 AS manipulation_lower, 0.60e0 AS manipulation_upper,
 0.18e0 AS max_view_range, 0.30e0 AS max_window_range, 224 AS minimum_short_side, 8 AS minimum_frames, true AS generation_enabled, true AS manipulation_enabled"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view, or a given table."""
    if name == "policy":
        return spark.sql(POLICY)
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    used = set(re.findall(r"\{(\w+)\}", VIEWS[name]))
    return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in used})


def duck(name: str) -> str:
    """The view in DuckDB's SQL."""
    if name == "policy":
        return POLICY
    if name in DUCK_ONLY:
        return DUCK_ONLY[name]
    sql = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
    sql = re.sub(r"cast\(conv\((.*?),16,10\) as bigint\)", r"('0x' || \1)::bigint", sql)
    return re.sub(r"\bsha2\((.*?),256\)", r"sha256(\1)", sql).replace("as string)", "as varchar)").replace("AS string)", "AS varchar)")


def with_views(names: str, sql: str) -> str:
    """DuckDB SQL: the named views before a query that starts with SELECT, or with further WITH terms after a comma."""
    terms = ", ".join(f"{n} AS ({duck(n)})" for n in names.split() if n in VIEWS or n == "policy")
    sql = sql.strip()
    if sql.startswith(","):
        return f"WITH RECURSIVE {terms}{sql if terms else sql[1:]}"
    return f"WITH RECURSIVE {terms} {sql}" if terms else sql
