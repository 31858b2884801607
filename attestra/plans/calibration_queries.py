"""Queries on thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions.scores import GENERATED, is_positive
from attestra.operators import calibration as cal
from attestra.plans.registry import query


def _upper(kind: str, label: str) -> str:
    return f"""SELECT k.s AS threshold, count(*) FILTER (label = '{label}') AS true_positive, count(*) AS predicted, count(*) FILTER (label = 'real_camera') AS false_authentic
 FROM (SELECT DISTINCT {kind}_score AS s FROM preds WHERE {kind}_score IS NOT NULL) k, preds p WHERE p.{kind}_score >= k.s GROUP BY k.s
 HAVING count(*) FILTER (label = '{label}') / count(*) >= 0.95 AND count(*) FILTER (label = 'real_camera') / (SELECT greatest(1, count(*) FILTER (label = 'real_camera')) FROM preds) <= 0.01
 ORDER BY true_positive DESC, threshold LIMIT 1"""


LOWER = """SELECT g AS generation_lower, m AS manipulation_lower, coverage FROM (
 SELECT g.s AS g, m.s AS m, count(*) FILTER (p.generation_score <= g.s AND p.manipulation_score <= m.s) AS coverage,
  count(*) FILTER (p.generation_score <= g.s AND p.manipulation_score <= m.s AND label <> 'real_camera') / (SELECT greatest(1, count(*) FILTER (label <> 'real_camera')) FROM preds) AS rate
 FROM (SELECT DISTINCT generation_score AS s FROM preds) g, (SELECT DISTINCT manipulation_score AS s FROM preds WHERE manipulation_score IS NOT NULL) m, preds p GROUP BY g.s, m.s)
 WHERE rate <= 0.02 ORDER BY coverage DESC, g, m LIMIT 1"""


@query("preds", _upper("generation", "ai_generated"))
def upper_threshold(preds):
    return cal.upper_threshold(preds, "generation_score", "generated", 0.95, 0.01)


@query("preds", f"SELECT *, true AS exact FROM ({LOWER})")
def lower_thresholds(preds):
    return cal.lower_thresholds(preds, 0.02)


@query(
    "preds",
    f"""SELECT (SELECT count(*) FROM preds WHERE label = 'real_camera') AS authentic, (SELECT count(*) FROM preds WHERE label = 'ai_generated') AS generated,
 (SELECT count(*) FROM preds WHERE label = 'ai_manipulated') AS manipulated, g.threshold AS generation_upper, true AS generation_enabled, m.threshold AS manipulation_upper, true AS manipulation_enabled,
 round(l.generation_lower, 6) AS generation_lower, round(l.manipulation_lower, 6) AS manipulation_lower
 FROM ({_upper("generation", "ai_generated")}) g, ({_upper("manipulation", "ai_manipulated")}) m, ({LOWER}) l""",
)
def calibrated_policy(preds):
    return cal.calibrated_policy(preds)


_ALL = "(SELECT count(*) FROM preds WHERE label = '{}'{})"


@query(
    "preds",
    """, k AS (SELECT DISTINCT manipulation_score AS s FROM preds WHERE manipulation_score IS NOT NULL), u AS (SELECT * FROM preds WHERE manipulation_score IS NOT NULL),
t AS (SELECT count(*) FILTER (label = 'real_camera') AS a, count(*) FILTER (label = 'ai_generated') AS g, count(*) FILTER (label = 'ai_manipulated') AS m FROM u)
SELECT k.s AS threshold, count(*) FILTER (label = 'ai_manipulated') / count(*) AS precision, count(*) FILTER (label = 'ai_manipulated') / max(t.m) AS recall, count(*) FILTER (label = 'real_camera') / max(t.a) AS authentic_rate,
 count(*) FILTER (label = 'ai_generated') / max(t.g) AS generated_rate, count(*) AS predicted, count(*) FILTER (label = 'ai_manipulated') AS true_manipulated
FROM k, u, t WHERE manipulation_score >= k.s GROUP BY k.s HAVING precision >= 0.95 AND authentic_rate <= 0.01 AND generated_rate <= 0.05 ORDER BY recall DESC, threshold DESC LIMIT 1""",
)
def safe_threshold(preds):
    return cal.safe_threshold(preds, generated=0.05)


@query(
    "preds",
    """SELECT 0.5::double AS threshold, count(*) FILTER (hit) AS predicted_manipulated, count(*) FILTER (hit AND label = 'ai_manipulated') AS true_manipulated, count(*) FILTER (hit AND label <> 'ai_manipulated') AS false_warnings,
 count(*) FILTER (hit AND label = 'ai_manipulated') / greatest(1, count(*) FILTER (hit)) AS precision, count(*) FILTER (hit AND label = 'ai_manipulated') / greatest(1, count(*) FILTER (label = 'ai_manipulated')) AS recall,
 count(*) FILTER (hit AND label = 'real_camera') / greatest(1, count(*) FILTER (label = 'real_camera')) AS authentic_rate, count(*) FILTER (hit AND label = 'ai_generated') / greatest(1, count(*) FILTER (label = 'ai_generated')) AS generated_rate
FROM (SELECT *, coalesce(manipulation_score >= 0.5, false) AND localized_or_persistent_support AND NOT force_inconclusive AS hit FROM preds)""",
)
def localizer_threshold(preds):
    return cal.localizer_threshold(preds, 0.5)


@query(
    "preds",
    """SELECT label, count(*) AS n, avg(localized_or_persistent_support::int::double) AS support_rate, count(*) FILTER (force_inconclusive) AS unstable,
 round(quantile_cont(manipulation_score, 0), 9) AS q0, round(quantile_cont(manipulation_score, 0.1), 9) AS q10, round(quantile_cont(manipulation_score, 0.5), 9) AS q50,
 round(quantile_cont(manipulation_score, 0.9), 9) AS q90, round(quantile_cont(manipulation_score, 0.99), 9) AS q99, round(quantile_cont(manipulation_score, 1), 9) AS q100 FROM preds GROUP BY label""",
)
def localizer_report(preds):
    out = cal.localizer_report(preds)
    return out.select(*[F.round(c, 9).alias(c) if c[0] == "q" else F.col(c) for c in out.columns])


@query(
    "preds",
    """, e AS (SELECT * FROM preds WHERE localized_or_persistent_support AND NOT force_inconclusive AND view_score_range <= 0.18 AND manipulation_score IS NOT NULL),
u AS (SELECT * FROM preds WHERE manipulation_score IS NOT NULL), t AS (SELECT count(*) FILTER (label = 'real_camera') AS a, count(*) FILTER (label = 'ai_generated') AS g, count(*) FILTER (label = 'ai_manipulated') AS m FROM u),
ar AS (SELECT 0.0::double AS a UNION SELECT predicted_region_area_ratio FROM u), sc AS (SELECT DISTINCT manipulation_score AS s FROM e)
SELECT ar.a AS area, sc.s AS score, count(*) AS predicted, count(*) FILTER (label = 'ai_manipulated') AS true_manipulated, count(*) FILTER (label <> 'ai_manipulated') AS warnings, count(*) FILTER (label = 'ai_manipulated') / count(*) AS precision,
 count(*) FILTER (label = 'ai_manipulated') / max(t.m) AS recall, count(*) FILTER (label = 'real_camera') / max(t.a) AS auth_rate, count(*) FILTER (label = 'ai_generated') / max(t.g) AS gen_rate
FROM ar, sc, e, t WHERE e.predicted_region_area_ratio >= ar.a AND e.manipulation_score >= sc.s GROUP BY ar.a, sc.s, sc.s
HAVING precision >= 0.9 AND auth_rate <= 0.01 AND gen_rate <= 0.05 AND bool_or(e.manipulation_score = sc.s) ORDER BY recall DESC, precision DESC, warnings, area, score DESC LIMIT 1""",
)
def localized_rule(preds):
    return cal.localized_rule(preds, 0.9, 0.01, 0.05, 0.18)


@query(
    "preds",
    """, k AS (SELECT round(0.05 + 0.9 * i / 180, 6) AS t FROM range(181) r(i)), m AS (SELECT t, count(*) FILTER (y AND s >= t) AS tp, count(*) FILTER (NOT y AND s >= t) AS fp, count(*) FILTER (NOT y AND s < t) AS tn, count(*) FILTER (y AND s < t) AS fn
FROM k, (SELECT generation_score AS s, label = 'ai_generated' AS y FROM preds) GROUP BY t), r AS (SELECT t AS threshold, (tp / greatest(1, tp + fn) + tn / greatest(1, tn + fp)) / 2 AS balanced_accuracy,
 2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn), 1e-12) AS f1 FROM m)
SELECT * FROM r ORDER BY round(balanced_accuracy, 12) DESC, round(f1, 12) DESC, round(abs(threshold - 0.5), 9), threshold LIMIT 1""",
)
def best_threshold(preds):
    return cal.best_threshold(preds.select(F.col("generation_score").alias("s"), is_positive("label", GENERATED).alias("y")))
