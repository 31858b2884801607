"""Queries on predictions, verdicts and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.functions.scores import GENERATED, MANIPULATED, flag, is_positive, normalized_label, probability
from attestra.operators import evaluation as ev
from attestra.plans.registry import query

NL = """CASE WHEN label IN ('authentic','real','real_camera','likely_authentic') THEN 'authentic'
 WHEN label IN ('manipulated','ai_manipulated','likely_ai_manipulated') THEN 'manipulated' ELSE 'generated' END"""
#: Terms over preds and policy: c, the classified predictions.
CLASSIFIED = f""", c AS (SELECT p.*, {NL} AS nl, CASE WHEN force_inconclusive THEN 'inconclusive'
 WHEN generation_score >= generation_upper THEN 'likely_ai_generated'
 WHEN manipulation_score >= manipulation_upper AND localized_or_persistent_support THEN 'likely_ai_manipulated'
 WHEN generation_score <= generation_lower AND manipulation_score <= manipulation_lower THEN 'likely_authentic' ELSE 'inconclusive' END AS verdict
 FROM preds p, policy)
"""
EXPECTED = "CASE nl WHEN 'authentic' THEN 'likely_authentic' WHEN 'generated' THEN 'likely_ai_generated' ELSE 'likely_ai_manipulated' END"


def _scored(preds):
    return preds.select(F.col("generation_score").alias("s"), is_positive("label", GENERATED).alias("y"))


_RATES = """count(*) AS record_count, count(*) FILTER (verdict <> 'inconclusive') / greatest(1, count(*)) AS decisive_coverage,
 count(*) FILTER ((verdict = 'likely_ai_generated' AND nl = 'generated') OR (verdict = 'likely_ai_manipulated' AND nl = 'manipulated')) / greatest(1, count(*) FILTER (verdict LIKE 'likely_ai%')) AS decisive_ai_precision,
 count(*) FILTER (verdict = 'likely_ai_generated' AND nl = 'generated') / greatest(1, count(*) FILTER (verdict = 'likely_ai_generated')) AS generated_verdict_precision,
 count(*) FILTER (verdict = 'likely_ai_manipulated' AND nl = 'manipulated') / greatest(1, count(*) FILTER (verdict = 'likely_ai_manipulated')) AS manipulated_verdict_precision,
 count(*) FILTER (nl = 'authentic' AND verdict LIKE 'likely_ai%') / greatest(1, count(*) FILTER (nl = 'authentic')) AS authentic_false_ai_rate,
 count(*) FILTER (nl <> 'authentic' AND verdict = 'likely_authentic') / greatest(1, count(*) FILTER (nl <> 'authentic')) AS synthetic_false_authentic_rate"""


def _auc(score: str, label: str) -> str:
    return f"(SELECT avg(CASE WHEN p.{score} > n.{score} THEN 1.0 WHEN p.{score} = n.{score} THEN 0.5 ELSE 0.0 END::double) FROM preds p, preds n WHERE p.label = '{label}' AND n.label <> '{label}' AND p.{score} IS NOT NULL AND n.{score} IS NOT NULL)"


def _ece(score: str, label: str) -> str:
    return f"""(SELECT sum(k * abs(cs - cy)) / sum(k) FROM (SELECT count(*) AS k, avg({score}) AS cs, avg(CASE WHEN label = '{label}' THEN 1.0 ELSE 0.0 END::double) AS cy
 FROM preds, (SELECT unnest(range(0, 10)) AS i) WHERE {score} >= i / 10.0::double AND ({score} < (i + 1) / 10.0::double OR i = 9) GROUP BY i))"""


@query(
    "preds policy",
    CLASSIFIED
    + f"""SELECT {_RATES}, {_auc("generation_score", "ai_generated")} AS generation_roc_auc, {_ece("generation_score", "ai_generated")} AS generation_calibration_error,
 {_auc("manipulation_score", "ai_manipulated")} AS manipulation_roc_auc, {_ece("manipulation_score", "ai_manipulated")} AS manipulation_calibration_error FROM c""",
)
def policy_metrics(preds, policy):
    return ev.policy_metrics(preds, policy)


@query("preds policy", CLASSIFIED + "SELECT doc_id, label, nl AS normalized_label, verdict FROM c")
def policy_verdict(preds, policy):
    return ev.classify_predictions(preds, policy).select("doc_id", "label", "normalized_label", "verdict")


@query("preds policy", CLASSIFIED + "SELECT label, verdict, count(*) AS n FROM c GROUP BY ALL")
def confusion_counts(preds, policy):
    return ev.confusion_counts(ev.classify_predictions(preds, policy))


@query(
    "preds policy",
    CLASSIFIED
    + """, k AS (SELECT unnest(['authentic', 'generated', 'manipulated']) AS class, unnest(['likely_authentic', 'likely_ai_generated', 'likely_ai_manipulated']) AS want)
SELECT class, count(*) FILTER (nl = class) AS count, count(*) FILTER (nl = class AND verdict = want) / greatest(1, count(*) FILTER (verdict = want)) AS precision,
 count(*) FILTER (nl = class AND verdict = want) / greatest(1, count(*) FILTER (nl = class)) AS recall,
 1 - count(*) FILTER (nl <> class AND verdict = want) / greatest(1, count(*) FILTER (nl <> class)) AS specificity,
 count(*) FILTER (nl = class AND verdict <> 'inconclusive') / greatest(1, count(*) FILTER (nl = class)) AS decisive_coverage FROM c, k GROUP BY class, want""",
)
def verdict_class_report(preds, policy):
    return ev.verdict_class_report(ev.classify_predictions(preds, policy))


@query(
    "preds policy",
    CLASSIFIED
    + f""", g AS (SELECT *, nl || ':' || coalesce(nullif(generator_or_editor, ''), 'unknown') AS generator, {EXPECTED} AS want FROM c), k AS (SELECT DISTINCT generator, want FROM g)
SELECT k.generator, count(*) FILTER (g.generator = k.generator) AS count,
 count(*) FILTER (g.generator = k.generator AND verdict <> 'inconclusive') / greatest(1, count(*) FILTER (g.generator = k.generator)) AS decisive_coverage,
 count(*) FILTER (g.generator = k.generator AND verdict = k.want) / greatest(1, count(*) FILTER (verdict = k.want)) AS precision,
 count(*) FILTER (g.generator = k.generator AND verdict = k.want) / greatest(1, count(*) FILTER (g.generator = k.generator)) AS recall,
 1 - count(*) FILTER (g.generator <> k.generator AND verdict = k.want) / greatest(1, count(*) FILTER (g.generator <> k.generator)) AS specificity,
 count(*) FILTER (g.generator = k.generator AND verdict = k.want) / greatest(1, count(*) FILTER (g.generator = k.generator AND verdict <> 'inconclusive')) AS decisive_accuracy
 FROM g, k GROUP BY k.generator, k.want""",
)
def generator_report(preds, policy):
    return ev.generator_report(ev.classify_predictions(preds, policy))


@query(
    "preds policy",
    CLASSIFIED
    + """SELECT 'category' AS kind, coalesce(nullif(semantic_category, ''), 'unspecified') AS name, count(*) AS count, avg((verdict LIKE 'likely_ai%')::int::double) AS error_rate FROM c WHERE nl = 'authentic' GROUP BY 2
UNION ALL SELECT 'transformation', nl || ':' || coalesce(nullif(transformation, ''), 'unspecified'), count(*),
 avg(((nl = 'authentic' AND verdict LIKE 'likely_ai%') OR (nl <> 'authentic' AND verdict = 'likely_authentic'))::int::double) FROM c GROUP BY 2""",
)
def group_error_rates(preds, policy):
    c = ev.classify_predictions(preds, policy)
    hard = ev.group_error_rates(c.filter("normalized_label = 'authentic'"), "semantic_category", ev.false_warning())
    moved = ev.group_error_rates(c, "transformation", ev.false_warning() | ev.missed_synthetic(), include_label=True)
    out = hard.withColumn("kind", F.lit("category")).unionByName(moved.withColumn("kind", F.lit("transformation")))
    return out.select("kind", "name", "count", "error_rate")


@query(
    "preds policy",
    CLASSIFIED
    + f""", r AS (SELECT {_RATES}, bool_or(nl = 'manipulated') AS has FROM c),
h AS (SELECT max(e) <= 0.01 AS ok FROM (SELECT avg((verdict LIKE 'likely_ai%')::int::double) AS e FROM c WHERE nl = 'authentic' GROUP BY coalesce(nullif(semantic_category, ''), 'unspecified'))),
m AS (SELECT bool_and(e <= CASE WHEN nl = 'authentic' THEN 0.01 ELSE 0.02 END) AS ok FROM (SELECT nl, avg(((nl = 'authentic' AND verdict LIKE 'likely_ai%') OR (nl <> 'authentic' AND verdict = 'likely_authentic'))::int::double) AS e FROM c GROUP BY nl, transformation)),
g AS (SELECT generated_verdict_precision >= 0.95 AS generated_verdict_precision_at_least_95_percent, NOT has OR manipulated_verdict_precision >= 0.95 AS manipulated_verdict_precision_at_least_95_percent,
 authentic_false_ai_rate <= 0.01 AS authentic_false_ai_rate_within_limit, synthetic_false_authentic_rate <= 0.02 AS synthetic_false_authentic_rate_within_limit,
 decisive_coverage >= 0.70 AS decisive_coverage_within_limit, h.ok AS no_hard_real_category_regression, m.ok AS no_supported_transformation_regression FROM r, h, m)
SELECT *, generated_verdict_precision_at_least_95_percent AND manipulated_verdict_precision_at_least_95_percent AND authentic_false_ai_rate_within_limit AND synthetic_false_authentic_rate_within_limit
 AND decisive_coverage_within_limit AND no_hard_real_category_regression AND no_supported_transformation_regression AS promoted FROM g""",
)
def promotion_gates(preds, policy):
    return ev.promotion_gates(preds, policy)


@query("preds", f"SELECT {_auc('generation_score', 'ai_generated')} AS auc")
def roc_auc(preds):
    return ev.roc_auc(preds, "generation_score", GENERATED)


@query(
    "preds",
    """, k AS (SELECT DISTINCT generation_score AS s FROM preds), r AS (SELECT k.s, count(*) FILTER (label = 'ai_generated') AS tp, count(*) AS n,
 count(*) FILTER (label = 'ai_generated' AND generation_score = k.s) AS own FROM k, preds WHERE generation_score >= k.s GROUP BY k.s)
SELECT sum(own * tp / n) / (SELECT count(*) FROM preds WHERE label = 'ai_generated') AS average_precision FROM r""",
)
def average_precision(preds):
    return ev.average_precision(preds, "generation_score", GENERATED)


@query("preds", "SELECT avg(power(manipulation_score - (label = 'ai_manipulated')::int, 2)) AS brier_score FROM preds WHERE manipulation_score IS NOT NULL")
def brier_score(preds):
    return ev.brier_score(preds, "manipulation_score", MANIPULATED)


@query("preds", f"SELECT {_ece('manipulation_score', 'ai_manipulated')} AS ece")
def calibration_error(preds):
    return ev.calibration_error(preds, "manipulation_score", MANIPULATED)


def _metrics(t: str) -> str:
    return f"""tp, fp, tn, fn, (tp + tn) / (tp + fp + tn + fn) AS accuracy, (tp / greatest(1, tp + fn) + tn / greatest(1, tn + fp)) / 2 AS balanced_accuracy,
 tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS recall, tn / greatest(1, tn + fp) AS specificity,
 2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn), 1e-12) AS f1
 FROM (SELECT {t} AS threshold, count(*) FILTER (y AND s >= {t}) AS tp, count(*) FILTER (NOT y AND s >= {t}) AS fp, count(*) FILTER (NOT y AND s < {t}) AS tn, count(*) FILTER (y AND s < {t}) AS fn
 FROM (SELECT generation_score AS s, label = 'ai_generated' AS y FROM preds)"""


@query("preds", f"SELECT {_metrics('0.5')})")
def binary_metrics(preds):
    return ev.binary_metrics(_scored(preds), F.lit(0.5))


@query("preds", f"SELECT threshold, {_metrics('t')}, (SELECT unnest([0.5::double, 0.7, 0.8, 0.85, 0.9, 0.95]) AS t) GROUP BY t)")
def threshold_sweep(preds):
    return ev.threshold_sweep(_scored(preds), [0.50, 0.70, 0.80, 0.85, 0.90, 0.95])


@query(
    "preds",
    """SELECT *, (total - inconclusive) / greatest(1, total) AS coverage, inconclusive / greatest(1, total) AS inconclusive_rate, (true_ai + true_authentic) / greatest(1, total - inconclusive) AS decisive_accuracy,
 true_ai / greatest(1, positives) AS ai_recall, true_authentic / greatest(1, negatives) AS authentic_recall, false_ai / greatest(1, negatives) AS false_positive_rate,
 false_authentic / greatest(1, positives) AS ai_as_authentic_rate, true_ai / greatest(1, true_ai + false_ai) AS ai_precision, true_authentic / greatest(1, true_authentic + false_authentic) AS authentic_precision
FROM (SELECT count(*) AS total, count(*) FILTER (s >= 0.55 AND y) AS true_ai, count(*) FILTER (s >= 0.55 AND NOT y) AS false_ai, count(*) FILTER (s <= 0.15 AND NOT y) AS true_authentic,
 count(*) FILTER (s <= 0.15 AND y) AS false_authentic, count(*) FILTER (s > 0.15 AND s < 0.55) AS inconclusive, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives
 FROM (SELECT generation_score AS s, label = 'ai_generated' AS y FROM preds))""",
)
def three_way_metrics(preds):
    return ev.three_way_metrics(_scored(preds), 0.15, 0.55)


@query(
    "preds policy",
    CLASSIFIED
    + """, k AS (SELECT DISTINCT nl AS class FROM c), p AS (SELECT nl AS t, CASE verdict WHEN 'likely_authentic' THEN 'authentic' WHEN 'likely_ai_generated' THEN 'generated' WHEN 'likely_ai_manipulated' THEN 'manipulated' ELSE 'none' END AS p FROM c),
r AS (SELECT class, count(*) FILTER (t = class AND p = class) / greatest(1, count(*) FILTER (p = class)) AS precision, count(*) FILTER (t = class AND p = class) / greatest(1, count(*) FILTER (t = class)) AS recall,
 count(*) FILTER (t = class) AS support FROM k, p GROUP BY class)
SELECT class, precision, recall, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1, support FROM r""",
)
def class_report(preds, policy):
    c = ev.classify_predictions(preds, policy)
    said = F.when(F.col("verdict") == "likely_authentic", "authentic").when(F.col("verdict") == "likely_ai_generated", "generated")
    said = said.when(F.col("verdict") == "likely_ai_manipulated", "manipulated").otherwise("none")
    return ev.class_report(c.select(F.col("normalized_label").alias("truth"), said.alias("predicted")))


@query("preds policy")
def bootstrap_intervals(preds, policy):
    return ev.bootstrap_intervals(ev.classify_predictions(preds, policy))


@query("preds", f"SELECT label, {NL} AS normalized_label, count(*) AS n FROM preds GROUP BY ALL")
def label_normalize(preds):
    return preds.groupBy("label", normalized_label("label").alias("normalized_label")).agg(F.count("*").alias("n"))


@query(
    "preds",
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN NULL WHEN doc_id % 7 = 2 THEN greatest(0, least(1, 3 * generation_score - 1)) ELSE generation_score END AS p,
 lower(trim(CASE doc_id % 4 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'yes' WHEN 2 THEN '0' ELSE '1' END)) IN ('1', 'true', 'yes') AS f FROM preds""",
)
def probability_coerce(preds):
    raw = F.when(F.col("doc_id") % 7 == 0, "abc").when(F.col("doc_id") % 7 == 1, "nan")
    raw = raw.when(F.col("doc_id") % 7 == 2, (3 * F.col("generation_score") - 1).cast("string")).otherwise(F.col("generation_score").cast("string"))
    text = F.when(F.col("doc_id") % 4 == 0, " TRUE ").when(F.col("doc_id") % 4 == 1, "yes").when(F.col("doc_id") % 4 == 2, "0").otherwise("1")
    return preds.select("doc_id", probability(raw).alias("p"), flag(text).alias("f"))
