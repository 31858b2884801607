"""Thresholds under limits. A limit that no threshold meets disables the outcome (null); it is never relaxed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions.scores import AUTHENTIC, GENERATED, MANIPULATED, is_positive, ratio
from attestra.operators.evaluation import threshold_sweep
from attestra.operators.pairs import GRID, best_pair
from attestra.operators.prefix import prefix_counts


def _counted(preds: DataFrame, score: str) -> DataFrame:
    """(s, pos?, authentic, generated, manipulated, one) as longs, null scores too."""
    one = lambda labels: is_positive("label", labels).cast("long")
    return preds.select(
        F.col(score).alias("s"), one(AUTHENTIC).alias("authentic"), one(GENERATED).alias("generated"), one(MANIPULATED).alias("manipulated"), F.lit(1).cast("long").alias("one")
    )


def upper_threshold(preds: DataFrame, score: str, positive: str, minimum_precision: float, false_warning_limit: float) -> DataFrame:
    """One row: threshold, true_positive, predicted, false_authentic. The lowest score with most true positives such that
    precision and the rate of authentic rows at or over it hold; the rate is over all authentic rows, scored or not.

    positive: `generated` or `manipulated`. All null if no score qualifies.
    """
    rows = _counted(preds, score)
    authentic = rows.agg(F.sum("authentic").alias("A"))
    c = prefix_counts(rows, "s", ["authentic", positive, "one"]).crossJoin(F.broadcast(authentic))
    ok = c.filter((F.col(f"cum_{positive}") / F.col("cum_one") >= minimum_precision) & (ratio(F.col("cum_authentic"), F.col("A")) <= false_warning_limit))
    best = ok.agg(F.min_by(F.struct("s", F.col(f"cum_{positive}").alias("t"), "cum_one", "cum_authentic"), F.struct(-F.col(f"cum_{positive}"), "s")).alias("b"))
    return best.select(F.col("b.s").alias("threshold"), F.col("b.t").alias("true_positive"), F.col("b.cum_one").alias("predicted"), F.col("b.cum_authentic").alias("false_authentic"))


def lower_thresholds(preds: DataFrame, false_authentic_limit: float, grid: int = GRID) -> DataFrame:
    """One row: generation_lower, manipulation_lower, coverage, exact. The pair of scores with the widest coverage such that
    few enough synthetic rows lie at or under both; the first in ascending order among equals.

    The pair is one of real scores at every size (see best_pair), so exact is always true; grid has no influence on it.
    Scores of rows that lack the other one are candidates too; they matter only if no pair that covers a row is
    allowed. Without any pair: 0, 0.
    """
    synthetic = (is_positive("label", GENERATED) | is_positive("label", MANIPULATED)).cast("long")
    g, m = F.col("generation_score"), F.col("manipulation_score")
    both = preds.filter(g.isNotNull() & m.isNotNull()).select(g.alias("x"), m.alias("y"), F.lit(1).cast("long").alias("n"), synthetic.alias("syn"))
    all_synthetic, g_first, m_first = preds.agg(F.coalesce(F.sum(synthetic), F.lit(0)), F.min(g), F.min(m)).first()
    whole = max(1, all_synthetic)

    def allowed(low: dict, high: dict):
        return low["syn"] / whole <= false_authentic_limit

    best = best_pair(both, None, ["n", "syn"], "n", allowed, lambda c: [-c["n"], c["x"], c["y"]], grid=grid)
    if best:
        row = (float(best["x"]), float(best["y"]), int(best["n"]), True)
    elif g_first is not None and m_first is not None and false_authentic_limit >= 0 and both.filter((F.col("x") <= g_first) & (F.col("y") <= m_first)).isEmpty():
        row = (float(g_first), float(m_first), 0, True)
    else:
        row = (0.0, 0.0, 0, True)
    return preds.sparkSession.createDataFrame([row], "generation_lower double, manipulation_lower double, coverage long, exact boolean")


def calibrated_policy(preds: DataFrame, media_type: str = "image", minimum_precision: float = 0.95) -> DataFrame:
    """One row: a policy's thresholds and switches, and the class counts. Limits depend on the media type."""
    warning, missed = (0.01, 0.02) if media_type == "image" else (0.02, 0.05)
    out = preds.agg(*[F.count_if(is_positive("label", x)).alias(n) for n, x in (("authentic", AUTHENTIC), ("generated", GENERATED), ("manipulated", MANIPULATED))])
    for kind, positive in (("generation", "generated"), ("manipulation", "manipulated")):
        one = upper_threshold(preds, f"{kind}_score", positive, minimum_precision, warning).select(
            F.coalesce("threshold", F.lit(1.0)).alias(f"{kind}_upper"), F.col("threshold").isNotNull().alias(f"{kind}_enabled")
        )
        out = out.crossJoin(F.broadcast(one))
    lower = lower_thresholds(preds, missed).select(F.round("generation_lower", 6).alias("generation_lower"), F.round("manipulation_lower", 6).alias("manipulation_lower"))
    return out.crossJoin(F.broadcast(lower))


def safe_threshold(preds: DataFrame, score: str = "manipulation_score", precision: float = 0.95, warning: float = 0.01, generated: float = 0.01) -> DataFrame:
    """One row: the threshold with most recall under three limits, the highest one among equals; null without all classes."""
    rows = _counted(preds.filter(F.col(score).isNotNull()), score)
    totals = rows.agg(*[F.sum(x).alias(f"all_{x}") for x in ("authentic", "generated", "manipulated")])
    c = prefix_counts(rows, "s", ["authentic", "generated", "manipulated", "one"]).crossJoin(F.broadcast(totals))
    c = c.filter("all_authentic > 0 AND all_generated > 0 AND all_manipulated > 0").select(
        F.col("s").alias("threshold"), (F.col("cum_manipulated") / F.col("cum_one")).alias("precision"), (F.col("cum_manipulated") / F.col("all_manipulated")).alias("recall"),
        (F.col("cum_authentic") / F.col("all_authentic")).alias("authentic_rate"), (F.col("cum_generated") / F.col("all_generated")).alias("generated_rate"),
        F.col("cum_one").alias("predicted"), F.col("cum_manipulated").alias("true_manipulated"),
    )
    ok = c.filter((F.col("precision") >= precision) & (F.col("authentic_rate") <= warning) & (F.col("generated_rate") <= generated))
    return ok.agg(F.max_by(F.struct(*c.columns), F.struct("recall", "threshold")).alias("b")).select("b.*")


def localizer_threshold(preds: DataFrame, threshold: float) -> DataFrame:
    """One row of counts and rates of manipulation_score >= threshold with support and stability both."""
    hit = (F.col("manipulation_score") >= threshold) & F.col("localized_or_persistent_support") & ~F.col("force_inconclusive")
    kind = {n: is_positive("label", x) for n, x in (("authentic", AUTHENTIC), ("generated", GENERATED), ("manipulated", MANIPULATED))}
    c = preds.agg(
        F.count_if(hit).alias("predicted_manipulated"), *[F.count_if(hit & k).alias(f"hit_{n}") for n, k in kind.items()], *[F.count_if(k).alias(f"all_{n}") for n, k in kind.items()]
    )
    return c.select(
        F.lit(threshold).alias("threshold"), "predicted_manipulated", F.col("hit_manipulated").alias("true_manipulated"),
        (F.col("predicted_manipulated") - F.col("hit_manipulated")).alias("false_warnings"),
        ratio(F.col("hit_manipulated"), F.col("predicted_manipulated")).alias("precision"), ratio(F.col("hit_manipulated"), F.col("all_manipulated")).alias("recall"),
        ratio(F.col("hit_authentic"), F.col("all_authentic")).alias("authentic_rate"), ratio(F.col("hit_generated"), F.col("all_generated")).alias("generated_rate"),
    )


def localizer_report(preds: DataFrame) -> DataFrame:
    """Rows of each label: rate of support, unstable rows, six quantiles of the score, each a column (q0 to q100)."""
    out = preds.groupBy("label").agg(
        F.count("*").alias("n"), F.avg(F.col("localized_or_persistent_support").cast("double")).alias("support_rate"), F.count_if("force_inconclusive").alias("unstable"),
        F.percentile("manipulation_score", F.array(*[F.lit(q) for q in (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)])).alias("quantiles"),
    )
    names = ("q0", "q10", "q50", "q90", "q99", "q100")
    return out.select("label", "n", "support_rate", "unstable", *[F.element_at("quantiles", i + 1).alias(name) for i, name in enumerate(names)])


def localized_rule(preds: DataFrame, precision: float, warning: float, generated: float, max_view_range: float, grid: int = GRID) -> DataFrame:
    """One row: the (area, score) rule with most recall, then precision, fewest warnings, smallest area, under the limits;
    all null if there is none.

    Candidate areas are 0 and the distinct areas of all scored rows, at every size (see best_pair); grid has no influence
    on the result.
    """
    scored = preds.filter("manipulation_score IS NOT NULL")
    one = lambda labels: is_positive("label", labels).cast("long")
    area = F.col("predicted_region_area_ratio").cast("double")
    rows = scored.filter("localized_or_persistent_support AND NOT force_inconclusive").filter((F.col("view_score_range") <= max_view_range) & area.isNotNull())
    # Rules take rows at or over both values, best_pair those at or under: values are negated. 0 - x has no negative zero.
    rows = rows.select((0 - area).alias("x"), (0 - F.col("manipulation_score")).alias("y"), F.lit(1).cast("long").alias("one"), one(AUTHENTIC).alias("auth"), one(GENERATED).alias("gen"), one(MANIPULATED).alias("man"))
    xs = scored.select((0 - area).alias("x")).union(preds.sparkSession.sql("SELECT 0e0 AS x")).filter("x IS NOT NULL").distinct()
    all_auth, all_gen, all_man = scored.agg(*[F.coalesce(F.sum(one(x)), F.lit(0)) for x in (AUTHENTIC, GENERATED, MANIPULATED)]).first()

    def allowed(low: dict, high: dict):
        man, rest = high["man"], low["one"] - low["man"]
        return (man / np.maximum(1, man + rest) >= precision) & (low["auth"] / all_auth <= warning) & (low["gen"] / all_gen <= generated)

    def rank(c: dict) -> list:
        return [-c["man"], -(c["man"] / c["one"]), c["auth"] + c["gen"], -c["x"], c["y"]]

    best = best_pair(rows, xs, ["one", "auth", "gen", "man"], "man", allowed, rank, x_last=True, grid=grid) if all_auth and all_gen and all_man else None
    row = (None,) * 9
    if best:
        n, auth, gen, man = (int(best[c]) for c in ("one", "auth", "gen", "man"))
        row = (float(0 - best["x"]), float(0 - best["y"]), n, man, auth + gen, man / n, man / all_man, auth / all_auth, gen / all_gen)
    return preds.sparkSession.createDataFrame(
        [row], "area double, score double, predicted long, true_manipulated long, warnings long, precision double, recall double, auth_rate double, gen_rate double"
    )


def best_threshold(scored: DataFrame, low: float = 0.05, high: float = 0.95, points: int = 181) -> DataFrame:
    """One row: the grid threshold with the best (balanced accuracy, F1, closeness to 0.5). scored: (s, y)."""
    grid = [round(low + (high - low) * i / (points - 1), 6) for i in range(points)]
    m = threshold_sweep(scored, grid)
    order = F.struct(F.bround("balanced_accuracy", 12), F.bround("f1", 12), -F.bround(F.abs(F.col("threshold") - 0.5), 9), -F.col("threshold"))
    return m.agg(F.max_by(F.struct("threshold", "balanced_accuracy", "f1"), order).alias("b")).select("b.*")
