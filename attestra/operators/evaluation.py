"""Quality of predictions and verdicts. Denominators are 1 at least; AUC, average precision and ECE of nothing are null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.scores import GENERATED, MANIPULATED, count_if, expected_verdict, is_positive, normalized_label, ratio
from attestra.operators.prefix import prefix_counts
from attestra.shipping import ship_package

AI_VERDICTS = ["likely_ai_generated", "likely_ai_manipulated"]


def with_policy(preds: DataFrame, policy: DataFrame) -> DataFrame:
    """Every prediction with the policy's one row."""
    return preds.crossJoin(F.broadcast(policy))


def classify_predictions(preds: DataFrame, policy: DataFrame) -> DataFrame:
    """preds with normalized_label and verdict, by the offline rule: abstention first, limits inclusive.

    A missing support column counts as support. A null manipulation score can lead to neither a manipulated nor an
    authentic verdict.
    """
    p = with_policy(preds, policy)
    g, m = F.col("generation_score"), F.col("manipulation_score")
    support = F.coalesce(F.col("localized_or_persistent_support"), F.lit(True)) if "localized_or_persistent_support" in preds.columns else F.lit(True)
    forced = F.coalesce(F.col("force_inconclusive"), F.lit(False)) if "force_inconclusive" in preds.columns else F.lit(False)
    verdict = (
        F.when(forced, "inconclusive")
        .when(F.col("generation_enabled") & (g >= F.col("generation_upper")), "likely_ai_generated")
        .when(F.col("manipulation_enabled") & (g < F.col("generation_upper")) & (m >= F.col("manipulation_upper")) & support, "likely_ai_manipulated")
        .when((g <= F.col("generation_lower")) & (m <= F.col("manipulation_lower")), "likely_authentic")
        .otherwise("inconclusive")
    )
    return p.select(*preds.columns, normalized_label("label").alias("normalized_label"), verdict.alias("verdict"))


def confusion_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("label", "verdict").agg(F.count("*").alias("n"))


def verdict_cells(classified: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, normalized_label, verdict, n): all that the rates below need, a few rows however large the input."""
    return classified.groupBy(*keys, "normalized_label", "verdict").agg(F.count("*").alias("n"))


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def verdict_class_report(classified: DataFrame) -> DataFrame:
    """count, precision, recall, specificity and decisive coverage of each normalized label, absent ones too."""
    labels = classified.sparkSession.createDataFrame([("authentic",), ("generated",), ("manipulated",)], "class string")
    cells = verdict_cells(classified).crossJoin(F.broadcast(labels))  # 12 cells at most
    own, hit = F.col("normalized_label") == F.col("class"), F.col("verdict") == expected_verdict("class")
    out = labels.join(
        cells.groupBy("class").agg(
            _n(own).alias("count"), _n(own & hit).alias("tp"), _n(hit).alias("predicted"), _n(~own).alias("negatives"),
            _n(~own & hit).alias("fp"), _n(own & (F.col("verdict") != "inconclusive")).alias("decided"),
        ), "class", "left",
    ).na.fill(0)
    return out.select(
        "class", "count", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("count")).alias("recall"),
        (1 - ratio(F.col("fp"), F.col("negatives"))).alias("specificity"), ratio(F.col("decided"), F.col("count")).alias("decisive_coverage"),
    )


def generator_report(classified: DataFrame) -> DataFrame:
    """The same for each label and generator, with decisive accuracy; what is outside a group is the total less the group."""
    key = F.concat_ws(":", "normalized_label", F.coalesce(F.when(F.col("generator_or_editor") != "", F.col("generator_or_editor")), F.lit("unknown")))
    cells = verdict_cells(classified.withColumn("generator", key), "generator")
    totals = cells.groupBy("verdict").agg(F.sum("n").alias("verdict_n"))
    every = cells.agg(F.sum("n").alias("all_n"))
    hit = F.col("verdict") == expected_verdict("normalized_label")
    own = cells.groupBy("generator", "normalized_label").agg(F.sum("n").alias("count"), _n(hit).alias("tp"), _n(F.col("verdict") != "inconclusive").alias("decided"))
    out = own.withColumn("verdict", expected_verdict("normalized_label")).join(F.broadcast(totals), "verdict", "left").crossJoin(F.broadcast(every))
    fp = F.coalesce("verdict_n", F.lit(0)) - F.col("tp")
    return out.select(
        "generator", "count", ratio(F.col("decided"), F.col("count")).alias("decisive_coverage"), ratio(F.col("tp"), F.col("tp") + fp).alias("precision"),
        ratio(F.col("tp"), F.col("count")).alias("recall"), (1 - ratio(fp, F.col("all_n") - F.col("count"))).alias("specificity"),
        ratio(F.col("tp"), F.col("decided")).alias("decisive_accuracy"),
    )


def group_error_rates(classified: DataFrame, key: str, error: Column, include_label: bool = False) -> DataFrame:
    """(name, count, error_rate) by key; a missing key is `unspecified`."""
    name = F.coalesce(F.when(F.col(key) != "", F.col(key)), F.lit("unspecified"))
    name = F.concat_ws(":", "normalized_label", name) if include_label else name
    return classified.groupBy(name.alias("name")).agg(F.count("*").alias("count"), F.avg(error.cast("double")).alias("error_rate"))


def false_warning() -> Column:
    return (F.col("normalized_label") == "authentic") & F.col("verdict").isin(AI_VERDICTS)


def missed_synthetic() -> Column:
    return F.col("normalized_label").isin("generated", "manipulated") & (F.col("verdict") == "likely_authentic")


def verdict_rates(classified: DataFrame) -> DataFrame:
    """One row of the rates of decisions, from the verdict cells."""
    label, verdict = F.col("normalized_label"), F.col("verdict")
    gen, man, ai = verdict == "likely_ai_generated", verdict == "likely_ai_manipulated", verdict.isin(AI_VERDICTS)
    right = (gen & (label == "generated")) | (man & (label == "manipulated"))
    authentic, synthetic = label == "authentic", label.isin("generated", "manipulated")
    return verdict_cells(classified).agg(
        _n(F.lit(True)).alias("record_count"),
        ratio(_n(verdict != "inconclusive"), _n(F.lit(True))).alias("decisive_coverage"),
        ratio(_n(right), _n(ai)).alias("decisive_ai_precision"),
        ratio(_n(gen & (label == "generated")), _n(gen)).alias("generated_verdict_precision"),
        ratio(_n(man & (label == "manipulated")), _n(man)).alias("manipulated_verdict_precision"),
        ratio(_n(authentic & ai), _n(authentic)).alias("authentic_false_ai_rate"),
        ratio(_n(synthetic & (verdict == "likely_authentic")), _n(synthetic)).alias("synthetic_false_authentic_rate"),
    )


def roc_auc(preds: DataFrame, score: str, positives: list[str], undefined: float | None = None) -> DataFrame:
    """One row, auc: the chance that a positive's score is over a negative's, ties by half; by ranks, in linear space."""
    y = preds.select(F.col(score).alias("s"), is_positive("label", positives).cast("long").alias("p"))
    c = prefix_counts(y.withColumn("q", 1 - F.col("p")), "s", ["p", "q"], descending=False)
    one = c.agg(
        F.sum(F.col("p") * (F.col("cum_q") - F.col("q") / F.lit(2.0))).alias("wins"), F.sum("p").alias("P"), F.sum("q").alias("N")
    )
    return one.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("wins") / (F.col("P").cast("double") * F.col("N"))).otherwise(F.lit(undefined).cast("double")).alias("auc"))


def average_precision(preds: DataFrame, score: str, positives: list[str]) -> DataFrame:
    """One row, average_precision: precision at each distinct score, weighted by the recall that it adds."""
    y = preds.select(F.col(score).alias("s"), is_positive("label", positives).cast("long").alias("p"), F.lit(1).cast("long").alias("one"))
    c = prefix_counts(y, "s", ["p", "one"])
    return c.agg((F.sum(F.col("p") * F.col("cum_p").cast("double") / F.col("cum_one")) / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def brier_score(preds: DataFrame, score: str, positives: list[str]) -> DataFrame:
    y = is_positive("label", positives).cast("double")
    return preds.filter(F.col(score).isNotNull()).agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier_score"))


def calibration_error(preds: DataFrame, score: str, positives: list[str], bins: int = 10) -> DataFrame:
    """One row, ece: the mean distance of score and outcome over equal bins. A score on an edge i / bins is in bin i."""
    y = preds.filter(F.col(score).isNotNull()).select(F.col(score).alias("s"), is_positive("label", positives).cast("double").alias("y"))
    low = F.floor(F.col("s") * bins)  # s * bins can round across an edge: i / bins itself decides
    low = F.when(F.col("s") >= (low + 1) / F.lit(float(bins)), low + 1).when(F.col("s") < low / F.lit(float(bins)), low - 1).otherwise(low)
    b = y.groupBy(F.least(low, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("s").alias("s"), F.avg("y").alias("y"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def policy_metrics(preds: DataFrame, policy: DataFrame) -> DataFrame:
    """One row: the decision rates under the policy, AUC and ECE of both scores."""
    out = verdict_rates(classify_predictions(preds, policy))
    for name, positives in (("generation", GENERATED), ("manipulation", MANIPULATED)):
        auc = roc_auc(preds, f"{name}_score", positives).withColumnRenamed("auc", f"{name}_roc_auc")
        ece = calibration_error(preds, f"{name}_score", positives).withColumnRenamed("ece", f"{name}_calibration_error")
        out = out.crossJoin(F.broadcast(auc)).crossJoin(F.broadcast(ece))  # a row each
    return out


def promotion_gates(preds: DataFrame, policy: DataFrame, media_type: str = "image") -> DataFrame:
    """One row: seven gates and whether all hold. Limits depend on the media type."""
    image = media_type == "image"
    warning, missed, coverage = (0.01, 0.02, 0.70) if image else (0.02, 0.05, 0.60)
    classified = classify_predictions(preds, policy)
    hard = group_error_rates(classified.filter("normalized_label = 'authentic'"), "semantic_category", false_warning())
    hard = hard.agg(F.coalesce(F.bool_and(F.col("error_rate") <= warning), F.lit(True)).alias("no_hard_real_category_regression"))
    moved = group_error_rates(classified, "transformation", false_warning() | missed_synthetic(), include_label=True)
    limit = F.when(F.col("name").startswith("authentic:"), warning).otherwise(missed)
    moved = moved.agg(F.coalesce(F.bool_and(F.col("error_rate") <= limit), F.lit(True)).alias("no_supported_transformation_regression"))
    has = classified.agg(F.coalesce(F.bool_or(F.col("normalized_label") == "manipulated"), F.lit(False)).alias("has_manipulated"))
    r = verdict_rates(classified).crossJoin(F.broadcast(hard)).crossJoin(F.broadcast(moved)).crossJoin(F.broadcast(has))
    gates = {
        "generated_verdict_precision_at_least_95_percent": F.col("generated_verdict_precision") >= 0.95,
        "manipulated_verdict_precision_at_least_95_percent": ~F.col("has_manipulated") | (F.col("manipulated_verdict_precision") >= 0.95),
        "authentic_false_ai_rate_within_limit": F.col("authentic_false_ai_rate") <= warning,
        "synthetic_false_authentic_rate_within_limit": F.col("synthetic_false_authentic_rate") <= missed,
        "decisive_coverage_within_limit": F.col("decisive_coverage") >= coverage,
        "no_hard_real_category_regression": F.col("no_hard_real_category_regression"),
        "no_supported_transformation_regression": F.col("no_supported_transformation_regression"),
    }
    out = r.select(*[g.alias(name) for name, g in gates.items()])
    every = F.lit(True)
    for name in gates:
        every = every & F.col(name)
    return out.withColumn("promoted", every)


def _rates(c: DataFrame, *keys: str) -> DataFrame:
    """keys, the counts tp, fp, tn and fn, and the rates that follow from them."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    recall, specificity, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    return c.select(
        *keys, "tp", "fp", "tn", "fn", ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), ((recall + specificity) / 2).alias("balanced_accuracy"),
        precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"),
    )


def binary_metrics(scored: DataFrame, threshold: Column, *keys: str) -> DataFrame:
    """Counts and rates of score >= threshold against the boolean y, by keys. scored: (s, y)."""
    hit, y = F.col("s") >= threshold, F.col("y")
    c = scored.groupBy(*keys).agg(
        count_if(hit & y).alias("tp"), count_if(hit & ~y).alias("fp"), count_if(~hit & ~y).alias("tn"), count_if(~hit & y).alias("fn")
    )
    return _rates(c, *keys)


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """binary_metrics at each threshold of a fixed list, in one pass: rows are counted by the stretch between two thresholds
    that their score is in, and these counts, one more than thresholds at most, are added up for each threshold."""
    steps = sorted({float(t) for t in thresholds})
    place = Bucketizer(splits=[float("-inf"), *steps, float("inf")], inputCol="s", outputCol="place", handleInvalid="keep")  # NaN: the last place
    rows = place.transform(scored.select(F.col("s").cast("double").alias("s"), "y")).withColumn("place", F.when(F.col("s").isNotNull(), F.col("place")))
    counts = rows.groupBy("place").agg(count_if(F.col("y")).alias("yes"), count_if(~F.col("y")).alias("no"))
    grid = scored.sparkSession.createDataFrame(list(enumerate(steps, 1)), "step long, threshold double")
    hit = F.col("place") >= F.col("step")
    sums = {"tp": (hit, "yes"), "fp": (hit, "no"), "tn": (~hit, "no"), "fn": (~hit, "yes")}
    c = counts.crossJoin(F.broadcast(grid)).groupBy("threshold").agg(*[F.coalesce(F.sum(F.when(at, F.col(n))), F.lit(0)).alias(k) for k, (at, n) in sums.items()])
    return _rates(c, "threshold")


def three_way_metrics(scored: DataFrame, low: float, high: float) -> DataFrame:
    """One row: counts and rates of score <= low (authentic), >= high (AI), else undecided, against the boolean y."""
    s, y = F.col("s"), F.col("y")
    ai, real = s >= high, (s <= low) & ~(s >= high)
    c = scored.agg(
        F.count("*").alias("total"), count_if(ai & y).alias("true_ai"), count_if(ai & ~y).alias("false_ai"), count_if(real & ~y).alias("true_authentic"),
        count_if(real & y).alias("false_authentic"), count_if(~ai & ~real).alias("inconclusive"), count_if(y).alias("positives"), count_if(~y).alias("negatives"),
    )
    x = {n: F.col(n) for n in c.columns}
    decided = x["total"] - x["inconclusive"]
    return c.select(
        "*", ratio(decided, x["total"]).alias("coverage"), ratio(x["inconclusive"], x["total"]).alias("inconclusive_rate"),
        ratio(x["true_ai"] + x["true_authentic"], decided).alias("decisive_accuracy"), ratio(x["true_ai"], x["positives"]).alias("ai_recall"),
        ratio(x["true_authentic"], x["negatives"]).alias("authentic_recall"), ratio(x["false_ai"], x["negatives"]).alias("false_positive_rate"),
        ratio(x["false_authentic"], x["positives"]).alias("ai_as_authentic_rate"), ratio(x["true_ai"], x["true_ai"] + x["false_ai"]).alias("ai_precision"),
        ratio(x["true_authentic"], x["true_authentic"] + x["false_authentic"]).alias("authentic_precision"),
    )


def class_report(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """precision, recall, f1 and support of each class, from the confusion cells."""
    cells = pairs.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    by_truth = cells.groupBy(F.col("t").alias("class")).agg(F.sum("n").alias("support"), _n(F.col("t") == F.col("p")).alias("tp"))
    by_pred = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    out = by_truth.join(by_pred, "class", "left").na.fill(0, ["predicted"])
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return out.select(
        "class", precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"), "support"
    )


def bootstrap_intervals(classified: DataFrame, samples: int = 1000, seed: int = 404) -> DataFrame:
    """(metric, low, high): 95 % intervals of coverage and the authentic false-AI rate; no rows without predictions.

    Rows drawn with replacement have multinomial counts by verdict cell, of which there are 12 at most. Each replicate
    draws these counts, from a generator seeded by its number, so the work does not depend on the rows. Bounds are
    the replicates' nearest ranks.
    """
    ship_package(classified.sparkSession)
    cells = verdict_cells(classified).agg(F.array_sort(F.collect_list(F.struct("normalized_label", "verdict", "n"))).alias("cells"))
    reps = classified.sparkSession.range(samples).withColumnRenamed("id", "replicate").crossJoin(F.broadcast(cells.filter("size(cells) > 0")))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rates = []
            for replicate, found in zip(b["replicate"], b["cells"], strict=True):
                label, verdict = [c["normalized_label"] for c in found], [c["verdict"] for c in found]
                n = np.array([c["n"] for c in found], dtype=np.int64)
                drawn = np.random.default_rng([seed, int(replicate)]).multinomial(n.sum(), n / n.sum())
                auth = np.array([x == "authentic" for x in label])
                decided, ai = np.array([v != "inconclusive" for v in verdict]), np.array([v in AI_VERDICTS for v in verdict])
                rates += [("decisive_coverage", drawn[decided].sum() / n.sum()), ("authentic_false_ai_rate", drawn[auth & ai].sum() / max(1, drawn[auth].sum()))]
            yield pd.DataFrame(rates, columns=["metric", "v"])

    q = reps.mapInPandas(draw, "metric string, v double").groupBy("metric").agg(F.array_sort(F.collect_list("v")).alias("v"))
    nearest = lambda share: F.col("v")[round(share * (samples - 1))]
    return q.select("metric", nearest(0.025).alias("low"), nearest(0.975).alias("high"))
