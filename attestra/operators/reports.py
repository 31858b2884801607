"""What a reader of a report sees: messages and interpretations of measurements, headlines, next steps, capped lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headlines, and the readable names of evidence scores.
EVIDENCE_LABELS = {
    "ai_generation_score": "Dedicated detector AI-class score (not probability)",
    "sampled_frame_ai_generation_score": "Sampled-frame AI likelihood",
    "video_ai_generation_score": "Video AI-generated likelihood",
    "video_manipulation_score": "Video manipulation-class score",
    "metadata_score": "Metadata availability (not authenticity)",
    "visual_consistency_score": "Basic image quality (not authenticity)",
    "compression_score": "Compression consistency (not authenticity)",
    "pixel_forensic_score": "Traditional forensic consistency",
    "ai_artifact_score": "Handcrafted AI-artifact signal",
    "source_score": "Source context",
    "provenance_score": "Verifiable provenance",
    "web_corroboration_score": "Web corroboration",
    "overall_risk_score": "Legacy context risk (not verdict)",
}
VIDEO_SCORES = ["video_ai_generation_score", "sampled_frame_ai_generation_score", "ai_generation_score"]
HEURISTIC = "local_heuristic_synthetic_likelihood"
UNMATCHED = ["not_checked", "possible_context_match", "visually_similar_match"]

#: Parts into which a key's rows are first thinned, so that a hot key is thinned by many tasks.
SALTS = 32


def _kept(*messages: Column) -> Column:
    return F.filter(F.array(*messages), lambda m: m.isNotNull())


def forensic_messages(synthetic: Column, manipulation: Column) -> Column:
    """warnings and positives (codes, in order) of an image's measured statistics; null statistics say nothing either way,
    but that a missing hotspot or repeated patch is reassuring."""
    caption = F.coalesce(F.col("caption_likely"), F.lit(False))
    yes = lambda test, code: F.when(F.coalesce(test, F.lit(False)), F.lit(code))
    repeated = F.coalesce(F.col("duplicate_patch_ratio"), F.lit(0.0)) > 0.08
    warnings = _kept(
        yes(caption, "caption_overlay"), yes(synthetic >= 0.62, "synthetic_artifacts"), yes((manipulation >= 0.58) & ~caption, "editing_artifacts"),
        yes(F.coalesce(F.col("mean_residual_noise"), F.lit(0.0)) < 1.2, "low_noise"), yes((F.col("spectral_spike_ratio") > 7.5) & ~caption, "periodic_spikes"), yes(repeated, "repeated_patches"),
    )
    positives = _kept(
        yes(caption, "caption_explains_edges"), yes(synthetic <= 0.28, "no_synthetic_artifacts"), yes(F.coalesce(F.col("blockiness_ratio"), F.lit(1.0)) <= 1.35, "ordinary_blocks"),
        yes(F.coalesce(F.col("localized_hot_area_ratio"), F.lit(0.0)) <= 0.12, "no_hotspot"), yes(~repeated, "no_repeated_patches"),
    )
    return F.struct(warnings.alias("warnings"), positives.alias("positives"))


def forensic_interpretations(error_p95: Column) -> Column:
    """Labels of noise, frequency, blockiness, error level and repeated patches."""
    noise, blocks = F.col("mean_residual_noise"), F.col("blockiness_ratio")
    return F.struct(
        F.when(noise < 1.2, "very_smooth").when((F.col("block_noise_cv") > 1.0) | (F.col("edge_to_flat_noise_ratio") > 5.5), "uneven").otherwise("ordinary").alias("noise"),
        F.when(F.col("high_frequency_ratio") < 0.06, "low_detail").when(F.col("spectral_spike_ratio") > 7.5, "spikes").otherwise("ordinary").alias("frequency"),
        F.when(blocks > 1.45, "strong").when(blocks < 0.7, "weak").otherwise("ordinary").alias("blockiness"),
        F.when(F.col("localized_hot_area_ratio") > 0.18, "elevated").when(error_p95 < 1.0, "very_low").otherwise("no_hotspot").alias("error_level"),
        F.when(F.col("duplicate_patch_ratio") > 0.08, "repeated").otherwise("ordinary").alias("patches"),
    )


def readable_label(name: Column) -> Column:
    """A name as words, each with a capital."""
    return F.array_join(F.transform(F.split(F.replace(name, F.lit("_"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def evidence_label(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EVIDENCE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), readable_label(name))


def short_hash(value: Column) -> Column:
    """The first 12 and last 8 characters of a long hash; null for an empty one."""
    return F.when(F.length(value) <= 22, F.nullif(value, F.lit(""))).otherwise(F.concat(F.substring(value, 1, 12), F.lit("…"), F.substring(value, -8, 8)))


def detector_score(content_type: Column, evidence: Column, detectors: Column) -> Column:
    """0 to 100: the first evidence score of the content type that is a number, else the first completed learned detector's."""
    finite = lambda v: F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)
    keys = [F.when((content_type == "video") | (k == VIDEO_SCORES[-1]), finite(F.try_element_at(evidence, F.lit(k)))) for k in VIDEO_SCORES]
    learned = F.get(F.filter(detectors, lambda d: (d["status"] == "completed") & (d["name"] != HEURISTIC) & finite(d["synthetic_probability"]).isNotNull()), F.lit(0))
    score = F.coalesce(*keys, learned["synthetic_probability"] * 100)
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def display_headline(score: Column, learned: Column) -> Column:
    return (
        F.when(~learned, "Trained detector unavailable").when(score.isNull(), "No AI verdict").when(score >= 90, "Likely AI-generated").when(score >= 70, "Inconclusive / uncertain")
        .when(score > 30, "Mixed AI signals").when(score <= 15, "Likely camera-made").otherwise("Lower AI signal")
    )


def risk_class(verdict: Column, score: Column, learned: Column) -> Column:
    """By verdict, where there is one; else by the score of a learned detector."""
    by_score = F.when(~learned | score.isNull(), "risk-low").when(score >= 70, "risk-high").when(score > 30, "risk-medium").otherwise("risk-trust")
    return (
        F.when(verdict == "likely_authentic", "risk-trust").when(verdict.isin("likely_ai_generated", "likely_ai_manipulated"), "risk-high").when(verdict == "inconclusive", "risk-medium").otherwise(by_score)
    )


def display_projection(reports: DataFrame) -> DataFrame:
    """reports (content_type, verdict, evidence map, detectors array of name, status and synthetic_probability, sha256) with
    ai_score, headline, risk_class, short_hash and labels (of the evidence names, sorted)."""
    learned = F.exists("detectors", lambda d: (d["status"] == "completed") & (d["name"] != HEURISTIC))
    out = reports.withColumn("ai_score", detector_score(F.col("content_type"), F.col("evidence"), F.col("detectors")))
    score, learned = F.col("ai_score"), F.coalesce(learned, F.lit(False))
    return out.withColumns(
        {
            "headline": display_headline(score, learned), "risk_class": risk_class(F.col("verdict"), score, learned), "short_hash": short_hash(F.col("sha256")),
            "labels": F.transform(F.array_sort(F.map_keys("evidence")), evidence_label),
        }
    )


def score_feedback(label: Column, score: Column, probability: Column, match: Column, web: Column) -> Column:
    """headline, detector (how strong the strongest detector's score is), match_note and next_steps (codes, four at most) of
    a legacy score; a text post has no attachment to match. match: the source match's status, web: that of the research."""
    attached = label != "text post"
    headline = (
        F.when(score < 40, F.concat(F.lit("High-risk "), label, F.lit(" signals found"))).when(score < 60, F.concat(F.lit("Several "), label, F.lit(" signals need verification")))
        .when(score < 80, F.concat(F.lit("Mixed "), label, F.lit(" evidence"))).otherwise(F.concat(F.lit("Mostly reassuring "), label, F.lit(" signals")))
    )
    known = match.isin("exact_hash_match", "exact_visual_match", "partial_visual_match", "visually_similar_match", "possible_context_match", "not_found")
    detector = F.when(probability.isNull(), "none").when(probability >= 0.75, "strong").when(probability >= 0.45, "uncertain").otherwise("low")
    steps = _kept(
        F.when(F.coalesce(attached & match.isin(UNMATCHED), F.lit(False)), F.lit("reverse_image_search")), F.when(web == "not_configured", F.lit("add_search_key")), F.lit("open_cited_sources"), F.lit("find_earliest_uploader")
    )
    return F.struct(headline.alias("headline"), detector.alias("detector"), F.when(attached, F.when(known, match).otherwise("not_available")).alias("match_note"), F.slice(steps, 1, 4).alias("next_steps"))


def video_feedback(probability: Column, learned: Column, warnings: Column, positives: Column) -> Column:
    """headline, and codes of reasons for and against, of a video's trained score."""
    p = F.when(probability.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), probability)))
    usable = F.coalesce(learned, F.lit(False)) & probability.isNotNull()
    headline = (
        F.when(~usable, "No reliable AI verdict for this video").when(p >= 0.90, "This video may be AI-generated").when(p <= 0.15, "This video appears less likely to be AI-generated").otherwise("We cannot tell with enough confidence")
    )
    sustained = F.exists(warnings, lambda w: F.contains(F.lower(w), F.lit("sustained share")))
    quiet = F.exists(positives, lambda w: F.contains(F.lower(w), F.lit("did not show strong synthetic-video signals")))
    ai = _kept(F.when(usable & (p >= 0.90), F.lit("strong_match")), F.when(usable & (p < 0.90) & (p >= 0.50), F.lit("partly_alike")), F.when(sustained, F.lit("several_frames")))
    real = _kept(F.when(usable & (p <= 0.15), F.lit("little_likeness")), F.when(usable & (p > 0.15) & (p < 0.50), F.lit("leans_away")), F.when(quiet, F.lit("no_repeated_pattern")))
    return F.struct(headline.alias("headline"), ai.alias("reasons_ai"), real.alias("reasons_not_ai"))


def capped(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key by a total order, with rank, total (all of the key's rows) and beyond (those not listed).

    Rows are thinned to n within each of SALTS parts of a key, before and after they are shuffled, and only those meet:
    a key's task gets SALTS * n rows at most. Totals are counted with a partial step. Null keys are a key.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))).filter(F.col("_r") <= n).drop("_r", "_salt")
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
    totals = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("total"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return first.join(totals.hint("merge"), same).withColumn("beyond", F.greatest(F.lit(0), F.col("total") - n)).drop(*[f"_{k}" for k in keys])
