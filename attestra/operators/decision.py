"""The four-way verdict on a medium. Abstention comes first; context never moves a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.scores import score_confidence
from attestra.operators.fusion import HEURISTIC, _learned, generation_fusion, manipulation_fusion

#: Largest range of generation scores that is no conflict.
MAX_DISAGREEMENT = 0.35


def quality_ok(media_type: Column, width: Column, height: Column, frames: Column, short_side: Column, minimum_frames: Column) -> Column:
    """Images need a short side, if both sides are known; videos need frames, an unknown count is 0."""
    video = F.coalesce(frames, F.lit(0)) >= minimum_frames
    image = F.when(width.isNotNull() & height.isNotNull(), F.least(width, height) >= short_side).otherwise(True)
    return F.when(media_type == "video", video).otherwise(image)


def evidence_table(detectors: DataFrame, context: DataFrame) -> DataFrame:
    """One row for each medium of context: fused scores, which specialists completed, and the context's columns.

    context: (media_id, media_type, width, height, frames, instability, ai_marker, camera_marker, provenance_verified).
    """
    generation = _learned("synthetic_probability", "generation")
    facts = detectors.groupBy("media_id").agg(
        (F.count(generation) > 0).alias("generation_available"),
        F.when(F.count(generation) >= 2, F.max(generation) - F.min(generation)).alias("disagreement"),
        (F.count(_learned("manipulation_probability", None)) > 0).alias("screen_available"),
        (F.count(_learned("manipulation_probability", "manipulation")) > 0).alias("dedicated_available"),
        F.bool_or((F.col("task") == "manipulation") & (F.col("status") == "completed") & F.col("has_region")).alias("localized"),
    )
    out = context.join(facts, "media_id", "left").join(generation_fusion(detectors), "media_id", "left").join(manipulation_fusion(detectors), "media_id", "left")
    return out.na.fill(False, ["generation_available", "screen_available", "dedicated_available", "localized"])


def verdict_conflicts() -> Column:
    """Names of the conflicts in a row of evidence with its policy."""
    limit = F.when(F.col("media_type") == "video", F.col("max_window_range")).otherwise(F.col("max_view_range"))
    strong = (F.col("generation_score") >= F.col("generation_upper")) & (F.col("camera_marker") | F.col("provenance_verified"))
    found = F.array(
        F.when(F.col("disagreement") > MAX_DISAGREEMENT, F.lit("disagreement")),
        F.when(F.col("instability") > limit, F.lit("instability")),
        F.when(strong, F.lit("provenance")),
    )
    return F.filter(found, lambda x: x.isNotNull())


def media_verdict(detectors: DataFrame, context: DataFrame, policy: DataFrame) -> DataFrame:
    """(media_id, generation_score, manipulation_score, conflicts, verdict, confidence, reason), by one ordered chain of
    rules: conflicts, an AI marker without a strong score, quality, a missing generator, a disabled outcome, generated,
    manipulated (enabled, dedicated, localized), authentic (with a manipulation check), else inconclusive."""
    e = evidence_table(detectors, context).crossJoin(F.broadcast(policy)).withColumn("conflicts", verdict_conflicts())
    g, m = F.col("generation_score"), F.col("manipulation_score")
    has_g = F.col("generation_available") & g.isNotNull()
    quality = quality_ok(F.col("media_type"), F.col("width"), F.col("height"), F.col("frames"), F.col("minimum_short_side"), F.col("minimum_frames"))
    high_m = (g < F.col("generation_upper")) & (m >= F.col("manipulation_upper"))
    low_g = g <= F.col("generation_lower")
    out = lambda verdict, confidence, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    rules = (
        F.when(F.size("conflicts") > 0, out("inconclusive", "moderate", "conflict"))
        .when((F.coalesce(F.trim("ai_marker"), F.lit("")) != "") & (~has_g | (g < F.col("generation_upper"))), out("inconclusive", "moderate", "marker_without_score"))
        .when(~quality, out("inconclusive", "low", "quality"))
        .when(~has_g, out("inconclusive", "low", "no_generator"))
        .when(~F.col("generation_enabled"), out("inconclusive", "low", "generation_disabled"))
        .when(g >= F.col("generation_upper"), out("likely_ai_generated", "high", "generated"))
        .when(high_m & ~F.col("manipulation_enabled"), out("inconclusive", "low", "manipulation_disabled"))
        .when(high_m & ~F.col("dedicated_available"), out("inconclusive", "moderate", "no_specialist"))
        .when(high_m & ~F.col("localized"), out("inconclusive", "moderate", "not_localized"))
        .when(high_m, out("likely_ai_manipulated", "high", "manipulated"))
        .when(low_g & (~F.col("screen_available") | m.isNull()), out("inconclusive", "low", "no_manipulation_check"))
        .when(low_g & (m <= F.col("manipulation_lower")), out("likely_authentic", "moderate", "authentic"))
        .otherwise(out("inconclusive", "low", "between"))
    )
    return e.withColumn("d", rules).select("media_id", "generation_score", "manipulation_score", "conflicts", "d.verdict", "d.confidence", "d.reason")


def evidence_signals(scored: DataFrame, policy: DataFrame) -> DataFrame:
    """(media_id, source, status, signal, confidence): one row for each medium and kind of score."""
    p = scored.crossJoin(F.broadcast(policy))
    one = lambda name: F.struct(
        F.lit(name).alias("source"),
        F.when(F.col(f"{name}_score").isNull(), "unavailable").otherwise("completed").alias("status"),
        F.when(F.col(f"{name}_score").isNull(), "unknown")
        .when(F.col(f"{name}_score") >= F.col(f"{name}_upper"), f"supports_{name}")
        .when(F.col(f"{name}_score") <= F.col(f"{name}_lower"), "supports_authentic")
        .otherwise("neutral")
        .alias("signal"),
        score_confidence(f"{name}_score").alias("confidence"),
    )
    return p.select("media_id", F.explode(F.array(one("generation"), one("manipulation"))).alias("s")).select("media_id", "s.*")


def single_tile_reuse(detectors: DataFrame, sizes: DataFrame, tile: int = 512) -> DataFrame:
    """Full-frame rows as tile rows where the frame fits one tile: name with the tile suffix, marked reused."""
    small = sizes.filter((F.col("width") <= tile) & (F.col("height") <= tile)).select("media_id")
    own = detectors.filter((F.coalesce(F.col("task"), F.lit("generation")) == "generation") & ~F.col("name").endswith(":tiled_pixel_scan") & ~F.col("name").isin(HEURISTIC, "fusion"))
    return own.join(small, "media_id", "left_semi").select("media_id", "pos", F.concat("name", F.lit(":tiled_pixel_scan")).alias("name"), "status", "synthetic_probability", F.lit(True).alias("reused"))


def media_feedback(verdict: Column, media_type: Column, generated: Column, manipulated: Column, authentic: Column, conflicts: Column) -> Column:
    """headline and capped lists of distinct reasons (arrays of texts, blanks dropped, first seen first)."""
    noun = F.when(media_type == "image", "image").otherwise("video")
    unique = lambda *x: F.array_distinct(F.filter(F.transform(F.concat(*x), lambda t: F.trim(t)), lambda t: t != ""))
    headline = (
        F.when(verdict == "likely_ai_generated", F.concat(F.lit("This "), noun, F.lit(" is likely AI-generated")))
        .when(verdict == "likely_ai_manipulated", F.concat(F.lit("This "), noun, F.lit(" is likely AI-edited or manipulated")))
        .when(verdict == "likely_authentic", F.concat(F.lit("This "), noun, F.lit(" is likely authentic")))
        .otherwise("We cannot tell with enough confidence")
    )
    combined = F.slice(unique(generated, manipulated), 1, 4)
    return F.struct(
        headline.alias("headline"), combined.alias("reasons_ai"), F.slice(unique(generated), 1, 4).alias("reasons_generated"), F.slice(unique(manipulated), 1, 4).alias("reasons_manipulated"),
        F.slice(unique(authentic), 1, 4).alias("reasons_authentic"), F.slice(unique(combined, authentic, conflicts), 1, 8).alias("notes"),
    )


def capability_report(registry: DataFrame, files: DataFrame, policy: DataFrame) -> DataFrame:
    """One row: which verdicts can be given. registry: (id, task, path); files: (path). An artifact is ready if its file is
    listed, or if its id is no path at all (a remote one); calibration must be a listed file."""
    there = registry.join(files.select("path", F.lit(True).alias("_there")).distinct().hint("merge"), "path", "left")
    ready = F.coalesce(F.col("_there"), F.lit(False)) | F.col("path").isNull()
    has = lambda task: F.coalesce(F.bool_and(F.when(F.col("task") == task, ready)), F.lit(False))
    state = there.agg(*[has(t).alias(t) for t in ("generation", "manipulation", "screen", "calibration")]).crossJoin(F.broadcast(policy))
    screen = F.col("manipulation") | F.col("screen")
    return state.select(
        (F.col("generation") & F.col("calibration") & F.col("generation_enabled")).alias("decisive_generation"),
        (F.col("manipulation") & F.col("calibration") & F.col("manipulation_enabled")).alias("decisive_manipulation"),
        (F.col("generation") & screen & F.col("calibration")).alias("decisive_authentic"), screen.alias("screening"), F.lit(True).alias("inconclusive_fallback"),
    )
