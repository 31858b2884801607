"""Rule scores over measured pixel statistics: one row for each image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.scores import clamp

# Parts of metadata values that name software, in the order in which they are looked for, and camera fields.
AI_SOFTWARE = [
    ("automatic1111", "AUTOMATIC1111"), ("comfyui", "ComfyUI"), ("dall-e", "DALL-E"), ("dalle", "DALL-E"), ("firefly", "Adobe Firefly"),
    ("fooocus", "Fooocus"), ("invokeai", "InvokeAI"), ("midjourney", "Midjourney"), ("stable diffusion", "Stable Diffusion"),
]
EDITING_SOFTWARE = [("adobe photoshop", "Adobe Photoshop"), ("adobe lightroom", "Adobe Lightroom"), ("affinity photo", "Affinity Photo"), ("gimp", "GIMP"), ("snapseed", "Snapseed")]
CAPTURE_FIELDS = ["datetimeoriginal", "exposuretime", "fnumber", "focallength", "isospeedratings", "lensmake", "lensmodel", "make", "model"]


def _plus(condition: Column, value: float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def synthetic_probability() -> Column:
    c = {n: F.col(n) for n in ("mean_residual_noise", "block_noise_cv", "edge_to_flat_noise_ratio", "high_frequency_ratio", "spectral_spike_ratio", "blockiness_ratio", "localized_hot_area_ratio", "duplicate_patch_ratio", "near_white_pixel_ratio")}
    caption, noise, high = F.col("caption_likely"), c["mean_residual_noise"], c["high_frequency_ratio"]
    p = (
        F.lit(0.16) + F.when(noise < 1.2, 0.16).when(noise > 2.5, -0.04).otherwise(0.0) + _plus((c["block_noise_cv"] < 0.16) & (noise < 2.4), 0.08)
        + _plus((c["edge_to_flat_noise_ratio"] > 5.5) & ~caption, 0.08) + F.when(high < 0.06, 0.08).when(high > 0.11, -0.04).otherwise(0.0)
        + _plus((c["spectral_spike_ratio"] > 7.5) & ~caption, 0.09) + _plus(c["blockiness_ratio"] > 1.42, 0.04) + _plus((c["localized_hot_area_ratio"] > 0.12) & ~caption, 0.06)
        + _plus(c["duplicate_patch_ratio"] > 0.08, 0.12) + _plus((c["near_white_pixel_ratio"] > 0.08) & ~caption, 0.03) + _plus(caption, -0.07)
    )
    return clamp(p, 0.03, 0.92)


def manipulation_probability() -> Column:
    p = (
        F.lit(0.12) + _plus(F.col("caption_likely"), 0.30) + _plus(F.col("localized_hot_area_ratio") > 0.12, 0.14)
        + _plus(F.col("blockiness_ratio") > 1.45, 0.05) + _plus(F.col("duplicate_patch_ratio") > 0.08, 0.18)
    )
    return clamp(p, 0.03, 0.90)


def forensic_score(synthetic: Column, manipulation: Column) -> Column:
    return clamp(100 - (72 * synthetic + 28 * manipulation), 5, 98)


def compression_score(cv: Column) -> Column:
    """From 20 to 95, falling with the variation between blocks; 60 where it is unknown."""
    return F.when(cv.isNull(), 60.0).otherwise(clamp(95 - 85 * cv, 20, 95))


def heuristic_fallback() -> Column:
    """A supporting score from entropy, blur, compression and the forensic scores; it decides nothing alone."""
    caption, s, m = F.col("caption_likely"), synthetic_probability(), manipulation_probability()
    p = (
        F.lit(0.14) + _plus((F.col("entropy") < 3.5) | (F.col("entropy") > 7.8), 0.10) + _plus(F.col("blur") < 35, 0.12)
        + F.when(F.col("block_noise_cv") > 0.7, F.when(caption, 0.02).otherwise(0.08)).otherwise(0.0)
        + F.when(s >= 0.60, F.least(F.lit(0.26), (s - 0.50) * 0.70)).when(s <= 0.28, -0.07).otherwise(0.0) + _plus((m >= 0.58) & ~caption, 0.06) + _plus(caption, -0.04)
    )
    return F.bround(clamp(p, 0.02, 0.98), 3)


def reasonable_dimensions(width: Column, height: Column) -> Column:
    """Both sides from 300 to 12000, the longer one at most 4.5 times the shorter."""
    return (F.least(width, height) >= 300) & (F.greatest(width, height) <= 12000) & (F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height)) <= 4.5)


def image_context_score(has_metadata: Column, has_camera: Column, format_differs: Column) -> Column:
    """A whole score from 70 on, by metadata, file format, dimensions, entropy, blur, compression and forensic scores.

    Metadata that is missing costs nothing. Columns beside the arguments are those of the measured statistics."""
    s, entropy = synthetic_probability(), F.col("entropy")
    forensic = forensic_score(s, manipulation_probability())
    plus = lambda c, a, b=0: F.when(c, a).otherwise(b)
    score = (
        F.lit(70) + plus(has_metadata, 8 + F.when(has_camera, 8).otherwise(0)) + plus(format_differs, -10) + plus(reasonable_dimensions(F.col("width"), F.col("height")), 4, -5)
        + plus((entropy >= 3.5) & (entropy <= 7.8), 5, -8) + plus(F.col("blur") < 35, -8) + F.when(F.col("block_noise_cv") > 0.7, F.when(F.col("caption_likely"), -2).otherwise(-7)).otherwise(5)
        + F.when(s >= 0.62, -12).when(s <= 0.28, 6).otherwise(0) + F.when(forensic >= 75, 5).when(forensic < 45, -8).otherwise(0)
    )
    return clamp(score, 0, 100).cast("int")


def metadata_evidence(tags: Column) -> Column:
    """status, ai_marker, editing_marker, camera, capture_fields and field_count of a map of tags; null is an empty map."""
    m = F.coalesce(tags, F.create_map().cast("map<string,string>"))
    values, keys = F.lower(F.array_join(F.map_values(m), " ")), F.transform(F.map_keys(m), lambda k: F.lower(k))
    first = lambda table: F.coalesce(*[F.when(F.contains(values, F.lit(k)), F.lit(v)) for k, v in table])
    ai, camera = first(AI_SOFTWARE), F.array_contains(keys, "make") | F.array_contains(keys, "model")
    status = F.when(ai.isNotNull(), "explicit_ai_software_tag").when(camera, "camera_metadata_present").when(F.size(m) > 0, "metadata_present").otherwise("metadata_absent")
    captured = F.array_sort(F.filter(F.map_keys(m), lambda k: F.lower(k).isin(CAPTURE_FIELDS)))
    return F.struct(status.alias("status"), ai.alias("ai_marker"), first(EDITING_SOFTWARE).alias("editing_marker"), camera.alias("camera"), captured.alias("capture_fields"), F.size(m).alias("field_count"))
