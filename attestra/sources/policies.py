"""Decision policies as nested JSON: merged over defaults at any depth, read out by path."""

from __future__ import annotations

import json
from collections.abc import Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.shipping import ship_package

# The policy that holds where a file says nothing.
DEFAULT_POLICY = {
    "policy_version": "media-policy-v4.0.0",
    "calibration_id": "bootstrap-conservative-v4",
    "generation": {"lower_threshold": 0.15, "upper_threshold": 0.95, "enabled": True},
    "manipulation": {"lower_threshold": 0.15, "upper_threshold": 0.95, "enabled": True},
    "stability": {"max_view_score_range": 0.18, "max_window_score_range": 0.30},
    "quality": {"minimum_short_side": 224, "minimum_video_frames": 8},
    "requirements": {"generation_for_decisive_verdict": True, "manipulation_for_authentic_verdict": True},
}

#: The columns that decisions use: where each stands in a policy, and its type.
POLICY_PATHS = {
    "generation_lower": ("$.generation.lower_threshold", "double"),
    "generation_upper": ("$.generation.upper_threshold", "double"),
    "generation_enabled": ("$.generation.enabled", "boolean"),
    "manipulation_lower": ("$.manipulation.lower_threshold", "double"),
    "manipulation_upper": ("$.manipulation.upper_threshold", "double"),
    "manipulation_enabled": ("$.manipulation.enabled", "boolean"),
    "max_view_range": ("$.stability.max_view_score_range", "double"),
    "max_window_range": ("$.stability.max_window_score_range", "double"),
    "minimum_short_side": ("$.quality.minimum_short_side", "int"),
    "minimum_frames": ("$.quality.minimum_video_frames", "int"),
    "generation_required": ("$.requirements.generation_for_decisive_verdict", "boolean"),
    "manipulation_required": ("$.requirements.manipulation_for_authentic_verdict", "boolean"),
}


def deep_merge(base: Mapping, update: Mapping) -> dict:
    """base with update's values; where both have an object, these are merged. A null in update replaces."""
    out = dict(base)
    for key, value in update.items():
        out[key] = deep_merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def merged_json(override: Column, defaults: Mapping = DEFAULT_POLICY) -> Column:
    """The policy of a JSON text as JSON with sorted keys: merged over the defaults, which alone hold for null, for what cannot be
    read and for what is no object."""

    @F.pandas_udf("string")
    def merge(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str:
            try:
                value = json.loads(text) if text is not None else {}
            except ValueError:
                value = {}
            return json.dumps(deep_merge(defaults, value if isinstance(value, dict) else {}), sort_keys=True)

        return texts.map(one, na_action=None)

    return merge(override)


def policy_columns(policies: DataFrame, column: str = "policy") -> DataFrame:
    """policies with the decision columns of a JSON policy; one that is missing or has another type is null."""
    v = F.try_parse_json(column)
    return policies.withColumns({name: F.try_variant_get(v, path, kind) for name, (path, kind) in POLICY_PATHS.items()})


def merged_policy_table(overrides: DataFrame, column: str, defaults: Mapping = DEFAULT_POLICY) -> DataFrame:
    """overrides with policy, the merged JSON, and its decision columns; one row for each row."""
    ship_package(overrides.sparkSession)
    return policy_columns(overrides.withColumn("policy", merged_json(F.col(column), defaults)))


def load_policy(spark: SparkSession, path: str | None, defaults: Mapping = DEFAULT_POLICY) -> DataFrame:
    """One row: policy, and its decision columns. A file that is missing or cannot be read leaves the defaults."""
    rows = spark.createDataFrame([(None,)], "value string")
    if path:
        try:
            rows = spark.read.text(path, wholetext=True).select("value").limit(1).unionByName(rows).limit(1)
        except AnalysisException:
            pass
    return merged_policy_table(rows, "value", defaults).drop("value")


def configured_models(configured: str | None, packaged: list[str], keep_packaged: bool = False) -> list[str]:
    """Model names of a comma-separated setting, first-seen distinct; the packaged ones where it is empty, and before the
    configured ones if keep_packaged."""
    names = [x.strip() for x in (configured or "").split(",") if x.strip()]
    return list(dict.fromkeys([*packaged, *names] if keep_packaged and names else names or packaged))


def configured_model_lists(rows: DataFrame, configured: str, packaged: str, keep_packaged: bool = False) -> Column:
    """The same for columns: a text, and an array of packaged names."""
    names = F.filter(F.transform(F.split(F.coalesce(F.col(configured), F.lit("")), ","), lambda x: F.btrim(x)), lambda x: x != "")
    both = F.concat(packaged, names) if keep_packaged else names
    return F.array_distinct(F.when(F.size(names) == 0, F.col(packaged)).otherwise(both))
