"""Readers and writers: explicit schemas, no inference; what cannot be read is dropped or refused by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.scores import flag, probability

MANIFEST_FIELDS = ["path", "sha256", "media_type", "class_label", "source", "license", "generator_or_editor", "parent_media", "transformation", "semantic_category", "source_group", "split"]
MANIFEST = T.StructType([T.StructField(f, T.StringType()) for f in MANIFEST_FIELDS])

# What an upload may be.
IMAGE_SUFFIXES, VIDEO_SUFFIXES = ["jpg", "jpeg", "png", "webp"], ["mp4", "mov", "webm", "avi", "mkv"]
IMAGE_BYTES, VIDEO_BYTES = 15 * 1024 * 1024, 80 * 1024 * 1024


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines if the path ends in .jsonl, else CSV with a header. Blank lines and values that are no object are dropped."""
    if path.endswith(".jsonl"):
        schema = T.StructType([*MANIFEST.fields, T.StructField("_corrupt_record", T.StringType())])
        rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
        return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record").filter(F.coalesce(*MANIFEST_FIELDS).isNotNull())
    return spark.read.schema(MANIFEST).option("header", True).option("enforceSchema", False).csv(path)


def prediction_rows(raw: DataFrame) -> DataFrame:
    """label in lower case, both scores as probabilities; rows without a label or a generation score are dropped."""
    out = raw.withColumns({"label": F.lower(F.trim("label")), "generation_score": probability("generation_score"), "manipulation_score": probability("manipulation_score")})
    return out.filter((F.coalesce("label", F.lit("")) != "") & F.col("generation_score").isNotNull())


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return prediction_rows(spark.read.option("header", True).csv(path))


def localizer_rows(raw: DataFrame) -> DataFrame:
    """Three numbers, two flags of text; a row with a number that cannot be read is dropped."""
    numbers = ["manipulation_score", "predicted_region_area_ratio", "view_score_range"]
    out = raw.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    return out.dropna(subset=numbers).withColumns({c: flag(c) for c in ("localized_or_persistent_support", "stable_across_views")})


def read_localizer_rows(spark: SparkSession, path: str) -> DataFrame:
    """localizer_rows of CSV files with a header."""
    return localizer_rows(spark.read.option("header", True).csv(path))


def load_feature_records(spark: SparkSession, path: str, schema: T.StructType | str, key: str = "source_id") -> DataFrame:
    """JSON lines of feature records; a key that occurs twice is an error."""
    return unique_records(spark.read.schema(schema).json(path), key)


def scan_corpus(spark: SparkSession, root: str, glob: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, split, label, length, modified) of files below root: split and label are the two folders above a file.

    Names and sizes alone are read; contents stay where they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    part = lambda i: F.try_element_at(F.split("path", "/"), F.lit(i))
    return files.select("path", part(-3).alias("split"), part(-2).alias("label"), "length", F.col("modificationTime").alias("modified"))


def image_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(path, height, width, channels) of the images below root that can be decoded."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(root).select("image.origin", "image.height", "image.width", "image.nChannels").toDF("path", "height", "width", "channels")


def upload_gate(name: Column, length: Column) -> Column:
    """Why an upload is refused: extension, empty or size; null if it is not."""
    suffix = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    image, video = suffix.isin(IMAGE_SUFFIXES), suffix.isin(VIDEO_SUFFIXES)
    return F.when(~(image | video), "extension").when(F.coalesce(length, F.lit(0)) <= 0, "empty").when((image & (length > IMAGE_BYTES)) | (video & (length > VIDEO_BYTES)), "size")


def merged_policy(defaults: DataFrame, override: DataFrame) -> DataFrame:
    """One row: each column of override where it has one and it is not null, else of defaults."""
    other = override.select(*[F.col(c).alias(f"_{c}") for c in override.columns]).limit(1)
    row = defaults.join(F.broadcast(other), F.lit(True), "left")
    return row.select(*[F.coalesce(f"_{c}", c).alias(c) if c in override.columns else F.col(c) for c in defaults.columns])


def merged_policies(defaults: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """One row for each row of overrides, named by its key: its columns where they are not null, else those of the one row
    of defaults."""
    own = [c for c in defaults.columns if c in overrides.columns]
    rows = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in own]).crossJoin(F.broadcast(defaults.limit(1)))
    return rows.select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in own else F.col(c) for c in defaults.columns])


def pending(inputs: DataFrame, done: DataFrame, key: str, config: str) -> DataFrame:
    """inputs that are not done; an error if anything was done under another configuration."""
    if done.filter(~F.col("config").eqNullSafe(F.lit(config))).limit(1).count():
        raise ValueError("finished rows have another configuration")
    return inputs.join(done.select(key).distinct().hint("merge"), key, "left_anti")


def unique_records(records: DataFrame, key: str) -> DataFrame:
    """records, if each key occurs once; else an error."""
    again = records.groupBy(key).count().filter("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{key} occurs more than once: {again[0][key]}")
    return records


# The arrays of path groups that an audit report has.
AUDIT_GROUPS = ["cross_split_exact_duplicates", "cross_split_normalized_pixel_duplicates", "cross_split_perceptual_hash_collisions", "cross_split_perceptual_near_matches"]


def audit_group_rows(reports: DataFrame, column: str = "body") -> DataFrame:
    """reports without the JSON text of a column, and a row for each path of each of its groups: kind, group and place (both from
    0), path (backslashes, lower case), split (the path's first part) and cross_split: whether the group's paths have more
    than one. A report without groups, or that is no JSON, has no rows; a group without paths has none."""
    schema = "struct<" + ", ".join(f"{k}: array<struct<paths: array<string>>>" for k in AUDIT_GROUPS) + ">"
    kept = [c for c in reports.columns if c != column]
    j = reports.select(*kept, F.from_json(column, schema).alias("j"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"j.{k}").alias("groups")) for k in AUDIT_GROUPS])
    groups = j.select(*kept, F.explode(kinds).alias("k")).select(*kept, "k.kind", F.posexplode("k.groups").alias("group", "g"))
    paths = groups.select(*kept, "kind", "group", F.transform("g.paths", lambda p: F.replace(p, F.lit("/"), F.lit("\\"))).alias("paths"))
    split = lambda p: F.substring_index(p, "\\", 1)
    cross = F.size(F.array_distinct(F.transform("paths", split))) > 1
    rows = paths.select(*kept, "kind", "group", cross.alias("cross_split"), F.posexplode("paths").alias("place", "p"))
    return rows.select(*kept, "kind", "group", "place", F.lower("p").alias("path"), split(F.col("p")).alias("split"), "cross_split")


def load_audit_groups(spark: SparkSession, path: str) -> DataFrame:
    """audit_group_rows of the report files below a path, one report a file."""
    return audit_group_rows(spark.read.text(path, wholetext=True).toDF("body"))


def without_audited(samples: DataFrame, groups: DataFrame, split: str) -> DataFrame:
    """samples of a split whose path (split first) is in no group of an audit that spans splits; case and slashes do not count."""
    bad = groups.filter(F.col("cross_split") & (F.col("split") == split)).select(F.col("path").alias("_bad")).distinct()
    own = F.lower(F.replace("path", F.lit("/"), F.lit("\\")))
    return samples.filter(F.col("split") == split).join(bad.hint("merge"), own == F.col("_bad"), "left_anti")


REGISTRY = "struct<registry_version: string, models: array<struct<id: string, task: string, role: string, license: string, enabled_by_default: boolean, integration_status: string, url: string>>>"


def registry_rows(bodies: DataFrame, column: str = "body") -> DataFrame:
    """A row for each model of JSON registries: bodies' other columns, registry_version, place, and the model's fields; models
    without an id are dropped. enabled_by_default is false where it is missing."""
    kept = [c for c in bodies.columns if c != column]
    j = bodies.select(*kept, F.from_json(column, REGISTRY).alias("j"))
    rows = j.select(*kept, "j.registry_version", F.posexplode("j.models").alias("place", "m")).filter("m.id IS NOT NULL")
    out = rows.select(*kept, "registry_version", "place", "m.*")
    return out.withColumn("enabled_by_default", F.coalesce("enabled_by_default", F.lit(False)))


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """registry_rows of the files below a path."""
    return registry_rows(spark.read.text(path, wholetext=True).toDF("body"))


def training_view(listing: DataFrame) -> DataFrame:
    """Files with the split that training may see: tuning as validation, calibration and locked_test never, an old test
    split only where there is no locked_test."""
    locked = listing.agg(F.coalesce(F.bool_or(F.col("split") == "locked_test"), F.lit(False)).alias("_locked"))
    out = listing.crossJoin(F.broadcast(locked))
    seen = F.when(F.col("split") == "tuning", "validation").when(F.col("split").isin("train", "validation"), F.col("split")).when((F.col("split") == "test") & ~F.col("_locked"), "test")
    return out.withColumn("training_split", seen).filter("training_split IS NOT NULL").drop("_locked")


def locked_guard(df: DataFrame, split: str, allow: bool = False) -> DataFrame:
    """Rows of a split; the locked one only on purpose."""
    if split == "locked_test" and not allow:
        raise PermissionError("the locked split is not read without allow=True")
    return df.filter(F.col("split") == split)


def class_presence(rows: DataFrame, positive: Column) -> DataFrame:
    """(split, positives, negatives, complete): whether a split has both classes."""
    n = rows.groupBy("split").agg(F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"))
    return n.withColumn("complete", (F.col("positives") > 0) & (F.col("negatives") > 0))


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order."""
    df.select(*sorted(df.columns)).write.json(path)


def write_manifest_csv(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """CSV in the order of split, label, source and path; the committer makes the folder appear whole."""
    order = [c for c in ("split", "class_label", "source", "path") if c in df.columns]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("header", True).csv(path)


def write_predictions_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV of predictions with the given columns, in the order of path; the committer makes the folder appear whole."""
    df.select(*(columns or df.columns)).repartitionByRange("path").sortWithinPartitions("path").write.option("header", True).csv(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON object with keys in order."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).coalesce(1).write.text(path)
