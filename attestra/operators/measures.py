"""Measures of groups, boxes, labels and maps that other operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of class names. Real ones win over synthetic ones.
SYNTHETIC_MARKERS = ["fake", "ai generated", "generated", "synthetic", "artificial", "deepfake", "sdxl", "diffusion"]
REAL_MARKERS = ["real", "authentic", "natural", "camera", "human", "not ai", "non ai", "photograph"]
EDIT_MARKERS = ["edited", "manipulated", "tampered", "inpaint", "face swap", "faceswap", "retouched", "composited"]


def group_entropy(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, entropy) in bits of the values of each group."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    total = n.groupBy(key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("weighted"))
    return total.select(key, (F.log2(F.col("total").cast("double")) - F.col("weighted") / F.col("total")).alias("entropy"))


def pair_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: corr_<a>_<b> of each pair, 0 where a column is constant."""
    def one(a: str, b: str) -> Column:
        flat = (F.stddev_pop(a) < 1e-6) | (F.stddev_pop(b) < 1e-6)
        return F.when(flat, 0.0).otherwise(F.corr(a, b)).alias(f"corr_{a}_{b}")

    return df.agg(*[one(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]])


def extreme_share(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    v = F.col(value)
    return df.agg(F.avg((v <= low).cast("double")).alias("low_share"), F.avg((v >= high).cast("double")).alias("high_share"))


def normalized_class(label: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(label, r"[_\-/.]+", " ")))


def _marked(label: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(label, F.lit(m))
    return found


def outputs_normalize(outputs: Column) -> Column:
    """Class outputs (label, score) without negative and infinite scores, highest first, then by label."""
    kept = F.filter(outputs, lambda o: o["score"].isNotNull() & ~F.isnan(o["score"]) & (o["score"] >= 0) & (o["score"] < float("inf")))
    return F.transform(F.array_sort(F.transform(kept, lambda o: F.struct((-o["score"]).alias("neg"), o["label"].alias("label")))), lambda o: F.struct(o["label"].alias("label"), (-o["neg"]).alias("score")))


def class_mass(outputs: Column) -> Column:
    """Synthetic mass / (synthetic + real mass); other classes do not count; null without any."""
    total = lambda keep: F.aggregate(F.filter(outputs, lambda o: keep(normalized_class(o["label"]))), F.lit(0.0), lambda a, o: a + o["score"])
    real, synthetic = total(lambda x: _marked(x, REAL_MARKERS)), total(lambda x: ~_marked(x, REAL_MARKERS) & _marked(x, SYNTHETIC_MARKERS))
    return F.when(synthetic + real > 0, synthetic / F.nullif(synthetic + real, F.lit(0.0)))


def manipulation_mass(outputs: Column) -> Column:
    """Mass of the editing classes / all mass; null if there is no editing class."""
    total = F.aggregate(outputs, F.lit(0.0), lambda a, o: a + o["score"])
    edits = F.filter(outputs, lambda o: _marked(normalized_class(o["label"]), EDIT_MARKERS))
    return F.when(F.size(edits) > 0, F.aggregate(edits, F.lit(0.0), lambda a, o: a + o["score"]) / F.nullif(total, F.lit(0.0)))


def tile_starts(length: Column, size: int, overlap: float) -> Column:
    """Where tiles of `size` begin so that they cover `length`, the last one flush with its end."""
    step = max(1, int(size * (1 - min(0.45, max(0.0, overlap)))))
    last = F.greatest(F.lit(0), length - size)
    return F.array_sort(F.array_distinct(F.array_append(F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda x: x <= last), last)))


def tile_grid(images: DataFrame, size: int = 512, overlap: float = 0.25) -> DataFrame:
    """(media_id, left, top, right, bottom) of covering tiles."""
    xs = images.withColumn("left", F.explode(tile_starts(F.col("width"), size, overlap)))
    both = xs.withColumn("top", F.explode(tile_starts(F.col("height"), size, overlap)))
    return both.select("media_id", "left", "top", F.least(F.col("left") + size, "width").alias("right"), F.least(F.col("top") + size, "height").alias("bottom"))


def scale_box(box: Column, resolution: float, width: Column, height: Column) -> Column:
    at = lambda i, side: F.bround(F.get(box, i) * side / resolution).cast("int")
    return F.array(at(0, width), at(1, height), at(2, width), at(3, height))


def expand_box(box: Column, pad: Column, width: Column, height: Column) -> Column:
    """A box (left, top, right, bottom) with pad on each side, within the image."""
    at = lambda i, sign, limit: F.greatest(F.lit(0), F.least(limit, F.get(box, i) + sign * pad)).cast("int")
    return F.array(at(0, -1, width), at(1, -1, height), at(2, 1, width), at(3, 1, height))


def iou(a: Column, b: Column) -> Column:
    g = F.get
    w = F.greatest(F.lit(0), F.least(g(a, 2), g(b, 2)) - F.greatest(g(a, 0), g(b, 0)))
    h = F.greatest(F.lit(0), F.least(g(a, 3), g(b, 3)) - F.greatest(g(a, 1), g(b, 1)))
    area = lambda x: (g(x, 2) - g(x, 0)) * (g(x, 3) - g(x, 1))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / F.nullif(union, F.lit(0))).otherwise(0.0)


def overlap_metrics(counts: DataFrame) -> DataFrame:
    """One row: micro precision, recall, F1 and IoU from rows (tp, fp, fn)."""
    s = counts.agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn")])
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tp, tp + fp + fn).alias("iou"))


def path_keys(path: Column) -> dict[str, Column]:
    """Columns from a path: file stem, slug, number at the end of the stem, the stem without a clip suffix."""
    stem = F.regexp_extract(path, r"([^/\\]*?)(?:\.[A-Za-z0-9]+)?$", 1)
    return {
        "stem": stem,
        "slug": F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), F.lit("-")),
        "number": F.expr("1") * F.regexp_extract(stem, "([0-9]+)$", 1).try_cast("long"),
        "source_group": F.regexp_replace(F.lower(stem), r"_[0-9]+_[0-9]+to[0-9]+$", ""),
    }
