"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.storage import without_keys, written
from attestra.llm.text import small_slices
from attestra.shipping import ship_package

#: Labelled rows that the fit may use; of more, those with the smallest id hashes are used.
SAMPLE_ROWS = 20_000
#: Pairs for each row of the larger class.
PAIRS = 6
#: The score that stands for the quantile at which texts are cut.
CUT = 0.3
CACHE = 50_000
FEATURE_COLUMN = "quality_features"

FEATURES = (
    "symbol_share", "shouted_share", "decorated_share", "digit_share", "pipe_share", "distinct_words", "distinct_trigrams",
    "stutter_share", "repeated_lines", "word_length", "long_share", "log_words",
)

_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~!")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(b"|")] = 3


class WordMarks(dict):
    """word -> hash in the upper 48 bits, then its length up to 255, then marks: 1 all upper case, 2 ends in symbols."""

    def __missing__(self, word: bytes) -> int:
        letters = word.decode("utf-8", "replace")
        shouted = sum(map(str.isalpha, letters)) >= 2 and letters.isupper()
        decorated = _CLASS[word[-1]] in (1, 3)
        h = (xxhash.xxh3_64_intdigest(word) & ~0xFFFF) | min(len(letters), 255) << 8 | shouted | decorated << 1
        if len(self) < CACHE:
            self[word] = h
        return h


def features(text: str | None, marks: WordMarks) -> list[float]:
    """FEATURES of a whole text. Shares of nothing are those of a plain text: 0, or 1 for the distinct ones."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    kinds = np.bincount(_CLASS[np.frombuffer(raw, dtype=np.uint8)], minlength=4) / len(raw)
    w = np.fromiter(map(marks.__getitem__, words), dtype=np.uint64, count=len(words))
    n, length = len(w), ((w >> np.uint64(8)) & np.uint64(255)).astype(np.float64)
    tri = np.unique(w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]) if n > 2 else w[:0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(kinds[1] + kinds[3]),
        float(np.mean(w & np.uint64(1))),
        float(np.mean((w >> np.uint64(1)) & np.uint64(1))),
        float(kinds[2]),
        float(kinds[3]),
        len(np.unique(w)) / n / (1 - 0.055 * min(np.log(n), 9)),  # a plain text's words repeat the more, the longer it is
        len(tri) / (n - 2) if n > 2 else 1.0,
        float(np.mean(w[1:] == w[:-1])) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(length.mean()) / 10,
        float(np.mean(length > 20)),
        float(np.log(n)) / 10,
    ]


def _with_features(text_at: int):
    """Adds the features of the text in column text_at as the last column."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = WordMarks()
        for batch in (part for whole in batches for part in small_slices(whole, text_at)):
            f = pa.array([features(t.as_py(), marks) for t in batch.column(text_at)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, f], names=[*batch.schema.names, FEATURE_COLUMN])

    return add


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with an array of FEATURES in FEATURE_COLUMN."""
    ship_package(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(FEATURE_COLUMN, T.ArrayType(T.DoubleType()))])
    return docs.mapInArrow(_with_features(docs.columns.index(text_col)), schema)


@dataclass(frozen=True)
class QualityModel:
    """score = sigmoid(weights . (features - center) / scale - cut + logit(CUT)); quantile: the share of the sample below the cut."""

    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    cut: float
    quantile: float

    def strength(self, column: str) -> Column:
        parts = [(F.element_at(column, i + 1) - float(c)) * float(w / s) for i, (w, c, s) in enumerate(zip(self.weights, self.center, self.scale, strict=True))]
        return sum(parts[1:], parts[0])

    def score(self, column: str) -> Column:
        shift = float(np.log(CUT / (1 - CUT)))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), self.strength(column) - self.cut + shift))))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learns from rows of labels (id_col, quality 0 or 1), of which at most `rows` are used.

    Rows of both classes are paired; the logistic loss is on the difference of a pair's features, with no intercept,
    so what is learnt is each feature's part in a text's strength. The cut is the quantile of the sample's strengths
    that splits the classes best (balanced accuracy; the middle, where several do). Without both classes all
    strengths are 0 and nothing is below the cut. A null label is no label. Of a repeated id the lowest label and the
    first text in order are used.
    """
    marked = labels.filter("quality IN (0, 1)").groupBy(F.col(id_col).alias("quality_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    marked = written(marked.orderBy(F.xxhash64("quality_id"), "quality_id").limit(rows), "quality-sample")
    texts = docs.select(F.col(id_col).alias("quality_id"), F.col(text_col).alias("quality_text"))
    sample = texts.join(F.broadcast(marked), "quality_id").groupBy("quality_id", "quality").agg(F.min("quality_text").alias("quality_text"))
    sample = written(with_features(sample, "quality_text").select("quality_id", "quality", FEATURE_COLUMN), "quality-features")

    found = sample.toPandas().sort_values("quality_id")
    x, y = np.array(found[FEATURE_COLUMN].tolist(), dtype=np.float64).reshape(len(found), len(FEATURES)), found["quality"].to_numpy()
    dims = len(FEATURES)
    if not 0 < y.sum() < len(y):
        return QualityModel((0.0,) * dims, (0.0,) * dims, (1.0,) * dims, 0.0, 0.0)
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    spark, n_good, n_bad = docs.sparkSession, int(y.sum()), int((1 - y).sum())
    z = (x - center) / scale
    side = lambda good, key: spark.createDataFrame(
        [(i, [float(v) for v in r]) for i, r in enumerate(z[y == good])], f"{key} long, {key}_features array<double>"
    )
    pairs = spark.range(PAIRS * max(n_good, n_bad), numPartitions=8).select(
        "id", (F.col("id") % n_good).alias("good"), ((F.col("id") * 7919 + F.floor(F.col("id") / n_bad)) % n_bad).alias("bad")
    )
    pairs = pairs.join(F.broadcast(side(1, "good")), "good").join(F.broadcast(side(0, "bad")), "bad")
    first = F.col("id") % 2 == 0  # half of the pairs are turned round, so that both outcomes occur
    pairs = pairs.select(
        F.when(first, 1.0).otherwise(0.0).alias("label"),
        array_to_vector(F.zip_with("good_features", "bad_features", lambda g, b: F.when(first, g - b).otherwise(b - g))).alias("features"),
    )
    lr = LogisticRegression(fitIntercept=False, standardization=False, regParam=0.003, maxIter=60)
    weights = lr.fit(pairs).coefficients.toArray()
    strength = z @ weights
    order = np.argsort(strength)
    s, good = strength[order], y[order]
    below = (np.cumsum(1 - good) / n_bad + 1 - np.cumsum(good) / n_good) / 2
    best = np.flatnonzero(below >= below.max() - 1e-12)
    at = best[len(best) // 2]
    cut = float((s[at] + s[min(at + 1, len(s) - 1)]) / 2)
    return QualityModel(tuple(map(float, weights)), tuple(map(float, center)), tuple(map(float, scale)), cut, float((at + 1) / len(s)))


def scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, score, predicted) of each row, by its text alone; mark is a hash of the text, which names the row with
    the id. Nothing but these three columns meets Python.

    Null and empty texts are scored as a text without words; equal texts get equal scores.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    scored = with_features(rows).select("doc_id", "mark", model.score(FEATURE_COLUMN).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of the ids that no model here learns from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted. The held-out fifth's labels are not learnt from."""
    model = fit_quality(docs, labels.filter(~held_out()))
    return scores(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that the classifier rejects, all columns, whatever their names. Rows are scored by id and text hash,
    then the rejected ones are dropped by these keys. id_col names the ids of docs and of labels."""
    model = fit_quality(docs, labels.filter(~held_out(id_col)), id_col, text_col)
    bad = scores(docs, model, id_col, text_col).filter("predicted = 0").select("doc_id", "mark")
    return without_keys(docs, [F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))], bad)
