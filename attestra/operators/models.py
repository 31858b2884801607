"""Models on feature vectors: MLlib fits, linear heads, adapters for foreign models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.scores import softmax
from attestra.operators.calibration import best_threshold
from attestra.operators.evaluation import average_precision, brier_score, calibration_error, roc_auc
from attestra.operators.series import video_features
from attestra.operators.splits import class_weights
from attestra.shipping import ship_package

# Names of the class that stands for generated media.
POSITIVE_CLASSES = ("1", "ai_generated", "synthetic", "fake")

#: The least rows of a partition of a fit: with fewer, the tasks of its many short jobs cost more than they save.
PART_ROWS = 20_000


def feature_inventory(records: DataFrame, excluded: list[str]) -> DataFrame:
    """One row: the sorted union of the feature maps' keys less the excluded ones, and the records' sampling policy, `mixed`
    where they have several. A missing policy is none."""
    names = records.select(F.explode(F.map_keys("features")).alias("name")).filter(~F.col("name").isin(excluded)).distinct()
    policy = records.agg(F.when(F.min("sampling_policy") == F.max("sampling_policy"), F.min("sampling_policy")).when(F.count("sampling_policy") > 0, "mixed").alias("sampling_policy"))
    return names.agg(F.array_sort(F.collect_list("name")).alias("names")).crossJoin(F.broadcast(policy))


def feature_matrix(records: DataFrame, names: list[str]) -> DataFrame:
    """records with one column for each name, 0 where a map has none."""
    return records.select("*", *[F.coalesce(F.try_element_at("features", F.lit(n)).cast("double"), F.lit(0.0)).alias(n) for n in names])


def linear_head_score(vector: Column, weights: list[float], bias: float) -> Column:
    """The logistic of weights . vector + bias."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    dot = F.aggregate(F.zip_with(vector, w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-(dot + bias)))


def head_probabilities(vector: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """Softmax over several heads."""
    heads = [F.aggregate(F.zip_with(vector, F.array(*[F.lit(float(x)) for x in w]), lambda x, y: x.cast("double") * y), F.lit(float(b)), lambda a, x: a + x) for w, b in zip(weights, bias, strict=True)]
    return softmax(F.array(*heads))


def candidates(seed: int = 7) -> dict[str, list]:
    scaled = [StandardScaler(inputCol="v", outputCol="x", withMean=True)]
    return {
        "logistic": [*scaled, LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=0.01)],
        "forest": [RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="weight", numTrees=40, maxDepth=6, seed=seed)],
        "deep_forest": [RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="weight", numTrees=40, maxDepth=10, seed=seed)],
        "boosting": [GBTClassifier(featuresCol="v", labelCol="y", weightCol="weight", maxIter=20, maxDepth=3, seed=seed)],
    }


def selection_score(kind: str = "temporal") -> Column:
    """What candidates are chosen by. temporal: over balanced_accuracy, auc, brier_score and ece; frame_head: over the first
    three; localizer: over average_precision, f1 and safe_recall."""
    c = F.col
    forms = {
        "temporal": lambda: c("balanced_accuracy") + 0.08 * c("auc") - 0.05 * c("brier_score") - 0.03 * c("ece"),
        "frame_head": lambda: c("balanced_accuracy") + 0.08 * c("auc") - 0.04 * c("brier_score"),
        "localizer": lambda: 0.45 * c("average_precision") + 0.20 * c("f1") + 0.35 * c("safe_recall"),
    }
    return forms[kind]()


def selection_scores(scored: DataFrame, kind: str = "temporal") -> DataFrame:
    """One row: threshold, balanced accuracy, AUC, average precision, Brier score, ECE, and the score that models are chosen by.
    scored: (s, y)."""
    labelled = scored.select("s", F.when(F.col("y"), "generated").otherwise("authentic").alias("label"))
    parts = [best_threshold(scored), roc_auc(labelled, "s", ["generated"]), average_precision(labelled, "s", ["generated"]), brier_score(labelled, "s", ["generated"]), calibration_error(labelled, "s", ["generated"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out.withColumn("selection_score", selection_score(kind))


def _scored_models(rows: DataFrame, estimators: dict[str, Estimator]) -> DataFrame:
    """selection_scores of each estimator, fitted on train rows and scored on validation rows, best first: one row each, so
    they are made at once. Validation rows are scored once for all measures."""
    train, validation = class_weights(rows.filter("split = 'train'"), "y"), rows.filter("split = 'validation'")
    found, schema = [], None
    for name, estimator in estimators.items():
        model = estimator.fit(train)
        scored = model.transform(validation).select(vector_to_array("probability")[1].alias("s"), (F.col("y") == 1).alias("y")).persist()
        one = selection_scores(scored).withColumn("model", F.lit(name))
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in one.schema])
        found.append(one.first())
        scored.unpersist()
    return leaderboard(rows.sparkSession.createDataFrame(found, schema))


def fit_candidates(rows: DataFrame, features: list[str], seed: int = 7) -> DataFrame:
    """(model, threshold, balanced_accuracy, auc, ...): each candidate, fitted on train rows and scored on validation rows,
    best first. rows: features, y (0 or 1), split. Rows are dealt out to the cores, PART_ROWS or more to each, since a file
    of many such rows can be one partition."""
    assembler = VectorAssembler(inputCols=features, outputCol="v", handleInvalid="keep")
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // PART_ROWS)
    dealt = rows.repartition(max(1, parts), *features).persist()
    out = _scored_models(dealt, {name: Pipeline(stages=[assembler, *stages]) for name, stages in candidates(seed).items()})
    dealt.unpersist()
    return out


def leaderboard(scores: DataFrame) -> DataFrame:
    """Best selection score first, then the threshold nearest to 0.5."""
    return scores.orderBy(F.desc("selection_score"), F.abs(F.col("threshold") - 0.5), "model")


def fit_head(rows: DataFrame, vector: str, grid: tuple[float, ...] = (0.01, 0.1, 1.0)) -> DataFrame:
    """The same for regularised logistic heads on an array column."""
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return _scored_models(data, {f"head_{reg}": LogisticRegression(featuresCol="v", labelCol="y", weightCol="weight", regParam=reg, maxIter=40) for reg in grid})


@dataclass(frozen=True)
class FeatureBundle:
    """A model on named features. predict takes a matrix with the columns of names, in their order, and gives a row of class
    probabilities for each of its rows; model_names are the names in the order that the model was fitted on, if it says."""

    names: tuple[str, ...]
    predict: Callable[[np.ndarray], np.ndarray]
    classes: tuple[str, ...] = ("0", "1")
    threshold: float = 0.5
    model_version: str = "unversioned"
    calibration_id: str = "uncalibrated"
    sampling_policy: str = "uniform"
    model_names: tuple[str, ...] | None = None

    def positive(self) -> int:
        """The class that stands for generated media: the first of its known names, else the last class."""
        return next((i for i, c in enumerate(self.classes) if str(c).lower() in POSITIVE_CLASSES), len(self.classes) - 1)


MODEL_RESULT = "name string, status string, label string, score double, threshold double, model_version string, calibration_id string, feature_count int, reason string"


def feature_model(rows: DataFrame, bundle: FeatureBundle, key: str, features: str = "features", name: str = "feature_model") -> DataFrame:
    """(key, name, status, label, score, ...): a bundle's score of each row's map of features; a missing feature is 0.

    The bundle, which must be picklable, is broadcast once; batches go to it as one matrix. A bundle whose column order differs from its model's, or
    that fails or gives another shape, makes `unavailable` rows with the reason; no row is lost and none raises.
    """
    ship_package(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(bundle)
    vector = F.array(*[F.coalesce(F.try_element_at(features, F.lit(n)).cast("double"), F.lit(0.0)) for n in bundle.names]).cast("array<double>")
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string(MODEL_RESULT)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = shared.value
        wrong = None if b.model_names is None or tuple(b.model_names) == tuple(b.names) else "the bundle's names are not in the model's order"
        for batch in batches:
            s, reason = None, wrong
            if reason is None:
                try:
                    p = np.asarray(b.predict(np.array(batch["_vector"].tolist(), dtype=np.float64).reshape(len(batch), len(b.names))))
                    if p.shape != (len(batch), len(b.classes)):
                        raise ValueError(f"probabilities of shape {p.shape} for {len(batch)} rows and {len(b.classes)} classes")
                    s = p[:, b.positive()].astype(np.float64)
                except Exception as e:
                    reason = str(e)[:300]
            out = pd.DataFrame({key: batch[key], "name": name, "status": "unavailable" if s is None else "completed"})
            out["label"] = None if s is None else np.where(s >= b.threshold, "likely_generated", "lower_signal")
            out["score"] = np.nan if s is None else s
            out["threshold"], out["model_version"], out["calibration_id"], out["feature_count"], out["reason"] = b.threshold, b.model_version, b.calibration_id, len(b.names), reason
            yield out

    out = rows.select(key, vector.alias("_vector")).mapInPandas(run, schema)
    return out.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))


def head_scores(frames: DataFrame, weights: list[list[float]], bias: list[float], positive: int, vector: str = "embedding", name: str = "ai_probability") -> DataFrame:
    """frames without the vector and with the softmax probability of one class under a linear head: one matrix product for each
    Arrow batch. A missing vector, or one of another length, has none."""
    shared = frames.sparkSession.sparkContext.broadcast((np.asarray(weights, dtype=np.float64), np.asarray(bias, dtype=np.float64)))
    kept = [c for c in frames.columns if c != vector]
    schema = T.StructType([*[f for f in frames.schema if f.name != vector and f.name != name], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            rows = [v if v is not None and len(v) == w.shape[1] and None not in v else None for v in batch.column(batch.num_columns - 1).to_pylist()]
            p = np.full(len(rows), np.nan)
            good = [i for i, v in enumerate(rows) if v is not None]
            if good:
                z = np.array([rows[i] for i in good], dtype=np.float64) @ w.T + b
                e = np.exp(z - z.max(axis=1, keepdims=True))
                p[good] = (e / e.sum(axis=1, keepdims=True))[:, positive]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, mask=np.isnan(p))], names=[f.name for f in schema])

    return frames.select(*[c for c in kept if c != name], vector).mapInArrow(run, schema)


def features_from_cached_frames(frames: DataFrame, weights: list[list[float]], bias: list[float], positive: int = 1) -> DataFrame:
    """(video_id, split, label, source, features): video features of cached frames, whose scores a linear head gives to their
    embeddings. frames: path (split/label/..._frame_number.ext), embedding, and the measured columns of a frame series.

    Frames of a split, label and source are a series, in the order of their numbers. Scores of still-image checks are not in
    a cache, so they are held neutral: truth 50, pixel probability 0.5.
    """
    name = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    parts = F.split("path", "/")
    keyed = frames.select(
        "*",
        F.get(parts, F.lit(0)).alias("split"), F.get(parts, F.lit(1)).alias("label"), F.regexp_extract(name, r"^(.*?)(?:_frame_.*)?$", 1).alias("source"),
        F.coalesce(F.regexp_extract(name, r"_frame_([0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("frame_index"),
    )
    scored = head_scores(keyed, weights, bias, positive).withColumns({"truth_score": F.lit(50.0), "pixel_probability": F.lit(0.5), "video_id": F.concat_ws("/", "split", "label", "source")})
    out = video_features(scored)
    names = [c for c in out.columns if c not in ("video_id", "frames")]
    pieces = F.split("video_id", "/")
    return out.select(
        "video_id", pieces[0].alias("split"), pieces[1].alias("label"), pieces[2].alias("source"), "frames",
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names])).alias("features"),
    )


def detector_adapter(media: DataFrame, load: Callable[[], object], predict: Callable[[object, pd.Series], pd.Series], name: str, column: str) -> DataFrame:
    """(media_id, name, status, score, error): a foreign model over a column, loaded once for each task. A model that cannot
    be loaded gives `unavailable` rows, one that fails on a batch `error` rows; no row is lost and none raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model, problem = load(), None
        except Exception as e:
            model, problem = None, str(e)
        for b in batches:
            out = pd.DataFrame({"media_id": b["media_id"], "name": name, "status": "unavailable", "score": float("nan"), "error": problem})
            if problem is None:
                try:
                    out["score"], out["status"] = predict(model, b[column]).astype("float64").to_numpy(), "completed"
                except Exception as e:
                    out["status"], out["error"] = "error", str(e)
            yield out

    return media.select("media_id", column).mapInPandas(run, "media_id long, name string, status string, score double, error string").withColumn("score", F.nanvl("score", F.lit(None).cast("double")))
