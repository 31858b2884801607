"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.quality import held_out
from attestra.llm.storage import written
from attestra.llm.text import small_slices
from attestra.shipping import ship_package

#: Character n-grams of these lengths, hashed to DIMS places.
ORDERS, DIMS = (1, 2, 3), 1 << 16
#: Rows that the fit may use: for each language, and in all. Those with the smallest id hashes are used.
ROWS_EACH, ROWS_ALL = 800, 4_000
#: Parts of a language in which its least id hashes are first found.
PARTS = 32
#: FTRL: learning rate, its smoothing, the two penalties, rounds over the rows.
ALPHA, BETA, L1, L2, ROUNDS = 0.5, 1.0, 0.02, 0.1, 3
#: Every so many rows are kept for the temperature.
CALIBRATION = 5
UNKNOWN = "und"


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of a whole text's n-grams; the text in lower case, white space as one mark."""
    chars = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    places = []
    for order in ORDERS:
        if len(chars) < order:
            continue
        h = np.full(len(chars) - order + 1, order, dtype=np.uint64)
        for j in range(order):
            h = (h ^ chars[j : len(chars) - order + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        places.append((h & np.uint64(DIMS - 1)).astype(np.int64))
    every = np.concatenate(places) if places else np.empty(0, dtype=np.int64)
    if len(every) < DIMS // 8:
        return np.unique(every, return_counts=True)
    c = np.bincount(every, minlength=DIMS)
    at = np.flatnonzero(c)
    return at, c[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the TF-IDF vector, of length 1; the term frequency by its logarithm."""
    at, c = counts(text)
    v = (1 + np.log(c)) * idf[at]
    return at, v / max(float(np.sqrt(v @ v)), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        at, v = vector(text, self.idf)
        p = softmax((v @ self.weights[at] + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS x classes) and bias by follow-the-regularised-leader with elastic-net penalties.

    z and n are the sums of the adjusted gradients and of their squares. A weight is 0 while |z| is at most L1, which
    keeps the model sparse; the bias is not penalised.
    """
    z, n = np.zeros((DIMS, classes)), np.zeros((DIMS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def leader(z, n, l1, l2):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))

    for r in range(ROUNDS):
        for i in np.random.default_rng(r).permutation(len(rows)):
            at, v = rows[i]
            za, na = z[at], n[at]
            w, b = leader(za, na, L1, L2), leader(zb, nb, 0.0, L2)
            g = softmax(v @ w + b)
            g[y[i]] -= 1
            grad = v[:, None] * g[None, :]
            z[at] = za + grad - (np.sqrt(na + grad**2) - np.sqrt(na)) / ALPHA * w
            n[at] = na + grad**2
            zb, nb = zb + g - (np.sqrt(nb + g**2) - np.sqrt(nb)) / ALPHA * b, nb + g**2
    return leader(z, n, L1, L2), leader(zb, nb, 0.0, L2)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in small_slices(whole, 2)):
        pairs = [counts(t.as_py() or "") for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([p[0] for p in pairs], pa.list_(pa.int64())), pa.array([p[1] for p in pairs], pa.list_(pa.int64()))],
            names=["id", "lang", "at", "times"],
        )


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from rows with a language and a letter; at most ROWS_EACH of a language and ROWS_ALL are used, whole texts.

    Which rows is settled by id hashes among the rows with a letter, in two steps, so that a language that most rows have is
    not ranked in one task: first the least hashes of each part of a language, then those of the language. Inverse document frequencies, weights and the
    temperature (smallest log loss on the rows kept for it) come from these rows. Without any row the model knows no
    language, and every text is `und`.
    """
    ship_package(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    order = lambda *keys: Window.partitionBy(*keys).orderBy(F.xxhash64("id"), "id")
    known = known.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS)))
    known = written(known.withColumn("rank", F.row_number().over(order("lang", "part"))).filter(F.col("rank") <= ROWS_EACH), "lang-least").drop("rank")
    chosen = known.withColumn("rank", F.row_number().over(order("lang"))).filter(F.col("rank") <= ROWS_EACH)
    chosen = written(chosen.orderBy("rank", "lang").limit(ROWS_ALL).groupBy("id").agg(F.min("lang").alias("lang")), "lang-sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    sample = texts.select("id", "lang", "text").mapInArrow(_count_rows, docs.select(F.col(id_col).alias("id")).schema.add("lang", "string").add("at", T.ArrayType(T.LongType())).add("times", T.ArrayType(T.LongType())))
    found = sample.toPandas().sort_values("id", ignore_index=True)
    languages = tuple(sorted(found["lang"].unique()))
    if not languages:
        return LanguageModel((), np.ones(DIMS), np.zeros((DIMS, 0)), np.zeros(0), 1.0)
    seen = np.zeros(DIMS)
    for at in found["at"]:
        seen[at] += 1
    idf = np.log((1 + len(found)) / (1 + seen)) + 1
    rows = []
    for at, times in zip(found["at"], found["times"], strict=True):
        v = (1 + np.log(times)) * idf[at]
        rows.append((np.asarray(at), v / max(float(np.sqrt(v @ v)), 1e-12)))
    y = np.array([languages.index(x) for x in found["lang"]])
    kept = np.arange(len(rows)) % CALIBRATION == 0 if len(rows) >= 10 * CALIBRATION else np.zeros(len(rows), dtype=bool)
    weights, bias = ftrl([r for r, k in zip(rows, kept, strict=True) if not k], y[~kept], len(languages))
    logits = np.array([v @ weights[at] + bias for (at, v), k in zip(rows, kept, strict=True) if k]).reshape(-1, len(languages))
    grid = np.exp(np.linspace(np.log(0.25), np.log(5), 60))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(logits)), y[kept]], 1e-12)).mean() if len(logits) else abs(np.log(t)) for t in grid]
    return LanguageModel(languages, idf.astype(np.float32), weights.astype(np.float32), bias.astype(np.float32), float(grid[int(np.argmin(loss))]))


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row, by its whole text alone. A null text, or one without a letter, is `und`, 0."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS * (languages + 1) floats

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (part for whole in batches for part in small_slices(whole, 1)):
            out = [m.predict(t.as_py()) if t.is_valid and m.languages else (UNKNOWN, 0.0) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[id_col, "lang_pred", "score"]
            )

    lettered = docs.select(id_col, F.when(F.col(text_col).rlike("\\p{L}"), F.col(text_col)).alias("text"))
    return lettered.mapInArrow(predict, docs.select(id_col).schema.add("lang_pred", "string").add("score", "double"))


def language_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score. The held-out fifth is not learnt from."""
    model = fit_language(docs.filter(~held_out()))
    return identify_language(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
