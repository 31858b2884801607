"""Column expressions on scores and labels. Fixed values are the vocabulary that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label sets.
AUTHENTIC = ["authentic", "real", "real_camera", "likely_authentic"]
GENERATED = ["generated", "ai_generated", "likely_ai_generated"]
MANIPULATED = ["manipulated", "ai_manipulated", "likely_ai_manipulated"]

Scalar = Column | str


def _c(x: Scalar) -> Column:
    return F.col(x) if isinstance(x, str) else x


def probability(x: Scalar) -> Column:
    """A finite number clamped to [0, 1]; null for text that is no number, for NaN and for infinities."""
    d = _c(x).try_cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))


def flag(x: Scalar) -> Column:
    """True for the texts 1, true and yes in any case."""
    return F.lower(F.trim(_c(x).cast("string"))).isin("1", "true", "yes")


def normalized_label(label: Scalar) -> Column:
    """authentic, manipulated, or generated for any other label."""
    return F.when(_c(label).isin(AUTHENTIC), "authentic").when(_c(label).isin(MANIPULATED), "manipulated").otherwise("generated")


def expected_verdict(normalized: Scalar) -> Column:
    n = _c(normalized)
    return F.when(n == "authentic", "likely_authentic").when(n == "generated", "likely_ai_generated").when(n == "manipulated", "likely_ai_manipulated")


def is_positive(label: Scalar, positives: list[str]) -> Column:
    """Null labels are not positive."""
    return F.coalesce(_c(label).isin(positives), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, the denominator 1 at least."""
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def clamp(x: Scalar, low: float, high: float) -> Column:
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _c(x))))


def logit(p: Scalar, clip: float = 1e-6) -> Column:
    q = clamp(p, clip, 1 - clip)
    return F.log(q / (1 - q))


def sigmoid(x: Scalar) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def softmax(values: Scalar) -> Column:
    """Softmax of an array, shifted by its maximum."""
    v = _c(values)
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def band(p: Scalar, upper: float, lower: float, names: tuple[str, str, str]) -> Column:
    """names[0] from upper on, names[2] up to lower, names[1] between; null stays null."""
    x = _c(p)
    return F.when(x >= upper, names[0]).when(x <= lower, names[2]).when(x.isNotNull(), names[1])


def score_confidence(p: Scalar) -> Column:
    return F.bround(2 * F.abs(_c(p) - 0.5), 3)


def clamp_score(x: Scalar) -> Column:
    """A whole score from 0 to 100, half to even."""
    return clamp(F.bround(_c(x)), 0, 100).cast("int")


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def three_way(score: Scalar, low: float, high: float) -> Column:
    return band(score, high, low, ("likely_ai", "inconclusive", "likely_authentic"))
