"""Periodic runs of words: suffix classes united by falling common prefix, newly adjacent places seed the runs."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.text import small_slices
from attestra.shipping import ship_package

#: Least length of a run in words, and in periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Two suffixes that begin a run one period apart share at least so many words: 6 - 1, 8 - 2, and 3 * q from q = 3 on.
MIN_SHARED = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)

RUN = "start: long, length: long, period: long"

Spoil = Callable[[int | None, int], np.ndarray | None]


def suspects(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which documents of a slice may have a run; ids holds their words one after the other, ends where each of them ends.

    A run needs a stretch of MIN_SHARED words that comes again no further off than the match is long. Places whose
    stretch comes again bound a match's length from above, so a document that is not named has no run; one that is may
    have none.
    """
    n = len(ids) - MIN_SHARED + 1
    if n < 2:
        return np.empty(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[:n]
    h = doc.astype(np.uint64)
    for j in range(MIN_SHARED):
        h = (h ^ ids[j : n + j].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(np.arange(n) + MIN_SHARED <= ends[doc])
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    first, second = order[:-1][same], order[1:][same]
    stop = np.arange(n + 1)
    stop[first] = stop[second] = n + 1
    stop[n] = n
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    return np.unique(doc[first[second - first <= stop[first] - first + MIN_SHARED - 1]])


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their words, by doubling, and each suffix's place in that order."""
    n, k = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        if rank[order[-1]] == n - 1 or 2 * k > n:
            return order, rank
        k *= 2


def shared_prefixes(words: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Of each suffix in order, how many words it shares with the one before it."""
    n, h, out = len(words), 0, [0] * len(words)
    for i in range(n):
        if not rank[i]:
            h = 0
            continue
        j = order[rank[i] - 1]
        most = n - max(i, j)
        while h < most and words[i + h] == words[j + h]:
            h += 1
        out[rank[i]] = h
        h = max(h - 1, 0)
    return out


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word ids, by start, then period.

    Pairs of neighbours in suffix order are taken by falling shared prefix, and the ordered sets of places that they
    join are united, the smaller into the larger. Two places that become neighbours by that share exactly that prefix.
    If it is no shorter than their distance, the words are periodic from the first of them on, and the distance is the
    smallest period, since a smaller one would have put a place between them. A run is reported at the pair that
    begins it, so once.
    """
    order, rank = suffix_order(ids)
    words, order = ids.tolist(), order.tolist()
    shared = np.array(shared_prefixes(words, order, rank.tolist()))
    pairs = np.flatnonzero(shared >= MIN_SHARED)
    pairs = pairs[np.argsort(-shared[pairs], kind="stable")]
    above, places, found = list(range(len(ids))), {}, []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    def seed(x: int, y: int, level: int) -> None:
        d = y - x
        length = d + level
        if length >= max(MIN_WORDS, MIN_PERIODS * d) and (x == 0 or words[x - 1] != words[y - 1]):
            found.append((x, length, d))

    for r, level in zip(pairs.tolist(), shared[pairs].tolist(), strict=True):
        a, b = top(order[r - 1]), top(order[r])
        large, small = places.pop(a, None) or [a], places.pop(b, None) or [b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        above[b] = a
        if len(small) * 16 > len(large):
            large = sorted(large + small)
        else:
            for x in small:
                insort(large, x)
        places[a] = large
        own = set(small)
        for x in small:
            i = bisect_left(large, x)
            if i and large[i - 1] not in own:
                seed(large[i - 1], x, level)
            if i + 1 < len(large) and large[i + 1] not in own:
                seed(x, large[i + 1], level)
    return sorted(found, key=lambda x: (x[0], x[2]))


def kept_places(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """The words that no run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.flatnonzero(np.cumsum(edge[:n]) == 0)


def periodic_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """The damage that the query does: of one document in ten (by its id), the words from some place on repeat the first few of
    them; the word that each place gets, or None if nothing changes. A null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _documents(batch: pa.RecordBatch, spoil: Spoil | None) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each row (id, text). Words are split at ASCII white space, as bytes.split() does."""
    seen: dict[bytes, int] = {}
    texts, every = [], []
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []
        if spoil and (at := spoil(doc_id.as_py(), len(words))) is not None:
            words = [words[i] for i in at.tolist()]
        texts.append(words)
        every.append(np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64))
    ends = np.cumsum([len(x) for x in every])
    maybe = set(suspects(np.concatenate(every), ends).tolist())
    for i, words in enumerate(texts):
        yield words, runs_of(every[i]) if i in maybe else []


def _mapped(docs: DataFrame, id_col: str, text_col: str, columns: dict[str, str], row: Callable, spoil: Spoil | None) -> DataFrame:
    """id_col and the named columns of row(words, runs)."""
    ship_package(docs.sparkSession)
    d = docs.select(id_col, F.col(text_col).alias("text") if text_col != id_col else F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([d.schema[0], *(T.StructField(k, T._parse_datatype_string(v)) for k, v in columns.items())])
    names, types = list(columns), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
        for batch in (part for whole in batches for part in small_slices(whole, 1)):
            out = [row(words, runs) for words, runs in _documents(batch, spoil)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], types[i]) for i in range(len(names)))], names=[id_col, *names])

    return d.mapInArrow(run, schema)


def _runs_row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    return len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs]


def _collapsed_row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    kept = kept_places(len(words), runs)
    return b" ".join([words[i] for i in kept.tolist()]).decode(), len(words) - len(kept)


def _report_row(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = b" ".join([words[i] for i in kept_places(len(words), runs).tolist()] if runs else words)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *four, sha256(listed.encode()).hexdigest(), sha256(kept).hexdigest()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs) of each row: its runs (start, length, period) in words, by start, then period.

    Words are what white space U+0009 to U+000D and U+0020 separates. A run is a stretch of at least max(6, 4 * period)
    words that repeats with its smallest period and that no neighbouring word extends. Rows are worked on where they
    are, nothing is shuffled, and a task holds about 4 MB of text at a time, or one longer text. A null or empty text
    has no words and no runs; rows that repeat an id are rows of their own; an empty table gives an empty result. Other
    columns are not read.
    """
    return _mapped(docs, id_col, text_col, {"n_words": "long", "runs": f"array<struct<{RUN}>>"}, _runs_row, None)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_dropped): of every run only the first period stays; words are joined by one space. Nulls become empty texts."""
    return _mapped(docs, id_col, text_col, {text_col: "string", "n_dropped": "long"}, _collapsed_row, None)


def periodic_report(docs: DataFrame) -> DataFrame:
    """One row for each document, after periodic_tail: doc_id, n_runs, the longest run's start, length, period and
    exponent_milli (ties: the smallest start, then period; nulls without a run), runs_sha256, collapsed_sha256."""
    columns = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}
    return _mapped(docs, "doc_id", "text", columns, _report_row, periodic_tail)
