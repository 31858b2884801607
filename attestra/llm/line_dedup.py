"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.storage import Scratch, key_bitmap, remove, shared_folder, with_possible, written
from attestra.llm.text import SPACES, ascii_lower, or_empty

#: Shortest key, in code points, that can be dropped, and in how many documents it must be found.
MIN_LENGTH, MIN_DOCS = 40, 5
#: Batches that a table is cut into, and runs on a level before they are merged into one on the next.
BATCHES, FANOUT = 4, 2

KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(or_empty(text), "\n")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hashes(key: str) -> list[Column]:
    """128 bits in two columns; equal lines alone have equal hashes, but for a chance of 2**-128 for a pair."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), F.col(key)).alias("h2")]


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, max_id) on levels, in a shared folder.

    A run is a Parquet table bucketed and sorted by key, in as many buckets as every other run, with each key once. So
    old runs are never shuffled again: a batch is dealt to their buckets, and runs are merged bucket by bucket. n_docs and
    max_id are totals up to the run's batch, so for a key that several runs hold the newest run has the largest of both.
    add() joins a batch with the runs: keys that no run holds (the anti-join part) enter with their own counts, known keys
    enter with their new totals. A level with FANOUT runs is merged into one run of the next level, so a key is rewritten
    as often as there are levels, which is the logarithm of the number of batches.

    Bucketed tables need names in the session's catalog; close() takes them out and deletes the files. buckets: by default
    as many as the session has shuffle partitions.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout, self.levels, self.folders = spark, fanout, [], {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, keys: DataFrame, level: int) -> None:
        path = shared_folder(self.spark, f"line-run-l{level}")
        name = path.rsplit("/", 1)[1].replace("-", "_")
        run = keys.select(*KEY, "n_docs", "max_id")
        run.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        self.folders[name] = path

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, self.folders.pop(name))

    def _totals(self, names: list[str]) -> DataFrame:
        # Joined, not united: Spark 4.1 plans no exchange above a union of bucketed tables, and groups then come twice.
        rows = self.spark.table(names[0])
        for name in names[1:]:
            other = self.spark.table(name).withColumnsRenamed({"n_docs": "other_n", "max_id": "other_max"})
            rows = rows.join(other.hint("merge"), KEY, "full").select(
                *KEY, F.greatest("n_docs", "other_n").alias("n_docs"), F.greatest("max_id", "other_max").alias("max_id")
            )
        return rows

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def totals(self) -> DataFrame:
        """Every key once, with its totals."""
        return self._totals(self.names())

    def joined(self, batch: DataFrame) -> DataFrame:
        """The batch's keys with their totals over the runs and the batch."""
        if not self.names():
            return batch.repartition(self.buckets, *KEY)
        keys, before = batch, []
        for i, name in enumerate(self.names()):
            known = self.spark.table(name).select(*KEY, F.col("n_docs").alias(f"n_{i}"), F.col("max_id").alias(f"max_{i}"))
            keys = keys.join(known.hint("merge"), KEY, "left")
            before.append(i)
        return keys.select(
            *KEY,
            (F.col("n_docs") + F.greatest(F.lit(0), *[f"n_{i}" for i in before])).alias("n_docs"),
            F.greatest("max_id", *[f"max_{i}" for i in before]).alias("max_id"),
        )

    def add(self, batch: DataFrame) -> str:
        """Adds a batch of (h1, h2, n_docs, max_id), each key once; returns the name of its run."""
        self._write(self.joined(batch), 0)
        newest = self.levels[0][-1]
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(self._totals(old), level + 1)
            self.levels[level] = []
            for name in old:
                self._drop(name)
            newest, level = self.levels[level + 1][-1], level + 1
        return newest

    def close(self) -> None:
        for name in self.names():
            self._drop(name)
        self.levels = []


def index_lines(docs: DataFrame, id_col: str, text_col: str, min_length: int = MIN_LENGTH, batches: int = BATCHES) -> LineRuns:
    """Runs over all documents, batch by batch. A document counts once for a key, however often it holds it."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col(text_col)), line_key), lambda k: F.length(k) >= min_length))
    lines = docs.select(
        F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col), F.lit(batches)).alias("batch"), F.explode(keys).alias("key")
    ).select("id", "batch", *_hashes("key"))
    counted = lines.groupBy("batch", *KEY).agg(F.count("*").alias("n_docs"), F.max("id").alias("max_id"))
    scratch = Scratch(docs.sparkSession)
    by_batch = scratch.written(counted, "line-batches", partition_by="batch")
    runs = LineRuns(docs.sparkSession)
    for b in range(batches):
        runs.add(by_batch.filter(F.col("batch") == b).drop("batch"))
    scratch.clear()
    return runs


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    counts: bool = True,
) -> DataFrame:
    """docs with text_col rewritten, and n_lines and n_dropped (line counts before dropping, and of what went).

    Keys of at least min_length code points found in at least min_docs documents lose all their lines but those in the
    largest id that holds them. Other lines stay as they are, joined by a line feed. Only texts that lose lines move to meet
    them (a bitmap of bounded size tells them apart, and lets a few others through). Counts are totals over all
    documents, from the runs. The join of lines with common keys is an inner shuffled join, which Spark splits where a
    key is hot, and what it yields is gathered by document. Documents meet their dropped lines by id and text hash.

    A null or empty text is one empty line, and becomes an empty text. Rows that repeat an id count as a document each,
    and all of them are the largest id if their id is. A null id is never the largest unless all are null. An empty
    table gives an empty result; other columns come through, but for ones named n_lines or n_dropped, which are replaced.
    Without counts these two are not made, and columns of these names come through as well.
    """
    runs = index_lines(docs, id_col, text_col, min_length, batches)
    common = written(
        runs.totals().filter(F.col("n_docs") >= min_docs).select(*KEY, F.col("max_id").alias("keep_id")), "line-common"
    )
    runs.close()
    held = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("text_hash"),
        F.explode(
            F.filter(
                F.transform(lines_of(F.col(text_col)), lambda x, i: F.struct(i.alias("at"), line_key(x).alias("key"))),
                lambda s: F.length(s["key"]) >= min_length,
            )
        ).alias("s"),
    ).select("id", "text_hash", F.col("s.at").alias("at"), F.col("s.key").alias("key"))
    held = held.select("id", "text_hash", "at", *_hashes("key"))
    lost = held.join(common.hint("merge"), KEY).filter(~F.col("id").eqNullSafe(F.col("keep_id")))
    lost = lost.groupBy("id", "text_hash").agg(F.collect_set("at").alias("lost_at"))
    lost = written(lost, "line-lost")
    bitmap = written(key_bitmap(lost.select(F.xxhash64("id", "text_hash").alias("h")), "h"), "line-bitmap")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text_col).alias("row_hash"))
    d = with_possible(d.withColumn("row_key", F.xxhash64(F.col(f"row.`{id_col}`"), F.col("row_hash"))), "row_key", bitmap, "maybe")
    same = F.col(f"row.`{id_col}`").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash"))
    changed = d.filter("maybe").select("row", "row_hash").join(lost.hint("shuffle_hash"), same, "left").select("row", "lost_at")
    out = changed.unionByName(d.filter("NOT maybe").select("row", F.lit(None).cast("array<int>").alias("lost_at")))
    text = or_empty(F.col(f"row.`{text_col}`"))
    lines = lines_of(F.col(f"row.`{text_col}`"))
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("lost_at", i)), "\n")
    new_text = F.when(F.col("lost_at").isNull(), text).otherwise(kept)
    keep = [new_text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    if not counts:
        return out.select(*keep)
    return out.select(
        *keep,
        (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("lost_at").isNull(), F.lit(0)).otherwise(F.size("lost_at")).cast("long").alias("n_dropped"),
    )


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_dropped, kept_sha256."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, i, s[i] AS line,
                  translate(regexp_replace(s[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
c AS (SELECT k, max(doc_id) AS keep_id FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT l.doc_id, i, line, c.k IS NOT NULL AND l.doc_id <> c.keep_id AS gone FROM l LEFT JOIN c USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""
