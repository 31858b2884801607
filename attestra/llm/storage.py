"""Written intermediate tables: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a key bitmap: at most this many rows are ever broadcast for one filter.
BITMAP_WORDS = 1 << 17


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that setting is missing, a local session gets a temporary folder; any other session is refused, since a folder
    of one machine cannot be read by the others.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("attestra.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-attestra-")
        spark.conf.set("attestra.scratch.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back."""
    path = shared_folder(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Drops what the driver still holds of finished steps: plans that Python's frames refer to, then the JVM's records of them,
    whereupon Spark also removes their shuffle files. An operator of many short steps fills the driver's heap otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables that an operator writes between two calls of settle. Each stage and each scan passes a block of some MB through the
#: driver's heap, which grows by them before it is collected.
SETTLED = 2


class Scratch:
    """The written tables of one operator, which it removes when they are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.steps = spark, [], 0

    def written(self, df: DataFrame, label: str, keep: bool = False, partition_by: str | None = None) -> DataFrame:
        path = shared_folder(self.spark, label)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
        if not keep:
            self.paths.append(path)
        self.steps += 1
        if self.steps % SETTLED == 0:
            settle(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
        settle(self.spark)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_folder() named."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def key_bitmap(keys: DataFrame, hash_col: str) -> DataFrame:
    """At most BITMAP_WORDS rows (word, bits): which of 64 * BITMAP_WORDS slots the 64-bit hashes in keys fall into."""
    h = F.col(hash_col)
    return keys.groupBy(F.pmod(h, F.lit(BITMAP_WORDS)).alias("bm_word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shiftright({hash_col}, 40), 64) AS int))")).alias("bm_bits")
    )


def with_possible(df: DataFrame, hash_col: str, bitmap: DataFrame, name: str) -> DataFrame:
    """df with a column that says whether a row's hash may be among the bitmap's keys: true for all that are and a few others.

    The bitmap has at most BITMAP_WORDS rows whatever the data, so its broadcast is bounded. It is full at worst, and
    then all rows are possible; results never rest on it alone.
    """
    probe = df.withColumn("bm_word", F.pmod(F.col(hash_col), F.lit(BITMAP_WORDS))).join(F.broadcast(bitmap), "bm_word", "left")
    test = f"coalesce(shiftright(bm_bits, cast(pmod(shiftright({hash_col}, 40), 64) AS int)) & 1L = 1L, false)"
    return probe.withColumn(name, F.expr(test)).drop("bm_word", "bm_bits")


def keep_possible(df: DataFrame, hash_col: str, bitmap: DataFrame) -> DataFrame:
    """Rows of df whose hash may be among the bitmap's keys: all true ones and a few others."""
    return with_possible(df, hash_col, bitmap, "bm_possible").filter("bm_possible").drop("bm_possible")


def without_keys(df: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """Rows of df whose keys are not in gone, whose columns are the keys in order; null keys match null keys. All of df's
    columns stay as they are.

    Rows that a bitmap of bounded size rules out go straight through; only the others are shuffled to the exact
    anti-join, so most of a table's texts never move.
    """
    lost = gone.toDF(*[f"gone_{i}" for i in range(len(keys))]).distinct()
    lost = written(lost, "drop-keys")
    h = F.xxhash64(*lost.columns)
    bitmap = written(key_bitmap(lost.select(h.alias("drop_hash")), "drop_hash"), "drop-bitmap")
    own = [k.alias(f"key_{i}") for i, k in enumerate(keys)]
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *own)
    row = row.withColumn("drop_hash", F.xxhash64(*[f"key_{i}" for i in range(len(keys))]))
    probe = with_possible(row, "drop_hash", bitmap, "maybe")
    same = None
    for i in range(len(keys)):
        one = F.col(f"key_{i}").eqNullSafe(F.col(f"gone_{i}"))
        same = one if same is None else same & one
    exact = probe.filter("maybe").join(lost.hint("merge"), same, "left_anti")
    return probe.filter("NOT maybe").select("row").unionByName(exact.select("row")).select("row.*")
