"""A ledger of finished rows: batches appear whole or not at all, and a batch that is replayed adds nothing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from attestra.streaming.streams import stream_ingest_dedup

CONFIG, BATCH = "ledger_config", "ledger_batch"


def config_hash(config: Mapping) -> str:
    """The same for equal settings in any order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


class RunLedger:
    """Finished rows below one shared folder, a folder for each batch.

    A batch is written by Spark's committer, whose last step leaves a success mark; folders without it are not read, so a
    batch that was cut off counts as never done. A batch is named by its id: written again it replaces itself. Rows
    carry the hash of the configuration that made them.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, config: Mapping, schema: T.StructType):
        self.spark, self.path, self.key, self.config = spark, path.rstrip("/"), key, config_hash(config)
        own = T.StructType([f for f in schema if f.name not in (CONFIG, BATCH)])
        self.schema = T.StructType([*own, T.StructField(CONFIG, T.StringType()), T.StructField(BATCH, T.LongType())])

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch-{batch}"

    def batches(self) -> list[int]:
        """Ids of the whole batches: names of folders, no rows."""
        jvm = self.spark.sparkContext._jvm
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch-*/_SUCCESS")
        found = marks.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
        return sorted(int(x.getPath().getParent().getName().removeprefix("batch-")) for x in found or [])

    def finished(self, but: int | None = None) -> DataFrame:
        """All finished rows, with the configuration and the batch of each; but: without that batch."""
        folders = [self._folder(b) for b in self.batches() if b != but]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, batch: int) -> None:
        """Writes a batch, in place of an earlier try of it."""
        marked = rows.withColumns({CONFIG: F.lit(self.config), BATCH: F.lit(batch).cast("long")})
        marked.select(*[F.col(f"`{f.name}`") for f in self.schema]).write.mode("overwrite").parquet(self._folder(batch))

    def report(self, inputs: DataFrame) -> DataFrame:
        """inputs with state: finished, refused (finished under another configuration alone), or pending. A null key is pending."""
        own = F.bool_or(F.col(CONFIG) == self.config).alias("_own")
        done = self.finished().groupBy(F.col(self.key).alias("_key")).agg(own)
        out = inputs.join(done.hint("merge"), F.col(self.key) == F.col("_key"), "left")
        state = F.when(F.col("_key").isNull(), "pending").when(F.col("_own"), "finished").otherwise("refused")
        return out.withColumn("state", state).drop("_key", "_own")

    def pending(self, inputs: DataFrame) -> DataFrame:
        """What is still to do. Rows finished under another configuration are an error, as a run must not mix two."""
        out = self.report(inputs)
        wrong = out.filter("state = 'refused'").select(self.key).limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0][0]} was finished under another configuration")
        return out.filter("state = 'pending'").drop("state")

    def ingest(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch: its distinct keys that no other batch has. The same batch again gives the same folder."""
        fresh = rows.dropDuplicates([self.key])
        self.commit(fresh.join(self.finished(but=batch).select(self.key).distinct().hint("merge"), self.key, "left_anti"), batch)


def ingest_once(files: DataFrame, ledger: RunLedger, time: str, checkpoint: str, delay: str = "1 day") -> DataStreamWriter:
    """A stream of files into a ledger, each key once: repeated keys within the watermark go in the stream's own state, those that
    come later, or again after a restart without its checkpoint, against the ledger."""
    deduped = stream_ingest_dedup(files, ledger.key, time, delay)
    return deduped.writeStream.foreachBatch(lambda df, batch: ledger.ingest(df, batch)).option("checkpointLocation", checkpoint)
