"""From raw documents to segmented training text, in five stages.

In every stage a null text counts as empty, rows that repeat an id are rows of their own, an empty table gives an empty
result, and columns that documents have besides keep their names and values in all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.decontaminate import remove_contaminated
from attestra.llm.line_dedup import dedup_lines
from attestra.llm.ngram_join import one_per_component
from attestra.llm.piece_lattice import encode_pieces
from attestra.llm.quality import keep_good
from attestra.llm.storage import written

#: Chunks that a worker of the last stage remembers: fewer than by default, since its executor still holds what earlier stages used.
REMEMBERED = 25_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps. It is fitted on these documents and the labels of all but a fifth."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many of them hold; every document stays, an emptied one too. n_chars is counted anew."""
    out = dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one with the smallest id."""
    return one_per_component(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is benchmark text."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the best segmentation's pieces, scores and n_pieces of the n best, others: where those differ from the best."""
    return encode_pieces(docs, remembered=REMEMBERED)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("segmentation", segmentation),
]

#: A fitted classifier and a lattice search are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
