"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.storage import remove, settle, shared_folder


def _written(e: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    """e as written to the shared folder, and where; the step before is removed."""
    spark = e.sparkSession
    path = shared_folder(spark, "components")
    e.write.parquet(path)
    if old:
        remove(spark, old)
    return spark.read.schema("u long, v long").parquet(path), path


def _are_stars(e: DataFrame) -> bool:
    """Whether each u hangs on one v alone, and no v hangs on another: nothing is left to change then."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("hung")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("hung")))
    loose = ends.groupBy("id").agg(F.sum("hung").alias("hung"), F.count("*").alias("ends")).filter("hung > 0 AND ends > 1")
    return loose.agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): for each end of an edge, the smallest id that it can reach. Ids are longs; nulls have no edges.

    Each step hangs a vertex's neighbours on the smallest of them, first its larger ones, then its smaller ones, until all
    are stars; edges that are stars at once take no step, and the number of steps grows with the logarithm of the vertices.
    Steps are written to the shared folder, so lineage stays short and a lost executor costs one step. A hub's edges are
    never gathered in a list: its minimum is an aggregate with a partial step, and it meets its edges in an inner join that
    Spark splits.
    """
    e, path = _written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), None)
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select("v", "m").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, path = _written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), path)
    settle(edges.sparkSession)
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    )
