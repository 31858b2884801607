"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of what survives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.storage import key_bitmap, keep_possible, without_keys, written
from attestra.llm.text import or_empty, without_spaces


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64) -> DataFrame:
    """Members of groups of equal texts: id, mark, keep_id, group_size, kept. Texts that stand alone have no row.

    Texts are equal when identical after white space is deleted. Of a group, the row with most code points in the
    original text stays, then the one with the smallest id, which may be of any ordered type; a null id is the largest. mark is a hash of the original text: with the id it names a row.

    First level: lengths and hashes of the first `prefix` characters leave one scan together and are counted; a length
    that occurs once has no prefix hash that occurs twice, so a count of its own would only cost a scan. Second level:
    full hashes of texts whose (length, prefix hash) occurs more than once. A bitmap of bounded size spares most others
    the full hash inside the scan, an exact semi-join on length and prefix hash removes what it lets through; no text is
    ever shuffled. A group's members are counted before they are shuffled; they meet their group's row in an inner join,
    whose large partitions Spark splits.

    Null texts are empty texts, and all empty texts are equal. Rows that repeat an id and a text are each counted, and stay
    or go together; rows that repeat an id with another text are rows of their own. An empty table gives an empty result.
    Other columns are not looked at.
    """
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), or_empty(F.col(text_col)).alias("text"))
    base = base.withColumn("squeezed", without_spaces(F.col("text")))
    level1 = F.xxhash64(F.length("squeezed"), F.substring("squeezed", 1, prefix))
    short = base.select(F.length("squeezed").alias("length"), level1.alias("h"))
    again = written(short.groupBy("length", "h").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "dedup-again")
    bitmap = written(key_bitmap(again, "h"), "dedup-bitmap")

    survivors = keep_possible(base.withColumn("h", level1), "h", bitmap).select(
        "id",
        "mark",
        F.length("text").alias("full_length"),
        F.length("squeezed").alias("length"),
        "h",
        F.sha2("squeezed", 256).alias("full_hash"),
    )
    members = written(survivors.join(again.hint("merge"), ["length", "h"], "left_semi"), "dedup-members")
    key = ["length", "h", "full_hash"]
    best = F.min_by(F.struct("id", "mark"), F.struct((-F.col("full_length")).alias("longest"), F.col("id").isNull().alias("nameless"), "id", "mark"))
    groups = members.groupBy(*key).agg(F.count("*").alias("group_size"), best.alias("best")).filter("group_size > 1")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    return members.join(groups.hint("merge"), key).select(
        F.col("id").alias(id_col), "mark", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept")
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    gone = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col(id_col).alias("id"), "mark")
    return without_keys(docs, [F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))], gone)


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256 of the text without white space."""
    digest = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.sha2(without_spaces(or_empty(F.col("text"))), 256).alias("text_sha256"))
    found = exact_duplicates(docs).toDF("found_id", "found_mark", "keep_id", "group_size", "kept").dropDuplicates(["found_id", "found_mark"])
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("mark") == F.col("found_mark"))
    alone = F.col("found_mark").isNull()
    return digest.join(found.hint("merge"), same, "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        "text_sha256",
    )


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
