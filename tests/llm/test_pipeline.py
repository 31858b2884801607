"""Each stage against brute force on the smallest tables."""

import os

import corpus_pipeline as cp
import duckdb
from pyspark.sql import functions as F

from attestra.llm import decontaminate, line_dedup, ngram_join, piece_lattice, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    scored = {r["doc_id"]: r["predicted"] for r in queries.op1_quality_classifier(spark, SF).collect()}
    kept = cp.written(cp.quality(spark, docs, SF), "t1")
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, p in scored.items() if p}
    for sql, stage, gone in (
        (line_dedup.SQL, cp.line_dedup, None),
        (ngram_join.SQL, cp.near_duplicates, "doc_id <> component_id"),
        (decontaminate.SQL, cp.decontamination, "contaminated"),
    ):
        before = kept.toPandas()
        c.register("documents", before)
        want = c.execute(sql).fetchdf()
        kept = cp.written(stage(spark, kept, SF), "t2")
        after = kept.toPandas()
        assert list(after.columns) == list(before.columns)
        if gone:
            assert set(after["doc_id"]) == set(c.execute(f"SELECT doc_id FROM want WHERE NOT ({gone})").fetchdf()["doc_id"])
        else:
            text = c.execute("SELECT doc_id, sha256(text) AS s FROM after").fetchdf()
            assert dict(zip(text["doc_id"], text["s"])) == dict(zip(want["doc_id"], want["kept_sha256"]))
    final = cp.segmentation(spark, kept, SF)
    model = piece_lattice.piece_model(piece_lattice.MODEL)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    got = final.collect()
    assert len(got) == len(texts) and all(model.decode(r["ids"]) == texts[r["doc_id"]] for r in got)


def test_stages_take_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing names go through all stages, and all their columns with them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields]
    odd = [None, "", " \n\t ", "x" * 20000, "word " * 30000, "a\r\nb"]
    rows = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)] + [(10**6 + 3, odd[3])], "doc_id long, text string")
    rows = rows.unionByName(spark.range(1).select(*nothing), allowMissingColumns=True)
    frame = docs.unionByName(rows, allowMissingColumns=True)
    clashing = ("row", "score", "id", "key", "h1", "batch", "n_lines", "n_dropped", "text_hash", "component_id", "n_hit", "label", "word", "other")
    frame = cp.written(frame.select(*docs.columns, *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in clashing]), "t3")
    columns = frame.columns
    for name, stage in cp.STAGES[:-1]:
        after = cp.written(stage(spark, frame, SF), "t4")
        assert after.columns == columns, name
        assert after.filter(" OR ".join(f"`{c}` <> concat('{c}', doc_id)" for c in clashing)).count() == 0, name
        before, ids = {r[0] for r in frame.select("doc_id").collect()}, {r[0] for r in after.select("doc_id").collect()}
        assert ids <= before, name
        if name == "line_dedup":
            assert ids == before and after.count() == frame.count()
        # A stage that a poor classifier starves still meets the odd rows.
        frame = cp.written(after.unionByName(spark.read.schema(frame.schema).parquet(*frame.inputFiles()).filter("doc_id >= 1000000 OR doc_id IS NULL")).distinct(), "t5")
    last = cp.segmentation(spark, frame, SF)
    assert last.count() == frame.count()


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        after = stage(spark, docs, SF)
        assert after.count() == 0, name
        if name != "segmentation":
            assert after.columns == docs.columns, name
