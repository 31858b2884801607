"""Streams give their batch twins' rows, readers their rules' rows."""

import datetime
import struct
import zlib

import pytest

from attestra.operators import claims, models, series
from attestra.plans.fixtures import view
from attestra.sources import ledger, readers
from attestra.streaming import streams

SF = "/root/testdata/sf0.001"


def drained(spark, make, df, tmp_path, mode):
    src, out = str(tmp_path / "src"), f"out_{mode}_{abs(hash(str(tmp_path))) % 10**8}"
    df.repartition(1).write.parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = make(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {out}")


def test_verdict_stream(spark, tmp_path):
    preds, policy = view(spark, SF, "preds"), view(spark, SF, "policy")
    got = drained(spark, lambda s: streams.stream_verdict(s, policy).select("doc_id", "verdict"), preds, tmp_path, "append")
    want = streams.classify_predictions(preds, policy).select("doc_id", "verdict")
    assert sorted(got.collect()) == sorted(want.collect())


def test_frame_state_stream(spark, tmp_path):
    frames = view(spark, SF, "frames").select("video_id", "frame_index", "ai_probability", "luma", "ts")
    got = {r["video_id"]: r for r in drained(spark, streams.stream_frame_state, frames, tmp_path, "update").collect() if not r["closed"]}
    want = {r["video_id"]: r for r in series.frame_states(frames).collect()}
    assert set(got) == set(want)
    for k, r in want.items():
        assert all(got[k][c] == r[c] for c in ("frames", "last_index", "high_run", "longest_run"))
        assert (got[k]["mean_probability"], got[k]["luma_total"]) == pytest.approx((r["mean_probability"], r["luma_total"]))


def test_quota_stream(spark, tmp_path):
    requests = view(spark, SF, "requests")
    got = {r["request_id"]: r["allowed"] for r in drained(spark, lambda s: streams.stream_quota(s, 10), requests, tmp_path, "append").collect()}
    want = {r["request_id"]: r["allowed"] for r in claims.monthly_quota(requests, 10).collect()}
    assert got == want


def test_window_streams(spark, tmp_path):
    frames = view(spark, SF, "frames").select("video_id", "frame_index", "ai_probability", "ts")
    got = drained(spark, lambda s: streams.stream_suspicious_windows(s), frames, tmp_path, "update")
    assert sorted(got.collect()) == sorted(streams.stream_suspicious_windows(frames).collect())


def test_adapter_rows(spark):
    media = spark.createDataFrame([(1, 2.0), (2, 3.0)], "media_id long, x double")

    def broken():
        raise OSError("no file")

    ok = models.detector_adapter(media, lambda: 2.0, lambda m, x: x * m, "m", "x").collect()
    assert sorted((r["media_id"], r["status"], r["score"]) for r in ok) == [(1, "completed", 4.0), (2, "completed", 6.0)]
    assert {r["status"] for r in models.detector_adapter(media, broken, lambda m, x: x, "m", "x").collect()} == {"unavailable"}
    assert {r["status"] for r in models.detector_adapter(media, lambda: 1, lambda m, x: 1 / 0, "m", "x").collect()} == {"error"}


def png(path, width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(3 * width) for _ in range(height))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_readers(spark, tmp_path):
    (tmp_path / "c" / "train" / "real").mkdir(parents=True)
    png(tmp_path / "c" / "train" / "real" / "a.png", 8, 5)
    r = readers.scan_corpus(spark, str(tmp_path / "c")).first()
    assert (r["split"], r["label"]) == ("train", "real") and r["length"] > 0
    r = readers.image_sizes(spark, str(tmp_path / "c")).first()
    assert (r["height"], r["width"]) == (5, 8)
    (tmp_path / "m.jsonl").write_text('{"path": "a", "split": "train"}\n\n[1, 2]\n{"path": "b"}\n')
    assert sorted(r["path"] for r in readers.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()) == ["a", "b"]
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "source_id string, v int")
    with pytest.raises(ValueError):
        readers.unique_records(rows, "source_id")
    with pytest.raises(PermissionError):
        readers.locked_guard(spark.createDataFrame([("a", "locked_test")], "path string, split string"), "locked_test")
    readers.write_jsonl(rows, str(tmp_path / "j"))
    readers.write_manifest_csv(rows.withColumnRenamed("source_id", "path"), str(tmp_path / "csv"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


class Steps:
    """A stream that runs over one more file of rows at each step, always with the same checkpoint."""

    def __init__(self, spark, make, schema, tmp_path, mode):
        self.spark, self.make, self.schema, self.path, self.mode, self.n = spark, make, schema, tmp_path, mode, 0
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def step(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / "src"))
        seen = []
        stream = self.make(self.spark.readStream.schema(self.spark.createDataFrame([], self.schema).schema).parquet(str(self.path / "src")))
        q = stream.writeStream.foreachBatch(lambda df, i: seen.extend(df.collect())).outputMode(self.mode).option("checkpointLocation", str(self.path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return seen


FRAMES = "video_id long, frame_index int, ai_probability double, luma double, ts timestamp"


def at(text):
    return datetime.datetime.fromisoformat(text)


def test_frame_state_is_dropped_after_the_watermark(spark, tmp_path):
    steps = Steps(spark, lambda s: streams.stream_frame_state(s, delay="1 hour", idle_minutes=60), FRAMES, tmp_path, "update")
    first = steps.step([(1, 0, 0.9, 0.1, at("2024-01-01T00:00")), (1, 1, 0.9, 0.3, at("2024-01-01T00:01"))])
    assert [(r["video_id"], r["frames"], r["longest_run"], r["late"]) for r in first] == [(1, 2, 2, 0)]
    second = steps.step([(1, 1, 0.9, 0.1, at("2024-01-01T00:02")), (1, 2, 0.1, 0.1, at("2024-01-01T00:03"))])
    assert [(r["frames"], r["longest_run"], r["late"], r["closed"]) for r in second if r["video_id"] == 1] == [(3, 2, 1, False)]
    third = steps.step([(2, 0, 0.1, 0.1, at("2024-01-05T00:00"))])
    closed = [r for r in third if r["closed"]]
    assert [(r["video_id"], r["frames"], r["late"]) for r in closed] == [(1, 3, 1)]
    again = steps.step([(1, 7, 0.7, 0.1, at("2024-01-05T00:01"))])
    assert [(r["frames"], r["last_index"], r["late"]) for r in again if r["video_id"] == 1] == [(1, 7, 0)]
    dropped = steps.step([(1, 8, 0.7, 0.1, at("2024-01-02T00:00"))])
    assert [r for r in dropped if r["video_id"] == 1 and not r["closed"]] == []


def test_month_quota_is_dropped_after_the_month(spark, tmp_path):
    steps = Steps(spark, lambda s: streams.stream_quota(s, 2), "request_id long, ts timestamp", tmp_path, "append")
    first = steps.step([(1, at("2024-01-30T00:00")), (2, at("2024-01-31T00:00"))])
    assert sorted((r["request_id"], r["allowed"]) for r in first) == [(1, True), (2, True)]
    second = steps.step([(3, at("2024-01-31T10:00")), (4, at("2024-02-01T10:00"))])
    assert sorted((r["request_id"], r["allowed"]) for r in second) == [(3, False), (4, True)]
    steps.step([(5, at("2024-04-01T00:00"))])
    steps.step([(6, at("2024-04-01T00:01"))])
    state = spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "cp")).select("key.month", "value.seen").collect()
    assert sorted(tuple(r) for r in state) == [("2024-04", 2)]


LEDGER = "path string, sha256 string, ts timestamp"


def test_ledger_replay_adds_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], LEDGER).schema
    made = lambda *ids: spark.createDataFrame([(f"p{i}", f"h{i}", at("2024-01-01T00:00")) for i in ids], LEDGER)
    book = ledger.RunLedger(spark, str(tmp_path / "done"), "sha256", {"stride": 2, "model": "a"}, schema)
    assert book.finished().count() == 0 and ledger.config_hash({"a": 1, "b": 2}) == ledger.config_hash({"b": 2, "a": 1})
    book.ingest(made(1, 2, 2), 0)
    book.ingest(made(2, 3), 1)
    for _ in range(2):
        book.ingest(made(2, 3), 1)
    book.ingest(made(1, 2, 2), 0)
    assert sorted(r["sha256"] for r in book.finished().collect()) == ["h1", "h2", "h3"]
    made(9).write.parquet(str(tmp_path / "done" / "batch-7"))
    (tmp_path / "done" / "batch-7" / "_SUCCESS").unlink()
    assert book.batches() == [0, 1] and book.finished().filter("sha256 = 'h9'").count() == 0
    report = {r["sha256"]: r["state"] for r in book.report(made(3, 4)).collect()}
    assert report == {"h3": "finished", "h4": "pending"} and [r["sha256"] for r in book.pending(made(3, 4)).collect()] == ["h4"]
    other = ledger.RunLedger(spark, str(tmp_path / "done"), "sha256", {"stride": 3, "model": "a"}, schema)
    assert {r["sha256"]: r["state"] for r in other.report(made(3, 4)).collect()} == {"h3": "refused", "h4": "pending"}
    with pytest.raises(ValueError, match="h3"):
        other.pending(made(3, 4))


def test_stream_into_the_ledger_once(spark, tmp_path):
    schema = spark.createDataFrame([], LEDGER).schema
    book = ledger.RunLedger(spark, str(tmp_path / "done"), "sha256", {}, schema)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "src"))
        q = ledger.ingest_once(stream, book, "ts", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(r["sha256"] for r in book.finished().collect())

    rows = lambda *ids: spark.createDataFrame([(f"p{i}", f"h{i % 4}", at("2024-01-01T00:00")) for i in ids], LEDGER)
    rows(1, 2, 5).coalesce(1).write.parquet(str(tmp_path / "src"))
    assert run("a") == ["h1", "h2"]
    rows(3, 6, 7).coalesce(1).write.mode("append").parquet(str(tmp_path / "src"))
    assert run("a") == ["h1", "h2", "h3"]
    assert run("b") == ["h1", "h2", "h3"]  # the checkpoint is lost: all files come again


def test_session_seconds_are_the_nearest(spark):
    from attestra.plans.report_queries import stream_sessions

    spots = [(1, "2024-01-01T00:00:00.400"), (1, "2024-01-01T00:10:00.600"), (2, "2024-01-01T00:00:01.700"), (2, "2024-01-01T00:31:02.100"), (3, "2024-01-01T00:00:00.500"), (3, "2024-01-01T00:00:01.500")]
    rows = [(video, i, 0.9, 0.1, at(ts).replace(tzinfo=datetime.timezone.utc)) for i, (video, ts) in enumerate(spots)]
    day = 1704067200
    found = {r["n"]: r for r in stream_sessions(spark.createDataFrame(rows[:2], FRAMES)).collect()}
    assert (found[2]["first_second"] - day, found[2]["last_second"] - day) == (0, 601)
    found = sorted((r["video_id"], r["n"], r["first_second"] - day, r["last_second"] - day) for r in stream_sessions(spark.createDataFrame(rows, FRAMES)).collect())
    assert found == [(1, 2, 0, 601), (2, 1, 2, 2), (2, 1, 1862, 1862), (3, 2, 0, 2)]  # a half goes to the even second
