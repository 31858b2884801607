"""Structured Streaming forms of the batch operators. Under trigger(availableNow=True) each gives its batch twin's rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from attestra.operators.evaluation import classify_predictions
from attestra.shipping import ship_package

FRAME_STATE = "video_id long, frames long, last_index long, high_run long, longest_run long, mean_probability double, luma_total double, late long, closed boolean"


def milliseconds(values: pd.Series) -> int:
    """The latest of some timestamps in milliseconds since 1970, 0 if there is none."""
    latest = pd.to_datetime(values, utc=True).max()
    return 0 if pd.isna(latest) else int(latest.timestamp() * 1000)


class FrameState(StatefulProcessor):
    """Per video: counts, running sums, the current and longest run of high frames. A frame whose index is not over the last
    one is late: it is counted and changes nothing else. idle_ms after a video's last frame in event time its state is
    dropped, and a last row says that it is closed; a later frame would begin the video anew."""

    def __init__(self, threshold: float = 0.65, idle_ms: int = 3_600_000):
        self.threshold, self.idle_ms = threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("frames", "frames long, last_index long, run long, longest long, total double, luma double, last_luma double, late long, seen_ms long")

    def _row(self, key, closed: bool) -> pd.DataFrame:
        frames, last, run, longest, total, luma, _, late, _ = self.state.get()
        return pd.DataFrame({"video_id": [key[0]], "frames": [frames], "last_index": [last], "high_run": [run], "longest_run": [longest], "mean_probability": [total / max(1, frames)], "luma_total": [luma], "late": [late], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, last, run, longest, total, luma, last_luma, late, seen = self.state.get() if self.state.exists() else (0, -1, 0, 0, 0.0, 0.0, 0.0, 0, 0)
        every = pd.concat(list(rows)).sort_values("frame_index")
        for index, p, light in zip(every["frame_index"], every["ai_probability"], every["luma"], strict=True):
            if index <= last:
                late += 1
                continue
            run = run + 1 if p >= self.threshold else 0
            luma += abs(light - last_luma) if frames else 0.0
            frames, last, longest, total, last_luma = frames + 1, int(index), max(longest, run), total + float(p), float(light)
        if (now := milliseconds(every["ts"])) > seen:
            if seen:
                self.handle.deleteTimer(seen + self.idle_ms)
            self.handle.registerTimer(now + self.idle_ms)
            seen = now
        self.state.update((frames, last, run, longest, total, float(luma), last_luma, late, seen))
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            yield self._row(key, True)
            self.state.clear()

    def close(self) -> None:
        pass


def stream_frame_state(frames: DataFrame, threshold: float = 0.65, delay: str = "1 hour", idle_minutes: int = 24 * 60) -> DataFrame:
    """The running state of each video after each batch (update mode), and a closed row when idle_minutes have passed since its
    last frame. Frames that the watermark has passed are dropped by Spark, which counts them in its metrics. Needs the
    RocksDB state store."""
    ship_package(frames.sparkSession)
    timed = frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("video_id").transformWithStateInPandas(FrameState(threshold, idle_minutes * 60_000), outputStructType=FRAME_STATE, outputMode="Update", timeMode="EventTime")


class MonthQuota(StatefulProcessor):
    """Per UTC month: how many requests were seen; the first `limit` are allowed. The count is dropped once the watermark is past
    the month's end, when no request of that month can come any more."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.state.exists() and key[0] is not None:
            self.handle.registerTimer(int((pd.Timestamp(f"{key[0]}-01", tz="UTC") + pd.offsets.MonthBegin(1)).timestamp() * 1000))
        seen = self.state.get()[0] if self.state.exists() else 0
        every = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        allowed = [self.limit > 0 and seen + i < self.limit for i in range(len(every))]
        self.state.update((seen + len(every),))
        yield pd.DataFrame({"month": key[0], "request_id": every["request_id"], "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"month": pd.Series(dtype="object"), "request_id": pd.Series(dtype="int64"), "allowed": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def stream_quota(requests: DataFrame, limit: int, delay: str = "1 day") -> DataFrame:
    """(month, request_id, allowed): requests are allowed in the order of time and id within a batch, batches in order."""
    ship_package(requests.sparkSession)
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    keyed = timed.withColumn("month", F.date_format("ts", "yyyy-MM"))
    return keyed.groupBy("month").transformWithStateInPandas(MonthQuota(limit), outputStructType="month string, request_id long, allowed boolean", outputMode="Append", timeMode="EventTime")


def stream_ingest_dedup(files: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return files.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_verdict(preds: DataFrame, policy: DataFrame) -> DataFrame:
    """Verdicts of a stream under a policy table, read once for each batch."""
    return classify_predictions(preds, policy)


def stream_suspicious_windows(frames: DataFrame, length: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """(video_id, start, end, n, peak) of high frames in sliding windows."""
    high = frames.filter("ai_probability >= 0.65").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = high.groupBy("video_id", F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"), F.max("ai_probability").alias("peak"))
    return out.select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "peak")


def stream_sessions(frames: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """(video_id, start, end, n) of high frames in sessions that a gap ends."""
    high = frames.filter("ai_probability >= 0.65").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = high.groupBy("video_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("video_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
