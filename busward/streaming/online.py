"""Online forms of the window and monitor operators on Structured Streaming.

State per key is small by construction: fewer than one window of frames, or a handful of numbers; and it
ends: windows by event time, monitors by the time they are idle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from busward.operators.windows import BYTES, PAYLOAD, STRUCTURAL, TIMING

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = ("seq", "can_id", *BYTES, "is_attack", "ts_us")
FEATURES = (*STRUCTURAL, *PAYLOAD, *TIMING)
# A window is `full`, or `ended` when event time has passed it with frames missing; features are null then.
# They leave Python as one array, as a row of many columns costs more than the features.
WINDOW_OUTPUT = "capture string, window_index bigint, status string, frames int, start_row bigint, end_row bigint, attack_frame_count bigint, features array<double>"
# Neighbouring windows that share a key of the stream.
TOGETHER = 64
MONITOR_OUTPUT = "run bigint, seq bigint, active int, trust double, late int"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed processors need; a RocksDB provider of the session's own stays."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, None) or ""):
        spark.conf.set(key, ROCKSDB)


def structural_values(ids: np.ndarray, data: np.ndarray) -> list[float]:
    """STRUCTURAL of the frames of one window in order; data is frames x 8."""
    n = len(ids)
    counts = np.unique(ids, return_counts=True)[1]
    shares = counts / n
    distinct = len(np.unique(np.column_stack([ids, data]), axis=0))
    same_id = ids[1:] == ids[:-1]
    same = same_id & (data[1:] == data[:-1]).all(axis=1)
    return [len(counts), float(-(shares * np.log2(shares)).sum()) + 0.0, counts.max() / n, distinct, distinct / n,
            (~same_id).sum() / (n - 1), same.sum() / (n - 1)]


def payload_values(data: np.ndarray) -> list[float]:
    """PAYLOAD of the frames of one window in order: byte by byte, statistic by statistic."""
    n = len(data)
    steps = np.abs(np.diff(data, axis=0)).sum(axis=0) / (n - 1)
    return np.stack([data.mean(axis=0), data.std(axis=0), data.min(axis=0), data.max(axis=0),
                     (data == 0).mean(axis=0), (data == 255).mean(axis=0), steps]).T.ravel().tolist()


def timing_values(ts_us: np.ndarray) -> list[float]:
    """TIMING of the frames of one window in order; quantiles and moments are of the positive intervals."""
    n = len(ts_us)
    iat = np.diff(ts_us) / 1e6
    positive = iat[iat > 0]
    span = max(float(ts_us[-1] - ts_us[0]) / 1e6, 0.0)
    mean, std = (positive.mean(), positive.std()) if len(positive) else (0.0, 0.0)
    low, median, high = np.quantile(positive, [0.1, 0.5, 0.9]) if len(positive) else (0.0, 0.0, 0.0)
    burst = (positive <= max(0.25 * median, 1e-9)).sum() / max(len(positive), 1)
    return [*np.log1p(np.maximum([span, mean, std, median, low, high], 0.0) * 1e6).tolist(),
            float(np.log1p((n - 1) / max(span, 1e-6))), (iat <= 0).sum() / (n - 1), float(burst)]


class WindowCarry(StatefulProcessor):
    """Keeps the frames of unfinished windows and emits all features of a window once it is full.

    The key is (capture, group of neighbouring windows), so frames may arrive in any order, a long capture is
    spread and a key's fixed cost is shared by its windows. The timing quantiles need every interval, so the
    frames themselves, fewer than `size` a window, are the smallest exact state. A frame that comes again counts
    once. When a window is full its frames go and a mark stays, so what comes later opens no new window. When the
    watermark has passed the window's last event time by `wait_ms`, the mark goes too, or the unfinished window
    ends with a row that says how many frames it had.
    """

    def __init__(self, size: int, wait_ms: int, origin_us: int = 0):
        self.size, self.wait_ms, self.origin_us = size, wait_ms, origin_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value, so a key costs one read and one write: frames as packed longs, windows as packed (window, ends, emitted), next timer.
        self.state = handle.getValueState("windows", "frames binary, windows binary, timer bigint")

    def load(self):
        packed, marks, timer = self.state.get() or (b"", b"", None)
        frames = np.frombuffer(packed, np.int64).reshape(-1, len(FRAME) + 1)
        return frames, {int(w): (int(until), bool(done)) for w, until, done in np.frombuffer(marks, np.int64).reshape(-1, 3)}, timer

    def save(self, frames: np.ndarray, windows: dict[int, tuple[int, bool]], timer: int | None) -> None:
        """Writes the state with a timer at the end of the window that ends first."""
        if not windows:
            self.state.clear()
            return
        first = min(until for until, _ in windows.values())
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        marks = np.array([(w, until, done) for w, (until, done) in windows.items()], np.int64)
        self.state.update((frames.tobytes(), marks.tobytes(), timer))

    @staticmethod
    def parts(frames: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The frames of each window, from rows in the order of their windows."""
        windows, starts = np.unique(frames[:, 0], return_index=True)
        return zip(windows.tolist(), np.split(frames, starts[1:]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, windows, timer = self.load()
        done = [w for w, (_, emitted) in windows.items() if emitted]
        fresh = np.concatenate([pdf[["window_index", *FRAME]].to_numpy(np.int64) for pdf in rows])
        fresh = fresh[~np.isin(fresh[:, 0], done)]
        if not len(fresh):
            return
        frames = np.concatenate([frames, fresh])
        # By window, then seq; of a frame that came twice the first one stays, as lexsort keeps the order of arrival.
        frames = frames[np.lexsort((frames[:, 1], frames[:, 0]))]
        frames = frames[np.r_[True, (frames[1:, :2] != frames[:-1, :2]).any(axis=1)]]
        kept, out = [], []
        for window, own in self.parts(frames):
            full = len(own) >= self.size
            windows[window] = (int((own[:, -1].max() + self.origin_us) // 1000 + self.wait_ms), full)
            if full:
                values = [*structural_values(own[:, 2], own[:, 3:11]), *payload_values(own[:, 3:11]), *timing_values(own[:, -1])]
                out.append(self.row(key, window, "full", own, values))
            else:
                kept.append(own)
        self.save(np.concatenate(kept) if kept else frames[:0], windows, timer)
        if out:
            yield self.table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frames, windows, _ = self.load()
        passed = timerValues.getCurrentWatermarkInMs()
        ended = [w for w, (until, _) in windows.items() if until <= passed]
        gone = np.isin(frames[:, 0], ended)
        out = [self.row(key, window, "ended", own, None) for window, own in self.parts(frames[gone])] if gone.any() else []
        self.save(frames[~gone], {w: v for w, v in windows.items() if w not in set(ended)}, None)
        if out:
            yield self.table(out)

    @staticmethod
    def row(key, window: int, status: str, frames: np.ndarray, values: Sequence | None) -> tuple:
        return (key[0], window, status, len(frames), int(frames[0, 1]), int(frames[-1, 1]), int(frames[:, 11].sum()), values)

    @staticmethod
    def table(rows: Sequence[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["capture", "window_index", "status", "frames", "start_row", "end_row", "attack_frame_count", "features"])

    def close(self) -> None:
        pass


class OnlineMonitor(StatefulProcessor):
    """Hysteresis monitor and trust memory of one run; rows behind the last seen one are marked late.

    A run that is idle for `idle_ms` (a week) is forgotten.
    """

    def __init__(self, threshold: float, attack: int = 2, recovery: int = 3, memory: float = 0.65, initial: float = 0.80,
                 idle_ms: int = 7 * 24 * 3600 * 1000):
        self.threshold, self.attack, self.recovery = threshold, attack, recovery
        self.memory, self.initial, self.idle_ms = memory, initial, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last bigint, bad int, good int, active int, trust double", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, bad, good, active, trust = self.state.get() or (-1, 0, 0, 0, self.initial)
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, score, fused, cap in zip(batch["seq"], batch["score"], batch["fused"], batch["cap"]):
            if seq <= last:
                out.append((int(key[0]), int(seq), active, trust, 1))
                continue
            if score < self.threshold:
                bad, good = bad + 1, 0
                active = 1 if bad >= self.attack else active
            else:
                bad, good = 0, good + 1
                active = 0 if good >= self.recovery else active
            trust = min(self.memory * trust + (1.0 - self.memory) * min(fused, cap), cap)
            trust = max(0.0, min(1.0, trust))
            last = int(seq)
            out.append((int(key[0]), last, active, trust, 0))
        self.state.update((last, bad, good, active, trust))
        yield pd.DataFrame(out, columns=["run", "seq", "active", "trust", "late"])

    def close(self) -> None:
        pass


def stream_windows(frames: DataFrame, size: int, delay: str = "10 minutes", wait_ms: int = 60_000, origin_us: int = 0) -> DataFrame:
    """Windows of a stream of frames (capture, window_index and FRAME), with all FEATURES.

    Event time is origin_us + ts_us, in microseconds of the epoch, and must lie after its start. Frames later than `delay` behind the latest one may be dropped; a window ends
    `wait_ms` after that.
    """
    timed = frames.select("capture", F.floor(F.col("window_index") / TOGETHER).alias("window_group"), "window_index", *FRAME,
                          F.timestamp_micros(F.col("ts_us") + origin_us).alias("event_time"))
    out = timed.withWatermark("event_time", delay).groupBy("capture", "window_group").transformWithStateInPandas(
        statefulProcessor=WindowCarry(size, wait_ms, origin_us), outputStructType=WINDOW_OUTPUT, outputMode="Append", timeMode="EventTime")
    return out.select(*[c for c in out.columns if c != "features"], *[F.get("features", F.lit(i)).alias(f) for i, f in enumerate(FEATURES)])


def stream_monitor(rows: DataFrame, threshold: float) -> DataFrame:
    """Monitor state and trust of a stream of context rows (run, seq, score, fused, cap)."""
    return rows.groupBy("run").transformWithStateInPandas(
        statefulProcessor=OnlineMonitor(threshold), outputStructType=MONITOR_OUTPUT, outputMode="Append", timeMode="ProcessingTime")


def run_to_table(stream: DataFrame, folder: str, empty_batches: bool = True) -> str:
    """Drain the available input into a Parquet folder with a checkpoint beside it; a later call goes on from there.

    Batches without data let event time end windows. State that ends by the clock asks for such batches without
    end, so its streams are drained without them (`empty_batches` False); it ends with the next data.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    conf.set(key, str(empty_batches and before == "true").lower())
    try:  # the query takes its settings when it starts
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
                 .trigger(availableNow=True).start())
    finally:
        conf.set(key, before)
    query.awaitTermination()
    return f"{folder}/out"
