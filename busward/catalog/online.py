"""Streaming queries: the given tables arrive in several files and are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from busward.catalog.frames import timing_ctes
from busward.catalog.registry import query
from busward.catalog.sources import folder
from busward.operators import policy, windows
from busward.plans import replay
from busward.streaming import online


def drained(t, df, order, keys, name, process, parts=3, empty_batches=True):
    """The table arrives in `parts` deliveries of many files each; the stream drains each before the next comes."""
    source, target = folder(t, name), folder(t, f"{name}_out")
    for i in range(parts):
        df.where(F.pmod(order, F.lit(parts)) == i).repartition(*keys).write.mode("append").parquet(source)
        out = online.run_to_table(process(t.spark.readStream.schema(df.schema).parquet(source)), target, empty_batches)
    return t.spark.read.parquet(out)


timing_ctes("frame_", "frames")
# Frames carry times from 0 on; the recording begins with 2024.
ORIGIN_US = 1_704_067_200_000_000
ALL_FEATURES = (*windows.STRUCTURAL, *windows.PAYLOAD, *windows.TIMING)


def streamed_windows(t, size):
    """The windows of all frames, delivered in three shuffled parts that cut every window; the delay is the whole recording."""
    online.use_rocksdb(t.spark)
    frames = t.frames().select("capture", F.floor(F.col("seq") / size).alias("window_index"), *online.FRAME)
    return drained(t, frames, F.col("seq"), ["capture", "window_index"], "stream_frames",
                   lambda s: online.stream_windows(s, size, "365 days", origin_us=ORIGIN_US)).where(F.col("status") == "full")


@query("t13_streaming_windows", "capture window_index:i start_row:i end_row:i attack_frame_count:i " + " ".join(f"{f}:d" for f in ALL_FEATURES),
       "SELECT w.*, t.* EXCLUDE (capture, window_index, start_row, attack_frame_count, binary_target) FROM w20 w JOIN frame_t20 t ON w.capture = t.capture AND w.window_index = t.window_index")
def t13(t):
    return streamed_windows(t, 20)


@query("t3_streaming_monitor", "run:i seq:i active:i trust:d late:i",
       "SELECT m.run, m.seq, m_gnss AS active, continuous_trust AS trust, 0 AS late FROM mon_active m JOIN trust_walk w ON w.run = m.run AND w.seq = m.seq")
def t3_stream(t):
    online.use_rocksdb(t.spark)
    context = t.context()
    cap = F.coalesce(policy.failure_cap(F.col("identity_failure"), F.col("device_failure")), F.lit(1.0))
    rows = context.select("run", "seq", F.col("gnss_score").alias("score"), policy.fuse(replay.evidence(context)).alias("fused"), cap.alias("cap"))
    delivery = F.least(F.floor(F.col("seq") / 25), F.lit(2))
    return drained(t, rows, delivery, ["run"], "stream_context", lambda s: online.stream_monitor(s, 0.30),
                   empty_batches=False)
