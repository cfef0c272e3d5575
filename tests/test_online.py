"""Windows of a stream: shuffled, split, repeated and late deliveries give the rows of the batch operators; the rest ends."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from busward.operators import windows
from busward.streaming import online

ORIGIN = 1_700_000_000_000_000


def recorded(n=210, seed=4):
    dice = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += dice.choice([-300, 0, 50, 1000, 900, 40_000])
        rows.append(("A" if i % 2 else "B", i // 2, dice.randrange(3), *[dice.choice([0, 255, dice.randrange(256)]) for _ in range(8)], dice.randrange(2), at))
    return rows


SCHEMA = "capture string, seq bigint, can_id int, " + ", ".join(f"d{i} int" for i in range(8)) + ", is_attack int, ts_us bigint"


def deliver(spark, folder, rows, **settings):
    """Appends rows as one file and drains the stream; returns all rows so far."""
    df = spark.createDataFrame(rows, SCHEMA).withColumn("window_index", F.floor(F.col("seq") / 20)).coalesce(1)
    df.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    out = online.run_to_table(online.stream_windows(stream, 20, origin_us=ORIGIN, **settings), str(folder))
    return spark.read.parquet(out).collect()


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    online.use_rocksdb(spark)


def test_deliveries_in_any_order(spark, tmp_path):
    rows = recorded()
    mixed = rows + rows[40:60]  # some frames come twice
    random.Random(1).shuffle(mixed)
    for part in (mixed[:70], mixed[70:90], mixed[90:]):
        got = deliver(spark, tmp_path, part, delay="1 hour")
    frames = spark.createDataFrame(rows, SCHEMA)
    batch = windows.window_features(frames, 20, payload=True).drop("attack_frame_count")
    timing = windows.timing_features(frames, 20).drop("start_row", "end_row", "attack_frame_count", "binary_target")
    want = {(r["capture"], r["window_index"]): r for r in batch.join(timing, ["capture", "window_index"]).collect()}
    assert len(got) == len(want) == 10 and all(r["status"] == "full" and r["frames"] == 20 for r in got)
    for r in got:
        same = want[r["capture"], r["window_index"]]
        assert (r["start_row"], r["end_row"]) == (same["start_row"], same["end_row"])
        assert [r[f] for f in online.FEATURES] == pytest.approx([same[f] for f in online.FEATURES], abs=1e-9)


def test_unfinished_windows_end_and_late_frames_open_none(spark, tmp_path):
    second = 1_000_000
    frame = lambda seq, ts: ("A", seq, 1, *[0] * 8, 1, ts)
    settings = {"delay": "10 seconds", "wait_ms": 5000}
    got = deliver(spark, tmp_path, [frame(i, i * 1000) for i in range(20)] + [frame(20 + i, 30_000 + i) for i in range(7)], **settings)
    assert [(r["window_index"], r["status"], r["frames"]) for r in got] == [(0, "full", 20)]
    got = deliver(spark, tmp_path, [frame(3, 3500), frame(200, 100 * second)], **settings)  # behind an emitted window, then far ahead
    got = deliver(spark, tmp_path, [frame(201, 101 * second)], **settings)
    ended = {(r["window_index"], r["status"]): r for r in got}
    assert sorted(ended) == [(0, "full"), (1, "ended")]
    assert ended[1, "ended"]["frames"] == 7 and ended[1, "ended"]["id_entropy"] is None and ended[1, "ended"]["attack_frame_count"] == 7
    got = deliver(spark, tmp_path, [frame(4, 4000), frame(30, 40_000), frame(202, 200 * second)], **settings)  # late: dropped
    got = deliver(spark, tmp_path, [frame(400, 400 * second)], **settings)
    assert sorted((r["window_index"], r["status"], r["frames"]) for r in got) == [(0, "full", 20), (1, "ended", 7), (10, "ended", 3)]


def test_windows_of_one_group_end_apart(spark, tmp_path):
    """A later delivery brings a window of the same group that ends before the one the timer was set for."""
    second = 1_000_000
    frame = lambda seq, ts: ("A", seq, 1, *[0] * 8, 0, ts)
    settings = {"delay": "10 seconds", "wait_ms": 5000}
    deliver(spark, tmp_path, [frame(25, 9 * second)], **settings)
    deliver(spark, tmp_path, [frame(45, 1 * second), frame(5000, 17 * second)], **settings)
    got = deliver(spark, tmp_path, [frame(5001, 18 * second)], **settings)
    assert [(r["window_index"], r["status"]) for r in got] == [(2, "ended")]
    deliver(spark, tmp_path, [frame(5002, 40 * second)], **settings)
    got = deliver(spark, tmp_path, [frame(5003, 41 * second)], **settings)
    assert sorted((r["window_index"], r["start_row"], r["frames"]) for r in got) == [(1, 25, 1), (2, 45, 1)]


def test_monitor_drains(spark, tmp_path):
    """State that ends by the clock must not keep a drained stream going."""
    rows = [(run, seq, 0.1 if seq in (2, 3) else 0.9, 0.9, 1.0) for run in (1, 2) for seq in range(8)]
    schema = "run bigint, seq bigint, score double, fused double, cap double"
    own = spark.newSession()  # a stream that does not end is stopped with its session's streams
    online.use_rocksdb(own)
    for part in (rows[:6], rows[6:]):
        own.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = online.stream_monitor(own.readStream.schema(schema).parquet(f"{tmp_path}/in"), 0.3)
        worker = threading.Thread(target=online.run_to_table, args=(stream, str(tmp_path), False))
        worker.start()
        worker.join(90)
        ended = not worker.is_alive()
        for query in own.streams.active:
            query.stop()
        worker.join(60)
        assert ended
    got = {(r["run"], r["seq"]): (r["active"], r["late"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(run, seq): (int(3 <= seq <= 5), 0) for run in (1, 2) for seq in range(8)}
