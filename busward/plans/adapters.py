"""The library's entities derived from the given tables: frames, timed frames, context rows, signals.

Every frame keeps an explicit sequence number. It is assigned in order-key buckets, so one capture
may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from busward.operators.ordering import number_rows
from busward.session import staged

KEY_BUCKET = 16_384
CLEAN_FRAMES = 500
HEALTHY = "N_F"
PAYLOAD = [f"d{i}" for i in range(8)]
FRAME_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
               "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
SIGNALS = 4


@dataclass(frozen=True)
class Tables:
    """The given tables of one folder and the entities derived from them."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def staged(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return staged(self.spark, self.folder, name, build)

    def frames(self) -> DataFrame:
        return frames_from_lineitem(self.read("lineitem"))

    def timed(self) -> DataFrame:
        return timed_from_events(self.read("events"))

    def context(self) -> DataFrame:
        return context_from_events(self.read("events"))

    def signals(self) -> DataFrame:
        return signals_from_lineitem(self.read("lineitem"))


def frames_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One bus message per line item: (capture, seq), ID, eight bytes, label, time in microseconds."""
    named = lineitem.select("*", F.concat_ws("_", "l_returnflag", "l_linestatus").alias("capture"))
    rows = number_rows(named, ["capture"], FRAME_ORDER, F.floor(F.col("l_orderkey") / KEY_BUCKET), rows=lineitem.count())
    density = F.element_at(F.array(*[F.lit(x) for x in (0, 3, 12, 45, 100)]),
                           (F.pmod(F.floor(F.col("seq") / 100), F.lit(5)) + 1).cast("int"))
    attack = ((F.col("capture") != HEALTHY) & (F.col("seq") >= CLEAN_FRAMES)
              & (F.col("seq") % 100 < density))
    raw = [
        F.col("l_partkey") % 256,
        F.col("l_quantity"),
        F.col("l_linenumber"),
        F.round(F.col("l_discount") * 100),
        F.round(F.col("l_tax") * 100),
        F.dayofmonth("l_shipdate"),
        F.col("l_orderkey") % 256,
        F.floor("l_extendedprice") % 256,
    ]
    jitter = F.col("l_partkey") % 400 - F.when(F.col("l_partkey") % 97 == 0, 1500).otherwise(0)
    return rows.withColumn("is_attack", attack.cast("int")).select(
        "capture", "seq",
        F.when(F.col("is_attack") == 1, 0).otherwise((F.col("l_suppkey") % 32).cast("int")).alias("can_id"),
        *[F.when(F.col("is_attack") == 1, 0).otherwise(x.cast("int")).alias(n) for n, x in zip(PAYLOAD, raw)],
        "is_attack",
        (F.col("seq") * 1000 + jitter).alias("ts_us"),
    )


def timed_from_events(events: DataFrame) -> DataFrame:
    """One timed frame per event; the event type is the capture."""
    base = events.select(
        F.col("event_type").alias("capture"), "event_id",
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("ts_us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    rows = number_rows(base, ["capture"], ["event_id"], F.floor(F.col("event_id") / KEY_BUCKET))
    return rows.select("capture", "seq", "event_id", "ts_us", (F.col("k") < 10).cast("int").alias("is_attack"))


def context_from_events(events: DataFrame) -> DataFrame:
    """One second of one run per event: evidence scores, failures, motion and ground truth."""
    base = events.select(
        F.col("user_id").alias("run"), "event_id", F.col("event_type").alias("phase"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
    )
    rows = number_rows(base, ["run"], ["event_id"], F.floor(F.col("event_id") / KEY_BUCKET))

    def score(factor: int):
        return ((F.col("k") * factor + F.col("event_id")) % 100) / F.lit(100.0)

    error = F.col("phase") == "error"
    rows = (rows.withColumn("ground_truth_attack", error.cast("int"))
            .withColumn("identity_failure", (error & (F.col("k") < 10)).cast("int"))
            .withColumn("device_failure", (error & (F.col("k") >= 90)).cast("int")))
    return rows.select(
        "run", "seq", "event_id", "phase", "k", "ground_truth_attack", "identity_failure", "device_failure",
        score(7).alias("gnss_score"), score(13).alias("v2x_score"), score(29).alias("can_score"),
        score(3).alias("sensor_score"),
        F.when(F.col("identity_failure") == 1, 0.02).otherwise(0.99).alias("identity_score"),
        F.when(F.col("device_failure") == 1, 0.08).otherwise(0.97).alias("device_score"),
        F.lit(1.0).alias("freshness_score"),
        (F.col("k") % 40 + 0.5 * (F.col("event_id") % 7)).alias("speed"),
        (((F.col("event_id") * 3 + F.col("k")) % 60) / F.lit(10.0) - 3.0).alias("acceleration"),
        ((F.col("event_id") * 37 + F.col("k") * 11) % 360).cast("double").alias("heading"),
    )


def signals_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """One decoded signal row per line item: twelve ambient captures and five attack captures."""
    ambient = F.col("l_linestatus") == "F"
    named = lineitem.select("*", F.when(
        ambient, F.concat(F.lit("ambient_"), F.col("l_orderkey") % 12)
    ).otherwise(F.concat(F.lit("attack_"), F.col("l_orderkey") % 5)).alias("capture"))
    rows = number_rows(named, ["capture"], [*FRAME_ORDER, "l_returnflag"],
                       F.floor(F.col("l_orderkey") / KEY_BUCKET), rows=lineitem.count())
    label = (~ambient & (F.col("seq") % 50 >= 30)).cast("int")
    can_id = F.when(~ambient & (F.col("l_partkey") % 50 == 0), F.lit(99)).otherwise(F.col("l_suppkey") % 10)
    rows = rows.withColumn("label", label).withColumn("can_id", can_id.cast("int"))
    hit = F.col("label") == 1
    return rows.select(
        "capture", "seq", (F.col("seq") / F.lit(100.0)).alias("time"), "can_id", "label",
        (F.col("l_quantity") * F.when(hit, 3.0).otherwise(1.0)).alias("s1"),
        (F.round(F.col("l_discount") * 100) + F.when(hit, 20.0).otherwise(0.0)).alias("s2"),
        F.when((F.col("can_id") % 3 != 0) | (F.col("l_partkey") % 40 == 0) & ~ambient,
               F.round(F.col("l_tax") * 100)).alias("s3"),
        F.when(F.col("can_id") % 2 == 0, F.col("l_extendedprice") / 1000.0).alias("s4"),
    )
