"""Count windows over bus frames and their features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from busward.functions.columns import density_band, safe_divide
from busward.operators.ordering import dealt, number_rows

BYTES = tuple(f"d{i}" for i in range(8))
STRUCTURAL = (
    "id_unique_count", "id_entropy", "dominant_id_fraction", "frame_unique_count",
    "frame_unique_fraction", "id_change_rate", "consecutive_frame_repeat_rate",
)
TIMING = (
    "log_window_span_us", "log_iat_mean_us", "log_iat_std_us", "log_iat_median_us", "log_iat_p10_us",
    "log_iat_p90_us", "log_message_rate_hz", "iat_nonpositive_fraction", "iat_burst_fraction",
)
PAYLOAD_STATS = ("mean", "std", "min", "max", "zero_fraction", "ff_fraction", "mean_abs_change")
PAYLOAD = tuple(f"data_{i}_{s}" for i in range(8) for s in PAYLOAD_STATS)


def with_window(frames: DataFrame, size: int, seq: str = "seq") -> DataFrame:
    return frames.withColumn("window_index", F.floor(F.col(seq) / size).cast("bigint"))


def window_spans(frames: DataFrame, size: int, keys: Sequence[str] = ("capture",)) -> DataFrame:
    """Full windows with their first and last row and the frames left over at the end of the capture."""
    spans = with_window(frames, size).groupBy(*keys, "window_index").agg(F.count(F.lit(1)).alias("frames"))
    tail = spans.groupBy(*keys).agg(
        F.sum(F.when(F.col("frames") < size, F.col("frames")).otherwise(0)).alias("discarded_tail"))
    return spans.where(F.col("frames") == size).join(tail, list(keys)).select(
        *keys, "window_index", (F.col("window_index") * size).alias("start_row"),
        ((F.col("window_index") + 1) * size - 1).alias("end_row"), "discarded_tail")


def time_ordered(frames: DataFrame, keys: Sequence[str], time: str, row: str, bucket: Column,
                 into: str = "time_seq") -> DataFrame:
    """Sequence by time, the source row deciding ties."""
    return number_rows(frames, keys, [time, row], bucket, into)


def window_features(frames: DataFrame, size: int, payload: bool = False,
                    keys: Sequence[str] = ("capture",), rows: int | None = None) -> DataFrame:
    """Structural (and payload) features, labels and positions of full windows.

    One shuffle on (keys, window): the three aggregation levels below it share that partitioning. `rows`, the
    number of frames, keeps the frames of a task near one number whatever the size of the captures.
    """
    group = [*keys, "window_index"]
    order = Window.partitionBy(*group).orderBy("seq")
    last = {c: F.lag(c).over(order) for c in ("can_id", *BYTES)}
    frames = dealt(with_window(frames, size), group, rows).withColumns({f"_p_{n}": v for n, v in last.items()})
    same_id = F.col("can_id") == F.col("_p_can_id")
    same_all = same_id
    for b in BYTES:
        same_all = same_all & (F.col(b) == F.col(f"_p_{b}"))
    marks = {"_changed": F.when(~same_id, 1).otherwise(0), "_repeated": F.when(same_all, 1).otherwise(0),
             "_attack": F.col("is_attack")}
    if payload:
        marks |= {f"_step_{b}": F.coalesce(F.abs(F.col(b) - F.col(f"_p_{b}")), F.lit(0)) for b in BYTES}
    distinct = frames.groupBy(*group, "can_id", *BYTES).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(m).alias(n) for n, m in marks.items()])
    per_id = [F.sum("_n").alias("_id_n"), F.count(F.lit(1)).alias("_frames"),
              *[F.sum(n).alias(n) for n in marks]]
    if payload:
        for b in BYTES:
            per_id += [
                F.sum(F.col(b) * F.col("_n")).alias(f"_sum_{b}"),
                F.sum(F.col(b) * F.col(b) * F.col("_n")).alias(f"_sq_{b}"),
                F.min(b).alias(f"_min_{b}"), F.max(b).alias(f"_max_{b}"),
                F.sum(F.when(F.col(b) == 0, F.col("_n")).otherwise(0)).alias(f"_zero_{b}"),
                F.sum(F.when(F.col(b) == 255, F.col("_n")).otherwise(0)).alias(f"_ff_{b}"),
            ]
    ids = distinct.groupBy(*group, "can_id").agg(*per_id)
    n = float(size)
    whole = [
        F.sum("_id_n").alias("_rows"), F.count(F.lit(1)).alias("id_unique_count"),
        F.array_sort(F.collect_list("_id_n")).alias("_counts"),
        (F.max("_id_n") / n).alias("dominant_id_fraction"), F.sum("_frames").alias("frame_unique_count"),
        (F.sum("_frames") / n).alias("frame_unique_fraction"),
        (F.sum("_changed") / (n - 1)).alias("id_change_rate"),
        (F.sum("_repeated") / (n - 1)).alias("consecutive_frame_repeat_rate"),
        F.sum("_attack").alias("attack_frame_count"),
    ]
    if payload:
        for i, b in enumerate(BYTES):
            total, square = F.sum(f"_sum_{b}"), F.sum(f"_sq_{b}")
            spread = (size * square - total * total) / (n * n)
            whole += [x.alias(f"data_{i}_{s}") for s, x in zip(PAYLOAD_STATS, (
                total / n, F.sqrt(spread), F.min(f"_min_{b}"), F.max(f"_max_{b}"),
                F.sum(f"_zero_{b}") / n, F.sum(f"_ff_{b}") / n, F.sum(f"_step_{b}") / (n - 1)))]
    out = ids.groupBy(*group).agg(*whole).where(F.col("_rows") == size)
    entropy = F.aggregate("_counts", F.lit(0.0), lambda acc, c: acc - c / n * F.log2(c / n))
    return out.withColumn("id_entropy", entropy).select(
        *group, (F.col("window_index") * size).alias("start_row"),
        ((F.col("window_index") + 1) * size - 1).alias("end_row"),
        *STRUCTURAL, *(PAYLOAD if payload else ()),
        "attack_frame_count", (F.col("attack_frame_count") / n).alias("attack_frame_fraction"),
        (F.col("attack_frame_count") > 0).cast("int").alias("binary_target"),
        density_band(F.col("attack_frame_count")).alias("density_band"))


def timing_features(frames: DataFrame, size: int = 20, keys: Sequence[str] = ("capture",), rows: int | None = None) -> DataFrame:
    """Nine timing features per window; at most size-1 intervals are gathered per window. `rows` is as in window_features."""
    group = [*keys, "window_index"]
    order = Window.partitionBy(*group).orderBy("seq")
    timed = dealt(with_window(frames, size), group, rows).withColumn(
        "_iat", (F.col("ts_us") - F.lag("ts_us").over(order)) / F.lit(1e6))
    gathered = timed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("is_attack").alias("attack_frame_count"),
        ((F.max_by("ts_us", "seq") - F.min_by("ts_us", "seq")) / F.lit(1e6)).alias("_span"),
        F.sum(F.when(F.col("_iat") <= 0, 1).otherwise(0)).alias("_nonpositive"),
        F.array_sort(F.collect_list(F.when(F.col("_iat") > 0, F.col("_iat")))).alias("_iats"),
    ).where(F.col("_rows") == size)
    count = F.size("_iats")
    none = count == 0
    mean = F.aggregate("_iats", F.lit(0.0), lambda a, x: a + x) / F.greatest(count, F.lit(1))
    gathered = gathered.withColumn("_mean", mean)
    std = F.sqrt(F.aggregate("_iats", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean")))
                 / F.greatest(count, F.lit(1)))

    def at(p: float) -> Column:
        where = (count - 1) * F.lit(p)
        low = F.get("_iats", F.floor(where).cast("int"))
        high = F.get("_iats", F.ceil(where).cast("int"))
        return F.when(none, 0.0).otherwise(low + (high - low) * (where - F.floor(where)))

    gathered = gathered.withColumn("_median", at(0.5))
    burst = F.size(F.filter("_iats", lambda x: x <= F.greatest(0.25 * F.col("_median"), F.lit(1e-9))))
    span = F.greatest(F.col("_span"), F.lit(0.0))

    def log_us(x: Column) -> Column:
        return F.log1p(F.greatest(x, F.lit(0.0)) * 1e6)

    values = (log_us(span), log_us(F.col("_mean")), log_us(std), log_us(F.col("_median")), log_us(at(0.1)),
              log_us(at(0.9)), F.log1p((size - 1) / F.greatest(span, F.lit(1e-6))),
              F.col("_nonpositive") / F.lit(size - 1.0), burst / F.greatest(count, F.lit(1)))
    return gathered.select(
        *group, (F.col("window_index") * size).alias("start_row"),
        ((F.col("window_index") + 1) * size - 1).alias("end_row"),
        *[v.alias(n) for n, v in zip(TIMING, values)], "attack_frame_count",
        (F.col("attack_frame_count") > 0).cast("int").alias("binary_target"))


def phase_tag(frames: DataFrame, intervals: DataFrame, time: str, key: str = "capture") -> DataFrame:
    """Mark frames inside the closed interval of their capture.

    `intervals` has one row per capture (key, interval_start, interval_end, role). A null interval is
    the whole capture; an ambient capture is never in phase.
    """
    joined = frames.join(intervals, key, "left")
    inside = F.col(time).between(F.col("interval_start"), F.col("interval_end"))
    return joined.withColumn("in_phase", F.when(F.coalesce(F.col("role"), F.lit("ambient")) == "ambient", 0)
                             .when(F.col("interval_start").isNull(), 1)
                             .otherwise(inside.cast("int")))


def step_phase(step: Column, phases: Sequence[tuple[int, int, str]], default: str) -> Column:
    """Phase of a step in half-open ranges."""
    out = None
    for start, end, name in phases:
        hit = (step >= start) & (step < end)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def signature_match(can_id: Column, payload_hex: Column, injection_id: Column, mask: Column) -> Column:
    """Injected-frame signature: equal ID (or wildcard) and every hex digit the mask does not hide."""
    padded = F.substring(F.rpad(F.upper(payload_hex), 16, "0"), 1, 16)
    wildcard = injection_id.isNull() | (F.upper(injection_id) == "XXX")
    same_id = wildcard | (can_id == F.conv(injection_id, 16, 10).cast("bigint"))
    pattern = F.concat(F.lit("^"), F.replace(F.upper(mask), F.lit("X"), F.lit(".")), F.lit("$"))
    hit = F.rlike(padded, pattern)
    return (mask.isNotNull() & (F.length(mask) == 16) & same_id & hit).cast("int")


def capture_family(name: Column, modified: Column) -> Column:
    return (
        F.when(name.startswith("accelerator_attack"), "accelerator_compromised_state")
        .when(F.coalesce(modified, F.lit(False)) | name.endswith("_masquerade"), "masquerade")
        .when(name.startswith("fuzzing_attack"), "fabrication_fuzzing")
        .otherwise("fabrication_targeted")
    )


def signal_family(name: Column) -> Column:
    """Family of a decoded-signal attack capture by its name."""
    # Name prefixes of the known attack families.
    prefixes = ("correlated_signal", "max_engine_coolant", "max_speedometer",
                "reverse_light_off", "reverse_light_on")
    out = F.when(name.startswith("accelerator_attack"), "accelerator_compromised_state")
    for prefix in prefixes:
        out = out.when(name.startswith(prefix), f"{prefix}_masquerade")
    return out.otherwise("other_signal_attack")


def rollup_to_parent(micro: DataFrame, flags: Sequence[str], maxima: Sequence[str] = (), means: Sequence[str] = (),
                     minima: Sequence[str] = (), parent_size: int = 100, per_parent: int = 5,
                     keys: Sequence[str] = ("capture",)) -> DataFrame:
    """Micro windows to their parent window; parents without all micro windows are dropped."""
    named = micro.withColumn("parent_window_index", F.floor(F.col("start_row") / parent_size).cast("bigint"))
    return named.groupBy(*keys, "parent_window_index").agg(
        F.count(F.lit(1)).alias("micro_windows"), F.sum("attack_frame_count").alias("micro_attack_frames"),
        *[F.max(f).alias(f"any_{f}") for f in flags],
        *[F.max(c).alias(f"{c}_max") for c in maxima],
        *[F.avg(c).alias(f"{c}_mean") for c in means],
        *[F.min(c).alias(f"{c}_min") for c in minima],
    ).where(F.col("micro_windows") == per_parent)


def content_hash(frames: DataFrame, size: int, line: Column, into: str, keys: Sequence[str] = ("capture",)) -> DataFrame:
    """SHA-256 over the ordered lines of each full window, every line closed by a newline."""
    named = with_window(frames, size).withColumn("_line", line)
    packed = named.groupBy(*keys, "window_index").agg(
        F.count(F.lit(1)).alias("_rows"), F.array_sort(F.collect_list(F.struct("seq", "_line"))).alias("_lines"))
    text = F.concat(F.concat_ws("\n", F.col("_lines._line")), F.lit("\n"))
    return packed.where(F.col("_rows") == size).select(*keys, "window_index", F.sha2(text, 256).alias(into))


def overlap_count(spans: DataFrame, size: int, keys: Sequence[str] = ("capture",)) -> DataFrame:
    """Windows that start before the previous one ends; the neighbour is found by its index."""
    before = spans.select(*keys, (F.col("window_index") + 1).alias("window_index"), F.col("end_row").alias("_end"))
    joined = spans.join(before, [*keys, "window_index"], "left")
    return joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.when(F.col("start_row") <= F.col("_end"), 1).otherwise(0)).alias("overlapping_windows"))


def score_reducers(rows: DataFrame, size: int, scores: Sequence[str], top: int = 3,
                   keys: Sequence[str] = ("capture",)) -> DataFrame:
    """q95, maximum and mean of the top scores of each full window of rows, with label shares."""
    packed = with_window(rows, size).groupBy(*keys, "window_index").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("label").alias("attack_target"),
        F.avg("label").alias("attack_row_fraction"), F.avg("unknown_signal").alias("unknown_signal_fraction"),
        *[F.percentile(s, F.lit(0.95)).alias(f"{s}_q95") for s in scores],
        *[F.max(s).alias(f"{s}_max") for s in scores],
        *[F.slice(F.sort_array(F.collect_list(s), asc=False), 1, top).alias(f"_top_{s}") for s in scores],
    ).where(F.col("_rows") == size)
    for s in scores:
        packed = packed.withColumn(f"{s}_top{top}_mean", F.aggregate(
            f"_top_{s}", F.lit(0.0), lambda a, x: a + x) / F.size(f"_top_{s}"))
    return packed.drop("_rows", *[f"_top_{s}" for s in scores])


def family_sets(frames: DataFrame, size: int, family: str, normal: str, keys: Sequence[str] = ("capture",)) -> DataFrame:
    """Attack families of each full window and whether one family has it alone."""
    named = with_window(frames, size)
    return named.groupBy(*keys, "window_index").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.array_sort(F.collect_set(F.when(F.col(family) != normal, F.col(family)))).alias("_set"),
    ).where(F.col("_rows") == size).select(
        *keys, "window_index",
        F.when(F.size("_set") == 0, "benign").otherwise(F.array_join("_set", "|")).alias("attack_families"),
        F.size("_set").alias("attack_family_count"),
        (F.size("_set") == 1).cast("int").alias("exclusive_family"))


def pseudo_sessions(windows: DataFrame, session_size: int, healthy: str, key: str = "capture") -> DataFrame:
    """Session names: blocks of the attack-free capture (the remainder is dropped), else the capture itself."""
    total = windows.where(F.col(key) == healthy).agg(F.count(F.lit(1)).alias("n")).scalar()
    block = F.floor(F.col("window_index") / session_size)
    is_healthy = F.col(key) == healthy
    return windows.where(~is_healthy | (block < F.floor(total / session_size))).select(
        "*",
        F.when(is_healthy, F.concat_ws("#", F.col(key), block.cast("string"))).otherwise(F.col(key)).alias("session_id"),
        F.when(is_healthy, F.pmod(F.col("window_index"), F.lit(session_size)))
        .otherwise(F.col("window_index")).alias("session_position"),
        F.when(is_healthy, block).alias("session_block"),
        F.when(is_healthy, F.floor(total / session_size)).alias("session_blocks"))


def baseline_audit(sessions: DataFrame, k: int) -> DataFrame:
    """Rows and attack frames inside and after the trusted baseline of each session."""
    inside = F.col("session_position") < k
    return sessions.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.sum(inside.cast("int")).alias("bootstrap_windows"),
        F.sum((~inside).cast("int")).alias("evaluated_windows"),
        F.sum(F.when(inside, F.col("binary_target")).otherwise(0)).alias("bootstrap_attack_windows"),
        F.sum(F.when(inside, F.col("attack_frame_count")).otherwise(0)).alias("bootstrap_attack_frames"))


def density_table(windows: DataFrame, keys: Sequence[str] = ("capture",)) -> DataFrame:
    return windows.groupBy(*keys, "density_band").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("attack_frame_count").alias("attack_frames"),
        safe_divide(F.sum("attack_frame_count"), F.count(F.lit(1))).alias("attack_frames_mean"))
