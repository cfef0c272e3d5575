"""Queries over frames, windows and the gates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from busward.catalog.registry import cte, query
from busward.operators import metrics, windows
from busward.plans import can_gate
from busward.plans.adapters import CLEAN_FRAMES, HEALTHY, PAYLOAD

ORDER = ("l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
         "l_shipdate")

cte(
    frames_raw=f"""SELECT *, l_returnflag || '_' || l_linestatus AS capture,
  row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {ORDER}) - 1 AS seq FROM lineitem""",
    frames_marked=f"""SELECT *, CASE WHEN capture <> '{HEALTHY}' AND seq >= {CLEAN_FRAMES}
  AND seq % 100 < [0, 3, 12, 45, 100][((seq // 100) % 5) + 1] THEN 1 ELSE 0 END AS is_attack FROM frames_raw""",
    frames="""SELECT capture, seq, is_attack,
  CASE WHEN is_attack = 1 THEN 0 ELSE l_suppkey % 32 END AS can_id,
  CASE WHEN is_attack = 1 THEN 0 ELSE l_partkey % 256 END AS d0,
  CASE WHEN is_attack = 1 THEN 0 ELSE l_quantity::INTEGER END AS d1,
  CASE WHEN is_attack = 1 THEN 0 ELSE l_linenumber END AS d2,
  CASE WHEN is_attack = 1 THEN 0 ELSE round(l_discount * 100)::INTEGER END AS d3,
  CASE WHEN is_attack = 1 THEN 0 ELSE round(l_tax * 100)::INTEGER END AS d4,
  CASE WHEN is_attack = 1 THEN 0 ELSE day(l_shipdate) END AS d5,
  CASE WHEN is_attack = 1 THEN 0 ELSE l_orderkey % 256 END AS d6,
  CASE WHEN is_attack = 1 THEN 0 ELSE floor(l_extendedprice)::BIGINT % 256 END AS d7,
  seq * 1000 + l_partkey % 400 - CASE WHEN l_partkey % 97 = 0 THEN 1500 ELSE 0 END AS ts_us
  FROM frames_marked""",
    timed="""SELECT event_type AS capture, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS seq,
  event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS ts_us,
  CASE WHEN regexp_extract(props, '([0-9]+)', 1)::INTEGER < 10 THEN 1 ELSE 0 END AS is_attack FROM events""",
)

_SAME = " AND ".join(f"{c} = lag({c}) OVER w" for c in ("can_id", *PAYLOAD))


def window_ctes(size: int, prefix: str = "", table: str = "frames") -> None:
    """Window features of `size` frames of a table of frames, as <prefix>w<size>."""
    n = f"{size}e0"
    stats = ", ".join(
        f"avg({b}) AS data_{i}_mean, stddev_pop({b}) AS data_{i}_std, min({b}) AS data_{i}_min, "
        f"max({b}) AS data_{i}_max, sum(CASE WHEN {b} = 0 THEN 1 ELSE 0 END) / {n} AS data_{i}_zero_fraction, "
        f"sum(CASE WHEN {b} = 255 THEN 1 ELSE 0 END) / {n} AS data_{i}_ff_fraction, "
        f"sum(step_{b}) / {size - 1}e0 AS data_{i}_mean_abs_change" for i, b in enumerate(PAYLOAD))
    steps = ", ".join(f"abs({b} - lag({b}) OVER w) AS step_{b}" for b in PAYLOAD)
    cte(**{
        f"{prefix}lag{size}": f"""SELECT *, seq // {size} AS window_index,
  CASE WHEN can_id <> lag(can_id) OVER w THEN 1 ELSE 0 END AS changed,
  CASE WHEN {_SAME} THEN 1 ELSE 0 END AS repeated, {steps}
  FROM {table} WINDOW w AS (PARTITION BY capture, seq // {size} ORDER BY seq)""",
        f"{prefix}ids{size}": f"""SELECT capture, window_index, max(c) / {n} AS dominant_id_fraction,
  sum(-(c / {n}) * log2(c / {n})) AS id_entropy, count(*) AS id_unique_count
  FROM (SELECT capture, window_index, can_id, count(*) AS c FROM {prefix}lag{size} GROUP BY ALL) GROUP BY ALL""",
        f"{prefix}base{size}": f"""SELECT capture, window_index, count(*) AS n_rows,
  count(DISTINCT (can_id, {', '.join(PAYLOAD)})) AS frame_unique_count,
  sum(changed) / {size - 1}e0 AS id_change_rate, sum(repeated) / {size - 1}e0 AS consecutive_frame_repeat_rate,
  sum(is_attack) AS attack_frame_count, {stats}
  FROM {prefix}lag{size} GROUP BY capture, window_index HAVING count(*) = {size}""",
        f"{prefix}w{size}": f"""SELECT *, frame_unique_count / {n} AS frame_unique_fraction, window_index * {size} AS start_row,
  (window_index + 1) * {size} - 1 AS end_row, attack_frame_count / {n} AS attack_frame_fraction,
  CASE WHEN attack_frame_count > 0 THEN 1 ELSE 0 END AS binary_target,
  CASE WHEN attack_frame_count = 0 THEN 'benign' WHEN attack_frame_count <= 5 THEN 'low_1_5'
    WHEN attack_frame_count <= 20 THEN 'medium_6_20' ELSE 'high_21_100' END AS density_band
  FROM {prefix}base{size} JOIN {prefix}ids{size} USING (capture, window_index)""",
    })


window_ctes(20)
window_ctes(100)

_STRUCT = " ".join(f"{f}:d" for f in windows.STRUCTURAL)
_PAYLOAD = " ".join(f"{f}:d" for f in windows.PAYLOAD)
_linear = f"{can_gate.INTERCEPT}e0" + "".join(
    f" + {f} * ({w}e0)" for f, w in zip(windows.STRUCTURAL, can_gate.WEIGHTS))
cte(p100=f"""SELECT *, ln(least(greatest(p, 1e-12), 1e0 - 1e-12) / (1e0 - least(greatest(p, 1e-12), 1e0 - 1e-12)))
  AS identifier_log_odds, p AS attack_probability FROM (SELECT *, 1e0 / (1e0 + exp(-({_linear}))) AS p FROM w100)""")


def gate_ctes(name: str, table: str, floors: dict[str, float], boot: int, session: int, fpr: float) -> None:
    feats = list(floors)
    place = len(feats) - 1
    pos = 0.75 * place
    low, high = int(pos) + 1, int(-(-pos // 1)) + 1
    parts = ", ".join(f"median({f}) AS c_{f}" for f in feats)
    mads = ", ".join(f"1.4826e0 * median(abs({f} - c_{f})) AS m_{f}" for f in feats)
    gm = ", ".join(f"median({f}) AS g_{f}" for f in feats)
    gs = ", ".join(f"greatest(0.25e0 * (1.4826e0 * median(abs({f} - g_{f}))), {v}e0) AS l_{f}" for f, v in floors.items())
    z = ", ".join(f"abs({f} - c_{f}) / greatest(greatest(m_{f}, l_{f}), 1e-12)" for f in feats)
    cte(**{
        f"{name}_sessions": f"""SELECT *, CASE WHEN capture = '{HEALTHY}' THEN capture || '#' || (window_index // {session})
    ELSE capture END AS session_id,
  CASE WHEN capture = '{HEALTHY}' THEN window_index % {session} ELSE window_index END AS session_position,
  CASE WHEN capture = '{HEALTHY}' THEN window_index // {session} END AS session_block,
  CASE WHEN capture = '{HEALTHY}' THEN (SELECT count(*) FROM {table} WHERE capture = '{HEALTHY}') // {session} END
    AS session_blocks
  FROM {table} WHERE capture <> '{HEALTHY}' OR window_index // {session} <
    (SELECT count(*) FROM {table} WHERE capture = '{HEALTHY}') // {session}""",
        f"{name}_center": f"SELECT session_id, {parts} FROM {name}_sessions WHERE session_position < {boot} GROUP BY 1",
        f"{name}_scale": f"""SELECT session_id, {mads} FROM {name}_sessions JOIN {name}_center USING (session_id)
  WHERE session_position < {boot} GROUP BY 1""",
        f"{name}_gm": f"SELECT {gm} FROM {table} WHERE capture = '{HEALTHY}'",
        f"{name}_floor": f"SELECT {gs} FROM {table}, {name}_gm WHERE capture = '{HEALTHY}'",
        f"{name}_scored": f"""SELECT session_id, capture, window_index, session_position, start_row, binary_target,
  attack_frame_count, CASE WHEN session_block IS NULL THEN 'attack_capture'
    WHEN session_block < session_blocks // 2 THEN 'calibration' ELSE 'holdout' END AS role,
  z[{low}] + (z[{high}] - z[{low}]) * {pos - int(pos)}e0 AS deviation
  FROM (SELECT *, list_sort([{z}]) AS z FROM {name}_sessions JOIN {name}_center USING (session_id)
    JOIN {name}_scale USING (session_id), {name}_floor WHERE session_position >= {boot})""",
        f"{name}_limit": f"""SELECT quantile_cont(deviation, {1.0 - fpr!r}::DOUBLE) AS threshold FROM {name}_scored
  WHERE role = 'calibration'""",
        f"{name}_instant": f"""SELECT *, CASE WHEN deviation >= threshold THEN 1 ELSE 0 END AS alarm_instant
  FROM {name}_scored, {name}_limit""",
        f"{name}_gate": f"""SELECT *, alarm_instant * lag(alarm_instant, 1, 0) OVER
    (PARTITION BY session_id ORDER BY session_position) AS alarm_persistent_2,
  1e0 / (1e0 + (deviation / greatest(threshold, 1e-12)) * (deviation / greatest(threshold, 1e-12))) AS can_trust
  FROM {name}_instant""",
    })


gate_ctes("micro", "w20", can_gate.STRUCTURAL_FLOORS, can_gate.MICRO_BOOT, can_gate.MICRO_SESSION, 0.01)
gate_ctes("parent", "p100", can_gate.LOG_ODDS_FLOOR, can_gate.PARENT_BOOT, can_gate.PARENT_SESSION, 0.05)
cte(
    rolled="""SELECT capture, start_row // 100 AS parent_window_index, count(*) AS micro_windows,
  sum(attack_frame_count) AS micro_attack_frames, max(alarm_instant) AS any_alarm_instant,
  max(alarm_persistent_2) AS any_alarm_persistent_2, max(deviation) AS deviation_max, avg(deviation) AS deviation_mean,
  min(can_trust) AS can_trust_min FROM micro_gate GROUP BY 1, 2 HAVING count(*) = 5""",
    parents="""SELECT r.*, p.role, p.binary_target, p.attack_frame_count, p.alarm_instant AS w100_instant,
  p.alarm_persistent_2 AS w100_persistent_2, p.can_trust AS w100_trust,
  greatest(p.alarm_instant, any_alarm_instant) AS multi_instant,
  greatest(p.alarm_persistent_2, any_alarm_persistent_2) AS multi_persistent_2,
  least(p.can_trust, can_trust_min) AS multi_trust
  FROM rolled r JOIN parent_gate p ON r.capture = p.capture AND r.parent_window_index = p.window_index""",
)

COUNTS = """sum(CASE WHEN {t} = 1 AND {a} = 1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN {t} = 0 AND {a} = 1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN {t} = 0 AND {a} = 0 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN {t} = 1 AND {a} = 0 THEN 1 ELSE 0 END) AS fn"""


def counts_sql(truth: str, alarm: str) -> str:
    return COUNTS.format(t=truth, a=alarm)


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0e0 ELSE ({a})::DOUBLE / ({b}) END)"


RATES_SQL = f"""{div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall,
  {div('2e0 * ' + div('tp', 'tp + fp') + ' * ' + div('tp', 'tp + fn'), div('tp', 'tp + fp') + ' + ' + div('tp', 'tp + fn'))} AS f1,
  {div('fp', 'fp + tn')} AS false_positive_rate, {div('fn', 'fn + tp')} AS false_negative_rate,
  {div('tp + tn', 'tp + fp + tn + fn')} AS accuracy"""
RATE_COLUMNS = "precision:d recall:d f1:d false_positive_rate:d false_negative_rate:d accuracy:d"


def rates_sql(inner: str) -> str:
    return f"SELECT *, {RATES_SQL} FROM ({inner})"


@query("session_gate_metrics", f"capture method tp:i fp:i tn:i fn:i {RATE_COLUMNS}",
       rates_sql(f"SELECT capture, 'instant' AS method, {counts_sql('binary_target', 'alarm_instant')} "
                 "FROM micro_gate WHERE role <> 'calibration' GROUP BY 1 UNION ALL "
                 f"SELECT capture, 'persistent_2', {counts_sql('binary_target', 'alarm_persistent_2')} "
                 "FROM micro_gate WHERE role <> 'calibration' GROUP BY 1"))
def session_gate_metrics(t):
    gated = can_gate.micro_gate(t).where(F.col("role") != "calibration")
    return metrics.with_rates(metrics.confusion(
        gated, ["capture"], "binary_target",
        {"instant": "alarm_instant", "persistent_2": "alarm_persistent_2"}))


@query("frames", "capture seq:i can_id:i d0:i d1:i d2:i d3:i d4:i d5:i d6:i d7:i is_attack:i ts_us:i",
       "SELECT * FROM frames")
def frames(t):
    return t.frames()


@query("w1_count_windows", "capture window_index:i start_row:i end_row:i discarded_tail:i",
       """SELECT capture, window_index, window_index * 100 AS start_row, window_index * 100 + 99 AS end_row,
  n % 100 AS discarded_tail FROM (SELECT DISTINCT capture, seq // 100 AS window_index, n
    FROM (SELECT *, count(*) OVER (PARTITION BY capture) AS n FROM frames)) WHERE (window_index + 1) * 100 <= n""")
def w1(t):
    return windows.window_spans(t.frames(), 100)


@query("w2_time_ordered", "capture time_seq:i seq:i ts_us:i",
       """SELECT capture, seq, ts_us, row_number() OVER (PARTITION BY capture ORDER BY ts_us, seq) - 1 AS time_seq
  FROM frames""")
def w2(t):
    return windows.time_ordered(t.frames(), ["capture"], "ts_us", "seq", F.floor(F.col("ts_us") / 65_536_000))


@query("w3_structural_features", f"capture window_index:i start_row:i end_row:i {_STRUCT}", "SELECT * FROM w20")
def w3(t):
    return can_gate.micro_windows(t)


@query("w4_payload_features", f"capture window_index:i {_STRUCT} {_PAYLOAD}", "SELECT * FROM w100")
def w4(t):
    return can_gate.parent_windows(t)


def timing_ctes(prefix: str, table: str) -> None:
    """Timing features of 20-frame windows of a table of timed frames, as <prefix>t20."""
    cte(**{name: body.replace("@", prefix) for name, body in {
        f"{prefix}iat20": f"""SELECT *, seq // 20 AS window_index, (ts_us - lag(ts_us) OVER
    (PARTITION BY capture, seq // 20 ORDER BY seq)) / 1e6 AS iat FROM {table}""",
        f"{prefix}timing_base": """SELECT capture, window_index, sum(is_attack) AS attack_frame_count, count(*) AS n_rows,
  greatest((arg_max(ts_us, seq) - arg_min(ts_us, seq)) / 1e6, 0e0) AS span,
  sum(CASE WHEN iat <= 0 THEN 1 ELSE 0 END) AS nonpositive, count(iat) FILTER (iat > 0) AS m,
  coalesce(avg(iat) FILTER (iat > 0), 0e0) AS mean_iat, coalesce(stddev_pop(iat) FILTER (iat > 0), 0e0) AS std_iat,
  coalesce(quantile_cont(iat, 0.5::DOUBLE) FILTER (iat > 0), 0e0) AS med,
  coalesce(quantile_cont(iat, 0.1::DOUBLE) FILTER (iat > 0), 0e0) AS p10,
  coalesce(quantile_cont(iat, 0.9::DOUBLE) FILTER (iat > 0), 0e0) AS p90
  FROM @iat20 GROUP BY 1, 2 HAVING count(*) = 20""",
        f"{prefix}timing_burst": """SELECT capture, window_index, sum(CASE WHEN iat > 0 AND iat <= greatest(0.25e0 * med, 1e-9)
    THEN 1 ELSE 0 END) AS burst FROM @iat20 JOIN @timing_base USING (capture, window_index) GROUP BY 1, 2""",
        f"{prefix}t20": """SELECT *, ln(1e0 + span * 1e6) AS log_window_span_us, ln(1e0 + mean_iat * 1e6) AS log_iat_mean_us,
  ln(1e0 + std_iat * 1e6) AS log_iat_std_us, ln(1e0 + med * 1e6) AS log_iat_median_us,
  ln(1e0 + p10 * 1e6) AS log_iat_p10_us, ln(1e0 + p90 * 1e6) AS log_iat_p90_us,
  ln(1e0 + 19e0 / greatest(span, 1e-6)) AS log_message_rate_hz, nonpositive / 19e0 AS iat_nonpositive_fraction,
  burst / greatest(m, 1)::DOUBLE AS iat_burst_fraction, window_index * 20 AS start_row,
  CASE WHEN attack_frame_count > 0 THEN 1 ELSE 0 END AS binary_target
  FROM @timing_base JOIN @timing_burst USING (capture, window_index)""",
    }.items()})


timing_ctes("", "timed")


@query("w5_timing_features", "capture window_index:i " + " ".join(f"{f}:d" for f in windows.TIMING), "SELECT * FROM t20")
def w5(t):
    return windows.timing_features(t.timed())


@query("w6_window_density", "capture density_band windows:i attack_frames:i attack_frames_mean:d",
       """SELECT capture, density_band, count(*) AS windows, sum(attack_frame_count) AS attack_frames,
  avg(attack_frame_count) AS attack_frames_mean FROM w100 GROUP BY 1, 2""")
def w6(t):
    return windows.density_table(can_gate.parent_windows(t))


cte(intervals="""SELECT * FROM (VALUES ('A_F', 0.25e0, 0.6e0, 'attack'), ('R_F', NULL, NULL, 'attack'),
  ('N_O', 0.5e0, 0.9e0, 'attack'), ('N_F', 0.1e0, 0.2e0, 'ambient')) AS v(capture, interval_start, interval_end, role)""")


def _intervals(t):
    return t.spark.createDataFrame(
        [("A_F", 0.25, 0.6, "attack"), ("R_F", None, None, "attack"), ("N_O", 0.5, 0.9, "attack"),
         ("N_F", 0.1, 0.2, "ambient")],
        "capture string, interval_start double, interval_end double, role string")


@query("w7_interval_phase", "capture in_phase:i frames:i step_phase",
       """SELECT capture, in_phase, step_phase, count(*) AS frames FROM (SELECT f.capture,
  CASE WHEN coalesce(role, 'ambient') = 'ambient' THEN 0 WHEN interval_start IS NULL THEN 1
    WHEN ts_us / 1e6 BETWEEN interval_start AND interval_end THEN 1 ELSE 0 END AS in_phase,
  CASE WHEN seq >= 0 AND seq < 120 THEN 'first' WHEN seq >= 120 AND seq < 500 THEN 'second' ELSE 'rest' END AS step_phase
  FROM frames f LEFT JOIN intervals i ON f.capture = i.capture) GROUP BY ALL""")
def w7(t):
    timed = t.frames().withColumn("elapsed", F.col("ts_us") / F.lit(1e6))
    tagged = windows.phase_tag(timed, _intervals(t), "elapsed")
    named = tagged.withColumn("step_phase", windows.step_phase(
        F.col("seq"), [(0, 120, "first"), (120, 500, "second")], "rest"))
    return named.groupBy("capture", "in_phase", "step_phase").agg(F.count(F.lit(1)).alias("frames"))


_HEX_SQL = " || ".join(f"lpad(upper(to_hex({b}::INTEGER)), 2, '0')" for b in PAYLOAD)


def hex_payload():
    return F.concat(*[F.lpad(F.hex(b), 2, "0") for b in PAYLOAD])


@query("w8_signature_match", "capture can_id:i matches:i wild_matches:i",
       f"""SELECT capture, can_id, sum(CASE WHEN can_id = 9 AND regexp_matches({_HEX_SQL}, '^..0.............$')
    THEN 1 ELSE 0 END) AS matches,
  sum(CASE WHEN regexp_matches({_HEX_SQL}, '^000000..........$') THEN 1 ELSE 0 END) AS wild_matches
  FROM frames GROUP BY 1, 2""")
def w8(t):
    frames = t.frames().withColumn("hex", hex_payload())
    exact = windows.signature_match(F.col("can_id"), F.col("hex"), F.lit("09"), F.lit("XX0XXXXXXXXXXXXX"))
    wild = windows.signature_match(F.col("can_id"), F.col("hex"), F.lit("XXX"), F.lit("000000XXXXXXXXXX"))
    return frames.groupBy("capture", "can_id").agg(F.sum(exact).alias("matches"), F.sum(wild).alias("wild_matches"))


@query("w9_micro_to_parent", "capture parent_window_index:i micro_windows:i micro_attack_frames:i any_alarm_instant:i "
       "any_alarm_persistent_2:i deviation_max:d deviation_mean:d can_trust_min:d", "SELECT * FROM rolled")
def w9(t):
    return windows.rollup_to_parent(can_gate.micro_gate(t), ["alarm_instant", "alarm_persistent_2"],
                                    ["deviation"], ["deviation"], ["can_trust"])


_LINE_SQL = " || ',' || ".join(f"{c}::INTEGER::VARCHAR" for c in ("can_id", *PAYLOAD))


def _line():
    return F.concat_ws(",", *[F.col(c).cast("string") for c in ("can_id", *PAYLOAD)])


cte(hash100=f"""SELECT capture, seq // 100 AS window_index, sha256(string_agg({_LINE_SQL}, chr(10) ORDER BY seq) || chr(10))
  AS content_sha256, sha256(string_agg({_LINE_SQL} || ',' || is_attack::VARCHAR, chr(10) ORDER BY seq) || chr(10))
  AS labelled_sha256 FROM frames GROUP BY 1, 2 HAVING count(*) = 100""")


@query("w10_content_hash", "capture window_index:i content_sha256 labelled_sha256", "SELECT * FROM hash100")
def w10(t):
    frames = t.frames()
    plain = windows.content_hash(frames, 100, _line(), "content_sha256")
    labelled = windows.content_hash(frames, 100, F.concat_ws(",", _line(), F.col("is_attack").cast("string")),
                                    "labelled_sha256")
    return plain.join(labelled, ["capture", "window_index"])


@query("w11_overlap_audit", "capture windows:i overlapping_windows:i",
       """SELECT capture, count(*) AS windows, sum(CASE WHEN start_row <= before THEN 1 ELSE 0 END) AS overlapping_windows
  FROM (SELECT capture, start_row, lag(end_row) OVER (PARTITION BY capture ORDER BY window_index) AS before FROM w20)
  GROUP BY 1""")
def w11(t):
    return windows.overlap_count(windows.window_spans(t.frames(), 20), 20)


@query("w12_pseudo_sessions", "session_id windows:i first_window:i last_window:i",
       """SELECT session_id, count(*) AS windows, min(window_index) AS first_window, max(window_index) AS last_window
  FROM micro_sessions GROUP BY 1""")
def w12(t):
    sessions = windows.pseudo_sessions(can_gate.micro_windows(t), can_gate.MICRO_SESSION, HEALTHY)
    return sessions.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("windows"), F.min("window_index").alias("first_window"),
        F.max("window_index").alias("last_window"))


@query("w13_baseline_split", "session_id total_windows:i bootstrap_windows:i evaluated_windows:i "
       "bootstrap_attack_windows:i bootstrap_attack_frames:i",
       """SELECT session_id, count(*) AS total_windows, count(*) FILTER (session_position < 25) AS bootstrap_windows,
  count(*) FILTER (session_position >= 25) AS evaluated_windows,
  coalesce(sum(binary_target) FILTER (session_position < 25), 0) AS bootstrap_attack_windows,
  coalesce(sum(attack_frame_count) FILTER (session_position < 25), 0) AS bootstrap_attack_frames
  FROM micro_sessions GROUP BY 1""")
def w13(t):
    sessions = windows.pseudo_sessions(can_gate.micro_windows(t), can_gate.MICRO_SESSION, HEALTHY)
    return windows.baseline_audit(sessions, can_gate.MICRO_BOOT)


# Capture names of the published attack metadata, as families are named from them.
NAMES = ("accelerator_attack_drive_1", "correlated_signal_attack_1_masquerade", "fuzzing_attack_2",
         "max_speedometer_attack_1", "reverse_light_off_attack_1_masquerade", "max_engine_coolant_temp_attack")


@query("w15_family_naming", "family signal_family captures:i frames:i",
       f"""SELECT CASE WHEN starts_with(name, 'accelerator_attack') THEN 'accelerator_compromised_state'
    WHEN modified OR ends_with(name, '_masquerade') THEN 'masquerade'
    WHEN starts_with(name, 'fuzzing_attack') THEN 'fabrication_fuzzing' ELSE 'fabrication_targeted' END AS family,
  CASE WHEN starts_with(name, 'accelerator_attack') THEN 'accelerator_compromised_state'
    WHEN starts_with(name, 'correlated_signal') THEN 'correlated_signal_masquerade'
    WHEN starts_with(name, 'max_engine_coolant') THEN 'max_engine_coolant_masquerade'
    WHEN starts_with(name, 'max_speedometer') THEN 'max_speedometer_masquerade'
    WHEN starts_with(name, 'reverse_light_off') THEN 'reverse_light_off_masquerade'
    WHEN starts_with(name, 'reverse_light_on') THEN 'reverse_light_on_masquerade'
    ELSE 'other_signal_attack' END AS signal_family,
  count(DISTINCT name) AS captures, count(*) AS frames
  FROM (SELECT {list(NAMES)}[(can_id % 6) + 1] AS name, d2 = 3 AS modified FROM frames) GROUP BY 1, 2""")
def w15(t):
    named = t.frames().select(
        F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("can_id") % 6 + 1)).alias("name"),
        (F.col("d2") == 3).alias("modified"))
    return named.groupBy(
        windows.capture_family(F.col("name"), F.col("modified")).alias("family"),
        windows.signal_family(F.col("name")).alias("signal_family")
    ).agg(F.countDistinct("name").alias("captures"), F.count(F.lit(1)).alias("frames"))


# Attack types of the typed source.
TYPES = ("DoS", "Brake Tampering", "Steering Tampering")


def typed_frames(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.floor(F.col("seq") / 7) % 3 + 1).cast("int"))
    return t.frames().withColumn("attack_type", F.when(F.col("is_attack") == 1, kind).otherwise("Normal"))


cte(
    typed=f"""SELECT *, CASE WHEN is_attack = 1 THEN {list(TYPES)}[((seq // 7) % 3) + 1] ELSE 'Normal' END AS attack_type
  FROM frames""",
    family100="""SELECT capture, window_index, CASE WHEN len(s) = 0 THEN 'benign' ELSE array_to_string(s, '|') END
    AS attack_families, len(s) AS attack_family_count, CASE WHEN len(s) = 1 THEN 1 ELSE 0 END AS exclusive_family
  FROM (SELECT capture, seq // 100 AS window_index, coalesce(list_sort(list(DISTINCT attack_type)
    FILTER (attack_type <> 'Normal')), []) AS s FROM typed GROUP BY 1, 2 HAVING count(*) = 100)""",
)


@query("w16_family_attribution", "capture window_index:i attack_families attack_family_count:i exclusive_family:i",
       "SELECT * FROM family100")
def w16(t):
    return windows.family_sets(typed_frames(t), 100, "attack_type", "Normal")


@query("e6_micro_trust", "session_id window_index:i role deviation:d alarm_instant:i alarm_persistent_2:i can_trust:d",
       "SELECT * FROM micro_gate")
def e6(t):
    return can_gate.micro_gate(t)


@query("e5_session_deviation", "session_id window_index:i role deviation:d", "SELECT * FROM parent_scored")
def e5(t):
    return can_gate.parent_scores(t)


@query("j2_multiscale_parents", "capture parent_window_index:i role binary_target:i micro_windows:i multi_instant:i "
       "multi_persistent_2:i multi_trust:d w100_instant:i w100_persistent_2:i", "SELECT * FROM parents")
def j2(t):
    return can_gate.multiscale(t)
