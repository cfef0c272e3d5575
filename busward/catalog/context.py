"""Queries over context rows: state, trust, policy, replay and robustness."""

from __future__ import annotations

from pyspark.sql import functions as F

from busward.catalog.frames import RATE_COLUMNS, RATES_SQL, counts_sql, div, rates_sql
from busward.catalog.registry import cte, query
from busward.operators import joins, metrics, policy, state, stats
from busward.operators.ordering import exact_quantiles, running_totals, streaks
from busward.plans import can_gate, replay
from busward.plans.replay import UNIT

_CASE5 = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(replay.ATTACK_CAPTURES))
_CASE4 = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(replay.DENSITIES))
_fuse_parts = [("identity_score", 0.15, 1.0), ("device_score", 0.13, 1.0), ("can_score", 0.20, 0.9),
               ("gnss_score", 0.17, 1.0), ("v2x_score", 0.10, 1.0), ("sensor_score", 0.20, 1.0),
               ("freshness_score", 0.05, 1.0)]
_weighted = "0e0 + " + " + ".join(f"{w}e0 * {q}e0 * {s}" for s, w, q in _fuse_parts)
_active = "0e0 + " + " + ".join(f"{w}e0 * {q}e0" for _, w, q in _fuse_parts)
FUSE_SQL = f"(({_weighted}) / ({_active}) * (({_active}) / {sum(w for _, w, _ in _fuse_parts)!r}e0))"


def monitor_ctes(name: str, table: str, limits: dict[str, float], a: int, r: int) -> None:
    """Monitors as a row-by-row recursion, independent of the closed form used in Spark."""
    cols = {"gnss": "gnss_score", "v2x": "v2x_score", "sensor_control": "sensor_score"}
    parts = [f"SELECT run, seq, '{m}' AS monitor, CASE WHEN {cols[m]} < {v}e0 THEN 1 ELSE 0 END AS bad, {a} AS a, {r} AS r "
             f"FROM {table}" for m, v in limits.items()]
    parts += [f"SELECT run, seq, '{m}', {c}, 1, {r} FROM {table}" for m, c in
              (("identity", "identity_failure"), ("device_posture", "device_failure"))]
    cte(**{
        f"{name}_in": " UNION ALL ".join(parts),
        f"{name}_walk": f"""SELECT run, monitor, seq, a, r, bad AS bads, 0 AS goods,
    CASE WHEN bad >= a THEN 1 ELSE 0 END AS active FROM {name}_in WHERE seq = 0
  UNION ALL
  SELECT i.run, i.monitor, i.seq, i.a, i.r, CASE WHEN i.bad = 1 THEN w.bads + 1 ELSE 0 END,
    CASE WHEN i.bad = 1 OR w.active = 0 OR w.goods + 1 >= i.r THEN 0 ELSE w.goods + 1 END,
    CASE WHEN i.bad = 1 THEN CASE WHEN w.bads + 1 >= i.a THEN 1 ELSE w.active END
      WHEN w.active = 1 AND w.goods + 1 >= i.r THEN 0 ELSE w.active END
  FROM {name}_walk w JOIN {name}_in i ON i.run = w.run AND i.monitor = w.monitor AND i.seq = w.seq + 1""",
        f"{name}_active": f"""SELECT run, seq, max(active) FILTER (monitor = 'gnss') AS m_gnss,
  max(active) FILTER (monitor = 'v2x') AS m_v2x, max(active) FILTER (monitor = 'sensor_control') AS m_sensor_control,
  max(active) FILTER (monitor = 'identity') AS m_identity,
  max(active) FILTER (monitor = 'device_posture') AS m_device_posture,
  coalesce(string_agg(monitor, ';' ORDER BY monitor) FILTER (active = 1), '') AS active_noncan_sources
  FROM {name}_walk GROUP BY 1, 2""",
    })


cte(
    ctx0="""SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id,
  event_type AS phase, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events""",
    ctx1="""SELECT *, CASE WHEN phase = 'error' THEN 1 ELSE 0 END AS ground_truth_attack,
  CASE WHEN phase = 'error' AND k < 10 THEN 1 ELSE 0 END AS identity_failure,
  CASE WHEN phase = 'error' AND k >= 90 THEN 1 ELSE 0 END AS device_failure FROM ctx0""",
    context="""SELECT *, ((k * 7 + event_id) % 100) / 100e0 AS gnss_score, ((k * 13 + event_id) % 100) / 100e0 AS v2x_score,
  ((k * 29 + event_id) % 100) / 100e0 AS can_score, ((k * 3 + event_id) % 100) / 100e0 AS sensor_score,
  CASE WHEN identity_failure = 1 THEN 0.02e0 ELSE 0.99e0 END AS identity_score,
  CASE WHEN device_failure = 1 THEN 0.08e0 ELSE 0.97e0 END AS device_score, 1e0 AS freshness_score,
  k % 40 + 0.5e0 * (event_id % 7) AS speed, ((event_id * 3 + k) % 60) / 10e0 - 3e0 AS acceleration,
  ((event_id * 37 + k * 11) % 360)::DOUBLE AS heading FROM ctx1""",
    fused=f"""SELECT *, {FUSE_SQL} AS fused, CASE WHEN identity_failure = 1 THEN 0.25e0 WHEN device_failure = 1
  THEN 0.35e0 ELSE 1e0 END AS cap FROM context""",
    trust_walk="""SELECT run, seq, greatest(0e0, least(1e0, least(0.65e0 * 0.8e0 + 0.35e0 * least(fused, cap), cap)))
    AS continuous_trust FROM fused WHERE seq = 0
  UNION ALL SELECT f.run, f.seq, greatest(0e0, least(1e0, least(0.65e0 * w.continuous_trust + 0.35e0 * least(f.fused, f.cap),
    f.cap))) FROM trust_walk w JOIN fused f ON f.run = w.run AND f.seq = w.seq + 1""",
    trusted="""SELECT f.*, least(fused, cap) AS instantaneous_trust, continuous_trust,
  CASE WHEN continuous_trust < 0.75e0 OR identity_failure = 1 OR device_failure = 1 THEN 1 ELSE 0 END AS security_alarm
  FROM fused f JOIN trust_walk USING (run, seq)""",
)
monitor_ctes("mon", "context", policy.SOURCE_THRESHOLDS, 2, 3)
_dig = "('0x' || substr(md5({}), 1, 8))::BIGINT"
cte(
    pool_rows="""SELECT capture AS source_file, unnest(CASE WHEN binary_target = 0 THEN ['benign'] ELSE ['representative_all',
    CASE WHEN attack_frame_count <= 5 THEN 'low_1_5' WHEN attack_frame_count <= 20 THEN 'medium_6_20'
    ELSE 'high_21_100' END] END) AS pool, parent_window_index, attack_frame_count AS replayed_attack_frames,
  w100_instant, multi_instant, multi_trust FROM parents WHERE role = 'attack_capture'""",
    pool_ranked=f"""SELECT *, row_number() OVER (PARTITION BY source_file, pool ORDER BY
    {_dig.format("'7|' || source_file || '|' || parent_window_index")}, parent_window_index) - 1 AS pick,
  count(*) OVER (PARTITION BY source_file, pool) AS pool_windows FROM pool_rows""",
    units=f"""SELECT *, CASE run % 5 {_CASE5} END AS source_file, CASE (run // 5) % 4 {_CASE4} END AS density_scenario
  FROM trusted""",
    ranked="""SELECT *, row_number() OVER (PARTITION BY run, pool ORDER BY seq) - 1 AS k_th FROM (SELECT *,
    CASE WHEN phase = 'error' THEN density_scenario ELSE 'benign' END AS pool FROM units)""",
    replayed=f"""SELECT r.*, coalesce(p.replayed_attack_frames, 0) AS replayed_attack_frames, p.parent_window_index,
  coalesce(p.w100_instant, 0) AS w100_instant, coalesce(p.multi_instant, 0) AS multi_instant, p.multi_trust, s.pool_windows
  FROM ranked r LEFT JOIN (SELECT DISTINCT source_file, pool, pool_windows FROM pool_ranked) s USING (source_file, pool)
  LEFT JOIN pool_ranked p ON p.source_file = r.source_file AND p.pool = r.pool AND p.pick =
    ({_dig.format("'7|' || r.run || '|' || r.pool")} + r.k_th) % s.pool_windows""",
    evid="""SELECT r.*, m.active_noncan_sources, m_gnss, m_v2x, m_sensor_control, m_identity, m_device_posture,
  multi_instant * lag(multi_instant, 1, 0) OVER (PARTITION BY run ORDER BY seq) AS multi_persistent_2,
  w100_instant * lag(w100_instant, 1, 0) OVER (PARTITION BY run ORDER BY seq) AS w100_persistent_2,
  CASE WHEN source_file = 'R_O' THEN 1 ELSE 0 END AS startup_quality_warning, security_alarm AS legacy_alarm,
  greatest(m_gnss, m_v2x, m_identity, m_device_posture) AS no_state,
  greatest(m_gnss, m_v2x, m_identity, m_device_posture, m_sensor_control) AS has_noncan
  FROM replayed r JOIN mon_active m USING (run, seq)""",
    decisions="""SELECT *, greatest(startup_quality_warning, multi_persistent_2, no_state) AS hard_guard_alarm,
  no_state AS context_only_no_state_alarm, greatest(w100_persistent_2, no_state) AS w100_persistent_no_state_alarm,
  greatest(multi_instant, no_state) AS advisory_instant_no_state_alarm,
  greatest(multi_persistent_2, no_state) AS persistent_no_state_alarm,
  greatest(multi_persistent_2, has_noncan) AS persistent_with_state_alarm,
  CASE WHEN multi_persistent_2 = 1 OR m_identity = 1 OR m_device_posture = 1 OR m_gnss = 1 THEN 'SAFE_FALLBACK'
    WHEN multi_instant = 1 THEN 'MONITOR_VERIFY' WHEN startup_quality_warning = 1 THEN 'DEGRADED_MONITORING'
    WHEN m_v2x = 1 THEN 'ALLOW_LOCAL_ONLY' ELSE 'ALLOW' END AS graded_local,
  CASE WHEN multi_persistent_2 = 1 OR m_identity = 1 OR m_device_posture = 1 OR m_gnss = 1
      THEN 'persistent_can_or_independent_critical_context'
    WHEN multi_instant = 1 THEN 'instant_can_advisory' WHEN startup_quality_warning = 1
      THEN 'startup_quality_warning_only' WHEN m_v2x = 1 THEN 'v2x_context_only' ELSE 'no_active_evidence' END AS graded_basis,
  CASE WHEN m_v2x = 1 THEN 'DENY_COOPERATIVE_ACTION' WHEN startup_quality_warning = 1 THEN 'REQUIRE_REVERIFICATION'
    ELSE 'ALLOW' END AS graded_cooperative,
  CASE WHEN m_identity = 1 OR m_device_posture = 1 THEN 'DENY' WHEN multi_instant = 1 OR startup_quality_warning = 1
    THEN 'RESTRICT' ELSE 'ALLOW' END AS graded_telemetry FROM evid""",
)
_ARRAY_SQL = "list_filter(string_split(active_noncan_sources, ';'), x -> x <> '')"


def alarm_union(methods: dict[str, str], keys: str, table: str = "decisions", truth: str = "ground_truth_attack") -> str:
    """Confusion counts per keys and method; the methods are unnested, not united."""
    pairs = ", ".join(f"{{'m': '{m}', 'a': {c}}}" for m, c in methods.items())
    return f"""SELECT {keys}, p.m AS method, {counts_sql('t', 'p.a')} FROM (SELECT {keys}, {truth} AS t, unnest([{pairs}]) AS p FROM {table})
  GROUP BY {keys}, p.m"""


cte(run_metrics=rates_sql(alarm_union(policy.POLICY_METHODS, "run, source_file, density_scenario")))


def run_metrics(t):
    return t.staged("run_metrics", lambda: metrics.with_rates(metrics.confusion(
        replay.decisions(t), UNIT, "ground_truth_attack", policy.POLICY_METHODS)))


# --- state -----------------------------------------------------------------------------------------

@query("t1_motion", "run:i seq:i derived_acceleration:d heading_delta:d",
       """SELECT run, seq, coalesce(speed - lag(speed) OVER w, acceleration) AS derived_acceleration,
  coalesce(CASE WHEN d < 0 THEN d + 360e0 ELSE d END - 180e0, 0e0) AS heading_delta
  FROM (SELECT *, fmod(heading - lag(heading) OVER w + 180e0, 360e0) AS d FROM context
    WINDOW w AS (PARTITION BY run ORDER BY seq)) WINDOW w AS (PARTITION BY run ORDER BY seq)""")
def t1(t):
    return state.motion(t.context(), ["run"], "seq", "speed", "heading", "acceleration", "seq")


@query("t2_two_in_a_row", "run:i seq:i alarm:i persistent:i",
       """SELECT run, seq, alarm, alarm * lag(alarm, 1, 0) OVER (PARTITION BY run ORDER BY seq) AS persistent
  FROM (SELECT *, CASE WHEN can_score < 0.4e0 THEN 1 ELSE 0 END AS alarm FROM context)""")
def t2(t):
    rows = t.context().withColumn("alarm", (F.col("can_score") < 0.4).cast("int"))
    return state.persistent_2(rows, ["run"], "seq", {"persistent": "alarm"})


@query("t3_hysteresis", "run:i seq:i m_gnss:i m_v2x:i m_sensor_control:i", "SELECT * FROM mon_active")
def t3(t):
    return replay.monitored(t.context())


@query("t4_critical_latch", "run:i seq:i m_identity:i m_device_posture:i active_noncan_sources", "SELECT * FROM mon_active")
def t4(t):
    return replay.monitored(t.context())


def _memory_ctes() -> None:
    rules = "SELECT * FROM (VALUES " + ", ".join(
        f"('{n}', {k}, {w}, {h})" for n, (k, w, h) in state.MEMORY_RULES.items()) + ") v(rule, k, n, h)"
    hits = ", ".join(f"sum(alarm) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS h{w}"
                     for w in (1, 2, 3, 4, 5))
    cte(
        mem_rules=rules,
        mem_hits=f"SELECT run, seq, multi_instant AS alarm, {hits.replace('alarm', 'multi_instant')} FROM replayed",
        mem_in="""SELECT run, seq, rule, alarm, h, CASE WHEN CASE n WHEN 1 THEN h1 WHEN 2 THEN h2 WHEN 3 THEN h3
    WHEN 4 THEN h4 ELSE h5 END >= k THEN 1 ELSE 0 END AS hit FROM mem_hits, mem_rules""",
        mem_walk="""SELECT run, seq, rule, hit AS active, 0 AS clean FROM mem_in WHERE seq = 0
  UNION ALL SELECT i.run, i.seq, i.rule,
    CASE WHEN i.h = 0 OR i.hit = 1 THEN i.hit WHEN w.active = 1 AND i.alarm = 0 AND w.clean + 1 >= i.h THEN 0 ELSE w.active END,
    CASE WHEN i.hit = 1 OR w.active = 0 OR i.alarm = 1 OR w.clean + 1 >= i.h THEN 0 ELSE w.clean + 1 END
  FROM mem_walk w JOIN mem_in i ON i.run = w.run AND i.rule = w.rule AND i.seq = w.seq + 1""",
        memory=f"""SELECT run, seq, {', '.join(f"max(active) FILTER (rule = '{n}') AS can__{n}" for n in state.MEMORY_RULES)}
  FROM mem_walk GROUP BY 1, 2""",
    )


_memory_ctes()


@query("t5_memory_rules", "run:i seq:i " + " ".join(f"can__{n}:i" for n in state.MEMORY_RULES), "SELECT * FROM memory")
def t5(t):
    return state.memory_rules(replay.decisions(t), ["run"], "seq", "multi_instant")


@query("t6_trust_memory", "run:i seq:i instantaneous_trust:d continuous_trust:d security_alarm:i", "SELECT * FROM trusted")
def t6(t):
    return replay.trusted(t.context())


cte(label_runs="""SELECT run, seq, ground_truth_attack, max(CASE WHEN changed THEN seq END) OVER
    (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run_start, security_alarm, sensor_alarm
  FROM (SELECT *, CASE WHEN sensor_score < 0.35e0 THEN 1 ELSE 0 END AS sensor_alarm,
    lag(ground_truth_attack) OVER w IS DISTINCT FROM ground_truth_attack AS changed
    FROM trusted WINDOW w AS (PARTITION BY run ORDER BY seq))""")


def attack_runs(t):
    rows = replay.trusted(t.context()).withColumn("sensor_alarm", (F.col("sensor_score") < 0.35).cast("int"))
    return state.label_runs(rows, ["run"], "seq", "ground_truth_attack")


@query("t7_attack_runs", "run:i run_start:i ground_truth_attack:i rows:i last_row:i",
       """SELECT run, run_start, ground_truth_attack, count(*) AS rows, max(seq) AS last_row FROM label_runs GROUP BY 1, 2, 3""")
def t7(t):
    return attack_runs(t).groupBy("run", "run_start", "ground_truth_attack").agg(
        F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last_row"))


cte(latencies="""SELECT run, run_start, method, min(seq) AS start, count(*) AS rows,
  min(CASE WHEN alarm = 1 THEN seq END) - min(seq) AS latency FROM (
    SELECT run, run_start, seq, 'weighted' AS method, security_alarm AS alarm FROM label_runs WHERE ground_truth_attack = 1
    UNION ALL SELECT run, run_start, seq, 'sensor', sensor_alarm FROM label_runs WHERE ground_truth_attack = 1) GROUP BY 1, 2, 3""")


def latencies(t):
    return state.detection_latency(attack_runs(t).where(F.col("ground_truth_attack") == 1), ["run", "run_start"], "seq",
                                   {"weighted": "security_alarm", "sensor": "sensor_alarm"})


@query("t8_first_detection", "run:i run_start:i method start:i rows:i latency:i", "SELECT * FROM latencies")
def t8(t):
    return latencies(t)


def _unit_sql(method, alarm):
    def late(c):
        return f"arg_min({c}, window_index) FILTER ({alarm} = 1) - arg_min({c}, window_index)"

    return f"""SELECT capture, '{method}' AS method, min(window_index) AS start, count(*) AS rows, {late('window_index')} AS latency_windows,
  {late('end_row')} AS latency_rows, ({late('ts_us')}) / 1e6 AS latency_seconds FROM (SELECT g.*, f.seq AS end_row, f.ts_us FROM micro_gate g
    JOIN frames f ON g.capture = f.capture AND g.start_row + 19 = f.seq WHERE g.role <> 'calibration' AND g.binary_target = 1) GROUP BY 1"""


@query("t8_latency_units", "capture method start:i rows:i latency_windows:i latency_rows:i latency_seconds:d",
       _unit_sql("instant", "alarm_instant") + " UNION ALL " + _unit_sql("persistent_2", "alarm_persistent_2"))
def t8_units(t):
    """Latency of the session gate in windows, in frames and in bus time at the end of the windows."""
    gated = can_gate.micro_gate(t).where((F.col("role") != "calibration") & (F.col("binary_target") == 1))
    gated = gated.withColumn("end_row", F.col("start_row") + can_gate.MICRO - 1)
    stamps = t.frames().where(F.col("seq") % can_gate.MICRO == can_gate.MICRO - 1).select(
        "capture", F.col("seq").alias("end_row"), (F.col("ts_us") / 1e6).alias("ts"))
    return state.detection_latency(
        gated.join(stamps, ["capture", "end_row"]), ["capture"], "window_index",
        {"instant": "alarm_instant", "persistent_2": "alarm_persistent_2"},
        {"latency_windows": "window_index", "latency_rows": "end_row", "latency_seconds": "ts"})


@query("t9_row_delay", "run:i seq:i ground_truth_attack_delayed:i identity_failure_delayed:i",
       """SELECT run, seq, lag(ground_truth_attack, 5, 0) OVER w AS ground_truth_attack_delayed,
  lag(identity_failure, 5, 0) OVER w AS identity_failure_delayed FROM context WINDOW w AS (PARTITION BY run ORDER BY seq)""")
def t9(t):
    return state.delayed(t.context(), ["run"], "seq", ["ground_truth_attack", "identity_failure"])


@query("t10_streaks", "run:i seq:i bad_streak:i good_streak:i",
       """SELECT run, seq, CASE WHEN bad = 1 THEN n ELSE 0 END AS bad_streak, CASE WHEN bad = 0 THEN n ELSE 0 END AS good_streak
  FROM (SELECT *, row_number() OVER (PARTITION BY run, g, bad ORDER BY seq) AS n FROM (SELECT run, seq, bad,
    seq - row_number() OVER (PARTITION BY run, bad ORDER BY seq) AS g FROM (SELECT run, seq,
      CASE WHEN gnss_score < 0.5e0 THEN 1 ELSE 0 END AS bad FROM context)))""")
def t10(t):
    bad = F.col("gnss_score") < 0.5
    return streaks(t.context(), ["run"], "seq", {"bad_streak": bad, "good_streak": ~bad})


@query("t11_running_totals", "run:i seq:i running_attacks:i",
       """SELECT run, seq, sum(ground_truth_attack) OVER (PARTITION BY run ORDER BY seq) AS running_attacks FROM context""")
def t11(t):
    rows = t.context().withColumn("_bucket", F.floor(F.col("seq") / 65_536))
    return running_totals(rows, ["run"], "seq", "_bucket", {"running_attacks": "ground_truth_attack"})


@query("t12_first_seen", "run:i phase first_seen:i rows:i",
       "SELECT run, phase, min(seq) AS first_seen, count(*) AS rows FROM context GROUP BY 1, 2")
def t12(t):
    return t.context().groupBy("run", "phase").agg(F.min("seq").alias("first_seen"), F.count(F.lit(1)).alias("rows"))


# --- policy ----------------------------------------------------------------------------------------

@query("e13_context_scores", "run:i seq:i gnss_imu_score:d v2x_score:d v2x_quality:d sensor_score:d can_score:d",
       """SELECT run, seq, least(1e0, exp(-(k / 10e0) / 7e0) * exp(-abs(acceleration) / 3e0)) AS gnss_imu_score,
  CASE WHEN event_id % 5 = 0 THEN 0.85e0 ELSE least(1e0, exp(-(k / 5e0) / 6e0)) END AS v2x_score,
  CASE WHEN event_id % 5 = 0 THEN 0.45e0 ELSE 1e0 END AS v2x_quality,
  least(1e0, exp(-abs(acceleration - 1e0) / 2.5e0)) AS sensor_score,
  greatest(0e0, least(1e0, 0.98e0 - 0.03e0 * greatest(0e0, abs(acceleration) - 4.5e0) - 0.02e0 * greatest(0e0, speed - 14e0)))
  AS can_score FROM context""")
def e13(t):
    scores = policy.context_scores(F.col("k") / 10.0, F.abs("acceleration"), F.col("k") / 5.0, F.col("event_id") % 5,
                                   F.abs(F.col("acceleration") - 1.0), F.col("acceleration"), F.col("speed"))
    return t.context().select("run", "seq", *[c.alias(n) for n, c in scores.items()])


@query("e14_physical_state", "run:i seq:i derived_acceleration:d physical_score:d reported_low:i physical_low:i",
       """SELECT run, seq, derived AS derived_acceleration, exp(-abs(acceleration - derived) / 2.5e0) AS physical_score,
  CASE WHEN sensor_score < 0.35e0 THEN 1 ELSE 0 END AS reported_low,
  CASE WHEN exp(-abs(acceleration - derived) / 2.5e0) < 0.35e0 THEN 1 ELSE 0 END AS physical_low
  FROM (SELECT *, coalesce(speed - lag(speed) OVER (PARTITION BY run ORDER BY seq), acceleration) AS derived FROM context)""")
def e14(t):
    moved = state.motion(t.context(), ["run"], "seq", "speed", "heading", "acceleration", "seq")
    scored = moved.withColumn("physical_score", F.exp(-F.abs(F.col("acceleration") - F.col("derived_acceleration")) / 2.5))
    return scored.withColumn("reported_low", (F.col("sensor_score") < 0.35).cast("int")).withColumn(
        "physical_low", (F.col("physical_score") < 0.35).cast("int"))


cte(
    healthy_median="SELECT run, median(gnss_score) AS m FROM context WHERE phase = 'view' GROUP BY 1",
    severity_rows="""SELECT c.run, c.seq, s / 10e0 AS severity, phase, CASE WHEN phase = 'error'
    THEN greatest(0e0, least(1e0, m + s / 10e0 * (gnss_score - m))) ELSE gnss_score END AS score
  FROM context c JOIN healthy_median USING (run), (SELECT unnest(range(1, 11)) AS s)
  WHERE phase IN ('view', 'error', 'click')""",
    severity_metrics="""SELECT run, severity, 'context_aware' AS attack_type, avg(alarm) FILTER (phase = 'error') AS recall,
  coalesce(avg(alarm) FILTER (phase <> 'error'), 0) AS false_positive_rate FROM (SELECT *,
    CASE WHEN score < 0.3e0 THEN 1 ELSE 0 END AS alarm FROM severity_rows) GROUP BY 1, 2 HAVING count(*) FILTER (phase = 'error') > 0""",
)


def severity_rows(t):
    context = t.context()
    medians = exact_quantiles(context.where(F.col("phase") == "view"), ["run"], "gnss_score", {"_m": 0.5})
    return policy_severity(context.where(F.col("phase").isin("view", "error", "click")), medians)


def policy_severity(rows, medians):
    return joins.severity_counterfactual(rows, medians, ["run"], "_m", "gnss_score", F.col("phase") == "error",
                                         [s / 10.0 for s in range(1, 11)])


@query("e15_severity_counterfactual", "run:i seq:i severity:d phase score:d", "SELECT * FROM severity_rows")
def e15(t):
    return severity_rows(t)


def severity_metrics(t):
    rows = severity_rows(t).withColumn("alarm", (F.col("score") < 0.3).cast("int"))
    attack = F.col("phase") == "error"
    return rows.groupBy("run", "severity").agg(
        F.avg(F.when(attack, F.col("alarm"))).alias("recall"),
        F.coalesce(F.avg(F.when(~attack, F.col("alarm"))), F.lit(0.0)).alias("false_positive_rate")
    ).where(F.col("recall").isNotNull()).withColumn("attack_type", F.lit("context_aware"))


@query("a17_detection_boundary", "attack_type minimum_severity:d",
       """SELECT attack_type, min(severity) FILTER (recall_mean >= 0.95e0) AS minimum_severity FROM (SELECT attack_type, severity,
  avg(recall) AS recall_mean FROM severity_metrics GROUP BY 1, 2) GROUP BY 1""")
def a17(t):
    means = stats.run_summary(severity_metrics(t), ["attack_type", "severity"], ["recall"])
    return stats.first_reaching(means, ["attack_type"], "severity", {"minimum_severity": F.col("recall_mean") >= 0.95})


_PHASES = {0: "healthy_baseline", 1: "gps_spoofing", 2: "v2x_falsification", 3: "can_injection",
           4: "identity_compromise", 5: "combined_attack"}


@query("e16_attack_overlay", "run:i seq:i overlay_phase gnss_bias_x:d gnss_bias_y:d sybil_messages:i v2x_false_offset:d "
       "can_attack_probability:d identity_failure:i device_failure:i",
       """SELECT run, seq, p AS overlay_phase,
  CASE p WHEN 'gps_spoofing' THEN 20e0 + 0.55e0 * o WHEN 'combined_attack' THEN 55e0 + 0.35e0 * o ELSE 0e0 END AS gnss_bias_x,
  CASE p WHEN 'gps_spoofing' THEN 12e0 + 0.2e0 * o WHEN 'combined_attack' THEN -35e0 ELSE 0e0 END AS gnss_bias_y,
  CASE p WHEN 'v2x_falsification' THEN 6 WHEN 'combined_attack' THEN 8 ELSE 0 END AS sybil_messages,
  CASE p WHEN 'v2x_falsification' THEN 65e0 WHEN 'combined_attack' THEN 90e0 ELSE 0e0 END AS v2x_false_offset,
  CASE p WHEN 'can_injection' THEN 0.98e0 WHEN 'combined_attack' THEN 0.99e0 ELSE 0.02e0 END AS can_attack_probability,
  CASE WHEN p = 'identity_compromise' THEN 1 ELSE 0 END AS identity_failure,
  CASE WHEN p = 'combined_attack' THEN 1 ELSE 0 END AS device_failure
  FROM (SELECT run, seq, seq % 10 AS o, ['healthy_baseline', 'gps_spoofing', 'v2x_falsification', 'can_injection',
    'identity_compromise', 'combined_attack'][((seq // 10) % 6) + 1] AS p FROM context)""")
def e16(t):
    phase = F.element_at(F.array(*[F.lit(p) for p in _PHASES.values()]), (F.floor(F.col("seq") / 10) % 6 + 1).cast("int"))
    rows = t.context().select("run", "seq", phase.alias("overlay_phase"), (F.col("seq") % 10).alias("_o"))
    return rows.select("run", "seq", "overlay_phase", *[
        c.alias(n) for n, c in policy.attack_overlay(F.col("overlay_phase"), F.col("_o")).items()])


@query("e17_trust_fusion", "run:i seq:i fused:d can_share:d identity_share:d",
       """SELECT run, seq, fused, 0.2e0 * 0.9e0 * can_score AS can_share, 0.15e0 * identity_score AS identity_share FROM fused""")
def e17(t):
    rows = t.context()
    shares = policy.contributions(replay.evidence(rows))
    return rows.select("run", "seq", policy.fuse(replay.evidence(rows)).alias("fused"),
                       shares["can_behavior"].alias("can_share"), shares["identity"].alias("identity_share"))


@query("e18_access_decision", "run:i seq:i telemetry actuator privileged",
       """SELECT run, seq, CASE WHEN crit THEN 'DENY' WHEN tr >= 0.75e0 THEN 'ALLOW' WHEN tr >= 0.5e0 THEN 'RESTRICT'
    ELSE 'DENY' END AS telemetry,
  CASE WHEN crit THEN 'SAFE_FALLBACK' WHEN tr >= 0.85e0 THEN 'ALLOW' ELSE 'SAFE_FALLBACK' END AS actuator,
  CASE WHEN crit THEN 'DENY' WHEN tr >= 0.85e0 THEN 'ALLOW' WHEN tr >= 0.75e0 THEN 'STEP_UP_VERIFY'
    WHEN tr >= 0.5e0 THEN 'RESTRICT' ELSE 'DENY' END AS privileged
  FROM (SELECT run, seq, continuous_trust AS tr, identity_failure = 1 OR device_failure = 1 AS crit FROM trusted)""")
def e18(t):
    rows = replay.trusted(t.context())
    critical = (F.col("identity_failure") == 1) | (F.col("device_failure") == 1)
    yes, no, trust = F.lit(True), F.lit(False), F.col("continuous_trust")
    return rows.select("run", "seq", policy.access_decision(trust, critical, no, no).alias("telemetry"),
                       policy.access_decision(trust, critical, yes, yes).alias("actuator"),
                       policy.access_decision(trust, critical, no, yes).alias("privileged"))


@query("e19_source_policy", "run:i seq:i active_noncan_sources local_control cooperative telemetry",
       """SELECT run, seq, active_noncan_sources, CASE WHEN active_noncan_sources = '' THEN 'ALLOW'
    WHEN m_identity + m_device_posture + m_sensor_control + m_gnss > 0 THEN 'SAFE_FALLBACK' ELSE 'ALLOW_LOCAL_ONLY' END AS local_control,
  CASE WHEN active_noncan_sources = '' THEN 'ALLOW' WHEN m_v2x = 1 THEN 'DENY_COOPERATIVE_ACTION'
    ELSE 'REQUIRE_REVERIFICATION' END AS cooperative,
  CASE WHEN active_noncan_sources = '' THEN 'ALLOW' WHEN m_identity + m_device_posture > 0 THEN 'DENY' ELSE 'RESTRICT' END AS telemetry
  FROM mon_active""")
def e19(t):
    rows = replay.monitored(t.context()).withColumn("_a", replay.split_sources(F.col("active_noncan_sources")))
    local, cooperative, telemetry = policy.source_policy(F.col("_a"))
    return rows.select("run", "seq", "active_noncan_sources", local.alias("local_control"),
                       cooperative.alias("cooperative"), telemetry.alias("telemetry"))


@query("e20_guarded_policy", "run:i seq:i local_control cooperative telemetry guarded_can_alarm:i proposed_alarm:i",
       """SELECT run, seq, CASE WHEN startup_quality_warning = 1 THEN 'SAFE_FALLBACK' WHEN has_noncan = 0 AND multi_instant = 0 THEN 'ALLOW'
    WHEN multi_persistent_2 = 1 OR m_identity + m_device_posture + m_gnss + m_sensor_control > 0 THEN 'SAFE_FALLBACK'
    WHEN multi_instant = 1 THEN 'VERIFY_RESTRICT' ELSE 'ALLOW_LOCAL_ONLY' END AS local_control,
  CASE WHEN startup_quality_warning = 1 THEN 'DENY_COOPERATIVE_ACTION' WHEN has_noncan = 0 AND multi_instant = 0 THEN 'ALLOW'
    WHEN m_v2x = 1 THEN 'DENY_COOPERATIVE_ACTION' ELSE 'REQUIRE_REVERIFICATION' END AS cooperative,
  CASE WHEN startup_quality_warning = 1 THEN 'DENY' WHEN has_noncan = 0 AND multi_instant = 0 THEN 'ALLOW'
    WHEN m_identity + m_device_posture > 0 THEN 'DENY' ELSE 'RESTRICT' END AS telemetry,
  greatest(multi_instant, startup_quality_warning) AS guarded_can_alarm,
  greatest(multi_instant, startup_quality_warning, has_noncan) AS proposed_alarm FROM decisions""")
def e20(t):
    i, p, w = (F.col(c) for c in ("multi_instant", "multi_persistent_2", "startup_quality_warning"))
    local, cooperative, telemetry = policy.guarded_policy(F.col("noncan"), i, p, w)
    return replay.decisions(t).select(
        "run", "seq", local.alias("local_control"), cooperative.alias("cooperative"), telemetry.alias("telemetry"),
        F.greatest(i, w).alias("guarded_can_alarm"), F.greatest(i, w, F.col("has_noncan")).alias("proposed_alarm"))


@query("e21_soft_guard_policy", "run:i seq:i local_control_action local_action_basis cooperative_action telemetry_action operating_mode",
       """SELECT run, seq, CASE WHEN hard THEN 'SAFE_FALLBACK' WHEN w AND i THEN 'SAFE_FALLBACK' WHEN i THEN 'VERIFY_RESTRICT'
    WHEN w THEN 'ALLOW_LOCAL_RESTRICTED' WHEN m_v2x = 1 THEN 'ALLOW_LOCAL_ONLY' ELSE 'ALLOW' END AS local_control_action,
  CASE WHEN hard THEN 'persistent_or_independent_critical_evidence' WHEN w AND i THEN 'startup_warning_plus_can_evidence'
    WHEN i THEN 'single_multiscale_can_evidence' WHEN w THEN 'startup_quality_warning_only' WHEN m_v2x = 1 THEN 'v2x_evidence'
    ELSE 'no_active_evidence' END AS local_action_basis,
  CASE WHEN m_v2x = 1 OR identity_failure = 1 OR device_failure = 1 THEN 'DENY_COOPERATIVE_ACTION'
    WHEN w THEN 'REQUIRE_REVERIFICATION' ELSE 'ALLOW' END AS cooperative_action,
  CASE WHEN m_identity + m_device_posture > 0 THEN 'DENY' WHEN w OR i THEN 'RESTRICT' ELSE 'ALLOW' END AS telemetry_action,
  CASE WHEN w THEN 'BASELINE_UNTRUSTED' ELSE 'BASELINE_ACCEPTED' END AS operating_mode
  FROM (SELECT *, startup_quality_warning = 1 AS w, multi_instant = 1 AS i, multi_persistent_2 = 1 OR
    m_identity + m_device_posture + m_gnss + m_sensor_control > 0 AS hard FROM decisions)""")
def e21(t):
    return replay.decisions(t)


_ALARMS = " ".join(f"{c}:i" for c in policy.POLICY_METHODS.values())


@query("e22_graded_policy", f"run:i source_file density_scenario seq:i {_ALARMS} graded_local graded_basis graded_cooperative graded_telemetry",
       "SELECT * FROM decisions")
def e22(t):
    return replay.decisions(t)


_RISKS = {"can": "multi_persistent_2", "gnss": "m_gnss", "v2x": "m_v2x", "identity": "m_identity",
          "device_posture": "m_device_posture"}


def risk_rows(t):
    rows = replay.decisions(t).select(
        *UNIT, "seq", "phase", "ground_truth_attack", "multi_instant", "startup_quality_warning",
        *[F.col(c).alias(f"risk_{s}") for s, c in _RISKS.items()])
    return state.delayed(rows, UNIT, "seq", ["multi_instant", *[f"risk_{s}" for s in _RISKS]], 5, "_late")


def _perturb_sql() -> None:
    variants = "SELECT * FROM (VALUES ('reference', 'none'), " + ", ".join(
        f"('{s}', '{x}')" for s in policy.SCENARIOS for x in policy.SOURCES) + ") v(scenario, target)"
    names = {**{f"risk_{s}": c for s, c in _RISKS.items()}, "instant": "multi_instant"}
    late = ", ".join(f"{c} AS {n}, lag({c}, 5, 0) OVER (PARTITION BY run ORDER BY seq) AS {n}_late" for n, c in names.items())

    def under(column: str, source: str) -> str:
        return (f"CASE WHEN target <> '{source}' OR scenario = 'reference' THEN {column} WHEN scenario = 'stale_delay_5' "
                f"THEN {column}_late WHEN scenario = 'conflicting_high_risk' THEN 1 ELSE 0 END AS {column}")

    cte(
        variants=variants,
        risks=f"SELECT run, source_file, density_scenario, seq, ground_truth_attack, startup_quality_warning, {late} FROM decisions",
        perturbed=f"""SELECT run, source_file, density_scenario, seq, ground_truth_attack, scenario, target,
  {', '.join(under(f'risk_{s}', s) for s in policy.SOURCES)}, {under('instant', 'can')},
  CASE WHEN scenario IN ('reference', 'compromised_undetected_false_healthy') THEN 0 ELSE 1 END AS quality_issue
  FROM risks, variants""",
        acted=f"""SELECT *, greatest({', '.join(f'risk_{s}' for s in policy.SOURCES)}) AS prediction,
  CASE WHEN greatest({', '.join(f'risk_{s}' for s in policy.CRITICAL)}) = 1 THEN 'SAFE_FALLBACK' WHEN instant = 1 THEN 'MONITOR_VERIFY'
    WHEN quality_issue = 1 THEN 'VERIFY_RESTRICT' WHEN risk_v2x = 1 THEN 'ALLOW_LOCAL_ONLY' ELSE 'ALLOW' END AS action FROM perturbed""",
    )


_perturb_sql()
cte(pr=f"""SELECT *, {RATES_SQL}, {div('unsafe_allow_count', 'attack_rows')} AS unsafe_allow_rate,
  {div('restricted', 'benign_rows')} AS benign_restriction_rate FROM (SELECT run, source_file, density_scenario, scenario, target,
    {counts_sql('ground_truth_attack', 'prediction')}, sum(ground_truth_attack) AS attack_rows,
    sum(1 - ground_truth_attack) AS benign_rows,
    count(*) FILTER (ground_truth_attack = 1 AND action = 'ALLOW') AS unsafe_allow_count,
    count(*) FILTER (prediction = 1 AND action = 'ALLOW') AS high_risk_allow_count,
    count(*) FILTER (quality_issue = 1 AND action = 'ALLOW') AS quality_issue_allow_count,
    count(*) FILTER (ground_truth_attack = 0 AND action <> 'ALLOW') AS restricted,
    avg(CASE WHEN action = 'ALLOW' THEN 1 ELSE 0 END) AS full_allow_rate,
    avg(CASE WHEN action = 'SAFE_FALLBACK' THEN 1 ELSE 0 END) AS safe_fallback_rate FROM acted GROUP BY 1, 2, 3, 4, 5)""",
    perturbed_runs="""SELECT r.*, b.f1 AS reference_f1, b.f1 - r.f1 AS f1_loss FROM pr r JOIN pr b
  ON r.run = b.run AND b.scenario = 'reference'""")


@query("e23_source_perturbation", "run:i seq:i scenario target risk_can:i risk_gnss:i risk_v2x:i risk_identity:i "
       "risk_device_posture:i instant:i quality_issue:i", "SELECT * FROM perturbed")
def e23(t):
    return policy.perturb(risk_rows(t), "multi_instant")


def perturbed_runs(t):
    return t.staged("perturbed_runs", lambda: policy.perturbed_run_metrics(
        policy.perturbed_actions(policy.perturb(policy.counted_rows(risk_rows(t), UNIT, ["ground_truth_attack"], "multi_instant"), "multi_instant")),
        UNIT, "ground_truth_attack"))


@query("e24_perturbed_evaluation", f"run:i scenario target tp:i fp:i tn:i fn:i {RATE_COLUMNS} attack_rows:i unsafe_allow_count:i "
       "high_risk_allow_count:i quality_issue_allow_count:i unsafe_allow_rate:d benign_restriction_rate:d full_allow_rate:d "
       "safe_fallback_rate:d reference_f1:d f1_loss:d", "SELECT * FROM perturbed_runs")
def e24(t):
    return perturbed_runs(t)


cte(
    codes="""SELECT run, target, with_warning, sum(ground_truth_attack) AS a, sum(1 - ground_truth_attack) AS b, code FROM (
    SELECT *, (CASE WHEN target = 'can' THEN 0 ELSE risk_can END) + (CASE WHEN target = 'gnss' THEN 0 ELSE risk_gnss * 2 END)
      + (CASE WHEN target = 'v2x' THEN 0 ELSE risk_v2x * 4 END) + (CASE WHEN target = 'identity' THEN 0 ELSE risk_identity * 8 END)
      + (CASE WHEN target = 'device_posture' THEN 0 ELSE risk_device_posture * 16 END)
      + (CASE WHEN target = 'can' THEN 0 ELSE instant * 32 END) + startup_quality_warning * with_warning * 64 AS code
    FROM risks, (SELECT unnest(['can', 'gnss', 'v2x', 'identity', 'device_posture']) AS target),
      (SELECT unnest([0, 1]) AS with_warning)) GROUP BY run, target, with_warning, code""",
    observed="""SELECT run, target, with_warning, sum(a) AS attack_rows, sum(b) AS benign_rows,
  count(*) FILTER (a > 0 AND b > 0) AS shared_signatures,
  coalesce(sum(a) FILTER (a > 0 AND b > 0), 0) AS ambiguous_attack_rows, coalesce(sum(b) FILTER (a > 0 AND b > 0), 0) AS ambiguous_benign_rows,
  coalesce(sum(a) FILTER (code = 0), 0) AS silent_attack_rows, coalesce(sum(b) FILTER (code = 0), 0) AS silent_benign_rows,
  sum(least(a, b)) AS bayes_error_count FROM codes GROUP BY 1, 2, 3""",
)


def observed(t):
    return policy.observability(risk_rows(t), UNIT, "ground_truth_attack", "multi_instant", "startup_quality_warning")


@query("e25_observability", "run:i target with_warning:i attack_rows:i benign_rows:i shared_signatures:i ambiguous_attack_rows:i "
       "ambiguous_benign_rows:i silent_attack_rows:i silent_benign_rows:i bayes_error_count:i", "SELECT * FROM observed")
def e25(t):
    return observed(t)


@query("i11_recount_matches", "target silent_attack_rows:i unsafe_allow_count:i count_match:i",
       """SELECT coalesce(o.target, p.target) AS target, silent_attack_rows, unsafe_allow_count,
  CASE WHEN silent_attack_rows = unsafe_allow_count THEN 1 ELSE 0 END AS count_match
  FROM (SELECT target, sum(silent_attack_rows) AS silent_attack_rows FROM observed WHERE with_warning = 0 GROUP BY 1) o
  FULL JOIN (SELECT target, sum(unsafe_allow_count) AS unsafe_allow_count FROM perturbed_runs
    WHERE scenario = 'compromised_undetected_false_healthy' GROUP BY 1) p ON o.target = p.target""")
def i11(t):
    seen = observed(t).where(F.col("with_warning") == 0).groupBy("target").agg(
        F.sum("silent_attack_rows").alias("silent_attack_rows"))
    kept = perturbed_runs(t).where(F.col("scenario") == "compromised_undetected_false_healthy").groupBy("target").agg(
        F.sum("unsafe_allow_count").alias("unsafe_allow_count"))
    return joins.cross_check(seen, kept, ["target"], "silent_attack_rows", "unsafe_allow_count")


@query("e29_gate_action", "session_id window_index:i action",
       """SELECT session_id, window_index, CASE WHEN alarm_persistent_2 = 1 THEN 'SAFE_FALLBACK' WHEN alarm_instant = 1
  THEN 'VERIFY_RESTRICT' ELSE 'ALLOW' END AS action FROM parent_gate""")
def e29(t):
    return can_gate.parent_gate(t).withColumn("action", policy.gate_action(F.col("alarm_instant"), F.col("alarm_persistent_2")))


def _grid():
    return [(th, a, r) for th in (0.2, 0.3, 0.4) for a in (1, 2, 3) for r in (1, 3, 5)]


monitor_ctes("mon_s", "context", {"gnss": 0.2, "v2x": 0.2, "sensor_control": 0.2}, 1, 5)


@query("e26_sensitivity_grid", "threshold:d attack_rows:i recovery_rows:i runs:i precision_mean:d recall_mean:d f1_mean:d f1_std:d "
       "false_positive_rate_mean:d", None)
def e26(t):
    return joins.sensitivity_grid(t.context(), _grid())


@query("e26_sensitivity_point", f"run:i tp:i fp:i tn:i fn:i {RATE_COLUMNS}",
       rates_sql(f"""SELECT run, {counts_sql('ground_truth_attack', 'alarm')} FROM (SELECT c.run, ground_truth_attack,
    CASE WHEN active_noncan_sources = '' THEN 0 ELSE 1 END AS alarm FROM context c JOIN mon_s_active m USING (run, seq)) GROUP BY 1"""))
def e26_point(t):
    runs = joins.sensitivity_runs(t.context(), [(0.2, 1, 5)])
    return metrics.with_rates(runs)


# --- replay joins ----------------------------------------------------------------------------------

@query("j1_ordinal_replay", "run:i source_file density_scenario seq:i pool k_th:i parent_window_index:i replayed_attack_frames:i multi_instant:i",
       "SELECT * FROM replayed")
def j1(t):
    return replay.decisions(t)


@query("p20_replay_pools", "source_file pool windows:i fewest_frames:i most_frames:i",
       """SELECT source_file, pool, count(*) AS windows, min(replayed_attack_frames) AS fewest_frames,
  max(replayed_attack_frames) AS most_frames FROM pool_rows GROUP BY 1, 2""")
def p20(t):
    return replay.pools(can_gate.multiscale(t)).groupBy("source_file", "pool").agg(
        F.count(F.lit(1)).alias("windows"), F.min("replayed_attack_frames").alias("fewest_frames"),
        F.max("replayed_attack_frames").alias("most_frames"))


cte(draws="""SELECT run, source_file, pool, count(*) AS drawn, any_value(pool_windows) AS pool_windows,
  count(DISTINCT parent_window_index) AS unique_windows, CASE WHEN count(*) > any_value(pool_windows) THEN 1 ELSE 0 END AS with_replacement
  FROM replayed WHERE pool_windows IS NOT NULL GROUP BY 1, 2, 3""")


@query("p14_replay_sampling", "run:i source_file pool drawn:i pool_windows:i unique_windows:i with_replacement:i", "SELECT * FROM draws")
def p14(t):
    return joins.draw_audit(replay.decisions(t).where(F.col("pool_windows").isNotNull()),
                            ["run", "source_file", "pool"], "pool_windows", "parent_window_index")


@query("a20_sample_size_audit", "density_scenario units:i sources:i replacement_units:i min_unique_attack_windows:i",
       """SELECT u.density_scenario, count(DISTINCT u.run) AS units, count(DISTINCT u.source_file) AS sources,
  coalesce(sum(with_replacement), 0) AS replacement_units, min(unique_windows) AS min_unique_attack_windows
  FROM (SELECT DISTINCT run, source_file, density_scenario FROM replayed) u LEFT JOIN draws d ON d.run = u.run AND d.pool <> 'benign'
  GROUP BY 1""")
def a20(t):
    rows = replay.decisions(t)
    drawn = joins.draw_audit(rows.where(F.col("pool_windows").isNotNull() & (F.col("pool") != "benign")),
                             UNIT, "pool_windows", "parent_window_index")
    return rows.select(*UNIT).distinct().join(drawn, UNIT, "left").groupBy("density_scenario").agg(
        F.countDistinct("run").alias("units"), F.countDistinct("source_file").alias("sources"),
        F.coalesce(F.sum("with_replacement"), F.lit(0)).alias("replacement_units"),
        F.min("unique_windows").alias("min_unique_attack_windows"))


@query("j9_ego_neighbours", "step:i neighbours:i nearest_distance:d mean_neighbour_speed:d position_rmse:d",
       """SELECT step, count(*) FILTER (d <= 120e0) AS neighbours, coalesce(min(d) FILTER (d <= 120e0), -1e0) AS nearest_distance,
  coalesce(avg(speed) FILTER (d <= 120e0), 0e0) AS mean_neighbour_speed, coalesce(sqrt(avg(e2) FILTER (d <= 120e0)), 0e0) AS position_rmse
  FROM (SELECT v.step, v.speed, sqrt((v.x - e.x) * (v.x - e.x) + (v.y - e.y) * (v.y - e.y)) AS d,
      (v.rx - v.x) * (v.rx - v.x) + (v.ry - v.y) * (v.ry - v.y) AS e2
    FROM placed v JOIN placed e ON v.step = e.step AND e.event_id % 20 = 0 AND v.event_id <> e.event_id) GROUP BY 1""")
def j9(t):
    placed = t.context().select(
        F.floor(F.col("event_id") / 20).alias("step"), "event_id", "speed",
        ((F.col("event_id") * 37) % 400).cast("double").alias("x"), ((F.col("k") * 4) % 400).cast("double").alias("y"))
    placed = placed.withColumn("rx", F.col("x") + F.col("event_id") % 3).withColumn("ry", F.col("y") - F.col("event_id") % 2)
    ego = F.col("event_id") % 20 == 0
    return policy.neighbour_summary(placed.where(~ego), placed.where(ego), ["step"], 120.0)


cte(placed="""SELECT *, x + event_id % 3 AS rx, y - event_id % 2 AS ry FROM (SELECT event_id // 20 AS step, event_id, speed,
  ((event_id * 37) % 400)::DOUBLE AS x, ((k * 4) % 400)::DOUBLE AS y FROM context)""")


@query("j8_parameter_lookup", "source_file warning:i rows:i alarms:i",
       """SELECT source_file, startup_quality_warning AS warning, count(*) AS rows, sum(multi_instant) AS alarms FROM decisions GROUP BY 1, 2""")
def j8(t):
    guard = t.spark.createDataFrame([(c, int(c in replay.WARNED)) for c in replay.ATTACK_CAPTURES],
                                    "source_file string, warning int")
    return joins.lookup(replay.decisions(t), guard, ["source_file"]).groupBy("source_file", "warning").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("multi_instant").alias("alarms"))
