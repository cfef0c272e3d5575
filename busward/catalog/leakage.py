"""Queries over splits, sampling, leakage and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from busward.catalog.frames import div
from busward.catalog.registry import cte, query
from busward.functions.columns import digest_number, parse_boolean, split_sources
from busward.operators import joins, quality, splits
from busward.plans import can_gate, replay
from busward.plans.adapters import HEALTHY, PAYLOAD

FIELDS = ("can_id", *PAYLOAD)
_SIG = "md5(" + " || '|' || ".join(f"{c}::INTEGER::VARCHAR" for c in FIELDS) + ")"
_num = "('0x' || substr({}, 1, 8))::BIGINT"

cte(
    signed=f"SELECT *, {_SIG} AS signature FROM frames",
    bucketed=f"""SELECT *, CASE WHEN {_num.format('signature')} % 100 < 70 THEN 'train'
  WHEN {_num.format('signature')} % 100 < 85 THEN 'validation' ELSE 'test' END AS split FROM signed""",
    wsigned="""SELECT *, md5(id_unique_count || '|' || round(id_change_rate * 19e0)::INTEGER) AS signature
  FROM w20""",
    chrono="""SELECT *, CASE WHEN window_index < floor(n * 0.7e0) THEN 'train' WHEN window_index < floor(n * 0.85e0) THEN 'validation'
  ELSE 'test' END AS split FROM (SELECT *, count(*) OVER (PARTITION BY capture) AS n FROM wsigned)""",
)


def signed(t):
    frames = t.frames()
    return frames.withColumn("signature", splits.signature(FIELDS))


def bucketed(t):
    number = F.conv(F.substring("signature", 1, 8), 16, 10).cast("bigint")
    return signed(t).withColumn("split", splits.hash_split(number))


def window_signed(t):
    w = can_gate.micro_windows(t).withColumn("_c", F.round(F.col("id_change_rate") * 19).cast("int"))
    return w.withColumn("signature", splits.signature(["id_unique_count", "_c"]))


def chrono(t):
    return splits.chronological_split(window_signed(t))


@query("p1_feature_signature", "capture seq:i signature", "SELECT * FROM signed")
def p1(t):
    return signed(t)


@query("p2_hash_split", "split capture rows:i signatures:i",
       "SELECT split, capture, count(*) AS rows, count(DISTINCT signature) AS signatures FROM bucketed GROUP BY 1, 2")
def p2(t):
    return bucketed(t).groupBy("split", "capture").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("signature").alias("signatures"))


@query("p3_chronological_split", "capture window_index:i split", "SELECT * FROM chrono")
def p3(t):
    return chrono(t)


@query("p4_greedy_split", "signature split", None)
def p4(t):
    return splits.greedy_split(window_signed(t), "signature", "capture")


@query("p5_stratified_split", "signature label_stratum rows:i attack_rows:i source_count:i split",
       f"""SELECT * EXCLUDE (number, r), CASE WHEN r < number THEN 'calibration' ELSE 'test' END AS split FROM (SELECT *,
    CASE WHEN n >= 2 THEN least(greatest(round_even(n * 0.3e0, 0), 1), n - 1) ELSE n END AS number FROM (SELECT *,
      count(*) OVER (PARTITION BY label_stratum) AS n, row_number() OVER (PARTITION BY label_stratum ORDER BY
        {_num.format("md5('11|' || signature)")}, signature) - 1 AS r FROM (SELECT signature, count(*) AS rows,
        sum(binary_target) AS attack_rows, count(DISTINCT capture) AS source_count, CASE WHEN sum(binary_target) = 0 THEN 'benign_only'
        WHEN sum(binary_target) = count(*) THEN 'attack_only' ELSE 'label_conflict' END AS label_stratum FROM wsigned GROUP BY 1)))""")
def p5(t):
    return splits.stratified_split(window_signed(t), "signature", "binary_target", "capture", 0.3, 11)


@query("p6_split_leakage", "signature values:i rows:i",
       "SELECT signature, count(DISTINCT split) AS values, count(*) AS rows FROM chrono GROUP BY 1 HAVING count(DISTINCT split) > 1")
def p6(t):
    return splits.crossing_signatures(chrono(t), "signature", "split")


cte(overlap_totals="""SELECT sum(n) AS total_rows, count(*) AS unique_signatures, 100e0 * (1 - count(*) / sum(n)::DOUBLE) AS repeated_percentage,
  count(*) FILTER (s > 1) AS crossing_signatures, coalesce(sum(n) FILTER (s > 1), 0) AS crossing_rows,
  count(*) FILTER (l > 1) AS conflicting_signatures, coalesce(sum(n) FILTER (l > 1), 0) AS conflicting_rows
  FROM (SELECT signature, count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT binary_target) AS l FROM chrono GROUP BY 1)""")


@query("p7_label_conflicts", "total_rows:i unique_signatures:i repeated_percentage:d crossing_signatures:i crossing_rows:i "
       "conflicting_signatures:i conflicting_rows:i", "SELECT * FROM overlap_totals")
def p7(t):
    return splits.overlap_audit(chrono(t), "signature", "split", "binary_target")


@query("p8_repetition_audit", "capture rows:i unique_signatures:i repeated_rows:i repetition_percentage:d dataset_percentage:d",
       """SELECT *, rows - unique_signatures AS repeated_rows, 100e0 * (rows - unique_signatures) / rows AS repetition_percentage,
  100e0 * rows / (SELECT count(*) FROM signed) AS dataset_percentage FROM (SELECT coalesce(capture, '__TOTAL__') AS capture,
    count(*) AS rows, count(DISTINCT signature) AS unique_signatures FROM signed GROUP BY ROLLUP (capture))""")
def p8(t):
    return splits.repetition_audit(signed(t), "signature", "capture")


cte(roles100=f"""SELECT *, CASE WHEN capture <> '{HEALTHY}' THEN 'external_attack_capture_evaluation'
  WHEN window_index < floor(n * 0.5e0) THEN 'healthy_reference' WHEN window_index < floor(n * 0.75e0) THEN 'healthy_calibration'
  ELSE 'healthy_holdout' END AS evaluation_role FROM (SELECT *, count(*) OVER (PARTITION BY capture) AS n FROM p100)""")


def roles100(t):
    return splits.healthy_roles(can_gate.parent_windows(t), HEALTHY)


@query("p9_healthy_roles", "capture window_index:i evaluation_role", "SELECT * FROM roles100")
def p9(t):
    return roles100(t)


SALT = "signal-roles"
ROLES = (("profile_fit", 8), ("threshold_calibration", 2), ("benign_holdout", 2))
cte(
    sig_raw=f"""SELECT *, CASE WHEN l_linestatus = 'F' THEN 'ambient_' || (l_orderkey % 12) ELSE 'attack_' || (l_orderkey % 5) END AS capture
  FROM lineitem""",
    sig_seq="""SELECT *, row_number() OVER (PARTITION BY capture ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag) - 1 AS seq FROM sig_raw""",
    sig_lab="""SELECT *, CASE WHEN l_linestatus <> 'F' AND seq % 50 >= 30 THEN 1 ELSE 0 END AS label,
  CASE WHEN l_linestatus <> 'F' AND l_partkey % 50 = 0 THEN 99 ELSE l_suppkey % 10 END AS can_id FROM sig_seq""",
    signals="""SELECT capture, seq, seq / 100e0 AS time, can_id, label, l_quantity * CASE WHEN label = 1 THEN 3e0 ELSE 1e0 END AS s1,
  round(l_discount * 100) + CASE WHEN label = 1 THEN 20e0 ELSE 0e0 END AS s2,
  CASE WHEN can_id % 3 <> 0 OR (l_partkey % 40 = 0 AND l_linestatus <> 'F') THEN round(l_tax * 100) END AS s3,
  CASE WHEN can_id % 2 = 0 THEN l_extendedprice / 1000e0 END AS s4 FROM sig_lab""",
    sig_roles=f"""SELECT capture, CASE WHEN r < 8 THEN 'profile_fit' WHEN r < 10 THEN 'threshold_calibration' WHEN r < 12 THEN 'benign_holdout'
  ELSE 'unused' END AS role FROM (SELECT capture, row_number() OVER (ORDER BY sha256('{SALT}:' || capture)) - 1 AS r
    FROM (SELECT DISTINCT capture FROM signals WHERE starts_with(capture, 'ambient')))""",
)


def signal_roles(t):
    names = t.signals().where(F.col("capture").startswith("ambient"))
    return splits.capture_roles(names, "capture", SALT, ROLES)


@query("p10_capture_roles", "capture role", "SELECT * FROM sig_roles")
def p10(t):
    return signal_roles(t)


@query("p11_run_partitions", "run:i partition",
       """SELECT run, CASE WHEN r <= 3 THEN 'development' ELSE 'confirmation' END AS partition FROM (SELECT run, row_number() OVER (ORDER BY run) AS r,
  row_number() OVER (ORDER BY run DESC) AS d FROM (SELECT DISTINCT run FROM context)) WHERE r <= 3 OR d <= 2""")
def p11(t):
    return splits.run_partitions(t.context(), "run", 3, 2)


@query("p12_label_shuffle", "capture window_index:i binary_target:i shuffled:i",
       f"""SELECT a.capture, a.window_index, a.binary_target, b.binary_target AS shuffled FROM (SELECT *, row_number() OVER (ORDER BY
    {_num.format("md5('5|row|' || capture || '|' || window_index)")}, capture, window_index) AS r FROM w100) a JOIN (SELECT *, row_number() OVER
    (ORDER BY {_num.format("md5('5|label|' || capture || '|' || window_index)")}, capture, window_index) AS r FROM w100) b USING (r)""")
def p12(t):
    return splits.shuffled_labels(can_gate.parent_windows(t), ["capture", "window_index"], "binary_target", 5)


@query("p13_leave_one_out", "held_out split capture rows:i",
       f"""SELECT held_out, split, capture, count(*) AS rows FROM chrono, (SELECT DISTINCT capture AS held_out FROM chrono WHERE capture <> '{HEALTHY}')
  WHERE (split <> 'test' AND capture <> held_out) OR (split = 'test' AND capture IN ('{HEALTHY}', held_out)) GROUP BY 1, 2, 3""")
def p13(t):
    return splits.leave_one_out(chrono(t), "split", "capture", HEALTHY).groupBy("held_out", "split", "capture").agg(
        F.count(F.lit(1)).alias("rows"))


_BAND_SQL = "CASE WHEN binary_target = 0 THEN 'benign' WHEN attack_frame_count <= 5 THEN 'low_1_5' WHEN attack_frame_count <= 20 THEN 'medium_6_20' ELSE 'high_21_100' END"
RUNS = ["r1", "r2", "r3"]
NEED = {"low_1_5": 2, "medium_6_20": 2, "high_21_100": 2, "representative_all": 3}
_pool_digest = _num.format("md5('13|' || capture || '|' || parent_window_index)")
cte(
    attack_pool=f"SELECT capture, parent_window_index, {_BAND_SQL} AS band FROM parents WHERE role = 'attack_capture' AND binary_target = 1",
    alloc1=f"""SELECT *, (row_number() OVER (PARTITION BY capture, band ORDER BY {_pool_digest}, parent_window_index) - 1) // 2 AS slot FROM attack_pool""",
    alloc2=f"""SELECT *, (row_number() OVER (PARTITION BY capture ORDER BY {_pool_digest}, parent_window_index) - 1) // 3 AS slot2 FROM alloc1 WHERE slot >= 3""",
)


def attack_pool(t):
    parents = can_gate.multiscale(t).where((F.col("role") == "attack_capture") & (F.col("binary_target") == 1))
    return parents.select("capture", "parent_window_index", splits_band().alias("band"))


def splits_band():
    from busward.functions.columns import density_band
    return density_band(F.col("attack_frame_count"))


@query("p15_disjoint_allocation", "capture parent_window_index:i drawn_for run",
       """SELECT capture, parent_window_index, band AS drawn_for, ['r1', 'r2', 'r3'][slot + 1] AS run FROM alloc1 WHERE slot < 3
  UNION ALL SELECT capture, parent_window_index, 'representative_all', ['r1', 'r2', 'r3'][slot2 + 1] FROM alloc2 WHERE slot2 < 3""")
def p15(t):
    return splits.disjoint_allocation(attack_pool(t), RUNS, ["capture"], "parent_window_index", NEED, "band", 13)


@query("p15_shortages", "capture drawn_for run asked:i got:i",
       f"""SELECT a.capture, a.drawn_for, a.run, asked, coalesce(got, 0) AS got FROM (SELECT capture, drawn_for, asked, run FROM (SELECT DISTINCT capture FROM attack_pool),
    (VALUES {", ".join(f"('{b}', {n})" for b, n in NEED.items())}) v(drawn_for, asked), (SELECT unnest(['r1', 'r2', 'r3']) AS run)) a
  LEFT JOIN (SELECT capture, drawn_for, run, count(*) AS got FROM (SELECT capture, band AS drawn_for, ['r1', 'r2', 'r3'][slot + 1] AS run FROM alloc1 WHERE slot < 3
    UNION ALL SELECT capture, 'representative_all', ['r1', 'r2', 'r3'][slot2 + 1] FROM alloc2 WHERE slot2 < 3) GROUP BY 1, 2, 3) g
  ON g.capture = a.capture AND g.drawn_for = a.drawn_for AND g.run = a.run WHERE coalesce(got, 0) < asked""")
def p15_shortages(t):
    return splits.allocation_shortages(attack_pool(t), p15(t), RUNS, ["capture"], NEED)


@query("p16_capacity_audit", "capture band total_unique:i used_unique:i unseen_unique:i required:i exhaustion_rate:d feasible:i",
       f"""SELECT *, {div('used_unique', 'total_unique')} AS exhaustion_rate, CASE WHEN unseen_unique >= required THEN 1 ELSE 0 END AS feasible
  FROM (SELECT capture, band, required, count(*) AS total_unique, count(*) FILTER (used) AS used_unique, count(*) FILTER (NOT used) AS unseen_unique
    FROM (SELECT p.*, EXISTS (SELECT 1 FROM replayed d WHERE d.source_file = p.capture AND d.parent_window_index = p.parent_window_index) AS used FROM attack_pool p) JOIN (VALUES ('low_1_5', 5), ('medium_6_20', 10), ('high_21_100', 20)) v(band, required) USING (band)
    GROUP BY 1, 2, 3)""")
def p16(t):
    required = t.spark.createDataFrame([("low_1_5", 5), ("medium_6_20", 10), ("high_21_100", 20)], "band string, required int")
    used = replay.decisions(t).where(F.col("parent_window_index").isNotNull()).select(
        F.col("source_file").alias("capture"), "parent_window_index")
    return splits.capacity_audit(attack_pool(t), used, ["capture"], "parent_window_index", "band", required)


_dg = lambda text: _num.format(f"md5({text})")
COUNTS, REPETITIONS = (0, 1, 2, 3, 5), 3
cte(
    poison_base="SELECT capture, window_index, identifier_log_odds FROM p100 WHERE capture <> 'N_F' AND window_index < 5",
    poison_pool=f"""SELECT capture, window_index AS item, identifier_log_odds AS drawn, count(*) OVER (PARTITION BY capture) AS size,
  row_number() OVER (PARTITION BY capture ORDER BY {_dg("'21|pool|' || capture || '|' || window_index")}, window_index) - 1 AS pick
  FROM p100 WHERE capture <> 'N_F' AND binary_target = 1""",
    poison_rank=f"""SELECT *, row_number() OVER (PARTITION BY capture, contaminated, repetition ORDER BY
    {_dg("'21|' || capture || '|' || contaminated || '|' || repetition || '|' || window_index")}, window_index) - 1 AS o
  FROM poison_base, (SELECT unnest([0, 1, 2, 3, 5]) AS contaminated), (SELECT unnest([0, 1, 2]) AS repetition)""",
    poisoned=f"""SELECT r.capture, contaminated, repetition, r.window_index, coalesce(drawn, identifier_log_odds) AS identifier_log_odds,
  CASE WHEN drawn IS NULL THEN 0 ELSE 1 END AS replaced FROM poison_rank r JOIN (SELECT DISTINCT capture, size FROM poison_pool) s USING (capture)
  LEFT JOIN poison_pool p ON p.capture = r.capture AND o < contaminated AND p.pick =
    ({_dg("'21|offset|' || r.capture || '|' || contaminated || '|' || repetition")} + o) % s.size""",
)


def poisoned(t):
    windows = can_gate.parent_windows(t).where(F.col("capture") != HEALTHY)
    base = windows.where(F.col("window_index") < can_gate.PARENT_BOOT)
    pool = windows.where(F.col("binary_target") == 1).select("capture", F.col("window_index").alias("_item"), "identifier_log_odds")
    return splits.contaminated_baselines(base, pool, ["capture"], "window_index", "identifier_log_odds", COUNTS, REPETITIONS, 21)


@query("p17_contaminated_baselines", "capture contaminated:i repetition:i window_index:i identifier_log_odds:d replaced:i", "SELECT * FROM poisoned")
def p17(t):
    return poisoned(t)


RESERVOIR = 3000
cte(kept=f"""SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY can_id ORDER BY {_dg("'3|' || s.capture || '|' || seq")}, s.capture, seq) AS r
  FROM signals s JOIN sig_roles g ON g.capture = s.capture AND g.role = 'profile_fit') WHERE r <= {RESERVOIR}""")


def fit_rows(t, rows):
    """The rows of the captures that profiles are fitted on."""
    return rows.join(signal_roles(t).where(F.col("role") == "profile_fit").select("capture"), "capture")


@query("p18_reservoir", "can_id:i capture seq:i", "SELECT * FROM kept")
def p18(t):
    return splits.reservoir(fit_rows(t, t.signals()), ["can_id"], ["capture", "seq"], RESERVOIR, 3)


@query("p19_balanced_sample", "capture window_index:i",
       """SELECT DISTINCT w.capture, w.window_index FROM (SELECT *, count(*) OVER (PARTITION BY capture) AS n FROM w20) w
  JOIN (SELECT min(n) AS target FROM (SELECT count(*) AS n FROM w20 GROUP BY capture)) ON n = target OR EXISTS (
    SELECT 1 FROM range(target) g(i) WHERE round_even(i * ((n - 1)::DOUBLE / (target - 1)), 0) = w.window_index)""")
def p19(t):
    return splits.balanced_sample(can_gate.micro_windows(t), "capture", "window_index")


# --- joins -----------------------------------------------------------------------------------------

@query("j3_many_to_one", "split capture rows:i unmatched:i",
       "SELECT split, capture, count(*) AS rows, 0 AS unmatched FROM bucketed GROUP BY 1, 2")
def j3(t):
    rows = bucketed(t)
    table = rows.select("signature", "split").distinct()
    out = joins.lookup(rows.drop("split"), table, ["signature"])
    return out.groupBy("split", "capture").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("split").isNull().cast("int")).alias("unmatched"))


@query("j4_unused_windows", "capture parent_window_index:i",
       """SELECT capture, parent_window_index FROM parents p WHERE role = 'attack_capture' AND NOT EXISTS (SELECT 1 FROM replayed d
  WHERE d.source_file = p.capture AND d.parent_window_index = p.parent_window_index)""")
def j4(t):
    used = replay.decisions(t).select(F.col("source_file").alias("capture"), "parent_window_index").distinct()
    return can_gate.multiscale(t).where(F.col("role") == "attack_capture").join(used, ["capture", "parent_window_index"], "left_anti")


@query("j5_conflicting_rows", "capture window_index:i binary_target:i signature",
       """SELECT capture, window_index, binary_target, signature FROM wsigned WHERE signature IN (SELECT signature FROM wsigned GROUP BY 1
  HAVING count(DISTINCT binary_target) > 1)""")
def j5(t):
    rows = window_signed(t)
    return rows.join(splits.crossing_signatures(rows, "signature", "binary_target"), "signature", "left_semi")


@query("j6_alignment_audit", "left_rows:i right_rows:i matched_keys:i left_only:i right_only:i duplicate_keys:i mismatches:i",
       """SELECT (SELECT count(*) FROM rolled) AS left_rows, (SELECT count(*) FROM parent_gate) AS right_rows,
  count(*) FILTER (l.c IS NOT NULL AND r.c IS NOT NULL) AS matched_keys, count(*) FILTER (r.c IS NULL) AS left_only,
  count(*) FILTER (l.c IS NULL) AS right_only, 0 AS duplicate_keys,
  count(*) FILTER (l.c IS NOT NULL AND r.c IS NOT NULL AND a IS DISTINCT FROM b) AS mismatches
  FROM (SELECT capture AS c, parent_window_index AS w, micro_attack_frames AS a FROM rolled) l FULL JOIN
    (SELECT capture AS c, window_index AS w, attack_frame_count AS b FROM parent_gate) r ON l.c = r.c AND l.w = r.w""")
def j6(t):
    from busward.operators.windows import rollup_to_parent
    micro = rollup_to_parent(can_gate.micro_gate(t), ["alarm_instant"])
    parent = can_gate.parent_gate(t).withColumnRenamed("window_index", "parent_window_index")
    return joins.one_to_one_audit(micro, parent, ["capture", "parent_window_index"], [("micro_attack_frames", "attack_frame_count")])


@query("j11_union_of_captures", "capture rows:i",
       "SELECT capture, count(*) AS rows FROM (SELECT capture, ts_us FROM frames UNION ALL SELECT capture, ts_us FROM timed) GROUP BY 1")
def j11(t):
    both = t.frames().select("capture", "seq", "ts_us").unionByName(t.timed().select("capture", "seq", "ts_us"))
    return both.groupBy("capture").agg(F.count(F.lit(1)).alias("rows"))


@query("j12_shared_signatures", "kind signatures:i",
       """SELECT 'shared' AS kind, count(*) AS signatures FROM (SELECT signature FROM chrono WHERE split = 'train' INTERSECT
    SELECT signature FROM chrono WHERE split = 'test') UNION ALL
  SELECT 'test_only', count(*) FROM (SELECT signature FROM chrono WHERE split = 'test' EXCEPT SELECT signature FROM chrono WHERE split = 'train')""")
def j12(t):
    rows = chrono(t)
    train, test = (rows.where(F.col("split") == s).select("signature") for s in ("train", "test"))
    n = F.count(F.lit(1)).alias("signatures")
    return train.intersect(test).agg(n).select(F.lit("shared").alias("kind"), "signatures").unionByName(
        test.exceptAll(train).distinct().join(train, "signature", "left_anti").agg(n).select(F.lit("test_only").alias("kind"), "signatures"))


@query("j13_previous_by_key", "capture can_id:i seq:i s1:d previous_s1:d previous_s4:d",
       """SELECT capture, can_id, seq, s1, lag(s1) OVER w AS previous_s1, lag(s4) OVER w AS previous_s4 FROM signals
  WINDOW w AS (PARTITION BY capture, can_id ORDER BY seq)""")
def j13(t):
    from busward.operators.signals import with_previous
    return with_previous(t.signals(), ["s1", "s4"], "previous_")


@query("j14_snapshot_diff", "key before_digest after_digest status",
       """SELECT coalesce(b.k, a.k) AS key, coalesce(b.d, 'missing') AS before_digest, coalesce(a.d, 'missing') AS after_digest,
  CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.d = b.d THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT capture || '/' || window_index AS k, content_sha256 AS d FROM hash100 WHERE window_index % 7 <> 0) b
  FULL JOIN (SELECT capture || '/' || window_index AS k, CASE WHEN window_index % 5 = 0 THEN labelled_sha256 ELSE content_sha256 END AS d
    FROM hash100 WHERE window_index % 9 <> 0) a ON a.k = b.k""")
def j14(t):
    from busward.catalog.frames import w10
    hashed = w10(t).withColumn("key", F.concat_ws("/", "capture", F.col("window_index").cast("string")))
    after = hashed.where(F.col("window_index") % 9 != 0).withColumn(
        "content_sha256", F.when(F.col("window_index") % 5 == 0, F.col("labelled_sha256")).otherwise(F.col("content_sha256")))
    return joins.snapshot_diff(hashed.where(F.col("window_index") % 7 != 0), after, "key", "content_sha256")


# --- quality ---------------------------------------------------------------------------------------

WORDS = ("true", "No", "1", "maybe", " YES ", "0")


@query("v1_coercion", "run:i seq:i parsed:i unknown:i sources:i without_state:i",
       f"""SELECT c.run, c.seq, CASE WHEN w IN ('true', '1', 'yes') THEN 1 WHEN w IN ('false', '0', 'no') THEN 0 END AS parsed,
  CASE WHEN w IN ('true', '1', 'yes', 'false', '0', 'no') THEN 0 ELSE 1 END AS unknown,
  m_gnss + m_v2x + m_sensor_control + m_identity + m_device_posture AS sources, m_gnss + m_v2x + m_identity + m_device_posture AS without_state
  FROM (SELECT *, lower(trim({list(WORDS)}[(k % 6) + 1])) AS w FROM context) c JOIN mon_active USING (run, seq)""")
def v1(t):
    text = F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("k") % 6 + 1).cast("int"))
    rows = replay.monitored(t.context()).withColumn("parsed", parse_boolean(text))
    names = F.col("active_noncan_sources")
    return rows.select("run", "seq", "parsed", F.col("parsed").isNull().cast("int").alias("unknown"),
                       F.size(split_sources(names)).alias("sources"),
                       F.size(split_sources(names, ("sensor_control",))).alias("without_state"))


@query("v2_file_audit", "capture rows:i columns:i null_cells:i duplicate_rows:i duplicate_percentage:d missing_columns unexpected_columns",
       """SELECT capture, count(*) AS rows, 6 AS columns, count(*) FILTER (s3 IS NULL) + count(*) FILTER (s4 IS NULL) AS null_cells,
  count(*) - count(DISTINCT (can_id, label, s1, s2, coalesce(s3, -1), coalesce(s4, -1))) AS duplicate_rows,
  100e0 * (count(*) - count(DISTINCT (can_id, label, s1, s2, coalesce(s3, -1), coalesce(s4, -1)))) / count(*) AS duplicate_percentage,
  's5' AS missing_columns, 'label' AS unexpected_columns FROM signals GROUP BY 1""")
def v2(t):
    return quality.file_audit(t.signals(), "capture", ["can_id", "label", "s1", "s2", "s3", "s4"], ["can_id", "s1", "s2", "s3", "s4", "s5"])


@query("v3_value_distribution", "capture target_column class_value count:i percentage:d",
       """SELECT capture, target_column, class_value, n AS count, round(100e0 * n / sum(n) OVER (PARTITION BY capture, target_column), 4) AS percentage
  FROM (SELECT capture, target_column, class_value, count(*) AS n FROM (SELECT capture, 'can_id' AS target_column, can_id::VARCHAR AS class_value
    FROM signals UNION ALL SELECT capture, 'tax', coalesce(s3::INTEGER::VARCHAR, '<MISSING>') FROM signals) GROUP BY 1, 2, 3)""")
def v3(t):
    return quality.value_distribution(t.signals().withColumn("tax", F.col("s3").cast("int")), "capture", ["can_id", "tax"])


@query("v6_duplicate_keys", "l_orderkey:i l_linenumber:i rows:i",
       "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v6(t):
    return quality.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query("v7_range_guard", "phase gnss_score_null:i gnss_score_nan:i gnss_score_outside:i acceleration_outside:i speed_outside:i",
       """SELECT phase, count(*) FILTER (gnss_score IS NULL) AS gnss_score_null, 0 AS gnss_score_nan,
  count(*) FILTER (NOT gnss_score BETWEEN 0e0 AND 1e0) AS gnss_score_outside, count(*) FILTER (NOT acceleration BETWEEN -2e0 AND 2e0)
  AS acceleration_outside, count(*) FILTER (NOT speed BETWEEN 0e0 AND 30e0) AS speed_outside FROM context GROUP BY 1""")
def v7(t):
    return quality.range_violations(t.context(), ["phase"], {"gnss_score": (0.0, 1.0), "acceleration": (-2.0, 2.0), "speed": (0.0, 30.0)})


@query("v8_inversions", "capture rows:i inversions:i",
       """SELECT capture, count(*) AS rows, count(*) FILTER (ts_us < before) AS inversions FROM (SELECT capture, ts_us,
  lag(ts_us) OVER (PARTITION BY capture ORDER BY seq) AS before FROM frames) GROUP BY 1""")
def v8(t):
    return quality.inversions(t.frames(), ["capture"], "seq", "ts_us")


@query("v9_alignment", "rows:i unmatched_rows:i different_rows:i aligned:i",
       """SELECT count(*) AS rows, 0 AS unmatched_rows, count(*) FILTER (seq % 1000 = 7) AS different_rows, 0 AS aligned FROM frames""")
def v9(t):
    frames = t.frames()
    other = frames.withColumn("d0", F.when(F.col("seq") % 1000 == 7, F.col("d0") + 1).otherwise(F.col("d0")))
    return quality.alignment(frames, other, ["capture", "seq"], list(FIELDS))


@query("v10_labels_per_file", "capture is_attack_values:i d2_values:i single:i",
       """SELECT capture, count(DISTINCT is_attack) AS is_attack_values, count(DISTINCT d2) AS d2_values,
  CASE WHEN count(DISTINCT is_attack) = 1 AND count(DISTINCT d2) = 1 THEN 1 ELSE 0 END AS single FROM frames GROUP BY 1""")
def v10(t):
    return quality.labels_per_file(t.frames(), "capture", ["is_attack", "d2"])


@query("v11_class_coverage", "split classes:i missing_classes complete:i",
       """SELECT split, len(have) AS classes, coalesce((SELECT string_agg(b, ';' ORDER BY b) FROM (SELECT DISTINCT density_band AS b FROM chrono)
    WHERE NOT list_contains(have, b)), '') AS missing_classes,
  CASE WHEN len(have) = (SELECT count(DISTINCT density_band) FROM chrono) THEN 1 ELSE 0 END AS complete
  FROM (SELECT split, list(DISTINCT density_band) AS have FROM chrono GROUP BY 1)""")
def v11(t):
    return quality.class_coverage(chrono(t), "split", "density_band")


@query("a21_allocation_summary", "capture split rows:i signatures:i percentage:d",
       """SELECT capture, split, count(*) AS rows, count(DISTINCT signature) AS signatures,
  100e0 * count(*) / sum(count(*)) OVER (PARTITION BY capture) AS percentage FROM chrono GROUP BY 1, 2""")
def a21(t):
    from pyspark.sql import Window
    counted = chrono(t).groupBy("capture", "split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("signature").alias("signatures"))
    return counted.withColumn("percentage", 100.0 * F.col("rows") / F.sum("rows").over(Window.partitionBy("capture")))
