"""Queries that write captures in their file formats, read them back and parse them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from busward.catalog.frames import hex_payload, timing_ctes, typed_frames, window_ctes
from busward.catalog.leakage import chrono
from busward.catalog.registry import cte, query
from busward.operators import quality, windows
from busward.plans.adapters import PAYLOAD
from busward.session import shared_folder
from busward.sources import captures, profile

SUMS = " ".join(f"sum_{b}:i" for b in PAYLOAD)
_sums_sql = ", ".join(f"sum({b}) AS sum_{b}" for b in PAYLOAD)


def folder(t, name):
    return f"{shared_folder(t.spark).rstrip('/')}/busward-{uuid.uuid4().hex}/{name}"


def seconds():
    """Time stamp text; shifted so that it is never negative."""
    micros = F.col("ts_us") + 2_000_000
    return F.format_string("%d.%06d", F.floor(micros / 1_000_000), micros % 1_000_000)


def sums():
    return [F.sum(b).alias(f"sum_{b}") for b in PAYLOAD]


@query("s1_labelled_csv", f"capture label specific_class rows:i last_seq:i {SUMS}",
       f"""SELECT capture, CASE WHEN is_attack = 1 THEN 'ATTACK' ELSE 'BENIGN' END AS label, 'class_' || d2 AS specific_class, count(*) AS rows,
  max(seq) AS last_seq, {_sums_sql} FROM frames GROUP BY 1, 2, 3""")
def s1(t):
    label = F.when(F.col("is_attack") == 1, " attack ").otherwise(" Benign")
    out = t.frames().select("capture", "seq", F.col("can_id").alias("ID"), *[F.col(b).alias(f"DATA_{i}") for i, b in enumerate(PAYLOAD)],
                            label.alias("label"), F.lit("bus").alias("category"), F.concat(F.lit("class_"), F.col("d2"), F.lit(" ")).alias("specific_class"))
    path = folder(t, "labelled")
    out.write.partitionBy("capture").option("header", True).csv(path)
    return captures.read_labelled_frames(t.spark, path).groupBy("capture", "label", "specific_class").agg(
        F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last_seq"), *sums())


_bytes_dlc = ", ".join(f"sum(CASE WHEN seq % 9 > {i} THEN {b} ELSE 0 END) AS sum_{b}" for i, b in enumerate(PAYLOAD))


@query("s2_variable_csv", f"capture dlc:i valid:i rows:i attack:i sum_id:i {SUMS}",
       f"""SELECT capture, seq % 9 AS dlc, CASE WHEN seq % 1000 = 13 THEN 0 ELSE 1 END AS valid, count(*) AS rows,
  sum(CASE WHEN seq % 1000 = 13 THEN 0 ELSE is_attack END) AS attack, sum(can_id) AS sum_id, {_bytes_dlc} FROM frames GROUP BY 1, 2, 3""")
def s2(t):
    frames = t.frames().withColumn("dlc", F.col("seq") % 9)
    flag = F.when(F.col("seq") % 1000 == 13, "X").when(F.col("is_attack") == 1, "T").otherwise("R")
    cells = [F.when(F.col("dlc") > i, F.lower(F.lpad(F.hex(PAYLOAD[i]), 2, "0"))).when(F.col("dlc") == i, flag) for i in range(8)]
    cells.append(F.when(F.col("dlc") == 8, flag))
    line = F.concat_ws(",", seconds(), F.lpad(F.hex("can_id"), 4, "0"), F.col("dlc"), *cells)
    path = folder(t, "variable")
    frames.select("capture", line.alias("value")).write.partitionBy("capture").text(path)
    parsed = captures.read_variable_csv(t.spark, path)
    return parsed.groupBy("capture", "dlc", "valid").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("is_attack"), F.lit(0)).alias("attack"), F.sum("can_id").alias("sum_id"), *sums())


def text_log(t):
    """Frames as text log lines, some broken, with blank lines between."""
    frames = t.frames().withColumn("dlc", F.col("seq") % 9)
    cells = [F.when(F.col("dlc") > i, F.lower(F.lpad(F.hex(b), 2, "0"))) for i, b in enumerate(PAYLOAD)]
    line = F.concat(F.lit("Timestamp: "), seconds(), F.lit("        ID: "), F.lpad(F.hex("can_id"), 4, "0"),
                    F.lit("    000    DLC: "), F.col("dlc"), F.lit("    "), F.concat_ws(" ", *cells))
    text = F.when(F.col("seq") % 200 == 7, F.concat(F.lit("broken line "), F.col("can_id"))).otherwise(line)
    lines = F.when(F.col("seq") % 50 == 0, F.array(text, F.lit("  "))).otherwise(F.array(text))
    return frames.select("capture", "seq", F.posexplode(lines).alias("part", "value"))


def bus_dump(t):
    payload = F.when(F.col("seq") % 500 == 9, F.substring(hex_payload(), 1, 1)).otherwise(hex_payload())
    line = F.concat(F.lit("("), seconds(), F.lit(") can0 "), F.lpad(F.hex("can_id"), 3, "0"), F.lit("#"), payload)
    return t.frames().select("capture", "seq", F.lit(0).alias("part"), line.alias("value"))


def ordered_capture(t, rows, name):
    """Rows (capture, seq, part, ..) written in order as the files of their captures; returns the folder."""
    path = folder(t, name)
    placed = rows.repartitionByRange("capture", "seq").sortWithinPartitions("capture", "seq", "part").drop("seq", "part")
    writer = placed.write.partitionBy("capture")
    writer.text(path) if placed.columns == ["capture", "value"] else writer.option("header", True).csv(path)
    return path


def ordered_lines(t, rows, name):
    lines = captures.with_capture_order(captures.read_lines(t.spark, ordered_capture(t, rows, name)), whole_files=True)
    return lines.withColumn("line", F.col("value"))


def typed_in_order(t):
    """The damaged typed rows without a row number of their own, read back in the order of their files."""
    rows = typed_raw(t).withColumnRenamed("source_row_number", "seq").withColumn("part", F.lit(0))
    raw = captures.read_typed_csv(t.spark, ordered_capture(t, rows, "ordered"))
    return captures.parse_typed(captures.with_capture_order(raw, whole_files=True))


def file_windows(t, name, build):
    """Structural and timing features of 20-frame windows in one row; the files are read and parsed once for both."""
    frames = t.staged(f"{name}_frames", build)
    rows = frames.count()
    timing = windows.timing_features(frames, rows=rows).select("capture", "window_index", *windows.TIMING)
    return windows.window_features(frames, 20, rows=rows).join(timing, ["capture", "window_index"])


def parsed_lines(t, rows, name, parse):
    """Parsed lines of the files of the captures, as a table: it is numbered anew in two passes."""
    return t.staged(f"{name}_parsed", lambda: parse(ordered_lines(t, rows, name).drop("line")))


_bytes_sql = ", ".join(f"CASE WHEN seq % 9 > {i} THEN {b} ELSE 0 END AS {b}" for i, b in enumerate(PAYLOAD))
_anew = "row_number() OVER (PARTITION BY capture ORDER BY seq) - 1 AS seq"
cte(log_frames=f"SELECT capture, {_anew}, ts_us, can_id, {_bytes_sql}, 0 AS is_attack FROM frames WHERE seq % 200 <> 7",
    dump_frames=f"SELECT capture, {_anew}, ts_us, can_id, {', '.join(PAYLOAD)}, 0 AS is_attack FROM frames WHERE seq % 500 <> 9",
    raw_frames=f"SELECT capture, {_anew}, ts_us, can_id, {', '.join(PAYLOAD)}, is_attack FROM typed WHERE seq % 400 NOT BETWEEN 1 AND 6")
for _kind in ("log", "dump", "raw"):
    window_ctes(20, _kind, f"{_kind}_frames")
    timing_ctes(_kind, f"{_kind}_frames")
WINDOWED = "capture window_index:i start_row:i end_row:i attack_frame_count:i " + " ".join(f"{f}:d" for f in (*windows.STRUCTURAL, *windows.TIMING))


def windowed_sql(kind):
    return f"SELECT w.*, {', '.join(f't.{f}' for f in windows.TIMING)} FROM {kind}w20 w JOIN {kind}t20 t USING (capture, window_index)"


@query("s3_log_windows", WINDOWED, windowed_sql("log"))
def s3_windows(t):
    def build():
        rows = parsed_lines(t, text_log(t), "textlog", captures.parse_text_log)
        return captures.valid_frames(rows, "ts", rows=rows.count())
    return file_windows(t, "textlog", build)


@query("s4_dump_windows", WINDOWED, windowed_sql("dump"))
def s4_windows(t):
    def build():
        rows = parsed_lines(t, bus_dump(t), "dump", captures.parse_bus_dump)
        return captures.valid_frames(rows, "elapsed", rows=rows.count())
    return file_windows(t, "dump", build)


@query("s5_typed_windows", WINDOWED, windowed_sql("raw"))
def s5_windows(t):
    def build():
        rows = captures.typed_values(t.staged("typed_parsed", lambda: typed_in_order(t))).withColumn("ts", F.col("ts") / 1e6)
        return captures.valid_frames(rows, "ts", F.col("label") == "T", rows=rows.count())
    return file_windows(t, "typed", build)


def report_sql(source, bad, example, limit):
    return f"""SELECT capture, rows, malformed_rows, malformed_rows / rows::DOUBLE AS malformed_fraction,
  CASE WHEN malformed_rows / rows::DOUBLE <= {limit} THEN 1 ELSE 0 END AS passed, examples FROM (
  SELECT capture, count(*) AS rows, count(*) FILTER ({bad}) AS malformed_rows,
    coalesce(array_to_string((list({example} ORDER BY seq) FILTER ({bad}))[1:5], '|'), '') AS examples FROM {source} GROUP BY 1)"""


REPORT = "capture rows:i malformed_rows:i malformed_fraction:d passed:i examples"


@query("s3_malformed_lines", REPORT, report_sql(
    "frames", "seq % 200 = 7", "(seq + (seq + 49) // 50) || ': broken line ' || can_id", "0.01e0"))
def s3_malformed(t):
    parsed = captures.parse_text_log(ordered_lines(t, text_log(t), "textlog"))
    return quality.malformed_report(parsed, ["capture"], "seq", "line", 0.01).withColumn("examples", F.array_join("examples", "|"))


@query("s4_malformed_lines", REPORT, report_sql(
    "frames", "seq % 500 = 9", "seq || ': (' || printf('%d.%06d', (ts_us + 2000000) // 1000000, (ts_us + 2000000) % 1000000) || ') can0 ' "
    "|| lpad(upper(to_hex(can_id)), 3, '0') || '#' || upper(to_hex(d0 // 16))", "0.001e0"))
def s4_malformed(t):
    parsed = captures.parse_bus_dump(ordered_lines(t, bus_dump(t), "dump"))
    return quality.malformed_report(parsed, ["capture"], "seq", "line", 0.001).withColumn("examples", F.array_join("examples", "|"))


@query("s3_text_log", f"capture valid:i lines:i sum_id:i {SUMS}",
       f"""SELECT capture, CASE WHEN seq % 200 = 7 THEN 0 ELSE 1 END AS valid, count(*) AS lines, sum(CASE WHEN seq % 200 <> 7 THEN can_id END) AS sum_id,
  {', '.join(f"sum(CASE WHEN seq % 200 <> 7 AND seq % 9 > {i} THEN {b} ELSE 0 END) AS sum_{b}" for i, b in enumerate(PAYLOAD))} FROM frames GROUP BY 1, 2""")
def s3(t):
    path = folder(t, "textlog")
    text_log(t).select("capture", "value").write.partitionBy("capture").text(path)
    parsed = captures.parse_text_log(captures.read_lines(t.spark, path))
    return parsed.groupBy("capture", "valid").agg(F.count(F.lit(1)).alias("lines"), F.sum("can_id").alias("sum_id"), *sums())


@query("s4_bus_dump", f"capture valid:i lines:i sum_id:i last_elapsed:d {SUMS}",
       f"""SELECT f.capture, CASE WHEN seq % 500 = 9 THEN 0 ELSE 1 END AS valid, count(*) AS lines, sum(can_id) AS sum_id, (max(ts_us) - any_value(first)) / 1e6 AS last_elapsed,
  {', '.join(f"sum(CASE WHEN seq % 500 = 9 AND {i} = 0 THEN d0 // 16 * 16 WHEN seq % 500 = 9 THEN 0 ELSE {b} END) AS sum_{b}" for i, b in enumerate(PAYLOAD))}
  FROM frames f JOIN (SELECT capture, min(ts_us) AS first FROM frames GROUP BY 1) USING (capture) GROUP BY 1, 2""")
def s4(t):
    path = folder(t, "dump")
    bus_dump(t).select("capture", "value").write.partitionBy("capture").text(path)
    parsed = captures.parse_bus_dump(captures.read_lines(t.spark, path))
    return parsed.groupBy("capture", "valid").agg(F.count(F.lit(1)).alias("lines"), F.sum("can_id").alias("sum_id"),
                                                  F.max("elapsed").alias("last_elapsed"), *sums())


def typed_raw(t):
    """Typed raw rows with one kind of damage per residue."""
    frames = typed_frames(t).withColumn("r", F.col("seq") % 400)
    return frames.select(
        "capture", F.col("seq").alias("source_row_number"),
        F.when(F.col("r") == 1, "late").otherwise(F.col("ts_us").cast("string")).alias("tiTestaTp"),
        F.when(F.col("r") == 2, "0xZ").otherwise(F.lower(F.hex("can_id"))).alias("arbitration_id"),
        F.when(F.col("r") == 3, "8.5").otherwise("8").alias("dlc"),
        *[F.when(F.col("r") == 4, "ABC").otherwise(F.lower(F.hex(b))).alias(f"data{i}") for i, b in enumerate(PAYLOAD)],
        F.when(F.col("r") == 5, "Q").when(F.col("is_attack") == 1, " t").otherwise("r ").alias("label"),
        F.when(F.col("r") == 6, "Alien").otherwise(F.col("attack_type")).alias("Attack_Type"))


def typed_checked(t):
    """The damaged rows written as CSV, read back and checked."""
    path = folder(t, "typed")
    typed_raw(t).write.option("header", True).csv(path)
    return captures.parse_typed(captures.read_typed_csv(t.spark, path))


cte(typed_bad="""SELECT *, CASE seq % 400 WHEN 1 THEN 'timestamp_parseable' WHEN 2 THEN 'arbitration_id_hex' WHEN 3 THEN 'dlc_integer_0_to_8'
  WHEN 4 THEN 'payload_matches_dlc' WHEN 5 THEN 'label_recognised;label_attack_type_consistent'
  WHEN 6 THEN CASE WHEN is_attack = 1 THEN 'attack_type_recognised' ELSE 'attack_type_recognised;label_attack_type_consistent' END ELSE '' END AS failure_reasons FROM typed""")


@query("s5_typed_csv", "capture failure_reasons rows:i", "SELECT capture, failure_reasons, count(*) AS rows FROM typed_bad GROUP BY 1, 2")
def s5(t):
    return typed_checked(t).groupBy("capture", "failure_reasons").agg(F.count(F.lit(1)).alias("rows"))


@query("v4_check_matrix", "capture check_name rows_checked:i failed_rows:i passed:i",
       f"""SELECT capture, k AS check_name, n AS rows_checked, f AS failed_rows, CASE WHEN f = 0 THEN 1 ELSE 0 END AS passed FROM (SELECT capture, k, count(*) AS n,
  sum(CASE WHEN list_contains(string_split(failure_reasons, ';'), k) THEN 1 ELSE 0 END) AS f FROM (SELECT *, unnest({list(captures.CHECKS)}) AS k FROM typed_bad) GROUP BY 1, 2)""")
def v4(t):
    return quality.check_counts(typed_checked(t), "capture", captures.CHECKS)


@query("v5_malformed_gate", "capture rows:i malformed_rows:i malformed_fraction:d passed:i",
       """SELECT *, malformed_rows / rows::DOUBLE AS malformed_fraction, CASE WHEN malformed_rows / rows::DOUBLE <= 0.0001e0 THEN 1 ELSE 0 END AS passed FROM (
  SELECT capture, count(*) AS rows, count(*) FILTER (failure_reasons <> '') AS malformed_rows FROM typed_bad GROUP BY 1)""")
def v5(t):
    return quality.malformed_gate(typed_checked(t), ["capture"], 1e-4)


@query("s6_signal_csv", "capture can_id:i label:i rows:i sum_s1:d present_s3:i present_s4:i width:i",
       """SELECT capture, can_id, label, count(*) AS rows, sum(s1) AS sum_s1, count(s3) AS present_s3, count(s4) AS present_s4, 22 AS width
  FROM signals WHERE seq % 100 <> 0 GROUP BY 1, 2, 3""")
def s6(t):
    out = t.signals().select(
        "capture", F.col("label").alias("Label"), F.col("time").alias("Time"),
        F.when(F.col("seq") % 100 != 0, F.col("can_id").cast("double")).alias("ID"),
        *[(F.col(f"s{i + 1}") if i < 4 else F.lit(None).cast("double")).alias(c) for i, c in enumerate(captures.SIGNAL_COLUMNS)])
    path = folder(t, "signals")
    out.write.partitionBy("capture").option("header", True).csv(path)
    rows = captures.read_signals(t.spark, path)
    at = lambda i: F.get("signals", F.lit(i))
    return rows.groupBy("capture", "can_id", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(at(0)).alias("sum_s1"), F.count(at(2)).alias("present_s3"), F.count(at(3)).alias("present_s4"),
        F.max(F.size("signals")).alias("width"))


@query("s7_capture_metadata", "capture elapsed_sec:d injection_id interval_start:d interval_end:d modified:i",
       """SELECT capture, max(ts_us) / 1e6 AS elapsed_sec, CASE WHEN capture = 'N_F' THEN NULL ELSE 'XXX' END AS injection_id,
  CASE WHEN capture = 'N_F' THEN NULL ELSE min(CASE WHEN is_attack = 1 THEN ts_us END) / 1e6 END AS interval_start,
  CASE WHEN capture = 'N_F' THEN NULL ELSE max(ts_us) / 1e6 END AS interval_end, starts_with(capture, 'R')::INTEGER AS modified FROM frames GROUP BY 1""")
def s7(t):
    per = t.frames().groupBy("capture").agg(F.max("ts_us").alias("last"), F.min(F.when(F.col("is_attack") == 1, F.col("ts_us"))).alias("first"))
    healthy = F.col("capture") == "N_F"
    entry = F.struct(F.lit("derived").alias("description"), (F.col("last") / 1e6).alias("elapsed_sec"), F.lit(None).cast("string").alias("injection_data_str"),
                     F.when(~healthy, "XXX").alias("injection_id"),
                     F.when(~healthy, F.array(F.col("first") / 1e6, F.col("last") / 1e6)).alias("injection_interval"),
                     F.col("capture").startswith("R").alias("modified"), F.lit(True).alias("on_dyno"))
    path = folder(t, "metadata")
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("capture", entry)))).alias("value")).write.text(path)
    return captures.read_metadata(t.spark, path)


@query("s8_run_key", "run_key:i rows:i last_seq:i", "SELECT run AS run_key, count(*) AS rows, max(seq) AS last_seq FROM context GROUP BY 1")
def s8(t):
    path = folder(t, "runs")
    named = t.context().select(F.concat(F.lit("context_attacks_seed_"), F.col("run")).alias("file"), "seq")
    captures.write_gathered(named, path, "file", F.floor(F.col("seq") / captures.FILE_ROWS))
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"file=([^/]+)/", 1)
    return t.spark.read.parquet(path).select(captures.run_key(stem).alias("run_key"), "seq").groupBy("run_key").agg(
        F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last_seq"))


@query("s9_file_manifest", "file length:i sha256", None)
def s9(t):
    return profile.file_manifest(t.spark, t.folder)


# Tables of the data set and their columns.
PROFILED = {
    "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "embeddings": "vec_id embedding label",
    "conversations": "conv_id turn role text",
}


@query("s9_dataset_profile", "table_name rows:i columns:i null_cells:i duplicate_rows:i same_as_first:i",
       " UNION ALL ".join(
           f"""SELECT '{n}' AS table_name, count(*) AS rows, {len(c.split())} AS columns, {' + '.join(f"count(*) FILTER ({x} IS NULL)" for x in c.split())} AS null_cells,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(c.split())} FROM {n})) AS duplicate_rows, {int(n == "nation")} AS same_as_first FROM {n}"""
           for n, c in PROFILED.items()))
def s9_profile(t):
    tables = {n: t.read(n).select(*c.split()) for n, c in PROFILED.items()}
    return profile.audit_tables(tables, [], key=F.lit("all")).withColumnRenamed("table", "table_name")


_audit_sql = """SELECT capture, count(*) AS rows, {columns} AS columns, count(*) FILTER (s3 IS NULL){s4} AS null_cells,
  count(*) - count(DISTINCT (can_id, s1, coalesce(s3, -1){s4v})) AS duplicate_rows, {same} AS same_as_first, '{missing}' AS missing_columns, '{extra}' AS unexpected_columns
  FROM (SELECT * FROM signals WHERE starts_with(capture, 'ambient')) GROUP BY 1"""


@query("v2_schema_differences", "capture rows:i columns:i null_cells:i duplicate_rows:i same_as_first:i missing_columns unexpected_columns",
       _audit_sql.format(columns=4, s4=" + count(*) FILTER (s4 IS NULL)", s4v=", coalesce(s4, -1)", same=1, missing="", extra="") + " UNION ALL "
       + _audit_sql.format(columns=3, s4="", s4v="", same=0, missing="s4", extra="").replace("'ambient'", "'attack'"))
def v2_schema(t):
    """Captures written in two layouts, the attacks without a column, audited file by file."""
    path, kinds = folder(t, "audit"), {"ambient": ["can_id", "s1", "s3", "s4"], "attack": ["can_id", "s1", "s3"]}
    for kind, columns in kinds.items():
        t.signals().where(F.col("capture").startswith(kind)).select("capture", *columns).write.partitionBy("capture").parquet(f"{path}/{kind}")
    tables = {kind: t.spark.read.parquet(f"{path}/{kind}") for kind in kinds}
    return profile.audit_tables(tables, kinds["ambient"], key=F.col("capture"), ignore=["capture"]).withColumnRenamed("file", "capture")


@query("s10_partitioned_sink", "split capture windows:i", "SELECT split, capture, count(*) AS windows FROM chrono GROUP BY 1, 2")
def s10(t):
    path = folder(t, "splits")
    captures.write_partitioned(chrono(t), path, ["split"])
    return t.spark.read.parquet(path).groupBy("split", "capture").agg(F.count(F.lit(1)).alias("windows"))
