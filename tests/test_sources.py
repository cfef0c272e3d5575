"""Hand-made lines for every file format, good and bad."""

from pyspark.sql import functions as F

from busward.operators import quality, windows
from busward.sources import captures


def test_variable_csv_cases(spark):
    cases = [  # timestamp, id, dlc, nine tail cells
        ("1.0", "0316", "8", "05", "21", "68", "09", "21", "21", "00", "6f", "R"),
        ("1.1", "018f", "2", "fe", "5b", "T", None, None, None, None, None, None),
        ("1.2", "0260", "0", "R", None, None, None, None, None, None, None, None),
        ("1.3", "0260", "1", "aa", None, None, None, None, None, None, None, None),
        ("1.4", "0260", "1", "R", "T", None, None, None, None, None, None, None),
        ("1.5", "0260", "3", "aa", "R", None, None, None, None, None, None, None),
        ("1.6", "0260", "1", "1ff", "R", None, None, None, None, None, None, None),
    ]
    names = "timestamp string, can_id_hex string, dlc_text string, " + ", ".join(f"t{i} string" for i in range(9))
    out = captures.parse_variable_csv(spark.createDataFrame(cases, names)).orderBy("ts").collect()
    assert [r["valid"] for r in out] == [1, 1, 1, 0, 0, 0, 0]
    assert (out[0]["can_id"], out[0]["d1"], out[0]["d7"], out[0]["is_attack"]) == (0x316, 0x21, 0x6F, 0)
    assert (out[1]["d0"], out[1]["d1"], out[1]["d2"], out[1]["is_attack"]) == (0xFE, 0x5B, 0, 1)


def test_text_log_cases(spark):
    lines = ["Timestamp: 1479121434.850202        ID: 0350    000    DLC: 8    05 28 84 66 6d 00 00 a2",
             "Timestamp: 2.5        ID: 05f0    000    DLC: 2    f4 00", "   ", "no frame here"]
    out = captures.parse_text_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert len(out) == 3 and sum(r["valid"] for r in out) == 2
    first = next(r for r in out if r["can_id"] == 0x350)
    assert (first["d0"], first["d7"], first["dlc"]) == (5, 0xA2, 8)
    short = next(r for r in out if r["can_id"] == 0x5F0)
    assert (short["d0"], short["d1"], short["d2"]) == (0xF4, 0, 0)


def test_bus_dump_cases(spark):
    lines = [("c", "(1000.000123) can0 0D0#0011223344556677"), ("c", "(1000.500123) can0 0D1#"),
             ("c", "(1001.0) can0 0D0#001"), ("c", "(1001.5) can0 0D0#001122334455667788"), ("c", "junk")]
    out = captures.parse_bus_dump(spark.createDataFrame(lines, "capture string, value string"))
    rows = out.orderBy("elapsed").collect()
    assert sum(r["valid"] for r in rows) == 2
    good = [r for r in rows if r["valid"]]
    assert good[0]["d7"] == 0x77 and good[1]["d0"] == 0 and abs(good[1]["elapsed"] - 0.5) < 1e-6


def test_typed_checks_name_each_failure(spark):
    base = ["1.0", "1A", "2", "FF", "01", *[None] * 6, "R", "Normal"]
    names = "timestamp string, arbitration_id string, dlc string, " + ", ".join(f"data{i} string" for i in range(8)) + ", label string, attack_type string"

    def changed(i, v):
        return tuple(v if j == i else x for j, x in enumerate(base))

    cases = [tuple(base), changed(0, "x"), changed(1, "G1"), changed(2, "9"), changed(3, "GG"), changed(11, "Q"), changed(12, "DoS")]
    out = captures.parse_typed(spark.createDataFrame(cases, names)).collect()
    assert sorted(r["failure_reasons"] for r in out) == sorted([
        "", "timestamp_parseable", "arbitration_id_hex", "dlc_integer_0_to_8;payload_matches_dlc", "payload_matches_dlc",
        "label_recognised;label_attack_type_consistent", "label_attack_type_consistent"])
    assert captures.quarantine(captures.parse_typed(spark.createDataFrame(cases, names)), []).count() == 6


def test_signature_run_key_and_phase(spark):
    df = spark.createDataFrame([(16, "0011", "10", "00XXXXXXXXXXXXXX", "context_runs_seed_2031.csv")],
                               "can_id int, payload string, injected string, mask string, file string")
    r = df.select(windows.signature_match(F.col("can_id"), F.col("payload"), F.col("injected"), F.col("mask")).alias("m"),
                  captures.run_key(F.col("file")).alias("k"),
                  windows.step_phase(F.lit(120), [(0, 120, "a"), (120, 200, "b")], "z").alias("p")).first()
    assert (r["m"], r["k"], r["p"]) == (1, 2031, "b")


def test_metadata_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"x_1": {"elapsed_sec": 2.5, "injection_id": "0D0", "injection_interval": [1.0, 2.0], "modified": true},'
                                     ' "y": {"elapsed_sec": 3.0, "injection_interval": null}}')
    out = {r["capture"]: r for r in captures.read_metadata(spark, str(tmp_path / "m.json")).collect()}
    assert out["x_1"]["interval_end"] == 2.0 and out["y"]["interval_start"] is None and out["x_1"]["modified"]


def test_timing_without_positive_intervals(spark):
    frames = spark.createDataFrame([("c", i, 5, 0) for i in range(20)], "capture string, seq bigint, ts_us bigint, is_attack int")
    r = windows.timing_features(frames).first()
    assert r["log_iat_mean_us"] == 0 and r["iat_nonpositive_fraction"] == 1.0 and r["iat_burst_fraction"] == 0


def test_quality_require_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    try:
        quality.require_columns(df, ["a", "b"], "table")
    except ValueError as error:
        assert "b" in str(error)
    else:
        raise AssertionError("missing column not reported")


def test_malformed_hex_is_not_zero(spark):
    names = "timestamp string, can_id_hex string, dlc_text string, " + ", ".join(f"t{i} string" for i in range(9))
    cases = [("1.0", "ZZ", "0", "R", *[None] * 8), ("1.1", "0260", "1", "GG", "R", *[None] * 7), ("1.2", "FFFFFFFF", "0", "R", *[None] * 8)]
    out = {r["ts"]: r for r in captures.parse_variable_csv(spark.createDataFrame(cases, names)).collect()}
    assert [out[t]["valid"] for t in (1.0, 1.1, 1.2)] == [0, 0, 1]
    assert out[1.0]["can_id"] is None and out[1.2]["can_id"] == 0xFFFFFFFF
    lines = [("c", "(1.0) can0 FFFFFFFF#00"), ("c", "(1.5) can0 ZZ#00"), ("c", "(2.0) can0 1#0G"), ("c", "1.0 can0 1#00"), ("c", "(3.0) can0 1#00 more")]
    dump = captures.parse_bus_dump(spark.createDataFrame(lines, "capture string, value string")).collect()
    assert sorted((r["can_id"] or -1, r["valid"]) for r in dump) == sorted([(0xFFFFFFFF, 1), (-1, 0), (1, 0), (1, 0), (1, 0)])
    logs = [("Timestamp: 1.0 ID: ZZ 000 DLC: 1 00",), ("Timestamp: x ID: 1 000 DLC: 1 00",), ("Timestamp: 1.0 ID: FFFFFFFF 000 DLC: 1 GG",), ("ID: 1 DLC:",)]
    text = captures.parse_text_log(spark.createDataFrame(logs, "value string")).collect()
    assert sorted((r["can_id"] or -1, r["d0"], r["valid"]) for r in text) == sorted([(-1, 0, 0), (1, 0, 0), (0xFFFFFFFF, 0, 1), (1, 0, 0)])


def test_labelled_frames_by_name_in_file_order(spark, tmp_path):
    (tmp_path / "x.csv").write_text("category,ID," + ",".join(f"DATA_{i}" for i in range(8)) + ",label,specific_class\n" + "".join(
        f"bus,{i},{','.join(str((i + k) % 256) for k in range(8))},Benign ,x\n" for i in range(500)))
    (tmp_path / "y.csv").write_text("ID," + ",".join(f"DATA_{i}" for i in range(8)) + ",label,category,specific_class\n" + "7,1,2,3,4,5,6,7,8, dos,a,DoS\n")
    rows = captures.read_labelled_frames(spark, f"{tmp_path}/x.csv").orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(500)) and all(r["can_id"] == r["seq"] and r["d7"] == (r["seq"] + 7) % 256 for r in rows)
    assert {(r["label"], r["category"]) for r in rows} == {("BENIGN", "bus")}
    (other,) = captures.read_labelled_frames(spark, f"{tmp_path}/y.csv").collect()
    assert (other["can_id"], other["d0"], other["d7"], other["label"], other["specific_class"]) == (7, 1, 8, "DOS", "DoS")


def test_lines_keep_their_order_over_blocks(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 1
        rows = captures.read_lines(spark, f"file://{tmp_path}", order=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert all(r["value"] == f"line {r['seq']}" for r in rows) and len(rows) == 3000


def test_capture_order_over_files_and_blocks(spark, tmp_path):
    for name, first in (("a", 0), ("b", 900)):
        (tmp_path / "capture=x").mkdir(exist_ok=True)
        (tmp_path / "capture=x" / f"{name}.log").write_text("".join(f"line {i}\n" for i in range(first, first + 900)))
    (tmp_path / "capture=y").mkdir()
    (tmp_path / "capture=y" / "a.log").write_text("line 0\nline 1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = captures.with_capture_order(captures.read_lines(spark, f"file://{tmp_path}")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 1802 and all(r["value"] == f"line {r['seq']}" for r in rows)


def test_order_of_whole_files_moves_no_line(spark, tmp_path):
    """Lines of whole files are numbered, and stamps counted from a capture's first, without a shuffle of the lines."""
    for name, first in (("a", 0), ("b", 900)):
        (tmp_path / "capture=x").mkdir(exist_ok=True)
        (tmp_path / "capture=x" / f"{name}.log").write_text("".join(f"({i}.5) can0 {i:X}#00\n" for i in range(first, first + 900)))
    (tmp_path / "capture=y").mkdir()
    (tmp_path / "capture=y" / "a.log").write_text("(7.5) can0 0#00\n\n(8.5) can0 1#00\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        parsed = captures.parse_bus_dump(captures.with_capture_order(captures.read_lines(spark, f"file://{tmp_path}"), whole_files=True))
        rows = parsed.collect()
        text = parsed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 1802
    assert all(r["can_id"] == r["elapsed"] == r["seq"] for r in rows if r["capture"] == "x")
    assert sorted((r["seq"], r["elapsed"]) for r in rows if r["capture"] == "y") == [(0, 0.0), (2, 1.0)]
    assert "SortMergeJoin" not in text


def test_valid_frames_are_numbered_without_gaps(spark):
    rows = [("c", i, i % 3 != 1, i / 10) for i in range(30)]
    parsed = spark.createDataFrame(rows, "capture string, seq long, valid boolean, ts double").selectExpr(
        "capture", "seq", "int(valid) AS valid", "ts", "7 AS can_id", *[f"1 AS d{i}" for i in range(8)])
    got = captures.valid_frames(parsed, "ts", bucket_rows=4).orderBy("seq").collect()
    assert [r["seq"] for r in got] == list(range(20))
    assert [r["ts_us"] for r in got] == [i * 100_000 for i in range(30) if i % 3 != 1]


def test_malformed_report_shows_the_first_lines(spark):
    rows = [("a", i, 0 if i % 2 else 1, f"l{i}") for i in range(20)] + [("b", 0, 1, "fine")]
    got = {r["capture"]: r for r in quality.malformed_report(
        spark.createDataFrame(rows, "capture string, seq long, valid int, line string"), ["capture"], "seq", "line", 0.1).collect()}
    assert got["a"]["examples"] == ["1: l1", "3: l3", "5: l5", "7: l7", "9: l9"]
    assert (got["a"]["rows"], got["a"]["malformed_rows"], got["a"]["passed"]) == (20, 10, 0)
    assert (got["b"]["examples"], got["b"]["passed"]) == ([], 1)


def test_runs_have_one_file_each(spark, tmp_path):
    """Rows of a run that lie in several tasks meet in one file, a long run's in one for each part."""
    rows = spark.range(400).select((F.col("id") % 20).alias("run"), F.floor(F.col("id") / 20).alias("seq")).repartition(8)
    captures.write_gathered(rows, f"{tmp_path}/one", "run", F.floor(F.col("seq") / 100))
    assert len(list((tmp_path / "one").glob("run=*/*.parquet"))) == 20
    captures.write_gathered(rows, f"{tmp_path}/two", "run", F.floor(F.col("seq") / 10))
    assert 20 <= len(list((tmp_path / "two").glob("run=*/*.parquet"))) <= 40
    read = spark.read.parquet(f"{tmp_path}/two")
    assert read.count() == 400 and read.groupBy("run").count().where("count <> 20").count() == 0
