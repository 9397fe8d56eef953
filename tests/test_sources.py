"""Readers, writers and text rules on small files."""

import json

import pytest
from pyspark.sql import functions as F

from strideframe.functions import text
from strideframe.sources import tables, writers
from strideframe.sources.schemas import COORDINATES, ContractError, feature_columns


def write(path, rows):
    path.write_text("\n".join(",".join(map(str, r)) for r in rows) + "\n")


def test_trajectories_and_rates(spark, tmp_path):
    header = ["frame", "other", *COORDINATES]
    write(tmp_path / "1_trajectory.csv", [header, [0, "x", *[0.5] * 12], [1, "y", "", "bad", *[0.25] * 10]])
    write(tmp_path / "02_trajectory.csv", [header, [0.0, "x", *["nan"] * 12]])
    write(tmp_path / "ignored.csv", [["a"], [1]])
    df = tables.read_trajectories(spark, str(tmp_path))
    rows = {(r.video_id, r.frame): r for r in df.collect()}
    assert set(rows) == {("1", 0), ("1", 1), ("2", 0)}
    assert rows["1", 1].left_shoulder_x is None and rows["1", 1].left_shoulder_y is None and rows["2", 0].left_wrist_x is None
    assert rows["1", 1].right_wrist_y == 0.25
    write(tmp_path / "fps.txt", [["Filename", "FPS"], ["A.mp4", 20], ["a_trajectory.csv", 25], ["b.mp4", 0], ["", 30], ["c", ""]])
    assert {tuple(r) for r in tables.read_fps_by_filename(spark, str(tmp_path / "fps.txt")).collect()} == {("a", 25.0)}
    write(tmp_path / "fps2.txt", [["Video", "FPS"], ["1.0", 20], ["1.mp4", 0], ["x_trajectory.csv", 12.5]])
    assert {tuple(r) for r in tables.read_fps_by_video(spark, str(tmp_path / "fps2.txt")).collect()} == {("1", 0.0), ("x", 12.5)}
    write(tmp_path / "fps3.txt", [["Filename", "FPS"], ["A", -1]])
    with pytest.raises(ValueError):
        tables.read_fps_by_filename(spark, str(tmp_path / "fps3.txt"))


def test_each_file_has_its_own_header(spark, tmp_path):
    """Columns in another order are read by name; a file without frames is refused or numbered."""
    names = ["frame", *COORDINATES]
    values = {c: 0.01 * (i + 1) for i, c in enumerate(COORDINATES)}
    turned = [*reversed(names), "extra"]
    write(tmp_path / "1_trajectory.csv", [names, *[[f, *values.values()] for f in range(3)]])
    write(tmp_path / "2_trajectory.csv", [turned, *[[*[f if c == "frame" else values[c] for c in reversed(names)], "x"] for f in range(3)]])
    rows = tables.read_trajectories(spark, str(tmp_path)).collect()
    assert sorted((r.video_id, r.frame) for r in rows) == [(v, f) for v in "12" for f in range(3)]
    assert all(abs(r[c] - values[c]) < 1e-12 for r in rows for c in COORDINATES)
    write(tmp_path / "3_trajectory.csv", [list(COORDINATES), *[list(values.values())] * 4])
    with pytest.raises(ContractError, match="3_trajectory.csv.*frame"):
        tables.read_trajectories(spark, str(tmp_path))
    stem = tables.read_trajectories(spark, str(tmp_path), video_rule="stem").collect()
    assert sorted((r.video_id, r.frame) for r in stem if r.video_id == "3") == [("3", f) for f in range(4)]
    write(tmp_path / "4_trajectory.csv", [names[:-1], [0] * 12])
    with pytest.raises(ContractError, match="4_trajectory.csv"):
        tables.read_trajectories(spark, str(tmp_path), video_rule="stem")
    with pytest.raises(FileNotFoundError):
        tables.scan_csv(spark, str(tmp_path), "_none.csv", [])


def test_segments_unite_by_name(spark, tmp_path):
    write(tmp_path / "1_segments.csv", [["Segment_ID", "a", "b"], ["s1", 1, 2.5], ["s2", 2, ""]])
    write(tmp_path / "2_segments.csv", [["b", "Video", "a", "c"], [3.5, "v.mp4", 3, "text"]])
    df = tables.read_segments(spark, str(tmp_path))
    assert {(c, t) for c, t in df.dtypes if c in "abc"} == {("a", "bigint"), ("b", "double"), ("c", "string")}
    assert sorted((r.Video, r.Segment_ID, r.a, r.b or 0.0, r.c) for r in df.collect()) == [
        ("1", "s1", 1, 2.5, None), ("1", "s2", 2, 0.0, None), ("v", "segment_0001", 3, 3.5, "text")]


def test_manual_boundaries(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"1.mp4": [5, 9], "cam": [], "7": [3]}))
    assert sorted(tuple(r) for r in tables.read_manual_boundaries(spark, str(tmp_path / "m.json")).collect()) == [("1", 5), ("1", 9), ("7", 3)]
    (tmp_path / "e.json").write_text("{}")
    with pytest.raises(ValueError):
        tables.read_manual_boundaries(spark, str(tmp_path / "e.json"))


def test_segments_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "3_segments.csv", [["Start_Frame", "speed", "pca_1"], [0, 1.5, 2], [10, 2.5, 3]])
    df = tables.read_segments(spark, str(folder))
    assert sorted((r.Video, r.Segment_ID) for r in df.collect()) == [("3", "segment_0001"), ("3", "segment_0002")]
    assert feature_columns(df, ["Start_Frame"], ["pca_"]) == ["speed"]
    assert writers.write_csv(df.withColumn("_private", F.lit(1)), str(tmp_path / "out"), by="Video")
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 2 and "_private" not in back.columns and {r.Video for r in back.collect()} == {"3"} == {r.Video_folder for r in back.select(F.col("Video_folder").cast("string")).collect()}
    assert not writers.write_csv(df.where("speed < 0"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    writers.write_manifest({"a": [1]}, str(tmp_path / "m" / "x.json"))
    assert json.loads((tmp_path / "m" / "x.json").read_text()) == {"a": [1]}
    assert writers.portable_path(str(tmp_path / "a" / "b.csv"), str(tmp_path)) == "a/b.csv"


def test_id_rules(spark):
    names = ["1.mp4", " /x/1_trajectory.csv ", "1.0", "A.B_trajectory.csv", "1_segments.csv", ".hidden", "1_2", "nan", "-3.9", "1e3", "x.0"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    c = F.col("n")
    rows = df.select(text.video_name(c), text.boundary_video_id(c), text.plain_video_id(c, text.CYCLE_TABLE_SUFFIXES)).collect()
    assert [r[0] for r in rows] == ["1", "1", "1", "a.b", "1_segments", ".hidden", "1_2", "nan", "-3", "1e3", "x"]
    assert [r[1] for r in rows] == ["1", "1", "1", "A", "1_segments", ".hidden", "12", "nan", "-3", "1000", "x"]
    assert [r[2] for r in rows] == ["1", "1", "1", "A.B", "1", ".hidden", "12", "nan", "-3", "1000", "x.0"]


def test_time_text(spark):
    df = spark.createDataFrame([("2000-01-01T00:00:00.1",), ("2000-01-01T00:00:00.1234567+08:00",), ("",), (None,), ("2000-01-01T00:00:02",)], "t string")
    got = [r[0] for r in df.select(text.micros_of(text.iso_time(F.col("t"))) - 946684800000000).collect()]
    assert got == [100000, 123456, None, None, 2000000]
    sec = spark.createDataFrame([(3725.9,), (61.0,), (5.2,), (None,)], "s double")
    assert [tuple(r) for r in sec.select(text.minutes_seconds(F.col("s")), text.hours_minutes_seconds(F.col("s"))).collect()][:3] == [
        ("62m 5s", "1h 2m 5s"), ("1m 1s", "1m 1s"), ("0m 5s", "5s")]


def test_tolerance_compare(spark):
    from strideframe.sources.compare import compare_tables

    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-13, "x"), (2, None, "y")], "k int, v double, s string")
    same = compare_tables(a, b, ["k"], ["v", "s"])
    assert same["passed"] and not same["columns"]["v"]["exactly_equal"] and same["columns"]["s"]["exactly_equal"]
    assert not compare_tables(a, b, ["k"], ["v"], tolerance=1e-14)["passed"]
    assert not compare_tables(a, b.where("k = 1"), ["k"], ["v"])["keys_match"]
    with pytest.raises(ValueError):
        compare_tables(a.union(a), b, ["k"], ["v"])


def test_documents_are_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/deep/folder/é manifest.json"
    writers.write_manifest({"a": 1}, path)
    writers.write_manifest({"a": "ä", "b": [1, 2]}, path)
    assert writers.read_manifest(path) == {"a": "ä", "b": [1, 2]}
    names = [p.name for p in (tmp_path / "deep/folder").iterdir() if not p.name.endswith(".crc")]
    assert names == ["é manifest.json"]
    writers.write_lines(["one", "two"], f"{tmp_path}/lines.txt")
    assert writers.read_text(f"{tmp_path}/lines.txt") == "one\ntwo\n"


def test_many_to_one_names_the_repeated_key(spark):
    from strideframe.sources.schemas import many_to_one

    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v int")
    right = spark.createDataFrame([("a", "x", None), ("b", "y", 5), ("d", "z", 6)], "k string, w string, u int")
    assert sorted(tuple(r) for r in many_to_one(left, right, ["k"], "audit").collect() if r.w) == [("a", 1, "x", None), ("a", 2, "x", None), ("b", 3, "y", 5)]
    assert many_to_one(left, right, ["k"], "audit").count() == 4
    with pytest.raises(Exception, match="audit has more than one row for a"):
        many_to_one(left, right.union(right.where("k = 'a'")), ["k"], "audit").collect()


def test_rank_by_range_of_mixed_ids(spark):
    from strideframe.functions.text import natural_order
    from strideframe.operators.blocks import ranked_by_range

    ids = [str(i * 7 % 101) for i in range(60)] + [f"take {i}" for i in range(60)] + ["é", "Z"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], "v string, n long").repartition(7)
    rows = {r.v: (r.rank, r.before) for r in ranked_by_range(df, natural_order("v"), {"before": F.col("n")}).collect()}
    ordered = sorted(ids, key=lambda v: (not v.isdigit(), int(v) if v.isdigit() else 0, v.encode()))
    total = 0
    for at, v in enumerate(ordered):
        assert rows[v] == (at, total)
        total += ids.index(v)
