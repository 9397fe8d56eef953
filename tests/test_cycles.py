"""Boundary cases of the half-open cycle mapping."""

import pytest

from strideframe.plans import cycles


@pytest.fixture
def mapper(spark):
    table = spark.createDataFrame(
        [("1", 0, 10, 20.0, "first"), ("1.mp4", 10, 20, 20.0, "second")],
        "Video string, Start_Frame int, End_Frame int, FPS double, Cycle_ID string",
    )

    def run(centres, clusters=None):
        clusters = clusters or [1] * len(centres)
        rows = [("1_segments.csv", f"segment_{i + 1}", c - 0.5, c + 0.5, k)
                for i, (c, k) in enumerate(zip(centres, clusters))]
        seg = spark.createDataFrame(
            rows, "Video string, Segment_ID string, Start_Frame double, End_Frame double, Cluster int"
        )
        return cycles.map_segments(cycles.standard_segments(seg), cycles.standard_cycles(table))

    return run


def test_shared_boundary_goes_to_the_later_cycle(mapper):
    rows = mapper([10.0]).collect()
    assert [(r.Cycle_ID, r.Relative_Center_Percent) for r in rows] == [("second", 0.0)]


def test_start_included_end_excluded(mapper):
    rows = mapper([0.0, 10.0]).orderBy("Segment_ID").collect()
    assert [r.Cycle_ID for r in rows] == ["first", "second"]
    rows = mapper([19.5, 20.0]).collect()
    assert [(r.Segment_ID, r.Cycle_ID) for r in rows] == [("segment_1", "second")]


def test_counts_and_clusters_survive(mapper):
    mapped = mapper([0.5, 5.5, 9.5, 10.5, 15.5, 19.5], [1, 2, 1, 1, 3, 2])
    rows = mapped.collect()
    assert len(rows) == 6 and len({r.Segment_ID for r in rows}) == 6
    assert sorted(r.Cycle_ID for r in rows) == ["first"] * 3 + ["second"] * 3
    wide = cycles.composition_wide(cycles.cycle_composition(mapped), [1, 2, 3])
    by_cycle = {r.Cycle_ID: r for r in wide.collect()}
    assert by_cycle["first"].Cluster_3_Percent == 0.0
    assert by_cycle["first"].Cluster_1_Percent == pytest.approx(200 / 3)
    assert by_cycle["second"].Cycle_Number_In_Video == 2


def test_global_index_skips_empty_cycles_and_sorts_videos_naturally(spark):
    table = spark.createDataFrame(
        [("10", 0, 10, 20.0), ("2", 0, 10, 20.0), ("2", 10, 20, 20.0), ("x", 0, 10, 20.0)],
        "Video string, Start_Frame int, End_Frame int, FPS double",
    )
    seg = spark.createDataFrame(
        [("10", 1, 2, 1), ("2", 11, 12, 1), ("x", 3, 4, 2)],
        "Video string, Start_Frame int, End_Frame int, Cluster int",
    )
    mapped = cycles.map_segments(cycles.standard_segments(seg), cycles.standard_cycles(table))
    rows = cycles.number_filled_cycles(mapped).collect()
    got = {(r.Video_ID, r.Cycle_Number_In_Video, r.Cycle_ID): r.Cycle_Index_Global for r in rows}
    assert got == {("2", 2, "Cycle 2"): 1, ("10", 1, "Cycle 1"): 2, ("x", 1, "Cycle 1"): 3}


def test_exactly_hundred_percent_has_no_bin(spark):
    from pyspark.sql import functions as F

    from strideframe.functions.scalars import timeline_bin

    df = spark.createDataFrame([(0.0,), (4.999,), (5.0,), (99.99,), (100.0,), (None,)], "p double")
    assert [r[0] for r in df.select(timeline_bin(F.col("p"))).collect()] == [0, 0, 1, 19, None, None]
