"""Cycle-balanced wrist-use regions: eligibility, bandwidth, regions and grid export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BANDWIDTHS_SW, CELL_SIZE_SW, HANDS, MIN_PHASE_AVAILABILITY, MIN_VALID_SAMPLES, PHASES
from ..functions.text import key_video
from ..operators import density as D
from ..session import materialize
from ..sources.schemas import TableContract, assert_count, assert_rows, assert_unique, many_to_one

GROUPS = ["phase", "hand"]
X, Y = "x_from_needle_sw", "y_from_needle_sw"


def check_inputs(points: DataFrame, audit: DataFrame, expected_cycles: int | None = None) -> None:
    TableContract("wrist trajectory", ("cycle_key", "video_id", "work_cycle_id", *GROUPS, X, Y)).check(points)
    counts = [f"{p}_{c}" for p in PHASES for c in ("retained_frames", "left_valid_frames", "right_valid_frames")]
    TableContract("audit of cycles", ("cycle_key", *counts)).check(audit)
    assert_unique(audit, ["cycle_key"], "cycle audit")
    if expected_cycles is not None:
        assert_count(audit, expected_cycles, "audited cycles")
        assert_count(points.select("cycle_key").distinct(), expected_cycles, "trajectory cycles")
    finite = lambda c: F.abs(c) < float("inf")
    assert_rows(points, {
        "phase": F.col("phase").isNull() | F.col("phase").isin(*PHASES),
        "hand": F.col("hand").isNull() | F.col("hand").isin(*HANDS),
        "finite coordinates": finite(X) & finite(Y),
    })


def eligible_cycles(audit: DataFrame, *, min_samples: int = MIN_VALID_SAMPLES, min_availability: float = MIN_PHASE_AVAILABILITY) -> DataFrame:
    """Cycles with enough valid samples and availability for both wrists, per phase."""
    long = audit.select(
        "cycle_key",
        F.explode(F.array(*[
            F.struct(F.lit(p).alias("phase"), *[F.col(f"{p}_{c}").cast("double").alias(n) for c, n in (
                ("retained_frames", "kept"), ("left_valid_frames", "left"), ("right_valid_frames", "right"))])
            for p in PHASES
        ])).alias("_a"),
    ).select("cycle_key", "_a.*")
    assert_rows(long, {"retained frame counts are positive": F.col("kept") > 0})
    enough = F.lit(True)
    for side in ("left", "right"):
        enough = enough & (F.col(side) >= min_samples) & (F.col(side) / F.col("kept") >= min_availability)
    return long.where(enough).select("phase", "cycle_key")


def analyse(
    points: DataFrame, audit: DataFrame, expected_cycles: int | None = None, *, min_samples: int = MIN_VALID_SAMPLES,
    min_availability: float = MIN_PHASE_AVAILABILITY, empty_cells: bool = False,
) -> dict:
    """All outputs of the spatial analysis, keyed by table name, and its manifest.

    ``density_grid`` has a row per cell that holds mass; with ``empty_cells`` every cell of the grid.
    """
    check_inputs(points, audit, expected_cycles)
    data = points.where("phase IS NOT NULL AND hand IS NOT NULL").withColumn("_video", key_video(F.col("cycle_key")))
    eligible = eligible_cycles(audit, min_samples=min_samples, min_availability=min_availability)
    grid = D.make_grid(points, X, Y)
    everything = materialize(D.cycle_histograms(data, GROUPS, "_video", "cycle_key", X, Y, grid))
    primary = everything.join(eligible, ["phase", "cycle_key"], "left_semi")
    scores = materialize(D.leave_one_video_out(primary, GROUPS, "_video", "cycle_key", grid))
    D.check_scores(scores)
    ranked = D.rank_bandwidths(scores)
    bandwidth = D.selected_bandwidth(ranked)
    kept = data.join(eligible, ["phase", "cycle_key"], "left_semi")

    def regions(name: str, cells: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        mass = materialize(D.fitted_density(cells, GROUPS, "_video", "cycle_key", grid, bandwidth))
        counts = rows.groupBy(*GROUPS).agg(
            F.countDistinct("cycle_key").alias("contributing_cycles"), F.count("*").alias("valid_wrist_observations")
        )
        table = D.hdr_summary(mass, GROUPS, grid).join(counts, GROUPS).select(
            F.lit(name).alias("analysis_set"), *GROUPS, "coverage", "contributing_cycles", "valid_wrist_observations",
            "area_sw2", "achieved_probability_mass", "x_centroid_sw", "y_centroid_sw", "centroid_distance_from_needle_sw",
            "probability_mass_threshold", F.lit(CELL_SIZE_SW).alias("cell_size_sw"), F.lit(bandwidth).alias("isotropic_bandwidth_sw"),
        )
        return mass, table

    mass, summary = regions("primary_completeness_screened", primary, kept)
    _, sensitivity = regions("all_nonempty", everything, data)
    levels = D.hdr_thresholds(mass, GROUPS).groupBy(*GROUPS).agg(
        F.max(F.when(F.col("coverage") == 0.5, F.col("threshold"))).alias("_t50"),
        F.max(F.when(F.col("coverage") == 0.9, F.col("threshold"))).alias("_t90"),
    )
    exported = D.whole_grid(mass, GROUPS, grid) if empty_cells else mass
    export = exported.join(levels, GROUPS).select(
        *GROUPS, grid.x.centre(F.col("ix")).alias(X), grid.y.centre(F.col("iy")).alias(Y),
        F.col("mass").alias("probability_mass"),
        (F.col("mass") >= F.col("_t50")).alias("inside_50_percent_hdr"), (F.col("mass") >= F.col("_t90")).alias("inside_90_percent_hdr"),
    )
    assert_rows(export.groupBy(*GROUPS).agg(F.sum("probability_mass").alias("s")), {"grid sums to one": F.abs(F.col("s") - 1) <= 1e-6})
    assert_rows(summary, {"coverage attained": F.col("achieved_probability_mass") + 1e-8 >= F.col("coverage")})
    counts = {r["phase"]: r["count"] for r in eligible.groupBy("phase").count().collect()}
    return {
        "cross_validation": many_to_one(scores, ranked, ["bandwidth_sw"], "bandwidth ranking"),
        "bandwidth_selection": ranked,
        "eligibility": eligible.groupBy("phase").agg(F.count("*").alias("primary_bilateral_eligible_cycles")),
        "primary_hdr": summary, "sensitivity_hdr": sensitivity, "density_grid": export,
        "manifest": {
            "primary_eligible_cycles": {p: counts.get(p, 0) for p in PHASES},
            "cell_size_sw": CELL_SIZE_SW, "selected_shared_isotropic_bandwidth_sw": bandwidth,
            "bandwidth_candidates_sw": list(BANDWIDTHS_SW), "grid_shape": list(grid.shape),
            "grid_extent_sw": [*grid.x.extent, *grid.y.extent],
            "primary_rule": {"minimum_valid_samples_per_wrist": min_samples,
                             "minimum_phase_availability_per_wrist": min_availability, "bilateral": True},
        },
    }
