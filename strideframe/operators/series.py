"""Sequence operators on ``(keys..., pos, value columns)`` with dense ``pos``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..constants import MAX_INTERPOLATION_FRAMES
from .blocks import BLOCK_ROWS, Carry, carry, halo_window, own_rows, with_halo

# Rows on either side that the smoothing chain can see: gradient 1 + quadratic
# fit 6 + median 2, and one more to notice a missing neighbour.
SMOOTH_REACH = 10


def _at(c: Column, k: int, w: WindowSpec) -> Column:
    """Value ``k`` rows after (before, if negative) the current row."""
    return c if k == 0 else (F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w))


def _mid(values: Column) -> Column:
    """Median of a short array of non-null numbers (NULL when empty)."""
    n = F.size(values)
    upper = F.try_element_at(values, F.floor(n / 2).cast("int") + 1)
    lower = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    return F.when(n > 0, (lower + upper) / 2)


def first_difference(
    df: DataFrame, keys: Sequence[str], column: str, scale: Column, out: str, *, rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(x - previous x) * scale``; NULL on the first row."""
    w = halo_window(keys)
    wide = with_halo(df, 1, ahead=0, rows=rows)
    x = F.col(column)
    return own_rows(wide.withColumn(out, (x - F.lag(x).over(w)) * scale))


def gradient_column(x: Column, w: WindowSpec) -> Column:
    """Central difference, one-sided next to a missing neighbour, NULL for lone rows."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return (
        F.when(x.isNull(), x)
        .when(before.isNotNull() & after.isNotNull(), (after - before) / 2)
        .when(after.isNotNull(), after - x)
        .when(before.isNotNull(), x - before)
    )


def central_gradient(
    df: DataFrame, keys: Sequence[str], column: str, scale: Column, out: str, *, rows: int = BLOCK_ROWS
) -> DataFrame:
    wide = with_halo(df, 1, rows=rows)
    return own_rows(wide.withColumn(out, gradient_column(F.col(column), halo_window(keys)) * scale))


def rolling_median(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], before: int, after: int,
    *, min_valid: int = 1, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Centred rolling median over ``[-before, +after]`` rows, missing values skipped."""
    w = halo_window(keys)
    wide = with_halo(df, before, ahead=after, rows=rows)
    arrays, result = {}, {}
    for name, column in columns.items():
        near = [_at(F.col(column), k, w) for k in range(-before, after + 1)]
        arrays[f"_a_{name}"] = F.sort_array(F.array_compact(F.array(*near)))
        result[name] = F.when(F.size(f"_a_{name}") >= min_valid, _mid(F.col(f"_a_{name}")))
    return own_rows(wide.withColumns(arrays).withColumns(result).drop(*arrays))


# Least-squares weights of the seven-point quadratic smoother.
# Row r gives the fitted value at point r of seven; row 3 is the interior filter.
QUADRATIC_7 = (
    ((32, 15, 3, -4, -6, -3, 5), 42),
    ((5, 4, 3, 2, 1, 0, -1), 14),
    ((1, 3, 4, 4, 3, 1, -2), 14),
    ((-2, 3, 6, 7, 6, 3, -2), 21),
    ((-2, 1, 3, 4, 4, 3, 1), 14),
    ((-1, 0, 1, 2, 3, 4, 5), 14),
    ((5, -3, -6, -4, 3, 15, 32), 42),
)


def _neighbours(df: DataFrame, column: str, w: WindowSpec) -> tuple[DataFrame, dict[int, Column]]:
    """The six values on either side as columns, computed once and used many times."""
    made = {k: f"_n{k + 6}" for k in range(-6, 7) if k}
    df = df.withColumns({name: _at(F.col(column), k, w) for k, name in made.items()})
    return df, {0: F.col(column), **{k: F.col(name) for k, name in made.items()}}


def _run_neighbours(df: DataFrame, near: dict[int, Column]) -> DataFrame:
    """How many unbroken valid rows lie before / after the row, counted up to six."""
    cols = {}
    for side, sign in (("_before", -1), ("_after", 1)):
        broken = F.when(near[sign].isNull(), 0)
        for k in range(2, 7):
            broken = broken.when(near[sign * k].isNull(), k - 1)
        cols[side] = broken.otherwise(6)
    return df.withColumns(cols)


def _quadratic(near: dict[int, Column]) -> Column:
    """Seven-point quadratic smoothing inside a run, given ``_before`` and ``_after``."""
    b, a = F.col("_before"), F.col("_after")

    def fit(place: int) -> Column:
        weights, scale = QUADRATIC_7[place]
        terms = [near[k - place] * float(c) for k, c in enumerate(weights) if c]
        return sum(terms[1:], terms[0]) / float(scale)

    out = F.when(near[0].isNull() | (b + a + 1 < 7), near[0])
    for place in (0, 1, 2):
        out = out.when(b == place, fit(place))
    for place in (6, 5, 4):
        out = out.when(a == 6 - place, fit(place))
    return out.otherwise(fit(3))


_SCRATCH = tuple(f"_n{k + 6}" for k in range(-6, 7) if k)


def quadratic_smooth(
    df: DataFrame, keys: Sequence[str], column: str, out: str, *, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Seven-point quadratic smoother per unbroken run; runs under seven rows pass through."""
    w = halo_window(keys)
    wide, near = _neighbours(with_halo(df, 7, rows=rows), column, w)
    wide = _run_neighbours(wide, near).withColumn(out, _quadratic(near))
    return own_rows(wide.drop("_before", "_after", *_SCRATCH))


def smooth_runs(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], *,
    velocity: dict[str, str] | None = None, scale: Column | None = None, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Median of five, then quadratic smoothing, then velocity, per unbroken run.

    One halo copy and one sort serve the whole chain. ``columns`` maps result to
    input; ``velocity`` maps a velocity column to the smoothed column it derives from.
    """
    w = halo_window(keys)
    wide = with_halo(df, SMOOTH_REACH, rows=rows)
    for name, column in columns.items():
        wide, near = _neighbours(wide, column, w)
        wide = _run_neighbours(wide, near)
        window = [
            F.when(F.col("_before") >= 2, near[-2]), F.when(F.col("_before") >= 1, near[-1]), near[0],
            F.when(F.col("_after") >= 1, near[1]), F.when(F.col("_after") >= 2, near[2]),
        ]
        wide = wide.withColumn("_near", F.sort_array(F.array_compact(F.array(*window))))
        wide = wide.withColumn("_median", F.when(near[0].isNotNull(), _mid(F.col("_near")))).drop(*_SCRATCH)
        wide, near = _neighbours(wide, "_median", w)
        wide = wide.withColumn(name, _quadratic(near)).drop("_before", "_after", "_near", "_median", *_SCRATCH)
    for name, column in (velocity or {}).items():
        wide = wide.withColumn(name, gradient_column(F.col(column), w) * scale)
    return own_rows(wide)


def interpolate(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], *, mode: str = "both",
    limit: int = MAX_INTERPOLATION_FRAMES, pos: str = "pos", rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Linear interpolation by row position.

    ``both``    interior gaps linear, ends take the nearest valid value
    ``zero``    as ``both``, and an all-missing series becomes 0
    ``inside``  only the first ``limit`` rows of an interior gap
    """
    specs = {}
    for name, column in columns.items():
        point = F.when(F.col(column).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(column).alias("v")))
        specs[f"_p_{name}"] = Carry("last", point)
        specs[f"_n_{name}"] = Carry("next", point)
    out = carry(df, keys, pos, specs, F.expr(f"{pos} div {rows}"))
    filled = {
        name: linear_fill(F.col(column), F.col(f"_p_{name}"), F.col(f"_n_{name}"), F.col(pos), mode, limit)
        for name, column in columns.items()
    }
    return out.withColumns(filled).drop(*specs)


def linear_fill(x: Column, prev: Column, nxt: Column, pos: Column, mode: str, limit: int) -> Column:
    """Interpolated value from the nearest valid points ``(p, v)`` on either side."""
    slope = (nxt["v"] - prev["v"]) / (nxt["p"] - prev["p"])
    line = slope * (pos - prev["p"]) + prev["v"]
    interior = prev.isNotNull() & nxt.isNotNull()
    if mode == "inside":
        return F.when(x.isNotNull(), x).when(interior & (pos - prev["p"] <= limit), line)
    filled = F.when(x.isNotNull(), x).when(interior, line).otherwise(F.coalesce(prev["v"], nxt["v"]))
    return F.coalesce(filled, F.lit(0.0)) if mode == "zero" else filled


def closed_mask(
    df: DataFrame, keys: Sequence[str], mask: Column, gap: Column, max_gap: int, out: str,
    *, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """TRUE also for interior FALSE runs of at most ``gap`` rows (``gap <= max_gap``)."""
    w = halo_window(keys)
    wide = with_halo(df.withColumn("_m", F.coalesce(mask, F.lit(False))), max_gap + 1, rows=rows)
    here = F.when(F.col("_m"), F.col("pos"))
    before = F.last(here, True).over(w.rowsBetween(-(max_gap + 1), 0))
    after = F.first(here, True).over(w.rowsBetween(0, max_gap + 1))
    short = F.coalesce(after - before - 1 <= gap, F.lit(False))
    return own_rows(wide.withColumn(out, F.col("_m") | short).drop("_m"))


def true_runs(
    df: DataFrame, keys: Sequence[str], mask: Column, *, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Maximal TRUE runs: inclusive ``start``, ``end`` positions and ``length``."""
    keys = list(keys)
    marked = df.select(*keys, "pos", F.coalesce(mask, F.lit(False)).alias("_m"))
    seen = carry(
        marked, keys, "pos", {"_seen": Carry("sum", F.col("_m").cast("bigint"))}, F.expr(f"pos div {rows}")
    )
    return (
        seen.where("_m")
        .groupBy(*keys, (F.col("pos") - F.col("_seen")).alias("_run"))
        .agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("length"))
        .drop("_run")
    )


def local_peaks(
    df: DataFrame, keys: Sequence[str], value: str, out: str, *, rows: int = BLOCK_ROWS
) -> DataFrame:
    """Flag rows at least as high as both neighbours; end rows are never peaks."""
    w = halo_window(keys)
    v = F.col(value)
    higher = (v >= F.lag(v).over(w)) & (v >= F.lead(v).over(w))
    return own_rows(with_halo(df, 1, rows=rows).withColumn(out, F.coalesce(higher, F.lit(False))))

