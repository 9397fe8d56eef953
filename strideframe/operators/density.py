"""Cycle-balanced two-dimensional density estimation.

Points become sparse cells before anything is shuffled. Smoothing is separable and
linear, so cycles are normalised in closed form, summed per video, and smoothed once
per video. The kernel ends after eight standard deviations, so the plane is cut into
tiles: a tile sees its own cells and those within the kernel's reach, empty tiles do
not exist, and cost follows the occupied cells whatever the extent of the points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BANDWIDTHS_SW, CELL_SIZE_SW, COVERAGES, GRID_MARGIN_SW, HANDS, KERNEL_TRUNCATE, PHASES, SCORE_FLOOR
from ..session import materialize, spread
from ..sources.schemas import assert_rows
from .selection import LEAF_ROWS, smallest_reaching

# Videos whose cells are subtracted one by one in a tile: they share the tile's totals.
CHUNK_VIDEOS = 256
# Share of the total that others must hold, so that a difference keeps ten digits.
LEAST_SHARE = 1e-5
# Cells of a video that is not cut into tiles, rows of a chunk of videos, pairs of cells at once, and broadcast values.
WHOLE_CELLS, CHUNK_ROWS, PAIRS, SENT_VALUES = 256, 1 << 15, 1 << 17, 1 << 22


@dataclass(frozen=True)
class Axis:
    """Cell edges of one axis by rule: ``count`` fixed ones from ``first`` on, and ``pad`` more on either side.

    Padding extends the fixed edges and never rebuilds them, so a point on an edge
    keeps its cell whatever the bandwidth range. No edge table exists, so the axis may
    be of any length.
    """

    first: float
    count: int
    pad: int

    @property
    def step(self) -> float:
        return (self.first + CELL_SIZE_SW) - self.first

    @property
    def cells(self) -> int:
        return self.count - 1 + 2 * self.pad

    def edge(self, i: Column) -> Column:
        inner = i - self.pad
        last = self.first + (self.count - 1) * self.step
        return (
            F.when(inner < 0, F.lit(self.first) + inner * CELL_SIZE_SW)
            .when(inner >= self.count, F.lit(last) + (inner - (self.count - 1)) * CELL_SIZE_SW)
            .otherwise(F.lit(self.first) + inner * self.step)
        )

    def centre(self, i: Column) -> Column:
        return (self.edge(i) + self.edge(i + 1)) / 2

    def edges(self) -> np.ndarray:
        inner = self.first + np.arange(self.count) * self.step
        outward = CELL_SIZE_SW * np.arange(1, self.pad + 1)
        return np.concatenate([inner[0] - outward[::-1], inner, inner[-1] + outward])

    @property
    def extent(self) -> tuple[float, float]:
        return self.first - CELL_SIZE_SW * self.pad, self.first + (self.count - 1) * self.step + CELL_SIZE_SW * self.pad


@dataclass(frozen=True)
class Grid:
    x: Axis
    y: Axis

    @property
    def shape(self) -> tuple[int, int]:
        return self.x.cells, self.y.cells

    @cached_property
    def x_edges(self) -> np.ndarray:
        return self.x.edges()

    @cached_property
    def y_edges(self) -> np.ndarray:
        return self.y.edges()

    @property
    def centres(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple((e[:-1] + e[1:]) / 2 for e in (self.x_edges, self.y_edges))


def _axis(low: float, high: float, widest: float) -> Axis:
    """The fixed margin around the points, then whole-cell padding for wider bandwidths."""
    cell = CELL_SIZE_SW
    first = float(np.floor((low - GRID_MARGIN_SW) / cell) * cell)
    last = float(np.ceil((high + GRID_MARGIN_SW) / cell) * cell)
    return Axis(first, int(np.ceil((last + cell / 2 - first) / cell)), int(np.ceil(max(0.0, 4 * widest - GRID_MARGIN_SW) / cell)))


def make_grid(df: DataFrame, x: str, y: str, bandwidths: Sequence[float] = BANDWIDTHS_SW) -> Grid:
    """Grid covering all points; one aggregation brings four numbers to the driver."""
    x0, x1, y0, y1 = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if x0 is None or y0 is None:
        raise ValueError("a grid needs at least one point")
    return Grid(_axis(x0, x1, max(bandwidths)), _axis(y0, y1, max(bandwidths)))


def cell_index(c: Column, axis: Axis) -> Column:
    """Bin by comparison with the edges themselves; the last bin is closed."""
    n = axis.cells
    near = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((c - axis.first) / axis.step) + axis.pad)).cast("bigint")
    return near + F.when(c < axis.edge(near), -1).when((c >= axis.edge(near + 1)) & (near < n - 1), 1).otherwise(0)


def cycle_histograms(
    points: DataFrame, groups: Sequence[str], video: str, cycle: str, x: str, y: str, grid: Grid
) -> DataFrame:
    """Unit-mass cells ``(groups, video, cycle, ix, iy, w)``."""
    keys = [*groups, video, cycle]
    counted = (
        points.select(*keys, cell_index(F.col(x), grid.x).alias("ix"), cell_index(F.col(y), grid.y).alias("iy"))
        .groupBy(*keys, "ix", "iy").agg(F.count("*").alias("_n"))
    )
    # One row per cell that the cycle visits in each window partition.
    total = F.sum("_n").over(Window.partitionBy(*keys))
    return counted.withColumn("w", F.col("_n") / total).drop("_n")


def kernel(bandwidth: float) -> np.ndarray:
    """Normalised Gaussian weights by cell distance, cut at eight standard deviations."""
    sigma = bandwidth / CELL_SIZE_SW
    reach = int(KERNEL_TRUNCATE * sigma + 0.5)
    d = np.arange(-reach, reach + 1)
    k = np.exp(-0.5 * (d / sigma) ** 2)
    return (k / k.sum())[reach:]


def reach(bandwidths: Sequence[float]) -> int:
    """Cells that the widest kernel extends to either side."""
    return max(len(kernel(b)) for b in bandwidths) - 1


def kernel_between(bandwidth: float, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Kernel weights between the cells ``rows`` and ``columns`` of an axis."""
    half = kernel(bandwidth)
    distance = np.abs(np.asarray(rows)[:, None] - np.asarray(columns)[None, :])
    return np.where(distance < len(half), half[np.minimum(distance, len(half) - 1)], 0.0)


def _with_axis_mass(cells: DataFrame, name: str, n: int, bandwidths: Sequence[float]) -> DataFrame:
    """``cells`` with the in-grid kernel mass ``_m{name}`` of their place on one axis, an array over bandwidths.

    The mass is what the kernel holds on either side up to the border. Places further from both borders than the kernel's
    reach are alike, so the broadcast table has one row per place near a border, whatever the grid.
    """
    far = reach(bandwidths)
    near = n <= 2 * far + 1
    places = np.arange(n) if near else np.r_[0 : far + 1, n - far : n]
    halves = [np.cumsum(kernel(b)) for b in bandwidths]
    held = [h[np.minimum(places, len(h) - 1)] + h[np.minimum(n - 1 - places, len(h) - 1)] - kernel(b)[0] for h, b in zip(halves, bandwidths)]
    rows = [(i, [float(v) for v in masses]) for i, masses in enumerate(np.stack(held, axis=1))]
    place = F.col(name) if near else F.least(F.col(name), F.lit(far)) + F.greatest(F.lit(0), F.col(name) - (n - 1 - far))
    table = F.broadcast(cells.sparkSession.createDataFrame(rows, f"_d bigint, _m{name} array<double>"))
    return cells.withColumn("_d", place.cast("bigint")).join(table, "_d").drop("_d")


def _masses(cells: DataFrame, grid: Grid, bandwidths: Sequence[float]) -> DataFrame:
    nx, ny = grid.shape
    return _with_axis_mass(_with_axis_mass(cells, "ix", nx, bandwidths), "iy", ny, bandwidths)


def normalised_cells(cells: DataFrame, groups: Sequence[str], video: str, cycle: str, grid: Grid, bandwidths: Sequence[float]) -> DataFrame:
    """Per video and cell: sum over cycles of weight / in-grid smoothed mass, one column per bandwidth."""
    keys = [*groups, video, cycle]
    masses = [F.sum(F.col("w") * F.col("_mix")[b] * F.col("_miy")[b]).alias(f"_t{b}") for b in range(len(bandwidths))]
    totals = _masses(cells, grid, bandwidths).groupBy(*keys).agg(*masses)
    return cells.join(totals, keys).groupBy(*groups, video, "ix", "iy").agg(
        *[F.sum(F.col("w") / F.col(f"_t{b}")).alias(f"a{b}") for b in range(len(bandwidths))]
    )


def on_tiles(cells: DataFrame, size: int, margin: int) -> DataFrame:
    """Each cell once per tile ``tx, ty`` that it lies in or within ``margin`` cells of; ``inside`` marks its own tile."""
    for axis, tile in (("ix", "tx"), ("iy", "ty")):
        low, high = (F.floor((F.col(axis) + by) / F.lit(size)).cast("bigint") for by in (-margin, margin))
        cells = cells.withColumn(tile, F.explode(F.sequence(low, high)))
    own = [F.floor(F.col(axis) / F.lit(size)) == F.col(tile) for axis, tile in (("ix", "tx"), ("iy", "ty"))]
    return cells.withColumn("inside", own[0] & own[1])


def _smooth_inside(ix: np.ndarray, iy: np.ndarray, inside: np.ndarray, values: np.ndarray, bandwidths: Sequence[float]) -> np.ndarray:
    """Smoothed ``values`` (a column per bandwidth) at the cells ``inside``, by one separable product per bandwidth."""
    xs, x_at = np.unique(ix, return_inverse=True)
    ys, y_at = np.unique(iy, return_inverse=True)
    rows, row_of = np.unique(ix[inside], return_inverse=True)
    columns, column_of = np.unique(iy[inside], return_inverse=True)
    out, layer = np.empty((int(inside.sum()), len(bandwidths))), np.zeros((len(xs), len(ys)))
    for b, bandwidth in enumerate(bandwidths):
        layer[x_at, y_at] = values[:, b]
        out[:, b] = (kernel_between(bandwidth, rows, xs) @ layer @ kernel_between(bandwidth, columns, ys).T)[row_of, column_of]
    return out


def _smooth_each(code: np.ndarray, ix: np.ndarray, iy: np.ndarray, inside: np.ndarray, values: np.ndarray, bandwidths: Sequence[float]) -> np.ndarray:
    """As ``_smooth_inside`` for many videos at once, each by itself: rows are sorted by ``code``.

    Videos of few cells go by pairs of their cells, ``PAIRS`` at a time; the others by products.
    """
    far = reach(bandwidths)
    weights = np.zeros((len(bandwidths), far + 2))
    for b, bandwidth in enumerate(bandwidths):
        weights[b, : len(kernel(bandwidth))] = kernel(bandwidth)
    starts = np.searchsorted(code, np.arange(code[-1] + 2))
    sizes = np.diff(starts)
    out = np.empty((len(code), len(bandwidths)))
    heavy = sizes * np.add.reduceat(inside.astype(int), starts[:-1]) > PAIRS
    for v in np.flatnonzero(heavy):
        own = slice(starts[v], starts[v + 1])
        out[own][inside[own]] = _smooth_inside(ix[own], iy[own], inside[own], values[own], bandwidths)
    targets = np.flatnonzero(inside & ~heavy[code])
    pairs = np.cumsum(sizes[code[targets]])
    for part in np.split(targets, np.flatnonzero(np.diff(pairs // PAIRS)) + 1):
        if len(part):
            n = sizes[code[part]]
            at = np.cumsum(n) - n
            source = np.arange(n.sum()) + np.repeat(starts[code[part]] - at, n)
            dx, dy = (np.minimum(np.abs(np.repeat(c[part], n) - c[source]), far + 1) for c in (ix, iy))
            for b, w in enumerate(weights):
                out[part, b] = np.add.reduceat(w[dx] * w[dy] * values[source, b], at)
    return out[inside]


def _exactly_held_out(
    held: DataFrame, wanted: DataFrame, total: DataFrame, groups: Sequence[str], video: str, bandwidths: Sequence[float], size: int, margin: int, chunk_videos: int,
) -> DataFrame:
    """``(groups, video, ix, iy, logd)`` of the ``wanted`` cells, with the video's own cells subtracted before smoothing.

    A cell that only this video visits is exactly empty. A task holds one tile with its margin and a chunk of the videos
    that have wanted cells there.
    """
    count = len(bandwidths)
    names = [f"a{b}" for b in range(count)]
    total_names = [f"t{a}" for a in names]
    place = [*groups, "tx", "ty"]
    visitors = wanted.groupBy(*groups, video).agg(F.lit(True).alias("_any"))
    chunks = visitors.groupBy(*groups).agg(F.ceil(F.count("*") / F.lit(chunk_videos)).alias("_chunks"))
    asked = wanted.select(*groups, video, "ix", "iy", F.lit(True).alias("_wanted"))
    mine = held.join(visitors, [*groups, video], "left_semi").join(asked, [*groups, video, "ix", "iy"], "left").join(chunks, groups)
    mine = on_tiles(mine.withColumn("chunk", F.pmod(F.hash(video), F.col("_chunks"))), size, margin)
    mine = mine.withColumn("inside", F.col("inside") & F.coalesce("_wanted", F.lit(False))).drop("_wanted", "_chunks")
    homes = mine.where("inside").select(*place, video, "chunk").distinct()
    own = mine.join(homes.drop("chunk"), [*place, video], "left_semi")
    around = on_tiles(total, size, margin).drop("inside").join(homes.select(*place, "chunk").distinct(), place)
    around = around.toDF(*around.columns)  # fresh column identities for the cogroup
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.select(*groups, video).schema)
    columns = [*groups, video, "ix", "iy", "logd"]

    def evaluate(mine: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if not mine.inside.any():
            return pd.DataFrame(columns=columns)
        xs, x_at = np.unique(totals.ix, return_inverse=True)
        ys, y_at = np.unique(totals.iy, return_inverse=True)
        stack, videos = np.zeros((count, len(xs), len(ys))), np.zeros((len(xs), len(ys)), int)
        stack[:, x_at, y_at] = totals[total_names].to_numpy().T
        videos[x_at, y_at] = totals["_videos"]
        here = mine[mine.inside]
        rows, columns_of = np.unique(here.ix), np.unique(here.iy)
        visits = []
        for _, near in mine.groupby(video, sort=False):
            own = near[near.inside]
            if len(own):
                at = np.searchsorted(xs, near.ix), np.searchsorted(ys, near.iy)
                used, place_of = np.unique(np.searchsorted(rows, own.ix), return_inverse=True)
                visits.append((near, own, at, videos[at] > 1, used, place_of, np.searchsorted(columns_of, own.iy), np.empty((len(own), count))))
        for b, bandwidth in enumerate(bandwidths):
            layer, over_x, over_y = stack[b], kernel_between(bandwidth, rows, xs), kernel_between(bandwidth, columns_of, ys)
            for near, own, at, shared, used, place_of, iy, logs in visits:
                kept = layer[at]
                layer[at] = np.where(shared, np.maximum(kept - near[names[b]].to_numpy(), 0.0), 0.0)
                density = np.einsum("ij,ij->i", (over_x[used] @ layer)[place_of], over_y[iy])
                layer[at] = kept
                logs[:, b] = np.log(np.maximum(density / own["_rest"].iloc[0], SCORE_FLOOR))
        out = pd.concat([own[[*groups, video, "ix", "iy"]] for _, own, *_ in visits])
        out["logd"] = [row for *_, logs in visits for row in logs]
        return out

    grouped = [spread(side, *place, "chunk").groupBy(*place, "chunk") for side in (own, around)]
    return grouped[0].cogroup(grouped[1]).applyInPandas(evaluate, f"{fields}, ix bigint, iy bigint, logd array<double>")


def leave_one_video_out(
    cells: DataFrame, groups: Sequence[str], video: str, cycle: str, grid: Grid,
    bandwidths: Sequence[float] = BANDWIDTHS_SW, *, chunk_videos: int = CHUNK_VIDEOS,
) -> DataFrame:
    """Held-out log scores: ``(groups, bandwidth_sw, contributing_cycles, mean, sd)``.

    The others' density at a video's own cells is the smoothed total, one value per visited cell, less the video's own
    smoothed cells: no video needs the totals around it. Where the others hold less than ``LEAST_SHARE`` of the total at
    some bandwidth, the difference would lose digits; at those cells the own cells are subtracted before smoothing.
    """
    groups = list(groups)
    count = len(bandwidths)
    names = [f"a{b}" for b in range(count)]
    total_names = [f"t{a}" for a in names]
    cells = materialize(cells)
    per_video = materialize(normalised_cells(cells, groups, video, cycle, grid, bandwidths).where("ix IS NOT NULL AND iy IS NOT NULL"))
    total = materialize(per_video.groupBy(*groups, "ix", "iy").agg(*[F.sum(a).alias(f"t{a}") for a in names], F.count("*").alias("_videos")))
    cycles = cells.select(*groups, video, cycle).distinct().groupBy(*groups, video).agg(F.count("*").alias("_own"))
    everyone = cycles.groupBy(*groups).agg(F.sum("_own").alias("_all"))
    assert_rows(everyone.join(cycles, groups), {"a video has others in its group to score it by": F.col("_all") > F.col("_own")})
    sizes = per_video.groupBy(*groups, video).agg(F.count("*").alias("_cells"))
    parts = sizes.groupBy(*groups).agg(F.ceil(F.sum("_cells") / F.lit(CHUNK_ROWS)).alias("_parts"))
    known = cycles.join(sizes, [*groups, video]).join(everyone, groups).join(parts, groups)
    held = per_video.join(known.select(*groups, video, (F.col("_all") - F.col("_own")).alias("_rest"), "_cells", F.pmod(F.hash(video), F.col("_parts")).alias("part")), [*groups, video])

    margin = reach(bandwidths)
    size = 2 * max(margin, 16)
    place = [*groups, "tx", "ty"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in per_video.select(*groups, video).schema)

    def smooth_total(pdf: pd.DataFrame) -> pd.DataFrame:
        inside = pdf.inside.to_numpy()
        out = pdf[inside][[*groups, "ix", "iy"]]
        return out.assign(density=list(_smooth_inside(pdf.ix.to_numpy(), pdf.iy.to_numpy(), inside, pdf[total_names].to_numpy(), bandwidths)) if inside.any() else None)

    def smooth_own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_code=pd.factorize(pdf[video])[0]).sort_values("_code")
        inside = pdf.inside.to_numpy()
        out = pdf[inside][[*groups, video, "ix", "iy", "_rest"]]
        return out.assign(own=list(_smooth_each(pdf["_code"].to_numpy(), pdf.ix.to_numpy(), pdf.iy.to_numpy(), inside, pdf[names].to_numpy(), bandwidths)) if inside.any() else None)

    field_groups = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in per_video.select(*groups).schema)
    densities = materialize(
        spread(on_tiles(total, size, margin), *place).groupBy(*place).applyInPandas(smooth_total, ", ".join(filter(None, [field_groups, "ix bigint, iy bigint, density array<double>"])))
    )
    # A video of few cells stays whole; a larger one is cut into tiles like the totals.
    whole = held.where(F.col("_cells") <= WHOLE_CELLS).withColumns({"tx": F.lit(None).cast("bigint"), "ty": F.lit(None).cast("bigint"), "inside": F.lit(True)})
    cut = whole.unionByName(on_tiles(held.where(F.col("_cells") > WHOLE_CELLS), size, margin)).drop("_cells")
    own = spread(cut, *place, "part", rows=per_video.count()).groupBy(*place, "part").applyInPandas(smooth_own, f"{fields}, ix bigint, iy bigint, _rest bigint, own array<double>")
    n_densities = densities.count()
    both = own.join(F.broadcast(densities) if n_densities * count <= SENT_VALUES else densities, [*groups, "ix", "iy"])
    clear = F.forall(F.zip_with("density", "own", lambda t, o: t - o > LEAST_SHARE * t), lambda ok: ok)
    logd = F.zip_with("density", "own", lambda t, o: F.ln(F.greatest((t - o) / F.col("_rest"), F.lit(SCORE_FLOOR))))
    seen = materialize(both.select(*groups, video, "ix", "iy", F.when(clear, logd).alias("logd")))
    unclear = seen.where("logd IS NULL").drop("logd")
    logs = seen.where("logd IS NOT NULL")
    if not unclear.isEmpty():
        logs = logs.unionByName(_exactly_held_out(held.drop("_cells", "part"), unclear, total, groups, video, bandwidths, size, margin, chunk_videos))

    scored = cells.join(logs, [*groups, video, "ix", "iy"]).groupBy(*groups, video, cycle).agg(
        *[F.sum(F.col("w") * F.col("logd")[b]).alias(f"s{b}") for b in range(count)]
    )
    pairs = [F.struct(F.avg(f"s{b}").alias("mean"), F.stddev_samp(f"s{b}").alias("sd"), F.lit(float(w)).alias("bw")) for b, w in enumerate(bandwidths)]
    out = scored.groupBy(*groups).agg(F.count("*").alias("contributing_cycles"), F.array(*pairs).alias("_s"))
    return out.select(*groups, "contributing_cycles", F.explode("_s").alias("_e")).select(
        *groups, F.col("_e.bw").alias("bandwidth_sw"), "contributing_cycles",
        F.col("_e.mean").alias("mean_heldout_cycle_log_score"), F.col("_e.sd").alias("sd_heldout_cycle_log_score"),
    )


def check_scores(scores: DataFrame, bandwidths: Sequence[float] = BANDWIDTHS_SW) -> None:
    """Every declared bandwidth has one finite score from each phase-hand group."""
    group = F.concat_ws("/", "phase", "hand")
    expected = sorted(f"{p}/{h}" for p in PHASES for h in HANDS)
    per = scores.groupBy("bandwidth_sw").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set(group)).alias("g"),
        F.bool_and(F.abs("mean_heldout_cycle_log_score") < float("inf")).alias("finite"),
    )
    assert_rows(per, {
        "one score per group": (F.col("n") == len(expected)) & (F.col("g") == F.array(*[F.lit(e) for e in expected])),
        "finite scores": F.col("finite"),
    })
    found = {r[0] for r in per.select("bandwidth_sw").collect()}
    if found != set(bandwidths):
        raise ValueError(f"no score for bandwidths {sorted(set(bandwidths) - found)}, or some for unknown {sorted(found - set(bandwidths))}")


def rank_bandwidths(scores: DataFrame) -> DataFrame:
    """Mean over groups with equal weight, rank, and the selected bandwidth (smallest exact tie).

    One row per bandwidth candidate, so the unpartitioned window is a few rows.
    """
    ordered = scores.groupBy("bandwidth_sw").agg(
        F.array_sort(F.collect_list(F.struct("phase", "hand", F.col("mean_heldout_cycle_log_score").alias("s")))).alias("_g")
    )
    # Summed in a fixed order, so equal scores give equal means and exact ties stay exact.
    mean = F.aggregate("_g", F.lit(0.0), lambda a, e: a + e["s"]) / F.size("_g")
    means = ordered.select("bandwidth_sw", mean.alias("equal_group_mean_loo_log_score"))
    every = Window.partitionBy(F.lit(0))
    score = F.col("equal_group_mean_loo_log_score")
    best = F.max_by("bandwidth_sw", F.struct(score, -F.col("bandwidth_sw"))).over(every)
    return means.select(
        "bandwidth_sw", "equal_group_mean_loo_log_score",
        F.rank().over(every.orderBy(F.desc("equal_group_mean_loo_log_score"))).cast("bigint").alias("score_rank"),
        (F.col("bandwidth_sw") == best).alias("selected_shared_bandwidth"),
    )


def selected_bandwidth(ranked: DataFrame) -> float:
    return float(ranked.where("selected_shared_bandwidth").first()["bandwidth_sw"])


def paired_rule(scores: DataFrame) -> DataFrame:
    """Paired loss from the best bandwidth over groups; the largest bandwidth within one standard error wins."""
    ranked = rank_bandwidths(scores)
    best = ranked.where("selected_shared_bandwidth").select(F.col("bandwidth_sw").alias("_best"))
    reference = scores.join(F.broadcast(best), F.col("bandwidth_sw") == F.col("_best")).select(
        "phase", "hand", F.col("mean_heldout_cycle_log_score").alias("_top")
    )
    loss = scores.join(reference, ["phase", "hand"]).withColumn("loss", F.col("_top") - F.col("mean_heldout_cycle_log_score"))
    per = loss.groupBy("bandwidth_sw").agg(
        F.avg("loss").alias("paired_mean_loss_from_best"),
        (F.stddev_samp("loss") / F.sqrt(F.count("*"))).alias("paired_se_loss_from_best"),
    ).withColumn("eligible", F.col("paired_mean_loss_from_best") <= F.col("paired_se_loss_from_best"))
    widest = F.max(F.when(F.col("eligible"), F.col("bandwidth_sw"))).over(Window.partitionBy(F.lit(0)))
    return per.withColumn("selected", F.col("bandwidth_sw") == widest)


def fitted_density(cells: DataFrame, groups: Sequence[str], video: str, cycle: str, grid: Grid, bandwidth: float) -> DataFrame:
    """Mean of the smoothed unit-mass cycles: ``(groups, ix, iy, mass)``, every cell that has mass.

    Cells beyond the kernel's reach of all points have none and no row; ``whole_grid`` adds them.
    """
    groups = list(groups)
    summed = normalised_cells(cells, groups, video, cycle, grid, [bandwidth]).groupBy(*groups, "ix", "iy").agg(F.sum("a0").alias("a"))
    summed = materialize(summed)
    mass = F.col("a") * F.col("_mix")[0] * F.col("_miy")[0]
    whole = _masses(summed, grid, [bandwidth]).groupBy(*groups).agg(F.sum(mass).alias("_whole"))
    nx, ny = grid.shape
    margin = reach([bandwidth])
    size = max(64, margin)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*groups).schema)

    def smooth(key, pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = (int(v) for v in key[-2:])
        xs, x_at = np.unique(pdf.ix, return_inverse=True)
        ys, y_at = np.unique(pdf.iy, return_inverse=True)
        layer = np.zeros((len(xs), len(ys)))
        layer[x_at, y_at] = pdf.a
        ix, iy = np.arange(tx * size, min((tx + 1) * size, nx)), np.arange(ty * size, min((ty + 1) * size, ny))
        ix, iy = ix[ix >= 0], iy[iy >= 0]
        layer = kernel_between(bandwidth, ix, xs) @ layer @ kernel_between(bandwidth, iy, ys).T
        a, b = np.nonzero(layer)
        out = pd.DataFrame({"ix": ix[a], "iy": iy[b], "mass": layer[a, b]})
        for name, value in zip(groups, key):
            out[name] = value
        return out[[*groups, "ix", "iy", "mass"]]

    place = [*groups, "tx", "ty"]
    tiles = spread(on_tiles(summed, size, margin), *place).groupBy(*place).applyInPandas(smooth, f"{fields}, ix bigint, iy bigint, mass double")
    return tiles.join(whole, groups).select(*groups, "ix", "iy", (F.col("mass") / F.col("_whole")).alias("mass"))


def whole_grid(mass: DataFrame, groups: Sequence[str], grid: Grid) -> DataFrame:
    """``mass`` with its empty cells as zeros: ``nx * ny`` rows per group, however large the grid."""
    nx, ny = grid.shape
    present = mass.select(*groups).distinct()
    columns = present.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nx - 1).cast("bigint"))))
    # Spread before the second axis multiplies the rows.
    cells = columns.repartition(*groups, "ix").withColumn("iy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ny - 1).cast("bigint"))))
    return cells.join(mass, [*groups, "ix", "iy"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def hdr_thresholds(mass: DataFrame, groups: Sequence[str], coverages: Sequence[float] = COVERAGES, *, leaf: int = LEAF_ROWS) -> DataFrame:
    """Smallest mass of the highest-density region per group and coverage.

    The heaviest cells are taken until they reach the coverage; the last one's mass is the threshold.
    """
    rows = mass.where("mass > 0").select(*groups, (-F.col("mass")).alias("x"), F.col("mass").alias("w"))
    names = {f"_c{i}": float(c) for i, c in enumerate(coverages)}
    found = smallest_reaching(rows, {name: lambda n, c=c: F.lit(c) for name, c in names.items()}, groups, leaf=leaf)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), (-F.col(name)).alias("threshold")) for name, c in names.items()])).alias("_r")
    return found.select(*groups, each).select(*groups, "_r.*")


def hdr_summary(mass: DataFrame, groups: Sequence[str], grid: Grid, coverages: Sequence[float] = COVERAGES) -> DataFrame:
    """Area, attained mass and weighted centroid of each region, ties at the threshold included."""
    x, y = grid.x.centre(F.col("ix")), grid.y.centre(F.col("iy"))
    inside = mass.join(hdr_thresholds(mass, groups, coverages), list(groups)).where(F.col("mass") >= F.col("threshold"))
    total = F.sum("mass")
    out = inside.groupBy(*groups, "coverage").agg(
        (F.count("*") * CELL_SIZE_SW**2).alias("area_sw2"), total.alias("achieved_probability_mass"),
        (F.sum(x * F.col("mass")) / total).alias("x_centroid_sw"), (F.sum(y * F.col("mass")) / total).alias("y_centroid_sw"),
        F.max("threshold").alias("probability_mass_threshold"),
    )
    return out.withColumn("centroid_distance_from_needle_sw", F.hypot("x_centroid_sw", "y_centroid_sw"))
