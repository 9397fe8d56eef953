"""K-means over many starts and numbers of clusters at once, and exact silhouettes over many labellings at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RANDOM_SEED
from ..session import materialize, spread

# Rows that starting centres are drawn from, bytes of centres on the way at once, rows measured at once, and rows of a task.
INIT_ROWS, CENTRE_BYTES, CHUNK_ROWS, TASK_ROWS = 4096, 32 << 20, 1024, 1 << 18
# Fits compared at once, share of rows in doubt that makes all be measured in double, centres whose sums travel as one value.
RUN_FITS, DENSE_SHARE, SLICE_CENTRES = 50, 0.02, 256


@dataclass
class Fit:
    """One run: its number of clusters, its place among the starts, its centres and, once settled, its cost."""

    k: int
    start: int
    centres: np.ndarray
    cost: float = float("inf")
    settled: bool = False


def _points(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centres far apart: each next one is drawn by squared distance to those chosen; repeated rows fill up what is missing."""
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = near.sum()
        at = int(np.searchsorted(np.cumsum(near), rng.random() * total, "right")) if total > 0 else int(rng.integers(len(x)))
        chosen.append(min(at, len(x) - 1))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def starting_fits(points: DataFrame, ks: Sequence[int], starts: int, seed: int) -> list[Fit]:
    """Every start of every K. Centres are drawn in tasks from up to ``INIT_ROWS`` rows of least hash (all rows of a smaller table)."""
    drawn = points.select("_x", F.xxhash64(F.lit(seed), "_x").alias("_h")).orderBy("_h", "_x").limit(INIT_ROWS).toPandas()
    sample = np.stack(drawn["_x"].to_list()).astype(float)
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(sample)
    wanted = spark.createDataFrame([(int(k), i) for k in ks for i in range(starts)], "k int, start int")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [_spread_start(shared.value, k, np.random.default_rng([seed, k, i])).ravel() for k, i in zip(pdf.k, pdf.start)]
            yield pdf.assign(centres=made)

    rows = spread(wanted, "k", "start").mapInPandas(draw, "k int, start int, centres array<double>").collect()
    return [Fit(r.k, r.start, np.array(r.centres).reshape(r.k, -1)) for r in sorted(rows, key=lambda r: (r.k, r.start))]


def _nearest(x: np.ndarray, centres: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Per row and fit the nearest of its centres (a number over all centres) and the squared distance to it.

    Neighbouring fits of the same K are compared at once. What is the same for all centres of a row is added at the end.
    """
    apart = np.c_[x, np.ones(len(x))] @ np.vstack([-2 * centres.T, (centres * centres).sum(axis=1)])
    place, least, at = [], [], 0
    for k, same in groupby(sizes):
        fits = len(list(same))
        part = apart[:, at : at + k * fits].reshape(len(x), fits, k)
        best = part.argmin(axis=2)
        place.append(best + (at + k * np.arange(fits)))
        least.append(np.take_along_axis(part, best[:, :, None], 2)[:, :, 0])
        at += k * fits
    return np.concatenate(place, axis=1), np.maximum(np.concatenate(least, axis=1) + (x * x).sum(axis=1)[:, None], 0.0)


def _members(x: np.ndarray, centres: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Who belongs to whom, per run of fits of one K: the number of its first centre, and centres by rows, true at the nearest.

    Distances are compared in single precision. A row that has not exactly one centre within the bound of the error is
    measured in double; so are all rows of the run if these are many. Of equally near centres it is the first.
    """
    rows, width = x.shape
    c2 = (centres * centres).sum(axis=1)
    near = np.c_[-2 * centres, c2].astype(np.float32)
    low = np.ascontiguousarray(np.c_[x, np.ones(rows)].astype(np.float32).T)
    length = np.sqrt((x * x).sum(axis=1))
    product = np.empty((min(RUN_FITS * max(sizes), len(centres)), rows), np.float32)
    at = 0
    for k, fits in ((k, min(RUN_FITS, left)) for k, same in groupby(sizes) for n in [len(list(same))] for left in range(n, 0, -RUN_FITS)):
        part = slice(at, at + k * fits)
        apart = np.matmul(near[part], low, out=product[: k * fits]).reshape(fits, k, rows)
        reach = np.sqrt(c2[part].reshape(fits, k).max(axis=1))[:, None]
        slack = ((width + 8) * np.finfo(np.float32).eps * (2 * length + reach) * reach + 1e-36).astype(np.float32)
        member = apart <= (apart.min(axis=1) + slack)[:, None]
        unsure = np.add.reduce(member, axis=1, dtype=np.uint16 if k < 1 << 16 else np.int64) != 1
        f, r = np.nonzero(unsure)
        if len(f) > DENSE_SHARE * unsure.size:
            exact = (c2[part, None] - 2 * (centres[part] @ x.T)).reshape(fits, k, rows)
            member = exact.argmin(axis=1)[:, None] == np.arange(k)[:, None]
        else:
            own, own2 = centres[part].reshape(fits, k, width), c2[part].reshape(fits, k)
            member[f, :, r] = False
            for i in range(0, len(f), 512):
                g, h = f[i : i + 512], r[i : i + 512]
                member[g, (own2[g] - 2 * np.einsum("rw,rkw->rk", x[h], own[g])).argmin(axis=1), h] = True
        yield at, member.reshape(k * fits, rows)
        at += k * fits


def _step(points: DataFrame, fits: Sequence[Fit], middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and sizes of all clusters and the costs of all fits, in one pass over the rows.

    A task sends its sums in slices of centres, which are added in tasks again. Costs follow from the sums, as everything
    is measured from ``middle``, about which the rows lie.
    """
    sizes = [f.k for f in fits]
    centres = np.concatenate([f.centres for f in fits])
    width = centres.shape[1]
    context = points.sparkSession.sparkContext
    shared = context.broadcast((centres - middle, middle))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved, zero = shared.value
        sums, squares = np.zeros((len(moved), width + 1)), 0.0
        ones = np.empty((min(RUN_FITS * max(sizes), len(moved)), CHUNK_ROWS))
        with np.errstate(over="ignore", invalid="ignore"):
            for batch in batches:
                whole = _points(batch, "_x")
                for i in range(0, len(whole), CHUNK_ROWS):
                    x = whole[i : i + CHUNK_ROWS] - zero
                    counted = np.c_[x, np.ones(len(x))]
                    squares += (x * x).sum()
                    for at, member in _members(x, moved, sizes):
                        held = ones[: len(member), : len(x)]
                        held[:] = member
                        sums[at : at + len(member)] += held @ counted
        firsts = range(0, len(sums), SLICE_CENTRES)
        cut = [sums[i : i + SLICE_CENTRES].tobytes() for i in firsts]
        yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(cut, pa.binary()), pa.array([squares] * len(cut))], ["at", "sums", "squares"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, float]] = {}
        for batch in batches:
            for at, sent, squares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, total = held.get(at, (0.0, 0.0))
                held[at] = (before + np.frombuffer(sent), total + squares)
        made = [pa.array(list(held), pa.int64()), pa.array([s.tobytes() for s, _ in held.values()], pa.binary()), pa.array([q for _, q in held.values()], pa.float64())]
        yield pa.RecordBatch.from_arrays(made, ["at", "sums", "squares"])

    kind = "at bigint, sums binary, squares double"
    tasks = min(context.defaultParallelism, -(-len(centres) // SLICE_CENTRES))
    rows = sorted(points.mapInArrow(measure, kind).repartition(tasks, "at").mapInArrow(add, kind).collect())
    shared.destroy()
    sums = np.concatenate([np.frombuffer(r.sums) for r in rows]).reshape(-1, width + 1)
    sums, counts = sums[:, :width], sums[:, width]
    moved = centres - middle
    gained = (moved * (counts[:, None] * moved - 2 * sums)).sum(axis=1)
    costs = np.maximum(rows[0].squares + np.add.reduceat(gained, np.concatenate([[0], np.cumsum(sizes)[:-1]])), 0.0)
    return sums + counts[:, None] * middle, counts, costs


def lloyd(points: DataFrame, fits: list[Fit], *, max_iter: int, tol: float) -> list[Fit]:
    """All fits advance together; one pass over ``_x`` serves every unsettled one, so jobs grow with iterations alone.

    A cluster without rows keeps its centre. A fit is settled when its centres move by no more than ``tol`` (sum of squares,
    in units of the mean variance of a column). Fits go in groups whose centres are at most ``CENTRE_BYTES``.
    """
    width = fits[0].centres.shape[1]
    columns = points.select(F.posexplode("_x")).groupBy("pos").agg(F.avg("col").alias("m"), F.var_pop("col").alias("v"))
    held = columns.agg(F.avg("v").alias("v"), F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("m")).first()
    spread_of, middle = held["v"] or 0.0, np.nan_to_num(np.array([m["m"] for m in held["m"]], float), posinf=0.0, neginf=0.0)
    group: list[Fit] = []
    groups = [group]
    for fit in fits:
        if group and sum(f.k for f in group) * width * 8 + fit.k * width * 8 > CENTRE_BYTES:
            group = []
            groups.append(group)
        group.append(fit)
    for group in groups:
        for turn in range(max_iter + 1):
            todo = [f for f in group if not f.settled]
            if not todo:
                break
            sums, sizes, costs = _step(points, todo, middle)
            at = 0
            for fit, cost in zip(todo, costs, strict=True):
                n = sizes[at : at + fit.k, None]
                moved = np.where(n > 0, sums[at : at + fit.k] / np.maximum(n, 1), fit.centres)
                at += fit.k
                # The cost belongs to the centres that were measured, so a settled fit keeps those.
                fit.cost = float(cost)
                fit.settled = turn == max_iter or ((moved - fit.centres) ** 2).sum() <= tol * spread_of
                if not fit.settled:
                    fit.centres = moved
    return fits


def best_fits(df: DataFrame, features: str, ks: Sequence[int], *, n_init: int, max_iter: int = 300, tol: float = 1e-4, seed: int = RANDOM_SEED) -> dict[int, Fit]:
    """Per K the fit of least cost over ``n_init`` starts, the first of equal ones. ``features`` is an array column."""
    spark = df.sparkSession
    # Few bytes, but every fit's work: a task for each core. More of them would only send more sums, as many as all centres each.
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
    points = materialize(df.select(F.col(features).alias("_x")).repartition(tasks))
    best: dict[int, Fit] = {}
    for fit in lloyd(points, starting_fits(points, ks, n_init, seed), max_iter=max_iter, tol=tol):
        if fit.k not in best or fit.cost < best[fit.k].cost:
            best[fit.k] = fit
    return best


def assign(df: DataFrame, key: str, features: str, fits: Sequence[Fit]) -> DataFrame:
    """``key`` and one column ``k{K}`` per fit with the number of the nearest centre, from 0."""
    sizes = [f.k for f in fits]
    shared = df.sparkSession.sparkContext.broadcast(np.concatenate([f.centres for f in fits]))
    offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    names = [f"k{k}" for k in sizes]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _points(batch, "_x")
            place = np.concatenate([_nearest(x[i : i + CHUNK_ROWS], shared.value, sizes)[0] for i in range(0, len(x), CHUNK_ROWS)]) - offsets if len(x) else np.empty((0, len(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c.astype(np.int32)) for c in place.T]], [key, *names])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(features).alias("_x")).mapInArrow(label, f"`{key}` {kind}, " + ", ".join(f"{n} int" for n in names))


def centre_table(df: DataFrame, fits: Sequence[Fit]) -> DataFrame:
    """``K, Cluster, centre``: the centres of the fits, clusters from 1."""
    rows = [(f.k, i + 1, [float(v) for v in c]) for f in fits for i, c in enumerate(f.centres)]
    return df.sparkSession.createDataFrame(rows, "K int, Cluster int, centre array<double>")


# --- silhouettes -----------------------------------------------------------------------
# Rows of one block in a task; a task meets two blocks. Rows of either side whose distances are made at once.
BLOCK_POINTS, TILE = 1 << 15, (256, 1024)
# Share of the largest squared length below which a squared distance is taken from the differences themselves.
CLOSE = 1e-5


def _distances(a: np.ndarray, b: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Distances by one product; ``a2`` and ``b2`` are squared lengths. Rows that are close, so that it loses digits, or not finite are subtracted."""
    squared = np.c_[a, a2, np.ones(len(a))] @ np.vstack([-2 * b.T, np.ones(len(b)), b2])
    bound = CLOSE * sum(v[np.isfinite(v)].max(initial=0.0) for v in (a2, b2))
    if squared.size and squared.min() > bound:  # most tiles have none
        return np.sqrt(squared, out=squared)
    i, j = np.nonzero(~(squared > bound))
    for at in range(0, len(i), 1 << 14):
        d = a[i[at : at + (1 << 14)]] - b[j[at : at + (1 << 14)]]
        squared[i[at : at + (1 << 14)], j[at : at + (1 << 14)]] = np.einsum("ij,ij->i", d, d)
    return np.sqrt(squared, out=squared)


def silhouettes(df: DataFrame, key: str, features: str, labels: Sequence[str]) -> DataFrame:
    """Euclidean silhouettes of every row under each labelling: ``key, labelling, label, silhouette``.

    Rows fall into ``g`` hash blocks. A task meets one pair of blocks and serves both sides of every distance, so a row is
    sent to ``g`` tasks, once per block and not once per pair. Blocks are as large as a task allows (fewer copies), smaller
    only to give every core a pair. What leaves a task is one sum per row and cluster.
    """
    labels = list(labels)
    points = materialize(df.select(F.col(key).alias("_id"), F.array(*[F.col(c).cast("bigint") for c in labels]).alias("_c"), F.col(features).alias("_x")))
    counted = points.select(F.posexplode("_c")).groupBy("pos", "col").count().collect()
    total = {(r["pos"], r["col"]): r["count"] for r in counted}
    place = {p: i for i, p in enumerate(sorted(total))}
    rows = sum(n for (which, _), n in total.items() if which == 0)
    cores = points.sparkSession.sparkContext.defaultParallelism
    g = max(1, -(-rows // BLOCK_POINTS), min(int(np.ceil(np.sqrt(2 * cores))), -(-rows // 512)))
    own = F.pmod(F.xxhash64("_id"), F.lit(g)).cast("int")
    sent = points.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    pairs = sent.select("_id", "_c", "_x", "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))

    def onehot(codes: pd.Series) -> np.ndarray:
        out = np.zeros((len(codes), len(place)))
        for which, column in enumerate(np.stack(codes.to_list()).T):
            out[np.arange(len(codes)), [place[which, c] for c in column]] = 1.0
        return out

    def measure(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        left, right = pdf[pdf["_own"] == i], pdf[pdf["_own"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"_id": pdf["_id"][:0], "_c": pdf["_c"][:0], "_s": []})
        x, y, of_left, of_right = np.stack(left["_x"].to_list()), np.stack(right["_x"].to_list()), onehot(left["_c"]), onehot(right["_c"])
        to_left, to_right = np.zeros((len(x), len(place))), np.zeros((len(y), len(place)))
        middle = x[np.isfinite(x).all(axis=1)].sum(axis=0) / len(x)  # shorter vectors lose fewer digits, and distances stay
        x, y = x - middle, y - middle
        x2, y2 = (x * x).sum(axis=1), (y * y).sum(axis=1)
        for at in range(0, len(x), TILE[0]):
            rows = slice(at, at + TILE[0])
            for to in range(0, len(y), TILE[1]):
                columns = slice(to, to + TILE[1])
                d = _distances(x[rows], y[columns], x2[rows], y2[columns])
                to_left[rows] += d @ of_right[columns]
                if i != j:
                    to_right[columns] += d.T @ of_left[rows]
        parts = [pd.DataFrame({"_id": left["_id"], "_c": left["_c"], "_s": list(to_left)})]
        if i != j:
            parts.append(pd.DataFrame({"_id": right["_id"], "_c": right["_c"], "_s": list(to_right)}))
        return pd.concat(parts)

    kind = points.schema["_id"].dataType.simpleString()
    sums = spread(pairs, "_i", "_j").groupBy("_i", "_j").applyInPandas(measure, f"_id {kind}, _c array<bigint>, _s array<double>")
    added = sums.groupBy("_id", "_c").agg(*[F.sum(F.col("_s")[i]).alias(f"s{i}") for i in range(len(place))])
    each = []
    for which, name in enumerate(labels):
        mine = [(c, i) for (w, c), i in place.items() if w == which]
        label = F.col("_c")[which]
        inside = F.coalesce(*[F.when(label == c, F.col(f"s{i}")) for c, i in mine])
        size = F.coalesce(*[F.when(label == c, F.lit(total[which, c])) for c, _ in mine])
        b = F.array_min(F.array(*[F.when(label != c, F.col(f"s{i}") / total[which, c]) for c, i in mine]))
        a = F.try_divide(inside, size - 1)
        value = F.coalesce(F.when(size == 1, 0.0).otherwise(F.try_divide(b - a, F.greatest(a, b))), F.lit(0.0))
        each.append(F.struct(F.lit(name).alias("labelling"), label.alias("label"), value.alias("silhouette")))
    if not each or not place:
        each = [F.struct(F.lit("").alias("labelling"), F.lit(None).cast("bigint").alias("label"), F.lit(None).cast("double").alias("silhouette"))]
    return added.select(F.col("_id").alias(key), F.explode(F.array(*each)).alias("_r")).select(key, "_r.*")
