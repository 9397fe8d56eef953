"""Exact order statistics by radix refinement.

Values are read as 64-bit integers that order like the doubles they stand for. A bucket is a prefix of these bits. Buckets
that fit one task are ranked; a larger one is split by its next 16 bits, of which only the weight per prefix reaches a
window (at most 65 536 rows per key), and only the values below the prefix that holds a goal go on. Four splits leave a
single value, so nothing depends on how values are spread and no group is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

# Rows that one task ranks of a bucket, and a larger one is split; rows of all the buckets that a task ranks; places that are broadcast.
LEAF_ROWS, TASK_ROWS, SENT_PLACES = 1 << 16, 1 << 19, 1 << 16


def ordered_bits(x: Column) -> Column:
    """An integer that orders like ``x`` and differs where ``x`` differs; both zeros are 0. ``x`` must not be NaN."""
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = guess + F.when(F.pow(F.lit(2.0), guess) > size, -1).when(F.pow(F.lit(2.0), guess + 1) <= size, 1).otherwise(0)
    power = F.greatest(F.lit(-1022), F.least(F.lit(1023), power))
    places = F.shiftleft((power + 1022).cast("bigint"), 52) + (size / F.pow(F.lit(2.0), power) * float(1 << 52)).cast("bigint")
    finite = F.when(size == 0, F.lit(0).cast("bigint")).otherwise(places)
    whole = F.when(size == float("inf"), F.lit(2047 << 52).cast("bigint")).otherwise(finite)
    return F.when(x < 0, -whole).otherwise(whole)


def _running(window: Window, weight: str) -> dict[str, Column]:
    upto = F.sum(weight).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return {"_upto": upto, "_last": F.lead(weight).over(window).isNull()}


def _reached() -> Column:
    """The goals that this row of a running total is the first to reach; the last row takes those out of reach, too."""
    return F.expr("filter(_goals, g -> _upto - _w < g.rest AND (_upto >= g.rest OR _last))")


def _joined(rows: DataFrame, few: DataFrame, place: Sequence[str], n: int, how: str) -> DataFrame:
    """``rows`` joined with the ``n`` places of ``few``: sent to the rows as long as that is a small table, so that a place of many rows stays spread."""
    return rows.join(F.broadcast(few) if n <= SENT_PLACES else few, place, how)


def _in_tasks(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in tasks of about ``TASK_ROWS``, once ``n`` rows need more tasks than the session's number."""
    tasks = -(-n // TASK_ROWS)
    return rows.repartition(tasks, *keys) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def smallest_reaching(rows: DataFrame, goals: Mapping[str, Callable[[Column], Column]], keys: Sequence[str], *, leaf: int = LEAF_ROWS) -> DataFrame:
    """``keys, _n`` and a column per goal: the smallest value at which the running weight of ``rows`` reaches it.

    ``rows`` has ``keys, x, w`` (positive weights). ``goals`` gives the weight to reach from a key's number of rows ``_n``. A
    goal beyond the whole weight takes the largest value. Keys may be null. Goals meet rows only after these are counted or
    ranked, so what a task sorts is a few numbers per row.
    """
    keys = list(keys)
    largest, every = rows.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n"), F.sum("_n")).first()
    if (largest or 0) <= leaf:
        # Every key fits a task as it is; its size is counted where its rows are ranked.
        ordered = Window.partitionBy(*keys).orderBy("x")
        size = F.count("*").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ranked = _in_tasks(rows, every or 0, *keys).withColumns({"_n": size, **_running(ordered, "w")})
        upto, n = F.col("_upto"), F.col("_n")
        here = {name: (upto - F.col("w") < rest(n)) & ((upto >= rest(n)) | F.col("_last")) for name, rest in goals.items()}
        return ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[F.max(F.when(first, F.col("x"))).alias(name) for name, first in here.items()])
    packed = F.struct(*keys).alias("_k")  # equal structs join even where a key is null
    first = F.lit(0).cast("bigint").alias("_prefix")
    rows = rows.select(packed, F.col("x"), F.col("w").alias("_w"), ordered_bits(F.col("x")).alias("_bits"), first)
    opened = materialize(rows.groupBy("_k", "_prefix").agg(F.count("*").alias("_n")).withColumn("_goals", F.array(*[
        F.struct(F.struct(F.lit(name).alias("name"), F.col("_n").alias("n")).alias("goal"), rest(F.col("_n")).alias("rest")) for name, rest in goals.items()
    ])))
    place = ["_k", "_prefix"]
    found = []
    for shift in (48, 32, 16, 0):
        wide = opened.where(F.col("_n") > leaf)
        n_wide, n_rows = opened.agg(F.count_if(F.col("_n") > leaf), F.sum(F.when(F.col("_n") <= leaf, F.col("_n")))).first()
        fits = _joined(rows, wide.select(*place), place, n_wide, "left_anti") if n_wide else rows
        ranked = _in_tasks(fits.select(*place, "_bits", "x", "_w"), n_rows or 0, *place).withColumns(_running(Window.partitionBy(*place).orderBy("_bits"), "_w"))
        found.append(ranked.join(opened.select(*place, "_goals"), place).select("_k", "x", F.explode(_reached()).alias("_g")))
        if not n_wide:
            break
        finer = F.shiftright("_bits", shift)
        weighed = (
            _joined(rows, wide.select(*place), place, n_wide, "left_semi")
            .groupBy(*place, finer.alias("_finer")).agg(F.sum("_w").alias("_w"), F.count("*").alias("_n"), F.min("x").alias("x"))
            .withColumns(_running(Window.partitionBy(*place).orderBy("_finer"), "_w")).join(wide.select(*place, "_goals"), place)
        )
        left = F.transform(_reached(), lambda g: F.struct(g["goal"].alias("goal"), (g["rest"] - (F.col("_upto") - F.col("_w"))).alias("rest")))
        narrowed = weighed.select("_k", F.col("_finer").alias("_prefix"), left.alias("_goals"), "_n", "x")
        opened = materialize(narrowed.where(F.size("_goals") > 0))
        if shift == 0:
            found.append(opened.select("_k", "x", F.explode("_goals").alias("_g")))
            break
        rows = materialize(_joined(rows.withColumn("_prefix", finer), opened.select(*place), place, opened.count(), "left_semi"))
    picks = [F.max(F.when(F.col("_g.goal.name") == name, F.col("x"))).alias(name) for name in goals]
    wide = reduce(DataFrame.unionByName, found).groupBy("_k").agg(F.max("_g.goal.n").alias("_n"), *picks)
    return wide.select(*[F.col("_k")[k].alias(k) for k in keys], "_n", *goals)
