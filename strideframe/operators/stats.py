"""Summary statistics that stay exact without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div, wrap_degrees
from .selection import LEAF_ROWS, smallest_reaching


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float], *, leaf: int = LEAF_ROWS,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per name in ``probs``.

    The two neighbouring ranks of every quantile are selected by radix refinement, so a group of any size is spread
    over tasks of at most ``leaf`` rows.
    """
    keys = list(keys)
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs, leaf=leaf).drop("_all")
    rows = df.select(*keys, value.cast("double").alias("x"), F.lit(1).cast("bigint").alias("w")).where("x IS NOT NULL AND NOT isnan(x)")
    rank = lambda p, n: F.lit(float(p)) * (n - 1)
    goals = {}
    for i, p in enumerate(probs.values()):
        goals[f"_p{i}_0"] = lambda n, p=p: (F.floor(rank(p, n)) + 1).cast("bigint")
        goals[f"_p{i}_1"] = lambda n, p=p: (F.ceil(rank(p, n)) + 1).cast("bigint")
    found = smallest_reaching(rows, goals, keys, leaf=leaf)
    result = []
    for i, (name, p) in enumerate(probs.items()):
        low, high, at = F.col(f"_p{i}_0"), F.col(f"_p{i}_1"), rank(p, F.col("_n"))
        result.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, *result)


def quantiles_of_columns(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float], *, leaf: int = LEAF_ROWS,
) -> DataFrame:
    """Exact quantiles of several columns: result columns ``{column}_{name}``."""
    keys = list(keys)
    long = df.select(
        *keys,
        F.explode(
            F.array(
                *[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)]
            )
        ).alias("_s"),
    ).select(*keys, F.col("_s.i").alias("_i"), F.col("_s.x").alias("_v"))
    q = exact_quantiles(long, [*keys, "_i"], F.col("_v"), probs, leaf=leaf)
    wide = [
        F.max(F.when(F.col("_i") == i, F.col(n))).alias(f"{c}_{n}") for i, c in enumerate(columns) for n in probs
    ]
    return q.groupBy(*keys).agg(*wide)


def eight_stats(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """mean, median, population std, min, max, range, q25, q75; missing values skipped."""
    x = F.col(column)
    basic = df.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"),
        F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"),
    )
    q = exact_quantiles(df, keys, x, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    return basic.join(q, list(keys), "left").select(
        *keys, "mean", "median", "std", "min", "max", "range", "q25", "q75"
    )


def distribution(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """n, median, q1, q3, mean, sample sd, minimum, maximum."""
    if not keys:
        return distribution(df.withColumn("_all", F.lit(0)), ["_all"], column).drop("_all")
    x = F.col(column)
    basic = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.min(x).alias("minimum"), F.max(x).alias("maximum"),
    )
    q = exact_quantiles(df, keys, x, {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return basic.join(q, list(keys), "left").select(*keys, "n", "median", "q1", "q3", "mean", "sd", "minimum", "maximum")


def summary_moments(columns: Iterable[str], stats: Sequence[str] = ("n", "mean", "sd", "cv")) -> list[Column]:
    """Aggregates ``{column}_{stat}``; cv is sd / mean with its sign, NULL for a zero mean."""
    out = []
    for c in columns:
        x = F.col(c)
        made = {
            "n": F.count(x), "mean": F.avg(x), "sd": F.stddev_samp(x),
            "cv": safe_div(F.stddev_samp(x), F.avg(x)), "min": F.min(x), "max": F.max(x),
        }
        out += [made[s].alias(f"{c}_{s}") for s in stats]
    return out


def summarize(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """n, mean, sd, cv, q1, median, q3, min, max."""
    basic = df.groupBy(*keys).agg(*summary_moments([column], ("n", "mean", "sd", "cv", "min", "max")))
    q = exact_quantiles(df, keys, F.col(column), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    named = {f"{column}_{s}": s for s in ("n", "mean", "sd", "cv", "min", "max")}
    return (
        basic.withColumnsRenamed(named)
        .join(q, list(keys), "left")
        .select(*keys, "n", "mean", "sd", "cv", "q1", "median", "q3", "min", "max")
    )


def circular_summary(df: DataFrame, keys: Sequence[str], degrees: str) -> DataFrame:
    """Circular mean, circular sd, resultant length and absolute-deviation quartiles."""
    keys = list(keys)
    if not keys:
        return circular_summary(df.withColumn("_all", F.lit(0)), ["_all"], degrees).drop("_all")
    r = F.radians(F.col(degrees))
    base = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.sin(r)).alias("_s"), F.avg(F.cos(r)).alias("_c"))
    length = F.hypot("_c", "_s")
    base = base.select(
        *keys, "n",
        F.degrees(F.atan2("_s", "_c")).alias("signed_circular_mean_deg"),
        F.when(length > 0, F.degrees(F.sqrt(-2 * F.ln(length))))
        .otherwise(F.lit(float("inf"))).alias("circular_sd_deg"),
        length.alias("mean_resultant_length_R"),
    )
    q = exact_quantiles(
        df, keys, F.abs(wrap_degrees(F.col(degrees))),
        {"median_absolute_deviation_deg": 0.5, "q1_absolute_deviation_deg": 0.25, "q3_absolute_deviation_deg": 0.75},
    )
    return base.join(q, keys)


def share_of_total(df: DataFrame, keys: Sequence[str], part: str, count: str, total: str) -> DataFrame:
    """Counts per (keys, part) with the keys' total and the percentage.

    Counting happens before the window, so the window sees one row per part.
    """
    counted = df.dropna(subset=[*keys, part]).groupBy(*keys, part).agg(F.count("*").alias(count))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counted.withColumn(total, F.sum(count).over(w)).withColumn(
        "Percentage", F.col(count) / F.col(total) * 100
    )
