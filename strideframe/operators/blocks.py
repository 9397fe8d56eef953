"""Bounded blocks for ordered series.

A series is ``(keys..., pos)``. A window over the whole key would put a hot key
into one task, so ordered operators run over ``(keys..., pos div rows)``:

* operators with a bounded reach copy the rows near a block edge into the
  neighbouring block (``with_halo``) and keep only a block's own rows at the end;
* operators with unbounded reach (carry-forward, running totals) scan each block,
  scan the one-row-per-block summaries, and add the carried value back
  (``carry``).

A task never holds more than ``rows`` rows plus the halo, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_ROWS = 1 << 16


def micros(ts: str) -> Column:
    """A zone-less timestamp column as microseconds."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def bucket_width(df: DataFrame, keys: Sequence[str], order: Column, target: int = BLOCK_ROWS) -> int:
    """Width of order buckets such that no ``(keys, bucket)`` exceeds ``target`` rows.

    One aggregation answers the usual case; a hot key shrinks the width until the
    counted maximum fits (or the width is one order unit).
    """
    per_key = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")
    )
    worst, lo, hi = per_key.agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    if worst is None:
        return 1
    width = max(1, int(hi) - int(lo) + 1)
    while worst > target and width > 1:
        width = max(1, width * target // (2 * worst))
        counted = df.groupBy(*keys, F.floor(order / F.lit(width)).alias("_b")).count()
        worst = counted.agg(F.max("count")).first()[0]
    return width


def _placed(block: Column, what: str) -> Column:
    """``block``, or an error for a row whose order key is missing: it has no place and would be lost or leak."""
    return F.coalesce(block, F.raise_error(F.lit(f"missing order key: {what}")).cast("bigint"))


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, out: str = "pos"
) -> DataFrame:
    """Dense zero-based row number per key, two-level over a monotone ``bucket``."""
    keys = list(keys)
    rows = df.withColumn("_b", _placed(bucket, "number_rows"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, "_b")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(starts, [*keys, "_b"])
        .withColumn(out, F.col("_start") + F.col("_local") - 1)
        .drop("_b", "_local", "_start")
    )


def ranked_by_range(df: DataFrame, order: Sequence[Column], totals: dict[str, Column], out: str = "rank") -> DataFrame:
    """Zero-based rank ``out`` over all rows by ``order`` (a total order of any type), and running ``totals`` before each row.

    Rows are range-partitioned by sampled splitters; every partition is scanned in order, and one row per partition carries
    its totals on.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id(), "_one": F.lit(1).cast("bigint")}))
    sums = {out: F.col("_one"), **totals}
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("_part").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()]).select(
        "_part", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums]
    )
    local = rows.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in sums.items()})
    joined = local.join(F.broadcast(carried), "_part")  # one row per partition
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).drop("_part", "_at", "_one", *[f"_c_{n}" for n in sums])


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key; Catalyst limits each map task to one row per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_halo(
    df: DataFrame, radius: int, *, rows: int = BLOCK_ROWS, pos: str = "pos", ahead: int | None = None
) -> DataFrame:
    """Copy rows into every block that sees them: up to ``radius`` rows behind and ``ahead`` rows before its own.

    A reach beyond a block's rows goes to several blocks.
    """
    ahead = radius if ahead is None else ahead
    blk = F.expr(f"{pos} div {rows}")
    homes = F.sequence(F.expr(f"floor(({pos} - {ahead}) / {rows})"), F.expr(f"floor(({pos} + {radius}) / {rows})"))
    return (
        df.withColumn("_home", blk)
        .withColumn("_blk", F.explode(homes))
        .withColumn("_own", F.col("_blk") == F.col("_home"))
        .drop("_home")
    )


def halo_window(keys: Sequence[str], pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*keys, "_blk").orderBy(pos)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_own", "_blk")


@dataclass(frozen=True)
class Carry:
    """One carried value: ``kind`` is last, next, lag, lead, sum or before_max."""

    kind: str
    value: Column


def carry(
    df: DataFrame, keys: Sequence[str], order: str, specs: dict[str, Carry], block: Column
) -> DataFrame:
    """Add carried values to every row, exact across blocks.

    ``order`` must be unique per key and ``block`` monotone in it.

    * last / next: nearest non-null value at or before / at or after the row
    * lag / lead: value of the previous / next row, null values included
    * sum: running total including the row
    * before_max: maximum over all earlier rows
    """
    keys = list(keys)
    rows = df.withColumn("_blk", _placed(block, order))
    inner = Window.partitionBy(*keys, "_blk").orderBy(order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    # Descending order keeps the growing-frame evaluation linear.
    since = (
        Window.partitionBy(*keys, "_blk")
        .orderBy(F.desc(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = inner.rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy(*keys).orderBy("_blk")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    after = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("_blk"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )

    local, summary, carried, final = {}, [], [], {}
    for name, spec in specs.items():
        v, here, there = spec.value, f"_l_{name}", f"_c_{name}"
        boxed = F.struct(v.alias("v"))
        if spec.kind == "last":
            local[here] = F.last(v, True).over(upto)
            total = F.max_by(v, F.when(v.isNotNull(), F.col(order)))
            incoming = F.last(F.col(f"_t_{name}"), True).over(before)
            final[name] = F.coalesce(F.col(here), F.col(there))
        elif spec.kind == "next":
            local[here] = F.last(v, True).over(since)
            total = F.min_by(v, F.when(v.isNotNull(), F.col(order)))
            incoming = F.last(F.col(f"_t_{name}"), True).over(after)
            final[name] = F.coalesce(F.col(here), F.col(there))
        elif spec.kind == "lag":
            local[here] = F.lag(boxed).over(inner)
            total = F.max_by(boxed, F.col(order))
            incoming = F.last(F.col(f"_t_{name}"), True).over(before)
            final[name] = F.coalesce(F.col(here), F.col(there))["v"]
        elif spec.kind == "lead":
            local[here] = F.lead(boxed).over(inner)
            total = F.min_by(boxed, F.col(order))
            incoming = F.last(F.col(f"_t_{name}"), True).over(after)
            final[name] = F.coalesce(F.col(here), F.col(there))["v"]
        elif spec.kind == "sum":
            local[here] = F.sum(v).over(upto)
            total = F.sum(v)
            incoming = F.sum(F.col(f"_t_{name}")).over(before)
            final[name] = F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(there), F.lit(0))
        elif spec.kind == "before_max":
            local[here] = F.max(v).over(earlier)
            total = F.max(v)
            incoming = F.max(F.col(f"_t_{name}")).over(before)
            final[name] = F.greatest(F.col(here), F.col(there))
        else:
            raise ValueError(f"unknown carry kind {spec.kind!r}")
        summary.append(total.alias(f"_t_{name}"))
        carried.append(incoming.alias(there))

    sums = rows.groupBy(*keys, "_blk").agg(*summary).select(*keys, "_blk", *carried)
    out = rows.withColumns(local).join(sums, [*keys, "_blk"])
    return out.withColumns(final).drop("_blk", *local, *[f"_c_{n}" for n in specs])
