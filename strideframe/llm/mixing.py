"""Mixing sources to target weights by entropy balancing.

Among all document rates that give each source its target of words, the mix takes those closest (in relative entropy)
to taking every document once, none more than ``most`` times. The dual has one variable a source; its solution tilts
rates exponentially in the document's size: rate = min(most, exp(lambda * size / mean size)). Spark sums the dual's
gradient and curvature over all documents in each Newton step (documents of one source and size share a rate, so the
sums run over a table of sizes and counts); a bracket around each lambda keeps the steps safe.

Rates become whole copies: within groups of about ``group_rows`` documents of one source, from the largest to the
smallest, the part of a copy that rounding takes or leaves is carried on to the next document, so a group misses its
share by less than its smallest documents' words. Groups are dealt by a hash of the id: a source that holds a third of
all rows is spread over many tasks, and reruns agree whatever the partitions.

Edge cases: null, empty and blank texts have size 0 and are taken once (0 words); a source without words has target 0;
null sources come last; rows that repeat an id are documents of their own; an empty table gives no rows; further
columns are carried along untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.store import free_name, keep

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
GROUP_ROWS, STEPS, TOLERANCE = 1024, 400, 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, rows, source_size, target): ``share`` of all words by weight, no source above ``most`` times its own.

    Sharing out again what capped sources leave ends where all others stand at one level per weight: with sources in the
    order of cap by weight, that level follows from running sums. One row per source goes through the ordered windows.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    ranked = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order, everything = Window.orderBy("ratio", F.asc_nulls_last("source")), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)
    stop = levelled.withColumn("stop", first)
    target = F.when(F.col("stop").isNull() | (F.col("ratio") < F.col("stop.ratio")), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("weight") * F.col("stop.level"))
    )
    return stop.select("source", "rows", "source_size", target.alias("target"))


def tilts(sizes: DataFrame, goals: DataFrame, *, most: float = MOST, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``goals`` with the dual solution ``tilt`` and the mean size of each source, by distributed Newton steps."""
    classes = keep(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    mean = F.when(F.col("source_size") > 0, F.col("source_size") / F.col("rows"))
    state = goals.withColumn("mean", mean).select(
        "source", "rows", "source_size", "target", "mean",
        F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        (F.col("mean").isNull() | (F.col("target") >= most * F.col("source_size"))).alias("done"),
    )
    state = keep(state, "tilts")
    for _ in range(steps):
        if state.where("NOT done").isEmpty():
            break
        open_ = state.where("NOT done").select(F.col("source").alias("s"), "mean", "tilt", "target")
        u = F.col("size") / F.col("mean")
        free = F.exp(F.least(F.col("tilt") * u, F.lit(700.0)))
        rate = F.least(free, F.lit(most))
        sums = (
            classes.join(open_, F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s").agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("taken"),
                F.sum(F.when(free < most, F.col("n") * F.col("size") * u * rate).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("taken") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("_low", low).withColumn("_high", high)
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        middle = (F.col("_low") + F.col("_high")) / 2
        outward = F.when(gap < 0, F.greatest(F.col("tilt") * 2, F.lit(1.0))).otherwise(F.least(F.col("tilt") * 2, F.lit(-1.0)))
        inside = (F.col("slope") > 0) & (F.abs(newton) < 1e6) & (F.col("_low").isNull() | (newton > F.col("_low"))) & (F.col("_high").isNull() | (newton < F.col("_high")))
        step = F.when(inside, newton).otherwise(F.coalesce(middle, outward))
        near = F.abs(gap) <= tolerance * F.col("target") + 1e-6
        settled = F.coalesce(F.col("done") | F.col("taken").isNull() | near | (F.col("_high") - F.col("_low") < 1e-12), F.lit(False))
        state = keep(moved.select(
            "source", "rows", "source_size", "target", "mean",
            F.when(settled, F.col("tilt")).otherwise(step).alias("tilt"),
            F.when(settled, F.col("low")).otherwise(F.col("_low")).alias("low"),
            F.when(settled, F.col("high")).otherwise(F.col("_high")).alias("high"), settled.alias("done"),
        ), "tilts")
    if not state.where("NOT done").isEmpty():
        raise RuntimeError(f"some sources don't settle within {steps} Newton steps")
    rate = F.when(F.col("target") >= most * F.col("source_size"), F.lit(None).cast("double")).otherwise(F.col("tilt"))
    return state.select("source", "rows", "source_size", "target", "mean", rate.alias("tilt"))


def _deal_copies(most: float):
    """Whole copies for one group of documents of one source."""

    def run(table: pa.Table) -> pa.Table:
        size, rate = table["_mix_size"].to_numpy(), table["_mix_rate"].to_numpy()
        copies, carried = np.ones(len(size), np.int64), 0.0
        for i in np.lexsort((table["_mix_key"].to_numpy(), -size)).tolist():
            if size[i]:
                copies[i] = min(int(most), max(0, int(np.floor(rate[i] + carried / size[i] + 0.5))))
                carried += (rate[i] - copies[i]) * size[i]
        return table.drop_columns(["_mix_rate", "_mix_key", "_mix_part"]).append_column("_mix_copies", pa.array(copies))

    return run


def mix(docs: DataFrame, size: Column | None = None, *, most: float = MOST, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with _mix_size, _mix_source_size, _mix_target and _mix_copies. ``size`` defaults to the text's words.

    Columns of ``docs`` whose names start with ``_mix_`` are replaced; all others stay as they are.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("_mix_")])
    size = size_of(F.col("text")) if size is None else size
    sizes = keep(docs.select(F.col("source").cast("string").alias("source"), size.alias("size")), "words")
    solved = keep(tilts(sizes, keep(targets(sizes, most=most), "targets"), most=most), "solved").select(
        F.col("source").alias("_mix_s"), F.col("rows").alias("_mix_rows"), F.col("mean").alias("_mix_mean"), F.col("tilt").alias("_mix_tilt"),
        F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"),
    )
    exponent = F.least(F.col("_mix_tilt") * F.col("_mix_size") / F.col("_mix_mean"), F.lit(700.0))
    rate = F.when(F.col("_mix_tilt").isNull(), F.lit(most)).otherwise(F.least(F.exp(exponent), F.lit(most)))
    key = F.xxhash64("doc_id")
    dealt = (
        docs.withColumn("_mix_size", size)
        .join(solved, F.col("source").cast("string").eqNullSafe(F.col("_mix_s")))
        .select(*docs.columns, "_mix_size", "_mix_source_size", "_mix_target", F.coalesce(rate, F.lit(1.0)).alias("_mix_rate"),
                key.alias("_mix_key"), F.pmod(key, F.ceil(F.col("_mix_rows") / F.lit(group_rows))).alias("_mix_part"))
    )
    out = dealt.drop("_mix_rate", "_mix_key", "_mix_part").withColumn("_mix_copies", F.lit(0).cast("long")).schema
    return dealt.groupBy("source", "_mix_part").applyInArrow(_deal_copies(most), out)


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document once per copy, numbered by ``copy``; documents with no copy go.

    Where ``docs`` has a column of that name, it stays, and the number is called ``copy_``.
    """
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))
    packed = docs.select("doc_id", "source", F.struct(*docs.columns).alias("doc"))
    mixed = mix(packed, size_of(F.col("doc.text"))).where("_mix_copies > 0")
    return mixed.select("doc.*", copies.alias(free_name("copy", docs.columns)))
