"""Interval tables: range joins, linkage, merging, gaps and greedy selection.

Range predicates always ride on an equality over a bucket of the ordered axis, so
a hot key spreads over its buckets and no theta join degenerates into a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import Carry, carry


# Interval lengths share a level of the bucket hierarchy in classes of this many powers of two.
LEVEL_STEP = 3


def _level(start: Column, end: Column) -> Column:
    """Power of two of the bucket width for an interval: a quarter of its length or less, so it meets at most 17 buckets.

    Buckets stay wide enough to be numbered: a width is never below the 2**50th part of the bounds.
    """
    length = F.ceil(F.log2((end - start).cast("double")))
    least = F.ceil(F.log2(F.greatest(F.abs(start), F.abs(end), F.lit(1)).cast("double"))) - 50
    return (F.floor(F.greatest(length - 2, least) / F.lit(LEVEL_STEP)) * LEVEL_STEP).cast("int")


def _bucket(value: Column, level: Column) -> Column:
    return F.floor(value.cast("double") / F.pow(F.lit(2.0), level))


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, *, closed: bool = False,
) -> DataFrame:
    """Points joined to every interval of their key that contains them.

    Half-open ``[start, end)``, or ``[start, end]`` when ``closed``. Every interval lies in a few buckets of the dyadic level
    that fits its own length, and a point asks its bucket once per level that occurs (a number of size classes, found by a
    subquery), so long and short intervals mix freely and no width is to be given. Rows with missing bounds match nothing.
    """
    renamed = {k: f"_k_{k}" for k in keys}
    leveled = intervals.where(F.col(end) >= F.col(start)).withColumn("_k__l", _level(F.col(start), F.col(end)))
    levels = leveled.agg(F.sort_array(F.collect_set("_k__l"))).scalar()
    spans = F.sequence(_bucket(F.col(start), F.col("_k__l")), _bucket(F.col(end), F.col("_k__l")))
    right = leveled.withColumnsRenamed(renamed).withColumn("_k__b", F.explode(spans))
    left = points.where(F.col(point).isNotNull()).withColumn("_l", F.explode(levels))
    left = left.withColumn("_b", _bucket(F.col(point), F.col("_l")))
    upper = F.col(point) <= F.col(end) if closed else F.col(point) < F.col(end)
    equal = [F.col(k) == F.col(f"_k_{k}") for k in [*keys, "_l", "_b"]]
    joined = left.join(right, [*equal, F.col(point) >= F.col(start), upper])
    return joined.drop("_l", "_b", "_k__l", "_k__b", *renamed.values())


def first_match(
    events: DataFrame, event_id: Sequence[str], actions: DataFrame, keys: Sequence[str], *,
    at: str, start: str, end: str, order: Sequence[str], carried: Sequence[str],
) -> DataFrame:
    """For each event the first action (by ``order``) with ``start <= at <= end``.

    Returns every event with ``linked`` and the carried action columns (NULL when outside).
    """
    hits = interval_join(events, actions, keys, at, start, end, closed=True)
    best = hits.groupBy(*event_id).agg(
        F.min_by(F.struct(*carried), F.struct(*order)).alias("_best")
    )
    out = events.join(best, list(event_id), "left")
    return out.select(
        *events.columns, F.col("_best").isNotNull().alias("linked"),
        *[F.col(f"_best.{c}").alias(c) for c in carried],
    )


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], frame: str, *, block: Column, out: str = "nearest"
) -> DataFrame:
    """Nearest ``right`` frame of the same key for every ``left`` row, ties to the earlier frame.

    Both sides are merged on the frame axis and the neighbouring right-hand frames
    are carried over, so no pairs are formed.
    """
    keys = list(keys)
    marks = right.groupBy(*keys, frame).agg(F.lit(True).alias("_r"))
    asked = left.groupBy(*keys, frame).agg(F.lit(True).alias("_l"))
    axis = marks.join(asked, [*keys, frame], "full")
    mark = F.when(F.col("_r"), F.col(frame))
    seen = carry(axis, keys, frame, {"_prev": Carry("last", mark), "_next": Carry("next", mark)}, block)
    back, ahead = F.col(frame) - F.col("_prev"), F.col("_next") - F.col(frame)
    pick = F.when(ahead.isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    found = seen.where("_l").select(*keys, frame, pick.alias(out))
    return left.join(found, [*keys, frame], "left")


def union_groups(
    df: DataFrame, keys: Sequence[str], start: str, end: str, *, order: str, block: Column
) -> DataFrame:
    """Label overlapping or touching intervals with a common group number per key.

    A group opens where the start lies beyond every earlier end. ``order`` is unique
    per key and sorts by start; rows with an end before their start are dropped.
    """
    valid = df.where(F.col(end) >= F.col(start))
    reach = carry(valid, keys, order, {"_reach": Carry("before_max", F.col(end))}, block)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    flagged = reach.withColumn("_opens", opens.cast("bigint")).drop("_reach")
    return carry(flagged, keys, order, {"group": Carry("sum", F.col("_opens"))}, block)


def attempt_count(
    df: DataFrame, keys: Sequence[str], start: str, end: str, *, order: str, block: Column, out: str = "attempts"
) -> DataFrame:
    """Number of temporally distinct attempts per key (overlapping records merged)."""
    valid = df.where(F.col(end) >= F.col(start))
    reach = carry(valid, keys, order, {"_reach": Carry("before_max", F.col(end))}, block)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    return reach.groupBy(*keys).agg(F.count_if(opens).alias(out))


def adjacent_gaps(
    df: DataFrame, keys: Sequence[str], start: str, end: str, flag: str, *, order: str, block: Column
) -> DataFrame:
    """Gap to the previous row where both rows are flagged; never across an unflagged one."""
    previous = carry(
        df, keys, order, {"_end": Carry("lag", F.col(end)), "_flag": Carry("lag", F.col(flag))}, block
    )
    return previous.where(F.col(flag) & F.col("_flag") & F.col("_end").isNotNull()).withColumn(
        "gap", F.col(start) - F.col("_end")
    ).drop("_end", "_flag")


def merge_without_return(
    runs: DataFrame, positions: DataFrame, keys: Sequence[str], columns: Sequence[str], *,
    max_gap: Column, tolerance: float, block: Column,
) -> DataFrame:
    """Join neighbouring runs when the short gap between them never falls back.

    ``runs`` has inclusive ``start``/``end`` positions. Two runs merge when at most
    ``max_gap`` rows lie between them and every column is known on the whole bridge
    and never more than ``tolerance`` below its value at the earlier run's end. The
    decision looks only at the previous raw run, so merging is a running count.
    """
    keys = list(keys)
    runs = materialize(runs)
    prior = carry(runs, keys, "start", {"_prior": Carry("lag", F.col("end"))}, block)
    near = prior.where(F.col("start") - F.col("_prior") - 1 <= max_gap)
    bridge = near.select(*keys, "start", "_prior", F.explode(F.sequence("_prior", "start")).alias("pos"))
    rows = bridge.join(positions.select(*keys, "pos", *columns), [*keys, "pos"], "left")
    tests = [F.count(c) == F.count("*") for c in columns]
    held = [
        F.min(c) - F.max(F.when(F.col("pos") == F.col("_prior"), F.col(c))) >= -tolerance for c in columns
    ]
    ok = tests[0]
    for t in [*tests[1:], *held]:
        ok = ok & t
    joins = rows.groupBy(*keys, "start").agg(F.coalesce(ok, F.lit(False)).alias("_joins"))
    flagged = runs.join(joins.select(*keys, "start", "_joins"), [*keys, "start"], "left").withColumns(
        {"_opens": F.when(F.col("_joins"), 0).otherwise(1).cast("bigint"), "_one": F.lit(1).cast("bigint")}
    )
    numbered = carry(
        flagged, keys, "start",
        {"candidate_index": Carry("sum", F.col("_opens")), "_raw": Carry("sum", F.col("_one"))}, block,
    )
    raw = F.array_join(F.transform(F.array_sort(F.collect_list("_raw")), lambda r: r.cast("string")), ";")
    return numbered.groupBy(*keys, "candidate_index").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.count("*").alias("raw_core_count"), raw.alias("source_raw_candidate_indices"),
    )


# Frames of one block of a greedy selection; a key has at most one candidate per frame.
SELECT_FRAMES = 1 << 16
_OPEN, _KEPT, _DROPPED = 0, 1, 2


def suppress_neighbours(
    df: DataFrame, keys: Sequence[str], frame: str, score: str, gap: str, *, block_frames: int = SELECT_FRAMES
) -> DataFrame:
    """Greedy selection by falling score (then frame), none nearer than ``gap`` frames.

    A candidate's fate hangs on its stronger neighbours alone. Keys are cut into blocks of frames that also see the
    candidates within one gap beyond their edges; a block settles every candidate whose stronger neighbours are
    settled. What waits for a stronger candidate of the next block is taken up again, in its block only, until
    nothing is open, so a chain takes as many rounds as it crosses blocks in falling order. ``gap`` is constant per
    key; missing scores come last.
    """
    keys = list(keys)
    width = max(block_frames, int(df.agg(F.coalesce(F.max(gap), F.lit(1))).first()[0]))
    home = F.floor(F.col("_f") / F.lit(width))
    state = df.select(
        *keys, F.col(frame).cast("bigint").alias("_f"), F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("_s"),
        F.col(gap).cast("double").alias("_g"), F.lit(_OPEN).alias("_state"),
    )
    schema = state.schema

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["_blk"].to_numpy() == pdf["_home"].to_numpy()
        settled = _settle(pdf["_f"].to_numpy(), pdf["_s"].to_numpy(), float(pdf["_g"].iloc[0]), pdf["_state"].to_numpy(), own)
        return pdf.assign(_state=settled).loc[own, schema.names]

    def one_round(rows: DataFrame, blocks: DataFrame | None) -> DataFrame:
        near = F.array_distinct(F.transform(F.array(-F.col("_g"), F.lit(0.0), F.col("_g")), lambda d: F.floor((F.col("_f") + d) / F.lit(width))))
        seen = rows.withColumn("_home", home).withColumn("_blk", F.explode(near))
        if blocks is not None:
            seen = seen.join(blocks, [*keys, "_blk"], "left_semi")
        return seen.groupBy(*keys, "_blk").applyInPandas(settle, schema)

    state = materialize(one_round(state, None))
    while not (waiting := state.where(F.col("_state") == _OPEN)).isEmpty():
        blocks = materialize(waiting.select(*keys, home.alias("_blk")).distinct())
        others = state.withColumn("_blk", home).join(blocks, [*keys, "_blk"], "left_anti").drop("_blk")
        state = materialize(others.unionByName(one_round(state, blocks)))
    kept = state.where(F.col("_state") == _KEPT).select(*keys, F.col("_f").alias(frame))
    return df.join(kept, [*keys, frame], "left_semi")


def _settle(frames: np.ndarray, scores: np.ndarray, gap: float, state: np.ndarray, own: np.ndarray) -> np.ndarray:
    """States of one block after settling its own candidates in order of strength, as far as they can be."""
    order = np.argsort(frames, kind="stable")
    f, s, state, own = frames[order], scores[order], state[order].copy(), own[order]
    # Candidates nearer than the gap: a range of places around each.
    low, high = np.searchsorted(f, f - gap, "right"), np.searchsorted(f, f + gap, "left")
    rank = np.empty(len(f), np.int64)
    strongest = np.lexsort((f, -s))
    rank[strongest] = np.arange(len(f))
    for i in strongest[own[strongest] & (state[strongest] == _OPEN)].tolist():
        around = state[low[i] : high[i]]
        if (around == _KEPT).any():
            state[i] = _DROPPED
        elif not ((around == _OPEN) & (rank[low[i] : high[i]] < rank[i])).any():
            state[i] = _KEPT
    out = np.empty_like(state)
    out[order] = state
    return out
