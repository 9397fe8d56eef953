"""Declared input schemas and contract checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MOTION_JOINTS

# Flags, numbers and times are read as text and converted by expressions, so that
# a stray value in one field never discards the whole record.
_XYZ = "STRUCT<x: STRING, y: STRING, z: STRING>"
_ZONE = (
    f"STRUCT<width: STRING, length: STRING, tableLocalCenter: {_XYZ}, "
    f"tableLocalForward: {_XYZ}, tableLocalRight: {_XYZ}>"
)
TRANSFER_SCHEMA = (
    "sessionId STRING, grabSessions ARRAY<STRUCT<startTime: STRING, endTime: STRING, hand: STRING, "
    f"samples: ARRAY<STRUCT<time: STRING, tableLocalPosition: {_XYZ}>>>>"
)
PUSH_SCHEMA = (
    "sessionId STRING, exitReason STRING, coordinateSpace STRING, pushCycleCount BIGINT, "
    "needleSafetyEvents ARRAY<STRUCT<time: STRING>>, "
    "pushCycles ARRAY<STRUCT<startTime: STRING, endTime: STRING, usedLeft: STRING, usedRight: STRING, "
    "isSingleHand: STRING, samples: ARRAY<STRUCT<time: STRING, hasLeft: STRING, hasRight: STRING, "
    f"leftTableLocalPosition: {_XYZ}, rightTableLocalPosition: {_XYZ}, "
    "leftInLeftZone: STRING, rightInRightZone: STRING>>>>, "
    f"pushLeftZone {_ZONE}, pushRightZone {_ZONE}"
)
META_SCHEMA = "sessionId STRING, endReason STRING, isPartialSession STRING, isSimulated STRING"

COORDINATES = tuple(f"{j}_{a}" for j in MOTION_JOINTS for a in ("x", "y"))
HIP_COORDINATES = tuple(f"{s}_hip_{a}" for s in ("left", "right") for a in ("x", "y"))


class ContractError(ValueError):
    """An input table that a plan can't work on."""


@dataclass(frozen=True)
class TableContract:
    """Columns that a table must have; ``check`` names all that are absent, and near spellings of each."""

    table: str
    columns: tuple[str, ...]

    def check(self, df: DataFrame) -> DataFrame:
        present = {c.casefold().strip(): c for c in df.columns}
        faults = []
        for name in dict.fromkeys(self.columns):
            if name not in df.columns:
                near = present.get(name.casefold())
                faults.append(f"{name} (there is {near!r})" if near else name)
        if faults:
            raise ContractError(f"{self.table}: no column {', '.join(faults)}")
        return df


def assert_rows(df: DataFrame, rules: Mapping[str, Column]) -> None:
    """Fail with the names of the rules that some row breaks; one aggregation for all."""
    broken = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]).first()
    failed = {name: broken[name] for name in rules if broken[name]}
    if failed:
        raise ValueError(f"rows break the input contract: {failed}")


def assert_unique(df: DataFrame, keys: Iterable[str], label: str) -> None:
    keys = list(keys)
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{label} has more than one row per {keys}")


def many_to_one(left: DataFrame, right: DataFrame, keys: Iterable[str], label: str, how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``, whose keys must be unique: a repeated key fails the join itself and is named.

    The guard is part of the plan (one aggregated row per key), so no second read of ``right`` is needed.
    """
    keys = list(keys)
    rest = [c for c in right.columns if c not in keys]
    named = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    single = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{label} has more than one row for "), named))).otherwise(F.col("_row"))
    guarded = single.select(*keys, checked.alias("_row"))
    joined = left.join(guarded, keys, how)
    return joined.select(*left.columns, *[F.col("_row")[c].alias(c) for c in rest])


def assert_count(df: DataFrame, expected: int | None, label: str) -> None:
    """Optional cohort size check, off when ``expected`` is None."""
    if expected is not None and (found := df.count()) != expected:
        raise ValueError(f"expected {expected} {label}, found {found}")


def feature_columns(df: DataFrame, meta: Iterable[str], patterns: Iterable[str] = ()) -> list[str]:
    """Numeric columns that are neither metadata nor named like derived results."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    skip = set(meta)
    return [
        name for name, kind in df.dtypes
        if name not in skip and (kind in numeric or kind.startswith("decimal"))
        and not any(p in name.lower() for p in patterns)
    ]
