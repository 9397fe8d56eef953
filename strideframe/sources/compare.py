"""Tolerance comparison of two result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import assert_unique

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def compare_tables(actual: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 1e-12) -> dict:
    """Key-set equality and per-column agreement; missing equals missing. One join, one aggregation."""
    keys = list(keys)
    assert_unique(actual, keys, "actual table")
    assert_unique(expected, keys, "expected table")
    kinds = dict(actual.dtypes)
    left = actual.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    right = expected.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    both = left.join(right, keys, "full")
    tests = [
        F.count("_in_a").alias("rows"), F.count("_in_b").alias("expected_rows"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("unmatched"),
    ]
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        tests.append(F.count_if(~a.eqNullSafe(b)).alias(f"x_{c}"))
        if kinds[c] in NUMERIC:
            gap = F.abs(a.cast("double") - b.cast("double"))
            tests += [F.max(gap).alias(f"d_{c}"), F.count_if(~a.eqNullSafe(b) & ~F.coalesce(gap <= tolerance, F.lit(False))).alias(f"f_{c}")]
    row = both.agg(*tests).first().asDict()
    result = {"rows": row["rows"], "expected_rows": row["expected_rows"], "keys_match": row["unmatched"] == 0, "columns": {}}
    for c in columns:
        entry = {"exactly_equal": row[f"x_{c}"] == 0, "passed": row[f"x_{c}"] == 0}
        if kinds[c] in NUMERIC:
            entry = {"exactly_equal": row[f"x_{c}"] == 0, "max_absolute_difference": row[f"d_{c}"], "passed": row[f"f_{c}"] == 0}
        entry["passed"] = entry["passed"] and result["keys_match"]
        result["columns"][c] = entry
    result["passed"] = result["keys_match"] and all(e["passed"] for e in result["columns"].values())
    return result
