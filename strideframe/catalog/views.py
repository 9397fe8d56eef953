"""Domain views over the driver tables: what plays a series, a cycle, an episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import BLOCK_ROWS, bucket_width, micros, number_rows

CYCLE_LEN = 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def raw_series(spark: SparkSession, sf: str) -> DataFrame:
    """One series per user in time order; ``x`` is missing on error events."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("entity"),
        "ts",
        micros("ts").alias("t"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("x"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.col("event_type").alias("cat"),
    )


#: Bucket widths by application and folder: a width only sets how work is split, never what comes out.
_WIDTHS: dict[tuple[str, str], int] = {}


def series(spark: SparkSession, sf: str) -> DataFrame:
    """``raw_series`` with the dense row position ``pos`` per entity."""
    raw = raw_series(spark, sf)
    place = spark.sparkContext.applicationId, sf
    if place not in _WIDTHS:
        _WIDTHS[place] = bucket_width(raw, ["entity"], F.col("t"), BLOCK_ROWS)
    width = _WIDTHS[place]
    return number_rows(raw, ["entity"], ["t"], F.floor(F.col("t") / F.lit(width)))


SERIES_SQL = """series AS (
  SELECT user_id AS entity, epoch_us(ts) AS t,
         CASE WHEN event_type <> 'error' THEN value END AS x, value AS v,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS cat,
         row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos
  FROM events)"""


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Each series row as a motion segment of 1 to 9 frames with one of three clusters."""
    return series(spark, sf).select(
        F.col("entity").cast("string").alias("Video"), F.col("pos").alias("Start_Frame"),
        (F.col("pos") + F.col("k") % 9).alias("End_Frame"), (F.col("k") % 3 + 1).cast("int").alias("Cluster"),
    )


def cycle_table(spark: SparkSession, sf: str) -> DataFrame:
    """Cycles over each series: every 20 rows, the first three rows left out."""
    per = series(spark, sf).groupBy("entity", F.expr(f"pos div {CYCLE_LEN}").alias("c")).agg(F.max("pos").alias("last"))
    return per.select(
        F.col("entity").cast("string").alias("Video"), (F.col("c") * CYCLE_LEN + 3).alias("Start_Frame"),
        (F.col("last") + 1).alias("End_Frame"), F.lit(20.0).alias("FPS"), F.col("c").alias("Work_Cycle_ID"),
    ).where("End_Frame > Start_Frame")


def manual_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Signup events stand for manually annotated frames."""
    return series(spark, sf).where("cat = 'signup'").select("entity", F.col("pos").alias("frame"))


SEGMENTS_SQL = """segments AS (SELECT CAST(entity AS VARCHAR) AS video, pos AS s, pos + k % 9 AS e,
    (pos + pos + k % 9) / 2.0 AS mid, CAST(k % 3 + 1 AS INTEGER) AS cluster FROM series)"""
CYCLES_SQL = """cyc0 AS (SELECT entity, pos // 20 AS c, max(pos) AS last FROM series GROUP BY 1, 2),
  cyc AS (SELECT CAST(entity AS VARCHAR) AS video, c, c * 20 + 3 AS cs, last + 1 AS ce,
    row_number() OVER (PARTITION BY entity ORDER BY c) AS num FROM cyc0 WHERE last + 1 > c * 20 + 3),
  mapped AS (SELECT segments.*, cyc.c, cyc.cs, cyc.ce, cyc.num, (cyc.ce - cyc.cs) / 20.0 AS dur
    FROM segments JOIN cyc ON segments.video = cyc.video AND mid >= cs AND mid < ce)"""


def episodes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as episodes of a customer: start, end (last shipment, microseconds) and a status flag."""
    ends = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(micros("l_shipdate")).alias("end"))
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("id"),
        micros("o_orderdate").alias("start"), F.col("o_orderstatus").alias("status"),
    )
    return orders.join(ends, orders.id == ends.l_orderkey).drop("l_orderkey").withColumn(
        "flag", F.col("status") != "P"
    )


EPISODES_SQL = """ends AS (SELECT l_orderkey, max(epoch_us(l_shipdate)) AS "end" FROM lineitem GROUP BY 1),
  episodes AS (SELECT o_custkey AS parent, o_orderkey AS id, epoch_us(o_orderdate) AS "start", "end",
    o_orderstatus AS status, o_orderstatus <> 'P' AS flag FROM orders JOIN ends ON o_orderkey = l_orderkey)"""
