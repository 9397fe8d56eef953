"""Summary blocks, angular statistics and identifier text."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MaxAbsScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text
from ..operators import stats
from ..operators import modeling as ML
from ..operators.modeling import classification_report, feature_summary
from ..session import materialize, shared_path
from ..sources import schemas
from ..sources.tables import read_fps_by_video
from ..sources.writers import read_bundle, read_manifest, write_bundle, write_csv, write_manifest
from .views import SERIES_SQL, series, table


def _r(df, keys, columns, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in columns])


def eight_stats(spark, sf):
    s = series(spark, sf).select("cat", "v")
    return _r(stats.eight_stats(s, ["cat"], "v"), ["cat"], ["mean", "median", "std", "min", "max", "range", "q25", "q75"])


def distribution_stats(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    out = stats.distribution(li, ["l_returnflag"], "l_extendedprice")
    return _r(out, ["l_returnflag", "n"], ["median", "q1", "q3", "mean", "sd", "minimum", "maximum"], 4)


def cv_summary(spark, sf):
    """Per nation; account balances take both signs, so the sign of the CV matters."""
    c = table(spark, sf, "customer").select("c_nationkey", "c_acctbal")
    out = stats.summarize(c, ["c_nationkey"], "c_acctbal")
    return _r(out, ["c_nationkey", "n"], ["mean", "sd", "cv", "q1", "median", "q3", "min", "max"], 4)


def two_level_p90(spark, sf):
    """Median price per order, then the 0.90 quantile over orders per return flag."""
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_extendedprice")
    med = materialize(stats.exact_quantiles(li, ["l_returnflag", "l_orderkey"], F.col("l_extendedprice"), {"med": 0.5}))
    return _r(stats.exact_quantiles(med, ["l_returnflag"], F.col("med"), {"p90": 0.9}), ["l_returnflag"], ["p90"], 4)


def circular_stats(spark, sf):
    s = series(spark, sf).select("cat", (F.col("v") * 1.7 - 60).alias("deg"))
    out = stats.circular_summary(s, ["cat"], "deg")
    names = ("signed_circular_mean_deg", "circular_sd_deg", "mean_resultant_length_R", "median_absolute_deviation_deg", "q1_absolute_deviation_deg", "q3_absolute_deviation_deg")
    return _r(out, ["cat", "n"], names, 5)


def signed_angle(spark, sf):
    """Signed angle and cosine between (v, k) and (k, v - 50) vectors."""
    s = series(spark, sf)
    a, b = [F.col("v"), F.col("k").cast("double")], [F.col("k").cast("double"), F.col("v") - 50]
    return s.select("entity", "pos", F.round(S.signed_angle(a, b), 5).alias("angle"), F.round(S.cosine(a, b), 6).alias("cosine"))


def missingness(spark, sf):
    """Missing shares per series: value missing, both of value and low counter, any of them."""
    s = series(spark, sf).withColumn("y", F.when(F.col("k") >= 20, F.col("k")))
    lost = lambda c: F.col(c).isNull().cast("int")
    return s.groupBy("entity").agg(
        F.round(F.avg((lost("x") + lost("y")) / 2), 6).alias("cell_missing_ratio"),
        F.round(F.avg(F.greatest(lost("x"), lost("y"))), 6).alias("row_any_missing_ratio"),
        F.round(F.avg(F.least(lost("x"), lost("y"))), 6).alias("row_all_missing_ratio"),
    )


def class_balance(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def report(spark, sf):
    """Classification report of a price threshold as predictor of finished orders."""
    o = table(spark, sf, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("label"), (F.col("o_totalprice") >= 250000).cast("int").alias("prediction"))
    return _r(classification_report(o), ["class"], ["precision", "recall", "f1"]).join(classification_report(o).select("class", "support"), "class")


def summary_before_scaling(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    out = feature_summary(table(spark, sf, "lineitem").select(*columns), columns)
    return _r(out, ["Feature", "Missing_Count"], ["Mean_before_scaling", "Std_before_scaling"], 5)


def union_models(spark, sf):
    """Three silhouettes-like tables united, ranked within setting, best three kept."""
    from ..operators.modeling import top_models

    c = table(spark, sf, "customer")
    parts = None
    for setting, value in (("Raw", F.avg("c_acctbal")), ("PCA90", F.max("c_acctbal")), ("PCA95", F.min("c_acctbal"))):
        part = c.groupBy(F.col("c_nationkey").alias("K")).agg(F.round(value, 4).alias("Silhouette_Score")).withColumn("Feature_Setting", F.lit(setting))
        parts = part if parts is None else parts.unionByName(part)
    return top_models(parts)


def id_normalise(spark, sf):
    """Names built from the tables and folded by each of the id rules."""
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id")
    raw = F.when(F.col("event_type") == "click", F.concat(F.lit("/data/v/"), "user_id", F.lit(".mp4")))
    raw = raw.when(F.col("event_type") == "view", F.concat("user_id", F.lit("_trajectory.csv")))
    raw = raw.when(F.col("event_type") == "error", F.concat(F.lit(" "), "user_id", F.lit(".0 ")))
    raw = raw.when(F.col("event_type") == "signup", F.concat(F.lit("Cam_"), "user_id", F.lit("_segments.csv"))).otherwise(F.concat(F.lit("Room.A"), "user_id", F.lit(".MOV")))
    n = e.withColumn("raw", raw)
    return n.select(
        "event_id", text.video_name(F.col("raw")).alias("stem"), text.boundary_video_id(F.col("raw")).alias("boundary_id"),
        text.plain_video_id(F.col("raw"), text.SEGMENT_SOURCE_SUFFIXES).alias("segment_source_id"),
        text.plain_video_id(F.col("raw"), text.CYCLE_TABLE_SUFFIXES).alias("cycle_id"),
    )


def duration_text(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 37).alias("s"))
    return o.select("o_orderkey", text.minutes_seconds(F.col("s")).alias("ms"), text.hours_minutes_seconds(F.col("s")).alias("hms"), text.key_video(text.cycle_key(F.col("o_orderkey"), F.lit(3))).alias("video"))


_RAW = """n AS (SELECT event_id, user_id AS u, event_type AS t FROM events)"""
def fill_mean(spark, sf):
    """Missing values of the series replaced by the mean of all."""
    return _r(ML.fill_with_mean(series(spark, sf).select("entity", "pos", "x"), ["x"]), ["entity", "pos"], ["x"])


def fill_median(spark, sf):
    """Missing values of the series and of high counters replaced by the columns' medians."""
    s = series(spark, sf).select("entity", "pos", "x", F.when(F.col("k") < 60, F.col("k").cast("double")).alias("y"))
    return _r(ML.fill_with_median(s, ["x", "y"]), ["entity", "pos"], ["x", "y"])


def feature_columns(spark, sf):
    """Which columns of a line item count as features, with their values: no keys, no text, nothing named like a tax."""
    li = table(spark, sf, "lineitem")
    names = schemas.feature_columns(li, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ["tax"])
    counts = F.array(*[F.struct(F.lit(n).alias("feature"), F.count(n).alias("n")) for n in names])
    return li.agg(counts.alias("c")).select(F.explode("c").alias("r")).select("r.*")


def rates_round_trip(spark, sf):
    """Sampling rates written as headed CSV in the shared folder and read again by their header."""
    rates = series(spark, sf).groupBy("entity").agg(F.count_if(F.col("cat") == "purchase").alias("n"))
    path = shared_path(spark, "rates")
    write_csv(rates.select((F.col("n") + 0.5).alias("FPS"), F.concat("entity", F.lit(".mp4")).alias("Video")), path)
    return read_fps_by_video(spark, path)


def manifest_round_trip(spark, sf):
    """Totals per event type written as a manifest in the shared folder, twice, and read again."""
    path = f"{shared_path(spark, 'manifest')}/totals.json"
    totals = {r["cat"]: r["count"] for r in series(spark, sf).groupBy("cat").count().collect()}
    write_manifest({"totals": {}, "note": "to be replaced"}, path)
    write_manifest({"totals": totals, "note": "événements"}, path)
    found = read_manifest(path)
    return spark.createDataFrame([(k, v, found["note"]) for k, v in found["totals"].items()], "cat string, n bigint, note string")


def bundle_round_trip(spark, sf):
    """A fitted scaler with its feature list and settings, saved, loaded from the shared folder and applied."""
    data = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"))
    names = ["l_quantity", "l_discount"]
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_v"), MaxAbsScaler(inputCol="_v", outputCol="_scaled")]).fit(data)
    path = shared_path(spark, "bundle")
    write_bundle(model, path, names, window_sec=2.0)
    loaded, document = read_bundle(path, PipelineModel.load)
    values = vector_to_array("_scaled")
    scaled = loaded.transform(data.select("l_returnflag", *document["features"]))
    return scaled.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), *[F.round(F.avg(values[i]), 6).alias(f"mean_{c}") for i, c in enumerate(document["features"])],
        F.lit(document["window_sec"]).alias("window_sec"),
    )


QUERIES = {
    "manifest_round_trip": manifest_round_trip, "bundle_round_trip": bundle_round_trip,
    "fill_mean": fill_mean, "fill_median": fill_median, "feature_columns": feature_columns, "rates_round_trip": rates_round_trip,
    "eight_stats": eight_stats, "distribution_stats": distribution_stats, "cv_summary": cv_summary, "two_level_p90": two_level_p90,
    "circular_stats": circular_stats, "signed_angle": signed_angle, "missingness": missingness, "class_balance": class_balance,
    "classification_report": report, "feature_summary": summary_before_scaling, "union_models": union_models,
    "id_normalise": id_normalise, "duration_text": duration_text,
}

ORACLES = {
    "manifest_round_trip": "SELECT event_type AS cat, count(*) AS n, 'événements' AS note FROM events GROUP BY 1",
    "bundle_round_trip": """SELECT l_returnflag, count(*) AS n, round(avg(l_quantity::DOUBLE / (SELECT max(abs(l_quantity))::DOUBLE FROM lineitem)), 6) AS mean_l_quantity,
        round(avg(l_discount::DOUBLE / (SELECT max(abs(l_discount))::DOUBLE FROM lineitem)), 6) AS mean_l_discount, 2.0::DOUBLE AS window_sec FROM lineitem GROUP BY 1""",
    "fill_mean": f"WITH {SERIES_SQL} SELECT entity, pos, round(coalesce(x, avg(x) OVER ()), 6) AS x FROM series",
    "fill_median": f"""WITH {SERIES_SQL}, y AS (SELECT entity, pos, x, CASE WHEN k < 60 THEN CAST(k AS DOUBLE) END AS y FROM series), m AS (SELECT median(x) AS mx, median(y) AS my FROM y)
        SELECT entity, pos, round(coalesce(x, mx), 6) AS x, round(coalesce(y, my), 6) AS y FROM y, m""",
    "feature_columns": """SELECT feature, n FROM (SELECT count(l_quantity) AS l_quantity, count(l_extendedprice) AS l_extendedprice, count(l_discount) AS l_discount FROM lineitem)
        UNPIVOT (n FOR feature IN (l_quantity, l_extendedprice, l_discount))""",
    "rates_round_trip": f"""WITH {SERIES_SQL} SELECT CAST(entity AS VARCHAR) AS video_id, CAST(count(*) FILTER (cat = 'purchase') + 0.5 AS DOUBLE) AS fps FROM series GROUP BY 1""",
    "eight_stats": f"""WITH {SERIES_SQL} SELECT cat, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min,
        round(max(v), 6) AS max, round(max(v) - min(v), 6) AS "range", round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75 FROM series GROUP BY cat""",
    "distribution_stats": """SELECT l_returnflag, count(*) AS n, round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
        round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd,
        min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum FROM lineitem GROUP BY 1""",
    "cv_summary": """SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd,
        round(stddev_samp(c_acctbal) / avg(c_acctbal), 4) AS cv, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS median,
        round(quantile_cont(c_acctbal, 0.75), 4) AS q3, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY 1""",
    "two_level_p90": """WITH m AS (SELECT l_returnflag, l_orderkey, median(l_extendedprice) AS med FROM lineitem GROUP BY 1, 2)
        SELECT l_returnflag, round(quantile_cont(med, 0.9), 4) AS p90 FROM m GROUP BY 1""",
    "circular_stats": f"""WITH {SERIES_SQL}, d AS (SELECT cat, v * 1.7::DOUBLE - 60 AS deg FROM series),
        a AS (SELECT *, abs((deg + 180) - floor((deg + 180) / 360) * 360 - 180) AS ad FROM d),
        g AS (SELECT cat, count(*) AS n, avg(sin(radians(deg))) AS s, avg(cos(radians(deg))) AS c, median(ad) AS m, quantile_cont(ad, 0.25) AS q1, quantile_cont(ad, 0.75) AS q3 FROM a GROUP BY cat)
        SELECT cat, n, round(degrees(atan2(s, c)), 5) AS signed_circular_mean_deg, round(degrees(sqrt(-2 * ln(sqrt(s*s + c*c)))), 5) AS circular_sd_deg,
        round(sqrt(s*s + c*c), 5) AS "mean_resultant_length_R", round(m, 5) AS median_absolute_deviation_deg, round(q1, 5) AS q1_absolute_deviation_deg, round(q3, 5) AS q3_absolute_deviation_deg FROM g""",
    "signed_angle": f"""WITH {SERIES_SQL}, d AS (SELECT entity, pos, v AS ax, k AS ay, k AS bx, v - 50 AS "by" FROM series)
        SELECT entity, pos, round(degrees(atan2(ax * "by" - ay * bx, ax * bx + ay * "by")), 5) AS angle,
        round(greatest(-1.0, least(1.0, (ax * bx + ay * "by") / nullif(sqrt(ax*ax + ay*ay) * sqrt(bx*bx + "by"*"by"), 0))), 6) AS cosine FROM d""",
    "missingness": f"""WITH {SERIES_SQL}, d AS (SELECT entity, CAST(x IS NULL AS INT) AS a, CAST(k < 20 AS INT) AS b FROM series)
        SELECT entity, round(avg((a + b) / 2), 6) AS cell_missing_ratio, round(avg(greatest(a, b)), 6) AS row_any_missing_ratio, round(avg(least(a, b)), 6) AS row_all_missing_ratio FROM d GROUP BY entity""",
    "class_balance": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "classification_report": """WITH d AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, CAST(o_totalprice >= 250000 AS INTEGER) AS p FROM orders),
        c AS (SELECT k AS class, count(*) FILTER (y = k AND p = k) AS h, count(*) FILTER (p = k) AS np, count(*) FILTER (y = k) AS ny FROM d, (VALUES (0), (1)) t(k) GROUP BY k)
        SELECT class, round(h / np, 6) AS precision, round(h / ny, 6) AS recall, round(2 * (h / np) * (h / ny) / (h / np + h / ny), 6) AS f1, ny AS support FROM c""",
    "feature_summary": " UNION ALL ".join(
        f"SELECT '{c}' AS \"Feature\", count(*) - count({c}) AS \"Missing_Count\", round(avg({c}), 5) AS \"Mean_before_scaling\", round(stddev_samp({c}), 5) AS \"Std_before_scaling\" FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "union_models": """WITH u AS (SELECT 'Raw' AS s, c_nationkey AS k, round(avg(c_acctbal), 4) AS v FROM customer GROUP BY 2 UNION ALL
        SELECT 'PCA90', c_nationkey, round(max(c_acctbal), 4) FROM customer GROUP BY 2 UNION ALL SELECT 'PCA95', c_nationkey, round(min(c_acctbal), 4) FROM customer GROUP BY 2)
        SELECT s AS "Feature_Setting", k AS "K", v AS "Silhouette_Score" FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY v DESC, k) AS r FROM u) WHERE r <= 3""",
    "id_normalise": f"""WITH {_RAW} SELECT event_id,
        CASE WHEN t IN ('click', 'view', 'error') THEN CAST(u AS VARCHAR) WHEN t = 'signup' THEN 'cam_' || u || '_segments' ELSE 'room.a' || u END AS stem,
        CASE WHEN t IN ('click', 'view', 'error') THEN CAST(u AS VARCHAR) WHEN t = 'signup' THEN 'Cam_' || u || '_segments' ELSE 'Room.A' || u END AS boundary_id,
        CASE WHEN t IN ('click', 'view', 'error') THEN CAST(u AS VARCHAR) WHEN t = 'signup' THEN 'Cam_' || u || '_segments.csv' ELSE 'Room.A' || u || '.MOV' END AS segment_source_id,
        CASE WHEN t IN ('click', 'view', 'error') THEN CAST(u AS VARCHAR) WHEN t = 'signup' THEN 'Cam_' || u ELSE 'Room.A' || u || '.MOV' END AS cycle_id FROM n""",
    "duration_text": """WITH d AS (SELECT o_orderkey, CAST(floor(o_totalprice / 37) AS BIGINT) AS s FROM orders)
        SELECT o_orderkey, (s // 60) || 'm ' || (s % 60) || 's' AS ms,
        CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS hms,
        CAST(o_orderkey AS VARCHAR) AS video FROM d""",
}
