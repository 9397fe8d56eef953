"""Cycle mapping, composition and interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators.blocks import first_rows
from ..plans import cycles
from .views import (
    CYCLES_SQL, EPISODES_SQL, SEGMENTS_SQL, SERIES_SQL, cycle_table, episodes, segments, series, table,
)

DAY_US = 86_400_000_000


def _mapped(spark, sf):
    seg = cycles.standard_segments(segments(spark, sf))
    return cycles.map_segments(seg, cycles.standard_cycles(cycle_table(spark, sf)))


def interval_map(spark, sf):
    return _mapped(spark, sf).select(
        "Video_ID", "Segment_Start_Frame", "Segment_Center_Frame", "Cluster", "Cycle_Number_In_Video", "Cycle_ID",
        *[F.round(c, 6).alias(c) for c in ("Relative_Center_sec", "Relative_Center_Percent", "Relative_End_Percent_Clipped")],
    )


def interval_global_index(spark, sf):
    out = cycles.number_filled_cycles(_mapped(spark, sf))
    return out.select("Video_ID", "Cycle_Number_In_Video", "Cycle_Index_Global").distinct()


def interval_global_index_text(spark, sf):
    """The same index where ids are words: videos in text order, some of them numeric and therefore first."""
    named = F.when(F.col("Video_ID").cast("bigint") % 3 > 0, F.concat(F.lit("take "), "Video_ID")).otherwise(F.col("Video_ID"))
    out = cycles.number_filled_cycles(_mapped(spark, sf).withColumn("Video_ID", named))
    return out.select("Video_ID", "Cycle_Number_In_Video", "Cycle_Index_Global").distinct()


def interval_composition(spark, sf):
    out = cycles.cycle_composition(_mapped(spark, sf))
    return out.select(
        "Video_ID", "Cycle_Number_In_Video", "Cycle_ID", "Cluster", "Segment_Count", "Cycle_Total_Segments",
        F.round("Percentage", 6).alias("Percentage"), "Cluster_Name",
    )


def composition_wide(spark, sf):
    out = cycles.composition_wide(cycles.cycle_composition(_mapped(spark, sf)), [1, 2, 3])
    return out.select("Video_ID", "Cycle_Number_In_Video", *[F.round(f"Cluster_{c}_Percent", 6).alias(f"Cluster_{c}_Percent") for c in (1, 2, 3)])


def timeline_bins(spark, sf):
    out = cycles.timeline_distribution(_mapped(spark, sf))
    return out.withColumn("Percentage", F.round("Percentage", 6))


def cluster_sizes(spark, sf):
    out = cycles.cluster_distribution(_mapped(spark, sf))
    return out.withColumn("Percentage", F.round("Percentage", 6))


def lag_gaps(spark, sf):
    """Gaps between consecutive flagged episodes of a customer, in days."""
    e = episodes(spark, sf).withColumn("order", F.struct("start", "id"))
    out = iv.adjacent_gaps(e, ["parent"], "start", "end", "flag", order="order", block=F.floor(F.col("start") / (30 * DAY_US)))
    return out.select("parent", "id", F.round(F.col("gap") / DAY_US, 6).alias("gap_days"))


def attempt_count(spark, sf):
    e = episodes(spark, sf).withColumn("order", F.struct("start", "id"))
    return iv.attempt_count(e, ["parent"], "start", "end", order="order", block=F.floor(F.col("start") / (30 * DAY_US)))


def union_intervals(spark, sf):
    e = episodes(spark, sf).withColumn("order", F.struct("start", "id"))
    out = iv.union_groups(e, ["parent"], "start", "end", order="order", block=F.floor(F.col("start") / (30 * DAY_US)))
    return out.groupBy("parent", "group").agg(
        F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.count("*").alias("members")
    )


def event_linkage_first(spark, sf):
    """Order totals of each nation's customers linked to the first episode of the same customer holding them."""
    e = episodes(spark, sf)
    events = e.select("parent", F.col("id").alias("event"), (F.col("end") - 3 * DAY_US).alias("at"))
    out = iv.first_match(
        events, ["event"], e, ["parent"], at="at", start="start", end="end", order=["start", "id"],
        carried=["id", "flag"],
    )
    return out.select("event", "linked", F.col("id").alias("action"), F.coalesce("flag", F.lit(False)).alias("bilateral"))


def event_linkage_counts(spark, sf):
    linked = event_linkage_first(spark, sf)
    return linked.agg(
        F.count("*").alias("events"), F.count_if("linked").alias("linked"),
        F.count_if(~F.col("linked")).alias("outside"), F.count_if("bilateral").alias("linked_bilateral"),
    )


def nearest_boundary(spark, sf):
    """Nearest purchase row for every signup row of the same series, with the signed error."""
    s = series(spark, sf)
    left = s.where("cat = 'signup'").select("entity", "pos")
    right = s.where("cat = 'purchase'").select("entity", "pos")
    out = iv.nearest(left, right, ["entity"], "pos", block=F.expr("pos div 65536")).where("nearest IS NOT NULL")
    return out.withColumn("error", F.col("nearest") - F.col("pos"))


def nearest_error_summary(spark, sf):
    from ..operators.stats import exact_quantiles

    out = nearest_boundary(spark, sf).withColumn("abs_error", F.abs("error"))
    base = out.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.avg("abs_error"), 6).alias("mean_abs_error"))
    return base.join(exact_quantiles(out, ["entity"], F.col("abs_error"), {"median_abs_error": 0.5}), "entity")


def distinct_first(spark, sf):
    """First line per order and day (a total order breaks ties)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    return first_rows(li, ["l_orderkey", "l_shipdate"], order).select("l_orderkey", "l_shipdate", "l_partkey", "l_extendedprice")


def top3_per_group(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return s.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3")


def nms_peaks(spark, sf):
    """Greedy selection of high values at least five rows apart."""
    peaks = series(spark, sf).where("v > 60").select("entity", "pos", "v", F.lit(5).cast("bigint").alias("gap"))
    out = iv.suppress_neighbours(peaks, ["entity"], "pos", "v", "gap")
    return out.select("entity", "pos", "v")


def merge_no_return(spark, sf):
    """Runs of rising value merged over short gaps that never fall back."""
    from ..operators import series as seq

    s = series(spark, sf).select("entity", "pos", "v", "k", "x")
    up = seq.with_halo(s, 1)
    w = seq.halo_window(["entity"])
    rising = seq.own_rows(up.withColumn("up", F.coalesce(F.col("v") > F.lag("v").over(w), F.lit(False))))
    runs = seq.true_runs(rising, ["entity"], F.col("up"))
    out = iv.merge_without_return(
        runs, s, ["entity"], ["v", "x"], max_gap=F.lit(2), tolerance=30.0, block=F.expr("start div 65536")
    )
    return out.select("entity", "candidate_index", "start", "end", "raw_core_count", "source_raw_candidate_indices")


_MAP = f"WITH {SERIES_SQL}, {SEGMENTS_SQL}, {CYCLES_SQL}"
_EP = f"WITH {EPISODES_SQL}"
_GROUPED = _EP + """, r AS (SELECT *, max("end") OVER (PARTITION BY parent ORDER BY "start", id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM episodes WHERE "end" >= "start"),
  o AS (SELECT *, CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END AS opens FROM r)"""
_LINK = _EP + f""", ev AS (SELECT parent, id AS event, "end" - {3 * DAY_US} AS at FROM episodes),
  hit AS (SELECT ev.event, e.id, e.flag, row_number() OVER (PARTITION BY ev.event ORDER BY e."start", e.id) AS r
    FROM ev JOIN episodes e ON e.parent = ev.parent AND e."start" <= ev.at AND ev.at <= e."end"),
  linked AS (SELECT ev.event, hit.id IS NOT NULL AS linked, hit.id AS action, coalesce(hit.flag, false) AS bilateral
    FROM ev LEFT JOIN hit ON hit.event = ev.event AND hit.r = 1)"""
_NEAR = f"""WITH {SERIES_SQL}, near AS (SELECT a.entity, a.pos, b.pos AS nearest, b.pos - a.pos AS error,
    row_number() OVER (PARTITION BY a.entity, a.pos ORDER BY abs(b.pos - a.pos), b.pos) AS r
    FROM series a JOIN series b ON a.entity = b.entity AND a.cat = 'signup' AND b.cat = 'purchase')"""

QUERIES = {
    "interval_map": interval_map,
    "interval_global_index": interval_global_index, "interval_global_index_text": interval_global_index_text,
    "interval_composition": interval_composition,
    "composition_wide": composition_wide,
    "timeline_bins": timeline_bins,
    "cluster_sizes": cluster_sizes,
    "lag_gaps": lag_gaps,
    "attempt_count": attempt_count,
    "union_intervals": union_intervals,
    "event_linkage_first": event_linkage_first,
    "event_linkage_counts": event_linkage_counts,
    "nearest_boundary": nearest_boundary,
    "nearest_error_summary": nearest_error_summary,
    "distinct_first": distinct_first,
    "top3_per_group": top3_per_group,
    "nms_peaks": nms_peaks,
    "merge_no_return": merge_no_return,
}

def greedy_sql(source: str, key: str, frame: str, score: str, gap: str) -> str:
    """Recursive CTEs ``ranked`` and ``picked``: strongest first, each kept unless a kept one is nearer than the gap."""
    return f"""ranked AS (SELECT {key}, {frame} AS f, {gap} AS g, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, {frame}) AS r FROM {source}),
  picked AS (SELECT {key}, r, [f] AS kept FROM ranked WHERE r = 1
    UNION ALL SELECT ranked.{key}, ranked.r, CASE WHEN len(list_filter(picked.kept, lambda k: abs(k - ranked.f) < ranked.g)) > 0
      THEN picked.kept ELSE list_append(picked.kept, ranked.f) END
    FROM picked JOIN ranked ON ranked.{key} = picked.{key} AND ranked.r = picked.r + 1)"""


ORACLES = {
    "nms_peaks": f"""WITH RECURSIVE {SERIES_SQL}, high AS (SELECT entity, pos, v FROM series WHERE v > 60),
        {greedy_sql("high", "entity", "pos", "v", "5")},
        chosen AS (SELECT entity, unnest(arg_max(kept, r)) AS pos FROM picked GROUP BY entity)
        SELECT chosen.entity, chosen.pos, high.v FROM chosen JOIN high ON high.entity = chosen.entity AND high.pos = chosen.pos""",
    "interval_map": _MAP + """ SELECT video AS "Video_ID", CAST(s AS DOUBLE) AS "Segment_Start_Frame",
        mid AS "Segment_Center_Frame", cluster AS "Cluster", num AS "Cycle_Number_In_Video", CAST(c AS VARCHAR) AS "Cycle_ID",
        round((mid - cs) / 20.0, 6) AS "Relative_Center_sec", round((mid - cs) / (ce - cs) * 100, 6) AS "Relative_Center_Percent",
        round(least(100.0, greatest(0.0, (e - cs) / (ce - cs) * 100)), 6) AS "Relative_End_Percent_Clipped" FROM mapped""",
    "interval_global_index": _MAP + """, f AS (SELECT DISTINCT video, num FROM mapped)
        SELECT video AS "Video_ID", num AS "Cycle_Number_In_Video",
        row_number() OVER (ORDER BY CAST(video AS BIGINT), num) AS "Cycle_Index_Global" FROM f""",
    "interval_global_index_text": _MAP + """, f AS (SELECT DISTINCT video, CASE WHEN CAST(video AS BIGINT) % 3 > 0 THEN 'take ' || video ELSE video END AS name, num FROM mapped)
        SELECT name AS "Video_ID", num AS "Cycle_Number_In_Video",
        row_number() OVER (ORDER BY try_cast(name AS BIGINT) NULLS LAST, name, num) AS "Cycle_Index_Global" FROM f""",
    "interval_composition": _MAP + """ SELECT video AS "Video_ID", num AS "Cycle_Number_In_Video", CAST(c AS VARCHAR) AS "Cycle_ID",
        cluster AS "Cluster", count(*) AS "Segment_Count",
        CAST(sum(count(*)) OVER (PARTITION BY video, num) AS BIGINT) AS "Cycle_Total_Segments",
        round(count(*) / sum(count(*)) OVER (PARTITION BY video, num) * 100, 6) AS "Percentage",
        'Cluster ' || cluster AS "Cluster_Name" FROM mapped GROUP BY video, num, c, cluster""",
    "composition_wide": _MAP + """ SELECT video AS "Video_ID", num AS "Cycle_Number_In_Video",
        round(count(*) FILTER (cluster = 1) / count(*) * 100, 6) AS "Cluster_1_Percent",
        round(count(*) FILTER (cluster = 2) / count(*) * 100, 6) AS "Cluster_2_Percent",
        round(count(*) FILTER (cluster = 3) / count(*) * 100, 6) AS "Cluster_3_Percent" FROM mapped GROUP BY video, num""",
    "timeline_bins": _MAP + """, p AS (SELECT cluster, (mid - cs) / (ce - cs) * 100 AS pc FROM mapped),
        b AS (SELECT CAST(floor(pc / 5) AS INTEGER) AS bin, cluster FROM p WHERE pc >= 0 AND pc < 100),
        t AS (SELECT bin, count(*) AS total FROM b GROUP BY bin),
        g AS (SELECT bin, cluster FROM t CROSS JOIN (SELECT DISTINCT cluster FROM mapped) c),
        n AS (SELECT bin, cluster, count(*) AS n FROM b GROUP BY 1, 2)
        SELECT g.bin, g.cluster AS "Cluster", coalesce(n.n, 0) AS "Segment_Count", t.total AS "Bin_Total",
        round(coalesce(n.n, 0) / t.total * 100, 6) AS "Percentage", 'Cluster ' || g.cluster AS "Cluster_Name",
        '[' || (g.bin * 5) || ', ' || (g.bin * 5 + 5) || ')' AS "Bin_Label", CAST(g.bin * 5 + 2.5 AS DOUBLE) AS "Bin_Center_Percent"
        FROM g JOIN t USING (bin) LEFT JOIN n ON n.bin = g.bin AND n.cluster = g.cluster""",
    "cluster_sizes": _MAP + """ SELECT cluster AS "Cluster", count(*) AS "Segment_Count",
        round(count(*) / sum(count(*)) OVER () * 100, 6) AS "Percentage", 'Cluster ' || cluster AS "Cluster_Name"
        FROM mapped GROUP BY cluster""",
    "lag_gaps": _EP + f""", l AS (SELECT *, lag("end") OVER w AS pe, lag(flag) OVER w AS pf FROM episodes
        WINDOW w AS (PARTITION BY parent ORDER BY "start", id))
        SELECT parent, id, round(("start" - pe) / {DAY_US}.0, 6) AS gap_days FROM l WHERE flag AND pf AND pe IS NOT NULL""",
    "attempt_count": _GROUPED + " SELECT parent, CAST(sum(opens) AS BIGINT) AS attempts FROM o GROUP BY parent",
    "union_intervals": _GROUPED + """, g AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY parent ORDER BY "start", id) AS BIGINT) AS grp FROM o)
        SELECT parent, grp AS "group", min("start") AS span_start, max("end") AS span_end, count(*) AS members FROM g GROUP BY parent, grp""",
    "event_linkage_first": _LINK + " SELECT * FROM linked",
    "event_linkage_counts": _LINK + """ SELECT count(*) AS events, count(*) FILTER (linked) AS linked,
        count(*) FILTER (NOT linked) AS outside, count(*) FILTER (bilateral) AS linked_bilateral FROM linked""",
    "nearest_boundary": _NEAR + " SELECT entity, pos, nearest, error FROM near WHERE r = 1",
    "nearest_error_summary": _NEAR + """ SELECT entity, count(*) AS n, round(avg(abs(error)), 6) AS mean_abs_error,
        median(CAST(abs(error) AS DOUBLE)) AS median_abs_error FROM near WHERE r = 1 GROUP BY entity""",
    "distinct_first": """SELECT l_orderkey, l_shipdate, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (
        PARTITION BY l_orderkey, l_shipdate ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS r FROM lineitem) WHERE r = 1""",
    "top3_per_group": """SELECT s_nationkey, s_suppkey, s_acctbal, "rank" FROM (SELECT s_nationkey, s_suppkey, s_acctbal,
        row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS "rank" FROM supplier) WHERE "rank" <= 3""",
    "merge_no_return": f"""WITH {SERIES_SQL}, u AS (SELECT *, v > lag(v) OVER (PARTITION BY entity ORDER BY pos) AS up FROM series),
        i AS (SELECT *, pos - row_number() OVER (PARTITION BY entity ORDER BY pos) AS g FROM u WHERE up),
        runs AS (SELECT entity, min(pos) AS s, max(pos) AS e FROM i GROUP BY entity, g),
        pr AS (SELECT *, lag(e) OVER (PARTITION BY entity ORDER BY s) AS pe, row_number() OVER (PARTITION BY entity ORDER BY s) AS raw FROM runs),
        br AS (SELECT pr.entity, pr.s, count(*) AS n, count(x) AS nx, min(v) AS mv, min(x) AS mx,
            max(CASE WHEN pos = pe THEN v END) AS v0, max(CASE WHEN pos = pe THEN x END) AS x0
          FROM pr JOIN series ON series.entity = pr.entity AND pos BETWEEN pe AND s WHERE s - pe - 1 <= 2 GROUP BY 1, 2),
        f AS (SELECT pr.*, CASE WHEN br.n = br.nx AND mv - v0 >= -30 AND mx - x0 >= -30 THEN 0 ELSE 1 END AS o
          FROM pr LEFT JOIN br ON br.entity = pr.entity AND br.s = pr.s),
        c AS (SELECT *, CAST(sum(o) OVER (PARTITION BY entity ORDER BY s) AS BIGINT) AS ci FROM f)
        SELECT entity, ci AS candidate_index, min(s) AS "start", max(e) AS "end", count(*) AS raw_core_count,
          string_agg(CAST(raw AS VARCHAR), ';' ORDER BY raw) AS source_raw_candidate_indices FROM c GROUP BY entity, ci""",
}
