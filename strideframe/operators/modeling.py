"""Imputation, scaling, PCA, K-means sweeps, silhouettes and the boundary classifier."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASS_CUT, RANDOM_SEED
from ..session import materialize, spread
from . import clustering as C
from .stats import quantiles_of_columns


# --- filling and scaling -------------------------------------------------------------
def fill_with_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first().asDict()
    return df.fillna({c: m for c, m in means.items() if m is not None})


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians; a column without any value counts as 0."""
    row = quantiles_of_columns(df, [], list(columns), {"m": 0.5}).first()
    return {c: (row[f"{c}_m"] if row is not None and row[f"{c}_m"] is not None else 0.0) for c in columns}


def fill_with_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna(column_medians(df, columns))


def feature_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation and missing count per feature, one pass."""
    stats = F.array(*[
        F.struct(F.lit(c).alias("Feature"), F.avg(c).alias("Mean_before_scaling"), F.stddev_samp(c).alias("Std_before_scaling"),
                 F.count_if(F.col(c).isNull()).alias("Missing_Count"))
        for c in columns
    ])
    return df.agg(stats.alias("_s")).select(F.explode("_s").alias("_r")).select("_r.*")


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero mean and unit population variance; constant columns are only centred."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - row[f"m_{c}"]) / (row[f"s_{c}"] or 1.0) for c in columns})


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])))


# --- principal components --------------------------------------------------------------
def explained_variance(df: DataFrame, features: str = "features") -> tuple[object, list[float]]:
    """Full PCA model and its variance ratios in falling order."""
    width = len(df.select(features).first()[0])
    model = PCA(k=width, inputCol=features, outputCol="_pc").fit(df)
    return model, [float(v) for v in model.explainedVariance]


def components_reaching(ratios: Sequence[float], target: float, strict: bool = False) -> int:
    """Leading components whose cumulative share reaches (strictly exceeds) the target."""
    total = np.cumsum(ratios)
    hit = total > target if strict else total >= target
    return int(np.argmax(hit)) + 1 if hit.any() else len(total)


def variance_table(df: DataFrame, ratios: Sequence[float]) -> DataFrame:
    total = np.cumsum(ratios)
    rows = [(f"PC{i + 1}", float(r), float(c)) for i, (r, c) in enumerate(zip(ratios, total))]
    return df.sparkSession.createDataFrame(rows, "PC string, Explained_Variance_Ratio double, Cumulative_Explained_Variance double")


def project(df: DataFrame, model, components: int, features: str = "features", out: str = "reduced") -> DataFrame:
    """Scores on the leading components (mean removed, as the model does not centre)."""
    mean = df.select(F.posexplode(vector_to_array(features))).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
    centre = F.array(*[F.lit(r["m"]) for r in mean])
    centred = df.withColumn("_x", array_to_vector(F.zip_with(vector_to_array(features), centre, lambda a, b: a - b)))
    scored = model.copy({model.getParam("inputCol"): "_x"}).transform(centred)
    return scored.withColumn(out, array_to_vector(F.slice(vector_to_array("_pc"), 1, components))).drop("_x", "_pc")


def display_scores(df: DataFrame, model, key: str, features: str = "features") -> DataFrame:
    """``key, PC1, PC2``: scores on the two leading components (one component: PC2 is 0)."""
    scored = project(df, model, 2, features, "_two").withColumn("_two", vector_to_array("_two"))
    return scored.select(key, F.get("_two", F.lit(0)).alias("PC1"), F.coalesce(F.get("_two", F.lit(1)), F.lit(0.0)).alias("PC2"))


# --- clustering ----------------------------------------------------------------------
def silhouette_values(df: DataFrame, key: str, features: str, label: str) -> DataFrame:
    """Euclidean silhouette per row ``(key, label, silhouette)``, over all rows."""
    return C.silhouettes(df, key, features, [label]).select(key, F.col("label").alias(label), "silhouette")


def silhouette_score(df: DataFrame, key: str, features: str, label: str) -> float | None:
    """Mean silhouette, None for fewer than two clusters."""
    if df.select(label).distinct().count() < 2:
        return None
    return silhouette_values(df, key, features, label).agg(F.avg("silhouette")).first()[0]


def kmeans_sweep(
    df: DataFrame, key: str, setting: str, ks: Sequence[int], *, n_init: int, max_iter: int = 300,
    seed: int = RANDOM_SEED, features: str = "features",
) -> tuple[DataFrame, DataFrame]:
    """Best model per K: assignments ``(Feature_Setting, K, key, Cluster)`` and one summary row per K.

    Starts and Ks share their passes over the rows, and the silhouettes of all Ks share their distances.
    """
    arrays = materialize(df.select(key, vector_to_array(features).alias("_a")))
    found = C.best_fits(arrays, "_a", ks, n_init=n_init, max_iter=max_iter, seed=seed)
    fits = [found[k] for k in ks]
    labels = [f"k{k}" for k in ks]
    labelled = materialize(C.assign(arrays, key, "_a", fits))
    per_row = C.silhouettes(arrays.join(labelled, key), key, "_a", labels)
    scores = {r["labelling"]: r for r in per_row.groupBy("labelling").agg(F.avg("silhouette").alias("s"), F.countDistinct("label").alias("n")).collect()}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("K"), (F.col(n) + 1).alias("Cluster")) for k, n in zip(ks, labels)])).alias("_r")
    assigned = labelled.select(F.lit(setting).alias("Feature_Setting"), each, key).select("Feature_Setting", "_r.K", key, "_r.Cluster")
    sizes: dict[int, list[int]] = {k: [0] * k for k in ks}
    for r in assigned.groupBy("K", "Cluster").count().collect():
        sizes[r["K"]][r["Cluster"] - 1] = r["count"]
    rows = []
    for fit, name in zip(fits, labels):
        held = scores.get(name)
        score = held["s"] if held is not None and held["n"] > 1 else None
        rows.append((setting, fit.k, score, ",".join(map(str, sizes[fit.k])), sum(sizes[fit.k]), fit.cost))
    summary = df.sparkSession.createDataFrame(
        rows, "Feature_Setting string, K int, Silhouette_Score double, Cluster_Sizes string, N_Segments bigint, Cost double"
    )
    return assigned, summary


def sweep_consistency(df: DataFrame, key: str, ks: Sequence[int], *, n_init: int, features: str = "features") -> DataFrame:
    """What must hold for the best model of every K, measured anew from its centres with column expressions.

    ``nearest``: every row belongs to its nearest centre; ``means``: centres are the means of their rows (as far as the
    last step moves them); ``cost_matches``: the reported cost is the sum of squared distances.
    """
    arrays = materialize(df.select(key, vector_to_array(features).alias("_a")))
    found = C.best_fits(arrays, "_a", ks, n_init=n_init)
    fits = [found[k] for k in ks]
    centres = F.broadcast(C.centre_table(df, fits).groupBy("K").agg(F.array_sort(F.collect_list(F.struct("Cluster", "centre"))).alias("_m")))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("K"), (F.col(f"k{k}") + 1).alias("Cluster")) for k in ks])).alias("_r")
    # Few bytes, but many distances a row: all cores take part, and the distances to a row's centres are made once.
    rows = spread(arrays.join(C.assign(arrays, key, "_a", fits), key), key).select("_a", each).select("_a", "_r.*").join(centres, "K")
    apart = F.transform("_m", lambda m: F.aggregate(F.zip_with("_a", m["centre"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    measured = rows.withColumn("_apart", apart).select("K", "Cluster", "_a", F.element_at("_apart", F.col("Cluster")).alias("_own"), F.array_min("_apart").alias("_least"))
    costs = df.sparkSession.createDataFrame([(f.k, f.cost) for f in fits], "K int, _cost double")
    width = len(fits[0].centres[0])
    means = measured.groupBy("K", "Cluster").agg(F.array(*[F.avg(F.col("_a")[i]) for i in range(width)]).alias("_mean"))
    off = F.aggregate(F.zip_with("_mean", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    moved = means.join(C.centre_table(df, fits), ["K", "Cluster"]).groupBy("K").agg((F.sum(off) <= 1e-3).alias("means"), F.count("*").alias("n_clusters"))
    return (
        measured.groupBy("K").agg(F.count("*").alias("n_rows"), F.bool_and(F.col("_own") <= F.col("_least") + 1e-9).alias("nearest"), F.sum("_own").alias("_sum"))
        .join(costs, "K").join(moved, "K")
        .select("K", "n_rows", "n_clusters", "nearest", "means", (F.abs(F.col("_sum") - F.col("_cost")) <= 1e-6 * F.col("_sum")).alias("cost_matches"))
    )


def top_models(summary: DataFrame, n: int = 3) -> DataFrame:
    """Best ``n`` K per setting by silhouette (a settings table, a few rows each)."""
    w = Window.partitionBy("Feature_Setting").orderBy(F.desc_nulls_last("Silhouette_Score"), "K")
    return summary.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


# --- boundary classifier -----------------------------------------------------------------
FOLDS_AT_A_TIME = 8


def balanced_weight(df: DataFrame, label: str = "label") -> Column:
    """``n / (2 * class size)`` as an expression over the counted classes."""
    counts = {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    pairs = [F.when(F.col(label) == c, F.lit(n / (len(counts) * m))) for c, m in counts.items()]
    return F.coalesce(*pairs)


def forest_pipeline(df: DataFrame, features: Sequence[str], *, trees: int = 500, seed: int = RANDOM_SEED) -> PipelineModel:
    """Median imputation and a balanced random forest as one saveable model."""
    medians = column_medians(df, features)
    filled = ", ".join(f"coalesce(`{c}`, CAST({medians[c]!r} AS DOUBLE)) AS `_f_{c}`" for c in features)
    stages = [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_features"),
        RandomForestClassifier(
            featuresCol="_features", labelCol="label", weightCol="_weight", numTrees=trees, maxDepth=8,
            minInstancesPerNode=3, seed=seed, probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction",
        ),
    ]
    weighted = df.withColumn("label", F.col("label").cast("double"))
    return Pipeline(stages=stages).fit(weighted.withColumn("_weight", balanced_weight(weighted)))


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Probability of the positive class; absent feature columns count as missing."""
    absent = {c: F.lit(None).cast("double") for c in features if c not in df.columns}
    scored = model.transform(df.withColumns(absent) if absent else df)
    return scored.withColumn("probability", vector_to_array("_probability")[1]).drop(*[c for c in scored.columns if c.startswith("_")])


def importances(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((c, float(v)) for c, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def leave_one_group_out(df: DataFrame, group: str, features: Sequence[str], *, trees: int = 500, seed: int = RANDOM_SEED) -> DataFrame:
    """Held-out predictions, one fit per group; each fit is a distributed job."""
    data = materialize(df)
    folds = [r[0] for r in data.select(group).distinct().orderBy(group).collect()]
    if len(folds) < 2:
        raise ValueError("leave-one-group-out needs at least two groups")

    def held_out(fold) -> DataFrame:
        model = forest_pipeline(data.where(F.col(group) != fold), features, trees=trees, seed=seed)
        held = predict(model, data.where(F.col(group) == fold), features)
        return held.withColumn("prediction", (F.col("probability") >= CLASS_CUT).cast("int"))

    # The fits are chains of short jobs that leave cores idle, so several folds share the cluster.
    with ThreadPoolExecutor(min(len(folds), FOLDS_AT_A_TIME)) as pool:
        parts = list(pool.map(inheritable_thread_target(df.sparkSession)(held_out), folds))
    return reduce(lambda a, b: a.unionByName(b), parts)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    classes = F.explode(F.array(F.lit(0), F.lit(1))).alias("class")
    counts = df.agg(*[
        F.count_if((F.col(label) == a) & (F.col(prediction) == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)
    ]).select("*", classes)
    pick = lambda zero, one: F.when(F.col("class") == 0, F.col(zero)).otherwise(F.col(one))
    hit = pick("n00", "n11")
    predicted, actual = hit + pick("n10", "n01"), hit + pick("n01", "n10")
    precision, recall = F.coalesce(F.try_divide(hit, predicted), F.lit(0.0)), F.coalesce(F.try_divide(hit, actual), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return counts.select("class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), actual.alias("support"))
