"""Macro F-beta evaluation of predicted links against true ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETA = 0.5


def f_beta(true: Column, pred: Column, tp: Column, beta: float = BETA) -> Column:
    """F-beta by numbers of true, predicted and common links: 1 for two empty sets, 0 where nothing is common."""
    p, r, b = tp / pred, tp / true, beta * beta
    return F.when((true == 0) & (pred == 0), F.lit(1.0)).when((true == 0) | (pred == 0) | (tp == 0), F.lit(0.0)).otherwise((1 + b) * p * r / (b * p + r))


def entity_scores(truth: DataFrame, predicted: DataFrame, beta: float = BETA) -> DataFrame:
    """(s1_id, n_true, n_pred, tp, f) of truth (s1_id, true_ids) and predicted (s1_id, pred_ids). Anchors that only the
    predictions have are left out; anchors without a prediction count as predicted empty."""
    empty = F.array().cast("array<string>")
    df = truth.join(predicted, "s1_id", "left")
    t, p = F.array_distinct(F.coalesce("true_ids", empty)), F.array_distinct(F.coalesce("pred_ids", empty))
    df = df.select("s1_id", F.size(t).alias("n_true"), F.size(p).alias("n_pred"), F.size(F.array_intersect(t, p)).alias("tp"))
    return df.withColumn("f", f_beta(F.col("n_true"), F.col("n_pred"), F.col("tp"), beta))


def macro(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: macro F0.5 over all anchors, over those with links, accuracy on those without, and their numbers."""
    e = entity_scores(truth, predicted)
    single = F.col("n_true") == 0
    return e.agg(
        F.avg("f").alias("macro_f05"),
        F.coalesce(F.avg(F.when(single, F.col("f"))), F.lit(1.0)).alias("singleton_accuracy"),
        F.coalesce(F.avg(F.when(~single, F.col("f"))), F.lit(0.0)).alias("match_macro_f05"),
        F.count("*").alias("total_entities"),
        F.count_if(single).alias("total_singletons"),
    )


def macro_prf(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """macro() with macro precision and recall; an anchor without links counts 1 in both if nothing is predicted."""
    e = entity_scores(truth, predicted)
    ratio = lambda n: F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), F.lit(1.0)).when(F.col(n) > 0, F.col("tp") / F.col(n)).otherwise(F.lit(0.0))
    e = e.withColumns({"p": F.when(F.col("n_true") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).otherwise(ratio("n_pred")), "r": F.when(F.col("n_true") == 0, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).otherwise(ratio("n_true"))})
    return e.agg(F.avg("f").alias("macro_f05"), F.avg("p").alias("macro_precision"), F.avg("r").alias("macro_recall"), F.count("*").alias("total_entities"), F.count_if(F.col("n_true") == 0).alias("total_singletons"))


def summary(predicted: DataFrame) -> DataFrame:
    """Anchors with and without matches, their shares in percent, and links, of (s1_id, pred_ids)."""
    n = F.size("pred_ids")
    out = predicted.agg(F.count("*").alias("anchors"), F.count_if(n > 0).alias("matched"), F.count_if(n == 0).alias("singletons"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("links"))
    pct = lambda c: F.round(F.when(F.col("anchors") > 0, 100 * F.col(c) / F.col("anchors")).otherwise(F.lit(0.0)), 6)
    return out.select("*", pct("matched").alias("matched_pct"), pct("singletons").alias("singleton_pct"))
