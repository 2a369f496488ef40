"""Decisions over scored pairs: injective choice, margins, top-K, gates, and a grid search for thresholds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.evaluate import f_beta

# The first engine's cutoff, margin and matches per source; the second's gate, floor and share.
CUTOFF, MARGIN, TOP = 0.992, 0.88, 3
GATE, FLOOR, SHARE = 0.45, 0.55, 0.55


def best_anchor(scored: DataFrame) -> DataFrame:
    """Each satellite record goes to its best anchor only; ties to the smaller anchor."""
    w = Window.partitionBy("source", "cand_id").orderBy(F.desc("score"), "s1_id")
    return scored.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def within_margin(scored: DataFrame, margin: float = MARGIN) -> DataFrame:
    w = Window.partitionBy("source", "s1_id")
    return scored.withColumn("__m", F.max("score").over(w)).where(F.col("score") >= F.col("__m") * margin).drop("__m")


def top_per_anchor(scored: DataFrame, top: int = TOP) -> DataFrame:
    w = Window.partitionBy("source", "s1_id").orderBy(F.desc("score"), "cand_id")
    return scored.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).drop("__n")


def select(scored: DataFrame, cutoff: float = CUTOFF, margin: float = MARGIN, top: int = TOP) -> DataFrame:
    """The first engine's matches: cutoff, injective choice, margin, top-K, each within a source."""
    return top_per_anchor(within_margin(best_anchor(scored.where(F.col("score") >= cutoff)), margin), top)


def match_lists(anchors: DataFrame, matches: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): one row per anchor (s1_id); sources in order, best first."""
    ids = matches.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("source", (-F.col("score")).alias("s"), "cand_id"))).alias("m"))
    joined = F.coalesce(F.array_join(F.col("m.cand_id"), ","), F.lit(""))
    return anchors.select("s1_id").join(ids, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), joined.alias("matched_entity_ids"))


def candidate_lists(anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, candidate_entity_ids): one row per anchor; sources in order, then ids."""
    ids = pairs.groupBy("s1_id").agg(F.array_sort(F.collect_set(F.struct("source", "cand_id"))).alias("m"))
    joined = F.coalesce(F.array_join(F.col("m.cand_id"), ","), F.lit(""))
    return anchors.select("s1_id").join(ids, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), joined.alias("candidate_entity_ids"))


def gate(anchors: DataFrame, scored: DataFrame, gate: float = GATE, floor: float = FLOOR, share: float = SHARE) -> DataFrame:
    """(s1_id, pred_ids): nothing where the best score is below the gate; else the scores of at least the floor and a
    share of the best, or the best alone if there is none. scored: (s1_id, candidate_id, prob)."""
    w = Window.partitionBy("s1_id")
    order = Window.partitionBy("s1_id").orderBy(F.desc("prob"), "candidate_id")
    df = scored.withColumns({"best": F.max("prob").over(w), "n": F.row_number().over(order)}).where(F.col("best") >= gate)
    kept = df.where((F.col("prob") >= F.greatest(F.lit(floor), F.col("best") * share)) | ((F.col("n") == 1)))
    ids = kept.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("p"), "candidate_id"))).alias("m"))
    return anchors.select("s1_id").join(ids, "s1_id", "left").select("s1_id", F.coalesce(F.col("m.candidate_id"), F.array().cast("array<string>")).alias("pred_ids"))


def grid() -> list[tuple[float, float, float]]:
    """Gate, floor and share triples whose floor isn't below the gate, in search order."""
    return [(float(s), float(m), float(r)) for s in np.linspace(0.35, 0.65, 7) for m in np.linspace(0.45, 0.75, 7) for r in np.linspace(0.40, 0.70, 4) if m >= s]


def grid_scores(truth: DataFrame, scored: DataFrame, triples: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """(gate, floor, share, macro_f05) of every triple, in one job: an anchor's true and predicted links are counted
    for each triple at once, so no list is built. truth: (s1_id, true_ids)."""
    spark = truth.sparkSession
    g = F.broadcast(spark.createDataFrame([(i, *t) for i, t in enumerate(triples or grid())], "i int, gate double, floor double, share double"))
    links = truth.select("s1_id", F.explode("true_ids").alias("candidate_id")).distinct().withColumn("hit", F.lit(1))
    w, order = Window.partitionBy("s1_id"), Window.partitionBy("s1_id").orderBy(F.desc("prob"), "candidate_id")
    df = scored.join(links, ["s1_id", "candidate_id"], "left").withColumns({"best": F.max("prob").over(w), "n": F.row_number().over(order)})
    kept = df.join(g, (F.col("best") >= F.col("gate")) & ((F.col("prob") >= F.greatest("floor", F.col("best") * F.col("share"))) | (F.col("n") == 1)))
    each = kept.groupBy("i", "s1_id").agg(F.count("*").alias("pred"), F.count("hit").alias("tp"))
    size = F.size(F.array_distinct("true_ids"))
    # anchors without a prediction score 1 if they have no link, else 0; those with one are corrected by the difference
    base = truth.select("s1_id", size.alias("true")).withColumn("none", F.when(F.col("true") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    totals = base.agg(F.sum("none").alias("none"), F.count("*").alias("n"))
    diff = each.join(base, "s1_id").select("i", (f_beta(F.col("true"), F.col("pred"), F.col("tp")) - F.col("none")).alias("d")).groupBy("i").agg(F.sum("d").alias("d"))
    out = g.join(diff, "i", "left").join(F.broadcast(totals))
    return out.select("gate", "floor", "share", F.round((F.col("none") + F.coalesce("d", F.lit(0.0))) / F.col("n"), 9).alias("macro_f05"))


def best_thresholds(truth: DataFrame, scored: DataFrame) -> DataFrame:
    """The first of the best triples in search order."""
    return grid_scores(truth, scored).orderBy(F.desc("macro_f05"), "gate", "floor", "share").limit(1)
