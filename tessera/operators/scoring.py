"""Score corrections and blends over scored pairs (s1_id, source, cand_id, score, features)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the blend, floors, caps and boosts.
BLEND = (0.25, 0.25, 0.20, 0.15, 0.15)
EXACT_FLOOR, DOOR_CAP, SUPPORT, BOOST = 0.998, 0.75, 0.88, 1.015
#: A score without a model: weights of native features, which sum to 1.
RULE = {"exact_root": 0.40, "same_digits": 0.20, "same_pin": 0.15, "same_country": 0.10, "soundex_match": 0.10, "same_unit": 0.05}


def blend(scores: list[Column], weights: tuple[float, ...] = BLEND) -> Column:
    out = F.lit(0.0)
    for s, w in zip(scores, weights, strict=True):
        out = out + s * F.lit(w)
    return out


def rule_score(weights: dict[str, float] = RULE) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * F.lit(w)
    return F.round(out, 6)


def exact_root_floor(score: Column) -> Column:
    """Pairs of equal roots and equal door or postal code score at least the floor."""
    return F.when((F.col("exact_root") == 1) & ((F.col("same_digits") == 1) | (F.col("same_pin") == 1)), F.greatest(score, F.lit(EXACT_FLOOR))).otherwise(score)


def adjacent_door_cap(score: Column) -> Column:
    """Pairs of unequal roots whose doors are neighbours score at most the cap."""
    return F.when((F.col("adjacent_door_penalty") == 1) & (F.col("exact_root") == 0), F.least(score, F.lit(DOOR_CAP))).otherwise(score)


def joint_support(scored: DataFrame, sources: tuple[str, str] = ("source2", "source3"), support: float = SUPPORT, boost: float = BOOST) -> DataFrame:
    """Where an anchor has a supported pair in both sources, its supported pairs of either are boosted."""
    w = Window.partitionBy("s1_id")
    best = [F.max(F.when(F.col("source") == s, F.col("score"))).over(w) for s in sources]
    df = scored.withColumns({"__x": best[0], "__y": best[1]})
    lifted = (F.col("__x") >= support) & (F.col("__y") >= support) & (F.col("score") >= support)
    return df.withColumn("score", F.when(lifted, F.col("score") * boost).otherwise(F.col("score"))).drop("__x", "__y")
