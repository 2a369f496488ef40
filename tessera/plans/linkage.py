"""The linkage plans of both engines, from raw records to decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocking, decide, entities, features, scoring, tfidf, training
from tessera.operators import models as M
from tessera.sources.shared import Shared


def rule_scored(raw: DataFrame) -> DataFrame:
    """(s1_id, source, cand_id, score, exact_root, same_digits, same_pin, adjacent_door_penalty): first-engine
    candidates with their native features, scored by rule with every correction but joint support."""
    e = entities.enrich(raw)
    f = features.with_native(features.attach(blocking.candidates(e), e))
    s = f.select("s1_id", "source", "cand_id", "exact_root", "same_digits", "same_pin", "adjacent_door_penalty", scoring.rule_score().alias("score"))
    return s.withColumn("score", scoring.exact_root_floor(F.col("score"))).withColumn("score", scoring.adjacent_door_cap(F.col("score")))


def rule_matches(raw: DataFrame, cutoff: float = decide.CUTOFF, margin: float = decide.MARGIN, top: int = decide.TOP) -> DataFrame:
    """Matches of the first engine by rule scores."""
    return decide.select(scoring.joint_support(rule_scored(raw)), cutoff, margin, top)


def training_features(raw: DataFrame, links: DataFrame) -> DataFrame:
    """Labelled pairs (links: s1_id, cand_id) of the first engine with their forty features."""
    e = entities.enrich(raw)
    pairs = training.with_sources(training.training_pairs(e, links), e)
    f = features.vector40(features.attach(pairs.drop("label"), e))
    return f.join(pairs.select("s1_id", "cand_id", "label"), ["s1_id", "cand_id"])


def model_scores(raw: DataFrame, models: list) -> DataFrame:
    """(s1_id, source, cand_id, score): first-engine candidates scored by its ensemble, with every correction."""
    e = entities.enrich(raw)
    f = features.vector40(features.attach(blocking.candidates(e), e))
    s = M.score_ensemble(models, f)
    s = s.withColumn("score", scoring.exact_root_floor(F.col("score"))).withColumn("score", scoring.adjacent_door_cap(F.col("score")))
    return scoring.joint_support(s).select("s1_id", "source", "cand_id", "score")


def model_matches(raw: DataFrame, models: list, cutoff: float = decide.CUTOFF, **more) -> DataFrame:
    """Matches of the first engine by its ensemble."""
    return decide.select(model_scores(raw, models), cutoff, **more)


#: What the second engine's candidates need of a cleaned record.
KEYS_B = tuple(dict.fromkeys(("id", "source", "clean_name", "clean_address", *(c for _, cols, _, _ in blocking.EXACT for c in cols))))


def _kept(cleaned: DataFrame, only: tuple[str, ...] | None = ()) -> DataFrame:
    """The cleaned records, written once for the plans that read them several times, with the texts of the features in `only`."""
    return Shared(cleaned.sparkSession).keep(cleaned.select(*dict.fromkeys((*KEYS_B, *features.texts_of(only)))), "cleaned")


def pairs_b(cleaned: DataFrame, top: int = 35, least: float = 0.25) -> DataFrame:
    """Second-engine candidates: two TF-IDF joins and the equal keys, merged."""
    return _pairs_b(_kept(cleaned), top, least)


def _pairs_b(cleaned: DataFrame, top: int, least: float) -> DataFrame:
    # an anchor with enough satellites of an equal key keeps no pair of a similarity below the key's
    floors = Shared(cleaned.sparkSession).keep(blocking.floors(cleaned), "floors")
    known = cleaned.where("source = 'source1'").join(floors.withColumn("floor", F.col("floor").cast("double") - 1e-6), F.col("id") == F.col("s1_id"), "left")
    combo = F.concat("clean_name", F.lit(" "), "clean_address")

    def texts(text):
        return known.select("id", text.alias("text"), "floor"), cleaned.where("source <> 'source1'").select("id", text.alias("text"))

    by_name = tfidf.top_similar(*texts(F.col("clean_name")), 2, 4, min(top, 25), least)
    by_both = tfidf.top_similar(*texts(combo), 3, 4, 20, 0.18)
    return blocking.merge(by_name, by_both, blocking.equal_keys(cleaned, most=blocking.MOST, least=floors))


def features_of(raw: DataFrame, top: int = 35, least: float = 0.25, only: tuple[str, ...] | None = None) -> DataFrame:
    """Features of all second-engine candidates; only: those of these names."""
    cleaned = _kept(entities.clean(raw), only)
    return features.features_b(_pairs_b(cleaned, top, least), cleaned, only=only)
