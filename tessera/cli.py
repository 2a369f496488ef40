"""Command line: `python -m tessera.cli --engine ensemble|folds --mode cv|submit|both --data DIR --output PATH`.

The ensemble engine trains on labelled pairs (cv), and scores every candidate of the test registries and writes the two
result files below the output (submit). The folds engine fits cross-validated models, the singleton model and thresholds
(cv), and writes a submission (submit).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocking, decide, entities, evaluate, features, models, training
from tessera.plans import linkage
from tessera.sources import sinks, tables


def _load(spark: SparkSession, data: str, part: str, rows: int | None) -> DataFrame:
    out = None
    for i in (1, 2, 3):
        df = tables.scan(spark, tables.find(f"{part}_source{i}", part, (data,)), rows if i == 1 else None)
        df = df.drop("source").withColumn("source", F.lit(f"source{i}"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def cross_validate(spark: SparkSession, data: str, rows: int | None, top: int, least: float, model: str, folds: int = 5) -> dict:
    """Fits the second engine's models on training data, searches thresholds, writes the models, and returns metrics."""
    raw = _load(spark, data, "train", rows)
    cleaned = entities.clean(raw)
    truth = tables.truth_list(tables.scan(spark, tables.find("train_ground_truth", "train", (data,))))
    anchors = cleaned.where("source = 'source1'").select(F.col("id").alias("s1_id"))
    empty = F.array().cast("array<string>")
    truth = anchors.join(truth, "s1_id", "left").select("s1_id", F.coalesce("true_ids", empty).alias("true_ids")).persist()
    pairs = linkage.pairs_b(cleaned, top, least).persist()
    links = truth.select("s1_id", F.explode("true_ids").alias("cand_id"))
    feats = features.features_b(pairs, cleaned).withColumnRenamed("candidate_id", "cand_id").persist()
    columns = [c for c in feats.columns if c.startswith("feat_")]
    scored, fitted = models.cross_fit(training.label_pairs(feats, links), columns, folds)
    scored = scored.withColumnRenamed("cand_id", "candidate_id").persist()
    models.save(fitted, model, spark)
    entity = models.singleton_features(anchors, feats.withColumnRenamed("cand_id", "candidate_id"))
    alone, singles = models.fit_singletons(entity, truth, folds)
    models.save(singles, f"{model}/singletons", spark)
    right = alone.agg(F.avg(((F.col("prob") >= 0.5) == (F.col("label") == 1)).cast("double")).alias("singleton_model_accuracy")).first()
    best = decide.best_thresholds(truth, scored).first()
    predicted = decide.gate(anchors, scored, best["gate"], best["floor"], best["share"])
    out = evaluate.macro_prf(truth, predicted).first().asDict() | blocking.recall(pairs, truth).first().asDict()
    for df in (truth, pairs, feats, scored):
        df.unpersist()
    return out | right.asDict() | {"gate": best["gate"], "floor": best["floor"], "share": best["share"], "folds": len(fitted)}


def submit(spark: SparkSession, data: str, top: int, least: float, model: str, output: str, gate: float, floor: float, share: float) -> None:
    raw = _load(spark, data, "test", None)
    cleaned = entities.clean(raw)
    feats = features.features_b(linkage.pairs_b(cleaned, top, least), cleaned)
    columns = [c for c in feats.columns if c.startswith("feat_")]
    scored = models.predict(models.load_folds(model, spark), feats, columns)
    anchors = cleaned.where("source = 'source1'").select(F.col("id").alias("s1_id"))
    sinks.write_submission(decide.gate(anchors, scored, gate, floor, share), output)


def train_ensemble(spark: SparkSession, data: str, rows: int | None, model: str, depth: int | None = None, rounds: int | None = None) -> dict:
    """Fits the first engine's ensemble on its labelled pairs and writes it."""
    raw = _load(spark, data, "train", rows)
    truth = tables.truth_set(tables.scan(spark, tables.find("train_ground_truth", "train", (data,))))
    pairs = linkage.training_features(raw, truth.select("s1_id", F.explode("true_ids").alias("cand_id"))).persist()
    counts = {r.label: r["count"] for r in pairs.groupBy("label").count().collect()}
    models.save(models.fit_ensemble(pairs, depth=depth, rounds=rounds), model, spark)
    pairs.unpersist()
    return {"positives": counts.get(1.0, 0), "negatives": counts.get(0.0, 0)}


def match_by_ensemble(spark: SparkSession, data: str, model: str, output: str, cutoff: float) -> None:
    """Scores every candidate of the test registries; writes matching_results and candidate_pairs below the output."""
    raw = _load(spark, data, "test", None)
    scored = linkage.model_scores(raw, models.load_ensemble(model, models.saved(model, spark))).persist()
    anchors = entities.enrich(raw).where("source = 'source1'").select(F.col("id").alias("s1_id"))
    sinks.write_delimited(decide.match_lists(anchors, decide.select(scored, cutoff)), f"{output}/matching_results")
    sinks.write_delimited(decide.candidate_lists(anchors, scored), f"{output}/candidate_pairs")
    scored.unpersist()


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--engine", choices=("ensemble", "folds"), default="folds")
    p.add_argument("--mode", choices=("cv", "submit", "both"), default="cv")
    p.add_argument("--data", default="data")
    p.add_argument("--sample-size", type=int, default=25000)
    p.add_argument("--full", action="store_true", help="all training anchors")
    p.add_argument("--top-k", type=int, default=35)
    p.add_argument("--min-sim", type=float, default=0.25)
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--model", default="model")
    p.add_argument("--output", default="submission")
    p.add_argument("--gate", type=float, default=decide.GATE)
    p.add_argument("--floor", type=float, default=decide.FLOOR)
    p.add_argument("--share", type=float, default=decide.SHARE)
    p.add_argument("--cutoff", type=float, default=decide.CUTOFF)
    p.add_argument("--depth", type=int, help="depth of the ensemble's trees in place of each model's own")
    p.add_argument("--rounds", type=int, help="rounds of the ensemble in place of each model's own")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    rows = None if a.full else a.sample_size
    if a.engine == "ensemble":
        if a.mode in ("cv", "both"):
            print(train_ensemble(spark, a.data, None, a.model, a.depth, a.rounds))
        if a.mode in ("submit", "both"):
            match_by_ensemble(spark, a.data, a.model, a.output, a.cutoff)
        return
    gate, floor, share = a.gate, a.floor, a.share
    if a.mode in ("cv", "both"):
        found = cross_validate(spark, a.data, rows, a.top_k, a.min_sim, a.model, a.folds)
        print(found)
        gate, floor, share = found["gate"], found["floor"], found["share"]
    if a.mode in ("submit", "both"):
        submit(spark, a.data, a.top_k, a.min_sim, a.model, a.output, gate, floor, share)


if __name__ == "__main__":
    main()
