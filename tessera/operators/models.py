"""Gradient-boosted pair models in Spark ML: the fixed ensemble, grouped cross-fitting, and the singleton model."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.features import VECTOR
from tessera.operators.scoring import BLEND, blend
from tessera.operators.training import group_fold
from tessera.sources.shared import Shared


@dataclass(frozen=True)
class Booster:
    step: float
    depth: int
    positive: float
    features: float
    rows: float
    least: int
    seed: int
    rounds: int


# Learning rate, depth, positive weight, feature and row shares, least rows of a leaf, seed, rounds.
ENSEMBLE = [
    Booster(0.05, 9, 1.30, 0.85, 0.85, 20, 42, 200),
    Booster(0.045, 10, 1.25, 0.80, 0.80, 15, 1337, 220),
    Booster(0.055, 8, 1.35, 0.88, 0.88, 22, 2026, 180),
    Booster(0.04, 10, 1.20, 0.82, 0.82, 18, 777, 240),
    Booster(0.035, 11, 1.25, 0.85, 0.85, 16, 999, 260),
]
SHARES = (0.55, 0.45)


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def classifier(b: Booster, depth: int | None = None, rounds: int | None = None) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", stepSize=b.step, maxDepth=depth or b.depth, maxIter=rounds or b.rounds,
        subsamplingRate=b.rows, featureSubsetStrategy=str(b.features), minInstancesPerNode=b.least, seed=b.seed, cacheNodeIds=True,
    )


def _probability(model, df: DataFrame, name: str) -> DataFrame:
    out = model.setProbabilityCol("__p").setRawPredictionCol("__r").setPredictionCol("__y").transform(df)
    return out.withColumn(name, vector_to_array("__p")[1]).drop("__p", "__r", "__y")


def fit_ensemble(train: DataFrame, columns: list[str] = VECTOR, boosters: list[Booster] = ENSEMBLE, depth: int | None = None, rounds: int | None = None) -> list:
    """One model for each booster on labelled pairs (columns, label)."""
    df = assemble(train, columns).select("features", "label").persist()
    models = [classifier(b, depth, rounds).fit(df.withColumn("weight", F.when(F.col("label") == 1, b.positive).otherwise(1.0))) for b in boosters]
    df.unpersist()
    return models


def score_ensemble(models: list, pairs: DataFrame, columns: list[str] = VECTOR, weights: tuple[float, ...] = BLEND) -> DataFrame:
    df = assemble(pairs, columns)
    for i, m in enumerate(models):
        df = _probability(m, df, f"__s{i}")
    return df.withColumn("score", blend([F.col(f"__s{i}") for i in range(len(models))], weights)).drop("features", *[f"__s{i}" for i in range(len(models))])


def families(depth: int, rounds: int, seed: int, fold: int) -> list[GBTClassifier]:
    """The two boosted families of a fold: sampled rows and features, and whole ones with other trees and steps. Both stop where
    the rows marked `held` say that more trees don't help."""
    common = {"labelCol": "label", "weightCol": "weight", "validationIndicatorCol": "held", "maxIter": rounds}
    return [
        GBTClassifier(**common, stepSize=0.05, maxDepth=depth, subsamplingRate=0.85, featureSubsetStrategy="0.85", minInstancesPerNode=5, seed=seed),
        GBTClassifier(**common, stepSize=0.06, maxDepth=depth + 2, featureSubsetStrategy="all", minInstancesPerNode=1, seed=seed + fold),
    ]


#: Distinct rows of a task that trains on them.
DISTINCT = 100_000


def _alike(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (fold, label, columns) and how many rows are such (weight), in few partitions, as each tree is many short jobs."""
    out = Shared(rows.sparkSession).keep(rows.groupBy("fold", "label", *columns).agg(F.count("*").cast("double").alias("weight")), "alike")
    return out.coalesce(out.count() // DISTINCT + 1)


def _by_weight(x: GBTClassifier, rows: int) -> GBTClassifier:
    """The booster's least rows of a leaf as a least weight; a half less, as weights are whole and the share is rounded."""
    return x.setMinWeightFractionPerNode((x.getMinInstancesPerNode() - 0.5) / rows).setMinInstancesPerNode(1)


def _unstopped(x: GBTClassifier) -> GBTClassifier:
    x.clear(x.validationIndicatorCol)
    return x


def singleton_boosters(rounds: int, seed: int, fold: int) -> list[GBTClassifier]:
    """The one booster of the singleton model: whole rows and features, and all of its rounds, as nothing stops it."""
    return [GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, stepSize=0.05, maxDepth=5, featureSubsetStrategy="all", minInstancesPerNode=20, seed=seed + fold)]


def cross_fit(pairs: DataFrame, columns: list[str], folds: int = 5, group: str = "s1_id", depth: int = 4, rounds: int = 20, seed: int = 42) -> tuple[DataFrame, list]:
    """Out-of-fold probabilities (prob) of labelled pairs, blended from two boosted families, and the models. All pairs of an
    anchor share a fold, which the fold's models are stopped by. A fold whose training rows have one label gets that label
    (0.5 without rows) and no model. The pairs are written to the shared folder once, and every fold reads them there."""
    return _cross_fit(pairs, columns, folds, group, lambda k: families(depth, rounds, seed, k), SHARES)


def _cross_fit(pairs: DataFrame, columns: list[str], folds: int, group: str, boosters: Callable[[int], list[GBTClassifier]], shares: tuple[float, ...], at_once: int = 1, counted: bool = False) -> tuple[DataFrame, list]:
    """cross_fit() with a fold's boosters and their shares of the blend; at_once: folds that are fitted at a time. counted:
    rows that are alike are trained as one of their weight, for boosters that draw no rows and that nothing stops."""
    kept = Shared(pairs.sparkSession).keep(pairs.withColumn("fold", group_fold(F.col(group), folds)), "pairs")
    df = assemble(kept, columns).withColumn("weight", F.lit(1.0))
    sizes = {(r.fold, r.label): r["count"] for r in df.groupBy("fold", "label").count().collect()}
    kinds = set(sizes)
    alike = assemble(_alike(kept, columns), columns) if counted else None
    known = {k: sorted({label for fold, label in kinds if fold != k}) for k in range(folds)}

    def fitted(k: int) -> tuple:
        train, marked = df.where(F.col("fold") != k), df.withColumn("held", F.col("fold") == k)
        # without a row of its own to stop by, a fold's models are stopped by none
        some = any(fold == k for fold, _ in kinds)
        rows = sum(n for (fold, _), n in sizes.items() if fold != k)
        if counted and all(rows >= 2 * x.getMinInstancesPerNode() for x in boosters(k)):
            return tuple(_by_weight(x, rows).fit(alike.where(F.col("fold") != k)) for x in boosters(k))
        return tuple(x.fit(marked) if some and x.isSet(x.validationIndicatorCol) else _unstopped(x).fit(train) for x in boosters(k))

    if counted:
        # what planning the pairs left in the driver goes before the trees' thousands of short jobs
        pairs.sparkSession.sparkContext._jvm.System.gc()
    with ThreadPoolExecutor(at_once) as pool:
        tasks = {k: pool.submit(inheritable_thread_target(pairs.sparkSession)(fitted), k) for k in range(folds) if len(known[k]) > 1}
    out, models = None, []
    for k in range(folds):
        part = df.where(F.col("fold") == k)
        if k in tasks:
            models.append(tasks[k].result())
            for i, m in enumerate(models[-1]):
                part = _probability(m, part, f"__f{i}")
            names = [f"__f{i}" for i in range(len(models[-1]))]
            part = part.withColumn("prob", blend([F.col(x) for x in names], shares)).drop(*names)
        else:
            part = part.withColumn("prob", F.lit(float(known[k][0]) if known[k] else 0.5))
        out = part if out is None else out.unionByName(part)
    return out.drop("features", "weight"), models


def predict(models: list, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Probabilities of new pairs: each family's mean over the folds that have models, then the blend."""
    if not models:
        raise ValueError("no fold had pairs of both labels, so there is no model to predict with")
    df = assemble(pairs, columns)
    for i, (a, b) in enumerate(models):
        df = _probability(b, _probability(a, df, f"__a{i}"), f"__b{i}")
    mean = lambda x: sum((F.col(f"__{x}{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return df.withColumn("prob", blend([mean("a"), mean("b")], SHARES)).drop("features", *[f"__{x}{i}" for x in "ab" for i in range(len(models))])


def importance(models: list, columns: list[str], spark) -> DataFrame:
    """(feature, importance): mean of the boosted trees' importances, greatest first."""
    total = [0.0] * len(columns)
    for a, _ in models:
        for i, x in enumerate(a.featureImportances.toArray()):
            total[i] += float(x) / len(models)
    return spark.createDataFrame(sorted(zip(columns, total, strict=True), key=lambda r: (-r[1], r[0])), "feature string, importance double")


#: Summaries of an anchor's pairs: name, and the feature whose maximum it is.
SINGLETON = {
    "agg_max_tfidf": "feat_blocking_tfidf_sim",
    "agg_max_name_jw": "feat_name_jw",
    "agg_max_addr_jw": "feat_addr_jw",
    "agg_max_name_ratio": "feat_name_ratio",
    "agg_max_street_match": "feat_street_num_match",
}


def singleton_features(anchors: DataFrame, feats: DataFrame) -> DataFrame:
    """(s1_id, agg_*): an anchor's best features and its number of pairs; zeros without pairs."""
    best = feats.groupBy("s1_id").agg(*[F.max(c).cast("double").alias(k) for k, c in SINGLETON.items()], F.count("*").cast("double").alias("agg_cand_count"))
    return anchors.select("s1_id").join(best, "s1_id", "left").fillna(0.0)


#: Rounds and seed of the singleton model (fixed values).
SINGLETON_ROUNDS, SINGLETON_SEED = 150, 42


def fit_singletons(features: DataFrame, truth: DataFrame, folds: int = 5, rounds: int = SINGLETON_ROUNDS) -> tuple[DataFrame, list]:
    """(s1_id, label, prob): out-of-fold probability that an anchor (features of singleton_features) has no link; the models."""
    label = truth.select("s1_id", F.when(F.size("true_ids") == 0, 1.0).otherwise(0.0).alias("label"))
    boosters = lambda k: singleton_boosters(rounds, SINGLETON_SEED, k)
    # the folds' many short jobs leave cores idle one after another
    scored, models = _cross_fit(features.join(label, "s1_id"), [*SINGLETON, "agg_cand_count"], folds, "s1_id", boosters, (1.0,), at_once=folds, counted=True)
    return scored.select("s1_id", "label", "prob"), models


def singleton_scores(features: DataFrame, truth: DataFrame, folds: int = 5, rounds: int = SINGLETON_ROUNDS) -> DataFrame:
    return fit_singletons(features, truth, folds, rounds)[0].select("s1_id", "prob")


def save(models: list, path: str, spark: SparkSession) -> None:
    """Writes the fold models (pairs) or an ensemble (single models) below the path, and how many there are."""
    for i, m in enumerate(models):
        for j, x in enumerate(m if isinstance(m, tuple) else (m,)):
            x.write().overwrite().save(f"{path}/{i}-{j}")
    spark.createDataFrame([(len(models),)], "models int").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def saved(path: str, spark: SparkSession) -> int:
    """How many models save() wrote below the path; folds without a model have none."""
    return spark.read.schema("models int").json(f"{path}/manifest").first().models


def load_folds(path: str, spark: SparkSession) -> list:
    return [tuple(GBTClassificationModel.load(f"{path}/{i}-{j}") for j in (0, 1)) for i in range(saved(path, spark))]


def load_ensemble(path: str, n: int = len(ENSEMBLE)) -> list:
    return [GBTClassificationModel.load(f"{path}/{i}-0") for i in range(n)]
