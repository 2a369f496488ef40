"""Training pairs, labels and folds."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocking import all_pairs
from tessera.sources.shared import Shared

# Bounds of the sample (the feature is a bounded sample; ids put it in order).
ANCHORS, POSITIVES, NEGATIVE_ANCHORS, NEGATIVE_SATELLITES, BY_NAME, BY_DOOR = 130_000, 120_000, 50_000, 130_000, 80_000, 60_000


def label_pairs(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs with label 1 where links (s1_id, cand_id) has them, else 0."""
    known = links.select("s1_id", "cand_id").distinct().withColumn("__hit", F.lit(1))
    return pairs.join(known, ["s1_id", "cand_id"], "left").withColumn("label", F.when(F.col("__hit").isNotNull(), 1.0).otherwise(0.0)).drop("__hit")


#: Keys of a hard negative: root and country, or door, root prefix and country.
HARD = (("name_root", "country_std"), ("street_digits", "root_prefix_3", "country_std"))
#: Links of an anchor up to which its pairs are held against them one by one.
FEW = 32


def hard_negatives(entities: DataFrame, links: DataFrame, satellites: str = "source2", bounded: bool = True) -> DataFrame:
    """(s1_id, cand_id): records that share the root and country, or the door, root prefix and country, without a link.

    bounded: only the sample that the fixed bounds allow, for training; else every such pair.
    """
    a, s = entities.where("source = 'source1'"), entities.where(F.col("source") == satellites)
    if not bounded:
        return _every_negative(a, s, links)
    a, s = a.orderBy("id").limit(NEGATIVE_ANCHORS), s.orderBy("id").limit(NEGATIVE_SATELLITES)

    def joined(keys: tuple[str, ...], most: int) -> DataFrame:
        left, right = a.select(F.col("id").alias("s1_id"), *keys), s.select(F.col("id").alias("cand_id"), *keys)
        # in the order of anchors and then satellites, no satellite of a key beyond the first `most` can be among the first pairs
        first = Window.partitionBy(*keys).orderBy("cand_id")
        right = right.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most).drop("__n")
        return left.join(right, list(keys)).select("s1_id", "cand_id").orderBy("s1_id", "cand_id").limit(most)

    both = joined(HARD[0], BY_NAME).unionByName(joined(HARD[1], BY_DOOR)).distinct()
    return both.join(links.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")


def _every_negative(a: DataFrame, s: DataFrame, links: DataFrame) -> DataFrame:
    """All hard negatives. Where an id has one record and an anchor few links, a pair of the second keys with equal roots is one
    of the first keys, so nothing has to be made distinct, and links are looked up in the anchor: no pair is shuffled. Pairs of
    other ids are made distinct and held against the links by joins."""
    shared, columns = Shared(a.sparkSession), list(dict.fromkeys(c for keys in HARD for c in keys))
    records = lambda df: df.groupBy("id").agg(F.collect_set(F.struct(*columns)).alias("records"))
    known = links.groupBy("s1_id").agg(F.collect_set("cand_id").alias("linked"))
    a = records(a).join(known.withColumnRenamed("s1_id", "id"), "id", "left").withColumn("plain", (F.size("records") == 1) & (F.coalesce(F.size("linked"), F.lit(0)) <= FEW))
    a, s = shared.keep(a, "anchors"), shared.keep(records(s).withColumn("plain", F.size("records") == 1), "satellites")

    def keyed(df: DataFrame, item: str, *more: str) -> DataFrame:
        df = df.where("plain").select("id", *more, F.col("records")[0].alias("r"))
        rules = []
        for i, keys in enumerate(HARD):
            values = [F.col(f"r.{c}") for c in keys]
            root = F.col("r.name_root") if i else F.lit(None).cast("string")
            rules.append(F.when(reduce(and_, (x.isNotNull() for x in values)), F.struct(F.lit(i).alias("rule"), F.array(*values).alias("key"), root.alias("root"))))
        return df.select("id", *more, F.explode(F.array_compact(F.array(*rules))).alias("k")).select("k.rule", "k.key", F.struct("id", "k.root", *more).alias(item))

    pairs = all_pairs(keyed(a, "a", "linked"), keyed(s, "b"), "a", "b")
    same, linked = F.col("a.root") == F.col("b.root"), F.array_contains("a.linked", F.col("b.id"))
    out = pairs.where(~F.coalesce(same, F.lit(False)) & ~F.coalesce(linked, F.lit(False))).select(F.col("a.id").alias("s1_id"), F.col("b.id").alias("cand_id"))
    if a.where("not plain").isEmpty() and s.where("not plain").isEmpty():
        return out
    side = lambda df, id_: df.select(F.col("id").alias(id_), "plain", F.explode("records").alias("r")).select(id_, F.col("plain").alias(f"{id_}_plain"), "r.*")
    left, right = side(a, "s1_id"), side(s, "cand_id")
    met = [x.join(y, list(keys)).select("s1_id", "cand_id") for keys in HARD for x, y in ((left.where("not s1_id_plain"), right), (left.where("s1_id_plain"), right.where("not cand_id_plain")))]
    return out.unionByName(reduce(DataFrame.unionByName, met).distinct().join(links.select("s1_id", "cand_id"), ["s1_id", "cand_id"], "left_anti"))


def training_pairs(entities: DataFrame, links: DataFrame, bounded: bool = True) -> DataFrame:
    """(s1_id, cand_id, label): true links of the anchors, and hard negatives.

    bounded: links of the first anchors and a sample of negatives, within the fixed bounds; else all of both.
    """
    first = entities.where("source = 'source1'").select(F.col("id").alias("s1_id"))
    if bounded:
        first = first.join(links.select("s1_id").distinct(), "s1_id", "left_semi").orderBy("s1_id").limit(ANCHORS)
    positive = links.join(first, "s1_id", "left_semi").select("s1_id", "cand_id").distinct()
    if bounded:
        positive = positive.orderBy("s1_id", "cand_id").limit(POSITIVES)
    return positive.withColumn("label", F.lit(1.0)).unionByName(hard_negatives(entities, links, bounded=bounded).withColumn("label", F.lit(0.0)))


def group_fold(group: Column, k: int) -> Column:
    """A fold in which all rows of a group are."""
    return F.pmod(F.xxhash64(group), F.lit(k)).cast("int")


def with_sources(pairs: DataFrame, entities: DataFrame, anchor: str = "source1") -> DataFrame:
    """Pairs (s1_id, cand_id, ...) with the source of their satellite; an id of several sources counts for the first."""
    of = entities.where(F.col("source") != anchor).groupBy(F.col("id").alias("cand_id")).agg(F.min("source").alias("source"))
    return pairs.join(of, "cand_id", "left")
