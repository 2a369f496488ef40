"""Candidate blocking: every pass of an engine as one exploded-key equi-join.

A record explodes into rows (pass, key). Within a pass all anchors with a key see the same satellites, so keeping the
first K satellites of each (source, pass, key) before the join gives what K per anchor behind the join would, and
bounds the join's fan-out whatever the key's skew. The order is by id, for the cap to be deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import Shared

SEPARATOR = "\x01"


@dataclass(frozen=True)
class Pass:
    """keys: columns joined on; least: minimal lengths; cap: candidates per anchor and source; other: satellite columns
    where they differ. country: whether country_std is a key, which anchors must then have unless `open` is set."""

    name: str
    keys: tuple[str, ...]
    cap: int
    least: tuple[int, ...] = ()
    other: tuple[str, ...] = ()
    country: bool = True
    open: bool = False

    def columns(self, satellite: bool) -> list[str]:
        own = self.other if satellite and self.other else self.keys
        return [*own, *["country_std"] * self.country]

    def guard(self, satellite: bool) -> list[tuple[str, int]]:
        own = self.other if satellite and self.other else self.keys
        least = self.least or (1,) * len(own)
        return [*zip(own, least, strict=True), *[("country_std", 1)] * (self.country and not self.open)]


# The passes' keys, minimal lengths and caps.
PASSES = [
    Pass("p01", ("name",), 4, (3,), open=True),
    Pass("p02", ("name_root",), 4, (3,)),
    Pass("p03", ("sorted_root",), 3, (4,)),
    Pass("p04", ("street_digits", "root_prefix_3"), 4, (1, 3)),
    Pass("p05", ("unit_code", "root_prefix_3"), 3, (1, 3)),
    Pass("p06", ("postal_code", "root_prefix_3"), 4, (1, 3)),
    Pass("p07", ("postal_code", "street_digits"), 3),
    Pass("p08", ("soundex_first", "postal_code"), 4),
    Pass("p09", ("soundex_first", "street_digits"), 4),
    Pass("p10", ("consonant_stem", "postal_code"), 3, (2, 1)),
    Pass("p11", ("consonant_stem", "street_digits"), 3, (2, 1)),
    Pass("p12", ("acronym", "street_digits"), 3, (2, 1), ("name_root", "street_digits")),
    Pass("p13", ("soundex_second", "postal_code"), 3),
    Pass("p14", ("soundex_second", "street_digits"), 3),
    Pass("p15", ("addr_core_prefix_4", "postal_code"), 3, (4, 1)),
    Pass("p16", ("root_prefix_2", "street_digits", "postal_code"), 3, (2, 1, 1)),
    Pass("p17", ("sorted_3gram", "postal_code"), 3, (3, 1)),
    Pass("p18", ("unit_code", "postal_code"), 3),
    Pass("p19", ("addr_core",), 3, (8,)),
    Pass("p20", ("soundex_first", "addr_core_prefix_4"), 3, (1, 4)),
    Pass("p21", ("name_root", "postal_code"), 2, (5, 5), country=False),
    Pass("p22", ("consonant_stem", "addr_core_prefix_4"), 3, (2, 4)),
    Pass("p23", ("first_word", "street_digits"), 3, (4, 1)),
]


def _keys(passes: list[Pass], satellite: bool) -> Column:
    rows = []
    for p in passes:
        holds = F.lit(True)
        for c, n in p.guard(satellite):
            holds = holds & (F.length(c) >= n)
        key = F.concat_ws(SEPARATOR, *p.columns(satellite))
        rows.append(F.when(holds, F.struct(F.lit(p.name).alias("pass"), key.alias("key"), F.lit(p.cap).alias("cap"))))
    return F.explode(F.array_compact(F.array(*rows)))


def candidates_by_pass(entities: DataFrame, passes: list[Pass] = PASSES, anchor: str = "source1") -> DataFrame:
    """(pass, s1_id, source, cand_id): enriched records of the anchor source against those of every other source."""
    anchors = entities.where(F.col("source") == anchor).select(F.col("id").alias("s1_id"), _keys(passes, False).alias("k")).select("s1_id", "k.pass", "k.key")
    sats = entities.where(F.col("source") != anchor).select("source", F.col("id").alias("cand_id"), _keys(passes, True).alias("k")).select("source", "cand_id", "k.*")
    order = Window.partitionBy("source", "pass", "key").orderBy("cand_id")
    most = max(p.cap for p in passes)
    first = sats.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).where(F.col("n") <= F.col("cap"))
    return anchors.join(first.select("source", "cand_id", "pass", "key"), ["pass", "key"]).select("pass", "s1_id", "source", "cand_id")


def candidates(entities: DataFrame, passes: list[Pass] = PASSES) -> DataFrame:
    """Distinct (s1_id, source, cand_id) over all passes."""
    return candidates_by_pass(entities, passes).select("s1_id", "source", "cand_id").distinct()


# The second engine: equal keys with a fixed similarity each, and no cap.
# Key columns, minimal lengths, similarities.
EXACT = [
    ("first_tokens", ("name_first_tokens",), (4,), 0.70),
    ("digits_city", ("street_digits_str", "clean_city"), (1, 1), 0.65),
    ("phone", ("clean_phone",), (7,), 1.0),
]
MOST = 45
#: For all pairs of equal keys: ids in a list, satellites and anchors in a block of pairs, pairs and tasks from which lists are dealt out.
LISTED, RUN, SIDE, DEALT, TASKS = 4096, 256, 32, 1 << 22, 10_000


def _keyed(df: DataFrame, id_: str, rules) -> DataFrame:
    """(id, rule, key, tfidf_sim) of records that have a rule's key."""
    keys = []
    for name, cols, least, sim in rules:
        holds = F.lit(True)
        for c, n in zip(cols, least, strict=True):
            holds = holds & (F.length(c) >= n)
        keys.append(F.when(holds, F.struct(F.lit(name).alias("rule"), F.concat_ws(SEPARATOR, *cols).alias("key"), F.lit(sim).cast("float").alias("tfidf_sim"))))
    return df.select(F.col("id").alias(id_), F.explode(F.array_compact(F.array(*keys))).alias("k")).select(id_, "k.*")


def _satellites(cleaned: DataFrame, rules, anchor: str, most: int | None) -> DataFrame:
    b = _keyed(cleaned.where(F.col("source") != anchor), "candidate_id", rules).drop("tfidf_sim")
    if most is not None:
        first = Window.partitionBy("rule", "key").orderBy("candidate_id")
        b = b.withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).drop("n")
    return b


def floors(cleaned: DataFrame, rules=EXACT, anchor: str = "source1", most: int = MOST) -> DataFrame:
    """(s1_id, floor): anchors with a key that `most` satellites have, and the greatest similarity of such a key. Their `most`
    best pairs are all of that similarity at least, so merge() keeps none below it."""
    full = _satellites(cleaned, rules, anchor, most).groupBy("rule", "key").agg(F.countDistinct("candidate_id").alias("n")).where(F.col("n") >= most).drop("n")
    a = _keyed(cleaned.where(F.col("source") == anchor), "s1_id", rules)
    return a.join(full, ["rule", "key"]).groupBy("s1_id").agg(F.max("tfidf_sim").alias("floor"))


def equal_keys(cleaned: DataFrame, rules=EXACT, anchor: str = "source1", most: int | None = None, least: DataFrame | None = None) -> DataFrame:
    """(rule, s1_id, candidate_id, tfidf_sim) of records with equal keys; one join for all rules.

    most: only the first satellites of a key, by id. All pairs of a key have one similarity, so where merge() keeps the
    `most` best of each anchor by similarity and id, no other satellite of the key can be among them: the cut changes
    nothing there, and keeps a hot key's pairs in proportion to its anchors. least: floors(), below which pairs are left out.
    Without `most`, all pairs come from lists of ids (all_pairs).
    """
    a = _keyed(cleaned.where(F.col("source") == anchor), "s1_id", rules)
    if least is not None:
        a = a.join(least, "s1_id", "left").where(F.col("floor").isNull() | (F.col("tfidf_sim") >= F.col("floor"))).drop("floor")
    b = _satellites(cleaned, rules, anchor, most)
    if most is None:
        return all_pairs(a, b)
    return a.join(b, ["rule", "key"]).select("rule", "s1_id", "candidate_id", "tfidf_sim")


def _lists(keyed: DataFrame, id_: str, ids: str, part: str) -> DataFrame:
    """A row for every LISTED ids of a key, null ones too."""
    by = [c for c in keyed.columns if c != id_]
    n = F.row_number().over(Window.partitionBy("rule", "key").orderBy(id_))
    lists = keyed.withColumn(part, F.floor((n - 1) / LISTED)).groupBy(*by, part).agg(F.collect_list(F.struct(id_)).alias(ids))
    return lists.withColumn(ids, F.col(ids)[id_])


def _cut(ids: str, n: int) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(1), F.size(ids), F.lit(n)), lambda i: F.slice(ids, i, n)))


def all_pairs(a: DataFrame, b: DataFrame, one: str = "s1_id", other: str = "candidate_id") -> DataFrame:
    """(rule, one, other, a's other columns): all pairs of equal rule and key; one, other: the columns of a and b that pair up.

    Lists of ids meet, not records, and are dealt out by list before they become pairs, so a hot key is the work of many
    tasks. A task's pairs come in blocks, each anchor of a block with the same short run of satellites: few ids a file and
    the same sequence again and again, which Parquet's dictionaries and compression make little of."""
    shared, rest = Shared(a.sparkSession), [c for c in a.columns if c not in ("rule", "key", one)]
    a, b = shared.keep(_lists(a, one, "ones", "one_part"), "anchors"), shared.keep(_lists(b, other, "others", "part"), "satellites")
    sizes = lambda df, ids, n: df.groupBy("rule", "key").agg(F.sum(F.size(ids)).cast("double").alias(n), F.count("*").alias(f"{n}_lists"))
    both = sizes(a, "ones", "a").join(sizes(b, "others", "b"), ["rule", "key"])
    size = both.agg(F.sum(F.col("a") * F.col("b")).alias("pairs"), F.sum(F.col("a_lists") * F.col("b_lists")).alias("lists")).first()
    met = a.join(b, ["rule", "key"])
    if (size.pairs or 0) > DEALT:
        met = met.repartition(int(min(size.pairs // DEALT + 1, size.lists, TASKS)), "rule", "key", "one_part", "part")
    blocks = met.select("rule", *rest, "ones", _cut("others", RUN).alias("run")).select("rule", *rest, "run", _cut("ones", SIDE).alias("side"))
    # a lambda keeps this out of generated code, which would hold copies of all pairs of a block at a time, not of one anchor's run
    ones = F.explode(F.transform("side", lambda x: x))
    return blocks.select("rule", *rest, "run", ones.alias(one)).select("rule", one, F.explode("run").alias(other), *rest)


def merge(*pairs: DataFrame, most: int = MOST) -> DataFrame:
    """(s1_id, candidate_id, tfidf_sim): the best similarity of each pair, the `most` best pairs of each anchor."""
    every = None
    for p in pairs:
        p = p.select("s1_id", "candidate_id", F.col("tfidf_sim").cast("float").alias("tfidf_sim"))
        every = p if every is None else every.unionByName(p)
    # dealt out by anchor once, for the sum and for the order
    best = every.repartition("s1_id").groupBy("s1_id", "candidate_id").agg(F.max("tfidf_sim").alias("tfidf_sim"))
    order = Window.partitionBy("s1_id").orderBy(F.desc("tfidf_sim"), "candidate_id")
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")


def recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: share of true links among the pairs, share of anchors with all of theirs, pairs, pairs per anchor.

    truth: (s1_id, true_ids array). Ratios without a denominator are 1.
    """
    links = truth.select("s1_id", F.explode("true_ids").alias("candidate_id")).distinct()
    found = links.join(pairs.select("s1_id", "candidate_id").distinct().withColumn("hit", F.lit(1)), ["s1_id", "candidate_id"], "left")
    each = found.groupBy("s1_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    a = each.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("n"), F.lit(0)).alias("links"), F.count_if(F.col("hits") == F.col("n")).alias("whole"), F.count("*").alias("anchors"))
    b = pairs.agg(F.count("*").alias("total_candidates"))
    c = truth.agg(F.count("*").alias("entities"))
    return a.join(b).join(c).select(
        ratio(F.col("hits"), F.col("links")).alias("candidate_match_recall"),
        ratio(F.col("whole"), F.col("anchors")).alias("entity_perfect_recall_rate"),
        "total_candidates",
        (F.col("total_candidates") / F.greatest("entities", F.lit(1))).alias("avg_candidates_per_entity"),
    )
