"""Pair features of both engines: native expressions, and one Arrow call for the similarities that have none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import FloatType, StringType, StructField, StructType

from tessera.functions.batches import Texts, similarities
from tessera.functions.similarity import KERNELS, KERNELS_B, kernels
from tessera.sources.shared import Shared, chunks

USED = ("name", "name_root", "acronym", "addr_std", "addr_core", "street_digits", "unit_code", "postal_code", "country_std", "soundex_first", "consonant_stem")
#: The features in vector order.
VECTOR = [
    "exact_name", "exact_root", "jw_root", "sort_root", "set_root", "partial_root", "lev_root", "qratio_root", "len_diff_ratio", "acronym_match",
    "soundex_match", "consonant_match", "jw_soundex", "jw_addr", "sort_addr", "set_addr", "lev_addr", "core_addr_sort", "core_addr_set", "core_addr_lev",
    "same_digits", "diff_digits", "digit_num_diff", "same_unit", "same_pin", "diff_pin", "same_country", "translit_flag", "composite", "addr_match_score",
    "pin_and_digits", "phonetic_addr_composite", "strong_exact_pair", "root_contains", "exact_full_addr", "exact_root_and_pin", "exact_addr_core",
    "shared_tokens", "adjacent_door_penalty", "sort_set_diff",
]


def attach(pairs: DataFrame, entities: DataFrame, anchor: str = "source1") -> DataFrame:
    """Pairs (s1_id, source, cand_id) with both sides' keys as a_* and b_*; missing records give empty keys."""
    left = entities.where(F.col("source") == anchor).select(F.col("id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in USED])
    right = entities.where(F.col("source") != anchor).select("source", F.col("id").alias("cand_id"), *[F.col(c).alias(f"b_{c}") for c in USED])
    out = pairs.join(left, "s1_id", "left").join(right, ["source", "cand_id"], "left")
    return out.fillna("", [f"{x}_{c}" for x in "ab" for c in USED])


def _flag(x: Column) -> Column:
    return F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))


def _both(c: str) -> Column:
    return (F.col(f"a_{c}") != "") & (F.col(f"b_{c}") != "")


def _same(c: str) -> Column:
    return (F.col(f"a_{c}") != "") & (F.col(f"a_{c}") == F.col(f"b_{c}"))


def _differ(c: str) -> Column:
    return _both(c) & (F.col(f"a_{c}") != F.col(f"b_{c}"))


def _edit(c: str, default: float) -> Column:
    a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
    return F.when(_both(c), 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(default))


def native_features() -> dict[str, Column]:
    """Features that are column expressions over a_* and b_* alone."""
    a, b = F.col("a_name_root"), F.col("b_name_root")
    la, lb = F.length(a), F.length(b)
    ac, bc = F.col("a_acronym"), F.col("b_acronym")
    delta = F.abs(F.expr("try_cast(a_street_digits AS decimal(38,0))") - F.expr("try_cast(b_street_digits AS decimal(38,0))"))
    ta, tb = (F.array_remove(F.array_distinct(F.split(x, " ")), "") for x in (a, b))
    exact_root, same_digits, same_pin = _same("name_root"), _same("street_digits"), _same("postal_code")
    return {
        "exact_name": _flag(_same("name")),
        "exact_root": _flag(exact_root),
        "lev_root": _edit("name_root", 0.0),
        "len_diff_ratio": F.abs(la - lb) / F.greatest(la, lb, F.lit(1)),
        "acronym_match": _flag(((ac != "") & (b != "") & ((ac == b) | (ac == bc))) | ((bc != "") & (a != "") & (bc == a))),
        "soundex_match": _flag(_same("soundex_first")),
        "consonant_match": _flag(_same("consonant_stem") & (F.length("a_consonant_stem") >= 2)),
        "lev_addr": _edit("addr_std", 0.4),
        "core_addr_lev": _edit("addr_core", 0.4),
        "same_digits": _flag(same_digits),
        "diff_digits": _flag(_differ("street_digits")),
        "digit_num_diff": F.coalesce(F.least(delta, F.lit(50)).cast("double") / 50, F.lit(0.0)),
        "same_unit": _flag(_same("unit_code")),
        "same_pin": _flag(same_pin),
        "diff_pin": _flag(_differ("postal_code")),
        "same_country": _flag(_same("country_std")),
        "pin_and_digits": _flag(same_pin & same_digits),
        "strong_exact_pair": _flag(exact_root & (same_digits | same_pin)),
        "root_contains": _flag((la >= 4) & (lb >= 4) & (F.contains(a, b) | F.contains(b, a))),
        "exact_full_addr": _flag(_same("addr_std")),
        "exact_root_and_pin": _flag(exact_root & same_pin),
        "exact_addr_core": _flag(_same("addr_core") & (F.length("a_addr_core") >= 6)),
        "shared_tokens": F.size(F.array_intersect(ta, tb)) / F.greatest(F.size(F.array_union(ta, tb)), F.lit(1)),
        "adjacent_door_penalty": F.coalesce(_flag(delta.between(1, 4)), F.lit(0.0)),
    }


def with_native(attached: DataFrame) -> DataFrame:
    return attached.withColumns(native_features())


def vector40(attached: DataFrame) -> DataFrame:
    """Pairs with all forty features, as floats, in VECTOR order."""
    df = with_native(attached).withColumn("__k", kernels(tuple(KERNELS)))
    df = df.withColumns({x: F.col(f"__k.{x}") for x in KERNELS})
    df = df.withColumns(
        {
            "translit_flag": _flag((F.col("sort_addr") >= 0.70) & (F.col("same_digits") == 1)),
            "composite": F.greatest("jw_root", "sort_root", "acronym_match") * F.col("sort_addr"),
            "addr_match_score": F.col("sort_addr") * 0.7 + F.col("same_digits") * 0.3,
            "phonetic_addr_composite": F.greatest("soundex_match", "consonant_match") * F.col("sort_addr"),
            "sort_set_diff": F.abs(F.col("sort_root") - F.col("set_root")),
        }
    )
    return df.select("s1_id", "source", "cand_id", *[F.col(x).cast("float").alias(x) for x in VECTOR])


# The second engine

USED_B = ("clean_name", "clean_full_address", "meta_key", "soundex_key", "street_digits_str", "clean_city", "clean_state", "clean_country", "clean_zip", "clean_phone")


#: Pairs whose satellites a task looks up at a time; satellites that it reads at a time; pairs whose features it computes at a time.
LOOKED_UP, SCANNED, COMPUTED = 420_000, 1 << 16, 40_000
#: The second engine's features in order.
FEATURES_B = (
    "name_ratio", "name_token_set", "name_token_sort", "name_partial", "name_jw", "name_len_ratio", "first_token_match", "addr_ratio", "addr_token_set", "addr_jw",
    "name_metaphone_match", "name_soundex_match", "street_num_match", "name_exact", "city_exact", "state_exact", "country_exact", "country_mismatch", "zip_exact",
    "phone_exact", "phone_missing", "is_source2", "blocking_tfidf_sim",
)
#: Those that tell whether a text that both sides have is the same.
SAME_B = {"name_metaphone_match": "meta_key", "name_soundex_match": "soundex_key", "street_num_match": "street_digits_str", **{f"{c}_exact": f"clean_{c}" for c in ("city", "state", "country", "zip", "phone")}}
#: The texts of the other ones that need some; those that are compared by more than being equal.
OWN_B = {"name_len_ratio": "clean_name", "first_token_match": "clean_name", "name_exact": "clean_name", "country_mismatch": "clean_country", "phone_missing": "clean_phone"}
COMPARED_B = ("clean_name", "clean_full_address")


def _similar(name: str, texts: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A kernel of pairs of texts, given by their places; a pair of texts that comes again isn't computed again."""
    f, _, default = KERNELS_B[name]
    pairs, back = np.unique(a.astype(np.int64) * len(texts) + b, return_inverse=True)
    (left, ia), (right, ib) = (np.unique(x, return_inverse=True) for x in (pairs // len(texts), pairs % len(texts)))
    left, right = texts.take(pa.array(left)).to_pylist(), texts.take(pa.array(right)).to_pylist()
    some = np.array([x != "" for x in left], bool)[ia] & np.array([x != "" for x in right], bool)[ib]
    out = np.full(len(pairs), default)
    out[some] = similarities(f.__name__, Texts(left), Texts(right), ia[some], ib[some])
    return out[back]


def _texts_of(wanted: tuple[str, ...]) -> list[str]:
    """The texts that features need, in the order of USED_B."""
    needed = {KERNELS_B[x][1] if x in KERNELS_B else SAME_B.get(x, OWN_B.get(x)) for x in wanted}
    return [c for c in USED_B if c in needed]


def _wanted(only: tuple[str, ...] | None) -> tuple[str, ...]:
    return tuple(x for x in FEATURES_B if only is None or f"feat_{x}" in only)


def texts_of(only: tuple[str, ...] | None) -> list[str]:
    """The texts of a cleaned record that the features of these names need; None: those of all."""
    return _texts_of(_wanted(only))


class _Sides:
    """Anchors and satellites of the pairs of one look-up, with their texts as numbers; the last satellite is the unknown one."""

    def __init__(self, anchors: pa.Table, satellites: pa.Table, wanted: tuple[str, ...]):
        self.wanted, self.n, self.codes, self.empty, self.texts = wanted, anchors.num_rows, {}, {}, {}
        unknown = [pa.array([None], pa.string())]
        self.source = pa.chunked_array([*satellites.column("cand_source").chunks, *unknown]).combine_chunks()
        for c in _texts_of(wanted):
            both = pa.chunked_array([*anchors.column(f"a_{c}").chunks, *satellites.column(f"b_{c}").chunks, *unknown], pa.string())
            self._number(c, pc.fill_null(both, ""))
        words = [t.split(" ", 1)[0] for t in self.texts["clean_name"].to_pylist()] if "first_token_match" in wanted else []
        if words:
            known = {w: i for i, w in enumerate(dict.fromkeys(words))}
            self.codes["first"] = np.array([known[w] for w in words])[self.codes["clean_name"]]
        self.lengths = pc.utf8_length(self.texts["clean_name"]).to_numpy(zero_copy_only=False) if "name_len_ratio" in wanted else None
        self.second = pc.fill_null(pc.equal(self.source, "source2"), False).to_numpy(zero_copy_only=False)

    def _number(self, c: str, texts: pa.ChunkedArray) -> None:
        coded = texts.combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.codes[c] = coded.indices.to_numpy(zero_copy_only=False)
        if c in COMPARED_B:
            self.texts[c] = coded.dictionary
        self.empty[c] = pc.index(coded.dictionary, "").as_py()

    def features(self, a: np.ndarray, b: np.ndarray, sims: np.ndarray) -> dict[str, np.ndarray]:
        code = {c: (self.codes[c][a], self.codes[c][self.n + b]) for c in self.codes}
        both = lambda c: (code[c][0] != self.empty[c]) & (code[c][1] != self.empty[c])
        equal = lambda c: code[c][0] == code[c][1]

        def length_ratio() -> np.ndarray:
            la, lb = (self.lengths[x] for x in code["clean_name"])
            return np.where(both("clean_name"), np.minimum(la, lb) / np.maximum(1, np.maximum(la, lb)), 0.0)

        own = {
            "name_len_ratio": length_ratio,
            "first_token_match": lambda: both("clean_name") & equal("first"),
            "name_exact": lambda: equal("clean_name"),
            "country_mismatch": lambda: both("clean_country") & ~equal("clean_country"),
            "phone_missing": lambda: ~both("clean_phone"),
            "is_source2": lambda: self.second[b],
            "blocking_tfidf_sim": lambda: sims,
        }
        out = {}
        for x in self.wanted:
            if x in KERNELS_B:
                c = KERNELS_B[x][1]
                out[x] = _similar(x, self.texts[c], *code[c])
            else:
                out[x] = both(SAME_B[x]) & equal(SAME_B[x]) if x in SAME_B else own[x]()
        return out


def _anchors(batch: pa.RecordBatch, columns: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The records of a batch's anchors, once where they stand one after another, and the place of each pair's."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return pa.table(batch.take(pa.array(np.flatnonzero(new))).select(columns)), np.cumsum(new) - 1


def _found(path: str, columns: list[str], wanted: tuple[str, ...], schema: pa.Schema):
    """The features of pairs with their anchors' columns: each task takes the satellites it needs from the shared table, as all of
    its pairs would otherwise be shuffled with their texts."""
    none = pa.table({c: pa.array([], pa.string()) for c in columns})

    def found(held: list[tuple]):
        anchors = pa.concat_tables([x for x, _, _, _ in held])
        starts = np.cumsum([0, *(x.num_rows for x, _, _, _ in held)])
        place = np.concatenate([at + n for (_, at, _, _), n in zip(held, starts, strict=False)])
        ids = pa.chunked_array([x for _, _, x, _ in held]).cast(pa.string())
        sims = np.concatenate([pc.fill_null(x.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) for _, _, _, x in held])
        needed = pc.unique(ids)
        # the wanted ids become a hash table once, not once a chunk
        every = [c.column("candidate_id").cast(pa.string()) for c in chunks(path, SCANNED, ["candidate_id"])]
        hits = pc.is_in(pa.chunked_array([x for c in every for x in c.chunks], pa.string()), value_set=needed)
        del every
        right = pa.concat_tables([none, *(c.filter(hits.slice(i * SCANNED, c.num_rows)).select(columns).cast(none.schema) for i, c in enumerate(chunks(path, SCANNED, columns)))])
        numbers = lambda n: pa.array(np.arange(n))
        left = pa.table({"candidate_id": ids, "pair": numbers(len(ids))})
        met = left.join(pa.table({"candidate_id": right.column("candidate_id"), "record": numbers(right.num_rows)}), "candidate_id", join_type="left outer", use_threads=False)
        pair, record = met.column("pair").to_numpy(), pc.fill_null(met.column("record"), right.num_rows).to_numpy()
        # in the order of anchors, whose texts are prepared once for all of their pairs
        order = np.argsort(pair, kind="stable")
        pair, record, sides = pair[order], record[order], _Sides(anchors, right, wanted)
        anchors = anchors.select(["s1_id"])
        del right, met, left, needed, order
        for i in range(0, len(pair), COMPUTED):
            p, r = pair[i : i + COMPUTED], record[i : i + COMPUTED]
            feats = sides.features(place[p], r, sims[p])
            out = [anchors.column("s1_id").take(place[p]), ids.take(p), sides.source.take(r), *(pa.array(feats[x].astype(np.float32)) for x in wanted)]
            yield from pa.table([x.cast(f.type) for x, f in zip(out, schema, strict=True)], schema=schema).combine_chunks().to_batches(max_chunksize=10_000)
        del held[:], sides, anchors, ids
        pa.default_memory_pool().release_unused()

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [c for c in batch.schema.names if c not in ("candidate_id", "tfidf_sim")]
            held.append((*_anchors(batch, names), batch.column("candidate_id"), batch.column("tfidf_sim")))
            n += batch.num_rows
            if n >= LOOKED_UP:
                yield from found(held)
                held, n = [], 0
        if n:
            yield from found(held)

    return run


def features_b(pairs: DataFrame, cleaned: DataFrame, anchor: str = "source1", only: tuple[str, ...] | None = None) -> DataFrame:
    """Pairs (s1_id, candidate_id, tfidf_sim) with the twenty-three feat_* columns; only: with those of these names."""
    wanted, used = _wanted(only), texts_of(only)
    left = cleaned.where(F.col("source") == anchor).select(F.col("id").alias("s1_id"), *[F.col(c).alias(f"a_{c}") for c in used])
    right = cleaned.where(F.col("source") != anchor).select(F.col("id").alias("candidate_id"), F.col("source").alias("cand_source"), *[F.col(c).alias(f"b_{c}") for c in used])
    shared = Shared(cleaned.sparkSession)
    right = shared.keep(right, "satellites")
    df = pairs.select("s1_id", "candidate_id", "tfidf_sim").join(left, "s1_id", "left")
    ids = [StructField(c, StringType()) for c in ("s1_id", "candidate_id", "source")]
    schema = StructType(ids + [StructField(f"feat_{x}", FloatType()) for x in wanted])
    return df.mapInArrow(_found(shared.path("satellites"), right.columns, wanted, to_arrow_schema(schema)), schema)
