import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import parts, tfidf

NAMES = [f"{x} {y}" for x in ("golden", "royal", "ab abc") for y in ("bake", "baker", "kele", "lemon", "mole", "bake bake", "or", "123")]
ADDRESSES = [f"{d} {s} {10_000 + 37 * d}" for d in (1, 12, 123, 124, 7) for s in ("main", "maison st", "lemon st")]


def _records(rng, n, side):
    return [(f"{side}{i:04}", f"{NAMES[rng.integers(len(NAMES))]} {ADDRESSES[rng.integers(len(ADDRESSES))]}") for i in range(n)]


def test_texts_of_few_parts_are_joined_by_them(spark, monkeypatch):
    """The same rows as without: copies, ties, words and grams that stand twice, words of one side alone, floors."""
    rng = np.random.default_rng(5)
    a = spark.createDataFrame([*_records(rng, 120, "a"), ("none", ""), ("null", None), ("other", "zzz golden")], "id string, text string")
    a = a.withColumn("floor", F.when(F.col("id").endswith("3"), 0.6))
    b = spark.createDataFrame([*_records(rng, 900, "b"), ("none", ""), ("null", None)], "id string, text string")
    own, used = parts.found, []
    monkeypatch.setattr(parts, "found", lambda *x: used.append(own(*x)) or used[-1])
    rows = lambda: sorted(map(tuple, tfidf.top_similar(a, b, 2, 4, 6, 0.3).collect()))
    got = rows()
    monkeypatch.setattr(parts, "MANY", 0)
    want = rows()
    assert used[0] is not None and used[1] is None
    assert len(got) > 600
    # below a floor, pairs may be missing
    low = {i.id for i in a.where("floor is not null").collect()}
    kept = lambda x: [r for r in x if r[0] not in low or r[2] >= 0.6]
    assert kept(got) == kept(want)


@pytest.mark.parametrize("first", [1, 40])
@pytest.mark.parametrize("group", [1, 7, 200])
def test_parts_past_chunks_against_a_product(monkeypatch, group, first):
    monkeypatch.setattr(parts, "FIRST", first)
    rng = np.random.default_rng(group)
    a, b = ([" ".join(sorted(t.split())) for _, t in _records(rng, n, "x")] for n in (150, 700))
    common = pa.array(sorted({w for t in ADDRESSES for w in t.split()} - {"lemon"} | {"golden", "royal"}))
    split = [parts._split(pa.array(b), common), parts._split(pa.array(a), common)]
    names = [pa.array(sorted(set(p.to_pylist()))) for p in split[0]]
    known = sorted({g for t in b for w in t.split() for g in tfidf._of_word(w, 2, 4)})
    code, idf, top = {g: i for i, g in enumerate(known)}, np.sort(rng.random(len(known)))[::-1] * 6 + 1, 5
    codes = lambda rows: pa.array([sorted(code[g] for w in t.split() for g in tfidf._of_word(w, 2, 4) if g in code) for t in rows], pa.list_(pa.int32()))

    def dense(v):
        m = np.zeros((v.n, len(known)))
        m[v.row, v.code] = v.weight
        return m

    of_b, times = tfidf.Vectors(codes(b), idf), rng.integers(1, 4, len(b))
    q, r = (np.array([n.to_pylist().index(x) for x in p.to_pylist()]) for n, p in zip(names, split[0], strict=True))
    spelling = parts.Spelling(names, 2, 4, pa.array(known), idf)
    assert np.array_equal(dense(spelling.vectors(q, r)), dense(of_b))
    block = tfidf.Block(codes(a), idf, top, 0.2)
    best = np.full((len(a), top), -1.0)
    order = np.argsort(np.array(split[1][0].to_pylist()), kind="stable")
    for i in range(0, len(b), 250):
        own = slice(i, i + 250)
        sats = parts.Satellites(spelling, q[own], r[own], of_b.norm[own], times[own])
        for lo in range(0, len(a), group):
            sats.search(block, np.sort(order[lo : lo + group]), i, best)
    anchor, sat, cosine = block.pairs()
    want = np.round(dense(block.a) @ dense(of_b).T, tfidf.DIGITS)
    assert np.abs(want[anchor, sat] - cosine).max() < 2e-9
    got = set(zip(anchor.tolist(), sat.tolist(), strict=True))
    assert len(got) == len(anchor)
    for i, row in enumerate(want):
        least = max(0.2, np.sort(np.repeat(row, times))[::-1][top - 1] + 5e-9)
        assert {(i, int(j)) for j in np.flatnonzero(row >= least)} <= got


def test_words_are_told_apart_by_the_fewest_parts():
    rng = np.random.default_rng(1)
    bags = [f"n{rng.integers(90)} s{d % 5} {d}" for d in rng.integers(0, 50, 3000)]
    words, count = np.unique([w for t in bags for w in t.split()], return_counts=True)
    most = parts.least_common(bags, words.tolist(), count)
    assert len({tuple(w for w in t.split() if count[words == w][0] > most) for t in bags}) + len({tuple(w for w in t.split() if count[words == w][0] <= most) for t in bags}) < 700
