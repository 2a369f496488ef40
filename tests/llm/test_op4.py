import math

import duckdb
import numpy as np
import pytest

from tessera.llm import op4_topk as op

SCHEMA = "vec_id long, embedding array<float>"


def _long(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def brute(rows, k=20, every=20):
    v = []
    for i, e in rows:
        if i is not None and e and all(x is not None and math.isfinite(x) for x in e):
            v.append((i, [_long(math.floor(64 * int(float(np.float32(x))) if abs(x) > 1e15 else 64 * float(np.float32(x)))) for x in e]))
    out = []
    for q, e in v:
        if q % every == 0:
            scored = sorted((-_long(sum(a * b for a, b in zip(e, f))), i) for i, f in v if i != q)[:k]  # noqa: B905
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, **more):
    return sorted(tuple(r) for r in op.top_k(spark.createDataFrame(rows, SCHEMA), **more).collect())


def test_cases(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (20, [1.0, 0.5]), (40, [-1.0]), (7, [0.25, 1e6]), (8, [0.0, 0.0]), (None, [1.0, 1.0]), (60, None), (9, [0.25, 1e6])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


@pytest.mark.parametrize("kind", ["skewed", "ties"])
def test_walks_that_stop_early(spark, kind):
    r = np.random.default_rng(0)
    if kind == "skewed":
        x = r.normal(size=(3000, 4)) * np.exp(r.normal(size=(3000, 1)) * 1.5)
    else:
        x = r.integers(-1, 2, size=(3000, 4)).astype(float)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    assert run(spark, rows) == brute(rows)


def test_threshold_ends_before_the_lists(monkeypatch):
    r = np.random.default_rng(0)
    v = np.floor(64 * r.normal(size=(5000, 3)) * np.exp(r.normal(size=(5000, 1)))).astype(np.int64)
    lists = op.Lists(np.arange(5000), v)
    walked = []
    monkeypatch.setattr(lists, "_seen", lambda q, d, f=lists._seen: walked.append(d) or f(q, d))
    got = lists.top(v[:50], np.arange(50), 20)
    assert lists.ended == 50 and walked and max(walked) < 2500
    for i, (ids, s) in enumerate(got):
        want = sorted((-(v[j] @ v[i]), j) for j in range(5000) if j != i)[:20]
        assert list(zip((-s).tolist(), ids.tolist(), strict=True)) == want
    # a k-th score from elsewhere ends walks before the first place, and loses nothing that reaches it
    walked.clear()
    assert all(not len(ids) for ids, _ in lists.top(v[:50], np.arange(50), 20, np.full(50, 1e12))) and not walked
    kth = np.array([s[9] for _, s in got], float)
    for (ids, s), (few, t) in zip(got, lists.top(v[:50], np.arange(50), 20, kth), strict=True):
        assert few.tolist()[:10] == ids.tolist()[:10] and set(t[t >= s[9]]) == set(s[s >= s[9]])


def test_huge_components(spark):
    big = [3.4e38, -3.4e38, 2.0**58, 2.0**57, -(2.0**57), 2.0**40, 2.0**31, 1.0, -1.0, 0.0]
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.choice(big, 3)]) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 1, 2, True, 9) for i in range(30)], SCHEMA + ", cb int, qb int, query boolean, least long")
    assert sorted(tuple(r) for r in op.top_k(df).collect()) == brute([(i, [float(i), 1.0]) for i in range(30)])


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_oracle(spark, sf):
    d = f"/root/testdata/{sf}"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op.op4_topk_threshold(spark, d).collect()) == sorted(c.execute(op.ORACLE).fetchall())


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 50)
    monkeypatch.setattr(op, "QUERIES", 5)
    r = np.random.default_rng(1)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(r.normal(size=(600, 6)))]
    assert run(spark, rows) == brute(rows)
