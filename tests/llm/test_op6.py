import itertools
import re

import pytest

from tessera.llm import op6_jaccard as op

SCHEMA = "doc_id long, text string"


def brute(rows, k=3, percent=90):
    sets = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(i)
    seen = {p for v in index.values() for p in itertools.combinations(sorted(v), 2)}
    for a, b in seen:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def run(spark, rows):
    out = op.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(tuple(r) for r in out)


def varied(n, seed=0):
    import random

    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    return rows


def test_cases(spark):
    long = " ".join(f"t{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "two one"), (8, long), (9, long + " end"), (10, "a b c d"), (11, "a b c d"), (12, "a\x0bb  c\nd"), (13, "É b c"), (14, "é b c")]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("block", [1024, 16])
def test_near_copies(spark, block, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "HEAVY", 8)
    rows = varied(150) + [(1000 + i, t) for i, t in varied(60, 1)] + [(2000 + i, t) for i, t in varied(40)]
    assert run(spark, rows) == brute(rows)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op.op6_jaccard_join(spark, d).collect()) == brute(rows)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, n int, token string")
    assert sorted(tuple(r) for r in op.jaccard_components(df).collect()) == [(1, 1, 1), (2, 1, 1)]
