import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import op5_hmm as op

SCHEMA = "doc_id long, text string"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        w = tokens(t)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def check(got, rows):
    got = sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens, r.score))
    want = sorted(base(rows), key=lambda r: (str(r[0]), r[2]))
    assert [tuple(r)[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r.base_score for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("known", [1 << 20, 3])
def test_cases(spark, monkeypatch, known):
    monkeypatch.setattr(op, "KNOWN", known)
    rows = [(1, None), (2, ""), (3, "A a b"), (4, "b\x0bB c  c\n"), (None, "a q"), (5, "w " * 3000), (3, "A a b"), *((i, f"a b c d{i % 5} e{i}") for i in range(10, 60))]
    got = op.score(spark.createDataFrame(rows, SCHEMA)).collect()
    check(got, rows)
    assert all(r.score < 0 for r in got)


def test_empty(spark):
    assert op.score(spark.createDataFrame([], SCHEMA)).collect() == []


def random_model(r):
    k = op.STATES
    return op.Hmm(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(op.SYMBOLS), k).T)


def plain(m, d):
    """log10 likelihood, expected pairs and states of one chain, without scaling tricks: in logs."""
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    start, step, emit = np.log(m.start), np.log(m.step), np.log(m.emit[d.astype(int)])
    alpha, beta = [start + emit[0]], [np.zeros(op.STATES)]
    for e in emit[1:]:
        alpha.append(lse(alpha[-1][:, None] + step, 0) + e)
    for e in emit[:0:-1]:
        beta.append(lse(step + (e + beta[-1])[None, :], 1))
    beta = beta[::-1]
    p = lse(alpha[-1], 0)
    pairs = sum((np.exp(alpha[t][:, None] + step + (emit[t + 1] + beta[t + 1])[None, :] - p) for t in range(len(d) - 1)), np.zeros(step.shape))
    return p / np.log(10), pairs, np.exp(np.array(alpha) + np.array(beta) - p)


@pytest.mark.parametrize("piece", [1, 7, 1 << 17])
def test_forward_backward_against_plain_recursion(monkeypatch, piece):
    """Whole chains, whatever the pieces they are computed in."""
    monkeypatch.setattr(op, "PIECE", piece)
    r = np.random.default_rng(0)
    k, m = op.STATES, random_model(r)
    docs = [r.integers(0, op.SYMBOLS, n).astype(np.uint16) for n in (5, 1, 40, 17, 40, 700)]
    want = [plain(m, d) for d in docs]
    c = op.Chains(docs)
    assert np.allclose(c.log10(m), [w[0] for w in want])
    mine, by_symbol = np.zeros((k, op.SYMBOLS)), np.zeros((op.SYMBOLS, k))
    first, pairs = c.expected(m, mine)
    assert np.allclose(pairs, sum(w[1] for w in want), rtol=1e-3) and np.allclose(first, sum(w[2][0] for w in want), rtol=1e-3)
    for d, w in zip(docs, want, strict=True):
        np.add.at(by_symbol, d, w[2])
    assert np.allclose(mine.T, by_symbol, rtol=1e-3, atol=1e-5)


def test_steps_hold_every_row_once():
    sizes = [3, 1, 900, 2, 2, 50, 1, 400, 400, 7]
    rows = [np.full(n, i, "<u2").tobytes() for i, n in enumerate(sizes)]
    batches = [pa.record_batch([pa.array(rows[a:b], pa.binary()), pa.array(range(a, b))], ["symbols", "row"]) for a, b in ((0, 4), (4, 5), (5, 10))]
    for most in (1, 10, 60, 800, 10_000):
        steps = [(part.column("row").to_pylist(), docs) for part, docs in op._held(batches, most)]
        assert [r for rows_, _ in steps for r in rows_] == list(range(10))
        assert all([len(d) for d in docs] == [sizes[i] for i in ids] and all((d == i).all() for i, d in zip(ids, docs, strict=True)) for ids, docs in steps)
        assert all(sum(map(len, docs)) <= most or len(docs) == 1 for _, docs in steps)


def test_scores_against_plain_recursion(spark, monkeypatch):
    """Every document's score from the fitted tables, by words, counts and an unscaled recursion of its own."""
    kept = {}
    monkeypatch.setattr(op, "train", lambda *a, f=op.train, **b: kept.setdefault("m", f(*a, **b)))
    monkeypatch.setattr(op, "vocabulary", lambda *a, f=op.vocabulary: kept.setdefault("v", f(*a)))
    r = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in r.zipf(1.3, r.integers(0, 60)) % 500)) for i in range(150)] + [(200 + i, " ".join(f"x{j}" for j in range(i * 900, i * 900 + 1000))) for i in range(45)] + [(500, None), (501, "new unseen words"), (501, "new unseen words")]
    got = op.score(spark.createDataFrame(rows, SCHEMA + "")).collect()
    m, v = kept["m"], kept["v"]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t) if w)
    h, b, _ = op.hashed(pa.array([" ".join(count)]))
    of = dict(zip([w for w in " ".join(count).split()], zip(h.tolist(), b.tolist(), strict=True), strict=True))
    own = sorted(count, key=lambda w: (-count[w], np.uint64(of[w][0]).astype(np.int64)))[: op.OWN]
    symbol = {w: i for i, w in enumerate(own)} | {w: op.OWN + of[w][1] for w in count if w not in own}
    mass, kinds = Counter(), Counter()
    for w, c in count.items():
        if w not in own:
            mass[of[w][1]] += c
            kinds[of[w][1]] += 1
    want = []
    for i, t in rows:
        chain, inside = [], 0.0
        for w in tokens(t)[:-1]:
            bucket = of[w][1] if w in of else int(op.hashed(pa.array([w]))[1][0])
            s = symbol.get(w, op.OWN + bucket)
            chain.append(s)
            if s >= op.OWN:
                inside += math.log10((count[w] + 1) / (mass[bucket] + kinds[bucket] + 1))
        want.append((str(i), plain(m, np.array([*chain, op.END]))[0] + inside))
    assert np.allclose([x[1] for x in sorted((str(r.doc_id), r.score) for r in got)], [x[1] for x in sorted(want)], rtol=1e-9)
    assert v.docs == sum(not held(i) for i, _ in rows)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a b c", 1, "x", 2.0, 3) for i in range(20)], SCHEMA + ", row long, symbols string, base double, h long")
    assert len(op.score(df).collect()) == 20


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = op.op5_hmm_scoring(spark, d).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and np.mean([r.score > r.base_score for r in held]) > 0.9
