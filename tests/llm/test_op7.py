import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import op7_quality as op

SCHEMA = "doc_id long, text string"


def labelled(n):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        line = "BUY!! NOW!! CHEAP!! " * 6 if bad else f"This is a calm sentence number {i}, with ordinary words in it."
        rows.append((i, "\n".join([line] * (1 + i % 3))))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def run(spark, rows, labels):
    out = op.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.doc_id, r.n_lines): r for r in out}, out


def test_cases(spark):
    rows, labels = labelled(200)
    more = [(1000, None), (1001, ""), (1002, " \n\t"), (None, "plain words here."), (1003, "WIN!! " * 40000), (1004, "x\n" * 20000), (3, rows[3][1])]
    got, out = run(spark, rows + more, labels + [(None, 1, 0), (5, None, 0)])
    assert len(out) == len(rows) + len(more)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    truth = {i: q for i, q, _ in labels}
    assert all(r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth)
    empty = {r.score for r in out if r.n_lines == 0}
    assert len(empty) == 1 and 0.6 < empty.pop() < 0.9


def test_without_labels(spark):
    _, out = run(spark, [(1, "a"), (2, None)], [])
    assert [r.score for r in out] == [0.5, 0.5]
    _, out = run(spark, [], [])
    assert out == []


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    at = np.array([0, 3, 3, 4, 9])
    score, step = r.normal(size=9), r.normal(size=(2, 2))
    p, pairs, total = op.marginals(score, step, at)
    want_p, want_pairs, want = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(at[:-1], at[1:], strict=True):
        if a == b:
            continue
        z, each = 0.0, []
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + i] for i in range(b - a) if y[i]) + sum(step[y[i], y[i + 1]] for i in range(b - a - 1)))
            z += w
            each.append((y, w))
        for y, w in each:
            want_p[a:b] += np.array(y) * w / z
            for i in range(b - a - 1):
                want_pairs[y[i], y[i + 1]] += w / z
        want += np.log(z)
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs) and np.isclose(total, want)


def test_neighbours_stay_in_their_text():
    x = np.arange(6, dtype=np.float32).reshape(6, 1) + 1
    got = op.with_neighbours(x, np.array([0, 2, 2, 6]))
    assert got.tolist() == [[1, 1, 0, 2], [1, 2, 1, 0], [1, 3, 0, 4], [1, 4, 3, 5], [1, 5, 4, 6], [1, 6, 5, 0]]


def test_lines():
    lines, at = op.lines_of(pa.array(["a\n\n b ", None, "", "c"]))
    assert lines.to_pylist() == ["a", "b", "c"] and at.tolist() == [0, 2, 2, 2, 3]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in op.op7_quality_crf(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 300 and np.mean([p == t for p, t in held]) > 0.97


def plain_measures(line):
    raw = line.encode()
    kind = lambda b: 6 if b > 127 else 0 if chr(b).isupper() else 1 if chr(b).islower() else 2 if chr(b).isdigit() else 3 if chr(b).isspace() else 4 if chr(b) in ".,;:?'\"-()" else 5
    kinds = [kind(b) for b in raw]
    share = [kinds.count(k) / len(raw) for k in range(7)]
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
    n = max(len(w), 1)
    return {
        "bytes": len(raw), "words": len(w), "word_length": sum(len(x.encode()) for x in w) / n, "capitals": share[0] / max(share[0] + share[1], 1e-9), "digits": share[2],
        "signs": share[5], "stops": share[4], "other": share[6], "distinct": len(set(w)) / n if len(w) > 3 else 1.0, "again": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        "bare": sum(not re.search(r"[0-9A-Za-z\x80-\U0010ffff]", x) for x in w) / n, "ends": float(raw[-1:] in (b".", b"!", b"?")), "starts": float(kinds[0] in (0, 6)),
    }


def plain_score(model, text):
    """A document's score from the fitted weights: features of each line and its neighbours, the chain's marginals in logs."""
    lines = [x for x in ((t or "").strip(" \t\n\r\x0b\x0c") for t in (text or "").split("\n")) if x]
    if not lines:
        return model.mean
    own = [[1 / (1 + math.exp(-8 * min(max((m[k] - c) / c, -4), 4))) for k, cuts in op.STEPS.items() for c in cuts] for m in map(plain_measures, lines)]
    none = [0.0] * op.WIDTH
    full = [[1.0, *own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none)] for i in range(len(own))]
    unary = [[0.0, min(max(sum(a * b for a, b in zip(f, model.weights.tolist(), strict=True)), -30), 30)] for f in full]
    alpha, beta = [unary[0]], [[0.0, 0.0]]
    for u in unary[1:]:
        alpha.append([u[j] + np.logaddexp(alpha[-1][0] + model.step[0, j], alpha[-1][1] + model.step[1, j]) for j in (0, 1)])
    for u in unary[:0:-1]:
        beta.append([np.logaddexp(model.step[i, 0] + u[0] + beta[-1][0], model.step[i, 1] + u[1] + beta[-1][1]) for i in (0, 1)])
    beta.reverse()
    good = [1 / (1 + math.exp(min(a[0] + b[0] - a[1] - b[1], 700))) for a, b in zip(alpha, beta, strict=True)]
    size = [len(x.encode()) for x in lines]
    return 1 / (1 + math.exp(-(model.slope * sum(g * n for g, n in zip(good, size, strict=True)) / sum(size) + model.shift)))


def test_scores_of_the_whole_table_against_plain_sums(spark, monkeypatch):
    d, kept = "/root/testdata/sf0.01", {}
    monkeypatch.setattr(op, "train", lambda *a, f=op.train: kept.setdefault("model", f(*a)))
    got = op.op7_quality_crf(spark, d).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - plain_score(kept["model"], texts[r.doc_id])) < 2e-3, r
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_the_fit_holds_its_bounds(spark, monkeypatch):
    rows, labels = labelled(200)
    seen = []
    monkeypatch.setattr(op, "fit", lambda x, size, at, label, f=op.fit: seen.append((len(x), len(label))) or f(x, size, at, label))
    docs = spark.createDataFrame([*rows, *rows, (7, "x\n" * 5000)], SCHEMA)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    op.train(docs, known)
    op.train(docs, known, 50, 60)
    (lines, n), (few, m) = seen
    assert m <= 50 and few <= 60 < lines
    assert n == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in rows) + (zlib.crc32(b"7") % 5 != 0)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "A line.", 1, "x", 2, 0.5) for i in range(9)], SCHEMA + ", label int, x string, copy int, score double")
    labels = spark.createDataFrame([(i, i % 2, "t") for i in range(9)], "doc_id long, quality int, text string")
    assert len(op.quality(docs, labels).collect()) == 9
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns and all(r.score == 0.5 for r in kept.collect())
