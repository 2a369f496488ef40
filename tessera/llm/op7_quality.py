"""Document quality by a linear-chain conditional random field over lines.

Every line that isn't blank gets features of itself and of the lines before and behind it (shares of signs, capitals,
digits and repeated words, word lengths, endings, as soft steps). A two-label chain (good, bad) is fitted by gradient
ascent on the likelihood of labelled documents, whose lines all bear the document's label. Forward-backward marginals
of a document's lines, weighted by line length, give its share of good text, and a logistic curve fitted on the same
documents turns the share into the probability of label 1. The fit takes TRAIN_DOCS labelled documents of TRAIN_LINES
lines together at most (in the order of a hash of the id; one that would exceed the lines is passed over, and of copies one
counts); their features, not their texts, go to the driver. Scores cover every whole text.

Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0. Labels, lang, source and doc_id are no inputs
of a score.

Results: one row per document. Null, empty and blank texts have no lines and get the labels' mean as score; with no
labels at all, or labels of one kind, every score is that mean (0.5 without labels). Documents with several labels
count as bad if one of them is; null ids are not held out; repeated rows are scored each;
no documents give no rows; further columns are ignored. A score of exactly 0.3 predicts 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fold, hash64, steps, table, words

#: Labelled documents and lines that the fit takes at most, and steps of gradient ascent.
TRAIN_DOCS, TRAIN_LINES, ROUNDS = 4000, 100_000, 150
CUT = 0.3
#: Kinds of bytes: capital, small letter, digit, blank, sentence sign, other sign, other byte.
_KIND = np.full(256, 6, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:?'\"-()" else 5
#: Steps of each measure at which a soft indicator rises.
STEPS = {
    "bytes": (20, 60, 150, 400, 1200),
    "words": (2, 5, 12, 40),
    "word_length": (2.5, 4, 6, 8, 11),
    "capitals": (0.02, 0.1, 0.3, 0.7),
    "digits": (0.02, 0.1, 0.3),
    "signs": (0.01, 0.05, 0.15, 0.3),
    "stops": (0.005, 0.03, 0.08),
    "other": (0.02, 0.1, 0.3),
    "distinct": (0.2, 0.4, 0.6, 0.8, 0.95),
    "again": (0.02, 0.1, 0.4, 0.8),
    "bare": (0.1, 0.3, 0.6),
    "ends": (0.5,),
    "starts": (0.5,),
}
WIDTH = sum(map(len, STEPS.values()))


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines that aren't blank, and where each text's begin (one more at the end)."""
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    parts = pa.concat_arrays([parts])
    at = np.asarray(parts.offsets, dtype=np.int64)
    flat = pc.ascii_trim_whitespace(parts.values.slice(at[0], at[-1] - at[0]))
    full = np.asarray(pc.binary_length(flat)) > 0
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[at - at[0]]


def measures(lines: pa.Array) -> dict[str, np.ndarray]:
    n = len(lines)
    if not n:
        return {k: np.zeros(0) for k in STEPS}
    lines = pa.concat_arrays([lines])
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(lines.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    size = np.diff(at)
    kind = _KIND[raw]
    share = [np.add.reduceat(kind == k, at[:-1], dtype=np.int64) / size for k in range(7)]
    flat, of = words(lines)
    count = np.diff(of)
    ids = hash64(flat)
    line = np.repeat(np.arange(n), count)
    order = np.lexsort((ids, line)) if len(ids) < 2 else np.argsort((line.astype(np.uint64) << np.uint64(40)) | (ids >> np.uint64(24)), kind="stable")
    a, b = line[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    distinct = np.bincount(a[new], minlength=n) / np.maximum(count, 1)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (line[1:] == line[:-1])
    again = np.bincount(line[same], minlength=n) / np.maximum(count, 1)
    length = np.asarray(pc.binary_length(flat)).astype(np.int64)
    signs = np.asarray(pc.match_substring_regex(flat, r"^[^0-9A-Za-z\x80-\x{10ffff}]+$")) if len(flat) else np.zeros(0, bool)
    last, first = raw[at[1:] - 1], kind[at[:-1]]
    return {
        "bytes": size,
        "words": count,
        "word_length": np.bincount(line, length, n) / np.maximum(count, 1),
        "capitals": share[0] / np.maximum(share[0] + share[1], 1e-9),
        "digits": share[2],
        "signs": share[5],
        "stops": share[4],
        "other": share[6],
        "distinct": np.where(count > 3, distinct, 1.0),
        "again": again,
        "bare": np.bincount(line[signs], minlength=n) / np.maximum(count, 1),
        "ends": np.isin(last, np.frombuffer(b".!?", np.uint8)).astype(float),
        "starts": ((first == 0) | (first == 6)).astype(float),
    }


def features(lines: pa.Array) -> np.ndarray:
    """Soft indicators of each line."""
    m = measures(lines)
    cols = []
    for name, cuts in STEPS.items():
        for c in cuts:
            x = np.asarray(m[name], float)
            cols.append(1 / (1 + np.exp(-8 * np.clip((x - c) / c, -4, 4))))
    return np.stack(cols, axis=1).astype(np.float32) if cols else np.zeros((len(lines), 0), np.float32)


def with_neighbours(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A constant, and each line's features with those of the lines before and behind it in its text."""
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    first, last = at[:-1][np.diff(at) > 0], at[1:][np.diff(at) > 0] - 1
    before[first], behind[last] = 0, 0
    return np.concatenate([np.ones((len(x), 1), x.dtype), x, before, behind], axis=1)


def marginals(score: np.ndarray, step: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of chains with unary log odds `score` for label 1 and label-pair scores `step`: P(label 1) of each line, expected
    label pairs, and the log partition sum. Chains run side by side, the longest first."""
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], at[:-1][order]
    chains = int((size > 0).sum())
    size, first = size[:chains], first[:chains]
    p, pairs, total = np.zeros(len(score)), np.zeros((2, 2)), 0.0
    if not chains:
        return p, pairs, total
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    e = np.exp(step)
    alpha = np.zeros((len(score), 2))
    scale = np.zeros(len(score))
    u = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], axis=1)
    for t, n in enumerate(live.tolist()):
        i = first[:n] + t
        a = u[i] if t == 0 else (alpha[i - 1] @ e) * u[i]
        s = a.sum(axis=1)
        alpha[i], scale[i] = a / s[:, None], s
    total = float(np.log(scale).sum())
    beta = np.ones((len(score), 2))
    for t in range(len(live) - 1, -1, -1):
        n = int(live[t])
        i = first[:n] + t
        more = int(live[t + 1]) if t + 1 < len(live) else 0
        if more:
            j = i[:more]
            b = (u[j + 1] * beta[j + 1]) / scale[j + 1][:, None]
            pairs += np.einsum("na,nb,ab->ab", alpha[j], b, e)
            beta[j] = b @ e.T
    g = alpha * beta
    return g[:, 1] / g.sum(axis=1), pairs, total


@dataclass
class Model:
    weights: np.ndarray
    step: np.ndarray
    slope: float
    shift: float
    mean: float

    def shares(self, lines: pa.Array, at: np.ndarray) -> np.ndarray:
        """Length-weighted share of good text; nan without lines."""
        return self._shares(features(lines), np.asarray(pc.binary_length(lines)), at)

    def _shares(self, x: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
        p, _, _ = marginals(with_neighbours(x, at) @ self.weights, self.step, at)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        n = np.bincount(doc, size, len(at) - 1)
        return np.where(n > 0, np.bincount(doc, p * size, len(at) - 1) / np.maximum(n, 1), np.nan)

    def scores(self, share: np.ndarray) -> np.ndarray:
        s = 1 / (1 + np.exp(-(self.slope * np.nan_to_num(share, nan=0.5) + self.shift)))
        return np.where(np.isnan(share), self.mean, s)


def fit(x: np.ndarray, size: np.ndarray, at: np.ndarray, label: np.ndarray) -> Model:
    """Gradient ascent (Adam) on the mean log-likelihood of the labelled chains, with a small quadratic penalty."""
    mean = float(label.mean()) if len(label) else 0.5
    width = 3 * WIDTH + 1
    flat = Model(np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))), mean)
    if len(set(label.tolist())) < 2 or not len(x):
        return flat
    y = np.repeat(label, np.diff(at)).astype(float)
    full = with_neighbours(x, at).astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    now = y[np.flatnonzero(inner)].astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (now, now), 1)
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for i in range(1, ROUNDS + 1):
        w, step = theta[:width], theta[width:].reshape(2, 2)
        p, pairs, _ = marginals(full @ w, step, at)
        g = np.concatenate([full.T @ (y - p), (seen - pairs).ravel()]) / len(label) - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    model = Model(theta[:width], theta[width:].reshape(2, 2), 1.0, 0.0, mean)
    share = model._shares(x, size, at)
    ok = ~np.isnan(share)
    z, target = share[ok], label[ok]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a penalised logistic fit
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = target - q, q * (1 - q) + 1e-9
        grad = np.array([(r * z).sum() - 0.01 * a, r.sum()])
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(hess, grad)
        a, b = a + np.clip(d[0], -2, 2), b + np.clip(d[1], -2, 2)
    model.slope, model.shift = float(a), float(b)
    return model


def _line_features(batches):
    for batch in batches:
        for part in steps(batch):
            lines, at = lines_of(part.column("text"))
            x = features(lines)
            size = np.asarray(pc.binary_length(lines)).astype("<i8")
            rows = [(x[a:b].tobytes(), size[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([part.column("doc_id"), part.column("label"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "label", "x", "size"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Model:
    known = labels.where("doc_id is not null and quality is not null").where(fold("doc_id", 5) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(_line_features, "doc_id long, label int, x binary, size binary")
    rows = Scratch(docs.sparkSession).keep(rows.withColumn("copy", F.xxhash64("x", "size")).withColumn("n", F.length("size") / 8), "features")
    sizes = rows.groupBy("doc_id", "copy").agg(F.max("n").cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "copy").limit(most).collect()
    taken, total = [], 0
    for r in sizes:
        if total + r.n <= most_lines:
            taken.append((r.doc_id, r.copy))
            total += r.n
    kept = docs.sparkSession.createDataFrame(taken, "doc_id long, copy long")
    rows = rows.join(F.broadcast(kept), ["doc_id", "copy"]).dropDuplicates(["doc_id", "copy"]).select("label", "x", "size").collect()
    rows = sorted(rows, key=lambda r: (r.label, r.x))
    x = np.concatenate([np.zeros((0, WIDTH), np.float32), *(np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows)])
    size = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(r.size, "<i8") for r in rows)])
    at = np.concatenate([[0], np.cumsum([len(r.size) // 8 for r in rows])]).astype(np.int64)
    return fit(x, size, at, np.array([r.label for r in rows], float))


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in steps(batch):
                lines, at = lines_of(part.column("text"))
                share = m.shares(lines, at)
                others = [part.column(i) for i, c in enumerate(part.schema.names) if c != "text"]
                score = m.scores(share)
                yield pa.record_batch([*others, pa.array(score), pa.array(np.diff(at), pa.int64())], [*(c for c in part.schema.names if c != "text"), "score", "n_lines"])

    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines) of documents (doc_id, text), by labels (doc_id, quality)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(model), "doc_id long, score double, n_lines long")
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_lines")


def _keep(model):
    def run(batches):
        m = model.value
        for batch in batches:
            for part in steps(batch):
                lines, at = lines_of(part.column("text"))
                yield part.filter(pa.array(m.scores(m.shares(lines, at)) >= CUT))

    return run


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are predicted 1; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return docs.mapInArrow(_keep(model), docs.schema)


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
