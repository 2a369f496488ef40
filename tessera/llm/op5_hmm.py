"""Hidden Markov language model over words.

Training documents give exact counts of words (64-bit hashes stand for words). The OWN commonest words are symbols of
their own, the others share BUCKETS symbols by their last bytes, and the end of a text is a symbol, so the chain's
tables have a fixed size whatever the vocabulary. A word of a bucket has the bucket's probability times
(c + 1) / (C + V + 1), for its count c and the bucket's C tokens of V words; words never seen share the one left over.
So every state's emissions sum to 1 over the known words and one unknown word a bucket.

STATES states start from frequent words that rarely share documents, and Baum-Welch fits them: each round computes
expected counts by forward-backward on every whole training document, sums them per symbol across partitions, and renews
the tables. The exact likelihood of a whole text is the scaled forward recursion over all its symbols. Both go over the
documents of a step side by side, PIECE symbols at a time: the backward pass computes a piece's forward variables again from
the state at its beginning, so that a text's length costs two bytes a symbol and no more. Counts of the KNOWN commonest words (a bound on what is sent)
are looked up where the text is read; those of the other words are joined.

Documents whose crc32(doc_id as text) mod 7 is 2 are held out.

Results: a row per document. Null and empty texts are the end alone; null ids are trained on and not held out;
repeated rows are scored each; without training documents every count is 0 and the tables are even; an empty table
gives no rows; further columns are ignored. Ties in count go to the smaller hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, fold, hash64, mix, steps, table, words

STATES, ROUNDS = 8, 3
OWN, BUCKETS, KNOWN = 1 << 15, 1 << 12, 1 << 20
END = OWN + BUCKETS
SYMBOLS = END + 1
#: Frequent words whose company in documents the states start from; symbols that one step of a worker holds, and of which it
#: has variables at a time.
ANCHORS, STEP, PIECE = 128, 3_000_000, 1 << 17


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' words their hashes and buckets, and where each text's words begin (one more at the end)."""
    flat, at = words(texts)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), at
    d = flat.dictionary_encode()
    names = d.dictionary
    end = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    raw = np.frombuffer(names.buffers()[2], np.uint8)
    tail = np.zeros(len(names), np.uint64)
    for i in range(1, 4):
        j = end[1:] - i
        tail = tail * np.uint64(257) + np.where(j >= end[:-1], raw[np.maximum(j, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    bucket = (mix(tail) % np.uint64(BUCKETS)).astype(np.int64)
    which = np.asarray(d.indices)
    return hash64(names)[which], bucket[which], at


def _count(batches):
    """Words of training texts with their counts."""
    for batch in batches:
        for part in steps(batch):
            h, b, at = hashed(part.column("text"))
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(b[first], pa.int32()), pa.array(c, pa.int64())], ["h", "b", "c"])


@dataclass
class Vocabulary:
    """Bounded tables: the commonest words with their counts and symbols, and what the buckets hold."""

    h: np.ndarray
    c: np.ndarray
    symbol: np.ndarray
    bucket_log: np.ndarray
    unigram: np.ndarray
    tokens: int
    distinct: int
    docs: int
    least: int


def vocabulary(counts: DataFrame, docs: int) -> Vocabulary:
    by = {r.c: r.n for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()}
    tokens, distinct = sum(c * n for c, n in by.items()), sum(by.values())
    least, known = max(by, default=0) + 1, 0
    for c in sorted(by, reverse=True):
        if known + by[c] > KNOWN:
            break
        known, least = known + by[c], c
    top = counts.where(F.col("c") >= least).select("h", "b", "c").toArrow()
    h, b, c = (top.column(x).to_numpy() for x in ("h", "b", "c"))
    order = np.lexsort((h, -c))
    h, b, c = h[order], b[order], c[order]
    symbol = np.where(np.arange(len(h)) < OWN, np.arange(len(h)), OWN + b)
    # tokens and words of each bucket: what is known, less the words with a symbol of their own
    of = {r.b: (r.t, r.v) for r in counts.groupBy("b").agg(F.sum("c").alias("t"), F.count("*").alias("v")).collect()}
    t, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for i, (x, y) in of.items():
        t[i], v[i] = x, y
    t -= np.bincount(b[:OWN], c[:OWN], BUCKETS)
    v -= np.bincount(b[:OWN], minlength=BUCKETS)
    mass = np.concatenate([np.zeros(OWN), t, [docs]])
    mass[: min(OWN, len(c))] = c[:OWN]
    unigram = (mass + 0.5) / (mass.sum() + 0.5 * SYMBOLS)
    by_hash = np.argsort(h.view(np.uint64), kind="stable")
    return Vocabulary(h[by_hash].view(np.uint64), c[by_hash], symbol[by_hash], np.log10(t + v + 1), unigram, tokens + docs, distinct + (docs > 0), docs, least)


SYMBOL_ROW = "row long, doc_id long, held_out boolean, symbols binary, n_words long, known long, base double, within double, rare array<long>"


def _symbols(vocabulary):
    def run(batches):
        v = vocabulary.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in steps(batch):
                h, b, at = hashed(part.column("text"))
                u, back = np.unique(h, return_inverse=True)
                i = np.minimum(np.searchsorted(v.h, u), max(len(v.h) - 1, 0))
                hit = v.h[i] == u if len(v.h) else np.zeros(len(u), bool)
                symbol = np.where(hit, v.symbol[i], -1) if len(v.h) else np.full(len(u), -1)
                count = np.where(hit, v.c[i], 0) if len(v.h) else np.zeros(len(u), np.int64)
                s, c, found = symbol[back], count[back], hit[back]
                s = np.where(s < 0, OWN + b, s)
                log = np.log10(c + 1.0)
                shared = s >= OWN
                inside = np.where(shared, log - v.bucket_log[np.where(shared, s - OWN, 0)], 0.0)
                lists = [np.append(s[x:y], END).astype("<u2").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
                rare_at = np.concatenate([[0], np.cumsum(~found)])[at].astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(rare_at), pa.array(h[~found].view(np.int64)))
                n = len(lists)
                yield pa.record_batch([pa.array(row + np.arange(n)), part.column("doc_id"), part.column("held_out"), pa.array(lists, pa.binary()), pa.array(np.diff(at)), pa.array(total(found.astype(np.int64))), pa.array(total(log)), pa.array(total(inside)), rare], ["row", "doc_id", "held_out", "symbols", "n_words", "known", "base", "within", "rare"])
                row += n

    return run


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states


class Chains:
    """Chains of symbols side by side in time order: place[t] .. place[t + 1] are the t-th symbols of those still running."""

    def __init__(self, chains: list[np.ndarray]):
        size = np.array([len(c) for c in chains], np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.sizes = size = size[self.order]
        live = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        place = np.concatenate([[0], np.cumsum(live)])
        self.symbols = np.empty(int(place[-1]), np.uint16)
        for rank, i in enumerate(self.order.tolist()):
            self.symbols[place[: len(chains[i])] + rank] = chains[i]
        # pieces of whole time steps, PIECE symbols or one step each
        self.live, self.place, self.cuts = live.tolist(), place.tolist(), [0]
        while self.cuts[-1] < len(live):
            at = self.cuts[-1]
            self.cuts.append(max(at + 1, int(np.searchsorted(place, place[at] + PIECE, side="right")) - 1))

    def emissions(self, m: Hmm, piece: int, kind) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a piece and what the states emit there."""
        s = self.symbols[self.place[self.cuts[piece]] : self.place[self.cuts[piece + 1]]].astype(np.int64)
        return s, m.emit.astype(kind)[s] if kind is np.float64 else self.emit32(m)[s]

    def emit32(self, m: Hmm) -> np.ndarray:
        if getattr(self, "_emit32", None) is None:
            self._emit32 = m.emit.astype(np.float32)
        return self._emit32

    def forward(self, m: Hmm, emit: np.ndarray, piece: int, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables of a piece, the scales, and the variables of its last step."""
        alpha, scale = np.empty_like(emit), np.empty(len(emit), emit.dtype)
        start, step, place, live = m.start.astype(emit.dtype), m.step.astype(emit.dtype), self.place, self.live
        base = place[self.cuts[piece]]
        for t in range(self.cuts[piece], self.cuts[piece + 1]):
            lo, n = place[t] - base, live[t]
            a = (start if before is None else before[:n] @ step) * emit[lo : lo + n]
            s = a.sum(axis=1)
            a /= s[:, None]
            alpha[lo : lo + n], scale[lo : lo + n] = a, s
            before = a
        return alpha, scale, before

    def log10(self, m: Hmm) -> np.ndarray:
        """log10 likelihood of each chain, in the order given."""
        out, before = np.zeros(len(self.sizes)), None
        for piece in range(len(self.cuts) - 1):
            _, emit = self.emissions(m, piece, np.float64)
            _, scale, before = self.forward(m, emit, piece, before)
            log, base = np.log10(scale), self.place[self.cuts[piece]]
            for t in range(self.cuts[piece], self.cuts[piece + 1]):
                out[: self.live[t]] += log[self.place[t] - base : self.place[t + 1] - base]
        back = np.empty(len(out))
        back[self.order] = out
        return back

    def expected(self, m: Hmm, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected first states and state pairs; adds the expected states of every symbol to `emissions` (state x symbol)."""
        step, place, live = m.step.astype(np.float32), self.place, self.live
        first, pairs = np.zeros(len(step)), np.zeros(step.shape)
        entry = [None]
        for piece in range(len(self.cuts) - 2):
            entry.append(self.forward(m, self.emissions(m, piece, np.float32)[1], piece, entry[-1])[2])
        behind = None  # emission times backward variable over scale, of the step behind
        for piece in range(len(self.cuts) - 2, -1, -1):
            symbols, emit = self.emissions(m, piece, np.float32)
            alpha, scale, _ = self.forward(m, emit, piece, entry[piece])
            base = place[self.cuts[piece]]
            for t in range(self.cuts[piece + 1] - 1, self.cuts[piece] - 1, -1):
                lo, n = place[t] - base, live[t]
                now = np.ones((n, len(step)), np.float32)
                if behind is not None:
                    k = len(behind)
                    pairs += alpha[lo : lo + k].T @ behind
                    now[:k] = behind @ step.T
                behind = emit[lo : lo + n] * now / scale[lo : lo + n, None]
                alpha[lo : lo + n] *= now
            alpha /= alpha.sum(axis=1, keepdims=True)
            for k in range(len(step)):
                emissions[k] += np.bincount(symbols, alpha[:, k], emissions.shape[1])
            if not piece:
                first = alpha[: live[0]].sum(axis=0).astype(float)
        return first, pairs * step


def _held(batches, most: int = STEP):
    """Lists of symbol arrays of about `most` symbols, with the rows they came from; a longer text makes a list of its own."""

    def joined(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()
        for part in t:
            yield part, [np.frombuffer(x.as_buffer(), "<u2") for x in part.column("symbols")]

    held, n = [], 0
    for batch in batches:
        size = np.asarray(pc.binary_length(batch.column("symbols"))).astype(np.int64) // 2
        ends = np.cumsum(size)
        start = 0
        while start < len(size):
            before = ends[start - 1] if start else 0
            end = max(start + (not held), int(np.searchsorted(ends, before + most - n, side="right")))
            if end > start:
                held.append(batch.slice(start, end - start))
                n += int(ends[end - 1] - before)
            if end < len(size) or n >= most:
                yield from joined(held)
                held, n = [], 0
            start = end
    if held:
        yield from joined(held)


GAMMA = "kind int, s int, " + ", ".join(f"g{k} double" for k in range(STATES))


def _expect(model):
    """Expected counts of a partition: kind 0 emissions by symbol, 1 pairs by first state, 2 first states."""

    def run(batches):
        m = model.value
        emissions, pairs, first = np.zeros((STATES, SYMBOLS)), np.zeros((STATES, STATES)), np.zeros(STATES)
        for _, docs in _held(batches):
            f, p = Chains(docs).expected(m, emissions)
            first, pairs = first + f, pairs + p
        some = np.flatnonzero(emissions.sum(axis=0) > 0)
        rows = [(np.zeros(len(some), int), some, emissions[:, some].T), (np.ones(STATES, int), np.arange(STATES), pairs), (np.full(1, 2), np.zeros(1, int), first[None, :])]
        for kind, s, g in rows:
            yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(s, pa.int32()), *(pa.array(np.ascontiguousarray(g[:, k])) for k in range(STATES))], ["kind", "s", *(f"g{k}" for k in range(STATES))])

    return run


def _company(batches):
    """In how many documents of the partition two of the commonest words meet."""
    met = np.zeros((ANCHORS, ANCHORS))
    for _, docs in _held(batches):
        seen = np.zeros((len(docs), ANCHORS))
        for i, d in enumerate(docs):
            seen[i, d[d < ANCHORS]] = 1
        met += seen.T @ seen
    i, j = np.nonzero(met)
    yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(met[i, j])], ["i", "j", "n"])


def begin(v: Vocabulary, met: np.ndarray) -> Hmm:
    """States start as frequent words that rarely share documents, each with the words it meets."""
    own = np.sqrt(np.maximum(np.diag(met), 1))
    like = met / own[:, None] / own[None, :]
    chosen = [0]
    while len(chosen) < STATES:
        far = like[:, chosen].max(axis=1)
        far[chosen] = np.inf
        far[np.diag(met) < 0.02 * met.max()] += 2
        chosen.append(int(np.argmin(far)))
    emit = np.repeat(v.unigram[:, None], STATES, axis=1)
    emit[:ANCHORS] *= (like[:, chosen] + 0.02) ** 2 * 4 + 0.01
    emit /= emit.sum(axis=0)
    step = np.full((STATES, STATES), 0.02 / (STATES - 1))
    np.fill_diagonal(step, 0.98)
    return Hmm(np.full(STATES, 1 / STATES), step, emit)


def renew(v: Vocabulary, counts: pa.Table) -> Hmm:
    """Tables from expected counts, with a little of the unigram distribution in every state."""
    kind, s = counts.column("kind").to_numpy(), counts.column("s").to_numpy()
    g = np.stack([counts.column(f"g{k}").to_numpy() for k in range(STATES)], axis=1)
    emit, pairs, first = np.zeros((SYMBOLS, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)
    emit[s[kind == 0]] = g[kind == 0]
    pairs[s[kind == 1]] = g[kind == 1]
    first += g[kind == 2].sum(axis=0)
    emit += 50 * v.unigram[:, None]
    pairs += 1
    first += 1
    return Hmm(first / first.sum(), pairs / pairs.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(symbols: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Hmm:
    spark = symbols.sparkSession
    known = symbols.where(~F.col("held_out")).select("symbols")
    pairs = known.mapInArrow(_company, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toArrow()
    met = np.zeros((ANCHORS, ANCHORS))
    met[pairs.column("i").to_numpy(), pairs.column("j").to_numpy()] = pairs.column("n").to_numpy()
    model = begin(v, met)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        sums = known.mapInArrow(_expect(sent), GAMMA).groupBy("kind", "s").agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in range(STATES)))
        model = renew(v, sums.toArrow())
        sent.destroy()
    return model


def _score(model):
    def run(batches):
        m = model.value
        for part, docs in _held(batches):
            keep = [c for c in part.schema.names if c != "symbols"]
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(Chains(docs).log10(m))], [*keep, "chain"])

    return run


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Scores of documents (doc_id, text) by a model of those that aren't held out."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"))
    known = rows.where(~F.col("held_out"))
    counts = scratch.keep(known.select("text").mapInArrow(_count, "h long, b int, c long").groupBy("h").agg(F.first("b").alias("b"), F.sum("c").alias("c")), "counts")
    v = vocabulary(counts, known.count())
    sent = spark.sparkContext.broadcast(v)
    symbols = scratch.keep(rows.mapInArrow(_symbols(sent), SYMBOL_ROW), "symbols")
    model = spark.sparkContext.broadcast(train(symbols, v, rounds))
    rare = symbols.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    rest = counts.where(F.col("c") < v.least).select("h", "c")
    found = rare.join(rest, "h").groupBy("row").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("l"))
    scored = symbols.select("row", "doc_id", "held_out", "symbols", "n_words", "known", "base", "within").mapInArrow(
        _score(model), "row long, doc_id long, held_out boolean, n_words long, known long, base double, within double, chain double"
    )
    n, log = F.col("n_words") + 1, F.coalesce("l", F.lit(0.0))
    end = float(np.log10(v.docs + 1))
    return scored.join(found, "row", "left").select(
        "doc_id",
        "held_out",
        n.alias("n_tokens"),
        (F.col("known") + F.coalesce("k", F.lit(0)) + F.lit(int(v.docs > 0))).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + log + F.lit(end) - n * F.lit(float(np.log10(v.tokens + v.distinct + 1)))).alias("base_score"),
        (F.col("chain") + F.col("within") + log).alias("score"),
    )


def op5_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
