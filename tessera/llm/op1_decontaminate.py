"""Benchmark decontamination by CGK embeddings.

Texts become words (A-Z lower-cased, ASCII punctuation at both ends removed, words of nothing else left out). An item
of m words leaks into a document when the document holds words within `m * edits` word edits of it.

A CGK random walk (Chakraborty, Goldenberg, Koucky 2016) reads a window one word at a time, moving on or staying by a
random bit of (step, word); the words it reads are its embedding, in which few edits stay few differences. For each
item length, keys sample SAMPLED positions of the walk over a window of that length; equal keys are candidates, and
every candidate is verified by an exact edit distance (Myers' bit vectors, free ends in the document). WALKS x KEYS
repetitions reach the target recall, which the tests measure. A window within the edits shares so many q-word
shingles with its item that windows with fewer of them can't match and are not embedded (q is 3, less for items so
short that 3 words in a row needn't be left); the shingles' filter is a bitmap of fixed size. Items too short for an
edit are looked up as they are, by the hash of all their words, whatever their length.

The documents are scanned once for each block of items and never shuffled; a block is bounded in items, so that what
is broadcast is bounded too, and a larger benchmark takes more blocks. Items of equal words are one. Candidates are
verified PAIRS at a time.

Results: a row for each document and item that leaks: doc_id, item_id, distance (least edits), item_words, start (of
the window's first word). Ties in distance go to the first place. Null, empty and wordless texts leak nothing, as items
and as documents; null ids are carried; repeated rows give repeated results; empty tables give none; further columns are
ignored, or kept by without_leaks().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import hash64, mix, steps, table, words

#: Words of a shingle at most.
Q = 3
#: Repetitions and positions in a key.
WALKS, KEYS, SAMPLED = 6, 4, 2
#: Bits of the shingle filter; items in a block; candidates verified at once.
FILTER_BITS, BLOCK_ITEMS, PAIRS = 1 << 24, 50_000, 1 << 20
#: Word edits of a leak, as a share of the item's words.
EDITS = 0.2
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the texts' words, and where each text's begin (one more at the end)."""
    flat, at = words(texts)
    if not len(flat):
        return np.zeros(0, np.uint64), at
    d = flat.dictionary_encode()
    bare = pc.ascii_trim(d.dictionary, characters=PUNCTUATION)
    which = np.asarray(d.indices)
    full = (np.asarray(pc.binary_length(bare)) > 0)[which]
    ids = hash64(bare)[which]
    return (ids, at) if full.all() else (ids[full], np.concatenate([[0], np.cumsum(full)])[at])


def edits_of(m: int, edits: float) -> int:
    return min(int(m * edits + 1e-9), m - 1)


def shingles(ids: np.ndarray, q: int) -> np.ndarray:
    if len(ids) < q:
        return np.zeros(0, np.uint64)
    h = ids[: len(ids) - q + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, q):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - q + 1 + i])
    return h


def walk(ids: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, steps_: int) -> np.ndarray:
    """Embeddings of ids[start:end] for each pair; zeros once a window is read to its end."""
    out = np.zeros((steps_, len(start)), np.uint64)
    at = start.copy()
    with np.errstate(over="ignore"):
        for j in range(steps_):
            live = at < end
            w = np.where(live, ids[np.minimum(at, len(ids) - 1)], np.uint64(0))
            out[j] = w
            bit = mix(w ^ np.uint64((seed * 1_000_003 + j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) & np.uint64(1)
            at = at + (bit.astype(bool) & live)
    return out


class Block:
    """What a scan needs of items (names, words, edits) that share a shingle length: key tables and the shingle filter."""

    def __init__(self, items: list[tuple], q: int):
        self.q = q
        self.names, self.words, self.edits = ([x[k] for x in items] for k in range(3))
        size = np.array([len(w) for w in self.words], np.int64)
        self.lengths = np.unique(size)
        self.least = min(len(w) - q + 1 - q * e for w, e in zip(self.words, self.edits, strict=True))
        self.reach = max(len(w) + e for w, e in zip(self.words, self.edits, strict=True))
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for w in self.words:
            h = (shingles(w, q) % np.uint64(FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
        self.bits = bits
        rng = np.random.default_rng(20160619)
        self.sample = {int(n): [[np.sort(rng.choice(max(SAMPLED, 2 * int(n)), SAMPLED, replace=False)) for _ in range(KEYS)] for _ in range(WALKS)] for n in self.lengths}
        flat = np.concatenate(self.words)
        start = np.cumsum(size) - size
        self.keys = []
        owners = np.arange(len(size))
        for r in range(WALKS):
            seen = walk(flat, start, start + size, r, 2 * int(size.max()))
            for n in self.lengths.tolist():
                own = owners[size == n]
                self.keys.append([self._sorted(self.key(seen[:, own], n, r, k), own) for k in range(KEYS)])

    def key(self, seen: np.ndarray, n: int, r: int, k: int) -> np.ndarray:
        h = np.full(seen.shape[1], (n * WALKS + r) * KEYS + k, np.uint64)
        with np.errstate(over="ignore"):
            for p in self.sample[n][r][k]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + seen[p])
        return h

    @staticmethod
    def _sorted(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h, kind="stable")
        return h[order], own[order]

    def starts(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a window may begin, and the ends of their texts: enough filtered shingles lie within reach."""
        none = np.zeros(0, np.int64)
        if len(ids) < self.q:
            return none, none
        h = (shingles(ids, self.q) % np.uint64(FILTER_BITS)).astype(np.int64)
        hit = (self.bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1
        hits = np.flatnonzero(hit)
        if not len(hits):
            return none, none
        doc = np.searchsorted(at, hits, side="right") - 1
        keep = hits + self.q <= at[doc + 1]
        hits, doc = hits[keep], doc[keep]
        # a window that begins at s and holds `least` hits begins within reach before the last of them
        k = self.least - 1
        if len(hits) <= k:
            return none, none
        first, last = hits[: len(hits) - k], hits[k:]
        close = (last - first < self.reach) & (doc[: len(hits) - k] == doc[k:])
        lo = np.maximum(at[doc[k:]], last - self.reach + 1)[close]
        hi = (first + 1)[close]  # and no later than the first
        if not len(lo):
            return none, none
        mark = np.zeros(len(ids) + 1, np.int32)
        np.add.at(mark, lo, 1)
        np.add.at(mark, np.maximum(hi, lo), -1)
        s = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        return s, at[np.searchsorted(at, s, side="right")]

    def candidates(self, ids: np.ndarray, at: np.ndarray):
        """Lists of distinct (item, place) pairs with an equal key, about PAIRS at a time; a pair may come again in a later list."""
        s, end = self.starts(ids, at)
        found, held = [], 0
        for lo in range(0, len(s), 20_000):
            a, b = s[lo : lo + 20_000], end[lo : lo + 20_000]
            slot = iter(self.keys)
            for r in range(WALKS):
                seen = walk(ids, a, b, r, 2 * int(self.lengths[-1]))
                for n in self.lengths.tolist():
                    for k, (known, own) in enumerate(next(slot)):
                        h = self.key(seen, n, r, k)
                        i, j = np.searchsorted(known, h), np.searchsorted(known, h, side="right")
                        some = np.flatnonzero(j > i)
                        cuts = np.searchsorted(np.cumsum((j - i)[some]), np.arange(PAIRS, (j - i)[some].sum(), PAIRS))
                        for part in np.split(some, cuts) if len(some) else ():
                            count = (j - i)[part]
                            which = np.repeat(i[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                            found.append(np.stack([own[which], np.repeat(a[part], count)], axis=1))
                            held += len(which)
                            if held >= PAIRS:
                                yield np.unique(np.concatenate(found), axis=0)
                                found, held = [], 0
        if found:
            yield np.unique(np.concatenate(found), axis=0)


class Exact:
    """Items of `n` words that must match without an edit."""

    def __init__(self, items: list[tuple], n: int):
        h = np.array([shingles(w, n)[0] for _, w, _ in items], np.uint64)
        order = np.argsort(h)
        self.n, self.h, self.names = n, h[order], [items[i][0] for i in order]

    def leaks(self, ids: np.ndarray, at: np.ndarray):
        """(text, names, edits, words, start) of each text's first match with each item."""
        h = shingles(ids, self.n)
        i = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        place = np.flatnonzero(self.h[i] == h)
        doc = np.searchsorted(at, place, side="right") - 1
        inside = place + self.n <= at[doc + 1]
        place, doc = place[inside], doc[inside]
        _, first = np.unique(np.stack([doc, i[place]], axis=1), axis=0, return_index=True)
        for x in first.tolist():
            yield int(doc[x]), self.names[i[place[x]]], 0, self.n, int(place[x] - at[doc[x]])


class Items:
    """A block of the benchmark."""

    def __init__(self, items: list[tuple], edits: float):
        ids, at = word_ids(pa.array([t for _, t in items], pa.string()))
        same: dict[bytes, tuple] = {}
        for (name, _), a, b in zip(items, at[:-1], at[1:], strict=True):
            if b > a:
                w = ids[a:b]
                same.setdefault(w.tobytes(), ([], w, edits_of(len(w), edits)))[0].append(name)
        by: dict[tuple[bool, int], list] = {}
        for x in same.values():
            _, w, e = x
            by.setdefault((True, min(Q, len(w) // (1 + e))) if e else (False, len(w)), []).append(x)
        self.parts = [Block(x, n) if edited else Exact(x, n) for (edited, n), x in sorted(by.items(), key=lambda kv: kv[0])]

    def leaks(self, ids: np.ndarray, at: np.ndarray):
        """(text, name, least edits, item's words, start) of every leak."""
        for part in self.parts:
            found = part.leaks(ids, at) if isinstance(part, Exact) else leaks(part, ids, at)
            for d, names, e, m, start in found:
                for name in names:
                    yield d, name, e, m, start


def fit(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edits between the item and any stretch of the region, and where the first such stretch ends (Myers 1999)."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(region.tolist()):
        eq = masks.get(w, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(x | up)), up & x
        if score < best:
            best, end = score, j + 1
    return best, end


def leaks(block: Block, ids: np.ndarray, at: np.ndarray) -> list[tuple]:
    """(text, names, least edits, item's words, start) of every verified leak."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for pairs in block.candidates(ids, at):
        item, place = pairs[:, 0], pairs[:, 1]
        doc = np.searchsorted(at, place, side="right") - 1
        order = np.lexsort((place, item, doc))
        i = 0
        while i < len(order):
            d, x = int(doc[order[i]]), int(item[order[i]])
            spans = []
            w, e = block.words[x], block.edits[x]
            while i < len(order) and doc[order[i]] == d and item[order[i]] == x:
                p = int(place[order[i]])
                lo, hi = max(int(at[d]), p - e), min(int(at[d + 1]), p + len(w) + 2 * e)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], hi)
                else:
                    spans.append([lo, hi])
                i += 1
            for lo, hi in spans:
                n, end = fit(w, ids[lo:hi])
                if n <= e and (n, lo) < best.get((d, x), (e + 1, 0)):
                    back, length = fit(w[::-1], ids[lo : lo + end][::-1])
                    best[d, x] = min(best.get((d, x), (e + 1, 0)), (n, lo + end - length))
    return [(d, block.names[x], n, len(block.words[x]), start - int(at[d])) for (d, x), (n, start) in best.items()]


def _scan(block):
    def run(batches):
        b = block.value
        for batch in batches:
            for part in steps(batch):
                ids, at = word_ids(part.column("text"))
                docs = part.column("doc_id").to_pylist()
                rows = [(docs[d], *x) for d, *x in b.leaks(ids, at)]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "distance", "item_words", "start"])

    return run


def item_blocks(benchmark: DataFrame, edits: float):
    """Broadcast blocks of the benchmark (item_id, text), each of BLOCK_ITEMS items or so."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    for i in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        yield spark.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], edits))


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """Documents (doc_id, text) that hold benchmark items (item_id, text) within the edits."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scans = [docs.mapInArrow(_scan(b), "doc_id long, item_id long, distance int, item_words int, start long") for b in item_blocks(benchmark, edits)]
    out = scans[0]
    for x in scans[1:]:
        out = out.unionByName(x)
    return out


def _clean(block):
    def run(batches):
        b = block.value
        for batch in batches:
            for part in steps(batch):
                ids, at = word_ids(part.column("text"))
                keep = np.ones(part.num_rows, bool)
                keep[[d for d, *_ in b.leaks(ids, at)]] = False
                yield part.filter(pa.array(keep))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item; nothing is shuffled."""
    for b in item_blocks(benchmark, edits):
        docs = docs.mapInArrow(_clean(b), docs.schema)
    return docs


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
