"""The top-N cosine join of tfidf where texts are made of two parts that come again and again.

A text's rare words are one part of it and the other words the second. Where the satellites have few parts beside their
number (records: a number of addresses with a number of names), what a part adds to a cosine is summed once for all of
them. A gram in several words counts less than the sum of what they give it, so the sum over words bounds the cosine. A
satellite whose bound reaches the anchor's least cosine has either a common part that gives some share of it or a rare
part that gives the rest: anchors of the same common part go together past the satellites of the first, and each anchor
past those of the second. Whole cosines of what the bound leaves are taken as in tfidf. Nothing is cut.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import tfidf
from tessera.operators.tfidf import DIGITS, Block, Vectors, _spread
from tessera.sources.shared import Shared, chunks

#: Words and parts at most, and parts for a satellite class; bags by which words are told apart.
MANY, SHARE, SAMPLE = 131_072, 0.5, 65_536
#: Anchor classes of a task, satellite classes of a chunk, anchors of a group at most; scores and bounds that are held at once.
ANCHORS, CHUNK, GROUP, CELLS = 32_768, 1 << 22, 256, 3 << 20
#: What the rounding of a bound may take from it; satellites by which the least cosine is found; the cost of a satellite
#: found by its rare part beside that of a cell.
SLACK, FIRST, COST = 1e-5, 1024, 6


def _word_counts(batches):
    """(word, n) of batches of bag."""
    for batch in batches:
        if batch.num_rows:
            found = pc.value_counts(pc.split_pattern(batch.column("bag"), " ").flatten())
            yield pa.record_batch([found.field("values"), found.field("counts")], ["word", "n"])


def least_common(bags: list[str], words: list[str], count: np.ndarray) -> int:
    """The count up to which a word is rare, for the fewest parts of some bags."""
    lists = pc.split_pattern(pa.array(bags, pa.string()), " ")
    word = np.asarray(pc.index_in(lists.flatten(), value_set=pa.array(words, pa.string()))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists)))])
    hashed = np.random.default_rng(0).integers(0, 1 << 63, len(words), np.uint64)[word]
    values, best = np.unique(count), (len(bags) * 2 + 1, 0)
    for most in np.unique(values[np.linspace(0, len(values) - 1, min(len(values), 48)).astype(int)]) if len(values) < 48 else np.unique(np.geomspace(values[0], values[-1], 64).astype(np.int64)):
        total = 0
        for own in (count[word] <= most, count[word] > most):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(own, hashed, np.uint64(0)), dtype=np.uint64)])
            total += len(np.unique(sums[at[1:]] - sums[at[:-1]]))
        best = min(best, (total, int(most)))
    return best[1]


@functools.lru_cache(4)
def _strings(path: str, column: str) -> pa.Array:
    got = [c for t in chunks(path, 1 << 20, [column]) for c in t.column(column).chunks]
    return pa.concat_arrays(got) if got else pa.array([], pa.string())


def _split(bags: pa.Array, common: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The common and the rare words of bags."""
    lists = pc.split_pattern(bags, " ")
    flat, size = lists.flatten(), np.asarray(pc.list_value_length(lists)).astype(np.int64)
    known = np.asarray(pc.is_in(flat, value_set=common))
    row, out = np.repeat(np.arange(len(size)), size), []
    for own in (known, ~known):
        at = np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(size)))])
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat.filter(pa.array(own))), " "))
    return out[0], out[1]


def _parts(path: str):
    """(rare, part): the parts of batches of bag."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for rare, part in enumerate(_split(batch.column("bag"), _strings(path, "word"))):
                    part = pc.unique(part)
                    yield pa.record_batch([pa.array([bool(rare)] * len(part)), part], ["rare", "part"])

    return run


def _coded(base: str, low: int, high: int, n: int):
    """(ids, q, r, norm) of batches of satellites (ids, bag): the numbers of their parts and their vectors' length."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                common, rare = _split(batch.column("bag"), _strings(f"{base}/common", "word"))
                of = lambda part, name: pc.index_in(part, value_set=_strings(f"{base}/{name}", "part"))
                codes = next(tfidf._codes(f"{base}/grams", low, high)([batch])).column("codes")
                norm = Vectors(codes, _idf(f"{base}/grams", n)).norm
                out = pa.record_batch([batch.column("ids"), of(common, "q"), of(rare, "r"), pa.array(norm)], ["ids", "q", "r", "norm"])
                yield out.filter(pa.array(norm > 0))

    return run


def _anchors(base: str, low: int, high: int):
    """(ids, floor, bag, q, codes) of batches of anchors (ids, floor, bag)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q, _ = _split(batch.column("bag"), _strings(f"{base}/common", "word"))
                codes = next(tfidf._codes(f"{base}/grams", low, high)([batch])).column("codes")
                yield pa.record_batch([*(batch.column(c) for c in ("ids", "floor", "bag")), q, codes], ["ids", "floor", "bag", "q", "codes"])

    return run


def _idf(path: str, n: int) -> np.ndarray:
    return np.log((1.0 + n) / (1 + tfidf._known(path)[1])) + 1


class Lists:
    """Lists of numbers below `n`."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat.astype(np.int64), size.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What some lists hold, and each one's place in `rows`."""
        k = self.size[rows]
        return self.flat[_spread(self.first[rows], k)], np.repeat(np.arange(len(rows)), k)

    def summed(self, score: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """For each line of scores, their sums over some lists."""
        out = np.zeros((len(score), len(rows)), score.dtype)
        for j in range(self.size[rows].max(initial=0)):
            has = np.flatnonzero(self.size[rows] > j)
            item = np.take(score, self.flat[self.first[rows[has]] + j], axis=1)
            if len(has) == len(rows):
                out += item
            else:
                out[:, has] += item
        return out


class Spelling:
    """The words of all parts, their grams and the postings of these."""

    def __init__(self, parts: list[pa.Array], low: int, high: int, grams: pa.Array, idf: np.ndarray):
        lists = [pc.split_pattern(p, " ") for p in parts]
        flat = pa.chunked_array([x.flatten() for x in lists]).combine_chunks()
        flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
        coded = flat.dictionary_encode()
        word, sizes = np.asarray(coded.indices).astype(np.int64), [np.asarray(pc.list_value_length(x)).astype(np.int64) for x in lists]
        cut = np.cumsum([s.sum() for s in sizes])[:-1]
        self.parts = [Lists(w, s) for w, s in zip(np.split(word, cut), sizes, strict=True)]
        spelled = [tfidf._of_word(w, low, high) if w else [] for w in coded.dictionary.to_pylist()]
        self.n, self.grams, self.idf = len(spelled), len(grams), idf
        size = np.array([len(x) for x in spelled], np.int64)
        code = np.asarray(pc.fill_null(pc.index_in(pa.array([g for x in spelled for g in x], pa.string()), value_set=grams), -1)).astype(np.int64)
        owner = np.repeat(np.arange(self.n), size)[code >= 0]
        code = code[code >= 0]
        self.spelled = Lists(code, np.bincount(owner, minlength=self.n))
        key, tf = np.unique(code * max(self.n, 1) + owner, return_counts=True)
        own = key // max(self.n, 1)
        self.word, self.weight = key % max(self.n, 1), (1 + np.log(tf)) * idf[own]
        self.first = np.searchsorted(own, np.arange(self.grams + 1))

    def scores(self, a: Vectors, rows: np.ndarray) -> np.ndarray:
        """What each word gives some anchors, before division by a satellite's length."""
        at, who = a.take(rows)
        code = a.code[at]
        k = self.first[code + 1] - self.first[code]
        which = _spread(self.first[code], k)
        cells = np.bincount(np.repeat(who * self.n, k) + self.word[which], self.weight[which] * np.repeat(a.weight[at], k), len(rows) * self.n)
        return cells.reshape(len(rows), self.n).astype(np.float32)

    def vectors(self, q: np.ndarray, r: np.ndarray) -> Vectors:
        """Vectors of satellites by their parts."""
        own = []
        for part, which in zip(self.parts, (q, r), strict=True):
            word, row = part.take(which)
            code, place = self.spelled.take(word)
            own.append(row[place] * self.grams + code)
        key = np.sort(np.concatenate(own))
        at = np.searchsorted(key, np.arange(len(q) + 1) * self.grams)
        return Vectors(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((key % self.grams).astype(np.int32))), self.idf)


class Satellites:
    """A chunk of satellites, by their parts."""

    def __init__(self, s: Spelling, q: np.ndarray, r: np.ndarray, norm: np.ndarray, times: np.ndarray):
        self.s, self.q, self.r, self.times, self.inverse = s, q, r, times, (1 / norm).astype(np.float32)
        by = lambda x, n: (np.argsort(x, kind="stable").astype(np.int32), np.bincount(x, minlength=n))
        (self.by_q, self.q_count), (self.by_r, self.r_count) = by(q, len(s.parts[0].size)), by(r, len(s.parts[1].size))
        self.q_first, self.r_first = np.cumsum(self.q_count) - self.q_count, np.cumsum(self.r_count) - self.r_count
        most = lambda x, n: np.maximum.reduceat(np.append(self.inverse[x[0]], 0), np.minimum(x[1], len(q))) * (n > 0)
        self.q_most, self.r_most = most((self.by_q, self.q_first), self.q_count), most((self.by_r, self.r_first), self.r_count)
        self.rows_q, self.rows_r = np.flatnonzero(self.q_count), np.flatnonzero(self.r_count)

    def cosines(self, block: Block, anchor: np.ndarray, sat: np.ndarray) -> np.ndarray:
        own, place = np.unique(sat, return_inverse=True)
        return tfidf.whole_cosines(self.s.vectors(self.q[own], self.r[own]), self.s.grams, block.a, anchor, place)

    def search(self, block: Block, rows: np.ndarray, start: int, best: np.ndarray) -> None:
        """Brings the satellites that may be among the best of a group of anchors into `best` and what the block has found."""
        parts, nq = self.s.parts, len(self.q_count)
        score = self.s.scores(block.a, rows)
        rare = np.zeros((len(rows), len(self.r_count)), np.float32)
        rare[:, self.rows_r] = parts[1].summed(score, self.rows_r)
        # of a common part, no anchor of the group gets more than this
        word, of = parts[0].take(np.arange(nq))
        top_q = np.bincount(of, score.max(axis=0)[word], nq).astype(np.float32)
        share = top_q * self.q_most
        order = self.rows_q[np.argsort(-share[self.rows_q], kind="stable")]
        total = np.cumsum(self.q_count[order])
        self._first(block, rows, score, rare, order[: 1 + np.searchsorted(total, FIRST)])
        least = (block.least[rows] - SLACK).astype(np.float32)
        # where the two ways divide: by the fewest satellites, as some of the anchors show
        some = np.linspace(0, len(rows) - 1, min(4, len(rows))).astype(int)
        lack = (least[some, None] - rare[some][:, self.rows_r] * self.r_most[self.rows_r]).ravel()
        by = np.argsort(lack)
        many = np.cumsum(np.tile(self.r_count[self.rows_r], len(some))[by])
        y = np.linspace(0, 1.5, 61)
        chosen = np.searchsorted(-share[order], -y, side="right")
        cost_q = len(rows) * np.append(0, total)[chosen]
        cost_r = np.append(0, many)[np.searchsorted(lack[by], y, side="right")] * (len(rows) / len(some)) * COST
        at = int(np.argmin(cost_q + cost_r))
        own = order[: chosen[at]]
        self._common(block, rows, score, rare, own, least, start, best)
        if len(own) < len(order):
            self._rare(block, rows, rare, own, top_q, least, y[at], start, best)

    def _bounds(self, score: np.ndarray, rare: np.ndarray, own: np.ndarray):
        """(satellites, a bound for each anchor and satellite) of some common parts."""
        common = self.s.parts[0].summed(score, own)
        k = self.q_count[own]
        sat, place = self.by_q[_spread(self.q_first[own], k)], np.repeat(np.arange(len(own)), k)
        step = max(1, CELLS // max(1, len(score)))
        for lo in range(0, len(sat), step):
            s = sat[lo : lo + step]
            bound = np.take(rare, self.r[s], axis=1)
            bound += np.take(common, place[lo : lo + step], axis=1)
            bound *= self.inverse[s]
            yield s, bound

    def _first(self, block: Block, rows: np.ndarray, score: np.ndarray, rare: np.ndarray, own: np.ndarray) -> None:
        best = np.full((len(rows), block.top), -1.0)
        for s, bound in self._bounds(score, rare, own):
            k = min(block.top, len(s))
            i, j = np.repeat(np.arange(len(rows)), k), np.argpartition(-bound, k - 1, axis=1)[:, :k].ravel()
            tfidf._raise(best, i, np.round(self.cosines(block, rows[i], s[j]), DIGITS), self.times[s[j]])
        block.least[rows] = np.maximum(block.least[rows], best[:, -1] - 2 * tfidf.ERROR)

    def _common(self, block: Block, rows: np.ndarray, score: np.ndarray, rare: np.ndarray, own: np.ndarray, least: np.ndarray, start: int, best: np.ndarray) -> None:
        for s, bound in self._bounds(score, rare, own):
            i, j = np.nonzero(bound >= least[:, None])
            self._pairs(block, rows[i], s[j], start, best)

    def _rare(self, block: Block, rows: np.ndarray, rare: np.ndarray, own: np.ndarray, top_q: np.ndarray, least: np.ndarray, y: float, start: int, best: np.ndarray) -> None:
        done = np.zeros(len(self.q_count), bool)
        done[own] = True
        i, part = np.nonzero((rare * self.r_most >= (least - np.float32(y))[:, None]) & (self.r_count > 0))
        for some in tfidf._stepped(np.arange(len(i)), self.r_count[part], CELLS // 2):
            k = self.r_count[part[some]]
            sat, who = self.by_r[_spread(self.r_first[part[some]], k)], np.repeat(i[some], k)
            q = self.q[sat]
            good = (np.repeat(rare[i[some], part[some]], k) + top_q[q]) * self.inverse[sat] >= least[who]
            good &= ~done[q]
            self._pairs(block, rows[who[good]], sat[good], start, best)

    def _pairs(self, block: Block, anchor: np.ndarray, sat: np.ndarray, start: int, best: np.ndarray) -> None:
        for lo in range(0, len(anchor), CELLS // 8):
            a, s = anchor[lo : lo + CELLS // 8], sat[lo : lo + CELLS // 8]
            block.take_pairs(a, s, self.cosines(block, a, s), self.times, start, best)


def _search(base: str, low: int, high: int, n: int, top: int, threshold: float):
    """(s1_id, candidate_id, cosine) of the anchors of a task against all satellite classes."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        t = t.take(pc.sort_indices(t, [("q", "ascending"), ("bag", "ascending")])).drop_columns(["bag"]).combine_chunks()
        ids, codes, q = (pa.concat_arrays(t.column(c).chunks) for c in ("ids", "codes", "q"))
        idf = _idf(f"{base}/grams", n)
        block = Block(codes, idf, top, max(threshold, tfidf.ERROR), t.column("floor").to_numpy())
        best = np.full((block.a.n, top), -1.0)
        spelling = Spelling([_strings(f"{base}/q", "part"), _strings(f"{base}/r", "part")], low, high, tfidf._known(f"{base}/grams")[0], idf)
        group = np.asarray(q.dictionary_encode().indices)
        edges = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        most = max(16, min(GROUP, CELLS // max(spelling.n, 1)))
        # groups of the same common part, and small ones together
        groups, lo = [], 0
        for e, f in zip(edges[1:], np.append(edges[2:], len(group) + most), strict=True):
            while e - lo > most:
                groups.append(np.arange(lo, lo + most))
                lo += most
            if f - lo > most or e - lo >= most // 4:
                groups.append(np.arange(lo, e))
                lo = e
        has = np.diff(block.a.at) > 0
        start = 0
        for c in chunks(f"{base}/satellites", CHUNK, ["ids", "q", "r", "norm"]):
            times = np.asarray(pc.list_value_length(c.column("ids").combine_chunks())).astype(np.int64)
            sats = Satellites(spelling, c.column("q").to_numpy(), c.column("r").to_numpy(), c.column("norm").to_numpy(), times)
            start, before = start + c.num_rows, start
            del c
            tfidf._give_back()
            for rows in groups:
                if len(rows := rows[has[rows]]):
                    sats.search(block, rows, before, best)
        del t, codes
        yield from tfidf._named(ids, f"{base}/satellites", block)
        del block, best
        tfidf._give_back()

    return run


def found(shared: Shared, classes: DataFrame, low: int, high: int, n: int, top: int, threshold: float, anchors: int) -> DataFrame | None:
    """(s1_id, candidate_id, cosine) of classes (anchor, bag, ids, floor); none where satellites have many words or parts."""
    satellites = classes.where("not anchor")
    words = shared.keep(satellites.select("bag").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    if not 0 < words.count() <= MANY:
        return None
    counted = words.collect()
    count = np.array([r.n for r in counted])
    most = least_common([r.bag for r in satellites.select("bag").limit(SAMPLE).collect()], [r.word for r in counted], count)
    shared.keep(words.where(F.col("n") > most).select("word").repartition(1).sortWithinPartitions("word"), "common")
    parts = shared.keep(satellites.select("bag").mapInArrow(_parts(shared.path("common")), "rare boolean, part string").distinct(), "parts")
    size = parts.count()
    if size > MANY or size > SHARE * satellites.count():
        return None
    for name, own in (("q", "not rare"), ("r", "rare")):
        shared.keep(parts.where(own).select("part").repartition(1).sortWithinPartitions("part"), name)
    shared.keep(satellites.select("ids", "bag").mapInArrow(_coded(shared.base, low, high, n), "ids array<string>, q int, r int, norm double"), "satellites")
    blocks = max(1, -(-anchors // ANCHORS), min(tfidf.SPREAD, anchors // 256))
    coded = classes.where("anchor").select("ids", "floor", "bag").mapInArrow(_anchors(shared.base, low, high), "ids array<string>, floor double, bag string, q string, codes array<int>")
    return coded.repartitionByRange(blocks, "q", "bag").mapInArrow(_search(shared.base, low, high, n, top, threshold), "s1_id string, candidate_id string, cosine double")
