"""Character-gram TF-IDF vectors and the top-N cosine join over them.

Vectors are native: words padded by a blank on either side, grams of `low` to `high` characters inside a word (a word
no longer than a gram size counts once, whole), sublinear term frequency, smoothed inverse document frequency, grams of
fewer than `least` texts left out, unit length.

The join works on classes of records with the same words, as their vectors are the same: an anchor class needs no more
than the `top` first ids of a satellite class. Satellite classes are written once to the shared folder as lists of gram
codes, and each task takes a block of anchors past all of them, in chunks. A first pass looks up every anchor's rarest
grams alone; the cosines of what they find give a least cosine that its last kept satellite must have. In the second a
satellite that shares none of the anchor's rarest grams can't reach it, where the others' length is below; of those that
share some, a bound on the rest tells which are worth a whole cosine. Anchors with too little to prune by are compared
with the whole chunk, by a product of matrices for common grams and sums over postings for the others. Nothing is cut.

Cosines are rounded to DIGITS decimals before they are compared, so that ties don't hang on the order of sums.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import Shared, chunks

#: Anchor classes of a task at most, tasks at least where there are classes for them; satellite classes of a chunk.
ANCHORS, SPREAD, CHUNK = 65_536, 12, 32_768
#: Decimals of a cosine; share of a chunk's satellites that makes a gram common; cosines and postings that a step holds.
DIGITS, COMMON, CELLS, POSTINGS = 9, 1 / 8, 1 << 20, 1 << 19
ERROR = 10.0**-DIGITS
#: The share of squared length that is looked up first; how far below the least cosine the length of what isn't looked up
#: is brought; the share of a chunk in postings beyond which an anchor is compared with all of it.
FIRST, BELOW, WHOLE = 0.25, 0.85, 0.15
#: A least cosine that is high enough to do without the first pass.
HIGH = 0.6
#: Bits of a product in a sort key.
BITS = 21


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def _give_back() -> None:
    """Give freed memory back, so that a worker holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def grams(text: Column, low: int, high: int) -> Column:
    """Array of the text's grams, repeated as they repeat."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        n = F.length(padded)

        def sized(k: int) -> Column:
            slide = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(k)))
            once = n <= k if k == low else (n == k)
            return F.when(n > k, slide).when(once, F.array(padded)).otherwise(F.array().cast("array<string>"))

        return F.concat(*[sized(k) for k in range(low, high + 1)])

    found = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(found, of_word))


def _raw(docs: DataFrame, n: int, low: int, high: int, least: int) -> DataFrame:
    """(id, gram, w) before vectors are brought to unit length; n: texts of the corpus."""
    terms = docs.select("id", F.explode(grams(F.col("text"), low, high)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))
    df = terms.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    return terms.join(df, "gram").select("id", "gram", ((1 + F.log("tf")) * idf).alias("w"))


def vectors(docs: DataFrame, low: int, high: int, least: int = 2) -> DataFrame:
    """(id, gram, weight) of texts (id, text); every text is in the corpus."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return _raw(docs, docs.count(), low, high, least).select("id", "gram", (F.col("w") / norm).alias("weight"))


def _of_word(word: str, low: int, high: int) -> list[str]:
    """grams() of one word."""
    padded = f" {word} "
    n, out = len(padded), []
    for k in range(low, high + 1):
        if n > k:
            out += [padded[i : i + k] for i in range(n - k + 1)]
        elif n == k or k == low:
            out.append(padded)
    return out


def _spelled(bags: pa.Array, low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of words joined by blanks: the grams of all distinct words, and which of them (with repeats) which text has."""
    lists = pc.split_pattern(bags, " ")
    size = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    word = np.asarray(coded.indices).astype(np.int64)
    spelled = [_of_word(w, low, high) if w else [] for w in coded.dictionary.to_pylist()]
    count = np.array([len(x) for x in spelled], np.int64)
    grams = pa.array([g for x in spelled for g in x], pa.string()).dictionary_encode()
    first, k = np.cumsum(count) - count, count[word]
    at = np.repeat(first[word] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    return grams.dictionary, np.asarray(grams.indices).astype(np.int64)[at], np.repeat(np.repeat(np.arange(len(size)), size), k)


def _counts(low: int, high: int):
    """(gram, n): in how many texts a gram is; batches of bag, n."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                names, gram, row = _spelled(batch.column("bag"), low, high)
                key = np.unique(row * max(len(names), 1) + gram)
                n = np.asarray(batch.column("n"))[key // max(len(names), 1)]
                total = np.zeros(len(names), np.int64)
                np.add.at(total, key % max(len(names), 1), n)
                yield pa.record_batch([names, pa.array(total)], ["gram", "n"])

    return run


@functools.lru_cache(2)
def _known(path: str) -> tuple[pa.Array, np.ndarray]:
    """The corpus' grams by rising frequency, and their frequencies."""
    parts = list(chunks(path, 1 << 20, ["gram", "df"]))
    t = pa.concat_tables(parts).combine_chunks() if parts else pa.table({"gram": pa.array([], pa.string()), "df": pa.array([], pa.int64())})
    return pa.concat_arrays(t.column("gram").chunks) if t.num_rows else pa.array([], pa.string()), t.column("df").to_numpy()


def _codes(path: str, low: int, high: int):
    """The batches with codes in place of bag: those of the corpus' grams in rising order, repeated as they repeat."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                known, _ = _known(path)
                names, gram, row = _spelled(batch.column("bag"), low, high)
                code = np.asarray(pc.fill_null(pc.index_in(names, value_set=known), -1)).astype(np.int64)[gram]
                row, code, n = row[code >= 0], code[code >= 0], max(len(known), 1)
                key = np.sort(row * n + code)
                at = np.searchsorted(key, np.arange(batch.num_rows + 1) * n)
                rest = [c for c in batch.schema.names if c != "bag"]
                yield pa.record_batch([*map(batch.column, rest), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((key % n).astype(np.int32)))], [*rest, "codes"])

    return run


def _spread(first: np.ndarray, k: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... for k[i] each."""
    return np.repeat(first - (np.cumsum(k) - k), k) + np.arange(k.sum())


class Vectors:
    """Unit vectors of some texts: codes and weights row by row, rarest grams first."""

    def __init__(self, codes: pa.Array, idf: np.ndarray):
        size = np.asarray(pc.list_value_length(codes)).astype(np.int64)
        code, row = np.asarray(codes.flatten()), np.repeat(np.arange(len(size), dtype=np.int32), size)
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else np.zeros(0, np.int64)
        tf = np.diff(np.append(new, len(code)))
        self.n, self.code, self.row = len(size), code[new], row[new]
        w = (1 + np.log(tf)) * idf[self.code]
        self.norm = np.sqrt(np.bincount(self.row, w * w, self.n))
        self.weight = w / self.norm[self.row]
        self.at = np.searchsorted(self.row, np.arange(self.n + 1))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries some rows have, and each one's place in `rows`."""
        k = self.at[rows + 1] - self.at[rows]
        return _spread(self.at[rows], k), np.repeat(np.arange(len(rows)), k)


class Index:
    """A chunk of satellites: postings of every gram, and a matrix of the common ones."""

    def __init__(self, v: Vectors, grams: int):
        self.v, self.n = v, v.n
        order = np.argsort(v.code, kind="stable")
        self.owner, self.weight = v.row[order], v.weight[order]
        self.first = np.searchsorted(v.code[order], np.arange(grams + 1))
        self.count = np.diff(self.first)

    @functools.cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        common = np.flatnonzero(self.count > max(1, self.n * COMMON))
        column = np.full(len(self.count), -1)
        column[common] = np.arange(len(common))
        matrix = np.zeros((len(common), self.n))
        for i, c in enumerate(common):
            own = slice(self.first[c], self.first[c + 1])
            matrix[i, self.owner[own]] = self.weight[own]
        return column, matrix

    def all_cosines(self, a: Vectors, rows: np.ndarray) -> np.ndarray:
        """Cosines of some anchors with every satellite."""
        column, matrix = self.common
        at, who = a.take(rows)
        code, weight = a.code[at], a.weight[at]
        c = column[code]
        dense = np.zeros((len(rows), len(matrix)))
        dense[who[c >= 0], c[c >= 0]] = weight[c >= 0]
        who, code, weight = who[c < 0], code[c < 0], weight[c < 0]
        k = self.count[code]
        which = _spread(self.first[code], k)
        cells = np.bincount(np.repeat(who * self.n, k) + self.owner[which], self.weight[which] * np.repeat(weight, k), len(rows) * self.n)
        return dense @ matrix + cells.reshape(len(rows), self.n)

    def partial(self, at: np.ndarray, who: np.ndarray, a: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's place, satellite, what these entries add to their cosine, rounded up) of all that share an entry."""
        code = a.code[at]
        k = self.count[code]
        which = _spread(self.first[code], k)
        product = np.ceil(self.weight[which] * np.repeat(a.weight[at], k) * (1 << BITS - 1)).astype(np.int64)
        key = np.sort((np.repeat(who * self.n, k) + self.owner[which] << BITS) | np.minimum(product, (1 << BITS) - 1))
        pair = key >> BITS
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        total = np.add.reduceat(key & (1 << BITS) - 1, new) / (1 << BITS - 1) if len(new) else np.zeros(0)
        return pair[new] // self.n, pair[new] % self.n, total

    def cosines(self, a: Vectors, anchor: np.ndarray, satellite: np.ndarray) -> np.ndarray:
        """Whole cosines of pairs in the order of their anchors."""
        return whole_cosines(self.v, len(self.count), a, anchor, satellite)


def whole_cosines(v: Vectors, grams: int, a: Vectors, anchor: np.ndarray, satellite: np.ndarray) -> np.ndarray:
    """Whole cosines of pairs with the satellites v, in the order of their anchors."""
    out = np.zeros(len(anchor))
    step = max(1, 2 * CELLS // max(grams, 1))
    change = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    buffer = np.zeros(step * grams)
    ends = np.append(change, len(anchor))
    for lo in range(0, len(change), step):
        some = anchor[change[lo : lo + step]]
        at, who = a.take(some)
        cell = who * grams + a.code[at]
        buffer[cell] = a.weight[at]
        start, stop = ends[lo], ends[min(lo + step, len(change))]
        local = np.repeat(np.arange(len(some)), np.diff(ends[lo : lo + len(some) + 1]))
        for b in range(start, stop, POSTINGS // 32):
            e = min(stop, b + POSTINGS // 32)
            entry, pair = v.take(satellite[b:e])
            out[b:e] = np.bincount(pair, buffer[local[b - start : e - start][pair] * grams + v.code[entry]] * v.weight[entry], e - b)
        buffer[cell] = 0
    return out


def _ranked(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by group and falling value, and each row's rank in its group from 0."""
    order = np.lexsort((-value, group))
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    return order, np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))


def _raise(best: np.ndarray, anchor: np.ndarray, value: np.ndarray, times: np.ndarray) -> None:
    """Bring values, each as often as `times`, into the anchors' greatest ones (falling)."""
    if not len(anchor):
        return
    top = best.shape[1]
    anchor, value = np.repeat(anchor, times), np.repeat(value, times)
    order, rank = _ranked(anchor, value)
    order, rank = order[rank < top], rank[rank < top]
    who, place = np.unique(anchor[order], return_inverse=True)
    more = np.full((len(who), top), -1.0)
    more[place, rank] = value[order]
    best[who] = -np.sort(-np.concatenate([best[who], more], axis=1), axis=1)[:, :top]


def _stepped(rows: np.ndarray, cost: np.ndarray, most: int):
    """Rows in pieces of a summed cost of `most` or a single row."""
    end = np.cumsum(cost)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, side="right")))
        yield rows[lo:hi]
        lo = hi


class Block:
    """The anchors of a task, and what they have found."""

    def __init__(self, codes: pa.Array, idf: np.ndarray, top: int, threshold: float, floor: np.ndarray | None = None):
        self.a, self.grams, self.top = Vectors(codes, idf), len(idf), top
        self.mass = np.cumsum(self.a.weight**2)
        before = np.concatenate([[0.0], self.mass])[self.a.at[:-1]]
        self.mass -= before[self.a.row]
        self.least = np.full(self.a.n, threshold) if floor is None else np.maximum(floor, threshold)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, 4 * POSTINGS

    def _entries(self, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of its rarest grams each anchor needs for a share of its squared length, and the share they have."""
        short = self.mass < share[self.a.row]
        k = np.minimum(np.bincount(self.a.row[short], minlength=self.a.n) + 1, np.diff(self.a.at))
        return k, np.where(k > 0, self.mass[np.minimum(self.a.at[:-1] + np.maximum(k, 1) - 1, max(len(self.mass) - 1, 0))] if len(self.mass) else 0.0, 0.0)

    def _cost(self, index: Index, k: np.ndarray) -> np.ndarray:
        at = _spread(self.a.at[:-1], k)
        return np.bincount(self.a.row[at], index.count[self.a.code[at]], self.a.n).astype(np.int64)

    def first(self, index: Index, times: np.ndarray, state: dict) -> None:
        """Cosines of satellites that share an anchor's rarest grams best raise its least cosine."""
        best, parts = state.setdefault("best", np.full((self.a.n, self.top), -1.0)), state.setdefault("parts", np.full((self.a.n, self.top), -1.0))
        k, _ = self._entries(np.full(self.a.n, FIRST))
        cost = self._cost(index, k)
        rows = np.flatnonzero((cost > 0) & (cost <= index.n * WHOLE))
        for some in _stepped(rows, cost[rows], POSTINGS):
            place, sat, part = index.partial(_spread(self.a.at[some], k[some]), np.repeat(np.arange(len(some)), k[some]), self.a)
            anchor = some[place]
            new = part > parts[anchor, -1]
            anchor, sat, part = anchor[new], sat[new], part[new]
            order, rank = _ranked(anchor, part)
            keep = order[rank < self.top]
            anchor, sat, part = anchor[keep], sat[keep], part[keep]
            _raise(parts, anchor, part, np.ones(len(anchor), np.int64))
            _raise(best, anchor, np.round(index.cosines(self.a, anchor, sat), DIGITS), times[sat])

    def settle(self, best: np.ndarray) -> None:
        # the same cosine may be summed in another order next time
        self.least = np.maximum(self.least, best[:, -1] - 2 * ERROR)

    def second(self, index: Index, times: np.ndarray, start: int, best: np.ndarray) -> None:
        k, mass = self._entries(1 - (BELOW * self.least) ** 2)
        cost = self._cost(index, k)
        some = (np.diff(self.a.at) > 0) & (cost > 0)
        whole = cost > index.n * WHOLE
        sparse, dense = np.flatnonzero(some & ~whole), np.flatnonzero(some & whole)
        for rows in _stepped(sparse, cost[sparse], POSTINGS):
            place, sat, part = index.partial(_spread(self.a.at[rows], k[rows]), np.repeat(np.arange(len(rows)), k[rows]), self.a)
            anchor = rows[place]
            q = np.minimum(mass[anchor], 1.0)
            rest = np.sqrt(np.maximum(1 - q, 0.0) + 1e-12)
            bound = part + rest * np.sqrt(np.maximum(1 - part**2 / q, 0.0))
            good = (part >= q) | (bound >= self.least[anchor] - ERROR)
            anchor, sat = anchor[good], sat[good]
            self.take_pairs(anchor, sat, index.cosines(self.a, anchor, sat), times, start, best)
        step = max(1, CELLS // max(index.n, 1))
        for lo in range(0, len(dense), step):
            rows = dense[lo : lo + step]
            cosine = index.all_cosines(self.a, rows)
            least = self.least[rows] - ERROR
            if index.n > self.top:
                least = np.maximum(least, np.partition(cosine, index.n - self.top, axis=1)[:, index.n - self.top] - ERROR)
            i, j = np.nonzero(cosine >= least[:, None])
            self.take_pairs(rows[i], j, cosine[i, j], times, start, best)

    def take_pairs(self, anchor: np.ndarray, sat: np.ndarray, cosine: np.ndarray, times: np.ndarray, start: int, best: np.ndarray) -> None:
        cosine = np.round(cosine, DIGITS)
        good = cosine >= self.least[anchor]
        anchor, sat, cosine = anchor[good], sat[good], cosine[good]
        _raise(best, anchor, cosine, times[sat])
        self.settle(best)
        self.found.append((anchor, start + sat, cosine))
        self.held += len(anchor)
        if self.held > self.most:
            self.found = [self.pairs()]
            self.held = len(self.found[0][0])
            self.most = max(self.most, 2 * self.held)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, satellite class, cosine) that may be among an anchor's best."""
        none = np.zeros(0, np.int64)
        anchor, sat, cosine = (np.concatenate(x) for x in zip((none, none, none.astype(float)), *self.found, strict=True))
        good = cosine >= self.least[anchor]
        return anchor[good], sat[good], cosine[good]


def _named(ids: pa.Array, path: str, block: Block):
    """Record batches of the anchors' `top` best by id, from the classes that were found."""
    anchor, sat, cosine = block.pairs()
    needed, names, start = np.unique(sat), [], 0
    for t in chunks(path, CHUNK, ["ids"]):
        own = needed[np.searchsorted(needed, start) : np.searchsorted(needed, start + t.num_rows)] - start
        names.append(pa.concat_arrays(t.column("ids").chunks).take(pa.array(own)))
        start += t.num_rows
    if not len(anchor):
        return
    lists = pa.concat_arrays(names)
    order = np.argsort(anchor, kind="stable")
    anchor, place, cosine = anchor[order], np.searchsorted(needed, sat[order]), cosine[order]
    for lo in range(0, block.a.n, 2048):
        b, e = np.searchsorted(anchor, [lo, lo + 2048])
        own = lists.take(pa.array(place[b:e]))
        k = np.asarray(pc.list_value_length(own)).astype(np.int64)
        t = pa.table({"a": np.repeat(anchor[b:e], k), "x": -np.repeat(cosine[b:e], k), "id": own.flatten()})
        t = t.take(pc.sort_indices(t, [("a", "ascending"), ("x", "ascending"), ("id", "ascending")]))
        a = t.column("a").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        size = np.minimum(np.diff(np.append(new, len(a))), block.top)
        # every anchor of a class gets the class' rows
        of = ids.take(pa.array(a[new]))
        copies = np.asarray(pc.list_value_length(of)).astype(np.int64)
        first, size = np.repeat(new, copies), np.repeat(size, copies)
        t, names = t.select(["x", "id"]), of.flatten()
        for part in _stepped(np.arange(len(first)), size, 1 << 16):
            rows = t.take(pa.array(_spread(first[part], size[part])))
            out = pa.table({"s1_id": names.take(pa.array(np.repeat(part, size[part]))), "candidate_id": rows.column("id"), "cosine": pc.negate(rows.column("x"))})
            yield from out.combine_chunks().to_batches()


def _search(path: str, gram_path: str, n: int, top: int, threshold: float):
    """(s1_id, candidate_id, cosine) of the anchors (ids, codes) of a task against all satellite classes below path."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        ids, codes = (pa.concat_arrays(t.column(c).chunks) for c in ("ids", "codes"))
        idf = np.log((1.0 + n) / (1 + _known(gram_path)[1])) + 1
        block, state = Block(codes, idf, top, threshold, t.column("floor").to_numpy()), {}
        best = np.full((block.a.n, top), -1.0)

        def indexes():
            start = 0
            for c in chunks(path, CHUNK, ["ids", "codes"]):
                times = np.asarray(pc.list_value_length(c.column("ids").combine_chunks())).astype(np.int64)
                yield Index(Vectors(pa.concat_arrays(c.column("codes").chunks), idf), len(idf)), times, start
                start += c.num_rows
                _give_back()

        if (block.least < HIGH).any():
            for index, times, _ in indexes():
                block.first(index, times, state)
        if "best" in state:
            block.settle(state.pop("best"))
        for index, times, start in indexes():
            block.second(index, times, start, best)
        yield from _named(ids, path, block)
        del block, best, t, ids, codes
        _give_back()

    return run


def top_similar(anchors: DataFrame, satellites: DataFrame, low: int, high: int, top: int, threshold: float, least: int = 2) -> DataFrame:
    """(s1_id, candidate_id, cosine, tfidf_sim): of each anchor (id, text) the `top` satellites of cosine `threshold` or
    more (above 0); tfidf_sim is the cosine as a float. Ties go to the smaller id. An id has one text on its side.

    Anchors may have a column `floor`: a cosine below which the caller has no use for their pairs, so that some of these may
    be missing; null: none."""
    floor = F.coalesce(F.col("floor").cast("double"), F.lit(0.0)) if "floor" in anchors.columns else F.lit(0.0)
    both = anchors.select(F.lit(True).alias("anchor"), "id", "text", floor.alias("floor")).unionByName(satellites.select(F.lit(False).alias("anchor"), "id", "text", F.lit(0.0).alias("floor")))
    words = F.array_sort(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    every = both.select("anchor", "id", F.coalesce(F.array_join(words, " "), F.lit("")).alias("bag"), "floor").groupBy("anchor", "bag").agg(F.collect_list("id").alias("ids"), F.min("floor").alias("floor"))
    shared = Shared(anchors.sparkSession)
    first = F.when(F.col("anchor"), F.col("ids")).otherwise(F.slice(F.sort_array("ids"), 1, top)).alias("ids")
    classes = shared.keep(every.select("anchor", "bag", F.size("ids").cast("long").alias("n"), first, "floor"), "classes")
    size = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if("anchor").alias("anchors")).first()
    classes = classes.where("bag <> ''")
    df = classes.select("bag", "n").mapInArrow(_counts(low, high), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("df")).where(F.col("df") >= least)
    shared.keep(df.repartition(1).sortWithinPartitions("df", "gram"), "grams")
    from tessera.operators import parts  # builds on this module

    by_parts = parts.found(shared, classes, low, high, size.n, top, threshold, size.anchors)
    if by_parts is not None:
        return by_parts.select("s1_id", "candidate_id", "cosine", F.col("cosine").cast("float").alias("tfidf_sim"))
    coded = lambda x: x.select("ids", "floor", "bag").mapInArrow(_codes(shared.path("grams"), low, high), "ids array<string>, floor double, codes array<int>")
    shared.keep(coded(classes.where("not anchor")), "satellites")
    blocks = max(1, -(-size.anchors // ANCHORS), min(SPREAD, size.anchors // 256))
    found = coded(classes.where("anchor").repartition(blocks)).mapInArrow(_search(shared.path("satellites"), shared.path("grams"), size.n, top, threshold), "s1_id string, candidate_id string, cosine double")
    return found.select("s1_id", "candidate_id", "cosine", F.col("cosine").cast("float").alias("tfidf_sim"))
