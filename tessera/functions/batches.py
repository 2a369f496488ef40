"""The similarities of similarity.py for many pairs at once: the same values, by bit vectors in numpy that stand for a text's places.

Texts of up to 63 ASCII characters go this way; pairs with another text are left to the functions for one pair.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np

from tessera.functions import similarity

#: Characters of a text at most; pairs that are compared at a time; pairs whose windows are; texts whose masks are made at a time.
LONGEST, PAIRS, WINDOWED, MASKED = 63, 2048, 512, 512
ONE = np.uint64(1)


def _whole(size: int) -> np.dtype:
    """The numbers that have a bit for each place."""
    return np.dtype(f"<u{1 if size <= 8 else 2 if size <= 16 else 4 if size <= 32 else 8}")


class Texts:
    """Distinct texts, their characters as rows of bytes (0 behind the end) and their lengths; plain: those that fit."""

    def __init__(self, texts: list[str], longest: int = LONGEST):
        self.texts, n = texts, len(texts)
        self.size = np.fromiter(map(len, texts), np.int64, n)
        self.plain = np.fromiter(map(str.isascii, texts), bool, n) & (self.size <= longest)
        if "\0" in "".join(texts):
            self.plain &= np.fromiter(("\0" not in t for t in texts), bool, n)
        rows = texts if self.plain.all() else [t if p else "" for t, p in zip(texts, self.plain.tolist(), strict=True)]
        self.chars = np.array(rows, dtype=f"S{LONGEST + 1}").view(np.uint8).reshape(n, LONGEST + 1) if n else np.zeros((0, LONGEST + 1), np.uint8)

    @functools.cached_property
    def masks(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of a character in a row of masks; a row for each text: the text's places of a character, as bits, and 0 last."""
        letters = np.unique(self.chars)
        letters = letters[letters > 0]
        place = np.full(256, len(letters), np.int64)
        place[letters] = np.arange(len(letters))
        chars = _cut(self.chars, np.where(self.plain, self.size, 0))
        out = np.zeros((len(chars), len(letters) + 1), _whole(chars.shape[1]))
        for i in range(0, len(chars), MASKED):
            out[i : i + MASKED, :-1] = _masks(chars[i : i + MASKED], np.broadcast_to(letters, (len(chars[i : i + MASKED]), len(letters)))).T
        return place, out


def _masks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each place of b, and pair: the places in a of the same character, as bits. a, b: characters of pairs, a row each."""
    kind = _whole(a.shape[1])
    if a.shape[1] < 8 * kind.itemsize:
        a = np.pad(a, ((0, 0), (0, 8 * kind.itemsize - a.shape[1])))
    b = np.where(b == 0, np.uint8(255), b).T
    bits = np.packbits(b[:, :, None] == a[None], axis=-1, bitorder="little")
    return bits.view(kind)[:, :, 0]


def _step(s: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A character more of the longest common subsequence (Hyyro 2004): its length is the number of bits that are not set."""
    u = s & m
    return (s + u) | (s - u)


def _cut(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    return x[:, : max(1, int(size.max()))]


def _sorted_parts(order_by: np.ndarray, n: int):
    """Pairs in the order of their sizes, up to n at a time: those of a part need about as many places."""
    order = np.argsort(order_by, kind="stable")
    for i in range(0, len(order), n):
        yield order[i : i + n]


def _of_pairs(a: Texts, b: Texts, x: np.ndarray, y: np.ndarray, gone: np.ndarray | None = None) -> np.ndarray:
    """For each place of b, and pair: the places in a of the same character. gone: places of b that are left out."""
    place, masks = a.masks
    codes = place[_cut(b.chars[y], b.size[y])]
    if gone is not None:
        codes[gone[:, : codes.shape[1]]] = masks.shape[1] - 1
    return masks.ravel().take(codes.T + x[None] * masks.shape[1])


def _length(m: np.ndarray) -> np.ndarray:
    s = np.full(m.shape[1], ~m.dtype.type(0))
    for row in m:
        s = _step(s, row)
    return np.bitwise_count(~s).astype(np.int64)


def common(a: Texts, b: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of plain texts."""
    out = np.zeros(len(ia), np.int64)
    for rows in _sorted_parts(b.size[ib], PAIRS):
        out[rows] = _length(_of_pairs(a, b, ia[rows], ib[rows]))
    return out


def _ratios(same: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.where(total > 0, 2 * same / np.maximum(total, 1), 1.0)


def ratio(a: Texts, b: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    return _ratios(common(a, b, ia, ib), a.size[ia] + b.size[ib])


def _in_order(x: Texts) -> Texts:
    return Texts([" ".join(sorted(t.split())) if p else "" for t, p in zip(x.texts, x.plain, strict=True)])


def token_sort(a: Texts, b: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    return ratio(_in_order(a), _in_order(b), ia, ib)


def _tokens(x: Texts) -> list[list[str]]:
    return [sorted(set(t.split())) if p else [] for t, p in zip(x.texts, x.plain.tolist(), strict=True)]


class Tokens:
    """The distinct tokens of texts, in order and each with a blank before it; ids: their numbers, by known (none where a text has no
    more); token: whose a character is; bits: the places of a token."""

    def __init__(self, tokens: list[list[str]], known: dict[str, int], none: int):
        self.texts = Texts([f" {' '.join(x)}" if x else "" for x in tokens], LONGEST + 1)
        self.count = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = [t for x in tokens for t in x]
        row = np.repeat(np.arange(len(tokens)), self.count)
        column = np.arange(len(flat)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.ids = np.full((len(tokens), max(1, int(self.count.max(initial=0)))), none, np.int64)
        self.ids[row, column] = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        self.lengths = np.zeros(self.ids.shape, np.int64)
        self.lengths[row, column] = np.fromiter(map(len, flat), np.int64, len(flat)) + 1
        self.token = np.clip(np.cumsum(self.texts.chars == ord(" "), axis=1) - 1, 0, None)
        ends = np.cumsum(self.lengths, axis=1).astype(np.uint64)
        below = lambda x: np.where(x >= 64, ~np.uint64(0), (ONE << np.minimum(x, np.uint64(63))) - ONE)
        self.bits = below(ends) ^ below(ends - self.lengths.astype(np.uint64))


def token_set(a: Texts, b: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Both sides begin with the common tokens, so only what follows them, with the blank before it, is compared."""
    left, right = _tokens(a), _tokens(b)
    known = {t: i for i, t in enumerate(dict.fromkeys(t for x in (*left, *right) for t in x))}
    x, y = Tokens(left, known, -1), Tokens(right, known, -2)
    out = np.zeros(len(ia))
    for rows in _sorted_parts(y.texts.size[ib], PAIRS):
        i, j = ia[rows], ib[rows]
        equal = x.ids[i][:, :, None] == y.ids[j][:, None, :]
        p, q = equal.any(axis=2), equal.any(axis=1)
        n = np.where(p, x.lengths[i], 0).sum(axis=1)  # of the common tokens, with a blank each
        gone = np.take_along_axis(q, y.token[j], axis=1)
        kept = np.bitwise_or.reduce(np.where(p, np.uint64(0), x.bits[i]), axis=1)
        m = _of_pairs(x.texts, y.texts, i, j, gone)
        more = _length(m & kept.astype(m.dtype)[None])
        # without the first blank; every side has at least that
        u, v, same = x.texts.size[i] - 1, y.texts.size[j] - 1, n + more - 1
        best = _ratios(same, u + v)
        head = n - 1
        some = n > 0
        best = np.where(some, np.maximum(best, np.maximum(_ratios(head, head + u), _ratios(head, head + v))), best)
        best = np.where(some & (p.sum(axis=1) == x.count[i]) | some & (q.sum(axis=1) == y.count[j]), 1.0, best)
        out[rows] = np.where((x.count[i] > 0) & (y.count[j] > 0), best, 0.0)
    return out


def partial(a: Texts, b: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    out, rows = np.zeros(len(ia)), []
    for i, (j, k) in enumerate(zip(ia.tolist(), ib.tolist(), strict=True)):
        x, y = a.texts[j], b.texts[k]
        if not x or not y:
            out[i] = float(x == y)
        elif (x in y) or (y in x):
            out[i] = 1.0
        else:
            rows.append(i)
    if not rows:
        return out
    rows = np.array(rows)
    x, y = a.chars[ia[rows]], b.chars[ib[rows]]
    m, n = a.size[ia[rows]], b.size[ib[rows]]
    swap = (m > n)[:, None]
    short, long = np.where(swap, y, x), np.where(swap, x, y)
    m, n = np.minimum(m, n), np.maximum(m, n)
    best = _slides(short, long, m, n)
    same = np.flatnonzero(m == n)
    best[same] = np.maximum(best[same], _slides(long[same], short[same], n[same], m[same]))
    out[rows] = best
    return out


def _slides(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best ratio of a text a (of m characters) with a window of m characters of b (of n), or a shorter one at its ends."""
    out = np.zeros(len(a))
    for size in np.unique(m).tolist():
        of = np.flatnonzero(m == size)
        for part in _sorted_parts(n[of], WINDOWED):
            at = of[part]
            ends, longest = n[at], int(n[at].max())
            masks = _masks(a[at, :size], b[at, :longest])
            masks = np.concatenate([masks, np.zeros((size, len(at)), masks.dtype)])
            s = np.full((longest, len(at)), ~masks.dtype.type(0))  # a row for each place a window begins at
            best = np.zeros(len(at))
            for k in range(size):
                s = _step(s, masks[k : k + longest])
                # a window at the left end
                best = np.maximum(best, 2 * np.bitwise_count(~s[0]) / (size + np.minimum(k + 1, ends)))
            lengths = np.clip(ends[None, :] - np.arange(longest)[:, None], 0, size)
            out[at] = np.maximum(best, (2 * np.bitwise_count(~s) / (size + lengths)).max(axis=0))
    return out


def jaro_winkler(a: Texts, b: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ia))
    for rows in _sorted_parts(np.maximum(a.size[ia], b.size[ib]), PAIRS):
        x, y = _cut(a.chars[ia[rows]], a.size[ia[rows]]), _cut(b.chars[ib[rows]], b.size[ib[rows]])
        m, n = a.size[ia[rows]], b.size[ib[rows]]
        # bits are places in b, a row for each place in a
        masks = _masks(y, x).astype(np.uint64)
        reach = np.maximum(0, np.maximum(m, n) // 2 - 1)
        window = ~np.uint64(0) >> (np.uint64(63) - reach.astype(np.uint64))
        taken, left = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.uint64)
        for i, mask in enumerate(masks):
            free = mask & window & ~taken
            hit = free & (~free + ONE)
            taken |= hit
            left |= (hit != 0).astype(np.uint64) << np.uint64(i)
            window = (window << ONE) | (i + 1 <= reach)
        k = np.bitwise_count(left).astype(np.int64)
        swaps, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for _ in range(int(k.max(initial=0))):
            i, j = left & (~left + ONE), taken & (~taken + ONE)
            at = np.minimum(np.bitwise_count(i - ONE), len(masks) - 1)
            swaps += (j != 0) & ((masks[at, every] & j) == 0)
            left, taken = left ^ i, taken ^ j
        swaps //= 2
        s = np.where(k > 0, (k / np.maximum(m, 1) + k / np.maximum(n, 1) + (k - swaps) / np.maximum(k, 1)) / 3, 0.0)
        same, held = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        for c in range(min(4, x.shape[1], y.shape[1])):
            held = held & (x[:, c] == y[:, c]) & (x[:, c] != 0)
            same += held
        s = np.where(s > 0.7, s + 0.1 * same * (1 - s), s)
        whole = np.zeros(len(rows), bool)
        if x.shape[1] == y.shape[1]:
            whole = (x == y).all(axis=1)
        else:
            wide = min(x.shape[1], y.shape[1])
            whole = (m == n) & (x[:, :wide] == y[:, :wide]).all(axis=1)
        out[rows] = np.where(whole, 1.0, s)
    return out


MANY: dict[str, Callable] = {f.__name__: f for f in (jaro_winkler, token_sort, token_set, partial, ratio)}


def similarities(name: str, a: Texts, b: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """The similarity of that name of pairs of texts, given by their places."""
    fits = a.plain[ia] & b.plain[ib]
    out = np.zeros(len(ia))
    if (at := np.flatnonzero(fits)).size:
        out[at] = MANY[name](a, b, ia[at], ib[at])
    if (rest := np.flatnonzero(~fits)).size:
        one = similarity.FUNCTIONS[name]
        out[rest] = [one(a.texts[i], b.texts[j]) for i, j in zip(ia[rest].tolist(), ib[rest].tolist(), strict=True)]
    return out
