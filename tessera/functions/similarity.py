"""Pairwise string similarities, and an Arrow function that computes those of a pair that are asked for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _codes(a: str, b: str) -> tuple[bytes, bytes] | None:
    """The texts with one byte a character, none of them 0; None if they have too many different ones."""
    if a.isascii() and b.isascii() and "\0" not in a and "\0" not in b:
        return a.encode(), b.encode()
    known = {c: i for i, c in enumerate(dict.fromkeys(a + b), 1)}
    return (bytes(map(known.get, a)), bytes(map(known.get, b))) if len(known) < 256 else None


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity, raised by up to four common first letters where it exceeds 0.7 (Winkler 1990)."""
    if a == b:
        return 1.0
    m, n = len(a), len(b)
    if not m or not n:
        return 0.0
    reach = max(0, max(m, n) // 2 - 1)
    x, y = _codes(a, b) or (a, b)
    rest, free = (bytearray(y), 0) if isinstance(y, bytes) else (list(y), None)  # taken characters become `free`
    left, taken = [], []
    for i, c in enumerate(x):
        lo = i - reach if i > reach else 0
        if free is None:
            j = next((j for j in range(lo, min(n, i + reach + 1)) if rest[j] == c), -1)
        else:
            j = rest.find(c, lo, i + reach + 1)
        if j >= 0:
            rest[j] = free
            left.append(c)
            taken.append(j)
    k = len(left)
    if not k:
        return 0.0
    taken.sort()
    swaps = sum(c != y[j] for c, j in zip(left, taken, strict=True)) // 2
    s = (k / m + k / n + (k - swaps) / k) / 3
    if s > 0.7:
        same = 0
        for c, d in zip(a[:4], b[:4], strict=False):
            if c != d:
                break
            same += 1
        s += 0.1 * same * (1 - s)
    return s


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit vectors (Hyyro 2004)."""
    if not a or not b:
        return 0
    masks = masks or _masks(a)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths; 1 for two empty texts."""
    n = len(a) + len(b)
    return 2 * common(a, b) / n if n else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best ratio among the common tokens and the common tokens with either side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    p, q = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not p or not q):
        return 1.0
    u, v = f"{both} {p}".strip(), f"{both} {q}".strip()
    best = ratio(u, v)
    return max(best, ratio(both, u), ratio(both, v)) if both else best


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of its length in the longer, or a shorter one at its ends."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) > len(b):
        a, b = b, a
    if a in b:
        return 1.0
    best = _slide(a, b)
    return max(best, _slide(b, a)) if len(a) == len(b) else best


def _slide(a: str, b: str) -> float:
    """The best window of b for a. A window that ends in a character a hasn't (or, past b's end, begins with one) is no
    better than the one beside it."""
    m, n, masks, best = len(a), len(b), _masks(a), 0.0
    for i in range(1 - m, n):
        w = b[max(0, i) : i + m]
        if (w[-1] if i + m <= n else w[0]) not in masks:
            continue
        k = len(w)
        if 2 * min(m, k) / (m + k) > best:
            best = max(best, 2 * common(a, w, masks) / (m + k))
    return best


def doubles(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


# Each kernel: its function, the text it compares, and its value where a side is empty.
KERNELS = {
    "jw_root": (jaro_winkler, "name_root", 0.0),
    "sort_root": (token_sort, "name_root", 0.0),
    "set_root": (token_set, "name_root", 0.0),
    "partial_root": (partial, "name_root", 0.0),
    "qratio_root": (ratio, "name_root", 0.0),
    "jw_soundex": (jaro_winkler, "soundex_first", 0.0),
    "jw_addr": (jaro_winkler, "addr_std", 0.4),
    "sort_addr": (token_sort, "addr_std", 0.4),
    "set_addr": (token_set, "addr_std", 0.4),
    "core_addr_sort": (token_sort, "addr_core", 0.4),
    "core_addr_set": (token_set, "addr_core", 0.4),
}
KERNELS_B = {
    "name_ratio": (ratio, "clean_name", 0.0),
    "name_token_set": (token_set, "clean_name", 0.0),
    "name_token_sort": (token_sort, "clean_name", 0.0),
    "name_partial": (partial, "clean_name", 0.0),
    "name_jw": (jaro_winkler, "clean_name", 0.0),
    "addr_ratio": (ratio, "clean_full_address", 0.0),
    "addr_token_set": (token_set, "clean_full_address", 0.0),
    "addr_jw": (jaro_winkler, "clean_full_address", 0.0),
}
#: Pairs of texts whose similarity a worker remembers, by function.
REMEMBERED = 200_000
_REMEMBERING: dict = {}


def _memo(f):
    """f, remembering what it gave; one a worker process, so that the next batch and task find it."""
    return _REMEMBERING.setdefault(f, lru_cache(REMEMBERED)(f))


def kernels(names: tuple[str, ...] | list[str], table: dict = KERNELS) -> Column:
    """A struct of the named similarities of a pair's texts a_* and b_*; only these are computed, and a pair of texts that
    comes again isn't computed again."""
    texts = list(dict.fromkeys(table[n][1] for n in names))
    plan = [(table[n][0].__name__, texts.index(table[n][1]), table[n][2]) for n in names]

    @F.pandas_udf(doubles(tuple(names)))
    def run(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in columns:
            pairs = [list(zip(cols[2 * i], cols[2 * i + 1], strict=True)) for i in range(len(texts))]
            out = {}
            for name, (f, i, default) in zip(names, plan, strict=True):
                g = _memo(FUNCTIONS[f])
                out[name] = [g(x, y) if x and y else default for x, y in pairs[i]]
            yield pd.DataFrame(out, columns=list(names), dtype=float)

    return run(*(F.col(f"{side}_{t}") for t in texts for side in "ab"))


FUNCTIONS = {f.__name__: f for f in (jaro_winkler, token_sort, token_set, partial, ratio)}
