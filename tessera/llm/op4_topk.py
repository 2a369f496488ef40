"""Exact top-k search by the threshold algorithm (Fagin, Lotem, Naor 2003).

Vectors become integers floor(64 * x). Candidates are dealt by a hash of their id into blocks of bounded size, each
with one sorted list a dimension. A query walks the lists from the end that its sign favours, level by level: vectors
met for the first time are scored whole, which raises the k-th score; the sum over dimensions of the query's component times
the list's value at a depth bounds every vector not seen by then; the walk ends at the first level where that bound
falls below the k-th score, be it before the first place. Where by the k-th score so far no depth short of half the
lists can end a walk, the lists are read out, for all such queries at once.

Every query meets the first block before the others, and takes the k-th score of that block along to them as the least that
counts. Queries come in sets too; every set meets every candidate block once, and the blocks' best are merged by rank.

Results: a row for each query and rank. Vectors that are null, empty or hold null, infinite or undefined components
take no part; components and scores beyond a long's range are its largest or smallest value, and tie there; shorter
vectors count as filled up with zeros; ties go to the smaller vec_id; rows with the same id and equal score are ranked one
behind the other, and a query's own id is never its candidate; null ids take no part; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, table

TOP, EVERY = 20, 20
#: Rows of a candidate block and of a query block at most; candidate blocks at least (for spreading small tables).
BLOCK, QUERIES, SPREAD = 32_768, 32_768, 24
#: A walk begins with so many places of every list that they hold this share of the block at most, and may end at
#: LEVELS depths.
BEGIN, LEVELS = 1 / 8, 64
ROW = "vec_id long, v array<long>"
LONG = np.iinfo(np.int64)


def _whole(batches):
    """Integer vectors of the rows that take part."""
    for batch in batches:
        lists = batch.column("embedding")
        lists = pa.concat_arrays([lists])
        size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
        flat = pc.cast(lists.flatten(), pa.float64())
        x = np.asarray(pc.fill_null(flat, np.nan), dtype=np.float64)
        row = np.repeat(np.arange(len(size)), size)
        bad = np.bincount(row[~np.isfinite(x)], minlength=len(size)) > 0
        keep = (size > 0) & ~bad & np.asarray(pc.is_valid(batch.column("vec_id")))
        with np.errstate(over="ignore"):
            f = np.floor(64.0 * np.where(np.isfinite(x), x, 0.0))
        q = np.where(f >= 2.0**63, LONG.max, np.where(f <= -(2.0**63), LONG.min, np.clip(f, -(2.0**62), 2.0**62).astype(np.int64)))
        mid = (np.abs(f) > 2.0**62) & (np.abs(f) < 2.0**63)
        q[mid] = f[mid].astype(np.int64)
        kept = keep[row]
        at = np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)
        yield pa.record_batch([batch.column("vec_id").filter(pa.array(keep)), pa.ListArray.from_arrays(pa.array(at), pa.array(q[kept]))], ["vec_id", "v"])


def _most(v: np.ndarray) -> np.ndarray:
    """The largest size of a component, by row."""
    return np.maximum(v.max(axis=1, initial=0).astype(float), -v.min(axis=1, initial=0).astype(float))


def products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of two sets of rows: in floats where every sum is below their precision, else in integers, and
    in integers of any size for the rows whose sums may leave a long's range, where they stop at its ends."""
    mv, mq, width = _most(v), _most(q), max(1, v.shape[1])
    most = mv.max(initial=0) * mq.max(initial=0) * width
    for kind, limit in ((np.float32, 2**24), (np.float64, 2**53)):
        if most < limit:
            return (v.astype(kind) @ q.astype(kind).T).astype(np.int64)
    if most < 2**62:
        return v @ q.T
    out = np.zeros((len(v), len(q)), np.int64)
    for i, j in zip(*np.nonzero(mv[:, None] * mq[None, :] * width >= 2**62), strict=True):
        out[i, j] = min(max(sum(x * y for x, y in zip(v[i].tolist(), q[j].tolist(), strict=True)), LONG.min), LONG.max)
    small = mv[:, None] * mq[None, :] * width < 2**62
    for i in np.flatnonzero(small.any(axis=1)):
        out[i, small[i]] = q[small[i]] @ v[i]
    return out


class Lists:
    """A block of candidates with its sorted lists. `ended` counts the walks that the threshold ended."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        self.by_dim = np.argsort(self.v, axis=0, kind="stable").T.astype(np.int32)  # dimension x place, rising
        n = len(ids)
        first = max(1, int(n * BEGIN) // max(1, v.shape[1]))
        self.depths = np.concatenate([[0], np.unique(np.geomspace(first, max(n, first), LEVELS).astype(np.int64))]) if n else np.zeros(0, np.int64)
        at = np.minimum(self.depths, n - 1)
        value = lambda place: np.take_along_axis(self.v.T, self.by_dim[:, place], axis=1).astype(float)
        self.low, self.high = (value(at), value(n - 1 - at)) if n else (np.zeros((v.shape[1], 0)),) * 2
        self.ended = 0

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query the k best (id, score) among those that score `least` or more."""
        none = np.zeros(0, np.int64)
        if not len(self.ids):
            return [(none, none)] * len(queries)
        n, width = self.v.shape
        # what an unseen vector may score at most, by query and depth: each list's value at the next place
        q = queries.astype(float)
        bound = np.maximum(q, 0) @ self.high + np.minimum(q, 0) @ self.low
        bound += 1e-9 * np.abs(bound) + 1e-6  # the floats' own error
        out, rest = [(none, none)] * len(queries), []
        for i in range(len(queries)):
            kth = -np.inf if least is None else float(least[i])
            seen, scores, level = none, none, 0
            while bound[i, level] >= kth:
                ends = np.flatnonzero(bound[i, level:] < kth) if kth > -np.inf else None
                if ends is not None and (not len(ends) or self.depths[level + ends[0]] * width * 2 > n) or level + 1 == len(self.depths):
                    rest.append(i)
                    break
                level += 1
                now = self._seen(queries[i], int(self.depths[level]))
                fresh = np.setdiff1d(now, seen, assume_unique=True)
                seen = np.concatenate([seen, fresh])
                scores = np.concatenate([scores, products(self.v[fresh], queries[i : i + 1])[:, 0]])
                kth = max(kth, self._kth(scores[self.ids[seen] != own[i]], k))
            else:
                self.ended += 1
                out[i] = self._best(scores, seen, own[i], k, kth)
        every = np.arange(n)
        for a in range(0, len(rest), 256):
            part = rest[a : a + 256]
            s = products(self.v, queries[part])
            for j, i in enumerate(part):
                out[i] = self._best(s[:, j], every, own[i], k, -np.inf if least is None else float(least[i]))
        return out

    def _seen(self, q: np.ndarray, depth: int) -> np.ndarray:
        up, down = self.by_dim[q > 0, -depth:], self.by_dim[q < 0, :depth]
        return np.unique(np.concatenate([up.ravel(), down.ravel()])).astype(np.int64)

    @staticmethod
    def _kth(s: np.ndarray, k: int) -> float:
        return float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else -np.inf

    def _best(self, s: np.ndarray, rows: np.ndarray, own: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        keep = np.flatnonzero(s >= least) if least > -np.inf else np.arange(len(s))
        keep = keep[self.ids[rows[keep]] != own]
        if len(keep) > k:
            keep = keep[s[keep] >= np.partition(s[keep], len(keep) - k)[len(keep) - k]]
        ids, s = self.ids[rows[keep]], s[keep]
        order = np.lexsort((ids, -s.astype(object) if len(s) and s.min() == LONG.min else -s))[:k]
        return ids[order], s[order]


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    size = np.asarray(pc.list_value_length(v)).astype(np.int64)
    flat = np.asarray(v.flatten())
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _search(width: int, k: int):
    """Best candidates of each pair of blocks; rows come sorted by pair."""

    def solve(t: pa.Table):
        t = t.combine_chunks()
        query = t.column("query").to_numpy()
        ids = t.column("vec_id").to_numpy()
        v = _matrix(t.column("v").chunk(0) if t.num_rows else pa.array([], pa.list_(pa.int64())), width)
        lists = Lists(ids[~query], v[~query])
        own = ids[query]
        least = np.asarray(pc.fill_null(t.column("least"), LONG.min))[query]
        best = lists.top(v[query], own, k, np.where(least == LONG.min, -np.inf, least.astype(float)))
        n = [len(x) for x, _ in best]
        none = np.zeros(0, np.int64)
        cols = [np.repeat(own, n), np.concatenate([none, *(x for x, _ in best)]), np.concatenate([none, *(s for _, s in best)])]
        return pa.record_batch([pa.array(c.astype(np.int64)) for c in cols], ["query_id", "vec_id", "score"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            c, q = t.column("cb").to_numpy(), t.column("qb").to_numpy()
            new = np.flatnonzero((c[1:] != c[:-1]) | (q[1:] != q[:-1])) + 1
            for a, b in zip([0, *new[:-1]], new, strict=False):
                yield solve(t.slice(int(a), int(b - a)))
            rest = t.slice(int(new[-1])) if len(new) else t
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return run


def top_k(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of the vectors (vec_id, embedding) whose id `every` divides, against all others."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.keep(rows.mapInArrow(_whole, ROW), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, q, width = rows.agg(F.count("*"), F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    blocks, sets = max(-(-n // BLOCK), min(SPREAD, max(1, n // 64))), max(1, -(-q // QUERIES))
    block, set_ = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(sets)).cast("int")
    held = rows.select(block.alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("qb"), F.lit(False).alias("query"), F.lit(None).cast("long").alias("least"), "vec_id", "v")
    queries = rows.where(is_query)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def meet(candidates: DataFrame, asked: DataFrame, first: int, last: int) -> DataFrame:
        asked = asked.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("cb"), set_.alias("qb"), F.lit(True).alias("query"), "least", "vec_id", "v")
        pairs = candidates.unionByName(asked).repartition("cb", "qb").sortWithinPartitions("cb", "qb")
        return pairs.mapInArrow(_search(width, k), "query_id long, vec_id long, score long")

    found = scratch.keep(meet(held.where("cb = 0"), queries.withColumn("least", F.lit(None).cast("long")), 0, 0), "first")
    if blocks > 1:
        least = found.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        found = found.unionByName(meet(held.where("cb > 0"), queries.join(least, "vec_id", "left"), 1, blocks - 1))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {TOP}
"""
