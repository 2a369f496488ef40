"""N-gram Jaccard join by grouped prefixes.

Sets are distinct k-word shingles (64-bit hashes; two different shingles are taken as equal with probability 2^-64).
Equal sets collapse into one class, kept by its least doc_id. The global order of shingles is (frequent?, hash):
frequent shingles come last, so that prefixes hold rare ones; any order gives the same links. Classes with the same
prefix and size form one group; groups that share a prefix shingle are compared by size and position, then expanded,
and members' pairs are filtered by a parity bitmap whose difference never exceeds the sets' own. What is left is
checked on bitmaps that grow with the sets, then verified on whole sets: first a spanning forest of the survivors, then every survivor that still lies between two
components. So a cluster of n near copies costs about n verifications and not n squared, and no link between two
components is lost. Posting lists over BLOCK classes are split into pairs of chunks, each a task's work of its own.

Results: one row per document with n_shingles and component_id. Null, empty or blank texts have no shingles and form
a component of their own; repeated texts fall in one class; a repeated doc_id gives a row each; null doc_ids are left
out, as they name no document; no documents give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lists, shingle_sets, steps, table
from tessera.llm.graph import components

#: A shingle in at least so many prefixes counts as frequent; raised until at most HEAVY_MOST are.
HEAVY, HEAVY_MOST = 32, 1 << 20
#: Classes of one posting list that one task compares at once.
BLOCK = 1024
#: Ids that one_of_each() sends to all executors at most (16 MB); more are joined by a shuffle.
SENT_IDS = 2_000_000
#: Bits of the parity bitmap; bits of the filter of documents to verify.
BITS, FILTER_BITS = 1024, 1 << 21


def prefix_length(n: int, percent: int) -> int:
    """Two sets of at least `percent` similarity share a shingle among the first so many of either."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _frequent_counts(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for part in steps(batch, limit=2 << 20):
                sets = shingle_sets(part.column("text"), k)
                tokens = [s[: prefix_length(len(s), percent)] for s in sets]
                u, c = np.unique(np.concatenate(tokens) if tokens else np.zeros(0, np.uint64), return_counts=True)
                yield pa.record_batch([pa.array(u.view(np.int64)), pa.array(c, pa.int64())], ["token", "c"])

    return run


def frequent(docs: DataFrame, scratch: Scratch, k: int, percent: int) -> np.ndarray:
    """Shingles that open many sets in hash order, HEAVY_MOST at most (8 MB), sorted."""
    counts = docs.select("text").mapInArrow(_frequent_counts(k, percent), "token long, c long")
    often = scratch.keep(counts.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= HEAVY), "frequent")
    sizes = {r[0]: r[1] for r in often.groupBy(F.floor(F.log2("c")).cast("int")).count().collect()}
    least = HEAVY
    while sum(n for e, n in sizes.items() if 2 ** (e + 1) > least) > HEAVY_MOST:
        least = 2 ** (int(np.log2(least)) + 1)
    out = often.where(F.col("c") >= least).select("token").toArrow().column(0).to_numpy()
    return np.sort(out.view(np.uint64))


def wide_bits(n: int) -> int:
    """Bits of the bitmap that grows with the set: a power of two, twice the set's size at least."""
    return max(BITS, 1 << (2 * n - 1).bit_length()) if n else BITS


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Of each value of the hash modulo bits, whether it is taken by an odd number of shingles."""
    return (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)


def most_apart(n, percent: int):
    """The largest symmetric difference of two linked sets of n shingles together."""
    return n - 2 * -(-percent * n // (100 + percent))


def _signatures(k: int, percent: int, heavy):
    def run(batches):
        often = heavy.value
        for batch in batches:
            for part in steps(batch, limit=2 << 20):
                ids, n, f1, f2, bits, wide, pre = part.column("doc_id"), [], [], [], [], [], []
                for s in shingle_sets(part.column("text"), k):
                    p = prefix_length(len(s), percent)
                    for most in (2 * p, len(s)):
                        head = s[:most]
                        if len(often):
                            at = np.minimum(np.searchsorted(often, head), len(often) - 1)
                            is_heavy = often[at] == head
                            light = head[~is_heavy]
                        else:
                            is_heavy, light = np.zeros(len(head), bool), head
                        if len(light) >= p:
                            break
                    chosen = light[:p] if len(light) >= p else np.concatenate([light, head[is_heavy]])[:p]
                    n.append(len(s))
                    raw = s.tobytes()
                    f1.append(xxhash.xxh3_64_intdigest(raw, 1))
                    f2.append(xxhash.xxh3_64_intdigest(raw, 2))
                    odd = parity(s, wide_bits(len(s)))
                    wide.append(np.packbits(odd).tobytes())
                    bits.append(np.packbits(np.bitwise_xor.reduce(odd.reshape(-1, BITS), axis=0)).tobytes())
                    pre.append(chosen.view(np.int64))
                gid = [xxhash.xxh3_64_intdigest(x.tobytes(), len(x) + m) for x, m in zip(pre, n, strict=True)]
                u64 = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.record_batch([ids, pa.array(n, pa.int64()), u64(f1), u64(f2), u64(gid), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), lists(pre, pa.int64())], ["doc_id", "n", "f1", "f2", "gid", "bits", "wide", "prefix"])

    return run


SIGNATURE = "doc_id long, n long, f1 long, f2 long, gid long, bits binary, wide binary, prefix array<long>"


def _between(g: np.ndarray, h: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members' pairs of groups' pairs; of a group with itself each pair once."""
    each = count[g] * count[h]
    which = np.repeat(np.arange(len(g)), each)
    at = np.arange(len(which)) - np.repeat(np.cumsum(each) - each, each)
    a, b = start[g][which] + at // count[h][which], start[h][which] + at % count[h][which]
    keep = (g[which] != h[which]) | (a < b)
    return a[keep], b[keep]


def _candidates(block: dict, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of sorted postings that pass every filter, and how far their bitmaps differ."""
    key, n, gid, pos = block["key"], block["n"], block["gid"], block["pos"]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (gid[1:] != gid[:-1]) | (block["side"][1:] != block["side"][:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(key)))
    gk, gn, gp, gs, cross = key[start], n[start], pos[start], block["side"][start], block["cross"][start]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def expand(g, h):
        step = 200_000
        size = np.cumsum(count[g] * count[h])
        i = 0
        while i < len(g):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + step, side="right")))
            a, b = _between(g[i:j], h[i:j], start, count)
            i = j
            keep = block["comp"][a] != block["comp"][b]
            a, b = a[keep], b[keep]
            most = most_apart(n[a] + n[b], percent)
            diff = np.bitwise_count(block["bits"][a] ^ block["bits"][b]).sum(axis=1, dtype=np.int64)
            keep = diff <= most
            found.append((a[keep], b[keep], diff[keep]))

    own = np.flatnonzero((count > 1) & ~cross)
    expand(own, own)
    g = np.arange(len(start))
    d = 0
    while len(g):
        d += 1
        g = g[g + d < len(start)]
        g = g[(gk[g] == gk[g + d])]
        near = g[100 * gn[g] >= percent * gn[g + d]]  # sizes rise within a block
        g = near
        h = near + d
        least = -(-percent * (gn[near] + gn[h]) // (100 + percent))
        bound = 1 + np.minimum(gp[near], gp[h]) + np.minimum(gn[near] - gp[near], gn[h] - gp[h]) - 1
        keep = (bound >= least) & (~cross[near] | (gs[near] != gs[h]))
        if keep.any():
            expand(near[keep], h[keep])
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Forest:
    """Union-find over the documents one task sees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, root)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _blocks(percent: int, forest: bool):
    """Survivors' pairs (a, b), a < b, of postings that come sorted by block, size and group."""

    def run(batches):
        tree, rest = Forest(), None

        def solve(t: pa.Table):
            c = {x: t.column(x).to_numpy() for x in ("token", "i", "j", "n", "gid", "pos", "doc", "comp", "side")}
            changes = np.zeros(len(c["doc"]), np.int64)
            for x in ("token", "i", "j"):
                changes[1:] |= c[x][1:] != c[x][:-1]
            raw = b"".join(t.column("bits").to_pylist())
            block = c | {"key": np.cumsum(changes), "cross": c["i"] != c["j"], "bits": np.frombuffer(raw, np.uint64).reshape(-1, BITS // 64)}
            a, b, diff = _candidates(block, percent)
            a, b = c["doc"][a], c["doc"][b]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            if forest:
                ca, cb = lo.tolist(), hi.tolist()
                kept = [x for x in np.argsort(diff, kind="stable").tolist() if tree.join(ca[x], cb[x])]
                lo, hi = lo[kept], hi[kept]
            return pa.record_batch([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
            same = np.ones(t.num_rows, bool)
            for x in ("token", "i", "j"):
                v = t.column(x).to_numpy()
                same &= v == v[-1] if len(v) else same
            cut = t.num_rows - int(same.sum())
            rest = t.slice(cut)
            if cut:
                yield solve(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return run


def _sets(k: int, wanted):
    """Whole sets of the documents that the filter may hold."""

    def run(batches):
        bits = wanted.value
        for batch in batches:
            h = batch.column("h").to_numpy()
            rows = np.flatnonzero((bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1))
            if len(rows):
                for part in steps(batch.take(pa.array(rows)), limit=2 << 20):
                    sets = shingle_sets(part.column("text"), k)
                    yield pa.record_batch([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])

    return run


def _plausible(percent: int):
    """Pairs whose wide bitmaps, the wider folded onto the other, differ no more than linked sets may."""

    def run(batches):
        for batch in batches:
            keep = []
            most = most_apart(batch.column("na").to_numpy() + batch.column("nb").to_numpy(), percent)
            for x, y, m in zip(batch.column("wa").to_pylist(), batch.column("wb").to_pylist(), most.tolist(), strict=True):
                x, y = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= m)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose whole sets reach the similarity. Only documents in a fixed-size filter of the pairs' ids are split again."""
    spark = docs.sparkSession
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).select(slot("id").alias("h"))
    found = ids.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("v")).collect()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    for w, v in found:
        bits[w] = np.uint64(v & (2**64 - 1))
    sets = docs.select("doc_id", "text", slot("doc_id").alias("h")).mapInArrow(_sets(k, spark.sparkContext.broadcast(bits)), "doc_id long, shingles binary")
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_verify(percent), "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text), linked at `percent` Jaccard similarity of k-word shingles."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    heavy = spark.sparkContext.broadcast(frequent(docs, scratch, k, percent))
    signed = scratch.keep(docs.mapInArrow(_signatures(k, percent, heavy), SIGNATURE), "signed")
    classes = scratch.keep(signed.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")

    # one posting for each prefix shingle of each class; lists of one class link nothing
    reps = signed.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").where("n > 0")
    tokens = reps.select("doc_id", F.posexplode("prefix").alias("pos", "token"))
    sizes = scratch.keep(tokens.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
    posts = scratch.keep(tokens.join(sizes, "token").select("token", "c", F.col("doc_id").alias("doc"), "pos"), "posts")
    facts = scratch.keep(reps.join(posts.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), "n", "gid", "bits", "wide"), "facts")

    def pairs(comp: DataFrame | None) -> DataFrame:
        p = posts.join(facts.drop("wide"), "doc")
        p = p.join(comp.select(F.col("node").alias("doc"), F.col("root").alias("comp")), "doc", "left").withColumn("comp", F.coalesce("comp", "doc")) if comp is not None else p.withColumn("comp", F.col("doc"))
        p = p.withColumn("chunks", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("doc", "token"), F.col("chunks")).cast("int"))
        p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        p = p.select("token", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "n", "gid", "pos", "doc", "comp", "side", "bits")
        p = p.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "gid", "side")
        found = scratch.keep(p.mapInArrow(_blocks(percent, comp is None), "a long, b long").distinct(), "near" if comp is None else "near-rest")
        of = lambda x: facts.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
        return found.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(_plausible(percent), "a long, b long")

    first = scratch.keep(pairs(None), "forest")
    links = scratch.keep(verified(docs, first, k, percent), "links")
    comp = components(links, scratch, "c1")
    rest = scratch.keep(pairs(comp), "rest")
    more = scratch.keep(verified(docs, rest, k, percent), "more")
    roots = components(links.unionByName(more), scratch, "c2")

    root = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("n", "f1", "f2", F.coalesce("root", "rep").alias("component_id"))
    root = scratch.keep(root, "roots")
    own = signed.select("doc_id", "n", "f1", "f2")
    linked = own.where("n > 0").join(root, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The documents, with all their columns, without those that have a lesser doc_id in their component; of rows that
    repeat a doc_id one stays. Rows without a doc_id stay."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(jaccard_components(docs, k, percent), "components")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    name = "gone"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    gone = scratch.keep(gone.withColumnRenamed("doc_id", name), "gone")
    # texts needn't move while the ids that go are few enough to be sent to all executors
    few = gone.count() <= SENT_IDS
    kept = docs.join(F.broadcast(gone) if few else gone.hint("merge"), F.col("doc_id") == F.col(name), "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").head(1):
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
