"""Best-fit packing of tokenised documents under several capacities.

Every document becomes its token ids and then id 0; one longer than the sequence is cut into full pieces, the first
taking what is over. A piece is a vector: its tokens, one document, and its attention cost (length squared). Which
sequence a piece joins depends on its length alone, so the packing is solved on the histogram of lengths, which has
at most as many rows as a sequence has tokens, whatever the corpus: from the longest down, pieces join the open
sequences whose residual capacities fit best, by weighted dot product or by least weighted residual norm, many equal
sequences at a time. The solution is a small table of slots (length, first rank, sequences, offset); a piece finds
its slot by its rank among the pieces of its length, counted per task and summed over tasks.

With the capacities of the contract (a sequence's tokens alone are limited) no sequence can exceed the document and
attention capacities before its tokens; their residuals weigh as much as the tokens' in the choice among sequences.

Results: one row per piece. Null and empty texts are one piece of the single id 0; repeated rows are packed each by
itself, under their own doc_id, which may be null; no documents give no rows; further columns are ignored. Ties go to
the sequence opened first.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, settle, steps, table


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and the weights of its three residuals."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Rank rows that are sent to all executors at most (20 MB or so).
SENT_RANKS = 200_000
#: Bytes of a chunk that Merges takes at most; ids that it holds as a table; the rank of a pair without a merge.
LONG, CELLS, NONE = 64, 1 << 18, np.iinfo(np.int32).max
#: White space that is not ASCII.
WIDE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = r"[^\x00-\x{24f}]"


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in such vocabularies: itself where it prints, else the next from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_SIGNS = _byte_signs()
#: What _kinds() says of a byte alone.
BYTE_KINDS = np.array([4 if b == 32 or 9 <= b <= 13 else 0 if b < 33 or b == 127 else 3 if chr(b).isdigit() and b < 128 else 1 if chr(b).isalpha() and b < 128 else 2 if b < 127 else 1 if 0xC3 <= b <= 0xC8 else 0 for b in range(256)], np.uint8)


def _by_bytes(tokenizer) -> bool:
    """Whether the file holds plain byte-level BPE, whose pre-tokens end where Ids cuts and whose words Merges joins."""
    pre, model = tokenizer.pre_tokenizer, tokenizer.model
    plain = type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space
    if not plain or type(model).__name__ != "BPE" or tokenizer.normalizer is not None:
        return False
    odd = (model.dropout, model.continuing_subword_prefix, model.end_of_word_suffix, model.byte_fallback, model.ignore_merges)
    return not any(odd) and all(tokenizer.token_to_id(chr(BYTE_SIGNS.get(b, b))) is not None for b in range(256))


class Merges:
    """The merges of a byte-level vocabulary, for many words at a time: in each round every word joins its pair of the
    least rank, the leftmost of equal ones, as the model does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte = np.array([vocab[chr(BYTE_SIGNS.get(b, b))] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rank = {(vocab[a] << 32) | vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.joined = np.array([vocab[a + b] for a, b in pairs] or [0], np.int32)
        self.bits = max(10, 2 + len(pairs).bit_length())
        self.key, self.rank, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32), 1
        key, value = np.array(list(rank), np.int64), np.array(list(rank.values()), np.int32)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.key[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.key[at[put]], self.rank[at[put]] = key[put], value[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, value, at = key[rest], value[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where there is no merge; ids below 0 stand for nothing."""
        key = (left.astype(np.int64) << 32) | right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        seen = self.key[at]
        out = np.where(seen == key, self.rank[at], NONE)
        rest = np.flatnonzero((seen != key) & (seen >= 0) & (key >= 0))
        at = at[rest]
        for _ in range(self.probes):
            if not len(rest):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            seen, want = self.key[at], key[rest]
            hit = seen == want
            out[rest[hit]] = self.rank[at[hit]]
            more = ~hit & (seen >= 0)
            rest, at = rest[more], at[more]
        return out

    def words(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words raw[first : first + size] one after another, and how many each has."""
        count, order = np.zeros(len(first), np.int64), np.argsort(size, kind="stable")
        parts, lo = [], 0
        while lo < len(order):
            # words of like sizes at a time, the narrow ones together
            narrow = int(size[order[lo]])
            width = narrow + (narrow > 3) + (narrow > 11) * narrow // 4
            hi = min(int(np.searchsorted(size[order], width, side="right")), lo + max(1, CELLS // max(width, 1)))
            own = order[lo:hi]
            width = max(int(size[own[-1]]), 1)
            place = np.arange(width)
            inside = place < size[own][:, None]
            ids = np.where(inside, self.byte[raw[np.minimum(first[own][:, None] + place, len(raw) - 1)]], -1)
            self._join(ids)
            count[own] = (ids >= 0).sum(axis=1)
            parts.append(ids[ids >= 0])
            lo = hi
        # from the order of sizes back to the words' own
        n = count[order]
        start = np.zeros(len(first), np.int64)
        start[order] = np.cumsum(n) - n
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(flat))
        return flat[at].astype(np.uint32), count

    def _join(self, ids: np.ndarray) -> None:
        """Merge the rows of ids (filled up with -1) in place."""
        if ids.shape[1] < 2:
            return
        row, now = np.arange(len(ids)), ids.copy()
        rank = self.ranks(now[:, :-1].ravel(), now[:, 1:].ravel()).reshape(len(now), -1)
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(now)), at]
            on = best < NONE
            if not on.all():
                ids[row[~on], : now.shape[1]] = now[~on]
                ids[row[~on], now.shape[1] :] = -1
                row, now, rank, at, best = row[on], now[on], rank[on], at[on], best[on]
            if not len(row):
                return
            width, i = now.shape[1], np.arange(len(row))
            # the pair becomes one id, what follows moves up
            at_ = at[:, None]
            now[i, at] = self.joined[best]
            after = np.arange(width - 1)
            now = np.where(after <= at_, now[:, :-1], now[:, 1:])
            if width == 2:
                ids[row, 0], ids[row, 1:] = now[:, 0], -1
                return
            rank = np.where(after[:-1] < at_, rank[:, :-1], rank[:, 1:])
            left, right = at > 0, at < width - 2
            where = np.concatenate([i[left] * (width - 2) + at[left] - 1, i[right] * (width - 2) + at[right]])
            cell = np.concatenate([i[left] * (width - 1) + at[left] - 1, i[right] * (width - 1) + at[right]])
            flat = now.ravel()
            rank.ravel()[where] = self.ranks(flat[cell], flat[cell + 1])


class Ids:
    """Token ids of whole texts, by way of chunks.

    The vocabulary's pre-tokens never reach over a white space's end but for one blank before what follows, nor from a
    Latin letter over the sign behind it, so the ids of a text are those of its chunks between such places one after
    another. Chunks repeat, so each is encoded once a step: those of letters, digits or signs alone are one pre-token
    and go through Merges together, the others through the tokenizer's own pre-tokenizer and model. Texts with white space
    beyond ASCII or with an added token's text, and chunks with letters beyond Latin ones, go through the whole tokenizer;
    so does every text if the file holds another kind of tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.pretokens = self.tokenizer.model, self.tokenizer.pre_tokenizer
        whole = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = _by_bytes(self.tokenizer)
        self.whole = "|".join([f"[{WIDE}]", *whole]) if plain else "(?s)."
        self.merges = Merges(path) if plain else None

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _one_by_one(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that may be several pre-tokens, or long."""
        flat, size = [], []
        odd = pc.match_substring_regex(chunks, ODD).to_pylist()
        for chunk, strange in zip(chunks.to_pylist(), odd, strict=True):
            if strange:
                ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            else:
                ids = [t.id for signs, _ in self.pretokens.pre_tokenize_str(chunk) for t in self.model.tokenize(signs)]
            flat += ids
            size.append(len(ids))
        return np.array(flat, np.uint32), np.array(size, np.int64)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, and where each one's begin and how many they are."""
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1].astype(np.int64)
        raw = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        first, size = offsets[:-1], np.diff(offsets)
        kind = _kinds(raw)
        # a blank in front belongs to what follows; white space alone is one pre-token, with others it is not
        core = np.minimum(first + ((raw[first] == 32) & (size > 1)), len(raw) - 1)
        change = np.concatenate([[0], np.cumsum(kind[1:] != kind[:-1])])
        simple = (kind[core] > 0) & (change[offsets[1:] - 1] == change[core]) & (size <= LONG)
        fast, slow = np.flatnonzero(simple), np.flatnonzero(~simple)
        a, n = self.merges.words(raw, first[fast], size[fast])
        b, m = self._one_by_one(chunks.filter(pa.array(~simple)))
        count, start = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        count[fast], count[slow] = n, m
        start[fast], start[slow] = np.cumsum(n) - n, len(a) + np.cumsum(m) - m
        return np.concatenate([a, b]), start, count

    def texts(self, column: pa.Array) -> list[np.ndarray]:
        column = pa.concat_arrays([pc.fill_null(column, "")])
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(column)
        wide = np.asarray(pc.match_substring_regex(column, self.whole))
        if wide.any():
            for i, ids in zip(np.flatnonzero(wide), self._encode(column.filter(pa.array(wide)).to_pylist()), strict=True):
                out[i] = ids
        plain = np.flatnonzero(~wide)
        if not len(plain):
            return out
        column = column.filter(pa.array(~wide))
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        if lo == hi:
            return out
        raw = np.frombuffer(column.buffers()[2], np.uint8)[lo:hi]
        cuts = np.flatnonzero(_starts(raw, offsets - lo))
        chunks = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer((cuts + lo).astype(np.int32)), column.buffers()[2]).dictionary_encode()
        flat, first, size = self._chunks(chunks.dictionary)
        which = np.asarray(chunks.indices)
        count = size[which]
        ends = np.cumsum(count)
        ids = flat[np.repeat(first[which] - (ends - count), count) + np.arange(int(ends[-1]))]
        bounds = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets - lo)]
        for i, a, b in zip(plain, bounds[:-1], bounds[1:], strict=True):
            out[i] = ids[a:b]
        return out


def _kinds(raw: np.ndarray) -> np.ndarray:
    """Of each byte: part of a Latin letter (1), an ASCII sign (2), an ASCII digit (3), white space (4), or something else (0)."""
    kind = BYTE_KINDS[raw]
    # the second byte of a letter from U+00C0 to U+023F, but for the two signs among them
    lead = (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC8)
    sign = (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    kind[1:][lead & ~sign] = 1
    return kind


def _starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, and True for the end; texts begin at offsets."""
    n, kind = len(raw), _kinds(raw)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    space = kind == 4
    start = first.copy()
    # a run of white space begins, or its last character, which stands before something of the same text
    last = space[:-1] & ~space[1:] & ~first[1:n]
    start[1:n] |= (space[1:] & ~space[:-1]) | ((kind[1:] == 2) & (kind[:-1] == 1)) | (last & (raw[:-1] != 32))
    start[: n - 1] |= last
    return start


_CODERS: dict[str, Ids] = {}


def coder_of(path: str) -> Ids:
    """One per worker process, so that the next task finds what it remembers."""
    if path not in _CODERS:
        _CODERS[path] = Ids(path)
        settle()
    return _CODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def _pieces(path: str, most: int):
    def run(batches):
        coder, part, seen = coder_of(path), TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in batches:
            for step in steps(batch):
                rows: list[tuple] = []
                for doc, ids in zip(step.column("doc_id").to_pylist(), coder.texts(step.column("text")), strict=True):
                    ids = np.append(ids, np.uint32(0)).astype("<u4")
                    first = (len(ids) - 1) % most + 1
                    for k, a in enumerate([0, *range(first, len(ids), most)]):
                        b = first if not k else a + most
                        rows.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, int(seen[b - a])))
                        seen[b - a] += 1
                cols = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return run


def solve(counts: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, how many, first sequence, offset) for counts of pieces by length."""
    weights = np.array(cap.weights)
    whole = np.array([cap.tokens, cap.documents, cap.attention], float)
    left = np.zeros((0, 3))
    open_n: list[int] = []
    shapes: list[tuple[int, ...]] = []
    index: dict[tuple[int, ...], int] = {}

    def add(shape: tuple[int, ...], rest: np.ndarray, n: int) -> None:
        nonlocal left
        if shape in index:
            open_n[index[shape]] += n
            return
        index[shape] = len(shapes)
        shapes.append(shape)
        open_n.append(n)
        if len(shapes) > len(left):
            left = np.vstack([left, np.full((max(64, len(left)), 3), -1.0)])
        left[len(shapes) - 1] = rest

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        need, todo = np.array([length, 1, length * length], float), counts[length]
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while todo:
            k = len(shapes)
            n = np.array(open_n, np.int64)
            fits = np.flatnonzero((n > 0) & (left[:k] >= need).all(axis=1)) if k else np.zeros(0, np.int64)
            if not len(fits):
                each = int(min(whole[0] // need[0], whole[1], whole[2] // need[2]))
                full, over = divmod(todo, each)
                if full:
                    add((length,) * each, whole - each * need, full)
                if over:
                    add((length,) * over, whole - over * need, 1)
                break
            if cap.rule == "dot":
                score = -((left[fits] / whole) * (need / whole) @ weights)
            else:
                score = (((left[fits] - need) / whole) ** 2) @ weights
            best = int(fits[np.argmin(score)])
            take = min(todo, open_n[best])
            open_n[best] -= take
            todo -= take
            add((*shapes[best], length), left[best] - need, take)

    slots, used, base = [], dict.fromkeys(counts, 0), 0
    for shape, n in zip(shapes, open_n, strict=True):
        if n:
            at = 0
            for length in shape:
                slots.append((length, used[length], n, base, at))
                used[length] += n
                at += length
            base += n
    return slots


def _place(slots):
    def run(batches):
        length, first, _, base, at = slots.value
        key = length * (1 << 44) + first
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(key, own * (1 << 44) + rank, side="right") - 1
            kept = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(base[i] + rank - first[i]), pa.array(at[i])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, cap: Capacity = Capacity(), tokenizer: str | None = None) -> DataFrame:  # noqa: B008
    """Pieces of documents (doc_id, text) with the sequence and the place each takes."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.keep(docs.mapInArrow(_pieces(tokenizer or default_tokenizer(), cap.tokens), PIECES), "pieces")
    parts = scratch.keep(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "parts")
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("n")).collect()}
    slots = np.array(sorted(solve(counts, cap)), np.int64).reshape(-1, 5).T
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = scratch.keep(parts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "ranks")
    few = ranks.count() <= SENT_RANKS
    ranked = pieces.join(F.broadcast(ranks) if few else ranks.hint("merge"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInArrow(_place(spark.sparkContext.broadcast(slots)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
