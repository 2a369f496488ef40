import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import op9_packing as op

SCHEMA = "doc_id long, text string"


def valid(rows, cap=op.Capacity()):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(pieces) <= cap.documents and sum(n * n for _, n in pieces) <= cap.attention
    return len(bins)


def expected(rows, most=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op.default_tokenizer())
    out = []
    for doc, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % most + 1, len(ids), most), len(ids)]
        out += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return sorted(out, key=str)


def got(rows):
    return sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=str)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, " x  y\n\n z \t"), (5, "word " * 5000), (6, "It's so   wide's 12 <|endoftext|> end"), (7, "né\r\n\x0b 'll"), (None, "a"), (3, "a"), (8, "x" * 30000), (9, "a\x1cb c")]
    out = op.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got(out) == expected(rows)
    valid(out)


def test_empty(spark):
    assert op.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    out = op.op9_best_fit_packing(spark, "/root/testdata/sf0.01").collect()
    assert got(out) == expected(rows)
    assert valid(out) <= -(-sum(r.length for r in out) // 2048) + 2


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_capacities(spark, rule):
    rng = np.random.default_rng(0)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 100, 3000), return_counts=True), strict=True)}
    cap = op.Capacity(tokens=128, documents=4, attention=10000, weights=(1.0, 0.5, 0.5), rule=rule)
    bins = defaultdict(list)
    seen = defaultdict(list)
    for length, rank, n, base, at in op.solve(counts, cap):
        for i in range(n):
            bins[base + i].append((at, length))
            seen[length].append(rank + i)
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    for pieces in bins.values():
        assert len(pieces) <= 4 and sum(n for _, n in pieces) <= 128 and sum(n * n for _, n in pieces) <= 10000
    assert len(bins) <= 1.25 * max(sum(k * n for k, n in counts.items()) / 128, sum(k * k * n for k, n in counts.items()) / 10000, 3000 / 4)


def test_ids_equal_the_tokenizers():
    """Texts of plain and odd white space, signs, letters of many scripts, and whole and broken texts of added tokens."""
    import random

    import pyarrow as pa

    coder, r = op.Ids(op.default_tokenizer()), random.Random(1)
    parts = ["a", "It's", " ", "  ", "\n", "<|", "|>", "endoftext", "<|endoftext|>", "é", "12", "!", "x1", "ñ", "'ll", " '", "\t", "\u2003", "中", "<|endof", "A", "_", "\x1c", "ß"]
    texts = ["It's so   wide's 12 <|endoftext|> end", "<|endoftext|>", "<|endoftext|", *("".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(5000))]
    for text, ids in zip(texts, coder.texts(pa.array(texts)), strict=True):
        assert ids.tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_another_kind_of_tokenizer_reads_whole_texts(tmp_path):
    import json

    import pyarrow as pa

    spec = json.loads(open(op.default_tokenizer(), encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    coder = op.Ids(str(path))
    texts = ["a b!c", "", "word", None]
    assert [x.tolist() for x in coder.texts(pa.array(texts))] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_the_vector_chooses_other_sequences_at_no_cost(spark):
    counts = {r[0]: r[1] for r in op.op9_best_fit_packing(spark, "/root/testdata/sf0.01").groupBy("length").count().collect()}
    vector, scalar = op.solve(counts, op.Capacity()), op.solve(counts, op.Capacity(weights=(1.0, 0.0, 0.0)))
    assert vector != scalar
    assert max(n + base for _, _, n, base, _ in vector) == max(n + base for _, _, n, base, _ in scalar) == -(-sum(k * n for k, n in counts.items()) // 2048)


def test_both_joins_and_clashing_columns(spark, monkeypatch):
    rows = [(i, "w " * (i * 37 % 900), 1, "x", 2) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA + ", part int, length string, rank int")
    want = expected([r[:2] for r in rows])
    assert got(op.pack(docs).collect()) == want
    monkeypatch.setattr(op, "SENT_RANKS", -1)
    out = op.pack(docs).collect()
    assert got(out) == want
    valid(out)


class Counting:
    """A model that counts the words it is asked for."""

    def __init__(self, model):
        self.model, self.words = model, 0

    def tokenize(self, word):
        self.words += 1
        return self.model.tokenize(word)


def test_plain_words_are_merged_together():
    """No call of the model for each new word, number or sign, whatever follows or precedes it, and the tokenizer's ids."""
    import random

    import pyarrow as pa

    coder, r = op.Ids(op.default_tokenizer()), random.Random(2)
    coder.model = counting = Counting(coder.model)
    ends = ["", ",", "...", "\n", " 2024", "  ", "\n\n", " \n"]
    texts = [" ".join("".join(r.choices("etaoinshréßĺ", k=r.randint(1, 20))) + r.choice(ends) for _ in range(r.randint(0, 60))) for _ in range(500)]
    got = coder.texts(pa.array(texts))
    assert [x.tolist() for x in got] == [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    # only runs of white space are left to it
    assert counting.words <= 20


def test_merges_of_bytes_equal_the_models():
    coder, rng = op.Ids(op.default_tokenizer()), np.random.default_rng(3)
    words = [bytes(rng.integers(0, 256, rng.integers(1, 60), dtype=np.uint8)) for _ in range(2000)] + [b"a" * n for n in range(1, 65)] + [b"thethethe", b"=" * 40]
    size = np.array([len(w) for w in words])
    flat, count = coder.merges.words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
    want = [[t.id for t in coder.model.tokenize("".join(chr(op.BYTE_SIGNS.get(b, b)) for b in w))] for w in words]
    assert count.tolist() == [len(w) for w in want] and flat.tolist() == [x for w in want for x in w]
