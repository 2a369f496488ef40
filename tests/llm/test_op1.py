import random
import re

from tessera.llm import op1_decontaminate as op

SCHEMA = "doc_id long, text string"


def norm(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in (x.strip(op.PUNCTUATION) for x in re.findall(r"[^\x20\x09-\x0D]+", low)) if w]


def distance(item, text):
    """Least edits between the item and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def brute(docs, items, edits=0.2):
    out = []
    for d, t in docs:
        w = norm(t)
        for i, b in items:
            m = norm(b)
            if m and (n := distance(m, w)) <= int(len(m) * edits + 1e-9):
                out.append((d, i, n))
    return sorted(out, key=str)


def run(spark, docs, items):
    out = op.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted([(r.doc_id, r.item_id, r.distance) for r in out], key=str)


def test_cases(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa."
    docs = [(1, None), (2, ""), (3, item), (4, "x y " + item + " z"), (5, item.replace("zeta", "ZZ")), (6, "alpha beta gamma"), (7, "| |"), (8, "word " * 4000 + item + " word" * 4000), (None, item), (3, item)]
    docs += [(9, "alpha, beta!"), (10, "see IOTA"), (11, "alpha beta X delta epsilon y"), (12, "x alpha beta delta epsilon")]
    items = [(1, item), (2, None), (3, ""), (4, "a b"), (5, item), (6, "gamma delta epsilon"), (7, "alpha beta"), (8, "iota"), (9, "alpha beta gamma delta epsilon"), (10, "...")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty(spark):
    assert run(spark, [], [(1, "a b c d")]) == []
    assert run(spark, [(1, "a b c d")], []) == []


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_ITEMS", 2)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(9)]
    docs = [(i, f"a b {t} c") for i, t in items]
    assert run(spark, docs, items) == [(i, i, 0) for i in range(9)]


def test_start(spark):
    item = " ".join(f"w{j}" for j in range(12))
    df = spark.createDataFrame([(1, "a b c " + item + " d")], SCHEMA)
    out = op.contaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.start, r.item_words, r.distance) for r in out] == [(3, 12, 0)]


def test_recall(monkeypatch):
    """Passages with edits up to the bound are found in at least 0.95 of the cases, exact ones always."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(1)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(5, 60)))) for i in range(150)]
    block = op.Items(items, 0.2)
    texts = []
    for _, t in items:
        for share in (0, 0.1, 0.2):
            w = t.split()
            for _ in range(int(len(w) * share)):
                p = r.randrange(len(w))
                kind = r.randrange(3)
                w[p : p + (kind != 1)] = [] if kind == 0 else [r.choice(vocabulary)]
            texts.append(" ".join(r.choices(vocabulary, k=80) + w + r.choices(vocabulary, k=80)))
    ids, at = op.word_ids(pa.array(texts))
    every = sorted(block.leaks(ids, at))
    monkeypatch.setattr(op, "PAIRS", 100)
    assert sorted(block.leaks(ids, at)) == every
    found = {(d, x) for d, x, *_ in block.leaks(ids, at)}
    hit = np.array([[(3 * i + k, i) in found for k in range(3)] for i in range(len(items))])
    assert hit[:, 0].all() and hit[:, 1].mean() >= 0.97 and hit[:, 2].mean() >= 0.95, hit.mean(axis=0)
    assert all(d // 3 == x for d, x in found)


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        w = norm(t)
        for j in range(len(w) - 2):
            grams.setdefault(tuple(w[j : j + 3]), set()).add(i)
    texts = dict(items)
    expected = []
    for n, t in docs:
        w = norm(t)
        near = set().union(*(grams.get(tuple(w[j : j + 3]), set()) for j in range(len(w) - 2)))
        expected += brute([(n, t)], [(i, texts[i]) for i in near])
    got = sorted([(r.doc_id, r.item_id, r.distance) for r in op.op1_benchmark_decontamination(spark, d).collect()], key=str)
    assert got == sorted(expected, key=str) and got


def test_fewer_hits_than_long_items_need(spark):
    """Every item needs several shared shingles, and the whole batch has fewer."""
    for n, shared in ((20, (1, 3, 4)), (40, (1, 9, 12, 19))):
        item = [f"w{j}" for j in range(n)]
        least = op.Items([(1, " ".join(item))], op.EDITS).parts[0].least
        for m in shared:
            docs = [(1, "a b " + " ".join(item[: m + op.Q - 1]) + " c d")]
            assert run(spark, docs, [(1, " ".join(item))]) == brute(docs, [(1, " ".join(item))]), (least, m)
    docs = [(1, "x y " + " ".join(item) + " z")]
    assert run(spark, docs, [(1, " ".join(item))]) == [(1, 1, 0)]


def test_clashing_columns(spark):
    names = "item_id long, distance int, start long, words string"
    docs = spark.createDataFrame([(1, "a b alpha beta gamma delta epsilon", 7, 8, 9, "w"), (2, "clean", 7, 8, 9, "w"), (3, None, 7, 8, 9, "w")], SCHEMA + ", " + names)
    items = spark.createDataFrame([(5, "alpha beta gamma delta epsilon", 1)], "item_id long, text string, doc_id long")
    assert [tuple(r) for r in op.contaminated(docs, items).collect()] == [(1, 5, 0, 5, 2)]
    left = op.without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(2, "clean", 7, 8, 9, "w"), (3, None, 7, 8, 9, "w")]
