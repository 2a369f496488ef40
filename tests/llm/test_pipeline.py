import corpus_pipeline as pipeline
from tests.llm import test_op1, test_op3, test_op6, test_op9
from tessera.llm import op3_lines, op7_quality

D = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{D}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in op7_quality.quality(docs, labels).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    site = {r.doc_id: r.source for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, D)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality classifier":
            text = {i: t for i, t in text.items() if predicted[i]}
        elif name == "line dedup":
            text = dict(test_op3.brute([(i, t, site[i]) for i, t in text.items()], op3_lines.SITES))
        elif name == "n-gram Jaccard join":
            text = {i: text[i] for i, _, c in test_op6.brute(sorted(text.items()), pipeline.NEAR_WORDS, pipeline.NEAR_PERCENT) if i == c}
        else:
            grams = {}
            for i, t in items:
                w = test_op1.norm(t)
                for j in range(len(w) - 2):
                    grams.setdefault(tuple(w[j : j + 3]), set()).add(i)
            leaks = set()
            for n, t in text.items():
                w = test_op1.norm(t)
                near = set().union(*(grams.get(tuple(w[j : j + 3]), set()) for j in range(len(w) - 2)))
                leaks |= {d for d, _, _ in test_op1.brute([(n, t)], [x for x in items if x[0] in near])}
            assert leaks
            text = {i: t for i, t in text.items() if i not in leaks}
        assert got == text, name
    packed = pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert test_op9.got(packed) == test_op9.expected(text.items())
    test_op9.valid(packed)


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "A text of some words.", "en", "s", 1), (2, "", "en", "s", 0), (3, "A text of some words.", "en", "s", 1), (3, "A text of some words.", "en", "s", 1), (4, "A text of some words.", "en", "t", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(str(r.doc_id) for r in pipeline.run(spark, str(tmp_path)).collect()) == ["1", "2", "3", "None"]


def test_both_ways_of_dropping_copies(spark, monkeypatch):
    from tessera.llm import op6_jaccard

    docs = spark.read.parquet(f"{D}/documents.parquet")
    few = sorted(r.doc_id for r in op6_jaccard.one_of_each(docs).collect())
    monkeypatch.setattr(op6_jaccard, "SENT_IDS", -1)
    assert sorted(r.doc_id for r in op6_jaccard.one_of_each(docs).collect()) == few and len(few) < docs.count()


def test_near_copies_of_five_words_and_four_fifths(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    stay = lambda k, percent: [i for i, _, c in test_op6.brute(rows, k, percent) if i == c]
    got = sorted(r.doc_id for r in pipeline.jaccard_join(spark, docs, D).collect())
    assert got == stay(5, 80) and got != stay(3, 90)


def test_further_columns_of_clashing_names(spark, tmp_path):
    """Every stage but the last keeps them, whatever names its own columns have."""
    names = ["gone", "gone_", "h1", "k1", "row", "label", "copy", "n", "part", "rank", "token", "site", "component_id", "score", "x"]
    rows = [(i, f"menu line\nA text of document {i} with some words of its own, number {i}.", "en", f"s{i % 12}", 1, *range(len(names))) for i in range(24)]
    rows += [(90, None, None, None, None, *[None] * len(names)), (91, "long words " * 30000, "en", "s1", 1, *range(len(names)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} long" for x in names)
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of seven words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {tuple(r)[5:] for r in out.collect()} == {r[5:] for r in rows}
    assert {r.doc_id for r in pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == {r[0] for r in rows}
