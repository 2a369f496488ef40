from collections import Counter

from pyspark.sql import functions as F

import pytest

from tessera.functions import similarity
from tessera.operators import blocking, decide, entities, evaluate, features, models, scoring, tfidf, training
from tessera.plans import linkage
from tessera.sources import sinks, tables

FIELDS = "id string, source string, name string, address string, city string, state string, zip string, country string, phone string"
RECORDS = [
    ("s1_1", "source1", "Amazon Web Services Inc", "410 Terry Ave N", "Seattle", "WA", "98109", "US", "2065551234"),
    ("s1_2", "source1", "Blue Bottle Coffee LLC", "315 Linden St", "San Francisco", "CA", "94102", "US", "4155554321"),
    ("s1_3", "source1", "Acme Corporation", "100 Industrial Pkwy", "Austin", "TX", "78701", "US", "5125559876"),
    ("s2_1", "source2", "AWS Cloud Services", "410 Terry Ave North", "Seattle", "WA", "98109", "US", "2065551234"),
    ("s2_2", "source2", "Blue Bottle Coffee", "315 Linden Street", "San Francisco", "CA", "94102", "US", "4155554321"),
    ("s3_1", "source3", "Amazon Web Services", "Terry Avenue Seattle", "Seattle", "WA", "98109", "US", "2065551234"),
    ("s3_x", "source3", "Completely Unrelated Inc", "999 Far Away St", "New York", "NY", "10001", "US", "2125550000"),
]
TRUTH = [("s1_1", ["s2_1", "s3_1"]), ("s1_2", ["s2_2"]), ("s1_3", [])]


@pytest.fixture(scope="module")
def truth(spark):
    return spark.createDataFrame(TRUTH, "s1_id string, true_ids array<string>")


@pytest.mark.parametrize(("true", "pred", "want"), [([], [], 1.0), ([], ["a"], 0.0), (["a"], [], 0.0), (["a", "b"], ["b", "a"], 1.0), (["a", "b"], ["a"], 1.25 * 0.5 / 0.75), (["a"], ["b"], 0.0), (["a"], ["a", "a"], 1.0)])
def test_f_beta(spark, true, pred, want):
    t = spark.createDataFrame([("x", true)], "s1_id string, true_ids array<string>")
    p = spark.createDataFrame([("x", pred), ("other", ["z"])], "s1_id string, pred_ids array<string>")
    rows = evaluate.entity_scores(t, p).collect()
    assert len(rows) == 1 and rows[0].f == pytest.approx(want)


def test_macro(spark, truth):
    p = spark.createDataFrame([("s1_1", ["s2_1"]), ("s1_2", ["s2_2"])], "s1_id string, pred_ids array<string>")
    r = evaluate.macro(truth, p).first()
    assert r.macro_f05 == pytest.approx((1.25 * 0.5 / 0.75 + 2) / 3) and (r.singleton_accuracy, r.total_entities, r.total_singletons) == (1.0, 3, 1)
    r = evaluate.macro_prf(truth, p).first()
    assert r.macro_precision == 1.0 and r.macro_recall == pytest.approx((0.5 + 2) / 3)
    none = truth.where("s1_id = 'nobody'")
    r = evaluate.macro(none, p).first()
    assert r.macro_f05 is None and r.singleton_accuracy == 1.0 and r.match_macro_f05 == 0.0


def test_second_engine_end_to_end(spark, truth):
    cleaned = entities.clean(spark.createDataFrame(RECORDS, FIELDS))
    pairs = linkage.pairs_b(cleaned, top=5, least=0.1).cache()
    got = {(r.s1_id, r.candidate_id): r.tfidf_sim for r in pairs.collect()}
    assert got["s1_1", "s2_1"] == 1.0 and got["s1_2", "s2_2"] == 1.0 and ("s1_1", "s3_1") in got
    recall = blocking.recall(pairs, truth).first()
    assert recall.candidate_match_recall == 1.0 and recall.entity_perfect_recall_rate == 1.0 and recall.total_candidates == len(got)
    feats = features.features_b(pairs, cleaned).cache()
    assert len([c for c in feats.columns if c.startswith("feat_")]) == 23
    links = truth.select("s1_id", F.explode("true_ids").alias("candidate_id")).withColumnRenamed("candidate_id", "cand_id")
    labelled = training.label_pairs(feats.withColumnRenamed("candidate_id", "cand_id"), links)
    scored, fitted = models.cross_fit(labelled, [c for c in feats.columns if c.startswith("feat_")], folds=2, depth=2, rounds=2)
    scored = scored.withColumnRenamed("cand_id", "candidate_id").cache()
    assert scored.count() == len(got) and all(len({r.fold for r in scored.collect() if r.s1_id == s}) <= 1 for s, _ in TRUTH)
    anchors = truth.select("s1_id")
    predicted = decide.gate(anchors, scored)
    assert predicted.count() == 3
    assert evaluate.macro(truth, predicted).first().total_singletons == 1


def test_empty_blocking(spark):
    cleaned = entities.clean(spark.createDataFrame([], FIELDS))
    assert linkage.pairs_b(cleaned).collect() == []
    assert blocking.candidates(entities.enrich(spark.createDataFrame([], "source string, entity_id string, business_name string, business_address string, country string"))).collect() == []


def test_acronym_pass(spark):
    rows = [("source1", "a", "Blue Bottle Coffee", "12 Main St", "France"), ("source2", "b", "BBC", "12 Main St", "France"), ("source3", "c", "bbc sarl", "12 rue X", "france")]
    e = entities.enrich(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string"))
    got = {(r.source, r.cand_id) for r in blocking.candidates_by_pass(e, [p for p in blocking.PASSES if p.name == "p12"]).collect()}
    assert got == {("source2", "b"), ("source3", "c")}


def test_cap_holds_for_a_hot_key(spark):
    rows = [("source1", f"a{i}", "Same Name", "", "") for i in range(50)] + [("source2", f"b{i:03}", "Same Name", "", "") for i in range(300)]
    e = entities.enrich(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string"))
    got = blocking.candidates_by_pass(e, blocking.PASSES[:1]).collect()
    assert len(got) == 200 and {r.cand_id for r in got} == {"b000", "b001", "b002", "b003"}


def test_tfidf_against_brute_force(spark):
    import math
    from collections import Counter

    a = [(f"a{i}", t) for i, t in enumerate(["blue bottle", "a", "acme acme co", "", "golden royal"])]
    b = [(f"b{i}", t) for i, t in enumerate(["blue bottle coffee", "a b", "acme", "bottle", "royal gold", "", "acme"])]

    def grams(text, low, high):
        out = []
        for w in text.split():
            w = f" {w} "
            for n in range(low, high + 1):
                if len(w) <= n:
                    out.append(w)
                    break
                out += [w[i : i + n] for i in range(len(w) - n + 1)]
        return Counter(out)

    low, high = 2, 4
    tf = {i: grams(t, low, high) for i, t in a + b}
    df = Counter(g for c in tf.values() for g in c)
    vec = {}
    for i, c in tf.items():
        v = {g: (1 + math.log(n)) * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {g: x / norm for g, x in v.items()}
    want = []
    for i, _ in a:
        sims = sorted(((-sum(x * vec[j].get(g, 0) for g, x in vec[i].items()), j) for j, _ in b))
        want += [(i, j, round(-s, 5)) for s, j in sims if -s >= 0.1][:2]
    schema = "id string, text string"
    got = tfidf.top_similar(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), low, high, 2, 0.1).collect()
    assert sorted((r.s1_id, r.candidate_id, round(r.tfidf_sim, 5)) for r in got) == sorted(want)


SCORED = [("a", "source2", "x", 0.9, 1), ("a", "source2", "y", 0.85, 0), ("a", "source3", "z", 0.89, 0), ("b", "source2", "x", 0.95, 0), ("b", "source2", "w", 0.5, 0), ("c", "source2", "v", 0.95, 0)]


def scored(spark):
    return spark.createDataFrame(SCORED, "s1_id string, source string, cand_id string, score double, n int").drop("n")


def test_decisions(spark):
    df = scored(spark)
    key = lambda d: {(r.s1_id, r.cand_id) for r in d.collect()}
    assert key(decide.best_anchor(df)) == {("a", "y"), ("a", "z"), ("b", "x"), ("b", "w"), ("c", "v")}
    assert key(decide.within_margin(df)) == {("a", "x"), ("a", "y"), ("a", "z"), ("b", "x"), ("c", "v")}
    assert key(decide.top_per_anchor(df, 1)) == {("a", "x"), ("a", "z"), ("b", "x"), ("c", "v")}
    got = {(r.s1_id, r.cand_id): r.score for r in scoring.joint_support(df).collect()}
    assert got["a", "x"] == pytest.approx(0.9 * 1.015) and got["a", "z"] == pytest.approx(0.89 * 1.015) and got["a", "y"] == 0.85 and got["b", "x"] == 0.95


def test_selection_invariants(spark):
    from tessera.sources import synthetic

    chosen = linkage.rule_matches(synthetic.entities(spark, "/root/testdata/sf0.01"), cutoff=0.5).collect()
    assert len({(r.source, r.cand_id) for r in chosen}) == len(chosen)
    per = {}
    for r in chosen:
        per[r.source, r.s1_id] = per.get((r.source, r.s1_id), 0) + 1
    assert max(per.values()) <= decide.TOP


def test_gate_falls_back_to_the_best(spark):
    df = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.48), ("b", "x", 0.4), ("c", "x", 0.9), ("c", "y", 0.6), ("c", "z", 0.3)], "s1_id string, candidate_id string, prob double")
    anchors = spark.createDataFrame([(x,) for x in "abcd"], "s1_id string")
    assert {r.s1_id: r.pred_ids for r in decide.gate(anchors, df).collect()} == {"a": ["x"], "b": [], "c": ["x", "y"], "d": []}


def test_grid_against_each_triple(spark, truth):
    df = spark.createDataFrame([("s1_1", "s2_1", 0.7), ("s1_1", "s3_1", 0.5), ("s1_2", "s2_2", 0.47), ("s1_2", "q", 0.66), ("s1_3", "q", 0.41)], "s1_id string, candidate_id string, prob double")
    triples = [(0.35, 0.45, 0.4), (0.5, 0.5, 0.7), (0.65, 0.75, 0.4)]
    got = {(r.gate, r.floor, r.share): r.macro_f05 for r in decide.grid_scores(truth, df, triples).collect()}
    for t in triples:
        want = evaluate.macro(truth, decide.gate(truth.select("s1_id"), df, *t)).first().macro_f05
        assert got[t] == pytest.approx(want)
    assert len(decide.grid()) == 152


def test_truth_readers(spark):
    rows = [("1", "a, b,,a"), ("2", None), ("3", "[]"), ("4", " None "), ("5", "")]
    got = {r.s1_id: r.true_ids for r in tables.truth_set(spark.createDataFrame(rows, "x string, y string")).collect()}
    assert got == {"1": ["a", "b"], "2": [], "3": [], "4": [], "5": []}
    rows = [("1", "['a'; \"b\", 'a']"), ("2", None), ("3", "[]")]
    got = {r.s1_id: r.true_ids for r in tables.truth_list(spark.createDataFrame(rows, "id string, matched_entity_ids string")).collect()}
    assert got == {"1": ["a", "b", "a"], "2": [], "3": []}


def test_files(spark, tmp_path):
    (tmp_path / "train").mkdir()
    path = tmp_path / "train" / "t.tsv"
    path.write_text("entity_id\tname\n1\ta,b\textra\n2\n")
    assert tables.find("t", "train", (str(tmp_path),)) == str(path)
    assert tables.find("none", "train", (str(tmp_path),)).endswith("none.csv")
    assert [tuple(r) for r in tables.scan(spark, str(path)).collect()] == [("1", "a,b"), ("2", None)]
    assert tables.scan(spark, str(path), 1).count() == 1
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "s1_id string, pred_ids array<string>")
    assert {r.id: r.matched_ids for r in sinks.submission(df).collect()} == {"a": "['x', 'y']", "b": "[]"}
    matches = spark.createDataFrame([("a", "source3", "z", 0.9), ("a", "source2", "x", 0.8), ("a", "source2", "y", 0.95)], "s1_id string, source string, cand_id string, score double")
    out = decide.match_lists(spark.createDataFrame([("a",), ("b",)], "s1_id string"), matches)
    assert {r[0]: r[1] for r in out.collect()} == {"a": "y,x,z", "b": ""}
    sinks.write_delimited(out.coalesce(1), str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and set(lines[1:]) == {"a\ty,x,z", "b\t"}


def test_command_line_and_stream(spark, tmp_path):
    from tessera import cli
    from tessera.streaming import incremental

    header = "id\tname\taddress\tcity\tstate\tzip\tcountry\tphone"
    for part in ("train", "test"):
        (tmp_path / part).mkdir()
        for i in (1, 2, 3):
            lines = ["\t".join([r[0], *r[2:]]) for r in RECORDS if r[1] == f"source{i}"]
            (tmp_path / part / f"{part}_source{i}.tsv").write_text("\n".join([header, *lines]) + "\n")
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{a}\t{','.join(b)}\n" for a, b in TRUTH))
    cli.main(["--mode", "both", "--data", str(tmp_path), "--folds", "2", "--top-k", "5", "--min-sim", "0.1", "--model", str(tmp_path / "m"), "--output", str(tmp_path / "o")])
    got = spark.read.option("header", True).csv(str(tmp_path / "o"))
    assert got.columns == ["id", "matched_ids"] and got.count() == 3
    assert models.saved(str(tmp_path / "m"), spark) <= 2 and models.saved(str(tmp_path / "m" / "singletons"), spark) <= 2
    cli.main(["--mode", "submit", "--data", str(tmp_path), "--top-k", "5", "--min-sim", "0.1", "--model", str(tmp_path / "m"), "--output", str(tmp_path / "again")])
    assert spark.read.option("header", True).csv(str(tmp_path / "again")).count() == 3

    fields = "entity_id string, business_name string, business_address string, country string"
    spark.createDataFrame([("a", "Golden Coffee Inc", "12 Main St, 75002", "France"), ("b", "Other", "1 x", "India")], fields).write.parquet(str(tmp_path / "in"))
    sats = spark.createDataFrame([("s", "Golden C0ffee LLC", "12 Main Street 75002", "FRANCE", "source2")], fields + ", source string")
    stream = spark.readStream.schema(fields).parquet(str(tmp_path / "in"))
    incremental.link_stream(stream, sats, str(tmp_path / "matches"), str(tmp_path / "cp"), cutoff=0.9).awaitTermination(120)
    assert [(r.s1_id, r.cand_id) for r in spark.read.parquet(str(tmp_path / "matches")).collect()] == [("a", "s")]
    # a later anchor of the same keys doesn't get the satellite again
    spark.createDataFrame([("c", "Golden Coffee Inc", "12 Main St, 75002", "France")], fields).write.mode("append").parquet(str(tmp_path / "in"))
    incremental.link_stream(stream, sats, str(tmp_path / "matches"), str(tmp_path / "cp"), cutoff=0.9).awaitTermination(120)
    assert [(r.s1_id, r.cand_id) for r in spark.read.parquet(str(tmp_path / "matches")).collect()] == [("a", "s")]


def test_models_are_saved(spark, tmp_path):
    rows = [(f"a{i % 20}", float(i % 2), float(i % 7), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "s1_id string, f1 double, f2 double, label double")
    fitted = models.fit_ensemble(df, ["f1", "f2"], models.ENSEMBLE[:2], depth=2, rounds=2)
    models.save(fitted, str(tmp_path / "e"), spark)
    again = models.load_ensemble(str(tmp_path / "e"), 2)
    a, b = (sorted(r.score for r in models.score_ensemble(m, df, ["f1", "f2"], (0.5, 0.5)).collect()) for m in (fitted, again))
    assert a == pytest.approx(b) and a[0] < 0.5 < a[-1]


def test_ensemble_command(spark, tmp_path):
    """Training, scoring and both result files, over the synthetic registries."""
    from tessera import cli
    from tessera.sources import synthetic

    d = "/root/testdata/sf0.001"
    everyone = synthetic.entities(spark, d).select("source", "entity_id", "business_name", "business_address", "country").collect()
    for part in ("train", "test"):
        (tmp_path / part).mkdir()
        for i in (1, 2, 3):
            lines = ["\t".join(r[1:]) for r in everyone if r.source == f"source{i}"]
            (tmp_path / part / f"{part}_source{i}.tsv").write_text("\n".join(["entity_id\tbusiness_name\tbusiness_address\tcountry", *lines]) + "\n")
    links = {}
    for r in synthetic.truth(spark, d).collect():
        links.setdefault(r.s1_id, []).append(r.cand_id)
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{a}\t{','.join(b)}\n" for a, b in links.items()))
    cli.main(["--engine", "ensemble", "--mode", "both", "--data", str(tmp_path), "--model", str(tmp_path / "m"), "--output", str(tmp_path / "o"), "--depth", "3", "--rounds", "2", "--cutoff", "0.5"])
    read = lambda x: {r[0]: r[1] or "" for r in spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/o/{x}").collect()}
    matches, candidates = read("matching_results"), read("candidate_pairs")
    assert models.saved(str(tmp_path / "m"), spark) == 5 and len(matches) == len(candidates) == 150
    assert all(set(filter(None, m.split(","))) <= set(candidates[a].split(",")) for a, m in matches.items())
    hits = sum(len(set(m.split(",")) & set(links.get(a, ()))) for a, m in matches.items())
    assert hits >= 0.5 * sum(map(len, links.values()))


def test_first_rows_are_those_of_the_file(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("id,x\n" + "".join(f"{i},{'y' * 50}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert [int(r.id) for r in tables.scan(spark, str(path), 700).collect()] == list(range(700))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_fold_without_two_labels(spark):
    rows = [("a", "x", 0.1, 1.0), ("b", "y", 0.2, 1.0), ("c", "z", 0.3, 1.0)]
    scored, fitted = models.cross_fit(spark.createDataFrame(rows, "s1_id string, cand_id string, f double, label double"), ["f"], 3)
    assert not fitted and {r.prob for r in scored.collect()} == {1.0}
    with pytest.raises(ValueError):
        models.predict(fitted, scored, ["f"])


def test_kernels_give_what_is_asked(spark):
    from tessera.functions import similarity

    df = spark.createDataFrame([("blue bottle", "bottle blue", "x st", "", 1), ("", "a", "x st", "x st", 2), ("naïve", "naive", "é", "é", 3)], "a_name_root string, b_name_root string, a_addr_std string, b_addr_std string, n int")
    got = {r.n: r.k for r in df.select("n", similarity.kernels(("sort_root", "jw_addr", "jw_root")).alias("k")).collect()}
    assert list(got[1].asDict()) == ["sort_root", "jw_addr", "jw_root"]
    assert (got[1].sort_root, got[1].jw_addr) == (1.0, 0.4) and (got[2].sort_root, got[2].jw_addr) == (0.0, 1.0)
    assert got[3].jw_root == pytest.approx(similarity.jaro_winkler("naive", "naxve"))


def test_negatives_and_links_are_whole_where_asked(spark, monkeypatch):
    for bound in ("ANCHORS", "POSITIVES", "NEGATIVE_ANCHORS", "NEGATIVE_SATELLITES", "BY_NAME", "BY_DOOR"):
        monkeypatch.setattr(training, bound, 3)
    rows = [("source1", f"a{i}", "Same Name", "12 Main St", "France") for i in range(5)] + [("source2", f"b{i}", "Same Name", "12 Main St", "France") for i in range(7)]
    e = entities.enrich(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string"))
    links = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(5)], "s1_id string, cand_id string")
    every = {(f"a{i}", f"b{j}") for i in range(5) for j in range(7)}
    known = {(f"a{i}", f"b{i}") for i in range(5)}
    assert sorted(map(tuple, training.hard_negatives(e, links, bounded=False).collect())) == sorted(every - known)
    assert sorted(map(tuple, training.training_pairs(e, links, bounded=False).collect())) == sorted([(*p, 1.0) for p in known] + [(*p, 0.0) for p in every - known])
    assert training.training_pairs(e, links).where("label = 1").count() == 3 and training.hard_negatives(e, links).count() < 5


@pytest.mark.parametrize("words", [40, 4])
def test_tfidf_search_past_chunks_against_a_product(words):
    """Anchors that prune and anchors that don't, copies, ties and texts without grams, over several chunks."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(words)
    grams, top, threshold = 400, 5, 0.2
    idf = np.log(2000 / (1 + np.sort(rng.zipf(1.3, grams).clip(1, 1500)))) + 1
    text = lambda: sorted(int(x) for x in grams - 1 - rng.zipf(1.4, rng.integers(0, words)).clip(1, grams) + 1)
    a, b = [text() for _ in range(150)], [text() for _ in range(900)]
    a[:20], times = b[100:120], rng.integers(1, 4, len(b))
    codes = lambda rows: pa.array(rows, pa.list_(pa.int32()))

    def dense(rows):
        m = np.zeros((len(rows), grams))
        v = tfidf.Vectors(codes(rows), idf)
        m[v.row, v.code] = v.weight
        return m

    block, state = tfidf.Block(codes(a), idf, top, threshold), {}
    parts = [(tfidf.Index(tfidf.Vectors(codes(b[i : i + 250]), idf), grams), times[i : i + 250], i) for i in range(0, len(b), 250)]
    for index, t, _ in parts:
        block.first(index, t, state)
    block.settle(state["best"])
    assert (block.least > threshold).sum() > 5
    best = np.full((len(a), top), -1.0)
    for index, t, start in parts:
        block.second(index, t, start, best)
    anchor, sat, cosine = block.pairs()
    want = np.round(dense(a) @ dense(b).T, tfidf.DIGITS)
    assert np.abs(want[anchor, sat] - cosine).max() < 2e-9
    got = set(zip(anchor.tolist(), sat.tolist(), strict=True))
    assert len(got) == len(anchor)
    for i, row in enumerate(want):
        all_ = np.sort(np.repeat(row, times))[::-1]
        least = max(threshold, all_[top - 1] + 5e-9)
        assert {(i, int(j)) for j in np.flatnonzero(row >= least)} <= got


def test_tfidf_gives_every_copy_its_links(spark):
    """Records of the same words are one class inside, and each has its own links outside."""
    a = spark.createDataFrame([(f"a{i}", "golden coffee" if i % 2 else "Coffee  golden") for i in range(30)] + [("null", None)], "id string, text string")
    b = spark.createDataFrame([(f"b{i:03}", "coffee golden") for i in range(300)] + [("c", "golden tea"), ("d", None)], "id string, text string")
    found = tfidf.top_similar(a, b, 2, 4, 7, 0.25)
    assert "Generate" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect())) == sorted((f"a{i}", f"b{j:03}", 1.0, 1.0) for i in range(30) for j in range(7))


def test_folds_compute_their_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)
    one = F.udf(lambda x: (seen.add(1), x)[1], "double")
    rows = [(f"a{i % 20}", float(i % 7), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "s1_id string, f double, label double").withColumn("f", one("f"))
    scored, fitted = models.cross_fit(df, ["f"], 2, depth=2, rounds=2)
    assert scored.count() == 200 and len(scored.select("prob").collect()) == 200 and fitted
    assert seen.value == 200


def test_merge_deals_pairs_out_once(spark):
    pairs = spark.createDataFrame([("a", f"b{i}", 0.5 + i / 100) for i in range(9)], "s1_id string, candidate_id string, tfidf_sim double")
    plan = blocking.merge(pairs, pairs, most=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and len(blocking.merge(pairs, pairs, most=3).collect()) == 3


def _alike(spark, n: int = 60):
    rows = [("source1", f"a{i}", f"Golden Coffee {'abcdef'[i] * 4} Works", f"{i} Main Street", "Lyon" if i % 2 else "", f"20000000{i:02}") for i in range(6)]
    rows += [("source2", f"b{i:02}", f"{'Golden Coffee' if i % 3 else 'Coffee Golden'} {'abcdefgh'[i % 8] * 4} {'Works' if i % 5 else ''}", f"{i % 9} Main Street", "Lyon", f"20000000{i:02}") for i in range(n)]
    rows += [("source1", "lone", "Quiet Tea House", "9 Main Street", "Lyon", ""), ("source2", "c", "Quiet House Tea", "9 Main Street", "Lyon", "")]
    return entities.clean(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, city string, phone string"))


@pytest.mark.parametrize("most", [3, 30])
def test_floors_leave_the_merged_pairs_as_they_are(spark, monkeypatch, most):
    """What is below the similarity of an equal key with enough satellites is left out before the merge, not by it."""
    monkeypatch.setattr(blocking, "MOST", most)
    c = _alike(spark).cache()
    floors = blocking.floors(c, most=most)
    by = {r.s1_id: round(r.floor, 2) for r in floors.collect()}
    assert by == {f"a{i}": 0.7 for i in range(6)} if most == 30 else {"lone"} | {f"a{i}" for i in range(6)} >= set(by) >= {f"a{i}" for i in range(6)}
    every = lambda x: sorted(map(tuple, x.collect()))
    keys, fewer = blocking.equal_keys(c, most=most), blocking.equal_keys(c, most=most, least=floors)
    a, b = (c.where(w).select("id", F.col("clean_name").alias("text")) for w in ("source = 'source1'", "source <> 'source1'"))
    known = a.join(floors.withColumnRenamed("s1_id", "id"), "id", "left").withColumn("floor", F.col("floor").cast("double") - 1e-6)
    whole, cut = (tfidf.top_similar(x, b, 2, 4, 25, 0.25).cache() for x in (a, known))
    assert cut.count() < whole.count() and not cut.join(whole, ["s1_id", "candidate_id"], "left_anti").count()
    assert every(blocking.merge(whole, keys, most=most)) == every(blocking.merge(cut, fewer, most=most))


@pytest.mark.parametrize("dealt", [20, 1 << 22])
def test_all_pairs_of_a_hot_key_are_dealt_out_by_lists(spark, monkeypatch, dealt):
    """Whole, whatever the sizes of lists and blocks divide, with ids that are null or stand twice; a hot key in many tasks."""
    for name, value in {"LISTED": 7, "RUN": 3, "SIDE": 2, "DEALT": dealt}.items():
        monkeypatch.setattr(blocking, name, value, raising=False)
    rows = [("source1", f"a{i}", "golden coffee") for i in range(23)] + [("source1", "a3", "golden coffee"), ("source1", None, "golden coffee"), ("source1", "lone", "quiet tea"), ("source1", "x", "silver tea"), ("source1", "y", "")]
    rows += [(f"source{2 + i % 2}", f"b{i}", "golden coffee") for i in range(44)] + [("source2", "b5", "golden coffee"), ("source3", None, "golden coffee"), ("source2", "c", "silver tea"), ("source2", "d", "")]
    records = spark.createDataFrame(rows, "source string, id string, name_first_tokens string")
    got = [(r.rule, r.s1_id, r.candidate_id, round(r.tfidf_sim, 2), r.task) for r in blocking.equal_keys(records, blocking.EXACT[:1]).withColumn("task", F.spark_partition_id()).collect()]
    assert Counter(x[:4] for x in got) == Counter(("first_tokens", a, b, 0.7) for s, a, k in rows for t, b, l in rows if s == "source1" != t and k == l != "")
    assert len(got) == 25 * 46 + 1
    tasks = Counter(x[4] for x in got if x[1] != "x")
    assert dealt > 20 or len(tasks) > 5 and max(tasks.values()) < len(got) / 2
    none = blocking.equal_keys(records.where("source = 'source1'"), blocking.EXACT[:1])
    assert none.columns == ["rule", "s1_id", "candidate_id", "tfidf_sim"] and none.count() == 0


def test_satellites_are_looked_up_without_shuffling_pairs_by_them(spark, monkeypatch):
    monkeypatch.setattr(features, "LOOKED_UP", 7)
    c = _alike(spark, 20).cache()
    pairs = spark.createDataFrame([(f"a{i}", f"b{j:02}", 0.5) for i in range(6) for j in range(20)] + [("a0", "unknown", 0.1)], "s1_id string, candidate_id string, tfidf_sim double")
    few = features.features_b(pairs, c, only=("feat_name_jw", "feat_street_num_match"))
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(candidate_id" not in plan and few.columns == ["s1_id", "candidate_id", "source", "feat_name_jw", "feat_street_num_match"]
    whole = {(r.s1_id, r.candidate_id): r for r in features.features_b(pairs, c).collect()}
    got = few.collect()
    assert len(whole) == len(got) == 121 and len(whole["a0", "unknown"]) == 26
    assert whole["a0", "unknown"].source is None and whole["a0", "unknown"].feat_name_jw == 0
    assert all(tuple(r) == tuple(whole[r.s1_id, r.candidate_id][x] for x in few.columns) for r in got)
    names = {r.id: r.clean_name for r in c.select("id", "clean_name").collect()}
    assert all(r.feat_name_jw == pytest.approx(similarity.jaro_winkler(names[r.s1_id], names[r.candidate_id])) for r in got if r.candidate_id != "unknown")


def test_the_singleton_model_trains_all_of_its_trees(spark, monkeypatch):
    """Every fold has all rounds of its booster; the query leaves folds and rounds as they are."""
    import inspect

    from tessera.plans import catalogue

    rows = [(f"a{i}", i % 40 / 40, (i * 7) % 11 / 11, float(i % 5)) for i in range(200)]
    f = spark.createDataFrame(rows, "s1_id string, x double, y double, agg_cand_count double")
    f = f.select("s1_id", *[F.col("x" if i % 2 else "y").alias(c) for i, c in enumerate(models.SINGLETON)], "agg_cand_count")
    truth = spark.createDataFrame([(f"a{i}", [] if i % 40 < 20 else ["b"]) for i in range(200)], "s1_id string, true_ids array<string>")
    scored, fitted = models.fit_singletons(f, truth, folds=2)
    assert [[m.getNumTrees for m in own] for own in fitted] == [[150], [150]]
    right = [(r.prob > 0.5) == (r.label == 1) for r in scored.collect()]
    assert len(right) == 200 and sum(right) > 180
    asked = []
    monkeypatch.setattr(models, "_cross_fit", lambda pairs, columns, folds, group, boosters, *a, **k: (asked.append((folds, [b.getMaxIter() for b in boosters(0)])), (scored, fitted))[1])
    monkeypatch.setattr(catalogue, "_singleton_features", lambda s, d: f)
    monkeypatch.setattr(catalogue, "truth_lists", lambda s, d: truth)
    catalogue.queries()["singleton_scores"](spark, "")
    assert asked == [(5, [150])] and inspect.signature(models.fit_singletons).parameters["folds"].default == 5


@pytest.mark.parametrize("few", [32, 1])
def test_hard_negatives_shuffle_no_pairs_of_plain_records(spark, monkeypatch, few):
    """Ids that are null or have several records, anchors with more links than are looked up one by one, links of null."""
    monkeypatch.setattr(training, "FEW", few, raising=False)
    names = ["golden coffee", "golden tea", "silver tea", ""]
    cell = lambda source, i, k: (source, f"{source[6]}{i}" if i % 17 else None, names[(i + k) % 4], "" if i % 5 == 0 else str(i % 3), names[(i + k) % 4][:3], "fr" if i % 7 else None)
    rows = [cell(x, i, 0) for x in ("source1", "source2") for i in range(40)] + [cell("source1", 3, 0), cell("source1", 4, 1), cell("source2", 5, 2), cell("source2", 34, 1)]
    e = spark.createDataFrame(rows, "source string, id string, name_root string, street_digits string, root_prefix_3 string, country_std string")
    known = [("13", f"2{i}") for i in range(3, 40, 4)] + [("18", "28"), ("19", "29"), ("19", "29"), (None, "25"), ("16", None), ("14", "25")]
    links = spark.createDataFrame(known, "s1_id string, cand_id string")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == "source1" and b[0] == "source2" and a[5] and a[5] == b[5] and (a[2] == b[2] or a[3:5] == b[3:5])}
    want -= {p for p in known if None not in p}
    for some, odd in ((e, True), (e.where("id not in ('14', '25', '13') and id is not null"), False)):
        ids = {r.id for r in some.collect()}
        got = training.hard_negatives(some, links, bounded=False)
        assert sorted(map(tuple, got.collect()), key=str) == sorted((p for p in want if set(p) <= ids), key=str)
        assert odd or "LeftAnti" not in got._jdf.queryExecution().toString()


def test_training_pairs_shuffle_no_negatives(spark):
    """The whole query's negatives meet by lists; neither the plan's distinct nor an anti join holds all pairs."""
    rows = [(f"source{1 + i % 2}", f"{i % 2}-{i}", "Same Name" if i % 4 < 2 else f"Same Name {i}", "12 Main St", "France") for i in range(40)]
    e = entities.enrich(spark.createDataFrame(rows, "source string, entity_id string, business_name string, business_address string, country string"))
    links = spark.createDataFrame([("0-0", "1-1"), ("0-2", "1-3"), ("0-2", "1-3")], "s1_id string, cand_id string")
    got = training.training_pairs(e, links, bounded=False)
    assert "LeftAnti" not in got._jdf.queryExecution().toString()
    pairs = {(f"0-{i}", f"1-{j}") for i in range(0, 40, 2) for j in range(1, 40, 2)}
    true = {("0-0", "1-1"), ("0-2", "1-3")}
    assert sorted(map(tuple, got.collect())) == sorted([(*p, 1.0) for p in true] + [(*p, 0.0) for p in pairs - true])


def test_training_pairs_deal_records_out_before_keys_and_hold_one_run_of_pairs(spark, monkeypatch):
    """Files of one task are dealt out by id ahead of the regular expressions, and only the last explode is in generated code."""
    from tessera.plans import catalogue

    seen = []
    monkeypatch.setattr(training, "_every_negative", lambda a, s, links: seen.extend((a, s)) or a.select(F.col("id").alias("s1_id"), F.col("id").alias("cand_id")))
    catalogue.queries()["training_pairs"](spark, "/root/testdata/sf0.001")
    for side in seen:
        plan = side.groupBy("id").agg(F.collect_set("name_root"))._jdf.queryExecution().executedPlan().toString()
        keys, _, records = plan.partition("Exchange hashpartitioning")
        assert "regexp_replace" in keys and records and "regexp_replace" not in records and "Exchange hashpartitioning" not in records
    keyed = spark.createDataFrame([("r", "k", f"{i}") for i in range(5)], "rule string, key string, id string")
    pairs = blocking.all_pairs(keyed.withColumnRenamed("id", "s1_id"), keyed.withColumnRenamed("id", "candidate_id"))
    codes = [x.startswith("explode(") and "lambdafunction" not in x for x in pairs._jdf.queryExecution().executedPlan().toString().split("Generate ")[1:]]
    assert sum(codes) == 1 and sorted((r.s1_id, r.candidate_id) for r in pairs.collect()) == [(f"{i}", f"{j}") for i in range(5) for j in range(5)]


def test_the_singleton_model_trains_rows_that_are_alike_once(spark, monkeypatch):
    """300 anchors of 12 kinds: the trees and probabilities are those of all rows, a leaf's least of 20 rows among them."""
    names = [*models.SINGLETON, "agg_cand_count"]
    f = spark.createDataFrame([(f"a{i}", *[float((i % 12) * 37 * (j + 3) % 101) for j in range(len(names))]) for i in range(300)], "s1_id string, " + ", ".join(f"{c} double" for c in names))
    truth = spark.createDataFrame([(f"a{i}", [] if i % 3 == 0 or i % 11 == 0 else ["x"]) for i in range(300)], "s1_id string, true_ids array<string>")
    seen, fit = [], models.GBTClassifier.fit
    monkeypatch.setattr(models.GBTClassifier, "fit", lambda self, df, *a: (seen.append(df.agg(F.count("*"), F.sum("weight")).first()), fit(self, df, *a))[1])
    scored, fitted = models.fit_singletons(f, truth, folds=2, rounds=3)
    assert all(n <= 24 for n, _ in seen) and sum(w for _, w in seen) == 300
    monkeypatch.setattr(models, "_cross_fit", lambda *a, whole=models._cross_fit, **k: whole(*a, **(k | {"counted": False})))
    plain, other = models.fit_singletons(f, truth, folds=2, rounds=3)
    # columns may tie for a split, but not in what it parts
    assert [[t.numNodes for t in a.trees] for (a,) in fitted] == [[t.numNodes for t in a.trees] for (a,) in other] and fitted[0][0].trees[0].numNodes > 1
    a, b = ({r.s1_id: r.prob for r in x.collect()} for x in (scored, plain))
    assert a == pytest.approx(b, abs=1e-9) and len(set(a.values())) > 2


def test_the_singleton_features_clean_only_the_texts_they_compare(spark):
    """Sound keys go through Python record by record; neither candidates nor these features look at them."""
    c = entities.clean(spark.createDataFrame([("s1_1", "source1", "Acme", "1 Main St", "", "", "", "", "")], FIELDS))
    kept = linkage._kept(c, tuple(models.SINGLETON.values())).columns
    assert {"clean_name", "clean_full_address", "street_digits_str"} <= set(kept) and not {"meta_key", "soundex_key", "clean_state", "clean_zip"} & set(kept)
    assert "meta_key" not in linkage._kept(c).columns and set(features.USED_B) <= set(linkage._kept(c, None).columns)
