import itertools

import numpy as np
import pytest

from tessera.functions import batches, similarity
from tessera.operators import features
from tests.test_similarity import texts


@pytest.mark.parametrize(("alphabet", "longest"), [("ab ", 9), ("abcdefgh  ", 40), ("abcdefghijk   ", 70), ("abé\0\t ", 30)])
@pytest.mark.parametrize("name", list(batches.MANY))
def test_many_pairs_have_the_similarities_of_one(name, alphabet, longest):
    """To the last bit; empty and equal texts, texts of 63 and 64 characters and other scripts among them."""
    a = list(dict.fromkeys(["", " ", "  a", "a" * 63, "b" * 64, *texts(40, 1, alphabet, longest)]))
    b = list(dict.fromkeys([*a[:12], "b" * 63, *texts(40, 2, alphabet, longest)]))
    pairs = list(itertools.product(range(len(a)), range(len(b))))
    got = batches.similarities(name, batches.Texts(a), batches.Texts(b), *np.array(pairs).T)
    assert got.tolist() == [similarity.FUNCTIONS[name](a[i], b[j]) for i, j in pairs]


def test_features_are_computed_where_satellites_are_looked_up(spark):
    """One pass through Python; repeated records and unknown ids count."""
    fields = ["id", "source", *features.USED_B]
    record = lambda i, source, name: (i, source, name, f"{name} st", *["k"] * (len(features.USED_B) - 2))
    rows = [record("a", "source1", "golden coffee"), record("a", "source1", "royal tea"), record("b", "source2", "golden tea"), record("b", "source3", "café royal")]
    cleaned = spark.createDataFrame(rows, ", ".join(f"{x} string" for x in fields))
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.25), ("z", "b", None)], "s1_id string, candidate_id string, tfidf_sim float")
    out = features.features_b(pairs, cleaned)
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.s1_id, r.candidate_id, r.source, r.feat_blocking_tfidf_sim): r for r in out.collect()}
    jw = sorted(r.feat_name_jw for r in out.where("s1_id = 'a' AND candidate_id = 'b'").collect())
    want = sorted(similarity.jaro_winkler(x, y) for x in ("golden coffee", "royal tea") for y in ("golden tea", "café royal"))
    assert jw == pytest.approx(want) and out.count() == 8
    none = got["a", "c", None, 0.25]
    assert none.feat_phone_missing == 1 and none.feat_is_source2 == 0 and none.feat_city_exact == 0 and none.feat_name_jw == 0
    assert got["z", "b", "source2", 0.0].feat_is_source2 == 1 and got["z", "b", "source3", 0.0].feat_is_source2 == 0
