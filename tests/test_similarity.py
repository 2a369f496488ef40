import itertools
import random

import duckdb
import pytest

from tessera.functions import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def texts(n, seed=0, alphabet="abc ", longest=14):
    r = random.Random(seed)
    return ["".join(r.choices(alphabet, k=r.randrange(longest))) for _ in range(n)]


def test_common_against_table():
    for a, b in itertools.product(texts(40), texts(40, 1)):
        assert S.common(a, b) == lcs(a, b)


def test_partial_against_all_windows():
    for a, b in itertools.product(texts(30, 2), texts(30, 3)):
        if a and b:
            x, y = sorted((a, b), key=len)
            best = 0.0
            for u, v in [(x, y)] + [(y, x)] * (len(x) == len(y)):
                m = len(u)
                for i in range(1 - m, len(v)):
                    w = v[max(0, i) : i + m]
                    best = max(best, S.ratio(u, w))
            assert S.partial(a, b) == pytest.approx(best)


def test_jaro_winkler_against_duckdb():
    c = duckdb.connect()
    pairs = [(a, b) for a, b in itertools.product(texts(40, 4, "abcdefgh"), texts(40, 5, "abcdefgh")) if a and b]
    want = c.execute("SELECT jaro_winkler_similarity(a, b) FROM (SELECT unnest(?) AS a, unnest(?) AS b)", [[a for a, _ in pairs], [b for _, b in pairs]]).fetchall()
    assert [S.jaro_winkler(a, b) for a, b in pairs] == pytest.approx([w for (w,) in want])


@pytest.mark.parametrize(
    ("f", "a", "b", "want"),
    [
        (S.ratio, "", "", 1.0),
        (S.ratio, "abc", "abd", 2 / 3),
        (S.token_sort, "new york mets", "mets york new", 1.0),
        (S.token_set, "fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0),
        (S.token_set, "a b", "c d", 2 * 1 / 6),
        (S.token_set, "", "a", 0.0),
        (S.partial, "york", "new york city", 1.0),
        (S.partial, "", "a", 0.0),
        (S.jaro_winkler, "martha", "marhta", 0.9611111111111111),
        (S.jaro_winkler, "", "a", 0.0),
    ],
)
def test_values(f, a, b, want):
    assert f(a, b) == pytest.approx(want)
