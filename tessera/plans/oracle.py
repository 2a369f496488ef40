"""SQL that checks the catalogue's queries, for DuckDB over the same tables."""

from __future__ import annotations

from tessera.functions import text as T
from tessera.operators import blocking, decide, scoring
from tessera.sources import synthetic


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def clean(x: str) -> str:
    return "trim(" + sub(f"translate(lower(coalesce({x}, '')), {q(T.MARKS)}, {q(' ' * len(T.MARKS))})", r"\s+", " ") + ")"


def tidy(x: str) -> str:
    return "trim(" + sub(x, r"\s+", " ") + ")"


def any_of(words: list[str]) -> str:
    return rf"\b(?:{'|'.join(words)})\b"


def chain(x: str, pairs) -> str:
    for words, to in pairs:
        x = sub(x, any_of(words if isinstance(words, list) else [words]), to)
    return x


def leet(x: str) -> str:
    for d, c in T.LEET:
        x = sub(x, rf"(\b[a-z]+){d}([a-z]+\b)", rf"\1{c}\2")
    return sub(x, r"\bph", "f")


def root(x: str) -> str:
    return tidy(sub(sub(leet(x), rf"^(?:{'|'.join(T.NAME_PREFIXES)})\s+", ""), any_of(T.NAME_SUFFIXES), " "))


def letter_code(word: str) -> str:
    x = f"translate({sub(f'lower({word})', '[^a-z]', '0')}, {q(T.SOUNDEX_FROM)}, {q(T.SOUNDEX_TO)})"
    for d in "0123456":
        x = sub(x, f"{d}+", d)
    return f"CASE WHEN regexp_matches(lower({word}), '^[a-z]') THEN substr(lower({word}), 1, 1) || rpad(substr(replace(substr({x}, 2), '0', ''), 1, 3), 3, '0') ELSE '' END"


# Registries with the first engine's keys: k
KEYS = f"""WITH e AS ({synthetic.in_duckdb(synthetic.ENTITIES)}),
k1 AS (SELECT source, entity_id AS id, {clean("business_name")} AS name, {clean("business_address")} AS addr, {clean("country")} AS country,
  regexp_extract(coalesce(business_address, ''), '(\\d+)', 1) AS street_digits, regexp_extract(coalesce(business_address, ''), '\\b(\\d{{5,6}})\\b', 1) AS postal_code FROM e),
k2 AS (SELECT *, {root("name")} AS name_root, {tidy(chain("addr", [([w for w in words if w.isascii()], to) for words, to in T.ADDRESS_WORDS]))} AS addr_std,
  trim({chain("country", T.COUNTRIES)}) AS country_std, regexp_extract(addr, {q(rf"\b(?:{'|'.join(T.UNIT_WORDS)})\s*(\d+)\b")}, 1) AS unit_code FROM k1),
k3 AS (SELECT *, array_to_string(list_sort(string_split(name_root, ' ')), ' ') AS sorted_root, coalesce(string_split(name_root, ' ')[1], '') AS first_word,
  coalesce(string_split(name_root, ' ')[2], '') AS second_word, array_to_string(list_transform(string_split(name_root, ' '), lambda t: substr(t, 1, 1)), '') AS acronym,
  {tidy(sub("addr_std", any_of(T.ADDRESS_FILLERS), " "))} AS addr_core, {", ".join(f"substr(name_root, 1, {n}) AS root_prefix_{n}" for n in (5, 4, 3, 2))},
  {sub("lower(name_root)", "[^a-z]", "")} AS letters FROM k2),
k AS (SELECT * EXCLUDE (letters), substr(addr_core, 1, 4) AS addr_core_prefix_4, {letter_code("first_word")} AS soundex_first, {letter_code("second_word")} AS soundex_second,
  substr({sub("lower(first_word)", "[^a-z]|[aeiou]", "")}, 1, 3) AS consonant_stem,
  CASE WHEN length(name_root) < 3 OR length(letters) < 3 THEN '' ELSE array_to_string(list_sort(string_split(substr(letters, 1, 4), '')), '') END AS sorted_3gram FROM k3)
"""


def keys(*cols: str) -> str:
    return f"{KEYS} SELECT id, {', '.join(cols)} FROM k"


# The second engine's keys: c
CLEAN = f"""WITH e AS ({synthetic.in_duckdb(synthetic.ENTITIES)}),
f AS (SELECT source, entity_id AS id, {", ".join(f"{tidy(sub(f'lower({col})', '[^a-z0-9_ ]', ' '))} AS {to}" for col, to in (("business_name", "clean_name_raw"), ("business_address", "address"), ("country", "clean_country"), ("city", "clean_city"), ("state", "clean_state")))},
  {sub("zip", "[^0-9]", "")} AS clean_zip, {sub("phone", "[^0-9]", "")} AS digits FROM e),
c1 AS (SELECT source, id, clean_name_raw, clean_country, clean_city, clean_state, clean_zip, CASE WHEN length(digits) >= 10 THEN right(digits, 10) ELSE digits END AS clean_phone,
  {tidy(sub("clean_name_raw", any_of(T.LEGAL_SUFFIXES), ""))} AS clean_name, {tidy(chain("address", T.STREET_WORDS))} AS clean_address FROM f),
c2 AS (SELECT *, trim(clean_address || ' ' || clean_city || ' ' || clean_state || ' ' || clean_zip) AS clean_full_address FROM c1),
c AS (SELECT *, array_to_string(list_slice(list_filter(string_split(clean_name, ' '), lambda t: length(t) > 1), 1, 2), ' ') AS name_first_tokens,
  array_to_string(regexp_extract_all(clean_full_address, '\\b(\\d+)\\b', 1), ' ') AS street_digits_str FROM c2)
"""


def cleaned(*cols: str) -> str:
    return f"{CLEAN} SELECT id, {', '.join(cols)} FROM c"


def one_pass(p: blocking.Pass) -> str:
    guard = lambda sat: " AND ".join(f"length({c}) >= {n}" for c, n in p.guard(sat))
    on = " AND ".join(f"a.{x} = s.{y}" for x, y in zip(p.columns(False), p.columns(True), strict=True))
    return f"""SELECT {q(p.name)} AS pass, a.id AS s1_id, s.source, s.id AS cand_id FROM (SELECT * FROM k WHERE source = 'source1' AND {guard(False)}) a
JOIN (SELECT *, row_number() OVER (PARTITION BY source, {", ".join(p.columns(True))} ORDER BY id) AS n FROM k WHERE source <> 'source1' AND {guard(True)}) s ON {on} WHERE s.n <= {p.cap}"""


def block(p: blocking.Pass) -> str:
    return f"{KEYS} {one_pass(p)}"


EVERY = f"{KEYS}, every AS ({' UNION ALL '.join(one_pass(p) for p in blocking.PASSES)}), pairs AS (SELECT DISTINCT s1_id, source, cand_id FROM every)"
CANDIDATES = f"{EVERY} SELECT * FROM pairs"
PASS_COUNTS = f"{EVERY} SELECT pass, source, count(*) AS n FROM every GROUP BY ALL"
CANDIDATE_LISTS = f"""{EVERY} SELECT a.id AS source1_entity_id, coalesce(string_agg(cand_id, ',' ORDER BY p.source, cand_id), '') AS candidate_entity_ids
FROM k a LEFT JOIN pairs p ON p.s1_id = a.id WHERE a.source = 'source1' GROUP BY a.id"""


def _both(c: str) -> str:
    return f"(a.{c} <> '' AND b.{c} <> '')"


def _same(c: str) -> str:
    return f"(a.{c} <> '' AND a.{c} = b.{c})"


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _edit(c: str, default: float) -> str:
    return f"CASE WHEN {_both(c)} THEN 1 - levenshtein(a.{c}, b.{c})::DOUBLE / greatest(length(a.{c}), length(b.{c})) ELSE {default}::DOUBLE END"


DELTA = "abs(try_cast(a.street_digits AS HUGEINT) - try_cast(b.street_digits AS HUGEINT))"
TOKENS = "list_distinct(string_split({}.name_root, ' '))"
FEATURES = {
    "exact_name": _flag(_same("name")),
    "exact_root": _flag(_same("name_root")),
    "lev_root": _edit("name_root", 0.0),
    "len_diff_ratio": "abs(length(a.name_root) - length(b.name_root))::DOUBLE / greatest(length(a.name_root), length(b.name_root), 1)",
    "acronym_match": _flag("(a.acronym <> '' AND b.name_root <> '' AND (a.acronym = b.name_root OR a.acronym = b.acronym)) OR (b.acronym <> '' AND a.name_root <> '' AND b.acronym = a.name_root)"),
    "soundex_match": _flag(_same("soundex_first")),
    "consonant_match": _flag(_same("consonant_stem") + " AND length(a.consonant_stem) >= 2"),
    "lev_addr": _edit("addr_std", 0.4),
    "core_addr_lev": _edit("addr_core", 0.4),
    "same_digits": _flag(_same("street_digits")),
    "diff_digits": _flag(_both("street_digits") + " AND a.street_digits <> b.street_digits"),
    "digit_num_diff": f"coalesce(least({DELTA}, 50)::DOUBLE / 50, 0.0)",
    "same_unit": _flag(_same("unit_code")),
    "same_pin": _flag(_same("postal_code")),
    "diff_pin": _flag(_both("postal_code") + " AND a.postal_code <> b.postal_code"),
    "same_country": _flag(_same("country_std")),
    "pin_and_digits": _flag(_same("postal_code") + " AND " + _same("street_digits")),
    "strong_exact_pair": _flag(f"{_same('name_root')} AND ({_same('street_digits')} OR {_same('postal_code')})"),
    "root_contains": _flag("length(a.name_root) >= 4 AND length(b.name_root) >= 4 AND (contains(a.name_root, b.name_root) OR contains(b.name_root, a.name_root))"),
    "exact_full_addr": _flag(_same("addr_std")),
    "exact_root_and_pin": _flag(_same("name_root") + " AND " + _same("postal_code")),
    "exact_addr_core": _flag(_same("addr_core") + " AND length(a.addr_core) >= 6"),
    "shared_tokens": f"len(list_intersect({TOKENS.format('a')}, {TOKENS.format('b')}))::DOUBLE / greatest(len(list_distinct(list_concat({TOKENS.format('a')}, {TOKENS.format('b')}))), 1)",
    "adjacent_door_penalty": _flag(f"coalesce({DELTA} BETWEEN 1 AND 4, false)"),
    "jw_root": "CASE WHEN a.name_root <> '' AND b.name_root <> '' THEN round(jaro_winkler_similarity(a.name_root, b.name_root), 6) ELSE 0.0::DOUBLE END",
    "jw_addr": "CASE WHEN a.addr_std <> '' AND b.addr_std <> '' THEN round(jaro_winkler_similarity(a.addr_std, b.addr_std), 6) ELSE 0.4::DOUBLE END",
}
MATERIAL = f"""{EVERY.replace("pairs AS (", "pairs AS MATERIALIZED (")}"""


def features(*names: str, more: str = "") -> str:
    """CTE fs: pairs with some features."""
    cols = ", ".join(f"{FEATURES[n]} AS {n}" for n in names)
    return f"{MATERIAL}, fs AS (SELECT p.s1_id, p.source, p.cand_id, {cols} FROM pairs p JOIN k a ON a.id = p.s1_id AND a.source = 'source1' JOIN k b ON b.id = p.cand_id AND b.source = p.source){more}"


def feature_query(*names: str) -> str:
    return f"{features(*names)} SELECT * FROM fs"


USED = ["exact_root", "same_digits", "same_pin", "same_country", "soundex_match", "same_unit", "adjacent_door_penalty"]
RULE = "round(0.0 + " + " + ".join(f"{n} * {w}::DOUBLE" for n, w in scoring.RULE.items()) + ", 6)"
FLOORED = f"CASE WHEN exact_root = 1 AND (same_digits = 1 OR same_pin = 1) THEN greatest(s, {scoring.EXACT_FLOOR}::DOUBLE) ELSE s END"
CAPPED = f"CASE WHEN adjacent_door_penalty = 1 AND exact_root = 0 THEN least(s, {scoring.DOOR_CAP}::DOUBLE) ELSE s END"
SCORES = features(
    *USED,
    more=f""", r0 AS (SELECT *, {RULE} AS s FROM fs), r1 AS (SELECT * REPLACE ({FLOORED} AS s) FROM r0), r2 AS (SELECT * REPLACE ({CAPPED} AS s) FROM r1),
r3 AS (SELECT *, max(CASE WHEN source = 'source2' THEN s END) OVER (PARTITION BY s1_id) AS x, max(CASE WHEN source = 'source3' THEN s END) OVER (PARTITION BY s1_id) AS y FROM r2),
sc AS (SELECT s1_id, source, cand_id, CASE WHEN x >= {scoring.SUPPORT} AND y >= {scoring.SUPPORT} AND s >= {scoring.SUPPORT} THEN s * {scoring.BOOST}::DOUBLE ELSE s END AS score FROM r3)""",
)
#: A lower cutoff than the default, so that the margin and top-K have something to do.
LOW = 0.5


def _chosen(cutoff: float) -> str:
    return f"""{SCORES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, cand_id ORDER BY score DESC, s1_id) AS n FROM sc WHERE score >= {cutoff}) WHERE n = 1),
m AS (SELECT * FROM (SELECT * EXCLUDE (n), max(score) OVER (PARTITION BY source, s1_id) AS t FROM b) WHERE score >= t * {decide.MARGIN}::DOUBLE),
top AS (SELECT * FROM (SELECT * EXCLUDE (t), row_number() OVER (PARTITION BY source, s1_id ORDER BY score DESC, cand_id) AS n FROM m) WHERE n <= {decide.TOP})"""


R = "round(score, 6) AS score"
TRUTH = f"t0 AS ({synthetic.in_duckdb(synthetic.TRUTH)}), t AS (SELECT a.id AS s1_id, coalesce(list(cand_id ORDER BY cand_id) FILTER (WHERE cand_id IS NOT NULL), []) AS true_ids FROM k a LEFT JOIN t0 ON t0.s1_id = a.id WHERE a.source = 'source1' GROUP BY a.id)"
PREDICTED = f"{_chosen(LOW)}, {TRUTH}, p AS (SELECT s1_id, list(cand_id) AS pred_ids FROM top GROUP BY s1_id), en AS (SELECT t.s1_id, len(true_ids) AS n_true, coalesce(len(pred_ids), 0) AS n_pred, coalesce(len(list_intersect(true_ids, pred_ids)), 0) AS tp FROM t LEFT JOIN p USING (s1_id)), es AS (SELECT *, CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_pred = 0 OR tp = 0 THEN 0.0::DOUBLE ELSE 1.25 * (tp::DOUBLE / n_pred) * (tp::DOUBLE / n_true) / (0.25 * (tp::DOUBLE / n_pred) + tp::DOUBLE / n_true) END AS f FROM en)"
GATED = f"""{SCORES}, {TRUTH}, w AS (SELECT *, max(score) OVER (PARTITION BY s1_id) AS best, row_number() OVER (PARTITION BY s1_id ORDER BY score DESC, cand_id) AS n FROM sc)"""


def gate(g: float = decide.GATE, floor: float = decide.FLOOR, share: float = decide.SHARE) -> str:
    return f"""{GATED}, kept AS (SELECT * FROM w WHERE best >= {g} AND (score >= greatest({floor}::DOUBLE, best * {share}::DOUBLE) OR n = 1))
SELECT a.id AS s1_id, coalesce(string_agg(cand_id, ',' ORDER BY score DESC, cand_id), '') AS pred_ids FROM k a LEFT JOIN kept ON kept.s1_id = a.id WHERE a.source = 'source1' GROUP BY a.id"""


def grid() -> str:
    rows = ", ".join(f"({s!r}::DOUBLE, {m!r}::DOUBLE, {r!r}::DOUBLE)" for s, m, r in decide.grid())
    return f"""{GATED}, g(gate, floor, share) AS (VALUES {rows}),
links AS (SELECT s1_id, unnest(true_ids) AS cand_id FROM t),
h AS (SELECT w.*, l.cand_id IS NOT NULL AS hit FROM w LEFT JOIN links l USING (s1_id, cand_id)),
each AS (SELECT gate, floor, share, s1_id, count(*) AS n_pred, count(*) FILTER (WHERE hit) AS tp FROM h JOIN g ON best >= gate AND (score >= greatest(floor, best * share) OR n = 1) GROUP BY ALL),
al AS (SELECT g.*, t.s1_id, len(true_ids) AS n_true FROM g CROSS JOIN t),
es AS (SELECT al.gate, al.floor, al.share, n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM al LEFT JOIN each USING (gate, floor, share, s1_id))
SELECT gate, floor, share, round(avg(CASE WHEN n_true = 0 AND n_pred = 0 THEN 1.0::DOUBLE WHEN n_true = 0 OR n_pred = 0 OR tp = 0 THEN 0.0::DOUBLE ELSE 1.25 * (tp::DOUBLE / n_pred) * (tp::DOUBLE / n_true) / (0.25 * (tp::DOUBLE / n_pred) + tp::DOUBLE / n_true) END), 6) AS macro_f05 FROM es GROUP BY ALL"""


def equal(rule: str) -> str:
    name, cols, least, sim = next(r for r in blocking.EXACT if r[0] == rule)
    on = " AND ".join(f"a.{c} = b.{c}" for c in cols)
    holds = " AND ".join(f"length(a.{c}) >= {n}" for c, n in zip(cols, least, strict=True))
    return f"{CLEAN} SELECT a.id AS s1_id, b.id AS candidate_id, round({sim}, 2)::DOUBLE AS sim FROM c a JOIN c b ON {on} AND a.source = 'source1' AND b.source <> 'source1' WHERE {holds}"


def _equal_every() -> str:
    parts = []
    for _, cols, least, sim in blocking.EXACT:
        on = " AND ".join(f"a.{c} = b.{c}" for c in cols)
        holds = " AND ".join(f"length(a.{c}) >= {n}" for c, n in zip(cols, least, strict=True))
        parts.append(f"SELECT a.id AS s1_id, b.id AS candidate_id, {sim}::DOUBLE AS sim FROM c a JOIN c b ON {on} AND a.source = 'source1' AND b.source <> 'source1' WHERE {holds}")
    return " UNION ALL ".join(parts)


MERGED = f"""{CLEAN}, every AS ({_equal_every()}), best AS (SELECT s1_id, candidate_id, max(sim) AS sim FROM every GROUP BY ALL)
SELECT s1_id, candidate_id, round(sim, 2) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, candidate_id) AS n FROM best) WHERE n <= {blocking.MOST}"""


def weights(low: int, high: int) -> str:
    sized = []
    for n in range(low, high + 1):
        once = f"length(w) <= {n}" if n == low else f"length(w) = {n}"
        sized.append(f"CASE WHEN length(w) > {n} THEN list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i, {n})) WHEN {once} THEN [w] ELSE [] END")
    return f"""{CLEAN}, ws AS (SELECT source || id AS id, ' ' || unnest(list_filter(string_split(clean_name, ' '), lambda t: t <> '')) || ' ' AS w FROM c),
gr AS (SELECT id, unnest(list_concat({", ".join(sized)})) AS gram FROM ws), tf AS (SELECT id, gram, count(*) AS tf FROM gr GROUP BY ALL),
df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 2), nn AS (SELECT count(*) AS n FROM c),
raw AS (SELECT id, gram, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS x FROM tf JOIN df USING (gram) CROSS JOIN nn), nm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY id)
SELECT id, gram, round(x / norm, 6) AS weight FROM raw JOIN nm USING (id)"""


NEGATIVES = f"""{KEYS}, t0 AS ({synthetic.in_duckdb(synthetic.TRUTH)}), neg AS (
SELECT a.id AS s1_id, b.id AS cand_id FROM k a JOIN k b ON a.name_root = b.name_root AND a.country_std = b.country_std WHERE a.source = 'source1' AND b.source = 'source2'
UNION SELECT a.id, b.id FROM k a JOIN k b ON a.street_digits = b.street_digits AND a.root_prefix_3 = b.root_prefix_3 AND a.country_std = b.country_std WHERE a.source = 'source1' AND b.source = 'source2'),
hard AS (SELECT * FROM neg n WHERE NOT EXISTS (SELECT 1 FROM t0 WHERE t0.s1_id = n.s1_id AND t0.cand_id = n.cand_id))"""
