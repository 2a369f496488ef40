"""SQL that checks string similarities, sound keys and the second engine's candidates and features.

Longest common subsequences are folds of bit sets over a text's characters; a partial ratio tries every window; sound keys are
read off each letter's neighbours. None of it shares code with the engine.
"""

from __future__ import annotations

from tessera.operators import blocking
from tessera.plans import oracle as O

# Sound keys


def soundex(x: str) -> str:
    """Soundex of the first 25 characters of column x."""
    s = f"upper(substr({x}, 1, 25))"
    code = f"translate(regexp_replace(substr({s}, 2), '[^A-Z]', '0', 'g'), 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000077111122222222334556')"
    first = f"translate(substr({s}, 1, 1), 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000077111122222222334556')"
    runs = f"{first} || replace({code}, '7', '')"
    for d in "0123456":
        runs = O.sub(runs, f"{d}+", d)
    return f"CASE WHEN {s} = '' THEN '' WHEN NOT regexp_matches({s}, '^[A-Z]') THEN substr({x}, 1, 25) ELSE substr({s}, 1, 1) || rpad(substr(replace(substr({runs}, 2), '0', ''), 1, 3), 3, '0') END"


def metaphone(x: str) -> str:
    """Metaphone of the first 25 characters of column x: each word's letters by their neighbours."""
    letters = f"regexp_replace(upper(substr({x}, 1, 25)), '[^A-Z ]', '', 'g')"
    word = "CASE WHEN substr(v, 1, 2) IN ('AE', 'GN', 'KN', 'PN', 'WR') THEN substr(v, 2) WHEN substr(v, 1, 1) = 'X' THEN 'S' || substr(v, 2) WHEN substr(v, 1, 2) = 'WH' THEN 'W' || substr(v, 3) ELSE v END"
    vowel = lambda s: f"({s} <> '' AND contains('AEIOU', {s}))"
    c, b, a, a2, b2 = "substr(w, i, 1)", "(CASE WHEN i = 1 THEN '' ELSE substr(w, i - 1, 1) END)", "substr(w, i + 1, 1)", "substr(w, i + 2, 1)", "(CASE WHEN i < 3 THEN '' ELSE substr(w, i - 2, 1) END)"
    soft = f"{a} IN ('I', 'E', 'Y')"
    # a letter that a pair of letters before it has swallowed: H behind C, G, P, S and T; G of DG before E, Y and I
    swallowed = f"({c} = 'H' AND {b} IN ('C', 'G', 'P', 'S', 'T') AND ({b2} <> {b} OR {b} = 'C')) OR ({c} = 'G' AND {b} = 'D' AND {b2} <> 'D' AND {a} IN ('E', 'Y', 'I'))"
    code = f"""CASE WHEN {swallowed} THEN '' WHEN {c} = {b} AND {c} <> 'C' THEN ''
      WHEN {vowel(c)} THEN CASE WHEN i = 1 THEN {c} ELSE '' END
      WHEN {c} = 'B' THEN CASE WHEN i = length(w) AND {b} = 'M' THEN '' ELSE 'B' END
      WHEN {c} = 'C' THEN CASE WHEN {a} = 'H' THEN CASE WHEN {b} = 'S' THEN 'K' ELSE 'X' END WHEN substr(w, i, 3) = 'CIA' THEN 'X' WHEN {soft} THEN CASE WHEN {b} = 'S' THEN '' ELSE 'S' END ELSE 'K' END
      WHEN {c} = 'D' THEN CASE WHEN {a} = 'G' AND {a2} IN ('E', 'Y', 'I') THEN 'J' ELSE 'T' END
      WHEN {c} = 'G' THEN CASE WHEN {a} = 'H' THEN CASE WHEN {a2} <> '' AND NOT {vowel(a2)} THEN '' WHEN i > 1 AND {a2} = '' THEN '' ELSE 'K' END
        WHEN {a} = 'N' AND (i + 1 = length(w) OR substr(w, i + 1) = 'NED') THEN '' WHEN {soft} THEN 'J' ELSE 'K' END
      WHEN {c} = 'H' THEN CASE WHEN {vowel(a)} AND {b} NOT IN ('C', 'S', 'P', 'T', 'G') THEN 'H' ELSE '' END
      WHEN {c} = 'K' THEN CASE WHEN {b} = 'C' THEN '' ELSE 'K' END
      WHEN {c} = 'P' THEN CASE WHEN {a} = 'H' THEN 'F' ELSE 'P' END
      WHEN {c} = 'Q' THEN 'K'
      WHEN {c} = 'S' THEN CASE WHEN {a} = 'H' OR substr(w, i, 3) IN ('SIO', 'SIA') THEN 'X' ELSE 'S' END
      WHEN {c} = 'T' THEN CASE WHEN substr(w, i, 3) IN ('TIA', 'TIO') THEN 'X' WHEN {a} = 'H' THEN '0' WHEN substr(w, i, 3) = 'TCH' THEN '' ELSE 'T' END
      WHEN {c} = 'V' THEN 'F' WHEN {c} IN ('W', 'Y') THEN CASE WHEN {vowel(a)} THEN {c} ELSE '' END WHEN {c} = 'X' THEN 'KS' WHEN {c} = 'Z' THEN 'S' ELSE {c} END"""
    words = f"list_transform(list_filter(string_split({letters}, ' '), lambda v: v <> ''), lambda v: {word})"
    return f"array_to_string(list_transform({words}, lambda w: array_to_string(list_transform(range(1, length(w) + 1), lambda i: {code}), '')), '')"


# Similarities of pairs of texts: tables ratio(x, y, r) and best(x, y, r) for the pairs that a query needs

_MASK = "list_reduce(list_transform(range(0, length(x)), lambda i: CASE WHEN substr(x, i::INTEGER + 1, 1) = c THEN 1::HUGEINT << i::INTEGER ELSE 0::HUGEINT END), lambda p, q: p | q, 0::HUGEINT)"
#: For each text, where each of its characters stands, as a bit set.
_MASKS = f"SELECT x, map(k, list_transform(k, lambda c: {_MASK})) AS m, (1::HUGEINT << length(x)) - 1 AS ones FROM (SELECT x, list_distinct(string_split(x, '')) AS k FROM (SELECT DISTINCT x FROM {{0}}))"
_BITS = "list_transform(string_split(y, ''), lambda c: coalesce(m[c], 0::HUGEINT))"
_FOLD = "bit_count(list_reduce({bits}, lambda s, m: ((s + (s & m)) | (s - (s & m))) & ones, ones))"


def sorted_tokens(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split({x}, ' '), lambda t: t <> '')), ' ')"


def _set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def _joined(x: str) -> str:
    return f"array_to_string(list_sort({x}), ' ')"


class Similarities:
    """Collects what a query compares; ctes() gives the tables, the methods give expressions over rows with columns."""

    def __init__(self, source: str):
        self.source, self.need, self.windows, self.joins = source, [], [], []

    def _ratio(self, x: str, y: str) -> str:
        n = len(self.joins)
        self.need.append(f"SELECT {x} AS x, {y} AS y FROM {self.source}")
        self.joins.append(f"LEFT JOIN ratios r{n} ON r{n}.x = {x} AND r{n}.y = {y}")
        return f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE ELSE r{n}.r END"

    def ratio(self, a: str, b: str, empty: float = 0.0) -> str:
        return f"CASE WHEN {a} = '' OR {b} = '' THEN {empty}::DOUBLE ELSE {self._ratio(a, b)} END"

    def token_sort(self, a: str, b: str, empty: float = 0.0) -> str:
        return f"CASE WHEN {a} = '' OR {b} = '' THEN {empty}::DOUBLE ELSE {self._ratio(sorted_tokens(a), sorted_tokens(b))} END"

    def token_set(self, a: str, b: str, empty: float = 0.0) -> str:
        x, y = _set(a), _set(b)
        both = _joined(f"list_intersect({x}, {y})")
        u, v = (f"trim({both} || ' ' || {_joined(f'list_filter({p}, lambda t: NOT list_contains({q}, t))')})" for p, q in ((x, y), (y, x)))
        with_both = lambda s: f"2.0 * length({both}) / (length({both}) + length({s}))"
        return f"""CASE WHEN {a} = '' OR {b} = '' THEN {empty}::DOUBLE WHEN {both} <> '' AND ({u} = {both} OR {v} = {both}) THEN 1.0::DOUBLE
          WHEN {both} <> '' THEN greatest({self._ratio(u, v)}, {with_both(u)}, {with_both(v)}) ELSE {self._ratio(u, v)} END"""

    def partial(self, a: str, b: str, empty: float = 0.0) -> str:
        n = len(self.joins)
        short, long = (f"CASE WHEN length({a}) <= length({b}) THEN {p} ELSE {q} END" for p, q in ((a, b), (b, a)))
        self.windows.append(f"SELECT {short} AS x, {long} AS y FROM {self.source}")
        self.joins.append(f"LEFT JOIN partials r{n} ON r{n}.x = {short} AND r{n}.y = {long}")
        return f"CASE WHEN {a} = '' OR {b} = '' THEN {empty}::DOUBLE ELSE r{n}.r END"

    @staticmethod
    def jaro_winkler(a: str, b: str, empty: float = 0.0) -> str:
        return f"CASE WHEN {a} = '' OR {b} = '' THEN {empty}::DOUBLE ELSE jaro_winkler_similarity({a}, {b}) END"

    def ctes(self) -> str:
        out = ""
        if self.need:
            out += f""", rneed AS MATERIALIZED (SELECT DISTINCT x, y FROM ({" UNION ALL ".join(self.need)}) WHERE x <> '' AND y <> '' AND x <> y),
rmask AS MATERIALIZED ({_MASKS.format("rneed")}),
ratios AS MATERIALIZED (SELECT x, y, 2.0::DOUBLE * (length(x) - {_FOLD.format(bits="bits")}) / (length(x) + length(y)) AS r FROM (SELECT x, y, ones, {_BITS} AS bits FROM rneed JOIN rmask USING (x)))"""
        if self.windows:
            out += f""", pneed AS MATERIALIZED (SELECT DISTINCT x, y FROM ({" UNION ALL ".join(self.windows)}) WHERE x <> '' AND y <> ''),
pboth AS MATERIALIZED (SELECT x, y, x AS x0, y AS y0 FROM pneed UNION ALL SELECT y, x, x, y FROM pneed WHERE length(x) = length(y)),
pmask AS MATERIALIZED ({_MASKS.format("pboth")}),
pwin AS (SELECT x0, y0, x, ones, list_slice(bits, greatest(i, 0) + 1, i + length(x)) AS part FROM (SELECT x0, y0, x, y, ones, {_BITS} AS bits, unnest(range(1 - length(x), length(y)))::INTEGER AS i FROM pboth JOIN pmask USING (x))),
partials AS MATERIALIZED (SELECT x0 AS x, y0 AS y, max(2.0::DOUBLE * (length(x) - {_FOLD.format(bits="part")}) / (length(x) + len(part))) AS r FROM pwin GROUP BY x0, y0)"""
        return out

    def join(self) -> str:
        return " ".join(self.joins)


#: Similarities of the first engine's pairs, as in its features.
def kernel(s: Similarities, name: str) -> str:
    how, column, empty = {
        "jw_root": (s.jaro_winkler, "name_root", 0.0), "sort_root": (s.token_sort, "name_root", 0.0), "set_root": (s.token_set, "name_root", 0.0),
        "partial_root": (s.partial, "name_root", 0.0), "qratio_root": (s.ratio, "name_root", 0.0), "jw_soundex": (s.jaro_winkler, "soundex_first", 0.0),
        "jw_addr": (s.jaro_winkler, "addr_std", 0.4), "sort_addr": (s.token_sort, "addr_std", 0.4), "set_addr": (s.token_set, "addr_std", 0.4),
        "core_addr_sort": (s.token_sort, "addr_core", 0.4), "core_addr_set": (s.token_set, "addr_core", 0.4),
    }[name]
    return how(f"a_{column}", f"b_{column}", empty)


_SIDES = ("name_root", "soundex_first", "addr_std", "addr_core")
SIMILAR = ("jw_root", "sort_root", "set_root", "partial_root", "qratio_root", "jw_soundex", "jw_addr", "sort_addr", "set_addr", "core_addr_sort", "core_addr_set")


def _pairs(native: tuple[str, ...]) -> str:
    both = ", ".join(f"{t}.{c} AS {t}_{c}" for c in _SIDES for t in "ab")
    cols = "".join(f", {O.FEATURES[n]} AS {n}" for n in native)
    return f"{O.MATERIAL}, ps AS MATERIALIZED (SELECT p.s1_id, p.source, p.cand_id, {both}{cols} FROM pairs p JOIN k a ON a.id = p.s1_id AND a.source = 'source1' JOIN k b ON b.id = p.cand_id AND b.source = p.source)"


def kernels(*names: str) -> str:
    s = Similarities("ps")
    cols = ", ".join(f"round({kernel(s, n)}, 6) AS {n}" for n in names)
    return f"{_pairs(())}{s.ctes()} SELECT s1_id, source, cand_id, {cols} FROM ps {s.join()}"


def vector40(order: list[str]) -> str:
    native = tuple(n for n in O.FEATURES if n not in SIMILAR)
    s = Similarities("ps")
    similar = ", ".join(f"{kernel(s, n)} AS {n}" for n in SIMILAR)
    flag = lambda x: f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    more = {
        "translit_flag": flag("sort_addr >= 0.70 AND same_digits = 1"),
        "composite": "greatest(jw_root, sort_root, acronym_match) * sort_addr",
        "addr_match_score": "sort_addr * 0.7::DOUBLE + same_digits * 0.3::DOUBLE",
        "phonetic_addr_composite": "greatest(soundex_match, consonant_match) * sort_addr",
        "sort_set_diff": "abs(sort_root - set_root)",
    }
    cols = ", ".join(f"round(({more.get(n, n)})::FLOAT::DOUBLE, 5) AS {n}" for n in order)
    return f"{_pairs(native)}{s.ctes()}, all40 AS (SELECT s1_id, source, cand_id, {', '.join(native)}, {similar} FROM ps {s.join()}) SELECT s1_id, source, cand_id, {cols} FROM all40"


# The second engine


def _weighted(name: str, text: str, low: int, high: int) -> str:
    """Table <name>(id, gram, weight): unit vectors of the text of every record."""
    sized = []
    for n in range(low, high + 1):
        once = f"length(w) <= {n}" if n == low else f"length(w) = {n}"
        sized.append(f"CASE WHEN length(w) > {n} THEN list_transform(range(1, length(w) - {n} + 2), lambda i: substr(w, i::INTEGER, {n})) WHEN {once} THEN [w] ELSE [] END")
    return f"""{name}w AS (SELECT source, id, ' ' || unnest(list_filter(string_split({text}, ' '), lambda t: t <> '')) || ' ' AS w FROM c),
{name}t AS (SELECT source, id, gram, count(*) AS tf FROM (SELECT source, id, unnest(list_concat({", ".join(sized)})) AS gram FROM {name}w) GROUP BY ALL),
{name}d AS (SELECT gram, count(*) AS df FROM {name}t GROUP BY gram HAVING count(*) >= 2),
{name}r AS (SELECT source, id, gram, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM c)) / (1 + df)) + 1) AS x FROM {name}t JOIN {name}d USING (gram)),
{name}n AS (SELECT source, id, sqrt(sum(x * x)) AS norm FROM {name}r GROUP BY ALL),
{name} AS MATERIALIZED (SELECT source, id, gram, x / norm AS weight FROM {name}r JOIN {name}n USING (source, id))"""


def _top(name: str, top: int, least: float) -> str:
    """Table <name>_top(s1_id, candidate_id, cosine)."""
    return f"""{name}_top AS MATERIALIZED (SELECT s1_id, candidate_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY cosine DESC, candidate_id) AS n FROM
  (SELECT a.id AS s1_id, b.id AS candidate_id, round(sum(a.weight * b.weight), 9) AS cosine FROM {name} a JOIN {name} b USING (gram) WHERE a.source = 'source1' AND b.source <> 'source1' GROUP BY ALL) WHERE cosine >= {least}) WHERE n <= {top})"""


NAME, BOTH = "clean_name", "clean_name || ' ' || clean_address"


def top_similar(text: str, low: int, high: int, top: int, least: float) -> str:
    return f"{O.CLEAN}, {_weighted('g', text, low, high)}, {_top('g', top, least)} SELECT s1_id, candidate_id, cosine FROM g_top"


CANDIDATES_B = f"""{O.CLEAN}, {_weighted("g", NAME, 2, 4)}, {_top("g", 25, 0.25)}, {_weighted("h", BOTH, 3, 4)}, {_top("h", 20, 0.18)},
alike AS (SELECT s1_id, candidate_id, max(sim) AS sim FROM (SELECT s1_id, candidate_id, sim::FLOAT AS sim FROM ({O._equal_every()}) UNION ALL SELECT s1_id, candidate_id, cosine::FLOAT FROM g_top UNION ALL SELECT s1_id, candidate_id, cosine::FLOAT FROM h_top) GROUP BY ALL),
cb AS MATERIALIZED (SELECT s1_id, candidate_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY sim DESC, candidate_id) AS n FROM alike) WHERE n <= {blocking.MOST})"""
CANDIDATES_B_QUERY = f"{CANDIDATES_B} SELECT s1_id, candidate_id, round(sim::DOUBLE, 5) AS sim FROM cb"


def _features_b() -> tuple[str, dict[str, str]]:
    """CTEs up to the pairs' keys, and the features over them."""
    used = ("clean_name", "clean_full_address", "street_digits_str", "clean_city", "clean_state", "clean_country", "clean_zip", "clean_phone")
    keys = f"keyed AS MATERIALIZED (SELECT *, {metaphone('clean_name')} AS meta_key, {soundex('clean_name')} AS soundex_key FROM c)"
    both = ", ".join(f"{t}.{c} AS {t}_{c}" for c in (*used, "meta_key", "soundex_key") for t in "ab")
    pairs = f"fb AS MATERIALIZED (SELECT s1_id, candidate_id, sim, b.source, {both} FROM cb JOIN keyed a ON a.id = s1_id AND a.source = 'source1' JOIN keyed b ON b.id = candidate_id AND b.source <> 'source1')"
    s = Similarities("fb")
    an, bn, aa, ba = "a_clean_name", "b_clean_name", "a_clean_full_address", "b_clean_full_address"
    flag = lambda x: f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    same = lambda c: flag(f"a_{c} <> '' AND a_{c} = b_{c}")
    cols = {
        "feat_name_ratio": s.ratio(an, bn), "feat_name_token_set": s.token_set(an, bn), "feat_name_token_sort": s.token_sort(an, bn), "feat_name_partial": s.partial(an, bn),
        "feat_name_jw": s.jaro_winkler(an, bn), "feat_name_len_ratio": f"CASE WHEN {an} <> '' AND {bn} <> '' THEN least(length({an}), length({bn}))::DOUBLE / greatest(length({an}), length({bn})) ELSE 0.0::DOUBLE END",
        "feat_first_token_match": flag(f"{an} <> '' AND {bn} <> '' AND string_split({an}, ' ')[1] = string_split({bn}, ' ')[1]"),
        "feat_addr_ratio": s.ratio(aa, ba), "feat_addr_token_set": s.token_set(aa, ba), "feat_addr_jw": s.jaro_winkler(aa, ba),
        "feat_name_metaphone_match": same("meta_key"), "feat_name_soundex_match": same("soundex_key"), "feat_street_num_match": same("street_digits_str"), "feat_name_exact": flag(f"{an} = {bn}"),
        **{f"feat_{c}_exact": same(f"clean_{c}") for c in ("city", "state", "country")},
        "feat_country_mismatch": flag("a_clean_country <> '' AND b_clean_country <> '' AND a_clean_country <> b_clean_country"),
        **{f"feat_{c}_exact": same(f"clean_{c}") for c in ("zip", "phone")},
        "feat_phone_missing": flag("a_clean_phone = '' OR b_clean_phone = ''"), "feat_is_source2": flag("source = 'source2'"), "feat_blocking_tfidf_sim": "sim",
    }
    rounded = ", ".join(f"({x})::FLOAT AS {n}" for n, x in cols.items())
    return f"{CANDIDATES_B}, {keys}, {pairs}{s.ctes()}, ff AS MATERIALIZED (SELECT s1_id, candidate_id, source, {rounded} FROM fb {s.join()})", cols


FEATURES_B, _COLUMNS_B = _features_b()
FEAT_B23 = f"{FEATURES_B} SELECT s1_id, candidate_id, source, {', '.join(f'round({n}::DOUBLE, 5) AS {n}' for n in _COLUMNS_B)} FROM ff"
SINGLETON_FEATURES = f"""{FEATURES_B} SELECT k.id AS s1_id, {", ".join(f"round(coalesce(max({c})::DOUBLE, 0.0::DOUBLE), 5) AS {n}" for n, c in (("agg_max_tfidf", "feat_blocking_tfidf_sim"), ("agg_max_name_jw", "feat_name_jw"), ("agg_max_addr_jw", "feat_addr_jw"), ("agg_max_name_ratio", "feat_name_ratio"), ("agg_max_street_match", "feat_street_num_match")))},
count(ff.s1_id)::DOUBLE AS agg_cand_count FROM c k LEFT JOIN ff ON ff.s1_id = k.id WHERE k.source = 'source1' GROUP BY k.id"""
