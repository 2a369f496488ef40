"""Text functions as native column expressions: cleaning, affixes, addresses, phonetic and structural keys."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters and words that results depend on.
MARKS = "<>{}[]()-_.,;:!?'\"/\\|*~@#$%^&=+`"
LEET = [("0", "o"), ("1", "l"), ("3", "e"), ("5", "s")]
NAME_PREFIXES = (
    "dr shree sri om ms hotel the saint st maison atelier ste boulangerie patisserie pharmacie cabinet garage "
    "boutique agence auto restaurant bar"
).split()
NAME_SUFFIXES = [
    *"inc incorporated corp corporation llc ltd limited co company gmbh sarl sas sasu sa sci eurl snc gie cie societe pvt".split(),
    *"private group holdings services solutions enterprises technologies associates partners international intl dba".split(),
    *"fils freres".split(),
    "et fils",
    "et cie",
]
ADDRESS_WORDS = [
    (["r", "rue"], "rue"),
    (["av", "ave", "avenue"], "ave"),
    (["bd", "blvd", "boulevard"], "blvd"),
    (["all", "allee", "allée"], "allee"),
    (["pl", "place"], "place"),
    (["no", "n°"], ""),
    (["street", "saint"], "st"),
    (["road"], "rd"),
    (["drive"], "dr"),
    (["lane"], "ln"),
    (["suite", "ste", "shop no", "shop", "fl", "floor"], "ste"),
    (["highway", "hwy"], "hwy"),
    (["apartment", "apt"], "apt"),
    (["sector", "sec"], "sec"),
]
ADDRESS_FILLERS = (
    "st rd dr ln ave blvd ste apt hwy unit floor fl plot sec sector near opp behind nagar colony road street marg "
    "bordeaux paris lille lyon mumbai delhi bangalore hyderabad chennai"
).split()
COUNTRIES = [
    (["united states", "usa", "u s a", "america"], "us"),
    (["united kingdom", "great britain", "uk", "england"], "gb"),
    (["india", "ind"], "in"),
    (["france", "republique francaise", "republique"], "fr"),
]
UNIT_WORDS = "ste suite unit flat office fl floor plot shop bldg".split()
LEGAL_SUFFIXES = [
    "incorporated", "inc", "limited liability company", "llc", "llp", "limited", "ltd", "corporation", "corp", "gmbh", "ag", "sarl", "sas", "sa",
    "pvt", "private", "co", "company",
]
STREET_WORDS = [
    ("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("road", "rd"), ("drive", "dr"), ("lane", "ln"), ("suite", "ste"),
    ("apartment", "apt"), ("building", "bldg"), ("floor", "fl"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
]
SOUNDEX_FROM, SOUNDEX_TO = "abcdefghijklmnopqrstuvwxyz", "01230120022455012623010202"


def words(alternatives: list[str], group: bool = False) -> str:
    """A pattern of whole words, Unicode-aware."""
    body = "|".join(alternatives)
    return rf"(?U)\b({body})\b" if group else rf"(?U)\b(?:{body})\b"


def _tidy(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _filled(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


# Keys of the first engine


def clean_text(x: Column) -> Column:
    """Lower case, marks to blanks, blanks collapsed; accents stay; null is empty."""
    return _tidy(F.translate(F.lower(_filled(x)), MARKS, " " * len(MARKS)))


def leet(cleaned: Column) -> Column:
    """Digits that stand for a letter inside a word of letters, and initial ph, on cleaned text."""
    out = cleaned
    for digit, letter in LEET:
        out = F.regexp_replace(out, rf"(?U)(\b[a-z]+){digit}([a-z]+\b)", f"$1{letter}$2")
    return F.regexp_replace(out, r"(?U)\bph", "f")


def strip_affixes(leeted: Column) -> Column:
    """A name without one leading title and without legal words anywhere."""
    out = F.regexp_replace(leeted, rf"(?U)^(?:{'|'.join(NAME_PREFIXES)})\s+", "")
    return _tidy(F.regexp_replace(out, words(NAME_SUFFIXES), " "))


def sorted_tokens(x: Column) -> Column:
    return F.array_join(F.array_sort(F.split(x, " ")), " ")


def acronym(root: Column) -> Column:
    return F.array_join(F.transform(F.split(root, " "), lambda t: F.substring(t, 1, 1)), "")


def nth_word(root: Column, n: int) -> Column:
    return F.coalesce(F.try_element_at(F.split(root, " "), F.lit(n)), F.lit(""))


def standard_address(cleaned: Column) -> Column:
    out = reduce(lambda x, pair: F.regexp_replace(x, words(pair[0]), pair[1]), ADDRESS_WORDS, cleaned)
    return _tidy(out)


def address_core(standard: Column) -> Column:
    return _tidy(F.regexp_replace(standard, words(ADDRESS_FILLERS), " "))


def standard_country(cleaned: Column) -> Column:
    return F.trim(reduce(lambda x, pair: F.regexp_replace(x, words(pair[0]), pair[1]), COUNTRIES, cleaned))


def first_digits(address: Column) -> Column:
    return F.regexp_extract(_filled(address), r"(?U)(\d+)", 1)


def postal_code(address: Column) -> Column:
    return F.regexp_extract(_filled(address), r"(?U)\b(\d{5,6})\b", 1)


def unit_code(cleaned: Column) -> Column:
    return F.regexp_extract(cleaned, rf"(?U)\b(?:{'|'.join(UNIT_WORDS)})\s*(\d+)\b", 1)


def letter_code(word: Column) -> Column:
    """First letter and up to three digits of differing neighbours; anything that has no digit separates."""
    w = F.lower(word)
    digits = F.translate(F.regexp_replace(w, "[^a-z]", "0"), SOUNDEX_FROM, SOUNDEX_TO)
    digits = F.regexp_replace(F.regexp_replace(digits, r"(.)\1+", "$1"), "^.", "")
    code = F.rpad(F.substring(F.regexp_replace(digits, "0", ""), 1, 3), 3, "0")
    return F.when(w.rlike("^[a-z]"), F.concat(F.substring(w, 1, 1), code)).otherwise(F.lit(""))


def consonants(word: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(word), "[^b-df-hj-np-tv-z]", ""), 1, 3)


def sorted_letters(root: Column) -> Column:
    """The first four letters, sorted; empty below three."""
    c = F.regexp_replace(F.lower(root), "[^a-z]", "")
    return F.when((F.length(root) < 3) | (F.length(c) < 3), F.lit("")).otherwise(F.array_join(F.array_sort(F.split(F.substring(c, 1, 4), "")), ""))


# Keys of the second engine


@F.pandas_udf(StringType())
def strip_accents(x: pd.Series) -> pd.Series:
    """Canonical decomposition without non-spacing marks. Spark has no normaliser, so this one runs in Arrow batches."""

    def bare(s):
        if s is None or s.isascii():
            return s or ""
        return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")

    return x.map(bare, na_action=None)


def clean_field(x: Column, accents: bool = True) -> Column:
    """Lower case without accents, signs to blanks, blanks collapsed. accents=False: the text is known to have none."""
    low = F.lower(_filled(x))
    low = strip_accents(low) if accents else low
    return _tidy(F.regexp_replace(low, r"[^\p{L}\p{N}_\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]", " "))


def clean_name(field: Column) -> Column:
    return _tidy(F.regexp_replace(field, words(LEGAL_SUFFIXES), ""))


def clean_address(field: Column) -> Column:
    return _tidy(reduce(lambda x, pair: F.regexp_replace(x, words([pair[0]]), pair[1]), STREET_WORDS, field))


def clean_phone(x: Column) -> Column:
    d = F.regexp_replace(_filled(x), r"(?U)\D", "")
    return F.when(F.length(d) >= 10, F.substring(d, -10, 10)).otherwise(d)


def clean_zip(x: Column) -> Column:
    return F.regexp_replace(_filled(x), r"(?U)\D", "")


def full_address(address: Column, city: Column, state: Column, zip_: Column) -> Column:
    """Joined by single blanks, trimmed at the ends only."""
    return F.trim(F.concat(address, F.lit(" "), city, F.lit(" "), state, F.lit(" "), zip_))


def all_digits(address: Column) -> Column:
    return F.array_join(F.regexp_extract_all(address, F.lit(r"(?U)\b(\d+)\b"), 1), " ")


def first_two_tokens(name: Column) -> Column:
    return F.array_join(F.slice(F.filter(F.split(name, " "), lambda t: F.length(t) > 1), 1, 2), " ")


def standard_soundex(name: Column) -> Column:
    """Soundex of the first 25 characters; empty where there is none."""
    s = F.substring(name, 1, 25)
    return F.when(s == "", F.lit("")).otherwise(F.soundex(s))


def metaphone(word: str) -> str:
    """Philips' Metaphone (1990) of a text, letter by letter; what is no letter is passed over."""
    s = "".join(c for c in word.upper() if "A" <= c <= "Z" or c == " ")
    out = []
    for w in s.split():
        if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
            w = w[1:]
        elif w[:1] == "X":
            w = "S" + w[1:]
        elif w[:2] == "WH":
            w = "W" + w[2:]
        n, i = len(w), 0
        while i < n:
            c, before, after = w[i], w[i - 1] if i else "", w[i + 1] if i + 1 < n else ""
            if c == before and c != "C":
                i += 1
                continue
            code = ""
            if c in "AEIOU":
                code = c if i == 0 else ""
            elif c == "B":
                code = "" if i == n - 1 and before == "M" else "B"
            elif c == "C":
                if after == "H":
                    code, i = ("K" if before == "S" else "X"), i + 1
                elif w[i : i + 3] == "CIA":
                    code = "X"
                elif after and after in "IEY":
                    code = "" if before == "S" else "S"
                else:
                    code = "K"
            elif c == "D":
                if after == "G" and w[i + 2 : i + 3] in ("E", "Y", "I"):
                    code, i = "J", i + 1
                else:
                    code = "T"
            elif c == "G":
                if after == "H":
                    if i + 2 < n and w[i + 2] not in "AEIOU":
                        code, i = "", i + 1
                    elif i and i + 2 >= n:
                        code, i = "", i + 1
                    else:
                        code, i = "K", i + 1
                elif after == "N" and (i + 2 == n or w[i + 1 :] == "NED"):
                    code = ""
                elif after and after in "EIY":
                    code = "J"
                else:
                    code = "K"
            elif c == "H":
                code = "H" if after and after in "AEIOU" and before not in ("C", "S", "P", "T", "G") else ""
            elif c == "K":
                code = "" if before == "C" else "K"
            elif c == "P":
                if after == "H":
                    code, i = "F", i + 1
                else:
                    code = "P"
            elif c == "Q":
                code = "K"
            elif c == "S":
                if after == "H":
                    code, i = "X", i + 1
                elif w[i : i + 3] in ("SIO", "SIA"):
                    code = "X"
                else:
                    code = "S"
            elif c == "T":
                if w[i : i + 3] in ("TIA", "TIO"):
                    code = "X"
                elif after == "H":
                    code, i = "0", i + 1
                elif w[i : i + 3] == "TCH":
                    code = ""
                else:
                    code = "T"
            elif c == "V":
                code = "F"
            elif c in "WY":
                code = c if after and after in "AEIOU" else ""
            elif c == "X":
                code = "KS"
            elif c == "Z":
                code = "S"
            else:
                code = c
            out.append(code)
            i += 1
    return "".join(out)


@F.pandas_udf(StringType())
def metaphone_key(name: pd.Series) -> pd.Series:
    return name.map(lambda s: metaphone(s[:25]) if s else "", na_action=None)
