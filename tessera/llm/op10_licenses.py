"""Licence scans by sentence rules, in native expressions only.

A text is cut into sentences, twice: at line ends and sentence ends, and at sentence ends and blank lines alone (for licence
texts that are wrapped). Normalised sentences (lower case, letters and digits, single blanks) are looked up as identifiers:
whole known sentences, a licence's title, or a grant phrase ("licensed under the ...") with a known licence name behind
it. The identifiers in text order form a sequence; a rule is an ordered list of identifiers that must occur in that
order, others between them allowed. A rule may give way to a more specific one. Sentences that official notices break by
colons or semicolons are known by their pieces too, as the cut leaves them. Only texts that hold one of the OPENINGS, of
which every known sentence and grant has one, are cut at all. One projection does it: no shuffle, no join.

Results: a row per document: licenses (sorted names joined by ", "; empty if none) and sentence_ids (of the reading
that found rules, joined by ","). Null and empty texts have none; repeated rows are treated alike; null ids are
carried; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.op10_oracle import ORACLE  # noqa: F401

# Public licence names, titles and sentences of their texts, and the order in which a licence has them.
NAMES = {
    "mit license": "MIT",
    "mit licence": "MIT",
    "apache license version 2 0": "Apache-2.0",
    "apache license version 2 0 the license": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "gnu general public license v2 0": "GPL-2.0",
    "gnu general public license v3 0": "GPL-3.0",
    "gnu gpl v2": "GPL-2.0",
    "gnu gpl v3": "GPL-3.0",
    "gnu lesser general public license version 2 1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license v 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "isc license": "ISC",
    "zlib license": "Zlib",
    "boost software license version 1 0": "BSL-1.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "eclipse public license v 2 0": "EPL-2.0",
    "cc0 1 0": "CC0-1.0",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "cc by nc nd 4 0": "CC-BY-NC-ND-4.0",
    "creative commons attribution 4 0 international license": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0",
}
#: What stands alone above a licence's whole text.
TITLES = {
    "apache license version 2 0 january 2004 http www apache org licenses": "Apache-2.0",
    "gnu general public license version 2 june 1991": "GPL-2.0",
    "gnu general public license version 3 29 june 2007": "GPL-3.0",
    "gnu lesser general public license version 2 1 february 1999": "LGPL-2.1",
    "gnu lesser general public license version 3 29 june 2007": "LGPL-3.0",
    "gnu affero general public license version 3 19 november 2007": "AGPL-3.0",
    "mozilla public license version 2 0": "MPL-2.0",
    "boost software license version 1 0 august 17th 2003": "BSL-1.0",
    "eclipse public license v 2 0": "EPL-2.0",
    "cc0 1 0 universal": "CC0-1.0",
    "creative commons attribution 4 0 international public license": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international public license": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international public license": "CC-BY-NC-4.0",
}
SENTENCES = {
    "all rights reserved": "rights-reserved",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "http www apache org licenses license 2 0": "apache-url",
    "https www apache org licenses license 2 0": "apache-url",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mozilla-form",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "this work is dedicated to the public domain": "public-domain",
    "this software is in the public domain": "public-domain",
}
#: Licences of the GNU notice: name and version in it.
GNU = {
    "GPL-2.0": ("gnu general public license", "2"),
    "GPL-3.0": ("gnu general public license", "3"),
    "LGPL-2.1": ("gnu lesser general public license", "2 1"),
    "LGPL-3.0": ("gnu lesser general public license", "3"),
    "AGPL-3.0": ("gnu affero general public license", "3"),
}
#: Rules: a licence's name and the identifiers that a text has in this order.
RULES = [
    *((name, (f"name:{name}",)) for name in sorted(set(NAMES.values()))),
    *((name, (f"title:{name}",)) for name in sorted(set(TITLES.values()))),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-title", "mit-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("ISC", ("isc-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-grant",)),
    ("Apache-2.0", ("apache-comply", "apache-copy", "apache-url")),
    ("MPL-2.0", ("mozilla-form",)),
    ("Unlicense", ("unlicense-grant",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("rights-reserved",)),
]
for _license, (_name, _version) in GNU.items():
    _terms = f"you can redistribute it and or modify it under the terms of the {_name} as published by the free software foundation"
    _either = f"either version {_version} of the license or at your option any later version"
    _kind, _short, _any = _name.split()[1], _license.lower(), f"gnu-either-{_version.replace(' ', '.')}"
    for _what in ("program", "library", "software", "file"):
        _free = f"this {_what} is free software"
        SENTENCES |= {_free: "gnu-free", f"{_free} {_terms}": f"{_kind}-free-terms", f"{_free} {_terms} {_either}": f"{_short}-grant"}
    SENTENCES |= {_terms: f"{_kind}-terms", _either: _any, f"{_terms} {_either}": f"{_short}-terms-either"}
    NAMES |= {f"{_short.replace('-', ' ').replace('.', ' ')} {x}": _license for x in ("only", "or later")}
    RULES += [(_license, x) for x in ((f"{_short}-grant",), ("gnu-free", f"{_short}-terms-either"), ("gnu-free", f"{_kind}-terms", _any), (f"{_kind}-free-terms", _any))]
#: A licence gives way where the other is found too.
YIELDS = {"BSD-2-Clause": ("BSD-3-Clause",)}
GRANT = r"^(?:spdx license identifier |(?:this (?:work|software|program|project|file|document|code|content|text|page) is |it is |content is )?(?:dual )?(?:licensed|released|distributed|published|available|made available|provided) under (?:the )?(?:terms of )?(?:the )?)(.+)$"
SPDX = {k.lower().replace("-", " ").replace(".", " "): k for k in sorted(set(NAMES.values()))}
#: Between words of a known sentence anything may stand that isn't a letter or digit.
OPENINGS = "licen[cs]e|rights[^a-z0-9]+reserved|permission|redistribut|warrant|public[^a-z0-9]+domain|free[^a-z0-9]+software|(?:released|distributed|published|available|provided)[^a-z0-9]+under|version[^a-z0-9]+[0-9]|cc0"
#: Where sentences end; a tag's name stays with its value, and "v." with its number.
KEPT = r"(?<!spdx-license-identifier)(?<!\bv)"
ENDS = rf"{KEPT}[.!?;:]*[ \t\r]*\n|{KEPT}[.!?;:]+[ \t\r]+", rf"{KEPT}[.!?;:]+[ \t\r\n]+|[ \t\r]*\n[ \t\r]*\n[ \t\r\n]*"


def _pattern(ids: tuple[str, ...]) -> str:
    """A rule as a pattern over ",id,id,"."""
    return "," + ",(?:[^,]+,)*".join(i.replace(".", "[.]") for i in ids) + ","


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _sequence(cut: str) -> Column:
    sentences = _map({**{k: f"title:{v}" for k, v in TITLES.items()}, **SENTENCES})
    names = _map({k: f"name:{v}" for k, v in {**SPDX, **NAMES}.items()})

    def name(s: Column) -> Column:
        plain = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
        return F.coalesce(F.try_element_at(sentences, plain), F.try_element_at(names, F.regexp_extract(plain, GRANT, 1)))

    ids = F.filter(F.transform(F.split(F.lower("text"), cut), name), lambda x: x.isNotNull())
    return F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))


def _licenses(seq: Column) -> Column:
    found: dict[str, list[str]] = {}
    for license_, ids in RULES:
        found.setdefault(license_, []).append(_pattern(ids))
    holds = {k: seq.rlike("|".join(v)) for k, v in found.items()}
    cases = []
    for k in sorted(holds):
        hit = holds[k]
        for other in YIELDS.get(k, ()):
            hit = hit & ~holds[other]
        cases.append(F.when(hit, F.lit(k)))
    return F.array_join(F.array_compact(F.array(*cases)), ", ")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, licenses, sentence_ids) of documents (doc_id, text)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    some = F.lower("text").rlike(OPENINGS)
    read = rows.select("doc_id", F.when(some, _sequence(ENDS[0])).alias("s1"), F.when(some, _sequence(ENDS[1])).alias("s2"))
    both = read.select("doc_id", "s1", "s2", F.coalesce(_licenses(F.col("s1")), F.lit("")).alias("l1"), F.coalesce(_licenses(F.col("s2")), F.lit("")).alias("l2"))
    first = F.length("l1") >= F.length("l2")
    ids = F.regexp_replace(F.coalesce(F.when(first, F.col("s1")).otherwise(F.col("s2")), F.lit("")), "^,+|,+$", "")
    return both.select("doc_id", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("licenses"), ids.alias("sentence_ids"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
