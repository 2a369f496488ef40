import random
import re

import duckdb
import pytest

from tessera.llm import op10_licenses as op

MIT = """The MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
"""
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nRedistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
BSD3 = BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
CASES = [
    (None, ""),
    ("", ""),
    ("no terms here", ""),
    ("Some words.\nReleased under the MIT License.\nmore", "MIT"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", "All-Rights-Reserved, GPL-3.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("SPDX-License-Identifier: BSD-3-Clause\n", "BSD-3-Clause"),
    ("I like the MIT License.", ""),
    (MIT, "MIT"),
    ("\n".join(reversed(MIT.split("\n\n"))), ""),
    (BSD, "BSD-2-Clause"),
    (BSD3, "BSD-3-Clause"),
    ("word " * 50000 + ". Licensed under CC BY 4.0. end", "CC-BY-4.0"),
]


def test_cases(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(None, CASES[3][0], "x")] * 2
    out = op.scan(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()
    assert sorted([(r.doc_id, r.licenses) for r in out], key=str) == sorted([*((i, x) for i, (_, x) in enumerate(CASES)), (None, "MIT"), (None, "MIT")], key=str)


def test_empty(spark):
    assert op.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_openings_cover_every_sentence():
    assert all(re.search(op.OPENINGS, s) for s in {**op.SENTENCES, **op.TITLES})
    assert all(re.search(op.OPENINGS, f"{v} under {s}") for s in op.NAMES for v in ("licensed", "released", "distributed", "published", "available", "provided"))


def test_every_identifier_is_in_a_rule():
    used = {i for _, ids in op.RULES for i in ids}
    assert set(op.SENTENCES.values()) <= used and {f"title:{x}" for x in op.TITLES.values()} <= used


def test_no_python_in_plan(spark):
    plan = op.op10_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def by_sql(path):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return sorted(c.execute(op.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_oracle(spark, sf):
    d = f"/root/testdata/{sf}"
    got = sorted([tuple(r) for r in op.op10_license_scan(spark, d).collect()], key=str)
    assert got == by_sql(f"{d}/documents.parquet") and any(x[1] for x in got)


def test_oracle_on_texts_made_for_it(spark, tmp_path):
    """Every grant, notice, title and whole text of this module, alone, reversed, and several in one document."""
    r = random.Random(0)
    texts = [*grants(), *notices(), *TEXTS, *(t for t, _ in CASES)]
    texts += ["\n".join(reversed((t or "").split("\n"))) for t in texts] + ["\n\n".join(x or "" for x in r.sample(texts, 3)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/d")
    assert sorted([tuple(x) for x in op.scan(df).collect()], key=str) == by_sql(f"{tmp_path}/d/*.parquet")


def licenses(spark, texts):
    return {t: x for t, x in spark_rows(spark, texts)}


def spark_rows(spark, texts):
    out = op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [(texts[r.doc_id], r.licenses) for r in out]


def grants():
    names = {**op.NAMES, **op.SPDX}
    verbs = ["licensed", "released", "distributed", "published", "available", "made available", "provided"]
    want = {f"This work is {v} under {n}.": k for v in verbs for n, k in names.items()}
    want |= {"Published\nunder CC0 1.0.": "CC0-1.0", "This software is distributed under the terms of the GNU GPL v3.": "GPL-3.0"}
    want |= {"This work is dedicated to the public\ndomain.": "Public-Domain", "All rights  reserved.": "All-Rights-Reserved", "This is free and unencumbered software released into the public\ndomain.": "Unlicense"}
    return want


def test_every_grant_with_every_name(spark):
    assert licenses(spark, list(grants())) == grants()


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
APACHE = """Copyright 2020 A. Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
"""


def notices():
    want = {GPL.format(a, b, v): f"GPL-{v}.0" for a in ";:," for b in ";:," for v in "23"}
    lesser = GPL.replace("This program is free", "This library is free").replace("GNU General", "GNU Lesser General")
    want |= {lesser.format(";", ";", "2.1"): "LGPL-2.1", lesser.format(":", ",", "3"): "LGPL-3.0", GPL.replace("GNU General", "GNU Affero General").format(":", ",", "3"): "AGPL-3.0"}
    want |= {APACHE: "Apache-2.0", "\n".join("# " + x for x in APACHE.split("\n")): "Apache-2.0", APACHE.replace('(the "License")', ""): "Apache-2.0"}
    want |= {f"{c}SPDX-License-Identifier: {k}\ncode": k for c in ("", "// ", "# ") for k in op.SPDX.values()}
    want |= {"SPDX-License-Identifier: GPL-2.0-or-later\n": "GPL-2.0", "Note: licensed under MIT; see there.": "MIT"}
    want |= {MPL: "MPL-2.0", "\n".join(" * " + x for x in MPL.split("\n")): "MPL-2.0", "Licensed under the Mozilla Public License, v. 2.0.": "MPL-2.0"}
    return want


def test_official_notices(spark):
    assert licenses(spark, list(notices())) == notices()


MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
HOLDER = "Copyright (c) 2020 A. Author\n\n"
#: Whole public texts, or the heads of those that are long.
TEXTS = {
    "MIT License\n\n" + HOLDER + MIT.split("\n", 2)[2] + "\n" + WARRANTY: "MIT",
    "The MIT License (MIT)\n\n" + HOLDER + MIT.split("\n", 2)[2] + "\n" + WARRANTY: "MIT",
    """BSD 3-Clause License

Copyright (c) 2020, A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
""": "BSD-3-Clause",
    """ISC License

Copyright 2020 A. Author

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
""": "ISC",
    """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software.
""": "Zlib",
    """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
""": "Unlicense",
    """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
""": "Apache-2.0",
    """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
""": "GPL-3.0",
    """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.,
""": "GPL-2.0",
    "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007": "LGPL-3.0",
    "                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright": "AGPL-3.0",
    "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n": "MPL-2.0",
    "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS": "EPL-2.0",
    "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION": "CC0-1.0",
    """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
""": "BSL-1.0",
}


def test_public_texts(spark):
    assert licenses(spark, list(TEXTS)) == TEXTS


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY 4.0.", "x", "y", "z")], "doc_id long, text string, s1 string, l1 string, sentence_ids string")
    assert [tuple(r) for r in op.scan(df).collect()] == [(1, "CC-BY-4.0", "name:CC-BY-4.0")]
