"""What the licence scan should find, in SQL of its own: tables of sentences and rules, matched by joins on positions.

It shares no pattern, table or code with the scan. Its sentence table is written out as rows; its grant phrases are the
products of the parts they consist of, and are looked up whole; rules are matched step by step by the least position
behind the step before.
"""

# Public licence names, titles, sentences and the order in which a licence has them.
_NAMES = """
VALUES ('mit', 'MIT'), ('mit license', 'MIT'), ('mit licence', 'MIT'), ('apache 2 0', 'Apache-2.0'), ('apache license version 2 0', 'Apache-2.0'),
('apache license version 2 0 the license', 'Apache-2.0'), ('apache license 2 0', 'Apache-2.0'), ('apache 2 0 license', 'Apache-2.0'),
('gnu general public license version 2', 'GPL-2.0'), ('gnu general public license v2 0', 'GPL-2.0'), ('gnu gpl v2', 'GPL-2.0'), ('gpl 2 0', 'GPL-2.0'),
('gnu general public license version 3', 'GPL-3.0'), ('gnu general public license v3 0', 'GPL-3.0'), ('gnu gpl v3', 'GPL-3.0'), ('gpl 3 0', 'GPL-3.0'),
('gnu lesser general public license version 2 1', 'LGPL-2.1'), ('lgpl 2 1', 'LGPL-2.1'), ('gnu lesser general public license version 3', 'LGPL-3.0'),
('lgpl 3 0', 'LGPL-3.0'), ('gnu affero general public license version 3', 'AGPL-3.0'), ('agpl 3 0', 'AGPL-3.0'),
('gpl 2 0 only', 'GPL-2.0'), ('gpl 2 0 or later', 'GPL-2.0'), ('gpl 3 0 only', 'GPL-3.0'), ('gpl 3 0 or later', 'GPL-3.0'),
('lgpl 2 1 only', 'LGPL-2.1'), ('lgpl 2 1 or later', 'LGPL-2.1'), ('lgpl 3 0 only', 'LGPL-3.0'), ('lgpl 3 0 or later', 'LGPL-3.0'),
('agpl 3 0 only', 'AGPL-3.0'), ('agpl 3 0 or later', 'AGPL-3.0'),
('mozilla public license version 2 0', 'MPL-2.0'), ('mozilla public license v 2 0', 'MPL-2.0'), ('mozilla public license 2 0', 'MPL-2.0'), ('mpl 2 0', 'MPL-2.0'),
('bsd 2 clause license', 'BSD-2-Clause'), ('bsd 2 clause', 'BSD-2-Clause'), ('bsd 3 clause license', 'BSD-3-Clause'), ('bsd 3 clause', 'BSD-3-Clause'),
('isc license', 'ISC'), ('isc', 'ISC'), ('zlib license', 'Zlib'), ('zlib', 'Zlib'), ('boost software license version 1 0', 'BSL-1.0'), ('bsl 1 0', 'BSL-1.0'),
('eclipse public license version 2 0', 'EPL-2.0'), ('eclipse public license v 2 0', 'EPL-2.0'), ('epl 2 0', 'EPL-2.0'), ('cc0 1 0', 'CC0-1.0'),
('cc by 4 0', 'CC-BY-4.0'), ('cc by sa 4 0', 'CC-BY-SA-4.0'), ('cc by nc 4 0', 'CC-BY-NC-4.0'), ('cc by nd 4 0', 'CC-BY-ND-4.0'),
('cc by nc sa 4 0', 'CC-BY-NC-SA-4.0'), ('cc by nc nd 4 0', 'CC-BY-NC-ND-4.0'),
('creative commons attribution 4 0 international license', 'CC-BY-4.0'), ('creative commons attribution sharealike 4 0 international license', 'CC-BY-SA-4.0'),
('creative commons attribution noncommercial 4 0 international license', 'CC-BY-NC-4.0')
"""
_KNOWN = """
VALUES ('apache license version 2 0 january 2004 http www apache org licenses', 'title:Apache-2.0'),
('gnu general public license version 2 june 1991', 'title:GPL-2.0'), ('gnu general public license version 3 29 june 2007', 'title:GPL-3.0'),
('gnu lesser general public license version 2 1 february 1999', 'title:LGPL-2.1'), ('gnu lesser general public license version 3 29 june 2007', 'title:LGPL-3.0'),
('gnu affero general public license version 3 19 november 2007', 'title:AGPL-3.0'), ('mozilla public license version 2 0', 'title:MPL-2.0'),
('boost software license version 1 0 august 17th 2003', 'title:BSL-1.0'), ('eclipse public license v 2 0', 'title:EPL-2.0'), ('cc0 1 0 universal', 'title:CC0-1.0'),
('creative commons attribution 4 0 international public license', 'title:CC-BY-4.0'),
('creative commons attribution sharealike 4 0 international public license', 'title:CC-BY-SA-4.0'),
('creative commons attribution noncommercial 4 0 international public license', 'title:CC-BY-NC-4.0'),
('all rights reserved', 'rights-reserved'), ('the mit license', 'mit-title'),
('permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions', 'mit-grant'),
('the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software', 'mit-notice'),
('the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement', 'mit-warranty'),
('redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met', 'bsd-grant'),
('redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer', 'bsd-source'),
('redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution', 'bsd-binary'),
('neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission', 'bsd-endorse'),
('permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies', 'isc-grant'),
('permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions', 'zlib-grant'),
('permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following', 'boost-grant'),
('you may not use this file except in compliance with the license', 'apache-comply'), ('you may obtain a copy of the license at', 'apache-copy'),
('http www apache org licenses license 2 0', 'apache-url'), ('https www apache org licenses license 2 0', 'apache-url'),
('this source code form is subject to the terms of the mozilla public license v 2 0', 'mozilla-form'),
('this is free and unencumbered software released into the public domain', 'unlicense-grant'),
('this work is dedicated to the public domain', 'public-domain'), ('this software is in the public domain', 'public-domain')
"""
_GNU = """
VALUES ('GPL-2.0', 'general', 'gnu general public license', '2', '2'), ('GPL-3.0', 'general', 'gnu general public license', '3', '3'),
('LGPL-2.1', 'lesser', 'gnu lesser general public license', '2 1', '2.1'), ('LGPL-3.0', 'lesser', 'gnu lesser general public license', '3', '3'),
('AGPL-3.0', 'affero', 'gnu affero general public license', '3', '3')
"""
_RULES = """
VALUES ('MIT', 'm1', 1, 'mit-grant'), ('MIT', 'm1', 2, 'mit-notice'), ('MIT', 'm2', 1, 'mit-title'), ('MIT', 'm2', 2, 'mit-warranty'),
('BSD-2-Clause', 'b2', 1, 'bsd-grant'), ('BSD-2-Clause', 'b2', 2, 'bsd-source'), ('BSD-2-Clause', 'b2', 3, 'bsd-binary'),
('BSD-3-Clause', 'b3', 1, 'bsd-grant'), ('BSD-3-Clause', 'b3', 2, 'bsd-source'), ('BSD-3-Clause', 'b3', 3, 'bsd-binary'), ('BSD-3-Clause', 'b3', 4, 'bsd-endorse'),
('ISC', 'i', 1, 'isc-grant'), ('Zlib', 'z', 1, 'zlib-grant'), ('BSL-1.0', 'l', 1, 'boost-grant'),
('Apache-2.0', 'a', 1, 'apache-comply'), ('Apache-2.0', 'a', 2, 'apache-copy'), ('Apache-2.0', 'a', 3, 'apache-url'), ('MPL-2.0', 'p', 1, 'mozilla-form'),
('Unlicense', 'u', 1, 'unlicense-grant'), ('Public-Domain', 'd', 1, 'public-domain'), ('All-Rights-Reserved', 'r', 1, 'rights-reserved')
"""
_STEPS = "".join(
    f", s{n} AS (SELECT s.reading, s.r, s.license, s.rule, min(f.i) AS i FROM s{n - 1} s JOIN rules u ON u.rule = s.rule AND u.step = {n} JOIN found f ON f.reading = s.reading AND f.r = s.r AND f.id = u.id AND f.i > s.i GROUP BY ALL)"
    for n in (2, 3, 4)
)
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, replace(regexp_replace(lower(text), '\\bv\\.', 'v', 'g'), 'spdx-license-identifier:', 'spdx-license-identifier') AS t FROM documents),
names(name, license) AS ({_NAMES}), gnu(license, kind, name, version, short) AS ({_GNU}),
opening(p) AS (SELECT a.x || b.x || c.x || ' under ' || e.x || f.x || g.x FROM
  (VALUES (''), ('it is '), ('content is '), ('this work is '), ('this software is '), ('this program is '), ('this project is '), ('this file is '), ('this document is '), ('this code is '), ('this content is '), ('this text is '), ('this page is ')) a(x),
  (VALUES (''), ('dual ')) b(x), (VALUES ('licensed'), ('released'), ('distributed'), ('published'), ('available'), ('made available'), ('provided')) c(x),
  (VALUES (''), ('the ')) e(x), (VALUES (''), ('terms of ')) f(x), (VALUES (''), ('the ')) g(x)
  UNION ALL SELECT 'spdx license identifier '),
free AS (SELECT gnu.*, 'this ' || w.x || ' is free software' AS free, 'you can redistribute it and or modify it under the terms of the ' || name || ' as published by the free software foundation' AS terms,
  'either version ' || version || ' of the license or at your option any later version' AS either FROM gnu, (VALUES ('program'), ('library'), ('software'), ('file')) w(x)),
known AS (SELECT DISTINCT * FROM (SELECT p || name AS s, 'name:' || license AS id FROM opening, names UNION ALL SELECT * FROM ({_KNOWN}) x(s, id)
  UNION ALL SELECT free, 'gnu-free' FROM free UNION ALL SELECT free || ' ' || terms, kind || '-free-terms' FROM free UNION ALL SELECT free || ' ' || terms || ' ' || either, lower(license) || '-grant' FROM free
  UNION ALL SELECT terms, kind || '-terms' FROM free UNION ALL SELECT either, 'gnu-either-' || short FROM free UNION ALL SELECT terms || ' ' || either, lower(license) || '-terms-either' FROM free)),
rules(license, rule, step, id) AS (SELECT * FROM ({_RULES})
  UNION ALL SELECT DISTINCT license, 'n' || license, 1, 'name:' || license FROM names
  UNION ALL SELECT DISTINCT substr(id, 7), 't' || id, 1, id FROM known WHERE id LIKE 'title:%'
  UNION ALL SELECT license, 'g1' || license, 1, lower(license) || '-grant' FROM gnu
  UNION ALL SELECT license, 'g2' || license, 1, 'gnu-free' FROM gnu UNION ALL SELECT license, 'g2' || license, 2, lower(license) || '-terms-either' FROM gnu
  UNION ALL SELECT license, 'g3' || license, 1, 'gnu-free' FROM gnu UNION ALL SELECT license, 'g3' || license, 2, kind || '-terms' FROM gnu UNION ALL SELECT license, 'g3' || license, 3, 'gnu-either-' || short FROM gnu
  UNION ALL SELECT license, 'g4' || license, 1, kind || '-free-terms' FROM gnu UNION ALL SELECT license, 'g4' || license, 2, 'gnu-either-' || short FROM gnu),
lines AS (SELECT r, unnest(a) AS line, unnest(range(len(a))) AS i FROM (SELECT r, string_split(t, chr(10)) AS a FROM d)),
paragraphs AS (SELECT r, unnest(a) AS part, unnest(range(len(a))) AS i FROM (SELECT r, string_split_regex(t, '\\n[ \\t\\r]*\\n') AS a FROM d)),
pieces AS (SELECT 1 AS reading, r, i, unnest(a) AS piece, unnest(range(len(a))) AS j FROM (SELECT r, i, string_split_regex(line, '[.!?;:]+[ \\t\\r]+') AS a FROM lines)
  UNION ALL SELECT 2, r, i, unnest(a), unnest(range(len(a))) FROM (SELECT r, i, string_split_regex(part, '[.!?;:]+[ \\t\\r\\n]+') AS a FROM paragraphs)),
found AS (SELECT reading, r, id, row_number() OVER (PARTITION BY reading, r ORDER BY i, j) AS i FROM pieces JOIN known ON s = trim(regexp_replace(piece, '[^a-z0-9]+', ' ', 'g'))),
s1 AS (SELECT f.reading, f.r, u.license, u.rule, min(f.i) AS i FROM found f JOIN rules u ON u.step = 1 AND u.id = f.id GROUP BY ALL){_STEPS},
last AS (SELECT rule, max(step) AS n FROM rules GROUP BY rule),
held AS (SELECT DISTINCT reading, r, license FROM (SELECT *, 1 AS n FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3 UNION ALL SELECT *, 4 FROM s4) JOIN last USING (rule, n)),
best AS (SELECT reading, r, string_agg(license, ', ' ORDER BY license) AS licenses FROM held h
  WHERE NOT (license = 'BSD-2-Clause' AND EXISTS (SELECT 1 FROM held o WHERE o.reading = h.reading AND o.r = h.r AND o.license = 'BSD-3-Clause')) GROUP BY reading, r),
ids AS (SELECT reading, r, string_agg(id, ',' ORDER BY i) AS ids FROM found GROUP BY reading, r),
choice AS (SELECT r, doc_id, CASE WHEN length(coalesce((SELECT licenses FROM best b WHERE b.r = d.r AND reading = 1), '')) >= length(coalesce((SELECT licenses FROM best b WHERE b.r = d.r AND reading = 2), '')) THEN 1 ELSE 2 END AS reading FROM d)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(ids, '') AS sentence_ids FROM choice LEFT JOIN best USING (r, reading) LEFT JOIN ids USING (r, reading)
"""
