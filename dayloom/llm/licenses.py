"""Licence scan by sentence rules: known sentences become identifiers, identifier runs become licences.

A text is cut into parts, each is normalised to lower-case letters and digits with single spaces,
and a known sentence is a part or consecutive parts: it may itself hold what cuts a text ("v. 2.0",
a line that opens as another sentence).  The identifiers found, in order, are then matched against ordered rules;
a rule takes the identifiers it covers, so a longer rule before a shorter one wins.
All of it is column expressions over the row's own text; nothing is shuffled.
"""

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dayloom.llm.common import table

# Licence sentences as published, and the identifier of each.
SENTENCES = {
    "ApacheUnder": "Licensed under the Apache License, Version 2.0.",
    "ApacheHead": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "ApacheCopy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "ApacheBasis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "ApacheSee": "See the License for the specific language governing permissions and limitations under the License.",
    "MITTitle": "MIT License",
    "MITTitleThe": "The MIT License",
    "MITReleased": "Released under the MIT License.",
    "MITUnder": "Licensed under the MIT License.",
    "MITGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MITNotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MITWarranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "MITLiability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSDGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSDSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "BSDBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSDNames": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL3Work": "This work is licensed under the GNU General Public License, version 3.",
    "GPLFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL2Free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPLHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPLSee": "See the GNU General Public License for more details.",
    "MPLTerms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CCByNc": "Licensed under CC BY-NC 4.0.",
    "CCBy": "Licensed under CC BY 4.0.",
    "CCBySa": "Licensed under CC BY-SA 4.0.",
    "CC0": "Released under CC0 1.0.",
    "Reserved": "All rights reserved.",
    "LGPLFree": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPLHope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPLSee": "See the GNU Lesser General Public License for more details.",
    "LGPL21Title": "GNU Lesser General Public License Version 2.1",
    "LGPL3Title": "GNU Lesser General Public License Version 3",
    "AGPLFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPLSee": "See the GNU Affero General Public License for more details.",
    "ISCTitle": "ISC License",
    "ISCGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty.",
    "ZlibGrant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "UnlicenseFree": "This is free and unencumbered software released into the public domain.",
    "UnlicenseGrant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "EPLTerms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSLGrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "BSLUnder": "Distributed under the Boost Software License, Version 1.0.",
}
# Short identifiers of the public licence list; a tag line with one of them is a known sentence too.
SPDX = ("0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
        "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only",
        "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TAG = "SPDX-License-Identifier:"
SENTENCES |= {f"Tag:{i}": f"{TAG} {i}" for i in SPDX}
# Licences and the ordered identifiers that show them; the first rule that fits takes its sentences.
RULES = [
    ("Apache-2.0", ("ApacheHead", "ApacheCopy", "ApacheBasis", "ApacheSee")),
    ("Apache-2.0", ("ApacheHead",)),
    ("Apache-2.0", ("ApacheUnder",)),
    ("MIT", ("MITTitle", "MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    ("MIT", ("MITTitleThe", "MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    ("MIT", ("MITGrant", "MITNotice", "MITWarranty", "MITLiability")),
    ("MIT", ("MITReleased",)),
    ("MIT", ("MITUnder",)),
    ("BSD-3-Clause", ("BSDGrant", "BSDSource", "BSDBinary", "BSDNames")),
    ("BSD-2-Clause", ("BSDGrant", "BSDSource", "BSDBinary")),
    ("GPL-3.0-or-later", ("GPLFree", "GPLHope", "GPLSee")),
    ("GPL-3.0-or-later", ("GPLFree",)),
    ("GPL-2.0-or-later", ("GPL2Free", "GPLHope", "GPLSee")),
    ("GPL-2.0-or-later", ("GPL2Free",)),
    ("GPL-3.0", ("GPL3Work",)),
    ("MPL-2.0", ("MPLTerms",)),
    ("CC-BY-NC-4.0", ("CCByNc",)),
    ("CC-BY-SA-4.0", ("CCBySa",)),
    ("CC-BY-4.0", ("CCBy",)),
    ("CC0-1.0", ("CC0",)),
    ("All-rights-reserved", ("Reserved",)),
    ("LGPL-2.1-or-later", ("LGPLFree", "LGPLHope", "LGPLSee")),
    ("LGPL-2.1-or-later", ("LGPLFree",)),
    ("LGPL-2.1", ("LGPL21Title",)),
    ("LGPL-3.0", ("LGPL3Title",)),
    ("AGPL-3.0-or-later", ("AGPLFree", "GPLHope", "AGPLSee")),
    ("AGPL-3.0-or-later", ("AGPLFree",)),
    ("ISC", ("ISCTitle", "ISCGrant")),
    ("ISC", ("ISCGrant",)),
    ("ISC", ("ISCTitle",)),
    ("Zlib", ("ZlibAsIs", "ZlibGrant")),
    ("Zlib", ("ZlibGrant",)),
    ("Unlicense", ("UnlicenseFree", "UnlicenseGrant")),
    ("Unlicense", ("UnlicenseFree",)),
    ("EPL-2.0", ("EPLTerms",)),
    ("BSL-1.0", ("BSLGrant",)),
    ("BSL-1.0", ("BSLUnder",)),
    *((i, (f"Tag:{i}",)) for i in SPDX),
]
CUT = "\x01"
GAP = r"[\x20\x09-\x0D]"


def _openings(known) -> str:
    """First two words of each known sentence, as a pattern."""
    return "|".join(sorted({" ".join(map(re.escape, s.split()[:2])) for s in known.values()}))


def ends(known):
    """Where a sentence ends: at the end of a tag line, at a final mark and white space, at an empty line, before a line
    that opens as a known sentence does."""
    return ((rf"({TAG}[^\n]*)\n", 1), (rf"([.!?:]){GAP}+", 1), (rf"\n{GAP}*\n", 0), (rf"\n({_openings(known)})", 2))


def keys(known) -> list:
    """Words such that every known sentence has one: a text without any of them needs no cutting.

    The word most of the sentences left have is taken first, a longer one before a shorter one.
    """
    left = {i: set(_plain(s).split()) for i, s in known.items() if _plain(s)}
    out = []
    while left:
        words = Counter(w for own in left.values() for w in own if len(w) > 3 or all(len(x) <= 3 for x in own))
        best = min(words, key=lambda w: (len(w) < 5, -words[w], -len(w), w))
        out.append(best)
        left = {i: own for i, own in left.items() if best not in own}
    return out


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def parts(text: Column, known=None) -> Column:
    """The normalised parts of a text in order, each between two cut marks."""
    for pattern, kind in ends(known or SENTENCES):
        text = F.regexp_replace(text, pattern, ("\x01", "$1\x01", "\x01$1")[kind])
    text = F.regexp_replace(F.lower(F.concat(F.lit(CUT), text, F.lit(CUT))), "[^a-z0-9\x01]+", " ")
    return F.regexp_replace(text, " ?\x01[ \x01]*", CUT)


def _pattern(plain) -> str:
    """One alternative a sentence; any space may be a cut, and of two that fit the shorter is taken."""
    return f"{CUT}({'|'.join(p.replace(' ', f'[ {CUT}]') for p in sorted(plain, key=len) if p)})(?={CUT})"


def licence_scan(docs: DataFrame, known=None, rules=None) -> DataFrame:
    """All columns of ``docs`` plus a struct ``licence``.

    In: ``text`` and any further columns (one named ``licence`` is replaced).  ``sentence_ids`` has
    the identifiers found, in order; ``names`` the licences, each once, in order of the rules;
    ``n_matches`` how often a rule fitted; ``n_left`` the identifiers that no rule took.  ``known`` and
    ``rules`` replace the built-in tables; texts to be cut are chosen by words of the table in use.  A null or
    blank text has none.  Repeated rows get equal results.  An empty table gives an empty table.
    """
    known = SENTENCES if known is None else {i: s for i, s in known.items() if _plain(s)}
    rules = RULES if rules is None else rules
    lookup = F.create_map(*[F.lit(x) for i, s in known.items() for x in (_plain(s), i)])
    text = F.coalesce("text", F.lit(""))
    worth = reduce(lambda a, b: a | b, (F.lower(text).contains(k) for k in keys(known)), F.lit(False))
    found = F.regexp_extract_all(parts(text, known), F.lit(_pattern(map(_plain, known.values()))), 1)
    ids = F.transform(found, lambda s: F.element_at(lookup, F.translate(s, CUT, " ")))
    names = [c for c in docs.columns if c != "licence"]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.when(worth, ids).otherwise(F.array().cast("array<string>")).alias("ids"))
    # every identifier in its own brackets, so a rule is a plain substring; what it takes leaves a bar that no rule crosses
    left, fits = F.array_join(F.transform("ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), ""), []
    steps = rows.withColumn("left0", left)
    for k, (_, need) in enumerate(rules):
        pattern = "".join(f"<{i}>" for i in need)
        after = F.replace(F.col(f"left{k}"), F.lit(pattern), F.lit("|" * len(need)))
        steps = steps.withColumn(f"left{k + 1}", F.when(F.col(f"left{k}") == "", "").otherwise(after))
        fits.append(((F.length(f"left{k}") - F.length(f"left{k + 1}")) / (len(pattern) - len(need))).cast("long"))
    found = F.array_distinct(F.filter(F.array(*[F.when(f > 0, F.lit(name)) for f, (name, _) in zip(fits, rules)]), lambda x: x.isNotNull()))
    last = F.col(f"left{len(rules)}")
    return steps.select(*[F.col("row")[c].alias(c) for c in names], F.struct(
        F.col("ids").alias("sentence_ids"), found.alias("names"), sum(fits, F.lit(0).cast("long")).alias("n_matches"),
        (F.length(last) - F.length(F.translate(last, "<", ""))).cast("long").alias("n_left")).alias("licence"))


def op2_licenses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licence_scan(docs).select("doc_id", F.array_join("licence.sentence_ids", ",").alias("sentence_ids"),
                                     F.array_join("licence.names", ",").alias("licenses"), "licence.n_matches", "licence.n_left")


def _sql_text(text):
    return "'" + text.replace("'", "''") + "'"


def _most_parts():
    """Parts that the longest cut sentence falls into."""
    def count(s):
        for pattern, kind in ends(SENTENCES):
            s = re.sub(pattern, ("\x01", r"\1" + "\x01", "\x01" + r"\1")[kind], s)
        return sum(bool(_plain(p)) for p in s.split("\x01"))

    return max(map(count, SENTENCES.values())) + 2


def _sql():
    cut = "text"
    for pattern, kind in ends(SENTENCES):
        cut = f"regexp_replace({cut}, {_sql_text(pattern)}, " + ("chr(1)", r"'\1' || chr(1)", r"chr(1) || '\1'")[kind] + ", 'g')"
    known = ", ".join(f"({_sql_text(_plain(s))}, '{i}')" for i, s in SENTENCES.items())
    counts = []
    steps = ["SELECT r, doc_id, sentence_ids, left0 FROM c"]
    for k, (_, need) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in need)
        steps.append(f"SELECT *, replace(left{k}, '{pattern}', '{'|' * len(need)}') AS left{k + 1} FROM ({steps[-1]})")
        counts.append(f"((length(left{k}) - length(left{k + 1})) // {len(pattern) - len(need)})")
    names = ", ".join(f"CASE WHEN {c} > 0 THEN '{name}' END" for c, (name, _) in zip(counts, RULES))
    last = f"left{len(RULES)}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, list_filter(list_transform(string_split({cut}, chr(1)), lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
  lambda s: s <> '') AS p FROM d),
k(plain, id) AS (VALUES {known}),
t AS (SELECT r, p, unnest(range(1, len(p) + 1)) AS i FROM s), w AS (SELECT r, i, i + n AS e, array_to_string(p[i:i + n], ' ') AS plain
  FROM t, range({_most_parts()}) AS n(n) WHERE i + n <= len(p)),
m AS (SELECT r, i, e, id, row_number() OVER (PARTITION BY r, i ORDER BY e) AS nth FROM w JOIN k USING (plain)),
f AS (SELECT r, i, id FROM m a WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM m b WHERE b.r = a.r AND b.nth = 1 AND b.i < a.i AND b.e >= a.i)),
g AS (SELECT r, string_agg(id, ',' ORDER BY i) AS sentence_ids, string_agg('<' || id || '>', '' ORDER BY i) AS left0 FROM f GROUP BY r),
c AS (SELECT d.r, doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(left0, '') AS left0 FROM d LEFT JOIN g USING (r)),
z AS ({steps[-1]})
SELECT doc_id, sentence_ids, array_to_string(list_transform(list_filter(list_zip(l, range(len(l))), lambda x: x[1] IS NOT NULL
    AND list_position(l, x[1]) = x[2] + 1), lambda x: x[1]), ',') AS licenses, n_matches::BIGINT AS n_matches, n_left::BIGINT AS n_left
FROM (SELECT doc_id, sentence_ids, [{names}] AS l, {' + '.join(counts)} AS n_matches, length({last}) - length(replace({last}, '<', '')) AS n_left FROM z)
"""


OP2_SQL = _sql()
