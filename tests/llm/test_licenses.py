"""Licence scan against a plain loop and SQL."""

import re

import pytest

from dayloom.llm import licenses

SCHEMA = "doc_id long, text string, licence string, ids string, left0 string, row string"
MIT = ["MITTitle", "MITGrant", "MITNotice", "MITWarranty", "MITLiability"]


def slow(text, known=licenses.SENTENCES, rules=licenses.RULES):
    """Sentences looked for part by part, from each part on as few parts as make one."""
    text = text or ""
    for pattern, kind in licenses.ends(known):
        text = re.sub(pattern, ("\x01", r"\1" + "\x01", "\x01" + r"\1")[kind], text)
    plain = {licenses._plain(s): i for i, s in known.items()}
    parts = [p for p in map(licenses._plain, text.split("\x01")) if p]
    ids, at = [], 0
    while at < len(parts):
        end = next((e for e in range(at + 1, len(parts) + 1) if " ".join(parts[at:e]) in plain), None)
        ids += [plain[" ".join(parts[at:end])]] if end else []
        at = end or at + 1
    rest, names, n = list(ids), [], 0
    for name, need in rules:
        i = 0
        while i + len(need) <= len(rest):
            if tuple(rest[i:i + len(need)]) == need:
                rest[i:i + len(need)] = [None] * len(need)
                n += 1
                names += [name] if name not in names else []
            i += 1
    return ids, names, n, sum(r is not None for r in rest)


def texts():
    s = licenses.SENTENCES
    mit = "\n\n".join(s[i] for i in MIT)
    wrapped = re.sub(r"(.{60}[^ ]*) ", r"\1" + "\n", mit)
    bsd = "\n".join(s[i] for i in ("BSDGrant", "BSDSource", "BSDBinary"))
    return [None, "", "  \n ", "Prose about a river.", "Some words. Licensed under the Apache License, Version 2.0. More words.",
            "line one\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.\nAll rights reserved.", mit, wrapped, mit + "\n" + mit, bsd,
            bsd + "\n" + s["BSDNames"], s["MITNotice"] + " " + s["GPLSee"], "the licensed bar and cc0 words", s["MITGrant"] + "\nLicensed under the MIT License.",
            "x " * 50000 + ". Released under CC0 1.0.", "LICENSED UNDER   the apache-license version 2.0"]


def test_equals_plain_loop(spark):
    rows = [(i, t, "a", "b", "c", "d") for i, t in enumerate(texts())] + [(None, texts()[4], None, None, None, None), (4, texts()[4], "a", "b", "c", "d")]
    out = licenses.licence_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and out[0].ids == "b"
    got = {r.doc_id: r.licence for r in out}
    for i, t in enumerate(texts()):
        g = got[i]
        assert (g.sentence_ids, g.names, g.n_matches, g.n_left) == slow(t), t
    assert got[6].names == ["MIT"] and got[7].names == ["MIT"] and got[8].n_matches == 2 and got[9].names == ["BSD-2-Clause"]
    assert got[10].names == ["BSD-3-Clause"] and got[11].n_left == 2 and got[None].names == ["Apache-2.0"]


def test_every_sentence_has_a_key():
    keys = licenses.keys(licenses.SENTENCES)
    for s in licenses.SENTENCES.values():
        assert any(k in s.lower() for k in keys), s
    assert licenses.keys({"X": "Use it freely.", "Y": "a b", "Z": "..."}) == ["freely", "a"]
    assert all(i in licenses.SENTENCES for _, need in licenses.RULES for i in need)


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_every_sentence_and_rule_is_found(spark):
    """Each sentence alone and inside prose, each rule's sentences on lines and wrapped, and headers as published."""
    s, rows, want = licenses.SENTENCES, [], []
    for i, sentence in s.items():
        for t in (sentence, f"Prose before.\n\n{sentence}\n\nProse after."):
            rows.append(t)
            want.append(([i], None))
    for name, need in licenses.RULES:
        for end in ("\n", "\n\n"):
            t = end.join(s[i] for i in need)
            for text in (t, re.sub(r"(.{60}[^ \n]*) ", r"\1" + "\n", t), re.sub(r" (?=THE SOFTWARE OR|The above|See the)", "\n", t)):
                rows.append(text)
                want.append((list(need), name))
    rows += [GPL3, MPL, APACHE]
    want += [(["GPLFree", "GPLHope", "GPLSee"], "GPL-3.0-or-later"), (["MPLTerms"], "MPL-2.0"),
             (["ApacheHead", "ApacheCopy", "ApacheBasis", "ApacheSee"], "Apache-2.0")]
    out = licenses.licence_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    for r in out:
        ids, name = want[r.doc_id]
        assert r.licence.sentence_ids == ids, r.text
        assert name is None or (r.licence.names == [name] and r.licence.n_matches == 1 and r.licence.n_left == 0), r.text
    assert len(out) == len(rows)


def test_a_table_of_ones_own(spark):
    """Sentences of the caller alone are looked for, and texts are chosen by their words."""
    known = {"X": "Use it freely.", "Y": "No resale (of parts).", "Z": "!!", "Q": "v. 2"}
    rules = [("Free", ("X", "Y")), ("Free-1", ("X",)), ("Two", ("Q",))]
    rows = ["Use it freely.", "use it\nFREELY! no resale: of parts", "All rights reserved. Use it freely. Other. No resale of parts.", "Prose.\n\nv. 2\n\nx", None, "", "MIT License"]
    out = licenses.licence_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), known, rules).collect()
    own = {i: s for i, s in known.items() if licenses._plain(s)}
    for r in out:
        assert (r.licence.sentence_ids, r.licence.names, r.licence.n_matches, r.licence.n_left) == slow(rows[r.doc_id], own, rules), rows[r.doc_id]
    assert {r.doc_id: r.licence.names for r in out} == {0: ["Free-1"], 1: ["Free"], 2: ["Free"], 3: ["Two"], 4: [], 5: [], 6: []}
    none = licenses.licence_scan(spark.createDataFrame([(1, "MIT License")], "doc_id long, text string"), {}, [])
    assert none.first().licence.sentence_ids == []


def test_tags_and_titles(spark):
    rows = {"// SPDX-License-Identifier: MIT\n#include <x>": ["MIT"], "# SPDX-License-Identifier: Apache-2.0\n\ncode": ["Apache-2.0"],
            "ISC License\n\nCopyright (c) 2020, A. Person": ["ISC"], "GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1": ["LGPL-2.1"],
            "x\n\nGNU LESSER GENERAL PUBLIC LICENSE\n Version 3\n\nfoo": ["LGPL-3.0"], "SPDX-License-Identifier: MIT-like": [],
            "the ISC License of old": [], "/* SPDX-License-Identifier: GPL-2.0-only\n * text */": ["GPL-2.0-only"]}
    out = licenses.licence_scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.text: r.licence.names for r in out} == rows


def test_half_a_sentence_is_none(spark):
    halves = [GPL3[:34], GPL3[34:280], "v. 2.0.", "License, v.\n\nOther words.\n\n2.0."]
    out = licenses.licence_scan(spark.createDataFrame(list(enumerate(halves)), "doc_id long, text string")).collect()
    assert all(r.licence.sentence_ids == [] and r.licence.names == [] for r in out)


def test_empty(spark):
    assert licenses.licence_scan(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from compare import compare, oracle
    problem = compare(licenses.op2_licenses(spark, f"/root/testdata/{sf}"), oracle(f"/root/testdata/{sf}"), licenses.OP2_SQL)
    assert not problem, problem
