import itertools
import re
import textwrap

import pytest

from kvspark.llm import licences

from .sqlcheck import equal

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert equal(licences.query(docs), licences.SQL, SF)
    assert licences.query(docs).where("status = 'known'").count() > 10


#: Official notices, each on one line, with the licences that they name.
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
    "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
    "    http://www.apache.org/licenses/LICENSE-2.0\n\n"
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
GPL = (
    "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
    "either version {} of the License, or (at your option) any later version.\n\n"
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE.  See the GNU General Public License for more details.\n\n"
    "You should have received a copy of the GNU General Public License along with this program{}"
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n\n{}"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
ENDORSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
    "written permission.\n\n"
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    "permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS."
)
OFFICIAL = {
    "mit": (MIT, "MIT"),
    "apache": (APACHE, "Apache-2.0"),
    "gpl2": (GPL.format(";", 2, "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."), "GPL-2.0-or-later"),
    "gpl3": (GPL.format(":", 3, ".  If not, see <https://www.gnu.org/licenses/>."), "GPL-3.0-or-later"),
    "bsd2": (BSD.format(""), "BSD-2-Clause"),
    "bsd3": (BSD.format(ENDORSE), "BSD-3-Clause"),
    "isc": (ISC, "ISC"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    "ccby": ("Released under CC BY 4.0.", "CC-BY"),
    "ccbysa": ("This text is distributed under Creative Commons BY-SA 4.0.", "CC-BY-SA"),
    "ccname": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", "CC-BY-NC-SA"),
    "gplref": ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Unlicense"),
}


def forms(text):
    yield text
    yield text.replace("\n", "\r\n")
    for width in (30, 55, 76):
        wrapped = ["\n".join(textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False)) for p in text.split("\n\n")]
        yield "\n\n".join(wrapped)
        yield "/*\n" + "\n".join(f" * {x}".rstrip() for x in "\n\n".join(wrapped).split("\n")) + "\n */\nint main() {}\n"
        yield "\n".join(f"# {x}" for x in "\n\n".join(wrapped).split("\n"))
    yield f"Some words before it\n\nCopyright (c) 2020 Somebody\n\n{text}\n\nand behind."


@pytest.mark.parametrize("name", OFFICIAL)
def test_official_texts(name):
    text, want = OFFICIAL[name]
    for form in forms(text):
        assert licences.recognise(licences.known_sentences(form.encode())) == ([want], True), form


def brute(text):
    """Runs of pieces, tried one by one; each pattern read by itself."""
    pieces = [" ".join(re.findall(r"[a-z0-9.]+", p)).strip(" .") for p in re.split(r"(?<=[.!?;])[ \t-\r]+|\n", text.translate({c: c + 32 for c in range(65, 91)}))]
    readings = [(re.compile(p.replace(".", r"\.").replace("%", "[a-z0-9. ]{1,200}?").replace("@", "( .*)?")), "@" in p, i) for p, i in licences.SENTENCES]
    out, at = [], 0
    while at < len(pieces):
        for reading, open_end, ident in readings:
            ends = [z for z in range(at + 1, min(len(pieces), at + 12) + 1) if "" not in pieces[at:z] and reading.fullmatch(" ".join(pieces[at:z]))]
            if ends:
                out.append(ident)
                at = min(ends) if open_end else max(ends)
                break
        else:
            at += 1
    return out


def test_search_equals_brute_force(spark):
    for text, _ in OFFICIAL.values():
        for form in itertools.islice(forms(text), 4):
            assert licences.known_sentences(form.encode()) == brute(form)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    docs = [r for k, r in enumerate(docs) if k < 40 or re.search("(?i)licen|rights|permission|software|domain", r.text or "") and len(r.text) < 4000]
    assert len(docs) > 60
    assert [licences.known_sentences((r.text or "").encode()) for r in docs] == [brute(r.text or "") for r in docs]


def test_rules():
    assert licences.recognise(["MITGrant", "MITNotice"]) == ([], False)
    assert licences.recognise(["GPL2Later", "GPLNoWarranty", "GPLSee", "AllRights"]) == (["GPL-2.0-or-later", "Proprietary"], True)
    assert licences.recognise([]) == ([], True)


def members(pattern):
    """Sentences of a pattern: each of its groups' choices, or none, in turn."""
    for k in range(8):
        out = pattern.replace("([a-z0-9]+ ){1,3}", "my tool ").replace("%", "some words ").replace("@", "")
        while group := re.search(r"\(([^()]*)\)(\??)", out):
            choices = group[1].split("|") + ([""] if group[2] else [])
            out = out[: group.start()] + choices[k % len(choices)] + out[group.end() :]
        yield out


def test_every_pattern_is_found_by_its_hint():
    for pattern, ident in licences.SENTENCES:
        for sentence in members(pattern):
            text = sentence.title().replace(" ", " \n- ").encode()
            assert licences._HINT.search(text.lower()), sentence
            assert len(licences.known_sentences(sentence.encode())) == 1, sentence
        assert licences.literal(pattern) in sentence and any(i == ident or ident in s for s, _ in licences.RULES for i in s)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "ALL RIGHTS-RESERVED"), (5, "x. " * 100000 + "\nLicensed under CC BY-NC 4.0."), (6, "See the GNU General Public License for more details.")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, status string")
    got = {(r.doc_id, r.n_sentences, r.licences, r.status) for r in licences.query(docs).collect()}
    assert got == {(1, 0, "", "none"), (2, 0, "", "none"), (3, 1, "MIT", "known"), (None, 1, "Proprietary", "known"), (5, 1, "CC-BY-NC", "known"), (6, 1, "", "partial")}
    assert licences.query(docs.limit(0)).collect() == []
