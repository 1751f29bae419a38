"""Licence scan by sentence rules.

A text is cut into pieces at line ends and after ``.``, ``!``, ``?`` and ``;``. A known licence
sentence is a run of whole pieces, so it is found as one line, hard-wrapped at any words, and behind
comment marks, but not across an empty line. Each found sentence gives its identifier; the
identifiers of a text, in order, are matched against ordered licence rules: a rule is a sequence of
identifiers, the first rules take their sentences first, and a sentence serves one rule only.
Identifiers that no rule takes make the result ``partial``.

Cases: null and empty texts have no sentences; a null id is carried along; repeated sentences match
as often as they occur and name their licence once, repeated rows give a row each; where several
known sentences begin at one piece (ties) the first of the table counts; texts of any length are
read whole; an empty table gives no rows; a kept column with the name, in any case, of a new one
gives way to it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Known sentences, normalised (lower case, runs of other characters than letters,
#: digits and dots as one blank, no blanks and dots at the ends), as patterns of the whole
#: sentence, with their identifiers. A dot is a dot, a blank also stands for the end of a piece, ``@``
#: is the rest of a piece, ``%`` a few words. The first that matches counts.
_WORK = "(this|the) (work|program|software|file|library|code|project|package|module)"
_UNDER = "(licensed|released|distributed|published|made available) under( the terms of)?( version (2|2.0|3|3.0|2.1) of)?( either)?( the)?"
_CC = "(this (work|text|page|article|document|image) is )?(licensed|released|distributed|available|published) under( the terms of)?( a| the)?"
SENTENCES = [
    (rf"{_WORK} is (free software )?{_UNDER} gnu affero general public license( agpl)?( v(ersion )?3(.0)?)?( only| or( at your option any)? later( version)?)?", "AGPL3"),
    (rf"{_WORK} is (free software )?{_UNDER} gnu lesser general public license( lgpl)?( v(ersion )?(2.1|3|3.0))?( or( at your option any)? later( version)?)?", "LGPL"),
    (rf"{_WORK} is (free software )?{_UNDER} gnu general public license( gpl)?( as published by the free software foundation)? v(ersion )?2(.0)?( only| or( at your option any)? later( version)?)?", "GPL2"),
    (rf"{_WORK} is (free software )?{_UNDER} gnu general public license( gpl)?( as published by the free software foundation)? v(ersion )?3(.0)?( only| or( at your option any)? later( version)?)?", "GPL3"),
    (r"([a-z0-9]+ ){1,3}is free software you can redistribute it and or modify it under the terms of (version 2 of the gnu general public license|the gnu general public license version 2|the gnu general public license as published by the free software foundation version 2 of the license) as published by the free software foundation", "GPL2"),
    (r"([a-z0-9]+ ){1,3}is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2( of the license)? or at your option any later version", "GPL2Later"),
    (r"([a-z0-9]+ ){1,3}is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3( of the license)? or at your option any later version", "GPL3Later"),
    (r"([a-z0-9]+ ){1,3}is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version (2.1|3)( of the license)? or at your option any later version", "LGPLLater"),
    (r"([a-z0-9]+ ){1,3}is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3( of the license)? or at your option any later version", "AGPL3Later"),
    (r"([a-z0-9]+ ){1,3}is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "GPLNoWarranty"),
    (r"see the gnu (lesser |affero )?general public license for more details", "GPLSee"),
    (r"you should have received a copy of the gnu (lesser |affero )?general public license along with %if not (see|write to)@", "GPLCopy"),
    (r"permission is hereby granted free of charge to any person obtaining a copy of this software@", "MITGrant"),
    (r"the above copyright notice and this permission notice( including the next paragraph)? shall be included in all copies or substantial portions of the software", "MITNotice"),
    (r"the software is provided as is without warranty of any kind express or implied@", "MITAsIs"),
    (r"in no event shall %be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "MITLiable"),
    (rf"({_WORK} is )?(licensed|released|distributed|published|made available) under( the terms of)? the mit( x11| expat)? license", "MITRef"),
    (r"licensed under the apache license version 2.0( the license you may not use this (file|work|software) except in compliance with the license)?", "Apache2Ref"),
    (rf"({_WORK} is )?(licensed|released|distributed|published|made available) under( the terms of)? the apache license( version| v)? 2.0", "Apache2Ref"),
    (r"you may obtain a copy of the license at@", "Apache2Obtain"),
    (r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis@", "Apache2AsIs"),
    (r"see the license for the specific language governing permissions and limitations under the license", "Apache2See"),
    (r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met( 1)?", "BSDGrant"),
    (r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer( 2)?", "BSDSource"),
    (r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution( 3)?", "BSDBinary"),
    (r"neither the name of %may be used to endorse or promote products derived from this software without specific prior written permission", "BSDEndorse"),
    (r"this software is provided by %as is and any express or implied warranties@", "BSDAsIs"),
    (rf"({_WORK} is )?(licensed|released|distributed|published|made available) under( the terms of)? (the |a )?(new |modified |revised |3 clause )?bsd( style)?( 3 clause)? license", "BSDRef"),
    (rf"({_WORK} is )?(licensed|released|distributed|published|made available) under( the terms of)? (the |a )?(simplified |2 clause )bsd( 2 clause)? license", "BSD2Ref"),
    (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted@", "ISCGrant"),
    (r"the software is provided as is and the author disclaims all warranties with regard to this software@", "ISCAsIs"),
    (rf"({_WORK} is )?(licensed|released|distributed|published|made available) under( the terms of)? the isc license", "ISCRef"),
    (r"this source code form is subject to the terms of the mozilla public license v 2.0", "MPL2Ref"),
    (r"if a copy of the mpl was not distributed with this file you can obtain one at@", "MPL2Obtain"),
    (rf"({_WORK} is )?(licensed|released|distributed|published|made available) under( the terms of)? the mozilla public license( version| v)? 2.0", "MPL2Ref"),
    (r"this program and the accompanying materials are made available under the terms of the eclipse public license v(ersion )?2.0@", "EPL2Ref"),
    (r"boost software license version 1.0 august 17th 2003", "BoostRef"),
    (r"distributed under the boost software license version 1.0@", "BoostRef"),
    (r"this is free and unencumbered software released into the public domain", "Unlicense"),
    (rf"{_CC} (creative commons|cc) (by|attribution) (nc|noncommercial|non commercial) (sa|sharealike|share alike)( (2.0|2.5|3.0|4.0))?( (unported|international))?( public)?( license)?", "CCByNcSa"),
    (rf"{_CC} (creative commons|cc) (by|attribution) (nc|noncommercial|non commercial) (nd|noderivatives|noderivs)( (2.0|2.5|3.0|4.0))?( (unported|international))?( public)?( license)?", "CCByNcNd"),
    (rf"{_CC} (creative commons|cc) (by|attribution) (nc|noncommercial|non commercial)( (2.0|2.5|3.0|4.0))?( (unported|international))?( public)?( license)?", "CCByNc"),
    (rf"{_CC} (creative commons|cc) (by|attribution) (sa|sharealike|share alike)( (2.0|2.5|3.0|4.0))?( (unported|international))?( public)?( license)?", "CCBySa"),
    (rf"{_CC} (creative commons|cc) (by|attribution) (nd|noderivatives|noderivs)( (2.0|2.5|3.0|4.0))?( (unported|international))?( public)?( license)?", "CCByNd"),
    (rf"{_CC} (creative commons|cc) (by|attribution)( (2.0|2.5|3.0|4.0))?( (unported|international))?( public)?( license)?", "CCBy"),
    (rf"{_CC} (creative commons (zero|cc0)|cc0)( 1.0)?( universal)?( public domain dedication)?( license)?", "CC0"),
    (rf"({_WORK} is |this (text|page|article) is )?(dedicated to|released into|placed in|in) the public domain", "PublicDomain"),
    (r"spdx license identifier mit", "MITRef"),
    (r"spdx license identifier apache 2.0", "Apache2Ref"),
    (r"spdx license identifier bsd 3 clause", "BSDRef"),
    (r"spdx license identifier bsd 2 clause", "BSD2Ref"),
    (r"spdx license identifier isc", "ISCRef"),
    (r"spdx license identifier mpl 2.0", "MPL2Ref"),
    (r"spdx license identifier gpl 2.0( only| or later)?", "GPL2"),
    (r"spdx license identifier gpl 3.0( only| or later)?", "GPL3"),
    (r"spdx license identifier lgpl (2.1|3.0)( only| or later)?", "LGPL"),
    (r"spdx license identifier agpl 3.0( only| or later)?", "AGPL3"),
    (r"all rights reserved", "AllRights"),
]

#: Ordered rules, longer sequences of a licence before its parts.
RULES = [
    (("GPL2Later", "GPLNoWarranty", "GPLSee", "GPLCopy"), "GPL-2.0-or-later"),
    (("GPL3Later", "GPLNoWarranty", "GPLSee", "GPLCopy"), "GPL-3.0-or-later"),
    (("LGPLLater", "GPLNoWarranty", "GPLSee", "GPLCopy"), "LGPL"),
    (("AGPL3Later", "GPLNoWarranty", "GPLSee", "GPLCopy"), "AGPL-3.0"),
    (("GPL2", "GPLNoWarranty", "GPLSee", "GPLCopy"), "GPL-2.0"),
    (("GPL2Later", "GPLNoWarranty", "GPLSee"), "GPL-2.0-or-later"),
    (("GPL3Later", "GPLNoWarranty", "GPLSee"), "GPL-3.0-or-later"),
    (("LGPLLater", "GPLNoWarranty", "GPLSee"), "LGPL"),
    (("AGPL3Later", "GPLNoWarranty", "GPLSee"), "AGPL-3.0"),
    (("GPL2", "GPLNoWarranty", "GPLSee"), "GPL-2.0"),
    (("GPL2Later",), "GPL-2.0-or-later"),
    (("GPL3Later",), "GPL-3.0-or-later"),
    (("LGPLLater",), "LGPL"),
    (("AGPL3Later",), "AGPL-3.0"),
    (("MITGrant", "MITNotice", "MITAsIs", "MITLiable"), "MIT"),
    (("MITGrant", "MITNotice", "MITAsIs"), "MIT"),
    (("Apache2Ref", "Apache2Obtain", "Apache2AsIs", "Apache2See"), "Apache-2.0"),
    (("Apache2Ref", "Apache2Obtain", "Apache2AsIs"), "Apache-2.0"),
    (("BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs"), "BSD-3-Clause"),
    (("BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs"), "BSD-2-Clause"),
    (("ISCGrant", "ISCAsIs"), "ISC"),
    (("ISCGrant",), "ISC"),
    (("MPL2Ref", "MPL2Obtain"), "MPL-2.0"),
    (("GPL2",), "GPL-2.0"),
    (("GPL3",), "GPL-3.0"),
    (("LGPL",), "LGPL"),
    (("AGPL3",), "AGPL-3.0"),
    (("MITRef",), "MIT"),
    (("Apache2Ref",), "Apache-2.0"),
    (("BSDRef",), "BSD-3-Clause"),
    (("BSD2Ref",), "BSD-2-Clause"),
    (("ISCRef",), "ISC"),
    (("MPL2Ref",), "MPL-2.0"),
    (("EPL2Ref",), "EPL-2.0"),
    (("BoostRef",), "BSL-1.0"),
    (("Unlicense",), "Unlicense"),
    (("CCByNcSa",), "CC-BY-NC-SA"),
    (("CCByNcNd",), "CC-BY-NC-ND"),
    (("CCByNc",), "CC-BY-NC"),
    (("CCBySa",), "CC-BY-SA"),
    (("CCByNd",), "CC-BY-ND"),
    (("CCBy",), "CC-BY"),
    (("CC0",), "CC0-1.0"),
    (("PublicDomain",), "Public-Domain"),
    (("AllRights",), "Proprietary"),
]

#: How the signs of a pattern read in a line of pieces, each of which stands between two bars.
_SIGNS = {".": r"\.", "(": "(?:", " ": "(?: |[|][|])", "@": "(?: [^|]*)?", "%": "(?:[^|]|[|][|]){1,200}?"}
PATTERNS = ["".join(_SIGNS.get(c, c) for c in p) for p, _ in SENTENCES]
_KNOWN = re.compile(r"\|(?:" + "|".join(f"({p})" for p in PATTERNS) + r")\|")

_LOWER = {c: c + 32 for c in range(65, 91)}
_BREAK = re.compile(r"([.!?;])[\x20\x09-\x0D]+")
_OTHER = re.compile(r"[^a-z0-9.]+")


def literal(pattern: str) -> str:
    """The longest run of letters and digits that all sentences of a pattern hold."""
    pattern, n = re.sub(r"\[[^]]*\]\+?|\{[^}]*\}", " ", pattern), 1
    while n:
        pattern, n = re.subn(r"\([^()]*\)\??", " ", pattern)
    return max(re.findall(r"[a-z0-9]+", pattern), key=len)


#: A text without any of these holds no known sentence.
_HINT = re.compile("|".join(sorted({literal(p) for p, _ in SENTENCES})).encode())


def line_of(text: str) -> str:
    """The normalised pieces of a text, each between two bars."""
    low = _BREAK.sub(r"\1\n", text.translate(_LOWER))
    return "|" + "||".join([_OTHER.sub(" ", s).strip(" .") for s in low.split("\n")]) + "|"


def known_sentences(text: bytes | None) -> list[str]:
    """The identifiers of a text, in order."""
    if not text or not _HINT.search(text.lower()):
        return []
    return [SENTENCES[m.lastindex - 1][1] for m in _KNOWN.finditer(line_of(text.decode("utf-8", "replace")))]


def recognise(ids: list[str]) -> tuple[list[str], bool]:
    """Licences by the rules, and whether every identifier was taken."""
    line = ";" + "".join(f";{x};" for x in ids) + ";"
    found = []
    for sequence, name in RULES:
        part = "".join(f";{x};" for x in sequence)
        if part in line:
            line = line.replace(part, "~")
            if name not in found:
                found.append(name)
    return sorted(found), set(line) <= {";", "~"}


def scan(docs: DataFrame, text_col: str = "text", keep=None) -> DataFrame:
    """docs with n_sentences (known ones), sentence_ids (joined by ``;``), licences (sorted, joined
    by ``,``) and status: none, known or partial."""

    def make():
        def run(texts):
            out: list[list] = [[], [], [], []]
            for t in texts:
                ids = known_sentences(t)
                names, whole = recognise(ids)
                row = (len(ids), ";".join(ids), ",".join(names), "none" if not ids else "known" if whole else "partial")
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
            return [pa.array(c, k) for c, k in zip(out, kinds)]

        return run

    fields = [T.StructField("n_sentences", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("sentence_ids", "licences", "status")]
    return map_texts(docs, text_col, fields, make, keep)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs, keep=["doc_id"])


def _sql() -> str:
    cases = " ".join(f"WHEN regexp_full_match(m, '[|](?:{p})[|]') THEN '{i}'" for p, (_, i) in zip(PATTERNS, SENTENCES))
    steps, last = [], "s0"
    for k, (sequence, _) in enumerate(RULES):
        part = "".join(f";{x};" for x in sequence)
        steps.append(f"s{k + 1} AS (SELECT *, contains(line{k}, '{part}') AS r{k}, replace(line{k}, '{part}', '~') AS line{k + 1} FROM {last})")
        last = f"s{k + 1}"
    names = ", ".join(f"CASE WHEN r{k} THEN '{name}' END" for k, (_, name) in enumerate(RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), cut AS (SELECT rid, doc_id, string_split(regexp_replace(t, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM d
), lines AS (SELECT rid, '|' || array_to_string(list_transform(parts, lambda p: trim(regexp_replace(p, '[^a-z0-9.]+', ' ', 'g'), ' .')), '||') || '|' AS line FROM cut
), found AS (SELECT rid, regexp_extract_all(line, '[|](?:{"|".join(PATTERNS)})[|]') AS ms FROM lines
), each AS (SELECT rid, unnest(range(1, len(ms) + 1)) AS ord, unnest(ms) AS m FROM found
), ids AS (SELECT rid, ord, CASE {cases} END AS id FROM each
), lists AS (SELECT rid, list(id ORDER BY ord) AS ids FROM ids GROUP BY rid
), s0 AS (SELECT doc_id, coalesce(ids, []) AS ids, ';' || coalesce(list_reduce(list_prepend('', list_transform(ids, lambda x: ';' || x || ';')), lambda a, b: a || b), '') || ';' AS line0 FROM d LEFT JOIN lists USING (rid)
), {", ".join(steps)}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ';') AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct([{names}])), ','), '') AS licences,
       CASE WHEN len(ids) = 0 THEN 'none' WHEN regexp_full_match({last.replace("s", "line")}, '[;~]*') THEN 'known' ELSE 'partial' END AS status
FROM {last}
"""


SQL = _sql()
