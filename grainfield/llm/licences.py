"""Licence scan by sentence rules, with DataFrame functions alone.

A text is cut into sentences (after . ! ? ; before white space, after : at a line's end, and at blank lines; other line ends
are wraps, and what comment lines begin with is left out); each is normalised (lower case, runs of characters other than
a-z and 0-9 to one blank, trimmed, years left out). Known licence sentences in it become their identifiers, longest first,
whole or as a part (a heading may stand before one); what is left with a licence word becomes UNKNOWN; a copyright line is
COPYRIGHT; others vanish. The identifier sequence is then matched against the ordered rules: a rule fires where its
identifiers follow each other, and what it matched is used up, so that later, looser rules only see the rest.

Everything happens within a row: no join, no shuffle, and the tables of sentences and rules are part of the plan.

Cases: null, empty and licence-free texts give no identifier and no licence; equal licences count once, in the order of
the rules; repeated rows give repeated results; an empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences by identifier, as they are written in the public licence texts and in common notices.
SENTENCES = {
    "COPYRIGHT": [],
    "MIT_GRANT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "MIT_NOTICE": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MIT_LIABLE": ["In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"],
    "MIT_REF": ["This project is licensed under the MIT License", "Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT"],
    "APACHE_REF": ['Licensed under the Apache License, Version 2.0 (the "License")', "Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "APACHE_COMPLY": ["you may not use this file except in compliance with the License"],
    "APACHE_COPY": ["You may obtain a copy of the License at"],
    "APACHE_URL": ["http://www.apache.org/licenses/LICENSE-2.0", "https://www.apache.org/licenses/LICENSE-2.0"],
    "APACHE_BASIS": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "APACHE_SEE": ["See the License for the specific language governing permissions and limitations under the License"],
    "GPL_TERMS": ["redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "LGPL_TERMS": [
        "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    ],
    "AGPL_TERMS": ["redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "V1_LATER": ["either version 1, or (at your option) any later version", "either version 1 of the License, or (at your option) any later version"],
    "V2_LATER": ["either version 2 of the License, or (at your option) any later version"],
    "V21_LATER": ["either version 2.1 of the License, or (at your option) any later version"],
    "V3_LATER": ["either version 3 of the License, or (at your option) any later version"],
    "V2": ["version 2 of the License", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "V21": ["version 2.1 of the License"],
    "V3": ["version 3 of the License"],
    "GPL_SEE": [f"See the GNU {x}General Public License for more details" for x in ("", "Lesser ", "Library ", "Affero ")],
    "GPL_COPY": [f"You should have received a copy of the GNU {x}General Public License along with this {y}" for x in ("", "Lesser ", "Library ", "Affero ") for y in ("program", "library", "software")]
    + [f"If not, see {x}://www.gnu.org/licenses/" for x in ("http", "https")],
    "APACHE_TITLE": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004 https://www.apache.org/licenses/"],
    "GPL1_TITLE": ["GNU General Public License Version 1, February 1989"],
    "GPL2_TITLE": ["GNU General Public License Version 2, June 1991"],
    "GPL3_TITLE": ["GNU General Public License Version 3, 29 June 2007"],
    "LGPL2_TITLE": ["GNU Library General Public License Version 2, June 1991"],
    "LGPL21_TITLE": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL3_TITLE": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "AGPL3_TITLE": ["GNU Affero General Public License Version 3, 19 November 2007"],
    "GFDL12_TITLE": ["GNU Free Documentation License Version 1.2, November 2002"],
    "GFDL13_TITLE": ["GNU Free Documentation License Version 1.3, 3 November 2008"],
    "MPL11_TITLE": ["Mozilla Public License Version 1.1"],
    "MPL2_TITLE": ["Mozilla Public License Version 2.0"],
    "CC0_TITLE": ["The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights"],
    "ARTISTIC_NAME": ["The Artistic License"],
    "ARTISTIC_TITLE": ["The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package"],
    "PSF_TITLE": ['This LICENSE AGREEMENT is between the Python Software Foundation ("PSF")'],
    "GPL3_REF": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL2_REF": ["Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL_REF": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"],
    "BSD_GRANT": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD_SOURCE": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BSD_BINARY": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BSD3_REF": ["Licensed under the BSD 3-Clause License", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD2_REF": ["Licensed under the BSD 2-Clause License", "BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC_GRANT": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "ISC_REF": ["Licensed under the ISC License", "ISC License", "SPDX-License-Identifier: ISC"],
    "MPL_REF": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC_BY_NC_REF": ["Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC_BY_SA_REF": ["Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC_BY_REF": ["Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC0_REF": ["Released under CC0 1.0", "This work is dedicated to the public domain", "SPDX-License-Identifier: CC0-1.0"],
    "UNLICENSE": ["This is free and unencumbered software released into the public domain"],
    "RESERVED": ["All rights reserved"],
}

#: Known sentences with slots: _ stands for any few words, such as a holder's name.
SLOTS = [
    ("BSD_NAMES", ["neither the name _ may be used to endorse or promote products derived from", "neither the names _ may be used to endorse or promote products derived from", "the name _ may not be used to endorse or promote products derived from", "the names _ may not be used to endorse or promote products derived from"]),
    ("BSD_AS_IS", ["this software is provided by _ as is and any express or implied warranties"]),
    ("BSD_LIABLE", ["in no event shall _ be liable for any direct indirect incidental special exemplary or consequential damages"]),
]
#: The most words in a slot, and the most runs of other sentences that the body of a whole licence text may hold.
WORDS, RUNS = 24, 200

#: Rules in order: licence, and the identifiers that must follow each other. Identifiers in brackets may be missing, and what
#: stands in round ones as a whole; ~ is the rest of a licence's text: sentences that are no other licence's.
NOTICE = "[GPL_SEE] [GPL_COPY] [GPL_COPY]"
GNU = [
    (f"{family}-{'2.1' if v == '21' else v + '.0'}{later}", ["[COPYRIGHT]", f"{family}_TERMS", f"V{v}{end}", *NOTICE.split()])
    for family, versions in (("GPL", ("1", "2", "3")), ("LGPL", ("2", "21", "3")), ("AGPL", ("3",)))
    for v in versions
    for later, end in (("-or-later", "_LATER"), ("", ""))
    if (v, end) != ("1", "")
]
WHOLE = [
    ("Apache-2.0", ["APACHE_TITLE", "~", "(APACHE_REF APACHE_COMPLY APACHE_COPY [APACHE_URL] [APACHE_BASIS] [APACHE_SEE])"]),
    ("GPL-1.0", ["GPL1_TITLE", "~", f"(GPL_TERMS [V1_LATER] {NOTICE} ~)"]),
    ("GPL-2.0", ["GPL2_TITLE", "~", f"(GPL_TERMS V2_LATER {NOTICE} ~)"]),
    ("GPL-3.0", ["GPL3_TITLE", "~", f"(GPL_TERMS V3_LATER {NOTICE} ~)"]),
    ("LGPL-2.0", ["LGPL2_TITLE", "~", f"(LGPL_TERMS V2_LATER {NOTICE} ~)"]),
    ("LGPL-2.1", ["LGPL21_TITLE", "~", f"(LGPL_TERMS V21_LATER {NOTICE} ~)"]),
    ("LGPL-3.0", ["LGPL3_TITLE", "~"]),
    ("AGPL-3.0", ["AGPL3_TITLE", "~", f"(AGPL_TERMS V3_LATER {NOTICE} ~)"]),
    ("GFDL-1.2", ["GFDL12_TITLE", "~"]),
    ("GFDL-1.3", ["GFDL13_TITLE", "~"]),
    ("MPL-1.1", ["MPL11_TITLE", "~", "(APACHE_COMPLY APACHE_COPY ~)"]),
    ("MPL-2.0", ["MPL2_TITLE", "~", "(MPL_REF ~)"]),
    ("CC0-1.0", ["CC0_TITLE", "~"]),
    ("Artistic-1.0", ["[ARTISTIC_NAME]", "ARTISTIC_TITLE", "~", "(BSD_NAMES ~)"]),
    ("PSF-2.0", ["PSF_TITLE", "~"]),
]
RULES = [
    *WHOLE,
    ("MIT", ["[MIT_REF]", "[COPYRIGHT]", "MIT_GRANT", "MIT_NOTICE", "[MIT_LIABLE]"]),
    ("Apache-2.0", ["[COPYRIGHT]", "APACHE_REF", "APACHE_COMPLY", "APACHE_COPY", "[APACHE_URL]", "[APACHE_BASIS]", "[APACHE_SEE]"]),
    *GNU,
    ("BSD-3-Clause", ["[BSD3_REF]", "[COPYRIGHT]", "[RESERVED]", "BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES", "[BSD_AS_IS]", "[BSD_LIABLE]"]),
    ("BSD-2-Clause", ["[BSD2_REF]", "[COPYRIGHT]", "[RESERVED]", "BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "[BSD_AS_IS]", "[BSD_LIABLE]"]),
    ("ISC", ["[ISC_REF]", "[COPYRIGHT]", "ISC_GRANT"]),
    ("MIT", ["MIT_REF"]),
    ("MIT", ["MIT_GRANT"]),
    ("Apache-2.0", ["APACHE_REF"]),
    ("GPL", ["GPL_TERMS"]),
    ("LGPL", ["LGPL_TERMS"]),
    ("AGPL", ["AGPL_TERMS"]),
    ("GPL-3.0", ["GPL3_REF"]),
    ("GPL-2.0", ["GPL2_REF"]),
    ("LGPL-3.0", ["LGPL_REF"]),
    ("BSD-3-Clause", ["BSD3_REF"]),
    ("BSD-2-Clause", ["BSD2_REF"]),
    ("ISC", ["ISC_REF"]),
    ("MPL-2.0", ["MPL_REF"]),
    ("CC-BY-NC-4.0", ["CC_BY_NC_REF"]),
    ("CC-BY-SA-4.0", ["CC_BY_SA_REF"]),
    ("CC-BY-4.0", ["CC_BY_REF"]),
    ("CC0-1.0", ["CC0_REF"]),
    ("Unlicense", ["UNLICENSE"]),
    ("Proprietary", ["RESERVED"]),
    ("Unknown", ["UNKNOWN"]),
    ("Unknown", ["COPYRIGHT"]),
]
#: Licences that are only told where no rule before fired: reserved rights stand in many free licences' notices, too.
LAST = "Proprietary"

#: What a line of a comment may begin with; abbreviations whose point ends no sentence; where a sentence ends: after its mark
#: before white space, and at a blank line. Other line ends are wraps.
LEADER, SHORT, NAMED, BREAK = r"(?m)^[ \t]*[#*/;%-]+[ \t]*", r"\bv\.[ \t]+([0-9])", r"\b(inc|ltd|corp|co|llc)\.(\s+nor\b)|\b(names? of(?:[ \t]+[a-z]+){0,6}[ \t]+[a-z])\.([ \t]+[a-z])", r"[.!?;]+[ \t]+|[.!?;:]+[ \t]*\n\s*|\n[ \t]*\n\s*"
LICENCE_WORD = "licen[cs]e|licensed|copyright|all rights reserved|public domain|redistribut|permission is hereby|permission to use|neither the name|endorse or promote"
ANY_WORD = "licen[cs]e|copyright|rights reserved|public domain|redistribut|permission|neither the name|endorse or promote"
COPYRIGHT_LINE = "^copyright( c)?( [a-z0-9]+){0,12}$"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub(r"\b(19|20)[0-9][0-9]\b", " ", sentence.lower())).strip()


def known_segments(sentences: dict[str, list[str]] = SENTENCES) -> list[tuple[str, str]]:
    """(normalised sentence, identifier), longest first; a sentence that has a break inside is two segments, the later ones without identifier."""
    out: dict[str, str] = {}
    for name, texts in sentences.items():
        for text in texts:
            parts = [normalised(p) for p in re.split(BREAK, re.sub(SHORT, r"v \1", text.lower()))]
            kept = [p for p in parts if re.search(LICENCE_WORD, p)]
            out |= {p: name if i == 0 else "" for i, p in enumerate(kept)}
    return sorted(out.items(), key=lambda x: (-len(x[0]), x[0]))


def slot_patterns(slots: list[tuple[str, list[str]]] = SLOTS) -> list[tuple[str, str]]:
    """(regular expression over words with two blanks between, identifier) of the sentences with slots."""
    word = "(?:  [a-z0-9]+)"
    return [(" " + text.replace(" _", f"{word}{{0,{WORDS}}}?").replace(" ", "  ").replace("(?:    ", "(?:  ") + " ", name) for name, texts in slots for text in texts]


def sentence_ids(text: Column | str, sentences: dict[str, list[str]] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order. Every known sentence holds a licence word, so only sentences with one are searched."""
    known = known_segments(sentences)
    double = lambda s: s.replace(" ", "  ")
    table = F.array(*[F.struct(F.lit(f" {double(k)} ").alias("segment"), F.lit(f" #{i}# ").alias("mark")) for i, (k, _) in enumerate(known)])
    slots = slot_patterns()
    names = F.array(*[F.lit(name) for _, name in [*known, *slots]])
    lower = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\r\n?", "\n")
    parts = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(lower, LEADER, ""), SHORT, "v $1"), NAMED, "$1$2$3$4"), BREAK)
    parts = F.when(lower.rlike(ANY_WORD), parts).otherwise(F.array().cast("array<string>"))
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(19|20)[0-9][0-9]\b", " "), "[^a-z0-9]+", " ")))
    clean = F.filter(clean, lambda s: s.rlike(LICENCE_WORD))

    def named(s: Column) -> Column:
        spaced = F.concat(F.lit("  "), F.replace(s, F.lit(" "), F.lit("  ")), F.lit("  "))
        for i, (pattern, _) in enumerate(slots):
            spaced = F.regexp_replace(spaced, pattern, f" #{len(known) + i}# ")
        marked = F.aggregate(table, spaced, lambda state, k: F.replace(state, k["segment"], k["mark"]))
        found = F.transform(F.regexp_extract_all(marked, F.lit("#([0-9]+)#"), F.lit(1)), lambda i: names[i.cast("int")])
        return F.concat(F.filter(found, lambda x: x != ""), F.when(marked.rlike(LICENCE_WORD), F.array(F.lit("UNKNOWN"))).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(clean, lambda s: F.when(s.rlike(COPYRIGHT_LINE) & ~s.rlike("licen|permi"), F.array(F.lit("COPYRIGHT"))).otherwise(named(s))))


def rule_pattern(sequence: list[str]) -> str:
    """A rule as a regular expression over identifiers between bars."""
    one = lambda x: rf"(?:\|(?:UNKNOWN|COPYRIGHT|RESERVED)\|){{0,{RUNS}}}" if x == "~" else rf"(?:\|{x[1:-1]}\|)?" if x.startswith("[") else f"(?:{rule_pattern(x[1:-1].split())})?" if x.startswith("(") else rf"\|{x}\|"
    return "".join(map(one, sequence))


def licences(ids: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Licences whose rules fire on a sequence of identifiers, each once, in the order of the rules. Runs of unknown sentences are one."""
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(seq)).alias("pattern")) for name, seq in rules])
    runs = F.filter(ids, lambda x, i: (x != "UNKNOWN") | (i == 0) | (F.get(ids, i - 1) != "UNKNOWN"))
    line = F.array_join(F.transform(runs, lambda s: F.concat(F.lit("|"), s, F.lit("|"))), "")
    start = F.struct(line.alias("line"), F.array().cast("array<string>").alias("found"))

    def fire(state, rule):
        hit = F.rlike(state["line"], rule["pattern"]) & ((rule["name"] != LAST) | (F.size(state["found"]) == 0))
        return F.struct(F.regexp_replace(state["line"], rule["pattern"], F.lit("#")).alias("line"), F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    return F.array_distinct(F.aggregate(table, start, fire)["found"])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, sentence_ids array, licences array of every row."""
    found = docs.select(id_col, sentence_ids(text_col).alias("sentence_ids"))
    return found.withColumn("licences", F.when(F.size("sentence_ids") > 0, licences(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))
