"""Licence scan by sentence rules.

Texts are split into sentences and normalised (lower case, the scheme and www. of addresses left out, runs of other
characters than letters and digits become one space).  Known sentences may have slots, for names of holders: what stands
between two fixed parts, up to SLOT words, is replaced by the slot's mark, also over line breaks.  A sentence may be wrapped: pieces that line breaks part, with any comment marks, are joined where they make up a
known sentence or a slot's, the longest first; blank lines within are passed over, as headers set addresses apart by them.  A line that
is a known sentence itself, and no part of a longer one, counts alone.  Known sentences have identifiers; a document's
identifiers in order form a sequence, on which the rules are matched, those of more sentences first and else in their order:
each takes all its non-overlapping occurrences from the left and removes them from what later rules see, so a whole licence
text isn't also reported as its parts.  All of that is done text by text, so no row is shuffled.

Defined results: null and empty texts and those without a known sentence give no row; each row is a document of its own,
also rows of one id or of none; repeated sentences count each; of rules that fit the same place the first in order counts;
long texts are scanned whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-notice-long": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-name": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "This work is dedicated to the public domain under CC0 1.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd-warranty": _WARRANTY,
    "bsd0-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "zlib-warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-name": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense-released": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl-do": "You just DO WHAT THE FUCK YOU WANT TO.",
    "apache-title": "Apache License\nVersion 2.0, January 2004",
    "mit-notice-under": "Licensed under the MIT License.",
    "mit-notice-this": "This project is licensed under the MIT License.",
    "bsd-names": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-its": "Neither the name of {} nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-style": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-only-terms": "This program is free software; you can redistribute it and/or modify it under the terms of version 2 of the GNU General Public License as published by the Free Software Foundation.",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "epl2-title": "Eclipse Public License - v 2.0",
    "cc0-title": "CC0 1.0 Universal",
    "artistic2-title": "The Artistic License 2.0",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
}
# Rules in the order of matching; each is a licence and a sequence of sentence identifiers.
RULES = [
    ("Apache-2.0", ("apache-notice-long", "apache-obtain", "apache-basis", "apache-see")),
    ("MIT", ("mit-name", "mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-see")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("Apache-2.0", ("apache-notice-long",)),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-name",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("Zlib", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("Unlicense", ("unlicense-released", "unlicense-anyone")),
    ("Unlicense", ("unlicense-released",)),
    ("0BSD", ("bsd0-grant",)),
    ("BSL-1.0", ("boost-name",)),
    ("BSL-1.0", ("boost-notice",)),
    ("WTFPL", ("wtfpl-do",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advert")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name-its")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", ("bsd-style",)),
    ("Apache-2.0", ("apache-title",)),
    ("MIT", ("mit-notice-under",)),
    ("MIT", ("mit-notice-this",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("GPL-2.0-only", ("gpl2-only-terms",)),
    ("GPL-3.0-only", ("gpl3-only",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("EPL-2.0", ("epl2-title",)),
    ("CC0-1.0", ("cc0-title",)),
    ("Artistic-2.0", ("artistic2-title",)),
]


def _add_families() -> None:
    """Notices that differ in name, version and wording alone, made by rule."""
    kinds = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    for kind, words in kinds.items():
        for version in ("2.0", "3.0", "4.0"):
            license_, scope = f"CC-{kind}-{version}", "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            forms = {"short": f"Licensed under CC {kind} {version}.", "long": f"This work is licensed under a Creative Commons {words} {version} {scope} License.", "the": f"This work is licensed under the Creative Commons {words} {version} {scope} License."}
            for form, text in forms.items():
                if text not in SENTENCES.values():
                    SENTENCES[f"{license_}-{form}"] = text
                    RULES.append((license_, (f"{license_}-{form}",)))
    for short, name in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License")):
        subject = "library" if short == "LGPL" else "program"
        for version in ("2", "2.1", "3"):
            for mark in (":", ";"):
                text = f"This {subject} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
                whole, key = f"{short}-{version if '.' in version else version + '.0'}-or-later", f"{short}-{version}-free{len(SENTENCES)}"
                if normalise(text) not in map(normalise, SENTENCES.values()):
                    SENTENCES[key] = text
                    RULES.append((whole, (key,)))


    for license_ in SPDX:
        if f"spdx-{license_}" not in SENTENCES:
            SENTENCES[f"spdx-{license_}"] = f"SPDX-License-Identifier: {license_}"
            RULES.append((license_, (f"spdx-{license_}",)))


# Identifiers that tags may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
TAG, TAGGED = r"spdx-license-identifier:[ \t]*", "spdx-license-identifier "  # a tag and its identifier are one sentence
BREAK = r"[.:!?][ \t]+|[\r\n]+"
ADDRESS = r"https?://(?:www[.])?"
OTHER = r"[^a-z0-9]+"
SLOT = 12  # words that a slot may hold


def normalise(sentence: str) -> str:
    return re.sub(OTHER, " ", re.sub(ADDRESS, "", sentence.lower())).strip()


_add_families()


class Known:
    """Known sentences, piece by piece between breaks: marks of plain pieces, slots, and the sequence of marks of each sentence.

    A piece that several sentences share has one mark, that of the first.
    """

    def __init__(self, sentences: dict[str, str]):
        pieces = {name: [p for p in re.split(BREAK, re.sub(TAG, TAGGED, text.lower())) if normalise(p)] for name, text in sentences.items()}
        number = {name: i for i, name in enumerate(sentences, 1)}
        self.plain: dict[str, str] = {}
        self.slots: dict[tuple[str, str], str] = {}
        self.marks: dict[str, str] = {}
        for name, parts in pieces.items():
            marks = []
            for k, piece in enumerate(parts):
                before, slot, after = piece.partition("{}")
                kept = self.slots.setdefault((normalise(before), normalise(after)), f"<{number[name]}.{k}>") if slot else self.plain.setdefault(normalise(piece), f"<{number[name]}.{k}>")
                marks.append(kept)
            self.marks[name] = "".join(marks)


def known_sentences(known: Known) -> Callable[[str], list[tuple[int, str]]]:
    """A function from a text to (position, mark) of the known sentences in it; positions number the pieces between breaks."""
    words = [sentence.split(" ") for sentence in known.plain]
    begun = {" ".join(w[:n]) for w in words for n in range(1, len(w))}
    starts = {" ".join(before.split(" ")[:n]) for before, _ in known.slots for n in range(1, len(before.split(" ")) + 1)}
    split, other, address = re.compile(f"({BREAK})").split, re.compile(OTHER).sub, re.compile(ADDRESS).sub
    longest = max((len(f"{b} {a}".split(" ")) for b, a in known.slots), default=0) + SLOT

    def filled(whole: str) -> str | None:
        for (before, after), mark in known.slots.items():
            if whole.startswith(f"{before} ") and whole.endswith(f" {after}") and 1 <= len(whole[len(before) : len(whole) - len(after)].split()) <= SLOT:
                return mark
        return None

    def may_fill(whole: str) -> bool:
        """Whether a slot's sentence may begin like this: by a part of its first words, or all of them and some more."""
        return whole in starts or len(whole.split(" ", longest)) <= longest and any(whole.startswith(f"{before} ") for before, _ in known.slots)

    def find(text: str) -> list[tuple[int, str]]:
        low = text.lower()
        parts = split(re.sub(TAG, TAGGED, low) if "spdx" in low else low)
        pieces = [other(" ", address("", p)).strip() for p in parts[::2]]
        found, at = [], 0
        while at < len(pieces):
            whole, after = pieces[at], at + 1
            mark = known.plain.get(whole) or filled(whole)
            if whole in begun or may_fill(whole):
                for i in range(at + 1, len(pieces)):
                    if parts[2 * i - 1][0] not in "\r\n":
                        break
                    if pieces[i]:
                        whole = f"{whole} {pieces[i]}"
                        if here := known.plain.get(whole) or filled(whole):
                            mark, after = here, i + 1
                        if whole not in begun and not may_fill(whole):
                            break
            if mark is not None:
                found.append((at, mark))
            at = after
        return found

    return find


def _by_length(rules: list[tuple[str, tuple[str, ...]]]) -> list[int]:
    """Places of the rules in the order of matching."""
    return sorted(range(len(rules)), key=lambda i: -len(rules[i][1]))


def license_findings(docs: DataFrame, *, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rule (its number from 1), license, matches, sentences (known ones in the document)."""
    known = Known(sentences)
    sequences, order = ["".join(known.marks[name] for name in names) for _, names in rules], _by_length(rules)
    kind = docs.schema[id_col].dataType.simpleString()

    def matched(marks: list[str]) -> Iterator[tuple[int, str, int]]:
        left = "".join(marks)
        for i in order:
            sequence = sequences[i]
            if sequence in left:
                yield i + 1, rules[i][0], left.count(sequence)
                left = left.replace(sequence, "|")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = known_sentences(known)
        for frame in frames:
            rows = []
            for key, text in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                if text and (marks := [mark for _, mark in find(text)]):
                    rows += [(key, *found, len(marks)) for found in matched(marks)]
            yield pd.DataFrame(rows, columns=[id_col, "rule", "license", "matches", "sentences"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInPandas(run, f"{id_col} {kind}, rule int, license string, matches long, sentences long")


def oracle(sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> str:
    """DuckDB SQL for license_findings over documents; it splits at every line break, so it has no sentences that are wrapped."""
    known = Known(sentences)
    marks = known.marks
    values = ", ".join(f"('{p}', '{m}')" for p, m in known.plain.items())
    slots = ", ".join(f"('{b} ', ' {a}', '{m}', {i})" for i, ((b, a), m) in enumerate(known.slots.items()))
    steps, last = [], "s0"
    for step, i in enumerate(_by_length(rules), 1):
        sequence = "".join(marks[n] for n in rules[i][1])
        steps.append(f"s{step} AS (SELECT *, (length(l{step - 1}) - length(replace(l{step - 1}, '{sequence}', ''))) // {len(sequence)} AS r{i + 1}, replace(l{step - 1}, '{sequence}', '|') AS l{step} FROM {last})")
        last = f"s{step}"
    rows = " UNION ALL ".join(f"SELECT doc_id, {i} AS rule, '{name}' AS license, r{i} AS matches, sentences FROM {last} WHERE r{i} > 0" for i, (name, _) in enumerate(rules, 1))
    return f"""WITH known(sentence, mark) AS (VALUES {values}), slots(before, after, mark, i) AS (VALUES {slots}),
pieces AS (SELECT doc_id, unnest(string_split_regex(t, '{BREAK}')) AS piece, generate_subscripts(string_split_regex(t, '{BREAK}'), 1) AS pos FROM (SELECT doc_id, regexp_replace(lower(text), '{TAG}', '{TAGGED}', 'g') AS t FROM documents)),
s0 AS (SELECT doc_id, string_agg(mark, '' ORDER BY pos, mark) AS l0, count(*) AS sentences FROM (SELECT doc_id, pos, coalesce(k.mark, s.mark) AS mark FROM (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(lower(piece), '{ADDRESS}', '', 'g'), '{OTHER}', ' ', 'g')) AS sentence FROM pieces) p LEFT JOIN known k USING (sentence)
  LEFT JOIN slots s ON k.mark IS NULL AND starts_with(sentence, before) AND ends_with(sentence, after) AND length(sentence) > length(before) + length(after) AND len(string_split(substr(sentence, length(before) + 1, length(sentence) - length(before) - length(after)), ' ')) <= {SLOT} WHERE coalesce(k.mark, s.mark) IS NOT NULL) GROUP BY doc_id),
{", ".join(steps)}
{rows}"""
