"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, single line breaks (and comment marks after them) being spaces. Each sentence is normalised and known
licence sentences are looked for in it. The document becomes a string of identifiers, '<7>' for a known sentence and '.' for a
sentence without one, and ordered rules are matched against it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Sentences of public licence texts, by identifier.
SENTENCES = {
    "apache_notice_long": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache_copy": "You may obtain a copy of the License at",
    "apache_basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache_see": "See the License for the specific language governing permissions and limitations under the License",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "gpl3_grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_grant": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl_see": "See the GNU General Public License for more details",
    "lgpl3_grant": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl21_grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl_hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl_see": "See the GNU Lesser General Public License for more details",
    "agpl3_grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl_see": "See the GNU Affero General Public License for more details",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd_disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED',
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "zerobsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc_disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS',
    "mpl_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "epl_available": "made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense_free": "This is free and unencumbered software released into the public domain",
    "unlicense_anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "cc0_extent": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "cc0_copy": "You should have received a copy of the CC0 Public Domain Dedication along with this software",
    "boost_grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    "zlib_as_is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib_liability": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}
#: Licence -> (prefix of its identifiers, names by which notices refer to it, rules in order); a rule is a name and the
#: sentences that have to follow each other.
LICENSES = {
    "Apache-2.0": ("apache", ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license"), (("apache_header", ("apache_notice_long", "apache_copy", "apache_basis", "apache_see")), ("apache_header_short", ("apache_notice_long",)))),
    "MIT": ("mit", ("the MIT License", "MIT License"), (("mit_text", ("mit_grant", "mit_condition", "mit_disclaimer")), ("mit_grant_only", ("mit_grant",)))),
    "GPL-3.0": ("gpl3", ("the GNU General Public License, version 3", "the GNU General Public License v3", "the GPLv3", "GPLv3"), (("gpl3_header", ("gpl3_grant", "gpl_hope", "gpl_see")), ("gpl3_grant_only", ("gpl3_grant",)))),
    "GPL-2.0": ("gpl2", ("the GNU General Public License, version 2", "the GNU General Public License v2", "the GPLv2", "GPLv2"), (("gpl2_header", ("gpl2_grant", "gpl_hope", "gpl_see")), ("gpl2_grant_only", ("gpl2_grant",)))),
    "LGPL-3.0": ("lgpl3", ("the GNU Lesser General Public License, version 3", "the LGPLv3", "LGPLv3"), (("lgpl3_header", ("lgpl3_grant", "lgpl_hope", "lgpl_see")), ("lgpl3_grant_only", ("lgpl3_grant",)))),
    "LGPL-2.1": ("lgpl21", ("the GNU Lesser General Public License, version 2.1", "the LGPLv2.1", "LGPLv2.1"), (("lgpl21_header", ("lgpl21_grant", "lgpl_hope", "lgpl_see")), ("lgpl21_grant_only", ("lgpl21_grant",)))),
    "AGPL-3.0": ("agpl3", ("the GNU Affero General Public License, version 3", "the AGPLv3", "AGPLv3"), (("agpl3_header", ("agpl3_grant", "gpl_hope", "agpl_see")), ("agpl3_grant_only", ("agpl3_grant",)))),
    "BSD-3-Clause": ("bsd3", ("the BSD 3-Clause License", "a 3-clause BSD license", "the 3-clause BSD license"), (("bsd3_text", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_disclaimer")), ("bsd3_conditions", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")))),
    "BSD-2-Clause": ("bsd2", ("the BSD 2-Clause License", "a 2-clause BSD license", "the 2-clause BSD license"), (("bsd2_text", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_disclaimer")), ("bsd2_conditions", ("bsd_grant", "bsd_source", "bsd_binary")), ("bsd_grant_only", ("bsd_grant",)))),
    "ISC": ("isc", ("the ISC License",), (("isc_text", ("isc_grant", "isc_disclaimer")), ("isc_grant_only", ("isc_grant",)))),
    "0BSD": ("zerobsd", ("the Zero-Clause BSD License",), (("zerobsd_text", ("zerobsd_grant", "isc_disclaimer")),)),
    "MPL-2.0": ("mpl", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"), (("mpl_header", ("mpl_subject", "mpl_copy")), ("mpl_subject_only", ("mpl_subject",)))),
    "EPL-2.0": ("epl", ("the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"), (("epl_header", ("epl_available",)),)),
    "Unlicense": ("unlicense", ("the Unlicense",), (("unlicense_text", ("unlicense_free", "unlicense_anyone")), ("unlicense_free_only", ("unlicense_free",)))),
    "CC0-1.0": ("cc0", ("CC0 1.0", "the CC0 1.0 Universal license"), (("cc0_text", ("cc0_extent", "cc0_copy")), ("cc0_extent_only", ("cc0_extent",)))),
    "BSL-1.0": ("boost", ("the Boost Software License, Version 1.0",), (("boost_text", ("boost_grant",)),)),
    "Zlib": ("zlib", ("the zlib License",), (("zlib_text", ("zlib_as_is", "zlib_liability", "zlib_grant")), ("zlib_grant_only", ("zlib_grant",)))),
    "CC-BY-4.0": ("cc_by", ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"), ()),
    "CC-BY-SA-4.0": ("cc_by_sa", ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"), ()),
    "CC-BY-NC-4.0": ("cc_by_nc", ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"), ()),
}
#: What comes before a licence's name in a notice, words that take a notice back, and the tag that names a licence by its identifier.
NOTICES, TAG = tuple(f"{verb} under{terms}" for verb in ("Licensed", "Released", "Distributed", "Available") for terms in ("", " the terms of")), "SPDX-License-Identifier:"
DENIALS = ("not", "never", "longer")
#: Public identifiers that begin like one of LICENSES but name other licences; the scan knows them, no rule does.
OTHER_IDS = (
    "MIT-0 MIT-CMU MIT-Modern-Variant MIT-advertising MIT-enna MIT-feh MIT-open-group MIT-Wu MIT-testregex BSD-2-Clause-Patent BSD-2-Clause-Views BSD-2-Clause-NetBSD BSD-2-Clause-FreeBSD BSD-2-Clause-Darwin BSD-3-Clause-Attribution "
    "BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-No-Military-License BSD-3-Clause-No-Nuclear-License BSD-3-Clause-No-Nuclear-License-2014 BSD-3-Clause-No-Nuclear-Warranty BSD-3-Clause-Open-MPI "
    "BSD-3-Clause-Sun BSD-3-Clause-acpica BSD-3-Clause-flex BSD-3-Clause-HP ISC-Veillard MPL-2.0-no-copyleft-exception Zlib-acknowledgement CC-BY-4.0-DE"
)
#: Identifiers of a version alone and of later ones too, by the licence that they belong to.
VERSIONS = {f"{x}{end}": x for x in ("GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0") for end in ("-only", "-or-later")}
#: What joins identifiers in a tag's expression; each side counts.
OPERATORS = ("AND", "OR")
#: A licence whose rules count only where the other's don't.
UNLESS = {"BSD-2-Clause": "BSD-3-Clause"}
#: Parts of words of which each known sentence has one; sentences without any aren't searched.
ANCHORS = ("licens", "permission", "redistribut", "software", "warrant", "copy", "copies", "under")
#: Unknown sentences that may stand between two of a rule.
GAP = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences, blank lines (but for comment marks) and numbers of list items; other line breaks join.
_MARKS = "[ \\t#*/%!|-]*"
_SPLIT, _OTHER = f"[.!?;]+[ \\t\\n]+|\\n{_MARKS}\\n|\\n{_MARKS}[0-9]+[.)][ \\t]", "[^a-z0-9]+"


def normalised(text: str) -> list[str]:
    """Sentences of a known text as the scan sees them (one with a semicolon inside counts as two)."""
    parts = re.split(_SPLIT, text.translate(str.maketrans(_UPPER, _LOWER)).replace("licence", "license"))
    return [x for x in (re.sub(_OTHER, " ", p).strip(" ") for p in parts) if x]


def known() -> tuple[dict[str, int], dict[str, list[int]]]:
    """Normalised sentence -> number, the longest sentence first; and the numbers that each identifier's text gives.

    All notices of one licence have one number, so have its tags and its places after an operator; what is denied, and identifiers
    of other licences, have numbers of their own.
    """
    found: dict[str, int] = {}
    numbers: dict[str, list[int]] = {}
    for name, text in SENTENCES.items():
        numbers[name] = [found.setdefault(part, len(found) + 1) for part in normalised(text)]
    last = len(found)

    def add(name: str, texts: list[str]) -> None:
        nonlocal last
        last += 1
        numbers[name] = [last]
        for t in texts:
            found.setdefault(normalised(t)[0], last)

    denied = []
    for licence, (prefix, names, _) in LICENSES.items():
        forms = [f"{verb} {x}" for verb in NOTICES for x in (*names, licence)]
        ids = [licence, *(v for v, of in VERSIONS.items() if of == licence)]
        denied += [f"{no} {x}" for no in DENIALS for x in forms]
        add(f"{prefix}_notice", forms)
        add(f"{prefix}_spdx", [f"{TAG} {x}" for x in ids])
        add(f"{prefix}_joined", [f"{op} {x}" for op in OPERATORS for x in ids])
    add("denied", denied)
    add("other_spdx", [f"{TAG} {x}" for x in OTHER_IDS.split()])
    add("other_joined", [f"{op} {x}" for op in OPERATORS for x in OTHER_IDS.split()])
    return dict(sorted(found.items(), key=lambda x: (-len(x[0]), x[0]))), numbers


def rule_patterns() -> dict[str, list[tuple[str, str]]]:
    """Licence -> (rule, pattern over identifier strings) in order: texts, then notices, then tags."""
    _, numbers = known()

    def pattern(sentences: tuple[str, ...]) -> str:
        return f"[.]{{0,{GAP}}}".join(f"<{k}>" for s in sentences for k in numbers[s])

    tags, joined = ("|".join(f"<{numbers[n][0]}>" for n in sorted(numbers) if n.endswith(end)) for end in ("_spdx", "_joined"))
    return {
        licence: [
            *((name, pattern(sentences)) for name, sentences in rules), (f"{prefix}_reference", pattern((f"{prefix}_notice",))), (f"{prefix}_tag", pattern((f"{prefix}_spdx",))),
            (f"{prefix}_expression", f"({tags})({joined})*{pattern((f'{prefix}_joined',))}"),
        ]
        for licence, (prefix, _, rules) in LICENSES.items()
    }


def _trie(words: list[str]) -> str:
    """A pattern of the words in which those that begin alike share their beginning; of several that fit the longest counts."""
    ends, rest = "" in words, {}
    for w in filter(None, words):
        rest.setdefault(w[0], []).append(w[1:])
    parts = [c + _trie(tails) for c, tails in sorted(rest.items())]
    if not parts:
        return ""
    if len(parts) == 1 and not ends:
        return parts[0]
    return f"(?:{'|'.join(parts)})" + ("?" if ends else "")


def _search() -> str:
    return f"\\b({_trie(list(known()[0]))})\\b"


def scan_licenses(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, rules, licenses (comma-joined in the order of LICENSES; empty if none) for every document.

    One pass without a shuffle or a join: the known sentences are one pattern, tried only on sentences with one of ANCHORS (a text
    without any has no known sentence), and rules are tried only on documents with a known sentence. A known sentence counts wherever it stands, as part of a longer one too; of
    those that begin at one place the longest counts, so an identifier ends where a longer one doesn't go on, and a denied notice is none.
    Every identifier of a tag's expression counts. n_known counts occurrences. Whole texts count; of a licence with several
    matching rules the first is reported.

    Null or empty text: no sentences, empty strings. Null ids and repeated rows keep their row; an empty table gives no rows; other
    columns are ignored.
    """
    found, _ = known()
    texts, numbers = F.array(*map(F.lit, found)), F.array(*map(F.lit, found.values()))

    def hits(sentence: Column) -> Column:
        matches = F.regexp_extract_all(sentence, F.lit(_search()), F.lit(1))
        return F.array_join(F.transform(matches, lambda m: F.concat(F.lit("<"), F.element_at(numbers, F.array_position(texts, m).cast("int")).cast("string"), F.lit(">"))), "")

    def anchored(text: Column) -> Column:
        return reduce(Column.__or__, [text.contains(a) for a in ANCHORS])

    def mark(sentence: Column) -> Column:
        return F.when(anchored(sentence), F.coalesce(F.nullif(hits(sentence), F.lit("")), F.lit("."))).otherwise(".")

    lower = F.replace(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER), F.lit("licence"), F.lit("license"))
    clean = F.filter(F.transform(F.split(F.regexp_replace(lower, "\r\n?", "\n"), _SPLIT), lambda s: F.trim(F.regexp_replace(s, _OTHER, " "))), lambda s: s != "")
    cut = documents.select(F.col("doc_id").alias("doc_id"), clean.alias("sentences"), anchored(lower).alias("searched"))
    placed = cut.select("doc_id", F.size("sentences").alias("n_sentences"), F.when(F.col("searched"), F.array_join(F.transform("sentences", mark), "")).otherwise("").alias("marks"))
    marked = placed.withColumn("n_known", F.length(F.regexp_replace("marks", "[^<]", "")))
    matched = {}
    for k, (licence, rules) in enumerate(rule_patterns().items()):
        hit = F.lit(None).cast("string")
        for name, pattern in reversed(rules):
            hit = F.when(F.col("marks").rlike(pattern), name).otherwise(hit)
        matched[licence] = F.when(F.col("n_known") > 0, hit).alias(f"_{k}")
    found_rules = marked.select("doc_id", "n_sentences", "n_known", *matched.values())
    at = {licence: F.col(f"_{k}") for k, licence in enumerate(matched)}
    counted = {licence: F.when(at[UNLESS[licence]].isNull(), c) if licence in UNLESS else c for licence, c in at.items()}
    names = F.concat_ws(",", *(F.when(c.isNotNull(), licence) for licence, c in counted.items()))
    return found_rules.select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.col("n_known").cast("long").alias("n_known"), F.concat_ws(",", *counted.values()).alias("rules"), names.alias("licenses"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    found, _ = known()
    texts, numbers = ", ".join(f"'{s}'" for s in found), ", ".join(map(str, found.values()))
    at = {licence: f"r{k}" for k, licence in enumerate(LICENSES)}
    hits = []
    for licence, rules in rule_patterns().items():
        tries = " ".join(f"when regexp_matches(marks, '{p}') then '{n}'" for n, p in rules)
        hits.append(f"case when n_known > 0 then case {tries} end end as {at[licence]}")
    counted = {licence: f"case when {at[UNLESS[licence]]} is null then {c} end" if licence in UNLESS else c for licence, c in at.items()}
    names = ", ".join(f"case when {c} is not null then '{licence}' end" for licence, c in counted.items())
    # a sentence's known sentences in the order in which they stand
    mark = f"array_to_string(list_transform(regexp_extract_all(x, '{_search()}', 1), lambda m: '<' || ([{numbers}])[list_position([{texts}], m)] || '>'), '')"
    return f"""
with cut as (
  select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), 'licence', 'license'), '\\r\\n?', chr(10), 'g'), '{_SPLIT}'),
    lambda x: trim(regexp_replace(x, '{_OTHER}', ' ', 'g'))), lambda x: x <> '') as s from documents),
placed as (
  select doc_id, len(s) as n_sentences,
    array_to_string(list_transform(s, lambda x: case when regexp_matches(x, '{"|".join(ANCHORS)}') then coalesce(nullif({mark}, ''), '.') else '.' end), '') as marks from cut),
marked as (select *, len(regexp_replace(marks, '[^<]', '', 'g')) as n_known from placed),
hit as (select *, {', '.join(hits)} from marked)
select doc_id, n_sentences, n_known, concat_ws(',', {', '.join(counted.values())}) as rules, concat_ws(',', {names}) as licenses from hit
"""


OP2_SQL = _oracle()
