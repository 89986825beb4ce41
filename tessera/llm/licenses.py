"""License scans by sentence rules.

A text is cut into sentences; each is normalised (lower case, runs of other
than letters and digits become one space) and looked up among the known
license sentences, giving a sequence of sentence identifiers. Ordered rules
over that sequence name the licenses: the identifiers of a rule must follow
one another with nothing else known between them; the first rule that fits
takes its identifiers, later rules see only the rest. Identifiers that no rule
took are reported as license language without a verdict.

A sentence may be wrapped over lines or stand on a line without a full stop,
so both readings of a line break are made and the one that recognises more
sentences is used (the plain reading, a break ends a sentence, on a tie).
The colon of an SPDX tag line ends no sentence, so a tag and its identifier are
one; a tag that joins several (``MIT OR Apache-2.0``) is not known. The BSD
clause that protects a name is known with any name in it, unless a full stop
with a blank stands inside the name (then its end is looked up).
Every known sentence holds one of a few cue words (asserted below), so texts
without a cue skip the work with the same result.

All of it is DataFrame expressions over one scan: no join, no shuffle, no
Python in tasks. The rule tables are fixed values of the program.

Defined results: null and empty texts have no sentences; an empty table gives
an empty result; texts of any length are scanned whole; repeated rows are
scanned each on its own; a sentence counted twice stays twice in the sequence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

# Known license sentences in normalised form, by identifier.
SENTENCES = {
    "mit-short": "released under the mit license",
    "mit-short2": "licensed under the mit license",
    "mit-name": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or "
                  "substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not "
             "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-short": "licensed under the apache license version 2 0",
    "apache-head": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-short2": "licensed under the gnu general public license version 3",
    # the wordings with commas only; the standard notices, which the splitter cuts, follow in NOTICES
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                "general public license as published by the free software foundation either version 3 of the license "
                "or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even "
                "the implied warranty of merchantability or fitness for a particular purpose",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted "
                 "provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and "
                  "the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions "
                  "and the following disclaimer in the documentation and or other materials provided with the "
                  "distribution",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee "
                 "is hereby granted provided that the above copyright notice and this permission notice appear in "
                 "all copies",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "rights": "copyright all rights reserved",
}
#: Sentences of standard license texts in their own wording, each as the splitter cuts it.
NOTICES = {
    # "This program is free software: you can" is cut at the colon (GPL 3) or semicolon (GPL 2)
    "hope": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                 "promote products derived from this software without specific prior written permission.",
    "bsd-names5": "The name of the author may not be used to endorse or promote products derived from this software "
                  "without specific prior written permission.",
    # the rest of "Neither the name of X Inc. nor"
    "bsd-names6": "nor the names of its contributors may be used to endorse or promote products derived from this "
                  "software without specific prior written permission.",
    # "Mozilla Public License, v. 2.0. If a copy": cut after "v." and after "2.0."
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at "
                  "https://mozilla.org/MPL/2.0/.",
    "mpl-obtain2": "If a copy of the MPL was not distributed with this file, You can obtain one at "
                   "http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse "
                   "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "epl2-notice2": "This program and the accompanying materials are made available under the terms of the Eclipse "
                    "Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0.",
    "epl2-notice3": "This program and the accompanying materials are made available under the terms of the Eclipse "
                    "Public License v2.0 which accompanies this distribution, and is available at "
                    "https://www.eclipse.org/legal/epl-v20.html",
    # the same read line by line, as its standard wrapping stands in comments
    "epl2-line": "terms of the Eclipse Public License 2.0 which is available at",
    "epl2-title": "Eclipse Public License - v 2.0",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse "
                   "Public License v1.0 which accompanies this distribution, and is available at "
                   "http://www.eclipse.org/legal/epl-v10.html",
    "epl1-title": "Eclipse Public License - v 1.0",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
}
NOTICE_RULES = []
# Free Software Foundation notices: "...; either version V" is two sentences, "..., either version V" is one
for _l, _name, _versions in (("gpl", "GNU General Public License", ("2", "3")), ("agpl", "GNU Affero General Public License", ("3",)),
                             ("lgpl", "GNU Lesser General Public License", ("2", "2.1", "3")),
                             ("lgpl2", "GNU Library General Public License", ("2",))):
    _grant = f"you can redistribute it and/or modify it under the terms of the {_name}"
    _by = "as published by the Free Software Foundation"
    NOTICES[f"{_l}-terms"] = f"{_grant} {_by}"
    for _v in _versions:
        _id = _v.replace(".", "")
        _any, _one = f"either version {_v} of the License, or (at your option) any later version", f"version {_v} of the License"
        NOTICES |= {f"v{_id}-later": _any, f"v{_id}-only": _one,
                    f"{_l}-{_id}-later": f"{_grant} {_by}, {_any}", f"{_l}-{_id}-only": f"{_grant} {_by}, {_one}",
                    f"{_l}-{_id}-named": f"{_grant} version {_v} {_by}"}
        _spdx = f"{_l.rstrip('2').upper()}-{_v if '.' in _v else _v + '.0'}"
        for _mode, _seqs in (("or-later", [[f"{_l}-terms", f"v{_id}-later"], [f"{_l}-{_id}-later"]]),
                             ("only", [[f"{_l}-terms", f"v{_id}-only"], [f"{_l}-{_id}-only"], [f"{_l}-{_id}-named"]])):
            NOTICE_RULES += [(f"{_spdx}-{_mode}", "copyleft", _s + _end) for _end in (["hope"], []) for _s in _seqs]
# SPDX identifiers that a tag line may name, by kind.
TAGS = {
    "permissive": "MIT ISC 0BSD BSD-2-Clause BSD-3-Clause Apache-2.0 Zlib BSL-1.0 Artistic-2.0 Unlicense CC0-1.0 CC-BY-4.0",
    "copyleft": "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later "
                "LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-1.0 EPL-2.0 CC-BY-SA-4.0",
    "noncommercial": "CC-BY-NC-4.0 CC-BY-NC-SA-4.0",
}
# Creative Commons 4.0 licenses by the words of their deeds.
DEEDS = {"CC-BY-4.0": ("Attribution", "permissive"), "CC-BY-SA-4.0": ("Attribution-ShareAlike", "copyleft"),
         "CC-BY-NC-4.0": ("Attribution-NonCommercial", "noncommercial"),
         "CC-BY-NC-SA-4.0": ("Attribution-NonCommercial-ShareAlike", "noncommercial")}
TAG_RULES = []
for _kind, _tags in TAGS.items():
    for _tag in _tags.split():
        NOTICES[f"spdx-{_tag.replace('.', '').lower()}"] = f"SPDX-License-Identifier: {_tag}"
        TAG_RULES.append((_tag, _kind, [f"spdx-{_tag.replace('.', '').lower()}"]))
for _name, (_words, _kind) in DEEDS.items():
    for _i, _lead in enumerate(("This work is licensed under a", "This work is licensed under the", "Licensed under a")):
        _id = f"deed-{_name[:-4].lower()}-{_i}"
        NOTICES[_id] = f"{_lead} Creative Commons {_words} 4.0 International License."
        TAG_RULES.append((_name, _kind, [_id]))
# Ordered rules (license, kind, identifiers in sequence).
RULES = [
    ("MIT", "permissive", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", "permissive", ["mit-grant", "mit-notice"]),
    ("ISC", "permissive", ["isc-grant"]),
    *(("BSD-3-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary", f"bsd-names{i}"])
      for i in ("", "5", "6")),
    ("BSD-2-Clause", "permissive", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", "permissive", ["apache-head", "apache-comply", "apache-copy"]),
    *NOTICE_RULES,
    ("GPL-3.0-or-later", "copyleft", ["gpl-free", "gpl-hope"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl-free"]),
    ("Apache-2.0", "permissive", ["apache-short"]),
    ("Apache-2.0", "permissive", ["apache-head"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-short"]),
    ("GPL-3.0-only", "copyleft", ["gpl3-short2"]),
    ("MPL-2.0", "copyleft", ["mpl"]),
    ("MPL-2.0", "copyleft", ["mpl-form", "mpl-obtain"]),
    ("MPL-2.0", "copyleft", ["mpl-form", "mpl-obtain2"]),
    ("LGPL-3.0-only", "copyleft", ["lgpl3-title"]),
    *(("EPL-2.0", "copyleft", [f"epl2-{i}"]) for i in ("notice", "notice2", "notice3", "line", "title")),
    *(("EPL-1.0", "copyleft", [f"epl1-{i}"]) for i in ("notice", "title")),
    *TAG_RULES,
    ("Unlicense", "permissive", ["unlicense", "as-is"]),
    ("Unlicense", "permissive", ["unlicense"]),
    ("CC-BY-NC-4.0", "noncommercial", ["cc-by-nc"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc-by-sa"]),
    ("CC-BY-4.0", "permissive", ["cc-by"]),
    ("CC0-1.0", "permissive", ["cc0"]),
    ("MIT", "permissive", ["mit-short"]),
    ("MIT", "permissive", ["mit-short2"]),
    ("MIT", "permissive", ["mit-name"]),
]
#: Every known sentence holds one of these.
CUES = ("licen", "permi", "warrant", "copyright", "redistribut", "mozilla", "unencumbered")
STOP_RE = r"[.!?:;](?=\s|$)"
#: The colon of a tag line ends no sentence.
TAG = "spdx-license-identifier"
#: A sentence with a free name: what a normalised sentence begins with, and with what name it is looked up.
SLOT_START, SLOT_END = "neither the name of ", " nor the names of its contributors "
SLOT_RE, SLOT_NAME = f"^{SLOT_START}.+{SLOT_END}", f"{SLOT_START}the copyright holder{SLOT_END}"


def cut(text: str) -> list[str]:
    """The normalised sentences of a text: what ``sentence_ids`` looks up, with soft line breaks."""
    parts = re.split(STOP_RE + r"|\n[ \t\r]*\n", text.lower().replace(TAG + ":", TAG + " "))
    plain = (re.sub(r"[\W_]+", " ", p).strip() for p in parts)
    return [re.sub(SLOT_RE, SLOT_NAME, s) for s in plain if s]


SENTENCES |= {k: cut(s)[-1] for k, s in NOTICES.items()}
assert all(cut(s) == [SENTENCES[k]] for k, s in NOTICES.items())
assert all(any(c in s for c in CUES) for s in SENTENCES.values())
assert len(set(SENTENCES.values())) == len(SENTENCES)


def sentence_ids(text: Column, sentences: dict[str, str], hard_breaks: bool) -> Column:
    """Identifiers of the known sentences of a lower-cased text, in order."""
    stops = STOP_RE + (r"|\n" if hard_breaks else r"|\n[ \t\r]*\n")
    names = F.create_map(*[F.lit(x) for k, s in sentences.items() for x in (s, k)])
    known = F.array(*[F.lit(s) for s in sentences.values()])
    tagged = F.replace(text, F.lit(TAG + ":"), F.lit(TAG + " "))
    plain = F.regexp_replace(F.regexp_replace(tagged, stops, "\x00"), r"[^\x00\p{L}\p{N}]+", " ")
    named = lambda s: F.when(s.startswith(SLOT_START), F.regexp_replace(s, SLOT_RE, SLOT_NAME)).otherwise(s)
    cut = F.transform(F.transform(F.split(plain, "\x00", -1), lambda s: F.btrim(s)), named)
    return let(cut, lambda c: F.when(F.arrays_overlap(c, known), F.transform(
        F.filter(c, lambda s: F.array_contains(known, s)), lambda s: F.try_element_at(names, s)))
        .otherwise(F.array().cast("array<string>")))


def scan_licenses(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None,
                  cues: tuple[str, ...] = CUES) -> DataFrame:
    """Rows of (doc_id, text) -> doc_id, n_sentences (known), sentence_ids, licenses, kind, n_unmatched.

    ``licenses`` is the comma-joined sorted set of matched licenses, ``kind``
    the strictest among their kinds (noncommercial, copyleft, permissive), and
    ``unknown`` for license sentences that no rule takes; both null without any.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id", low.alias("_low")).withColumn("_cue", F.col("_low").rlike("|".join(cues)))
    for name, hard in (("_a", True), ("_b", False)):
        rows = rows.withColumn(name, F.when(F.col("_cue"), sentence_ids(F.col("_low"), sentences, hard)).otherwise(none))
    rows = rows.select("doc_id", F.when(F.size("_b") > F.size("_a"), F.col("_b")).otherwise(F.col("_a")).alias("ids"))
    # the sequence as text, each identifier between bars; a rule that fits leaves a gap mark
    seq = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "")
    empty = F.array().cast("array<string>")
    start = F.struct(seq.alias("left"), empty.alias("names"), empty.alias("kinds"))
    ordered = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"),
                                 F.lit("|" + "||".join(ids) + "|").alias("want")) for n, k, ids in rules])
    apply = lambda a, r: F.when(F.contains(a["left"], r["want"]), F.struct(
        F.replace(a["left"], r["want"], F.lit("#")).alias("left"), F.array_append(a["names"], r["name"]).alias("names"),
        F.array_append(a["kinds"], r["kind"]).alias("kinds"))).otherwise(a)
    # a generator keeps the state from being worked out again for each of its fields
    rows = rows.select("doc_id", "ids", F.inline(F.array(
        F.when(F.size("ids") > 0, F.aggregate(ordered, start, apply)).otherwise(start))).alias("_left", "_n", "_kinds"))
    some = lambda kind: F.array_contains(F.col("_kinds"), kind)
    named = rows.withColumns({
        "_names": F.array_sort(F.array_distinct("_n")),
        "n_unmatched": F.regexp_count("_left", F.lit(r"[a-z0-9-]+")).cast("long"),
    })
    kind = (F.when(some("noncommercial"), F.lit("noncommercial")).when(some("copyleft"), F.lit("copyleft"))
            .when(some("permissive"), F.lit("permissive")).when(F.size("ids") > 0, F.lit("unknown")))
    return named.select("doc_id", F.size("ids").cast("long").alias("n_sentences"),
                        F.array_join("ids", ",").alias("sentence_ids"),
                        F.when(F.size("_names") > 0, F.array_join("_names", ",")).alias("licenses"),
                        kind.alias("kind"), "n_unmatched")
