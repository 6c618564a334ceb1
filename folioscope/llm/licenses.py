"""Licence scans: known sentences by identifier, ordered rules over the identifiers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import packed, text_of
from folioscope.llm.spans import let

# Sentences of licences, as written; they are compared in normal form.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-name": "Released under the MIT License.",
    "mit-name-2": "Licensed under the MIT License.",
    "mit-name-3": "This project is licensed under the MIT License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-name": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3-name": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-zero": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}
# Rules, as sentences that follow one another once unknown sentences are left out.
RULES = {
    "Apache-2.0": [["apache-name"], ["apache-header", "apache-copy", "apache-as-is"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "CC-BY-4.0": [["cc-by"]],
    "CC-BY-NC-4.0": [["cc-by-nc"]],
    "CC-BY-SA-4.0": [["cc-by-sa"]],
    "CC0-1.0": [["cc-zero"]],
    "GPL-2.0-or-later": [["gpl-2-free", "gpl-hope"]],
    "GPL-3.0-only": [["gpl-3-name"]],
    "GPL-3.0-or-later": [["gpl-free", "gpl-hope", "gpl-details"], ["gpl-free", "gpl-hope"]],
    "ISC": [["isc-grant", "isc-warranty"]],
    "MIT": [["mit-grant", "mit-notice", "mit-warranty", "mit-liability"], ["mit-name"], ["mit-name-2"], ["mit-name-3"]],
    "MPL-2.0": [["mpl-subject", "mpl-obtain"]],
    "Unlicense": [["unlicense"]],
    "all-rights-reserved": [["reserved"]],
}
# A rule that holds another one's sentences takes its place.
WIDER = {"BSD-2-Clause": "BSD-3-Clause"}
# A sentence ends at a sign before white space, but not after the "v." of a version; an empty line ends one without a sign.
BREAKS = "(?<=[.!?])(?<!\\bv\\.)[\\x20\\x09-\\x0D]+|\\n[\\x20\\x09\\x0B-\\x0D]*+\\n[\\x20\\x09-\\x0D]*+"
# Every known sentence holds one of these words; texts and sentences without any are not put in normal form.
TRIGGER = "(?i)licen[cs]e|permission|software|redistribution|copyright|rights|contributors|MPL"


def plain(sentence: str) -> str:
    """Normal form: ASCII letters and digits in lower case, single blanks."""
    return " ".join("".join(c.lower() if c.isascii() and c.isalnum() else " " for c in sentence).split())


KNOWN = {plain(sentence): name for name, sentence in SENTENCES.items()}


def normal(sentence: Column) -> Column:
    """The same in Spark."""
    return F.btrim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def known_sentences(text: Column) -> Column:
    """Identifiers of the known sentences in order. A piece that is no known sentence is tried line by line."""
    forms, names = F.array(*map(F.lit, KNOWN)), F.array(*map(F.lit, KNOWN.values()))
    of = lambda s: F.when(s.rlike(TRIGGER), normal(s))
    tried = F.flatten(F.transform(F.filter(F.split(text, BREAKS), lambda s: s.rlike(TRIGGER)), lambda s: let(
        of(s), lambda form: F.when(form.isin(list(KNOWN)), F.array(form)).otherwise(F.transform(F.split(s, "\n"), of)))))
    hits = F.filter(tried, lambda form: form.isin(list(KNOWN)))
    return F.when(text.rlike(TRIGGER), F.transform(hits, lambda form: F.get(names, F.array_position(forms, form).cast("int") - 1))).otherwise(F.array().cast("array<string>"))


def licences_of(names: Column) -> Column:
    """Licences, in order of name, one of whose rules is a run of the identifiers; a sentence said twice counts once."""
    once = F.filter(names, lambda x, i: F.when(i > 0, x != F.get(names, i - 1)).otherwise(F.lit(True)))

    def judged(line: Column) -> Column:
        holds = {name: reduce(or_, [line.contains(f" {' '.join(rule)} ") for rule in rules]) for name, rules in RULES.items()}
        for name, wider in WIDER.items():
            holds[name] = holds[name] & ~holds[wider]
        return F.filter(F.array(*[F.when(held, F.lit(name)) for name, held in holds.items()]), lambda x: x.isNotNull())

    return let(F.concat(F.lit(" "), F.array_join(once, " "), F.lit(" ")), judged)


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns row (the input), sentences (identifiers in order), licences (names in order); one row per input row.

    Texts are read whole where they lie: no join and no shuffle. Sentences are compared in normal form, so case, signs and
    line ends inside a sentence do not matter; between the sentences of a rule, unknown ones may stand. Null and empty texts
    have none; repeated rows give equal rows; an empty table gives an empty table.
    """
    base = packed(docs, text=text).select("row", known_sentences(text_of()).alias("sentences"))
    return base.select("row", "sentences", licences_of(F.col("sentences")).alias("licences"))
