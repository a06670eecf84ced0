"""Licence scans by sentences and ordered rules. Native: SQL functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import NOT_WORD, lower_ascii

# Sentences of public licences and of the notices that name them.
SENTENCES = {
    "mit.grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit.notice-kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit.liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit.named": "Released under the MIT License.",
    "mit.named-licensed": "Licensed under the MIT License.",
    "mit.title": "The MIT License (MIT)",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc.as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.no-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd.no-endorsement-named": "The name of the copyright holder may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd.named": "Licensed under the BSD License.",
    "bsd2.named": "Licensed under the BSD 2-Clause License.",
    "bsd3.named": "Licensed under the BSD 3-Clause License.",
    "apache2.header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2.copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2.copy-at": "You may obtain a copy of the License at",
    "apache2.address": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache2.as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2.limits": "See the License for the specific language governing permissions and limitations under the License.",
    "apache2.named": "Licensed under the Apache License, Version 2.0.",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl.details": "See the GNU General Public License for more details.",
    "gpl.received": "You should have received a copy of the GNU General Public License along with this program.",
    "lgpl21.free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl.hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl.details": "See the GNU Lesser General Public License for more details.",
    "gpl3.named": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2.named": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl3.named": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl3.named": "This work is licensed under the GNU Affero General Public License, version 3.",
    "mpl2.form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc0.named": "This work is dedicated to the public domain under CC0 1.0.",
    "ccby4.named": "Licensed under CC BY 4.0.",
    "ccbysa4.named": "Licensed under CC BY-SA 4.0.",
    "ccbync4.named": "Licensed under CC BY-NC 4.0.",
    "ccbynd4.named": "Licensed under CC BY-ND 4.0.",
    "ccbyncsa4.named": "Licensed under CC BY-NC-SA 4.0.",
    "ccbyncnd4.named": "Licensed under CC BY-NC-ND 4.0.",
    "ccby4.work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "unlicense.free": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}

# Known sentences that name their holder: what stands before and behind the name, and the name in ``SENTENCES``.
HOLDERS = [
    ("Neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "the copyright holder"),
    ("The name of", "may not be used to endorse or promote products derived from this software without specific prior written permission.", "the copyright holder"),
    ("This software is provided by", "\"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.", "the copyright holders and contributors"),
]
HOLDER_WORDS = 24
"""Words that a holder's name may have."""

# Licences (SPDX names where there are any) by sequences of sentences; earlier rules take their sentences first.
RULES = [
    ("MIT", ("mit.grant", "mit.notice-kept", "mit.as-is", "mit.liability")),
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.no-endorsement", "bsd.as-is")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.no-endorsement", "bsd.as-is")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.no-endorsement-named", "bsd.as-is")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.as-is")),
    ("ISC", ("isc.grant", "isc.as-is")),
    ("Apache-2.0", ("apache2.header", "apache2.copy", "apache2.as-is", "apache2.limits")),
    ("Apache-2.0", ("apache2.header", "apache2.copy-at", "apache2.address", "apache2.as-is", "apache2.limits")),
    ("GPL-3.0-or-later", ("gpl.free", "gpl.hope", "gpl.details", "gpl.received")),
    ("GPL-2.0-or-later", ("gpl2.free", "gpl.hope", "gpl.details", "gpl.received")),
    ("LGPL-2.1-or-later", ("lgpl21.free", "lgpl.hope", "lgpl.details")),
    ("MPL-2.0", ("mpl2.form", "mpl2.copy")),
    ("MIT", ("mit.grant", "mit.notice-kept")),
    ("BSD", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("MIT", ("mit.title",)),
    ("Apache-2.0", ("apache2.header",)),
    ("GPL-3.0-or-later", ("gpl.free",)),
    ("GPL-2.0-or-later", ("gpl2.free",)),
    ("LGPL-2.1-or-later", ("lgpl21.free",)),
    ("MPL-2.0", ("mpl2.form",)),
    ("MIT", ("mit.named",)),
    ("MIT", ("mit.named-licensed",)),
    ("Apache-2.0", ("apache2.named",)),
    ("BSD-2-Clause", ("bsd2.named",)),
    ("BSD-3-Clause", ("bsd3.named",)),
    ("BSD", ("bsd.named",)),
    ("GPL-3.0-only", ("gpl3.named",)),
    ("GPL-2.0-only", ("gpl2.named",)),
    ("LGPL-3.0-only", ("lgpl3.named",)),
    ("AGPL-3.0-only", ("agpl3.named",)),
    ("CC0-1.0", ("cc0.named",)),
    ("CC-BY-4.0", ("ccby4.named",)),
    ("CC-BY-4.0", ("ccby4.work",)),
    ("CC-BY-SA-4.0", ("ccbysa4.named",)),
    ("CC-BY-NC-4.0", ("ccbync4.named",)),
    ("CC-BY-ND-4.0", ("ccbynd4.named",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa4.named",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd4.named",)),
    ("Unlicense", ("unlicense.free",)),
    ("Proprietary", ("reserved",)),
]

# Licences by their tag in a source file, for every SPDX name above.
SPDX = sorted({name for name, _ in RULES} - {"BSD", "Proprietary"})
SENTENCES |= {f"spdx.{name}": f"SPDX-License-Identifier: {name}" for name in SPDX}
RULES += [(name, (f"spdx.{name}",)) for name in SPDX]

CLOSE = [("bsd.binary", "bsd.as-is"), ("bsd.binary", "bsd.no-endorsement"), ("bsd.binary", "bsd.no-endorsement-named")]
"""Sentences that no unknown one may part: a clause between them makes another licence."""

# Abbreviations before a full stop that ends no sentence, and marks that begin a line of a comment or a list.
ABBREVIATIONS = ("v", "vs", "no", "inc", "ltd", "corp", "e.g", "i.e")
COMMENT_MARK = r"(?m)^[ \t]*(?:(?:#|//|/?\*|--|;|%|<!--|\"|')+(?:[*/>-]*[ \t]+|$))"
LIST_MARK = r"\r?\n[ \t]*(?=(?:[*•-]|[(]?(?:[0-9]{1,2}|[a-z])[.)])[ \t])"
LONE_MARK = r"^[ \t]*[(]?(?:[0-9]{1,2}|[a-z])[.)]?[ \t]*$"
END = "".join(rf"(?<!\b{a.replace('.', '[.]')}[.])" for a in ABBREVIATIONS) + r"(?<=[.!?])[ \t\n\x0B\f\r]+"
BREAK = rf"{END}|(?:\r?\n[ \t]*){{2,}}|{LIST_MARK}"
LINE_ENDS = r"[\n\r]+"


def normal_form(sentence: str) -> str:
    """A-Z lower-cased, every run of other ASCII than letters and digits one space, none at the ends; ``licence`` spelled ``license``."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), sentence)
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", low).strip(" ").replace("licence", "license")


def normalised(sentence: Column) -> Column:
    """``normal_form`` of a column that is lower-cased already."""
    return F.replace(F.btrim(F.regexp_replace(sentence, f"{NOT_WORD}+", " ")), F.lit("licence"), F.lit("license"))


def unnamed(norm: Column) -> Column:
    """A normal form with the holder of ``HOLDERS`` in the place of another of at most ``HOLDER_WORDS`` words."""
    out = norm
    for before, behind, holder in HOLDERS:
        a, b = normal_form(before), normal_form(behind)
        held = F.startswith(norm, F.lit(f"{a} ")) & F.endswith(norm, F.lit(f" {b}"))
        name = F.regexp_extract(norm, f"^{a} (.*) {b}$", 1)
        fits = (name != "") & (F.size(F.split(name, " ")) <= HOLDER_WORDS)
        out = F.when(held, F.when(fits, f"{a} {normal_form(holder)} {b}").otherwise(norm)).otherwise(out)
    return out


def short_notices(table: dict[str, str]) -> dict[str, str]:
    """Normal forms, with their identifiers, of the sentences that name a licence; they are met inside lines too."""
    return {normal_form(s): k for k, s in table.items() if k.endswith(".named") or k.endswith(".named-licensed") or k.startswith("spdx.")}


def inside(line: Column, notices: dict[str, str]) -> Column:
    """Normal forms of ``notices`` inside a normalised line, left to right, the longest at a place; all names of an SPDX expression count.

    Only a line with their first words is searched.
    """
    longest = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
    tag = normal_form("SPDX-License-Identifier:") + " "
    names = [n.removeprefix(tag) for n in notices if n.startswith(tag)]
    openings = sorted({" ".join(n.split(" ")[:2]) for n in notices})
    spread = F.regexp_replace(line, f"(?<= or | and )(?=(?:{longest(names)})(?![^ ]))", tag) if names else line
    asked = F.when(F.contains(line, F.lit(tag)), spread).otherwise(line)
    found = F.regexp_extract_all(asked, F.lit(f"(?<![^ ])(?:{longest(notices)})(?![^ ])"), F.lit(0))
    opened = reduce(lambda a, b: a | b, [F.contains(line, F.lit(o)) for o in openings])
    return F.when(opened, found).otherwise(F.array().cast("array<string>"))


def known_sentences(spark: SparkSession, sentences: dict[str, str] | None = None) -> DataFrame:
    """``(norm, sid)`` of a table of sentences; one that the rules below would cut in the middle can't be met and raises ``ValueError``."""
    table = SENTENCES if sentences is None else sentences
    if cut := [k for k, s in table.items() if re.search(BREAK, s.strip().lower())]:
        raise ValueError(f"sentences with an end in the middle: {cut}")
    rows = [F.struct(F.lit(normal_form(s)).alias("norm"), F.lit(k).alias("sid")) for k, s in table.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def recognised(docs: DataFrame, id_col: str, text_col: str, known: DataFrame, most_words: int, notices: dict[str, str] | None = None) -> DataFrame:
    """``(doc, piece, line, sid)``: every occurrence of a known sentence in every whole text, with its place.

    Marks that begin lines of comments go first. A piece ends at a full stop, exclamation or question mark before a blank
    (``ABBREVIATIONS`` aside), at an empty line, or before an item of a list. Sentences are its lines, and, so that wrapped ones are found,
    its first and its last lines together, up to all of them; ``line`` is where a sentence begins. Lines without words do not
    count, so no sentence of ``most_words``, the most that a known one has with its holder, crosses more lines. ``notices`` are met inside lines too, once a
    line, unless a known sentence crosses that line: there they are parts of it. Sentences meet the table in a
    broadcast join of fixed size, so one that a third of all texts holds is never gathered. Pieces with words, a list item's mark aside, are numbered from 0 in each text.
    """
    low = docs.select(F.col(id_col).alias("doc"), F.regexp_replace(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), COMMENT_MARK, "").alias("low"))
    worded = F.filter(F.split("low", BREAK), lambda s: s.rlike("[0-9a-z]|[^\\x00-\\x7F]") & ~((F.length(s) < 8) & s.rlike(LONE_MARK)))
    pieces = low.select("doc", F.posexplode(worded).alias("piece", "body"))
    several = F.contains("body", F.lit("\n")) | F.contains("body", F.lit("\r"))
    cut = F.when(several, F.filter(F.transform(F.split("body", LINE_ENDS), normalised), lambda s: s != "")).otherwise(F.array(normalised(F.col("body"))))
    lines = pieces.select("doc", "piece", cut.alias("lines")).where("size(lines) > 0")
    n = F.size("lines")
    sentence = lambda line, norm, upto, whole=True: F.struct(line.cast("int").alias("line"), norm.alias("norm"), upto.cast("int").alias("upto"), F.lit(whole).alias("whole"))
    single = F.transform("lines", lambda s, i: sentence(i, s, i))
    some = F.sequence(F.lit(2), F.least(n, F.lit(most_words)))
    joined = lambda at, k: F.array_join(F.slice("lines", at + 1, k), " ")
    first = F.transform(some, lambda k: sentence(F.lit(0), joined(F.lit(0), k), k - 1))
    last = F.transform(some, lambda k: sentence(n - k, joined(n - k, k), n - 1))
    tried = F.when(n > 1, F.concat(single, first, last)).otherwise(single)
    if notices:
        tried = F.concat(tried, F.flatten(F.transform("lines", lambda s, i: F.transform(inside(s, notices), lambda part: sentence(i, part, i, False)))))
    found = lines.select("doc", "piece", F.inline(tried)).withColumn("norm", unnamed(F.col("norm"))).join(F.broadcast(known), "norm")
    order = Window.partitionBy("doc").orderBy("piece", "line").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = F.max(F.when(F.col("whole"), F.struct("piece", "upto"))).over(order)
    covered = F.coalesce((F.col("taken.piece") == F.col("piece")) & (F.col("taken.upto") >= F.col("line")), F.lit(False))
    return found.withColumn("taken", taken).where(F.col("whole") | ~covered).select("doc", "piece", "line", "sid").distinct()


def match_rules(sequences: DataFrame, rules: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """``sequences`` with ``licenses``: sorted names of the rules that ``sids`` (array of identifiers in order) meets.

    Rules apply in their order. One matches where its identifiers follow each other directly, and takes them, at all
    places, so that later rules don't see them.
    """
    out = sequences.withColumn("_left", F.concat(F.lit(","), F.array_join("sids", ",,"), F.lit(",")))
    out = out.withColumn("_hits", F.array().cast("array<string>"))
    for name, ids in rules:
        pattern = "," + ",,".join(ids) + ","
        out = out.select(
            *[c for c in out.columns if c not in ("_left", "_hits")],
            F.replace("_left", F.lit(pattern), F.lit(",_,")).alias("_left"),
            F.when(F.contains("_left", F.lit(pattern)), F.array_append("_hits", F.lit(name))).otherwise(F.col("_hits")).alias("_hits"),
        )
    return out.withColumn("licenses", F.array_sort(F.array_distinct("_hits"))).drop("_left", "_hits")


GAP = "?"
"""Stands for unknown words between two sentences of ``CLOSE``."""


def _with_gaps(places: Column) -> Column:
    """Identifiers of sorted ``array<struct<piece, line, sid>>``, ``GAP`` before one that unknown pieces part from its ``CLOSE`` predecessor."""

    def step(x: Column, i: Column) -> Column:
        before = F.get(places, i - 1)
        pair = reduce(lambda a, b: a | b, [(before["sid"] == a) & (x["sid"] == b) for a, b in CLOSE])
        return F.when((i > 0) & pair & (x["piece"] - before["piece"] > 1), F.array(F.lit(GAP), x["sid"])).otherwise(F.array(x["sid"]))

    return F.flatten(F.transform(places, step))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    sentences: dict[str, str] | None = None, rules: list[tuple[str, tuple[str, ...]]] | None = None,
) -> DataFrame:
    """``(id_col, sids, licenses)`` for every document: known sentences in order of place, and the licences they make up.

    Names of holders count as those of ``HOLDERS``. Sentences of ``CLOSE`` between which other words stand don't follow each other for a rule, so a
    BSD text with an unknown clause is no more than ``BSD``. A sentence that a text repeats counts at each of its places; of sentences that begin at one place the first by identifier comes first. Null, empty and blank texts have none. Rows that repeat
    id and text give one row, an id with several texts a row for each.
    """
    table = SENTENCES if sentences is None else sentences
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body"))
    slim = docs.select(doc.alias("_doc"), F.col(text_col).alias("_text"))
    most_words = max((len(normal_form(s).split()) for s in table.values()), default=1) + HOLDER_WORDS
    found = recognised(slim, "_doc", "_text", known_sentences(docs.sparkSession, table), most_words, short_notices(table))
    listed = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("piece", "line", "sid"))).alias("s"))
    judged = match_rules(listed.select("doc", _with_gaps(F.col("s")).alias("sids")), RULES if rules is None else rules)
    judged = judged.withColumn("sids", F.array_remove("sids", GAP))
    every = slim.select("_doc").distinct()
    none = F.array().cast("array<string>")
    out = every.join(judged, every["_doc"] == judged["doc"], "left")
    return out.select(F.col("_doc.id").alias(id_col), F.coalesce("sids", none).alias("sids"), F.coalesce("licenses", none).alias("licenses"))
