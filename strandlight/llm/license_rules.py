"""Licence recognition by sentence rules, in DataFrame operations only.

The text is normalised - A-Z lower-cased, anything but letters and digits becomes one blank - and keeps two
marks: where a sentence ends (after ``.``, ``!``, ``?`` before a blank or line end) and where another line
ends (unless the next goes on with a lower-case letter). Known licence sentences are looked up from mark to
mark, the longest first; a line end inside one counts as a blank, so the wrapping of a text, its blank lines
and comment signs do not matter. The identifiers found, in order, are matched against ordered rules: a rule fits when its identifiers occur in its order,
other text in between allowed. All of it happens inside a row, so no key can be hot and nothing is shuffled.

Null and empty texts have no sentences. Repeated sentences keep all their places. Whole texts are read.
The known sentences and rules are fixed lists, whatever the size of the data.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences as published, by identifier.
SENTENCES = {
    "mit-mention": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-mention": "Licensed under the Apache License, Version 2.0.",
    "apache-head": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-mention": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "bsd-use": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ccbync-mention": "Licensed under CC BY-NC 4.0.",
    "ccby-mention": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "reserved": "All rights reserved.",
}
# Licence, kind and the identifiers in order; more specific rules first.
RULES = [
    ("MIT", "permissive", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", "permissive", ("mit-title",)),
    ("MIT", "permissive", ("mit-mention",)),
    ("Apache-2.0", "permissive", ("apache-head", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", "permissive", ("apache-mention",)),
    ("BSD-3-Clause", "permissive", ("bsd-use", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", "permissive", ("bsd-use", "bsd-source", "bsd-binary")),
    ("GPL-3.0", "copyleft", ("gpl-free", "gpl-hope", "gpl-see")),
    ("GPL-3.0", "copyleft", ("gpl3-mention",)),
    ("CC-BY-NC-4.0", "noncommercial", ("ccbync-mention",)),
    ("CC-BY-4.0", "permissive", ("ccby-mention",)),
    ("All-rights-reserved", "reserved", ("reserved",)),
]


def normal(sentence: str) -> str:
    """What the normalisation makes of a known sentence."""
    low = sentence.translate({c: c + 32 for c in range(65, 91)})
    return re.sub("[^a-z0-9]+", " ", low).strip()


def known() -> list[tuple[str, str]]:
    """(normalised sentence, identifier); a listed text that holds several sentences is listed by its first."""
    out = {}
    for name, text in SENTENCES.items():
        first = re.sub(r"([.!?])[ \t]+", "\\1\n", text).split("\n")[0]
        out.setdefault(normal(first), name)
    return sorted(out.items())


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    t = F.translate(F.coalesce(text, F.lit("")), "\1\2", "  ")  # \1 and \2 become the marks of sentence and line ends
    t = F.regexp_replace(t, "(?m)^([ \t]*)(?:[Rr][Ee][Mm]|dnl)[ \t]", "$1 ")  # comment signs made of letters
    t = F.regexp_replace(t, "([^.!?\\s])[ \t]*\\r?\\n[ \t]*([a-z])", "$1 $2")
    t = F.regexp_replace(t, "[.!?](?:[ \t]+|[ \t]*\\r?\\n)", "\1")
    t = F.regexp_replace(t, "\\r?\\n", "\2")
    t = F.regexp_replace(F.translate(t, upper, lower), "[^a-z0-9\1\2]+", " ")
    # a run of marks and blanks is one mark; the look-behind lets a search start only where a run does
    t = F.regexp_replace(t, "(?<![ \1\2])[ \2]*+\1[ \1\2]*+", "\1")
    t = F.trim(F.regexp_replace(t, "(?<![ \2])[ \2]*\2[ \2]*", "\2"))
    longest = sorted((k for k, _ in known()), key=lambda k: (-len(k), k))
    rx = "(?:^|[\1\2])(" + "|".join(k.replace(" ", "[ \2]") for k in longest) + ")(?=[\1\2]|\\z)"
    table = F.create_map(*[F.lit(x) for pair in known() for x in pair])
    return F.transform(F.regexp_extract_all(t, F.lit(rx), F.lit(1)), lambda s: F.element_at(table, F.translate(s, "\2", " ")))


def matching(ids: Column) -> Column:
    """The rules (by their place in the list) whose identifiers occur in order."""
    line = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    fits = [F.when(line.like("%" + "%".join(f",{i}," for i in rule) + "%"), F.lit(k)) for k, (_, _, rule) in enumerate(RULES)]
    return F.array_compact(F.array(*fits))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentence_ids, n_sentences, licenses, kinds, primary_license."""
    d = docs.select(F.col(id_col).alias("doc_id"), sentence_ids(F.col(text_col)).alias("ids"))
    d = d.select("doc_id", "ids", matching(F.col("ids")).alias("hit"))
    names, kinds = (F.array(*[F.lit(r[k]) for r in RULES]) for k in (0, 1))
    size = F.array(*[F.lit(len(r[2])) for r in RULES])
    name = F.array_distinct(F.transform("hit", lambda k: F.get(names, k)))
    kind = F.array_sort(F.array_distinct(F.transform("hit", lambda k: F.get(kinds, k))))
    # the longest matching rule, the first of equals
    best = F.element_at(F.array_sort(F.transform("hit", lambda k: F.struct((-F.get(size, k)).alias("s"), k.alias("k")))), 1)
    return d.select(
        "doc_id", F.array_join("ids", ",").alias("sentence_ids"), F.size("ids").cast("long").alias("n_sentences"),
        F.array_join(name, ",").alias("licenses"), F.array_join(kind, ",").alias("kinds"),
        F.when(F.size("hit") > 0, F.get(names, best["k"])).alias("primary_license"))


def oracle() -> str:
    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    keys = ", ".join(text(k) for k, _ in known())
    vals = ", ".join(text(v) for _, v in known())
    fits = ", ".join(f"CASE WHEN line LIKE {text('%' + '%'.join(f',{i},' for i in r[2]) + '%')} THEN {k} END" for k, r in enumerate(RULES))
    names, kinds, sizes = ("[" + ", ".join(x) + "]" for x in ([text(r[0]) for r in RULES], [text(r[1]) for r in RULES], [str(len(r[2])) for r in RULES]))
    distinct = "[" + ", ".join(text(n) for n in dict.fromkeys(r[0] for r in RULES)) + "]"
    return f"""
WITH a AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '([^.!?\\s])[ \\t]*\\r?\\n[ \\t]*([a-z])', '\\1 \\2', 'g'),
  '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '\\r?\\n') AS parts FROM documents),
b AS (SELECT doc_id, list_transform(parts, lambda s: trim(regexp_replace(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))) AS p FROM a),
c AS (SELECT doc_id, list_transform(list_filter(p, lambda s: list_contains([{keys}], s)), lambda s: [{vals}][list_position([{keys}], s)]) AS ids FROM b),
d AS (SELECT *, ',' || array_to_string(ids, ',,') || ',' AS line FROM c),
e AS (SELECT *, list_filter([{fits}], lambda k: k IS NOT NULL) AS hit FROM d)
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, CAST(len(ids) AS BIGINT) AS n_sentences,
  array_to_string(list_filter({distinct}, lambda x: list_contains(list_transform(hit, lambda k: {names}[k + 1]), x)), ',') AS licenses,
  array_to_string(list_sort(list_distinct(list_transform(hit, lambda k: {kinds}[k + 1]))), ',') AS kinds,
  {names}[list_sort(list_transform(hit, lambda k: struct_pack(s := -{sizes}[k + 1], k := k)))[1].k + 1] AS primary_license
FROM e
"""
