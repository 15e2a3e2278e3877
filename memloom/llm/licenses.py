"""License scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, anything but letters
and digits as one space) and looked up among known licence sentences. The identifiers
found, in the order of the text, form a sequence; ordered rules name the licence that
a run of identifiers stands for. A rule takes its identifiers out of the sequence, so
a later, more general rule can't count them again. What is left over is reported.

Cutting is the same on both sides: a known sentence that holds ". ", "; " or ": " is
cut there too, and a rule asks for its pieces in sequence. "This program is free software"
is not part of any known sentence, since a program's own name may stand there. Texts are read twice: line
by line, and paragraph by paragraph with wrapped lines joined (comment marks vanish
with the other signs), so neither headings nor wrapped comments hide a sentence.
Known sentences and rules are two small tables compiled into the projection; nothing
is shuffled and no user function runs.

Scope: the notices, headers or permission texts below, word for word, of MIT, ISC,
0BSD, BSD-2-Clause, BSD-3-Clause (whoever its last clause names), Apache-2.0, MPL-2.0, EPL-2.0, GPL-2.0
and GPL-3.0, LGPL-2.1 and LGPL-3.0, AGPL-3.0 (whatever the program is called), Unlicense,
CC0-1.0, CC-BY, -SA and -NC 4.0, reserved rights, and SPDX lines of these, old names and
expressions with OR, AND and WITH included: each licence of an expression is reported.
Other licences aren't recognised; pass tables of your own.

Defined results: null and empty texts give no identifiers and no licences; repeated
rows and null ids give one row each; a sentence seen twice counts twice; pieces of
fewer than four words of a longer sentence are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences by identifier, as they are published.
SENTENCES = {
    "mit_notice": "Released under the MIT License.",
    "mit_notice_2": "This project is licensed under the MIT License.",
    "mit_notice_3": "Licensed under the MIT license.",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit_notice_kept": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit_liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc_grant_2": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zero_bsd_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc_warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd_warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "apache2_notice": "Licensed under the Apache License, Version 2.0.",
    "apache2_notice_2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache2_copy": "You may obtain a copy of the License at",
    "apache2_warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache2_limits": "See the License for the specific language governing permissions and limitations under the License.",
    "mpl2_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2_copy_2": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "epl2_notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3_or_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl3_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.",
    "gpl2_or_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2_only": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2_only_2": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "lgpl21_or_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3_or_later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3_or_later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl_warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl_warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_copy": "See the GNU General Public License for more details.",
    "lgpl_copy": "See the GNU Lesser General Public License for more details.",
    "agpl_copy": "See the GNU Affero General Public License for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0_notice": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "cc_by_nc_notice": "Licensed under CC BY-NC 4.0.",
    "cc_by_notice": "Licensed under CC BY 4.0.",
    "cc_by_sa_notice": "Licensed under CC BY-SA 4.0.",
    "cc_by_nc_full": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc_by_sa_full": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc_by_full": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all_rights": "All rights reserved.",
}

#: Names on SPDX lines.
SPDX = (
    "MIT ISC 0BSD BSD-2-Clause BSD-3-Clause Apache-2.0 MPL-2.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0"
).split()
#: Names that such lines had before, and what they stand for.
SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
SENTENCES |= {f"spdx_{x}": f"SPDX-License-Identifier: {x}" for x in (*SPDX, *SPDX_OLD)}

#: (licence, run of identifiers), the first that fits wins.
RULES = (
    ("MIT", ("mit_grant", "mit_notice_kept", "mit_warranty", "mit_liability")),
    ("MIT", ("mit_grant", "mit_notice_kept", "mit_warranty")),
    ("MIT", ("mit_grant", "mit_notice_kept")),
    ("MIT", ("mit_grant",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_notice_2",)),
    ("MIT", ("mit_notice_3",)),
    ("ISC", ("isc_grant", "isc_warranty")),
    ("ISC", ("isc_grant_2", "isc_warranty")),
    ("0BSD", ("zero_bsd_grant", "isc_warranty")),
    ("ISC", ("isc_grant",)),
    ("ISC", ("isc_grant_2",)),
    ("0BSD", ("zero_bsd_grant",)),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names", "bsd_warranty")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_warranty")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("Apache-2.0", ("apache2_notice_2", "apache2_copy", "apache2_warranty", "apache2_limits")),
    ("Apache-2.0", ("apache2_notice_2", "apache2_copy", "apache2_warranty")),
    ("Apache-2.0", ("apache2_notice_2", "apache2_warranty")),
    ("Apache-2.0", ("apache2_notice_2",)),
    ("Apache-2.0", ("apache2_notice",)),
    ("MPL-2.0", ("mpl2_notice", "mpl2_copy")),
    ("MPL-2.0", ("mpl2_notice", "mpl2_copy_2")),
    ("MPL-2.0", ("mpl2_notice",)),
    ("EPL-2.0", ("epl2_notice",)),
    ("GPL-3.0-or-later", ("gpl3_or_later", "gpl_warranty", "gpl_copy")),
    ("GPL-3.0-or-later", ("gpl3_or_later",)),
    ("GPL-3.0-only", ("gpl3_only", "gpl_warranty", "gpl_copy")),
    ("GPL-3.0-only", ("gpl3_only",)),
    ("GPL-2.0-or-later", ("gpl2_or_later", "gpl_warranty", "gpl_copy")),
    ("GPL-2.0-or-later", ("gpl2_or_later",)),
    ("GPL-2.0-only", ("gpl2_only", "gpl_warranty", "gpl_copy")),
    ("GPL-2.0-only", ("gpl2_only",)),
    ("GPL-2.0-only", ("gpl2_only_2", "gpl_warranty", "gpl_copy")),
    ("GPL-2.0-only", ("gpl2_only_2",)),
    ("LGPL-2.1-or-later", ("lgpl21_or_later", "lgpl_warranty", "lgpl_copy")),
    ("LGPL-2.1-or-later", ("lgpl21_or_later",)),
    ("LGPL-3.0-or-later", ("lgpl3_or_later", "gpl_warranty", "lgpl_copy")),
    ("LGPL-3.0-or-later", ("lgpl3_or_later",)),
    ("AGPL-3.0-or-later", ("agpl3_or_later", "gpl_warranty", "agpl_copy")),
    ("AGPL-3.0-or-later", ("agpl3_or_later",)),
    ("GPL-3.0-only", ("gpl3_notice",)),
    ("Unlicense", ("unlicense",)),
    ("CC0-1.0", ("cc0_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_notice",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_full",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_notice",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_full",)),
    ("CC-BY-4.0", ("cc_by_notice",)),
    ("CC-BY-4.0", ("cc_by_full",)),
    *((x, (f"spdx_{x}",)) for x in SPDX),
    *((new, (f"spdx_{x}",)) for x, new in SPDX_OLD.items()),
    ("Proprietary", ("all_rights",)),
)

#: Every known sentence holds one of these; texts without any aren't cut up.
HINTS = ("licen", "permi", "copyright", "warrant", "redistribut", "rights reserved", "the mpl", "public domain")

#: The colon of an SPDX line is no place to cut.
SPDX_COLON, SPDX_PLAIN = "(?i)(SPDX-License-Identifier):", "{0}1"
#: A sentence ends at a sign before white space; a paragraph at a line of comment marks at most.
END = r"[.!?:;]+[ \t\r]+"
GAP = r"\n[ \t\r*#;/%-]*\n"
MARK = "\x01"
LEAST_WORDS = 4
#: Any sentence that forbids endorsement in these words, whoever is named, stands for the one of the three-clause text.
ENDORSEMENT = "to endorse or promote products derived from this software"
#: A licence that is part of another one: where one reading finds the longer only, the other one has missed a clause.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}
SPDX_HEAD = "spdx license identifier "
#: The plus sign of an old name.
PLUS, OR_LATER = r"(?i)(GPL-[0-9.]*[0-9])\+", "{0}1-or-later"


def normal(sentence: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower()).split())


def pieces(sentence: str) -> list[str]:
    """A known sentence cut and normalised as texts are."""
    found = [normal(x) for x in re.split(END, re.sub(SPDX_COLON, SPDX_PLAIN.format("\\"), sentence))]
    found = [x for x in found if x]
    return found if len(found) == 1 else [x for x in found if len(x.split()) >= LEAST_WORDS]


def compiled(sentences: dict[str, str], rules) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """({normalised piece: identifier}, [(licence, run of marked identifiers)]). A piece that sentences share has the identifier it got first."""
    known: dict[str, str] = {}
    for name, text in sentences.items():
        assert any(h in text.lower() for h in HINTS), text
        own = pieces(text)
        for n, piece in enumerate(own, 1):
            known.setdefault(piece, name if len(own) == 1 else f"{name}.{n}")
    return known, [(licence, "".join(f"|{known[x]}|" for name in run for x in pieces(sentences[name]))) for licence, run in rules]


def _normalised(parts: Column) -> Column:
    """Sentences in plain form; an SPDX line gives one for each licence of its expression, without exceptions."""
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    named = F.transform(plain, lambda s: F.when(F.contains(s, F.lit(ENDORSEMENT)), normal(SENTENCES["bsd_names"])).otherwise(s))
    rest = lambda s: F.split(F.replace(F.substring(s, len(SPDX_HEAD) + 1, 1 << 30), F.lit(" or later"), F.lit(" orlater")), " (?:or|and) ")
    one = lambda x: F.concat(F.lit(SPDX_HEAD), F.replace(F.regexp_replace(x, " with .*$", ""), F.lit(" orlater"), F.lit(" or later")))
    each = F.transform(named, lambda s: F.when(F.startswith(s, F.lit(SPDX_HEAD)), F.transform(rest(s), one)).otherwise(F.array(s)))
    return F.when(F.exists(named, lambda s: F.startswith(s, F.lit(SPDX_HEAD))), F.flatten(each)).otherwise(named)


def _by_line(text: Column) -> Column:
    return _normalised(F.split(F.regexp_replace(text, END, "\n"), "\n"))


def _by_paragraph(text: Column) -> Column:
    joined = F.translate(F.regexp_replace(text, GAP, MARK), "\n", " ")
    return _normalised(F.split(F.regexp_replace(joined, END, MARK), MARK))


def _identifiers(parts: Column, known: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.transform(F.filter(parts, lambda s: s.isin(*known)), lambda s: F.element_at(table, s))


def _match(ids: Column, runs) -> Column:
    """struct(left, found): the identifiers as '|a||b|', what rules leave of them and the licences they name."""
    marked = F.array_join(F.transform(ids, lambda x: F.concat(F.lit("|"), x, F.lit("|"))), "")
    table = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(run).alias("run")) for name, run in runs))
    start = F.struct(marked.alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.when(
        F.contains(acc["left"], r["run"]),
        F.struct(F.replace(acc["left"], r["run"], F.lit("/")).alias("left"), F.array_append(acc["found"], r["name"]).alias("found")),
    ).otherwise(acc)
    return F.aggregate(table, start, step)


def license_scan(docs: DataFrame, sentences=None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_known, sentence_ids, licenses, unmatched of every row; lists are joined by commas, licences sorted."""
    known, runs = compiled(SENTENCES if sentences is None else sentences, rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    hinted = F.lower(text).rlike("|".join(HINTS))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(hinted, F.regexp_replace(F.regexp_replace(text, SPDX_COLON, SPDX_PLAIN.format("$")), PLUS, OR_LATER.format("$"))).alias("t"))
    none = F.array().cast("array<string>")
    ids = rows.select(
        "doc_id",
        F.when(F.col("t").isNull(), none).otherwise(_identifiers(_by_line(F.col("t")), known)).alias("lines"),
        F.when(F.col("t").isNull(), none).otherwise(_identifiers(_by_paragraph(F.col("t")), known)).alias("joined"),
    )
    matched = ids.select("doc_id", "lines", "joined", _match(F.col("lines"), runs).alias("a"), _match(F.col("joined"), runs).alias("b"))
    def whole(own: Column, other: Column) -> Column:
        for part, more in PART_OF.items():
            own = F.when(F.array_contains(other, more) & ~F.array_contains(other, part), F.array_remove(own, part)).otherwise(own)
        return own

    found = F.array_union(whole(F.col("a.found"), F.col("b.found")), whole(F.col("b.found"), F.col("a.found")))
    longer = F.when(F.size("joined") > F.size("lines"), F.col("joined")).otherwise(F.col("lines"))
    left = F.when(F.size("joined") > F.size("lines"), F.col("b.left")).otherwise(F.col("a.left"))
    return matched.select(
        "doc_id",
        F.size(longer).cast("long").alias("n_known"),
        F.array_join(longer, ",").alias("sentence_ids"),
        F.array_join(F.array_sort(found), ",").alias("licenses"),
        F.array_join(F.filter(F.split(F.translate(left, "/", "|"), r"\|"), lambda x: x != ""), ",").alias("unmatched"),
    )


def oracle_sql() -> str:
    """The default tables in DuckDB's SQL, which cuts the published sentences itself."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    sentences = ", ".join(f"({n}, {quote(name)}, {quote(text)})" for n, (name, text) in enumerate(SENTENCES.items()))
    rules = ", ".join(f"({n}, {quote(name)}, [{', '.join(map(quote, run))}])" for n, (name, run) in enumerate(RULES))
    plain = lambda t: f"regexp_replace(regexp_replace({t}, 'SPDX-License-Identifier:', 'SPDX-License-Identifier', 'gi'), '(GPL-[0-9.]*[0-9])\\+', '\\1-or-later', 'gi')"
    low = lambda parts: f"list_transform({parts}, lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')))"
    named = "CASE WHEN contains(s, 'to endorse or promote products derived from this software') THEN 'neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission' ELSE s END"
    spdx = "list_transform(string_split_regex(replace(s[25:], ' or later', ' orlater'), ' (?:or|and) '), lambda x: 'spdx license identifier ' || replace(regexp_replace(x, ' with .*$', ''), ' orlater', ' or later'))"
    each = lambda parts: f"flatten(list_transform(list_transform({low(parts)}, lambda s: {named}), lambda s: CASE WHEN starts_with(s, 'spdx license identifier ') THEN {spdx} ELSE [s] END))"
    end = r"'[.!?:;]+[ \t\r]+'"
    by_line = lambda t: each(f"string_split(regexp_replace({t}, {end}, chr(10), 'g'), chr(10))")
    gap = r"'\n[ \t\r*#;/%-]*\n'"
    by_paragraph = lambda t: each(f"string_split(regexp_replace(replace(regexp_replace({t}, {gap}, chr(1), 'g'), chr(10), ' '), {end}, chr(1), 'g'), chr(1))")

    def fold(ids: str) -> str:
        marked = f"list_aggregate(list_concat([''], list_transform({ids}, lambda x: '|' || x || '|')), 'string_agg', '')"
        first = f"struct_pack(n := '', r := '', l := {marked}, f := CAST([] AS VARCHAR[]))"
        return (
            f"list_reduce(list_concat([{first}], rr.rules), lambda a, q: CASE WHEN contains(a.l, q.r) "
            "THEN struct_pack(n := '', r := '', l := replace(a.l, q.r, '/'), f := list_append(a.f, q.n)) ELSE a END)"
        )

    whole = lambda own, other: f"CASE WHEN list_contains({other}, 'BSD-3-Clause') AND NOT list_contains({other}, 'BSD-2-Clause') THEN list_filter({own}, lambda x: x <> 'BSD-2-Clause') ELSE {own} END"
    return f"""
WITH sent(o, name, s) AS (VALUES {sentences}),
cut AS (SELECT o, name, unnest({by_line(plain('s'))}) AS p, generate_subscripts({by_line(plain('s'))}, 1) AS i FROM sent),
kept AS (SELECT *, count(*) OVER (PARTITION BY o) AS c FROM cut WHERE p <> ''),
piece AS (SELECT o, name, p, count(*) OVER (PARTITION BY o) AS m, row_number() OVER (PARTITION BY o ORDER BY i) AS i FROM kept WHERE c = 1 OR len(string_split(p, ' ')) >= 4),
known AS (SELECT p AS s, arg_min(CASE WHEN m = 1 THEN name ELSE name || '.' || i END, o * 1000 + i) AS id FROM piece GROUP BY p),
rule(o, licence, run) AS (VALUES {rules}),
step AS (SELECT o, licence, unnest(run) AS name, generate_subscripts(run, 1) AS n FROM rule),
runs AS (SELECT step.o, any_value(licence) AS licence, string_agg('|' || id || '|', '' ORDER BY n, i) AS r FROM step JOIN piece USING (name) JOIN known ON known.s = piece.p GROUP BY step.o),
rr AS (SELECT list(struct_pack(n := licence, r := r, l := '', f := CAST([] AS VARCHAR[])) ORDER BY o) AS rules FROM runs),
d AS (SELECT row_number() OVER () AS r, doc_id, {plain("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT r, 1 AS kind, unnest({by_line('t')}) AS s, generate_subscripts({by_line('t')}, 1) AS i FROM d
      UNION ALL SELECT r, 2, unnest({by_paragraph('t')}), generate_subscripts({by_paragraph('t')}, 1) FROM d),
k AS (SELECT r, kind, list(id ORDER BY i) AS ids FROM p JOIN known USING (s) GROUP BY r, kind),
j AS (SELECT doc_id, coalesce(a.ids, CAST([] AS VARCHAR[])) AS la, coalesce(b.ids, CAST([] AS VARCHAR[])) AS lb
      FROM d LEFT JOIN (SELECT * FROM k WHERE kind = 1) a USING (r) LEFT JOIN (SELECT * FROM k WHERE kind = 2) b USING (r)),
m AS (SELECT j.*, {fold('la')} AS ma, {fold('lb')} AS mb FROM j, rr)
SELECT doc_id, greatest(len(la), len(lb))::BIGINT AS n_known,
  coalesce(array_to_string(CASE WHEN len(lb) > len(la) THEN lb ELSE la END, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_concat({whole('ma.f', 'mb.f')}, {whole('mb.f', 'ma.f')}))), ','), '') AS licenses,
  coalesce(array_to_string(list_filter(string_split(replace(CASE WHEN len(lb) > len(la) THEN mb.l ELSE ma.l END, '/', '|'), '|'), lambda x: x <> ''), ','), '') AS unmatched
FROM m
"""
