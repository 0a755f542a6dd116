"""License scans by sentence recognition and ordered rules, with DataFrame functions alone.

A text is cut into sentences, which are normalised; those that are known licence sentences become
identifiers. The sequence of identifiers of a text is then matched, from left to right, against rules in a
fixed order: at each place the first rule whose whole sequence stands there wins and its sentences are
used up. A rule for a full text stands before the rule for its part, so three clauses are not taken for
two. There is no shuffle: sentences never leave their row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifiers and the sentences that they stand for.
SENTENCES = {
    "mit.ref": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "This software is released under the MIT License", "Distributed under the MIT License", "The MIT License", "MIT License", "The MIT License (MIT)"),
    "mit.grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "mit.notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "mit.warranty": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",),
    "mit.liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",),
    "apache.ref": ("Licensed under the Apache License, Version 2.0", "This project is licensed under the Apache License 2.0", "Licensed under Apache 2.0", "Released under the Apache License, Version 2.0", "Apache License Version 2.0"),
    "apache.head": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",),
    "apache.copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"),
    "apache.basis": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",),
    "apache.see": ("See the License for the specific language governing permissions and limitations under the License",),
    "gpl3.ref": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Licensed under the GPLv3", "Released under the GNU General Public License v3.0"),
    "gpl2.ref": ("Licensed under the GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "Licensed under the GPLv2", "Released under the GNU General Public License v2.0"),
    "gpl.free2": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",),
    "gpl.free3": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "lgpl.free": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",),
    "agpl.free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",),
    "gpl.hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    "gpl.see": ("See the GNU General Public License for more details", "See the GNU Lesser General Public License for more details", "See the GNU Affero General Public License for more details"),
    "bsd.ref3": ("Licensed under the BSD 3-Clause License", "BSD 3-Clause License", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    "bsd.ref2": ("Licensed under the BSD 2-Clause License", "BSD 2-Clause License"),
    "bsd.may": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    "bsd.source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd.binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",),
    "bsd.names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd.warranty": ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",),
    "mpl.form": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v", "Licensed under the Mozilla Public License 2.0"),
    "mpl.copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    "isc.grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",),
    "isc.ref": ("Licensed under the ISC License", "ISC License"),
    "unlicense.free": ("This is free and unencumbered software released into the public domain",),
    "cc0.ref": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Licensed under CC0 1.0", "Released under CC0 1.0 Universal"),
    "cc.by": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc.by-sa": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc.by-nc": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc.by-nd": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc.by-nc-sa": ("Licensed under CC BY-NC-SA 4.0",),
    "cc.by-nc-nd": ("Licensed under CC BY-NC-ND 4.0",),
    "all.rights": ("All rights reserved",),
}

#: Rules in their order, each a licence and the identifiers that must stand one after another.
RULES = (
    ("MIT", ("mit.ref", "mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty", "mit.liability")),
    ("MIT", ("mit.ref", "mit.grant", "mit.notice")),
    ("MIT", ("mit.grant", "mit.notice")),
    ("Apache-2.0", ("apache.head", "apache.copy", "apache.basis", "apache.see")),
    ("Apache-2.0", ("apache.head", "apache.basis", "apache.see")),
    ("Apache-2.0", ("apache.head",)),
    ("GPL-3.0-or-later", ("gpl.free3", "gpl.hope", "gpl.see")),
    ("GPL-2.0-or-later", ("gpl.free2", "gpl.hope", "gpl.see")),
    ("LGPL-2.1-or-later", ("lgpl.free", "gpl.hope", "gpl.see")),
    ("AGPL-3.0-or-later", ("agpl.free", "gpl.hope", "gpl.see")),
    ("GPL-3.0-or-later", ("gpl.free3",)),
    ("GPL-2.0-or-later", ("gpl.free2",)),
    ("LGPL-2.1-or-later", ("lgpl.free",)),
    ("AGPL-3.0-or-later", ("agpl.free",)),
    ("BSD-3-Clause", ("bsd.may", "bsd.source", "bsd.binary", "bsd.names", "bsd.warranty")),
    ("BSD-2-Clause", ("bsd.may", "bsd.source", "bsd.binary", "bsd.warranty")),
    ("BSD-3-Clause", ("bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.source", "bsd.binary")),
    ("MPL-2.0", ("mpl.form", "mpl.copy")),
    ("MPL-2.0", ("mpl.form",)),
    ("ISC", ("isc.grant",)),
    ("Unlicense", ("unlicense.free",)),
    ("MIT", ("mit.ref",)),
    ("Apache-2.0", ("apache.ref",)),
    ("GPL-3.0-only", ("gpl3.ref",)),
    ("GPL-2.0-only", ("gpl2.ref",)),
    ("BSD-3-Clause", ("bsd.ref3",)),
    ("BSD-2-Clause", ("bsd.ref2",)),
    ("ISC", ("isc.ref",)),
    ("CC0-1.0", ("cc0.ref",)),
    ("CC-BY-4.0", ("cc.by",)),
    ("CC-BY-SA-4.0", ("cc.by-sa",)),
    ("CC-BY-NC-4.0", ("cc.by-nc",)),
    ("CC-BY-ND-4.0", ("cc.by-nd",)),
    ("CC-BY-NC-SA-4.0", ("cc.by-nc-sa",)),
    ("CC-BY-NC-ND-4.0", ("cc.by-nc-nd",)),
    ("All-Rights-Reserved", ("all.rights",)),
)

#: A sentence ends at a full stop, exclamation or question mark before white space, and at a blank line.
ENDS = r"[.!?][ \t\r\n\f\v]+|\r?\n[ \t]*\r?\n[ \t\r\n]*"
LINES = r"[\r\n]+"
_OTHER = "[^A-Za-z0-9.+]+"


def normalise(sentence: str) -> str:
    """ASCII letters in lower case, digits, full stops inside and plus signs; single spaces; no full stop at the end."""
    kept = re.sub(_OTHER, " ", sentence)
    return re.sub("[. ]+$", "", re.sub("^[. ]+", "", kept)).lower()


def known() -> dict[str, str]:
    """Normalised sentence -> identifier; SPDX tags are sentences too."""
    table = {normalise(s): name for name, sentences in SENTENCES.items() for s in sentences}
    return table | {normalise(f"SPDX-License-Identifier: {licence}"): f"spdx.{licence}" for licence in sorted({r[0] for r in rules()})}


def rules() -> list[tuple[str, tuple[str, ...]]]:
    licences = list(dict.fromkeys(licence for licence, _ in RULES))
    return [*RULES, *((licence, (f"spdx.{licence}",)) for licence in licences if licence != "All-Rights-Reserved")]


def marks() -> list[str]:
    """Words such that every known sentence has one: a text without any of them has no known sentence."""
    left, out = set(known()), []
    while left:
        words = sorted({w for s in left for w in s.split() if len(w) >= 6 and w.isalpha()})
        best = max(words, key=lambda w: (sum(w in s for s in left), len(w)))
        out.append(best)
        left = {s for s in left if best not in s}
    return out


def _written(names: tuple[str, ...]) -> str:
    """Identifiers as they stand in a sequence: each followed by a semicolon."""
    return "".join(f"{n};" for n in names)


def rule_pattern() -> str:
    """The rules as one ordered alternation."""
    return "|".join(re.escape(_written(names)).replace("\\-", "-") for _, names in rules())


def run_pattern() -> str:
    """Known sentences, the longest first, that fill whole lines; lines stand between bars."""
    written = (r"(?: |\|+)".join(map(re.escape, s.split())) for s in sorted(known(), key=lambda s: (-len(s), s)))
    return rf"(?<=\|)({'|'.join(written)})(?=\|)"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licenses, n_licenses of every row.

    sentence_ids are the identifiers found, in order, each followed by a semicolon; licenses are those of
    the rules that match, in order, joined by commas. Sentences are cut at their ends alone; in one that is
    not known as a whole, runs of whole lines are sought that are, from left to right and the longest first,
    so that a notice in one line and a wrapped one are both found. A null or empty text has none. Rows that repeat are judged alike. An empty table gives an empty result.
    """
    table, sequence_of = _map(known()), _map({_written(names): licence for licence, names in reversed(rules())})
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    body = F.when(whole.rlike("(?i)" + "|".join(marks())), whole).otherwise(F.lit(""))

    def identifiers() -> Column:
        clean = lambda s: F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, _OTHER, " "), "^[. ]+", ""), "[. ]+$", ""))
        marked = lambda s: F.concat(F.lit("|"), F.array_join(F.transform(F.split(s, LINES), clean), "|"), F.lit("|"))
        runs = lambda s: F.transform(F.regexp_extract_all(marked(s), F.lit(run_pattern()), F.lit(1)), lambda m: F.element_at(table, F.regexp_replace(m, r"\|+", " ")))
        return F.flatten(F.transform(F.split(body, ENDS), lambda s: F.when(F.element_at(table, clean(s)).isNotNull(), F.array(F.element_at(table, clean(s)))).otherwise(runs(s))))

    found = docs.select(F.col(key).cast("long").alias("doc_id"), identifiers().alias("_ids"))
    found = found.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join(F.transform("_ids", lambda x: F.concat(x, F.lit(";"))), "").alias("sentence_ids"))
    matches = F.transform(F.regexp_extract_all("sentence_ids", F.lit(f"({rule_pattern()})"), F.lit(1)), lambda m: F.element_at(sequence_of, m))
    found = found.withColumn("_licenses", matches)
    return found.select("doc_id", "n_sentences", "sentence_ids", F.array_join("_licenses", ",").alias("licenses"), F.size("_licenses").cast("long").alias("n_licenses"))


def scan_sql() -> str:
    """The same in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda pairs: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs)
    sequences = {_written(names): licence for licence, names in reversed(rules())}

    clean = lambda s: f"lower(regexp_replace(regexp_replace(regexp_replace({s}, {quoted(_OTHER)}, ' ', 'g'), '^[. ]+', ''), '[. ]+$', ''))"
    # two bars between lines, so that a match takes one on each side and needs no look around itself
    marked = f"'||' || array_to_string(list_transform(string_split_regex(part, {quoted(LINES)}), lambda l: {clean('l')}), '||') || '||'"
    run = run_pattern().removeprefix(r"(?<=\|)").removesuffix(r"(?=\|)")

    return f"""
WITH known(sentence, id) AS (VALUES {values(known().items())}), rule(seq, licence) AS (VALUES {values(sequences.items())}),
parts AS (SELECT doc_id, part, place, {clean('part')} AS sentence FROM (SELECT doc_id, unnest(p) AS part, unnest(range(len(p))) AS place
          FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), {quoted(ENDS)}) AS p FROM documents))),
runs AS (SELECT doc_id, place, unnest(m) AS run, unnest(range(len(m))) AS nth
         FROM (SELECT doc_id, place, regexp_extract_all({marked}, {quoted(chr(92) + '|' + run + chr(92) + '|')}, 1) AS m FROM parts ANTI JOIN known USING (sentence))),
found AS (SELECT doc_id, place, 0 AS nth, id FROM parts JOIN known USING (sentence)
          UNION ALL SELECT doc_id, place, nth, id FROM runs JOIN known ON known.sentence = regexp_replace(run, '[|]+', ' ', 'g')),
listed AS (SELECT doc_id, list(id ORDER BY place, nth) AS ids FROM found GROUP BY doc_id),
ids AS (SELECT documents.doc_id, coalesce(listed.ids, []) AS ids FROM documents LEFT JOIN listed USING (doc_id)),
seqs AS (SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(list_transform(ids, lambda x: x || ';'), ''), '') AS sentence_ids FROM ids),
hits AS (SELECT *, regexp_extract_all(sentence_ids, {quoted(rule_pattern())}) AS m FROM seqs),
named AS (SELECT doc_id, string_agg(licence, ',' ORDER BY i) AS licenses FROM (SELECT doc_id, unnest(m) AS seq, unnest(range(len(m))) AS i FROM hits) JOIN rule USING (seq) GROUP BY doc_id)
SELECT hits.doc_id, n_sentences, sentence_ids, coalesce(licenses, '') AS licenses, CAST(len(m) AS BIGINT) AS n_licenses
FROM hits LEFT JOIN named USING (doc_id)
"""
