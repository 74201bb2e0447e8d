"""Licence recognition by sentence rules, with DataFrame functions only.

Text is cut into sentences (at lines without letters and digits, and after ``.``, ``!``, ``?``, ``;`` or ``:`` before
white space, but not within an SPDX line), each is normalised (lower case, runs of other characters than letters and digits,
so line feeds and comment marks too, become one space) and looked up among known licence sentences. In a sentence
that is not known, each line is looked up by itself, and then all from that line on. The identifiers found, in text order, are matched against licence
rules, the first rule first: a rule whose identifiers stand next to each other in the sequence names a
licence and uses them up, so a full text is not reported again by its parts.

Licence sentences with a cut mark inside, such as the grant of the GPL, are known by their pieces.
Each text is judged by itself in one projection: nothing is shuffled, and texts of any length
or repeats need no rule. A null text has no sentences. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table

# Known sentences as they stand in licence texts and notices, with their identifiers.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "mit-title": ["MIT License", "The MIT License (MIT)", "The MIT License"],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": [
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    ],
    "apache-title": ["Apache License", "Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "apache-body": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-or-mit": ["Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "SPDX-License-Identifier: Apache-2.0 OR MIT", "SPDX-License-Identifier: MIT OR Apache-2.0"],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "SPDX-License-Identifier: Apache-2.0"],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-warranty": [
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2-notice": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "gnu-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "agpl-preamble": ["The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."],
    "lgpl3-body": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "gpl2-classpath": ["SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0"],
    "classpath-exception": ["Linking this library statically or dynamically with other modules is making a combined work based on this library."],
    "gpl3-gcc": ["SPDX-License-Identifier: GPL-3.0-or-later WITH GCC-exception-3.1"],
    "gcc-exception": ["Under Section 7 of GPL version 3, you are granted additional permissions described in the GCC Runtime Library Exception, version 3.1, as published by the Free Software Foundation."],
    "gpl-program": ["This program is free software:"],
    "gpl3-redistribute": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-redistribute": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;"],
    "gpl2-version": ["either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"],
    "gpl-implied": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-details": ["See the GNU General Public License for more details."],
    "agpl-notice": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later", "This work is licensed under the GNU Affero General Public License, version 3."],
    "agpl-redistribute": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-notice": ["SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later", "Licensed under the GNU Lesser General Public License, version 3."],
    "lgpl3-redistribute": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-library": ["This library is free software:"],
    "lgpl21-redistribute": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;"],
    "lgpl21-version": ["either version 2.1 of the License, or (at your option) any later version."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-warranty": [
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    ],
    "bsd3-notice": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License."],
    "bsd2-notice": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License."],
    "isc-title": ["ISC License", "The ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-notice": ["SPDX-License-Identifier: ISC"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "mpl-title": ["Mozilla Public License Version 2.0"],
    "mpl-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "mpl-notice": ["SPDX-License-Identifier: MPL-2.0"],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by-notice": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc0-notice": ["SPDX-License-Identifier: CC0-1.0", "This work is dedicated to the public domain."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "unlicense-free": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ],
    "boost-title": ["Boost Software License - Version 1.0 - August 17th, 2003"],
    "boost-notice": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "zlib-warranty": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib-notice": ["SPDX-License-Identifier: Zlib"],
    "epl-notice": ["SPDX-License-Identifier: EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "eupl-notice": [
        "SPDX-License-Identifier: EUPL-1.2",
        "Licensed under the EUPL, Version 1.2.",
        'Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the "Licence");',
    ],
    "artistic-title": ["The Artistic License 2.0"],
    "artistic-notice": ["SPDX-License-Identifier: Artistic-2.0", "Licensed under the Artistic License 2.0."],
    "cddl-title": ["COMMON DEVELOPMENT AND DISTRIBUTION LICENSE (CDDL) Version 1.0"],
    "cddl-form": ['The contents of this file are subject to the terms of the Common Development and Distribution License (the "License").'],
    "cddl-notice": ["SPDX-License-Identifier: CDDL-1.0"],
    "mspl-title": ["Microsoft Public License (Ms-PL)"],
    "mspl-body": ["This license governs use of the accompanying software."],
    "mspl-notice": ["SPDX-License-Identifier: MS-PL"],
}

# Licence and the identifiers it shows, in the order in which rules apply.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-title", "mit-grant", "mit-condition"]),
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy", "apache-warranty", "apache-see"]),
    ("Apache-2.0", ["apache-notice", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-title", "apache-body"]),
    ("GPL-3.0 WITH GCC-exception-3.1", ["gpl-program", "gpl3-redistribute", "gpl-hope", "gpl-implied", "gpl-details", "gcc-exception"]),
    ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-program", "gpl2-redistribute", "gpl2-version", "gpl-hope", "gpl-implied", "gpl-details", "classpath-exception"]),
    ("GPL-3.0", ["gpl3-title", "gnu-verbatim", "gpl3-preamble"]),
    ("GPL-2.0", ["gpl2-title", "gnu-verbatim"]),
    ("AGPL-3.0", ["agpl-title", "gnu-verbatim", "agpl-preamble"]),
    ("LGPL-3.0", ["lgpl3-title", "gnu-verbatim", "lgpl3-body"]),
    ("LGPL-2.1", ["lgpl21-title", "gnu-verbatim"]),
    ("CDDL-1.0", ["cddl-form", "apache-comply"]),
    ("MS-PL", ["mspl-title", "mspl-body"]),
    ("GPL-3.0", ["gpl-program", "gpl3-redistribute", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-3.0", ["gpl-program", "gpl3-redistribute", "gpl-hope"]),
    ("GPL-2.0", ["gpl-program", "gpl2-redistribute", "gpl2-version", "gpl-hope", "gpl-implied", "gpl-details"]),
    ("GPL-2.0", ["gpl-program", "gpl2-redistribute", "gpl2-version"]),
    ("AGPL-3.0", ["gpl-program", "agpl-redistribute"]),
    ("LGPL-3.0", ["lgpl-library", "lgpl3-redistribute"]),
    ("LGPL-2.1", ["lgpl-library", "lgpl21-redistribute", "lgpl21-version"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-title", "isc-grant"]),
    ("MPL-2.0", ["mpl-form", "mpl-copy"]),
    ("Unlicense", ["unlicense", "unlicense-free"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("MIT", ["mit-grant"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-title"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0", ["gpl3-redistribute"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("AGPL-3.0", ["agpl-notice"]),
    ("AGPL-3.0", ["agpl-redistribute"]),
    ("LGPL-3.0", ["lgpl-notice"]),
    ("LGPL-3.0", ["lgpl3-redistribute"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-notice"]),
    ("0BSD", ["0bsd-grant"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("MPL-2.0", ["mpl-form"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense"]),
    ("BSL-1.0", ["boost-title"]),
    ("BSL-1.0", ["boost-notice"]),
    ("Zlib", ["zlib-grant"]),
    ("Zlib", ["zlib-notice"]),
    ("EPL-2.0", ["epl-notice"]),
    ("Apache-2.0 OR MIT", ["apache-or-mit"]),
    ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl2-classpath"]),
    ("GPL-3.0 WITH GCC-exception-3.1", ["gpl3-gcc"]),
    ("GPL-3.0", ["gpl3-title"]),
    ("GPL-2.0", ["gpl2-title"]),
    ("AGPL-3.0", ["agpl-title"]),
    ("LGPL-3.0", ["lgpl3-title"]),
    ("LGPL-3.0", ["lgpl3-body"]),
    ("LGPL-2.1", ["lgpl21-title"]),
    ("MPL-2.0", ["mpl-title"]),
    ("EUPL-1.2", ["eupl-notice"]),
    ("Artistic-2.0", ["artistic-title"]),
    ("Artistic-2.0", ["artistic-notice"]),
    ("CDDL-1.0", ["cddl-title"]),
    ("CDDL-1.0", ["cddl-form"]),
    ("CDDL-1.0", ["cddl-notice"]),
    ("MS-PL", ["mspl-title"]),
    ("MS-PL", ["mspl-notice"]),
]
CUT = r"\n(?:[^A-Za-z0-9\n]*\n)+|(?<!SPDX-License-Identifier:)(?<=[.!?;:])[\x20\x09-\x0D]+"


def normal(sentence: str) -> str:
    """The form of a sentence that is compared, in Python."""
    out = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(out.split())


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def scanned(docs: DataFrame, sentences: dict[str, list[str]] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licences (both in text order, comma-joined; empty if none)."""
    known = {normal(s): name for name, forms in (SENTENCES if sentences is None else sentences).items() for s in forms}
    ordered = RULES if rules is None else rules
    lengths = sorted({len(s) for s in known})
    names = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    # each line of a sentence has a word, so a known one has no more lines than this
    most = max(len(s.split()) for s in known)

    def look(x: Column) -> Column:
        # only what has a known length is normalised in full and looked up
        return F.when(F.length(x) >= lengths[0], F.element_at(names, _normal(x)))

    def by_line(x: Column) -> Column:
        lines = F.split(x, "\n", -1)

        def at(line: Column, i: Column) -> Column:
            left = F.size(lines) - i
            rest = F.when((i > 0) & (left > 1) & (left <= most), look(F.array_join(F.slice(lines, i + 1, left), " ")))
            return F.coalesce(look(line), rest)

        return F.transform(lines, at)

    parts = F.filter(F.split(F.coalesce("text", F.lit("")), CUT, -1), lambda x: F.length(x) >= lengths[0])
    whole = F.transform(parts, lambda x: F.struct(x.alias("x"), look(x).alias("id")))
    ids = F.flatten(F.transform(whole, lambda w: F.when(w["id"].isNotNull() | ~F.contains(w["x"], F.lit("\n")), F.array(w["id"])).otherwise(by_line(w["x"]))))
    ids = F.filter(ids, lambda x: x.isNotNull())
    rule = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("," + "".join(f"{i}," for i in need)).alias("need")) for name, need in ordered))
    first = F.struct(F.col("sequence").alias("left"), F.array().cast("array<struct<at:int,name:string>>").alias("found"))

    def apply(acc: Column, r: Column) -> Column:
        at = F.call_function("instr", acc["left"], r["need"])
        one = F.array(F.struct(at.alias("at"), r["name"].alias("name"))).cast("array<struct<at:int,name:string>>")
        # what is used up becomes as many bars, so the places of the rest stay
        used = F.replace(acc["left"], r["need"], F.concat(F.lit(","), F.repeat(F.lit("|"), F.length(r["need"]) - 2), F.lit(",")))
        return F.when(at > 0, F.struct(used.alias("left"), F.concat(acc["found"], one).alias("found"))).otherwise(acc)

    chosen = F.when(F.size("ids") > 0, F.aggregate(rule, first, apply, lambda acc: F.array_distinct(F.transform(F.sort_array(acc["found"]), lambda x: x["name"]))))
    return (
        docs.select("doc_id", ids.alias("ids"))
        .withColumn("sequence", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")))
        .select(
            "doc_id",
            F.size("ids").cast("long").alias("n_sentences"),
            F.array_join("ids", ",").alias("sentence_ids"),
            F.coalesce(F.array_join(chosen, ","), F.lit("")).alias("licences"),
        )
    )


def op4_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _sql() -> str:
    forms = {normal(s): name for name, forms in SENTENCES.items() for s in forms}
    known = ", ".join(f"('{form}', '{name}')" for form, name in forms.items())
    rules = ", ".join("({}, '{}', ',{},')".format(i, name, ",".join(need)) for i, (name, need) in enumerate(RULES))
    short, most = min(map(len, forms)), max(len(s.split()) for s in forms)
    return rf"""
WITH RECURSIVE known(form, id) AS (VALUES {known}),
rules(place, name, need) AS (VALUES {rules}),
cut AS (SELECT doc_id, string_split(regexp_replace(replace(replace(coalesce(text, ''), chr(1), ' '), 'SPDX-License-Identifier:', 'SPDX-License-Identifier '),
          '\n(?:[^A-Za-z0-9\n]*\n)+|([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM documents),
part AS (SELECT doc_id, x, i, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS form
         FROM (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM cut) WHERE length(x) >= {short}),
whole AS (SELECT part.*, id FROM part LEFT JOIN known USING (form)),
line AS (SELECT doc_id, i, j, len(ls) - j + 1 AS rest, ls[j] AS x, array_to_string(ls[j:], ' ') AS xs
         FROM (SELECT doc_id, i, string_split(x, chr(10)) AS ls, unnest(generate_series(1, len(string_split(x, chr(10))))) AS j FROM whole WHERE id IS NULL AND contains(x, chr(10)))),
looked AS (SELECT line.doc_id, i, j, coalesce(a.id, CASE WHEN j > 1 AND rest BETWEEN 2 AND {most} THEN b.id END) AS id
           FROM line LEFT JOIN known a ON length(x) >= {short} AND a.form = trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))
                     LEFT JOIN known b ON b.form = trim(regexp_replace(lower(xs), '[^a-z0-9]+', ' ', 'g'))),
k AS (SELECT doc_id, id, i, 0 AS j FROM whole WHERE id IS NOT NULL UNION ALL SELECT doc_id, id, i, j FROM looked WHERE id IS NOT NULL),
g AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY i, j) AS ids FROM k GROUP BY doc_id),
r AS (
  SELECT doc_id, -1 AS place, ',' || ids || ',' AS left_over, 0 AS pos, '' AS name FROM g
  UNION ALL
  SELECT r.doc_id, rules.place,
         CASE WHEN contains(left_over, need) THEN replace(left_over, need, ',' || repeat('|', CAST(length(need) - 2 AS BIGINT)) || ',') ELSE left_over END,
         CAST(strpos(left_over, need) AS INTEGER), rules.name
  FROM r JOIN rules ON rules.place = r.place + 1),
f AS (SELECT doc_id, name, min(pos) AS pos FROM r WHERE pos > 0 GROUP BY doc_id, name),
l AS (SELECT doc_id, string_agg(name, ',' ORDER BY pos, name) AS licences FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0) AS n_sentences, coalesce(g.ids, '') AS sentence_ids, coalesce(l.licences, '') AS licences
FROM documents d LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)
"""


ORACLE = _sql()
