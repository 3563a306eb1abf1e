"""Licence scan: known licence sentences, then ordered rules over their sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences as running text states them, and their identifiers.
NAMES = {
    "Apache License, Version 2.0": "Apache-2.0", "Apache License 2.0": "Apache-2.0", "Apache 2.0 License": "Apache-2.0", "Apache-2.0 License": "Apache-2.0",
    "MIT License": "MIT", "MIT-style License": "MIT", "X11 License": "X11", "ISC License": "ISC", "zlib License": "Zlib", "Boost Software License, Version 1.0": "BSL-1.0",
    "BSD License": "BSD", "2-clause BSD License": "BSD-2-Clause", "BSD 2-Clause License": "BSD-2-Clause", "Simplified BSD License": "BSD-2-Clause",
    "3-clause BSD License": "BSD-3-Clause", "BSD 3-Clause License": "BSD-3-Clause", "New BSD License": "BSD-3-Clause", "Modified BSD License": "BSD-3-Clause", "BSD-style License": "BSD",
    "GNU General Public License": "GPL", "GNU General Public License, version 2": "GPL-2.0-only", "GNU General Public License, version 3": "GPL-3.0-only",
    "GNU General Public License, version 2 or later": "GPL-2.0-or-later", "GNU General Public License, version 3 or later": "GPL-3.0-or-later",
    "GNU Lesser General Public License": "LGPL", "GNU Lesser General Public License, version 2.1": "LGPL-2.1-only", "GNU Lesser General Public License, version 3": "LGPL-3.0-only",
    "GNU Affero General Public License, version 3": "AGPL-3.0-only", "GNU Free Documentation License, version 1.3": "GFDL-1.3-only",
    "GPL, version 2": "GPL-2.0-only", "GPL, version 3": "GPL-3.0-only", "GPL": "GPL", "LGPL": "LGPL",
    "Mozilla Public License, Version 2.0": "MPL-2.0", "Mozilla Public License, v. 2.0": "MPL-2.0", "Eclipse Public License 2.0": "EPL-2.0",
    "CC0 1.0": "CC0-1.0", "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY-ND 4.0": "CC-BY-ND-4.0",
    "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "CC BY 3.0": "CC-BY-3.0", "CC BY-SA 3.0": "CC-BY-SA-3.0",
    "Creative Commons Attribution 4.0 International License": "CC-BY-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0",
}
# Sentences of licence texts and headers, and their identifiers.
SENTENCES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit-notice",
    "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.": "mit-notice",
    "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.": "mit-as-is",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc-grant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0bsd-grant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd-grant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd-source",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd-binary",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd-names",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement:": "bsd-advert",
    "You may not use this file except in compliance with the License.": "apache-comply",
    "You may obtain a copy of the License at": "apache-copy",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-url",
    "https://www.apache.org/licenses/LICENSE-2.0": "apache-url",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.": "apache-as-is",
    "See the License for the specific language governing permissions and limitations under the License.": "apache-see",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.": "gpl-2-later",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.": "gpl-2-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3-later",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl-terms",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "gpl-2",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "lgpl-terms",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "lgpl-3-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "agpl-3-later",
    "either version 2 of the License, or (at your option) any later version.": "later-2",
    "either version 2.1 of the License, or (at your option) any later version.": "later-2.1",
    "either version 3 of the License, or (at your option) any later version.": "later-3",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.": "gpl-hope",
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.": "gpl-implied",
    "See the GNU General Public License for more details.": "gpl-see",
    "You should have received a copy of the GNU General Public License along with this program.": "gpl-copy",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.": "mpl-copy",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib-grant",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:": "bsl-grant",
    "Distributed under the Boost Software License, Version 1.0.": "under-BSL-1.0",
    "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.": "cc0-waiver",
    "All rights reserved.": "all-rights",
}
#: Rules in order of precedence: a sequence of sentence identifiers that stand next to each other, and the licence it means. A match uses up its sentences.
RULES = (
    ("bsd-grant bsd-source bsd-binary bsd-advert bsd-names", "BSD-4-Clause"), ("bsd-grant bsd-source bsd-binary bsd-names", "BSD-3-Clause"), ("bsd-grant bsd-source bsd-binary", "BSD-2-Clause"),
    ("mit-grant mit-notice mit-as-is", "MIT"), ("mit-grant mit-notice", "MIT"), ("isc-grant", "ISC"), ("0bsd-grant", "0BSD"),
    *((f"{start}apache-comply{rest}", "Apache-2.0") for start in ("under-Apache-2.0 ", "") for rest in (" apache-copy apache-url apache-as-is apache-see", " apache-copy apache-as-is apache-see", " apache-copy apache-url", " apache-copy")),
    ("under-Apache-2.0 apache-comply", "Apache-2.0"),
    ("gpl-2-later gpl-copy", "GPL-2.0-or-later"), ("gpl-3-later gpl-copy", "GPL-3.0-or-later"), ("gpl-2-later", "GPL-2.0-or-later"), ("gpl-3-later", "GPL-3.0-or-later"), ("gpl-2", "GPL-2.0-only"),
    ("gpl-terms later-2", "GPL-2.0-or-later"), ("gpl-terms later-3", "GPL-3.0-or-later"), ("lgpl-terms later-2.1", "LGPL-2.1-or-later"), ("lgpl-terms later-3", "LGPL-3.0-or-later"), ("lgpl-3-later", "LGPL-3.0-or-later"),
    ("agpl-3-later", "AGPL-3.0-or-later"), ("mpl-2 mpl-copy", "MPL-2.0"), ("mpl-2", "MPL-2.0"), ("unlicense", "Unlicense"), ("zlib-grant", "Zlib"), ("bsl-grant", "BSL-1.0"), ("cc0-waiver", "CC0-1.0"),
    *((f"{way}-{x}", x) for way in ("spdx", "under") for x in dict.fromkeys(NAMES.values())), ("all-rights", "Proprietary"),
)
#: A licence that counts only where no rule before gives another: many open licences reserve all rights first.
ALONE = "Proprietary"
#: Words of which a licence sentence has one, before and after its letters are lower-cased.
CRITICAL = "(?i)licen[cs]e|copyright|permission|permitted|redistribut|warrant|public domain|rights reserved|cc[ -]by|cc0|free software foundation|mozilla.org/mpl|advertising materials"
#: Steps before lines are joined: line ends, comment signs, list marks.
LINES = (("\r\n?", "\n"), (r"(^|\n)[ \t]*(?://+|#+|/?[*]+/?|;+|--+|<!--|dnl |REM )", "$1"), (r"(^|\n)[ \t]*(?:[0-9]{1,2}[.)]|[(][a-z0-9]{1,2}[)]|[-•])[ \t]+", "$1\n"), ("[ \t]+(\n|$)", "$1"))
#: A line that the next one goes on from: of a length that texts are wrapped at, and without an end; and starts that never go on from the line before.
WRAPPED, STARTS = r"^.{50,99}$", r"^[ \t]*(?:$|Licensed |Released |This work |This software |This program |This file |Permission |Redistribution|SPDX|All rights |https?://)"
OPEN_END = r"[A-Za-z0-9,()\"'/-]$"
#: Steps that end sentences at marks followed by white space.
ENDS = ((r"([ (]v)[.] ([0-9])", "$1 $2"), (r"([.!?;]|(?:conditions|restrictions|following|met|that|at):)[ \t]+", "$1\n"))
#: Steps of normalisation: pattern, replacement. $1 stands for the first group.
STEPS = (
    ("licence", "license"), ("[^a-z0-9.+]+", " "), (r"[.]+( |$)", " "), (" v(?:ersion)? ?([0-9])", " $1"), (" +", " "), ("^ | $", ""), ("^(under .*|.* under .*) the license$", "$1"),
    ("^(?:it|(?:this|the|all|these|our)(?: [a-z]+){1,3}) (?:is|are) (?:also )?", ""),
    ("^(?:hereby )?(?:licensed|released|distributed|made available|available|published|provided|shared) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:an |a )?", "under "),
)


def normalised(sentence: Column) -> Column:
    """Lower case, punctuation and the words for the licensed thing and for licensing evened out."""
    return _stepped(F.lower(sentence), STEPS)


def _known() -> list[tuple[str, str]]:
    """Sentences and their identifiers; those that name a licence follow from its names."""
    ids = dict.fromkeys(NAMES.values())
    return [*((f"Licensed under the {n}.", f"under-{x}") for n, x in NAMES.items()), *((f"SPDX-License-Identifier: {x}", f"spdx-{x}") for x in ids), *SENTENCES.items()]


def _marked(sequence: str) -> str:
    """Identifiers as they stand in a list: each between commas of its own."""
    return "".join(f",{i}," for i in sequence.split())


def _stepped(x: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    for pattern, put in steps:
        x = F.regexp_replace(x, F.lit(pattern), F.lit(put))
    return x


def sentences(text: Column) -> tuple[Column, Column]:
    """The lines of a text, and, once they are the column `lines`, its sentences.

    Comment signs and list marks at line starts go. Lines of 50 to 99 characters without a mark at their end are wrapped ones, which the next line goes on from.
    Sentences end at the other line ends, and at white space after a full stop, exclamation mark, question mark, semicolon, or a colon that leads a list in.
    """
    lines = F.split(_stepped(text, LINES), "\n")
    onward = lambda x, i: x.rlike(WRAPPED) & x.rlike(OPEN_END) & ~F.coalesce(F.get(F.col("lines"), i + 1).rlike(STARTS), F.lit(True))
    joined = F.array_join(F.transform("lines", lambda x, i: F.concat(x, F.when(onward(x, i), F.lit(" ")).otherwise(F.lit("\n")))), "")
    return lines, F.filter(F.split(_stepped(joined, ENDS), "\n"), lambda x: F.trim(x) != "")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, licenses, sentences, unknown.

    Texts are cut into sentences as sentences() says. The normalised text of those with a critical word is looked up among the known ones; `sentences` is the array of the identifiers found, in order, and
    unknown the number of those with a critical word that aren't known. Then the rules are tried in order on the sequence of identifiers, in which any other sentences
    hold a place: each rule takes its sequence out wherever it stands, leaves a mark there, so that what stood on both sides never becomes neighbours,
    and adds its licence; licenses is the array of different licences in order of the rules. Null and
    empty texts have none. Ids may repeat; each row gives a row. All of it are built-in expressions on the row: no shuffle, no Python.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(_known(), "sentence string, id string").select(normalised(F.col("sentence")).alias("key"), "id").distinct().collect()
    ids = F.create_map(*(F.lit(x) for r in known for x in (r["key"], r["id"])))
    rules = F.array(*(F.struct(F.lit(_marked(seq)).alias("ids"), F.lit(x).alias("license")) for seq, x in RULES))
    none, any_ = F.array().cast("array<string>"), F.col("text").rlike(CRITICAL)

    lines, cut = sentences(F.col("text"))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(any_, F.col("text")).alias("text")).withColumn("lines", F.when(F.col("text").isNotNull(), lines))
    found = found.withColumn("all", F.transform(F.coalesce(cut, none), lambda x: F.when(x.rlike(CRITICAL), F.coalesce(F.try_element_at(ids, normalised(x)), F.lit("?"))).otherwise(F.lit("-"))))
    found = found.withColumn("sentences", F.filter("all", lambda x: ~x.isin("?", "-"))).withColumn("unknown", F.size(F.filter("all", lambda x: x == "?")))

    start = F.struct(F.concat(F.lit(","), F.array_join("all", ",,"), F.lit(",")).alias("left"), none.alias("got"))
    step = lambda acc, r: F.when(acc["left"].contains(r["ids"]), F.struct(F.replace(acc["left"], r["ids"], F.lit(",-,")).alias("left"), F.array_append(acc["got"], r["license"]).alias("got"))).otherwise(acc)
    matched = F.array_distinct(F.when(F.size("sentences") > 0, F.aggregate(rules, start, step)["got"]).otherwise(none))
    matched = F.when(F.size(matched) > 1, F.array_remove(matched, ALONE)).otherwise(matched)
    return found.select("doc_id", matched.alias("licenses"), "sentences", F.col("unknown").cast("long").alias("unknown"))


def as_sql() -> str:
    """The scan in DuckDB's SQL over documents, with the arrays joined by commas, licenses sorted."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def stepped(x: str, steps: tuple[tuple[str, str], ...]) -> str:
        for pattern, put in steps:
            x = f"regexp_replace({x}, {q(pattern)}, {q(put.replace('$', chr(92)))}, 'g')"
        return x

    even = lambda x: stepped(f"lower({x})", STEPS)
    taken = [f"case when contains(l{k}, {q(_marked(seq))}) then {q(x)} end" for k, (seq, x) in enumerate(RULES)]
    steps = "".join(f", r{k + 1} as (select *, replace(l{k}, {q(_marked(seq))}, ',-,') as l{k + 1} from r{k})" for k, (seq, _) in enumerate(RULES))
    onward = f"regexp_matches(x, {q(WRAPPED)}) and regexp_matches(x, {q(OPEN_END)}) and not coalesce(regexp_matches(lines[i + 1], {q(STARTS)}), true)"
    return f"""
with known as (select distinct {even('s')} as key, id from (values {', '.join(f'({q(s)}, {q(i)})' for s, i in _known())}) t(s, id)),
docs as (select row_number() over () as n, doc_id, case when regexp_matches(text, {q(CRITICAL)}) then text end as text from documents),
lined as (select n, string_split({stepped('text', LINES)}, chr(10)) as lines from docs where text is not null),
cut as (select n, string_split({stepped(f"array_to_string(list_transform(lines, lambda x, i: x || case when {onward} then ' ' else chr(10) end), '')", ENDS)}, chr(10)) as parts from lined),
each as (select n, unnest(parts) as s, generate_subscripts(parts, 1) as place from cut),
mapped as (select n, place, case when regexp_matches(s, {q(CRITICAL)}) then coalesce(id, '?') else '-' end as id from (select n, place, s, {even('s')} as key from each where trim(s) <> '') left join known using (key)),
put as (select n, string_agg(id, ',' order by place) filter (id not in ('?', '-')) as sentences, count(*) filter (id = '?') as unknown, string_agg(',' || id || ',', '' order by place) as whole from mapped group by n),
r0 as (select doc_id, coalesce(sentences, '') as sentences, coalesce(unknown, 0) as unknown, case when sentences is not null then whole else '' end as l0 from docs left join put using (n)){steps}
select doc_id, array_to_string(list_sort(case when len(got) > 1 then list_filter(got, lambda x: x <> {q(ALONE)}) else got end), ',') as licenses, sentences, unknown
from (select doc_id, sentences, unknown, list_distinct(list_filter([{', '.join(taken)}], lambda x: x is not null)) as got from r{len(RULES)})
"""
