"""Licence scan with a positional rare-token index; DataFrame functions only.

A licence template is a word sequence with mandatory key phrases at fixed places.
The index is made of the templates: of each, the ``RARE`` mandatory words that stand in
the fewest templates (highest inverse document frequency) have postings
(word, template, position).  The scan looks up the index words that a text holds, turns
each occurrence into the places where templates would begin, and intersects the
postings: a template can begin only where all of its index words say so.  There the
mandatory key phrases are verified by relative position.  All index words are mandatory
words, so the look-up loses nothing, whichever words are taken as rare.  Long licences
have a template for each paragraph that tells them apart; an edited one is found while
its key phrases stand, with the share of its words as coverage.

The scan is one map over the documents without a shuffle or a first pass.  Most texts
have none of a few words of which every template and phrase has one; they are done then.

Defined results: a null text counts as empty: no words, no labels, score and coverage 0;
repeated rows give repeated results; an empty table gives an empty one; templates and
phrases may overlap, all places count; other columns are not read.  A text is held
whole by the task that reads it, at some 60 bytes for each of its words if it holds an
index word.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


RARE = 3  # index words of a template


def _split(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


@dataclass(frozen=True)
class Template:
    """``keys``: phrases of ``text`` that must stand at their places."""

    label: str
    text: str
    keys: tuple[str, ...]

    @cached_property
    def words(self) -> list[str]:
        return _split(self.text)

    @cached_property
    def mandatory(self) -> list[int]:
        """Places of the words of the key phrases."""
        w, out = self.words, set()
        for key in self.keys:
            k = _split(key)
            at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            out.update(range(at, at + len(k)))
        return sorted(out)


#: Wording of public licences and of the notices that name them.
TEMPLATES = (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template(
        "agpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ("under the terms of the GNU Affero General Public License", "version 3 of the License"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
        to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("except in compliance with the License", "Unless required by applicable law", "governing permissions and limitations"),
    ),
    Template("artistic-2.0", "the artistic license 2 0", ("artistic license 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms", "modification are permitted")),
    Template(
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY""",
        ("Redistributions of source code must retain", "Redistributions in binary form must reproduce", "provided with the distribution THIS SOFTWARE IS PROVIDED"),
    ),
    Template(
        "bsd-3-clause",
        """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
        ("nor the names of its contributors", "endorse or promote products derived from this software"),
    ),
    Template(
        "bsd",
        """IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        ("COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE", "PROCUREMENT OF SUBSTITUTE GOODS"),
    ),
    Template("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    Template(
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software""",
        ("accompanying documentation covered by this license", "use reproduce display distribute execute and transmit"),
    ),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by", "licensed under a creative commons attribution", ("creative commons attribution",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.", ("Creative Commons Attribution ShareAlike",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("epl-2.0", "eclipse public license v 2 0", ("eclipse public license",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template(
        "gpl-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("under the terms of the GNU General Public License", "either version 2 of the License"),
    ),
    Template(
        "gpl-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        ("under the terms of the GNU General Public License", "either version 3 of the License"),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
        CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("this permission notice appear in all copies", "THE AUTHOR DISCLAIMS ALL WARRANTIES", "OTHER TORTIOUS ACTION"),
    ),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template(
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        ("This library is free software", "GNU Lesser General Public License"),
    ),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "obtaining a copy")),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("to deal in the Software without restriction", "publish distribute sublicense and or sell copies", "substantial portions of the Software"),
    ),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template(
        "mpl-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("This Source Code Form is subject to", "copy of the MPL was not distributed"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        ("Permission is granted to anyone to use this software", "to alter it and redistribute it freely"),
    ),
)


def normal(text: Column) -> Column:
    """The words in lower case, with one space between them.  The Kelvin sign is
    kept from turning into an ASCII k."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.trim(F.regexp_replace(plain, SEPARATORS, " "))


def words_of(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside its lambdas."""
    return F.transform(F.array(value), body)[0]


def rare_words(templates) -> list[list[int]]:
    """Of each template, the places of its index words: the mandatory words that stand in
    the fewest templates, the longest and first of equals."""
    held = Counter(w for t in templates for w in set(t.words))
    rank = lambda t, i: (held[t.words[i]], -len(t.words[i]), i)
    return [sorted(t.mandatory, key=lambda i: rank(t, i))[:RARE] for t in templates]


def cover(word_sets) -> list[str]:
    """Few words of which every set has one, six letters or more where there are such."""
    rest, out = [set(s) for s in word_sets], []
    while rest:
        held = Counter(w for s in rest for w in s)
        out.append(max(held, key=lambda w: (len(w) >= 6, held[w], len(w), w)))
        rest = [s for s in rest if out[-1] not in s]
    return out


def _array(rows, kind: str) -> Column:
    nested = kind.count("array") > 1
    return F.array(*(F.array(*map(F.lit, r)) if nested else F.lit(r) for r in rows)).cast(kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> DataFrame:
    """One row per document: words, places of the plain phrases, labels, score and coverage.

    The score is the largest share of a found template's words that stand at their
    places, or 1 if a plain phrase is found; the coverage is that share of the found
    template with the most such words, so a licence text is not hidden by its first line.
    """
    rare = rare_words(templates)
    postings: dict[str, list[tuple[int, int]]] = {}
    for k, (t, places) in enumerate(zip(templates, rare)):
        for i in places:
            postings.setdefault(t.words[i], []).append((k, i))
    index = F.create_map(*(x for w, ps in postings.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("t"), F.lit(i).alias("i")) for k, i in ps)))))
    index_words, needed = _array(postings, "array<string>"), _array([len(r) for r in rare], "array<int>")
    words, mandatory = _array([t.words for t in templates], "array<array<string>>"), _array([t.mandatory for t in templates], "array<array<int>>")
    labels = _array([t.label for t in templates], "array<string>")

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def places(w: Column) -> Column:
        """Starts of the plain phrases, ascending."""
        def here(i):
            hit = F.lit(False)
            for p in phrases:
                one = F.lit(True)
                for j, x in enumerate(p.split()):
                    one = one & (F.get(w, i + j) == x)
                hit = hit | F.coalesce(one, F.lit(False))
            return hit

        return F.filter(numbers(F.size(w)), here)

    def stands(w: Column, c: Column, m: Column) -> Column:
        return F.coalesce(F.get(w, c["at"] + m) == F.get(F.get(words, c["t"]), m), F.lit(False))

    def begun(w: Column) -> Column:
        """(template, place) of each posting of each index word of the text, sorted."""
        at = F.filter(numbers(F.size(w)), lambda i: F.array_contains(index_words, F.get(w, i)))
        begins = F.transform(at, lambda i: F.transform(F.element_at(index, F.get(w, i)), lambda p: F.struct(p["t"].alias("t"), (i - p["i"]).alias("at"))))
        return F.sort_array(F.flatten(begins))

    def met(sorted_: Column) -> Column:
        """Those that all index words of the template agree on."""
        def last(k):
            x = F.get(sorted_, k)
            n = F.get(needed, x["t"])
            return (F.get(sorted_, k - n + 1) == x) & ~F.coalesce(F.get(sorted_, k + 1) == x, F.lit(False))

        return F.transform(F.filter(numbers(F.size(sorted_)), lambda k: F.coalesce(last(k), F.lit(False))), lambda k: F.get(sorted_, k))

    def found(w: Column) -> Column:
        """(label, share of the words) of each template at each place where it is verified."""
        fits = F.filter(let(begun(w), met), lambda c: F.forall(F.get(mandatory, c["t"]), lambda m: stands(w, c, m)))
        count = lambda c: F.size(F.filter(numbers(F.size(F.get(words, c["t"]))), lambda m: stands(w, c, m)))
        return F.transform(fits, lambda c: F.struct(count(c).alias("n"), F.get(labels, c["t"]).alias("label"), F.size(F.get(words, c["t"])).alias("of")))

    kind = "array<struct<n:int,label:string,of:int>>"
    step = docs.select(F.col(id_col), normal(F.col(text_col)).alias("_kv_norm"))
    norm = F.col("_kv_norm")
    some = F.lit(False)  # only texts with one of these words can hold anything
    for w in cover([p.split() for p in phrases] + [{t.words[i] for i in t.mandatory} for t in templates]):
        some = some | F.contains(norm, F.lit(w))
    step = step.select(
        id_col,
        F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.when(some, F.concat(F.lit(" "), norm, F.lit(" "))).alias("_kv_padded"),
        F.when(some, words_of(norm)).alias("_kv_words"),
    )
    holds = lambda x: F.contains("_kv_padded", F.lit(f" {x} "))
    base = F.array_compact(F.array(*(F.when(holds(p), F.lit(v)) for p, v in sorted(phrases.items(), key=lambda x: x[1]))))
    rarest = _array(sorted({t.words[r[0]] for t, r in zip(templates, rare)}), "array<string>")  # each template needs its own
    step = step.select(
        id_col,
        "n_words",
        "_kv_words",
        F.when(F.col("_kv_words").isNotNull(), F.array_distinct(base)).otherwise(F.array().cast("array<string>")).alias("_kv_base"),
        F.coalesce(F.arrays_overlap("_kv_words", rarest), F.lit(False)).alias("_kv_any"),
    )
    step = step.select(
        id_col,
        "n_words",
        F.when(F.size("_kv_base") > 0, let(F.col("_kv_words"), places)).otherwise(F.array().cast("array<int>")).alias("_kv_places"),
        F.when(F.col("_kv_any"), let(F.col("_kv_words"), found)).otherwise(F.array().cast(kind)).cast(kind).alias("_kv_found"),
        F.array_sort("_kv_base").alias("_kv_base"),
    )
    every = F.array_sort(F.array_union(F.col("_kv_base"), F.transform("_kv_found", lambda x: x["label"])))
    share = lambda x: x["n"] / x["of"]
    best = F.coalesce(F.array_max(F.transform("_kv_found", share)), F.lit(0.0))
    coverage = F.coalesce(F.array_max(F.transform("_kv_found", lambda x: F.struct(x["n"].alias("n"), share(x).alias("share"))))["share"], F.lit(0.0))
    return step.select(
        id_col,
        "n_words",
        F.size("_kv_places").cast("long").alias("n_base"),
        F.get("_kv_places", F.lit(0)).cast("long").alias("first_word"),
        F.get("_kv_places", F.size("_kv_places") - 1).cast("long").alias("last_word"),
        F.array_join("_kv_base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.when(F.size("_kv_places") > 0, 1.0).otherwise(0.0), best).alias("score"),
        coverage.alias("coverage"),
    )


def oracle(phrases: dict[str, str] = PHRASES, templates=TEMPLATES) -> str:
    """The same result in DuckDB SQL, by joining every word with every template word."""
    upper = "".join(map(chr, range(65, 91)))
    values = ", ".join(f"({k}, '{t.label}', {i}, '{w}', {i in t.mandatory})" for k, t in enumerate(templates) for i, w in enumerate(t.words))
    plain = ", ".join(f"({k}, '{v}', {i}, '{w}', {len(p.split())})" for k, (p, v) in enumerate(phrases.items()) for i, w in enumerate(p.split()))
    return rf"""
WITH tok AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tok),
tmpl(t, label, i, word, needed) AS (VALUES {values}),
size AS (SELECT t, count(*) AS n, count(*) FILTER (needed) AS m FROM tmpl GROUP BY t),
hit AS (SELECT doc_id, t, any_value(label) AS label, count(*) / any_value(size.n) AS score, count(*) AS held
        FROM word JOIN tmpl USING (word) JOIN size USING (t) GROUP BY doc_id, t, pos - i
        HAVING count(*) FILTER (needed) = any_value(size.m)),
plain(p, label, i, word, n) AS (VALUES {plain}),
place AS (SELECT doc_id, any_value(label) AS label, pos - i AS begins FROM word JOIN plain USING (word)
          GROUP BY doc_id, p, pos - i HAVING count(*) = any_value(n)),
base AS (SELECT doc_id, count(*) AS n_base, min(begins) AS first_word, max(begins) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY doc_id),
own AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score,
          arg_max(score, held + score / 2) FILTER (held > 0) AS coverage
        FROM (SELECT doc_id, label, score, held FROM hit UNION ALL SELECT doc_id, label, 1.0, 0 FROM place) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(coverage, 0) AS DOUBLE) AS coverage
FROM tok LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)"""
