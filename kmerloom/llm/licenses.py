"""Licence scans by Dice coefficient over word bigrams (operator 6, native).

A text is normalised to words of a-z and 0-9 and cut into units: its lines, its
sentences, the whole, and for each template windows of its length: a few of its bigrams, the
rarest of each of its parts, are anchors, and where one stands in the text a window is laid so that the
anchor falls on its place in the template. A unit's set of word bigrams is compared
with a template's by 2 * common / (sum of sizes). A coefficient of ``least`` bounds the
ratio of sizes, so a unit meets only templates whose size lies in its bounds: the table
of template bigrams is broadcast, it has the size of this file's texts, and only the
bigrams that units share with templates are grouped. Units without any of a few words, one of
which every unit that can reach ``least`` must have, are left out at once.

Defined cases: a null or empty text has no licence; equal ``doc_id`` give one row with the
findings of all, equal rows those of one; a null ``doc_id`` is a document of its own; equal units of one text count
once; ties go to the first name; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import ascii_lower

# Texts of public licences and their usual notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
General Public License along with this program."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a
product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered
from any source distribution."""
#: (name, text): full texts and notices of a line.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Released under the Apache License 2.0"),
    ("BSD-2-Clause", f"{BSD_START} {BSD_END}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", f"{BSD_START} {BSD_NAMES} {BSD_END}"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", GPL.format(v=2)),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", GPL.format(v=3)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("ISC", ISC),
    ("ISC", "Released under the ISC License"),
    ("MIT", MIT),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", MPL),
    ("Unlicense", UNLICENSE),
    ("Zlib", ZLIB),
]
#: Most anchors of a template, and the coefficient whose least number of shared bigrams they are chosen for.
ANCHORS, ANCHORED = 8, 0.8


def normal_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(templates: list[tuple[str, str]]) -> list[tuple[str, int, int, str]]:
    """(license, template, bigrams of the template, bigram)."""
    rows = []
    for k, (name, text) in enumerate(templates):
        w = normal_words(text)
        pairs = sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})
        rows += [(name, k, len(pairs), p) for p in pairs]
    return rows


def key_words(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which any unit that reaches ``least`` with some template has one.

    Such a unit shares at least ``need`` bigrams of the template's t, so it has one of
    any t - need + 1 of them: words are picked, those that cover most first and long
    ones before short ones, until so many bigrams of each template hold a picked word.
    """
    open_ = []
    for k in range(len(templates)):
        pairs = {tuple(p.split()) for *_, p in template_bigrams(templates[k : k + 1])}
        open_.append([pairs, len(pairs) - math.ceil(len(pairs) * least / (2 - least) - 1e-9) + 1])
    picked: list[str] = []
    while any(n > 0 for _, n in open_):
        gain: dict[str, int] = {}
        for pairs, n in open_:
            for w in {w for p in pairs for w in p} if n > 0 else ():
                gain[w] = gain.get(w, 0) + min(n, sum(w in p for p in pairs))
        word = max(gain, key=lambda w: (len(w) >= 6, gain[w], len(w), w))
        picked.append(word)
        for t in open_:
            hit = {p for p in t[0] if word in p}
            t[0] -= hit
            t[1] -= len(hit)
    return sorted(picked)


def _squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def anchors(templates: list[tuple[str, str]]) -> dict[str, list[tuple[int, int]]]:
    """Of each anchor the windows it stands for: (words before it, words of the window).

    A template of t bigrams is cut into as many parts as it may lack bigrams and still be found, and one
    more, but ANCHORS at most; of each part the bigram that fewest templates have, and of these the longest, is an anchor.
    """
    texts = sorted({tuple(normal_words(text)) for _, text in templates if len(normal_words(text)) > 1})
    spread: dict[str, int] = {}
    for w in texts:
        for pair in {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}:
            spread[pair] = spread.get(pair, 0) + 1
    out: dict[str, list[tuple[int, int]]] = {}
    for w in texts:
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        parts = min(ANCHORS, len(pairs) - math.ceil(ANCHORED * len(pairs)) + 1)
        for k in range(parts):
            places = range(len(pairs) * k // parts, len(pairs) * (k + 1) // parts)
            best = min(places, key=lambda i: (spread[pairs[i]], -len(pairs[i]), i))
            out.setdefault(pairs[best], []).append((best, len(w)))
    return {pair: sorted(set(windows)) for pair, windows in sorted(out.items())}


def _windows(templates: list[tuple[str, str]]) -> Column:
    """The windows laid at the anchors in the column ``words``."""
    known = anchors(templates)
    if not known:
        return F.array().cast("array<string>")
    words, size = F.col("words"), F.size("words")
    pair = lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i))
    laid = F.create_map(*[x for p, ws in known.items() for x in (F.lit(p), F.array(*[F.struct(F.lit(b).alias("before"), F.lit(n).alias("n")) for b, n in ws]))])

    def one(i: Column) -> Column:
        return F.transform(F.element_at(laid, pair(i)), lambda o: F.array_join(F.slice(words, F.greatest(i - o["before"], F.lit(1)), o["n"] + F.least(i - o["before"] - 1, F.lit(0))), " "))

    places = F.filter(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.coalesce(pair(i).isin(list(known)), F.lit(False)))
    return F.flatten(F.transform(places, one))


def _units(templates: list[tuple[str, str]]) -> Column:
    """The normalised units of the columns ``low`` and ``words``, each once."""
    low = F.col("low")
    parts = [F.split(low, "\n", -1), F.split(low, r"[.!?]+(?:[ \n]|$)", -1), F.array(low), _windows(templates)]
    return F.array_distinct(F.transform(F.concat(*parts), _squeeze))


def scan(docs: DataFrame, least: float = 0.8, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per ``doc_id``: licenses (names found, sorted and joined by commas), best_dice and n_units.

    ``least`` is the smallest coefficient of a finding, over 0 and at most 1; n_units counts
    pairs of unit and template that reach it.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    table = template_bigrams(templates)
    sizes = [n for *_, n, _ in table]
    lo, hi = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
    known = spark.createDataFrame(table, "license string, template int, t_size int, bigram string")
    words = key_words(templates, least)
    has_key = lambda c: reduce(or_, [F.contains(c, F.lit(w)) for w in words])
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_fp"), ascii_lower(F.coalesce("text", F.lit(""))).alias("low"))
    units = (
        rows.filter(F.exists(F.array("low"), has_key))  # an array of one: a filter that names ``low`` for each word would lower-case the text for each
        .withColumn("words", F.split(_squeeze(F.col("low")), " ", -1))
        .select("doc_id", "row_fp", F.posexplode(_units(templates)).alias("unit", "body"))
        .filter(has_key(F.col("body")))
        .withColumn("w", F.split("body", " ", -1))
        .filter(F.size("w") - 1 >= max(1, math.ceil(lo - 1e-9)))
        .withColumn("bigrams", F.array_distinct(F.zip_with(
            F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))))
        .select("doc_id", "row_fp", "unit", F.size("bigrams").alias("u_size"), "bigrams")
        .filter((F.col("u_size") >= lo - 1e-9) & (F.col("u_size") <= hi + 1e-9))
    )
    ratio = (2 - least) / least
    met = (
        units.select("doc_id", "row_fp", "unit", "u_size", F.explode("bigrams").alias("bigram"))
        .join(F.broadcast(known), "bigram")
        .filter((F.col("u_size") <= F.col("t_size") * ratio + 1e-9) & (F.col("t_size") <= F.col("u_size") * ratio + 1e-9))
        .groupBy("doc_id", "row_fp", "unit", "u_size", "template", "t_size", "license")
        .agg(F.size(F.collect_set("bigram")).alias("common"))  # a set of a template's size at most; equal rows add nothing
        .withColumn("dice", 2.0 * F.col("common") / (F.col("u_size") + F.col("t_size")))
        .filter(F.col("dice") >= least)
        .select("doc_id", "license", "dice")
    )
    everyone = docs.select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("dice"))
    return (
        met.unionByName(everyone)
        .groupBy("doc_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
            F.round(F.max("dice"), 6).alias("best_dice"),
            F.count("license").alias("n_units"),
        )
    )


def scan_sql(least: float = 0.8) -> str:
    """The same over ``documents`` in DuckDB's SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quoted(a)}, {k}, {n}, {quoted(b)})" for a, k, n, b in template_bigrams(TEMPLATES))
    laid = ", ".join(f"{quoted(p)}: [" + ", ".join(f"[{x}, {n}]" for x, n in ws) + "]" for p, ws in anchors(TEMPLATES).items())
    ratio = (2 - least) / least
    return f"""
WITH known(license, template, t_size, bigram) AS (VALUES {values}),
low AS (
  SELECT row_number() OVER () AS r, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT DISTINCT doc_id, text FROM documents)
), flat AS (SELECT r, doc_id, low, string_split(trim(regexp_replace(low, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM low),
laid AS (SELECT key AS pair, w[1] AS before, w[2] AS n FROM (SELECT key, unnest(value) AS w FROM (SELECT unnest(map_keys(m)) AS key, unnest(map_values(m)) AS value FROM (SELECT MAP {{{laid}}} AS m)))),
places AS (SELECT r, doc_id, i, w[i] || ' ' || w[i + 1] AS pair FROM (SELECT r, doc_id, w, unnest(range(1, len(w))) AS i FROM flat)),
windows AS (
  SELECT f.r, f.doc_id, array_to_string(f.w[greatest(i - before, 1):i - before + n - 1], ' ') AS u
  FROM places p JOIN laid USING (pair) JOIN flat f ON p.r = f.r
), units AS (
  SELECT DISTINCT r, doc_id, trim(regexp_replace(u, '[^a-z0-9]+', ' ', 'g')) AS body
  FROM (SELECT r, doc_id, unnest(string_split(low, chr(10)) || string_split_regex(low, '[.!?]+(?:[ \\n]|$)') || [low]) AS u FROM flat UNION ALL SELECT r, doc_id, u FROM windows)
), pairs AS (
  SELECT r, doc_id, body, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigrams
  FROM (SELECT r, doc_id, body, string_split(body, ' ') AS w FROM units) WHERE len(w) >= 2
), each AS (SELECT r, doc_id, body, len(bigrams) AS u_size, unnest(bigrams) AS bigram FROM pairs),
met AS (
  SELECT doc_id, license, 2.0::DOUBLE * count(*) / (u_size + t_size) AS dice
  FROM each JOIN known USING (bigram)
  WHERE u_size <= t_size * {ratio}::DOUBLE + 1e-9 AND t_size <= u_size * {ratio}::DOUBLE + 1e-9
  GROUP BY r, doc_id, body, u_size, template, t_size, license
  HAVING 2.0::DOUBLE * count(*) / (u_size + t_size) >= {least}
)
SELECT doc_id, coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
       round(max(dice), 6) AS best_dice, count(license) AS n_units
FROM (SELECT doc_id, license, dice FROM met UNION ALL SELECT doc_id, NULL, NULL FROM documents)
GROUP BY doc_id
"""
