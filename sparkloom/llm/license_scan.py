"""Licence scan, in DataFrame functions only.

Text is normalised (lower case, runs of anything but letters and digits become one blank) and compared with licence
templates by the Dice coefficient over sets of word bigrams, 2 |A and B| / (|A| + |B|). Compared are units: every line,
every paragraph of several lines, every text of several paragraphs, and for each template the best window of as many
words as the template has (so a notice is found inside a line, in a comment of many lines, and with code behind it).
A template is a candidate only where the sizes allow the threshold t: t / (2 - t) <= |A| / |B| <= (2 - t) / t.

Whatever reaches t shares at least t / (2 - t) of the template's bigrams. Hence two prunings that lose nothing. A match
holds one of any set of bigrams that leaves fewer than that; such sets, chosen to lie on few rare words, give words of
which one must be in the text. And a window matches only where that many of its places hold bigrams of the template."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
EVERYDAY = {"a", "all", "and", "any", "are", "at", "be", "by", "can", "file", "for", "from", "if", "in", "is", "it", "not", "of", "or", "other", "that", "the", "this", "to", "under", "use", "was", "with", "without", "work", "you"}

#: Licence notices as their licensors publish them (fixed values).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def normalise(text: str) -> str:
    return re.sub(r"[\W_]+", " ", text.lower()).strip()


def bigrams(text: str) -> list[str]:
    words = normalise(text).split(" ")
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchor_words(templates, threshold: float) -> list[str]:
    """Words such that whatever matches a template holds one of them: greedily, the word in most bigrams still needed."""
    needs = []
    for _, text in templates:
        own = bigrams(text)
        shared = math.ceil(threshold / (2 - threshold) * len(own) - 1e-9)
        needs.append([set(own), len(own) - shared + 1])  # so many bigrams must hold an anchor word
    # Short and everyday words let too many texts through, so they cost more.
    cost = lambda w: 200 if w in EVERYDAY or w.isdigit() else {1: 100, 2: 40, 3: 30, 4: 8, 5: 4}.get(len(w), 1)
    chosen: list[str] = []
    while any(need > 0 for _, need in needs):
        gain: dict[str, float] = {}
        for left, need in needs:
            if need > 0:
                for w in {w for b in left for w in b.split(" ")}:
                    gain[w] = gain.get(w, 0) + min(1, sum(w in b.split(" ") for b in left) / need)
        best = max(sorted(gain), key=lambda w: gain[w] / cost(w))
        chosen.append(best)
        for entry in needs:
            taken = {b for b in entry[0] if best in b.split(" ")}
            entry[0] -= taken
            entry[1] -= len(taken)
    return chosen


def _normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words occurs; short ones must stand alone."""
    out = F.lit(False)
    for w in words:
        if len(w) > 3:
            out = out | text.contains(w)
    short = [w for w in words if len(w) <= 3]
    return out | text.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(short) + r")(?![\p{L}\p{N}])") if short else out


def _let(name: str, value: Column) -> Column:
    """A column computed once: a generator of one row, which the optimiser neither repeats nor moves."""
    return F.explode_outer(F.array(value)).alias(name)


def _best_windows(literal: Column, share: float) -> Column:
    """For each template its best window, ``license, unit, dice``, from words ``w``, bigrams ``g`` and the places ``hits``
    of bigrams that some template has. A window begins with a bigram of its template; of equal ones the first counts."""

    def best(t: Column) -> Column:
        at = F.filter(F.col("hits"), lambda i: F.array_contains(t["grams"], F.element_at("g", i)))
        need = F.ceil(t["size"] * F.lit(share) - 1e-9).cast("int")
        return F.struct(t["license"].alias("license"), t["grams"].alias("grams"), t["size"].alias("size"), t["words"].alias("words"), need.alias("need"), at.alias("at"))

    def starts(x: Column) -> Column:
        enough = F.filter(F.sequence(F.lit(1), F.size(x["at"]) - x["need"] + 1), lambda j: F.element_at(x["at"], j + x["need"] - 1) - F.element_at(x["at"], j) <= x["words"] - 2)
        return F.transform(enough, lambda j: F.element_at(x["at"], j))

    def dice(x: Column, p: Column) -> Column:
        return F.transform(F.array(F.array_distinct(F.slice("g", p, x["words"] - 1))), lambda own: F.lit(2.0) * F.size(F.array_intersect(own, x["grams"])) / (F.size(own) + x["size"]))[0]

    def window(x: Column) -> Column:
        top = F.array_max(F.transform(starts(x), lambda p: F.struct(dice(x, p).alias("dice"), (-p).alias("p"))))
        return F.transform(F.array(top), lambda m: F.struct(x["license"].alias("license"), F.array_join(F.slice("w", -m["p"], x["words"]), " ").alias("raw"), m["dice"].alias("dice")))[0]

    found = F.filter(F.transform(literal, best), lambda x: F.size(x["at"]) >= x["need"])
    return F.filter(F.transform(F.filter(found, lambda x: F.size(starts(x)) > 0), window), lambda m: m["dice"].isNotNull())


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, license, dice, n_units, first_unit`` for each document and licence that some unit of it matches.

    dice is the best unit's, n_units counts matching units of different texts and first_unit is the normalised text of
    the first of these in order of text. A unit matching several templates of a licence counts once; notices that differ in a word or a version
    match each other's templates as well, and dice says which is nearest. Null, empty and
    wordless texts match nothing; units of one word have no bigrams. Rows of equal id and text add up only as one; other
    columns are not read.
    """
    words = anchor_words(templates, threshold)
    known = [(name, bigrams(text), len(normalise(text).split(" "))) for name, text in templates]
    # Constants, which the optimiser folds; as expression trees of words they would plan for seconds.
    literal = F.from_json(F.lit(json.dumps([{"license": n, "size": len(g), "words": w, "grams": g} for n, g, w in known])), "array<struct<license:string,size:int,words:int,grams:array<string>>>")
    every = sorted({x for _, g, _ in known for x in g})  # looked up as a hash set
    smallest, largest = min(len(g) for _, g, _ in known), max(len(g) for _, g, _ in known)
    size, share = F.size("grams"), threshold / (2 - threshold)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(_any_of(F.lower("text"), words))
    rows = rows.select("id", "text", _let("w", F.split(_normalised(F.col("text")), " ")))
    rows = rows.select("id", "text", "w", _let("g", F.transform(F.slice("w", 2, F.size("w")), lambda x, i: F.concat(F.element_at("w", i + 1), F.lit(" "), x))))
    rows = rows.select("id", "text", "w", "g", _let("hits", F.filter(F.transform("g", lambda x, i: F.when(x.isin(every), i + 1)), lambda i: i.isNotNull())))
    lines = F.split("text", r"\n")
    paragraphs = F.filter(F.split("text", r"\n[ \t\r]*\n\s*"), lambda p: F.rtrim(p).contains("\n"))
    whole = F.when(F.col("text").rlike(r"\n[ \t\r]*\n"), F.array("text")).otherwise(F.array().cast("array<string>"))
    natural = F.transform(F.array_distinct(F.concat(lines, paragraphs, whole)), lambda u: F.struct(F.lit(None).cast("string").alias("license"), u.alias("raw"), F.lit(None).cast("double").alias("dice")))
    # explode_outer: for an inner one Spark would compute the array once more to filter by its size.
    units = rows.select("id", F.explode_outer(F.concat(natural, _best_windows(literal, share))).alias("u")).select("id", "u.*")
    units = units.where((F.col("dice") >= threshold) | F.col("license").isNull() & _any_of(F.lower("raw"), words))
    plain = F.col("license").isNull()
    units = units.select("id", "license", "dice", F.when(plain, _normalised(F.col("raw"))).otherwise(F.col("raw")).alias("unit"))
    # Overlapping pairs of words by look-ahead. distinct() also ends the projection, so nothing below repeats this work.
    sized = units.select("*", F.when(plain, F.array_distinct(F.regexp_extract_all("unit", F.lit(r"(?:^| )(?=(\S+ \S+))"), F.lit(1)))).alias("grams")).distinct()
    sized = sized.where(~plain | (size >= smallest * share - 1e-9) & (size * share <= largest + 1e-9))
    fits = F.filter(literal, lambda t: (size >= t["size"] * share - 1e-9) & (size * share <= t["size"] + 1e-9))
    scored = F.transform(fits, lambda t: F.struct(t["license"].alias("license"), (F.lit(2.0) * F.size(F.array_intersect("grams", t["grams"])) / (size + t["size"])).alias("dice")))
    scored = F.when(plain, F.filter(scored, lambda s: s["dice"] >= threshold)).otherwise(F.array(F.struct("license", "dice")))
    hits = sized.select("id", "unit", F.explode_outer(scored).alias("s")).where("s is not null")
    best = hits.groupBy("id", F.col("s.license").alias("license"), "unit").agg(F.max("s.dice").alias("dice"))
    out = best.groupBy("id", "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_units"), F.min("unit").alias("first_unit"))
    return out.withColumnRenamed("id", id_col)


def scan_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, without any pruning."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(n)}, {len(normalise(t).split(' '))}, [{', '.join(map(quoted, bigrams(t)))}])" for i, (n, t) in enumerate(templates))
    return f"""
WITH t(t, license, words, grams) AS (VALUES {values}),
docs AS (SELECT row_number() OVER () AS k, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
paragraphs AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*')) AS unit FROM docs),
units AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM docs
  UNION ALL SELECT doc_id, unit FROM paragraphs WHERE contains(rtrim(unit), chr(10))
  UNION ALL SELECT doc_id, text FROM docs WHERE regexp_matches(text, '\\n[ \\t\\r]*\\n')),
plain AS (SELECT DISTINCT doc_id, trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS unit FROM units),
natural_ AS (SELECT doc_id, unit, string_split(unit, ' ') AS w FROM plain WHERE contains(unit, ' ')),
sets AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM natural_),
scored AS (SELECT doc_id, unit, license, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM sets, t),
worded AS (SELECT k, doc_id, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM docs),
places AS (SELECT k, unnest(range(1, len(w))) AS p FROM worded),
grams_ AS (SELECT k, p, w[p] || ' ' || w[p + 1] AS gram FROM places JOIN worded USING (k)),
starts AS (SELECT k, p, t FROM grams_ JOIN (SELECT t, unnest(grams) AS gram FROM t) USING (gram)),
windows AS (SELECT k, doc_id, p, t, license, grams, w[p:p + words - 1] AS w FROM starts JOIN t USING (t) JOIN worded USING (k)),
wsets AS (SELECT k, doc_id, p, t, license, grams, array_to_string(w, ' ') AS unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM windows),
wscored AS (SELECT k, doc_id, p, t, license, unit, 2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM wsets),
best AS (SELECT doc_id, unit, license, dice FROM wscored QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY dice DESC, p) = 1),
matches AS (SELECT doc_id, unit, license, max(dice)::DOUBLE AS dice FROM (SELECT * FROM scored UNION ALL SELECT * FROM best) WHERE dice >= {threshold} GROUP BY ALL)
SELECT doc_id, license, max(dice) AS dice, count(*) AS n_units, min(unit) AS first_unit FROM matches GROUP BY doc_id, license"""
