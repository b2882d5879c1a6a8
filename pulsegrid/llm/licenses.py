"""Licence scans: Dice coefficient over word bigrams of normalised text units and licence templates.

Built from DataFrame expressions only, in one pass and without a shuffle: the
templates are a constant of this module (under 200 short texts), so they ride
along in the projection whatever the size of the input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A unit matches a template from this coefficient on.
LEAST = 0.8

#: Names that notices give to licences.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
#: Sentences that notices put them in.
FORMS = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}."]
#: Whole licence texts and standard headers.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_SEPARATORS = r"[^\p{L}\p{N}\n]+"


def templates() -> list[tuple[str, list[str]]]:
    """(licence, distinct word bigrams) of every template, in order."""
    texts = [(k, f.format(n)) for k, names in NAMES.items() for n in names for f in FORMS] + list(TEXTS.items())
    out = []
    for k, text in texts:
        words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
        out.append((k, list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))))
    return out


def _template_array():
    """The templates as one constant array of (licence, size, hashed bigrams)."""
    spark = SparkSession.active()
    rows = spark.createDataFrame(templates(), "k string, b array<string>")
    hashed = rows.select("k", F.transform("b", lambda x: F.xxhash64(F.split(x, " ")[0], F.split(x, " ")[1])).alias("h")).collect()
    return F.array(*[F.struct(F.lit(r["k"]).alias("k"), F.lit(len(r["h"])).alias("n"), F.lit(r["h"]).alias("h")) for r in hashed])


def _matches(unit):
    """Best (dice, licence) of a unit of words, null below LEAST; only templates within the size bounds are compared."""
    low, high = LEAST / (2 - LEAST), (2 - LEAST) / LEAST
    grams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(unit) - 2), lambda i: F.xxhash64(unit[i], unit[i + 1])))

    def against(g):
        near = F.filter(F.col("_templates"), lambda t: (t["n"] >= F.size(g) * low) & (t["n"] <= F.size(g) * high))
        dice = F.transform(
            near, lambda t: F.struct((-2.0 * F.size(F.array_intersect(g, t["h"])) / (F.size(g) + t["n"])).alias("d"), t["k"].alias("k"))
        )
        best = F.array_min(dice)
        return F.when(best["d"] <= -LEAST, F.struct((-best["d"]).alias("dice"), best["k"].alias("licence")))

    # a one-element transform binds the bigrams once
    return F.transform(F.array(grams), against)[0]


def license_scan(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with what licences it carries; input columns but text stay.

    Text is lower-cased, runs of anything but letters, digits and newlines
    become blanks.  Units are its lines, its paragraphs (what empty lines
    separate) of several lines, and the whole text if it has several
    paragraphs.  A unit matches the template of highest Dice coefficient over
    distinct word bigrams, if that is LEAST or more (ties: first licence name);
    templates whose size rules that out are not compared.  Units of fewer than
    two words, null and empty texts match nothing.
    Added: n_units (long, lines with a word), n_matches (long, matching units),
    licences (array of names, sorted), best_dice (double, null without a match).
    Ids are not looked at: null and repeated ones are rows like others.
    """
    least = min(len(b) for _, b in templates()) * LEAST / (2 - LEAST)
    clean = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), _SEPARATORS, " ")
    flat = lambda x: F.filter(F.split(F.translate(x, "\n", " "), " "), lambda w: w != "")
    rows = docs.withColumn("_clean", clean).withColumn("_lines", F.filter(F.split("_clean", "\n"), lambda x: F.trim(x) != ""))
    paragraphs = F.filter(F.split("_clean", r"\n *\n[ \n]*"), lambda x: F.trim(x) != "")
    rows = rows.withColumn("_paragraphs", F.when(F.instr("_clean", "\n") > 0, paragraphs).otherwise(F.array().cast("array<string>")))
    several = F.filter("_paragraphs", lambda x: F.instr(F.trim(F.btrim(x, F.lit(" \n"))), "\n") > 0)
    whole = F.when(F.size("_paragraphs") > 1, F.array("_clean")).otherwise(F.array().cast("array<string>"))
    units = F.concat(F.col("_lines"), several, whole)
    # a unit has at most its words less one distinct bigrams
    words = F.filter(F.transform(units, flat), lambda u: F.size(u) - 1 >= F.lit(least))
    rows = rows.withColumn("_units", words).withColumn("_templates", _template_array())
    rows = rows.withColumn("_found", F.filter(F.transform("_units", _matches), lambda x: x.isNotNull()))
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_units", "n_matches", "licences", "best_dice")]
    return rows.select(
        *keep,
        F.size("_lines").cast("long").alias("n_units"),
        F.size("_found").cast("long").alias("n_matches"),
        F.array_sort(F.array_distinct(F.transform("_found", lambda x: x["licence"]))).alias("licences"),
        F.array_max(F.transform("_found", lambda x: x["dice"])).alias("best_dice"),
    )


def oracle() -> str:
    values = ", ".join("('" + k + "', [" + ", ".join(f"'{x}'" for x in b) + "])" for k, b in templates())
    return rf"""
WITH t(k, b) AS (VALUES {values}),
c AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS s FROM documents),
l AS (SELECT doc_id, s, list_filter(string_split(s, chr(10)), lambda x: trim(x) <> '') AS lines,
        CASE WHEN contains(s, chr(10)) THEN list_filter(regexp_split_to_array(s, '\n *\n[ \n]*'), lambda x: trim(x, ' ' || chr(10)) <> '') ELSE [] END AS paras FROM c),
u AS (SELECT doc_id, len(lines) AS n_units, unnest(list_concat(list_concat(lines, list_filter(paras, lambda x: contains(trim(x, ' ' || chr(10)), chr(10)))), CASE WHEN len(paras) > 1 THEN [s] ELSE [] END)) AS x FROM l),
w AS (SELECT doc_id, row_number() OVER () AS u, list_filter(string_split(replace(x, chr(10), ' '), ' '), lambda y: y <> '') AS w FROM u),
g AS (SELECT doc_id, u, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2),
m AS (SELECT doc_id, u, k, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS d FROM g, t
      WHERE len(b) >= len(g) * {LEAST / (2 - LEAST)} AND len(b) <= len(g) * {(2 - LEAST) / LEAST}),
r AS (SELECT doc_id, u, k, CAST(d AS DOUBLE) AS d, row_number() OVER (PARTITION BY u ORDER BY d DESC, k) AS n FROM m WHERE d >= {LEAST}),
f AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT k, ' ' ORDER BY k) AS ks, max(d) AS d FROM r WHERE n = 1 GROUP BY doc_id)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_units, CAST(coalesce(f.n, 0) AS BIGINT) AS n_matches, coalesce(ks, '') AS licences, round(d, 6) AS best_dice
FROM l LEFT JOIN f USING (doc_id)
"""
