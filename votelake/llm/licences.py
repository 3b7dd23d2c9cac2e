"""License scans: MinHash bands over overlapping windows find templates, exact shingle containment decides.

Only DataFrame functions are used.  A template of ``m`` shingles is looked for
in windows of ``m`` shingles, one at every ``max(1, m // 5)``-th place.  A text
that holds the template has a window with a Jaccard similarity of at least
0.81, and one that holds 80 % of it in place one of at least 0.56; with BANDS
bands of ROWS values these share a band with a probability of 0.9999999 and
0.997.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, the share of a template's shingles that must be there, MinHash bands and values of a band.
WORDS, CONTAINED, BANDS, ROWS = 5, 0.8, 16, 2

#: Names of licences, the sentences that grant them, and the beginnings of well-known notices.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
SENTENCES = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "Distributed under the {}", "Made available under the {}"]
SPDX = "SPDX-License-Identifier: {}"
_BSD_0 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_GNU_0 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License"
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
NOTICES = {
    "GPL-2.0": _GNU_0.format(2),
    "GPL-3.0": _GNU_0.format(3),
    "BSD-3-Clause": _BSD_3,
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
}
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU_END = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. You should have received a copy of the {0} along with this program."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. " + _GNU_END
#: The short licences whole, and the notices that files under the long ones carry.
TEXTS = {
    "MIT": NOTICES["MIT"] + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": NOTICES["ISC"] + ", provided that the above copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": f"{_BSD_0}: 1. {_BSD_1} 2. {_BSD_2} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD_0}: 1. {_BSD_1} 2. {_BSD_2} 3. {_BSD_3} {_BSD_END}",
    "Zlib": NOTICES["Zlib"] + ". In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": NOTICES["Unlicense"] + ". Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "BSL-1.0": NOTICES["BSL-1.0"] + ' (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: '
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); ' + NOTICES["Apache-2.0"] + " http://www.apache.org/licenses/LICENSE-2.0 "
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0": NOTICES["MPL-2.0"] + ". If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-2.0": _GNU.format("GNU General Public License", "2"),
    "GPL-3.0": _GNU.format("GNU General Public License", "3"),
    "LGPL-2.1": _GNU.format("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": _GNU.format("GNU Lesser General Public License", "3"),
    "AGPL-3.0": _GNU.format("GNU Affero General Public License", "3"),
}


def default_templates() -> list[tuple[str, str]]:
    """(licence, text) of every sentence with every name, of SPDX lines, beginnings of notices, and whole texts."""
    made = [(k, s.format(n)) for k, names in NAMES.items() for n in names for s in SENTENCES]
    lines = [(k, SPDX.format(k)) for k in [*NAMES, "Zlib", "Unlicense"]]
    return made + lines + list(NOTICES.items()) + list(TEXTS.items())


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where a lambda inside reads it for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(own: Column, k: int = WORDS) -> Column:
    """Hashes of all runs of ``k`` words of an array, in order; none if it has fewer."""

    def runs(w: Column) -> Column:
        at = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(w, i, k), " ")))

    return _let(own, runs)


def _seeded(k: int):
    """The ``k``-th hash of an element; made here so that the lambda has one parameter, as a second one would be the element's position."""
    return lambda x: F.xxhash64(x, F.lit(k))


def minhash_values(grams: Column) -> Column:
    """An array of BANDS * ROWS arrays: the elements under each of the hash functions."""
    return F.array(*[F.transform(grams, _seeded(k)) for k in range(BANDS * ROWS)])


def bands(window) -> Column:
    """One hash per band, of its number and its MinHash values; ``window(k)`` are the window's elements under the ``k``-th hash function."""
    least = [F.array_min(window(k)) for k in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *least[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def _templates(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    given = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(templates)], "template_id int, license string, template string")
    sized = given.withColumn("w", words(F.col("template"))).withColumn("k", F.least(F.size("w"), F.lit(WORDS)))
    # fewer words are one shingle; m is then below 1, so that longer templates come first
    grams = F.when(F.col("k") < WORDS, F.array(F.xxhash64(F.array_join("w", " ")))).otherwise(F.array_distinct(shingles(F.col("w"))))
    made = sized.where("k > 0").withColumn("grams", grams).drop("w")
    return made.withColumn("m", F.size("grams") - (WORDS - F.col("k")))


def _short(some: DataFrame, short: DataFrame, k: int, keys: list[int]) -> DataFrame:
    """Places of ``some(doc_id, row, text)`` that hold a template of ``k`` words, fewer than WORDS."""
    wanted = F.lit(keys)
    at = _let(shingles(words(F.col("text")), k), lambda h: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(wanted, x), F.struct(i.alias("i"), x.alias("gram")))), lambda s: s.isNotNull()))
    hits = some.select("doc_id", "row", F.explode(at).alias("hit")).select("doc_id", "row", F.col("hit.i").alias("first_word"), F.col("hit.gram").alias("gram"))
    met = hits.join(F.broadcast(short.where(F.col("k") == k).select("template_id", "license", "m", F.col("grams")[0].alias("gram"))), "gram")
    return met.select("doc_id", "row", "license", "m", F.lit(1.0).alias("containment"), "first_word", (F.col("first_word") + (k - 1)).alias("last_word"))


def _anchors(templates: list[tuple[str, str]]) -> list[str]:
    """Beginnings of long words of which any text that holds CONTAINED of a template must have one.

    They lie in more than ``1 - CONTAINED`` of every template's shingles, so
    not all of these can be missing.
    """
    wanted = []
    for _, text in templates:
        own = re.findall(r"[^\W_]+", text.lower())
        grams = {tuple(own[i : i + WORDS]) for i in range(len(own) - WORDS + 1)} or ({tuple(own)} if own else set())
        if grams:
            wanted.append([{w[:6] for w in g} for g in grams])
    chosen: list[str] = []
    while True:
        open_ = [t for t in wanted if sum(any(c in g for c in chosen) for g in t) <= (1 - CONTAINED) * len(t)]
        if not open_:
            return chosen
        count: dict[str, int] = {}
        for t in open_:
            for w in set().union(*t):
                count[w] = count.get(w, 0) + sum(w in g for g in t)
        chosen.append(max((w for w in count if w not in chosen), key=lambda w: (len(w), count[w], w)))


def _long(some: DataFrame, known: DataFrame, sizes: list[int], keys: list[int]) -> DataFrame:
    """Places of ``some(doc_id, row, text)`` that hold a template of WORDS words or more; ``sizes`` are theirs in shingles, ``keys`` their shingles."""
    grams = F.lit(keys)
    some = some.select("doc_id", "row", shingles(words(F.col("text"))).alias("h")).where(F.arrays_overlap("h", grams))
    hits = _let(F.array_intersect("h", grams), lambda own: F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(own, x), i)), lambda i: i.isNotNull()))
    some = some.select("doc_id", "row", "h", hits.alias("hits"), minhash_values(F.col("h")).alias("values"))

    def starts(m: int) -> Column:  # windows of the grid of size m with a shingle of a template
        step = max(1, m // 5)
        grid = F.transform("hits", lambda p: F.sequence(F.greatest(F.floor((p - (m - 1) + step - 1) / step), F.lit(0)).cast("int"), F.floor(p / step).cast("int")))
        return F.transform(F.array_distinct(F.flatten(grid)), lambda g: F.struct(F.lit(m).alias("m"), (g * step).alias("start")))

    def keyed(w: Column) -> Column:  # a window carries its own surroundings, not the whole text
        low = F.greatest(w["start"] - w["m"] / 2, F.lit(0)).cast("int")
        around = F.slice(F.col("h"), low + 1, w["m"] * 2)
        return F.struct(w["m"].alias("m"), low.alias("low"), around.alias("wide"), bands(lambda k: F.slice(F.col("values")[k], w["start"] + 1, w["m"])).alias("bands"))

    windows = F.transform(F.flatten(F.array(*[starts(m) for m in sizes])), keyed)
    windows = some.select("doc_id", "row", F.explode(windows).alias("w")).select("doc_id", "row", "w.m", "w.low", "w.wide", "w.bands")
    index = known.select("template_id", "license", "m", "grams", bands(lambda k: F.transform("grams", _seeded(k))).alias("own")).withColumn("band", F.explode("own"))
    met = windows.withColumn("band", F.explode("bands")).join(F.broadcast(index), ["m", "band"])
    # a window and a template may share several bands: only the first one counts
    met = met.where(F.element_at(F.filter(F.zip_with("bands", "own", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), 1) == F.col("band"))
    at = F.filter(F.transform("wide", lambda x, i: F.when(F.array_contains(F.col("grams"), x), F.col("low") + i)), lambda i: i.isNotNull())
    share = F.size(F.array_intersect("grams", "wide")) / F.col("m")
    met = met.withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    return met.select("doc_id", "row", "license", "m", "containment", F.array_min(at).alias("first_word"), (F.array_max(at) + (WORDS - 1)).alias("last_word"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, license, first_word, last_word, containment)``: every place of a document that holds a licence's template.

    A template is there if a window with a common band, widened by half a
    window at both sides, has CONTAINED of its distinct shingles of WORDS words;
    a template of fewer words, where all its words stand in a row.
    Of matches of one text that overlap in words, those that cover fewer
    shingles of their template, or as many with a smaller containment, give
    way, so a whole licence with another holder's name stands against its first
    sentence; the matches of a text are gathered in one row for that.  Null texts are empty; a template
    without words matches nothing; rows with the same id, or none, and the same
    text give their matches once, those with other texts each their own; other
    columns are not read; an empty table gives no match.  The templates are
    fixed and few, and broadcast.
    """
    spark = docs.sparkSession
    templates = default_templates() if templates is None else templates
    known = _templates(spark, templates)
    rows = known.select("k", "m", "grams").collect()
    empty = "doc_id long, license string, first_word int, last_word int, containment double"
    if not rows:
        return spark.createDataFrame([], empty)
    text = F.col(text_col).cast("string")
    low = F.lower(text)
    near = F.lit(False)
    for a in _anchors(templates):
        near = near | low.contains(a)
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where(near).select("doc_id", F.md5(F.col("text").cast("binary")).alias("row"), "text")
    parts = [_short(some, known, k, sorted({r["grams"][0] for r in rows if r["k"] == k})) for k in sorted({r["k"] for r in rows} - {WORDS})]
    if any(r["k"] == WORDS for r in rows):
        long = [r for r in rows if r["k"] == WORDS]
        parts.append(_long(some, known.where(F.col("k") == WORDS), sorted({r["m"] for r in long}), sorted({g for r in long for g in r["grams"]})))
    found = reduce(DataFrame.unionByName, parts)
    # by text: at a place, a licence's best match; then those that no better one overlaps
    best = found.groupBy("doc_id", "row", "license", "first_word", "last_word").agg(F.max(F.struct(F.round(F.col("m") * F.col("containment")).alias("covered"), "containment")).alias("best"))
    own = best.groupBy("doc_id", "row").agg(F.collect_list(F.struct("best.covered", "best.containment", "license", "first_word", "last_word")).alias("all"))
    rank = lambda x: F.struct(x["covered"], x["containment"], x["license"])
    beats = lambda b, a: (a["first_word"] <= b["last_word"]) & (b["first_word"] <= a["last_word"]) & (rank(b) > rank(a))
    left = F.filter("all", lambda a: ~F.exists("all", lambda b: beats(b, a)))
    return own.select("doc_id", F.explode(left).alias("x")).select("doc_id", "x.license", "x.first_word", "x.last_word", "x.containment")
