"""License scans by MinHash bands over overlapping text windows; DataFrame functions only.

Texts become arrays of 64-bit hashes of word 5-grams (words: A-Z lower-cased, runs of letters, digits and
everything beyond ASCII; fewer than five words are one gram).  For a template of ``span`` grams, ``m`` of
them distinct, the text is cut into windows of ``span + stride - 1`` grams every ``stride = max(1, span / 4)``,
so that every run of ``span`` grams lies in a window.  A window retrieves the template if one of BANDS
MinHash values (bands of one row) agrees.  A window that holds a share ``c`` of a template without repeated
grams has a Jaccard similarity of at least ``c m / (m + stride - 1 + (1 - c) m)``, 0.55 at the threshold of
0.8, and is retrieved with a probability of ``1 - 0.45^16`` = 0.999997 or more.  Then the exact share of the
template's distinct grams in the window decides.  The bands of templates, 16 short rows each, are broadcast
for retrieval, their grams once each for verification.

A band can only agree where the gram that is least in the template stands in the text; texts without any
such gram have no candidate, so only the others are cut into windows.

Edge cases: null and empty texts hold nothing; templates without words are left out; repeated rows give
repeated results; an empty table, or no template, gives an empty result; extra columns are ignored;
templates of more than ``MAX_GRAMS`` grams together are scanned in blocks.  Rows are told apart by their
place in the plan, so a table that cannot be read twice alike (one without a fixed order after a shuffle)
has to be written first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BANDS, CONTAINED = 5, 16, 0.8
#: Grams of the templates in one broadcast (8 bytes each, and 16 short rows a template).
MAX_GRAMS = 1_000_000
_NO_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_ENDING = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_CONDITIONS = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Notices, openings and whole texts of well-known licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-text": _BSD_OPENING,
    "MIT-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY,
    "BSD-2-Clause-whole": f"{_BSD_OPENING}: {_BSD_CONDITIONS} {_BSD_ENDING}",
    "BSD-3-Clause-whole": f"{_BSD_OPENING}: {_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_ENDING}",
    "ISC-whole": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-whole": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-whole": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def grams(w: Column) -> Column:
    """Hashes of the word 5-grams of an array of words, in order."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (GRAM - 1)))
    return F.when(F.size(w) > 0, F.transform(at, lambda i: F.xxhash64(F.slice(w, i, GRAM)))).otherwise(F.array().cast("array<bigint>"))


def _gram_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, _row, g).  The row number, which is not deterministic, keeps the words a column of their own:
    substituted into the lambda of ``grams`` they would be made again for every gram."""
    split = rows.select(key, words(F.col("text")).alias("w"), F.monotonically_increasing_id().alias("_row"))
    return split.select(key, "_row", grams(F.col("w")).alias("g"))


def _band(window: Column, k: int) -> Column:
    return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(k))))


def _prepared(spark: SparkSession, templates: dict[str, str]):
    """Per template (name, grams, distinct grams, the gram that is least in each band)."""
    table = spark.createDataFrame([(n, t) for n, t in templates.items()], "name string, text string")
    table = _gram_rows(table, "name").where(F.size("g") > 0).select("name", F.size("g").alias("span"), F.array_distinct("g").alias("g"))

    def by_hash(k: int) -> Column:
        return F.array_sort(F.transform("g", lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("h"), x.alias("x"))))

    least = F.array(*[F.element_at(by_hash(k), 1) for k in range(BANDS)])
    return table.select("name", "span", "g", least.alias("b")).collect()


def _in_blocks(templates: dict[str, str]) -> list[dict[str, str]]:
    """Blocks of about MAX_GRAMS grams (a text has fewer than half as many words as characters)."""
    blocks, held = [{}], 0
    for name in sorted(templates):
        size = len(templates[name]) // 2 + 1
        if blocks[-1] and held + size > MAX_GRAMS:
            blocks.append({})
            held = 0
        blocks[-1][name] = templates[name]
        held += size
    return blocks


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED, key: str = "doc_id") -> DataFrame:
    """(key, license, containment, n_windows, first_word): the templates that a text holds, with the
    largest share of a template's grams in one window, the number of such windows and the first one's
    first word (from 0)."""
    out = None
    for block in _in_blocks(templates):
        part = _scan_block(docs, block, contained, key)
        out = part if out is None else out.unionByName(part)
    return out


def _scan_block(docs: DataFrame, templates: dict[str, str], contained: float, key: str) -> DataFrame:
    spark = docs.sparkSession
    found = _prepared(spark, templates)
    signs = sorted({b.x for r in found for b in r.b})
    sizes = sorted({r.span for r in found})
    held = _gram_rows(docs, key).where(F.arrays_overlap("g", F.array(*[F.lit(s) for s in signs]).cast("array<bigint>")))
    shape = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.lit(max(1, n // 4)).alias("stride")) for n in sizes]).cast("array<struct<span:int,stride:int>>"))
    starts = held.select("_row", key, "g", shape.alias("s")).select("_row", key, "g", "s.span", "s.stride", F.explode(F.expr("sequence(0, size(g) - 1, s.stride)")).alias("start"))
    windows = starts.select("_row", key, "span", "start", F.expr("slice(g, start + 1, span + stride - 1)").alias("w"))
    windows = windows.where(F.arrays_overlap("w", F.array(*[F.lit(s) for s in signs]).cast("array<bigint>")))
    bands = windows.select("*", F.posexplode(F.array(*[_band(F.col("w"), k) for k in range(BANDS)])).alias("k", "h"))
    # MAX_GRAMS bounds both broadcasts
    table = spark.createDataFrame([(r.name, r.span, k, b.h) for r in found for k, b in enumerate(r.b)], "license string, span int, k int, h bigint")
    texts = spark.createDataFrame([(r.name, r.g) for r in found], "license string, tg array<bigint>")
    hits = bands.join(F.broadcast(table), ["span", "k", "h"]).join(F.broadcast(texts), "license")
    share = F.size(F.array_intersect("tg", "w")) / F.size("tg")
    true = hits.select("_row", key, "license", "start", share.alias("share")).where(F.col("share") >= contained)
    # all windows of a row come from one task; the hits of one window are equal
    best = true.groupBy("_row", "license").agg(F.first(key).alias(key), F.max("share").alias("containment"), F.count_distinct("start").alias("n_windows"), F.min("start").cast("long").alias("first_word"))
    return best.select(key, "license", "containment", "n_windows", "first_word")
