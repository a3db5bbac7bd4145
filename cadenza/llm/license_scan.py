"""License scans: MinHash bands over overlapping text windows, verified by exact shingle containment.

All of it is DataFrame functions. A template of L words is looked for in windows of L + L // 4
words that begin every L // 4 + 1 words, so an occurrence of L words lies whole in some window. A
signature has one minimum for each of BANDS seeds; a window retrieves a template where at least
one band, a minimum of its own, is equal. A window that holds 0.8 of a template's
shingles shares at least 0.8 / (1 + 1.25 + 1 / L - 0.8), about 0.5, of all their shingles with it (the
smallest template has windows of two shingles, and shares 0.5), so all 24 bands differ with
probability 0.5 ** 24, less than one in ten million. Containment, the part of the template's shingles that the window
holds, is then computed exactly on the words and must be 0.8 or more.

Retrieval looks the templates' band minima up, not windows one by one: only a window that holds the
shingle which is a template's minimum in some band can have the same minimum there. So texts are
cut into blocks of BLOCK words (and as many more as a window that begins in it may need), a block is
searched for those shingles by hash, and the windows around them get their signature. A block is as
long whatever its text is, so the work on a text grows with its length. Texts without any of the
words that cover the minima's shingles are left out first.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; shingles have
five words. Null texts, and texts of fewer than five words, hold no license. Rows that repeat a
doc_id count as one document: their windows at a place count once, by the highest containment. Without templates or documents there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 5
BANDS = 24
BLOCK = 256

#: Notices and texts of public licenses (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def shingles_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)))


def geometry(n_words: int) -> tuple[int, int]:
    """(shingles of a window, words from one window to the next)."""
    return n_words + n_words // 4 - SHINGLE + 1, n_words // 4 + 1


def covering_words(shingles: Iterable[str], shortest: int = 5) -> tuple[list[str], list[str]]:
    """Few long words such that every shingle has one of them, and the shingles without a long word."""
    words = {s: {w for w in s.split() if len(w) >= shortest} for s in shingles}
    left = {s: ws for s, ws in words.items() if ws}
    out: list[str] = []
    while left:
        counts: dict[str, int] = {}
        for ws in left.values():
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
        # A short word is in many texts and sorts out little.
        word = max(counts, key=lambda w: (min(len(w), 6), counts[w], w))
        out.append(word)
        left = {s: ws for s, ws in left.items() if word not in ws}
    return out, sorted(s for s, ws in words.items() if not ws)


def bound(value: Column, then) -> Column:
    """then(value), with value computed once however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hashed(words: Column) -> Column:
    """The hash of each shingle, in the order of the text."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (SHINGLE - 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, SHINGLE))))


def in_bands(then) -> Column:
    """then(k) of each band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), then)


def template_rows(templates: dict[str, str]) -> list[tuple[str, list[str], int, int]]:
    return [(k, shingles_of(t), *geometry(len(words_of(t)))) for k, t in sorted(templates.items()) if shingles_of(t)]


def template_index(spark: SparkSession, rows: list[tuple[str, list[str], int, int]]) -> list:
    """license_id, shingles, span, step, and for each band the least hash (`minima`) and the number of its shingle (`lowest`)."""
    frame = spark.createDataFrame(rows, "license_id string, shingles array<string>, span int, step int")
    least = in_bands(lambda k: F.array_min(F.transform("shingles", lambda s, i: F.struct(F.xxhash64(F.xxhash64(s), k).alias("m"), i.alias("i")))))
    frame = frame.withColumn("least", least)
    return frame.select("license_id", "shingles", "span", "step", F.col("least.m").alias("minima"), F.col("least.i").alias("lowest")).collect()  # a row for each template


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """Per document and template found: windows that hold it, the highest containment, and the first word of the first window with it."""
    rows = template_rows(TEMPLATES if templates is None else templates)
    schema = "doc_id long, license_id string, n_windows long, containment double, first_word long"
    if not rows:
        return docs.sparkSession.createDataFrame([], schema)
    index = template_index(docs.sparkSession, rows)
    keys = {r.license_id: list(dict.fromkeys(r.shingles[i] for i in r.lowest)) for r in index}
    longest = max(r.span for r in index)
    strings = lambda xs: F.array(*map(F.lit, xs))
    hashes = lambda xs: F.transform(strings(xs), lambda s: F.xxhash64(s))
    known = F.array(
        *(
            F.struct(F.lit(r.license_id).alias("license_id"), strings(r.shingles).alias("shingles"), hashes(keys[r.license_id]).alias("keys"), strings(r.minima).alias("minima"), F.lit(r.span).alias("span"), F.lit(r.step).alias("step"))
            for r in index
        )
    )
    long_words, short = covering_words({s for ss in keys.values() for s in ss})
    tests = [lambda low, w=w: low.contains(w) for w in long_words]
    tests += [lambda low, p=r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(s.split()): low.rlike(p) for s in short]
    may = F.exists(F.array(F.lower(F.col(text_col).cast("string"))), lambda low: reduce(or_, (t(low) for t in tests)))
    words = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(WORD), F.lit(0))

    def block(w: Column, b: Column) -> Column:
        own = F.slice(w, b * BLOCK + 1, BLOCK + longest + SHINGLE - 1)
        return bound(own, lambda own: F.struct((b * BLOCK).alias("at"), own.alias("w"), hashed(own).alias("h")))

    blocks = bound(words, lambda w: F.when(F.size(w) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - SHINGLE) / BLOCK).cast("int")), lambda b: block(w, b))))
    texts = docs.filter(may).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(blocks).alias("x")).select("doc_id", "x.*")
    near = texts.filter(F.arrays_overlap("h", hashes(sorted({s for ss in keys.values() for s in ss}))))
    each = near.select("doc_id", "at", "w", "h", F.explode(known).alias("t"))
    # Places of the template's band minima, and the windows that begin in this block and hold one.
    held = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(F.col("t.keys"), x), i + F.col("at"))), lambda i: i.isNotNull())
    first = lambda i: F.greatest(F.ceil(F.col("at") / F.col("t.step")), F.ceil((i - F.col("t.span") + 1) / F.col("t.step"))).cast("int")
    last = lambda i: F.least(F.floor(i / F.col("t.step")), F.floor((F.col("at") + BLOCK - 1) / F.col("t.step"))).cast("int")
    starts = F.array_distinct(F.flatten(F.transform(held, lambda i: F.when(first(i) <= last(i), F.sequence(first(i), last(i))).otherwise(F.array().cast("array<int>")))))
    windows = each.select("doc_id", "at", "w", "h", "t", F.explode(starts).alias("k"))
    # Explode keeps what follows from being computed more than once a window.
    begin = F.col("k") * F.col("t.step") - F.col("at") + 1
    windows = windows.select("doc_id", "t", (F.col("k") * F.col("t.step")).alias("at"), F.slice("w", begin, F.col("t.span") + SHINGLE - 1).alias("w"), F.array_distinct(F.slice("h", begin, F.col("t.span"))).alias("h"))
    # Bands retrieve the template ...
    met = windows.filter(F.exists(in_bands(lambda k: F.array_min(F.transform("h", lambda x: F.xxhash64(x, k))) == F.get("t.minima", k)), lambda same: same))
    # ... and exact containment decides.
    shingles = F.transform(F.sequence(F.lit(1), F.size("w") - (SHINGLE - 1)), lambda i: F.concat_ws(" ", F.slice("w", i, SHINGLE)))
    share = F.size(F.array_intersect(shingles, F.col("t.shingles"))) / F.size("t.shingles")
    found = met.select("doc_id", F.col("t.license_id").alias("license_id"), "at", share.alias("share")).filter(F.col("share") >= least)
    found = found.groupBy("doc_id", "license_id", "at").agg(F.max("share").alias("share"))
    return found.groupBy("doc_id", "license_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("share").alias("containment"), F.min_by("at", F.struct(-F.col("share"), F.col("at"))).cast("long").alias("first_word")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The containment of every template in every window of every document, without signatures.
OP3_SQL = f"""
WITH t(license_id, ts, span, step) AS (VALUES {", ".join(f"({_quoted(k)}, [{', '.join(map(_quoted, s))}], {n}, {step})" for k, s, n, step in template_rows(TEMPLATES))}),
p AS (SELECT license_id, span, step, len(ts) AS m, unnest(ts) AS x FROM t),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, r, i, array_to_string(w[i + 1:i + {SHINGLE}], ' ') AS x FROM (SELECT doc_id, r, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS i FROM d WHERE len(w) >= {SHINGLE})),
h AS (SELECT doc_id, r, license_id, m, x, step, unnest(range(greatest(0, CAST(ceil((i - span + 1) / step) AS BIGINT)), i // step + 1)) AS k FROM s JOIN p USING (x)),
f AS (SELECT doc_id, license_id, k * step AS a, count(DISTINCT x) / any_value(m) AS share FROM h GROUP BY doc_id, r, license_id, k, step),
c AS (SELECT doc_id, license_id, a, max(share) AS share FROM f GROUP BY doc_id, license_id, a)
SELECT doc_id, license_id, count(*) AS n_windows, max(share) AS containment, CAST(arg_min(a, (-share, a)) AS BIGINT) AS first_word FROM c WHERE share >= 0.8 GROUP BY doc_id, license_id
"""
