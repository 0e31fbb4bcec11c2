"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are lower-cased runs of letters and digits; shingles have five words, or all words of a shorter template.
Templates fall into classes by length (the next power of two, M words at most). A text is cut into windows of 2 M words
every 3 M / 4 words, so every passage of up to 5 M / 4 words lies in a window whole. The Jaccard similarity of a template
and a full window that contains just 0.8 of its shingles is the least that a match can have; each class has so many
bands of one value that one of them collides with a probability above 1 - ``MISS`` at the least similarity of its
templates (:func:`n_bands`). Containment is then counted exactly on the shingles themselves.

Texts and windows that can't contain 0.8 of any template are left out before that: shingles that begin with different
words differ, so a match lacks no more of the words that begin a template's shingles than it may lack shingles.

Only DataFrame expressions. Cases: null and empty texts match nothing; a template without words is refused; a text that
is shorter than a window is one window; repeated rows are matched row by row; the result has a row for each row and
template that match, and none for the others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm.common import ASCII_LOWER, ASCII_UPPER, broadcast_if_small, saved, table
from gridtide.llm.decontaminate import words

SIZE = 5
MISS = 1e-4  # probability that no band of a match collides
CONTAINED = 0.8

#: Notices by the name of their license (fixed values).
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
    "bsd-source": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "apache-2.0-grant": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def _words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER)))


def _class(n: int) -> int:
    """The words a template of n words may have at most in its class."""
    return max(8, 1 << (n - 1).bit_length())


def _shingles(w: list[str]) -> list[str]:
    k = min(SIZE, len(w))
    return list(dict.fromkeys(" ".join(w[i : i + k]) for i in range(len(w) - k + 1)))


def n_bands(shingles: list[str], k: int, most: int) -> int:
    """Bands of one value that a template needs: its least Jaccard similarity is that with a full window in which it
    has ``CONTAINED`` of its shingles and all others are different ones."""
    met = math.ceil(CONTAINED * len(shingles))
    least = met / (len(shingles) - met + 2 * most - k + 1)
    return math.ceil(math.log(MISS) / math.log(1 - least)) if least < 1 else 1


def may_match(has, templates: list[list[str]]):
    """Whether an array of words may be that of a match with one of the templates, given by their shingles."""
    out = F.lit(False)
    for shingles in templates:
        begin = sorted({s.split()[0] for s in shingles})
        lacks = len(shingles) - math.ceil(CONTAINED * len(shingles))
        out = out | (F.size(F.array_intersect(has, F.array(*map(F.lit, begin)))) >= len(begin) - lacks)
    return out


def matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word) for each row of docs (doc_id, text) and template in it."""
    spark: SparkSession = docs.sparkSession
    own = {name: _words(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    if not all(own.values()):
        raise ValueError("a template has no words")
    rows = [(name, min(SIZE, len(w)), _class(len(w)), _shingles(w)) for name, w in own.items()]
    count: dict[tuple[int, int], int] = {}
    for _, k, most, shingles in rows:
        count[k, most] = max(count.get((k, most), 1), n_bands(shingles, k, most))
    known = spark.createDataFrame([(*r, count[r[1], r[2]]) for r in rows], "license string, k int, most int, of array<string>, bands int")
    bands = lambda shingles, n: F.transform(F.sequence(F.lit(1), n), lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b)))))
    known = broadcast_if_small(known.select("license", "k", "most", "of", F.explode(F.array_distinct(bands(F.col("of"), F.col("bands")))).alias("band")), 100_000)  # at most some hundred rows a template
    classes: dict[tuple[int, int], list[list[str]]] = {}
    for _, k, most, shingles in rows:
        classes.setdefault((k, most), []).append(shingles)
    every = sorted({s.split()[0] for *_, shingles in rows for s in shingles})
    texts = docs.select("doc_id", words(F.col("text")).alias("w"))
    # beside the row's number, which is not deterministic, filters stay above the words, which are then taken once
    texts = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "w", F.array_intersect("w", F.array(*map(F.lit, every))).alias("has"))
    may = [may_match(F.col("has"), some).alias(f"may_{k}_{most}") for (k, most), some in classes.items()]
    texts = texts.where(may_match(F.col("has"), [of for some in classes.values() for of in some]))
    texts = saved(texts.select("row", "doc_id", "w", *may))  # the whole table is read once
    out = None
    for (k, most), some in sorted(classes.items()):
        cut = texts.where(F.col(f"may_{k}_{most}") & (F.size("w") >= k)).select("row", "doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(3 * most // 4))).alias("first_word"))
        win = F.slice("w", F.col("first_word") + 1, F.lit(2 * most))
        cut = cut.select("row", "doc_id", "first_word", win.alias("win")).where((F.size("win") >= k) & may_match(F.col("win"), some))
        cut = cut.withColumn("has", F.expr(f"array_distinct(transform(sequence(1, size(win) - {k - 1}), i -> array_join(slice(win, i, {k}), ' ')))"))
        cut = cut.select("row", "doc_id", "first_word", "has", F.explode(bands(F.col("has"), F.lit(count[k, most]))).alias("band"))
        here = cut.join(known.where((F.col("k") == k) & (F.col("most") == most)), "band")
        here = here.withColumn("containment", F.size(F.array_intersect("has", "of")) / F.size("of")).where(F.col("containment") >= CONTAINED)
        here = here.select("row", "doc_id", "license", "first_word", "containment")
        out = here if out is None else out.unionByName(here)
    out = out.groupBy("row", "doc_id", "license").agg(F.max("containment").alias("containment"), F.count_distinct("first_word").alias("n_windows"), F.min("first_word").cast("long").alias("first_word"))
    return out.drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _values() -> str:
    rows = []
    for name, text in TEMPLATES.items():
        w = _words(text)
        rows.append(f"('{name}', {min(SIZE, len(w))}, {_class(len(w))}, [{', '.join(repr(s) for s in _shingles(w))}])")
    return ", ".join(rows)


SQL = rf"""
WITH t(license, k, most, shingles) AS (VALUES {_values()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT DISTINCT k, most FROM t),
win AS (SELECT doc_id, k, most, s, w[s + 1:s + 2 * most] AS win FROM d, c, unnest(range(0, len(w), 3 * most // 4)) AS u(s)),
sh AS (SELECT doc_id, k, most, s, list_distinct(list_transform(range(1, len(win) - k + 2), lambda i: array_to_string(win[i:i + k - 1], ' '))) AS has FROM win WHERE len(win) >= k),
m AS (SELECT doc_id, license, s, len(list_intersect(has, shingles)) / len(shingles) AS containment FROM sh JOIN t USING (k, most))
SELECT doc_id, license, max(containment) AS containment, count(*) AS n_windows, CAST(min(s) AS BIGINT) AS first_word
FROM m WHERE containment >= {CONTAINED} GROUP BY doc_id, license
"""
