"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

DataFrame and SQL functions only. Words are runs of ASCII letters and digits, lowered; shingles are two
words. For every length among the templates, windows of that many words overlap by seven eighths or
more, so some window is aligned with a match to within a sixteenth of its length. A template is found
where a window, widened by an eighth (one word at least) on both sides, contains ``share`` (0.8) of its
shingles.

Such a window and its template have a Jaccard similarity of 0.58 or more; 16 bands of one value then
miss it with probability 1e-6, and unchanged copies of short templates (whose windows start at every
word) never. In windows of 16 words or fewer a word more weighs too much for that, so their widened
words have bands too: their similarity is 0.6 or more, 0.5 for three words (missed with 2e-5). Before windows are cut, texts and windows without any *anchor* are passed over, which loses
nothing: anchors are words chosen so that, of each template, the shingles without one are fewer than a
match must hold. Texts are first cut into segments of ``SEGMENT`` words with the words around that their
windows need, and windows out of these, so that no row made per window carries more than the window: the
work grows with the text, not with its square.

The templates are a fixed list, so the tables broadcast have a fixed size. Nothing of the documents is
shuffled but the verified matches.

Defined results: null, empty and unmatched texts give no rows; a null doc_id is returned as it is; rows
with the same doc_id are summed up together; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import plain

# License notices, and the whole texts of the short licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-3-clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
BANDS, ROWS = 16, 1
SHORT, SEGMENT = 16, 512


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def shingles_of(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def needed(n: int, share: float) -> int:
    return max(1, -int(-(share * n - 1e-9) // 1))


def anchors(templates: dict[str, str], share: float) -> list[str]:
    """Words, longest first, until every template's shingles without one are fewer than a match needs."""
    out: set[str] = set()
    for text in templates.values():
        shingles = shingles_of(words_of(text))
        for word in sorted({w for s in shingles for w in s.split()}, key=lambda w: (-len(w), w)):
            if sum(not out & set(s.split()) for s in shingles) < needed(len(shingles), share):
                break
            out.add(word)
    return sorted(out)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))

    return _let(words, pairs)


def _shingles(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bands(shingles: Column) -> Column:
    """One key a band, from MinHash values of the shingles."""

    def keys(hashed: Column) -> Column:
        least = lambda seed: F.array_min(F.transform(hashed, lambda h: F.xxhash64(h, seed)))
        return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, *[least(b * ROWS + k) for k in range(ROWS)]))

    return _let(F.transform(shingles, lambda s: F.xxhash64(s)), keys)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8) -> DataFrame:
    """doc_id, license, n_matches (windows that verify), first_word, containment (the largest)."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    known = [(name, len(words_of(t)), shingles_of(words_of(t))) for name, t in sorted(templates.items())]
    known = [(name, n, s, needed(len(s), share)) for name, n, s in known if s]
    marks = anchors(templates, share)
    table = spark.createDataFrame(known, "license string, length int, shingles array<string>, needed int")
    table = table.select("license", "length", F.col("shingles").alias("wanted"), "needed", F.explode(_bands(F.col("shingles"))).alias("band"))
    by_length: dict[int, set[str]] = {}
    for _, n, shingles, _ in known:
        by_length.setdefault(n, set()).update(w for s in shingles for w in s.split() if w in marks)

    rows = plain(docs, doc_id="long", text="string")
    rows = rows.where(_let(F.lower("text"), lambda low: reduce(or_, [F.contains(low, F.lit(m)) for m in marks], F.lit(False))))
    rows = rows.select("doc_id", _words(F.col("text")).alias("words"))
    longest = max(by_length, default=1)
    pad, total = longest + longest // 8 + 1, F.size("words")

    def segment(k: Column) -> Column:
        at = k * SEGMENT + 1
        low = F.greatest(F.lit(1), at - pad)
        return F.struct(at.alias("at"), low.alias("low"), F.slice("words", low, F.least(total, at + SEGMENT + 2 * pad) - low + 1).alias("part"))

    rows = rows.where("size(words) > 1").select("doc_id", total.alias("total"), F.explode(F.transform(F.sequence(F.lit(0), F.floor((total - 1) / SEGMENT).cast("int")), segment)).alias("segment"))
    rows = rows.select("doc_id", "total", "segment.*").where(F.arrays_overlap("part", F.array(*[F.lit(m) for m in marks]).cast("array<string>")))
    kinds = F.array(*[F.struct(F.lit(n).alias("length"), F.array(*[F.lit(w) for w in sorted(ws)]).alias("marks")) for n, ws in sorted(by_length.items())])
    rows = rows.select("*", F.explode(kinds).alias("kind")).select("doc_id", "total", "at", "low", "part", "kind.*")
    places = F.transform(F.filter(F.sequence(F.lit(1), F.size("part")), lambda i: F.array_contains("marks", F.element_at("part", i))), lambda i: F.col("low") + i - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("length") / 8)).cast("int")
    first = lambda p: F.greatest(F.lit(1), p - F.col("length") + 1 - step)
    last = lambda p: F.least(F.col("total"), p + step)
    own = lambda s: ((s - 1) % step == 0) & (s >= F.col("at")) & (s < F.col("at") + SEGMENT)
    starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.filter(F.sequence(first(p), F.greatest(first(p), last(p))), own))))

    def window(s: Column) -> Column:
        begin = F.greatest(F.lit(1), s - step)
        cut = lambda x, n: F.slice("part", x - F.col("low") + 1, n)
        return F.struct(s.alias("start"), begin.alias("begin"), cut(s, F.col("length")).alias("own"), cut(begin, s + F.col("length") + step - begin).alias("broad"))

    windows = rows.select("doc_id", "length", F.explode(F.transform(starts, window)).alias("window")).select("doc_id", "length", "window.*")
    windows = windows.select("doc_id", "length", "start", "begin", _shingles(F.col("own")).alias("shingles"), _pairs(F.col("broad")).alias("wide")).where("size(shingles) > 0")
    bands = F.when(F.col("length") <= SHORT, F.concat(_bands(F.col("shingles")), _bands(F.col("wide")))).otherwise(_bands(F.col("shingles")))
    keyed = windows.withColumn("band", F.explode_outer(F.array_distinct(bands)))
    found = keyed.join(F.broadcast(table), ["length", "band"])
    met = F.size(F.array_intersect("wanted", "wide"))
    found = found.withColumn("met", met).where("met >= needed")
    # A short window that verifies only when widened stands where its first shingle does.
    place = F.array_min(F.filter(F.transform("wanted", lambda w: F.array_position("wide", w)), lambda i: i > 0))
    alone = (F.col("length") > SHORT) | (F.size(F.array_intersect("wanted", "shingles")) >= F.col("needed"))
    found = found.withColumn("start", F.when(alone, F.col("start")).otherwise(F.col("begin") + place - 1))
    out = found.groupBy("doc_id", "license").agg(
        F.countDistinct("start").alias("n_matches"), (F.min("start") - 1).cast("long").alias("first_word"), F.max(F.col("met") / F.size("wanted")).alias("containment")
    )
    return out.select("doc_id", "license", "n_matches", "first_word", "containment")
