"""License scans: MinHash bands over text windows retrieve templates, shingles verify them.

Words are runs of characters other than ASCII signs and a few typographic
ones, A-Z lower-cased, so comment marks and quotes around a notice don't count.
A template of m distinct shingles is sought in windows of 2 m shingles that
begin at every multiple of an eighth of m: an occurrence of up to 15/8 m
shingles, so with many words added, lies whole in one of them. With four fifths
of a template in a window their similarity is 0.8 m / 2.2 m at least, and BANDS
one-row bands collide with a chance of 1 - (1 - 4/11)**BANDS, which misses less
than one in a million.

A band of a window collides with a template's only if the window holds the very
shingle that is the template's minimum in that band and nothing less. So the
bands' minima, a table of BANDS rows a template, are joined with the texts'
shingles, and only windows around what meets are sketched: windows left out
can't collide in any band.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ascii_lower, cut

SHINGLE = 5
BANDS = 32
#: Windows begin at every such part of a template.
STEPS = 8

_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

#: Fixed texts: public license notices, grants and full licenses.
TEMPLATES = {
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_REST,
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": " ".join([_CONDITIONS, _BSD, _BSD_WARRANTY]),
    "bsd-3-clause": " ".join([_CONDITIONS, _BSD, _NAMES, _BSD_WARRANTY]),
    "bsd-grant": _CONDITIONS,
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": f"{_ISC} {_ISC_REST}",
    "isc-grant": _ISC,
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": f"{_MIT} {_MIT_REST}",
    "mit-grant": _MIT,
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: What separates words: ASCII but letters and digits, and no-break spaces, copyright signs, dashes, quotes and bullets.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}\x{A9}\x{2010}-\x{2027}]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _shingled(rows: DataFrame, text_col: str) -> DataFrame:
    """``rows`` with ``shingles``, the hash of every run of five words (none in a shorter text), and a number ``row``.

    The number isn't a deterministic expression; so the optimizer keeps later
    filters above it and doesn't write the splitting of a text into them, where
    it would be done again for each word.
    """
    words = F.col("__words")
    hashed = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(words[i + k] for k in range(SHINGLE))))
    none = F.array().cast("array<bigint>")
    return rows.withColumn("__words", _words(F.col(text_col))).withColumn("shingles", F.when(F.size(words) >= SHINGLE, hashed).otherwise(none)).withColumn("row", F.monotonically_increasing_id()).drop("__words")


def _least(shingles: str, band: str) -> Column:
    """The shingle with the least hash of the band numbered ``band``."""
    return F.expr(f"array_min(transform({shingles}, h -> struct(xxhash64(h, {band}) AS v, h AS h))).h")


def sketches(templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of templates (``license, text``) those of five words or more: ``license, wanted, m``, and ``license, m, band, key``, their bands' minima."""
    known = _shingled(templates, "text").select("license", F.array_distinct("shingles").alias("wanted")).where("size(wanted) > 0")
    known = cut(known.withColumn("m", F.size("wanted")), "license-templates")
    bands = known.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
    return known, cut(bands.select("license", "m", "band", _least("wanted", "band").alias("key")), "license-bands")


#: Rows of a template table that are broadcast at most (some 50 bytes each for bands, 8 m for templates).
BROADCAST_ROWS = 500_000
#: Bits of the filter for each minimum, and at most in all (512 KB); fuller, it lets more rows through, and nothing is lost.
FILTER_BITS, FILTER_MOST = 256, 1 << 22


def _bit(h: str, k: int, words: str) -> tuple[str, str]:
    """The word of the filter (of a power of two) and the bit of it that a shingle has in its hash ``k``."""
    return f"cast(shiftrightunsigned(xxhash64({h}, {k}), 6) & ({words} - 1) AS int)", f"cast(xxhash64({h}, {k}) & 63 AS int)"


def _filter_bits(minima: DataFrame) -> DataFrame:
    """One row, ``bits, words``: a bit array with two bits set for each of the minima."""
    n = minima.count()
    words = 1
    while words * 64 < min(n * FILTER_BITS, FILTER_MOST):
        words *= 2
    size = f"{words}L"
    bits = ", ".join("struct({} AS word, {} AS bit)".format(*_bit("key", k, size)) for k in (0, 1))
    some = minima.select(F.expr(f"explode(array({bits}))").alias("b")).groupBy("b.word").agg(F.bit_or(F.expr("shiftleft(1L, b.bit)")).alias("bits"))
    every = minima.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    filled = every.unionByName(some).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # bounded by FILTER_MOST
    return cut(filled.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("x")).select(F.col("x.bits").alias("bits"), F.expr(size).alias("words")), "license-filter")


def _in_bits(h: str) -> str:
    return " AND ".join("(shiftrightunsigned(get(bits, {}), {}) & 1) = 1".format(*_bit(h, k, "words")) for k in (0, 1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """One row per input row and template found in it.

    Columns: ``id_col, license, shared`` (the template's shingles in the best
    window), ``shingles`` (all of the template's), ``first_word`` and
    ``end_word`` of those shared. A template (of a dictionary, or a table
    ``license, text`` of any size with each license once) is found if a window
    has four fifths of its shingles; of equal windows the first is the best.
    Null, empty and short texts have none; rows of a repeated or null id are
    separate. An empty table gives an empty result; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(sorted((TEMPLATES if templates is None else templates).items()), "license string, text string")
    known, minima = sketches(templates.select("license", "text"))
    few = minima.count() <= BROADCAST_ROWS
    small = lambda df: F.broadcast(df) if few else df
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # one row, so that texts without any of the minima go before anything is written
    held = _shingled(rows, "text").join(F.broadcast(_filter_bits(minima)))
    places = F.expr(f"filter(transform(shingles, (h, i) -> if({_in_bits('h')}, struct(i AS place, h AS h), NULL)), x -> x IS NOT NULL)")
    # written with their numbers, so that these stay the same whatever is run again
    held = cut(held.select("row", "id", "shingles", places.alias("places")).where("size(places) > 0"), "license-rows")
    at = held.select("row", F.explode("places").alias("p")).select("row", "p.place", "p.h").join(small(minima), F.col("h") == F.col("key")).drop("h")
    # the windows of the template's size that hold the place
    step = F.greatest(F.lit(1), F.floor(F.col("m") / STEPS)).cast("int")
    last = F.col("place") - F.col("place") % step
    first = F.greatest(F.lit(0), F.ceil((F.col("place") - 2 * F.col("m") + 1) / step).cast("int") * step)
    windows = at.withColumn("start", F.explode(F.sequence(first, last, step)))
    windows = windows.groupBy("row", "license", "m", "start").agg(F.collect_set(F.struct("band", "key")).alias("bands"))
    # exploded from an array of one, so that the slice is made once, by generated code, and not within each expression on it
    windows = windows.join(held, "row").select("row", "id", "license", "m", "start", "bands", F.explode(F.array(F.expr("slice(shingles, start + 1, 2 * m)"))).alias("window"))
    # the sketch: in one of the bands the window's minimum is the template's
    collides = F.expr("exists(bands, b -> array_min(transform(window, h -> xxhash64(h, b.band))) = xxhash64(b.key, b.band))")
    found = windows.where(collides).drop("bands").join(small(known.select("license", "wanted")), "license")
    found = found.withColumn("shared", F.size(F.array_intersect("window", "wanted"))).where("5 * shared >= 4 * m")
    # an intersection keeps the order of its first array
    first = F.expr("array_position(window, element_at(array_intersect(window, wanted), 1)) - 1")
    last = F.expr("size(window) - array_position(reverse(window), element_at(array_intersect(reverse(window), wanted), 1))")
    found = found.withColumns({"first": F.col("start") + first, "end": F.col("start") + last + SHINGLE})
    best = F.max_by(F.struct("id", "shared", "m", "first", "end"), F.struct("shared", -F.col("start")))
    out = found.groupBy("row", "license").agg(best.alias("b"))
    return out.select(
        F.col("b.id").alias(id_col),
        "license",
        F.col("b.shared").cast("long").alias("shared"),
        F.col("b.m").cast("long").alias("shingles"),
        F.col("b.first").cast("long").alias("first_word"),
        F.col("b.end").cast("long").alias("end_word"),
    )
