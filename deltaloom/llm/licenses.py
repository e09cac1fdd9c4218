"""License scans with DataFrame functions only.

Every template has a MinHash signature of BANDS bands of one row. A window's band can equal a template's only if the
window holds the template's pivot shingle of that band, so the shingles of a text meet the pivots in a hash join
first, and signatures are made for the overlapping windows around pivots alone: the same collisions as
banding every window. Half a template of slack surrounds a window, so a template that keeps 0.8 of its shingles has a
Jaccard similarity of 0.47 with it and collides in one of 16 bands with probability 0.99996. Exact containment of the
template's shingles decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from deltaloom.llm._shared import documents

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 16
#: Templates beyond this number are joined by shuffle instead of broadcast (each has BANDS pivots at most).
BROADCAST_TEMPLATES = 5000
#: Notices and headers of public licenses.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD-3-Clause-condition": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def license_words(text) -> F.Column:
    """Lower-cased runs of a-z and 0-9, in order; the first or last may be empty."""
    return F.split(F.lower(text), "[^a-z0-9]+")


def shingles(words: str, first: str = "0", last: str | None = None) -> F.Column:
    """Hashes of the shingles that begin at words first..last of an array column."""
    last = last or f"size({words}) - {SHINGLE}"
    hashed = ", ".join(f"get({words}, i + {k})" for k in range(SHINGLE))
    return F.expr(f"if({last} < {first}, cast(array() as array<bigint>), transform(sequence({first}, {last}), i -> xxhash64({hashed})))")


def template_pivots(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """Rows (hash, license_id, at, words, parts, bands): where a band's least shingle stands in a template."""
    table = spark.createDataFrame(list(templates.items()), "license_id string, text string")
    trimmed = F.expr("filter(w, x -> x <> '')")
    table = table.select("license_id", license_words(F.col("text")).alias("w")).select("license_id", trimmed.alias("w"))
    table = table.select("license_id", F.size("w").alias("words"), shingles("w").alias("parts")).where("size(parts) > 0")
    least = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> array_min(transform(parts, h -> xxhash64(h, k))))")
    table = table.withColumn("least", least).select("license_id", "words", "parts", "least", F.posexplode("parts").alias("at", "hash"))
    bands = F.expr(f"filter(sequence(0, {BANDS - 1}), k -> xxhash64(hash, k) = get(least, k))")
    table = table.withColumn("bands", bands).where("size(bands) > 0")
    return table.select("hash", "license_id", "at", "words", F.array_distinct("parts").alias("parts"), "bands")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """Templates found in every whole text.

    Rows (id_col, license_id, containment, first_word, n_windows): the best containment of the template's five-word
    shingles in a window, that window's first word and how many windows were verified. Templates under five words match nothing.

    * Nulls: a null text has no rows; a null id groups like any other.
    * Empty texts, and those too short for a shingle, have no rows. Very long texts are searched whole.
    * Ties: of equally good windows the one with the least first word counts.
    * Repeated rows of one id count once. An empty table, or no template, gives an empty result.
    * Other columns are not carried, so their names cannot clash.
    """
    templates = TEMPLATES if templates is None else templates
    pivots = template_pivots(docs.sparkSession, templates)
    if len(templates) <= BROADCAST_TEMPLATES:
        pivots = F.broadcast(pivots)
    words = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id_"), license_words(F.col(text_col).cast("string")).alias("w"))
    placed = words.select("id_", "w", F.posexplode(shingles("w")).alias("pos", "hash")).join(pivots, "hash")
    slack = "cast(ceil(words * 0.25) as int)"
    framed = placed.select("id_", "w", "license_id", "parts", "bands", "hash", F.expr(f"greatest(pos - at - {slack}, 0)").alias("first"), F.expr(f"least(pos - at + words + {slack}, size(w)) - {SHINGLE}").alias("last"))
    seen = framed.withColumn("window", shingles("w", "first", "last")).drop("w")
    banded = seen.where("exists(bands, k -> array_min(transform(window, h -> xxhash64(h, k))) = xxhash64(hash, k))")
    found = banded.select("id_", "license_id", "first", F.expr("size(array_intersect(parts, window)) / size(parts)").alias("share")).where(F.col("share") >= containment)
    best = found.groupBy("id_", "license_id", "first").agg(F.max("share").alias("share"))
    grouped = best.groupBy("id_", "license_id").agg(F.max("share").alias("containment"), F.expr("max_by(first, struct(share, -first))").alias("first_word"), F.count("*").alias("n_windows"))
    return grouped.withColumnRenamed("id_", id_col)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License templates in every document."""
    return scan(documents(spark, sf_dir))
