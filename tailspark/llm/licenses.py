"""License scans: MinHash bands retrieve templates, exact shingle containment verifies.

Native expressions only.  Texts are cut into overlapping windows, twice as long as the
templates they are meant for and half a window apart, so that each occurrence of a template
lies wholly in some window and makes up at least a quarter of it.  With ``BANDS`` bands of one
row each, such a window shares a band with its template with probability 1 - 0.75 ** BANDS
(0.9999); one that holds only ``CONTAINMENT`` of the template, at Jaccard 0.2, with 0.9992.
Templates that share a band with a window, and only those, are then verified: the share of the
template's shingles in the window.

Some of each template's shingles hold an *anchor* word (``anchors``), so many that a window
which verifies must hold one.  Windows without any are passed over before they are hashed.

Scale: map-only; one row in, one row out; windows are made one at a time, so that a long text
takes little more memory than its words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark.llm.common import LOWER, UPPER, table

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32

#: Notices and usual one-line wordings, by name.
TEMPLATES = {
    "AGPL-3.0": "GNU Affero General Public License, version 3.",
    "AGPL-3.0-notice": "GNU Affero General Public License as published by",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "Apache-2.0-tag": "SPDX-License-Identifier: Apache-2.0",
    "BSD-2-Clause-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause-notice": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
    ),
    "BSD-3-Clause-tag": "SPDX-License-Identifier: BSD-3-Clause",
    "BSD": "Licensed under the BSD License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "GNU General Public License, version 2.",
    "GPL-2.0-notice": "GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-notice": "GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "LGPL-3.0": "GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-notice": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_FROM, _TO = UPPER + _SEPARATORS, LOWER + " " * len(_SEPARATORS)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), lambda w: w != "")


def _shingles(words: Column) -> Column:
    n = F.size(words) - SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))).otherwise(F.array().cast("array<bigint>"))


def _mix(h: Column, band: int) -> Column:
    return F.xxhash64(h, F.lit(band))


def _plain_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))


def anchors(templates: dict[str, str], containment: float = CONTAINMENT) -> list[str]:
    """Long words such that fewer than ``containment`` of any template's distinct shingles are without one.

    A window that holds ``containment`` of a template therefore holds an anchor.
    """
    chosen: set[str] = set()
    for text in templates.values():
        ws = _plain_words(text)
        shingles = {tuple(ws[i : i + SHINGLE]) for i in range(len(ws) - SHINGLE + 1)}
        more = sorted(set(ws) - chosen, key=lambda w: (len(w), w))
        while shingles and more and sum(not chosen & set(x) for x in shingles) >= containment * len(shingles):
            chosen.add(more.pop())
    return sorted(chosen)


def window_size(n_shingles: int) -> int:
    """Shingles in a window: the least power of two of at least twice the template's, and no fewer than 4."""
    return max(4, 1 << (2 * n_shingles - 1).bit_length())


def _prepared(spark: SparkSession, templates: dict[str, str]) -> list[tuple[str, list[int], list[int]]]:
    """name, distinct shingle hashes and band values of each template, from the same expressions as the texts."""
    made = spark.createDataFrame(list(templates.items()), "name string, text string").select("name", F.array_distinct(_shingles(words_of(F.col("text")))).alias("s"))
    rows = made.filter(F.size("s") > 0).select("name", "s", *_least_mixes(F.col("s"))).collect()
    return [(r[0], list(r[1]), list(r[2:])) for r in sorted(rows)]


def _least_mixes(shingles: Column) -> list[Column]:
    """MinHash values of a set of shingles, one per band."""

    def mixed(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: _mix(h, band)))

    return [mixed(k) for k in range(BANDS)]


def _matches(size: int, own: list[tuple[str, list[int], list[int]]], words: list[str], containment: float) -> Column:
    """Verified matches of the templates of one window size in the words ``w`` of a text."""
    step = size // 2
    n = F.size("w") - SHINGLE + 1
    last = F.greatest(F.floor((n - 1) / step), F.lit(0))

    def window(k: Column) -> Column:
        return F.struct((k * step).cast("bigint").alias("first"), F.slice(F.col("w"), (k * step + 1).cast("int"), size + SHINGLE - 1).alias("w"))

    def banded(x: Column) -> Column:
        own = F.array_distinct(_shingles(x["w"]))
        return F.struct(x["first"].alias("first"), F.size(x["w"]).cast("bigint").alias("words"), own.alias("s"))

    def sketched(x: Column) -> Column:
        return F.struct(x["first"].alias("first"), x["words"].alias("words"), x["s"].alias("s"), F.array(*_least_mixes(x["s"])).alias("b"))

    def verified(x: Column, name: str, shingles: list[int], bands: list[int]) -> Column:
        retrieved = F.exists(F.zip_with(x["b"], F.array(*map(F.lit, bands)), lambda a, b: a == b), lambda y: y)
        share = F.size(F.filter(x["s"], lambda h: h.isin(shingles))) / F.lit(float(len(shingles)))
        return F.when(retrieved, F.struct(F.lit(name).alias("name"), x["first"].alias("first"), x["words"].alias("words"), share.alias("containment")))

    anchored = lambda x: F.arrays_overlap(x["w"], F.array(*map(F.lit, words)))
    at = F.transform(F.filter(F.transform(F.sequence(F.lit(0).cast("bigint"), last), window), anchored), banded)
    met = F.transform(F.transform(F.filter(at, lambda x: F.size(x["s"]) > 0), sketched), lambda x: F.array(*(verified(x, *t) for t in own)))
    return F.filter(F.flatten(met), lambda y: y.isNotNull() & (y["containment"] >= containment))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, licenses (sorted names, comma-joined), n_licenses and evidence, one row per document row.

    evidence holds, per window that verifies, name, first word, words and containment.  Null and
    empty texts, and those shorter than a shingle, have no license; long ones are read whole.
    Repeated rows give a row each, an empty table gives none.  Templates shorter than a shingle
    are ignored, and so are columns other than doc_id and text, whatever their names.
    """
    known = _prepared(docs.sparkSession, templates)
    kind = "array<struct<name:string,first:bigint,words:bigint,containment:double>>"
    listed = anchors(templates, containment)
    spotted = F.arrays_overlap("w", F.array(*map(F.lit, listed))) if known else F.lit(False)
    base = docs.select("doc_id", words_of(F.col("text")).alias("w"))
    base = base.select("doc_id", F.when(spotted, F.col("w")).otherwise(F.array().cast("array<string>")).alias("w"))
    sizes = sorted({window_size(len(s)) for _, s, _ in known})
    parts = [_matches(size, [t for t in known if window_size(len(t[1])) == size], listed, containment).cast(kind) for size in sizes]
    found = F.concat(*parts) if parts else F.array().cast(kind)
    named = base.select("doc_id", F.when(F.size("w") >= SHINGLE, found).otherwise(F.array().cast(kind)).alias("evidence"))
    names = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["name"])))
    return named.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size(names).cast("long").alias("n_licenses"), "evidence")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "licenses", "n_licenses")
