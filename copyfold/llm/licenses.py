"""License scans by an exact set-similarity join, with DataFrame functions only.

Templates are license notices and paragraphs of license texts. A template's tokens
are its distinct pairs of neighbouring words, so the order of words counts. A block of a text, at most a
quarter longer than the template, matches when it holds at least CONTAINED of the template's tokens.

Texts are read once: what is kept of each is where tokens of any template stand.
Tokens are ordered from the globally rarest to the most frequent, by counts over
all documents. If a text holds k of a template's n tokens, one of them is
among the template's n - k + 1 rarest (prefix filter); it has k template tokens
at all (length filter); and from the first shared token on, both have enough left
(position filter). The texts and templates that pass are looked through
from each place of a token on, and tokens are counted exactly.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyfold.llm.common import checkpointed

# The phrases that the contract names, by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Notices and paragraphs of public licenses, by label.
TEMPLATES = (
    ("mit", "under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    (
        "mit",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2", "Apache License Version 2"),
    ("apache-2", "you may not use this file except in compliance with the License"),
    (
        "apache-2",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ),
    (
        "apache-2",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl", "GNU General Public License"),
    ("gpl", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
    ),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/"),
    ("mpl", "Mozilla Public License"),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    (
        "bsd",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "bsd",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    ),
    (
        "zlib",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    ("all-rights-reserved", "All rights reserved"),
)

#: Least share of a template's tokens; a block is longer than its template by at most one word for so many.
CONTAINED, SLACK = 0.8, 4
#: Steps into which the length of a block is divided; far more than the words of any block, squared.
RANGE = 1 << 32

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAPS = "".join(chr(c) for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_words(text: Column) -> Column:
    """The words of a text, A-Z folded; null: none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _GAPS + _UPPER, " " * len(_GAPS) + _LOWER)
    return F.array_remove(F.split(spaced, " "), "")


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def template_rows(templates=TEMPLATES) -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct tokens, least tokens of a match, most words of a block) of each template."""
    rows = []
    for i, (label, text) in enumerate(templates):
        words = re.findall(_WORD, text.lower())
        if len(words) < 2:
            raise ValueError("a template needs two words")
        tokens = list(dict.fromkeys(pairs_of(words)))
        rows.append((i, label, tokens, math.ceil(CONTAINED * len(tokens) - 1e-9), len(words) + len(words) // SLACK))
    return rows


def token_places(words: Column, tokens: list[str]) -> Column:
    """Where the words of a text make one of ``tokens``: array of (pos, token), in order."""
    firsts = sorted({t.split(" ")[0] for t in tokens})

    def pair(i: Column) -> Column:
        return F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))

    found = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.get(words, i).isin(firsts) & pair(i).isin(tokens))
    return F.transform(found, lambda i: F.struct(i.alias("pos"), pair(i).alias("token")))


def matched_blocks(scanned: DataFrame, templates=TEMPLATES) -> DataFrame:
    """The places of ``scanned`` (row, occ) where a template matches: row, label, template, first_word, last_word, share.

    ``row`` is unique. Blocks of one template that overlap are one place, from the first to the last of
    their tokens; share is that of the best of its blocks. Token counts are taken
    over all rows; at most one for each token of a template reaches the driver.
    """
    spark = scanned.sparkSession
    found = template_rows(templates)
    held = scanned.filter(F.size("occ") > 0).select("row", F.explode(F.array_distinct(F.transform("occ", lambda x: x["token"]))).alias("token"))
    counts = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted({t for r in found for t in r[2]}, key=lambda t: (counts.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    sets = [(i, label, sorted(rank[t] for t in tokens), least, words) for i, label, tokens, least, words in found]
    prefixes = [(i, token, place) for i, _, tokens, least, _ in sets for place, token in enumerate(tokens[: len(tokens) - least + 1])]
    names = F.broadcast(spark.createDataFrame(list(rank.items()), "token string, rank int"))
    index = spark.createDataFrame(prefixes, "template int, rank int, place int").join(spark.createDataFrame([(i, t, least) for i, _, t, least, _ in sets], "template int, tokens array<int>, least int"), "template")
    own = held.join(names, "token").groupBy("row").agg(F.array_sort(F.collect_list("rank")).alias("own"))
    probes = own.select("row", "own", F.posexplode("own").alias("at", "rank"))
    left = F.least(F.size("own") - F.col("at"), F.size("tokens") - F.col("place"))
    pairs = probes.join(F.broadcast(index), "rank").filter((F.size("own") >= F.col("least")) & (left >= F.col("least")))
    pairs = pairs.filter(F.size(F.array_intersect("own", "tokens")) >= F.col("least")).select("row", "template").distinct()
    # the places of the template's tokens in the texts that are left
    each = spark.createDataFrame([(i, t, label, len(tokens), least, words) for i, label, tokens, least, words in found for t in tokens], "template int, token string, label string, size int, least int, words int")
    occ = pairs.join(scanned.select("row", "occ"), "row").select("row", "template", F.inline("occ")).join(F.broadcast(each), ["template", "token"])
    # places in units of about 1/RANGE of a block's length: those of one block lie less than RANGE - longest apart, all others more
    longest = max(r[4] for r in found)
    step = F.col("pos").cast("bigint") * F.floor(F.lit(RANGE) / (F.col("words") - 1))
    block = Window.partitionBy("row", "template").orderBy(step).rangeBetween(0, RANGE - 2 * longest)
    blocks = occ.withColumn("shared", F.size(F.collect_set("token").over(block))).withColumn("end", F.max("pos").over(block) + 1).filter("shared >= least")
    by_start = Window.partitionBy("row", "template").orderBy("pos")
    opens = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)) < F.col("pos"), F.lit(True))
    blocks = blocks.withColumn("opens", opens).withColumn("place", F.count_if("opens").over(by_start))
    return blocks.groupBy("row", "template", "label", "place").agg(F.min("pos").cast("bigint").alias("first_word"), F.max("end").cast("bigint").alias("last_word"), F.max(F.col("shared") / F.col("size")).alias("share")).drop("place")


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """License labels of every row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base (places where the words of one of PHRASES
    stand), first_word and last_word (smallest and largest of their starts, from 0;
    else null), base_labels, labels (with those of the matched templates), score:
    the largest share of a template's tokens in a block, of templates that match, 0 without a
    match; and places, an array of the matched blocks (label, template, first_word, last_word, share).
    Null texts count as empty and match nothing; texts of any length are read whole. Each row is
    scanned for itself, so null or repeated ids and texts do no harm. An empty table gives no rows. Further columns are not read.
    """
    phrases = {label: pairs_of(text.split(" ")) for label, text in PHRASES.items()}
    tokens = sorted({t for r in template_rows(templates) for t in r[2]} | {t for p in phrases.values() for t in p})
    words = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_words(F.col("text")).alias("w"))
    scanned = words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), token_places(F.col("w"), tokens).alias("occ"))
    scanned = checkpointed(scanned.withColumn("row", F.monotonically_increasing_id()))

    def places_of(token: str, back: int) -> Column:
        return F.transform(F.filter("occ", lambda x: x["token"] == token), lambda x: x["pos"] - back)

    def starts(pairs: list[str]) -> Column:
        """Places where all pairs of a phrase follow each other."""
        return reduce(F.array_intersect, [places_of(token, j) for j, token in enumerate(pairs)])

    rows = scanned.select("row", "doc_id", "n_words", *[starts(p).alias(f"_{i}") for i, p in enumerate(phrases.values())])
    places = F.concat(*[F.col(f"_{i}") for i in range(len(phrases))])
    base = [F.when(F.size(f"_{i}") > 0, F.lit(label)) for i, label in enumerate(phrases)]
    rows = rows.select(
        "row", "doc_id", "n_words", F.size(places).cast("bigint").alias("n_base"), F.array_min(places).cast("bigint").alias("first_word"), F.array_max(places).cast("bigint").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*base))).alias("base"),
    )
    blocks = matched_blocks(scanned.select("row", "occ"), templates)
    hits = blocks.groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("first_word", "last_word", "label", "template", "share"))).alias("places"),
    )
    out = rows.join(hits, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("places", F.array().cast(hits.schema["places"].dataType)).alias("places"),
    )
