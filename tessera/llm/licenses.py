"""License notices in texts, retrieved by MinHash bands and verified by shingles.

Words are lower-cased without punctuation; shingles have five of them. Overlapping
windows of 12, 4 and 1 shingles have a MinHash under each of their size's
permutations (hashes with different seeds), one key a band. A template uses the
largest size that it holds, at every word; texts use all sizes, the largest at every
fourth word. A text that holds 0.8 of a template's shingles has a window with at
most a fifth of them changed, so at a similarity of 0.67 at least: five bands of one
row miss it with probability 0.33 ** 5, 0.4 percent; notices have many windows, and
an unchanged one never is missed. Notices of less than 12 shingles can lose two at
most and keep a window whole or 3 of 5 in common (three bands: 6 percent).

Retrieved (document, template) pairs are verified exactly: the share of the
template's different shingles that the whole text has must reach ``threshold``,
wherever they stand.

Most texts hold no license, so a lossless test comes first: for each template words
are chosen that its shingles need to such a degree that without any of them the
threshold can't be reached; texts without any chosen word are left out.

Edge cases: null and empty texts match nothing; texts and templates of fewer than
five words are one shingle of all their words; of rows with equal ``doc_id`` the
best counts; of templates with equal ids the smallest text; a null ``doc_id`` is
not reported; no templates or an empty table give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, single_spaces, small_side, text_or_empty, word_grams

SHINGLE = 5
#: Sizes of windows in shingles: (size, bands, every so many words of a text).
WINDOWS = ((12, 5, 4), (4, 3, 1), (1, 1, 1))
THRESHOLD = 0.8
#: Template keys (about 40 bytes each) that are sent to every executor at most.
BROADCAST_KEYS = 200_000
#: Templates for which words are chosen at most; with more, all texts are cut into windows.
CHOOSE_FOR = 1000

# Public license notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-short": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(
        list((TEMPLATES if templates is None else templates).items()), "template_id string, text string"
    )


def tidy(text: str | Column) -> Column:
    """Words in lower case without punctuation, parted by single spaces."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]++", "")
    return F.btrim(single_spaces(bare), F.lit(" "))


def _shingles(words: str) -> Column:
    """Hashes of the shingles of a tidy text, in order."""
    short = F.length(words) - F.length(F.translate(words, " ", "")) + 1 < SHINGLE
    grams = F.when(F.col(words) == "", F.array().cast("array<string>")).when(short, F.array(words))
    return F.transform(grams.otherwise(word_grams(words, SHINGLE)), lambda x: F.xxhash64(x))


def chosen_words(templates: dict[str, str], threshold: float = THRESHOLD) -> list[str]:
    """Words of tidy templates of which a text needs one to reach ``threshold`` with any template.

    Greedy: the word that most shingles still need, long words first; a template is
    done when the shingles without a chosen word are fewer than it must have.
    """
    left = {}
    for name, text in templates.items():
        words = text.split(" ")
        left[name] = {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    needed = {name: threshold * len(found) for name, found in left.items()}
    chosen: list[str] = []
    while left:
        gain: Counter[str] = Counter()
        for name, found in left.items():
            for shingle in found:
                for word in set(shingle):
                    gain[word] += len(word) ** 2 / needed[name]
        best = max(gain, key=lambda w: (gain[w], w))
        chosen.append(best)
        left = {name: {x for x in found if best not in x} for name, found in left.items()}
        left = {name: found for name, found in left.items() if len(found) >= needed[name]}
    return chosen


def _keys(sizes: tuple[tuple[int, int, int], ...]) -> Column:
    """MinHash keys of the windows of shingles ``h``: one number for size, band and value."""
    parts = []
    for size, bands, stride in sizes:
        for band in range(bands):
            number = 16 * size + band
            if size == 1:
                parts.append(f"transform(h, x -> xxhash64({number}, x))")
                continue
            # Indices stay inside: texts with fewer shingles have no window of the size.
            mins = (
                f"transform(sequence(0, size(h) - {size}, {stride}), i -> xxhash64({number},"
                f" array_min(transform(slice(h, i + 1, {size}), x -> xxhash64(x, {band})))))"
            )
            parts.append(f"case when size(h) < {size} then cast(array() as array<bigint>) else {mins} end")
    return F.expr(f"concat({', '.join(parts)})")


def scan(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, template_id, containment, matched, shingles, first_word)`` for each pair that reaches the threshold."""
    own = templates.select("template_id", tidy(text_or_empty()).alias("words")).filter("words <> '' and template_id is not null")
    own = materialise(own.groupBy("template_id").agg(F.min("words").alias("words")).withColumn("h", _shingles("words")), "templates")
    # Of the sizes the largest that a template holds, at each of its words.
    fitting = F.coalesce(*(F.when(F.size("h") >= size, _keys(((size, bands, 1),))) for size, bands, _ in WINDOWS))
    keys = materialise(own.select("template_id", F.explode(fitting).alias("key")).distinct(), "keys")
    n_keys, n_templates = keys.agg(F.count("*"), F.count_distinct("template_id")).first()
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text")).filter("doc_id is not null")
    words = texts.select("doc_id", tidy("text").alias("words"))
    if 0 < n_templates <= CHOOSE_FOR:
        some = chosen_words({r["template_id"]: r["words"] for r in own.select("template_id", "words").collect()}, threshold)
        # One pattern, since the optimizer writes the tidy text out at each place that names it.
        words = words.filter(F.col("words").rlike("|".join(some)))
    side = F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys
    retrieved = (
        words.select("doc_id", _shingles("words").alias("h"))
        .select("doc_id", F.explode_outer(_keys(WINDOWS)).alias("key"))
        .join(side, "key")
        .select("doc_id", "template_id")
        .distinct()
    )
    retrieved = materialise(retrieved, "retrieved")
    # Verification reads the retrieved texts alone.
    pairs = texts.join(small_side(retrieved), "doc_id").select("doc_id", "template_id", tidy("text").alias("words"))
    pairs = pairs.select("doc_id", "template_id", _shingles("words").alias("h"))
    exact = own.select("template_id", F.array_distinct("h").alias("theirs"))
    exact = F.broadcast(exact) if n_keys <= BROADCAST_KEYS else exact
    found = (
        pairs.join(exact, "template_id")
        .withColumn("matched", F.size(F.array_intersect("theirs", "h")).cast("long"))
        .withColumn("shingles", F.size("theirs"))
        .filter(F.col("matched") >= threshold * F.col("shingles"))
        .withColumn("first_word", F.expr("array_position(transform(h, x -> array_contains(theirs, x)), true) - 1"))
    )
    best = found.groupBy("doc_id", "template_id", "shingles").agg(F.max(F.struct("matched", (-F.col("first_word")).alias("from"))).alias("best"))
    return best.select(
        "doc_id",
        "template_id",
        F.round(F.col("best.matched") / F.col("shingles"), 6).alias("containment"),
        F.col("best.matched").alias("matched"),
        "shingles",
        (-F.col("best.from")).alias("first_word"),
    )
