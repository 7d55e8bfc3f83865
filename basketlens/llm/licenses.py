"""License scan by exact set-similarity join (operator 5), DataFrame functions only.

A text is cut into overlapping blocks of words; a block matches a template if
it holds at least ``threshold`` of the template's distinct words and, so that
scattered words are no notice, ``in_order`` of its distinct pairs of
consecutive words. Words are ordered by how many documents hold them, rarest
first. Three filters leave few blocks to verify, and lose none that meets the
threshold:

* prefix: a matching block holds one of the template's rarest
  ``size - need + 1`` words (need = words that must be common);
* length: a matching block holds ``need`` words of the templates at least;
* position: behind the first common word, template and block must have enough
  words left to reach ``need``.

Templates have blocks by their length: the smallest of 32, 128, 512, ... words
that is twice as long. Blocks begin every half of that, so any run of words as
long as a template lies within one of its blocks. The templates are a
parameter, and everything that is broadcast or brought to the driver is bounded
by their words.

Besides, fixed phrases are found where their words stand consecutively.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import LOWER, UPPER, once, text_key, words

#: Phrase and label.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label and notice, short ones and whole texts.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation"""),
    ("agpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
License as published by the Free Software Foundation"""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("bsd-3", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
)
THRESHOLD = 0.9
IN_ORDER = 0.6            # with a tenth of the words missing one by one, four fifths of the pairs are left

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _strings(values) -> Column:
    return F.array(*[F.lit(x) for x in values]).cast("array<string>")


def need(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def template_words(notice: str) -> list[str]:
    """Words of a notice in order, lower-cased as those of the texts."""
    return _WORD.findall(notice.translate(str.maketrans(UPPER, LOWER)))


def word_pairs(sequence: list[str]) -> list[str]:
    """The distinct pairs of consecutive words, sorted."""
    return sorted({f"{x} {y}" for x, y in zip(sequence, sequence[1:])})


def block_words(sequence: list[str]) -> int:
    """Words of a block for a template: the smallest of 32, 128, 512, ... that is at least twice as long."""
    size = 32
    while size < 2 * len(sequence):
        size *= 4
    return size


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, in_order: float = IN_ORDER) -> DataFrame:
    """doc_id, text_key, size and start (first word) of the block, template (its place in ``templates``), label and containment
    for every block of ``docs(doc_id, text)`` that meets the threshold and has enough pairs in order."""
    spark = docs.sparkSession
    sequences = [template_words(t) for _, t in templates]
    vocabulary = sorted({x for s in sequences for x in s})
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    base = once(base, w=words(F.col("text"))).drop("text")
    held = base.select(F.explode(F.array_intersect("w", _strings(vocabulary))).alias("word")).groupBy("word").count().collect()   # a row per template word
    order = {r["word"]: r["count"] for r in held}
    ranked = sorted(vocabulary, key=lambda x: (order.get(x, 0), x))
    rank = {x: i for i, x in enumerate(ranked)}
    rows, prefix, known, pairs = [], {}, {}, {}
    for i, ((label, _), sequence) in enumerate(zip(templates, sequences)):
        s, two, size = sorted(set(sequence), key=rank.get), word_pairs(sequence), block_words(sequence)
        n, chain = (need(len(s), threshold) if s else 0), (need(len(two), in_order) if two else 0)
        rows += [(x, i, label, size, at, len(s), n, s, two, chain) for at, x in enumerate(s[: len(s) - n + 1])]
        prefix.setdefault(size, set()).update(s[: len(s) - n + 1])
        known.setdefault(size, set()).update(s)
        pairs.setdefault(size, set()).update(two)
    index = F.broadcast(spark.createDataFrame(rows, "word string, template int, label string, block int, at int, size int, need int, words array<string>, pairs array<string>, chain int"))
    sizes = sorted(x for x in prefix if prefix[x])
    none = "array<struct<block:int,start:int,words:array<string>>>"

    def cuts(size: int) -> Column:
        last = f"greatest(0, ceil((size(w) - {size}) / {size // 2}))"
        every = F.expr(f"transform(sequence(0, cast({last} as int)), i -> struct({size} as block, i * {size // 2} as start, slice(w, i * {size // 2} + 1, {size}) as words))")
        return F.when(F.arrays_overlap("w", _strings(sorted(prefix[size]))), every).otherwise(F.array()).cast(none)

    def by_size(value) -> Column:
        out = F.array().cast("array<string>")
        for size in sizes:
            out = F.when(F.col("block") == size, value(size)).otherwise(out)
        return out

    blocks = base.select("doc_id", "text_key", F.explode(F.concat(F.array().cast(none), *[cuts(size) for size in sizes])).alias("b")).select("doc_id", "text_key", "b.*")
    blocks = blocks.where(F.arrays_overlap("words", by_size(lambda size: _strings(sorted(prefix[size])))))
    runs = F.expr("transform(slice(words, 1, greatest(size(words) - 1, 0)), (x, i) -> concat(x, ' ', get(words, i + 1)))")
    blocks = once(blocks, have=by_size(lambda size: F.array_intersect(_strings(sorted(known[size], key=rank.get)), F.col("words"))),
                  runs=by_size(lambda size: F.array_intersect(_strings(sorted(pairs[size])), runs))).drop("words")
    tokens = blocks.select("doc_id", "text_key", "block", "start", "have", "runs", F.posexplode("have").alias("pos", "word"))
    likely = tokens.join(index, ["word", "block"]).where((F.size("have") >= F.col("need"))
                                                         & (F.least(F.col("size") - F.col("at"), F.size("have") - F.col("pos")) >= F.col("need")))
    both = F.size(F.array_intersect("have", "words"))
    chained = F.size(F.array_intersect("runs", "pairs")) >= F.col("chain")
    return likely.where((both >= F.col("need")) & chained).select("doc_id", "text_key", F.col("block").alias("size"), "start", "template", "label", (both / F.col("size")).alias("containment")).distinct()


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, in_order: float = IN_ORDER) -> DataFrame:
    """A row per row of ``docs(doc_id, text)``: doc_id, n_words, n_base (all places of phrases), first_word and last_word
    (smallest and largest start of a place, words from 0; null without one), base_labels, labels (of the phrases and of
    matching templates; distinct, sorted, comma-joined) and score (1 with a phrase, else the largest containment that
    meets the threshold, else 0).

    Null and empty texts have no words, no labels and score 0. Rows that
    repeat get equal results; a null doc_id is a value as any other; an empty
    table gives an empty result. Other columns are not read.
    """
    found = matches(docs, templates, threshold, in_order).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    found = found.withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    base = once(base, w=words(F.col("text"))).drop("text")
    base = once(base, line=F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    places = []
    for phrase, _ in phrases:
        same = " and ".join(f"get(w, i + {j}) = '{x}'" for j, x in enumerate(phrase.split()))
        places.append(F.when(F.col("line").contains(f" {phrase} "), F.expr(f"filter(sequence(0, size(w) - 1), i -> {same})")).otherwise(F.array().cast("array<int>")))
    base = once(base, **{f"p{k}": x for k, x in enumerate(places)})
    at = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    labels = F.array_distinct(F.concat(*[F.when(F.size(f"p{k}") > 0, _strings([label])).otherwise(_strings([])) for k, (_, label) in enumerate(phrases)]))
    base = base.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), at.alias("at"), labels.alias("by_phrase"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["id"]) & (base["text_key"] == found["key"]), "left")
    every = F.array_distinct(F.concat("by_phrase", F.coalesce("more", _strings([]))))
    return out.select("doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
                      F.array_join(F.sort_array("by_phrase"), ",").alias("base_labels"), F.array_join(F.sort_array(every), ",").alias("labels"),
                      F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))
