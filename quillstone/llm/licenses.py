"""License scans: phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import textkit as K
from quillstone.llm.common import cut
from quillstone.session import ship

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# The sentences by which licenses are granted or named.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the Software to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License You may obtain a copy of the License at apache org licenses LICENSE 2.0"),
    ("gpl", "licensed under the GNU General Public License version 3"),
    ("gpl", "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
# Whole license texts.
TEMPLATES += [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source "
        "code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS "
        "SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
        "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
        "License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of "
        "the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in "
        "source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
        "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and "
        "to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this "
        "software under copyright law.",
    ),
]
CONTAINED = 0.9
#: The shortest block, in words.
BLOCK = 64
#: As many template tokens at most are sent to every task.
BROADCAST_TOKENS = 100_000

WORD = K.lower_alnum_tables()[0]


def tokens(text: str) -> list[str]:
    """Words of a template as they are compared: lower-cased runs of digits, letters and anything beyond ASCII."""
    data = K.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = K.word_bounds(data, np.array([0, len(data)]), WORD)
    low = data.tobytes()
    return [low[a:b].decode() for a, b in zip(starts, ends)]


def block_of(text: str) -> int:
    """Words in the blocks of a template: the power of two from twice its words on, BLOCK at least.

    Blocks start at every half of their words, so any passage as long as the template lies whole in one.
    """
    return max(BLOCK, 1 << (2 * len(tokens(text)) - 1).bit_length())


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(K.word_hashes(data, np.array([0]), np.array([len(data)]))[0])


class Vocabulary:
    """Numbers of the template words, looked up by hash for whole arrays of words and confirmed by their bytes."""

    def __init__(self, words: list[str]):
        held = sorted((_hash(w), w.encode()) for w in set(words))
        self.hashes = np.array([h for h, _ in held], np.uint64)
        self.words = [w for _, w in held]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.bytes = np.zeros((len(held), max(self.lengths, default=0)), np.uint8)
        for k, w in enumerate(self.words):
            self.bytes[k, : len(w)] = np.frombuffer(w, np.uint8)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the words, and the number of the template word that stands there."""
        if not len(self.words) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = K.word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == hashes)
        numbers = at[places]
        same = (ends - starts)[places] == self.lengths[numbers]
        for k in range(self.bytes.shape[1]):
            held = np.flatnonzero(same & (self.lengths[numbers] > k))
            same[held] = data[starts[places[held]] + k] == self.bytes[numbers[held], k]
        return places[same], numbers[same]


def _prepared(column: pa.Array) -> Iterator[tuple]:
    for first, rows, data, offsets in K.slices(column):
        data = K.LOWER[data]
        yield (first, rows, data, *K.word_bounds(data, offsets, WORD))


def token_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of the template words occurs in all texts; only that many counts reach the driver."""
    ship(docs.sparkSession)
    vocabulary = Vocabulary(words)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in parts:
            for _, _, data, starts, ends, _ in _prepared(batch.column("text")):
                total += np.bincount(vocabulary.numbers(data, starts, ends)[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in vocabulary.words], pa.string()), pa.array(total)], ["word", "n"])

    counted = docs.select("text").mapInArrow(batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r.word: r.n for r in counted.collect()} if vocabulary.words else {}
    return dict.fromkeys(words, 0) | found


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    A block meets a template if it holds at least ``least`` of the template's distinct words; how long the blocks are
    follows from the template (``block_of``), so no template is too long. Template words are ordered by their frequency in all texts, the rarest first. A template's prefix is as many of its rarest words as a block
    that meets it cannot miss altogether: blocks without a prefix word are never looked at, and a pair that shares one is
    dropped where the lengths, or the places of the shared word in both orders, leave too few words to share.

    score is 1 for a phrase, else the best containment of a met template, else 0. Null texts read as empty and have no
    words, no places and no labels; repeated rows come out alike.
    """
    spark = docs.sparkSession
    ship(spark)
    templates = TEMPLATES if templates is None else templates
    named = [(label, sorted(set(tokens(text))), block_of(text)) for label, text in templates if tokens(text)]
    counts = token_counts(docs, [w for _, words, _ in named for w in words])
    order = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (counts[w], w)))}
    table = []
    seeds = {words_in: np.zeros(len(order) + 1, bool) for _, _, words_in in named}
    for number, (label, words, words_in) in enumerate(named):
        ranks = sorted(order[w] for w in words)
        need = ceil(least * len(ranks) - 1e-9)
        for place, rank in enumerate(ranks[: len(ranks) - need + 1]):
            table.append((number, label, words_in, rank, place, len(ranks), need, ranks))
            seeds[words_in][rank] = True

    vocabulary = Vocabulary(list(order))
    rank_of = np.array([order[w.decode()] for w in vocabulary.words], np.int64)
    phrase_words = Vocabulary([w for p in PHRASES for w in p.split()])
    number_of = {w.decode(): k for k, w in enumerate(phrase_words.words)}
    phrases = [([number_of[w] for w in p.split()], label) for p, label in PHRASES.items()]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, rows, data, starts, ends, ranges in _prepared(batch.column("text")):
                owner = K.document_of(ranges)
                marks = np.full(len(starts) + 3, -1, np.int64)
                places, numbers = phrase_words.numbers(data, starts, ends)
                marks[places] = numbers
                found = [[] for _ in range(rows)]
                for words, label in phrases:
                    at = places[numbers == words[0]]
                    for k, w in enumerate(words[1:], 1):
                        at = at[marks[at + k] == w]
                    at = at[at + len(words) <= ranges[owner[at] + 1]]
                    for d, p in zip(owner[at].tolist(), (at - ranges[owner[at]]).tolist()):
                        found[d].append((p, label))
                places, numbers = vocabulary.numbers(data, starts, ends)
                ranks = rank_of[numbers] if len(numbers) else numbers
                own = owner[places] if len(places) else places
                local = places - ranges[own] if len(places) else places
                blocks: list[list] = [[] for _ in range(rows)]
                for words_in, seed in seeds.items():
                    half = words_in // 2
                    at = np.flatnonzero(seed[ranks])
                    last = local[at] // half
                    wanted = np.unique(np.column_stack([np.tile(own[at], 2), np.concatenate([last, last - 1])]), axis=0)
                    for d, b in wanted[wanted[:, 1] >= 0].tolist():
                        lo, hi = np.searchsorted(places, [ranges[d] + b * half, min(ranges[d] + b * half + words_in, ranges[d + 1])])
                        blocks[d].append({"words": words_in, "block": b, "ranks": np.unique(ranks[lo:hi]).tolist()})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        batch.column("twin").slice(first, rows),
                        pa.array(np.diff(ranges)),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array([min(x)[0] if x else None for x in found], pa.int64()),
                        pa.array([max(x)[0] if x else None for x in found], pa.int64()),
                        pa.array([sorted({label for _, label in x}) for x in found], pa.list_(pa.string())),
                        pa.array(blocks, pa.list_(pa.struct([("words", pa.int64()), ("block", pa.int64()), ("ranks", pa.list_(pa.int64()))]))),
                    ],
                    ["doc_id", "twin", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )

    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.hash(text).alias("twin"), text.alias("text")).mapInArrow(
        batches,
        f"doc_id {kind}, twin int, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks array<struct<words:long,block:long,ranks:array<long>>>",
    )
    read = cut(read, "licenses-blocks")
    met = meet(read, table, spark)
    met = met.withColumnRenamed("doc_id", "_doc").withColumnRenamed("twin", "_twin")
    joined = read.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("twin") == F.col("_twin")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        *"doc_id n_words n_base first_word last_word".split(),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", F.coalesce("met", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def meet(read: DataFrame, table: list[tuple], spark) -> DataFrame:
    """doc_id, twin, met (labels) and containment (the best) of documents with a block that meets a template."""
    schema = "template int, label string, words long, rank long, place int, size int, need int, wanted array<long>"
    side = spark.createDataFrame(table, schema)
    if len(table) <= BROADCAST_TOKENS:
        side = F.broadcast(side)
    blocks = read.where(F.size("blocks") > 0).select("doc_id", "twin", F.explode("blocks").alias("b")).select("doc_id", "twin", "b.words", "b.block", F.col("b.ranks").alias("held"))
    each = blocks.select("doc_id", "twin", "words", "block", "held", F.posexplode("held").alias("at", "rank"))
    rest = F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at"))
    pairs = each.join(side, ["words", "rank"]).where((F.size("held") >= F.col("need")) & (rest >= F.col("need") - F.least("place", "at")))
    shared = F.size(F.array_intersect("held", "wanted"))
    verified = pairs.where(shared >= F.col("need")).select("doc_id", "twin", "label", (shared / F.col("size")).alias("containment"))
    return verified.groupBy("doc_id", "twin").agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))
