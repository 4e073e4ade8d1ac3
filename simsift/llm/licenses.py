"""License scan by diagonal voting.

Every template (a phrase or a license text) is a sequence of words. The hashes of all rolling k-grams of words of a
document are joined with the template positions that have the same hash. A hit at document word p and template word q
votes for the diagonal p - q; a passage that follows a template puts all its votes on one diagonal, and words that were
added or left out move the rest to a neighbouring one. Votes are counted by diagonal, and neighbouring diagonals whose
places follow each other are merged into spans. A span is verified by aligning its words with the template's (longest
common subsequence): it holds a license text if it has COVER of the template's words and these are DENSE of its own. In
a span that is longer than that allows, the same is asked of the parts that begin where a diagonal does.

Phrases have two or three words, so they use k = 2 and must be complete; license texts use k = LONG_K. The templates
are a fixed list and broadcast; grams meet them in the map tasks, and only votes are dealt, by document, with the words
of the documents that have any. Neither a common word nor a common line brings rows of different documents together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SHORT_K, LONG_K = 2, 4
#: Multiplier of the rolling hash, and words whose hash a worker remembers.
_BASE, REMEMBERED = 0x9E3779B97F4A7C15, 400_000
#: Diagonals this near each other are merged, if the next begins so many words after the end of the last at most.
SHIFT, GAP = 8, 32
#: Share of a license text's words that a span must hold, and share of a span's words that must be the license's.
COVER, DENSE = 0.5, 0.5
#: Hashes of a row that every document has, and of the row with its words.
_DOCUMENT, _BODY = 1, 2


@dataclass(frozen=True)
class Template:
    name: str
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[bytes]:
        return words(self.text)

    @property
    def k(self) -> int:
        return SHORT_K if self.phrase else LONG_K


# The base phrases, and the opening or grant passages of public licenses.
TEMPLATES = (
    Template("mit license", "mit", "mit license", True),
    Template("apache license", "apache", "apache license", True),
    Template("general public license", "gpl", "general public license", True),
    Template("MIT", "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("GPL-3.0", "gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("LGPL", "lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("BSD", "bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("ISC", "isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("MPL-2.0", "mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("CC", "cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("CC BY", "cc", "Licensed under CC BY 4.0"),
    Template("CC BY-SA", "cc", "Licensed under CC BY-SA 4.0"),
    Template("CC BY-ND", "cc", "Licensed under CC BY-ND 4.0"),
    Template("CC BY-NC", "cc", "Licensed under CC BY-NC 4.0"),
    Template("CC BY-NC-SA", "cc", "Licensed under CC BY-NC-SA 4.0"),
    Template("CC BY-NC-ND", "cc", "Licensed under CC BY-NC-ND 4.0"),
    Template("MIT warranty", "mit", "The Software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."),
    Template("Apache-2.0 warranty", "apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    Template("GPL warranty", "gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("Unlicense", "unlicense", "This is free and unencumbered software released into the public domain."),
)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and everything beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_LOWER).split()


class _Hashes(dict):
    """Hash of each word, computed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


def grams(found: list[bytes], k: int, hashes: _Hashes) -> np.ndarray:
    """Rolling hashes of all k-grams; the number of words is part of a hash."""
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(len(h) - k + 1, 0)
    value = np.full(n, k, np.uint64)
    for i in range(k):
        value = value * np.uint64(_BASE) + h[i : i + n]
    return value.view(np.int64)


def positions(templates=TEMPLATES) -> list[tuple[int, int, int, int]]:
    """(hash, template, at, k): every k-gram of every template, and the two rows of a document."""
    rows = [(_DOCUMENT, -1, 0, 0), (_BODY, -2, 0, 0)]
    for t, template in enumerate(templates):
        rows += [(h, t, i, template.k) for i, h in enumerate(grams(template.words, template.k, _Hashes()).tolist())]
    return rows


def _scan(templates):
    names = ["key", "id", "n_words", "body", "grams"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = _Hashes(), np.array([p[0] for p in positions(templates)[2:]], np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                at, n, body, every = [], [], [], []
                for r, text in enumerate(b.column(2).to_pylist()):
                    found = words(text)
                    own = np.concatenate(([_DOCUMENT], *(grams(found, k, hashes) for k in (SHORT_K, LONG_K))))
                    at.append(r)
                    n.append(len(found))
                    body.append(None)
                    every.append(own)
                    if np.isin(own, known).any():  # the words, to verify what the votes find
                        at.append(r)
                        n.append(len(found))
                        body.append(b" ".join(found).decode())
                        every.append(np.array([_BODY]))
                ends = np.cumsum([0, *map(len, every)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(every)))
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(n, pa.int64()), pa.array(body, pa.string()), lists], names=names)

    return run


def common_words(template: list[bytes], found: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    return common_by_prefix(template, found)[-1] if found else 0


def common_by_prefix(template: list[bytes], found: list[bytes]) -> list[int]:
    """Length of the longest common subsequence with every prefix of found, a bit for each word of the template."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(template):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(template)) - 1
    v, out = full, []
    for w in found:
        u = v & at.get(w, 0)
        v = (v + u | v - u) & full
        out.append(len(template) - v.bit_count())
    return out


def passages(template: list[bytes], text: list[bytes], start: int, stop: int, starts: list[int]) -> tuple[list[tuple[int, int, float]], float]:
    """(start, stop, cover) of the license in a span, and the best cover of any part of it, less where that is not dense.

    The span counts as a whole if it may. If it is too long for that, since fragments before and after were merged into
    it, every part is looked at that begins with a diagonal and is no longer than a valid one can be: of those that begin
    at one place the one with most of the template, the shorter one of equals; parts that overlap one before are left out.
    """
    size = len(template)

    def score(n: int, length: int) -> float:
        return n / size * min(1.0, n / length / DENSE)

    whole, length = common_words(template, text[start:stop]), stop - start
    if whole >= COVER * size and whole >= DENSE * length:
        return [(start, stop, whole / size)], score(whole, length)
    found, best, last = [], score(whole, length), start
    for a in starts:
        if a < last:
            continue
        common = common_by_prefix(template, text[a : min(stop, a + math.floor(size / DENSE))])
        best = max([best, *(score(n, i + 1) for i, n in enumerate(common))])
        n, shorter = max(((n, -i - 1) for i, n in enumerate(common) if n >= DENSE * (i + 1)), default=(0, 0))
        if n and n >= COVER * size:
            last = a - shorter
            found.append((a, last, n / size))
    return found, best


def _verify(templates):
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("template", pa.string()), ("label", pa.string()), ("phrase", pa.bool_()), ("cover", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [t.words for t in templates]
        for b in batches:
            spans, scores = [], []
            for body, found in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                kept, score = [], 0.0
                text = (body or "").encode().split(b" ") if found else []
                for s in sorted(found or [], key=lambda s: (s["start"], s["stop"], s["template"])):
                    t, start, stop = templates[s["template"]], s["start"], s["stop"]
                    if t.phrase:
                        best = float(text[start:stop] == own[s["template"]])
                        parts = [(start, stop, best)] if best else []
                    else:
                        parts, best = passages(own[s["template"]], text, start, stop, s["starts"])
                    kept += [{"start": a, "stop": b, "template": t.name, "label": t.label, "phrase": t.phrase, "cover": c} for a, b, c in parts]
                    score = max(score, best)
                spans.append(kept)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(span)), pa.array(scores, pa.float64())], names=["id", "n_words", "spans", "score"])

    return run


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(id, n_words, spans, labels, score), a row for every row of docs.

    spans: array of struct<start, stop, template, label, phrase, cover>, by start: words from 0, stop exclusive, cover
    the share of the template's words that the span holds in order. Complete phrases count, and license texts from
    COVER and DENSE on. labels: distinct, sorted. score: the best cover of any span, less where it is not dense; 0
    without votes. A null text counts as empty. Rows with equal ids, and repeated rows, are told apart; other columns
    of docs are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("body", T.StringType())])
    schema = schema.add("grams", T.ArrayType(T.LongType()))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    every = rows.mapInArrow(_scan(templates), schema).select("key", "id", "n_words", "body", F.posexplode("grams").alias("pos", "gram"))
    known = F.broadcast(spark.createDataFrame(positions(templates), "hash long, template int, at int, k int"))  # a fixed list
    votes = every.join(known, F.col("gram") == F.col("hash"))
    short = F.greatest(F.col("n_words") - (SHORT_K - 1), F.lit(0))  # grams of SHORT_K come first
    place = F.when(F.col("k") == 0, 0).otherwise(F.col("pos") - 1 - F.when(F.col("k") == LONG_K, short).otherwise(0))
    votes = votes.withColumn("place", place.cast("long")).select("key", "id", "n_words", "body", "template", "k", "at", "place", (F.col("place") - F.col("at")).alias("diagonal"))
    votes = votes.repartition("key")  # everything below is grouped by the row, so this is the only exchange
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("id", "n_words", "body")]
    lines = votes.groupBy("key", "template", "diagonal").agg(F.collect_set("at").alias("at"), F.min("place").alias("start"), F.max(F.col("place") + F.col("k")).alias("stop"), *first)
    by_diagonal = Window.partitionBy("key", "template").orderBy("diagonal")
    phrase = F.col("template").isin([i for i, t in enumerate(templates) if t.phrase])
    far = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > SHIFT) | (F.col("start") - F.lag("stop").over(by_diagonal) > GAP)
    lines = lines.withColumn("fresh", F.coalesce(phrase | far, F.lit(True)).cast("int")).withColumn("span", F.sum("fresh").over(by_diagonal))
    spans = lines.groupBy("key", "template", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max(F.size("at")).alias("held"), F.sort_array(F.collect_set("start")).alias("starts"), *first)
    grams_of = F.element_at(F.array(*[F.lit(len(t.words) - t.k + 1) for t in templates]), F.col("template") + 1)
    worth = (F.col("template") >= 0) & (~phrase | (F.col("held") == F.when(F.col("template") >= 0, grams_of)))  # all grams of a phrase
    found = F.collect_list(F.when(worth, F.struct("start", "stop", "template", "starts"))).alias("found")
    done = spans.groupBy("key").agg(*first, found).select("id", "n_words", "body", "found")
    span = T.StructType().add("start", T.LongType()).add("stop", T.LongType()).add("template", T.StringType()).add("label", T.StringType()).add("phrase", T.BooleanType()).add("cover", T.DoubleType())
    out = T.StructType([T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("score", T.DoubleType())])
    checked = done.mapInArrow(_verify(templates), out)
    return checked.select("id", "n_words", "spans", F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["label"]))).alias("labels"), "score")


def license_query(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["phrase"])
    starts = F.transform(base, lambda s: s["start"])
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda s: s["label"]))), ",")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels.alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
