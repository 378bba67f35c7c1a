"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined to the places where the license templates have them. A hit
votes for the diagonal (place in the document less place in the template); votes are counted by document, template
and diagonal, and neighbouring diagonals are merged. In what is merged, stretches are verified: hits that follow one
another in the document and in the template, no further apart here than there by more than MERGE words, and that have
the words that decide between licenses one after the other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.base import arrow_type, grams, parts, slabs, words_of, written

#: Words of a gram; diagonals at most this far apart are merged; share of a template's words that a span must cover.
K, MERGE, COVER = 3, 2, 0.8
#: The base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Fixed values: (label, text) of the templates, common license notices.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("gpl-3.0-or-later", "either version 3 of the License, or (at your option) any later version"),
    ("gpl-2.0-or-later", "either version 2 of the License, or (at your option) any later version"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("wtfpl", "You just DO WHAT THE FUCK YOU WANT TO"),
]

#: Names and versions that decide between licenses: where a template has one, a span must have it whole, word after word.
DECIDING = (
    "the mit license", "apache license version 2 0", "gnu general public license version 3", "gnu general public license version 2", "gnu general public license",
    "gnu lesser general public license", "cc by 4 0", "cc by nc 4 0", "cc by sa 4 0", "creative commons attribution 4 0", "mozilla public license v 2 0", "free and unencumbered software",
    "version 3 of the license or", "version 2 of the license or", "boost software license version 1 0", "eclipse public license 2 0", "waived all copyright",
)


def _hashes(text: str) -> np.ndarray:
    return words_of(text.encode())[0]


def template_grams(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[int, int, int, str, int]]:
    """(gram, template, place, label, words) of all grams of all templates; gram as a signed 64-bit number."""
    out = []
    for t, (label, text) in enumerate(templates):
        h = _hashes(text)
        out += [(int(g), t, at, label, len(h)) for at, g in enumerate(grams(h, K).astype(np.int64))]
    return out


def deciding_places(text: str) -> list[int]:
    """Places of the grams of the first deciding words that a template has."""
    h = _hashes(text)
    for own in map(_hashes, DECIDING):
        for at in range(len(h) - len(own) + 1):
            if (h[at : at + len(own)] == own).all():
                return list(range(at, at + len(own) - K + 1))
    return []


def stretches(hits: list[tuple[int, int]], words: int, must: list[int]) -> list[tuple[int, int, float]]:
    """(first word, end word, cover) of the verified stretches among one template's hits (place in the document, place in the template).

    A stretch begins where the uncovered share allows it; from hit to hit both places grow, and the diagonal stays within
    MERGE of the first one's. It holds if it covers COVER of the template's words and has the hits at must on one
    diagonal. Stretches of a template don't overlap.
    """
    hits = sorted(set(hits))
    ats = [a for a, _ in hits]
    out, done, last = [], -1, words - K
    for i, (a0, p0) in enumerate(hits):
        if a0 < done or words - p0 < COVER * words:
            continue
        at, place, covered, on = a0, p0, K, {a0 - p0: {p0}}
        for a, p in hits[i + 1 : bisect_left(ats, a0 + last - p0 + MERGE + 1)]:
            if a > at and p > place and abs((a - p) - (a0 - p0)) <= MERGE:
                covered += min(K, p - place)
                at, place = a, p
                on.setdefault(a - p, set()).add(p)
        if covered >= COVER * words and (not must or any(places.issuperset(must) for places in on.values())):
            out.append((a0, at + K, covered / words))
            done = at + K
    return out


def _scan(id_type: pa.DataType):
    phrases = [(label, len(_hashes(p)), grams(_hashes(p), len(_hashes(p)))[0]) for p, label in PHRASES.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            cols = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base", "gram")}
            for first, last, data, offsets in slabs(texts):
                h, starts, _ = words_of(data)
                owner = np.searchsorted(offsets, starts, "right") - 1
                edge = np.searchsorted(owner, np.arange(last - first + 1))
                places, kinds = [], []
                for k, (_, n, g) in enumerate(phrases):
                    at = np.flatnonzero(grams(h, n) == g)
                    at = at[owner[at] == owner[at + n - 1]]
                    places.append(at)
                    kinds.append(np.full(len(at), k))
                order = np.argsort(np.concatenate(places), kind="stable")
                place, kind = np.concatenate(places)[order], np.concatenate(kinds)[order]
                g = grams(h, K).view(np.int64)
                base_edge = np.searchsorted(place, edge)
                for d in range(last - first):
                    p, q = base_edge[d], base_edge[d + 1]
                    cols["n_words"].append(int(edge[d + 1] - edge[d]))
                    cols["n_base"].append(int(q - p))
                    cols["first_word"].append(int(place[p] - edge[d]) if q > p else None)
                    cols["last_word"].append(int(place[q - 1] - edge[d]) if q > p else None)
                    cols["base"].append(sorted({phrases[k][0] for k in kind[p:q]}))
                    cols["gram"].append(g[edge[d] : max(edge[d], edge[d + 1] - K + 1)])
            types = {"base": pa.list_(pa.string()), "gram": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id").cast(id_type), *(pa.array(v, types.get(c, pa.int64())) for c, v in cols.items())],
                names=["row", "doc_id", *cols],
            )

    return scan


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    must = [deciding_places(text) for _, text in TEMPLATES]
    for batch in batches:
        rows, labels, spans = [], [], ([], [], [])
        for row, template, label, words, hits in zip(*(batch.column(c).to_pylist() for c in ("row", "template", "label", "words", "hits")), strict=True):
            for span in stretches([(h["at"], h["place"]) for h in hits], words, must[template]):
                rows.append(row)
                labels.append(label)
                for to, value in zip(spans, span, strict=True):
                    to.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(labels, pa.string()), pa.array(spans[0], pa.int64()), pa.array(spans[1], pa.int64()), pa.array(spans[2], pa.float64())], names=["row", "label", "first", "end", "cover"]
        )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans are the verified template spans (label, first word, end word, cover). score is the best cover of a verified
    span, or half where only a base phrase was found, or else 0. A null or empty text has no words and no labels;
    repeated documents are separate rows; other columns are ignored; texts are scanned whole.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"row long, doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base array<string>, gram array<long>"
    scanned = rows.mapInArrow(_scan(arrow_type(id_type)), schema)
    # a first entry without a gram stands for the document itself, with its columns; the templates are a constant of this module, so broadcasting them is bounded
    own = F.struct("doc_id", "n_words", "n_base", "first_word", "last_word", "base")
    each = scanned.select("row", own.alias("own"), F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "gram")).alias("at", "gram"))
    each = each.select("row", F.when(F.col("at") == 0, F.col("own")).alias("own"), (F.col("at") - 1).cast("long").alias("at"), "gram")
    templates = F.broadcast(spark.createDataFrame(template_grams(), "gram long, template int, place int, label string, words int"))
    seen = written(each.join(templates, "gram", "left").filter(F.col("template").isNotNull() | F.col("own").isNotNull()), "licenses")
    lines = seen.filter(F.col("template").isNotNull()).groupBy("row", "template", "label", "words", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_list(F.struct("at", "place")).alias("hits"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > MERGE, F.lit(True))
    lines = lines.withColumn("run", F.sum(apart.cast("int")).over(order))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["place"], h["place"] + K - 1)))))
    runs = lines.groupBy("row", "template", "label", "words", "run").agg(F.flatten(F.collect_list("hits")).alias("hits")).filter(covered >= COVER * F.col("words"))
    spans = runs.select("row", "template", "label", "words", "hits").mapInArrow(_verified, "row long, label string, first long, end long, cover double")
    best = spans.groupBy("row").agg(F.collect_set("label").alias("labels"), F.max("cover").alias("best"), F.sort_array(F.collect_list(F.struct("first", "end", "label", "cover"))).alias("spans"))
    out = seen.filter(F.col("own").isNotNull()).select("row", "own.*").join(best, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("labels", none))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))).alias("score"),
        "spans",
    )
