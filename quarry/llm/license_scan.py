"""License scan by diagonal voting.

All rolling k-word hashes of all documents are joined in Spark with the positions of the same hashes in license templates. A
hit's diagonal is its word number minus the template's; hits are aggregated by document, template and diagonal, so a passage
that follows a template collects its votes on one diagonal, and on neighbouring ones where words were left out or put in. In
the verification, neighbouring diagonals are merged to spans and compared with the template word by word: phrases must stand
there exactly, license texts must have ``COVER`` of their words in order.

The template table has a few entries of bounded length and is broadcast; a parameter can replace it. Null texts count as empty.
Repeated rows each give a row. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, NOT_ALNUM, run_hashes, shingle_hashes, text_slices, words
from .common import written
from .decontaminate import normal_words

K = 3
#: Words that may lie between two diagonals of one span, and the share of votes and of words that a license text needs.
GAP, VOTES, COVER = 4, 0.25, 0.75
#: Up to this many spans, all documents' together, the table of spans is broadcast to the texts; beyond, both are shuffled.
BROADCAST_SPANS = 500_000

# Phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Passages of public license texts and their labels.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "no part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"),
]


def gram_hashes(column):
    """Yield the k-word hashes of each text of a string column, in the order of its words."""
    for first, last, data, offsets in text_slices(column):
        data = LOWER[data]
        starts, ends, texts = words(data, offsets, NOT_ALNUM)
        hashes, at = shingle_hashes(run_hashes(data, starts, ends - starts), texts, K)
        cuts = np.searchsorted(texts[at], np.arange(last - first + 1))
        for r in range(last - first):
            yield hashes[cuts[r] : cuts[r + 1]].view(np.int64)


def merged_spans(hits: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first word, word after the last, votes) of hits (diagonal, first and last template word, votes) with neighbours merged."""
    out: list[list[int]] = []
    for diagonal, low, high, votes in sorted(hits):
        start, end = diagonal + low, diagonal + high + K
        if out and diagonal - out[-1][3] <= gap and start <= out[-1][1] + 8 * gap:
            last = out[-1]
            last[0], last[1], last[2], last[3] = min(last[0], start), max(last[1], end), last[2] + votes, diagonal
        else:
            out.append([start, end, votes, diagonal])
    return [(s, e, v) for s, e, v, _ in out]


def scan_licenses(docs: DataFrame, phrases: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base counts the places of phrases, first_word and last_word are their smallest and largest start. labels are those of
    phrases and of license texts that pass the verification. score: 1 with a phrase, else the largest share of a license
    text's words found in order, 0 without any candidate. spans: label, first word and word after the last of each finding.
    """
    spark = docs.sparkSession
    phrases, texts = PHRASES if phrases is None else phrases, TEXTS if texts is None else texts
    templates = [(label, normal_words(text), exact) for exact, rows in ((True, phrases), (False, texts)) for label, text in rows]
    if any(len(own) < K for _, own, _ in templates):
        raise ValueError(f"a template needs {K} words at least")
    grams = [(int(h), t, p) for t, hashes in enumerate(gram_hashes(pa.array([b" ".join(own).decode() for _, own, _ in templates]))) for p, h in enumerate(hashes)]
    positions = F.broadcast(spark.createDataFrame(grams, "gram long, template int, place int"))

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(gram_hashes(batch.column(1))), pa.list_(pa.int64()))], names=["key", "grams"])

    hits = docs.select("key", "text").mapInArrow(hashed, "key long, grams array<long>").select("key", F.posexplode("grams").alias("word", "gram")).join(positions, "gram")
    diagonals = hits.groupBy("key", "template", (F.col("word") - F.col("place")).alias("diagonal")).agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count_distinct("place").alias("votes"))
    spans = written(diagonals.groupBy("key").agg(F.collect_list(F.struct("template", "diagonal", "low", "high", F.col("votes").cast("int").alias("votes"))).alias("hits")), "diagonals")
    if (spans.agg(F.sum(F.size("hits"))).first()[0] or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)

    schema = T.StructType(
        [
            docs.schema["doc_id"],
            *(T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")),
            T.StructField("base_labels", T.StringType()),
            T.StructField("labels", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        ]
    )

    def verify(batches):
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names[1:]}
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = normal_words(text)
                by: dict[int, list] = {}
                for h in found or ():
                    by.setdefault(h["template"], []).append((h["diagonal"], h["low"], h["high"], h["votes"]))
                base, labels, places, score, where = set(), set(), [], 0.0, []
                for t, held in by.items():
                    label, template, exact = templates[t]
                    n = len(template)
                    if exact:
                        for diagonal, _, _, votes in held:
                            if diagonal >= 0 and own[diagonal : diagonal + n] == template:
                                base.add(label)
                                places.append(diagonal)
                                where.append((label, diagonal, diagonal + n))
                        continue
                    for start, end, votes in merged_spans(held, GAP):
                        if votes < max(1, VOTES * (n - K + 1)):
                            continue
                        a, b = max(0, start - n // 4), end + n // 4
                        blocks = SequenceMatcher(None, template, own[a:b], autojunk=False).get_matching_blocks()
                        cover = sum(m.size for m in blocks) / n
                        score = max(score, cover)
                        if cover >= COVER:
                            labels.add(label)
                            hit = [m for m in blocks if m.size]
                            where.append((label, a + hit[0].b, a + hit[-1].b + hit[-1].size))
                out["n_words"].append(len(own))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | labels)))
                out["score"].append(1.0 if base else min(1.0, score))
                out["spans"].append([{"label": x, "first": s, "last": e} for x, s, e in sorted(where)])
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c], t) for c, t in zip(schema.names[1:], kinds, strict=True))], names=schema.names)

    return docs.join(spans, "key", "left").select("doc_id", "text", "hits").mapInArrow(verify, schema)
