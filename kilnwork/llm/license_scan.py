"""License scans by diagonal voting.

Every rolling k-gram of a document's words is hashed and joined, by Spark, to the
positions that the gram has in the templates. A hit votes for the diagonal
(document position less template position); neighbouring diagonals, as insertions
and deletions make them, are merged; a span is verified by the share of the
template's places that its votes cover, each counted once. A phrase must be covered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, BYTE_CODES, Rolling, require, text_blocks, word_bounds

GRAM = 3
#: Least share of a template's grams that a span must have.
COVERAGE = 0.8
#: Diagonals this close are one span.
DRIFT = 3

#: Phrases that count word for word, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Wordings of public licenses, and their labels.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind": "apache-2",
    "licensed under the gnu general public license version 3": "gpl-3",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _grams(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word k-grams of a block's documents, the place where each document's begin, and its words."""
    data = _LOWER[data]
    starts, ends, of = word_bounds(data, offsets, ALNUM)
    words = Rolling(Rolling(BYTE_CODES[data]).hash(starts, ends))
    at = np.arange(max(0, len(starts) - k + 1))
    at = at[of[at] == of[at + k - 1]]
    n = len(offsets) - 1
    return words.hash(at, at + k), np.searchsorted(of[at], np.arange(n + 1)), np.bincount(of, minlength=n)


def _listed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, data, offsets in text_blocks(batch.column(2)):
                hashes, begins, words = _grams(data, offsets, k)
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(hashes.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(words.astype(np.int64)), lists], ["row", "doc", "n_words", "grams"])

    return run


def _positions(spark, wordings: list[tuple[str, str, bool]], k: int) -> DataFrame:
    """(gram, template, place, least, label, phrase): a row for each gram of each wording. The list is the caller's, so its size is known."""
    rows = []
    for t, (text, label, phrase) in enumerate(wordings):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, _, _ = _grams(data, np.array([0, len(data)]), k)
        if not len(hashes):
            raise ValueError(f"a template needs {k} words at least: {text!r}")
        rows += [(int(h), t, i, len(hashes), label, phrase) for i, h in enumerate(hashes.astype(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, place int, size int, label string, phrase boolean")


def license_scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, k: int = GRAM, coverage: float = COVERAGE, drift: int = DRIFT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_base, first_word, last_word (places of phrases), base_labels, labels, score, n_spans.

    Words are runs of letters and digits after A-Z is lower-cased. `score` is the
    largest share of a template that a span covers (1 for a phrase, 0 without
    any hit). A null or empty text has no words and no labels; repeated rows and
    rows with equal or null keys are scanned each by itself. A text of any length is
    scanned whole; an empty table gives an empty result; other columns, of whatever
    name, don't matter.
    """
    wordings = [(t, label, True) for t, label in (PHRASES if phrases is None else phrases).items()]
    wordings += [(t, label, False) for t, label in (TEMPLATES if templates is None else templates).items()]
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    source = require(docs, key, text).select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), F.col(text).alias("text"))
    grams = source.mapInArrow(_listed(k), f"row long, doc {kind}, n_words long, grams array<long>")
    hits = (
        grams.select("row", "doc", "n_words", F.posexplode_outer("grams").alias("at", "gram"))
        .join(F.broadcast(_positions(spark, wordings, k)), "gram", "left")
        .where("template is not null or at is null or at = 0")
        .select("row", "doc", "n_words", "at", "template", "place", "size", "label", "phrase")
        .repartition("row")
    )
    diagonals = hits.groupBy("row", "doc", "n_words", "template", (F.col("at") - F.col("place")).alias("diagonal"), "size", "label", "phrase").agg(F.collect_set("place").alias("places"), F.min("at").alias("first"), F.max("at").alias("last"))
    along = Window.partitionBy("row", "template").orderBy("diagonal", "first")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(along) > drift) | (F.abs(F.col("first") - F.lag("first").over(along)) > F.col("size") + k)
    spans = (
        diagonals.withColumn("fresh", F.coalesce(F.col("phrase") | fresh, F.lit(True)).cast("int"))
        .withColumn("span", F.sum("fresh").over(along))
        .select("row", "doc", "n_words", "template", "span", "size", "label", "phrase", F.explode_outer("places").alias("place"), "first", "last")
        .groupBy("row", "doc", "n_words", "template", "span", "size", "label", "phrase", "place")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("row", "doc", "n_words", "template", "span", "size", "label", "phrase")
        .agg(F.count("place").alias("covered"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("share", F.when(F.col("template").isNull(), 0.0).otherwise(F.col("covered") / F.col("size")))
    )
    base = F.col("phrase") & (F.col("covered") == F.col("size"))
    verified = base | (~F.col("phrase") & (F.col("share") >= coverage))
    joined = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    return (
        spans.groupBy("row", "doc", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            joined(base).alias("base_labels"),
            joined(verified).alias("labels"),
            F.max(F.when(base | ~F.col("phrase"), F.col("share"))).alias("score"),
            F.count(F.when(verified, 1)).alias("n_spans"),
        )
        .select(F.col("doc").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.coalesce("score", F.lit(0.0)).alias("score"), "n_spans")
    )
