"""License scans by MinHash bands over text windows, in DataFrame operations only.

Words are lower-cased and lose their punctuation.  A text is cut into windows
of ``WIDTH`` words, one every ``STEP`` words, so each run of WIDTH - STEP + 1
words lies within one window; its set is its shingles of ``SHINGLE`` words.
Each of ``BANDS`` bands is the least of the shingles' hashes under one
permutation (xor with a constant); a band equal to one of a template's windows
(cut at every word) retrieves the template.  For a window and template piece of
Jaccard similarity J that happens with probability 1 - (1 - J)^BANDS: 1 within
a literal licence text, 0.996 for a five-word notice among other words (J = 1/2).
Retrieved templates are verified exactly: the share of the template's distinct
shingles that the whole document contains must reach ``share``.

Defined cases: null and empty texts match nothing; texts shorter than a window
are one window; templates of under WIDTH - STEP + 1 words are refused; repeated
rows with one doc_id give one result if any of them matches; null doc_ids never match.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

WIDTH, STEP, SHINGLE, BANDS, SHARE = 8, 4, 3, 8, 0.8
BROADCAST_ROWS = 500_000
_MASKS = [random.Random(2024 + k).getrandbits(63) for k in range(BANDS)]

#: Public licence notices and openings.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", ""), r"\s+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hash of each run of SHINGLE words; of all words, if fewer."""
    last = F.size(words) - SHINGLE
    return F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))


def _bands(hashes: Column, at: Column, n: int) -> Column:
    """Band values of the window whose n shingles start at place ``at`` (from 0)."""
    cells = [F.get(hashes, at + k) for k in range(n)]
    return F.array(*[F.least(*[c.bitwiseXOR(F.lit(m)) for c in cells]).bitwiseXOR(F.lit(k << 56)) for k, m in enumerate(_MASKS)])


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template_id int, license string, text string")


def _text_bands(texts: DataFrame, step: int) -> DataFrame:
    """Adds ``band`` (one row each) and ``at``, the window's first word, to rows with ``hashes``."""
    n = WIDTH - SHINGLE + 1
    # the last window ends with the text, wherever the step would leave it
    last = F.greatest(F.size("hashes") - n, F.lit(0))
    places = F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)) if step > 1 else F.sequence(F.lit(0), last)
    keep = [c for c in texts.columns if c != "hashes"]
    windows = texts.select(*keep, F.explode(F.transform(places, lambda i: F.struct(i.alias("at"), _bands(F.col("hashes"), i, n).alias("bands")))).alias("w"))
    return windows.select(*keep, "w.at", F.explode("w.bands").alias("band"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, share: float = SHARE) -> DataFrame:
    """(doc_id, template_id, license, containment, first_word) for each template found; ``known``: template_id, license, text."""
    spark = docs.sparkSession
    known = templates(spark) if known is None else known
    known = known.select("template_id", "license", words_of(F.col("text")).alias("words"))
    least = WIDTH - STEP + 1
    if known.filter(F.coalesce(F.size("words"), F.lit(0)) < least).limit(1).count():
        raise ValueError(f"a template has fewer than {least} words")
    known = written(known.select("template_id", "license", _shingles(F.col("words")).alias("hashes")), "templates")
    keys = written(_text_bands(known.select("template_id", "hashes"), 1).select("template_id", "band").distinct(), "bands")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    hashed = texts.select("doc_id", words_of(F.col("text")).alias("words")).select("doc_id", _shingles(F.col("words")).alias("hashes"))
    retrieved = _text_bands(hashed, STEP).join(keys, "band").groupBy("doc_id", "template_id").agg(F.min("at").alias("first_word"))
    retrieved = written(retrieved, "retrieved")
    wanted = retrieved.groupBy("doc_id").agg(F.collect_list(F.struct("template_id", "first_word")).alias("found"))
    wanted = F.broadcast(wanted) if retrieved.count() <= BROADCAST_ROWS else wanted
    own = texts.join(wanted, "doc_id").select("doc_id", words_of(F.col("text")).alias("words"), "found")
    own = own.select("doc_id", _shingles(F.col("words")).alias("own"), F.explode("found").alias("f"))
    met = own.select("doc_id", "own", "f.template_id", "f.first_word").join(F.broadcast(known) if known.count() <= 10_000 else known, "template_id")
    held = F.size(F.array_intersect("hashes", "own")) / F.size(F.array_distinct("hashes"))
    best = met.select("doc_id", "template_id", "license", held.alias("containment"), "first_word").filter(F.col("containment") >= share)
    return best.groupBy("doc_id", "template_id", "license").agg(F.max("containment").alias("containment"), F.min("first_word").cast("long").alias("first_word"))
