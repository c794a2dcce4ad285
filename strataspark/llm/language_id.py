"""Language ID: script ranges narrow candidates, word scores, Viterbi spans.

Training counts, over all training texts, hashed byte n-grams of each word (3
and 4 bytes with the word's edges) per language into tables of fixed size, and
which scripts each language uses.  A word's score for a language is the sum of
its n-grams' log probabilities; a word in a script that a language was never
seen in can't be that language.  A Viterbi pass over the words of a text, with
a penalty for each switch, labels spans; the language of the spans with most
letters is the text's.

Defined cases: null texts and texts without any letter are ``und`` with score
0; rows without lang or text don't train; with nothing to train on every text
is ``und``; ties go to the first language by code point; words without letters
take the label of their surroundings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_blocks, prepare
from .textops import LOWER, Words, slices

ORDERS, SLOTS, MAX_LANGS = (3, 4), 1 << 16, 256
#: First bytes of UTF-8 sequences by script range: 0 none, 1 Latin, 2 Greek, 3 Cyrillic, 4 Hebrew and Arabic, 5 Indic and South-East Asian, 6 Kana and Han, 7 Hangul, 8 other.
SCRIPT = np.zeros(256, np.int8)
SCRIPT[65:91] = SCRIPT[97:123] = 1
SCRIPT[0xC3:0xCA] = 1
SCRIPT[0xCA:0xF5] = 8
SCRIPT[0xCD:0xD0] = 2
SCRIPT[0xD0:0xD4] = 3
SCRIPT[0xD6:0xDC] = 4
SCRIPT[0xE0:0xE2] = 5
SCRIPT[0xE3:0xEA] = 6
SCRIPT[0xEA:0xEE] = 7
SCRIPTS = 9
SWITCH = 12.0


def lettered(texts: list[str | None], w: Words) -> np.ndarray:
    """Which texts have a letter (a character of category L)."""
    ascii_letter = (LOWER[w.data] >= 97) & (LOWER[w.data] <= 122)
    sums = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = sums[w.offsets[1:]] > sums[w.offsets[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in texts[d] or "")
    return out


def _grams(w: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of the n-gram that ends after each place of the edged words, and each word's first place.

    An edged word is 0, its bytes, 0; it has length + 3 - order n-grams, one at least.
    """
    lengths = w.ends - w.starts
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    edged = np.zeros(first[-1] + order, np.uint32)
    at = np.repeat(w.starts - first[:-1], lengths) + np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
    inside = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths) + 1
    edged[inside] = LOWER[w.data[at]]
    key = np.zeros(first[-1], np.uint32)
    for k in range(order):
        key = key * np.uint32(0x01000193) ^ edged[k : k + len(key)]
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA6B)
    return (key >> np.uint32(16)).astype(np.int64), first[:-1]


def _scripts(w: Words) -> np.ndarray:
    """Each word's script: that of its largest first byte (0: no letter)."""
    if not len(w.starts):
        return np.zeros(0, np.int8)
    s = SCRIPT[w.data]
    edges = np.stack([w.starts, w.ends], 1).ravel()
    ends = np.concatenate((s, [np.int8(0)]))
    return np.maximum.reduceat(ends, edges)[::2]


def train(rows: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log P(n-gram | lang) as (orders * SLOTS, langs), allowed (SCRIPTS, langs) and log priors, from (lang, text)."""
    n, size = len(langs), len(ORDERS) * SLOTS
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        total = np.zeros(n * (size + SCRIPTS + 1), np.int64)
        grams = total[: n * size].reshape(n, size)
        scripts = total[n * size : n * (size + SCRIPTS)].reshape(n, SCRIPTS)
        for batch in slices(batches):
            w = Words(batch.column(1), hashed=False)
            lang = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            total[n * (size + SCRIPTS) :] += np.bincount(lang, minlength=n)
            if not len(w.starts):
                continue
            of = lang[w.doc]
            script = _scripts(w)
            scripts += np.bincount(of * SCRIPTS + script, minlength=n * SCRIPTS).reshape(n, SCRIPTS)
            weight = np.where(script > 0, w.ends - w.starts + 1, 0)
            for k, order in enumerate(ORDERS):
                slot, _ = _grams(w, order)
                of_gram = np.repeat(of, w.ends - w.starts + 1)
                solid = np.repeat(weight > 0, w.ends - w.starts + 1)
                grams[:, k * SLOTS : (k + 1) * SLOTS] += np.bincount(of_gram[solid] * SLOTS + slot[solid], minlength=n * SLOTS).reshape(n, SLOTS)
        return total

    total = count_blocks(rows, count)
    grams = total[: n * size].reshape(n, size).astype(np.float64)
    scripts = total[n * size : n * (size + SCRIPTS)].reshape(n, SCRIPTS)
    docs = total[n * (size + SCRIPTS) : n * (size + SCRIPTS + 1)]
    table = np.concatenate([np.log((g + 0.5) / (g.sum(1, keepdims=True) + 0.5 * SLOTS)) for g in np.split(grams, len(ORDERS), axis=1)], axis=1)
    seen = scripts > 1e-5 * np.maximum(scripts.sum(1, keepdims=True), 1)
    return np.ascontiguousarray(table.T.astype(np.float32)), seen.T, np.log((docs + 1) / (docs.sum() + n)).astype(np.float32)


def word_scores(w: Words, table: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """(words, langs): log scores; 0 for words without letters; far below for languages outside the word's script."""
    n = table.shape[1]
    out = np.zeros((len(w.starts), n), np.float32)
    if not len(w.starts):
        return out
    for k, order in enumerate(ORDERS):
        slot, first = _grams(w, order)
        out += np.add.reduceat(table[k * SLOTS + slot], first, axis=0)
    script = _scripts(w)
    out[script == 0] = 0
    ok = allowed[script]
    none = ~ok.any(1) | (script == 0)
    out[~ok & ~none[:, None]] -= 1e4
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, all texts side by side, the longest first."""
    n = scores.shape[1]
    labels = np.zeros(len(scores), np.int8 if n <= 127 else np.int16)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return labels
    start, lengths = first[:-1][order], lengths[order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
    back = np.zeros(scores.shape, bool)  # whether the best way into this word and label is a switch
    came = np.zeros(len(scores), labels.dtype)  # from which label a switch comes
    total = scores[start] + prior
    for t in range(1, longest):
        m = active[t]
        at = start[:m] + t
        now = total[:m]
        best = now.argmax(1)
        top = now[np.arange(m), best] - switch
        jump = top[:, None] > now
        back[at], came[at] = jump, best
        total[:m] = np.where(jump, top[:, None], now) + scores[at]
    label = total.argmax(1)
    last = lengths - 1
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at = start[:m] + t
        labels[at] = label[:m]
        if t:
            jump = back[at, label[:m]]
            label[:m] = np.where(jump, came[at], label[:m])
    return labels


def identify(docs: DataFrame, training: DataFrame, carry: tuple[str, ...] = (), spans: bool = False, letters: bool = False) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): lang_pred, score and the columns to ``carry``; with ``spans`` also (lang, first word, stop), with ``letters`` whether the text has a letter."""
    spark = docs.sparkSession
    prepare(spark)
    known = training.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    langs = sorted(r[0] for r in known.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    model = spark.sparkContext.broadcast(train(known, langs) if langs else None)
    own = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(f"c_{c}") for c in carry])
    kept = own.schema.fields[1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double" + (", spans array<struct<lang:string,start:int,stop:int>>" if spans else "") + (", has_letter boolean" if letters else "")

    def each(batches):
        for batch in slices(batches, "text", 8 << 20):
            parts = list(slices(iter([batch]), "text"))
            scores, first, lengths, solid, n_words = [], [np.zeros(1, np.int64)], [], [], 0
            for part in parts:
                w = Words(part.column(0), hashed=False)
                solid.append(lettered(part.column(0).to_pylist(), w))
                if model.value is None:
                    continue
                s = word_scores(w, model.value[0], model.value[1])
                scores.append(s)
                lengths.append(np.where(_scripts(w) > 0, w.ends - w.starts, 0))
                first.append(w.first[1:] + n_words)
                n_words += len(w.starts)
            solid = np.concatenate(solid)
            pred, score, found = ["und"] * len(solid), [0.0] * len(solid), [[] for _ in solid]
            if model.value is not None:
                scores, first, lengths = np.concatenate(scores), np.concatenate(first), np.concatenate(lengths)
                labels = viterbi(scores, first, model.value[2])
                weight = np.zeros((len(solid), len(langs)))
                np.add.at(weight, (np.repeat(np.arange(len(solid)), np.diff(first)), labels), lengths)
                best, total = weight.argmax(1), weight.sum(1)
                for d in np.flatnonzero(solid):
                    pred[d] = langs[best[d]]
                    score[d] = float(weight[d, best[d]] / total[d]) if total[d] else 1.0 / len(langs)
                    if spans:
                        own_labels = labels[first[d] : first[d + 1]]
                        cut = np.flatnonzero(np.diff(own_labels)) + 1
                        ends = [*cut.tolist(), len(own_labels)]
                        found[d] = [{"lang": langs[own_labels[a]], "start": a, "stop": b} for a, b in zip([0, *cut.tolist()], ends) if b > a]
            cols = [*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            names = [f.name for f in kept] + ["lang_pred", "score"]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))))
                names.append("spans")
            if letters:
                cols.append(pa.array(solid))
                names.append("has_letter")
            yield pa.RecordBatch.from_arrays(cols, names)

    out = own.mapInArrow(each, schema)
    return out.select("doc_id", *[F.col(f"c_{c}").alias(c) for c in carry if c != "doc_id"], "lang_pred", "score", *(["spans"] if spans else []), *(["has_letter"] if letters else []))
