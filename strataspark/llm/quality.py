"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, convolved by learned filters of ``WIDTH`` bytes at every
place, rectified and max-pooled in chunks of ``CHUNK`` bytes that overlap by a
filter's width and cover the whole document (zeros follow its end, so a score
depends on the text alone); the chunks' pooled
vectors, averaged, go through one hidden layer to one probability.  An
embedding and a filter tap together are a table of 256 rows, so a document is
scored by table look-ups.

The network is fitted on the driver on a bounded sample: ``per_class`` labelled
documents of each class at most, chosen by hash, of at most ``MAX_TRAIN_BYTES``
each; the class weights restore the labels' own rate.  Every document is scored whole.

Defined cases: null and empty texts get the score of a document without any
byte (one chunk of zeros); rows without a label don't train; without labels of
both classes every score is the rate of label 1 (0.5 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .textops import raw, slices

EMBED, WIDTH, FILTERS, HIDDEN, CHUNK = 8, 8, 16, 16, 512
MAX_TRAIN_BYTES = 1 << 16


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as rows of CHUNK + WIDTH bytes, zero after a text's end; chunks per text; each chunk's text."""
    lengths = np.diff(offsets)
    per = np.maximum(1, -(-lengths // CHUNK))
    base = (np.cumsum(per) - per) * CHUNK
    flat = np.zeros(int(per.sum()) * CHUNK + WIDTH, np.uint8)
    flat[np.arange(len(data)) + np.repeat(base - offsets[:-1], lengths)] = data
    rows = np.lib.stride_tricks.sliding_window_view(flat, CHUNK + WIDTH)[::CHUNK].copy()
    rows[np.cumsum(per) - 1, CHUNK:] = 0
    return rows, per, np.repeat(np.arange(len(lengths)), per)


def _pooled(rows: np.ndarray, taps: np.ndarray, bias: np.ndarray, where: bool = False):
    """(chunks, FILTERS) maxima over each chunk's places; with ``where`` also the places, as positions in ``rows.ravel()``."""
    out = np.zeros((len(rows), FILTERS), np.float32)
    spot = np.zeros((len(rows), FILTERS), np.int64) if where else None
    step = 64
    for lo in range(0, len(rows), step):
        x = rows[lo : lo + step]
        total = taps[0].take(x[:, :CHUNK], axis=0)
        for k in range(1, WIDTH):
            total += taps[k].take(x[:, k : k + CHUNK], axis=0)
        if where:
            best = total.argmax(1)
            spot[lo : lo + step] = np.arange(lo, lo + len(x))[:, None] * (CHUNK + WIDTH) + best
            out[lo : lo + step] = np.take_along_axis(total, best[:, None], 1)[:, 0]
        else:
            out[lo : lo + step] = total.max(1)
    out = np.maximum(out + bias, 0)
    return (out, spot) if where else out


def _taps(p: dict) -> np.ndarray:
    return np.einsum("be,kef->kbf", p["embed"], p["conv"]).astype(np.float32)


def _head(p: dict, pooled: np.ndarray, per: np.ndarray):
    mean = np.add.reduceat(pooled, np.cumsum(per) - per, axis=0) / per[:, None]
    hidden = np.tanh(mean @ p["w1"] + p["b1"])
    return mean, hidden, 1 / (1 + np.exp(-(hidden @ p["w2"] + p["b2"])))


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = 14, seed: int = 7) -> dict:
    """Adam on weighted log loss; gradients reach the filters at the pooled places only."""
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "conv": rng.normal(0, 0.25, (WIDTH, EMBED, FILTERS)), "b": np.zeros(FILTERS),
        "w1": rng.normal(0, 0.3, (FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(()),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    encoded, t = [x.encode() for x in texts], 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            part = order[lo : lo + 32]
            data = np.frombuffer(b"".join(encoded[i] for i in part), np.uint8)
            offsets = np.concatenate(([0], np.cumsum([len(encoded[i]) for i in part])))
            chunks, per, of = _chunks(data, offsets)
            pooled, spot = _pooled(chunks, _taps(p), p["b"].astype(np.float32), True)
            mean, hidden, prob = _head(p, pooled, per)
            y, w = labels[part], weights[part] / weights[part].sum()
            d = (prob - y) * w
            g = {"w2": hidden.T @ d, "b2": d.sum()}
            dh = d[:, None] * p["w2"] * (1 - hidden**2)
            g["w1"], g["b1"] = mean.T @ dh, dh.sum(0)
            dm = ((dh @ p["w1"].T) / per[:, None])[of] * (pooled > 0)
            g["b"], g["conv"], g["embed"] = dm.sum(0), np.zeros_like(p["conv"]), np.zeros_like(p["embed"])
            for k in range(WIDTH):
                b = chunks.ravel()[spot + k]
                for f in range(FILTERS):
                    by = np.bincount(b[:, f], weights=dm[:, f], minlength=256)
                    g["conv"][k, :, f] = by @ p["embed"]
                    g["embed"] += by[:, None] * p["conv"][k, :, f]
            t += 1
            for k in p:
                m, v = moments[k]
                m[...] = 0.9 * m + 0.1 * g[k]
                v[...] = 0.999 * v + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p


def train(docs: DataFrame, labels: DataFrame, per_class: int = 700) -> dict | float:
    """Fit on a bounded sample of ``labels`` (doc_id, label 0 or 1) joined to ``docs`` (doc_id, text)."""
    labels = labels.filter("doc_id is not null and label in (0, 1)").select("doc_id", "label")
    rates = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    rate = rates.get(1, 0) / sum(rates.values()) if rates else 0.5
    if len(rates) < 2:
        return float(rate)
    picked = None
    for c in (0, 1):
        some = labels.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    small = docs.filter(F.octet_length("text") <= MAX_TRAIN_BYTES)
    rows = small.join(F.broadcast(picked), "doc_id").select("text", "label", "doc_id").limit(4 * per_class).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"]))
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return float(rate)
    share = y.mean()
    w = np.where(y == 1, rate / share, (1 - rate) / (1 - share))
    return fit([r["text"] for r in rows], y, w)


def score(docs: DataFrame, model: dict | float) -> DataFrame:
    """(doc_id, score) of every whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((model, _taps(model)) if isinstance(model, dict) else (model, None))

    def each(batches):
        p, taps = shared.value
        for batch in slices(batches):
            if taps is None:
                prob = np.full(batch.num_rows, p, float)
            else:
                chunks, per, _ = _chunks(*raw(batch.column(1)))
                prob = _head(p, _pooled(chunks, taps, p["b"].astype(np.float32)), per)[2]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prob, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, score double")


def quality(docs: DataFrame, training: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 700) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs``."""
    columns = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(columns(training), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label"), per_class)
    return score(columns(docs), model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
