"""Quality classifier: attention-based multiple-instance learning (gated attention, Ilse et al. 2018).

A document is a bag of passages of ``PASSAGE`` words, all of them.  Each passage is measured (shares of byte classes, lengths, distinct
and repeated words, hashed bag of words), encoded by a tanh layer, weighted by gated attention softmax(w . (tanh(V h) * sigmoid(U h)))
over the document, and the weighted sum is scored by a logistic unit.  Only documents have labels.

Training: at most ``TRAIN_ROWS`` labelled documents (smallest hash of doc_id) of at most ``TRAIN_CHARS`` characters, measured on the
executors, fitted on the driver by Adam with a fixed seed.

Defined results: null or wordless text is a bag of one empty passage; without training rows every score is 0.5; of conflicting labels
of one doc_id the mean counts; repeated rows get equal results; no other column than doc_id and text is read for a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, crc_mod, map_arrow, slices, table, text_bytes, word_hashes

PASSAGE = 128
TRAIN_ROWS, TRAIN_CHARS = 6000, 60_000
THRESHOLD = 0.3
BAG = 64
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4
SEED = 5

#: Byte classes: space, newline, lower case, upper case, digit, symbol of quality rules, full stop or comma, exclamation, other
#: punctuation, beyond ASCII.
_CLASSES = 10
_CLASS = np.full(256, 8, np.int64)
_CLASS[_SPACE] = 0
_CLASS[10] = 1
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 2, 3, 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[[46, 44]] = 6
_CLASS[33] = 7
_CLASS[128:] = 9
WIDTH = _CLASSES + 6 + BAG


def passages(texts) -> tuple[np.ndarray, np.ndarray]:
    """(measures of passages, passages per row); each row has one at least."""
    data, offsets = text_bytes(texts)
    hashes, counts = word_hashes(data, offsets)
    per_row = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(per_row) - per_row
    total = int(per_row.sum())
    x = np.zeros((total, WIDTH), np.float32)
    row = np.repeat(np.arange(len(counts)), counts)
    ordinal = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    of_word = first[row] + ordinal // PASSAGE
    n = np.bincount(of_word, minlength=total).astype(np.float64)
    safe = np.maximum(n, 1)
    if len(data):
        inside = ~_SPACE[data]
        before = np.concatenate(([False], inside[:-1]))
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        begun = np.cumsum(inside & ~before)  # words begun so far
        of_byte = np.repeat(np.arange(len(counts)), np.diff(offsets))
        done = np.concatenate(([0], np.cumsum(counts)))[of_byte]
        of_byte = first[of_byte] + np.maximum(begun - done - 1, 0) // PASSAGE
        kinds = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=total * _CLASSES).reshape(total, _CLASSES)
        size = kinds.sum(1)
        x[:, :_CLASSES] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
        x[:, _CLASSES] = size / safe / 10
    k = _CLASSES + 1
    x[:, k] = np.log1p(n) / 5
    if len(hashes):
        key = of_word.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24)
        key.sort()
        new = np.concatenate(([True], key[1:] != key[:-1]))
        distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=total)
        x[:, k + 1] = distinct / safe
        same = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
        x[:, k + 2] = np.bincount(of_word[1:][same], minlength=total) / safe
        again = (hashes[3:] == hashes[:-3]) & (of_word[3:] == of_word[:-3])
        x[:, k + 3] = np.bincount(of_word[3:][again], minlength=total) / safe
        bag = np.bincount(of_word * BAG + (hashes & np.uint64(BAG - 1)).astype(np.int64), minlength=total * BAG).reshape(total, BAG)
        x[:, k + 5 :] = np.sqrt(bag / safe[:, None])
    x[:, k + 4] = 1 - (n > 0)
    return x, per_row


def _segments(per_row: np.ndarray) -> np.ndarray:
    return np.cumsum(per_row) - per_row


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(p: dict, x: np.ndarray, per_row: np.ndarray):
    h = np.tanh((x - p["mean"]) / p["scale"] @ p["E"] + p["e"])
    t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    a = (t * s) @ p["w"]
    at, owner = _segments(per_row), np.repeat(np.arange(len(per_row)), per_row)
    a = np.exp(a - np.maximum.reduceat(a, at)[owner])
    a = a / np.add.reduceat(a, at)[owner]
    z = np.add.reduceat(a[:, None] * h, at)
    return h, t, s, a, owner, z, sigmoid(z @ p["c"] + p["b"])


def gradient(p: dict, x: np.ndarray, per_row: np.ndarray, y: np.ndarray) -> dict:
    """Of the mean logistic loss."""
    h, t, s, a, owner, z, q = forward(p, x, per_row)
    g = {}
    dq = (q - y) / len(y)
    g["c"], g["b"] = z.T @ dq, dq.sum(keepdims=True)
    dz = dq[:, None] * p["c"]
    da = (dz[owner] * h).sum(1)
    da = a * (da - np.add.reduceat(a * da, _segments(per_row))[owner])
    g["w"] = (t * s).T @ da
    dts = da[:, None] * p["w"]
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (a[:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
    g["E"], g["e"] = ((x - p["mean"]) / p["scale"]).T @ dh, dh.sum(0)
    return g


def train(x: np.ndarray, per_row: np.ndarray, y: np.ndarray, seed: int = SEED) -> dict:
    r = np.random.Generator(np.random.PCG64(seed))
    init = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
    p = {"E": init(WIDTH, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE), "c": init(HIDDEN), "b": np.zeros(1)}
    fixed = {"mean": x.mean(0), "scale": np.maximum(x.std(0), 0.05)}
    names = list(p)
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    at, step = _segments(per_row), 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            docs = order[lo : lo + BATCH]
            take = np.concatenate([np.arange(at[d], at[d] + per_row[d]) for d in docs])
            xb, nb, yb = x[take], per_row[docs], y[docs]
            g = gradient(p | fixed, xb, nb, yb)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in names:
                grad = g[k] + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                p[k] = p[k] - rate * m1[k] / (1 - 0.9**step) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return p | fixed


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=None) -> dict | None:
    """The model, or None without labelled rows."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = (marked if allowed is None else marked.where(allowed)).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= TRAIN_CHARS).join(F.broadcast(sample), "doc_id")

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                x, n = passages(part.column("text"))
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([x[e - k : e].tobytes() for k, e in zip(n.tolist(), ends.tolist())], pa.binary())], ["doc_id", "y", "x"])

    got = sorted(map_arrow(rows.select("doc_id", "y", "text"), work, "doc_id long, y double, x binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    if not got:
        return None
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got]
    return train(np.concatenate(bags).astype(np.float64), np.array([len(b) for b in bags]), np.array([r.y for r in got]))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for part in slices(batch):
                if shared.value is None:
                    q = np.full(part.num_rows, 0.5)
                else:
                    q = forward(shared.value, *passages(part.column("text")))[-1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(q.astype(np.float64))], ["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), work, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), allowed=crc_mod("doc_id", 5) != 0)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
