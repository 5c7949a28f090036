"""Quality of documents by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of it is encoded (character class pairs, repetition of words, word lengths),
gated attention weighs the encoded passages, and the weighted sum is scored; weights and scores are learned together from
document labels. Learning takes a bounded sample of labelled documents; scoring sees every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from pickflow.llm.common import small_side, text_batches
from pickflow.llm.wordhash import as_bytes, in_pieces, mixed, words

#: Words of a passage.
PASSAGE = 48
#: Most labelled documents that are learned from, and the longest text (bytes) among them: the driver gets their features.
TRAIN_DOCS, TRAIN_BYTES = 6_000, 200_000
#: Bytes of text that are encoded at a time; a task needs some fifty times as much memory for it.
PIECE = 1 << 20
HIDDEN, GATE, EPOCHS, RATE = 32, 16, 40, 3e-3

_CLASS = np.full(256, 9, np.int64)  # other marks
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".?", b",;:", b"!", b"|#*$%&=+~^_<>{}[]\\@`")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 10
CLASSES = 11
WIDTH = CLASSES * CLASSES + 8


def _first_seen(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """1 where a key occurs for the first time in its group."""
    if not len(keys):
        return np.zeros(0)
    both = mixed(keys + mixed(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    new = np.ones(len(keys))
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys))
    out[order] = new
    return out


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (rows), and for each text where its passages begin. A text without words has one of zeros."""
    data, begins = as_bytes(texts)
    hashes, start, end, at = words(data, begins)
    counts = np.diff(at)
    many = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros((first[-1], WIDTH), np.float32)
    doc = np.repeat(np.arange(len(counts)), counts)
    word = np.arange(len(hashes)) - at[doc]
    passage = first[doc] + word // PASSAGE
    if len(hashes):
        n = np.bincount(passage, minlength=len(out)).astype(float)
        has = n > 0
        opens = np.flatnonzero(np.concatenate([[True], np.diff(passage) > 0]))
        closes = np.concatenate([opens[1:], [len(hashes)]]) - 1
        # classes of neighbouring bytes, from the first byte of a passage to its last
        a, b, which = start[opens], end[closes], passage[opens]
        size = b - a
        place = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        kinds = _CLASS[data[place]]
        owner = np.repeat(np.arange(len(a)), size)
        same = owner[1:] == owner[:-1]
        pairs = np.bincount((owner[:-1] * CLASSES * CLASSES + kinds[:-1] * CLASSES + kinds[1:])[same], minlength=len(a) * CLASSES * CLASSES)
        out[which, : CLASSES * CLASSES] = np.sqrt(pairs.reshape(len(a), -1) / np.maximum(1, size)[:, None])
        after = np.zeros(len(hashes), np.uint64)
        after[:-1] = hashes[1:]
        two = hashes * np.uint64(0x9E3779B97F4A7C15) + after
        three = two * np.uint64(0xD6E8FEB86659FD93)
        three[:-2] += hashes[2:]
        repeat = np.zeros(len(hashes))
        repeat[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        mean = lambda x: np.bincount(passage, x, minlength=len(out))[has] / n[has]
        length = (end - start).astype(float)
        f = CLASSES * CLASSES
        out[has, f] = np.log1p(n[has]) / 4
        out[has, f + 1] = mean(length) / 10
        out[has, f + 2] = np.sqrt(np.maximum(0, mean(length**2) - mean(length) ** 2)) / 10
        out[has, f + 3] = mean(_first_seen(hashes, passage))
        out[has, f + 4] = mean(_first_seen(two, passage))
        out[has, f + 5] = mean(repeat)
        out[has, f + 6] = mean(_first_seen(three, doc))
        out[has, f + 7] = mean(length > 20)
    return out, first


class Model:
    """encoded = tanh(x W + b); weight = softmax((tanh(encoded V) * sigmoid(encoded U)) w); score = sigmoid(c · Σ weight encoded + d)."""

    def __init__(self, seed: int = 3, constant: float | None = None):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.constant = constant
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)}

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, at, many = self.p, first[:-1], np.diff(first)
        h = np.tanh(np.clip((x - self.mean) * self.scale, -6, 6) @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), many))
        a = e / np.repeat(np.add.reduceat(e, at), many)
        z = np.add.reduceat(h * a[:, None], at)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))}

    def scores(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        return self._forward(x, first)["s"].astype(float)

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
        rng, p = np.random.default_rng(seed), self.p
        self.mean, self.scale = x.mean(0), (1 / (x.std(0) + 0.02)).astype(np.float32)
        m, v, step = {k: 0 * w for k, w in p.items()}, {k: 0 * w for k, w in p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for part in np.array_split(order, max(1, len(y) // 64)):
                many = np.diff(first)[part]
                starts = np.concatenate([[0], np.cumsum(many)])
                rows = np.repeat(first[:-1][part] - starts[:-1], many) + np.arange(starts[-1])
                xs, ys = x[rows], y[part]
                o = self._forward(xs, starts)
                ds = ((o["s"] - ys) / len(ys)).astype(np.float32)
                dz = ds[:, None] * p["c"]
                dz_row = np.repeat(dz, many, axis=0)
                da = (dz_row * o["h"]).sum(1)
                de = o["a"] * (da - np.repeat(np.add.reduceat(da * o["a"], starts[:-1]), many))
                dt, dg = de[:, None] * p["w"] * o["g"], de[:, None] * p["w"] * o["t"]
                dvt, dug = dt * (1 - o["t"] ** 2), dg * o["g"] * (1 - o["g"])
                dh = dz_row * o["a"][:, None] + dvt @ p["V"].T + dug @ p["U"].T
                dpre = dh * (1 - o["h"] ** 2)
                xn = np.clip((xs - self.mean) * self.scale, -6, 6)
                grads = {"W": xn.T @ dpre, "b": dpre.sum(0), "V": o["h"].T @ dvt, "U": o["h"].T @ dug, "w": (o["t"] * o["g"]).T @ de, "c": o["z"].T @ ds, "d": ds.sum(keepdims=True)}
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for k, grad in grads.items():
                    grad = grad + 1e-4 * p[k] * (k not in "bd")
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                    p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: str = "doc_id"):
    """Rows no label is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in in_pieces(batch, 1, PIECE):
            x, first = passages(piece.column(1))
            blobs = [x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(blobs, pa.binary()), piece.column(2)], names=["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """A model from at most ``most`` labelled documents of ``docs`` up to ``TRAIN_BYTES``, the first by a hash of their ids.

    ``labels`` (``doc_id``, ``quality``): null labels are ignored, repeated ones averaged. Held-out ids are never used.
    Without documents of both labels the model scores every text alike: 0 if all labels are 0, else 1.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    ids = short.select("doc_id").distinct().join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = ids.collect()
    if not found or len({r["_y"] for r in found}) < 2:
        return Model(constant=found[0]["_y"] if found else 1.0)
    chosen = docs.sparkSession.createDataFrame(found, ids.schema)
    rows: list[Row] = (
        short.select("doc_id", "text")
        .join(small_side(chosen), "doc_id")
        .select("doc_id", "text", "_y")
        .mapInArrow(_features, "doc_id bigint, x binary, y double")
        .collect()
    )
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    bags = [np.frombuffer(r["x"], np.float16).reshape(-1, WIDTH) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Model().fit(np.concatenate(bags).astype(np.float32), first, np.array([r["y"] for r in rows], np.float32))


def _scores(model: Model, batch: pa.RecordBatch, column: int) -> np.ndarray:
    parts = [model.scores(*passages(piece.column(column))) for piece in in_pieces(batch, column, PIECE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from 0.5 on) for every row of ``docs``.

    Null text counts as empty; a text without words is scored by one passage of zeros. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scores(model, batch, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score ``threshold`` at least."""
    text_batches(docs.sparkSession)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch, column) >= threshold))

    return docs.mapInArrow(run, docs.schema)
