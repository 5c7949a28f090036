"""Document fingerprints: counts of hashed byte triplets, coded by the quartile each bucket falls into, and the length.

Two fingerprints are compared by the distance of their quartile codes and lengths, against the largest distance there is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickflow.llm.ordered import with_successor_rows

BUCKETS = 256
#: Bytes of a window of five that form a triplet with its first byte.
PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: What a difference of the length code may add at most, in steps of a quartile.
LENGTH_CAP = 24

_T = np.random.default_rng(20_24).permuted(np.tile(np.arange(256, dtype=np.uint8), (9, 1)), axis=1)
_STEP = np.array([0, 1, 2, 4], np.int64)  # by how far two quartile codes differ; opposite ends count double


def bucket_counts(data: bytes) -> np.ndarray:
    """Triplets of ``data`` by bucket. Fewer than three bytes have none."""
    b = np.frombuffer(data, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for i, (p, q) in enumerate(PAIRS):
        n = len(b) - q
        if n > 0:
            total += np.bincount(_T[0][b[:n]] ^ _T[i + 1][_T[7][b[p : p + n]]] ^ _T[8][b[q : q + n]], minlength=BUCKETS)
    return total


def fingerprint(data: bytes) -> str:
    """Hexadecimal: one byte for the length (in steps of 10 %), two bits for each bucket's quartile."""
    counts = bucket_counts(data)
    low, mid, high = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > low).astype(np.uint8) + (counts > mid) + (counts > high)
    packed = (code.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    length = min(255, int(np.log(len(data) + 1) / np.log(1.1)))
    return f"{length:02x}{packed.tobytes().hex()}"


def _codes(digest: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return int(raw[0]), ((raw[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).ravel().astype(np.int64)


def likeness(one: str, other: str) -> float:
    """1 for equal fingerprints, 0 for the largest difference."""
    (n, a), (m, b) = _codes(one), _codes(other)
    apart = int(_STEP[np.abs(a - b)].sum()) + min(LENGTH_CAP, abs(n - m))
    return 1.0 - apart / (int(_STEP[3]) * BUCKETS + LENGTH_CAP)


def edited_text(text: str, following: str) -> str:
    """``text`` whose last half (rounded down) is replaced by as many first characters of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # range, doc_id, text, fingerprint of the row whose successor comes next
    for batch in batches:
        out = []
        for doc_id, text, rng, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            same = held is not None and held[0] == rng
            if tail and not same:
                continue  # a second row of those that may follow a range
            mark = fingerprint(text.encode())
            if same:
                edited = edited_text(held[2], text)
                raw = edited.encode()
                changed = fingerprint(raw)
                out.append((held[1], len(held[2]), hashlib.sha256(raw).hexdigest(), held[3], changed, likeness(held[3], changed), likeness(held[3], mark)))
            held = None if tail else (rng, doc_id, text, mark)
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document's.

    The edited text ends in the beginning of the next document by ascending doc_id; the first follows the last. Null text
    counts as empty; its fingerprint, like that of any text under three bytes, has length and zero codes only. Repeated ids
    are ordered by a hash of the text. A single document follows itself. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"))
    return with_successor_rows(rows).select("doc_id", "text", "_range", "_tail").mapInArrow(_compare, SCHEMA)
