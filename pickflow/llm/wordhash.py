"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; the blocks end at white space, so the memory used does not grow with a text.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(7)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _VALUE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, BLOCK + (1 << 16))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse))
    return _powers


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array one after the other, and where each text begins (and the last ends). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, begins: np.ndarray, lower: bool = True, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and for every text where its words begin in these arrays.

    Words never cross texts. ``begins`` has one entry more than there are texts. ``between`` marks the bytes outside words.
    """
    table = _LOWER if lower else _VALUE
    hashes, starts, ends = [], [], []
    at, n = 0, len(data)
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    while at < n:
        upto = min(n, at + BLOCK)
        while upto < n:  # to the next white space or beginning of a text
            piece = slice(upto, min(n, upto + 4096))
            stop = np.flatnonzero(between[data[piece]] | edge[piece])
            upto = upto + int(stop[0]) if len(stop) else piece.stop
            if len(stop):
                break
        part, cuts = data[at:upto], edge[at:upto]
        solid = ~between[part]
        before = np.concatenate([[False], solid[:-1]]) & ~cuts
        start = np.flatnonzero(solid & ~before)
        after = np.concatenate([before[1:] & solid[1:], [False]])
        end = np.flatnonzero(solid & ~after) + 1
        power, inverse = _powers_to(len(part) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * power[: len(part)])])
        hashes.append(mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
        starts.append(start + at)
        ends.append(end + at)
        at = upto
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    start = join(starts, np.int64)
    return join(hashes, np.uint64), start, join(ends, np.int64), np.searchsorted(start, begins)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of the whole sequence if it is shorter, none without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total += hashes[i : n - width + 1 + i] * _PLACE[i]
    return mixed(total)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles."""
    data, begins = as_bytes(texts)
    hashes, _, _, at = words(data, begins)
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield np.unique(shingles(hashes[a:b], width))


def in_pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows whose texts have about ``most`` bytes."""
    sizes = np.diff(as_bytes(batch.column(column))[1])
    piece = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
