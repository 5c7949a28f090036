"""Removal of every byte covered by a string of a stated length that also starts earlier in the corpus.

Winnowing with grouping by hash, in place of prefix doubling: there are no pairs of ranks, no growing offsets and no sorts.
The positions grouped first are anchors: of each window of the stated length the place of its smallest hashed gram, about
one position in 35. Equal windows have equal anchors at the same place.

1. Anchors are ranked by their gram. Unique ones are dropped, with all windows around them.
2. The others are ranked by the longer string that all their windows cover. Of equal ones all but the first go, whole.
3. Where a gram goes on in different strings, the windows of the first of each are ranked by their whole length.

A rank is a hash of 64 bits, beside the hash that deals it to a task. Equal ranks of one task's input are reduced to their
first position before the shuffle, so a string that is everywhere meets once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickflow.llm.common import stored
from pickflow.llm.wordhash import _VALUE, _powers_to, as_bytes, in_pieces, mixed

#: Bytes of a string that is removed, and of the gram that picks an anchor.
LENGTH, GRAM = 100, 32
#: Bytes that a task works on at a time; longer texts are cut into overlapping segments. Anchors of a bucket.
SEGMENT, BUCKET_ROWS = 1 << 20, 1_000_000
#: Most spans that are broadcast.
SPANS = 2_000_000
_LOW = np.uint64((1 << 28) - 1)
_OTHER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BIG = np.int64(1) << np.int64(40)


def _sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    power, _ = _powers_to(len(data) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * power[: len(data)])])


def _hash(sums: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of the strings from begin to end, wherever they stand."""
    return mixed((sums[end] - sums[begin]) * _powers_to(len(sums))[1][: len(sums)][begin])


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers begin[i] .. begin[i] + count[i] - 1, one range after the other."""
    total = int(count.sum())
    return np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total) if total else np.zeros(0, np.int64)


def merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same row that overlap or touch, as one; sorted."""
    if not len(row):
        return row, begin, end
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    which = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]])).astype(np.int64) * _BIG
    upto = np.maximum.accumulate(end + which)
    first = np.flatnonzero(np.concatenate([[True], begin[1:] + which[1:] > upto[:-1]]))
    last = np.concatenate([first[1:], [len(row)]]) - 1
    return row[first], begin[first], upto[last] - which[last]


def segments(texts: pa.Array, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several texts, where each begins (and the last ends), its row and how many bytes of the text went before."""
    data, begins = as_bytes(texts)
    size = np.diff(begins)
    at = 0
    while at < len(size):
        if size[at] > SEGMENT:
            for part in range(0, int(size[at]) - LENGTH + 1, SEGMENT):
                one = data[begins[at] + part : min(begins[at + 1], begins[at] + part + SEGMENT + LENGTH - 1)]
                yield one, np.array([0, len(one)]), rows[at : at + 1], np.array([part])
            at += 1
            continue
        upto = at + 1
        while upto < len(size) and begins[upto + 1] - begins[at] <= SEGMENT:
            upto += 1
        yield data[begins[at] : begins[upto]], begins[at : upto + 1] - begins[at], rows[at:upto], np.zeros(upto - at, np.int64)
        at = upto


def anchor_runs(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same anchor: text, first and last window, hash of the gram, of all bytes covered, and to deal by."""
    n, width = len(data), LENGTH - GRAM + 1
    count = np.maximum(0, np.diff(begins) - LENGTH + 1)
    q = _ranges(begins[:-1], count)
    if not len(q):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    sums = _sums(data, _VALUE)
    gram = _hash(sums, slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    key = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)  # the first of equal grams
    blocks = np.full(-(-len(key) // width) * width, ~np.uint64(0), np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[q], ahead[q + width - 1]) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(count)), count)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(q)]]) - 1
    lo, hi, a = q[first], q[last], anchor[first]
    shape = ((a - lo) * 128 + (a - hi)).astype(np.uint64)
    return text[first], lo, hi, gram[a], mixed(_hash(sums, lo, hi + LENGTH) + shape), mixed(gram[a] ^ np.uint64(0x5851F42D4C957F2D))


def _rows(kind: int, to: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """One row per bucket with the bytes of each column."""
    order = np.argsort(to, kind="stable")
    ranked = to[order]
    cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(to) else np.zeros(0, np.int64)
    ends = [*cut[1:].tolist(), len(to)]
    columns = tuple(c[order] for c in columns)
    return [(int(ranked[a]), kind, *(c[a:b].tobytes() for c in columns), *[None] * (4 - len(columns))) for a, b in zip(cut.tolist(), ends, strict=False)]


_BLOBS = "bucket bigint, kind int, a binary, b binary, c binary, d binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "kind", "a", "b", "c", "d"])


def _dealt(buckets: int, kind: int, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple]:
    """Spans that are decided, handed on in a bucket by row."""
    row, begin, end = merged(row, begin, end)
    return _rows(kind, (mixed(row.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), row, begin, end)


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """True where any of the sorted columns changes."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _anchors(buckets: int):
    """Kind 0: spans to remove. 1: windows to rank by whole length. 2: runs by gram (rank, longer rank, row, place); the place
    holds the first window, the number of windows and whether the gram is known to go on in different ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 1):
                for data, begins, rows, before in segments(piece.column(1), piece.column(0).to_numpy()):
                    text, lo, hi, rank, longer, deal = anchor_runs(data, begins)
                    row, at = rows[text], lo - begins[:-1][text] + before[text]
                    order = np.lexsort((at, row, longer, rank))
                    row, at, n, rank, longer, deal = row[order], at[order], (hi - lo + 1)[order], rank[order], longer[order], deal[order]
                    first = _first_of(rank, longer)
                    again = ~first
                    out = _dealt(buckets, 0, row[again], at[again], (at + n + LENGTH - 1)[again])
                    row, at, n, rank, longer, deal = (x[first] for x in (row, at, n, rank, longer, deal))
                    gram = np.cumsum(_first_of(rank)) - 1
                    many = np.bincount(gram)[gram] > 1 if len(gram) else np.zeros(0, bool)
                    out += _dealt(buckets, 1, row[many], at[many], (at + n)[many])
                    send = _first_of(rank)
                    place = (at << np.int64(8)) | (n << np.int64(1)) | many
                    out += _rows(2, (deal % np.uint64(buckets)).astype(np.int64)[send], *(x[send] for x in (rank, longer, row, place)))
                    if out:
                        yield _batch(out)

    return run


def _read(t: pa.Table, kind: int, *types: type) -> list[np.ndarray]:
    some = t.filter(pc.equal(t["kind"], kind))
    return [np.frombuffer(b"".join(some[c].to_pylist()), k) for c, k in zip("abcd", types, strict=False)]


_FOUND = "kind int, row bigint, begin bigint, end bigint"


def _spans(parts: list[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> pa.Table:
    columns = [np.concatenate([np.full(len(s[0]), k, np.int32) for k, s in parts]), *(np.concatenate([s[i] for _, s in parts]) for i in range(3))]
    return pa.table(dict(zip(("kind", "row", "begin", "end"), map(pa.array, columns), strict=True)))


def _meet_anchors(t: pa.Table) -> pa.Table:
    """Of a bucket: spans to remove (0) and windows to rank by whole length (1)."""
    rank, longer, row, place = _read(t, 2, np.uint64, np.uint64, np.int64, np.int64)
    order = np.lexsort((place, row, longer, rank))
    rank, longer, row, place = rank[order], longer[order], row[order], place[order]
    at, n, known = place >> 8, (place >> 1) & 127, (place & 1).astype(bool)
    first = _first_of(rank, longer)
    again = ~first & ~known
    gram = np.cumsum(_first_of(rank)) - 1
    ways = np.bincount(gram, first) + np.bincount(gram, known) if len(gram) else np.zeros(0)
    open_ = first & ~known & (ways[gram] > 1 if len(gram) else np.zeros(0, bool))
    decided = [(k, tuple(_read(t, k, np.int64, np.int64, np.int64))) for k in (0, 1)]
    return _spans([*decided, (0, merged(row[again], at[again], (at + n + LENGTH - 1)[again])), (1, merged(row[open_], at[open_], (at + n)[open_]))])


def _windows(buckets: int):
    """Rows of text and spans of windows: kind 0: spans to remove; 2: windows by their hash (rank, row, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 1):
                lists = piece.column(2)
                owner = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
                spans = lists.flatten()
                which, begin, end = merged(owner, spans.field("begin").to_numpy(), spans.field("end").to_numpy())
                for data, begins, rows, before in segments(piece.column(1), np.arange(piece.num_rows)):
                    # the windows of these texts that begin in this segment
                    place = np.full(piece.num_rows, -1)
                    place[rows] = np.arange(len(rows))
                    text = place[which]
                    some = text >= 0
                    text, b, e = text[some], begin[some], end[some]
                    b = np.maximum(b, before[text])
                    e = np.minimum(e, before[text] + np.diff(begins)[text] - LENGTH + 1)
                    count = np.maximum(0, e - b)
                    at = _ranges(b, count)
                    text = np.repeat(text, count)
                    q = at - before[text] + begins[:-1][text]
                    rank, deal = (_hash(_sums(data, v), q, q + LENGTH) for v in (_VALUE, _OTHER))
                    row = piece.column(0).to_numpy()[rows][text]
                    order = np.lexsort((at, row, rank))
                    row, at, rank, deal = row[order], at[order], rank[order], deal[order]
                    first = _first_of(rank)
                    out = _dealt(buckets, 0, row[~first], at[~first], at[~first] + LENGTH)
                    out += _rows(2, (deal % np.uint64(buckets)).astype(np.int64)[first], rank[first], row[first], at[first])
                    if out:
                        yield _batch(out)

    return run


def _meet_windows(t: pa.Table) -> pa.Table:
    rank, row, at = _read(t, 2, np.uint64, np.int64, np.int64)
    order = np.lexsort((at, row, rank))
    rank, row, at = rank[order], row[order], at[order]
    again = ~_first_of(rank)
    return _spans([(0, tuple(_read(t, 0, np.int64, np.int64, np.int64))), (0, merged(row[again], at[again], at[again] + LENGTH))])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of spans per row, merged."""
    for batch in batches:
        lists = batch.column(1)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        spans = lists.flatten()
        which, begin, end = merged(owner, spans.field("begin").to_numpy(), spans.field("end").to_numpy())
        offsets = np.searchsorted(which, np.arange(batch.num_rows + 1)).astype(np.int32)
        values = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["begin", "end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["row", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, at, kept = (text or "").encode(), 0, hashlib.sha256()
            for s in spans or []:
                kept.update(raw[at : s["begin"]])
                at = s["end"]
            kept.update(raw[at:])
            out.append((len(raw), sum(s["end"] - s["begin"] for s in spans or []), len(spans or []), kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _spans_by_row(found: DataFrame, name: str) -> DataFrame:
    """row, spans: merged lists; with a broadcast hint if all spans together are few."""
    lists = found.groupBy("row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    lists = stored(lists.mapInArrow(_gather, "row bigint, spans array<struct<begin:bigint,end:bigint>>"), name)
    return F.broadcast(lists) if (lists.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= SPANS else lists


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, row: a number that ascends with the id and is unique. Only where ids repeat or are null it is not the id."""
    rows = docs.select("doc_id", "text")
    if not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return rows.withColumn("row", F.col("doc_id"))
    tie = F.xxhash64("text")
    return stored(rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie).withColumn("row", F.monotonically_increasing_id()), "rows")


def removed_spans(docs: DataFrame) -> DataFrame:
    """row, spans: the maximal runs of removed bytes of each row of ``docs`` (row, text) that has any."""
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where(F.octet_length("text") >= LENGTH).select("row", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(4 * shuffles, total // (35 * BUCKET_ROWS)))
    met = texts.mapInArrow(_anchors(buckets), _BLOBS).groupBy("bucket").applyInArrow(_meet_anchors, _FOUND)
    found = stored(met, "anchors")
    open_ = _spans_by_row(found.where("kind = 1"), "windows")
    windows = texts.join(open_, "row").select("row", "text", "spans").mapInArrow(_windows(buckets), _BLOBS)
    more = stored(windows.groupBy("bucket").applyInArrow(_meet_windows, _FOUND), "repeats")
    return _spans_by_row(found.where("kind = 0").unionAll(more), "spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte of the UTF-8 text goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a smaller doc_id,
    or earlier in the same text. Strings are judged on the input and never cross documents. Null text counts as empty. Null
    ids come first; rows that share an id follow each other by a hash of their text, each a document of its own. Other
    columns are ignored.
    """
    rows = _ordered(docs)
    return rows.join(removed_spans(rows), "row", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
