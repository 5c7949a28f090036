"""Token ids as Parquet list columns, written in document order and read back selectively.

The documents are range-partitioned and sorted by id, so the part files in the order of their numbers hold the corpus in
ascending order. Each file has doc_id, offset (ids before the document in its file), n_tokens and tokens; row groups and
pages are small enough that a reader of one document or of the counts alone touches little of a file.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pickflow.llm.common import scratch, small_side, text_batches
from pickflow.llm.wordhash import in_pieces

#: Ids are coded by a dictionary (tokens, counts repeat) or by deltas (doc_id and offset ascend); pages carry an index.
LAYOUT = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false",
}
FILE_SCHEMA = "doc_id bigint, offset bigint, n_tokens bigint, tokens array<int>"
#: Most chunks that a worker remembers if not told otherwise, and the bytes of text it encodes at a time.
CACHE, BATCH = 100_000, 1 << 20
#: Most pieces after a line feed that are remembered.
BARE = 250_000
#: Marks that end a word: runs of them, as long as this at most, are pieces of their own (apostrophes are not).
MARKS, TAIL = ".,;:!?#$%&*+=@^~|)]}>", 4


#: How byte-level tokenizers write bytes as characters; those that print stand for themselves.
_SHOWN = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class ChunkEncoder:
    """Encodes a text by its blank-separated chunks and remembers the ids of each chunk.

    The byte-level pre-tokenizer always splits before a single blank between two other characters that are no white
    space, so such chunks can be encoded apart. A text with any other blank is encoded whole. New chunks are encoded many
    at a time, with line feeds between them, which become ids of their own there.
    """

    def __init__(self, path: str, end_id: int, remember: int = CACHE):
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for runs of letters, which are one piece each: no search for pieces, bytes mapped beforehand
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = WhitespaceSplit()
        self.end = np.array([end_id], "<u4").tobytes()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.content.isalpha() for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens of letters only are not told from words")
        self.special = re.compile("|".join(added) or "(?!)").search
        self.remember = remember
        self.marks: dict[str, bytes] = {}  # runs of marks that end words
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = np.array([self.line], "<u4").tobytes()
        self.known: dict[str, bytes | None] = {}  # chunks after a blank
        self.bare: dict[str, bytes | None] = {}  # pieces after a line feed

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lettered(self, known: dict[str, bytes | None], words: list[str], lead: str) -> None:
        """Remember the ids of words of Latin letters only, after a blank (``lead``) or not, many encoded at a time."""
        lead, gap = lead.replace(" ", _BYTES[0x20]), f" {_BYTES[0x0A]} "
        mapped = [lead + (w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)) for w in words]
        runs = range(0, len(words), 500)
        for i, e in zip(runs, self.letters.encode_batch_fast([gap.join(mapped[i : i + 500]) for i in runs], add_special_tokens=False), strict=True):
            self._cut(known, words[i : i + 500], e.ids)

    def _cut(self, known: dict[str, bytes | None], run: list[str], ids: list[int]) -> None:
        coded = np.array(ids, "<u4")
        cut, raw, at = (4 * np.flatnonzero(coded == self.line)).tolist(), coded.tobytes(), 0
        for c, upto in zip(run, [*cut, len(raw)], strict=True):
            known[c] = raw[at:upto]
            at = upto + 4

    def _joined(self, known: dict[str, bytes | None], pieces: list[str], lead: str) -> None:
        """Remember the ids of pieces without a line feed, many encoded at a time with line feeds between."""
        words, rest = [], []
        for c in pieces:
            (words if c.isalpha() and (c.isascii() or max(c) < "\u0250") else rest).append(c)
        self._lettered(known, words, lead)
        pieces = rest
        runs = [pieces[i : i + 500] for i in range(0, len(pieces), 500)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast(["\n".join([lead + c for c in run]) for run in runs], add_special_tokens=False), strict=True):
            self._cut(known, run, e.ids)

    def _learn(self, new: Iterable[str]) -> None:
        """Remember the ids of each chunk with a blank before it; None for a chunk that may not be encoded apart."""
        plain, alone, marked, lines, known, special, marks = {}, [], [], [], self.known, self.special, self.marks
        for c in new:
            if c.isalpha():
                plain[c] = None
            elif (word := c.rstrip(MARKS)).isalpha() and len(tail := c[len(word) :]) <= TAIL and not special(tail):  # letters and marks are never one piece
                marked.append((c, word, tail))
                if word not in known:
                    plain[word] = None
            elif not c or c[0].isspace() or c[-1].isspace():
                known[c] = None
            elif special(c):
                alone.append(c)
            elif "\n" in c:
                parts = c.split("\n")
                if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
                    lines.append((c, parts))
                else:
                    alone.append(c)
            else:
                plain[c] = None
        known.update(zip(alone, self._ids([" " + c for c in alone]), strict=True))
        self._joined(known, list(plain), " ")
        tails = list({tail for _, _, tail in marked}.difference(marks))
        marks.update(zip(tails, self._ids(tails), strict=True))
        for c, word, tail in marked:
            known[c] = known[word] + marks[tail]
        if lines:  # a single line feed between other characters is a piece of its own
            self._learn({p[0] for _, p in lines}.difference(known))
            self._joined(self.bare, list({x for _, p in lines for x in p[1:]}.difference(self.bare)), "")
            for c, (head, *rest) in lines:
                known[c] = b"".join([known[head], *[y for x in rest for y in (self.feed, self.bare[x])]])

    def _forget(self, known: dict, most: int) -> dict:
        """What was learned first, which is what is frequent."""
        return dict(itertools.islice(known.items(), most // 2)) if len(known) > most else known

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as little-endian unsigned 32-bit integers."""
        self.known, self.bare = self._forget(self.known, self.remember), self._forget(self.bare, min(self.remember, BARE))
        split = [text.split(" ") for text in texts]
        self._learn(set().union(*split).difference(self.known))
        out: list[bytes | None] = []
        heads: dict[str, None] = {}
        for chunks in split:
            head, coded = chunks[0], None
            if len(chunks) == 1 or (head and not head[-1].isspace()):
                try:
                    coded = b"".join(map(self.known.__getitem__, chunks[1:]))
                    heads[head] = None
                except TypeError:  # a chunk that may not be encoded apart: None
                    pass
            out.append(coded)
        first = dict(zip(heads, self._ids(list(heads)), strict=True))
        whole = iter(self._ids([t for t, c in zip(texts, out, strict=True) if c is None]))
        return [(first[chunks[0]] + coded if coded is not None else next(whole)) + self.end for chunks, coded in zip(split, out, strict=True)]


_encoders: dict[tuple[str, int, int], ChunkEncoder] = {}


def _encoder(path: str, end_id: int, remember: int) -> ChunkEncoder:
    """One encoder for all tasks of a worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, end_id, remember) not in _encoders:
        _encoders[path, end_id, remember] = ChunkEncoder(path, end_id, remember)
    return _encoders[path, end_id, remember]


def _encode(path: str, end_id: int, remember: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, offset = _encoder(path, end_id, remember), 0
        for batch in batches:
            for piece in in_pieces(batch, 1, BATCH):
                coded = encoder.encode(piece.column(1).to_pylist())
                counts = np.array([len(c) // 4 for c in coded], np.int64)
                ends = np.cumsum(counts)
                tokens = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(coded), "<i4"))
                )
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(offset + ends - counts), pa.array(counts), tokens],
                    names=["doc_id", "offset", "n_tokens", "tokens"],
                )
                offset += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, layout: dict[str, str] = LAYOUT, remember: int = CACHE) -> None:
    """Encode every text of ``docs`` (``doc_id``, ``text``; null text: empty) and write the ids to ``path``.

    ``tokenizer`` is the file of a byte-level tokenizer, readable where the tasks run. Repeated ids are ordered by a hash
    of the text; null ids come first. Other columns are ignored. An empty table gives a folder with no rows. A worker
    remembers the ids of ``remember`` chunks, some 200 bytes each.
    """
    text_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    (
        docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
        .mapInArrow(_encode(tokenizer, end_id, remember), FILE_SCHEMA)
        .write.options(**layout)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens of the files at ``path``.

    Only the counts are read to place the files one after the other; without ``tokens`` in the projection the ids are not
    read at all.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    numbered = files.select("*", number.alias("_file"))
    totals = numbered.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    bases = totals.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_base"))
    return numbered.join(small_side(bases), "_file").select("doc_id", (F.col("_base") + F.col("offset")).alias("start"), "n_tokens", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 0, remember: int = CACHE) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and return their index, read back from the files."""
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, remember=remember)
    return token_index(docs.sparkSession, path)
