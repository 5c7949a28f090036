"""Ranked lexical search: the highest-scoring documents of every query, by best-first search over document intervals.

Documents are indexed in shards of some thousands. A shard holds, for each term, its postings in document order with
their impacts (what the term adds to a document's score) and a sparse table that answers where the largest impact of a
range of postings is. A query starts with the whole shard as one interval. The interval with the highest bound, the sum of
the largest impacts of the query's terms in it, is taken and split at the document of maximum impact, which is scored; both
rests are bounded anew by range maxima. Short intervals are scored document by document. When the highest bound is below
the score of the last document kept, no other document can enter, and the shard is done. The documents kept are carried
from shard to shard of a task, so later shards start with a high floor.

Scores are integers and exact. Only terms that a query asks for are indexed; counts are over all terms of all documents.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pickflow.llm.common import stored
from pickflow.llm.wordhash import as_bytes, in_pieces, words

#: Results per query, documents of a shard, documents of an interval that is scored without further splits.
TOP, SHARD, LEAF = 10, 8192, 64
#: Bytes of query texts that are searched together; more are searched in several passes.
QUERY_BYTES = 1 << 20

#: Bytes outside terms: ASCII other than digits and letters. Fixed by the contract.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _BETWEEN[ord(_first) : ord(_last) + 1] = False
_MAX = np.iinfo(np.int64).max


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of several texts, one after the other, and where those of each text begin (and the last end)."""
    data, begins = as_bytes(texts)
    hashes, _, _, at = words(data, begins, between=_BETWEEN)
    return hashes, at


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What ``tf`` occurrences in a document of ``n`` terms add to its score."""
    if 75 * int(n.max(initial=0)) * n_docs <= _MAX:
        m = 25 + (75 * n * n_docs) // n_terms
    else:  # the product needs more than 64 bits
        m = np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Best:
    """The documents kept for a query: highest score first, equal scores by id, null ids last."""

    def __init__(self, size: int = TOP):
        self.size, self.rows = size, []
        self.floor = 1

    def offer(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        some = score >= self.floor
        if not some.any():
            return
        score, ids, known = score[some], ids[some], known[some]
        some = np.lexsort((ids, ~known, -score))[: self.size]
        self.rows += zip((-score[some]).tolist(), (~known[some]).tolist(), ids[some].tolist(), strict=True)
        self.rows = sorted(self.rows)[: self.size]
        if len(self.rows) == self.size:
            self.floor = -self.rows[-1][0]


class Shard:
    """Postings of some documents with their range-maximum tables. ``term`` and ``tf`` are those of the documents in turn."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, counts: np.ndarray, term: np.ndarray, impact: np.ndarray):
        docs = len(ids)
        self.width = docs + 1
        # Documents with the same main term lie together: bounds of short intervals are closer to the scores in them.
        owner = np.repeat(np.arange(docs), counts)
        main = np.zeros(docs, np.int64)
        heavy = np.lexsort((impact, owner))
        last = np.flatnonzero(np.append(owner[heavy][1:] != owner[heavy][:-1], True)) if len(heavy) else heavy
        main[owner[heavy][last]] = term[heavy][last]
        order = np.argsort(main, kind="stable")
        place = np.empty(docs, np.int64)
        place[order] = np.arange(docs)
        self.ids, self.known = ids[order], known[order]
        key = term.astype(np.int64) * self.width + place[owner]
        by = np.argsort(key, kind="stable")
        self.key, self.impact = key[by], impact[by]
        self.place = self.key % self.width
        size = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(self.key // self.width) > 0, [True]]))) if len(by) else np.zeros(0, np.int64)
        self.tables = [np.arange(len(by), dtype=np.int32)]
        while (1 << len(self.tables)) <= size.max(initial=0):
            half = 1 << (len(self.tables) - 1)
            a, b = self.tables[-1][:-half], self.tables[-1][half:]
            self.tables.append(np.where(self.impact[a] >= self.impact[b], a, b))

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For ranges of postings, none empty, the posting of the largest impact."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            some = level == k
            a, b = self.tables[k][lo[some]], self.tables[k][hi[some] - (1 << k)]
            out[some] = np.where(self.impact[a] >= self.impact[b], a, b)
        return out

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> int:
        """Offer ``best`` every document that may belong to it; the number of documents scored."""
        scored, made = 0, 0
        heap: list[tuple] = []

        def add(a: int, b: int, terms: np.ndarray, times: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            nonlocal made
            some = hi > lo
            if not some.all():
                terms, times, lo, hi = terms[some], times[some], lo[some], hi[some]
            if not len(terms):
                return
            at = self.largest(lo, hi)
            parts = self.impact[at] * times
            bound = int(parts.sum())
            if bound >= best.floor:
                made += 1
                heapq.heappush(heap, (-bound, made, a, b, terms, times, lo, hi, int(self.place[at[parts.argmax()]])))

        base = terms * self.width
        add(0, len(self.ids), terms, times, np.searchsorted(self.key, base), np.searchsorted(self.key, base + self.width))
        while heap and -heap[0][0] >= best.floor:
            _, _, a, b, terms, times, lo, hi, split = heapq.heappop(heap)
            if b - a <= LEAF:
                total = np.zeros(b - a, np.int64)
                count = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                np.add.at(total, self.place[at] - a, self.impact[at] * np.repeat(times, count))
                best.offer(total, self.ids[a:b], self.known[a:b])
                scored += b - a
                continue
            cut = np.searchsorted(self.key, terms * self.width + split)
            here = cut < hi
            here[here] = self.place[cut[here]] == split
            best.offer(np.array([(self.impact[cut[here]] * times[here]).sum()]), self.ids[split : split + 1], self.known[split : split + 1])
            scored += 1
            for x, y, i, j in ((a, split, lo, cut), (split + 1, b, cut + here, hi)):
                if 4 * (y - x) <= 3 * (b - a):
                    add(x, y, terms, times, i, j)
                else:  # the split was near an end: halve the long rest, so that intervals always get shorter
                    half = np.searchsorted(self.key, terms * self.width + (x + y) // 2)
                    add(x, (x + y) // 2, terms, times, i, half)
                    add((x + y) // 2, y, terms, times, half, j)
        return scored


#: A document's asked terms with their counts; or, with ``docs`` set, of a piece of input how many documents have terms, all
#: their terms together (n), and in how many documents each asked term is.
POSTINGS = "doc_id bigint, n bigint, terms array<int>, tf array<int>, docs bigint"


def _postings(asked: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = asked.value
        for batch in batches:
            for piece in in_pieces(batch, 1):
                hashes, at = text_terms(piece.column(1))
                n = np.diff(at)
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                pair = np.repeat(np.arange(len(n)), n)[hit] * max(1, len(known)) + place[hit]
                pair, tf = np.unique(pair, return_counts=True)
                row, term = pair // max(1, len(known)), pair % max(1, len(known))
                rows, count = np.unique(row, return_counts=True)
                term_, df = np.unique(term, return_counts=True)
                offsets = np.concatenate([[0], np.cumsum(count), [len(row) + len(term_)]]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x).astype(np.int32))) for x in ((term, term_), (tf, df))]
                columns = [
                    pa.concat_arrays([piece.column(0).take(pa.array(rows)), pa.array([None], piece.column(0).type)]).cast(pa.int64()),
                    pa.array(np.append(n[rows], n.sum()).astype(np.int64)),
                    *lists,
                    pa.array([*[None] * len(rows), int((n > 0).sum())], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tf", "docs"])

    return run


def _search(queries: Broadcast, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search the postings of a task for all queries of a pass: (q, doc_id, score) of the documents kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight, n_docs, n_terms = queries.value
        kept = {q: Best(size) for q, _, _ in asked}
        for batch in batches:
            pieces = -(-batch.num_rows // SHARD)
            for i in range(pieces):
                part = batch.slice(i * batch.num_rows // pieces, (i + 1) * batch.num_rows // pieces - i * batch.num_rows // pieces)
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy()
                counts = np.diff(part.column(2).offsets.to_numpy())
                term, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                value = impacts(weight[term], tf, np.repeat(part.column(1).to_numpy(), counts), n_docs, n_terms)
                shard = Shard(ids, known, counts, term, value)
                for q, terms, times in asked:
                    shard.search(terms, times, kept[q])
        out = [(q, None if null else i, -s) for q, best in kept.items() for s, null, i in best.rows]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "doc_id", "score"])

    return run


def _pass(docs: DataFrame, queries: list, size: int) -> DataFrame:
    """(q, doc_id, score) for some queries (q, text): the highest of every task that reads the index."""
    spark = docs.sparkSession
    hashes, at = text_terms(pa.array([t for _, t in queries], pa.string()))
    terms = np.unique(hashes)
    index = stored(docs.select("doc_id", "text").mapInArrow(_postings(spark.sparkContext.broadcast(terms)), POSTINGS), "postings")
    pieces = index.where("docs is not null")
    n_docs, n_terms = (int(x or 0) for x in pieces.agg(F.sum("docs"), F.sum("n")).first())
    df = np.zeros(len(terms), np.int64)
    for row in pieces.select(F.explode(F.arrays_zip("terms", "tf")).alias("x")).groupBy("x.terms").agg(F.sum("x.tf").alias("df")).toLocalIterator():
        df[row["terms"]] = row["df"]
    weight = weights(df, n_docs)
    asked = []
    for (q, _), a, b in zip(queries, at[:-1], at[1:], strict=True):
        own, times = np.unique(np.searchsorted(terms, hashes[a:b]), return_counts=True)
        some = weight[own] > 0  # a term of weight 0 adds nothing
        asked.append((q, own[some], times[some]))
    given = spark.sparkContext.broadcast((asked, weight, n_docs, n_terms))
    return index.where("docs is null").select("doc_id", "n", "terms", "tf").mapInArrow(_search(given, size), "q bigint, doc_id bigint, score bigint")


def best_documents(docs: DataFrame, items: DataFrame, *, size: int = TOP) -> DataFrame:
    """Per query of ``items`` (item_id, text) its ``size`` highest-scoring documents: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and all other characters beyond ASCII, A-Z lower-cased; null has none. Equal
    scores rank by doc_id, null ids last; rows that share a doc_id are documents of their own. Equal items are searched once;
    rows that share an item_id with different texts are queries of their own, each with ranks from 1. Items without a term,
    or whose terms no document has, have no rows. Other columns are ignored. Terms are compared by 64-bit hashes.

    The texts of queries reach the driver, ``QUERY_BYTES`` at a time; each time is one pass over the documents.
    """
    spark = docs.sparkSession
    numbered = stored(items.select("item_id", "text").where("text is not null").distinct().withColumn("q", F.monotonically_increasing_id()), "queries")
    total = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-total // QUERY_BYTES))
    found = None
    for k in range(passes):
        queries = [(r["q"], r["text"]) for r in numbered.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == k).select("q", "text").collect()]
        if queries:
            some = _pass(docs, queries, size)
            found = some if found is None else found.unionAll(some)
    if found is None:
        found = spark.createDataFrame([], "q bigint, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= size)
    return ranked.join(numbered.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


RANK_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents
), total AS (
    SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0
), q AS (
    SELECT row_number() OVER () AS q, item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), asked AS (
    SELECT q, term, count(*)::BIGINT AS times FROM (SELECT q, unnest(t) AS term FROM q) GROUP BY q, term
), postings AS (
    SELECT r, doc_id, n, term, count(*)::BIGINT AS tf
    FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d)
    WHERE term IN (SELECT term FROM asked) GROUP BY r, doc_id, n, term
), weighted AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), total
), scored AS (
    SELECT q, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weighted USING (term), total GROUP BY q, r, doc_id
), ranked AS (
    SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN q USING (q) WHERE rank <= 10
"""
