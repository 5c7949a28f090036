"""Exact self-join of texts by the Jaccard similarity of their word shingles, with parity sketches.

Tokens (shingle hashes) are dealt into parts by their leading bits, and the tokens of a part are XOR-ed. Two sets whose
symmetric difference is D differ in at most D parts, so with more than D parts in use they agree in one that is not empty
(pigeonhole). Sets are joined on such parts within bands of size, each set offering as many of its parts, in an order that
is the same for all sets, as the largest D of its size needs; pairs that meet are verified. A shorter sketch, one bit per
token flipped, bounds D from below and drops pairs before the exact comparison.

Equal sets are joined once. Parts that many sets share, as common passages do, come last in the order. A key that still
has many sets is reduced to its smallest id before the shuffle; pairs with that id are verified first. Where a key still spans several components, nearest pairs are verified round by round, and in the
end all pairs between components, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickflow.llm.common import small_side, stored, text_batches
from pickflow.llm.graph import components
from pickflow.llm.wordhash import in_pieces, mixed, shingle_sets

#: Largest set of the first band, its parts (as a power of two); each band has four times both.
FIRST, PARTS = 1536, 10
#: Bits of the sketch that bounds the difference.
BITS = 2048
#: Most keys that are known to be shared by many sets, and how often a key is seen in one piece of input to be counted as such.
HOT_KEYS, HOT_SEEN = 100_000, 4
#: Sets of a key that are compared in one block with those of another, and keys in a bucket.
BLOCK, BUCKET_KEYS = 1000, 1_500_000
_SEED = np.uint64(0xA0761D6478BD642F)


def sketch(tokens: np.ndarray, bits: int = BITS) -> bytes:
    """Each token flips one bit. The Hamming distance of two sketches is at most the symmetric difference of the sets."""
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def wide_sketch(tokens: np.ndarray) -> bytes | None:
    """A sketch that grows with the set, for sets beyond the first band, where ``BITS`` bits are about half ones."""
    bits, n = BITS, FIRST
    while len(tokens) > n:
        bits, n = 4 * bits, 4 * n
    return sketch(tokens, bits) if bits > BITS else None


def apart(one: bytes, other: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded to the bits of the shorter."""
    a, b = (np.frombuffer(x, np.uint8) for x in (one, other))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, min(len(a), len(b))), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def largest_difference(n: int, m: int) -> int:
    """Of two sets of sizes n and m with a similarity of 0.75 or more: 100 i >= 75 u gives 7 (u - i) <= n + m."""
    return (n + m) // 7


def dealings(tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each dealing that a set offers parts of: digests of its parts in use, 56 bits, and the tokens in each.

    One dealing for the band of the set, and one for the next if a similar set may be there. If no more parts are in use
    than the largest difference, which random hashes make rare, another dealing follows, until more are: a pair is found
    wherever one of the two has more, and two that have not both go on to the next dealing.
    """
    n, band = len(tokens), 0
    while n > FIRST << 2 * band:
        band += 1
    for b in (band, band + 1) if 4 * n // 3 > FIRST << 2 * band else (band,):
        seed = 0
        while True:
            t = tokens if not seed else np.sort(mixed(tokens ^ (_SEED * np.uint64(seed))))
            part = t >> np.uint64(64 - PARTS - 2 * b)
            begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            digest = mixed(np.bitwise_xor.reduceat(mixed(t + _SEED), begin) + part[begin] + np.uint64((b << 8) + seed << 40))
            yield digest >> np.uint64(8), np.diff(np.append(begin, n))
            if len(begin) > largest_difference(n, 4 * n // 3):
                break
            seed += 1


def part_keys(tokens: np.ndarray, hot: np.ndarray | None = None) -> np.ndarray:
    """The keys under which a set looks for similar ones: the first D + 1 of each dealing, D being its largest difference.

    Which come first is the same for all sets: those not in ``hot`` (sorted digests), then those of more tokens, then by
    digest. Any such order finds all pairs; this one keeps passages that many texts share out of the keys.
    """
    most, out = largest_difference(len(tokens), 4 * len(tokens) // 3), []
    for digest, count in dealings(tokens):
        late = np.uint64(127) - np.minimum(count, 127).astype(np.uint64)
        if hot is not None and len(hot):
            late |= (hot[np.minimum(np.searchsorted(hot, digest), len(hot) - 1)] == digest).astype(np.uint64) << np.uint64(7)
        key = late << np.uint64(56) | digest
        out.append(np.partition(key, most)[: most + 1] if len(key) > most + 1 else key)
    return np.concatenate(out)


PROFILE = "doc_id bigint, n bigint, hi bigint, lo bigint, sketch binary, wide binary, keys array<bigint>, seen array<bigint>"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; and for each piece of input a row of size -1 with the keys seen often in it."""
    lists = pa.list_(pa.int64())
    for batch in batches:
        for piece in in_pieces(batch, 1):
            n, hi, lo, sk, wide, parts = [], [], [], [], [], [np.zeros(0, np.uint64)]
            for s in shingle_sets(piece.column(1)):
                n.append(len(s))
                hi.append(np.bitwise_xor.reduce(s).astype(np.int64) if len(s) else 0)
                lo.append(mixed(s + _SEED).sum(dtype=np.uint64).astype(np.int64) if len(s) else 0)
                sk.append(sketch(s))
                wide.append(wide_sketch(s))
                if len(s):
                    parts += [digest for digest, _ in dealings(s)]
            keys, seen = np.unique(np.concatenate(parts), return_counts=True)
            often = seen >= HOT_SEEN
            none = [None] * len(n)
            columns = (
                pa.concat_arrays([piece.column(0), pa.array([None], piece.column(0).type)]),
                pa.array([*n, -1], pa.int64()),
                pa.array([*hi, None], pa.int64()),
                pa.array([*lo, None], pa.int64()),
                pa.array([*sk, None], pa.binary()),
                pa.array([*wide, None], pa.binary()),
                pa.array([*none, keys[often].astype(np.int64)], lists),
                pa.array([*none, seen[often]], lists),
            )
            yield pa.RecordBatch.from_arrays(list(columns), names=[f.split()[0] for f in PROFILE.split(", ")])


def _groups(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys and ids, and for each entry the place of the first (smallest id) of its key."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return keys, ids, np.flatnonzero(new)[np.cumsum(new) - 1] if len(keys) else np.zeros(0, np.int64)


def _offer(buckets: int, hot: Broadcast):
    """Rows of a bucket: keys and the smallest id of each in this piece; and, spread evenly, the pairs (key, smallest id, other id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, 1):
                keys = [part_keys(s, hot.value) if len(s) else np.zeros(0, np.uint64) for s in shingle_sets(piece.column(1))]
                ids = np.repeat(piece.column(0).to_numpy(), [len(k) for k in keys])
                keys, ids, first = _groups(np.concatenate(keys), ids)
                lead = first == np.arange(len(keys))
                rest = ~lead & (ids != ids[first])
                to = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
                rows: list[tuple[int, bytes, bytes, bytes | None]] = []
                for chosen, others in ((lead, None), (rest, ids[first])):
                    at = np.flatnonzero(chosen)
                    at = at[np.argsort(to[at], kind="stable")]
                    cut = np.flatnonzero(np.concatenate([[True], np.diff(to[at]) > 0])).tolist() if len(at) else [0]
                    for a, b in zip(cut, [*cut[1:], len(at)], strict=True):
                        some = at[a:b]
                        if not len(some):
                            continue
                        rows.append((int(to[some[0]]), keys[some].tobytes(), ids[some].tobytes(), None if others is None else others[some].tobytes()))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "keys", "ids", "leads"])

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """The pairs (key, smallest id, other id) of a bucket."""
    read = lambda name, kind, keep: np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x, k in zip(rows[name].to_pylist(), keep, strict=True) if k]])
    own = [x is None for x in rows["leads"].to_pylist()]
    done = [not x for x in own]
    keys, ids, first = _groups(read("keys", np.uint64, own), read("ids", np.int64, own))
    rest = ids != ids[first] if len(ids) else np.zeros(0, bool)
    key = np.concatenate([keys[rest], read("keys", np.uint64, done)])
    u = np.concatenate([ids[first][rest] if len(ids) else ids, read("leads", np.int64, done)])
    v = np.concatenate([ids[rest], read("ids", np.int64, done)])
    order = np.lexsort((v, u))
    return pa.table({"key": pa.array(key[order].astype(np.int64)), "u": pa.array(u[order]), "v": pa.array(v[order])})


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop pairs whose sizes or sketches are too far apart."""
    for batch in batches:
        n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (3, 5))
        near = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= (n + m) // 7
        near &= 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
        for i in np.flatnonzero(near & (np.minimum(n, m) > FIRST)).tolist():
            near[i] = apart(batch.column(6)[i].as_py(), batch.column(7)[i].as_py()) <= (n[i] + m[i]) // 7
        keep = pa.array(near)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in in_pieces(batch, 1):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.tobytes() for s in shingle_sets(piece.column(1))], pa.binary())], names=["id", "tokens"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.sort(np.concatenate([a, b]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= 75 * (len(a) + len(b) - common))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def _nearest(ids: np.ndarray, p: np.ndarray, q: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of near pairs, for each of both its nearest partner; ties: the smallest id."""
    a, b, d = np.concatenate([p, q]), np.concatenate([q, p]), np.concatenate([distance, distance])
    order = np.lexsort((ids[b], d, a))
    a, b = a[order], b[order]
    first = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
    return a[first], b[first]


def _block_pairs(t: pa.Table, cuts: list[tuple[int, int]], nearest: bool) -> np.ndarray:
    """Pairs of ids, each once, from groups of rows: different components, sizes and sketches that allow a link."""
    ids, block, comp, n, i, j = (t[c].to_numpy() for c in ("id", "block", "component", "n", "i", "j"))
    bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
    found = [np.zeros((0, 2), np.int64)]
    for a, b in cuts:
        rows = np.arange(a, b)
        left, right = (rows[block[a:b] == i[a]], rows[block[a:b] == j[a]]) if i[a] != j[a] else (rows, rows)
        parts = []
        for at in range(0, len(left), 64):
            x, y = left[at : at + 64, None], right[None, :]
            ok = (ids[x] < ids[y]) if i[a] == j[a] else ids[x] != ids[y]
            ok &= (comp[x] != comp[y]) & (4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y]))
            p, q = np.nonzero(ok)
            p, q = left[at + p], right[q]
            distance = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64)
            near = distance <= (n[p] + n[q]) // 7
            parts.append((p[near], q[near], distance[near]))
        p, q, distance = (np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        if nearest:
            p, q = _nearest(ids, p, q, distance)
        one, two = ids[p], ids[q]
        found.append(np.stack([np.minimum(one, two), np.maximum(one, two)], 1))
    return np.unique(np.concatenate(found), axis=0)


def _blocks(nearest: bool):
    """Rows (key, i, j, id, block, component, n, sketch), sorted by the first three: near pairs between blocks i and j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            key = np.stack([t[c].to_numpy() for c in ("key", "i", "j")])
            cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])).tolist() if t.num_rows else []
            cuts = list(zip(cut, [*cut[1:], t.num_rows], strict=True))
            out = _block_pairs(t, cuts if last else cuts[:-1], nearest)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"]), None if last or not cut else t.slice(cut[-1])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            out, held = done(t if held is None else pa.concat_tables([held, t]).combine_chunks(), last=False)
            yield out
        if held is not None:
            yield done(held, last=True)[0]

    return run


class ParityJoin:
    """The steps of the join over ``docs`` (``doc_id``, ``text``), with what they share."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        text_batches(self.spark)
        self.rows = docs.select("doc_id", "text")
        made = stored(self.rows.mapInArrow(_profile, PROFILE), "sets")
        self.profiles = made.where("n >= 0").drop("keys", "seen")
        often = made.where("n < 0").select(F.explode(F.arrays_zip("keys", "seen")).alias("k")).groupBy("k.keys").agg(F.sum("k.seen").alias("seen"))
        hot = [r["keys"] for r in often.orderBy(F.desc("seen"), "keys").limit(HOT_KEYS).collect()]
        self.hot = self.spark.sparkContext.broadcast(np.sort(np.array(hot, np.uint64)))
        some = self.profiles.where("n > 0 and doc_id is not null")
        self.classes = stored(some.groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes", many := made.count())
        copies = some.select("doc_id", "n", "hi", "lo").join(self.classes.where("copies > 1"), ["n", "hi", "lo"]).where("doc_id <> rep").select("doc_id", "rep")
        reps = self.classes.select(F.col("rep").alias("doc_id")).distinct()
        self.copies = stored(copies, "copies", many)
        others = self.copies.select("doc_id").distinct().join(reps, "doc_id", "left_anti")
        self.distinct = self.rows.where("doc_id is not null and text is not null").join(small_side(others), "doc_id", "left_anti")
        # one row per id; rows that share an id are one node, whose size is that of any of its sets
        self.sizes = some.join(self.classes.select("n", "hi", "lo", F.col("rep").alias("doc_id")), ["n", "hi", "lo", "doc_id"]).select(F.col("doc_id").alias("id"), "n", "sketch", "wide")

    def met(self) -> DataFrame:
        """(key, u, v): u the smallest id seen with the key, v another one."""
        total = self.classes.agg(F.sum("n")).first()[0] or 0
        shuffles = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(4 * shuffles, total // BUCKET_KEYS)
        offered = self.distinct.mapInArrow(_offer(buckets, self.hot), "bucket bigint, keys binary, ids binary, leads binary")
        # pairs found before the shuffle need no meeting: they are dealt by size, not by key
        dealt = offered.select(F.when(F.col("leads").isNull(), F.col("bucket")).otherwise(buckets + F.pmod(F.xxhash64("keys"), F.lit(buckets))).alias("bucket"), "keys", "ids", "leads")
        return stored(dealt.groupBy("bucket").applyInArrow(_meet, "key bigint, u bigint, v bigint"), "met")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sizes and sketches allow a link."""
        a, b = (self.sizes.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_s"), F.col("wide").alias(f"{c}_w")) for c in ("u", "v"))
        return pairs.join(a, "u").join(b, "v").select("u", "v", "u_n", "u_s", "v_n", "v_s", "u_w", "v_w").mapInArrow(_bound, "u bigint, v bigint")

    def linked(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of texts that are similar, by their whole sets."""
        pairs = stored(pairs, name)
        many = pairs.count()
        ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), name, 2 * many)
        sets = self.distinct.join(small_side(ids), "doc_id", "left_semi").mapInArrow(_sets, "id bigint, tokens binary")
        both = (
            pairs.join(sets.select(F.col("id").alias("v"), F.col("tokens").alias("vt")), "v")
            .join(sets.select(F.col("id").alias("u"), F.col("tokens").alias("ut")), "u")
            .select("u", "v", "ut", "vt")
        )
        return stored(both.mapInArrow(_verify, "u bigint, v bigint").distinct(), name, many)

    def across(self, entries: DataFrame, parts: DataFrame, nearest: bool) -> DataFrame:
        """Pairs of a key that lie in different components and may be similar: all, or for each id and block the nearest."""
        placed = entries.join(parts, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        open_keys = placed.groupBy("key").agg(F.count("*").alias("g"), F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b and g > 2")
        blocks = F.ceil(F.col("g") / BLOCK).cast("int")
        dealt = (
            placed.join(open_keys.select("key", "g"), "key")
            .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
            .select("key", "id", "component", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("x"))
            .select("key", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "id", "block", "component")
        )
        full = dealt.join(self.sizes, "id").select("key", "i", "j", "id", "block", "component", "n", "sketch")
        return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_blocks(nearest), "u bigint, v bigint").distinct()

    def joined(self, links: DataFrame, many: int) -> tuple[DataFrame, DataFrame]:
        """The links, ``many`` at most, and the components they make, both written."""
        links = stored(links, "links", many)
        return links, stored(components(links, many), "parts", 2 * many)

    def components(self) -> DataFrame:
        """(id, component) of all smallest ids of equal sets that are linked with another."""
        met = self.met()
        repeated = self.profiles.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
        links = self.copies.join(repeated, "doc_id", "left_semi").select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))
        found = self.linked(self.near(met.select("u", "v").distinct()), "pairs")
        links, parts = self.joined(links.unionAll(found), self.copies.count() + found.count())
        # Near copies join their nearest first, round by round as long as components meet; each round at least halves those
        # that do. What is left are pairs between components of which no nearest one is a link: these are all looked at.
        entries = stored(met.select("key", F.explode(F.array("u", "v")).alias("id")).distinct(), "entries", 2 * met.count())
        for nearest in (True, False):
            while True:
                pairs = stored(self.near(self.across(entries, parts, nearest)), "across")
                if not pairs.limit(1).count() or not (more := self.linked(pairs, "across")).limit(1).count():
                    break
                links, parts = self.joined(links.unionAll(more), links.count() + more.count())
                if not nearest:
                    break
        return parts


def linked_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links of similarity 0.75 or more).

    Texts are sets of five-word shingles, A-Z lower-cased; a shorter text is one shingle; null and empty texts and texts
    without words have none and are linked with nothing. Rows that share an id are one node of the graph. Null ids are
    linked with nothing and have a null component. Other columns are ignored.
    """
    join = ParityJoin(docs)
    parts = join.components()
    known = join.profiles.select("doc_id", "n", "hi", "lo").join(join.classes.select("n", "hi", "lo", "rep"), ["n", "hi", "lo"], "left")
    known = known.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("rep")).otherwise(F.col("doc_id")).alias("id"))
    return known.join(parts, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of the smallest id of each component. Rows without an id are kept.

    Rows that repeat a kept id stay.
    """
    gone = linked_documents(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small_side(gone), "doc_id", "left_anti").select(*docs.columns)
