"""Near-duplicate vectors of one label by counting collisions of many one-dimensional projections.

A pair of unit vectors at cosine c differs by a normal variable of variance 2 - 2c on a random projection. In ``PROJECTIONS``
of them every vector has a window around its own value, wide enough to hold a vector at the threshold with probability
``HIT``; the values are sorted, the window is a range of ranks, and a pair collides where one lies in the window of the
other. Pairs at the threshold collide in almost all projections, others in few: pairs that collide as often as ``RECALL``
of the pairs at the threshold do are verified by their cosine.

Which pairs are counted at all is decided in rounds of coarser projections: a round deals the vectors into cells of
``CELL`` on each of ``k`` projections, and pairs are counted within cells. ``k`` grows with the logarithm of the largest
label and the number of rounds follows from it, so that a pair at the threshold shares a cell with probability ``RECALL``
too, while unlike vectors rarely do. A pair that shares cells in several rounds belongs to the first of these.

Equal vectors are one node with a number of copies. A large cell is cut into blocks, and blocks are counted pair by pair of
blocks in separate tasks. Links are counted where they are found: what leaves a task is, for every vector, how many links it
has there, and a spanning forest of them, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickflow.llm.common import small_side, stored
from pickflow.llm.graph import components

THRESHOLD = 0.93
#: Projections on which collisions are counted; the chance that a pair at the threshold collides on one; the share of such
#: pairs that each of both filters lets through.
PROJECTIONS, HIT, RECALL = 24, 0.93, 0.998
#: Width of a cell, in standard deviations of a projection of a unit vector; pairs of unlike vectors that a vector may meet.
CELL, MEETS = 2.0, 4000
#: Vectors of a block, and how many of them are counted against a block at a time.
BLOCK, STRIP = 2048, 128
_SEED = 20_25


def _normal_cdf(x: float) -> float:
    return (1 + math.erf(x / math.sqrt(2))) / 2


def _same_cell(spread: float) -> float:
    """The chance that two values lie in one cell, if their difference is normal with this deviation."""
    r = CELL / spread
    return 2 * _normal_cdf(r) - 1 - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


class Plan:
    """The calibrated numbers for a threshold and the size of the largest label."""

    def __init__(self, threshold: float, largest: int):
        near = math.sqrt(max(2 - 2 * threshold, 1e-12))
        self.threshold = threshold
        low, high = 0.0, 10.0
        for _ in range(60):  # the window in which a difference at the threshold falls with chance HIT
            mid = (low + high) / 2
            low, high = (mid, high) if 2 * _normal_cdf(mid) - 1 < HIT else (low, mid)
        self.window = near * high
        tail, self.count = 0.0, PROJECTIONS + 1
        while tail < RECALL:
            self.count -= 1
            tail += math.comb(PROJECTIONS, self.count) * HIT**self.count * (1 - HIT) ** (PROJECTIONS - self.count)
        same, other = _same_cell(near), _same_cell(math.sqrt(2))
        self.k = 0
        while True:  # more projections a cell, until a vector meets few unlike ones in all rounds together
            hit = same**self.k
            self.rounds = 1 if hit >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - hit))
            if other**self.k * self.rounds * largest <= MEETS or self.k >= 40:
                break
            self.k += 1

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """For unit vectors (rows) the cell of each in every round, as hashes."""
        n, dims = vectors.shape
        rng = np.random.default_rng([_SEED, 1, dims])
        out = np.empty((n, self.rounds), np.uint64)
        for r in range(self.rounds):
            at = np.floor((vectors @ rng.standard_normal((dims, self.k)) + rng.uniform(0, CELL, self.k)) / CELL).astype(np.int64).astype(np.uint64)
            h = np.full(n, (r + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
            for j in range(self.k):
                h = (h ^ at[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            out[:, r] = h
        return out

    def windows(self, vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each projection the ranks of all vectors, and of ``rows`` the first rank in their window and the one after it."""
        dims = vectors.shape[1]
        values = vectors @ np.random.default_rng([_SEED, 2, dims]).standard_normal((dims, PROJECTIONS))
        rank, first, after = (np.empty((PROJECTIONS, k), np.int16 if len(vectors) < 1 << 14 else np.int32) for k in (len(vectors), len(rows), len(rows)))
        for j in range(PROJECTIONS):
            order = np.argsort(values[:, j], kind="stable")
            line = values[order, j]
            rank[j, order] = np.arange(len(line))
            first[j] = np.searchsorted(line, values[rows, j] - self.window, "left")
            after[j] = np.searchsorted(line, values[rows, j] + self.window, "right")
        return rank, first, after

    def pairs(self, vectors: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a row of ``left`` and one of ``right`` (row numbers) that collide often enough and whose cosine is high enough."""
        own, rows = np.concatenate([left, right]) if right is not left else left, np.arange(len(left))
        rank, first, after = self.windows(vectors[own], rows)
        begin = 0 if right is left else len(left)
        for at in range(0, len(left), STRIP):
            # of one block only pairs with the later row
            start = begin + at if right is left else begin
            seen = np.zeros((min(STRIP, len(left) - at), len(own) - start), np.int8)
            for j in range(PROJECTIONS):
                line = rank[j, None, start:]
                seen += (line >= first[j, at : at + STRIP, None]) & (line < after[j, at : at + STRIP, None])
            p, q = np.nonzero(seen >= self.count)
            p, q = p + at, q + start
            if right is left:
                p, q = p[q > p], q[q > p]
            p, q = own[p], own[q]
            for k in range(0, len(p), 1 << 16):
                a, b = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                x, y = vectors[a], vectors[b]
                near = np.einsum("ij,ij->i", x, y) >= self.threshold
                yield a[near], b[near]


def unit_vectors(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # keeps squares in range
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs connect: each row with the smallest row of its component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(root != np.arange(n))
    return some, root[some]


def _cells(plan: Plan, kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Classes (cid, place, vector) with equal labels and lengths known by ``place``: their cell in every round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, place = batch.column(2).to_pylist(), batch.column(1).to_numpy().astype(np.uint64)
            size = np.array([len(x) for x in raw])
            for width in np.unique(size).tolist():
                rows = np.flatnonzero(size == width)
                cells = np.asfortranarray(plan.cells(unit_vectors([raw[i] for i in rows], kind)) ^ (place[rows] * np.uint64(0x94D049BB133111EB))[:, None])
                same = [batch.column(c).take(pa.array(rows)) for c in range(4)]
                for r in range(plan.rounds):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[:, r].view(np.int64)), pa.array(np.full(len(rows), r, np.int32)), *same],
                        names=["cell", "round", "cid", "place", "vector", "copies"],
                    )

    return run


def _links(plan: Plan, kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (cell, i, j, round, block, cid, place, vector, copies) sorted by the first four: for each vector linked within
    blocks i and j of a cell the copies it is linked with (n), and edges of a forest (cid, other)."""

    def group(t: pa.Table) -> pa.RecordBatch:
        r, i, j = (t[c][0].as_py() for c in ("round", "i", "j"))
        cid, place, copies, block = (t[c].to_numpy() for c in ("cid", "place", "copies", "block"))
        raw = t["vector"].to_pylist()
        size = np.array([len(v) for v in raw])
        n = np.zeros(len(cid), np.int64)
        edges = [np.zeros((2, 0), np.int64)]
        kinds, which = np.unique(np.stack([place, size]), axis=1, return_inverse=True)
        # a cell is a hash: what differs in label or length is told apart
        for kind_ in range(kinds.shape[1]):
            rows = np.flatnonzero(which.ravel() == kind_)
            x = unit_vectors([raw[k] for k in rows], kind)
            earlier = plan.cells(x)[:, :r]
            left = np.flatnonzero(block[rows] == i)
            right = left if i == j else np.flatnonzero(block[rows] == j)
            for a, b in plan.pairs(x, left, right):
                first = ~(earlier[a] == earlier[b]).any(1)
                a, b = a[first], b[first]
                np.add.at(n, rows[a], copies[rows[b]])
                np.add.at(n, rows[b], copies[rows[a]])
                edges.append(rows[np.stack(_forest(len(rows), a, b))])
        some = np.flatnonzero(n)
        u, v = np.concatenate(edges, axis=1)
        none = np.zeros(len(u), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([cid[some], cid[u]])), pa.array(np.concatenate([n[some], none])), pa.array([*[None] * len(some), *cid[v].tolist()], pa.int64())],
            names=["cid", "n", "other"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = np.stack([t[c].to_numpy() for c in ("cell", "i", "j", "round")])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if b - a > 1:
                    yield group(t.slice(a, b - a))
            held = t.slice(cut[-1])
        if held is not None and held.num_rows > 1:
            yield group(held)

    return run


def near_vectors(vectors: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors of one label (not null) and one length link when their cosine, in double precision, is ``threshold`` or more.
    n_links counts the other rows linked directly, rows without an id left out; component_id is the smallest vec_id reachable
    by links, itself included; kept is vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing. Rows that share an id are one node of the graph, each with its own n_links. A null id links
    with nothing and has null component and false kept. Other columns are ignored.

    Links at the threshold are found with a probability of ``RECALL`` twice, nearer ones almost always, none below it.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    element = rows.schema["embedding"].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    if kind is np.float64 and not isinstance(element, T.DoubleType):
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # 0.0 and -0.0 are one value; the bytes of a vector are its key from here on
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    usable = rows.where(whole).select("vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0).cast(element if kind is np.float32 else "double")).alias("embedding"))
    keyed = usable.mapInArrow(_as_bytes(kind), T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("vector", T.BinaryType())]))
    keyed = stored(keyed, "vectors")
    grouped = keyed.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    # the number is given once, when the table is written
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    plan = Plan(threshold, largest)
    dealt = classes.select("cid", F.xxhash64("label").alias("place"), "vector", "copies").mapInArrow(
        _cells(plan, kind), "cell bigint, round int, cid bigint, place bigint, vector binary, copies bigint"
    )
    large = dealt.groupBy("cell").count().where(f"count > {BLOCK}").select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    cut = dealt.join(small_side(large), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("cell", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "round", "block", "cid", "place", "vector", "copies")
    met = cut.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "round").mapInArrow(_links(plan, kind), "cid bigint, n bigint, other bigint")
    met = stored(met, "links")

    linked = met.where("other is null").groupBy("cid").agg(F.sum("n").alias("n"))
    own = classes.select("label", "vector", "cid", "rep", "copies").join(linked, "cid", "left")
    ids = classes.select("cid", "rep")
    edges = met.where("other is not null").select("cid", "other").distinct().join(ids, "cid").select("other", F.col("rep").alias("u"))
    edges = edges.join(ids.select(F.col("cid").alias("other"), F.col("rep").alias("v")), "other").select("u", "v")
    known = stored(
        keyed.join(own, ["label", "vector"]).select("vec_id", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "rows"
    )
    # rows of one id in several classes connect these; the other rows follow their class
    repeated = known.groupBy("vec_id").agg(F.count_distinct("rep").alias("reps")).where("reps > 1").select("vec_id")
    bridges = known.join(repeated, "vec_id", "left_semi").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    parts = stored(components(edges.unionAll(bridges).select(F.col("u").cast("bigint"), F.col("v").cast("bigint"))), "parts")
    placed = known.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    rest = rows.where(~F.coalesce(whole, F.lit(False))).select("vec_id")
    alone = rest.join(placed.groupBy("vec_id").agg(F.min("component_id").alias("component_id")), "vec_id", "left").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return placed.unionAll(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _as_bytes(kind: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            at = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            packed = pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["vec_id", "label", "vector"])

    return run
