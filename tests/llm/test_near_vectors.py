import numpy as np
import pytest

from pickflow.llm.near_vectors import Plan, near_vectors
from pickflow.llm.queries import op13_near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows, threshold=0.93):
    """All pairs of rows compared: {position: (vec_id, n_links, component_id, kept)}."""
    usable = [k for k, (i, v, label) in enumerate(rows) if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: [] for k in range(len(rows))}
    for label, width in {(rows[k][2], len(rows[k][1])) for k in usable}:
        own = [k for k in usable if rows[k][2] == label and len(rows[k][1]) == width]
        x = np.array([rows[k][1] for k in own], np.float64)
        norm = np.sqrt((x * x).sum(1))
        for a, b in zip(*np.nonzero(x @ x.T / norm[:, None] / norm >= threshold), strict=True):
            if a != b:
                links[own[a]].append(own[b])
    root = {i: i for i, _, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, others in links.items():
        for m in others:
            a, b = sorted((find(rows[k][0]), find(rows[m][0])))
            root[b] = a
    return sorted(((i, len(links[k]), None if i is None else find(i), i is not None and find(i) == i) for k, (i, _, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near(rng, x, cosine):
    """A vector at the given cosine of unit vector ``x``."""
    y = rng.standard_normal(len(x))
    y -= (y @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_whole_table(spark, sf):
    sf = f"/root/testdata/{sf}"
    got = op13_near_vectors(spark, sf)
    assert dict(got.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert found(got) == expected([tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()])


def test_recall_at_the_threshold(spark):
    """Pairs just above it among many others are found, pairs just below are not."""
    rng = np.random.default_rng(4)
    rows = []
    for k in range(3000):
        x = rng.standard_normal(32)
        x /= np.linalg.norm(x)
        rows.append((2 * k, x, k % 2))
        rows.append((2 * k + 1, near(rng, x, 0.9301 if k % 3 else 0.9299), k % 2))
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = found(near_vectors(spark.createDataFrame(rows, SCHEMA)))
    want = expected(rows)
    links = sum(r[1] for r in want)
    assert links >= 3900
    assert sum(min(a[1], b[1]) for a, b in zip(got, want, strict=True)) >= 0.99 * links
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))


def test_odd_vectors_repeated_ids_copies_and_clashing_columns(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    nan, inf = float("nan"), float("inf")
    rows = [
        (9, a, 1), (8, a, 1), (7, [2.0, -0.0, 0.0], 1), (6, a, 2), (5, a, None), (4, None, 1), (3, [], 1), (2, [0.0, 0.0, 0.0], 1), (1, [1.0, None, 0.0], 1), (0, [nan, 1.0, 0.0], 1), (10, [inf, 0.0, 0.0], 1),
        (11, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, a, 1), (None, None, None), (20, b, 1), (20, c, 1), (19, [0.0, 5.0, 0.1], 1), (21, [0.1, 0.0, 3.0], 1), (19, None, 1), (30, [3e38, 3e38, 0.0], 1), (31, [1e-40, 1e-40, 0.0], 1),
    ]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS cell", "2 AS n_links", "'x' AS component_id", "3 AS cid")
    assert found(near_vectors(df)) == expected(rows)
    assert found(near_vectors(df.selectExpr("vec_id", "cast(embedding AS array<double>) AS embedding", "cast(label AS string) AS label"))) == expected([(i, v, None if x is None else str(x)) for i, v, x in rows])
    assert near_vectors(df.limit(0)).collect() == []


def test_a_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("pickflow.llm.near_vectors.BLOCK", 100)
    rng = np.random.default_rng(8)
    x = rng.standard_normal(16)
    rows = [(i, [float(np.float32(v)) for v in x + (0.1 if i % 3 else 0.3) * rng.standard_normal(16)], 0) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(300)] + [(2000 + i, [float(np.float32(v)) for v in rng.standard_normal(16)], 0) for i in range(300)]
    got, want = found(near_vectors(spark.createDataFrame(rows, SCHEMA))), expected(rows)
    assert [(r[0], r[2], r[3]) for r in got] == [(r[0], r[2], r[3]) for r in want]
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.995 * sum(r[1] for r in want)


def test_the_plan_grows_with_the_label():
    plans = [Plan(0.93, n) for n in (0, 500, 20_000, 1_000_000, 100_000_000)]
    assert [p.k for p in plans] == sorted(p.k for p in plans) and plans[0].rounds == 1
    assert plans[-1].rounds < 1000 and all(p.count == plans[0].count for p in plans)
