import re
from collections import defaultdict

import duckdb
import pytest

from pickflow.llm import mixing
from pickflow.llm.queries import op2_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, budget, cap):
    """Fixed point by repeated sharing: clamp who is above, share what is left among the others."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] >= cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        left, open_ = left - sum(out[s] for s in over), open_ - over
    return out


def check(docs, got, **o):
    cap = o.get("max_epochs", 2.0)
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = targets(sizes, o.get("weights", (5, 2, 1)), o.get("budget", 1.5), cap)
    taken, n = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= cap * r.size
        taken[r.source] += r.taken
        n[r.source] += 1
    for s in want:
        assert abs(taken[s] - want[s]) <= max(3, 0.002 * want[s]), s
    assert len(got) == len(docs)


def test_whole_table_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mix(docs).collect()
    check(docs.collect(), mixed)
    got = sorted(tuple(r) for r in op2_mixing(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.sql(mixing.MIX_SQL.format(docs="documents")).fetchall())
    assert [(a, b, c, round(d, 6), e) for a, b, c, d, e in got] == [(a, b, c, round(d, 6), e) for a, b, c, d, e in want]
    assert got == sorted(tuple(r) for r in op2_mixing(spark, sf).collect())


@pytest.mark.parametrize("budget", [0.5, 1.5, 1.99, 5.0])
def test_hot_tiny_and_null_sources(spark, make_docs, budget):
    items = [(i, "w " * (1 + i % 7), "hot") for i in range(400)] + [(1000 + i, "a b c", None) for i in range(5)] + [(2000, "x " * 500, "one"), (2001, None, "none"), (2002, " \t", "none"), (2002, " \t", "none"), (None, "q r", "")]
    docs = make_docs(*items).withColumnRenamed("lang", "target")
    check(docs.collect(), mixing.mix(docs, budget=budget).collect(), budget=budget)


def test_repeats_and_empty_table(spark, make_docs):
    docs = make_docs(*[(i, f"a b c d {i}", "x" if i % 3 else "y") for i in range(300)])
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    seen = defaultdict(int)
    for r in out.collect():
        seen[r.doc_id] += 1
    assert {k: v for k, v in copies.items() if v} == dict(seen) and max(copies.values()) <= 2
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.repeat_rows(docs.limit(0)).collect() == []


def test_native(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
