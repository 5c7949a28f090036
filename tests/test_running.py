"""Running totals: the range split and the blocks give the numbers of a sequential loop."""

from __future__ import annotations

import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pickflow.functions import paging
from pickflow.functions.paging import rowset_page
from pickflow.functions.intervals import _level, _tiles, overlap_join
from pickflow.functions.running import block_totals, row_numbers, running_totals


def _data(seed: int):
    rng = random.Random(seed)
    # One group holds most of the rows, one key is null, many order values are equal.
    keys = ["hot"] * 400 + ["a", "b", None] * 20
    data = [(k, rng.randint(0, 9), i, rng.randint(-3, 9)) for i, k in enumerate(keys)]
    rng.shuffle(data)
    return data


def _expected(data):
    out = []
    ordered = sorted(data, key=lambda r: (str(r[0]), r[1], r[2]))
    for _, group in groupby(ordered, key=lambda r: r[0]):
        total = 0
        for n, row in enumerate(group, 1):
            total += row[3]
            out.append((*row, total, n))
    return sorted(out, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("partitions", [1, 5])
def test_running_totals(spark, partitions):
    data = _data(1)
    df = spark.createDataFrame(data, "k string, o int, id int, v int").repartition(partitions)
    got = running_totals(df, ["k"], [F.col("o").asc(), F.col("id").asc()], {"s": F.col("v"), "n": 1})
    assert rows(got) == _expected(data)


def test_row_numbers(spark):
    df = spark.createDataFrame([("x", i) for i in range(10)], "k string, o int")
    assert rows(row_numbers(df, ["k"], [F.col("o").desc()]), "o", "rn") == sorted([(i, 10 - i) for i in range(10)], key=str)
    assert rows(row_numbers(df.filter("false"), ["k"], [F.col("o").desc()])) == []


def test_block_totals(spark):
    rng = random.Random(5)
    data = [(k, p, rng.randint(0, 5)) for k in ("a", "b") for p in rng.sample(range(1, 500), 150)]
    df = spark.createDataFrame(data, "k string, pos bigint, v int")
    got = block_totals(df, ["k"], "pos", {"s": F.col("v")}, width=7)
    want = []
    for k in ("a", "b"):
        total = 0
        for _, p, v in sorted(r for r in data if r[0] == k):
            total += v
            want.append((k, p, v, total))
    assert rows(got) == sorted(want, key=lambda r: [(False, str(v)) for v in r])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlap_join(spark, seed):
    rng = random.Random(seed)
    left, right = [], []
    for k in range(12):
        at = 0
        for i in range(rng.randint(0, 12)):
            size = rng.randint(1, 9)
            left.append((k, f"l{k}-{i}", at, at + size))
            at += size
        at = 0
        for i in range(rng.randint(0, 8)):
            size = rng.choice([1, 2, 3, 40])
            right.append((k, f"r{k}-{i}", at, at + size))
            at += size
    a = spark.createDataFrame(left, "k int, l string, start bigint, end bigint")
    b = spark.createDataFrame(right, "k int, r string, start bigint, end bigint")
    got = {(r["l"], r["r"]): r["overlap"] for r in overlap_join(a, b, ["k"]).collect()}
    want = {
        (x[1], y[1]): min(x[3], y[3]) - max(x[2], y[2])
        for x in left for y in right if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2])
    }
    assert got == want


def test_overlap_join_with_intervals_of_very_different_lengths(spark):
    """One interval a million times the average, many of length 1, borders that touch, and negative positions."""
    rng = random.Random(3)
    short = [(0, s, s + rng.choice((1, 1, 2, 3, 7)), f"s{i}") for i, s in enumerate(rng.sample(range(-5_000, 5_000), 600))]
    wide = [(0, -3_000_000, 4_000_000, "w0"), (0, 4_999, 5_000_000, "w1"), (0, 17, 17, "empty"), (1, -2, 1_000_000_000_000, "alone")]
    left = [*short[:300], *wide]
    right = [*short[300:], (0, -10, 3_000_000, "w2"), (0, 10_000_000, 10_000_001, "far"), (2, 0, 5, "other key")]
    a = spark.createDataFrame(left, "k int, start bigint, end bigint, l string")
    b = spark.createDataFrame(right, "k int, start bigint, end bigint, r string")
    want = {(x[3], y[3]): min(x[2], y[2]) - max(x[1], y[1]) for x in left for y in right if x[0] == y[0] and max(x[1], y[1]) < min(x[2], y[2])}
    joined = overlap_join(a, b, ["k"])
    got = [(r["l"], r["r"], r["overlap"]) for r in joined.collect()]
    assert len(got) == len(want) and {(x, y): n for x, y, n in got} == want
    # no interval makes more rows than two for each level of the other side
    levels = F.array(*[F.lit(x) for x in range(0, 64, 2)])
    one = a.filter("l = 'w0'").withColumns({"_level": _level(F.col("start"), F.col("end")), "_levels": levels})
    assert _tiles(one, 0, F.filter("_levels", lambda x: x > F.col("_level"))).count() <= 64


def test_deep_pages_of_a_hot_group(spark, monkeypatch):
    rng = random.Random(12)
    values = [(None if k == 3 else k, rng.choice([None, *range(40)]), i) for i, k in enumerate(rng.choices([1, 2, 3], [50, 1, 1], k=6000))]
    df = spark.createDataFrame(values, "k int, v int, i int").repartition(7)
    order = [F.col("v").desc_nulls_last(), F.col("i").asc()]
    ranked = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    monkeypatch.setattr(paging, "SHALLOW", 50)
    for page, limit in ((1, 51), (4, 20), (100, 30), (240, 25), (9000, 10)):
        want = [r for k in (1, 2, None) for r in [x for x in ranked if x[0] == k][(page - 1) * limit : page * limit]]
        assert sorted(tuple(r) for r in rowset_page(df, order, page, limit, keys=["k"]).select("i").collect()) == sorted((r[2],) for r in want)
        whole = ranked[(page - 1) * limit : page * limit]
        assert sorted(tuple(r) for r in rowset_page(df, order, page, limit).select("i").collect()) == sorted((r[2],) for r in whole)


def test_a_deep_page_sorts_only_the_partitions_it_is_in(spark):
    """Page 100,000 of ten million rows in one group: one block of rows is numbered, of some dozens."""
    df = spark.range(10_000_000).select(F.lit(1).alias("k"), F.expr("id * 7919 % 10000000").alias("v"))
    with_parts = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {name: spark.conf.get(name) for name in with_parts}
    for name, value in with_parts.items():
        spark.conf.set(name, value)
    try:
        page = rowset_page(df, [F.col("v").asc()], 100_000, 50, keys=["k"])
        assert [r["v"] for r in page.orderBy("v").collect()] == list(range(4_999_950, 5_000_000))
        numbered = page._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert "WindowGroupLimit" not in numbered


def test_only_groups_at_the_edges_of_partitions_are_summed_across_them(spark):
    """Many small groups, one over several partitions, and one without a key; the other groups' totals stay where they are."""
    data = [(g, i, 1) for g in range(200) for i in range(3)] + [(77, 100 + i, 2) for i in range(400)] + [(None, i, 5) for i in range(300)]
    df = spark.createDataFrame(data, "g int, i int, v int")
    out = running_totals(df, ["g"], [F.col("i").asc()], {"upto": F.col("v"), "rn": 1})
    expected, sums, counts = [], {}, {}
    for g, i, v in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        sums[g], counts[g] = sums.get(g, 0) + v, counts.get(g, 0) + 1
        expected.append((g, i, sums[g], counts[g]))
    got = [tuple(r) for r in out.select("g", "i", "upto", "rn").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert re.search(r"BroadcastHashJoin \[[^\n]*LeftOuter, BuildRight", out._jdf.queryExecution().executedPlan().toString())
