"""Stock allocation against the sequential model, and its invariants on the sample data."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import models
from conftest import rows
from pickflow.hooks import Hooks
from pickflow.operators import allocate as al
from pickflow.plans.flows import allocate_stock
from pickflow.session import cut_lineage

ORDER_SCHEMA = "id string, domain_id int, batch_id string, job_date string, equip_type string, equip_cd string, class_cd string, com_cd string, sku_cd string, order_qty int, order_type string, status string"
STOCK_SCHEMA = "id string, domain_id int, equip_type string, equip_cd string, cell_cd string, com_cd string, sku_cd string, load_qty int, alloc_qty int, active_flag boolean"
CELL_SCHEMA = "domain_id int, equip_type string, equip_cd string, cell_cd string, ind_cd string, active_flag boolean"


def _case(rng, domain, batches=1, max_skus=4):
    """One tenant with one rack: a random case."""
    skus = [f"S{i}" for i in range(rng.randint(1, 5))]
    orders, lines = [], defaultdict(list)
    for b in range(batches):
        for c in range(rng.randint(1, 9)):
            wanted = rng.sample(skus + ["NONE"], min(rng.randint(1, max_skus), len(skus)))
            for sku in wanted:
                qty = rng.randint(1, 6)
                lines[b].append((f"C{b}-{c}", sku, qty))
                orders.append((f"{domain}-{b}-{c}-{sku}", domain, f"B{b}", f"2020{10 - b:02d}", "Rack", "R1", f"C{b}-{c}", "K", sku, qty, "MT", "W"))
    stocks, cells, state = [], [], {}
    for n in range(8):
        active = rng.random() < 0.85
        cells.append((domain, "Rack", "R1", f"c{n}", f"i{n}", active))
        for sku in rng.sample(skus, rng.randint(0, min(2, len(skus)))):
            load = rng.randint(0, 7)
            row_active = rng.random() < 0.9
            stock_id = f"{domain}-{n}-{sku}"
            stocks.append((stock_id, domain, "Rack", "R1", f"c{n}", "K", sku, load, 0, row_active))
            if row_active:
                state[stock_id] = [sku, f"c{n}", load, active]
    return orders, stocks, cells, lines, state


def _frames(spark, cases):
    parts = [sum((list(c[i]) for c in cases), []) for i in range(3)]
    return [spark.createDataFrame(p, s) for p, s in zip(parts, (ORDER_SCHEMA, STOCK_SCHEMA, CELL_SCHEMA))]


def _as_dict(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["domain_id"]][(r["order_no"], r["sku_cd"], r["stock_id"])] = r["assign_qty"]
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_allocate_equals_the_sequential_greedy(spark, hot, monkeypatch):
    rng = random.Random(7)
    cases = [_case(rng, d) for d in range(400)]
    if hot:
        monkeypatch.setattr(al, "BLOCK", 2)
    got = _as_dict(al.allocate(*_frames(spark, cases)))
    for domain, (_, _, _, lines, state) in enumerate(cases):
        assert got.get(domain, {}) == models.greedy(lines[0], state), domain


def test_allocate_batch_by_batch(spark):
    rng = random.Random(11)
    cases = [_case(rng, d, batches=3) for d in range(120)]
    orders, stocks, cells = _frames(spark, cases)
    batches = spark.createDataFrame(
        [(d, f"B{b}", f"2020{10 - b:02d}", "RUN") for d in range(120) for b in range(3)], "domain_id int, id string, job_date string, status string"
    )
    got = _as_dict(al.allocate(orders, stocks, cells, batches, wave="batch"))
    for domain, (_, _, _, lines, state) in enumerate(cases):
        want = {}
        for b in range(3):
            want.update(models.greedy(lines[b], state))
        assert got.get(domain, {}) == want, domain


def test_batches_that_share_plenty_do_not_wait_for_each_other(spark, monkeypatch):
    """The tables written, so the rounds, are as many for six batches as for two, while the SKU they share lasts."""

    def written(n):
        count = []
        monkeypatch.setattr(al, "cut_lineage", lambda df: count.append(1) or cut_lineage(df))
        orders = [(f"{b}-{c}-{s}", 1, f"B{b}", f"2020{10 - b:02d}", "Rack", "R1", f"C{b}-{c}", "K", s, 2, "MT", "W") for b in range(n) for c in range(2) for s in ("A", f"S{b}")]
        stocks = [(s, 1, "Rack", "R1", "c0", "K", s, 90, 0, True) for s in ("A", *(f"S{b}" for b in range(n)))]
        batches = spark.createDataFrame([(1, f"B{b}", f"2020{10 - b:02d}", "RUN") for b in range(n)], "domain_id int, id string, job_date string, status string")
        frames = [spark.createDataFrame(orders, ORDER_SCHEMA), spark.createDataFrame(stocks, STOCK_SCHEMA), spark.createDataFrame([(1, "Rack", "R1", "c0", "i0", True)], CELL_SCHEMA)]
        got = rows(al.allocate(*frames, batches, wave="batch"), "wave", "seq", "order_no", "sku_cd", "assign_qty")
        assert got == sorted((b + 1, c + 1, f"C{b}-{c}", s, 2) for b in range(n) for c in range(2) for s in ("A", f"S{b}"))
        return len(count)

    assert written(6) == written(2)


def test_allocate_lines_is_the_greedy_for_one_sku_orders(spark):
    rng = random.Random(3)
    cases = [_case(rng, d, max_skus=1) for d in range(300)]
    orders, stocks, cells = _frames(spark, cases)
    assert _as_dict(al.allocate_lines(orders, stocks, cells)) == _as_dict(al.allocate(orders, stocks, cells))


def test_allocation_invariants(spark, small):
    result = allocate_stock(small)
    given = rows(result.allocations.groupBy("stock_id").agg(F.sum("assign_qty")))
    loads = {r["id"]: r["load_qty"] for r in small.stocks.collect()}
    assert given and all(0 < qty <= loads[stock] for stock, qty in given)
    demand = {(r["domain_id"], r["batch_id"], r["class_cd"], r["sku_cd"]): r["order_qty"] for r in al.open_demand(small.orders).collect()}
    served = defaultdict(int)
    for r in result.allocations.collect():
        served[(r["domain_id"], r["batch_id"], r["order_no"], r["sku_cd"])] += r["assign_qty"]
    assert all(demand[k] == v for k, v in served.items())
    # All or nothing per order.
    for d, b, c, _ in served:
        assert all((d, b, c, s) in served for (d2, b2, c2, s) in demand if (d2, b2, c2) == (d, b, c))
    assert result.jobs.count() == result.allocations.count() == result.jobs.select("id").distinct().count()
    statuses = {(r["domain_id"], r["status"]) for r in result.jobs.select("domain_id", "status").distinct().collect()}
    assert statuses == {(1, "BW"), (2, "W")}
    after = result.stocks.agg(F.sum("load_qty"), F.sum("alloc_qty")).first()
    before = small.stocks.agg(F.sum("load_qty")).first()[0]
    assert after[0] + after[1] == before and after[1] == sum(served.values())
    assert result.orders.filter("status = 'A'").count() > small.orders.filter("status = 'A'").count()


def test_skip_orders_hook(spark, small):
    hooks = Hooks().add("skip_orders", lambda df: df.filter("domain_id = 1"))
    result = allocate_stock(small, hooks)
    assert {r[0] for r in result.allocations.select("domain_id").distinct().collect()} == {2}


def test_wrong_wave(small):
    with pytest.raises(ValueError, match="wave"):
        al.allocate(small.orders, small.stocks, small.cells, wave="all")


def test_candidates_keep_only_covered_skus(spark):
    orders = spark.createDataFrame(
        [("1", 1, "B", "202001", "Rack", "R1", "C1", "K", "A", 5, "MT", "W"), ("2", 1, "B", "202001", "Rack", "R1", "C1", "K", "NONE", 1, "MT", "W")], ORDER_SCHEMA
    )
    stocks = spark.createDataFrame(
        [("x", 1, "Rack", "R1", "c2", "K", "A", 3, 0, True), ("y", 1, "Rack", "R1", "c1", "K", "A", 3, 0, True), ("z", 1, "Rack", "R1", "c3", "K", "A", 9, 0, True)], STOCK_SCHEMA
    )
    cells = spark.createDataFrame([(1, "Rack", "R1", f"c{n}", f"i{n}", True) for n in (1, 2, 3)], CELL_SCHEMA)
    got = rows(al.assign_candidates(orders, stocks, cells), "sku_cd", "cell_cd", "load_sum_by_cell", "ranking", "check_assignable")
    # Equal loads follow the cell code; the SKU without stock has no rows but counts as short.
    assert got == [("A", "c1", 3, 1, 1), ("A", "c2", 6, 2, 1)]


def test_a_round_moves_the_lines_by_item_and_by_order_once(spark, monkeypatch):
    """Lines move as numbers: the plan of a round has few exchanges, and none of its tables has a name of an order or SKU."""
    plans = []

    def written(df):
        if "is_open" in df.columns:
            plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString().count("Exchange")))
        return cut_lineage(df)

    monkeypatch.setattr(al, "cut_lineage", written)
    rng = random.Random(5)
    al.allocate(*_frames(spark, [_case(rng, d) for d in range(20)]))
    assert len(plans) > 2  # the lines at first, and those of each round
    assert all(not {"class_cd", "sku_cd", "equip_cd"} & set(columns) and moves <= 5 for columns, moves in plans)


def test_cells_are_swept_as_they_overlap(spark):
    from pickflow.functions.intervals import overlap_join

    rng, lines, cells = random.Random(13), [], []
    for item in range(60):
        for rows_, total in ((lines, 40), (cells, 50)):
            at = 0
            while at < total:
                end = min(at + rng.choice([0, 1, 2, 9]), total)
                if rows_ is lines or end > at:
                    rows_.append((item, at, end, len(rows_)))
                at = max(end, at + (rows_ is lines and rng.random() < 0.01))
    taken = spark.createDataFrame(lines, "item_no bigint, start bigint, end bigint, place bigint")
    laid = spark.createDataFrame([(i, s, e, "K", "S", f"c{n}", f"i{n}", f"s{n}") for i, s, e, n in cells], "item_no bigint, start bigint, end bigint, com_cd string, sku_cd string, cell_cd string, ind_cd string, stock_id string")
    want = overlap_join(taken, laid, ["item_no"]).select("place", *al.CELL_COLUMNS, F.col("overlap").alias("assign_qty"))
    got = rows(al._swept(taken, laid))
    assert got == rows(want) and got


@pytest.mark.parametrize("block", [2, 100_000])
def test_odd_quantities_are_allocated_alike_in_blocks(spark, block, monkeypatch):
    """No demand, none given and less than none, with a rack, order or SKU unnamed; items are summed whole or in blocks."""
    monkeypatch.setattr(al, "BLOCK", block)
    lines = [(None, "S", 1), ("A", "S", 3), ("B", "S", None), ("B", "T", 2), ("C", "S", -1), ("C", "T", 1), ("D", "S", 0), ("E", None, 0), ("E", "S", 2), ("F", "S", 4), ("G", "S", 1)]
    orders = [(f"{n}", 1, "B", "202001", "Rack", None if c == "G" else "R1", c, "K", s, q, "MT", "W") for n, (c, s, q) in enumerate(lines)]
    stocks = [(f"{s}{n}", 1, "Rack", "R1", f"c{n}", "K", s, 3, 0, True) for s in "ST" for n in range(3)]
    cells = [(1, "Rack", "R1", f"c{n}", f"i{n}", True) for n in range(3)]
    frames = [spark.createDataFrame(p, k) for p, k in ((orders, ORDER_SCHEMA), (stocks, STOCK_SCHEMA), (cells, CELL_SCHEMA))]
    got = rows(al.allocate(*frames), "order_no", "sku_cd", "stock_id", "assign_qty", "seq")
    assert got == [("A", "S", "S0", 2, 6), ("A", "S", "S1", 1, 6), ("B", "T", "T0", 2, 1), ("C", "T", "T0", 1, 2), ("E", "S", "S0", 1, 5), ("F", "S", "S1", 2, 7), ("F", "S", "S2", 2, 7)]
