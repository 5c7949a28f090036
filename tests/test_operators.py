"""Edge cases and random cases of single operators, against sequential models or by hand."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import models
from conftest import rows
from pickflow.functions.columns import box_color, box_type_of, ratio, where
from pickflow.functions.paging import rowset_page
from pickflow.operators import boxing as bx
from pickflow.operators import classify as cl
from pickflow.operators import close as cs
from pickflow.operators import inputs as ip
from pickflow.operators import instruct as ins
from pickflow.operators import picking as pk
from pickflow.operators import progress as pg
from pickflow.operators import receive as rc

T0 = dt.datetime(2024, 1, 1)
LINE = "id string, domain_id int, batch_id string, class_cd string, com_cd string, sku_cd string, order_type string, status string, equip_cd string, order_qty int"


def test_confirm_pick_like_one_event_after_the_other(spark):
    rng = random.Random(2)
    jobs = {f"J{i}": (rng.randint(1, 9), 0, rng.choice("PPPPFC")) for i in range(60)}
    events = [(T0 + dt.timedelta(minutes=rng.randint(0, 20)), f"E{n}", f"J{rng.randint(0, 65)}", rng.randint(-1, 5)) for n in range(300)]
    want = models.confirm(jobs, [e for e in events if e[3] > 0])
    jdf = spark.createDataFrame(
        [(1, "B", i, p, q, s, None) for i, (p, q, s) in jobs.items()],
        "domain_id int, batch_id string, id string, pick_qty int, picked_qty int, status string, pick_started_at timestamp_ntz",
    )
    edf = spark.createDataFrame([(1, "B", j, e, t, q) for t, e, j, q in events], "domain_id int, batch_id string, job_id string, event_id string, ts timestamp_ntz, qty int")
    got = {r["id"]: (r["picked_qty"], r["status"], r["pick_started_at"], r["pick_ended_at"]) for r in pk.confirm_pick(jdf, edf).collect()}
    assert got == {i: (j["picked"], j["status"], j["start"], j["end"]) for i, j in want.items() if j["start"]}


def test_pick_to_orders_fills_the_least_picked_line_first(spark):
    rng = random.Random(4)
    lines, picks, want = [], [], {}
    for o in range(80):
        own = []
        for n in range(rng.randint(1, 5)):
            qty = rng.randint(1, 8)
            own.append((f"L{o}-{n}", qty, rng.randint(0, qty)))
        picked = rng.randint(0, 20)
        want.update(models.spread(own, picked))
        lines += [(1, "B", f"O{o}", "K", "S", i, q, h) for i, q, h in own]
        picks += [(1, "B", f"O{o}", "K", "S", part) for part in (picked // 2, picked - picked // 2)]
    ldf = spark.createDataFrame(lines, "domain_id int, batch_id string, order_no string, com_cd string, sku_cd string, id string, order_qty int, picked_qty int")
    pdf = spark.createDataFrame(picks, "domain_id int, batch_id string, order_no string, com_cd string, sku_cd string, picked_qty int")
    got = pk.pick_to_orders(ldf, pdf).collect()
    assert {r["id"]: r["picked_qty"] for r in got} == want
    full = {i: q for _, _, _, _, _, i, q, _ in lines}
    assert all(r["status"] == ("F" if r["picked_qty"] >= full[r["id"]] else "R") for r in got)


def test_map_boxes_serves_the_boxes_in_turn(spark):
    rng = random.Random(6)
    jobs, boxes, want = [], [], {}
    for d in range(30):
        orders = []
        for o in range(rng.randint(0, 7)):
            kind, skus = rng.choice(["A", "B"]), rng.randint(1, 3)
            qty = [rng.randint(1, 4) for _ in range(skus)]
            orders.append((kind, skus, sum(qty), f"O{o}"))
            jobs += [(d, "X", f"O{o}", f"O{o}", f"S{n}", q, "MT", "W", 0, kind, None) for n, q in enumerate(qty)]
        arriving = [(T0 + dt.timedelta(minutes=rng.randint(0, 3)), f"N{n}", rng.choice(["A", "B"])) for n in range(rng.randint(0, 7))]
        boxes += [(d, "X", b, k, None, t) for t, b, k in arriving]
        # A box that is in use already must not be mapped again.
        jobs.append((d, "X", "OLD", "OLD", "S0", 1, "MT", "P", 5, "A", "USED"))
        boxes.append((d, "X", "USED", "A", None, T0))
        for box, order in models.map_boxes(orders, arriving).items():
            want[(d, box)] = order
    jdf = spark.createDataFrame(jobs, "domain_id int, batch_id string, order_no string, class_cd string, sku_cd string, pick_qty int, order_type string, status string, input_seq bigint, box_type_cd string, box_id string")
    idf = spark.createDataFrame([], "domain_id int, batch_id string, order_no string")
    bdf = spark.createDataFrame(boxes, "domain_id int, batch_id string, box_id string, box_type_cd string, color_cd string, arrived_at timestamp_ntz")
    mapped = ip.map_boxes(jdf, idf, bdf, default_color="Y")
    assert {(r["domain_id"], r["box_id"]): r["order_no"] for r in mapped.collect()} == want
    assert {r["color_cd"] for r in mapped.collect()} == {"Y"}


def _lines(spark, data):
    return spark.createDataFrame(data, LINE)


def test_classify(spark):
    lines = _lines(spark, [
        ("1", 1, "B", "one", "K", "S", None, "W", None, 1),
        ("2", 1, "B", "one", "K", "S", None, "W", None, 1),
        ("3", 1, "B", "two", "K", "S", None, "W", None, 1),
        ("4", 1, "B", "two", "L", "S", None, "W", None, 1),
        ("5", 1, "G", "given", "K", "S", "MT", "W", None, 1),
        ("6", 1, "G", "other", "K", "S", None, "W", None, 1),
        ("7", 2, "B", "one", "K", "Z", None, "W", None, 1),
    ])
    by_sku = rows(cl.classify_orders(lines), "id", "order_type", "status")
    # Same SKU of two companies makes a multi order; a batch with any given type keeps its types.
    assert by_sku == [("1", "OT", "T"), ("2", "OT", "T"), ("3", "MT", "T"), ("4", "MT", "T"), ("5", "MT", "T"), ("6", None, "T"), ("7", "OT", "T")]
    by_lines = rows(cl.classify_orders(lines, variant="line_count"), "id", "order_type", "status")
    assert by_lines[:4] == [("1", "MT", "T"), ("2", "MT", "T"), ("3", None, "W"), ("4", None, "W")]
    counts = rows(cl.classify_counts(cl.classify_orders(lines)), "domain_id", "batch_id", "mt_count", "ot_count")
    assert counts == [(1, "B", 1, 1), (1, "G", 1, 0), (2, "B", 0, 1)]
    with pytest.raises(ValueError, match="variant"):
        cl.classify_orders(lines, variant="x")
    with pytest.raises(ValueError, match="class column"):
        cl.apply_class_codes(lines, class_field="id; drop")


def test_split_keeps_the_first_rack_and_moves_the_rest(spark, small):
    split = ins.apply_split(small.received_orders, small.batches, small.racks)
    assert split.orders.count() == small.orders.count()
    sizes = rows(split.orders.groupBy("domain_id", F.col("batch_id").alias("id")).agg(F.count_distinct("class_cd").alias("n")))
    planned = rows(split.batches.filter("batch_order_qty IS NOT NULL").select("domain_id", "id", F.col("batch_order_qty").alias("n")))
    assert set(planned) <= set(sizes)
    assert split.batches.select("domain_id", "id").distinct().count() == split.batches.count()


def test_cancel_receipt_modes(spark, small):
    with pytest.raises(ValueError, match="keep or delete"):
        rc.cancel_receipt(small.orders, small.batches, mode="drop")
    kept = rc.cancel_receipt(small.received_orders, small.batches, small.preprocesses)
    gone = rc.cancel_receipt(small.received_orders, small.batches, small.preprocesses, mode="delete")
    assert kept.orders.filter("status <> 'C'").count() == gone.orders.count()
    assert kept.preprocesses.count() == gone.preprocesses.count() < small.preprocesses.count()
    assert gone.batches.count() == small.batches.filter("status = 'RUN'").count()


def test_receive_again_adds_nothing(spark, small):
    items = rc.receipt_items(rc.receive_summary(small.wms_if_orders))
    first = rc.receive_orders(small.wms_if_orders, items)
    assert first.count() == small.wms_if_orders.filter("if_flag = 'N'").count()
    assert rc.receive_orders(small.wms_if_orders, items, first).count() == 0


def test_progress_of_an_empty_batch_is_zero(spark):
    jobs = spark.createDataFrame([(1, "B", "c", "K", "S", 5, None, "P"), (1, "B", "c", "K", "T", 5, 5, "C")],
                                 "domain_id int, batch_id string, class_cd string, com_cd string, sku_cd string, pick_qty int, picked_qty int, status string")
    batches = spark.createDataFrame([(1, "B"), (1, "EMPTY")], "domain_id int, id string")
    got = rows(pg.batch_progress_jobs(jobs, batches), "batch_id", "plan_pcs", "actual_pcs", "plan_sku", "plan_order", "rate_pcs", "rate_sku")
    assert got == [("B", 5, 0, 1, 1, 0.0, 0.0), ("EMPTY", 0, 0, 0, 0, 0.0, 0.0)]


def test_progress_does_not_count_a_sku_per_line_and_cell(spark):
    item = "domain_id int, batch_id string, class_cd string, com_cd string, sku_cd string"
    orders = spark.createDataFrame([(1, "B", "c", "K", "S", 2), (1, "B", "c", "K", "S", 3)], item + ", order_qty int")
    jobs = spark.createDataFrame([(1, "B", "c", "K", "S", 1, "P"), (1, "B", "c", "K", "S", 4, "F")], item + ", picked_qty int, status string")
    got = pg.batch_progress_orders(orders, jobs).first()
    assert (got["plan_pcs"], got["actual_pcs"], got["plan_sku"], got["actual_sku"], got["rate_pcs"]) == (5, 5, 1, 1, 100.0)


def test_picking_jobs_filters(spark, small):
    args = (small.jobs, small.cells, small.sku, small.indicators, small.gateways)
    every = pk.picking_jobs(*args)
    assert every.count() == small.jobs.join(small.cells, (small.jobs.sub_equip_cd == small.cells.cell_cd) & (small.jobs.domain_id == small.cells.domain_id)).count()
    assert every.filter("gw_path IS NULL").count() > 0
    assert {r[0] for r in pk.picking_jobs(*args, gw_cd="G1-0").select("gw_path").distinct().collect()} == {"GW/G1-0"}
    assert pk.picking_jobs(*args, input_seq_is_blank=True).filter("input_seq <> 0").count() == 0
    assert pk.picking_jobs(*args, exclude_cell_cd="R1-C1", equip_cd="R1").filter("sub_equip_cd = 'R1-C1'").count() == 0
    first = pk.picking_jobs(*args, only_one=True).collect()
    every = pk.picking_jobs(*args).select("domain_id", "batch_id").distinct().count()
    assert len(first) == every == len({(r["domain_id"], r["batch_id"]) for r in first})
    with pytest.raises(ValueError, match="unknown filters"):
        pk.picking_jobs(*args, colour="R")


def test_box_input_tab_around_a_base(spark):
    schema = "id string, domain_id int, batch_id string, equip_type string, equip_cd string, station_cd string, order_no string, box_id string, color_cd string, input_seq bigint, status string"
    def box(seq, station, status, order=None):
        order = order or f"O{seq}"
        return (f"I{seq}{station}", 1, "B", "Rack", "R1", station, order, f"X{order}", "R", seq, status)
    inputs = spark.createDataFrame([
        box(1, "S1", "F"), box(2, "S2", "F"), box(3, "S1", "R"), box(4, "S2", "W", "O3"), box(5, "S2", "W"), box(6, "S1", "W"), box(7, "S1", "W"),
    ], schema)
    jobs = spark.createDataFrame([(1, "B", "Rack", "R1", "c1", "O3", 4, 1)], "domain_id int, batch_id string, equip_type string, equip_cd string, sub_equip_cd string, order_no string, pick_qty int, picked_qty int")
    cells = spark.createDataFrame([(1, "Rack", "R1", "c1", "S1")], "domain_id int, equip_type string, equip_cd string, cell_cd string, station_cd string")
    tab = ip.box_input_tab(inputs, jobs, cells)
    got = rows(tab.filter("station_cd = 'S1'"), "screen_pos", "order_no", "has_my_jobs", "is_my_zone_is_last", "my_zone_progress_rate", "input_seq", "status")
    # Base O3 runs; O2 is before it, O5 and O6 follow. At O3 station S2 still waits, so S1 is not the last.
    assert got == [(1, "O2", 0, 0, 0.0, 2, None), (2, "O3", 1, 0, 25.0, 3, "R"), (3, "O5", 0, 0, 0.0, 5, None), (3, "O6", 1, 1, 0.0, 6, "W")]
    chosen = ip.box_input_tab(inputs, jobs, cells, selected=spark.createDataFrame([(1, "I7S1")], "domain_id int, id string"))
    assert rows(chosen.filter("station_cd = 'S1' AND screen_pos = 2"), "order_no", "is_selected_item") == [("O7", 1)]
    mine = ip.box_input_tab(inputs, jobs, cells, only_my_jobs=True)
    assert mine.filter("has_my_jobs = 0").count() == 0


def test_mapping_of_single_orders_prefers_the_job_that_holds_the_box(spark):
    schema = "id string, domain_id int, batch_id string, order_type string, box_id string, pick_qty int, picked_qty int, input_seq bigint, status string"
    jobs = spark.createDataFrame([
        ("held", 1, "B", "OT", "X", 9, 2, 4, "P"), ("small", 1, "B", "OT", None, 1, 0, 0, "W"), ("big", 1, "B", "OT", None, 5, 0, 0, "W"), ("multi", 1, "B", "MT", None, 1, 0, 0, "W"),
    ], schema)
    scanned = spark.createDataFrame([(1, "B", "X"), (1, "B", "Y"), (2, "B", "Y")], "domain_id int, batch_id string, box_id string")
    assert rows(ip.next_mapping_single(jobs, scanned), "box_id", "job_id", "qty", "is_held") == [("X", "held", 7, 1), ("Y", "small", 1, 0)]


def test_close_reasons(spark):
    batches = spark.createDataFrame([(1, n, "G", s) for n, s in [("a", "WAIT"), ("b", "RUN"), ("c", "RUN"), ("d", "RUN"), ("e", "RUN")]], "domain_id int, id string, batch_group_id string, status string")
    orders = spark.createDataFrame([(1, b) for b in "acde"], "domain_id int, batch_id string")
    jobs = spark.createDataFrame([(1, "d", "P", "R2"), (1, "e", "F", "R1"), (1, "d", "W", "R1")], "domain_id int, batch_id string, status string, equip_cd string")
    assert rows(cs.close_check(batches, orders, jobs), "batch_id", "reason") == [("a", "NOT_RUNNING"), ("b", "NO_ORDERS"), ("c", "NO_JOBS"), ("d", "OPEN_JOBS"), ("e", "OK")]
    assert ("d", "OK") in rows(cs.close_check(batches, orders, jobs, forced=True), "batch_id", "reason")
    assert rows(cs.close_check_group(batches, jobs), "running_cnt", "first_equip_cd", "open_equip_cnt", "reason") == [(4, "R1", 2, "OPEN_JOBS")]


def test_small_functions(spark):
    df = spark.createDataFrame([("AB12", "", 0, 3), ("XY99", "G", 4, 2)], "box string, color string, whole int, part int")
    got = df.select(box_type_of("box"), box_type_of("box", "1,3"), box_type_of("box", ""), box_color("color", "R"), ratio("part", "whole", 100.0)).collect()
    assert [tuple(r) for r in got] == [("A", "B1", "A", "R", 0.0), ("X", "Y9", "X", "G", 50.0)]
    assert where(df, box=["AB12", "XY99"], color=None).count() == 2
    assert rows(rowset_page(df, [F.col("box").asc()], 2, 1), "box") == [("XY99",)]
    with pytest.raises(ValueError, match="scope"):
        bx.box_duplicates(df, scope="Z")


def test_config_flags_reads_empty_as_missing(spark):
    batches = spark.createDataFrame([(1, "B", "C"), (2, "B", "C")], "domain_id int, id string, job_config_set_id string")
    configs = spark.createDataFrame([(1, "C", "dps.pick.1box.enabled", "true"), (1, "C", "dps.box.out.class.field", ""), (1, "C", "other", "x")], "domain_id int, job_config_set_id string, name string, value string")
    got = rows(ins.config_flags(batches, configs), "domain_id", "pick_1box_enabled", "box_out_class_field")
    assert got == [(1, True, None), (2, None, None)]


def test_tenants_do_not_mix(spark, small):
    seen = defaultdict(set)
    for r in pk.inspection_items(small.jobs, small.sku).select("domain_id", "batch_id").distinct().collect():
        seen[r["batch_id"][1]].add(r["domain_id"])
    assert seen == {"1": {1}, "2": {2}}
