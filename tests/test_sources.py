"""Loading and writing tables, and the flows over them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from pickflow.hooks import Hooks
from pickflow.plans.flows import confirm_picks, instruct, put_boxes_in, receive
from pickflow.schemas import SCHEMAS
from pickflow.sources import sinks
from pickflow.sources.tables import Tables, check_schema, load_tables


def test_sample_tables_have_the_declared_columns(small):
    for name in SCHEMAS:
        check_schema(name, getattr(small, name))


def test_check_schema_names_the_column(spark):
    with pytest.raises(ValueError, match="column batch_id is missing"):
        check_schema("pick_events", spark.createDataFrame([], "event_id string, domain_id int"))
    with pytest.raises(ValueError, match="domain_id is bigint"):
        check_schema("pick_events", spark.createDataFrame([], "event_id string, domain_id bigint"))
    with pytest.raises(AttributeError, match="no table"):
        Tables().orders


def test_load_checks_what_is_stored(spark, tmp_path):
    spark.createDataFrame([(1,)], "domain_id int").write.parquet(f"{tmp_path}/sku")
    with pytest.raises(ValueError, match="column com_cd is missing"):
        load_tables(spark, str(tmp_path)).sku
    spark.createDataFrame([("1", 2)], "id string, qty bigint").write.parquet(f"{tmp_path}/orders")
    with pytest.raises(ValueError, match="orders: column domain_id is missing"):
        load_tables(spark, str(tmp_path)).orders


def test_write_load_overwrite(spark, small, tmp_path):
    root = str(tmp_path)
    sinks.write_table(small.orders, f"{root}/orders")
    loaded = load_tables(spark, root).orders
    assert rows(loaded, "id", "batch_id", "status") == rows(small.orders, "id", "batch_id", "status")
    one = loaded.filter("domain_id = 1 AND batch_id = 'B1-199612'")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(domain_id" in plan
    before = loaded.count()
    sinks.overwrite_batches(one.withColumn("status", F.lit("X")), f"{root}/orders", f"{root}/staging")
    after = load_tables(spark, root).orders
    assert after.count() == before
    assert {(r["domain_id"], r["batch_id"]) for r in after.filter("status = 'X'").collect()} == {(1, "B1-199612")}
    fresh = after.filter("status = 'X'").limit(3)
    sinks.append_rows(fresh, f"{root}/orders")
    assert load_tables(spark, root).orders.count() == before + 3
    left = sinks.without_rows(after, after.filter("status = 'X'"), ["domain_id", "batch_id"])
    assert left.filter("status = 'X'").count() == 0


def test_instruct_flow(spark, small):
    waiting = small.batches.filter("status = 'WAIT'")
    calls = []

    def note(step):
        def hook(df):
            calls.append(step)
            return df
        return hook

    hooks = Hooks()
    for step in ("classify_orders", "before_instruct", "after_instruct"):
        hooks.add(step, note(step))
    done = instruct(small.replace(orders=small.received_orders), hooks)
    assert calls == ["classify_orders", "before_instruct", "after_instruct"]
    assert done.batches.count() > waiting.count()
    assert {r[0] for r in done.orders.select("status").distinct().collect()} == {"W"}
    lines = small.received_orders.join(waiting.select("domain_id", F.col("id").alias("batch_id")), ["domain_id", "batch_id"], "left_semi")
    assert done.orders.count() == lines.count()
    assert done.counts.agg(F.sum("batch_pcs")).first()[0] == lines.agg(F.sum("order_qty")).first()[0]
    with pytest.raises(ValueError, match="no step"):
        hooks.add("other", note("other"))


def test_every_hook_is_called(spark, small):
    from pickflow.hooks import STEPS
    from pickflow.operators.classify import classify_orders
    from pickflow.plans.flows import allocate_stock, cancel, merge

    called, hooks = set(), Hooks()
    for step in STEPS:
        hooks.add(step, lambda df, step=step: called.add(step) or (df.filter("false") if step == "skip_orders" else df))
    typed = small.replace(orders=classify_orders(small.received_orders))
    instruct(small.replace(orders=small.received_orders), hooks)
    merge(typed, small.merge_plan, hooks)
    cancel(small, hooks)
    few = small.replace(orders=small.orders.filter("equip_cd = 'R1' AND domain_id = 1"))
    allocate_stock(few, hooks)
    assert called == set(STEPS)


def test_box_and_pick_flows(spark, small):
    boxes = put_boxes_in(small)
    assert boxes.mapped.count() > 0
    assert boxes.inputs.groupBy("domain_id", "batch_id", "input_seq").count().filter("count > 1").count() == 0
    assert boxes.jobs.count() == small.jobs.count()
    picked = confirm_picks(small.replace(jobs=small.picking_jobs_at_start, orders=small.orders.withColumn("picked_qty", F.lit(0))), small.pick_events)
    assert picked.confirmed.agg(F.sum("applied_qty")).first()[0] == picked.orders.agg(F.sum("applied_qty")).first()[0]
    assert picked.jobs.filter("status = 'B'").count() > 0


def test_receive_flow(spark, small):
    new = receive(small.wms_if_orders, small.orders.filter("status = 'F'"), skip=F.col("com_cd") == "COM3")
    assert new.count() > 0 and new.filter("com_cd = 'COM3'").count() == 0


def test_a_second_run_keeps_what_the_first_wrote(spark, small):
    from pickflow.operators import classify as cl
    from pickflow.operators import close as cs
    from pickflow.operators import instruct as ins
    from pickflow.operators import picking as pk

    named = small.received_orders.withColumn("equip_nm", F.when(F.col("equip_cd") == "R1", "old name"))
    once = cl.assign_single_rack(named, small.racks)
    assert rows(cl.assign_single_rack(once, small.racks)) == rows(once)
    assert once.filter("equip_nm = 'old name'").count() == named.filter("equip_cd = 'R1'").count()
    split = ins.apply_split(once, small.batches, small.racks).orders
    assert split.filter("equip_nm IS NULL").count() <= once.filter("equip_nm IS NULL").count()

    stamp = F.lit("2024-01-01").cast("timestamp_ntz")
    closed = cs.close_batch(small.batches, small.orders, small.jobs, small.box_packs, small.stocks, small.racks, forced=True, finished_at=stamp).batches
    again = cs.close_batch(closed, small.orders, small.jobs, small.box_packs, small.stocks, small.racks, finished_at=F.lit(None).cast("timestamp_ntz")).batches
    assert sorted(again.columns) == sorted(closed.columns)
    assert again.filter("finished_at IS NOT NULL").count() == closed.filter("finished_at IS NOT NULL").count() > 0

    boxed = pk.jobs_after_boxing(small.jobs)
    assert rows(pk.jobs_after_boxing(boxed)) == rows(boxed)


def test_one_job_per_batch(small):
    from pickflow.operators.picking import picking_jobs

    tables = small.jobs, small.cells, small.sku, small.indicators, small.gateways
    every, some = picking_jobs(*tables), picking_jobs(*tables, only_one=True)
    assert some.count() == every.select("domain_id", "batch_id").distinct().count() > 1


def test_jobs_are_derived_with_one_shuffle_of_the_lines(small):
    plan = small.jobs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
