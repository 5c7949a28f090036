"""Whole flows, composed of the operators: receive, instruct, allocate, put boxes in, confirm picks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickflow.hooks import Hooks
from pickflow.operators import allocate as al
from pickflow.operators import classify as cl
from pickflow.operators import inputs as ip
from pickflow.operators import instruct as ins
from pickflow.operators import picking as pk
from pickflow.operators import receive as rc
from pickflow.schemas import BATCH_READY, BATCH_RUNNING, BATCH_WAIT, ORDER_WAIT
from pickflow.session import cut_lineage
from pickflow.sources.tables import Tables


def receive(wms_if_orders: DataFrame, existing: DataFrame, *, skip: Column | None = None, class_column: str = "order_no") -> DataFrame:
    """New order lines of all open receipts."""
    items = rc.receipt_items(rc.receive_summary(wms_if_orders), skip)
    return rc.receive_orders(wms_if_orders, items, existing, class_column=class_column)


class Instructed(NamedTuple):
    orders: DataFrame
    batches: DataFrame
    racks: DataFrame
    counts: DataFrame


def instruct(t: Tables, hooks: Hooks | None = None, *, now: Column | None = None) -> Instructed:
    """Instruct all batches that wait: racks, class codes, types, split by rack, status, counts.

    Tables used: orders, batches, racks, configs.
    """
    hooks = hooks or Hooks()
    todo = t.batches.filter(F.col("status").isin(BATCH_WAIT, BATCH_READY))
    lines = t.orders.join(todo.select("domain_id", F.col("id").alias("batch_id")), ["domain_id", "batch_id"], "left_semi")
    flags = ins.config_flags(todo, t.configs)
    coded = cl.apply_class_codes(cl.assign_single_rack(lines, t.racks), flags)
    typed = hooks.apply("classify_orders", cl.classify_orders(coded))
    split = ins.apply_split(hooks.apply("before_instruct", hooks.apply("recommend_cells", typed)), todo, t.racks)
    orders = hooks.apply("total_picking", hooks.apply("after_instruct", ins.instruct_orders(split.orders, split.batches)))
    counts = ins.batch_counts(orders, split.batches, now)
    started = split.batches.withColumn("status", F.lit(BATCH_RUNNING))
    racks = ins.mark_racks(split.racks, orders, split.batches)
    return Instructed(orders, started, racks, counts)


def merge(t: Tables, mapping: DataFrame, hooks: Hooks | None = None, *, now: Column | None = None) -> ins.MergeResult:
    """Merge the batches of ``mapping`` into running ones: orders, batches, single-pack jobs and counts after it.

    Tables used: orders (typed), batches, racks, sku.
    """
    hooks = hooks or Hooks()
    done = ins.merge_with_jobs(hooks.apply("before_merge", t.orders), t.batches, mapping, t.racks, t.sku, now=now)
    return done._replace(orders=hooks.apply("after_merge", done.orders))


def cancel(t: Tables, hooks: Hooks | None = None) -> ins.CancelledInstruction:
    """Take back the instruction of the given batches where no job has begun.

    Tables used: orders, batches, jobs, racks.
    """
    hooks = hooks or Hooks()
    done = ins.cancel_instruction(hooks.apply("before_cancel", t.orders), t.batches, t.jobs, t.racks)
    return done._replace(orders=hooks.apply("after_cancel", done.orders))


class Allocated(NamedTuple):
    allocations: DataFrame
    jobs: DataFrame
    stocks: DataFrame
    orders: DataFrame


def allocate_stock(t: Tables, hooks: Hooks | None = None, *, wave: str = "equip", status: str = ORDER_WAIT) -> Allocated:
    """Allocate stock to the orders in ``status``; new jobs, stock and orders after it.

    A ``skip_orders`` hook gets those order lines and returns the ones that must be left out, a ``request_box`` hook gets
    the new jobs. Tables used: orders, stocks, cells, batches, configs.
    """
    skip = None
    if hooks is not None:
        waiting = t.orders.filter(F.col("status") == status)
        chosen = hooks.apply("skip_orders", waiting)
        skip = None if chosen is waiting else chosen
    # The result feeds three tables, so it is computed once.
    allocations = cut_lineage(al.allocate(t.orders, t.stocks, t.cells, t.batches, wave=wave, skip=skip, status=status))
    flags = ins.config_flags(t.batches, t.configs)
    jobs = al.create_jobs(t.orders, allocations, flags)
    jobs = jobs if hooks is None else hooks.apply("request_box", jobs)
    return Allocated(allocations, jobs, al.stock_after(t.stocks, allocations), al.orders_after(t.orders, allocations, status=status))


class BoxesPutIn(NamedTuple):
    mapped: DataFrame
    inputs: DataFrame
    jobs: DataFrame


def put_boxes_in(t: Tables, *, default_color: Column | str = "R", input_at: Column | None = None) -> BoxesPutIn:
    """Map arriving boxes to waiting orders; the new input rows and the jobs after it.

    Tables used: jobs, inputs, arrivals, cells.
    """
    mapped = cut_lineage(ip.map_boxes(t.jobs, t.inputs, t.arrivals, default_color=default_color))
    new_inputs = cut_lineage(ip.create_inputs(ip.new_input_rows(t.jobs, t.cells, mapped), mapped, t.inputs))
    return BoxesPutIn(mapped, new_inputs, ip.apply_box_mapping(t.jobs, t.cells, new_inputs, input_at=input_at))


class Picked(NamedTuple):
    confirmed: DataFrame
    jobs: DataFrame
    orders: DataFrame
    stocks: DataFrame
    inputs: DataFrame


def confirm_picks(t: Tables, events: DataFrame) -> Picked:
    """Confirm pick events: jobs (boxed where complete), order lines that changed, stock and inputs after it.

    Tables used: jobs, orders, stocks, inputs, cells.
    """
    confirmed = cut_lineage(pk.confirm_pick(t.jobs, events))
    jobs = pk.jobs_after_confirm(t.jobs, confirmed)
    place = ["order_no", "com_cd", "sku_cd", "equip_type", "equip_cd", "sub_equip_cd"]
    key = ["domain_id", "batch_id", "id"]
    picks = confirmed.select(*key, "applied_qty").join(t.jobs.select(*key, *place), key)
    return Picked(
        confirmed,
        pk.jobs_after_boxing(jobs),
        pk.pick_to_orders(t.orders, picks, qty="applied_qty"),
        pk.stock_after_pick(t.stocks, picks, qty="applied_qty"),
        pk.inputs_after_picking(t.inputs, jobs, t.cells),
    )
