"""Receiving order lines from the upstream interface table, and taking a receipt back."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickflow.functions.columns import natural_id, where
from pickflow.schemas import (
    BATCH_CANCELLED,
    BATCH_READY,
    BATCH_WAIT,
    ORDER_CANCELLED,
    ORDER_WAIT,
    RECEIPT_ERROR,
    RECEIPT_FINISHED,
    RECEIPT_SKIPPED,
    RECEIPT_WAIT,
)

RECEIPT_KEYS = (
    "domain_id wms_batch_no wcs_batch_no com_cd area_cd stage_cd job_date job_type equip_type equip_cd".split()
)
LINE_KEYS = ["domain_id", "order_no", "order_line_no", "com_cd", "sku_cd"]
# Columns copied as they are from the interface table to ORDERS.
COPIED = (
    "job_date job_type order_no order_line_no com_cd area_cd stage_cd equip_type equip_cd shop_cd sku_cd"
    " box_type_cd order_qty"
).split()
# What else an order line takes over where the interface table has it.
OPTIONAL = (
    "order_date order_detail_id cust_order_no cust_order_line_no equip_nm sub_equip_cd shop_nm sku_barcd sku_nm box_in_qty"
    " boxed_qty cancel_qty box_id invoice_id order_type pack_type lot_no from_zone_cd from_cell_cd to_zone_cd to_cell_cd"
).split()
# Job types whose batches are ready once they are received; others wait.
READY_JOB_TYPES = ("DPS",)
ITEM_KEYS = ["domain_id", "com_cd", "area_cd", "stage_cd", "wms_batch_no"]


def receive_summary(wms_if_orders: DataFrame, **filters) -> DataFrame:
    """One receipt item per upstream batch with rows that were not received yet.

    ``filters`` may name com_cd, area_cd, stage_cd or job_date.
    """
    return (
        where(wms_if_orders, if_flag="N", **filters)
        .groupBy(*RECEIPT_KEYS)
        .agg(
            F.count_distinct("order_no").alias("total_orders"),
            F.sum("order_qty").cast("bigint").alias("total_pcs"),
            F.count("*").alias("total_records"),
        )
        .withColumns({"item_type": F.lit("order"), "status": F.lit(RECEIPT_WAIT), "skip_flag": F.lit(0)})
    )


def receipt_items(summary: DataFrame, skip: Column | None = None) -> DataFrame:
    """Give every receipt item its batch id (from the upstream batch number) and its skip flag."""
    skipped = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    return summary.withColumns(
        {"batch_id": F.concat(F.lit("RB-"), "wms_batch_no"), "job_seq": F.lit("1"), "skip_flag": skipped.cast("int")}
    )


def receive_orders(
    wms_if_orders: DataFrame, items: DataFrame, existing: DataFrame | None = None, *, class_column: str = "order_no", optional: Sequence[str] = ()
) -> DataFrame:
    """New ORDERS rows for the receipt items that are not skipped; ``optional`` columns are taken over as they are.

    ``class_cd`` comes from ``class_column``. Lines already in ``existing`` are left out, so a repeated
    run adds nothing.
    """
    wanted = items.filter("skip_flag = 0").select("domain_id", "com_cd", "area_cd", "stage_cd", "wms_batch_no", "batch_id", "job_seq")
    # Several items of one upstream batch differ only by equipment and share the batch id.
    wanted = wanted.distinct()
    fresh = wms_if_orders.filter("if_flag = 'N'").join(wanted, ["domain_id", "com_cd", "area_cd", "stage_cd", "wms_batch_no"])
    if existing is not None:
        fresh = fresh.join(existing.select(*LINE_KEYS), LINE_KEYS, "left_anti")
    return fresh.select(
        "domain_id",
        "batch_id",
        "job_seq",
        "wms_batch_no",
        "wcs_batch_no",
        *COPIED,
        *optional,
        F.col(class_column).alias("class_cd"),
        F.lit(0).alias("picked_qty"),
        F.lit(ORDER_WAIT).alias("status"),
    )


class Receipt(NamedTuple):
    orders: DataFrame
    batches: DataFrame
    items: DataFrame


def faulty_items(wms_if_orders: DataFrame, items: DataFrame) -> DataFrame:
    """Keys of the receipt items with a line that cannot become an order line: no order, line, SKU or quantity."""
    bad = F.col("order_no").isNull() | F.col("order_line_no").isNull() | F.col("sku_cd").isNull() | ~F.coalesce(F.col("order_qty") > 0, F.lit(False))
    lines = wms_if_orders.filter("if_flag = 'N'").filter(bad).select(*ITEM_KEYS).distinct()
    return lines.join(items.select(*ITEM_KEYS).distinct(), ITEM_KEYS, "left_semi")


def receive_batch(
    wms_if_orders: DataFrame, items: DataFrame, existing: DataFrame | None = None, *, class_column: str = "order_no"
) -> Receipt:
    """A whole receipt: order lines with their ids and all columns the interface table has, new batches, items after it.

    An item is received as a whole or, if one of its lines is faulty, not at all (status E). Batches of a job type in
    ``READY_JOB_TYPES`` are READY, others WAIT. Given order types are kept. A batch of several items takes the place of
    the first by company, area and stage.
    """
    faulty = faulty_items(wms_if_orders, items)
    good = items.join(faulty, ITEM_KEYS, "left_anti")
    optional = [c for c in OPTIONAL if c in wms_if_orders.columns]
    lines = receive_orders(wms_if_orders, good, existing, class_column=class_column, optional=optional)
    lines = lines.withColumn("id", natural_id("domain_id", "batch_id", *LINE_KEYS[1:]))
    # Only an item that brings lines makes a batch.
    first = F.min(F.struct("com_cd", "area_cd", "stage_cd", "equip_type", "equip_cd", "job_date", "job_seq", "job_type", "wms_batch_no")).alias("_i")
    made = good.filter("skip_flag = 0").groupBy("domain_id", F.col("batch_id").alias("id")).agg(first).select("domain_id", "id", "_i.*")
    status = F.when(F.col("job_type").isin(*READY_JOB_TYPES), BATCH_READY).otherwise(BATCH_WAIT)
    batches = made.withColumns({"batch_group_id": F.col("id"), "status": status})
    marked = receipt_items_after(items).join(faulty.withColumn("_bad", F.lit(True)), ITEM_KEYS, "left")
    failed = F.col("_bad") & (F.col("skip_flag") == 0)
    return Receipt(lines, batches, marked.withColumn("status", F.when(failed, RECEIPT_ERROR).otherwise(F.col("status"))).drop("_bad"))


def receipt_items_after(items: DataFrame) -> DataFrame:
    """Receipt items once the receipt ran: skipped ones stay out, the others are finished."""
    done = F.when(F.col("skip_flag") == 1, RECEIPT_SKIPPED).otherwise(RECEIPT_FINISHED)
    return items.withColumn("status", done)


class CancelledReceipt(NamedTuple):
    orders: DataFrame
    batches: DataFrame
    preprocesses: DataFrame | None


def cancel_receipt(
    orders: DataFrame, batches: DataFrame, preprocesses: DataFrame | None = None, *, mode: str = "keep"
) -> CancelledReceipt:
    """Take back the receipt of all given batches that still wait; other batches stay as they are.

    ``keep`` marks orders and batch as cancelled, ``delete`` removes them. Preprocess rows go in both cases.
    """
    if mode not in ("keep", "delete"):
        raise ValueError(f"mode must be keep or delete, not {mode!r}")
    waiting = F.col("status").isin(BATCH_WAIT, BATCH_READY)
    cancelled = batches.filter(waiting).select("domain_id", F.col("id").alias("batch_id"))
    if preprocesses is not None:
        preprocesses = preprocesses.join(cancelled, ["domain_id", "batch_id"], "left_anti")
    if mode == "delete":
        kept = orders.join(cancelled, ["domain_id", "batch_id"], "left_anti")
        return CancelledReceipt(kept, batches.filter(~F.coalesce(waiting, F.lit(False))), preprocesses)
    marked = orders.join(cancelled.withColumn("_cancelled", F.lit(True)), ["domain_id", "batch_id"], "left")
    marked = marked.withColumns(
        {
            "status": F.when(F.col("_cancelled"), ORDER_CANCELLED).otherwise(F.col("status")),
            "job_seq": F.when(F.col("_cancelled"), "0").otherwise(F.col("job_seq")),
        }
    ).drop("_cancelled")
    after = batches.withColumn("status", F.when(waiting, BATCH_CANCELLED).otherwise(F.col("status")))
    return CancelledReceipt(marked, after, preprocesses)
