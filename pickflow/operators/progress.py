"""Progress and results of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickflow.functions.columns import long_sum, ratio, where
from pickflow.functions.paging import rowset_page
from pickflow.operators.inputs import input_seq_list, inputable_box_count
from pickflow.schemas import JOB_CANCELLED, KEY


def seconds_between(start: str, end: str) -> Column:
    """Seconds from ``start`` to ``end``, whatever the session time zone."""
    return F.expr(f"CAST(CAST(CAST({end} - {start} AS INTERVAL SECOND) AS DECIMAL(18, 6)) AS DOUBLE)")


def _progress(rows: DataFrame, batches: DataFrame | None) -> DataFrame:
    """Planned and actual pieces, SKUs and orders from rows (class, company, SKU, pick_qty, picked_qty).

    One pass makes both the SKU groups and the order groups; a group is done when all its pieces are picked.
    """
    by_sku, by_order = [*KEY, "com_cd", "sku_cd"], [*KEY, "class_cd"]
    groups = rows.groupingSets([by_sku, by_order], *KEY, "com_cd", "sku_cd", "class_cd").agg(
        F.sum("pick_qty").alias("_plan"), F.sum("picked_qty").alias("_actual"), F.grouping_id().alias("_level")
    )
    is_sku = F.col("_level") == 1
    done = F.col("_plan") == F.col("_actual")
    totals = groups.groupBy(*KEY).agg(
        F.sum(F.when(~is_sku, F.col("_plan"))).alias("plan_pcs"),
        F.sum(F.when(~is_sku, F.col("_actual"))).alias("actual_pcs"),
        F.count(F.when(is_sku, 1)).alias("plan_sku"),
        F.count(F.when(is_sku & done, 1)).alias("actual_sku"),
        F.count(F.when(~is_sku, 1)).alias("plan_order"),
        F.count(F.when(~is_sku & done, 1)).alias("actual_order"),
    )
    if batches is not None:
        totals = batches.select("domain_id", F.col("id").alias("batch_id")).join(totals, KEY, "left")
    counts = [f"{kind}_{unit}" for unit in ("pcs", "sku", "order") for kind in ("plan", "actual")]
    filled = totals.select(*KEY, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    return filled.withColumns({f"rate_{u}": ratio(f"actual_{u}", f"plan_{u}", 100.0) for u in ("pcs", "sku", "order")})


def batch_progress_jobs(jobs: DataFrame, batches: DataFrame | None = None, **filters) -> DataFrame:
    """Progress per batch from its jobs, cancelled ones left out; with ``batches`` empty batches show zeros."""
    rows = where(jobs, **filters).filter(~F.col("status").isin(*JOB_CANCELLED))
    columns = [*KEY, "class_cd", "com_cd", "sku_cd", "pick_qty", F.coalesce("picked_qty", F.lit(0)).alias("picked_qty")]
    return _progress(rows.select(*columns), batches)


def batch_progress_orders(orders: DataFrame, jobs: DataFrame, batches: DataFrame | None = None, **filters) -> DataFrame:
    """Progress per batch, planned from order lines and picked from jobs.

    Both sides are summed per (class, company, SKU) before they meet, so a SKU with several lines or cells counts once.
    """
    item = [*KEY, "class_cd", "com_cd", "sku_cd"]
    planned = where(orders, **filters).groupBy(*item).agg(F.sum("order_qty").alias("pick_qty"))
    picked = jobs.filter(~F.col("status").isin(*JOB_CANCELLED)).groupBy(*item).agg(F.sum("picked_qty").alias("picked_qty"))
    rows = planned.join(picked, item, "left").withColumn("picked_qty", F.coalesce("picked_qty", F.lit(0)))
    return _progress(rows, batches)


def batch_summary(orders: DataFrame, jobs: DataFrame, batches: DataFrame) -> DataFrame:
    """Progress of every batch with the number of orders that still wait for a box."""
    boxes = inputable_box_count(jobs).groupBy(*KEY).agg(F.sum("inputable_box").alias("inputable_buckets"))
    progress = batch_progress_orders(orders, jobs, batches)
    return progress.join(boxes, KEY, "left").withColumn("inputable_buckets", F.coalesce("inputable_buckets", F.lit(0)))


def batch_summary_inputs(jobs: DataFrame, page: int, limit: int) -> DataFrame:
    """The list page of the summary: the boxes put in of every batch, latest first, ``limit`` to a page."""
    order = [F.col("input_seq").desc(), F.col("order_no").asc(), F.col("box_id").asc()]
    return rowset_page(input_seq_list(jobs), order, page, limit, keys=KEY)


def batch_result(orders: DataFrame, packs: DataFrame) -> DataFrame:
    """Final result per batch: planned orders, shipped orders and boxes, pieces, box rate, pieces per hour, minutes.

    The run time goes from the first to the last change of an order line, rounded to whole hours and minutes.
    Box packs in status A or W do not count as shipped.
    """
    per_class = orders.groupBy(*KEY, "class_cd").agg(
        F.sum("picked_qty").alias("_pcs"), F.min("updated_at").alias("_first"), F.max("updated_at").alias("_last")
    )
    planned = per_class.groupBy(*KEY).agg(
        F.count("class_cd").alias("plan_order"), long_sum("_pcs").alias("actual_pcs"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    shipped = packs.filter(~F.col("status").isin("A", "W"))
    orders_out = shipped.groupBy(*KEY).agg(F.count_distinct("cust_order_no").alias("_orders"), F.count_distinct("class_cd").alias("_boxes"))
    seconds = seconds_between("_first", "_last")
    hours, minutes = F.round(seconds / 3600), F.round(seconds / 60)
    joined = planned.join(orders_out, KEY, "left").withColumns({"_hours": hours, "_minutes": minutes})
    boxes = F.coalesce("_boxes", F.lit(0))
    return joined.select(
        *KEY,
        "plan_order",
        F.coalesce("_orders", F.lit(0)).alias("actual_order"),
        boxes.alias("actual_sku"),
        "actual_pcs",
        F.when(F.col("plan_order") > 0, F.round(boxes * 100.0 / F.col("plan_order"), 1)).otherwise(0.0).alias("rate_order"),
        F.when(F.col("_hours") > 0, F.round(F.col("actual_pcs") / F.col("_hours"), 1)).otherwise(0.0).alias("uph"),
        F.col("_minutes").alias("rate_sku"),
    )


def batch_result_jobs(jobs: DataFrame) -> DataFrame:
    """Result per batch from its jobs: orders with an ended pick, pieces, progress and pieces per hour.

    Batches without an ended pick are left out.
    """
    ended = F.col("pick_ended_at").isNotNull() & (F.col("picked_qty") > 0)
    per_class = jobs.groupBy(*KEY, "class_cd").agg(
        F.max(ended).alias("_ended"),
        F.sum("pick_qty").alias("_plan"),
        F.sum("picked_qty").alias("_picked"),
        F.min("pick_started_at").alias("_first"),
        F.max("pick_ended_at").alias("_last"),
    )
    totals = per_class.groupBy(*KEY).agg(
        F.count_if("_ended").alias("actual_order"),
        F.sum("_plan").alias("_plan"),
        long_sum("_picked").alias("actual_pcs"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )
    hours = F.round(seconds_between("_first", "_last") / 3600, 2)
    return (
        totals.filter("actual_order > 0")
        .withColumn("_hours", hours)
        .select(
            *KEY,
            "actual_order",
            "actual_pcs",
            ratio("actual_pcs", "_plan", 100.0).alias("progress_rate"),
            F.when(F.col("_hours") > 0, F.round(F.col("actual_pcs") / F.col("_hours"), 2)).otherwise(0.0).alias("job_uph"),
        )
    )
