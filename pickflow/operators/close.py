"""Closing batches and moving them to another rack."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickflow.functions.running import row_numbers
from pickflow.operators.progress import batch_result
from pickflow.schemas import BATCH_END, BATCH_READY, BATCH_RUNNING, BATCH_WAIT, JOB_WIPC, KEY

OK, NOT_RUNNING, NO_ORDERS, NO_JOBS, OPEN_JOBS = "OK", "NOT_RUNNING", "NO_ORDERS", "NO_JOBS", "OPEN_JOBS"
SAME_RACK, STARTED, CELL_COUNT = "SAME_RACK", "STARTED", "CELL_COUNT"


def close_check(batches: DataFrame, orders: DataFrame, jobs: DataFrame, *, forced: bool = False) -> DataFrame:
    """May a batch be closed, and if not, why: it does not run, has no orders, no jobs, or open jobs."""
    lines = orders.groupBy(*KEY).agg(F.count("*").alias("_lines"))
    work = jobs.groupBy(*KEY).agg(F.count("*").alias("_jobs"), F.count_if(F.col("status").isin(*JOB_WIPC)).alias("_open"))
    joined = batches.withColumnRenamed("id", "batch_id").join(lines, KEY, "left").join(work, KEY, "left")
    reason = (
        F.when(~F.col("status").eqNullSafe(BATCH_RUNNING), NOT_RUNNING)
        .when(F.col("_lines").isNull(), NO_ORDERS)
        .when(F.col("_jobs").isNull(), NO_JOBS)
        .when((F.col("_open") > 0) & (not forced), OPEN_JOBS)
        .otherwise(OK)
    )
    return joined.select(*KEY, reason.alias("reason"))


def close_check_group(batches: DataFrame, jobs: DataFrame, *, forced: bool = False) -> DataFrame:
    """May a batch group be closed: running batches, and the racks with open jobs (the first and how many)."""
    group = ["domain_id", "batch_group_id"]
    running = batches.groupBy(*group).agg(F.count_if(F.col("status") == BATCH_RUNNING).alias("running_cnt"))
    open_racks = jobs.filter(F.col("status").isin(*JOB_WIPC)).select(*KEY, "equip_cd").distinct()
    per_group = (
        open_racks.join(batches.select("domain_id", F.col("id").alias("batch_id"), "batch_group_id"), KEY)
        .groupBy(*group)
        .agg(F.min("equip_cd").alias("first_equip_cd"), F.count_distinct("equip_cd").alias("open_equip_cnt"))
    )
    joined = running.join(per_group, group, "left")
    count = F.coalesce("open_equip_cnt", F.lit(0))
    reason = F.when(F.col("running_cnt") == 0, NOT_RUNNING).when((count > 0) & (not forced), OPEN_JOBS).otherwise(OK)
    return joined.select(*group, "running_cnt", "first_equip_cd", count.alias("open_equip_cnt"), reason.alias("reason"))


class ClosedBatches(NamedTuple):
    batches: DataFrame
    stocks: DataFrame
    racks: DataFrame
    preprocesses: DataFrame | None
    work_cells: DataFrame | None


def close_batch(
    batches: DataFrame,
    orders: DataFrame,
    jobs: DataFrame,
    packs: DataFrame,
    stocks: DataFrame,
    racks: DataFrame,
    preprocesses: DataFrame | None = None,
    work_cells: DataFrame | None = None,
    *,
    forced: bool = False,
    finished_at: Column | None = None,
) -> ClosedBatches:
    """Close every given batch that passes ``close_check``.

    Stock that is not fixed on the racks of a closed batch is emptied, the racks are freed, work rows go, and the
    batch is END with its result.
    """
    closed = close_check(batches, orders, jobs, forced=forced).filter(F.col("reason") == OK).select(*KEY)
    result = batch_result(orders, packs).join(closed, KEY, "left_semi").withColumnRenamed("batch_id", "id")
    columns = {
        "actual_order": "result_order_qty",
        "actual_sku": "result_box_qty",
        "actual_pcs": "result_pcs",
        "rate_order": "progress_rate",
        "uph": "uph",
        "rate_sku": "equip_runtime",
    }
    outcome = result.select("domain_id", "id", *[F.col(c).alias(f"_{n}") for c, n in columns.items()], F.lit(True).alias("_closed"))
    stamp = F.lit(None).cast("timestamp_ntz") if finished_at is None else finished_at
    # a batch that is not closed now keeps what an earlier run has written
    had = {c: F.col(f"b.{c}") if c in batches.columns else F.lit(None) for c in (*columns.values(), "finished_at")}
    new = {**{c: F.col(f"o._{c}") for c in columns.values()}, "finished_at": stamp}
    kept = [F.col(f"b.{c}") for c in batches.columns if c not in ("status", *had)]
    done = F.col("o._closed")
    batches_after = batches.alias("b").join(outcome.alias("o"), ["domain_id", "id"], "left").select(
        *kept,
        F.when(done, BATCH_END).otherwise(F.col("b.status")).alias("status"),
        *[F.when(done, new[c]).otherwise(had[c]).alias(c) for c in had],
    )
    freed = racks.join(closed.withColumn("_free", F.lit(True)), KEY, "left")
    racks_after = freed.withColumns(
        {"status": F.when(F.col("_free").isNull(), F.col("status")), "batch_id": F.when(F.col("_free").isNull(), F.col("batch_id"))}
    ).drop("_free")
    emptied = freed.filter("_free").select("domain_id", F.col("rack_cd").alias("equip_cd"), F.lit(True).alias("_empty")).distinct()
    loose = F.col("_empty") & ~F.coalesce("fixed_flag", F.lit(False))
    stocks_after = (
        stocks.join(emptied, ["domain_id", "equip_cd"], "left")
        .withColumns(
            {
                "sku_cd": F.when(~F.coalesce(loose, F.lit(False)), F.col("sku_cd")),
                **{c: F.when(loose, 0).otherwise(F.col(c)) for c in ("load_qty", "alloc_qty")},
            }
        )
        .drop("_empty")
    )
    dropped = [None if t is None else t.join(closed, KEY, "left_anti") for t in (preprocesses, work_cells)]
    return ClosedBatches(batches_after, stocks_after, racks_after, *dropped)


def change_equipment_check(batches: DataFrame, cells: DataFrame, requests: DataFrame) -> DataFrame:
    """May a batch move to another rack (requests: domain_id, batch_id, to_equip_cd), and if not, why."""
    active = cells.filter("active_flag").groupBy("domain_id", "equip_type", "equip_cd").agg(F.count("*").alias("_cells"))
    from_cells = active.withColumnRenamed("_cells", "_from")
    to_cells = active.select("domain_id", "equip_type", F.col("equip_cd").alias("to_equip_cd"), F.col("_cells").alias("_to"))
    joined = (
        requests.join(batches.withColumnRenamed("id", "batch_id"), KEY)
        .join(from_cells, ["domain_id", "equip_type", "equip_cd"], "left")
        .join(to_cells, ["domain_id", "equip_type", "to_equip_cd"], "left")
    )
    same = F.coalesce(F.lower("equip_cd") == F.lower("to_equip_cd"), F.lit(False))
    reason = (
        F.when(same, SAME_RACK)
        .when(~F.coalesce(F.col("status").isin(BATCH_WAIT, BATCH_READY), F.lit(False)), STARTED)
        .when(F.coalesce("_from", F.lit(0)) != F.coalesce("_to", F.lit(0)), CELL_COUNT)
        .otherwise(OK)
    )
    return joined.select(*KEY, "equip_type", "equip_cd", "to_equip_cd", reason.alias("reason"))


def change_equipment(lines: DataFrame, batches: DataFrame, cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Order lines (or preprocess rows) after the allowed moves: the i-th cell of the old rack becomes the i-th of the new."""
    moves = change_equipment_check(batches, cells, requests).filter(F.col("reason") == OK)
    place = ["domain_id", "equip_type", "equip_cd"]
    numbered = row_numbers(cells.select(*place, "cell_cd", "cell_seq"), place, [F.col("cell_seq").asc_nulls_last(), F.col("cell_cd").asc()])
    source = numbered.select(*place, F.col("cell_cd").alias("sub_equip_cd"), "rn")
    target = numbered.select("domain_id", "equip_type", F.col("equip_cd").alias("to_equip_cd"), F.col("cell_cd").alias("_to_cell"), "rn")
    mapping = moves.join(source, place).join(target, ["domain_id", "equip_type", "to_equip_cd", "rn"])
    mapping = mapping.select(*KEY, "sub_equip_cd", F.col("to_equip_cd").alias("_to_equip"), "_to_cell")
    return (
        lines.join(mapping, [*KEY, "sub_equip_cd"], "left")
        .withColumns({"equip_cd": F.coalesce("_to_equip", "equip_cd"), "sub_equip_cd": F.coalesce("_to_cell", "sub_equip_cd")})
        .drop("_to_equip", "_to_cell")
    )


def batches_after_change(batches: DataFrame, cells: DataFrame, requests: DataFrame) -> DataFrame:
    """Batches on their new rack."""
    moves = change_equipment_check(batches, cells, requests).filter(F.col("reason") == OK)
    new = moves.select("domain_id", F.col("batch_id").alias("id"), "to_equip_cd")
    return batches.join(new, ["domain_id", "id"], "left").withColumn("equip_cd", F.coalesce("to_equip_cd", "equip_cd")).drop("to_equip_cd")
