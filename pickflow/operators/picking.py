"""Pick job lists, pick confirmation and its effects on orders, stock and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickflow.functions.columns import flag, long_sum, never_broadcast, where
from pickflow.functions.running import running_totals
from pickflow.schemas import (
    INPUT_FINISHED,
    JOB_BOXED,
    JOB_FINISHED,
    JOB_PICKING,
    JOB_WIP,
    JOB_WIPF,
    KEY,
    ORDER_FINISHED,
    ORDER_RUNNING,
    SINGLE,
)

JOB_FILTERS = "id batch_id input_seq com_cd status class_cd box_class_cd box_id order_no sku_cd order_type".split()
CELL_FILTERS = "equip_type equip_cd station_cd equip_zone_cd side_cd ind_cd".split()


def picking_jobs(
    jobs: DataFrame,
    cells: DataFrame,
    sku: DataFrame,
    indicators: DataFrame,
    gateways: DataFrame,
    *,
    input_seq_is_blank: bool = False,
    latest_running: DataFrame | None = None,
    running_status: str = "R",
    exclude_cell_cd: str | None = None,
    gw_cd: str | None = None,
    restore: bool = False,
    only_one: bool = False,
    **filters,
) -> DataFrame:
    """Jobs with cell, SKU, indicator and gateway; a missing indicator or gateway keeps the job.

    ``filters`` are equalities (a list means membership) on the job and cell columns in ``JOB_FILTERS`` and
    ``CELL_FILTERS``. ``latest_running`` is the input table: only jobs of the latest running input of their
    batch stay. ``restore`` keeps the jobs with the lowest sequence in picking of their cell. ``only_one``
    keeps the first row by gateway, station, cell and id.
    """
    unknown = set(filters) - set(JOB_FILTERS) - set(CELL_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    rows = where(jobs, **{k: v for k, v in filters.items() if k in JOB_FILTERS})
    if input_seq_is_blank:
        rows = rows.filter("input_seq IS NULL OR input_seq = 0")
    if latest_running is not None:
        latest = where(latest_running, status=running_status).groupBy(*KEY).agg(F.max("input_seq").alias("input_seq"))
        rows = rows.join(latest, [*KEY, "input_seq"], "left_semi")
    if restore:
        lowest = where(jobs, status=JOB_PICKING).groupBy(*KEY, "sub_equip_cd").agg(F.min("input_seq").alias("input_seq"))
        rows = rows.join(lowest, [*KEY, "sub_equip_cd", "input_seq"], "left_semi")
    places = where(cells, **{k: v for k, v in filters.items() if k in CELL_FILTERS})
    if exclude_cell_cd is not None:
        places = places.filter(F.col("cell_cd") != exclude_cell_cd)
    places = places.select("domain_id", "equip_type", "equip_cd", F.col("cell_cd").alias("sub_equip_cd"), "side_cd", F.col("station_cd").alias("_station"), F.col("ind_cd").alias("_ind"))
    lights = indicators.select("domain_id", F.col("ind_cd").alias("_ind"), F.col("gw_cd").alias("_gw"))
    routers = gateways.select("domain_id", F.col("gw_cd").alias("_gw"), F.col("gw_nm").alias("gw_path"), F.lit(True).alias("_has_gw"))
    names = never_broadcast(sku.select("domain_id", "com_cd", "sku_cd", "sku_barcd", F.col("sku_nm").alias("_sku_nm")))
    joined = (
        rows.join(places, ["domain_id", "equip_type", "equip_cd", "sub_equip_cd"])
        .join(names, ["domain_id", "com_cd", "sku_cd"])
        .join(lights, ["domain_id", "_ind"], "left")
        .join(routers, ["domain_id", "_gw"], "left")
    )
    if gw_cd is not None:
        joined = joined.filter((F.col("_gw") == gw_cd) & F.col("_has_gw"))
    optional = {c: F.col(c) if c in jobs.columns else F.lit(default) for c, default in (("picking_qty", 0), ("box_in_qty", None), ("sku_nm", None))}
    result = joined.select(
        "domain_id",
        "id",
        "batch_id",
        "stage_cd",
        "com_cd",
        "job_type",
        "input_seq",
        "equip_type",
        "equip_cd",
        "sub_equip_cd",
        F.col("_ind").alias("ind_cd"),
        F.coalesce("color_cd", F.lit("R")).alias("color_cd"),
        F.coalesce("pick_qty", F.lit(0)).alias("pick_qty"),
        F.coalesce(optional["picking_qty"], F.lit(0)).alias("picking_qty"),
        F.coalesce("picked_qty", F.lit(0)).alias("picked_qty"),
        optional["box_in_qty"].cast("int").alias("box_in_qty"),
        "gw_path",
        "side_cd",
        F.col("_station").alias("station_cd"),
        "order_no",
        "sku_cd",
        "sku_barcd",
        F.coalesce(optional["sku_nm"].cast("string"), F.col("_sku_nm")).alias("sku_nm"),
        "status",
        "box_id",
        "box_type_cd",
        "invoice_id",
        "order_type",
        "class_cd",
        "box_class_cd",
        "pick_started_at",
        "pick_ended_at",
    )
    if only_one:
        order = [F.col(c).asc_nulls_last() for c in ("gw_path", "station_cd", "sub_equip_cd", "id")]
        return result.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).filter("_n = 1").drop("_n")
    return result


def job_indicator(jobs: DataFrame, cells: DataFrame, indicators: DataFrame, gateways: DataFrame) -> DataFrame:
    """Indicator and gateway path of every job from its active cell, else what the job already has."""
    places = cells.filter("active_flag").select("domain_id", "equip_cd", F.col("cell_cd").alias("sub_equip_cd"), F.col("ind_cd").alias("_ind"))
    lights = indicators.select("domain_id", F.col("ind_cd").alias("_ind"), F.col("gw_cd").alias("_gw"))
    routers = gateways.select("domain_id", F.col("gw_cd").alias("_gw"), F.col("gw_nm").alias("gw_path"), F.col("stage_cd"))
    lit_cells = places.join(lights, ["domain_id", "_ind"]).join(routers, ["domain_id", "_gw"])
    return (
        jobs.join(lit_cells, ["domain_id", "stage_cd", "equip_cd", "sub_equip_cd"], "left")
        .withColumn("ind_cd", F.coalesce("_ind", "ind_cd"))
        .drop("_ind", "_gw")
    )


def order_items(jobs: DataFrame, orders: DataFrame | None = None, **filters) -> DataFrame:
    """Jobs of orders: those in ``orders`` (domain_id, batch_id, order_no), or those the filters name."""
    rows = where(jobs, **filters)
    return rows if orders is None else rows.join(orders.select(*KEY, "order_no"), [*KEY, "order_no"], "left_semi")


def single_pack_summary(jobs: DataFrame, *, job_pcs: int | None = None, job_box_type: str | None = None) -> DataFrame:
    """Single-order jobs per SKU: all and completed boxes, and the same per (pieces, box type)."""
    sku_key = [*KEY, "sku_cd"]
    waiting = flag(F.col("status").isin("W", "P"))
    per_kind = where(jobs, order_type=SINGLE).groupBy(*sku_key, "pick_qty", "box_type_cd").agg(
        F.count("*").alias("tot_order_cnt"), (F.count("*") - F.sum(waiting)).alias("comp_order_cnt")
    )
    per_sku = per_kind.groupBy(*sku_key).agg(
        F.sum("tot_order_cnt").alias("tot_cnt"), F.sum("comp_order_cnt").alias("comp_cnt")
    )
    chosen = F.lit(0)
    if job_box_type is not None:
        chosen = flag((F.col("pick_qty") == job_pcs) & (F.col("box_type_cd") == job_box_type))
    return per_sku.join(per_kind, sku_key).withColumn("selected_job", chosen)


def confirm_pick(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs after all pick events (event_id, domain_id, batch_id, job_id, ts, qty), one row per job with events.

    Only jobs in picking take picks. The picked quantity is capped to the planned one; the first event sets the
    start, the event that fills the job sets the end and status F. Equal times follow the event id.
    """
    open_jobs = where(jobs, status=JOB_PICKING).filter("picked_qty < pick_qty")
    job_key = [*KEY, "job_id"]
    picks = events.filter("qty > 0").select(*job_key, "event_id", "ts", "qty")
    taken = open_jobs.select(*KEY, F.col("id").alias("job_id"), "pick_qty", F.col("picked_qty").alias("_had"), "pick_started_at").join(picks, job_key)
    cumulated = running_totals(taken, job_key, [F.col("ts").asc(), F.col("event_id").asc()], {"_upto": F.col("qty")})
    reached = F.col("_had") + F.col("_upto")
    done = cumulated.groupBy(*KEY, "job_id").agg(
        F.max("pick_qty").alias("pick_qty"),
        F.least(F.max("pick_qty"), F.max(reached)).cast("int").alias("picked_qty"),
        (F.least(F.max("pick_qty"), F.max(reached)) - F.max("_had")).cast("int").alias("applied_qty"),
        F.coalesce(F.max("pick_started_at"), F.min("ts")).alias("pick_started_at"),
        F.min(F.when(reached >= F.col("pick_qty"), F.col("ts"))).alias("pick_ended_at"),
    )
    full = F.col("picked_qty") >= F.col("pick_qty")
    return done.select(
        F.col("job_id").alias("id"),
        *KEY,
        "picked_qty",
        F.lit(0).alias("picking_qty"),
        "applied_qty",
        F.when(full, JOB_FINISHED).otherwise(JOB_PICKING).alias("status"),
        "pick_started_at",
        "pick_ended_at",
    )


def jobs_after_confirm(jobs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The full job table with the confirmed picks in place."""
    changed = ["picked_qty", "status", "pick_started_at", "pick_ended_at"]
    new = confirmed.select(*KEY, "id", *[F.col(c).alias(f"_{c}") for c in changed])
    hit = F.col("_status").isNotNull()
    joined = jobs.join(new, [*KEY, "id"], "left")
    return joined.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in changed}).drop(*[f"_{c}" for c in changed])


def pick_to_orders(orders: DataFrame, picks: DataFrame, *, qty: str = "picked_qty") -> DataFrame:
    """Spread picked pieces per (order, company, SKU) over the open order lines, least picked first.

    ``picks`` are jobs with the newly picked quantity in column ``qty``. A line is F when full, else R. Only
    lines that get pieces are returned.
    """
    group = [*KEY, "order_no", "com_cd", "sku_cd"]
    picked = picks.groupBy(*group).agg(F.sum(qty).cast("bigint").alias("_picked")).filter("_picked > 0")
    open_lines = orders.select(*group, "id", "order_qty", "picked_qty").filter("order_qty > picked_qty")
    lines = open_lines.join(picked, group)
    room = F.col("order_qty") - F.col("picked_qty")
    placed = running_totals(lines, group, [F.col("picked_qty").asc(), F.col("id").asc()], {"_room": room})
    share = F.greatest(F.lit(0), F.least(room, F.col("_picked") - (F.col("_room") - room))).cast("int")
    return (
        placed.withColumn("applied_qty", share)
        .filter("applied_qty > 0")
        .withColumn("picked_qty", F.col("picked_qty") + F.col("applied_qty"))
        .select(
            "id",
            *group,
            "applied_qty",
            "picked_qty",
            F.when(F.col("picked_qty") >= F.col("order_qty"), ORDER_FINISHED).otherwise(ORDER_RUNNING).alias("status"),
        )
    )


def stock_after_pick(stocks: DataFrame, picks: DataFrame, *, qty: str = "picked_qty") -> DataFrame:
    """Stock rows with the pieces picked from their (cell, company, SKU) and what is left on the cell."""
    place = ["domain_id", "equip_type", "equip_cd", "cell_cd", "com_cd", "sku_cd"]
    taken = picks.groupBy(
        "domain_id", "equip_type", "equip_cd", F.col("sub_equip_cd").alias("cell_cd"), "com_cd", "sku_cd"
    ).agg(F.sum(qty).cast("bigint").alias("_taken"))
    picked = F.coalesce("_taken", F.lit(0))
    return stocks.join(taken, place, "left").select(
        "id", *place, picked.alias("picked_qty"), (F.col("load_qty") + F.col("alloc_qty") - picked).alias("stock_qty")
    )


def _is_open(statuses: tuple[str, ...]) -> Column:
    return F.max(flag(F.col("status").isin(*statuses)))


def station_done(jobs: DataFrame, cells: DataFrame) -> DataFrame:
    """Per (order, box, station): are all jobs there done?"""
    places = cells.select("domain_id", "equip_type", "equip_cd", F.col("cell_cd").alias("sub_equip_cd"), F.col("station_cd").alias("_station"))
    return (
        jobs.join(places, ["domain_id", "equip_type", "equip_cd", "sub_equip_cd"])
        .groupBy(*KEY, F.col("_station").alias("station_cd"), "order_no", "box_id")
        .agg((_is_open(JOB_WIP) == 0).alias("is_done"))
    )


def boxing_done(jobs: DataFrame) -> DataFrame:
    """Per (order, box): are all jobs done, so that the box can be closed?"""
    return jobs.groupBy(*KEY, "order_no", "box_id").agg((_is_open(JOB_WIP) == 0).alias("is_done"))


def all_done(jobs: DataFrame) -> DataFrame:
    """Per batch: are all jobs done and boxed?"""
    return jobs.groupBy(*KEY).agg((_is_open(JOB_WIPF) == 0).alias("is_done"))


def jobs_after_boxing(jobs: DataFrame) -> DataFrame:
    """All jobs of a class go to status B once its box has a finished job and no open one.

    ``boxed_at`` is the end of the last pick in the box.
    """
    boxes = jobs.filter("box_id IS NOT NULL").groupBy(*KEY, "class_cd", "order_no", "box_id").agg(
        _is_open(JOB_WIP).alias("_open"), _is_open((JOB_FINISHED,)).alias("_finished"), F.max("pick_ended_at").alias("_ended")
    )
    closed = boxes.filter("_open = 0 AND _finished = 1").groupBy(*KEY, "class_cd").agg(F.max("_ended").alias("_boxed_at"), F.lit(True).alias("_closed"))
    had = F.col("boxed_at") if "boxed_at" in jobs.columns else F.lit(None).cast("timestamp_ntz")
    return (
        jobs.join(closed, [*KEY, "class_cd"], "left")
        .withColumns({"status": F.when(F.col("_closed"), JOB_BOXED).otherwise(F.col("status")), "boxed_at": F.when(F.col("_closed"), F.col("_boxed_at")).otherwise(had)})
        .drop("_closed", "_boxed_at")
    )


def inputs_after_picking(inputs: DataFrame, jobs: DataFrame, cells: DataFrame) -> DataFrame:
    """Inputs whose jobs at the station are all done go to status F."""
    done = station_done(jobs, cells).filter("is_done AND box_id IS NOT NULL")
    joined = inputs.join(done, [*KEY, "station_cd", "order_no", "box_id"], "left")
    return joined.withColumn("status", F.when(F.col("is_done"), INPUT_FINISHED).otherwise(F.col("status"))).drop("is_done")


def inspection_header(jobs: DataFrame, **filters) -> DataFrame:
    """Per (order, invoice, box, status): distinct SKUs and picked pieces."""
    group = [*KEY, "order_no", "invoice_id", "box_id", "status"]
    per_sku = where(jobs, **filters).groupBy(*group, "sku_cd").agg(F.sum("picked_qty").alias("_pcs"))
    return per_sku.groupBy(*group).agg(F.count("sku_cd").alias("sku_qty"), long_sum("_pcs").alias("picked_qty"))


def inspection_items(jobs: DataFrame, sku: DataFrame, **filters) -> DataFrame:
    """Per batch, order, status and SKU: name, barcode and picked pieces. SKUs are matched within the tenant and company."""
    group = [*KEY, "order_no", "status", "com_cd", "sku_cd"]
    picked = where(jobs, **filters).groupBy(*group).agg(long_sum("picked_qty").alias("picked_qty"))
    names = never_broadcast(sku.select("domain_id", "com_cd", "sku_cd", "sku_nm", "sku_barcd"))
    return picked.join(names, ["domain_id", "com_cd", "sku_cd"]).select(*group, "sku_nm", "sku_barcd", "picked_qty")
