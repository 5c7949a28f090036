"""Putting boxes in: which order a box gets, input rows, and the input screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickflow.functions.columns import box_color, flag, long_sum, ratio, where
from pickflow.functions.running import row_numbers, running_totals, same_keys
from pickflow.schemas import INPUT_WAIT, JOB_BOX_WAIT, JOB_INPUT, JOB_PICKING, JOB_WAIT, KEY, MULTI, SINGLE
from pickflow.session import cut_lineage

NOT_STARTED = (JOB_BOX_WAIT, JOB_WAIT)


def inputable_box_count(jobs: DataFrame, **filters) -> DataFrame:
    """Multi orders per batch that still wait for a box."""
    return (
        where(jobs, order_type=MULTI, status=NOT_STARTED, **filters)
        .groupBy(*KEY, "equip_type")
        .agg(F.count_distinct("order_no").alias("inputable_box"))
    )


def inputable_box_by_type(orders: DataFrame, jobs: DataFrame, **filters) -> DataFrame:
    """Planned, started and remaining multi orders per batch and box type."""
    group = [*KEY, "equip_type", "box_type_cd"]
    planned = where(orders, order_type=MULTI, **filters).groupBy(*group).agg(F.count_distinct("order_no").alias("input_plan_qty"))
    started = (
        where(jobs, order_type=MULTI, **filters)
        .filter(~F.col("status").isin(*NOT_STARTED))
        .groupBy(*group)
        .agg(F.count_distinct("order_no").alias("_started"))
    )
    joined = planned.alias("p").join(started.alias("s"), same_keys("p", "s", group), "left")
    done = F.coalesce("_started", F.lit(0))
    return joined.select(
        *[f"p.{c}" for c in group], "input_plan_qty", done.alias("input_box_qty"), (F.col("input_plan_qty") - done).alias("remain_qty")
    )


def waiting_jobs(jobs: DataFrame) -> DataFrame:
    return where(jobs, order_type=MULTI, status=JOB_WAIT, input_seq=0)


def waiting_orders(jobs: DataFrame) -> DataFrame:
    """Orders that wait for a box, with the two numbers that rank them: SKUs, then pieces."""
    per_sku = waiting_jobs(jobs).groupBy(*KEY, "box_type_cd", "order_no", "class_cd", "sku_cd").agg(F.sum("pick_qty").alias("_pcs"))
    return per_sku.groupBy(*KEY, "box_type_cd", "order_no", "class_cd").agg(
        F.count("sku_cd").alias("sku_cnt"), F.sum("_pcs").cast("bigint").alias("pick_cnt")
    )


def next_mapping_order(jobs: DataFrame) -> DataFrame:
    """The order the next box of a type gets: fewest SKUs, then fewest pieces, then order number."""
    best = F.min(F.struct("sku_cnt", "pick_cnt", "order_no")).alias("_best")
    return (
        waiting_orders(jobs)
        .groupBy(*KEY, "box_type_cd")
        .agg(best)
        .select(*KEY, "box_type_cd", F.col("_best.order_no").alias("order_no"), F.col("_best.sku_cnt").alias("sku_cnt"), F.col("_best.pick_cnt").alias("pick_cnt"))
    )


def next_mapping_single(jobs: DataFrame, scanned: DataFrame) -> DataFrame:
    """The single-order job of every scanned box (domain_id, batch_id, box_id).

    A job that already holds the box comes first (least left to pick). The other boxes, by id, take the waiting jobs in
    turn, fewest pieces first, each job once. Boxes for which no job is left are left out.
    """
    single = where(jobs, order_type=SINGLE)
    rest = F.col("pick_qty") - F.col("picked_qty")
    held = (
        single.filter("box_id IS NOT NULL")
        .groupBy(*KEY, "box_id")
        .agg(F.min(F.struct(rest.alias("qty"), "id")).alias("_held"))
    )
    boxes = scanned.select(*KEY, "box_id").filter("box_id IS NOT NULL").distinct().join(held, [*KEY, "box_id"], "left")
    kept = boxes.filter("_held IS NOT NULL").select(*KEY, "box_id", F.col("_held.id").alias("job_id"), F.col("_held.qty").alias("qty"), F.lit(1).alias("is_held"))
    free = row_numbers(boxes.filter("_held IS NULL").select(*KEY, "box_id"), KEY, [F.col("box_id").asc()])
    waiting = where(single, input_seq=0, status=JOB_WAIT).filter("box_id IS NULL").select(*KEY, F.col("id").alias("job_id"), F.col("pick_qty").alias("qty"))
    taken = free.join(row_numbers(waiting, KEY, [F.col("qty").asc(), F.col("job_id").asc()]), [*KEY, "rn"])
    return kept.unionByName(taken.select(*KEY, "box_id", "job_id", "qty", F.lit(0).alias("is_held")))


def map_boxes(jobs: DataFrame, inputs: DataFrame, arrivals: DataFrame, *, default_color: Column | str = "R") -> DataFrame:
    """Give the n-th arriving box of a type the n-th waiting order of that type, per batch.

    ``arrivals`` has domain_id, batch_id, box_id, box_type_cd, color_cd, arrived_at. Boxes already used in the
    tenant and orders that already have an input are left out. Boxes or orders without partner drop out.
    """
    pair_key = [*KEY, "box_type_cd"]
    free_orders = waiting_orders(jobs).join(inputs.select(*KEY, "order_no"), [*KEY, "order_no"], "left_anti")
    used = jobs.filter("box_id IS NOT NULL").select("domain_id", "box_id")
    # A box that is scanned twice counts at its first arrival.
    first_scan = arrivals.groupBy("domain_id", "box_id").agg(
        F.min(F.struct("arrived_at", "batch_id", "box_type_cd", "color_cd")).alias("_a")
    )
    free_boxes = first_scan.join(used, ["domain_id", "box_id"], "left_anti").select("domain_id", "box_id", "_a.*")
    by_size = [F.col("sku_cnt").asc(), F.col("pick_cnt").asc(), F.col("order_no").asc()]
    by_arrival = [F.col("arrived_at").asc_nulls_last(), F.col("box_id").asc()]
    ranked_orders = row_numbers(free_orders, pair_key, by_size)
    ranked_boxes = row_numbers(free_boxes, pair_key, by_arrival)
    return ranked_boxes.join(ranked_orders, [*pair_key, "rn"]).select(
        *KEY, "box_id", "box_type_cd", "order_no", "class_cd", "arrived_at", box_color("color_cd", default_color).alias("color_cd")
    )


def new_input_rows(jobs: DataFrame, cells: DataFrame, orders_to_input: DataFrame | None = None) -> DataFrame:
    """The stations an order has to visit: distinct stations of its jobs on active cells.

    ``orders_to_input`` (domain_id, batch_id, class_cd) narrows the orders, for example to mapped ones.
    """
    source = jobs if orders_to_input is None else jobs.join(orders_to_input.select(*KEY, "class_cd").distinct(), [*KEY, "class_cd"], "left_semi")
    places = cells.filter("active_flag").select("domain_id", "equip_type", "equip_cd", F.col("cell_cd").alias("sub_equip_cd"), F.col("station_cd").alias("_station"))
    return (
        source.join(places, ["domain_id", "equip_type", "equip_cd", "sub_equip_cd"])
        .select(*KEY, "equip_type", "equip_cd", F.col("_station").alias("station_cd"), "order_no", "class_cd", "com_cd")
        .distinct()
    )


def create_inputs(new_rows: DataFrame, mapped: DataFrame, inputs: DataFrame) -> DataFrame:
    """Input rows of mapped boxes, numbered on from the highest sequence of the batch.

    Boxes are numbered as they arrived, the stations of a box by rack, station and company.
    """
    highest = inputs.groupBy(*KEY).agg(F.max("input_seq").alias("_max"))
    boxes = mapped.select(*KEY, "class_cd", "box_id", "color_cd", F.col("box_type_cd").alias("box_type"), "arrived_at")
    rows = new_rows.join(boxes, [*KEY, "class_cd"])
    order = [F.col(c).asc_nulls_last() for c in ("arrived_at", "box_id", "equip_cd", "station_cd", "com_cd", "order_no")]
    numbered = row_numbers(rows, KEY, order)
    return numbered.join(highest, KEY, "left").select(
        *KEY,
        "equip_type",
        "equip_cd",
        "station_cd",
        "order_no",
        "class_cd",
        "com_cd",
        "box_id",
        "box_type",
        "color_cd",
        (F.coalesce("_max", F.lit(0)) + F.col("rn")).cast("bigint").alias("input_seq"),
        F.lit(INPUT_WAIT).alias("status"),
    )


def apply_box_mapping(jobs: DataFrame, cells: DataFrame, new_inputs: DataFrame, *, input_at: Column | None = None) -> DataFrame:
    """Jobs after their box was put in: sequence, box, colour and status (single orders go straight to picking)."""
    places = cells.select("domain_id", "equip_type", "equip_cd", F.col("cell_cd").alias("sub_equip_cd"), F.col("station_cd").alias("_station"))
    # Two companies of one order at one station have two input rows; the job takes the later one.
    per_station = new_inputs.groupBy(*KEY, "equip_type", "class_cd", F.col("station_cd").alias("_station")).agg(
        F.max(F.struct("input_seq", "box_id", "color_cd")).alias("_in")
    )
    per_order = new_inputs.groupBy(*KEY, "equip_type", "class_cd").agg(F.max(F.struct("input_seq", "box_id", "color_cd")).alias("_single"))
    placed = jobs.join(places, ["domain_id", "equip_type", "equip_cd", "sub_equip_cd"], "left")
    joined = placed.join(per_station, [*KEY, "equip_type", "class_cd", "_station"], "left").join(per_order, [*KEY, "equip_type", "class_cd"], "left")
    is_single = F.col("order_type") == SINGLE
    hit = F.when(is_single, F.col("_single")).otherwise(F.col("_in"))
    mapped = hit.isNotNull()
    stamp = F.lit(None).cast("timestamp_ntz") if input_at is None else input_at
    had = F.col("input_at") if "input_at" in jobs.columns else F.lit(None).cast("timestamp_ntz")
    return joined.withColumns(
        {
            "input_seq": F.coalesce(hit["input_seq"], F.col("input_seq")),
            "box_id": F.coalesce(hit["box_id"], F.col("box_id")),
            "color_cd": F.coalesce(hit["color_cd"], F.col("color_cd")),
            "input_at": F.when(mapped, stamp).otherwise(had),
            "status": F.when(mapped & is_single, JOB_PICKING).when(mapped, JOB_INPUT).otherwise(F.col("status")),
        }
    ).drop("_station", "_in", "_single")


def input_seq_list(jobs: DataFrame, cells: DataFrame | None = None, *, variant: str = "sequenced", station_cd: str | None = None, **filters) -> DataFrame:
    """Boxes put in, per (order, box): sequence, SKUs, planned and picked pieces, done flag.

    ``all`` takes every started job, ``sequenced`` only those with a sequence, ``no_assigned`` also leaves out
    status A. ``station_cd`` (with ``cells``) keeps only jobs on cells of that station.
    """
    if variant not in ("all", "sequenced", "no_assigned"):
        raise ValueError(f"unknown variant {variant!r}")
    excluded = [*NOT_STARTED, "A"] if variant == "no_assigned" else NOT_STARTED
    rows = where(jobs, order_type=MULTI, **filters).filter(~F.col("status").isin(*excluded))
    if variant != "all":
        rows = rows.filter("input_seq >= 1")
    if station_cd is not None:
        mine = where(cells, station_cd=station_cd).select("domain_id", F.col("cell_cd").alias("sub_equip_cd"))
        rows = rows.join(mine, ["domain_id", "sub_equip_cd"], "left_semi")
    group = [*KEY, "equip_type", "equip_cd", "order_no", "box_id", "box_type_cd"]
    measures = {"input_seq": F.min, "color_cd": F.max, "pick_qty": F.sum, "picked_qty": F.sum}
    per_sku = rows.groupBy(*group, "com_cd", "sku_cd").agg(*[fn(c).alias(c) for c, fn in measures.items()])
    per_box = per_sku.groupBy(*group).agg(
        F.min("input_seq").alias("input_seq"),
        F.count("*").alias("sku_qty"),
        F.sum("pick_qty").cast("bigint").alias("plan_qty"),
        long_sum("picked_qty").alias("result_qty"),
        F.max("color_cd").alias("color_cd"),
    )
    done = F.when(F.col("plan_qty") == F.col("result_qty"), "1").otherwise("0")
    return per_box.withColumn("status", done).withColumnRenamed("box_type_cd", "box_type")


def _base_inputs(inputs: DataFrame, selected: DataFrame | None) -> DataFrame:
    """The input a station's screen is centred on: the selected one, else the latest running, else the latest
    finished, else the earliest waiting one."""
    station = [*KEY, "equip_type", "equip_cd", "station_cd"]
    row = F.struct("input_seq", "id", "order_no", "box_id")
    status = F.col("status")
    marked = inputs
    picked = F.lit(False)
    if selected is not None:
        marked = inputs.join(selected.select("domain_id", "id").distinct().withColumn("_sel", F.lit(True)), ["domain_id", "id"], "left")
        picked = F.coalesce("_sel", F.lit(False))
    best = marked.groupBy(*station).agg(
        F.coalesce(
            F.max(F.when(picked, row)),
            F.max(F.when(status == "R", row)),
            F.max(F.when(status.isin("F", "E"), row)),
            F.min(F.when(status == "W", row)),
        ).alias("_base"),
        F.max(F.when(picked, F.col("id"))).alias("selected_id"),
    )
    return best.filter("_base IS NOT NULL").select(
        *station, "selected_id", F.col("_base.input_seq").alias("base_seq"), F.col("_base.order_no").alias("base_order_no"), F.col("_base.box_id").alias("base_box_id")
    )


def _neighbours(inputs: DataFrame, bases: DataFrame) -> DataFrame:
    """For every station its base box (seq 1 before, 2 base, 3 after): one box before, two after, by sequence.

    The boxes of a batch are numbered by sequence, together with the sequences of the bases, which so learn how many boxes
    lie before and up to them. A neighbour is then looked up by its number: no station meets more than five boxes.
    """
    box = [*KEY, "equip_type", "order_no", "box_id"]
    scope = [*KEY, "equip_type"]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("order_no", "box_id")]
    boxes = inputs.groupBy(*box).agg(F.min("input_seq").alias("seq")).select(*scope, "seq", "order_no", "box_id", F.lit(1).alias("_kind"))
    marks = bases.select(*scope, F.col("base_seq").alias("seq")).distinct().select(*scope, "seq", *nothing, F.explode(F.array(F.lit(0), F.lit(2))).alias("_kind"))
    order = [F.col(c).asc() for c in ("seq", "_kind", "order_no", "box_id")]
    counted = running_totals(boxes.unionByName(marks), scope, order, {"_rn": F.when(F.col("_kind") == 1, 1).otherwise(0)})
    numbered = counted.filter("_kind = 1").select(*scope, "_rn", "seq", "order_no", "box_id")
    at = F.max(F.when(F.col("_kind") == 0, F.col("_rn"))).alias("_before"), F.max(F.when(F.col("_kind") == 2, F.col("_rn"))).alias("_upto")
    places = counted.filter("_kind <> 1").groupBy(*scope, F.col("seq").alias("base_seq")).agg(*at)
    station = [*scope, "equip_cd", "station_cd"]
    # One more on each side, as the base box itself may be among them.
    near = F.array(F.col("_before") - 1, F.col("_before"), F.col("_upto") + 1, F.col("_upto") + 2, F.col("_upto") + 3)
    other = ~(F.col("order_no").eqNullSafe(F.col("base_order_no")) & F.col("box_id").eqNullSafe(F.col("base_box_id")))
    found = bases.join(places, [*scope, "base_seq"]).withColumn("_rn", F.explode(near)).join(numbered, [*scope, "_rn"]).filter(other)
    after = found.filter("seq > base_seq").withColumn("_n", F.row_number().over(Window.partitionBy(*station).orderBy("_rn"))).filter("_n <= 2")
    before = found.filter("seq < base_seq").withColumn("_n", F.row_number().over(Window.partitionBy(*station).orderBy(F.desc("_rn")))).filter("_n <= 1")
    columns = [*station, "selected_id", "order_no", "box_id", "screen_pos"]
    base = bases.select(*station, "selected_id", F.col("base_order_no").alias("order_no"), F.col("base_box_id").alias("box_id"), F.lit(2).alias("screen_pos"))
    return (
        base.unionByName(before.withColumn("screen_pos", F.lit(1)).select(*columns))
        .unionByName(after.withColumn("screen_pos", F.lit(3)).select(*columns))
    )


def box_input_tab(inputs: DataFrame, jobs: DataFrame, cells: DataFrame, *, selected: DataFrame | None = None, only_my_jobs: bool = False) -> DataFrame:
    """The box list of every station screen: the base box, one before and two after it.

    ``selected`` holds inputs (domain_id, id) chosen by hand. ``only_my_jobs`` keeps boxes that have an input
    at the station itself. The progress is picked over planned pieces of the order at the station, in percent.

    The boxes to show, at most four per station, are written first: inputs and jobs then meet a table whose size
    Spark knows, and need no shuffle as long as it is small enough to broadcast.
    """
    station = [*KEY, "equip_type", "equip_cd", "station_cd"]
    shown = cut_lineage(_neighbours(inputs, _base_inputs(inputs, selected)))
    rows = inputs.select(
        *KEY, "equip_type", "order_no", "box_id", "color_cd", "id", "input_seq", "status", F.col("station_cd").alias("_at")
    )
    joined = shown.alias("s").join(rows.alias("r"), same_keys("s", "r", [*KEY, "equip_type", "order_no", "box_id"]))
    mine = F.col("_at") == F.col("station_cd")
    done = F.coalesce(F.col("status").isin("F", "U", "E"), F.lit(False))
    open_here = F.coalesce(mine & F.col("status").isin("W", "R"), F.lit(False))
    boxes = (
        joined.select(*[F.col(f"s.{c}") for c in (*station, "selected_id", "screen_pos", "order_no", "box_id")], "color_cd", "id", "input_seq", "status", "_at")
        .groupBy(*station, "selected_id", "screen_pos", "order_no", "box_id", "color_cd")
        .agg(
            F.max(F.when(mine, F.col("id"))).alias("_my_id"),
            F.min("id").alias("_any_id"),
            F.sum(flag(mine)).alias("has_my_jobs"),
            F.max(F.when(mine, F.col("input_seq")).otherwise(0)).alias("_my_seq"),
            F.max("input_seq").alias("_last_seq"),
            # one open input is left, and it is here
            flag((F.count_if(open_here) == 1) & (F.count_if(~open_here & ~done) == 0)).alias("is_my_zone_is_last"),
            F.max(F.when(mine, F.col("status"))).alias("status"),
        )
    )
    if only_my_jobs:
        boxes = boxes.filter("has_my_jobs > 0")
    places = cells.select("domain_id", "equip_type", "equip_cd", F.col("cell_cd").alias("sub_equip_cd"), F.col("station_cd").alias("_station"))
    on_screen = shown.select(*KEY, "order_no").distinct()
    zone = (
        jobs.join(on_screen, [*KEY, "order_no"], "left_semi")
        .join(places, ["domain_id", "equip_type", "equip_cd", "sub_equip_cd"])
        .groupBy(*KEY, "equip_type", "equip_cd", F.col("_station").alias("station_cd"), "order_no")
        .agg(F.sum("pick_qty").alias("_plan"), F.sum("picked_qty").alias("_picked"))
    )
    return boxes.join(zone, [*station, "order_no"], "left").select(
        *station,
        "screen_pos",
        "order_no",
        "box_id",
        "color_cd",
        F.coalesce("_my_id", "_any_id").alias("id"),
        F.col("has_my_jobs").cast("bigint").alias("has_my_jobs"),
        "is_my_zone_is_last",
        F.when(F.col("_my_seq") == 0, F.col("_last_seq")).otherwise(F.col("_my_seq")).alias("input_seq"),
        ratio("_picked", "_plan", 100.0).alias("my_zone_progress_rate"),
        "status",
        flag(F.col("_my_id") == F.col("selected_id")).alias("is_selected_item"),
    )


def box_input_details(jobs: DataFrame, cells: DataFrame, indicators: DataFrame, gateways: DataFrame, **filters) -> DataFrame:
    """Jobs with side, gateway code and path; jobs without an indicator or gateway on their stage drop out."""
    places = cells.select(
        "domain_id", "equip_type", "equip_cd", F.col("cell_cd").alias("sub_equip_cd"), F.col("station_cd").alias("cell_station_cd"), "side_cd"
    )
    paths = gateways.select("domain_id", "gw_cd", "stage_cd", F.col("gw_nm").alias("gw_path"))
    return (
        where(jobs, **filters)
        .join(places, ["domain_id", "equip_type", "equip_cd", "sub_equip_cd"])
        .join(indicators, ["domain_id", "ind_cd"])
        .join(paths, ["domain_id", "gw_cd", "stage_cd"])
    )


def arrival_candidates(inputs: DataFrame) -> DataFrame:
    """Per place and box the input that an arrival there belongs to, and its status after it: a waiting one starts to run.

    A waiting input is taken before a running one, the lowest sequence first.
    """
    place = [*KEY, "equip_type", "equip_cd", "station_cd", "box_id"]
    rank = F.when(F.col("status") == "W", 1).when(F.col("status") == "R", 2)
    candidate = inputs.filter("status IN ('W', 'R')").groupBy(*place).agg(
        F.min(F.struct(rank.alias("_rank"), "input_seq", "id", "order_no")).alias("_in")
    )
    return candidate.select(
        *place, F.col("_in.id").alias("id"), F.col("_in.order_no").alias("order_no"), F.lit("R").alias("status"), flag(F.col("_in._rank") == 1).alias("is_started")
    )


def box_arrivals(inputs: DataFrame, scans: DataFrame) -> DataFrame:
    """The input a box arrival at a station belongs to, and its status after it.

    ``scans`` has domain_id, batch_id, equip_type, equip_cd, station_cd, box_id.
    """
    place = [*KEY, "equip_type", "equip_cd", "station_cd", "box_id"]
    return scans.select(*place).distinct().join(arrival_candidates(inputs), place)


