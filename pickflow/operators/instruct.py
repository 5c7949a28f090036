"""Instructing, splitting, merging and un-instructing batches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pickflow.operators.classify import splittable_batches
from pickflow.functions.columns import natural_id, never_broadcast, per_batch
from pickflow.schemas import (
    BATCH_MERGED,
    BATCH_READY,
    BATCH_RUNNING,
    CONFIG_KEYS,
    JOB_WAIT,
    KEY,
    MULTI,
    ORDER_ASSIGNED,
    ORDER_INSTRUCTED,
    ORDER_TYPED,
    ORDER_WAIT,
    SINGLE,
    SINGLE_PACK_RACK,
    flag_name,
)


def _batch_key(batches: DataFrame, *columns: str | Column) -> DataFrame:
    return batches.select("domain_id", F.col("id").alias("batch_id"), *columns)


def split_batch_by_rack(orders: DataFrame, racks: DataFrame) -> DataFrame:
    """One batch per rack: the first rack by code keeps the batch id, the others get ``<id>-<rank>``.

    The rank runs over the racks of a batch, after the lines are counted per rack.
    """
    per_rack = orders.groupBy(*KEY, "equip_type", "equip_cd").agg(
        F.count_distinct("class_cd").alias("batch_order_qty"), F.sum("order_qty").cast("bigint").alias("batch_pcs")
    )
    named = per_rack.join(racks.select("domain_id", F.col("rack_cd").alias("equip_cd"), F.col("rack_nm").alias("equip_nm")), ["domain_id", "equip_cd"])
    ranked = named.withColumn("rank_num", F.rank().over(Window.partitionBy(*KEY).orderBy("equip_cd")))
    new_id = F.when(F.col("rank_num") == 1, F.col("batch_id")).otherwise(F.concat_ws("-", "batch_id", "rank_num"))
    return ranked.select(*KEY, new_id.alias("new_batch_id"), "equip_type", "equip_cd", "equip_nm", "rank_num", "batch_order_qty", "batch_pcs")


class SplitBatch(NamedTuple):
    orders: DataFrame
    batches: DataFrame
    racks: DataFrame


def apply_split(orders: DataFrame, batches: DataFrame, racks: DataFrame) -> SplitBatch:
    """Orders, batches and racks after the split; batches that name at most one rack stay as they are."""
    many = splittable_batches(orders).filter("rack_count > 1").select(*KEY)
    parts = split_batch_by_rack(orders, racks).join(many, KEY, "left_semi")
    target = parts.select(*KEY, "equip_cd", F.col("new_batch_id").alias("_new_id"), F.col("equip_nm").alias("_nm"))
    name = F.coalesce("_nm", "equip_nm") if "equip_nm" in orders.columns else F.col("_nm")
    moved = orders.join(target, [*KEY, "equip_cd"], "left").withColumns(
        {"batch_id": F.coalesce("_new_id", "batch_id"), "equip_nm": name}
    )
    base = batches.withColumnRenamed("id", "batch_id")
    split = base.drop("equip_cd").join(parts.drop("equip_type", "rank_num"), KEY)
    untouched = base.join(many, KEY, "left_anti").withColumnRenamed("batch_id", "id")
    after = split.withColumn("id", F.col("new_batch_id")).drop("batch_id", "new_batch_id")
    # A rack that already runs a batch keeps it; of several new ones it takes the last id.
    claimed = parts.groupBy("domain_id", F.col("equip_cd").alias("rack_cd")).agg(F.max("new_batch_id").alias("_claim"))
    taken = racks.join(claimed, ["domain_id", "rack_cd"], "left").withColumn("batch_id", F.coalesce("batch_id", "_claim"))
    return SplitBatch(
        moved.drop("_new_id", "_nm"), untouched.unionByName(after, allowMissingColumns=True), taken.drop("_claim")
    )


def single_pack_racks(racks: DataFrame) -> DataFrame:
    """The active single-pack rack of every (domain, area, stage, job type)."""
    return (
        racks.filter((F.col("rack_type") == SINGLE_PACK_RACK) & F.col("active_flag"))
        .groupBy("domain_id", "area_cd", "stage_cd", "job_type")
        .agg(F.min(F.struct("rack_cd", "rack_nm")).alias("_rack"))
        .select("domain_id", "area_cd", "stage_cd", "job_type", F.col("_rack.rack_cd").alias("_ot_rack_cd"), F.col("_rack.rack_nm").alias("_ot_rack_nm"))
    )


def instruct_orders(orders: DataFrame, batches: DataFrame, racks: DataFrame | None = None, *, variant: str = "service") -> DataFrame:
    """Status of typed orders once their batch group is instructed.

    ``batches`` are the batches to instruct; every batch of their groups is in scope. ``service`` moves typed
    orders to W and onto the rack of their batch if it has one. ``procedure`` moves single orders to A on the
    single-pack rack (``racks``) and multi orders to I.
    """
    scope = batches.select("domain_id", "batch_group_id", F.col("id").alias("batch_id"), F.col("equip_cd").alias("_batch_equip"))
    lines = orders.join(per_batch(scope.drop("batch_group_id").withColumn("_in", F.lit(True))), KEY, "left")
    typed = F.col("_in") & (F.col("status") == ORDER_TYPED)
    if variant == "service":
        new = {
            "status": F.when(typed, ORDER_WAIT).otherwise(F.col("status")),
            "equip_cd": F.when(typed, F.coalesce("_batch_equip", "equip_cd")).otherwise(F.col("equip_cd")),
        }
        return lines.withColumns(new).drop("_batch_equip", "_in")
    if variant != "procedure":
        raise ValueError(f"unknown variant {variant!r}")
    lines = lines.join(per_batch(single_pack_racks(racks)), ["domain_id", "area_cd", "stage_cd", "job_type"], "left")
    single, multi = typed & (F.col("order_type") == SINGLE), typed & (F.col("order_type") == MULTI)
    new = {
        "status": F.when(single, ORDER_ASSIGNED).when(multi, ORDER_INSTRUCTED).otherwise(F.col("status")),
        "equip_cd": F.when(single, F.col("_ot_rack_cd")).otherwise(F.col("equip_cd")),
    }
    return lines.withColumns(new).drop("_batch_equip", "_in", "_ot_rack_cd", "_ot_rack_nm")


def batches_to_instruct(batches: DataFrame, instructed: DataFrame) -> DataFrame:
    """All batches whose group holds one of the ``instructed`` batches (domain_id, batch_id)."""
    groups = (
        batches.join(instructed.select("domain_id", F.col("batch_id").alias("id")), ["domain_id", "id"], "left_semi")
        .select("domain_id", "batch_group_id")
        .distinct()
    )
    return batches.join(groups, ["domain_id", "batch_group_id"], "left_semi")


def create_single_pack_jobs(orders: DataFrame, racks: DataFrame, sku: DataFrame | None = None, *, status: str | None = None) -> DataFrame:
    """One pick job per single order class, SKU, box type and rack; lines without a rack go to the single-pack rack.

    ``status`` narrows the lines: all single lines of an instructed batch get jobs, of a merged one those in T. The rack name
    is that of the lines, where they have none that of the single-pack rack. The id is made of tenant, batch, class, SKU, box
    type and rack. Columns of the jobs table that are not set yet are null, so the rows can be appended to it.
    """
    orders = orders if status is None else orders.filter(F.col("status") == status)
    orders = orders if "equip_nm" in orders.columns else orders.withColumn("equip_nm", F.lit(None).cast("string"))
    keys = [*KEY, "area_cd", "stage_cd", "job_date", "job_seq", "job_type", "equip_type", "class_cd", "order_type"]
    grouped = (
        orders.filter(F.col("order_type") == SINGLE)
        .groupBy(*keys, "com_cd", "sku_cd", "box_type_cd", "equip_cd")
        .agg(F.sum("order_qty").cast("int").alias("pick_qty"), F.max("equip_nm").alias("equip_nm"))
    )
    if sku is not None:
        grouped = grouped.join(never_broadcast(sku.select("domain_id", "com_cd", "sku_cd", "sku_nm")), ["domain_id", "com_cd", "sku_cd"], "left")
    else:
        grouped = grouped.withColumn("sku_nm", F.lit(None).cast("string"))
    placed = grouped.join(per_batch(single_pack_racks(racks)), ["domain_id", "area_cd", "stage_cd", "job_type"], "left")
    placed = placed.withColumns({"equip_cd": F.coalesce("equip_cd", "_ot_rack_cd"), "equip_nm": F.coalesce("equip_nm", "_ot_rack_nm")})
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*KEY, "class_cd", "com_cd", "sku_cd", "box_type_cd", "equip_cd")]
    unset = "sub_equip_cd ind_cd box_class_cd box_id invoice_id color_cd".split()
    return placed.select(
        natural_id(*named).alias("id"),
        *KEY,
        "job_date",
        "job_seq",
        "job_type",
        "stage_cd",
        "equip_type",
        "equip_cd",
        "equip_nm",
        "class_cd",
        F.col("class_cd").alias("order_no"),
        "com_cd",
        F.col("com_cd").alias("shop_cd"),
        "sku_cd",
        "sku_nm",
        "box_type_cd",
        "pick_qty",
        "order_type",
        F.lit(JOB_WAIT).alias("status"),
        F.lit(0).cast("bigint").alias("input_seq"),
        F.lit(0).alias("picked_qty"),
        *[F.lit(None).cast("string").alias(c) for c in unset],
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("pick_started_at", "pick_ended_at")],
    )


def batch_counts(orders: DataFrame, batches: DataFrame, now: Column | None = None) -> DataFrame:
    """Distinct classes, distinct SKUs and pieces of every batch; ``instructed_at`` is kept where set.

    Distinct values are counted from one pass over (batch, class) and (batch, SKU) groups.
    """
    by_class, by_sku = [*KEY, "class_cd"], [*KEY, "sku_cd"]
    level = F.grouping_id()
    groups = (
        orders.groupingSets([by_class, by_sku], *KEY, "class_cd", "sku_cd")
        .agg(F.sum("order_qty").alias("_pcs"), level.alias("_level"))
    )
    classes = F.col("_level") == 1
    counts = groups.groupBy(*KEY).agg(
        F.count(F.when(classes, F.col("class_cd"))).alias("batch_order_qty"),
        F.count(F.when(~classes, F.col("sku_cd"))).alias("batch_sku_qty"),
        F.sum(F.when(classes, F.col("_pcs"))).cast("bigint").alias("batch_pcs"),
    )
    stamp = F.col("instructed_at") if now is None else F.coalesce("instructed_at", now)
    return (
        _batch_key(batches, stamp.alias("instructed_at"))
        .join(counts, KEY, "left")
        .select(
            *KEY,
            F.coalesce("batch_order_qty", F.lit(0)).alias("batch_order_qty"),
            F.coalesce("batch_sku_qty", F.lit(0)).alias("batch_sku_qty"),
            "batch_pcs",
            "instructed_at",
        )
    )


def mark_racks(racks: DataFrame, orders: DataFrame, batches: DataFrame) -> DataFrame:
    """Racks of the instructed ``batches`` run with the id of the newest of them; the rest stay as they are."""
    named = orders.filter("equip_cd IS NOT NULL").select(*KEY, "equip_cd").distinct()
    newest = (
        named.join(_batch_key(batches, "job_date"), KEY)
        .groupBy("domain_id", F.col("equip_cd").alias("rack_cd"))
        .agg(F.max(F.struct("job_date", "batch_id"))["batch_id"].alias("_batch_id"))
    )
    used = F.col("_batch_id").isNotNull()
    return (
        racks.join(newest, ["domain_id", "rack_cd"], "left")
        .withColumns({"status": F.when(used, BATCH_RUNNING).otherwise(F.col("status")), "batch_id": F.coalesce("_batch_id", "batch_id")})
        .drop("_batch_id")
    )


class MergedBatches(NamedTuple):
    orders: DataFrame
    batches: DataFrame
    rejected: DataFrame


def merge_batch(orders: DataFrame, batches: DataFrame, mapping: DataFrame, racks: DataFrame | None = None, *, variant: str = "service") -> MergedBatches:
    """Merge batches into running main batches; ``mapping`` has domain_id, batch_id, main_batch_id.

    ``service`` rejects a batch whose lines name several racks; typed orders go to W on the rack of the main
    batch, and all orders move. ``by_rack`` moves typed orders to the batch that runs on their rack (``racks``)
    and to status I; a part whose rack runs no other batch keeps its batch.
    """
    main = batches.select("domain_id", F.col("id").alias("main_batch_id"), F.col("batch_group_id").alias("_group"), F.col("equip_cd").alias("_main_equip"))
    plan = mapping.select("domain_id", "batch_id", "main_batch_id").join(main, ["domain_id", "main_batch_id"])
    typed = F.col("status") == ORDER_TYPED
    if variant == "service":
        spread = splittable_batches(orders).filter("rack_count > 1").select(*KEY)
        rejected = plan.join(spread, KEY, "left_semi").select(*KEY, "main_batch_id")
        plan = plan.join(spread, KEY, "left_anti")
        lines = orders.join(per_batch(plan), KEY, "left")
        moves = F.col("main_batch_id").isNotNull()
        merged = lines.withColumns(
            {
                "new_batch_id": F.coalesce("main_batch_id", "batch_id"),
                "status": F.when(moves & typed, ORDER_WAIT).otherwise(F.col("status")),
                "equip_cd": F.when(moves & typed, F.coalesce("_main_equip", "equip_cd")).otherwise(F.col("equip_cd")),
            }
        ).drop("main_batch_id", "_group", "_main_equip")
    elif variant == "by_rack":
        rejected = plan.filter(F.lit(False)).select(*KEY, "main_batch_id")
        running = racks.select("domain_id", F.col("rack_cd").alias("equip_cd"), F.col("batch_id").alias("_rack_batch"))
        lines = orders.join(per_batch(plan), KEY, "left").join(per_batch(running), ["domain_id", "equip_cd"], "left")
        moves = F.col("main_batch_id").isNotNull() & typed
        multi = moves & (F.col("order_type") == MULTI)
        merged = lines.withColumns(
            {
                "new_batch_id": F.when(moves, F.coalesce("_rack_batch", "batch_id")).otherwise(F.col("batch_id")),
                "status": F.when(multi, ORDER_INSTRUCTED).otherwise(F.col("status")),
            }
        ).drop("main_batch_id", "_group", "_main_equip", "_rack_batch")
    else:
        raise ValueError(f"unknown variant {variant!r}")
    into = plan.select("domain_id", F.col("batch_id").alias("id"), "_group")
    after = batches.join(into, ["domain_id", "id"], "left").withColumns(
        {
            "status": F.when(F.col("_group").isNotNull(), BATCH_MERGED).otherwise(F.col("status")),
            "batch_group_id": F.coalesce("_group", "batch_group_id"),
        }
    )
    return MergedBatches(merged, after.drop("_group"), rejected)


class MergeResult(NamedTuple):
    orders: DataFrame
    batches: DataFrame
    jobs: DataFrame
    counts: DataFrame


def merge_with_jobs(
    orders: DataFrame, batches: DataFrame, mapping: DataFrame, racks: DataFrame, sku: DataFrame | None = None, *, now: Column | None = None
) -> MergeResult:
    """The whole merge by rack: multi orders to I, single orders to A on the single-pack rack with their pick jobs.

    ``orders`` hold their batch after the merge, ``counts`` are those of all batches after it.
    """
    merged = merge_batch(orders, batches, mapping, racks, variant="by_rack")
    moved = mapping.select(*KEY).distinct().withColumn("_moved", F.lit(True))
    lines = merged.orders.join(per_batch(moved), KEY, "left")
    single = F.col("_moved") & (F.col("status") == ORDER_TYPED) & (F.col("order_type") == SINGLE)
    placed = lines.withColumn("_single", F.coalesce(single, F.lit(False))).withColumn("batch_id", F.col("new_batch_id")).drop("new_batch_id", "_moved")
    jobs = create_single_pack_jobs(placed.filter("_single").withColumn("equip_cd", F.lit(None).cast("string")), racks, sku, status=ORDER_TYPED)
    after = (
        placed.join(per_batch(single_pack_racks(racks)), ["domain_id", "area_cd", "stage_cd", "job_type"], "left")
        .withColumns(
            {
                "status": F.when(F.col("_single"), ORDER_ASSIGNED).otherwise(F.col("status")),
                "equip_cd": F.when(F.col("_single"), F.coalesce("_ot_rack_cd", "equip_cd")).otherwise(F.col("equip_cd")),
            }
        )
        .drop("_single", "_ot_rack_cd", "_ot_rack_nm")
    )
    return MergeResult(after, merged.batches, jobs, batch_counts(after, merged.batches, now))


class CancelledInstruction(NamedTuple):
    batches: DataFrame
    orders: DataFrame
    jobs: DataFrame
    racks: DataFrame


def cancel_instruction(orders: DataFrame, batches: DataFrame, jobs: DataFrame, racks: DataFrame) -> CancelledInstruction:
    """Take back the instruction of every given batch that has no picked job.

    Waiting orders go back to T, jobs are dropped, the rack of the batch is freed and the batch is READY. A
    batch that is alone in its group, merged ones aside, also loses its rack, so that another can be chosen.
    """
    started = jobs.filter("picked_qty > 0").select("domain_id", F.col("batch_id").alias("id")).distinct()
    peers = batches.filter(F.col("status") != BATCH_MERGED).groupBy("domain_id", "batch_group_id").agg(F.count("*").alias("_peers"))
    decided = (
        batches.join(started.withColumn("_started", F.lit(True)), ["domain_id", "id"], "left")
        .join(peers, ["domain_id", "batch_group_id"], "left")
        .withColumns({"allowed": F.col("_started").isNull(), "_alone": F.coalesce("_peers", F.lit(0)) <= 1})
    )
    cancelled = decided.filter("allowed").select("domain_id", F.col("id").alias("batch_id"), "_alone", F.col("equip_cd").alias("_rack"))
    ready = F.col("allowed")
    batches_after = decided.withColumns(
        {
            "equip_cd": F.when(~(ready & F.col("_alone")), F.col("equip_cd")),
            "status": F.when(ready, BATCH_READY).otherwise(F.col("status")),
            "instructed_at": F.when(~ready, F.col("instructed_at")),
        }
    ).drop("_started", "_peers", "_alone")
    back = F.col("_alone").isNotNull() & (F.col("status") == ORDER_WAIT)
    orders_after = (
        orders.join(cancelled.drop("_rack"), KEY, "left")
        .withColumns(
            {
                "status": F.when(back, ORDER_TYPED).otherwise(F.col("status")),
                "equip_cd": F.when(~F.coalesce("_alone", F.lit(False)), F.col("equip_cd")),
            }
        )
        .drop("_alone")
    )
    freed = cancelled.filter("_rack IS NOT NULL").select("domain_id", F.col("_rack").alias("rack_cd"), F.lit(True).alias("_free")).distinct()
    racks_after = (
        racks.join(freed, ["domain_id", "rack_cd"], "left")
        .withColumns({"batch_id": F.when(F.col("_free").isNull(), F.col("batch_id")), "status": F.when(F.col("_free").isNull(), F.col("status"))})
        .drop("_free")
    )
    return CancelledInstruction(batches_after, orders_after, jobs.join(cancelled.select(*KEY), KEY, "left_anti"), racks_after)


def config_flags(batches: DataFrame, configs: DataFrame) -> DataFrame:
    """Configuration rows as one typed column per key, for every batch; a missing or empty value is null."""
    wide = (
        configs.filter(F.col("name").isin(*CONFIG_KEYS) & (F.col("value") != ""))
        .groupBy("domain_id", "job_config_set_id")
        .agg(*[F.max(F.when(F.col("name") == key, F.col("value"))).cast(kind).alias(flag_name(key)) for key, kind in CONFIG_KEYS.items()])
    )
    joined = batches.join(wide, ["domain_id", "job_config_set_id"], "left")
    return joined.select("domain_id", F.col("id").alias("batch_id"), *[flag_name(key) for key in CONFIG_KEYS])


def running_batches(batches: DataFrame, *, job_type: str = "DPS") -> DataFrame:
    """Running batches, newest job date first."""
    running = batches.filter((F.col("status") == BATCH_RUNNING) & (F.col("job_type") == job_type))
    return running.orderBy(F.col("job_date").desc_nulls_last(), "domain_id", "id")
