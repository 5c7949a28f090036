"""Box items, box packs and the checks on box ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickflow.functions.columns import long_sum, never_broadcast
from pickflow.schemas import KEY

ITEM_WAIT = "W"


def box_items(orders: DataFrame, sku: DataFrame) -> DataFrame:
    """One box line per order line, with the SKU weight (0 where the SKU is unknown)."""
    weights = sku.select("domain_id", "com_cd", "sku_cd", "sku_nm", "sku_wt")
    return orders.join(never_broadcast(weights), ["domain_id", "com_cd", "sku_cd"], "left").select(
        F.concat(F.lit("BI-"), "id").alias("id"),
        *KEY,
        F.concat(F.lit("BP-"), "class_cd").alias("box_pack_id"),
        F.col("id").alias("order_id"),
        "order_no",
        "order_line_no",
        "com_cd",
        "shop_cd",
        "sku_cd",
        "sku_nm",
        F.coalesce("sku_wt", F.lit(0)).alias("sku_wt"),
        F.col("order_qty").alias("pick_qty"),
        F.lit(0).alias("picked_qty"),
        F.lit(0).alias("cancel_qty"),
        F.lit(0).alias("pass_flag"),
        F.lit(ITEM_WAIT).alias("status"),
    )


def box_packs(items: DataFrame, jobs: DataFrame, batches: DataFrame, box_types: DataFrame, *, box_kind: Column | str = "BOX") -> DataFrame:
    """One box per order: SKUs, pieces and weights from its items, the rest from its jobs and its batch.

    Box weights (stored in grams) count only when ``box_kind`` is BOX; an unknown box type weighs nothing.
    """
    kind = F.lit(box_kind) if isinstance(box_kind, str) else box_kind
    order_key = [*KEY, "order_no"]
    per_sku = items.groupBy(*order_key, "sku_cd").agg(
        F.sum("pick_qty").alias("_pcs"), F.sum(F.col("sku_wt").cast("bigint") * F.col("pick_qty")).alias("_wt"), F.max("shop_cd").alias("_shop")
    )
    content = per_sku.groupBy(*order_key).agg(
        F.count("sku_cd").alias("sku_qty"), long_sum("_pcs").alias("pick_qty"), long_sum("_wt").alias("_sku_wt"), F.max("_shop").alias("shop_cd")
    )
    head = jobs.groupBy(*order_key).agg(
        *[F.max(c).alias(c) for c in ("order_type", "box_type_cd", "box_id", "class_cd", "box_class_cd")]
    )
    batch = batches.select(
        "domain_id", F.col("id").alias("batch_id"), "job_date", "job_seq", "job_type", "area_cd", "stage_cd", "equip_type", "equip_cd"
    )
    empty = {c: F.when(kind == "BOX", F.coalesce(c, F.lit(0))).otherwise(0) / F.lit(1000.0) for c in ("box_wt", "box_wt_min", "box_wt_max")}
    return (
        content.join(head, order_key)
        .join(batch, KEY)
        .join(box_types, ["domain_id", "box_type_cd"], "left")
        .select(
            F.concat(F.lit("BP-"), "class_cd").alias("id"),
            *KEY,
            "job_date",
            "job_seq",
            "job_type",
            "order_no",
            "shop_cd",
            "area_cd",
            "stage_cd",
            "equip_type",
            "equip_cd",
            "order_type",
            "box_type_cd",
            "box_id",
            "sku_qty",
            "pick_qty",
            F.lit(0).alias("picked_qty"),
            *[(F.col("_sku_wt") + w).alias(c) for c, w in empty.items()],
            "class_cd",
            "box_class_cd",
            F.lit(0).alias("pass_flag"),
            F.lit(ITEM_WAIT).alias("status"),
        )
    )


def update_box_items(items: DataFrame, orders: DataFrame, *, status: str, update_pass_flag: bool = True) -> DataFrame:
    """Box lines with the picked quantity of their order line and the new status; B sets the pass flag."""
    picked = orders.select("domain_id", F.col("id").alias("order_id"), F.col("picked_qty").alias("_picked"))
    new = {"picked_qty": F.col("_picked"), "status": F.lit(status)}
    if update_pass_flag:
        new["pass_flag"] = F.lit(1 if status == "B" else 0)
    return items.join(picked, ["domain_id", "order_id"], "left").withColumns(new).drop("_picked")


def box_of_order(packs: DataFrame, orders: DataFrame) -> DataFrame:
    """The box pack of each of the given orders (domain_id, batch_id, order_no)."""
    return packs.join(orders.select(*KEY, "order_no"), [*KEY, "order_no"], "left_semi")


def box_duplicates(boxes: DataFrame, batches: DataFrame | None = None, *, scope: str = "G") -> DataFrame:
    """How often a box id is used within the scope: G the tenant, D the job date, B the batch.

    ``boxes`` is the table to search, box packs or jobs. Every used id is reported; ``is_used_box`` tells more
    than none, a count above 1 is a double use.
    """
    columns = {"G": ["domain_id"], "D": ["domain_id", "job_date"], "B": list(KEY)}
    if scope not in columns:
        raise ValueError(f"scope must be G, D or B, not {scope!r}")
    used = boxes.filter("box_id IS NOT NULL").select(*KEY, "box_id")
    if scope == "D":
        used = used.join(batches.select("domain_id", F.col("id").alias("batch_id"), "job_date"), KEY)
    counted = used.groupBy(*columns[scope], "box_id").agg(F.count("*").alias("dup_cnt"))
    return counted.withColumn("scope", F.lit(scope))


def latest_box_of_cell(packs: DataFrame) -> DataFrame:
    """The box or boxes with the highest box sequence of every (batch, cell)."""
    cell = [*KEY, "sub_equip_cd"]
    top = packs.groupBy(*cell).agg(F.max("box_seq").alias("box_seq"))
    return packs.join(top, [*cell, "box_seq"], "left_semi")


def resolve_scan(codes: DataFrame, *, sku: DataFrame, boxes: DataFrame, cells: DataFrame, indicators: DataFrame, racks: DataFrame) -> DataFrame:
    """Kind of a scanned code (domain_id, code): SKU, else BOX, CELL, IND or RACK; null where it is none of them.

    All known codes form one list with their rank; the kind is the lowest rank of the code.
    """
    kinds = [("SKU", sku, "sku_cd"), ("BOX", boxes, "box_id"), ("CELL", cells, "cell_cd"), ("IND", indicators, "ind_cd"), ("RACK", racks, "rack_cd")]
    known = None
    for rank, (_, table, column) in enumerate(kinds, 1):
        rows = table.filter(F.col(column).isNotNull()).select("domain_id", F.col(column).alias("code"), F.lit(rank).alias("_rank"))
        known = rows if known is None else known.unionByName(rows)
    best = known.groupBy("domain_id", "code").agg(F.min("_rank").alias("_rank"))
    label = F.coalesce(*[F.when(F.col("_rank") == rank, kind) for rank, (kind, _, _) in enumerate(kinds, 1)])
    return codes.select("domain_id", "code").distinct().join(best, ["domain_id", "code"], "left").select("domain_id", "code", label.alias("input_type"))
