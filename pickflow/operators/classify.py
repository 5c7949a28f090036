"""Class codes, order types and the racks of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickflow.functions.columns import per_batch
from pickflow.schemas import KEY, MULTI, ORDER_TYPED, SINGLE

# Columns an order class may be taken from.
CLASS_COLUMNS = ("order_no", "cust_order_no", "shop_cd", "sku_cd", "box_type_cd", "com_cd", "class_cd", "box_class_cd")


def _named_column(name: str | Column) -> Column:
    """The value of the order column called ``name``; a Column holds the name per row, null gives null."""
    if isinstance(name, str):
        if name not in CLASS_COLUMNS:
            raise ValueError(f"{name!r} cannot be a class column")
        return F.col(name)
    return F.coalesce(*[F.when(name == c, F.col(c)) for c in CLASS_COLUMNS])


def apply_class_codes(orders: DataFrame, flags: DataFrame | None = None, *, class_field: str = "order_no", box_class_field: str | None = None) -> DataFrame:
    """Set ``class_cd`` and, where configured, ``box_class_cd`` from the configured order columns.

    With ``flags`` (the result of ``config_flags``) every batch uses its own columns, and the arguments are
    the defaults; otherwise the arguments hold for all batches.
    """
    if flags is None:
        new = {"class_cd": _named_column(class_field)}
        if box_class_field:
            new["box_class_cd"] = _named_column(box_class_field)
        return orders.withColumns(new)
    fields = flags.select(
        *KEY,
        F.coalesce("preproces_cell_mapping_field", F.lit(class_field)).alias("_class_field"),
        F.coalesce("box_out_class_field", F.lit(box_class_field)).alias("_box_field"),
    )
    return (
        orders.join(fields, KEY, "left")
        .withColumns(
            {
                "class_cd": F.coalesce(_named_column(F.col("_class_field")), F.col("class_cd")),
                "box_class_cd": F.coalesce(_named_column(F.col("_box_field")), F.col("box_class_cd")),
            }
        )
        .drop("_class_field", "_box_field")
    )


def order_classes(orders: DataFrame, single_pack: bool | str = True) -> DataFrame:
    """Order type per class: one (company, SKU) is a single order if single packing is on, more is a multi order.

    More than one distinct pair is the same as a smallest pair unlike the largest one, which needs no
    distinct step and keeps a class of any size in partial aggregates.
    """
    pair = F.struct("com_cd", "sku_cd")
    enabled = F.lit(single_pack) if isinstance(single_pack, bool) else F.col(single_pack)
    one = F.min(pair).eqNullSafe(F.max(pair))
    typed = orders.groupBy(*KEY, "class_cd").agg(one.alias("_one"))
    return typed.select(*KEY, "class_cd", F.when(F.col("_one") & enabled, SINGLE).otherwise(MULTI).alias("order_type"))


def classify_orders(orders: DataFrame, *, single_pack: bool = True, variant: str = "distinct_sku") -> DataFrame:
    """Order type and status of every line.

    Batches in which the upstream system typed any line keep their types and only go to status T.
    ``distinct_sku`` types the other batches by the number of distinct SKUs of the class. ``line_count`` only
    marks classes that have several lines of one SKU as multi, and leaves the rest as it is.
    """
    if variant not in ("distinct_sku", "line_count"):
        raise ValueError(f"unknown variant {variant!r}")
    given = orders.groupBy(*KEY).agg((F.count("order_type") > 0).alias("_given"))
    if variant == "distinct_sku":
        types = order_classes(orders, single_pack).withColumnRenamed("order_type", "_type")
    else:
        repeated = orders.groupBy(*KEY, "class_cd", "com_cd", "sku_cd").count().filter("count > 1")
        types = repeated.select(*KEY, "class_cd").distinct().withColumn("_type", F.lit(MULTI))
    typed = F.coalesce("_given", F.lit(False)) | F.col("_type").isNotNull()
    return (
        orders.join(per_batch(given), KEY, "left")
        .join(types, [*KEY, "class_cd"], "left")
        .withColumns(
            {
                "order_type": F.when(F.col("_given"), F.col("order_type")).otherwise(
                    F.coalesce("_type", "order_type")
                ),
                "status": F.when(typed, ORDER_TYPED).otherwise(F.col("status")),
            }
        )
        .drop("_given", "_type")
    )


def classify_counts(orders: DataFrame) -> DataFrame:
    """Number of multi and single classes per batch, after classification."""
    classes = orders.groupBy(*KEY, "class_cd").agg(
        F.max((F.col("order_type") == MULTI).cast("int")).alias("_mt"),
        F.max((F.col("order_type") == SINGLE).cast("int")).alias("_ot"),
    )
    return classes.groupBy(*KEY).agg(
        F.coalesce(F.sum("_mt"), F.lit(0)).cast("bigint").alias("mt_count"),
        F.coalesce(F.sum("_ot"), F.lit(0)).cast("bigint").alias("ot_count"),
    )


def _named_racks(orders: DataFrame) -> DataFrame:
    return orders.filter("equip_cd IS NOT NULL").select(*KEY, "equip_cd").distinct()


def splittable_batches(orders: DataFrame) -> DataFrame:
    """Per batch the number of racks its lines name; more than one means the batch can be split."""
    return _named_racks(orders).groupBy(*KEY).agg(F.count("*").alias("rack_count"), F.min("equip_cd").alias("first_equip_cd"))


def racks_for_batch(orders: DataFrame, racks: DataFrame) -> DataFrame:
    """Racks named by the order lines of a batch, with the mark whether the batch can be split."""
    named = _named_racks(orders).withColumnRenamed("equip_cd", "rack_cd")
    counts = splittable_batches(orders).select(*KEY, (F.col("rack_count") > 1).alias("is_splittable"))
    return (
        named.join(racks.select("domain_id", "rack_cd", "rack_nm"), ["domain_id", "rack_cd"])
        .join(counts, KEY)
        .select(*KEY, "rack_cd", "rack_nm", "is_splittable")
    )


def single_racks(orders: DataFrame, racks: DataFrame) -> DataFrame:
    """The rack of every batch that names exactly one."""
    one = splittable_batches(orders).filter("rack_count = 1")
    return one.join(
        racks.select("domain_id", F.col("rack_cd").alias("first_equip_cd"), F.col("rack_nm").alias("equip_nm")),
        ["domain_id", "first_equip_cd"],
    ).select(*KEY, F.col("first_equip_cd").alias("equip_cd"), "equip_nm")


def assign_single_rack(orders: DataFrame, racks: DataFrame) -> DataFrame:
    """Lines without a rack get the rack of the batch, and its name, if the batch has exactly one; other lines stay as they are."""
    name = F.col("equip_nm") if "equip_nm" in orders.columns else F.lit(None).cast("string")
    rack = single_racks(orders, racks).select(*KEY, F.col("equip_cd").alias("_equip_cd"), F.col("equip_nm").alias("_equip_nm"))
    filled = F.col("equip_cd").isNull() & F.col("_equip_cd").isNotNull()
    return (
        orders.join(per_batch(rack), KEY, "left")
        .withColumns({"equip_nm": F.when(filled, F.col("_equip_nm")).otherwise(name), "equip_cd": F.coalesce("equip_cd", "_equip_cd")})
        .drop("_equip_cd", "_equip_nm")
    )
