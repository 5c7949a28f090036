"""Stock allocation: which orders get which stock, cell by cell.

The rule is an all-or-nothing greedy: SKUs in stock priority, per SKU the orders by size, and an order is taken
only if all its SKUs are covered by what is left. Stock only goes down, so an order that fails once can never
succeed later, and the whole procedure equals one pass over a fixed order of orders. ``allocate`` finds its result
in rounds over all racks at once: a round accepts every order that fits even if all undecided orders before it
were taken, and rejects every order that does not fit even if none of them were. The first undecided order of a
rack is always decided, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pickflow.functions.columns import natural_id, never_broadcast, per_batch
from pickflow.functions.intervals import overlap_join
from pickflow.functions.running import block_totals, row_numbers, running_totals, same_keys
from pickflow.schemas import BATCH_RUNNING, JOB_BOX_WAIT, JOB_WAIT, KEY, MULTI, ORDER_ASSIGNED, ORDER_WAIT
from pickflow.session import cut_lineage

RACK = ["domain_id", "equip_type", "equip_cd"]
ITEM = ["com_cd", "sku_cd"]
# Places of a rack's sequence that one task sums of a SKU.
BLOCK = 100_000
# Cells of a SKU are used up the least loaded first.
CELL_ORDER = ["load_qty", "cell_cd", "stock_id"]
CELL_COLUMNS = [*ITEM, "cell_cd", "ind_cd", "stock_id"]


def _demand() -> list[Column]:
    return [F.sum("order_qty").cast("bigint").alias("order_qty"), F.count("*").alias("line_cnt")]


def _open_lines(orders: DataFrame, *, status: str = ORDER_WAIT, order_type: str | None = MULTI, skip: DataFrame | None = None) -> DataFrame:
    """The lines that wait for stock; ``skip`` holds orders to leave out."""
    lines = orders.filter(F.col("status") == status)
    if order_type is not None:
        lines = lines.filter(F.col("order_type") == order_type)
    if skip is not None:
        lines = lines.join(skip.select(*KEY, "class_cd"), [*KEY, "class_cd"], "left_anti")
    return lines


def open_demand(orders: DataFrame, *, status: str = ORDER_WAIT, order_type: str | None = MULTI, skip: DataFrame | None = None) -> DataFrame:
    """Demand per (order, SKU) of the lines that wait for stock; ``skip`` holds orders to leave out."""
    lines = _open_lines(orders, status=status, order_type=order_type, skip=skip)
    return lines.groupBy(*KEY, "equip_type", "equip_cd", "class_cd", *ITEM).agg(*_demand())


def loaded_stock(stocks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Stock rows that can be given out: active and loaded, and with ``cells`` only those on active cells."""
    rows = stocks.filter("active_flag AND load_qty > 0 AND com_cd IS NOT NULL AND sku_cd IS NOT NULL")
    if cells is None:
        return rows
    places = cells.filter("active_flag").select(*RACK, "cell_cd", "ind_cd")
    return never_broadcast(rows).join(places, [*RACK, "cell_cd"])


def stock_total(stocks: DataFrame) -> DataFrame:
    """Pieces that can be given out per rack and SKU."""
    return loaded_stock(stocks).groupBy(*RACK, *ITEM).agg(F.sum("load_qty").cast("bigint").alias("stock_qty"))


def _rank_class() -> Column:
    return F.when(F.col("order_qty") <= F.col("load_qty"), 1).when(F.col("order_sku_cnt") >= F.col("load_qty"), 2).otherwise(3)


def _prioritised(demand: DataFrame, total: DataFrame, group: list[str]) -> DataFrame:
    """SKUs of every group with their rank class, given the stock that is left of each: ``stock_total``, or such a table for every group."""
    wanted = demand.groupBy(*group, *ITEM).agg(F.sum("order_qty").alias("order_qty"), F.sum("line_cnt").alias("order_sku_cnt"))
    stock = never_broadcast(total.withColumnRenamed("stock_qty", "load_qty"))
    joined = wanted.join(stock, [c for c in total.columns if c != "stock_qty"])
    return joined.select(*group, *ITEM, "load_qty", "order_sku_cnt", "order_qty", _rank_class().alias("assign_priority"))


def stock_priority(orders: DataFrame, stocks: DataFrame, *, status: str = ORDER_WAIT) -> DataFrame:
    """Stocked SKUs of every batch with their rank class.

    1 where the stock covers the whole demand, 2 where there are at least as many order lines as pieces, else 3.
    They are served by class, then by stock (most first), then by SKU.
    """
    return _prioritised(open_demand(orders, status=status), stock_total(stocks), [*KEY, "equip_type", "equip_cd"])


def orders_for_stock(orders: DataFrame, stocks: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Waiting orders per SKU whose demand the stock of the SKU covers."""
    covered = open_demand(orders, skip=skip).join(never_broadcast(stock_total(stocks)), [*RACK, *ITEM]).filter("order_qty <= stock_qty")
    return covered.select(*KEY, "equip_type", "equip_cd", F.col("class_cd").alias("order_no"), *ITEM, "order_qty", "stock_qty")


def _cell_intervals(stock: DataFrame) -> DataFrame:
    """Stock rows of a (rack, SKU) laid end to end, least loaded first: ``[start, end)``."""
    rows = stock.select(*RACK, *ITEM, "cell_cd", "ind_cd", F.col("id").alias("stock_id"), "load_qty")
    laid = running_totals(rows, [*RACK, *ITEM], [F.col(c).asc() for c in CELL_ORDER], {"end": F.col("load_qty"), "cell_no": 1})
    return laid.withColumn("start", F.col("end") - F.col("load_qty"))


def assign_candidates(orders: DataFrame, stocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells an order would use per SKU: in load order up to the first one that covers the demand.

    ``check_assignable`` counts the SKUs of the order that are short; SKUs that are short have no rows. The cells are
    summed once per SKU, not once per order. Runs jobs while it is built: the cells, the demand with their sums and what is
    wanted of them are read several times, so each is written once, to the checkpoint folder.
    """
    demand = open_demand(orders, order_type=None)
    laid = cut_lineage(_cell_intervals(loaded_stock(stocks, cells)).withColumn("load_sum_by_cell", F.col("end")))
    totals = laid.groupBy(*RACK, *ITEM).agg(F.sum("load_qty").alias("_total"))
    checked = cut_lineage(demand.join(totals, [*RACK, *ITEM], "left").withColumn("_short", F.coalesce("_total", F.lit(0)) < F.col("order_qty")))
    order_key = [*KEY, "equip_type", "equip_cd", "class_cd"]
    short = checked.groupBy(*order_key).agg(F.count_if("_short").alias("check_assignable"))
    wanted = cut_lineage(checked.filter(~F.col("_short")).join(short, order_key).withColumns({"start": F.lit(0).cast("bigint"), "end": F.col("order_qty")}))
    # Only the cells that [0, demand) reaches meet an order, not every cell of the SKU.
    rows = overlap_join(wanted, laid, [*RACK, *ITEM])
    return rows.select(
        *KEY,
        "equip_type",
        "equip_cd",
        F.col("class_cd").alias("order_no"),
        *ITEM,
        "order_qty",
        "cell_cd",
        "ind_cd",
        "stock_id",
        "load_qty",
        "load_sum_by_cell",
        "check_assignable",
        F.col("cell_no").cast("int").alias("ranking"),
    )


def _fill_cells(accepted: DataFrame, stock: DataFrame) -> DataFrame:
    """Lay the accepted demand of a SKU over its cells; the overlaps are the quantities to pick."""
    cells = _cell_intervals(stock).select(*RACK, *ITEM, "start", "end", "cell_cd", "ind_cd", "stock_id")
    return overlap_join(accepted, cells, [*RACK, *ITEM]).withColumnRenamed("overlap", "assign_qty")


def _ordered(demand: DataFrame, total: DataFrame, group: list[str]) -> DataFrame:
    """Demand lines with the place ``seq`` of their order in its group (a rack, or a turn of it); orders without a stocked SKU
    are left out."""
    ranked = _prioritised(demand, total, group).select(*group, *ITEM, "assign_priority", (-F.col("load_qty")).alias("_load"))
    turn = F.struct("assign_priority", "_load", "sku_cd", "com_cd", "order_qty")
    order_key = list(dict.fromkeys([*group, "batch_id", "class_cd"]))
    first = demand.join(ranked, [*group, *ITEM]).groupBy(*order_key).agg(F.min(turn).alias("_turn"))
    placed = row_numbers(first, group, [F.col("_turn").asc(), F.col("class_cd").asc(), F.col("batch_id").asc()], "seq")
    return demand.join(placed.drop("_turn"), order_key)


def _item_totals(lines: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Add running totals over the lines of an item in the order of their places.

    Lines of an item meet in one task; a hot item (``is_hot``) is cut into blocks of ``BLOCK`` places, and a block adds the totals
    of those before it.
    """
    block = F.when(F.col("is_hot"), F.floor(F.col("place") / BLOCK)).otherwise(0)
    numbered = lines.withColumn("_block", block)
    upto = Window.partitionBy("item_no", "_block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("item_no").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = numbered.filter("is_hot").groupBy("item_no", "_block").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    offsets = sums.select("item_no", "_block", *[F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in totals])
    local = numbered.withColumns({f"_local_{n}": F.sum(v).over(upto) for n, v in totals.items()})
    return local.join(offsets, ["item_no", "_block"], "left").select(
        *[c for c in lines.columns if c not in totals],
        *[(F.col(f"_local_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).cast("bigint").alias(n) for n in totals],
    )


def _round(state: DataFrame) -> DataFrame:
    """One round over lines with their place: those of accepted and of undecided orders, the ``room`` that the accepted ones before
    them leave brought up to date; rejected orders are gone. Lines that are not open were accepted in the round before and only
    count here."""
    summed = _item_totals(
        state, {"_open_upto": F.when(F.col("is_open"), F.col("qty")).otherwise(0), "_taken": F.when(F.col("is_open"), 0).otherwise(F.col("qty"))}
    ).filter("is_open")
    room = F.col("room") - F.col("_taken")
    judged = summed.withColumns({"_fits": F.col("_open_upto") <= room, "_fails": F.col("qty") > room, "room": room})
    # The lines of an order are at most as many as the SKUs of a rack.
    of_order = Window.partitionBy("place")
    verdict = judged.withColumns({"_accept": F.min("_fits").over(of_order), "_reject": F.max("_fails").over(of_order)})
    return verdict.filter(~F.col("_reject")).withColumn("is_open", ~F.col("_accept")).select(*state.columns)


def _all_of(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def _numbered_demand(lines: DataFrame) -> DataFrame:
    """Demand per (order, SKU) of lines, with a number ``order_id`` for each order; written once, as it is read several times.

    The lines of an order meet in one task, where rows are numbered one after the other; an order has the number of its first.
    """
    order_key = [*KEY, "equip_type", "equip_cd", "class_cd"]
    rank = F.row_number().over(Window.partitionBy(*order_key).orderBy(*ITEM))
    numbered = lines.select(*order_key, *ITEM, "order_qty", rank.alias("_rank")).withColumn("order_id", F.monotonically_increasing_id() - F.col("_rank"))
    return cut_lineage(numbered.groupBy(*order_key, "order_id", *ITEM).agg(*_demand()).filter(" AND ".join(f"{c} IS NOT NULL" for c in RACK)))


def _numbered_items(demand: DataFrame, loaded: DataFrame, places: DataFrame) -> DataFrame:
    """The wanted items with ``item_no``, which follows racks and the turn of the SKUs in them, and the stock ``cap`` on active cells.

    ``is_stocked`` tells which have any stock, ``is_hot`` which have more than ``BLOCK`` lines or stock rows, or a negative demand,
    which makes intervals overlap.
    """
    item = [*RACK, *ITEM]
    lines = F.sum(F.when(F.col("order_qty") < 0, BLOCK + 1).otherwise(1))
    asked = demand.groupBy(*item).agg(F.sum("order_qty").alias("order_qty"), F.sum("line_cnt").alias("order_sku_cnt"), lines.alias("_lines"))
    cell = places.groupBy(*RACK, "cell_cd").agg(F.count("*").alias("_cells"))
    total = loaded.join(cell, [*RACK, "cell_cd"], "left").groupBy(*item).agg(
        F.sum("load_qty").cast("bigint").alias("load_qty"),
        F.sum(F.col("load_qty") * F.col("_cells")).cast("bigint").alias("cap"),
        F.sum(F.coalesce("_cells", F.lit(1))).alias("_rows"),
    )
    stocked = asked.join(never_broadcast(total), item, "left").withColumn("_priority", F.when(F.col("load_qty").isNotNull(), _rank_class()))
    placed = stocked.orderBy(*RACK, F.col("_priority").asc_nulls_last(), F.col("load_qty").desc(), "sku_cd", "com_cd")
    return cut_lineage(
        placed.select(
            *item,
            F.monotonically_increasing_id().alias("item_no"),
            F.coalesce("cap", F.lit(0)).alias("cap"),
            F.col("_priority").isNotNull().alias("is_stocked"),
            (F.greatest("_lines", "_rows") > BLOCK).alias("is_hot"),
        )
    )


def _with_seq(placed: DataFrame) -> DataFrame:
    """Orders with their rank ``seq`` within the rack, from the numbers ``place`` that a sort has given."""
    # Spark numbers rows from 0 within a partition, whose own number stands from bit 33 on.
    part = F.shiftright("place", 33)
    runs = placed.groupBy(*RACK, part.alias("_part")).agg(F.min("place").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*RACK).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(*RACK, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    joined = placed.withColumn("_part", part).join(per_batch(starts), [*RACK, "_part"])
    return joined.withColumn("seq", F.col("place") - F.col("_first") + F.col("_before") + 1).drop("_part", "_first", "_before")


def _greedy(lines: DataFrame, stocks: DataFrame, cells: DataFrame) -> DataFrame:
    """The accepted lines of one wave laid over the cells of their SKU, with ``seq``.

    Orders and items are numbered first, so that lines move between tasks as numbers; names come back in the end.
    """
    item = [*RACK, *ITEM]
    demand = _numbered_demand(lines)
    # Written, so that their sizes are known: Spark broadcasts the cells if they are few.
    loaded = cut_lineage(loaded_stock(stocks).select(*item, "cell_cd", F.col("id").alias("stock_id"), "load_qty"))
    places = cut_lineage(cells.filter("active_flag").select(*RACK, "cell_cd", "ind_cd"))
    items = _numbered_items(demand, loaded, places)
    same = same_keys("d", "i", ITEM) & same_keys("d", "i", RACK)
    wanted = cut_lineage(demand.alias("d").join(never_broadcast(items).alias("i"), same).select("order_id", "item_no", F.col("order_qty").alias("qty"), "cap", "is_stocked", "is_hot"))
    # An order stands where its first SKU does; without a stocked SKU it has no place. What does not fit the whole stock never will.
    turns = wanted.groupBy("order_id").agg(F.min(F.when(F.col("is_stocked"), F.struct("item_no", "qty"))).alias("_turn"), F.max(F.col("qty") > F.col("cap")).alias("_fails"))
    heads = demand.groupBy("order_id").agg(*[F.min(c).alias(c) for c in (*RACK, "batch_id", "class_cd")])
    turned = heads.join(turns.filter("_turn IS NOT NULL"), "order_id").orderBy(*RACK, "_turn", "class_cd", "batch_id")
    # Lines without a batch or class have a place, but get no stock.
    fails = F.col("_fails") | F.col("batch_id").isNull() | F.col("class_cd").isNull()
    placed = cut_lineage(turned.select("order_id", F.monotonically_increasing_id().alias("place"), *RACK, "batch_id", "class_cd", fails.alias("_fails")))
    state = cut_lineage(
        wanted.join(placed.filter(~F.col("_fails")).select("order_id", "place"), "order_id")
        .select("place", "item_no", "qty", F.col("cap").alias("room"), "is_hot", F.lit(True).alias("is_open"))
    )
    accepted = [state.filter(~F.col("is_open"))]
    while state.filter("is_open").limit(1).count():
        # Accepted lines stay for one more round, to be added to what is taken before the open ones.
        state = cut_lineage(_round(state))
        accepted.append(state.filter(~F.col("is_open")))
    taken = _item_totals(_all_of(accepted).select("place", "item_no", "qty", "is_hot"), {"end": F.col("qty")})
    taken = cut_lineage(taken.select("place", "item_no", "is_hot", "end", (F.col("end") - F.col("qty")).alias("start")))
    given = items.select(*item, "item_no", "is_hot").join(taken.select("item_no").distinct(), "item_no")
    rows = lambda of: loaded.join(of, item).join(places, [*RACK, "cell_cd"])
    order = [F.col(c).asc() for c in CELL_ORDER]
    # Few rows of an item are summed where the join has brought them.
    upto = Window.partitionBy(*item).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = rows(never_broadcast(given.filter("NOT is_hot"))).withColumn("end", F.sum("load_qty").over(upto))
    many = running_totals(rows(cut_lineage(given.filter("is_hot"))).select("item_no", *CELL_COLUMNS, "load_qty"), ["item_no"], order, {"end": F.col("load_qty")})
    laid = lambda df: df.select("item_no", *CELL_COLUMNS, (F.col("end") - F.col("load_qty")).alias("start"), "end")
    picks = _swept(taken.filter("NOT is_hot"), laid(few)).unionByName(
        overlap_join(taken.filter("is_hot"), laid(many), ["item_no"]).select("place", *CELL_COLUMNS, F.col("overlap").alias("assign_qty"))
    )
    return picks.join(_with_seq(placed).filter(~F.col("_fails")).select("place", *RACK, "batch_id", "class_cd", "seq"), "place")


def _swept(taken: DataFrame, laid: DataFrame) -> DataFrame:
    """The overlaps of lines and cells of an item, both laid end to end from 0: between one start and the next there is one line and
    one cell, the last that began. One sort instead of the tiles of ``overlap_join``; an item's rows meet in one task."""
    line, cell = T.StructType.fromDDL("place bigint, end bigint"), T.StructType([*laid.select(*CELL_COLUMNS).schema.fields, T.StructField("end", T.LongType())])
    starts = taken.filter("start < end").select("item_no", "start", F.struct("place", "end").alias("_line"), F.lit(None).cast(cell).alias("_cell")).unionByName(
        laid.select("item_no", "start", F.lit(None).cast(line).alias("_line"), F.struct(*CELL_COLUMNS, "end").alias("_cell"))
    )
    sweep = Window.partitionBy("item_no").orderBy("start")
    upto = sweep.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = starts.withColumns({"_next": F.lead("start").over(sweep), "_line": F.last("_line", True).over(upto), "_cell": F.last("_cell", True).over(upto)})
    qty = F.least("_next", "_line.end", "_cell.end") - F.col("start")
    return parts.withColumn("assign_qty", qty).filter("_line IS NOT NULL AND _cell IS NOT NULL AND assign_qty > 0").select("_line.place", *[f"_cell.{c}" for c in CELL_COLUMNS], "assign_qty")


# Places of one turn; a place in the sequence of all turns of a rack is turn * PLACES + seq.
PLACES = 1 << 40


def _bounded(state: DataFrame) -> DataFrame:
    """Lines with the bounds ``low`` and ``high`` of the key that places their order in its turn, as far as it is known what the
    turns before take; ``high`` is null where the order may have no stocked SKU left.

    SKUs without an open line are known for good: what they mean for the key of an accepted order is kept in ``known``, and their
    lines leave. Open orders that have no stocked SKU leave as well.
    """
    item, turn_key = [*RACK, *ITEM], [*RACK, "turn"]
    qty, is_open = F.coalesce(F.col("qty"), F.lit(0)), F.col("is_open")
    per = state.groupBy(*item, "turn").agg(
        F.sum(F.when(is_open, 0).otherwise(qty)).alias("_taken"), F.sum(qty).alias("_asked"), F.max("cap").alias("_cap"), F.max(is_open).alias("_open")
    )
    earlier = Window.partitionBy(*item).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.coalesce(F.sum("_taken").over(earlier), F.lit(0))
    most = F.greatest(sure, F.least(F.coalesce(F.sum("_asked").over(earlier), F.lit(0)), F.col("_cap")))
    used = per.select(*item, "turn", sure.alias("_sure"), most.alias("_most"), F.max("_open").over(Window.partitionBy(*item)).alias("_item_open"))
    known = state.alias("l").join(used.alias("o"), same_keys("l", "o", [*item, "turn"])).select("l.*", "_item_open", (F.col("stock") - F.col("_most")).alias("_least"), (F.col("stock") - F.col("_sure")).alias("_left"))
    # The class of a SKU as in ``_prioritised``, for all that may be left of it: from _from to _left.
    start, left, asked, cnt = F.greatest("_least", F.lit(1)), F.col("_left"), F.col("asked"), F.col("cnt")
    second = (start <= cnt) & (start < asked)
    third = F.greatest(start, cnt + 1) <= F.least(left, asked - 1)
    first_class = F.when(left >= asked, 1).when(second, 2).otherwise(3)
    last_class = F.when(third, 3).when(second, 2).otherwise(1)
    key = lambda kind, load: F.struct(kind.alias("assign_priority"), (-load).alias("_load"), "sku_cd", "com_cd", "qty")
    low, high = F.when(left > 0, key(first_class, left)), F.when(F.col("_least") > 0, key(last_class, F.col("_least")))
    of_order = Window.partitionBy(*turn_key, "batch_id", "class_cd")
    lines = known.withColumns({"_low": low, "_high": high})
    lines = lines.withColumns({"known": F.least("known", F.min(F.when(~F.col("_item_open"), F.col("_low"))).over(of_order)), "low": F.min("_low").over(of_order), "high": F.min("_high").over(of_order)})
    lines = lines.withColumns({"low": F.least("low", "known"), "high": F.least("high", "known")})
    return lines.filter(F.col("_item_open") & ~(is_open & F.col("low").isNull())).select(*state.columns, "low", "high")


def _verdicts(bounded: DataFrame) -> DataFrame:
    """Open orders that are decided, with ``accept``: true where every SKU lasts even if all orders that may come before were
    taken, false where one does not last even if only those were that are accepted and surely come before.

    A line whose place is known stands there once; else at the first place it may have, where it counts as what may be taken, and
    at the last, where it counts, if accepted, as what surely is.
    """
    item, order_key = [*RACK, *ITEM], [*RACK, "turn", "batch_id", "class_cd"]
    qty, taken = F.coalesce(F.col("qty"), F.lit(0)), F.when(F.col("is_open"), 0).otherwise(F.coalesce(F.col("qty"), F.lit(0)))
    none = F.lit(0).cast("bigint")
    place = lambda key, kind, may, sure: F.struct(key.alias("key"), F.lit(kind).alias("kind"), may.cast("bigint").alias("may"), sure.cast("bigint").alias("sure"))
    both = F.array(place(F.col("low"), 1, qty, none), place(F.col("high"), 2, none, taken))
    places = F.when(F.col("low").eqNullSafe(F.col("high")), F.array(place(F.col("low"), 0, qty, taken))).otherwise(both)
    events = bounded.select(*item, "turn", "batch_id", "class_cd", "qty", "cap", "is_open", F.explode(places).alias("_at")).select("*", "_at.*").drop("_at")
    order = [F.col("turn").asc(), F.col("key").asc_nulls_last(), F.col("class_cd").asc(), F.col("batch_id").asc(), F.col("kind").asc()]
    summed = running_totals(events, item, order, {"may_upto": F.col("may"), "sure_upto": F.col("sure")}).filter("is_open")
    fits = F.when(F.col("kind") != 1, F.col("may_upto") <= F.col("cap"))
    fails = F.when(F.col("kind") != 2, F.col("sure_upto") + F.col("qty") > F.col("cap"))
    judged = summed.groupBy(*order_key).agg(F.min(fits).alias("_fits"), F.coalesce(F.max(fails), F.lit(True)).alias("_fails"))
    return judged.filter("_fits OR _fails").select(*order_key, (~F.col("_fails")).alias("accept"))


def _greedy_by_turn(demand: DataFrame, stocks: DataFrame, cells: DataFrame) -> DataFrame:
    """The accepted lines where the batches of a rack come one after the other (``turn``), each with the stock left by then.

    What is left of a SKU for a turn lies between two bounds, as long as orders before are undecided, and so does the place of an
    order in its turn. A round decides, for all turns of all racks at once, the orders for which the bounds are enough; the first
    undecided order of a rack always is decided. So the number of rounds follows the longest chain of orders that depend on each
    other by scarce SKUs, not the number of turns. The places are those of the stock left in the end.
    """
    item, turn_key = [*RACK, *ITEM], [*RACK, "turn"]
    order_key = [*turn_key, "batch_id", "class_cd"]
    caps = loaded_stock(stocks, cells).groupBy(*item).agg(F.sum("load_qty").cast("bigint").alias("cap"))
    total = cut_lineage(stock_total(stocks))
    lines = cut_lineage(
        demand.join(caps, item, "left").select(
            *item, *KEY[1:], "class_cd", F.col("turn").cast("bigint").alias("turn"), "order_qty", "line_cnt", F.coalesce("cap", F.lit(0)).alias("cap")
        )
    )
    asked = lines.groupBy(*item, "turn").agg(F.sum("order_qty").alias("asked"), F.sum("line_cnt").alias("cnt"))
    unlimited = F.lit((1 << 62)).cast("bigint")
    start = (
        lines.join(asked.join(total, item), [*item, "turn"], "left")
        .filter(F.col("class_cd").isNotNull())
        .select(*order_key, *ITEM, F.col("order_qty").alias("qty"), "cap", F.col("stock_qty").alias("stock"), F.coalesce("asked", unlimited).alias("asked"), "cnt")
    )
    unknown = "struct<assign_priority: int, _load: bigint, sku_cd: string, com_cd: string, qty: bigint>"
    state = start.withColumns({"known": F.lit(None).cast(unknown), "is_open": F.lit(True)})
    accepted: list[DataFrame] = []
    while True:
        bounded = cut_lineage(_bounded(state))
        if not bounded.filter("is_open").limit(1).count():
            break
        verdicts = cut_lineage(_verdicts(bounded))
        accepted.append(verdicts.filter("accept").select(*order_key))
        state = (
            bounded.drop("low", "high")
            .join(verdicts, order_key, "left")
            .filter("accept IS NULL OR accept")
            .withColumn("is_open", F.col("is_open") & F.col("accept").isNull())
            .drop("accept")
        )
    taken = _all_of(accepted or [lines.select(*order_key).filter(F.lit(False))]).withColumn("_accepted", F.lit(True))
    flagged = lines.join(taken, order_key, "left")
    per = flagged.groupBy(*item, "turn").agg(F.sum(F.when(F.col("_accepted"), F.col("order_qty"))).alias("_taken"))
    earlier = Window.partitionBy(*item).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    left = (
        per.withColumn("_used", F.coalesce(F.sum("_taken").over(earlier), F.lit(0)))
        .join(total, item)
        .select(*item, "turn", (F.col("stock_qty") - F.col("_used")).alias("stock_qty"))
        .filter("stock_qty > 0")
    )
    placed = _ordered(lines, left, turn_key).join(taken, order_key).withColumn("place", F.col("turn") * PLACES + F.col("seq"))
    every = placed.select(*order_key, *ITEM, "seq", F.col("order_qty").alias("qty"), "place")
    return block_totals(every, item, "place", {"end": F.col("qty")}, width=BLOCK).withColumn("start", F.col("end") - F.col("qty"))


def _allocation(filled: DataFrame, wave: Column) -> DataFrame:
    return filled.select(
        *KEY, "equip_type", "equip_cd", F.col("class_cd").alias("order_no"), *ITEM, "cell_cd", "ind_cd", "stock_id", "assign_qty", "seq", wave.alias("wave")
    )


def allocate(orders: DataFrame, stocks: DataFrame, cells: DataFrame, batches: DataFrame | None = None, *, wave: str = "equip", skip: DataFrame | None = None, status: str = ORDER_WAIT) -> DataFrame:
    """Allocations (order, SKU, cell, quantity) of all multi orders in ``status``: waiting, or instructed where orders are typed first.

    With ``wave="equip"`` all waiting orders of a rack compete in one pass. With ``wave="batch"`` the batches of
    a rack come one after the other, newest job date first (``batches``), each with the stock the earlier ones left.
    Runs jobs while it is built: some per round, written to the checkpoint folder.
    """
    if wave == "equip":
        return _allocation(_greedy(_open_lines(orders, status=status, skip=skip), stocks, cells), F.lit(1).cast("bigint"))
    if wave != "batch":
        raise ValueError(f"wave must be equip or batch, not {wave!r}")
    if batches is None:
        raise ValueError("wave='batch' needs the batches")
    # The demand is read several times, so it is written once.
    demand = cut_lineage(open_demand(orders, status=status, skip=skip))
    rack_batches = demand.select(*KEY, "equip_type", "equip_cd").distinct().join(
        batches.filter(F.col("status") == BATCH_RUNNING).select("domain_id", F.col("id").alias("batch_id"), "job_date"), KEY
    )
    turns = row_numbers(rack_batches, RACK, [F.col("job_date").desc_nulls_last(), F.col("batch_id").asc()], "turn").drop("job_date")
    accepted = _greedy_by_turn(demand.join(turns, [*RACK, "batch_id"]), stocks, cells)
    # Stock is used up cell by cell, the least loaded first, so one laying of all turns is the same as one for each.
    return _allocation(_fill_cells(accepted, loaded_stock(stocks, cells)), F.col("turn"))


def allocate_lines(orders: DataFrame, stocks: DataFrame, cells: DataFrame, *, order_type: str | None = None) -> DataFrame:
    """Allocation of the orders that want exactly one SKU: per SKU the smallest orders first while the stock lasts.

    The closed form of ``allocate`` for such orders: one running total, no rounds.
    """
    demand = open_demand(orders, order_type=order_type)
    order_key = [*KEY, "equip_type", "equip_cd", "class_cd"]
    item = [*RACK, *ITEM]
    single = demand.groupBy(*order_key).agg(F.count("*").alias("_skus")).filter("_skus = 1").select(*order_key)
    lines = demand.join(single, order_key, "left_semi").select(*item, "batch_id", "class_cd", F.col("order_qty").alias("qty"))
    usable = loaded_stock(stocks, cells)
    caps = usable.groupBy(*item).agg(F.sum("load_qty").alias("cap"))
    order = [F.col(c).asc() for c in ("qty", "class_cd", "batch_id")]
    laid = running_totals(lines.join(caps, item), item, order, {"end": F.col("qty"), "seq": 1})
    accepted = laid.filter("end <= cap").withColumn("start", F.col("end") - F.col("qty"))
    return _allocation(_fill_cells(accepted, usable), F.lit(1).cast("bigint"))


def create_jobs(orders: DataFrame, allocations: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """One pick job per allocation, with the attributes of its order lines.

    The job waits for a box request (BW) where the batch is configured so (``flags`` from ``config_flags``), else W.
    """
    attributes = "job_type job_date job_seq stage_cd cust_order_no box_class_cd shop_cd box_type_cd order_type".split()
    heads = orders.groupBy(*KEY, "class_cd", *ITEM).agg(*[F.max(c).alias(c) for c in ("order_no", *attributes)])
    jobs = allocations.withColumnRenamed("order_no", "class_cd").join(heads, [*KEY, "class_cd", *ITEM])
    request = F.lit(False)
    if flags is not None:
        jobs = jobs.join(flags.select(*KEY, F.col("preprocess_box_request_enabled").alias("_request")), KEY, "left")
        request = F.coalesce("_request", F.lit(False))
    return jobs.select(
        natural_id("domain_id", "batch_id", "class_cd", *ITEM, "stock_id").alias("id"),
        *KEY,
        "equip_type",
        "equip_cd",
        F.col("cell_cd").alias("sub_equip_cd"),
        "ind_cd",
        "order_no",
        "class_cd",
        *ITEM,
        *attributes,
        F.col("assign_qty").cast("int").alias("pick_qty"),
        F.lit(0).alias("picking_qty"),
        F.lit(0).alias("picked_qty"),
        F.lit(0).cast("bigint").alias("input_seq"),
        F.when(request, JOB_BOX_WAIT).otherwise(JOB_WAIT).alias("status"),
    )


def stock_after(stocks: DataFrame, allocations: DataFrame) -> DataFrame:
    """Stock rows after the allocations: loaded less, allocated more."""
    given = allocations.groupBy("domain_id", F.col("stock_id").alias("id")).agg(F.sum("assign_qty").cast("int").alias("_given"))
    amount = F.coalesce("_given", F.lit(0))
    return (
        stocks.join(given, ["domain_id", "id"], "left")
        .withColumns({"load_qty": F.col("load_qty") - amount, "alloc_qty": F.col("alloc_qty") + amount})
        .drop("_given")
    )


def orders_after(orders: DataFrame, allocations: DataFrame, *, status: str = ORDER_WAIT) -> DataFrame:
    """Lines in ``status`` of allocated (order, SKU) pairs go to status A."""
    given = allocations.select(*KEY, F.col("order_no").alias("class_cd"), *ITEM).distinct().withColumn("_given", F.lit(True))
    joined = orders.join(given, [*KEY, "class_cd", *ITEM], "left")
    hit = F.col("_given") & (F.col("status") == status)
    return joined.withColumn("status", F.when(hit, ORDER_ASSIGNED).otherwise(F.col("status"))).drop("_given")
