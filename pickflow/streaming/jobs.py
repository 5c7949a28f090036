"""Structured Streaming jobs for pick, box, receipt and progress events.

Each function takes a streaming DataFrame and returns one, or starts a query that writes with ``foreachBatch``. Every
write is repeatable: a micro-batch that runs again after a failure replaces its own output. State that has served its
purpose leaves the state store: what a watermark or a stated time has passed. By then the tables that the streams look
things up in must show it (jobs finished, inputs running).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pickflow.functions.columns import where
from pickflow.operators.classify import order_classes
from pickflow.operators.inputs import arrival_candidates
from pickflow.operators.receive import ITEM_KEYS, LINE_KEYS, faulty_items, receipt_items, receive_orders, receive_summary
from pickflow.schemas import JOB_FINISHED, JOB_PICKING, KEY, ORDER_TYPED, ORDER_WAIT, RECEIPT_ERROR, RECEIPT_FINISHED
from pickflow.session import SETTINGS
from pickflow.streaming.updates import compact, last_state, latest_rows, write_epoch

__all__ = ["dropped_late", "last_orders", "latest_rows", "stream_box_arrival", "stream_confirm_pick", "stream_progress", "stream_receive", "write_updates"]

CONFIRM_OUTPUT = (
    "domain_id int, batch_id string, id string, picked_qty int, applied_qty int, status string,"
    " pick_started_at timestamp_ntz, pick_ended_at timestamp_ntz"
)
# Per job of a slot: pieces picked so far, first pick and filling pick in microseconds (-1 until full), what was to be
# picked and had been picked when the job was first seen, so that a restart on an updated job table counts nothing twice,
# and its last event.
CONFIRM_FIELDS = ("applied", "started", "ended", "room", "had", "last")
# The jobs of a slot and their fields as one Arrow table, which takes no step per job between the store and Python.
CONFIRM_STATE = "jobs binary"
# Events of a slot that are ordered by time at once; more of them in a micro-batch count in the order they arrive.
CHUNK = 4_000_000
# State is kept on the executors' disks, as it has a row per event within the lateness; by Spark's default it is held in their heaps.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": SETTINGS["spark.sql.streaming.stateStore.providerClass"],
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
LATENESS = "30 days"
IDLE = "90 days"
SLOTS = 1024


def _micros(duration: str) -> int:
    """Microseconds of a duration such as ``30 days``."""
    return int(pd.Timedelta(duration) / pd.Timedelta(microseconds=1))


def _slot_function(finished: str, picking: str, idle_us: int) -> Callable[..., Iterator[pd.DataFrame]]:
    """The state function of a slot. It is a closure, so Spark sends its code to the workers with the query."""
    fields, chunk = CONFIRM_FIELDS, CHUNK
    kept = pa.schema([("job", pa.string()), *[(f, pa.int64()) for f in fields]])
    begin = {"applied": 0, "started": np.iinfo("int64").max, "ended": -1, "last": -1}

    def load(state: GroupState) -> tuple[dict[str, int], dict[str, np.ndarray]]:
        """The place of every job of the slot, and its fields by place."""
        table = pa.ipc.open_stream(state.get[0]).read_all() if state.exists else kept.empty_table()
        jobs = table["job"].to_pylist()
        return dict(zip(jobs, range(len(jobs)))), {f: table[f].to_numpy().astype("int64") for f in fields}

    def keep(jobs: dict[str, int], known: dict[str, np.ndarray], state: GroupState) -> None:
        """Keep what the watermark has not passed, and be called again when it passes the next job."""
        watermark = state.getCurrentWatermarkMs()
        due = known["last"] + (known["ended"] < 0) * idle_us
        stay = due >= watermark * 1000
        if not stay.any():
            state.remove()
            return
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept) as out:
            out.write_batch(pa.record_batch([pa.array(jobs, pa.string()).filter(stay), *[pa.array(known[f][stay]) for f in fields]], schema=kept))
        state.update((sink.getvalue().to_pybytes(),))
        state.setTimeoutTimestamp(max(int(due[stay].min()) // 1000, watermark) + 1)

    def take(known: dict[str, np.ndarray], fresh: list[pd.DataFrame], events: list[tuple]) -> dict[str, np.ndarray]:
        """The fields after ``events`` (places, times, quantities), with one step for all jobs; those in ``fresh`` are new."""
        new = pd.concat(fresh) if fresh else pd.DataFrame({"room": [], "had": []})
        known = {f: np.concatenate([known[f], np.asarray(new[f], dtype="int64") if f in new else np.full(len(new), begin[f], dtype="int64")]) for f in fields}
        place, us, qty = (np.concatenate(x) for x in zip(*events))
        order = np.lexsort((us, place))
        place, us, qty = place[order], us[order], qty[order]
        start = np.flatnonzero(np.diff(place, prepend=-1))
        end = np.append(start[1:], len(place))
        at, cnt, upto = place[start], end - start, np.cumsum(qty)
        reached = upto + np.repeat(known["applied"][at] - (upto[start] - qty[start]), cnt)
        # Quantities are positive, so the events from the filling one on are the last of a job.
        over = np.add.reduceat((reached >= known["room"][place]).astype("int64"), start)
        filling = np.where(over > 0, us[np.minimum(end - over, len(us) - 1)], -1)
        known["ended"][at] = np.where(known["ended"][at] >= 0, known["ended"][at], filling)
        known["applied"][at] = np.minimum(reached[end - 1], known["room"][at])
        known["started"][at] = np.minimum(known["started"][at], us[start])
        known["last"][at] = np.maximum(known["last"][at], us[end - 1])
        return known

    def confirm(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """State of the jobs of one slot: takes their new events by time, each job up to its planned quantity.

        Of the events their places, times and quantities are held, at most ``CHUNK`` of them.
        """
        jobs, known = load(state)
        fresh, events, rows, told, touched = [], [], 0, set(), []
        for batch in batches:
            if not len(batch):  # called because the watermark has passed a job
                continue
            codes, names = pd.factorize(batch["job"].to_numpy())
            before = len(jobs)
            place = np.array([jobs.setdefault(n, len(jobs)) for n in names], dtype="int64")
            first = np.empty(len(names), dtype="int64")
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            seen = batch.iloc[first].set_axis(place)
            fresh.append(seen.loc[place >= before, ["room", "had"]])
            touched.append(seen.loc[[p not in told for p in place.tolist()], ["domain_id", "batch_id", "job_id"]])
            told.update(place.tolist())
            events.append((place[codes], batch["us"].to_numpy(), batch["qty"].to_numpy()))
            rows += len(batch)
            if rows >= chunk:
                known, fresh, events, rows = take(known, fresh, events), [], [], 0
        known = take(known, fresh, events) if events else known
        keep(jobs, known, state)
        if not touched:
            return
        plan = pd.concat(touched)
        of = {f: known[f][plan.index] for f in fields}
        # Not to_datetime: it rounds what stands in place of missing floats, and may overflow there.
        missing = np.iinfo("int64").min
        yield pd.DataFrame(
            {
                "domain_id": plan["domain_id"].to_numpy(),
                "batch_id": plan["batch_id"].to_numpy(),
                "id": plan["job_id"].to_numpy(),
                "picked_qty": of["had"] + of["applied"],
                "applied_qty": of["applied"],
                "status": np.where(of["applied"] >= of["room"], finished, picking).astype(object),
                "pick_started_at": of["started"].view("datetime64[us]"),
                "pick_ended_at": np.where(of["ended"] >= 0, of["ended"], missing).view("datetime64[us]"),
            }
        )

    return confirm


def _timed(events: DataFrame, lateness: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came later than the watermark allows and were left out, as far back as the query's progress goes."""
    return sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p["stateOperators"])


def stream_confirm_pick(events: DataFrame, jobs: DataFrame, *, lateness: str = LATENESS, idle: str = IDLE, slots: int = SLOTS) -> DataFrame:
    """Jobs as pick events come in: one row per changed job and micro-batch (update mode).

    An event that is delivered twice within ``lateness`` counts once. Jobs that are not in picking take no events.
    Events count in the order they arrive, those of one micro-batch by time. The state is kept per slot (hash of
    the job), because a state call per job costs far more than the work in it; choose ``slots`` so that a slot holds
    some thousands of jobs, as a slot is read and written as a whole. A checkpoint holds for one number of slots.

    A job leaves the state when the watermark passes its last event (a full job) or that event plus ``idle`` (a job that
    never filled). Its own events are late from then on and left out; ``dropped_late`` counts them. A later event for it
    counts as the first, so ``jobs`` must show by then what was picked.
    """
    open_jobs = where(jobs, status=JOB_PICKING).filter("picked_qty < pick_qty")
    plan = open_jobs.select(
        *KEY, F.col("id").alias("job_id"), (F.col("pick_qty") - F.col("picked_qty")).cast("bigint").alias("room"), F.col("picked_qty").cast("bigint").alias("had")
    )
    once = _timed(events.filter("qty > 0"), lateness).dropDuplicatesWithinWatermark(["event_id"])
    job = F.concat_ws("|", *KEY, "job_id")
    taken = once.join(plan, [*KEY, "job_id"]).select(
        F.pmod(F.xxhash64(job), F.lit(slots)).alias("slot"),
        job.alias("job"),
        *KEY,
        "job_id",
        F.unix_micros("ts").alias("us"),
        F.col("qty").cast("bigint").alias("qty"),
        "room",
        "had",
        "ts",
    )
    return taken.groupBy("slot").applyInPandasWithState(
        _slot_function(JOB_FINISHED, JOB_PICKING, _micros(idle)), CONFIRM_OUTPUT, CONFIRM_STATE, "update", GroupStateTimeout.EventTimeTimeout
    )


def stream_progress(events: DataFrame, *, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Events and picked pieces per batch and time window; late events count within ``lateness``."""
    return (
        _timed(events, lateness)
        .groupBy(*KEY, F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("event_cnt"), F.sum("qty").cast("bigint").alias("qty"))
        .select(*KEY, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_cnt", "qty")
    )


def write_updates(df: DataFrame, path: str, checkpoint: str, *, mode: str = "update", keys: list[str] | None = None, compact_every: int = 0, trigger: dict | None = None) -> StreamingQuery:
    """Write every micro-batch of updates to ``path`` under its number; ``latest_rows`` or ``last_state`` read them.

    With ``compact_every``, every so many micro-batches the state by ``keys`` up to the last finished one is written as a
    snapshot.
    """
    schema = df.schema

    def write(batch: DataFrame, epoch: int) -> None:
        write_epoch(batch, path, epoch)
        if compact_every and epoch and epoch % compact_every == 0:
            compact(batch.sparkSession, path, schema, keys or [], epoch - 1)

    return _start(df, write, checkpoint, mode, trigger)


ARRIVAL_STATE = "id array<string>, started array<bigint>"


def _arrival_function(keep_ms: int) -> Callable[..., Iterator[pd.DataFrame]]:
    """The state function of a slot of inputs: which of them have started, and when (milliseconds)."""

    def arrive(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        seen: set = set()
        out = []
        for scans in batches:
            if not len(scans):  # called because the watermark has passed an input
                continue
            scans = scans.drop(columns=["slot", "ts"])
            place = pd.Series(list(scans.drop(columns=["is_started", "ms"]).itertuples(index=False, name=None)), index=scans.index)
            scans = scans[~place.isin(seen) & ~place.duplicated()]
            seen.update(place)
            full = scans["domain_id"].astype(str) + "|" + scans["batch_id"] + "|" + scans["id"]
            starts = (scans["is_started"] == 1) & ~full.isin(known.keys()) & ~full.duplicated()
            known.update(zip(full[starts], scans["ms"][starts].tolist(), strict=True))
            out.append(scans.drop(columns="ms").assign(is_started=starts.astype("int32")))
        watermark = state.getCurrentWatermarkMs()
        known = {i: at for i, at in known.items() if at + keep_ms >= watermark}
        if known:
            state.update(([*known.keys()], [*known.values()]))
            state.setTimeoutTimestamp(max(min(known.values()) + keep_ms, watermark) + 1)
        elif state.exists:
            state.remove()
        yield from out

    return arrive


def stream_box_arrival(
    scans: DataFrame, inputs: DataFrame, path: str, checkpoint: str, *, keep: str = "7 days", lateness: str = LATENESS, slots: int = SLOTS, trigger: dict | None = None
) -> StreamingQuery:
    """Inputs that start to run because their box arrived at the station (one row per scanned place and micro-batch).

    An input that has started does not start again: started inputs are held in the state store until the watermark passes
    their start by ``keep``; ``inputs`` must show them running by then. Nothing that was written before is read. The time
    of a scan is its ``ts``, with ``lateness``; scans without that column count at the time they are processed.
    """
    place = [*KEY, "equip_type", "equip_cd", "station_cd", "box_id"]
    timed = _timed(scans, lateness) if "ts" in scans.columns else scans.withColumn("ts", F.current_timestamp()).withWatermark("ts", "1 minute")
    found = timed.select(*place, "ts").join(arrival_candidates(inputs), place)
    output = T.StructType([f for f in found.schema.fields if f.name != "ts"])
    dealt = found.select(*output.names, "ts", F.unix_millis("ts").alias("ms"), F.pmod(F.xxhash64(*KEY, "id"), F.lit(slots)).alias("slot"))
    state = dealt.groupBy("slot").applyInPandasWithState(_arrival_function(_micros(keep) // 1000), output, ARRIVAL_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return write_updates(state, path, checkpoint, mode="append", trigger=trigger)


#: What the receipt keeps besides the order lines: the type that came from upstream, and whether a line was taken back.
RECEIVED_EXTRA = "given_type string, is_withdrawn boolean"
DEAD_LETTER = [*LINE_KEYS, "area_cd", "stage_cd", "wms_batch_no", "order_qty"]


def _received_schema(wms_rows: DataFrame) -> T.StructType:
    """The columns of the order lines that a receipt of such rows keeps."""
    lines = receive_orders(wms_rows, receipt_items(receive_summary(wms_rows)), optional=["order_type"]).schema
    return T.StructType([*lines.fields, *T.StructType.fromDDL(RECEIVED_EXTRA).fields])


def last_orders(wms_rows: DataFrame, path: str) -> DataFrame:
    """The order lines that ``stream_receive`` has received so far; ``wms_rows`` gives the schema."""
    state = last_state(wms_rows.sparkSession, path, _received_schema(_with_type(wms_rows)), LINE_KEYS)
    return state.filter("NOT is_withdrawn").drop("given_type", "is_withdrawn")


def _with_type(wms_rows: DataFrame) -> DataFrame:
    return wms_rows if "order_type" in wms_rows.columns else wms_rows.withColumn("order_type", F.lit(None).cast("string"))


def stream_receive(wms_rows: DataFrame, path: str, checkpoint: str, *, compact_every: int = 20, trigger: dict | None = None) -> StreamingQuery:
    """Receive upstream rows as they arrive, and type the orders that new lines touch.

    Three logs are kept (``updates``): the order lines at ``path``, keyed by line, with a snapshot partitioned by tenant
    and batch; the receipt items at ``path_items``; and at ``path_errors`` the rows that were not received. A micro-batch
    reads the lines of the batches it touches and writes the lines of the orders it touches.

    A line that is there already stays as it is; of several rows for one line in a micro-batch the smallest counts. Types and status are those of a receipt in one go: a batch in which
    upstream typed any line keeps the given types, other orders are typed by their distinct SKUs, so an order whose lines
    come in several micro-batches gets the right type. An item with a faulty line is not received: its lines go to
    ``path_errors``, those received before are taken back. Lines that are past typing (instructed, assigned, picked) keep
    type and status in all cases.
    """
    static = wms_rows.sparkSession.createDataFrame([], _with_type(wms_rows).schema)
    order_schema = _received_schema(static)
    item_schema = receipt_items(receive_summary(static)).select(*ITEM_KEYS, *KEY[1:], "status").schema
    letter_schema = T.StructType([*static.select(*DEAD_LETTER).schema.fields, T.StructField("reason", T.StringType())])
    past = ~F.col("status").isin(ORDER_WAIT, ORDER_TYPED)

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = _with_type(batch)
        items = receipt_items(receive_summary(batch))
        keys = items.select(*ITEM_KEYS).distinct()
        before = last_state(spark, f"{path}_items", item_schema, ITEM_KEYS, before=epoch).join(keys, ITEM_KEYS, "left_semi")
        stopped = before.filter(F.col("status") == RECEIPT_ERROR).select(*ITEM_KEYS).unionByName(faulty_items(batch, items)).distinct()
        fresh = receive_orders(batch, items.join(stopped, ITEM_KEYS, "left_anti"), optional=["order_type"])
        fresh = fresh.withColumns({"given_type": F.col("order_type"), "is_withdrawn": F.lit(False)})
        # one row per line, also if a micro-batch has it twice
        others = [c for c in order_schema.names if c not in LINE_KEYS]
        fresh = fresh.groupBy(*LINE_KEYS).agg(F.min(F.struct(*others)).alias("_r")).select(*LINE_KEYS, "_r.*")

        touched = items.select("domain_id", "batch_id").distinct()
        old = last_state(spark, path, order_schema, LINE_KEYS, before=epoch).join(touched, KEY, "left_semi").filter("NOT is_withdrawn")
        old = old.join(stopped.withColumn("_stop", F.lit(True)), ITEM_KEYS, "left").withColumn("_gone", F.coalesce(F.col("_stop") & ~past, F.lit(False))).drop("_stop")
        added = fresh.join(old.select(*LINE_KEYS), LINE_KEYS, "left_anti")
        lines = old.withColumn("_new", F.lit(False)).unionByName(added.withColumns({"_gone": F.lit(False), "_new": F.lit(True)}))

        stay = lines.filter("NOT _gone")
        types = order_classes(stay).withColumnRenamed("order_type", "_type")
        orders = lines.groupBy(*KEY, "class_cd").agg(F.max(F.col("_new") | F.col("_gone")).alias("_touched"))
        given = lines.groupBy(*KEY).agg(
            F.count_if(~F.col("_gone") & F.col("given_type").isNotNull()).alias("_given"), F.count_if(~F.col("_new") & F.col("given_type").isNotNull()).alias("_was")
        )
        changed = (
            lines.join(orders, [*KEY, "class_cd"])
            .join(given, KEY)
            # a batch that turns out to be typed upstream, or not to be, is typed again as a whole
            .filter(F.col("_touched") | ((F.col("_given") > 0) != (F.col("_was") > 0)))
            .join(types, [*KEY, "class_cd"], "left")
            .withColumns(
                {
                    "order_type": F.when(past, F.col("order_type")).when(F.col("_given") > 0, F.col("given_type")).otherwise(F.col("_type")),
                    "status": F.when(past, F.col("status")).otherwise(F.lit(ORDER_TYPED)),
                    "is_withdrawn": F.col("_gone"),
                }
            )
        )
        write_epoch(changed.select(*order_schema.names), path, epoch)
        # what was taken back is found among the changes just written
        withdrawn = spark.read.schema(order_schema).parquet(f"{path}/epoch={epoch}").filter("is_withdrawn")
        refused = batch.filter("if_flag = 'N'").join(stopped, ITEM_KEYS, "left_semi").select(*DEAD_LETTER, F.lit("item with a faulty line").alias("reason"))
        letters = refused.unionByName(withdrawn.select(*DEAD_LETTER, F.lit("taken back").alias("reason")))
        write_epoch(letters.select(*letter_schema.names), f"{path}_errors", epoch)
        status = F.when(F.col("_stop"), RECEIPT_ERROR).otherwise(RECEIPT_FINISHED)
        after = items.select(*ITEM_KEYS, "batch_id").distinct().join(stopped.withColumn("_stop", F.lit(True)), ITEM_KEYS, "left").withColumn("status", status)
        write_epoch(after.select(*item_schema.names), f"{path}_items", epoch)
        if compact_every and epoch and epoch % compact_every == 0:
            compact(spark, path, order_schema, LINE_KEYS, epoch - 1, partition_by=KEY)
            compact(spark, f"{path}_items", item_schema, ITEM_KEYS, epoch - 1)

    return _start(wms_rows, write, checkpoint, "append", trigger)


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str, trigger: dict | None) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    conf = df.sparkSession.conf
    # A query takes the settings as they are when it starts; what the session has chosen stays.
    unset = [key for key in ON_DISK if conf.get(key, None) is None]
    try:
        for key in unset:
            conf.set(key, ON_DISK[key])
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for key in unset:
            conf.unset(key)
