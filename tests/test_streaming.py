"""Stream jobs over several micro-batches."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

import models
from conftest import rows
from pickflow.streaming import jobs as st
from pickflow.streaming import updates
from pickflow.streaming.updates import patch_rows

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id string, domain_id int, batch_id string, job_id string, ts timestamp_ntz, qty int"


def _stream(spark, folder, schema, parts):
    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def test_confirm_pick_in_many_batches(spark, tmp_path):
    rng = random.Random(9)
    jobs = {f"J{i}": (rng.randint(1, 30), rng.choice([0, 0, 2]), rng.choice("PPPC")) for i in range(40)}
    jobs = {i: (max(p, q), q, s) for i, (p, q, s) in jobs.items()}
    events, n = [], 0
    for _ in range(4):
        part = []
        for _ in range(60):
            part.append((f"E{n:04d}", 1, "B", f"J{rng.randint(0, 42)}", T0 + dt.timedelta(minutes=n), rng.randint(1, 4)))
            n += 1
        # Every fifth event of a batch is delivered again in the next one.
        events.append(part + (events[-1][::5] if events else []))
    jdf = spark.createDataFrame([(1, "B", i, p, q, s) for i, (p, q, s) in jobs.items()], "domain_id int, batch_id string, id string, pick_qty int, picked_qty int, status string")
    stream = _stream(spark, str(tmp_path), EVENT, events)
    query = st.write_updates(st.stream_confirm_pick(stream, jdf, slots=5), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p.numInputRows]) == 4
    got = st.latest_rows(spark.read.parquet(f"{tmp_path}/out"), ["domain_id", "batch_id", "id"])
    unique = {e[0]: (e[4], e[0], e[3], e[5]) for part in events for e in part}
    want = models.confirm(jobs, list(unique.values()))
    assert {r["id"]: (r["picked_qty"], r["status"], r["pick_started_at"], r["pick_ended_at"]) for r in got.collect()} == {
        i: (j["picked"], j["status"], j["start"], j["end"]) for i, j in want.items() if j["start"]
    }


def test_progress_windows(spark, tmp_path):
    parts = [[("a", 1, "B", "J", T0, 2), ("b", 1, "B", "J", T0 + dt.timedelta(minutes=59), 3)], [("c", 1, "B", "J", T0 + dt.timedelta(minutes=30), 5), ("d", 2, "B", "J", T0, 7)]]
    query = st.write_updates(st.stream_progress(_stream(spark, str(tmp_path), EVENT, parts)), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    got = st.latest_rows(spark.read.parquet(f"{tmp_path}/out"), ["domain_id", "batch_id", "window_start"])
    assert rows(got, "domain_id", "event_cnt", "qty") == [(1, 3, 10), (2, 1, 7)]


def test_receive_types_an_order_over_two_batches(spark, tmp_path, small):
    schema = small.wms_if_orders.schema
    sample = small.wms_if_orders.filter("if_flag = 'N'").limit(1).collect()[0].asDict()

    def line(order, no, sku):
        return {**sample, "order_no": order, "order_line_no": no, "sku_cd": sku, "order_qty": 1}

    parts = [[line("O1", "1", "S1"), line("O2", "1", "S1")], [line("O1", "2", "S2"), line("O2", "1", "S1")]]
    stream = _stream(spark, str(tmp_path), schema, [[tuple(p[f] for f in schema.names) for p in part] for part in parts])
    st.stream_receive(stream, f"{tmp_path}/orders", f"{tmp_path}/cp").awaitTermination()
    got = rows(st.last_orders(small.wms_if_orders, f"{tmp_path}/orders"), "order_no", "order_line_no", "order_type", "status")
    # The second line makes O1 a multi order; the repeated line of O2 is there once.
    assert got == [("O1", "1", "MT", "T"), ("O1", "2", "MT", "T"), ("O2", "1", "OT", "T")]


def test_box_arrival_starts_waiting_inputs(spark, tmp_path):
    schema = "id string, domain_id int, batch_id string, equip_type string, equip_cd string, station_cd string, order_no string, box_id string, input_seq bigint, status string"
    inputs = spark.createDataFrame([
        ("run", 1, "B", "Rack", "R1", "S1", "O1", "X", 1, "R"), ("wait", 1, "B", "Rack", "R1", "S1", "O1", "X", 2, "W"), ("done", 1, "B", "Rack", "R1", "S1", "O2", "Y", 3, "F"), ("only", 1, "B", "Rack", "R1", "S2", "O3", "Z", 4, "R"),
    ], schema)
    scans = _stream(spark, str(tmp_path), "domain_id int, batch_id string, equip_type string, equip_cd string, station_cd string, box_id string",
                    [[(1, "B", "Rack", "R1", "S1", "X"), (1, "B", "Rack", "R1", "S1", "Y")], [(1, "B", "Rack", "R1", "S2", "Z")]])
    st.stream_box_arrival(scans, inputs, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "id", "status", "is_started")
    assert got == [("only", "R", 0), ("wait", "R", 1)]


def test_stream_equals_batch_on_the_sample(spark, small):
    from checks.registry import queries
    from conftest import SMALL
    from pickflow.operators.picking import confirm_pick

    columns = ["id", "picked_qty", "status", "pick_started_at", "pick_ended_at"]
    streamed = queries()["stream_confirm_pick"](spark, SMALL)
    batch = confirm_pick(small.picking_jobs_at_start, small.pick_events)
    assert rows(streamed, *columns) == rows(batch, *columns)
    assert batch.filter(F.col("status") == "F").count() > 0


def test_confirm_pick_restarts_on_an_updated_job_table(spark, tmp_path):
    def table(picked):
        return spark.createDataFrame([(1, "B", "J", 10, picked, "P")], "domain_id int, batch_id string, id string, pick_qty int, picked_qty int, status string")

    def run(part, picked, n):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        st.write_updates(st.stream_confirm_pick(stream, table(picked), slots=2), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
        return st.latest_rows(spark.read.parquet(f"{tmp_path}/out"), ["domain_id", "batch_id", "id"]).first()["picked_qty"]

    assert run([("a", 1, "B", "J", T0, 3)], 0, 1) == 3
    assert run([("b", 1, "B", "J", T0 + dt.timedelta(minutes=1), 2)], 3, 2) == 5
    assert run([("c", 1, "B", "J", T0 + dt.timedelta(minutes=2), 9)], 5, 3) == 10


def test_a_box_starts_once(spark, tmp_path):
    inputs = spark.createDataFrame([("I1", 1, "B", "Rack", "R1", "S1", "O1", "X", 1, "W")], "id string, domain_id int, batch_id string, equip_type string, equip_cd string, station_cd string, order_no string, box_id string, input_seq bigint, status string")
    scan = "domain_id int, batch_id string, equip_type string, equip_cd string, station_cd string, box_id string"
    stream = _stream(spark, str(tmp_path), scan, [[(1, "B", "Rack", "R1", "S1", "X")]] * 3)
    st.stream_box_arrival(stream, inputs, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "epoch", "is_started") == [(0, 1), (1, 0), (2, 0)]


def test_a_late_line_leaves_assigned_lines_as_they_are(spark, tmp_path, small):
    schema = small.wms_if_orders.schema
    line = small.wms_if_orders.filter("if_flag = 'N'").limit(1).collect()[0].asDict()

    def run(n, no):
        spark.createDataFrame([{**line, "order_line_no": no, "sku_cd": f"SKU{no}"}], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        st.stream_receive(stream, f"{tmp_path}/orders", f"{tmp_path}/cp").awaitTermination()
        return st.last_orders(small.wms_if_orders, f"{tmp_path}/orders")

    first = run(1, "1")
    assert rows(first, "order_line_no", "order_type", "status") == [("1", "OT", "T")]
    assigned = first.withColumns({"status": F.lit("A"), "given_type": F.lit(None).cast("string"), "is_withdrawn": F.lit(False)})
    patch_rows(assigned, f"{tmp_path}/orders")
    assert rows(run(2, "2"), "order_line_no", "order_type", "status") == [("1", "OT", "A"), ("2", "MT", "T")]


def _state_rows(query, operator):
    """Rows in the state of an operator after each micro-batch."""
    return [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == operator]


def test_a_finished_job_leaves_the_state(spark, tmp_path):
    def at(hours):
        return T0 + dt.timedelta(hours=hours)

    jobs = spark.createDataFrame([(1, "B", j, 5, 0, "P") for j in ("A", "B", "C", "D")], "domain_id int, batch_id string, id string, pick_qty int, picked_qty int, status string")
    parts = [
        [("a", 1, "B", "A", at(0), 5), ("d", 1, "B", "D", at(0), 1)],
        [("b", 1, "B", "B", at(5), 5)],
        [("c", 1, "B", "C", at(10), 2)],
        [("a", 1, "B", "A", at(0), 5), ("a2", 1, "B", "A", at(1), 1), ("c1", 1, "B", "C", at(11), 1)],  # a again, and a late event
        [("c2", 1, "B", "C", at(400), 9)],
        [("c3", 1, "B", "C", at(401), 9)],
    ]
    stream = _stream(spark, str(tmp_path), EVENT, parts)
    query = st.write_updates(st.stream_confirm_pick(stream, jobs, lateness="1 hour", idle="300 hours", slots=10_000), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    # A and B go once the watermark has passed them, D, which never filled, after 300 idle hours; C at 401 hours is kept
    sizes = _state_rows(query, "applyInPandasWithState")
    assert sizes[0] == 2 and max(sizes) <= 3 and sizes[-1] == 1
    assert st.dropped_late(query) == 2
    got = st.latest_rows(spark.read.parquet(f"{tmp_path}/out"), ["domain_id", "batch_id", "id"])
    assert rows(got, "id", "picked_qty", "status") == [("A", 5, "F"), ("B", 5, "F"), ("C", 5, "F"), ("D", 1, "P")]


INPUT = "id string, domain_id int, batch_id string, equip_type string, equip_cd string, station_cd string, order_no string, box_id string, input_seq bigint, status string"
SCAN = "domain_id int, batch_id string, equip_type string, equip_cd string, station_cd string, box_id string, ts timestamp_ntz"


def test_box_arrival_reads_nothing_it_has_written_and_forgets_in_time(spark, tmp_path):
    inputs = spark.createDataFrame([(f"I{n}", 1, "B", "Rack", "R1", "S1", f"O{n}", f"X{n}", n, "W") for n in range(6)], INPUT)

    def run(n, scans):
        spark.createDataFrame([(1, "B", "Rack", "R1", "S1", box, T0 + dt.timedelta(days=day)) for box, day in scans], SCAN).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(SCAN).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = st.stream_box_arrival(stream, inputs, f"{tmp_path}/out{n}", f"{tmp_path}/cp", keep="3 days", lateness="1 day", slots=10_000)
        query.awaitTermination()
        written = spark.read.parquet(f"{tmp_path}/out{n}")
        return rows(written, "id", "is_started"), _state_rows(query, "applyInPandasWithState")[-1]

    # each run writes elsewhere and could not find earlier output; the state alone knows what has started
    assert run(1, [("X1", 0), ("X2", 0), ("X1", 0)]) == ([("I1", 1), ("I2", 1)], 2)
    assert run(2, [("X1", 1), ("X3", 1)]) == ([("I1", 0), ("I3", 1)], 3)
    started, size = run(3, [("X4", 9)])
    assert started == [("I4", 1)] and size == 1  # the watermark is at day 8: those of day 0 and 1 are forgotten


def _lines(spark, small, tmp_path, parts, **options):
    """``stream_receive`` over parts of lines (item, order, line, sku, qty, type)."""
    base = small.wms_if_orders.filter("if_flag = 'N'").limit(1).collect()[0].asDict()
    schema = T.StructType([*small.wms_if_orders.schema.fields, T.StructField("order_type", T.StringType())])
    for n, part in enumerate(parts):
        rows_ = [{**base, "com_cd": com, "order_no": o, "order_line_no": no, "sku_cd": sku, "order_qty": qty, "order_type": kind} for com, o, no, sku, qty, kind in part]
        spark.createDataFrame([tuple(r[f] for f in schema.names) for r in rows_], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    return schema, lambda: st.stream_receive(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), f"{tmp_path}/orders", f"{tmp_path}/cp", **options
    ).awaitTermination()


def test_receive_sends_an_item_with_a_faulty_line_to_the_errors(spark, tmp_path, small):
    parts = [
        [("K1", "O1", "1", "S1", 1, None), ("K2", "O2", "1", "S1", 1, None)],
        [("K2", "O2", "2", "S2", None, None), ("K1", "O3", "1", "S1", 2, None)],
        [("K2", "O4", "1", "S4", 1, None), ("K1", "O1", "2", "S1", 1, None)],
    ]
    schema, run = _lines(spark, small, tmp_path, parts)
    run()
    empty = spark.createDataFrame([], schema)
    assert rows(st.last_orders(empty, f"{tmp_path}/orders"), "order_no", "order_line_no", "order_type", "status") == [("O1", "1", "OT", "T"), ("O1", "2", "OT", "T"), ("O3", "1", "OT", "T")]
    letters = spark.read.parquet(f"{tmp_path}/orders_errors")
    assert rows(letters, "epoch", "order_no", "order_line_no", "reason") == [(1, "O2", "1", "taken back"), (1, "O2", "2", "item with a faulty line"), (2, "O4", "1", "item with a faulty line")]
    assert rows(st.latest_rows(spark.read.parquet(f"{tmp_path}/orders_items"), ["com_cd"]), "com_cd", "status") == [("K1", "F"), ("K2", "E")]
    # a micro-batch writes the orders it touches only
    assert rows(spark.read.parquet(f"{tmp_path}/orders").filter("epoch = 2"), "order_no", "order_line_no") == [("O1", "1"), ("O1", "2")]


def test_receive_keeps_upstream_types_and_can_run_again(spark, tmp_path, small):
    parts = [[("K", "O1", "1", "S1", 1, None), ("K", "O2", "1", "S1", 1, None)], [("K", "O1", "2", "S2", 1, None)], [("K", "O3", "1", "S1", 1, "MT")]]
    schema, run = _lines(spark, small, tmp_path, parts, compact_every=1)
    run()
    empty = spark.createDataFrame([], schema)
    # the third line shows that upstream types this batch: computed types are dropped, as in a receipt in one go
    want = [("O1", "1", None, "T"), ("O1", "2", None, "T"), ("O2", "1", None, "T"), ("O3", "1", "MT", "T")]
    assert sorted(rows(st.last_orders(empty, f"{tmp_path}/orders"), "order_no", "order_line_no", "order_type", "status")) == want
    # the driver dies before the last micro-batch is marked as done: it runs again
    os.remove(f"{tmp_path}/cp/commits/2")
    for name in glob.glob(f"{tmp_path}/cp/commits/.2*"):
        os.remove(name)
    run()
    assert sorted(rows(st.last_orders(empty, f"{tmp_path}/orders"), "order_no", "order_line_no", "order_type", "status")) == want


def test_snapshots_of_an_update_log(spark, tmp_path):
    schema = T.StructType.fromDDL("k int, v string")
    path, keys = f"{tmp_path}/log", ["k"]

    def put(epoch, *pairs):
        updates.write_epoch(spark.createDataFrame(list(pairs), schema), path, epoch)

    def state(before=None):
        return rows(updates.last_state(spark, path, schema, keys, before=before))

    assert state() == []
    for epoch in range(6):
        put(epoch, (epoch % 4, f"v{epoch}"), (9, f"n{epoch}"))
    want = [(0, "v4"), (1, "v5"), (2, "v2"), (3, "v3"), (9, "n5")]
    assert state() == want
    updates.compact(spark, path, schema, keys, 2)
    assert updates.log_parts(spark, path) == (2.0, [3.0, 4.0, 5.0]) and state() == want
    assert state(before=2) == [(0, "v0"), (1, "v1"), (9, "n1")]  # older epochs are there until the next snapshot
    # a run that ended within a snapshot left a folder without success mark
    spark.createDataFrame([(77, "half")], schema).write.parquet(f"{path}_snapshot/epoch=4")
    os.remove(f"{path}_snapshot/epoch=4/_SUCCESS")
    assert updates.log_parts(spark, path)[0] == 2.0 and state() == want
    updates.compact(spark, path, schema, keys, 4)
    assert updates.log_parts(spark, path) == (4.0, [5.0]) and state() == want
    assert sorted(os.listdir(path)) == ["epoch=3", "epoch=4", "epoch=5"]  # what the first snapshot covers is gone
    # one that ended before the removal is done again by the next
    put(1, (1, "stale"))
    assert state() == want
    updates.compact(spark, path, schema, keys, 5)
    assert sorted(os.listdir(path)) == ["epoch=5"] and state() == want
    updates.patch_rows(spark.createDataFrame([(9, "patched"), (10, "new")], schema), path)
    updates.patch_rows(spark.createDataFrame([(10, "newer")], schema), path)
    assert state() == [(0, "v4"), (1, "v5"), (10, "newer"), (2, "v2"), (3, "v3"), (9, "patched")]
    put(6, (9, "n6"))
    assert (9, "n6") in state()


def test_a_stream_with_snapshots_keeps_few_folders(spark, tmp_path):
    parts = [[(f"e{n}", 1, "B", f"J{n % 3}", T0 + dt.timedelta(minutes=n), 1)] for n in range(9)]
    jobs = spark.createDataFrame([(1, "B", f"J{n}", 30, 0, "P") for n in range(3)], "domain_id int, batch_id string, id string, pick_qty int, picked_qty int, status string")
    stream, keys = st.stream_confirm_pick(_stream(spark, str(tmp_path), EVENT, parts), jobs, slots=4), ["domain_id", "batch_id", "id"]
    st.write_updates(stream, f"{tmp_path}/out", f"{tmp_path}/cp", keys=keys, compact_every=2).awaitTermination()
    assert rows(updates.last_state(spark, f"{tmp_path}/out", stream.schema, keys), "id", "picked_qty") == [("J0", 3), ("J1", 3), ("J2", 3)]
    assert len(os.listdir(f"{tmp_path}/out")) <= 5 and len([d for d in os.listdir(f"{tmp_path}/out_snapshot") if d.startswith("epoch")]) == 2


def _confirmed(spark, tmp_path, events, jobs):
    """The jobs after one micro-batch of ``events``, by one slot."""
    stream = _stream(spark, str(tmp_path), EVENT, [events])
    st.write_updates(st.stream_confirm_pick(stream, jobs, slots=1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    return rows(spark.read.parquet(f"{tmp_path}/out"), "id", "picked_qty", "status", "pick_started_at", "pick_ended_at")


def test_events_of_a_micro_batch_count_by_time_whatever_their_arrow_batches(spark, tmp_path):
    """A job that its first event fills, after five Arrow batches of later ones; and one that is never full."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        jobs = spark.createDataFrame([(1, "B", "A", 9, 0, "P"), (1, "B", "Z", 99, 0, "P")], "domain_id int, batch_id string, id string, pick_qty int, picked_qty int, status string")
        events = [(f"a{n}", 1, "B", "A", T0 + dt.timedelta(minutes=n), 9 if n == 0 else 1) for n in reversed(range(10))] + [("z", 1, "B", "Z", T0, 1)]
        got = _confirmed(spark, tmp_path, events, jobs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [("A", 9, "F", T0, T0), ("Z", 1, "P", T0, None)]


def test_the_state_function_holds_a_slot_as_one_table_and_takes_events_in_chunks(monkeypatch):
    """Equal to taking them one by one, with a missing end beside others and chunks of few events."""
    import pandas as pd

    class State:
        exists, value = False, None

        @property
        def get(self):
            return self.value

        def update(self, value):
            self.exists, self.value = True, value

        def remove(self):
            self.exists = False

        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

        def setTimeoutTimestamp(self, at):  # noqa: N802
            assert at > 0

    rng = random.Random(21)
    events = [(f"J{rng.randint(0, 30)}", n, rng.randint(1, 4)) for n in range(1, 400)]
    room = {f"J{i}": 5 + i for i in range(31)}
    want = {}
    for job, at, qty in events:
        j = want.setdefault(job, [0, at, None])
        if j[0] < room[job] <= j[0] + qty:
            j[2] = at
        j[0] = min(j[0] + qty, room[job])
    for size in (3, 4_000_000):
        monkeypatch.setattr(st, "CHUNK", size)
        confirm, state, got = st._slot_function("F", "P", 10**6), State(), {}
        for n in range(0, len(events), 50):
            part = pd.DataFrame(events[n : n + 50], columns=["job", "us", "qty"]).assign(domain_id=1, batch_id="B", had=0)
            part = part.assign(job_id=part["job"], room=part["job"].map(room), event_id="")
            for out in confirm((0,), iter([part[:20], part[:0], part[20:]]), state):
                got.update({r.id: [r.applied_qty, r.pick_started_at, r.pick_ended_at, r.status] for r in out.itertuples()})
        assert len(state.get) == 1 and isinstance(state.get[0], bytes)
        us = lambda t: None if pd.isna(t) else t.value // 1000
        assert {i: [a, us(s), us(e)] for i, (a, s, e, _) in got.items()} == want
        assert all((e is not pd.NaT) == (k == "F") for _, _, e, k in got.values())
