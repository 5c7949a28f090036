"""Comparison SQL per registered query, written in another form than the DataFrame code where there is one."""

from __future__ import annotations

from checks.fixtures import with_tables
from pickflow.schemas import CONFIG_KEYS, flag_name

COUNTED = {
    "lines": "wh_lines", "orders": "wh_orders", "received_orders": "wh_received_orders", "wms_if_orders": "wh_wms_if_orders",
    "jobs": "wh_jobs", "inputs": "wh_inputs", "cells": "wh_cells", "racks": "wh_racks", "stocks": "wh_stocks", "sku": "wh_sku",
    "indicators": "wh_indicators", "gateways": "wh_gateways", "batches": "wh_batches", "configs": "wh_configs",
    "box_types": "wh_box_types", "box_packs": "wh_box_packs", "pick_events": "wh_pick_events", "arrivals": "wh_arrivals",
    "preprocesses": "wh_preprocesses", "work_cells": "wh_work_cells",
}

SUMMARY = """
SELECT domain_id, wms_batch_no, wcs_batch_no, com_cd, area_cd, stage_cd, job_date, job_type, equip_type, equip_cd,
  count(DISTINCT order_no) AS total_orders, cast(sum(order_qty) AS bigint) AS total_pcs, count(*) AS total_records
FROM wh_wms_if_orders WHERE if_flag = 'N' GROUP BY ALL"""

CLASSIFIED = """
t_given AS (SELECT domain_id, batch_id FROM wh_received_orders GROUP BY ALL HAVING count(order_type) > 0),
t_kind AS (SELECT domain_id, batch_id, class_cd, CASE WHEN count(*) = 1 THEN 'OT' ELSE 'MT' END AS kind
  FROM (SELECT DISTINCT domain_id, batch_id, class_cd, com_cd, sku_cd FROM wh_received_orders) GROUP BY ALL),
t_classified AS (
  SELECT o.* REPLACE (CASE WHEN EXISTS (SELECT 1 FROM t_given g WHERE g.domain_id = o.domain_id AND g.batch_id = o.batch_id)
      THEN o.order_type ELSE k.kind END AS order_type, 'T' AS status)
  FROM wh_received_orders o JOIN t_kind k USING (domain_id, batch_id, class_cd))"""

TYPED = CLASSIFIED + """,
t_single AS (SELECT domain_id, batch_id, max(equip_cd) AS the_rack FROM wh_received_orders GROUP BY ALL HAVING count(DISTINCT equip_cd) = 1),
t_typed AS (SELECT c.* REPLACE (coalesce(c.equip_cd, s.the_rack) AS equip_cd) FROM t_classified c LEFT JOIN t_single s USING (domain_id, batch_id))"""

MOVED = TYPED + """,
t_moved AS (SELECT o.* REPLACE (CASE WHEN p.batch_id IS NOT NULL THEN coalesce(r.batch_id, o.batch_id) ELSE o.batch_id END AS batch_id,
    CASE WHEN p.batch_id IS NULL THEN o.status WHEN o.order_type = 'MT' THEN 'I' WHEN o.order_type = 'OT' THEN 'A' ELSE o.status END AS status,
    CASE WHEN p.batch_id IS NOT NULL AND o.order_type = 'OT' THEN 'R4' ELSE o.equip_cd END AS equip_cd)
  FROM t_typed o LEFT JOIN wh_merge_plan p USING (domain_id, batch_id) LEFT JOIN wh_racks r ON r.domain_id = o.domain_id AND r.rack_cd = o.equip_cd)"""

SCOPE = """
t_scope AS (SELECT * FROM wh_batches b WHERE EXISTS (SELECT 1 FROM wh_batches w
  WHERE w.domain_id = b.domain_id AND w.batch_group_id = b.batch_group_id AND w.status = 'WAIT'))"""

SPLIT = """
t_split AS (
  SELECT *, CASE WHEN rank_num = 1 THEN batch_id ELSE concat(batch_id, '-', cast(rank_num AS string)) END AS new_batch_id
  FROM (SELECT o.domain_id, o.batch_id, o.equip_type, o.equip_cd, r.rack_nm AS equip_nm, count(DISTINCT class_cd) AS batch_order_qty,
      cast(sum(order_qty) AS bigint) AS batch_pcs,
      cast(rank() OVER (PARTITION BY o.domain_id, o.batch_id ORDER BY o.equip_cd) AS int) AS rank_num
    FROM {orders} o JOIN wh_racks r ON r.domain_id = o.domain_id AND r.rack_cd = o.equip_cd
    GROUP BY o.domain_id, o.batch_id, o.equip_type, o.equip_cd, r.rack_nm))"""

SPLIT_MANY = SPLIT.format(orders="wh_received_orders") + """,
t_many AS (SELECT domain_id, batch_id FROM wh_received_orders GROUP BY ALL HAVING count(DISTINCT equip_cd) > 1),
t_parts AS (SELECT * FROM t_split SEMI JOIN t_many USING (domain_id, batch_id))"""

DEMAND = """
t_demand AS (SELECT domain_id, batch_id, equip_type, equip_cd, class_cd, com_cd, sku_cd, cast(sum(order_qty) AS bigint) AS order_qty, count(*) AS line_cnt
  FROM wh_orders WHERE status = 'W' {kind} GROUP BY ALL)"""

TOTAL = """
t_total AS (SELECT domain_id, equip_type, equip_cd, com_cd, sku_cd, cast(sum(load_qty) AS bigint) AS stock_qty
  FROM wh_stocks WHERE active_flag AND load_qty > 0 GROUP BY ALL)"""

USABLE = """
t_usable AS (SELECT s.*, c.ind_cd,
    cast(sum(s.load_qty) OVER (PARTITION BY s.domain_id, s.equip_type, s.equip_cd, s.com_cd, s.sku_cd ORDER BY s.load_qty, s.cell_cd, s.id ROWS UNBOUNDED PRECEDING) AS bigint) AS c_end
  FROM wh_stocks s JOIN wh_cells c USING (domain_id, equip_type, equip_cd, cell_cd)
  WHERE s.active_flag AND c.active_flag AND s.load_qty > 0)"""

ALLOCATED = DEMAND.format(kind="") + "," + USABLE + """,
t_one AS (SELECT *, count(*) OVER (PARTITION BY domain_id, batch_id, equip_type, equip_cd, class_cd) AS skus FROM t_demand),
t_cap AS (SELECT domain_id, equip_type, equip_cd, com_cd, sku_cd, sum(load_qty) AS cap FROM t_usable GROUP BY ALL),
t_laid AS (
  SELECT l.*, cast(sum(order_qty) OVER w AS bigint) AS l_end, cast(row_number() OVER w AS bigint) AS seq
  FROM t_one l SEMI JOIN t_cap c USING (domain_id, equip_type, equip_cd, com_cd, sku_cd) WHERE skus = 1
  WINDOW w AS (PARTITION BY domain_id, equip_type, equip_cd, com_cd, sku_cd ORDER BY order_qty, class_cd, batch_id ROWS UNBOUNDED PRECEDING)),
t_allocated AS (
  SELECT l.domain_id, l.batch_id, l.equip_type, l.equip_cd, l.class_cd AS order_no, l.com_cd, l.sku_cd, u.cell_cd, u.ind_cd, u.id AS stock_id,
    cast(least(l_end, c_end) - greatest(l_end - order_qty, c_end - load_qty) AS bigint) AS assign_qty, seq, cast(1 AS bigint) AS wave
  FROM t_laid l JOIN t_cap k USING (domain_id, equip_type, equip_cd, com_cd, sku_cd) JOIN t_usable u USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)
  WHERE l_end <= cap AND least(l_end, c_end) > greatest(l_end - order_qty, c_end - load_qty))"""

# The greedy, one order of every rack after the other: what is left of each SKU, and whether the order at hand is taken.
GREEDY = """
t_wanted AS (SELECT domain_id, equip_type, equip_cd, com_cd, sku_cd, sum(order_qty) AS pcs, sum(line_cnt) AS lines FROM t_demand GROUP BY ALL),
t_class AS (SELECT domain_id, equip_type, equip_cd, com_cd, sku_cd, stock_qty, CASE WHEN pcs <= stock_qty THEN 1 WHEN lines >= stock_qty THEN 2 ELSE 3 END AS cls
  FROM t_wanted JOIN t_total USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)),
t_turn AS (SELECT d.*, c.cls, c.stock_qty FROM t_demand d JOIN t_class c USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)
  QUALIFY row_number() OVER (PARTITION BY domain_id, equip_type, equip_cd, batch_id, class_cd ORDER BY cls, stock_qty DESC, sku_cd, com_cd, order_qty) = 1),
t_place AS (SELECT domain_id, equip_type, equip_cd, batch_id, class_cd,
    row_number() OVER (PARTITION BY domain_id, equip_type, equip_cd ORDER BY cls, stock_qty DESC, sku_cd, com_cd, order_qty, class_cd, batch_id) AS seq FROM t_turn),
t_cap AS (SELECT domain_id, equip_type, equip_cd, com_cd, sku_cd, sum(load_qty) AS cap FROM t_usable GROUP BY ALL),
t_item AS (SELECT w.domain_id, w.equip_type, w.equip_cd, w.com_cd, w.sku_cd, cast(coalesce(cap, 0) AS bigint) AS cap,
    row_number() OVER (PARTITION BY w.domain_id, w.equip_type, w.equip_cd ORDER BY w.com_cd, w.sku_cd) AS i
  FROM t_wanted w LEFT JOIN t_cap USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)),
t_need AS (SELECT domain_id, equip_type, equip_cd, seq, map(list(i), list(order_qty)) AS need
  FROM t_demand JOIN t_place USING (domain_id, equip_type, equip_cd, batch_id, class_cd) JOIN t_item USING (domain_id, equip_type, equip_cd, com_cd, sku_cd) GROUP BY ALL),
t_run AS (
  SELECT domain_id, equip_type, equip_cd, cast(0 AS bigint) AS seq, list(cap ORDER BY i) AS rest, false AS taken FROM t_item GROUP BY ALL
  UNION ALL
  SELECT r.domain_id, r.equip_type, r.equip_cd, n.seq,
    CASE WHEN list_min([rest[k] - need[k] for k in map_keys(need)]) >= 0 THEN [v - coalesce(need[k], 0) for v, k in rest] ELSE rest END,
    list_min([rest[k] - need[k] for k in map_keys(need)]) >= 0
  FROM t_run r JOIN t_need n ON n.domain_id = r.domain_id AND n.equip_type = r.equip_type AND n.equip_cd = r.equip_cd AND n.seq = r.seq + 1),
t_taken AS (SELECT d.*, seq, cast(sum(order_qty) OVER (PARTITION BY domain_id, equip_type, equip_cd, com_cd, sku_cd ORDER BY seq) AS bigint) AS l_end
  FROM t_demand d JOIN t_place USING (domain_id, equip_type, equip_cd, batch_id, class_cd) SEMI JOIN (SELECT * FROM t_run WHERE taken) r USING (domain_id, equip_type, equip_cd, seq)),
t_allocated AS (
  SELECT l.domain_id, l.batch_id, l.equip_type, l.equip_cd, l.class_cd AS order_no, l.com_cd, l.sku_cd, u.cell_cd, u.ind_cd, u.id AS stock_id,
    cast(least(l_end, c_end) - greatest(l_end - order_qty, c_end - load_qty) AS bigint) AS assign_qty, cast(seq AS bigint) AS seq, cast(1 AS bigint) AS wave
  FROM t_taken l JOIN t_usable u USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)
  WHERE least(l_end, c_end) > greatest(l_end - order_qty, c_end - load_qty))"""

GREEDY_WAITING = DEMAND.format(kind="AND order_type = 'MT'") + "," + TOTAL + "," + USABLE + "," + GREEDY

WAITING = """
t_waiting AS (SELECT domain_id, batch_id, box_type_cd, order_no, class_cd, count(DISTINCT sku_cd) AS sku_cnt, cast(sum(pick_qty) AS bigint) AS pick_cnt
  FROM wh_jobs WHERE order_type = 'MT' AND status = 'W' AND input_seq = 0 GROUP BY ALL)"""

MAPPED = WAITING + """,
t_free_orders AS (SELECT *, row_number() OVER (PARTITION BY domain_id, batch_id, box_type_cd ORDER BY sku_cnt, pick_cnt, order_no) AS rn
  FROM t_waiting w WHERE NOT EXISTS (SELECT 1 FROM wh_inputs i WHERE i.domain_id = w.domain_id AND i.batch_id = w.batch_id AND i.order_no = w.order_no)),
t_first AS (SELECT * FROM wh_arrivals
  QUALIFY row_number() OVER (PARTITION BY domain_id, box_id ORDER BY arrived_at, batch_id, box_type_cd, color_cd NULLS FIRST) = 1),
t_free_boxes AS (SELECT *, row_number() OVER (PARTITION BY domain_id, batch_id, box_type_cd ORDER BY arrived_at, box_id) AS rn
  FROM t_first a WHERE NOT EXISTS (SELECT 1 FROM wh_jobs j WHERE j.domain_id = a.domain_id AND j.box_id = a.box_id)),
t_mapped AS (SELECT b.domain_id, b.batch_id, b.box_id, b.box_type_cd, o.order_no, o.class_cd, b.arrived_at, coalesce(b.color_cd, 'R') AS color_cd
  FROM t_free_boxes b JOIN t_free_orders o USING (domain_id, batch_id, box_type_cd, rn))"""

NEW_ROWS = """
SELECT DISTINCT j.domain_id, j.batch_id, j.equip_type, j.equip_cd, c.station_cd, j.order_no, j.class_cd, j.com_cd
FROM wh_jobs j, wh_cells c
WHERE j.domain_id = c.domain_id AND j.equip_type = c.equip_type AND j.equip_cd = c.equip_cd AND j.sub_equip_cd = c.cell_cd AND c.active_flag"""

NEW_INPUTS = MAPPED + f""",
t_rows AS ({NEW_ROWS}),
t_new_inputs AS (
  SELECT r.*, m.box_id, m.box_type_cd AS box_type, m.color_cd,
    cast(coalesce((SELECT max(input_seq) FROM wh_inputs i WHERE i.domain_id = r.domain_id AND i.batch_id = r.batch_id), 0)
      + row_number() OVER (PARTITION BY r.domain_id, r.batch_id ORDER BY m.arrived_at, m.box_id, r.equip_cd, r.station_cd, r.com_cd, r.order_no) AS bigint) AS input_seq,
    'W' AS status
  FROM t_rows r JOIN t_mapped m ON m.domain_id = r.domain_id AND m.batch_id = r.batch_id AND m.class_cd = r.class_cd)"""

CONFIRMED = """
t_taken AS (SELECT e.*, j.pick_qty, sum(e.qty) OVER (PARTITION BY e.domain_id, e.batch_id, e.job_id ORDER BY e.ts, e.event_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM wh_pick_events e JOIN wh_jobs_at_start j ON j.domain_id = e.domain_id AND j.batch_id = e.batch_id AND j.id = e.job_id
  WHERE e.qty > 0 AND j.status = 'P' AND j.picked_qty < j.pick_qty),
t_confirmed AS (
  SELECT job_id AS id, domain_id, batch_id, cast(least(max(pick_qty), sum(qty)) AS int) AS picked_qty, 0 AS picking_qty,
    cast(least(max(pick_qty), sum(qty)) AS int) AS applied_qty,
    CASE WHEN sum(qty) >= max(pick_qty) THEN 'F' ELSE 'P' END AS status,
    min(ts) AS pick_started_at, min(CASE WHEN upto >= pick_qty THEN ts END) AS pick_ended_at
  FROM t_taken GROUP BY job_id, domain_id, batch_id)"""

PICKING_COLUMNS = """
SELECT j.domain_id, j.id, j.batch_id, j.stage_cd, j.com_cd, j.job_type, j.input_seq, j.equip_type, j.equip_cd, j.sub_equip_cd, c.ind_cd,
  coalesce(j.color_cd, 'R') AS color_cd, j.pick_qty, 0 AS picking_qty, j.picked_qty, cast(NULL AS int) AS box_in_qty, g.gw_nm AS gw_path,
  c.side_cd, c.station_cd, j.order_no, j.sku_cd, s.sku_barcd, s.sku_nm, j.status, j.box_id, j.box_type_cd, j.invoice_id, j.order_type,
  j.class_cd, j.box_class_cd, j.pick_started_at, j.pick_ended_at
FROM wh_jobs j
  JOIN wh_cells c ON j.domain_id = c.domain_id AND j.equip_type = c.equip_type AND j.equip_cd = c.equip_cd AND j.sub_equip_cd = c.cell_cd
  JOIN wh_sku s ON j.domain_id = s.domain_id AND j.com_cd = s.com_cd AND j.sku_cd = s.sku_cd
  LEFT JOIN wh_indicators i ON c.domain_id = i.domain_id AND c.ind_cd = i.ind_cd
  LEFT JOIN wh_gateways g ON i.domain_id = g.domain_id AND i.gw_cd = g.gw_cd
WHERE """

BOX_ITEMS = """
SELECT concat('BI-', o.id) AS id, o.domain_id, o.batch_id, concat('BP-', o.class_cd) AS box_pack_id, o.id AS order_id, o.order_no, o.order_line_no,
  o.com_cd, o.shop_cd, o.sku_cd, s.sku_nm, coalesce(s.sku_wt, 0) AS sku_wt, o.order_qty AS pick_qty, 0 AS picked_qty, 0 AS cancel_qty, 0 AS pass_flag, 'W' AS status
FROM wh_orders o LEFT JOIN wh_sku s ON s.domain_id = o.domain_id AND s.com_cd = o.com_cd AND s.sku_cd = o.sku_cd"""


def _progress(rows: str, keep_empty: bool) -> str:
    kinds = ("pcs", "sku", "order")
    counts = ", ".join(f"cast(coalesce({k}_{u}, 0) AS bigint) AS {k}_{u}" for u in kinds for k in ("plan", "actual"))
    rates = ", ".join(
        f"CASE WHEN coalesce(plan_{u}, 0) = 0 THEN 0.0 ELSE cast(actual_{u} AS double) / cast(plan_{u} AS double) * 100.0 END AS rate_{u}" for u in kinds
    )
    source = "(SELECT domain_id, id AS batch_id FROM wh_batches) b LEFT JOIN" if keep_empty else ""
    using = "USING (domain_id, batch_id)"
    return f"""t_rows AS ({rows}),
t_pcs AS (SELECT domain_id, batch_id, sum(pick_qty) AS plan_pcs, sum(picked_qty) AS actual_pcs FROM t_rows GROUP BY ALL),
t_sku AS (SELECT domain_id, batch_id, count(*) AS plan_sku, sum(done) AS actual_sku FROM (
  SELECT domain_id, batch_id, com_cd, sku_cd, CASE WHEN sum(pick_qty) = sum(picked_qty) THEN 1 ELSE 0 END AS done FROM t_rows GROUP BY ALL) GROUP BY ALL),
t_order AS (SELECT domain_id, batch_id, count(*) AS plan_order, sum(done) AS actual_order FROM (
  SELECT domain_id, batch_id, class_cd, CASE WHEN sum(pick_qty) = sum(picked_qty) THEN 1 ELSE 0 END AS done FROM t_rows GROUP BY ALL) GROUP BY ALL),
t_progress AS (SELECT domain_id, batch_id, {counts}, {rates} FROM {source} t_pcs {using if keep_empty else ''} LEFT JOIN t_sku {using} LEFT JOIN t_order {using})"""


JOB_ROWS = "SELECT domain_id, batch_id, class_cd, com_cd, sku_cd, pick_qty, picked_qty FROM wh_jobs WHERE status NOT IN ('C', 'D')"
ORDER_ROWS = """SELECT o.*, coalesce((SELECT sum(picked_qty) FROM wh_jobs j WHERE j.domain_id = o.domain_id AND j.batch_id = o.batch_id AND j.class_cd = o.class_cd
    AND j.com_cd = o.com_cd AND j.sku_cd = o.sku_cd AND j.status NOT IN ('C', 'D')), 0) AS picked_qty
  FROM (SELECT domain_id, batch_id, class_cd, com_cd, sku_cd, sum(order_qty) AS pick_qty FROM wh_orders GROUP BY ALL) o"""

RESULT = """
t_packs AS (SELECT domain_id, batch_id, count(DISTINCT cust_order_no) AS orders_out, count(DISTINCT class_cd) AS boxes_out FROM wh_box_packs WHERE status NOT IN ('A', 'W') GROUP BY ALL),
t_plan AS (SELECT domain_id, batch_id, count(DISTINCT class_cd) AS plan_order, cast(sum(picked_qty) AS bigint) AS actual_pcs,
    round(epoch(max(updated_at) - min(updated_at)) / 3600) AS hours, round(epoch(max(updated_at) - min(updated_at)) / 60) AS minutes
  FROM wh_orders GROUP BY ALL),
t_result AS (SELECT domain_id, batch_id, plan_order, coalesce(orders_out, 0) AS actual_order, coalesce(boxes_out, 0) AS actual_sku, actual_pcs,
    round(coalesce(boxes_out, 0) * cast(100.0 AS double) / plan_order, 1) AS rate_order,
    CASE WHEN hours > 0 THEN round(actual_pcs / hours, 1) ELSE 0.0 END AS uph, minutes AS rate_sku
  FROM t_plan LEFT JOIN t_packs USING (domain_id, batch_id))"""

CLOSE = """
t_close AS (SELECT b.domain_id, b.id AS batch_id, b.status,
    (SELECT count(*) FROM wh_orders o WHERE o.domain_id = b.domain_id AND o.batch_id = b.id) AS order_cnt,
    (SELECT count(*) FROM wh_jobs j WHERE j.domain_id = b.domain_id AND j.batch_id = b.id) AS job_cnt,
    (SELECT count(*) FROM wh_jobs j WHERE j.domain_id = b.domain_id AND j.batch_id = b.id AND j.status IN ('W', 'I', 'P', 'C')) AS open_cnt
  FROM wh_batches b),
t_closed AS (SELECT domain_id, batch_id FROM t_close WHERE status = 'RUN' AND order_cnt > 0 AND job_cnt > 0)"""

REQUESTS = """
t_check AS (SELECT q.domain_id, q.batch_id, b.equip_type, b.equip_cd, q.to_equip_cd,
    CASE WHEN b.equip_cd = q.to_equip_cd THEN 'SAME_RACK' WHEN b.status NOT IN ('WAIT', 'READY') THEN 'STARTED'
      WHEN (SELECT count(*) FROM wh_cells c WHERE c.domain_id = b.domain_id AND c.equip_type = b.equip_type AND c.equip_cd = b.equip_cd AND c.active_flag)
        <> (SELECT count(*) FROM wh_cells c WHERE c.domain_id = b.domain_id AND c.equip_type = b.equip_type AND c.equip_cd = q.to_equip_cd AND c.active_flag)
      THEN 'CELL_COUNT' ELSE 'OK' END AS reason
  FROM wh_rack_requests q JOIN wh_batches b ON b.domain_id = q.domain_id AND b.id = q.batch_id)"""

CANCELLED = """
t_cancelled AS (SELECT b.*, NOT EXISTS (SELECT 1 FROM wh_jobs j WHERE j.domain_id = b.domain_id AND j.batch_id = b.id AND j.picked_qty > 0) AS allowed,
    (SELECT count(*) FROM wh_batches p WHERE p.domain_id = b.domain_id AND p.batch_group_id = b.batch_group_id AND p.status <> 'MERGED') AS peers
  FROM wh_batches b)"""


def _input_list(where: str) -> str:
    return f"""
SELECT domain_id, batch_id, equip_type, equip_cd, order_no, box_id, box_type_cd AS box_type, min(input_seq) AS input_seq,
  count(DISTINCT (com_cd, sku_cd)) AS sku_qty, cast(sum(pick_qty) AS bigint) AS plan_qty, cast(coalesce(sum(picked_qty), 0) AS bigint) AS result_qty,
  max(color_cd) AS color_cd, CASE WHEN sum(pick_qty) = coalesce(sum(picked_qty), 0) THEN '1' ELSE '0' END AS status
FROM wh_jobs WHERE order_type = 'MT' AND {where}
GROUP BY domain_id, batch_id, equip_type, equip_cd, order_no, box_id, box_type_cd"""


def _tab(selected: bool) -> str:
    first = (
        "CASE WHEN id = (SELECT min(m.id) FROM wh_inputs m WHERE m.domain_id = s.domain_id AND m.batch_id = s.batch_id AND m.equip_type = s.equip_type"
        " AND m.equip_cd = s.equip_cd AND m.station_cd = s.station_cd) THEN 1 ELSE prio END"
        if selected
        else "prio"
    )
    return f"""
WITH t_prio AS (SELECT *, CASE WHEN status = 'R' THEN 2 WHEN status IN ('F', 'E') THEN 3 WHEN status = 'W' THEN 4 END AS prio FROM wh_inputs),
t_ranked AS (SELECT *, {first} AS rank_no FROM t_prio s),
t_base AS (SELECT domain_id, batch_id, equip_type, equip_cd, station_cd, id AS base_id, input_seq AS base_seq, order_no AS base_order, box_id AS base_box,
    CASE WHEN rank_no = 1 THEN id END AS selected_id
  FROM t_ranked WHERE rank_no IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY domain_id, batch_id, equip_type, equip_cd, station_cd
    ORDER BY rank_no, CASE WHEN rank_no = 4 THEN input_seq ELSE -input_seq END) = 1),
t_group AS (SELECT domain_id, batch_id, equip_type, order_no, box_id, min(input_seq) AS seq FROM wh_inputs GROUP BY ALL),
t_near AS (
  SELECT b.*, 2 AS screen_pos, b.base_order AS order_no, b.base_box AS box_id FROM t_base b
  UNION ALL
  SELECT b.*, 1, g.order_no, g.box_id FROM t_base b JOIN t_group g USING (domain_id, batch_id, equip_type)
  WHERE g.seq < b.base_seq AND NOT (g.order_no = b.base_order AND g.box_id = b.base_box)
  QUALIFY row_number() OVER (PARTITION BY b.domain_id, b.batch_id, b.equip_type, b.equip_cd, b.station_cd ORDER BY g.seq DESC, g.order_no DESC, g.box_id DESC) <= 1
  UNION ALL
  SELECT b.*, 3, g.order_no, g.box_id FROM t_base b JOIN t_group g USING (domain_id, batch_id, equip_type)
  WHERE g.seq > b.base_seq AND NOT (g.order_no = b.base_order AND g.box_id = b.base_box)
  QUALIFY row_number() OVER (PARTITION BY b.domain_id, b.batch_id, b.equip_type, b.equip_cd, b.station_cd ORDER BY g.seq, g.order_no, g.box_id) <= 2),
t_whole AS (SELECT domain_id, batch_id, equip_type, order_no, box_id, color_cd, min(id) AS any_id, max(input_seq) AS last_seq, count(*) FILTER (status NOT IN ('F', 'U', 'E')) AS open_cnt
  FROM wh_inputs GROUP BY ALL),
t_here AS (SELECT domain_id, batch_id, equip_type, order_no, box_id, color_cd, station_cd, max(id) AS my_id, max(input_seq) AS my_seq, max(status) AS my_status, count(*) AS input_cnt,
    count(*) FILTER (status IN ('W', 'R')) AS open_cnt
  FROM wh_inputs GROUP BY ALL),
t_boxes AS (
  SELECT n.domain_id, n.batch_id, n.equip_type, n.equip_cd, n.station_cd, n.screen_pos, n.selected_id, n.order_no, n.box_id, w.color_cd, h.my_id, w.any_id,
    coalesce(h.input_cnt, 0) AS has_my_jobs, coalesce(h.my_seq, 0) AS my_seq, w.last_seq, CASE WHEN w.open_cnt = 1 AND h.open_cnt = 1 THEN 1 ELSE 0 END AS is_last, h.my_status
  FROM t_near n JOIN t_whole w USING (domain_id, batch_id, equip_type, order_no, box_id)
  LEFT JOIN t_here h ON h.domain_id = n.domain_id AND h.batch_id = n.batch_id AND h.equip_type = n.equip_type AND h.order_no = n.order_no AND h.box_id = n.box_id
    AND h.color_cd IS NOT DISTINCT FROM w.color_cd AND h.station_cd = n.station_cd),
t_zone AS (SELECT j.domain_id, j.batch_id, j.equip_type, j.equip_cd, c.station_cd, j.order_no, sum(j.pick_qty) AS plan, sum(j.picked_qty) AS picked
  FROM wh_jobs j JOIN wh_cells c ON c.domain_id = j.domain_id AND c.equip_type = j.equip_type AND c.equip_cd = j.equip_cd AND c.cell_cd = j.sub_equip_cd GROUP BY ALL)
SELECT domain_id, batch_id, equip_type, equip_cd, station_cd, screen_pos, order_no, box_id, color_cd, coalesce(my_id, any_id) AS id, has_my_jobs,
  is_last AS is_my_zone_is_last, CASE WHEN my_seq = 0 THEN last_seq ELSE my_seq END AS input_seq,
  CASE WHEN coalesce(plan, 0) = 0 THEN 0.0 ELSE cast(picked AS double) / cast(plan AS double) * 100.0 END AS my_zone_progress_rate,
  my_status AS status, CASE WHEN my_id = selected_id THEN 1 ELSE 0 END AS is_selected_item
FROM t_boxes LEFT JOIN t_zone USING (domain_id, batch_id, equip_type, equip_cd, station_cd, order_no)
{'WHERE has_my_jobs > 0' if selected else ''}"""


BODIES = {
    "load_tables": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_cnt FROM {v}" for n, v in COUNTED.items()),
    "receive_summary": f"SELECT *, 'order' AS item_type, 'W' AS status, 0 AS skip_flag FROM ({SUMMARY})",
    "receive_orders": """
SELECT w.domain_id, concat('RB-', w.wms_batch_no) AS batch_id, '1' AS job_seq, w.wms_batch_no, w.wcs_batch_no, w.job_date, w.job_type, w.order_no, w.order_line_no,
  w.com_cd, w.area_cd, w.stage_cd, w.equip_type, w.equip_cd, w.shop_cd, w.sku_cd, w.box_type_cd, w.order_qty, w.order_no AS class_cd, 0 AS picked_qty, 'W' AS status
FROM wh_wms_if_orders w
WHERE w.if_flag = 'N' AND w.com_cd <> 'COM3' AND NOT EXISTS (SELECT 1 FROM wh_orders o WHERE o.status = 'F' AND o.domain_id = w.domain_id
  AND o.order_no = w.order_no AND o.order_line_no = w.order_line_no AND o.com_cd = w.com_cd AND o.sku_cd = w.sku_cd)""",
    "receive_batch_orders": """
SELECT sha256(concat_ws('|', w.domain_id, concat('RB-', w.wms_batch_no), w.order_no, w.order_line_no, w.com_cd, w.sku_cd)) AS id, w.domain_id, concat('RB-', w.wms_batch_no) AS batch_id,
  w.order_no, w.order_line_no, w.com_cd, w.sku_cd, w.order_qty, w.order_no AS class_cd, 'W' AS status
FROM wh_wms_if_orders w
WHERE w.if_flag = 'N' AND w.com_cd <> 'COM3' AND w.wms_batch_no <> 'WB1-199601' AND NOT EXISTS (SELECT 1 FROM wh_orders o WHERE o.status = 'F' AND o.domain_id = w.domain_id
  AND o.order_no = w.order_no AND o.order_line_no = w.order_line_no AND o.com_cd = w.com_cd AND o.sku_cd = w.sku_cd)""",
    "receive_batch_batches": f"""
SELECT domain_id, concat('RB-', wms_batch_no) AS id, concat('RB-', wms_batch_no) AS batch_group_id, min(com_cd) AS com_cd, 'DPS' AS job_type, 'READY' AS status
FROM ({SUMMARY}) WHERE com_cd <> 'COM3' AND wms_batch_no <> 'WB1-199601' GROUP BY ALL""",
    "receive_batch_items": f"""
SELECT domain_id, concat('RB-', wms_batch_no) AS batch_id, com_cd, equip_cd, total_records,
  CASE WHEN com_cd = 'COM3' THEN 'S' WHEN wms_batch_no = 'WB1-199601' THEN 'E' ELSE 'F' END AS status FROM ({SUMMARY})""",
    "receipt_items": f"""
SELECT domain_id, concat('RB-', wms_batch_no) AS batch_id, com_cd, equip_cd, total_records, CASE WHEN com_cd = 'COM3' THEN 'S' ELSE 'F' END AS status,
  CASE WHEN com_cd = 'COM3' THEN 1 ELSE 0 END AS skip_flag FROM ({SUMMARY})""",
    "cancel_receipt_keep": """
SELECT o.id, o.domain_id, o.batch_id, CASE WHEN b.status IN ('WAIT', 'READY') THEN '0' ELSE o.job_seq END AS job_seq,
  CASE WHEN b.status IN ('WAIT', 'READY') THEN 'C' ELSE o.status END AS status
FROM wh_received_orders o LEFT JOIN wh_batches b ON b.domain_id = o.domain_id AND b.id = o.batch_id""",
    "cancel_receipt_delete": """
SELECT id, domain_id, batch_id, job_seq, status FROM wh_received_orders o
WHERE (domain_id, batch_id) NOT IN (SELECT (domain_id, id) FROM wh_batches WHERE status IN ('WAIT', 'READY'))""",
    "cancel_receipt_batches": "SELECT domain_id, id, CASE WHEN status IN ('WAIT', 'READY') THEN 'CANCEL' ELSE status END AS status FROM wh_batches",
    "cancel_receipt_preprocesses": "SELECT * FROM wh_preprocesses WHERE (domain_id, batch_id) NOT IN (SELECT (domain_id, id) FROM wh_batches WHERE status IN ('WAIT', 'READY'))",
    "rowset_page": f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, batch_id ORDER BY input_seq DESC, order_no, box_id) AS rn
  FROM ({_input_list("status NOT IN ('BW', 'W') AND input_seq >= 1")})) WHERE rn BETWEEN 21 AND 40""",
    "batch_summary_inputs": f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY domain_id, batch_id ORDER BY input_seq DESC, order_no, box_id) AS rn
  FROM ({_input_list("status NOT IN ('BW', 'W') AND input_seq >= 1")})) WHERE rn <= 10""",
    "apply_class_codes": "SELECT id, domain_id, batch_id, order_no AS class_cd, shop_cd AS box_class_cd FROM wh_received_orders",
    "apply_class_codes_configured": """
SELECT id, domain_id, batch_id, CASE WHEN domain_id = 1 THEN order_no ELSE cust_order_no END AS class_cd,
  CASE WHEN domain_id = 2 THEN shop_cd ELSE box_class_cd END AS box_class_cd FROM wh_received_orders""",
    "classify_orders": f"WITH {CLASSIFIED} SELECT id, domain_id, batch_id, class_cd, order_type, status FROM t_classified",
    "classify_orders_no_single": f"""
WITH {CLASSIFIED} SELECT id, domain_id, batch_id, class_cd,
  CASE WHEN EXISTS (SELECT 1 FROM t_given g WHERE g.domain_id = c.domain_id AND g.batch_id = c.batch_id) THEN order_type ELSE 'MT' END AS order_type, status FROM t_classified c""",
    "classify_orders_line_count": f"""
WITH {CLASSIFIED},
t_repeated AS (SELECT DISTINCT domain_id, batch_id, class_cd FROM (
  SELECT domain_id, batch_id, class_cd FROM wh_received_orders GROUP BY domain_id, batch_id, class_cd, com_cd, sku_cd HAVING count(*) > 1)),
t_marked AS (SELECT o.*, (o.domain_id, o.batch_id) IN (SELECT (domain_id, batch_id) FROM t_given) AS given,
    (o.domain_id, o.batch_id, o.class_cd) IN (SELECT (domain_id, batch_id, class_cd) FROM t_repeated) AS repeated FROM wh_received_orders o)
SELECT id, domain_id, batch_id, class_cd, CASE WHEN repeated AND NOT given THEN 'MT' ELSE order_type END AS order_type,
  CASE WHEN given OR repeated THEN 'T' ELSE status END AS status FROM t_marked""",
    "classify_counts": f"""
WITH {CLASSIFIED} SELECT domain_id, batch_id, count(DISTINCT CASE WHEN order_type = 'MT' THEN class_cd END) AS mt_count,
  count(DISTINCT CASE WHEN order_type = 'OT' THEN class_cd END) AS ot_count FROM t_classified GROUP BY ALL""",
    "racks_for_batch": """
SELECT DISTINCT o.domain_id, o.batch_id, r.rack_cd, r.rack_nm,
  (SELECT count(DISTINCT x.equip_cd) FROM wh_received_orders x WHERE x.domain_id = o.domain_id AND x.batch_id = o.batch_id) > 1 AS is_splittable
FROM wh_received_orders o JOIN wh_racks r ON r.domain_id = o.domain_id AND r.rack_cd = o.equip_cd""",
    "assign_single_rack": f"""
WITH {TYPED} SELECT o.id, o.domain_id, o.batch_id, coalesce(o.equip_cd, s.the_rack) AS equip_cd, CASE WHEN o.equip_cd IS NULL THEN r.rack_nm END AS equip_nm
FROM wh_received_orders o LEFT JOIN t_single s USING (domain_id, batch_id) LEFT JOIN wh_racks r ON r.domain_id = o.domain_id AND r.rack_cd = s.the_rack""",
    "split_batch_by_rack": f"WITH {SPLIT.format(orders='wh_orders')} SELECT * FROM t_split",
    "split_batch_orders": f"""
WITH {SPLIT_MANY} SELECT o.id, o.domain_id, coalesce(p.new_batch_id, o.batch_id) AS batch_id, o.equip_cd, p.equip_nm
FROM wh_received_orders o LEFT JOIN t_parts p USING (domain_id, batch_id, equip_cd)""",
    "split_batch_batches": f"""
WITH {SPLIT_MANY}
SELECT b.domain_id, p.new_batch_id AS id, b.batch_group_id, p.equip_cd, p.batch_order_qty, p.batch_pcs, b.status
FROM wh_batches b JOIN t_parts p ON p.domain_id = b.domain_id AND p.batch_id = b.id
UNION ALL
SELECT b.domain_id, b.id, b.batch_group_id, b.equip_cd, NULL, NULL, b.status FROM wh_batches b WHERE (b.domain_id, b.id) NOT IN (SELECT (domain_id, batch_id) FROM t_many)""",
    "instruct_orders": f"""
WITH {TYPED},{SCOPE} SELECT o.id, o.domain_id, o.batch_id, CASE WHEN s.id IS NOT NULL THEN 'W' ELSE o.status END AS status, coalesce(s.equip_cd, o.equip_cd) AS equip_cd
FROM t_typed o LEFT JOIN t_scope s ON s.domain_id = o.domain_id AND s.id = o.batch_id""",
    "instruct_orders_procedure": f"""
WITH {TYPED},{SCOPE} SELECT o.id, o.domain_id, o.batch_id,
  CASE WHEN s.id IS NULL THEN o.status WHEN o.order_type = 'OT' THEN 'A' WHEN o.order_type = 'MT' THEN 'I' ELSE o.status END AS status,
  CASE WHEN s.id IS NOT NULL AND o.order_type = 'OT' THEN 'R4' ELSE o.equip_cd END AS equip_cd
FROM t_typed o LEFT JOIN t_scope s ON s.domain_id = o.domain_id AND s.id = o.batch_id""",
    "create_single_pack_jobs": f"""
WITH {CLASSIFIED} SELECT sha256(concat_ws('|', o.domain_id, o.batch_id, o.class_cd, o.com_cd, o.sku_cd, coalesce(o.box_type_cd, ''), coalesce(o.equip_cd, 'R4'))) AS id,
  o.domain_id, o.batch_id, o.job_date, o.job_seq, o.job_type, o.stage_cd, o.equip_type, coalesce(o.equip_cd, 'R4') AS equip_cd, 'Rack 4' AS equip_nm, o.class_cd, o.class_cd AS order_no,
  o.com_cd, o.com_cd AS shop_cd, o.sku_cd, max(s.sku_nm) AS sku_nm, o.box_type_cd, cast(sum(o.order_qty) AS int) AS pick_qty, o.order_type, 'W' AS status, cast(0 AS bigint) AS input_seq
FROM t_classified o LEFT JOIN wh_sku s ON s.domain_id = o.domain_id AND s.com_cd = o.com_cd AND s.sku_cd = o.sku_cd
WHERE o.order_type = 'OT'
GROUP BY o.domain_id, o.batch_id, o.job_date, o.job_seq, o.job_type, o.stage_cd, o.equip_type, o.equip_cd, o.class_cd, o.com_cd, o.sku_cd, o.box_type_cd, o.order_type""",
    "batch_counts": """
SELECT b.domain_id, b.id AS batch_id, count(DISTINCT o.class_cd) AS batch_order_qty, count(DISTINCT o.sku_cd) AS batch_sku_qty,
  cast(sum(o.order_qty) AS bigint) AS batch_pcs, coalesce(max(b.instructed_at), timestamp '2020-01-01') AS instructed_at
FROM wh_batches b LEFT JOIN wh_orders o ON o.domain_id = b.domain_id AND o.batch_id = b.id GROUP BY b.domain_id, b.id""",
    "mark_racks": """
SELECT r.domain_id, r.rack_cd, 'RUN' AS status, coalesce((SELECT b.id FROM wh_batches b WHERE b.domain_id = r.domain_id
    AND EXISTS (SELECT 1 FROM wh_orders o WHERE o.domain_id = b.domain_id AND o.batch_id = b.id AND o.equip_cd = r.rack_cd)
    ORDER BY b.job_date DESC, b.id DESC LIMIT 1), r.batch_id) AS batch_id
FROM wh_racks r""",
    "merge_batch": f"""
WITH {TYPED},
t_spread AS (SELECT domain_id, batch_id FROM t_typed GROUP BY ALL HAVING count(DISTINCT equip_cd) > 1),
t_plan AS (SELECT p.*, b.equip_cd AS main_equip FROM wh_merge_plan p JOIN wh_batches b ON b.domain_id = p.domain_id AND b.id = p.main_batch_id
  WHERE (p.domain_id, p.batch_id) NOT IN (SELECT (domain_id, batch_id) FROM t_spread))
SELECT o.id, o.domain_id, o.batch_id, coalesce(p.main_batch_id, o.batch_id) AS new_batch_id, CASE WHEN p.main_batch_id IS NOT NULL THEN 'W' ELSE o.status END AS status,
  coalesce(p.main_equip, o.equip_cd) AS equip_cd
FROM t_typed o LEFT JOIN t_plan p USING (domain_id, batch_id)""",
    "merge_batch_batches": f"""
WITH {TYPED},
t_spread AS (SELECT domain_id, batch_id FROM t_typed GROUP BY ALL HAVING count(DISTINCT equip_cd) > 1),
t_plan AS (SELECT * FROM wh_merge_plan WHERE (domain_id, batch_id) NOT IN (SELECT (domain_id, batch_id) FROM t_spread))
SELECT b.domain_id, b.id, coalesce(m.batch_group_id, b.batch_group_id) AS batch_group_id, CASE WHEN p.batch_id IS NOT NULL THEN 'MERGED' ELSE b.status END AS status
FROM wh_batches b LEFT JOIN t_plan p ON p.domain_id = b.domain_id AND p.batch_id = b.id LEFT JOIN wh_batches m ON m.domain_id = p.domain_id AND m.id = p.main_batch_id""",
    "merge_batch_rejected": f"""
WITH {TYPED} SELECT * FROM wh_merge_plan p WHERE (SELECT count(DISTINCT equip_cd) FROM t_typed o WHERE o.domain_id = p.domain_id AND o.batch_id = p.batch_id) > 1""",
    "merge_batch_by_rack": f"""
WITH {TYPED} SELECT o.id, o.domain_id, o.batch_id, CASE WHEN p.batch_id IS NOT NULL THEN coalesce(r.batch_id, o.batch_id) ELSE o.batch_id END AS new_batch_id,
  CASE WHEN p.batch_id IS NOT NULL AND o.order_type = 'MT' THEN 'I' ELSE o.status END AS status
FROM t_typed o LEFT JOIN wh_merge_plan p USING (domain_id, batch_id) LEFT JOIN wh_racks r ON r.domain_id = o.domain_id AND r.rack_cd = o.equip_cd""",
    "merge_with_jobs_orders": f"WITH {MOVED} SELECT id, domain_id, batch_id, status, equip_cd FROM t_moved",
    "merge_with_jobs_jobs": f"""
WITH {MOVED} SELECT domain_id, batch_id, class_cd, com_cd, sku_cd, box_type_cd, 'R4' AS equip_cd, cast(sum(order_qty) AS int) AS pick_qty, 'W' AS status
FROM t_moved WHERE status = 'A' GROUP BY ALL""",
    "merge_with_jobs_counts": f"""
WITH {MOVED} SELECT b.domain_id, b.id AS batch_id, count(DISTINCT o.class_cd) AS batch_order_qty, count(DISTINCT o.sku_cd) AS batch_sku_qty, cast(sum(o.order_qty) AS bigint) AS batch_pcs
FROM wh_batches b LEFT JOIN t_moved o ON o.domain_id = b.domain_id AND o.batch_id = b.id GROUP BY b.domain_id, b.id""",
    "cancel_instruction": f"""
WITH {CANCELLED} SELECT o.id, o.domain_id, o.batch_id, CASE WHEN c.allowed AND o.status = 'W' THEN 'T' ELSE o.status END AS status,
  CASE WHEN c.allowed AND c.peers <= 1 THEN NULL ELSE o.equip_cd END AS equip_cd
FROM wh_orders o JOIN t_cancelled c ON c.domain_id = o.domain_id AND c.id = o.batch_id""",
    "cancel_instruction_batches": f"""
WITH {CANCELLED} SELECT domain_id, id, allowed, CASE WHEN allowed THEN 'READY' ELSE status END AS status, CASE WHEN allowed AND peers <= 1 THEN NULL ELSE equip_cd END AS equip_cd FROM t_cancelled""",
    "cancel_instruction_jobs": f"WITH {CANCELLED} SELECT j.id, j.domain_id, j.batch_id, j.status FROM wh_jobs j JOIN t_cancelled c ON c.domain_id = j.domain_id AND c.id = j.batch_id WHERE NOT c.allowed",
    "config_flags": "SELECT b.domain_id, b.id AS batch_id, "
    + ", ".join(
        f"cast((SELECT c.value FROM wh_configs c WHERE c.domain_id = b.domain_id AND c.job_config_set_id = b.job_config_set_id AND c.name = '{k}') AS {t}) AS {flag_name(k)}"
        for k, t in CONFIG_KEYS.items()
    )
    + " FROM wh_batches b",
    "running_batches": "SELECT domain_id, id, job_date, equip_cd, status FROM wh_batches WHERE status = 'RUN' AND job_type = 'DPS'",
    "stock_priority": f"""
WITH {DEMAND.format(kind="AND order_type = 'MT'")},{TOTAL}
SELECT *, CASE WHEN order_qty <= load_qty THEN 1 WHEN order_sku_cnt >= load_qty THEN 2 ELSE 3 END AS assign_priority
FROM (SELECT domain_id, batch_id, equip_type, equip_cd, com_cd, sku_cd, cast(sum(line_cnt) AS bigint) AS order_sku_cnt, cast(sum(order_qty) AS bigint) AS order_qty FROM t_demand GROUP BY ALL)
JOIN (SELECT * RENAME (stock_qty AS load_qty) FROM t_total) USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)""",
    "stock_total": f"WITH {TOTAL} SELECT * FROM t_total",
    "orders_for_stock": f"""
WITH {DEMAND.format(kind="AND order_type = 'MT'")},{TOTAL} SELECT domain_id, batch_id, equip_type, equip_cd, class_cd AS order_no, com_cd, sku_cd, order_qty, stock_qty
FROM t_demand JOIN t_total USING (domain_id, equip_type, equip_cd, com_cd, sku_cd) WHERE order_qty <= stock_qty""",
    "assign_candidates": f"""
WITH {DEMAND.format(kind="")},{USABLE},
t_sum AS (SELECT domain_id, equip_type, equip_cd, com_cd, sku_cd, max(c_end) AS loaded FROM t_usable GROUP BY ALL),
t_judged AS (SELECT d.*, coalesce(s.loaded, 0) < d.order_qty AS is_short FROM t_demand d LEFT JOIN t_sum s USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)),
t_shorts AS (SELECT *, count(*) FILTER (is_short) OVER (PARTITION BY domain_id, batch_id, equip_type, equip_cd, class_cd) AS shorts FROM t_judged)
SELECT d.domain_id, d.batch_id, d.equip_type, d.equip_cd, d.class_cd AS order_no, d.com_cd, d.sku_cd, d.order_qty, u.cell_cd, u.ind_cd, u.id AS stock_id, u.load_qty,
  u.c_end AS load_sum_by_cell, cast(d.shorts AS bigint) AS check_assignable,
  cast(row_number() OVER (PARTITION BY d.domain_id, d.batch_id, d.equip_type, d.equip_cd, d.class_cd, d.com_cd, d.sku_cd ORDER BY u.c_end) AS int) AS ranking
FROM t_shorts d JOIN t_usable u USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)
WHERE NOT d.is_short AND u.c_end - u.load_qty < d.order_qty""",
    "allocate_lines": f"WITH {ALLOCATED} SELECT * FROM t_allocated",
    "create_jobs": f"""
WITH {ALLOCATED} SELECT a.domain_id, a.batch_id, a.equip_type, a.equip_cd, a.cell_cd AS sub_equip_cd, a.ind_cd, max(o.order_no) AS order_no, a.order_no AS class_cd, a.com_cd, a.sku_cd,
  max(o.job_type) AS job_type, max(o.job_date) AS job_date, max(o.job_seq) AS job_seq, max(o.stage_cd) AS stage_cd, max(o.cust_order_no) AS cust_order_no,
  max(o.box_class_cd) AS box_class_cd, max(o.shop_cd) AS shop_cd, max(o.box_type_cd) AS box_type_cd, max(o.order_type) AS order_type,
  cast(a.assign_qty AS int) AS pick_qty, 0 AS picking_qty, 0 AS picked_qty, cast(0 AS bigint) AS input_seq, CASE WHEN a.domain_id = 1 THEN 'BW' ELSE 'W' END AS status
FROM t_allocated a JOIN wh_orders o ON o.domain_id = a.domain_id AND o.batch_id = a.batch_id AND o.class_cd = a.order_no AND o.com_cd = a.com_cd AND o.sku_cd = a.sku_cd
GROUP BY a.domain_id, a.batch_id, a.equip_type, a.equip_cd, a.cell_cd, a.ind_cd, a.order_no, a.com_cd, a.sku_cd, a.stock_id, a.assign_qty""",
    "stock_after": f"""
WITH {ALLOCATED} SELECT s.id, s.domain_id, cast(s.load_qty - coalesce(sum(a.assign_qty), 0) AS int) AS load_qty, cast(s.alloc_qty + coalesce(sum(a.assign_qty), 0) AS int) AS alloc_qty
FROM wh_stocks s LEFT JOIN t_allocated a ON a.domain_id = s.domain_id AND a.stock_id = s.id GROUP BY s.id, s.domain_id, s.load_qty, s.alloc_qty""",
    "orders_after": f"""
WITH {ALLOCATED} SELECT id, domain_id, batch_id, CASE WHEN status = 'W' AND (domain_id, batch_id, class_cd, com_cd, sku_cd) IN (SELECT (domain_id, batch_id, order_no, com_cd, sku_cd) FROM t_allocated)
  THEN 'A' ELSE status END AS status FROM wh_orders""",
    "allocate": f"WITH RECURSIVE {GREEDY_WAITING} SELECT * FROM t_allocated",
    "allocate_stock_after": f"""
WITH RECURSIVE {GREEDY_WAITING} SELECT s.id, s.domain_id, cast(s.load_qty - coalesce(sum(a.assign_qty), 0) AS int) AS load_qty, cast(s.alloc_qty + coalesce(sum(a.assign_qty), 0) AS int) AS alloc_qty
FROM wh_stocks s LEFT JOIN t_allocated a ON a.domain_id = s.domain_id AND a.stock_id = s.id GROUP BY s.id, s.domain_id, s.load_qty, s.alloc_qty""",
    "allocate_orders_after": f"""
WITH RECURSIVE {GREEDY_WAITING} SELECT id, domain_id, batch_id, CASE WHEN status = 'W' AND (domain_id, batch_id, class_cd, com_cd, sku_cd) IN (SELECT (domain_id, batch_id, order_no, com_cd, sku_cd) FROM t_allocated)
  THEN 'A' ELSE status END AS status FROM wh_orders""",
    "allocate_create_jobs": f"""
WITH RECURSIVE {GREEDY_WAITING} SELECT sha256(concat_ws('|', domain_id, batch_id, order_no, com_cd, sku_cd, stock_id)) AS id, domain_id, batch_id, equip_type, equip_cd, cell_cd AS sub_equip_cd,
  order_no AS class_cd, com_cd, sku_cd, cast(assign_qty AS int) AS pick_qty, CASE WHEN domain_id = 1 THEN 'BW' ELSE 'W' END AS status FROM t_allocated""",
    "allocate_instructed": f"""
WITH RECURSIVE {TYPED},{SCOPE},
t_demand AS (SELECT domain_id, batch_id, equip_type, equip_cd, class_cd, com_cd, sku_cd, cast(sum(order_qty) AS bigint) AS order_qty, count(*) AS line_cnt
  FROM t_typed o WHERE order_type = 'MT' AND (domain_id, batch_id) IN (SELECT (domain_id, id) FROM t_scope) GROUP BY ALL),{TOTAL},{USABLE},{GREEDY}
SELECT * FROM t_allocated""",
    "inputable_box_count": "SELECT domain_id, batch_id, equip_type, count(DISTINCT order_no) AS inputable_box FROM wh_jobs WHERE order_type = 'MT' AND status IN ('BW', 'W') GROUP BY ALL",
    "inputable_box_by_type": """
SELECT domain_id, batch_id, equip_type, box_type_cd, input_plan_qty, input_box_qty, input_plan_qty - input_box_qty AS remain_qty FROM (
  SELECT o.domain_id, o.batch_id, o.equip_type, o.box_type_cd, count(DISTINCT o.order_no) AS input_plan_qty,
    (SELECT count(DISTINCT j.order_no) FROM wh_jobs j WHERE j.domain_id = o.domain_id AND j.batch_id = o.batch_id AND j.equip_type = o.equip_type AND j.box_type_cd = o.box_type_cd
      AND j.order_type = 'MT' AND j.status NOT IN ('BW', 'W')) AS input_box_qty
  FROM wh_orders o WHERE o.order_type = 'MT' GROUP BY o.domain_id, o.batch_id, o.equip_type, o.box_type_cd)""",
    "next_mapping_order": f"""
WITH {WAITING} SELECT domain_id, batch_id, box_type_cd, order_no, sku_cnt, pick_cnt FROM t_waiting
QUALIFY row_number() OVER (PARTITION BY domain_id, batch_id, box_type_cd ORDER BY sku_cnt, pick_cnt, order_no) = 1""",
    "next_mapping_single": """
WITH t_scan AS (SELECT DISTINCT domain_id, batch_id, box_id FROM wh_box_packs WHERE box_id IS NOT NULL),
t_held AS (SELECT s.*, j.id AS job_id, j.pick_qty - j.picked_qty AS qty FROM t_scan s JOIN wh_jobs j USING (domain_id, batch_id, box_id) WHERE j.order_type = 'OT'
  QUALIFY row_number() OVER (PARTITION BY domain_id, batch_id, box_id ORDER BY j.pick_qty - j.picked_qty, j.id) = 1),
t_free AS (SELECT *, row_number() OVER (PARTITION BY domain_id, batch_id ORDER BY box_id) AS n FROM t_scan ANTI JOIN t_held USING (domain_id, batch_id, box_id)),
t_ready AS (SELECT domain_id, batch_id, id AS job_id, pick_qty AS qty, row_number() OVER (PARTITION BY domain_id, batch_id ORDER BY pick_qty, id) AS n
  FROM wh_jobs WHERE order_type = 'OT' AND input_seq = 0 AND status = 'W' AND box_id IS NULL)
SELECT *, 1 AS is_held FROM t_held UNION ALL SELECT domain_id, batch_id, box_id, job_id, qty, 0 FROM t_free JOIN t_ready USING (domain_id, batch_id, n)""",
    "map_boxes": f"WITH {MAPPED} SELECT * FROM t_mapped",
    "new_input_rows": NEW_ROWS,
    "create_inputs": f"WITH {NEW_INPUTS} SELECT * FROM t_new_inputs",
    "apply_box_mapping": f"""
WITH {NEW_INPUTS},
t_hit AS (SELECT j.id, j.domain_id, j.batch_id, max(n.input_seq) AS new_seq
  FROM wh_jobs j LEFT JOIN wh_cells c ON c.domain_id = j.domain_id AND c.equip_type = j.equip_type AND c.equip_cd = j.equip_cd AND c.cell_cd = j.sub_equip_cd
  JOIN t_new_inputs n ON n.domain_id = j.domain_id AND n.batch_id = j.batch_id AND n.equip_type = j.equip_type AND n.class_cd = j.class_cd
    AND (j.order_type = 'OT' OR n.station_cd = c.station_cd)
  GROUP BY ALL)
SELECT j.id, j.domain_id, j.batch_id, coalesce(h.new_seq, j.input_seq) AS input_seq, coalesce(n.box_id, j.box_id) AS box_id, coalesce(n.color_cd, j.color_cd) AS color_cd,
  CASE WHEN h.id IS NULL THEN j.status WHEN j.order_type = 'OT' THEN 'P' ELSE 'I' END AS status
FROM wh_jobs j LEFT JOIN t_hit h ON h.domain_id = j.domain_id AND h.batch_id = j.batch_id AND h.id = j.id
  LEFT JOIN t_new_inputs n ON n.domain_id = h.domain_id AND n.batch_id = h.batch_id AND n.input_seq = h.new_seq""",
    "box_color": "SELECT domain_id, batch_id, box_id, CASE WHEN color_cd IS NULL THEN 'R' ELSE color_cd END AS color_cd FROM wh_arrivals",
    "box_type_of": "SELECT domain_id, batch_id, box_id, substr(box_id, 1, 1) AS box_type_cd, substr(box_id, 2, 2) AS box_type_2 FROM wh_arrivals",
    "input_seq_list": _input_list("status NOT IN ('BW', 'W') AND input_seq >= 1"),
    "input_seq_list_all": _input_list("status NOT IN ('BW', 'W')"),
    "input_seq_list_no_assigned": _input_list("status NOT IN ('BW', 'W', 'A') AND input_seq >= 1"),
    "input_seq_list_station": _input_list(
        "status NOT IN ('BW', 'W') AND input_seq >= 1 AND (domain_id, sub_equip_cd) IN (SELECT (domain_id, cell_cd) FROM wh_cells WHERE station_cd = 'S1')"
    ),
    "box_input_tab": _tab(False),
    "box_input_tab_selected": _tab(True),
    "box_input_details": """
SELECT j.id, j.domain_id, j.batch_id, j.order_no, c.station_cd AS cell_station_cd, c.side_cd, g.gw_cd, g.gw_nm AS gw_path, j.pick_qty, j.status
FROM wh_jobs j, wh_cells c, wh_indicators i, wh_gateways g
WHERE j.domain_id = c.domain_id AND j.equip_type = c.equip_type AND j.equip_cd = c.equip_cd AND j.sub_equip_cd = c.cell_cd
  AND i.domain_id = j.domain_id AND i.ind_cd = j.ind_cd AND g.domain_id = i.domain_id AND g.gw_cd = i.gw_cd AND g.stage_cd = j.stage_cd""",
    "box_arrivals": """
WITH t_scans AS (SELECT DISTINCT domain_id, batch_id, equip_type, equip_cd, station_cd, box_id FROM wh_jobs WHERE box_id IS NOT NULL)
SELECT s.*, i.id, i.order_no, 'R' AS status, CASE WHEN i.status = 'W' THEN 1 ELSE 0 END AS is_started
FROM t_scans s JOIN wh_inputs i USING (domain_id, batch_id, equip_type, equip_cd, station_cd, box_id) WHERE i.status IN ('W', 'R')
QUALIFY row_number() OVER (PARTITION BY s.domain_id, s.batch_id, s.equip_type, s.equip_cd, s.station_cd, s.box_id ORDER BY CASE WHEN i.status = 'W' THEN 1 ELSE 2 END, i.input_seq, i.id) = 1""",
    "box_duplicates": "SELECT domain_id, box_id, count(*) AS dup_cnt, 'G' AS scope FROM wh_box_packs GROUP BY ALL",
    "box_duplicates_date": "SELECT x.domain_id, y.job_date, x.box_id, count(*) AS dup_cnt, 'D' AS scope FROM wh_box_packs x JOIN wh_batches y ON y.domain_id = x.domain_id AND y.id = x.batch_id GROUP BY ALL",
    "box_duplicates_batch": "SELECT domain_id, batch_id, box_id, count(*) AS dup_cnt, 'B' AS scope FROM wh_jobs WHERE box_id IS NOT NULL GROUP BY ALL",
    "latest_box_of_cell": """
SELECT * FROM wh_box_packs p WHERE box_seq = (SELECT max(box_seq) FROM wh_box_packs m WHERE m.domain_id = p.domain_id AND m.batch_id = p.batch_id AND m.sub_equip_cd = p.sub_equip_cd)""",
    "resolve_scan": """
SELECT domain_id, code, CASE WHEN (domain_id, code) IN (SELECT (domain_id, sku_cd) FROM wh_sku) THEN 'SKU' WHEN (domain_id, code) IN (SELECT (domain_id, box_id) FROM wh_box_packs) THEN 'BOX'
  WHEN (domain_id, code) IN (SELECT (domain_id, cell_cd) FROM wh_cells) THEN 'CELL' WHEN (domain_id, code) IN (SELECT (domain_id, ind_cd) FROM wh_indicators) THEN 'IND'
  WHEN (domain_id, code) IN (SELECT (domain_id, rack_cd) FROM wh_racks) THEN 'RACK' END AS input_type
FROM wh_scanned_codes""",
    "picking_jobs": PICKING_COLUMNS + "j.status IN ('W', 'I', 'P', 'C')",
    "picking_jobs_restore": PICKING_COLUMNS
    + "(j.domain_id, j.batch_id, j.sub_equip_cd, j.input_seq) IN (SELECT (domain_id, batch_id, sub_equip_cd, min(input_seq)) FROM wh_jobs WHERE status = 'P' GROUP BY domain_id, batch_id, sub_equip_cd)",
    "picking_jobs_latest": PICKING_COLUMNS
    + "j.input_seq = (SELECT max(x.input_seq) FROM wh_inputs x WHERE x.domain_id = j.domain_id AND x.batch_id = j.batch_id AND x.status = 'R')",
    "job_indicator": """
SELECT j.id, j.domain_id, j.batch_id, coalesce(x.ind_cd, j.ind_cd) AS ind_cd, x.gw_nm AS gw_path
FROM wh_jobs j LEFT JOIN (SELECT c.domain_id, c.equip_cd, c.cell_cd, c.ind_cd, g.gw_nm, g.stage_cd FROM wh_cells c JOIN wh_indicators i ON i.domain_id = c.domain_id AND i.ind_cd = c.ind_cd
    JOIN wh_gateways g ON g.domain_id = i.domain_id AND g.gw_cd = i.gw_cd WHERE c.active_flag) x
  ON x.domain_id = j.domain_id AND x.equip_cd = j.equip_cd AND x.cell_cd = j.sub_equip_cd AND x.stage_cd = j.stage_cd""",
    "order_items": """
SELECT id, domain_id, batch_id, order_no, sku_cd, pick_qty, picked_qty, status FROM wh_jobs j
WHERE EXISTS (SELECT 1 FROM wh_box_packs p WHERE p.domain_id = j.domain_id AND p.batch_id = j.batch_id AND p.order_no = j.order_no)""",
    "single_pack_summary": """
WITH t_ot AS (SELECT *, CASE WHEN status IN ('W', 'P') THEN 1 ELSE 0 END AS todo FROM wh_jobs WHERE order_type = 'OT')
SELECT DISTINCT domain_id, batch_id, sku_cd, pick_qty, box_type_cd, count(*) OVER k AS tot_order_cnt, cast(count(*) OVER k - sum(todo) OVER k AS bigint) AS comp_order_cnt,
  count(*) OVER s AS tot_cnt, cast(count(*) OVER s - sum(todo) OVER s AS bigint) AS comp_cnt, CASE WHEN pick_qty = 10 AND box_type_cd = 'BT1' THEN 1 ELSE 0 END AS selected_job
FROM t_ot WINDOW k AS (PARTITION BY domain_id, batch_id, sku_cd, pick_qty, box_type_cd), s AS (PARTITION BY domain_id, batch_id, sku_cd)""",
    "confirm_pick": f"WITH {CONFIRMED} SELECT * FROM t_confirmed",
    "jobs_after_confirm": f"""
WITH {CONFIRMED} SELECT j.id, j.domain_id, j.batch_id, coalesce(c.picked_qty, j.picked_qty) AS picked_qty, coalesce(c.status, j.status) AS status, c.pick_started_at, c.pick_ended_at
FROM wh_jobs_at_start j LEFT JOIN t_confirmed c ON c.domain_id = j.domain_id AND c.batch_id = j.batch_id AND c.id = j.id""",
    "pick_to_orders": """
WITH t_picked AS (SELECT domain_id, batch_id, order_no, com_cd, sku_cd, sum(picked_qty) AS picked FROM wh_jobs GROUP BY ALL),
t_lines AS (SELECT o.*, p.picked, sum(o.order_qty) OVER (PARTITION BY o.domain_id, o.batch_id, o.order_no, o.com_cd, o.sku_cd ORDER BY o.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS room_before
  FROM wh_orders o JOIN t_picked p USING (domain_id, batch_id, order_no, com_cd, sku_cd)),
t_given AS (SELECT *, cast(greatest(0, least(order_qty, picked - coalesce(room_before, 0))) AS int) AS applied_qty FROM t_lines)
SELECT id, domain_id, batch_id, order_no, com_cd, sku_cd, applied_qty, applied_qty AS new_qty, CASE WHEN applied_qty >= order_qty THEN 'F' ELSE 'R' END AS status FROM t_given WHERE applied_qty > 0""".replace(
        "applied_qty AS new_qty", "applied_qty AS picked_qty"
    ),
    "stock_after_pick": """
SELECT s.id, s.domain_id, s.equip_type, s.equip_cd, s.cell_cd, s.com_cd, s.sku_cd, cast(coalesce(p.picked, 0) AS bigint) AS picked_qty,
  cast(s.load_qty + s.alloc_qty - coalesce(p.picked, 0) AS bigint) AS stock_qty
FROM wh_stocks s LEFT JOIN (SELECT domain_id, equip_cd, sub_equip_cd, com_cd, sku_cd, sum(picked_qty) AS picked FROM wh_jobs GROUP BY ALL) p
  ON p.domain_id = s.domain_id AND p.equip_cd = s.equip_cd AND p.sub_equip_cd = s.cell_cd AND p.com_cd = s.com_cd AND p.sku_cd = s.sku_cd""",
    "station_done": """
SELECT j.domain_id, j.batch_id, c.station_cd, j.order_no, j.box_id, count(*) FILTER (j.status IN ('W', 'I', 'P')) = 0 AS is_done
FROM wh_jobs j JOIN wh_cells c ON c.domain_id = j.domain_id AND c.equip_type = j.equip_type AND c.equip_cd = j.equip_cd AND c.cell_cd = j.sub_equip_cd
GROUP BY j.domain_id, j.batch_id, c.station_cd, j.order_no, j.box_id""",
    "boxing_done": "SELECT domain_id, batch_id, order_no, box_id, count(*) FILTER (status IN ('W', 'I', 'P')) = 0 AS is_done FROM wh_jobs GROUP BY domain_id, batch_id, order_no, box_id",
    "all_done": "SELECT domain_id, batch_id, count(*) FILTER (status IN ('W', 'I', 'P', 'F')) = 0 AS is_done FROM wh_jobs GROUP BY domain_id, batch_id",
    "jobs_after_boxing": """
WITH t_box AS (SELECT domain_id, batch_id, class_cd, box_id, count(*) FILTER (status IN ('W', 'I', 'P')) AS todo, count(*) FILTER (status = 'F') AS finished, max(pick_ended_at) AS ended
  FROM wh_jobs WHERE box_id IS NOT NULL GROUP BY ALL)
SELECT j.id, j.domain_id, j.batch_id, CASE WHEN b.box_id IS NOT NULL THEN 'B' ELSE j.status END AS status, b.ended AS boxed_at
FROM wh_jobs j LEFT JOIN t_box b ON b.domain_id = j.domain_id AND b.batch_id = j.batch_id AND b.class_cd = j.class_cd AND b.todo = 0 AND b.finished > 0""",
    "inputs_after_picking": """
SELECT i.id, i.domain_id, i.batch_id, CASE WHEN EXISTS (SELECT 1 FROM wh_jobs j WHERE j.domain_id = i.domain_id AND j.batch_id = i.batch_id AND j.order_no = i.order_no AND j.box_id = i.box_id
      AND j.station_cd = i.station_cd AND j.status IN ('W', 'I', 'P')) THEN i.status ELSE 'F' END AS status
FROM wh_inputs i""",
    "box_items": BOX_ITEMS,
    "box_packs": f"""
WITH t_items AS ({BOX_ITEMS}),
t_box AS (SELECT domain_id, batch_id, order_no, count(DISTINCT sku_cd) AS sku_qty, cast(sum(pick_qty) AS bigint) AS pick_qty, cast(sum(cast(sku_wt AS bigint) * pick_qty) AS bigint) AS wt, max(shop_cd) AS shop_cd
  FROM t_items GROUP BY ALL),
t_head AS (SELECT domain_id, batch_id, order_no, max(order_type) AS order_type, max(box_type_cd) AS box_type_cd, max(box_id) AS box_id, max(class_cd) AS class_cd, max(box_class_cd) AS box_class_cd FROM wh_jobs GROUP BY ALL)
SELECT concat('BP-', h.class_cd) AS id, x.domain_id, x.batch_id, b.job_date, b.job_seq, b.job_type, x.order_no, x.shop_cd, b.area_cd, b.stage_cd, b.equip_type, b.equip_cd,
  h.order_type, h.box_type_cd, h.box_id, x.sku_qty, x.pick_qty, 0 AS picked_qty,
  x.wt + coalesce((SELECT t.box_wt FROM wh_box_types t WHERE t.domain_id = x.domain_id AND t.box_type_cd = h.box_type_cd), 0) / cast(1000 AS double) AS box_wt,
  x.wt + coalesce((SELECT t.box_wt_min FROM wh_box_types t WHERE t.domain_id = x.domain_id AND t.box_type_cd = h.box_type_cd), 0) / cast(1000 AS double) AS box_wt_min,
  x.wt + coalesce((SELECT t.box_wt_max FROM wh_box_types t WHERE t.domain_id = x.domain_id AND t.box_type_cd = h.box_type_cd), 0) / cast(1000 AS double) AS box_wt_max,
  h.class_cd, h.box_class_cd, 0 AS pass_flag, 'W' AS status
FROM t_box x JOIN t_head h USING (domain_id, batch_id, order_no) JOIN wh_batches b ON b.domain_id = x.domain_id AND b.id = x.batch_id""",
    "update_box_items": "SELECT concat('BI-', id) AS id, domain_id, batch_id, 'B' AS status, picked_qty, 1 AS pass_flag FROM wh_orders",
    "box_of_order": "SELECT * FROM wh_box_packs p WHERE (domain_id, batch_id, order_no) IN (SELECT (domain_id, batch_id, order_no) FROM wh_jobs WHERE status = 'B')",
    "inspection_header": """
SELECT domain_id, batch_id, order_no, invoice_id, box_id, status, count(DISTINCT sku_cd) AS sku_qty, cast(coalesce(sum(picked_qty), 0) AS bigint) AS picked_qty FROM wh_jobs GROUP BY ALL""",
    "inspection_items": """
SELECT j.domain_id, j.batch_id, j.order_no, j.status, j.com_cd, j.sku_cd, s.sku_nm, s.sku_barcd, cast(coalesce(sum(j.picked_qty), 0) AS bigint) AS picked_qty
FROM wh_jobs j JOIN wh_sku s ON s.domain_id = j.domain_id AND s.com_cd = j.com_cd AND s.sku_cd = j.sku_cd GROUP BY ALL""",
    "batch_progress_jobs": f"WITH {_progress(JOB_ROWS, True)} SELECT * FROM t_progress",
    "batch_progress_jobs_multi": f"WITH {_progress(JOB_ROWS + chr(32) + "AND equip_cd = 'R1' AND order_type = 'MT'", False)} SELECT * FROM t_progress",
    "batch_progress_orders": f"WITH {_progress(ORDER_ROWS, True)} SELECT * FROM t_progress",
    "batch_summary": f"""
WITH {_progress(ORDER_ROWS, True)} SELECT p.*, (SELECT count(DISTINCT order_no) FROM wh_jobs j WHERE j.domain_id = p.domain_id AND j.batch_id = p.batch_id AND j.order_type = 'MT' AND j.status IN ('BW', 'W')) AS inputable_buckets
FROM t_progress p""",
    "batch_result": f"WITH {RESULT} SELECT * FROM t_result",
    "batch_result_jobs": """
WITH t_jobs AS (SELECT domain_id, batch_id, count(DISTINCT CASE WHEN pick_ended_at IS NOT NULL AND picked_qty > 0 THEN class_cd END) AS actual_order, sum(pick_qty) AS plan,
    cast(sum(picked_qty) AS bigint) AS actual_pcs, round(epoch(max(pick_ended_at) - min(pick_started_at)) / 3600, 2) AS hours FROM wh_jobs GROUP BY ALL)
SELECT domain_id, batch_id, actual_order, actual_pcs, CASE WHEN plan = 0 THEN 0.0 ELSE cast(actual_pcs AS double) / cast(plan AS double) * 100.0 END AS progress_rate,
  CASE WHEN hours > 0 THEN round(actual_pcs / hours, 2) ELSE 0.0 END AS job_uph
FROM t_jobs WHERE actual_order > 0""",
    "close_check": f"""
WITH {CLOSE} SELECT domain_id, batch_id, CASE WHEN status <> 'RUN' THEN 'NOT_RUNNING' WHEN order_cnt = 0 THEN 'NO_ORDERS' WHEN job_cnt = 0 THEN 'NO_JOBS' WHEN open_cnt > 0 THEN 'OPEN_JOBS' ELSE 'OK' END AS reason FROM t_close""",
    "close_check_forced": f"""
WITH {CLOSE} SELECT domain_id, batch_id, CASE WHEN status <> 'RUN' THEN 'NOT_RUNNING' WHEN order_cnt = 0 THEN 'NO_ORDERS' WHEN job_cnt = 0 THEN 'NO_JOBS' ELSE 'OK' END AS reason FROM t_close""",
    "close_check_group": """
SELECT domain_id, batch_group_id, running_cnt, first_equip_cd, open_equip_cnt, CASE WHEN running_cnt = 0 THEN 'NOT_RUNNING' WHEN open_equip_cnt > 0 THEN 'OPEN_JOBS' ELSE 'OK' END AS reason FROM (
  SELECT b.domain_id, b.batch_group_id, count(DISTINCT CASE WHEN b.status = 'RUN' THEN b.id END) AS running_cnt, min(j.equip_cd) AS first_equip_cd, count(DISTINCT j.equip_cd) AS open_equip_cnt
  FROM wh_batches b LEFT JOIN wh_jobs j ON j.domain_id = b.domain_id AND j.batch_id = b.id AND j.status IN ('W', 'I', 'P', 'C') GROUP BY b.domain_id, b.batch_group_id)""",
    "close_batch": f"""
WITH {CLOSE},{RESULT} SELECT b.domain_id, b.id, CASE WHEN c.batch_id IS NOT NULL THEN 'END' ELSE b.status END AS status, r.actual_order AS result_order_qty, r.actual_sku AS result_box_qty,
  r.actual_pcs AS result_pcs, r.rate_order AS progress_rate, r.uph, r.rate_sku AS equip_runtime
FROM wh_batches b LEFT JOIN t_closed c ON c.domain_id = b.domain_id AND c.batch_id = b.id LEFT JOIN t_result r ON r.domain_id = c.domain_id AND r.batch_id = c.batch_id""",
    "close_batch_stocks": f"""
WITH {CLOSE},
t_free AS (SELECT domain_id, rack_cd FROM wh_racks WHERE (domain_id, batch_id) IN (SELECT (domain_id, batch_id) FROM t_closed))
SELECT s.id, s.domain_id, CASE WHEN f.rack_cd IS NOT NULL AND NOT s.fixed_flag THEN NULL ELSE s.sku_cd END AS sku_cd,
  CASE WHEN f.rack_cd IS NOT NULL AND NOT s.fixed_flag THEN 0 ELSE s.load_qty END AS load_qty, CASE WHEN f.rack_cd IS NOT NULL AND NOT s.fixed_flag THEN 0 ELSE s.alloc_qty END AS alloc_qty
FROM wh_stocks s LEFT JOIN t_free f ON f.domain_id = s.domain_id AND f.rack_cd = s.equip_cd""",
    "close_batch_racks": f"""
WITH {CLOSE} SELECT r.domain_id, r.rack_cd, CASE WHEN c.batch_id IS NULL THEN r.status END AS status, CASE WHEN c.batch_id IS NULL THEN r.batch_id END AS batch_id
FROM wh_racks r LEFT JOIN t_closed c USING (domain_id, batch_id)""",
    "close_batch_preprocesses": f"WITH {CLOSE} SELECT * FROM wh_preprocesses WHERE (domain_id, batch_id) NOT IN (SELECT (domain_id, batch_id) FROM t_closed)",
    "close_batch_work_cells": f"WITH {CLOSE} SELECT * FROM wh_work_cells WHERE (domain_id, batch_id) NOT IN (SELECT (domain_id, batch_id) FROM t_closed)",
    "change_equipment_check": f"WITH {REQUESTS} SELECT domain_id, batch_id, to_equip_cd, reason FROM t_check",
    "change_equipment": f"""
WITH {REQUESTS},
t_cells AS (SELECT *, row_number() OVER (PARTITION BY domain_id, equip_type, equip_cd ORDER BY cell_seq, cell_cd) AS rn FROM wh_cells),
t_moves AS (SELECT k.domain_id, k.batch_id, a.cell_cd AS from_cell, k.to_equip_cd, z.cell_cd AS to_cell FROM t_check k
  JOIN t_cells a ON a.domain_id = k.domain_id AND a.equip_type = k.equip_type AND a.equip_cd = k.equip_cd
  JOIN t_cells z ON z.domain_id = k.domain_id AND z.equip_type = k.equip_type AND z.equip_cd = k.to_equip_cd AND z.rn = a.rn
  WHERE k.reason = 'OK')
SELECT o.id, o.domain_id, o.batch_id, coalesce(m.to_equip_cd, o.equip_cd) AS equip_cd, coalesce(m.to_cell, o.sub_equip_cd) AS sub_equip_cd
FROM wh_orders o LEFT JOIN t_moves m ON m.domain_id = o.domain_id AND m.batch_id = o.batch_id AND m.from_cell = o.sub_equip_cd""",
}

BODIES["stream_confirm_pick"] = f"""
WITH {CONFIRMED} SELECT id, domain_id, batch_id, picked_qty, applied_qty, status, pick_started_at, pick_ended_at FROM t_confirmed"""
BODIES["stream_progress"] = """
SELECT domain_id, batch_id, date_trunc('hour', ts) AS window_start, count(*) AS event_cnt, cast(sum(qty) AS bigint) AS qty FROM wh_pick_events GROUP BY ALL"""
BODIES["stream_box_arrival"] = BODIES["box_arrivals"]
SHOWN = "id, domain_id, batch_id, order_no, sku_cd, order_qty, order_type, status"
BODIES["sink_insert_select"] = f"""
SELECT {SHOWN} FROM wh_orders UNION ALL SELECT * REPLACE (concat(id, '-2') AS id, 'R' AS status) FROM (SELECT {SHOWN} FROM wh_orders WHERE status = 'W')"""
BODIES["sink_batch_insert"] = f"SELECT {SHOWN} FROM wh_orders"
BODIES["sink_update"] = f"""
SELECT * REPLACE (CASE WHEN status = 'W' AND cast(right(batch_id, 2) AS int) % 2 = 0 THEN 'C' ELSE status END AS status) FROM (SELECT {SHOWN} FROM wh_orders)"""
BODIES["sink_delete"] = f"""
SELECT {SHOWN} FROM wh_orders WHERE batch_id <> 'B1-199503' AND (domain_id, batch_id, order_no) NOT IN (SELECT (domain_id, batch_id, order_no) FROM wh_orders WHERE order_qty > 45)"""
BODIES["load_tables_pruned"] = """
WITH t_run AS (SELECT domain_id, id AS batch_id FROM wh_batches WHERE status = 'RUN'),
t_lines AS (SELECT domain_id, batch_id, count(*) AS line_cnt, cast(sum(order_qty) AS bigint) AS pcs FROM wh_orders GROUP BY ALL),
t_jobs AS (SELECT domain_id, batch_id, count(*) AS job_cnt, cast(sum(picked_qty) AS bigint) AS picked_pcs FROM wh_jobs GROUP BY ALL)
SELECT l.*, j.job_cnt, j.picked_pcs FROM t_run r JOIN t_lines l USING (domain_id, batch_id) LEFT JOIN t_jobs j USING (domain_id, batch_id)"""
BODIES["single_pack_jobs_appended"] = f"""
WITH {CLASSIFIED},
t_made AS (SELECT domain_id, batch_id, coalesce(equip_cd, 'R4') AS equip_cd, class_cd, com_cd, sku_cd, box_type_cd, sum(order_qty) AS pcs FROM t_classified WHERE order_type = 'OT' GROUP BY ALL),
t_all AS (SELECT domain_id, batch_id, equip_cd, order_type, status, pick_qty AS pcs, picked_qty FROM wh_jobs
  UNION ALL SELECT domain_id, batch_id, equip_cd, 'OT', 'W', pcs, 0 FROM t_made)
SELECT domain_id, batch_id, equip_cd, order_type, status, count(*) AS job_cnt, cast(sum(pcs) AS bigint) AS pcs, cast(sum(picked_qty) AS bigint) AS picked_pcs FROM t_all GROUP BY ALL"""
BODIES["split_batch_racks"] = f"""
WITH {SPLIT_MANY} SELECT r.domain_id, r.rack_cd, coalesce(r.batch_id, (SELECT max(p.new_batch_id) FROM t_parts p WHERE p.domain_id = r.domain_id AND p.equip_cd = r.rack_cd)) AS batch_id FROM wh_racks r"""
BODIES["cancel_instruction_racks"] = f"""
WITH {CANCELLED}, t_freed AS (SELECT DISTINCT domain_id, equip_cd AS rack_cd FROM t_cancelled WHERE allowed)
SELECT r.domain_id, r.rack_cd, CASE WHEN f.rack_cd IS NULL THEN r.status END AS status, CASE WHEN f.rack_cd IS NULL THEN r.batch_id END AS batch_id
FROM wh_racks r LEFT JOIN t_freed f USING (domain_id, rack_cd)"""
BODIES["batches_after_change"] = f"""
WITH {REQUESTS} SELECT b.domain_id, b.id, coalesce((SELECT k.to_equip_cd FROM t_check k WHERE k.reason = 'OK' AND k.domain_id = b.domain_id AND k.batch_id = b.id), b.equip_cd) AS equip_cd FROM wh_batches b"""
BODIES["hooks"] = f"""
WITH {TYPED},
t_lines AS (SELECT t.* FROM t_typed t JOIN wh_batches b ON b.domain_id = t.domain_id AND b.id = t.batch_id WHERE b.status IN ('WAIT', 'READY') AND t.com_cd <> 'COM3'),
t_many AS (SELECT domain_id, batch_id FROM t_lines GROUP BY ALL HAVING count(DISTINCT equip_cd) > 1),
t_ranked AS (SELECT domain_id, batch_id, equip_cd, row_number() OVER (PARTITION BY domain_id, batch_id ORDER BY equip_cd) AS place
  FROM (SELECT DISTINCT domain_id, batch_id, equip_cd FROM t_lines SEMI JOIN t_many USING (domain_id, batch_id) WHERE equip_cd IS NOT NULL))
SELECT o.id, o.domain_id, CASE WHEN r.place > 1 THEN concat(o.batch_id, '-', r.place) ELSE o.batch_id END AS batch_id, CASE WHEN o.com_cd = 'COM1' THEN 'H' ELSE 'W' END AS status
FROM t_lines o LEFT JOIN t_ranked r USING (domain_id, batch_id, equip_cd)"""
LEFT_OUT = "AND order_type = 'MT' AND (domain_id, batch_id, class_cd) NOT IN (SELECT (domain_id, batch_id, class_cd) FROM wh_orders WHERE status = 'W' AND com_cd = 'COM1')"
BODIES["skip_orders_hook"] = f"WITH RECURSIVE {DEMAND.format(kind=LEFT_OUT)},{TOTAL},{USABLE},{GREEDY} SELECT * FROM t_allocated"
BODIES["picking_jobs_blank_seq"] = PICKING_COLUMNS + "coalesce(j.input_seq, 0) = 0"
BODIES["picking_jobs_other_cells"] = PICKING_COLUMNS + "j.equip_cd = 'R1' AND c.cell_cd <> 'R1-C5'"
BODIES["rowset_page_deep"] = """
SELECT id, domain_id, batch_id, pick_qty FROM wh_jobs QUALIFY row_number() OVER (PARTITION BY domain_id ORDER BY pick_qty DESC, id) BETWEEN 13981 AND 14000"""
BODIES["rowset_page_of_all"] = "SELECT id, domain_id, batch_id, order_qty FROM wh_orders ORDER BY order_qty DESC, id LIMIT 1000 OFFSET 24000"
BY_BATCH = DEMAND.format(kind="AND order_type = 'MT'") + "," + TOTAL + "," + USABLE + """,
t_turns AS (SELECT *, row_number() OVER (PARTITION BY domain_id, equip_type, equip_cd ORDER BY job_date DESC NULLS LAST, batch_id) AS turn
  FROM (SELECT DISTINCT d.domain_id, d.equip_type, d.equip_cd, d.batch_id, b.job_date FROM t_demand d JOIN wh_batches b ON b.domain_id = d.domain_id AND b.id = d.batch_id WHERE b.status = 'RUN')),
t_lines AS (SELECT d.*, t.turn, dense_rank() OVER (PARTITION BY d.domain_id, d.equip_type, d.equip_cd ORDER BY d.com_cd, d.sku_cd) AS i,
    sum(order_qty) OVER same AS pcs, sum(line_cnt) OVER same AS line_sum
  FROM t_demand d JOIN t_turns t USING (domain_id, equip_type, equip_cd, batch_id)
  WINDOW same AS (PARTITION BY d.domain_id, d.equip_type, d.equip_cd, t.turn, d.com_cd, d.sku_cd)),
t_orders AS (SELECT domain_id, equip_type, equip_cd, turn, list({'class_cd': class_cd, 'need': need}) AS orders
  FROM (SELECT domain_id, equip_type, equip_cd, turn, class_cd, list({'i': i, 'qty': order_qty, 'sku': sku_cd, 'com': com_cd, 'pcs': pcs, 'lines': line_sum}) AS need FROM t_lines GROUP BY ALL) GROUP BY ALL),
t_cap AS (SELECT domain_id, equip_type, equip_cd, com_cd, sku_cd, sum(load_qty) AS cap FROM t_usable GROUP BY ALL),
t_item AS (SELECT DISTINCT w.domain_id, w.equip_type, w.equip_cd, w.i, cast(coalesce(cap, 0) AS bigint) AS cap, cast(coalesce(stock_qty, 0) AS bigint) AS stock
  FROM t_lines w LEFT JOIN t_cap USING (domain_id, equip_type, equip_cd, com_cd, sku_cd) LEFT JOIN t_total USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)),
t_run AS (
  SELECT domain_id, equip_type, equip_cd, cast(0 AS bigint) AS turn, cast(0 AS bigint) AS seq, list(cap ORDER BY i) AS rest, list(stock ORDER BY i) AS stock, '' AS class_cd, false AS taken,
    (SELECT any_value([{'k': {'cls': 0, 'load': cast(0 AS bigint), 'sku': '', 'com': '', 'qty': cast(0 AS bigint)}, 'class_cd': '', 'need': orders[1].need}]) FROM t_orders)[2:] AS todo
  FROM t_item GROUP BY ALL
  UNION ALL
  SELECT r.domain_id, r.equip_type, r.equip_cd, CASE WHEN len(todo) > 0 THEN r.turn ELSE n.turn END, CASE WHEN len(todo) > 0 THEN r.seq + 1 ELSE 0 END,
    CASE WHEN len(todo) > 0 AND list_min([rest[x.i] - x.qty for x in todo[1].need]) >= 0 THEN [v - coalesce(map([x.i for x in todo[1].need], [x.qty for x in todo[1].need])[k], 0) for v, k in rest] ELSE rest END,
    CASE WHEN len(todo) > 0 AND list_min([rest[x.i] - x.qty for x in todo[1].need]) >= 0 THEN [v - coalesce(map([x.i for x in todo[1].need], [x.qty for x in todo[1].need])[k], 0) for v, k in stock] ELSE stock END,
    CASE WHEN len(todo) > 0 THEN todo[1].class_cd ELSE '' END,
    len(todo) > 0 AND list_min([rest[x.i] - x.qty for x in todo[1].need]) >= 0,
    CASE WHEN len(todo) > 0 THEN todo[2:] ELSE list_sort([{
        'k': list_min([{'cls': CASE WHEN x.pcs <= stock[x.i] THEN 1 WHEN x.lines >= stock[x.i] THEN 2 ELSE 3 END, 'load': -stock[x.i], 'sku': x.sku, 'com': x.com, 'qty': x.qty} for x in o.need if stock[x.i] > 0]),
        'class_cd': o.class_cd, 'need': o.need} for o in n.orders if list_max([stock[x.i] for x in o.need]) > 0]) END
  FROM t_run r LEFT JOIN t_orders n ON n.domain_id = r.domain_id AND n.equip_type = r.equip_type AND n.equip_cd = r.equip_cd AND n.turn = r.turn + 1
  WHERE len(todo) > 0 OR n.turn IS NOT NULL),
t_taken AS (SELECT l.*, r.seq, cast(sum(order_qty) OVER (PARTITION BY domain_id, equip_type, equip_cd, com_cd, sku_cd ORDER BY turn, r.seq) AS bigint) AS l_end
  FROM t_lines l JOIN (SELECT domain_id, equip_type, equip_cd, turn, class_cd, seq FROM t_run WHERE taken) r USING (domain_id, equip_type, equip_cd, turn, class_cd))"""
BODIES["allocate_by_batch"] = f"""
WITH RECURSIVE {BY_BATCH}
SELECT l.domain_id, l.batch_id, l.equip_type, l.equip_cd, l.class_cd AS order_no, l.com_cd, l.sku_cd, u.cell_cd, u.ind_cd, u.id AS stock_id,
  cast(least(l_end, c_end) - greatest(l_end - order_qty, c_end - load_qty) AS bigint) AS assign_qty, l.seq, l.turn AS wave
FROM t_taken l JOIN t_usable u USING (domain_id, equip_type, equip_cd, com_cd, sku_cd)
WHERE least(l_end, c_end) > greatest(l_end - order_qty, c_end - load_qty)"""
UPSTREAM = """
t_new AS (SELECT * REPLACE (CASE WHEN cast(job_date AS int) % 7 = 0 AND order_line_no = '3' THEN NULL ELSE order_qty END AS order_qty),
    CASE WHEN cast(job_date AS int) % 5 = 0 AND order_line_no = '2' THEN 'MT' END AS given_type FROM wh_wms_if_orders WHERE if_flag = 'N'),
t_bad AS (SELECT DISTINCT domain_id, com_cd, area_cd, stage_cd, wms_batch_no FROM t_new WHERE order_qty IS NULL),
t_good AS (SELECT * FROM t_new ANTI JOIN t_bad USING (domain_id, com_cd, area_cd, stage_cd, wms_batch_no)
    QUALIFY row_number() OVER (PARTITION BY domain_id, order_no, order_line_no, com_cd, sku_cd
        ORDER BY wms_batch_no, wcs_batch_no, job_date, job_type, area_cd, stage_cd, equip_type, equip_cd, shop_cd, box_type_cd, order_qty) = 1)"""
BODIES["stream_receive"] = f"""
WITH {UPSTREAM}
SELECT w.domain_id, concat('RB-', w.wms_batch_no) AS batch_id, w.order_no, w.order_line_no, w.com_cd, w.sku_cd, w.order_qty,
  CASE WHEN (SELECT count(x.given_type) FROM t_good x WHERE x.domain_id = w.domain_id AND x.wms_batch_no = w.wms_batch_no) > 0 THEN w.given_type
       WHEN (SELECT count(DISTINCT (x.com_cd, x.sku_cd)) FROM t_good x WHERE x.domain_id = w.domain_id AND x.wms_batch_no = w.wms_batch_no AND x.order_no = w.order_no) = 1 THEN 'OT' ELSE 'MT' END AS order_type,
  'T' AS status
FROM t_good w"""
BODIES["stream_receive_items"] = f"""
WITH {UPSTREAM}
SELECT DISTINCT n.domain_id, n.com_cd, n.area_cd, n.stage_cd, n.wms_batch_no, concat('RB-', n.wms_batch_no) AS batch_id, CASE WHEN b.domain_id IS NULL THEN 'F' ELSE 'E' END AS status
FROM t_new n LEFT JOIN t_bad b USING (domain_id, com_cd, area_cd, stage_cd, wms_batch_no)"""
BODIES["stream_receive_errors"] = f"""
WITH {UPSTREAM}
SELECT domain_id, order_no, order_line_no, com_cd, sku_cd, area_cd, stage_cd, wms_batch_no FROM t_new SEMI JOIN t_bad USING (domain_id, com_cd, area_cd, stage_cd, wms_batch_no)"""


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(body) for name, body in BODIES.items()}
