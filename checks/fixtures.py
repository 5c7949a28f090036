"""The derived warehouse tables as SQL (see FIXTURES.md), for the comparison engine.

``with_tables`` puts the needed definitions in front of a query body.
"""

from __future__ import annotations

import re

VIEWS = {
    "wh_lines": """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(l_linenumber AS string), '-', cast(cast(l_quantity AS int) AS string)) AS id,
  cast(1 + l_orderkey % 2 AS int) AS domain_id,
  concat('B', cast(1 + l_orderkey % 2 AS string), '-', cast(year(o_orderdate) * 100 + month(o_orderdate) AS string)) AS batch_id,
  cast(year(o_orderdate) * 100 + month(o_orderdate) AS string) AS job_date,
  l_orderkey, l_partkey, l_linenumber, l_returnflag, o_orderstatus, o_custkey,
  cast(l_quantity AS int) AS qty,
  cast(CASE WHEN o_orderstatus = 'F' THEN l_quantity
            WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN l_quantity
            WHEN o_orderstatus = 'P' AND l_returnflag = 'A' THEN floor(l_quantity / 2)
            ELSE 0 END AS int) AS picked,
  cast(1 + l_orderkey % 4 AS int) AS rack_no, cast(l_partkey % 40 AS int) AS cell_no, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "wh_orders": """
SELECT id, domain_id, batch_id, job_date, '1' AS job_seq, 'DPS' AS job_type,
  concat('O', cast(l_orderkey AS string)) AS order_no, cast(l_linenumber AS string) AS order_line_no,
  concat('CO', cast(l_orderkey % 997 AS string)) AS cust_order_no, concat('O', cast(l_orderkey AS string)) AS class_cd,
  concat('BC', cast(l_orderkey % 5 AS string)) AS box_class_cd, concat('COM', cast(l_partkey % 4 AS string)) AS com_cd,
  concat('SKU', cast(l_partkey AS string)) AS sku_cd, concat('SHOP', cast(o_custkey % 10 AS string)) AS shop_cd,
  'A1' AS area_cd, 'ST1' AS stage_cd, 'Rack' AS equip_type, concat('R', cast(rack_no AS string)) AS equip_cd,
  concat('R', cast(rack_no AS string), '-C', cast(cell_no AS string)) AS sub_equip_cd,
  concat('BT', cast(l_orderkey % 3 AS string)) AS box_type_cd, qty AS order_qty, picked AS picked_qty,
  CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 'OT' ELSE 'MT' END AS order_type,
  CASE WHEN o_orderstatus = 'O' THEN 'W' WHEN picked >= qty THEN 'F' WHEN picked > 0 THEN 'R' ELSE 'A' END AS status,
  l_shipdate AS updated_at
FROM wh_lines""",
    "wh_received_orders": """
SELECT * REPLACE (
  CASE WHEN cast(job_date AS int) % 5 = 0 AND order_line_no = '1' THEN order_type END AS order_type,
  CASE WHEN cast(job_date AS int) % 4 = 0 AND equip_cd IN ('R3', 'R4') THEN NULL ELSE equip_cd END AS equip_cd,
  0 AS picked_qty, 'W' AS status)
FROM wh_orders""",
    "wh_wms_if_orders": """
SELECT domain_id, concat('W', batch_id) AS wms_batch_no, concat('C', batch_id) AS wcs_batch_no,
  job_date, job_type, order_no, order_line_no, com_cd, area_cd, stage_cd, equip_type, equip_cd,
  shop_cd, sku_cd, box_type_cd, order_qty, class_cd,
  CASE WHEN cast(substr(order_no, 2) AS bigint) % 3 = 0 THEN 'N' ELSE 'Y' END AS if_flag
FROM wh_orders""",
    "wh_jobs": """
SELECT concat('J-', cast(l_orderkey AS string), '-', cast(l_partkey AS string)) AS id,
  domain_id, batch_id, 'ST1' AS stage_cd, 'DPS' AS job_type, 'Rack' AS equip_type,
  concat('R', cast(rack_no AS string)) AS equip_cd,
  concat('R', cast(rack_no AS string), '-C', cast(cell_no AS string)) AS sub_equip_cd,
  concat('S', cast(cell_no % 4 AS string)) AS station_cd,
  concat('I', cast(rack_no AS string), '-', cast(cell_no AS string)) AS ind_cd,
  concat('O', cast(l_orderkey AS string)) AS order_no, concat('O', cast(l_orderkey AS string)) AS class_cd,
  concat('BC', cast(l_orderkey % 5 AS string)) AS box_class_cd, concat('COM', cast(l_partkey % 4 AS string)) AS com_cd,
  concat('SKU', cast(l_partkey AS string)) AS sku_cd, concat('BT', cast(l_orderkey % 3 AS string)) AS box_type_cd,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE concat('BX', cast(l_orderkey AS string)) END AS box_id,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE concat('INV', cast(l_orderkey AS string)) END AS invoice_id,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE substr('RGBY', cast(1 + l_orderkey % 4 AS int), 1) END AS color_cd,
  CASE WHEN count(*) OVER (PARTITION BY l_orderkey) = 1 THEN 'OT' ELSE 'MT' END AS order_type,
  cast(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE l_orderkey * 4 + cell_no % 4 + 1 END AS bigint) AS input_seq,
  cast(pick_qty AS int) AS pick_qty, cast(picked_qty AS int) AS picked_qty,
  CASE WHEN min_line = 7 THEN 'C' WHEN o_orderstatus = 'O' THEN 'W' WHEN o_orderstatus = 'F' THEN 'B'
       WHEN picked_qty >= pick_qty THEN 'F' WHEN picked_qty > 0 THEN 'P' ELSE 'I' END AS status,
  CASE WHEN picked_qty > 0 THEN started_at END AS pick_started_at,
  CASE WHEN picked_qty >= pick_qty THEN ended_at END AS pick_ended_at
FROM (
  SELECT domain_id, batch_id, rack_no, cell_no, l_orderkey, l_partkey, o_orderstatus,
    sum(qty) AS pick_qty, sum(picked) AS picked_qty, min(l_linenumber) AS min_line,
    min(l_shipdate) AS started_at, max(l_shipdate) AS ended_at
  FROM wh_lines
  GROUP BY domain_id, batch_id, rack_no, cell_no, l_orderkey, l_partkey, o_orderstatus) g""",
    "wh_jobs_at_start": """
SELECT * REPLACE (0 AS picked_qty, CASE WHEN status IN ('W', 'C') THEN status ELSE 'P' END AS status,
  cast(NULL AS timestamp) AS pick_started_at, cast(NULL AS timestamp) AS pick_ended_at)
FROM wh_jobs""",
    "wh_inputs": """
SELECT concat('IN-', order_no, '-', station_cd) AS id, domain_id, batch_id, equip_type, equip_cd, station_cd,
  order_no, box_id, max(color_cd) AS color_cd, min(input_seq) AS input_seq,
  CASE WHEN sum(pick_qty) = sum(picked_qty) THEN 'F' WHEN sum(picked_qty) > 0 THEN 'R' ELSE 'W' END AS status
FROM wh_jobs WHERE input_seq > 0
GROUP BY domain_id, batch_id, equip_type, equip_cd, station_cd, order_no, box_id""",
    "wh_places": """
SELECT domain_id, rack_no FROM (SELECT 1 AS domain_id UNION ALL SELECT 2) d
CROSS JOIN (SELECT 1 AS rack_no UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) r""",
    "wh_cells": """
SELECT domain_id, 'Rack' AS equip_type, concat('R', cast(rack_no AS string)) AS equip_cd,
  concat('R', cast(rack_no AS string), '-C', cast(p_partkey AS string)) AS cell_cd, cast(p_partkey AS int) AS cell_seq,
  concat('S', cast(p_partkey % 4 AS string)) AS station_cd, concat('Z', cast(p_partkey % 2 AS string)) AS equip_zone_cd,
  CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE 'R' END AS side_cd,
  concat('I', cast(rack_no AS string), '-', cast(p_partkey AS string)) AS ind_cd,
  p_partkey % 10 <> 9 AND NOT (rack_no = 4 AND p_partkey = 5) AS active_flag
FROM part CROSS JOIN wh_places WHERE p_partkey < 40""",
    "wh_racks": """
SELECT domain_id, concat('R', cast(rack_no AS string)) AS rack_cd, concat('Rack ', cast(rack_no AS string)) AS rack_nm,
  'A1' AS area_cd, 'ST1' AS stage_cd, 'DPS' AS job_type, CASE WHEN rack_no = 4 THEN 'O' ELSE 'M' END AS rack_type,
  true AS active_flag, 'RUN' AS status,
  CASE WHEN rack_no <= 2 THEN concat('B', cast(domain_id AS string), '-199612') END AS batch_id
FROM wh_places""",
    "wh_stocks": """
SELECT concat('ST', cast(domain_id AS string), '-', cast(rack_no AS string), '-', cast(p_partkey AS string), '-', cast(loc AS string)) AS id,
  domain_id, 'Rack' AS equip_type, concat('R', cast(rack_no AS string)) AS equip_cd,
  concat('R', cast(rack_no AS string), '-C', cast((p_partkey + 13 * (loc - 1)) % 40 AS string)) AS cell_cd,
  concat('COM', cast(p_partkey % 4 AS string)) AS com_cd, concat('SKU', cast(p_partkey AS string)) AS sku_cd,
  cast((p_size * loc * 5 + rack_no * 7) % 90 AS int) AS load_qty, 0 AS alloc_qty,
  p_partkey % 17 <> 0 AS active_flag, p_partkey % 2 = 0 AS fixed_flag
FROM part CROSS JOIN wh_places CROSS JOIN (SELECT 1 AS loc UNION ALL SELECT 2) l""",
    "wh_sku": """
SELECT domain_id, concat('COM', cast(p_partkey % 4 AS string)) AS com_cd, concat('SKU', cast(p_partkey AS string)) AS sku_cd,
  p_name AS sku_nm, concat('880', cast(1000000 + p_partkey AS string)) AS sku_barcd, p_size AS sku_wt
FROM part CROSS JOIN (SELECT 1 AS domain_id UNION ALL SELECT 2) d""",
    "wh_indicators": """
SELECT domain_id, ind_cd, concat('G', substr(equip_cd, 2, 1), '-', cast(cell_seq % 2 AS string)) AS gw_cd
FROM wh_cells WHERE cell_seq % 8 <> 7""",
    "wh_gateways": """
SELECT DISTINCT domain_id, gw_cd, concat('GW/', gw_cd) AS gw_nm, 'ST1' AS stage_cd FROM wh_indicators WHERE gw_cd <> 'G4-1'""",
    "wh_batches": """
SELECT domain_id, batch_id AS id, concat('G', cast(domain_id AS string), '-', substr(job_date, 1, 4)) AS batch_group_id,
  job_date, '1' AS job_seq, 'DPS' AS job_type, 'A1' AS area_cd, 'ST1' AS stage_cd, 'Rack' AS equip_type,
  CASE WHEN cast(job_date AS int) % 4 = 0 THEN concat('R', cast(domain_id AS string)) END AS equip_cd,
  concat('CS', cast(domain_id AS string)) AS job_config_set_id,
  CASE WHEN cast(job_date AS int) % 3 = 0 THEN 'WAIT' ELSE 'RUN' END AS status,
  CASE WHEN cast(job_date AS int) % 3 <> 0 THEN strptime(concat(job_date, '01'), '%Y%m%d') END AS instructed_at
FROM (SELECT DISTINCT domain_id, batch_id, job_date FROM wh_lines) b""",
    "wh_configs": """
SELECT domain_id, concat('CS', cast(domain_id AS string)) AS job_config_set_id, name, value FROM (VALUES
  (1, 'dps.preprocess.box-request.enabled', 'true'), (1, 'dps.preproces.cell.mapping.field', 'order_no'),
  (1, 'dps.pick.1box.enabled', 'true'), (1, 'dps.batch.split-by-rack.enabled', 'true'),
  (1, 'dps.station.wait-pool.count', '4'), (2, 'dps.preproces.cell.mapping.field', 'cust_order_no'),
  (2, 'dps.box.out.class.field', 'shop_cd'), (2, 'dps.pick.1box.enabled', 'false'),
  (2, 'dps.input.box.type.split.index', '0,3')) v(domain_id, name, value)""",
    "wh_box_types": """
SELECT domain_id, concat('BT', cast(n AS string)) AS box_type_cd, 100 * (n + 1) AS box_wt, 90 * (n + 1) AS box_wt_min, 110 * (n + 1) AS box_wt_max
FROM (SELECT 1 AS domain_id UNION ALL SELECT 2) d CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) t""",
    "wh_box_packs": """
SELECT concat('BP-', class_cd) AS id, domain_id, batch_id, class_cd, cust_order_no, order_no,
  concat('BX', cast(number % 5000 AS string)) AS box_id, concat(equip_cd, '-C', cast(number % 40 AS string)) AS sub_equip_cd,
  number AS box_seq, CASE WHEN number % 7 = 0 THEN 'W' ELSE 'B' END AS status
FROM (
  SELECT domain_id, batch_id, class_cd, order_no, min(cust_order_no) AS cust_order_no, min(equip_cd) AS equip_cd,
    cast(substr(order_no, 2) AS bigint) AS number
  FROM wh_orders WHERE status = 'F' GROUP BY domain_id, batch_id, class_cd, order_no) x""",
    "wh_pick_events": """
SELECT concat(id, '/', cast(n AS string)) AS event_id, domain_id, batch_id,
  concat('J-', cast(l_orderkey AS string), '-', cast(l_partkey AS string)) AS job_id,
  CASE WHEN n = 1 THEN l_shipdate + INTERVAL '1' MINUTE ELSE l_shipdate + INTERVAL '9' MINUTE END AS ts,
  cast(CASE WHEN n = 1 THEN picked - floor(picked / 2)
            ELSE floor(picked / 2) + CASE WHEN l_orderkey % 4 = 0 THEN 3 ELSE 0 END END AS int) AS qty
FROM wh_lines CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2) e
WHERE picked > 0 AND (n = 1 OR l_linenumber % 3 = 0)""",
    "wh_arrivals": """
SELECT domain_id, batch_id, CASE WHEN status = 'W' THEN concat('E', id) ELSE concat('BX', substr(order_no, 2)) END AS box_id,
  concat('BT', cast(cast(substr(sku_cd, 4) AS bigint) % 3 AS string)) AS box_type_cd,
  CASE WHEN com_cd = 'COM1' THEN 'G' END AS color_cd, updated_at AS arrived_at
FROM wh_orders WHERE order_line_no = '1' AND status IN ('W', 'A')""",
    "wh_preprocesses": """
SELECT domain_id, batch_id, equip_type, equip_cd, sub_equip_cd, com_cd, sku_cd, cast(sum(order_qty) AS bigint) AS total_pcs
FROM wh_orders GROUP BY domain_id, batch_id, equip_type, equip_cd, sub_equip_cd, com_cd, sku_cd""",
    "wh_work_cells": "SELECT DISTINCT domain_id, batch_id, sub_equip_cd AS cell_cd FROM wh_jobs",
    "wh_merge_plan": """
SELECT w.domain_id, w.id AS batch_id, (SELECT max(r.id) FROM wh_batches r WHERE r.domain_id = w.domain_id AND r.batch_group_id = w.batch_group_id AND r.status = 'RUN') AS main_batch_id
FROM wh_batches w WHERE w.status = 'WAIT'
  AND EXISTS (SELECT 1 FROM wh_batches r WHERE r.domain_id = w.domain_id AND r.batch_group_id = w.batch_group_id AND r.status = 'RUN')""",
    "wh_rack_requests": """
SELECT domain_id, id AS batch_id, concat('R', cast(CASE WHEN cast(job_date AS int) % 2 = 0 THEN domain_id + 2 ELSE domain_id END AS string)) AS to_equip_cd
FROM wh_batches""",
    "wh_scanned_codes": """
SELECT domain_id, box_id AS code FROM wh_box_packs UNION SELECT domain_id, sub_equip_cd FROM wh_orders
UNION SELECT domain_id, ind_cd FROM wh_jobs UNION SELECT domain_id, sku_cd FROM wh_orders
UNION SELECT domain_id, order_no FROM wh_orders UNION SELECT domain_id, rack_cd FROM wh_racks""",
}

ORDER = list(VIEWS)


def _needed(body: str, found: set[str]) -> set[str]:
    for name in set(re.findall(r"\bwh_\w+", body)) & set(VIEWS) - found:
        found.add(name)
        _needed(VIEWS[name], found)
    return found


def with_tables(body: str) -> str:
    """``body`` with the table definitions it needs; a leading WITH of the body is joined to them."""
    needed = _needed(body, set())
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in ORDER if name in needed]
    body = body.strip()
    if not parts:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return head + ",\n".join(parts) + ",\n" + body[len(head) :].lstrip()
    return "WITH " + ",\n".join(parts) + "\n" + body
