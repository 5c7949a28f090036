"""Table schemas and code values."""

from __future__ import annotations

# Order type, order status, job status, input status, batch status, rack type.
MULTI, SINGLE = "MT", "OT"
ORDER_WAIT, ORDER_TYPED, ORDER_INSTRUCTED, ORDER_ASSIGNED = "W", "T", "I", "A"
ORDER_RUNNING, ORDER_FINISHED, ORDER_CANCELLED = "R", "F", "C"
JOB_BOX_WAIT, JOB_WAIT, JOB_INPUT, JOB_PICKING, JOB_FINISHED, JOB_BOXED = "BW", "W", "I", "P", "F", "B"
JOB_CANCELLED = ("C", "D")
JOB_WIP = ("W", "I", "P")
JOB_WIPF = ("W", "I", "P", "F")
JOB_WIPC = ("W", "I", "P", "C")
INPUT_WAIT, INPUT_RUNNING, INPUT_FINISHED = "W", "R", "F"
BATCH_WAIT, BATCH_READY, BATCH_RUNNING = "WAIT", "READY", "RUN"
BATCH_MERGED, BATCH_CANCELLED, BATCH_END = "MERGED", "CANCEL", "END"
SINGLE_PACK_RACK = "O"
RECEIPT_WAIT, RECEIPT_FINISHED, RECEIPT_SKIPPED, RECEIPT_ERROR = "W", "F", "S", "E"

# Configuration keys read per batch, with the type of their value.
CONFIG_KEYS = {
    "dps.input.box.type": "string",
    "dps.preproces.cell.mapping.field": "string",
    "dps.box.out.class.field": "string",
    "dps.station.wait-pool.count": "int",
    "dps.batch.split-by-rack.enabled": "boolean",
    "dps.sku.popula.rank.calc.days": "string",
    "dps.pick.1box.enabled": "boolean",
    "dps.pick.1sku.1pcs.enabled": "boolean",
    "dps.pick.1sku.npcs.enabled": "boolean",
    "dps.supple.recommend-cell.enabled": "boolean",
    "dps.pick.with-inspection.enabled": "boolean",
    "dps.input.box.type.split.index": "string",
    "dps.preprocess.box-request.enabled": "boolean",
    "dps.box.id.unique.scope": "string",
}


def flag_name(key: str) -> str:
    """Column name of a configuration key: without the prefix, separators as underscores."""
    return key.removeprefix("dps.").replace(".", "_").replace("-", "_")


KEY = ["domain_id", "batch_id"]

SCHEMAS = {
    "wms_if_orders": """domain_id int, wms_batch_no string, wcs_batch_no string, job_date string, job_type string,
        order_no string, order_line_no string, com_cd string, area_cd string, stage_cd string, equip_type string,
        equip_cd string, shop_cd string, sku_cd string, box_type_cd string, order_qty int, class_cd string,
        if_flag string""",
    "orders": """id string, domain_id int, batch_id string, job_date string, job_seq string, job_type string,
        order_no string, order_line_no string, cust_order_no string, class_cd string, box_class_cd string,
        com_cd string, sku_cd string, shop_cd string, area_cd string, stage_cd string, equip_type string,
        equip_cd string, sub_equip_cd string, box_type_cd string, order_qty int, picked_qty int, order_type string,
        status string, updated_at timestamp_ntz""",
    "jobs": """id string, domain_id int, batch_id string, stage_cd string, job_type string, equip_type string,
        equip_cd string, sub_equip_cd string, ind_cd string, order_no string, class_cd string, box_class_cd string,
        com_cd string, sku_cd string, box_type_cd string, box_id string, invoice_id string, color_cd string,
        order_type string, input_seq bigint, pick_qty int, picked_qty int, status string,
        pick_started_at timestamp_ntz, pick_ended_at timestamp_ntz""",
    "inputs": """id string, domain_id int, batch_id string, equip_type string, equip_cd string, station_cd string,
        order_no string, box_id string, color_cd string, input_seq bigint, status string""",
    "cells": """domain_id int, equip_type string, equip_cd string, cell_cd string, cell_seq int, station_cd string,
        equip_zone_cd string, side_cd string, ind_cd string, active_flag boolean""",
    "racks": """domain_id int, rack_cd string, rack_nm string, area_cd string, stage_cd string, job_type string,
        rack_type string, active_flag boolean, status string, batch_id string""",
    "stocks": """id string, domain_id int, equip_type string, equip_cd string, cell_cd string, com_cd string,
        sku_cd string, load_qty int, alloc_qty int, active_flag boolean, fixed_flag boolean""",
    "sku": "domain_id int, com_cd string, sku_cd string, sku_nm string, sku_barcd string, sku_wt int",
    "indicators": "domain_id int, ind_cd string, gw_cd string",
    "gateways": "domain_id int, gw_cd string, gw_nm string, stage_cd string",
    "batches": """domain_id int, id string, batch_group_id string, job_date string, job_seq string, job_type string,
        area_cd string, stage_cd string, equip_type string, equip_cd string, job_config_set_id string, status string,
        instructed_at timestamp_ntz""",
    "configs": "domain_id int, job_config_set_id string, name string, value string",
    "box_types": "domain_id int, box_type_cd string, box_wt int, box_wt_min int, box_wt_max int",
    "box_packs": """id string, domain_id int, batch_id string, class_cd string, cust_order_no string,
        order_no string, box_id string, sub_equip_cd string, box_seq bigint, status string""",
    "pick_events": "event_id string, domain_id int, batch_id string, job_id string, ts timestamp_ntz, qty int",
}


def columns_of(table: str) -> list[str]:
    """Names of the declared columns of a table."""
    return [field.split()[0] for field in SCHEMAS[table].split(",")]
