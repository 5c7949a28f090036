"""Sequential models of the loop operators, one row at a time, as the reference works."""

from __future__ import annotations

from collections import defaultdict


def greedy(lines, stocks):
    """Literal greedy of one batch on one rack.

    ``lines``: (class, sku, qty) with one row per (class, sku); ``stocks``: {stock_id: [sku, cell, load, on_active_cell]}.
    Returns {(class, sku, stock_id): qty}; ``stocks`` is changed.
    """
    demand = defaultdict(dict)
    for cls, sku, qty in lines:
        demand[cls][sku] = demand[cls].get(sku, 0) + qty

    def total(sku):
        return sum(s[2] for s in stocks.values() if s[0] == sku and s[2] > 0)

    wanted = defaultdict(lambda: [0, 0])
    for cls, sku, qty in lines:
        wanted[sku][0] += qty
        wanted[sku][1] += 1
    listed = []
    for sku, (pcs, count) in wanted.items():
        load = total(sku)
        if load > 0:
            listed.append((1 if pcs <= load else 2 if count >= load else 3, -load, sku))
    waiting = {(cls, sku) for cls in demand for sku in demand[cls]}
    skipped, result = set(), {}
    for _, _, sku in sorted(listed):
        left = total(sku)
        if left < 1:
            continue
        found = sorted((d[sku], cls) for cls, d in demand.items() if (cls, sku) in waiting and cls not in skipped and d[sku] <= left)
        for qty, cls in found:
            if left < qty:
                skipped.add(cls)
                break
            candidates, short = [], 0
            for item in sorted(s for c, s in waiting if c == cls):
                cells = sorted((s[2], s[1], i) for i, s in stocks.items() if s[0] == item and s[2] > 0 and s[3])
                if sum(c[0] for c in cells) < demand[cls][item]:
                    short += 1
                else:
                    candidates.append((item, cells))
            if not candidates:
                continue
            if short:
                skipped.add(cls)
                continue
            for item, cells in candidates:
                rest = demand[cls][item]
                if item == sku:
                    left -= rest
                for load, _, stock_id in cells:
                    if rest <= 0:
                        break
                    take = min(rest, load)
                    stocks[stock_id][2] -= take
                    result[(cls, item, stock_id)] = take
                    rest -= take
                waiting.discard((cls, item))
    return result


def confirm(jobs, events):
    """``jobs``: {id: [pick_qty, picked_qty, status]}; ``events``: (ts, event_id, job, qty). One event after the other."""
    state = {i: {"pick": p, "picked": q, "status": s, "start": None, "end": None} for i, (p, q, s) in jobs.items()}
    for ts, _, job, qty in sorted(events):
        j = state.get(job)
        if j is None or j["status"] != "P" or j["picked"] >= j["pick"]:
            continue
        qty = min(qty, j["pick"] - j["picked"])
        if qty <= 0:
            continue
        j["picked"] += qty
        j["start"] = j["start"] or ts
        if j["picked"] >= j["pick"]:
            j["status"], j["end"] = "F", ts
    return state


def spread(lines, picked):
    """``lines``: (id, order_qty, picked_qty); the picked pieces go to the least picked line first. {id: new picked}"""
    out = {}
    for line, qty, had in sorted(lines, key=lambda r: (r[2], r[0])):
        take = min(qty - had, picked)
        if qty > had and take > 0:
            out[line] = had + take
            picked -= take
    return out


def map_boxes(orders, boxes):
    """``orders``: (type, skus, pieces, order), ``boxes``: (arrived, box, type). Each box takes the best waiting order of its type."""
    waiting, result = set(orders), {}
    for _, box, kind in sorted(boxes):
        fitting = sorted(o for o in waiting if o[0] == kind)
        if fitting:
            waiting.discard(fitting[0])
            result[box] = fitting[0][3]
    return result
