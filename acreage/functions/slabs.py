"""Areas of small sets of polygons, many sets at a time: the plane sweep of ``operators.overlay`` on arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Array cells worked on at a time; bounds a task's memory whatever the sets hold.
CELLS = 1 << 21
PARTS = ("l", "r", "ly", "ry", "wa", "wb")
AREAS = ("union_area", "a_area", "b_area", "both_area", "a_only_area")
#: With a third side C: what A and C share off B.
CLEAR_PARTS, CLEAR = (*PARTS, "wc"), ("clear_area",)


def _cuts(l, r, ly, ry):  # noqa: E741
    """Sorted x of all span ends and crossings, a row per set; the rest of a row is nan."""
    span = r > l
    slope = np.where(span, (ry - ly) / np.where(span, r - l, 1.0), 0.0)
    i, j = np.triu_indices(l.shape[1], 1)
    turn = slope[:, i] - slope[:, j]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (ly[:, j] - slope[:, j] * l[:, j] - ly[:, i] + slope[:, i] * l[:, i]) / turn
        crossing = (x > np.maximum(l[:, i], l[:, j])) & (x < np.minimum(r[:, i], r[:, j])) & (turn != 0)
    x = np.sort(np.where(crossing, x, np.nan), axis=1)
    most = int(crossing.sum(axis=1).max(initial=0))
    cuts = np.sort(np.concatenate([np.where(span, l, np.nan), np.where(span, r, np.nan), x[:, :most]], axis=1), axis=1)
    cuts[:, 1:][cuts[:, 1:] == cuts[:, :-1]] = np.nan
    cuts = np.sort(cuts, axis=1)
    return cuts[:, : int((~np.isnan(cuts)).sum(axis=1).max(initial=0))]


def slab_areas(l, r, ly, ry, wa, wb, wc=None):  # noqa: E741
    """AREAS, with ``wc`` CLEAR, of sets of spans, a row per set, filled up with spans of no width."""
    ox, oy = np.where(r > l, l, np.inf).min(axis=1, initial=np.inf), np.where(r > l, ly, np.inf).min(axis=1, initial=np.inf)
    ox, oy = np.where(np.isfinite(ox), ox, 0.0)[:, None], np.where(np.isfinite(oy), oy, 0.0)[:, None]
    l, r, ly, ry = l - ox, r - ox, ly - oy, ry - oy  # noqa: E741
    cuts = _cuts(l, r, ly, ry)
    out = np.zeros((len(l), len(AREAS if wc is None else CLEAR)))
    step = max(1, CELLS // max(1, l.size))
    for at in range(0, cuts.shape[1] - 1, step):
        x = cuts[:, at : at + step + 1]
        left, right = x[:, :-1, None], x[:, 1:, None]
        here = (l[:, None] <= left) & (r[:, None] >= right) & (r > l)[:, None]
        row, slab, span = np.nonzero(here)
        if not len(row):
            continue
        x0, x1 = x[row, slab], x[row, slab + 1]
        y = ly[row, span] + (ry - ly)[row, span] * ((x0 + x1) / 2.0 - l[row, span]) / (r - l)[row, span]
        place = row * x.shape[1] + slab
        order = np.lexsort((y, place))
        row, span, place, y, width = row[order], span[order], place[order], y[order], (x1 - x0)[order]
        same = place[1:] == place[:-1]
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(place)), 0))

        def wound(w: np.ndarray) -> np.ndarray:
            # going up, a span with sign -1 is a lower rim: it adds one to the winding number
            step = w[row, span]
            total = np.cumsum(step)
            return -(total - (total - step)[start])[:-1] > 0.5

        a, b, area = wound(wa), wound(wb), np.where(same, (y[1:] - y[:-1]) * width[:-1], 0.0)
        for k, cond in enumerate((a | b, a, b, a & b, a & ~b) if wc is None else (a & ~b & wound(wc),)):
            out[:, k] += np.bincount(row[:-1], np.where(cond, area, 0.0), len(out))
    return out


def sweep_batch(keys: list[str], batch: pa.RecordBatch, parts: tuple[str, ...] = PARTS, areas: tuple[str, ...] = AREAS) -> pa.RecordBatch:
    """Rows (keys, spans) to rows (keys, areas), sets of about one size together."""
    spans = batch.column(batch.schema.get_field_index("spans"))
    sizes = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = spans.flatten()
    parts = [flat.field(flat.type.get_field_index(p)).to_numpy(zero_copy_only=False).astype(float) for p in parts]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    out, order, at = np.zeros((len(sizes), len(areas))), np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        take = max(1, CELLS // 8 // max(1, int(sizes[order[at]]) ** 2))
        rows = order[at : at + take]
        rows = rows[sizes[rows] <= max(8, 2 * int(sizes[rows[0]]))]
        n = int(sizes[rows].max())
        slot = np.arange(n)[None, :]
        given = slot < sizes[rows][:, None]
        index = np.where(given, begin[rows][:, None] + slot, 0)
        if n:
            out[rows] = slab_areas(*[np.where(given, p[index], 0.0) for p in parts])
        at += len(rows)
    kept = [batch.column(batch.schema.get_field_index(k)) for k in keys]
    return pa.RecordBatch.from_arrays([*kept, *[pa.array(out[:, k]) for k in range(len(areas))]], names=[*keys, *areas])
