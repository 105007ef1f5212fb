"""Land of candidate layouts on arrays, many layouts at a time: roads, free rectangles, zones, blocks of plots and their totals.

Lists of boxes of many layouts are one table, ``Boxes``: the layout's number, ascending, and the corners as four rows of numbers. A null
is nan here: comparisons with it fail, and ``fmax`` and ``fmin`` pass it over, as ``greatest`` and ``least`` do in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SIDES = ("x0", "y0", "x1", "y1")
#: Pairs of a block and another box, and a quarter as many roads, that are worked on at a time: bounds a task's memory whatever the
#: parcels are, and what fits the processor's cache is faster.
CELLS = 1 << 16


class Boxes(NamedTuple):
    row: np.ndarray
    at: np.ndarray

    def take(self, which: np.ndarray) -> Boxes:
        which = np.flatnonzero(which) if which.dtype == bool else which
        return Boxes(self.row[which], self.at.take(which, axis=1))


def area(b: np.ndarray) -> np.ndarray:
    return (b[2] - b[0]) * (b[3] - b[1])


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The box two boxes share; turned inside out where they share none."""
    return np.stack([np.fmax(a[0], b[0]), np.fmax(a[1], b[1]), np.fmin(a[2], b[2]), np.fmin(a[3], b[3])])


def real(b: np.ndarray) -> np.ndarray:
    return (b[2] > b[0]) & (b[3] > b[1])


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = common(a, b)
    return np.where(real(both), area(both), 0.0)


def runs(sizes: np.ndarray, most: int = CELLS) -> Iterator[slice]:
    """Neighbours whose sizes add up to about ``most``; a larger one stands nearly alone."""
    part = np.cumsum(sizes) // most
    ends = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [True]])) + 1 if len(part) else []
    for begin, end in zip([0, *ends], ends):
        yield slice(int(begin), int(end))


def cut_out(free: Boxes, taken: np.ndarray) -> Boxes:
    """``free`` without the ground of the box ``taken`` from each: below, above, left and right of it."""
    r, t = free.at, taken
    lo, hi = np.fmax(r[1], t[1]), np.fmin(r[3], t[3])
    meets = real(common(r, t))
    parts = np.stack([np.stack([r[0], r[1], r[2], t[1]]), np.stack([r[0], t[3], r[2], r[3]]), np.stack([r[0], lo, t[0], hi]), np.stack([t[2], lo, r[2], hi])], axis=-1)
    keep = real(parts) & meets[:, None]
    parts[:, :, 0] = np.where(meets, parts[:, :, 0], r)
    keep[:, 0] |= ~meets
    return Boxes(np.repeat(free.row, keep.sum(axis=1)), parts[:, keep])


def cut_all(free: Boxes, taken: Boxes, rows: int) -> Boxes:
    """``free`` without the boxes of ``taken``, one after the other; a layout is left alone when its own have been cut."""
    sizes = np.bincount(taken.row, minlength=rows)
    begin, done = np.cumsum(sizes) - sizes, []
    for k in range(int(sizes.max(initial=0)) + 1):
        more = sizes[free.row] > k
        done.append(free.take(~more))
        free = free.take(more)
        free = cut_out(free, taken.at.take(begin[free.row] + k, axis=1))
    row, at = np.concatenate([d.row for d in done]), np.concatenate([d.at for d in done], axis=1)
    order = np.argsort(row, kind="stable")
    return Boxes(row[order], at[:, order])


def place(target: np.ndarray, domain: np.ndarray, free: Boxes, tried: Callable, share: float, sqft: float, side: float) -> tuple[np.ndarray, np.ndarray]:
    """First tried box whose largest part in ``free`` has ``share`` of the target: that part, nan if none has, and its try's number.

    ``tried(k, rows)`` gives which of the rows have a k-th try, whether it lies east, north or in the center, and its two scales; None
    ends. Of equal parts the one to the left, then the lower one counts.
    """
    dw, dh = np.fmax(1.0, domain[2] - domain[0]), np.fmax(1.0, domain[3] - domain[1])
    w = np.fmax(side, np.sqrt(target) * 1.12)
    h, need = np.fmax(side, target / w), np.fmax(target * share, sqft)
    found, number, open_rows, k = np.full((4, len(target)), np.nan), np.full(len(target), -1), np.flatnonzero(~np.isnan(target)), 0
    while len(open_rows) and (spot := tried(k, open_rows)) is not None:
        has, east, north, center, sw, sh = spot
        p = open_rows[has]
        cw, ch, d = np.fmin(dw[p] * 0.85, w[p] * sw), np.fmin(dh[p] * 0.85, h[p] * sh), domain[:, p]
        x0 = np.where(east, d[2] - cw, np.where(center, (d[0] + d[2]) / 2.0 - cw / 2.0, d[0]))
        y0 = np.where(north, d[3] - ch, np.where(center, (d[1] + d[3]) / 2.0 - ch / 2.0, d[1]))
        slot = np.full(len(target), -1)
        slot[p] = np.arange(len(p))
        free = free.take(slot[free.row] >= 0)
        both = common(free.at, np.stack([x0, y0, x0 + cw, y0 + ch]).take(slot[free.row], axis=1))
        size = np.floor(area(both) * 10000.0 + 0.5) / 10000.0
        good = np.flatnonzero(real(both) & (size >= need[free.row]))
        row, both, size = free.row[good], both[:, good], size[good]
        order = np.lexsort((both[1], both[0], -size, row))
        row, both = row[order], both[:, order]
        best = np.concatenate([[True], row[1:] != row[:-1]])[: len(row)]
        found[:, row[best]], number[row[best]] = both[:, best], k
        open_rows, k = p[number[p] < 0], k + 1
    return found, number


def blocks(free: Boxes, rows: dict[str, np.ndarray], max_w: float, min_d: float) -> dict[str, np.ndarray]:
    """Free rectangles as blocks of equal plots: row (the layout's), SIDES, n_rows, n_cols, plot_d, second_y, plot_w.

    One or two rows of plots; columns under 70 % of the least area merge into one plot; blocks, strips and plots that are too small or
    too slim are left out. Large parcels get larger plots.
    """
    least, gross, wish = rows["min_plot_sqft"], rows["gross_sqft"], rows["target_plot_sqft"]
    target = np.where((gross > 120000) & (wish < 1800), np.fmax(wish, np.fmin(2800.0, gross / 75.0)), wish)
    tw = np.fmax(rows["min_frontage_ft"] * rows["plot_w_mult"], np.fmin(max_w, np.sqrt(target * 0.65)))
    td = np.fmax(min_d, target / tw)
    b = free.take(area(free.at) >= (least * 0.55)[free.row])
    w, h, tw, td = b.at[2] - b.at[0], b.at[3] - b.at[1], tw[b.row], td[b.row]
    n_rows = np.where(h <= td * 1.6, 1.0, np.fmin(2.0, np.fmax(1.0, np.rint(h / td))))
    cols = np.fmax(1.0, np.rint(w / tw))
    plot_d = np.where(h > td * 2.3, np.fmin(td * 1.15, h / n_rows), h / n_rows)
    n_cols = np.where(w / cols * plot_d < (least * 0.70)[b.row], 1.0, cols)
    plot_w = w / n_cols
    slim = np.fmax(1.0, plot_w) / np.fmax(1.0, plot_d)
    half = (least * 0.50)[b.row]
    kept = (w * plot_d >= half) & (plot_w * plot_d >= half) & (slim >= 0.10) & (slim <= 9.0)
    b = b.take(kept)
    n_rows, n_cols, plot_d, plot_w = n_rows[kept], n_cols[kept], plot_d[kept], plot_w[kept]
    return {
        "row": b.row, **dict(zip(SIDES, b.at)), "n_rows": n_rows.astype(np.int32), "n_cols": n_cols.astype(np.int32), "plot_d": plot_d,
        "second_y": np.fmax(b.at[1] + plot_d, b.at[3] - plot_d), "plot_w": plot_w,
    }


def total(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Sums per layout; exact for whole numbers."""
    return np.bincount(row, values, rows)


def exact(values: np.ndarray) -> np.ndarray:
    """In millionths, so that sums do not depend on an order."""
    return np.floor(np.abs(values) * 1e6 + 0.5) * np.sign(values)


def shared_with(at: np.ndarray, row: np.ndarray, others: Boxes, rows: int) -> np.ndarray:
    """Ground each box has in common with the ``others`` of its layout, added up in their order."""
    sizes = np.bincount(others.row, minlength=rows)
    begin, n, out = np.cumsum(sizes) - sizes, sizes[row], np.zeros(len(row))
    for part in runs(n):
        own = np.repeat(np.arange(part.start, part.stop), n[part])
        if len(own):
            first = np.cumsum(n[part]) - n[part]
            other = begin[row[own]] + np.arange(len(own)) - first[own - part.start]
            out[part] = np.bincount(own - part.start, shared(at.take(own, axis=1), others.at.take(other, axis=1)), part.stop - part.start)
    return out


# ---- to and from Arrow


def numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(float)


def fields(values: pa.Array, names: list[str]) -> list[np.ndarray]:
    """Number fields of a struct."""
    flat = dict(zip([f.name for f in values.type], values.flatten()))
    return [numbers(flat[n]) for n in names]


def boxes_of(lists: pa.Array) -> Boxes:
    """Boxes of a list column."""
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return Boxes(np.repeat(np.arange(len(n)), n), np.array(fields(lists.flatten(), list(SIDES))).reshape(4, -1))


def column(values: np.ndarray) -> pa.Array:
    return pa.array(values, from_pandas=True)


def struct(**parts: np.ndarray | pa.Array) -> pa.StructArray:
    arrays = [v if isinstance(v, pa.Array) else column(v) for v in parts.values()]
    return pa.StructArray.from_arrays(arrays, names=list(parts))


def listed(row: np.ndarray, items: pa.Array, rows: int) -> pa.ListArray:
    """A list per layout of the items, which are ordered by layout."""
    ends = np.cumsum(np.bincount(row, minlength=rows))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), items)
