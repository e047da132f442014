"""What covers the nodes of a cell: how many nodes paint above each, and how much of it they hide.

A cell's boxes are measured together, so pairs are neither listed nor stored.
Their edges make a grid. Boxes are painted on it from the lowest to the highest,
so that each place has the highest that covers it, and the hidden part of a node
is what has a higher one: a difference of four running sums. Boxes that a node
meets are counted the same way, by where they begin and end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Places of a grid; a finer grid is taken apart into tiles.
MOST_PLACES = 1 << 20
#: Pairs that are compared at once.
MOST_PAIRS = 1 << 20

FOUND = "id string, covered double, n long, own long"


def codes(z: np.ndarray, tier: np.ndarray) -> np.ndarray:
    """Places of (z, tier) in their order; equal ones share one, and NaN is the greatest z."""
    order = np.lexsort((tier, z))
    zs, ts = z[order], tier[order]
    same = (zs[1:] == zs[:-1]) | (np.isnan(zs[1:]) & np.isnan(zs[:-1]))
    out = np.empty(len(z), np.int64)
    out[order] = np.cumsum(np.r_[0, ~(same & (ts[1:] == ts[:-1]))][: len(z)])
    return out


def _sums(grid: np.ndarray) -> np.ndarray:
    """Sums of all rectangles that begin where the grid does."""
    out = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), grid.dtype)
    np.cumsum(np.cumsum(grid, 0), 1, out=out[1:, 1:])
    return out


def _painted(top: np.ndarray, places: np.ndarray, low: np.ndarray, low_code: np.ndarray) -> np.ndarray:
    """The hidden area of each ``low`` (x0, y0, x1, y1, places of the grid)."""
    out = np.zeros(len(low))
    for code in np.unique(low_code):
        at = np.flatnonzero(low_code == code)
        if len(at) < 4:
            for i in at:
                x0, y0, x1, y1 = low[i]
                out[i] = places[y0:y1, x0:x1][top[y0:y1, x0:x1] > code].sum()
            continue
        s, (x0, y0, x1, y1) = _sums(np.where(top > code, places, 0.0)), low[at].T
        out[at] = s[y1, x1] - s[y0, x1] - s[y1, x0] + s[y0, x0]
    return out


def hidden(xs: np.ndarray, ys: np.ndarray, low: np.ndarray, low_code: np.ndarray, high: np.ndarray, high_code: np.ndarray, most: int = MOST_PLACES) -> np.ndarray:
    """The area of each ``low`` under the union of the ``high`` of greater codes; boxes are (x0, y0, x1, y1), indices into ``xs`` and ``ys``."""
    out = np.zeros(len(low))
    rising = np.argsort(high_code, kind="stable")
    high, high_code = high[rising], high_code[rising]
    side = max(1, int(most**0.5))
    whole = (len(xs) - 1) * (len(ys) - 1) <= most
    step_x, step_y = (max(1, len(xs) - 1), max(1, len(ys) - 1)) if whole else (side, side)
    for tx in range(0, len(xs) - 1, step_x):
        for ty in range(0, len(ys) - 1, step_y):
            wide, tall = min(step_x, len(xs) - 1 - tx), min(step_y, len(ys) - 1 - ty)
            inside = lambda b: np.clip(b - [tx, ty, tx, ty], 0, [wide, tall, wide, tall])  # noqa: B023, E731
            h, a = inside(high), inside(low)
            at = np.flatnonzero((a[:, 0] < a[:, 2]) & (a[:, 1] < a[:, 3]))
            there = (h[:, 0] < h[:, 2]) & (h[:, 1] < h[:, 3])
            if not len(at) or not there.any():
                continue
            top = np.full((tall, wide), -1, np.int64)
            for (x0, y0, x1, y1), code in zip(h[there].tolist(), high_code[there].tolist(), strict=True):
                top[y0:y1, x0:x1] = code
            places = np.outer(np.diff(ys[ty : ty + tall + 1]), np.diff(xs[tx : tx + wide + 1]))
            out[at] += _painted(top, places, a[at], low_code[at])
    return out


def met(low: np.ndarray, low_code: np.ndarray, high: np.ndarray, high_code: np.ndarray, wide: int, tall: int, most: int = MOST_PLACES) -> np.ndarray:
    """How many ``high`` of greater codes each ``low`` overlaps."""
    out = np.zeros(len(low), np.int64)
    found = np.unique(low_code)
    if wide * tall <= most and len(found) * wide * tall * 8 <= max(len(low) * len(high), 1 << 18):
        for code in found:
            at, up = np.flatnonzero(low_code == code), high[high_code > code]
            x0, y0, x1, y1 = low[at].T
            # a box is met in a direction if it begins before the end and does not end before the beginning
            count = lambda i, j: _sums(np.bincount(up[:, j] * wide + up[:, i], minlength=wide * tall).reshape(tall, wide))  # noqa: B023, E731
            out[at] = count(0, 1)[y1, x1] - count(2, 1)[y1, x0 + 1] - count(0, 3)[y0 + 1, x1] + count(2, 3)[y0 + 1, x0 + 1]
        return out
    some = max(1, MOST_PAIRS // max(1, len(high)))
    for i in range(0, len(low), some):
        a, part = low[i : i + some, :, None], slice(i, i + some)
        both = (high[:, 0] < a[:, 2]) & (high[:, 2] > a[:, 0]) & (high[:, 1] < a[:, 3]) & (high[:, 3] > a[:, 1])
        out[part] = (both & (high_code > low_code[part, None])).sum(1)
    return out


def cell(bounds: tuple, view: np.ndarray, clip: np.ndarray, code: np.ndarray, occludes: np.ndarray, pre: np.ndarray, last: np.ndarray, ids: np.ndarray):
    """(covered, n, own) of the nodes of a cell: hidden area in it, nodes above that it meets where both begin in it, and whether it begins here.

    ``view`` and ``clip``: (x0, y0, x1, y1) of what a node covers and of what can
    be covered, the latter NaN for none. Nodes with ``pre`` from a node's own to
    its ``last`` do not cover it, nor do those of its id.
    """
    low_x, low_y, end_x, end_y = bounds
    # clipped to the cell; what only touches it is not in it
    frame = lambda b: np.clip(b, [low_x, low_y, low_x, low_y], [end_x, end_y, end_x, end_y])
    extended = lambda b: (b[:, 0] < b[:, 2]) & (b[:, 1] < b[:, 3])
    v, c = frame(view), frame(clip)
    covered, n = np.zeros(len(code)), np.zeros(len(code), np.int64)
    is_low = extended(c) & extended(clip)
    begins = lambda b: ((b[:, 0] >= low_x) & (b[:, 0] < end_x)) + 2 * ((b[:, 1] >= low_y) & (b[:, 1] < end_y))
    low_from, high_from = begins(clip), begins(view)
    own = (extended(clip) & (low_from == 3)).astype(np.int64)
    lows, highs = np.flatnonzero(is_low), np.flatnonzero(occludes & extended(v) & extended(view))
    if not len(lows) or not len(highs):
        return covered, n, own
    xs, ys = (np.unique(np.r_[c[lows, k], c[lows, k + 2], v[highs, k], v[highs, k + 2]]) for k in (0, 1))
    placed = lambda b: np.stack([np.searchsorted(xs if k % 2 == 0 else ys, b[:, k]) for k in range(4)], 1)
    a, b = placed(c[lows]), placed(v[highs])
    covered[lows] = hidden(xs, ys, a, code[lows], b, code[highs])
    for kind in range(4):
        at = np.flatnonzero(low_from[lows] == kind)
        up = (high_from[highs] | kind) == 3
        if len(at) and up.any():
            n[lows[at]] = met(a[at], code[lows[at]], b[up], code[highs[up]], len(xs), len(ys))
    # nodes above which their own subtree, or one of the same id, paints are measured by themselves
    for i in np.flatnonzero(_exempt(lows, highs, code, pre, last, ids)):
        k = lows[i]
        kin = ((pre[highs] >= pre[k]) & (pre[highs] <= last[k])) | (ids[highs] == ids[k])
        over = (code[highs] > code[k]) & ~kin & (b[:, 0] < a[i, 2]) & (b[:, 2] > a[i, 0]) & (b[:, 1] < a[i, 3]) & (b[:, 3] > a[i, 1])
        n[k] = (over & ((high_from[highs] | low_from[k]) == 3)).sum()
        covered[k] = hidden(xs, ys, a[i : i + 1], code[[k]], b[over], code[highs[over]])[0] if over.any() else 0.0
    return covered, n, own


def _exempt(lows: np.ndarray, highs: np.ndarray, code: np.ndarray, pre: np.ndarray, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which nodes have one of their subtree, or of their id, above them."""
    best = np.full(ids.max() + 1, -1, np.int64)
    np.maximum.at(best, ids[highs], code[highs])
    out = best[ids[lows]] > code[lows]
    family = highs[pre[highs] >= 0]
    family = family[np.argsort(pre[family], kind="stable")]
    order = pre[family]
    for i in np.flatnonzero(last[lows] > pre[lows]):
        k = lows[i]
        kin = family[np.searchsorted(order, pre[k]) : np.searchsorted(order, last[k], "right")]
        out[i] |= len(kin) > 0 and code[kin].max() > code[k]
    return out


def measured(key: tuple, rows: pa.Table, side: int, steps: int, bits: int, limit: int) -> pa.Table:
    """:func:`cell` of the rows of one cell of :mod:`quadtree`."""
    level, x, y = (k.as_py() for k in key[1:])
    shift, edge = bits * (steps - level), limit // side

    def ends(q: int) -> tuple[float, float]:
        # coordinates beyond the limit share the outermost cells
        first, after = q << shift, (q + 1) << shift
        return -np.inf if first <= -edge else float(first * side), np.inf if after > edge else float(after * side)

    (x0, x1), (y0, y1) = ends(x), ends(y)
    of = lambda name, none: rows.column(name).combine_chunks().fill_null(none).to_numpy(zero_copy_only=False)
    boxes = lambda p: np.stack([of(f"{p}_{k}", np.nan) for k in ("x0", "y0", "x1", "y1")], 1)
    ids = rows.column("id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    found = cell((x0, y0, x1, y1), boxes("b"), boxes("a"), codes(of("z", 0.0), of("tier", 0)), of("occludes", False).astype(bool), of("pre", -1), of("last", -2), ids)
    keep = np.flatnonzero((found[2] > 0) | (found[0] > 0) | (found[1] > 0))
    columns = [rows.column("id").combine_chunks().take(pa.array(keep)), *[pa.array(f[keep]) for f in found]]
    return pa.Table.from_arrays(columns, names=["id", "covered", "n", "own"])
