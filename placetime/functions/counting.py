"""Numbers of points in parts of polygons, for the points and parts of one lattice cell.

Points are laid in blocks of neighbours. Most blocks lie wholly on one side of a side of a polygon, which the
corners of a block tell; only blocks that a side may pass through are tested point by point. Every step
of the side test is monotone in x and y also after rounding, so corners decide exactly as the points would.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

BLOCK = 256
# Values in one work table, at most about.
WORK = 1 << 19


def _blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y as rows of `BLOCK` neighbours and the number of points in each; the last row repeats its last point."""
    n = len(x)
    strips = max(1, round((n / BLOCK) ** 0.5))
    length = -(-n // (strips * BLOCK)) * BLOCK
    strip = np.empty(n, dtype=np.int64)
    strip[np.argsort(x)] = np.arange(n) // length
    order = np.lexsort((y, strip))
    sizes = np.full(-(-n // BLOCK), BLOCK)
    sizes[-1] = n - BLOCK * (len(sizes) - 1)
    order = np.concatenate([order, np.repeat(order[-1:], BLOCK * len(sizes) - n)])
    return x[order].reshape(-1, BLOCK), y[order].reshape(-1, BLOCK), sizes


def _passing(sides: np.ndarray, low: tuple, high: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(does the ray of every point cross, may the points differ or touch) for sides and the corners of blocks."""
    x1, y1, x2, y2 = (sides[:, i, None] for i in range(4))
    (bx0, by0), (bx1, by1) = low, high
    bottom, top = np.minimum(y1, y2), np.maximum(y1, y2)
    at = [(x2 - x1) * (y - y1) / (y2 - y1) + x1 for y in (np.maximum(by0, bottom), np.minimum(by1, top))]
    some = (by1 >= bottom) & (by0 < top) & (bottom < top) & (bx0 < np.maximum(*at))
    every = (by0 >= bottom) & (by1 < top) & (bx1 < np.minimum(*at))
    up, across = ([d * (v - o) for v in ends] for d, o, ends in ((x2 - x1, y1, (by0, by1)), (y2 - y1, x1, (bx0, bx1))))
    touch = (by1 >= bottom) & (by0 <= top) & (bx1 >= np.minimum(x1, x2)) & (bx0 <= np.maximum(x1, x2))
    touch &= (np.maximum(*up) >= np.minimum(*across)) & (np.minimum(*up) <= np.maximum(*across))
    return every, (some & ~every) | touch


def _tested(sides: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tests of `geometry`, crosses and touches, of each side with a row of points."""
    x1, y1, x2, y2 = (sides[:, i, None] for i in range(4))
    crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    on_line = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
    return crosses, on_line & ((x - x1) * (x - x2) <= 0) & ((y - y1) * (y - y2) <= 0)


def count_inside(
    x: np.ndarray, y: np.ndarray, flip: np.ndarray, starts: np.ndarray, sides: np.ndarray, boxes: Sequence[np.ndarray], boundary: bool
) -> np.ndarray:
    """Number of points in each part: `starts` has the place of its first side in `sides` (x1, y1, x2, y2) and a last one
    behind all, `flip` tells if an odd number of sides passes to its right, `boxes` are xmin, xmax, ymin, ymax of its polygon."""
    counts = np.zeros(len(flip), dtype=np.int64)
    known = np.isfinite(x) & np.isfinite(y)
    x, y = x[known], y[known]
    if not len(x):
        return counts
    px, py, sizes = _blocks(x, y)
    rows = max(1, WORK // len(sizes))
    corners = (px.min(1), py.min(1)), (px.max(1), py.max(1))
    first = 0
    with np.errstate(all="ignore"):
        while first < len(flip):
            # As many parts as fit the work table, one at least.
            last = max(first + 1, min(first + rows, int(np.searchsorted(starts, starts[first] + rows, "right")) - 1))
            part = slice(first, last)
            own = starts[first : last + 1] - starts[first]
            box = [b[part] for b in boxes]
            counts[part] = _count(px, py, sizes, corners, flip[part], own, sides[starts[first] : starts[last]], box, boundary, rows)
            first = last
    return counts


def _count(px, py, sizes, corners, flip, starts, sides, boxes, boundary, rows) -> np.ndarray:
    (bx0, by0), (bx1, by1) = corners
    xmin, xmax, ymin, ymax = (b[:, None] for b in boxes)
    inside_box = (bx0 >= xmin) & (bx1 <= xmax) & (by0 >= ymin) & (by1 <= ymax)
    meets_box = (bx1 >= xmin) & (bx0 <= xmax) & (by1 >= ymin) & (by0 <= ymax)
    odd = np.repeat(flip[:, None], len(sizes), axis=1)
    open_ = np.zeros_like(odd)
    of_part = np.repeat(np.arange(len(flip)), np.diff(starts))
    sides_at, blocks_at = [], []
    for at in range(0, len(sides), rows):
        every, differ = _passing(sides[at : at + rows], *corners)
        owner = of_part[at : at + rows]
        np.logical_xor.at(odd, owner, every & ~differ)
        np.logical_or.at(open_, owner, differ)
        side, block = np.nonzero(differ)
        sides_at.append(side + at)
        blocks_at.append(block)
    tested = meets_box & (open_ | (odd & ~inside_box))
    counts = (odd & meets_box & ~tested) @ sizes
    part, block = np.nonzero(tested)
    if not len(part):
        return counts
    # The undecided sides of a part in a block, one run after another.
    pair_of_side = np.zeros(0, dtype=np.int64)
    side = np.zeros(0, dtype=np.int64)
    if sides_at:
        side, of_block = np.concatenate(sides_at), np.concatenate(blocks_at)
        pair_of_side = of_part[side] * len(sizes) + of_block
        order = np.argsort(pair_of_side, kind="stable")
        side, pair_of_side = side[order], pair_of_side[order]
    pair = part * len(sizes) + block
    run, end = np.searchsorted(pair_of_side, pair, "left"), np.searchsorted(pair_of_side, pair, "right")
    place = np.arange(BLOCK)
    step = max(1, WORK // BLOCK)
    for at in range(0, len(pair), step):
        p, b, lo, hi = part[at : at + step], block[at : at + step], run[at : at + step], end[at : at + step]
        x, y = px[b], py[b]
        inside = np.repeat(odd[p, b][:, None], BLOCK, axis=1)
        on_border = np.zeros_like(inside)
        for i in range(int((hi - lo).max())):
            more = np.nonzero(hi - lo > i)[0]
            crosses, touches = _tested(sides[side[lo[more] + i]], x[more], y[more])
            inside[more] ^= crosses
            on_border[more] |= touches
        inside = (inside | on_border) if boundary else (inside & ~on_border)
        inside &= (x >= xmin[p]) & (x <= xmax[p]) & (y >= ymin[p]) & (y <= ymax[p]) & (place < sizes[b][:, None])
        counts += np.bincount(p, inside.sum(1), minlength=len(flip)).astype(np.int64)
    return counts
