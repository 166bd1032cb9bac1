"""Nearest points and Voronoi cells of points of the plane, many at once, for the tasks of `graph` and `delaunay`."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np

#: Points of a leaf of the search, and numbers in one matrix of distances at most.
LEAF, CELLS = 192, 1 << 21
_EPS = 1e-11


def _first(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rank from 0) of the k least of each row of distances, ties to the lower id; infinite ones are none."""
    k = min(k, d.shape[1])
    if not k or not len(d):
        return (np.zeros(0, np.int64),) * 3
    bound = np.partition(d, k - 1, 1)[:, k - 1]
    row, col = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
    by = np.lexsort((ids[col], d[row, col], row))
    row, col = row[by], col[by]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    keep = rank < k
    return row[keep], col[keep], rank[keep]


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, asked: np.ndarray | None = None, others: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, place of a neighbour, distance, rank from 0): the k nearest others of each point, or of those asked.

    others: (x, y, ids) of the points searched, if these are further ones. Points are dealt to leaves of about LEAF by
    quantiles of x and then y, so that outliers make no leaf large; a leaf's points search the leaves that can hold
    something nearer than what their own has.
    """
    ox, oy, oids = others or (x, y, ids)
    at = np.arange(len(x)) if asked is None else np.flatnonzero(asked)
    n = len(ox)
    if not n or not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    out: list[tuple[np.ndarray, ...]] = []

    def search(own: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Distances of the points `own` to the points `seen`; none to a point of the same id."""
        dx, dy = x[own][:, None] - ox[seen][None, :], y[own][:, None] - oy[seen][None, :]
        d = np.sqrt(dx * dx + dy * dy)
        d[ids[own][:, None] == oids[seen][None, :]] = np.inf
        return d

    def keep(own: np.ndarray, seen: np.ndarray) -> None:
        for i in range(0, len(own), step := max(1, CELLS // len(seen))):
            d = search(own[i : i + step], seen)
            row, col, rank = _first(d, oids[seen], k)
            out.append((own[i : i + step][row], seen[col], d[row, col], rank))

    if n <= 4 * LEAF:
        keep(at, np.arange(n))
    else:
        across = max(1, round((n / LEAF) ** 0.5))
        strip = np.empty(n, np.int64)
        strip[np.argsort(ox, kind="stable")] = np.arange(n) * across // n
        order = np.lexsort((oy, strip))
        size = np.bincount(strip, minlength=across)
        leaf = strip[order] * across + (np.arange(n) - np.repeat(np.cumsum(size) - size, size)) * across // np.repeat(size, size)
        begin = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        end = np.append(begin[1:], n)
        box = [f.reduceat(v[order], begin) for v in (ox, oy) for f in (np.minimum, np.maximum)]
        gap = lambda x0, x1, y0, y1: np.hypot(np.maximum(0, np.maximum(box[0] - x1, x0 - box[1])), np.maximum(0, np.maximum(box[2] - y1, y0 - box[3])))
        if others is None:
            wanted = np.zeros(n, bool)
            wanted[at] = True
            groups = [order[a:z][wanted[order[a:z]]] for a, z in zip(begin, end, strict=True)]
        else:  # each asked point goes with the leaf nearest to it
            near = np.concatenate([np.argmin(np.hypot(np.maximum(0, np.maximum(box[0][None, :] - x[p][:, None], x[p][:, None] - box[1][None, :])), np.maximum(0, np.maximum(box[2][None, :] - y[p][:, None], y[p][:, None] - box[3][None, :]))), 1) for p in np.array_split(at, max(1, len(at) * len(begin) // CELLS))])
            groups = [at[near == i] for i in range(len(begin))]
        for i, own in enumerate(groups):
            if not len(own):
                continue
            mine = order[begin[i] : end[i]]
            d = search(own, mine)
            reach = np.partition(d, k - 1, 1)[:, k - 1].max() if k <= d.shape[1] else np.inf
            some = np.flatnonzero(gap(x[own].min(), x[own].max(), y[own].min(), y[own].max()) <= reach) if np.isfinite(reach) else np.arange(len(begin))
            keep(own, np.concatenate([order[begin[j] : end[j]] for j in some]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Cells:
    """Voronoi cells of some points, cut by one bisector each at a time.

    Coordinates are relative to each cell's point. A corner is (x, y, w), at infinity where w is 0; a border belongs to
    the half-plane (a, b, c) with a x + b y + c w <= 0 that made it, and is known by that neighbour's number (below 0:
    at infinity). Corners are where two borders' lines meet, so that errors don't add up.
    """

    def __init__(self, n: int):
        far = np.array([[1, -1, 0], [1, 1, 0], [-1, 1, 0], [-1, -1, 0]], float)
        self.corners = np.tile(far, (n, 1, 1))
        self.lines = np.tile(np.array([0, 0, -1.0]), (n, 4, 1))
        self.owners = np.full((n, 4), -1, np.int64)
        self.sizes = np.full(n, 4)

    def _valid(self, at: np.ndarray) -> np.ndarray:
        return np.arange(self.corners.shape[1])[None, :] < self.sizes[at][:, None]

    def reach(self, at: np.ndarray) -> np.ndarray:
        """The distance of the farthest corner of the cells `at`."""
        v = self.corners[at]
        far = np.where(v[:, :, 2] > 0, np.hypot(v[:, :, 0], v[:, :, 1]), np.inf)
        return np.where(self._valid(at), far, 0).max(1)

    def cut(self, at: np.ndarray, dx: np.ndarray, dy: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Cuts the cells `at` by their bisectors to the points (dx, dy) from their own; returns those that changed."""
        live = (dx != 0) | (dy != 0)
        at, dx, dy, owner = at[live], dx[live], dy[live], owner[live]
        h = np.stack([dx, dy, -(dx * dx + dy * dy) / 2], 1)
        v = self.corners[at]
        valid = self._valid(at)
        side = np.where(valid, np.einsum("ijk,ik->ij", v, h), -np.inf)
        length = np.sqrt(-2 * h[:, 2])
        scale = _EPS * (np.hypot(v[:, :, 0], v[:, :, 1]) * length[:, None] + v[:, :, 2] * (length * length)[:, None])
        outside = valid & (side > scale)
        touching = valid & ~outside & (side >= -scale) & (v[:, :, 2] > 0)
        lone = ~outside.any(1) & (touching.sum(1) == 1)  # a border of no length, for the exact test to judge
        outside[lone] = touching[lone]
        some = np.flatnonzero(outside.any(1) & (valid & ~outside).any(1))
        if not len(some):
            return at[:0]
        at, h, owner, outside, valid = at[some], h[some], owner[some], outside[some], valid[some]
        size = self.sizes[at]
        width = outside.shape[1]
        slots = np.arange(width)[None, :]
        before = np.take_along_axis(outside, np.where(slots == 0, size[:, None] - 1, slots - 1), 1)
        first = (valid & ~outside & before).argmax(1)  # where the part that stays begins
        turn = (first[:, None] + slots) % size[:, None]
        row = np.arange(len(at))[:, None]
        corners, lines, owners = self.corners[at][row, turn], self.lines[at][row, turn], self.owners[at][row, turn]
        kept = (valid & ~outside).sum(1)
        if int(kept.max()) + 2 > width:
            more = int(kept.max()) + 2 - width
            self.corners, self.lines = (np.pad(x, ((0, 0), (0, more), (0, 0))) for x in (self.corners, self.lines))
            self.owners = np.pad(self.owners, ((0, 0), (0, more)))
            corners, lines = (np.pad(x, ((0, 0), (0, more), (0, 0))) for x in (corners, lines))
            owners = np.pad(owners, ((0, 0), (0, more)))
        i = np.arange(len(at))
        leaving, coming = lines[i, kept - 1], lines[i, size - 1]
        into = owners[i, size - 1]
        for k, (a, b) in enumerate(((leaving, h), (h, coming))):
            p = np.cross(a, b)
            w = p[:, 2]
            flat = w <= 1e-14 * np.hypot(a[:, 0], a[:, 1]) * np.hypot(b[:, 0], b[:, 1])  # parallel: they meet at infinity
            p[~flat] /= w[~flat][:, None]
            p[flat, 2] = 0
            norm = np.hypot(p[flat, 0], p[flat, 1])
            p[flat] /= np.where(norm > 0, norm, 1)[:, None]
            corners[i, kept + k] = p
        lines[i, kept], owners[i, kept] = h, owner
        lines[i, kept + 1], owners[i, kept + 1] = coming, into
        self.corners[at], self.lines[at], self.owners[at], self.sizes[at] = corners, lines, owners, kept + 2
        return at

    def violated(self, at: int, dx: np.ndarray, dy: np.ndarray, least: float = 0.0) -> np.ndarray:
        """Which of the points (dx, dy) from a cell's own, all at `least` from it or farther, cut it."""
        v = self.corners[at, : self.sizes[at]]
        v = v[(v[:, 2] == 0) | (2 * np.hypot(v[:, 0], v[:, 1]) >= least * (1 - 1e-6))]  # a corner's points are nearer than twice its distance
        if not len(v):
            return np.zeros(len(dx), bool)
        square = dx * dx + dy * dy
        side = v[:, :1] * dx + v[:, 1:2] * dy - v[:, 2:] * square / 2
        scale = 4 * _EPS * (np.hypot(v[:, :1], v[:, 1:2]) * np.sqrt(square) + v[:, 2:] * square)
        return (side > scale).any(0) & (square > 0)

    def borders(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, neighbour, certain) for each border of every cell, in order; a very short border isn't certain."""
        valid = self._valid(np.arange(len(self.sizes)))
        cell, i = np.nonzero(valid & (self.owners >= 0))
        a, b = self.corners[cell, i], self.corners[cell, (i + 1) % self.sizes[cell]]
        apart = np.hypot(a[:, 0] - b[:, 0], a[:, 1] - b[:, 1]) > 1e-7 * np.where((a[:, 2] > 0) & (b[:, 2] > 0), np.hypot(a[:, 0], a[:, 1]) + np.hypot(b[:, 0], b[:, 1]), 1)
        return cell, self.owners[cell, i], apart | ((a[:, 2] > 0) != (b[:, 2] > 0))


def in_circle(a: tuple[float, float], b: tuple[float, float], c: tuple[float, float], p: tuple[float, float]) -> int:
    """1, 0 or -1: p lies inside, on or outside the circle through a, b and c, exactly."""
    m = [[Fraction(q[0]) - Fraction(p[0]), Fraction(q[1]) - Fraction(p[1])] for q in (a, b, c)]
    s = [x * x + y * y for x, y in m]
    det = m[0][0] * (m[1][1] * s[2] - s[1] * m[2][1]) - m[0][1] * (m[1][0] * s[2] - s[1] * m[2][0]) + s[0] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    turn = (m[1][0] - m[0][0]) * (m[2][1] - m[0][1]) - (m[1][1] - m[0][1]) * (m[2][0] - m[0][0])
    sign = (det > 0) - (det < 0)
    return sign if turn > 0 else -sign


def neighbours(cells: Cells, place: Callable[[int, int], tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, neighbour) of finished cells. Short borders are judged exactly: the neighbour must lie strictly inside the
    circle through the cell's point and the next certain neighbours on both sides. place gives the coordinates of a
    cell's neighbour, and with -1 those of its own point."""
    cell, other, sure = cells.borders()
    keep = sure.copy()
    for i in np.flatnonzero(~sure).tolist():
        own = np.arange(*np.searchsorted(cell, [cell[i], cell[i] + 1]))
        own = own[sure[own]]
        if len(own) > 1:
            left, right = (int(other[j]) for j in (own[own < i][-1] if (own < i).any() else own[-1], own[own > i][0] if (own > i).any() else own[0]))
            at = int(cell[i])
            keep[i] = left != right and in_circle(place(at, -1), place(at, left), place(at, right), place(at, int(other[i]))) > 0
    return cell[keep], other[keep]


def delaunay(x: np.ndarray, y: np.ndarray, k: int = 16, own: np.ndarray | None = None) -> np.ndarray:
    """Pairs of places, the lower first, whose Voronoi cells share a border of positive length; own: whose cells to look at.

    Cells are cut by their k nearest points, those that this may leave open by eight times as many, and the outer ones
    by the nearest point of all that still cuts them, again and again. Only the cells that are looked at take memory.
    """
    n = len(x)
    mine = np.arange(n) if own is None else np.flatnonzero(own)
    m, row = len(mine), np.full(n, -1)
    row[mine] = np.arange(m)
    px, py = x[mine], y[mine]
    cells, reach, seen = Cells(m), np.full(m, np.inf), np.zeros(m)
    for done, more in ((0, k), (k, 8 * k)):
        open_ = seen < 2 * reach
        asked = np.zeros(n, bool)
        asked[mine[open_]] = True
        of, to, distance, rank = nearest(x, y, np.arange(n), more, asked=asked)
        table, far = np.full((m, more), -1), np.full((m, more), np.inf)
        table[row[of], rank], far[row[of], rank] = to, distance
        for r in range(done, more):
            at = np.flatnonzero(open_ & (table[:, r] >= 0) & (far[:, r] < 2 * reach))
            to = table[at, r]
            changed = cells.cut(at, x[to] - px[at], y[to] - py[at], to)
            reach[changed] = cells.reach(changed)
        seen[open_] = far[open_, -1]  # infinite where there are no further points
    order = np.argsort(x, kind="stable")
    sx, sy = x[order], y[order]
    for i in np.flatnonzero(seen < 2 * reach).tolist():
        most = 2 * reach[i] * (1 + 1e-9)
        first, end = np.searchsorted(sx, px[i] + (most + 1e-9 * abs(px[i])) * np.array([-1, 1]))
        dx, dy = sx[first:end] - px[i], sy[first:end] - py[i]
        square = dx * dx + dy * dy
        some = np.flatnonzero((square <= most**2) & (square >= seen[i] ** 2 * (1 - 1e-9)))
        dx, dy, square, some = dx[some], dy[some], square[some], order[first + some]
        cut = ~np.isin(some, cells.owners[i, : cells.sizes[i]])
        while (cut := cut & cells.violated(i, dx, dy, seen[i])).any():
            dx, dy, square, some = dx[cut], dy[cut], square[cut], some[cut]
            j = np.argmin(square)
            if not len(cells.cut(np.array([i]), dx[[j]], dy[[j]], some[[j]])):
                break
            cut = some != some[j]
    of, to = neighbours(cells, lambda i, j: (float(x[j]), float(y[j])) if j >= 0 else (float(px[i]), float(py[i])))
    of = mine[of]
    return np.unique(np.stack([np.minimum(of, to), np.maximum(of, to)], 1), axis=0)
