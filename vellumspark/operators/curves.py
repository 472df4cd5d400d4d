"""Smooth outlines: closed pixel paths to lines and cubic curves.

The steps follow the published account of polygon-based tracing: a path of pixel corners and edge middles becomes the
polygon of fewest straight parts (a shortest path, ties to the one that fits best), the polygon's corners move to
where the lines fitted to its sides meet, corners that are sharp stay and the others become curves, and neighbouring
curves join where one is within a tolerance of them.

A straight part spans at most ``LONGEST`` of these points, so work grows with the corners; a longer staircase becomes several parts in line.
A curve begins and ends at most ``UNEVEN`` times the nearer half side away from its corner, so no corner beside a long side is cut far.
Paths keep the ink on their left, y upwards.
"""

from __future__ import annotations

import math

import numpy as np

#: Points looked at first as a straight part grows, and at most.
REACH, LONGEST = 32, 256
#: Half a pixel: paths are doubled so that middles of edges are whole numbers.
HALF = 1.0
#: The longer way from a corner to its curve's end, in shorter ones.
UNEVEN = 3.0
#: Control points lie at least so far on the way to the corner.
LEAST = 0.55


class Lattice:
    """Corners and edge middles of a closed pixel path, doubled, from the start of its longest edge and back to it, with sums
    over the half-pixel steps up to each."""

    def __init__(self, path: list[tuple[int, int]]):
        p = 2 * np.array(path, np.int64)
        p = np.roll(p, -int(np.abs(np.roll(p, -1, 0) - p).sum(1).argmax()), 0)
        p = np.stack([p, (p + np.roll(p, -1, 0)) // 2], 1).reshape(-1, 2)
        self.p = np.concatenate([p, p[:1]]).astype(float)
        step = np.abs(np.diff(self.p, axis=0)).sum(1).astype(int)
        self.at = np.append(0, np.cumsum(step))
        way = np.diff(self.p, axis=0) / step[:, None]
        place = np.arange(self.at[-1]) - np.repeat(self.at[:-1], step)
        unit = np.repeat(self.p[:-1], step, 0) + np.repeat(way, step, 0) * place[:, None]
        x, y = unit.T
        self.sums = np.concatenate([np.zeros((1, 5)), np.cumsum(np.stack([x, y, x * x, y * y, x * y], 1), 0)])

    def moments(self, a, b) -> tuple:
        """(n, mean x, mean y, sums of squares and of products about the means) of the steps from point ``a`` to ``b``, both included."""
        end = np.asarray(self.p[b])
        x, y = end[..., 0], end[..., 1]
        s = self.sums[self.at[b]] - self.sums[self.at[a]] + np.stack([x, y, x * x, y * y, x * y], -1)
        n = self.at[b] - self.at[a] + 1
        mx, my = s[..., 0] / n, s[..., 1] / n
        return n, mx, my, s[..., 2] - n * mx * mx, s[..., 3] - n * my * my, s[..., 4] - n * mx * my


#: Points whose straight parts are sought together.
TOGETHER = 1024


def straight(path: Lattice, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, j, cost): the points ``j`` to which a straight part from each of the points ``i`` may go, those of one after those of
    the one before and up to its place in ``ends``, and what each costs: how far the steps between lie from it, squared.

    A part is straight if its line meets the open unit square around every point between; the squares leave a cone of directions from ``i``.
    """
    end = len(path.p) - 1
    near = path.p[i + 1] - path.p[i]
    ux, uy = (near / np.abs(near).sum(1)[:, None]).T[:, :, None]
    last = np.minimum(end, i + LONGEST)
    low, high = np.full(len(i), -math.inf), np.full(len(i), math.inf)
    live, at, size, found, owners = np.arange(len(i)), 1, REACH, [], []
    while len(live):
        to = i[live, None] + np.arange(at, at + size)
        dx, dy = np.moveaxis(path.p[np.minimum(to, end)] - path.p[i[live]][:, None], 2, 0)
        x, y = dx * ux[live] + dy * uy[live], dy * ux[live] - dx * uy[live]
        ahead = x > HALF
        if at == 1:
            ahead[:, 0] |= x[:, 0] > 0  # the first middle lies so near that every direction meets its square
        corners = np.arctan2(y[..., None] + HALF * np.array([-1, -1, 1, 1]), np.where(ahead, x, 2.0)[..., None] + HALF * np.array([-1, 1, -1, 1]))
        lows = np.maximum.accumulate(np.column_stack([low[live], np.where(ahead, corners.min(2), math.inf)]), 1)
        highs = np.minimum.accumulate(np.column_stack([high[live], np.where(ahead, corners.max(2), -math.inf)]), 1)
        angle = np.arctan2(y, np.where(ahead, x, 2.0))
        row, column = np.nonzero(ahead & (angle > lows[:, :-1] + 1e-9) & (angle < highs[:, :-1] - 1e-9) & (to <= last[live, None]))
        found.append(to[row, column])
        owners.append(live[row])
        low[live], high[live] = lows[:, -1], highs[:, -1]
        at, size = at + size, size * 2
        live = live[(low[live] < high[live]) & (i[live] + at <= last[live])]
    owner, j = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    owner, j = owner[order], j[order]
    a = i[owner]
    n, mx, my, xx, yy, xy = path.moments(a, j)
    dx, dy = (path.p[j] - path.p[a]).T
    off = dy * (mx - path.p[a, 0]) - dx * (my - path.p[a, 1])
    cost = (dy * dy * xx - 2 * dx * dy * xy + dx * dx * yy + n * off * off) / np.maximum(dx * dx + dy * dy, 1)
    return np.cumsum(np.bincount(owner, minlength=len(i))), j, cost


def polygon(path: Lattice) -> list[int]:
    """The points of the polygon of fewest straight parts, and among those of least cost, through the path's first point."""
    n = len(path.p) - 1
    best, before = np.full(n + 1, math.inf), np.zeros(n + 1, int)
    best[0] = 0.0
    for first in range(0, n, TOGETHER):
        ends, to, cost = straight(path, np.arange(first, min(n, first + TOGETHER)))
        # All costs together are below twice the number of steps, so a part more always costs more.
        cost = cost / (2.0 * path.at[-1] + 1)
        begin = 0
        for i, end in enumerate(ends.tolist(), first):
            j = to[begin:end]
            total = best[i] + 1 + cost[begin:end]
            better = total < best[j]
            best[j[better]], before[j[better]] = total[better], i
            begin = end
    out, at = [], n
    while at:
        at = int(before[at])
        out.append(at)
    return out[::-1]


def fitted(path: Lattice, a: int, b: int) -> tuple[float, float, float]:
    """(nx, ny, c): the line nx x + ny y = c closest to the steps from point ``a`` to ``b``."""
    _, mx, my, xx, yy, xy = (float(v) for v in path.moments(a, b))
    turn = 0.5 * math.atan2(2 * xy, xx - yy)
    nx, ny = -math.sin(turn), math.cos(turn)
    return nx, ny, nx * mx + ny * my


def meeting(v: np.ndarray, one: tuple, two: tuple) -> tuple[float, float]:
    """The point of the unit square around ``v`` nearest to two lines, by the sum of squared distances."""
    x0, y0 = v
    det = one[0] * two[1] - one[1] * two[0]
    if abs(det) > 1e-9:
        x, y = (one[2] * two[1] - two[2] * one[1]) / det, (one[0] * two[2] - two[0] * one[2]) / det
        if abs(x - x0) <= HALF and abs(y - y0) <= HALF:
            return x, y
    off = lambda x, y: sum((nx * x + ny * y - c) ** 2 for nx, ny, c in (one, two))
    tried = [(x0, y0)]
    for edge in (-HALF, HALF):
        # Along a side the sum is a parabola; its lowest point, kept on the side, is a candidate.
        for along, fixed in ((0, 1), (1, 0)):
            at = v[fixed] + edge
            square = sum(l[along] ** 2 for l in (one, two))
            lowest = sum(l[along] * (l[2] - l[fixed] * at) for l in (one, two)) / square if square > 1e-12 else v[along]
            lowest = min(max(lowest, v[along] - HALF), v[along] + HALF)
            tried.append((lowest, at) if along == 0 else (at, lowest))
    return min(tried, key=lambda p: off(*p))


Point = tuple[float, float]


def _mix(a: Point, b: Point, t: float) -> Point:
    return a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def curve_area(a: Point, b: Point, c: Point, d: Point) -> float:
    """The signed area between a cubic curve and the origin: a twentieth of weighted cross products."""
    cross = lambda p, q: p[0] * q[1] - p[1] * q[0]
    return (6 * cross(a, b) + 3 * cross(a, c) + cross(a, d) + 3 * cross(b, c) + 3 * cross(b, d) + 6 * cross(c, d)) / 20


def softness(before: Point, v: Point, after: Point) -> float:
    """How far a curve at ``v`` leans into its corner: from 0 to 4/3, by the height of ``v`` over its neighbours' chord against the unit square's."""
    wide = abs(after[0] - before[0]) + abs(after[1] - before[1])
    if wide < 1e-12:
        return 4 / 3
    height = abs(_cross(before, after, v)) / wide
    return 4 / 3 * (1 - 1 / height) if height > 1 else 0.0


def joined(curves: list[tuple], tolerance: float) -> tuple | None:
    """One cubic curve for several that follow each other: their ends and end tangents, their area; None if it strays from them."""
    a, d = curves[0][0], curves[-1][3]
    p, q = curves[0][1], curves[-1][2]
    s, t = (p[0] - a[0], p[1] - a[1]), (q[0] - d[0], q[1] - d[1])
    det = s[0] * t[1] - s[1] * t[0]
    if abs(det) < 1e-9:
        return None
    u = ((d[0] - a[0]) * t[1] - (d[1] - a[1]) * t[0]) / det
    w = ((d[0] - a[0]) * s[1] - (d[1] - a[1]) * s[0]) / det
    if u <= 0 or w <= 0:
        return None
    o = (a[0] + u * s[0], a[1] + u * s[1])
    triangle = _cross(a, o, d) / 2
    area = sum(curve_area(*c) for c in curves) + (d[0] * a[1] - d[1] * a[0]) / 2
    # With control points a share k of the way to o, the curve and its chord enclose 0.3 k (4 - k) of the triangle.
    share = area / (0.3 * triangle) if abs(triangle) > 1e-9 else -1.0
    if not 0 < share <= 3:
        return None
    k = 2 - math.sqrt(4 - share)
    one = (a, _mix(a, o, k), _mix(d, o, k), d)
    line = _sampled(one, np.linspace(0, 1, 8 * len(curves) + 1))
    probes = np.concatenate([_sampled(c, np.array([0.25, 0.5, 0.75, 1.0])) for c in curves])
    return one if _furthest(probes, line) <= tolerance else None


def _sampled(curve: tuple, t: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.array(p) for p in curve)
    t = t[:, None]
    return (1 - t) ** 3 * a + 3 * t * (1 - t) ** 2 * b + 3 * t * t * (1 - t) * c + t**3 * d


def _furthest(points: np.ndarray, line: np.ndarray) -> float:
    """The largest distance of ``points`` from a chain of lines."""
    a, way = line[None, :-1], np.diff(line, axis=0)[None]
    t = np.clip(((points[:, None] - a) * way).sum(2) / np.maximum((way**2).sum(2), 1e-18), 0, 1)
    return float(np.sqrt((((a + t[..., None] * way) - points[:, None]) ** 2).sum(2)).min(1).max())


def smooth(path: list[tuple[int, int]], sharpest: float = 1.0, tolerance: float = 0.2) -> list[tuple]:
    """Lines (a, b) and cubic curves (a, p, q, b) around a closed pixel path, each beginning where the one before ends.

    A corner whose softness reaches ``sharpest`` stays a corner. ``tolerance``: how far a joined curve may lie from those it takes the place of; 0 joins none.
    """
    lattice = Lattice(path)
    chosen = polygon(lattice)
    if len(chosen) < 3:
        chosen = list(range(0, len(lattice.p) - 1, 2))
    last = len(lattice.p) - 1
    lines = [fitted(lattice, a, b) for a, b in zip(chosen, [*chosen[1:], last])]
    v = [tuple(c / 2 for c in meeting(lattice.p[c], lines[k - 1], lines[k])) for k, c in enumerate(chosen)]
    n = len(v)
    middle = [_mix(v[k], v[(k + 1) % n], 0.5) for k in range(n)]
    soft = [softness(v[k - 1], v[k], v[(k + 1) % n]) for k in range(n)]
    begin = next((k for k in range(n) if soft[k] >= sharpest), 0)
    out: list[tuple] = []
    held: list[tuple] = []
    whole: tuple | None = None
    turned, side = 0.0, 0.0

    def close() -> None:
        nonlocal held, whole, turned
        if held:
            out.append(whole)
        held, whole, turned = [], None, 0.0

    for k in ((begin + i) % n for i in range(n)):
        a, corner, b = middle[k - 1], v[k], middle[k]
        if soft[k] >= sharpest:
            close()
            out += [(a, corner), (corner, b)]
            continue
        lean = max(LEAST, min(1.0, soft[k]))
        back, on = math.dist(a, corner), math.dist(corner, b)
        first = _mix(corner, a, min(1.0, UNEVEN * on / back)) if back > UNEVEN * on else a
        second = _mix(corner, b, min(1.0, UNEVEN * back / on)) if on > UNEVEN * back else b
        if first != a or second != b:
            close()
            out += [(a, first)] * (first != a) + [(first, _mix(first, corner, lean), _mix(second, corner, lean), second)] + [(second, b)] * (second != b)
            continue
        curve = (a, _mix(a, corner, lean), _mix(b, corner, lean), b)
        bend = _cross(a, corner, b)
        turn = abs(math.atan2(bend, (corner[0] - a[0]) * (b[0] - corner[0]) + (corner[1] - a[1]) * (b[1] - corner[1])))
        one = joined([*held, curve], tolerance) if held and tolerance and bend * side > 0 and turned + turn < math.pi * 179 / 180 else None
        if one is None:
            close()
            held, whole, turned, side = [curve], curve, turn, bend
        else:
            held, whole, turned = [*held, curve], one, turned + turn
    close()
    return out


def path_data(parts: list[tuple]) -> str:
    """SVG path data of ``smooth``'s parts, to a thousandth of a pixel."""
    text = lambda *points: " ".join(f"{c:.3f}".rstrip("0").rstrip(".") if abs(c) >= 0.0005 else "0" for p in points for c in p)
    return f"M{text(parts[0][0])} " + " ".join(("L" if len(p) == 2 else "C") + text(*p[1:]) for p in parts) + " Z"
