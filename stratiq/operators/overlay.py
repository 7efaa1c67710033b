"""Intersection, difference and repair of areas: rings cut at all crossings, and the faces traced anew.

Each pair of areas is a row; the geometry of one row runs in an Arrow batch.  The
edges of both areas are cut where they meet; a piece belongs to the result's
outline if what is wanted holds on one of its sides alone.  Pieces, turned so that
the result is on their left, are followed by the sharpest left turn, so that parts
that touch in a corner are rings of their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from math import atan2, frexp, hypot, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .areas import AREA

ARROW_AREA = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
Rings = list[list[tuple[float, float]]]


def _edges(rings: Rings) -> np.ndarray:
    """x, y of both ends of each edge that has a length."""
    found = [(*a, *b) for ring in rings for a, b in zip(ring, [*ring[1:], *ring[:1]], strict=True) if a != b]
    return np.array(found, float).reshape(-1, 4)


#: Comparisons of edges that are made at once.
AT_ONCE = 400_000


def _crossed(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each edge and its point: does the edge run on the right of the point, across its height."""
    ax, ay, bx, by = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (bx - ax) * (y - ay) / (by - ay) + ax
    return ((ay > y) != (by > y)) & (x < at)


def _spans(sizes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of the first ones' and the others' rows, case by case: rows of a case lie together."""
    start = np.cumsum(sizes) - sizes
    begin = np.cumsum(others) - others
    n = sizes * others
    case = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return start[case] + at // others[case], begin[case] + at % others[case]


def _meetings(edges: np.ndarray, sizes: np.ndarray, snap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edge and share of its length for each place inside an edge where another of its case meets it."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]) - snap[:, None], np.maximum(edges[:, :2], edges[:, 2:]) + snap[:, None]
    i, j = _spans(sizes, sizes)
    box = (low[j] <= np.maximum(edges[i, :2], edges[i, 2:])).all(axis=1) & (high[j] >= np.minimum(edges[i, :2], edges[i, 2:])).all(axis=1)
    i, j = i[box], j[box]
    (ax, ay, bx, by), (cx, cy, dx, dy), near = edges[i].T, edges[j].T, snap[i]
    length2 = (bx - ax) ** 2 + (by - ay) ** 2
    cross = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / cross
        u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / cross
    slack = near / np.maximum(np.sqrt(length2), near)
    met = (cross != 0) & (t > 0) & (t < 1) & (u > -slack) & (u < 1 + slack)
    edge, share = [i[met]], [t[met]]
    for px, py in ((cx, cy), (dx, dy)):  # ends of others on this edge: touching and parallel ones
        s = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length2
        on = (np.hypot(ax + s * (bx - ax) - px, ay + s * (by - ay) - py) <= near) & (s > 0) & (s < 1)
        edge.append(i[on])
        share.append(s[on])
    edge, share = np.concatenate(edge), np.concatenate(share)
    order = np.lexsort((share, edge))
    return edge[order], share[order]


def _cut(edges: list[list[float]], shares: list[list[float]], snap: float) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    """The edges' pieces between all points where two of them meet; equal pieces once, whatever their direction."""
    nodes: dict[tuple[int, int], tuple[float, float]] = {}

    def near(x: float, y: float) -> tuple[float, float]:
        """The known point beside (x, y), so that one crossing found twice is one point."""
        i, j = round(x / snap), round(y / snap)
        if (i, j) in nodes:
            return nodes[i, j]
        for key in ((i + di, j + dj) for di in (0, -1, 1) for dj in (0, -1, 1)):
            if key in nodes:
                return nodes[key]
        return nodes.setdefault((i, j), (i * snap, j * snap))

    for x, y, _, _ in edges:
        near(x, y)
    pieces = set()
    for (ax, ay, bx, by), own in zip(edges, shares, strict=True):
        at = [near(ax, ay), *(near(ax + s * (bx - ax), ay + s * (by - ay)) for s in own), near(bx, by)]
        pieces |= {(p, q) if p < q else (q, p) for p, q in zip(at, at[1:], strict=False) if p != q}
    return sorted(pieces)


def traced(groups: list[Rings], wanted: Callable[..., np.ndarray]) -> Rings:
    """The rings around the places for which ``wanted(inside of each group)`` holds: outlines counter-clockwise, holes clockwise."""
    return traced_all([groups], wanted)[0]


def traced_all(cases: list[list[Rings]], wanted: Callable[..., np.ndarray]) -> list[Rings]:
    """:func:`traced` for many cases: their edges are compared together, so many comparisons at a time."""
    out: list[Rings] = []
    held: list[list[np.ndarray]] = []
    room = 0
    for groups in cases:
        edges = [_edges(g) for g in groups]
        cost = sum(map(len, edges)) ** 2
        if held and room + cost > AT_ONCE:
            out += _traced(held, wanted)
            held, room = [], 0
        held.append(edges)
        room += cost
    return out + (_traced(held, wanted) if held else [])


def _traced(cases: list[list[np.ndarray]], wanted: Callable[..., np.ndarray]) -> list[Rings]:
    each = [np.concatenate(c) for c in cases]
    sizes = np.array([len(e) for e in each])
    # A power of two, so that whole numbers and simple fractions stay what they are.
    snaps = [2.0 ** (frexp(float(np.abs(e).max()))[1] - 37) if len(e) else 1.0 for e in each]
    edges = np.concatenate(each)
    edge, share = _meetings(edges, sizes, np.repeat(snaps, sizes))
    ends = np.searchsorted(edge, np.arange(len(edges) + 1)).tolist()
    share = share.tolist()
    own = [share[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    stop = np.cumsum(sizes).tolist()
    pieces = [_cut(e.tolist(), own[z - len(e) : z], snap) for e, z, snap in zip(each, stop, snaps, strict=True)]
    parts = np.array([len(p) for p in pieces])
    if not parts.sum():
        return [[] for _ in cases]
    ab = np.array([(*p, *q) for ps in pieces for p, q in ps])
    a, b = ab[:, :2], ab[:, 2:]
    middle, ahead = (a + b) / 2, b - a
    # A step aside that is short beside the piece, but not lost in rounding.
    aside = np.stack([-ahead[:, 1], ahead[:, 0]], axis=1) * np.maximum(1e-5, 4 * np.repeat(snaps, parts) / np.hypot(ahead[:, 0], ahead[:, 1]))[:, None]
    left, right = (wanted(*(_odd(at, parts, [c[g] for c in cases]) for g in range(len(cases[0])))) for at in (middle + aside, middle - aside))
    turned = iter(zip(left.tolist(), right.tolist(), strict=True))
    out = []
    for ps in pieces:
        following: dict[tuple[float, float], list[tuple[float, float]]] = defaultdict(list)
        for p, q in ps:
            on_left, on_right = next(turned)
            if on_left != on_right:
                start, end = (p, q) if on_left else (q, p)
                following[start].append(end)
        out.append(_rings(following))
    return out


def _odd(at: np.ndarray, parts: np.ndarray, group: list[np.ndarray]) -> np.ndarray:
    """Whether each point is inside an odd number of its case's rings."""
    sizes = np.array([len(e) for e in group])
    edges = np.concatenate(group)
    i, j = _spans(parts, sizes)
    crossed = i[_crossed(edges[j], at[i, 0], at[i, 1])]
    return np.bincount(crossed, minlength=len(at)) % 2 == 1


def _rings(out: dict[tuple[float, float], list[tuple[float, float]]]) -> Rings:
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, at, to = [start], start, out[start].pop()
            while to != start and out.get(to):
                back = atan2(at[1] - to[1], at[0] - to[0])
                # The next piece clockwise from where we came: the sharpest turn to the left.
                turn = lambda n: (back - atan2(n[1] - to[1], n[0] - to[0])) % (2 * pi) or 2 * pi  # noqa: B023, E731
                ring.append(to)
                following = min(out[to], key=turn)
                out[to].remove(following)
                at, to = to, following
            if to == start:
                rings.append(_straightened(ring))
    return [r for r in rings if len(r) > 2]


def _straightened(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Without the vertices in the middle of a straight line."""
    kept = []
    for i, (x, y) in enumerate(ring):
        (ax, ay), (bx, by) = ring[i - 1], ring[(i + 1) % len(ring)]
        bend = (x - ax) * (by - y) - (y - ay) * (bx - x)
        if abs(bend) > 1e-12 * (hypot(x - ax, y - ay) * hypot(bx - x, by - y)):
            kept.append((x, y))
    return kept


def _read(areas: Iterable[list | None]) -> list[Rings | None]:
    return [None if a is None else [[(p["x"], p["y"]) for p in ring or []] for ring in a] for a in areas]


def _written(areas: list[Rings | None]) -> pa.Array:
    return pa.array([None if a is None else [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in a] for a in areas], ARROW_AREA)


def _of_two(wanted: Callable[..., np.ndarray]) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(AREA)
    def overlay(one: pa.Array, other: pa.Array) -> pa.Array:
        pairs = list(zip(_read(one.to_pylist()), _read(other.to_pylist()), strict=True))
        found = iter(traced_all([[a, b] for a, b in pairs if a is not None and b is not None], wanted))
        return _written([None if a is None or b is None else next(found) for a, b in pairs])

    # Evaluated once: a filter on the result would otherwise repeat it.
    return overlay.asNondeterministic()


def intersection(one: Column, other: Column) -> Column:
    """What two areas have in common, of any shape; an empty area where they only touch or are apart; null if either is."""
    return _of_two(lambda a, b: a & b)(one, other)


def difference(one: Column, other: Column) -> Column:
    """What is in the first area but not in the other."""
    return _of_two(lambda a, b: a & ~b)(one, other)


def made_valid(area: Column) -> Column:
    """The same places with rings that neither cross nor touch themselves along a line: a bow-tie becomes two triangles; null stays null, an area without inside becomes empty."""

    @F.arrow_udf(AREA)
    def repaired(batch: pa.Array) -> pa.Array:
        areas = _read(batch.to_pylist())
        found = iter(traced_all([[a] for a in areas if a is not None], lambda inside: inside))
        return _written([None if a is None else next(found) for a in areas])

    return repaired(area)
