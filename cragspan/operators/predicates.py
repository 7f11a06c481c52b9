"""Exact signs of plane determinants: floating point where its error bound settles the sign, whole numbers elsewhere.

Points are (x, y, rank) or longer.  Four points on a circle are decided as if each height x * x + y * y were raised by
an infinitesimal amount, much more for a lesser rank: a Delaunay triangulation is then unique, whoever computes it.
"""

from __future__ import annotations

from collections.abc import Sequence

Point = Sequence[float]
#: Bounds of the rounding error relative to the sum of absolute products.
_TURN = (3.0 + 16.0 * 2.0**-53) * 2.0**-53
_CIRCLE = (10.0 + 96.0 * 2.0**-53) * 2.0**-53


def _whole(*values: float) -> list[int]:
    """The values times a common power of two."""
    pairs = [float(v).as_integer_ratio() for v in values]
    common = max(d for _, d in pairs)
    return [n * (common // d) for n, d in pairs]


def turn(a: Point, b: Point, c: Point) -> int:
    """1 if a, b, c turn left, -1 if right, 0 on a line."""
    left, right = (a[0] - c[0]) * (b[1] - c[1]), (a[1] - c[1]) * (b[0] - c[0])
    det = left - right
    if abs(det) > _TURN * (abs(left) + abs(right)):
        return 1 if det > 0 else -1
    ax, ay, bx, by, cx, cy = _whole(a[0], a[1], b[0], b[1], c[0], c[1])
    exact = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
    return (exact > 0) - (exact < 0)


def in_circle(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether d lies inside the circle of a, b, c, which turn left; on the circle the least rank decides."""
    ax, ay, bx, by, cx, cy = a[0] - d[0], a[1] - d[1], b[0] - d[0], b[1] - d[1], c[0] - d[0], c[1] - d[1]
    bc, cb, ca, ac, ab, ba = bx * cy, cx * by, cx * ay, ax * cy, ax * by, bx * ay
    aa, bb, cc = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    det = aa * (bc - cb) + bb * (ca - ac) + cc * (ab - ba)
    if abs(det) > _CIRCLE * (aa * (abs(bc) + abs(cb)) + bb * (abs(ca) + abs(ac)) + cc * (abs(ab) + abs(ba))):
        return det > 0
    v = _whole(a[0], a[1], b[0], b[1], c[0], c[1], d[0], d[1])
    ax, ay, bx, by, cx, cy = v[0] - v[6], v[1] - v[7], v[2] - v[6], v[3] - v[7], v[4] - v[6], v[5] - v[7]
    det = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    if det:
        return det > 0
    least = min((a, b, c, d), key=lambda p: p[2])  # raised most: out of the circle of the others, or pulls it off d
    if least is d:
        return False
    # raising a corner lifts the plane over d on its side of the line through the other two
    one, two = [p for p in (a, b, c) if p is not least]
    return turn(one, two, d) == turn(one, two, least)
