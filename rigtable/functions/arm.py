"""Scalar maths of the arm: gripper widths, approach geometry, trajectories."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the gripper: motor angle when open and closed, full width in metres.
MOTOR_OPEN = -5.0
MOTOR_CLOSED = 0.0
MAX_WIDTH = 0.09


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low = F.lit(low) if isinstance(low, (int, float)) else low
    high = F.lit(high) if isinstance(high, (int, float)) else high
    return F.greatest(low, F.least(high, value))


def grasp_width(object_width: Column, padding: float, closed: float, open_: float) -> Column:
    """Half of the padded width, clamped; the closed position when no width is known."""
    closed_pos = F.lit(max(closed, min(open_, closed)))
    return F.when(object_width.isNull(), closed_pos).otherwise(clamp((object_width + padding) * 0.5, closed, open_))


def width_to_motor(half_width: Column, max_width: float = MAX_WIDTH, open_: float = MOTOR_OPEN, closed: float = MOTOR_CLOSED) -> Column:
    share = F.lit(0.0) if max_width <= 0 else clamp(half_width * 2.0 / max_width, 0.0, 1.0)
    return share * (open_ - closed) + closed


def motor_to_joint(motor: Column, max_width: float = MAX_WIDTH, open_: float = MOTOR_OPEN, closed: float = MOTOR_CLOSED) -> Column:
    span = open_ - closed
    share = F.lit(0.0) if span == 0 else (motor - closed) / span
    return clamp(share * (max_width * 0.5), 0.0, max_width * 0.5)


def azimuth(x: Column, y: Column, ref_deg: float = 0.0, align: bool = True) -> Column:
    return F.atan2(y, x) - math.radians(ref_deg) if align else F.lit(0.0)


def rotate_xy(dx: Column | float, dy: Column | float, theta: Column) -> tuple[Column, Column]:
    c, s = F.cos(theta), F.sin(theta)
    return c * dx - s * dy, s * dx + c * dy


def quat_mul(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column, Column]:
    """Hamilton product of two (x, y, z, w) quaternions."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + bw * ax + (ay * bz - az * by),
        aw * by + bw * ay + (az * bx - ax * bz),
        aw * bz + bw * az + (ax * by - ay * bx),
        aw * bw - (ax * bx + ay * by + az * bz),
    )


def about_axis(theta: Column, axis: str) -> tuple[Column, Column, Column, Column]:
    half = theta / 2.0
    return tuple(F.sin(half) if a == axis else F.lit(0.0) for a in "xyz") + (F.cos(half),)


def yaw_quat(quat: tuple[Column, ...], theta: Column) -> tuple[Column, Column, Column, Column]:
    """Turn an orientation about the base Z axis."""
    return quat_mul(about_axis(theta, "z"), quat)


def tilt_quat(quat: tuple[Column, ...], pitch_deg: float, theta: Column) -> tuple[Column, Column, Column, Column]:
    """Tilt about base Y, then turn about base Z."""
    return yaw_quat(quat_mul(about_axis(F.radians(F.lit(pitch_deg)), "y"), quat), theta)


def descent_z(hand_z: Column, target_z: Column, delta: float, object_height: float, margin: float) -> Column:
    """Go down by ``delta`` but never below the table plus a margin."""
    return F.greatest(hand_z - delta, target_z - object_height / 2.0 + margin)


def lift_center(surface_z: Column, height: float) -> Column:
    return surface_z + height * 0.5


def joints_close(a: Column, b: Column, tol: float) -> Column:
    """All paired differences within tolerance; extra entries of the longer list are ignored."""
    n = F.least(F.size(a), F.size(b))
    gaps = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda p, q: F.abs(p - q))
    return F.forall(gaps, lambda g: g <= tol)


def valid_joints(col: Column, n: int) -> Column:
    return (F.size(col) == n) & F.exists(col, lambda v: v != 0)


def resample(start: Column, goal: Column, duration: Column | float, steps: int = 30) -> Column:
    """ARRAY<STRUCT<positions,t>> of steps + 1 evenly spaced points."""
    dur = F.lit(float(duration)) if isinstance(duration, (int, float)) else duration
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.struct(
            F.zip_with(start, goal, lambda a, b: a + (b - a) * (i / F.lit(steps))).alias("positions"),
            (i * (dur / F.lit(max(steps, 1)))).alias("t"),
        ),
    )


def with_start(points: Column, current: Column) -> Column:
    """Put the present position in front when the first point is later than zero."""
    first = F.struct(current.alias("positions"), F.lit(0.0).alias("t"))
    return F.when(points[0]["t"] > 0, F.concat(F.array(first), points)).otherwise(points)


def _taken_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where lambdas inside ``use`` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def interp_at(points: Column, t: Column) -> Column:
    """Positions at time t: linear between neighbours, held at both ends.

    Point times that run backwards count as equal to the previous one, so of several
    candidates the first segment whose end has been reached or lies ahead is used.
    """

    def segment(given: Column) -> Column:
        at, n = given["points"], F.size(given["points"])
        spans = F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda i: F.struct(F.get(at, i - 1).alias("a"), F.coalesce(F.get(at, i), F.get(at, i - 1)).alias("b")),
        )
        return _taken_once(spans, lambda all_: F.coalesce(F.get(F.filter(all_, lambda s: F.greatest(s["b"]["t"], s["a"]["t"]) >= given["t"]), F.lit(0)), F.element_at(all_, -1)))

    def shared(span: Column, at: Column) -> Column:
        t0 = span["a"]["t"]
        t1 = F.greatest(span["b"]["t"], t0)
        share = F.when(t1 <= t0, F.lit(1.0)).otherwise(clamp((at - t0) / (t1 - t0), 0.0, 1.0))
        return _taken_once(share, lambda w: F.zip_with(span["a"]["positions"], span["b"]["positions"], lambda p, q: p + (q - p) * w))

    given = F.struct(points.alias("points"), t.alias("t"))
    return _taken_once(given, lambda g: _taken_once(segment(g), lambda span: shared(span, g["t"])))


def wrap_near(value: Column, ref: Column | float) -> Column:
    """Angle moved by whole turns to within half a turn of a reference, kept in [-pi, pi]."""
    ref = F.lit(float(ref)) if isinstance(ref, (int, float)) else ref
    turn = F.lit(2 * math.pi)
    near = ref + F.pmod(value - ref + math.pi, turn) - math.pi
    held = F.when(F.abs(near) > math.pi, F.pmod(value + math.pi, turn) - math.pi).otherwise(near)
    return F.when((held == -math.pi) & (value > 0), F.lit(math.pi)).otherwise(held)
