"""3-vectors, plane frames, rotations and rigid transforms as column expressions.

Vectors are plain 3-tuples of columns while an expression is being built, and
STRUCT<x,y,z> once stored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]
Mat = Sequence[Sequence[Column]]

# The table normal used when none is known, and degeneracy limits.
DEFAULT_NORMAL = (0.0, -1.0, 0.0)
ZERO_LENGTH = 1e-8
PARALLEL_LENGTH = 1e-6


def lits(values: Sequence[float]) -> Vec:
    return tuple(F.lit(float(v)) for v in values)


def parts(col: Column | str) -> Vec:
    col = F.col(col) if isinstance(col, str) else col
    return col["x"], col["y"], col["z"]


def pack(v: Sequence[Column]) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    )


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def length(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return length(sub(a, b))


def normalize(a: Vec, fallback: Vec) -> Vec:
    size = length(a)
    return tuple(F.when(size < ZERO_LENGTH, f).otherwise(p / size) for p, f in zip(a, fallback))


def onto_plane(a: Vec, normal: Vec) -> Vec:
    k = dot(a, normal)
    return tuple(p - k * n for p, n in zip(a, normal))


def wrap_half_turn(angle: Column) -> Column:
    """Into [-pi/2, pi/2)."""
    return F.pmod(angle + math.pi / 2, F.lit(math.pi)) - math.pi / 2


def wrap_turn(angle: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(angle + math.pi, F.lit(2 * math.pi)) - math.pi


def fixed_basis(normal: Sequence[float], reference: Sequence[float] = (1, 0, 0)) -> Column:
    """Table frame STRUCT<u,v,n> of a known normal, worked out once on the driver."""

    def unit(a, fallback):
        size = math.sqrt(sum(c * c for c in a))
        return tuple(fallback) if size < ZERO_LENGTH else tuple(c / size for c in a)

    def by(a, b):
        return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])

    n = unit(normal, DEFAULT_NORMAL)
    for axis in (reference, (0, 0, 1), (0, 1, 0)):
        k = sum(p * q for p, q in zip(axis, n))
        u = tuple(p - k * q for p, q in zip(axis, n))
        if math.sqrt(sum(c * c for c in u)) >= PARALLEL_LENGTH:
            break
    u = unit(u, (1, 0, 0))
    v = unit(by(n, u), (0, 0, 1))
    return F.struct(pack(lits(unit(by(v, n), u))).alias("u"), pack(lits(v)).alias("v"), pack(lits(n)).alias("n"))


def with_basis(df, normal: Column, out: str = "basis", reference: Sequence[float] = (1, 0, 0)):
    """Adds the table frame STRUCT<u,v,n> of a normal column.

    The first usable reference axis gives u.  Vectors are bound one after another, so none
    is spelled out twice in the plan.  Meant for one row per normal; join the result to
    points.
    """

    def after_normal(n: Column) -> Column:
        flats = [onto_plane(lits(axis), parts(n)) for axis in (reference, (0, 0, 1), (0, 1, 0))]
        return let(F.array(*[pack(f) for f in flats]), lambda f: let(first_usable(f), lambda u: after_u(n, u)))

    def first_usable(f: Column) -> Column:
        usable = [length(parts(f[i])) >= PARALLEL_LENGTH for i in range(2)]
        chosen = F.when(usable[0], f[0]).when(usable[1], f[1]).otherwise(f[2])
        return let(chosen, lambda c: pack(normalize(parts(c), lits((1, 0, 0)))))

    def after_u(n: Column, u: Column) -> Column:
        side = let(pack(cross(parts(n), parts(u))), lambda c: pack(normalize(parts(c), lits((0, 0, 1)))))
        return let(side, lambda v: let(pack(cross(parts(v), parts(n))), lambda w: frame_of(n, u, v, w)))

    def frame_of(n: Column, u: Column, v: Column, w: Column) -> Column:
        return F.struct(pack(normalize(parts(w), parts(u))).alias("u"), v.alias("v"), n.alias("n"))

    return df.withColumn(out, let(normal, lambda c: let(pack(normalize(parts(c), lits(DEFAULT_NORMAL))), after_normal)))


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression."""
    return F.transform(F.array(value), body)[0]


def turned_axes(u: Vec, v: Vec, yaw: Column) -> tuple[Vec, Vec]:
    c, s = F.cos(yaw), F.sin(yaw)
    return (
        tuple(c * p + s * q for p, q in zip(u, v)),
        tuple(c * q - s * p for p, q in zip(u, v)),
    )


# Sign of each half extent per corner, in drawing order.
CORNER_SIGNS = (
    (-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1),
    (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1),
)


def box_corners(center: Vec, extent: Vec, axes: Sequence[Vec]) -> Column:
    """Eight corners of an oriented box as ARRAY<STRUCT<x,y,z>>."""
    half = [e * 0.5 for e in extent]
    corners = []
    for signs in CORNER_SIGNS:
        reach = [h * float(s) for h, s in zip(half, signs)]
        corners.append(
            pack(tuple(center[i] + sum(reach[a] * axes[a][i] for a in range(3)) for i in range(3)))
        )
    return F.array(*corners)


def pose_corners(center: Vec, extent: Vec, yaw: Column, basis: Column) -> Column:
    """Corners of a box given in the table frame by centre, extent and yaw."""
    u, v, n = parts(basis["u"]), parts(basis["v"]), parts(basis["n"])
    long, short = turned_axes(u, v, yaw)
    return box_corners(center, extent, (long, short, n))


def workspace_corners(bounds: dict[str, tuple[float, float]] | None) -> Column:
    """Axis-aligned corners, same order; null when disabled or not finite."""
    values = [v for axis in ("x", "y", "z") for v in bounds[axis]] if bounds else []
    if not values or not all(math.isfinite(v) for v in values):
        return F.lit(None).cast("array<struct<x:double,y:double,z:double>>")
    picks = [[bounds[a][0 if s < 0 else 1] for a, s in zip("xyz", signs)] for signs in CORNER_SIGNS]
    return F.array(*[pack(lits(p)) for p in picks])


# --- rotations ---------------------------------------------------------------


def quat_to_rot(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion; identity when its norm vanishes."""
    norm = F.sqrt(x * x + y * y + z * z + w * w)
    tiny = norm < 1e-12
    x, y, z, w = (F.when(tiny, F.lit(d)).otherwise(q / norm) for q, d in ((x, 0.0), (y, 0.0), (z, 0.0), (w, 1.0)))
    twice = lambda a, b: F.lit(2.0) * (a * b)
    return [
        [1 - twice(y, y) - twice(z, z), twice(x, y) - twice(z, w), twice(x, z) + twice(y, w)],
        [twice(x, y) + twice(z, w), 1 - twice(x, x) - twice(z, z), twice(y, z) - twice(x, w)],
        [twice(x, z) - twice(y, w), twice(y, z) + twice(x, w), 1 - twice(x, x) - twice(y, y)],
    ]


def rot_to_quat(r: Mat) -> tuple[Column, Column, Column, Column]:
    """(x, y, z, w), divided by the largest component so that no branch loses precision.

    Four times the product of any two components is a sum or difference of matrix
    entries, so with the leading component known the other three follow.
    """
    diag = [r[0][0], r[1][1], r[2][2]]
    trace = diag[0] + diag[1] + diag[2]
    xy, xz, yz = r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
    xw, yw, zw = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]
    products = {"w": (xw, yw, zw, None), "x": (None, xy, xz, xw), "y": (xy, None, yz, yw), "z": (xz, yz, None, zw)}
    four_squared = {
        "w": 1 + trace,
        "x": 1 + diag[0] - diag[1] - diag[2],
        "y": 1 + diag[1] - diag[0] - diag[2],
        "z": 1 + diag[2] - diag[0] - diag[1],
    }
    lead = (
        F.when(trace > 0, F.lit("w"))
        .when((diag[0] > diag[1]) & (diag[0] > diag[2]), F.lit("x"))
        .when(diag[1] > diag[2], F.lit("y"))
        .otherwise(F.lit("z"))
    )
    out = []
    for slot in range(4):
        value = None
        for name in "wxyz":
            double = F.sqrt(four_squared[name])  # twice the leading component
            term = double / 2 if products[name][slot] is None else products[name][slot] / (double * 2)
            value = F.when(lead == name, term) if value is None else value.when(lead == name, term)
        out.append(value)
    return tuple(out)


def matmul(a: Mat, b: Mat) -> list[list[Column]]:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def transpose(a: Mat) -> list[list[Column]]:
    return [[a[j][i] for j in range(3)] for i in range(3)]


def rotate(r: Mat, p: Vec) -> Vec:
    return tuple(dot(tuple(row), p) for row in r)


def rot_angle_deg(r: Mat) -> Column:
    """Geodesic angle of a rotation, from its skew part and its trace: exact to all digits near 0 and 180 degrees too."""
    skew = (r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1])
    return F.degrees(F.atan2(length(skew), r[0][0] + r[1][1] + r[2][2] - 1.0))


def yaw_pitch_rot(yaw_deg: Column, pitch_deg: Column) -> list[list[Column]]:
    """Yaw about Y after pitch about X."""
    y, p = F.radians(yaw_deg), F.radians(pitch_deg)
    cy, sy, cp, sp = F.cos(y), F.sin(y), F.cos(p), F.sin(p)
    return [
        [cy, sy * sp, sy * cp],
        [F.lit(0.0), cp, -sp],
        [-sy, cy * sp, cy * cp],
    ]


def quat_to_rpy(x: Column, y: Column, z: Column, w: Column) -> tuple[Column, Column, Column]:
    """Static-axes roll, pitch, yaw."""
    r = quat_to_rot(x, y, z, w)
    flat = F.sqrt(r[0][0] * r[0][0] + r[1][0] * r[1][0])
    locked = flat <= 4 * 2.220446049250313e-16
    roll = F.when(locked, F.atan2(-r[1][2], r[1][1])).otherwise(F.atan2(r[2][1], r[2][2]))
    pitch = F.atan2(-r[2][0], flat)
    yaw = F.when(locked, F.lit(0.0)).otherwise(F.atan2(r[1][0], r[0][0]))
    return roll, pitch, yaw


# --- rigid transforms: STRUCT<r00..r22, tx, ty, tz> ---------------------------


def pack_rigid(r: Mat, t: Sequence[Column]) -> Column:
    cells = [r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return F.struct(*cells, t[0].alias("tx"), t[1].alias("ty"), t[2].alias("tz"))


def rigid_parts(col: Column | str) -> tuple[list[list[Column]], Vec]:
    col = F.col(col) if isinstance(col, str) else col
    return [[col[f"r{i}{j}"] for j in range(3)] for i in range(3)], (col["tx"], col["ty"], col["tz"])


def rigid_from_quat(t: Vec, q: tuple[Column, Column, Column, Column]) -> Column:
    return pack_rigid(quat_to_rot(*q), t)


def rigid_from_rows(col: Column | str) -> Column:
    """From a 4x4 ARRAY<ARRAY<DOUBLE>>."""
    col = F.col(col) if isinstance(col, str) else col
    return pack_rigid([[col[i][j] for j in range(3)] for i in range(3)], [col[i][3] for i in range(3)])


def rigid_lit(rows: Sequence[Sequence[float]]) -> Column:
    return pack_rigid(
        [[F.lit(float(rows[i][j])) for j in range(3)] for i in range(3)],
        [F.lit(float(rows[i][3])) for i in range(3)],
    )


def compose(a: Column | str, b: Column | str) -> Column:
    ra, ta = rigid_parts(a)
    rb, tb = rigid_parts(b)
    return pack_rigid(matmul(ra, rb), add(rotate(ra, tb), ta))


def apply_rigid(t: Column | str, p: Vec) -> Vec:
    r, shift = rigid_parts(t)
    return add(rotate(r, p), shift)


# --- pinhole camera -----------------------------------------------------------


def backproject(u: Column, v: Column, z: Column, fx, fy, ppx, ppy) -> Vec:
    return (u - ppx) * z / fx, (v - ppy) * z / fy, z


def project(p: Vec, fx, fy, ppx, ppy) -> tuple[Column, Column, Column]:
    """Pixel position and depth; the depth divisor never drops below 1e-6."""
    z = F.greatest(p[2], F.lit(1e-6))
    return (fx * p[0] + ppx * p[2]) / z, (fy * p[1] + ppy * p[2]) / z, p[2]
