"""3x3 and 4x4 matrices, symmetric tensors and quaternions as columns.

Matrices are lists of nine (sixteen) columns by rows; as arrays they are column-major. Symmetric tensors come as xx, yy, zz, xy,
xz, yz; quaternions as x, y, z, w.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[Column]


def det(m: Matrix) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Matrix, d: Column | None = None) -> Matrix:
    """``d`` is the determinant, where it is at hand as a column."""
    d = det(m) if d is None else d
    return [
        (m[4] * m[8] - m[5] * m[7]) / d, (m[2] * m[7] - m[1] * m[8]) / d, (m[1] * m[5] - m[2] * m[4]) / d,
        (m[5] * m[6] - m[3] * m[8]) / d, (m[0] * m[8] - m[2] * m[6]) / d, (m[2] * m[3] - m[0] * m[5]) / d,
        (m[3] * m[7] - m[4] * m[6]) / d, (m[1] * m[6] - m[0] * m[7]) / d, (m[0] * m[4] - m[1] * m[3]) / d,
    ]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)]


def gram(f: Matrix) -> list[Column]:
    """The symmetric tensor F^T F."""
    pair = lambda i, j: f[i] * f[j] + f[3 + i] * f[3 + j] + f[6 + i] * f[6 + j]
    return [pair(0, 0), pair(1, 1), pair(2, 2), pair(0, 1), pair(0, 2), pair(1, 2)]


def von_mises_shear(e: list[Column]) -> Column:
    xx, yy, zz, xy, xz, yz = e
    return F.sqrt(xy * xy + xz * xz + yz * yz + ((yy - zz) * (yy - zz) + (xx - zz) * (xx - zz) + (xx - yy) * (xx - yy)) / 6.0)


def column_major(m: Matrix) -> Column:
    return F.array(*[m[3 * i + j] for j in range(3) for i in range(3)])


def transpose(m: Matrix) -> Matrix:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def polar_rotation(m: Matrix, rounds: int = 16) -> Column:
    """The orthogonal factor Q of a matrix Q S with a symmetric S that has no negative eigenvalue, as an array by rows; null for a singular one.

    Means of the matrix and its inverse's transpose, scaled to even out their sizes, draw near to Q and double the right digits each round.
    Q turns space inside out if the matrix does.
    """
    items = lambda x: [F.get(x, F.lit(i)) for i in range(9)]
    size = lambda x: F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0]))

    def step(x: Column, _: Column) -> Column:
        both = F.transform(F.array(F.struct(x.alias("x"), F.array(*transpose(inverse(items(x)))).alias("y"))), lambda p: mean(items(p["x"]), items(p["y"])))
        return F.get(both, F.lit(0))

    def mean(x: Matrix, y: Matrix) -> Column:
        g = F.sqrt(size(y) / size(x))
        return F.array(*[(a * g + b / g) / 2.0 for a, b in zip(x, y)])

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[v.cast("double") for v in m]), step)
    return F.when(F.abs(det(m)) > 0, found)


def symmetric_eigenvalues(e: list[Column]) -> Column:
    """Eigenvalues of a symmetric tensor, largest first: a third of the trace and three cosines a third of a turn apart."""
    xx, yy, zz, xy, xz, yz = e
    q = (xx + yy + zz) / 3.0
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2.0 * off) / 6.0)
    r = det([xx - q, xy, xz, xy, yy - q, yz, xz, yz, zz - q]) / (2.0 * p * p * p)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3.0
    first, last = q + 2.0 * p * F.cos(angle), q + 2.0 * p * F.cos(angle + 2.0 * math.pi / 3.0)
    return F.when(p > 0, F.array(first, 3.0 * q - first - last, last)).otherwise(F.array(q, q, q))


def matrix_to_quaternion(m: Matrix) -> list[Column]:
    """Quaternion of a rotation, w not negative, from whichever component is largest."""
    x, y, z, w = m[0] - m[4] - m[8], m[4] - m[0] - m[8], m[8] - m[0] - m[4], m[0] + m[4] + m[8]
    s = {
        "x": [1.0 + x, m[1] + m[3], m[2] + m[6], m[7] - m[5]],
        "y": [m[1] + m[3], 1.0 + y, m[5] + m[7], m[2] - m[6]],
        "z": [m[2] + m[6], m[5] + m[7], 1.0 + z, m[3] - m[1]],
        "w": [m[7] - m[5], m[2] - m[6], m[3] - m[1], 1.0 + w],
    }
    most = F.greatest(x, y, z, w)
    out = []
    for i in range(4):
        picked = F.when(w >= most, s["w"][i]).when(x >= most, s["x"][i]).when(y >= most, s["y"][i]).otherwise(s["z"][i])
        sign = F.when(w >= most, 1.0).when(x >= most, F.signum(s["x"][3])).when(y >= most, F.signum(s["y"][3])).otherwise(F.signum(s["z"][3]))
        out.append(picked * F.when(sign < 0, -1.0).otherwise(1.0) / (2.0 * F.sqrt(1.0 + most)))
    return out


def affine_decomposition(rows: DataFrame, m: Matrix, translation: list[Column]) -> DataFrame:
    """Rows with their affine map as a stretch, then a rotation, then -1 if it turns space inside out, then a translation.

    Adds ``translation`` array, ``sign``, ``rotation`` quaternion, ``stretch`` symmetric tensor and ``scaling``, its eigenvalues, largest first;
    for a singular map, whose rotation isn't unique, all but the translation are null. Each step is a projection of its own, so that
    no expression is worked out more than once.
    """
    at = lambda c, n: [F.get(c, F.lit(i)) for i in range(n)]
    old = rows.columns
    rows = rows.select("*", F.array(*translation).alias("translation"), F.array(*[v.cast("double") for v in m]).alias("_m"))
    rows = rows.withColumn("sign", F.when(F.abs(det(at("_m", 9))) > 0, F.signum(det(at("_m", 9))))).withColumn("_q", polar_rotation(at("_m", 9)))
    rows = rows.withColumn("_r", F.transform("_q", lambda v: v * F.col("sign")))
    full = product(transpose(at("_q", 9)), at("_m", 9))
    mean = lambda i, j: (full[3 * i + j] + full[3 * j + i]) / 2.0
    rows = rows.withColumn("stretch", F.when(F.col("sign").isNotNull(), F.array(full[0], full[4], full[8], mean(0, 1), mean(0, 2), mean(1, 2))))
    rows = rows.withColumn("rotation", F.when(F.col("sign").isNotNull(), F.array(*matrix_to_quaternion(at("_r", 9)))))
    rows = rows.withColumn("scaling", F.when(F.col("sign").isNotNull(), symmetric_eigenvalues(at("stretch", 6))))
    return rows.select(*old, "translation", "sign", "rotation", "stretch", "scaling")


def minor(m: list[Column], i: int, j: int) -> Column:
    """Determinant of a 4x4 matrix without a row and a column."""
    return det([m[4 * r + c] for r in range(4) if r != i for c in range(4) if c != j])


def det4(m: list[Column]) -> Column:
    return m[0] * minor(m, 0, 0) - m[1] * minor(m, 0, 1) + m[2] * minor(m, 0, 2) - m[3] * minor(m, 0, 3)


def inverse4(m: list[Column]) -> list[Column]:
    d = det4(m)
    return [(1.0 if (i + j) % 2 == 0 else -1.0) * minor(m, j, i) / d for i in range(4) for j in range(4)]


def product4(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[4 * i] * b[j] + a[4 * i + 1] * b[4 + j] + a[4 * i + 2] * b[8 + j] + a[4 * i + 3] * b[12 + j] for i in range(4) for j in range(4)]


def quaternion_product(p: list[Column], q: list[Column]) -> list[Column]:
    px, py, pz, pw = p
    qx, qy, qz, qw = q
    return [
        pw * qx + px * qw + py * qz - pz * qy,
        pw * qy - px * qz + py * qw + pz * qx,
        pw * qz + px * qy - py * qx + pz * qw,
        pw * qw - px * qx - py * qy - pz * qz,
    ]


def quaternion_conjugate(q: list[Column]) -> list[Column]:
    return [-q[0], -q[1], -q[2], q[3]]


def quaternion_to_matrix(q: list[Column]) -> Matrix:
    x, y, z, w = q
    return [
        1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y),
        2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x),
        2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y),
    ]


def rotation_angle(w: Column) -> Column:
    """Angle in degrees of a unit quaternion by its real part, in either sign."""
    return F.degrees(2.0 * F.acos(F.least(F.abs(w), F.lit(1.0))))


def cubic_disorientation(p: list[Column], q: list[Column]) -> Column:
    """Smallest rotation in degrees between two orientations under the 24 rotations of the cube.

    The largest real part over all cubic rotations is a function of the ordered absolute components a >= b >= c >= d of
    the misorientation: a itself, (a + b) / sqrt 2, or (a + b + c + d) / 2.
    """
    m = quaternion_product(quaternion_conjugate(p), q)
    s = F.array_sort(F.array(*[F.abs(x) for x in m]))
    d, c, b, a = (F.get(s, F.lit(i)) for i in range(4))
    return rotation_angle(F.greatest(a, (a + b) / (2.0**0.5), (a + b + c + d) / 2.0))


def hexagonal_disorientation(p: list[Column], q: list[Column]) -> Column:
    """Smallest rotation in degrees between two orientations under the 12 rotations of the hexagonal lattice about z.

    Turns about z mix the real and the z part, the others x and y: the largest real part over all of them is the larger of both
    pairs' lengths along the nearest of twelve directions.
    """
    x, y, z, w = quaternion_product(quaternion_conjugate(p), q)
    steps = [(math.cos(k * math.pi / 6), math.sin(k * math.pi / 6)) for k in range(6)]
    return rotation_angle(F.greatest(*[F.abs(w * c + z * s) for c, s in steps], *[F.abs(x * c + y * s) for c, s in steps]))


def graph_weight(theta: Column) -> Column:
    """Weight of a grain graph's edge by its disorientation in degrees."""
    return F.when(theta < 1e-5, 1.0).otherwise(F.exp(-theta * theta / 3.0))


def harmonic_mean(a: Column, b: Column) -> Column:
    return 2.0 / (1.0 / a + 1.0 / b)


def magnitude(v: Column) -> Column:
    """Euclidean length of an array; 0 for an empty one."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
