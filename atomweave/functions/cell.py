"""Simulation cells as columns: three edge vectors ``a, b, c``, an ``origin`` (arrays of 3) and ``pbc`` flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(v: str | Column, i: int) -> Column:
    return F.get(F.col(v) if isinstance(v, str) else v, F.lit(i))


def dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def edges(prefix: str = "") -> list[list[Column]]:
    return [[_at(f"{prefix}{e}", i) for i in range(3)] for e in "abc"]


def volume(prefix: str = "") -> Column:
    a, b, c = edges(prefix)
    return F.abs(dot(a, cross(b, c)))


def with_geometry(cells: DataFrame) -> DataFrame:
    """Add ``volume``, the rows ``inv`` of the inverse cell matrix, and the plane heights ``heights``."""
    a, b, c = edges()
    det = dot(a, cross(b, c))
    rows = [cross(b, c), cross(c, a), cross(a, b)]
    cells = cells.withColumn("_det", det)
    inv = F.array(*[F.array(*[x / F.col("_det") for x in r]) for r in rows])
    heights = F.array(*[F.abs(F.col("_det")) / F.sqrt(dot(r, r)) for r in rows])
    return cells.withColumn("volume", F.abs("_det")).withColumn("inv", inv).withColumn("heights", heights).drop("_det")


def lengths_and_angles(prefix: str = "") -> dict[str, Column]:
    """Edge lengths, and the angles between the edges in degrees."""
    a, b, c = edges(prefix)
    size = [F.sqrt(dot(v, v)) for v in (a, b, c)]
    angle = lambda u, v, m, n: F.degrees(F.acos(dot(u, v) / (m * n)))
    return {
        "len_a": size[0], "len_b": size[1], "len_c": size[2],
        "alpha": angle(b, c, size[1], size[2]), "beta": angle(a, c, size[0], size[2]), "gamma": angle(a, b, size[0], size[1]),
    }


def reciprocal(prefix: str = "") -> dict[str, Column]:
    """Reciprocal edges without the factor 2 pi."""
    a, b, c = edges(prefix)
    det = dot(a, cross(b, c))
    return {f"reciprocal_{n}": F.array(*[x / det for x in v]) for n, v in (("a", cross(b, c)), ("b", cross(c, a)), ("c", cross(a, b)))}


def reduced(xyz: list[Column], inv: str = "inv", origin: str = "origin") -> list[Column]:
    """Absolute points to reduced coordinates."""
    r = [xyz[i] - _at(origin, i) for i in range(3)]
    return [dot([_at(_at(inv, i), j) for j in range(3)], r) for i in range(3)]


def absolute(s: list[Column], prefix: str = "", origin: str | None = "origin") -> list[Column]:
    """Reduced coordinates to absolute ones; without an origin they are vectors."""
    e = edges(prefix)
    return [s[0] * e[0][i] + s[1] * e[1][i] + s[2] * e[2][i] + (_at(origin, i) if origin else 0.0) for i in range(3)]


def wrapped(s: list[Column], pbc: str = "pbc") -> list[Column]:
    """Reduced points moved into the cell along periodic axes."""
    return [F.when(_at(pbc, i), s[i] - F.floor(s[i])).otherwise(s[i]) for i in range(3)]


def nearest_image(s: list[Column], pbc: str = "pbc") -> list[Column]:
    """Reduced vectors to their nearest image: floor(s + 0.5) is taken off along periodic axes."""
    return [F.when(_at(pbc, i), s[i] - F.floor(s[i] + 0.5)).otherwise(s[i]) for i in range(3)]


def is_wrapped(s: list[Column], pbc: str = "pbc") -> Column:
    """Whether a reduced vector is longer than half the cell along a periodic axis."""
    out = F.lit(False)
    for i in range(3):
        out = out | (_at(pbc, i) & (F.abs(s[i]) >= 0.5))
    return out
