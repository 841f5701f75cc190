"""Triangle meshes as tables ``points(v, x, y, z)`` and ``facets(v0, v1, v2)``, and robust line fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomweave.session import cut


def mesh_edges(facets: DataFrame) -> DataFrame:
    """Directed edges ``(v, w)`` between the corners of the facets, each once."""
    ends = [("v0", "v1"), ("v1", "v2"), ("v2", "v0")]
    pairs = F.explode(F.array(*[F.struct(F.col(p).alias("v"), F.col(q).alias("w")) for a, b in ends for p, q in ((a, b), (b, a))]))
    return facets.select(pairs.alias("e")).select("e.v", "e.w").where("v <> w").distinct()


def smooth_mesh(points: DataFrame, facets: DataFrame, iterations: int, shrink: float = 0.5, inflate: float = -0.52) -> DataFrame:
    """Taubin smoothing: each iteration moves vertices towards their neighbours' mean and then back a little more.

    One join on edges per step, written to the shared folder; vertices without edges stay.
    """
    edges = cut(mesh_edges(facets), "mesh-edges")
    now = points.select("v", "x", "y", "z")
    for _ in range(iterations):
        for weight in (shrink, inflate):
            near = now.select(F.col("v").alias("w"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
            mean = edges.join(near, "w").groupBy("v").agg(*[F.avg(f"n{c}").alias(f"m{c}") for c in "xyz"])
            now = now.join(mean, "v", "left").select("v", *[(F.col(c) + weight * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in "xyz"])
            now = cut(now, "mesh-points")
    return now


def vertex_normals(points: DataFrame, facets: DataFrame) -> DataFrame:
    """``(v, nx, ny, nz)``: unit sums of the facets' normals weighted by area; vertices of no facet have none."""
    corners = facets
    for k in range(3):
        corners = corners.join(points.select(F.col("v").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), f"v{k}")
    a = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    b = [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    normal = F.struct((a[1] * b[2] - a[2] * b[1]).alias("x"), (a[2] * b[0] - a[0] * b[2]).alias("y"), (a[0] * b[1] - a[1] * b[0]).alias("z"))
    each = corners.select(F.explode(F.array("v0", "v1", "v2")).alias("v"), normal.alias("n"))
    total = each.groupBy("v").agg(*[F.sum(f"n.{c}").alias(f"n{c}") for c in "xyz"])
    size = F.sqrt(sum((F.col(f"n{c}") * F.col(f"n{c}") for c in "yz"), F.col("nx") * F.col("nx")))
    return total.select("v", *[F.coalesce(F.try_divide(F.col(f"n{c}"), size), F.lit(0.0)).alias(f"n{c}") for c in "xyz"])


def weighted_line(df: DataFrame, x: str, y: str, weight) -> tuple[float, float]:
    """Slope and intercept of the weighted least-squares line; one pass of five sums."""
    w, u, v = weight, F.col(x), F.col(y)
    s = df.agg(F.sum(w).alias("w"), F.sum(w * u).alias("x"), F.sum(w * v).alias("y"), F.sum(w * u * u).alias("xx"), F.sum(w * u * v).alias("xy")).first()
    if not s["w"]:
        return 0.0, 0.0
    spread = s["xx"] - s["x"] * s["x"] / s["w"]
    slope = (s["xy"] - s["x"] * s["y"] / s["w"]) / spread if spread else 0.0
    return slope, (s["y"] - slope * s["x"]) / s["w"]


def least_absolute_line(df: DataFrame, x: str, y: str, weight: str | None = None, rounds: int = 100, floor: float = 1e-4) -> tuple[float, float]:
    """Line of least absolute deviations by reweighting: weights divided by the residual, held above ``floor``.

    Stops when neither coefficient moves; every round is one aggregation over the table.
    """
    base = F.col(weight) if weight else F.lit(1.0)
    line = weighted_line(df, x, y, base)
    for _ in range(rounds):
        apart = F.abs(F.col(y) - (F.lit(line[0]) * F.col(x) + F.lit(line[1])))
        new = weighted_line(df, x, y, base / F.greatest(apart, F.lit(floor)))
        if abs(new[0] - line[0]) < 1e-9 and abs(new[1] - line[1]) < 1e-9:
            return new
        line = new
    return line


def unwrapped_mesh(points: DataFrame, facets: DataFrame, lengths: list[float]) -> tuple[DataFrame, DataFrame]:
    """A periodic mesh drawn in one piece: ``(mesh, point, x, y, z)`` and ``(mesh, facet, a, b, c)``.

    ``points(mesh, vertex, x, y, z)``, ``facets(mesh, facet, a, b, c)``. Each facet's second and third vertex take the
    image nearest to its first; a vertex that is drawn at several images becomes a point for each of them (the seam).
    Points are numbered within the mesh by vertex and image.
    """
    at = lambda k: points.select("mesh", F.col("vertex").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"])
    placed = facets.join(at("a"), ["mesh", "a"]).join(at("b"), ["mesh", "b"]).join(at("c"), ["mesh", "c"])
    shift = lambda k: F.concat_ws(" ", *[(-F.floor((F.col(f"{k}{c}") - F.col(f"a{c}")) / size + 0.5)).cast("long") for c, size in zip("xyz", lengths)])
    placed = placed.select("mesh", "facet", *[F.struct(F.col(k).alias("vertex"), (F.lit("0 0 0") if k == "a" else shift(k)).alias("image")).alias(k) for k in "abc"])
    used = placed.select("mesh", F.explode(F.array("a", "b", "c")).alias("p")).distinct().select("mesh", "p.vertex", "p.image")
    order = Window.partitionBy("mesh").orderBy("vertex", "image")
    drawn = used.withColumn("point", F.row_number().over(order) - 1).join(points, ["mesh", "vertex"])
    moved = [(F.col(c) + F.get(F.split("image", " "), F.lit(i)).cast("double") * size).alias(c) for i, (c, size) in enumerate(zip("xyz", lengths))]
    key = lambda k: drawn.select("mesh", F.struct("vertex", "image").alias(k), F.col("point").alias(f"_{k}"))
    faces = placed.join(key("a"), ["mesh", "a"]).join(key("b"), ["mesh", "b"]).join(key("c"), ["mesh", "c"])
    return drawn.select("mesh", "point", "vertex", *moved), faces.select("mesh", "facet", *[F.col(f"_{k}").alias(k) for k in "abc"])
