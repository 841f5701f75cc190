"""Dislocation lines and triangle meshes as tables: statistics, arc length, smoothing, clipping, documents, topology."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.functions.cell import absolute, reduced, with_geometry
from atomweave.functions.scalars import dislocation_type, vector_text

#: Fixed value: points closer than this along every axis are the same.
SAME_POINT = 1e-4
#: Decimals of reduced coordinates, and of shares of a step, that tell whether a point lies on a face: what is nearer to it differs by rounding alone.
FACE_DECIMALS = 12


def polyline_length(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points(keys, pos, x, y, z)`` to ``keys, n_points, length``."""
    w = Window.partitionBy(*keys).orderBy("pos")
    d = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    step = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return points.withColumn("_step", step).groupBy(*keys).agg(F.count("*").alias("n_points"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"))


def arc_lengths(points: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``arc``, the length of the line up to the point."""
    w = Window.partitionBy(*keys).orderBy("pos")
    d = [F.col(c) - F.lag(c).over(w) for c in "xyz"]
    stepped = points.withColumn("_step", F.coalesce(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(0.0)))
    return stepped.withColumn("arc", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def point_on_line(arcs: DataFrame, keys: list[str], t: float) -> DataFrame:
    """The point at a fraction of each line's length."""
    w = Window.partitionBy(*keys)
    placed = arcs.withColumn("_goal", F.max("arc").over(w) * t)
    nxt = Window.partitionBy(*keys).orderBy("pos")
    for c in ("x", "y", "z", "arc"):
        placed = placed.withColumn(f"_{c}", F.lead(c).over(nxt))
    hit = placed.where((F.col("arc") <= F.col("_goal")) & (F.coalesce("_arc", F.col("arc")) >= F.col("_goal")))
    share = F.coalesce(F.try_divide(F.col("_goal") - F.col("arc"), F.col("_arc") - F.col("arc")), F.lit(0.0))
    at = [(F.col(c) + share * (F.coalesce(f"_{c}", c) - F.col(c))).alias(c) for c in "xyz"]
    return hit.select(*keys, "pos", *at).groupBy(*keys).agg(*[F.min_by(c, "pos").alias(c) for c in "xyz"])


def network_statistics(segments: DataFrame, volume: float) -> DataFrame:
    """Totals of ``segments(length, n_points, dangling, ...)`` and the density, length per volume."""
    return segments.agg(
        F.count("*").alias("n_segments"), F.sum("length").alias("total_length"), F.avg("length").alias("mean_length"), F.min("length").alias("min_length"),
        F.max("length").alias("max_length"), F.sum("n_points").alias("total_points"), F.count_if("dangling").alias("n_dangling"),
    ).withColumn("density", F.col("total_length") / F.lit(volume))


def junction_arms(ends: DataFrame) -> DataFrame:
    """``ends(junction, segment)`` to ``arms, junctions``: how many junctions join so many ends, one end not counting."""
    arms = ends.groupBy("junction").agg(F.count("*").alias("arms")).where("arms > 1")
    return arms.groupBy("arms").agg(F.count("*").alias("junctions"))


def burgers_families(segments: DataFrame) -> DataFrame:
    return segments.withColumn("family", dislocation_type(F.col("bx"), F.col("by"), F.col("bz")))


def circuit_statistics(circuits: DataFrame) -> DataFrame:
    """One row of ``circuits(edges, dangling, blocked)``: how many there are, how many are dangling or blocked, and their mean, least and most edges.

    A null flag counts as false; without circuits the counts are 0 and the rest null.
    """
    return circuits.agg(F.count("*").alias("total"), F.count_if(F.col("dangling")).alias("dangling"), F.count_if(F.col("blocked")).alias("blocked"), F.avg("edges").alias("mean_edges"), F.min("edges").alias("min_edges"), F.max("edges").alias("max_edges"))


def mesh_topology(facets: DataFrame) -> DataFrame:
    """Vertices, distinct undirected edges and faces of ``facets(v0, v1, v2)``; Euler number, genus, mean degree."""
    vertices = facets.select(F.explode(F.array("v0", "v1", "v2")).alias("v")).agg(F.count_distinct("v").alias("vertices"))
    pair = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    edges = facets.select(F.explode(F.array(pair("v0", "v1"), pair("v1", "v2"), pair("v2", "v0"))).alias("e")).agg(F.count_distinct("e").alias("edges"))
    faces = facets.agg(F.count("*").alias("faces"))
    out = vertices.crossJoin(edges).crossJoin(faces)  # one row each
    euler = F.col("vertices") - F.col("edges") + F.col("faces")
    return out.select("*", euler.alias("euler"), ((2 - euler) / 2.0).alias("genus"), F.try_divide(2.0 * F.col("edges"), F.col("vertices")).alias("mean_degree"))


def coarsen(p: np.ndarray, core: np.ndarray, interval: float, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """A line's points and core sizes averaged over stretches: one ends once its points squared reach ``interval`` times its cores.

    Open lines keep their ends. Closed ones come with their first point once more at the end and return so; where the end lies elsewhere
    (a line through the periodic box) and the cores outweigh its length, two points are left, one period apart. Lines of under four
    points, and results of under two (closed: four), stay as they were.
    """
    n = len(p)
    if interval <= 0 or n < 4:
        return p, core
    if closed and np.abs(p[0] - p[-1]).max() > SAME_POINT and core[:-1].sum() * interval > (n - 1) ** 2:
        middle = (p[:-1] - p[0]).mean(0)
        return np.array([p[0] + middle, p[-1] + middle]), np.repeat(core[:-1].sum() // (n - 1), 2)
    inner = slice(None) if closed else slice(1, -1)
    starts, size, total = [], 0, 0
    for at, c in enumerate(core[inner].tolist()):
        if not size or size * size >= interval * total:
            starts.append(at)
            size = total = 0
        size, total = size + 1, total + c
    count = np.diff([*starts, len(core[inner])])
    points = np.add.reduceat(p[inner], starts) / count[:, None]
    cores = np.add.reduceat(core[inner], starts) // count
    ends = ([], [0]) if closed else ([0], [-1])
    points, cores = (np.concatenate([x[ends[0]], y, (y if closed else x)[ends[1]]]) for x, y in ((p, points), (core, cores)))
    return (points, cores) if len(points) >= (4 if closed else 2) else (p, core)


def _smooth(p: np.ndarray, level: int, closed: bool) -> np.ndarray:
    """Taubin smoothing with weights 0.5 and -0.53; open ends stay, closed lines hold their first point at the end too."""
    for _ in range(level):
        for weight in (0.5, -0.53):
            off = np.zeros_like(p)
            off[1:-1] = (p[:-2] + p[2:]) / 2 - p[1:-1]
            if closed:
                off[0], off[-1] = ((p[-2] + p[1]) / 2 - p[k] for k in (0, -1))
            p = p + weight * off
    return p


def smooth_lines(lines: DataFrame, level: int = 1, interval: float = 2.5) -> DataFrame:
    """``lines(line_id, closed, points, cores)`` averaged over stretches that their core sizes and ``interval`` set (``coarsen``), then smoothed.

    ``cores`` holds a whole number per point; lines without any stay as they are, and so do, when it comes to smoothing, loops of
    up to four points. A null ``closed`` counts as open.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done, left = [], []
            for closed, points, cores in zip(b["closed"].fillna(False), b["points"], b["cores"]):
                p = np.array([list(x) for x in points], float).reshape(-1, 3) if points is not None else np.zeros((0, 3))
                core = np.array(cores if cores is not None else [], np.int64)
                if len(core) and len(p) > 1:
                    p, core = coarsen(p, core, interval, bool(closed))
                    if len(p) > 2 and not (closed and len(p) <= 4):
                        p = _smooth(p, level, bool(closed))
                done.append(p.tolist())
                left.append(core.tolist())
            yield pd.DataFrame({"line_id": b["line_id"], "closed": b["closed"], "points": done, "cores": left})

    return lines.select("line_id", "closed", "points", "cores").mapInPandas(work, "line_id long, closed boolean, points array<array<double>>, cores array<long>")


def clip_lines(points: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of ``points(frame, keys, pos, x, y, z)`` cut at the cell's periodic faces: ``(frame, keys, chunk, place, x, y, z)``.

    ``cells`` may be tilted. Steps are split where they cross a face, any number of times; each part lies in one image of the cell
    and is moved from there into the cell, and a chunk is a run of parts of one image. Chunks are numbered from 0 along a
    line, their points from 0 along a chunk; a crossing ends one chunk and starts the next. Steps through an edge of the cell
    cross it once. Reduced coordinates and crossings count to twelve decimals, so a point on a face does not cross it by rounding.
    Lines of one point give nothing, nor do points without coordinates or in frames without a cell.
    """
    whole = points.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    placed = whole.join(with_geometry(cells).select("frame", "origin", "inv", "pbc", "a", "b", "c"), "frame")
    s = [F.round(v, FACE_DECIMALS) for v in reduced([F.col(c) for c in "xyz"])]
    line = ["frame", *keys]
    along = Window.partitionBy(*line).orderBy("pos")
    steps = placed.select(*line, "pos", "pbc", F.array(*s).alias("p")).withColumn("q", F.lead("p").over(along)).where("q IS NOT NULL")

    def crossings(i: int) -> Column:
        u, v = F.get("p", F.lit(i)), F.get("q", F.lit(i))
        low, high = F.least(u, v), F.greatest(u, v)
        first, last = F.floor(low) + 1, F.ceil(high) - 1
        faces = F.when(F.get("pbc", F.lit(i)) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(faces, lambda k: F.round((k - u) / (v - u), FACE_DECIMALS))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), *[crossings(i) for i in range(3)])))
    parts = steps.withColumn("t", cuts).select(*line, "pos", "pbc", "p", "q", F.explode(F.arrays_zip(F.slice("t", 1, F.size("t") - 1).alias("t0"), F.slice("t", 2, F.size("t") - 1).alias("t1"))).alias("t"))
    at = lambda t, i: F.get("p", F.lit(i)) + t * (F.get("q", F.lit(i)) - F.get("p", F.lit(i)))
    middle = (F.col("t.t0") + F.col("t.t1")) / 2.0
    image = F.array(*[F.when(F.get("pbc", F.lit(i)), F.floor(at(middle, i))).otherwise(0) for i in range(3)])
    order = Window.partitionBy(*line).orderBy("pos", "t0")
    parts = parts.select(*line, "pos", F.col("t.t0").alias("t0"), *[F.array(*[at(F.col(t), i) for i in range(3)]).alias(n) for n, t in (("u", "t.t0"), ("v", "t.t1"))], F.when(F.col("p") != F.col("q"), image).alias("image"), image.alias("here"))
    parts = parts.withColumn("image", F.coalesce(F.last("image", ignorenulls=True).over(order), "here"))
    parts = parts.withColumn("new", F.coalesce(F.lag("image").over(order) != F.col("image"), F.lit(True)))
    parts = parts.withColumn("chunk", F.sum(F.col("new").cast("int")).over(order) - 1)
    ends = F.when(F.col("new"), F.array(F.col("u"), F.col("v"))).otherwise(F.array(F.col("v")))
    rows = parts.select(*line, "chunk", "pos", "t0", "image", F.posexplode(ends).alias("k", "s"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*line, "chunk").orderBy("pos", "t0", "k")) - 1)
    back = rows.join(cells.select("frame", "a", "b", "c", "origin"), "frame")
    xyz = absolute([F.get("s", F.lit(i)) - F.get("image", F.lit(i)) for i in range(3)])
    return back.select(*line, F.col("chunk").cast("int").alias("chunk"), "place", *[v.alias(c) for v, c in zip(xyz, "xyz")])


def line_documents(points: DataFrame, cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents of clipped lines, a row per chunk: ``(frame, line_id, chunk, points, length, num_points, burgers)``.

    ``points(frame, line_id, pos, x, y, z)``, ``lines(frame, line_id, bx, by, bz)``; ``burgers`` is a structure of the vector, its
    magnitude and its text. A frame's totals are ``document_summary`` of the chunks.
    """
    chunks = clip_lines(points, cells, ["line_id"])
    step = Window.partitionBy("frame", "line_id", "chunk").orderBy("place")
    d = [F.col(c) - F.lag(c).over(step) for c in "xyz"]
    stepped = chunks.withColumn("step", F.coalesce(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]), F.lit(0.0)))
    ordered = F.sort_array(F.collect_list(F.struct("place", F.array("x", "y", "z").alias("p"))))
    told = stepped.groupBy("frame", "line_id", "chunk").agg(F.transform(ordered, lambda r: r["p"]).alias("points"), F.sum("step").alias("length"), F.count("*").alias("num_points"))
    b = [F.col(f"b{c}") for c in "xyz"]
    burgers = F.struct(F.array(*b).alias("vector"), F.sqrt(b[0] * b[0] + b[1] * b[1] + b[2] * b[2]).alias("magnitude"), vector_text(F.array(*b)).alias("fractional"))
    return told.join(lines, ["frame", "line_id"]).select("frame", "line_id", "chunk", "points", "length", "num_points", burgers.alias("burgers"))


def document_summary(chunks: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Count, points and mean, longest, shortest and total length of ``line_documents``."""
    return chunks.groupBy(*by).agg(F.count("*").alias("count"), F.sum("num_points").alias("total_points"), F.avg("length").alias("average_segment_length"), F.max("length").alias("max_segment_length"), F.min("length").alias("min_segment_length"), F.sum("length").alias("total_length"))


def tube_mesh(points: DataFrame, keys: list[str], width: float, sides: int = 8) -> tuple[DataFrame, DataFrame]:
    """Lines of ``points(keys, pos, x, y, z)`` as tubes: ``(keys, vertex, x, y, z, nx, ny, nz)`` and triangles ``(keys, a, b, c)``.

    Each step of a line is a prism of its own: ``sides`` + 1 pairs of vertices around it, half a ``width`` away, the last pair
    on the first, with normals outwards. Vertices are numbered from 0 within their line. Steps without length, and lines of one
    point, give nothing.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    ahead = points.select(*keys, "pos", *[F.col(c).alias(f"p{c}") for c in "xyz"], *[F.lead(c).over(order).alias(f"q{c}") for c in "xyz"]).where("qx IS NOT NULL")
    d = [F.col(f"q{c}") - F.col(f"p{c}") for c in "xyz"]
    steps = ahead.withColumn("size", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).where("size > 0")
    steps = steps.select("*", *[(x / F.col("size")).alias(f"d{c}") for x, c in zip(d, "xyz")]).withColumn("step", F.row_number().over(order) - 1)
    x, y, z = (F.col(f"d{c}") for c in "xyz")
    steep = F.abs(y) > 0.99  # the side is across the step and across y, or x where the step runs along y
    right = [F.when(steep, 0.0).otherwise(-z), F.when(steep, z).otherwise(0.0), F.when(steep, -y).otherwise(x)]
    size = F.sqrt(right[0] * right[0] + right[1] * right[1] + right[2] * right[2])
    steps = steps.select("*", *[(r / size).alias(f"r{c}") for r, c in zip(right, "xyz")])
    r = [F.col(f"r{c}") for c in "xyz"]
    up = [y * r[2] - z * r[1], z * r[0] - x * r[2], x * r[1] - y * r[0]]
    around = steps.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(sides))))
    angle = F.col("j") * (2 * np.pi / sides)
    normal = [(a * F.cos(angle) + b * F.sin(angle)).alias(f"n{c}") for a, b, c in zip(r, up, "xyz")]
    around = around.select(*keys, "step", "j", *normal, F.explode(F.array(*[F.struct(F.lit(k).alias("end"), *[F.col(f"{e}{c}").alias(c) for c in "xyz"]) for k, e in enumerate("pq")])).alias("e"))
    first = F.col("step") * (2 * (sides + 1))
    vertices = around.select(*keys, (first + 2 * F.col("j") + F.col("e.end")).cast("long").alias("vertex"), *[(F.col(f"e.{c}") + F.col(f"n{c}") * (width / 2)).alias(c) for c in "xyz"], "nx", "ny", "nz")
    at = lambda k: (first + 2 * F.col("j") + k).cast("long")
    faces = steps.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    faces = faces.select(*keys, F.explode(F.array(*[F.struct(at(p).alias("a"), at(q).alias("b"), at(s).alias("c")) for p, q, s in ((0, 1, 2), (2, 1, 3))])).alias("f"))
    return vertices, faces.select(*keys, "f.a", "f.b", "f.c")


def finished_lines(lines: DataFrame, clusters: DataFrame, transitions: DataFrame, kind: int) -> DataFrame:
    """Traced lines made ready: ``(frame, line, cluster, bx, by, bz, points)``.

    ``lines(frame, line, cluster, bx, by, bz, points, head, tail)`` have ``points`` as arrays of arrays; the first ``head`` and the last ``tail``
    of them are left over from tracing and go. A Burgers vector in a cluster of another structure than ``kind`` is turned into
    the smallest cluster of that structure that a transition leads to, if there is one. It then changes sign, and a line whose ends
    are further apart backwards along their dominant axis (z on ties, then y) is turned around, which changes it once more.
    ``clusters(frame, cluster, kind)`` has a row per cluster. Lines with no points left have none.
    """
    known = transitions.where("t0 IS NOT NULL")
    back = [F.col(f"t{3 * (k % 3) + k // 3}").alias(f"t{k}") for k in range(9)]
    ways = known.select("frame", F.col("a").alias("cluster"), F.col("b").alias("to"), *[f"t{k}" for k in range(9)]).unionByName(known.select("frame", F.col("b").alias("cluster"), F.col("a").alias("to"), *back))
    of = clusters.select("frame", "cluster", "kind")
    good = ways.join(of.where(F.col("kind") == kind).select("frame", F.col("cluster").alias("to")), ["frame", "to"])
    best = good.groupBy("frame", "cluster").agg(F.min(F.struct("to", *[f"t{k}" for k in range(9)])).alias("w"))
    told = lines.join(of, ["frame", "cluster"], "left").join(best, ["frame", "cluster"], "left")
    other = F.coalesce((F.col("kind") != kind) & F.col("w").isNotNull(), F.lit(False))
    b = [F.col(f"b{c}") for c in "xyz"]
    turned = [F.when(other, F.col(f"w.t{3 * i}") * b[0] + F.col(f"w.t{3 * i + 1}") * b[1] + F.col(f"w.t{3 * i + 2}") * b[2]).otherwise(b[i]) for i in range(3)]
    points = F.slice("points", F.col("head") + 1, F.greatest(F.size("points") - F.col("head") - F.col("tail"), F.lit(0)))
    told = told.select("frame", "line", F.when(other, F.col("w.to")).otherwise(F.col("cluster")).alias("cluster"), *[(-x).alias(f"b{c}") for x, c in zip(turned, "xyz")], points.alias("points"))
    ends = [F.get(F.get("points", F.size("points") - 1), F.lit(i)) - F.get(F.get("points", F.lit(0)), F.lit(i)) for i in range(3)]
    x, y, z = (F.abs(e) for e in ends)
    along = F.when((x > y) & (x > z), ends[0]).when((y >= x) & (y > z), ends[1]).otherwise(ends[2])
    flip = F.coalesce((along < 0) & (x * x + y * y + z * z > 1e-8), F.lit(False))
    return told.select("frame", "line", "cluster", *[F.when(flip, -F.col(f"b{c}")).otherwise(F.col(f"b{c}")).alias(f"b{c}") for c in "xyz"], F.when(flip, F.reverse("points")).otherwise(F.col("points")).alias("points"))
