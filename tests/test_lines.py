"""Tubes around lines, and lines made ready after tracing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import lines


def test_tubes_are_closed_around_their_lines(spark):
    path = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 2.0, 0.5), (1, 2, 1.0, 2.0, 0.5), (1, 3, 1.0, 5.0, 0.5), (2, 0, 1.0, 1.0, 1.0)]
    points = spark.createDataFrame(path, "line int, pos int, x double, y double, z double")
    vertices, faces = lines.tube_mesh(points, ["line"], 0.4, 6)
    v = {r.vertex: np.array([r.x, r.y, r.z]) for r in vertices.collect()}
    n = {r.vertex: np.array([r.nx, r.ny, r.nz]) for r in vertices.collect()}
    f = [(r.a, r.b, r.c) for r in faces.collect()]
    assert len(v) == 2 * 14 and len(f) == 2 * 12 and {r.line for r in vertices.collect()} == {1}
    ends = [(np.array(path[0][2:]), np.array(path[1][2:])), (np.array(path[1][2:]), np.array(path[3][2:]))]
    for k, x in v.items():
        a, b = ends[k // 14]
        d = (b - a) / np.linalg.norm(b - a)
        off = x - (a if k % 2 == 0 else b)
        assert np.linalg.norm(off) == pytest.approx(0.2) and off @ d == pytest.approx(0, abs=1e-12) and np.allclose(off / 0.2, n[k])
    area = sum(np.linalg.norm(np.cross(v[b] - v[a], v[c] - v[a])) / 2 for a, b, c in f)
    assert area == pytest.approx(6 * 2 * 0.2 * np.sin(np.pi / 6) * sum(np.linalg.norm(b - a) for a, b in ends))


def test_lines_are_trimmed_turned_into_the_crystal_and_aligned(spark):
    schema = "frame int, line long, cluster long, bx double, by double, bz double, points array<array<double>>, head int, tail int"
    rows = [
        (1, 1, 7, 0.5, 0.0, 0.0, [[9.0, 9, 9], [0.0, 0, 0], [2.0, 1, 0], [8.0, 8, 8]], 1, 1),  # in the crystal, forwards
        (1, 2, 7, 0.5, 0.0, 0.0, [[2.0, 1, 0], [0.0, 0, 0]], 0, 0),  # backwards
        (1, 3, 9, 0.0, 0.5, 0.0, [[0.0, 0, 0], [0.0, 0, 3]], 0, 0),  # in a defect next to it
        (1, 4, 11, 0.0, 0.5, 0.0, [[0.0, 0, 0]], 1, 1),  # in a defect that leads nowhere, nothing left
    ]
    clusters = spark.createDataFrame([(1, 7, 1), (1, 9, 2), (1, 11, 2)], "frame int, cluster long, kind int")
    turn = [0.0, -1, 0, 1, 0, 0, 0, 0, 1]  # from 7's frame to 9's: x to y
    transitions = spark.createDataFrame([(1, 7, 9, *map(float, turn))], "frame int, a long, b long, " + ", ".join(f"t{k} double" for k in range(9)))
    got = {r.line: r for r in lines.finished_lines(spark.createDataFrame([(*r[:6], [[float(x) for x in p] for p in r[6]], *r[7:]) for r in rows], schema), clusters, transitions, 1).collect()}
    told = {k: (r.cluster, r.bx, r.by, r.points) for k, r in got.items()}
    assert told[1] == (7, -0.5, 0.0, [[0, 0, 0], [2, 1, 0]]) and told[2] == (7, 0.5, 0.0, [[0, 0, 0], [2, 1, 0]])
    assert told[3] == (7, -0.5, 0.0, [[0, 0, 0], [0, 0, 3]]) and told[4] == (11, 0.0, -0.5, [])


def test_lines_are_cut_at_the_faces_of_a_tilted_cell(spark):
    box = np.array([[10.0, 0, 0], [3.0, 8, 0], [-2.0, 1, 9]])
    cells = spark.createDataFrame([(1, *[r.tolist() for r in box], [1.0, 2.0, 3.0], [True, True, False])], "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>")
    rng = np.random.default_rng(4)
    paths = {k: np.cumsum(rng.normal(0, 12, (9, 3)), 0) for k in range(6)}
    paths[5][4] = paths[5][3]  # a step of no length
    rows = [(1, k, i, *map(float, p)) for k, v in paths.items() for i, p in enumerate(v)]
    rows += [(1, 90, 0, 1.0, 2.0, 3.0), (1, 91, 0, None, 1.0, 1.0), (2, 92, 0, 1.0, 1.0, 1.0), (2, 92, 1, 2.0, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "frame int, line int, pos int, x double, y double, z double")
    got = {}
    for r in sorted(lines.clip_lines(points, cells, ["line"]).collect(), key=lambda r: (r.line, r.chunk, r.place)):
        got.setdefault(r.line, {}).setdefault(r.chunk, []).append([r.x, r.y, r.z])
    assert set(got) == set(paths)
    for k, chunks in got.items():
        inside = [(np.array(c) - [1, 2, 3]) @ np.linalg.inv(box) for c in chunks.values()]
        assert sorted(chunks) == list(range(len(chunks))) and len(chunks) > 1
        assert all(s[:, :2].min() > -1e-9 and s[:, :2].max() < 1 + 1e-9 for s in inside)
        total = sum(np.linalg.norm(np.diff(c, axis=0), axis=1).sum() for c in chunks.values())
        assert total == pytest.approx(np.linalg.norm(np.diff(paths[k], axis=0), axis=1).sum())
        for a, b in zip(inside, inside[1:]):  # the next chunk starts where the last one ended, one image on
            off = b[0] - a[-1]
            assert np.allclose(off, np.round(off), atol=1e-9) and np.abs(off).max() > 0.5 and abs(off[2]) < 1e-9
        assert len(np.concatenate(inside)) == len(paths[k]) + 2 * (len(chunks) - 1)
    told = lines.line_documents(points.withColumnRenamed("line", "line_id"), cells, points.select("frame", points.line.alias("line_id")).distinct().selectExpr("*", "0.5D as bx", "-0.5D as by", "0D as bz"))
    one = told.where("line_id = 3 and chunk = 0").first()
    assert np.allclose(one.points, got[3][0]) and one.burgers.fractional == "[0.500 -0.500 0.000]" and one.burgers.magnitude == pytest.approx(0.5**0.5)
    whole = lines.document_summary(told).first()
    assert whole["count"] == sum(map(len, got.values())) and whole.total_points == sum(len(c) for v in got.values() for c in v.values())


def test_coarser_lines_by_core_sizes(spark):
    p = np.array([[float(i), i % 2, 0] for i in range(9)])
    core = np.array([9, 4, 4, 4, 4, 4, 4, 4, 9])
    points, cores = lines.coarsen(p, core, 0.5, False)  # a stretch ends at 2 points: 4 >= 0.5 * 8
    assert np.allclose(points, [p[0], p[1:3].mean(0), p[3:5].mean(0), p[5:7].mean(0), p[7], p[8]]) and cores.tolist() == [9, 4, 4, 4, 4, 9]
    loop = np.array([[np.cos(a), np.sin(a), 0] for a in np.linspace(0, 2 * np.pi, 13)])
    points, cores = lines.coarsen(loop, np.full(13, 4), 0.5, True)
    assert len(points) == 8 and np.allclose(points[0], points[-1]) and np.allclose(points[0], loop[:2].mean(0))
    line = np.array([[i * 1.0, 0.5 * (i % 2), 0] for i in range(6)])  # through the box
    points, cores = lines.coarsen(line, np.full(6, 9), 2.5, True)
    assert np.allclose(points[1] - points[0], [5, 0.5, 0]) and np.allclose(points[0], line[:5].mean(0)) and cores.tolist() == [9, 9]
    rows = [(1, False, p.tolist(), core.tolist()), (2, False, p.tolist(), []), (3, None, p[:1].tolist(), [1]), (4, True, None, None)]
    got = {r.line_id: r for r in lines.smooth_lines(spark.createDataFrame(rows, "line_id long, closed boolean, points array<array<double>>, cores array<int>"), 3, 0.5).collect()}
    assert np.allclose(got[1].points[0], p[0]) and np.allclose(got[1].points[-1], p[8]) and len(got[1].points) == 6
    assert got[2].points == p.tolist() and got[3].points == p[:1].tolist() and got[4].points == []


def test_points_on_a_face_do_not_cross_it_by_rounding(spark):
    """In a cell tilted along x these points lie on the face x = 1 or on an edge, but for rounding."""
    box = 20.0
    at = lambda s: (s[0] * box + s[1] * 4.0, s[1] * box, s[2] * box)
    paths = [[(1.0, k / 10007 * 2, 0.1), (0.5 if k % 2 else 1.5, 0.3, 0.2)] for k in range(1, 400)]
    paths += [[(0.7 + k / 997, 0.4, 0.1), (1.3 - k / 997, 1.6, 0.2)] for k in range(1, 200)]  # through the edge at (1, 1)
    points = spark.createDataFrame([(0, line, pos, *at(s)) for line, p in enumerate(paths) for pos, s in enumerate(p)], "frame int, line_id long, pos int, x double, y double, z double")
    flags = [[True, True, False]]
    cells = spark.createDataFrame([(0, [box, 0.0, 0.0], [4.0, box, 0.0], [0.0, 0.0, box], [0.0] * 3, *flags)], "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>")
    got = {r.line_id: (r.chunks, r.points) for r in lines.clip_lines(points, cells, ["line_id"]).groupBy("line_id").agg(F.count_distinct("chunk").alias("chunks"), F.count("*").alias("points")).collect()}
    assert all(got[k] == (1, 2) for k in range(399))
    assert all(got[k] == (2, 4) for k in range(399, len(paths)))
