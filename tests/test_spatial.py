"""Overlap joins against all pairs, the triangle test against points of both shapes, affine maps against numpy."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from atomweave.functions import linalg
from atomweave.operators import spatial

BOXES = "frame int, id int, low array<double>, high array<double>"


def boxes(rng, n, start, most):
    low = rng.uniform(-5, 5, (n, 3))
    high = low + rng.uniform(0, 1, (n, 3)) * most ** rng.uniform(-2, 1, (n, 1))
    return [(int(rng.integers(2)), start + i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(low, high))]


def test_boxes_of_all_sizes_meet_once(spark):
    rng = np.random.default_rng(0)
    a, b = boxes(rng, 150, 0, 30.0), boxes(rng, 150, 1000, 8.0)
    grid = [(0, 500 + i, [float(i), 0.0, 0.0], [i + 1.0, 0.0, 4.0]) for i in range(8)]  # flat, on lines of the grid
    points = [(0, 2000 + i, [float(i), 0.0, 1.0], [float(i), 0.0, 1.0]) for i in range(8)]
    a, b = a + grid + [(0, 700, None, [1.0, 1.0, 1.0]), (0, 701, [1.0, 1.0, 1.0], [0.0, 2.0, 2.0]), (0, 702, [float("nan")] * 3, [1.0] * 3)], b + points + grid[2:3]
    meets = lambda p, q: p[2] and p[0] == q[0] and all(u <= y and v >= x and u <= v for u, v, x, y in zip(p[2], p[3], q[2], q[3]))
    want = sorted((p[0], p[1], q[1]) for p, q in itertools.product(a, b) if meets(p, q))
    left, right = spark.createDataFrame(a, BOXES).withColumn("cx", F.lit("x")), spark.createDataFrame(b, BOXES).withColumn("row", F.lit(1))
    got = spatial.overlap_join(left, right, ("frame",)).select("frame", "left.id", "right.id").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 100
    assert spatial.overlap_join(left, right.limit(0), ("frame",)).count() == 0 == spatial.overlap_join(left.limit(0), right.limit(0)).count()
    assert spatial.overlap_join(right.where("id >= 2000"), right.where("id >= 2000")).count() == 8  # points alone, repeated from both sides


def test_a_full_cell_is_dealt_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    made = lambda n: spark.createDataFrame([(0, i, a.tolist(), (a + 0.9).tolist()) for i, a in enumerate(rng.uniform(0, 0.1, (n, 3)))], BOXES)
    left, right = made(90), made(70)  # all meet, in one cell
    monkeypatch.setattr(spatial, "BLOCK", 16, raising=False)
    monkeypatch.setattr(spatial, "PER_TASK", 256, raising=False)
    pairs = spatial.overlap_join(left, right, ("frame",)).select("left.id", F.col("right.id").alias("other"), F.spark_partition_id().alias("task")).collect()
    assert sorted((r.id, r.other) for r in pairs) == list(itertools.product(range(90), range(70)))
    tasks = [sum(r.task == k for r in pairs) for k in {r.task for r in pairs}]
    assert len(tasks) > 8 and max(tasks) < 90 * 70 / 3


def meets(t, v):
    """Whether some point of the triangle lies in the tetrahedron, or an edge of either passes the other's face."""

    def crosses(p, q, a, b, c):
        m = np.stack([p - q, b - a, c - a], 1)
        if abs(np.linalg.det(m)) < 1e-12:
            return False
        s, x, y = np.linalg.solve(m, p - a)
        return 0 <= s <= 1 and x >= 0 and y >= 0 and x + y <= 1

    w = np.linalg.solve(np.vstack([v.T, np.ones(4)]), np.vstack([t.T, np.ones(3)]))
    if (w >= 0).all(0).any():
        return True
    faces = list(itertools.combinations(v, 3))
    return any(crosses(*e, *f) for e in itertools.combinations(t, 2) for f in faces) or any(crosses(*e, *t) for e in itertools.combinations(v, 2))


def test_triangles_and_tetrahedra(spark):
    rng = np.random.default_rng(7)
    place = lambda n, k, size: rng.uniform(0, 6, (n, 1, 3)) + rng.normal(size=(n, k, 3)) * size
    t, v = place(60, 3, 0.8), place(60, 4, 0.8)
    made = lambda x: spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id int, corners array<array<double>>")
    got = {(r.triangle, r.tetrahedron) for r in spatial.triangles_in_tetrahedra(made(t), made(v)).collect()}
    want = {(i, j) for i, j in itertools.product(range(60), range(60)) if meets(t[i], v[j])}
    assert got == want and len(want) > 20
    corner = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])
    touch = np.array([[[-1.0, 0, 0], [-1, 1, 0], [0, 0, 0]], [[-1.0, 0, 0], [-1, 1, 0], [-0.01, 0, 0]], [[0.1, 0.1, 0.1], [0.2, 0.1, 0.1], [0.1, 0.2, 0.1]]])
    assert {r.triangle for r in spatial.triangles_in_tetrahedra(made(touch), made(corner[None])).collect()} == {0, 2}


def test_affine_maps_come_apart_and_together(spark):
    rng = np.random.default_rng(3)
    many = rng.normal(size=(60, 9)) * 10.0 ** rng.integers(-3, 4, (60, 1))
    many[0], many[1] = np.diag([2.0, 2.0, 2.0]).ravel(), np.diag([-1.0, 1.0, 1.0]).ravel()
    many[2], many[3] = np.diag([-1.0, -1.0, 1.0]).ravel(), 0.0
    rows = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(many)], "id int, m array<double>")
    m = [F.get("m", F.lit(i)) for i in range(9)]
    for r in linalg.affine_decomposition(rows, m, [F.lit(1.0), F.lit(2.0), F.lit(3.0)]).collect():
        a = many[r.id].reshape(3, 3)
        if r.id == 3:
            assert r.rotation is None and r.scaling is None and r.translation == [1.0, 2.0, 3.0]
            continue
        x, y, z, w = r.rotation
        turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        xx, yy, zz, xy, xz, yz = r.stretch
        stretch = np.array([[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]])
        size = np.abs(a).max()
        assert np.allclose(r.sign * turn @ stretch, a, atol=1e-9 * size) and abs(np.dot(r.rotation, r.rotation) - 1) < 1e-9 and w >= 0
        assert np.allclose(r.scaling, np.linalg.svd(a)[1], atol=1e-6 * size) and r.sign == np.sign(np.linalg.det(a))
    four = rng.normal(size=(5, 16))
    rows = spark.createDataFrame([(x.tolist(),) for x in four], "m array<double>")
    m = [F.get("m", F.lit(i)) for i in range(16)]
    back = rows.select(F.array(*linalg.inverse4(m)).alias("b"), linalg.det4(m).alias("d"), F.array(*linalg.product4(m, linalg.inverse4(m))).alias("one")).collect()
    for x, r in zip(four, back):
        assert np.allclose(np.reshape(r.b, (4, 4)), np.linalg.inv(x.reshape(4, 4))) and np.isclose(r.d, np.linalg.det(x.reshape(4, 4))) and np.allclose(np.reshape(r.one, (4, 4)), np.eye(4))
