import pytest

from atomweave.operators import meshes

TETRA = [(0, 1, 2), (0, 3, 1), (0, 2, 3), (1, 3, 2)]
CORNERS = [(0, 0.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 0.0, 1.0), (9, 5.0, 5.0, 5.0)]


def test_smoothing_and_normals(spark):
    points = spark.createDataFrame(CORNERS, "v int, x double, y double, z double")
    facets = spark.createDataFrame(TETRA, "v0 int, v1 int, v2 int")
    assert meshes.mesh_edges(facets).count() == 12
    got = {r.v: (r.x, r.y, r.z) for r in meshes.smooth_mesh(points, facets, 1).collect()}
    want = {v: [x, y, z] for v, x, y, z in CORNERS}
    for weight in (0.5, -0.52):
        old = {k: list(p) for k, p in want.items()}
        for v in range(4):
            for c in range(3):
                want[v][c] = old[v][c] + weight * (sum(old[w][c] for w in range(4) if w != v) / 3 - old[v][c])
    assert all(got[v] == pytest.approx(want[v]) for v in want)
    normals = {r.v: (r.nx, r.ny, r.nz) for r in meshes.vertex_normals(points, facets).collect()}
    assert 9 not in normals and all(sum(c * c for c in n) == pytest.approx(1) for n in normals.values())


def test_lines_through_outliers(spark):
    rows = [(float(i), 2.0 * i + 1.0 if i != 7 else 500.0) for i in range(20)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert meshes.least_absolute_line(df, "x", "y", rounds=30) == pytest.approx((2.0, 1.0), abs=1e-2)
    assert meshes.weighted_line(df.where("x <> 7"), "x", "y", meshes.F.lit(1.0)) == pytest.approx((2.0, 1.0))
