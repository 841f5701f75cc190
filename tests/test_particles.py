import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.functions import linalg
from atomweave.operators import crystal, deformation, particles, structure
from atomweave.operators import lines as dislocations
from atomweave.operators.graph import connected_components
from atomweave.operators.neighbors import cutoff_neighbors, nearest_neighbors
from atomweave.operators.ranking import running_sum

CELL = "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>"


def frame(spark, points, cell, pbc=(True, True, True), origin=(0.0, 0.0, 0.0)):
    rows = [(1, i, *map(float, p)) for i, p in enumerate(points)]
    atoms = spark.createDataFrame(rows, "frame int, id long, x double, y double, z double")
    edges = [[float(x) for x in v] for v in cell]
    return atoms, spark.createDataFrame([(1, *edges, list(map(float, origin)), list(pbc))], CELL)


def lattice(basis, n):
    return np.array([np.array(c) + b for c in itertools.product(range(n), repeat=3) for b in basis], float)


FCC = [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)]
BCC = [(0, 0, 0), (0.5, 0.5, 0.5)]
SC = [(0, 0, 0)]


def brute(points, cell, pbc, cutoff, reach=3):
    cell, out = np.array(cell, float), set()
    inv = np.linalg.inv(cell)
    s = points @ inv
    s = np.where(pbc, s - np.floor(s), s)
    p = s @ cell
    for shift in itertools.product(*[range(-reach, reach + 1) if q else [0] for q in pbc]):
        d = p[None] + np.array(shift) @ cell - p[:, None]
        for i, j in np.argwhere((d**2).sum(-1) <= cutoff**2):
            if i != j or any(shift):
                out.add((int(i), int(j), *shift))
    return out


@pytest.mark.parametrize(
    "cell, pbc, cutoff",
    [
        (np.diag([5.0, 6.0, 7.0]), (True, True, True), 1.4),
        ([[5, 0, 0], [1.5, 5, 0], [-1, 0.7, 6]], (True, True, True), 1.5),
        ([[5, 0, 0], [1.5, 5, 0], [-1, 0.7, 6]], (True, False, True), 1.5),
        (np.diag([1.5, 1.7, 2.0]), (True, True, True), 2.2),
    ],
)
def test_neighbors_equal_brute_force(spark, cell, pbc, cutoff):
    rng = np.random.default_rng(42)
    points = rng.uniform(-0.2, 1.2, (40 if cutoff > 2 else 150, 3)) @ np.array(cell, float)
    atoms, cells = frame(spark, points, cell, pbc)
    found = {tuple(r) for r in cutoff_neighbors(atoms, cells, cutoff).select("i", "j", "sx", "sy", "sz").collect()}
    assert found == brute(points, cell, pbc, cutoff)


def test_bad_cutoffs_and_cells(spark):
    atoms, cells = frame(spark, [(0, 0, 0)], np.eye(3))
    with pytest.raises(ValueError):
        cutoff_neighbors(atoms, cells, 0.0)
    flat = cells.withColumn("c", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    with pytest.raises(Exception, match="volume"):
        cutoff_neighbors(atoms, flat, 1.0).collect()


@pytest.mark.parametrize("basis, cutoff, n, k, kind", [(FCC, 0.8, 12, 12, "FCC"), (BCC, 0.9, 8, 8, "BCC"), (SC, 1.1, 6, 6, "OTHER")])
def test_perfect_lattices(spark, basis, cutoff, n, k, kind):
    atoms, cells = frame(spark, lattice(basis, 4), np.eye(3) * 4)
    pairs = cutoff_neighbors(atoms, cells, cutoff)
    assert {r[0] for r in structure.coordination(atoms, pairs).select("coordination").collect()} == {n}
    near = nearest_neighbors(atoms, cells, 15)
    assert structure.centrosymmetry(atoms, near, k).agg(F.max("csp")).first()[0] == pytest.approx(0, abs=1e-9)
    assert structure.matching_centrosymmetry(atoms, near, k).agg(F.max("csp")).first()[0] == pytest.approx(0, abs=1e-9)
    assert {r[0] for r in structure.local_structure(atoms, near).select("structure").collect()} == {kind}


def test_homogeneous_strain(spark):
    points = lattice(FCC, 4) + 0.1
    f = np.array([[1.02, 0.01, 0.0], [0.0, 0.99, 0.02], [0.0, 0.0, 1.01]])
    then, cells = frame(spark, points, np.eye(3) * 8)
    now, _ = frame(spark, points @ f.T, np.eye(3) * 8)
    moved = deformation.displacements(deformation.reference_join(now, then), cells, minimum_image=False)
    inner = cells.withColumn("pbc", F.array(F.lit(False), F.lit(False), F.lit(False)))
    strain = deformation.atomic_strain(then, cutoff_neighbors(then, inner, 0.8), moved)
    want = (f.T @ f - np.eye(3)) / 2
    for r in strain.where("not invalid").limit(20).collect():
        assert r.strain_tensor == pytest.approx([want[0, 0], want[1, 1], want[2, 2], want[0, 1], want[0, 2], want[1, 2]], abs=1e-9)
        assert np.array(r.deformation_gradient).reshape(3, 3).T == pytest.approx(f, abs=1e-9)
        assert r.d2min == pytest.approx(0, abs=1e-9)
    assert strain.where("invalid").count() == 0


def test_rigid_shift_across_a_face(spark):
    points = np.random.default_rng(1).uniform(0, 5, (50, 3))
    then, cells = frame(spark, points, np.eye(3) * 5)
    now, _ = frame(spark, (points + [0.3, -0.2, 4.9]) % 5, np.eye(3) * 5)
    moved = deformation.displacements(deformation.reference_join(now, then), cells)
    for r in moved.collect():
        assert [r.dx, r.dy, r.dz] == pytest.approx([0.3, -0.2, -0.1], abs=1e-9)


def test_reference_join_errors(spark):
    a, _ = frame(spark, [(0, 0, 0), (1, 1, 1)], np.eye(3))
    with pytest.raises(Exception, match="repeated"):
        deformation.reference_join(a.unionAll(a), a).collect()
    with pytest.raises(Exception, match="not in the reference"):
        deformation.reference_join(a, a.where("id = 0")).collect()


def test_clusters_and_shapes(spark):
    blob = np.random.default_rng(3).normal(0, 0.3, (30, 3))
    points = np.concatenate([(blob[:20] + [0, 5, 5]) % 10, blob[20:] + [5, 5, 5]])
    atoms, cells = frame(spark, points, np.eye(3) * 10)
    pairs = cutoff_neighbors(atoms, cells, 1.5)
    labelled = structure.clusters(atoms, pairs)
    assert {tuple(r) for r in labelled.collect()} == {tuple(r) for r in structure.unwrapped_clusters(atoms, pairs).select("frame", "id", "cluster", "size").collect()}
    assert {(r.cluster, r["size"]) for r in labelled.collect()} == {(1, 20), (2, 10)}
    shape = structure.cluster_shapes(structure.unwrapped_clusters(atoms, pairs)).where("cluster = 1").first()
    assert shape.radius_of_gyration == pytest.approx(np.sqrt(blob[:20].var(0).sum()), abs=1e-9)


def test_float32_predicates(spark):
    v = spark.createDataFrame([(0.1,), (float("nan"),), (1.0,), (None,)], "v double")
    count = lambda op, x: v.where(particles.predicate(F.col("v"), op, x)).count()
    assert [count("==", 0.1), count("!=", 0.1), count("==", 1.0), count(">", 0.5), count("<=", 0.0), count("~", 1.0)] == [0, 4, 1, 1, 1, 0]


def test_delete_everything_is_an_error(spark):
    atoms, _ = frame(spark, [(0, 0, 0)], np.eye(3))
    with pytest.raises(ValueError):
        particles.delete_matching(atoms, F.lit(True))


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.component for r in found if r.vertex <= 200} == {0} and {r.component for r in found if r.vertex >= 500} == {500}
    assert len(found) == 203
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_running_sum(spark):
    rows = [("a" if i % 3 else None, i, i % 5 + 1) for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumn("c", F.floor(F.col("i") / 7))
    total: dict = {}
    want = {}
    for k, i, v in rows:
        want[i] = total.get(k, 0)
        total[k] = want[i] + v
    assert {r.i: r.before for r in running_sum(df, "v", ["k"], "c", [F.col("i")], "before").collect()} == want


def test_cubic_disorientation(spark):
    q = spark.createDataFrame([(0.0, 0.0, float(np.sin(np.radians(50))), float(np.cos(np.radians(50))))], "x double, y double, z double, w double")
    angle = linalg.cubic_disorientation([F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)], [F.col(c) for c in "xyzw"])
    assert q.select(angle).first()[0] == pytest.approx(10.0, abs=1e-6)


def test_lines(spark):
    tetra = spark.createDataFrame([(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)], "v0 int, v1 int, v2 int")
    r = dislocations.mesh_topology(tetra).first()
    assert (r.vertices, r.edges, r.faces, r.euler, r.genus, r.mean_degree) == (4, 6, 4, 2, 0.0, 3.0)


def test_offsets_follow_bonds_through_many_contractions(spark):
    """A coil longer than the box: every bond leads from one end to the other, and no percolation is found."""
    n = 200
    t = np.arange(n)
    coil = np.stack([3 * np.cos(0.15 * t) + 50, 3 * np.sin(0.15 * t) + 50, 0.4 * t], 1)
    order = np.random.default_rng(3).permutation(n)
    box = np.diag([20.0, 20.0, 90.0])
    atoms, cells = frame(spark, (coil % np.diag(box))[order], box)
    pairs = cutoff_neighbors(atoms, cells, 0.7)
    placed = structure.unwrapped_clusters(atoms.repartition(5), pairs)
    got = {r.id: np.array([r.ux, r.uy, r.uz]) for r in placed.collect()}
    assert all(np.allclose(got[k] - got[0], coil[order[k]] - coil[order[0]]) for k in range(n))
    assert structure.percolating_clusters(placed, pairs).count() == 0
    line, cells = frame(spark, [(0.5 * k, 1.0, 1.0) for k in range(20)] + [(5.0, 5.0, 5.0)], np.eye(3) * 10)
    pairs = cutoff_neighbors(line, cells, 0.6)
    placed = structure.unwrapped_clusters(line, pairs)
    assert placed.count() == 21 and [tuple(r) for r in structure.percolating_clusters(placed, pairs).collect()] == [(1, 1)]


def test_group_labels_of_components_equal_walks(spark):
    """Turns by quarters along random edges that agree with hidden states."""
    from atomweave.operators.graph import labelled_components

    rng = np.random.default_rng(8)
    state = rng.integers(0, 4, 300)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2)) if a != b]
    table = spark.createDataFrame([(a, b, int((state[a] - state[b]) % 4)) for a, b in edges], "src long, dst long, label int")
    found = labelled_components(table, F.lit(0), lambda a, b: F.pmod(a + b, F.lit(4)), lambda a: F.pmod(-a, F.lit(4))).collect()
    plain = {r.vertex: r.component for r in connected_components(table).collect()}
    assert {r.vertex: r.component for r in found} == plain
    assert all(r.label == (state[r.vertex] - state[r.component]) % 4 for r in found)
    assert labelled_components(table.limit(0), F.lit(0), lambda a, b: a + b, lambda a: -a).count() == 0


def test_atoms_without_a_position_have_no_neighbours(spark):
    rows = [(1, 0, 0.1, 0.1, 0.1), (1, 1, 0.3, 0.1, 0.1), (1, 2, None, 0.1, 0.1), (1, 3, float("nan"), 0.1, 0.1)]
    atoms = spark.createDataFrame(rows, "frame int, id long, x double, y double, z double")
    _, cells = frame(spark, [(0, 0, 0)], np.eye(3))
    assert {r.i for r in nearest_neighbors(atoms, cells, 3).collect()} == {0, 1}
    assert {r.id: r.coordination for r in structure.coordination(atoms, cutoff_neighbors(atoms, cells, 0.3)).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_matching_of_any_size_is_the_cheapest(spark):
    rng = np.random.default_rng(1)
    for k in (2, 6, 10):
        v = rng.normal(size=(12, k, 3))

        def cheapest(left, cost):
            return min((cost[left[0], j] + cheapest([x for x in left[1:] if x != j], cost) for j in left[1:]), default=0.0)

        want = [cheapest(list(range(k)), ((x[:, None] + x[None]) ** 2).sum(-1)) for x in v]
        assert np.allclose(structure.best_matchings(v), want)
    half = rng.normal(size=(5, 16, 3))
    assert np.allclose(structure.best_matchings(np.concatenate([half, -half[:, ::-1]], 1)), 0)
    off = rng.normal(size=(30, 32, 3))  # no matching made by hand is cheaper
    sums = structure.best_matchings(off)
    for x, total in zip(off, sums):
        cost = ((x[:, None] + x[None]) ** 2).sum(-1)
        assert all(cost[p[::2], p[1::2]].sum() > total - 1e-9 for p in (rng.permutation(32) for _ in range(200)))
    atoms = spark.createDataFrame([(1, 1), (1, 2)], "frame int, id int")
    near = spark.createDataFrame([(1, 1, k + 1, *map(float, x)) for k, x in enumerate(off[0])], "frame int, i int, rank int, dx double, dy double, dz double")
    got = {r.id: r.csp for r in structure.matching_centrosymmetry(atoms, near, 32).collect()}
    assert got == {1: pytest.approx(sums[0]), 2: 0.0}


@pytest.mark.parametrize("most", [10**6, 50])
def test_nearest_neighbors_come_from_tiles_that_move_atoms_not_pairs(spark, monkeypatch, most):
    """Uneven density, an axis open with atoms outside, tilted cell; with small ``most`` the crowded tiles are joined instead."""
    from atomweave.operators import neighbors

    monkeypatch.setattr(neighbors, "MOST_IN_TILE", most)
    monkeypatch.setattr(neighbors, "PER_TILE", 64)
    rng = np.random.default_rng(5)
    box = np.array([[6.0, 0, 0], [1.5, 5, 0], [0, 0, 7]])
    s = np.concatenate([rng.random((300, 3)), 0.1 + 0.05 * rng.random((200, 3)), rng.random((20, 3)) + [0, 0, 1.0]])
    p = s @ box
    atoms = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(p)], "frame int, id long, x double, y double, z double")
    cells = spark.createDataFrame([(0, *box.tolist(), [0.0] * 3, [True, True, False])], "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>")
    got = {(r.i, r["rank"]): (r.j, r.d2) for r in neighbors.nearest_neighbors(atoms, cells, 6).collect()}
    images = [(x, y) for x in range(-2, 3) for y in range(-2, 3)]
    every = np.concatenate([p + x * box[0] + y * box[1] for x, y in images])
    ids = np.tile(np.arange(len(p)), len(images))
    for i, x in enumerate(p):
        d2 = ((every - x) ** 2).sum(1)
        near = sorted((round(float(d), 9), int(j)) for d, j in zip(d2, ids) if d > 1e-12)[:6]
        for rank, (d, j) in enumerate(near, 1):
            assert got[i, rank][0] == j and got[i, rank][1] == pytest.approx(d, abs=1e-8)
    assert len(got) == 6 * len(p)


def test_tiles_hold_few_images_of_an_atom(spark):
    from atomweave.operators import neighbors

    atoms = spark.range(20000).selectExpr("0 AS frame", "id", *[f"pmod(xxhash64(id, '{c}'), 1000003) / 1000003D * 10 AS {c}" for c in "xyz"])
    cells = spark.createDataFrame([(0, [10.0, 0.0, 0.0], [0.0, 10.0, 0.0], [0.0, 0.0, 10.0], [0.0] * 3, [True] * 3, 0.5, 5.0)], "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>, cutoff double, side double")
    rows = neighbors.tiled(atoms, cells)
    assert rows.where("center").count() == 20000 and rows.count() < 3 * 20000


def test_strain_summed_in_tiles_is_that_of_the_pairs(spark, monkeypatch):
    from atomweave.operators import neighbors

    monkeypatch.setattr(neighbors, "PER_TILE", 40)
    rng = np.random.default_rng(9)
    p = rng.random((400, 3)) * 5
    q = p @ np.array([[1.02, 0.01, 0], [0, 0.99, 0.03], [0, 0, 1.01]]) + 0.02 * rng.random((400, 3))
    frame = lambda v: spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(v)], "frame int, id long, x double, y double, z double")
    cells = spark.createDataFrame([(0, [5.0, 0.0, 0.0], [0.5, 5.0, 0.0], [0.0, 0.0, 5.0], [0.0] * 3, [True, False, True])], "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>")
    then = frame(p)
    moved = deformation.displacements(deformation.reference_join(frame(q), then), cells)
    one = {r.id: r for r in deformation.strain_within(then, cells, 1.1, moved).collect()}
    two = {r.id: r for r in deformation.atomic_strain(then, cutoff_neighbors(then, cells, 1.1), moved).collect()}
    assert one.keys() == two.keys() and len(one) == 400
    for k, r in two.items():
        assert one[k].invalid == r.invalid and np.allclose(one[k].strain_tensor, r.strain_tensor, atol=1e-9)
        assert one[k].d2min == pytest.approx(r.d2min, abs=1e-9) and one[k].shear_strain == pytest.approx(r.shear_strain, abs=1e-9)
    sums = deformation.strain_sums(then, cells, 1.1, moved)
    elastic = {r.id: r.strain_tensor for r in crystal.elastic_strain_of_sums(then, sums).collect()}
    assert all(np.allclose(elastic[k], r.strain_tensor, atol=1e-9) for k, r in two.items() if not r.invalid)


def test_radial_distribution_counted_in_tiles_is_that_of_the_pairs(spark, monkeypatch):
    from atomweave.operators import neighbors

    monkeypatch.setattr(neighbors, "PER_TILE", 30)
    p = np.random.default_rng(4).random((300, 3)) * 4
    atoms = spark.createDataFrame([(i % 2, i, *map(float, x)) for i, x in enumerate(p)], "frame int, id long, x double, y double, z double")
    cell = ([4.0, 0.0, 0.0], [0.5, 4.0, 0.0], [0.0, 0.0, 4.0], [0.0] * 3, [True, True, False])
    cells = spark.createDataFrame([(f, *cell) for f in (0, 1)], "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>")
    one = sorted(map(tuple, structure.radial_distribution_within(atoms, cells, 1.3, 20).collect()))
    assert one == sorted(map(tuple, structure.radial_distribution(atoms, cells, cutoff_neighbors(atoms, cells, 1.3), 1.3, 20).collect())) and len(one) == 40
