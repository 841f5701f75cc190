"""Templates, orientations, strain, grains and geometry on crystals made here, and the smaller document operators."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.functions import geometry as G
from atomweave.operators import crystal as C
from atomweave.operators import deformation, meshes
from atomweave.operators import documents as D
from atomweave.operators.neighbors import nearest_neighbors
from atomweave.operators.ranking import numbered

CELL = "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>"
ATOM = "frame int, id long, x double, y double, z double"
BASES = {
    "SC": [(0, 0, 0)],
    "FCC": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5)],
    "BCC": [(0, 0, 0), (0.5, 0.5, 0.5)],
    "CUBIC_DIAMOND": [(0, 0, 0), (0.5, 0.5, 0), (0.5, 0, 0.5), (0, 0.5, 0.5), (0.25, 0.25, 0.25), (0.75, 0.75, 0.25), (0.75, 0.25, 0.75), (0.25, 0.75, 0.75)],
}


def rotations(n, seed=3):
    q = np.random.default_rng(seed).normal(size=(n, 4))
    x, y, z, w = (q / np.linalg.norm(q, axis=1)[:, None]).T
    return np.moveaxis(np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]), 2, 0)


def crystal(spark, kind, cells=3, size=4.0, noise=0.0, frame=1):
    rng = np.random.default_rng(7)
    sites = [(np.array(c) + b) * size for c in itertools.product(range(cells), repeat=3) for b in np.array(BASES[kind], float)]
    rows = [(frame, i, *map(float, p + rng.normal(0, noise, 3) if noise else p)) for i, p in enumerate(sites)]
    edge = cells * size
    box = [(frame, [edge, 0.0, 0.0], [0.0, edge, 0.0], [0.0, 0.0, edge], [0.0] * 3, [True] * 3)]
    return spark.createDataFrame(rows, ATOM), spark.createDataFrame(box, CELL)


@pytest.mark.parametrize("kind", list(C.KINDS))
def test_templates_are_told_apart_in_any_orientation(kind):
    rng = np.random.default_rng(1)
    v = C.lattice_vectors(kind)
    data = np.einsum("mab,nb->mna", rotations(12), v) * 2.3 + rng.normal(0, 0.03, (12, len(v), 3))
    far = np.full((12, 16 - len(v), 3), 9.0) + rng.normal(0, 1, (12, 16 - len(v), 3))
    full = np.concatenate([data, far], 1)
    full = np.take_along_axis(full, np.argsort(np.linalg.norm(full, axis=2), axis=1)[:, :, None], 1)
    told = C.identify(full, list(C.KINDS))
    assert (told["kind"] == C.KINDS[kind]).all() and told["rmsd"].max() < 0.1
    exact = C.identify(np.einsum("mab,nb->mna", rotations(5), v), [kind])
    assert exact["rmsd"].max() < 1e-6
    noise = C.identify(rng.normal(size=(20, 16, 3)), list(C.KINDS))
    assert (noise["rmsd"] > 0.1).all()


@pytest.mark.parametrize("kind", list(C.KINDS))
def test_symmetries_form_groups(kind):
    table, moves = C.symmetry_products(kind), C.permutations(kind)
    n = len(table)
    assert n == {"SC": 24, "FCC": 24, "BCC": 24, "HCP": 6, "CUBIC_DIAMOND": 12, "HEX_DIAMOND": 3}[kind]
    assert (table[0] == np.arange(n)).all() and all(sorted(r) == list(range(n)) for r in table.tolist())
    assert all(sorted(p) == list(range(len(C.lattice_vectors(kind)))) for p in moves.tolist())
    assert all((moves[table[a, b]] == moves[a][moves[b]]).all() for a in range(n) for b in range(n))


def test_matching_strain_and_neighbours_of_a_strained_crystal(spark):
    f = np.array([[1.01, 0.02, 0.0], [0.0, 0.99, 0.0], [0.0, 0.01, 1.02]])
    atoms, cells = crystal(spark, "FCC", size=4.0)
    moved = np.array([[r.x, r.y, r.z] for r in atoms.orderBy("id").collect()]) @ f.T
    edges = (np.eye(3) * 12) @ f.T
    atoms = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(moved)], ATOM)
    cells = spark.createDataFrame([(1, *[list(map(float, e)) for e in edges], [0.0] * 3, [True] * 3)], CELL)
    near = nearest_neighbors(atoms, cells, 18)
    near = near.cache()
    typed = C.template_matching(atoms, near).cache()
    assert {r.structure for r in typed.collect()} == {"FCC"}
    strain = C.elastic_strain(atoms, C.ideal_bonds(spark, typed, near, "FCC", 4.0)).collect()
    green = (f.T @ f - np.eye(3)) / 2
    assert len(strain) == 108
    assert all(abs(r.volumetric_strain - np.trace(green) / 3) < 1e-6 for r in strain)
    euler = C.elastic_strain(atoms, C.ideal_bonds(spark, typed, near, "FCC", 4.0), push_forward=True).collect()
    # the symmetric strain's invariants don't depend on which of the equivalent orientations the template took
    back = np.linalg.inv(f)
    assert all(abs(r.volumetric_strain - np.trace((np.eye(3) - back.T @ back) / 2) / 3) < 1e-6 for r in euler)
    rows = C.ordered_neighbors(spark, typed, near, F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])).collect()
    assert len(rows) == 108 * 12 and all(math.dist((r.dx, r.dy, r.dz), (r.ix, r.iy, r.iz)) < 0.2 for r in rows)
    assert max(r.disorientation for r in rows) < 2.0


@pytest.mark.parametrize("kind", list(BASES))
def test_a_perfect_crystal_is_one_cluster(spark, kind):
    atoms, cells = crystal(spark, kind, noise=0.02, cells=2 if kind == "CUBIC_DIAMOND" else 3)
    near = nearest_neighbors(atoms, cells, 18).cache()
    typed = C.template_matching(atoms, near).cache()
    assert {r.structure for r in typed.collect()} == {kind}
    bonds = C.orientation_bonds(typed, near.where("rank <= 6"))
    clusters = C.crystal_clusters(typed, bonds)
    if kind != "CUBIC_DIAMOND":
        assert clusters.select("cluster").distinct().count() == 1
    else:  # its two sublattices are turned against each other
        assert {r["size"] for r in clusters.collect()} == {32} or clusters.select("cluster").distinct().count() == 1
        assert {r.structure for r in C.structures_by_mode(atoms, near, "DIAMOND").collect()} == {kind}


def test_clusters_and_transitions_against_brute_force(spark):
    rng = np.random.default_rng(2)
    kind, turn = rng.integers(0, 3, 60), rng.uniform(-0.05, 0.05, (60, 3))
    rows = [(1, i, int(kind[i]), 0.05, *map(float, turn[i]), float(math.sqrt(1 - (turn[i] ** 2).sum()))) for i in range(60)]
    typed = spark.createDataFrame(rows, "frame int, id long, structure_type int, rmsd double, qx double, qy double, qz double, qw double")
    links = sorted({tuple(sorted(map(int, p))) for p in rng.integers(0, 60, (150, 2)) if p[0] != p[1]})
    pairs = spark.createDataFrame([(1, i, j) for i, j in links], "frame int, i long, j long")
    bonds = C.orientation_bonds(typed, pairs).cache()
    got = {r.id: r.cluster for r in C.crystal_clusters(typed, bonds).collect()}
    own = {i: i for i in range(60) if kind[i] > 0}
    theta = {(r.i, r.j): r.theta for r in bonds.collect()}
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if kind[i] == kind[j] > 0 and theta[i, j] <= 3.0 and own[i] != own[j]:
                own[i] = own[j] = min(own[i], own[j])
                changed = True
    assert got == own
    crossing = {(r.a, r.b): r.bonds for r in C.cluster_transitions(C.crystal_clusters(typed, bonds), pairs).collect()}
    want = {}
    for i, j in links:
        if i in own and j in own and own[i] != own[j]:
            key = tuple(sorted((own[i], own[j])))
            want[key] = want.get(key, 0) + 1
    assert crossing == want


def test_grains_below_the_least_size_have_no_number(spark):
    atoms = spark.createDataFrame([(f, i, 0.0, 0.0, 0.0) for f in (1, 2) for i in range(6)], ATOM)
    merges = spark.createDataFrame([(1, 4, 5, 0.1), (1, 0, 1, 0.2), (1, 1, 2, 0.9), (2, 2, 3, 0.1)], "frame int, a long, b long, log_distance double")
    got = {(r.frame, r.id): (r.grain, r["size"]) for r in C.merged_grains(atoms, merges, 0.5, 2).collect()}
    assert [got[1, i] for i in range(6)] == [(1, 2), (1, 2), (0, 1), (0, 1), (2, 2), (2, 2)] and got[2, 3] == (1, 2)


def test_first_and_second_neighbours_of_diamonds(spark):
    typed = spark.createDataFrame([(1, 0, 4), (1, 1, 0), (1, 2, 0), (1, 3, 0)], "frame int, id long, structure_type int")
    near = spark.createDataFrame([(1, a, b, 1) for a, b in ((0, 1), (1, 0), (1, 2), (2, 3))], "frame int, i long, j long, rank int")
    got = {r.id: r.marking for r in C.diamond_shells(typed, near).collect()}
    assert got == {0: None, 1: "CUBIC_DIAMOND_FIRST_NEIGHBOR", 2: "CUBIC_DIAMOND_SECOND_NEIGHBOR", 3: None}


def test_few_atoms_without_periodic_axes_keep_what_they_have(spark):
    atoms = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 9.0, 0.0, 0.0), (2, 7, 0.0, 0.0, 0.0)], ATOM)
    box = lambda f, p: (f, [10.0, 0.0, 0.0], [0.0, 10.0, 0.0], [0.0, 0.0, 10.0], [0.0] * 3, [p] * 3)
    near = nearest_neighbors(atoms, spark.createDataFrame([box(1, False), box(2, True)], CELL), 4).collect()
    assert sorted((r.i, r.j) for r in near if r.frame == 1) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert [round(r.d2) for r in near if r.frame == 2] == [100] * 4  # its own images


def test_mapped_displacements_leave_out_the_cell(spark):
    then = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0)], ATOM)
    now = spark.createDataFrame([(1, 0, 11.5, 2.2, 3.3)], ATOM)
    box = lambda e: spark.createDataFrame([(1, [e, 0.0, 0.0], [0.0, e, 0.0], [0.0, 0.0, e], [0.0] * 3, [True] * 3)], CELL)
    joined = deformation.reference_join(now, then)
    r = deformation.mapped_displacements(joined, box(10.0), box(11.0)).first()
    assert np.allclose((r.dx, r.dy, r.dz), ((11.5 / 11 - 0.1 - 1) * 10, 0.0, 0.0), atol=1e-9)
    s = deformation.mapped_displacements(joined, box(10.0), box(11.0), "current", minimum_image=False).first()
    assert np.allclose((s.dx, s.dy, s.dz), ((11.5 / 11 - 0.1) * 11, 0.0, 0.0), atol=1e-9)


def test_rays_boxes_and_circuits(spark):
    p = lambda *x: [F.lit(float(v)) for v in x]
    one = spark.range(1).select(
        G.ray_triangle(p(0.2, 0.2, -1), p(0, 0, 2), p(0, 0, 0), p(1, 0, 0), p(0, 1, 0)).alias("hit"), G.ray_triangle(p(0.9, 0.9, -1), p(0, 0, 2), p(0, 0, 0), p(1, 0, 0), p(0, 1, 0)).alias("miss"),
        G.ray_plane(p(0, 0, 1), p(0, 0, -1), p(0, 0, 1), F.lit(0.0)).alias("down"), G.boxes_meet(p(0, 0, 0), p(1, 1, 1), p(1, 1, 1), p(2, 2, 2)).alias("touch"), G.box_contains(p(2, 0, 0), p(0, 0, 0), p(1, 1, 1)).alias("out"),
        G.alpha_test([p(0, 0, 0), p(1, 0, 0), p(0, 1, 0), p(0, 0, 1)], 0.76).alias("good"), G.alpha_test([p(0, 0, 0), p(1, 0, 0), p(0, 1, 0), p(0, 0, 1)], 0.74).alias("bad"), G.alpha_test([p(0, 0, 0)] * 4, 1.0).alias("flat"),
        G.rotations_close(p(0, -1, 0, 1, 0, 0, 0, 0, 1), p(0, -1, 0, 1, 0, 0, 0, 0, 1), p(-1, 0, 0, 0, -1, 0, 0, 0, 1)).alias("closed"),
    ).first()
    assert (one.hit, one.miss, one.down, one.touch, one.out, one.good, one.bad, one.flat, one.closed) == (0.5, None, 1.0, True, False, True, False, None, True)


def test_a_periodic_mesh_is_drawn_in_one_piece(spark):
    points = spark.createDataFrame([(1, 0, 9.5, 0.0, 0.0), (1, 1, 0.5, 0.0, 0.0), (1, 2, 9.5, 1.0, 0.0), (1, 3, 1.0, 1.0, 0.0)], "mesh int, vertex long, x double, y double, z double")
    facets = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 1, 3, 2)], "mesh int, facet long, a long, b long, c long")
    drawn, faces = meshes.unwrapped_mesh(points, facets, [10.0] * 3)
    at = {r.point: (r.x, r.y) for r in drawn.collect()}
    assert sorted(at.values()) == sorted([(9.5, 0.0), (10.5, 0.0), (0.5, 0.0), (9.5, 1.0), (-0.5, 1.0), (1.0, 1.0)])
    for r in faces.collect():
        assert max(abs(at[a][0] - at[b][0]) for a, b in ((r.a, r.b), (r.a, r.c))) <= 1.5


def test_iterables_relations_and_exports(spark, tmp_path):
    docs = spark.createDataFrame([(1, ([1, 2], ["x"])), (2, (None, []))], "id int, payload struct<data:array<int>,rows:array<string>>")
    assert [r["items"] for r in D.resolve_iterable(docs, "payload", "rows").orderBy("id").collect()] == [["x"], []]
    assert [r["items"] for r in D.resolve_iterable(docs, "payload").orderBy("id").collect()] == [[1, 2], []]
    assert D.resolve_iterable(docs, "id").first()["items"] == []
    before = spark.createDataFrame([(1, ["a", "b", "a"]), (2, None)], "own int, refs array<string>")
    after = spark.createDataFrame([(1, ["b"]), (2, ["a"])], "own int, refs array<string>")
    assert sorted(map(tuple, D.relation_changes(before, after, "own", "refs", "target").collect())) == [("a", 1, "remove"), ("a", 2, "add")]
    assert {r.target: r.back for r in D.inverse_relations(before, "own", "refs", "target").collect()} == {"a": [1], "b": [1]}
    frames = spark.createDataFrame([(2, "x"), (1, "y")], "frame int, v string")
    D.write_exposures({"atoms": frames}, str(tmp_path / "out"), {"main": frames})
    back = spark.read.json(str(tmp_path / "out/exposures/atoms"))
    assert sorted((r.frame, r.v) for r in back.collect()) == [(1, "y"), (2, "x")] and spark.read.json(str(tmp_path / "out/listings/main")).count() == 2


def test_rows_are_numbered_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id % 7 as a", "id")
    got = [(r.a, r.id) for r in numbered(rows, [F.desc("a"), F.col("id")], "n").orderBy("n").collect()]
    assert got == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))
    assert numbered(rows.where("id < 0"), [F.col("id")], "n").count() == 0


def test_more_keys_than_columns_must_be_declared(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_COLUMNS", 2)
    rows = spark.createDataFrame([({"a": 1, "b": 2, "c": 3},)], "m map<string,int>")
    with pytest.raises(ValueError):
        D.expand_map(rows, "m", "v")
    assert D.expand_map(rows, "m", "v", ["c"]).first()[0] == 3


def test_solid_angles_are_what_faces_take_up():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(20, 18, 3))
    v *= (1 + rng.uniform(0, 1, (20, 18, 1))) / np.linalg.norm(v, axis=2, keepdims=True)
    v[3, 5] = 0.0
    got = C.solid_angles(v)
    assert np.allclose(got.sum(1), 4 * np.pi) and got.min() == 0.0 and got[3, 5] == 0.0
    x = rng.normal(size=(300_000, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in (0, 3):  # which face a ray meets first
        d = np.delete(v[i], 5, 0) if i == 3 else v[i]
        along = x @ d.T
        first = np.where(along > 1e-9, (d * d).sum(1) / 2 / np.maximum(along, 1e-9), np.inf).argmin(1)
        seen = np.bincount(first, minlength=len(d)) / len(x) * 4 * np.pi
        assert np.abs(seen - (np.delete(got[i], 5) if i == 3 else got[i])).max() < 0.03
    for kind, angles in {"SC": [2 * np.pi / 3] * 6, "FCC": [np.pi / 3] * 12, "HCP": [np.pi / 3] * 12}.items():
        assert np.allclose(C.solid_angles(C.lattice_vectors(kind)[None])[0], angles, atol=1e-6)
    body = C.solid_angles(C.lattice_vectors("BCC")[None])[0]
    assert np.allclose(body[:8], body[0]) and np.allclose(body[8:], body[-1]) and body[0] > 2 * body[-1] > 0
    open_side = C.solid_angles(np.array([[[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]]))[0]
    assert np.allclose(open_side, open_side[0], atol=1e-5) and open_side[0] < 4 * np.pi / 3
    assert C.solid_angles(np.zeros((2, 0, 3))).shape == (2, 0)


def test_shells_by_solid_angle_hold_what_distance_loses():
    """A body-centred atom with a far face neighbour: a nearer one behind the others takes its place by distance."""
    v = C.lattice_vectors("BCC").copy()
    v[-1] *= 1.15
    behind = (v[0] + v[1]) * 0.98  # between two of the first shell, all but hidden
    behind *= 1.1 / np.linalg.norm(behind)
    near = np.concatenate([v, behind[None], 3 * v[:3]])
    near = near[np.argsort(np.linalg.norm(near, axis=1), kind="stable")]
    places = C.by_solid_angle(near[None])[0]
    shell = near[places[:14]]
    assert all(np.abs(shell - w).max(1).min() < 1e-12 for w in v)
    found = C.identify(near[None], ["BCC", "FCC", "HCP", "SC"])
    assert found["kind"][0] == C.KINDS["BCC"] and sorted(found["order"][0]) == sorted(places[:14].tolist())


def _tried_in_full(shell, kind):
    """The assignment with the least sum of squares, every way to lay two vectors tried on all."""
    t = C._template(kind)
    n, v = len(t), shell / np.linalg.norm(shell, axis=1).mean()
    length = np.linalg.norm(t, axis=1)
    cosine = t @ t.T / np.outer(length, length)
    other = int(np.argmin(np.where(np.abs(cosine[0]) < 0.9, np.abs(length - length[0]) - 1e-3 * np.arange(n)[::-1] / n, 9)))
    unit, goal, best, chosen = v / np.linalg.norm(v, axis=1, keepdims=True), C._frames(t[:1], t[other : other + 1])[0], np.inf, None
    for i in range(n):
        for j in range(n):
            if i != j and abs(unit[i] @ unit[j] - cosine[0, other]) < 0.3:
                far = ((t @ (C._frames(v[i : i + 1], v[j : j + 1])[0].T @ goal).T)[:, None] - v[None]) ** 2
                at, cost = far.sum(-1).argmin(1), far.sum(-1).min(1).sum()
                if len(set(at.tolist())) == n and cost < best - 1e-12:
                    best, chosen = cost, at
    return best, chosen


def test_templates_are_matched_in_little_time_and_as_in_full():
    rng = np.random.default_rng(3)
    for kind in C.KINDS:
        turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
        turn *= np.sign(np.linalg.det(turn))
        for noise in (0.005, 0.08):
            v = C.lattice_vectors(kind) @ turn.T + rng.normal(0, noise, (3, C.SHELLS[kind], 3))
            for name in C.KINDS:
                shells = v[:, : C.SHELLS[name]]
                if shells.shape[1] < C.SHELLS[name]:
                    continue
                rmsd, _, _, order = C.match_template(shells, name)
                for k, shell in enumerate(shells):
                    cost, chosen = _tried_in_full(shell, name)
                    assert np.isfinite(cost) == np.isfinite(rmsd[k]) and (chosen is None or chosen.tolist() == order[k].tolist())
                    assert C._least_rmsd(shells[k : k + 1], name)[0] <= rmsd[k] + 1e-7
    axes = np.concatenate([np.eye(3), -np.eye(3)])
    shells = np.concatenate([C.lattice_vectors("FCC"), axes]) + rng.normal(0, 0.005, (2000, 18, 3))
    began = time.process_time()
    told = C.identify(shells, list(C.KINDS))
    assert (told["kind"] == C.KINDS["FCC"]).all() and time.process_time() - began < 4
