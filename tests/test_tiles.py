"""Tiles tell the pairs, counts and clusters that the join of all pairs gives, without its rows."""

import numpy as np
import pytest

from atomweave.operators import neighbors, structure
from atomweave.operators.neighbors import counted_within, cutoff_neighbors, pairs_within, spanning_links

CELLS = [
    (np.diag([4.0, 5.0, 6.0]), (True, True, True), 1.1),
    ([[4, 0, 0], [0.5, 4, 0], [0, -0.7, 4]], (True, False, True), 0.9),
    (np.diag([1.5, 1.7, 2.0]), (True, True, True), 2.2),
]


def frames(spark, cell, pbc, n=250):
    p = np.random.default_rng(8).uniform(-0.1, 1.1, (2 * n, 3)) @ np.array(cell, float)
    rows = [(i % 2, i, *map(float, x)) for i, x in enumerate(p)] + [(0, 10**6, None, 0.0, 0.0), (0, 10**6 + 1, float("nan"), 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "frame int, id long, x double, y double, z double")
    box = [list(map(float, v)) for v in cell]
    cells = spark.createDataFrame([(f, *box, [0.0] * 3, list(pbc)) for f in (0, 1)], "frame int, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>")
    return atoms, cells


@pytest.mark.parametrize("cell, pbc, cutoff", CELLS)
def test_tiles_tell_all_pairs(spark, monkeypatch, cell, pbc, cutoff):
    monkeypatch.setattr(neighbors, "PER_TILE", 20)
    atoms, cells = frames(spark, cell, pbc, 60 if cutoff > 2 else 250)
    value = lambda df: {(r.frame, r.i, r.j, r.sx, r.sy, r.sz): (r.dx, r.dy, r.dz, r.d2) for r in df.collect()}
    got, want = value(pairs_within(atoms, cells, cutoff)), value(cutoff_neighbors(atoms, cells, cutoff))
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert pairs_within(atoms, cells, cutoff).count() == len(want)
    counts = {(r.frame, r.id): r["count"] for r in counted_within(atoms, cells, cutoff).collect()}
    assert len(counts) == atoms.count() - 2 and sum(counts.values()) == len(want)
    told = structure.coordination(atoms, cutoff_neighbors(atoms, cells, cutoff))
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, structure.coordination_within(atoms, cells, cutoff).collect()))


@pytest.mark.parametrize("cell, pbc, cutoff", [(c, p, 0.45 if r < 2 else r) for c, p, r in CELLS])
def test_spanning_links_give_the_clusters_of_all_pairs(spark, monkeypatch, cell, pbc, cutoff):
    monkeypatch.setattr(neighbors, "PER_TILE", 20)
    atoms, cells = frames(spark, cell, pbc)
    links, pairs = spanning_links(atoms, cells, cutoff), cutoff_neighbors(atoms, cells, cutoff)
    told = lambda d: sorted(map(tuple, structure.clusters(atoms, d).collect()))
    assert told(links) == told(pairs)
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, spanning_links(atoms.repartition(7, "x"), cells, cutoff).collect()))
    assert links.where("i >= j").count() == 0
    known = {(r.frame, r.i, r.j, round(r.dx, 6), round(r.dy, 6), round(r.dz, 6)) for r in pairs.collect()}
    assert all((r.frame, r.i, r.j, round(r.dx, 6), round(r.dy, 6), round(r.dz, 6)) in known for r in links.collect())
    if cutoff < 2:
        near = {(r.frame, r.id): (r.cluster, r.ux, r.uy, r.uz) for r in structure.unwrapped_clusters(atoms, links).collect()}
        whole = structure.unwrapped_clusters(atoms, pairs)
        endless = {tuple(r) for r in structure.percolating_clusters(whole, pairs).collect()}
        rows = [r for r in whole.where("ux IS NOT NULL AND NOT isnan(ux)").collect() if (r.frame, r.cluster) not in endless]
        assert len(rows) > 50 and all(np.allclose(near[r.frame, r.id], (r.cluster, r.ux, r.uy, r.uz), atol=1e-9) for r in rows)


@pytest.mark.parametrize("cell, pbc, cutoff", [(c, p, 0.45 if r < 2 else r) for c, p, r in CELLS])
def test_parts_of_tiles_give_the_clusters_of_all_pairs(spark, monkeypatch, cell, pbc, cutoff):
    monkeypatch.setattr(neighbors, "PER_TILE", 20)
    atoms, cells = frames(spark, cell, pbc)
    told = lambda d: sorted(map(str, d.collect()))
    for reach in (cutoff, cutoff / 2):
        assert told(structure.clusters_within(atoms, cells, reach)) == told(structure.clusters(atoms, cutoff_neighbors(atoms, cells, reach)))


def test_parts_of_tiles_contract_few_links(spark, monkeypatch):
    """In a dense frame links between parts of tiles are few, however many atoms there are."""
    seen, whole = [], neighbors.connected_components
    monkeypatch.setattr(neighbors, "connected_components", lambda links: (seen.append(links.count()), whole(links))[1])
    atoms, cells = frames(spark, np.eye(3) * 4, (True, True, True), 1200)
    assert len({r.root for r in neighbors.parts_within(atoms, cells, 1.2).collect()}) <= 2 and seen[0] < 100


def test_links_grow_with_atoms_not_with_pairs(spark):
    """Twelve times the atoms of a frame have 144 times the pairs; the links stay below the rows of the tiles."""
    for n in (100, 1200):
        atoms, cells = frames(spark, np.eye(3) * 4, (True, True, True), n)
        assert spanning_links(atoms, cells, 1.2).count() < 6 * 2 * n
    assert cutoff_neighbors(atoms, cells, 1.2).count() > 100 * 2 * n


def test_cutoffs_must_be_positive(spark):
    atoms, cells = frames(spark, np.eye(3), (True, True, True), 2)
    for f in (pairs_within, counted_within, spanning_links):
        with pytest.raises(ValueError):
            f(atoms, cells, 0.0)


def test_coincident_atoms_are_linked_or_not(spark):
    atoms, cells = frames(spark, np.eye(3) * 4, (True, True, True), 1)
    twins = atoms.sparkSession.createDataFrame([(0, 5, 1.0, 1.0, 1.0), (0, 6, 1.0, 1.0, 1.0), (0, 7, 1.2, 1.0, 1.0)], "frame int, id long, x double, y double, z double")
    links = lambda **k: {(r.i, r.j) for r in spanning_links(twins, cells, 0.5, **k).collect()}
    assert len(links()) == 2 and links(coincident=False) == {(5, 7), (6, 7)}


def test_merged_grains_of_the_query_are_those_of_all_pairs(spark):
    import math
    import os

    from atomweave.operators import crystal
    from atomweave.plans import crystal_queries as q

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    a, c = q._frames(spark, sf)
    merges = cutoff_neighbors(a, c, q._LINK).where("i < j").selectExpr("frame", "i AS a", "j AS b", "log(sqrt(d2)) AS log_distance")
    want = crystal.merged_grains(a, merges, math.log(0.45), q._LEAST)
    assert sorted(map(tuple, q.x18(spark, sf).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name, absent", [("j1_cutoff_neighbors", "Join"), ("a1_coordination", "wx")])
def test_queries_shuffle_atoms_not_pairs(spark, name, absent):
    """Plans without a join on bins: what the tiles tell is neither joined nor, for pairs, shuffled."""
    import os

    from atomweave.plans import registry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in top and absent not in top
