"""Queries on crystals whose sites come from orders: structures, lattice clusters, grains, paths, tessellations."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.functions.scalars import STRUCTURE_COLORS
from atomweave.operators import crystal, grains, lattices, particles, structure, tessellation
from atomweave.operators.neighbors import cutoff_neighbors, nearest_neighbors
from atomweave.plans.particle_queries import _PAIRS, _frames
from atomweave.session import cut, export_by
from atomweave.sources.adapters import CRYSTAL_SQL, LAMELLA, crystal_atoms, crystal_cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


BOND = 1.2
_STACK = lambda l: f"CASE WHEN frame = 0 THEN ({l}) % 3 WHEN frame = 1 THEN ({l}) % 2 ELSE least(({l}) % {2 * LAMELLA}, {2 * LAMELLA} - ({l}) % {2 * LAMELLA}) % 3 END"
#: Sites with ideal positions, their near pairs by nearest images, and what they are: an inner atom of a stack is hexagonal
#: if the layers above and below it are stacked alike. Clusters are what lies between two twin planes, or a plane.
SITES = f"""c AS ({CRYSTAL_SQL}),
p AS (SELECT *, CASE WHEN frame = 2 THEN r % 4 + (l % 2) * 5e-1 ELSE (r // 2) % 4 + (r % 2) * 5e-1 + o * 5e-1 END AS x, CASE WHEN frame = 2 THEN r // 4 + (l % 2) * 5e-1 ELSE ((r // 2) // 4 + (r % 2) * 5e-1) * sqrt(3e0) + o * sqrt(3e0) / 6 END AS y,
  CASE WHEN frame = 2 THEN l * 5e-1 ELSE l * sqrt(2e0 / 3e0) END AS z, CASE WHEN frame = 2 THEN 4e0 ELSE 2 * sqrt(3e0) END AS depth FROM c),
raw AS (SELECT a.frame, a.id AS i, b.id AS j, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, a.depth FROM p a, (SELECT unnest([-2, -1, 0, 1, 2]) AS dl) d, p b WHERE b.frame = a.frame AND b.l = a.l + d.dl AND a.id <> b.id),
bond AS (SELECT * FROM (SELECT frame, i, j, dx - 4 * floor(dx / 4 + 5e-1) AS dx, dy - depth * floor(dy / depth + 5e-1) AS dy, dz FROM raw) WHERE dx * dx + dy * dy + dz * dz < {BOND * BOND!r}),
n AS (SELECT i, count(*) AS n FROM bond GROUP BY i),
t AS (SELECT p.*, CASE WHEN frame = 2 THEN CASE WHEN n = 14 THEN 3 ELSE 0 END WHEN n = 12 THEN CASE WHEN {_STACK('l + 1')} = {_STACK('l - 1')} THEN 2 ELSE 1 END ELSE 0 END AS kind FROM p LEFT JOIN n ON n.i = p.id),
k AS (SELECT *, min(id) OVER w AS cluster, count(*) OVER w AS size FROM t WHERE kind > 0 WINDOW w AS (PARTITION BY frame, kind, CASE WHEN frame < 3 THEN 0 WHEN kind = 2 THEN l ELSE l // {LAMELLA} END))"""
_NAME = "['OTHER', 'FCC', 'HCP', 'BCC'][kind + 1]"


def _crystal(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = cut(crystal_atoms(spark, sf_dir), "crystal")
    return a, crystal_cells(a)


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, c = _crystal(spark, sf_dir)
    return a, c, cut(nearest_neighbors(a, c, crystal.CANDIDATES), "nearest")


KINDS = ("FCC", "HCP", "BCC")


@query("a9_structure_statistics", f"WITH {SITES} SELECT frame, {_NAME} AS structure, count(*) AS atoms, round(count(*) * 1e2 / sum(count(*)) OVER (PARTITION BY frame), 6) AS percentage FROM t GROUP BY frame, kind")
def a9(spark, sf_dir):
    a, _, near = _near(spark, sf_dir)
    return structure.structure_statistics(structure.local_structure(a, near)).withColumn("percentage", F.round("percentage", 6))


@query("a9_identification", f"WITH {SITES} SELECT frame, count(*) FILTER (WHERE kind > 0) AS identified, count(*) FILTER (WHERE kind = 0) AS unidentified, round(avg(CAST(kind > 0 AS INT)), 6) AS rate, count(DISTINCT kind) FILTER (WHERE kind > 0) AS structures FROM t GROUP BY frame")
def a9b(spark, sf_dir):
    a, _, near = _near(spark, sf_dir)
    return structure.identification(structure.local_structure(a, near)).withColumn("rate", F.round("rate", 6))


@query("x9_template_matching", f"WITH {SITES} SELECT frame, id, kind AS structure_type, {_NAME} AS structure FROM t")
def x9(spark, sf_dir):
    a, _, near = _near(spark, sf_dir)
    return crystal.template_matching(a, near).select("frame", "id", "structure_type", "structure")


@query("x10_structures_by_mode", f"WITH {SITES} SELECT frame, {_NAME} AS structure, count(*) AS atoms, mode FROM t, (SELECT unnest(['CNA', 'PTM']) AS mode) GROUP BY frame, kind, mode")
def x10(spark, sf_dir):
    a, _, near = _near(spark, sf_dir)
    modes = [crystal.structures_by_mode(a, near, m).groupBy("frame", "structure").agg(F.count("*").alias("atoms")).withColumn("mode", F.lit(m)) for m in ("CNA", "PTM")]
    return modes[0].unionByName(modes[1])


@query("x34_ordered_neighbors", f"WITH {SITES} SELECT frame, id, CASE WHEN kind = 3 THEN 14 ELSE 12 END AS n, true AS fits FROM t WHERE kind > 0")
def x34(spark, sf_dir):
    """Each atom's neighbours in template order: how many, and whether all are where the template says."""
    a, _, near = _near(spark, sf_dir)
    told = crystal.ordered_neighbors(spark, crystal.template_matching(a, near, kinds=KINDS), near)
    off = F.greatest(*[F.abs(F.col(f"d{c}") - F.col(f"i{c}")) for c in "xyz"])
    return told.groupBy("frame", "id").agg(F.count("*").alias("n"), (F.max(off) < 0.05).alias("fits"))


def _lattice(spark, sf_dir):
    """Atoms, cells, pairs, identified atoms, shells and lattice clusters by common neighbours."""
    a, c, near = _near(spark, sf_dir)
    typed = cut(lattices.ordered_structures(structure.local_structure(a, near), near), "ordered")
    shells = cut(lattices.lattice_shells(typed, near), "shells")
    clusters = cut(lattices.lattice_clusters(shells, lattices.lattice_bonds(shells)), "clusters")
    return a, c, shells, clusters, cut(lattices.lattice_neighbors(clusters, shells), "neighbors")


@query("x11_lattice_clusters", f"WITH {SITES} SELECT frame, cluster, kind, size, CASE WHEN kind = 3 THEN 1e0 ELSE 28e-1 END AS volume FROM k GROUP BY ALL")
def x11(spark, sf_dir):
    """Clusters with the volume of their lattice's cubic cell, by their orientation."""
    *_, clusters, neighbors = _lattice(spark, sf_dir)
    m = [F.col(f"m{k}") for k in range(9)]
    volume = lattices.cluster_orientations(neighbors).select("frame", "cluster", F.round(lattices._det(m), 1).alias("volume"))
    return clusters.select("frame", "cluster", "kind", "size").distinct().join(volume, ["frame", "cluster"])


@query("x12_crystal_clusters", f"WITH {SITES} SELECT frame, id, cluster, size FROM k")
def x12(spark, sf_dir):
    a, c, near = _near(spark, sf_dir)
    typed = cut(crystal.template_matching(a, near, kinds=KINDS), "matched")
    return crystal.crystal_clusters(typed, crystal.orientation_bonds(typed, cutoff_neighbors(a, c, BOND)))


_CROSSING = f"WITH {SITES}, x AS (SELECT a.frame, a.cluster AS a, b.cluster AS b, count(*) AS bonds FROM bond JOIN k a ON a.id = bond.i JOIN k b ON b.id = bond.j WHERE a.cluster < b.cluster GROUP BY 1, 2, 3)"


@query("x13_cluster_transitions", _CROSSING + " SELECT frame, a, b, bonds, true AS rotation FROM x")
def x13(spark, sf_dir):
    *_, clusters, neighbors = _lattice(spark, sf_dir)
    return lattices.lattice_transitions(neighbors, clusters).select("frame", "a", "b", "bonds", F.col("t0").isNotNull().alias("rotation"))


@query("x13_super_clusters", f"WITH {SITES} SELECT DISTINCT frame, cluster, cluster AS parent FROM k")
def x13b(spark, sf_dir):
    """What lies between two twin planes is turned against what is beyond, so no plane joins its sides."""
    *_, clusters, neighbors = _lattice(spark, sf_dir)
    return lattices.super_clusters(clusters, lattices.lattice_transitions(neighbors, clusters), crystal.KINDS["FCC"])


@query(
    "k8_cluster_graph",
    _CROSSING
    + """ SELECT DISTINCT frame, 'cluster' AS kind, cluster AS a, '{"id":' || cluster || ',"size":' || size || '}' AS document FROM k
UNION ALL SELECT frame, 'transition', a, '{"cluster1":' || a || ',"cluster2":' || b || ',"bonds":' || bonds || '}' FROM x""",
)
def k8(spark, sf_dir):
    *_, clusters, neighbors = _lattice(spark, sf_dir)
    transitions = lattices.lattice_transitions(neighbors, clusters).select("frame", "a", "b", "bonds")
    return crystal.cluster_graph_document(clusters.select("frame", "id", "cluster"), transitions)


#: The cubic axes of the stacks' first lamella: z is a body diagonal, x a face diagonal.
PREFERRED = [*[v / math.sqrt(2) for v in (-1, 1, 0)], *[v / math.sqrt(6) for v in (-1, -1, 2)], *[v / math.sqrt(3) for v in (1, 1, 1)]]


@query("x14_preferred_orientations", f"WITH {SITES} SELECT DISTINCT frame, cluster, frame = 0 OR (l // {LAMELLA}) % 2 = 0 AS aligned FROM k WHERE kind = 1")
def x14(spark, sf_dir):
    """Which lamellae can take the first one's axes: every other one."""
    *_, clusters, neighbors = _lattice(spark, sf_dir)
    _, turned = lattices.preferred_orientations(clusters, lattices.cluster_orientations(neighbors), crystal.KINDS["FCC"], [PREFERRED])
    off = F.greatest(*[F.abs(F.col(f"m{k}") / math.sqrt(2) - F.lit(PREFERRED[k])) for k in range(9)])
    return turned.where(F.col("kind") == crystal.KINDS["FCC"]).select("frame", "cluster", (off < 0.05).alias("aligned"))


_STEP = "e AS (SELECT bond.frame, i, j, dx, dy, dz FROM bond JOIN t a ON a.id = bond.i JOIN t b ON b.id = bond.j WHERE a.kind > 0 OR b.kind > 0)"
_AHEAD = 2 * 16 * 4


@query(
    "j13_crystal_paths",
    f"""WITH {SITES}, {_STEP}, w1 AS (SELECT i AS a, j AS b FROM e), w2 AS (SELECT DISTINCT a, j AS b FROM w1 JOIN e ON e.i = w1.b), w3 AS (SELECT DISTINCT a, j AS b FROM w2 JOIN e ON e.i = w2.b), w4 AS (SELECT DISTINCT a, j AS b FROM w3 JOIN e ON e.i = w3.b),
far AS (SELECT a, b, min(n) AS length FROM (SELECT a, b, 1 AS n FROM w1 UNION ALL SELECT a, b, 2 FROM w2 UNION ALL SELECT a, b, 3 FROM w3 UNION ALL SELECT a, b, 4 FROM w4) WHERE b = a + {_AHEAD} GROUP BY 1, 2),
v AS (SELECT p.frame, a, length, q.x - p.x AS dx, q.y - p.y AS dy, q.z - p.z AS dz, p.depth FROM far JOIN p ON p.id = a JOIN p q ON q.id = b)
SELECT frame, a, length, round((pow(dx - 4 * floor(dx / 4 + 5e-1), 2) + pow(dy - depth * floor(dy / depth + 5e-1), 2) + dz * dz) * CASE WHEN frame = 2 THEN 1 ELSE 5e-1 END, 3) AS squared FROM v""",
)
def j13(spark, sf_dir):
    """From every site to the one two layers above: the shortest way and the square of its ideal vector."""
    a, _, _, clusters, neighbors = _lattice(spark, sf_dir)
    ends = a.select("frame", F.col("id").alias("a"), (F.col("id") + _AHEAD).alias("b")).join(a.select("frame", F.col("id").alias("b")), ["frame", "b"], "left_semi")
    found = lattices.crystal_paths(ends, neighbors, lattices.lattice_transitions(neighbors, clusters))
    squared = F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz")
    return found.select("frame", "a", "length", F.round(squared, 3).alias("squared"))


@query("x17_coherent_interfaces", f"WITH {SITES} SELECT frame, CASE WHEN frame = 3 AND kind = 2 THEN 1 ELSE kind END AS structure_type, count(*) AS atoms FROM t GROUP BY ALL")
def x17(spark, sf_dir):
    a, c, near = _near(spark, sf_dir)
    typed = cut(crystal.template_matching(a, near, kinds=KINDS), "matched")
    return grains.coherent_interfaces(typed, cutoff_neighbors(a, c, BOND)).groupBy("frame", "structure_type").agg(F.count("*").alias("atoms"))


def _segmented(spark, sf_dir):
    a, c, near = _near(spark, sf_dir)
    typed = cut(crystal.template_matching(a, near, kinds=KINDS), "matched")
    return typed, *grains.segment_grains(a, typed, cutoff_neighbors(a, c, BOND), least=10, interfaces=False)


@query("x16_dendrogram")
def x16(spark, sf_dir):
    """The merges of the crystals' bonds; held against merging one pair at a time in the tests."""
    return _segmented(spark, sf_dir)[2].select("frame", "a", "b", F.round("distance", 6).alias("distance"), "size_a", "size_b", F.round("merge_size", 6).alias("merge_size"))


@query("x18_segmented_grains")
def x18(spark, sf_dir):
    return _segmented(spark, sf_dir)[1]


@query("a10_grain_orientations")
def a10(spark, sf_dir):
    typed, found, _, limits = _segmented(spark, sf_dir)
    return grains.grain_table(found, typed).join(limits.select("frame", "threshold"), "frame")


_REACH = 1.5
_J = lambda c, k: f"{_REACH * tessellation.JITTER!r} * ((({c} * {tessellation.SPREAD[k][0]}) % {tessellation.SPREAD[k][1]}) / {tessellation.SPREAD[k][1]}e0 - 5e-1)"
#: A tetrahedron's vectors are e, f, g ("by" is a word of SQL).
_NBR = ", ".join(f"d{c} + {_J('j', k)} - {_J('i', k)} AS d{c}" for k, c in enumerate("xyz"))
_CROSS = lambda u, v: [f"({u}y * {v}z - {u}z * {v}y)", f"({u}z * {v}x - {u}x * {v}z)", f"({u}x * {v}y - {u}y * {v}x)"]
_SQ = lambda u: f"({u}x * {u}x + {u}y * {u}y + {u}z * {u}z)"
_CENTER = ", ".join(f"({_SQ('e')} * {_CROSS('f', 'g')[k]} + {_SQ('f')} * {_CROSS('g', 'e')[k]} + {_SQ('g')} * {_CROSS('e', 'f')[k]}) / (2 * det) AS m{x}" for k, x in enumerate("xyz"))
_APART = lambda u, v: f"{' + '.join(f'pow({u}.d{c} - {v}.d{c}, 2)' for c in 'xyz')} <= {_REACH * _REACH!r}"


@query(
    "x19_delaunay",
    f"""WITH {_PAIRS}, nbr AS (SELECT frame, i, j, {_NBR} FROM near WHERE d2 <= {_REACH * _REACH!r} AND d2 > 0),
up AS (SELECT * FROM nbr WHERE j > i),
trio AS (SELECT a.frame, a.i AS v0, a.j AS v1, b.j AS v2, c.j AS v3, {', '.join(f'{u}.d{x} AS {n}{x}' for u, n in zip('abc', 'efg') for x in 'xyz')} FROM up a JOIN up b ON a.i = b.i AND a.j < b.j AND {_APART('a', 'b')} JOIN up c ON c.i = a.i AND b.j < c.j AND {_APART('a', 'c')} AND {_APART('b', 'c')}),
d AS (SELECT *, {' + '.join(f'e{x} * {y}' for x, y in zip('xyz', _CROSS('f', 'g')))} AS det FROM trio),
m AS (SELECT *, {_CENTER} FROM d WHERE abs(det) > 1e-14),
s AS (SELECT *, mx * mx + my * my + mz * mz AS r2 FROM m WHERE 4 * (mx * mx + my * my + mz * mz) <= {_REACH * _REACH!r}),
full_ AS (SELECT DISTINCT s.v0, s.v1, s.v2, s.v3 FROM s JOIN nbr e ON e.i = s.v0 AND e.j NOT IN (s.v1, s.v2, s.v3) WHERE pow(e.dx - mx, 2) + pow(e.dy - my, 2) + pow(e.dz - mz, 2) < r2 * (1 - 1e-12))
SELECT frame, v0, v1, v2, v3, round(2 * sqrt(r2), 5) AS diameter FROM s ANTI JOIN full_ USING (v0, v1, v2, v3)""",
)
def x19(spark, sf_dir):
    """Tetrahedra of the particle frames with spheres up to 1.5 across."""
    tets = tessellation.delaunay(*_frames(spark, sf_dir), _REACH)
    v = F.array_sort(F.array("v1", "v2", "v3"))
    return tets.select("frame", "v0", *[F.get(v, F.lit(k)).alias(f"v{k + 1}") for k in range(3)], F.round("diameter", 5).alias("diameter"))


def _elastic(spark, sf_dir):
    a, c, _, clusters, neighbors = _lattice(spark, sf_dir)
    tets = cut(tessellation.delaunay(a, c, 2.2), "tetrahedra")
    edges = cut(tessellation.tessellation_edges(tets), "edges")
    transitions = cut(lattices.lattice_transitions(neighbors, clusters), "transitions")
    spread = tessellation.vertex_clusters(edges, clusters)
    ideal = cut(tessellation.ideal_edges(edges, spread, neighbors, transitions), "ideal")
    return tets, spread, ideal, transitions


@query(
    "x21_ideal_edges",
    f"""WITH {SITES} SELECT bond.frame, round((bond.dx * bond.dx + bond.dy * bond.dy + bond.dz * bond.dz) * CASE WHEN bond.frame = 2 THEN 1 ELSE 5e-1 END, 2) AS squared, count(*) AS edges
FROM bond JOIN k a ON a.id = bond.i JOIN k b ON b.id = bond.j WHERE i < j GROUP BY 1, 2""",
)
def x21(spark, sf_dir):
    """The edges between atoms of the crystal that are lattice bonds, by the square of their ideal vector: all bonds are edges."""
    _, spread, ideal, _ = _elastic(spark, sf_dir)
    known = spread.where("known").select("frame", "id")
    inner = ideal.join(known.withColumnRenamed("id", "a"), ["frame", "a"], "left_semi").join(known.withColumnRenamed("id", "b"), ["frame", "b"], "left_semi")
    squared = F.round(F.col("lx") * F.col("lx") + F.col("ly") * F.col("ly") + F.col("lz") * F.col("lz"), 2)
    inner = inner.select("frame", squared.alias("squared")).where(F.col("squared") <= F.when(F.col("frame") == 2, 1.2).otherwise(0.8))
    return inner.groupBy("frame", "squared").agg(F.count("*").alias("edges"))


@query("x23_interface_mesh")
def x23(spark, sf_dir):
    """The surface of the crystals' good tetrahedra: per frame its facets, points, and half edges without an opposite (none)."""
    tets, _, ideal, transitions = _elastic(spark, sf_dir)
    mesh = cut(tessellation.interface_mesh(tessellation.good_tetrahedra(tets, ideal, transitions)), "mesh")
    halves = cut(tessellation.half_edges(mesh), "halves")
    points = tessellation.manifold(mesh, halves).groupBy("frame").agg(F.countDistinct("facet").alias("facets"), F.countDistinct("vertex", "point").alias("points"))
    return points.join(halves.groupBy("frame").agg(F.count(F.when(F.col("opposite").isNull(), 1)).alias("open")), "frame")


@query("k2_structures_by_name", f"WITH {SITES} SELECT {_NAME} AS structure, frame, count(*) AS atoms, min(id) AS first FROM t GROUP BY kind, frame")
def k2(spark, sf_dir):
    """Atoms by structure, written to a folder of each name and read back from there."""
    a, _, near = _near(spark, sf_dir)
    typed = structure.local_structure(a, near).join(a, ["frame", "id"])
    path = export_by(typed.select("frame", "structure", "id", F.array("x", "y", "z").alias("pos")), ["structure"], "structures")
    return spark.read.parquet(path).groupBy("structure", "frame").agg(F.count("*").alias("atoms"), F.min("id").alias("first"))


@query("x15_lattice_strain", f"WITH {SITES} SELECT frame, id, true AS stretched FROM t WHERE kind > 0")
def x15(spark, sf_dir):
    """Crystals stretched by a fiftieth along z: the strain of every lattice says so, whatever its orientation."""
    a, c, near = _near(spark, sf_dir)
    typed = cut(crystal.template_matching(a, near, kinds=KINDS), "matched")
    pulled = near.withColumn("dz", F.col("dz") * 1.02)
    edge = {"FCC": math.sqrt(2.0), "HCP": 1.0, "BCC": 1.0}
    bonds = None
    for kind in KINDS:
        part = crystal.ideal_bonds(spark, typed, pulled, kind, edge[kind])
        bonds = part if bonds is None else bonds.unionByName(part)
    strained = crystal.elastic_strain(a, bonds, push_forward=True)
    told = strained.join(typed.where("structure_type > 0").select("frame", "id"), ["frame", "id"], "left_semi")
    off = F.abs(F.get("strain_tensor", F.lit(2)) - (1 - 1 / 1.02**2) / 2)
    return told.select("frame", "id", ((off < 0.02) & (F.abs(F.get("strain_tensor", F.lit(0))) < 0.02)).alias("stretched"))


_PALETTE = "[" + ", ".join("'" + ",".join(map(str, STRUCTURE_COLORS[n])) + "'" for n in ("OTHER", "FCC", "HCP", "BCC")) + "]"


@query("x33_structure_colors", f"WITH {SITES} SELECT frame, id, {_NAME} AS structure, {_PALETTE}[kind + 1] AS color FROM t")
def x33(spark, sf_dir):
    a, _, near = _near(spark, sf_dir)
    told = particles.structure_colors(structure.local_structure(a, near))
    return told.select("frame", "id", "structure", F.array_join(F.col("color").cast("array<string>"), ",").alias("color"))
