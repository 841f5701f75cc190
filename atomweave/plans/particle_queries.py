"""Queries on particle frames made from line items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomweave.functions import cell as C
from atomweave.functions import linalg as L
from atomweave.functions import scalars as S
from atomweave.operators import crystal, deformation, particles, structure
from atomweave.operators import lines as dislocations
from atomweave.operators.neighbors import nearest_neighbors, pairs_within, spanning_links
from atomweave.session import cut
from atomweave.sources.adapters import ATOMS_SQL, BOX, atoms, cube_cells, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUTOFF = 1.2


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = cut(atoms(spark, sf_dir), "atoms")  # each branch of a plan would sum them up anew
    return a, cube_cells(a)


def _image(d: str) -> str:
    return f"({d}) - 2e1 * floor(({d}) / 2e1 + 5e-1)"


_ATOMS = f"fr AS ({ATOMS_SQL})"
#: Near pairs by nearest images: equal to all images while the cutoff is below half the box.
#: Slabs are two wide; three to each side hold the nearest neighbours of sparse frames too.
_PAIRS = f"""{_ATOMS}, grid AS (SELECT *, CAST(floor(x / 2e0) AS INT) gx FROM fr),
halo AS (SELECT g.*, (g.gx + o.o + 10) % 10 AS tx FROM grid g, (SELECT unnest([-3, -2, -1, 0, 1, 2, 3]) AS o) o),
delta AS (SELECT p.frame AS frame, p.id AS i, q.id AS j, {_image('q.x - p.x')} AS dx, {_image('q.y - p.y')} AS dy, {_image('q.z - p.z')} AS dz
  FROM halo p JOIN grid q ON q.frame = p.frame AND q.gx = p.tx AND p.id <> q.id),
near AS (SELECT *, dx * dx + dy * dy + dz * dz AS d2 FROM delta)"""


@query("j1_cutoff_neighbors", f"WITH {_PAIRS} SELECT frame, i, j, round(d2, 6) AS d2 FROM near WHERE d2 <= {CUTOFF * CUTOFF!r}")
def j1(spark, sf_dir, frames=_frames, by=("frame",)):
    return pairs_within(*frames(spark, sf_dir), CUTOFF, ("i", "j", "d2")).select(*by, "i", "j", F.round("d2", 6).alias("d2"))


@query("a1_coordination", f"WITH {_PAIRS} SELECT fr.frame, fr.id, count(near.i) AS coordination FROM fr LEFT JOIN near ON near.i = fr.id AND near.d2 <= {CUTOFF * CUTOFF!r} GROUP BY fr.frame, fr.id")
def a1(spark, sf_dir, frames=_frames, by=("frame",)):
    a, c = frames(spark, sf_dir)
    return structure.coordination_within(a, c, CUTOFF).select(*by, "id", "coordination")


_BINS = 60


@query(
    "a2_rdf",
    f"""WITH {_PAIRS}, hist AS (SELECT frame, CAST(floor(sqrt(d2) / {(CUTOFF + 1e-12) / _BINS!r}) AS INT) AS bin, count(*) AS c FROM near WHERE d2 <= {CUTOFF * CUTOFF!r} GROUP BY 1, 2),
n AS (SELECT frame, count(*) AS n FROM fr GROUP BY 1)
SELECT n.frame, CAST(b.bin AS INT) AS bin, coalesce(c, 0) AS pairs, round(coalesce(c, 0) / (4e0 / 3e0 * pi() * (n / 8e3) * n * (pow((b.bin + 1) * {CUTOFF / _BINS!r}, 3) - pow(b.bin * {CUTOFF / _BINS!r}, 3))), 6) AS g
FROM (SELECT unnest(range({_BINS})) AS bin) b CROSS JOIN n LEFT JOIN hist ON hist.bin = b.bin AND hist.frame = n.frame""",
)
def a2(spark, sf_dir, frames=_frames, by=("frame",)):
    a, c = frames(spark, sf_dir)
    return structure.radial_distribution_within(a, c, CUTOFF, _BINS).select(*by, "bin", "pairs", F.round("g", 6).alias("g"))


_KNN = f"""WITH {_PAIRS}, ranked AS (SELECT frame, i, j, d2, row_number() OVER (PARTITION BY i ORDER BY round(d2, 9), j) AS rank FROM near WHERE d2 > 0)"""


@query("j2_knn", _KNN + " SELECT frame, i, CAST(rank AS INT) AS rank, round(d2, 6) AS d2 FROM ranked WHERE rank <= 4")
def j2(spark, sf_dir, frames=_frames, by=("frame",)):
    return nearest_neighbors(*frames(spark, sf_dir), 4).select(*by, "i", "rank", F.round("d2", 6).alias("d2"))


_CSP_K = 4


@query(
    "x4_centrosymmetry",
    f"""WITH {_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d2, 9), j) AS rank FROM near WHERE d2 > 0),
k AS (SELECT * FROM ranked WHERE rank <= {_CSP_K}),
s AS (SELECT p.frame, p.i, (p.dx + q.dx) * (p.dx + q.dx) + (p.dy + q.dy) * (p.dy + q.dy) + (p.dz + q.dz) * (p.dz + q.dz) AS v FROM k p JOIN k q ON p.i = q.i AND p.rank < q.rank),
o AS (SELECT frame, i, v, row_number() OVER (PARTITION BY i ORDER BY v) AS r FROM s)
SELECT frame, i AS id, round(sum(v), 6) AS csp FROM o WHERE r <= {_CSP_K // 2} GROUP BY 1, 2""",
)
def x4(spark, sf_dir, frames=_frames, by=("frame",)):
    a, c = frames(spark, sf_dir)
    return structure.centrosymmetry(a, nearest_neighbors(a, c, _CSP_K), _CSP_K).select(*by, "id", F.round("csp", 6).alias("csp"))


@query(
    "x5_matching_centrosymmetry",
    f"""WITH {_PAIRS}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d2, 9), j) AS rank FROM near WHERE d2 > 0) WHERE rank <= 6),
s AS (SELECT p.i, p.rank AS p, q.rank AS q, (p.dx + q.dx) * (p.dx + q.dx) + (p.dy + q.dy) * (p.dy + q.dy) + (p.dz + q.dz) * (p.dz + q.dz) AS v FROM k p JOIN k q ON p.i = q.i AND p.rank < q.rank),
w AS (SELECT a.i, min(a.v + b.v + c.v) AS csp FROM s a JOIN s b ON b.i = a.i AND a.p = 1 AND b.p > 1 AND b.p <> a.q AND b.q <> a.q JOIN s c ON c.i = a.i AND c.p > b.p AND c.p NOT IN (a.q, b.q) AND c.q NOT IN (a.q, b.q) GROUP BY a.i)
SELECT fr.frame, fr.id, round(coalesce(csp, 0), 5) AS csp FROM fr LEFT JOIN w ON w.i = fr.id""",
)
def x5(spark, sf_dir):
    a, c = _frames(spark, sf_dir)
    return structure.matching_centrosymmetry(a, nearest_neighbors(a, c, 6), 6).select("frame", "id", F.round("csp", 5).alias("csp"))


@query("a27_farthest_neighbor", _KNN + " SELECT frame, round(sqrt(max(d2)), 6) AS max_distance FROM ranked WHERE rank <= 4 GROUP BY 1")
def a27(spark, sf_dir):
    return crystal.farthest_neighbor(nearest_neighbors(*_frames(spark, sf_dir), 4)).select("frame", F.round("max_distance", 6).alias("max_distance"))


@query(
    "a6_csp_histogram",
    f"""WITH {_PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d2, 9), j) AS rank FROM near WHERE d2 > 0),
k AS (SELECT * FROM ranked WHERE rank <= {_CSP_K}),
s AS (SELECT p.frame, p.i, (p.dx + q.dx) * (p.dx + q.dx) + (p.dy + q.dy) * (p.dy + q.dy) + (p.dz + q.dz) * (p.dz + q.dz) AS v FROM k p JOIN k q ON p.i = q.i AND p.rank < q.rank),
o AS (SELECT frame, i, v, row_number() OVER (PARTITION BY i ORDER BY v) AS r FROM s),
c AS (SELECT frame, i, sum(v ORDER BY r) AS csp FROM o WHERE r <= {_CSP_K // 2} GROUP BY 1, 2),
w AS (SELECT frame, max(csp) * 101e-2 / 100 AS width FROM c GROUP BY 1),
h AS (SELECT frame, CAST(floor(csp / width) AS INT) AS bin, count(*) AS atoms FROM c JOIN w USING (frame) GROUP BY 1, 2)
SELECT w.frame, CAST(b.bin AS INT) AS bin, coalesce(atoms, 0) AS atoms FROM w CROSS JOIN (SELECT unnest(range(100)) AS bin) b LEFT JOIN h ON h.frame = w.frame AND h.bin = b.bin""",
)
def a6(spark, sf_dir):
    a, c = _frames(spark, sf_dir)
    return structure.symmetry_histogram(structure.centrosymmetry(a, nearest_neighbors(a, c, _CSP_K), _CSP_K), by=["frame"])


_LINK = 0.55
_COMPONENTS = f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT i, j FROM near WHERE d2 <= {_LINK * _LINK!r}),
walk(id, root) AS (SELECT id, id FROM fr UNION SELECT e.j, w.root FROM walk w JOIN e ON e.i = w.id),
comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
sizes AS (SELECT frame, root, count(*) AS size FROM comp JOIN fr USING (id) GROUP BY frame, root),
ranked AS (SELECT frame, root, size, row_number() OVER (PARTITION BY frame ORDER BY size DESC, root) AS cluster FROM sizes)"""


def _clusters(spark, sf_dir, frames):
    a, c = frames(spark, sf_dir)
    return structure.clusters_within(a, c, _LINK)


@query("x1_clusters", _COMPONENTS + " SELECT r.frame, c.id, CAST(r.cluster AS INT) AS cluster, r.size FROM comp c JOIN ranked r USING (root)")
def x1(spark, sf_dir, frames=_frames, by=("frame",)):
    return _clusters(spark, sf_dir, frames).select(*by, "id", "cluster", "size")


@query("a3_cluster_sizes", _COMPONENTS + " SELECT frame, CAST(cluster AS INT) AS cluster, size FROM ranked")
def a3(spark, sf_dir, frames=_frames, by=("frame",)):
    return _clusters(spark, sf_dir, frames).select(*by, "cluster", "size").distinct()


#: Clusters of these sparse frames are smaller than half the box: each atom is at its image nearest to the first one.
_SHAPES = _COMPONENTS + f""", u AS (SELECT r.frame, r.cluster, s.x + {_image('fr.x - s.x')} AS x, s.y + {_image('fr.y - s.y')} AS y, s.z + {_image('fr.z - s.z')} AS z
  FROM comp c JOIN ranked r USING (root) JOIN fr ON fr.id = c.id JOIN fr s ON s.id = c.root)"""


def _shapes(spark, sf_dir):
    a, c = _frames(spark, sf_dir)
    return structure.cluster_shapes(structure.unwrapped_clusters(a, spanning_links(a, c, _LINK)))


@query("a4_cluster_centers", _SHAPES + " SELECT frame, CAST(cluster AS INT) AS cluster, count(*) AS size, round(avg(x), 5) AS cx, round(avg(y), 5) AS cy, round(avg(z), 5) AS cz FROM u GROUP BY 1, 2")
def a4(spark, sf_dir):
    return _shapes(spark, sf_dir).select("frame", "cluster", "size", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "cz")])


@query(
    "a5_cluster_shapes",
    _SHAPES
    + """, g AS (SELECT frame, cluster, count(*) AS size, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM u GROUP BY 1, 2)
SELECT frame, CAST(cluster AS INT) AS cluster, size, round(sqrt(xx + yy + zz), 5) AS radius_of_gyration, """
    + ", ".join(f"CASE WHEN round({c}, 5) = 0 THEN 0e0 ELSE round({c}, 5) END AS {c}" for c in ("xx", "yy", "zz", "xy", "xz", "yz"))
    + " FROM g",
)
def a5(spark, sf_dir):
    zero = lambda c: F.when(c == 0, 0.0).otherwise(c)  # noqa: E731  # a rounded -0
    part = lambda k, n: zero(F.round(F.get("gyration_tensor", F.lit(k)), 5)).alias(n)
    return _shapes(spark, sf_dir).select("frame", "cluster", "size", F.round("radius_of_gyration", 5).alias("radius_of_gyration"), *[part(k, n) for k, n in enumerate(("xx", "yy", "zz", "xy", "xz", "yz"))])


def _moved(a: DataFrame) -> DataFrame:
    """The frame sheared by a little, with some noise that depends on the id."""
    n = lambda p: ((F.col("id") * p) % 101).cast("double") / F.lit(101.0) * F.lit(0.05)
    return a.select("frame", "id", (F.col("x") + F.col("y") * F.lit(0.01) + n(17)).alias("x"), (F.col("y") + n(29)).alias("y"), (F.col("z") * F.lit(1.001) + n(43)).alias("z"))


def _noise(p: int) -> str:
    return f"CAST((id * {p}) % 101 AS DOUBLE) / 101e0 * 5e-2"


_MOVED = f"moved AS (SELECT frame, id, x + y * 1e-2 + {_noise(17)} AS x, y + {_noise(29)} AS y, z * 1.001e0 + {_noise(43)} AS z FROM fr)"
_SHIFT = f"""shift AS (SELECT m.frame, m.id, {_image('m.x - fr.x')} AS dx, {_image('m.y - fr.y')} AS dy, {_image('m.z - fr.z')} AS dz FROM moved m JOIN fr ON m.id = fr.id)"""


def _displacements(spark, sf_dir, frames):
    a, c = frames(spark, sf_dir)
    return deformation.displacements(deformation.reference_join(_moved(a), a), c)


@query("x2_displacements", f"WITH {_ATOMS}, {_MOVED}, {_SHIFT} SELECT frame, id, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS magnitude FROM shift")
def x2(spark, sf_dir, frames=_frames, by=("frame",)):
    d = _displacements(spark, sf_dir, frames)
    return d.select(*by, "id", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "dz", "magnitude")])


@query("a7_displacement_summary", f"WITH {_ATOMS}, {_MOVED}, {_SHIFT}, m AS (SELECT frame, sqrt(dx * dx + dy * dy + dz * dz) AS v FROM shift) SELECT frame, round(avg(v), 6) AS avg_magnitude, round(max(v), 6) AS max_magnitude, round(min(v), 6) AS min_magnitude FROM m GROUP BY frame")
def a7(spark, sf_dir, frames=_frames, by=("frame",)):
    s = deformation.displacement_summary(_displacements(spark, sf_dir, frames))
    return s.select(*by, *[F.round(c, 6).alias(c) for c in ("avg_magnitude", "max_magnitude", "min_magnitude")])


_DET = lambda m: f"({m}00 * ({m}11 * {m}22 - {m}12 * {m}21) - {m}01 * ({m}10 * {m}22 - {m}12 * {m}20) + {m}02 * ({m}10 * {m}21 - {m}11 * {m}20))"
_COFACTOR = lambda m, i, j: "({m}{a}{b} * {m}{c}{d} - {m}{a}{d} * {m}{c}{b})".format(m=m, a=(i + 1) % 3, b=(j + 1) % 3, c=(i + 2) % 3, d=(j + 2) % 3)
_PLACES = [(i, j) for i in range(3) for j in range(3)]


def strain_sql(bonds: str) -> str:
    """From ``bonds(frame, id, r0..r2, d0..d2)``: ``sums``, ``f`` with F by places and ``e`` with the strain by places."""
    return f"""sums AS (SELECT frame, id, count(*) AS n, sum(d0 * d0 + d1 * d1 + d2 * d2) AS dd, {', '.join(f'sum(r{i} * r{j}) AS v{i}{j}, sum(d{i} * r{j}) AS w{i}{j}' for i, j in _PLACES)} FROM {bonds} GROUP BY 1, 2),
good AS (SELECT *, {_DET('v')} AS dv, {_DET('w')} AS dw FROM sums WHERE n >= 3),
f AS (SELECT *, {', '.join(f"({' + '.join(f'w{i}{k} * {_COFACTOR(chr(118), j, k)}' for k in range(3))}) / dv AS f{i}{j}" for i, j in _PLACES)} FROM good WHERE abs(dv) > 1e-4 AND abs(dw) > 1e-4),
e AS (SELECT *, {', '.join(f"(f0{i} * f0{j} + f1{i} * f1{j} + f2{i} * f2{j} - {int(i == j)}) / 2 AS e{i}{j}" for i, j in _PLACES)} FROM f)"""


_STRAIN = f"""WITH {_PAIRS}, {_MOVED}, {_SHIFT}, bonds AS (SELECT near.frame, near.i AS id, near.dx AS r0, near.dy AS r1, near.dz AS r2, near.dx + b.dx - a.dx AS d0, near.dy + b.dy - a.dy AS d1, near.dz + b.dz - a.dz AS d2
  FROM near JOIN shift a ON a.id = near.i JOIN shift b ON b.id = near.j WHERE near.d2 <= {CUTOFF * CUTOFF!r}), {strain_sql('bonds')},
told AS (SELECT fr.frame, fr.id, coalesce(sqrt(e01 * e01 + e02 * e02 + e12 * e12 + ((e11 - e22) * (e11 - e22) + (e00 - e22) * (e00 - e22) + (e00 - e11) * (e00 - e11)) / 6), 0) AS shear_strain, coalesce((e00 + e11 + e22) / 3, 0) AS volumetric_strain,
  coalesce(greatest(dd - ({' + '.join(f'f{i}{j} * w{i}{j}' for i, j in _PLACES)}), 0), 0) AS d2min, e.id IS NULL AS invalid FROM fr LEFT JOIN e ON e.id = fr.id)"""


def _strain(spark, sf_dir):
    a, c = _frames(spark, sf_dir)
    return deformation.strain_within(a, c, CUTOFF, _displacements(spark, sf_dir, _frames))


@query("x3_atomic_strain", _STRAIN + " SELECT frame, id, round(shear_strain, 5) AS shear_strain, round(volumetric_strain, 5) AS volumetric_strain, round(d2min, 5) AS d2min, invalid FROM told")
def x3(spark, sf_dir):
    return _strain(spark, sf_dir).select("frame", "id", *[F.round(c, 5).alias(c) for c in ("shear_strain", "volumetric_strain", "d2min")], "invalid")


@query("a8_strain_summary", _STRAIN + " SELECT frame, round(avg(shear_strain), 5) AS avg_shear, round(avg(volumetric_strain), 5) AS avg_volumetric, round(max(shear_strain), 4) AS max_shear, count(*) FILTER (WHERE invalid) AS n_invalid FROM told GROUP BY 1")
def a8(spark, sf_dir):
    told = deformation.strain_summary(_strain(spark, sf_dir))
    return told.select("frame", F.round("avg_shear", 5).alias("avg_shear"), F.round("avg_volumetric", 5).alias("avg_volumetric"), F.round("max_shear", 4).alias("max_shear"), "n_invalid")


@query("f3_filter_preview", f"WITH atoms AS ({ATOMS_SQL}) SELECT count(*) FILTER (WHERE CAST(x AS FLOAT) > 1.5e1) AS match_count, count(*) AS total_atoms FROM atoms")
def f3(spark, sf_dir):
    return particles.preview(atoms(spark, sf_dir), particles.predicate(F.col("x"), ">", 15.0))


@query("f1_float_equality", f"WITH atoms AS ({ATOMS_SQL}) SELECT id, CAST(type AS INT) AS type FROM atoms WHERE CAST(CAST(type AS FLOAT) AS DOUBLE) = 3e0")
def f1(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return a.where(particles.predicate(F.col("type"), "==", 3.0)).select("id", "type")


@query("f4_filter_delete", f"WITH atoms AS ({ATOMS_SQL}) SELECT id, round(x, 6) AS x FROM atoms WHERE NOT (CAST(CAST(y AS FLOAT) AS DOUBLE) <= 1e1)")
def f4(spark, sf_dir):
    return particles.delete_matching(atoms(spark, sf_dir), particles.predicate(F.col("y"), "<=", 10.0)).select("id", F.round("x", 6).alias("x"))


@query("f5_highlight", f"WITH atoms AS ({ATOMS_SQL}) SELECT id, CASE WHEN CAST(CAST(z AS FLOAT) AS DOUBLE) < 2e0 THEN 1e0 ELSE 8e-1 END AS red FROM atoms")
def f5(spark, sf_dir):
    a = atoms(spark, sf_dir)
    return a.select("id", F.get(particles.highlight(particles.predicate(F.col("z"), "<", 2.0)), F.lit(0)).alias("red"))


@query(
    "j4_modifier_join",
    f"""WITH atoms AS ({ATOMS_SQL}), v AS (SELECT l_orderkey * 8 + l_linenumber AS id, max_by(l_quantity, l_suppkey * 1000 + l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT a.id, coalesce(v.q, 0e0) AS quantity FROM atoms a LEFT JOIN v USING (id)""",
)
def j4(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    values = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") * 1000 + F.col("l_quantity")).alias("ordinal"), F.col("l_quantity").alias("value"))
    return particles.with_modifier(atoms(spark, sf_dir), values, "quantity").select("id", "quantity")


@query("j5_page_lookup", f"WITH atoms AS ({ATOMS_SQL}), page AS (SELECT id FROM atoms WHERE frame = 1996 ORDER BY id LIMIT 500) SELECT a.id, CAST(a.type AS INT) AS type, round(a.x, 6) AS x FROM atoms a JOIN page USING (id)")
def j5(spark, sf_dir):
    a = atoms(spark, sf_dir)
    ids = a.where("frame = 1996").select("id").orderBy("id").limit(500)
    return a.join(F.broadcast(ids), "id", "left_semi").select("id", "type", F.round("x", 6).alias("x"))


@query("o6_atom_page", f"WITH atoms AS ({ATOMS_SQL}), n AS (SELECT id, row_number() OVER (PARTITION BY frame ORDER BY id) - 1 AS ordinal, frame FROM atoms) SELECT frame, id, ordinal FROM n WHERE ordinal >= 200 AND ordinal < 300")
def o6(spark, sf_dir):
    numbered = particles.with_ordinal(atoms(spark, sf_dir), [F.col("id")], F.floor(F.col("id") / 65536))
    return particles.atom_page(numbered, 3, 100).select(F.col("frame").cast("long").alias("frame"), "id", "ordinal")


@query("a16_value_range", f"WITH atoms AS ({ATOMS_SQL}) SELECT round(min(x), 6) AS min_value, round(max(x), 6) AS max_value FROM atoms")
def a16(spark, sf_dir):
    return particles.value_range(atoms(spark, sf_dir), "x").select(*[F.round(c, 6).alias(c) for c in ("min_value", "max_value")])


@query("a17_bounding_box", f"WITH atoms AS ({ATOMS_SQL}) SELECT frame, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM atoms GROUP BY frame")
def a17(spark, sf_dir):
    b = particles.bounding_box(atoms(spark, sf_dir), ["frame"])
    return b.select(F.col("frame").cast("long").alias("frame"), *[F.round(c, 6).alias(c) for c in b.columns if c != "frame"])


_CELL = "a AS (SELECT n_nationkey AS frame, 4e0 + n_nationkey AS ax, 1e0 + n_regionkey * 5e-1 AS bx, 5e0 + n_regionkey AS b_y, 5e-1 AS cx, 7e-1 * n_regionkey AS cy, 6e0 + n_nationkey % 7 AS cz FROM nation)"


@query(
    "m3_cell_geometry",
    f"""WITH {_CELL} SELECT frame, round(ax * b_y * cz, 6) AS volume, round(ax * b_y * cz / sqrt(pow(b_y * cz, 2) + pow(bx * cz, 2) + pow(bx * cy - b_y * cx, 2)), 6) AS height_a, round(b_y * cz / sqrt(cz * cz + cy * cy), 6) AS height_b, round(cz, 6) AS height_c,
  round(sqrt(cx * cx + cy * cy + cz * cz), 6) AS len_c, round(degrees(acos((bx * cx + b_y * cy) / (sqrt(bx * bx + b_y * b_y) * sqrt(cx * cx + cy * cy + cz * cz)))), 6) AS alpha, round(degrees(acos(bx / sqrt(bx * bx + b_y * b_y))), 6) AS gamma, round(1 / ax, 6) AS reciprocal FROM a""",
)
def m3(spark, sf_dir):
    """A tilted cell for each nation."""
    n = table(spark, sf_dir, "nation")
    k, r, zero = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double"), F.lit(0.0)
    c = n.select(F.col("n_nationkey").alias("frame"), F.array(k + 4.0, zero, zero).alias("a"), F.array(1.0 + r * 0.5, r + 5.0, zero).alias("b"), F.array(F.lit(0.5), r * 0.7, 6.0 + k % 7).alias("c"), F.array(zero, zero, zero).alias("origin"), F.array(*[F.lit(True)] * 3).alias("pbc"))
    c = C.with_geometry(c)
    told = {**C.lengths_and_angles(), "reciprocal": F.get(C.reciprocal()["reciprocal_a"], F.lit(0)), "volume": F.col("volume"), **{f"height_{x}": F.get("heights", F.lit(i)) for i, x in enumerate("abc")}}
    return c.select("frame", *[F.round(told[x], 6).alias(x) for x in ("volume", "height_a", "height_b", "height_c", "len_c", "alpha", "gamma", "reciprocal")])


@query("m2_wrap", f"WITH atoms AS ({ATOMS_SQL}) SELECT id, round((x * 3 - 17) - 2e1 * floor((x * 3 - 17) / 2e1), 6) AS wx FROM atoms")
def m2(spark, sf_dir):
    a = atoms(spark, sf_dir).withColumn("x", F.col("x") * 3 - 17)
    placed = a.join(C.with_geometry(cube_cells(a)), "frame")
    s = C.wrapped(C.reduced([F.col("x"), F.col("y"), F.col("z")]))
    return placed.select("id", F.round(s[0] * BOX, 6).alias("wx"))


@query("m8_magnitude", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS magnitude FROM embeddings")
def m8(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(L.magnitude(F.col("embedding")), 6).alias("magnitude"))


_Q8 = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS v{i}" for i in range(8))
_UNIT = ", ".join(f"v{i} / sqrt({' + '.join(f'v{j} * v{j}' for j in range(i // 4 * 4, i // 4 * 4 + 4))}) AS q{i}" for i in range(8))


@query(
    "m5_disorientation",
    f"""WITH e AS (SELECT vec_id, {_Q8} FROM embeddings), u AS (SELECT vec_id, {_UNIT} FROM e),
s AS (SELECT vec_id, list_sort([abs(q3 * q4 - q0 * q7 - q1 * q6 + q2 * q5), abs(q3 * q5 + q0 * q6 - q1 * q7 - q2 * q4), abs(q3 * q6 - q0 * q5 + q1 * q4 - q2 * q7), abs(q3 * q7 + q0 * q4 + q1 * q5 + q2 * q6)]) AS s FROM u),
t AS (SELECT vec_id, 2 * degrees(acos(least(1e0, greatest(s[4], (s[4] + s[3]) / sqrt(2e0), (s[1] + s[2] + s[3] + s[4]) / 2)))) AS t FROM s)
SELECT vec_id, round(t, 5) AS degrees, round(CASE WHEN t < 1e-5 THEN 1 ELSE exp(-t * t / 3) END, 6) AS weight FROM t""",
)
def m5(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"q{i}") for i in range(8)])
    unit = lambda k: [F.col(f"q{i}") / F.sqrt(sum((F.col(f"q{j}") * F.col(f"q{j}") for j in range(k + 1, k + 4)), F.col(f"q{k}") * F.col(f"q{k}"))) for i in range(k, k + 4)]
    theta = L.cubic_disorientation(unit(0), unit(4))
    return e.select("vec_id", F.round(theta, 5).alias("degrees"), F.round(L.graph_weight(theta), 6).alias("weight"))


@query("m11_morton", f"WITH atoms AS ({ATOMS_SQL}), c AS (SELECT id, CAST(least(1023, greatest(0, floor(x / 2e1 * 1023e0))) AS BIGINT) AS a, CAST(least(1023, greatest(0, floor(y / 2e1 * 1023e0))) AS BIGINT) AS b, CAST(least(1023, greatest(0, floor(z / 2e1 * 1023e0))) AS BIGINT) AS c FROM atoms) SELECT id, CAST(list_sum(list_transform(range(10), lambda k: (((a >> CAST(k AS BIGINT)) & 1) << (3 * k)) + (((b >> CAST(k AS BIGINT)) & 1) << (3 * k + 1)) + (((c >> CAST(k AS BIGINT)) & 1) << (3 * k + 2)))) AS BIGINT) AS morton FROM c")
def m11(spark, sf_dir):
    lo, hi = [F.lit(0.0)] * 3, [F.lit(BOX)] * 3
    return atoms(spark, sf_dir).select("id", S.morton_code(F.col("x"), F.col("y"), F.col("z"), lo, hi).alias("morton"))


@query("x32_gradient", f"WITH atoms AS ({ATOMS_SQL}), t AS (SELECT id, floor(greatest(0, least(1, (x - 2e0) / 1.6e1)) * 1023) / 1023e0 AS t FROM atoms) SELECT id, round(CASE WHEN t < 5e-1 THEN 0.267004 + (0.127568 - 0.267004) * (t * 2) ELSE 0.127568 + (0.993248 - 0.127568) * (t * 2 - 1) END, 6) AS red FROM t")
def x32(spark, sf_dir):
    color = S.gradient(F.col("x"), F.lit(2.0), F.lit(18.0), "Viridis")
    return atoms(spark, sf_dir).select("id", F.round(F.get(color, F.lit(0)), 6).alias("red"))


def _segments(spark, sf_dir):
    """Orders as lines: line items of an order, by number, as its points."""
    p = atoms(spark, sf_dir).select((F.col("id") - F.col("type")).alias("line_id"), F.col("type").alias("pos"), "x", "y", "z")
    return p


_POINTS = f"atoms AS ({ATOMS_SQL}), p AS (SELECT id - type AS line_id, type AS pos, x, y, z FROM atoms), st AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS step FROM p WINDOW w AS (PARTITION BY line_id ORDER BY pos))"


@query("w6_polyline_length", f"WITH {_POINTS} SELECT line_id, count(*) AS n_points, round(coalesce(sum(step), 0), 6) AS length FROM st GROUP BY line_id")
def w6(spark, sf_dir):
    return dislocations.polyline_length(_segments(spark, sf_dir), ["line_id"]).select("line_id", "n_points", F.round("length", 6).alias("length"))


@query("w7_arc_length", f"WITH {_POINTS} SELECT line_id, CAST(pos AS INT) AS pos, round(sum(coalesce(step, 0)) OVER (PARTITION BY line_id ORDER BY pos), 6) AS arc FROM st")
def w7(spark, sf_dir):
    return dislocations.arc_lengths(_segments(spark, sf_dir), ["line_id"]).select("line_id", "pos", F.round("arc", 6).alias("arc"))


_HALF = ", ".join(f"round({c} + coalesce((goal - arc) / nullif(narc - arc, 0), 0) * (coalesce(n{c}, {c}) - {c}), 4) AS {c}" for c in "xyz")


@query(
    "w7_point_on_line",
    f"""WITH {_POINTS}, a AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY line_id ORDER BY pos) AS arc FROM st),
g AS (SELECT *, max(arc) OVER (PARTITION BY line_id) * 5e-1 AS goal, lead(arc) OVER w AS narc, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM a WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
h AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY pos) AS k FROM g WHERE arc <= goal AND coalesce(narc, arc) >= goal)
SELECT line_id, {_HALF} FROM h WHERE k = 1""",
)
def w7b(spark, sf_dir):
    middle = dislocations.point_on_line(dislocations.arc_lengths(_segments(spark, sf_dir), ["line_id"]), ["line_id"], 0.5)
    return middle.select("line_id", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("a15_segment_summary", f"WITH {_POINTS}, s AS (SELECT line_id, count(*) AS n_points, coalesce(sum(step), 0) AS length FROM st GROUP BY line_id) SELECT count(*) AS n_segments, round(sum(length), 3) AS total_length, round(avg(length), 6) AS mean_length, round(max(length), 6) AS max_length, CAST(sum(n_points) AS BIGINT) AS total_points, count(*) FILTER (WHERE n_points = 1) AS n_dangling, round(sum(length) / 8e3, 6) AS density FROM s")
def a15(spark, sf_dir):
    s = dislocations.polyline_length(_segments(spark, sf_dir), ["line_id"]).withColumn("dangling", F.col("n_points") == 1)
    n = dislocations.network_statistics(s, BOX**3)
    return n.select("n_segments", F.round("total_length", 3).alias("total_length"), *[F.round(c, 6).alias(c) for c in ("mean_length", "max_length")], "total_points", "n_dangling", F.round("density", 6).alias("density"))


_SIDES, _WIDTH = 8, 0.4


@query(
    "k11_tube_mesh",
    f"""WITH {_POINTS}, d AS (SELECT line_id, pos, x, lag(x) OVER w AS px, (x - lag(x) OVER w) / step AS dx, (y - lag(y) OVER w) / step AS d_y, (z - lag(z) OVER w) / step AS dz, step FROM st WINDOW w AS (PARTITION BY line_id ORDER BY pos)),
r AS (SELECT *, CASE WHEN abs(d_y) > 99e-2 THEN 0 ELSE -dz / sqrt(dz * dz + dx * dx) END AS rx FROM d WHERE step > 0)
SELECT line_id, count(*) * {2 * (_SIDES + 1)} AS vertices, count(*) * {2 * _SIDES} AS triangles, round(sum({_SIDES + 1} * (x + px) + {_WIDTH!r} * rx), 4) AS total_x FROM r GROUP BY 1""",
)
def k11(spark, sf_dir):
    """Tubes around the orders' lines: vertices, triangles, and the sum of the vertices' x."""
    vertices, faces = dislocations.tube_mesh(_segments(spark, sf_dir), ["line_id"], _WIDTH, _SIDES)
    v = vertices.groupBy("line_id").agg(F.count("*").alias("vertices"), F.round(F.sum("x"), 4).alias("total_x"))
    return v.join(faces.groupBy("line_id").agg(F.count("*").alias("triangles")), "line_id")


@query(
    "x25_finished_lines",
    f"""WITH atoms AS ({ATOMS_SQL}), p AS (SELECT id - type AS line, type AS pos, x, y, z FROM atoms), n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY line) AS n FROM p WINDOW w AS (PARTITION BY line ORDER BY pos)),
c AS (SELECT * FROM n WHERE k > CASE WHEN n > 3 THEN 1 ELSE 0 END AND k <= n - CASE WHEN n > 4 THEN 1 ELSE 0 END),
e AS (SELECT line, count(*) AS n_points, min_by(x, k) AS fx, max_by(x, k) AS tx, max_by(x, k) - min_by(x, k) AS ax, max_by(y, k) - min_by(y, k) AS ay, max_by(z, k) - min_by(z, k) AS az FROM c GROUP BY line),
s AS (SELECT *, CASE WHEN abs(ax) > abs(ay) AND abs(ax) > abs(az) THEN ax WHEN abs(ay) >= abs(ax) AND abs(ay) > abs(az) THEN ay ELSE az END < 0 AS flip FROM e)
SELECT line, n_points, round(CASE WHEN flip THEN tx ELSE fx END, 6) AS first_x, CASE WHEN flip THEN 5e-1 ELSE -5e-1 END AS bx FROM s""",
)
def x25(spark, sf_dir):
    """Orders as traced lines with points to trim, all in one crystal."""
    p = _segments(spark, sf_dir).groupBy("line_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda q: F.array(q["x"], q["y"], q["z"])).alias("points"))
    rows = p.select(F.lit(0).alias("frame"), F.col("line_id").alias("line"), F.lit(1).cast("long").alias("cluster"), F.lit(0.5).alias("bx"), F.lit(0.5).alias("by"), F.lit(0.0).alias("bz"), "points", (F.size("points") > 3).cast("int").alias("head"), (F.size("points") > 4).cast("int").alias("tail"))
    one = rows.select("frame", "cluster").distinct().withColumn("kind", F.lit(1))
    none = rows.limit(0).select("frame", F.col("cluster").alias("a"), F.col("cluster").alias("b"), *[F.col("bx").alias(f"t{k}") for k in range(9)])
    done = dislocations.finished_lines(rows, one, none, 1)
    return done.select("line", F.size("points").cast("long").alias("n_points"), F.round(F.get(F.get("points", F.lit(0)), F.lit(0)), 6).alias("first_x"), "bx")


@query("a12_junction_arms", "WITH e AS (SELECT l_partkey AS junction, count(*) AS arms FROM lineitem GROUP BY 1 HAVING count(*) > 1) SELECT arms, count(*) AS junctions FROM e GROUP BY arms")
def a12(spark, sf_dir):
    return dislocations.junction_arms(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("junction"), F.col("l_orderkey").alias("segment")))


_FACES = "f AS (SELECT l_partkey % 997 AS v0, l_suppkey % 991 + 1 AS v1, l_orderkey % 983 + 2 AS v2 FROM lineitem)"


@query("a14_mesh_topology", f"WITH {_FACES}, v AS (SELECT count(DISTINCT v) AS vertices FROM (SELECT v0 AS v FROM f UNION ALL SELECT v1 FROM f UNION ALL SELECT v2 FROM f)), e AS (SELECT count(DISTINCT (least(p, q), greatest(p, q))) AS edges FROM (SELECT v0 AS p, v1 AS q FROM f UNION ALL SELECT v1, v2 FROM f UNION ALL SELECT v2, v0 FROM f)), n AS (SELECT count(*) AS faces FROM f) SELECT vertices, edges, faces, vertices - edges + faces AS euler, (2 - (vertices - edges + faces)) / 2e0 AS genus, round(2e0 * edges / vertices, 6) AS mean_degree FROM v, e, n")
def a14(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 997).alias("v0"), (F.col("l_suppkey") % 991 + 1).alias("v1"), (F.col("l_orderkey") % 983 + 2).alias("v2"))
    return dislocations.mesh_topology(f).withColumn("mean_degree", F.round("mean_degree", 6))


@query("x30_burgers_families", """WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_linenumber % 6 AS k FROM lineitem) SELECT CASE k WHEN 0 THEN '1/2<111>' WHEN 1 THEN '<100>' WHEN 2 THEN '<110>' WHEN 3 THEN '<111>' WHEN 4 THEN '1/6<112>' ELSE 'Other' END AS family, count(*) AS n FROM b GROUP BY 1""")
def x30(spark, sf_dir):
    vectors = [(0.5, -0.5, 0.5), (0.0, -1.0, 0.0), (1.0, 0.0, -1.0), (-1.0, 1.0, 1.0), (1 / 6, -2 / 6, 1 / 6), (0.3, 0.7, 0.1)]
    table_of = F.array(*[F.array(*[F.lit(x) for x in v]) for v in vectors])
    b = table(spark, sf_dir, "lineitem").select(F.get(table_of, (F.col("l_linenumber") % 6).cast("int")).alias("b"))
    b = b.select(*[F.get("b", F.lit(i)).alias(f"b{c}") for i, c in enumerate("xyz")])
    return dislocations.burgers_families(b).groupBy("family").agg(F.count("*").alias("n"))


_NEAR = lambda c: f"""{c} + w * CASE WHEN k > 0 AND k < n - 1 THEN (lag({c}) OVER o + lead({c}) OVER o) / 2 - {c}
  WHEN closed THEN (max(CASE WHEN k = 1 THEN {c} END) OVER l + max(CASE WHEN k = n - 2 THEN {c} END) OVER l) / 2 - {c} ELSE 0 END AS {c}"""  # noqa: E731
_PASS = lambda t, w: f"SELECT line_id, k, n, closed, core, {', '.join(map(_NEAR, 'xyz'))} FROM (SELECT *, CASE WHEN n > 2 AND NOT (closed AND n <= 4) THEN {w} ELSE 0 END AS w FROM {t}) WINDOW o AS (PARTITION BY line_id ORDER BY k), l AS (PARTITION BY line_id)"


@query(
    "x28_line_smoothing",
    f"""WITH RECURSIVE atoms AS ({ATOMS_SQL}), b AS (SELECT id - type AS line_id, row_number() OVER w - 1 AS k, x, y, z, type AS core, count(*) OVER (PARTITION BY id - type) AS n FROM atoms WINDOW w AS (PARTITION BY id - type ORDER BY type)),
c AS (SELECT *, n >= 3 AND line_id // 8 % 2 = 0 AS closed FROM b), p AS (SELECT * FROM c UNION ALL SELECT line_id, n, x, y, z, core, n, closed FROM c WHERE k = 0 AND closed),
m AS (SELECT * EXCLUDE (n), count(*) OVER (PARTITION BY line_id) AS n FROM p),
i AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY k) AS r FROM m WHERE n >= 4 AND (closed OR (k > 0 AND k < n - 1))),
g AS (SELECT line_id, r, 1 AS stretch, 1 AS size, core AS total FROM i WHERE r = 1 UNION ALL
  SELECT i.line_id, i.r, CASE WHEN size * size >= 25e-1 * total THEN stretch + 1 ELSE stretch END, CASE WHEN size * size >= 25e-1 * total THEN 1 ELSE size + 1 END, CASE WHEN size * size >= 25e-1 * total THEN core ELSE total + core END FROM g JOIN i ON i.line_id = g.line_id AND i.r = g.r + 1),
a AS (SELECT line_id, stretch, any_value(closed) AS closed, avg(x) AS x, avg(y) AS y, avg(z) AS z, sum(core) // count(*) AS core FROM i JOIN g USING (line_id, r) GROUP BY line_id, stretch),
e AS (SELECT line_id, stretch AS k, x, y, z, core, closed FROM a UNION ALL SELECT line_id, 99, x, y, z, core, closed FROM a WHERE closed AND stretch = 1 UNION ALL
  SELECT line_id, CASE WHEN k = 0 THEN 0 ELSE 99 END, x, y, z, core, closed FROM m WHERE n >= 4 AND NOT closed AND (k = 0 OR k = n - 1)),
f AS (SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY k) - 1 AS k, count(*) OVER (PARTITION BY line_id) AS n, closed, x, y, z, core FROM e),
s0 AS (SELECT line_id, k, n, closed, x, y, z, core FROM f WHERE n >= CASE WHEN closed THEN 4 ELSE 2 END UNION ALL SELECT line_id, k, n, closed, x, y, z, core FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.line_id = m.line_id AND f.n >= CASE WHEN f.closed THEN 4 ELSE 2 END)),
s1 AS ({_PASS("s0", "5e-1")}), s2 AS ({_PASS("s1", "-53e-2")})
SELECT line_id, k AS place, closed, CAST(core AS BIGINT) AS core, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM s2""",
)
def x28(spark, sf_dir):
    """Orders as lines; those of an even key and at least three items are closed. Core sizes are the line numbers."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x", "y", "z")))
    p = _segments(spark, sf_dir).groupBy("line_id").agg(ordered.alias("p"))
    p = p.withColumn("closed", (F.size("p") >= 3) & (F.floor(F.col("line_id") / 8) % 2 == 0))
    p = p.withColumn("p", F.when(F.col("closed"), F.concat("p", F.slice("p", 1, 1))).otherwise(F.col("p")))
    p = p.select("line_id", "closed", F.transform("p", lambda q: F.array(q["x"], q["y"], q["z"])).alias("points"), F.transform("p", lambda q: q["pos"].cast("long")).alias("cores"))
    done = dislocations.smooth_lines(p).select("line_id", "closed", F.posexplode(F.arrays_zip("points", "cores")).alias("place", "v"))
    return done.select("line_id", F.col("place").cast("long").alias("place"), "closed", F.col("v.cores").alias("core"), *[F.round(F.get("v.points", F.lit(i)), 5).alias(c) for i, c in enumerate("xyz")])


_CUT = ", ".join(f"{u} + t0 * ({v} - {u}) AS a{i}, {u} + t1 * ({v} - {u}) AS b{i}, " + (f"floor({u} + (t0 + t1) / 2 * ({v} - {u}))" if i < 2 else "0") + f" AS m{i}" for i, (u, v) in enumerate((f"u{i}", f"v{i}") for i in range(3)))
_FACES = " || ".join(f"[round((k - u{i}) / (v{i} - u{i}), 12) for k in generate_series(CAST(floor(least(u{i}, v{i})) AS BIGINT) + 1, CAST(ceil(greatest(u{i}, v{i})) AS BIGINT) - 1)]" for i in range(2))
#: Orders as lines of a frame in a cell tilted along x and open along z, cut into chunks. Faces are told to twelve decimals, as by `clip_lines`.
_CHUNKS = f"""atoms AS ({ATOMS_SQL}), s AS (SELECT frame, id - type AS line_id, type AS pos, round((x * 2 - y * 4e-1) / 2e1, 12) AS u0, round(y * 2 / 2e1, 12) AS u1, round(z * 2 / 2e1, 12) AS u2 FROM atoms),
st AS (SELECT * FROM (SELECT *, lead(u0) OVER w AS v0, lead(u1) OVER w AS v1, lead(u2) OVER w AS v2 FROM s WINDOW w AS (PARTITION BY frame, line_id ORDER BY pos)) WHERE v0 IS NOT NULL),
cr AS (SELECT *, unnest(list_distinct([0e0, 1e0] || {_FACES})) AS t0 FROM st), pt AS (SELECT * FROM (SELECT *, lead(t0) OVER (PARTITION BY frame, line_id, pos ORDER BY t0) AS t1 FROM cr) WHERE t1 IS NOT NULL),
im AS (SELECT frame, line_id, pos, t0, {_CUT} FROM pt), nw AS (SELECT *, coalesce(lag([m0, m1]) OVER w <> [m0, m1], true) AS fresh FROM im WINDOW w AS (PARTITION BY frame, line_id ORDER BY pos, t0)),
ck AS (SELECT *, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY frame, line_id ORDER BY pos, t0) - 1 AS INT) AS chunk FROM nw),
ro AS (SELECT frame, line_id, chunk, pos, t0, 0 AS k, a0 - m0 AS s0, a1 - m1 AS s1, a2 AS s2 FROM ck WHERE fresh UNION ALL SELECT frame, line_id, chunk, pos, t0, 1, b0 - m0, b1 - m1, b2 FROM ck),
clipped AS (SELECT frame, line_id, chunk, row_number() OVER (PARTITION BY frame, line_id, chunk ORDER BY pos, t0, k) - 1 AS place, s0 * 2e1 + s1 * 4 AS x, s1 * 2e1 AS y, s2 * 2e1 AS z FROM ro)"""


def _tilted(spark, sf_dir):
    """Orders as lines of a frame, twice as far out, and their cells."""
    a = atoms(spark, sf_dir)
    p = a.select("frame", (F.col("id") - F.col("type")).alias("line_id"), F.col("type").alias("pos"), *[(F.col(c) * 2).alias(c) for c in "xyz"])
    tilt = F.array(F.lit(4.0), F.lit(BOX), F.lit(0.0))
    return p, cube_cells(a).withColumn("b", tilt).withColumn("pbc", F.array(F.lit(True), F.lit(True), F.lit(False)))


@query("x29_line_clipping", f"WITH {_CHUNKS} SELECT frame, line_id, chunk, place, round(x, 5) + 0e0 AS x, round(y, 5) + 0e0 AS y, round(z, 5) + 0e0 AS z FROM clipped")
def x29(spark, sf_dir):
    chunks = dislocations.clip_lines(*_tilted(spark, sf_dir), ["line_id"])
    return chunks.select("frame", "line_id", "chunk", F.col("place").cast("long").alias("place"), *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


_STEPS = "sl AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM clipped WINDOW w AS (PARTITION BY frame, line_id, chunk ORDER BY place)), dc AS (SELECT frame, line_id, chunk, count(*) AS num_points, coalesce(sum(step), 0) AS length FROM sl GROUP BY ALL)"
_BURGERS = ["(line_id // 8 % 3) * 5e-1", "-5e-1", "(line_id // 8 % 2) * 5e-1"]
_TEXT = " || ' ' || ".join(f"printf('%.3f', {b})" for b in _BURGERS)


def _documents(spark, sf_dir):
    points, cells = _tilted(spark, sf_dir)
    order = F.floor(F.col("line_id") / 8)
    lines = points.select("frame", "line_id").distinct().select("*", ((order % 3) * 0.5).alias("bx"), F.lit(-0.5).alias("by"), ((order % 2) * 0.5).alias("bz"))
    return dislocations.line_documents(points, cells, lines)


@query(
    "k5_line_documents",
    f"WITH {_CHUNKS}, {_STEPS} SELECT frame, line_id, chunk, num_points, round(length, 5) AS length, round(sqrt({' + '.join(f'{b} * {b}' for b in _BURGERS)}), 6) AS magnitude, '[' || {_TEXT} || ']' AS fractional FROM dc",
)
def k5(spark, sf_dir):
    return _documents(spark, sf_dir).select("frame", "line_id", "chunk", "num_points", F.round("length", 5).alias("length"), F.round("burgers.magnitude", 6).alias("magnitude"), "burgers.fractional")


@query("k5_document_summary", f"WITH {_CHUNKS}, {_STEPS} SELECT frame, count(*) AS count, CAST(sum(num_points) AS BIGINT) AS total_points, round(avg(length), 4) AS average_segment_length, round(max(length), 4) AS max_segment_length, round(min(length), 4) AS min_segment_length, round(sum(length), 3) AS total_length FROM dc GROUP BY frame")
def k5_summary(spark, sf_dir):
    told = dislocations.document_summary(_documents(spark, sf_dir))
    return told.select("frame", "count", "total_points", *[F.round(c, 4).alias(c) for c in ("average_segment_length", "max_segment_length", "min_segment_length")], F.round("total_length", 3).alias("total_length"))


@query("k10_point_cloud", "WITH m AS (" + ORACLES["m11_morton"] + f"), atoms AS ({ATOMS_SQL}) SELECT a.frame, id, CAST(a.type AS INT) AS type, row_number() OVER (PARTITION BY a.frame ORDER BY morton, id) AS place FROM m JOIN atoms a USING (id)")
def k10(spark, sf_dir):
    """Each frame's cloud in Morton order, as it was written and read back."""
    lo, hi = [F.lit(0.0)] * 3, [F.lit(BOX)] * 3
    cloud = particles.point_cloud(atoms(spark, sf_dir), S.morton_code(F.col("x"), F.col("y"), F.col("z"), lo, hi))
    return cut(cloud, "cloud").select("frame", "id", "type", "place")


@query("g8_workflow_coordination", f"WITH {_PAIRS} SELECT frame, coordination, count(*) AS atoms FROM (SELECT fr.frame, fr.id, count(near.i) AS coordination FROM fr LEFT JOIN near ON near.i = fr.id AND near.d2 <= {CUTOFF * CUTOFF!r} GROUP BY fr.frame, fr.id) GROUP BY 1, 2")
def g8(spark, sf_dir, frames=_frames, by=("frame",)):
    """A workflow that runs the coordination analysis on its frames, behind an if-statement that lets it through."""
    from atomweave.plans import workflow as W

    a, cells = frames(spark, sf_dir)
    steps = [r[0] for r in cells.select("frame").orderBy("frame").collect()]
    node = lambda i, t, **d: {"id": i, "type": t, "data": d}
    flow = {
        "nodes": [
            node("m", "modifier", name="coordination", version="2"), node("a", "arguments", arguments=[{"argument": "cutoff", "default": CUTOFF}, {"argument": "bins", "default": 10}]),
            node("c", "context", timesteps=steps), node("i", "if-statement", conditions=[{"left": "{{ m.version }}", "operator": "==", "right": 2}]),
            node("e", "entrypoint", analyzer="coordination"), node("x", "exposure", results="coordination", name="atoms"),
        ],
        "edges": [{"source": s, "target": t, "sourceHandle": h} for s, t, h in (("m", "a", None), ("a", "c", None), ("c", "i", None), ("i", "e", "true"), ("e", "x", None))],
    }
    out = W.run(flow, W.Frames(a, cells))
    return out.results["atoms"].groupBy(*by, "coordination").agg(F.count("*").alias("atoms"))
