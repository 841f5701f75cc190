"""Per-frame analyses on neighbour pairs: coordination, radial distribution, clusters, symmetry, local structure."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.functions.cell import with_geometry
from atomweave.functions.linalg import magnitude  # noqa: F401
from atomweave.operators.graph import connected_components, labelled_components
from atomweave.operators.neighbors import counted_within, distances, parts_within, tile_sides, tiled


def coordination(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(frame, id, coordination)``, 0 for atoms without neighbours."""
    return _counted(atoms, pairs.groupBy("frame", F.col("i").alias("id")).count())


def coordination_within(atoms: DataFrame, cells: DataFrame, cutoff: float) -> DataFrame:
    """``coordination`` of the pairs within ``cutoff``, which are never rows."""
    return _counted(atoms, counted_within(atoms, cells, cutoff))


def _counted(atoms: DataFrame, counts: DataFrame) -> DataFrame:
    return atoms.select("frame", "id").join(counts, ["frame", "id"], "left").select("frame", "id", F.coalesce("count", F.lit(0)).alias("coordination"))


def radial_distribution(atoms: DataFrame, cells: DataFrame, pairs: DataFrame, cutoff: float, bins: int = 500) -> DataFrame:
    """``(frame, bin, r, pairs, g)`` for every bin: histogram width (cutoff + 1e-12) / bins, normalised with cutoff / bins."""
    hist = pairs.groupBy("frame", F.floor(F.sqrt("d2") / F.lit((cutoff + 1e-12) / bins)).cast("int").alias("bin")).count()
    return _distribution(atoms, cells, hist, cutoff, bins)


def radial_distribution_within(atoms: DataFrame, cells: DataFrame, cutoff: float, bins: int = 500) -> DataFrame:
    """``radial_distribution`` of the pairs within ``cutoff``: tiles count their own pairs, which are never rows."""
    if cutoff <= 0:
        raise ValueError("the cutoff must be positive")

    def work(rows: pa.Table) -> pa.Table:
        found, most = np.zeros(bins, np.int64), rows.column("most")[0].as_py()
        for some, others, d2 in distances(rows):
            near = d2[(d2 <= most) & (others != some[:, None])]
            found += np.bincount(np.floor(np.sqrt(near) / ((cutoff + 1e-12) / bins)).astype(np.int64), minlength=bins)
        bin_ = np.flatnonzero(found)
        return pa.table([rows.column("frame").take(pa.array(np.zeros(len(bin_), np.int64))), pa.array(bin_.astype(np.int32)), pa.array(found[bin_])], names=["frame", "bin", "count"])

    rows = tiled(atoms, tile_sides(atoms, cells.withColumn("cutoff", F.lit(float(cutoff)))))
    counts = rows.groupBy("frame", "tx", "ty", "tz").applyInArrow(work, f"frame {atoms.schema['frame'].dataType.simpleString()}, bin int, count long")
    return _distribution(atoms, cells, counts.groupBy("frame", "bin").agg(F.sum("count").alias("count")), cutoff, bins)


def _distribution(atoms: DataFrame, cells: DataFrame, hist: DataFrame, cutoff: float, bins: int) -> DataFrame:
    frames = atoms.groupBy("frame").agg(F.count("*").alias("n")).join(with_geometry(cells).select("frame", "volume"), "frame")
    grid = frames.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    step = cutoff / bins
    r1, r2 = F.col("bin") * step, (F.col("bin") + 1) * step
    shell = 4.0 / 3.0 * math.pi * (F.col("n") / F.col("volume")) * F.col("n") * (r2 * r2 * r2 - r1 * r1 * r1)
    found = F.coalesce("count", F.lit(0))
    return grid.join(hist, ["frame", "bin"], "left").select("frame", "bin", ((F.col("bin") + 0.5) * step).alias("r"), found.alias("pairs"), (found / shell).alias("g"))


def _key(c: str) -> Column:
    return F.struct("frame", F.col(c).alias("id"))


def _numbered_clusters(every: DataFrame) -> DataFrame:
    """Adds ``cluster`` and ``size`` to atoms with a ``root``: numbered from 1 by size, ties by the root."""
    sizes = every.groupBy("frame", "root").agg(F.count("*").alias("size"))
    ranked = sizes.withColumn("cluster", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("size"), "root")))
    return every.join(ranked, ["frame", "root"])


def clusters(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(frame, id, cluster, size)``: components of the neighbour graph, numbered from 1 by size, ties by smallest id."""
    found = connected_components(pairs.where("i < j").select(_key("i").alias("src"), _key("j").alias("dst")))
    return _numbered_parts(atoms, found.select(F.col("vertex.frame").alias("frame"), F.col("vertex.id").alias("id"), F.col("component.id").alias("root")))


def clusters_within(atoms: DataFrame, cells: DataFrame, cutoff: float) -> DataFrame:
    """``clusters`` over the pairs within ``cutoff``, which are never rows."""
    return _numbered_parts(atoms, parts_within(atoms, cells, cutoff))


def _numbered_parts(atoms: DataFrame, found: DataFrame) -> DataFrame:
    every = atoms.select("frame", "id").join(found, ["frame", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    return _numbered_clusters(every).select("frame", "id", "cluster", "size")


def unwrapped_clusters(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Clusters as above with positions that don't jump inside them: ``(frame, id, cluster, size, ux, uy, uz)``.

    Each atom stands where neighbour vectors lead from its cluster's first atom, which keeps its place. Vectors are added
    up while the components contract, in as many rounds, so no task holds a cluster. A cluster that meets its own image
    has no unique answer (``percolating_clusters`` finds these); its atoms then stand at one of their images each.
    """
    vector = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    add = lambda a, b: vector(*[a[c] + b[c] for c in "xyz"])
    back = lambda a: vector(*[-a[c] for c in "xyz"])
    edges = pairs.where("i < j").select(_key("j").alias("src"), _key("i").alias("dst"), vector(F.col("dx"), F.col("dy"), F.col("dz")).alias("label"))
    found = labelled_components(edges, vector(*[F.lit(0.0)] * 3), add, back)
    found = found.select(F.col("vertex.frame").alias("frame"), F.col("vertex.id").alias("id"), F.col("component.id").alias("root"), *[F.col(f"label.{c}").alias(f"o{c}") for c in "xyz"])
    every = atoms.select("frame", "id").join(found, ["frame", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    starts = atoms.select("frame", F.col("id").alias("root"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    placed = _numbered_clusters(every).join(starts, ["frame", "root"])
    return placed.select("frame", "id", "cluster", "size", *[(F.col(f"s{c}") + F.coalesce(f"o{c}", F.lit(0.0))).alias(f"u{c}") for c in "xyz"])


def percolating_clusters(placed: DataFrame, pairs: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """``(frame, cluster)`` of ``unwrapped_clusters`` with a bond that doesn't lead from one end to the other: they meet their own image."""
    end = lambda x: placed.select("frame", F.col("id").alias(x), F.col("cluster").alias(f"c{x}"), *[F.col(f"u{c}").alias(f"{x}{c}") for c in "xyz"])
    apart = sum(F.abs(F.col(f"j{c}") - F.col(f"i{c}") - F.col(f"d{c}")) for c in "xyz")
    bonds = pairs.select("frame", "i", "j", "dx", "dy", "dz").join(end("i"), ["frame", "i"]).join(end("j"), ["frame", "j"])
    return bonds.where(apart > tolerance).select("frame", F.col("ci").alias("cluster")).distinct()


def cluster_shapes(points: DataFrame) -> DataFrame:
    """Size, centre of mass, radius of gyration and gyration tensor (xx, yy, zz, xy, xz, yz) of clusters."""
    x, y, z = F.col("ux"), F.col("uy"), F.col("uz")
    tensor = F.array(F.var_pop(x), F.var_pop(y), F.var_pop(z), F.covar_pop(x, y), F.covar_pop(x, z), F.covar_pop(y, z))
    return points.groupBy("frame", "cluster").agg(
        F.count("*").alias("size"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.avg(z).alias("cz"),
        F.sqrt(F.var_pop(x) + F.var_pop(y) + F.var_pop(z)).alias("radius_of_gyration"), tensor.alias("gyration_tensor"),
    )


def centrosymmetry(atoms: DataFrame, nearest: DataFrame, k: int = 12) -> DataFrame:
    """``(frame, id, csp)``: the sum of the k/2 smallest |ri + rj|**2 over pairs of the k nearest; 0 with fewer than k."""
    if k % 2 or not 2 <= k <= 32:
        raise ValueError("k must be even, from 2 to 32")
    near = nearest.where(F.col("rank") <= k).groupBy("frame", F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "dx", "dy", "dz"))).alias("v"))
    add = lambda p, q, c: (p[c] + q[c]) * (p[c] + q[c])
    sums = F.flatten(F.transform("v", lambda p, i: F.transform(F.slice("v", i + 2, F.lit(k)), lambda q: add(p, q, "dx") + add(p, q, "dy") + add(p, q, "dz"))))
    csp = F.when(F.size("v") < k, 0.0).otherwise(F.aggregate(F.slice(F.array_sort(sums), 1, k // 2), F.lit(0.0), lambda a, s: a + s))
    near = near.select("frame", "id", csp.alias("csp"))
    return atoms.select("frame", "id").join(near, ["frame", "id"], "left").select("frame", "id", F.coalesce("csp", F.lit(0.0)).alias("csp"))


def assignments(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest assignments of rows to columns of a batch of square matrices ``(m, n, n)``, and their totals; forbidden places are infinite.

    Shortest augmenting paths for the whole batch at once: a row at a time enters every matrix, and n steps of the search serve all.
    A matrix without an assignment has an infinite total.
    """
    m, n = cost.shape[:2]
    every = np.arange(m)
    u, v = np.zeros((m, n + 1)), np.zeros((m, n + 1))
    owner = np.full((m, n + 1), -1)  # the row of each column; column n stands for the row that enters
    sound = np.ones(m, bool)
    for row in range(n):
        owner[:, n] = row
        dist, back, seen = np.full((m, n), np.inf), np.full((m, n), n), np.zeros((m, n + 1), bool)
        at, live = np.full(m, n), sound.copy()
        while live.any():
            w = every[live]
            col = at[w]
            seen[w, col] = True
            r = owner[w, col]
            step = cost[w, r] - u[w, r, None] - v[w, :n]
            closer = (step < dist[w]) & ~seen[w, :n]
            dist[w] = np.where(closer, step, dist[w])
            back[w] = np.where(closer, col[:, None], back[w])
            open_ = np.where(seen[w, :n], np.inf, dist[w])
            nxt = open_.argmin(1)
            delta = open_[np.arange(len(w)), nxt]
            lost = ~np.isfinite(delta)
            sound[w[lost]] = live[w[lost]] = False
            w, nxt, delta = w[~lost], nxt[~lost], delta[~lost]
            used = seen[w]
            rows, cols = np.nonzero(used)
            u[w[rows], owner[w[rows], cols]] += delta[rows]
            v[w] -= used * delta[:, None]
            dist[w] -= np.where(used[:, :n], 0, delta[:, None])
            at[w] = nxt
            live[w] = owner[w, nxt] >= 0
        w = every[sound]
        while len(w):  # turn the paths over
            col = at[w]
            prior = back[w, col]
            owner[w, col] = owner[w, prior]
            at[w] = prior
            w = w[prior != n]
    to = np.zeros((m, n), np.int64)
    rows, cols = np.nonzero(owner[:, :n] >= 0)
    to[rows, owner[rows, cols]] = cols
    total = np.take_along_axis(cost, to[:, :, None], 2)[:, :, 0].sum(1)
    return to, np.where(sound, total, np.inf)


def _paired(cost: np.ndarray, to: np.ndarray) -> tuple[float, list[int]]:
    """A perfect matching near an assignment, by its total, and the first odd cycle of the assignment (empty: the total is the least)."""
    n, left, total, loose, odd = len(to), np.ones(len(to), bool), 0.0, [], []
    for first in range(n):
        if left[first]:
            ring = [first]
            while to[ring[-1]] != first:
                ring.append(int(to[ring[-1]]))
            left[ring] = False
            if len(ring) % 2:
                odd = odd or ring
                loose += ring
            else:
                around = cost[ring, np.roll(ring, -1)]
                total += min(around[::2].sum(), around[1::2].sum())
    while loose:
        i = loose.pop()
        j = min(loose, key=lambda k: cost[i, k])
        loose.remove(j)
        total += cost[i, j]
    return total, odd


#: Subproblems of the matching that are solved at once; what remains waits on a stack.
TOGETHER = 1024


def best_matchings(v: np.ndarray) -> np.ndarray:
    """Smallest total |ri + rj|**2 over perfect matchings of each atom's vectors ``(m, k, 3)``, for any even k.

    Half the cheapest assignment bounds a matching from below and is one unless it has odd cycles. An odd cycle then gives two
    branches, with one of its links demanded or forbidden; branches that can't beat the best matching known end there. Branches of
    all atoms are solved together, those opened last first, so few wait.
    """
    m, k = v.shape[:2]
    full = ((v[:, :, None] + v[:, None]) ** 2).sum(-1)
    full[:, range(k), range(k)] = np.inf
    best = np.full(m, np.inf)
    stack = [(i, full[i]) for i in range(m)]
    while stack:
        now, stack = stack[-TOGETHER:], stack[:-TOGETHER]
        to, total = assignments(np.stack([c for _, c in now]))
        for (i, c), t, whole in zip(now, to, total):
            if not whole / 2 < best[i] - 1e-12:
                continue
            found, odd = _paired(c, t)
            best[i] = min(best[i], found)
            if odd and whole / 2 < best[i] - 1e-12:
                p, q = max(zip(odd, np.roll(odd, -1)), key=lambda e: c[e])
                without, only = c.copy(), c.copy()
                without[[p, q], [q, p]] = np.inf
                for a, b in ((p, q), (q, p)):
                    only[a, np.arange(k) != b] = np.inf
                    only[np.arange(k) != b, a] = np.inf
                stack += [(i, only), (i, without)]
    return best


def matching_centrosymmetry(atoms: DataFrame, nearest: DataFrame, k: int = 12) -> DataFrame:
    """``(frame, id, csp)``: centrosymmetry by the cheapest perfect matching of the k nearest, k even and up to 32; 0 with fewer than k."""
    if k % 2 or not 2 <= k <= 32:
        raise ValueError("k must be even, from 2 to 32")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums, full = np.zeros(len(b)), np.flatnonzero(b["v"].map(len).to_numpy() == 3 * k)
            for at in np.array_split(full, max(1, len(full) // 512)):
                if len(at):
                    sums[at] = best_matchings(np.stack(b["v"].iloc[at].to_list()).astype(float).reshape(-1, k, 3))
            yield pd.DataFrame({"frame": b["frame"], "id": b["id"], "csp": sums})

    near = nearest.where(F.col("rank") <= k).groupBy("frame", F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.array("dx", "dy", "dz").alias("d")))).alias("w"))
    near = near.select("frame", "id", F.flatten(F.transform("w", lambda x: x["d"])).alias("v"))
    found = near.mapInPandas(match, f"frame {near.schema['frame'].dataType.simpleString()}, id long, csp double")
    return atoms.select("frame", "id").join(found, ["frame", "id"], "left").select("frame", "id", F.coalesce("csp", F.lit(0.0)).alias("csp"))


def symmetry_histogram(csp: DataFrame, bins: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, bin, atoms)`` over all rows, or those of the same ``by``: width 1.01 max / bins, or 1 if the maximum is 0."""
    top = csp.groupBy(*by).agg(F.max("csp").alias("top"))
    width = F.when(F.col("top") > 0, F.col("top") * 1.01 / bins).otherwise(1.0)
    topped = csp.join(top, [*by]) if by else csp.crossJoin(F.broadcast(top))
    found = topped.groupBy(*by, F.floor(F.col("csp") / width).cast("int").alias("bin")).agg(F.count("*").alias("atoms"))
    grid = csp.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    grid = top.select(*by).crossJoin(F.broadcast(grid)) if by else grid
    return grid.join(found, [*by, "bin"], "left").select(*by, "bin", F.coalesce("atoms", F.lit(0)).alias("atoms"))


# Structure types and their names.
STRUCTURE_NAMES = {0: "OTHER", 1: "FCC", 2: "HCP", 3: "BCC", 4: "CUBIC_DIAMOND", 5: "HEX_DIAMOND"}


def _signatures(v: np.ndarray, cutoff: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each neighbour of each atom: common neighbours, bonds among them, longest chain of those bonds."""
    d = np.sqrt(((v[:, :, None] - v[:, None]) ** 2).sum(-1))
    bonded = (d < cutoff[:, None, None]) & ~np.eye(v.shape[1], dtype=bool)
    out = []
    for i in range(v.shape[1]):
        common = bonded[:, i]
        inner = bonded & common[:, :, None] & common[:, None, :]
        bonds = inner.sum((1, 2)) // 2
        # bonds in the largest connected part: spread labels to the smallest, then count by label
        label = np.where(inner.any(-1), np.arange(v.shape[1]), -1)
        for _ in range(v.shape[1]):
            near = np.where(inner, np.where(label[:, None, :] >= 0, label[:, None, :], v.shape[1]), v.shape[1]).min(-1)
            label = np.where(label >= 0, np.minimum(label, near), -1)
        chain = np.max([((label == k)[:, :, None] & inner).sum((1, 2)) // 2 for k in range(v.shape[1])], axis=0)
        out.append((common.sum(-1), bonds, chain))
    return out


def classify_neighbors(v: np.ndarray) -> np.ndarray:
    """Structure type of each atom from its 14 nearest vectors (sorted): adaptive common neighbour analysis."""
    r = np.sqrt((v**2).sum(-1))
    kind = np.zeros(len(v), np.int32)
    close = r[:, :12].mean(1) * (1 + math.sqrt(2)) / 2
    fits = r[:, 12] > close
    fits &= r[:, 11] < close
    sig = _signatures(v[:, :12], close)
    n421 = sum(((c == 4) & (b == 2) & (m == 1)).astype(int) for c, b, m in sig)
    n422 = sum(((c == 4) & (b == 2) & (m == 2)).astype(int) for c, b, m in sig)
    kind[fits & (n421 == 12)] = 1
    kind[fits & (n421 == 6) & (n422 == 6)] = 2
    wide = (r[:, :8].mean(1) / (math.sqrt(3) / 2)) * (1 + math.sqrt(2)) / 2
    fits = r[:, 13] < wide
    if v.shape[1] > 14:
        fits &= r[:, 14] > wide
    sig = _signatures(v[:, :14], wide)
    n444 = sum(((c == 4) & (b == 4) & (m == 4)).astype(int) for c, b, m in sig)
    n666 = sum(((c == 6) & (b == 6) & (m == 6)).astype(int) for c, b, m in sig)
    kind[(kind == 0) & fits & (n444 == 6) & (n666 == 8)] = 3
    return kind


def local_structure(atoms: DataFrame, nearest: DataFrame) -> DataFrame:
    """``(frame, id, structure_type, structure)`` by common neighbour analysis of the 15 nearest; fewer give OTHER."""

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kind = np.zeros(len(b), np.int32)
            full = np.flatnonzero(b["v"].map(len).to_numpy() == 15)
            for at in np.array_split(full, max(1, len(full) // 2000)):
                if len(at):
                    v = np.stack([np.stack([np.asarray(x, float) for x in b["v"].iloc[i]]) for i in at])
                    kind[at] = classify_neighbors(v)
            yield pd.DataFrame({"frame": b["frame"], "id": b["id"], "structure_type": kind})

    near = nearest.where("rank <= 15").groupBy("frame", F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.array("dx", "dy", "dz").alias("d")))).alias("w"))
    near = near.select("frame", "id", F.transform("w", lambda x: x["d"]).alias("v"))
    found = near.mapInPandas(classify, f"frame {near.schema['frame'].dataType.simpleString()}, id long, structure_type int")
    names = F.create_map(*[F.lit(x) for kv in STRUCTURE_NAMES.items() for x in kv])
    kind = F.coalesce("structure_type", F.lit(0))
    return atoms.select("frame", "id").join(found, ["frame", "id"], "left").select("frame", "id", kind.alias("structure_type"), F.element_at(names, kind).alias("structure"))


def structure_statistics(typed: DataFrame) -> DataFrame:
    """``(frame, structure, atoms, percentage)`` per name; OTHER is what was not identified."""
    counts = typed.groupBy("frame", "structure").agg(F.count("*").alias("atoms"))
    return counts.withColumn("percentage", F.col("atoms") * 100.0 / F.sum("atoms").over(Window.partitionBy("frame")))


def identification(typed: DataFrame) -> DataFrame:
    """``(frame, identified, unidentified, rate, structures)``: how many atoms have a structure, their share, and how many structures there are."""
    known = F.col("structure") != "OTHER"
    told = typed.groupBy("frame").agg(F.count(F.when(known, 1)).alias("identified"), F.count(F.when(~known, 1)).alias("unidentified"), F.countDistinct(F.when(known, F.col("structure"))).alias("structures"))
    return told.select("frame", "identified", "unidentified", (F.col("identified") / (F.col("identified") + F.col("unidentified"))).alias("rate"), "structures")
