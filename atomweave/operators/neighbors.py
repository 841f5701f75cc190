"""Neighbour joins in periodic cells: all pairs within a cutoff, and the k nearest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.functions.cell import edges, reduced, with_geometry, wrapped
from atomweave.operators.graph import connected_components
from atomweave.session import cut, shuffle_width

#: Atoms of a tile at even density, and rows that a tile may hold with its halo; the atoms of fuller ones are joined by bins.
PER_TILE, MOST_IN_TILE = 4096, 500_000
#: Atoms whose distances are taken at once, and the most distances.
TOGETHER, DISTANCES = 64, 1 << 22


def _placed() -> Column:
    """Whether an atom has a position; those with a null or NaN coordinate are nobody's neighbours."""
    out = F.lit(True)
    for c in "xyz":
        out = out & F.col(c).isNotNull() & ~F.isnan(c)
    return out


def _binned(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """Atoms with their wrapped positions and, in reduced coordinates, the bins of their cell."""
    placed = atoms.select("frame", "id", "x", "y", "z").where(_placed()).join(cells, "frame")
    s = wrapped(reduced([F.col("x"), F.col("y"), F.col("z")]))
    placed = placed.select("*", *[c.alias(f"s{i}") for i, c in enumerate(s)])
    e = edges()
    wrap = [sum((F.col(f"s{k}") * e[k][i] for k in range(1, 3)), F.col("s0") * e[0][i]) + F.get("origin", F.lit(i)) for i in range(3)]
    bins = [F.greatest(F.lit(0), F.least(F.floor(F.col(f"s{i}") * F.get("bins", F.lit(i))), F.get("bins", F.lit(i)) - 1)).cast("int") for i in range(3)]
    return placed.select("*", *[c.alias(n) for n, c in zip(("wx", "wy", "wz"), wrap)], *[b.alias(f"b{i}") for i, b in enumerate(bins)])


def _with_volume(cells: DataFrame) -> DataFrame:
    return with_geometry(cells).withColumn("volume", F.when(F.col("volume") > 1e-12, F.col("volume")).otherwise(F.raise_error(F.lit("a cell has no volume"))))


def tiled(atoms: DataFrame, cells: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Atoms dealt to tiles: in their own as ``center``, and as the images ``(sx, sy, sz)`` within the cutoff of other tiles.

    ``cells`` have a ``cutoff`` and the ``side`` of a tile per frame. Rows are ``(frame, tx, ty, tz, id, wx, wy, wz, sx, sy, sz,
    mx, my, mz, most, center)`` and the ``carried`` columns: an image stands at w + m, ``most`` is the cutoff squared. A tile's
    rows hold all pairs of its centers; a row's work in it is bounded by the local density, none moves a pair.
    """
    cells = _with_volume(cells).where("volume > 0")
    part = lambda c, i: F.get(c, F.lit(i))
    cells = cells.withColumn("bins", F.array(*[F.least(F.greatest(F.lit(1.0), F.floor(part("heights", i) / F.col("side"))), F.lit(1e6)).cast("int") for i in range(3)]))
    rows = _binned(atoms, cells)
    if carried:
        rows = rows.join(atoms.select("frame", "id", *carried), ["frame", "id"])
    for i in range(3):
        reach = F.col("cutoff") / part("heights", i) * (1 + 1e-9) + 1e-12
        n = part("bins", i)
        low, high = (F.floor((F.col(f"s{i}") + r) * n) for r in (-reach, reach))
        inside = lambda t: F.greatest(F.lit(0).cast("long"), F.least(t, n.cast("long") - 1))  # noqa: B023,E731
        steps = F.when(part("pbc", i), F.sequence(low, high)).otherwise(F.sequence(inside(low), inside(high)))
        rows = rows.withColumn(f"u{i}", F.explode(steps))
    shift = [F.floor(F.col(f"u{i}") / part("bins", i)) for i in range(3)]
    own = F.lit(True)
    for i in range(3):
        own = own & (F.col(f"u{i}") == F.col(f"b{i}"))
    rows = rows.select("*", *[(-v).cast("int").alias(f"s{c}") for v, c in zip(shift, "xyz")], *[(F.col(f"u{i}") - v * part("bins", i)).cast("int").alias(f"t{c}") for i, (v, c) in enumerate(zip(shift, "xyz"))], own.alias("center"))
    e = edges()
    moved = [F.col("sx") * e[0][i] + F.col("sy") * e[1][i] + F.col("sz") * e[2][i] for i in range(3)]
    return rows.select("frame", "tx", "ty", "tz", "id", "wx", "wy", "wz", "sx", "sy", "sz", *[m.alias(n) for m, n in zip(moved, ("mx", "my", "mz"))], (F.col("cutoff") * F.col("cutoff")).alias("most"), "center", *carried)


def tile_sides(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` with a ``side``: tiles of some thousand atoms or, at high density, four times the cutoff, so that halos stay thin."""
    n = atoms.groupBy("frame").agg(F.count("*").alias("_n"))
    size = lambda atoms: F.pow(F.col("volume") * atoms / F.col("_n"), F.lit(1 / 3))
    side = F.greatest(size(PER_TILE), F.least(F.col("cutoff") * 4, size(16 * PER_TILE)))
    found = with_geometry(cells).join(n, "frame").select("frame", side.alias("side"))
    return cells.join(found, "frame")


def distances(rows: pa.Table, settled: Callable[[np.ndarray, np.ndarray], bool] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(centers, others, squared distances)`` of a tile's rows, block by block: all its pairs within the cutoff and some beyond.

    Centers are halved along their longest side until few are left; rows further off than the cutoff go on the way. Blocks that are
    ``settled`` when they come up are left out.
    """
    w = np.stack([rows.column(c).to_numpy() for c in ("wx", "wy", "wz")], 1)
    m = np.stack([rows.column(c).to_numpy() for c in ("mx", "my", "mz")], 1)
    at = w + m
    near = np.sqrt(rows.column("most")[0].as_py()) * (1 + 1e-9) + 1e-12
    stack = [(np.flatnonzero(rows.column("center").to_numpy(zero_copy_only=False)), np.arange(len(w)))]
    while stack:
        some, others = stack.pop()
        if not len(some) or settled is not None and settled(some, others):
            continue
        low, high = at[some].min(0), at[some].max(0)
        if len(some) > 1 and (len(some) > TOGETHER or len(some) * len(others) > DISTANCES):
            axis = int((high - low).argmax())
            along = at[some, axis]
            order = np.argpartition(along, len(some) // 2)
            for half in (order[: len(some) // 2], order[len(some) // 2 :]):
                x = at[others, axis]
                stack.append((some[half], others[(x >= along[half].min() - near) & (x <= along[half].max() + near)]))
            continue
        others = others[((at[others] >= low - near) & (at[others] <= high + near)).all(1)]
        if settled is not None and settled(some, others):
            continue
        d2 = None
        for c in range(3):
            d = m[others, c] - w[some, c][:, None]
            d += w[others, c]
            d *= d
            d2 = d if d2 is None else d2 + d
        yield some, others, d2


def _in_tiles(atoms: DataFrame, cells: DataFrame, cutoff: float, carried: tuple[str, ...] = ()):
    """The rows of ``tiled`` for one cutoff, by tile."""
    if cutoff <= 0:
        raise ValueError("the cutoff must be positive")
    rows = tiled(atoms, tile_sides(atoms, cells.withColumn("cutoff", F.lit(float(cutoff)))), carried)
    # by bytes a few tasks would do; the distances ask for all
    tile = ["frame", "tx", "ty", "tz"]
    return rows.repartition(shuffle_width(atoms.sparkSession), *tile).groupBy(*tile)


#: What ``pairs_within`` can tell of a pair, with their types.
PAIR = {"i": "long", "j": "long", "dx": "double", "dy": "double", "dz": "double", "d2": "double", "sx": "int", "sy": "int", "sz": "int"}


def pairs_within(atoms: DataFrame, cells: DataFrame, cutoff: float, columns: tuple[str, ...] = tuple(PAIR)) -> DataFrame:
    """``frame`` and ``columns`` of the pairs that ``cutoff_neighbors`` gives, for callers that read each pair once.

    Tiles tell their own pairs, block by block: atoms and halos are shuffled, so what is written grows with the atoms, and no task
    holds the pairs of a tile, however many there are.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        value = {c: rows.column(c).to_numpy() for c in ("id", "wx", "wy", "wz", "mx", "my", "mz", "sx", "sy", "sz")}
        most, frame = rows.column("most")[0].as_py(), rows.column("frame").chunk(0).slice(0, 1)
        for some, others, d2 in distances(rows):
            p, q = np.nonzero((d2 <= most) & (others != some[:, None]))
            if not len(p):
                continue
            a, b = some[p], others[q]
            found = {"i": lambda: value["id"][a], "j": lambda: value["id"][b], "d2": lambda: d2[p, q]}  # noqa: B023
            for c in "xyz":
                found[f"d{c}"] = lambda c=c: value[f"w{c}"][b] + (value[f"m{c}"][b] - value[f"w{c}"][a])  # noqa: B023
                found[f"s{c}"] = lambda c=c: value[f"s{c}"][b]  # noqa: B023
            told = [pa.array(found[c]()) for c in columns]
            yield pa.record_batch([frame.take(pa.array(np.zeros(len(p), np.int64))), *told], names=["frame", *columns])

    kind = atoms.schema["frame"].dataType.simpleString()
    of = {**PAIR, **dict.fromkeys("ij", atoms.schema["id"].dataType.simpleString())}
    return _in_tiles(atoms, cells, cutoff).applyInArrow(work, ", ".join([f"frame {kind}", *[f"{c} {of[c]}" for c in columns]]))


def counted_within(atoms: DataFrame, cells: DataFrame, cutoff: float) -> DataFrame:
    """``(frame, id, count)``: how many pairs each atom with a position has within ``cutoff``; tiles count, no pair is a row."""

    def work(rows: pa.Table) -> pa.Table:
        most, count = rows.column("most")[0].as_py(), np.zeros(rows.num_rows, np.int64)
        for some, others, d2 in distances(rows):
            count[some] += ((d2 <= most) & (others != some[:, None])).sum(1)
        own = np.flatnonzero(rows.column("center").to_numpy(zero_copy_only=False))
        return pa.table([rows.column("frame").take(pa.array(own)), rows.column("id").take(pa.array(own)), pa.array(count[own])], names=["frame", "id", "count"])

    of = {f.name: f.dataType.simpleString() for f in atoms.select("frame", "id").schema}
    return _in_tiles(atoms, cells, cutoff).applyInArrow(work, f"frame {of['frame']}, id {of['id']}, count long")


def _joining(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links a-b that join parts which no link before joins; ``root``, the smallest row of each row's part, is brought up to date."""
    taken, at = [np.zeros(0, np.int64)], np.arange(len(a))
    while True:
        u, v = root[a[at]], root[b[at]]
        apart = u != v
        at, high, low = at[apart], np.maximum(u, v)[apart], np.minimum(u, v)[apart]
        if not len(at):
            return np.concatenate(taken)
        first = np.unique(high, return_index=True)[1]  # a part is hung on a smaller one, by its first link to one
        root[high[first]] = low[first]
        taken.append(at[first])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def _same_cell(rows: pa.Table, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows to the first one of their cell, for cells with a center that are so small that any two rows in one are near."""
    at = np.stack([rows.column(f"w{c}").to_numpy() + rows.column(f"m{c}").to_numpy() for c in "xyz"], 1)
    cell = np.floor((at - at.min(0)) / (cutoff / np.sqrt(3) * (1 - 1e-6)))
    order = np.lexsort((np.arange(len(cell)), *cell.T))
    new = np.ones(len(order), bool)
    new[1:] = (cell[order[1:]] != cell[order[:-1]]).any(1)
    group = np.cumsum(new) - 1
    own = np.bincount(group, rows.column("center").to_numpy(zero_copy_only=False)[order]) > 0
    keep = ~new & own[group]
    return order[keep], order[new][group[keep]]


def _forest(rows: pa.Table, coincident: bool, cellwise: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a tile's sorted rows the smallest row that each hangs together with, and the links a-b that say so; ``cellwise`` links what lies in one small cell first."""
    most = rows.column("most")[0].as_py()
    root, kept, held = np.arange(rows.num_rows), [], []

    def settle() -> None:
        a, b = (np.concatenate(x) for x in zip(*held))
        at = _joining(root, a, b)
        kept.append((a[at], b[at]))
        held.clear()

    if cellwise:
        held.append(_same_cell(rows, np.sqrt(most)))
        settle()
    for some, others, d2 in distances(rows, lambda some, others: bool((root[others] == root[some[0]]).all())):
        p, q = np.nonzero((d2 <= most) if coincident else (d2 <= most) & (d2 > 0))
        a, b = some[p], others[q]
        apart = root[a] != root[b]
        held.append((a[apart], b[apart]))
        if sum(len(x) for x, _ in held) > (DISTANCES >> 4 if cellwise else DISTANCES):
            settle()
    if held:
        settle()
    return root, kept


def parts_within(atoms: DataFrame, cells: DataFrame, cutoff: float) -> DataFrame:
    """``(frame, id, root)``: the smallest atom that each atom with a position hangs together with over pairs within ``cutoff``.

    Tiles tell the parts of their own atoms and halos. An atom that several tiles see joins their parts, so what contracts in rounds
    over the whole frame are links between parts of tiles, not between atoms.
    """
    atoms = atoms.where(F.col("id").isNotNull())

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("id", "sx", "sy", "sz")])
        root, ids = _forest(rows, True, True)[0], rows.column("id").to_numpy()
        # an atom and its own image are one
        first = np.searchsorted(ids, ids)
        same = np.flatnonzero(first != np.arange(len(ids)))
        _joining(root, same, first[same])
        own = rows.column("center").to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(own | (np.bincount(root, own, len(root)) > 0)[root])  # parts of halo alone tell nothing
        return pa.table([*[rows.column(c).take(pa.array(kept)) for c in ("frame", "id")], pa.array(ids[root[kept]]), pa.array(own[kept])], names=["frame", "id", "part", "own"])

    of = {f.name: f.dataType.simpleString() for f in atoms.select("frame", "id").schema}
    told = cut(_in_tiles(atoms, cells, cutoff).applyInArrow(work, f"frame {of['frame']}, id {of['id']}, part {of['id']}, own boolean"), "parts")
    met = told.groupBy("frame", "id").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most").select("frame", "id", "least")
    links = told.join(met, ["frame", "id"]).where("part > least").select("frame", "part", "least").distinct()
    key = lambda c: F.struct("frame", F.col(c).alias("id"))
    found = connected_components(links.select(key("part").alias("src"), key("least").alias("dst")))
    found = found.select(F.col("vertex.frame").alias("frame"), F.col("vertex.id").alias("part"), F.col("component.id").alias("root"))
    own = told.where("own").select("frame", "id", "part").join(found, ["frame", "part"], "left")
    return own.select("frame", "id", F.coalesce("root", "part").alias("root"))


def spanning_links(atoms: DataFrame, cells: DataFrame, cutoff: float, coincident: bool = True) -> DataFrame:
    """``(frame, i, j, dx, dy, dz)``, i < j: of the pairs within ``cutoff`` some that hold together the same atoms as all do.

    A tile keeps a link only if it joins what its links before don't, so there are fewer links than rows of tiles, however dense
    the frame is; atoms that meet in no tile meet through others. Ways along the links are ways along pairs. Reruns agree.
    Without ``coincident`` pairs at distance 0 don't count.
    """

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("id", "sx", "sy", "sz")])
        ids, kept = rows.column("id").to_numpy(), _forest(rows, coincident, False)[1]
        a, b = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 2
        a, b = a[ids[a] != ids[b]], b[ids[a] != ids[b]]  # an atom and its own image are one already
        sign = np.where(ids[a] < ids[b], 1.0, -1.0)
        value = {c: rows.column(c).to_numpy() for c in ("wx", "wy", "wz", "mx", "my", "mz")}
        delta = [pa.array(sign * (value[f"w{c}"][b] + (value[f"m{c}"][b] - value[f"w{c}"][a]))) for c in "xyz"]
        ends = [pa.array(f(ids[a], ids[b])) for f in (np.minimum, np.maximum)]
        return pa.table([rows.column("frame").take(pa.array(a)), *ends, *delta], names=["frame", "i", "j", "dx", "dy", "dz"])

    of = {f.name: f.dataType.simpleString() for f in atoms.select("frame", "id").schema}
    schema = f"frame {of['frame']}, i {of['id']}, j {of['id']}, dx double, dy double, dz double"
    return _in_tiles(atoms, cells, cutoff).applyInArrow(work, schema)


def cutoff_neighbors(atoms: DataFrame, cells: DataFrame, cutoff: float | None, centers: DataFrame | None = None) -> DataFrame:
    """Directed pairs ``(frame, i, j, dx, dy, dz, d2, sx, sy, sz)`` with d2 <= cutoff**2.

    ``atoms(frame, id, x, y, z)``, ``cells(frame, a, b, c, origin, pbc)``. Every periodic image counts, an atom's own
    images included; only an atom with itself under no shift is left out. Shifts are in cells, between wrapped
    positions. Atoms outside along an open axis go to the edge bins; atoms with a null or NaN coordinate are left out.
    Each atom is sent to one of each two opposite bins that its sphere can touch and joined there on equal bin numbers,
    and each pair found is told both ways, so work grows with the number of near pairs. A cutoff of 0 or less, or a flat
    cell, is an error. With a cutoff of None each frame has its own, the column ``cutoff`` of ``cells``. ``centers(frame,
    id)`` are the only atoms i, if given.
    """
    if cutoff is not None and cutoff <= 0:
        raise ValueError("the cutoff must be positive")
    cells = cells.withColumn("cutoff", F.col("cutoff") if cutoff is None else F.lit(float(cutoff)))
    cells = _with_volume(cells)
    count = lambda i: F.greatest(F.lit(1), F.floor(F.get("heights", F.lit(i)) / F.col("cutoff"))).cast("int")
    reach = lambda i: F.ceil(F.col("cutoff") * F.get("bins", F.lit(i)) / F.get("heights", F.lit(i))).cast("int")
    cells = cells.where("volume > 0").withColumn("bins", F.array(*[count(i) for i in range(3)]))
    cells = cells.withColumn("reach", F.array(*[reach(i) for i in range(3)]))
    placed = _binned(atoms, cells)
    left = placed if centers is None else placed.join(centers.select("frame", "id"), ["frame", "id"], "left_semi")
    left = left.withColumn("o", F.explode(_offsets(half=centers is None)))
    for i, (t, shift) in enumerate((("tx", "sx"), ("ty", "sy"), ("tz", "sz"))):
        n, to = F.get("bins", F.lit(i)), F.col(f"b{i}") + F.col(f"o.{t[1]}")
        left = left.withColumn(shift, F.when(F.get("pbc", F.lit(i)), F.floor(to / n)).otherwise(0).cast("int"))
        left = left.withColumn(t, (to - F.col(shift) * n).cast("int"))
    for i, t in enumerate(("tx", "ty", "tz")):
        left = left.where((F.col(t) >= 0) & (F.col(t) < F.get("bins", F.lit(i))))
    e = edges()
    moved = [sum((F.col(s) * e[k][i] for k, s in ((1, "sy"), (2, "sz"))), F.col("sx") * e[0][i]) for i in range(3)]
    own = (F.col("o.x") == 0) & (F.col("o.y") == 0) & (F.col("o.z") == 0)
    left = left.select("frame", F.col("id").alias("i"), *[(m - F.col(w)).alias(f"o{w}") for m, w in zip(moved, ("wx", "wy", "wz"))], "tx", "ty", "tz", "sx", "sy", "sz", own.alias("own"), (F.col("cutoff") * F.col("cutoff")).alias("most"))
    right = placed.select("frame", F.col("id").alias("j"), "wx", "wy", "wz", F.col("b0").alias("tx"), F.col("b1").alias("ty"), F.col("b2").alias("tz"))
    delta = [F.col(w) + F.col(f"o{w}") for w in ("wx", "wy", "wz")]
    d2 = delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2]
    pairs = left.join(right, ["frame", "tx", "ty", "tz"])
    vector = [d.alias(n) for d, n in zip(delta, ("dx", "dy", "dz"))]
    if centers is not None:
        pairs = pairs.where((d2 <= F.col("most")) & ~((F.col("i") == F.col("j")) & F.col("own")))
        return pairs.select("frame", "i", "j", *vector, d2.alias("d2"), "sx", "sy", "sz")
    pairs = pairs.where((d2 <= F.col("most")) & (~F.col("own") | (F.col("i") < F.col("j")))).select("frame", "i", "j", *vector, d2.alias("d2"), "sx", "sy", "sz")
    turned = [F.col("j").alias("i"), F.col("i").alias("j"), *[(-F.col(c)).alias(c) for c in ("dx", "dy", "dz")], "d2", *[(-F.col(c)).alias(c) for c in ("sx", "sy", "sz")]]
    there = ["i", "j", "dx", "dy", "dz", "d2", "sx", "sy", "sz"]
    return pairs.select("frame", F.explode(F.array(F.struct(*there), F.struct(*turned))).alias("p")).select("frame", *[f"p.{c}" for c in there])


def _offsets(half: bool) -> Column:
    """Steps ``(x, y, z)`` to the bins within reach; with ``half`` the own bin and one of each two opposite ones."""
    steps = lambda i: F.sequence(-F.get("reach", F.lit(i)), F.get("reach", F.lit(i)))
    cube = F.flatten(F.transform(steps(0), lambda x: F.flatten(F.transform(steps(1), lambda y: F.transform(steps(2), lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))
    zero = F.struct(*[F.lit(0).alias(c) for c in "xyz"])
    return F.filter(cube, lambda o: o >= zero) if half else cube


def _extent() -> Column:
    """No two atoms of a frame without periodic axes are further apart than this."""
    return F.sqrt(sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in "yz"), (F.max("x") - F.min("x")) * (F.max("x") - F.min("x"))))


def _nearest_in_tile(k: int):
    """Kernel on the rows of a tile: its centers' nearest by rank, and rank 0 for a center with under ``k``."""

    def work(rows: pa.Table) -> pa.Table:
        ids, shifts = rows.column("id").to_numpy(), [rows.column(c).to_numpy() for c in ("sx", "sy", "sz")]
        w = [rows.column(c).to_numpy() for c in ("wx", "wy", "wz")]
        m = [rows.column(c).to_numpy() for c in ("mx", "my", "mz")]
        most = rows.column("most")[0].as_py()
        none = np.zeros(0, np.int64)
        found = [(none, none, none, none.astype(bool))]
        for some, others, d2 in distances(rows):
            d2[(d2 > most) | (d2 == 0)] = np.inf
            last = np.partition(d2, k - 1, axis=1)[:, k - 1] if d2.shape[1] >= k else np.full(len(some), np.inf)
            full = np.isfinite(last)
            p, q = np.nonzero((d2 <= (last + 2e-9)[:, None]) & np.isfinite(d2))  # ties to nine decimals too
            o = others[q]
            order = np.lexsort((*[s[o] for s in shifts[::-1]], ids[o], np.floor(d2[p, q] * 1e9 + 0.5), p))
            p, o = p[order], o[order]
            rank = np.arange(len(p)) - np.searchsorted(p, p) + 1
            keep = rank <= k
            p, o, rank = p[keep], o[keep], rank[keep]
            short = some[~full]
            found.append((np.concatenate([some[p], short]), np.concatenate([o, short]), np.concatenate([rank, np.zeros(len(short), rank.dtype)]), np.concatenate([full[p], np.zeros(len(short), bool)])))
        i, o, rank, full = (np.concatenate(x) for x in zip(*found))
        delta = [w[c][o] + (m[c][o] - w[c][i]) for c in range(3)]
        shift = [pa.array(x[o]) for x in shifts]
        columns = [rows.column("frame").take(pa.array(i)), rows.column("id").take(pa.array(i)), rows.column("id").take(pa.array(o)), *map(pa.array, delta), *shift, pa.array(rank.astype(np.int32)), pa.array(full)]
        return pa.table(columns, names="frame i j dx dy dz sx sy sz rank full".split())

    return work


def nearest_neighbors(atoms: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest images of each atom: pairs as above with ``rank`` from 1, by d2 to nine decimals and
    then j.

    Images at distance 0 don't count, nor do atoms without a position, which have no neighbours. Each frame's cutoff starts where a uniform density has more than k neighbours by four
    deviations: atoms are dealt to tiles with all that is within it, and each tile ranks its own, so no pair is moved that is not
    among the nearest. The cutoff is doubled for the atoms that have fewer, until none has or, in frames without periodic axes, all
    atoms are within it: only atoms of such frames can end with fewer than k.
    """
    atoms = atoms.where(_placed())
    n = atoms.groupBy("frame").agg(F.count("*").alias("count"), _extent().alias("extent"))
    enough = k + 4 * k**0.5 + 4
    guess = F.pow(F.col("volume") * (enough * 3 / (4 * 3.141592653589793)) / F.col("count"), F.lit(1 / 3))
    side = F.pow(F.col("volume") * PER_TILE / F.col("count"), F.lit(1 / 3))
    found = with_geometry(cells).join(n, "frame").select("frame", guess.alias("cutoff"), side.alias("side"), "extent")
    sized = cut(cells.drop("cutoff", "side").join(found, "frame"), "cutoffs")
    open_frames = sized.where(~F.exists("pbc", lambda p: p)).select("frame", "cutoff", "extent")
    tile = ["frame", "tx", "ty", "tz"]
    rows = tiled(atoms, sized.drop("extent"))
    crowded = cut(rows.groupBy(*tile).count().where(F.col("count") > MOST_IN_TILE).select(*tile), "crowded")
    if crowded.isEmpty():
        late = None
    else:
        late = rows.where("center").join(crowded, tile, "left_semi").select("frame", "id")
        rows = rows.join(crowded, tile, "left_anti")
    of = {f.name: f.dataType.simpleString() for f in atoms.select("frame", "id").schema}
    schema = f"frame {of['frame']}, i {of['id']}, j {of['id']}, dx double, dy double, dz double, sx int, sy int, sz int, rank int, full boolean"
    ranked = cut(rows.groupBy(*tile).applyInArrow(_nearest_in_tile(k), schema), "nearest")
    d2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")
    there = ["frame", "i", "j", "dx", "dy", "dz", d2.alias("d2"), "sx", "sy", "sz", "rank"]
    over = open_frames.where(F.col("cutoff") > F.col("extent")).select("frame")
    out = ranked.where("rank > 0 AND full").select(*there).unionAll(ranked.where("rank > 0 AND NOT full").join(over, "frame", "left_semi").select(*there))
    wanted = cut(ranked.where("rank = 0").join(over, "frame", "left_anti").select("frame", "i"), "wanted")
    factor = 2.0
    if late is not None:
        wanted, factor = cut(wanted.unionAll(late.select("frame", F.col("id").alias("i"))), "wanted"), 1.0
    order = Window.partitionBy("frame", "i").orderBy(F.round("d2", 9), "j", "sx", "sy", "sz")
    while not wanted.isEmpty():
        scaled = sized.withColumn("cutoff", F.col("cutoff") * factor).drop("extent", "side")
        pairs = cutoff_neighbors(atoms, scaled, None, wanted.select("frame", F.col("i").alias("id"))).where("d2 > 0")
        ranked = cut(pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        full = ranked.where(F.col("rank") == k).select("frame", "i")
        over = open_frames.where(F.col("cutoff") * factor > F.col("extent")).select("frame")
        wanted = cut(wanted.join(full, ["frame", "i"], "left_anti").join(over, "frame", "left_anti"), "wanted")
        out = out.unionAll(ranked.join(wanted, ["frame", "i"], "left_anti"))
        factor *= 2
    return out
