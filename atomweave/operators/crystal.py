"""Crystal templates, template matching of neighbour shells, and what rests on orientations: strain, clusters, grains."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomweave.functions.linalg import column_major, cubic_disorientation, det, gram, graph_weight, hexagonal_disorientation, inverse, product
from atomweave.operators.graph import connected_components
from atomweave.operators.ranking import numbered
from atomweave.operators.structure import STRUCTURE_NAMES

# Structures by type number, and the numbers of neighbours that they are told by.
KINDS = {"FCC": 1, "HCP": 2, "BCC": 3, "CUBIC_DIAMOND": 4, "HEX_DIAMOND": 5, "SC": 6}
SHELLS = {"FCC": 12, "HCP": 12, "BCC": 14, "CUBIC_DIAMOND": 16, "HEX_DIAMOND": 16, "SC": 6}


def _cubic_rotations() -> np.ndarray:
    """The 24 proper rotations of the cube: signed permutation matrices of determinant 1."""
    out = []
    for p in itertools.permutations(range(3)):
        for s in itertools.product((1, -1), repeat=3):
            m = np.zeros((3, 3))
            m[range(3), p] = s
            if np.linalg.det(m) > 0:
                out.append(m)
    return np.array(out)


def _hexagonal_rotations() -> np.ndarray:
    """The 6 proper rotations that keep a close-packed hexagonal shell: thirds of a turn about z and half turns across."""
    turn = lambda a: np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    flip = np.diag([-1.0, 1.0, -1.0])
    return np.array([turn(k * 2 * math.pi / 3) @ f for k in range(3) for f in (np.eye(3), flip)])


def lattice_vectors(kind: str) -> np.ndarray:
    """Neighbour vectors of an atom, first shell first; the edge of the cubic cell, or the close-packed distance, is 1."""
    signs = lambda *v: sorted({tuple(s * x for s, x in zip(t, q)) for q in itertools.permutations(v) for t in itertools.product((1, -1), repeat=3)})
    if kind == "SC":
        return np.array(signs(1, 0, 0), float)
    if kind == "FCC":
        return np.array(signs(0.5, 0.5, 0), float)
    if kind == "BCC":
        return np.array(signs(0.5, 0.5, 0.5) + signs(1, 0, 0), float)
    plane = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3), 0.0) for k in range(6)]
    height, off = math.sqrt(2 / 3), 1 / math.sqrt(3)
    above = [(off * math.cos(a), off * math.sin(a), height) for a in (math.pi / 6 + k * 2 * math.pi / 3 for k in range(3))]
    hcp = np.array(plane + above + [(x, y, -z) for x, y, z in above])
    if kind == "HCP":
        return hcp
    if kind == "CUBIC_DIAMOND":
        first = [v for v in signs(0.25, 0.25, 0.25) if v[0] * v[1] * v[2] > 0]
        return np.array(first + signs(0.5, 0.5, 0), float)
    if kind == "HEX_DIAMOND":  # the close-packed shell around an atom, and its partners of the other sublattice
        bond = math.sqrt(3 / 8)
        return np.array([(0.0, 0.0, -bond), *[(x, y, bond / 3) for x, y, _ in above], *map(tuple, hcp)])
    raise ValueError(f"no lattice {kind!r}")


def symmetries(kind: str) -> np.ndarray:
    """Proper rotations that map the lattice's neighbour vectors to themselves, the identity first."""
    ops = _hexagonal_rotations() if kind in ("HCP", "HEX_DIAMOND") else _cubic_rotations()
    v = lattice_vectors(kind)
    kept = [m for m in ops if all(np.min(np.abs(v - w).max(1)) < 1e-9 for w in v @ m.T)]
    return np.array(sorted(kept, key=lambda m: -np.trace(m)))


def permutations(kind: str) -> np.ndarray:
    """For each symmetry the neighbour that each neighbour is moved to."""
    v = lattice_vectors(kind)
    return np.array([[int(np.argmin(np.abs(v - w).max(1))) for w in v @ m.T] for m in symmetries(kind)])


def symmetry_products(kind: str) -> np.ndarray:
    """The number of the symmetry that is one after the other, for each two."""
    ops = symmetries(kind)
    return np.array([[int(np.argmin(np.abs(ops - a @ b).max((1, 2)))) for b in ops] for a in ops])


def lattice_table(spark: SparkSession) -> DataFrame:
    """``(structure, place, x, y, z, common)``: neighbour vectors and, for each, its neighbours that are the atom's too."""
    rows = []
    for kind in KINDS:
        v = lattice_vectors(kind)
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
        near = np.abs(d - d[d > 1e-9].min()) < 1e-6
        rows += [(kind, i, *map(float, p), [int(k) for k in np.flatnonzero(near[i])]) for i, p in enumerate(v)]
    return spark.createDataFrame(rows, "structure string, place int, x double, y double, z double, common array<int>")


def _template(kind: str) -> np.ndarray:
    v = lattice_vectors(kind)
    return v / np.sqrt((v**2).sum(1)).mean()


def _frames(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Right-handed orthonormal frames, as rows, of pairs of vectors."""
    a = u / np.linalg.norm(u, axis=-1, keepdims=True)
    c = np.cross(a, v)
    c /= np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-12)
    return np.stack([a, np.cross(c, a), c], axis=-2)


@cache
def _moves(kind: str) -> tuple[np.ndarray, np.ndarray]:
    return symmetries(kind), permutations(kind)


def _turned(turn: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Vectors ``(n, 3)`` under each of the rotations ``(r, 3, 3)``."""
    return np.einsum("rab,nb->rna", turn, t)


def _nearest(turn: np.ndarray, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the data vectors ``(r, n, 3)`` to each turned template vector, and its squared distance."""
    laid, far = _turned(turn, t), None
    for c in range(3):
        d = laid[:, :, None, c] - v[:, None, :, c]
        d *= d
        far = d if far is None else np.add(far, d, out=far)
    at = far.argmin(-1)
    return at, np.take_along_axis(far, at[:, :, None], 2)[:, :, 0]


def _laid(v: np.ndarray, t: np.ndarray, goal: np.ndarray, cosine: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The least sum of squared distances over the ways to lay the template on each shell, and its assignment; infinite without one.

    One way is tried in full. The template's symmetries tell what the others assign: where each turned vector is nearer to the told
    one than half of what data vectors are apart, no other is nearest. What is left is tried in full unless a few of
    its vectors are already further off than the best way's all.
    """
    m, n = v.shape[:2]
    unit = v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    off = np.abs(np.einsum("mia,mja->mij", unit, unit) - cosine)
    off[:, np.arange(n), np.arange(n)] = np.inf
    row, i, j = np.nonzero(off < 0.3)
    best, chosen = np.full(m, np.inf), np.zeros((m, n), np.int64)
    if not len(row):
        return best, chosen
    turn = np.swapaxes(_frames(v[row, i], v[row, j]), 1, 2) @ goal
    cost, at = np.full(len(row), np.inf), np.zeros((len(row), n), np.int64)

    def settle(some: np.ndarray) -> None:
        for part in np.array_split(some, max(1, len(some) // 512)):
            near, far = _nearest(turn[part], t, v[row[part]])
            whole = np.bitwise_or.reduce(1 << near, axis=1) == (1 << n) - 1
            cost[part], at[part] = np.where(whole, far.sum(1), np.inf), near

    by_atom = np.lexsort((off[row, i, j], row))
    first = by_atom[np.unique(row[by_atom], return_index=True)[1]]
    settle(first)
    base = np.full(m, -1)
    base[row[first]] = np.where(np.isfinite(cost[first]), first, -1)
    tried = np.zeros(len(row), bool)
    tried[first] = True
    rest = np.flatnonzero(~tried & (base[row] >= 0))
    if len(rest):
        between = ((v[:, :, None] - v[:, None]) ** 2).sum(-1)
        between[:, np.arange(n), np.arange(n)] = np.inf
        apart = np.sqrt(between.min((1, 2))) / 2 - 1e-9
        ops, moved = _moves(kind)
        by = np.swapaxes(turn[base[row[rest]]], 1, 2) @ turn[rest]
        told = np.take_along_axis(at[base[row[rest]]], moved[(by.reshape(-1, 9) @ ops.reshape(-1, 9).T).argmax(1)], 1)
        far = ((_turned(turn[rest], t) - v[row[rest][:, None], told]) ** 2).sum(-1)
        sure = (far < np.square(np.maximum(apart, 0))[row[rest], None]).all(1)
        cost[rest[sure]], at[rest[sure]], tried[rest[sure]] = far[sure].sum(1), told[sure], True
    least = np.full(m, np.inf)
    np.minimum.at(least, row, cost)
    rest = np.flatnonzero(~tried)
    some = np.unique(np.linspace(1, n - 1, 4).astype(int))
    for few in (some[1:2], some) if n > 6 else ():
        known = np.isfinite(least[row[rest]])
        far = _nearest(turn[rest[known]], t[few], v[row[rest[known]]])[1].sum(1)
        rest = np.concatenate([rest[~known], rest[known][far <= least[row[rest[known]]] + 1e-9]])
    settle(rest)
    table = np.full((n * n, m), np.inf)
    table[i * n + j, row] = cost
    place = np.zeros((n * n, m), np.int64)
    place[i * n + j, row] = np.arange(len(row))
    for k in np.unique(i * n + j):
        better = table[k] < best - 1e-12
        best[better], chosen[better] = table[k, better], at[place[k, better]]
    return best, chosen


def match_template(shell: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """RMSD, rotation, scale and correspondence (data place of each template vector) of neighbour shells ``(m, n, 3)``.

    Two template vectors are laid on every two data vectors that enclose about their angle; each such rotation assigns
    the nearest data vector to every template vector, and the best assignment is refined by a least-squares rotation and
    scale over the shell and its centre. RMSD is relative to the mean neighbour distance; it is infinite without one.
    """
    t = _template(kind)
    m, n = len(shell), len(t)
    size = np.linalg.norm(shell, axis=-1)
    v = shell / np.maximum(size.mean(1), 1e-12)[:, None, None]
    cosine = (t @ t.T) / np.outer(np.linalg.norm(t, axis=1), np.linalg.norm(t, axis=1))
    other = int(np.argmin(np.where(np.abs(cosine[0]) < 0.9, np.abs(np.linalg.norm(t, axis=1) - np.linalg.norm(t[0])) - 1e-3 * np.arange(n)[::-1] / n, 9)))
    goal = _frames(t[:1], t[other : other + 1])[0]
    parts = [_laid(v[at], t, goal, cosine[0, other], kind) for at in np.array_split(np.arange(m), max(1, m // 128))]
    best, chosen = (np.concatenate(x) for x in zip(*parts))
    found = np.isfinite(best)
    data = np.concatenate([np.zeros((m, 1, 3)), np.take_along_axis(shell, chosen[:, :, None], 1)], 1)
    want = np.concatenate([np.zeros((1, 3)), t])
    data, want = data - data.mean(1, keepdims=True), want - want.mean(0)
    u, s, w = np.linalg.svd(np.einsum("mna,nb->mab", data, want))
    sign = np.sign(np.linalg.det(u @ w))
    s[:, 2] *= sign
    u[:, :, 2] *= sign[:, None]
    power = (data**2).sum((1, 2))
    trace = s.sum(1)
    rest = (want**2).sum() - trace**2 / np.maximum(power, 1e-300)
    rmsd = np.where(found, np.sqrt(np.maximum(rest, 0) / (n + 1)), np.inf)
    return rmsd, u @ w, power / np.maximum(trace, 1e-300), chosen


def quaternions(r: np.ndarray) -> np.ndarray:
    """Quaternions ``x, y, z, w`` of rotation matrices, w not negative."""
    q = np.zeros((len(r), 4))
    diagonal = np.stack([r[:, 0, 0], r[:, 1, 1], r[:, 2, 2]], 1)
    total = diagonal.sum(1)
    largest = np.argmax(np.concatenate([diagonal, total[:, None]], 1), 1)
    for k in range(3):
        a, b = (k + 1) % 3, (k + 2) % 3
        at = largest == k
        q[at, k] = 1 - total[at] + 2 * r[at, k, k]
        q[at, a] = r[at, a, k] + r[at, k, a]
        q[at, b] = r[at, b, k] + r[at, k, b]
        q[at, 3] = r[at, b, a] - r[at, a, b]
    at = largest == 3
    q[at] = np.stack([r[at, 2, 1] - r[at, 1, 2], r[at, 0, 2] - r[at, 2, 0], r[at, 1, 0] - r[at, 0, 1], 1 + total[at]], 1)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    return np.where(q[:, 3:] < 0, -q, q)


#: How much the faces below are moved, each by its own share, so that never more than three meet in a point.
NUDGE = 1e-8

#: Neighbours among which faces are looked for.
CANDIDATES = 18


@cache
def _triples(n: int) -> tuple[np.ndarray, ...]:
    """Each three of ``n`` planes, which of them are a triple's own, each two, and the numbers of a triple's twos (second and third, first and third, first and second)."""
    three, two = (np.array(list(itertools.combinations(range(n), c))) for c in (3, 2))
    own = np.zeros((len(three), n), bool)
    own[np.arange(len(three))[:, None], three] = True
    number = np.zeros((n, n), int)
    number[two[:, 0], two[:, 1]] = np.arange(len(two))
    return three, own, two, number[three[:, 1], three[:, 2]], number[three[:, 0], three[:, 2]], number[three[:, 0], three[:, 1]]


def _angles(d: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solid angles of the faces of cells with the planes ``x d <= height``, and whether these planes alone close a cell well within a cube a thousand times as large."""
    m, n = height.shape
    three, own, two, bc_, ac_, ab_ = _triples(n)
    # by component, atoms last: a plane's, or a corner's, values lie together
    x, h = np.ascontiguousarray(d.transpose(2, 1, 0)), np.ascontiguousarray(height.T)
    u, v = x[:, two[:, 0]], x[:, two[:, 1]]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    bc, ac, ab = ([c[number] for c in cross] for number in (bc_, ac_, ab_))
    det = sum((x[c][three[:, 0]] * bc[c] for c in (1, 2)), x[0][three[:, 0]] * bc[0])
    inside = np.abs(det) >= 1e-9
    over = np.where(inside, det, 1)
    ha, hb, hc = (h[three[:, c]] for c in range(3))
    corner = [(ha * bc[c] - hb * ac[c] + hc * ab[c]) / over for c in range(3)]
    # the nearest planes cut most corners off; what is left is held against all
    most = 1e-6 * h.max(0)
    for near in np.argsort(h, axis=0)[:6]:
        plane, limit = x[:, near, np.arange(m)], h[near, np.arange(m)] + most
        inside &= corner[0] * plane[0] + corner[1] * plane[1] + corner[2] * plane[2] <= limit
    t, atom = np.nonzero(inside)
    w = np.stack([c[t, atom] for c in corner], 1)
    over = np.where(own[t], -np.inf, (w[:, None] @ np.swapaxes(d[atom], 1, 2))[:, 0] - height[atom]).max(-1)
    kept = over <= 0
    atom, t, w = atom[kept], t[kept], w[kept]
    sense = np.sign(det[t, atom])
    out = np.zeros(m * n)
    for i in range(3):
        p = three[t, i]
        u, hu = d[atom, p], height[atom, p]
        foot = u * (hu / (u * u).sum(-1))[:, None]
        for j, way in ((i + 1) % 3, 1.0), ((i + 2) % 3, -1.0):
            q = three[t, j]
            v, hv = d[atom, q], height[atom, q]
            uu, vv, uv = (u * u).sum(-1), (v * v).sum(-1), (u * v).sum(-1)
            edge = (u * (hu * vv - hv * uv)[:, None] + v * (hv * uu - hu * uv)[:, None]) / (uu * vv - uv * uv)[:, None]
            x, y, z = (r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-300) for r in (foot, edge, w))
            angle = 2 * np.arctan2((x * np.cross(y, z)).sum(1), 1 + (x * y).sum(1) + (y * z).sum(1) + (x * z).sum(1))
            out += np.bincount(atom * n + p, way * sense * angle, m * n)
    # a cell is closed if each of its edges ends at two corners
    ends = sum(np.bincount(atom * len(two) + x[t], minlength=m * len(two)) for x in (bc_, ac_, ab_)).reshape(m, -1)
    far = np.zeros(m)
    np.maximum.at(far, atom, np.linalg.norm(w, axis=1))
    return out.reshape(m, n), ((ends == 2) | (ends == 0)).all(1) & (ends > 0).any(1) & (far < 400)


def solid_angles(shells: np.ndarray) -> np.ndarray:
    """Solid angles ``(m, k)`` that the faces of Voronoi cells take up, from the neighbour vectors ``(m, k, 3)`` of their atoms.

    Three faces meet in a corner of the cell if no other face cuts it off. A corner gives each of its faces two signed triangles, from
    the face's foot over its edges to the corner, whose angles add up to the face's. A cell that neighbours leave open ends at a cube
    a thousand times as large. Neighbours in the atom's own place have no face.
    """
    m, k = shells.shape[:2]
    out = np.zeros((m, k + 6))
    if not m or not k:
        return out[:, :k]
    size = np.linalg.norm(shells, axis=-1)
    apart = size > 1e-12
    unit = np.where(apart, size, 0).sum(1) / np.maximum(apart.sum(1), 1)
    d = shells / np.where(unit > 0, unit, 1)[:, None, None]
    d = np.where(apart[:, :, None], d, np.array([3e3, 2e3, 1e3]))
    d = np.concatenate([d, np.broadcast_to(1e3 * np.concatenate([np.eye(3), -np.eye(3)]), (m, 6, 3))], 1)
    square = (d * d).sum(-1)
    height = square / 2 * (1 + NUDGE * np.random.default_rng(0).random(k + 6))
    for at in np.array_split(np.arange(m), max(1, m // 48)):
        angle, closed = _angles(d[at, :k], height[at, :k]) if k > 3 else (None, np.zeros(len(at), bool))
        if closed.any():
            out[at[closed], :k] = angle[closed]
        if not closed.all():
            out[at[~closed]] = _angles(d[at[~closed]], height[at[~closed]])[0]
    return np.where(apart, out[:, :k], 0.0)


def by_solid_angle(shells: np.ndarray) -> np.ndarray:
    """The places ``(m, k)`` of neighbours by falling solid angle; angles within a millionth are ties, which distance and then place decide."""
    angle = np.round(solid_angles(shells), 6)
    size = np.round(np.linalg.norm(shells, axis=-1), 9)
    return np.lexsort((np.broadcast_to(np.arange(shells.shape[1]), angle.shape), size, -angle), axis=-1)


@cache
def _template_distances(kind: str) -> np.ndarray:
    return _distances_between(_template(kind)[None])[0]


def _distances_between(shell: np.ndarray) -> np.ndarray:
    """The sorted distances ``(m, pairs)`` between the points of a shell and its centre."""
    x = np.concatenate([np.zeros((len(shell), 1, 3)), shell], 1)
    a, b = np.triu_indices(x.shape[1], 1)
    return np.sort(np.sqrt(((x[:, a] - x[:, b]) ** 2).sum(-1)), axis=1)


def _least_rmsd(shell: np.ndarray, kind: str) -> np.ndarray:
    """What ``match_template``'s RMSD is at least, whatever the assignment.

    Errors e about their mean have sum |e_a - e_b|^2 = N sum |e|^2 over all pairs of the N points; each |e_a - e_b| is at least the difference
    of the two distances, and those differ least, in squares, if both are sorted.
    """
    want, own = _template_distances(kind), _distances_between(shell)
    scale = own @ want / np.maximum((own * own).sum(1), 1e-300)
    return np.sqrt(((want - scale[:, None] * own) ** 2).sum(1)) / (shell.shape[1] + 1)


def identify(shells: np.ndarray, kinds: list[str]) -> dict[str, np.ndarray]:
    """Best template of each atom from its nearest vectors ``(m, k, 3)``, nearest first.

    A shell is what takes up most of the view; of diamonds this holds for the bonds alone, and the second shell, parts of which hide
    behind the first, comes by distance.
    """
    m = len(shells)
    out = {"kind": np.zeros(m, np.int32), "rmsd": np.full(m, np.inf), "q": np.tile([0.0, 0.0, 0.0, 1.0], (m, 1)), "scale": np.zeros(m), "order": [[] for _ in range(m)]}
    places = by_solid_angle(shells)
    bonds = np.argsort(np.where(np.argsort(places, 1) < 4, 0, 1), 1, kind="stable")
    kinds = [k for k in kinds if shells.shape[1] >= SHELLS[k]]
    if not m or not kinds:
        return out
    own = {k: np.take_along_axis(shells, (bonds if "DIAMOND" in k else places)[:, : SHELLS[k], None], 1) for k in kinds}
    least = np.stack([_least_rmsd(own[k], k) for k in kinds], 1)
    rmsd, found = np.full((m, len(kinds)), np.inf), [[None] * m for _ in kinds]
    # the kind that can fit best comes first; another is tried while it can fit as well
    for _ in kinds:
        at, untried = least.argmin(1), least.min(1)
        some = np.isfinite(untried) & (untried <= rmsd.min(1) + 1e-6)
        for c in np.unique(at[some]):
            rows = np.flatnonzero(some & (at == c))
            told = match_template(own[kinds[c]][rows], kinds[c])
            rmsd[rows, c], least[rows, c] = told[0], np.inf
            for r, x in zip(rows, zip(*told[1:])):
                found[c][r] = x
    for c, kind in enumerate(kinds):
        mine = bonds if "DIAMOND" in kind else places
        better = np.flatnonzero(rmsd[:, c] < out["rmsd"] - 1e-9)
        if not len(better):
            continue
        turn, scale, order = (np.array(x) for x in zip(*[found[c][i] for i in better]))
        out["kind"][better], out["rmsd"][better], out["scale"][better] = KINDS[kind], rmsd[better, c], scale
        out["q"][better] = quaternions(turn)
        for i, o in zip(better, np.take_along_axis(mine[better], order, 1).tolist()):
            out["order"][i] = o
    return out


MATCHED = "structure_type int, rmsd double, qx double, qy double, qz double, qw double, distance double, order array<int>"


def template_matching(atoms: DataFrame, nearest: DataFrame, rmsd_cutoff: float = 0.1, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """Structures by template matching of each atom's nearest neighbours: ``frame, id, structure_type, structure, rmsd,
    qx, qy, qz, qw, distance, order``.

    ``nearest`` holds pairs with ``rank``; of up to 18 an atom's shell are those whose Voronoi faces take up the largest solid angles, so
    that a far neighbour of a strained or shaken shell isn't lost to one behind it (templates that need more neighbours than an atom has are left out). The smallest RMSD decides; above the cutoff an atom is OTHER. The quaternion turns the template to the
    atom, ``distance`` is the mean neighbour distance of the fitted template, ``order`` the rank (from 0) of the neighbour
    at each template place. Atoms without neighbours are OTHER with nulls.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(x) for x in vectors])
            found: list = [None] * len(vectors)
            for size in np.unique(sizes):
                for at in np.array_split(np.flatnonzero(sizes == size), max(1, int((sizes == size).sum()) // 512)):
                    if not len(at) or not size:
                        continue
                    told = identify(np.array([vectors[i] for i in at], float), list(kinds))
                    for j, i in enumerate(at):
                        r = told["rmsd"][j]
                        kind = int(told["kind"][j]) if r <= rmsd_cutoff else 0
                        found[i] = (kind, float(r) if np.isfinite(r) else None, *map(float, told["q"][j]), float(told["scale"][j]), told["order"][j])
            rows = [f or (0, None, None, None, None, None, None, []) for f in found]
            kinds_ = (pa.int32(), *[pa.float64()] * 6, pa.list_(pa.int32()))
            yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds_)]], names=["frame", "id", *[x.split()[0] for x in MATCHED.split(", ")]])

    near = nearest.where(F.col("rank") <= CANDIDATES).groupBy("frame", F.col("i").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", F.array("dx", "dy", "dz").alias("d")))).alias("w"))
    near = near.select("frame", "id", F.transform("w", lambda x: x["d"]).alias("v"))
    told = near.mapInArrow(kernel, f"frame {near.schema['frame'].dataType.simpleString()}, id long, {MATCHED}")
    names = F.create_map(*[F.lit(x) for kv in {**STRUCTURE_NAMES, **{v: k for k, v in KINDS.items()}}.items() for x in kv])
    kind = F.coalesce("structure_type", F.lit(0))
    both = atoms.select("frame", "id").join(told, ["frame", "id"], "left").withColumn("structure_type", kind)
    return both.select("frame", "id", "structure_type", F.element_at(names, kind).alias("structure"), "rmsd", "qx", "qy", "qz", "qw", "distance", "order")


def farthest_neighbor(nearest: DataFrame, by: tuple[str, ...] = ("frame",)) -> DataFrame:
    """The longest of the neighbour distances of each frame."""
    return nearest.groupBy(*by).agg(F.sqrt(F.max("d2")).alias("max_distance"))


def orientation_bonds(typed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Bonds ``(frame, i, j, theta, crystalline)`` with i < j: disorientation in degrees, modulo the rotations of the cube or, for hexagonal structures, of their lattice.

    ``typed(frame, id, structure_type, qx, qy, qz, qw)``; a bond is crystalline if both ends have the same structure.
    """
    end = lambda x: typed.select("frame", F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("structure_type", "qx", "qy", "qz", "qw")])
    bonds = pairs.where("i < j").select("frame", "i", "j").distinct().join(end("i"), ["frame", "i"]).join(end("j"), ["frame", "j"])
    q = lambda x: [F.col(f"{x}_q{c}") for c in "xyzw"]
    same = (F.col("i_structure_type") == F.col("j_structure_type")) & (F.col("i_structure_type") > 0)
    hexagonal = F.col("i_structure_type").isin(KINDS["HCP"], KINDS["HEX_DIAMOND"])
    theta = F.when(hexagonal, hexagonal_disorientation(q("i"), q("j"))).otherwise(cubic_disorientation(q("i"), q("j")))
    return bonds.select("frame", "i", "j", F.when(same, theta).alias("theta"), same.alias("crystalline"))


def sorted_bonds(bonds: DataFrame, most: float = 4.0) -> DataFrame:
    """The grain graph's edges below ``most`` degrees with their weight, numbered by disorientation within all frames."""
    kept = bonds.where(F.col("crystalline") & (F.col("theta") < most)).select("frame", "i", "j", "theta", graph_weight(F.col("theta")).alias("weight"))
    return numbered(kept, [F.col("frame"), F.col("theta"), F.col("i"), F.col("j")], "place")


def crystal_clusters(typed: DataFrame, bonds: DataFrame, tight: float = 3.0, loose: float = 8.0, rmsd: float = 0.1) -> DataFrame:
    """``(frame, id, cluster, size)``: regions of one structure whose neighbours are turned by at most ``tight`` degrees.

    In frames whose mean RMSD is not below ``rmsd``, and for simple cubic atoms always, ``loose`` degrees count. A cluster
    is named by its smallest id; atoms of no structure are in none.
    """
    quality = typed.where("structure_type > 0").groupBy("frame").agg(F.avg("rmsd").alias("mean"))
    told = typed.select("frame", F.col("id").alias("i"), F.col("structure_type").alias("kind"))
    limit = F.when((F.col("mean") < rmsd) & (F.col("kind") != KINDS["SC"]), F.lit(tight)).otherwise(F.lit(loose))
    links = bonds.where("crystalline").join(told, ["frame", "i"]).join(quality, "frame").where(F.col("theta") <= limit)
    key = lambda x: F.struct("frame", F.col(x).alias("id"))
    parts = connected_components(links.select(key("i").alias("src"), key("j").alias("dst")))
    parts = parts.select(F.col("vertex.frame").alias("frame"), F.col("vertex.id").alias("id"), F.col("component.id").alias("cluster"))
    every = typed.where("structure_type > 0").select("frame", "id").join(parts, ["frame", "id"], "left").withColumn("cluster", F.coalesce("cluster", "id"))
    return every.join(every.groupBy("frame", "cluster").agg(F.count("*").alias("size")), ["frame", "cluster"]).select("frame", "id", "cluster", "size")


def cluster_transitions(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(frame, a, b, bonds)``: how many bonds join two clusters, a < b."""
    of = lambda x, name: clusters.select("frame", F.col("id").alias(x), F.col("cluster").alias(name))
    both = pairs.where("i < j").select("frame", "i", "j").distinct().join(of("i", "ci"), ["frame", "i"]).join(of("j", "cj"), ["frame", "j"])
    crossing = both.where(F.col("ci") != F.col("cj")).groupBy("frame", F.least("ci", "cj").alias("a"), F.greatest("ci", "cj").alias("b"))
    return crossing.agg(F.count("*").alias("bonds"))


def cluster_graph_document(clusters: DataFrame, transitions: DataFrame) -> DataFrame:
    """``(frame, kind, a, document)``: a JSON row per cluster and per cluster's list of transitions, to be written by frame."""
    nodes = clusters.groupBy("frame", "cluster").agg(F.count("*").alias("size"))
    nodes = nodes.select("frame", F.lit("cluster").alias("kind"), F.col("cluster").alias("a"), F.to_json(F.struct(F.col("cluster").alias("id"), "size")).alias("document"))
    links = transitions.select("frame", F.lit("transition").alias("kind"), "a", F.to_json(F.struct(F.col("a").alias("cluster1"), F.col("b").alias("cluster2"), "bonds")).alias("document"))
    return nodes.unionAll(links)


def merged_grains(atoms: DataFrame, merges: DataFrame, threshold: float, least: int = 100) -> DataFrame:
    """``(frame, id, grain, size)`` from a dendrogram's ``merges(frame, a, b, log_distance)`` up to the threshold.

    Grains are numbered from 1 within their frame in the order of their smallest atom; atoms of grains with fewer than
    ``least`` atoms have grain 0.
    """
    key = lambda x: F.struct("frame", F.col(x).alias("id"))
    parts = connected_components(merges.where(F.col("log_distance") <= threshold).select(key("a").alias("src"), key("b").alias("dst")))
    parts = parts.select(F.col("vertex.frame").alias("frame"), F.col("vertex.id").alias("id"), F.col("component.id").alias("root"))
    every = atoms.select("frame", "id").join(parts, ["frame", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    sizes = every.groupBy("frame", "root").agg(F.count("*").alias("size"))
    kept = numbered(sizes.where(F.col("size") >= least), [F.col("frame"), F.col("root")], "_place")
    first = kept.groupBy("frame").agg(F.min("_place").alias("_first"))
    kept = kept.join(first, "frame").select("frame", "root", (F.col("_place") - F.col("_first") + 1).alias("grain"))
    told = every.join(sizes, ["frame", "root"]).join(kept, ["frame", "root"], "left")
    return told.select("frame", "id", F.coalesce("grain", F.lit(0)).cast("long").alias("grain"), "size")


def elastic_strain(atoms: DataFrame, bonds: DataFrame, push_forward: bool = False) -> DataFrame:
    """Strain of each atom's crystal: ``frame, id, volumetric_strain, strain_tensor, deformation_gradient``.

    ``bonds(frame, id, dx, dy, dz, ix, iy, iz)`` pairs each neighbour vector with its vector in the undeformed lattice,
    already turned and scaled. F = W V^-1 over an atom's bonds; the strain is Green's, (F^T F - I) / 2, or with
    ``push_forward`` Euler's, (I - F^-T F^-1) / 2. Atoms without bonds, or with a singular V or F, have zeros.
    """
    d, r = [F.col(f"d{c}") for c in "xyz"], [F.col(f"i{c}") for c in "xyz"]
    sums = [F.sum(r[i] * r[j]).alias(f"v{i}{j}") for i in range(3) for j in range(3)] + [F.sum(d[i] * r[j]).alias(f"w{i}{j}") for i in range(3) for j in range(3)]
    return elastic_strain_of_sums(atoms, bonds.groupBy("frame", "id").agg(*sums), push_forward)


def elastic_strain_of_sums(atoms: DataFrame, sums: DataFrame, push_forward: bool = False) -> DataFrame:
    """``elastic_strain`` from V and W per atom, ``sums(frame, id, v00..v22, w00..w22)``."""
    total = atoms.select("frame", "id").join(sums, ["frame", "id"], "left")
    v, w = [F.col(f"v{i}{j}") for i in range(3) for j in range(3)], [F.col(f"w{i}{j}") for i in range(3) for j in range(3)]
    good = F.coalesce((F.abs(det(v)) > 1e-10) & (F.abs(det(w)) > 1e-10), F.lit(False))
    total = total.select("*", *[x.alias(f"f{k}") for k, x in enumerate(product(w, inverse([F.when(good, x) for x in v])))])
    f = [F.col(f"f{k}") for k in range(9)]
    if push_forward:
        total = total.select("*", *[x.alias(f"h{k}") for k, x in enumerate(inverse(f))])
        g = gram([F.col(f"h{k}") for k in range(9)])
        e = [((1.0 if k < 3 else 0.0) - g[k]) / 2.0 for k in range(6)]
    else:
        g = gram(f)
        e = [(g[k] - (1.0 if k < 3 else 0.0)) / 2.0 for k in range(6)]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.select("frame", "id", zero((e[0] + e[1] + e[2]) / 3.0).alias("volumetric_strain"), F.array(*[zero(x) for x in e]).alias("strain_tensor"), F.transform(column_major(f), zero).alias("deformation_gradient"))


def ideal_bonds(spark: SparkSession, typed: DataFrame, nearest: DataFrame, kind: str, lattice_constant: float, ca_ratio: float = math.sqrt(8 / 3)) -> DataFrame:
    """Each matched atom's neighbour vectors beside the lattice's own, for ``elastic_strain``.

    Only atoms of structure ``kind`` count. The lattice vectors stay in the template's frame, so a rotation of the crystal
    is part of F and none of the strain. Hexagonal lattices are scaled along their axis by the c/a ratio.
    """
    hexagonal = kind in ("HCP", "HEX_DIAMOND")
    v = lattice_vectors(kind) * lattice_constant * np.array([1, 1, ca_ratio / math.sqrt(8 / 3) if hexagonal else 1.0])
    table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(v)], "place int, ix double, iy double, iz double")
    placed = typed.where(F.col("structure_type") == KINDS[kind]).select("frame", "id", F.posexplode("order").alias("place", "at"))
    placed = placed.select("frame", "id", "place", (F.col("at") + 1).alias("rank")).join(F.broadcast(table), "place")
    return placed.join(nearest.select("frame", F.col("i").alias("id"), "rank", "dx", "dy", "dz"), ["frame", "id", "rank"])


def ordered_neighbors(spark: SparkSession, typed: DataFrame, nearest: DataFrame, target: Column | None = None) -> DataFrame:
    """Neighbours in template order: ``frame, id, place, j, dx, dy, dz, ix, iy, iz, rmsd, distance, disorientation``.

    The ideal vector is the template's, turned to the atom and scaled by its distance. ``target`` is an array of four
    numbers, an orientation to which the atom's disorientation is told in degrees.
    """
    rows = [(KINDS[k], i, *map(float, p)) for k in KINDS for i, p in enumerate(_template(k))]
    table = spark.createDataFrame(rows, "structure_type int, place int, tx double, ty double, tz double")
    goal = [F.get(target, F.lit(i)) for i in range(4)] if target is not None else None
    q = [F.col(f"q{c}") for c in "xyzw"]
    told = typed.where("structure_type > 0").withColumn("disorientation", cubic_disorientation(goal, q) if goal else F.lit(None).cast("double"))
    placed = told.select("frame", "id", "structure_type", "rmsd", "distance", "disorientation", "qx", "qy", "qz", "qw", F.posexplode("order").alias("place", "at"))
    placed = placed.withColumn("rank", F.col("at") + 1).join(F.broadcast(table), ["structure_type", "place"])
    x, y, z, w = q
    t = [F.col(f"t{c}") for c in "xyz"]
    c = [2.0 * (y * t[2] - z * t[1]), 2.0 * (z * t[0] - x * t[2]), 2.0 * (x * t[1] - y * t[0])]
    turned = [t[0] + w * c[0] + y * c[2] - z * c[1], t[1] + w * c[1] + z * c[0] - x * c[2], t[2] + w * c[2] + x * c[1] - y * c[0]]
    placed = placed.select("frame", "id", "place", "rank", "rmsd", "distance", "disorientation", *[(F.col("distance") * a).alias(f"i{n}") for n, a in zip("xyz", turned)])
    near = nearest.select("frame", F.col("i").alias("id"), "rank", "j", "dx", "dy", "dz")
    return placed.join(near, ["frame", "id", "rank"]).select("frame", "id", "place", "j", "dx", "dy", "dz", "ix", "iy", "iz", "rmsd", "distance", "disorientation")


def structures_by_mode(atoms: DataFrame, nearest: DataFrame, mode: str = "CNA", rmsd_cutoff: float = 0.1) -> DataFrame:
    """``frame, id, structure_type, structure`` by CNA, PTM, or DIAMOND (templates of the two diamonds alone)."""
    from atomweave.operators.structure import local_structure

    columns = ["frame", "id", "structure_type", "structure"]
    if mode == "CNA":
        return local_structure(atoms, nearest).select(*columns)
    if mode == "PTM":
        return template_matching(atoms, nearest, rmsd_cutoff).select(*columns)
    if mode == "DIAMOND":
        return template_matching(atoms, nearest, rmsd_cutoff, ("CUBIC_DIAMOND", "HEX_DIAMOND")).select(*columns)
    raise ValueError(f"no identification mode {mode!r}")


def diamond_shells(typed: DataFrame, nearest: DataFrame) -> DataFrame:
    """Adds ``marking``: atoms that are no diamond but neighbours of one are its first or second neighbours."""
    diamonds = typed.where(F.col("structure_type").isin(KINDS["CUBIC_DIAMOND"], KINDS["HEX_DIAMOND"])).select("frame", F.col("id").alias("i"), F.col("structure_type").alias("kind"))
    close = nearest.where("rank <= 4").select("frame", "i", "j")
    name = F.when(F.col("kind") == KINDS["CUBIC_DIAMOND"], "CUBIC").otherwise("HEX")
    first = diamonds.join(close, ["frame", "i"]).select("frame", F.col("j").alias("id"), "kind").join(diamonds.select("frame", F.col("i").alias("id")), ["frame", "id"], "left_anti")
    first = first.groupBy("frame", "id").agg(F.min("kind").alias("kind"))
    near = first.select("frame", F.col("id").alias("i"), "kind").join(close, ["frame", "i"]).select("frame", F.col("j").alias("id"), "kind")
    taken = diamonds.select("frame", F.col("i").alias("id")).unionAll(first.select("frame", "id"))
    second = near.join(taken, ["frame", "id"], "left_anti").groupBy("frame", "id").agg(F.min("kind").alias("kind"))
    marks = first.withColumn("marking", F.concat(name, F.lit("_DIAMOND_FIRST_NEIGHBOR"))).unionAll(second.withColumn("marking", F.concat(name, F.lit("_DIAMOND_SECOND_NEIGHBOR"))))
    return typed.join(marks.select("frame", "id", "marking"), ["frame", "id"], "left")


def largest_gap(values: DataFrame, column: str, by: str = "frame") -> DataFrame:
    """For each group where its sorted values are furthest apart: ``(by, below, above)``; a cut for a merge threshold."""
    order = Window.partitionBy(by).orderBy(column)
    steps = values.select(by, column, F.lead(column).over(order).alias("above")).where(F.col("above").isNotNull())
    widest = steps.groupBy(by).agg(F.max(F.struct((F.col("above") - F.col(column)).alias("gap"), F.col(column).alias("below"), "above")).alias("g"))
    return widest.select(by, "g.below", "g.above")
