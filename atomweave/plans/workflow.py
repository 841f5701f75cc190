"""Dataflow workflows: graphs of nodes that select frames, run analyses and publish their results.

A workflow is a dictionary ``{"nodes": [{"id", "type", "data"}], "edges": [{"source", "target", "sourceHandle"}]}``. It
is checked, ordered and pruned on the driver; what runs are DataFrame plans over all frames at once.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.functions.scalars import split_arguments
from atomweave.operators import deformation, documents, structure
from atomweave.operators.neighbors import nearest_neighbors, spanning_links

Workflow = dict[str, list[dict]]
_REFERENCE = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")


def ordered(workflow: Workflow) -> list[str]:
    """Node ids so that each comes after its sources; among equals in the order given. Nodes on cycles are left out."""
    ids = [n["id"] for n in workflow["nodes"]]
    waiting, after = dict.fromkeys(ids, 0), defaultdict(list)
    for e in workflow["edges"]:
        if e["source"] in waiting and e["target"] in waiting:
            waiting[e["target"]] += 1
            after[e["source"]].append(e["target"])
    ready, out = deque(i for i in ids if not waiting[i]), []
    while ready:
        out.append(node := ready.popleft())
        for nxt in after[node]:
            waiting[nxt] -= 1
            if not waiting[nxt]:
                ready.append(nxt)
    return out


def reachable(workflow: Workflow, start: str, handle: str | None = None, backwards: bool = False) -> set[str]:
    """Nodes downstream (or upstream) of a node, from one of its handles if given."""
    near, far = ("target", "source") if backwards else ("source", "target")
    seen: set[str] = set()
    ready = [e[far] for e in workflow["edges"] if e[near] == start and (handle is None or e.get("sourceHandle") == handle)]
    while ready:
        if (node := ready.pop()) not in seen:
            seen.add(node)
            ready += [e[far] for e in workflow["edges"] if e[near] == node]
    return seen


def parent_of_type(workflow: Workflow, node: str, kind: str) -> dict | None:
    """The nearest upstream node of a type, breadth first."""
    kinds = {n["id"]: n for n in workflow["nodes"]}
    ready, seen = deque([node]), {node}
    while ready:
        for e in workflow["edges"]:
            if e["target"] == ready[0] and e["source"] not in seen:
                if kinds[e["source"]]["type"] == kind:
                    return kinds[e["source"]]
                seen.add(e["source"])
                ready.append(e["source"])
        ready.popleft()
    return None


def problems(workflow: Workflow) -> list[str]:
    """What is wrong with a workflow; nothing if it can run."""
    kinds = [n["type"] for n in workflow["nodes"]]
    found = [f"no {k} node" for k in ("modifier", "entrypoint", "exposure") if k not in kinds]
    for n in workflow["nodes"]:
        data = n.get("data") or {}
        if n["type"] == "modifier" and not data.get("name"):
            found.append(f"{n['id']}: a modifier needs a name")
        if n["type"] == "entrypoint" and data.get("analyzer") not in ANALYZERS:
            found.append(f"{n['id']}: no analyzer {data.get('analyzer')!r}")
        if n["type"] == "exposure" and not data.get("results"):
            found.append(f"{n['id']}: an exposure needs the name of a result")
    if len(ordered(workflow)) < len(workflow["nodes"]):
        found.append("the graph has a cycle")
    return found


def resolve(path: str, values: dict[str, Any]) -> Any:
    """A dotted path into nested dictionaries and lists; None where it leads nowhere."""
    now: Any = values
    for part in path.split("."):
        if isinstance(now, dict):
            now = now.get(part)
        elif isinstance(now, list) and part.isdigit() and int(part) < len(now):
            now = now[int(part)]
        else:
            return None
    return now


def interpolate(text: str, values: dict[str, Any]) -> Any:
    """A sole reference gives its value; references within a text are put in as text, missing ones as nothing."""
    if whole := _REFERENCE.fullmatch(text.strip()):
        return resolve(whole[1], values)
    return _REFERENCE.sub(lambda m: "" if (v := resolve(m[1], values)) is None else str(v), text)


def _coerced(v: Any) -> Any:
    if isinstance(v, str):
        if v.strip().lower() in ("true", "false"):
            return v.strip().lower() == "true"
        try:
            return float(v) if v.strip() else v
        except ValueError:
            return v
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def loosely_equal(a: Any, b: Any) -> bool:
    """Equality after booleans and numbers in text are read as such; true is 1 and false is 0 beside a number."""
    a, b = _coerced(a), _coerced(b)
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) != isinstance(b, bool) and not isinstance(a, str) and not isinstance(b, str):
        a, b = float(a), float(b)
    return type(a) is type(b) and a == b


def decide(conditions: list[dict], values: dict[str, Any]) -> bool:
    """Conditions ``{left, operator, right, join}`` folded from the left by their AND and OR; none at all is true."""
    result: bool | None = None
    for c in conditions:
        left, right = (interpolate(x, values) if isinstance(x, str) else x for x in (c["left"], c["right"]))
        one = loosely_equal(left, right) == (c.get("operator", "==") == "==")
        result = one if result is None else (result or one) if c.get("join", "AND").upper() == "OR" else (result and one)
    return True if result is None else result


def bind_arguments(declared: list[dict], config: dict[str, Any]) -> dict[str, Any]:
    """Parameter values: a fixed value first, then the user's, then the default. False stays false."""
    out = {}
    for a in declared:
        value = a["value"] if a.get("value") is not None else config.get(a["argument"], a.get("default"))
        if value is not None:
            out[a["argument"]] = value
    return out


@dataclass
class Frames:
    """What analyses read: atoms and cells of the chosen frames, and the reference frame's if there is one."""

    atoms: DataFrame
    cells: DataFrame
    reference: DataFrame | None = None


ANALYZERS: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def analyzer(name: str):
    """Register a table function over frames: it takes ``Frames`` and parameters and returns named results."""

    def add(f):
        ANALYZERS[name] = f
        return f

    return add


@analyzer("coordination")
def _coordination(f: Frames, cutoff: float = 3.2, bins: int = 500) -> dict[str, DataFrame]:
    return {"coordination": structure.coordination_within(f.atoms, f.cells, float(cutoff)), "rdf": structure.radial_distribution_within(f.atoms, f.cells, float(cutoff), int(bins))}


@analyzer("cluster-analysis")
def _cluster(f: Frames, cutoff: float = 3.2) -> dict[str, DataFrame]:
    placed = structure.unwrapped_clusters(f.atoms, spanning_links(f.atoms, f.cells, float(cutoff)))
    return {"atoms": placed.select("frame", "id", "cluster", "size"), "clusters": structure.cluster_shapes(placed)}


@analyzer("centrosymmetry")
def _centrosymmetry(f: Frames, k: int = 12) -> dict[str, DataFrame]:
    csp = structure.centrosymmetry(f.atoms, nearest_neighbors(f.atoms, f.cells, int(k)), int(k))
    return {"atoms": csp, "histogram": structure.symmetry_histogram(csp)}


@analyzer("structure")
def _structure(f: Frames) -> dict[str, DataFrame]:
    typed = structure.local_structure(f.atoms, nearest_neighbors(f.atoms, f.cells, 15))
    return {"atoms": typed, "statistics": structure.structure_statistics(typed)}


@analyzer("displacements")
def _displacements(f: Frames, mic: bool = True) -> dict[str, DataFrame]:
    moved = deformation.displacements(deformation.reference_join(f.atoms, f.reference), f.cells, bool(mic))
    return {"atoms": moved, "summary": deformation.displacement_summary(moved)}


@analyzer("atomic-strain")
def _strain(f: Frames, cutoff: float = 3.0) -> dict[str, DataFrame]:
    moved = deformation.displacements(deformation.reference_join(f.atoms, f.reference), f.cells)
    strain = deformation.strain_within(f.reference, f.cells, float(cutoff), moved)
    return {"atoms": strain, "summary": deformation.strain_summary(strain)}


@dataclass
class Run:
    """Published results by exposure, the nodes that ran in order, and those that a branch skipped."""

    results: dict[str, DataFrame] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)
    skipped: set[str] = field(default_factory=set)
    values: dict[str, Any] = field(default_factory=dict)
    catalog: dict[str, dict[str, Any]] = field(default_factory=dict)


def run(workflow: Workflow, frames: Frames, config: dict[str, Any] | None = None) -> Run:
    """Run a checked workflow over all its frames. Analyses stay lazy: an exposure is a DataFrame, not a result."""
    if found := problems(workflow):
        raise ValueError("; ".join(found))
    nodes, out, produced, arguments = {n["id"]: n for n in workflow["nodes"]}, Run(), {}, {}
    now = frames
    for name in ordered(workflow):
        if name in out.skipped:
            continue
        node, data = nodes[name], nodes[name].get("data") or {}
        out.order.append(name)
        if node["type"] == "modifier":
            out.values[name] = {k: v for k, v in data.items()}
        elif node["type"] == "arguments":
            arguments = bind_arguments(data.get("arguments", []), config or {})
            out.values[name] = arguments
        elif node["type"] == "context":
            chosen = data.get("timesteps")
            if chosen is not None:
                wanted = F.col("frame").isin([int(t) for t in chosen])
                now = Frames(now.atoms.where(wanted), now.cells.where(wanted), now.reference.where(wanted) if now.reference is not None else None)
        elif node["type"] == "if-statement":
            taken = decide(data.get("conditions", []), out.values)
            out.values[name] = {"result": taken, "branch": "true" if taken else "false"}
            out.skipped |= reachable(workflow, name, "false" if taken else "true")
        elif node["type"] == "entrypoint":
            extra = data.get("parameters", {})
            if isinstance(data.get("argv"), str):
                words = split_arguments(str(interpolate(data["argv"], out.values)))
                extra = extra | {w[2:]: v for w, v in zip(words, words[1:]) if w.startswith("--")}
            produced = ANALYZERS[data["analyzer"]](now, **{**arguments, **extra})
        elif node["type"] == "exposure":
            out.results[data.get("name", name)] = produced[data["results"]]
            out.values[name] = {"columns": produced[data["results"]].columns}
        elif node["type"] == "forEach":
            out.values[name] = {"items": sorted(r["frame"] for r in now.cells.select("frame").distinct().collect())}  # a row per frame
        elif node["type"] in ("schema", "visualizers"):
            out.values[name] = dict(data)
            out.catalog[name] = {"kind": node["type"], **data}
        elif node["type"] == "export":
            chosen = data.get("exposures") or list(out.results)
            target = interpolate(data["path"], out.values) if "path" in data else None
            if target:
                documents.write_exposures({k: out.results[k] for k in chosen}, str(target), form=data.get("format", "json"))
            out.values[name] = {"path": target, "exposures": chosen}
        else:
            raise ValueError(f"{name}: no handler for {node['type']!r}")
    return out


def listing(results: dict[str, DataFrame], columns: list[dict[str, str]], keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """One row per frame of ``columns`` ``{"label", "path": "exposure.column"}``; numbers missing from a frame are 0."""
    out, first = None, {}
    for c in columns:
        exposure, _, column = c["path"].partition(".")
        first.setdefault(exposure, []).append((column, c))
    for exposure, wanted in first.items():
        kinds = dict(results[exposure].dtypes)
        part = results[exposure].groupBy(*keys).agg(*[F.first(col, ignorenulls=True).alias(c["label"]) for col, c in wanted])
        out = part if out is None else out.join(part, list(keys), "full")
        numbers = [c["label"] for col, c in wanted if kinds[col] in ("int", "bigint", "double", "float")]
        out = out.fillna(0, numbers)
    return out
