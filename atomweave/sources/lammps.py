"""LAMMPS dump and data files as DataFrames, parsed line by line by Spark.

Files are read as text, so a large file is split over many tasks. Only a file's header (its first lines, one row per
file) goes through a Python helper; atom lines are split and cast by Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from atomweave.operators.ranking import running_sum

#: Lines read of a file that has no atom section, to tell what it is.
UNKNOWN_LINES = 200
HEADER = "file string, ok boolean, error string, timestep long, natoms long, columns array<string>, first_atom long, a array<double>, b array<double>, c array<double>, origin array<double>, pbc array<boolean>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` with line numbers from 0, counted block by block of a split file."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("frame"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.rtrim("value").alias("line"), F.lit(1).alias("one")
    )
    counted = running_sum(lines, "one", ["frame"], "block", [F.col("place")], "line_no")
    return counted.select(F.col("frame").alias("file"), "line_no", "line")


def _box(rows: list[list[str]], header: list[str]) -> dict:
    """Edges of a box given by bounds, with the tilts of a triclinic box taken off its bounding values."""
    lo, hi = [float(r[0]) for r in rows], [float(r[1]) for r in rows]
    tilt = [float(r[2]) for r in rows] if all(len(r) > 2 for r in rows) else [0.0, 0.0, 0.0]
    xy, xz, yz = tilt
    lo[0] -= min(0.0, xy, xz, xy + xz)
    hi[0] -= max(0.0, xy, xz, xy + xz)
    lo[1] -= min(0.0, yz)
    hi[1] -= max(0.0, yz)
    flags = [t for t in header if len(t) == 2 and set(t) <= set("pfsm")]
    pbc = [t == "pp" for t in flags[:3]] if len(flags) >= 3 else [True] * 3
    return {"a": [hi[0] - lo[0], 0.0, 0.0], "b": [xy, hi[1] - lo[1], 0.0], "c": [xz, yz, hi[2] - lo[2]], "origin": lo, "pbc": pbc}


def dump_header(lines: list[str]) -> dict:
    """Timestep, number of atoms, box and columns of a dump's first frame; the sections may come in any order."""
    out: dict = {"ok": False, "error": None, "timestep": None, "natoms": None, "columns": None, "first_atom": None}
    out |= dict.fromkeys(("a", "b", "c", "origin", "pbc"))
    try:
        i = 0
        while i < len(lines):
            words = lines[i].split()
            if words[:2] == ["ITEM:", "TIMESTEP"]:
                out["timestep"] = int(lines[i + 1])
                i += 2
            elif words[:4] == ["ITEM:", "NUMBER", "OF", "ATOMS"]:
                out["natoms"] = int(lines[i + 1])
                i += 2
            elif words[:3] == ["ITEM:", "BOX", "BOUNDS"]:
                out |= _box([lines[i + k].split() for k in (1, 2, 3)], words[3:])
                i += 4
            elif words[:2] == ["ITEM:", "ATOMS"]:
                out |= {"columns": words[2:], "first_atom": i + 1}
                break
            else:
                i += 1
        missing = [k for k in ("timestep", "natoms", "columns", "a") if out[k] is None]
        out |= {"ok": not missing, "error": f"no {', '.join(missing)}" if missing else None}
    except (ValueError, IndexError) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def data_header(lines: list[str]) -> dict:
    """The same of a data file; the style of its atom lines follows from their number of columns."""
    out: dict = {"ok": False, "error": None, "timestep": 0, "natoms": None, "columns": None, "first_atom": None}
    out |= dict.fromkeys(("a", "b", "c", "origin", "pbc"))
    bounds, tilt = {}, [0.0] * 3
    try:
        for i, line in enumerate(lines):
            w = line.split("#")[0].split()
            if len(w) == 2 and w[1] == "atoms":
                out["natoms"] = int(w[0])
            elif len(w) >= 4 and w[2] in ("xlo", "ylo", "zlo"):
                bounds[w[2][0]] = (float(w[0]), float(w[1]))
            elif w[3:6] == ["xy", "xz", "yz"]:
                tilt = [float(x) for x in w[:3]]
            elif w[:1] == ["Atoms"]:
                at = next(k for k in range(i + 1, len(lines)) if lines[k].strip())
                n = len(lines[at].split())
                style = ["id", "mol", "type", "q", "x", "y", "z"] if n >= 7 else ["id", "type", "q", "x", "y", "z"] if n == 6 else ["id", "type", "x", "y", "z"]
                out |= {"columns": style, "first_atom": at}
                break
        if out["natoms"] is None or out["columns"] is None or len(bounds) < 3:
            out["error"] = "no atoms or box"
        else:
            lo, hi = ([bounds[k][j] for k in "xyz"] for j in (0, 1))
            out |= {"a": [hi[0] - lo[0], 0.0, 0.0], "b": [tilt[0], hi[1] - lo[1], 0.0], "c": [tilt[1], tilt[2], hi[2] - lo[2]], "origin": lo, "pbc": [True] * 3, "ok": True}
    except (ValueError, StopIteration) as e:
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def sniff(lines: list[str]) -> str | None:
    """``dump``, ``data`` or None by a file's first lines."""
    if any(x.startswith("ITEM:") for x in lines):
        return "dump"
    if any(x.split()[-1:] == ["atoms"] for x in lines) and any("xlo" in x for x in lines):
        return "data"
    return None


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for file, lines in zip(b["file"], b["lines"]):
            lines = list(lines)
            kind = sniff(lines)
            found = dump_header(lines) if kind == "dump" else data_header(lines) if kind == "data" else dict(dump_header([]), error="unknown format")
            rows.append({"file": file, **found})
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: timestep, number of atoms, columns and cell, or why it can't be read. No atom line is parsed.

    Only the first block of each file is looked at, up to the line that opens its atom section, however late that comes
    in the block; lines of other blocks are dropped as they are read and never shuffled.
    """
    lines = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place"), F.rtrim("value").alias("line"))
    order = Window.partitionBy("file").orderBy("place")
    opens = F.col("line").startswith("ITEM: ATOMS") | F.col("line").rlike(r"^\s*Atoms\b")
    head = lines.withColumn("opened", F.count_if(opens).over(order)).withColumn("line_no", F.row_number().over(order) - 1)
    after = F.sum(F.when((F.col("opened") > 0) & (F.trim("line") != ""), 1).otherwise(0)).over(order)
    head = head.withColumn("after", after).withColumn("ends", F.max("opened").over(Window.partitionBy("file")) > 0)
    head = head.where(F.when(F.col("ends"), F.col("after") <= 2).otherwise(F.col("line_no") < UNKNOWN_LINES))
    files = head.groupBy("file").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    return files.mapInPandas(_headers, HEADER)


def read_atoms(spark: SparkSession, path: str, properties: list[str] = (), permissive: bool = False) -> DataFrame:
    """Atoms of each file's first frame: ``file, timestep, ordinal, id, type, x, y, z, props``.

    Columns ``xs ys zs`` are scaled and turned into positions; a missing id is the line's number from 1, a missing type
    1. ``props`` maps the asked columns to numbers. A file with a bad header or atom line gives no rows (see
    ``corrupt_files``); permissive reading takes unreadable numbers as 0.
    """
    head = read_metadata(spark, path).where("ok")
    lines = numbered_lines(spark, path).join(head, "file")
    atoms = lines.where((F.col("line_no") >= F.col("first_atom")) & (F.col("line_no") < F.col("first_atom") + F.col("natoms")))
    atoms = atoms.withColumn("w", F.split(F.trim("line"), r"\s+"))

    def number(name: str, kind: str = "double"):
        at = F.array_position("columns", name).cast("int")
        value = F.when(at > 0, F.get("w", at - 1)).try_cast(kind)
        return F.when(at > 0, F.coalesce(value, F.lit(0).cast(kind))) if permissive else value

    def position(k: str, i: int):
        scaled = [number(f"{c}s") for c in "xyz"]
        moved = sum((scaled[j] * F.get(e, F.lit(i)) for j, e in ((1, "b"), (2, "c"))), scaled[0] * F.get("a", F.lit(i))) + F.get("origin", F.lit(i))
        return F.coalesce(number(k), moved, number(f"{k}u"))

    ordinal = F.col("line_no") - F.col("first_atom")
    has = lambda c: F.array_contains("columns", c)
    atoms = atoms.select(
        "file", "timestep", ordinal.alias("ordinal"), F.when(has("id"), number("id", "long")).otherwise(ordinal + 1).alias("id"), F.when(has("type"), number("type", "int")).otherwise(1).alias("type"),
        *[position(k, i).alias(k) for i, k in enumerate("xyz")],
        F.create_map(*[x for p in properties for x in (F.lit(p), number(p))]).cast("map<string,double>").alias("props"), "natoms",
    )
    if permissive:
        return atoms.drop("natoms")
    good = F.col("id").isNotNull() & F.col("type").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    whole = atoms.groupBy("file").agg(F.count_if(good).alias("_good"), F.max("natoms").alias("_n")).where("_good = _n").select("file")
    return atoms.join(whole, "file").drop("natoms")


def corrupt_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, error)`` of files that strict reading leaves out."""
    head = read_metadata(spark, path)
    read = read_atoms(spark, path).select("file").distinct()
    return head.join(read, "file", "left_anti").select("file", F.coalesce("error", F.lit("bad or missing atom lines")).alias("error"))


def write_dump_text(atoms: DataFrame, cells: DataFrame) -> DataFrame:
    """``(frame, place, value)``: the lines of dump files of frames with upright cells, to be written by frame."""
    n = atoms.groupBy("frame").count().join(cells, "frame")
    bound = lambda i, e: F.format_string("%s %s", F.get("origin", F.lit(i)), F.get("origin", F.lit(i)) + F.get(e, F.lit(i)))
    flags = F.array_join(F.transform("pbc", lambda p: F.when(p, "pp").otherwise("ff")), " ")
    head = F.array(F.lit("ITEM: TIMESTEP"), F.col("frame").cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("count").cast("string"), F.concat(F.lit("ITEM: BOX BOUNDS "), flags), bound(0, "a"), bound(1, "b"), bound(2, "c"), F.lit("ITEM: ATOMS id type x y z"))
    lines = n.select("frame", F.posexplode(head).alias("place", "value")).withColumn("place", F.col("place") - 9)
    body = atoms.select("frame", F.col("id").alias("place"), F.concat_ws(" ", "id", "type", "x", "y", "z").alias("value"))
    return lines.select("frame", F.col("place").cast("long").alias("place"), "value").unionByName(body)
