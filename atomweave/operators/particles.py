"""Per-atom queries: predicates, filters, colours, modifier joins, pages, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomweave.functions.scalars import GRAIN_COLORS, HIGHLIGHT, MUTED, STRUCTURE_COLORS
from atomweave.operators.ranking import numbered, running_sum

OPERATORS = ("==", "!=", ">", ">=", "<", "<=")


def predicate(value: Column, operator: str, literal: float) -> Column:
    """A comparison of a 32-bit value with a 64-bit literal; with NaN only ``!=`` holds, unknown operators never do.

    So ``== 0.1`` is never true, as 0.1 isn't a 32-bit number. A null value counts as 0.
    """
    v = F.coalesce(value.cast("float"), F.lit(0.0).cast("float")).cast("double")
    bound, nan = F.lit(float(literal)), F.isnan(v)
    tests = {"==": v == bound, "!=": v != bound, ">": v > bound, ">=": v >= bound, "<": v < bound, "<=": v <= bound}
    if operator not in tests:
        return F.lit(False)
    return (nan | tests[operator]) if operator == "!=" else (~nan & tests[operator])


def preview(atoms: DataFrame, mask: Column) -> DataFrame:
    return atoms.agg(F.count_if(mask).alias("match_count"), F.count("*").alias("total_atoms"))


def delete_matching(atoms: DataFrame, mask: Column) -> DataFrame:
    """Atoms that don't match; deleting every atom of a non-empty table is an error."""
    keep = ~F.coalesce(mask, F.lit(False))
    left = atoms.where(keep)
    if left.isEmpty() and not atoms.isEmpty():
        raise ValueError("the filter would delete all atoms")
    return left


def highlight(mask: Column) -> Column:
    array = lambda c: F.array(*[F.lit(x) for x in c])
    return F.when(F.coalesce(mask, F.lit(False)), array(HIGHLIGHT)).otherwise(array(MUTED))


def with_modifier(atoms: DataFrame, values: DataFrame, name: str, order: str = "ordinal") -> DataFrame:
    """Left join of ``values(id, ordinal, value)``: the last value of an id counts, ids without one get 0.

    Array values give their Euclidean length.
    """
    kind = dict(values.dtypes)["value"]
    value = F.sqrt(F.aggregate("value", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) if kind.startswith("array") else F.col("value").cast("double")
    last = values.groupBy("id").agg(F.max_by(value, order).alias(name))
    return atoms.join(last, "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def filter_source(atoms: DataFrame, modifier: DataFrame | None, name: str) -> tuple[DataFrame, str]:
    """Atoms with the column that a filter on ``name`` reads, and that column's name.

    ``modifier(id, ordinal, name, value)`` are the values that a result declares: if it has the name (exactly), its values are
    joined, 0 where an atom has none; otherwise it is the atoms' own column, in any case. A name of neither is an error. An
    empty modifier declares nothing.
    """
    if modifier is not None:
        mine = modifier.where(F.col("name") == name)
        if not mine.isEmpty():
            return with_modifier(atoms, mine.select("id", "ordinal", "value"), f"_{name}"), f"_{name}"
    own = next((c for c in atoms.columns if c.lower() == name.lower()), None)
    if own is None:
        raise ValueError(f"no property {name!r}")
    return atoms, own


def point_cloud(atoms: DataFrame, code: Column) -> DataFrame:
    """Atoms in the order of a space-filling ``code`` within their frame, with their ``place`` there from 1, in ranges to be written as they are.

    Equal codes go by id. Ranges of the order are parts of the result, so files hold near atoms and their statistics are narrow.
    """
    placed = numbered(atoms.withColumn("code", code), [F.col("frame"), F.col("code"), F.col("id")], "_place")
    first = placed.groupBy("frame").agg(F.min("_place").alias("_first"))
    placed = placed.join(F.broadcast(first), "frame")  # a row per frame
    return placed.withColumn("place", F.col("_place") - F.col("_first") + 1).drop("_place", "_first").sortWithinPartitions("frame", "place")


def value_range(values: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value; 0 and 0 for an empty column."""
    return values.agg(F.coalesce(F.min(column), F.lit(0)).alias("min_value"), F.coalesce(F.max(column), F.lit(0)).alias("max_value"))


def bounding_box(atoms: DataFrame, keys: list[str]) -> DataFrame:
    return atoms.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def with_ordinal(atoms: DataFrame, order: list[Column], chunk: Column) -> DataFrame:
    """Row numbers from 0 in ``order`` within a frame, counted chunk by chunk; ``chunk`` must grow with the order."""
    return running_sum(atoms.withColumn("_one", F.lit(1)).withColumn("_chunk", chunk), "_one", ["frame"], "_chunk", order, "ordinal").drop("_one", "_chunk")


def atom_page(numbered: DataFrame, page: int, size: int = 1000) -> DataFrame:
    """Rows of one page, pages from 1, sizes held between 1 and 10,000."""
    size = max(1, min(10_000, size))
    first = (max(1, page) - 1) * size
    return numbered.where((F.col("ordinal") >= first) & (F.col("ordinal") < first + size))


def flatten_vector(df: DataFrame, column: str, keys: list[str] | None) -> DataFrame:
    """One column ``"<column> <key>"`` per declared key; a vector without declared keys is dropped."""
    parts = [F.get(F.col(column), F.lit(i)).alias(f"{column} {k}") for i, k in enumerate(keys or [])]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *parts)


def structure_colors(df: DataFrame, column: str = "structure") -> DataFrame:
    """Add ``color`` of the structure's name; unknown names have the colour of UNKNOWN."""
    spark = df.sparkSession
    table = spark.createDataFrame([(k, list(v)) for k, v in STRUCTURE_COLORS.items()], "name string, color array<int>")
    unknown = F.array(*[F.lit(x) for x in STRUCTURE_COLORS["UNKNOWN"]])
    return df.join(F.broadcast(table), F.col(column) == F.col("name"), "left").drop("name").withColumn("color", F.coalesce("color", unknown))


def grain_colors(grains: DataFrame) -> DataFrame:
    """Add ``color`` to grains, the palette taken in turn in the order of grain ids."""
    palette = F.array(*[F.array(*[F.lit(x) for x in c]) for c in GRAIN_COLORS])
    turned = numbered(grains, [F.col("grain")], "_turn")
    return turned.withColumn("color", F.get(palette, ((F.col("_turn") - 1) % len(GRAIN_COLORS)).cast("int"))).drop("_turn")
