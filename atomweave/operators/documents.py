"""Document queries: filters, search, sorting, offset and keyset pages, references, listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE, LARGEST_PAGE = 100, 1000


#: Keys of a map that are turned into columns without being declared.
MOST_COLUMNS = 1000


def select_fields(df: DataFrame, fields: str) -> DataFrame:
    """``a,b`` keeps those columns that exist."""
    return df.select(*[c for c in (f.strip() for f in fields.split(",")) if c in df.columns])


def allowed_fields(df: DataFrame, allowed: Iterable[str]) -> DataFrame:
    allowed = set(allowed) - {"__proto__", "constructor", "prototype"}
    return df.select(*[c for c in df.columns if c in allowed])


def equal_filters(df: DataFrame, query: dict[str, object], allowed: Iterable[str]) -> DataFrame:
    for name, value in query.items():
        if name in set(allowed):
            df = df.where(F.col(name) == F.lit(value))
    return df


def text_search(df: DataFrame, columns: list[str], terms: str) -> DataFrame:
    """Rows with at least one of the terms in one of the columns, and ``score``, how many distinct terms they have."""
    wanted = sorted({t for t in terms.lower().split() if t})
    words = F.array_distinct(F.flatten(F.array(*[F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}_]+") for c in columns])))
    score = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in wanted])))
    return df.withColumn("score", score).where(F.col("score") > 0)


def contains_any(columns: list[str], needle: str) -> Column:
    """Case-blind substring in any of the columns; the needle is plain text, not a pattern."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return out


def sort_keys(spec: str = "-updated_at", tiebreak: str | None = "_id") -> list[Column]:
    """``-a,b``: descending a, then ascending b, then the tiebreak."""
    keys = [k.strip() for k in spec.split(",") if k.strip()]
    return [*[F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in keys], *([F.asc(tiebreak)] if tiebreak else [])]


def sort_by(df: DataFrame, spec: str = "-updated_at", tiebreak: str = "_id") -> DataFrame:
    return df.orderBy(*sort_keys(spec, tiebreak if tiebreak in df.columns else None))


def page(df: DataFrame, number: int = 1, limit: int = PAGE) -> DataFrame:
    """One page of a sorted table; a limit of -1 gives every row, others are held between 1 and 1000."""
    if limit == -1:
        return df
    limit = max(1, min(LARGEST_PAGE, limit))
    return df.offset((max(1, number) - 1) * limit).limit(limit)


def page_info(df: DataFrame, limit: int = PAGE) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long"))


def keyset_page(df: DataFrame, cursor: tuple | None, limit: int = 50, descending: bool = False, keys: tuple[str, str] = ("timestep", "_id")) -> DataFrame:
    """The rows after ``cursor`` in the order of two keys: ``limit + 1`` of them, the last one tells that more follow."""
    limit = max(1, min(200, limit))
    a, b = (F.col(k) for k in keys)
    if cursor is not None:
        x, y = (F.lit(v) for v in cursor)
        df = df.where((a < x) | ((a == x) & (b < y)) if descending else (a > x) | ((a == x) & (b > y)))
    order = [c.desc() if descending else c.asc() for c in (a, b)]
    return df.orderBy(*order).limit(limit + 1)


def client_sort(column: str, descending: bool = False) -> list[Column]:
    """Nulls first (last if descending), numbers by value before text, text by its lower case."""
    number = F.col(column).cast("string").try_cast("double")
    keys = [F.col(column).isNull().cast("int") * -1, number.isNull().cast("int"), number, F.lower(F.col(column).cast("string"))]
    return [k.desc() if descending else k.asc() for k in keys]


def populate(df: DataFrame, other: DataFrame, key: str, other_key: str, name: str, fields: list[str]) -> DataFrame:
    """Left outer reference lookup: the first match as a struct ``name``, null without one."""
    first = other.groupBy(F.col(other_key).alias("_ref")).agg(F.min(F.struct(*fields)).alias(name))
    return df.join(first, F.col(key) == F.col("_ref"), "left").drop("_ref")


def without_arrays(kind: T.DataType, column: Column) -> Column | None:
    """A column without array values at any depth; None if nothing is left."""
    if isinstance(kind, T.ArrayType):
        return None
    if isinstance(kind, T.StructType):
        kept = [(f.name, without_arrays(f.dataType, column[f.name])) for f in kind.fields]
        kept = [c.alias(n) for n, c in kept if c is not None]
        return F.struct(*kept) if kept else F.create_map().cast("map<string,string>")
    return column


def remove_arrays(df: DataFrame) -> DataFrame:
    kept = [(f.name, without_arrays(f.dataType, F.col(f.name))) for f in df.schema.fields]
    return df.select(*[c.alias(n) for n, c in kept if c is not None])


def numeric_default(column: Column, hint: str | None) -> Column:
    """Null becomes 0 where the declared type is a number."""
    return F.coalesce(column, F.lit(0)) if hint in ("int", "float", "double", "number", "uint", "long", "short") else column


def expand_map(df: DataFrame, column: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """One column ``"<label> <key>"`` per key of a map; undeclared keys are found in a first pass, in sorted order.

    A table can't have a column for each of more than ``MOST_COLUMNS`` keys: then keys must be declared.
    """
    if keys is None:
        found = df.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k")
        keys = [r[0] for r in found.limit(MOST_COLUMNS + 1).collect()]
        if len(keys) > MOST_COLUMNS:
            raise ValueError(f"{column} has more than {MOST_COLUMNS} keys: declare those wanted")
    return df.select("*", *[F.try_element_at(F.col(column), F.lit(k)).alias(f"{label} {k}") for k in keys]).drop(column)


def present_columns(df: DataFrame, reserved: Iterable[str]) -> list[str]:
    """Columns besides the reserved ones that hold a value in at least one row, in table order."""
    names = [c for c in df.columns if c not in set(reserved)]
    counts = df.agg(*[F.count(c).alias(c) for c in names]).first() if names else {}
    return [c for c in names if counts[c] > 0]


def flat_rows(df: DataFrame, reserved: list[str], payload: str) -> DataFrame:
    """Reserved columns first, then the fields of the payload struct; a payload field replaces a reserved one in place."""
    fields = df.schema[payload].dataType.fieldNames()
    first = [F.col(f"{payload}.{c}").alias(c) if c in fields else F.col(c) for c in reserved]
    return df.select(*first, *[F.col(f"{payload}.{c}").alias(c) for c in fields if c not in reserved])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Keyed overwrite: of rows with equal keys the one of the highest version stays, new before old in ties."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    names = [c for c in old.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(version, "_new")).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in names]).select(*old.columns)


def cascade_delete(tables: dict[str, DataFrame], references: list[tuple[str, str, str]], root: str, gone: DataFrame, depth: int = 5) -> dict[str, DataFrame]:
    """Delete ``gone(_id)`` from ``root`` and, up to ``depth`` levels down, rows that refer to deleted ones.

    ``references`` holds ``(child table, child column, parent table)``.
    """
    doomed, wave = {root: gone.select("_id")}, {root: gone.select("_id")}
    for _ in range(depth):
        following: dict[str, DataFrame] = {}
        for child, column, parent in references:
            if parent in wave:
                hit = tables[child].join(wave[parent].select(F.col("_id").alias(column)), column, "left_semi").select("_id")
                following[child] = following[child].unionAll(hit) if child in following else hit
        for name, ids in following.items():
            doomed[name] = doomed[name].unionAll(ids) if name in doomed else ids
        wave = following
        if not wave:
            break
    return {n: t.join(doomed[n].distinct(), "_id", "left_anti") if n in doomed else t for n, t in tables.items()}


def merge_chunks(chunks: DataFrame, keys: list[str], order: str, arrays: list[str], maps: list[str], scalars: list[str]) -> DataFrame:
    """Fold chunks of a payload: arrays append in order, maps merge with later values, scalars keep the last non-null."""
    collected = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])
    out = [F.flatten(F.filter(collected(c), lambda v: v.isNotNull())).alias(c) for c in arrays]
    for c in maps:
        entries = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.map_entries(c).alias("v")))), lambda x: x["v"])
        flat = F.flatten(F.filter(entries, lambda v: v.isNotNull()))
        keys_of = F.array_distinct(F.transform(flat, lambda e: e["key"]))
        out.append(F.map_from_entries(F.transform(keys_of, lambda k: F.struct(k, F.element_at(F.filter(flat, lambda e: e["key"] == k), -1)["value"]))).alias(c))
    out += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    return chunks.groupBy(*keys).agg(*out)


def chart_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points of two array columns side by side; a missing y is 0, and an empty series is an error."""
    points = df.select(F.inline(F.arrays_zip(F.col(x).alias("x"), F.col(y).alias("y")))).where("x is not null")
    if points.isEmpty():
        raise ValueError("the series is empty")
    return points.select("x", F.coalesce("y", F.lit(0)).alias("y"))


def resolve_iterable(df: DataFrame, payload: str, key: str | None = None) -> DataFrame:
    """Add ``items``, the rows of a payload: the payload if it is an array, else its ``key``, else its field ``data``,
    else its first array field; without any, an empty array of strings. A null array counts as empty."""
    kind = df.schema[payload].dataType
    found = F.col(payload) if isinstance(kind, T.ArrayType) else None
    if found is None and isinstance(kind, T.StructType):
        arrays = [f.name for f in kind.fields if isinstance(f.dataType, T.ArrayType)]
        chosen = next((n for n in (key, "data", *arrays) if n in arrays), None)
        found = F.col(payload)[chosen] if chosen else None
    if found is None:
        return df.withColumn("items", F.expr("cast(array() as array<string>)"))
    return df.withColumn("items", found).withColumn("items", F.coalesce("items", F.slice(F.array(F.get("items", F.lit(0))), 1, 0)))


def inverse_relations(docs: DataFrame, key: str, refs: str, target: str) -> DataFrame:
    """``(target, back)``: for each document that others refer to, their keys in order. Derived, so it is never stale.

    ``refs`` is a column or an array column of target keys; nulls and repeated references count once.
    """
    one = F.explode(F.col(refs)) if isinstance(docs.schema[refs].dataType, T.ArrayType) else F.col(refs)
    links = docs.select(F.col(key).alias("_own"), one.alias(target)).where(F.col(target).isNotNull()).distinct()
    return links.groupBy(target).agg(F.sort_array(F.collect_list("_own")).alias("back"))


def relation_changes(before: DataFrame, after: DataFrame, key: str, refs: str, target: str) -> DataFrame:
    """``(target, own, change)``: the back-references that an update adds or removes."""

    def links(docs: DataFrame) -> DataFrame:
        one = F.explode(F.col(refs)) if isinstance(docs.schema[refs].dataType, T.ArrayType) else F.col(refs)
        return docs.select(one.alias(target), F.col(key).alias("own")).where(F.col(target).isNotNull()).distinct()

    old, new = links(before), links(after)
    both = [target, "own"]
    return new.join(old, both, "left_anti").withColumn("change", F.lit("add")).unionAll(old.join(new, both, "left_anti").withColumn("change", F.lit("remove")))


def write_exposures(results: dict[str, DataFrame], path: str, listings: dict[str, DataFrame] | None = None, form: str = "json") -> None:
    """Write an analysis: each exposure under ``exposures/<name>/frame=<t>`` with rows in order of time, and the rows of
    each listing under ``listings/<name>``. Spark writes a folder per frame, so nothing passes through one task."""
    for name, df in results.items():
        ranged = df.repartitionByRange("frame").sortWithinPartitions("frame") if "frame" in df.columns else df
        writer = ranged.write.mode("overwrite").format(form)
        (writer.partitionBy("frame") if "frame" in df.columns else writer).save(f"{path}/exposures/{name}")
    for name, df in (listings or {}).items():
        df.write.mode("overwrite").format(form).save(f"{path}/listings/{name}")
