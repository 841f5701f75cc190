"""N-gram Jaccard join: which documents share three quarters of their word 5-grams.

Method: a global rare-first order of n-grams, prefix filtering with length, positional and suffix filters, a join on
prefix n-grams, and one exact verification per pair.

1. One pass hashes every document's n-gram set (``shingle_sets``) and counts n-grams in a sketch of ``2**SKETCH_BITS``
   counters. The order (counter, hash) puts rare n-grams first; any common order is exact, this one is selective.
   A parity map of each set is kept, which bounds from below how far two sets are apart.
2. Equal sets form classes, so copies cost one row each. A second pass emits each set's prefix.
3. Prefix rows meet at their n-gram. There, every class is offered two partners, the first of the n-gram's list and the
   one just before it; each class has its two most frequent offers verified. A second round draws partners from other
   components. That links groups of near copies with a number of pairs in proportion to their members.
4. At crowded n-grams of several components, each shows a few classes; the closest few of such pairs of two components
   are verified, and components that link are joined.
5. Remaining pairs that share a prefix n-gram and lie in different components are formed if they pass the filters by
   length, position and parity map, which the join itself applies. Pairs within a component can't change it.

Verification compares each pair once: the suffix filter first (it splits both ordered sets at one n-gram, again and
again, and adds up by how much the parts differ in size), then the whole sets.

Exactness: two linked sets share a prefix n-gram, so they end in one component through step 3, 4 or 5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomweave.llm import sketch
from atomweave.llm.text import encoded, mix, shingle_sets, slices
from atomweave.operators.graph import connected_components
from atomweave.session import cut

SKETCH_BITS = 20
#: Fewest bits of a set's parity map, by which the suffix filter bounds how many n-grams two sets have apart.
PARITY_BITS = 1024
#: Partners by which a class is linked before the remaining pairs are formed.
PARTNERS = 3
#: Drawn partners of a class that the parity map ranks to choose those; pairs left over are formed later.
DRAWN = 12
#: An n-gram of more rows than this is crowded: it shows so many classes of each component before its remaining pairs are formed.
CROWD = 64
#: 64-bit words of the parity map by which the last join filters, and how often the suffix filter splits a part.
FOLDED, SPLITS = 16, 3
#: Sets of one task that are remembered, so that copies read by the same task emit their prefix once.
REMEMBERED = 200_000


def _class_of(s: np.ndarray) -> int:
    """A 64-bit name of a sorted set of hashes; 0 for the empty set."""
    if not len(s):
        return 0
    place = np.arange(1, len(s) + 1, dtype=np.uint64)
    both = np.array([np.sum(mix(s + place), dtype=np.uint64), np.bitwise_xor.reduce(mix(s * np.uint64(3) + place))], np.uint64)
    return int(mix(both[:1] ^ mix(both[1:]))[0].view(np.int64)) or 1


def _parity(s: np.ndarray) -> bytes:
    """One bit per hash bucket: whether the set has an odd number of n-grams there; as many bits as n-grams at least."""
    bits = max(PARITY_BITS, 1 << (len(s) - 1).bit_length())
    marks = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(marks.astype(np.uint8)).tobytes()


def prefix_length(n: int) -> int:
    """How many of the first n-grams of a set must meet those of any set with Jaccard of 3/4 or more."""
    return n - (3 * n + 3) // 4 + 1 if n else 0


def _measure(width: int, bits: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
        names = ("doc_id", "n_shingles", "cls", "parity", "chunk", "counts")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), encoded(batch.column(1))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], width)
                if len(every := np.concatenate(sets)):
                    counts += np.bincount((every >> np.uint64(64 - bits)).astype(np.int64), minlength=len(counts))
                none = [None] * (b - a)
                columns = (ids[a:b], [len(s) for s in sets], [_class_of(s) for s in sets], [_parity(s) for s in sets], none, none)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        for chunk, blob in sketch.chunks(counts):
            yield pa.record_batch([pa.array([c], k) for c, k in zip((None, None, None, None, chunk, blob), kinds)], names=names)

    return kernel


def _prefixes(width: int, bits: int, counts):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = counts.value, set()
        for batch in batches:
            texts = encoded(batch.column(0))
            for a, b in slices(texts):
                tokens, classes, sizes, places = [], [], [], []
                for s in shingle_sets(texts[a:b], width):
                    if not len(s) or (name := _class_of(s)) in seen:
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(name)
                    n, p = len(s), prefix_length(len(s))
                    order = np.lexsort((s, table[(s >> np.uint64(64 - bits)).astype(np.int64)]))[:p]
                    tokens.append(s[order])
                    classes.append(np.full(p, name, np.int64))
                    sizes.append(np.full(p, n, np.int32))
                    places.append(np.arange(p, dtype=np.int32))
                if tokens:
                    yield pa.record_batch(
                        [pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in tokens], classes, sizes, places)],
                        names=["token", "cls", "n", "pos"],
                    )

    return kernel


def _offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (token, n, cls), those whose token has more classes, with the token's first and previous one.

    Only the first and the latest row of the token being read are carried from batch to batch.
    """
    names = ["token", "cls", "n", "pos"]
    first = last = None  # rows of the token that the previous batch ended in
    told = True  # whether the row `first` was handed on
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        head = [r for r in (first, last) if r is not None][: 2 if first is not last else 1]
        columns = [np.concatenate([np.array([r[i] for r in head], c.dtype), c]) for i, c in enumerate(columns)]
        token, cls, n, pos = columns
        fresh = np.empty(len(token), bool)  # not the same class again
        fresh[0] = True
        fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        keep = np.flatnonzero(fresh)
        carried = int(np.count_nonzero(keep < len(head)))
        token, cls, n, pos = (c[keep] for c in columns)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        group = np.cumsum(np.concatenate([[True], token[1:] != token[:-1]])) - 1
        size = np.diff(np.append(starts, len(token)))[group]
        hub = starts[group]
        prev = np.maximum(np.arange(len(token)) - 1, hub)
        out = size > 1
        out[:carried] = False
        if carried and size[0] > 1 and not told:
            out[0] = True
        last_start = int(starts[-1])
        told = bool(out[last_start]) or (last_start == 0 and carried > 0 and (told or size[0] > 1))
        at = np.flatnonzero(out)
        yield pa.record_batch(
            [pa.array(c[i]) for c, i in ((token, at), (cls, at), (n, at), (pos, at), (cls, hub[at]), (n, hub[at]), (pos, hub[at]), (cls, prev[at]), (n, prev[at]), (pos, prev[at]))],
            names=names + ["hub", "hub_n", "hub_pos", "prev", "prev_n", "prev_pos"],
        )
        first = tuple(c[last_start] for c in (token, cls, n, pos))
        last = first if last_start == len(token) - 1 else tuple(c[-1] for c in (token, cls, n, pos))
        if last is not first:
            continue
        last = first


def _sets(width: int, bits: int, wanted):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(flags[sketch.bucket(ids, bits)]))
            ids, texts = batch.column(0).to_pylist(), encoded(batch.column(1))
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b], width)
                yield pa.record_batch(
                    [pa.array(ids[a:b], pa.int64()), pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "cls", "grams"],
                )

    return kernel


def _apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of n-grams in which two sets differ; the larger map is folded to the smaller's size."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _parity_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop pairs whose parity maps differ in more bits than linked sets can have n-grams apart."""
    for batch in batches:
        maps = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
        apart = np.fromiter((_apart(x, y) for x, y in maps), np.int64, batch.num_rows)
        total = batch.column(4).to_numpy() + batch.column(5).to_numpy()
        keep = apart <= total - 2 * -(-3 * total.astype(np.int64) // 7)
        kept = batch.filter(pa.array(keep)).select([0, 1])
        yield pa.record_batch([*kept.columns, pa.array(apart[keep])], names=["a", "b", "apart"])


def suffix_bound(x: np.ndarray, y: np.ndarray, most: int, splits: int = SPLITS) -> int:
    """A lower bound of the number of elements in which two ascending sets differ; more than ``most`` is not told exactly.

    Both are split at the middle element of ``y``; parts on one side of it can only match each other.
    """
    least = abs(len(x) - len(y))
    if not splits or not len(y) or least > most:
        return least
    middle = len(y) // 2
    at = int(np.searchsorted(x, y[middle]))
    found = at < len(x) and x[at] == y[middle]
    left, right = (x[:at], y[:middle]), (x[at + found :], y[middle + 1 :])
    rest = abs(len(right[0]) - len(right[1])) + (not found)
    least = abs(len(left[0]) - len(left[1])) + rest
    if least > most:
        return least
    bound = suffix_bound(*left, most - rest, splits - 1)
    if bound + rest > most:
        return bound + rest
    here = bound + (not found)
    return here + suffix_bound(*right, most - here, splits - 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right, keep = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            total = len(x) + len(y)
            most = total - 2 * -(-3 * total // 7)
            if suffix_bound(x, y, most) > most:
                keep.append(False)
                continue
            both = np.concatenate([x, y])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * shared >= 75 * (total - shared))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, name: str, nearest: int = 0) -> tuple[DataFrame, DataFrame]:
    """Of distinct ``pairs(a, b)`` of classes those that link, and those that were compared whole: parity maps come first.

    With ``nearest``, only so many pairs of each ``a`` are compared, those whose maps are closest.
    """
    spark, bits = docs.sparkSession, SKETCH_BITS
    side = classes.select("cls", "parity", "n")
    for x in "ab":
        pairs = pairs.join(side.select(F.col("cls").alias(x), F.col("parity").alias(f"p{x}"), F.col("n").alias(f"n{x}")), x)
    pairs = pairs.select("a", "b", "pa", "pb", "na", "nb").mapInArrow(_parity_filter, "a long, b long, apart long")
    if nearest:
        closest = Window.partitionBy("a").orderBy("apart", "b")
        pairs = pairs.withColumn("r", F.row_number().over(closest)).where(F.col("r") <= nearest)
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-pairs")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "class_id"), "cls")
    wanted = spark.sparkContext.broadcast(sketch.id_table(involved.select("class_id"), bits))
    found = docs.where("doc_id is not null").mapInArrow(_sets(width, bits, wanted), "doc_id long, cls long, grams binary")
    sets = found.join(involved.select(F.col("class_id").alias("doc_id"), "cls"), ["doc_id", "cls"]).dropDuplicates(["doc_id", "cls"])
    return cut(_verified(pairs, cut(sets.select("cls", "grams"), "sets")), name), pairs


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("cls").alias("a"), F.col("grams").alias("ga")), "a")
    both = with_a.join(sets.select(F.col("cls").alias("b"), F.col("grams").alias("gb")), "b")
    return both.select("a", "b", "ga", "gb").mapInArrow(_verify, "a long, b long")


def _could_link(x: str, y: str):
    """Length and positional filters between a row's columns ``n, pos`` and a partner's, in either order of size."""
    n, pos, m, q = F.col(f"{x}n"), F.col(f"{x}pos"), F.col(f"{y}n"), F.col(f"{y}pos")
    need = F.floor((3 * (n + m) + 6) / 7)
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (F.least(n - pos, m - q) >= need)


def _mixed(met: DataFrame, components: DataFrame, name: str) -> DataFrame:
    """Prefix rows with their class's component and their n-gram's number of rows, of the n-grams where several components meet."""
    named = met.select("token", "cls", "n", "pos").join(components.withColumnRenamed("vertex", "cls"), "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    several = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("crowd")).where("lo < hi")
    return cut(named.join(several.select("token", "crowd"), "token"), name)


def _folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = [np.bitwise_xor.reduce(np.frombuffer(p, "<i8").reshape(-1, FOLDED), axis=0) for p in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([m.tolist() for m in maps], pa.list_(pa.int64()))], names=["cls", "fold"])


def _folded(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Prefix rows with their class's parity map, folded to ``FOLDED`` words."""
    used = rows.select("cls").distinct().join(classes.select("cls", "parity"), "cls").select("cls", "parity")
    return rows.join(used.mapInArrow(_folds, "cls long, fold array<long>"), "cls")


def _across(rows: DataFrame) -> DataFrame:
    """``(a, b, ca, cb, apart)``: rows of folded classes that share a prefix n-gram across components and pass all filters.

    Parity maps are compared in the join's own condition, so a pair that they rule out is no row.
    """
    x, y = rows.select(*[F.col(c).alias(f"x_{c}") for c in rows.columns]), rows.select(*[F.col(c).alias(f"y_{c}") for c in rows.columns])
    apart = sum((F.bit_count(F.get("x_fold", F.lit(k)).bitwiseXOR(F.get("y_fold", F.lit(k)))) for k in range(1, FOLDED)), F.bit_count(F.get("x_fold", F.lit(0)).bitwiseXOR(F.get("y_fold", F.lit(0)))))
    total = F.col("x_n") + F.col("y_n")
    near = apart <= total - 2 * F.floor((3 * total + 6) / 7)
    crossing = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_cls") < F.col("y_cls")) & (F.col("x_component") != F.col("y_component")) & _could_link("x_", "y_") & near)
    return crossing.select(F.col("x_cls").alias("a"), F.col("y_cls").alias("b"), F.col("x_component").alias("ca"), F.col("y_component").alias("cb"), apart.alias("apart"))


def _crossing(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of classes that share a prefix n-gram across components and pass all filters."""
    return _across(_folded(rows, classes)).select("a", "b").distinct()


def _meeting(rows: DataFrame, classes: DataFrame, compared: DataFrame) -> DataFrame:
    """Of two components that share prefix n-grams the ``PARTNERS`` closest pairs ``(a, b)``, each n-gram showing ``CROWD`` classes of a component.

    They are drawn by n-gram, so large components show many; pairs grow with the components that meet, not with their members.
    """
    drawn = Window.partitionBy("token", "component").orderBy(F.xxhash64("token", "cls"), "cls")
    some = rows.withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= CROWD).drop("r")
    ends = [F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")]
    met = _across(_folded(some, classes)).select("a", "b", *ends, "apart").distinct()
    closest = Window.partitionBy("ca", "cb").orderBy("apart", "a", "b")
    met = met.join(compared, ["a", "b"], "left_anti").withColumn("r", F.row_number().over(closest))
    return met.where(F.col("r") <= PARTNERS).select("a", "b")


def _new_pairs(pairs: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs, each class's own order kept, without those that were compared before in either order."""
    key = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    return pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(compared.select(*key), ["lo", "hi"], "left_anti").select("a", "b")


def ngram_jaccard_join(docs: DataFrame, width: int = 5) -> DataFrame:
    """Classes and components of ``docs(doc_id, text)`` under Jaccard similarity of 75 % or more of word n-gram sets.

    Returns one row per input row: ``doc_id, n_shingles, class_id, component_id``. A null text counts as empty; empty
    texts have ``n_shingles`` 0 and are their own component. Texts with fewer than ``width`` words have one n-gram, the
    whole sequence. Equal sets share ``class_id`` (their smallest doc_id); ``component_id`` is the smallest doc_id
    reachable over links. Repeated rows give repeated rows; a row without doc_id follows the rows of equal n-gram set,
    and without any links to nothing. Other columns are ignored. An empty table gives an empty result.
    """
    spark, bits = docs.sparkSession, SKETCH_BITS
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = "doc_id long, n_shingles long, cls long, parity binary, chunk int, counts binary"
    measured = cut(docs.mapInArrow(_measure(width, bits), kinds), "measured")
    meta = measured.where("chunk is null").select("doc_id", "n_shingles", "cls")
    order = spark.sparkContext.broadcast(sketch.merged(measured.where("chunk is not null").select("chunk", "counts"), bits))
    classes = measured.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.min("n_shingles").alias("n"), F.first("parity").alias("parity"))
    classes = cut(classes, "classes")

    prefixes = docs.select("text").mapInArrow(_prefixes(width, bits, order), "token long, cls long, n int, pos int")
    met = prefixes.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(
        _offers, "token long, cls long, n int, pos int, hub long, hub_n int, hub_pos int, prev long, prev_n int, prev_pos int"
    )
    met = cut(met, "met")

    offers = met.where(F.col("cls") != F.col("hub")).where(_could_link("", "hub_")).select("cls", F.col("hub").alias("with")).unionAll(
        met.where((F.col("cls") != F.col("prev")) & (F.col("prev") != F.col("hub"))).where(_could_link("", "prev_")).select("cls", F.col("prev").alias("with"))
    )
    votes = offers.groupBy("cls", "with").count()
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("count"), "with"))).where("r <= 2")
    pairs = best.select(F.least("cls", "with").alias("a"), F.greatest("cls", "with").alias("b")).distinct()
    links, compared = _links(docs, pairs, classes, width, "links")
    first = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    left = _mixed(met, first, "left")
    hubs = left.groupBy("token").agg(F.min(F.struct(F.xxhash64("token", "cls").alias("draw"), "cls", "n", "pos", "component")).alias("hub"))
    offers = left.join(hubs, "token").select("*", F.col("hub.n").alias("hub_n"), F.col("hub.pos").alias("hub_pos"))
    offers = offers.where((F.col("hub.component") != F.col("component")) & _could_link("", "hub_"))
    offers = offers.groupBy(F.col("cls").alias("a"), F.col("hub.cls").alias("b")).count()
    drawn = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("count"), F.xxhash64("a", "b")))
    offers = offers.withColumn("r", drawn).where(F.col("r") <= DRAWN).select("a", "b")
    others, compared_too = _links(docs, _new_pairs(offers, compared), classes, width, "others", PARTNERS)
    links, compared = links.unionAll(others), compared.unionAll(compared_too)
    second = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    left = _mixed(left.drop("component"), second, "rest")
    crowded = left.where(F.col("crowd") > CROWD).drop("crowd")
    if not crowded.isEmpty():
        found, compared_too = _links(docs, _meeting(crowded, classes, compared), classes, width, "meetings")
        links, compared = links.unionAll(found), compared.unionAll(compared_too)
        third = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        left = _mixed(left.drop("component"), third, "apart")
    more, _ = _links(docs, _new_pairs(_crossing(left.drop("crowd"), classes), compared), classes, width, "more")

    every = links.unionAll(more).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    final = connected_components(every).withColumnRenamed("vertex", "cls")
    labelled = classes.join(final, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = labelled.groupBy("component").agg(F.min("class_id").alias("component_id"))
    labelled = labelled.join(smallest, "component").select("cls", "class_id", "component_id")
    linked = meta.where("n_shingles > 0").join(labelled, "cls").select("doc_id", "n_shingles", "class_id", "component_id")
    alone = meta.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)
