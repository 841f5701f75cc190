"""Ranked lexical search of all documents for a table of items, through an index whose documents are clustered by bisection.

Method: recursive graph bisection orders documents so that those of like terms stand together. It is fitted on a bounded
sample: the sample is halved again and again, documents change sides while that lowers the cost of the terms' gaps, and
each half remembers what its terms cost. Every document of the corpus then goes down the same tree, to the side where it
costs less, and is indexed in the cluster where it ends, in shards of a few hundred documents with the greatest
impact of each term. An item visits clusters by their bound, the sum of their terms' greatest impacts, the best first; a
cluster or shard whose bound is below the item's last place so far can hold no better document and is never scored, one
that equals it is, because ties go by doc_id. Results are exact whatever the clusters are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomweave.llm.text import encoded
from atomweave.session import cut

MOST = 50
#: Documents that the bisection is fitted on, its levels, and how often sides are changed in each.
SAMPLE, LEVELS, SWAPS = 8192, 6, 12
#: Documents of a shard, and of the parts that a cluster is dealt into.
SHARD, PART = 512, 50_000
#: Terms of the items that are searched for in one pass over the corpus; more items take more passes.
QUERY_TERMS = 100_000
#: Clusters visited by each item in the first rounds; the last round has all the others that are not ruled out.
ROUNDS = (1, 7)
_LAST = 2**63 - 1

#: Bytes of terms: digits, letters, A-Z lower-cased, and all of UTF-8 beyond ASCII; the rest is a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, with repeats."""
    return text.translate(_TERM).split()


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))


_FORWARD = "doc long, n long, docs long, terms array<int>, tfs array<long>"


def _forward(vocabulary):
    """Documents with their size and their terms that items have; and a row without ``doc`` of the task's own sums."""

    def batch_of(docs, sizes, counts, names, tfs) -> pa.RecordBatch:
        return pa.record_batch([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), _lists(names, pa.int32()), _lists(tfs, pa.int64())], names=["doc", "n", "docs", "terms", "tfs"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df, size, count = np.zeros(len(known), np.int64), 0, 0
        for batch in batches:
            docs, sizes, names, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), encoded(batch.column(1))):
                words = terms(text)
                if not words:
                    continue
                size, count = size + len(words), count + 1
                found = Counter(words)
                mine = found.keys() & known.keys()
                if mine:
                    at = np.array([known[w] for w in mine], np.int64)
                    order = np.argsort(at)
                    at = at[order]
                    df[at] += 1
                    docs.append(doc)
                    sizes.append(len(words))
                    names.append(at)
                    tfs.append(np.array([found[w] for w in mine], np.int64)[order])
            if docs:
                yield batch_of(docs, sizes, [None] * len(docs), names, tfs)
        at = np.flatnonzero(df)
        yield batch_of([None], [size], [count], [at], [df[at]])

    return kernel


def _csr(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column, and where each row begins (one more entry: the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _gap_cost(degree: np.ndarray, n: int) -> np.ndarray:
    return degree * np.log2(max(n, 1) / (degree + 1.0))


def bisection(flat: np.ndarray, begin: np.ndarray, vocabulary: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """For each inner node of the tree, what a document gains on the left by each of its terms, and the least gain that goes left.

    Documents are the rows ``flat[begin[i]:begin[i + 1]]`` of term numbers. Nodes are numbered as in a heap, from 1.
    """
    weights = np.zeros((1 << levels, vocabulary), np.float32)
    limits = np.zeros(1 << levels, np.float64)
    sizes = np.diff(begin)

    def gathered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        return flat[np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], owner

    def gain(rows: np.ndarray, by_term: np.ndarray) -> np.ndarray:
        at, owner = gathered(rows)
        return np.bincount(owner, by_term[at], len(rows))

    parts = {1: np.arange(len(sizes))}
    for node in range(1, 1 << levels):
        rows = parts.pop(node)
        left, right = rows[: len(rows) // 2], rows[len(rows) // 2 :]
        for _ in range(SWAPS):
            a, b = (np.bincount(gathered(x)[0], minlength=vocabulary).astype(float) for x in (left, right))
            now = _gap_cost(a, len(left)) + _gap_cost(b, len(right))
            away = gain(left, now - _gap_cost(np.maximum(a - 1, 0), len(left)) - _gap_cost(b + 1, len(right)))
            back = gain(right, now - _gap_cost(a + 1, len(left)) - _gap_cost(np.maximum(b - 1, 0), len(right)))
            i, j = np.argsort(-away, kind="stable"), np.argsort(-back, kind="stable")
            m = min(len(i), len(j))
            swap = int((away[i[:m]] + back[j[:m]] > 1e-9).sum())
            if not swap:
                break
            goes, comes = left[i[:swap]].copy(), right[j[:swap]].copy()
            left[i[:swap]], right[j[:swap]] = comes, goes
        a, b = (np.bincount(gathered(x)[0], minlength=vocabulary).astype(float) for x in (left, right))
        weights[node] = (_gap_cost(b + 1, len(right)) - _gap_cost(b, len(right))) - (_gap_cost(a + 1, len(left)) - _gap_cost(a, len(left)))
        score = gain(rows, weights[node].astype(float))
        limits[node] = float(np.median(score)) if len(score) else 0.0
        parts[2 * node], parts[2 * node + 1] = left, right
    return weights, limits


def _placed(tree, levels: int):
    """Adds each document's cluster."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, limits = tree.value
        for batch in batches:
            flat, begin = _csr(batch.column(2))
            n = batch.num_rows
            owner, node = np.repeat(np.arange(n), np.diff(begin)), np.ones(n, np.int64)
            for _ in range(levels):
                score = np.bincount(owner, weights[node[owner], flat].astype(float), n)
                node = 2 * node + (score < limits[node])
            yield pa.record_batch([pa.array(node - (1 << levels), pa.int32()), *batch.columns], names=["cluster", "doc", "n", "terms", "tfs"])

    return kernel


_INDEX = "cluster int, docs array<long>, terms array<int>, best array<int>, ends array<int>, places array<int>, impacts array<int>"


def _shards(n_docs: int, length: int, size: int):
    """Shards of documents sorted by cluster: for each term its greatest impact and its documents' places and impacts."""

    def shard(cluster: int, docs: list, sizes: list, names: list, tfs: list) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(docs)), [len(x) for x in names])
        term, tf = np.concatenate(names).astype(np.int64), np.concatenate(tfs).astype(np.int64)
        m = np.array([50 + 50 * x * n_docs // length for x in sizes], np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[owner])
        order = np.lexsort((owner, term))
        term, owner, impact = term[order], owner[order], impact[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        columns = [term[first], np.maximum.reduceat(impact, first), np.append(first[1:], len(term)), owner, impact]
        return pa.record_batch([pa.array([cluster], pa.int32()), pa.array([docs], pa.list_(pa.int64())), *[_lists([c], pa.int32()) for c in columns]], names=[x.split()[0] for x in _INDEX.split(", ")])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])
        for batch in batches:
            flat, begin = _csr(batch.column(3))
            tfs, _ = _csr(batch.column(4))
            for i, (cluster, doc, n) in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)])):
                if held[0] and (cluster != now or len(held[0]) == size):
                    yield shard(now, *held)
                    held = ([], [], [], [])
                now = cluster
                for c, v in zip(held, (doc, n, flat[begin[i] : begin[i + 1]], tfs[begin[i] : begin[i + 1]])):
                    c.append(v)
        if held[0]:
            yield shard(now, *held)

    return kernel


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each cluster's greatest impact of each term, as far as the task has its shards."""
    held: dict[int, dict[int, int]] = {}
    for batch in batches:
        for cluster, names, best in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            mine = held.setdefault(cluster, {})
            for t, b in zip(names, best):
                if b > mine.get(t, 0):
                    mine[t] = b
    rows = [(c, t, b) for c, mine in held.items() for t, b in mine.items()]
    yield pa.record_batch([pa.array([r[k] for r in rows], pa.int32()) for k in range(3)], names=["cluster", "term", "best"])


class Items:
    """Items as flat term numbers with weights; ``bounds`` sums weight times impact for each."""

    def __init__(self, names: list[np.ndarray], weights: np.ndarray):
        self.n = len(names)
        self.flat = np.concatenate(names) if names else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(x) for x in names])
        self.weight = weights[self.flat]
        self.begin = np.searchsorted(self.owner, np.arange(self.n + 1))

    def bounds(self, best: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.weight * best[self.flat], self.n)


def _cluster_bounds(items, vocabulary: int):
    def kernel(key: tuple, table: pa.Table) -> pa.Table:
        best = np.zeros(vocabulary)
        best[table["term"].to_numpy()] = table["best"].to_numpy()
        bound = items.value.bounds(best).astype(np.int64)
        n = len(bound)
        return pa.table({"cluster": pa.array([key[0].as_py()] * n, pa.int32()), "item": pa.array(range(n), pa.int32()), "bound": pa.array(bound)})

    return kernel


def _search(items, visits, vocabulary: int, most: int):
    """The best documents of each item in the task's shards of the clusters that the item visits: ``item, doc, score``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: Items = items.value
        allowed, least = visits.value
        least = least.astype(float)
        found = [(np.zeros(0), np.zeros(0, np.int64))] * told.n
        at, best = np.full(vocabulary, -1), np.zeros(vocabulary)
        for batch in batches:
            for k in range(batch.num_rows):
                cluster, docs, names, greatest, ends, places, impacts = (batch.column(c)[k] for c in range(7))
                names = names.values.to_numpy()
                best[names] = greatest.values.to_numpy()
                bound = told.bounds(best)
                best[names] = 0
                some = np.flatnonzero(allowed[cluster.as_py()] & (bound >= least) & (bound > 0))
                if not len(some):
                    continue
                docs = docs.values.to_numpy()
                at[names] = np.arange(len(names))
                table = np.zeros((len(names), len(docs)))
                ends = ends.values.to_numpy()
                table[np.repeat(np.arange(len(names)), np.diff(ends, prepend=0)), places.values.to_numpy()] = impacts.values.to_numpy()
                for few in np.array_split(some, -(-len(some) // 256)):
                    rows = np.concatenate([np.arange(told.begin[i], told.begin[i + 1]) for i in few])
                    place, line = at[told.flat[rows]], np.repeat(np.arange(len(few)), told.begin[few + 1] - told.begin[few])
                    weight = np.zeros((len(few), len(names)))
                    weight[line[place >= 0], place[place >= 0]] = told.weight[rows][place >= 0]
                    scores = weight @ table  # whole numbers below 2**53: exact
                    for i, score in zip(few.tolist(), scores):
                        good = np.flatnonzero((score >= least[i]) & (score > 0))
                        if len(good):
                            score, doc = np.concatenate([found[i][0], score[good]]), np.concatenate([found[i][1], docs[good]])
                            order = np.lexsort((doc, -score))[:most]
                            found[i] = (score[order], doc[order])
                            if len(order) == most:
                                least[i] = max(least[i], score[order[-1]])
                at[names] = -1
        sizes = [len(s) for s, _ in found]
        yield pa.record_batch(
            [pa.array(np.repeat(np.arange(told.n), sizes), pa.int32()), pa.array(np.concatenate([d for _, d in found])), pa.array(np.concatenate([s for s, _ in found]).astype(np.int64))] if told.n else [pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())],
            names=["item", "doc", "score"],
        )

    return kernel


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _search_block(docs: DataFrame, rows: list[tuple[int, bytes | None]], most: int, levels: int) -> DataFrame:
    """``(item, rank, doc, score)`` for some items; an item's number is its place in ``rows``."""
    spark = docs.sparkSession
    each = [sorted(set(terms(text or b""))) for _, text in rows]
    words = {w: i for i, w in enumerate(sorted(set().union(*each)))}
    send = spark.sparkContext.broadcast
    told = cut(docs.mapInArrow(_forward(send(words)), _FORWARD), "forward")

    sums = told.where(F.col("docs").isNotNull())
    n_docs, length = sums.agg(F.sum("docs"), F.sum("n")).first()
    n_docs, length = n_docs or 0, length or 1
    df = sums.select(F.explode(F.arrays_zip("terms", "tfs")).alias("e")).groupBy(F.col("e.terms").alias("t")).agg(F.sum("e.tfs").alias("df"))
    weights = np.zeros(len(words))
    for t, n in df.collect():  # a row per term of the items
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    items = send(Items([np.array([words[w] for w in x], np.int64) for x in each], weights))

    forward = told.where(F.col("docs").isNull()).select("doc", "n", "terms", "tfs")
    share = int(min(1.0, SAMPLE / max(n_docs, 1)) * (1 << 30))
    sample = forward.where(F.pmod(F.xxhash64("doc", "n"), F.lit(1 << 30)) < share).orderBy("doc", "n").select("terms").toArrow()
    flat, begin = _csr(sample["terms"])
    tree = send(bisection(flat, begin, len(words), levels))

    placed = forward.mapInArrow(_placed(tree, levels), "cluster int, doc long, n long, terms array<int>, tfs array<long>")
    parts = max(1, n_docs // (PART << levels))
    placed = placed.repartition("cluster", F.pmod(F.xxhash64("doc"), F.lit(parts))).sortWithinPartitions("cluster", "doc")
    index = cut(placed.mapInArrow(_shards(n_docs, length, SHARD), _INDEX), "index")

    best = index.select("cluster", "terms", "best").mapInArrow(_best, "cluster int, term int, best int")
    best = best.groupBy("cluster", "term").agg(F.max("best").alias("best"))
    bounds = np.zeros((1 << levels, len(rows)), np.int64)
    for cluster, item, bound in best.groupBy("cluster").applyInArrow(_cluster_bounds(items, len(words)), "cluster int, item int, bound long").collect():  # clusters x items
        bounds[cluster, item] = bound

    order = np.argsort(-bounds, axis=0, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(order))[:, None], axis=0)
    found, least, begin_at = None, np.zeros(len(rows), np.int64), 0
    for n in (*ROUNDS, len(order)):
        visits = (place >= begin_at) & (place < begin_at + n) & (bounds > 0) & (bounds >= least)
        begin_at += n
        some = [int(c) for c in np.flatnonzero(visits.any(1))]
        if not some:
            continue
        new = index.where(F.col("cluster").isin(some)).mapInArrow(_search(items, send((visits, least)), len(words), most), "item int, doc long, score long")
        found = cut(_ranked(new if found is None else found.select("item", "doc", "score").unionByName(new), most), "found")
        for item, score in found.where(F.col("rank") == most).select("item", "score").collect():  # a row per item
            least[item] = score
    if found is None:
        return spark.createDataFrame([], "item int, rank int, doc long, score long")
    return found.select("item", "rank", "doc", "score")


def ranked_search(docs: DataFrame, items: DataFrame, most: int = MOST, levels: int = LEVELS, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The ``most`` best documents of ``docs(doc_id, text)`` for each of ``items(item_id, text)``: ``item_id, rank, doc_id, score``.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null has none. A term's weight and a
    document's size norm are whole numbers, so scores are exact. Equal scores go by doc_id (null is the largest). Each
    row is a document of its own; equal rows of ``items`` are one item, rows of one item_id with different texts are
    ranked each for itself. Items without terms, or whose terms no document has, give no rows; empty tables give none.
    Items are searched in blocks of some ``query_terms`` terms, each in a pass of its own over all documents.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    items = cut(items.select("item_id", F.col("text").cast("string").alias("text")).distinct(), "items")
    blocks = 1 + int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (6 * query_terms)
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        rows = [(r["item_id"], (r["text"] or "").encode()) for r in block]
        if not rows:
            continue
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = _search_block(docs, rows, most, levels).join(F.broadcast(names), "item")
        part = found.select("item_id", "rank", F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out
