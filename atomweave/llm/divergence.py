"""How the sources of a language differ in their words: exact divergences of every two sources, and what marks each one.

Method: sort-based streaming. Each task sums the terms of its texts by language and source before anything moves, so a
term of all texts is a few rows a task. Those rows are dealt by (lang, term), sorted by (lang, term, source, document)
and read once: equal keys are runs, a term's runs give its document frequency and its counts by source, and no task holds
more than one term. The kept terms, a small table, are read a second time in slices of each language together with the
sizes of its sources; every slice emits partial sums for each two sources and its best terms for each source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atomweave.llm.text import encoded
from atomweave.session import cut

#: A term stays if so many documents of its language have it; the mass added to each count; terms told per source.
LEAST_DOCS, PRIOR, TERMS = 30, 5, 50
SCALE = 1_000_000_000
#: Distinct (lang, source, term) that a task sums up before it sends them on; results don't depend on it.
HELD = 600_000
#: Terms of a language that are compared in one group; results don't depend on it.
SLICE = 4096

#: Bytes of terms: letters, A-Z lower-cased, and all of UTF-8 beyond ASCII; the rest is a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text, with repeats."""
    return text.translate(_TERM).split()


def _flushed(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (doc, counts, docs) in held.items():
        n = len(counts)
        if n:
            names = list(counts)
            yield pa.record_batch(
                [pa.array([lang] * n, pa.string()), pa.array(names, pa.binary()).cast(pa.string()), pa.array([source] * n, pa.string()), pa.array([doc] * n, pa.int64()), pa.array([docs[t] for t in names], pa.int64()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "term", "source", "doc", "docs", "n"],
            )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and source: each term's documents and occurrences in this task, and the first document of the run."""
    held: dict[tuple[str, str], list] = {}
    for batch in batches:
        for lang, source, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), encoded(batch.column(3))):
            group = held.setdefault((lang, source), [doc, Counter(), Counter()])
            words = terms(text)
            group[1].update(words)
            group[2].update(set(words))
        if sum(len(g[1]) for g in held.values()) >= HELD:
            yield from _flushed(held)
            held = {}
    yield from _flushed(held)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _scan(least: int):
    """From rows sorted by (lang, term, source, doc), the terms of at least ``least`` documents with their counts by source.

    The last term of a batch stays open until another one comes; it is held as sums by source, not as rows.
    """

    def told(runs: list[tuple]) -> pa.RecordBatch:
        kept = [r for r in runs if sum(r[3]) >= least]
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.record_batch([pa.array([r[k] for r in kept], t) for k, t in zip((0, 1, 2, 4), kinds)], names=["lang", "term", "sources", "counts"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # lang, term, sources, docs, counts
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            lang, term, source = batch.column(0), batch.column(1), batch.column(2)
            new = np.ones(n, bool)
            new[1:] = _changes(lang) | _changes(term)
            run = new.copy()
            run[1:] |= _changes(source)
            at = np.flatnonzero(run)
            docs = np.add.reduceat(batch.column(4).to_numpy(), at)
            counts = np.add.reduceat(batch.column(5).to_numpy(), at)
            first = np.searchsorted(at, np.flatnonzero(new))
            total = np.add.reduceat(docs, first)
            ends = np.append(first[1:], len(at))
            wanted = np.flatnonzero(total >= least)
            wanted = np.unique(np.concatenate([[0], wanted, [len(first) - 1]]))
            runs = []
            for k in wanted.tolist():
                a, b = int(first[k]), int(ends[k])
                runs.append((lang[int(at[a])].as_py(), term[int(at[a])].as_py(), source.take(pa.array(at[a:b])).to_pylist(), docs[a:b].tolist(), counts[a:b].tolist()))
            if last is not None:
                if last[:2] == runs[0][:2]:
                    same = int(last[2][-1] == runs[0][2][0])
                    if same:
                        last[3][-1] += runs[0][3][0]
                        last[4][-1] += runs[0][4][0]
                    runs[0] = (*last[:2], *[x + y[same:] for x, y in zip(last[2:], runs[0][2:])])
                else:
                    runs.insert(0, last)
            last = runs.pop()
            if runs:
                yield told(runs)
        if last is not None:
            yield told([last])

    return kernel


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), exact for any size."""
    top = counts + PRIOR
    if top.size and int(top.max()) >= 2**63 // SCALE:
        return (top.astype(object) * SCALE // total.astype(object) + 1).astype(np.int64)
    return top * SCALE // total + 1


def _partial(most: int):
    """Of one slice of a language's terms: partial sums for each two sources, and each source's best terms."""

    def kernel(key: tuple, kept: pa.Table, sizes: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        names = sizes["source"].to_pylist()
        order = sorted(range(len(names)), key=lambda i: names[i].encode())
        names = [names[i] for i in order]
        total = np.array(sizes["size"].to_pylist(), np.int64)[order]
        at = {s: i for i, s in enumerate(names)}
        words = kept["term"].to_pylist()
        rows = sorted(range(len(words)), key=lambda i: words[i].encode())
        counts = np.zeros((len(words), len(names)), np.int64)
        sources, numbers = kept["sources"].to_pylist(), kept["counts"].to_pylist()
        for k, i in enumerate(rows):
            counts[k, [at[s] for s in sources[i]]] = numbers[i]
        words = [words[i] for i in rows]
        out: dict[str, list] = {"lang": [], "source": [], "part": [], "item": [], "value": []}

        def add(source: str, part: str, items: list, values: list) -> None:
            for name, column in zip(out, ([lang] * len(items), [source] * len(items), [part] * len(items), items, values)):
                out[name] += column

        if words:
            vocabulary = sizes["vocabulary"][0].as_py()
            p = _shares(counts, total + PRIOR * vocabulary)
            q = _shares(counts.sum(1), np.array(int(total.sum()) + PRIOR * vocabulary))
        for i, name in enumerate(names):
            apart = np.abs(p - p[:, i : i + 1]).sum(0) if words else np.zeros(len(names), np.int64)
            add(name, "pair", names[:i] + names[i + 1 :], np.delete(apart, i).tolist())
            if words:
                marks = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
                gain = p[marks, i] - q[marks]
                best = np.lexsort((marks, -gain))[:most]
                add(name, "term", [words[k] for k in marks[best]], gain[best].tolist())
        return pa.table(out, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())]))

    return kernel


def source_divergence(docs: DataFrame, least: int = LEAST_DOCS, most: int = TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every (lang, source) of ``docs(doc_id, text, lang, source)``.

    Part ``pair``: each other source of the language with the sum of |p - q| over all kept terms, where p and q are the
    two sources' smoothed shares in parts of ``SCALE``; part ``term``: the ``most`` kept terms that the source has and
    uses more than its language as a whole. Null lang, source and text are empty strings. Each row is a document of its
    own, repeated rows and null doc_ids too. A source alone in its language has no pairs; where no term is in ``least``
    documents all pairs are 0. Ranks go by value, ties by the item's UTF-8 bytes. An empty table gives an empty result;
    other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.mapInArrow(_sums, "lang string, term string, source string, doc long, docs long, n long")
    rows = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "doc")
    kept = cut(rows.mapInArrow(_scan(least), "lang string, term string, sources array<string>, counts array<long>"), "kept-terms")

    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).select("lang", F.col("e.sources").alias("source"), F.col("e.counts").alias("n"))
    size = each.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"))
    groups = docs.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary"))
    slices = (F.floor(F.col("vocabulary") / SLICE) + 1).cast("int")
    left = kept.join(vocabulary, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), slices).cast("int")).drop("vocabulary")
    right = cut(groups, "groups").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    schema = "lang string, source string, part string, item string, value long"
    parts = left.groupBy("lang", "slice").cogroup(right.groupBy("lang", "slice")).applyInArrow(_partial(most), schema)
    parts = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = parts.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= most))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
