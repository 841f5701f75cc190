"""Repeated substrings across documents: remove every byte that an earlier document's 50-byte string covers.

Sorting the suffixes of a whole corpus moves every byte position through several shuffles, so positions are thinned out
first, without losing a repeat: each 50-byte window names its anchor, the 20-byte gram in it with the smallest hash, and
equal windows name equal anchors at equal offsets. About one position in sixteen is an anchor.

1. Anchors of every distinct text meet by hash; those of one text alone are dropped.
2. Around each anchor that other texts share, the bytes that its windows span are taken and meet at the anchor: sorted
   by anchor and document, each document's windows are looked up among those of documents with smaller ids. Anchors of
   more than ``HOT`` texts fill no task: their equal spans are aggregated first, and what is left meets by window.
3. The covered bytes go back to the document, are merged to runs and cut out.

Copies of whole texts are decided by their text alone and take no part in steps 1 to 3 but through their first document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm import sketch
from atomweave.llm.text import _CODE, _STEP, encoded, mix, powers, slices
from atomweave.session import cut

LENGTH, GRAM = 50, 20
BITS = 20
#: Texts of an anchor that meet in one task; results don't depend on it.
HOT = 4096
REMEMBERED = 200_000
_LAST = 2**63 - 1
_INVERSE = {"powers": np.ones(1, np.uint64)}


def _inverse_powers(n: int) -> np.ndarray:
    if len(_INVERSE["powers"]) < n:
        step = np.uint64(pow(int(_STEP), -1, 2**64))
        _INVERSE["powers"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 16) - 1, step, np.uint64), dtype=np.uint64)])
    return _INVERSE["powers"][:n]


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive bytes."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * powers(len(data)), dtype=np.uint64, out=total[1:])
    return mix((total[width:] - total[:n]) * _inverse_powers(n))


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end: where each begins, the gram hashes, each window's smallest hash, and the anchors' positions.

    A window that reaches beyond its text has the smallest hash 0 and no anchor.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h = gram_hashes(data, gram) | np.uint64(1)
    width = length - gram + 1
    if len(h) < width:
        return begin, h, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _sliding(h, width, np.minimum).copy()
    ends = np.repeat(begin[1:], np.diff(begin))[: len(low)]
    low[np.arange(len(low)) + length > ends] = 0
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    high = _sliding(padded, width, np.maximum)
    return begin, h, low, np.flatnonzero(high == h)


def _content(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), encoded(batch.column(1))
        yield pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(map(_content, texts), pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])],
            names=["doc_id", "content", "n_bytes", "sha256"],
        )


def _anchor_rows(length: int, gram: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = encoded(batch.column(0))
            for a, b in slices(texts, 1 << 20):
                new = []
                for t in texts[a:b]:
                    if len(t) >= length and (name := _content(t)) not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(name)
                        new.append((name, t))
                begin, h, _, at = anchors([t for _, t in new], length, gram)
                owner = np.searchsorted(begin, at, side="right") - 1
                names = np.array([n for n, _ in new], np.int64)
                pairs = np.unique(np.stack([h[at].view(np.int64), names[owner]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
                yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["anchor", "content"])

    return kernel


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (anchor, content), those whose anchor has several contents, numbered from 0 within it.

    Carried from batch to batch: the last row and how many contents its anchor has had so far.
    """
    last, n = None, 0
    for batch in batches:
        anchor, content = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(anchor):
            continue
        before = np.array(last if last else (~anchor[0], 0), np.int64)
        new = np.concatenate([before[:1], anchor[:-1]]) != anchor
        keep = new | (np.concatenate([before[1:], content[:-1]]) != content)
        anchor, content, new = anchor[keep], content[keep], new[keep]
        if not len(anchor):
            continue
        goes_on = last is not None and not new[0]
        first = np.flatnonzero(np.concatenate([[True], new[1:]]))
        size = np.diff(np.append(first, len(anchor)))
        had = np.zeros(len(first), np.int64)
        if goes_on:
            had[0] = n
        rank = np.arange(len(anchor)) + np.repeat(had - first, size)
        out = np.repeat(had + size, size) > 1
        rows = [anchor[out], content[out], rank[out]]
        if goes_on and n == 1:  # the row that waited for company
            rows = [np.concatenate([np.array([x], np.int64), c]) for x, c in zip((*last, 0), rows)]
        yield pa.record_batch([pa.array(c) for c in rows], names=["anchor", "content", "rank"])
        last, n = (int(anchor[-1]), int(content[-1])), int(had[-1] + size[-1])


def _contexts(length: int, gram: int):
    """For each shared anchor of a text: the bytes its windows span, to be compared where the anchor's rows meet."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, contents, texts, wanted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2)), batch.column(3)
            for a, b in slices(texts, 1 << 20):
                part = texts[a:b]
                begin, h, low, at = anchors(part, length, gram)
                data = b"".join(part)
                names, owners, marks, places, spans, offsets = [], [], [], [], [], []
                owner = np.searchsorted(begin, at, side="right") - 1
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                for k in range(len(part)):
                    mine = at[edges[k] : edges[k + 1]]
                    mine = mine[np.isin(h[mine].view(np.int64), wanted[a + k].values.to_numpy(zero_copy_only=False))]
                    for p in mine.tolist():
                        name = h[p]
                        # windows named by this gram: from the first to the last start whose smallest hash is its own
                        lo = max(int(begin[k]), p - (length - gram))
                        own = np.flatnonzero(low[lo : p + 1] == name)
                        if not len(own):
                            continue
                        first, last = lo + int(own[0]), lo + int(own[-1])
                        names.append(int(name.view(np.int64)))
                        owners.append(docs[a + k])
                        marks.append(contents[a + k])
                        places.append(first - int(begin[k]))
                        offsets.append(p - first)
                        spans.append(data[first : last + length])
                yield pa.record_batch(
                    [pa.array(names, pa.int64()), pa.array(owners, pa.int64()), pa.array(marks, pa.int64()), pa.array(places, pa.int64()), pa.array(offsets, pa.int32()), pa.array(spans, pa.binary())],
                    names=["anchor", "doc", "content", "place", "offset", "span"],
                )

    return kernel


def _earlier(length: int):
    """From rows sorted by (anchor, doc, content), the stretches of windows that a smaller (doc, content) has at the same anchor."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, single, waiting = None, {}, {}, []
        for batch in batches:
            docs, starts, ends = [], [], []
            for anchor, number, content, place, offset, span in zip(*[batch.column(i).to_pylist() for i in range(6)]):
                doc = (number, content)
                if anchor != now:
                    now, whole, single, waiting = anchor, {}, {}, []
                first = whole.setdefault((offset, span), doc)
                if first < doc:
                    docs.append(doc)
                    starts.append(place)
                    ends.append(place + len(span))
                    continue
                if len(whole) == 1:  # windows are looked at only where spans differ
                    waiting = [(offset, span, doc)]
                    continue
                for o, other, owner in waiting:
                    for i in range(len(other) - length + 1):
                        single.setdefault((o - i, other[i : i + length]), owner)
                waiting = []
                for i in range(len(span) - length + 1):
                    if single.setdefault((offset - i, span[i : i + length]), doc) < doc:
                        if docs and docs[-1] == doc and starts[-1] <= place + i <= ends[-1]:
                            ends[-1] = max(ends[-1], place + i + length)
                        else:
                            docs.append(doc)
                            starts.append(place + i)
                            ends.append(place + i + length)
            yield pa.record_batch([pa.array([d for d, _ in docs], pa.int64()), pa.array([c for _, c in docs], pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc", "content", "begin", "stop"])

    return kernel


def _windows(length: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows, windows, places = batch.column(3).to_pylist(), [], [], []
            for k, (place, span) in enumerate(zip(batch.column(2).to_pylist(), spans)):
                n = len(span) - length + 1
                rows += [k] * n
                windows += [span[i : i + length] for i in range(n)]
                places += range(place, place + n)
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int64()), pa.array(windows, pa.binary())], names=["doc", "content", "place", "window"])

    return kernel


def _hot_stretches(spans: DataFrame, length: int) -> DataFrame:
    """Like ``_earlier`` for ``spans`` of hot anchors, with aggregates that are summed up before they are shuffled.

    All but the first of equal spans are covered whole; the windows of the first ones are held against each other.
    """
    own, at = F.struct("doc", "content"), ["anchor", "offset", "span"]
    firsts = spans.groupBy(*at).agg(F.min(own).alias("first"))
    told = cut(spans.join(firsts, at).withColumn("later", own > F.col("first")), "hot-told")
    equal = told.where("later").select("doc", "content", F.col("place").alias("begin"), (F.col("place") + F.length("span")).alias("stop"))
    windows = told.where("not later").select("doc", "content", "place", "span").mapInArrow(_windows(length), "doc long, content long, place long, window binary")
    windows = cut(windows, "hot-windows")
    first = windows.groupBy("window").agg(F.min(own).alias("first"))
    covered = windows.join(first, "window").where(own > F.col("first"))
    return equal.unionAll(covered.select("doc", "content", F.col("place").alias("begin"), (F.col("place") + length).alias("stop")))


def runs(begins: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(begins, kind="stable"):
        b, e = int(begins[i]), int(stops[i])
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, begins, stops = encoded(batch.column(2)), batch.column(3), batch.column(4)
        removed, spans, kept = [], [], []
        for i, text in enumerate(texts):
            gone, at, left = runs(begins[i].values.to_numpy(), stops[i].values.to_numpy()), 0, []
            for b, e in gone:
                left.append(text[at:b])
                at = e
            left.append(text[at:])
            kept.append(b"".join(left))
            removed.append(len(text) - len(kept[-1]))
            spans.append(len(gone))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept]), pa.array(kept, pa.binary())],
            names=["doc", "content", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def repeated_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = HOT) -> DataFrame:
    """What is left of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per input row.

    Texts are UTF-8 bytes; null counts as empty. A byte goes if it lies in a ``length``-byte string that also starts in
    an earlier text: of a smaller doc_id (null is the largest), then of a smaller content hash. Strings are judged on the
    input. Repeated rows don't remove each other. Texts shorter than ``length`` stay whole. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    measured = cut(docs.mapInArrow(_measure, "doc long, content long, n_bytes long, sha256 string"), "measured")
    owners = measured.where(F.col("n_bytes") >= length).groupBy("content", "sha256").agg(F.min("doc").alias("owner"))
    rows = docs.select("text").mapInArrow(_anchor_rows(length, gram), "anchor long, content long")
    shared = rows.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(_shared, "anchor long, content long, rank long")
    shared = cut(shared, "shared")
    hot = cut(shared.where(F.col("rank") == most).select("anchor"), "hot")
    any_hot = not hot.isEmpty()

    def contexts(anchors: DataFrame, name: str) -> DataFrame:
        wanted = anchors.groupBy("content").agg(F.collect_set("anchor").alias("anchors")).join(owners, "content")
        wanted = cut(wanted.select(F.col("owner").alias("doc"), "content", "anchors"), name)
        flags = spark.sparkContext.broadcast(sketch.id_table(wanted.select("doc"), BITS))
        some = docs.mapInArrow(_flagged(flags), "doc long, text string, content long")
        texts = some.join(wanted, ["doc", "content"]).dropDuplicates(["doc", "content"]).select("doc", "content", "text", "anchors")
        return texts.mapInArrow(_contexts(length, gram), "anchor long, doc long, content long, place long, offset int, span binary")

    cold = contexts(shared.join(hot, "anchor", "left_anti") if any_hot else shared, "wanted")
    met = cold.repartition("anchor").sortWithinPartitions("anchor", "doc", "content").mapInArrow(_earlier(length), "doc long, content long, begin long, stop long")
    if any_hot:
        met = met.unionAll(_hot_stretches(cut(contexts(shared.join(hot, "anchor", "left_semi"), "hot-wanted"), "hot-spans"), length))
    covered = cut(met.groupBy("doc", "content").agg(F.collect_list("begin").alias("begins"), F.collect_list("stop").alias("stops")), "covered")

    flags = spark.sparkContext.broadcast(sketch.id_table(covered.select("doc"), BITS))
    some = docs.mapInArrow(_flagged(flags), "doc long, text string, content long")
    left = some.join(covered, ["doc", "content"]).select("doc", "content", "text", "begins", "stops").mapInArrow(_cut_out, "doc long, content long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    left = left.select(*[F.col(c).alias(f"_{c}") for c in ("doc", "content", "n_removed", "n_spans", "kept_sha256")]).dropDuplicates(["_doc", "_content"])

    judged = measured.join(owners, ["content", "sha256"], "left").join(left, (F.col("doc") == F.col("_doc")) & (F.col("content") == F.col("_content")), "left")
    copy = F.coalesce(F.col("owner") < F.col("doc"), F.lit(False))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return judged.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("_n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("_n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("_kept_sha256", "sha256")).alias("kept_sha256"),
    )


def _flagged(flags):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(flags.value[sketch.bucket(batch.column(0).to_numpy(zero_copy_only=False), BITS)]))
            names = pa.array([_content(t) for t in encoded(batch.column(1))], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), names], names=["doc", "text", "content"])

    return kernel
