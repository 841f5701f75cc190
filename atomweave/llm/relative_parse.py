"""Repeated passages of words: each text is parsed relative to the rest of the corpus, long factors are duplicates.

Method: relative Lempel-Ziv parsing over windows of 35 words. The reference is the whole corpus, dealt into blocks: every
window names its anchor, the 16-word gram in it with the smallest hash, and the windows of one anchor that follow each
other are a stretch. Equal windows name equal anchors, so all places of a window meet in the block of its anchor, and a
text needs to be looked up there alone. A block indexes its stretches by window; each stretch is factored greedily from
left to right: a factor goes on along a place elsewhere as far as both agree, and at its end the windows that cross the
boundary are looked up before the parse goes on, so no repeat of 35 words is lost between two factors.

1. One pass counts words, hashes the word sequence (equal sequences are copies, which go whole) and counts anchors.
2. A second pass sends the stretches. Anchors of many texts are told by the first pass: their windows travel one by one,
   those that a task has seen twice as finished spans, so a passage of a third of all texts is a row or two a task.
3. Blocks are parsed; a block whose index would grow too large passes its windows on, to meet by window.
4. Covered words are cut out of the texts that have some.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm import sketch
from atomweave.llm.substring_dedup import _content, _inverse_powers, _sliding, runs
from atomweave.llm.text import encoded, mix, powers, slices, split_texts, word_bounds, word_hashes
from atomweave.session import cut

LENGTH, GRAM = 35, 16
#: Occurrences of an anchor in a task from which it is told; in all from which its windows travel singly; most of these.
TOLD, MANY, MOST_HOT = 16, 4096, 1 << 16
#: Windows that a block indexes in one task. None of these changes results.
INDEXED = 1 << 18
REMEMBERED = 200_000
#: Texts with covered words up to which the others are left out before the join, by a bit map of eight bits for each.
FILTERED = 1 << 21
_LAST = 2**63 - 1
_NOTHING = hashlib.sha256(b"").hexdigest()


def _rolling(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words)), dtype=np.uint64, out=total[1:])
    return mix((total[width:] - total[:n]) * _inverse_powers(n))


def anchored(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts end to end: each text's first word, the windows' hashes, and of each stretch its anchor, first window and end."""
    data, begin = split_texts(texts)
    starts, ends = word_bounds(data)
    words = word_hashes(data, starts, ends, fold=False)
    first = np.searchsorted(starts, begin)
    grams = _rolling(words, gram) | np.uint64(1)
    if len(words) < length:
        none = np.zeros(0, np.int64)
        return first, np.zeros(0, np.int64), none, none, none
    low = _sliding(grams, length - gram + 1, np.minimum).copy()
    stops = np.repeat(first[1:], np.diff(first))[: len(low)]
    low[np.arange(len(low)) + length > stops] = 0  # a window that leaves its text
    at = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
    end = np.append(at[1:], len(low))
    real = low[at] != 0
    return first, _rolling(words, length).view(np.int64), low[at[real]].view(np.int64), at[real], end[real]


def _measure(length: int, gram: int, told: int):
    """Per text its words, and in rows of their own the anchors that this task has often."""

    def frequent(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        names, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64),) * 2
        return names[counts >= told], counts[counts >= told]

    def row(doc, content, n, digest, anchor, count) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, t) for c, t in zip((doc, content, n, digest, anchor, count), kinds)], names=["doc", "content", "n_words", "sha256", "anchor", "count"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        for batch in batches:
            texts = encoded(batch.column(1))
            contents = [_content(t) for t in texts]
            counts, digests = [], []
            for t in texts:
                words = t.split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            none = [None] * len(texts)
            yield row(batch.column(0).to_pylist(), contents, counts, digests, none, none)
            for a, b in slices(texts, 1 << 20):
                new = [t for t, c in zip(texts[a:b], contents[a:b]) if c not in seen]
                if len(seen) < REMEMBERED:
                    seen.update(contents[a:b])
                if new:
                    parts.append(anchored(new, length, gram)[2])
            if sum(map(len, parts)) > 1 << 22:
                names, often = frequent(parts)
                none = [None] * len(names)
                yield row(none, none, none, none, names, often)
                parts = []
        names, often = frequent(parts)
        none = [None] * len(names)
        yield row(none, none, none, none, names, often)

    return kernel


_ROW = ("key", "doc", "content", "place", "n", "windows", "again")
_ROW_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
ROW = "key long, doc long, content long, place long, n long, windows binary, again boolean"


def _finished(doc: int, content: int, place: int, n: int) -> tuple:
    """A row of windows that are known to stand elsewhere; its key only spreads it."""
    return (((content ^ (place * 0x9E3779B97F4A7C15)) + 2**63) % 2**64 - 2**63, doc, content, place, n, None, False)


def _repeating(full: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a stretch holds a window twice."""
    of = np.full(len(full), -1)
    inside = np.repeat(np.arange(len(at)), end - at)
    of[np.repeat(at, end - at) + np.arange(len(inside)) - np.repeat(np.cumsum(end - at) - (end - at), end - at)] = inside
    order = np.argsort(full, kind="stable")
    same = (full[order][1:] == full[order][:-1]) & (of[order][1:] == of[order][:-1]) & (of[order][1:] >= 0)
    out = np.zeros(len(at), bool)
    out[of[order][1:][same]] = True
    return out


def _stretches(length: int, gram: int, hot):
    """Rows ``key, doc, content, place, n, windows, again``: n windows from a place on; without ``windows`` they are finished."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        met: dict[int, tuple | None] = {}  # windows of hot anchors: where they stand, until they are met again
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), encoded(batch.column(1))
            for a, b in slices(texts, 1 << 20):
                names, owners, part = [], [], []
                for doc, t in zip(docs[a:b], texts[a:b]):
                    if (name := _content(t)) not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(name)
                        names.append(name)
                        owners.append(doc)
                        part.append(t)
                if not part:
                    continue
                first, full, anchor, at, end = anchored(part, length, gram)
                of = np.searchsorted(first, at, side="right") - 1
                owner, name = np.array(owners, np.int64)[of], np.array(names, np.int64)[of]
                many = np.isin(anchor, hot.value)
                blob, few = full.astype("<i8").tobytes(), ~many
                spans = [blob[8 * i : 8 * j] for i, j in zip(at[few].tolist(), end[few].tolist())]
                columns = [anchor[few], owner[few], name[few], (at - first[of])[few], (end - at)[few], spans, _repeating(full, at, end)[few]]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ROW_TYPES)], names=list(_ROW))
                rows: list[tuple] = []
                for k in np.flatnonzero(many).tolist():
                    shift, doc, content, since = int(first[of[k]]), int(owner[k]), int(name[k]), None
                    for i in range(int(at[k]), int(end[k])):
                        window = int(full[i])
                        if window in met:
                            if met[window]:
                                rows.append(_finished(*met[window], 1))
                                met[window] = None
                            since = i if since is None else since
                            continue
                        if since is not None:
                            rows.append(_finished(doc, content, since - shift, i - since))
                            since = None
                        if len(met) >= INDEXED:
                            met.clear()
                        met[window] = (doc, content, i - shift)
                        rows.append((window, doc, content, i - shift, 1, blob[8 * i : 8 * i + 8], False))
                    if since is not None:
                        rows.append(_finished(doc, content, since - shift, int(end[k]) - since))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _ROW_TYPES)], names=list(_ROW))

    return kernel


def factors(stretches: list[list[int]], skip: list[bool]) -> Iterator[tuple[int, int, int]]:
    """The factors ``(stretch, first window, windows)`` of each stretch that is not skipped, relative to all of them.

    A window's reference is its first place in the block, or its second if it is that place itself. A factor follows its
    reference while both agree. Windows that stand nowhere else are literals.
    """
    index: dict[int, tuple] = {}
    for k, s in enumerate(stretches):
        for i, w in enumerate(s):
            if (e := index.get(w)) is None:
                index[w] = (k, i)
            elif len(e) == 2:
                index[w] = (*e, k, i)
    for k, s in enumerate(stretches):
        i, n = 0, 0 if skip[k] else len(s)
        while i < n:
            e = index[s[i]]
            if len(e) == 2:
                i += 1
                continue
            r, j = e[:2] if e[:2] != (k, i) else e[2:]
            other, m = stretches[r], 1
            while i + m < n and j + m < len(other) and other[j + m] == s[i + m]:
                m += 1
            yield k, i, m
            i += m


def _parse(length: int, limit: int):
    """From rows sorted by key, the covered words ``doc, content, begin, stop``; with ``key`` and ``windows`` those to be met by window."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, size, passing, alone = None, {}, 0, False, True
        out: list[tuple] = []
        met: dict[int, tuple | None] = {}

        def cover(doc: int, content: int, place: int, n: int) -> None:
            out.append((doc, content, place, place + n + length - 1, None, None))

        def close() -> None:
            if not alone and not passing:
                held = list(whole.values())
                spans = [np.frombuffer(s, "<i8").tolist() for s in whole]
                for k, i, m in factors(spans, [h[3] for h in held]):
                    doc, content, place, _ = held[k]
                    cover(doc, content, place + i, m)

        def on(doc: int, content: int, place: int, span: bytes) -> None:
            since = None  # start of a run of windows that the block has had before
            windows = np.frombuffer(span, "<i8").tolist()
            for i, window in enumerate(windows):
                if window in met:
                    if first := met[window]:
                        cover(*first, 1)
                        met[window] = None
                    since = i if since is None else since
                    continue
                if since is not None:
                    cover(doc, content, place + since, i - since)
                    since = None
                if len(met) >= limit:
                    met.clear()
                met[window] = (doc, content, place + i)
                out.append((doc, content, place + i, place + i + length, window, span[8 * i : 8 * i + 8]))
            if since is not None:
                cover(doc, content, place + since, len(windows) - since)

        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys):
                continue
            alike = keys[1:] == keys[:-1]
            company = np.zeros(len(keys), bool)
            company[1:] |= alike
            company[:-1] |= alike
            company[0] |= keys[0] == now
            company[-1] = True
            company |= batch.column(5).is_null().to_numpy(zero_copy_only=False) | batch.column(6).to_numpy(zero_copy_only=False)
            rows = batch.take(pa.array(np.flatnonzero(company)))
            for key, doc, content, place, n, span, again in zip(*[c.to_pylist() for c in rows.columns]):
                if key != now:
                    close()
                    now, whole, size, passing, alone = key, {}, 0, False, True
                    met.clear()
                if span is None:
                    cover(doc, content, place, n)
                elif passing:
                    on(doc, content, place, span)
                elif span in whole:
                    held = whole[span]
                    if not held[3]:
                        cover(held[0], held[1], held[2], n)
                        held[3] = True
                    cover(doc, content, place, n)
                else:
                    alone = alone and not whole and not again
                    whole[span] = [doc, content, place, False]
                    size += n
                    if size > limit and not alone:
                        for s, (d, c, p, _) in whole.items():
                            on(d, c, p, s)
                        whole, passing = {}, True
            kinds = (*[pa.int64()] * 5, pa.binary())
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc", "content", "begin", "stop", "key", "windows"])
                out.clear()
        close()
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 5, pa.binary()))], names=["doc", "content", "begin", "stop", "key", "windows"])

    return kernel


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for doc, content, text, begins, stops in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2)), batch.column(3), batch.column(4)):
            if _content(text) != content:
                continue  # another text of this doc_id
            words, kept, at = text.split(), [], 0
            for b, e in runs(begins.values.to_numpy(), stops.values.to_numpy()):
                kept += words[at:b]
                at = e
            kept += words[at:]
            left = b" ".join(kept)
            for c, v in zip(columns, (doc, content, len(words) - len(kept), hashlib.sha256(left).hexdigest(), left)):
                c.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc", "content", "n_removed", "kept_sha256", "kept"])


def _flagged(flags, bits: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(flags.value[sketch.bucket(batch.column(0).to_numpy(zero_copy_only=False), bits)]))

    return kernel


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, told: int = TOLD, many: int = MANY, indexed: int = INDEXED) -> DataFrame:
    """What is left of ``docs(doc_id, text)``: ``doc_id, n_words, n_removed, kept_sha256, kept``, one row per input row.

    Words are what white space (space, tab to carriage return) separates, unchanged; null counts as empty. Each word that
    lies in ``length`` consecutive words which also start anywhere else goes, in all places alike; windows are judged on
    the input. Every row is a document: repeated rows, equal or null doc_ids repeat each other like any others. Texts
    with fewer words stay whole. ``kept`` holds the words that stay, joined by one space, for texts that lose some but
    not all; it is null for the others. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), "text")
    first = cut(docs.mapInArrow(_measure(length, gram, told), "doc long, content long, n_words long, sha256 string, anchor long, count long"), "measured")
    measured = first.where(F.col("anchor").isNull()).select("doc", "content", "n_words", "sha256")
    # at most 2**16 anchors: each holds a 2**16th of all that are told
    often = first.where(F.col("anchor").isNotNull()).groupBy("anchor").agg(F.sum("count").alias("n"))
    least = F.greatest(F.lit(many), F.col("all") / MOST_HOT)
    total = often.agg(F.sum("n").alias("all"))
    hot = np.array(sorted(r[0] for r in often.join(F.broadcast(total)).where(F.col("n") >= least).select("anchor").collect()), np.int64)

    def parsed(rows: DataFrame, limit: int, name: str) -> DataFrame:
        sent = rows.repartition("key").sortWithinPartitions("key")
        return cut(sent.mapInArrow(_parse(length, limit), "doc long, content long, begin long, stop long, key long, windows binary"), name)

    spans = parsed(docs.mapInArrow(_stretches(length, gram, spark.sparkContext.broadcast(hot)), ROW), indexed, "spans")
    singly = spans.where(F.col("key").isNotNull()).select("key", "doc", "content", F.col("begin").alias("place"), F.lit(1).cast("long").alias("n"), "windows", F.lit(False).alias("again"))
    covered = spans.where(F.col("key").isNull())
    if not singly.isEmpty():  # one window a key: its index never grows
        covered = covered.unionByName(parsed(singly, indexed, "spans-by-window"))

    copied = measured.where(F.col("n_words") >= length).groupBy("sha256").agg(F.count("*").alias("copies")).where("copies > 1").select("sha256", F.lit(True).alias("copy"))
    measured = cut(measured.join(copied, "sha256", "left"), "copies")
    covered = covered.select("doc", "content", "begin", "stop").join(measured.where("copy").select("doc", "content"), ["doc", "content"], "left_anti")
    covered = cut(covered.groupBy("doc", "content").agg(F.collect_list("begin").alias("begins"), F.collect_list("stop").alias("stops")), "covered")
    some, n = docs, covered.count()
    if n <= FILTERED:
        bits = max(12, (8 * n).bit_length())
        flags = spark.sparkContext.broadcast(sketch.id_table(covered.select("doc"), bits))
        some = docs.mapInArrow(_flagged(flags, bits), "doc long, text string")
    left = some.join(covered, "doc").select("doc", "content", "text", "begins", "stops")
    left = left.mapInArrow(_cut_out, "doc long, content long, n_removed long, kept_sha256 string, kept binary")
    left = left.select(*[F.col(c).alias(f"_{c}") for c in left.columns])
    judged = measured.join(left, (F.col("doc") == F.col("_doc")) & (F.col("content") == F.col("_content")), "left")
    return judged.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("_n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(_NOTHING)).otherwise(F.coalesce("_kept_sha256", "sha256")).alias("kept_sha256"),
        F.col("_kept").cast("string").alias("kept"),
    )
