"""Best-fit packing of tokenised documents into sequences of a fixed length.

Method (best-two-fit): a bin is filled greedily, each time with the longest piece that fits. If a gap is left, the
bin's smallest piece is taken out again and two unpacked pieces that fit the wider gap more tightly replace it.
Pieces are dealt by hash into groups of a bounded size and each group is packed in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.text import encoded, slices
from atomweave.llm.tokens import Tokens
from atomweave.session import cut

LENGTH, END = 1024, 2
#: Pieces that are packed together: about as many as fill some ten thousand sequences.
GROUP = 32_768


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids: all but the first have the full length."""
    if n <= length:
        return [(0, n)]
    head = n % length
    return ([(0, head)] if head else []) + [(s, length) for s in range(head, n, length)]


def best_two_fit(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; every length lies between 1 and ``capacity``."""
    order = np.argsort(lengths, kind="stable")
    bounds = np.searchsorted(lengths[order], np.arange(capacity + 2))
    stock = [order[bounds[s] : bounds[s + 1]].tolist() for s in range(capacity + 1)]
    left = 0  # bit s is set while pieces of length s are unpacked
    for s in range(1, capacity + 1):
        left |= bool(stock[s]) << s

    def longest(most: int, left: int) -> int:
        return (left & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while left:
        inside, gap = [], capacity
        while (s := longest(gap, left)) > 0:
            inside.append(stock[s].pop())
            if not stock[s]:
                left &= ~(1 << s)
            gap -= s
        if gap and len(inside) > 0 and left:
            small = int(lengths[inside[-1]])
            room, best, pair = gap + small, small, None
            a = longest(room - 1, left)
            while a > 0 and 2 * a > best and best < room:
                b = longest(min(a, room - a), left if len(stock[a]) > 1 else left & ~(1 << a))
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                a = longest(a - 1, left)
            if pair:
                back = inside.pop()
                stock[small].append(back)
                left |= 1 << small
                for s in pair:
                    inside.append(stock[s].pop())
                    if not stock[s]:
                        left &= ~(1 << s)
        at = 0
        for i in inside:
            bins[i], offsets[i] = used, at
            at += int(lengths[i])
        used += 1
    return bins, offsets


def _pieces(vocabulary: str, length: int, columns: list[str]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(vocabulary)
        tail = np.array([END], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            rows = []
            texts = encoded(batch.column(columns.index("text")))
            for a, b in slices(texts):
                for i, ids in enumerate(tokens.encode([t.decode() for t in texts[a:b]]), a):
                    ids += tail
                    for k, (start, size) in enumerate(cuts(len(ids) // 4, length)):
                        rows.append(i)
                        for column, value in zip(out, (k, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]))):
                            column.append(value)
            kept = [batch.column(columns.index(c)).take(pa.array(rows, pa.int64())) for c in columns if c != "text"]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([*kept, *[pa.array(c, k) for c, k in zip(out, kinds)]], names=[c for c in columns if c != "text"] + ["piece", "start", "length", "ids_crc32"])

    return kernel


def _pack(length: int):
    def pack(table: pa.Table) -> pa.Table:
        bins, offsets = best_two_fit(table["length"].to_numpy(), length)
        return pa.table({"uid": table["uid"], "sequence_id": pa.array((table["g"].to_numpy().astype(np.int64) << 32) | bins), "offset": pa.array(offsets)})

    return pack


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` and their places: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and an end id; null and empty texts are the end id alone. Pieces of the full length
    are sequences by themselves (negative ids). Repeated rows are packed each for itself; a null doc_id stays null.
    Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = docs.mapInArrow(_pieces(vocabulary, length, docs.columns), "doc_id long, piece int, start long, length long, ids_crc32 long")
    made = cut(made.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = made.where(F.col("length") == length).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    short = made.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group))
    dealt = short.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("g"))
    places = dealt.groupBy("g").applyInArrow(_pack(length), "uid long, sequence_id long, offset long")
    packed = short.join(places, "uid")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return full.select(*names).unionAll(packed.select(*names))
