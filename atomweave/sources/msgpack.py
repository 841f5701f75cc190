"""MessagePack files as DataFrames of JSON rows, and rows as MessagePack.

A file is a stream of messages. The small codec below covers nil, booleans, integers, floats, text, binary (as hex text
on reading), arrays and maps.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_CONSTANTS = {0xC0: None, 0xC2: False, 0xC3: True}
#: Format bytes of values with a length: what they hold and how the length is written.
_SIZED = {
    0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"),
    0xDC: ("array", ">H"), 0xDD: ("array", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I"),
}


def decode(data: bytes, at: int = 0) -> tuple[Any, int]:
    """The value that starts at a place, and the place after it. Cut-off data is an error."""
    head, at = data[at], at + 1
    if head in _CONSTANTS:
        return _CONSTANTS[head], at
    if head in _NUMBERS:
        size = struct.calcsize(_NUMBERS[head])
        return struct.unpack_from(_NUMBERS[head], data, at)[0], at + size
    if head < 0x80 or head >= 0xE0:
        return head if head < 0x80 else head - 256, at
    if head < 0xC0:
        kind, n = ("map", head & 15) if head < 0x90 else ("array", head & 15) if head < 0xA0 else ("str", head & 31)
    elif head in _SIZED:
        kind, form = _SIZED[head]
        n, at = struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    else:
        raise ValueError(f"unknown format byte {head:#x}")
    if kind in ("str", "bin"):
        if at + n > len(data):
            raise ValueError("cut-off message")
        raw = bytes(data[at : at + n])
        return (raw.decode() if kind == "str" else raw.hex()), at + n
    items = []
    for _ in range(n if kind == "array" else 2 * n):
        item, at = decode(data, at)
        items.append(item)
    return (items if kind == "array" else dict(zip(map(str, items[::2]), items[1::2]))), at


def messages(data: bytes) -> Iterator[Any]:
    at = 0
    while at < len(data):
        value, at = decode(data, at)
        yield value


def _head(n: int, small: int | None, limit: int, forms: list[tuple[int, str]]) -> bytes:
    if small is not None and n < limit:
        return bytes([small | n])
    for code, form in forms:
        if n < 256 ** struct.calcsize(form):
            return bytes([code]) + struct.pack(form, n)
    raise ValueError("too long")


def encode(value: Any, sort_keys: bool = False) -> bytes:
    """Integers in their shortest form, floats with 64 bits, maps in their own or in sorted order."""
    if value is None or isinstance(value, bool):
        return bytes([{None: 0xC0, False: 0xC2, True: 0xC3}[value]])
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack(">b", value)
        forms = [(0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")] if value >= 0 else [(0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q")]
        for code, form in forms:
            bits = 8 * struct.calcsize(form)
            if value < 2**bits if value >= 0 else value >= -(2 ** (bits - 1)):
                return bytes([code]) + struct.pack(form, value)
        raise ValueError("integer of more than 64 bits")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(len(raw), 0xA0, 32, [(0xD9, ">B"), (0xDA, ">H"), (0xDB, ">I")]) + raw
    if isinstance(value, (bytes, bytearray)):
        return _head(len(value), None, 0, [(0xC4, ">B"), (0xC5, ">H"), (0xC6, ">I")]) + bytes(value)
    if isinstance(value, dict):
        items = sorted(value.items()) if sort_keys else value.items()
        return _head(len(value), 0x80, 16, [(0xDE, ">H"), (0xDF, ">I")]) + b"".join(encode(str(k)) + encode(v, sort_keys) for k, v in items)
    return _head(len(value), 0x90, 16, [(0xDC, ">H"), (0xDD, ">I")]) + b"".join(encode(v, sort_keys) for v in value)


def read_messages(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """``(file, message, item, json)``: one row per message, or per item of its array ``key``.

    Without the key, a message is one row with item 0. A message that has no such array gives no rows; a file that is
    cut off gives the messages before the cut.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["path"], b["content"]):
                rows, stream, number = [], messages(bytes(data)), 0
                while True:
                    try:
                        value = next(stream)
                    except (StopIteration, ValueError, IndexError, struct.error):
                        break
                    items = [value] if key is None else (value.get(key) if isinstance(value, dict) else None)
                    rows += [(file, number, i, json.dumps(x)) for i, x in enumerate(items if isinstance(items, list) else [])]
                    number += 1
                yield pd.DataFrame(rows, columns=["file", "message", "item", "json"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "file string, message long, item long, json string")


def to_messages(df: DataFrame, sort_keys: bool = False) -> DataFrame:
    """``(message binary)``: each row as a map of its columns."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"message": [encode(json.loads(x), sort_keys) for x in b["json"]]})

    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json")).mapInPandas(work, "message binary")
