"""Words and word shingles of whole texts: numpy kernels that run inside Spark tasks.

A word is a run of bytes outside space and 0x09-0x0D; in UTF-8 no other character contains those bytes, so words can be
found on the encoded text. Word and shingle identities are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np

#: The word pattern of the contracts, for Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.default_rng(20_240_117)
_CODE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Multipliers of a shingle's words by their place.
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(32))


_POWERS = {"up": np.ones(1, np.uint64)}


def powers(n: int) -> np.ndarray:
    """The first n powers of the byte hash's base, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        _POWERS["up"] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _STEP, np.uint64), dtype=np.uint64)])
    return _POWERS["up"][:n]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_SPACE[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold``, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    # The words' bytes by place in the word: as many passes as the longest word has bytes; very long words go one by one.
    length = ends - starts
    codes = _CODE[_LOWER] if fold else _CODE
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(length, kind="stable")
    left = np.searchsorted(length[order], np.arange(1, 33), side="left")
    scale = powers(32)
    for place in range(min(32, int(length[order[-1]]))):
        live = order[left[place] :]
        out[live] += codes[data[starts[live] + place]] * scale[place]
    for i in order[np.searchsorted(length[order], 32, side="right") :]:
        rest = codes[data[starts[i] + 32 : ends[i]]]
        out[i : i + 1] += np.sum(rest * powers(len(rest) + 32)[32:], dtype=np.uint64, keepdims=True)
    return mix(out ^ (length.astype(np.uint64) << np.uint64(48)))


def split_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid end to end with a space after each, and where each begins (one more entry: the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(sizes)])


def doc_words(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the first word of each text (one more entry: the end)."""
    data, begin = split_texts(texts)
    starts, ends = word_bounds(data)
    return word_hashes(data, starts, ends, fold), np.searchsorted(starts, begin)


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    words, first = doc_words(texts)
    scaled = [words * _PLACE[j] for j in range(width)]
    n = len(words)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    if len(full):
        for j in range(width):
            full += scaled[j][j : j + len(full)]
        full = mix(full)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            s = full[a : b - width + 1].copy()
            s.sort()
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            total = sum((int(scaled[j][a + j]) for j in range(b - a)), b - a) % 2**64
            out.append(mix(np.array([total], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(texts: list[bytes | None], at_most: int = 1 << 21):
    """Index ranges of consecutive texts of about ``at_most`` bytes together, so that a kernel's arrays stay small."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= at_most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encoded(column) -> list[bytes]:
    """The UTF-8 texts of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
