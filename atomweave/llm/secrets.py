"""Secret scans: pattern spans of three kinds, and literals that assignments bind to sensitive names.

Method (assignment-aware lexing): texts that hold an assignment sign are lexed into (name, value) pairs in the syntaxes
of source and configuration files; values are quoted literals, bare configuration words, names bound before (constants
are propagated) or sums of those. A literal is a secret if a sensitive name gets it, directly or through other names, and
the value's make-up scores high enough: length, character classes, entropy, and no sign of a placeholder.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.text import encoded, slices

# The base patterns.
ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the same matches: a run is matched whole from its start
KINDS = ("assign", "access", "hex", "literal")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SENSITIVE = ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "accesskey", "privatekey", "signingkey", "encryptionkey", "credential", "authorization", "bearer", "clientsecret", "connectionstring")
_SENSITIVE = tuple(s.encode() for s in SENSITIVE)
_OTHERS = bytes(c for c in range(256) if not ord("a") <= c <= ord("z"))
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "dummy", "xxxx", "****", "none", "null", "true", "false", "todo", "redacted", "sample", "<", "${", "{{")
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_QUOTED = r'"{3}(?:[^\\]|\\.)*?"{3}|\'{3}(?:[^\\]|\\.)*?\'{3}|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\''
#: name, sign, and the rest of the line from the value on; also quoted keys, typed declarations and exports. A name begins
#: where a run of its characters does (or after the run's dashes, dots and digits), so no run is read more than once.
_PAIR = re.compile(rf"""["']?(?<![A-Za-z0-9_.\-])[0-9.\-]*+({_NAME})["']?(?:\x20*+:\x20*+[A-Za-z_][A-Za-z0-9_]*+)?\x20*+(?::=|=>|=(?!=)|:)\x20*+(?=["'A-Za-z_0-9])""")
#: A bare word ends at a sign of assignment but for its own padding, so no character is read by more than two pairs.
_TERM = re.compile(rf"({_QUOTED})|({_NAME})|([A-Za-z0-9+/_.\-]++=*+)", re.S)
_PLUS = re.compile(r"\x20*+[+.]\x20*+(?=[\"'A-Za-z_])")
LEAST_SCORE = 3.0
_EDGE = max(map(len, PLACEHOLDERS)) - 1


def _sensitive(name: str) -> bool:
    plain = re.sub(r"[^a-z]", "", name.lower())
    return any(s in plain for s in SENSITIVE)


class _Made(NamedTuple):
    """What a score needs of a text; a sum's follows from its terms', however often constants double."""

    counts: Counter
    head: str
    tail: str
    refused: bool


def _made(value: str) -> _Made:
    low = value.lower()
    return _Made(Counter(value), low[:_EDGE], low[-_EDGE:], any(p in low for p in PLACEHOLDERS))


def _joined(a: _Made, b: _Made) -> _Made:
    refused = a.refused or b.refused or any(p in a.tail + b.head for p in PLACEHOLDERS)
    return _Made(a.counts + b.counts, (a.head + b.head)[:_EDGE], (a.tail + b.tail)[-_EDGE:], refused)


def _score(made: _Made) -> float:
    size, characters = made.counts.total(), "".join(made.counts)
    if size < 8 or made.refused or re.search(r"\s", characters):
        return 0.0
    classes = sum(bool(re.search(c, characters)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    entropy = -sum(n / size * math.log2(n / size) for n in made.counts.values())
    return (classes - 1) * 0.75 + entropy * 0.6 + min(size, 40) / 20 - (1.0 if classes < 2 else 0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: classes of characters, entropy and length; 0 for placeholders."""
    return _score(_made(value))


class _Value:
    """An assigned value: its terms in order, each a text or an earlier value, and the spans of its own terms."""

    def __init__(self, at: int):
        self.at, self.terms, self.spans, self.literals, self.made = at, [], [], [], None

    def behind(self, seen: set[int], scored: bool = True) -> list[_Value]:
        """Itself and the values it is made of, earlier ones first, without those in ``seen`` or, if told so, scored ones."""
        found, left = [], [self]
        while left:
            v = left.pop()
            if v.at not in seen and (scored or v.made is None):
                seen.add(v.at)
                found.append(v)
                left += [t for t in v.terms if isinstance(t, _Value)]
        return sorted(found, key=lambda v: v.at)

    def score(self) -> float:
        for v in self.behind(set(), scored=False):
            v.made = reduce(_joined, [t.made if isinstance(t, _Value) else _made(t) for t in v.terms])
        return _score(self.made)


def assignments(text: str) -> Iterator[tuple[str, _Value, bool]]:
    """``(name, value, literal)`` of each assignment; a name bound to literals, or to such a name, stands for its value."""
    bound: dict[str, _Value] = {}
    for m in _PAIR.finditer(text):
        name, at, value, literal = m[1], m.end(), _Value(m.start()), False
        while t := _TERM.match(text, at):
            if t[1]:
                edge = 3 if len(t[1]) > 5 and t[1][:3] in ('"""', "'''") else 1
                value.terms.append(t[1][edge:-edge])
                value.literals.append((t.start() + edge, t.end() - edge))
                literal = True
            elif t[2] and t[2] in bound:
                value.terms.append(bound[t[2]])
                literal = True
            else:
                value.terms.append(t[0])
                value.spans.append((t.start(), t.end()))
            plus = _PLUS.match(text, t.end())
            if not plus:
                break
            at = plus.end()
        if literal:
            bound[name] = value
        else:
            bound.pop(name, None)
        if value.terms:
            yield name, value, literal


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _overlaps(taken: list[tuple[int, int]], starts: list[int], s: int, e: int) -> bool:
    k = bisect_left(starts, e)
    return k > 0 and s < taken[k - 1][1]


def _letters_hold_a_name(low: str) -> bool:
    """False only if no name in the text is sensitive: like names, the text is looked at by its letters alone."""
    letters = low.encode().translate(None, _OTHERS)
    return any(s in letters for s in _SENSITIVE)


def spans_of(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans ``(kind, start, end)``, each by start, then kind as listed."""
    base, low = [], None
    if ":" in text or "=" in text:
        low = text.lower()
        if any(h in low for h in _HINTS):
            base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    added = []
    if low is not None and _letters_hold_a_name(low):
        taken = _merged([(s, e) for _, s, e in base])
        starts = [s for s, _ in taken]
        seen: set[int] = set()
        for name, value, literal in assignments(text):
            if _sensitive(name) and value.score() >= LEAST_SCORE + (0.0 if literal else 0.8):
                found = value.spans + [x for v in value.behind(seen) for x in v.literals]
                added += [("literal", s, e) for s, e in found if not _overlaps(taken, starts, s, e)]
    key = lambda x: (x[1], KINDS.index(x[0]))
    return sorted(base, key=key), sorted(set(added), key=key)


def _digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), encoded(batch.column(1))
        for a, b in slices(texts):
            counts, hashes, joined = [[], [], []], [], []
            for text in texts[a:b]:
                base, added = spans_of(text.decode())
                for column, kind in zip(counts, KINDS):
                    column.append(sum(k == kind for k, _, _ in base))
                hashes.append(hashlib.sha256(_digest(base).encode()).hexdigest())
                joined.append(_digest(sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))))
            yield pa.record_batch([ids.slice(a, b - a), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes), pa.array(joined)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of ``docs(doc_id, text)``: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``, one row per input row.

    Spans are ``kind:start:end`` in code points, end exclusive. Base kinds match leftmost without overlap within their
    kind, matches that are too short are dropped. Added spans have kind ``literal`` and never overlap a base span. Null
    and empty texts have none; other columns are ignored; repeated rows and null ids give rows alike.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
