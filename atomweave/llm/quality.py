"""Quality rules: measures of each text, and lines that too many documents of a host share.

Method (cross-document line frequency): normalised lines are hashed, the distinct documents that carry a line are
counted per host, lines above the limit are removed wherever they occur but in their first document, and documents that
lose more than half of their words are rejected as depleted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.text import LOWER, UPPER, encoded, slices
from atomweave.session import cut

#: A line may occur in this many distinct texts of a host.
LINE_LIMIT = 20
#: Frequent lines that are sent to every task at once: 16 bytes each. Beyond, they are joined.
MOST_SENT = 200_000
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, host: bytes | None) -> list[tuple[int, int, bytes]]:
    """For each line with a word: its hash within the host, its number of words, and the line as it stands."""
    seed = 0 if host is None else xxhash.xxh64_intdigest(host, 1) >> 1
    out = []
    for line in text.split(b"\n"):
        if words := line.split():
            out.append((xxhash.xxh3_64_intdigest(b" ".join(words).translate(_FOLD), seed) - 2**63, len(words), line))
    return out


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often, covered, end = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    chars = len(text.decode()) - sum(map(text.count, (_SPACES[i : i + 1] for i in range(6))))
    symbols = sum(map(text.count, (_SYMBOLS[i : i + 1] for i in range(8))))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeat_words(words)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, hosts = batch.column(0).to_pylist(), encoded(batch.column(1)), batch.column(2).to_pylist()
        for a, b in slices(texts):
            names, marks, owners = [], [], []
            for i in range(a, b):
                keys = {k for k, _, _ in line_keys(texts[i], None if hosts[i] is None else hosts[i].encode())}
                names += keys
                marks += [xxhash.xxh3_64_intdigest(texts[i]) - 2**63] * len(keys)
                owners += [ids[i]] * len(keys)
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(marks, pa.int64()), pa.array(owners, pa.int64())], names=["line", "content", "doc_id"])


def frequent_lines(docs: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """Lines ``(line, keeper)`` in more than ``limit`` distinct texts of a host, and the smallest doc_id with each."""
    found = docs.select("doc_id", "text", "source").mapInArrow(_lines, "line long, content long, doc_id long")
    by_text = found.groupBy("line", "content").agg(F.min("doc_id").alias("doc_id"))
    return by_text.groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where(F.col("n") > limit).select("line", "keeper")


def _judge(columns: list[str], sent):
    """Measures, verdict and cleaned text; the frequent lines come by ``sent`` or in the last column of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hosts = (batch.column(columns.index(c)) for c in ("doc_id", "text", "source"))
            ids, texts, hosts = ids.to_pylist(), encoded(texts), hosts.to_pylist()
            own = None if sent else batch.column(len(columns)).to_pylist()
            rows, cleaned = [], []
            for i, text in enumerate(texts):
                base = measures(text)
                frequent = sent.value if sent else dict.fromkeys(own[i] or ())
                kept_lines, lost = [], 0
                if frequent:
                    lost = sum(n for k, n, _ in line_keys(text, None if hosts[i] is None else hosts[i].encode()) if k in frequent and frequent[k] != (ids[i] if sent else ""))
                if lost:
                    host = None if hosts[i] is None else hosts[i].encode()
                    for line in text.split(b"\n"):
                        key = line_keys(line, host)
                        if not key or key[0][0] not in frequent or (sent and frequent[key[0][0]] == ids[i]):
                            kept_lines.append(line)
                    cleaned.append(b"\n".join(kept_lines).decode())
                else:
                    cleaned.append(text.decode())
                failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
                rows.append((*base, failed, lost, not failed and 2 * lost <= base[0]))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "kept", "clean_text"]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_()]
            measured = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
            yield pa.record_batch([*batch.columns[: len(columns)], *measured, pa.array(cleaned, pa.string())], names=[*columns, *names])

    return kernel


def quality_rules(docs: DataFrame, limit: int = LINE_LIMIT, most_sent: int = MOST_SENT) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with measures, verdict and the text without frequent lines.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_frequent_words, kept,
    clean_text``; input columns of these names are replaced. A document is a distinct text, so copies count once and
    don't make their own lines frequent. A frequent line stays in the document with the smallest doc_id of its host.
    Null texts count as empty and fail the base rules; null hosts form a host. Repeated rows are judged alike; a null
    doc_id is no first document. An empty table gives an empty result.
    """
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_frequent_words long, kept boolean, clean_text string"
    docs = docs.drop(*[x.split()[0] for x in added.split(", ")]).withColumns({"doc_id": F.col("doc_id").cast("long"), "source": F.col("source").cast("string")})
    frequent = cut(frequent_lines(docs, limit), "frequent")
    columns = docs.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", " + added
    if frequent.count() <= most_sent:
        sent = docs.sparkSession.sparkContext.broadcast({r["line"]: r["keeper"] for r in frequent.collect()})
        return docs.mapInArrow(_judge(columns, sent), schema)
    found = docs.select("doc_id", "text", "source").mapInArrow(_lines, "line long, content long, doc_id long").distinct()
    hits = found.withColumn("salt", F.pmod(F.col("content"), F.lit(16))).join(frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["line", "salt"])
    hits = hits.where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("doc_id").alias("_doc"), F.col("content").alias("_content")).agg(F.collect_set("line").alias("_lines"))
    marked = docs.mapInArrow(_contents(columns), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", _mark long")
    joined = marked.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_mark") == F.col("_content")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in columns], "_lines").mapInArrow(_judge(columns, None), schema)


def _contents(columns: list[str]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [xxhash.xxh3_64_intdigest(t) - 2**63 for t in encoded(batch.column(columns.index("text")))]
            yield pa.record_batch([*batch.columns, pa.array(marks, pa.int64())], names=[*columns, "_mark"])

    return kernel
