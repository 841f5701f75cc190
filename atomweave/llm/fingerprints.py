"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

Method: a text's terms are its word 5-grams, weighted by their counts S. Each of ``DRAWS`` samples gives every term two
Gamma(2, 1) variates r, c and a uniform b that depend on the term alone, and takes the term with the smallest
ln a = ln c - r (t - b + 1), where t = floor(ln S / r + b). Two texts share a sample with the probability of their
generalised Jaccard similarity. ln a depends on term and t alone, so the smallest value names the sample.

The likeness is the share of equal slots of all ``DRAWS``: an estimate of generalised Jaccard similarity with a standard
error of at most 0.5 / sqrt(DRAWS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.session import shuffle_width

WIDTH, DRAWS = 5, 40
EMPTY = "----"
_LEAST = -(2**63)


def weighted_terms(text: Column, width: int = WIDTH) -> list:
    """Projections, to be applied one after the other, that end in ``ones``, the terms found once, and ``more array<struct<h, w>>``, the others."""
    text = F.lower(text)
    for c in "\n\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    words = F.transform(F.array_remove(F.split(text, " "), ""), lambda w: F.xxhash64(w))
    n = F.size("words")
    shifted = [F.slice("words", F.lit(j + 1), F.greatest(n, F.lit(1))).alias(f"w{j}") for j in range(width)]
    grams = F.slice(F.transform(F.arrays_zip(*shifted), lambda g: F.xxhash64(g)), F.lit(1), F.greatest(n - (width - 1), F.least(n, F.lit(1))))
    last = F.size("sorted") - 1
    runs = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(F.col("sorted"), i) != F.get(F.col("sorted"), i - 1)))
    counted = F.transform(F.col("starts"), lambda p, j: F.struct(F.get(F.col("sorted"), p).alias("h"), (F.coalesce(F.get(F.col("starts"), j + 1), F.size("sorted")) - p).alias("w")))
    repeats = F.size("once") < F.size("grams")
    return [
        ("words", words),
        ("grams", grams),
        ("once", F.array_distinct("grams")),
        ("sorted", F.when(repeats, F.sort_array("grams"))),
        ("starts", F.when(repeats, runs)),
        ("terms", F.when(repeats, counted)),
        ("ones", F.when(repeats, F.transform(F.filter("terms", lambda x: x["w"] == 1), lambda x: x["h"])).otherwise(F.col("once"))),
        ("more", F.when(repeats, F.filter("terms", lambda x: x["w"] > 1))),
    ]


def _whole(bits: Column, shift: int) -> Column:
    """A whole number from 1 to 2**21."""
    return (F.shiftrightunsigned(bits, shift) if shift else bits).bitwiseAND((1 << 21) - 1) + 1


def _gamma(a: Column, b: Column) -> Column:
    """Gamma(2, 1) from two such numbers; their product is exact, so it is scaled once."""
    return F.greatest(-F.log((a * b).cast("double") * 2.0**-42), F.lit(1e-6))


def samples(h: Column, log_w: Column, draws: int = DRAWS) -> list[Column]:
    """ln a of a term in each draw, given the logarithm of its weight."""
    out = []
    for k in range(draws):
        one, two = F.xxhash64(h, F.lit(2 * k)), F.xxhash64(h, F.lit(2 * k + 1))
        r, c = _gamma(_whole(one, 0), _whole(one, 21)), _gamma(_whole(one, 42), _whole(two, 0))
        b = _whole(two, 21).cast("double") * 2.0**-21
        t = F.when(log_w == 0.0, F.lit(0.0)).otherwise(F.floor(log_w / r + b).cast("double"))
        out.append(F.log(c) - r * (t - b + 1.0))
    return out


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slots of two fingerprints; texts without terms are like each other only."""
    slots = F.sequence(F.lit(0), F.lit(DRAWS - 1))
    slot = lambda s, i: s.substr(i * 4 + 1, F.lit(4))
    return F.size(F.filter(slots, lambda i: slot(a, i) == slot(b, i))) / F.lit(DRAWS)


def fingerprints(texts: DataFrame, keys: list[str], variants: list[str]) -> DataFrame:
    """``keys`` and ``fp_<variant>`` for each text column named in ``variants``; null texts count as without terms.

    The smallest value over the terms of a text is the least of those over the parts it is made of, so what two texts share
    costs its draws once.
    If ``texts`` is partitioned by the first key, nothing is shuffled.
    """
    rows = texts.select(*keys, *[F.col(v).alias(f"body{i}") for i, v in enumerate(variants)])
    for i in range(len(variants)):
        steps = weighted_terms(F.col(f"body{i}"))
        for name, column in steps:
            rows = rows.withColumn(name, column)
        rows = rows.withColumn(f"ones{i}", F.coalesce("ones", F.expr("cast(array() as array<bigint>)"))).withColumnRenamed("more", f"more{i}").drop(*[name for name, _ in steps])
    # terms found once in both of the first two texts are drawn for once: an edited text has half of them from the other
    parts = [((i,), F.col(f"ones{i}")) for i in range(len(variants))]
    if len(variants) > 1:
        rows = rows.withColumn("both", F.array_intersect("ones0", "ones1"))
        parts[:2] = [((0, 1), F.col("both")), ((0,), F.array_except("ones0", "both")), ((1,), F.array_except("ones1", "both"))]
    part = lambda k, h, w: F.struct(F.lit(k).alias("part"), h.alias("h"), w.alias("w"))
    lists = [F.transform(ones, lambda h: part(k, h, F.lit(1))) for k, (_, ones) in enumerate(parts)]  # noqa: B023
    for i in range(len(variants)):
        own = next(k for k, (members, _) in enumerate(parts) if members == (i,))
        lists.append(F.coalesce(F.transform(f"more{i}", lambda x: part(own, x["h"], x["w"])), F.expr("cast(array() as array<struct<part:int,h:bigint,w:int>>)")))  # noqa: B023
    rows = rows.select(*keys, F.inline_outer(F.concat(*lists))).select(*keys, "part", "h", F.when(F.col("w") == 1, 0.0).otherwise(F.log(F.col("w").cast("double"))).alias("log_w"))
    best = rows.groupBy(*keys, "part").agg(*[F.min(a).alias(f"a{k}") for k, a in enumerate(samples(F.col("h"), F.col("log_w")))])
    least = F.struct(*[f"a{k}" for k in range(DRAWS)])
    wide = best.groupBy(*keys).agg(*[F.max(F.when(F.col("part") == k, least)).alias(f"p{k}") for k in range(len(parts))])
    told = []
    for i, v in enumerate(variants):
        mine = [k for k, (members, _) in enumerate(parts) if i in members]
        slot = lambda k, mine=mine: F.least(*[F.col(f"p{p}.a{k}") for p in mine]) if len(mine) > 1 else F.col(f"p{mine[0]}.a{k}")
        code = F.concat(*[F.lpad(F.lower(F.hex(F.xxhash64(slot(k)).bitwiseAND(0xFFFF))), 4, "0") for k in range(DRAWS)])
        told.append(F.when(slot(0).isNull(), F.lit(EMPTY * DRAWS)).otherwise(code).alias(f"fp_{v}"))
    return wide.select(*keys, *told)


def with_next(docs: DataFrame) -> DataFrame:
    """``(bucket, seq, guest, id, text, next)``: each document and the text after it in descending doc_id, first after last.

    Documents are dealt into buckets of consecutive ids whose upper bounds are quantiles of the ids, a constant number of
    values on the driver. A bound's document is also a guest of the bucket above, whose last row it follows.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = shuffle_width(docs.sparkSession)
    found = docs.agg(F.percentile_approx("id", [(i + 1) / n for i in range(n)], 20 * n), F.max("id")).first()
    bounds = sorted({*(found[0] or []), *([found[1]] if found[1] is not None else [])})
    upper = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    bucket = F.size(F.filter(upper, lambda b: b < F.col("id"))) if bounds else F.lit(0)
    after = F.when(F.col("id") == (bounds[-1] if bounds else 0), 0).otherwise(F.col("bucket") + 1)
    is_bound = F.array_contains(upper, F.col("id")) if bounds else F.lit(False)
    placed = docs.withColumn("bucket", bucket).withColumn("at", F.explode(F.when(is_bound, F.array(F.struct("bucket", F.lit(0).alias("guest")), F.struct(after.alias("bucket"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct("bucket", F.lit(0).alias("guest"))))))
    placed = placed.select("at.bucket", "at.guest", "id", "text").repartitionByRange(n, "bucket")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("id"), "text")
    return placed.withColumn("seq", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of its edited texts, one row per input row.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The edited text has its
    last floor(n_chars / 2) code points replaced by the first as many of the next document in descending doc_id (after
    the last one: the first; null ids come last, equal ids by text). Null texts count as empty; a text without words has
    empty slots only and is like another such text alone. Other columns are ignored; an empty table gives an empty result.
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("guest") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)))
    rows = rows.select("bucket", "seq", "guest", "id", "text", edited.alias("edited"))
    prints = fingerprints(rows, ["bucket", "seq"], ["text", "edited"])
    about = rows.select("bucket", "seq", "guest", "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    both = about.join(prints, ["bucket", "seq"])
    after = F.lead("fp_text").over(Window.partitionBy("bucket").orderBy("seq"))
    both = both.withColumn("fp_next", after).where("guest = 0")
    return both.select(
        F.when(F.col("id") != _LEAST, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        F.col("fp_text").alias("fingerprint"),
        F.col("fp_edited").alias("edited_fingerprint"),
        likeness(F.col("fp_text"), F.col("fp_edited")).alias("near_edited"),
        likeness(F.col("fp_text"), F.col("fp_next")).alias("near_next"),
    )
