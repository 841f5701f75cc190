"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Method: each source's documents, in hash order, form one stream of words that is cut into blocks of equal size, and a
source needs as many slots of the mix as its target holds blocks. Slot i holds the golden-ratio point
frac((i + 1) * phi), which falls into one source's share of the cumulated slots; slots are ranked per source, and the
source's r-th slot takes its block r modulo the number of blocks, so a source that is too small is read again from its
start. Slots that the points give a source beyond its number stay out, those that they leave short follow at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.llm.text import WORD, encoded, slices, word_bounds
from atomweave.operators.ranking import running_sum
from atomweave.session import cut, shuffle_width

WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its words.
MOST_TIMES = 3
#: Words of a block: a 65,536th of the corpus, from 1 to 1024, and no more than a 64th of its source.
LARGEST_BLOCK, SLOTS, FEWEST_BLOCKS = 1024, 1 << 16, 64
GOLDEN = 0.6180339887498949
CELLS = 1024


def source_targets(sized: DataFrame) -> DataFrame:
    """``(source, rank, source_size, target)``: weights 5, 2, 1 by code point order, nulls last, share all words.

    No target is above ``MOST_TIMES`` times its source; what is cut off is shared anew by weight until none is above.
    That level is found in one pass: with sources ordered by cap per weight, a source is capped if giving every later
    source that much per weight would still not use up all words. Windows here have one row per source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_TIMES)
    ranked = ranked.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = Window.partitionBy(F.lit(0)).orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("used", F.sum("cap").over(upto) + F.col("ratio") * (F.col("weights") - F.sum("weight").over(upto)))
        .withColumn("capped", F.col("used") <= F.col("total"))
    )
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest.cast("double") / open_weight)
    return ranked.select("source", "rank", "source_size", "total", target.alias("target"))


def source_blocks(targets: DataFrame, block: int) -> DataFrame:
    """Adds ``blocks``, ``need`` (slots), and the blocks' sizes: the first ``longer`` have ``words`` + 1 words, the others ``words``."""
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / FEWEST_BLOCKS)))
    blocks = F.greatest(F.ceil(F.col("source_size") / most), F.lit(1)).cast("long")
    sized = targets.withColumn("blocks", blocks).withColumn("words", F.floor(F.col("source_size") / F.col("blocks")))
    need = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")), MOST_TIMES * F.col("blocks"))).otherwise(0)
    return sized.withColumn("longer", F.col("source_size") - F.col("words") * F.col("blocks")).withColumn("need", need.cast("long"))


def schedule(sources: DataFrame) -> DataFrame:
    """Slots ``(slot, rank, turn, block, pass)`` of the mix in order; ``turn`` numbers the slots of a source."""
    spark = sources.sparkSession
    n = sources.agg(F.sum("need")).first()[0] or 0
    before = F.sum("need").over(Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    shares = sources.where("need > 0").withColumn("lo", F.coalesce(before, F.lit(0)).cast("double") / F.lit(float(n or 1)))
    nxt = F.lead("lo").over(Window.partitionBy(F.lit(0)).orderBy("rank"))
    shares = shares.withColumn("hi", F.coalesce(nxt, F.lit(2.0)))
    cells = F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))
    within = shares.select("rank", "blocks", "need", "lo", "hi", F.explode(cells).alias("cell"))
    at = (F.col("slot") + 1).cast("double") * F.lit(GOLDEN)
    slots = spark.range(0, n, 1, shuffle_width(spark)).withColumnRenamed("id", "slot").withColumn("point", at - F.floor(at))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS)).withColumn("stretch", F.floor(F.col("slot") / 4096))
    placed = slots.join(within, "cell").where((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi")))
    placed = placed.select("slot", "rank", "blocks", "need", "stretch", F.lit(1).alias("one"))
    turned = running_sum(placed, "one", ["rank"], "stretch", [F.col("slot")], "turn").select("slot", "rank", "turn", "blocks", "need")
    turned = cut(turned.where(F.col("turn") < F.col("need")), "turned")
    have = turned.groupBy("rank").agg(F.count("*").alias("have"))
    short = shares.select("rank", "blocks", "need", "lo").join(have, "rank", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    short = short.where("have < need").select("rank", "blocks", "need", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("turn"))
    late = short.select((F.lit(n) + F.col("turn") * (1 << 20) + F.col("rank")).alias("slot"), "rank", "turn", "blocks", "need")
    every = turned.unionByName(late)
    return every.select("slot", "rank", "turn", (F.col("turn") % F.col("blocks")).alias("block"), F.floor(F.col("turn") / F.col("blocks")).alias("pass"))


def _block_of(word: Column) -> Column:
    ahead = F.col("longer") * (F.col("words") + 1)
    return F.when(word < ahead, F.floor(word / (F.col("words") + 1))).otherwise(F.col("longer") + F.floor((word - ahead) / F.greatest(F.col("words"), F.lit(1))))


def _block_start(block: Column) -> Column:
    return block * F.col("words") + F.least(block, F.col("longer"))


def mix_sources(docs: DataFrame, mark: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mix ``docs(doc_id, text, source, ...)``: documents with ``taken``, the slots, and the slots' parts of documents.

    The first table has one row per input row: ``row`` (its number), ``doc_id, source, size, source_size, target,
    taken, mark``. ``taken`` counts words with repeats and is at most three times ``size``. The third table holds
    ``(slot, pass, block, row, mark, doc_id, first_word, words)``. ``mark`` is any value of a row that its parts shall
    carry. Null texts have size 0 and give nothing; the null source is the last one. Order and schedule depend on
    doc_ids and sizes alone, so reruns agree; rows of equal doc_id and size can exchange their parts. An empty table, or
    one without words, gives takes of 0. Other columns are ignored.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    mark = F.lit(0).cast("long") if mark is None else mark
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), mark.alias("mark"))
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    targets = cut(source_targets(sized), "targets")
    total = targets.agg(F.max("total")).first()[0] or 0
    targets = cut(source_blocks(targets, max(1, min(LARGEST_BLOCK, total // SLOTS))), "blocks")
    slots = cut(schedule(targets), "slots")

    named = targets.select(F.col("source").alias("_source"), "rank", "source_size", "target", "words", "longer")
    ranked = sized.join(F.broadcast(named) if targets.count() <= 10_000 else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    streamed = ranked.where("size > 0").withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    streamed = cut(running_sum(streamed, "size", ["rank"], "part", [F.col("key"), F.col("size"), F.col("row")], "start").drop("key", "part"), "streamed")
    blocks = F.sequence(_block_of(F.col("start")), _block_of(F.col("start") + F.col("size") - 1))
    pieces = streamed.select("row", "mark", "doc_id", "rank", "start", "size", "words", "longer", F.explode(blocks).alias("block"))
    first = F.greatest(F.col("start"), _block_start(F.col("block")))
    words = F.least(F.col("start") + F.col("size"), _block_start(F.col("block") + 1)) - first
    pieces = pieces.select("row", "mark", "doc_id", "rank", "block", (first - F.col("start")).alias("first_word"), words.alias("n"))
    parts = slots.join(pieces, ["rank", "block"]).select("slot", "pass", "block", "row", "mark", "doc_id", "first_word", F.col("n").alias("words"))

    uses = slots.groupBy("rank", "block").agg(F.count("*").alias("uses"))
    taken = pieces.join(uses, ["rank", "block"]).groupBy("row").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    mixed = ranked.join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return mixed.select("row", "doc_id", "source", "size", "source_size", "target", "taken", "mark"), slots, parts


def _cut_words(columns: list[str]):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = columns.index("text")
        for batch in batches:
            texts, firsts, counts = encoded(batch.column(k)), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist()
            for a, b in slices(texts):
                out = []
                for text, first, n in zip(texts[a:b], firsts[a:b], counts[a:b]):
                    starts, ends = word_bounds(np.frombuffer(text, np.uint8))
                    whole = first == 0 and n == len(starts)
                    out.append((text if whole else text[starts[first] : ends[first + n - 1]]).decode())
                part = batch.slice(a, b - a)
                yield pa.record_batch([pa.array(out, pa.string()) if i == k else part.column(i) for i in range(len(columns))], names=columns)

    return kernel


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as rows of ``docs``: each reading of a document in one row, with the words that the mix takes of it.

    Neighbouring blocks that are taken in one pass give one text with its white space as it stands, so documents that
    are taken whole stay whole; of the others the parts between taken blocks are left out. Documents without words give
    nothing. Repeated rows are read each for itself.
    """
    mark = F.xxhash64(*docs.columns)
    _, _, parts = mix_sources(docs, mark)
    order = Window.partitionBy("row", "pass").orderBy("block")
    runs = parts.withColumn("run", F.col("block") - F.row_number().over(order))
    runs = runs.groupBy("row", "mark", "pass", "run").agg(F.min("first_word").alias("_first"), F.sum("words").alias("_words"))
    runs = runs.select(F.col("mark").alias("_mark"), "_first", "_words")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # names can't clash in there
    joined = docs.select(row, mark.alias("_mark")).dropDuplicates(["_mark"]).join(runs, "_mark")
    joined = joined.select(*[F.col("_row").getField(c).alias(f"c{k}") for k, c in enumerate(docs.columns)], "_first", "_words")
    return joined.mapInArrow(_cut_words(docs.columns), docs.schema)
