"""Line dedup across documents: an exact set-similarity join of lines, in DataFrame functions alone.

Method: a line's tokens are its distinct word 5-grams (a shorter line's whole sequence), ordered by rarity. Lines whose
token sets have a Jaccard similarity of 3/4 or more match; a line that matches an earlier one is removed.

1. Tokens are counted in 65,536 hash buckets over all lines; the buckets' ranks give the common order, rare ones first.
2. Lines of equal token sets form a class with its first line; all other lines of the class are removed.
3. Prefix tokens of classes meet. Each class is first held against the earliest class at each of its tokens; only
   classes that match none of those are held against all other earlier ones. Length and positional filters apply before
   a pair is formed, and each distinct pair is verified once on the full token sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atomweave.session import cut

WIDTH = 5
#: Lines of fewer words, so those without any, are left alone.
FEWEST_WORDS = 1
BUCKETS = 1 << 16
#: A bucket with over this share of all tokens is hot: its tokens' rows are summed up before they are shuffled.
HOT_SHARE = 1 / 2048
_LAST = 2**63 - 1
#: White space but for the blank and the line feed.
OTHER_BLANKS = "\t\x0b\x0c\r"
PLACE = ["doc", "mark", "line_no"]


def _plain(text: Column) -> Column:
    """The text in lower case with every white space but line feeds as a blank, so that it can be split without patterns."""
    text = F.lower(text)
    for c in OTHER_BLANKS:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _hashes(line: Column) -> Column:
    """A hash of each word of a line without white space but blanks."""
    return F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w))


def _n_grams(width: int, fewest: int) -> Column:
    n = F.size("hashes")
    return F.when(n >= F.lit(max(1, fewest)), F.greatest(n - (width - 1), F.lit(1))).otherwise(0)


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc, mark, line_no, hashes)`` of all lines. Mark tells texts of one doc_id apart.

    Lines aren't filtered by their words: Spark would split them twice for that.
    """
    lines = docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("mark"), F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line")
    )
    return lines.select(*PLACE, _hashes(F.col("line")).alias("hashes"))


def _grams(width: int, fewest: int) -> Column:
    """The grams of ``hashes`` in order; a gram comes as often as it occurs. Its hash is that of its words' hashes in turn."""
    n = F.size("hashes")
    shifted = [F.slice("hashes", F.lit(k + 1), F.greatest(n, F.lit(1))).alias(f"w{k}") for k in range(width)]
    grams = F.transform(F.arrays_zip(*shifted), lambda words: F.xxhash64(words))
    return F.slice(grams, F.lit(1), _n_grams(width, fewest))


def _bucket(token: Column) -> Column:
    return F.shiftrightunsigned(token, 48).cast("int")


def _ranks(lines: DataFrame, width: int, fewest: int) -> tuple[Column, int]:
    """The rank by rarity of each token bucket, as a constant, and the rank from which buckets are hot.

    Its size doesn't depend on the input's. A row per gram and plain columns, not arrays of grams: this is compiled code.
    """
    last = F.greatest(F.size("hashes") - width, F.lit(0))
    each = lines.select("hashes", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    gram = F.xxhash64(*[F.get("hashes", F.col("i") + j) for j in range(width)])
    each = each.select(_bucket(gram).alias("bucket"), F.when(F.size("hashes") >= max(1, fewest), 1).alias("counts"))
    counts = each.groupBy("bucket").agg(F.count("counts").alias("n"))
    every = lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["n"])
    ranked = every.withColumn("rank", (F.row_number().over(Window.orderBy("n", "bucket")) - 1).cast("long"))
    one = ranked.agg(F.sort_array(F.collect_list(F.struct("bucket", "rank", "n"))).alias("all"), F.sum("n").alias("total"))
    hot = F.size(F.filter("all", lambda x: x["n"] > F.lit(HOT_SHARE) * F.col("total")))
    found = one.select(F.array_join(F.transform("all", lambda x: x["rank"].cast("string")), ",").alias("ranks"), (BUCKETS - hot).alias("hot")).first()
    return F.split(F.lit(found["ranks"]), ",").cast("array<long>"), found["hot"]


def _ordered(grams: Column, ranks: Column) -> Column:
    """Distinct tokens as codes that sort by rarity: the bucket's rank above, the hash's other bits below."""
    code = F.transform(F.array_distinct(grams), lambda h: F.shiftleft(F.get(ranks, _bucket(h)), 47).bitwiseOR(h.bitwiseAND(F.lit((1 << 47) - 1))))
    return F.sort_array(code)


def _near(n: str, pos: str, m: str, q: str) -> Column:
    """Length and positional filters of two prefix rows."""
    n, pos, m, q = F.col(n), F.col(pos), F.col(m), F.col(q)
    return (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (7 * F.least(n - pos, m - q) >= 3 * (n + m))


def _flags(keys: DataFrame) -> DataFrame:
    """One row with a bit map of 2**22 bits, set where a row of ``keys`` hashes: half a megabyte for any input."""
    h = F.xxhash64(*keys.columns)
    words = keys.select(_bucket(h).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 42).bitwiseAND(63).cast("int")).alias("bit"))
    words = words.groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("slot")).join(words, "slot", "left").fillna(0, ["bits"])
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"]).alias("map"))


def _flagged(flags: DataFrame, *key: Column) -> Column:
    h = F.xxhash64(*key)
    word = F.get(flags.scalar(), _bucket(h))
    bit = F.shiftrightunsigned(h, 42).bitwiseAND(63).cast("int")
    return F.call_function("shiftrightunsigned", word, bit).bitwiseAND(1) == 1


def _matching(docs: DataFrame, pairs: DataFrame, classes: DataFrame, width: int, fewest: int, name: str) -> DataFrame:
    """Of distinct ``pairs(p, q)`` of classes those whose token sets match, with the one that comes ``later`` as ``cls``.

    The classes' first lines are read again; bit maps drop most other documents and lines before the join.
    """
    used = pairs.select(F.explode(F.array("p", "q")).alias("cls")).distinct().join(classes.select("cls", *PLACE), "cls")
    used = cut(used, f"{name}-used")
    by_doc, by_line = cut(_flags(used.select("doc")), f"{name}-docs"), cut(_flags(used.select(*PLACE)), f"{name}-lines")
    some = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "text").where(_flagged(by_doc, F.col("doc")))
    some = some.select("doc", F.xxhash64("text").alias("mark"), F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"))
    some = some.where(_flagged(by_line, *[F.col(c) for c in PLACE])).join(used, PLACE).select("cls", *PLACE, _hashes(F.col("line")).alias("hashes"))
    sets = cut(some.dropDuplicates(["cls"]).select("cls", F.struct(*PLACE).alias("place"), F.array_distinct(_grams(width, fewest)).alias("grams")), f"{name}-sets")
    for x in "pq":
        pairs = pairs.join(sets.select(F.col("cls").alias(x), F.col("place").alias(f"{x}_place"), F.col("grams").alias(f"{x}_grams")), x)
    shared = F.size(F.array_intersect("p_grams", "q_grams"))
    union = F.size("p_grams") + F.size("q_grams") - shared
    return pairs.where(100 * shared >= 75 * union).select(F.when(F.col("p_place") > F.col("q_place"), F.col("p")).otherwise(F.col("q")).alias("cls"))


def _met(rows: DataFrame, hot: int) -> DataFrame:
    """Prefix rows ``(token, doc, cls, n, pos)`` whose token several classes have, with the token's earliest class as hub.

    Rows of hot buckets get their hub from a partial aggregate and a join, which Spark can split; the others by a sort.
    """
    unpacked = lambda c, x: [F.shiftright(c, 32).cast("int").alias(f"{x}n"), F.col(c).bitwiseAND((1 << 32) - 1).cast("int").alias(f"{x}pos")]
    is_hot = F.shiftrightunsigned("token", 47) >= hot
    group = Window.partitionBy("token")
    first = F.first(F.struct("cls", "np")).over(group.orderBy("doc", "cls"))
    cold = rows.where(~is_hot).withColumn("hub", first).withColumn("lo", F.min("cls").over(group)).withColumn("hi", F.max("cls").over(group))
    cold = cold.where("lo < hi").select("token", "doc", "cls", "np", F.col("hub.cls").alias("hub"), F.col("hub.np").alias("hub_np"))
    few = rows.where(is_hot)
    hubs = few.groupBy("token").agg(F.min(F.struct("doc", "cls", "np")).alias("hub"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi")
    few = few.join(hubs.select("token", F.col("hub.cls").alias("hub"), F.col("hub.np").alias("hub_np")), "token")
    every = cold.unionByName(few.select("token", "doc", "cls", "np", "hub", "hub_np"))
    return every.select("token", "doc", "cls", *unpacked("np", ""), "hub", *unpacked("hub_np", "hub_"))


def matched_lines(docs: DataFrame, width: int = WIDTH, fewest: int = FEWEST_WORDS) -> DataFrame:
    """Lines of ``docs(doc_id, text)`` that match an earlier line: ``(doc_id, mark, line_no)``, mark = xxhash64(text).

    Earlier means a smaller doc_id (null last), then a smaller text hash, then a smaller line number. Matching is judged
    on the input: the earlier line may itself be removed. Identical rows count as one document. Null and empty texts
    have no lines to remove; very long lines are compared whole. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranks, hot = _ranks(_lines(docs), width, fewest)
    lines = _lines(docs).select(*PLACE, _ordered(_grams(width, fewest), ranks).alias("codes"))
    n = F.size("codes")
    prefix = F.slice("codes", F.lit(1), n - F.floor((3 * n + 3) / 4).cast("int") + 1)
    lines = cut(lines.select(*PLACE, F.xxhash64("codes").alias("cls"), n.alias("n"), prefix.alias("prefix")), "lines").where("n > 0")

    classes = lines.groupBy("cls").agg(F.min(F.struct(*PLACE, "n", "prefix")).alias("f")).select("cls", "f.*")
    classes = cut(classes, "classes")
    # Small numbers in few columns: these rows are the bulk of what is shuffled.
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    rows = classes.select("cls", "doc", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "doc", "cls", packed.alias("np"))
    met = cut(_met(rows, hot), "met")

    near = met.where(F.col("cls") != F.col("hub")).where(_near("n", "pos", "hub_n", "hub_pos"))
    pairs = cut(near.select(F.least("cls", "hub").alias("p"), F.greatest("cls", "hub").alias("q")).distinct(), "pairs")
    done = cut(_matching(docs, pairs, classes, width, fewest, "hubs").distinct(), "done")

    side = ["token", "doc", "cls", "n", "pos"]
    x = met.join(done, "cls", "left_anti").select(*[F.col(c).alias(f"x_{c}") for c in side])
    y = met.select(*[F.col(c).alias(f"y_{c}") for c in side])
    rest = x.join(y, (F.col("x_token") == F.col("y_token")) & (F.col("x_cls") != F.col("y_cls")) & (F.col("y_doc") <= F.col("x_doc")) & _near("x_n", "x_pos", "y_n", "y_pos"))
    rest = rest.select(F.least("x_cls", "y_cls").alias("p"), F.greatest("x_cls", "y_cls").alias("q")).distinct()
    rest = cut(rest.join(pairs, ["p", "q"], "left_anti"), "rest")
    more = _matching(docs, rest, classes, width, fewest, "rest")

    later = done.unionAll(more).distinct().withColumn("similar", F.lit(True))
    judged = classes.join(later, "cls", "left").select("cls", *[F.col(c).alias(f"first_{c}") for c in PLACE], "similar")
    judged = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(3))))
    salted = lines.select(*PLACE, "cls").withColumn("salt", F.pmod("mark", F.lit(4)).cast("int"))
    found = salted.join(judged, ["cls", "salt"])
    own = (F.col("doc") == F.col("first_doc")) & (F.col("mark") == F.col("first_mark")) & (F.col("line_no") == F.col("first_line_no"))
    removed = found.where(~own | F.coalesce("similar", F.lit(False))).select(*PLACE).distinct()
    return removed.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "mark", "line_no")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with later matches of lines removed from ``text``; other columns stay.

    Adds ``n_lines, n_removed`` and ``removed_lines`` (ascending numbers); a null text stays null with no lines.
    """
    removed = matched_lines(docs).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    removed = removed.select(F.coalesce("doc_id", F.lit(_LAST)).alias("_doc"), F.col("mark").alias("_mark"), "gone")
    # The row travels as one column, so that its names can't clash with those used here.
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_lines")]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row")
    joined = docs.select(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_doc"), F.xxhash64("text").alias("_mark")).join(removed, ["_doc", "_mark"], "left")
    text = F.col("_row.text")
    gone = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    numbered = F.transform(F.split(text, "\n"), lambda line, i: F.when(~F.array_contains(gone, i), line))
    left = F.when(F.size(gone) > 0, F.array_join(numbered, "\n")).otherwise(text)
    return joined.select(
        *[left.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in kept],
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"),
        F.size(gone).alias("n_removed"),
        gone.alias("removed_lines"),
    )
