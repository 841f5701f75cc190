"""Source divergence, ranked search and repeated passages against brute force: nulls, ties, copies, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import SCHEMA, WORDS, corpus, make

LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def found(pattern, text):
    return [m.translate(LOWER) for m in pattern.findall(text or "")]


def divergences(rows, least, most):
    """(lang, source, part, item, value, rank) of rows (lang, source, text)."""
    rows = [(lang or "", source or "", found(LETTERS, text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == lang]
        df = Counter(t for r in mine for t in set(r[2]))
        kept = [t for t, n in df.items() if n >= least]
        sources = sorted({r[1] for r in mine})
        n = {s: Counter(t for r in mine if r[1] == s for t in r[2]) for s in sources}
        size = {s: sum(n[s][t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 5 * len(kept))
        p = {s: {t: share(n[s][t], size[s]) for t in kept} for s in sources}
        q = {t: share(sum(n[s][t] for s in sources), sum(size.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            marks = [(t, p[s][t] - q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, len(pairs)), ("term", marks, most)):
                for k, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]):
                    out.append((lang, s, part, item, v, k + 1))
    return sorted(out)


def test_source_divergence(spark):
    from atomweave.llm.divergence import source_divergence

    rng = random.Random(3)
    pool = WORDS[:30] + ["É", "é", "漢字", "don't", "A1b", "_x"]
    texts = [" ".join(rng.choices(pool[i % 9 : i % 9 + 20], k=rng.randint(0, 40))) for i in range(80)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "", "é", None][i % 5], None, "x", "y", 7) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, None, "en", "a", None, "x", "y", 7), (5, "solo words here", "fr", "only", None, "x", "y", 7), (6, "", "en", "z", None, "x", "y", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for least, most in ((4, 3), (1, 50), (10**6, 5)):
        got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in source_divergence(docs.repartition(5), least, most).collect())
        assert got == divergences([(r[2], r[3], r[1]) for r in rows], least, most)
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_divergence_shares_are_exact_beyond_64_bits():
    from atomweave.llm.divergence import _shares

    counts, total = np.array([[10**13, 3], [7 * 10**12, 0]]), np.array([3 * 10**13, 11])
    want = [[1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(row, total)] for row in counts]
    assert _shares(counts, total).tolist() == want


def searched(texts, items, most):
    """(item, rank, doc, score) of texts (doc, text), None the largest doc."""
    docs = [(d, found(ALNUM, t)) for d, t in texts]
    n_docs, length = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df, out = Counter(t for _, w in docs for t in set(w)), []
    for item, text in items:
        scored = []
        for d, w in docs:
            tf, score = Counter(w), 0
            for t in set(found(ALNUM, text)) & tf.keys():
                m = 50 + 50 * len(w) * n_docs // length
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
            if score > 0:
                scored.append((-score, 2**63 if d is None else d))
        for k, (score, d) in enumerate(sorted(scored)[:most]):
            out.append((item, k + 1, None if d == 2**63 else d, -score))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels,query_terms", [(6, 100_000), (2, 20)])
def test_ranked_search(spark, levels, query_terms):
    from atomweave.llm.lexical import ranked_search

    rng = random.Random(5)
    texts = corpus(4, 60)
    texts += [(1000 + i, "w1 w2 w3") for i in range(9)] + [(2000, "W1 é漢 x_y " * 400)]
    items = [(i, " ".join(rng.choices(WORDS[:60], k=rng.randint(1, 12)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "W1, é漢!"), (54, "w1 w2"), (54, "w1 w2"), (None, "w3")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, cluster string")
    got = ranked_search(make(spark, texts).repartition(3), table, 7, levels, query_terms)
    want = searched(texts, list(dict.fromkeys(items)), 7)
    assert sorted([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()], key=str) == want
    assert ranked_search(make(spark, []), table).count() == 0
    assert ranked_search(make(spark, texts), table.limit(0)).count() == 0


def test_bisection_separates_topics():
    from atomweave.llm.lexical import bisection

    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12) + 40 * (i % 2)) for i in range(200)]
    begin = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    weights, limits = bisection(np.concatenate(rows), begin, 80, 1)
    side = [weights[1][r].sum() < limits[1] for r in rows]
    assert sum(side[i] != side[i % 2] for i in range(200)) <= 2


def passages(texts, length=35):
    """(doc, words, removed, kept sha256) of each text."""
    words = [(t or "").encode().split() for _, t in texts]
    at = defaultdict(list)
    for k, w in enumerate(words):
        for i in range(len(w) - length + 1):
            at[tuple(w[i : i + length])].append((k, i))
    gone = [set() for _ in words]
    for places in at.values():
        for k, i in places if len(places) > 1 else []:
            gone[k].update(range(i, i + length))
    kept = [b" ".join(x for i, x in enumerate(w) if i not in g) for w, g in zip(words, gone)]
    return sorted([(d, len(w), len(g), hashlib.sha256(x).hexdigest()) for (d, _), w, g, x in zip(texts, words, gone, kept)], key=str)


def repeated(seed=9):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(WORDS, k=rng.randint(30, 60))) for _ in range(6)]
    texts = []
    for i in range(50):
        parts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 50)))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), " ".join(rng.choices(WORDS, k=rng.randint(0, 30)))]
        texts.append((i, "\n".join(parts)))
    texts += [(60, "a b " * 60), (61, "a b " * 25), (62, "z " * 34), (63, "z " * 35), (64, "q r s " * 14), (65, shared[0]), (66, shared[0].replace(" ", "\t ")), (67, shared[1]), (67, shared[2]), (None, shared[3]), (None, None), (68, ""), (69, " ".join(WORDS * 12))]
    return texts + [texts[3], texts[3]]


@pytest.mark.parametrize("told,many,indexed", [(16, 4096, 1 << 18), (1, 2, 1 << 18), (16, 4096, 3), (2, 6, 20)])
def test_repeated_passages(spark, told, many, indexed):
    """The usual route, frequent anchors by single windows, and blocks that pass their windows on give the same."""
    from atomweave.llm.relative_parse import repeated_passages

    texts = repeated()
    got = repeated_passages(make(spark, texts).repartition(3), told=told, many=many, indexed=indexed)
    assert sorted([tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str) == passages(texts)
    assert repeated_passages(make(spark, [])).count() == 0


def test_kept_words_are_texts(spark):
    from atomweave.llm.relative_parse import repeated_passages

    shared = " ".join(WORDS[:40])
    got = {r.doc_id: r.kept for r in repeated_passages(make(spark, [(1, f"one {shared} two"), (2, f"{shared} three"), (3, "four five")])).collect()}
    assert got == {1: "one two", 2: "three", 3: None}


def test_factors_cover_every_window_that_stands_elsewhere():
    from atomweave.llm.relative_parse import factors

    rng = random.Random(2)
    for _ in range(200):
        stretches = [[rng.randint(0, 6) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        count = Counter(w for s in stretches for w in s)
        covered = {(k, i + j) for k, i, m in factors(stretches, [False] * len(stretches)) for j in range(m)}
        assert covered == {(k, i) for k, s in enumerate(stretches) for i, w in enumerate(s) if count[w] > 1}


def test_fingerprints_of_two_texts_share_their_draws(spark):
    """Texts alone and beside another have equal fingerprints, and what both share is drawn for once."""
    from pyspark.sql import functions as F

    from atomweave.llm.fingerprints import EMPTY, fingerprints

    words = [f"w{i * 7919 % 5003}" for i in range(400)]
    rows = [(0, " ".join(words), " ".join(words[:200] + words[:200])), (1, "", "one two"), (2, None, " ".join(words)), (3, "a b", None), (4, "x " * 40, "x " * 30)]
    texts = spark.createDataFrame(rows, "id long, a string, b string")
    both = {r.id: r for r in fingerprints(texts, ["id"], ["a", "b"]).collect()}
    for v in "ab":
        alone = {r.id: r[f"fp_{v}"] for r in fingerprints(texts, ["id"], [v]).collect()}
        assert alone == {k: r[f"fp_{v}"] for k, r in both.items()}
    assert both[1].fp_a == both[2].fp_a == both[3].fp_b and set(both[1].fp_a) == set(EMPTY) and both[2].fp_b == both[0].fp_a
    same = texts.where("id = 0").select("id", "a", F.col("a").alias("b"))
    plan = fingerprints(same, ["id"], ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "array_except" in plan
