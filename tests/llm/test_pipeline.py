"""Each stage of the pipeline on rows with nulls, empty texts, copies, ties and clashing columns, and the whole run."""

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _mark long, row string, cls string, token long, block long"
STAGES = dict(corpus_pipeline.STAGES)


def rows(n=60, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(8, 20))) for _ in range(8)) for _ in range(n)]
    out = [(i, t, "en", "abc"[i % 3] if i % 7 else None, len(t), 5, "x", None, 1, 2) for i, t in enumerate(texts)]
    near = texts[1].replace(" ", " other ", 1)
    extra = [(900, near), (901, None), (902, ""), (903, "too short"), (None, texts[5] + " end"), (904, texts[2]), (905, texts[2]), (906, " ".join(rng.choices(words, k=30_000)))]
    out += [(i, t, None, "a", None, None, None, "y", None, None) for i, t in extra]
    return out + [out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5)


def words(text):
    return (text or "").encode().split()


def test_quality_keeps_clean_documents(spark, docs):
    got = STAGES["quality rules"](spark, docs, "")
    assert got.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert left == Counter((r[0], r[1]) for r in rows() if len(words(r[1])) >= 50)


def test_lines_that_recur_go(spark, docs):
    got = STAGES["line dedup"](spark, docs, "").collect()
    kept = {r.doc_id: r.text for r in got}
    assert 901 not in kept and 902 not in kept and 904 not in kept and 905 not in kept and len([r for r in got if r.doc_id == 3]) == 3
    assert all(kept[i] == t for i, t, *_ in rows() if i is not None and i < 60) and kept[903] == "too short"


def test_one_document_of_a_group_stays(spark, docs):
    got = Counter(r.doc_id for r in STAGES["n-gram jaccard join"](spark, docs, "").collect())
    assert got == Counter(r[0] for r in rows() if r[0] not in (900, 904, 905))


def test_the_mix_meets_its_targets_with_words_of_the_documents(spark, docs):
    got = STAGES["mixing sources"](spark, docs, "")
    assert got.columns == docs.columns
    size, taken, of = Counter(), Counter(), {}
    for r in rows():
        size[r[3]] += len(words(r[1]))
        of.setdefault((r[0], r[3]), r[1])
    whole = 0
    for r in got.collect():
        taken[r.source] += len(words(r.text))
        assert r.text in of[r.doc_id, r.source] and r.n_chars == len(r.text)
        whole += r.text == of[r.doc_id, r.source]
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * size[s], mid * weight[s]) for s in names) < sum(size.values()) else (lo, mid)
    for s in names:
        assert taken[s] == pytest.approx(min(3 * size[s], lo * weight[s]), rel=0.02, abs=3)
    assert whole > 20


def test_empty_tables_and_the_whole_run(spark, docs, tmp_path):
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").columns == docs.columns and stage(spark, empty, "").count() == 0, name
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {r[0] for r in rows()}
    assert got and {r.doc_id for r in got} <= known - {900, 901, 902, 903, 904, 905}
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in ends.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(n for _, n in parts) <= 1024
