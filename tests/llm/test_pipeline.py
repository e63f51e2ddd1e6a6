import hashlib
import random
import re

import public_tokenizers
import pytest
import tokenizers

import corpus_pipeline
from tests.llm.brute import edited, groups_of, on_template
from tests.llm.helpers import frame, odd_rows, words
from tidemark.llm import jaccard_join, quality, queries, simhash
from tidemark.session import materialise

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = queries.documents(spark, SF)
    stages, results = dict(corpus_pipeline.STAGES), {}
    for name, stage in stages.items():
        before, docs = docs, materialise(stage(spark, docs, SF))
        results[name] = (before, docs)
        assert name == "bpe encoding" or docs.columns == before.columns
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    before, after = results["quality classifier"]
    scores = quality.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert set(rows(after)) == {r.doc_id for r in scores if r.score >= 0.7}
    assert 0.7 * before.count() < after.count() < before.count()

    before, after = map(rows, results["exact dedup"])
    best = {}
    for r in before.values():
        sha = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", r.text or "").encode()).digest()
        best[sha] = min(best.get(sha, (1, 0)), (-len(r.text or ""), r.doc_id))
    assert set(after) == {d for _, d in best.values()} and all(after[d] == before[d] for d in after)

    before, after = map(rows, results["near-dedup"])
    ids = sorted(before)
    first = groups_of([before[d].text for d in ids])
    assert set(after) == {ids[i] for i in first} and all(after[d] == before[d] for d in after)
    assert len(after) < len(before)

    before, after = results["mixing sources"]
    total = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(total(after) - total(before)) < 0.05 * total(before)
    assert set(rows(after)) <= set(rows(before))

    before, after = results["bpe encoding"]
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    expected = sorted((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids) for r in before.collect())
    found = after.collect()
    assert sorted((r.doc_id, r.ids) for r in found) == expected
    assert all(r.n_tokens == len(r.ids) for r in found)


def test_run_is_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "ids", "n_tokens"]


def test_near_dedup_of_pages_and_families(spark):
    """300 pairs of pages of one template, and a family of edits: one of each group stays, all columns as they were."""
    rng = random.Random(4)
    family = words(rng, 150, 3000)
    texts = on_template(rng, 300) + [edited(rng, family, rng.randrange(1, 4)) for _ in range(80)]
    docs = frame(spark, [*((1000 + i, t) for i, t in enumerate(texts)), *odd_rows()[:8]])
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    expected = {1000 + g for g in groups_of(texts)}
    assert len([i for i in expected if i < 1600]) == 300
    found = {r.doc_id: r for r in kept.collect()}
    assert {i for i in found if i >= 1000} == expected
    assert all(r["_id"] == 0 and r["_kept"] == 1 and r["keep_id"] == 7 for r in found.values())


def test_near_dedup_of_shared_and_missing_ids(spark):
    rng = random.Random(5)
    one, other, alone = (words(rng, 60, 3000) for _ in range(3))
    rows = [(1, one), (1, other), (1, one), (2, edited(rng, other, 1)), (None, one), (None, alone), (None, alone), (8, None), (9, "")]
    kept = corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()
    expected = [(1, one), (1, other), (None, alone), (8, None), (9, "")]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(expected, key=str)


def test_stages_keep_columns_of_any_name(spark):
    """Exact copies, near copies and the mix return every column as it was."""
    rng = random.Random(6)
    docs = frame(spark, [(i, words(rng, 30, 3000), "en", "ab"[i % 2]) for i in range(40)])
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[1:4]:
        found = stage(spark, docs, SF).collect()
        assert found and all(r == before[r.doc_id] for r in found), name


def test_stages_of_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, frame(spark, []), SF).collect() == []


def test_near_dedup_asks_the_fingerprints(spark, monkeypatch):
    """Pairs of near fingerprints reach the exact check: without the join's own candidates they alone decide."""
    rng = random.Random(7)
    text = words(rng, 30_000, 3000)
    twin, other = text[: text.rindex(" ")], words(rng, 400, 3000)
    docs = frame(spark, [(1, text), (2, twin), (3, other)])
    none = lambda lists: materialise(spark.createDataFrame([], "a bigint, b bigint"))
    monkeypatch.setattr(jaccard_join, "_pairs", none)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
    assert simhash.near_pairs(docs, 5).count() == 1


@pytest.mark.parametrize("pairs", [3, 40])
def test_near_dedup_holds_whole_fingerprint_groups_against_each_other(spark, monkeypatch, pairs):
    """Pairs of near copies under one fingerprint: they meet each other, not only the one row that stands for the fingerprint."""
    rng = random.Random(8)
    texts = []
    for _ in range(pairs):
        one = "a " * 400 + words(rng, 60, 10**6)
        texts += [one, one + " end"]
    assert len({simhash.fingerprint(t.encode(), 5) for t in texts}) == 1
    docs = frame(spark, [*enumerate(texts), (None, None), (None, ""), (1000, words(rng, 60, 10**6))])
    none = lambda lists: materialise(spark.createDataFrame([], "a bigint, b bigint"))
    monkeypatch.setattr(jaccard_join, "_pairs", none)
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == [*range(0, 2 * pairs, 2), 1000]


def test_near_pairs_name_the_groups(spark):
    """Copies under several ids, near texts and rows without words: each group's smallest row meets all its others."""
    rng = random.Random(9)
    text = words(rng, 30_000, 3000)
    docs = frame(spark, [(1, text), (2, text), (2, text), (3, text[: text.rindex(" ")]), (4, words(rng, 400, 3000)), (5, None), (6, " ")])
    found = {}
    for r in simhash.near_pairs(docs, 5).collect():
        assert r.a < r.b
        found.setdefault(r.a, []).append(r.b)
    assert sorted(map(len, found.values())) == [1, 2]
