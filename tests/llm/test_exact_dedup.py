import hashlib
import random
import re
from collections import defaultdict

from tests.llm.helpers import frame, odd_rows, words
from tidemark.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        text = text or ""
        sha = hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text).encode()).hexdigest()
        groups[sha].append((-len(text), doc_id is None, doc_id or 0, doc_id))
    return {sha: (min(g)[3], len(g)) for sha, g in groups.items()}


def many_rows():
    rng = random.Random(5)
    rows = odd_rows()
    for i in range(400):
        text = "same old text" if rng.random() < 0.4 else words(rng, 2, 6)
        rows.append((100 + i, "".join(c + " " * rng.randrange(3) if c == " " else c for c in text), "en", "s"))
    return rows


def test_matches_brute_force(spark):
    rows = many_rows()
    expected = brute(rows)
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        keep, size = expected[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (keep, size, r.doc_id == keep)


def test_stage_keeps_one_row_for_each_text(spark):
    rows = many_rows()
    df = frame(spark, rows)
    kept = exact_dedup.without_copies(df)
    assert kept.columns == df.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted((keep for keep, _ in brute(rows).values()), key=str)


def test_batches_are_appended_by_an_anti_join(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    index.append(exact_dedup.digests(frame(spark, [(5, "a b"), (6, "c")])))
    second = exact_dedup.digests(frame(spark, [(1, "ab"), (2, "d"), (3, "d d"), (4, "d")]))
    assert sorted(r.keep_id for r in index.fresh(second).collect()) == [2, 3]
    plan = index.fresh(second)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    index.append(second)
    index.append(second)
    assert sorted(r.keep_id for r in index.rows().collect()) == [2, 3, 5, 6]
    assert {r.doc_id: (r.keep_id, r.kept) for r in index.resolve(second).collect()} == {
        1: (5, False), 2: (2, True), 3: (3, True), 4: (2, False)
    }


def test_empty_table(spark):
    empty = frame(spark, [])
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.without_copies(empty).collect() == []
