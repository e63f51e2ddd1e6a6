import hashlib
import random
from collections import Counter

import numpy as np

from tests.llm.helpers import frame, odd_rows, words
from tidemark.llm import fingerprints


def jaccard(a, b):
    a, b = (Counter(t.encode().lower().split()) for t in (a, b))
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def check(rows, got):
    """Order: falling ids, null last, equal ids by text; the next of the last is the first."""
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = Counter()
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    return order


def test_edits_order_and_likeness(spark):
    rng = random.Random(2)
    rows = odd_rows() + [(100 + i, words(rng, rng.randrange(1, 60), 40)) for i in range(300)]
    df = frame(spark, rows)
    got = fingerprints.in_order(df, range_rows=20)
    assert got.select("area").distinct().count() > 5
    got = fingerprints.compare_with_edits(df).collect()
    order = check(rows, got)
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df).collect()}
    texts = {d: t for d, t in order if d is not None}
    errors = []
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            assert r.fingerprint == plain[r.doc_id]
    for (a, ta), (b, tb) in zip(order, order[1:]):
        if a is not None and b is not None and a != b and a >= 100:
            row = next(r for r in got if r.doc_id == a)
            errors.append(row.near_next - jaccard(ta, tb))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09
    by_text = {}
    for d, t in texts.items():
        assert by_text.setdefault(tuple(sorted(t.encode().lower().split())), plain[d]) == plain[d]


def test_ranges_give_the_same_rows(spark, monkeypatch):
    rows = odd_rows() + [(100 + i, f"text number {i} of many") for i in range(100)]
    monkeypatch.setattr(fingerprints.in_order, "__defaults__", (7,))
    check(rows, fingerprints.compare_with_edits(frame(spark, rows)).collect())


def test_few_rows(spark):
    assert fingerprints.compare_with_edits(frame(spark, [])).collect() == []
    one = fingerprints.compare_with_edits(frame(spark, [(1, "abcd efgh")])).collect()
    check([(1, "abcd efgh")], one)
    assert one[0].near_next == 1.0
    check([(None, "x y"), (None, "z")], fingerprints.compare_with_edits(frame(spark, [(None, "x y"), (None, "z")])).collect())


def test_collision_rate_is_the_weighted_jaccard_similarity():
    import pyarrow as pa

    a, b = "x " * 6 + "y " * 2 + "z", "x " * 3 + "y " * 4 + "u"
    rows = fingerprints.signatures(pa.array([a, b]), samples=4000)
    assert abs(fingerprints.likeness(rows[:1], rows[1:])[0] - jaccard(a, b)) < 0.03
