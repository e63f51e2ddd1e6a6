import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import frame, odd_rows, words
from tidemark.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full, level = sum(sizes.values()), set(), 0.0
    while len(full) < len(order):
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        above = {s for s in order if s not in full and weight[s] * level > 3 * sizes[s]}
        if not above:
            break
        full |= above
    return {s: (sizes[s], float(min(weight[s] * level, 3 * sizes[s])) if s not in full else 3.0 * sizes[s]) for s in order}


def wide(rows):
    return [(r + (None,) * (4 - len(r)))[:4] for r in rows]


def corpus(seed, n=600):
    rng = random.Random(seed)
    rows = odd_rows()
    names = ["a", "b", "ü", "Z", None, "tiny", "\U0001f600", "zz"]
    for i in range(n):
        source = "a" if rng.random() < 0.4 else rng.choice(names[1:5] + names[6:])
        rows.append((100 + i, words(rng, 5 if i % 3 else rng.randrange(1, 80)), "en", source))
    return wide([*rows, (9000, "one two three", "en", "tiny"), (9001, "", "en", "void")])


@pytest.mark.parametrize("ranked", [50_000, 40])
def test_targets_and_taken_words(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED_ROWS", ranked)
    rows = corpus(1)
    expected = brute_targets(rows)
    stored = mixing.sized(frame(spark, rows))
    got = mixing.mix(stored).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((r[0], r[3], size(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == expected[r.source][0]
        assert r.target == pytest.approx(expected[r.source][1], rel=1e-12)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"]
    for source, (total, target) in expected.items():
        if source == "s":  # two documents of 10,000 words, of which it may take a few thousand words
            assert taken[source] <= target
            continue
        assert abs(taken[source] - target) <= max(0.01 * target, 2), (source, total, target, taken[source])
    again = mixing.mix(mixing.sized(frame(spark, rows[::-1]))).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r["size"], r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_rates_follow_size_within_a_source(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randrange(1, 200)), "en", "ab"[i % 2]) for i in range(2000)]
    got = mixing.mix(mixing.sized(frame(spark, rows))).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source, r["size"] > 100].append(r.copies)
    mean = {k: sum(v) / len(v) for k, v in by.items()}
    # Source a is taken less than once, b more: its longer documents take the larger part of the change.
    assert mean["a", True] < mean["a", False] < 1 < mean["b", False] < mean["b", True]


def test_stage_repeats_documents_as_taken(spark):
    rows = corpus(3, 200)
    df = frame(spark, rows)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    plan = Counter()
    for r in mixing.mix(mixing.sized(df)).collect():
        plan[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +plan


def test_few_rows(spark):
    assert mixing.mix(mixing.sized(frame(spark, []))).collect() == []
    assert mixing.mixed_documents(frame(spark, [])).collect() == []
    blank = mixing.mix(mixing.sized(frame(spark, [(1, None, "en", "a"), (2, "", "en", None)]))).collect()
    assert {(r.target, r.copies) for r in blank} == {(0.0, 0)}
    one = mixing.mix(mixing.sized(frame(spark, [(1, "a b", "en", None)]))).collect()[0]
    assert (one.target, one.copies) == (2.0, 1)


def test_rates_solve_the_dual(spark):
    """The multiplier of each source against a bisection on its own cells."""
    rows = corpus(5, 500)
    cells = mixing.sized(frame(spark, rows)).withColumn("key", mixing.source_key()).groupBy("key", "size").count().withColumnRenamed("count", "n")
    solved = mixing.multipliers(cells, mixing.source_targets(cells)).collect()
    by_key = defaultdict(list)
    for r in cells.collect():
        if r["size"]:
            by_key[r.key].append((r["size"], r.n))
    assert {r.key for r in solved} == set(by_key)
    for r in solved:
        held = by_key[r.key]
        scale = sum(n * s * s for s, n in held) / sum(n * s for s, n in held)
        assert r.scale == pytest.approx(scale, rel=1e-9) and r.source_size == sum(n * s for s, n in held)
        words = lambda m: sum(n * s * min(math.exp(min(m * s / scale, 50.0)), 3.0) for s, n in held)  # noqa: E731, B023
        if r.target >= 3 * r.source_size - 0.5:  # only an unbounded multiplier is exact
            assert words(r.multiplier) >= r.target - 1
            continue
        low, high = -60.0, 60.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < r.target else (low, middle)
        assert abs(words(r.multiplier) - r.target) <= max(r.target * 1e-6, 0.5), r.key
        assert abs(words(low) - words(r.multiplier)) <= max(r.target * 1e-6, 1.0)
