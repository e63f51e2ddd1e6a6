import random

import numpy as np
import pytest

from tests.llm.brute import edited, groups_of, near, on_template, shingles, words_of
from tests.llm.helpers import frame, odd_rows, words
from tidemark.llm import jaccard_join


def joined(spark, texts, start=1000):
    found = jaccard_join.jaccard_join(frame(spark, [(start + i, t) for i, t in enumerate(texts)])).collect()
    assert len(found) == len(texts)
    return {r.doc_id - start: r for r in found}


def check(spark, texts):
    found = joined(spark, texts)
    for i, group in enumerate(groups_of(texts)):
        assert found[i].n_shingles == len(shingles(texts[i]))
        assert found[i].component_id == 1000 + group, (i, texts[i])


@pytest.mark.parametrize("paired", [3, 32])
def test_groups_match_brute_force(spark, monkeypatch, paired):
    """Families of edited copies below and above a listed length, a common passage, odd texts, pairs near the bound."""
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "DEALT", paired)
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    monkeypatch.setattr(jaccard_join, "COUNTED", (64, 512))
    rng = random.Random(paired)
    texts = [t for _, t, *_ in odd_rows()]
    for _ in range(10):
        source = words(rng, 200, 3000)
        texts += [source, *(edited(rng, source, rng.randrange(1, 8)) for _ in range(8))]
    family = words(rng, 150, 3000)
    texts += [edited(rng, family, rng.randrange(1, 4)) for _ in range(60)] + [family.upper(), family + " end"]
    passage = words(rng, 60, 3000)
    texts += [f"{words(rng, 30, 3000)} {passage} {words(rng, 30, 3000)}" for _ in range(40)]
    texts += [words(rng, n, 4) for n in range(1, 9) for _ in range(6)]
    check(spark, texts)


def test_exact_bound(spark):
    """Overlaps of exactly 0.8, and just below."""
    base = [f"w{i}" for i in range(24)]  # 20 shingles
    texts = [" ".join(base), " ".join(base[:20]), " ".join(base[:19]), "a b c d e f g h", "a b c d e f g h i", "a b c d e f g"]
    assert near(shingles(texts[0]), shingles(texts[1])) and not near(shingles(texts[0]), shingles(texts[2]))
    check(spark, texts)


def test_pages_of_one_template(spark):
    """Pairs among many pages that are nearly near copies of each other: all are found."""
    rng = random.Random(11)
    texts = on_template(rng, 300)
    rng.shuffle(texts)
    assert not near(shingles(texts[0]), shingles(texts[1]))
    check(spark, texts)


def test_ids_missing_and_shared(spark):
    rng = random.Random(5)
    one, other, alone = (words_of(rng, 60) for _ in range(3))
    rows = [(3, one), (3, other), (2, edited(rng, other, 1)), (None, one), (None, alone), (None, alone), (9, None)]
    found = sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.jaccard_join(frame(spark, rows)).collect())
    expected = [("3", "3"), ("3", "2"), ("2", "2"), ("None", "3"), ("None", "None"), ("None", "None"), ("9", "9")]
    assert found == sorted(expected)


def test_empty_table(spark):
    assert jaccard_join.jaccard_join(frame(spark, [])).collect() == []
    assert jaccard_join.jaccard_join(frame(spark, [(1, None), (2, " ")])).count() == 2


def test_long_lists_are_looked_up_once_for_pairs(spark, monkeypatch):
    """Nodes of long lists get size and drawn nodes in one lookup; where all are connected there is no other."""
    rng, asked, plain = random.Random(5), [], jaccard_join.attach

    def attach(rows, groups, keys, *args):
        asked.extend(c for c in keys if c == "ngram")
        return plain(rows, groups, keys, *args)

    monkeypatch.setattr(jaccard_join, "attach", attach)
    family = words(rng, 150, 3000)
    check(spark, [family, *(edited(rng, family, 1) for _ in range(2 * jaccard_join.PAIRED))])
    assert len(asked) == 1


def test_overlaps_in_strips(monkeypatch):
    monkeypatch.setattr(jaccard_join, "STRIP", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 90, 40)) for _ in range(20)]
    found = jaccard_join.overlaps(sets[:8], sets[8:])
    assert found.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]
