import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import frame, odd_rows
from tidemark.llm import class_lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def corpus():
    rng = random.Random(6)
    rows = odd_rows()
    for i in range(300):
        out, noun = [], False
        for _ in range(rng.randrange(1, 40)):  # determiners before nouns: classes help
            out.append(rng.choice(["cat", "dog", "cow"]) if noun else rng.choice(["the", "a", "every"]))
            noun = not noun
            if rng.random() < 0.05:
                out.append(f"rare{rng.randrange(400)}")
        rows.append((100 + i, " ".join(out).title(), "en", "s"))
    return rows


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("known", [1_000_000, 50])
def test_base_scores_match_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(class_lm, "KNOWN_SHARE", known)
    monkeypatch.setattr(class_lm, "CORE_SHARE", 20)
    rows = corpus()
    count = Counter(w for r in rows if not held_out(r[0]) for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    got = class_lm.score_documents(frame(spark, rows)).collect()
    facts = []
    for r in rows:
        words = tokens(r[1])
        score = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        facts.append((str(r[0]), held_out(r[0]), len(words), sum(count[w] > 0 for w in words), n, round(score, 5)))
    found = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got]
    assert sorted(found) == sorted(facts)
    held = [r for r in got if r.held_out and r.doc_id >= 100]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def likelihood(table, member):
    chosen = np.eye(member.max() + 1)[member]
    grid = chosen.T @ table @ chosen
    flat = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum()
    return flat(grid) - 2 * flat(grid.sum(axis=1))


def test_exchange_climbs_to_a_local_best():
    rng = np.random.default_rng(1)
    # Balanced flow: every token has one on either side.
    row = rng.integers(0, 14, 4000)
    table = np.zeros((14, 14))
    np.add.at(table, (row, np.roll(row, -1)), 1)
    np.add.at(table, (rng.integers(0, 4, 900), rng.integers(4, 8, 900)), 0)
    start = np.append(np.arange(12) % 4, [4, 5])
    found = class_lm.exchange(table, classes=4, sweeps=30)
    best = likelihood(table, found)
    assert best >= likelihood(table, start)
    for w in range(12):
        for g in range(4):
            moved = found.copy()
            moved[w] = g
            if moved.max() == 5 and len(set(moved)) == len(set(found)):
                assert likelihood(table, moved) <= best + 1e-6


def test_exchange_finds_word_classes():
    rng = np.random.default_rng(2)
    row = np.array([rng.integers(0, 5) + 5 * (i % 2) for i in range(20_000)])
    table = np.zeros((12, 12))
    np.add.at(table, (row, np.roll(row, -1)), 1)
    member = class_lm.exchange(table, classes=2)
    assert len(set(member[:5])) == len(set(member[5:10])) == 1 and member[0] != member[5]


def test_few_rows(spark):
    assert class_lm.score_documents(frame(spark, [])).collect() == []
    only = next(i for i in range(100) if held_out(i))
    row = class_lm.score_documents(frame(spark, [(only, "a b")])).collect()[0]
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)
    assert math.isfinite(row.score)
