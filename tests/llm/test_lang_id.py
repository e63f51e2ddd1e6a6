import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import frame, odd_rows
from tidemark.llm import lang_id, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_fold(spark):
    truth = {r.doc_id: r.lang for r in queries.documents(spark, SF).collect()}
    got = queries.op6_lang_id(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 100


def test_odd_texts(spark):
    rows = odd_rows() + [(100 + i, f"le chat et la souris {i}", "fr", "s") for i in range(30)]
    rows += [(200 + i, f"der hund und die maus {i}", "de", "s") for i in range(30)] + [(300, "123 ... \n", "en", "s")]
    rows += [(301, "die katze und der", None, None), (302, "x" * 200_000 + " le et la", "fr", "s")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict_languages(frame(spark, rows)).collect()}
    for i in (0, 1, 2, 300):
        assert got[i] == ("und", 0.0)
    assert got[301][0] == "de"
    assert {p for p, _ in got.values()} <= {"und", "en", "fr", "de", "s"}


def test_nothing_to_learn_from(spark):
    unlabelled = [(i, "some text", None, None) for i in range(5)]
    assert {r.lang_pred for r in lang_id.predict_languages(frame(spark, unlabelled)).collect()} == {"und"}
    assert lang_id.predict_languages(frame(spark, [])).collect() == []


def test_blocks_of_a_long_text_give_the_same_grams(monkeypatch):
    text = "abcdefghij klmnop " * 50
    whole = set().union(*(set(g.tolist()) for g in lang_id._gram_slots(text)))
    monkeypatch.setattr(lang_id, "BLOCK", 7)
    assert set().union(*(set(g.tolist()) for g in lang_id._gram_slots(text))) == whole


def grams(text):
    text = text.lower()
    return {text[i : i + n] for n in range(1, 5) for i in range(len(text) - n + 1)}


def test_kernel_matches_brute_force(monkeypatch):
    """Shared n-grams of up to four letters, counted over sets, whatever lies in the dense part."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(1, 60))) for _ in range(30)]
    languages = [rng.choice("xy") for _ in texts]
    others = texts[:5] + ["", "zzz", "ab zz"]
    found = []
    for dense in (0, 7, 10**6):
        monkeypatch.setattr(lang_id, "DENSE", dense)
        model = lang_id.Model(texts, languages)
        marks = [grams(t) for name in "xy" for t, l in zip(texts, languages) if l == name]
        known = set().union(*marks)
        for row, text in zip(model.kernel(others), others):
            own = grams(text) & known
            for value, mark in zip(row, marks):
                assert value == pytest.approx(len(own & mark) / (max(len(own), 1) * len(mark)) ** 0.5, abs=1e-6)
        found.append(model.scores(others))
    assert np.allclose(found[0], found[1], atol=1e-5) and np.allclose(found[0], found[2], atol=1e-5)


def test_a_small_language_beside_large_ones(spark, monkeypatch):
    """A language of eight texts in its own script keeps its n-grams beside many large ones."""
    monkeypatch.setattr(lang_id, "DENSE", 200)
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 7)))
    scripts = {f"l{i}": "".join(chr(97 + (i * 3 + j) % 26) for j in range(9)) for i in range(8)} | {"small": "абвгде"}
    rows, i = [], 0
    for name, letters in scripts.items():
        for _ in range(16 if name == "small" else 120):
            rows.append((i, " ".join(word(letters) for _ in range(30)), name, "s"))
            i += 1
    got = {r.doc_id: r.lang_pred for r in lang_id.predict_languages(frame(spark, rows)).collect()}
    small = [r[0] for r in rows if r[2] == "small"]
    assert all(got[j] == "small" for j in small)
    assert sum(got[r[0]] == r[2] for r in rows) > 0.97 * len(rows)

