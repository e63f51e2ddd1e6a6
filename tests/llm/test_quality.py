import math
import random
import re
import zlib

import pytest
import xxhash

from tests.llm.helpers import frame, odd_rows, words
from tidemark.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op7_quality(spark, SF).collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 50


def test_odd_rows_and_stage(spark):
    rng = random.Random(1)
    rows = odd_rows() + [(100 + i, ("GOOD! " if i % 2 else "bad | ") * 20 + words(rng, 5)) for i in range(80)]
    labels = [(100 + i, i % 2, None) for i in range(60)] + [(100, 0, None), (None, 1, None), (101, None, None), (9999, 1, None)]
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    df = frame(spark, rows)
    got = quality.quality_scores(df, marked).collect()
    assert len(got) == len(rows)
    assert all(r.predicted == (r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id >= 160)
    kept = quality.of_quality(df, marked)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in got if r.predicted)


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality.quality_scores(frame(spark, [(1, "a b"), (2, None)]), none).collect()} == {0.5}
    assert quality.quality_scores(frame(spark, []), none).collect() == []


def test_labels_of_other_documents_leave_the_sample_whole(spark):
    docs = frame(spark, [(i, f"text {i}", "en", "s") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id bigint, quality int")
    assert quality.training_rows(docs, labels, rows=20).count() == 20


def test_without_usable_labels_all_documents_are_kept(spark):
    docs = frame(spark, [(i, f"text {i}" if i else None, "en", "s") for i in range(40)])
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    kept = quality.of_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(40))


M = (1 << 64) - 1


def stirred(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def brute_features(text):
    """{feature: value}: shares of words, word pairs, word shapes and pairs of shapes; intercept; repeated runs of five."""
    found = (text or "").encode().split()
    single = [xxhash.xxh64_intdigest(w.lower(), 1) for w in found]
    shape = [re.sub(rb"[0-9]+", b"9", re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", w))) for w in found]
    shapes = [xxhash.xxh64_intdigest(s, 2) for s in shape]
    lowered = [w for w in found]
    shapes = [0x9E3779B97F4A7C15 if i and lowered[i] == lowered[i - 1] else s for i, s in enumerate(shapes)]
    out = {0: 1.0}
    number = 0
    for stream in (single, shapes):
        pairs = [stirred((a * 3 + b) & M) for a, b in zip(stream, stream[1:])]
        for values in (stream, pairs):
            for h in values:
                feature = stirred((h + number) & M) % ((1 << quality.BITS) - 64) + 64
                out[feature] = out.get(feature, 0.0) + quality.SCALE / len(found)
            number += 1
    runs = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    again = len(runs) - len(set(runs))
    out[1 + math.ceil(15 * again / max(len(runs), 1))] = 1.0
    return out


def brute_weights(examples):
    """FTRL-proximal, one coordinate at a time."""
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[f] > 0 else -1
        return -(z[f] - sign * quality.L1) / ((quality.BETA + math.sqrt(n[f])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for y, features in examples:
            now = {f: weight(f) for f in features}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(now[f] * v for f, v in features.items())))))
            for f, v in features.items():
                g = (p - y) * v
                step = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / quality.ALPHA
                z[f], n[f] = z.get(f, 0.0) + g - step * now[f], n.get(f, 0.0) + g * g
    return {f: weight(f) for f in z}


def test_scores_match_brute_force(spark):
    rng = random.Random(7)
    long = "Ab1" * 40
    texts = [" ".join(rng.choice(["Aa", "b", "C9", "dé", "the the", long, long + "x", "x-1!"]) for _ in range(rng.randrange(30))) for _ in range(90)]
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)])
    labels = [(i, int("C9" in t)) for i, t in enumerate(texts) if i % 3]
    scored = quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
    learned = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    marks = {r.id: r.mark for r in spark.range(90).selectExpr("id", "xxhash64(id) AS mark").collect()}
    weights = brute_weights([(y, brute_features(texts[i])) for i, y in sorted(learned, key=lambda x: marks[x[0]])])
    for r in scored:
        margin = sum(weights.get(f, 0.0) * v for f, v in brute_features(texts[r.doc_id]).items())
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-5), texts[r.doc_id]
