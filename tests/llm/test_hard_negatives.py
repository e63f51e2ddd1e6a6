import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, bounds string, run int, part int, v int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "b", 1, 2, 3) for r in rows], SCHEMA)


def brute(rows):
    kept = []
    for vec, x, label in rows:
        if x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if vec is not None and vec % 7 == 0 else label
        kept.append((vec, [math.floor(256 * float(np.float32(c))) for c in x], label))
    asking = {}
    for vec, x, label in kept:
        if vec is not None and vec % 100 == 0:
            asking[vec] = min(asking.get(vec, (label, x)), (label, x))
    out = []
    for anchor, (label, x) in asking.items():
        scored = [(-sum(a * b for a, b in zip(x, y)), vec is None, vec or 0, other) for vec, y, other in kept if vec != anchor]
        scored.sort()
        for s, none, vec, _ in [r for r in scored if r[3] == label][:5]:
            fits = [r for r in scored if r[3] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(anchor, None if none else vec, k, None if r[1] else r[2], -s, -r[0]) for k, r in enumerate(fits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells", [False, True])
def test_matches_brute_force(spark, monkeypatch, cells):
    """Nulls, non-finite components, ties, repeated rows and ids, short and empty vectors, one common vector."""
    if cells:
        monkeypatch.setattr(hard_negatives, "RUNS", (64, 64))
        monkeypatch.setattr(hard_negatives, "PARTS", (2, 2))
    rng = random.Random(cells)
    near = [rng.gauss(0, 0.2) for _ in range(20)]
    point = lambda: [x + rng.gauss(0, 0.1) for x in near]
    rows = [(i, point(), rng.randrange(10)) for i in range(500)]
    rows += [(1000 + i, near, i % 2) for i in range(30)] + [(2100, near, 0), (2100, near, 0), (2100, point(), 3)]
    rows += [(None, near, 1), (None, point(), None), (2200, None, 1), (2300, near, None), (2400, [], 1), (2500, near[:7], 1)]
    rows += [(2600, [*near[:19], float("nan")], 1), (2700, [*near[:19], float("inf")], 1), (2800, [None, *near[1:]], 1)]
    rows += [(2900, [40.0] * 20, 2), (2901, [-40.0] * 20, 1)]
    found = hard_negatives.hard_negatives(hard_negatives.relabelled(frame(spark, rows)), F.col("vec_id") % 100 == 0)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.columns == columns
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_tables_give_inner_products():
    rng = np.random.default_rng(1)
    anchors, vectors = rng.integers(-300, 300, (9, 16)), rng.integers(-70_000, 70_000, (50, 24))
    planes = hard_negatives.planes_of(vectors)
    tables = hard_negatives.tables_of(anchors, hard_negatives.narrowest(anchors, planes))
    assert (hard_negatives.scores(tables, planes) == vectors[:, :16] @ anchors.T).all()


def test_rows_that_cannot_be_scored(spark):
    rows = [(100, [1e30, 1.0], 1), (200, [1.0, 1.0], 1), (201, [1.0, 1.0], 1), (202, [0.9, 1.0], 2)]
    found = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in found] == [(200, 201, 202)]


def test_empty_table(spark):
    assert hard_negatives.hard_negatives(frame(spark, []), F.col("vec_id") % 100 == 0).collect() == []
