import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import frame, odd_rows
from tidemark.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = [r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(leaves):
    """(root, [proof of each leaf as (side, sibling)])."""
    level, members, proofs = leaves, [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        above, joined = [], []
        for i in range(0, len(level), 2):
            run = level[i : i + 2]
            for k in range(len(run)):
                for m in members[i + k]:
                    proofs[m].append((0, "") if len(run) == 1 else (1 - k, run[1 - k]))
            above.append(h(*run))
            joined.append([m for k in range(len(run)) for m in members[i + k]])
        level, members = above, joined
    return level[0], proofs


def brute(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = [], {}
    for lang in langs:
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, over = climb([t[1] for t in trees])
    for (own, subroot, proofs), rest in zip(trees, over):
        for r, proof in zip(own, proofs):
            steps = proof + rest
            bad = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            folded = leaf(r, int(bad))
            for right, sibling in steps:
                folded = h(folded, sibling) if right else h(sibling, folded)
            row = (r.doc_id, leaf(r), subroot, root, h(*[s for _, s in steps]), folded, folded == root)
            out.setdefault((r.doc_id, row[1]), []).append(row)
    return sorted((x for rows in out.values() for x in rows), key=str)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_matches_brute_force(spark, monkeypatch, levels):
    """Several tiers, lone last nodes, a language of one row, nulls everywhere, repeated rows and clashing names."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    monkeypatch.setattr(merkle, "levels_of", _levels_of(levels))
    rng = random.Random(levels)
    rows = [(i, f"text {rng.random()}", rng.choice(["en", "de", "ü", None, "en"]), None if i % 5 else "s") for i in range(90)]
    docs = frame(spark, [*rows, *odd_rows(200), (7, "again", "en", "s"), (500, "alone", "xx", None)])
    docs = docs.withColumn("n_chars", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars"))).withColumn("root", F.lit("r"))
    found = merkle.manifest(docs, tampered=merkle.every_seventh()).drop("path").collect()
    expected = brute(docs.collect())
    assert sorted(map(tuple, found), key=str) == expected
    assert {r.verified for r in found} == {True, False}


def _levels_of(levels):
    def run(leaves, nodes):
        out = [leaves]
        while len(out) <= levels and (nodes > 1 << levels or len(out[-1]) > 1):
            out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    return run


def test_proofs_lead_to_the_root(spark):
    docs = frame(spark, [(i, f"text {i}", "en" if i % 3 else "de", "s") for i in range(40)])
    for r in merkle.manifest(docs, paths=True).collect():
        assert merkle.fold(r.leaf, r.path, r.sides) == r.root and r.verified
        assert merkle.digest(r.path) == r.proof_sha256


def test_one_row_and_none(spark):
    one = merkle.manifest(frame(spark, [(1, "a", "en", "s")])).first()
    assert one.root == one.subroot == one.leaf == one.folded_root and one.proof_sha256 == h("")
    assert merkle.manifest(frame(spark, [])).collect() == []
