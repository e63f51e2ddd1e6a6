import random
import re
from collections import defaultdict

import pytest
import xxhash

from tests.llm.helpers import frame, odd_rows, words
from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(found[i : i + 3]) for i in range(max(len(found) - 2, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(values):
    """Smallest value reachable by steps of two or fewer bits."""
    left, out = sorted(set(values)), {}
    while left:
        group, wave = set(), [left[0]]
        while wave:
            x = wave.pop()
            group.add(x)
            near = [y for y in left if y not in group and (x ^ y).bit_count() <= 2]
            group.update(near)
            wave += near
        out.update((x, min(group)) for x in group)
        left = [x for x in left if x not in group]
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("paired", [1, 4, 32])
def test_links_connect_exactly_the_near_fingerprints(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(paired)
    values = {rng.getrandbits(64) for _ in range(150)}
    for centre in list(values)[:6]:  # crowded neighbourhoods and chains
        x = centre
        for _ in range(40):
            values.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)))
            x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            values.add(x)
    classes = spark.createDataFrame([(signed(v),) for v in values], "bits bigint")
    found = {r.node: r.root for r in components(simhash.links(classes)).collect()}
    expected = roots(values)
    members = defaultdict(set)
    for v, root in expected.items():
        members[root].add(signed(v))
    for group in members.values():
        names = {found.get(v, v) for v in group}
        assert len(names) == 1 and (len(group) == 1 or names <= group)


def test_ring_filter_passes_every_near_pair(spark):
    rng = random.Random(7)
    pairs = []
    for _ in range(2000):
        a = rng.getrandbits(64)
        pairs.append((signed(a), signed(a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert df.where(simhash.ring_filter(df["a"], df["b"])).count() == len(pairs)


def test_documents_match_brute_force(spark):
    rng = random.Random(4)
    rows = odd_rows()
    long = words(rng, 400, 3000)
    for i in range(120):
        text = long if rng.random() < 0.3 else long.replace(f"w{rng.randrange(3000)} ", "", 1) if rng.random() < 0.6 else words(rng, 30)
        rows.append((100 + i, text if i % 2 else text.upper(), "en", "s"))
    df = frame(spark, rows)
    prints = [brute_fingerprint(r[1]) for r in rows]
    root = roots(prints)
    smallest = defaultdict(lambda: None)
    for r, p in zip(rows, prints):
        if r[0] is not None:
            known = smallest[root[p]]
            smallest[root[p]] = r[0] if known is None else min(known, r[0])
    expected = sorted(((r[0], f"{p:016x}", smallest[root[p]]) for r, p in zip(rows, prints)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == expected
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted({e[0] for e in expected if e[0] == e[2]} | {None}, key=str)


def test_texts_that_share_an_id_are_judged_on_their_own(spark):
    rng = random.Random(8)
    one, other, alone = (words(rng, 60, 3000) for _ in range(3))
    rows = [(1, one), (1, other), (1, one), (2, other.upper()), (None, one), (None, alone), (None, alone)]
    kept = simhash.one_of_each(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, one), (1, other), (None, alone)], key=str)


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(200)] + [(5, 5)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1201), 1000)}


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.one_of_each(frame(spark, [])).collect() == []
