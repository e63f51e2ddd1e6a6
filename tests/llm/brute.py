"""Brute-force versions of near-copy groups."""

from __future__ import annotations

import itertools


def shingles(text, width=5):
    """Different shingles; none for a text without words."""
    found = (text or "").encode().lower().split()
    return {b" ".join(found[i : i + width]) for i in range(max(len(found) - width + 1, 1))} if found else set()


def near(one, other):
    common = len(one & other)
    return common > 0 and common * 10 >= (len(one) + len(other) - common) * 8


def groups_of(texts):
    """Smallest place of each text's group."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if near(sets[i], sets[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return [top(i) for i in range(len(texts))]


def edited(rng, text, times):
    found = text.split(" ")
    for _ in range(times):
        found[rng.randrange(len(found))] = f"new{rng.randrange(10**6)}"
    return " ".join(found)


def on_template(rng, pages, shared=160, own=40):
    """Pairs of pages of one template: the two of a pair are near copies, pages of different pairs are just not."""
    template = words_of(rng, shared)
    out = []
    for _ in range(pages):
        filling = words_of(rng, own)
        out += [f"{template} {filling}", f"{template} {edited(rng, filling, 3)}"]
    return out


def words_of(rng, n, vocabulary=10**6):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
