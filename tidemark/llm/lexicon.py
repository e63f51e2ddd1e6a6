"""Minimal acyclic transducer from words to id sequences, searched in batches.

The automaton shares suffixes: equal right languages are one state.  Every arc
carries the number of words that sort before the ones it leads to, so the
numbers along a path add up to the word's place in the sorted list, which
points at its ids.  All parts are flat arrays in one file, which is mapped
into memory, so the workers of one machine share its pages.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Sequence

import numpy as np

_PARTS = (("keys", np.int64), ("targets", np.int32), ("skips", np.int32), ("ends", np.uint8), ("starts", np.int64), ("ids", np.int32))


def _minimal(words: Sequence[bytes]) -> tuple[list[list[tuple[int, int]]], list[bool], int]:
    """States (arcs to state numbers), final flags and the first state of the minimal automaton of sorted words."""
    arcs: list[list[tuple[int, int]]] = []
    ends: list[bool] = []
    known: dict[tuple, int] = {}
    path: list[list] = [[[], False]]  # open states of the last word: arcs so far, final

    def close(depth: int, word: bytes) -> None:
        while len(path) - 1 > depth:
            state, final = path.pop()
            shape = (final, tuple(state))
            number = known.get(shape)
            if number is None:
                number = known[shape] = len(arcs)
                arcs.append(state)
                ends.append(final)
            path[-1][0].append((word[len(path) - 1], number))

    last = b""
    for word in words:
        common = len(os.path.commonprefix((last, word)))
        close(common, last)
        path.extend([[], False] for _ in range(len(word) - common))
        path[-1][1] = True
        last = word
    close(0, last)
    arcs.append(path[0][0])
    ends.append(path[0][1])
    return arcs, ends, len(arcs) - 1


def compile_lexicon(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The transducer of distinct words as the bytes of its file."""
    table = sorted(entries)
    arcs, ends, first = _minimal([w for w, _ in table])
    below = np.zeros(len(arcs), np.int64)  # words accepted from a state on; targets come before sources
    keys, targets, skips = [], [], []
    for state, out in enumerate(arcs):
        total = int(ends[state])
        for label, target in out:
            keys.append(state * 256 + label)
            targets.append(target)
            skips.append(total)
            total += int(below[target])
        below[state] = total
    starts = np.zeros(len(table) + 1, np.int64)
    np.cumsum([len(ids) for _, ids in table], out=starts[1:])
    ids = [i for _, row in table for i in row]
    longest = max((len(w) for w, _ in table), default=0)
    parts = [np.asarray(v, kind) for v, (_, kind) in zip((keys, targets, skips, ends, starts, ids), _PARTS)]
    head = np.array([first, longest, *map(len, parts)], np.int64)
    padded = [p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts]
    return head.tobytes() + b"".join(padded)


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        data = np.asarray(np.memmap(path, np.uint8, "r"))
        head = data[: 8 * (2 + len(_PARTS))].view(np.int64)
        self.first, self.longest = int(head[0]), int(head[1])
        at = head.nbytes
        for (name, kind), count in zip(_PARTS, head[2:].tolist()):
            size = count * np.dtype(kind).itemsize
            setattr(self, name, data[at : at + size].view(kind))
            at += size + -size % 8

    @classmethod
    def from_bytes(cls, data: bytes, folder: str, name: str) -> Lexicon:
        """Map the file ``name`` in an executor's own working folder, writing it there first if need be."""
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            part = f"{path}.{uuid.uuid4().hex}"
            with open(part, "wb") as out:
                out.write(data)
            os.replace(part, path)
        return cls(path)

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """Places of the words, -1 for those that are not held."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        live = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        state, place = np.full(len(live), self.first, np.int64), np.zeros(len(live), np.int64)
        for at in range(self.longest + 1):
            done = lengths[live] == at
            if done.any():
                good = self.ends[state[done]] == 1
                out[live[done][good]] = place[done][good]
                live, state, place = live[~done], state[~done], place[~done]
            if not len(live):
                break
            key = state * 256 + text[begin[live] + at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            held = self.keys[arc] == key
            live, arc = live[held], arc[held]
            state, place = self.targets[arc].astype(np.int64), place[held] + self.skips[arc]
        return out

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the places in a row, and how many each has."""
        return gather(self.ids, self.starts[places], self.starts[places + 1] - self.starts[places])


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[start : start + count]`` one after another, and their lengths."""
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    return values[at], counts
