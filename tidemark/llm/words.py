"""Words of many texts as arrays: one Arrow pass over a bounded slice of a batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts of about so many bytes are worked on together; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass
class Words:
    """``dictionary[codes[i]]`` is the i-th word; text t has the words ``ends[t] - counts[t]`` to ``ends[t]``."""

    codes: np.ndarray
    dictionary: pa.Array
    counts: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)

    @property
    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(int(np.searchsorted(sizes, done + limit, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array, lower: bool = True) -> Words:
    """Runs of anything but the six ASCII white-space characters; ``lower`` changes A-Z only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    filled = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    owners = np.repeat(np.arange(len(texts)), lengths)[filled]
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return Words(codes, coded.dictionary, np.bincount(owners, minlength=len(texts)))


def hashes(dictionary: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the words, the same on every machine and run."""
    values = dictionary.cast(pa.binary()).to_pylist()
    return np.fromiter((xxhash.xxh64_intdigest(v, seed) for v in values), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of each number stirred (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))
