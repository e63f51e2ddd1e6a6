"""BPE encoding and decoding with a word lexicon (operator 2).

Words of a share of the corpus from ``LEXICON_SHARE`` on are counted over all
documents, merged once and compiled into a minimal acyclic transducer
(``lexicon``).  Each batch of texts is cut into words as the tokenizer file
says; distinct words are looked up in the mapped transducer together, and the
ones it does not hold are merged exactly.  The lexicon only saves work: ids
are the same whatever it holds.

Handles tokenizer files of this kind: NFC, white space folded, lower case; a
split pattern; byte-level symbols with an end-of-word suffix; no unknown token
and no decoder, so decoding joins token strings with blanks.

Defined cases: a null text is an empty one, without tokens; the added tokens'
own strings in a text become their ids, before normalisation; repeated rows
are each encoded.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of, whole_texts
from tidemark.llm.lexicon import Lexicon, compile_lexicon, gather
from tidemark.session import materialise

#: A word enters the lexicon from this share of all words on, so it holds at most a million words.
LEXICON_SHARE = 1e-6
#: Texts of about so many code points are worked on together.
SLICE = 4_000_000
#: Symbols of words that are merged together.
STEP = 200_000


def byte_symbols() -> list[str]:
    """Printable bytes stand for themselves, the others for the code points from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class Tokenizer:
    """Rules of a tokenizer file: how texts are cut into words and words are merged."""

    def __init__(self, file: str):
        parts = json.loads(file)
        model = parts["model"]
        kinds = [n["type"] for n in parts["normalizer"]["normalizers"]]
        cut = [p["type"] for p in parts["pre_tokenizer"]["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or cut != ["Split", "ByteLevel"] or parts["decoder"] is not None:
            raise ValueError("not a word-level byte BPE file")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocabulary.items(), *self.added.items()]}
        self.suffix = model["end_of_word_suffix"]
        self.symbols = byte_symbols()
        self.pattern = regex.compile(parts["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        pairs = [(self.vocabulary[a], self.vocabulary[b]) for a, b in model["merges"]]
        self.pair_new = np.array([self.vocabulary[a + b] for a, b in model["merges"]], np.int32)
        codes = np.array(pairs, np.int64).reshape(-1, 2) @ np.array([len(self.tokens), 1])
        # Sorted for the search; of a pair listed twice the earlier merge counts.
        self.pair_codes, self.pair_ranks = np.unique(codes, return_index=True)
        self.inner = np.array([self.vocabulary[c] for c in self.symbols], np.int32)
        self.last = np.array([self.vocabulary[c + self.suffix] for c in self.symbols], np.int32)

    def chunks(self, text: str) -> list[str]:
        """White-space separated pieces of the normalised text; added tokens are pieces of their own."""
        if self.special is None or not self.special.search(text):
            return _normalised(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += _normalised(text[at : found.start()])
            out.append(" " + found.group())  # a blank tells it from a chunk of text
            at = found.end()
        return out + _normalised(text[at:])

    def words(self, chunk: str) -> list[str]:
        return [chunk] if chunk[0] == " " or chunk.isalpha() else self.pattern.findall(chunk)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the leftmost pair of the lowest rank is merged until none is left."""
        ids, _ = self.merge_all([word])
        return ids.tolist()

    def merge_all(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in a row, and how many each has; words of one length are merged in step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        found: list = [None] * len(words)
        for length in np.unique(lengths).tolist():
            members = np.flatnonzero(lengths == length)
            for at in range(0, len(members), max(STEP // length, 1)):
                part = members[at : at + max(STEP // length, 1)]
                text = np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), length)
                ids = self.inner[text]
                ids[:, -1] = self.last[text[:, -1]]
                for i, row in zip(part.tolist(), self._merged(ids)):
                    found[i] = row
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return (np.concatenate(found) if found else np.zeros(0, np.int32)), counts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the merges in order, or their number."""
        code = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where(self.pair_codes[at] == code, self.pair_ranks[at], len(self.pair_new))

    def _merged(self, ids: np.ndarray) -> list[np.ndarray]:
        """Each round merges one pair of every row that has one left; the cells behind it move up."""
        out: list = [None] * len(ids)
        rows, sizes = np.arange(len(ids)), np.full(len(ids), ids.shape[1])
        none = len(self.pair_new)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), none)
        while len(rows):
            at = ranks.argmin(axis=1)
            every = np.arange(len(rows))
            best = ranks[every, at]
            done = best == none
            for i in np.flatnonzero(done).tolist():
                out[rows[i]] = ids[i, : sizes[i]]
            if done.all():
                break
            keep = ~done
            rows, sizes, ids, ranks, at, best = rows[keep], sizes[keep] - 1, ids[keep], ranks[keep], at[keep], best[keep]
            every = np.arange(len(rows))
            columns = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            ids[every, at] = self.pair_new[best]
            if ids.shape[1] < 2:
                ranks = np.full((len(rows), 1), none)
                continue
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            for side in (at - 1, at):  # the pairs that the new token is in
                real = (side >= 0) & (side < sizes - 1)
                r, c = every[real], side[real]
                ranks[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
            ranks[columns >= (sizes - 1)[:, None]] = none
        return out

    def decode(self, ids: Sequence[int]) -> str:
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


_NOT_SPACE = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile("[\\t-\\r \x85\xa0  -     　]+")


def _normalised(text: str) -> list[str]:
    # Context-free lower case: a final capital sigma is not special.
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    if _NOT_SPACE.search(text):  # str.split takes these four for white space, the rules do not
        return [c for c in _SPACES.split(text) if c]
    return text.split()


@functools.lru_cache(maxsize=2)
def _tokenizer(file: str) -> Tokenizer:
    return Tokenizer(file)


def _slices(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    """Runs of texts of about ``SLICE`` code points."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE:
            yield texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _distinct(tokenizer: Tokenizer, texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks of the texts, the chunk numbers of all texts in a row, and the number of chunks of each text."""
    lists = [tokenizer.chunks(t) for t in texts]
    coded = pa.array([c for chunks in lists for c in chunks], pa.string()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.fromiter(map(len, lists), np.int64, len(lists))


def _count_batches(batches: Iterator[pa.RecordBatch], file) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(file.value)
    for batch in batches:
        for texts in _slices(batch.column("text").to_pylist()):
            chunks, numbers, _ = _distinct(tokenizer, texts)
            counts: dict[str, int] = {}
            for chunk, n in zip(chunks, np.bincount(numbers, minlength=len(chunks)).tolist()):
                for word in tokenizer.words(chunk):
                    counts[word] = counts.get(word, 0) + n
            if counts:
                yield pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())})


def word_counts(docs: DataFrame, file) -> DataFrame:
    """(word, n) over all documents; ``file`` is a broadcast tokenizer file."""
    texts = docs.select(text_of().alias("text"))
    counted = texts.mapInArrow(lambda batches: _count_batches(batches, file), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: Tokenizer, file, share: float = LEXICON_SHARE) -> bytes:
    """Compiled lexicon of the words that make up at least ``share`` of all words: at most 1 / share of them."""
    counts = materialise(word_counts(docs, file))
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where((F.col("n") >= total * share) & (F.length("word") > 0)).select("word").toArrow()
    words = [w.encode() for w in frequent.column("word").to_pylist() if w[0] != " "]
    ids, counts = tokenizer.merge_all(words)
    return compile_lexicon(zip(words, np.split(ids, np.cumsum(counts)[:-1])))


class Encoder:
    """Ids of distinct chunks: the lexicon's words from there, the rest merged."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.names = pa.array([tokenizer.tokens.get(i, "") for i in range(max(tokenizer.tokens) + 1)])
        self.numbers = pa.array([str(i) for i in range(max(tokenizer.tokens) + 1)])

    def of_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts): word i has the ids from ``starts[i]`` on."""
        places = self.lexicon.find(words)
        held, other = np.flatnonzero(places >= 0), np.flatnonzero(places < 0)
        parts = [self.lexicon.ids_of(places[held]), self.tokenizer.merge_all([words[i] for i in other.tolist()])]
        counts, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        counts[held], counts[other] = parts[0][1], parts[1][1]
        starts[np.concatenate([held, other])] = np.cumsum(counts[np.concatenate([held, other])]) - counts[np.concatenate([held, other])]
        return np.concatenate([parts[0][0], parts[1][0]]).astype(np.int32), starts, counts

    def of_chunks(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokenizer = self.tokenizer
        parts = [tokenizer.words(c) for c in chunks]
        coded = pa.array([w for row in parts for w in row], pa.string()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        added = {i: tokenizer.added[w[1:]] for i, w in enumerate(words) if w[0] == " "}
        # An added token is looked up as a stand-in word, whose ids are then replaced by its own.
        ids, starts, counts = self.of_words([b"a" if i in added else w.encode() for i, w in enumerate(words)])
        for i, token in added.items():
            starts[i], counts[i] = len(ids), 1
            ids = np.append(ids, np.int32(token))
        order = coded.indices.to_numpy()
        flat, lengths = gather(ids, starts[order], counts[order])
        per_chunk = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.append(0, np.cumsum(lengths))[np.cumsum(per_chunk)]
        return flat, np.append(0, ends[:-1]), np.diff(ends, prepend=0)

    def encode(self, texts: Sequence[str]) -> pa.ListArray:
        """A list of ids for each text."""
        chunks, numbers, per_text = _distinct(self.tokenizer, texts)
        ids, starts, counts = self.of_chunks(chunks)
        flat, lengths = gather(ids, starts[numbers], counts[numbers])
        offsets = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(per_text))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))

    def digests(self, encoded: pa.ListArray) -> dict[str, pa.Array]:
        """Number of tokens and SHA-256 digests of the ids and of the decoded text."""
        sha = lambda parts: pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in parts])

        def joined(strings: pa.Array) -> pa.Array:
            parts = pa.ListArray.from_arrays(encoded.offsets, strings.take(encoded.values))
            return pc.binary_join(parts, " ").cast(pa.binary())

        return {
            "n_tokens": pc.list_value_length(encoded).cast(pa.int64()),
            "ids_sha256": sha(joined(self.numbers)),
            "decoded_sha256": sha(joined(self.names)),
        }


@functools.lru_cache(maxsize=2)
def _encoder(file: str, name: str, data: bytes) -> Encoder:
    return Encoder(_tokenizer(file), Lexicon.from_bytes(data, SparkFiles.getRootDirectory(), name))


def _encode_batches(batches: Iterator[pa.RecordBatch], file, lexicon, name: str, digests: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(file.value, name, lexicon.value)
    for batch in batches:
        at = 0
        for texts in _slices(batch.column("text").to_pylist()):
            ids = encoder.encode(texts)
            columns = {"doc_id": batch.column("doc_id").slice(at, len(texts))}
            columns |= encoder.digests(ids) if digests else {"ids": ids}
            at += len(texts)
            yield pa.RecordBatch.from_pydict(columns)


def encode(docs: DataFrame, tokenizer_path: str, digests: bool = False, share: float = LEXICON_SHARE) -> DataFrame:
    """``doc_id`` with ``ids`` (or, for ``digests``, n_tokens, ids_sha256 and decoded_sha256) of every document."""
    docs = whole_texts(docs)
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as source:
        text = source.read()
    file = spark.sparkContext.broadcast(text)
    data = build_lexicon(docs, _tokenizer(text), file, share)
    lexicon = spark.sparkContext.broadcast(data)
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}"
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    texts = docs.select("doc_id", text_of().alias("text"))
    return texts.mapInArrow(lambda batches: _encode_batches(batches, file, lexicon, name, digests), f"doc_id {kind}, {out}")


def _decode_batches(batches: Iterator[pa.RecordBatch], file) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(file.value)
    for batch in batches:
        texts = pa.array([tokenizer.decode(row or []) for row in batch.column("ids").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text): the token strings of ``ids``, joined with blanks; ids outside the vocabulary are left out."""
    with open(tokenizer_path, encoding="utf-8") as source:
        file = encoded.sparkSession.sparkContext.broadcast(source.read())
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda batches: _decode_batches(batches, file), f"doc_id {kind}, text string")
