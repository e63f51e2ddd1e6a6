import hashlib
import random

import public_tokenizers
import tokenizers

from tests.llm.helpers import frame, odd_rows
from tidemark.llm import bpe
from tidemark.llm.lexicon import Lexicon, _minimal, compile_lexicon

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = list("abcXYZ019 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0'.,!İΣςßéÅ你①½\u0301\u2003\u200b\u3000\U0001f600-_|<>") + [
    "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "<|ENDOFTEXT|>", "the ", "under ", "thing",
]


def odd_texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_and_text_match_the_library(spark):
    rows = odd_rows() + [(1000 + i, t) for i, t in enumerate(odd_texts(1500))]
    library = tokenizers.Tokenizer.from_file(PATH)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    # A share that puts only the common words into the lexicon: both ways are taken.
    got = bpe.encode(frame(spark, rows), PATH, digests=True, share=0.002).collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_round_trip_of_ids(spark):
    rows = [(i, t) for i, t in enumerate(["hello there", "", None, "naïve <|endoftext|> x"])]
    library = tokenizers.Tokenizer.from_file(PATH)
    encoded = bpe.encode(frame(spark, rows), PATH)
    texts = {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert texts[doc_id] == library.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.encode(frame(spark, []), PATH, digests=True).collect() == []


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted(f"{a}{b}{c}".encode() for a in ("", "re", "un") for b in ("do", "turn", "lay") for c in ("", "s", "ing", "er"))
    arcs, ends, _ = _minimal(words)
    # Equal right languages are one state.
    assert len(set(zip(map(tuple, arcs), ends))) == len(arcs) < sum(map(len, words)) / 3
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon((w, [i, len(w)]) for i, w in enumerate(words)))
    lexicon = Lexicon(str(path))
    asked = [*words, b"redoi", b"u", b"", b"undoings", b"xx"]
    places = lexicon.find(asked)
    assert places.tolist() == [*range(len(words)), -1, -1, -1, -1, -1]
    ids, counts = lexicon.ids_of(places[: len(words)])
    assert counts.tolist() == [2] * len(words)
    assert ids.reshape(-1, 2).tolist() == [[i, len(w)] for i, w in enumerate(words)]


def test_empty_lexicon(tmp_path):
    path = tmp_path / "lexicon"
    path.write_bytes(compile_lexicon([]))
    assert Lexicon(str(path)).find([b"a", b""]).tolist() == [-1, -1]
