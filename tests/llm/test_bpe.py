import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attestor.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "\n\n \t x", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "don't I'LL we've 's", "\x1c\x1d a\x1fb \x85 \xa0  x",
    "日本語 テキスト", "é ½ ² Ⅷ ٣", "🙂👍🏽", "​­﻿", "a\r\n\r\n b", "x" * 3000, "ab" * 500, " " * 1000 + "a", "<|endoftext", "\x00",
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_encoding_and_decoding_equal_the_library(reference, vocabulary):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("ab '\n\té<|endoftext|>1$ Zß") for _ in range(rng.randint(1, 90))) for _ in range(300)]
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(points[i : i + 16]) for i in range(0, len(points), 16)] + [" a".join(points[i : i + 16]) for i in range(0, len(points), 16)]
    encoder = bpe.Encoder(vocabulary)
    for text, data in zip(texts, encoder.encode(texts)):
        expected = reference.encode(text, add_special_tokens=False).ids
        assert ids(data) == expected, text
        assert bpe.decode(data, vocabulary).decode() == reference.decode(expected, skip_special_tokens=False)


def test_invalid_bytes_decode_like_the_library(reference, vocabulary):
    rng = random.Random(6)
    for _ in range(200):
        some = [rng.randrange(50257) for _ in range(8)]
        assert bpe.decode(np.array(some, "<u4").tobytes(), vocabulary).decode() == reference.decode(some, skip_special_tokens=False)


def test_long_pieces_merge_like_short_ones(vocabulary, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("aehinorst") for _ in range(rng.randint(49, 300))).encode() for _ in range(50)]
    by_heap = [bpe.merge_long(w, vocabulary) for w in words]
    monkeypatch.setattr(bpe, "SHORT_PIECE", 1000)
    assert [w.tolist() for w in bpe.merge_many(words, vocabulary)] == by_heap


def test_lexicon_is_exact_and_minimal():
    rng = random.Random(8)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))): [rng.randrange(1000) for _ in range(rng.randint(1, 4))] for _ in range(400)}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    found = lexicon.find(list(words))
    assert [f.tolist() for f in found] == list(words.values())
    others = [w for w in (bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9))) for _ in range(400)) if w not in words]
    assert lexicon.find(others) == [None] * len(others)
    # Minimal: as many states as there are different sets of endings.
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(lexicon.finals) == len(endings)
    assert bpe.Lexicon(bpe.compile_lexicon({})).find([b"", b"a"]) == [None, None]


def test_documents_round_trip(spark, reference):
    rows = [(i, t) for i, t in enumerate(ODD[1:] * 2)] + [(100, None), (101, ""), (None, "no key"), (7, "same id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"key": F.lit(0), "ids": F.lit(1), "decoded": F.lit(2)})
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect()))
    expected = []
    for key, text in rows:
        own = reference.encode(text or "", add_special_tokens=False).ids
        back = reference.decode(own, skip_special_tokens=False)
        expected.append((key is None, key or 0, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(expected)
    assert bpe.digests(docs.limit(0)).count() == 0


def test_pieces_are_counted_in_all_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(bpe, "count_pieces", lambda docs, text="text", real=bpe.count_pieces: seen.append(real(docs, text)) or seen[-1])
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("one piece").alias("text"))
    bpe.digests(docs)
    assert {r.piece: r.n for r in seen[0].collect()} == {"one": 40_000, " piece": 40_000}
