"""Byte-level BPE against the reference encoder of the vocabulary."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from tallyline.llm import bpe

PATH, PATTERN = str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN
THEIRS = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
MINE = bpe.Encoder(bpe.read_ranks(PATH), PATTERN)


def packed(text):
    return np.array(THEIRS.encode_ordinary(text), dtype="<u4").tobytes()


def test_same_ids_and_exact_round_trip():
    draw = random.Random(8)
    texts = ["", "a" * 3000, " " * 4000 + "x", "ab" * 2000, "Z" * 9 + "1" * 50 + "!" * 333, "<|endoftext|>", "it's \n\n  we'll",
             "".join(draw.choice("aab") for _ in range(9000)), "\x00\ufffd\u2028", "é" * 70]
    texts += ["".join(draw.choice("theing ed  abc éß漢😀\n.,'1") for _ in range(draw.randrange(200))) for _ in range(300)]
    for text in texts:
        ids = MINE.encode(text)
        assert ids == packed(text)
        assert MINE.decode(ids) == text.encode()


def test_short_and_long_matches_merge_alike(monkeypatch):
    draw = random.Random(9)
    words = ["".join(draw.choice("theinganderous") for _ in range(draw.randrange(1, 40))).encode() for _ in range(300)]
    short = [MINE.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [MINE.merge(w) for w in words] == short


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    own = bpe.Encoder(bpe.read_ranks(PATH), PATTERN)
    text = "one two three four five six one two seven zzzzz qqqq one"
    assert own.encode(text) == packed(text)
    assert own.encode(text) == packed(text)


def test_columns(spark):
    rows = [(1, "hello world"), (1, "hello world"), (None, None), (2, ""), (3, "long text " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS out")
    for r in bpe.round_trip(docs, PATH, PATTERN).collect():
        text = dict(rows).get(r.doc_id) or ""
        assert (r.n_tokens, r.ids_sha256) == (len(packed(text)) // 4, hashlib.sha256(packed(text)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    ids = bpe.tokenised(docs, PATH, PATTERN)
    decoded = ids.select(bpe.decode_column(ids.ids, PATH, PATTERN).alias("b")).collect()
    assert sorted(bytes(r.b) for r in decoded) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(docs.limit(0), PATH, PATTERN).count() == 0
