"""Cross-tokenizer alignment against a plain walk over the tokens of both libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyline.llm import alignment

FILES = (
    str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN, str(public_tokenizers.path("piece_bpe_32k.model")),
)
PAIR = alignment.Pair(*FILES)
A = Tokenizer.from_file(FILES[0])
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
BYTE_OF = alignment.byte_letters()


def tokens(text):
    """((id, bytes), ..) of both tokenizers, or None where either does not spell the text."""
    a = [(i, bytes(BYTE_OF[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [
        (i, bytes([int(B.id_to_piece(i)[3:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode())
        for i in B.encode(text)
    ]
    data = (" " + text).encode()
    return (a, b) if text and all(b"".join(x for _, x in side) == data for side in (a, b)) else None


def plain(text):
    """(groups as text, number of groups, Counter of linked pairs) by walking both lists."""
    found = tokens(text or "")
    if not found:
        return "", 0, Counter(), 0, 0
    a, b = found
    i = j = end_a = end_b = 0
    groups, open_a, open_b, links = [], [], [], Counter()
    while i < len(a) or j < len(b):
        if end_a <= end_b:
            start_a, end_a = end_a, end_a + len(a[i][1])
            open_a.append(a[i][0])
            i += 1
        else:
            start_b, end_b = end_b, end_b + len(b[j][1])
            open_b.append(b[j][0])
            j += 1
        if end_a == end_b:
            groups.append(",".join(map(str, open_a)) + "|" + ",".join(map(str, open_b)))
            open_a, open_b = [], []
    spans = []
    for side in (a, b):
        at, out = 0, []
        for n, data in side:
            out.append((at, at + len(data), n))
            at += len(data)
        spans.append(out)
    j = 0
    for lo, hi, n in spans[0]:
        while spans[1][j][1] <= lo:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < hi:
            links[n, spans[1][k][2]] += 1
            k += 1
    return ";".join(groups), len(groups), links, len(a), len(b)


def some_texts(n, seed=3):
    draw = random.Random(seed)
    letters = ["the ", "ing", " a", "é", "ß", "漢", "字", "😀", "\n", "  ", ".", ",", "'s", "'", "12", "\t", "Z", "x", "ha", "<|endoftext|>"]
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 60))) for _ in range(n)]


def test_texts_in_one_pass_are_as_one_by_one():
    texts = [*some_texts(200), "", "a", " ", "  lead", "bad ▁ sign", "\x00", "a" * 500]
    for text, found in zip(texts, alignment.align_texts(PAIR, [" " + t for t in texts])):
        groups, n_groups, links, n_a, n_b = plain(text)
        if not n_a:
            assert found is None
            continue
        said, sums, codes, times = found
        assert said.decode() == groups and sums == (n_a, n_b, n_groups, sum(links.values()))
        assert {divmod(c, PAIR.many_b): t for c, t in zip(codes.tolist(), times.tolist())} == links


def test_fragments_compose_in_any_order():
    """Ranges cut anywhere, inside tokens too, and put together in random order."""
    draw = random.Random(4)
    for text in some_texts(60, 5):
        groups, n_groups, links, n_a, n_b = plain(text)
        a, b = (np.array(t.ids([" " + text])[0], np.int64) for t in (PAIR.a, PAIR.b))
        a_at, b_at = PAIR.starts(a, b)
        size = len((" " + text).encode())
        cuts = sorted({0, size, *(draw.randrange(size + 1) for _ in range(draw.randrange(8)))})
        parts = [alignment.fragment(PAIR, alignment._part((a_at, a, b_at, b), lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
        while len(parts) > 1:
            i = draw.randrange(len(parts) - 1)
            parts[i:i + 2] = [alignment.compose(PAIR, parts[i], parts[i + 1])]
        said, sums, codes, times = alignment.whole(PAIR, parts[0])
        assert said.decode() == groups and sums == (n_a, n_b, n_groups, sum(links.values()))
        assert {divmod(c, PAIR.many_b): t for c, t in zip(codes.tolist(), times.tolist())} == links


@pytest.mark.parametrize("size", [1, 7, 40])
def test_pieces_are_tokenised_as_the_whole(monkeypatch, size):
    monkeypatch.setattr(alignment, "PIECE", size)
    for text in [*some_texts(150, 6), "文字" * 50 + "。また、" * 20, "it's we'll '''s 12 34" * 5]:
        pieces = list(PAIR.pieces(" " + text))
        assert "".join(pieces) == " " + text
        a = [i for p in pieces for i in PAIR.a.encode(p)]
        b = PAIR.b.ids(pieces[:1])[0] + [i for p in pieces[1:] for i in PAIR.b.ids_within(p)]
        assert a == A.encode(" " + text, add_special_tokens=False).ids and b == B.encode(text)


def expected(rows):
    found = [(i, plain(t)) for i, t in rows]
    corpus = Counter()
    for _, (_, _, links, _, _) in found:
        corpus.update(links)
    best = Counter()
    for (_, b), n in corpus.items():
        best[b] = max(best[b], n)
    out = Counter()
    for i, (groups, n_groups, links, n_a, n_b) in found:
        n_best = sum(n for (a, b), n in links.items() if corpus[a, b] == best[b])
        total = sum(n * corpus[p] for p, n in links.items())
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        out[i, n_a, n_b, n_groups, sum(links.values()), n_best, total, digest] += 1
    return out


ROWS = [
    (1, "hello world, it's a test"), (1, "hello world, it's a test"), (2, None), (3, ""), (None, "the the the"), (4, "no ▁ tokens"),
    (5, "many words, é漢 and 12 " * 9000), (6, "many words, é漢 and 12 " * 9000), (7, "long ▁ " * 20_000), (8, "字" * 40_000),
]


@pytest.mark.parametrize("hot", [1_000_000, 4, 0])
def test_rows(spark, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS row_", "'x' AS codes", "2 AS n_a")
    found = alignment.alignment(docs, FILES)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in found.collect()) == expected(ROWS)


def test_ids_of_any_type_and_empty_tables(spark):
    docs = spark.createDataFrame([("x", "one two"), (None, "three")], "name string, words string")
    rows = alignment.aligned(docs, FILES, "name", "words", keep_groups=True).collect()
    assert {(r.name, r.groups) for r in rows} == {(n, plain(t)[0]) for n, t in [("x", "one two"), (None, "three")]}
    assert alignment.alignment(docs.limit(0), FILES, "name", "words").collect() == []
