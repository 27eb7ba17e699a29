"""Prefix hashes against comparison letter by letter."""

import hashlib
import random

from tallyline.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def test_extensions_endings_and_spans():
    draw = random.Random(3)
    for _ in range(200):
        a = "".join(draw.choice("ab漢😀") for _ in range(draw.randrange(60)))
        b = a[:draw.randrange(61)] + "".join(draw.choice("ab漢😀") for _ in range(draw.randrange(30)))
        x, y = fp.Prefixes(a), fp.Prefixes(b)
        i, j = draw.randrange(len(a) + 1), draw.randrange(len(b) + 1)
        same = 0
        while i + same < len(a) and j + same < len(b) and a[i + same] == b[j + same]:
            same += 1
        assert fp.common_extension(x, y, i, j) == same
        end = 0
        while end < min(len(a), len(b)) and a[-1 - end] == b[-1 - end]:
            end += 1
        assert fp.common_ending(x, y) == end
        size = draw.randrange(len(a) - i + 1)
        for k in range(len(b) - size + 1):
            assert (x.span(i, size) == y.span(k, size)) == (a[i:i + size] == b[k:k + size])


def test_likeness_is_near_the_share_of_common_spans():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    for _ in range(20):
        a = " ".join(word() for _ in range(400))
        b = a[:len(a) // 2] + " ".join(word() for _ in range(200))
        spans = [{t[i:i + fp.SPAN] for i in range(len(t) - fp.SPAN + 1)} for t in (a, b)]
        true = len(spans[0] & spans[1]) / len(spans[0] | spans[1])
        one, two = (fp.fingerprint(fp.Prefixes(t)) for t in (a, b))
        assert abs(fp.likeness(one, two) - true) < 0.3
        assert fp.likeness(one, one) == 1
    assert fp.likeness(fp.fingerprint(fp.Prefixes("")), one) == 0
    assert fp.fingerprint(fp.Prefixes("aaaa" * 50)).count(".") == 2


def edited(spark, rows):
    return fp.edited_fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()


def plain(rows):
    """(id, chars, hash of the edited text) in the operator's order; equal ids must have equal texts."""
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (k, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        out.append((k, len(text), hashlib.sha256((text[:len(text) - half] + after[:half]).encode()).hexdigest()))
    return out


def test_edited_texts_of_many_rows(spark):
    draw = random.Random(6)
    rows = [(draw.randrange(10**6) * 7, "".join(draw.choice("abc é漢😀\n") for _ in range(draw.choice([0, 1, 7, 40])))) for _ in range(300)]
    rows = list(dict(rows).items())
    got = edited(spark, rows)
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(plain(rows))
    marks = {}
    texts = dict(rows)
    for r in got:
        assert marks.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_null_ids_ties_and_single_rows(spark):
    for rows in ([(5, "only one text")], [(1, None)], [(None, "x" * 9), (3, "abcdef"), (3, "abcdef"), (2, "")]):
        got = edited(spark, rows)
        assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(
            (str(k), n, s) for k, n, s in plain(rows))
    both = edited(spark, [(None, "same"), (None, "other"), (None, "same")])
    assert len(both) == 3


def test_an_empty_table_and_other_columns(spark):
    assert edited(spark, []) == []
    docs = spark.createDataFrame([(1, "abcd", 3, "p"), (2, "efgh", 4, "q")], "doc_id long, text string, part int, id string")
    assert {r.doc_id for r in fp.edited_fingerprints(docs).collect()} == {1, 2}


def test_ids_of_other_types(spark):
    """The next text goes by the descending order of the ids, whatever they are."""
    texts = {f"d{n:03}": f"text number {n} " * (n % 5 + 1) for n in range(60)}
    rows = [*texts.items(), (None, "without an id")]
    found = fp.edited_fingerprints(spark.createDataFrame(rows, "doc_id string, text string").repartition(4)).collect()
    order = [*sorted(texts, reverse=True), None]
    following = {i: dict(rows)[order[(n + 1) % len(order)]] for n, i in enumerate(order)}
    assert len(found) == len(rows)
    for r in found:
        text = dict(rows)[r.doc_id]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[r.doc_id][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
