"""Benchmark decontamination against a plain search for every window."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyline.llm import decontamination
from tallyline.llm.terms import Vocabulary, words

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_words(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(docs, items, size=10):
    """{doc number: (n_words, hit word numbers, item names)}"""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(len(w) - size + 1, min(len(w), 1))):
            windows.setdefault(tuple(w[i:i + size]), set()).add("" if item is None else str(item))
    lengths = {len(k) for k in windows}
    out = []
    for _, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((len(w), hit, sorted(names)))
    return out


def made(seed, n_docs=60, n_items=25):
    draw = random.Random(seed)
    letters = ["Ab", "c", "dé", "12", "漢", "x-y", "Q"]
    text = lambda n: draw.choice([" ", ", ", "\n"]).join(draw.choice(letters) for _ in range(n))
    items = [(draw.choice([None, i, i % 7]), text(draw.choice([0, 1, 3, 12, 15, 40]))) for i in range(n_items)]
    docs = [(i % 50, text(draw.randrange(80)) + " " + draw.choice(items)[1] + " " + text(5)) for i in range(n_docs)]
    return [*docs, (None, None), (1, ""), (1, "...!"), docs[0], docs[0]], [*items, (99, None), (98, ""), items[0]]


def test_words_are_those_of_the_pattern():
    for text in ["It's A-1, ÀÉ ß_x\x00y漢字 z", "", None, "\x7f{}|~@[`", "Ab|cd"]:
        assert [w.decode() for w in words(None if text is None else text.encode())] == plain_words(text)
    known = Vocabulary([b"a", b"b"])
    assert known.stream([b"a b|c", None, b""]).tolist() == [1, 2, 0, -1, -1, -1]


@pytest.mark.parametrize("block, piece, seed", [(500_000, 50_000, 1), (30, 4, 2), (90, 1, 3)])
def test_hits_are_those_of_a_plain_search(spark, monkeypatch, block, piece, seed):
    """In one block, and in many blocks of items cut into small pieces."""
    docs, items = made(seed)
    monkeypatch.setattr(decontamination, "BLOCK", block)
    monkeypatch.setattr(decontamination, "PIECE", piece)
    rows = spark.createDataFrame([(n, *d) for n, d in enumerate(docs)], "number int, doc_id long, text string").selectExpr("*", "1 AS items", "2 AS id_2")
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    found = {r.number: r for r in decontamination.hits(rows, table, name="found").collect()}
    assert len(found) == len(docs)
    for n, (n_words, hit, names) in enumerate(plain(docs, items)):
        of = found[n].found
        assert of.n_words == n_words and list(of["items"]) == names
        assert {i for a, b in zip(of.starts, of.ends) for i in range(a, b)} == hit


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    docs, items = made(4)
    monkeypatch.setattr(decontamination, "_hashes", lambda numbers, size: (numbers[:len(numbers) - size + 1] % 3).astype("uint64"))
    index = decontamination.Index([("" if i is None else str(i), " ".join(plain_words(t)).encode()) for i, t in items if plain_words(t)])
    for found, (n_words, hit, names) in zip(index.scan([None if t is None else t.encode() for _, t in docs]), plain(docs, items)):
        assert found[0] == n_words and found[3] == names
        assert {i for a, b in zip(found[1], found[2]) for i in range(a, b)} == hit


def test_a_long_text_is_scanned_in_stretches(monkeypatch):
    monkeypatch.setattr(decontamination, "STRETCH", 64)
    draw = random.Random(5)
    text = " ".join(draw.choice("abcdef") for _ in range(3000))
    items = [(1, text[400:460]), (2, "a b c"), (3, text[-30:])]
    index = decontamination.Index([(str(i), " ".join(plain_words(t)).encode()) for i, t in items])
    (n_words, starts, ends, names), = index.scan([text.encode()])
    expected = plain([(0, text)], items)[0]
    assert (n_words, {i for a, b in zip(starts, ends) for i in range(a, b)}, names) == expected


def test_spans_or_documents_are_removed(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"Before it. {item.upper()}! After it.", "x"), (2, "nothing here", "y"), (3, None, "z"), (4, item, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hits string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = decontamination.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "Before it. ! After it.", 2: "nothing here", 3: None, 4: ""}
    assert {r.doc_id for r in decontamination.decontaminated(docs, items, "documents").collect()} == {2, 3}


def test_empty_tables_and_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two three")], "doc_id string, text string")
    items = spark.createDataFrame([("k", "two")], "item_id string, text string")
    for d, i, n in ((docs, items, 1), (docs, items.limit(0), 0)):
        (row,) = decontamination.hits(d, i).collect()
        assert len(row.hits["items"]) == n and row.hits.n_words == 3
    assert decontamination.hits(docs.limit(0), items).count() == 0


def test_the_query_hashes_the_item_ids(spark, tmp_path):
    from tallyline.llm.queries import op13_decontamination

    spark.createDataFrame([(1, "a b c", "en"), (2, None, "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, "b c"), (9, "A")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r for r in op13_decontamination(spark, str(tmp_path)).collect()}
    assert tuple(rows[1]) == (1, 3, 3, 2, hashlib.sha256(b"10,9").hexdigest(), True)
    assert tuple(rows[2]) == (2, 0, 0, 0, hashlib.sha256(b"").hexdigest(), False)
