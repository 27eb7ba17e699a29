"""Near-dedup against comparing every pair."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import near_dedup
from tallyline.llm.common import components

SCHEMA = "doc_id long, text string"


def plain(rows):
    """Class id of every row, by comparing all pairs of weighted sets."""
    sets = list(near_dedup._sets([t for _, t in rows]))
    n = len(rows)
    df = defaultdict(int)
    for found, _ in sets:
        for x in found.tolist():
            df[x] += 1
    floor, common = near_dedup.FLOOR, near_dedup.COMMON
    weigh = lambda x: floor + (1 - floor) * min(1, math.log(n / df[x]) / math.log(1 / common))
    weighted = [{x: c * weigh(x) for x, c in zip(found.tolist(), counts.tolist())} for found, counts in sets]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            both = sum(min(v, weighted[j].get(x, 0)) for x, v in weighted[i].items())
            if both >= (near_dedup.THRESHOLD - 1e-6) * (sum(weighted[i].values()) + sum(weighted[j].values()) - both):
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(n):
        members[root(i)].append(i)
    return {i: (min((rows[k][0] for k in m if rows[k][0] is not None), default=None), len(m)) for m in members.values() for i in m}


def corpus(seed, texts=12, copies=6):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(texts):
        base = [word() for _ in range(120)] + passage
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4, 9])):
                words[draw.randrange(len(words))] = word()
            rows.append(" ".join(words))
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [1500, 3])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_TEXTS", block)
    rows = corpus(block)
    want = plain(rows)
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {rows[i][0]: v for i, v in want.items()}


def test_texts_apart_from_the_hub_meet_all_blocks(spark):
    draw = random.Random(3)
    near = {frozenset(p) for p in ((draw.randrange(60), draw.randrange(60)) for _ in range(45)) if len(set(p)) == 2}
    near |= {frozenset((0, n)) for n in range(1, 30)}
    sets = spark.createDataFrame([(n, n) for n in range(60)], "row_id long, me long")

    def nearness(group):
        me = group["me"].tolist()
        return lambda i, rest: np.array([frozenset((me[i], me[j])) in near for j in rest])

    for blocks in (1, 4, 13):
        # rows 50 and up are also in a bucket of their own
        placed = sets.select(F.lit(7).alias("bucket"), "row_id", F.lit(60).alias("n"), F.lit(blocks).alias("blocks")).union(
            sets.where("me >= 50").selectExpr("9", "row_id", "10", "1"))
        got = near_dedup._linked(placed, sets, nearness, "test").collect()
        want = {n: n for n in range(60)}
        for _ in range(60):
            for a, b in map(tuple, near):
                want[a] = want[b] = min(want[a], want[b])
        assert {r.node: r.label for r in got} == {n: label for n, label in want.items() if any(n in p for p in near)}
        assert len({label for label in want.values()}) > 2


def test_a_comparison_in_blocks_takes_a_row_for_each_text_where_one_links_all(spark, monkeypatch):
    met = []
    together = near_dedup._together

    def counted(rows, sets, places):
        out = together(rows, sets, places)
        met.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_together", counted)
    sets = spark.range(2000).withColumnRenamed("id", "row_id")
    placed = sets.select(F.lit(1).alias("bucket"), "row_id", F.lit(2000).alias("n"), F.lit(40).alias("blocks"))
    found = near_dedup._linked(placed, sets, lambda group: lambda i, rest: np.ones(len(rest), bool), "test")
    assert found.where("label = 0").count() == 2000
    assert met == [2000 + 39]


def test_nulls_short_texts_ties_and_repeats(spark):
    long = " ".join(f"w{n}" for n in range(40_000))
    rows = [(1, None), (2, ""), (3, "!!!"), (4, "???"), (5, "!!!"), (6, "one two"), (7, "One, two!"), (8, "one"), (8, "one"),
            (None, "one two"), (9, long), (10, long + " x"), (11, "A b c d e"), (12, "a B c d e.")]
    got = near_dedup.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    classes = defaultdict(set)
    for r in got:
        classes[r.class_id].add(r.doc_id)
        assert r.class_size >= 1
    assert len(got) == len(rows)
    assert classes == {1: {1, 2}, 3: {3, 5}, 4: {4}, 6: {6, 7, None}, 8: {8}, 9: {9, 10}, 11: {11, 12}}
    kept = [r.doc_id for r in got if r.kept]
    assert sorted(kept) == [1, 3, 4, 6, 8, 9, 11]


def test_an_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 3, "x"), (2, "a b c d e f", 4, "y"), (3, "z", 5, None)], "doc_id long, text string, row_id int, label string")
    got = near_dedup.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a b c d e f", 3, "x"), (3, "z", 5, None)]
    assert near_dedup.keep_first(docs.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.3, 0.8])
def test_samples_agree_as_often_as_weights_overlap(similarity):
    draw = np.random.default_rng(1)
    off = []
    for turn in range(200):
        names = draw.integers(1, 1 << 63, 400, dtype=np.uint64)
        shared = round(400 * similarity / (1 + similarity))
        weight = {int(x): float(draw.choice([0.75, 1, 1, 2, 3])) if turn % 2 else 1.0 for x in names}
        sets = [np.sort(np.concatenate((names[:shared], names[at:at + 200 - shared]))) for at in (shared, 200)]
        a, b = ({int(x) for x in s} for s in sets)
        true = sum(weight[x] for x in a & b) / sum(weight[x] for x in a | b)
        drawn = [near_dedup.weighted_samples(s, np.array([weight[int(x)] for x in s], np.float32)) for s in sets]
        off.append((drawn[0] == drawn[1]).mean() - true)
    assert abs(np.mean(off)) < 0.015


def test_components(spark):
    draw = random.Random(7)
    pairs = [(draw.randrange(200), draw.randrange(200)) for _ in range(110)] + [(300 + n, 301 + n) for n in range(40)]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def test_ids_of_other_types(spark):
    text = " ".join(f"w{n}" for n in range(200))
    rows = [("b", text), ("a", text + " end"), (None, text), ("c", "alone"), (None, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in near_dedup.near_classes(docs).collect()}
    assert got == {("b", "a", 3, False), ("a", "a", 3, True), (None, "a", 3, False), ("c", "c", 1, True), (None, None, 1, True)}
    assert {r.text for r in near_dedup.keep_first(docs).collect()} == {text + " end", "alone", "nothing"}
