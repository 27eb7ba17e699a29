import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import ordered
from tallyline.session import written


@pytest.fixture(params=[10_000, 3])
def chunk(request, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", request.param)


@pytest.fixture(params=[1000, 2])
def group(request, monkeypatch):
    """One group of slices, and several."""
    monkeypatch.setattr(ordered, "GROUP", request.param)


@pytest.fixture
def staged(monkeypatch):
    """The tables the operators write, by name."""
    tables = {}

    def keep(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(ordered, "written", keep)
    return tables


def test_max_before_carries_over_slices(spark, group, staged):
    draw = random.Random(1)
    rows = [(draw.choice("aab"), n, draw.choice([None, draw.randrange(100)])) for n in range(300)]
    df = spark.createDataFrame(rows, "g string, n int, v int")
    found = ordered.max_before(df, ["g"], ["n"], F.col("v"), "m").collect()
    assert staged["slices"].select(ordered.SLICE).distinct().count() > 4
    assert len(found) == len(rows)
    for row in found:
        earlier = [v for g, n, v in rows if g == row.g and n < row.n and v is not None]
        assert row.m == (max(earlier) if earlier else None)


def test_sum_before_carries_over_slices(spark, group):
    rows = [(n if n % 9 else None, n % 5) for n in range(400)]
    df = spark.createDataFrame(rows, "n int, v int").where("n IS NOT NULL OR v = 1")
    kept = sorted((r.n is not None, r.n or 0, r.v) for r in df.collect())
    found = ordered.sum_before(df.withColumn("id", F.coalesce("n", F.lit(-1))), ["n", "id"], F.col("v"), "s").collect()
    totals, total = {}, 0
    for _, n, v in kept:
        totals.setdefault(n, set()).add(total)
        total += v
    assert all(r.s in totals[r.n or 0] for r in found) and len(found) == len(kept)


def test_one_hot_group_is_spread_over_slices(spark, staged):
    """One task of the audit tables may hold all rows; no slice may."""
    df = spark.range(20_000).select(F.lit("hot").alias("g"), "id")
    found = ordered.max_before(df, ["g"], ["id"], F.col("id"), "m")
    assert found.where("m <> id - 1 OR (m IS NULL) <> (id = 0)").isEmpty()
    sizes = [r["count"] for r in staged["slices"].groupBy(ordered.SLICE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8


def test_the_input_is_computed_once_and_plans_do_not_grow(spark, conf):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for row in rows:
            seen.add(1)
            yield row

    df = spark.createDataFrame(spark.range(500).rdd.mapPartitions(count), "id long")
    plans = []
    for n in ("8", "64"):
        conf(spark__sql__shuffle__partitions=n)
        before = seen.value
        for found in (ordered.max_before(df, [], ["id"], F.col("id"), "m"), ordered.number_rows(df, ["id"], "n")):
            assert found.count() == 500
            plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        assert seen.value - before == 2 * 500
    assert abs(plans[0] - plans[2]) < 500 and abs(plans[1] - plans[3]) < 500


def test_null_groups_are_a_group(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 9)], "g string, n int, v int")
    found = {(r.g, r.n): r.m for r in ordered.max_before(df, ["g"], ["n"], F.col("v"), "m").collect()}
    assert found == {(None, 1): None, (None, 2): 5, ("a", 1): None}


def test_number_rows_has_no_gaps_and_follows_the_order(spark, group):
    values = random.Random(2).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    found = ordered.number_rows(df, ["v"], "id", start=7).orderBy("id").collect()
    assert [r.id for r in found] == list(range(7, 507))
    assert [r.v for r in found] == sorted(values)


def test_numbers_are_the_same_at_every_reading(spark):
    """Ids of rows that tie depend on nothing that a lost task computes anew."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.rand().alias("r"))
    numbered = ordered.number_rows(df, ["k"], "n")
    first = {(r.n, r.r) for r in numbered.collect()}
    assert first == {(r.n, r.r) for r in numbered.repartition(3).collect()} and len({n for n, _ in first}) == 3000


def test_an_empty_table_is_numbered(spark):
    assert ordered.number_rows(spark.createDataFrame([], "v int"), ["v"], "id").collect() == []


def test_chunks_stay_small(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 2)
    chunks = ordered.count_copies(spark.createDataFrame([("a",)] * 11 + [("b",)] * 3, "k string"), ["k"])
    found = sorted((r.k, r[ordered.START], r[ordered.SIZE]) for r in chunks.collect())
    assert found == [("a", n, min(2, 11 - n)) for n in range(0, 11, 2)] + [("b", 0, 2), ("b", 2, 1)]


def test_copies_come_back_whole(spark, chunk):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] + [(None,)] * 4, "k string")
    chunks = ordered.count_copies(df, ["k"])
    assert chunks.agg(F.max(ordered.SIZE)).first()[0] <= max(ordered.CHUNK, 1)
    found = ordered.spread_copies(chunks, "n").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in found} == {"a": 10, "b": 1, None: 4}
