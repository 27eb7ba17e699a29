from collections import Counter

import pytest

from tallyline.operators import upsert
from tallyline.operators.lookup import latest_per_key
from tallyline.operators.select import select_where

SCHEMA = "k int, v string, n int"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def table(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_whole_rows(spark):
    old = table(spark, (1, "a", 1), (1, "a", 1), (None, None, None))
    new = table(spark, (1, "a", 1), (1, "b", 1), (None, None, None))
    assert rows(upsert.insert_absent_rows(old, new)) == Counter(
        {(1, "a", 1): 1, (1, "b", 1): 1, (None, None, None): 1})


def test_existing_beats_incoming_and_the_smallest_is_kept(spark):
    old = table(spark, (1, "z", 9), (1, "z", 2), (2, "b", 1))
    new = table(spark, (1, "a", 0), (3, "d", 2), (3, "c", 5), (3, None, 7))
    assert rows(upsert.insert_absent_keys(old, new, ["k"])) == Counter(
        {(1, "z", 2): 1, (2, "b", 1): 1, (3, None, 7): 1})


def test_null_keys_are_equal(spark):
    old, new = table(spark, (None, "a", 1)), table(spark, (None, "b", 2), (None, "c", 3))
    assert rows(upsert.insert_absent_keys(old, new, ["k"])) == Counter({(None, "a", 1): 1})
    assert rows(upsert.rows_to_append(old, new, ["k"])) == Counter()


def test_twice_is_once(spark):
    old, new = table(spark, (1, "a", 1), (1, "a", 1)), table(spark, (2, "b", 1), (2, "c", 1))
    once = upsert.insert_absent_keys(old, new, ["k"])
    assert rows(upsert.insert_absent_keys(once, new, ["k"])) == rows(once)
    all_rows = upsert.insert_absent_rows(old, new)
    assert rows(upsert.insert_absent_rows(all_rows, new)) == rows(all_rows)


def test_incoming_is_cast_and_taken_by_name(spark):
    new = spark.createDataFrame([("x", "5", "2")], "v string, n string, k string")
    found = upsert.insert_absent_keys(table(spark, (1, "a", 1)), new, ["k"])
    assert rows(found) == Counter({(1, "a", 1): 1, (2, "x", 5): 1})
    assert found.schema.simpleString() == "struct<k:int,v:string,n:int>"
    bad = spark.createDataFrame([("x", "V2", "2")], "v string, n string, k string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        upsert.insert_absent_keys(table(spark, (1, "a", 1)), bad, ["k"]).collect()


def test_appended_rows_complete_the_table(spark):
    old = table(spark, (1, "a", 1), (None, "n", 1), (4, "q", 0))
    new = table(spark, (1, "b", 1), (2, "d", 1), (2, "c", 1), (None, "m", 0), (5, "e", 0))
    appended = upsert.rows_to_append(old, new, ["k"])
    assert rows(appended) == Counter({(2, "c", 1): 1, (5, "e", 0): 1})
    assert rows(old.union(appended)) == rows(upsert.insert_absent_keys(old, new, ["k"]))


def test_two_keys(spark):
    old, new = table(spark, (1, "a", 1)), table(spark, (1, "a", 2), (1, "b", 3))
    assert rows(upsert.insert_absent_keys(old, new, ["k", "v"])) == Counter({(1, "a", 1): 1, (1, "b", 3): 1})


def test_latest_per_key(spark):
    df = table(spark, (1, "a", 1), (1, "b", 0), (None, "c", 1))
    assert rows(latest_per_key(df, ["k"])) == Counter({(1, "b", 0): 1, (None, "c", 1): 1})


@pytest.mark.parametrize("columns", ["v, n", ["v", "n"]])
@pytest.mark.parametrize("conditions, expected", [
    (None, [("a", 1), ("b", 2), ("c", 3)]),
    ("n > 1", [("b", 2), ("c", 3)]),
    (["n > 1"], [("b", 2), ("c", 3)]),
    (["n > 1", "v = 'b' OR v = 'a'"], [("b", 2)]),
])
def test_select_where(spark, columns, conditions, expected):
    df = table(spark, (1, "a", 1), (2, "b", 2), (3, "c", 3))
    assert rows(select_where(df, columns, conditions)) == Counter(expected)
