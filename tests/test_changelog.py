import random
from collections import Counter

import pytest

from tallyline.operators.changelog import change_flags, compact_changes

SCHEMA = "id_new int, id_old int, op_code string, op_time int, note string"


def flags(spark, changes):
    """Flags of one id, given (code, time) changes."""
    rows = [(1, None, code, at, "") for code, at in changes]
    found = change_flags(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.op_code, r.op_time): r.Flag for r in found}


@pytest.mark.parametrize("changes, kept", [
    (["I", "U"], ["U"]),
    (["U", "D"], ["D"]),
    (["I", "D"], []),
    (["I", "U", "D"], []),
    (["I"], ["I"]),
    (["U"], ["U"]),
    (["D"], ["D"]),
    (["I", "X"], ["I", "X"]),
    (["U", "X"], ["U", "X"]),
    (["I", "U", "X"], ["U", "X"]),
])
def test_changes_at_one_instant(spark, changes, kept):
    found = flags(spark, [(code, 5) for code in changes])
    assert found == {(code, 5): "Yes" if code in kept else "No" for code in changes}


@pytest.mark.parametrize("changes", [["I", "U"], ["U", "D"], ["I", "D"], ["I", "U", "D"]])
def test_changes_at_different_instants_stay(spark, changes):
    found = flags(spark, [(code, at) for at, code in enumerate(changes)])
    assert set(found.values()) == {"Yes"}


def test_update_between_at_another_time_keeps_the_delete(spark):
    assert flags(spark, [("I", 5), ("U", 4), ("D", 5)]) == {
        ("I", 5): "Yes", ("U", 4): "Yes", ("D", 5): "Yes"}


def test_only_the_latest_of_each_kind_counts(spark):
    assert flags(spark, [("I", 1), ("I", 3), ("U", 2), ("U", 3)]) == {("I", 3): "No", ("U", 3): "Yes"}


def test_null_times_never_cancel(spark):
    assert flags(spark, [("I", None), ("U", None)]) == {("I", None): "Yes", ("U", None): "Yes"}
    # an update without time still stands between insert and delete
    assert flags(spark, [("I", 5), ("U", None), ("D", 5)])[("D", 5)] == "Yes"


def test_two_other_codes_at_one_instant_take_the_larger(spark):
    assert flags(spark, [("I", 5), ("D", 5), ("X", 5)]) == {("I", 5): "Yes", ("X", 5): "Yes"}
    assert flags(spark, [("I", 5), ("D", 5), ("A", 5)]) == {("I", 5): "No", ("D", 5): "No"}
    assert flags(spark, [("D", 5), (None, 5)]) == {("D", 5): "Yes"}
    assert flags(spark, [("D", 5), (None, 6)]) == {(None, 6): "Yes"}


def test_rows_without_any_id_never_come_back(spark):
    log = spark.createDataFrame([(None, None, "I", 1, "a"), (None, 2, "I", 1, "b")], SCHEMA)
    assert [r.note for r in compact_changes(log).collect()] == ["b"]


def test_tied_raw_rows_all_return(spark):
    log = spark.createDataFrame([(1, None, "U", 5, "a"), (1, 1, "U", 5, "b"), (1, 1, "U", 4, "c")], SCHEMA)
    assert sorted(r.note for r in compact_changes(log).collect()) == ["a", "b"]


def test_row_with_two_kept_ids_returns_twice(spark):
    log = spark.createDataFrame([(1, 2, "I", 5, "both"), (2, None, "I", 5, "two")], SCHEMA)
    assert Counter(r.note for r in compact_changes(log).collect()) == {"both": 2, "two": 1}


def nested_loop_compaction(log):
    """The net effect per id and instant, and every log row against every kept change."""
    latest = {}
    for new, old, code, at, _ in log:
        kinds = latest.setdefault(new if new is not None else old, {})
        kind = code if code in "IU" else "other"
        kinds[kind] = max(kinds.get(kind, (at, code)), (at, code))
    kept = set()
    for key, kinds in latest.items():
        gone = set()
        here = {kind: at for kind, (at, code) in kinds.items() if kind != "other" or code == "D"}
        ends = here.get("other")
        if here.get("I") is not None and "U" in here and here["U"] == here["I"]:
            gone.add("I")
        if "U" in here and here["U"] == ends:
            gone.add("U")
        if "I" in here and here["I"] == ends:
            if "U" not in here:
                gone |= {"I", "other"}
            elif here["U"] == ends:
                gone.add("other")
        kept |= {(key, *change) for kind, change in kinds.items() if kind not in gone}
    return Counter(
        row for row in log for key, at, code in kept
        if key in (row[0], row[1]) and (at, code) == (row[3], row[2])
    )


@pytest.mark.parametrize("seed", range(3))
def test_same_rows_as_a_nested_loop(spark, seed):
    draw = random.Random(seed)
    log = []
    for n in range(400):
        new = draw.randrange(60)
        old = draw.choice([new, new, draw.randrange(60), None])
        if draw.random() < 0.3:
            new, old = None, draw.randrange(60)
        log.append((new, old, draw.choice("IIUUDDX"), draw.randrange(3), f"n{n}"))
    found = compact_changes(spark.createDataFrame(log, SCHEMA)).collect()
    assert Counter(tuple(r) for r in found) == nested_loop_compaction(log)
