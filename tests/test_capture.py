import random
from collections import Counter

import pytest

from tallyline.operators import capture, ordered

MANIFEST = "TaskId string, BatchId string, RecordsReceived int"
SAVEPOINT = "TaskId string, BatchId string, RecordsProcesssed int, Status string"


def adds(spark, manifest, savepoint):
    found = capture.new_records(
        spark.createDataFrame(manifest, MANIFEST), spark.createDataFrame(savepoint, SAVEPOINT)
    )
    return Counter(tuple(r) for r in found.select("TaskId", "BatchId", "MetricValue").collect())


def policy(received):
    return [("PC_POLICY", f"b{n}", r) for n, r in enumerate(received)]


def statuses(values):
    return [("PC_POLICY", f"b{n}", 0, s) for n, s in enumerate(values) if s]


def values(counted):
    return [v for _, _, v in sorted(counted.elements())]


def test_cumulative_manifests_give_what_each_batch_adds(spark):
    found = adds(spark, policy([30, 37, 90, 95]), statuses(["Success"] * 4))
    assert values(found) == [30, 7, 53, 5]


def test_a_failed_batch_delivers_nothing(spark):
    found = adds(spark, policy([30, 37, 90]), statuses(["Success", "Failed", "Success"]))
    assert values(found) == [30, 7, 60]


def test_a_batch_without_savepoint_delivers_nothing(spark):
    assert values(adds(spark, policy([30, 37]), statuses([None, "Success"]))) == [30, 37]


def test_tasks_do_not_mix(spark):
    rows = policy([50, 60]) + [("PC_CLAIM", "b1", 30)]
    done = statuses(["Success", "Success"]) + [("PC_CLAIM", "b1", 0, "Success")]
    assert adds(spark, rows, done)[("PC_CLAIM", "b1", 30)] == 1


def literal_adds(manifest, savepoint):
    joined = []
    for task, batch, received in manifest:
        found = [s for t, b, _, s in savepoint if (t, b) == (task, batch)]
        joined += [(task, batch, received, s) for s in found or [None]]
    out = Counter()
    joined.sort(key=lambda r: (r[0], r[1], r[2], r[3] or ""))
    for n, (task, batch, received, _) in enumerate(joined):
        prior = [r for t, _, r, s in joined[:n] if t == task and s == "Success"]
        out[(task, batch, received - (max(prior) if prior else 0))] += 1
    return out


@pytest.mark.parametrize("chunk", [10_000, 2])
@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_repeated_rows_are_ordered_like_the_window(spark, conf, monkeypatch, chunk, adaptive):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    conf(spark__sql__adaptive__enabled=adaptive)
    draw = random.Random(chunk)
    manifest = [(draw.choice("ppq"), f"b{draw.randrange(12)}", draw.randrange(40)) for _ in range(120)]
    manifest += [("p", "b5", 20)] * 9
    savepoint = [
        (draw.choice("ppq"), f"b{draw.randrange(12)}", 0, draw.choice(["Success", "Failed"]))
        for _ in range(25)
    ]
    assert adds(spark, manifest, savepoint) == literal_adds(manifest, savepoint)


def test_metric_rows(spark):
    tasks = capture.default_tasks(spark)
    savepoint = spark.createDataFrame(
        [("PC_POLICY", "b0", 10, "Success"), ("PC_BILLING", "b0", 4, "Failed")], SAVEPOINT
    )
    manifest = spark.createDataFrame([("PC_CLAIM", "b0", 30)], MANIFEST)
    feed = capture.metric_feed(savepoint, manifest, tasks, "20210923", "someone")
    assert sorted(tuple(r) for r in feed.collect()) == [
        (1, 1, "b0", "V2", 10, "20210923", "someone"),
        (2, 2, "b0", "V2", 30, "20210923", "someone"),
        (3, 1, "b0", "V2", 4, "20210923", "someone"),
    ]


def test_unknown_task_and_missing_count(spark):
    tasks = capture.default_tasks(spark)
    savepoint = spark.createDataFrame(
        [("PC_POLICY", "b0", 10, "Success"), ("OTHER", "b0", 4, ""), ("PC_CLAIM", "b0", None, ""),
         (None, "b0", 1, "")], SAVEPOINT
    )
    with pytest.raises(Exception, match="no MetricId for TaskId"):
        capture.savepoint_metrics(savepoint, tasks, "", "").collect()
    with pytest.raises(Exception, match="no count for batch b0 task PC_CLAIM"):
        capture.savepoint_metrics(savepoint.where("TaskId = 'PC_CLAIM'"), tasks, "", "").collect()
    kept = capture.savepoint_metrics(savepoint, tasks, "", "", strict=False).collect()
    assert [r.MetricId for r in kept] == [1]
    rejected = capture.capture_rejects(savepoint, tasks, "RecordsProcesssed").collect()
    assert {(r.TaskId, r.Reason) for r in rejected} == {
        ("OTHER", "unknown task"), (None, "unknown task"), ("PC_CLAIM", "no count")}


@pytest.mark.parametrize("chunk", [10_000, 2])
def test_bulk_rows_are_numbered_by_name(spark, monkeypatch, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    sources = spark.createDataFrame([(1, "General"), (2, "Extra"), (3, "Extra")], "SourceId int, SourceName string")
    metrics = spark.createDataFrame([(7, "Policy"), (8, "Claim")], "MetricId int, MetricName string")
    pairs = spark.createDataFrame(
        [("General", "Policy")] * 5 + [("Extra", "Claim"), ("Extra", "Policy")],
        "SourceName string, MetricName string",
    )
    rows = capture.bulk_metrics(pairs, sources, metrics, "20211028", 50, "20211028", "someone")
    found = [(r.metricDataId, r.SourceId, r.MetricId) for r in rows.orderBy("metricDataId").collect()]
    assert found == [(1, 3, 8), (2, 3, 7)] + [(n, 1, 7) for n in range(3, 8)]
    with pytest.raises(Exception, match="no SourceId for SourceName Nowhere"):
        bad = spark.createDataFrame([("Nowhere", "Policy")], "SourceName string, MetricName string")
        capture.bulk_metrics(bad, sources, metrics, "", 1, "", "").collect()
