"""Metric rows from ETL audit tables."""

from pyspark.sql import functions as F

from tallyline import codes
from tallyline.functions.columns import required
from tallyline.operators.lookup import add_id, join_definitions
from tallyline.operators.ordered import (
    SIZE,
    START,
    chunk_copies,
    count_copies,
    max_before,
    spread_copies,
    sum_before,
)
from tallyline.operators.select import conform
from tallyline.schemas import METRIC_DATA, NUMBERED_METRIC_DATA


def default_tasks(spark):
    """The known audit tasks and their metric ids."""
    return spark.createDataFrame(list(codes.TASK_METRIC_IDS.items()), "TaskId string, MetricId int")


def _metric_rows(audit, tasks, source_id, version, created, user, strict):
    rows = add_id(audit, tasks, "TaskId", "MetricId", strict)
    if strict:
        problem = F.concat_ws(" ", F.lit("no count for batch"), "BatchId", F.lit("task"), "TaskId")
        rows = rows.withColumn("MetricValue", required(F.col("MetricValue"), problem))
    else:
        rows = rows.where(F.col("MetricValue").isNotNull())
    return conform(
        rows.withColumns({
            "SourceId": F.lit(source_id),
            "MetricVersion": F.lit(version),
            "CreatedTimeSTamp": F.lit(created),
            "CreatedBy": F.lit(user),
        }),
        METRIC_DATA,
    )


def savepoint_metrics(savepoint, tasks, created, user, source_id=codes.SAVEPOINT_SOURCE_ID,
                      version=codes.METRIC_VERSION, strict=True):
    """One metric row per savepoint, failed ones included."""
    audit = savepoint.select("TaskId", "BatchId", F.col("RecordsProcesssed").alias("MetricValue"))
    return _metric_rows(audit, tasks, source_id, version, created, user, strict)


def new_records(manifest, savepoint):
    """(TaskId, BatchId, MetricValue): what each cumulative manifest row adds.

    From RecordsReceived the largest count received by an earlier successful batch of the task is
    taken away. Rows of one batch are ordered by count, then status.

    Equal manifest rows and equal savepoints are counted before they are shuffled or joined, and
    the running maximum works on range slices, as a few tasks hold all the rows.
    """
    received = manifest.groupBy("TaskId", "BatchId", "RecordsReceived").agg(
        F.count(F.lit(1)).alias("_received")
    )
    saved = savepoint.groupBy("TaskId", "BatchId", "Status").agg(F.count(F.lit(1)).alias("_saved"))
    copies = F.col("_received") * F.coalesce("_saved", F.lit(1))
    joined = received.join(saved, ["BatchId", "TaskId"], "left").select(
        "TaskId", "BatchId", "RecordsReceived", "Status", copies.alias("_copies")
    )

    delivered = F.when(F.col("Status") == codes.SAVEPOINT_SUCCESS, F.col("RecordsReceived"))
    order = ["BatchId", "RecordsReceived", "Status", START]
    chunks = max_before(chunk_copies(joined, "_copies"), ["TaskId"], order, delivered, "_prior")

    # a second copy already sees the first one
    prior = F.when(F.col("_copy") == 0, F.col("_prior")).otherwise(F.greatest("_prior", delivered))
    count = F.col("RecordsReceived").cast("bigint")
    return spread_copies(chunks, "_copy").select(
        "TaskId", "BatchId", (count - F.coalesce(prior, F.lit(0))).alias("MetricValue")
    )


def manifest_metrics(manifest, savepoint, tasks, created, user,
                     source_id=codes.MANIFEST_SOURCE_ID, version=codes.METRIC_VERSION, strict=True):
    """One metric row per manifest row, counting only what the batch adds."""
    return _metric_rows(
        new_records(manifest, savepoint), tasks, source_id, version, created, user, strict
    )


def metric_feed(savepoint, manifest, tasks, created, user, version=codes.METRIC_VERSION,
                strict=True):
    """Savepoint and manifest metrics together."""
    return savepoint_metrics(savepoint, tasks, created, user, version=version, strict=strict).unionByName(
        manifest_metrics(manifest, savepoint, tasks, created, user, version=version, strict=strict)
    )


def capture_rejects(audit, tasks, count):
    """Audit rows the non-strict capture leaves out: unknown task or no count."""
    known = tasks.select("TaskId", F.lit(True).alias("_known")).distinct()
    reason = F.when(F.col("_known").isNull(), "unknown task").when(F.col(count).isNull(), "no count")
    rejected = join_definitions(audit, known, ["TaskId"], "left").withColumn("Reason", reason)
    return rejected.where(F.col("Reason").isNotNull()).select(*audit.columns, "Reason")


def _with_ids(pairs, sources, metrics, strict):
    known = add_id(pairs, sources, "SourceName", "SourceId", strict)
    return add_id(known, metrics, "MetricName", "MetricId", strict)


def _constants(batch, value, created, user, version):
    return {
        "BatchId": F.lit(batch),
        "MetricVersion": F.lit(version),
        "MetricValue": F.lit(value),
        "CreatedTimeSTamp": F.lit(created),
        "CreatedBy": F.lit(user),
    }


def named_metrics(pairs, sources, metrics, batch, value, created, user,
                  version=codes.METRIC_VERSION, strict=True):
    """One metric row per (SourceName, MetricName) pair."""
    rows = _with_ids(pairs, sources, metrics, strict)
    return conform(rows.withColumns(_constants(batch, value, created, user, version)), METRIC_DATA)


def bulk_metrics(pairs, sources, metrics, batch, value, created, user,
                 version=codes.METRIC_VERSION, start=1, strict=True):
    """`named_metrics`, numbered in the order of the names.

    Equal pairs are counted first, so the lookups and the numbering work on different pairs only.
    """
    names = ["SourceName", "MetricName"]
    chunks = _with_ids(count_copies(pairs, names), sources, metrics, strict)
    chunks = sum_before(chunks, [*names, START], F.col(SIZE), "_earlier")
    rows = spread_copies(chunks, "_copy").withColumns({
        "metricDataId": F.col("_earlier") + F.col("_copy") + start,
        **_constants(batch, value, created, user, version),
    })
    return conform(rows, NUMBERED_METRIC_DATA)
