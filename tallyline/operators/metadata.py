"""Job and task metadata, and the placeholder run rows that go with them."""

from pyspark.sql import functions as F

from tallyline import codes
from tallyline.functions.columns import seconds


def _moment(as_of):
    return seconds(F.current_timestamp()) if as_of is None else as_of


def _batch_id(job, prefix):
    return F.concat(F.lit(prefix), F.col(job).cast("string"))


def job_placeholders(metadata, job="jobid", prefix=codes.PLACEHOLDER_BATCH_PREFIX, as_of=None):
    """One completed batch row per job row."""
    moment = _moment(as_of)
    return metadata.select(
        _batch_id(job, prefix).alias("BatchId"),
        moment.alias("StartTime"),
        F.lit(codes.JOB_COMPLETED).alias("Status"),
        F.col(job).cast("string").alias("JobId"),
        moment.alias("EndTime"),
    )


def savepoint_placeholders(metadata, job="jobid", prefix=codes.PLACEHOLDER_BATCH_PREFIX, as_of=None):
    """One successful savepoint row, with nothing processed, per task row."""
    moment = _moment(as_of)
    return metadata.select(
        _batch_id(job, prefix).alias("BatchId"),
        F.col(job).cast("string").alias("JobId"),
        F.lit(codes.PLACEHOLDER_TASK_ID).alias("TaskId"),
        moment.alias("StartTime"),
        moment.alias("EndTime"),
        F.lit(None).cast("string").alias("SourceDetail"),
        F.lit(None).cast("string").alias("TargetDetail"),
        F.lit(codes.SAVEPOINT_SUCCESS).alias("Status"),
        F.lit(0).alias("RecordsProcesssed"),
        F.lit("True").alias("IsActive"),
        moment.alias("CreatedTime"),
    )
