"""Schemas of the tables the operators read and write.

Column names keep the spelling used in the stored data. Counted values are BIGINT, wider than the
stored INT, so differences never wrap.
"""

from pyspark.sql.types import (
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _schema(**columns):
    return StructType([StructField(name, kind) for name, kind in columns.items()])


INT, LONG, TEXT, TIME = IntegerType(), LongType(), StringType(), TimestampType()

SOURCE_DEFINITION = _schema(
    SourceId=INT, SourceName=TEXT, SourceDescription=TEXT,
    CreatedBy=TEXT, CreatedDt=TEXT, UpdatedBy=TEXT, UpdatedDt=TEXT,
)
METRIC_DEFINITION = _schema(MetricId=INT, MetricName=TEXT, MetricDescription=TEXT)
COMPARISION_DEFINITION = _schema(ComparisionId=INT, SourceId=INT, TargetId=INT)
METRIC_COMPARISION_MAP = _schema(
    MetricComparisionMapId=INT, MetricId=INT, ComparisionId=INT, ThresholdPercentage=INT,
)
METRIC_DATA = _schema(
    MetricId=INT, SourceId=INT, BatchId=TEXT, MetricVersion=TEXT,
    MetricValue=LONG, CreatedTimeSTamp=TEXT, CreatedBy=TEXT,
)
NUMBERED_METRIC_DATA = StructType([StructField("metricDataId", LONG)] + METRIC_DATA.fields)
METRIC_BATCH_TRACKER = _schema(
    metricbatchtrackerid=INT, BatchId=TEXT, MetricComparisionMapId=INT,
    MetricComparisionStatus=TEXT,
)
RECONCILIATION_LOG = _schema(
    ReconLogId=LONG, MetricComparisionMapId=INT, MetricBatch=TEXT, MetricVersion=TEXT,
    SourceId=INT, SourceValue=LONG, TargetId=INT, TargetValue=LONG,
    ThresholdPercentage=INT, DeviationPercentage=LONG, ReconStatus=TEXT,
)
ETLAUDIT_SAVEPOINT = _schema(TaskId=TEXT, RecordsProcesssed=INT, BatchId=TEXT, Status=TEXT)
MANIFEST = _schema(TaskId=TEXT, RecordsReceived=INT, BatchId=TEXT)
LOOKUP = _schema(source_table=TEXT, sql_query=TEXT, target_table=TEXT)
JOB_BATCH = _schema(BatchId=TEXT, StartTime=TIME, Status=TEXT, JobId=TEXT, EndTime=TIME)
JOB_SAVEPOINT = _schema(
    BatchId=TEXT, JobId=TEXT, TaskId=TEXT, StartTime=TIME, EndTime=TIME,
    SourceDetail=TEXT, TargetDetail=TEXT, Status=TEXT, RecordsProcesssed=INT, IsActive=TEXT,
    CreatedTime=TIME,
)
PLAYERS = _schema(id=INT, name=TEXT, age=INT)
