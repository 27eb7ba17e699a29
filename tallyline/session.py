"""The folder all executors share, for checkpoints and staged tables."""

import uuid

SETTING = "spark.checkpoint.dir"


def shared_folder(spark):
    """Folder named by ``spark.checkpoint.dir``; without one, a folder in the warehouse, which is shared too."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tallyline-staged"


def scratch_path(spark, name):
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name):
    """`df` from a table in the shared folder: computed once, and the same for every reader."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
