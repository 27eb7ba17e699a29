"""Projection with conditions, and casting to a stored schema."""

from pyspark.sql import functions as F


def select_where(df, columns, conditions=None):
    """`columns` of the rows meeting every condition; both may be one string or a list."""
    if isinstance(columns, str):
        columns = [c.strip() for c in columns.split(",")]
    if isinstance(conditions, str):
        conditions = [conditions]
    for condition in conditions or []:
        df = df.where(condition)
    return df.select(*columns)


def conform(df, schema):
    """Columns of `schema`, taken by name and cast to its types, in its order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
