"""Column helpers shared by the operators. All of them stay built-in expressions."""

from pyspark.sql import functions as F

from tallyline import codes


def distinct_ids(first, second):
    """Array of the different ids of a row; a null one only where both are null."""
    return (
        F.when(second.isNull() | (first == second), F.array(first))
        .when(first.isNull(), F.array(second))
        .otherwise(F.array(first, second))
    )


def within_threshold(deviation, threshold):
    return F.when(deviation <= threshold, codes.PASSED).otherwise(codes.FAILED)


def id_list(ids):
    """Ids given as a list or as comma-separated text, as ints."""
    if isinstance(ids, str):
        ids = ids.split(",")
    return [int(i) for i in ids]


def required(value, problem):
    """`value`, failing the job with `problem` where it is null."""
    return F.when(value.isNull(), F.raise_error(problem)).otherwise(value)


def seconds(moment):
    return F.date_trunc("second", moment)
