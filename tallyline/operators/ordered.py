"""Totals over earlier rows, and numbering, without pulling an order into one task.

A window that is ordered over everything, or over a few big groups, runs in one task per group. Here
the input is written once, and Spark's range partitioning cuts the order into as many slices as there
are shuffle partitions. What each slice says of its own rows is written with the number of the slice, and
a table of one total per slice is summed up from it. Totals are carried over slices in two levels, inside
groups of GROUP slices and over the groups, so that no window sees more than GROUP slices, or as many
groups. A row keeps its slice from then on, also after a task is lost.
"""

from pyspark.sql import Window, functions as F

from tallyline.session import written

SLICE = "_slice"
START = "_start"
SIZE = "_size"

GROUP = 1000  # slices whose totals meet in one window
PLACES = 33  # bits of a row's place in its slice

# copies of one row that travel together
CHUNK = 10_000


def _long(number):
    return F.lit(number).cast("bigint")


def count_copies(df, columns):
    """One row per different value of `columns`, cut into chunks of copies.

    Copies are counted before the shuffle, so a row repeated without bound costs one row per task.
    """
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    return chunk_copies(counted, "_copies")


def chunk_copies(df, copies):
    """Rows cut into chunks of CHUNK copies, in two steps, so that no array holds more than CHUNK numbers."""
    wide = CHUNK * CHUNK
    total = F.col(copies)
    outer = df.withColumn("_outer", F.explode(F.sequence(_long(0), total - 1, _long(wide))))
    inner = F.sequence(F.col("_outer"), F.least(F.col("_outer") + wide, total) - 1, _long(CHUNK))
    return (
        outer.withColumn(START, F.explode(inner))
        .withColumn(SIZE, F.least(_long(CHUNK), total - F.col(START)))
        .drop(copies, "_outer")
    )


def spread_copies(chunks, position):
    """Undo `count_copies`; `position` counts the copies inside their chunk from 0."""
    places = F.when(F.col(SIZE) == 1, F.array(_long(0))).otherwise(F.sequence(_long(0), F.col(SIZE) - 1))
    return chunks.withColumn(position, F.explode(places)).drop(START, SIZE)


def _ascending(columns):
    return [F.col(c).asc_nulls_first() for c in columns]


def _slices(df):
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df, order):
    """Rows dealt to ordered slices of about equal size.

    Spark looks at the rows once for the bounds and once to deal them, so they are written first.
    """
    return written(df, "unordered").repartitionByRange(_slices(df), *_ascending(order))


def _carried(totals, by, aggregate, combine):
    """From (by, SLICE, `_total`) the total of all earlier slices as `_carried`, in two levels.

    It is written, so that Spark knows its size and shuffles no rows to join it where it is small.
    """
    keys = [F.col(c).alias(f"_at_{c}") for c in [*by, SLICE]]

    def earlier(within, order):
        return aggregate("_total").over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))

    if _slices(totals) <= GROUP:
        return written(totals.select(*keys, combine(F.lit(None), earlier(by, SLICE)).alias("_carried")), "carried")
    grouped = totals.withColumn("_group", F.floor(F.col(SLICE) / GROUP))
    near = grouped.withColumn("_near", earlier([*by, "_group"], SLICE))
    of_groups = grouped.groupBy(*by, "_group").agg(aggregate("_total").alias("_total"))
    far = of_groups.select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_group"]], earlier(by, "_group").alias("_far"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*by, "_group"]]
    return written(near.join(far, same).select(*keys, combine(F.col("_far"), F.col("_near")).alias("_carried")), "carried")


def _before(df, by, order, value, name, aggregate, combine):
    sliced = _ranged(df.withColumn("_value", value), [*by, *order]).withColumn(SLICE, F.spark_partition_id())
    in_slice = Window.partitionBy(SLICE, *by).orderBy(*_ascending(order)).rowsBetween(Window.unboundedPreceding, -1)
    sliced = written(sliced.withColumn("_inside", aggregate("_value").over(in_slice)), "slices")
    totals = sliced.groupBy(*by, SLICE).agg(aggregate("_value").alias("_total"))
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in [*by, SLICE]]
    return sliced.join(_carried(totals, by, aggregate, combine), same, "left").select(
        *df.columns, combine(F.col("_carried"), F.col("_inside")).alias(name)
    )


def max_before(df, by, order, value, name):
    """Largest `value` among the rows of the same `by` group that come earlier in `order`."""
    return _before(df, by, order, value, name, F.max, lambda a, b: F.greatest(a, b))


def _added(a, b):
    return F.coalesce(a, _long(0)) + F.coalesce(b, _long(0))


def sum_before(df, order, value, name):
    """Sum of `value` over all rows that come earlier in `order`."""
    return _before(df, [], order, value, name, F.sum, _added)


def number_rows(df, order, name, start=1):
    """Consecutive BIGINT ids from `start` in `order`, as the first column.

    Each sorted slice numbers its own rows as it is written; the sizes of the slices are then read from
    the one column of these numbers.
    """
    placed = _ranged(df, order).sortWithinPartitions(*_ascending(order)).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "numbered")
    of_slice = F.shiftright("_at", PLACES).cast("int")
    sizes = placed.groupBy(of_slice.alias(SLICE)).agg(F.count(F.lit(1)).alias("_total"))
    offsets = _carried(sizes, [], F.sum, _added)
    place = F.col("_at").bitwiseAND(_long((1 << PLACES) - 1))
    return placed.join(offsets, of_slice == F.col(f"_at_{SLICE}")).select(
        (F.col("_carried") + place + start).alias(name), *df.columns
    )
