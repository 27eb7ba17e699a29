"""Audit, metric and definition tables derived from the test data, in the shapes of `schemas`.

Every one of them reads whole tables, so it grows with them.
"""

from pyspark.sql import functions as F

SYSTEM_PAIRS = [(1, 1, 2), (2, 2, 1), (3, 1, 1), (4, 1, 9)]


SCHEMAS = {}


def read(spark, sf_dir, name):
    """A table; its schema is kept, so that reading it again starts no job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def _day(at):
    return F.year(at) * 10000 + F.month(at) * 100 + F.dayofmonth(at)


def _month(at):
    return F.year(at) * 100 + F.month(at)


BATCHES = {
    "day": lambda at: _day(at).cast("string"),
    "minute": lambda at: (
        _day(at).cast("bigint") * 10000 + F.hour(at) * 100 + F.minute(at)
    ).cast("string"),
}


def audit_log(spark, sf_dir):
    key = F.col("user_id") * 40 + F.col("event_id") % 31
    by_old_id = F.col("event_id") % 4 == 0
    kind = F.col("event_type")
    old = F.when(F.col("event_id") % 9 == 0, key + 1).otherwise(key)
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.when(~by_old_id, key).alias("id_new"),
        F.when(by_old_id, key).when(kind.isin("error", "view"), old).alias("id_old"),
        F.when(kind.isin("signup", "view"), "I").when(kind.isin("error", "click"), "D")
            .otherwise("U").alias("op_code"),
        F.date_trunc("week", "ts").cast("timestamp_ntz").alias("op_time"),
    )


def manifest(spark, sf_dir, grain="day"):
    """A counter per task: the largest event id seen by the end of a batch."""
    return read(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("TaskId"), BATCHES[grain](F.col("ts")).alias("BatchId")
    ).agg(F.max("event_id").cast("int").alias("RecordsReceived"))


def savepoint(spark, sf_dir, grain="day"):
    return read(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("TaskId"), BATCHES[grain](F.col("ts")).alias("BatchId")
    ).agg(
        F.count(F.when(F.col("value") > 5, 1)).cast("int").alias("RecordsProcesssed"),
        F.when(F.min("event_id") % 3 == 0, "Failed").otherwise("Success").alias("Status"),
    )


def tasks(spark, sf_dir):
    """Metric id per task."""
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("TaskId")).agg(
        (F.min("event_id") + 1).cast("int").alias("MetricId")
    )


METRICS = {
    "priority": lambda: F.substring("o_orderpriority", 1, 1).cast("int"),
    "customer": lambda: F.col("o_custkey").cast("int"),
}


def metric_data(spark, sf_dir, metric="priority"):
    """Source 1 counts orders, source 2 those that have a line.

    The lines are not broadcast: their one column is small in its file, and all of it in the driver's memory.
    """
    by = [METRICS[metric]().alias("MetricId"), _month(F.col("o_orderdate")).cast("string").alias("BatchId")]
    orders = read(spark, sf_dir, "orders")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey")
    ordered = orders.groupBy(*by).agg(F.count("*").alias("MetricValue"))
    shipped = orders.join(lines.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    shipped = shipped.groupBy(*by).agg(F.count("*").alias("MetricValue"))

    def rows(df, source):
        return df.select(
            "MetricId", F.lit(source).alias("SourceId"), "BatchId",
            F.lit("V2").alias("MetricVersion"), "MetricValue",
        )

    return rows(ordered, 1).unionByName(rows(shipped, 2))


def comparision_definition(spark):
    """Plain, reversed, source equals target, target without data."""
    return spark.createDataFrame(SYSTEM_PAIRS, "ComparisionId int, SourceId int, TargetId int")


def supplier_comparisons(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("ComparisionId"),
        F.col("s_nationkey").alias("SourceId"),
        (F.col("s_suppkey") % 25).cast("int").alias("TargetId"),
    )


def metric_comparision_map(spark, sf_dir, metric="priority"):
    ids = F.array(*[F.lit(pair[0]) for pair in SYSTEM_PAIRS])
    return (
        read(spark, sf_dir, "orders").select(METRICS[metric]().alias("MetricId")).distinct()
        .select("MetricId", F.explode(ids).alias("ComparisionId"))
        .select(
            (F.col("MetricId") * 4 + F.col("ComparisionId")).alias("MetricComparisionMapId"),
            "MetricId",
            "ComparisionId",
            (F.col("MetricId") % 7 * 2).alias("ThresholdPercentage"),
        )
    )


def metric_batch_tracker(spark, sf_dir, metric="priority"):
    """Every map with the batches of its metric, and with one batch that has no metric rows.

    Neither side is broadcast, as both grow with the orders.
    """
    orders = read(spark, sf_dir, "orders").withColumn("MetricId", METRICS[metric]())
    months = orders.select("MetricId", _month(F.col("o_orderdate")).cast("string").alias("BatchId"))
    empty = orders.select("MetricId", F.lit("209901").alias("BatchId"))
    batches = months.union(empty).distinct()
    map_id = F.col("MetricComparisionMapId")
    return metric_comparision_map(spark, sf_dir, metric).join(batches.hint("merge"), "MetricId").select(
        "MetricComparisionMapId", "BatchId",
        F.when((map_id + F.col("BatchId").cast("int")) % 4 == 0, "Done").otherwise("New")
            .alias("MetricComparisionStatus"),
    )


def source_definition(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1).alias("SourceId"),
        F.col("n_name").alias("SourceName"),
        F.concat(F.lit("Orders of "), "n_name").alias("SourceDescription"),
    )


def metric_definition(spark, sf_dir):
    """The order priorities."""
    return read(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 3, 99).alias("MetricName")).agg(
        F.min(METRICS["priority"]()).alias("MetricId")
    )


def metric_pairs(spark, sf_dir):
    """One pair of names per order: the customer's nation and the priority."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        read(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("SourceName"),
            F.substring("o_orderpriority", 3, 99).alias("MetricName"),
        )
    )


def order_lines(spark, sf_dir):
    """A table with several rows per key."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"), F.col("l_quantity").alias("quantity"),
        F.col("l_linestatus").alias("status"),
    )


def order_heads(spark, sf_dir):
    """One row per order, typed as text where the table is not."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("orderkey"), F.lit("0").alias("linenumber"),
        F.lit(None).cast("string").alias("partkey"),
        F.col("o_totalprice").alias("quantity"), F.col("o_orderstatus").alias("status"),
    )


def customer_accounts(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nationkey"), F.col("c_mktsegment").alias("segment"),
        F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("balance"),
    )


def supplier_accounts(spark, sf_dir):
    """Accounts without a segment, so with a null in their key."""
    return read(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("nationkey"), F.lit(None).cast("string").alias("segment"),
        F.col("s_suppkey").alias("account"), F.col("s_acctbal").alias("balance"),
    )


def part_notes(spark, sf_dir):
    """Parts with a nested XML text column, some of whose texts read like numbers."""
    size = F.col("p_size").cast("string")
    note = F.struct(
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"),
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("code"), F.concat(size, F.lit(".10")).alias("rate"),
        F.concat(size, F.lit("e5")).alias("limit"),
    )
    return read(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.to_xml(note, {"rowTag": "part"}).alias("blob_column")
    )
