"""Registered queries: one per operator, over the test tables."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import fixtures as fx  # noqa: E402
from oracles import ORACLES  # noqa: E402
from tallyline.operators import capture, changelog, lookup, reconcile, select, upsert, xmlblob  # noqa: E402
from tallyline.plans import jobs  # noqa: E402
from tallyline.session import scratch_path  # noqa: E402
from tallyline.sources import files, xmldump  # noqa: E402
from tallyline.sources.catalog import CatalogStore  # noqa: E402

CREATED, USER = "20240131", "capture"


def _as_of():
    return F.lit("2024-01-15 08:30:00").cast("timestamp_ntz")


def _store(spark):
    """A catalog database of its own, kept in the shared folder."""
    name = f"tallyline_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{scratch_path(spark, name)}'")
    return CatalogStore(spark, name)


# change log

def change_flags(spark, sf_dir):
    return changelog.change_flags(fx.audit_log(spark, sf_dir))


def compact_changes(spark, sf_dir):
    return changelog.compact_changes(fx.audit_log(spark, sf_dir))


# metric capture

def savepoint_metrics(spark, sf_dir):
    return capture.savepoint_metrics(
        fx.savepoint(spark, sf_dir), fx.tasks(spark, sf_dir), CREATED, USER
    )


def _manifest_metrics(grain):
    def query(spark, sf_dir):
        return capture.manifest_metrics(
            fx.manifest(spark, sf_dir, grain), fx.savepoint(spark, sf_dir, grain),
            fx.tasks(spark, sf_dir), CREATED, USER,
        )
    return query


def metric_feed(spark, sf_dir):
    return capture.metric_feed(
        fx.savepoint(spark, sf_dir, "minute"), fx.manifest(spark, sf_dir, "minute"),
        fx.tasks(spark, sf_dir), CREATED, USER,
    )


def capture_rejects(spark, sf_dir):
    known = fx.tasks(spark, sf_dir).where("TaskId <> 'purchase'")
    return capture.capture_rejects(fx.manifest(spark, sf_dir, "minute"), known, "RecordsReceived")


def bulk_metrics(spark, sf_dir):
    return capture.bulk_metrics(
        fx.metric_pairs(spark, sf_dir), fx.source_definition(spark, sf_dir),
        fx.metric_definition(spark, sf_dir), "20240228", 35, "20240228", "bulk",
    )


# reconciliation

def latest_metric_rows(spark, sf_dir):
    return lookup.latest_per_key(fx.metric_data(spark, sf_dir, "customer"), ["MetricId"])


def _by_map(metric, map_ids=None):
    def query(spark, sf_dir):
        return reconcile.recon_by_map(
            fx.metric_comparision_map(spark, sf_dir, metric), fx.comparision_definition(spark),
            fx.metric_data(spark, sf_dir, metric), map_ids,
        )
    return query


def _by_batch(metric, on_missing="zero"):
    def query(spark, sf_dir):
        return reconcile.recon_by_batch(
            fx.metric_comparision_map(spark, sf_dir, metric), fx.comparision_definition(spark),
            fx.metric_batch_tracker(spark, sf_dir, metric), fx.metric_data(spark, sf_dir, metric),
            on_missing=on_missing,
        )
    return query


def recon_log(spark, sf_dir):
    return reconcile.number_log(_by_batch("customer")(spark, sf_dir))


def comparisons_of(spark, sf_dir):
    return reconcile.comparisons_of(fx.supplier_comparisons(spark, sf_dir), 1)


# insert if absent

def insert_absent_rows(spark, sf_dir):
    columns = ["orderkey", "status"]
    return upsert.insert_absent_rows(
        fx.order_lines(spark, sf_dir).select(*columns), fx.order_heads(spark, sf_dir).select(*columns)
    )


def insert_absent_keys(spark, sf_dir):
    return upsert.insert_absent_keys(
        fx.order_lines(spark, sf_dir), fx.order_heads(spark, sf_dir), ["orderkey"]
    )


def insert_absent_keys_with_null(spark, sf_dir):
    return upsert.insert_absent_keys(
        fx.customer_accounts(spark, sf_dir), fx.supplier_accounts(spark, sf_dir),
        ["nationkey", "segment"],
    )


def append_absent_keys(spark, sf_dir):
    suppliers = fx.supplier_accounts(spark, sf_dir)
    return upsert.rows_to_append(
        suppliers, fx.customer_accounts(spark, sf_dir).union(suppliers), ["nationkey", "segment"]
    )


def insert_metric(spark, sf_dir):
    existing = fx.metric_data(spark, sf_dir, "customer")
    row = jobs.single_metric(
        fx.source_definition(spark, sf_dir), fx.metric_definition(spark, sf_dir),
        "NATION_8", "URGENT", 120, "20240229", "20240301", "bulk",
    )
    return upsert.insert_absent_keys(existing, row, ["SourceId", "MetricId"])


# tables

def select_where(spark, sf_dir):
    lines = fx.read(spark, sf_dir, "lineitem")
    return select.select_where(lines, "l_orderkey, l_quantity", ["l_returnflag = 'R'", "l_quantity > 25"])


def catalog_table_scan(spark, sf_dir):
    store = _store(spark)
    orders = fx.read(spark, sf_dir, "orders")
    store.write(orders, "orders", "overwrite")
    return store.table("orders")


def catalog_sql_scan(spark, sf_dir):
    store = _store(spark)
    customers = fx.read(spark, sf_dir, "customer")
    store.write(customers, "customer", "overwrite")
    return store.query(f"SELECT * FROM {store.database}.customer")


def external_table(spark, sf_dir):
    store = _store(spark)
    orders = fx.read(spark, sf_dir, "orders")
    files.publish_table(orders, f"{store.database}.orders", scratch_path(spark, "external"))
    return store.table("orders")


def publish_parquet(spark, sf_dir):
    path = scratch_path(spark, "published")
    lines = fx.read(spark, sf_dir, "lineitem")
    files.publish_parquet(lines, path)
    return spark.read.parquet(path)


def staged_overwrite(spark, sf_dir):
    """A table rewritten with what it lacked, while it is being read."""
    store = _store(spark)
    columns = ["orderkey", "status"]
    store.write(fx.order_lines(spark, sf_dir).select(*columns), "order_status", "overwrite")
    jobs.insert_if_absent(store, "order_status", fx.order_heads(spark, sf_dir).select(*columns))
    return store.table("order_status")


def _lookup_copy(spark, sf_dir):
    source, target = _store(spark), _store(spark)
    for name in ("orders", "customer", "supplier"):
        spark.sql(
            f"CREATE VIEW {source.database}.{name} AS SELECT * FROM parquet.`{sf_dir}/{name}.parquet`"
        )
    copies = [
        ("orders", "SELECT o_custkey AS custkey, o_totalprice AS amount FROM {}.orders", "amounts"),
        ("customer", "SELECT c_custkey AS custkey, c_acctbal AS amount FROM {}.customer", "amounts"),
        ("supplier", "SELECT s_suppkey, s_name FROM {}.supplier", "suppliers"),
    ]
    rows = [(table, sql.format(source.database), to) for table, sql, to in copies]
    names = "source_table string, sql_query string, target_table string"
    return jobs.lookup_copy(source, target, spark.createDataFrame(rows, names)), target


def lookup_copy(spark, sf_dir):
    return _lookup_copy(spark, sf_dir)[0]


def lookup_copy_rows(spark, sf_dir):
    return _lookup_copy(spark, sf_dir)[1].table("amounts")


# jobs that write, on stores of the catalog; each reads back what it wrote

def _recon_store(spark, sf_dir, metric):
    store = _store(spark)
    for name, rows in {
        "metric_comparision_map": fx.metric_comparision_map(spark, sf_dir, metric),
        "comparision_definition": fx.comparision_definition(spark),
        "metric_batch_tracker": fx.metric_batch_tracker(spark, sf_dir, metric),
        "metric_data": fx.metric_data(spark, sf_dir, metric),
    }.items():
        store.write(rows, name, "overwrite")
    return store


def job_compact_log(spark, sf_dir):
    source, target = _store(spark), _store(spark)
    source.write(fx.audit_log(spark, sf_dir), "audit_log", "overwrite")
    jobs.compact_log(source, target)
    return target.table("output_auditlog")


def job_capture_metrics(spark, sf_dir):
    source, target = _store(spark), _store(spark)
    source.write(fx.savepoint(spark, sf_dir, "minute"), "etlaudit_savepoint", "overwrite")
    source.write(fx.manifest(spark, sf_dir, "minute"), "manifest", "overwrite")
    jobs.capture_metrics(source, target, fx.tasks(spark, sf_dir), CREATED, USER)
    return target.table("metric_data")


def job_reconcile_maps(spark, sf_dir):
    store = _recon_store(spark, sf_dir, "priority")
    jobs.reconcile_maps(store, store, "5,6,7,12")
    return store.table("reconciliation_log")


def job_reconcile_batches(spark, sf_dir):
    store = _recon_store(spark, sf_dir, "customer")
    jobs.reconcile_batches(store, store, None)
    return store.table("reconciliation_log")


def job_load_bulk_metrics(spark, sf_dir):
    store = _store(spark)
    store.write(fx.source_definition(spark, sf_dir), "source_definition", "overwrite")
    store.write(fx.metric_definition(spark, sf_dir), "metric_definition", "overwrite")
    jobs.load_bulk_metrics(store, fx.metric_pairs(spark, sf_dir), "20240228", 35, "20240228", "bulk")
    return store.table("metric_data")


def job_store_metadata(spark, sf_dir):
    """Suppliers as jobs, and a placeholder of each, added by position to tables that have some."""
    store = _store(spark)
    rows, placeholders = _jobs(spark, sf_dir)
    store.write(rows.limit(0), "jobmetadata", "overwrite")
    store.write(placeholders.limit(0), "batch", "overwrite")
    jobs.store_metadata(store, rows, placeholders, "jobmetadata", "batch")
    kept = store.table("jobmetadata").withColumnRenamed("jobid", "id")
    return kept.join(store.table("batch"), F.col("id") == F.col("JobId")).select(
        "jobname", "cost", "BatchId", "Status"
    )


def job_publish_query(spark, sf_dir):
    store, path = _store(spark), scratch_path(spark, "published")
    store.write(fx.read(spark, sf_dir, "customer"), "customer", "overwrite")
    jobs.publish_query(store, f"SELECT c_nationkey, c_name FROM {store.database}.customer WHERE c_acctbal > 0", path)
    return spark.read.parquet(path)


def _csv(df, spark, name):
    path = scratch_path(spark, name)
    df.write.option("header", True).csv(path)
    return path


def _jobs(spark, sf_dir):
    suppliers = fx.read(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS jobid", "s_name AS jobname", "s_acctbal AS cost"
    )
    schema = spark.createDataFrame([], "jobid string, jobname string, cost double").schema
    return jobs.load_job_metadata(spark, _csv(suppliers, spark, "jobs"), schema, as_of=_as_of())


def _tasks(spark, sf_dir):
    customers = fx.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS jobid", "c_name AS taskname", "c_nationkey AS priority"
    )
    schema = spark.createDataFrame([], "jobid string, taskname string, priority int").schema
    return jobs.load_task_metadata(spark, _csv(customers, spark, "tasks"), schema, as_of=_as_of())


def seed_definitions(spark, sf_dir):
    store = _store(spark)
    suppliers = fx.read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("SourceId"),
        F.col("s_name").alias("SourceName"),
        F.concat(F.lit("Supplier of nation "), "s_nationkey").alias("SourceDescription"),
        F.col("s_nationkey").alias("Nation"),
    )
    seeded = jobs.seed_definition(
        store, suppliers, ["SourceId", "SourceName", "SourceDescription", "Nation"]
    )
    return select.select_where(seeded, "SourceId, SourceName, SourceDescription", "Nation > 4")


def _part_dump(spark, sf_dir):
    path = scratch_path(spark, "parts")
    xmldump.write_dump(fx.part_notes(spark, sf_dir), path, "part")
    return path


def xml_dump_rows(spark, sf_dir):
    return xmldump.dump_rows(spark, _part_dump(spark, sf_dir), ["p_partkey", "p_size", "p_retailprice"])


def xml_blob_json(spark, sf_dir):
    rows = xmldump.dump_rows(spark, _part_dump(spark, sf_dir), ["p_partkey", "blob_column"])
    return xmlblob.blob_to_json(rows, "blob_column").select("p_partkey", "json")


QUERIES = {
    "change_flags": change_flags,
    "compact_changes": compact_changes,
    "savepoint_metrics": savepoint_metrics,
    "manifest_metrics": _manifest_metrics("day"),
    "manifest_metrics_by_minute": _manifest_metrics("minute"),
    "metric_feed": metric_feed,
    "capture_rejects": capture_rejects,
    "bulk_metrics": bulk_metrics,
    "latest_metric_rows": latest_metric_rows,
    "recon_by_map": _by_map("priority"),
    "recon_by_map_selected": _by_map("priority", "5,6,7,12"),
    "recon_by_map_customers": _by_map("customer"),
    "recon_by_batch": _by_batch("priority"),
    "recon_by_batch_found": _by_batch("priority", "skip"),
    "recon_by_batch_customers": _by_batch("customer"),
    "recon_log": recon_log,
    "comparisons_of": comparisons_of,
    "insert_absent_rows": insert_absent_rows,
    "insert_absent_keys": insert_absent_keys,
    "insert_absent_keys_with_null": insert_absent_keys_with_null,
    "append_absent_keys": append_absent_keys,
    "insert_metric": insert_metric,
    "select_where": select_where,
    "catalog_table_scan": catalog_table_scan,
    "catalog_sql_scan": catalog_sql_scan,
    "external_table": external_table,
    "publish_parquet": publish_parquet,
    "staged_overwrite": staged_overwrite,
    "lookup_copy": lookup_copy,
    "lookup_copy_rows": lookup_copy_rows,
    "job_metadata": lambda spark, sf_dir: _jobs(spark, sf_dir)[0],
    "job_placeholders": lambda spark, sf_dir: _jobs(spark, sf_dir)[1],
    "task_metadata": lambda spark, sf_dir: _tasks(spark, sf_dir)[0],
    "savepoint_placeholders": lambda spark, sf_dir: _tasks(spark, sf_dir)[1],
    "seed_definitions": seed_definitions,
    "xml_dump_rows": xml_dump_rows,
    "xml_blob_json": xml_blob_json,
    "job_compact_log": job_compact_log,
    "job_capture_metrics": job_capture_metrics,
    "job_reconcile_maps": job_reconcile_maps,
    "job_reconcile_batches": job_reconcile_batches,
    "job_load_bulk_metrics": job_load_bulk_metrics,
    "job_store_metadata": job_store_metadata,
    "job_publish_query": job_publish_query,
}
CORE = dict(QUERIES)


MORE_ORACLES = {}
try:
    import corpus_pipeline
    from tallyline.llm import queries as llm
except ImportError:
    pass
else:
    QUERIES |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    MORE_ORACLES = llm.ORACLES | {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else llm.ORACLES


def entry(spark: SparkSession) -> DataFrame:
    """Reconciliation per comparison map and batch."""
    return QUERIES["recon_by_batch"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return ORACLES | MORE_ORACLES
