"""Whole jobs: read from a store, apply an operator, write to a store.

A store is a CatalogStore or a JdbcStore. Rows go from the source to the target in one write. Jobs that
append take a `token`: a CatalogStore appends the rows of one token once, so a lost job is repeated with
the same token. Ids go on from the highest one of the target.
"""

import hashlib
from collections import Counter

from pyspark.sql import Observation, functions as F

from tallyline import codes
from tallyline.operators import capture, changelog, metadata, reconcile, upsert
from tallyline.operators.select import conform, select_where
from tallyline.schemas import LOOKUP, RECONCILIATION_LOG
from tallyline.session import written
from tallyline.sources.files import publish_parquet, read_csv


def _read_once(store, name):
    """A table the job uses twice; one in a database is copied to the shared folder first."""
    return written(store.table(name), name) if store.remote else store.table(name)


def _append(store, rows, name, token):
    if token is None:
        store.write(rows, name)
    else:
        store.append_once(rows, name, token)


def _next_id(store, name, column):
    return (store.last_id(name, column) or 0) + 1


def compact_log(source, target, log="audit_log", output="output_auditlog", token=None):
    """Append the net changes of an audit log."""
    _append(target, changelog.compact_changes(_read_once(source, log)), output, token)


def capture_metrics(source, target, tasks, created, user, output="metric_data", token=None, **options):
    """Append savepoint and manifest metrics."""
    savepoint = _read_once(source, "etlaudit_savepoint")
    feed = capture.metric_feed(savepoint, source.table("manifest"), tasks, created, user, **options)
    _append(target, feed, output, token)


def load_bulk_metrics(store, pairs, batch, value, created, user, token=None, **options):
    """Append one numbered metric row per (SourceName, MetricName) pair."""
    options.setdefault("start", _next_id(store, "metric_data", "metricDataId"))
    rows = capture.bulk_metrics(
        pairs, store.table("source_definition"), store.table("metric_definition"),
        batch, value, created, user, **options,
    )
    _append(store, rows, "metric_data", token)


def reconcile_maps(source, target, map_ids, token=None):
    """Append one reconciliation per map."""
    log = reconcile.recon_by_map(
        source.table("metric_comparision_map"), source.table("comparision_definition"),
        source.table("metric_data"), map_ids,
    )
    numbered = reconcile.number_log(log, start=_next_id(target, "reconciliation_log", "ReconLogId"))
    _append(target, conform(numbered, RECONCILIATION_LOG), "reconciliation_log", token)


def reconcile_batches(source, target, map_ids, on_missing="zero"):
    """Replace the log by one reconciliation per map and new batch."""
    tracker = source.table("metric_batch_tracker")
    log = reconcile.recon_by_batch(
        source.table("metric_comparision_map"), source.table("comparision_definition"),
        tracker, source.table("metric_data"), map_ids, on_missing,
    )
    numbered = conform(reconcile.number_log(log), RECONCILIATION_LOG)
    target.write(numbered, "reconciliation_log", "overwrite")


def insert_if_absent(store, name, incoming, keys=None):
    """Rewrite a table with the rows, or keys, it lacked; doubles already in it are collapsed."""
    existing = store.table(name)
    if keys is None:
        store.replace(upsert.insert_absent_rows(existing, incoming), name)
    else:
        store.replace(upsert.insert_absent_keys(existing, incoming, keys), name)


def append_if_absent(store, name, incoming, keys):
    """Append the rows whose key a table without double keys lacks, without rewriting it."""
    existing = store.table(name)
    store.write(upsert.rows_to_append(existing, incoming, keys), name)


def insert_metric(store, source_name, metric_name, value, batch, created, user, version=codes.METRIC_VERSION):
    """Insert one metric by names unless its source and metric already have one."""
    row = single_metric(
        store.table("source_definition"), store.table("metric_definition"),
        source_name, metric_name, value, batch, created, user, version,
    )
    insert_if_absent(store, "metric_data", row, ["SourceId", "MetricId"])


def single_metric(sources, metrics, source_name, metric_name, value, batch, created, user, version=codes.METRIC_VERSION):
    """One metric row with its ids looked up by name."""
    spark = sources.sparkSession
    pair = spark.createDataFrame([(source_name, metric_name)], "SourceName string, MetricName string")
    return capture.named_metrics(pair, sources, metrics, batch, value, created, user, version)


def lookup_copy(source, target, lookup, splits=None, run=None):
    """Run every lookup row's query and append its result to its target table.

    The driver goes over the lookup rows, which are job definitions; the data stays in Spark. `splits`
    names, for source tables whose queries many tasks shall read, a column and a number of ranges. With
    a `run`, a name, every copy of it is appended once, by a token of the run and the lookup row, and a
    lost run is repeated under its name. Returns (target_table, rows) per lookup row.
    """
    done, before = [], Counter()
    for job in conform(lookup, LOOKUP).toLocalIterator():
        rows = source.query(job.sql_query, (splits or {}).get(job.source_table))
        if run is None:
            seen = Observation()
            target.write(rows.observe(seen, F.count(F.lit(1)).alias("rows")), job.target_table)
            done.append((job.target_table, seen.get["rows"]))
            continue
        before[job] += 1  # equal lookup rows are copies of their own
        copy = hashlib.sha256(repr((*job, before[job])).encode()).hexdigest()[:16]
        done.append((job.target_table, target.append_once(rows, job.target_table, f"{run}-{copy}")))
    return lookup.sparkSession.createDataFrame(done, "target_table string, rows bigint")


def load_job_metadata(spark, path, schema=None, as_of=None, **options):
    """Job metadata of a CSV file, and one completed batch per job."""
    jobs = read_csv(spark, path, schema)
    return jobs, metadata.job_placeholders(jobs, as_of=as_of, **options)


def load_task_metadata(spark, path, schema=None, as_of=None, **options):
    """Task metadata of a CSV file, and one successful savepoint per task."""
    tasks = read_csv(spark, path, schema)
    return tasks, metadata.savepoint_placeholders(tasks, as_of=as_of, **options)


def store_metadata(store, rows, placeholders, rows_table, placeholders_table, token=None):
    """Append metadata and placeholders to existing catalog tables, by position."""
    for kind, df, name in (("rows", rows, rows_table), ("placeholders", placeholders, placeholders_table)):
        store.insert_by_position(df, name, token and f"{token}-{kind}")


def publish_query(store, sql, destination, single_file=False):
    """Replace a parquet folder by a query's result."""
    publish_parquet(store.query(sql), destination, single_file)


def seed_definition(store, rows, columns, name="source_definition", token=None):
    """Append definition rows and read back some columns of the table."""
    _append(store, rows, name, token)
    return select_where(store.table(name), columns)
