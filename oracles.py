"""The registered queries as plain SQL over the same tables."""

AUDIT_LOG = """
audit_log AS (
  SELECT event_id,
    CASE WHEN event_id % 4 <> 0 THEN k END AS id_new,
    CASE WHEN event_id % 4 = 0 THEN k
         WHEN event_type IN ('error', 'view')
         THEN CASE WHEN event_id % 9 = 0 THEN k + 1 ELSE k END END AS id_old,
    CASE WHEN event_type IN ('signup', 'view') THEN 'I'
         WHEN event_type IN ('error', 'click') THEN 'D' ELSE 'U' END AS op_code,
    CAST(date_trunc('week', ts) AS TIMESTAMP) AS op_time
  FROM (SELECT *, user_id * 40 + event_id % 31 AS k FROM events) e)
"""

# every latest change side by side with the other latest changes of its id
CHANGE_FLAGS = """
changes AS (
  SELECT coalesce(id_new, id_old) AS id, op_code, op_time,
    CASE op_code WHEN 'I' THEN 1 WHEN 'U' THEN 2 ELSE 3 END AS kind
  FROM audit_log),
latest AS (
  SELECT id, op_code, op_time, kind FROM (
    SELECT *, row_number() OVER (PARTITION BY id, kind
      ORDER BY op_time DESC NULLS LAST, op_code DESC NULLS LAST) AS n
    FROM changes WHERE id IS NOT NULL) r
  WHERE n = 1),
change_flags AS (
  SELECT c.id, c.op_time, c.op_code,
    CASE WHEN
      CASE c.kind
        WHEN 1 THEN CASE WHEN u.id IS NOT NULL THEN u.op_time = c.op_time
                         ELSE o.op_code = 'D' AND o.op_time = c.op_time END
        WHEN 2 THEN o.op_code = 'D' AND o.op_time = c.op_time
        ELSE c.op_code = 'D' AND i.op_time = c.op_time AND (u.id IS NULL OR u.op_time = c.op_time)
      END THEN 'No' ELSE 'Yes' END AS "Flag"
  FROM latest c
  LEFT JOIN latest i ON i.id = c.id AND i.kind = 1
  LEFT JOIN latest u ON u.id = c.id AND u.kind = 2
  LEFT JOIN latest o ON o.id = c.id AND o.kind = 3)
"""

DAY = "year(ts) * 10000 + month(ts) * 100 + day(ts)"
BATCHES = {
    "day": f"CAST({DAY} AS VARCHAR)",
    "minute": f"CAST(CAST({DAY} AS BIGINT) * 10000 + hour(ts) * 100 + minute(ts) AS VARCHAR)",
}


def audit(grain):
    batch = BATCHES[grain]
    return f"""
manifest AS (
  SELECT event_type AS "TaskId", {batch} AS "BatchId", MAX(event_id) AS "RecordsReceived"
  FROM events GROUP BY 1, 2),
savepoint AS (
  SELECT event_type AS "TaskId", {batch} AS "BatchId",
    COUNT(CASE WHEN value > 5 THEN 1 END) AS "RecordsProcesssed",
    CASE WHEN MIN(event_id) % 3 = 0 THEN 'Failed' ELSE 'Success' END AS "Status"
  FROM events GROUP BY 1, 2),
tasks AS (
  SELECT event_type AS "TaskId", MIN(event_id) + 1 AS "MetricId" FROM events GROUP BY 1),
savepoint_metrics AS (
  SELECT CAST("MetricId" AS INTEGER) AS "MetricId", 1 AS "SourceId", "BatchId",
    'V2' AS "MetricVersion", CAST("RecordsProcesssed" AS BIGINT) AS "MetricValue",
    '20240131' AS "CreatedTimeSTamp", 'capture' AS "CreatedBy"
  FROM savepoint JOIN tasks USING ("TaskId")),
lagged AS (
  SELECT m."TaskId", m."BatchId", m."RecordsReceived",
    MAX(CASE WHEN s."Status" = 'Success' THEN m."RecordsReceived" END) OVER (
      PARTITION BY m."TaskId"
      ORDER BY m."BatchId", m."RecordsReceived", s."Status" NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
  FROM manifest m
  LEFT JOIN savepoint s ON s."BatchId" = m."BatchId" AND s."TaskId" = m."TaskId"),
manifest_metrics AS (
  SELECT CAST("MetricId" AS INTEGER) AS "MetricId", 2 AS "SourceId", "BatchId",
    'V2' AS "MetricVersion", CAST("RecordsReceived" - coalesce(prior, 0) AS BIGINT) AS "MetricValue",
    '20240131' AS "CreatedTimeSTamp", 'capture' AS "CreatedBy"
  FROM lagged JOIN tasks USING ("TaskId"))
"""


MONTH = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS VARCHAR)"
METRICS = {
    "priority": "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)",
    "customer": "CAST(o_custkey AS INTEGER)",
}


def recon_tables(metric):
    by = METRICS[metric]
    return f"""
metric_data AS (
  SELECT {by} AS "MetricId", 1 AS "SourceId", {MONTH} AS "BatchId", 'V2' AS "MetricVersion",
    COUNT(*) AS "MetricValue" FROM orders GROUP BY 1, 3
  UNION ALL
  SELECT {by}, 2, {MONTH}, 'V2', COUNT(DISTINCT o_orderkey)
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 3),
defs AS (SELECT * FROM (VALUES (1, 1, 2), (2, 2, 1), (3, 1, 1), (4, 1, 9))
         t("ComparisionId", "SourceId", "TargetId")),
maps AS (
  SELECT m."MetricId" * 4 + d."ComparisionId" AS "MetricComparisionMapId", m."MetricId",
    d."ComparisionId", m."MetricId" % 7 * 2 AS "ThresholdPercentage"
  FROM (SELECT DISTINCT {by} AS "MetricId" FROM orders) m CROSS JOIN defs d),
tracker AS (
  SELECT "MetricComparisionMapId", "BatchId",
    CASE WHEN ("MetricComparisionMapId" + CAST("BatchId" AS INTEGER)) % 4 = 0 THEN 'Done'
         ELSE 'New' END AS "MetricComparisionStatus"
  FROM maps JOIN (
    SELECT DISTINCT {by} AS "MetricId", {MONTH} AS "BatchId" FROM orders
    UNION SELECT {by}, '209901' FROM orders) b USING ("MetricId"))
"""


def by_map(condition="TRUE"):
    order = '"BatchId" DESC, "MetricVersion" DESC, sid DESC, val DESC'
    return f"""
j AS (
  SELECT m."MetricComparisionMapId" AS map, m."ThresholdPercentage" AS thr, d."SourceId" AS src,
    d."TargetId" AS tgt, x."SourceId" AS sid, x."BatchId", x."MetricVersion", x."MetricValue" AS val
  FROM maps m JOIN defs d ON d."ComparisionId" = m."ComparisionId"
  JOIN metric_data x ON x."MetricId" = m."MetricId" AND (x."SourceId" = d."SourceId" OR x."SourceId" = d."TargetId")
  WHERE {condition}),
last_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map ORDER BY {order}) AS n FROM j) q WHERE n = 1),
source_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map ORDER BY {order}) AS n
  FROM j WHERE sid = src AND val <> 0) q WHERE n = 1),
target_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY map ORDER BY {order}) AS n
  FROM j WHERE sid = tgt AND val <> 0) q WHERE n = 1),
folded AS (
  SELECT l.map, l."BatchId" AS batch, l."MetricVersion" AS version, l.thr,
    coalesce(s.sid, 0) AS sid, coalesce(s.val, 0) AS sval,
    coalesce(t.sid, 0) AS tid, coalesce(t.val, 0) AS tval
  FROM last_row l LEFT JOIN source_row s ON s.map = l.map LEFT JOIN target_row t ON t.map = l.map)
"""


def by_batch(missing="LEFT JOIN"):
    return f"""
j AS (
  SELECT t."MetricComparisionMapId" AS map, t."BatchId" AS batch, m."ThresholdPercentage" AS thr,
    d."SourceId" AS src, x."SourceId" AS sid, x."MetricVersion" AS ver, x."MetricValue" AS val
  FROM (SELECT DISTINCT "MetricComparisionMapId", "BatchId" FROM tracker
        WHERE "MetricComparisionStatus" = 'New') t
  JOIN maps m ON m."MetricComparisionMapId" = t."MetricComparisionMapId"
  JOIN defs d ON d."ComparisionId" = m."ComparisionId"
  {missing} metric_data x ON x."MetricId" = m."MetricId" AND x."BatchId" = t."BatchId"
    AND x."SourceId" IN (d."SourceId", d."TargetId")),
folded AS (
  SELECT map, batch, coalesce(MAX(ver), '') AS version,
    coalesce(MAX(CASE WHEN sid IS NOT NULL THEN thr END), 0) AS thr,
    coalesce(MAX(CASE WHEN sid = src THEN sid END), 0) AS sid,
    coalesce(MAX(CASE WHEN sid = src THEN val END), 0) AS sval,
    coalesce(MAX(CASE WHEN sid <> src THEN sid END), 0) AS tid,
    coalesce(MAX(CASE WHEN sid <> src THEN val END), 0) AS tval
  FROM j GROUP BY map, batch)
"""


LOG = """map AS "MetricComparisionMapId", batch AS "MetricBatch", version AS "MetricVersion",
  sid AS "SourceId", sval AS "SourceValue", tid AS "TargetId", tval AS "TargetValue",
  thr AS "ThresholdPercentage", abs(tval - sval) AS "DeviationPercentage",
  CASE WHEN abs(tval - sval) <= thr THEN 'Passed' ELSE 'Failed' END AS "ReconStatus"
"""

LINES = """SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey,
  l_quantity AS quantity, l_linestatus AS status FROM lineitem"""
HEADS = """SELECT o_orderkey AS orderkey, 0 AS linenumber, CAST(NULL AS BIGINT) AS partkey,
  o_totalprice AS quantity, o_orderstatus AS status FROM orders"""
ACCOUNTS = """SELECT c_nationkey AS nationkey, c_mktsegment AS segment, c_custkey AS account,
  c_acctbal AS balance FROM customer"""
SUPPLIERS = """SELECT s_nationkey AS nationkey, CAST(NULL AS VARCHAR) AS segment,
  s_suppkey AS account, s_acctbal AS balance FROM supplier"""


def first_per_key(existing, incoming, keys, rest):
    order = ", ".join(f"{c} NULLS FIRST" for c in ["origin", *rest])
    return f"""SELECT {", ".join([*keys, *rest])} FROM (
  SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)} ORDER BY {order}) AS n
  FROM (SELECT 0 AS origin, e.* FROM ({existing}) e UNION ALL SELECT 1, i.* FROM ({incoming}) i) b
) r WHERE n = 1"""


def appended(existing, incoming, keys, rest):
    order = ", ".join(f"{c} NULLS FIRST" for c in rest)
    same = " AND ".join(f"e.{k} IS NOT DISTINCT FROM r.{k}" for k in keys)
    return f"""SELECT {", ".join([*keys, *rest])} FROM (
  SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)} ORDER BY {order}) AS n
  FROM ({incoming}) i) r
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM ({existing}) e WHERE {same})"""


def bulk(select):
    return f"""
WITH pairs AS (
  SELECT n_name AS "SourceName", substr(o_orderpriority, 3) AS "MetricName"
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
sources AS (SELECT n_name AS "SourceName", n_nationkey + 1 AS "SourceId" FROM nation),
metrics AS (SELECT substr(o_orderpriority, 3) AS "MetricName",
  MIN(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS "MetricId" FROM orders GROUP BY 1)
{select}"""


MOMENT = "TIMESTAMP '2024-01-15 08:30:00'"

ORACLES = {
    "change_flags": f"WITH {AUDIT_LOG}, {CHANGE_FLAGS} SELECT * FROM change_flags",
    "compact_changes": f"""WITH {AUDIT_LOG}, {CHANGE_FLAGS}
SELECT m.* FROM audit_log m JOIN change_flags k
  ON (m.id_new = k.id OR m.id_old = k.id) AND m.op_time = k.op_time AND m.op_code = k.op_code
WHERE k."Flag" = 'Yes'""",
    "savepoint_metrics": f"WITH {audit('day')} SELECT * FROM savepoint_metrics",
    "manifest_metrics": f"WITH {audit('day')} SELECT * FROM manifest_metrics",
    "manifest_metrics_by_minute": f"WITH {audit('minute')} SELECT * FROM manifest_metrics",
    "metric_feed": f"""WITH {audit('minute')}
SELECT * FROM savepoint_metrics UNION ALL SELECT * FROM manifest_metrics""",
    "capture_rejects": f"""WITH {audit('minute')}
SELECT "TaskId", "BatchId", CAST("RecordsReceived" AS INTEGER) AS "RecordsReceived",
  'unknown task' AS "Reason" FROM manifest
WHERE "TaskId" = 'purchase'""",
    "bulk_metrics": bulk("""SELECT row_number() OVER (ORDER BY "SourceName", "MetricName") AS "metricDataId",
  "MetricId", "SourceId", '20240228' AS "BatchId", 'V2' AS "MetricVersion", CAST(35 AS BIGINT) AS "MetricValue",
  '20240228' AS "CreatedTimeSTamp", 'bulk' AS "CreatedBy"
FROM pairs JOIN sources USING ("SourceName") JOIN metrics USING ("MetricName")"""),
    "latest_metric_rows": f"""WITH {recon_tables('customer')}
SELECT "MetricId", "SourceId", "BatchId", "MetricVersion", "MetricValue" FROM (
  SELECT *, row_number() OVER (PARTITION BY "MetricId"
    ORDER BY "SourceId" DESC, "BatchId" DESC, "MetricValue" DESC) AS n FROM metric_data) r
WHERE n = 1""",
    "recon_by_map": f"WITH {recon_tables('priority')}, {by_map()} SELECT {LOG} FROM folded",
    "recon_by_map_selected": f"""WITH {recon_tables('priority')},
{by_map('m."MetricComparisionMapId" IN (5, 6, 7, 12)')} SELECT {LOG} FROM folded""",
    "recon_by_map_customers": f"WITH {recon_tables('customer')}, {by_map()} SELECT {LOG} FROM folded",
    "recon_by_batch": f"WITH {recon_tables('priority')}, {by_batch()} SELECT {LOG} FROM folded",
    "recon_by_batch_found": f"WITH {recon_tables('priority')}, {by_batch('JOIN')} SELECT {LOG} FROM folded",
    "recon_by_batch_customers": f"WITH {recon_tables('customer')}, {by_batch()} SELECT {LOG} FROM folded",
    "recon_log": f"""WITH {recon_tables('customer')}, {by_batch()}
SELECT row_number() OVER (ORDER BY map, batch) AS "ReconLogId", {LOG} FROM folded""",
    "comparisons_of": """SELECT CAST(s_suppkey AS INTEGER) AS "ComparisionId", s_nationkey AS "SourceId",
  CAST(s_suppkey % 25 AS INTEGER) AS "TargetId" FROM supplier WHERE s_nationkey = 1 OR s_suppkey % 25 = 1""",
    "insert_absent_rows": f"""SELECT orderkey, status FROM ({LINES}) e
UNION SELECT orderkey, status FROM ({HEADS}) i""",
    "insert_absent_keys": first_per_key(
        LINES, HEADS, ["orderkey"], ["linenumber", "partkey", "quantity", "status"]),
    "insert_absent_keys_with_null": first_per_key(
        ACCOUNTS, SUPPLIERS, ["nationkey", "segment"], ["account", "balance"]),
    "append_absent_keys": appended(
        SUPPLIERS, ACCOUNTS + " UNION ALL " + SUPPLIERS, ["nationkey", "segment"],
        ["account", "balance"]),
    "insert_metric": f"""WITH {recon_tables('customer')}, {{bulk_names}}
SELECT "MetricId", "SourceId", "BatchId", "MetricVersion", "MetricValue" FROM (
  SELECT *, row_number() OVER (PARTITION BY "SourceId", "MetricId"
    ORDER BY origin, "BatchId", "MetricVersion", "MetricValue") AS n
  FROM (SELECT 0 AS origin, * FROM metric_data
        UNION ALL SELECT 1, "MetricId", "SourceId", '20240229', 'V2', 120 FROM named) b) r
WHERE n = 1""".replace("{bulk_names}", """named AS (
  SELECT (SELECT MIN(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) FROM orders
          WHERE substr(o_orderpriority, 3) = 'URGENT') AS "MetricId",
         (SELECT n_nationkey + 1 FROM nation WHERE n_name = 'NATION_8') AS "SourceId")"""),
    "select_where": """SELECT l_orderkey, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity > 25""",
    "catalog_table_scan": "SELECT * FROM orders",
    "catalog_sql_scan": "SELECT * FROM customer",
    "external_table": "SELECT * FROM orders",
    "publish_parquet": "SELECT * FROM lineitem",
    "staged_overwrite": f"""SELECT orderkey, status FROM ({LINES}) e
UNION SELECT orderkey, status FROM ({HEADS}) i""",
    "lookup_copy": """SELECT 'amounts' AS target_table, COUNT(*) AS rows FROM orders
UNION ALL SELECT 'amounts', COUNT(*) FROM customer
UNION ALL SELECT 'suppliers', COUNT(*) FROM supplier""",
    "lookup_copy_rows": """SELECT o_custkey AS custkey, o_totalprice AS amount FROM orders
UNION ALL SELECT c_custkey, c_acctbal FROM customer""",
    "job_metadata": """SELECT CAST(s_suppkey AS VARCHAR) AS jobid, s_name AS jobname,
  s_acctbal AS cost FROM supplier""",
    "job_placeholders": f"""SELECT '20210917' || s_suppkey AS "BatchId", {MOMENT} AS "StartTime",
  'Completed' AS "Status", CAST(s_suppkey AS VARCHAR) AS "JobId", {MOMENT} AS "EndTime" FROM supplier""",
    "task_metadata": """SELECT CAST(c_custkey AS VARCHAR) AS jobid, c_name AS taskname,
  c_nationkey AS priority FROM customer""",
    "savepoint_placeholders": f"""SELECT '20210917' || c_custkey AS "BatchId",
  CAST(c_custkey AS VARCHAR) AS "JobId", 'SAMTSK1' AS "TaskId", {MOMENT} AS "StartTime",
  {MOMENT} AS "EndTime", CAST(NULL AS VARCHAR) AS "SourceDetail",
  CAST(NULL AS VARCHAR) AS "TargetDetail", 'Success' AS "Status", 0 AS "RecordsProcesssed",
  'True' AS "IsActive", {MOMENT} AS "CreatedTime" FROM customer""",
    "seed_definitions": """SELECT s_suppkey AS "SourceId", s_name AS "SourceName",
  'Supplier of nation ' || s_nationkey AS "SourceDescription" FROM supplier WHERE s_nationkey > 4""",
    "xml_dump_rows": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,
  CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part""",
    "xml_blob_json": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,
  '{"part":{"brand":"' || p_brand || '","code":"' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || '","limit":"' || p_size
  || 'e5","name":"' || p_name || '","rate":"' || p_size || '.10","type":"' || p_type || '"}}' AS json
FROM part""",
}

ORACLES |= {
    "job_compact_log": ORACLES["compact_changes"],
    "job_capture_metrics": ORACLES["metric_feed"],
    "job_reconcile_maps": ORACLES["recon_by_map_selected"].replace(
        f"SELECT {LOG}", f'SELECT row_number() OVER (ORDER BY map, batch) AS "ReconLogId", {LOG}'),
    "job_reconcile_batches": ORACLES["recon_log"],
    "job_load_bulk_metrics": ORACLES["bulk_metrics"],
    "job_store_metadata": """SELECT s_name AS jobname, s_acctbal AS cost,
  '20210917' || s_suppkey AS "BatchId", 'Completed' AS "Status" FROM supplier""",
    "job_publish_query": "SELECT c_nationkey, c_name FROM customer WHERE c_acctbal > 0",
}
