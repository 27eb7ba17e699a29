"""Fixed values that must equal the ones the audit tables already hold."""

# change kinds of an audit log, in the order they are applied within one instant
INSERT, UPDATE, DELETE = "I", "U", "D"

# audit task name -> metric id
TASK_METRIC_IDS = {"PC_POLICY": 1, "PC_CLAIM": 2, "PC_BILLING": 3}

# kind of audit row -> source id
SAVEPOINT_SOURCE_ID = 1
MANIFEST_SOURCE_ID = 2

# statuses
SAVEPOINT_SUCCESS = "Success"
TRACKER_NEW = "New"
PASSED, FAILED = "Passed", "Failed"
JOB_COMPLETED = "Completed"

# row constants
METRIC_VERSION = "V2"
PLACEHOLDER_BATCH_PREFIX = "20210917"
PLACEHOLDER_TASK_ID = "SAMTSK1"
