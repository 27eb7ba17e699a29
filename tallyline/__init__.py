"""Data reconciliation, change-log and table-movement operators for PySpark."""
