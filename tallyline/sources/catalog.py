"""Tables of the session catalog."""

import uuid

from pyspark.sql import functions as F

from tallyline.sources.files import Addition, remove

TRACKED = "spark.sql.hive.manageFilesourcePartitions"
PREVIOUS = "tallyline.previous"  # the folder of the version before, kept for readers that have begun
APPENDED = "tallyline.appended"  # with a token: the number of rows that it has added
VERSIONS = ".versions"


def _quoted(text):
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class CatalogStore:
    """Reads and writes the tables of one catalog database."""

    remote = False

    def __init__(self, spark, database="default"):
        self.spark = spark
        self.database = database

    def _full(self, name):
        return f"{self.database}.{name}"

    def _has(self, name):
        return self.spark.catalog.tableExists(self._full(name))

    def _settle(self, name):
        """Finish or undo a replacement of a table that was lost half way."""
        old = f"{name}_old"
        if not self._has(old):
            return
        if not self._has(name):
            self._rename(old, name)
            self._resync(name)
            return
        # the new content has its name, so the old one is no longer needed
        self._resync(name)
        self.drop(old)

    def exists(self, name):
        self._settle(name)
        return self._has(name)

    def table(self, name):
        self._settle(name)
        return self.spark.table(self._full(name))

    def query(self, sql, split=None):
        """Any query; its tables carry their database name, and Spark splits their reading."""
        return self.spark.sql(sql)

    def write(self, df, name, mode="append"):
        self._settle(name)
        partitions = self._partitions(name) if self._has(name) else []
        df.write.mode(mode).format("parquet").partitionBy(*partitions).saveAsTable(self._full(name))

    def append_once(self, df, name, token):
        """Append `df` by column name, unless this token has been appended already; the number of its rows.

        The table keeps the token. A job lost at any step may be repeated: what it had staged whole is
        added, and nothing twice.
        """
        self._settle(name)
        if not self._has(name):
            self.write(df.limit(0), name)
        key, partitions = f"{APPENDED}.{token}", self._partitions(name)
        known = self._properties(name).get(key)
        addition = Addition(self.spark, self._location(name), token)
        if known is None:
            columns = self.spark.table(self._full(name)).schema
            rows = df.select(*[F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in columns])
            known = addition.add(rows, partitions)
            self._resync(name)
            self._set_properties(name, {key: str(known)})
            self.spark.catalog.refreshTable(self._full(name))
        addition.forget()
        return int(known)

    def insert_by_position(self, df, name, token=None):
        self._settle(name)
        if token is None:
            df.write.insertInto(self._full(name))
        else:
            self.append_once(df.toDF(*self.spark.table(self._full(name)).columns), name, token)

    def last_id(self, name, column):
        """The highest id of a table; null where there is none."""
        return self.table(name).agg(F.max(column)).first()[0] if self.exists(name) else None

    def drop(self, name):
        self.spark.sql(f"DROP TABLE IF EXISTS {self._full(name)}")

    def replace(self, df, name):
        """Overwrite a table that `df` may be read from; it keeps its columns, partitioning, properties and type.

        The new content is written once, beside the old one, and readers find either of them whole. A
        managed table is swapped by renaming. An external table is a pointer to a folder of files: the
        new version gets a folder of its own and the pointer is set to it, by one change of the table's
        location, or, as partitions have locations of their own, by renaming a definition that was
        made on the new folder. The folder before is kept until the next replacement, for readers that
        have begun. Any later use of the table finishes or undoes what a lost job left.
        """
        self._settle(name)
        staged = f"{name}_temp"
        self.drop(staged)
        if not self._has(name):
            df.write.mode("overwrite").format("parquet").saveAsTable(self._full(staged))
            self._rename(staged, name)
            return
        columns = self.spark.table(self._full(name)).schema
        rows = df.select(*[F.col(f"`{c.name}`").cast(c.dataType).alias(c.name) for c in columns])
        if self._is_external(name):
            self._repoint(rows, name, staged)
        else:
            self._stage(rows, staged, self._properties(name), self._partitions(name))
            self._swap(name, staged)

    def _stage(self, df, staged, properties, partitions):
        """A managed table of the content; its partitions are those of its folder, which a rename moves."""
        tracked = self.spark.conf.get(TRACKED)
        self.spark.conf.set(TRACKED, "false")
        try:
            df.write.mode("overwrite").format("parquet").partitionBy(*partitions).saveAsTable(self._full(staged))
        finally:
            self.spark.conf.set(TRACKED, tracked)
        self._set_properties(staged, properties)

    def _swap(self, name, staged):
        self._rename(name, f"{name}_old")
        self._resync(f"{name}_old")  # else dropping it would drop the folders its partitions had
        self._rename(staged, name)
        self._resync(name)
        self.drop(f"{name}_old")

    def _repoint(self, df, name, staged):
        """Write a new version of an external table and point the table to it."""
        partitions, properties, here = self._partitions(name), self._properties(name), self._location(name)
        if properties.get(PREVIOUS):
            remove(self.spark, properties[PREVIOUS])
        parent = here.rpartition("/")[0]
        versions = parent if parent.endswith(VERSIONS) else here + VERSIONS
        version = f"{versions}/{uuid.uuid4().hex}"
        df.write.partitionBy(*partitions).parquet(version)
        if not partitions:
            self.spark.sql(f"ALTER TABLE {self._full(name)} SET LOCATION {_quoted(version)}")
            self._set_properties(name, {PREVIOUS: here})
            return
        fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in df.schema)
        by = ", ".join(f"`{c}`" for c in partitions)
        self.spark.sql(f"CREATE TABLE {self._full(staged)} ({fields}) USING parquet PARTITIONED BY ({by}) LOCATION {_quoted(version)}")
        self._resync(staged)
        self._set_properties(staged, properties | {PREVIOUS: here})
        self._swap(name, staged)

    def _resync(self, name):
        """Make the partitions the catalog knows those of the table's folder, which a rename may have moved."""
        if self._partitions(name):
            self.spark.sql(f"MSCK REPAIR TABLE {self._full(name)} SYNC PARTITIONS")

    def _set_properties(self, name, properties):
        if properties:
            pairs = ", ".join(f"{_quoted(k)} = {_quoted(v)}" for k, v in properties.items())
            self.spark.sql(f"ALTER TABLE {self._full(name)} SET TBLPROPERTIES ({pairs})")

    def _location(self, name):
        rows = self.spark.sql(f"DESCRIBE EXTENDED {self._full(name)}").collect()
        return next(r["data_type"] for r in reversed(rows) if r["col_name"] == "Location").rstrip("/")

    def _partitions(self, name):
        return [c.name for c in self.spark.catalog.listColumns(self._full(name)) if c.isPartition]

    def _is_external(self, name):
        return self.spark.catalog.getTable(self._full(name)).tableType == "EXTERNAL"

    def _properties(self, name):
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self._full(name)}").collect()
        return {r["key"]: r["value"] for r in rows if not r["key"].startswith(("spark.", "transient"))}

    def _rename(self, name, new):
        self.spark.sql(f"ALTER TABLE {self._full(name)} RENAME TO {self._full(new)}")
