"""CSV input, and parquet and catalog output.

A published folder is replaced by renaming: the new files are written to a folder beside it, and when
they are whole a record says so. Then the old folder is set aside and the new one takes its name. What a
lost job left is finished, or dropped, by the next publication or by `published`. A rename must be one
step for readers to see nothing half done, as on HDFS; an object store copies file by file. A reader that
listed the old files has to list the folder again.
"""

import hashlib

from pyspark.sql import Observation, functions as F

from tallyline.operators.select import conform


def read_csv(spark, path, schema=None):
    """CSV with a header row: all text, then cast to `schema` where one is given."""
    rows = spark.read.option("header", True).csv(path)
    return rows if schema is None else conform(rows, schema)


def _hadoop(spark, path):
    """A path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark, path):
    """Delete a folder, if it is there."""
    found, fs = _hadoop(spark, path)
    fs.delete(found, True)


class Publication:
    """A published folder, and what stands beside it while it is replaced."""

    def __init__(self, spark, destination):
        self.spark, self.destination = spark, destination.rstrip("/")
        folder, _, name = self.destination.rpartition("/")
        self.staged, self.old, self.record = (f"{folder}/_{name}.{kind}" for kind in ("staged", "old", "ready"))

    def _has(self, path):
        found, fs = _hadoop(self.spark, path)
        return fs.exists(found)

    def _rename(self, path, new):
        source, fs = _hadoop(self.spark, path)
        target, _ = _hadoop(self.spark, new)
        if not fs.rename(source, target):
            raise OSError(f"{path} could not be renamed to {new}")

    def _write_record(self):
        found, fs = _hadoop(self.spark, self.record)
        fs.create(found, True).close()

    def _remove(self, path):
        remove(self.spark, path)

    def settle(self):
        """Finish a replacement whose files are whole."""
        if not self._has(self.record):
            return
        if self._has(self.staged):
            if self._has(self.destination):
                self._remove(self.old)
                self._rename(self.destination, self.old)
            self._rename(self.staged, self.destination)
        self._remove(self.old)
        self._remove(self.record)

    def replace(self, df):
        """Write `df`, which may be read from the folder itself, and put it in the folder's place."""
        self.settle()
        df.write.mode("overwrite").parquet(self.staged)
        self._write_record()
        self.settle()


class Addition:
    """Parquet files that are added to a folder once, by a token, however often the job is repeated.

    They are written to a folder beside it; when they are whole a record holds their number of rows.
    Then they are moved one by one, under names that carry the token.
    """

    def __init__(self, spark, folder, token):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.mark = hashlib.sha256(token.encode()).hexdigest()[:32]
        parent, _, name = self.folder.rpartition("/")
        self.staged, self.record = f"{parent}/_{name}.{self.mark}", f"{parent}/_{name}.{self.mark}.ready"

    def add(self, df, partitions=()):
        """Add the rows of `df`, or what a lost job has staged of them; the number of rows."""
        record, fs = _hadoop(self.spark, self.record)
        if not fs.exists(record):
            seen = Observation()
            rows = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            rows.write.mode("overwrite").partitionBy(*partitions).parquet(self.staged)
            self._write_record(seen.get["rows"])
        said = fs.open(record)
        count = int(said.readLine())
        said.close()
        self._move()
        return count

    def _write_record(self, count):
        found, fs = _hadoop(self.spark, f"{self.record}.begun")
        out = fs.create(found, True)
        out.writeBytes(f"{count}\n")
        out.close()
        self._rename(fs, found, _hadoop(self.spark, self.record)[0])

    def _move(self):
        staged, fs = _hadoop(self.spark, self.staged)
        if not fs.exists(staged):
            return
        base, files = fs.getFileStatus(staged).getPath().toString(), fs.listFiles(staged, True)
        while files.hasNext():
            file = files.next().getPath()
            inside, _, name = file.toString()[len(base) + 1:].rpartition("/")
            if name.startswith(("_", ".")):
                continue
            target, _ = _hadoop(self.spark, f"{self.folder}/{inside}".rstrip("/"))
            fs.mkdirs(target)
            self._rename(fs, file, _hadoop(self.spark, f"{target.toString()}/{self.mark}-{name}")[0])

    def _rename(self, fs, file, target):
        if not fs.rename(file, target):
            raise OSError(f"{file.toString()} could not be moved to {target.toString()}")

    def forget(self):
        """Remove what is left beside the folder."""
        remove(self.spark, self.staged)
        remove(self.spark, self.record)


def publish_parquet(df, destination, single_file=False):
    """Replace a parquet folder, wherever its URI lies; one file only when asked for."""
    if single_file:
        df = df.coalesce(1)
    Publication(df.sparkSession, destination).replace(df)


def published(spark, destination):
    """The rows of a published folder: old or new ones, whole, whatever a lost job left."""
    Publication(spark, destination).settle()
    return spark.read.parquet(destination)


def publish_table(df, name, path):
    """Replace an external parquet table kept at `path`: the folder is replaced, the table stays, unless its columns change."""
    spark = df.sparkSession
    publish_parquet(df, path)
    if spark.catalog.tableExists(name):
        here = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Location'").first()["data_type"]
        same_place = _hadoop(spark, here)[0].toUri().getPath() == _hadoop(spark, path)[0].toUri().getPath()
        known = [(c.name, c.dataType) for c in spark.table(name).schema]
        if same_place and known == [(c.name, c.dataType) for c in df.schema]:
            spark.catalog.refreshTable(name)
            return
        spark.sql(f"DROP TABLE {name}")
    spark.catalog.createTable(name, path, "parquet")
