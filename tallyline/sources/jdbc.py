"""Tables of a database reached over JDBC. Connection options always come from the caller."""

import datetime

CATALOG_CLASS = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"


def cuts_query(relation, column, parts):
    """A query for the least values of `parts` runs of about as many rows each, in the order of a column."""
    return (
        f"(SELECT MIN({column}) AS cut FROM (SELECT {column}, NTILE({parts}) OVER (ORDER BY {column}) AS part "
        f"FROM {relation} WHERE {column} IS NOT NULL) ranked GROUP BY part) cuts"
    )


def literal(value):
    """A number, text, date or time in SQL."""
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP '{value}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def cut_predicates(column, cuts):
    """Conditions that each row fulfils one of, one for each run between different cuts; nulls go with the first.

    A value that fills several runs is cut out once: its rows are one run.
    """
    bounds = [literal(cut) for cut in sorted(set(cuts))][1:]
    if not bounds:
        return ["1 = 1"]
    between = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *between, f"{column} >= {bounds[-1]}"]


class JdbcStore:
    """Reads and writes the tables of one database.

    `options` are Spark's JDBC options (url, driver, user, password, fetchsize, batchsize, ..).
    `ranges` names, for the tables many tasks shall read, a column of numbers, texts, dates or times and
    the number of ranges to cut it into; the database is asked for its quantiles, so that the ranges hold
    about as many rows each, however the values are spread. `writers` bounds the connections that write
    at a time.
    """

    remote = True

    def __init__(self, spark, options, ranges=None, catalog="tallyline_jdbc", writers=None):
        self.spark = spark
        self.options = dict(options)
        self.ranges = dict(ranges or {})
        self.catalog = catalog
        self.writers = writers

    def _reader(self, **more):
        return self.spark.read.format("jdbc").options(**{**self.options, **more})

    def table(self, name):
        try:
            return self._read(name, self.ranges.get(name))
        except Exception as e:
            raise RuntimeError(f"Table {name} not found or not readable") from e

    def _read(self, relation, split):
        """A table or a query in brackets, in ranges of a column if `split` names one and their number."""
        if split is None:
            return self._reader(dbtable=relation).load()
        column, parts = split
        cuts = [row[0] for row in self._reader(dbtable=cuts_query(relation, column, parts)).load().collect()]
        options = {k: v for k, v in self.options.items() if k != "numPartitions"}
        return self.spark.read.options(**options).jdbc(options["url"], relation, predicates=cut_predicates(column, cuts))

    def query(self, sql, split=None):
        """The result of a query the database runs; `split` is (column, number of ranges)."""
        return self._read(f"({sql}) t", split)

    def last_id(self, name, column):
        """The highest id of a table that is there; null where it is empty."""
        return self._reader(dbtable=f"(SELECT MAX({column}) AS last FROM {name}) t").load().first()[0]

    def write(self, df, name, mode="append"):
        """Append, or overwrite keeping the table's definition."""
        writers = {} if self.writers is None else {"numPartitions": str(self.writers)}
        (
            df.write.format("jdbc").options(**{**self.options, **writers})
            .option("dbtable", name).option("truncate", True).mode(mode).save()
        )

    def drop(self, name):
        prefix = f"spark.sql.catalog.{self.catalog}"
        self.spark.conf.set(prefix, CATALOG_CLASS)
        for key, value in self.options.items():
            self.spark.conf.set(f"{prefix}.{key}", value)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.catalog}.{name}")

    def replace(self, df, name):
        """Overwrite a table that `df` may be read from.

        The new content is staged whole, then copied over. The staged copy is dropped only after
        the copy succeeded, so a failure in between loses nothing.
        """
        staged = f"{name}_temp"
        self.write(df, staged, "overwrite")
        self.write(self._read(staged, self.ranges.get(name)), name, "overwrite")
        self.drop(staged)
