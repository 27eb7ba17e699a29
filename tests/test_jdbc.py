"""The options given to Spark's JDBC source. No database is started for a test, so nothing connects."""

import datetime
from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from tallyline.sources.jdbc import CATALOG_CLASS, JdbcStore, cut_predicates, cuts_query

OPTIONS = {"url": "jdbc:some:db", "user": "u", "fetchsize": "1000"}


class Recorder:
    """Takes the place of a session, a reader and a writer."""

    def __init__(self, first=None, fail=False):
        self.calls, self.row, self.fail = [], first, fail
        self.read = self.write = self.conf = self

    def format(self, name):
        self.calls.append({"format": name})
        return self

    def options(self, **options):
        if not self.calls or "dbtable" in self.calls[-1]:
            self.calls.append({})
        self.calls[-1].update(options)
        return self

    def option(self, name, value):
        self.calls[-1][name] = value
        return self

    def mode(self, mode):
        self.calls[-1]["mode"] = mode
        return self

    def load(self):
        if self.fail:
            raise OSError("no such table in the database")
        return self

    def save(self):
        return None

    def first(self):
        return self.row

    def collect(self):
        return [(cut,) for cut in self.row]

    def jdbc(self, url, table, predicates):
        self.calls[-1].update(url=url, dbtable=table, predicates=predicates)
        return self

    def set(self, name, value):
        self.calls.append({name: value})

    def sql(self, text):
        self.calls.append({"sql": text})


def test_table_and_query():
    spark = Recorder()
    store = JdbcStore(spark, OPTIONS)
    store.table("t")
    store.query("SELECT 1 AS a")
    assert spark.calls == [
        {"format": "jdbc", "dbtable": "t", **OPTIONS},
        {"format": "jdbc", "dbtable": "(SELECT 1 AS a) t", **OPTIONS},
    ]


def test_parallel_read_asks_for_its_quantiles():
    spark = Recorder(first=(3, 40, 41, 90))
    JdbcStore(spark, OPTIONS, {"t": ("id", 4)}).table("t")
    assert spark.calls[0]["dbtable"] == cuts_query("t", "id", 4)
    predicates = ["id < 40 OR id IS NULL", "id >= 40 AND id < 41", "id >= 41 AND id < 90", "id >= 90"]
    assert spark.calls[1] == {"dbtable": "t", "predicates": predicates, **OPTIONS}


def test_parallel_read_of_an_empty_table():
    spark = Recorder(first=())
    JdbcStore(spark, OPTIONS, {"t": ("id", 12)}).table("t")
    assert spark.calls[1]["predicates"] == ["1 = 1"]


VALUES = {
    "skewed": [n if n % 10 else 1_000_000_000 * n for n in range(1000)], "hot": [7] * 400 + list(range(600)), "one": [5] * 10,
    "none": [None] * 10, "some": [None, 1, 2, None, 3], "texts": [f"it's {n % 50}" for n in range(500)],
    "days": [datetime.date(2024, 1, 1) + datetime.timedelta(n * n) for n in range(99)],
    "times": [datetime.datetime(2024, 1, 1, 0, 0, n % 60, 5) for n in range(300)],
}


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("parts", [1, 4, 16])
def test_every_row_is_in_one_range_and_the_ranges_are_even(kind, parts):
    """The query and the conditions, as SQL over a table in memory."""
    values, db = VALUES[kind], duckdb.connect()
    table = pa.table({"v": pa.array(values, pa.int64() if kind == "none" else None), "n": range(len(values))})
    db.register("t", table)
    cuts = [r[0] for r in db.execute(f"SELECT cut FROM {cuts_query('t', 'v', parts)}").fetchall()]
    rows = [db.execute(f"SELECT n FROM t WHERE {p}").fetchall() for p in cut_predicates("v", cuts)]
    assert sorted(n for part in rows for n, in part) == list(range(len(values))) and len(rows) <= parts
    most = max(Counter(v for v in values if v is not None).values(), default=0)
    assert max(len(part) for part in rows) <= len(values) / parts + 1 + most + sum(v is None for v in values)


def test_missing_table():
    with pytest.raises(RuntimeError, match="Table t not found"):
        JdbcStore(Recorder(fail=True), OPTIONS).table("t")


def test_replace_stages_first_and_drops_last():
    spark = Recorder()
    JdbcStore(spark, OPTIONS).replace(spark, "t")
    steps = [(c.get("dbtable"), c.get("mode")) for c in spark.calls if "format" in c]
    assert steps == [("t_temp", "overwrite"), ("t_temp", None), ("t", "overwrite")]
    assert spark.calls[-1] == {"sql": "DROP TABLE IF EXISTS tallyline_jdbc.t_temp"}
    assert {"spark.sql.catalog.tallyline_jdbc": CATALOG_CLASS} in spark.calls


def test_append_keeps_the_definition():
    spark = Recorder()
    JdbcStore(spark, OPTIONS).write(spark, "t")
    assert spark.calls == [
        {"format": "jdbc", **OPTIONS, "dbtable": "t", "truncate": True, "mode": "append"}]


def test_a_callers_partitions_bound_the_writers_and_not_the_ranges():
    spark = Recorder(first=(3, 90))
    store = JdbcStore(spark, {**OPTIONS, "numPartitions": "4"}, {"t": ("id", 12)}, writers=2)
    store.table("t")
    assert len(spark.calls[1]["predicates"]) == 2 and "numPartitions" not in spark.calls[1]
    store.write(spark, "t")
    assert spark.calls[2]["numPartitions"] == "2"


def test_a_query_is_read_in_ranges():
    spark = Recorder(first=(1, 8))
    JdbcStore(spark, OPTIONS).query("SELECT id FROM t", ("id", 3))
    assert spark.calls[0]["dbtable"] == cuts_query("(SELECT id FROM t) t", "id", 3)
    assert spark.calls[1] == {"dbtable": "(SELECT id FROM t) t", "predicates": ["id < 8 OR id IS NULL", "id >= 8"], **OPTIONS}


def test_a_staged_copy_is_read_in_the_ranges_of_its_table():
    spark = Recorder(first=(3, 90))
    JdbcStore(spark, OPTIONS, {"t": ("id", 12)}).replace(spark, "t")
    reads = [c for c in spark.calls if c.get("dbtable") == "t_temp" and "mode" not in c]
    assert [len(r["predicates"]) for r in reads] == [2]
    assert cuts_query("t_temp", "id", 12) in [c.get("dbtable") for c in spark.calls]
