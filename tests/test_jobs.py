from collections import Counter

import pytest

from tallyline import schemas
from tallyline.plans import jobs
from tallyline.session import shared_folder
from tallyline.sources.catalog import CatalogStore
from tallyline.sources.files import Addition, Publication, publish_parquet, publish_table, published, read_csv


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def seed(spark, store):
    store.write(spark.createDataFrame([(1, "General", "d", "a", "1", "a", "1")], schemas.SOURCE_DEFINITION), "source_definition")
    store.write(spark.createDataFrame([(7, "Policy", "d")], schemas.METRIC_DEFINITION), "metric_definition")
    store.write(spark.createDataFrame([(1, 1, 2)], schemas.COMPARISION_DEFINITION), "comparision_definition")
    store.write(spark.createDataFrame([(1, 7, 1, 5), (2, 8, 1, 5)], schemas.METRIC_COMPARISION_MAP), "metric_comparision_map")
    store.write(spark.createDataFrame(
        [(7, 1, "b1", "V2", 10, "x", "y"), (7, 2, "b1", "V2", 12, "x", "y")], schemas.METRIC_DATA), "metric_data")
    store.write(spark.createDataFrame(
        [(1, "b1", 1, "New"), (2, "b2", 1, "New"), (3, "b1", 2, "Done")], schemas.METRIC_BATCH_TRACKER), "metric_batch_tracker")


def test_reconciliation_jobs(spark, store):
    seed(spark, store)
    jobs.reconcile_batches(store, store, "1,2")
    assert rows(store.table("reconciliation_log")) == Counter({
        (1, 1, "b1", "V2", 1, 10, 2, 12, 5, 2, "Passed"): 1,
        (2, 1, "b2", "", 0, 0, 0, 0, 0, 0, "Passed"): 1,
    })
    jobs.reconcile_maps(store, store, "1,2")
    assert store.table("reconciliation_log").count() == 3


def test_metrics_are_inserted_once(spark, store):
    seed(spark, store)
    before = rows(store.table("metric_data"))
    jobs.insert_metric(store, "General", "Policy", 120, "20240229", "20240301", "someone")
    assert rows(store.table("metric_data")) == before
    store.write(spark.createDataFrame([(3, "Extra", "", "", "", "", "")], schemas.SOURCE_DEFINITION), "source_definition")
    for _ in range(2):
        jobs.insert_metric(store, "Extra", "Policy", 120, "20240229", "20240301", "someone")
        assert rows(store.table("metric_data")) == before + Counter(
            {(7, 3, "20240229", "V2", 120, "20240301", "someone"): 1})
    with pytest.raises(Exception, match="no SourceId for SourceName Nowhere"):
        jobs.insert_metric(store, "Nowhere", "Policy", 1, "", "", "")
    assert not store.exists("metric_data_old")
    assert store.exists("metric_data")


def test_bulk_metrics_are_appended(spark, store):
    seed(spark, store)
    store.drop("metric_data")
    pairs = spark.createDataFrame([("General", "Policy")] * 2, "SourceName string, MetricName string")
    jobs.load_bulk_metrics(store, pairs, "20240228", 35, "20240228", "someone")
    assert rows(store.table("metric_data")) == Counter(
        {(n, 7, 1, "20240228", "V2", 35, "20240228", "someone"): 1 for n in (1, 2)})


def test_capture_job(spark, store):
    store.write(spark.createDataFrame([("PC_POLICY", 9, "b1", "Success")], schemas.ETLAUDIT_SAVEPOINT), "etlaudit_savepoint")
    store.write(spark.createDataFrame([("PC_POLICY", 10, "b1"), ("PC_POLICY", 15, "b2")], schemas.MANIFEST), "manifest")
    tasks = spark.createDataFrame([("PC_POLICY", 1)], "TaskId string, MetricId int")
    jobs.capture_metrics(store, store, tasks, "20240131", "someone")
    found = store.table("metric_data").select("SourceId", "BatchId", "MetricValue")
    assert rows(found) == Counter({(1, "b1", 9): 1, (2, "b1", 10): 1, (2, "b2", 5): 1})


def test_compaction_job(spark, store):
    log = spark.createDataFrame(
        [(1, None, "I", 5, "a"), (1, 1, "U", 5, "b"), (2, None, "I", 5, "c")],
        "id_new int, id_old int, op_code string, op_time int, note string",
    )
    store.write(log, "audit_log")
    jobs.compact_log(store, store)
    assert sorted(r.note for r in store.table("output_auditlog").collect()) == ["b", "c"]


def test_insert_and_append_if_absent(spark, store):
    old = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([("2", "b"), ("1", "z"), (None, "m")], "k string, v string")
    store.write(old, "t")
    jobs.insert_if_absent(store, "t", new, ["k"])
    assert rows(store.table("t")) == Counter({(1, "a"): 1, (None, "n"): 1, (2, "b"): 1})
    jobs.append_if_absent(store, "t", spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), ["k"])
    assert rows(store.table("t")) == Counter({(1, "a"): 1, (None, "n"): 1, (2, "b"): 1, (3, "c"): 1})
    jobs.insert_if_absent(store, "t", new)
    assert store.table("t").count() == 6


def test_a_failed_rewrite_keeps_the_table(spark, store):
    store.write(spark.createDataFrame([(1,)], "k int"), "t")
    bad = spark.createDataFrame([("x",)], "k string").selectExpr("CAST(k AS INT) AS k")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        store.replace(bad, "t")
    assert rows(store.table("t")) == Counter({(1,): 1})
    store.replace(spark.createDataFrame([(2,)], "k int"), "t")
    assert rows(store.table("t")) == Counter({(2,): 1})


def test_lookup_copy(spark, store):
    store.write(spark.createDataFrame([(n,) for n in range(5)], "k int"), "s")
    db = store.database
    lookup = spark.createDataFrame(
        [("s", f"SELECT k FROM {db}.s", "t"), ("s", f"SELECT k FROM {db}.s WHERE k > 2", "t"),
         ("s", f"SELECT k FROM {db}.s WHERE k > 9", "u")], schemas.LOOKUP)
    done = jobs.lookup_copy(store, store, lookup)
    assert rows(done) == Counter({("t", 5): 1, ("t", 2): 1, ("u", 0): 1})
    assert store.table("t").count() == 7
    assert store.table("u").count() == 0


def test_metadata_load(spark, store, tmp_path):
    path = tmp_path / "jobs.csv"
    path.write_text("jobid,name,cost\nj1,it's,5\nj2,,7\n")
    assert read_csv(spark, str(path)).schema.simpleString() == "struct<jobid:string,name:string,cost:string>"
    schema = spark.createDataFrame([], "jobid string, name string, cost int").schema
    loaded, placeholders = jobs.load_job_metadata(spark, str(path), schema)
    assert rows(loaded) == Counter({("j1", "it's", 5): 1, ("j2", None, 7): 1})
    first = placeholders.orderBy("JobId").first()
    assert (first.BatchId, first.Status, first.JobId) == ("20210917j1", "Completed", "j1")
    assert first.StartTime == first.EndTime and first.StartTime.microsecond == 0

    _, savepoints = jobs.load_task_metadata(spark, str(path), schema, prefix="2022")
    assert savepoints.count() == 2
    one = savepoints.orderBy("JobId").first()
    assert tuple(one)[:3] == ("2022j1", "j1", "SAMTSK1")
    assert tuple(one)[5:10] == (None, None, "Success", 0, "True")

    store.write(loaded.limit(0).toDF("id", "n", "c"), "jobmetadata")
    store.write(spark.createDataFrame([], schemas.JOB_BATCH), "jbatch")
    jobs.store_metadata(store, loaded, placeholders, "jobmetadata", "jbatch")
    assert rows(store.table("jobmetadata")) == rows(loaded)
    assert store.table("jbatch").count() == 2


def test_publishing(spark, store, tmp_path):
    df = spark.createDataFrame([(1, "a", 20), (2, "b", 30)], schemas.PLAYERS)
    store.write(df, "players")
    target = str(tmp_path / "out")
    for _ in range(2):
        jobs.publish_query(store, f"SELECT id, age FROM {store.database}.players", target)
    assert rows(spark.read.parquet(target)) == Counter({(1, 20): 1, (2, 30): 1})
    publish_parquet(df.repartition(4), target, single_file=True)
    assert len(list((tmp_path / "out").glob("*.parquet"))) == 1
    name = f"{store.database}.ext"
    for _ in range(2):
        publish_table(df, name, str(tmp_path / "ext"))
    assert rows(spark.table(name)) == rows(df)
    kind = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}["Type"]
    assert kind == "EXTERNAL"


def test_definitions_are_read_back(spark, store):
    definition = spark.createDataFrame([(1, "General", "d", "a", "1", "a", "1")], schemas.SOURCE_DEFINITION)
    found = jobs.seed_definition(store, definition, "SourceId, SourceName, SourceDescription")
    assert rows(found) == Counter({(1, "General", "d"): 1})


def test_the_shared_folder_is_the_one_the_cluster_names(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_missing_table(spark):
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        CatalogStore(spark).table("no_such_table")


class Lost(Exception):
    pass


def failing(store, monkeypatch, step):
    """Make the n-th step of a store's replacement fail once."""
    count = [0]

    def wrap(name):
        own = getattr(store, name)

        def call(*args):
            count[0] += 1
            if count[0] == step:
                raise Lost(name)
            return own(*args)

        monkeypatch.setattr(store, name, call)

    for name in ("_rename", "_repoint", "_resync", "_set_properties", "drop"):
        wrap(name)


@pytest.mark.parametrize("step", range(1, 9))
@pytest.mark.parametrize("external, partitions", [(False, ["p"]), (True, ["p"]), (True, []), (False, [])])
def test_a_replacement_lost_at_any_step_loses_no_row(spark, store, monkeypatch, tmp_path, step, external, partitions):
    old = spark.createDataFrame([(n, n % 3) for n in range(100)], "k int, p int")
    writer = old.write.format("parquet").partitionBy(*partitions)
    if external:
        writer = writer.option("path", str(tmp_path / "t"))
    writer.saveAsTable(f"{store.database}.t")
    new = store.table("t").union(spark.createDataFrame([(n, 4) for n in range(100, 110)], "k int, p int"))
    with monkeypatch.context() as patched:
        failing(store, patched, step)
        try:
            store.replace(new, "t")
        except Lost:
            pass
    assert {r.k for r in store.table("t").collect()} in (set(range(100)), set(range(110)))
    jobs.append_if_absent(store, "t", spark.createDataFrame([(1000, 0), (5, 2)], "k int, p int"), ["k"])
    jobs.insert_if_absent(store, "t", spark.createDataFrame([(1001, 1)], "k int, p int"), ["k"])
    keys = {r.k for r in store.table("t").collect()}
    assert set(range(100)) | {1000, 1001} <= keys
    assert store.table("t").count() == len(keys)
    assert not store.exists("t_old") and not store.exists("t_temp")


@pytest.mark.parametrize("partitions", [["p"], []])
def test_an_external_table_is_pointed_to_its_new_version(spark, store, tmp_path, partitions):
    """Written once; a reader that has begun finds the files it has listed, or the new ones, whole."""
    path, name = str(tmp_path / "ext"), f"{store.database}.e"
    spark.createDataFrame([(n, n % 2) for n in range(10)], "k int, p int").write.partitionBy(*partitions).option("path", path).saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('owner_team' = 'it''s us')")
    for most in (4, 2, 3):
        begun, before = spark.table(name), spark.table(name).count()
        here = store._location("e")
        store.replace(spark.range(most).selectExpr("CAST(id % 2 AS INT) AS p", "id AS k"), "e")
        assert begun.count() in (before, most)
        assert store._location("e") != here and store.table("e").count() == most
    assert len(list((tmp_path / "ext.versions").iterdir())) == 2
    assert not (tmp_path / "ext").exists()
    assert spark.catalog.getTable(name).tableType == "EXTERNAL"
    assert [c.name for c in spark.catalog.listColumns(name) if c.isPartition] == partitions
    assert spark.table(name).schema.simpleString() == "struct<k:int,p:int>"
    assert store._properties("e")["owner_team"] == "it's us"


@pytest.mark.parametrize("partitions", [["p"], []])
def test_a_replaced_managed_table_keeps_its_kind(spark, store, partitions):
    store.spark.createDataFrame([(1, 1), (5, 3)], "k int, p int").write.partitionBy(*partitions).saveAsTable(f"{store.database}.m")
    spark.sql(f"ALTER TABLE {store.database}.m SET TBLPROPERTIES ('owner_team' = 'it''s us')")
    store.replace(spark.createDataFrame([(2, 1), (3, 7)], "k int, p int"), "m")
    assert store._properties("m")["owner_team"] == "it's us"
    assert spark.catalog.getTable(f"{store.database}.m").tableType == "MANAGED"
    assert [c.name for c in spark.catalog.listColumns(f"{store.database}.m") if c.isPartition] == partitions
    assert rows(store.table("m")) == Counter({(2, 1): 1, (3, 7): 1})
    if partitions:
        assert {r.partition for r in spark.sql(f"SHOW PARTITIONS {store.database}.m").collect()} == {"p=1", "p=7"}
    store.write(spark.createDataFrame([(9, 7)], "k int, p int"), "m")
    assert store.table("m").count() == 3


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("step", range(1, 7))
def test_a_publication_lost_at_any_step_is_old_or_new(spark, monkeypatch, tmp_path, step, first):
    target = str(tmp_path / "out")
    if not first:
        publish_parquet(spark.range(5), target)
        publish_parquet(spark.range(6), target)
    count = [0]
    with monkeypatch.context() as patched:
        for name in ("_rename", "_remove", "_write_record"):
            def call(self, *args, own=getattr(Publication, name)):
                count[0] += 1
                if count[0] == step:
                    raise Lost(step)
                return own(self, *args)
            patched.setattr(Publication, name, call)
        try:
            publish_parquet(published(spark, target).union(spark.range(6, 8)) if not first else spark.range(8), target)
        except Lost:
            pass
    if first and step == 1:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            published(spark, target)
    else:
        assert sorted(r.id for r in published(spark, target).collect()) in ([*range(6)], [*range(8)])
    publish_parquet(spark.range(3), target)
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 1, 2]


def test_a_failed_publication_keeps_the_folder(spark, tmp_path):
    target = str(tmp_path / "out")
    publish_parquet(spark.range(4), target)
    begun = spark.read.parquet(target)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        publish_parquet(spark.createDataFrame([("x",)], "k string").selectExpr("CAST(k AS INT) AS k"), target)
    assert spark.read.parquet(target).count() == 4
    publish_parquet(begun.where("id > 1"), target)
    assert published(spark, target).count() == 2
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_published_table_may_change_its_columns(spark, store, tmp_path):
    name, path = f"{store.database}.p", str(tmp_path / "p")
    for df in (spark.range(3), spark.range(5), spark.range(2).selectExpr("id", "'x' AS v")):
        publish_table(df, name, path)
        assert rows(spark.table(name)) == rows(df) == rows(spark.read.parquet(path))
    assert spark.catalog.getTable(name).tableType == "EXTERNAL"


def lost_at(monkeypatch, patched, step):
    """Make the n-th step of an append fail once, before or after it is done."""
    count = [0]

    def wrap(owner, name):
        own = getattr(owner, name)

        def call(*args, **more):
            count[0] += 1
            if count[0] == step:
                raise Lost(name)
            out = own(*args, **more)
            count[0] += 1
            if count[0] == step:
                raise Lost(name)
            return out

        patched.setattr(owner, name, call)

    for owner, name in ((Addition, "_write_record"), (Addition, "_rename"), (Addition, "forget"), (CatalogStore, "_resync"), (CatalogStore, "_set_properties")):
        wrap(owner, name)


@pytest.mark.parametrize("step", [1, 2, 4, 6, 9, 11, 17, 23])
def test_a_lost_lookup_copy_is_repeated_without_doubles(spark, store, monkeypatch, step):
    store.write(spark.range(6), "s")
    db = store.database
    lookup = spark.createDataFrame(
        [("s", f"SELECT id FROM {db}.s", "t"), ("s", f"SELECT id FROM {db}.s", "t"), ("s", f"SELECT id + 100 AS id FROM {db}.s WHERE id > 1", "u")],
        schemas.LOOKUP)
    with monkeypatch.context() as patched:
        lost_at(monkeypatch, patched, step)
        try:
            jobs.lookup_copy(store, store, lookup, run="monday")
        except Lost:
            pass
    for _ in range(2):
        assert rows(jobs.lookup_copy(store, store, lookup, run="monday")) == Counter({("t", 6): 2, ("u", 4): 1})
    assert sorted(r.id for r in store.table("t").collect()) == sorted([*range(6)] * 2)
    assert sorted(r.id for r in store.table("u").collect()) == [102, 103, 104, 105]
    jobs.lookup_copy(store, store, lookup, run="tuesday")
    assert store.table("t").count() == 24


@pytest.mark.parametrize("external", [False, True])
def test_an_append_to_a_partitioned_table_is_made_once(spark, store, tmp_path, external):
    writer = spark.createDataFrame([(1, "a")], "k int, p string").write.partitionBy("p")
    (writer.option("path", str(tmp_path / "t")) if external else writer).saveAsTable(f"{store.database}.t")
    for _ in range(2):
        assert store.append_once(spark.createDataFrame([("b", 2), ("a", 3), (None, 4)], "p string, k long"), "t", "one") == 3
        assert rows(store.table("t")) == Counter({(1, "a"): 1, (2, "b"): 1, (3, "a"): 1, (4, None): 1})
    store.replace(store.table("t").where("k < 3"), "t")
    assert store.append_once(store.table("t"), "t", "one") == 3 and store.table("t").count() == 2


def test_ids_go_on_and_retried_appends_add_nothing(spark, store):
    seed(spark, store)
    for token in ("a", "a", "b", None):
        jobs.reconcile_maps(store, store, "1,2", token=token)
    log = [r.ReconLogId for r in store.table("reconciliation_log").collect()]
    assert sorted(log) == [*range(1, len(log) + 1)] and len(log) == 3
    store.drop("metric_data")
    pairs = spark.createDataFrame([("General", "Policy")] * 2, "SourceName string, MetricName string")
    for token in ("a", "a", "b"):
        jobs.load_bulk_metrics(store, pairs, "20240228", 35, "20240228", "someone", token=token)
    assert sorted(r.metricDataId for r in store.table("metric_data").collect()) == [1, 2, 3, 4]
    store.write(spark.createDataFrame([], "id string, n string"), "jobmetadata")
    store.write(spark.createDataFrame([], "b string"), "jbatch")
    for _ in range(2):
        jobs.store_metadata(store, spark.createDataFrame([("j", 1)], "x string, y int"), spark.createDataFrame([("p",)], "z string"), "jobmetadata", "jbatch", token="load")
    assert rows(store.table("jobmetadata")) == Counter({("j", "1"): 1}) and rows(store.table("jbatch")) == Counter({("p",): 1})
    log = spark.createDataFrame([(1, None, "I", 5, "a")], "id_new int, id_old int, op_code string, op_time int, note string")
    store.write(log, "audit_log")
    for _ in range(2):
        jobs.compact_log(store, store, token="day")
        jobs.seed_definition(store, spark.createDataFrame([(9, "M", "d")], schemas.METRIC_DEFINITION), "MetricId", "metric_definition", token="day")
    assert store.table("output_auditlog").count() == 1
    assert store.table("metric_definition").where("MetricId = 9").count() == 1
