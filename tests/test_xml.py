import json
import random

import pytest

from tallyline.operators.xmlblob import blob_to_json
from tallyline.sources import xmldump
from tallyline.sources.xmldump import dump_rows, write_dump

ENTRY = "&lt;entry kind=&quot;{}&quot;&gt;&lt;item&gt;salt &amp;amp; oil&lt;/item&gt;&lt;item&gt;bread&lt;/item&gt;&lt;/entry&gt;"
HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<database name="db">\n  <!-- Table t -->\n'


def row(**columns):
    cells = "".join(f'\n    <column name="{k}">{v}</column>' for k, v in columns.items())
    return f'  <table name="t">{cells}\n  </table>\n'


@pytest.fixture
def dump(tmp_path):
    def write(*rows):
        path = tmp_path / "dump.xml"
        path.write_text(HEAD + "".join(rows) + "</database>\n")
        return str(path)
    return write


@pytest.mark.parametrize("splittable", [True, False])
def test_rows_and_missing_columns(spark, dump, splittable):
    path = dump(row(id=1, name="a &amp; b"), row(id=2), row(name="c", other="x"))
    found = dump_rows(spark, path, ["id", "name"], splittable=splittable).collect()
    assert sorted(found, key=str) == sorted(
        [("1", "a & b"), ("2", None), (None, "c")], key=str)


@pytest.mark.parametrize("splittable", [True, False])
def test_a_dump_of_one_row(spark, dump, splittable):
    assert dump_rows(spark, dump(row(id=1)), ["id"], splittable=splittable).collect() == [("1",)]


def test_cumulative_counts_of_a_dump(spark, dump):
    """A dump in the stored shape: batch, task, count, and a note per row."""
    counts = [("b1", "PC_POLICY", 30), ("b2", "PC_POLICY", 37), ("b3", "PC_POLICY", 90)]
    path = dump(*[
        row(ManifestId=n, BatchId=b, TaskId=t, RecordsReceived=r, blob_column=ENTRY.format(f"k{n}"))
        for n, (b, t, r) in enumerate(counts)
    ])
    rows = dump_rows(spark, path, ["BatchId", "TaskId", "RecordsReceived", "blob_column"])
    assert sorted((r.BatchId, r.TaskId, int(r.RecordsReceived)) for r in rows.collect()) == counts
    noted = blob_to_json(rows, "blob_column").orderBy("BatchId").collect()
    assert [json.loads(r.json) for r in noted] == [
        {"entry": {"_kind": f"k{n}", "item": ["salt & oil", "bread"]}} for n in range(3)]


def test_a_big_file_is_read_by_many_tasks(spark, dump, conf):
    path = dump(*[row(id=n, name="x" * 50) for n in range(2000)])
    conf(spark__sql__files__maxPartitionBytes="20k", spark__sql__files__openCostInBytes="1k")
    rows = dump_rows(spark, path, ["id"])
    assert rows.rdd.getNumPartitions() > 4
    assert sorted(int(r.id) for r in rows.collect()) == list(range(2000))


@pytest.mark.parametrize("splittable", [True, False])
def test_tags_inside_cdata(spark, dump, splittable):
    path = dump(row(id=1, name="<![CDATA[a </table> b]]>"), row(id=2, name="<![CDATA[c]]>"))
    found = dump_rows(spark, path, ["id", "name"], splittable=splittable).collect()
    assert sorted(found) == [("1", "a </table> b"), ("2", "c")]


@pytest.mark.parametrize("run", [256, 3])
def test_sections_over_many_splits(spark, dump, conf, monkeypatch, run):
    """Rows whose sections hold closing tags, openings of the other kind, and more than a split."""
    monkeypatch.setattr(xmldump, "RUN", run)
    draw, rows, expected = random.Random(run), [], []
    for n in range(400):
        text = "".join(draw.choice(["x" * 30, "</table>", "<!--", "-->", '<table name="t">', "]]", "<![CDATA["]) for _ in range(draw.choice([1, 5, 200])))
        kind = draw.randrange(4)
        if kind == 0:
            rows.append(row(id=n, name=f"<![CDATA[{text}]]>"))
            expected.append((str(n), text))
        elif kind == 1:
            rows.append(row(id=n, name="y"))
            expected.append((str(n), "y"))
        elif kind == 2:
            rows.append(f"<!-- {text.replace('-->', '').replace('--', '')} -->")
        else:
            rows.append("<!--" + row(id=n, name="z") * 3 + "-->")
    conf(spark__sql__files__maxPartitionBytes="10k", spark__sql__files__openCostInBytes="1k")
    found = dump_rows(spark, dump(*rows), ["id", "name"])
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_files_of_one_folder_are_apart(spark, tmp_path):
    """A section that one file leaves open says nothing about the next."""
    for n in range(3):
        (tmp_path / f"d{n}.xml").write_text(HEAD + row(id=n, name="<![CDATA[</table>]]>") + "</database>\n<!-- end </table>")
    assert sorted(r.id for r in dump_rows(spark, str(tmp_path), ["id"]).collect()) == ["0", "1", "2"]


def test_complete_cdata_is_fine(spark, dump):
    path = dump(row(id=1, name="<![CDATA[a < b]]>"), row(id=2, name="c"))
    assert sorted(dump_rows(spark, path, ["id", "name"]).collect()) == [("1", "a < b"), ("2", "c")]


def test_text_that_is_not_xml(spark):
    rows = spark.createDataFrame([(1, "<note><to>a</to></note>"), (2, "<note><to>"), (3, None)], "id int, x string")
    with pytest.raises(Exception):
        blob_to_json(rows, "x", "to string", "note").collect()
    found = blob_to_json(rows, "x", "to string", "note", strict=False).orderBy("id").collect()
    assert json.loads(found[0].json) == {"note": {"to": "a"}}
    assert found[2].json is None
    assert "a" not in (found[1].json or "")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b>&\"c\"", None), (2, "", "x")], "id int, s string, t string")
    path = str(tmp_path / "out")
    write_dump(df, path, "t")
    found = {r.id: (r.s, r.t) for r in dump_rows(spark, path, ["id", "s", "t"]).collect()}
    assert found["1"] == ("a<b>&\"c\"", None)
    assert found["2"][1] == "x"


COMMENTED = '  <!-- <table name="t"><column name="id">99</column></table> -->\n'


@pytest.mark.parametrize("splittable", [True, False])
def test_commented_rows_are_no_rows(spark, dump, splittable):
    path = dump(row(id=1), COMMENTED, row(id=2))
    assert sorted(dump_rows(spark, path, ["id"], splittable=splittable).collect()) == [("1",), ("2",)]


@pytest.mark.parametrize("splittable", [True, False])
def test_comments_without_closing_tags_are_left_out(spark, dump, splittable):
    path = dump(row(id=1), "<!-- <table name='t'> only a start -->", row(id=2, name="<![CDATA[<!-- kept -->]]>"))
    found = dump_rows(spark, path, ["id", "name"], splittable=splittable).collect()
    assert sorted(found, key=str) == [("1", None), ("2", "<!-- kept -->")]


def test_a_row_tag_is_no_pattern(spark, tmp_path):
    path = tmp_path / "dump.xml"
    path.write_text('<d><a.b name="t"><column name="id">1</column></a.b><axb name="t"><column name="id">2</column></axb></d>')
    assert dump_rows(spark, str(path), ["id"], row_tag="a.b").collect() == [("1",)]


def test_everything_in_a_blob_is_kept(spark):
    blobs = [
        (1, '<note lang="en"><to>a</to><cc>x</cc><cc>y</cc><empty/></note>'),
        (2, '<?xml version="1.0"?>\n<!-- c -->\n<memo><n>12</n></memo>'), (3, None),
    ]
    rows = spark.createDataFrame(blobs, "id int, x string")
    found = [r.json for r in blob_to_json(rows, "x").orderBy("id").collect()]
    assert json.loads(found[0]) == {"note": {"_lang": "en", "to": "a", "cc": ["x", "y"], "empty": ""}}
    assert json.loads(found[1]) == {"memo": {"n": "12"}}
    assert found[2] is None


def test_a_foreign_root_is_not_taken_for_another(spark):
    rows = spark.createDataFrame([(1, "<memo><to>a</to></memo>"), (2, "<note><to>b</to></note>")], "id int, x string")
    with pytest.raises(Exception, match="unexpected root"):
        blob_to_json(rows, "x", "to string", "note").collect()
    found = blob_to_json(rows, "x", "to string", "note", strict=False).orderBy("id").collect()
    assert [r.json for r in found] == [None, '{"note":{"to":"b"}}']


def test_values_stay_as_they_are_written(spark):
    blobs = [
        "<r><a>00123</a><b>1.10</b><c>1e5</c></r>", "<r><a>true</a><b>007</b><b>+1</b><d><e k='0.50'>2024-01-05</e></d></r>",
        '<s><d><e>NaN</e></d><a/></s>', None,
    ]
    rows = spark.createDataFrame([(n, b) for n, b in enumerate(blobs)], "id int, blob string").repartition(3)
    found = [r.json and json.loads(r.json) for r in blob_to_json(rows, "blob").orderBy("id").collect()]
    assert found == [
        {"r": {"a": "00123", "b": ["1.10"], "c": "1e5"}},
        {"r": {"a": "true", "b": ["007", "+1"], "d": {"e": {"_k": "0.50", "_VALUE": "2024-01-05"}}}},
        {"s": {"a": "", "d": {"e": {"_VALUE": "NaN"}}}}, None,
    ]
    typed = blob_to_json(rows.where("id = 0"), "blob", "a int, b double").first().json
    assert json.loads(typed) == {"r": {"a": 123, "b": 1.1}}


def test_broken_texts_add_nothing_to_the_schema(spark):
    rows = spark.createDataFrame([(1, "<r><a>1</a></r>"), (2, "<r><b>"), (3, "no xml")], "id int, x string")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        blob_to_json(rows, "x").collect()
    assert [r.json for r in blob_to_json(rows, "x", strict=False).orderBy("id").collect()] == ['{"r":{"a":"1"}}', None, None]
    assert blob_to_json(rows.limit(0), "x").collect() == []
    empty = blob_to_json(spark.createDataFrame([("<r/>",), (None,)], "x string"), "x", strict=False).collect()
    assert sorted((r.json for r in empty), key=str) == [None, '{"r":{}}']
