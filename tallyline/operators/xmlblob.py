"""XML held in a column, as JSON."""

import json

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<([^\s/>]+)"
BROKEN = "_corrupt_record"


def merged_schema(rows, column, strict=True):
    """One schema for all XML texts of a column, merged from their element trees in a distributed aggregation.

    Its leaves are strings, and an element that any text repeats is an array. A text that is not XML
    fails the job, or, when not strict, adds nothing.
    """
    spark = rows.sparkSession
    texts = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))
    texts = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    reader = spark.read.option("inferSchema", False).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("rowTag", "row")
    schema = StructType.fromJson(json.loads(reader._jreader.xml(texts).schema().json()))
    return StructType([field for field in schema if field.name != BROKEN])


def blob_to_json(rows, column, schema=None, root=None, name="json", strict=True):
    """Add `name`, the XML text of `column` as ``{"<root>": {...}}``.

    Without a schema all elements and attributes are kept, by the schema merged from all texts, which
    reads the column once more: attributes as ``_name``, text beside them as ``_VALUE``, elements that
    any text repeats as arrays, and all values as texts, as they are written. With a schema only its
    fields are kept, by its types. Spaces at the ends of texts go both ways, empty elements are empty
    texts. Text that is not XML, or has another root than `root` where that is given, fails the job, or
    gives null when not strict.
    """
    text = F.col(column)
    found = F.regexp_extract(text, ROOT, 1)
    fits = found != "" if root is None else found == root
    if schema is None:
        schema = merged_schema(rows, column, strict)
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if strict:
        record = F.to_json(F.from_xml(text, schema, {"mode": "FAILFAST"}))
    else:
        marked = StructType([*schema.fields, StructField(BROKEN, StringType())])
        whole = F.from_xml(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
        record = F.when(whole[BROKEN].isNull(), F.to_json(whole.dropFields(BROKEN)) if len(schema) else F.lit("{}"))
    said = F.concat(F.lit('{"'), found, F.lit('":'), record, F.lit("}"))
    problem = F.concat(F.lit("unexpected root in "), F.substring(text, 1, 200))
    wrong = F.raise_error(problem).cast("string") if strict else F.lit(None).cast("string")
    return rows.withColumn(name, F.when(text.isNotNull(), F.when(fits, said).otherwise(wrong)))
