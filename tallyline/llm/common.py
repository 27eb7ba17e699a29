"""Helpers shared by the operators of this subpackage."""

import os
import tempfile
import zipfile

from pyspark.sql import Window, functions as F

import tallyline
from tallyline.session import written

_shipped = set()
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
FIT_BYTES = 64 << 20  # of texts that one classifier learns from


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(column):
    """A text column with nulls as empty texts."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def numbered(df, columns, label):
    """Distinct rows of `columns`, sorted, each with an integer `name` that respects the order.

    The names depend on how the sorted rows are cut into partitions, so the table is written once
    and read from there.
    """
    ordered = df.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    return written(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def ship_package(spark):
    """Give the executors this package, once for each application, and keep their batches small.

    Texts may be long, so a batch of Arrow's default number of rows could take a worker's memory.
    """
    if int(spark.conf.get(BATCH)) > BATCH_ROWS:
        spark.conf.set(BATCH, BATCH_ROWS)
    if spark.sparkContext.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(tallyline.__file__))
    path = os.path.join(tempfile.mkdtemp(), "tallyline.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(spark.sparkContext.applicationId)


def rows_to_fit(docs, chosen, mark, max_rows, max_bytes, id_col, text_col):
    """Rows (mark, text_key, value, text) to fit a classifier on: at most `max_rows`, of `max_bytes` together.

    `chosen` are at most `max_rows` labels (label_id, value); `mark` is a hash of label_id. The first rows by
    mark and text_key are taken as long as they fit, without texts of over a sixteenth of `max_bytes`; rows
    that repeat id and text are one. Only hashes and sizes are sorted, so long texts stay where they are.
    """
    texts = docs.select(F.col(id_col).alias("label_id"), filled(text_col).alias("text"))
    known = texts.join(F.broadcast(chosen), "label_id").withColumns({"mark": mark, "text_key": F.xxhash64("text")})
    sizes = known.groupBy("mark", "text_key").agg(F.max(F.octet_length("text").cast("long")).alias("bytes"))
    first = sizes.where(F.col("bytes") <= max_bytes // 16).orderBy("mark", "text_key").limit(max_rows)
    so_far = F.sum("bytes").over(Window.orderBy("mark", "text_key"))
    taken = written(first.withColumn("so_far", so_far).where(F.col("so_far") <= max_bytes).select("mark", "text_key"), "rows-to-fit")
    rows = known.join(F.broadcast(taken), ["mark", "text_key"])
    return rows.groupBy("mark", "text_key").agg(F.first("value").alias("value"), F.first("text").alias("text"))


def components(pairs, label):
    """Connected components of pairs (a, b): a row (node, label) for each node, with its least node as label.

    Each round takes the least label among a node's own and its neighbours', then the label of that
    label, until none changes.
    """
    pairs = written(pairs.select("a", "b").distinct(), f"{label}-pairs")
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), f"{label}-0")
    changed, turn = not labels.isEmpty(), 0
    while changed:
        turn += 1
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other")
        least = seen.groupBy("node").agg(F.min("label").alias("least"))
        nearer = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = nearer.join(further, "label", "left").select(
            "node", "old", F.coalesce(F.least("label", "beyond"), F.col("label")).alias("label")
        )
        moved = written(moved, f"{label}-{turn}")
        changed = not moved.where("old <> label").isEmpty()
        labels = moved.drop("old")
    return labels


def staying(docs, groups, id_col, text_col):
    """The rows of `docs` that `groups` (id_col, text_key, kept) keeps, with all their columns."""
    kept = groups.where("kept").select(F.col(id_col).alias("id_"), F.col("text_key").alias("key_"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(id_col).alias("own_id_"),
        F.xxhash64(filled(text_col)).alias("own_key_"),
    )
    stay = rows.join(kept, F.col("own_id_").eqNullSafe(F.col("id_")) & (F.col("own_key_") == F.col("key_")), "left_semi")
    if not groups.groupBy(id_col, "text_key").count().where("count > 1").isEmpty():
        # rows that repeat both id and text: one of them stays
        stay = stay.groupBy("own_id_", "own_key_").agg(F.first("row_").alias("row_"))
    return stay.select("row_.*")
