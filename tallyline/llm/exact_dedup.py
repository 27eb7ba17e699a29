"""Exact dedup by deterministic block naming, in DataFrame functions only.

The text without white space is cut into blocks of fixed size. The distinct blocks are sorted and
get integers as names; then adjacent names are paired, the distinct pairs are sorted and named in
turn, until each document has one name. A document's identity is its last name with the level on
which it was given: equal texts have equal identities, different texts have different ones.

Blocks are sorted by a 64-bit key of their content. All contents are compared under their key
first, and contents that share a key get ordinals, so no name rests on a hash alone. Only that
comparison moves contents, and tasks drop repeated blocks before they do; keys and names are
moved after it. A name held by a third of all rows is split by Spark's skew join, as the tables of
names have a row for each name.

Null text counts as empty; empty texts are equal. Rows that repeat a doc_id are rows of their own.
Of equal rows one is kept. Ids are of any type that has an order; a null one comes after all others.
"""

import math

from pyspark.sql import functions as F

from tallyline.llm.common import filled, numbered, staying
from tallyline.session import written

SPACE = "[ \\t-\\r]+"  # the characters x20 and x09 to x0D
BLOCK_BYTES = 4096
NO_NAME = -1


def normalised(text):
    return F.regexp_replace(text, SPACE, "")


def _blocks(text, size):
    """A text's bytes in blocks; one empty block for an empty text."""
    count = F.greatest(F.ceil(F.octet_length(text) / size), F.lit(1)).cast("int")
    content = F.encode(text, "UTF-8")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(content, i * size + 1, F.lit(size)))


def _clashes(texts, size, key):
    """Contents that share their key with other contents, with ordinals; none is the rule.

    Of n blocks about n * n / 2**65 are expected here, so the list is for the driver.
    """
    blocks = texts.select(F.explode(_blocks(F.col("norm"), size)).alias("block")).select(
        key(F.col("block")).alias("key"), "block"
    )
    keys = written(
        blocks.distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "clash-keys"
    )
    if keys.isEmpty():
        return []
    rows = blocks.join(keys, "key", "left_semi").distinct().collect()
    by_key = {}
    for row in sorted(rows, key=lambda r: (r["key"], bytes(r["block"]))):
        by_key.setdefault(row["key"], []).append(bytes(row["block"]))
    return [(k, b, i) for k, contents in by_key.items() for i, b in enumerate(contents) if i]


def _ordinal(key, block, clashes):
    found = F.lit(0)
    for k, content, i in clashes:
        found = F.when((key == k) & (block == F.lit(bytearray(content))), F.lit(i)).otherwise(found)
    return found


def identities(docs, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES, key=F.xxhash64):
    """Rows of `docs` with level and name: row_id, id_col, n_chars, text_key, text_sha256, level, name.

    `key` gives a block's sort key; any function of the content is right.
    """
    texts = docs.select(F.col(id_col).alias(id_col), filled(text_col).alias("text"))
    texts = texts.withColumn("norm", normalised(F.col("text")))
    clashes = _clashes(texts, block_bytes, key)
    rows = written(texts.select(
        F.monotonically_increasing_id().alias("row_id"), id_col,
        F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("text_key"),
        F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"),
        F.transform(_blocks(F.col("norm"), block_bytes), lambda b: F.struct(
            key(b).alias("key"), _ordinal(key(b), b, clashes).alias("ordinal")
        )).alias("blocks"),
    ), "block-keys")
    longest = rows.agg(F.max(F.size("blocks"))).first()[0] or 1

    placed = rows.select(
        "row_id", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block")
    ).select("row_id", "n", "pos", "block.key", "block.ordinal")
    names = numbered(placed, ["key", "ordinal"], "block-names")
    current = placed.join(names, ["key", "ordinal"]).select("row_id", "n", "pos", "name")
    if longest > 1:
        current = written(current, "named-0")
    ended = current.where("n = 1").select("row_id", F.lit(0).alias("level"), "name")
    for level in range(1, math.ceil(math.log2(longest)) + 1):
        pairs = current.where("n > 1").groupBy(
            "row_id", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")
        ).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_NAME)).alias("right"),
        )
        names = numbered(pairs, ["left", "right"], "pair-names")
        current = written(pairs.join(names, ["left", "right"]).select("row_id", "n", "pos", "name"), f"named-{level}")
        ended = ended.unionByName(current.where("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
    return rows.drop("blocks").join(ended, "row_id")


def exact_groups(docs, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES, key=F.xxhash64):
    """A row for each row of `docs`: id, keep_id, group_size, kept, text_sha256, n_chars, text_key.

    Of equal texts the row with the most code points in the original text, then the smallest id stays.
    """
    named = written(identities(docs, id_col, text_col, block_bytes, key), "identities")
    # the least of (fewer code points, no id, id, row), so ids may be of any type that has an order
    best = F.min(F.struct((-F.col("n_chars")).alias("short"), F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "row_id"))
    groups = written(named.groupBy("level", "name").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    return named.join(groups, ["level", "name"]).select(
        id_col, F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"), "text_sha256", "n_chars", "text_key",
    )


def keep_one(docs, id_col="doc_id", text_col="text"):
    """The rows of `docs` that stay, with all their columns."""
    return staying(docs, written(exact_groups(docs, id_col, text_col), "exact-groups"), id_col, text_col)
