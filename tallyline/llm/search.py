"""Ranked lexical search by dense multiplication: every document's score for every query item.

A score is the sum over an item's terms of term weight times the document's impact of the term, all in
whole numbers. Documents are cut into rows of (length, item terms, their numbers), written once; the
number of documents with a term, of documents and of terms come from these rows, over the whole table.
Then tiles of documents times item terms, as impacts, are multiplied with tiles of item terms times items,
as weights, by BLAS in float64. A tile of terms is cut so that no sum of its products reaches 2**53, so
every partial sum is exact; the tiles are added as 64-bit integers. Each task keeps the best documents of
each item, all that tie for the last place of a tile included until ids have decided; windows over
buckets of documents, then over items, rank what the tasks kept.

Items are worked off in blocks of PAIRS different terms at most (or one item), whose terms and weights are
broadcast; each block reads the documents once. Terms are the words of `terms`; null and empty texts have
none. Items without terms, or whose terms no document has, give no rows; neither does an empty table.
Repeated items are ranked one by one, repeated documents each take a rank, equal scores go by ascending
id, a null id last. Other columns are not looked at.
"""

import math
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyline.llm.common import ship_package
from tallyline.llm.terms import Vocabulary, runs, words
from tallyline.operators.ordered import sum_before
from tallyline.session import written

PAIRS = 250_000
DOCS, TERMS, ITEMS = 512, 2048, 256  # documents, terms and items of a tile
BUCKETS = 32
HIGHEST = 1_000_000  # no impact reaches it
SAFE = (1 << 53) // HIGHEST  # weights of an item that a tile may add up to


def impact(tf, length_norm):
    """What a term gives a document that has it `tf` times."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * length_norm)


def length_norm(n, many, total):
    """The share of a document's length in its impacts, for `many` documents of `total` terms."""
    return 75 + 25 * n * many // total


def weight(many, df):
    return math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1)))


def _counted_items(items, item_col, text_col):
    """A row per item: its own number, its id, its different terms and how often it has them."""
    @F.pandas_udf("terms array<binary>, counts array<long>")
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            terms, counts = np.unique(np.array(words(text), dtype=object), return_counts=True)
            rows.append((list(terms), counts))
        return pd.DataFrame(rows, columns=["terms", "counts"])

    counted = items.select(
        F.monotonically_increasing_id().alias("item_"), F.col(item_col).alias("id_"), count(F.col(text_col).cast("string").cast("binary")).alias("of_")
    )
    rows = counted.select("item_", "id_", "of_.*").withColumn("size_", F.size("terms").cast("long"))
    return written(rows.where("size_ > 0"), "search-items")


class Block:
    """The terms of some items (number, terms, counts), and tiles of their weights."""

    def __init__(self, rows):
        self.items = [r.item_ for r in rows]
        self.vocabulary = Vocabulary(sorted({bytes(t) for r in rows for t in r.terms}))
        self.item = np.repeat(np.arange(len(rows)), [len(r.terms) for r in rows])
        self.term = np.array([self.vocabulary[bytes(t)] for r in rows for t in r.terms], np.int64)
        self.count = np.array([c for r in rows for c in r.counts], np.int64)

    def weigh(self, many, df):
        """Tiles (first item, items, terms, and the weights as places among the terms, items and values), with `df` by term."""
        by_term = np.array([weight(many, n) for n in df], np.int64)
        weights, tiles = self.count * by_term[self.term], []
        parts = np.maximum(-(-weights // SAFE), 1)  # a weight beyond SAFE stands in several columns
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(weights, parts)
        item, column = np.repeat(self.item, parts), np.repeat(self.term, parts) + part * len(df)
        value = np.minimum(whole - part * SAFE, SAFE)
        for first in range(0, len(self.items), ITEMS):
            here = (item >= first) & (item < first + ITEMS)
            many_items = min(ITEMS, len(self.items) - first)
            for cut in _cut(item[here] - first, column[here], value[here], many_items):
                columns, place = np.unique(column[here][cut], return_inverse=True)
                tiles.append((first, many_items, columns % len(df), (place.ravel(), item[here][cut] - first, value[here][cut])))
        return tiles


def _cut(item, column, value, many_items):
    """Cuts of some weights by column, of TERMS columns at most and sums that stay exact."""
    waiting = [np.argsort(column, kind="stable")]
    while waiting:
        rows = waiting.pop()
        columns = np.unique(column[rows])
        sums = np.zeros(many_items, np.int64)
        np.add.at(sums, item[rows], value[rows])
        if len(columns) <= TERMS and sums.max(initial=0) <= SAFE:
            if len(rows):
                yield rows
            continue
        middle = columns[len(columns) // 2]
        waiting += [rows[column[rows] >= middle], rows[column[rows] < middle]]


def _postings(docs, id_col, text_col, known):
    """Documents that have terms: id, number of terms, item terms in ascending order and how often they occur."""
    @F.pandas_udf("n long, terms array<int>, counts array<int>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        vocabulary, rows = known.value.vocabulary, []
        for a, b in runs(texts):
            numbers = vocabulary.stream(texts[a:b])
            ends = np.flatnonzero(numbers == -1)
            sizes = np.diff(np.concatenate(([-1], ends))) - 1
            doc = np.repeat(np.arange(len(sizes)), sizes + 1)
            mine = numbers > 0
            keys = np.sort(doc[mine] * (1 << 32) + numbers[mine])
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
            keys, counts = keys[new], np.diff(np.append(new, len(keys)))
            bounds = np.searchsorted(keys, np.arange(len(sizes) + 1) << 32)
            terms = (keys & 0xFFFFFFFF).astype(np.int32)
            rows += [(n, terms[x:y], counts[x:y]) for n, x, y in zip(sizes, bounds, bounds[1:])]
        return pd.DataFrame(rows, columns=["n", "terms", "counts"])

    cut_docs = docs.select(F.col(id_col).alias("doc_"), cut(F.col(text_col).cast("string").cast("binary")).alias("of_"))
    return written(cut_docs.select("doc_", "of_.*").where("n > 0"), "search-postings")


def _multiplied(many_docs, held, tiles):
    """Scores of documents for the items of some tiles, from (document, term, impact) rows."""
    doc, term, value = held
    scores = np.zeros((many_docs, tiles[0][1]), np.int64)
    for _, many_items, columns, (place, item, weights) in tiles:
        column = np.minimum(np.searchsorted(columns, term), len(columns) - 1)
        here = columns[column] == term
        impacts, dense = np.zeros((many_docs, len(columns))), np.zeros((len(columns), many_items))
        impacts[doc[here], column[here]] = value[here]
        dense[place, item] = weights
        scores += (impacts @ dense).astype(np.int64)
    return scores


def _scored(postings, known, tiles, many, total, top, doc_type):
    """The best documents of each item in each task: item, document, score."""
    out_type = pa.schema([("item_", pa.int64()), ("doc_", doc_type), ("score", pa.int64())])

    def multiply(batches):
        own, cells = known.value, tiles.value
        pools, least = {}, np.ones(len(own.items), np.int64)
        for batch in batches:
            ids = pd.Series(batch.column("doc_"), dtype=pd.ArrowDtype(doc_type))
            norm = length_norm(batch.column("n").to_numpy(), many, total)
            lists = batch.column("terms")
            doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy()
            value = impact(batch.column("counts").flatten().to_numpy().astype(np.int64), norm[doc])
            for lo in range(0, len(ids), DOCS):
                here = slice(*np.searchsorted(doc, (lo, lo + DOCS)))
                held = doc[here] - lo, term[here], value[here]
                many_docs = min(DOCS, len(ids) - lo)
                for first, group in groupby(cells, key=lambda tile: tile[0]):
                    scores = _multiplied(many_docs, held, list(group))
                    limit = least[first:first + scores.shape[1]]
                    if many_docs > top:
                        limit = np.maximum(limit, np.partition(scores, many_docs - top, axis=0)[many_docs - top])
                    at, item = np.nonzero(scores >= limit)
                    if not len(at):
                        continue
                    more = pd.DataFrame({"item": item + first, "score": scores[at, item], "doc": ids.iloc[at + lo].reset_index(drop=True)})
                    pool = pd.concat([pools[first], more], ignore_index=True) if first in pools else more
                    pools[first] = pool = pool.sort_values(["item", "score", "doc"], ascending=[True, False, True]).groupby("item").head(top)
                    count = pool.groupby("item")["score"].agg(["size", "min"])
                    full = count[count["size"] >= top]
                    least[full.index.to_numpy()] = full["min"].to_numpy()
        for pool in pools.values():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.array(own.items, np.int64)[pool["item"].to_numpy()]), pa.array(pool["doc"]).cast(doc_type),
                pa.array(pool["score"].to_numpy(), pa.int64()),
            ], schema=out_type)

    kind = postings.schema["doc_"].dataType.simpleString()
    return postings.mapInArrow(multiply, f"item_ long, doc_ {kind}, score long")


def ranked(docs, items, top=20, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"):
    """The `top` documents of each item whose score is above 0: `item_col`, `rank` from 1, `id_col`, `score`."""
    spark = docs.sparkSession
    ship_package(spark)
    counted = _counted_items(items, item_col, item_text_col)
    pairs = counted.agg(F.sum("size_")).first()[0] or 0
    before = sum_before(counted, ["item_"], F.col("size_"), "before_")
    blocks = written(before.withColumn("block_", F.floor(F.col("before_") / PAIRS)), "search-blocks")
    best = None
    for number in range(pairs // PAIRS + 1):
        rows = blocks.where(F.col("block_") == number).select("item_", "terms", "counts").orderBy("item_").collect()
        known = spark.sparkContext.broadcast(Block(rows))
        postings = _postings(docs, id_col, text_col, known)
        many, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(known.value.vocabulary), np.int64)  # by term; the mark's place is that of no term
        for r in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        tiles = spark.sparkContext.broadcast(known.value.weigh(many, df))
        doc_type = to_arrow_type(postings.schema["doc_"].dataType)
        own = written(_scored(postings, known, tiles, many, total or 1, top, doc_type), "search-best")
        known.destroy()
        tiles.destroy()
        best = own if best is None else best.union(own)
    order = [F.col("score").desc(), F.col("doc_").asc_nulls_last()]
    few = best.withColumn("bucket_", F.pmod(F.xxhash64("doc_"), F.lit(BUCKETS)))
    few = few.withColumn("place_", F.row_number().over(Window.partitionBy("item_", "bucket_").orderBy(*order))).where(F.col("place_") <= top)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_").orderBy(*order))).where(F.col("rank") <= top)
    return few.join(counted.select("item_", "id_"), "item_").select(F.col("id_").alias(item_col), "rank", F.col("doc_").alias(id_col), "score")
