"""Benchmark decontamination: documents' words that lie inside word windows of benchmark items.

An item's windows are all runs of WINDOW of its words; an item of fewer words is one window. A hash set
of the windows is broadcast. The words of the documents are scanned as one stream of numbers per task:
runs of known words are hashed by position, hashes that the set holds are compared word by word with its
windows, and what is equal is a hit. Hit words give the spans to cut out, or the documents to drop.

What is broadcast holds BLOCK words of benchmark text at most, as items are cut into overlapping pieces.
A larger benchmark is worked off in blocks: each block's scan writes the documents it hits, and these are
put together per document. Nothing else is shuffled.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Null and
empty texts have no words. Items of one id are one item, a null id counts as empty text, and items without
words have no windows. Repeated documents each get their own result, other columns are kept as they are,
and empty tables on either side give documents without hits, or none.
"""

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyline.llm.common import ship_package
from tallyline.llm.terms import Vocabulary, runs, words
from tallyline.operators.ordered import sum_before
from tallyline.session import written

WINDOW = 10
BLOCK = 500_000  # words of benchmark text in one broadcast
PIECE = 50_000  # words of one item in one row
STRETCH = 1 << 20  # words that are hashed at a time
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hashes(numbers, size):
    """Hashes of all runs of `size` numbers."""
    terms = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    terms ^= terms >> np.uint64(32)
    count = len(numbers) - size + 1
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * FACTOR + terms[k:k + count]
    return total ^ (total >> np.uint64(29))


class Windows:
    """The different windows of one length, sorted by hash, and the items that have them."""

    def __init__(self, rows, owners):
        self.size = rows.shape[1]
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        hashes = np.concatenate([_hashes(row, self.size) for row in self.rows])
        order = np.argsort(hashes, kind="stable")
        self.rows, self.hashes = self.rows[order], hashes[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack((place[which.ravel()], owners), axis=1), axis=0)
        self.first = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        self.owners = pairs[:, 1]
        self.shift = np.uint64(64 - min(24, max(12, int(np.log2(len(order))) + 5)))
        self.seen = np.zeros(1 << int(64 - self.shift), bool)
        self.seen[self.hashes >> self.shift] = True

    def found(self, numbers):
        """(first words, windows) of the windows that occur in a stream."""
        known = np.cumsum(numbers <= 0)
        count = len(numbers) - self.size + 1
        if count <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(known[self.size - 1:] == np.concatenate(([0], known))[:count])
        hashes = _hashes(numbers, self.size)[at]
        some = self.seen[hashes >> self.shift]
        at, hashes = at[some], hashes[some]
        window = np.searchsorted(self.hashes, hashes)
        places, windows = [], []
        while len(at):  # windows that share a hash lie side by side
            held = window < len(self.hashes)
            at, hashes, window = at[held], hashes[held], window[held]
            held = self.hashes[window] == hashes
            at, hashes, window = at[held], hashes[held], window[held]
            same = (numbers[at[:, None] + np.arange(self.size)] == self.rows[window]).all(axis=1)
            places.append(at[same])
            windows.append(window[same])
            at, hashes, window = at[~same], hashes[~same], window[~same] + 1
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, windows))

    def items(self, windows):
        """The items that have any of some windows."""
        return np.unique(np.concatenate([self.owners[self.first[w]:self.first[w + 1]] for w in np.unique(windows)]))


class Index:
    """The windows of some pieces (item, words joined by spaces)."""

    def __init__(self, pieces):
        texts = [data.split() for _, data in pieces]
        self.vocabulary = Vocabulary(sorted({w for text in texts for w in text}))
        self.names = sorted({item for item, _ in pieces})
        number = {name: i for i, name in enumerate(self.names)}
        by_size = {}
        for (item, _), text in zip(pieces, texts):
            ids = np.array([self.vocabulary[w] for w in text], np.int32)
            size = min(WINDOW, len(ids))
            rows, owners = by_size.setdefault(size, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(ids, size))
            owners.append(np.full(len(ids) - size + 1, number[item], np.int64))
        self.windows = [Windows(np.concatenate(rows), np.concatenate(owners)) for rows, owners in by_size.values()]
        self.overlap = max((w.size for w in self.windows), default=1) - 1

    def scan(self, texts):
        """(words, first hit words of runs, words behind the runs, items) of each text."""
        numbers = self.vocabulary.stream(texts)
        ends = np.flatnonzero(numbers == -1)
        starts = np.concatenate(([0], ends[:-1] + 1))
        change, hits = None, []
        for lo in range(0, len(numbers), STRETCH):
            stretch = numbers[lo:lo + STRETCH + self.overlap]
            for which, windows in enumerate(self.windows):
                at, found = windows.found(stretch)
                here = at < STRETCH
                at, found = at[here] + lo, found[here]
                if len(at):
                    change = np.zeros(len(numbers) + 1, np.int32) if change is None else change
                    np.add.at(change, at, 1)
                    np.add.at(change, at + windows.size, -1)
                    hits.append(np.stack((np.searchsorted(ends, at), np.full(len(at), which), found), axis=1))
        out = [(int(b - a), [], [], []) for a, b in zip(starts, ends)]
        if change is None:
            return out
        inside = np.cumsum(change[:-1]) > 0
        hits = np.unique(np.concatenate(hits), axis=0)
        bounds = np.append(np.flatnonzero(np.concatenate(([True], hits[1:, 0] != hits[:-1, 0]))), len(hits))
        for a, b in zip(bounds, bounds[1:]):
            text = int(hits[a, 0])
            hit = np.concatenate(([0], inside[starts[text]:ends[text]].astype(np.int8), [0]))
            edges = np.flatnonzero(np.diff(hit))
            own = hits[a:b]
            items = np.unique(np.concatenate([self.windows[k].items(own[own[:, 1] == k, 2]) for k in np.unique(own[:, 1])]))
            out[text] = (out[text][0], edges[::2], edges[1::2], [self.names[i] for i in items])
        return out


def _pieces(benchmark, item_col, text_col):
    """Items' words in overlapping pieces that keep every window: item, words as one text, their number."""
    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found, rows = words(text), []
            for at in range(0, max(len(found) - WINDOW + 1, min(len(found), 1)), PIECE):
                rows.append(b" ".join(found[at:at + PIECE + WINDOW - 1]))
            out.append(rows)
        return pd.Series(out)

    item = F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item")
    rows = benchmark.select(item, F.explode(cut(F.col(text_col).cast("string").cast("binary"))).alias("piece")).distinct()
    return written(rows.withColumn("words", F.size(F.split(F.col("piece").cast("string"), " ")).cast("long")), "benchmark-pieces")


def _scan(known):
    @F.pandas_udf("n_words long, starts array<long>, ends array<long>, items array<string>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        index, rows = known.value, []
        for a, b in runs(texts):
            rows += index.scan(texts[a:b])
        return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return scan


def _joined_runs(starts, ends):
    """Runs of hit words where some may overlap, as a column (starts, ends) without overlaps."""
    @F.pandas_udf("starts array<long>, ends array<long>")
    def join(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = []
        for a, b in zip(starts, ends):
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
            rows.append((a[new], b[np.append(new[1:] - 1, len(b) - 1)]))
        return pd.DataFrame(rows, columns=["starts", "ends"])

    return join(starts, ends)


def hits(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", name="hits"):
    """`docs` with a column `name`: n_words, runs of hit words as `starts` and `ends` (behind the last), and `items`, sorted."""
    spark = docs.sparkSession
    ship_package(spark)
    pieces = _pieces(benchmark, item_col, item_text_col)
    text = F.col(text_col).cast("string").cast("binary")

    def block(rows):
        return spark.sparkContext.broadcast(Index([(r.item, bytes(r.piece)) for r in rows.collect()]))

    total = pieces.agg(F.sum("words")).first()[0] or 0
    if total <= BLOCK:
        return docs.withColumn(name, _scan(block(pieces))(text))
    before = sum_before(pieces, ["item", "piece"], F.col("words"), "before")
    blocks = written(before.withColumn("block", F.floor(F.col("before") / BLOCK)), "benchmark-blocks")
    keys = [F.col(id_col).alias("id_"), F.sha2(text, 256).alias("key_")]
    found = None
    for number in range(total // BLOCK + 1):
        known = block(blocks.where(F.col("block") == number))
        own = docs.select(*keys, _scan(known)(text).alias("of_")).where(F.size("of_.items") > 0).select("id_", "key_", "of_.*")
        own = written(own, "benchmark-hits")
        known.destroy()
        found = own if found is None else found.union(own)
    grouped = found.groupBy("id_", "key_").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")])
    runs_of = grouped.select("id_", "key_", F.array_sort(F.array_distinct("items")).alias("items_"), _joined_runs("starts", "ends").alias("runs_"))
    empty = spark.sparkContext.broadcast(Index([]))
    base = docs.withColumn(name, _scan(empty)(text)).withColumns({"own_id_": F.col(id_col), "own_key_": F.sha2(text, 256)})
    same = F.col("own_id_").eqNullSafe(F.col("id_")) & F.col("own_key_").eqNullSafe(F.col("key_"))
    of = {f: F.coalesce(F.col(f"runs_.{f}"), F.col(f"{name}.{f}")).alias(f) for f in ("starts", "ends")}
    items = F.coalesce("items_", F.col(f"{name}.items")).alias("items")
    joined = base.join(runs_of, same, "left")
    return joined.withColumn(name, F.struct(F.col(f"{name}.n_words").alias("n_words"), of["starts"], of["ends"], items)).drop(
        "own_id_", "own_key_", "id_", "key_", "items_", "runs_"
    )


def n_hit(name="hits"):
    """The number of hit words of a column of hits."""
    sizes = F.zip_with(f"{name}.ends", f"{name}.starts", lambda b, a: b - a)
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda total, size: total + size)


def _without(text, starts, ends):
    """A text's bytes, as a text, without the runs of words."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for data, first, last in zip(texts, starts, ends):
            if data is not None and len(first):
                spans, kept, at = [m.span() for m in WORD.finditer(data)], [], 0
                for a, b in zip(first, last):
                    kept.append(data[at:spans[a][0]])
                    at = spans[b - 1][1]
                data = b"".join(kept) + data[at:]
            out.append(None if data is None else data.decode("utf-8", "replace"))
        return pd.Series(out)

    return cut(text, starts, ends)


def decontaminated(docs, benchmark, remove="spans", text_col="text", **columns):
    """`docs` without the documents that are hit, or, with ``remove="spans"``, without the text from a run's first hit word to its last."""
    found = hits(docs, benchmark, text_col=text_col, name="hits_", **columns)
    hit = F.size("hits_.items") > 0
    if remove == "documents":
        return found.where(~hit).drop("hits_")
    text = F.col(text_col).cast("string")
    cleaned = F.when(hit, _without(text.cast("binary"), F.col("hits_.starts"), F.col("hits_.ends"))).otherwise(text)
    return found.withColumn(text_col, cleaned).drop("hits_")
