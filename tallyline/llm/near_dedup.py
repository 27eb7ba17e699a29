"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's shingles of five words weigh their count times their inverse document frequency. Improved
consistent weighted sampling draws SAMPLES of them, so that two texts draw the same one with the
probability of their weighted Jaccard similarity. ROWS samples form a band; texts that share a band are
candidates, and those whose signatures agree in at least AGREE places are compared on their whole
weighted sets: a similarity of THRESHOLD or more is a link. Classes are the connected components.
With these numbers a pair of similarity 0.8 shares a band with probability 0.9994, of 0.9 with 1 - 6e-7.

Document frequency is exact for shingles found in at least COMMON of all documents; rarer ones have
the full weight 1, and one found everywhere weighs FLOOR. There are at most mean set size / COMMON
common shingles, whatever the number of documents, so that table is sent to the tasks.

Rows of equal sets are one text to all later steps. Large buckets and clusters are cut into blocks. Each
block is first linked by itself and with the bucket's first row, the hub; that takes a row for each text.
What is connected to the hub by then needs no comparison among itself. Only the texts that are still apart
from it meet all blocks, in blocks of their own, so every pair that is not yet connected is compared. A
task holds two blocks at most, and a group gives a spanning forest of its links, never all of them.

Texts without words equal those of the same characters only; null counts as empty. Rows that repeat a
doc_id are rows of their own. A class has the smallest doc_id of its rows as its id, and that row
stays (the first of several). Ids are of any type that has an order; a null one comes after all others.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyline.llm.common import components, filled, ship_package, staying
from tallyline.llm.words import mixed, shingles, words_of
from tallyline.session import written

SHINGLE_WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
AGREE = 32
COMMON, FLOOR = 0.01, 0.85
FLUSHED = 1 << 21  # shingles that are counted together
BLOCK_TEXTS, BLOCK_SHINGLES = 500, 500_000
LEVELS = 1 << 16


def _gamma_quantiles():
    """Quantiles of the gamma distribution of shape 2, at the middles of LEVELS equal steps."""
    x = np.geomspace(1e-4, 60, 1 << 18)
    below = -np.expm1(-x) - x * np.exp(-x)
    return np.interp((np.arange(LEVELS) + 0.5) / LEVELS, below, x).astype(np.float32)


GAMMA = _gamma_quantiles()
LOG_GAMMA = np.log(GAMMA)
UNIFORM = ((np.arange(LEVELS) + 0.5) / LEVELS).astype(np.float32)
SEEDS = np.random.Generator(np.random.PCG64(6)).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def weighted_samples(hashes, weights):
    """The consistent weighted samples of a set, as a 64-bit hash each."""
    out = np.empty(SAMPLES, np.uint64)
    logs = None if (weights == 1).all() else np.log(weights)
    for first in range(0, SAMPLES, 8):
        # four independent numbers of 16 bits for each shingle and sample, the lowest unused
        drawn = (hashes[None, :] * SEEDS[first:first + 8, None]).view(np.uint16).reshape(8, len(hashes), 4)
        rate, shift = GAMMA.take(drawn[:, :, 3]), UNIFORM.take(drawn[:, :, 1])
        if logs is None:
            best = (LOG_GAMMA.take(drawn[:, :, 2]) - rate * (1 - shift)).argmin(axis=1)
            out[first:first + 8] = mixed(hashes[best])
            continue
        step = np.floor(logs / rate + shift)
        best = (LOG_GAMMA.take(drawn[:, :, 2]) - rate * (step - shift + 1)).argmin(axis=1)
        steps = np.take_along_axis(step, best[:, None], 1)[:, 0].astype(np.int64).astype(np.uint64)
        out[first:first + 8] = mixed(hashes[best] ^ (steps * np.uint64(0x9E3779B97F4A7C15)))
    return out


def _sets(texts):
    """(sorted shingle hashes, counts) for every text."""
    for text, (words, _) in zip(texts, words_of(texts)):
        found = shingles(words, SHINGLE_WORDS)
        if not len(found):
            digest = hashlib.blake2b((text or "").encode("utf-8", "replace"), digest_size=8).digest()
            found = np.frombuffer(digest, np.uint64)
        yield np.unique(found, return_counts=True)


def _maybe_common(batches):
    """Shingles and how many texts hold them, but those of a quarter of COMMON or less of the texts counted together."""
    held, size = [], 0

    def counted():
        found, n = np.unique(np.concatenate(held), return_counts=True)
        often = n > int(COMMON * len(held) / 4)
        return pd.DataFrame({"shingle": found[often].view(np.int64), "n": n[often]})

    for batch in batches:
        for found, _ in _sets(batch["text"]):
            held.append(found)
            size += len(found)
            if size >= FLUSHED:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def common_shingles(texts):
    """(number of texts, sorted hashes, their document frequencies) of the shingles of COMMON texts or more."""
    total = texts.count()
    often = texts.mapInPandas(_maybe_common, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    # what a task left out is a quarter of the limit at most
    rows = often.where(F.col("n") >= 0.75 * COMMON * total).select("shingle").toPandas()
    candidates = np.sort(rows["shingle"].to_numpy(np.int64).view(np.uint64))
    shared = texts.sparkSession.sparkContext.broadcast(candidates)

    def counted(batches):
        known = shared.value
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for found, _ in _sets(batch["text"]):
                at = np.searchsorted(known, found)
                at[at == len(known)] = 0
                counts[at[known[at] == found]] += 1
        seen = np.flatnonzero(counts)
        yield pd.DataFrame({"at": seen, "n": counts[seen]})

    if not len(candidates):
        return total, candidates, np.empty(0)
    exact = texts.mapInPandas(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    exact = exact[exact["n"] >= COMMON * total].sort_values("at")
    return total, candidates[exact["at"].to_numpy(np.int64)], exact["n"].to_numpy(np.float64)


def _sketches(shared):
    def made(batches):
        total, common, n = shared.value
        idf = (FLOOR + (1 - FLOOR) * np.log(total / n) / np.log(1 / COMMON)).astype(np.float32)
        for batch in batches:
            rows = []
            for found, counts in _sets(batch["text"]):
                weights = counts.astype(np.float32)
                if len(common):
                    at = np.searchsorted(common, found)
                    at[at == len(common)] = 0
                    known = common[at] == found
                    weights[known] *= idf[at[known]]
                key = hashlib.blake2b(found.tobytes() + counts.astype(np.int64).tobytes(), digest_size=16).hexdigest()
                samples = weighted_samples(found, weights)
                bands = np.zeros(BANDS, np.uint64)
                for row in samples.reshape(BANDS, ROWS).T:
                    bands = mixed(bands * np.uint64(0xD6E8FEB86659FD93) + row)
                bands = mixed(bands ^ np.arange(BANDS, dtype=np.uint64))
                plain = b"" if (weights == 1).all() else weights.tobytes()
                rows.append((
                    key, bands.view(np.int64), samples.astype(np.uint8).tobytes(),
                    (found >> np.uint64(32)).astype(np.uint32).tobytes(), plain, len(found),
                ))
            frame = pd.DataFrame(rows, columns=["set_key", "bands", "signature", "hashes", "weights", "size"])
            for name in ("row_id", "id", "text_key"):
                frame[name] = batch[name]
            yield frame

    return made


def _groups(batches, keys):
    """The frame of each group of rows sorted by `keys`, also of those that span batches."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        values = batch[keys].to_numpy()
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for first, end in zip([0, *cuts[:-1]], cuts):
            yield batch.iloc[first:end]
        rest = batch.iloc[cuts[-1]:] if len(cuts) else batch
    if rest is not None and len(rest):
        yield rest


def _forest(size, near):
    """Pairs that connect what `near` connects; near(i, rest) tells which of `rest` are near i."""
    rest = np.arange(size)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            hit = near(queue.pop(), rest)
            found, rest = rest[hit], rest[~hit]
            queue.extend(found)
            yield from ((root, i) for i in found)


def _crossing(labels, apart, near):
    """Pairs that connect rows of different labels; one of each pair is `apart`."""
    labels = labels.copy()
    for i in np.flatnonzero(apart):
        rest = np.flatnonzero(labels != labels[i])
        if not len(rest):
            return
        hit = rest[near(i, rest)]
        names, at = np.unique(labels[hit], return_index=True)
        for name, k in zip(names, at):
            yield i, hit[k]
            labels[labels == name] = labels[i]


def _connected(nearness):
    """For mapInPandas: pairs (a, b) that connect the rows of each group, by nearness(group)(i, rest)."""
    def pairs(batches):
        for group in _groups(batches, ["bucket", "low", "high"]):
            if len(group) < 2:
                continue
            ids, near = group["row_id"].to_numpy(), nearness(group)
            if "apart" in group:
                found = list(_crossing(group["label"].to_numpy(), group["apart"].to_numpy(), near))
            else:
                found = list(_forest(len(ids), near))
            if found:
                a, b = np.array(found).T
                yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    return pairs


def _agreement(group):
    signs = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), SAMPLES)
    return lambda i, rest: (signs[rest] == signs[i]).sum(axis=1) >= AGREE


def _likeness(group):
    return _WeightedSets(list(group["hashes"]), list(group["weights"])).near


class _WeightedSets:
    """The sets of a group, for comparing one with many."""

    def __init__(self, hashes, weights):
        sizes = [len(h) // 4 for h in hashes]
        codes = np.frombuffer(b"".join(hashes), np.uint32)
        _, self.codes = np.unique(codes, return_inverse=True)
        self.weights = np.concatenate([
            np.frombuffer(w, np.float32) if w else np.ones(n, np.float32) for w, n in zip(weights, sizes)
        ])
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.totals = np.add.reduceat(self.weights.astype(np.float64), self.starts[:-1])
        self.dense = np.zeros(self.codes.max() + 1, np.float32)
        self._take(np.arange(len(sizes)))

    def _take(self, rows):
        """Put the sets of some rows together."""
        sizes = np.diff(self.starts)[rows]
        self.held, self.bounds = rows, np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(self.starts[rows] - self.bounds[:-1], sizes) + np.arange(self.bounds[-1])
        self.held_codes, self.held_weights = self.codes[at], self.weights[at]

    def near(self, i, rest):
        at = np.searchsorted(self.held, rest)
        if len(rest) < len(self.held) / 2 or at[-1] == len(self.held) or (self.held[at] != rest).any():
            self._take(rest)
            at = np.arange(len(rest))
        own = slice(self.starts[i], self.starts[i + 1])
        self.dense[self.codes[own]] = self.weights[own]
        common = np.minimum(self.dense[self.held_codes], self.held_weights)
        self.dense[self.codes[own]] = 0
        shared = np.add.reduceat(common, self.bounds[:-1], dtype=np.float64)[at]
        return shared >= (THRESHOLD - 1e-6) * (self.totals[i] + self.totals[rest] - shared)


def _together(rows, sets, places):
    """A row of `rows` (bucket, row_id, ..) with its columns of `sets` for each of its `places`, each group in one task.

    `rows` is a written table and its rows are multiplied after the join, so that Spark knows its size and
    need not shuffle the sets where few rows are left. Block numbers are part of the key, so the groups of a
    large bucket go to different tasks; in order of row_id, so that the hub comes first and the buckets of a
    class mostly name the same row.
    """
    keys = ["bucket", "low", "high"]
    placed = rows.join(sets, "row_id").withColumn("place", F.explode(places))
    own = [c for c in ("label",) if c in rows.columns] + [c for c in sets.columns if c != "row_id"]
    return placed.select("bucket", "place.*", "row_id", *own).repartition(*keys).sortWithinPartitions(*keys, "row_id")


def _linked(placed, sets, nearness, label):
    """Components (node, label) of the rows of a written table (bucket, row_id, n, blocks) that are near in a bucket."""
    link = lambda rows, places: _together(rows, sets, places).mapInPandas(_connected(nearness), "a long, b long")
    numbers = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    block = lambda n: F.pmod(F.xxhash64("row_id"), F.col(n)).cast("int")
    many = placed.where("blocks > 1")
    hubs = written(many.groupBy("bucket", "n", "blocks").agg(F.min("row_id").alias("row_id")), f"{label}-hubs")
    if hubs.isEmpty():
        one = F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high")))
        return components(link(placed, one), label)
    at = placed.join(hubs.select("bucket", "row_id", F.lit(True).alias("hub")), ["bucket", "row_id"], "left")
    blocks = F.when(F.col("hub"), numbers("blocks")).otherwise(F.array(block("blocks")))
    in_blocks = F.transform(blocks, lambda i: F.struct(i.alias("low"), F.lit(0).alias("high")))
    found = components(link(written(at, f"{label}-placed"), in_blocks), f"{label}-blocks")

    named = lambda rows: rows.join(found.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn(
        "label", F.coalesce("label", "row_id"))
    reached = written(named(hubs).select("bucket", F.col("label").alias("hub")), f"{label}-reached")
    held = written(named(many).join(reached, "bucket").withColumn("apart", F.col("label") != F.col("hub")), f"{label}-held")
    left = written(held.where("apart").groupBy("bucket").agg(
        F.ceil(F.count("*") * F.first("blocks") / F.first("n")).alias("parts")), f"{label}-left")
    if left.isEmpty():
        return found
    held = written(held.join(left, "bucket").select(
        "bucket", "row_id", "blocks", "label", F.col("apart").alias("is_apart"), "parts"), f"{label}-apart")
    place = lambda low, high, apart: F.struct(low.alias("low"), high.alias("high"), F.lit(apart).alias("apart"))
    # a row that is apart meets every block in its part; in its block, every row meets all parts but its own
    every = F.when(F.col("is_apart"), numbers("blocks")).otherwise(F.array().cast("array<int>"))
    other = F.filter(numbers("parts"), lambda i: ~F.col("is_apart") | (i != block("parts")))
    more = link(held, F.concat(
        F.transform(every, lambda j: place(block("parts"), j, True)), F.transform(other, lambda i: place(i, block("blocks"), False))))
    return components(more.unionByName(found.toDF("a", "b").where("a <> b")), label)


def near_classes(docs, id_col="doc_id", text_col="text"):
    """A row for each row of `docs`: id_col, class_id, class_size, kept, text_key."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), filled(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(common_shingles(texts.select("text")))
    kind = dict(texts.dtypes)["id"]
    sketches = written(texts.withColumn("text_key", F.xxhash64("text")).mapInPandas(
        _sketches(shared), f"row_id long, id {kind}, text_key long, set_key string, bands array<long>, "
        "signature binary, hashes binary, weights binary, size int",
    ), "sketches")
    # written, so that the join shuffles both sides and Spark can split a set that many rows have
    equal = written(sketches.groupBy("set_key").agg(F.min("row_id").alias("rep")), "equal-sets")
    rows = written(sketches.select("row_id", "id", "text_key", "set_key").join(equal, "set_key").drop("set_key"), "rows")
    reps = rows.where("row_id = rep").select("row_id")

    buckets = sketches.select("row_id", "bands").join(reps, "row_id", "left_semi").select("row_id", F.explode("bands").alias("band"))
    sizes = written(buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    met = written(buckets.join(sizes, "band").select(
        F.col("band").alias("bucket"), "row_id", "n", F.ceil(F.col("n") / BLOCK_TEXTS).alias("blocks")), "met")
    clusters = _linked(met, sketches.select("row_id", "signature"), _agreement, "agreeing")

    sized = clusters.join(sketches.select(F.col("row_id").alias("node"), "size"), "node")
    sizes = written(sized.groupBy("label").agg(F.count("*").alias("n"), F.greatest(
        F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks")), "cluster-sizes")
    placed = written(clusters.join(sizes, "label").select(
        F.col("label").alias("bucket"), F.col("node").alias("row_id"), "n", "blocks"), "clustered")
    links = _linked(placed, sketches.select("row_id", "hashes", "weights"), _likeness, "linked")

    classed = rows.join(links.withColumnRenamed("node", "rep"), "rep", "left").select(
        "row_id", "id", "text_key", F.coalesce("label", "rep").alias("label")
    )
    classed = written(classed, "classed")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_id"))
    classes = written(classed.groupBy("label").agg(F.count("*").alias("class_size"), first.alias("first")), "classes")
    return classed.join(classes, "label").select(
        F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "class_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"), "text_key",
    )


def keep_first(docs, id_col="doc_id", text_col="text"):
    """The rows of `docs` that stay, with all their columns."""
    return staying(docs, written(near_classes(docs, id_col, text_col), "near-classes"), id_col, text_col)
