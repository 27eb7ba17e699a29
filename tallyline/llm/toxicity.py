"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words of a text, their first letters, adjacent pairs and pairs with one
word between, hashed into 2**BITS places. Weights are learned with per-coordinate rates, and L1 sets
most of them to zero: what is sent to the tasks has a row for each remaining weight.

The model is fitted on at most `max_rows` labelled rows of `max_bytes` together, chosen and ordered by a
hash of their id, in one task; texts of over a sixteenth of `max_bytes` are not learned from. Every row
is scored on its whole text. A label of null is no label; of several labels for an id the largest counts;
of rows that repeat an id the fit takes each text once. Null and empty texts have no features, so their score is that of the bias. Without
any label all scores are 0.5 and nothing is predicted as toxic.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyline.llm.common import FIT_BYTES, filled, rows_to_fit, ship_package
from tallyline.llm.words import distinct, mixed, words_of

BITS = 20
STEM_BYTES = 5
MAX_ROWS = 12_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 3.0, 0.0, 3
PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(texts):
    """The places of every text's features, with repeats."""
    shift = np.uint64(64 - BITS)
    for words, stems in words_of(texts, STEM_BYTES):
        parts = [words, mixed(stems ^ np.uint64(1))]
        if len(words) > 1:
            parts.append(mixed(words[:-1] * PAIR + words[1:]))
        if len(words) > 2:
            parts.append(mixed(words[:-2] * PAIR + (words[2:] ^ np.uint64(2))))
        yield (np.concatenate(parts) >> shift).astype(np.int32)


class Ftrl:
    """FTRL-proximal with the log loss; the last place is the bias, which L1 leaves alone."""

    def __init__(self, size):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, places):
        z, n = self.z[places], self.n[places]
        shrunk = np.where(places == len(self.z) - 1, z, np.sign(z) * np.maximum(np.abs(z) - L1, 0))
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, places, label):
        weights = self.weights(places)
        slope = 1 / (1 + np.exp(-np.clip(weights.sum(), -35, 35))) - label
        grown = self.n[places] + slope * slope
        self.z[places] += slope - (np.sqrt(grown) - np.sqrt(self.n[places])) / ALPHA * weights
        self.n[places] = grown


def _fit(batches):
    """(place, weight) of all weights that are not zero; the bias is at place 2**BITS."""
    bias = np.array([1 << BITS], np.int32)
    examples = [
        (np.concatenate((np.frombuffer(places, np.int32), bias)), label)
        for batch in batches for places, label in zip(batch["places"], batch["label"])
    ]
    model = Ftrl(1 << BITS)
    for _ in range(EPOCHS):
        for places, label in examples:
            model.learn(places, label)
    weights = model.weights(np.arange((1 << BITS) + 1))
    found = np.flatnonzero(weights)
    yield pd.DataFrame({"place": found, "weight": weights[found]})


def held_out(id_col):
    """Whether a row's label must not be learned: the remainder of its id's crc32 by 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", max_rows=MAX_ROWS, max_bytes=FIT_BYTES):
    """Weights by place, learned from the labels that are not held out."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("double").alias("value"))
    mark = F.xxhash64("label_id", F.lit(7))
    chosen = known.orderBy(mark, "label_id").limit(max_rows)

    def places(batches):
        for batch in batches:
            yield pd.DataFrame({
                "mark": batch["mark"], "text_key": batch["text_key"], "label": batch["value"],
                "places": [distinct(p).tobytes() for p in features(batch["text"])],
            })

    rows = rows_to_fit(docs, chosen, mark, max_rows, max_bytes, id_col, text_col)
    rows = rows.mapInPandas(places, "mark long, text_key long, label double, places binary")
    ordered = rows.repartition(1).sortWithinPartitions("mark", "text_key")
    found = ordered.mapInPandas(_fit, "place int, weight double").collect()
    return {row["place"]: row["weight"] for row in found}


def score_column(spark, text, weights):
    """Column of scores from 0 to 1."""
    shared = spark.sparkContext.broadcast((
        np.array(list(weights), np.int32), np.array(list(weights.values()), np.float32), weights.get(1 << BITS, 0.0)
    ))

    @F.pandas_udf("double")
    def score(batches: pd.Series) -> pd.Series:
        places, values, bias = shared.value
        table = np.zeros((1 << BITS) + 1, np.float32)
        table[places] = values
        sums = np.empty(len(batches))
        for i, found in enumerate(features(batches)):
            sums[i] = table[distinct(found[table[found] != 0])].sum(dtype=np.float64)
        return pd.Series(1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))))

    return score(text)


def scored(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", max_rows=MAX_ROWS):
    """Rows of `docs` with id_col, held_out, score and predicted."""
    weights = fit(docs, labels, id_col, text_col, label_col, max_rows)
    score = score_column(docs.sparkSession, filled(text_col), weights)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), score.alias("score"))
    likely = (F.col("score") >= 0.5) if weights else F.lit(False)
    return out.withColumn("predicted", likely.cast("int"))


def keep_clean(docs, labels, id_col="doc_id", text_col="text"):
    """The rows of `docs` that are not predicted as toxic, with all their columns."""
    weights = fit(docs, labels, id_col, text_col)
    if not weights:
        return docs
    return docs.where(score_column(docs.sparkSession, filled(text_col), weights) < 0.5)
