"""Mixing to target weights with soft domain membership.

A softmax regression learns the domains from the labels and gives every document a posterior for each.
Documents get rates, how often each is to be seen; projected gradient steps on the rates bring the
expected token totals of the domains, the sum of rate * tokens * posterior, to the targets in the least
squares sense, with every rate at least `least`. The gradient is scaled by the small matrix of the
domains' overlaps over the documents whose rate is above `least`; a pass sums totals and overlaps over
all documents for some lengths of the step and for plain gradient steps, and the best is taken. Steps
end when the targets are met; a warning tells what is missing if no step, or PATIENCE of them, bring
the totals nearer. A document's rate follows from its posterior and the steps so far, so no state is
kept between them.

Where `least` is above 0 the total is free, as repeating a document of one domain also adds the others'
share in it: it is the smallest one at which rates of `least` plus a mix of the posteriors, no part of it
negative, have the target shares. That follows from the domains' overlaps alone, and one step gets there.

The classifier is fitted on at most `max_rows` labelled rows of `max_bytes` together, chosen by a hash of
their id, in one task; texts of over a sixteenth of `max_bytes` are not learned from. Posteriors, totals
and rates cover every document. The features are byte shares and hashed words of the whole text. A document is seen floor(rate) times, and once more if a hash of its id and text is below
the rest. Null and empty texts have no tokens and rates like others of their posterior; null labels are
left out; rows that repeat an id are mixed each. Without labels all domains are equally likely.
"""

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyline.llm.common import FIT_BYTES, filled, rows_to_fit, ship_package
from tallyline.llm.words import distinct, words_of
from tallyline.session import written

BITS = 15
BYTES = 256
MAX_ROWS = 6000
EPOCHS, RATE, DECAY = 4, 0.3, 1e-4
TOLERANCE = 1e-7
PACES, LONG = (1.0, 0.5, 0.2, 0.05), 16.0  # lengths of steps that a pass tries
PATIENCE, FALL = 30, 0.98  # targets are out of reach if so many steps leave more than this share of the error

#: The domains that the table of labels tells apart, as SQL conditions in order.
DOMAINS = {"toxic": "toxic = 1", "junk": "quality = 0", "clean": "quality = 1"}


def features(texts):
    """(number of words, places, values) for every text: shares of bytes, and its distinct hashed words."""
    for text, (words, _) in zip(texts, words_of(texts)):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        shares = np.sqrt(np.bincount(data, minlength=BYTES) / max(1, len(data)))
        found = distinct(words >> np.uint64(64 - BITS)).astype(np.int64) + BYTES
        places = np.concatenate((np.arange(BYTES), found))
        values = np.concatenate((4 * shares, np.full(len(found), 1.0)))
        yield len(words), places, values


def _softmax(scores):
    powers = np.exp(scores - scores.max())
    return powers / powers.sum()


def _fit(domains):
    def fit(batches):
        """Softmax regression with a rate of its own for each weight; the last place is the bias."""
        examples = []
        for batch in batches:
            for (_, places, values), domain in zip(features(batch["text"]), batch["domain"]):
                examples.append((np.append(places, BYTES + (1 << BITS)), np.append(values, 1.0), int(domain)))
        weights = np.zeros((BYTES + (1 << BITS) + 1, domains))
        squares = np.full(weights.shape, 1e-2)
        for _ in range(EPOCHS):
            for places, values, domain in examples:
                slope = _softmax(values @ weights[places])
                slope[domain] -= 1
                change = values[:, None] * slope + DECAY * weights[places]
                squares[places] += change * change
                weights[places] -= RATE * change / np.sqrt(squares[places])
        used = np.flatnonzero(np.abs(weights).sum(axis=1))
        yield pd.DataFrame({"place": used, "weights": list(weights[used])})

    return fit


def domain_weights(docs, labels, domains, id_col, text_col, max_rows=MAX_ROWS, max_bytes=FIT_BYTES):
    """Weights of the classifier, a row for each place and a column for each domain."""
    number = F.lit(None).cast("int")
    for i, condition in reversed(list(enumerate(domains.values()))):
        number = F.when(F.expr(condition), i).otherwise(number)
    known = labels.select(F.col(id_col).alias("label_id"), number.alias("domain")).where("label_id IS NOT NULL AND domain IS NOT NULL")
    known = known.where(F.crc32(F.col("label_id").cast("string")) % 5 != 0).groupBy("label_id").agg(F.min("domain").alias("value"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    rows = rows_to_fit(docs, chosen, F.xxhash64("label_id"), max_rows, max_bytes, id_col, text_col)
    rows = rows.select(F.col("value").alias("domain"), "text", "mark", "text_key")
    ordered = rows.repartition(1).sortWithinPartitions("mark", "text_key").select("domain", "text")
    weights = np.zeros((BYTES + (1 << BITS) + 1, len(domains)), np.float32)
    for row in ordered.mapInPandas(_fit(len(domains)), "place int, weights array<double>").collect():
        weights[row["place"]] = row["weights"]
    return weights


def posteriors(docs, labels, domains=None, id_col="doc_id", text_col="text", max_rows=MAX_ROWS):
    """A row for each row of `docs`: id, text_key, tokens and the posterior of each domain, as an array."""
    spark = docs.sparkSession
    ship_package(spark)
    domains = domains or DOMAINS
    shared = spark.sparkContext.broadcast(domain_weights(docs, labels, domains, id_col, text_col, max_rows))

    @F.pandas_udf("tokens long, posterior array<double>")
    def judged(texts: pd.Series) -> pd.DataFrame:
        weights = shared.value
        rows = [(n, _softmax(values @ weights[places] + weights[-1])) for n, places, values in features(texts)]
        return pd.DataFrame(rows, columns=["tokens", "posterior"])

    text = filled(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), judged(text).alias("j")).select(
        "id", "text_key", "j.tokens", "j.posterior"
    )


def _rates(posterior, steps, least):
    rates = np.maximum(np.ones(len(posterior)), least)
    for step in steps:
        rates = np.maximum(rates - posterior @ step, least)
    return rates


def _summed(table, what, width):
    """The sum over all rows of `what`(tokens, posteriors), an array of `width` numbers."""
    def sums(batches):
        total = np.zeros(width)
        for batch in batches:
            if len(batch):
                total += what(batch["tokens"].to_numpy(np.float64), np.array(batch["posterior"].tolist()))
        yield pd.DataFrame({"sums": [total]})

    parts = table.select("tokens", "posterior").mapInPandas(sums, "sums array<double>")
    return np.sum([row["sums"] for row in parts.collect()] or [np.zeros(width)], axis=0)


def overlaps(table, size):
    """The matrix of the domains' overlaps, sums of tokens * posterior * posterior; its rows sum to the totals at rate 1."""
    return _summed(table, lambda n, p: (p * n[:, None]).T.dot(p).ravel(), size * size).reshape(size, size)


def least_total(whole, shares, least):
    """The smallest total of the domains with `shares` at which rates of `least` plus a mix of posteriors meet them.

    None where no mix does: where domains overlap more than their shares allow.
    """
    bound = sorted(shares)
    block, share = whole[np.ix_(bound, bound)], np.array([shares[i] for i in bound])
    inverse = np.linalg.pinv(block)
    held, wanted = inverse @ (least * whole.sum(axis=1)[bound]), inverse @ share
    if (wanted <= 0).any() or not np.allclose(block @ wanted, share, atol=1e-9):
        return None
    return (held / wanted).max()


def fit_steps(table, targets, least=0.0, tolerance=TOLERANCE, whole=None):
    """Gradient steps whose rates give the domains of `table` (tokens, posterior) the target totals.

    `targets` has None for a domain that may have any total; `whole` are the table's overlaps, if known.
    """
    size = len(targets)
    whole = overlaps(table, size) if whole is None else whole
    # a plain gradient step of this length never raises the error
    slowest = max(np.linalg.eigvalsh(whole).max(), 1e-9)
    bound = np.array([t is not None for t in targets])
    wanted = np.array([t or 0.0 for t in targets])

    def scaled(overlap, missing):
        """The scaled gradient step: overlap inverse times what is missing, for the bound domains."""
        inverse = np.zeros((size, size))
        eye = max(np.trace(overlap), 1e-9) * np.eye(bound.sum())
        inverse[np.ix_(bound, bound)] = np.linalg.pinv(overlap[np.ix_(bound, bound)] + 1e-9 * eye)
        return inverse @ missing

    def tried(steps, options):
        """(error, missing, overlap of the rows above `least`, option) of the option with the least error."""
        def what(n, p):
            before, out = _rates(p, steps, least), []
            for option in options:
                rates = before if option is None else np.maximum(before - p @ option, least)
                free = (n * (rates > least))[:, None]
                out.append(np.concatenate(((n * rates) @ p, (p * free).T.dot(p).ravel())))
            return np.concatenate(out)

        width, found = size + size * size, []
        for option, sums in zip(options, _summed(table, what, width * len(options)).reshape(-1, width)):
            missing = np.where(bound, sums[:size] - wanted, 0.0)
            error = np.sqrt((missing ** 2).sum()) / max(wanted.sum(), 1.0)
            found.append((error, missing, sums[size:].reshape(size, size), option))
        return min(found, key=lambda f: f[0])

    steps = []
    error, missing, overlap, _ = tried(steps, [None])
    errors = [error]
    while error > tolerance:
        options = [pace * scaled(overlap, missing) for pace in PACES]
        options += [scaled(whole, missing), missing / slowest, LONG * missing / slowest]
        error, missing, overlap, step = tried(steps, options)
        if error >= errors[-1]:
            break
        steps.append(step)
        errors.append(error)
        if len(errors) > PATIENCE and error > FALL * errors[-1 - PATIENCE]:
            break
    if errors[-1] > tolerance:
        warnings.warn(f"the rates miss the target totals by {errors[-1]:.2g} of the tokens", stacklevel=2)
    return steps


def mixed_rates(docs, labels, weights, domains=None, least=0.0, id_col="doc_id", text_col="text", max_rows=MAX_ROWS):
    """A row for each row of `docs`: id_col, text_key, tokens, posterior, rate, copies.

    `weights` are the domains' target shares of the tokens; a domain without one may have any share.
    All tokens together stay as many as they are, or, if rates have a least value, become as many as
    that needs.
    """
    domains = domains or DOMAINS
    table = written(posteriors(docs, labels, domains, id_col, text_col, max_rows), "posteriors")
    whole = overlaps(table, len(domains))
    now = whole.sum(axis=1)
    share = sum(weights.values())
    shares = {i: weights[name] / share for i, name in enumerate(domains) if name in weights}
    total = sum(now[i] for i in shares)
    if least > 0:
        reached = least_total(whole, shares, least)
        total = max([total * least, *(least * now[i] / s for i, s in shares.items() if s)]) if reached is None else reached
    targets = [total * shares[i] if i in shares else None for i in range(len(domains))]
    steps = fit_steps(table, targets, least, whole=whole)

    @F.pandas_udf("double")
    def rate(posterior: pd.Series) -> pd.Series:
        return pd.Series(_rates(np.array(posterior.tolist()).reshape(len(posterior), -1), steps, least))

    rated = table.withColumn("rate", rate("posterior"))
    chance = F.pmod(F.xxhash64("id", "text_key", F.lit(9)), F.lit(1 << 30)) / (1 << 30)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return rated.select(F.col("id").alias(id_col), "text_key", "tokens", "posterior", "rate", copies.alias("copies"))


def mixed(docs, labels, weights, domains=None, least=0.0, id_col="doc_id", text_col="text", max_rows=MAX_ROWS):
    """The rows of `docs`, each as often as its copies say."""
    rates = written(mixed_rates(docs, labels, weights, domains, least, id_col, text_col, max_rows), "rates")
    plan = rates.groupBy(F.col(id_col).alias("id_"), F.col("text_key").alias("key_")).agg(F.max("copies").alias("copies_"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"), F.col(id_col).alias("own_id_"),
        F.xxhash64(filled(text_col)).alias("own_key_"),
    )
    joined = rows.join(plan, F.col("own_id_").eqNullSafe(F.col("id_")) & (F.col("own_key_") == F.col("key_")))
    times = F.sequence(F.lit(1).cast("long"), F.col("copies_"))
    return joined.where("copies_ > 0").select("row_", F.explode(times)).select("row_.*")
