"""URL filter by the ratio of two character language models, in DataFrame functions only.

Rules decide the urls they fit. The urls that rules allow and those they block train two
variable-order Markov models over the characters of host and path: the probability of a character
after up to three others, at each order smoothed with that of the shorter context (Witten-Bell). The
other urls are judged by the mean log-likelihood difference of their characters, against a threshold
calibrated on every fifth decided url, which the models don't learn from. With no url decided one
way the difference is 0, and the threshold too, so the verdict is allow.

Distinct addresses are scored once. Counts are summed in the tasks first; the model has a row for
each distinct 4-gram of characters, and Spark broadcasts it only below its size threshold.

Null urls and those without ``://`` have empty host and path; repeated rows are judged each.
"""

from pyspark.sql import functions as F

from tallyline.session import written

ORDER = 4
ALPHABET = 256.0  # the lowest order is uniform over so many characters
START, STOP = "\u0002", "\u0003"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url):
    host = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules):
    """(text, verdict) of the longest of `rules` (verdict, host and path) that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _grams(address):
    """Each character of an address with the three before it."""
    padded = F.concat(F.lit(START * (ORDER - 1)), address, F.lit(STOP))
    return F.regexp_extract_all(padded, F.lit("(?s)(?=(.{%d}))" % ORDER), 1)


def _smoothed(counts, kinds):
    """Probability of each gram's last character after the others, for each kind."""
    for order in range(1, ORDER + 1):
        level = counts.groupBy(F.expr(f"right(gram, {order})").alias("gram")).agg(*[F.sum(k).alias(k) for k in kinds])
        level = level.withColumns({"context": F.expr(f"left(gram, {order - 1})"), "shorter": F.expr(f"right(gram, {order - 1})")})
        contexts = level.groupBy("context").agg(
            *[F.sum(k).alias(f"{k}_all") for k in kinds], *[F.count(F.when(F.col(k) > 0, 1)).alias(f"{k}_kinds") for k in kinds]
        )
        joined = level.join(contexts, "context")
        if order == 1:
            joined = joined.withColumns({f"{k}_p": F.lit(1 / ALPHABET) for k in kinds})
        else:
            joined = joined.join(below, joined["shorter"] == below["below"])  # noqa: F821
        chance = {k: F.when(F.col(f"{k}_all") == 0, F.col(f"{k}_p")).otherwise(
            (F.col(k) + F.col(f"{k}_kinds") * F.col(f"{k}_p")) / (F.col(f"{k}_all") + F.col(f"{k}_kinds"))) for k in kinds}
        below = joined.select(F.col("gram").alias("below"), *[chance[k].alias(f"{k}_p") for k in kinds])
    return below.withColumnRenamed("below", "gram")


def held_out(address):
    """Every fifth address, by the first eight digits of its MD5, which other engines have too."""
    return F.conv(F.left(F.md5(F.encode(address, "UTF-8")), F.lit(8)), 16, 10).cast("long") % 5 == 0


def _threshold(scored):
    """Where both kinds of held-out urls are equally many of their standard deviations away."""
    stats = {r["verdict"]: r for r in scored.groupBy("verdict").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread"), F.count("*").alias("n")).collect()}
    a, b = stats.get("allow"), stats.get("block")
    if not a or not b:
        return 0.0
    spread = a["spread"] + b["spread"]
    return (a["mean"] * b["spread"] + b["mean"] * a["spread"]) / spread if spread else (a["mean"] + b["mean"]) / 2


def judge_urls(pages, rules, id_col="page_id", url_col="url"):
    """A row for each row of `pages`: id_col, host, path, rule, verdict, score.

    `rules` are a configuration, (verdict, "host/path") pairs. `score` is the mean log-likelihood
    difference less the threshold: allow from 0 up.
    """
    url = F.col(url_col).cast("string")
    parts = pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    parts = parts.select(id_col, "host", "path", "found.rule", "found.verdict")
    address = F.concat("host", "path")
    addresses = parts.select(address.alias("address"), "verdict").groupBy("address").agg(
        F.max("verdict").alias("verdict"), F.count("*").alias("n")
    ).withColumn("held", held_out(F.col("address")))
    addresses = written(addresses, "addresses")
    grams = addresses.select("address", "verdict", "held", F.explode(_grams(F.col("address"))).alias("gram"))
    counted = lambda v: F.sum(F.when((F.col("verdict") == v) & ~F.col("held"), 1).otherwise(0))
    counts = written(grams.groupBy("gram").agg(counted("allow").alias("a"), counted("block").alias("b")), "grams")
    model = _smoothed(counts, ["a", "b"])
    known = F.lit(bool(counts.where("a > 0").limit(1).count() and counts.where("b > 0").limit(1).count()))
    gain = F.when(known, F.log("a_p") - F.log("b_p")).otherwise(0.0)
    model = written(model.select("gram", gain.alias("gain")), "url-model")
    scored = grams.select("address", "gram").join(model, "gram").groupBy("address").agg(F.avg("gain").alias("score"))
    scored = written(addresses.join(scored, "address"), "url-scores")
    limit = _threshold(scored.where("held AND verdict IS NOT NULL"))
    scored = scored.select("address", (F.col("score") - limit).alias("score"))
    judged = parts.withColumn("address", address).join(scored, "address")
    own = F.when(F.col("score") >= 0, "allow").otherwise("block")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "score")
