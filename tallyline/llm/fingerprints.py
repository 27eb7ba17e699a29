"""Document fingerprints from prefix polynomial hashes.

A text's code points c[0], c[1], ... give the arrays P[i] = sum of c[j] * B**j for j < i, modulo two
primes. The hash of any span follows from two entries, so equal spans are told in constant time and
the longest common extension of two texts from two places is found by binary search.

The fingerprint holds the length, the hash of the whole text and the smallest KEPT hashes of all its
spans of SPAN code points (of the whole text, if it is shorter). The likeness of two fingerprints is
1 if they are equal, else the share of the smallest KEPT hashes of both together that both have: an
estimate of the share of common spans. Two empty texts are alike; an empty and another text are not.

`with_next` puts the following row in descending order of an id beside each row, without a global
order: ids are cut into ranges, each range is ordered by itself, and its first row also goes to the
range before it. Rows of equal ids are ordered by their texts, a null id comes last, and after the
last row comes the first. Null text counts as empty.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F, types as T

from tallyline.llm.common import filled, ship_package
from tallyline.llm.words import distinct

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1597334677)
SPAN, KEPT = 12, 48
_tables = {}


def _powers(size):
    """For each prime the powers of its base and of the base's inverse."""
    if _tables.get("size", 0) < size:
        size = max(size, 1 << 16, 2 * _tables.get("size", 0))
        made = []
        for prime, base in zip(PRIMES, BASES):
            for root in (base % prime, pow(base, -1, prime)):
                out = np.ones(1, np.int64)
                while len(out) < size:  # doubling: the next half is the first one times a power
                    out = np.concatenate((out, out * pow(root, len(out), prime) % prime))
                made.append(out)
        _tables.update(size=len(made[0]), made=made)
    return _tables["made"]


class Prefixes:
    """The prefix hashes of a text."""

    def __init__(self, text):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        self.size = size = len(points)
        powers = _powers(size + 1)
        self.sums = []
        for prime, power in zip(PRIMES, powers[::2]):
            sums = np.zeros(size + 1, np.int64)
            np.cumsum(points * power[:size] % prime, out=sums[1:])
            self.sums.append(sums % prime)

    def span(self, first, size):
        """Hash of a span as a pair of remainders."""
        powers = _powers(self.size + 1)
        return tuple(
            int(sums[first + size] - sums[first]) * int(inverse[first]) % prime
            for prime, sums, inverse in zip(PRIMES, self.sums, powers[1::2])
        )

    def spans(self, size):
        """Hashes of all spans of a size, to the first prime."""
        sums, prime = self.sums[0], PRIMES[0]
        inverse = _powers(self.size + 1)[1]
        return (sums[size:] - sums[:-size]) % prime * inverse[:self.size - size + 1] % prime


def common_extension(a, b, at_a=0, at_b=0):
    """How many code points are equal from two places on."""
    low, high = 0, min(a.size - at_a, b.size - at_b)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(at_a, middle) == b.span(at_b, middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_ending(a, b):
    """How many code points are equal at the ends."""
    low, high = 0, min(a.size, b.size)
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(a.size - middle, middle) == b.span(b.size - middle, middle):
            low = middle
        else:
            high = middle - 1
    return low


def fingerprint(prefixes):
    """Length, hash of the text and its smallest span hashes, in hexadecimal digits."""
    size = prefixes.size
    whole = "%08x%08x" % prefixes.span(0, size)
    if not size:
        return f"0.{whole}."
    # stirred again, as spans that differ little have hashes in line
    found = prefixes.spans(min(SPAN, size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)
    least = distinct(np.partition(found, 4 * KEPT)[:4 * KEPT] if len(found) > 4 * KEPT else found)
    if len(least) < KEPT:  # many repeats
        least = distinct(found)
    return f"{size:x}.{whole}." + least[:KEPT].astype(">u4").tobytes().hex()


def likeness(a, b):
    """Share of common spans that two fingerprints show, from 0 to 1."""
    if a == b:
        return 1.0
    one, other = ({f[i:i + 8] for i in range(f.rindex(".") + 1, len(f), 8)} for f in (a, b))
    if not one or not other:
        return 0.0
    low = sorted(one | other)[:KEPT]
    return sum(x in one and x in other for x in low) / len(low)


def fingerprint_column(text):
    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(Prefixes(t or "")))

    return made(text)


def compared(text, other, own, following):
    """The other text's fingerprint, its likeness to `own`, and how far both texts agree at their ends."""
    @F.pandas_udf("edited_fingerprint string, near_edited double, near_next double, common_start long, common_end long")
    def made(texts: pd.Series, others: pd.Series, owns: pd.Series, followings: pd.Series) -> pd.DataFrame:
        rows = []
        for one, two, mark, after in zip(texts, others, owns, followings):
            a, b = Prefixes(one), Prefixes(two)
            edited = fingerprint(b)
            rows.append((edited, likeness(mark, edited), likeness(mark, after), common_extension(a, b), common_ending(a, b)))
        return pd.DataFrame(rows, columns=["edited_fingerprint", "near_edited", "near_next", "common_start", "common_end"])

    return made(text, other, own, following)


def _range_of(column, bounds):
    """How many of the sorted bounds a value has reached, found in two steps."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1::step]])
    passed = F.size(F.filter(coarse, lambda b: b <= column)) * step
    near = F.slice(F.array(*[F.lit(b) for b in bounds]), passed + 1, F.lit(step))
    return passed + F.size(F.filter(near, lambda b: b <= column))


def _bounds(ids, shares, sampled):
    """Different ids that cut the rows into about equal ranges: quantiles of numbers, or of a sample of other ids."""
    if not shares:
        return []
    if isinstance(ids.schema["id"].dataType, T.NumericType):
        return sorted(set(ids.agg(F.percentile_approx("id", shares, sampled)).first()[0] or []))
    drawn = ids.where("id IS NOT NULL").orderBy(F.xxhash64("mark", "id")).limit(sampled)
    found = [r["id"] for r in drawn.orderBy("id").collect()]
    return sorted({found[int(share * len(found))] for share in shares}) if found else []


def with_next(rows, id_col, text_col, columns):
    """`rows` with each of `columns` of the following row as next_<column>."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = _bounds(ids, shares, 10 * ranges)
    part = F.when(F.col("id").isNull(), -1).otherwise(_range_of(F.col("id"), bounds))
    # one row for each range, of which there are as many as shuffle partitions
    first = {r["part"]: r["first"] for r in ids.groupBy(part.alias("part")).agg(
        F.max(F.struct("id", F.bitwise_not("mark").alias("mark"))).alias("first")).collect()}
    order = sorted(first, reverse=True)
    before = dict(zip(order, order[-1:] + order[:-1]))
    heads = spark.createDataFrame(
        [(first[p]["id"], ~first[p]["mark"], before[p]) for p in order], f"head_id {dict(rows.dtypes)[id_col]}, head_mark long, goes_to int"
    )
    placed = rows.withColumns({"id": F.col(id_col), "mark": F.xxhash64(text_col)}).withColumn("part", part)
    marked = placed.join(
        F.broadcast(heads), F.col("id").eqNullSafe(F.col("head_id")) & (F.col("mark") == F.col("head_mark")), "left"
    )
    own, copy = F.struct("part", F.lit(0).alias("copy")), F.struct(F.col("goes_to").alias("part"), F.lit(1).alias("copy"))
    places = F.when(F.col("goes_to").isNull(), F.array(own)).otherwise(F.array(own, copy))
    both = marked.withColumn("place_", F.explode(places)).withColumns(
        {"part": F.col("place_.part"), "copy": F.col("place_.copy")}
    ).drop("place_", "head_id", "head_mark", "goes_to")
    order = Window.partitionBy("part").orderBy("copy", F.col("id").desc_nulls_last(), "mark", text_col)
    following = both.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return following.where("copy = 0").drop("id", "mark", "part", "copy")


def edited_fingerprints(docs, id_col="doc_id", text_col="text"):
    """Each text's fingerprint against that of its edited form, whose last half comes from the next text."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias(id_col), filled(text_col).alias("text"))
    marked = texts.withColumn("fingerprint", fingerprint_column(F.col("text")))
    paired = with_next(marked, id_col, "text", ["text", "fingerprint"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - half), F.substr("next_text", F.lit(1), half))
    done = paired.withColumn("edited", edited)
    return done.select(
        id_col, size.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint", compared(F.col("text"), F.col("edited"), F.col("fingerprint"), F.col("next_fingerprint")).alias("c"),
    ).select(id_col, "n_chars", "edited_sha256", "fingerprint", "c.*")
