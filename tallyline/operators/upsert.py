"""Add rows to a table only where they are absent."""

from pyspark.sql import functions as F

from tallyline.operators.select import conform

ORIGIN = "_origin"


def insert_absent_rows(existing, incoming):
    """Different rows of both inputs; incoming is cast to the stored types first."""
    return existing.union(conform(incoming, existing.schema)).distinct()


def insert_absent_keys(existing, incoming, keys):
    """One row per key of both inputs. Null keys are equal.

    An existing row beats an incoming one; within one side the smallest row by the remaining
    columns, nulls first, is kept. The choice is a minimum, partly taken before the shuffle, so the
    rows of one key are never gathered.
    """
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn(ORIGIN, F.lit(0)).union(
        conform(incoming, existing.schema).withColumn(ORIGIN, F.lit(1))
    )
    kept = both.groupBy(*keys).agg(F.min(F.struct(ORIGIN, *rest)).alias("_kept"))
    return kept.select(*[
        F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c) for c in existing.columns
    ])


def rows_to_append(existing, incoming, keys):
    """The incoming rows `insert_absent_keys` would add, for a table without double keys.

    Lets a big table be appended to instead of rewritten. Its keys are first cut down to those that
    come in: with few incoming rows Spark broadcasts them and the table is scanned, not shuffled.
    """
    incoming = conform(incoming, existing.schema)
    rest = [c for c in existing.columns if c not in keys]
    kept = incoming.groupBy(*keys).agg(F.min(F.struct(F.lit(1), *rest)).alias("_kept"))
    stored = existing.select(*[F.col(k).alias(f"_at_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]
    present = stored.join(incoming.select(*keys).distinct(), same, "left_semi").distinct()
    return kept.join(present, same, "left_anti").select(*[
        F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c) for c in existing.columns
    ])
