"""Lookups of ids by name or code."""

from pyspark.sql import functions as F

from tallyline.functions.columns import required

SALT = "_salt"
SALTS = 2


def latest_per_key(df, keys):
    """One row per key: the largest by the remaining columns.

    A maximum, not a window, so it is partly taken before the shuffle and no key is gathered whole.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def join_definitions(df, definitions, on, how="inner", salts=SALTS, growing=False):
    """Join many rows, a few keys of which may hold most of them, with one definition per key.

    Spark broadcasts the definitions when their size is below its threshold. Beyond it both sides
    are shuffled by key and salt: the rows of a key are spread by their content, and AQE can split
    what is left, as neither side brings a partitioning of its own. The salt depends on the row
    alone, so a task that runs again sends its rows the same way.

    Spark estimates a size from compressed files, which their rows may exceed many times. `growing`
    definitions, whose number follows the data, are therefore shuffled at any size: the driver, which
    gathers what is broadcast, never holds them.
    """
    rows = df.withColumn(SALT, F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    spread = definitions.withColumn(
        SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    if growing:
        spread = spread.hint("merge")
    return rows.join(spread, [*on, SALT], how).drop(SALT)


def add_id(df, definitions, name, id_column, strict=True):
    """Add `id_column`, looked up by `name`; an unknown name fails the job, or is left out.

    Of several definitions of one name the largest id counts.
    """
    ids = definitions.groupBy(name).agg(F.max(id_column).alias(id_column))
    if not strict:
        return join_definitions(df, ids, [name])
    problem = F.concat(F.lit(f"no {id_column} for {name} "), F.coalesce(F.col(name), F.lit("null")))
    found = join_definitions(df, ids, [name], "left")
    return found.withColumn(id_column, required(F.col(id_column), problem))
