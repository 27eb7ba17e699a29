"""Net changes of an insert/update/delete audit log."""

from pyspark.sql import functions as F

from tallyline.codes import DELETE, INSERT, UPDATE
from tallyline.functions.columns import distinct_ids

ID = "_changed_id"


def _latest(log, op, at):
    """Per id the latest insert, update and other change, each as struct(at, op) or null.

    Latest is a maximum per id, so an id with any number of changes costs one row per task. For the
    three known codes only times are kept, which Spark aggregates in place by hash. Other codes
    are rare and need their text: they take a branch of their own, which AQE drops when it is empty.
    """
    kinds = {"insert": INSERT, "update": UPDATE, "delete": DELETE}
    latest = log.groupBy(ID).agg(*[
        measure
        for name, code in kinds.items()
        for measure in (
            F.max(F.when(F.col(op) == code, F.col(at))).alias(f"{name}_at"),
            F.bool_or(F.col(op) == code).alias(f"has_{name}"),
        )
    ])
    known = F.coalesce(F.col(op).isin(*kinds.values()), F.lit(False))
    unknown = log.where(~known).groupBy(ID).agg(
        F.max(F.struct(F.col(at).alias("at"), F.col(op).alias("op"))).alias("unknown")
    )

    def change(name):
        row = F.struct(F.col(f"{name}_at").alias("at"), F.lit(kinds[name]).alias("op"))
        return F.when(F.col(f"has_{name}"), row)

    return latest.join(unknown, ID, "left").select(
        F.col(ID).alias("id"),
        change("insert").alias("insert"),
        change("update").alias("update"),
        F.greatest(change("delete"), "unknown").alias("other"),
    )


def change_flags(log, id_new="id_new", id_old="id_old", op="op_code", at="op_time"):
    """Latest insert, update and other change per id, with Flag 'No' where they cancel out.

    At one instant insert + update leaves the update, update + delete the delete, and insert +
    delete, with or without an update between, leaves nothing. Null times never cancel. Of other
    changes at one instant the largest code is the latest. Rows without any id are left out.
    """
    changes = log.select(F.coalesce(id_new, id_old).alias(ID), op, at).where(F.col(ID).isNotNull())
    insert, update, other = F.col("insert"), F.col("update"), F.col("other")
    updated, deleted = update.isNotNull(), other["op"] == DELETE
    cancelled = [
        (insert, F.when(updated, insert["at"] == update["at"])
            .otherwise(deleted & (insert["at"] == other["at"]))),
        (update, deleted & (update["at"] == other["at"])),
        (other, deleted & (insert["at"] == other["at"])
            & F.when(updated, update["at"] == other["at"]).otherwise(True)),
    ]

    def flagged(change, drop):
        flag = F.when(drop, "No").otherwise("Yes").alias("Flag")
        return F.when(change.isNotNull(), F.struct(change["at"].alias(at), change["op"].alias(op), flag))

    rows = F.array(*[flagged(change, drop) for change, drop in cancelled])
    flags = _latest(changes, op, at).select("id", F.explode(rows).alias("row"))
    return flags.where("row IS NOT NULL").select("id", "row.*")


def compact_changes(log, id_new="id_new", id_old="id_old", op="op_code", at="op_time"):
    """Raw rows of the changes that were not cancelled.

    A row is matched through either id, hence twice when both of its ids are kept. The ids are
    exploded so that the match is a plain hash join on (id, time, code), which AQE splits where one
    id holds many rows: the other side has each key once.
    """
    kept = change_flags(log, id_new, id_old, op, at).where("Flag = 'Yes'")
    kept = kept.select(F.col("id").alias(ID), at, op)
    raw = log.withColumn(ID, F.explode(distinct_ids(F.col(id_new), F.col(id_old))))
    return raw.join(kept, [ID, at, op]).select(*log.columns)
