"""Compare one metric between a source and a target system."""

from pyspark.sql import functions as F

from tallyline import codes
from tallyline.functions.columns import id_list, within_threshold
from tallyline.operators.lookup import join_definitions, latest_per_key
from tallyline.operators.ordered import number_rows

MAP_ID = "MetricComparisionMapId"
MAP_COLUMNS = [MAP_ID, "MetricId", "ComparisionId", "ThresholdPercentage"]
DEFINITION_COLUMNS = ["ComparisionId", "SourceId", "TargetId"]


def comparisons_of(definitions, system_id):
    """Comparison definitions in which the system is source or target."""
    systems = F.array("SourceId", "TargetId")
    return definitions.where(F.array_contains(systems, F.lit(system_id)))


def _maps(maps, map_ids):
    maps = maps.select(*MAP_COLUMNS)
    if map_ids is not None:
        maps = maps.where(F.col(MAP_ID).isin(id_list(map_ids)))
    return latest_per_key(maps, [MAP_ID])


def _last_values(metric_data, keys):
    """Per key the last metric row and the last one that is not zero.

    Rows are ordered by batch, version, system and value. Everything a reconciliation needs of
    metric_data is in these maxima, so it is read once and reduced before its shuffle, whatever the
    number of rows of a system, and no row of it is joined.
    """
    row = F.struct("BatchId", "MetricVersion", "SourceId", "MetricValue")
    return metric_data.groupBy(*keys).agg(
        F.max(row).alias("last"),
        F.max(F.when(F.col("MetricValue") != 0, row)).alias("last_value"),
    )


def _of_systems(metric_data, systems, map_ids):
    """The metric rows of the listed maps' systems, filtered before they are reduced."""
    if map_ids is None:
        return metric_data
    wanted = systems.select("MetricId", "SourceId").distinct()
    return metric_data.join(wanted, ["MetricId", "SourceId"], "left_semi")


def _log(df):
    zero = F.lit(0).cast("bigint")
    source = F.coalesce(F.col("SourceValue").cast("bigint"), zero)
    target = F.coalesce(F.col("TargetValue").cast("bigint"), zero)
    threshold = F.coalesce("ThresholdPercentage", F.lit(0))
    deviation = F.abs(target - source)
    return df.select(
        MAP_ID,
        "MetricBatch",
        "MetricVersion",
        F.coalesce("SourceId", F.lit(0)).alias("SourceId"),
        source.alias("SourceValue"),
        F.coalesce("TargetId", F.lit(0)).alias("TargetId"),
        target.alias("TargetValue"),
        threshold.alias("ThresholdPercentage"),
        deviation.alias("DeviationPercentage"),
        within_threshold(deviation, threshold).alias("ReconStatus"),
    )


def recon_by_map(maps, definitions, metric_data, map_ids=None):
    """One reconciliation per comparison map, from the last rows of its two systems.

    A zero counts as no value. A map without any metric row is left out; a side without rows is 0.
    When source and target are the same system its rows count for both sides.
    """
    compared = join_definitions(
        _maps(maps, map_ids), definitions.select(*DEFINITION_COLUMNS).distinct(), ["ComparisionId"]
    )
    sides = compared.select(
        MAP_ID, "MetricId", "ThresholdPercentage",
        F.explode(F.array(
            F.struct(F.lit(True).alias("is_source"), F.col("SourceId").alias("SourceId")),
            F.struct(F.lit(False).alias("is_source"), F.col("TargetId").alias("SourceId")),
        )).alias("side"),
    ).select(MAP_ID, "MetricId", "ThresholdPercentage", "side.*")
    keys = ["MetricId", "SourceId"]
    found = join_definitions(sides, _last_values(_of_systems(metric_data, sides, map_ids), keys), keys)

    on_source, on_target = F.col("is_source"), ~F.col("is_source")
    known = F.col("SourceId") != 0
    folded = found.groupBy(MAP_ID).agg(
        F.max("last").alias("last"),
        F.max(F.when(on_source & known, F.col("last")))["SourceId"].alias("SourceId"),
        F.max(F.when(on_source, F.col("last_value")))["MetricValue"].alias("SourceValue"),
        F.max(F.when(on_target & known, F.col("last")))["SourceId"].alias("TargetId"),
        F.max(F.when(on_target, F.col("last_value")))["MetricValue"].alias("TargetValue"),
        F.max("ThresholdPercentage").alias("ThresholdPercentage"),
    )
    return _log(folded.withColumns({
        "MetricBatch": F.col("last.BatchId"), "MetricVersion": F.col("last.MetricVersion"),
    }))


def recon_by_batch(maps, definitions, tracker, metric_data, map_ids=None, on_missing="zero"):
    """One reconciliation per comparison map and tracked batch whose status is New.

    When source and target are the same system its rows count for the source side only. A batch
    without metric rows gives a row of zeros that passes, or none with ``on_missing="skip"``.
    """
    tracked = tracker.where(F.col("MetricComparisionStatus") == codes.TRACKER_NEW)
    if map_ids is not None:
        tracked = tracked.where(F.col(MAP_ID).isin(id_list(map_ids)))
    definitions = latest_per_key(definitions.select(*DEFINITION_COLUMNS), ["ComparisionId"])
    mapped = join_definitions(_maps(maps, map_ids), definitions, ["ComparisionId"])
    compared = join_definitions(tracked.select(MAP_ID, "BatchId").distinct(), mapped, [MAP_ID], growing=True)
    systems = mapped.select("MetricId", F.explode(F.array("SourceId", "TargetId")).alias("SourceId"))
    metric_data = _of_systems(metric_data, systems, map_ids)

    # one narrow row per metric, system and batch, matched once for each side
    value = F.struct("MetricVersion", "MetricValue")
    values = metric_data.groupBy("MetricId", "BatchId", F.col("SourceId").alias("system")).agg(
        F.max("MetricVersion").alias("version"),
        F.max(F.when(F.col("MetricValue") != 0, value))["MetricValue"].alias("value"),
    )
    def side(name, system):
        return values.select(
            "MetricId", "BatchId", F.col("system").alias(system), F.struct("system", "version", "value").alias(name)
        )

    by = ["MetricId", "BatchId"]
    matched = join_definitions(compared, side("s", "SourceId"), [*by, "SourceId"], "left", growing=True)
    matched = join_definitions(matched, side("t", "TargetId"), [*by, "TargetId"], "left", growing=True)
    matched = matched.withColumn("t", F.when(F.col("TargetId") != F.col("SourceId"), F.col("t")))
    found = F.col("s").isNotNull() | F.col("t").isNotNull()
    if on_missing == "skip":
        matched = matched.where(found)
    return _log(matched.select(
        MAP_ID,
        F.col("BatchId").alias("MetricBatch"),
        F.coalesce(F.greatest("s.version", "t.version"), F.lit("")).alias("MetricVersion"),
        F.col("s.system").alias("SourceId"),
        F.col("s.value").alias("SourceValue"),
        F.col("t.system").alias("TargetId"),
        F.col("t.value").alias("TargetValue"),
        F.when(found, F.col("ThresholdPercentage")).alias("ThresholdPercentage"),
    ))


def number_log(log, order=(MAP_ID, "MetricBatch"), start=1):
    """Add ReconLogId, counted from `start` in `order`."""
    return number_rows(log, list(order), "ReconLogId", start)
