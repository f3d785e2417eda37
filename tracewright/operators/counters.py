"""Hardware counters: selection, rates, nearest resampling, display order and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import fixed_values, text
from tracewright.operators.ordered import scan, time_chunk
from tracewright.session import cut_lineage


def counter_filter(counters: DataFrame, names: list[str]) -> DataFrame:
    """Counters with exactly the given names."""
    return counters.filter(F.col("counter").isin(names))


def _having(counters: DataFrame, condition: Column) -> DataFrame:
    kept = counters.groupBy("trace_id", "counter").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    return counters.join(kept.filter(condition), ["trace_id", "counter"], "left_semi")


def usable_counters(counters: DataFrame) -> DataFrame:
    """Named counters with something to show: no hash names, no series that is zero throughout."""
    named = counters.filter(~F.col("counter").rlike("^_?[0-9A-Fa-f]{64}$"))
    return _having(named, ~((F.col("_lo") == 0) & (F.col("_hi") == 0)))


def nonzero_counters(counters: DataFrame) -> DataFrame:
    """Counters with any sample other than zero."""
    return _having(counters, (F.col("_lo") != 0) | (F.col("_hi") != 0))


def counter_summary(counters: DataFrame) -> DataFrame:
    return counters.groupBy("trace_id", "counter").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("avg"),
        F.count(F.lit(1)).alias("num_samples"),
    )


def primary_rate(counters: DataFrame) -> DataFrame:
    """Per recording the sample count most counters share; ties go to the count whose first name sorts first."""
    sizes = counters.groupBy("trace_id", "counter").agg(F.count(F.lit(1)).alias("num_samples"))
    rates = sizes.groupBy("trace_id", "num_samples").agg(
        F.count(F.lit(1)).alias("counters"), F.min("counter").alias("first_counter")
    )
    rank = Window.partitionBy("trace_id").orderBy(F.col("counters").desc(), "first_counter")
    best = rates.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")
    return best.select("trace_id", "num_samples", "counters", "first_counter")


def resample_nearest(source: DataFrame, axis: DataFrame) -> DataFrame:
    """For each (trace_id, counter) the source value nearest in time to every axis point; on equal distance the later.

    ``source``: trace_id, counter, sample_idx, ts_ns, value. ``axis``: trace_id, counter, sample_idx, ts_ns. Both are
    merged in time order and cut into chunks of time; the nearest earlier and later values come from running columns.
    """
    # The last of several values at one instant counts.
    latest = source.groupBy("trace_id", "counter", "ts_ns").agg(F.max_by("value", "sample_idx").alias("value"))
    nothing = F.lit(None)
    points = axis.select("trace_id", "counter", "ts_ns", "sample_idx", nothing.cast("double").alias("value"))
    known = latest.select("trace_id", "counter", "ts_ns", nothing.cast("bigint").alias("sample_idx"), "value")
    merged = known.unionByName(points)
    merged = merged.withColumn("pos", F.col("ts_ns") * 2 + F.col("value").isNull().cast("int"))
    key = ["trace_id", "counter"]
    seen = F.when(F.col("value").isNotNull(), F.struct("ts_ns", "value"))
    around = scan(
        time_chunk(merged, key, "ts_ns"), key, "pos", last_before={"left": seen}, next_after={"right": seen}
    )
    to_left = F.col("ts_ns") - F.col("left.ts_ns")
    to_right = F.col("right.ts_ns") - F.col("ts_ns")
    take_right = F.col("left").isNull() | (F.col("right").isNotNull() & (to_right <= to_left))
    value = F.when(take_right, F.col("right.value")).otherwise(F.col("left.value"))
    return around.filter("sample_idx is not null").select("trace_id", "counter", "sample_idx", "ts_ns", value.alias("value"))


def display_order(names: DataFrame) -> DataFrame:
    """Add category, unit and display rank columns. The catalog has 111 rows, safe to broadcast."""
    catalog = F.broadcast(fixed_values.counter_catalog(names.sparkSession))
    out = names.join(catalog, "counter", "left")
    last = len(fixed_values.COUNTER_CATEGORIES)
    return (
        out.withColumn("category", F.coalesce("category", F.lit(fixed_values.OTHER_CATEGORY)))
        .withColumn("cat_rank", F.coalesce("cat_rank", F.lit(last)))
        .withColumn("idx", F.coalesce("idx", F.lit(0)))
        .withColumn("unit", text.counter_unit(F.col("counter")))
    )


def _names(counters: DataFrame) -> DataFrame:
    return counters.select("trace_id", "counter").distinct()


def counter_order(counters: DataFrame) -> DataFrame:
    """Counter names of each recording in display order: category, place in it, then name."""
    rank = Window.partitionBy("trace_id").orderBy("cat_rank", "idx", "counter")
    return display_order(_names(counters)).withColumn("position", F.row_number().over(rank) - 1)


def counter_matrix(counters: DataFrame) -> DataFrame:
    """All counters of a recording on its primary time axis, in long form.

    The axis is that of the first counter in display order among those with the primary sample count. Counters at that
    rate keep their samples by position, the others are resampled.
    """
    usable = cut_lineage(usable_counters(counters))
    sizes = usable.groupBy("trace_id", "counter").agg(F.count(F.lit(1)).alias("_n"))
    rates = primary_rate(usable).select("trace_id", F.col("num_samples").alias("_rate"))
    order = counter_order(usable).select("trace_id", "counter", "position")
    # One row per recording and counter.
    facts = sizes.join(rates, "trace_id").join(order, ["trace_id", "counter"])
    facts = cut_lineage(facts.withColumn("at_rate", F.col("_n") == F.col("_rate")).drop("_n", "_rate"))
    lead = facts.filter("at_rate").groupBy("trace_id").agg(F.min_by("counter", "position").alias("counter"))
    axis = cut_lineage(usable.join(lead, ["trace_id", "counter"], "left_semi").select("trace_id", "sample_idx", "ts_ns"))
    key = ["trace_id", "counter"]
    direct = usable.join(facts.filter("at_rate"), key, "left_semi").drop("ts_ns").join(axis, ["trace_id", "sample_idx"])
    other_names = facts.filter("not at_rate").select(*key)
    others = usable.join(other_names, key, "left_semi")
    resampled = resample_nearest(others, axis.join(other_names, "trace_id"))
    columns = ["trace_id", "counter", "sample_idx", "ts_ns", "value"]
    return direct.select(*columns).unionByName(resampled).join(facts.select(*key, "position"), key)


def wide_matrix(matrix: DataFrame, names: list[str]) -> DataFrame:
    """One column per named counter, one row per axis point."""
    return matrix.groupBy("trace_id", "sample_idx", "ts_ns").pivot("counter", names).agg(F.first("value"))


def counter_report(counters: DataFrame, names: list[str] | None = None, summary: bool = True) -> DataFrame:
    """Summary per counter, or the full matrix, of all or of the named counters."""
    matrix = counter_matrix(counters)
    if names is not None:
        matrix = counter_filter(matrix, names)
    return counter_summary(matrix) if summary else matrix


def hash_labels(hashes: DataFrame, column: str = "hash") -> DataFrame:
    """Readable label and derived names of counter hashes. The dictionary has 35 rows, safe to broadcast."""
    known = F.broadcast(fixed_values.counter_hashes(hashes.sparkSession).select(F.col("hash").alias(column), "label", "vendor_names", "hw_group"))
    out = hashes.join(known, column, "left")
    cut = F.concat(F.substring(column, 1, 16), F.lit("..."))
    return out.withColumn("label", F.coalesce("label", cut)).withColumn(
        "vendor_names", F.coalesce("vendor_names", F.array().cast("array<string>"))
    )
