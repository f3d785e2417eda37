"""CPU samples, hangs, signposts: time ranges, filters, weighted rankings, interval scoping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import checks
from tracewright.functions import numeric, text
from tracewright.operators.ordered import at_cell, at_range, each_between, placed


def time_range(df: DataFrame, column: str = "time_ns", start_ns: int | None = None, end_ns: int | None = None):
    """Rows between both ends, which are inclusive and optional."""
    if start_ns is not None:
        df = df.filter(F.col(column) >= start_ns)
    if end_ns is not None:
        df = df.filter(F.col(column) <= end_ns)
    return df


def first_rows(df: DataFrame, order: list[str], limit: int | None, offset: int = 0) -> DataFrame:
    """Offset, then limit, over the stated order of the whole frame."""
    checks.limit_offset(limit, offset)
    if limit is None and not offset:
        return df
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def first_rows_per_trace(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of every recording; Spark prunes each map partition before the shuffle."""
    checks.limit_offset(limit)
    rank = Window.partitionBy("trace_id").orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= limit).drop("_rank")


def first_rows_with_total(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows of every recording beside ``total``, its number of rows before the limit."""
    totals = df.groupBy("trace_id").agg(F.count(F.lit(1)).alias("total"))
    return first_rows_per_trace(df, order, limit).join(totals, "trace_id")


def cpu_samples(
    df: DataFrame, start_ns: int | None = None, end_ns: int | None = None, limit: int | None = None
) -> DataFrame:
    """Samples in a time range with their leaf function and stack depth."""
    ranged = time_range(df, "time_ns", start_ns, end_ns)
    shown = ranged.withColumn("leaf", F.get("backtrace", F.lit(0))["name"]).withColumn("depth", F.size("backtrace"))
    return shown if limit is None else first_rows_per_trace(shown, ["row_no"], limit)


def hangs(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        numeric.to_ms(F.col("duration_ns")).alias("duration_ms"),
        text.process_display(F.col("process_name"), F.col("pid")).alias("process"),
    )


def signposts(
    df: DataFrame,
    subsystem: str | None = None,
    category: str | None = None,
    name: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Events or intervals whose named fields equal the given ones; missing texts read as empty."""
    wanted = {"subsystem": subsystem, "category": category, "name": name}
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    for column in ("message", "start_message", "end_message"):
        if column in df.columns:
            df = df.withColumn(column, F.coalesce(column, F.lit("")))
    return df if limit is None else first_rows_per_trace(df, ["row_no"], limit)


def filter_process(df: DataFrame, part: str, column: str = "process_name", keep_missing: bool = False) -> DataFrame:
    """Case-insensitive substring of the process; GPU rows without a process pass (``keep_missing``)."""
    match = text.contains_ignore_case(F.col(column), checks.filled("process", part))
    return df.filter(F.col(column).isNull() | match) if keep_missing else df.filter(match)


def top_weighted(weighted: DataFrame, name: str, weight: str, seen: str, n: int, out: str) -> DataFrame:
    """Per recording the ``n`` names with the largest summed weight, ties to the one seen first.

    Sums are pre-aggregated before the shuffle, and the ranking sees one row per name.
    """
    sums = weighted.groupBy("trace_id", name).agg(F.sum(weight).alias(out), F.min(seen).alias("_seen"))
    rank = Window.partitionBy("trace_id").orderBy(F.col(out).desc(), "_seen")
    ranked = sums.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)
    return ranked.select("trace_id", "rank", name, out)


def frames(samples: DataFrame) -> DataFrame:
    """One row per stack frame with a first-seen key that orders by sample, then by depth."""
    exploded = samples.select("trace_id", "row_no", "weight", F.posexplode("backtrace").alias("pos", "frame"))
    seen = numeric.begin_key(F.col("row_no"), F.col("pos"))
    return exploded.select("trace_id", "weight", F.col("frame.name").alias("name"), seen.alias("seen"))


def top_functions(samples: DataFrame, n: int = 20, start_ns: int | None = None, end_ns: int | None = None):
    """Inclusive weight: every occurrence of a frame adds its sample's weight."""
    ranged = time_range(samples, "time_ns", start_ns, end_ns)
    return top_weighted(frames(ranged), "name", "weight", "seen", checks.top_n(n), "total_weight")


def self_functions(samples: DataFrame, n: int = 10) -> DataFrame:
    """Weight of the leaf frame only."""
    leaves = samples.filter(F.size("backtrace") > 0).select(
        "trace_id", "row_no", "weight", F.get("backtrace", F.lit(0))["name"].alias("name")
    )
    return top_weighted(leaves, "name", "weight", "row_no", checks.top_n(n), "total_weight")


def top_labels(intervals: DataFrame, n: int = 10) -> DataFrame:
    """Total duration per interval label."""
    seen = numeric.begin_key(F.col("start_ns"), F.col("row_no"))
    return top_weighted(intervals.withColumn("seen", seen), "label", "duration_ns", "seen", checks.top_n(n), "total_ns")


def threads(samples: DataFrame) -> DataFrame:
    """Each thread once, as first seen."""
    seen = ("thread_name", "process_name", "pid")
    firsts = samples.groupBy("trace_id", "tid").agg(
        *[F.min_by(c, "row_no").alias(c) for c in seen], F.min("row_no").alias("first_row")
    )
    return firsts.select("trace_id", "tid", *seen, "first_row")


def samples_in_intervals(samples: DataFrame, intervals: DataFrame, rows: int = 256) -> DataFrame:
    """Every (sample, interval) pair with the sample inside the interval, both ends inclusive.

    Samples and both ends of all intervals are laid out in one order of time and cut into cells of ``rows`` of them,
    wherever times crowd. Cells that hold samples are numbered; an interval is open in those from its start's to its
    end's. Every cell but these two lies inside the interval, so a copy of an interval beyond them is never without
    results. In a cell, at most ``rows`` samples meet the intervals open there. Only keys and times are laid out;
    ``row_no`` must tell the rows of a recording apart. Rows without a time and intervals that end before they start
    match nothing.
    """
    checks.in_range("rows", rows, 1)
    spans = intervals.select(
        "trace_id",
        "row_no",
        F.col("start_ns").alias("interval_start_ns"),
        (F.col("start_ns") + F.col("duration_ns")).alias("interval_end_ns"),
    ).filter("interval_end_ns >= interval_start_ns")
    # At equal times starts come before samples and samples before ends.
    begin = F.struct(F.col("interval_start_ns").alias("ts"), F.lit(0).alias("kind"))
    end = F.struct(F.col("interval_end_ns").alias("ts"), F.lit(2).alias("kind"))
    ends = spans.select("trace_id", "row_no", F.inline(F.array(begin, end)))
    points = samples.select("trace_id", "row_no", F.col("time_ns").alias("ts"), F.lit(1).alias("kind"))
    # Samples before the first and behind the last interval of their recording stay where they are.
    reach = spans.groupBy("trace_id").agg(F.min("interval_start_ns").alias("_lo"), F.max("interval_end_ns").alias("_hi"))
    points = points.join(reach, "trace_id").filter("ts between _lo and _hi").drop("_lo", "_hi")
    laid = placed(points.unionByName(ends), ["trace_id", "ts", "kind", "row_no"])
    laid = laid.withColumn("_range", at_range()).withColumn("_cell", at_cell(rows))

    # Number of cells with samples up to each cell: counted per range, carried by one row per range.
    cells = laid.groupBy("_range", "_cell").agg(F.max(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("_holds"))
    upto = Window.partitionBy("_range").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.groupBy("_range").agg(F.sum("_holds").alias("_held"))
    carried = carried.select("_range", F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_carry"))
    cells = cells.withColumn("_upto", F.sum("_holds").over(upto)).join(carried, "_range")
    cells = cells.select("_range", "_cell", "_holds", (F.col("_upto") + F.col("_carry")).alias("_slot"))
    laid = laid.join(cells, ["_range", "_cell"])

    starts, stops = F.col("kind") == 0, F.col("kind") == 2
    open_in = laid.filter("kind <> 1").groupBy("trace_id", F.col("row_no").alias("interval_row")).agg(
        F.min(F.when(starts, F.col("ts"))).alias("interval_start_ns"),
        F.max(F.when(stops, F.col("ts"))).alias("interval_end_ns"),
        F.min(F.when(starts, F.col("_slot") - F.col("_holds") + 1)).alias("_first"),
        F.max(F.when(stops, F.col("_slot"))).alias("_last"),
    )
    copies = each_between(open_in, "_first", "_last", "_slot").drop("_first", "_last")
    met = laid.filter("kind = 1").select("trace_id", "row_no", "ts", "_slot").join(copies, ["trace_id", "_slot"])
    inside = met.filter("ts between interval_start_ns and interval_end_ns").drop("ts", "_slot")
    return samples.join(inside, ["trace_id", "row_no"])


def first_available(df: DataFrame, source: str, order: tuple[str, ...]) -> DataFrame:
    """Per recording the rows of the first source in ``order`` that has any."""
    priority = reduce(
        lambda c, named: c.when(F.col(source) == named[1], F.lit(named[0])),
        enumerate(order),
        F.when(F.lit(False), F.lit(-1)),
    )
    ranked = df.withColumn("_prio", priority).filter("_prio is not null")
    best = ranked.groupBy("trace_id").agg(F.min("_prio").alias("_prio"))
    return ranked.join(best, ["trace_id", "_prio"], "left_semi").drop("_prio")


def gpu_intervals(raw: DataFrame, order: tuple[str, ...], process: str | None = None) -> DataFrame:
    """Labelled GPU intervals of the first source that has any after filtering."""
    if process is not None:
        raw = filter_process(raw, process, "process_fmt", keep_missing=True)
    kept = raw.filter((F.col("start_ns") > 0) | (F.col("duration_ns") > 0))
    label: Column = text.clean_gpu_label(text.pick_label())
    return first_available(kept, "source_schema", order).select(
        "trace_id", "row_no", "source_schema", "start_ns", "duration_ns", label.alias("label")
    )
