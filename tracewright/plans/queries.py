"""Named queries over the driver's tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import GPU_SOURCES
from tracewright.operators import samples, timeline
from tracewright.plans import adapters
from tracewright.plans.oracle import RANGE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Samples, hangs, signposts


@query
def top_functions(spark, sf):
    return samples.top_functions(adapters.cpu_samples(spark, sf))


@query
def top_functions_range(spark, sf):
    return samples.top_functions(adapters.cpu_samples(spark, sf), 5, *RANGE)


@query
def self_functions(spark, sf):
    return samples.self_functions(adapters.cpu_samples(spark, sf))


def _gpu(spark, sf, several_sources=False, process=None):
    return samples.gpu_intervals(adapters.gpu_intervals_raw(spark, sf, several_sources), GPU_SOURCES, process)


@query
def top_labels(spark, sf):
    return samples.top_labels(_gpu(spark, sf))


@query
def threads(spark, sf):
    return samples.threads(adapters.cpu_samples(spark, sf))


@query
def cpu_samples_range(spark, sf):
    return samples.cpu_samples(adapters.cpu_samples(spark, sf), *RANGE).drop("backtrace", "pid")


@query
def cpu_samples_first(spark, sf):
    first = samples.cpu_samples(adapters.cpu_samples(spark, sf), limit=5)
    return first.select("trace_id", "row_no", "time_ns", "leaf")


@query
def cpu_samples_total(spark, sf):
    first = samples.first_rows_with_total(adapters.cpu_samples(spark, sf), ["row_no"], 3)
    return first.select("trace_id", "row_no", "total")


@query
def first_signposts(spark, sf):
    """Offset and limit over the file order of all recordings."""
    events = adapters.signpost_events(spark, sf)
    return samples.first_rows(events, ["row_no"], 50, 100).select("trace_id", "row_no", "name")


@query
def hangs(spark, sf):
    return samples.hangs(adapters.hangs(spark, sf)).drop("pid", "process_name", "tid")


@query
def signpost_events(spark, sf):
    found = samples.signposts(adapters.signpost_events(spark, sf), subsystem="sub1", name="click")
    return found.select("trace_id", "row_no", "time_ns", "event_type", "name", "message", "scope")


@query
def signpost_intervals(spark, sf):
    found = samples.signposts(adapters.signpost_intervals(spark, sf), category="cat2")
    return found.drop("subsystem", "category", "identifier", "pid", "process_name")


@query
def process_filter(spark, sf):
    raw = adapters.gpu_intervals_raw(spark, sf)
    return samples.filter_process(raw, "APP1", "process_fmt", keep_missing=True).select(
        "trace_id", "row_no", "process_fmt"
    )


@query
def process_filter_cpu(spark, sf):
    found = samples.filter_process(adapters.cpu_samples(spark, sf), "OC2")
    return found.select("trace_id", "row_no", "process_name")


@query
def label_clean(spark, sf):
    return _gpu(spark, sf).select("trace_id", "row_no", "label")


@query
def samples_in_hangs(spark, sf):
    pairs = samples.samples_in_intervals(
        adapters.cpu_samples(spark, sf).select("trace_id", "row_no", "time_ns", "weight"),
        adapters.hangs(spark, sf),
    )
    return pairs.select("trace_id", "row_no", "interval_row", "weight")


@query
def source_priority(spark, sf):
    return _gpu(spark, sf, several_sources=True).select("trace_id", "row_no", "source_schema")


# Correlated timeline


@query
def interval_spread(spark, sf):
    cpu, gpu = adapters.cpu_samples(spark, sf), _gpu(spark, sf)
    plan = timeline.bucket_plan(timeline.extents(cpu, gpu), num_buckets=50)
    spread = timeline.spread_intervals(gpu, plan)
    return spread.groupBy("trace_id", "bucket").agg(
        F.sum("overlap_ns").alias("active_ns"), F.count(F.lit(1)).alias("pieces")
    )


def _timeline(spark, sf, **kwargs):
    return timeline.correlated_timeline(adapters.cpu_samples(spark, sf), _gpu(spark, sf), **kwargs)


@query
def timeline_(spark, sf):
    return _timeline(spark, sf).timeline


QUERIES["timeline"] = QUERIES.pop("timeline_")


@query
def timeline_hours(spark, sf):
    return _timeline(spark, sf, bucket_ms=6 * 3_600_000).timeline


@query
def timeline_others(spark, sf):
    return _timeline(spark, sf).others


@query
def phases(spark, sf):
    return _timeline(spark, sf).phases.drop("avg_cpu_pct", "avg_gpu_pct")


@query
def phase_breakdown(spark, sf):
    return _timeline(spark, sf).breakdown


@query
def timeline_summary(spark, sf):
    return _timeline(spark, sf).summary
