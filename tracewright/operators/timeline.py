"""Correlated timeline: aligned buckets, interval spreading, phase detection and roll-up."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import checks
from tracewright.functions import numeric, text
from tracewright.operators import samples as sample_ops
from tracewright.operators.ordered import each_between, index_chunk, scan
from tracewright.session import cut_lineage

_MS = 1_000_000


class Timeline(NamedTuple):
    timeline: DataFrame
    others: DataFrame
    phases: DataFrame
    summary: DataFrame
    breakdown: DataFrame


def extents(samples: DataFrame, gpu: DataFrame) -> DataFrame:
    """First and last instant of each recording over both sources."""
    cpu = samples.select("trace_id", F.col("time_ns").alias("lo"), F.col("time_ns").alias("hi"))
    end = F.col("start_ns") + F.col("duration_ns")
    spans = gpu.select(
        "trace_id", F.least("start_ns", end).alias("lo"), F.greatest(F.col("start_ns"), end).alias("hi")
    )
    return cpu.unionByName(spans).groupBy("trace_id").agg(F.min("lo").alias("t_min"), F.max("hi").alias("t_max"))


def bucket_plan(extent: DataFrame, num_buckets: int | None = None, bucket_ms: float | None = None) -> DataFrame:
    """Bucket width and count per recording; about 10 ms per bucket, 20 to 50 buckets, unless told otherwise."""
    if num_buckets is not None:
        checks.in_range("num_buckets", num_buckets, 1)
    if bucket_ms is not None and bucket_ms <= 0:
        raise ValueError("bucket_ms must be positive")
    if bucket_ms is not None:
        width = F.lit(int(bucket_ms * _MS)).cast("bigint")
    elif num_buckets is not None:
        width = F.expr(f"total_ns div {num_buckets}")
    else:
        width = F.expr(f"total_ns div greatest(20, least(50, total_ns div {10 * _MS}))")
    span = F.col("t_max") - F.col("t_min")
    return (
        extent.withColumn("total_ns", F.when(span > 0, span).otherwise(F.lit(_MS)))
        .withColumn("width", F.greatest(width, F.lit(1000)).cast("bigint"))
        .withColumn("n_buckets", F.expr("(total_ns + width - 1) div width"))
    )


def spread_intervals(gpu: DataFrame, plan: DataFrame) -> DataFrame:
    """Each interval's overlap with every bucket it touches; buckets behind the last one are cut off."""
    placed = gpu.join(plan.select("trace_id", "t_min", "width", "n_buckets"), "trace_id")
    placed = placed.withColumn("end_ns", F.col("start_ns") + F.col("duration_ns"))
    placed = placed.withColumn("_first", numeric.bucket_index("start_ns", "t_min", "width"))
    placed = placed.withColumn(
        "_last", F.least(numeric.bucket_index("end_ns", "t_min", "width"), F.col("n_buckets") - F.lit(1))
    )
    rows = each_between(placed, "_first", "_last", "bucket")
    begin = F.col("t_min") + F.col("bucket") * F.col("width")
    overlap = F.least(F.col("end_ns"), begin + F.col("width")) - F.greatest(F.col("start_ns"), begin)
    rows = rows.withColumn("overlap_ns", overlap).filter("overlap_ns > 0")
    return rows.select("trace_id", "row_no", "label", "start_ns", "bucket", "overlap_ns")


def _named_weights(samples: DataFrame, gpu: DataFrame, plan: DataFrame) -> DataFrame:
    """Weight per bucket, side and name, ranked; each source is read once and summed before the shuffle."""
    placed = samples.join(plan.select("trace_id", "t_min", "width", "n_buckets"), "trace_id")
    placed = placed.withColumn("bucket", numeric.bucket_index("time_ns", "t_min", "width")).filter("bucket < n_buckets")
    leaf = F.get("backtrace", F.lit(0))["name"]
    cpu = placed.groupBy("trace_id", "bucket", leaf.alias("name")).agg(
        F.sum("weight").alias("w"), F.min(F.col("row_no").cast("decimal(38,0)")).alias("seen")
    )
    # Intervals are visited by start time, then in file order.
    seen = numeric.begin_key(F.col("start_ns"), F.col("row_no"))
    spread = spread_intervals(gpu, plan)
    active = spread.groupBy("trace_id", "bucket", F.col("label").alias("name")).agg(
        F.sum("overlap_ns").alias("w"), F.min(seen).alias("seen")
    )
    both = cpu.withColumn("side", F.lit("cpu")).unionByName(active.withColumn("side", F.lit("gpu")))
    by_weight = Window.partitionBy("trace_id", "bucket", "side").orderBy(
        F.col("name").isNull(), F.col("w").desc(), "seen"
    )
    return both.withColumn("rank", F.row_number().over(by_weight)).drop("seen")


def _dense_buckets(plan: DataFrame) -> DataFrame:
    """Every bucket of every recording but a last one shorter than a tenth of the width."""
    ends = plan.withColumn("_zero", F.lit(0).cast("bigint")).withColumn("_end", F.col("n_buckets") - 1)
    start = F.col("t_min") + F.col("bucket") * F.col("width")
    dense = each_between(ends, "_zero", "_end", "bucket").select(
        "trace_id",
        "bucket",
        "width",
        start.alias("start_ns"),
        F.least(start + F.col("width"), F.col("t_max")).alias("end_ns"),
    )
    return dense.filter(F.expr("end_ns - start_ns >= width div 10"))


def buckets(samples: DataFrame, gpu: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dense bucket table with shares, leaders and phase, and the runner-up names per bucket."""
    named = _named_weights(samples, gpu, plan)

    def side(value: Column, name: str) -> Column:
        return F.when(F.col("side") == name, value)

    first = F.when(F.col("rank") == 1, F.col("name"))
    per_bucket = named.groupBy("trace_id", "bucket").agg(
        F.sum(side(F.col("w"), "cpu")).alias("cpu_weight"),
        F.sum(side(F.col("w"), "gpu")).alias("gpu_active_ns"),
        F.max(side(first, "cpu")).alias("cpu_top_function"),
        F.max(side(first, "gpu")).alias("gpu_top_shader"),
    )
    dense = _dense_buckets(plan)
    joined = dense.join(per_bucket, ["trace_id", "bucket"], "left")
    length = F.col("end_ns") - F.col("start_ns")
    shares = joined.select(
        "trace_id",
        "bucket",
        "start_ns",
        "end_ns",
        F.coalesce("cpu_weight", F.lit(0)).alias("cpu_weight"),
        F.coalesce("gpu_active_ns", F.lit(0)).alias("gpu_active_ns"),
        numeric.capped_percent(F.coalesce("cpu_weight", F.lit(0)), length).alias("cpu_pct"),
        numeric.capped_percent(F.coalesce("gpu_active_ns", F.lit(0)), length).alias("gpu_pct"),
        F.coalesce("cpu_top_function", F.lit(text.IDLE)).alias("cpu_top_function"),
        F.coalesce("gpu_top_shader", F.lit(text.IDLE)).alias("gpu_top_shader"),
    )
    shares = shares.withColumn("phase", numeric.classify_phase(F.col("cpu_pct"), F.col("gpu_pct")))
    others = named.filter("rank between 2 and 4 and name is not null")
    return shares, others.join(dense.select("trace_id", "bucket"), ["trace_id", "bucket"], "left_semi")


def merge_phases(timeline: DataFrame, bounded: bool = False) -> DataFrame:
    """Runs of buckets with equal phase; a phase ends where the next one starts.

    ``bounded`` states that recordings have at most a chunk of buckets.
    """
    key = ["trace_id"]
    chunked = timeline.withColumn("_chunk", index_chunk("bucket"))
    marked = scan(chunked, key, "bucket", last_before={"previous": F.col("phase")}, bounded=bounded)
    change = (F.col("previous").isNull() | (F.col("previous") != F.col("phase"))).cast("bigint")
    # The start of the following bucket closes a run; the last run closes at its own end.
    next_start = {"next_start": F.col("start_ns")}
    grouped = scan(marked, key, "bucket", sums={"island": change}, next_after=next_start, bounded=bounded)
    run = ["trace_id", "island"]
    # One row per run and pair of leaders, then the most frequent leader of each side.
    pairs = grouped.groupBy(*run, "phase", "cpu_top_function", "gpu_top_shader").agg(
        F.min("start_ns").alias("start_ns"),
        F.max(F.coalesce("next_start", "end_ns")).alias("end_ns"),
        F.count(F.lit(1)).alias("n"),
        F.min("bucket").alias("first"),
        F.sum("cpu_pct").alias("cpu"),
        F.sum("gpu_pct").alias("gpu"),
    )

    def votes(name: str, side: str) -> tuple[Column, Column]:
        per = Window.partitionBy(*run, name)
        return F.sum("n").over(per).alias(f"_{side}_n"), F.min("first").over(per).alias(f"_{side}_first")

    counted = pairs.select("*", *votes("cpu_top_function", "cpu"), *votes("gpu_top_shader", "gpu"))

    def leader(name: str, side: str) -> Column:
        # Most buckets first, then the earliest bucket, as one sortable number.
        key = F.col(f"_{side}_n").cast("decimal(38,0)") * F.lit(10**18).cast("decimal(19,0)") - F.col(f"_{side}_first")
        return F.max_by(name, key.cast("decimal(38,0)")).alias(name)

    out = counted.groupBy(*run).agg(
        F.min("phase").alias("phase"),
        F.min("start_ns").alias("start_ns"),
        F.max("end_ns").alias("end_ns"),
        F.sum("n").alias("buckets"),
        (F.sum("cpu") / F.sum("n")).alias("avg_cpu_pct"),
        (F.sum("gpu") / F.sum("n")).alias("avg_gpu_pct"),
        leader("cpu_top_function", "cpu"),
        leader("gpu_top_shader", "gpu"),
    )
    return out.withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))


def phase_breakdown(phases: DataFrame, plan: DataFrame) -> DataFrame:
    """Time per phase name, all five names present, and its share of the recording."""
    names = F.array(*[F.lit(p) for p in numeric.PHASES])
    domain = plan.select("trace_id", "total_ns", F.explode(names).alias("phase"))
    spent = phases.groupBy("trace_id", "phase").agg(F.sum("duration_ns").alias("spent"))
    out = domain.join(spent, ["trace_id", "phase"], "left")
    duration = F.coalesce("spent", F.lit(0))
    return out.select(
        "trace_id",
        "phase",
        duration.alias("duration_ns"),
        numeric.percent(duration, F.col("total_ns")).alias("pct"),
    )


def bottleneck(phases: DataFrame, plan: DataFrame) -> DataFrame:
    """Which side dominates each recording."""

    def spent(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("phase") == name, F.col("duration_ns"))), F.lit(0))

    sums = phases.groupBy("trace_id").agg(
        spent("GPU_BOUND").alias("g"), spent("CPU_BOUND").alias("c"), spent("BALANCED").alias("b")
    )
    out = plan.join(sums, "trace_id", "left")
    verdict = (
        F.when(F.col("g") > F.col("c"), "GPU_BOUND")
        .when(F.col("c") > F.col("g"), "CPU_BOUND")
        .when(F.col("b") * 2 > F.col("total_ns"), "BALANCED")
        .otherwise("UNKNOWN")
    )
    return out.select("trace_id", verdict.alias("bottleneck"))


def correlated_timeline(
    samples: DataFrame,
    gpu: DataFrame,
    num_buckets: int | None = None,
    bucket_ms: float | None = None,
    target_process: str | None = None,
) -> Timeline:
    """Bucketed CPU and GPU activity, its phases and per-recording summary.

    ``gpu`` holds labelled intervals (``samples.gpu_intervals`` applies the process filter to the raw ones). The top
    functions and labels of the summary are ``samples.self_functions`` and ``samples.top_labels``.
    """
    if target_process is not None:
        samples = sample_ops.filter_process(samples, target_process)
    # One row per recording; every later step joins it, so it is stored once.
    plan = cut_lineage(bucket_plan(extents(samples, gpu), num_buckets, bucket_ms))
    timeline, others = buckets(samples, gpu, plan)
    # Only the default plan keeps recordings within a chunk: a given width or number of buckets may exceed it.
    phases = merge_phases(timeline, bounded=bucket_ms is None and num_buckets is None)
    cpu_count = samples.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_cpu_samples"))
    gpu_count = gpu.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_gpu_intervals"))
    summary = (
        plan.join(bottleneck(phases, plan), "trace_id")
        .join(cpu_count, "trace_id", "left")
        .join(gpu_count, "trace_id", "left")
        .select(
            "trace_id",
            numeric.to_ms(F.col("total_ns")).alias("total_duration_ms"),
            numeric.to_ms(F.col("width")).alias("bucket_width_ms"),
            F.col("n_buckets").alias("num_buckets"),
            F.coalesce("num_cpu_samples", F.lit(0)).alias("num_cpu_samples"),
            F.coalesce("num_gpu_intervals", F.lit(0)).alias("num_gpu_intervals"),
            "bottleneck",
        )
    )
    return Timeline(timeline, others, phases, summary, phase_breakdown(phases, plan))
