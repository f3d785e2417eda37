"""Capture documents in JSON: event lists, groups and counter matrices, one document per recording."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.sources.exports import recording_of

CAPTURE = """metadata map<string,string>, total_functions bigint,
  events array<struct<type:string,index:bigint,kernel:string,encoder_idx:bigint,scope:string,dispatch_type:string,
    threadgroups:array<int>,threads_per_threadgroup:array<int>,buffers_bound:map<string,bigint>,pipeline_addr:bigint>>,
  command_buffers array<struct<func_idx:bigint,addr:string,dispatches:array<struct<index:bigint>>>>,
  compute_encoders array<struct<encoder_idx:bigint,command_buffer_idx:bigint,addr:string,
    dispatches:array<struct<index:bigint>>>>"""
COUNTERS = "counter_names array<string>, num_samples bigint, timestamps_ns array<bigint>, samples array<array<double>>"


class Captures(NamedTuple):
    events: DataFrame
    bindings: DataFrame
    command_buffers: DataFrame
    encoders: DataFrame


def _documents(spark: SparkSession, paths: str | list[str], ddl: str, multiline: bool, recording: Column | None):
    docs = spark.read.schema(ddl).option("multiLine", multiline).json(paths)
    trace = recording_of(F.col("doc")) if recording is None else recording
    return docs.withColumn("doc", F.col("_metadata.file_path")).withColumn("trace_id", trace).drop("doc")


def read_captures(
    spark: SparkSession, paths: str | list[str], multiline: bool = True, recording: Column | None = None
) -> Captures:
    """Event captures as flat tables. With ``multiline`` False every line is a document, which splits large files."""
    docs = _documents(spark, paths, CAPTURE, multiline, recording)
    events = docs.select("trace_id", F.explode("events").alias("e")).select("trace_id", "e.*")
    events = events.withColumnsRenamed({"index": "func_idx", "threads_per_threadgroup": "threads_per_tg"})
    groups = docs.select("trace_id", F.posexplode("command_buffers").alias("cb_idx", "g"))
    members = groups.select("trace_id", F.col("cb_idx").cast("bigint"), F.explode("g.dispatches.index").alias("func_idx"))
    # A dispatch belongs to the first command buffer that lists it, else to -1.
    members = members.groupBy("trace_id", "func_idx").agg(F.min("cb_idx").alias("cb_idx"))
    events = events.join(members, ["trace_id", "func_idx"], "left")
    events = events.withColumn("cb_idx", F.when(F.col("type") == "dispatch", F.coalesce("cb_idx", F.lit(-1))))
    bound = events.filter("type = 'dispatch'").select("trace_id", "func_idx", F.posexplode("buffers_bound").alias("ord", "slot", "buffer_addr"))
    bindings = bound.select(
        "trace_id", "func_idx", "ord", F.col("slot").cast("int").alias("buffer_index"), "buffer_addr", F.lit("UNKNOWN").alias("access_mode")
    )
    buffers = groups.select(
        "trace_id", F.col("cb_idx").cast("bigint"), F.coalesce("g.addr", F.lit("")).alias("addr"), "g.func_idx",
        F.size("g.dispatches").cast("bigint").alias("num_dispatches"),
    )
    encoders = docs.select("trace_id", F.explode("compute_encoders").alias("g")).select(
        "trace_id", "g.encoder_idx", F.col("g.command_buffer_idx").alias("cb_idx"), F.coalesce("g.addr", F.lit("")).alias("addr"),
        F.size("g.dispatches").cast("bigint").alias("num_dispatches"),
    )
    return Captures(events.drop("buffers_bound"), bindings, buffers, encoders)


def read_counters(
    spark: SparkSession, paths: str | list[str], multiline: bool = True, recording: Column | None = None
) -> DataFrame:
    """Counter matrices as long rows (trace_id, counter, sample_idx, ts_ns, value)."""
    docs = _documents(spark, paths, COUNTERS, multiline, recording)
    rows = docs.select("trace_id", "counter_names", "timestamps_ns", F.posexplode("samples").alias("sample_idx", "row"))
    rows = rows.select(
        "trace_id", "sample_idx", F.get("timestamps_ns", "sample_idx").alias("ts_ns"), F.explode(F.arrays_zip("counter_names", "row")).alias("z")
    )
    return rows.select("trace_id", F.col("z.counter_names").alias("counter"), F.col("sample_idx").cast("bigint"), "ts_ns", F.col("z.row").alias("value"))
