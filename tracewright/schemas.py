"""Canonical tables. All instants and durations are BIGINT nanoseconds."""

from __future__ import annotations

from pyspark.sql import types as T

FRAME = "struct<name:string,address:string,binary_name:string,binary_path:string,binary_uuid:string>"

_TABLES = {
    "trace_info": "trace_id string, device_name string, device_model string, os_version string, platform string, "
    "start_date string, end_date string, duration_seconds double, instruments_version string, "
    "template_name string, recording_mode string, end_reason string, target_process string, target_pid bigint",
    "trace_table": "trace_id string, ord bigint, schema string, attributes map<string,string>",
    "trace_process": "trace_id string, ord bigint, pid bigint, name string",
    "table_columns": "trace_id string, schema string, position int, mnemonic string, name string, "
    "engineering_type string",
    "table_cells": "trace_id string, schema string, row_no bigint, position int, mnemonic string, tag string, "
    "text string, fmt string",
    "cpu_samples": "trace_id bigint, row_no bigint, time_ns bigint, pid bigint, process_name string, tid bigint, "
    f"thread_name string, core string, state string, weight bigint, backtrace array<{FRAME}>",
    "hangs": "trace_id bigint, row_no bigint, start_ns bigint, duration_ns bigint, hang_type string, pid bigint, "
    "process_name string, tid bigint, thread_name string",
    "gpu_intervals_raw": "trace_id bigint, row_no bigint, source_schema string, start_ns bigint, "
    "duration_ns bigint, process_fmt string, event_label string, label string, channel_name string, narr string, "
    "name string, shader string, function string",
    "api_calls": "trace_id bigint, func_idx bigint, call_id int, arg_text string, obj_addr bigint",
    "gpu_events": "trace_id bigint, func_idx bigint, type string, kernel string, encoder_idx bigint, "
    "scope string, dispatch_type string, threadgroups array<int>, threads_per_tg array<int>",
    "dispatches": "trace_id bigint, dispatch_id bigint, func_idx bigint, kernel string, encoder_idx bigint, "
    "cb_idx bigint, threadgroups array<int>, threads_per_tg array<int>",
    "bindings": "trace_id bigint, dispatch_id bigint, ord int, buffer_index int, buffer_addr bigint, "
    "access_mode string",
    "barriers": "trace_id bigint, barrier_id bigint, func_idx bigint, scope string, encoder_idx bigint, "
    "cb_idx bigint, after_dispatch_id bigint",
    "dispatch_times": "trace_id bigint, func_idx bigint, ts_begin_ns bigint, ts_end_ns bigint",
    "counters": "trace_id bigint, counter string, sample_idx bigint, ts_ns bigint, value double",
    "dep_edges": "trace_id bigint, src bigint, tgt bigint, dep_type string, buffer_addr bigint",
}


def schema(table: str) -> T.StructType:
    """The Spark schema of a canonical table, for reading stored tables and for tests."""
    return T.StructType.fromDDL(_TABLES[table])
