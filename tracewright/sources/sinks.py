"""Writers for exported rows, dependency graphs and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright import checks

FORMATS = ("parquet", "json")


def write_table(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    checks.choice("file_format", file_format, FORMATS)
    df.write.mode(mode).format(file_format).save(path)


def event_lines(events: DataFrame, named: bool = False) -> DataFrame:
    """(trace_id, ts, value): every event as one JSON object; ``args`` already is JSON text and becomes an object.

    ``named`` objects hold the recording as their field ``trace_id``, too.
    """
    fields = [c for c in events.columns if c != "args" and (named or c != "trace_id")]
    head = events.withColumn("_head", F.to_json(F.struct(*fields)))
    args = F.concat(F.expr("left(_head, length(_head) - 1)"), F.lit(',"args":'), "args", F.lit("}"))
    return head.select("trace_id", "ts", F.when(F.col("args").isNotNull(), args).otherwise(F.col("_head")).alias("value"))


def write_trace_events(events: DataFrame, path: str, mode: str = "errorifexists", folders: bool = True) -> None:
    """One folder per recording with one event per line in time order, names and other events without a time first.

    The rows are dealt out by ranges of (recording, time), so a recording of any size is spread over files that follow
    one another, and none of it stands in one task or list. Without ``folders`` these ranges are the files and every line
    names its recording: the same lines in the same order, in as many files as there are tasks. Many small recordings
    want that, since a folder and a file for each cost far more than their events.
    """
    placed = event_lines(events, named=not folders).repartitionByRange("trace_id", "ts").sortWithinPartitions("trace_id", "ts", "value")
    if folders:
        placed.select("trace_id", "value").write.mode(mode).partitionBy("trace_id").text(path)
    else:
        placed.select("value").write.mode(mode).text(path)


def write_dep_graph(tables: dict[str, DataFrame], path: str, file_format: str = "json", mode: str = "errorifexists") -> None:
    """Nodes, edges, summary and roll-ups of a dependency report, each as its own table below ``path``."""
    checks.choice("file_format", file_format, FORMATS)
    for name, df in tables.items():
        hexed = df.withColumn("buffer", F.concat(F.lit("0x"), F.lower(F.hex("buffer_addr")))) if "buffer_addr" in df.columns else df
        write_table(hexed, f"{path}/{name}", file_format, mode)
