"""Recording exports in XML: files with one or more tables of a recording, and tables of contents.

A table export is read as text split at row ends, so a large file is spread over tasks. Each fragment is parsed on its
own; cells that refer to content given elsewhere in the file are completed by a join on (file, id).
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import fixed_values, text
from tracewright.operators.catalog import expand_refs
from tracewright.operators.ordered import scan
from tracewright.schemas import schema as table_schema
from tracewright.session import cut_lineage

_OPEN_ROW = re.compile(r"<row(?=[\s>])(?![^>]*/>)")
_TABLE = re.compile(r"<node(?=[\s>])")
_SCHEMA = re.compile(r"<schema(?=[\s>]).*?</schema>", re.DOTALL)
_EMPTY_ROW = re.compile(r"<row\s*/>")
_NODE = "struct<idx:int,parent:int,position:int,tag:string,id:string,ref:string,text:string,fmt:string,attrs:map<string,string>>"
_HEADER = "struct<node:int,schema:string,columns:array<struct<mnemonic:string,name:string,engineering_type:string>>>"
_FRAGMENT = f"struct<rows:int,nodes:int,elements:array<{_NODE}>,headers:array<{_HEADER}>>"


class Exports(NamedTuple):
    """``elements``: completed elements of all rows; ``columns``: the header of every table."""

    elements: DataFrame
    columns: DataFrame


def _parse_fragment(fragment: str) -> dict:
    """Cells of the row that ends a fragment, in document order, and table headers; empty rows and table starts are counted."""
    opened = _OPEN_ROW.search(fragment)
    elements: list[tuple] = []
    if opened:
        row = ET.fromstring(fragment[opened.start() :] + "</row>")

        def visit(node: ET.Element, parent: int, position: int) -> None:
            attrs = dict(node.attrib)
            named = [attrs.pop(key, None) for key in ("id", "fmt")]
            content = (node.text or "").strip() or None
            idx = len(elements)
            elements.append((idx, parent, position, node.tag, named[0], attrs.get("ref"), content, named[1], attrs))
            for child in node:
                visit(child, idx, -1)

        for position, cell in enumerate(row):
            visit(cell, -1, position)
    rows = len(_EMPTY_ROW.findall(fragment)) + bool(opened)
    starts = [m.start() for m in _TABLE.finditer(fragment)]
    headers = [(sum(at < m.start() for at in starts), *_header(m.group())) for m in _SCHEMA.finditer(fragment)]
    return {"rows": rows, "nodes": len(starts), "elements": elements, "headers": headers}


def _parsed(parse: Callable[[str], dict], ddl: str) -> Column:
    """The ``value`` column parsed text by text, in Arrow batches."""

    def batch(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(v) for v in values])

    return F.pandas_udf(batch, ddl)(F.col("value"))


def _header(xml: str) -> tuple[str, list[tuple]]:
    root = ET.fromstring(xml)
    parts = ("mnemonic", "name", "engineering-type")
    return root.get("name", ""), [tuple(col.findtext(p) or None for p in parts) for col in root.findall("col")]


def recording_of(path: Column) -> Column:
    """Default recording id: the folder that holds the file."""
    return F.element_at(F.split(path, "/"), -2)


def read_exports(spark: SparkSession, paths: str | list[str], recording: Column | None = None) -> Exports:
    """Read table exports, all tables of every file. ``recording`` maps the column ``doc`` (file path) to the recording's id.

    Row numbers count all rows of a file, so those of a second table go on where the first one ends.
    """
    lines = spark.read.option("lineSep", "</row>").text(paths)
    lines = lines.select(
        F.col("_metadata.file_path").alias("doc"),
        F.col("_metadata.file_block_start").alias("_chunk"),
        F.monotonically_increasing_id().alias("_line"),
        "value",
    )
    trace = recording_of(F.col("doc")) if recording is None else recording
    parsed = cut_lineage(lines.select("doc", "_chunk", "_line", _parsed(_parse_fragment, _FRAGMENT).alias("f")))
    # Rows and tables are counted over the whole file: a block of the file is a chunk, lines keep their order inside it.
    numbered = scan(parsed, ["doc"], "_line", sums={"_rows": F.col("f.rows"), "node_no": F.col("f.nodes")})
    heads = numbered.filter(F.size("f.headers") > 0).select("doc", F.explode("f.headers").alias("h"), (F.col("node_no") - F.col("f.nodes")).alias("_before"))
    heads = heads.select(
        "doc", trace.cast("string").alias("trace_id"), (F.col("_before") + F.col("h.node")).alias("node_no"), "h.schema", "h.columns"
    )
    heads = cut_lineage(heads)
    elements = numbered.filter(F.size("f.elements") > 0).select(
        "doc", (F.col("_rows") - 1).alias("row_no"), "node_no", F.explode("f.elements").alias("e")
    ).select("doc", "row_no", "node_no", "e.*")
    elements = elements.withColumns({"src_row": F.col("row_no"), "src_idx": F.col("idx")})
    expanded = expand_refs(elements, ["doc"], ["tag", "text", "fmt", "attrs", "src_row", "src_idx"], order=F.struct("row_no", "idx"))
    expanded = expanded.join(heads.select("doc", "node_no", "trace_id", "schema"), ["doc", "node_no"])
    columns = heads.select("trace_id", "doc", "node_no", "schema", F.posexplode("columns").alias("position", "c")).select(
        "trace_id", "doc", "node_no", "schema", "position", "c.*"
    )
    return Exports(cut_lineage(expanded), columns)


def _cells(exports: Exports) -> DataFrame:
    cells = exports.elements.filter("position >= 0")
    names = exports.columns.select("doc", "node_no", "position", "mnemonic")
    return cells.join(names, ["doc", "node_no", "position"], "left")


def table_cells(exports: Exports) -> DataFrame:
    """Generic cells of every table."""
    columns = table_schema("table_cells").fieldNames()
    return _cells(exports).select(*columns)


def _children(exports: Exports, parents: DataFrame, tag: str, **wanted: Column) -> DataFrame:
    """Children with the given tag of ``parents`` (doc, src_row, src_idx, …), with selected content."""
    kids = exports.elements.filter((F.col("tag") == tag) & (F.col("parent") >= 0)).select(
        "doc",
        F.col("row_no").alias("src_row"),
        F.col("parent").alias("src_idx"),
        F.col("idx").alias("ord"),
        F.col("src_row").alias("kid_row"),
        F.col("src_idx").alias("kid_idx"),
        *[c.alias(n) for n, c in wanted.items()],
    )
    return parents.join(kids, ["doc", "src_row", "src_idx"])


def _child_number(exports: Exports, cells: DataFrame, mnemonic: str, tag: str, name: str) -> DataFrame:
    """An integer given as the first child of a cell, per row."""
    owners = cells.filter(F.col("mnemonic") == mnemonic).select("doc", "row_no", "src_row", "src_idx")
    found = _children(exports, owners, tag, value=text.int_value(F.col("text")))
    return found.groupBy("doc", "row_no").agg(F.min_by("value", "ord").alias(name))


def _wide(exports: Exports, schemas: tuple[str, ...], mnemonics: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows of the named tables with one struct (raw text, display) per column; missing cells are null."""
    cells = _cells(exports).filter(F.col("schema").isin(*schemas))
    present = F.struct("text", "fmt", text.display_value(F.col("fmt"), F.col("text")).alias("value"))
    columns = [
        F.max(F.when((F.col("mnemonic") == m) & (F.col("tag") != "sentinel"), present)).alias(m.replace("-", "_"))
        for m in mnemonics
    ]
    return cells, cells.groupBy("trace_id", "doc", "schema", "row_no").agg(*columns)


def _number(column: str) -> Column:
    return text.int_value(F.col(f"{column}.text"))


def _words(column: str) -> Column:
    return F.coalesce(F.col(f"{column}.value"), F.lit(""))


def _thread_name(column: str = "thread") -> Column:
    shown = F.coalesce(F.when(F.col(f"{column}.fmt") != "", F.col(f"{column}.fmt")), F.col(f"{column}.text"))
    return F.coalesce(shown, F.lit("Unknown"))


def _process_name() -> Column:
    shown = F.coalesce(F.when(F.col("process.fmt") != "", F.col("process.fmt")), F.col("process.text"))
    return text.process_name(shown)


def _with_ids(exports: Exports, cells: DataFrame, rows: DataFrame, *ids: tuple[str, str, str]) -> DataFrame:
    for mnemonic, tag, name in ids:
        rows = rows.join(_child_number(exports, cells, mnemonic, tag, name), ["doc", "row_no"], "left")
        rows = rows.withColumn(name, F.coalesce(name, F.lit(0)))
    return rows


def cpu_samples(exports: Exports) -> DataFrame:
    """Samples with resolved stacks; of both sample tables the preferred one is taken per recording."""
    wanted = ("time", "thread", "process", "core", "thread-state", "weight", "stack")
    cells, rows = _wide(exports, fixed_values.CPU_SOURCES, wanted)
    best = rows.groupBy("trace_id").agg(F.min("schema").alias("schema"))  # the preferred name sorts first
    rows = rows.join(best, ["trace_id", "schema"], "left_semi")
    rows = _with_ids(exports, cells, rows, ("process", "pid", "pid"), ("thread", "tid", "tid"))
    stacks = cells.filter("mnemonic = 'stack'").select("doc", "row_no", "src_row", "src_idx")
    frames = _children(
        exports, stacks, "frame", name=F.coalesce(F.col("attrs")["name"], F.lit("")),
        address=F.coalesce(F.col("attrs")["addr"], F.lit("")),
    )
    frames = frames.select("doc", "row_no", "ord", "name", "address", F.col("kid_row").alias("src_row"), F.col("kid_idx").alias("src_idx"))
    binaries = _children(exports, frames.select("doc", "row_no", F.col("ord").alias("frame"), "src_row", "src_idx"), "binary", attrs=F.col("attrs"))
    binaries = binaries.groupBy("doc", "row_no", F.col("frame").alias("ord")).agg(F.min_by("attrs", "ord").alias("b"))
    frames = frames.join(binaries, ["doc", "row_no", "ord"], "left")
    frame = F.struct(
        "name", "address", F.col("b")["name"].alias("binary_name"), F.col("b")["path"].alias("binary_path"),
        F.col("b")["UUID"].alias("binary_uuid"),
    )
    # One list per sample, as long as its stack is deep.
    ordered = frames.groupBy("doc", "row_no").agg(F.array_sort(F.collect_list(F.struct("ord", frame.alias("f")))).alias("l"))
    ordered = ordered.select("doc", "row_no", F.transform("l", lambda x: x["f"]).alias("backtrace"))
    rows = rows.join(ordered, ["doc", "row_no"], "left")
    empty = F.array().cast(table_schema("cpu_samples")["backtrace"].dataType)
    return rows.select(
        "trace_id", "row_no", _number("time").alias("time_ns"), "pid", _process_name().alias("process_name"), "tid",
        _thread_name().alias("thread_name"), _words("core").alias("core"), _words("thread_state").alias("state"),
        _number("weight").alias("weight"), F.coalesce("backtrace", empty).alias("backtrace"),
    )


def hangs(exports: Exports) -> DataFrame:
    cells, rows = _wide(exports, ("potential-hangs",), ("start", "duration", "hang-type", "thread", "process"))
    rows = _with_ids(exports, cells, rows, ("process", "pid", "pid"), ("thread", "tid", "tid"))
    return rows.select(
        "trace_id", "row_no", _number("start").alias("start_ns"), _number("duration").alias("duration_ns"),
        _words("hang_type").alias("hang_type"), "pid", _process_name().alias("process_name"), "tid",
        _thread_name().alias("thread_name"),
    )


def signpost_events(exports: Exports) -> DataFrame:
    names = ("time", "thread", "process", "event-type", "scope", "identifier", "name", "subsystem", "category", "message")
    cells, rows = _wide(exports, ("os-signpost",), names)
    rows = _with_ids(exports, cells, rows, ("process", "pid", "pid"), ("thread", "tid", "tid"))
    return rows.select(
        "trace_id", "row_no", _number("time").alias("time_ns"),
        *[_words(c).alias(c) for c in ("event_type", "name", "subsystem", "category", "message")],
        F.col("scope.value").alias("scope"), _words("identifier").alias("identifier"), "pid",
        _process_name().alias("process_name"), "tid",
    )


def signpost_intervals(exports: Exports) -> DataFrame:
    names = ("start", "duration", "name", "category", "subsystem", "identifier", "process", "start-thread", "end-thread",
             "start-message", "end-message")
    cells, rows = _wide(exports, ("os-signpost-interval",), names)
    ids = (("process", "pid", "pid"), ("start-thread", "tid", "start_tid"), ("end-thread", "tid", "end_tid"))
    rows = _with_ids(exports, cells, rows, *ids)
    return rows.select(
        "trace_id", "row_no", _number("start").alias("start_ns"), _number("duration").alias("duration_ns"),
        *[_words(c).alias(c) for c in ("name", "subsystem", "category", "identifier")], "pid",
        _process_name().alias("process_name"), "start_tid", "end_tid",
        *[_words(c).alias(c) for c in ("start_message", "end_message")],
    )


def gpu_intervals_raw(exports: Exports) -> DataFrame:
    names = ("start", "duration", "process", "event-label", "label", "channel-name", "narr", "name", "shader", "function")
    _, rows = _wide(exports, fixed_values.GPU_SOURCES, names)
    shown = [F.col(f"{c.replace('-', '_')}.value").alias(c.replace("-", "_")) for c in names[3:]]
    return rows.select(
        "trace_id", "row_no", F.col("schema").alias("source_schema"), _number("start").alias("start_ns"),
        _number("duration").alias("duration_ns"), F.col("process.value").alias("process_fmt"), *shown,
    )


# Tables of contents

_TOC = """struct<info:map<string,string>,
  tables:array<map<string,string>>,
  processes:array<struct<pid:bigint,name:string>>>"""
_SUMMARY = ("start-date", "end-date", "duration", "instruments-version", "template-name", "recording-mode", "end-reason")


def _parse_toc(document: str) -> dict:
    root = ET.fromstring(document)
    run = root.find(".//run")
    if run is None:
        raise ValueError("no run in the table of contents")
    info: dict[str, str] = {}
    device, target, summary = run.find(".//device"), run.find(".//target/process"), run.find(".//summary")
    if device is not None:
        info.update({f"device-{k}": v for k, v in device.attrib.items()})
    if target is not None:
        info.update({f"target-{k}": v for k, v in target.attrib.items()})
    if summary is not None:
        info.update({k: (summary.findtext(k) or "").strip() for k in _SUMMARY})
    return {
        "info": info,
        "tables": [dict(t.attrib) for t in root.iter("table")],
        "processes": [(int(p.get("pid", "0")), p.get("name", "")) for p in root.iter("process")],
    }


class Contents(NamedTuple):
    info: DataFrame
    tables: DataFrame
    processes: DataFrame


def read_contents(spark: SparkSession, paths: str | list[str], recording: Column | None = None) -> Contents:
    """Read tables of contents: one short document per recording."""
    docs = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), "value")
    trace = recording_of(F.col("doc")) if recording is None else recording
    docs = cut_lineage(docs.select(trace.cast("string").alias("trace_id"), _parsed(_parse_toc, _TOC).alias("t")).select("trace_id", "t.*"))

    def fact(key: str) -> Column:
        return F.coalesce(F.col("info")[key], F.lit(""))

    info = docs.select(
        "trace_id",
        fact("device-name").alias("device_name"),
        fact("device-model").alias("device_model"),
        fact("device-os-version").alias("os_version"),
        fact("device-platform").alias("platform"),
        fact("start-date").alias("start_date"),
        fact("end-date").alias("end_date"),
        F.coalesce(fact("duration").try_cast("double"), F.lit(0.0)).alias("duration_seconds"),
        fact("instruments-version").alias("instruments_version"),
        fact("template-name").alias("template_name"),
        fact("recording-mode").alias("recording_mode"),
        fact("end-reason").alias("end_reason"),
        F.col("info")["target-name"].alias("target_process"),
        F.col("info")["target-pid"].try_cast("bigint").alias("target_pid"),
    )
    tables = docs.select("trace_id", F.posexplode("tables").alias("ord", "attributes"))
    tables = tables.select("trace_id", F.col("ord").cast("bigint"), F.coalesce(F.col("attributes")["schema"], F.lit("")).alias("schema"), "attributes")
    entries = docs.select("trace_id", F.posexplode("processes").alias("ord", "p"))
    return Contents(info, tables, entries.select("trace_id", F.col("ord").cast("bigint"), "p.*"))
