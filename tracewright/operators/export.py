"""Rows of the viewer formats: trace events, track packets, and drawn graph elements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import checks
from tracewright.functions import fixed_values, numeric, text
from tracewright.operators import counters as counter_ops
from tracewright.operators import graph
from tracewright.operators.ordered import index_chunk, scan

GROUPINGS = ("kernel", "cb")
# Process and thread numbers with a meaning, and the bases of track numbers.
BARRIER_PID, BARRIER_SORT, OVERVIEW_TID = -1, 999999, -1
STAGE_IID = 100
PROCESS_BASE, OVERVIEW_BASE, ENCODER_BASE = 1000, 2000, 3000
COUNTER_BASE = 0x67000000
SLOT_NS = 1000

_EVENT = "trace_id, ph, name, cat, pid, tid, ts, dur, s, args".split(", ")


def with_encoder_cb(df: DataFrame, encoders: DataFrame) -> DataFrame:
    """The command buffer of each row's encoder, -1 when the encoder is unknown."""
    owner = encoders.select("trace_id", "encoder_idx", F.col("cb_idx").alias("cb"), F.col("addr").alias("encoder_addr"))
    return df.join(owner, ["trace_id", "encoder_idx"], "left").withColumn("cb", F.coalesce("cb", F.lit(-1)))


def _with_cb_addr(df: DataFrame, command_buffers: DataFrame) -> DataFrame:
    named = command_buffers.select("trace_id", F.col("cb_idx").alias("cb"), F.col("addr").alias("cb_addr"))
    return df.join(named, ["trace_id", "cb"], "left")


def with_clock(events: DataFrame, times: DataFrame | None) -> DataFrame:
    """Begin and duration: measured where known, else one slot of 1000 ns per call index."""
    if times is None:
        events = events.withColumns({c: F.lit(None).cast("bigint") for c in ("ts_begin_ns", "ts_end_ns")})
    else:
        events = events.join(times.select("trace_id", "func_idx", "ts_begin_ns", "ts_end_ns"), ["trace_id", "func_idx"], "left")
    return events.withColumns(
        {
            "at_ns": F.coalesce("ts_begin_ns", F.col("func_idx") * SLOT_NS),
            "length_ns": F.coalesce(F.col("ts_end_ns") - F.col("ts_begin_ns"), F.lit(SLOT_NS)),
        }
    )


def _events(
    dispatches: DataFrame, barriers: DataFrame, encoders: DataFrame, command_buffers: DataFrame, times: DataFrame | None
) -> DataFrame:
    """Dispatches and barriers in one frame with their clock and owners."""
    walls = barriers.select(
        "trace_id", "func_idx", "encoder_idx", "scope", F.lit("barrier").alias("type"), F.lit(None).cast("string").alias("kernel")
    )
    nodes = dispatches.drop("cb_idx").withColumn("type", F.lit("dispatch"))
    both = nodes.unionByName(walls, allowMissingColumns=True)
    return _with_cb_addr(with_encoder_cb(with_clock(both, times), encoders), command_buffers)


def _first_seen(dispatches: DataFrame) -> DataFrame:
    """Kernels numbered from 0 in the order of their first dispatch."""
    firsts = dispatches.groupBy("trace_id", "kernel").agg(F.min("func_idx").alias("first_idx"))
    order = Window.partitionBy("trace_id").orderBy("first_idx")
    return firsts.withColumn("kernel_no", F.row_number().over(order) - 1)


def _us(ns: Column) -> Column:
    return ns.cast("double") / F.lit(1000.0)


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _event(rows: DataFrame, ph: str, **values: Column) -> DataFrame:
    types = dict(name="string", cat="string", pid="bigint", tid="bigint", ts="double", dur="double", s="string", args="string")
    shown = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    return rows.select("trace_id", F.lit(ph).alias("ph"), *shown)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _dispatch_args(**more: Column) -> Column:
    return _json(
        func_idx=F.col("func_idx"),
        threadgroups=text.size_text(F.col("threadgroups")),
        threads_per_threadgroup=text.size_text(F.col("threads_per_tg")),
        buffers_bound=F.when(F.col("buffers") > 0, F.col("buffers")),
        dispatch_type=F.when(F.col("dispatch_type") != "", F.col("dispatch_type")),
        **more,
    )


def trace_events(
    dispatches: DataFrame,
    barriers: DataFrame,
    encoders: DataFrame,
    command_buffers: DataFrame,
    times: DataFrame | None = None,
    group_by: str = "kernel",
) -> DataFrame:
    """Trace-event rows, one track per kernel or per command buffer and encoder.

    ``dispatches`` carry ``buffers`` (number bound) and ``dispatch_type`` beside the canonical columns.
    """
    checks.choice("group_by", group_by, GROUPINGS)
    events = _events(dispatches, barriers, encoders, command_buffers, times)
    return _by_kernel(events, dispatches) if group_by == "kernel" else _by_buffer(events)


def _by_kernel(events: DataFrame, dispatches: DataFrame) -> DataFrame:
    kernels = _first_seen(dispatches)
    at, length = _us(F.col("at_ns")), _us(F.col("length_ns"))
    runs = events.filter("type = 'dispatch'").join(kernels.drop("first_idx"), ["trace_id", "kernel"])
    args = _dispatch_args(cb=F.col("cb"), cb_addr=F.col("cb_addr"), encoder=F.col("encoder_idx"))
    walls = events.filter("type = 'barrier'")
    wall_args = _json(scope=F.col("scope"), encoder=F.col("encoder_idx"), cb=F.col("cb"))
    walled = walls.select("trace_id").distinct()
    zero, pid = F.lit(0), F.col("kernel_no")
    return _union(
        [
            _event(runs, "X", name=F.col("kernel"), cat=F.lit("dispatch"), pid=pid, tid=zero, ts=at, dur=length, args=args),
            _event(
                walls, "i", name=F.concat(F.lit("barrier ("), "scope", F.lit(")")), cat=F.lit("barrier"),
                pid=F.lit(BARRIER_PID), tid=zero, ts=at, s=F.lit("t"), args=wall_args,
            ),
            _event(kernels, "M", name=F.lit("process_name"), pid=pid, tid=zero, args=_json(name=F.col("kernel"))),
            _event(
                kernels, "M", name=F.lit("process_sort_index"), pid=pid, tid=zero, args=_json(sort_index=F.col("first_idx"))
            ),
            _event(
                walled, "M", name=F.lit("process_name"), pid=F.lit(BARRIER_PID), tid=zero, args=_json(name=F.lit("Barriers"))
            ),
            _event(
                walled, "M", name=F.lit("process_sort_index"), pid=F.lit(BARRIER_PID), tid=zero,
                args=_json(sort_index=F.lit(BARRIER_SORT)),
            ),
        ]
    )


def _spans(events: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """Begin and end of a group: measured times where the group has any, else the call index range."""
    return events.groupBy("trace_id", *keys).agg(
        F.coalesce(F.min("ts_begin_ns"), F.min("func_idx") * SLOT_NS).alias("begin_ns"),
        F.coalesce(F.max("ts_end_ns"), (F.max("func_idx") + 1) * SLOT_NS).alias("end_ns"),
        *[F.max(c).alias(c) for c in carried],
    )


def _titled(title: str, number: str, addr: str) -> Column:
    suffix = F.when(F.col(addr) != "", F.concat(F.lit(" ("), addr, F.lit(")")))
    return F.concat(F.lit(title), F.col(number).cast("string"), F.coalesce(suffix, F.lit("")))


def _by_buffer(events: DataFrame) -> DataFrame:
    at = _us(F.col("at_ns"))
    pid, tid = F.col("cb"), F.col("encoder_idx")
    encoder_spans = _spans(events, ["encoder_idx"], "cb", "encoder_addr")
    buffer_spans = _spans(events, ["cb"], "cb_addr")
    encoder_name = _titled("Encoder #", "encoder_idx", "encoder_addr")
    buffer_name = _titled("CB #", "cb", "cb_addr")
    overview = F.lit(OVERVIEW_TID)
    parts = [
        _event(
            events.filter("type = 'dispatch'"), "X", name=F.col("kernel"), cat=F.lit("dispatch"), pid=pid, tid=tid, ts=at,
            dur=_us(F.col("length_ns")), args=_dispatch_args(),
        ),
        _event(
            events.filter("type = 'barrier'"), "i", name=F.concat(F.lit("barrier ("), "scope", F.lit(")")),
            cat=F.lit("barrier"), pid=pid, tid=tid, ts=at, s=F.lit("t"), args=_json(scope=F.col("scope")),
        ),
        _event(buffer_spans, "M", name=F.lit("process_name"), pid=pid, tid=F.lit(0), args=_json(name=buffer_name)),
        _event(buffer_spans, "M", name=F.lit("thread_name"), pid=pid, tid=overview, args=_json(name=F.lit("CB Overview"))),
        _event(encoder_spans, "M", name=F.lit("thread_name"), pid=pid, tid=tid, args=_json(name=encoder_name)),
    ]
    for ph, when in (("B", "begin_ns"), ("E", "end_ns")):
        ts = _us(F.col(when))
        parts.append(_event(encoder_spans, ph, name=encoder_name, cat=F.lit("encoder"), pid=pid, tid=tid, ts=ts))
        parts.append(_event(buffer_spans, ph, name=buffer_name, cat=F.lit("command_buffer"), pid=pid, tid=overview, ts=ts))
    return _union(parts)


_PACKET = dict(
    ts="bigint", uuid="bigint", parent_uuid="bigint", name="string", iid="int", duration="bigint", event_id="bigint",
    submission_id="bigint", handle="bigint", rank="int", unit="string", value="double", extra="string",
)


def _packet(rows: DataFrame, kind: str, **values: Column) -> DataFrame:
    shown = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _PACKET.items()]
    return rows.select("trace_id", F.lit(kind).alias("kind"), *shown)


def synthetic_lengths(dispatches: DataFrame) -> DataFrame:
    """Length of each dispatch without measured times: up to the next dispatch, one slot for the last."""
    ahead = scan(
        dispatches, ["trace_id"], "func_idx", index_chunk("func_idx"), next_after={"_next": F.col("func_idx")}
    )
    slots = F.coalesce(F.col("_next") - F.col("func_idx"), F.lit(1))
    return ahead.withColumn("slot_ns", slots * SLOT_NS).drop("_next")


def track_packets(
    dispatches: DataFrame,
    barriers: DataFrame,
    encoders: DataFrame,
    command_buffers: DataFrame,
    times: DataFrame | None = None,
    group_by: str = "kernel",
    counters: DataFrame | None = None,
) -> DataFrame:
    """Track packets as rows: stage events per kernel, or slices per encoder; counter tracks on request."""
    checks.choice("group_by", group_by, GROUPINGS)
    if times is None:
        dispatches = synthetic_lengths(dispatches)
    else:
        dispatches = dispatches.withColumn("slot_ns", F.lit(SLOT_NS))
    events = _events(dispatches, barriers, encoders, command_buffers, times)
    length = F.coalesce(F.col("ts_end_ns") - F.col("ts_begin_ns"), F.col("slot_ns"))
    events = events.withColumn("length_ns", length)
    packets = _stage_packets(events, dispatches) if group_by == "kernel" else _slice_packets(events)
    return packets if counters is None else packets.unionByName(counter_packets(counters))


def _stage_packets(events: DataFrame, dispatches: DataFrame) -> DataFrame:
    kernels = _first_seen(dispatches)
    iid = F.col("kernel_no") + 1
    stage = kernels.select("trace_id").distinct()
    runs = events.filter("type = 'dispatch'").join(kernels.drop("first_idx"), ["trace_id", "kernel"])
    digits = F.regexp_replace(F.coalesce("cb_addr", F.lit("0x0")), "^0x", "")
    extra = _json(
        threadgroups=text.size_text(F.col("threadgroups")),
        threads_per_threadgroup=text.size_text(F.col("threads_per_tg")),
        buffers_bound=F.when(F.col("buffers") > 0, F.col("buffers").cast("string")),
        dispatch_type=F.when(F.col("dispatch_type") != "", F.col("dispatch_type")),
        encoder=F.col("encoder_idx").cast("string"),
        cb=F.col("cb").cast("string"),
    )
    return _union(
        [
            _packet(kernels, "specification", ts=F.lit(0), iid=iid, name=F.col("kernel")),
            _packet(stage, "specification", ts=F.lit(0), iid=F.lit(STAGE_IID), name=F.lit("Compute Dispatch")),
            _packet(
                runs, "stage_event", ts=F.col("at_ns"), iid=iid, duration=F.col("length_ns"), event_id=F.col("dispatch_id"),
                submission_id=F.col("cb"), handle=F.conv(digits, 16, -10), name=F.col("kernel"), extra=extra,
            ),
        ]
    )


def _slice_packets(events: DataFrame) -> DataFrame:
    encoder_spans = _spans(events, ["encoder_idx"], "cb", "encoder_addr")
    buffer_spans = _spans(events, ["cb"], "cb_addr")
    encoder_name = _titled("Encoder #", "encoder_idx", "encoder_addr")
    buffer_name = _titled("CB #", "cb", "cb_addr")
    process, overview = F.col("cb") + PROCESS_BASE, F.col("cb") + OVERVIEW_BASE
    track = F.col("encoder_idx") + ENCODER_BASE
    runs = events.filter("type = 'dispatch'")
    parts = [
        _packet(buffer_spans, "track", uuid=process, name=buffer_name),
        _packet(buffer_spans, "track", uuid=overview, parent_uuid=process, name=F.lit("CB Overview")),
        _packet(encoder_spans, "track", uuid=track, parent_uuid=process, name=encoder_name),
        _packet(runs, "slice_begin", ts=F.col("at_ns"), uuid=track, name=F.col("kernel"), extra=_dispatch_args()),
        _packet(runs, "slice_end", ts=F.col("at_ns") + F.col("length_ns"), uuid=track),
        _packet(
            events.filter("type = 'barrier'"), "instant", ts=F.col("at_ns"), uuid=track,
            name=F.concat(F.lit("barrier ("), "scope", F.lit(")")), extra=_json(scope=F.col("scope")),
        ),
        _packet(encoder_spans, "slice_begin", ts=F.col("begin_ns"), uuid=track, name=encoder_name),
        _packet(encoder_spans, "slice_end", ts=F.col("end_ns"), uuid=track),
        _packet(buffer_spans, "slice_begin", ts=F.col("begin_ns"), uuid=overview, name=buffer_name),
        _packet(buffer_spans, "slice_end", ts=F.col("end_ns"), uuid=overview),
    ]
    return _union(parts)


def counter_packets(counters: DataFrame) -> DataFrame:
    """Counter tracks under category tracks under one root, and a packet per sample of counters with any value."""
    kept = counter_ops.nonzero_counters(counters)
    named = counter_ops.display_order(kept.select("trace_id", "counter").distinct())
    # Category and counter tracks are numbered together, each category before its counters.
    order = Window.partitionBy("trace_id").orderBy("cat_rank", "idx", "counter")
    inside = Window.partitionBy("trace_id", "category").orderBy("idx", "counter")
    named = (
        named.withColumn("_row", F.row_number().over(order))
        .withColumn("_group", F.dense_rank().over(Window.partitionBy("trace_id").orderBy("cat_rank")))
        .withColumn("rank", F.row_number().over(inside) - 1)
        .withColumn("uuid", F.col("_row") + F.col("_group") - 1 + F.lit(COUNTER_BASE))
        .withColumn("group_uuid", F.col("uuid") - F.col("rank") - 1)
    )
    root = named.select("trace_id").distinct()
    groups = named.filter("rank = 0")
    unit = F.when(F.col("unit") != "", F.col("unit"))
    values = kept.join(named.select("trace_id", "counter", "uuid"), ["trace_id", "counter"])
    zero = F.lit(0)
    return _union(
        [
            _packet(root, "track", ts=zero, uuid=F.lit(COUNTER_BASE - 1), name=F.lit("GPU Counters")),
            _packet(
                groups, "track", ts=zero, uuid=F.col("group_uuid"), parent_uuid=F.lit(COUNTER_BASE - 1), name=F.col("category"),
                rank=F.col("_group") - 1,
            ),
            _packet(
                named, "track", ts=zero, uuid=F.col("uuid"), parent_uuid=F.col("group_uuid"), name=F.col("counter"),
                rank=F.col("rank"), unit=unit,
            ),
            _packet(values, "counter", ts=F.col("ts_ns"), uuid=F.col("uuid"), value=F.col("value")),
        ]
    )


_ELEMENT = dict(
    id="string", label="string", type="string", parent="string", source="string", target="string", color="string",
    width="double", dashed="boolean", count="bigint",
)


def _element(rows: DataFrame, **values: Column) -> DataFrame:
    return rows.select("trace_id", *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _ELEMENT.items()])


def _tagged(tag: str, number: str) -> Column:
    return F.concat(F.lit(tag), F.col(number).cast("string"))


def graph_elements(
    dispatches: DataFrame,
    edges: DataFrame,
    barriers: DataFrame,
    bindings: DataFrame | None = None,
    scale: str = "dispatch",
) -> DataFrame:
    """Clusters, nodes and edges of a drawn graph; rolled-up nodes are wider the more dispatches they hold."""
    if scale == "dispatch":
        return _dispatch_elements(dispatches, edges, barriers, bindings)
    return _group_elements(graph.rollup_graph(dispatches, edges, barriers, scale), scale)


def _dispatch_elements(
    dispatches: DataFrame, edges: DataFrame, barriers: DataFrame, bindings: DataFrame | None
) -> DataFrame:
    if bindings is None:
        nodes = dispatches.withColumn("bufs", F.lit(0))
    else:
        bound = bindings.groupBy("trace_id", "dispatch_id").agg(F.count(F.lit(1)).alias("bufs"))
        nodes = dispatches.join(bound, ["trace_id", "dispatch_id"], "left")
        nodes = nodes.withColumn("bufs", F.coalesce("bufs", F.lit(0)))
    size = F.coalesce(F.concat(F.lit("\ntg="), text.size_text(F.col("threadgroups"))), F.lit(""))
    label = F.concat(
        F.lit("D"), F.col("dispatch_id").cast("string"), F.lit(": "), text.shorten(F.col("kernel"), 40), size,
        F.lit("\nbufs="), F.col("bufs").cast("string"),
    )
    parent = F.when(F.col("cb_idx") >= 0, _tagged("cb_group_", "cb_idx"))
    clusters = dispatches.filter("cb_idx >= 0").select("trace_id", "cb_idx").distinct()
    walls = barriers.filter("after_dispatch_id >= 0")
    is_wall = F.col("buffer_addr") == 0
    colors = F.create_map(*[F.lit(x) for pair in fixed_values.EDGE_COLORS.items() for x in pair])
    red = F.lit(fixed_values.BARRIER_COLOR)
    # The first dispatch behind each barrier in its encoder.
    marks = dispatches.select(
        "trace_id", "encoder_idx", (F.col("dispatch_id") * 2).alias("pos"), F.col("dispatch_id").alias("node"),
        F.lit(None).cast("bigint").alias("barrier_id"),
    ).unionByName(
        walls.select(
            "trace_id", "encoder_idx", (F.col("after_dispatch_id") * 2 + 1).alias("pos"), F.lit(None).cast("bigint").alias("node"),
            "barrier_id",
        )
    )
    placed = scan(
        marks, ["trace_id", "encoder_idx"], "pos", index_chunk(F.expr("pos div 2")), next_after={"behind": F.col("node")}
    )
    placed = placed.filter("barrier_id is not null and behind is not null").withColumn("before", F.expr("pos div 2"))
    dashed, thin, none = F.lit(True), F.lit(1.5), F.lit("")
    return _union(
        [
            _element(clusters, id=_tagged("cb_group_", "cb_idx"), label=_tagged("Command Buffer #", "cb_idx"), type=F.lit("cluster")),
            _element(nodes, id=_tagged("D", "dispatch_id"), label=label, type=F.lit("dispatch"), parent=parent, count=F.col("bufs")),
            _element(
                walls, id=_tagged("barrier", "barrier_id"), label=F.when(F.col("scope") == "buffers", "B").otherwise("R"),
                type=F.lit("barrier"), parent=parent,
            ),
            _element(
                edges, id=F.concat_ws("_", F.lit("e"), "src", "tgt"), source=_tagged("D", "src"), target=_tagged("D", "tgt"),
                label=F.when(is_wall, "barrier").otherwise(F.col("dep_type")),
                color=F.when(is_wall, red).otherwise(colors[F.col("dep_type")]),
                width=F.when(is_wall, 2.0).otherwise(1.5), dashed=is_wall,
            ),
            _element(
                placed, id=_tagged("be_pre_", "barrier_id"), source=_tagged("D", "before"), target=_tagged("barrier", "barrier_id"),
                label=none, color=red, width=thin, dashed=dashed,
            ),
            _element(
                placed, id=_tagged("be_post_", "barrier_id"), source=_tagged("barrier", "barrier_id"), target=_tagged("D", "behind"),
                label=none, color=red, width=thin, dashed=dashed,
            ),
        ]
    )


def _group_elements(rolled: graph.RolledUp, scale: str) -> DataFrame:
    nodes = graph.node_labels(rolled.nodes, scale)
    nodes = nodes.join(nodes.groupBy("trace_id").agg(F.max("dispatch_count").alias("largest")), "trace_id")
    group = {"cb": "cb_idx", "encoder": "encoder_idx", "kernel": "kernel"}[scale]
    names = nodes.select("trace_id", group, "node_id")
    edges = rolled.edges
    for side in ("src", "tgt"):
        named = names.select("trace_id", F.col(group).alias(f"{side}_{group}"), F.col("node_id").alias(f"{side}_id"))
        edges = edges.join(named, ["trace_id", f"{side}_{group}"])
    parts = []
    parent = F.lit(None)
    if scale == "encoder":
        parent = F.when(F.col("cb_idx") >= 0, _tagged("cluster_CB_", "cb_idx"))
        clusters = nodes.filter("cb_idx >= 0").select("trace_id", "cb_idx").distinct()
        parts.append(
            _element(clusters, id=_tagged("cluster_CB_", "cb_idx"), label=_tagged("CB #", "cb_idx"), type=F.lit("cluster"))
        )
    parts.append(
        _element(
            nodes, id=F.col("node_id"), label=F.col("label"), type=F.lit("aggregated"), parent=parent, count=F.col("dispatch_count"),
            width=numeric.node_width(F.col("dispatch_count"), F.col("largest")),
        )
    )
    parts.append(
        _element(
            edges, id=F.concat_ws("_", F.lit("e"), "src_id", "tgt_id"), source=F.col("src_id"), target=F.col("tgt_id"),
            label=F.col("weight").cast("string"), color=F.lit(fixed_values.GROUP_EDGE_COLOR),
            width=numeric.edge_width(F.col("weight")), dashed=F.lit(False), count=F.col("buffers"),
        )
    )
    return _union(parts)
