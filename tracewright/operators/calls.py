"""From an ordered call log to dispatches: bound kernels, buffer bindings, encoders and command buffers.

The log is cut into chunks of the call index, so a recording of any length is spread over many tasks. Rules that look
at names or addresses run as latest-definition lookups keyed by (recording, address).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import checks
from tracewright.functions import fixed_values, text
from tracewright.operators.ordered import index_chunk, number_rows, scan
from tracewright.session import cut_lineage

# Call ids that carry state.
MAKE_FUNCTION, MAKE_PIPELINE = -16290, -16299
SET_PIPELINE, SET_BYTES, SET_BUFFER = -16338, -16337, -16336
QUEUE_BUFFER, START_ENCODER, COMMIT = -16352, -16355, -16363
END_ENCODER = (-16325, -16370)
DISPATCH_GROUPS, DISPATCH_THREADS = -16327, -16078
BARRIER_BUFFERS, BARRIER_RESOURCES = -16009, -16008
POINTER_FLOOR = 0xFFFF

_KEY = ["trace_id"]


class CallState(NamedTuple):
    events: DataFrame
    bindings: DataFrame
    encoders: DataFrame
    command_buffers: DataFrame


def known_calls(calls: DataFrame) -> DataFrame:
    """Calls in the dictionary; others are dropped but keep their place in the index."""
    return calls.filter(F.col("call_id").isin(*fixed_values.CALL_IDS))


def unknown_calls(calls: DataFrame) -> DataFrame:
    """Call ids that the dictionary does not hold, with their number of calls per recording."""
    unknown = calls.filter(~F.col("call_id").isin(*fixed_values.CALL_IDS))
    return unknown.groupBy("trace_id", "call_id").agg(F.count(F.lit(1)).alias("calls"))


def _is(*ids: int) -> Column:
    return F.col("call_id").isin(*ids)


def _latest_name(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """For every use (trace_id, addr, func_idx, pos) the name its address was given last before it."""
    both = uses.select("trace_id", "addr", "func_idx", "pos", F.lit(None).cast("string").alias("name"), F.lit(True).alias("use"))
    both = both.unionByName(
        definitions.select("trace_id", "addr", "func_idx", F.lit(-1).alias("pos"), "name", F.lit(False).alias("use"))
    )
    found = scan(
        both, ["trace_id", "addr"], "func_idx", index_chunk("func_idx"), last_before={"found": F.col("name")}
    )
    return found.filter("use").select("trace_id", "addr", "func_idx", "pos", "found")


def _first_hit(looked_up: DataFrame, hit: Column) -> DataFrame:
    """The first address of each call that leads to a name."""
    hits = looked_up.withColumn("hit", hit).filter("hit is not null")
    return hits.groupBy("trace_id", "func_idx").agg(
        F.min_by("hit", "pos").alias("kernel"), F.min_by("addr", "pos").alias("pipeline_addr")
    )


def pipelines(calls: DataFrame) -> DataFrame:
    """Pipelines made in the recording, named after the kernel function they were made from."""
    functions = calls.filter(_is(MAKE_FUNCTION)).select(
        "trace_id",
        "func_idx",
        text.returned_address(F.col("arg_text")).alias("addr"),
        text.first_quoted(F.col("arg_text")).alias("name"),
    )
    functions = functions.filter("addr is not null and name is not null")
    made = calls.filter(_is(MAKE_PIPELINE)).withColumn("made", text.returned_address(F.col("arg_text")))
    made = made.filter("made is not null")
    arguments = text.hex_addresses(text.call_arguments(F.col("arg_text")))
    uses = made.select("trace_id", "func_idx", F.posexplode(arguments).alias("pos", "addr"))
    named = _first_hit(_latest_name(uses, functions), F.col("found")).drop("pipeline_addr")
    out = made.join(named, ["trace_id", "func_idx"], "left")
    fallback = F.concat(F.lit("pipeline_"), text.hex_text(F.col("made")))
    return out.select("trace_id", "func_idx", F.col("made").alias("addr"), F.coalesce("kernel", fallback).alias("name"))


def pipeline_sets(calls: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """Calls that bind a kernel: by address in a byte argument, or by the explicit call after a creation."""
    made = cut_lineage(pipelines(calls))
    byte_calls = calls.filter(_is(SET_BYTES))
    uses = byte_calls.select(
        "trace_id", "func_idx", F.posexplode(text.hex_addresses(F.col("arg_text"))).alias("pos", "addr")
    )
    placeholder = F.when(
        F.col("addr") > POINTER_FLOOR, F.concat(F.lit("Compute Pipeline "), text.hex_text(F.col("addr")))
    )
    by_address = _first_hit(_latest_name(uses, made), F.coalesce("found", placeholder))

    explicit = calls.filter(_is(SET_PIPELINE)).select("trace_id", "func_idx", F.lit(None).cast("string").alias("name"))
    marks = explicit.unionByName(made.select("trace_id", "func_idx", "name"))
    is_set = F.col("name").isNull()
    creation = F.when(~is_set, F.struct("func_idx", "name"))
    seen = scan(
        marks,
        _KEY,
        "func_idx",
        index_chunk("func_idx"),
        last_before={"made": creation, "used": F.when(is_set, F.col("func_idx"))},
    )
    fresh = is_set & (F.col("made.func_idx") > F.coalesce("used", F.lit(-1)))
    by_order = seen.filter(fresh).select(
        "trace_id", "func_idx", F.col("made.name").alias("kernel"), F.lit(None).cast("bigint").alias("pipeline_addr")
    )
    sets = by_address.unionByName(by_order)
    return sets if resources is None else resolve_names(sets, resources)


def resolve_names(named: DataFrame, resources: DataFrame) -> DataFrame:
    """Replace placeholder kernel names by the names stored beside the recording; others stay.

    Of several names of one address the last counts: by ``ord`` where the resources have it, else by the alphabet.
    """
    last = F.max_by("name", "ord") if "ord" in resources.columns else F.max("name")
    lookup = resources.groupBy("trace_id", "addr").agg(last.alias("_resolved")).select(
        "trace_id", F.concat(F.lit("Compute Pipeline "), text.hex_text(F.col("addr"))).alias("kernel"), "_resolved"
    )
    out = named.join(lookup, ["trace_id", "kernel"], "left")
    return out.withColumn("kernel", F.coalesce("_resolved", "kernel")).drop("_resolved").select(*named.columns)


def _track(calls: DataFrame, sets: DataFrame) -> DataFrame:
    """State-carrying calls with what came before them; written once because several steps read it."""
    dispatch = _is(DISPATCH_GROUPS, DISPATCH_THREADS)
    start, close = _is(START_ENCODER), _is(*END_ENCODER, COMMIT)
    wanted = _is(
        DISPATCH_GROUPS, DISPATCH_THREADS, START_ENCODER, *END_ENCODER, COMMIT, QUEUE_BUFFER, BARRIER_BUFFERS,
        BARRIER_RESOURCES, SET_BUFFER, SET_BYTES, SET_PIPELINE,
    )
    rows = calls.filter(wanted).join(sets, ["trace_id", "func_idx"], "left")
    at = F.col("func_idx")
    touch = F.when(_is(QUEUE_BUFFER, START_ENCODER) & (F.col("obj_addr") != 0), F.col("obj_addr"))
    returned = F.when(_is(QUEUE_BUFFER), text.returned_address(F.col("arg_text")))
    rows = rows.withColumn("_chunk", index_chunk("func_idx")).withColumn("touch", touch).withColumn("ret_addr", returned)
    tracked = scan(
        rows,
        _KEY,
        "func_idx",
        last_before={
            "pd": F.when(dispatch, at),
            "ps": F.when(start, at),
            "px": F.when(close, at),
            "bound": F.col("kernel"),
            "cur_addr": F.col("touch"),
            "enc_made": F.when(F.col("ret_addr").isNotNull(), F.struct(at.alias("at"), F.col("ret_addr").alias("addr"))),
        },
        sums_before={
            "resets": F.when(dispatch | start, 1).otherwise(0),
            "seg": F.when(F.col("touch").isNotNull(), 1).otherwise(0),
        },
        next_after={"next_close": F.when(start | close, at)},
    )
    no_encoder = F.col("pd").isNull() & F.col("ps").isNull()
    left_off = (
        F.col("pd").isNotNull()
        & (F.coalesce("ps", F.lit(-1)) < F.col("pd"))
        & (F.coalesce("px", F.lit(-1)) > F.col("pd"))
    )
    return cut_lineage(tracked.withColumn("closed", no_encoder | left_off))


def _assign_encoders(tracked: DataFrame) -> DataFrame:
    """Starts count up; a dispatch or barrier belongs to the open encoder; a dispatch without one opens one."""
    dispatch = _is(DISPATCH_GROUPS, DISPATCH_THREADS)
    opened = F.when(_is(START_ENCODER) | (dispatch & F.col("closed")), 1).otherwise(0)
    numbered = scan(tracked, _KEY, "func_idx", sums={"opened": opened})
    index = F.when(~dispatch & F.col("closed"), F.lit(-1)).otherwise(F.col("opened") - 1)
    return numbered.withColumn("encoder_idx", index.cast("bigint")).drop("opened")


def _fallback_commits(tracked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Touches and commits with what each one closes.

    A commit names a command buffer or, without an address, means the current one. When the named one is not open, the
    current one is closed instead. Whether a buffer is open may itself depend on such a replacement in the segment of
    its last touch, so the closed segments are followed along such replacements.
    """
    control = tracked.filter(F.col("touch").isNotNull() | _is(COMMIT)).select(
        "trace_id", "func_idx", "_chunk", "touch", "cur_addr",
        F.col("seg").alias("seg"), F.when(_is(COMMIT) & (F.col("obj_addr") != 0), F.col("obj_addr")).alias("named"),
    )
    is_commit = F.col("touch").isNull()
    closes_current = is_commit & (F.col("named").isNull() | (F.col("named") == F.col("cur_addr")))
    # The current buffer is forgotten by the first commit in its segment that means it.
    resets = scan(
        control, _KEY, "func_idx", last_before={"reset_seg": F.when(closes_current, F.col("seg"))}
    ).drop("_chunk")
    live = F.col("cur_addr").isNotNull() & (F.coalesce("reset_seg", F.lit(-1)) != F.col("seg"))
    keyed = resets.withColumn("live", live).withColumn(
        "addr", F.coalesce("touch", "named", F.when(F.col("live"), F.col("cur_addr")))
    )
    keyed = keyed.filter("addr is not null")
    # A touch opens the segment after itself.
    opened = F.when(F.col("touch").isNotNull(), F.struct("func_idx", (F.col("seg") + 1).alias("seg")))
    history = scan(
        keyed,
        ["trace_id", "addr"],
        "func_idx",
        index_chunk("func_idx"),
        last_before={"last_touch": opened, "last_commit": F.when(F.col("touch").isNull(), F.col("func_idx"))},
    )
    gone = F.col("last_touch").isNull() | (F.coalesce("last_commit", F.lit(-1)) > F.col("last_touch.func_idx"))
    history = history.withColumn("gone", gone).withColumn(
        "fallback", F.col("touch").isNull() & F.col("live") & (F.col("addr") != F.col("cur_addr"))
    )
    history = cut_lineage(history)
    fallbacks = history.filter("fallback")
    dead = fallbacks.filter("gone").select("trace_id", "seg").distinct()
    edges = fallbacks.filter("not gone").select(
        "trace_id", F.col("last_touch.seg").alias("from_seg"), F.col("seg").alias("to_seg")
    )
    return history, _reached(dead, edges)


def _reached(dead: DataFrame, edges: DataFrame) -> DataFrame:
    """Segments that a dead one leads to, over any number of edges, the dead ones included.

    A touch is closed by one commit only, so every segment has one edge at most and jumps can be doubled: after k rounds
    a jump spans 2^k edges and all segments within 2^k edges are marked. Rounds grow with the logarithm of the longest chain.
    """
    dead, jumps = cut_lineage(dead), cut_lineage(edges)
    while not dead.isEmpty() and not jumps.isEmpty():
        step = dead.withColumnRenamed("seg", "from_seg").join(jumps, ["trace_id", "from_seg"])
        dead = cut_lineage(dead.unionByName(step.select("trace_id", F.col("to_seg").alias("seg"))).distinct())
        onward = jumps.select("trace_id", F.col("from_seg").alias("to_seg"), F.col("to_seg").alias("beyond"))
        jumps = cut_lineage(jumps.join(onward, ["trace_id", "to_seg"]).select("trace_id", "from_seg", F.col("beyond").alias("to_seg")))
    return dead


class _Buffers(NamedTuple):
    segments: DataFrame
    instances: DataFrame
    commits: DataFrame
    inside: DataFrame


def _command_buffers(tracked: DataFrame) -> _Buffers:
    """Command-buffer instances: which touch made them, which commit closed them, which dispatches they hold."""
    history, dead = _fallback_commits(tracked)
    dead = dead.select("trace_id", F.col("seg").alias("touch_seg"), F.lit(True).alias("dead"))
    marked = history.withColumn("touch_seg", F.col("last_touch.seg")).join(dead, ["trace_id", "touch_seg"], "left")
    # A buffer is not open when it was committed or replaced since its last touch.
    marked = cut_lineage(marked.withColumn("shut", F.col("gone") | F.coalesce("dead", F.lit(False))))

    position = index_chunk("func_idx")
    touches = marked.filter("touch is not null").withColumn("is_new", F.col("shut").cast("int"))
    made = cut_lineage(scan(touches, _KEY, "func_idx", position, sums={"made": F.col("is_new")}))
    fresh = F.when(F.col("is_new") == 1, F.col("made"))
    owned = scan(made, ["trace_id", "addr"], "func_idx", position, last={"instance": fresh})
    # The first commit of a segment that closes its buffer: one that means it, or a replacement.
    closing = marked.filter("touch is null and live and ((fallback and shut) or addr = cur_addr)")
    first_close = closing.groupBy("trace_id", "seg").agg(F.min("func_idx").alias("closed_at"))
    opened = owned.select("trace_id", (F.col("seg") + 1).alias("seg"), "addr", "instance", F.col("func_idx").alias("at"))
    segments = cut_lineage(opened.join(first_close, ["trace_id", "seg"], "left"))

    replaced = F.col("fallback") & F.col("shut")
    commits = marked.filter("touch is null").select(
        "trace_id",
        "func_idx",
        replaced.alias("replaced"),
        F.when(~F.col("shut"), F.col("touch_seg")).when(replaced, F.col("seg")).alias("seg"),
    )
    commits = commits.join(segments, ["trace_id", "seg"])
    commits = commits.filter(~F.col("replaced") | (F.col("func_idx") == F.col("closed_at")))
    commits = cut_lineage(commits.select("trace_id", "func_idx", "instance"))

    inside = tracked.filter(_is(DISPATCH_GROUPS, DISPATCH_THREADS)).select("trace_id", "func_idx", "seg")
    inside = inside.join(segments, ["trace_id", "seg"])
    inside = inside.filter(F.col("closed_at").isNull() | (F.col("func_idx") < F.col("closed_at")))
    inside = inside.select("trace_id", "func_idx", "instance")

    key = ["trace_id", "instance"]
    pops = commits.groupBy(*key).agg(F.min("func_idx").alias("commit_idx"))
    filled = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("num_dispatches"))
    instances = segments.groupBy(*key).agg(F.min("at").alias("made_idx"), F.min("addr").alias("addr"))
    instances = instances.join(pops, key, "left").join(filled, key, "left")
    instances = cut_lineage(instances.withColumn("num_dispatches", F.coalesce("num_dispatches", F.lit(0))))
    return _Buffers(segments, _number_buffers(instances), commits, inside)


def _number_buffers(instances: DataFrame) -> DataFrame:
    """Both numberings: at creation (all made before, less those closed empty) and in the final list."""
    emptied = instances.filter("commit_idx is not null and num_dispatches = 0")
    steps = instances.select("trace_id", F.col("made_idx").alias("func_idx"), "instance", F.lit(1).alias("step"))
    nothing = F.lit(None).cast("bigint").alias("instance")
    drops = emptied.select("trace_id", F.col("commit_idx").alias("func_idx"), nothing, F.lit(-1).alias("step"))
    numbered = scan(
        steps.unionByName(drops),
        _KEY,
        "func_idx",
        index_chunk("func_idx"),
        sums_before={"cb_created_idx": F.col("step").cast("bigint")},
    )
    numbered = numbered.filter("instance is not null").select("trace_id", "instance", "cb_created_idx")
    # Listed in commit order, open ones last in creation order.
    listed = instances.filter("num_dispatches > 0").withColumn(
        "_list", F.coalesce("commit_idx", F.col("made_idx") + F.lit(1 << 60))
    )
    listed = number_rows(listed, _KEY, "_list", "cb_idx", index_chunk("_list"))
    key = ["trace_id", "instance"]
    return cut_lineage(
        instances.join(numbered, key).join(listed.select("trace_id", "instance", "cb_idx"), key, "left")
    )


def call_rows(calls: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """State-carrying calls with bound kernel, encoder number and binding run; stored for the steps behind it."""
    known = known_calls(calls)
    return cut_lineage(_assign_encoders(_track(known, pipeline_sets(known, resources))))


def dispatch_kernels(rows: DataFrame) -> DataFrame:
    """The kernel bound at each dispatch."""
    kernel = F.coalesce("bound", F.lit("unknown")).alias("kernel")
    return rows.filter(_is(DISPATCH_GROUPS, DISPATCH_THREADS)).select("trace_id", "func_idx", kernel)


def read_calls(calls: DataFrame, resources: DataFrame | None = None) -> CallState:
    """Reconstruct events, bindings, encoders and command buffers from an ordered call log."""
    rows = call_rows(calls, resources)
    buffers = _command_buffers(rows)
    instances = buffers.instances
    listed = instances.filter("num_dispatches > 0").select(
        "trace_id",
        "cb_idx",
        "cb_created_idx",
        text.hex_text(F.col("addr")).alias("addr"),
        F.coalesce("commit_idx", F.lit(-1)).alias("func_idx"),
        "num_dispatches",
    )
    return CallState(_events(rows, buffers), fold_bindings(rows), _encoders(rows, buffers), listed)


def _events(rows: DataFrame, buffers: _Buffers) -> DataFrame:
    is_dispatch = _is(DISPATCH_GROUPS, DISPATCH_THREADS)
    sizes = text.size_triples(F.col("arg_text"))
    both = is_dispatch & (F.size(sizes) >= 2)
    kind = (
        F.when(is_dispatch, "dispatch")
        .when(_is(BARRIER_BUFFERS, BARRIER_RESOURCES), "barrier")
        .when(F.col("kernel").isNotNull(), "set_pipeline")
    )
    shown = rows.select(
        "trace_id",
        "func_idx",
        kind.alias("type"),
        F.when(is_dispatch, F.coalesce("bound", F.lit("unknown"))).otherwise(F.col("kernel")).alias("kernel"),
        F.when(F.col("kernel").isNull(), F.col("encoder_idx")).alias("encoder_idx"),
        F.when(_is(BARRIER_BUFFERS), "buffers").when(_is(BARRIER_RESOURCES), "resources").alias("scope"),
        F.when(_is(DISPATCH_GROUPS), "threadgroups").when(_is(DISPATCH_THREADS), "threads").alias("dispatch_type"),
        F.when(both, F.get(sizes, F.lit(0))).alias("threadgroups"),
        F.when(both, F.get(sizes, F.lit(1))).alias("threads_per_tg"),
        "pipeline_addr",
    ).filter("type is not null")
    numbers = buffers.instances.select("trace_id", "instance", "cb_idx", "cb_created_idx")
    owner = buffers.inside.join(numbers, ["trace_id", "instance"]).drop("instance")
    events = shown.join(owner, ["trace_id", "func_idx"], "left")
    for column in ("cb_idx", "cb_created_idx"):
        events = events.withColumn(column, F.when(F.col("type") == "dispatch", F.coalesce(column, F.lit(-1))))
    return events


def fold_bindings(rows: DataFrame) -> DataFrame:
    """Buffers bound since the previous dispatch or encoder start; the last call for a slot wins."""
    sets = rows.filter(_is(SET_BUFFER)).select(
        "trace_id",
        "resets",
        "func_idx",
        text.trailing_index(F.col("arg_text")).alias("buffer_index"),
        F.get(text.hex_addresses(F.col("arg_text")), F.lit(0)).alias("buffer_addr"),
    )
    latest = (
        sets.filter("buffer_addr is not null")
        .groupBy("trace_id", "resets", "buffer_index")
        .agg(F.max_by("buffer_addr", "func_idx").alias("buffer_addr"), F.min("func_idx").alias("ord"))
    )
    # A run of bindings belongs to the dispatch that ends it, if a dispatch does.
    ends = rows.filter(_is(DISPATCH_GROUPS, DISPATCH_THREADS)).select("trace_id", "resets", "func_idx")
    return latest.join(ends, ["trace_id", "resets"]).drop("resets")


def _encoders(rows: DataFrame, buffers: _Buffers) -> DataFrame:
    """Encoders with dispatches, the buffer current when each was closed, and their last known address."""
    dispatch_rows = rows.filter(_is(DISPATCH_GROUPS, DISPATCH_THREADS))
    closed = dispatch_rows.groupBy("trace_id", "encoder_idx").agg(
        F.count(F.lit(1)).alias("num_dispatches"), F.max_by("next_close", "func_idx").alias("func_idx")
    )
    state = rows.select("trace_id", "func_idx", "call_id", F.col("seg").alias("_seg"), F.col("enc_made").alias("_made"))
    made_at = F.when(F.col("ret_addr").isNotNull(), F.col("func_idx"))
    log_end = rows.groupBy("trace_id").agg(
        F.count("touch").alias("_end_seg"),
        F.max(made_at).alias("_end_at"),
        F.max_by("ret_addr", made_at).alias("_end_addr"),
    )
    at_end = F.col("func_idx").isNull()
    joined = closed.join(state, ["trace_id", "func_idx"], "left").join(log_end, "trace_id")
    joined = joined.select(
        "trace_id",
        "encoder_idx",
        "num_dispatches",
        "func_idx",
        "call_id",
        F.when(at_end, F.col("_end_seg")).otherwise(F.col("_seg")).alias("seg"),
        F.when(at_end, F.col("_end_at")).otherwise(F.col("_made.at")).alias("made_at"),
        F.when(at_end, F.col("_end_addr")).otherwise(F.col("_made.addr")).alias("made_addr"),
    )
    # Ending an encoder forgets its address; starting the next one does not.
    forgets = F.when(_is(*END_ENCODER, COMMIT), F.col("func_idx"))
    joined = scan(cut_lineage(joined), _KEY, "encoder_idx", index_chunk("encoder_idx"), last_before={"forgot": forgets})
    segments = buffers.segments.select("trace_id", "seg", F.col("instance").alias("current"), "closed_at")
    joined = joined.join(segments, ["trace_id", "seg"], "left").join(
        buffers.commits.withColumnRenamed("instance", "committed"), ["trace_id", "func_idx"], "left"
    )
    is_open = F.col("closed_at").isNull() | (F.col("func_idx") <= F.col("closed_at"))
    owner = F.when(F.col("call_id") == COMMIT, F.col("committed")).when(is_open, F.col("current"))
    created = buffers.instances.select("trace_id", "instance", "cb_created_idx")
    known = F.col("made_at") > F.coalesce("forgot", F.lit(-1))
    return joined.withColumn("instance", owner).join(created, ["trace_id", "instance"], "left").select(
        "trace_id",
        "encoder_idx",
        F.coalesce("cb_created_idx", F.lit(-1)).alias("cb_created_idx"),
        F.when(known, text.hex_text(F.col("made_addr"))).otherwise(F.lit("")).alias("addr"),
        "num_dispatches",
    )


def number_dispatches(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dispatches and barriers numbered in call order; each barrier knows the last dispatch before it in its encoder.

    Where events carry ``cb_idx``, a barrier takes the command buffer of its encoder, -1 where that has none.
    """
    is_dispatch = F.col("type") == "dispatch"
    rows = events.filter(F.col("type").isin("dispatch", "barrier")).withColumn("_chunk", index_chunk("func_idx"))
    numbered = scan(
        cut_lineage(rows),
        _KEY,
        "func_idx",
        sums_before={"dispatch_id": is_dispatch.cast("bigint"), "barrier_id": (~is_dispatch).cast("bigint")},
    )
    numbered = cut_lineage(numbered)
    dispatches = numbered.filter("type = 'dispatch'").drop("_chunk", "barrier_id", "type", "scope")
    placed = scan(
        numbered,
        ["trace_id", "encoder_idx"],
        "func_idx",
        last_before={"after_dispatch_id": F.when(is_dispatch, F.col("dispatch_id"))},
    )
    walls = placed.filter("type = 'barrier'")
    if "cb_idx" in events.columns:
        named = F.when(F.col("cb_idx").isNotNull(), F.col("func_idx"))
        owners = events.groupBy("trace_id", "encoder_idx").agg(F.min_by("cb_idx", named).alias("cb_idx"))
        walls = walls.drop("cb_idx").join(owners, ["trace_id", "encoder_idx"], "left")
        walls = walls.withColumn("cb_idx", F.coalesce("cb_idx", F.lit(-1)))
    columns = ["trace_id", "barrier_id", "func_idx", "scope", "encoder_idx", *[c for c in walls.columns if c == "cb_idx"]]
    barriers = walls.select(*columns, F.coalesce("after_dispatch_id", F.lit(-1)).alias("after_dispatch_id"))
    return dispatches, barriers


class DispatchTables(NamedTuple):
    """What the dependency graph and the exports read, in their columns."""

    dispatches: DataFrame
    bindings: DataFrame
    barriers: DataFrame
    encoders: DataFrame
    command_buffers: DataFrame


def dispatch_tables(events: DataFrame, bindings: DataFrame, encoders: DataFrame, command_buffers: DataFrame) -> DispatchTables:
    """Numbered tables from a call log or a capture; pass ``*read_calls(..)`` or the capture's tables in this order.

    Bindings get their dispatch's number and, where none is known, the mode UNKNOWN; dispatches the number of their
    buffers. An encoder belongs to the command buffer of its first dispatch, -1 without one, and so do its barriers.
    """
    dispatches, barriers = (cut_lineage(part) for part in number_dispatches(cut_lineage(events)))
    mode = F.coalesce("access_mode", F.lit("UNKNOWN")) if "access_mode" in bindings.columns else F.lit("UNKNOWN")
    numbers = dispatches.select("trace_id", "func_idx", "dispatch_id")
    bound = bindings.join(numbers, ["trace_id", "func_idx"]).select("trace_id", "dispatch_id", "ord", "buffer_index", "buffer_addr", mode.alias("access_mode"))
    bound = cut_lineage(bound)
    counts = bound.groupBy("trace_id", "dispatch_id").agg(F.count(F.lit(1)).alias("buffers"))
    owners = dispatches.groupBy("trace_id", "encoder_idx").agg(F.min_by("cb_idx", "dispatch_id").alias("cb_idx"))
    owned = encoders.drop("cb_idx", "cb_created_idx").join(owners, ["trace_id", "encoder_idx"], "left")
    return DispatchTables(
        dispatches.join(counts, ["trace_id", "dispatch_id"], "left"),
        bound,
        barriers,
        owned.withColumn("cb_idx", F.coalesce("cb_idx", F.lit(-1))),
        command_buffers,
    )


def kernel_summary(events: DataFrame) -> DataFrame:
    """Dispatches per kernel, most frequent first, ties to the kernel seen first."""
    kernel = F.coalesce("kernel", F.lit("unknown")).alias("kernel")
    counts = events.filter("type = 'dispatch'").groupBy("trace_id", kernel).agg(
        F.count(F.lit(1)).alias("dispatches"), F.min("func_idx").alias("first_idx")
    )
    order = Window.partitionBy("trace_id").orderBy(F.col("dispatches").desc(), "first_idx")
    return counts.select("trace_id", F.row_number().over(order).alias("rank"), "kernel", "dispatches")


def gpu_overview(calls: DataFrame, state: CallState) -> DataFrame:
    """Totals of a recording and the average number of dispatches per command buffer."""

    def total(kind: str) -> Column:
        return F.count(F.when(F.col("type") == kind, F.lit(1)))

    per_trace = [
        calls.groupBy("trace_id").agg(F.count(F.lit(1)).alias("total_api_calls")),
        state.events.groupBy("trace_id").agg(
            total("dispatch").alias("num_dispatches"), total("barrier").alias("num_barriers")
        ),
        state.command_buffers.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_command_buffers")),
        state.encoders.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_compute_encoders")),
    ]
    out = per_trace[0]
    for more in per_trace[1:]:
        out = out.join(more, "trace_id", "left")
    out = out.na.fill(0)
    buffers = F.greatest("num_command_buffers", F.lit(1))
    return out.withColumn("avg_dispatches_per_cb", F.col("num_dispatches").cast("double") / buffers.cast("double"))


def counted_groups(groups: DataFrame) -> DataFrame:
    """Command buffers or encoders with ``num_groups``, how many of them their recording has."""
    counts = groups.groupBy("trace_id").agg(F.count(F.lit(1)).alias("num_groups"))
    return groups.join(counts, "trace_id")


def gpu_timeline(
    state: CallState,
    kernel: str | None = None,
    cb: int | None = None,
    encoder: int | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Events in call order. Filters drop dispatches only, but a recording without the asked group is empty.

    Offset and limit count per recording; ``total`` is the number of events before them.
    """
    checks.limit_offset(limit, offset)
    events = state.events
    is_other = F.col("type") != "dispatch"
    for column, value, groups in (("cb_idx", cb, state.command_buffers), ("encoder_idx", encoder, state.encoders)):
        if value is None:
            continue
        checks.in_range(column, value, 0)
        having = groups.filter(F.col(column) == value).select("trace_id").distinct()
        events = events.join(having, "trace_id", "left_semi").filter(is_other | (F.col(column) == value))
    if kernel is not None:
        events = events.filter(is_other | text.matches_glob(F.coalesce("kernel", F.lit("")), kernel))
    if limit is None and not offset:
        return events
    events = cut_lineage(events)
    numbered = number_rows(events, _KEY, "func_idx", "_pos", index_chunk("func_idx"))
    totals = events.groupBy("trace_id").agg(F.count(F.lit(1)).alias("total"))
    kept = numbered.filter(F.col("_pos") >= offset)
    if limit is not None:
        kept = kept.filter(F.col("_pos") < offset + limit)
    return kept.join(totals, "trace_id").drop("_pos")
