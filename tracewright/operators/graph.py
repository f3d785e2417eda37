"""Dependency graphs of dispatches: hazards, barriers, reduction, longest path, roll-ups.

Dispatch ids are call order, so an edge normally points to a larger id. Reduction and longest path use that: a path between
two ids only visits ids in between, so a hierarchy of id tiles decides them in a number of steps that does not depend on
the length of paths (``tiles``). Graphs with other id orders take general loops, one round per step.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import checks
from tracewright.functions import text
from tracewright.functions import numeric
from tracewright.operators import tiles
from tracewright.operators.ordered import index_chunk, rank_rows, scan
from tracewright.session import cut_lineage

SCALES = ("cb", "encoder", "kernel")
MODES = ("conservative", "hazard")

_PAIR = ["trace_id", "src", "tgt"]


class Graph(NamedTuple):
    dispatches: DataFrame
    edges: DataFrame


def _positions(bindings: DataFrame) -> DataFrame:
    """Bindings in call order, by dispatch and then slot order."""
    pos = numeric.begin_key(F.col("dispatch_id"), F.col("ord"))
    return bindings.select("trace_id", "dispatch_id", "buffer_addr", "access_mode", "ord", pos.alias("pos")).withColumn(
        "_chunk", index_chunk("dispatch_id")
    )


def _first_per_key(edges: DataFrame) -> DataFrame:
    """One edge per pair and type; it names the buffer of the target's first binding that caused it."""
    return edges.groupBy(*_PAIR, "dep_type").agg(F.min_by("buffer_addr", "ord").alias("buffer_addr"))


def shared_edges(bindings: DataFrame) -> DataFrame:
    """Edge from the latest earlier user of the same buffer."""
    users = scan(
        _positions(bindings),
        ["trace_id", "buffer_addr"],
        "pos",
        last_before={"src": F.col("dispatch_id")},
    )
    found = users.filter("src <> dispatch_id").select(
        "trace_id", "src", F.col("dispatch_id").alias("tgt"), F.lit("SHARED").alias("dep_type"), "buffer_addr", "ord"
    )
    return _first_per_key(found)


def hazard_edges(bindings: DataFrame, keep_self: bool = False) -> DataFrame:
    """Read-after-write, write-after-read and write-after-write edges from access modes.

    A binding that is not a pure READ also writes. A reader's write-after-read edge leads to the next writer of the
    buffer, so it is found by looking ahead once per reader instead of joining readers with writers.
    """
    reads = F.col("access_mode") == "READ"
    writer = F.when(~reads, F.struct("dispatch_id", "ord"))
    steps = scan(
        _positions(bindings),
        ["trace_id", "buffer_addr"],
        "pos",
        last_before={"before": writer},
        next_after={"after": writer},
    )
    me = F.col("dispatch_id")

    def edge(condition: Column, src: Column, tgt: Column, kind: str, order: Column) -> Column:
        found = F.struct(
            src.alias("src"), tgt.alias("tgt"), F.lit(kind).alias("dep_type"), order.cast("bigint").alias("ord")
        )
        return F.when(condition, found)

    last, nxt = F.col("before.dispatch_id"), F.col("after.dispatch_id")
    kinds = F.array(
        edge(last.isNotNull() & (F.col("access_mode") != "WRITE"), last, me, "RAW", F.col("ord")),
        edge(last.isNotNull() & ~reads, last, me, "WAW", F.col("ord")),
        edge(nxt.isNotNull() & reads & (nxt != me), me, nxt, "WAR", F.col("after.ord")),
    )
    found = steps.select("trace_id", "buffer_addr", F.explode(F.array_compact(kinds)).alias("e"))
    found = found.select("trace_id", "e.src", "e.tgt", "e.dep_type", "buffer_addr", "e.ord")
    if not keep_self:
        found = found.filter("src <> tgt")
    return _first_per_key(found)


def barrier_edges(dispatches: DataFrame, barriers: DataFrame, edges: DataFrame) -> DataFrame:
    """For each barrier an edge from the last dispatch before to the first after it, where no edge exists yet."""
    nodes = dispatches.select("trace_id", "encoder_idx", F.col("dispatch_id").alias("node"), F.lit(False).alias("wall"))
    walls = barriers.filter("after_dispatch_id >= 0").select(
        "trace_id", "encoder_idx", F.col("after_dispatch_id").alias("node"), F.lit(True).alias("wall")
    )
    # A barrier sits right behind the dispatch it follows.
    rows = nodes.unionByName(walls.distinct()).withColumn("pos", F.col("node") * 2 + F.col("wall").cast("int"))
    around = scan(
        rows,
        ["trace_id", "encoder_idx"],
        "pos",
        index_chunk("node"),
        last_before={"src": F.when(~F.col("wall"), F.col("node"))},
        next_after={"tgt": F.when(~F.col("wall"), F.col("node"))},
    )
    found = around.filter("wall and src is not null and tgt is not null").select(*_PAIR).distinct()
    return found.join(edges.select(*_PAIR), _PAIR, "left_anti").select(
        *_PAIR, F.lit("SHARED").alias("dep_type"), F.lit(0).cast("bigint").alias("buffer_addr")
    )


def _closure(starts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes reachable from each start (one step or more), for graphs of any id order.

    Each round extends only pairs found in the round before and drops those seen earlier.
    """
    steps = pairs.select("trace_id", F.col("src").alias("node"), F.col("tgt").alias("to"))
    frontier = starts.select("trace_id", F.col("start").alias("start"), F.col("start").alias("node"))
    rounds: list[DataFrame] = []
    key = ["trace_id", "start", "node"]
    while True:
        reached = frontier.join(steps, ["trace_id", "node"])
        reached = reached.select("trace_id", "start", F.col("to").alias("node")).distinct()
        for earlier in rounds:
            reached = reached.join(earlier.select(*key), key, "left_anti")
        reached = cut_lineage(reached)
        if reached.isEmpty():
            break
        rounds.append(reached)
        frontier = reached
    out = rounds[0] if rounds else reached
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.select(*key)


def redundant_pairs(pairs: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """Pairs (src, tgt) that another path of the same graph connects. ``pairs`` must be distinct and stored.

    Recordings whose edges all lead to larger ids go through the hierarchy of tiles; others are judged by their closure.
    """
    disordered = cut_lineage(pairs.filter("src >= tgt").select("trace_id").distinct())
    if disordered.isEmpty():
        return tiles.redundant_edges(pairs, tile)
    ordered = cut_lineage(pairs.join(disordered, "trace_id", "left_anti"))
    rest = cut_lineage(pairs.join(disordered, "trace_id", "left_semi"))
    return tiles.redundant_edges(ordered, tile).unionByName(_judge_by_closure(rest))


def _judge_by_closure(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) for which some other successor w of u reaches v."""
    far = pairs.select("trace_id", "src", F.col("tgt").alias("goal"))
    via = cut_lineage(far.join(pairs, ["trace_id", "src"]).filter("tgt <> goal").withColumnRenamed("tgt", "start"))
    reach = _closure(via.select("trace_id", "start").distinct(), pairs).withColumnRenamed("node", "goal")
    hit = via.join(reach, ["trace_id", "start", "goal"], "left_semi")
    return hit.select("trace_id", "src", F.col("goal").alias("tgt")).distinct()


def transitive_reduction(edges: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """Edges that no other path implies, judged on the whole edge set at once."""
    edges = cut_lineage(edges)
    pairs = cut_lineage(edges.select(*_PAIR).distinct())
    return edges.join(redundant_pairs(pairs, tile), _PAIR, "left_anti")


def _peel(pairs: DataFrame) -> DataFrame:
    """General graphs: remove nodes without incoming edges round by round. Adds is_dag and the longest length."""
    rest, number = pairs, 0
    lengths = pairs.select("trace_id").distinct().withColumn("critical_path_length", F.lit(0).cast("bigint"))
    while True:
        inner = rest.select("trace_id", F.col("tgt").alias("src")).distinct()
        free = cut_lineage(rest.join(inner, ["trace_id", "src"], "left_anti"))
        if free.isEmpty():
            break
        number += 1
        # A free source of round k ends a path of k-1 edges, and its own edge makes it k.
        grown = free.select("trace_id").distinct().withColumn("critical_path_length", F.lit(number).cast("bigint"))
        lengths = cut_lineage(
            lengths.unionByName(grown).groupBy("trace_id").agg(F.max("critical_path_length").alias("critical_path_length"))
        )
        rest = cut_lineage(rest.join(free, _PAIR, "left_anti"))
    cyclic = rest.select("trace_id", F.lit(False).alias("acyclic")).distinct()
    out = lengths.join(cyclic, "trace_id", "left")
    return out.select("trace_id", "critical_path_length", F.coalesce("acyclic", F.lit(True)).alias("is_dag"))


def path_facts(dispatches: DataFrame, edges: DataFrame, tile: int = tiles.TILE) -> DataFrame:
    """Per recording: number of edges on the longest path, and whether the graph has no cycle."""
    pairs = cut_lineage(edges.select(*_PAIR).distinct())
    disordered = cut_lineage(pairs.filter("src >= tgt").select("trace_id").distinct())
    if disordered.isEmpty():
        facts = tiles.longest_paths(pairs, tile).withColumn("is_dag", F.lit(True))
    else:
        ordered = tiles.longest_paths(cut_lineage(pairs.join(disordered, "trace_id", "left_anti")), tile)
        general = _peel(cut_lineage(pairs.join(disordered, "trace_id", "left_semi")))
        facts = ordered.withColumn("is_dag", F.lit(True)).unionByName(general)
    traces = dispatches.select("trace_id").distinct()
    return traces.join(facts, "trace_id", "left").select(
        "trace_id",
        F.coalesce("critical_path_length", F.lit(0).cast("bigint")).alias("critical_path_length"),
        F.coalesce("is_dag", F.lit(True)).alias("is_dag"),
    )


def is_dag(dispatches: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether each recording's graph has no cycle.

    Edges that all point to larger ids cannot close a cycle, and a self-edge is one; only the rest is peeled.
    """
    shape = edges.groupBy("trace_id").agg(
        F.max(F.col("src") == F.col("tgt")).alias("loops"), F.min(F.col("src") < F.col("tgt")).alias("rising")
    )
    shape = cut_lineage(shape)
    unclear = shape.filter("not loops and not rising")
    facts = shape.filter("loops or rising").select("trace_id", (~F.col("loops")).alias("is_dag"))
    if not unclear.isEmpty():
        pairs = cut_lineage(edges.join(unclear, "trace_id", "left_semi").select(*_PAIR).distinct())
        facts = facts.unionByName(_peel(pairs).select("trace_id", "is_dag"))
    traces = dispatches.select("trace_id").distinct()
    return traces.join(facts, "trace_id", "left").select("trace_id", F.coalesce("is_dag", F.lit(True)).alias("is_dag"))


def build_dep_graph(
    dispatches: DataFrame,
    bindings: DataFrame,
    barriers: DataFrame | None = None,
    mode: str = "conservative",
    reduce: bool = True,
) -> Graph:
    """Dependency graph in the given mode, with barrier edges, optionally reduced."""
    checks.choice("mode", mode, MODES)
    edges = shared_edges(bindings) if mode == "conservative" else hazard_edges(bindings)
    if barriers is not None:
        edges = cut_lineage(edges)
        edges = edges.unionByName(barrier_edges(dispatches, barriers, edges))
    return Graph(dispatches, transitive_reduction(edges) if reduce else edges)


def scope_dispatches(
    dispatches: DataFrame,
    barriers: DataFrame,
    cb: int | None = None,
    encoder: int | None = None,
    kernel: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Dispatches that pass all filters, with their ids kept, and the barriers of encoders that stay."""
    if cb is not None:
        dispatches = dispatches.filter(F.col("cb_idx") == cb)
    if encoder is not None:
        dispatches = dispatches.filter(F.col("encoder_idx") == encoder)
    if kernel is not None:
        dispatches = dispatches.filter(text.matches_glob(F.col("kernel"), kernel))
    encoders = dispatches.select("trace_id", "encoder_idx").distinct()
    return dispatches, barriers.join(encoders, ["trace_id", "encoder_idx"], "left_semi")


def _endpoints(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("src", "tgt"))
    return edges.select("trace_id", ends.alias("dispatch_id")).distinct()


def connected(dispatches: DataFrame, edges: DataFrame) -> DataFrame:
    return dispatches.join(_endpoints(edges), ["trace_id", "dispatch_id"], "left_semi")


def isolated(dispatches: DataFrame, edges: DataFrame) -> DataFrame:
    return dispatches.join(_endpoints(edges), ["trace_id", "dispatch_id"], "left_anti")


def dep_summary(dispatches: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals, edges per type, longest path, isolated dispatches and parallelism."""

    def of(kind: str) -> Column:
        return F.count(F.when(F.col("dep_type") == kind, F.lit(1))).alias(f"{kind.lower()}_edges")

    edges = cut_lineage(edges)
    nodes = dispatches.groupBy("trace_id").agg(F.count(F.lit(1)).alias("total_dispatches"))
    counts = edges.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total_edges"), *[of(k) for k in ("RAW", "WAR", "WAW", "SHARED")]
    )
    touched = _endpoints(edges).groupBy("trace_id").agg(F.count(F.lit(1)).alias("_touched"))
    facts = path_facts(dispatches, edges)
    out = nodes.join(counts, "trace_id", "left").join(touched, "trace_id", "left").na.fill(0)
    out = out.join(facts, "trace_id").withColumn("isolated_nodes", F.col("total_dispatches") - F.col("_touched"))
    levels = F.col("critical_path_length") + F.lit(1)
    return out.drop("_touched").withColumn(
        "parallelism", F.col("total_dispatches").cast("double") / levels.cast("double")
    )


def _with_ends(edges: DataFrame, dispatches: DataFrame, value: str) -> DataFrame:
    """Edges with an attribute of both ends as src_<value> and tgt_<value>."""
    ends = dispatches.select("trace_id", "dispatch_id", value)
    for side in ("src", "tgt"):
        named = ends.select("trace_id", F.col("dispatch_id").alias(side), F.col(value).alias(f"{side}_{value}"))
        edges = edges.join(named, ["trace_id", side])
    return edges


def kernel_edge_counts(dispatches: DataFrame, edges: DataFrame) -> DataFrame:
    """Per kernel its dispatches and the edges that enter and leave them."""
    ends = edges.select("trace_id", F.explode(F.array(
        F.struct(F.col("src").alias("dispatch_id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("tgt").alias("dispatch_id"), F.lit(0).alias("out"), F.lit(1).alias("in")),
    )).alias("e")).select("trace_id", "e.*")
    degree = ends.groupBy("trace_id", "dispatch_id").agg(F.sum("in").alias("in"), F.sum("out").alias("out"))
    joined = dispatches.select("trace_id", "dispatch_id", "kernel").join(degree, ["trace_id", "dispatch_id"], "left")
    return joined.groupBy("trace_id", "kernel").agg(
        F.count(F.lit(1)).alias("dispatches"),
        F.coalesce(F.sum("in"), F.lit(0)).alias("edges_in"),
        F.coalesce(F.sum("out"), F.lit(0)).alias("edges_out"),
    )


def degree_stats(dispatches: DataFrame, edges: DataFrame) -> DataFrame:
    """Largest and mean degrees over all dispatches, and the share of possible edges that exist."""
    ins = edges.groupBy("trace_id", F.col("tgt").alias("dispatch_id")).agg(F.count(F.lit(1)).alias("n_in"))
    outs = edges.groupBy("trace_id", F.col("src").alias("dispatch_id")).agg(F.count(F.lit(1)).alias("n_out"))
    key = ["trace_id", "dispatch_id"]
    joined = dispatches.select(*key).join(ins, key, "left").join(outs, key, "left").na.fill(0)
    sums = joined.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("n_in").alias("max_in"),
        F.max("n_out").alias("max_out"),
        F.sum("n_in").alias("total"),
        F.sum("n_out").alias("total_out"),
    )
    possible = F.when(F.col("n") > 1, F.expr("n * (n - 1) div 2")).otherwise(F.lit(1))
    count = F.col("n").cast("double")
    return sums.select(
        "trace_id",
        "max_in",
        "max_out",
        (F.col("total").cast("double") / count).alias("avg_in"),
        (F.col("total_out").cast("double") / count).alias("avg_out"),
        (F.col("total").cast("double") / possible.cast("double")).alias("density"),
    )


class RolledUp(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    composition: DataFrame
    edge_buffers: DataFrame


def short_composition(composition: DataFrame, group: str) -> DataFrame:
    """The four most frequent kernels of each group as ``name(count)``, shortened, with a mark when there are more."""
    rank = Window.partitionBy("trace_id", group).orderBy(F.col("dispatches").desc(), "first_id")
    ranked = composition.withColumn("r", F.row_number().over(rank)).filter("r <= 5")
    part = F.concat(text.shorten(F.col("kernel"), 25), F.lit("("), F.col("dispatches").cast("string"), F.lit(")"))
    shown = F.when(F.col("r") <= 4, part).otherwise(F.lit("..."))
    # At most five rows per group reach this list.
    parts = ranked.groupBy("trace_id", group).agg(F.array_sort(F.collect_list(F.struct("r", shown.alias("p")))).alias("l"))
    return parts.select("trace_id", group, F.array_join(F.transform("l", lambda x: x["p"]), ", ").alias("composition"))


def rollup_graph(dispatches: DataFrame, edges: DataFrame, barriers: DataFrame, scale: str) -> RolledUp:
    """The graph at command-buffer, encoder or kernel scale; edges inside a group are not drawn."""
    checks.choice("scale", scale, SCALES)
    group = {"cb": "cb_idx", "encoder": "encoder_idx", "kernel": "kernel"}[scale]
    composition = dispatches.groupBy("trace_id", group, F.col("kernel").alias("_k")).agg(
        F.count(F.lit(1)).alias("dispatches"), F.min("dispatch_id").alias("first_id")
    )
    composition = composition.withColumn("kernel", F.col("_k")).drop("_k") if group != "kernel" else composition.drop("_k")
    nodes = composition.groupBy("trace_id", group).agg(F.sum("dispatches").alias("dispatch_count"))
    nodes = nodes.join(short_composition(composition, group), ["trace_id", group])
    ended = _with_ends(edges, dispatches, group)
    inside = F.col(f"src_{group}") == F.col(f"tgt_{group}")
    if scale == "kernel":
        selfs = ended.filter(inside).groupBy("trace_id", F.col(f"src_{group}").alias(group))
        nodes = nodes.join(selfs.agg(F.count(F.lit(1)).alias("self_deps")), ["trace_id", group], "left")
        order = Window.partitionBy("trace_id").orderBy(group)
        name = F.concat(F.lit("K"), (F.row_number().over(order) - 1).cast("string"))
        nodes = nodes.withColumn("node_id", name)
    else:
        if scale == "cb":
            # Barriers carry an encoder; its command buffer is the one of its first dispatch.
            first = dispatches.groupBy("trace_id", "encoder_idx").agg(F.min_by("cb_idx", "dispatch_id").alias("_cb"))
            barriers = barriers.drop("cb_idx").join(first, ["trace_id", "encoder_idx"]).withColumnRenamed("_cb", "cb_idx")
        walls = barriers.groupBy("trace_id", group).agg(F.count(F.lit(1)).alias("barrier_count"))
        nodes = nodes.join(walls, ["trace_id", group], "left")
        prefix = "CB" if scale == "cb" else "E"
        nodes = nodes.withColumn("node_id", F.concat(F.lit(prefix), F.col(group).cast("string")))
        if scale == "encoder":
            first = dispatches.groupBy("trace_id", "encoder_idx").agg(F.min_by("cb_idx", "dispatch_id").alias("cb_idx"))
            nodes = nodes.join(first, ["trace_id", "encoder_idx"])
    nodes = nodes.na.fill(0, [c for c in ("self_deps", "barrier_count") if c in nodes.columns])

    crossing = ended.filter(~inside)
    by_buffer = crossing.groupBy("trace_id", f"src_{group}", f"tgt_{group}", "buffer_addr").agg(
        F.count(F.lit(1)).alias("_n")
    )
    # Two partial steps: buffers are counted without collecting them.
    rolled = by_buffer.groupBy("trace_id", f"src_{group}", f"tgt_{group}").agg(
        F.sum("_n").alias("weight"), F.count(F.lit(1)).alias("buffers")
    )
    return RolledUp(nodes, rolled, composition, by_buffer.withColumnRenamed("_n", "weight"))


def ranked_edges(edges: DataFrame, scale: str) -> DataFrame:
    """Rolled-up edges with their rank per recording: heaviest first, then by source and target group."""
    group = {"cb": "cb_idx", "encoder": "encoder_idx", "kernel": "kernel"}[checks.choice("scale", scale, SCALES)]
    return rank_rows(edges, ["trace_id"], [-F.col("weight"), F.col(f"src_{group}"), F.col(f"tgt_{group}")])


def ranked_nodes(nodes: DataFrame, scale: str) -> DataFrame:
    """Rolled-up groups with their rank per recording: most dispatches first, then by group."""
    group = {"cb": "cb_idx", "encoder": "encoder_idx", "kernel": "kernel"}[checks.choice("scale", scale, SCALES)]
    return rank_rows(nodes, ["trace_id"], [-F.col("dispatch_count"), F.col(group)])


def node_labels(nodes: DataFrame, scale: str) -> DataFrame:
    """Display label of rolled-up nodes."""
    count = F.col("dispatch_count").cast("string")
    if scale == "kernel":
        selfs = F.when(F.col("self_deps") > 0, F.concat(F.lit("\nself-deps="), F.col("self_deps").cast("string")))
        label = F.concat(
            text.shorten(F.col("kernel"), 40), F.lit("\ndispatches="), count, F.coalesce(selfs, F.lit(""))
        )
    else:
        title, group = ("CB #", "cb_idx") if scale == "cb" else ("Encoder #", "encoder_idx")
        walls = F.when(
            F.col("barrier_count") > 0, F.concat(F.lit(", "), F.col("barrier_count").cast("string"), F.lit(" barriers"))
        )
        label = F.concat(
            F.lit(title), F.col(group).cast("string"), F.lit("\n"), count, F.lit(" dispatches"),
            F.coalesce(walls, F.lit("")), F.lit("\n"), F.col("composition"),
        )
    return nodes.withColumn("label", label)


def dependency_report(
    dispatches: DataFrame,
    bindings: DataFrame,
    barriers: DataFrame,
    scale: str | None = None,
    mode: str = "conservative",
    reduce: bool = True,
    cb: int | None = None,
    encoder: int | None = None,
    kernel: str | None = None,
) -> dict[str, DataFrame]:
    """Scoped dependency graph, its summary, and the requested roll-up."""
    nodes, walls = scope_dispatches(dispatches, barriers, cb, encoder, kernel)
    bound = bindings.join(nodes.select("trace_id", "dispatch_id"), ["trace_id", "dispatch_id"], "left_semi")
    graph = build_dep_graph(nodes, bound, walls, mode, reduce)
    edges = cut_lineage(graph.edges)
    out = {"nodes": nodes, "edges": edges, "summary": dep_summary(nodes, edges)}
    if scale is not None:
        rolled = rollup_graph(nodes, edges, walls, scale)
        out.update(rolled_nodes=rolled.nodes, rolled_edges=rolled.edges, composition=rolled.composition)
    return out
