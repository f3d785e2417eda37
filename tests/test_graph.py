import random


import pytest

from tracewright.operators import graph, tiles

EDGE = "trace_id bigint, src bigint, tgt bigint, dep_type string, buffer_addr bigint"


def _bindings(spark, dispatches):
    """``dispatches``: per dispatch a list of (addr, mode)."""
    rows = [
        (1, d, i, i, addr, mode) for d, bound in enumerate(dispatches) for i, (addr, mode) in enumerate(bound)
    ]
    ddl = "trace_id bigint, dispatch_id bigint, ord int, buffer_index int, buffer_addr bigint, access_mode string"
    return spark.createDataFrame(rows, ddl)


def _edges(spark, pairs, trace=1):
    return spark.createDataFrame([(trace, a, b, "SHARED", 9) for a, b in pairs], EDGE)


def _nodes(spark, n, trace=1):
    return spark.createDataFrame([(trace, i) for i in range(n)], "trace_id bigint, dispatch_id bigint")


def _pairs(df, *more):
    return {(r.src, r.tgt, *(r[m] for m in more)) for r in df.collect()}


def test_shared_edges_lead_from_the_latest_user(spark):
    unknown = "UNKNOWN"
    assert _pairs(graph.shared_edges(_bindings(spark, [[(100, unknown)]] * 3))) == {(0, 1), (1, 2)}
    both = [(100, unknown), (200, unknown)]
    assert _pairs(graph.shared_edges(_bindings(spark, [both, both])), "buffer_addr") == {(0, 1, 100)}
    assert _pairs(graph.shared_edges(_bindings(spark, [[(100, unknown)], [(200, unknown)]]))) == set()


def test_hazards_of_write_read_read_write(spark):
    modes = ["WRITE", "READ", "READ", "WRITE"]
    got = _pairs(graph.hazard_edges(_bindings(spark, [[(7, m)] for m in modes])), "dep_type")
    assert got == {(0, 1, "RAW"), (0, 2, "RAW"), (1, 3, "WAR"), (2, 3, "WAR"), (0, 3, "WAW")}


def test_self_edges_only_on_request(spark):
    twice = _bindings(spark, [[(7, "UNKNOWN"), (7, "UNKNOWN")]])
    assert graph.hazard_edges(twice).isEmpty()
    assert _pairs(graph.hazard_edges(twice, keep_self=True), "dep_type") == {(0, 0, "RAW"), (0, 0, "WAW")}


def _hazards_by_definition(bound):
    """Edges from the definition on the flat list of accesses, without running state."""
    flat = [(d, addr, mode) for d, items in enumerate(bound) for addr, mode in items]
    out = set()
    for j, (d, addr, mode) in enumerate(flat):
        earlier = [(i, e, m) for i, (e, a, m) in enumerate(flat[:j]) if a == addr]
        writes = [i for i, _, m in earlier if m != "READ"]
        last = max(writes, default=None)
        if last is not None and flat[last][0] != d:
            out |= {(flat[last][0], d, t) for t, on in (("RAW", mode != "WRITE"), ("WAW", mode != "READ")) if on}
        if mode != "READ":
            out |= {(e, d, "WAR") for i, e, m in earlier if m == "READ" and e != d and i > (-1 if last is None else last)}
    return out


def test_hazards_match_the_definition_on_random_input(spark):
    rng = random.Random(5)
    for _ in range(4):
        bound = [[(rng.randrange(3), rng.choice(["READ", "WRITE", "UNKNOWN"])) for _ in range(rng.randrange(4))] for _ in range(25)]
        assert _pairs(graph.hazard_edges(_bindings(spark, bound)), "dep_type") == _hazards_by_definition(bound)


def _reachable(pairs, start):
    seen, todo = set(), [start]
    while todo:
        here = todo.pop()
        for a, b in pairs:
            if a == here and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def _redundant(pairs):
    return {(u, v) for u, v in pairs if any(a == u and w != v and v in _reachable(pairs, w) for a, w in pairs)}


@pytest.mark.parametrize("cyclic", [False, True])
def test_reduction_matches_reachability(spark, cyclic):
    rng = random.Random(11)
    rows, expected = [], set()
    for trace in range(6):
        pairs = set()
        for _ in range(60):
            a, b = rng.sample(range(30), 2)
            pairs.add((a, b) if cyclic else (min(a, b), max(a, b)))
        rows += [(trace, a, b) for a, b in pairs]
        expected |= {(trace, *p) for p in _redundant(pairs)}
    stored = graph.cut_lineage(spark.createDataFrame(rows, "trace_id bigint, src bigint, tgt bigint"))
    for tile in (8, 4096):
        assert {tuple(r) for r in graph.redundant_pairs(stored, tile).collect()} == expected


def test_reduction_of_a_triangle(spark):
    assert _pairs(graph.transitive_reduction(_edges(spark, [(0, 1), (1, 2), (0, 2)]))) == {(0, 1), (1, 2)}


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_longest_path(spark, block):
    chain, diamond = [(0, 1), (1, 2), (2, 3), (3, 7), (7, 8)], [(0, 1), (0, 2), (1, 3), (2, 3)]
    edges = _edges(spark, chain, 1).unionByName(_edges(spark, diamond, 2))
    nodes = _nodes(spark, 9, 1).unionByName(_nodes(spark, 4, 2)).unionByName(_nodes(spark, 1, 3))
    got = {r.trace_id: (r.critical_path_length, r.is_dag) for r in graph.path_facts(nodes, edges, block).collect()}
    assert got == {1: (5, True), 2: (2, True), 3: (0, True)}


def test_cycles_are_found(spark):
    edges = _edges(spark, [(0, 1), (1, 2), (2, 1)], 1).unionByName(_edges(spark, [(3, 1), (1, 0)], 2))
    nodes = _nodes(spark, 4, 1).unionByName(_nodes(spark, 4, 2))
    facts = {r.trace_id: (r.critical_path_length, r.is_dag) for r in graph.path_facts(nodes, edges).collect()}
    assert facts == {1: (1, False), 2: (2, True)}
    assert {r.trace_id: r.is_dag for r in graph.is_dag(nodes, edges).collect()} == {1: False, 2: True}


def test_barrier_edges(spark):
    nodes = spark.createDataFrame([(1, d, 0 if d < 3 else 1) for d in range(5)], "trace_id bigint, dispatch_id bigint, encoder_idx bigint")
    ddl = "trace_id bigint, barrier_id bigint, encoder_idx bigint, after_dispatch_id bigint"
    walls = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 0, 0), (1, 2, 0, 2), (1, 3, 1, -1), (1, 4, 1, 3)], ddl)
    got = graph.barrier_edges(nodes, walls, _edges(spark, [(3, 4)]))
    # Behind dispatch 2 nothing follows in its encoder, -1 has nothing before it, 3 to 4 exists already.
    assert _pairs(got, "buffer_addr") == {(0, 1, 0)}


def test_rollup_counts_crossing_edges_and_buffers(spark):
    nodes = spark.createDataFrame(
        [(1, 0, "fill", 0, 0), (1, 1, "fill", 0, 0), (1, 2, "sum", 1, 0), (1, 3, "sum", 2, 1), (1, 4, "fill", 2, 1)],
        "trace_id bigint, dispatch_id bigint, kernel string, encoder_idx bigint, cb_idx bigint",
    )
    rows = [(0, 1, 5), (1, 2, 5), (0, 2, 6), (2, 3, 6), (3, 4, 0)]
    edges = spark.createDataFrame([(1, a, b, "SHARED", buf) for a, b, buf in rows], EDGE)
    walls = spark.createDataFrame([(1, 0, 2)], "trace_id bigint, barrier_id bigint, encoder_idx bigint")
    by_encoder = graph.rollup_graph(nodes, edges, walls, "encoder")
    found = {(r.src_encoder_idx, r.tgt_encoder_idx): (r.weight, r.buffers) for r in by_encoder.edges.collect()}
    assert found == {(0, 1): (2, 2), (1, 2): (1, 1)}
    by_cb = graph.rollup_graph(nodes, edges, walls, "cb")
    assert {r.node_id: (r.dispatch_count, r.barrier_count, r.composition) for r in by_cb.nodes.collect()} == {
        "CB0": (3, 0, "fill(2), sum(1)"),
        "CB1": (2, 1, "sum(1), fill(1)"),
    }
    by_kernel = graph.rollup_graph(nodes, edges, walls, "kernel")
    assert {r.kernel: (r.node_id, r.self_deps) for r in by_kernel.nodes.collect()} == {"fill": ("K0", 1), "sum": ("K1", 1)}
    with pytest.raises(ValueError):
        graph.rollup_graph(nodes, edges, walls, "dispatch")


def test_degrees_and_kernel_counts(spark):
    nodes = spark.createDataFrame([(1, i, "a" if i < 2 else "b") for i in range(4)], "trace_id bigint, dispatch_id bigint, kernel string")
    edges = _edges(spark, [(0, 1), (0, 2), (1, 2)])
    stats = graph.degree_stats(nodes, edges).first()
    assert (stats.max_in, stats.max_out, stats.avg_in, stats.density) == (2, 2, 0.75, 0.5)
    counts = {r.kernel: (r.dispatches, r.edges_in, r.edges_out) for r in graph.kernel_edge_counts(nodes, edges).collect()}
    assert counts == {"a": (2, 1, 3), "b": (2, 2, 0)}
    assert [r.dispatch_id for r in graph.isolated(nodes, edges).collect()] == [3]


def _ordered_graphs():
    """Recordings named by text, as files give them, with edges of all widths."""
    rng = random.Random(3)
    return {f"rec_{t}": {(a, a + rng.choice([1, 2, 3, 8, 30, 90])) for a in (rng.randrange(100) for _ in range(150))} for t in range(5)}


@pytest.mark.parametrize("tile", [2, 5, 16, 4096])
def test_tiles_of_any_size_give_the_same_reduction_and_longest_paths(spark, tile):
    graphs = _ordered_graphs()
    rows = [(name, *p) for name, pairs in graphs.items() for p in pairs]
    stored = graph.cut_lineage(spark.createDataFrame(rows, "trace_id string, src bigint, tgt bigint"))
    assert {tuple(r) for r in tiles.redundant_edges(stored, tile).collect()} == {(name, *p) for name, pairs in graphs.items() for p in _redundant(pairs)}

    def longest(pairs):
        best = {}
        for a, b in sorted(pairs):
            best[b] = max(best.get(b, 0), best.get(a, 0) + 1)
        return max(best.values())

    assert {r[0]: r[1] for r in tiles.longest_paths(stored, tile).collect()} == {name: longest(pairs) for name, pairs in graphs.items()}


def test_number_of_jobs_follows_the_levels_and_not_the_path(spark):
    """A wide edge over a chain; eight times the ids are one more level."""
    jobs = {}
    for n in (64, 128, 1024):
        chain = [("a", i, i + 1) for i in range(n)] + [("a", 0, n)]
        stored = graph.cut_lineage(spark.createDataFrame(chain, "trace_id string, src bigint, tgt bigint"))
        spark.sparkContext.setJobGroup(f"chain-{n}", "")
        assert [tuple(r) for r in tiles.redundant_edges(stored, 16).collect()] == [("a", 0, n)]
        assert tiles.longest_paths(stored, 16).first()[1] == n
        jobs[n] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain-{n}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[64] <= jobs[128] <= jobs[64] + 6 and jobs[1024] <= jobs[128] + 6


def test_small_recordings_are_judged_together(spark, monkeypatch):
    """Recordings below 64 ids share calls, across Arrow batches and beside wider ones; no recording has a call of its own."""
    rng = random.Random(8)
    graphs = {}
    for t in [*range(250), None]:
        last = 63 if t == 0 else 200 if t == 1 else rng.randint(1, 20)
        ends = [sorted(rng.sample(range(last + 1), 2)) for _ in range(3 * last)]
        graphs[t] = {(a, b) for a, b in ends} | {(0, last)}
    stored = graph.cut_lineage(spark.createDataFrame([(t, *p) for t, pairs in graphs.items() for p in pairs], "trace_id bigint, src bigint, tgt bigint"))
    wide = []
    hierarchy = tiles._hierarchy
    monkeypatch.setattr(tiles, "_hierarchy", lambda pairs, *rest: wide.append({r[0] for r in pairs.collect()}) or hierarchy(pairs, *rest))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        redundant = {tuple(r) for r in tiles.redundant_edges(stored).collect()}
        longest = {r[0]: r[1] for r in tiles.longest_paths(stored).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert wide == [{1}, {1}]
    assert redundant == {(t, *p) for t, pairs in graphs.items() for p in _redundant(pairs)}
    for t, pairs in graphs.items():
        best = {}
        for a, b in sorted(pairs):
            best[b] = max(best.get(b, 0), best.get(a, 0) + 1)
        assert longest[t] == max(best.values())


def test_reduced_graph_of_named_recordings(spark):
    ddl = "trace_id string, dispatch_id bigint, ord int, buffer_index int, buffer_addr bigint, access_mode string"
    rows = [("rec_a", d, i, i, addr, "UNKNOWN") for d, bound in enumerate([[7], [7, 8], [8, 7]]) for i, addr in enumerate(bound)]
    nodes = spark.createDataFrame([("rec_a", i) for i in range(3)], "trace_id string, dispatch_id bigint")
    built = graph.build_dep_graph(nodes, spark.createDataFrame(rows, ddl), mode="hazard")
    assert _pairs(built.edges) == {(0, 1), (1, 2)}
    facts = graph.dep_summary(nodes, built.edges).first()
    assert (facts.trace_id, facts.critical_path_length, facts.is_dag) == ("rec_a", 2, True)
