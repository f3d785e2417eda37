import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import numeric, text
from tracewright.operators import samples, timeline
from tracewright.schemas import schema

MS = 1_000_000


def _samples(spark, rows):
    """Rows: (row_no, time_ns, weight, stack names)."""
    frame = lambda n: (n, None, None, None, None)
    data = [(1, i, t, 5, "App", 7, "main", "", "", w, [frame(n) for n in stack]) for i, t, w, stack in rows]
    return spark.createDataFrame(data, schema("cpu_samples"))


def _gpu(spark, rows):
    return spark.createDataFrame(
        [(1, i, "s", start, length, label) for i, (start, length, label) in enumerate(rows)],
        "trace_id bigint, row_no bigint, source_schema string, start_ns bigint, duration_ns bigint, label string",
    )


def test_recursion_counts_every_occurrence(spark):
    df = _samples(spark, [(0, 10, 5, ["f", "g", "f"]), (1, 20, 7, ["g"]), (2, 30, 0, [])])
    got = [(r.rank, r.name, r.total_weight) for r in samples.top_functions(df).orderBy("rank").collect()]
    assert got == [(1, "g", 12), (2, "f", 10)]
    ranged = samples.top_functions(df, 1, 20, 20).collect()
    assert [(r.name, r.total_weight) for r in ranged] == [("g", 7)]
    leaves = samples.self_functions(df).orderBy("rank").collect()
    assert [(r.name, r.total_weight) for r in leaves] == [("g", 7), ("f", 5)]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            samples.top_functions(df, bad)
    assert samples.top_functions(df, 501).count() == 2


def test_ties_go_to_the_first_seen(spark):
    df = _samples(spark, [(0, 10, 5, ["b"]), (1, 20, 5, ["a"])])
    assert [r.name for r in samples.top_functions(df).orderBy("rank").collect()] == ["b", "a"]


def test_range_is_inclusive_at_both_ends(spark):
    df = _samples(spark, [(i, t, 1, ["f"]) for i, t in enumerate((10, 20, 30, 40))])
    assert [r.time_ns for r in samples.cpu_samples(df, 20, 30).collect()] == [20, 30]
    assert samples.cpu_samples(df, limit=3).count() == 3


def test_bucket_edges(spark):
    # 100 ms in 10 buckets; the last sample lies exactly at the end and so behind the last bucket.
    cpu = _samples(spark, [(0, 0, 5 * MS, ["f"]), (1, 100 * MS, 5 * MS, ["late"])])
    gpu = _gpu(spark, [(5 * MS, 20 * MS, "wide"), (12 * MS, 4 * MS, "inner")])
    result = timeline.correlated_timeline(cpu, gpu, num_buckets=10)
    rows = {r.bucket: r for r in result.timeline.collect()}
    assert len(rows) == 10
    assert rows[0].cpu_pct == 50.0 and rows[0].cpu_top_function == "f" and rows[0].phase == "BALANCED"
    assert (rows[1].gpu_active_ns, rows[1].gpu_top_shader, rows[1].gpu_pct) == (14 * MS, "wide", 100.0)
    assert rows[9].cpu_weight == 0 and rows[9].phase == "IDLE"
    assert [(r.bucket, r.name, r.w) for r in result.others.collect()] == [(1, "inner", 4 * MS)]
    phases = [(r.phase, r.start_ns, r.end_ns) for r in result.phases.orderBy("island").collect()]
    assert phases == [("BALANCED", 0, 10 * MS), ("GPU_BOUND", 10 * MS, 30 * MS), ("IDLE", 30 * MS, 100 * MS)]
    summary = result.summary.first()
    assert (summary.bottleneck, summary.num_buckets, summary.num_gpu_intervals) == ("GPU_BOUND", 10, 2)
    spent = {r.phase: r.duration_ns for r in result.breakdown.collect()}
    assert spent == {"CPU_BOUND": 0, "GPU_BOUND": 20 * MS, "BALANCED": 10 * MS, "PIPELINE_BUBBLE": 0, "IDLE": 70 * MS}


def test_phases_agree_for_bounded_and_chunked_scans(spark):
    cpu = _samples(spark, [(i, i * 7 * MS, (i % 4) * 3 * MS, [f"f{i % 3}"]) for i in range(60)])
    gpu = _gpu(spark, [(i * 11 * MS, 5 * MS, "x") for i in range(30)])
    rows = timeline.correlated_timeline(cpu, gpu, bucket_ms=10).timeline
    pick = lambda df: sorted((r.island, r.phase, r.start_ns, r.end_ns) for r in df.collect())
    assert pick(timeline.merge_phases(rows)) == pick(timeline.merge_phases(rows, bounded=True))


def test_more_buckets_than_a_chunk_number_runs_once(spark, monkeypatch):
    cpu = _samples(spark, [(i, i * 7 * MS, (i % 4) * 3 * MS, [f"f{i % 3}"]) for i in range(60)])
    gpu = _gpu(spark, [(i * 11 * MS, 5 * MS, "x") for i in range(30)])
    pick = lambda r: sorted((p.island, p.phase, p.start_ns, p.end_ns, p.buckets) for p in r.phases.collect())
    whole = timeline.correlated_timeline(cpu, gpu, num_buckets=40)
    want, summary = pick(whole), whole.breakdown.collect()
    chunk = timeline.index_chunk
    monkeypatch.setattr(timeline, "index_chunk", lambda index: chunk(index, 8))
    cut = timeline.correlated_timeline(cpu, gpu, num_buckets=40)
    assert pick(cut) == want
    assert sorted(cut.breakdown.collect()) == sorted(summary)


def test_short_last_bucket_and_single_instant_are_dropped(spark):
    # 100.5 ms in buckets of 10 ms leave half a millisecond, less than a tenth of the width.
    cpu = _samples(spark, [(0, 0, 1, ["f"]), (1, 100 * MS + MS // 2, 1, ["f"])])
    assert timeline.correlated_timeline(cpu, _gpu(spark, [(0, 1, "x")]), bucket_ms=10).timeline.count() == 10
    one = _samples(spark, [(0, 50, 1, ["f"])])
    assert timeline.correlated_timeline(one, _gpu(spark, [(50, 0, "x")]), num_buckets=5).timeline.isEmpty()


def test_interval_overlaps_add_up(spark):
    gpu = _gpu(spark, [(3, 5000, "a"), (4321, 777, "b"), (0, 9000, "c")])
    plan = timeline.bucket_plan(timeline.extents(_samples(spark, [(0, 0, 1, ["f"]), (1, 9000, 1, ["f"])]), gpu), num_buckets=9)
    total = timeline.spread_intervals(gpu, plan).groupBy("label").agg(F.sum("overlap_ns").alias("n"))
    assert {r.label: r.n for r in total.collect()} == {"a": 5000, "b": 777, "c": 9000}


@pytest.mark.parametrize(
    ("cpu", "gpu", "phase"),
    [(41, 19, "CPU_BOUND"), (19, 41, "GPU_BOUND"), (40, 19, "PIPELINE_BUBBLE"), (41, 20, "PIPELINE_BUBBLE"),
     (21, 21, "BALANCED"), (20, 20, "PIPELINE_BUBBLE"), (5, 5, "IDLE"), (30, 0, "PIPELINE_BUBBLE")],
)
def test_phase_borders(spark, cpu, gpu, phase):
    got = spark.range(1).select(numeric.classify_phase(F.lit(float(cpu)), F.lit(float(gpu))).alias("p")).first().p
    assert got == phase


def test_labels_names_and_globs(spark):
    raw = ["Buffer 0:Compute 0     ( app (22) )  0x304f50ce", "Read: 1 2 -> 6   ( My App (3) )", " a  b ", "( x (1) )", "plain"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [x.c for x in df.select(text.clean_gpu_label(F.col("r")).alias("c")).collect()] == [
        "Buffer 0:Compute 0", "Read: 1 2 -> 6 ( My App (3) )", "a b", "( x (1) )", "plain",
    ]
    names = spark.createDataFrame([("Finder (751)",), ("A (b) (1)",), ("",), (None,)], "n string")
    assert [x.c for x in names.select(text.process_name(F.col("n")).alias("c")).collect()] == ["Finder", "A", "Unknown", "Unknown"]
    kernels = spark.createDataFrame([("fill_a",), ("fill_b\n",), ("Fill_a",), ("fill.a",)], "k string")
    match = lambda p: [x.k for x in kernels.filter(text.matches_glob(F.col("k"), p)).collect()]
    assert match("fill_?") == ["fill_a"]
    assert match("fill[!_]*") == ["fill.a"]
    assert match("fill*") == ["fill_a", "fill_b\n", "fill.a"]


def test_gpu_source_is_the_first_with_rows_after_filtering(spark):
    ddl = schema("gpu_intervals_raw")
    row = lambda i, src, start, proc, label: (1, i, src, start, 5, proc, label, None, None, None, None, None, None)
    raw = spark.createDataFrame([row(0, "a", 1, "Other (1)", "x"), row(1, "b", 2, "App (2)", None), row(2, "b", 3, None, " ")], ddl)
    got = samples.gpu_intervals(raw, ("a", "b"), "app").collect()
    assert sorted((r.row_no, r.label) for r in got) == [(1, "b"), (2, "b")]
    assert [r.label for r in samples.gpu_intervals(raw, ("a", "b")).collect()] == ["x"]


def test_samples_in_intervals_of_any_length(spark):
    points = spark.createDataFrame([(1, i, i * 10) for i in range(200)], "trace_id bigint, row_no bigint, time_ns bigint")
    rows = [(1, 0, 15, 20), (1, 1, 0, 1990), (1, 2, 500, 0), (1, 3, 777, 350), (2, 4, 0, 5000)]
    spans = spark.createDataFrame(rows, "trace_id bigint, row_no bigint, start_ns bigint, duration_ns bigint")
    got = samples.samples_in_intervals(points, spans, rows=8)
    expected = {(i, n) for i in range(200) for t, n, s, d in rows if t == 1 and s <= i * 10 <= s + d}
    pairs = [(r.row_no, r.interval_row) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


@pytest.mark.parametrize("rows", [1, 5, 64, 10000])
def test_samples_in_intervals_where_times_crowd(spark, rows):
    rng = random.Random(rows)
    # A third of the samples share one instant; nested, touching, empty and backward intervals; times that are missing.
    times = [rng.randrange(-50, 400) for _ in range(160)] + [77] * 80 + [None] * 3
    points = [(rng.choice([1, 1, 2]), i, t, "x") for i, t in enumerate(times)]
    spans = [(rng.choice([1, 2, 3]), i, rng.randrange(-60, 400), rng.choice([0, 1, 9, 80, 500, -5]), "kept") for i in range(60)]
    spans += [(1, 60, 77, 0, ""), (1, 61, None, 5, ""), (1, 62, 5, None, ""), (2, 63, -1000, 5000, "")]
    left = spark.createDataFrame(points, "trace_id bigint, row_no bigint, time_ns bigint, kind string").repartition(3)
    right = spark.createDataFrame(spans, "trace_id bigint, row_no bigint, start_ns bigint, duration_ns bigint, ts string")
    got = samples.samples_in_intervals(left, right, rows=rows)
    assert got.columns == ["trace_id", "row_no", "time_ns", "kind", "interval_row", "interval_start_ns", "interval_end_ns"]
    want = {
        (t, i, at, "x", n, s, s + d)
        for t, i, at, _ in points for t2, n, s, d, _ in spans
        if t == t2 and None not in (at, s, d) and s <= at <= s + d
    }
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_samples_in_intervals_of_empty_tables(spark):
    points = spark.createDataFrame([], "trace_id string, row_no bigint, time_ns bigint")
    spans = spark.createDataFrame([("a", 0, 1, 5)], "trace_id string, row_no bigint, start_ns bigint, duration_ns bigint")
    some = spark.createDataFrame([("a", 0, 3)], points.schema)
    assert samples.samples_in_intervals(points, spans).collect() == []
    assert samples.samples_in_intervals(some, spans.limit(0)).collect() == []
    assert [r.interval_row for r in samples.samples_in_intervals(some, spans).collect()] == [0]
