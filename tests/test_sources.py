import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import calls, catalog, graph, samples
from tracewright.sources import captures, exports, sinks


def _header(name, *columns):
    cols = "".join(f"<col><mnemonic>{m}</mnemonic><name>{m.title()}</name><engineering-type>{t}</engineering-type></col>" for m, t in columns)
    return f'<schema name="{name}">{cols}</schema>'


SAMPLES = _header(
    "time-profile", ("time", "sample-time"), ("thread", "thread"), ("process", "process"), ("core", "core"),
    ("thread-state", "thread-state"), ("weight", "weight"), ("stack", "backtrace"),
)
SAMPLE_ROWS = """<row><sample-time id="1" fmt="00:01">1000</sample-time><thread id="2" fmt="main 0x1 (Demo)"><tid id="3">77</tid>
<process id="4" fmt="Demo (42)"><pid id="5" fmt="42">42</pid></process></thread><process ref="4"/><core id="6" fmt="CPU 1">1</core>
<thread-state id="7" fmt="Running">Running</thread-state><weight id="8" fmt="1 ms">500</weight>
<backtrace id="9"><frame id="10" name="leaf" addr="0x10"><binary id="11" name="libA" UUID="U-1" path="/lib/A"/></frame>
<frame id="12" name="root" addr="0x20"><binary ref="11"/></frame></backtrace></row><row/>
<row><sample-time id="20">2000</sample-time><thread ref="2"/><process ref="4"/><sentinel/><thread-state ref="7"/><weight ref="30"/>
<backtrace id="21"><frame ref="12"/></backtrace></row>
<row><sample-time id="29">3000</sample-time><thread ref="99"/><sentinel/><core ref="6"/><sentinel/><weight id="30" fmt="9 &amp; more">900</weight>
<backtrace ref="9"/></row>"""
HANGS = _header("potential-hangs", ("start", "start-time"), ("duration", "duration"), ("hang-type", "hang-type"), ("thread", "thread"), ("process", "process"))
HANG_ROWS = """<row><start-time>1500</start-time><duration>2000</duration><hang-type id="1" fmt="Severe Hang">Severe Hang</hang-type>
<thread id="2" fmt="Main"><tid id="3">77</tid></thread><process id="4" fmt="Demo (42)"><pid id="5">42</pid></process></row>
<row><start-time>oops</start-time><duration>5</duration><hang-type ref="1"/><sentinel/><process ref="4"/></row>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("exports")
    for trace in ("r1", "r2"):
        (base / trace).mkdir()
        body = f"<?xml version='1.0'?><trace-query-result>\n<node xpath='x'>{SAMPLES}{SAMPLE_ROWS}</node></trace-query-result>"
        (base / trace / "samples.xml").write_text(body)
    (base / "r1" / "hangs.xml").write_text(f"<trace-query-result><node>{HANGS}{HANG_ROWS}</node></trace-query-result>")
    return base


@pytest.fixture(scope="module")
def loaded(spark, folder):
    return exports.read_exports(spark, [str(p) for p in sorted(folder.glob("*/*.xml"))])


def test_cells_keep_position_and_follow_references(loaded):
    cells = exports.table_cells(loaded).filter("trace_id = 'r1' and schema = 'time-profile'")
    rows = {(r.row_no, r.mnemonic): (r.tag, r.text, r.fmt) for r in cells.collect()}
    assert rows[0, "time"] == ("sample-time", "1000", "00:01")
    # The weight of the second filled row refers forward; row 1 is empty and still counts.
    assert rows[2, "weight"] == ("weight", "900", "9 & more")
    assert rows[2, "core"][0] == "sentinel" and (1, "time") not in rows
    assert rows[3, "thread"] == ("thread", None, None)
    typed = {(r.row_no, r.mnemonic): (r.value, r.int_value) for r in catalog.typed(cells).collect()}
    assert typed[2, "core"] == (None, None) and typed[0, "time"] == ("00:01", 1000) and typed[2, "time"] == ("2000", 2000)


def test_samples_of_a_file(loaded):
    rows = {r.row_no: r for r in exports.cpu_samples(loaded).filter("trace_id = 'r2'").collect()}
    assert {i: (r.time_ns, r.weight, r.pid, r.tid, r.process_name, r.core) for i, r in rows.items()} == {
        0: (1000, 500, 42, 77, "Demo", "CPU 1"),
        2: (2000, 900, 42, 77, "Demo", ""),
        3: (3000, 900, 0, 0, "Unknown", "CPU 1"),
    }
    stacks = {i: [tuple(f) for f in r.backtrace] for i, r in rows.items()}
    root = ("root", "0x20", "libA", "/lib/A", "U-1")
    assert stacks == {0: [("leaf", "0x10", "libA", "/lib/A", "U-1"), root], 2: [root], 3: [("leaf", "0x10", "libA", "/lib/A", "U-1"), root]}
    assert rows[3].thread_name == "Unknown" and rows[3].state == ""
    top = samples.top_functions(exports.cpu_samples(loaded)).filter("trace_id = 'r1'").collect()
    assert sorted((r["rank"], r.name, r.total_weight) for r in top) == [(1, "root", 2300), (2, "leaf", 1400)]


def test_hangs_of_a_file(loaded):
    got = sorted((r.row_no, r.start_ns, r.duration_ns, r.hang_type, r.pid, r.tid) for r in exports.hangs(loaded).collect())
    assert got == [(0, 1500, 2000, "Severe Hang", 42, 77), (1, 0, 5, "Severe Hang", 42, 0)]


def test_generic_table_query(loaded):
    cells = exports.table_cells(loaded)
    got = catalog.query_table(cells, "potential-hangs", limit=1).collect()
    assert [(r.row_no, r.total_rows, r.row["start"], r.row["hang-type"]) for r in got] == [(0, 2, "1500", "Severe Hang")]
    with pytest.raises(ValueError, match="potential-hangs, time-profile"):
        catalog.query_table(cells, "absent")
    assert {(r.trace_id, r.schema) for r in catalog.available_tables(cells).collect()} == {
        ("r1", "time-profile"), ("r2", "time-profile"), ("r1", "potential-hangs"),
    }
    with pytest.raises(ValueError):
        catalog.query_table(cells, "  ")


def test_rows_do_not_depend_on_file_splits(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        split = exports.read_exports(spark, str(folder / "r1" / "samples.xml"))
        got = sorted((r.row_no, r.position, r.text) for r in exports.table_cells(split).collect() if r.text)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = exports.read_exports(spark, str(folder / "r1" / "samples.xml"))
    assert got == sorted((r.row_no, r.position, r.text) for r in exports.table_cells(whole).collect() if r.text)


def test_chains_of_references(spark):
    rows = [(1, 0, "a", None, "text"), (1, 1, "b", "a", None), (1, 2, "c", "b", None), (1, 3, None, "c", None), (1, 4, None, "z", None)]
    df = spark.createDataFrame(rows, "doc int, n int, id string, ref string, content string")
    got = {r.n: r.content for r in catalog.expand_refs(df, ["doc"], ["content"]).collect()}
    assert got == {0: "text", 1: "text", 2: "text", 3: "text", 4: None}


def test_all_tables_of_a_file(spark, tmp_path):
    (tmp_path / "r5").mkdir()
    empty = _header("empty-table", ("a", "a"))
    body = f"<trace-query-result><node>{SAMPLES}{SAMPLE_ROWS}</node><node>{empty}</node><node>{HANGS}{HANG_ROWS}</node></trace-query-result>"
    (tmp_path / "r5" / "both.xml").write_text(body)
    both = exports.read_exports(spark, str(tmp_path / "r5" / "both.xml"))
    cells = exports.table_cells(both).collect()
    assert {(r.schema, r.row_no) for r in cells} == {("time-profile", i) for i in (0, 2, 3)} | {("potential-hangs", i) for i in (4, 5)}
    assert [r.start_ns for r in exports.hangs(both).orderBy("row_no").collect()] == [1500, 0]
    names = {(r.schema, r.mnemonic) for r in catalog.table_columns(both.columns, "potential-hangs").join(both.columns.select("schema", "mnemonic"), "mnemonic").collect()}
    assert ("potential-hangs", "start") in names
    assert {r.schema for r in both.columns.select("schema").distinct().collect()} == {"time-profile", "empty-table", "potential-hangs"}


def test_long_chains_and_circles(spark):
    rows = [(1, i, f"n{i}", f"n{i - 1}" if i else None, None if i else "text") for i in range(60)]
    rows += [(2, 0, "a", "b", None), (2, 1, "b", "a", None), (2, 2, None, "a", None)]
    df = spark.createDataFrame(rows, "doc int, n int, id string, ref string, content string")
    got = {(r.doc, r.n): r.content for r in catalog.expand_refs(df, ["doc"], ["content"]).collect()}
    assert got == {**{(1, i): "text" for i in range(60)}, **{(2, i): None for i in range(3)}}


def test_of_repeated_ids_the_last_counts(spark):
    rows = [(1, 0, "a", None, "old"), (1, 1, "a", None, "new"), (1, 2, None, "a", None), (1, 3, "b", "a", None), (1, 4, "b", "a", None), (1, 5, None, "b", None)]
    df = spark.createDataFrame(rows, "doc int, n int, id string, ref string, content string")
    got = sorted((r.n, r.content) for r in catalog.expand_refs(df, ["doc"], ["content"], order="n").collect())
    assert got == [(0, "old"), (1, "new"), (2, "new"), (3, "new"), (4, "new"), (5, "new")]
    assert catalog.expand_refs(df, ["doc"], ["content"]).count() == len(rows)


def test_captures_lead_to_a_reduced_graph(spark, tmp_path):
    """Files to graph: recordings are named by their folder, and a call listed twice keeps its first command buffer."""
    for name, bound in (("rec_a", [[7], [7, 8], [8, 7]]), ("rec_b", [[1], [2]])):
        events = [{"type": "dispatch", "index": 10 * i, "encoder_idx": 0, "kernel": f"k{i}", "buffers_bound": {str(s): a for s, a in enumerate(b)}} for i, b in enumerate(bound)]
        listed = [{"func_idx": 99, "addr": "0x1", "dispatches": [{"index": 0}, {"index": 10}]}, {"func_idx": 100, "addr": "0x2", "dispatches": [{"index": 10}]}]
        encoders = [{"encoder_idx": 0, "command_buffer_idx": 0, "addr": "0xe", "dispatches": [{"index": 0}]}]
        (tmp_path / name).mkdir()
        (tmp_path / name / "events.json").write_text(json.dumps({"events": events, "command_buffers": listed, "compute_encoders": encoders}))
    got = captures.read_captures(spark, str(tmp_path / "*" / "events.json"))
    assert sorted((r.trace_id, r.func_idx, r.cb_idx) for r in got.events.collect())[:3] == [("rec_a", 0, 0), ("rec_a", 10, 0), ("rec_a", 20, -1)]
    tables = calls.dispatch_tables(got.events, got.bindings, got.encoders, got.command_buffers)
    built = graph.build_dep_graph(tables.dispatches, tables.bindings, tables.barriers, mode="hazard")
    assert {(r.trace_id, r.src, r.tgt) for r in built.edges.collect()} == {("rec_a", 0, 1), ("rec_a", 1, 2)}
    report = graph.dependency_report(tables.dispatches, tables.bindings, tables.barriers, scale="kernel")
    assert {(r.trace_id, r.critical_path_length) for r in report["summary"].collect()} == {("rec_a", 2), ("rec_b", 0)}
    assert {r.kernel for r in report["rolled_nodes"].filter("trace_id = 'rec_a'").collect()} == {"k0", "k1", "k2"}


def test_cells_without_header_and_equal_names(spark):
    rows = [("r", "t", 0, 0, "a", "x"), ("r", "t", 0, 1, None, "y"), ("r", "t", 0, 2, "a", "z"), ("r", "t", 1, 0, None, "w")]
    cells = spark.createDataFrame([(*row, None) for row in rows], "trace_id string, schema string, row_no long, position int, mnemonic string, text string, fmt string")
    got = {r.row_no: (r.row, r.total_rows, r.returned_rows) for r in catalog.query_table(cells, "t").collect()}
    assert got == {0: ({"a": "x"}, 2, 2), 1: (None, 2, 2)}
    assert [r.row_no for r in catalog.query_table(cells, "t", limit=1).collect()] == [0]


def test_table_of_contents(spark, tmp_path):
    (tmp_path / "r9").mkdir()
    (tmp_path / "r9" / "toc.xml").write_text(
        """<trace-toc><run number="1"><info><target><device name="Box" model="M" os-version="1" platform="P"/>
        <process name="Demo" pid="42"/></target><summary><duration>1.5</duration><template-name>Blank</template-name></summary></info>
        <processes><process name="kernel" pid="0"/><process name="Demo" pid="42"/></processes>
        <data><table schema="time-profile" codes="x"/><table schema="time-profile"/></data></run></trace-toc>"""
    )
    toc = exports.read_contents(spark, str(tmp_path / "r9" / "toc.xml"))
    info = catalog.trace_info(toc.info).first()
    assert (info.trace_id, info.device_name, info.duration_seconds, info.template_name, info.end_reason) == ("r9", "Box", 1.5, "Blank", "")
    assert (info.target_process, info.target_pid) == ("Demo", 42)
    listed = catalog.list_tables(toc.tables).orderBy("ord").collect()
    assert [(r.schema, r.attributes) for r in listed] == [("time-profile", {"codes": "x"}), ("time-profile", {})]
    assert catalog.processes(toc.processes).count() == 3 and catalog.processes(toc.processes, distinct=True).count() == 2
    opened = catalog.open_trace(toc.info, toc.tables, toc.processes).first()
    assert (opened.tables, opened.num_tables, opened.num_processes) == (["time-profile"], 2, 3)
    assert catalog.has_table(toc.tables, "absent").first().has_table is False


def test_capture_documents(spark, tmp_path):
    event = lambda kind, i, **more: {"type": kind, "index": i, "encoder_idx": 0, **more}
    doc = {
        "metadata": {"a": "b"}, "total_functions": 9,
        "events": [event("dispatch", 1, kernel="fill", buffers_bound={"0": 4096, "2": 8192}, threadgroups=[1, 2, 3]),
                   event("barrier", 2, scope="buffers"), event("dispatch", 5, kernel="sum", buffers_bound={})],
        "command_buffers": [{"func_idx": 7, "addr": "0x1", "dispatches": [{"index": 1, "kernel": "fill"}]}],
        "compute_encoders": [{"encoder_idx": 0, "command_buffer_idx": 0, "addr": "0xe", "dispatches": [{"index": 1}, {"index": 5}]}],
    }
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "events.json").write_text(json.dumps(doc, indent=1))
    got = captures.read_captures(spark, str(tmp_path / "c1" / "events.json"))
    assert sorted((r.func_idx, r.type, r.kernel, r.cb_idx) for r in got.events.collect()) == [
        (1, "dispatch", "fill", 0), (2, "barrier", None, None), (5, "dispatch", "sum", -1),
    ]
    assert sorted((r.func_idx, r.buffer_index, r.buffer_addr) for r in got.bindings.collect()) == [(1, 0, 4096), (1, 2, 8192)]
    assert [(r.trace_id, r.num_dispatches) for r in got.encoders.collect()] == [("c1", 2)]
    matrix = {"counter_names": ["A", "B"], "num_samples": 2, "timestamps_ns": [10, 20], "samples": [[1.0, 2.0], [3.0, 4.0]]}
    (tmp_path / "c1" / "counters.json").write_text(json.dumps(matrix))
    long = captures.read_counters(spark, str(tmp_path / "c1" / "counters.json"), multiline=False)
    assert sorted((r.counter, r.sample_idx, r.ts_ns, r.value) for r in long.collect()) == [
        ("A", 0, 10, 1.0), ("A", 1, 20, 3.0), ("B", 0, 10, 2.0), ("B", 1, 20, 4.0),
    ]


def test_trace_event_documents(spark, tmp_path):
    ddl = "trace_id bigint, ph string, name string, ts double, args string"
    events = spark.createDataFrame([(t, "X", f"k{i}", float(i), '{"n":%d}' % i if i % 2 else None) for t in (1, 2) for i in range(25)], ddl)
    sinks.write_trace_events(events, str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert len(lines) == events.count()
    for trace in (1, 2):
        found = sorted((e["name"], (e.get("args") or {}).get("n")) for e in (json.loads(r.value) for r in lines if r.trace_id == trace))
        assert found == sorted((f"k{i}", i if i % 2 else None) for i in range(25))
    for file in (tmp_path / "out").glob("*/part-*"):
        times = [json.loads(line)["ts"] for line in file.read_text().splitlines()]
        assert times == sorted(times)
    edges = spark.createDataFrame([(1, 0, 1, 255)], "trace_id bigint, src bigint, tgt bigint, buffer_addr bigint")
    sinks.write_dep_graph({"edges": edges}, str(tmp_path / "graph"))
    assert spark.read.json(str(tmp_path / "graph" / "edges")).select(F.col("buffer")).first().buffer == "0xff"


def test_many_recordings_share_event_files(spark, tmp_path):
    fields = "trace_id bigint, name string, ts bigint, args string"
    rows = [(t, f"e{i}", 100 - i, '{"n":1}' if i % 2 else None) for t in [*range(300), None] for i in range(4)]
    sinks.write_trace_events(spark.createDataFrame(rows, fields), str(tmp_path / "out"), folders=False)
    files = sorted((tmp_path / "out").rglob("part-*"))
    assert 0 < len(files) < 100
    lines = [json.loads(line) for file in files for line in file.read_text().splitlines()]
    order = [(e.get("trace_id", -1), e["ts"]) for e in lines]
    assert order == sorted(order)
    found = {(e.get("trace_id"), e["name"], e["ts"], json.dumps(e["args"], separators=(",", ":")) if "args" in e else None) for e in lines}
    assert found == set(rows) and len(lines) == len(rows)
