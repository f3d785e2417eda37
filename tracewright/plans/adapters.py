"""Canonical tables expressed over the star-schema and event Parquet tables.

These views stand in for stored recordings: a user's own tables of the same schema replace them one for one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.fixed_values import GPU_SOURCES
from tracewright.operators.ordered import index_chunk, number_rows, time_chunk
from tracewright.session import cut_lineage, ship_package


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(template: str) -> F.Column:
    """``a{expr}b`` as a concatenation of literals and SQL expressions."""
    parts = template.replace("}", "{").split("{")
    return F.concat(*[F.expr(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("trace_id"),
        F.col("event_id").alias("row_no"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) * 1000").alias("time_ns"),
        "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def cpu_samples(spark: SparkSession, sf: str) -> DataFrame:
    def frame(name: F.Column) -> F.Column:
        return F.struct(
            name.alias("name"),
            F.lit(None).cast("string").alias("address"),
            F.lit(None).cast("string").alias("binary_name"),
            F.lit(None).cast("string").alias("binary_path"),
            F.lit(None).cast("string").alias("binary_uuid"),
        )

    return (
        events(spark, sf)
        .filter(F.col("event_type").isin("click", "view"))
        .select(
            "trace_id",
            "row_no",
            "time_ns",
            F.col("trace_id").alias("pid"),
            _text("Proc{trace_id % 3}").alias("process_name"),
            F.expr("cast(k % 8 as bigint)").alias("tid"),
            _text("Thread {k % 8}").alias("thread_name"),
            _text("CPU {k % 4}").alias("core"),
            F.expr("if(k % 9 = 0, 'Blocked', 'Running')").alias("state"),
            (F.col("cents") * F.lit(3000000000)).alias("weight"),
            F.array(frame(F.col("event_type")), frame(_text("k{k % 7}")), frame(_text("k{k % 5}"))).alias("backtrace"),
        )
    )


def hangs(spark: SparkSession, sf: str) -> DataFrame:
    return (
        events(spark, sf)
        .filter("event_type = 'error'")
        .select(
            "trace_id",
            "row_no",
            F.col("time_ns").alias("start_ns"),
            (F.col("cents") * F.lit(600000000)).alias("duration_ns"),
            F.expr("if(cents > 10000, 'Severe Hang', 'Hang')").alias("hang_type"),
            F.col("trace_id").alias("pid"),
            _text("Proc{trace_id % 3}").alias("process_name"),
            F.expr("cast(k % 8 as bigint)").alias("tid"),
            _text("Thread {k % 8}").alias("thread_name"),
        )
    )


def signpost_events(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "trace_id",
        "row_no",
        "time_ns",
        F.expr("element_at(array('Begin', 'End', 'Event'), k % 3 + 1)").alias("event_type"),
        F.col("event_type").alias("name"),
        _text("sub{k % 5}").alias("subsystem"),
        _text("cat{k % 4}").alias("category"),
        F.expr("if(k % 6 = 0, null, concat('m', k))").alias("message"),
        F.expr("if(k % 2 = 0, 'Process', null)").alias("scope"),
        _text("{k}").alias("identifier"),
        F.col("trace_id").alias("pid"),
        _text("Proc{trace_id % 3}").alias("process_name"),
        F.expr("cast(k % 8 as bigint)").alias("tid"),
    )


def signpost_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "trace_id",
        "row_no",
        F.col("time_ns").alias("start_ns"),
        (F.col("cents") * F.lit(1000000)).alias("duration_ns"),
        F.col("event_type").alias("name"),
        _text("sub{k % 5}").alias("subsystem"),
        _text("cat{k % 4}").alias("category"),
        _text("{k}").alias("identifier"),
        F.col("trace_id").alias("pid"),
        _text("Proc{trace_id % 3}").alias("process_name"),
        F.expr("cast(k % 8 as bigint)").alias("start_tid"),
        F.expr("cast(k % 3 as bigint)").alias("end_tid"),
        F.expr("if(k % 6 = 0, null, concat('s', k))").alias("start_message"),
        F.expr("if(k % 7 = 0, null, concat('e', k))").alias("end_message"),
    )


def gpu_intervals_raw(spark: SparkSession, sf: str, several_sources: bool = False) -> DataFrame:
    source = F.lit(GPU_SOURCES[0])
    if several_sources:
        names = F.array(*[F.lit(s) for s in GPU_SOURCES])
        source = F.element_at(names, F.greatest(F.col("k") % 3, F.col("trace_id") % 3).cast("int") + 1)
    label = (
        "Command Buffer {k % 4}:Compute   {k % 6}     ( app{trace_id % 3} ({trace_id}) )  0x{lower(hex(row_no + 4096))}"
    )
    return (
        events(spark, sf)
        .filter("event_type = 'purchase'")
        .select(
            "trace_id",
            "row_no",
            source.alias("source_schema"),
            F.expr("if(k % 25 = 3, 0, time_ns)").alias("start_ns") if several_sources else F.col("time_ns").alias("start_ns"),
            (F.expr("if(k % 25 = 3, 0, cents)") * F.lit(6000000000)).alias("duration_ns")
            if several_sources
            else (F.col("cents") * F.lit(6000000000)).alias("duration_ns"),
            F.when(F.col("k") % 11 != 0, _text("app{trace_id % 3} ({trace_id})")).alias("process_fmt"),
            F.when(F.col("k") % 10 == 1, F.lit("  ")).when(F.col("k") % 10 != 0, _text(label)).alias("event_label"),
            F.when(F.col("k") % 2 == 0, _text("L{k % 3}")).alias("label"),
            F.when(F.col("k") % 3 != 0, _text("chan{k % 5}")).alias("channel_name"),
            *[F.lit(None).cast("string").alias(c) for c in ("narr", "name", "shader", "function")],
        )
    )


def api_calls(spark: SparkSession, sf: str) -> DataFrame:
    """One call per event; argument texts carry what the parsing functions have to find."""
    call_id = F.expr(
        """case event_type
             when 'signup' then if(k % 4 = 0, -16352, -16355)
             when 'click' then if(k % 13 = 0, -99999, -16336)
             when 'purchase' then if(k % 2 = 0, -16327, -16078)
             when 'error' then case when k % 2 = 1 then -16363 when k % 4 = 0 then -16325 else -16370 end
             else case k % 10 when 0 then if(k % 20 = 0, -16009, -16008) when 1 then -16290 when 2 then -16299
                              when 3 then -16338 else -16337 end
           end"""
    )
    text = F.expr(
        """case event_type
             when 'signup' then if(k % 4 = 0, concat('0x', lower(hex(8192 + k)), 'l = (null)(queue)'), null)
             when 'click' then concat('(null)(31488869312ull, 0x', lower(hex(4096 + k)), 'l, 0ul, ', k % 4, 'ul)')
             when 'purchase' then if(k % 7 = 0, '(null)(31488869312ull)', concat('(null)(31488869312ull, {', k % 4 + 1,
                                     'ul, ', k % 3 + 1, 'ul, 1ul}, {', 32 * (k % 2 + 1), 'ul, 1ul, 1ul})'))
             when 'error' then null
             else case k % 10 when 0 then null
                    when 1 then concat('0x', lower(hex(1048576 + k div 10 % 3)), 'l = (null)(lib, "kern', k div 10, '")')
                    when 2 then concat('0x', lower(hex(2097152 + k div 10 % 4)), 'l = (null)(dev, 0x',
                                       lower(hex(1048576 + k div 10 % 5)), 'l)')
                    when 3 then '(null)(31488869312ull)'
                    else concat('(null)(31488869312ull, 0x', lower(hex(k)), 'l, 0x', lower(hex(2097152 + k % 6)), 'l)')
                  end
           end"""
    )
    addr = F.expr(
        "case when event_type in ('signup', 'error') then if(k % 17 = 16, 0, 512 + cast(k % 3 as bigint)) end"
    )
    return events(spark, sf).select(
        "trace_id",
        F.col("row_no").alias("func_idx"),
        call_id.alias("call_id"),
        text.alias("arg_text"),
        addr.alias("obj_addr"),
    )


def gpu_resources(spark: SparkSession, sf: str) -> DataFrame:
    """Names found beside a recording for pipelines made before it began."""
    return (
        events(spark, sf)
        .filter("event_type = 'view' and k % 10 > 3 and k % 6 in (4, 5)")
        .select("trace_id", (F.lit(2097152) + F.col("k") % 6).cast("bigint").alias("addr"))
        .distinct()
        .withColumn("name", _text("resource_{addr % 16}"))
    )


def dispatches(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer in date order; halves of a year are encoders, years are command buffers."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("trace_id"),
        F.col("o_orderkey").alias("source_key"),
        F.expr("datediff(o_orderdate, DATE '1970-01-01') * shiftleft(1L, 36) + o_orderkey").alias("pos"),
        F.col("o_orderpriority").alias("kernel"),
        F.expr("cast(year(o_orderdate) * 2 + if(month(o_orderdate) > 6, 1, 0) as bigint)").alias("encoder_idx"),
        F.expr("cast(year(o_orderdate) as bigint)").alias("cb_idx"),
        F.expr("if(o_orderkey % 9 = 0, null, array(cast(o_orderkey % 4 + 1 as int), 1, 1))").alias("threadgroups"),
        F.expr("if(o_orderkey % 9 < 3, null, array(32, 1, 1))").alias("threads_per_tg"),
        F.expr("cast(floor(o_totalprice) as bigint)").alias("price_ns"),
    )
    numbered = number_rows(time_chunk(orders, ["trace_id"], "pos"), ["trace_id"], "pos", "dispatch_id")
    return numbered.drop("pos", "_chunk").withColumn("func_idx", F.col("dispatch_id") * 10)


def bindings(spark: SparkSession, sf: str, nodes: DataFrame | None = None) -> DataFrame:
    """The lines of an order, numbered by all that is read of them, are the buffer slots of its dispatch."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    # An order has a handful of lines.
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_returnflag")
    slots = lines.withColumn("slot", F.row_number().over(place))
    nodes = (nodes or dispatches(spark, sf)).select("trace_id", "dispatch_id", "source_key")
    return slots.join(nodes, slots.l_orderkey == nodes.source_key).select(
        "trace_id",
        "dispatch_id",
        F.col("slot").alias("ord"),
        F.col("slot").alias("buffer_index"),
        (F.col("l_suppkey") % 8 + 1).alias("buffer_addr"),
        F.expr("case l_returnflag when 'A' then 'READ' when 'N' then 'WRITE' else 'UNKNOWN' end").alias("access_mode"),
    )


def barriers(spark: SparkSession, sf: str, nodes: DataFrame | None = None) -> DataFrame:
    """A barrier follows every dispatch whose order key is divisible by seven."""
    nodes = (nodes or dispatches(spark, sf)).filter("source_key % 7 = 0")
    return nodes.select(
        "trace_id",
        F.col("dispatch_id").alias("barrier_id"),
        (F.col("func_idx") + 1).alias("func_idx"),
        F.expr("if(source_key % 2 = 0, 'buffers', 'resources')").alias("scope"),
        "encoder_idx",
        "cb_idx",
        F.col("dispatch_id").alias("after_dispatch_id"),
    )


def timed_dispatches(spark: SparkSession, sf: str) -> DataFrame:
    """Dispatches with begin and end for the scheduling operators: years are encoders, two kernels."""
    return dispatches(spark, sf).select(
        "trace_id",
        "func_idx",
        F.expr("if(kernel < '3', 'k1', 'k2')").alias("kernel"),
        F.col("cb_idx").alias("encoder_idx"),
        "threadgroups",
        "threads_per_tg",
        F.expr("dispatch_id * 300000 + (source_key % 700) * 100").alias("ts_begin_ns"),
        F.expr("dispatch_id * 300000 + (source_key % 700) * 100 + price_ns").alias("ts_end_ns"),
    )


def draw_times(spark: SparkSession, sf: str, nodes: DataFrame | None = None) -> DataFrame:
    """Draw records in capture order; some are outside the timeline, reversed or empty."""
    nodes = nodes or dispatches(spark, sf)
    begin = F.expr("if(source_key % 13 = 0, 0, dispatch_id * 300000 + (source_key % 700) * 100)")
    length = F.expr(
        "case when source_key % 13 = 0 then 0 when source_key % 11 = 0 then -5 "
        "when source_key % 17 = 0 then 1000000000000 else price_ns end"
    )
    return nodes.filter("source_key % 19 <> 0").select(
        "trace_id",
        F.col("dispatch_id").alias("draw_idx"),
        begin.cast("bigint").alias("ts_begin_ns"),
        (begin + length).cast("bigint").alias("ts_end_ns"),
    )


def counters(spark: SparkSession, sf: str) -> DataFrame:
    numbered = number_rows(
        events(spark, sf), ["trace_id", "event_type"], "row_no", "sample_idx", index_chunk("row_no")
    )
    return numbered.select(
        "trace_id",
        F.col("event_type").alias("counter"),
        "sample_idx",
        F.col("time_ns").alias("ts_ns"),
        (F.col("cents").cast("double") / F.lit(100.0)).alias("value"),
    )


def timeline_facts(spark: SparkSession, sf: str) -> DataFrame:
    """End of the timeline and busy time of each recording."""
    ends = timed_dispatches(spark, sf).groupBy("trace_id").agg(F.max("ts_end_ns").alias("timeline_end_ns"))
    return ends.withColumn("gpu_time_ns", F.expr("timeline_end_ns * (80 + trace_id % 20) div 100"))


def named_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters whose names partly occur in the catalog, with some zero series and some hash names."""
    base = counters(spark, sf)
    name = F.expr(
        """case counter when 'click' then 'ALU Utilization' when 'view' then 'L2 Bandwidth'
             when 'error' then if(trace_id % 4 = 0, '_bc236dcf3744edf6bcf329ae47088528b35ea5e0beac601cf6781545eb2327cc',
                                  'Custom Bytes')
             when 'signup' then 'Ray Occupancy' else 'Zebra' end"""
    )
    value = F.expr("if(counter = 'signup' and trace_id % 3 = 0, 0.0D, value)")
    return base.withColumns({"value": value, "counter": name})


def counter_hash_uses(spark: SparkSession, sf: str) -> DataFrame:
    """Hash-named series of parts: known hashes by part key, and unknown ones."""
    known = (
        "_bc236dcf3744edf6bcf329ae47088528b35ea5e0beac601cf6781545eb2327cc",
        "_5c5c55d05fb355aa5be61ac63c88eb4a2a521a47dd8f79c18b5c1df163d5cb55",
        "_28b593c4df5283c263b57e9a6d113d841094eb62c8e83c152a3d733a17af7b80",
    )
    names = F.array(*[F.lit(k) for k in known])
    unknown = F.concat(F.lit("_"), F.sha2(F.col("p_partkey").cast("string"), 256))
    pick = (F.col("p_partkey") % 5).cast("int")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("trace_id"), F.when(pick < 3, F.get(names, pick)).otherwise(unknown).alias("hash")
    )


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of one document per customer: an order refers to the one before it, so references form long chains.

    The first order and pending ones hold content of their own; one in 97 of the others refers to an id that no element has.
    """
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("trace_id"), F.col("o_orderkey").alias("node"), "o_orderstatus"
    )
    numbered = cut_lineage(number_rows(time_chunk(orders, ["trace_id"], "node"), ["trace_id"], "node", "place").drop("_chunk"))
    before = numbered.select("trace_id", (F.col("place") + 1).alias("place"), F.col("node").cast("string").alias("last"))
    own = F.col("last").isNull() | (F.col("o_orderstatus") == "P")
    target = F.when(~own, F.when(F.col("node") % 97 == 0, F.lit("missing")).otherwise(F.col("last")))
    return numbered.join(before, ["trace_id", "place"], "left").select(
        "trace_id",
        "node",
        F.col("node").cast("string").alias("id"),
        target.alias("ref"),
        F.when(own, F.concat("o_orderstatus", F.col("node").cast("string"))).alias("content"),
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Long cells of two generic tables: customers by nation, and suppliers."""
    customers = table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("trace_id"),
        F.lit("accounts").alias("schema"),
        F.col("c_custkey").alias("row_no"),
        F.array(
            F.struct(F.lit("name").alias("m"), F.col("c_name").alias("t"), F.lit(None).cast("string").alias("f")),
            F.struct(
                F.lit("segment").alias("m"), F.lit("7").alias("t"),
                F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("f"),
            ),
            F.struct(
                F.lit("key").alias("m"),
                F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey").cast("string")).alias("t"),
                F.lit(None).cast("string").alias("f"),
            ),
        ).alias("row"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("trace_id"),
        F.lit("vendors").alias("schema"),
        F.col("s_suppkey").alias("row_no"),
        F.array(
            F.struct(F.lit("name").alias("m"), F.col("s_name").alias("t"), F.lit(None).cast("string").alias("f"))
        ).alias("row"),
    )
    rows = customers.unionByName(suppliers)
    return rows.select("trace_id", "schema", "row_no", F.posexplode("row").alias("position", "c")).select(
        "trace_id", "schema", "row_no", "position", F.col("c.m").alias("mnemonic"),
        F.when(F.col("c.t").isNull() & F.col("c.f").isNull(), "sentinel").otherwise("string").alias("tag"),
        F.col("c.t").alias("text"), F.col("c.f").alias("fmt"),
    )


def byte_records(spark: SparkSession, sf: str) -> DataFrame:
    """Packed binary records of parts."""
    packed = F.concat(F.col("p_brand"), F.lit("|"), F.col("p_type"), F.lit("|"), F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_size").alias("buffer_index"), F.encode(packed, "UTF-8").alias("record"))


def table_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Table entries of a nation's recording: one per customer, named after the market segment."""
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("trace_id"),
        F.col("c_custkey").alias("ord"),
        F.col("c_mktsegment").alias("schema"),
        F.create_map(F.lit("schema"), F.col("c_mktsegment"), F.lit("target-pid"), F.col("c_custkey").cast("string")).alias("attributes"),
    )


def trace_info(spark: SparkSession, sf: str) -> DataFrame:
    """Recording facts from suppliers, some of them missing."""
    missing = F.lit(None).cast("string")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("trace_id"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("device_name"),
        *[missing.alias(c) for c in ("device_model", "os_version", "platform", "start_date", "end_date")],
        F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("duration_seconds"),
        *[missing.alias(c) for c in ("instruments_version", "template_name", "recording_mode", "end_reason")],
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("target_process"),
        F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey")).alias("target_pid"),
    )


def trace_processes(spark: SparkSession, sf: str) -> DataFrame:
    """Process entries: the parts of a size, some without a number or name, some listed twice."""
    return table(spark, sf, "part").select(
        F.col("p_size").cast("string").alias("trace_id"),
        F.col("p_partkey").alias("ord"),
        F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey") % 100).alias("pid"),
        F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")).alias("name"),
    )
