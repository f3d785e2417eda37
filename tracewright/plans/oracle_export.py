"""Reference SQL for the catalog, generic tables and exported rows."""

from __future__ import annotations

from tracewright.plans.oracle import ORACLE
from tracewright.plans.oracle_gpu import BAR, BND, COMP, DSP, NCTR, SHARED

ORACLE["list_tables"] = """
SELECT CAST(c_nationkey AS VARCHAR) AS trace_id, c_custkey AS ord, c_mktsegment AS schema,
       CAST(c_custkey AS VARCHAR) AS attribute FROM customer"""
ORACLE["has_table"] = """
SELECT CAST(c_nationkey AS VARCHAR) AS trace_id, count(*) FILTER (c_mktsegment = 'MACHINERY') > 0 AS has_table
FROM customer GROUP BY c_nationkey"""
ORACLE["trace_info"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS trace_id, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE '' END AS device_name,
       '' AS device_model, '' AS os_version, '' AS platform, '' AS start_date, '' AS end_date,
       CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal ELSE 0.0 END AS duration_seconds, '' AS instruments_version,
       '' AS template_name, '' AS recording_mode, '' AS end_reason,
       CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS target_process, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END AS target_pid
FROM supplier"""
_PROC = """
SELECT {d} CAST(p_size AS VARCHAR) AS trace_id{o}, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey % 100 ELSE 0 END AS pid,
       CASE WHEN p_partkey % 7 <> 0 THEN p_type ELSE '' END AS name FROM part"""
ORACLE["processes"] = _PROC.format(d="", o=", p_partkey AS ord")
ORACLE["processes_distinct"] = _PROC.format(d="DISTINCT", o="")
ORACLE["ref_expand"] = """
WITH o AS (SELECT o_custkey AS t, o_orderkey AS node, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders),
m AS (SELECT *, p = 1 OR s = 'P' AS own, NOT (p = 1 OR s = 'P') AND node % 97 = 0 AS lost FROM o),
l AS (SELECT *, max(p) FILTER (own) OVER w AS at, max(p) FILTER (lost) OVER w AS gap FROM m WINDOW w AS (PARTITION BY t ORDER BY p ROWS UNBOUNDED PRECEDING))
SELECT l.t AS trace_id, l.node, CASE WHEN coalesce(gap, 0) > l.at THEN NULL ELSE g.s || g.node END AS content
FROM l JOIN o g ON g.t = l.t AND g.p = l.at"""
_CELLS = """
WITH c AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS trace_id FROM customer)
"""
ORACLE["typed_cells"] = _CELLS + """
SELECT trace_id, 'accounts' AS schema, c_custkey AS row_no, 'name' AS mnemonic, c_name AS value, CAST(0 AS BIGINT) AS int_value FROM c
UNION ALL SELECT trace_id, 'accounts', c_custkey, 'segment', CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE '7' END, 7 FROM c
UNION ALL SELECT trace_id, 'accounts', c_custkey, 'key', CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) END,
                 CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END FROM c
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), 'vendors', s_suppkey, 'name', s_name, 0 FROM supplier"""
ORACLE["table_query"] = _CELLS + """
SELECT trace_id, row_no, total_rows, least(total_rows, 5) AS returned_rows, name, segment, key FROM (
  SELECT trace_id, c_custkey AS row_no, count(*) OVER (PARTITION BY trace_id) AS total_rows, c_name AS name,
         CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE '7' END AS segment,
         CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS key,
         row_number() OVER (PARTITION BY trace_id ORDER BY c_custkey) AS r FROM c) WHERE r <= 5"""

PARTS = (
    BND
    + """,
own AS (SELECT trace_id, encoder_idx, min_by(cb_idx, d) AS cb FROM dsp GROUP BY ALL),
nd AS (SELECT n.trace_id, d, d * 10 AS f, n.kernel, n.encoder_idx AS enc, own.cb, source_key,
              CASE WHEN source_key % 9 <> 0 THEN (source_key % 4 + 1) || 'x1x1' END AS tg,
              CASE WHEN source_key % 9 >= 3 THEN '32x1x1' END AS tpt,
              (SELECT count(*) FROM bnd b WHERE b.trace_id = n.trace_id AND b.d = n.d) AS bufs,
              CASE WHEN source_key % 2 = 0 THEN 'threads' ELSE 'threadgroups' END AS dt,
              CASE WHEN own.cb % 2 = 0 THEN '0x' || own.cb END AS cba, '0xe' || n.encoder_idx AS ea,
              CASE WHEN source_key % 5 <> 0 THEN d * 300000 + source_key % 700 * 100 END AS tb,
              CASE WHEN source_key % 5 <> 0 THEN d * 300000 + source_key % 700 * 100 + CAST(floor(o_totalprice) AS BIGINT) END AS te,
              source_key % 7 = 0 AS walled, CASE WHEN source_key % 2 = 0 THEN 'buffers' ELSE 'resources' END AS scope
       FROM dsp n JOIN own ON own.trace_id = n.trace_id AND own.encoder_idx = n.encoder_idx),
ar AS (SELECT *, '"func_idx":' || f || coalesce(',"threadgroups":"' || tg || '"', '')
              || coalesce(',"threads_per_threadgroup":"' || tpt || '"', '')
              || CASE WHEN bufs > 0 THEN ',"buffers_bound":' || bufs ELSE '' END || ',"dispatch_type":"' || dt || '"' AS a FROM nd),
ks AS (SELECT trace_id, kernel, min(f) AS first, row_number() OVER (PARTITION BY trace_id ORDER BY min(f)) - 1 AS no
       FROM nd GROUP BY trace_id, kernel),
ev0 AS (SELECT trace_id, enc, cb, cba, ea, f, {tb} AS tb, {te} AS te FROM nd
        UNION ALL SELECT trace_id, enc, cb, cba, ea, f + 1, NULL, NULL FROM nd WHERE walled),
esp AS (SELECT trace_id, enc, any_value(cb) AS cb, any_value(ea) AS ea, coalesce(min(tb), min(f) * 1000) AS b,
               coalesce(max(te), (max(f) + 1) * 1000) AS e FROM ev0 GROUP BY trace_id, enc),
csp AS (SELECT trace_id, cb, any_value(cba) AS cba, coalesce(min(tb), min(f) * 1000) AS b,
               coalesce(max(te), (max(f) + 1) * 1000) AS e FROM ev0 GROUP BY trace_id, cb)"""
)
_REAL = "WITH " + PARTS.format(tb="tb", te="te")
_SYNTH = "WITH " + PARTS.format(tb="CAST(NULL AS BIGINT)", te="CAST(NULL AS BIGINT)")
_AT = "CAST(coalesce(tb, f * 1000) AS DOUBLE) / 1000.0"
_LEN = "CAST(coalesce(te - tb, 1000) AS DOUBLE) / 1000.0"
ORACLE["trace_events_kernel"] = _REAL + f"""
SELECT ar.trace_id, 'X' AS ph, ar.kernel AS name, 'dispatch' AS cat, CAST(no AS BIGINT) AS pid, CAST(0 AS BIGINT) AS tid, {_AT} AS ts, {_LEN} AS dur,
       CAST(NULL AS VARCHAR) AS s,
       '{{' || a || ',"cb":' || cb || coalesce(',"cb_addr":"' || cba || '"', '') || ',"encoder":' || enc || '}}' AS args
FROM ar JOIN ks ON ks.trace_id = ar.trace_id AND ks.kernel = ar.kernel
UNION ALL SELECT trace_id, 'i', 'barrier (' || scope || ')', 'barrier', -1, 0, CAST((f + 1) * 1000 AS DOUBLE) / 1000.0, NULL, 't',
       '{{"scope":"' || scope || '","encoder":' || enc || ',"cb":' || cb || '}}' FROM nd WHERE walled
UNION ALL SELECT trace_id, 'M', 'process_name', NULL, no, 0, NULL, NULL, NULL, '{{"name":"' || kernel || '"}}' FROM ks
UNION ALL SELECT trace_id, 'M', 'process_sort_index', NULL, no, 0, NULL, NULL, NULL, '{{"sort_index":' || first || '}}' FROM ks
UNION ALL SELECT DISTINCT trace_id, 'M', 'process_name', NULL, -1, 0, NULL, NULL, NULL, '{{"name":"Barriers"}}' FROM nd WHERE walled
UNION ALL SELECT DISTINCT trace_id, 'M', 'process_sort_index', NULL, -1, 0, NULL, NULL, NULL, '{{"sort_index":999999}}' FROM nd WHERE walled"""
_EN, _CN = "'Encoder #' || enc || ' (' || ea || ')'", "'CB #' || cb || coalesce(' (' || cba || ')', '')"
ORACLE["trace_events_cb"] = _REAL + f"""
SELECT trace_id, 'X' AS ph, kernel AS name, 'dispatch' AS cat, cb AS pid, enc AS tid, {_AT} AS ts, {_LEN} AS dur,
       CAST(NULL AS VARCHAR) AS s, '{{' || a || '}}' AS args FROM ar
UNION ALL SELECT trace_id, 'i', 'barrier (' || scope || ')', 'barrier', cb, enc, CAST((f + 1) * 1000 AS DOUBLE) / 1000.0, NULL, 't',
       '{{"scope":"' || scope || '"}}' FROM nd WHERE walled
UNION ALL SELECT trace_id, unnest(['B', 'E']), {_EN}, 'encoder', cb, enc, unnest([CAST(b AS DOUBLE), CAST(e AS DOUBLE)]) / 1000.0, NULL, NULL, NULL FROM esp
UNION ALL SELECT trace_id, unnest(['B', 'E']), {_CN}, 'command_buffer', cb, -1, unnest([CAST(b AS DOUBLE), CAST(e AS DOUBLE)]) / 1000.0, NULL, NULL, NULL FROM csp
UNION ALL SELECT trace_id, 'M', 'process_name', NULL, cb, 0, NULL, NULL, NULL, '{{"name":"' || {_CN} || '"}}' FROM csp
UNION ALL SELECT trace_id, 'M', 'thread_name', NULL, cb, -1, NULL, NULL, NULL, '{{"name":"CB Overview"}}' FROM csp
UNION ALL SELECT trace_id, 'M', 'thread_name', NULL, cb, enc, NULL, NULL, NULL, '{{"name":"' || {_EN} || '"}}' FROM esp"""


def _packet(kind: str, source: str, **values: str) -> str:
    types = dict(
        ts="BIGINT", uuid="BIGINT", parent_uuid="BIGINT", name="VARCHAR", iid="INTEGER", duration="BIGINT", event_id="BIGINT",
        submission_id="BIGINT", handle="BIGINT", rank="INTEGER", unit="VARCHAR", value="DOUBLE", extra="VARCHAR",
    )
    shown = ", ".join(f"CAST({values.get(n, 'NULL')} AS {t}) AS {n}" for n, t in types.items())
    return f"SELECT trace_id, '{kind}' AS kind, {shown} FROM {source}"


_EXTRA = (
    "'{' || CASE WHEN tg IS NOT NULL THEN '\"threadgroups\":\"' || tg || '\",' ELSE '' END"
    " || CASE WHEN tpt IS NOT NULL THEN '\"threads_per_threadgroup\":\"' || tpt || '\",' ELSE '' END"
    " || CASE WHEN bufs > 0 THEN '\"buffers_bound\":\"' || bufs || '\",' ELSE '' END"
    " || '\"dispatch_type\":\"' || dt || '\",\"encoder\":\"' || enc || '\",\"cb\":\"' || cb || '\"}'"
)
_UNION = "\nUNION ALL\n"
ORACLE["track_packets"] = _SYNTH + """,
sk AS (SELECT nd.*, no, coalesce((SELECT min(f) FROM nd m WHERE m.trace_id = nd.trace_id AND m.f > nd.f) - f, 1) * 1000 AS len
       FROM nd JOIN ks ON ks.trace_id = nd.trace_id AND ks.kernel = nd.kernel)
""" + _UNION.join([
    _packet("specification", "ks", ts="0", iid="no + 1", name="kernel"),
    _packet("specification", "(SELECT DISTINCT trace_id FROM ks)", ts="0", iid="100", name="'Compute Dispatch'"),
    _packet("stage_event", "sk", ts="f * 1000", iid="no + 1", duration="len", event_id="d", submission_id="cb",
            handle="CASE WHEN cba IS NULL THEN 0 ELSE CAST(cba AS BIGINT) END", name="kernel", extra=_EXTRA),
])
ORACLE["track_packets_cb"] = _REAL + "\n" + _UNION.join([
    _packet("track", "csp", uuid="1000 + cb", name=_CN),
    _packet("track", "csp", uuid="2000 + cb", parent_uuid="1000 + cb", name="'CB Overview'"),
    _packet("track", "esp", uuid="3000 + enc", parent_uuid="1000 + cb", name=_EN),
    _packet("slice_begin", "ar", ts="coalesce(tb, f * 1000)", uuid="3000 + enc", name="kernel", extra="'{' || a || '}'"),
    _packet("slice_end", "ar", ts="coalesce(te, f * 1000 + 1000)", uuid="3000 + enc"),
    _packet("instant", "(SELECT * FROM nd WHERE walled)", ts="(f + 1) * 1000", uuid="3000 + enc",
            name="'barrier (' || scope || ')'", extra="'{\"scope\":\"' || scope || '\"}'"),
    _packet("slice_begin", "esp", ts="b", uuid="3000 + enc", name=_EN),
    _packet("slice_end", "esp", ts="e", uuid="3000 + enc"),
    _packet("slice_begin", "csp", ts="b", uuid="2000 + cb", name=_CN),
    _packet("slice_end", "csp", ts="e", uuid="2000 + cb"),
])
ORACLE["counter_tracks"] = "WITH " + NCTR + """,
nz AS (SELECT * FROM nc WHERE NOT (counter = 'Ray Occupancy' AND trace_id % 3 = 0)),
cat(counter, category, unit, o, g) AS (VALUES ('L2 Bandwidth', 'Memory Bandwidth', 'bytes', 1, 2), ('ALU Utilization', 'Shader Utilization', 'percent', 2, 3),
  ('Ray Occupancy', 'Raytracing', 'percent', 3, 8), ('Custom Bytes', 'Other Counters', 'bytes', 4, 9), ('Zebra', 'Other Counters', NULL, 5, 9),
  ('_bc236dcf3744edf6bcf329ae47088528b35ea5e0beac601cf6781545eb2327cc', 'Other Counters', NULL, 6, 9)),
have AS (SELECT * FROM (SELECT DISTINCT trace_id, counter FROM nz) JOIN cat USING (counter)),
tracks AS (SELECT trace_id, category AS name, g * 100 AS k, NULL AS unit, g, 0 AS child FROM have GROUP BY ALL
           UNION ALL SELECT trace_id, counter, g * 100 + o, unit, g, 1 FROM have),
num AS (SELECT *, 1728053248 + row_number() OVER (PARTITION BY trace_id ORDER BY k) - 1 AS uuid FROM tracks)
SELECT trace_id, 'track' AS kind, CAST(0 AS BIGINT) AS ts, CAST(1728053247 AS BIGINT) AS uuid, CAST(NULL AS BIGINT) AS parent_uuid,
       'GPU Counters' AS name, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS DOUBLE) AS value
FROM have GROUP BY trace_id
UNION ALL SELECT trace_id, 'track', 0, uuid, 1728053247, name,
  CAST((SELECT count(DISTINCT g) FROM num p WHERE p.trace_id = n.trace_id AND p.g < n.g) AS INTEGER), NULL, NULL FROM num n WHERE child = 0
UNION ALL SELECT trace_id, 'track', 0, uuid, (SELECT uuid FROM num p WHERE p.trace_id = n.trace_id AND p.g = n.g AND p.child = 0), name,
  CAST((SELECT count(*) FROM num p WHERE p.trace_id = n.trace_id AND p.g = n.g AND p.child = 1 AND p.k < n.k) AS INTEGER), unit, NULL FROM num n WHERE child = 1
UNION ALL SELECT nz.trace_id, 'counter', ts_ns, uuid, NULL, NULL, NULL, NULL, value
FROM nz JOIN num ON num.trace_id = nz.trace_id AND num.name = nz.counter AND child = 1"""

_G = "WITH " + SHARED + BAR.format(edges="sh")
_EL = "SELECT trace_id, {id} AS id, {label} AS label, {type} AS type, CAST({parent} AS VARCHAR) AS parent, {source} AS source, {target} AS target, {color} AS color, CAST({width} AS DOUBLE) AS width, CAST({dashed} AS BOOLEAN) AS dashed, CAST({count} AS BIGINT) AS count FROM {table}"


def _element(table: str, **values: str) -> str:
    names = "id label type parent source target color width dashed count".split()
    return _EL.format(table=table, **{n: values.get(n, "NULL") for n in names})


_RED = "'#e63946'"
ORACLE["graph_elements"] = _G + """,
n0 AS (SELECT n.*, (SELECT count(*) FROM bnd b WHERE b.trace_id = n.trace_id AND b.d = n.d) AS bufs FROM dsp n),
w0 AS (SELECT *, CASE WHEN source_key % 2 = 0 THEN 'B' ELSE 'R' END AS lab FROM dsp WHERE source_key % 7 = 0)
""" + _UNION.join([
    _element("(SELECT DISTINCT trace_id, cb_idx FROM dsp)", id="'cb_group_' || cb_idx", label="'Command Buffer #' || cb_idx", type="'cluster'"),
    _element("n0", id="'D' || d", type="'dispatch'", parent="'cb_group_' || cb_idx", count="bufs",
             label="'D' || d || ': ' || kernel || CASE WHEN source_key % 9 <> 0 THEN chr(10) || 'tg=' || (source_key % 4 + 1) || 'x1x1' ELSE '' END "
                   "|| chr(10) || 'bufs=' || bufs"),
    _element("w0", id="'barrier' || d", label="lab", type="'barrier'", parent="'cb_group_' || cb_idx"),
    _element("g", id="'e_' || src || '_' || tgt", source="'D' || src", target="'D' || tgt",
             label="CASE WHEN buffer_addr = 0 THEN 'barrier' ELSE dep_type END",
             color=f"CASE WHEN buffer_addr = 0 THEN {_RED} ELSE '#6c757d' END",
             width="CASE WHEN buffer_addr = 0 THEN 2.0 ELSE 1.5 END", dashed="buffer_addr = 0"),
    _element("wall", id="'be_pre_' || src", source="'D' || src", target="'barrier' || src", label="''", color=_RED, width="1.5", dashed="true"),
    _element("wall", id="'be_post_' || src", source="'barrier' || src", target="'D' || tgt", label="''", color=_RED, width="1.5", dashed="true"),
])
ORACLE["graph_elements_encoder"] = _G + COMP.format(c="encoder_idx") + """,
en AS (SELECT c.*, f.cb_idx, max(c.n) OVER (PARTITION BY c.trace_id) AS most,
              (SELECT count(*) FROM dsp b WHERE b.source_key % 7 = 0 AND b.trace_id = c.trace_id AND b.encoder_idx = c.grp) AS walls
       FROM comp c JOIN first_cb f ON f.trace_id = c.trace_id AND f.encoder_idx = c.grp),
own AS (SELECT trace_id, encoder_idx, min_by(cb_idx, d) AS cb FROM dsp GROUP BY ALL),
re AS (SELECT g.trace_id, a.encoder_idx AS s, b.encoder_idx AS t, count(*) AS w, count(DISTINCT g.buffer_addr) AS bufs
       FROM g JOIN dsp a ON a.trace_id = g.trace_id AND a.d = g.src JOIN dsp b ON b.trace_id = g.trace_id AND b.d = g.tgt
       WHERE a.encoder_idx <> b.encoder_idx GROUP BY ALL)
""" + _UNION.join([
    _element("(SELECT DISTINCT trace_id, cb FROM own)", id="'cluster_CB_' || cb", label="'CB #' || cb", type="'cluster'"),
    _element("en", id="'E' || grp", type="'aggregated'", parent="'cluster_CB_' || cb_idx", count="n",
             width="1.5 + 2.5 * (n / greatest(most, 1))",
             label="'Encoder #' || grp || chr(10) || n || ' dispatches' || CASE WHEN walls > 0 THEN ', ' || walls || ' barriers' ELSE '' END "
                   "|| chr(10) || composition"),
    _element("re", id="'e_E' || s || '_E' || t", source="'E' || s", target="'E' || t", label="CAST(w AS VARCHAR)", color="'#6c757d'",
             width="least(1.0 + w / 50.0, 5.0)", dashed="false", count="bufs"),
])

ORACLE["open_trace"] = f"""
SELECT i.trace_id, i.device_name, i.duration_seconds, t.tables, t.num_tables, p.num_processes
FROM ({ORACLE["trace_info"]}) i
LEFT JOIN (SELECT CAST(c_nationkey AS VARCHAR) AS trace_id, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS tables,
                  count(*) AS num_tables FROM customer GROUP BY c_nationkey) t USING (trace_id)
LEFT JOIN (SELECT CAST(p_size AS VARCHAR) AS trace_id, count(*) AS num_processes FROM part GROUP BY p_size) p USING (trace_id)"""
ORACLE["process_names"] = """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 OR p_partkey % 5 = 0 THEN 'Unknown' ELSE p_name END AS name FROM part"""
ORACLE["short_names"] = """
SELECT p_partkey, CASE WHEN length(l) > 25 THEN l[1:22] || '...' ELSE l END AS short,
       CASE WHEN length(l) > 40 THEN l[1:37] || '...' ELSE l END AS label
FROM (SELECT p_partkey, p_type || ' ' || p_name AS l FROM part)"""
ORACLE["table_files"] = "WITH " + DSP + " SELECT trace_id, d AS dispatch_id, kernel, encoder_idx, cb_idx FROM dsp"
ORACLE["event_files"] = ORACLE["trace_events_kernel"]
ORACLE["dep_graph_files"] = f"""
SELECT *, '0x' || lower(to_hex(buffer_addr)) AS buffer FROM ({ORACLE["dep_edges_hazard"]})"""
ORACLE["export_files"] = """
WITH r AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS trace_id,
                  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS row_no FROM customer)
SELECT trace_id, 'accounts' AS schema, row_no, 0 AS position, 'name' AS mnemonic, 'name' AS tag, c_name AS text, NULL AS fmt FROM r
UNION ALL SELECT trace_id, 'accounts', row_no, 1, 'segment', 'segment', '7', c_mktsegment FROM r
UNION ALL SELECT trace_id, 'accounts', row_no, 2, 'key', CASE WHEN c_custkey % 5 = 0 THEN 'sentinel' ELSE 'key' END,
                 CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey AS VARCHAR) END, NULL FROM r"""
ORACLE["capture_files"] = """
SELECT CAST(c_nationkey AS VARCHAR) AS trace_id, c_custkey AS func_idx, CASE WHEN c_custkey % 4 = 0 THEN 'barrier' ELSE 'dispatch' END AS type,
       c_mktsegment AS kernel, c_custkey % 3 AS encoder_idx,
       CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 5 <> 0 THEN 0 ELSE -1 END AS cb_idx FROM customer"""
