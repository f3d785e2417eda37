"""Registered queries against their reference SQL on the smallest tables.

A selection by default; set TRACEWRIGHT_ALL=1 for every query.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SELECTED = (
    "top_functions samples_in_hangs source_priority timeline_others phases encoders command_buffers kernel_summary dep_graph "
    "dep_summary rollup_cb_nodes recommendations counter_matrix trace_events_cb track_packets counter_tracks graph_elements "
    "ref_expand table_query byte_profile small_groups presence presence_pairs barrier_numbering encoder_gaps fusion_candidates top_functions_range"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_reference_sql():
    """Corpus queries without SQL have tests of their own."""
    own = {name for name, function in entry_points.queries().items() if function.__module__.startswith("tracewright.plans")}
    assert own <= set(entry_points.oracle_sql())


def test_flagship_query_runs(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(entry_points.oracle_sql()) if os.environ.get("TRACEWRIGHT_ALL") else SELECTED)
def test_query_equals_reference_sql(spark, duck, key):
    found = entry_points.queries()[key](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    cursor = duck.execute(entry_points.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
