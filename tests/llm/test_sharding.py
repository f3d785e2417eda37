import duckdb
import pytest

from tracewright.llm import sharding
from tracewright.llm.queries import sharding_sql


@pytest.mark.parametrize("limit", [60, 400, 10**6])
def test_directory_equals_sql(spark, documents, limit):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(150)] + [(900, None), (901, "y" * 1000)]
    found = sharding.assign(documents(rows), limit=limit)
    names = sorted(found.columns)
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    cursor = connection.execute(sharding_sql(limit))
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())


def test_a_key_with_most_rows_is_spread(spark, documents):
    rows = [(None, "x" * 30)] * 60 + [(1, None), (2, "z" * 500), (2, "z" * 500)]
    found = sharding.assign(documents(rows), limit=100).collect()
    assert len(found) == len(rows)
    sizes = {}
    for r in found:
        sizes.setdefault(r.shard, []).append(r.n_bytes)
        assert r.shard_bytes <= 100 or r.shard_rows == 1
    assert all(sum(v) == next(r.shard_bytes for r in found if r.shard == s) for s, v in sizes.items())
    shards = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))


def test_written_shards_hold_every_document_within_the_limit(spark, documents, tmp_path):
    rows = [(i % 70, "x" * (i * 7 % 90)) for i in range(150)] + [(900, None), (901, "y" * 1000), (None, "z" * 40)]
    docs = documents(rows).selectExpr("*", "1 AS shard", "2 AS n_bytes", "3 AS row")
    directory = {r.shard: (r.shard_bytes, r.shard_rows) for r in sharding.write(docs, str(tmp_path / "out"), limit=400).collect()}
    files = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    assert sorted(map(str, files.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    for folder in (tmp_path / "out").glob("shard*=*"):
        texts = [r.text or "" for r in spark.read.parquet(str(folder)).collect()]
        assert directory[folder.name.split("=")[1][1:]] == (sum(map(len, texts)), len(texts))
        assert sum(map(len, texts)) <= 400 or len(texts) == 1
    assert len(directory) > 10


def test_no_rows(spark, documents):
    assert sharding.assign(documents([])).count() == 0


def test_plan_has_no_python(spark, documents):
    plan = sharding.assign(documents([(1, "a"), (2, "b")]), limit=1)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
