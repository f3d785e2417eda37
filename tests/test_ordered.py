import random

from pyspark.sql import functions as F

from tracewright.operators.ordered import index_chunk, number_rows, placed, rank_rows, scan, time_chunk


def _rows(seed, keys=3, n=200):
    rng = random.Random(seed)
    return [(rng.randrange(keys), pos, rng.choice([None, None, rng.randrange(100)])) for pos in rng.sample(range(1000), n)]


def _expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted(r[1:] for r in rows if r[0] == key)
        for i, (pos, value) in enumerate(mine):
            before = [v for _, v in mine[:i] if v is not None]
            upto = [v for _, v in mine[: i + 1] if v is not None]
            after = [v for _, v in mine[i + 1 :] if v is not None]
            out[key, pos] = (
                sum(v or 0 for _, v in mine[: i + 1]), i, before[-1] if before else None, upto[-1] if upto else None,
                after[0] if after else None,
            )
    return out


def test_scan_is_the_same_for_any_chunk_size(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "k int, pos bigint, v int")
    value = F.col("v")
    for size in (7, 64, 100000):
        got = scan(
            df, ["k"], "pos", index_chunk("pos", size), sums={"total": value}, sums_before={"n": F.lit(1)},
            last_before={"prev": value}, last={"cur": value}, next_after={"next": value},
        )
        assert {(r.k, r.pos): (r.total, r.n, r.prev, r.cur, r.next) for r in got.collect()} == _expected(rows)


def test_time_chunks_keep_order_when_one_sequence_is_crowded(spark):
    rng = random.Random(3)
    # A third of all rows crowd into a short burst of one key.
    times = rng.sample(range(10**6), 150) + [500000 + i for i in range(100)]
    rows = [(0 if i > 100 else 1, t) for i, t in enumerate(dict.fromkeys(times))]
    df = spark.createDataFrame(rows, "k int, t bigint")
    chunked = time_chunk(df, ["k"], "t", rows=20)
    sizes = [r["count"] for r in chunked.groupBy("k", "_chunk").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 60
    got = {(r.k, r.t): r.n for r in number_rows(chunked, ["k"], "t", "n").collect()}
    for key in (0, 1):
        assert [got[key, t] for t in sorted(t for k, t in rows if k == key)] == list(range(sum(k == key for k, _ in rows)))


def test_ranks_where_most_rows_have_one_value(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 1, None]), rng.choice([1, 1, 1, 1, 7, None]), f"n{i:04}") for i in range(600)]
    df = spark.createDataFrame(rows, "k int, w bigint, name string").repartition(5)
    got = {r.name: (r.k, r.rank) for r in rank_rows(df, ["k"], [-F.col("w"), F.col("name")]).collect()}
    for key in (0, 1, None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, -(r[1] or 0), r[2]))
        assert [got[r[2]] for r in mine] == [(key, i + 1) for i in range(len(mine))]
    assert rank_rows(df.limit(0), ["k"], [F.col("w"), F.col("name")]).collect() == []


def test_equal_values_are_dealt_over_ranges(spark):
    df = spark.range(4000).select(F.lit(1).alias("w"), "id").repartition(4)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in placed(df, ["w", "id"]).groupBy(F.shiftright("_at", 33)).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(sizes) == 4 and max(sizes) < 1500


def test_rows_of_one_chunk_need_no_carry_side(spark):
    """Short sequences are scanned alone; chunks that differ are carried over."""
    rows = spark.createDataFrame([(k, pos, 10 * k + pos) for k in range(3) for pos in range(4)], "k int, pos bigint, v int")
    values = {"sums_before": {"n": F.lit(1)}, "last_before": {"v0": F.col("v")}, "next_after": {"v1": F.col("v")}}
    expected = {(k, p, p, 10 * k + p - 1 if p else None, 10 * k + p + 1 if p < 3 else None) for k in range(3) for p in range(4)}
    chunks = {False: [index_chunk("pos"), F.lit(None).cast("bigint")], True: [index_chunk("pos", 2)]}
    for joins, columns in chunks.items():
        for chunk in columns:
            found = scan(rows, ["k"], "pos", chunk, **values)
            assert {(r.k, r.pos, r.n, r.v0, r.v1) for r in found.collect()} == expected
            assert ("Join" in found._jdf.queryExecution().analyzed().toString()) == joins
