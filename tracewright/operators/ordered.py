"""Running values along long ordered sequences, computed in bounded chunks.

A plain window over ``trace_id`` would put one recording into one task. Here each sequence is cut into chunks of its
order key. Windows run per (keys, chunk); one small row per chunk carries running sums and nearest values across the
chunk borders. Only sequences with more than one chunk produce carry rows. Tables of ordinary recordings have one chunk
number in all; a look at it then spares the carry side, which would group the whole table to find no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut_lineage

CHUNK = 1 << 17


def index_chunk(index: str | Column, rows: int = CHUNK) -> Column:
    """Chunk number of a call-log style index: at most ``rows`` distinct positions share a chunk."""
    column = F.col(index) if isinstance(index, str) else index
    return F.floor(column / F.lit(rows)).cast("bigint")


_CUTS, _BLOCK = 1024, 32
#: Position of the range number in ``monotonically_increasing_id``.
_RANGE_BITS = 33
#: Numbers in one array of ``each_between``.
_SPAN = 4096


def time_chunk(df: DataFrame, keys: Sequence[str], ts: str, rows: int = CHUNK) -> DataFrame:
    """Add ``_chunk``: sequences longer than ``rows`` are cut at quantiles of ``ts``, whatever their density.

    Sequences are counted first; quantiles are only taken of the long ones, and only their rows look up a cut. A chunk
    is named by the cut it starts at, so chunk order is time order. Equal times always share a chunk. The result is
    stored, because the scans behind it read it more than once.
    """
    long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows).select(*keys)
    # One constant instead of a thousand expressions for the optimizer to walk.
    shares = F.from_json(F.lit(str([i / _CUTS for i in range(_CUTS)])), "array<double>")
    cuts = df.join(long, list(keys), "left_semi").groupBy(*keys).agg(
        F.percentile_approx(ts, shares, 10 * _CUTS).alias("_cuts")
    )
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: i % _BLOCK == 0))
    behind = F.size(F.filter("_coarse", lambda c: c <= F.col(ts)))
    block = F.slice("_cuts", F.greatest(behind - 1, F.lit(0)) * _BLOCK + 1, F.lit(_BLOCK))
    start = F.array_max(F.filter(block, lambda c: c <= F.col(ts)))
    # Rows before the first cut, and sequences without cuts, share the lowest chunk.
    chunk = F.coalesce(start.cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    chunked = df.join(cuts, list(keys), "left").select(*df.columns, chunk.alias("_chunk"))
    return cut_lineage(chunked)


def _one_chunk(df: DataFrame) -> bool:
    """Whether all rows share a chunk, so that no sequence has a border to carry values over."""
    found = df.agg(F.min("_chunk").alias("low"), F.max("_chunk").alias("high"), F.count("_chunk").alias("known"), F.count(F.lit(1)).alias("rows")).first()
    return found.known == 0 or (found.low == found.high and found.known == found.rows)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    chunk: Column | None = None,
    *,
    sums: Mapping[str, Column] | None = None,
    sums_before: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    next_after: Mapping[str, Column] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Add running columns along ``order`` (a unique BIGINT column) within ``keys``.

    ``sums`` include the row, ``sums_before`` do not. ``last`` and ``last_before`` give the latest non-null value up to
    or before the row, ``next_after`` the first non-null value behind it. With ``chunk`` None the frame must already
    carry ``_chunk`` and keeps it, so a following scan needs no new shuffle. ``bounded`` says that no sequence is longer
    than one chunk, which drops the carry side; so does a look at the chunks themselves if there is only one. The input is
    read more than once otherwise, so it should be a stored table or a frame whose lineage was cut.
    """
    sums, sums_before = dict(sums or {}), dict(sums_before or {})
    last, last_before, next_after = dict(last or {}), dict(last_before or {}), dict(next_after or {})
    totals = {**sums, **sums_before}
    latest = {**last, **last_before}
    inputs = {f"_in_{name}": expr for name, expr in {**totals, **latest, **next_after}.items()}
    if chunk is not None:
        inputs["_chunk"] = chunk
    elif bounded and "_chunk" not in df.columns:
        inputs["_chunk"] = F.lit(0).cast("bigint")
    base = df.withColumns(inputs)
    part = [*keys, "_chunk"]
    bounded = bounded or _one_chunk(base)

    whole = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is looking back along the reverse order: a frame that ends at the partition end would be quadratic.
    behind = Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = base.select(
        *[c for c in base.columns if not c.startswith("_in_")],
        *[F.coalesce(F.sum(f"_in_{n}").over(whole), F.lit(0)).alias(f"_lo_{n}") for n in sums],
        *[F.coalesce(F.sum(f"_in_{n}").over(before), F.lit(0)).alias(f"_lo_{n}") for n in sums_before],
        *[F.last(f"_in_{n}", True).over(whole).alias(f"_lo_{n}") for n in last],
        *[F.last(f"_in_{n}", True).over(before).alias(f"_lo_{n}") for n in last_before],
        *[F.last(f"_in_{n}", True).over(behind).alias(f"_lo_{n}") for n in next_after],
    )

    if bounded:
        return local.select(*df.columns, *[F.col(f"_lo_{n}").alias(n) for n in {**totals, **latest, **next_after}])

    def at(name: str) -> Column:
        return F.when(F.col(f"_in_{name}").isNotNull(), F.col(order))

    chunks = base.select(*part, order, *[c for c in inputs if c != "_chunk"]).groupBy(*part).agg(
        *[F.sum(f"_in_{n}").alias(f"_ch_{n}") for n in totals],
        *[F.max_by(F.col(f"_in_{n}"), at(n)).alias(f"_ch_{n}") for n in latest],
        *[F.min_by(F.col(f"_in_{n}"), at(n)).alias(f"_ch_{n}") for n in next_after],
        F.count(F.lit(1)).alias("_rows"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        chunks.withColumn("_chunks", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .filter("_chunks > 1")
        .select(
            *part,
            *[F.sum(f"_ch_{n}").over(earlier).alias(f"_ca_{n}") for n in totals],
            *[F.last(f"_ch_{n}", True).over(earlier).alias(f"_ca_{n}") for n in latest],
            *[F.last(f"_ch_{n}", True).over(later).alias(f"_ca_{n}") for n in next_after],
        )
    )
    joined = local.join(carry, part, "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"_lo_{n}") + F.coalesce(F.col(f"_ca_{n}"), F.lit(0))).alias(n) for n in totals],
        *[F.coalesce(F.col(f"_lo_{n}"), F.col(f"_ca_{n}")).alias(n) for n in {**latest, **next_after}],
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: str, name: str, chunk: Column | None = None) -> DataFrame:
    """Zero-based dense position along ``order`` within ``keys``."""
    return scan(df, keys, order, chunk, sums_before={name: F.lit(1).cast("bigint")})


def placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``_at``, which rises along ``order`` over the whole table: partition number, then position within it.

    One shuffle into ranges of ``order`` and a sort within them. ``order`` should settle ties, so that even equal values
    are dealt over many ranges. Stored, because a range that is computed anew may be numbered otherwise.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(ranges.withColumn("_at", F.monotonically_increasing_id()))


def at_range(at: str = "_at") -> Column:
    """The range of a row of ``placed``."""
    return F.shiftright(at, _RANGE_BITS)


def at_cell(rows: int, at: str = "_at") -> Column:
    """Number of the cell of ``rows`` rows within the range."""
    return F.floor((F.col(at) - F.shiftleft(at_range(at), _RANGE_BITS)) / F.lit(rows)).cast("bigint")


def each_between(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """One row per number ``name`` from ``first`` to ``last``, in two steps of bounded arrays."""
    blocks = F.sequence(F.expr(f"{first} div {_SPAN}"), F.expr(f"{last} div {_SPAN}"))
    blocked = df.filter(F.col(last) >= F.col(first)).withColumn("_block", F.explode(blocks))
    low = F.greatest(F.col(first), F.col("_block") * F.lit(_SPAN))
    high = F.least(F.col(last), F.col("_block") * F.lit(_SPAN) + F.lit(_SPAN - 1))
    return blocked.withColumn(name, F.explode(F.sequence(low, high))).drop("_block")


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Rank from 1 within ``keys`` along ``order``, ascending with nulls first; its last columns must settle ties.

    Rows are dealt into ranges of the whole order, ties included, so a million rows of one value share no task. A range
    hands on the number of its rows; there is one such row per key and range that meet.
    """
    by = [f"_by{i}" for i in range(len(order))]
    rows = placed(df.withColumns(dict(zip(by, order, strict=True))), [*keys, *by]).drop(*by).withColumn("_range", at_range())
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_from") + 1
    pieces = pieces.select(
        *[F.col(key).alias(f"_key{i}") for i, key in enumerate(keys)], F.col("_range").alias("_piece"), shift.alias("_shift")
    )
    same = F.col("_range") == F.col("_piece")
    for i, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(pieces, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
