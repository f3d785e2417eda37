"""Reachability and longest paths of ordered graphs by a hierarchy of id tiles.

Every edge leads to a larger id. The ids of a recording are cut into tiles of ``tile`` ids. A tile sees the outside only
through its border, the nodes with an edge to or from another tile, so it is summed up by a table between border nodes: a
bit matrix of who reaches whom, or the longest lengths. ``FAN`` neighbouring tiles make a tile of the next level: their
tables are composed along the edges between them, and nodes whose edges all stay inside leave the border. All tiles of a
level are separate groups of one job, and the number of levels is the logarithm of the number of tiles, whatever the
length of the paths.

Recordings of fewer than ``WORD`` ids need no tiles: whom a node reaches fits into one word, so a task judges all recordings
of an Arrow batch together, one id after the other, instead of calling a function for each of them.

A task holds the tables of ``FAN`` tiles, which take the square of the border: the number of edges across a cut of the id
order, not the number of ids, decides. Rows of a table are rows of the stored frame; only the levels pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut_lineage

TILE = 4096
FAN = 8
#: Ids of a recording that is judged by words of 64 bits.
WORD = 64
#: No path.
NONE = -(1 << 30)
_OUT = "kind string, src bigint, tgt bigint, tile bigint, node bigint, low bigint, high bigint, row binary"


def _levels(pairs: DataFrame, tile: int) -> int:
    """Levels above the single tiles until one tile holds every id."""
    last = pairs.agg(F.max("tgt")).first()[0]
    tiles, levels = (last or 0) // tile + 1, 0
    while tiles > 1:
        tiles, levels = -(-tiles // FAN), levels + 1
    return levels


def _reach(pairs: DataFrame, size: int) -> DataFrame:
    """Borders of all nodes that have an edge across tiles of ``size`` ids: lowest source and highest target."""
    crossing = pairs.filter(F.expr(f"src div {size} <> tgt div {size}"))
    ends = crossing.select("trace_id", F.col("src").alias("node"), F.lit(None).cast("bigint").alias("low"), F.col("tgt").alias("high"))
    ends = ends.unionByName(crossing.select("trace_id", F.col("tgt").alias("node"), F.col("src").alias("low"), F.lit(None).cast("bigint").alias("high")))
    return ends.groupBy("trace_id", "node").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _batch(trace, rows: list[tuple], kind: pa.DataType) -> pa.Table:
    """Rows (kind, src, tgt, tile, node, low, high, row) of one group."""
    names = ["kind", "src", "tgt", "tile", "node", "low", "high", "row"]
    types = [pa.string(), *[pa.int64()] * 6, pa.binary()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    arrays = [pa.array([trace] * len(rows), kind), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
    return pa.table(arrays, names=["trace_id", *names])


def _integers(table: pa.Table, name: str, missing: int) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(missing).to_numpy()


class _Part:
    """Border nodes of a tile in id order with their farthest edges."""

    def __init__(self, nodes: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.nodes, self.low, self.high = nodes, low, high

    def at(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nodes, nodes)


def _runs(values: np.ndarray):
    """(first, end) of every run of equal values, which are sorted and not negative."""
    starts = np.flatnonzero(np.diff(values, prepend=-1))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(values)][: len(starts)], strict=True))


def _closed(n: int, src: np.ndarray, tgt: np.ndarray) -> np.ndarray:
    """(n, n) bits, packed by row: which local nodes each local node reaches in one step or more."""
    reach = np.zeros((n, -(-n // 8)), dtype=np.uint8)
    order = np.argsort(src, kind="stable")
    src, tgt = src[order], tgt[order]
    for first, end in reversed(_runs(src)):
        targets = tgt[first:end]
        row = np.bitwise_or.reduce(reach[targets], axis=0)
        np.bitwise_or.at(row, targets >> 3, (128 >> (targets & 7)).astype(np.uint8))
        reach[src[first]] = row
    return reach


def _bit(packed: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    return (packed[row, column >> 3] >> (7 - (column & 7)).astype(np.uint8)) & 1


class Reachability:
    """Tables of bits; an edge is redundant if its source reaches its target on another way, too."""

    def inside(self, base: int, n: int, src: np.ndarray, tgt: np.ndarray, border: _Part):
        """Table between border nodes of a single tile, and its redundant edges."""
        reach = _closed(n, src, tgt)
        # A way over another target: some target of the source reaches the edge's target.
        order = np.argsort(src, kind="stable")
        src, tgt = src[order], tgt[order]
        redundant = np.zeros(len(src), dtype=bool)
        for first, end in _runs(src):
            if end - first > 1:
                behind = np.bitwise_or.reduce(reach[tgt[first:end]], axis=0)[None]
                redundant[first:end] = _bit(behind, np.zeros(end - first, dtype=int), tgt[first:end])
        nodes = border.nodes - base
        table = np.unpackbits(reach[nodes], axis=1)[:, nodes] if len(nodes) else np.zeros((0, 0), dtype=np.uint8)
        table[np.arange(len(nodes)), np.arange(len(nodes))] = 1
        return table, (src[redundant] + base, tgt[redundant] + base)

    def joined(self, a: np.ndarray, b: np.ndarray, src: np.ndarray, tgt: np.ndarray):
        """Table of two neighbours, and which of the edges between them are redundant."""
        steps = np.zeros((len(a), len(b)), dtype=np.float32)
        steps[src, tgt] = 1
        ways = a.astype(np.float32) @ steps @ b.astype(np.float32)
        corner = np.zeros((len(b), len(a)), dtype=np.uint8)
        return np.block([[a, (ways > 0).astype(np.uint8)], [corner, b]]), ways[src, tgt] > 1.5  # the edge itself is one way

    def pack(self, table: np.ndarray) -> list[bytes]:
        return [r.tobytes() for r in np.packbits(table, axis=1)]

    def unpack(self, rows: list[bytes], n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(n, -1), axis=1)[:, :n]


class Longest:
    """Tables of longest lengths, with a first row for paths that start and a first column for paths that end anywhere."""

    def inside(self, base: int, n: int, src: np.ndarray, tgt: np.ndarray, border: _Part):
        nodes = border.nodes - base
        length = np.full((n, len(nodes) + 1), NONE, dtype=np.int32)
        length[:, 0] = 0
        length[nodes, np.arange(len(nodes)) + 1] = 0
        order = np.argsort(tgt, kind="stable")
        src, tgt = src[order], tgt[order]
        for first, end in _runs(tgt):
            node = tgt[first]
            length[node] = np.maximum(length[node], length[src[first:end]].max(axis=0) + 1)
        return np.vstack([length.max(axis=0), length[nodes]]).T, ((), ())

    def joined(self, a: np.ndarray, b: np.ndarray, src: np.ndarray, tgt: np.ndarray):
        into = np.full((len(a), len(b)), NONE, dtype=np.int32)
        for s, t in zip(src.tolist(), tgt.tolist(), strict=True):
            into[:, t + 1] = np.maximum(into[:, t + 1], a[:, s + 1] + 1)
        over = np.full((len(a), len(b)), NONE, dtype=np.int32)
        for k in np.unique(tgt) + 1:
            over = np.maximum(over, into[:, k, None] + b[None, k])
        over = np.where(over < 0, NONE, over)
        # Row and column 0 mean anywhere in either tile; the others are a's nodes, then b's.
        out = np.full((len(a) + len(b) - 1, len(a) + len(b) - 1), NONE, dtype=np.int32)
        out[: len(a), : len(a)], out[: len(a), len(a) :] = a, over[:, 1:]
        out[len(a) :, len(a) :], out[len(a) :, 0] = b[1:, 1:], b[1:, 0]
        out[0, len(a) :] = np.maximum(over[0, 1:], b[0, 1:])
        out[: len(a), 0] = np.maximum(a[:, 0], over[:, 0])
        out[0, 0] = max(out[0, 0], b[0, 0])
        return out, np.zeros(len(src), dtype=bool)

    def pack(self, table: np.ndarray) -> list[bytes]:
        return [r.tobytes() for r in np.ascontiguousarray(table)]

    def unpack(self, rows: list[bytes], n: int) -> np.ndarray:
        return np.frombuffer(b"".join(rows), dtype=np.int32).reshape(n, n).copy()


def _emitted(trace, kind, tables, tile: int, lo: int, hi: int, border: _Part, table: np.ndarray, redundant) -> pa.Table:
    """Rows of one tile: its redundant edges, its longest path, and the table of nodes with edges beyond the tile."""
    rows = [("redundant", s, t, tile, None, None, None, None) for s, t in zip(*(np.asarray(x).tolist() for x in redundant), strict=True)]
    extra = len(table) - len(border.nodes)  # the row of paths that start anywhere
    stays = np.flatnonzero((border.low < lo) | (border.high >= hi))
    held = np.concatenate((np.arange(extra), stays + extra)).astype(int)
    packed = tables.pack(table[np.ix_(held, held)]) if len(held) else []
    if extra:
        rows.append(("anywhere", int(table[0, 0]), None, tile, -1, None, None, packed[0]))
    rows += [("border", None, None, tile, int(border.nodes[i]), int(border.low[i]), int(border.high[i]), packed[extra + k]) for k, i in enumerate(stays)]
    return _batch(trace, rows, kind)


_FAR = np.iinfo(np.int64).max


def _single(tables, tile: int, kind: pa.DataType) -> Callable:
    """Table of one tile from its edges and border nodes."""

    def run(table: pa.Table) -> pa.Table:
        trace, number = table.column("trace_id")[0].as_py(), table.column("tile")[0].as_py()
        base = number * tile
        nodes = table.filter(pa.compute.is_valid(table.column("node"))).sort_by("node")
        border = _Part(_integers(nodes, "node", -1), _integers(nodes, "low", _FAR), _integers(nodes, "high", -1))
        edges = table.filter(pa.compute.is_null(table.column("node")))
        src, tgt = _integers(edges, "src", -1) - base, _integers(edges, "tgt", -1) - base
        used = int(max(tgt.max(initial=-1), (border.nodes - base).max(initial=-1))) + 1  # most recordings fill no tile
        found, redundant = tables.inside(base, used, src, tgt, border)
        return _emitted(trace, kind, tables, number, base, base + tile, border, found, redundant)

    return run


def _composed(tables, size: int, kind: pa.DataType) -> Callable:
    """Table of one tile of the next level, of ``size`` ids, from those of its parts and the edges between them."""

    def run(table: pa.Table) -> pa.Table:
        trace, number = table.column("trace_id")[0].as_py(), table.column("up")[0].as_py()
        edges = table.filter(pa.compute.equal(table.column("kind"), "edge"))
        src, tgt = _integers(edges, "src", -1), _integers(edges, "tgt", -1)
        rows = table.filter(pa.compute.not_equal(table.column("kind"), "edge")).sort_by([("tile", "ascending"), ("node", "ascending")])
        tile, node = _integers(rows, "tile", -1), _integers(rows, "node", -1)
        low, high, packed = _integers(rows, "low", _FAR), _integers(rows, "high", -1), rows.column("row").to_pylist()
        border, found, redundant = None, None, ([], [])
        for first, end in _runs(tile):
            extra = int(node[first] == -1)
            part = _Part(node[first + extra : end], low[first + extra : end], high[first + extra : end])
            own = tables.unpack(packed[first:end], end - first)
            if border is None:
                border, found = part, own
                continue
            inside = np.flatnonzero(np.isin(tgt, part.nodes) & np.isin(src, border.nodes))
            found, doubled = tables.joined(found, own, border.at(src[inside]), part.at(tgt[inside]))
            redundant[0].extend(src[inside][doubled].tolist())
            redundant[1].extend(tgt[inside][doubled].tolist())
            border = _Part(*(np.concatenate((getattr(border, c), getattr(part, c))) for c in ("nodes", "low", "high")))
        if border is None:
            return _batch(trace, [], kind)
        return _emitted(trace, kind, tables, number, number * size, (number + 1) * size, border, found, redundant)

    return run


def _hierarchy(pairs: DataFrame, tables, tile: int) -> list[DataFrame]:
    """Stored outputs of all levels, single tiles first. ``pairs``: stored, distinct (trace_id, src, tgt), src < tgt."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(pairs.schema["trace_id"].dataType)
    schema = f"trace_id {pairs.schema['trace_id'].dataType.simpleString()}, {_OUT}"
    levels = _levels(pairs, tile)
    nothing = F.lit(None).cast("bigint")
    own = F.expr(f"src div {tile}")
    inside = pairs.filter(own == F.expr(f"tgt div {tile}")).select("trace_id", own.alias("tile"), "src", "tgt", nothing.alias("node"), nothing.alias("low"), nothing.alias("high"))
    nodes = _reach(pairs, tile).select("trace_id", F.expr(f"node div {tile}").alias("tile"), nothing.alias("src"), nothing.alias("tgt"), "node", "low", "high")
    single = _single(tables, tile, kind)
    out = [cut_lineage(inside.unionByName(nodes).groupBy("trace_id", "tile").applyInArrow(single, schema))]
    size = tile
    for _ in range(levels):
        up = size * FAN
        between = pairs.filter(F.expr(f"src div {size} <> tgt div {size} and src div {up} = tgt div {up}"))
        edges = between.select("trace_id", F.expr(f"src div {up}").alias("up"), F.lit("edge").alias("kind"), "src", "tgt", *[nothing.alias(c) for c in ("tile", "node", "low", "high")], F.lit(None).cast("binary").alias("row"))
        below = out[-1].filter("kind <> 'redundant'").withColumn("up", F.expr(f"tile div {FAN}"))
        rows = below.select(*edges.columns).unionByName(edges)
        out.append(cut_lineage(rows.groupBy("trace_id", "up").applyInArrow(_composed(tables, up, kind), schema)))
        size = up
    return out


def _split(pairs: DataFrame, tile: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of the recordings whose ids fit into a word, and stored pairs of the others if there are any."""
    limit = min(tile, WORD)
    ends = pairs.groupBy("trace_id").agg(F.min("src").alias("first"), F.max("tgt").alias("last"))
    wide = cut_lineage(ends.filter(f"first < 0 or last >= {limit}").select(F.col("trace_id").alias("wide")))
    if wide.isEmpty():
        return pairs, None
    same = F.col("trace_id").eqNullSafe(F.col("wide"))
    return pairs.join(wide, same, "left_anti"), cut_lineage(pairs.join(wide, same, "left_semi"))


def _whole(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole recordings of batches in which each one's rows follow one another, with the recording's number per row."""
    rest = None
    for batch in source:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        codes = table.column("trace_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        if len(starts):
            number = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(codes)))
            yield table.slice(0, starts[-1]), number[: starts[-1]]
            rest = table.slice(starts[-1])
    if rest is not None:
        yield rest, np.zeros(len(rest), dtype=int)


def _steps(at: np.ndarray, number: np.ndarray, falling: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each id in ``at`` its rows, by recording, and where among them each recording starts."""
    order = np.lexsort((number, -at if falling else at))
    for first, end in _runs(np.cumsum(np.diff(at[order], prepend=-1) != 0)):
        rows = order[first:end]
        yield rows, np.flatnonzero(np.diff(number[rows], prepend=-1))


def _redundant_words(src: np.ndarray, tgt: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Which edges of many recordings another path replaces."""
    reach = np.zeros((int(number.max(initial=-1)) + 1, WORD), dtype=np.uint64)
    redundant = np.zeros(len(src), dtype=bool)
    bit = np.uint64(1) << tgt.astype(np.uint64)
    for rows, starts in _steps(src, number, falling=True):
        own = number[rows[starts]]
        behind = np.bitwise_or.reduceat(reach[number[rows], tgt[rows]], starts)
        reach[own, src[rows[0]]] = behind | np.bitwise_or.reduceat(bit[rows], starts)
        redundant[rows] = np.repeat(behind, np.diff(starts, append=len(rows))) & bit[rows] != 0
    return redundant


def _longest_words(src: np.ndarray, tgt: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Edges on the longest path of each of many recordings."""
    length = np.zeros((int(number.max(initial=-1)) + 1, WORD), dtype=np.int64)
    for rows, starts in _steps(tgt, number, falling=False):
        length[number[rows[starts]], tgt[rows[0]]] = np.maximum.reduceat(length[number[rows], src[rows]], starts) + 1
    return length.max(axis=1)


def _by_words(pairs: DataFrame, judged: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    def run(source):
        for table, number in _whole(source):
            yield from judged(table, number).to_batches()

    rows = pairs.repartition("trace_id").sortWithinPartitions("trace_id")
    return rows.mapInArrow(run, f"trace_id {pairs.schema['trace_id'].dataType.simpleString()}, {schema}")


def _redundant_rows(table: pa.Table, number: np.ndarray) -> pa.Table:
    redundant = _redundant_words(_integers(table, "src", -1), _integers(table, "tgt", -1), number)
    return table.select(["trace_id", "src", "tgt"]).filter(pa.array(redundant))


def _longest_rows(table: pa.Table, number: np.ndarray) -> pa.Table:
    length = _longest_words(_integers(table, "src", -1), _integers(table, "tgt", -1), number)
    names = table.column("trace_id").take(pa.array(np.flatnonzero(np.diff(number, prepend=-1))))
    return pa.table([names, pa.array(length)], names=["trace_id", "critical_path_length"])


def redundant_edges(pairs: DataFrame, tile: int = TILE) -> DataFrame:
    """(trace_id, src, tgt) of edges that another path between their ends replaces."""
    narrow, wide = _split(pairs, tile)
    out = _by_words(narrow, _redundant_rows, "src bigint, tgt bigint")
    for level in [] if wide is None else _hierarchy(wide, Reachability(), tile):
        out = out.unionByName(level.filter("kind = 'redundant'").select("trace_id", "src", "tgt"))
    return out


def longest_paths(pairs: DataFrame, tile: int = TILE) -> DataFrame:
    """(trace_id, critical_path_length): edges on the longest path of each recording that has any."""
    narrow, wide = _split(pairs, tile)
    out = _by_words(narrow, _longest_rows, "critical_path_length bigint")
    if wide is None:
        return out
    top = _hierarchy(wide, Longest(), tile)[-1]
    return out.unionByName(top.filter("kind = 'anywhere'").groupBy("trace_id").agg(F.max("src").alias("critical_path_length")))
