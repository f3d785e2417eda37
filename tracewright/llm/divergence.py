"""Source divergence audit: how far each source's word use is from every other source and from its whole language.

Terms are runs of ASCII letters and of all characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms
that at least ``min_docs`` of its documents hold, V of them. Each group (language, source) and each whole language gives
every kept term p = 1 + floor(10^9 (count + 1) / (N + V)), N being its count over kept terms; a term that does not occur
has the group's floor p0. The divergence of p from q is f = floor((p - q)^2 / q).

The sum over all kept terms for a pair of groups is taken in three parts, so that no term that both lack, and no pair of
postings, becomes a row:

* baseline: V times f(p0, q0);
* one side alone: what each occurring term of one group adds where the other has its floor. p depends on the count alone,
  so a group is a short histogram of its p, held against blocks of its peers' floors;
* both sides: each group scatters its terms through the term-major index into one dense accumulator over its peers,
  block of terms by block of terms, and corrects the two one-sided values that counted the term with a floor.

All numbers are whole. Sums stay inside a long for up to 10^9 kept terms, since p adds up to about 10^9 in every group.

Null text, language and source are empty strings. Documents without terms, and empty texts, still make their group occur.
Repeated rows count as often as they stand there. A language without kept terms has V = 0: its pairs have the value 0 and
it has no ``term`` rows. Ties go by the UTF-8 bytes of the item. Further columns are ignored, and an empty table gives no
rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import arrays, stored

UNIT = 1_000_000_000
#: Distinct terms a counting task holds before it hands its counts on.
HELD_TERMS = 400_000
#: Postings of one block of the term-major index, unless a single term has more.
BLOCK_ROWS = 200_000
#: Peers in a block of floors.
PEERS = 256
#: Lower-cased byte of a term, or a blank. All bytes of characters beyond ASCII belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_GROUP = ["lang", "source"]
_PAIR = "lang string, source string, item string, value long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a group; a null term for the group itself."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    source = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in _GROUP], text.alias("text"))

    def rows(counts, marks):
        for (lang, name), (n, docs) in counts.items():
            terms = pa.array([*n], pa.binary()).cast(pa.string())
            sums = pa.array([*n.values()], pa.int64()), pa.array([docs[t] for t in n], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([name] * len(n), pa.string()), terms, *sums], ["lang", "source", "term", "n", "docs"])
        if marks:
            langs, names = (pa.array([m[i] for m in marks], pa.string()) for i in (0, 1))
            zeros = pa.array([0] * len(marks), pa.int64())
            yield pa.RecordBatch.from_arrays([langs, names, pa.nulls(len(marks), pa.string()), zeros, zeros], ["lang", "source", "term", "n", "docs"])

    def run(source):
        counts, marks, held = {}, set(), 0
        for batch in source:
            for lang, name, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                marks.add((lang, name))
                if (lang, name) not in counts:
                    counts[lang, name] = Counter(), Counter()
                n, docs = counts[lang, name]
                terms = text.translate(_FOLD).split()
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
                if held >= HELD_TERMS:
                    yield from rows(counts, ())
                    counts, held = {}, 0
            if len(marks) >= HELD_TERMS:
                yield from rows({}, marks)
                marks = set()
        yield from rows(counts, marks)

    found = source.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    # Tasks have combined their counts, so one shuffle by term serves both the sums and all that looks along a term.
    return found.repartition("lang", "term").groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) for whole numbers of any size; null for a total of zero."""
    scaled = count.cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    large = F.call_function("div", scaled, total.cast("decimal(20,0)"))
    small = F.call_function("div", count * UNIT, total)
    return F.when((total > 0) & (count < UNIT), small + 1).when(total > 0, large + 1)


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _scatter(source):
    """Corrections of term pairs. Rows: lang, source, p, floor, opens; postings of a term together, the first one ``opens``."""

    def block(table: pa.Table):
        langs, names = (table.column(c).combine_chunks().dictionary_encode() for c in _GROUP)
        codes = langs.indices.to_numpy().astype(np.int64) * len(names.dictionary) + names.indices.to_numpy()
        groups, at = np.unique(codes, return_inverse=True)
        p, floor = table.column("p").to_numpy(), table.column("floor").to_numpy()
        starts = np.flatnonzero(table.column("opens").to_numpy())
        lengths = np.diff(np.append(starts, len(p)))
        term = np.repeat(np.arange(len(starts)), lengths)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=len(groups)))
        for own, end in enumerate(ends):
            mine = order[end - np.count_nonzero(at == own) : end]
            met = lengths[term[mine]]
            other, me = np.repeat(starts[term[mine]], met) + arrays(met), np.repeat(mine, met)
            value = _distance(p[me], p[other]) - _distance(p[me], floor[other]) - _distance(floor[me], p[other]) + _distance(floor[me], floor[other])
            peers = np.zeros(len(groups), dtype=np.int64)
            np.add.at(peers, at[other], value)
            peers[own] = 0
            hit = np.flatnonzero(peers)
            lang, name = divmod(int(groups[own]), len(names.dictionary))
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs.dictionary[lang].as_py()] * len(hit), pa.string()), pa.array([names.dictionary[name].as_py()] * len(hit), pa.string()),
                 names.dictionary.take(pa.array(groups[hit] % len(names.dictionary))), pa.array(peers[hit])], ["lang", "source", "item", "value"],
            )

    held, size = [], 0
    for batch in source:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(table.column("opens").to_numpy())[-1])
            if cut:
                yield from block(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size -= cut
    if size:
        yield from block(pa.Table.from_batches(held))


def _against_floors(source):
    """Baseline and one-sided values. Rows: a group with its histogram, and a block of peers with their floors."""
    for batch in source:
        for lang, name, kept, floor, held, peers in zip(*(batch.column(c) for c in ("lang", "source", "kept", "floor", "held", "peers")), strict=True):
            items, kept = peers.values.field("source"), kept.as_py()
            ahead, back = np.zeros((2, len(items)), dtype=np.int64)
            if kept:
                floor, floors = floor.as_py(), peers.values.field("floor").to_numpy()
                ahead += kept * _distance(floor, floors)
                if held.is_valid:
                    p, n = held.values.field("p").to_numpy(), held.values.field("n").to_numpy()
                    for at in range(0, len(p), 4096):
                        some, times = p[at : at + 4096, None], n[at : at + 4096, None]
                        ahead += ((_distance(some, floors) - _distance(floor, floors)) * times).sum(axis=0)
                        back += ((_distance(floors, some) - _distance(floors, floor)) * times).sum(axis=0)
            own = pa.array([name.as_py()] * len(items), pa.string())
            langs = pa.array([lang.as_py()] * len(items), pa.string())
            for one, other, value in ((own, items, ahead), (items, own, back)):
                yield pa.RecordBatch.from_arrays([langs, one, other, pa.array(value)], ["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for all peers, ``term`` rows for the ``top`` terms above the language."""
    of_term = Window.partitionBy("lang", "term")
    summed = term_counts(docs).select("*", F.sum("docs").over(of_term).alias("held_by"), F.sum("n").over(of_term).alias("lang_n"))
    counts = stored(summed.where((F.col("held_by") >= min_docs) | F.col("term").isNull()).select(*_GROUP, "term", "n", "lang_n"))
    kept = counts.where("term is not null")
    words = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select(*_GROUP).join(words, "lang", "left").join(totals, _GROUP, "left").na.fill(0, ["kept", "lang_total", "total"])
    groups = stored(groups.withColumn("floor", _share(F.lit(1), F.col("total") + F.col("kept"))))
    # Groups are few rows beside the postings; adaptive execution picks the join from their measured size.
    # Three steps read the shares; computing them anew costs less than another copy of the index.
    shares = kept.join(groups, _GROUP).select(*_GROUP, "term", _share(F.col("n") + 1, F.col("total") + F.col("kept")).alias("p"), "floor", _share(F.col("lang_n") + 1, F.col("lang_total") + F.col("kept")).alias("q"))

    opens = F.row_number().over(of_term.orderBy("source")) == 1
    both = shares.select(*_GROUP, "p", "floor", opens.alias("opens")).mapInArrow(_scatter, _PAIR)
    histogram = shares.groupBy(*_GROUP, "p").agg(F.count("*").alias("n")).groupBy(*_GROUP).agg(F.collect_list(F.struct("p", "n")).alias("held"))
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / PEERS).alias("blocks"))
    blocks = groups.join(sizes, "lang").groupBy("lang", F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"))
    peers = blocks.agg(F.collect_list(F.struct("source", "floor")).alias("peers")).select("lang", "peers")
    alone = groups.join(histogram, _GROUP, "left").join(peers, "lang").select(*_GROUP, "kept", "floor", "held", "peers").mapInArrow(_against_floors, _PAIR)
    pairs = alone.where("source <> item").unionByName(both).groupBy(*_GROUP, "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))

    by_value = Window.partitionBy(*_GROUP).orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    terms = shares.where("p > q").select(*_GROUP, F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    out = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*out).unionByName(terms.withColumn("part", F.lit("term")).select(*out))
