"""SimHash near copies through an inverted index over byte positions with count filtering.

A fingerprint has 64 bits, one per majority vote of the hashed three-word shingles. Two fingerprints that differ in at
most ``bits`` = 2 bits differ in at most 2 of their 8 bytes, so they share at least 6 positional bytes. One posting list
per (position, byte) would make every pair meet that shares one byte, about a 32nd of all pairs. The count filter is
therefore part of the key: a list is kept for every set of 6 positions with its 6 bytes (28 sets), so exactly the pairs
whose tally of shared positional bytes reaches 6 meet. Only the two other bytes differ within a list: at most 65,536
distinct fingerprints, which bounds what one list can gather, whatever the number of documents. A list is verified
against bit masks (137 values within 2 bits of any value), not pair by pair, so even a full list costs in proportion to
its length, and every link between different fingerprints is found. Equal fingerprints form one class and are never
expanded into pairs.

Texts of fewer than three words have one shingle, the whole sequence. Null or wordless texts have fingerprint zero,
which links like any other. Repeated rows keep their own row. Rows without an id get the component of the rows with
their fingerprint; a fingerprint of which no row has an id links with nothing and has a null component. Further columns
are ignored, and empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import components, stored

SEED = 42
BYTES = 8


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z is lowered, only the six ASCII blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], dtype=np.uint64)
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    source = docs.select(key, F.col(text).alias("text"))

    def run(source):
        for batch in source:
            found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found.view(np.int64))], [key, "fp"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, fp long")


def _postings(classes: DataFrame, bits: int) -> DataFrame:
    """(places, bytes, members): posting lists with at least two fingerprints; a member is (the other bytes, rep)."""
    shared = []
    for places in combinations(range(BYTES), BYTES - bits):
        mask = sum(0xFF << (8 * p) for p in places)
        signed = mask - (1 << 64) if mask >> 63 else mask
        shared.append(F.struct(F.lit(signed).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bytes")))
    listed = classes.select("fp", "rep", F.explode(F.array(*shared)).alias("posting")).select("posting.*", "fp", "rep")
    lists = listed.groupBy("mask", "bytes").agg(F.collect_list(F.struct("fp", "rep")).alias("members"))
    return lists.where(F.size("members") > 1)


def _near_masks(bits: int, width: int) -> np.ndarray:
    """All differences of ``width`` bits with 1 to ``bits`` bits set."""
    return np.array([reduce(lambda a, b: a | 1 << b, places, 0) for n in range(1, bits + 1) for places in combinations(range(width), n)])


def _list_links(values: np.ndarray, reps: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a list whose remaining bytes differ by one of ``masks``, each pair once."""
    order = np.argsort(values)
    values, reps = values[order], reps[order]
    out = []
    for mask in masks:
        wanted = values ^ mask
        place = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        hit = np.flatnonzero((values[place] == wanted) & (values < wanted))
        out.append(np.stack([reps[hit], reps[place[hit]]]))
    return tuple(np.concatenate(out, axis=1))


def links(classes: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b): representatives of distinct fingerprints at ``bits`` or fewer differing bits; each pair once.

    ``classes``: one row per fingerprint ``fp`` with its representative ``rep`` (long).
    """

    def run(source):
        for batch in source:
            masks, left, right = batch.column("mask").to_numpy(), [], []
            for mask, members in zip(masks, batch.column("members"), strict=True):
                fps = members.values.field("fp").to_numpy().view(np.uint64)
                reps = members.values.field("rep").to_numpy()
                free = ~np.int64(mask).view(np.uint64)
                other = fps & free
                if len(fps) <= 64:
                    a, b = np.triu_indices(len(fps), 1)
                    near = np.bitwise_count(other[a] ^ other[b]) <= bits
                    left.append(reps[a[near]])
                    right.append(reps[b[near]])
                else:
                    places = np.array([p for p in range(64) if int(free) >> p & 1], dtype=np.uint64)
                    spread = [np.uint64(sum(1 << int(places[i]) for i in range(len(places)) if m >> i & 1)) for m in _near_masks(bits, len(places)).tolist()]
                    a, b = _list_links(other, reps, spread)
                    left.append(a)
                    right.append(b)
            left, right = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], ["a", "b"])

    return _postings(classes, bits).select("mask", "members").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 2) -> DataFrame:
    """(key, fp, component_id), one row per document; component_id is the smallest key reachable over links."""
    prints = stored(fingerprints(docs, key, text))
    classes = stored(prints.groupBy("fp").agg(F.min(key).cast("long").alias("rep")))
    joined = components(links(classes.where("rep is not null"), bits))
    labels = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(labels, "fp").select(key, "fp", "component_id")


def report(docs: DataFrame, **options) -> DataFrame:
    found = near_copies(docs, "doc_id", **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id; of several rows with that id one stays.

    Rows without an id cannot be told apart by it and stay.
    """
    found = near_copies(docs, key, **options)
    firsts = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    return docs.join(firsts, key, "left_semi").dropDuplicates([key]).select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))
