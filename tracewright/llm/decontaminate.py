"""Benchmark decontamination by winnowing.

Words are runs of letters, digits and non-ASCII characters after A-Z is lower-cased. Of every ``window`` neighbouring
k-grams the one with the smallest hash is a fingerprint (k + window - 1 = ``span``), so any shared run of ``span`` words
shares a fingerprint. Items with fewer words have no such run: an item of n < ``span`` words has one fingerprint, the
hash of all its words, and documents offer their n-grams for exactly the lengths n that occur among the items.

Fingerprints of documents and items are joined by hash; each pair that meets is extended: the item's windows are looked
up in the document word by word, so a hash collision never counts. If the items' fingerprints are few (``filter_rows``,
checked by a count), tasks skip fingerprints that no item has before the join. Beyond that all fingerprints go
through the shuffle, with the same rows as the result.

Null or wordless texts have no words and no hits. Items without an id or without words are left out; an item id that
occurs on several rows is one item with the windows of all of them. Repeated documents each get their own row. Further
columns are ignored. Empty tables give no hits or no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrays, free_name, running_hash, span_hashes, stored, text_blocks

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Lower-cased byte, or 0 for bytes outside words.
_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def words(text: str | None) -> list[bytes]:
    """The words of one text."""
    return _WORD.findall((text or "").encode().lower())


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and the number of words of each text."""
    raw = [text.encode() for text in texts]
    folded = _FOLD[np.frombuffer(b"\x00".join(raw) + b"\x00", dtype=np.uint8)]
    inside = np.concatenate(([False], folded != 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return span_hashes(running_hash(folded), start, end), counts


def _grams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams that lie in one text, and the number of them in each text."""
    each = np.maximum(counts - n + 1, 0)
    first = np.repeat(np.cumsum(counts) - counts, each) + arrays(each)
    if not len(first):
        return np.empty(0, dtype=np.uint64), each
    return span_hashes(running_hash(hashes), first, first + n), each


def _minima(grams: np.ndarray, each: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest gram) of every window; windows never cross texts, and a value that stays is given once."""
    full = np.maximum(each - window + 1, 0)
    if not full.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    least, width = grams, 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    rows = np.repeat(np.arange(len(each)), full)
    found = least[np.repeat(np.cumsum(each) - each, full) + arrays(full)]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], found[new]


def _signed(hashes: np.ndarray, n: int) -> np.ndarray:
    """Keep fingerprints of different lengths apart."""
    return (hashes ^ np.uint64(n * 0x9E3779B1)).view(np.int64)


def fingerprints(hashes: np.ndarray, counts: np.ndarray, lengths: Iterable[int], span: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, fingerprint) arrays: winnowed k-grams for runs of ``span`` words, whole n-grams for shorter ``lengths``."""
    rows, least = _minima(*_grams(hashes, counts, k), span - k + 1)
    yield rows, _signed(least, 0)
    for n in lengths:
        grams, each = _grams(hashes, counts, n)
        yield np.repeat(np.arange(len(counts)), each), _signed(grams, n)


def item_fingerprints(items: DataFrame, span: int = 10, k: int = 4) -> DataFrame:
    """(item_id, n, fp) of every item; n is its number of words where that is below ``span``, else 0."""
    source = items.select("item_id", "text").where("item_id is not null")
    kind = source.schema["item_id"].dataType.simpleString()

    def run(source):
        for batch in source:
            ids, out = batch.column("item_id"), []
            for row, text in enumerate(batch.column("text").to_pylist()):
                hashes, counts = _word_hashes([text or ""])
                n = len(hashes)
                if n >= span:
                    out += [(row, 0, fp) for fp in np.unique(next(fingerprints(hashes, counts, (), span, k))[1]).tolist()]
                elif n:
                    out.append((row, n, int(_signed(_grams(hashes, counts, n)[0], n)[0])))
            rows, lengths, fps = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(lengths, pa.int32()), pa.array(fps, pa.int64())], ["item_id", "n", "fp"])

    return source.mapInArrow(run, f"item_id {kind}, n int, fp long")


def _document_fingerprints(docs: DataFrame, key: str, lengths: list[int], keep: np.ndarray | None, span: int, k: int) -> DataFrame:
    """(key, n_words, fps, text): distinct fingerprints that may meet an item; the text only where there are some."""
    source = docs.select(key, "text")
    kind = source.schema[key].dataType.simpleString()
    kept = docs.sparkSession.sparkContext.broadcast(keep) if keep is not None else None

    def run(source):
        for batch in source:
            texts = batch.column("text").to_pylist()
            for start, block in text_blocks(texts):
                hashes, counts = _word_hashes(block)
                found = []
                for rows, fps in fingerprints(hashes, counts, lengths, span, k):
                    if kept is not None:
                        place = np.minimum(np.searchsorted(kept.value, fps), max(len(kept.value) - 1, 0))
                        hit = kept.value[place] == fps if len(kept.value) else np.zeros(len(fps), dtype=bool)
                        rows, fps = rows[hit], fps[hit]
                    found.append(np.stack([rows.astype(np.int64), fps], axis=1))
                pairs = np.unique(np.concatenate(found), axis=0)
                offsets = np.searchsorted(pairs[:, 0], np.arange(len(block) + 1)).astype(np.int32)
                fps = pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs[:, 1]))
                shown = pa.array([t if a < b else None for t, a, b in zip(block, offsets[:-1], offsets[1:], strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(start, len(block)), pa.array(counts, pa.int64()), fps, shown], [key, "n_words", "fps", "text"])

    return source.mapInArrow(run, f"{key} {kind}, n_words long, fps array<bigint>, text string")


def hit_words(text: str | None, items: Iterable[tuple[object, str | None]], span: int = 10) -> tuple[np.ndarray, list]:
    """Which words of a text lie in a window of an item (bool each), and the ids of the items with such a window."""
    own, hits, ids = words(text), None, []
    hits = np.zeros(len(own) + 1, dtype=np.int64)
    places: dict[int, dict[tuple, list[int]]] = {}
    for item_id, item in items:
        other = words(item)
        n = min(span, len(other))
        if n and n not in places:
            index: dict[tuple, list[int]] = {}
            for at in range(len(own) - n + 1):
                index.setdefault(tuple(own[at : at + n]), []).append(at)
            places[n] = index
        occurs = False
        for window in {tuple(other[at : at + n]) for at in range(len(other) - n + 1)} if n else ():
            for at in places[n].get(window, ()):
                hits[at] += 1
                hits[at + n] -= 1
                occurs = True
        if occurs:
            ids.append(item_id)
    return np.cumsum(hits)[:-1] > 0, ids


def _extended(candidates: DataFrame, span: int) -> DataFrame:
    """(row, n_hit, item_ids) of candidate documents with their items."""

    def run(source):
        for batch in source:
            rows, hit, found = batch.column("row"), [], []
            for text, items in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True):
                hits, ids = hit_words(text, [(i["item_id"], i["item_text"]) for i in items], span)
                hit.append(int(hits.sum()))
                found.append(sorted({str(i) for i in ids}))
            yield pa.RecordBatch.from_arrays([rows, pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["row", "n_hit", "item_ids"])

    return candidates.mapInArrow(run, "row long, n_hit long, item_ids array<string>")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", span: int = 10, k: int = 4, filter_rows: int = 1_000_000) -> DataFrame:
    """(row, key, n_words, n_hit, item_ids), one row per document; ``row`` numbers them arbitrarily but uniquely."""
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    fps = stored(item_fingerprints(items, span, k).distinct())
    lengths = sorted(r.n for r in fps.where("n > 0").select("n").distinct().collect())  # below span
    few = fps.limit(filter_rows + 1).count() <= filter_rows  # all rows, which are what is broadcast
    keep = np.sort(np.array([r.fp for r in fps.select("fp").distinct().collect()], dtype=np.int64)) if few else None
    base = stored(_document_fingerprints(docs, key, lengths, keep, span, k).withColumn("row", F.monotonically_increasing_id()))
    met = (
        base.where("size(fps) > 0").select("row", F.explode("fps").alias("fp"))
        .join(F.broadcast(fps) if few else fps, "fp").select("row", "item_id").distinct()
    )
    texts = items.where("item_id is not null").select("item_id", F.col("text").alias("item_text"))
    grouped = met.join(texts, "item_id").groupBy("row").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    found = _extended(base.where("size(fps) > 0").select("row", "text").join(grouped, "row"), span)
    columns = ("row", key, "n_words", "n_hit", "item_ids")
    clean = base.where("size(fps) = 0").select("row", key, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    near = base.where("size(fps) > 0").select("row", key, "n_words").join(found, "row", "left")
    near = near.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))})
    return clean.unionByName(near.select(*columns))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: words, hit words, number and digest of the items found."""
    found = contamination(docs, items, key, **options)
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item; rows and columns are otherwise unchanged."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    name = free_name(docs, "digest")
    found = contamination(docs.select(digest.alias(name), "text"), items, name, **options)
    bad = found.where("n_hit > 0").select(name).distinct()
    return docs.withColumn(name, digest).join(bad, name, "left_anti").select(*docs.columns)
