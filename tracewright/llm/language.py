"""Language identification, words first: known words by their log frequency per language, unseen words by shorter and
shorter character n-grams.

A word is a run of letters, lower-cased. A word seen at least twice in the sample adds its log frequency in every
language. Any other word falls back to its n-grams (with a mark at either end) from ``longest`` characters down to one:
the first length of which the sample knows an n-gram decides, by the mean log frequency of those known. A word of which
nothing is known adds nothing. The score is the posterior of the winner.

The model learns from a sample of about ``per_language`` documents of every language, drawn by a hash of the id over all
rows; its tables are bounded by that sample. Rows without a language or an id teach nothing. Null texts and texts
without a letter are ``und`` with score 0; without anything learned, every text is. Equal evidence goes to the language
with more documents, then to the first by name. Repeated rows repeat their result, and further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrays, crc_remainder, running_hash, span_hashes, stored, text_blocks, uniform

UNKNOWN = "und"
_EDGE = 0x110000  # the mark at either end of a word
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, start, end, text) of all words; the codes hold every word between two marks."""
    raw = [text.lower().encode("utf-32-le", "surrogatepass") for text in texts]
    codes = np.frombuffer(b"\x00\x00\x00\x00".join(raw) + b"\x00\x00\x00\x00", dtype=np.uint32)
    inside = np.concatenate(([False], _is_letter()[codes]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    owner = np.searchsorted(np.cumsum([len(r) // 4 + 1 for r in raw]), start, side="right")
    return codes, start, end, owner


def _grams(codes, start, end, n):
    """(word, hash) of all n-grams of the marked words; words shorter than n with their marks have none."""
    length = end - start + 2
    marked = np.full(int(length.sum()), _EDGE, dtype=np.uint32)
    first = np.cumsum(length) - length
    place = np.repeat(first + 1, length - 2) + arrays(length - 2)
    marked[place] = codes[np.repeat(start, length - 2) + arrays(length - 2)]
    each = np.maximum(length - n + 1, 0)
    at = np.repeat(first, each) + arrays(each)
    return np.repeat(np.arange(len(start)), each), _salted(span_hashes(running_hash(marked), at, at + n), n)


def _salted(hashes: np.ndarray, n: int) -> np.ndarray:
    return hashes ^ np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def count_entries(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, hash, count) of the words (n = 0) and n-grams of some texts."""
    out = []
    codes, start, end, _ = _words(texts)
    hashes = span_hashes(running_hash(codes), start, end)
    words, at, counts = np.unique(hashes, return_index=True, return_counts=True)
    out.append((0, words, counts))
    for n in range(1, longest + 1):
        owner, grams = _grams(codes, start[at], end[at], n)
        grams, place = np.unique(grams, return_inverse=True)
        out.append((n, grams, np.bincount(place, counts[owner], minlength=len(grams)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*[(np.full(len(h), n), h, c) for n, h, c in out], strict=True))


@dataclass
class Model:
    languages: list[str]  # by falling number of documents, then name
    prior: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]  # by n: sorted hashes, log frequency per language


def learn(docs: DataFrame, per_language: int = 2000, longest: int = 5, smoothing: float = 0.5) -> Model:
    """The model from (doc_id, text, lang); see the module about the sample."""
    known = docs.select("doc_id", "text", "lang").where("lang is not null and doc_id is not null and text is not null")
    sizes = sorted(known.groupBy("lang").count().collect(), key=lambda r: (-r["count"], r["lang"]))  # one row per language
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.empty(0), [])
    # As many rows as languages, which the driver holds already.
    shares = docs.sparkSession.createDataFrame([(r["lang"], i, min(1.0, per_language / r["count"])) for i, r in enumerate(sizes)], "lang string, language int, share double")
    sample = known.join(F.broadcast(shares), "lang").where(uniform("doc_id") < F.col("share")).select("text", "language")

    def run(source):
        for batch in source:
            owner, texts = batch.column("language").to_numpy(), batch.column("text").to_pylist()
            for language in np.unique(owner).tolist():
                for _, block in text_blocks([t for t, o in zip(texts, owner, strict=True) if o == language]):
                    n, hashes, counts = count_entries(block, longest)
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(hashes.view(np.int64)), pa.array(np.full(len(n), language), pa.int32()), pa.array(counts, pa.int64())], ["n", "hash", "language", "count"])

    entries = stored(sample.mapInArrow(run, "n int, hash long, language int, count long").groupBy("n", "hash", "language").agg(F.sum("count").alias("count")))
    # A word seen once in the whole sample is no known word; a rare n-gram still tells something.
    totals = entries.groupBy("n", "hash").agg(F.sum("count").alias("total"))
    counted = entries.join(totals, ["n", "hash"]).where("n > 0 or total > 1").select("n", "hash", "language", "count").toPandas()
    prior = np.log([r["count"] for r in sizes]) - np.log(sum(r["count"] for r in sizes))
    tables = []
    for n in range(longest + 1):
        part = counted[counted["n"] == n]
        hashes, place = np.unique(part["hash"].to_numpy(dtype=np.int64).view(np.uint64), return_inverse=True)
        seen = np.full((len(hashes), len(languages)), smoothing)
        np.add.at(seen, (place, part["language"].to_numpy(dtype=np.int64)), part["count"].to_numpy(dtype=np.float64))
        tables.append((hashes, np.log(seen / seen.sum(axis=0)).astype(np.float32)))
    return Model(languages, prior, tables)


def _found(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
    place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return place, table[place] == hashes


def log_scores(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(letters, evidence): whether each text has a word, and its summed log frequencies with the prior."""
    codes, start, end, owner = _words(texts)
    # Each different word is looked up once, however often it stands in the block.
    hashes, at, place = np.unique(span_hashes(running_hash(codes), start, end), return_index=True, return_inverse=True)
    start, end = start[at], end[at]
    worth = np.zeros((len(hashes), len(model.languages)))
    row, hit = _found(model.tables[0][0], hashes)
    worth[hit] = model.tables[0][1][row[hit]]
    rest = np.flatnonzero(~hit)
    for n in range(len(model.tables) - 1, 0, -1):
        if not len(rest):
            break
        word, grams = _grams(codes, start[rest], end[rest], n)
        row, hit = _found(model.tables[n][0], grams)
        number = np.bincount(word[hit], minlength=len(rest))
        decided = number > 0
        for language in range(len(model.languages)):
            sums = np.bincount(word[hit], model.tables[n][1][row[hit], language], minlength=len(rest))
            worth[rest[decided], language] = sums[decided] / number[decided]
        rest = rest[~decided]
    out = np.stack([np.bincount(owner, worth[place, language], minlength=len(texts)) for language in range(len(model.languages))], axis=1)
    return np.bincount(owner, minlength=len(texts)) > 0, out + model.prior


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score), one row per document."""
    source = docs.select(key, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(source):
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch in filter(len, source):
            best, score = [], []
            for _, block in text_blocks(batch.column("text").to_pylist()):
                if not model.languages:
                    best.append(np.full(len(block), -1))
                    score.append(np.zeros(len(block)))
                    continue
                letters, logs = log_scores(block, model)
                winner = logs.argmax(axis=1)
                share = 1.0 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                best.append(np.where(letters, winner, -1))
                score.append(np.where(letters, share, 0.0))
            best, score = np.concatenate(best), np.concatenate(score)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, lang_pred string, score double")


def report(docs: DataFrame, **options) -> DataFrame:
    model = learn(docs.where(crc_remainder("doc_id", 4) != 2), **options)
    held = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held, "lang_pred", "score")
