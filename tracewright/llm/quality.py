"""Quality scores: hashed word n-grams, logistic regression by follow the regularised leader, sparse dot products.

Words are runs of letters and digits or runs of other visible characters. Each counts in two forms: its lower-cased
characters, and its shape (capital, upper, lower, mixed case, digits, symbols, with a mark where the word before is the
same). Features are the hashed single words and neighbouring pairs of either form; a text's vector holds their counts
and has length one. The score is the logistic function of its dot product with the weights.

Training takes at most ``sample_rows`` labelled rows in expectation, drawn by a hash of the id over all of them, and
deals them into shards of about ``shard_rows``; each shard runs follow-the-regularised-leader passes of its own, and the
weights are averaged. Weights are at most 2^``bits`` numbers, whatever the corpus. Labels may be null (such rows are not learned
from), repeat, or name unknown documents. Without any label every score is 0.5. Null or empty texts have no features
and get the score of the intercept. Repeated rows repeat their score, and further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import arrays, crc_remainder, running_hash, span_hashes, stored, text_blocks, uniform

_SPACE, _LETTER, _DIGIT, _SYMBOL = 0, 1, 2, 3
_CLASS = np.full(256, _SYMBOL, dtype=np.uint8)
_CLASS[list(b"\x00\t\n\x0b\x0c\r ")] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = _LETTER
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    mixed = a * np.uint64(0xC2B2AE3D27D4EB4F) + np.asarray(b, dtype=np.uint64) * np.uint64(0x9E3779B185EBCA87) + np.uint64(salt)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def features(texts: list[str], bits: int = 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of the unit vectors of some texts, by text, then bucket."""
    raw = [text.encode() for text in texts]
    data = np.frombuffer(b"\x00".join(raw) + b"\x00", dtype=np.uint8)
    kind = _CLASS[data]
    word = np.where(kind == _DIGIT, _LETTER, kind)  # letters and digits together
    change = np.flatnonzero(np.diff(word, prepend=_SPACE))
    filled = word[change] != _SPACE
    start, end = change[filled], np.append(change, len(data))[1:][filled]
    ends = np.cumsum([len(r) + 1 for r in raw])
    owner = np.searchsorted(ends, start, side="right")
    form = span_hashes(running_hash(_LOWER[data]), start, end)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    digit = np.concatenate(([0], np.cumsum(kind == _DIGIT)))
    n, n_upper, n_digit = end - start, upper[end] - upper[start], digit[end] - digit[start]
    symbol = word[start] == _SYMBOL
    shape = np.select([symbol, n_digit == n, n_digit > 0, n_upper == 0, n_upper == n, (n_upper == 1) & (_UPPER[data[start]] == 1)], [0, 1, 2, 3, 4, 5], 6).astype(np.uint64)
    shape = np.where(symbol, form, shape)
    paired = owner[1:] == owner[:-1]
    same = np.zeros(len(form), dtype=np.uint64)
    same[1:] = (form[1:] == form[:-1]) & paired
    shape = _mix(shape, same, 1)
    both, left, right = owner[1:][paired], np.flatnonzero(paired), np.flatnonzero(paired) + 1
    hashes = np.concatenate([_mix(form, 0, 2), _mix(shape, 0, 3), _mix(form[left], form[right], 4), _mix(shape[left], shape[right], 5)])
    owners = np.concatenate([owner, owner, both, both]).astype(np.uint64)
    keys = np.sort((owners << np.uint64(bits)) | (hashes >> np.uint64(64 - bits)))
    if not len(keys):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(first, len(keys))).astype(np.float64)
    rows = (keys[first] >> np.uint64(bits)).astype(np.int64)
    buckets = (keys[first] & np.uint64((1 << bits) - 1)).astype(np.int64)
    length = np.sqrt(np.bincount(rows, counts * counts, minlength=len(texts)))
    return rows, buckets, counts / length[rows]


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def learn(texts: list[str], labels: np.ndarray, bits: int, passes: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after follow-the-regularised-leader passes over some labelled texts; the last one is the intercept."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(at):
        strong = np.abs(z[at]) > l1
        return np.where(strong, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    parts = [(start, features(block, bits)) for start, block in text_blocks(texts)]
    rows = np.concatenate([start + part[0] for start, part in parts])
    buckets, values = (np.concatenate([part[i] for _, part in parts]) for i in (1, 2))
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    for _ in range(passes):
        for row in range(len(texts)):
            at = np.append(buckets[cuts[row] : cuts[row + 1]], 1 << bits)
            x = np.append(values[cuts[row] : cuts[row + 1]], 1.0)
            w = weights(at)
            slope = (_logistic(w @ x) - labels[row]) * x
            step = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / alpha
            z[at] += slope - step * w
            n[at] += slope * slope
    return weights(np.arange((1 << bits) + 1))


def marks(labels: DataFrame, label: str = "quality", leave_out: tuple[int, int] | None = (3, 1)) -> DataFrame:
    """(doc_id, label) to learn from: equal labels of a document once, none of the left-out fold (modulus, remainder)."""
    kept = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("label")).distinct()
    return kept.where(crc_remainder("doc_id", leave_out[0]) != leave_out[1]) if leave_out else kept


def train(
    docs: DataFrame, marks: DataFrame, sample_rows: int = 16_384, shard_rows: int = 2048, bits: int = 18, passes: int = 6,
    alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1,
) -> np.ndarray:
    """Weights from ``docs`` (doc_id, text) and ``marks`` (doc_id, label); see the module about the sample."""
    share = min(1.0, sample_rows / max(marks.count(), 1))
    drawn = stored(marks.where(uniform("doc_id") < share))
    shards = max(1, round(drawn.count() / shard_rows))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "label"])
    sample = sample.select(F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).alias("shard"), F.xxhash64("doc_id").alias("place"), "text", F.col("label").cast("double").alias("label"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["place", "label"])
        w = learn(part["text"].tolist(), part["label"].to_numpy(), bits, passes, alpha, beta, l1, l2)
        at = np.union1d(np.flatnonzero(w), [1 << bits])
        return pd.DataFrame({"shard": part["shard"].iloc[0], "bucket": at, "weight": w[at]})

    fitted = stored(sample.groupBy("shard").applyInPandas(fit, "shard long, bucket long, weight double"))
    n = fitted.select("shard").distinct().count()
    mean = fitted.groupBy("bucket").agg((F.sum("weight") / max(n, 1)).alias("weight")).toPandas()  # at most 2^bits + 1 rows
    out = np.zeros((1 << bits) + 1)
    out[mean["bucket"].to_numpy(dtype=np.int64)] = mean["weight"].to_numpy(dtype=np.float64)
    return out


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``score``: 0 to 1, higher where label 1 is likelier."""
    docs = docs.drop("score")
    bits = (len(weights) - 1).bit_length() - 1
    model = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits + 1 numbers

    def run(source):
        for batch in source:
            out = []
            for _, block in text_blocks(batch.column("text").to_pylist()):
                rows, buckets, values = features(block, bits)
                out.append(np.bincount(rows, values * model.value[buckets], minlength=len(block)) + model.value[-1])
            names = [*batch.schema.names, "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_logistic(np.concatenate(out)) if out else [], pa.float64())], names)

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.5)).schema)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    weights = train(docs, marks(labels), **options)
    scored = score(docs.select("doc_id", "text"), weights)
    held = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` that the classifier accepts; columns unchanged."""
    weights = train(docs, marks(labels), **options)
    names = [f"column_{i}" if c != "text" else c for i, c in enumerate(docs.columns)]  # a column may be called score
    return score(docs.toDF(*names), weights).where(F.col("score") >= threshold).select(*names).toDF(*docs.columns)
