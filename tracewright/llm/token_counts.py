"""Token counts of sections by offset-mapped attribution.

Every document is encoded once and whole. The lengths of its tokens give each token's character span, and the spans are
interval-joined to the sections by binary search over the section starts. Unless told otherwise, a section is a line with the break that
ends it, so the sections of a text lie side by side and every token is counted exactly once. A token that crosses a border
goes to the section that holds most of its characters; of equal shares the earliest wins. A token that holds only part
of a character spans that whole character.

Counts of a document therefore add up to its number of tokens. Null or empty texts have no sections and no rows. Strings of special tokens count as ordinary text. Repeated
documents repeat their rows; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    """(encoding, number of bytes of each token) of a rank file: one base64 token and its id per line."""
    import tiktoken

    with open(path, "rb") as source:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, source)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens that have ``lengths`` bytes each and make up the text."""
    ends = np.cumsum(lengths)
    if text.isascii():
        return ends - lengths, ends
    lead = (np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80
    number = np.cumsum(lead)  # characters begun up to and with each byte
    return number[ends - lengths] - 1, number[ends - 1]


def line_starts(text: str) -> np.ndarray:
    """Starts of the lines; a break belongs to the line it ends."""
    starts, at = [0] if text else [], text.find("\n")
    while 0 <= at < len(text) - 1:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(starts, dtype=np.int64)


def allocate(start: np.ndarray, end: np.ndarray, sections: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(section of every token, whether it crosses a border) by the rule of the module."""
    first = np.searchsorted(sections, start, side="right") - 1
    last = np.searchsorted(sections, end - 1, side="right") - 1
    out, borders = first.copy(), np.append(sections, length)
    for token in np.flatnonzero(first != last).tolist():
        held = np.arange(first[token], last[token] + 1)
        share = np.minimum(borders[held + 1], end[token]) - np.maximum(borders[held], start[token])
        out[token] = held[share.argmax()]
    return out, first != last


def by_section(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", starts: Callable[[str], np.ndarray] = line_starts) -> DataFrame:
    """(key, section, start, n_chars, n_tokens, n_crossing): one row per section, numbered from 0 in text order.

    ``starts`` gives the rising character positions at which the sections of a non-empty text start, 0 first.
    """
    source = docs.select(key, "text")

    def run(source):
        encoding, sizes = _encoding(path, pattern)
        for batch in source:
            parts = {c: [] for c in ("row", "section", "start", "n_chars", "n_tokens", "n_crossing")}
            for row, text in enumerate(batch.column("text").to_pylist()):
                if not text:
                    continue
                sections = starts(text)
                owner, crossing = allocate(*token_spans(text, sizes[np.array(encoding.encode_ordinary(text))]), sections, len(text))
                parts["row"].append(np.full(len(sections), row))
                parts["section"].append(np.arange(len(sections)))
                parts["start"].append(sections)
                parts["n_chars"].append(np.diff(np.append(sections, len(text))))
                parts["n_tokens"].append(np.bincount(owner, minlength=len(sections)))
                parts["n_crossing"].append(np.bincount(owner, crossing, minlength=len(sections)).astype(np.int64))
            joined = {c: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for c, v in parts.items()}
            keys = batch.column(key).take(pa.array(joined.pop("row"), pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *[pa.array(v, pa.int64()) for v in joined.values()]], [key, *joined])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {kind}, section long, start long, n_chars long, n_tokens long, n_crossing long")
