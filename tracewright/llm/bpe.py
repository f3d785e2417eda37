"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts every text into chunks, so equal passages give equal chunks wherever they
stand. A task encodes each different chunk once and keeps its ids. So that documents that share chunks meet in a task,
they are dealt by their smallest chunk hash and sorted by it: copies always meet, near copies mostly. The exchange is a
rebalance, which adaptive execution splits where one key is hot, so copies of one text may fill several tasks; each of
them then encodes its chunks once.

Joins of chunks are mended exactly. The tokenizer splits text into pieces before it merges, and a piece never runs over
a place where a blank follows a non-blank. Both a chunk's own encoding and any re-encoding of text around it agree at
such a place. What a chunk keeps are the ids between its first and its last such place; from the last one of the left
chunk to the first one of the right chunk the text is encoded anew, growing over following chunks that have none, until
both sides agree. The decoded ids are compared with the text; if they ever differ, the whole text is encoded at once,
which is also what happens for tokenizers that are not plain byte-level BPE.

Text of Latin letters goes through a second, faster implementation of the same byte-pair merges, built from the same
vocabulary file. It is used only if every merge of the file makes the next id in turn, so that merging by smallest id
is merging by the file's order, and only for characters up to U+00FF without special tokens, where both libraries split
text alike; everything else goes through the tokenizer itself. Tests hold the two against each other.

Null counts as empty text, which has no ids. Special tokens written in a text are recognised as the tokenizer does.
Repeated rows repeat their result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BITS = 10
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
_AGREED = re.compile(r"(?<=\S)[ \n]")
_LAST_AGREED = re.compile(r"(?s:.*)((?<=\S)[ \n])")
_KEEP_BYTES = 32 << 20


def chunk_ends(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the chunks of some UTF-8 bytes: where the hash of the last 32 bytes has ``bits`` leading zeros."""
    codes = np.frombuffer(data, dtype=np.uint8)
    rolling = _GEAR[codes]
    for step in (1, 2, 4, 8, 16):
        rolling[step:] += rolling[:-step] << np.uint32(step)
    ends = np.flatnonzero(rolling >> np.uint32(32 - bits) == 0) + 1
    ends = ends[ends < len(data)]
    ends = ends[(codes[ends] & 0xC0) != 0x80]  # not inside a character
    return [*ends.tolist(), len(data)] if data else []


def chunks(text: str, bits: int = CHUNK_BITS) -> list[bytes]:
    data = text.encode()
    ends = chunk_ends(data, bits)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


#: The pieces into which byte-level tokenizers cut text before they merge: a fixed value of the format.
_PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _latin_encoder(spec: dict):
    """The fast encoder of a byte-level vocabulary, or None if its ids do not follow its merges."""
    vocabulary, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    made = [vocabulary.get(a + b) for a, b in pairs]
    if not made or made != list(range(made[0], made[0] + len(made))) or spec["model"].get("ignore_merges"):
        return None
    import tiktoken

    byte = _shown_bytes()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): rank for token, rank in vocabulary.items() if token not in special}
    if len(ranks) != made[0] + len(made):
        return None
    return tiktoken.Encoding("latin", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path) as source:
        spec = json.load(source)
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = spec.get("added_tokens", [])
    special = [t["content"] for t in added]
    # Added tokens that take blanks along, or look at their neighbours, change the text around them.
    wide = any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word"))
    plain = bool(plain) and not wide and not any(_AGREED.search(t) for t in special)
    return tokenizer, plain, _latin_encoder(spec) if plain else None, special


class Encoder:
    """Encodes texts one after another and reuses chunks met before; ``encoded`` and ``reused`` count chunks."""

    def __init__(self, path: str, bits: int = CHUNK_BITS):
        self.tokenizer, self.plain, self.latin, self.special = _tokenizer(path)
        self.bits, self.encoded, self.reused = bits, 0, 0
        self._kept: dict[bytes, tuple[str, int, int, list[int]]] = {}
        self._size = 0

    def whole(self, text: str) -> list[int]:
        if self.latin and not any(token in text for token in self.special):
            try:
                text.encode("latin-1")
                return self.latin(text)
            except UnicodeEncodeError:
                pass
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else []

    def _chunk(self, data: bytes) -> tuple[str, int, int, list[int]]:
        """(text, first, last, ids): ids of the text between its first and last agreed places; -1 if it has none."""
        found = self._kept.get(data)
        if found is not None:
            self.reused += 1
            return found
        self.encoded += 1
        text = data.decode()
        place = _AGREED.search(text)
        first, last = (place.start(), _LAST_AGREED.match(text).start(1)) if place else (-1, -1)
        found = text, first, last, self.whole(text[first:last])
        self._size += 8 * len(data)
        if self._size > _KEEP_BYTES:
            self._kept.clear()
            self._size = 8 * len(data)
        self._kept[data] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not self.plain:
            return self.whole(text)
        ids, open_text = [], ""
        for data in chunks(text, self.bits):
            part, first, last, inner = self._chunk(data)
            if first < 0:  # no agreement in this chunk: the text to encode anew grows
                open_text += part
                continue
            ids += self.whole(open_text + part[:first])
            ids += inner
            open_text = part[last:]
        return ids + self.whole(open_text)

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def round_trip(self, text: str) -> tuple[list[int], str]:
        ids = self.encode(text)
        decoded = self.decode(ids)
        if decoded != text and self.plain:
            ids = self.whole(text)
            decoded = self.decode(ids)
        return ids, decoded


def _near_each_other(docs: DataFrame, bits: int) -> DataFrame:
    """Documents that share chunks brought together; needs columns key and text."""

    def run(source):
        for batch in source:
            smallest = []
            for text in batch.column("text").to_pylist():
                keys = [int.from_bytes(hashlib.blake2b(c, digest_size=8).digest(), "big", signed=True) for c in chunks(text or "", bits)]
                smallest.append(min(keys, default=0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(smallest, pa.int64())], [*batch.schema.names, "nearest"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, nearest long").hint("rebalance", "nearest").sortWithinPartitions("nearest")


def encode(docs: DataFrame, path: str, key: str = "doc_id", with_ids: bool = True, bits: int = CHUNK_BITS) -> DataFrame:
    """(key, n_tokens, ids, ids_sha256, decoded_sha256), one row per document; ``ids`` only if asked for."""
    source = _near_each_other(docs.select(key, "text"), bits)
    kind = docs.schema[key].dataType.simpleString()

    def run(source):
        encoder = Encoder(path, bits)
        for batch in source:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": []}
            for text in batch.column("text").to_pylist():
                ids, decoded = encoder.round_trip(text or "")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(np.array(ids, dtype=np.int32))
            columns = [batch.column(key), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the texts of id arrays; null ids give an empty text."""

    def run(source):
        tokenizer = _tokenizer(path)[0]
        for batch in source:
            texts = tokenizer.decode_batch([x or [] for x in batch.column(ids).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")
