"""Byte-level BPE: encoding with a heap of merge ranks over linked symbols, decoding by concatenation."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How byte-level vocabularies split a text before merging (fixed value of that format).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of plain characters only, for the faster matcher of the standard library.
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PLAIN_SPLIT = rf" ?[^\W\d_{NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBERS}]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters up to U+017E that every library lower-cases, normalises and splits one by one alike.
PLAIN = re.compile("[\x00-\x1b\x20-\x84\x86-\u012f\u0131-\u017e]*")
#: Pieces a worker remembers before it starts afresh.
CACHE = 300_000


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Pieces(dict):
    """The ids of pieces, as bytes, by piece."""

    def __init__(self, merge: Callable[[bytes], list[int]]) -> None:
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = array("i", self.merge(piece.encode())).tobytes()
        return ids


class ByteBpe:
    """A vocabulary in the JSON format of the tokenizers library, byte level, without normaliser."""

    def __init__(self, source: str) -> None:
        model = json.loads(source)
        vocab = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        marks = byte_symbols()
        back = {c: b for b, c in marks.items()}
        self.byte_id = [vocab[marks[b]] for b in range(256)]
        self.base = len(vocab) + len(self.special) + 1
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] * self.base + vocab[right], rank)
            self.made.append(vocab[left + right])
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.split, self.plain_split = regex.compile(SPLIT), re.compile(PLAIN_SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache = Pieces(self.merge)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece: the applicable merge of least rank first, the leftmost among equals.

        The heap holds rank and position in one number; ranks has the rank of the pair that now starts
        at a position, so an entry that disagrees with it is stale.
        """
        byte_id = self.byte_id
        ids = [byte_id[b] for b in piece]
        n = len(ids)
        if n == 1:
            return ids
        find, base, made = self.merges.get, self.base, self.made
        ranks = [find(a * base + b, -1) for a, b in zip(ids, ids[1:])]
        heap = [(r << 32) | at for at, r in enumerate(ranks) if r >= 0]
        if not heap:
            return ids
        heapify(heap)
        ranks.append(-1)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heappop(heap)
            rank, at = entry >> 32, entry & 0xFFFFFFFF
            if ranks[at] != rank:
                continue  # stale: one of its symbols has been merged since
            then = after[at]
            end = after[then]
            new = ids[at] = made[rank]
            ids[then] = ranks[then] = -1
            after[at] = end
            if end < n:
                before[end] = at
                ranks[at] = r = find(new * base + ids[end], -1)
                if r >= 0:
                    heappush(heap, (r << 32) | at)
            else:
                ranks[at] = -1
            start = before[at]
            if start >= 0:
                ranks[start] = r = find(ids[start] * base + new, -1)
                if r >= 0:
                    heappush(heap, (r << 32) | start)
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> bytes:
        if len(self.cache) > CACHE:
            self.cache.clear()
        split = self.plain_split if PLAIN.fullmatch(text) else self.split
        return b"".join(map(self.cache.__getitem__, split.findall(text)))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; strings of special tokens in it become their ids."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        if self.cut is None or not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), dtype=np.int32)
        parts = [
            np.array([self.special[p]], dtype=np.int32).tobytes() if p in self.special else self._plain(p)
            for p in self.cut.split(text)
            if p
        ]
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in np.asarray(ids).tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _model(source: str) -> ByteBpe:
    return ByteBpe(source)


def _shared(df: DataFrame, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the ids of text_col as array<int>; null and empty texts get an empty array.

    path is a vocabulary file that the driver reads and broadcasts (its size does not depend on the
    data). All other columns stay; an existing ids_col is replaced.
    """
    source = _shared(df, path)
    kept = df.drop(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(source.value)
        for batch in batches:
            coded = [model.encode(t) for t in batch.column(text_col).to_pylist()]
            ends = np.cumsum([0, *map(len, coded)], dtype=np.int64)
            ids = pa.ListArray.from_arrays(ends.astype(np.int32), np.concatenate([np.zeros(0, np.int32), *coded]))
            yield batch.append_column(ids_col, ids)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of ids_col; null ids give an empty text, an unknown id is an error."""
    source = _shared(df, path)
    kept = df.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(source.value)
        for batch in batches:
            texts = [model.decode(i.values) if i.is_valid else "" for i in batch.column(ids_col)]
            yield batch.append_column(text_col, pa.array(texts, pa.string()))

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(text_col, T.StringType())]))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again.

    Null and empty texts have no ids, so the digests are those of an empty text; repeated rows each get a row; a null
    doc_id stays null; an empty table gives no rows; other columns are not read.
    """
    coded = bpe_decode(bpe_encode(docs.select("doc_id", "text"), path).select("doc_id", "ids"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
