"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lexspark.llm.bpe import PLAIN, PLAIN_SPLIT, SPLIT, byte_symbols
from lexspark.llm.memory import trim
from lexspark.llm.packing import PLAIN_WORDS

#: Pre-tokens a worker remembers before it starts afresh, and texts whose pre-tokens are held at once.
CACHE, SLICE = 200_000, 100
#: Bytes of pre-tokens that are merged at once.
BYTES = 1 << 20


class RankMerges:
    """The merges of a vocabulary in the JSON format of the tokenizers library (bytes shown as characters, with or
    without a suffix at the ends of words), applied to many pre-tokens at once."""

    def __init__(self, source: str) -> None:
        model = json.loads(source)["model"]
        vocab, marks = model["vocab"], byte_symbols()
        suffix = model.get("end_of_word_suffix") or ""
        self.inner = np.array([vocab[marks[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[marks[b] + suffix] for b in range(256)], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = len(pairs)
        keys, first = np.unique(left * self.base + right, return_index=True)
        self.keys, self.ranks = np.append(keys, np.iinfo(np.int64).max), np.append(first, self.none)
        # A merge is whole if no merge that uses what it makes comes before it: then all places of a pair that are
        # free of each other can be merged in one step. Otherwise only the first of a sequence is.
        earliest = np.full(self.base, self.none)
        np.minimum.at(earliest, left, np.arange(self.none))
        np.minimum.at(earliest, right, np.arange(self.none))
        self.whole = np.append(earliest[self.made] > np.arange(self.none), True)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; the number of merges where there is none."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def symbols(self, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pre-token) of the surviving symbols of non-empty pre-tokens, pre-tokens in no order.

        All symbols lie in one array, those of a pre-token together. Each step finds every pre-token's least rank and
        merges all places of that pair in it (of overlapping ones, as in a run of one symbol, every other from the
        left). Pre-tokens without a pair that merges leave the arrays.
        """
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        ids, end = self.inner[raw], np.cumsum(size) - 1
        ids[end] = self.last[raw[end]]
        word = np.repeat(np.arange(len(coded)), size)
        ranks = np.full(len(ids), self.none)
        inside = np.flatnonzero(word[:-1] == word[1:])
        ranks[inside] = self.rank(ids[inside], ids[inside + 1])
        left_ids, left_words = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(ranks, first)
            if (least == self.none).any():
                over = np.repeat(least == self.none, count)
                left_ids.append(ids[over])
                left_words.append(word[over])
                ids, word, ranks = ids[~over], word[~over], ranks[~over]
                count, least = count[least < self.none], least[least < self.none]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, count))
            starts = np.append(True, np.diff(at) != 1) | np.append(True, word[at][1:] != word[at][:-1])
            run = np.flatnonzero(starts)
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            once = ~self.whole[ranks[at]]
            if once.any():
                at = at[~once | np.append(True, word[at][1:] != word[at][:-1])]
            ids[at] = self.made[ranks[at]]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            now = at - np.arange(len(at))
            ids, word, ranks = ids[stay], word[stay], ranks[stay]
            for left in (now, now[now > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                inside = (left + 1 < len(ids)) & (word[left] == word[right])
                ranks[left] = np.where(inside, self.rank(ids[left], ids[right]), self.none)
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *left_ids]), np.concatenate([none, *left_words])

    def counts(self, coded: list[bytes]) -> np.ndarray:
        """How many symbols survive of each pre-token; none of an empty one."""
        out = np.zeros(len(coded), dtype=np.int64)
        at = np.array([k for k, c in enumerate(coded) if c], dtype=np.int64)
        size = np.cumsum([len(coded[k]) for k in at])
        for part in np.split(at, np.searchsorted(size, np.arange(BYTES, size[-1], BYTES)) if len(at) else []):
            if len(part):
                _, word = self.symbols([coded[k] for k in part])
                out[part] = np.bincount(word, minlength=len(part))
        return out


class TokenCounter:
    """Numbers of tokens as the tokenizers library gives them without added special tokens, truncation or padding;
    strings of special tokens in texts are one token each, as the library has them by default.

    The library normalises and splits texts outside PLAIN; plain ones are split by the same pattern here. The merges
    are always those of RankMerges.
    """

    def __init__(self, source: str) -> None:
        self.whole = Tokenizer.from_str(source)
        self.special = sorted((t.content for t in self.whole.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.merges = RankMerges(source)
        self.back = {ord(c): b for b, c in byte_symbols().items()}
        self.lower = bool(json.loads(source)["model"].get("end_of_word_suffix"))
        self.plain = PLAIN_WORDS if self.lower else re.compile(PLAIN_SPLIT)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if PLAIN.fullmatch(text):
            return self.plain.findall(text.lower() if self.lower else text)
        if self.whole.normalizer is not None:
            text = self.whole.normalizer.normalize_str(text)
        return [bytes(map(self.back.__getitem__, map(ord, p))).decode("utf-8", "surrogateescape") for p, _ in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special tokens) of a text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split(text), 0
        parts = self.cut.split(text)
        return list(chain.from_iterable(self.split(p) for p in parts if p)), len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text. The pre-tokens of all texts that are not remembered are merged together."""
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.pieces(t) for t in texts]
        new = list(set(filterfalse(self.known.__contains__, chain.from_iterable(w for w, _ in split))))
        self.known.update(zip(new, self.merges.counts([w.encode("utf-8", "surrogateescape") for w in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, w)) + n for w, n in split]


@lru_cache(maxsize=2)
def _counter(source: str) -> TokenCounter:
    return TokenCounter(source)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """df with the number of tokens of text_col as count_col (long), a null or empty text having none.

    path is a BPE vocabulary of the tokenizers library, which the driver reads and broadcasts: its size does not
    depend on the data. Rows stay where they are and texts are whole; SLICE of them are in hand at once, and a worker
    forgets its pre-tokens at CACHE. All other columns stay, an existing count_col is replaced, repeated rows are
    counted each, an empty table stays empty.
    """
    with open(path, encoding="utf-8") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())
    kept = df.drop(count_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(source.value)
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                found = counter.count([t or "" for t in part.column(text_col).to_pylist()])
                yield part.append_column(count_col, pa.array(found, pa.int64()))
        counter.known.clear()
        trim()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(count_col, T.LongType())]))


def document_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs.

    n_bytes counts the text in UTF-8; over_limit says whether n_tokens exceeds limit. Null and empty texts have no
    bytes and no tokens; repeated rows each get a row; a null doc_id stays null; an empty table gives no rows; other
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = count_tokens(rows, path).select("doc_id", "n_bytes", "n_tokens")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
