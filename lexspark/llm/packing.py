"""Packing documents into windows of tokens by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from lexspark.llm.bpe import NUMBERS, PLAIN, byte_symbols
from lexspark.llm.memory import trim

#: Words a task remembers before it starts afresh.
CACHE = 150_000
#: Texts whose words are held at once, and ids and rows that are handed on at once.
SLICE, IDS, ROWS = 100, 1 << 20, 5_000
#: Words of plain texts, in the vocabulary's own pattern.
PLAIN_WORDS = re.compile(rf"[^\W\d_{NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|(?:[^\s\w]|_)+")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of the positions of sizes, with near equal sums.

    A partial partition is a list of (sum, positions), largest first, without its empty parts. The two
    partial partitions of the largest spread are merged, the large parts of one with the small parts of
    the other, until one is left.
    """
    heap = [(-s, at, [(s, [at])]) for at, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        one, two = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = max(0, len(one) + len(two) - k)
        keep, tail, two = one[: len(one) - over], one[len(one) - over :], two[::-1]
        merged = keep + [(a + b, x + y) for (a, x), (b, y) in zip(tail, two, strict=False)] + two[over:]
        merged.sort(key=lambda p: -p[0])
        if len(merged) == k and (low := merged[-1][0]):
            merged = [(a - low, x) for a, x in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, serial, merged))
        serial += 1
    parts = [x for _, x in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def fill_windows(sizes: list[int], window: int) -> list[list[int]]:
    """Positions of sizes (each at most window) by window; one more window whenever one overflows."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[x] for x in part) <= window for part in parts):
            return [p for p in parts if p]
        k += 1


class WordIds:
    """Ids as the tokenizers library gives them.

    Where words are independent of each other, ids are looked up by word; the merges of all words of a
    call that are not known yet are applied together, one merge of each word at a time.
    """

    def __init__(self, source: str) -> None:
        self.whole = Tokenizer.from_str(source)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}
        model = json.loads(source)["model"]
        vocab, marks = model["vocab"], byte_symbols()
        self.inner = np.array([vocab[marks[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[marks[b] + model["end_of_word_suffix"]] for b in range(256)], dtype=np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs])
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(order, len(keys))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; the number of merges where there is none."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.made))

    def learn(self, new: list[str]) -> None:
        """Remember the ids of new words."""
        coded = [w.encode() for w in new]
        size = np.array([len(w) for w in coded])
        ids = self.inner[np.frombuffer(b"".join(coded), dtype=np.uint8)]
        end = np.cumsum(size)
        ids[end - 1] = self.last[np.frombuffer(b"".join(coded), dtype=np.uint8)[end - 1]]
        word = np.repeat(np.arange(len(new)), size)
        none = len(self.made)
        ranks = np.full(len(ids), none)
        same = np.flatnonzero(word[:-1] == word[1:])
        ranks[same] = self.rank(ids[same], ids[same + 1])
        done_ids, done_words = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(ranks, first)
            count = np.diff(np.append(first, len(ids)))
            over = np.repeat(least == none, count)
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                ids, word, ranks = ids[~over], word[~over], ranks[~over]
                count, least = count[least < none], least[least < none]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == np.repeat(least, count))
            at = hits[np.append(True, word[hits][1:] != word[hits][:-1])]
            ids[at] = self.made[ranks[at]]
            stay = np.ones(len(ids), dtype=bool)
            stay[at + 1] = False
            shift = at - np.arange(len(at))
            ids, word, ranks = ids[stay], word[stay], ranks[stay]
            for left in (shift, shift[shift > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                inside = (left + 1 < len(ids)) & (word[left] == word[right])
                ranks[left] = np.where(inside, self.rank(ids[left], ids[right]), none)
        ids, word = np.concatenate(done_ids).astype("<u4"), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        packed, at = ids[order].tobytes(), 0
        for text, n in zip(new, np.bincount(word, minlength=len(new)).tolist(), strict=True):
            self.cache[text] = packed[at : at + 4 * n]
            at += 4 * n

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray | None] = []
        split: list[list[str]] = []
        missing: set[str] = set()
        known = self.cache.__contains__
        if len(self.cache) > CACHE:
            self.cache.clear()
        for text in texts:
            if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4"))
                split.append([])
                continue
            out.append(None)
            split.append(found := PLAIN_WORDS.findall(text.lower()))
            missing.update(filterfalse(known, found))
        if missing:
            self.learn(list(missing))
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), dtype="<u4") if o is None else o for o, w in zip(out, split, strict=True)]

    def stream(self, texts: pd.Series) -> Iterator[np.ndarray]:
        """The ids of each text (null: empty), a slice of texts at a time."""
        for at in range(0, len(texts), SLICE):
            yield from self.encode([t or "" for t in texts[at : at + SLICE]])


@lru_cache(maxsize=2)
def _ids(source: str) -> WordIds:
    return WordIds(source)


def pack_documents(
    docs: DataFrame,
    path: str,
    window: int = 2048,
    group: int = 32,
    piece: int = 256,
    end_id: int = 1,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is the ids of its text (null: empty) and end_id. What fills whole windows from its start
    is cut off as sequences of their own; the rest is cut into pieces of at most piece ids, small enough
    for near equal windows. Each task gathers pieces for about group windows, up to a little under a whole
    number of them, and packs them by differencing, so memory is bounded, nothing is shuffled, and a lost
    task is simply run again. sequence_id counts within a partition, whose number is in its upper bits.
    Repeated rows are packed each on their own, null ids stay null, an empty table gives no rows; other columns are
    not read.
    """
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(c, T.StringType() if c == "doc_id" else T.LongType()) for c in out])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = _ids(source.value)
        serial = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []
        total = held = 0
        rows: list[tuple] = []

        def put(members: list[tuple]) -> None:
            nonlocal serial, held
            at = 0
            for doc, start, ids, whole in members:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), whole, serial, at, *([ids.astype(np.int32)] if with_ids else [])))
                at += len(ids)
            serial += 1
            held += at

        def pack() -> None:
            for part in fill_windows([len(m[2]) for m in waiting], window):
                put([waiting[k] for k in part])
            waiting.clear()

        def frame() -> pd.DataFrame:
            nonlocal held
            made = pd.DataFrame(rows, columns=schema.names)
            rows.clear()
            held = 0
            return made

        for batch in batches:
            for doc, ids in zip(batch["id"], tokens.stream(batch["text"]), strict=True):
                ids = np.append(ids, np.array([end_id], dtype="<u4"))
                cut = len(ids) // window * window
                for at in range(0, cut, window):
                    put([(doc, at, ids[at : at + window], len(ids))])
                for at in range(cut, len(ids), piece):
                    waiting.append((doc, at, ids[at : at + piece], len(ids)))
                    total += len(waiting[-1][2])
                    left = -total % window
                    if total > (group - 1) * window and (window // 5 < left < window // 3 or total > (group + 8) * window):
                        pack()
                        total = 0
                if held >= IDS or len(rows) >= ROWS:
                    yield frame()
        if waiting:
            pack()
        yield frame()
        tokens.cache.clear()
        trim()

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
