"""Alignment of two tokenizers: documents cut where tokens of both end, and id pairs counted over the corpus by
inverted bitmaps of documents."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from tokenizers import Tokenizer

from lexspark.llm.bpe import PLAIN, SPLIT, byte_symbols
from lexspark.llm.memory import trim
from lexspark.operators.lineage import settle

#: What is counted of each document.
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
#: Documents and links of a block, at most (its last slice may go over the links); bitmaps have a bit a document.
DOCS, LINKS = 8192, 1 << 20
#: Texts and characters that are aligned at once.
SLICE, CHARS = 200, 1 << 21
#: Words of the second vocabulary that a worker remembers before it starts afresh.
CACHE = 200_000
#: Longest text for the faster of two equal encoders.
FAST = 1_000_000


class ByteTokens:
    """A byte-level BPE vocabulary of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, source: bytes) -> None:
        self.whole = Tokenizer.from_str(source.decode())
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.whole.no_padding()
        back = {c: b for b, c in byte_symbols().items()}
        vocab = json.loads(source)["model"]["vocab"]
        self.strings = [b""] * self.whole.get_vocab_size()
        for piece, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in piece)
        for i, token in self.whole.get_added_tokens_decoder().items():
            self.strings[i] = token.content.encode()
        merges = json.loads(source)["model"]["merges"]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={self.strings[i]: i for i in vocab.values()}, special_tokens={}) if made == sorted(made) else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with a space before it; both encoders give the same for PLAIN texts."""
        return [
            self.fast.encode_to_numpy(f" {t}", disallowed_special=()).view(np.int32)
            if self.fast and len(t) < FAST and PLAIN.fullmatch(t)
            else np.array(self.whole.encode(f" {t}", add_special_tokens=False).ids, dtype=np.int32)
            for t in texts
        ]

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the ids' bytes are raw."""
        return b"".join(map(self.strings.__getitem__, ids.tolist())) == raw


class PieceTokens:
    """A sentencepiece vocabulary, which adds the space itself."""

    def __init__(self, source: bytes) -> None:
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=source)
        self.strings = []
        for i in range(self.whole.get_piece_size()):
            piece = self.whole.id_to_piece(i)
            raw = len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")
            self.strings.append(bytes([int(piece[3:5], 16)]) if raw else piece.replace("▁", " ").encode())
        # Where no piece has a space after another character, runs of spaces with the word after them never merge with
        # their neighbours, and their ids are remembered. A space alone, which the library would not add to nothing, ends a text.
        crossing = any(re.search(b"[^ ] ", s) for s in self.strings)
        self.cut = None if crossing else re.compile(" *[^ ]+| +")
        self.known: dict[str, bytes] = {}
        self.space = self.whole.piece_to_id("▁")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.cut is None:
            return [np.array(ids, dtype=np.int32) for ids in self.whole.encode(texts, num_threads=1)]
        if len(self.known) > CACHE:
            self.known.clear()
        split = [self.cut.findall(f" {t}") if t else [] for t in texts]
        new = list(set(filterfalse(self.known.__contains__, chain.from_iterable(split))))
        coded = [ids or [self.space] for ids in self.whole.encode([u[1:] for u in new], num_threads=1)]
        self.known.update((u, array("i", ids).tobytes()) for u, ids in zip(new, coded, strict=True))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, units)), dtype=np.int32) for units in split]

    def spells(self, ids: np.ndarray, raw: bytes) -> bool:
        """Whether the ids' bytes are raw."""
        return b"".join(map(self.strings.__getitem__, ids.tolist())) == raw


class Aligner:
    """Tokens of two vocabularies by groups; a pair of ids is one number, the first times width plus the second."""

    def __init__(self, sources: tuple[bytes, bytes], kinds: tuple[type, type]) -> None:
        self.sides = [kind(source) for kind, source in zip(kinds, sources, strict=True)]
        self.sizes = [np.fromiter(map(len, s.strings), dtype=np.int64, count=len(s.strings)) for s in self.sides]
        a, b = (len(s.strings) for s in self.sides)
        self.width = b
        # An id with the sign that follows it: within a side, at its end, and at the end of all.
        self.told = [f"{i}{sign}" for n, signs in ((a, ",|"), (b, ",;")) for sign in signs for i in range(n)]
        self.first_b = 2 * a

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(COUNTS of each text; the pair and the text's position of each link; groups written out).

        All texts that have tokens lie one after the other, so one pass finds the common ends of all of them.
        """
        held = [k for k, t in enumerate(texts) if t]
        coded = [side.encode([texts[k] for k in held]) for side in self.sides]
        raw = [b" " + texts[k].encode() for k in held]
        for side, ids in zip(self.sides, coded, strict=True):
            raw = [r if r is not None and side.spells(i, r) else None for r, i in zip(raw, ids, strict=True)]
        fine = [x for x, r in enumerate(raw) if r is not None]
        counts = np.zeros((len(texts), 4), dtype=np.int64)
        groups = [""] * len(texts)
        if not fine:
            return counts, np.zeros(0, np.int64), np.zeros(0, np.int64), groups
        where = np.array([held[x] for x in fine])
        n_a, n_b = (np.array([len(ids[x]) for x in fine]) for ids in coded)
        a, b = (np.concatenate([ids[x] for x in fine]).astype(np.int64) for ids in coded)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # Tokens without bytes end where their forerunner does, and so link as often.
        both = end_a[np.append(True, end_a[1:] != end_a[:-1])]
        both = both[end_b[np.minimum(np.searchsorted(end_b, both), len(end_b) - 1)] == both]
        to_a, to_b = np.searchsorted(end_a, both, "right"), np.searchsorted(end_b, both, "right")
        many_a, many_b = to_a - np.searchsorted(end_a, both), to_b - np.searchsorted(end_b, both)
        links = many_a * many_b
        at = np.repeat(np.arange(len(both)), links)
        turn = np.arange(len(at)) - np.repeat(np.cumsum(links) - links, links)
        pairs = a[(to_a - many_a)[at] + turn // many_b[at]] * self.width + b[(to_b - many_b)[at] + turn % many_b[at]]
        doc = np.searchsorted(np.cumsum(n_a), to_a)
        counts[where] = np.stack([n_a, n_b, np.bincount(doc, minlength=len(fine)), np.bincount(doc, weights=links, minlength=len(fine)).astype(np.int64)], axis=1)
        # Where each token is written: after all of its own side, and all of the other side's earlier groups.
        group_a, group_b = np.repeat(np.arange(len(both)), np.diff(to_a, prepend=0)), np.repeat(np.arange(len(both)), np.diff(to_b, prepend=0))
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        sign_a, sign_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        sign_a[to_a - 1], sign_b[to_b - 1] = 1, 1
        codes[np.arange(len(a)) + np.append(0, to_b)[group_a]] = a + sign_a * (self.first_b // 2)
        codes[np.arange(len(b)) + to_a[group_b]] = self.first_b + b + sign_b * self.width
        told, begin = self.told.__getitem__, 0
        for k, n in zip(where.tolist(), (n_a + n_b).tolist(), strict=True):
            groups[k] = "".join(map(told, codes[begin : begin + n].tolist()))[:-1]
            begin += n
        return counts, pairs, where[doc][at], groups


def bitmaps(pairs: np.ndarray, docs: np.ndarray) -> dict[str, list | np.ndarray]:
    """(pair, plane, docs, links, bits) of the links of a block, given by pair and document number.

    Plane k of a pair holds the documents whose number of links of the pair has bit k, so its links are the sum of
    2^k times the planes' popcounts. Planes are compressed: bits is a list of document numbers of two bytes, or a
    bitmap where that is shorter. docs is the popcount of the pair's planes OR-merged, given at its lowest plane.
    """
    keys, many = np.unique(pairs << 16 | docs, return_counts=True)
    fresh = np.append(True, np.diff(keys >> 16) != 0)[: len(keys)]
    order = np.cumsum(fresh) - 1
    lowest = np.full(int(order[-1]) + 1 if len(keys) else 0, 63)
    np.minimum.at(lowest, order, np.round(np.log2(many & -many)).astype(np.int64))
    together = np.bincount(order)
    wide = (int((keys & 0xFFFF).max()) + 8) // 8 if len(keys) else 0
    found: dict[str, list] = {"pair": [], "plane": [], "docs": [], "links": [], "bits": []}
    for plane in range(int(many.max()).bit_length() if len(keys) else 0):
        on = np.flatnonzero(many >> plane & 1)
        if not len(on):
            continue
        first = np.flatnonzero(np.append(True, np.diff(order[on]) != 0))
        n = np.diff(np.append(first, len(on)))
        low = (keys[on] & 0xFFFF).astype("<u2")
        raw = low.tobytes()
        bits = [raw[2 * x : 2 * y] for x, y in zip(first.tolist(), (first + n).tolist(), strict=True)]
        for k in np.flatnonzero(2 * n > wide).tolist():
            mark = np.zeros(8 * wide, dtype=np.uint8)
            mark[low[first[k] : first[k] + n[k]]] = 1
            bits[k] = np.packbits(mark, bitorder="little").tobytes()
        mine = order[on[first]]
        found["pair"].append(keys[on[first]] >> 16)
        found["plane"].append(np.full(len(first), plane))
        found["docs"].append(np.where(lowest[mine] == plane, together[mine], 0))
        found["links"].append(n << plane)
        found["bits"] += bits
    return {k: np.concatenate(v) if v and k != "bits" else v for k, v in found.items()}


def scored_documents(rows: pd.DataFrame) -> pd.DataFrame:
    """(block, pos, n_best, count_sum) of a block's documents, from its planes with the pairs' counts (count) and
    whether a pair is its second id's best (best)."""
    n = rows["links"].to_numpy(np.int64) >> rows["plane"].to_numpy(np.int64)
    weight = rows["count"].to_numpy(np.int64) << rows["plane"].to_numpy(np.int64)
    best = np.where(rows["best"].to_numpy(bool), 1 << rows["plane"].to_numpy(np.int64), 0)
    size = np.fromiter(map(len, rows["bits"]), dtype=np.int64, count=len(rows))
    lists = size == 2 * n
    total, top, seen = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, bool)
    at = np.frombuffer(b"".join(rows["bits"][lists]), dtype="<u2").astype(np.int64)
    np.add.at(total, at, np.repeat(weight[lists], n[lists]))
    np.add.at(top, at, np.repeat(best[lists], n[lists]))
    seen[at] = True
    for k in np.flatnonzero(~lists).tolist():
        on = np.flatnonzero(np.unpackbits(np.frombuffer(rows["bits"].iloc[k], dtype=np.uint8), bitorder="little"))
        total[on] += weight[k]
        top[on] += best[k]
        seen[on] = True
    pos = np.flatnonzero(seen)
    return pd.DataFrame({"block": np.full(len(pos), rows["block"].iloc[0] if len(rows) else 0), "pos": pos, "n_best": top[pos], "count_sum": total[pos]})


@lru_cache(maxsize=1)
def _aligner(sources: tuple[bytes, bytes], kinds: tuple[type, type]) -> Aligner:
    return Aligner(sources, kinds)


def _vocabularies(df: DataFrame, paths: tuple[str, str]) -> tuple[Broadcast, tuple[type, type]]:
    sources = []
    for path in paths:
        with open(path, "rb") as f:
            sources.append(f.read())
    kinds = tuple(ByteTokens if os.path.splitext(p)[1] == ".json" else PieceTokens for p in paths)
    return df.sparkSession.sparkContext.broadcast(tuple(sources)), kinds


ROWS = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "block", "pos", *COUNTS)]
    + [("groups", pa.string()), ("groups_sha256", pa.string())]
    + [(c, pa.int64()) for c in ("pair", "plane", "docs", "links")]
    + [("bits", pa.binary())]
)


def _batch(n: int, **columns: object) -> pa.RecordBatch:
    """n rows of ROWS; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ROWS], schema=ROWS)


def alignment_table(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """Rows of two kinds. Of each document: doc_id, its block and position there, its counts and its groups (as text if
    with_groups, else their digest only). Of each pair and plane of a block (pair not null): see bitmaps.

    A block is up to DOCS documents of one task, so memory is bounded, nothing is shuffled, and bitmaps of different
    blocks hold different documents.
    """
    sources, kinds = _vocabularies(docs, (path_a, path_b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(sources.value, kinds)
        block, filled, held = TaskContext.get().partitionId() << 32, 0, 0
        pairs: list[np.ndarray] = [np.zeros(0, np.int64)]
        where: list[np.ndarray] = [np.zeros(0, np.int64)]

        def close() -> Iterator[pa.RecordBatch]:
            found = bitmaps(np.concatenate(pairs), np.concatenate(where))
            del pairs[1:], where[1:]
            n = len(found["bits"])
            for at in range(0, n, 20_000):
                m = min(20_000, n - at)
                yield _batch(m, block=np.full(m, block), **{c: x[at : at + m] for c, x in found.items()})

        for batch in batches:
            at = 0
            size = np.cumsum([0, *(len(t) if t else 0 for t in batch.column("text").to_pylist())])
            while at < len(batch):
                end = int(np.searchsorted(size, size[at] + CHARS, "right")) - 1
                part = batch.slice(at, max(1, min(end - at, SLICE, DOCS - filled)))
                n = len(part)
                at += n
                counts, linked, doc, groups = aligner.align(part.column("text").to_pylist())
                pairs.append(linked)
                where.append(doc + filled)
                told = {"groups": groups} if with_groups else {}
                told["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                yield _batch(n, doc_id=part.column("doc_id"), block=np.full(n, block), pos=np.arange(filled, filled + n), **{c: counts[:, k] for k, c in enumerate(COUNTS)}, **told)
                filled, held = filled + n, held + len(linked)
                if filled >= DOCS or held >= LINKS:
                    yield from close()
                    block, filled, held = block + 1, 0, 0
        yield from close()
        trim()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, from_arrow_schema(ROWS))


def pair_counts(planes: DataFrame) -> DataFrame:
    """(pair, docs, links): in how many documents and links of all blocks each pair is."""
    return planes.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))


def pair_scores(planes: DataFrame, width: int) -> DataFrame:
    """(pair, docs, count, best): best says whether no other pair of the same second id has more links.

    The highest counts are broadcast: one row for each id of the second vocabulary, width at most."""
    counts = pair_counts(planes).withColumnRenamed("links", "count").withColumn("b", F.pmod("pair", F.lit(width)))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select("pair", "docs", "count", (F.col("count") == F.col("highest")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs, and its groups as
    text if with_groups: `a1,a2|b1;a3|b2,b3`, ids of A and B by group.

    A (path_a) encodes a space and the text, B (path_b) the text; a .json file is a byte-level vocabulary of the
    tokenizers library, a .model file one of sentencepiece, which adds the space itself. Strings of special tokens are
    plain text. Byte offsets where tokens of both end cut a text into groups; tokens of both that end together are
    links. n_best counts the links whose pair of ids has the most links in the corpus of all pairs with its id of B,
    ties included; count_sum adds up the pairs' links in the corpus over the document's links.

    Each block of documents keeps compressed bitmaps by pair; their popcounts are added up by pair, combined before
    the shuffle, and the pairs' scores are joined back to the bitmaps, whose bits hand them to documents, block by
    block. A block's size is bounded, a pair that all documents have is a row of each block, and the join splits
    where such rows crowd.

    Null and empty texts, and texts whose tokens' bytes are not a space and the text (as where they hold the sign that
    B has for a space), have no tokens: zeros and no groups. Repeated rows count and get a row each; a null doc_id
    stays null; an empty table gives no rows; other columns are not read.
    """
    table = settle(alignment_table(docs, path_a, path_b, with_groups), "alignment")
    with open(path_b, "rb") as f:
        width = len((ByteTokens if path_b.endswith(".json") else PieceTokens)(f.read()).strings)
    planes = table.filter("pair IS NOT NULL").select("pair", "block", "plane", "docs", "links", "bits")
    scores = pair_scores(planes, width).select("pair", "count", "best")
    scored = planes.select("pair", "block", "plane", "links", "bits").join(scores, "pair").drop("pair")
    found = scored.groupBy("block").applyInPandas(scored_documents, "block long, pos long, n_best long, count_sum long")
    own = table.filter("pair IS NULL").select("doc_id", "block", "pos", *COUNTS, *(["groups"] if with_groups else []), "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    out = own.join(found, ["block", "pos"], "left")
    return out.select("doc_id", *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256", *(["groups"] if with_groups else []))
