"""Quality rules: repetition and symbol counts, and a likelihood ratio of hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.memory import trim
from lexspark.operators.lineage import forget, settle
from lexspark.operators.sieve import sieved

BUCKETS = 1 << 16
#: Bins of the histogram of labelled scores, and its range.
BINS, SPAN = 2000, 10.0
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Word hashes a worker remembers before it starts afresh.
CACHE = 300_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """XXH64 of words by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def hashed(words: list[bytes], cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def features(h: np.ndarray) -> np.ndarray:
    """The buckets of all words and pairs of neighbouring words."""
    pairs = (h[:-1] * MIX) ^ (h[1:] >> np.uint64(7))
    return (np.concatenate([h, pairs * MIX]) >> np.uint64(48)).astype(np.int64)


def repeated_words(words: list[bytes], h: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of window words found at least twice, the first place included."""
    if len(words) <= window:
        return 0
    value = np.zeros(len(h) - window + 1, dtype=np.uint64)
    for k in range(window):
        value = value * MIX + h[k : len(h) - window + 1 + k]
    order = np.sort(value)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    seen: dict[tuple[bytes, ...], list[int]] = {}  # equal hashes: compare the words themselves
    for at in np.flatnonzero(np.isin(value, twice)).tolist():
        seen.setdefault(tuple(words[at : at + window]), []).append(at)
    mark = np.zeros(len(h) + 1, dtype=np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(mark, places, 1)
            np.add.at(mark, [p + window for p in places], -1)
    return int((np.cumsum(mark)[:-1] > 0).sum())


def counts(text: str | None, cache: Hashes) -> tuple[list[bytes], np.ndarray, int, int, int, int]:
    """(words, hashes, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    h = hashed(words, cache)
    blank = sum(raw.count(b) for b in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return words, h, len(text or "") - blank, sum(raw.count(s) for s in [SYMBOLS[k : k + 1] for k in range(len(SYMBOLS))]), len(lines) - len(set(lines)), repeated_words(words, h)


@dataclass
class QualityModel:
    """ratio: log share in the target less log share in the corpus, by bucket. Texts under threshold fail."""

    ratio: np.ndarray
    threshold: float


def _labelled(labels: DataFrame) -> DataFrame:
    """(id, good) of every labelled id, several labels as their worst."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).cast("int").alias("good")).dropna()
    return rows.groupBy("id").agg(F.min("good").alias("good"))


def train_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The hashed word and word-pair multinomials of good labelled documents and of all documents.

    The corpus multinomial counts every document; the target and the threshold come from all labelled rows, whose
    texts are shuffled once to their labels. The threshold is the one that best tells
    good from bad labelled documents by mean recall, the lowest among equals, from a histogram; without
    labels of both kinds every text passes.
    """
    marked = _labelled(labels)
    near, rest = sieved(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), F.col("id"), marked, "id")
    # Shuffled whatever the size of the labels
    near = settle(near.join(marked.hint("shuffle_hash"), "id", "left").select("text", "good"), "labelled")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, total = Hashes(), np.zeros((2, BUCKETS))
        for batch in batches:
            for text, good in zip(batch["text"], batch["good"], strict=True):
                at = np.bincount(features(hashed((text or "").encode("utf-8", "surrogatepass").split(), cache)), minlength=BUCKETS)
                total[0] += at
                if good == 1:
                    total[1] += at
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": at, "every": total[0, at], "target": total[1, at]})
        cache.clear()
        trim()

    found = (
        near.unionByName(rest.select("text", F.lit(None).cast("int").alias("good")))
        .mapInPandas(run, "bucket int, every double, target double")
        .groupBy("bucket")
        .agg(F.sum("every").alias("every"), F.sum("target").alias("target"))
        .toPandas()
    )
    total = np.zeros((2, BUCKETS))
    total[0, found["bucket"]], total[1, found["bucket"]] = found["every"], found["target"]
    share = (total + 0.5) / (total + 0.5).sum(axis=1, keepdims=True)
    model = QualityModel(np.log(share[1]) - np.log(share[0]), -np.inf)
    scores = document_scores(near.filter("good is not null"), model, ["good"])
    at = F.least(F.greatest(F.floor((F.col("llr") + SPAN / 2) / SPAN * BINS), F.lit(0)), F.lit(BINS - 1)).cast("int")
    bins = scores.filter("not base_failed").groupBy("good", at.alias("bin")).count().toPandas()
    forget(near)
    hist = np.zeros((2, BINS))
    hist[bins["good"], bins["bin"]] = bins["count"]
    if hist.sum(axis=1).min() > 0:
        under = np.cumsum(hist, axis=1) / hist.sum(axis=1, keepdims=True)
        model.threshold = (int((under[0] - under[1]).argmax()) + 1) / BINS * SPAN - SPAN / 2
    return model


def judge(text: str | None, model: QualityModel, cache: Hashes) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) of a text."""
    words, h, *rest = counts(text, cache)
    n, again = len(words), rest[3]
    failed = n < 20 or 100 * again > 30 * n
    llr = float(model.ratio[features(h)].mean()) if n else 0.0
    return n, *rest, failed, llr, not failed and llr >= model.threshold


def document_scores(rows: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """keep and the counts, base_failed, the ratio per feature (llr) and kept, for the column text of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    kinds = ["long"] * 5 + ["boolean", "double", "boolean"]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"{c} {k}" for c, k in zip(names, kinds, strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cache = shared.value, Hashes()
        for batch in batches:
            out = [judge(text, model, cache) for text in batch["text"]]
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)
        cache.clear()
        trim()

    return rows.select(*keep, "text").mapInPandas(run, schema)


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, llr and kept of every document.

    Null and empty texts have no words and fail. Ties and repeated rows are judged alike, row by row. A
    label of a document that is not there is ignored; several labels of one id count as their worst. A null doc_id
    stays null, an empty table gives no rows, and without labels of both kinds the counts alone decide.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    scored = document_scores(rows, train_quality(docs, labels), ["doc_id"])
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def filter_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the counts and the ratio, all columns kept.

    Null and empty texts fail; ties at the threshold pass; repeated rows are judged alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def passes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache = Hashes()
        for texts in batches:
            yield pd.Series([judge(t, shared.value, cache)[-1] for t in texts], dtype=bool)
        cache.clear()
        trim()

    return docs.filter(passes(F.col(text_col)))
