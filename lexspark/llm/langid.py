"""Language of texts: script ranges, word scores of letter n-grams, Viterbi spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.memory import trim

#: Runs of letters, and of the few other word characters that are no decimal digits, such as fractions.
WORD = re.compile(r"[^\W\d_]+")
#: First and last code point of the scripts told apart (fixed values of Unicode's blocks); else "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9D)),
    "han": ((0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
NAMES = [*SCRIPTS, "other"]
_EDGES = sorted((a, b, k) for k, name in enumerate(SCRIPTS) for a, b in SCRIPTS[name])
_FIRST = np.array([e[0] for e in _EDGES])
_LAST = np.array([e[1] for e in _EDGES])
_SCRIPT = np.array([e[2] for e in _EDGES])

#: Hash buckets of n-grams; a model has this many rows for each language.
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
#: Words a worker remembers before it starts afresh.
CACHE = 300_000
#: Texts whose words are held at once, and distinct words that are counted before their n-grams are.
SLICE, COUNTED = 200, 50_000
#: What a word of a script that a language does not use scores there.
FOREIGN = -50.0


def letter_runs(text: str) -> list[str]:
    """Runs of letters (Unicode's categories L) of the lower-cased text."""
    found = WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [run for w in found for run in "".join(c if c.isalpha() else " " for c in w).split()]


def scripts(first: np.ndarray) -> np.ndarray:
    """The script of each code point."""
    at = np.maximum(np.searchsorted(_FIRST, first, side="right") - 1, 0)
    return np.where((first >= _FIRST[at]) & (first <= _LAST[at]), _SCRIPT[at], len(NAMES) - 1)


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word, script of each word): the hashed n-grams of every word between edge marks."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    end = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    room = np.repeat(end, size) - np.arange(len(code))
    buckets, owners = [], []
    value = code.copy()
    for n in range(2, max(GRAMS) + 1):
        value = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(room[: len(value)] >= n)
            buckets.append(((value[at] ^ (value[at] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49))
            owners.append(word[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), scripts(code[end - size + 1].astype(np.int64))


@dataclass
class LanguageModel:
    """langs in order; grams: log shares by bucket and language; used: whether a language uses a script."""

    langs: list[str]
    grams: np.ndarray
    used: np.ndarray


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id's text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_languages(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> LanguageModel:
    """Counts of hashed n-grams and scripts over all rows with a language and a text.

    Each task adds up its own counts, so what is shuffled and collected is bounded by languages x
    (BUCKETS + scripts), whatever the number of rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        counts: dict[str, Counter] = {}

        def add(lang: str, found: Counter) -> None:
            if found:
                times = np.fromiter(found.values(), dtype=np.float64, count=len(found))
                bucket, owner, script = word_grams(list(found))
                sums = total.setdefault(lang, np.zeros(BUCKETS + len(NAMES)))
                sums += np.bincount(bucket, times[owner], minlength=BUCKETS + len(NAMES))
                sums += np.bincount(BUCKETS + script, times, minlength=BUCKETS + len(NAMES))
                found.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                found = counts.setdefault(lang, Counter())
                found.update(letter_runs(text))
                if len(found) > COUNTED:
                    add(lang, found)
        for lang, found in counts.items():
            add(lang, found)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": sums[at]})
        counts.clear()
        trim()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    found = rows.mapInPandas(run, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + len(NAMES), len(langs)))
    counts[found["bucket"], [langs.index(x) for x in found["lang"]]] = found["n"]
    grams, script = counts[:BUCKETS] + 0.5, counts[BUCKETS:]
    used = script >= 0.001 * np.maximum(script.sum(axis=0), 1)
    return LanguageModel(langs, np.log(grams / grams.sum(axis=0)), used & (script > 0))


class Labeler:
    """Word scores and spans under a model."""

    def __init__(self, model: LanguageModel, penalty: float) -> None:
        self.model, self.penalty = model, penalty
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(model.langs)), dtype=np.float32)
        self.foreign: set[str] = set()

    def learn(self, words: list[str]) -> None:
        bucket, owner, script = word_grams(words)
        n = len(words)
        scores = np.stack([np.bincount(owner, self.model.grams[bucket, k], minlength=n) for k in range(len(self.model.langs))], axis=1)
        used = self.model.used[script]
        scores = np.where(used, scores, np.where(used.any(axis=1, keepdims=True), scores.max(axis=1, keepdims=True) + FOREIGN, 0.0))
        start = len(self.index)
        while start + n > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        self.scores[start : start + n] = scores
        self.index.update(zip(words, range(start, start + n), strict=True))
        self.foreign.update(words[k] for k in np.flatnonzero(~used.any(axis=1)))

    def prepare(self, found: list[list[str]]) -> None:
        """Score the words of a batch that are not known yet."""
        known, missing = self.index, set()
        for words in found:
            missing.update([w for w in words if w not in known])
        if len(known) + len(missing) > CACHE:
            known.clear()
            self.foreign.clear()
            missing = {w for words in found for w in words}
        if missing:
            self.learn(list(missing))

    def split(self, texts: pd.Series) -> Iterator[list[str]]:
        """The words of each text, their scores prepared; none where there is no model."""
        for at in range(0, len(texts), SLICE):
            found = [letter_runs(t) if t and self.model.langs else [] for t in texts[at : at + SLICE]]
            self.prepare(found)
            yield from found

    def share(self, words: list[str]) -> float:
        """The share of the words that the prevailing language on the best path has; words of a script that no
        language uses count for none."""
        path = self.path(words)
        if self.foreign:
            path = path[[w not in self.foreign for w in words]]
        return np.bincount(path, minlength=1).max() / len(words)

    def path(self, words: list[str]) -> np.ndarray:
        """The language of each word on the best path, where each change costs the penalty.

        The language that is best overall holds throughout if no stretch of words gains over the penalty
        elsewhere, and no beginning and end together do: every stretch elsewhere costs one change at
        least, or, without a word of the best language, all but one.
        """
        index = self.index
        s = self.scores[[index[w] for w in words]].astype(np.float64)
        best = int(s.sum(axis=0).argmax())
        gain = np.cumsum(s - s[:, best : best + 1], axis=0)
        low = np.minimum.accumulate(np.minimum(gain, 0.0), axis=0)
        start, end = gain.max(initial=0.0), (gain[-1] - low[-1]).max(initial=0.0)
        if (gain - low).max() <= self.penalty and start + end <= self.penalty:
            return np.full(len(s), best)
        first, *rest = s.tolist()
        at, back = first, []
        for row in rest:
            lead = max(at)
            change = lead - self.penalty
            if min(at) >= change:
                back.append(None)  # nobody gains by a change
                at = [a + x for a, x in zip(at, row)]
            else:
                lead = at.index(lead)
                back.append([k if a >= change else lead for k, a in enumerate(at)])
                at = [(a if a >= change else change) + x for a, x in zip(at, row)]
        path = [at.index(max(at))]
        for step in reversed(back):
            path.append(path[-1] if step is None else step[path[-1]])
        return np.array(path[::-1])



def label_languages(docs: DataFrame, model: LanguageModel, penalty: float = 40.0, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """docs' rows as (id, lang_pred, score, n_words), with spans also an array of (lang, first, last) words.

    lang_pred is the language of most words on the best path, ties to the first in order; score is its
    share of them. Repeated rows are labelled alike, an empty table gives no row. Null texts and texts without a letter get und and 0, and so does every text if nothing
    was learned. All other columns of docs are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "id string, lang_pred string, score double, n_words long" + (", spans array<struct<lang:string,first:int,last:int>>" if spans else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeler = Labeler(shared.value, penalty)
        langs = labeler.model.langs
        for batch in batches:
            pred, score, cuts, n = [], [], [], []
            for words in labeler.split(batch["text"]):
                n.append(len(words))
                if not words:
                    pred.append("und")
                    score.append(0.0)
                    cuts.append([])
                    continue
                path = labeler.path(words)
                share = np.bincount(path, minlength=len(langs))
                pred.append(langs[int(share.argmax())])
                score.append(float(share.max() / len(words)))
                if spans:
                    at = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
                    cuts.append([(langs[path[a]], int(a), int(b) - 1) for a, b in zip(at, np.append(at[1:], len(path)), strict=True)])
            out = pd.DataFrame({"id": batch["id"], "lang_pred": pred, "score": score, "n_words": n})
            if spans:
                out["spans"] = cuts
            yield out
        del labeler
        trim()

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema).withColumn("id", F.col("id").cast("long"))


def document_languages(docs: DataFrame, penalty: float = 40.0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents, learned from those that are not held out."""
    model = train_languages(docs.filter(~held_out()))
    return label_languages(docs, model, penalty).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score"
    )


def filter_languages(docs: DataFrame, model: LanguageModel, least: float, penalty: float = 40.0, text_col: str = "text") -> DataFrame:
    """The rows of docs with a language that has more than the share least of their words, and all their columns.

    Words of a script that no learned language uses belong to no language. Null texts and texts without a
    letter go; repeated rows are judged alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def prevails(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        labeler = Labeler(shared.value, penalty)
        for texts in batches:
            yield pd.Series([bool(w) and labeler.share(w) > least for w in labeler.split(texts)], dtype=bool)
        del labeler
        trim()

    return docs.filter(prevails(F.col(text_col)))
