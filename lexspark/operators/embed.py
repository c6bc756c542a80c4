"""Embeddings of texts: TF-IDF over a learned or a fixed vocabulary, and any batch embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions.legal import VOCABULARY
from lexspark.functions.text import WORD
from lexspark.operators.lineage import settle, spread


#: What a token must look like: letters of English, or any word characters.
LATIN, ANY = "^[a-z]{2,}$", "^.{2,}$"


def tokens(texts: DataFrame, stop_words: list[str], token: str = LATIN) -> DataFrame:
    """(id, t): the tokens of texts (id, text) without stop words, written once for the passes over them."""
    found = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(f"{WORD}+"), F.lit(0)), lambda t: t.rlike(token) & (~t.isin(*stop_words) if stop_words else F.lit(True)))
    return settle(spread(texts).select("id", found.alias("t")), "tokens")


def _tokens(texts: DataFrame, stop_words: list[str], token: str = LATIN) -> DataFrame:
    return texts if "t" in texts.columns else tokens(texts, stop_words, token)


def _grams(words: DataFrame, most: int, only: list[str] | None = None) -> DataFrame:
    """(id, term) of each n-gram of 1 to most tokens, repeats included; of those whose tokens are all among only."""
    rows = words if only is None else words.select("id", F.transform("t", lambda t: F.when(t.isin(*only), t)).alias("t"))

    def runs(n: int) -> Column:
        each = lambda i: [x for k in range(n) for x in (F.lit(" "), F.element_at("t", i + k))][1:]
        found = F.col("t") if n == 1 else F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.concat(*each(i)))
        found = found if only is None else F.filter(found, lambda term: term.isNotNull())
        return F.when(F.size("t") >= n, found).otherwise(F.array().cast("array<string>"))

    return rows.select("id", F.explode(F.concat(*[runs(n) for n in range(1, most + 1)])).alias("term"))


def _words_of(terms: DataFrame) -> list[str]:
    """The tokens of the terms of a model, which its features bound."""
    return sorted({w for r in terms.select("term").collect() for w in r["term"].split(" ")})


def _frequent(totals: DataFrame, features: int) -> list[str] | None:
    """The tokens of which all terms among the most frequent consist; None where that leaves out few.

    totals: (term, total) of single tokens. No term occurs more often than any of its tokens, so one with a token under
    the total of the last of the most frequent tokens comes after all of these."""
    totals = settle(totals, "totals")
    last = totals.orderBy(F.desc("total")).limit(features).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
    if last["n"] < features:
        return None
    found = totals.filter(F.col("total") >= last["least"]).limit(10 * features + 1).collect()
    return [r["term"] for r in found] if len(found) <= 10 * features else None


def _totals(texts: DataFrame, stop_words: list[str], most: int) -> DataFrame:
    # Tokens are dealt by text, so the terms of a text, which are many more, are counted where they arise.
    counts = _grams(_tokens(texts, stop_words).repartition("id"), most).groupBy("id", "term").count()
    return counts.groupBy("term").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("df"))


def _idf(n: Column) -> Column:
    return F.log((1 + n) / (1 + F.col("df"))) + 1


def term_counts(texts: DataFrame, stop_words: list[str], most: int = 2) -> DataFrame:
    """(term, total, df): how often each term is in the texts (id, text) and in how many of them. The row of the null
    term has the number of texts. Counts of separate sets of texts add up (add_counts)."""
    texts = _tokens(texts, stop_words)
    n = texts.agg(F.count(F.lit(1)).alias("total")).select(F.lit(None).cast("string").alias("term"), "total", F.col("total").alias("df"))
    return _totals(texts, stop_words, most).unionByName(n)


def add_counts(*counts: DataFrame) -> DataFrame:
    """The counts of all the texts that these are counts of."""
    return reduce(DataFrame.unionByName, counts).groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def model_of(counts: DataFrame, features: int = 1000) -> DataFrame:
    """(term, idf) of the most frequent terms, ties to the lesser term, as fit_tfidf gives it for the texts counted."""
    n = counts.filter("term is null").agg(F.sum("total").alias("n"))
    top = counts.filter("term is not null").orderBy(F.desc("total"), "term").limit(features)
    return top.crossJoin(F.broadcast(n)).select("term", _idf(F.col("n")).alias("idf"))  # one row


def fit_tfidf(texts: DataFrame, stop_words: list[str], features: int = 1000, most: int = 2) -> DataFrame:
    """(term, idf) of the terms most frequent in the corpus, ties to the lesser term.

    texts: (id, text), or tokens of them. Tokens are counted first, then terms of frequent tokens only, then the texts
    that have one of the most frequent terms; the model is bounded by features.
    """
    words = _tokens(texts, stop_words)
    only = _frequent(_grams(words, 1).groupBy("term").agg(F.count(F.lit(1)).alias("total")), features)
    totals = _grams(words, most, only).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
    top = settle(totals.orderBy(F.desc("total"), "term").limit(features).select("term"), "top")
    counts = _grams(words, most, _words_of(top)).join(F.broadcast(top), "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counts.select("term", _idf(F.lit(words.count())).alias("idf"))


def store_counts(texts: DataFrame, root: str, batch: int, stop_words: list[str], most: int = 2) -> None:
    """Add a batch of new texts to the counts stored under root; a batch that is added again replaces itself. Nothing
    else is read or written."""
    term_counts(texts, stop_words, most).write.mode("overwrite").parquet(f"{root}/batch={batch}")


def stored_model(spark: SparkSession, root: str, features: int = 1000) -> DataFrame:
    """The model of all texts whose counts are stored under root; only terms of frequent tokens are added up."""
    counts = spark.read.parquet(root).select("term", "total", "df")
    only = _frequent(counts.filter(~F.contains("term", F.lit(" "))).groupBy("term").agg(F.sum("total").alias("total")), features)
    if only is not None:
        counts = counts.filter(F.col("term").isNull() | F.forall(F.split("term", " "), lambda t: t.isin(*only)))
    return model_of(settle(add_counts(counts), "counts"), features)


def fixed_vocabulary(texts: DataFrame, stop_words: list[str]) -> DataFrame:
    """(term, idf) of the legal vocabulary, up to three words a term."""
    words = _tokens(texts, stop_words, ANY)
    n = words.count()
    terms = texts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in VOCABULARY])).alias("term"))
    counts = _grams(words, 3, _words_of(terms)).join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.countDistinct("id").alias("df"))
    idf = F.log((1 + F.lit(n)) / (1 + F.coalesce("df", F.lit(0)))) + 1
    return terms.join(counts, "term", "left").select("term", idf.alias("idf"))


def tfidf(texts: DataFrame, model: DataFrame, stop_words: list[str], most: int = 2, sublinear: bool = False) -> DataFrame:
    """(id, term, weight) of the model's terms in each text, at length one over a text's terms.

    texts: (id, text), or tokens of them. The model is broadcast: fit_tfidf bounds it by its number of features.
    """
    model = settle(model, "model")
    words = _tokens(texts, stop_words, ANY if sublinear else LATIN)
    counts = _grams(words, most, _words_of(model)).join(F.broadcast(model), "term").groupBy("id", "term", "idf").count()
    tf = (1 + F.log(F.col("count").cast("double"))) if sublinear else F.col("count").cast("double")
    raw = counts.select("id", "term", (tf * F.col("idf")).alias("w"))
    total = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / total).alias("weight"))


def embed_with(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], name: str, batch: int = 32) -> DataFrame:
    """texts (id, text) with embedding, embedding_model and embedding_dimension by any embedder.

    load runs once in each task and returns a function from a list of texts to a list of vectors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                vectors = embed(part["text"].fillna("").tolist())
                yield part.assign(embedding=[list(map(float, v)) for v in vectors], embedding_model=name, embedding_dimension=[len(v) for v in vectors])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, text string, embedding array<float>, embedding_model string, embedding_dimension int")
