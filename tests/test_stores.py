"""What stored models, counts and similarities give, against the same from scratch."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import analytics, embed, similarity
from tests.measure import shuffled


def vectors(spark, n=400, width=16, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    v[n // 2 :] = v[: n - n // 2] + rng.uniform(0.1, 0.9, size=(n - n // 2, 1)) * rng.normal(size=(n - n // 2, width))  # near pairs among spread vectors
    return spark.createDataFrame(list(enumerate(v.tolist())), "doc_id long, embedding array<double>").repartition(4)


def pairs_of(df):
    return {(r["doc1_id"], r["doc2_id"]): round(r["similarity_score"], 9) for r in df.collect()}


def test_bands_send_few_copies():
    """a low threshold at a high recall sent each vector to 1,240 bands of 50,000 vectors."""
    for n in (1_000, 50_000, 100_000, 600_000):
        bits = similarity.bits_for(n, 0.43, 0.9999)
        assert similarity.bands_for(0.43, bits, 0.9999) * max(1, n / 2**bits / similarity.PART) <= max(1, n / similarity.PART)
    assert similarity.bits_for(1_000_000, 0.9, 0.95) > 4


def test_banded_pairs(spark, monkeypatch):
    """True pairs only, each once, and nine of ten at least; whole and cut into parts."""
    docs = vectors(spark)
    exact = pairs_of(similarity.similar_documents(docs, 0.7))
    assert len(exact) > 100
    found = similarity.similar_documents_banded(docs, 0.7, bits=8)
    assert found.count() == len(pairs_of(found)) and pairs_of(found).items() <= exact.items()
    assert len(pairs_of(found)) >= 0.9 * len(exact)
    monkeypatch.setattr(similarity, "BLOCK", 3)
    assert pairs_of(similarity.similar_documents_banded(docs, 0.7, bits=8)) == pairs_of(found)
    copies = docs.limit(1).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))).alias("doc_id"), "embedding")
    assert len(pairs_of(similarity.similar_documents_banded(copies, 0.9, bits=8))) == 30 * 29 / 2
    assert similarity.similar_documents_banded(docs.filter("false")).count() == 0


def test_vectors_of_one_value_meet_in_many_tasks(spark, monkeypatch):
    """without signs all vectors have one value, and all parts of a value were compared in one task."""
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "PART", 40)
    docs = vectors(spark)
    copies = docs.limit(1).select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(200).cast("long"))).alias("doc_id"), "embedding")
    for rows, least, bits in ((docs, 0.43, 0), (docs.withColumn("embedding", F.col("embedding").cast("array<float>")), 0.43, 0), (copies, 0.9, 8)):
        found = similarity.similar_documents_banded(rows, least, bits).withColumn("task", F.spark_partition_id()).toPandas()
        assert found["task"].nunique() >= 6 and found["task"].value_counts(normalize=True).max() < 0.5
        exact = similarity.similar_documents(rows, least).toPandas()
        one, two = (f.sort_values(["doc1_id", "doc2_id"]).reset_index(drop=True) for f in (found.drop(columns="task"), exact))
        assert len(one) and (one[["doc1_id", "doc2_id"]] == two[["doc1_id", "doc2_id"]]).all(axis=None)
        assert np.allclose(one["similarity_score"], two["similarity_score"], rtol=0, atol=1e-12)


def test_rows_without_id_have_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    monkeypatch.setattr(similarity, "PART", 40)
    docs = vectors(spark, 200)
    some = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    found = pairs_of(similarity.similar_documents_banded(some, 0.43, 0))
    assert found == pairs_of(similarity.similar_documents(docs.filter("doc_id % 3 > 0"), 0.43))


@pytest.mark.parametrize("tile", [1024, 7])
def test_single_precision_decides_nothing(monkeypatch, tile):
    """Pairs closer to the threshold than single precision tells stay or go by their cosine in double precision."""
    monkeypatch.setattr(similarity, "TILE", tile)
    monkeypatch.setattr(similarity, "CHECKED", 5)
    rng = np.random.default_rng(5)
    base = np.linalg.qr(rng.normal(size=(64, 64)))[0][:20]
    cosine = 0.43 + np.linspace(-3e-9, 3e-9, 30).reshape(-1, 1)
    near = cosine * base[0] + np.sqrt(1 - cosine**2) * base[1]
    v = np.concatenate([base, near, np.full((1, 64), np.nan)])
    for two in (None, v[10:]):
        want = v @ (v if two is None else two).T >= 0.43
        want = np.triu(want, 1) if two is None else want
        x, y, score = map(np.concatenate, zip(*similarity.pairs_within(v, two, 0.43), strict=True))
        assert sorted(zip(x.tolist(), y.tolist(), strict=True)) == [tuple(p) for p in np.argwhere(want).tolist()]
        assert 0 < want[0].sum() < 30 and np.allclose(score, (v @ (v if two is None else two).T)[x, y], rtol=0, atol=1e-12)


@pytest.mark.parametrize("block", [2000, 40])
def test_new_documents_add_their_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    docs, new = vectors(spark), F.col("doc_id") % 5 == 1
    old, more = similarity.similar_documents(docs.filter(~new), 0.6), similarity.similar_documents(docs, 0.6, new=new)
    every = similarity.similar_documents(docs, 0.6)
    assert pairs_of(old) | pairs_of(more) == pairs_of(every) and not set(pairs_of(old)) & set(pairs_of(more))
    grown = similarity.grown_clusters(similarity.clusters(old, 0.65), more, 0.65)
    key = lambda df: {r["doc_id"]: (r["cluster_id"], r["cluster_size"]) for r in df.collect()}
    assert key(grown) == key(similarity.clusters(every, 0.65))


def test_the_maximum_is_found_below_any_threshold(spark):
    docs = spark.createDataFrame([(k, [float(k == j) + 0.05 * (k + j) for j in range(4)]) for k in range(4)], "doc_id long, embedding array<double>")
    v = np.array([r["embedding"] for r in docs.orderBy("doc_id").collect()])
    cosine = (v @ v.T / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None, :])[np.triu_indices(4, 1)]
    row = similarity.similarity_totals(docs, similarity.similar_documents(docs, 0.95)).first()
    assert row["max_similarity"] == pytest.approx(cosine.max()) and row["max_similarity"] < 0.95
    far = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.1])], docs.schema)
    assert similarity.highest_similarity(far) < 0 and similarity.highest_similarity(far.limit(1)) == 0


def test_term_counts_add_up(spark, tmp_path):
    texts = spark.createDataFrame([(k, "alpha beta " * (k % 3) + f"word{k % 7} gamma and delta" if k % 11 else None) for k in range(60)], "id long, text string")
    want = sorted(map(tuple, embed.fit_tfidf(texts, ["and"], 12).collect()))
    for _ in range(2):
        for batch in (0, 1):
            embed.store_counts(texts.filter(F.col("id") % 2 == batch), str(tmp_path), batch, ["and"])
    assert sorted(map(tuple, embed.stored_model(spark, str(tmp_path), 12).collect())) == want
    assert embed.model_of(embed.term_counts(texts.filter("false"), [])).count() == 0


def test_running_counts_of_a_crowded_moment(spark):
    """All rows of one time: counts go on over many ranges, and no range holds all of it."""
    at = datetime(2024, 1, 1)
    rows = [(at if k % 10 else at + timedelta(minutes=k), k % 2, f"d{k:05}") for k in range(3000)] + [(None, 0, "x")]
    df = spark.createDataFrame(rows, "ts timestamp, q int, name string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        held = df.repartitionByRange(9, "ts", "q", "name", F.monotonically_increasing_id()).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        got = analytics.running_counts(df.filter("ts is not null"), ["ts", "q", "name"], "q = 0", "n").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = got.sort_values(["ts", "q", "name"])
    assert held < 1000 and len(got) == 3000
    assert got["n"].tolist() == (got["q"] == 0).cumsum().tolist() and list(got.columns) == ["ts", "q", "name", "n"]


def test_sketches_of_days(spark):
    day = datetime(2024, 1, 1)
    rows = [(day + timedelta(hours=7 * k), f"u{k % 700}", f"t{k % 30}", float(k % 5), None if k % 3 else 0.5) for k in range(3000)] + [(None, "u", "t", 1.0, 1.0)]
    log = spark.createDataFrame(rows, "timestamp timestamp, user_id string, query_type string, processing_time double, avg_similarity_score double")
    sketches = analytics.daily_sketches(log).cache()
    for first, last in ((date(2024, 1, 10), date(2024, 3, 20)), (date(2024, 1, 1), date(2030, 1, 1)), (date(2020, 1, 1), date(2020, 1, 2))):
        own = log.filter(F.to_date("timestamp").between(F.lit(first), F.lit(last)))
        want = analytics.query_stats(own, datetime(2030, 1, 1), 4000).first().asDict()
        got = analytics.sketched_stats(sketches, first, last).first().asDict()
        users, estimate = want.pop("unique_users"), got.pop("unique_users")
        assert got == want and abs(estimate - users) <= users * analytics.USERS_ERROR
        assert analytics.sketched_types(sketches, first, last).collect() == analytics.top_query_types(own, datetime(2030, 1, 1), 4000).collect()


def test_sessions_end_after_a_gap(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("a", "ask", at(0)), ("a", "see", at(30)), ("a", "ask", at(61)), ("b", "ask", at(10)), (None, "ask", at(1)), ("b", "ask", None), ("a", "ask", at(61))]
    got = analytics.engagement_by_gap(spark.createDataFrame(rows, "user_id string, activity_type string, timestamp timestamp"), ("ask",)).first()
    assert tuple(got) == (3, 10.0, pytest.approx(4 / 3, abs=1e-3))


def test_frequent_terms_need_few_pairs(spark, tmp_path):
    """every pair of words of every text was shuffled; one of rare words cannot be frequent."""
    row = "concat_ws(' ', transform(sequence(1, 300), i -> concat('w', translate(CAST(hash(id, i) % 9 AS STRING), '-012345678', 'qabcdefghi'), ' ', translate(sha2(concat(id, i), 256), '0123456789', 'ghijklmnop'))))"
    texts = spark.range(0, 200, numPartitions=4).select("id", F.expr(row).alias("text"))
    want = embed.model_of(embed.term_counts(texts, ["and"]), 10)
    found = []
    moved = shuffled(spark, lambda: found.append(sorted(map(tuple, embed.fit_tfidf(texts, ["and"], 10).collect()))))
    assert found[0] == sorted(map(tuple, want.collect()))
    assert moved < 8_000_000  # pairs of words: 20 MB and more, compressed
    embed.store_counts(texts.filter("id % 2 = 0"), str(tmp_path), 0, ["and"])
    embed.store_counts(texts.filter("id % 2 = 1"), str(tmp_path), 1, ["and"])
    assert sorted(map(tuple, embed.stored_model(spark, str(tmp_path), 10).collect())) == found[0]
