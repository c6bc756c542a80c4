"""The pipeline against a plain version of each stage on the whole smallest table."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import langid, quality, simhash
from lexspark.operators.lineage import settle
from tests.conftest import SF
from tests.llm.test_operators import check_packing, plain_counts, plain_spans
from tests.measure import shuffled

KINDS = ("EMAIL", "IP", "CARD", "PHONE", "SECRET")


def plain_language(texts, model, penalty=40.0):
    own = langid.Labeler(model, penalty)
    kept = []
    for i, t in texts.items():
        words = langid.WORD.findall(t.lower())
        if not words:
            continue
        own.prepare([words])
        s = np.array([own.scores[own.index[w]] for w in words], dtype=float)
        at, back = s[0].copy(), []
        for row in s[1:]:
            stay = at >= at.max() - penalty
            back.append(np.where(stay, np.arange(len(at)), at.argmax()))
            at = np.where(stay, at, at.max() - penalty) + row
        path = [int(at.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        if max(path.count(k) for k in set(path)) > 0.5 * len(path):
            kept.append(i)
    return kept


def plain_quality(texts, model):
    import xxhash

    mix, full = 0x9E3779B97F4A7C15, 2**64 - 1
    kept = []
    for i, t in texts.items():
        n, *_, again = plain_counts(t)
        if n < 20 or 100 * again > 30 * n:
            continue
        h = [xxhash.xxh64_intdigest(w, 42) for w in t.encode().split()]
        pairs = [((((a * mix) & full) ^ (b >> 7)) * mix) & full for a, b in zip(h, h[1:])]
        if np.mean([model.ratio[x >> 48] for x in h + pairs]) >= model.threshold - 1e-12:
            kept.append(i)
    return kept


def plain_copies(texts):
    sets, parent = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [i for i in ids if find(i) == i]


def plain_redaction(text):
    out, at = [], 0
    secrets = [(m.start(1), 4, m.end(1)) for m in re.finditer('token = "([0-9a-f]{40})"', text)]
    for a, k, b in sorted(plain_spans(text) + secrets, key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(settle(stage(spark, found[-1], SF), name))
    return found


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_each_stage_equals_its_plain_version(spark, stages):
    docs, language, rules, copies, private, packed = stages
    before = texts_of(docs)
    model = langid.train_languages(docs.filter(~langid.held_out()))
    assert sorted(texts_of(language)) == sorted(plain_language(before, model))
    model = quality.train_quality(language, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(texts_of(rules)) == sorted(plain_quality(texts_of(language), model))
    assert sorted(texts_of(copies)) == plain_copies(texts_of(rules))
    assert texts_of(private) == {i: plain_redaction(t) for i, t in texts_of(copies).items()}
    rows = packed.toPandas()
    check_packing(rows, list(texts_of(private).items()))
    assert sorted(rows["doc_id"].unique()) == sorted(texts_of(private))


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert got.select(key).exceptAll(stages[-1].select(key)).count() == 0 and got.count() == stages[-1].count()


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    rows = [(1, None, None, "s", 0), (None, "words " * 30, "en", "s", 1), (2, "", "en", None, None), (3, "fine words of a text " * 9, None, "s", 3), (3, "fine words of a text " * 9, None, "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for kept in (rows, []):
        df = spark.createDataFrame(kept, schema).withColumn("id", F.lit(1))
        for _, stage in corpus_pipeline.STAGES:
            df = settle(stage(spark, df, str(tmp_path)), "odd")
        assert df.count() == 0 or kept


def test_near_copies_shuffle_the_texts_of_copies_alone(spark):
    """Without a broadcast of what goes all texts were shuffled, to leave a few out."""
    body = "array_join(transform(sequence(1, {n}), i -> sha2(concat(id, ' ', i), 256)), ' ')"
    docs = spark.range(0, 600, numPartitions=4).select(F.col("id").alias("doc_id"), F.expr(body.format(n=400)).alias("text"))
    docs = settle(docs.unionByName(docs.filter("doc_id < 6").withColumn("doc_id", F.col("doc_id") + 1000)), "docs")
    pad = docs.withColumn("note", F.expr("array_join(transform(sequence(1, 400), i -> sha2(concat(doc_id, '-', i), 256)), ' ')"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    kept = []
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        wide = shuffled(spark, lambda: kept.append(sorted(r["doc_id"] for r in simhash.drop_near_copies(settle(pad, "pad")).select("doc_id", "note", "text").collect())))
        plain = shuffled(spark, lambda: simhash.near_copy_classes(docs).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert kept[0] == list(range(600))
    assert wide - plain < 4_000_000  # texts and notes: 31 MB
