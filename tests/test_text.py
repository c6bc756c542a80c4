"""Text functions against plain statements of their rules."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lexspark.functions import legal, text, vectors
from lexspark.functions import text as T

TEXTS = [
    "", " ", "short", "An ordinary sentence with plain words. Another one follows, and more of them!", "– 12€ § 4 ﬁne café naïve \x07 bell",
    "ЖЖЖ ЩЩЩ йцу кен гшщ зхъ эждл", "tab\there\nand  there 347 US 483 and 12 F.3d 99 WHEREAS, x NOW  THEREFORE, y", "a" * 500, "x y " * 400,
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")


def values(rows, column):
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_clean_text(rows):
    assert values(rows, text.clean_text(F.col("t"))) == [text.clean(t) for t in [*TEXTS, None]]
    assert text.clean("–…§ ﬁ") == "-...section fi"


def test_cleaning_drops_other_ascii_signs():
    assert text.clean("ЖЖЖ_ЖЖЖ щщщ") == "ЖЖЖЖЖЖ щщщ"
    assert text.clean("plain_ascii stays_") == "plain_ascii stays_"
    assert text.clean("ЖЖЖ\u2028ЖЖЖ (щ) № 5") == "ЖЖЖ ЖЖЖ (щ) No 5"


def test_nested_metadata(spark):
    row = spark.sql("SELECT named_struct('a', array('x', null, 'y'), 'b', named_struct('c', 0, 'd', true), 'e', map('k', 'v'), 'f', cast(null as string), 'g', 1.5D) AS s")
    got = row.select(text.flatten_struct(F.col("s"), row.schema["s"].dataType, "p").alias("m")).first()["m"]
    assert got == {"p_a": "x, y", "p_b_c": "", "p_b_d": "true", "p_e_k": "v", "p_f": "", "p_g": "1.5"}


def garbled(t):
    if not t or len(t.strip()) < 10:
        return True
    n = len(t)
    shares = [sum(map(f, t)) / n for f in (lambda c: ord(c) < 128, str.isalpha, str.isspace)]
    return shares[0] < 0.3 or shares[1] < 0.2 or shares[2] > 0.8 or shares[2] < 0.05 or len(set(t)) < max(5, n * 0.1)


def test_garbled(rows):
    assert values(rows, text.is_garbled(F.col("t"))) == [garbled(t) for t in [*TEXTS, None]]
    assert values(rows, text.with_banner(F.col("t")))[2].endswith("\n\nshort")


def test_preprocess(rows):
    assert values(rows, text.preprocess_legal(F.col("t")))[6] == "tab here and there 347 U.S. 483 and 12 F.3d 99 WHEREAS x NOW THEREFORE y"
    assert values(rows, text.preprocess_sentences(F.col("t")))[3].count("\n") == 1
    assert values(rows, text.word_count(F.col("t"))) == [len((t or "").split()) for t in [*TEXTS, None]]


def test_preview_and_metadata(spark):
    row = spark.sql("SELECT 'abcdef' AS t, map('a', 'x', 'b', null) AS m").select(
        text.preview(F.col("t"), 3), text.preview(F.col("t"), 9), text.preview(F.col("t"), 9, always=True), text.flatten_metadata(F.col("m"), "pdf"), text.joined(F.lit(None).cast("array<string>"))
    )
    assert tuple(row.first()) == ("abc...", "abcdef", "abcdef...", {"pdf_a": "x", "pdf_b": ""}, "")


DOC = (
    "Smith v. Jones, 347 US 483 (1954) is a holding. 42 USC § 1983, 29 CFR 1630.2, section 12 of the civil code and U.S. Const. amend. XIV. "
    "Pay $1,200.00 or $5 by 1/2/2024, January 5, 2024. Termination of the agreement: salary, liquidated damages. Confidential!"
)


def test_entities(spark):
    df = spark.createDataFrame([(1, DOC)], "doc_id long, text string")
    e = df.select(legal.entities(F.col("text")).alias("e")).first()["e"]
    plain = [m for p in legal.CITATIONS for m in re.findall(p, DOC, re.I)]
    assert e["citations"] == plain and len(plain) == 5
    assert e["monetary_amounts"] == re.findall(legal.MONEY, DOC) and e["dates"] == re.findall(legal.DATES, DOC)
    assert e["legal_terms"] == [t for t in legal.VOCABULARY if t in DOC.lower()]
    found = legal.precedents(df).orderBy("rank").collect()
    spots = [(m.group(), m.start(), m.end()) for p in legal.CITATIONS for m in re.finditer(p, DOC, re.I)]
    assert sorted((r["citation"], r["start"], r["stop"]) for r in found) == sorted(spots)
    assert found[0]["type"] == "case_law" and found[0]["relevance_score"] == pytest.approx(0.8)


def test_scores(spark):
    def complexity(t):
        sizes = [len(s.split()) for s in re.split("[.!?]+", t) if s.strip()]
        score = min(sum(k in t.lower() for k in legal.VOCABULARY) / len(t.split()) * 10, 1)
        n = sum(len(re.findall(p, t, re.I)) for p in legal.CITATIONS)
        return min(sum(sizes) / len(sizes) / 20, 1) * 0.4 + score * 0.4 + min(n / 10, 1) * 0.2

    row = spark.createDataFrame([(DOC,)], "t string").select(legal.complexity_score(F.col("t")), legal.document_class(F.col("t"), F.lit(5)), legal.section_type(F.col("t"))).first()
    assert row[0] == pytest.approx(complexity(DOC))
    assert row[1:] == ("legal_brief", "compensation")
    empty = spark.sql("SELECT '' AS t").select(legal.legal_score(F.col("t")), F.isnan(legal.complexity_score(F.col("t"))), legal.document_type(F.col("t"))).first()
    assert tuple(empty) == (0.0, True, "general")


def test_suggestions(spark):
    row = spark.sql("SELECT 'nda' AS k, array('a', 'b', 'c', 'd') AS t").select(legal.query_suggestions(F.col("k"), F.col("t")).alias("s")).first()
    assert len(row["s"]) == 6 and row["s"][-1] == "Tell me more about c"


def test_hash_embeddings(spark):
    import hashlib

    raw = list(hashlib.md5(b"abc").digest())
    row = spark.sql("SELECT 'abc' AS t").select(vectors.repeated_hash_embedding(F.col("t")), vectors.unit_hash_embedding(F.col("t")), vectors.cosine(vectors.unit_hash_embedding(F.col("t")), vectors.unit_hash_embedding(F.col("t")))).first()
    size = sum(b * b for b in raw) ** 0.5
    assert row[0] == pytest.approx([b / 255 for b in raw] * 24, rel=1e-6)
    assert row[1] == pytest.approx([b / size for b in raw] + [0] * 368, rel=1e-6)
    assert row[2] == pytest.approx(1)


def test_blanks_are_those_of_python(spark):
    """Classes that Java tries quickly hold the same characters as before."""
    every = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    rows = spark.createDataFrame([(k, "".join(every[k : k + 4096])) for k in range(0, len(every), 4096)], "k int, text string")
    old = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    found = rows.select("text", *[F.regexp_replace("text", p, "").alias(n) for n, p in (("old", old), ("blank", T.BLANK))], F.regexp_replace("text", T.NO_BLANK, "").alias("rest"))
    row = found.agg(F.bool_and(F.col("old") == F.col("blank")).alias("same"), F.array_join(F.collect_list("rest"), "").alias("rest")).first()
    assert row["same"] and set(row["rest"]) == {c for c in every if c.isspace()} == set(T.BLANKS)


def test_word_count_costs_about_a_split(spark):
    """F1, F2, F5 to F8, F11, F12, F15: each character went through some sixteen nested checks."""
    rows = spark.range(0, 2000, 1, 4).select(F.array_join(F.array_repeat(F.lit("Wörter stehen hier, and words. "), 100), "").alias("text")).localCheckpoint()

    def seconds(column):
        took = []
        for _ in range(4):
            start = time.perf_counter()
            rows.agg(F.sum(column)).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(T.word_count(F.col("text"))) < 8 * seconds(F.size(F.split("text", "[.!?]+")))


def test_garbled_bound_changes_nothing(spark):
    """long texts are judged without taking them apart."""
    wide = "".join(chr(0x4E00 + k) for k in range(900))
    texts = ["word and " * 300, wide + " so it is " * 30, wide * 3, "plain words of a short text", "ab " * 427, "ab " * 426, "é" * 2000 + " a" * 200]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    garbled = [
        len(t.strip()) < 10 or sum(map(str.isascii, t)) / len(t) < 0.3 or sum(map(str.isalpha, t)) / len(t) < 0.2
        or not 0.05 <= sum(map(str.isspace, t)) / len(t) <= 0.8 or len(set(t)) < max(5.0, len(t) * 0.1) for t in texts
    ]
    assert [r[0] for r in rows.select(T.is_garbled(F.col("text"))).collect()] == garbled


def test_cleaning_brings_few_rows_to_a_worker(spark):
    """F16: rows came to Python ten thousand at a time."""
    rows = spark.createDataFrame([("é\x07  ﬁ – ",)], "text string").select(T.clean_text(F.col("text")).alias("t"))
    assert rows.first()["t"] == T.clean("é\x07  ﬁ – ") == "e\u0301 fi -"
    assert "ArrowEvalPython" not in rows._jdf.queryExecution().executedPlan().toString()
