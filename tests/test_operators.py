"""Chunking, retrieval, similarity, collection and components against plain statements of their rules."""

import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.operators import analytics, chunking, collection, embed, retrieval, similarity
from lexspark.operators.components import connected_components
from lexspark.plans import ingest
from lexspark.sources import folders, tables

NOW = datetime(2024, 1, 31)
CONTRACT = "Preamble here.\nSection 1 Scope of it\nline one\n\nSection 2 Money\nSection 3 End\nlast line\n"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id long, text string, source string")


def test_windows_cover_all_words(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = chunking.chunk_documents(docs(spark, text, "", " ", None, "one"), 10, 3).orderBy("doc_id", "chunk_index").collect()
    own = [r for r in rows if r["doc_id"] == 0]
    assert [r["text"] for r in own] == [" ".join(text.split()[s : s + 10]) for s in range(0, 25, 7)]
    assert [r["chunk_size"] for r in own] == [10, 10, 10, 4]
    assert [r["doc_id"] for r in rows if r["doc_id"] > 0] == [4]
    with pytest.raises(ValueError):
        chunking.word_windows(F.col("x"), 5, 5)


def test_sections_found_before_blanks_collapse(spark):
    rows = chunking.chunk_documents(docs(spark, CONTRACT), 50, 5, normalize_first=False).orderBy("section_num").collect()
    assert [r["text"] for r in rows] == ["Preamble here.", "Section 1 Scope of it line one", "Section 2 Money", "Section 3 End last line"]
    assert chunking.chunk_documents(docs(spark, CONTRACT), 50, 5).count() == 1


def plain_sections(text):
    out, title, content = [], None, []
    lines = text.split("\n")

    def flush(end):
        if title and content:
            out.append((title, "\n".join(content).strip(), out[-1][3] if out else 0, end))

    for at, line in enumerate(lines):
        if any(re.match(h, line, re.I) for h in chunking.HEADERS):
            flush(at)
            title, content = line.strip(), []
        elif line.strip():
            content.append(line)
    flush(len(lines))
    return out


def test_section_table(spark):
    texts = [CONTRACT, "1. A\nx\n(b) sub\ny\nWHEREAS it\n\n", "no header\nat all", "SECTION 9\n\nCLAUSE 3\nz"]
    rows = chunking.section_table(docs(spark, *texts)).orderBy("doc_id", "section_num").collect()
    for i, t in enumerate(texts):
        assert [(r["title"], r["content"], r["start_line"], r["end_line"]) for r in rows if r["doc_id"] == i] == plain_sections(t)


def plain_packed(text, limit):
    out, now = [], ""
    for s in re.split(r"(?<=[.!?])\s+", text):
        if len((now + " " + s).split()) <= limit:
            now += " " + s if now else s
        else:
            if now:
                out.append(now.strip())
            now = s
    return out + ([now.strip()] if now else [])


def test_enhanced_chunks(spark):
    random.seed(3)
    text = " ".join("Word " * random.randint(1, 30) + "end." for _ in range(60))
    rows = chunking.enhanced_chunks(docs(spark, text), repeat_paragraphs=False, limit=50).orderBy("chunk_index").collect()
    marked = re.sub(r"([.!?])\s*([A-Z])", r"\1\n\2", re.sub(r"\s+", " ", text))
    assert [r["text"] for r in rows] == [c for c in plain_packed(marked, 50) if len(c.split()) >= 10]
    twice = chunking.enhanced_chunks(docs(spark, text), limit=10**6).collect()
    assert len(twice) == 2 and twice[0]["chunk_size"] == twice[1]["chunk_size"]


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[5] = 0
    rows = spark.createDataFrame([(str(i), v[i].tolist(), i / 300, 0.5 if i % 2 else None) for i in range(300)], "id string, embedding array<double>, legal_score double, complexity_score double")
    asked = spark.createDataFrame([(q, v[q].tolist()) for q in range(7)], "query_id long, embedding array<double>")
    got = retrieval.nearest_chunks(asked, rows.repartition(5), 4, weights=(0.7, 0.2, 0.1)).toPandas()
    n = np.linalg.norm(v, axis=1)
    for q in range(7):
        base = np.divide(v @ v[q], n * n[q], out=np.zeros(300), where=n * n[q] > 0)
        score = 0.7 * base + 0.2 * np.arange(300) / 300 + 0.1 * np.where(np.arange(300) % 2, 0.5, 0)
        best = sorted(range(300), key=lambda i: (-round(score[i], 10), str(i)))[:4]
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["id"].tolist() == list(map(str, best))
    none = retrieval.nearest_chunks(asked, rows.filter("false")).count()
    assert none == 0


def test_answers(spark):
    found = spark.createDataFrame([(1, 1, "a", 0.9, "t1 fee", "src", 0, None), (1, 2, "b", 0.5, "t2", None, 2, 3)], "query_id long, rank int, id string, score double, text string, source string, chunk_index int, section_num int")
    rows = {r["query_id"]: r for r in retrieval.answer_questions(spark.createDataFrame([(1,), (2,)], "query_id long"), found).collect()}
    assert rows[1]["answer"] == "Based on the retrieved documents: t1 fee\nt2..." and rows[1]["sources"] == ["a", "b"]
    assert rows[1]["confidence"] == pytest.approx(0.7 * 0.7 + 0.4 * 0.3) and rows[1]["top_score"] == 0.9
    assert rows[2]["answer"] == retrieval.NO_ANSWER and rows[2]["confidence"] == 0.0
    context = retrieval.contexts(found).first()["context"]
    assert context == "\n--- Document 1: src ---\nSection: General\nRelevance Score: 0.90\n\nt1 fee\n\n\n--- Document 2: Document 2 (chunk 2) ---\nSection: 3\nRelevance Score: 0.50\n\nt2\n"
    each, total = retrieval.evaluate(spark.createDataFrame([(1, ["FEE", "none"])], "query_id long, keywords array<string>"), found)
    assert each.first()["coverage"] == 0.5 and total.first()["passed"]
    told = spark.createDataFrame([(context,)], "c string").select(retrieval.fallback_answer(F.lit("q?"), F.col("c")).alias("a")).first()["a"]
    assert "**Query:** q?" in told and "1. Document 1: src" in told


def test_components_equal_union_find(spark):
    random.seed(5)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, k) for k in range(2001, 2100)] + [(7777, 7777)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_document_similarity(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4))
    rows = spark.createDataFrame([(i // 3, v[i].tolist()) for i in range(60)], "doc_id long, embedding array<double>")
    pairs = similarity.similar_documents(similarity.centroids(rows, 4), 0.5)
    m = v.reshape(20, 3, 4).mean(axis=1)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    expected = {(i, j): (m @ m.T)[i, j] for i in range(20) for j in range(i + 1, 20) if (m @ m.T)[i, j] >= 0.5}
    got = {(r[0], r[1]): r[2] for r in pairs.collect()}
    assert set(got) == set(expected) and all(got[k] == pytest.approx(expected[k]) for k in got)
    sizes = similarity.clusters(pairs, 0.8).groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("cluster_size").alias("s")).collect()
    assert all(r["n"] == r["s"] for r in sizes)
    assert [similarity.band(F.lit(x)) is not None for x in (0.95, 0.85, 0.1)] == [True] * 3


def test_collection(spark):
    table = spark.createDataFrame([("a", "t", "s", NOW, {"k": "1", "j": "2"})], "id string, text string, source string, indexed_at timestamp, metadata map<string,string>")
    new = spark.createDataFrame([("a", "other", "s"), (None, "fresh", "s"), (None, "fresh", "s")], "id string, text string, source string")
    rows = {r["id"]: r for r in collection.add(table, new, NOW).collect()}
    assert len(rows) == 2 and rows["a"]["text"] == "t"
    changed = collection.update_metadata(table, spark.createDataFrame([("a", {"k": "9"}), ("z", {"k": "0"})], "id string, metadata map<string,string>"), NOW).collect()
    assert changed[0]["metadata"] == {"k": "9", "j": "2"} and changed[0]["updated_at"] == NOW
    assert collection.after_key(table, datetime(2020, 1, 1), "").count() == 1
    with pytest.raises(ValueError):
        collection.predicate({"x": {"$like": "y"}})


def test_lagged_average(spark):
    uploads = spark.createDataFrame([("d", datetime(2024, 1, 1))], "document_id string, upload_timestamp timestamp")
    asked = spark.createDataFrame([(datetime(2024, 1, 2, h), s) for h, s in ((1, 0.2), (2, 0.4), (3, 0.9))], "timestamp timestamp, score double")
    assert analytics.document_usage(uploads, asked).first()["avg_similarity_score"] == pytest.approx(0.5)
    assert analytics.document_usage(uploads, asked, lagged=True).first()["avg_similarity_score"] == pytest.approx(0.3)


def test_embedder_plugin(spark):
    rows = spark.createDataFrame([("1", "abc"), ("2", None)], "id string, text string")
    got = embed.embed_with(rows, lambda: lambda texts: [[len(t), 1.0] for t in texts], "length").orderBy("id").collect()
    assert [list(r["embedding"]) for r in got] == [[3.0, 1.0], [0.0, 1.0]] and got[0]["embedding_dimension"] == 2


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TXT").write_bytes("naïve".encode())
    (tmp_path / "in" / "b.txt").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "in" / "c.doc").write_bytes(b"x")
    (tmp_path / "in" / "d.pdf").write_bytes(b"%PDF-1")
    good, bad = folders.read_folder(spark, str(tmp_path / "in"))
    texts = folders.decode_texts(good.filter("content_type = 'text/plain'")).orderBy("path").collect()
    assert [(r["text"], r["encoding_used"]) for r in texts] == [("naïve", "utf-8"), ("naïve", "latin-1")]
    assert bad.count() == 1 and bad.first()["reason"].startswith("Legacy")
    fine, raw = folders.check_extraction(folders.decode_texts(good).select("path", "text"))
    assert raw.count() == 1 and fine.filter("too_short").count() == 2
    pages = spark.createDataFrame([(1, 2, "two"), (1, 1, "one"), (1, 3, " "), (2, 1, None)], "doc_id long, page int, text string")
    got = {r["doc_id"]: (r["text"], r["page_count"]) for r in folders.assemble_pages(pages).collect()}
    assert got == {1: ("[Page 1]\none\n\n[Page 2]\ntwo", 3), 2: ("", 1)}


def test_tables_round_trip(spark, tmp_path):
    log = spark.createDataFrame([("q", NOW)], "query_id string, timestamp timestamp")
    tables.write_log(log, str(tmp_path / "log"))
    assert tables.read_table(spark, str(tmp_path / "log"), tables.QUERY_LOG).first()["query_id"] == "q"
    assert spark.sql("SELECT '{\"k\": 3}' AS j").select(tables.payload_value(F.col("j"), "$.k", "int").alias("k")).first()["k"] == 3
    tables.write_json(log, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_ingest_drops_copies_and_blanks(spark):
    made = ingest.ingest(docs(spark, "The  agreement of the parties.", "The agreement of the parties.", " ", None), NOW)
    assert [(r["doc_id"], r["text"]) for r in made.collect()] == [(0, "The agreement of the parties.")]


def test_deduplication_loses_no_text(spark):
    rows = [(None, "orphan text"), (1, "x"), (1, "y"), (2, "y"), (3, None), (4, "")]
    got = collection.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    import hashlib

    assert sorted((r["doc_id"], r["text"], r["n_copies"]) for r in got if r["doc_id"]) == [(1, "x", 1), (1, "y", 2), (3, None, 2)]
    assert [r["text"] for r in got if r["doc_id"] is None] == ["orphan text"]
    assert all(r["document_hash"] == hashlib.md5((r["text"] or "").encode()).hexdigest() for r in got)
    assert collection.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_updates_are_merged_in_order(spark):
    table = spark.createDataFrame([("a", {"k": "0", "x": "0"}), ("b", None), ("c", {"k": "0"})], "id string, metadata map<string,string>")
    updates = spark.createDataFrame([("a", {"k": "2"}, 2), ("a", {"k": "1", "l": "1", "m": "1"}, 1), ("b", {}, 1)], "id string, metadata map<string,string>, seq int")
    got = {r["id"]: (r["metadata"], r["updated_at"] is not None) for r in collection.update_metadata(table, updates, datetime(2024, 1, 1), "seq").collect()}
    assert got == {"a": ({"k": "2", "x": "0", "l": "1", "m": "1"}, True), "b": ({}, True), "c": ({"k": "0"}, False)}


def test_pruned_pairs_are_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(20, 16))[rng.integers(0, 20, 600)] + 0.4 * rng.normal(size=(600, 16))
    v[5] = 0
    monkeypatch.setattr(similarity, "BLOCK", 25)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for least in (0.2, 0.8):
        got = similarity.similar_documents(spark.createDataFrame(list(enumerate(v.tolist())), "doc_id long, embedding array<double>"), least).toPandas()
        plain = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= least, 1)))}
        assert len(got) == len(plain) and set(zip(got["doc1_id"], got["doc2_id"])) == plain
    pivots = u[6:10]
    assert len(similarity.near_blocks(pivots, np.zeros(4), 0.99)) == 4  # groups far apart do not meet


def test_nearest_chunks_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 2000)
    monkeypatch.setattr(retrieval, "SLICE", 3)
    q, c = rng.integers(-2, 3, size=(30, 4)).astype(float), rng.integers(-2, 3, size=(200, 4)).astype(float)
    queries = spark.createDataFrame(list(enumerate(q.tolist())), "query_id long, embedding array<double>")
    chunks = spark.createDataFrame([(f"c{i:03d}", x) for i, x in enumerate(c.tolist())], "id string, embedding array<double>").repartition(5)
    for metric in ("cosine", "l2"):
        got = retrieval.nearest_chunks(queries, chunks, 7, metric).toPandas()
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
        score = np.divide(q @ c.T, size, out=np.zeros_like(size), where=size > 0) if metric == "cosine" else 1 - ((q[:, None] - c[None]) ** 2).sum(axis=2)
        for i in range(30):
            own = got[got["query_id"] == i].sort_values("rank")
            assert own["id"].tolist() == [f"c{j:03d}" for j in np.lexsort((np.arange(200), -np.round(score[i], 12)))[:7]]


def test_search_returns_what_is_asked_for(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], "t", {"k": "v"})], "id string, embedding array<double>, text string, metadata map<string,string>")
    queries = chunks.select(F.lit(1).alias("query_id"), "embedding")
    assert retrieval.search(queries, chunks).columns == ["query_id", "rank", "id", "text", "metadata", "distance"]
    assert retrieval.search(queries, chunks, include=("distances",)).first().asDict() == {"query_id": 1, "rank": 1, "id": "a", "distance": 0.0}
    with pytest.raises(ValueError):
        retrieval.search(queries, chunks, include=("vectors",))
