"""Token counts and alignments against the libraries and brute force."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexspark.llm import alignment, queries, token_counts
from lexspark.llm.bpe import byte_symbols
from tests.conftest import SF

WORDS, BYTES, PIECES = (queries.vocabulary(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "Wort für Wort, " * 10_000
EDGE = [
    (1, "plain text of a few words"), (1, "plain text of a few words"), (2, None), (3, ""), (None, "no id"), (4, LONG), (5, "ÀÉ ñandú 漢字 \U0001f600 end\n\tx"),
    (2**60 + 1, " two  <|endoftext|> <s> <0x41>"), (-7, " \t\n "), (8, "A" * 3000), (9, "a▁b"), (10, "İstanbul ǅ ﬁ ½ ́e \x00\x1d"),
]
TEXT = st.text(alphabet=st.one_of(st.sampled_from("aabbthein ERS 's12.,!\n\t\x1c"), st.characters(exclude_categories=["Cs"])), max_size=80)


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, 1, "x", 2.0, "y") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, pair string, block double, groups string").repartition(3)


@pytest.fixture(scope="module")
def libraries():
    out = {p: Tokenizer.from_file(p) for p in (WORDS, BYTES)}
    plain = Tokenizer.from_file(BYTES)
    plain.encode_special_tokens = True
    return out | {"plain": plain, PIECES: sentencepiece.SentencePieceProcessor(model_file=PIECES)}


def _read(path):
    with open(path, encoding="utf-8") as f:
        return f.read()


COUNTERS = [(token_counts.TokenCounter(_read(p)), Tokenizer.from_file(p)) for p in (WORDS, BYTES)]


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_equal_the_library(text):
    for counter, whole in COUNTERS:
        assert counter.count([text, text + "<|endoftext|>" + text]) == [len(whole.encode(t, add_special_tokens=False).ids) for t in (text, text + "<|endoftext|>" + text)]


def test_merges_of_runs_and_of_orders_that_interfere():
    """Runs of one symbol pair from the left; where a merge makes what an earlier one uses, one place at a time goes."""
    marks = byte_symbols()
    vocab = {marks[b]: b for b in range(256)} | {"ab": 256, "aba": 257, "aa": 258}
    source = '{"model": {"vocab": %s, "merges": %s}}'
    merges = token_counts.RankMerges(source % (json.dumps(vocab), json.dumps([["ab", "a"], ["a", "b"], ["a", "a"]])))
    assert not merges.whole[1] and merges.whole[0]
    assert merges.counts([b"abab", b"", b"aaaaa", b"aaaa", b"xabaab"]).tolist() == [2, 0, 3, 2, 3]  # aba|b, -, aa|aa|a, aa|aa, x|aba|ab


def test_count_tokens_of_edge_cases(edge, libraries):
    out = token_counts.document_tokens(edge, WORDS).collect()
    want = Counter()
    for i, t in EDGE:
        n = len(libraries[WORDS].encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    assert Counter(map(tuple, out)) == want
    assert token_counts.document_tokens(edge.filter("false"), WORDS).collect() == []
    kept = token_counts.count_tokens(edge, BYTES)
    assert sorted(kept.columns) == sorted(edge.columns) and kept.count() == len(EDGE)


def test_op11_equals_the_library(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    n = [len(e.ids) for e in libraries[WORDS].encode_batch([t or "" for t in docs["text"]], add_special_tokens=False)]
    want = {(d, len((t or "").encode()), k, k > 2048) for d, t, k in zip(docs["doc_id"], docs["text"], n, strict=True)}
    got = queries.op11_tokens(spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


def aligned(texts, libraries):
    """Brute force: (counts, groups) of each text, by the definition."""
    marks = {c: b for b, c in byte_symbols().items()}
    plain, pieces = libraries["plain"], libraries[PIECES]
    out, count = [], Counter()
    for text in texts:
        a, b = ([], []) if not text else (plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text))
        told = [[bytes(marks[c] for c in plain.id_to_token(i)) if plain.id_to_token(i) != "<|endoftext|>" else b"<|endoftext|>" for i in a]]
        shown = [pieces.id_to_piece(i) for i in b]
        told.append([bytes([int(p[3:5], 16)]) if len(p) == 6 and p[:3] == "<0x" else p.replace("▁", " ").encode() for p in shown])
        if not text or any(b"".join(x) != (" " + text).encode() for x in told):
            out.append(([], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in told]
        both = sorted(set(ends[0]) & set(ends[1]))
        at_a, at_b = dict(zip(ends[0], a, strict=True)), dict(zip(ends[1], b, strict=True))
        links = [(at_a[e], at_b[e]) for e in both]  # no token is without bytes
        lists = [defaultdict(list), defaultdict(list)]
        for side, ids in enumerate((a, b)):
            for i, g in zip(ids, np.searchsorted(both, ends[side]).tolist(), strict=True):
                lists[side][g].append(str(i))
        groups = [",".join(lists[0][g]) + "|" + ",".join(lists[1][g]) for g in range(len(both))]
        count.update(links)
        out.append((a, b, links, ";".join(groups)))
    best = defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [
        (len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), g)
        for a, b, links, g in out
    ]


def test_alignment_of_edge_cases(edge, libraries):
    want = Counter()
    for (i, _), (*counts, groups) in zip(EDGE, aligned([t for _, t in EDGE], libraries), strict=True):
        want[(i, *counts, hashlib.sha256(groups.encode()).hexdigest() if groups else "", groups)] += 1
    assert Counter(map(tuple, alignment.align_documents(edge, BYTES, PIECES, with_groups=True).collect())) == want
    assert alignment.align_documents(edge.filter("false"), BYTES, PIECES).collect() == []


@pytest.mark.parametrize("docs,links", [(7, 1 << 20), (8192, 5000)])
def test_op12_equals_brute_force_over_small_blocks(spark, libraries, monkeypatch, docs, links):
    monkeypatch.setattr(alignment, "DOCS", docs)
    monkeypatch.setattr(alignment, "LINKS", links)
    rows = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    want = {
        (i, *counts, hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, (*counts, groups) in zip(rows["doc_id"], aligned(rows["text"].tolist(), libraries), strict=True)
    }
    got = queries.op12_alignment(spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {tuple(r) for r in got.collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_encoders_equal_the_libraries(texts):
    for side, whole in SIDES:
        assert [x.tolist() for x in side.encode(texts)] == [whole(t) for t in texts]


def _sides():
    with open(BYTES, "rb") as f:
        a = alignment.ByteTokens(f.read())
    with open(PIECES, "rb") as f:
        b = alignment.PieceTokens(f.read())
    return [(a, lambda t: a.whole.encode(" " + t, add_special_tokens=False).ids), (b, lambda t: b.whole.encode(t))]


SIDES = _sides()


def test_planes_hold_every_link():
    """Lists and bitmaps, several planes a pair: scores and counts equal sums over the links."""
    rng = np.random.default_rng(3)
    pairs = np.concatenate([np.full(3000, 5), rng.integers(0, 40, 4000), np.full(300, 77)])
    docs = np.concatenate([rng.integers(0, 900, 7000), np.full(300, 11)])
    found = alignment.bitmaps(pairs, docs)
    links, many = Counter(), defaultdict(set)
    for p, d in zip(pairs.tolist(), docs.tolist(), strict=True):
        links[p] += 1
        many[p].add(d)
    got_links, got_docs = Counter(), Counter()
    for p, n, d in zip(found["pair"].tolist(), found["links"].tolist(), found["docs"].tolist(), strict=True):
        got_links[p] += n
        got_docs[p] += d
    assert got_links == links and {p: len(d) for p, d in many.items()} == {p: n for p, n in got_docs.items()}
    assert max(map(len, found["bits"])) == 113  # a bitmap of 900 documents; longer lists would have up to 900 * 2 bytes
    rows = pd.DataFrame({k: found[k] for k in ("pair", "plane", "links", "bits")}).assign(block=3)
    rows["count"], rows["best"] = rows["pair"].map(links), rows["pair"] % 2 == 1
    out = alignment.scored_documents(rows).set_index("pos")
    want, top = Counter(), Counter()
    for p, d in zip(pairs.tolist(), docs.tolist(), strict=True):
        want[d] += links[p]
        top[d] += p % 2
    assert out["count_sum"].to_dict() == dict(want) and {d: n for d, n in out["n_best"].items() if n} == {d: n for d, n in top.items() if n}
