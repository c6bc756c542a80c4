"""Inputs that once cost too much or gave another result at another size."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexspark.llm import html_layout, langid, packing, ring


@pytest.mark.parametrize("n", [200, 1000])
def test_wide_cells_cost_little(n):
    """Columns that spans cover beside their cells have no width."""
    began = time.time()
    text = html_layout.visible_text("<table><tr>" + "<td colspan=1000>x" * n + "<tr>" + "<td colspan=9999 rowspan=70000>y" * n + "<tr><td>z</table>")
    assert text == "  ".join("x" * n) + "\n" + "  ".join("y" * n) + "\n" + " " * 2 * n + "z" and time.time() - began < 1


def test_spans_of_four_digits_count_as_the_most_allowed():
    page = "<table><tr><td colspan={}>a<td>b<tr><td>c<td>d</table>"
    assert html_layout.visible_text(page.format(1000)) == html_layout.visible_text(page.format(2000)) == html_layout.visible_text(page.format(999))
    rows = "<table><tr><td rowspan={}>a<td>b<tr><td>c<tr><td>d</table>"
    assert html_layout.visible_text(rows.format(3)) == html_layout.visible_text(rows.format(3000)) == "a  b\n   c\n   d"
    assert html_layout.visible_text(rows.format(2)) == "a  b\n   c\nd"
    assert html_layout.visible_text(rows.format("²")) == html_layout.visible_text(rows.format(0)) == "a  b\nc\nd"


def test_aligned_columns_of_random_tables():
    """Every cell of span one begins where its column does, on each line of it."""
    rng = random.Random(4)
    for _ in range(60):
        grid = [[f"{r}.{c}" + "w" * rng.randint(0, 9) for c in range(rng.randint(1, 6))] for r in range(rng.randint(1, 6))]
        lines = html_layout.visible_text("<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in row) for row in grid) + "</table>").split("\n")
        wide = [max(len(row[c]) for row in grid if c < len(row)) for c in range(max(map(len, grid)))]
        assert lines == ["  ".join(x.ljust(wide[c]) for c, x in enumerate(row)).rstrip() for row in grid]


def test_blocks_and_lists_of_random_pages():
    """Block spacing and list marks of nested pages, from what the page was made of."""
    rng = random.Random(6)
    for _ in range(60):
        parts, want = [], []
        for k in range(rng.randint(1, 8)):
            kind = rng.choice(["p", "div", "ul", "ol"])
            items = [f"t{k}x{j}" for j in range(rng.randint(1, 4))]
            if kind in ("p", "div"):
                parts.append(f"<{kind}>{' '.join(items)}</{kind}>")
                want.append((kind == "p", [" ".join(items)]))
            else:
                parts.append(f"<{kind}>" + "".join(f"<li>{x}" for x in items) + f"</{kind}>")
                want.append((True, [f"{'-' if kind == 'ul' else f'{j}.'} {x}" for j, x in enumerate(items, 1)]))
        lines = []
        for at, (margin, own) in enumerate(want):
            if at and (margin or want[at - 1][0]):
                lines.append("")
            lines += own
        assert html_layout.visible_text("".join(parts)) == "\n".join(lines)


def test_open_elements_are_found_by_name():
    began = time.time()
    text = html_layout.visible_text("<p><button>" + "<b>" * 8000 + "<div>x" * 8000)
    assert text.count("x") == 8000 and time.time() - began < 3


@pytest.mark.parametrize("text", ["½ ²", "Ⅻ ①", "3 4.5", "_ ٣", ""])
def test_texts_without_letters_have_no_language(spark, text):
    rows = [(k, f"das ist der {k} Satz und die Sprache", "de") for k in range(40)] + [(100 + k, f"this is the {k} line of the language", "en") for k in range(40)]
    docs = spark.createDataFrame([*rows, (999, text, "en"), (1000, f"{text} this is the line", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.document_languages(docs).filter("doc_id >= 999").collect()}
    assert got == {999: "und", 1000: "en"}


def test_letter_runs():
    assert langid.letter_runs("A½b Ⅻ①x aé漢 3b_c ǅ") == ["a", "b", "x", "aé漢", "b", "c", "ǆ"]


def test_slots_do_not_depend_on_how_they_are_ranked(spark, monkeypatch):
    """The order within a slot is that of the rows alone, however many parts it is ranked in, hot keys and repeated rows included."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1500).alias("doc_id"), (F.col("id") % 40).cast("string").alias("text"))
    docs = docs.unionByName(spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")))
    want = sorted(map(str, ring.ring_shards(docs).collect()))
    assert len(want) == 3500
    for name, value in (("RANKED", 5), ("CHUNK", 3)):
        monkeypatch.setattr(ring, name, value)
        assert sorted(map(str, ring.ring_shards(docs.repartition(3)).collect())) == want
    for shard, rows in ring.ring_shards(docs).toPandas().groupby("shard"):
        assert sorted(rows["slot"]) == list(range(len(rows))) and abs(len(rows) - 3500 / 16) < 1, shard


def test_differencing_balances():
    """Sums of the parts lie within the largest size of each other, and far closer where sizes are many and random."""
    rng = random.Random(11)
    for k, n, most in ((10, 200, 256), (32, 700, 256), (3, 40, 50), (7, 7, 100)):
        sizes = [rng.randint(1, most) for _ in range(n)]
        parts = packing.differencing(sizes, k)
        assert sorted(x for part in parts for x in part) == list(range(n)) and len(parts) == k
        sums = [sum(sizes[x] for x in part) for part in parts]
        assert max(sums) - min(sums) <= (max(sizes) if n < 10 * k else 0.05 * max(sizes))
    even = [256] * 80
    assert {sum(even[x] for x in part) for part in packing.differencing(even, 10)} == {2048}
