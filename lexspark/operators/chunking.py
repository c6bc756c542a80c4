"""Chunks of documents: word windows, legal sections, packed sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.legal import section_type
from lexspark.functions.text import BLANK, has_words, preprocess_legal, preprocess_sentences, strip, word_count
from lexspark.functions.vectors import let
from lexspark.operators.lineage import spread

#: Patterns that begin a section, in the order in which they are tried (fixed values).
SECTION_STARTS = (
    r"\n\s*(?:Section|Article|Chapter|Part)\s+\d+",
    r"\n\s*\d+\.\s+",
    r"\n\s*[A-Z]\.\s+",
    r"\n\s*\([a-z]\)\s+",
    r"\n\s*\(\d+\)\s+",
    r"\nWHEREAS,",
    r"\nNOW THEREFORE,",
    r"\nIN WITNESS WHEREOF,",
)
#: Lines that are section headers (fixed values), upper and lower case alike.
HEADERS = (
    r"\s*(?:SECTION|SEC\.)\s+\d+",
    r"\s*(?:ARTICLE|ART\.)\s+\d+",
    r"\s*CLAUSE\s+\d+",
    r"\s*\d+\.\s+[A-Z]",
    r"\s*\([a-z]\)\s+",
    r"\s*WHEREAS\b",
    r"\s*NOW THEREFORE\b",
    r"\s*IN WITNESS WHEREOF\b",
)
CUT = "\x01"


def chunk_id(text: Column, source: Column, index: Column) -> Column:
    """md5 of the first 100 characters, the source and the index."""
    return F.md5(F.concat(F.substring(text, 1, 100), F.coalesce(source, F.lit("")), index.cast("string")))


def document_id(text: Column, source: Column) -> Column:
    """md5 of the text and its quoted source."""
    return F.md5(F.concat(text, F.lit('"'), F.coalesce(source, F.lit("")), F.lit('"')))


def word_windows(w: Column, size: int, overlap: int) -> Column:
    """Array of (chunk_index, text, chunk_size) of overlapping windows of the words w; empty without words.

    w should be a column that is there already: an expression would be worked out again in each window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")
    step = size - overlap
    window = lambda s: F.slice(w, s + 1, size)
    starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda s: F.struct(
            (s / step).cast("int").alias("chunk_index"), F.array_join(window(s), " ").alias("text"), F.least(F.size(w) - s, F.lit(size)).alias("chunk_size")
        ),
    )


def split_sections(text: Column) -> Column:
    """The sections by the first pattern that occurs at least twice, each with its header; else the text."""
    out = F.array(text)
    for pattern in reversed(SECTION_STARTS):
        cut = F.split(F.regexp_replace(text, f"({pattern})", f"{CUT}$1"), CUT)
        parts = F.transform(cut, strip)
        kept = F.when(parts[0] == "", F.slice(parts, 2, F.size(parts))).otherwise(parts)
        out = F.when(F.regexp_count(text, F.lit(pattern)) >= 2, kept).otherwise(out)
    return out


def chunk_documents(docs: DataFrame, size: int = 1000, overlap: int = 200, normalize_first: bool = True) -> DataFrame:
    """One row per chunk: docs' columns without text, section_num, chunk_index, id, text, chunk_size, char_count.

    docs: doc_id, text, source and whatever else is to be kept. normalize_first collapses blanks before
    sections are looked for, so that none is found and section_num is null; without it sections are found
    first and each is normalised and chunked by itself. Documents without words give no chunk. Nothing is
    shuffled, but for inputs of fewer files than cores (spread).
    """
    docs = spread(docs)
    kept = [c for c in docs.columns if c != "text"]
    if normalize_first:
        parts = docs.select(*kept, F.lit(None).cast("int").alias("section_num"), preprocess_legal(F.col("text")).alias("section"))
    else:
        found = docs.select(*kept, split_sections(F.col("text")).alias("sections"))
        many = F.size("sections") > 1
        parts = found.select(*kept, many.alias("many"), F.posexplode("sections").alias("at", "section"))
        parts = parts.select(*kept, F.when(F.col("many"), F.col("at")).alias("section_num"), preprocess_legal(F.col("section")).alias("section"))
    split = parts.select(*kept, "section_num", F.filter(F.split("section", " "), lambda w: w != "").alias("_words"))
    chunks = split.select(*kept, "section_num", F.explode(word_windows(F.col("_words"), size, overlap)).alias("c"))
    return chunks.select(
        *kept, "section_num", "c.chunk_index", chunk_id(F.col("c.text"), F.col("source"), F.col("c.chunk_index")).alias("id"),
        "c.text", "c.chunk_size", F.length("c.text").alias("char_count"),
    )


def is_header(line: Column) -> Column:
    """Whether a line begins a section."""
    return line.rlike("(?i)^(?:" + "|".join(h.replace(r"\s", BLANK) for h in HEADERS) + ")")


def section_table(docs: DataFrame) -> DataFrame:
    """(doc_id, section_num, title, content, start_line, end_line) of sections with content.

    A fold over each document's lines, so nothing is shuffled and a document is never a group of rows.
    """
    section = "struct<title:string,content:array<string>,header:int,end_line:int>"
    state = F.struct(
        F.array().cast(f"array<{section}>").alias("done"), F.lit(None).cast("string").alias("title"),
        F.array().cast("array<string>").alias("content"), F.lit(0).alias("line"),
    )

    def flush(s: Column, end: Column) -> Column:
        whole = F.struct(s["title"].alias("title"), s["content"].alias("content"), F.lit(0).alias("header"), end.alias("end_line"))
        return F.when(s["title"].isNotNull() & (s["title"] != "") & (F.size(s["content"]) > 0), F.concat(s["done"], F.array(whole))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        header = is_header(line)
        blank = strip(line) == ""
        return F.struct(
            F.when(header, flush(s, s["line"])).otherwise(s["done"]).alias("done"),
            F.when(header, strip(line)).otherwise(s["title"]).alias("title"),
            F.when(header, F.array().cast("array<string>")).when(blank, s["content"]).otherwise(F.concat(s["content"], F.array(line))).alias("content"),
            (s["line"] + 1).alias("line"),
        )

    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    found = F.aggregate(lines, state, step, lambda s: flush(s, s["line"]))
    rows = docs.select("doc_id", found.alias("found"))
    end = lambda at: F.when(at > 0, F.col("found")[at - 1]["end_line"]).otherwise(0)
    cut = F.transform("found", lambda s, at: F.struct(at.alias("section_num"), s["title"].alias("title"), strip(F.array_join(s["content"], "\n")).alias("content"), end(at).alias("start_line"), s["end_line"].alias("end_line")))
    return rows.select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.*")


def pack_sentences(sentences: Column, limit: int = 200) -> Column:
    """Sentences, as an array of (text, n words), joined as long as they have limit words together; a longer
    sentence is alone."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))
    told = lambda now: strip(F.array_join(now, " "))

    def step(s: Column, x: Column) -> Column:
        fits, empty = s["n"] + x["n"] <= limit, F.size(s["now"]) == 0
        return F.struct(
            F.when(fits | empty, s["done"]).otherwise(F.concat(s["done"], F.array(told(s["now"])))).alias("done"),
            F.when(fits, F.concat(s["now"], F.array(x["text"]))).otherwise(F.array(x["text"])).alias("now"),
            F.when(fits, s["n"] + x["n"]).otherwise(x["n"]).alias("n"),
        )

    every = F.aggregate(sentences, state, step, lambda s: F.when(F.size(s["now"]) == 0, s["done"]).otherwise(F.concat(s["done"], F.array(told(s["now"])))))
    return F.filter(every, lambda x: x != "")


def enhanced_chunks(docs: DataFrame, repeat_paragraphs: bool = True, limit: int = 200, least: int = 10) -> DataFrame:
    """(doc_id, chunk_index, text, section_type, is_subsection, chunk_size): marked sections, long ones by
    subsection, and packed sentences where there is one section at most.

    repeat_paragraphs adds the sentences to that section, so its text occurs twice; without it they
    replace it. Chunks under least words go.
    """
    chunk = lambda text, kind, sub: F.struct(text.alias("text"), kind.alias("section_type"), sub.alias("is_subsection"))
    counted = lambda x: F.struct(x.alias("text"), word_count(x).alias("n"))
    marked = docs.select("doc_id", preprocess_sentences(F.coalesce("text", F.lit(""))).alias("marked"))
    sections = F.transform(F.filter(F.split("marked", rf"\n{BLANK}*SECTION{BLANK}*"), has_words), counted)
    subsections = lambda s: F.filter(F.split(s, rf"\n{BLANK}*SUBSECTION{BLANK}*"), has_words)

    def parts(s: Column) -> Column:
        kind = let(section_type(s["text"]), lambda k: F.transform(subsections(s["text"]), lambda x: chunk(strip(x), k, s["text"].contains("SUBSECTION"))))
        return F.when(s["n"] > limit, kind).otherwise(F.array(chunk(strip(s["text"]), section_type(s["text"]), F.lit(False))))

    rows = marked.select("doc_id", "marked", F.flatten(F.transform(sections, parts)).alias("cut"))
    # Sentences are looked for only where they are needed, after blanks only.
    sentences = F.transform(F.split("marked", rf"(?={BLANK})(?<=[.!?]){BLANK}+"), counted)
    paragraphs = F.transform(pack_sentences(sentences, limit), lambda x: chunk(x, F.lit("paragraph"), F.lit(False)))
    both = F.concat("cut", paragraphs) if repeat_paragraphs else paragraphs
    rows = rows.select("doc_id", F.when(F.size("cut") <= 1, both).otherwise(F.col("cut")).alias("chunks"))
    sized = F.transform("chunks", lambda c: F.struct(c.alias("c"), word_count(c["text"]).alias("n")))
    rows = rows.select("doc_id", F.posexplode(F.filter(sized, lambda x: x["n"] >= least)).alias("chunk_index", "x"))
    return rows.select("doc_id", "chunk_index", "x.c.text", "x.c.section_type", "x.c.is_subsection", F.col("x.n").alias("chunk_size"))
