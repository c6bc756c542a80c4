"""Legal annotation as column functions: citations, terms, types and scores."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.functions.text import BLANK, END, START, WORD, word_count
from lexspark.functions.vectors import let

# Patterns, terms, types and keywords that results depend on, in order.
CITATIONS = (
    r"\b\w+\s+v\.?\s+\w+,?\s+\d+\s+\w+\.?\s*\d*\s+\d+\s*\(\d{4}\)",
    r"\b\d+\s+[A-Z]+\.?[A-Z]*\.?[A-Z]*\.?\s*§\s*\d+",
    r"\bsection\s+\d+\s+of\s+the\s+\w+\s+code\b",
    r"\b\d+\s+CFR\s+\d+\.\d+\b",
    r"\bU\.?S\.?\s+Const\.?\s+amend\.?\s+[IVXLC]+\b",
)
MONEY = r"\$[\d,]+(?:\.\d{2})?"
DATES = r"\b\d{1,2}/\d{1,2}/\d{4}\b|\b\w+\s+\d{1,2},\s+\d{4}\b"
VOCABULARY = (
    "contract", "agreement", "party", "parties", "whereas", "therefore", "covenant", "covenant not to",
    "employee", "employer", "employment", "termination", "compensation", "salary", "benefits", "confidentiality",
    "non-disclosure", "non-compete", "severance",
    "jurisdiction", "governing law", "dispute resolution", "arbitration", "litigation", "mediation",
    "rights", "obligations", "duties", "responsibilities", "liability", "indemnity", "warranty", "representation",
    "effective date", "term", "renewal", "expiration", "notice period", "advance notice",
    "payment", "invoice", "penalty", "damages", "liquidated damages", "interest", "late fee",
)
TERM_PATTERNS = (
    "whereas|therefore|heretofore|hereinafter|notwithstanding",
    "party|parties|agreement|contract|consideration",
    "liability|indemnify|damages|breach|default",
    "termination|expiration|renewal|amendment",
    "confidential|proprietary|intellectual property",
    "jurisdiction|governing law|dispute resolution",
)
DOCUMENT_TYPES = {
    "contract": ("agreement", "contract", "whereas", "party", "consideration"),
    "employment": ("employment", "employee", "employer", "compensation", "benefits"),
    "lease": ("lease", "tenant", "landlord", "rent", "premises"),
    "nda": ("non-disclosure", "confidential", "proprietary", "trade secret"),
    "terms_of_service": ("terms of service", "terms and conditions", "user agreement"),
    "privacy_policy": ("privacy policy", "personal information", "data collection"),
    "license": ("license", "licensed", "licensor", "licensee"),
    "will": ("last will", "testament", "executor", "beneficiary"),
    "power_of_attorney": ("power of attorney", "attorney-in-fact", "principal"),
}
SECTION_TYPES = {
    "compensation": ("compensation", "salary", "payment", "wage"),
    "termination": ("termination", "terminate", "end", "expir"),
    "confidentiality": ("confidential", "non-disclosure", "proprietary"),
    "recitals": ("whereas", "recital", "background"),
    "definitions": ("definition", "define", "means"),
    "governing_law": ("govern", "jurisdiction", "applicable law"),
}
CITATION_TYPES = {"v.": "case_law", "cfr": "federal_regulation", "u.s.c": "federal_statute", "const": "constitutional", "section": "code_section"}
RELEVANCE_TERMS = ("holding", "rule", "precedent", "established", "court held")
#: (keywords, whether all must occur, class) in the order in which they are tried; then briefs by citations.
DOCUMENT_CLASSES = (
    (("employment", "agreement"), True, "employment_agreement"),
    (("non-disclosure", "confidentiality"), False, "nda"),
    (("lease", "rental"), False, "lease_agreement"),
    (("purchase", "sale"), True, "purchase_agreement"),
    (("service", "agreement"), True, "service_agreement"),
)
SUGGESTIONS = {
    "employment_agreement": (
        "What are the compensation details?",
        "What are the termination conditions?",
        "What confidentiality requirements exist?",
        "What benefits are provided?",
    ),
    "nda": (
        "What information is considered confidential?",
        "What are the penalties for disclosure?",
        "How long does the confidentiality obligation last?",
    ),
}


def java(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern with Unicode classes for Java's matcher. A word boundary at the start of an alternative
    stands before a word character, any other after one."""
    out = re.sub(r"(^|\|)\\b", lambda m: m[1] + START, pattern)
    out = out.replace(r"\w", WORD).replace(r"\b", END).replace(r"\s", BLANK).replace(r"[\d,]", r"[\p{Nd},]").replace(r"\d", r"\p{Nd}")
    return f"(?iu){out}" if ignore_case else out


def _all(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def citations(text: Column) -> Column:
    """All citations, pattern by pattern. The costly patterns are tried only where their signs occur."""
    gate = (r"(?iu)\sv\.?\s", "§", r"(?iu)section", r"(?iu)cfr", r"(?iu)const")
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(text.rlike(g), _all(text, java(p, True))).otherwise(none) for p, g in zip(CITATIONS, gate, strict=True)])


def monetary_amounts(text: Column) -> Column:
    return _all(text, java(MONEY))


def dates(text: Column) -> Column:
    """All dates; the costly pattern is tried only where a part of one occurs."""
    return F.when(text.rlike(java(r"\d/\d{1,2}/\d{4}|\d,\s+\d{4}")), _all(text, java(DATES))).otherwise(F.array().cast("array<string>"))


def _lowered(text: Column, use: Callable[[Column], Column]) -> Column:
    """use of the text in lower case (null: empty), which is worked out once."""
    return let(F.lower(F.coalesce(text, F.lit(""))), use)


def _listed(text: Column, terms: tuple[str, ...]) -> Column:
    return _lowered(text, lambda low: F.array_compact(F.array(*[F.when(low.contains(t), t) for t in terms])))


def vocabulary_terms(text: Column) -> Column:
    """The vocabulary's terms that occur in the text, in its order."""
    return _listed(text, VOCABULARY)


def legal_terms(text: Column) -> Column:
    """Distinct whole-word matches of the term patterns, sorted."""
    return F.array_sort(F.array_distinct(_all(F.lower(text), f"{START}(?:{'|'.join(TERM_PATTERNS)}){END}")))


def _hits(low: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms a text in lower case holds."""
    total = F.lit(0)
    for t in terms:
        total = total + low.contains(t).cast("int")
    return total


def document_type(text: Column) -> Column:
    """The type with most keywords present, the first listed among equals; general without any."""

    def best(low: Column) -> Column:
        return F.array_max(F.array(*[F.struct(_hits(low, k).alias("n"), F.lit(-at).alias("o"), F.lit(name).alias("name")) for at, (name, k) in enumerate(DOCUMENT_TYPES.items())]))

    return let(_lowered(text, best), lambda b: F.when(b["n"] > 0, b["name"]).otherwise("general"))


def document_class(text: Column, n_citations: Column) -> Column:
    """The first class whose keywords occur; else a brief if there are over three citations."""

    def first(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for terms, every, name in reversed(DOCUMENT_CLASSES):
            out = F.when(_hits(low, terms) >= (len(terms) if every else 1), name).otherwise(out)
        return out

    return F.coalesce(_lowered(text, first), F.when(n_citations > 3, "legal_brief").otherwise("general_legal"))


def section_type(text: Column) -> Column:
    def first(low: Column) -> Column:
        out = F.lit("general")
        for name, terms in reversed(SECTION_TYPES.items()):
            out = F.when(_hits(low, terms) > 0, name).otherwise(out)
        return out

    return _lowered(text, first)


def citation_type(citation: Column) -> Column:
    low, out = F.lower(citation), F.lit("unknown")
    for sign, name in reversed(CITATION_TYPES.items()):
        out = F.when(low.contains(sign), name).otherwise(out)
    return out


def relevance_terms(text: Column) -> Column:
    """How many indicator terms the text holds."""
    return _lowered(text, lambda low: _hits(low, RELEVANCE_TERMS))


def citation_relevance(citation: Column, indicators: Column) -> Column:
    """0.5, 0.2 more for cases, 0.1 more for each indicator term of the whole text, at most 1."""
    score = F.lit(0.5) + F.when(F.lower(citation).contains("v."), 0.2).otherwise(0.0) + indicators * F.lit(0.1)
    return F.least(score, F.lit(1.0))


def legal_score(text: Column) -> Column:
    density = F.size(vocabulary_terms(text)) / F.nullif(word_count(text), F.lit(0)) * 10
    return F.least(F.coalesce(density, F.lit(0.0)), F.lit(1.0))


def complexity_score(text: Column, legal: Column | None = None) -> Column:
    """Of sentence length, legal terms and citations; NaN without a sentence. legal: the text's legal_score, where it
    is there already."""
    sizes = F.transform(F.split(text, "[.!?]+"), word_count)
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))
    add = lambda a, n: F.struct((a["n"] + (n > 0).cast("int")).alias("n"), (a["words"] + n).alias("words"))
    none = F.lit(float("nan"))
    length = F.aggregate(sizes, state, add, lambda a: F.when(a["n"] == 0, none).otherwise(F.least(a["words"] / a["n"] / 20, F.lit(1.0))))
    return length * 0.4 + (legal_score(text) if legal is None else legal) * 0.4 + F.least(F.size(citations(text)) / 10, F.lit(1.0)) * 0.2


def entities(text: Column) -> Column:
    """Citations, terms, dates and amounts; parties and organisations need an entity model and are empty."""
    none = F.array().cast("array<string>")
    return F.struct(
        citations(text).alias("citations"), vocabulary_terms(text).alias("legal_terms"), dates(text).alias("dates"),
        monetary_amounts(text).alias("monetary_amounts"), none.alias("parties"), none.alias("organizations"),
    )


def query_suggestions(kind: Column, terms: Column) -> Column:
    """Questions for a class of document and its first three terms, eight at most."""
    none = F.array().cast("array<string>")
    fixed = none
    for name, asked in SUGGESTIONS.items():
        fixed = F.when(kind == name, F.array(*[F.lit(q) for q in asked])).otherwise(fixed)
    return F.slice(F.concat(fixed, F.transform(F.slice(terms, 1, 3), lambda t: F.concat(F.lit("Tell me more about "), t))), 1, 8)


_COMPILED = tuple(re.compile(p, re.I) for p in CITATIONS)


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc, text, indicators in zip(batch["doc_id"], batch["text"], batch["indicators"], strict=True):
            for order, pattern in enumerate(_COMPILED):
                for m in pattern.finditer(text or ""):
                    rows.append((doc, order, m.group(), m.start(), m.end(), text[max(0, m.start() - 100) : m.end() + 100], indicators))
        yield pd.DataFrame(rows, columns=["doc_id", "pattern", "citation", "start", "stop", "context", "indicators"])


def precedents(docs: DataFrame, top: int | None = 10) -> DataFrame:
    """(doc_id, rank, citation, start, stop, context, type, relevance_score), the most relevant first.

    Offsets of all matches need a matcher in Python; rows without a sign of a citation never reach it.
    """
    gate = F.col("text").rlike(r"(?iu)\sv\.?\s|§|section|cfr|const")
    found = docs.filter(gate).select(F.col("doc_id").cast("string").alias("doc_id"), "text", relevance_terms(F.col("text")).alias("indicators"))
    found = found.mapInPandas(_find, "doc_id string, pattern int, citation string, start int, stop int, context string, indicators int")
    scored = found.withColumns({"type": citation_type(F.col("citation")), "relevance_score": citation_relevance(F.col("citation"), F.col("indicators"))})
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("relevance_score"), "pattern", "start"))
    ranked = scored.drop("indicators").withColumn("rank", rank)
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.select(F.col("doc_id").cast("long").alias("doc_id"), "rank", "citation", "start", "stop", "context", "type", "relevance_score")
