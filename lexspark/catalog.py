"""All registered queries outside llm, and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import legal, text, vectors
from lexspark.operators import analytics, chunking, collection, embed, retrieval, similarity
from lexspark.operators.lineage import settle, spread
from lexspark.plans import answers, ingest
from lexspark.sources import folders

AS_OF = datetime(2024, 1, 31)
#: Stop words of the registered TF-IDF queries.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "on", "at", "by", "la", "le", "de", "en", "der", "die", "und", "el", "que"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# Views on the given tables, in SQL that Spark and others read alike.
VIEWS = {
    "planted": """
SELECT doc_id, source, lang AS category, text || CASE CAST(doc_id % 7 AS INT)
  WHEN 0 THEN chr(10) || 'SECTION 1. Compensation' || chr(10) || 'The employee salary payment of $1,200.00 follows 29 CFR 1630.2 and section 12 of the civil code.'
  WHEN 1 THEN ' WHEREAS, the parties enter this agreement on January 5, 2024; NOW THEREFORE, liability and damages follow. Service of the agreement.'
  WHEN 2 THEN ' Smith v. Jones, 347 US 483 (1954) is the holding. The court held a precedent. 42 USC § 1983 and U.S. Const. amend. XIV apply.'
  WHEN 3 THEN ' This non-disclosure and confidentiality obligation is proprietary. Governing law and jurisdiction: 3/15/2023.'
  WHEN 4 THEN ' The landlord and tenant sign the lease for rent of premises at $950 and $1,100.50 on 12/1/2022.'
  ELSE '' END AS text
FROM documents""",
    "contracts": """
SELECT doc_id, source, lang AS category, CASE CAST(doc_id % 5 AS INT)
  WHEN 0 THEN 'PREAMBLE' || chr(10) || 'Section 1 Scope of the services. ' || text || chr(10) || 'Section 2 Payment of the salary. The employer pays $1,200.00 each month to the employee for all services.' || chr(10) || 'Section 3 Termination of the agreement by either party. ' || text
  WHEN 1 THEN 'HEADS' || chr(10) || '1. The parties agree to the terms that follow here below.' || chr(10) || '2. The employee has the duties of the office named above. ' || text || chr(10) || '3. Notice of ten days ends it.'
  WHEN 2 THEN 'LIST' || chr(10) || '(a) confidential matters of the parties stay so for ever and ever' || chr(10) || '' || chr(10) || '(b) ' || text || chr(10) || '(c) governing law'
  WHEN 3 THEN 'RECITALS' || chr(10) || 'WHEREAS, the landlord lets the premises' || chr(10) || 'WHEREAS, the tenant pays the rent' || chr(10) || 'NOW THEREFORE, they agree. ' || text
  ELSE text END AS text
FROM documents""",
    "query_analytics": """
SELECT CAST(event_id AS STRING) AS query_id, event_type || ' ' || props AS query_text, CAST(ts AS TIMESTAMP) AS timestamp, value / 50 AS processing_time,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS avg_similarity_score, CAST(user_id AS STRING) AS user_id, event_type AS query_type,
  CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id, event_id AS seq
FROM events""",
    "user_activity": """
SELECT CAST(user_id AS STRING) AS user_id, event_type AS activity_type, props AS activity_data, CAST(ts AS TIMESTAMP) AS timestamp,
  CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS session_id
FROM events""",
    "system_performance": """
SELECT CAST(ts AS TIMESTAMP) AS timestamp, value % 100 AS cpu_usage, value / 2 AS memory_usage, value / 50 AS avg_response_time,
  CASE WHEN event_type = 'error' THEN 1.0E0 ELSE 0.0E0 END AS error_rate, value / 10 AS query_throughput
FROM events""",
    "document_analytics": """
SELECT CAST(doc_id AS STRING) AS document_id, CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP) + CAST(doc_id AS INT) * INTERVAL '1' MINUTE AS upload_timestamp,
  n_chars AS file_size, CAST(floor(n_chars / 1000) AS INT) + 1 AS chunks_created, n_chars / 1.0E4 AS processing_time, n_chars / 1.0E5 AS legal_complexity, source AS uploader_id
FROM documents""",
    "files": """
SELECT CAST(doc_id AS STRING) AS id, 'File' || CAST(doc_id AS STRING) || '.TXT' AS filename, CAST(CAST(TIMESTAMP '2024-01-01 00:00:00' AS DATE) AS STRING) || '-' || source AS upload_date,
  lang AS category, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source, text
FROM documents""",
    "repeated": """
SELECT CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN CAST(floor(doc_id / 10) AS BIGINT) ELSE doc_id END AS doc_id,
  CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'same text' ELSE text END AS text, lang, source, n_chars
FROM documents""",
    "chunk_vectors": """
SELECT CAST(vec_id AS STRING) AS id, CAST(floor(vec_id / 5) AS BIGINT) AS doc_id, label, embedding, label / 1.0E1 AS legal_score, (vec_id % 7) / 7.0E0 AS complexity_score
FROM embeddings""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view on one."""
    if name in VIEWS:
        sql = VIEWS[name]
        base = sql.rstrip().rpartition("FROM ")[2]
        return spark.sql(f"{sql.rpartition('FROM ')[0]} FROM {{base}}", base=table(spark, sf_dir, base))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)


def query(*names: str, sql: str | None = None) -> Callable:
    """Register a function of these tables; sql, which may read views by name, gives the same rows."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])
        if sql:
            views = [n for n in names if n in VIEWS]
            ORACLE_SQL[f.__name__] = (_with(*views) + (", " if sql.startswith("more ") else " ") if views else ("WITH " if sql.startswith("more ") else "")) + sql.removeprefix("more ")
        return f

    return keep


# Chunks and questions -------------------------------------------------------------------------------

#: Words of the text after blanks are collapsed, and windows of 100 words every 80.
CHUNKS_SQL = r"""
words AS (SELECT doc_id, source, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, source, w, unnest(range(0, len(w), 80)) AS s FROM words),
windows AS (SELECT doc_id, source, CAST(s / 80 AS INT) AS chunk_index, list_slice(w, s + 1, s + 100) AS part FROM starts),
chunks AS (SELECT doc_id, source, chunk_index, array_to_string(part, ' ') AS text, CAST(len(part) AS INT) AS chunk_size FROM windows),
named AS (SELECT *, md5(substring(text, 1, 100) || source || CAST(chunk_index AS VARCHAR)) AS id, CAST(length(text) AS INT) AS char_count FROM chunks)
"""


def _chunks(documents: DataFrame) -> DataFrame:
    return chunking.chunk_documents(documents.select("doc_id", "source", "text"), 100, 20)


@query("documents", sql=f"more {CHUNKS_SQL} SELECT doc_id, chunk_index, id, chunk_size, char_count, md5(text) AS text_md5 FROM named")
def chunk_windows(documents: DataFrame) -> DataFrame:
    return _chunks(documents).select("doc_id", "chunk_index", "id", "chunk_size", "char_count", F.md5("text").alias("text_md5"))


def _store(documents: DataFrame) -> DataFrame:
    """The chunk table that questions are put to, each id once, written once."""
    rows = _chunks(documents)
    first = F.min_by(F.struct(*rows.columns), F.struct("doc_id", "chunk_index")).alias("row")
    chunks = rows.groupBy("id").agg(first).select("row.*")
    return settle(chunks.withColumn("embedding", vectors.unit_hash_embedding(F.col("text"))), "chunks")


def _questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


HASH_SQL = r"list_transform(range(0, 16), lambda i: CAST(('0x' || substring(md5({0}), CAST(2 * i + 1 AS INT), 2)) AS INT))"
UNIT_SQL = "list_transform({0}, lambda x: CAST(CAST(x / sqrt(list_sum(list_transform({0}, lambda y: CAST(y * y AS DOUBLE)))) AS FLOAT) AS DOUBLE))"
FOUND_SQL = f"""
more {CHUNKS_SQL},
stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id, chunk_index) AS n FROM named) WHERE n = 1),
raw AS (SELECT id, {HASH_SQL.format("text")} AS h FROM stored),
c AS (SELECT id, {UNIT_SQL.format("h")} AS v FROM raw),
asked AS (SELECT item_id AS query_id, {HASH_SQL.format("trim(regexp_replace(text, '[[:space:]]+', ' ', 'g'))")} AS h FROM benchmark),
q AS (SELECT query_id, {UNIT_SQL.format("h")} AS v FROM asked),
s AS (SELECT query_id, id, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)), 12) AS score FROM q, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
found AS (SELECT r.query_id, CAST(r.rank AS INT) AS rank, r.id, r.score, t.source, t.text, t.chunk_index FROM r JOIN stored t USING (id) WHERE rank <= 5)
""".strip()
RETRIEVE_SQL = f"{FOUND_SQL} SELECT query_id, rank, id, round(score, 6) AS score FROM found"
CONFIDENCE_SQL = "round(least(avg(score) * 0.7E0 + least(count(*), 5) / 5 * 0.3E0, 1.0E0), 6) AS confidence, round(max_by(score, -rank), 6) AS top_score"
_LINES = "list_filter(string_split({0}, chr(10)), lambda x: trim(x) <> '')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: Sentences that an answer without a model consists of (fixed values).
FALLBACK_SQL = """'**Confidence Level: Medium**

Based on the available legal documents, here are the relevant sections for your query:

**Query:** ' || question || '

**Relevant Information:**
' || array_to_string(list_transform(snippets, lambda t, i: CASE WHEN t = '' THEN '' ELSE chr(10) || i || '. ' || string_split(t, chr(10))[1] || chr(10)
  || array_to_string(list_slice(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(x, 'Section:') AND NOT starts_with(x, 'Relevance')), 1, 3), chr(10)) || chr(10) END), '') || '
**Note:** This response was generated from document excerpts. For detailed legal advice, please consult with a qualified attorney.'"""


@query("documents", "benchmark", sql=RETRIEVE_SQL)
def retrieve_chunks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = retrieval.nearest_chunks(answers.embed_questions(_questions(benchmark)), _store(documents))
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _answers(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return answers.answer(_questions(benchmark), _store(documents))


@query(
    "documents",
    "benchmark",
    sql=f"""{FOUND_SQL}, told AS (SELECT query_id, list(id ORDER BY rank) AS ids, list(text ORDER BY rank) AS texts, {CONFIDENCE_SQL} FROM found GROUP BY query_id)
SELECT item_id AS query_id, CAST(len(ids) AS INT) AS n_sources, array_to_string(ids, ',') AS sources, confidence, top_score,
  'Based on the retrieved documents: ' || substring(array_to_string(list_transform(list_slice(texts, 1, 3), lambda t: substring(t, 1, 500)), chr(10)), 1, 1000) || '...' AS answer
FROM benchmark JOIN told ON query_id = item_id""",
)
def answer_questions(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    rounded = {"sources": F.array_join("sources", ","), "confidence": F.round("confidence", 6), "top_score": F.round("top_score", 6)}
    return _answers(documents, benchmark).withColumns(rounded)


@query(
    "documents",
    "benchmark",
    sql=rf"""{FOUND_SQL}, blocks AS (SELECT query_id, array_to_string(list(chr(10) || '--- Document ' || rank || ': ' || source
    || CASE WHEN chunk_index <> 0 THEN ' (chunk ' || chunk_index || ')' ELSE '' END || ' ---' || chr(10) || 'Section: General' || chr(10)
    || 'Relevance Score: ' || printf('%.2f', score) || chr(10) || chr(10) || text || chr(10) ORDER BY rank), chr(10)) AS context FROM found GROUP BY query_id),
cut AS (SELECT query_id, context, text AS question, list_transform(list_slice(string_split(context, '---'), 2, 3), lambda t: {_STRIP.format("t")}) AS snippets
  FROM blocks JOIN benchmark ON item_id = query_id)
SELECT query_id, context, {FALLBACK_SQL} AS fallback FROM cut""",
)
def question_contexts(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    chunks = _store(documents)
    found = retrieval.nearest_chunks(answers.embed_questions(_questions(benchmark)), chunks)
    told = retrieval.contexts(retrieval.with_chunks(found, chunks, ["text", "source", "chunk_index", "section_num"]))
    asked = _questions(benchmark).join(told, "query_id")
    return asked.select("query_id", "context", retrieval.fallback_answer(F.col("question"), F.col("context")).alias("fallback"))


_KEYWORDS_SQL = r"list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''))"


def _cases(benchmark: DataFrame) -> DataFrame:
    """Every distinct word of a question as its expected keywords."""
    return _questions(benchmark).select("query_id", F.array_distinct(text.words(F.lower("question"))).alias("keywords"))


@query(
    "documents",
    "benchmark",
    sql=f"""{FOUND_SQL}, told AS (SELECT query_id, lower(array_to_string(list(text ORDER BY rank), ' ')) AS told FROM found GROUP BY query_id),
cases AS (SELECT item_id AS query_id, {_KEYWORDS_SQL} AS k FROM benchmark),
each AS (SELECT query_id, len(list_filter(k, lambda x: contains(told, x))) / len(k) AS coverage FROM cases JOIN told USING (query_id) WHERE len(k) > 0)
SELECT query_id, round(coverage, 6) AS coverage, coverage >= 0.5 AS passed FROM each""",
)
def retrieval_evaluation(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    chunks = _store(documents)
    found = retrieval.with_chunks(retrieval.nearest_chunks(answers.embed_questions(_questions(benchmark)), chunks), chunks, ["text"])
    return retrieval.evaluate(_cases(benchmark), found)[0].withColumn("coverage", F.round("coverage", 6))


@query(
    "documents",
    "benchmark",
    sql=f"""{FOUND_SQL}, told AS (SELECT query_id, lower('Based on the retrieved documents: ' || substring(array_to_string(list_transform(list_slice(list(text ORDER BY rank), 1, 3), lambda t: substring(t, 1, 500)), chr(10)), 1, 1000) || '...') AS told
  FROM found GROUP BY query_id),
cases AS (SELECT item_id AS query_id, {_KEYWORDS_SQL} AS k FROM benchmark),
each AS (SELECT query_id, len(list_filter(k, lambda x: contains(told, x))) / len(k) AS coverage FROM cases JOIN told USING (query_id) WHERE len(k) > 0)
SELECT query_id, round(coverage, 6) AS coverage, coverage >= 0.5 AS passed FROM each""",
)
def answer_evaluation(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Answers held against every distinct word of their questions; without a source none passes."""
    return retrieval.evaluate_answers(_cases(benchmark), _answers(documents, benchmark))[0].withColumn("coverage", F.round("coverage", 6))


@query("documents", "benchmark", sql=f"{FOUND_SQL} SELECT query_id, {CONFIDENCE_SQL} FROM found GROUP BY query_id")
def question_confidence(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = retrieval.confidence(retrieval.nearest_chunks(answers.embed_questions(_questions(benchmark)), _store(documents)))
    return found.select("query_id", F.round("confidence", 6).alias("confidence"), F.round("top_score", 6).alias("top_score"))


# The patterns, terms and types of annotation in SQL: fixed values, written once beside those of functions/legal.

CITATIONS_SQL = [
    r"(?i)\b\w+\s+v\.?\s+\w+,?\s+\d+\s+\w+\.?\s*\d*\s+\d+\s*\(\d{4}\)", r"(?i)\b\d+\s+[A-Z]+\.?[A-Z]*\.?[A-Z]*\.?\s*§\s*\d+", r"(?i)\bsection\s+\d+\s+of\s+the\s+\w+\s+code\b",
    r"(?i)\b\d+\s+CFR\s+\d+\.\d+\b", r"(?i)\bU\.?S\.?\s+Const\.?\s+amend\.?\s+[IVXLC]+\b",
]


#: What the SQL looks for, written out so that it does not follow the code under test (fixed values).
VOCABULARY_SQL = (
    "contract", "agreement", "party", "parties", "whereas", "therefore", "covenant", "covenant not to", "employee", "employer", "employment",
    "termination", "compensation", "salary", "benefits", "confidentiality", "non-disclosure", "non-compete", "severance", "jurisdiction",
    "governing law", "dispute resolution", "arbitration", "litigation", "mediation", "rights", "obligations", "duties", "responsibilities",
    "liability", "indemnity", "warranty", "representation", "effective date", "term", "renewal", "expiration", "notice period", "advance notice",
    "payment", "invoice", "penalty", "damages", "liquidated damages", "interest", "late fee",
)
DOCUMENT_TYPES_SQL = {
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
SECTION_TYPES_SQL = {
    "compensation": ("compensation", "salary", "payment", "wage"),
    "termination": ("termination", "terminate", "end", "expir"),
    "confidentiality": ("confidential", "non-disclosure", "proprietary"),
    "recitals": ("whereas", "recital", "background"),
    "definitions": ("definition", "define", "means"),
    "governing_law": ("govern", "jurisdiction", "applicable law"),
}
TERM_PATTERNS_SQL = (
    r"whereas|therefore|heretofore|hereinafter|notwithstanding",
    r"party|parties|agreement|contract|consideration",
    r"liability|indemnify|damages|breach|default",
    r"termination|expiration|renewal|amendment",
    r"confidential|proprietary|intellectual property",
    r"jurisdiction|governing law|dispute resolution",
)


def _citations_sql(column: str) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({column}, '{p}')" for p in CITATIONS_SQL) + ")"


def _terms_sql(column: str) -> str:
    return "list_filter([" + ", ".join(f"'{t}'" for t in VOCABULARY_SQL) + f"], lambda t: contains(lower({column}), t))"


def _amounts_sql(column: str) -> str:
    return rf"regexp_extract_all({column}, '\$[\d,]+(?:\.\d{{2}})?')"


def _dates_sql(column: str) -> str:
    return rf"regexp_extract_all({column}, '\b\d{{1,2}}/\d{{1,2}}/\d{{4}}\b|\b\w+\s+\d{{1,2}},\s+\d{{4}}\b')"


def _count_sql(column: str) -> str:
    return rf"len(list_filter(string_split_regex({column}, '\s+'), lambda x: x <> ''))"


def _legal_sql(column: str) -> str:
    return f"CASE WHEN {_count_sql(column)} = 0 THEN 0.0E0 ELSE least(len({_terms_sql(column)}) / {_count_sql(column)} * 10, 1.0E0) END"


def _complexity_sql(column: str) -> str:
    sizes = f"list_filter(list_transform(string_split_regex({column}, '[.!?]+'), lambda s: {_count_sql('s')}), lambda c: c > 0)"
    return f"least(list_avg({sizes}) / 20, 1.0E0) * 0.4E0 + ({_legal_sql(column)}) * 0.4E0 + least(len({_citations_sql(column)}) / 10, 1.0E0) * 0.2E0"


def _hits_sql(terms: tuple[str, ...], column: str = "text") -> str:
    return " + ".join(f"CAST(contains(lower({column}), '{t}') AS INT)" for t in terms)


def _type_sql(column: str) -> str:
    kinds = ", ".join(f"{{'n': {_hits_sql(k, column)}, 'o': {-at}, 'name': '{name}'}}" for at, (name, k) in enumerate(DOCUMENT_TYPES_SQL.items()))
    return f"list_transform([list_max([{kinds}])], lambda b: CASE WHEN b.n > 0 THEN b.name ELSE 'general' END)[1]"


def _section_sql(column: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hits_sql(k, column)} > 0 THEN '{name}'" for name, k in SECTION_TYPES_SQL.items()) + " ELSE 'general' END"


def _legal_terms_sql(column: str) -> str:
    found = ", ".join(rf"regexp_extract_all(lower({column}), '\b(?:{p})\b')" for p in TERM_PATTERNS_SQL)
    return f"array_to_string(list_sort(list_distinct(flatten([{found}]))), ', ')"


def _clean_sql(column: str) -> str:
    """Cleaning in SQL for texts of Latin letters: letters up to U+017E decomposed, blanks collapsed."""
    out = column
    for code in range(0xC0, 0x17F):
        parts = unicodedata.normalize("NFKD", chr(code))
        if parts != chr(code):
            out = f"replace({out}, '{chr(code)}', '{parts}')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[\x00-\x08\x0b-\x1f]', '', 'g'), '\s+', ' ', 'g'))"


@query(
    "documents",
    sql=rf"""
WITH cleaned AS (SELECT doc_id, source, {_clean_sql("text")} AS text FROM documents WHERE trim(text) <> ''),
kept AS (SELECT md5(text) AS document_hash, min(doc_id) AS doc_id, min_by(source, doc_id) AS source, any_value(text) AS text FROM cleaned GROUP BY md5(text)),
words AS (SELECT *, {_type_sql("text")} AS legal_document_type, {_legal_terms_sql("text")} AS legal_terms, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM kept),
starts AS (SELECT *, unnest(range(0, len(w), 462)) AS s FROM words),
chunks AS (SELECT * EXCLUDE (text), CAST(s / 462 AS INT) AS chunk_index, array_to_string(list_slice(w, s + 1, s + 512), ' ') AS text, CAST(len(list_slice(w, s + 1, s + 512)) AS INT) AS chunk_size FROM starts)
SELECT doc_id, source, document_hash, legal_document_type, legal_terms, chunk_index, md5(substring(text, 1, 100) || source || CAST(chunk_index AS VARCHAR)) AS id, chunk_size,
  CAST(length(text) AS INT) AS char_count, md5(text) AS text_md5, {_section_sql("text")} AS section_type, round({_legal_sql("text")}, 6) AS legal_score, round({_complexity_sql("text")}, 6) AS complexity_score,
  array_to_string({_citations_sql("text")}, '; ') AS citations, array_to_string({_terms_sql("text")}, '; ') AS terms, array_to_string({_dates_sql("text")}, '; ') AS dates,
  array_to_string({_amounts_sql("text")}, '; ') AS amounts, 'unit_hash' AS embedding_model, 384 AS embedding_dimension FROM chunks""",
)
def ingest_chunks(documents: DataFrame) -> DataFrame:
    e = {"citations": "citations", "terms": "legal_terms", "dates": "dates", "amounts": "monetary_amounts"}
    return ingest.ingest(documents, AS_OF, 512, 50).select(
        "doc_id", "source", "document_hash", "legal_document_type", "legal_terms", "chunk_index", "id", "chunk_size", "char_count", F.md5("text").alias("text_md5"), "section_type",
        F.round("legal_score", 6).alias("legal_score"), F.round("complexity_score", 6).alias("complexity_score"), *[F.array_join(F.col("entities")[k], "; ").alias(c) for c, k in e.items()],
        "embedding_model", "embedding_dimension",
    )


def _forms_sql(column: str) -> str:
    """Blanks collapsed and legal forms in one way."""
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({column}, '\s+', ' ', 'g'), '\b(\d+)\s+U\.?S\.?\s+(\d+)', '\1 U.S. \2', 'g'), "
        r"'\b(\d+)\s+F\.?\s*(\d+)d?\s+(\d+)', '\1 F.\2d \3', 'g'), '\bWHEREAS,?\s+', 'WHEREAS ', 'g'), '\bNOW\s+THEREFORE,?\s+', 'NOW THEREFORE ', 'g'))"
    )


#: What begins a section, in order (fixed values).
SECTIONS_SQL = [
    r"\n\s*(?:Section|Article|Chapter|Part)\s+\d+", r"\n\s*\d+\.\s+", r"\n\s*[A-Z]\.\s+", r"\n\s*\([a-z]\)\s+", r"\n\s*\(\d+\)\s+", r"\nWHEREAS,", r"\nNOW THEREFORE,",
    r"\nIN WITNESS WHEREOF,",
]
_CUT_SQL = " ".join(rf"WHEN len(regexp_extract_all(text, '{p}')) >= 2 THEN string_split(regexp_replace(text, '({p})', chr(1) || '\1', 'g'), chr(1))" for p in SECTIONS_SQL)


def _sectioned_sql(table: str) -> str:
    """Chunks of 512 words by section, of a table of doc_id, source, text."""
    return rf"""
cut AS (SELECT doc_id, source, list_transform(CASE {_CUT_SQL} ELSE [text] END, lambda t: {_STRIP.format("t")}) AS parts, CASE {_CUT_SQL.replace("THEN string_split", "THEN len(string_split").replace("chr(1))", "chr(1)))")} ELSE 0 END AS n FROM {table}),
parts AS (SELECT doc_id, source, CASE WHEN n > 0 AND parts[1] = '' THEN parts[2:] ELSE parts END AS parts, n FROM cut),
sections AS (SELECT doc_id, source, unnest(CASE WHEN n > 0 THEN parts ELSE parts END) AS section, CASE WHEN len(parts) > 1 THEN generate_subscripts(parts, 1) - 1 END AS section_num FROM parts),
split AS (SELECT *, list_filter(string_split({_forms_sql("section")}, ' '), lambda x: x <> '') AS w FROM sections),
starts AS (SELECT *, unnest(range(0, len(w), 462)) AS s FROM split),
chunks AS (SELECT doc_id, source, CAST(section_num AS INT) AS section_num, CAST(s / 462 AS INT) AS chunk_index, array_to_string(list_slice(w, s + 1, s + 512), ' ') AS text, CAST(len(list_slice(w, s + 1, s + 512)) AS INT) AS chunk_size FROM starts)
SELECT doc_id, source, coalesce(section_num, -1) AS section_num, chunk_index, md5(substring(text, 1, 100) || source || CAST(chunk_index AS VARCHAR)) AS id, md5(text) AS text, chunk_size, CAST(length(text) AS INT) AS char_count FROM chunks"""


def _sectioned(rows: DataFrame) -> DataFrame:
    chunks = chunking.chunk_documents(rows.select("doc_id", "source", "text"), 512, 50, normalize_first=False)
    return chunks.withColumns({"text": F.md5("text"), "section_num": F.coalesce("section_num", F.lit(-1))})


@query("documents", sql="more " + _sectioned_sql("documents").strip())
def chunk_sections(documents: DataFrame) -> DataFrame:
    return _sectioned(documents)


@query("contracts", sql="more " + _sectioned_sql("contracts").strip())
def contract_sections(contracts: DataFrame) -> DataFrame:
    return _sectioned(contracts)


#: Lines that are headers (fixed values).
HEADER_SQL = r"(?i)^(?:\s*(?:SECTION|SEC\.)\s+\d+|\s*(?:ARTICLE|ART\.)\s+\d+|\s*CLAUSE\s+\d+|\s*\d+\.\s+[A-Z]|\s*\([a-z]\)\s+|\s*WHEREAS\b|\s*NOW THEREFORE\b|\s*IN WITNESS WHEREOF\b)"


def _section_table_sql(table: str) -> str:
    return rf"""
more lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {table}),
marked AS (SELECT *, regexp_matches(line, '{HEADER_SQL}') AS header FROM lines),
grouped AS (SELECT *, sum(CAST(header AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM marked),
found AS (SELECT doc_id, g, {_STRIP.format("min_by(line, pos)")} AS title, min(pos) AS pos, any_value(n) AS n,
  string_agg(line, chr(10) ORDER BY pos) FILTER (NOT header AND {_STRIP.format("line")} <> '') AS content FROM grouped WHERE g > 0 GROUP BY doc_id, g),
ended AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY g), n) AS end_line FROM found),
kept AS (SELECT * FROM ended WHERE title <> '' AND content IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INT) AS section_num, title, {_STRIP.format("content")} AS content,
  CAST(coalesce(lag(end_line) OVER (PARTITION BY doc_id ORDER BY g), 0) AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM kept""".strip()


@query("planted", sql=_section_table_sql("planted"))
def section_table(planted: DataFrame) -> DataFrame:
    return chunking.section_table(spread(planted))


@query("contracts", sql=_section_table_sql("contracts"))
def contract_table(contracts: DataFrame) -> DataFrame:
    return chunking.section_table(spread(contracts))


#: Sentences marked as sections and subsections.
MARKED_SQL = _STRIP.format(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([.!?])\s*([A-Z])', '\1' || chr(10) || '\2', 'g'), '(\n\s*\d+\.)', chr(10) || chr(10) || 'SECTION\1', 'g'), '(\n\s*\([a-z]\))', chr(10) || chr(10) || 'SUBSECTION\1', 'g')"
)


def _enhanced_sql(table: str) -> str:
    """chunked: doc_id, chunk_index, text, section_type, is_subsection, chunk_size of enhanced chunks."""
    chunk = lambda t, kind, sub: f"{{'text': {t}, 'section_type': {kind}, 'is_subsection': {sub}}}"
    whole = chunk(_STRIP.format("s"), _section_sql("s"), "FALSE")
    part = chunk(_STRIP.format("x"), _section_sql("s"), "contains(s, 'SUBSECTION')")
    parts = rf"list_transform(list_filter(string_split_regex(s, '\n\s*SUBSECTION\s*'), lambda x: {_STRIP.format('x')} <> ''), lambda x: {part})"
    told = _STRIP.format("array_to_string({0}.now, ' ')")
    state = "{'done': CAST([] AS VARCHAR[]), 'now': CAST([] AS VARCHAR[]), 'n': CAST(0 AS BIGINT)}"
    step = f"""{{'done': CASE WHEN a.n + x.n <= 200 OR len(a.now) = 0 THEN a.done ELSE list_append(a.done, {told.format("a")}) END,
    'now': CASE WHEN a.n + x.n <= 200 THEN list_concat(a.now, x.now) ELSE x.now END, 'n': CASE WHEN a.n + x.n <= 200 THEN a.n + x.n ELSE x.n END}}"""
    return rf"""
more marked AS (SELECT doc_id, {MARKED_SQL} AS m FROM {table}),
cut AS (SELECT doc_id, flatten(list_transform(list_filter(string_split_regex(m, '\n\s*SECTION\s*'), lambda s: {_STRIP.format('s')} <> ''),
    lambda s: CASE WHEN {_count_sql("s")} > 200 THEN {parts} ELSE [{whole}] END)) AS cut,
  list_reduce(list_transform(string_split(regexp_replace(m, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: {{'done': CAST([] AS VARCHAR[]), 'now': [t], 'n': CAST({_count_sql("t")} AS BIGINT)}}),
    lambda a, x: {step}, {state}) AS packed FROM marked),
both_ways AS (SELECT doc_id, cut, list_filter(CASE WHEN len(packed.now) = 0 THEN packed.done ELSE list_append(packed.done, {told.format("packed")}) END, lambda x: x <> '') AS packed FROM cut),
chosen AS (SELECT doc_id, list_filter(CASE WHEN len(cut) <= 1 THEN list_concat(cut, list_transform(packed, lambda t: {chunk("t", "'paragraph'", "FALSE")})) ELSE cut END, lambda c: {_count_sql("c.text")} >= 10) AS chunks FROM both_ways),
chunked AS (SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INT) AS chunk_index, unnest(chunks, max_depth := 2), FROM chosen),
sized AS (SELECT *, CAST({_count_sql("text")} AS INT) AS chunk_size FROM chunked)
""".strip()


@query("planted", sql=_enhanced_sql("planted") + " SELECT doc_id, chunk_index, text, section_type, is_subsection, chunk_size FROM sized")
def enhanced_chunks(planted: DataFrame) -> DataFrame:
    return chunking.enhanced_chunks(spread(planted))


@query("contracts", sql=_enhanced_sql("contracts") + " SELECT doc_id, chunk_index, text, section_type, is_subsection, chunk_size FROM sized")
def contract_chunks(contracts: DataFrame) -> DataFrame:
    return chunking.enhanced_chunks(spread(contracts))


# Texts and annotation -------------------------------------------------------------------------------


@query(
    "documents",
    sql=r"""
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INT) AS word_count, CAST(length(text) AS INT) AS char_count,
  md5(text) AS document_hash, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview,
  CASE WHEN length(trim(text)) < 10 OR length(regexp_replace(text, '[^\x00-\x7f]', '', 'g')) / length(text) < 0.3
    OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) < 0.2 OR (length(text) - length(regexp_replace(text, '\s', '', 'g'))) / length(text) > 0.8
    OR (length(text) - length(regexp_replace(text, '\s', '', 'g'))) / length(text) < 0.05
    OR len(list_distinct(string_split(text, ''))) < greatest(5.0, length(text) * 0.1) THEN 'poor' ELSE 'good' END AS extraction_quality
FROM documents""",
)
def text_statistics(documents: DataFrame) -> DataFrame:
    t = F.col("text")
    return spread(documents).select(
        "doc_id", text.word_count(t).alias("word_count"), F.length(t).alias("char_count"), text.content_hash(t).alias("document_hash"),
        text.preview(t).alias("preview"), text.extraction_quality(t).alias("extraction_quality"),
    )


@query("planted", sql=f"SELECT doc_id, {_forms_sql('text')} AS text FROM planted")
def preprocess_legal(planted: DataFrame) -> DataFrame:
    return spread(planted).select("doc_id", text.preprocess_legal(F.col("text")).alias("text"))


@query("documents", sql=f"SELECT doc_id, {_clean_sql('text')} AS text FROM documents")
def clean_documents(documents: DataFrame) -> DataFrame:
    return spread(documents).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(
    "planted",
    sql=f"""SELECT doc_id, array_to_string({_citations_sql("text")}, '; ') AS citations, array_to_string({_amounts_sql("text")}, '; ') AS amounts,
  array_to_string({_dates_sql("text")}, '; ') AS dates, array_to_string({_terms_sql("text")}, '; ') AS terms FROM planted""",
)
def legal_entities(planted: DataFrame) -> DataFrame:
    e = legal.entities(F.col("text"))
    told = {"citations": "citations", "amounts": "monetary_amounts", "dates": "dates", "terms": "legal_terms"}
    return spread(planted).select("doc_id", *[F.array_join(e[k], "; ").alias(c) for c, k in told.items()])


@query("planted", sql=f"SELECT doc_id, {_legal_terms_sql('text')} AS legal_terms FROM planted")
def legal_terms(planted: DataFrame) -> DataFrame:
    return spread(planted).select("doc_id", text.joined(legal.legal_terms(F.col("text"))).alias("legal_terms"))


@query("planted", sql=f"SELECT doc_id, {_type_sql('text')} AS document_type, {_section_sql('text')} AS section_type FROM planted")
def document_types(planted: DataFrame) -> DataFrame:
    return spread(planted).select("doc_id", legal.document_type(F.col("text")).alias("document_type"), legal.section_type(F.col("text")).alias("section_type"))


@query("planted", sql=f"SELECT doc_id, round({_legal_sql('text')}, 6) AS legal_score, round({_complexity_sql('text')}, 6) AS complexity_score FROM planted")
def legal_scores(planted: DataFrame) -> DataFrame:
    rows = spread(planted).select("doc_id", "text", legal.legal_score(F.col("text")).alias("score"))
    return rows.select("doc_id", F.round("score", 6).alias("legal_score"), F.round(legal.complexity_score(F.col("text"), F.col("score")), 6).alias("complexity_score"))


#: Terms that make a text's citations more relevant (fixed values).
RELEVANCE_SQL = _hits_sql(("holding", "rule", "precedent", "established", "court held"))


@query(
    "planted",
    sql="more m AS (" + " UNION ALL ".join(f"SELECT doc_id, text, {k} AS pattern, unnest(regexp_extract_all(text, '{p}')) AS citation FROM planted" for k, p in enumerate(CITATIONS_SQL)) + rf"""),
s AS (SELECT *, strpos(text, citation) - 1 AS start, least(0.5E0 + CASE WHEN contains(lower(citation), 'v.') THEN 0.2E0 ELSE 0.0E0 END + ({RELEVANCE_SQL}) * 0.1E0, 1.0E0) AS relevance_score,
  CASE WHEN contains(lower(citation), 'v.') THEN 'case_law' WHEN contains(lower(citation), 'cfr') THEN 'federal_regulation' WHEN contains(lower(citation), 'u.s.c') THEN 'federal_statute'
    WHEN contains(lower(citation), 'const') THEN 'constitutional' WHEN contains(lower(citation), 'section') THEN 'code_section' ELSE 'unknown' END AS type FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(relevance_score, 6) DESC, pattern, start) AS rank FROM s)
SELECT doc_id, CAST(rank AS INT) AS rank, citation, CAST(start AS INT) AS start, CAST(start + length(citation) AS INT) AS stop,
  substring(text, greatest(start - 100, 0) + 1, start + length(citation) + 100 - greatest(start - 100, 0)) AS context, type, round(relevance_score, 6) AS relevance_score FROM r WHERE rank <= 10""",
)
def precedents(planted: DataFrame) -> DataFrame:
    return legal.precedents(spread(planted)).withColumn("relevance_score", F.round("relevance_score", 6))


@query(
    "planted",
    sql=_enhanced_sql("planted") + f""", cited AS (SELECT doc_id, {_citations_sql("text")} AS c FROM planted),
ordered AS (SELECT doc_id, list_filter(c, lambda x, i: list_position(c, x) = i) AS c FROM cited)
SELECT doc_id, chunk_index, s.text, section_type, is_subsection, chunk_size, array_to_string(list_filter(c, lambda x: contains(s.text, x)), '; ') AS precedents,
  round({_legal_sql("s.text")}, 6) AS legal_score, round({_complexity_sql("s.text")}, 6) AS complexity_score FROM sized s JOIN ordered USING (doc_id)""",
)
def analysed_chunks(planted: DataFrame) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("legal_score", "complexity_score")}
    return ingest.analyse(spread(planted))[0].drop("legal_entities").withColumns(rounded | {"precedents": F.array_join("precedents", "; ")})


#: Class of a document and questions for it (fixed values).
CLASS_SQL = f"""CASE WHEN {_hits_sql(("employment", "agreement"))} = 2 THEN 'employment_agreement' WHEN {_hits_sql(("non-disclosure", "confidentiality"))} > 0 THEN 'nda'
  WHEN {_hits_sql(("lease", "rental"))} > 0 THEN 'lease_agreement' WHEN {_hits_sql(("purchase", "sale"))} = 2 THEN 'purchase_agreement' WHEN {_hits_sql(("service", "agreement"))} = 2 THEN 'service_agreement'
  WHEN len(c) > 3 THEN 'legal_brief' ELSE 'general_legal' END"""
SUGGESTIONS_SQL = """array_to_string(list_slice(list_concat(CASE document_class
  WHEN 'employment_agreement' THEN ['What are the compensation details?', 'What are the termination conditions?', 'What confidentiality requirements exist?', 'What benefits are provided?']
  WHEN 'nda' THEN ['What information is considered confidential?', 'What are the penalties for disclosure?', 'How long does the confidentiality obligation last?'] ELSE [] END,
  list_transform(list_slice(t, 1, 3), lambda x: 'Tell me more about ' || x)), 1, 8), ' ')"""


@query(
    "planted",
    sql=_enhanced_sql("planted") + f""", per AS (SELECT doc_id, avg({_complexity_sql("text")}) AS legal_complexity, count(*) AS chunks_created, sum(chunk_size) AS total_tokens FROM sized GROUP BY doc_id),
found AS (SELECT doc_id, text, {_citations_sql("text")} AS c, {_terms_sql("text")} AS t FROM planted),
kinds AS (SELECT *, {CLASS_SQL} AS document_class FROM found)
SELECT doc_id, CAST(len(c) + len(t) AS INT) AS total_entities, CAST(len(c) AS INT) AS precedent_count, array_to_string(list_slice(t, 1, 10), '; ') AS key_legal_terms,
  array_to_string(list_slice(c, 1, 5), '; ') AS citations_found, document_class, round(legal_complexity, 6) AS legal_complexity, CAST(coalesce(chunks_created, 0) AS BIGINT) AS chunks_created,
  CAST(coalesce(total_tokens, 0) AS BIGINT) AS total_tokens, {SUGGESTIONS_SQL} AS suggestions FROM kinds LEFT JOIN per USING (doc_id)""",
)
def document_analysis(planted: DataFrame) -> DataFrame:
    told = {"key_legal_terms": F.array_join("key_legal_terms", "; "), "citations_found": F.array_join("citations_found", "; "), "suggestions": F.array_join("suggestions", " ")}
    return ingest.analyse(spread(planted))[1].withColumns(told | {"legal_complexity": F.round("legal_complexity", 6)})


@query("planted", sql=f"WITH_FOUND SELECT doc_id, document_class, {SUGGESTIONS_SQL} AS suggestions FROM kinds".replace("WITH_FOUND", f"""more found AS (SELECT doc_id, text, {_citations_sql("text")} AS c, {_terms_sql("text")} AS t FROM planted),
kinds AS (SELECT *, {CLASS_SQL} AS document_class FROM found)"""))  # fmt: skip
def suggested_questions(planted: DataFrame) -> DataFrame:
    t = F.col("text")
    rows = spread(planted).select("doc_id", legal.document_class(t, F.size(legal.citations(t))).alias("document_class"), legal.vocabulary_terms(t).alias("t"))
    return rows.select("doc_id", "document_class", F.array_join(legal.query_suggestions(F.col("document_class"), F.col("t")), " ").alias("suggestions"))


@query(
    "planted",
    sql=_enhanced_sql("planted") + f""", kinds AS (SELECT 'legal_document_type' AS key, {_type_sql("text")} AS value FROM planted),
terms AS (SELECT 'legal_term' AS key, unnest(list_filter(string_split({_legal_terms_sql("text")}, ', '), lambda x: x <> '')) AS value FROM planted),
sections AS (SELECT DISTINCT doc_id, 'section_type' AS key, section_type AS value FROM sized)
SELECT key, value, count(*) AS n FROM (SELECT * FROM kinds UNION ALL SELECT * FROM terms UNION ALL SELECT key, value FROM sections) GROUP BY ALL""",
)
def corpus_roll_up(planted: DataFrame) -> DataFrame:
    t, rows = F.col("text"), spread(planted)
    processed = rows.select(legal.document_type(t).alias("legal_document_type"), text.joined(legal.legal_terms(t)).alias("legal_terms"))
    return ingest.roll_up(processed, chunking.enhanced_chunks(rows))


@query(
    "documents",
    sql="""WITH pages AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)
SELECT doc_id, coalesce(string_agg('[Page ' || page || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY page) FILTER (trim(t) <> ''), '') AS text, count(*) AS page_count FROM pages GROUP BY doc_id""",
)
def assembled_pages(documents: DataFrame) -> DataFrame:
    pages = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")
    return folders.assemble_pages(pages)


@query(
    "documents",
    sql="""SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 2 = 1 AND regexp_matches(text, '[^\\x00-\\x7f]') THEN 'latin-1' ELSE 'utf-8' END AS encoding_used FROM documents""",
)
def decoded_texts(documents: DataFrame) -> DataFrame:
    """Texts as files of two encodings, decoded again."""
    content = F.when(F.col("doc_id") % 2 == 1, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return folders.decode_texts(documents.select("doc_id", content.alias("content"))).select("doc_id", F.md5("text").alias("text_md5"), "encoding_used")


@query(
    "documents",
    sql="""WITH t AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '%PDF-1.7 ' || text WHEN 1 THEN '  ' || substring(text, 1, 9) || ' ' ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN starts_with(text, '%PDF') THEN 'text is raw PDF data' WHEN length(trim(text)) < 10 THEN 'short' ELSE 'good' END AS state FROM t""",
)
def extraction_check(documents: DataFrame) -> DataFrame:
    """Texts of which some are still raw files and some are too short."""
    t = F.col("text")
    rows = documents.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("%PDF-1.7 "), t)).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("  "), F.substring(t, 1, 9), F.lit(" "))).otherwise(t).alias("text"))
    good, bad = folders.check_extraction(rows)
    return good.select("doc_id", F.when(F.col("too_short"), "short").otherwise("good").alias("state")).unionByName(bad.select("doc_id", F.col("reason").alias("state")))


@query(
    "documents",
    sql=r"""SELECT doc_id, md5(CASE WHEN length(trim(text)) < 10 OR length(regexp_replace(text, '[^\x00-\x7f]', '', 'g')) / length(text) < 0.3
    OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text) < 0.2 OR (length(text) - length(regexp_replace(text, '\s', '', 'g'))) / length(text) > 0.8
    OR (length(text) - length(regexp_replace(text, '\s', '', 'g'))) / length(text) < 0.05
    OR len(list_distinct(string_split(text, ''))) < greatest(5.0, length(text) * 0.1)
  THEN '[WARNING: Text extraction may be incomplete or corrupted]' || chr(10) || chr(10) || text ELSE text END) AS text_md5 FROM documents""",
)
def banner_texts(documents: DataFrame) -> DataFrame:
    return spread(documents).select("doc_id", F.md5(text.with_banner(F.col("text"))).alias("text_md5"))


@query("contracts", sql=f"SELECT doc_id, {MARKED_SQL} AS text FROM contracts")
def sentence_texts(contracts: DataFrame) -> DataFrame:
    return spread(contracts).select("doc_id", text.preprocess_sentences(F.col("text")).alias("text"))


@query("documents", sql="SELECT doc_id, md5(text || '\"' || source || '\"') AS id FROM documents")
def document_ids(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", chunking.document_id(F.col("text"), F.col("source")).alias("id"))


@query(
    "documents",
    sql="""SELECT doc_id, 'pdf_info_author=' || source || ';pdf_info_title=;pdf_pages=' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE CAST(doc_id % 3 AS VARCHAR) END || ';pdf_scanned='
  || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE '' END || ';pdf_tags=' || lang || ', ' || source AS metadata FROM documents""",
)
def flattened_metadata(documents: DataFrame) -> DataFrame:
    nested = F.struct(
        F.struct(F.col("source").alias("author"), F.lit(None).cast("string").alias("title")).alias("info"), (F.col("doc_id") % 3).alias("pages"),
        (F.col("doc_id") % 2 == 0).alias("scanned"), F.array("lang", "source").alias("tags"),
    )
    rows = documents.select("doc_id", nested.alias("pdf"))
    flat = text.flatten_struct(F.col("pdf"), rows.schema["pdf"].dataType, "pdf")
    return rows.select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(flat)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata"))


# Vectors --------------------------------------------------------------------------------------------


@query(
    "documents",
    sql=f"""
SELECT doc_id, round(list_sum(list_transform({HASH_SQL.format("text")}, lambda x: CAST(CAST(x / 255.0E0 AS FLOAT) AS DOUBLE))) * 24, 4) AS repeated_sum,
  round(list_sum({UNIT_SQL.format("(" + HASH_SQL.format("text") + ")")}), 4) AS unit_sum,
  round(list_sum(list_transform(range(0, 384), lambda i: CAST(CAST(({HASH_SQL.format("text")})[i % 16 + 1] / 255.0E0 AS FLOAT) AS DOUBLE) * (i + 1))), 3) AS repeated_order,
  round(list_sum(list_transform({UNIT_SQL.format("(" + HASH_SQL.format("text") + ")")}, lambda x, i: x * i)), 3) AS unit_order FROM documents""",
)
def hash_embeddings(documents: DataFrame) -> DataFrame:
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    placed = lambda v: F.round(F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x), 3)
    rows = documents.select("doc_id", vectors.repeated_hash_embedding(F.col("text")).alias("r"), vectors.unit_hash_embedding(F.col("text")).alias("u"))
    return rows.select("doc_id", total("r").alias("repeated_sum"), total("u").alias("unit_sum"), placed("r").alias("repeated_order"), placed("u").alias("unit_order"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "documents",
    sql=rf"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{2,}}') AND x NOT IN ({_STOP_SQL})) AS t FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM t),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
totals AS (SELECT term, sum(tf) AS total, count(*) AS df FROM counts GROUP BY term ORDER BY total DESC, term LIMIT 1000),
raw AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM counts JOIN totals USING (term)),
size AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM raw GROUP BY doc_id)
SELECT doc_id AS id, term, round(w / s, 6) AS weight FROM raw JOIN size USING (doc_id)""",
)
def tfidf_vectors(documents: DataFrame) -> DataFrame:
    texts = embed.tokens(documents.select(F.col("doc_id").alias("id"), "text"), STOP_WORDS)
    found = embed.tfidf(texts, embed.fit_tfidf(texts, STOP_WORDS), STOP_WORDS)
    return found.withColumn("weight", F.round("weight", 6))


@query(
    "planted",
    sql=rf"""
more t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2 AND x NOT IN ({_STOP_SQL})) AS t FROM planted),
grams AS (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS term FROM t),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams WHERE term IN ({", ".join(f"'{t}'" for t in VOCABULARY_SQL)}) GROUP BY ALL),
model AS (SELECT term, ln((1 + (SELECT count(*) FROM planted)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM counts JOIN model USING (term)),
size AS (SELECT doc_id, sqrt(sum(w * w)) AS s FROM raw GROUP BY doc_id)
SELECT doc_id AS id, term, round(w / s, 6) AS weight FROM raw JOIN size USING (doc_id)""".strip(),
)
def legal_tfidf_vectors(planted: DataFrame) -> DataFrame:
    texts = embed.tokens(planted.select(F.col("doc_id").alias("id"), "text"), STOP_WORDS, embed.ANY)
    return embed.tfidf(texts, embed.fixed_vocabulary(texts, STOP_WORDS), STOP_WORDS, 3, sublinear=True).withColumn("weight", F.round("weight", 6))


def _vector_sql(score: str, where: str = "TRUE") -> str:
    return f"""
more v AS (SELECT id, legal_score, complexity_score, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM chunk_vectors),
q AS (SELECT CAST(id AS BIGINT) AS query_id, e FROM v WHERE CAST(id AS BIGINT) % 50 = 0),
b AS (SELECT query_id, id, legal_score, complexity_score, {score} AS base FROM q, v WHERE {where}),
"""


def _vector_queries(chunk_vectors: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 50."""
    return chunk_vectors.filter(F.col("id").cast("long") % 50 == 0).select(F.col("id").cast("long").alias("query_id"), "embedding")


_COSINE = "round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 12)"
_RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= "


@query("chunk_vectors", sql=(_vector_sql(_COSINE) + f"s AS (SELECT query_id, id, base AS score FROM b), {_RANKED} 5").strip())
def cosine_search(chunk_vectors: DataFrame) -> DataFrame:
    found = retrieval.nearest_chunks(_vector_queries(chunk_vectors), chunk_vectors)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(
    "chunk_vectors",
    sql=(_vector_sql("round(1 - list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 12)", "label >= 3") + f"s AS (SELECT query_id, id, base AS score FROM b), {_RANKED} 5").strip(),
)
def distance_search(chunk_vectors: DataFrame) -> DataFrame:
    where = collection.predicate({"label": {"$gte": 3}})
    found = retrieval.nearest_chunks(_vector_queries(chunk_vectors), chunk_vectors, metric="l2", where=where)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(
    "chunk_vectors",
    sql=(_vector_sql(_COSINE) + f"s AS (SELECT query_id, id, 0.7E0 * base + 0.2E0 * legal_score + 0.1E0 * complexity_score AS score FROM b), {_RANKED} 10 AND score >= 0.3").strip(),
)
def hybrid_search(chunk_vectors: DataFrame) -> DataFrame:
    found = retrieval.nearest_chunks(_vector_queries(chunk_vectors), chunk_vectors, 10, weights=(0.7, 0.2, 0.1), least=0.3)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


PAIRS_SQL = """
more c AS (SELECT doc_id, list_transform(range(1, 65), lambda i: 0.0E0) AS zero, list(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS es FROM chunk_vectors GROUP BY doc_id),
m AS (SELECT doc_id, list_transform(range(1, 65), lambda i: list_avg(list_transform(es, lambda e: e[i]))) AS e FROM c),
pairs AS (SELECT a.doc_id AS doc1_id, b.doc_id AS doc2_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) AS similarity_score
  FROM m a JOIN m b ON a.doc_id < b.doc_id),
alike AS (SELECT * FROM pairs WHERE similarity_score >= 0.25)
""".strip()


def _pairs(chunk_vectors: DataFrame) -> DataFrame:
    return settle(similarity.similar_documents(_centroids(chunk_vectors), 0.25), "pairs")


def _centroids(chunk_vectors: DataFrame) -> DataFrame:
    return settle(similarity.centroids(chunk_vectors, 64), "centroids")


_BAND = "CASE WHEN {0} > {1} THEN 'high' WHEN {0} > {2} THEN 'medium' ELSE 'low' END"


@query("chunk_vectors", sql=f"{PAIRS_SQL} SELECT doc1_id, doc2_id, round(similarity_score, 6) AS similarity_score, {_BAND.format('similarity_score', 0.9, 0.8)} AS band FROM alike")
def similar_documents(chunk_vectors: DataFrame) -> DataFrame:
    pairs = _pairs(chunk_vectors)
    return pairs.select("doc1_id", "doc2_id", F.round("similarity_score", 6).alias("similarity_score"), similarity.band(F.col("similarity_score")).alias("band"))


@query(
    "chunk_vectors",
    sql=PAIRS_SQL
    + """, both_ways AS (SELECT doc1_id AS doc_id, doc2_id AS other_id, similarity_score FROM alike UNION ALL SELECT doc2_id, doc1_id, similarity_score FROM alike),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity_score DESC, other_id) AS rank FROM both_ways)
SELECT doc_id, CAST(rank AS INT) AS rank, other_id, round(similarity_score, 6) AS similarity_score FROM r WHERE rank <= 10""",
)
def most_similar_documents(chunk_vectors: DataFrame) -> DataFrame:
    return similarity.most_similar(_pairs(chunk_vectors)).withColumn("similarity_score", F.round("similarity_score", 6))


@query("chunk_vectors", sql=f"{PAIRS_SQL} SELECT round(avg(similarity_score), 6) AS avg_similarity, round(max(similarity_score), 6) AS max_similarity, count(*) AS total_comparisons FROM pairs")
def similarity_totals(chunk_vectors: DataFrame) -> DataFrame:
    docs = _centroids(chunk_vectors)
    row = similarity.similarity_totals(docs, similarity.similar_documents(docs, 0.25))
    return row.select(F.round("avg_similarity", 6).alias("avg_similarity"), F.round("max_similarity", 6).alias("max_similarity"), "total_comparisons")


@query("chunk_vectors", sql=f"{PAIRS_SQL} SELECT doc1_id, doc2_id, round(similarity_score, 6) AS similarity_score FROM alike WHERE similarity_score > 0.3 ORDER BY similarity_score DESC, doc1_id, doc2_id LIMIT 20")
def top_similar_pairs(chunk_vectors: DataFrame) -> DataFrame:
    return similarity.top_pairs(_pairs(chunk_vectors), 0.3).withColumn("similarity_score", F.round("similarity_score", 6))


@query(
    "chunk_vectors",
    sql=PAIRS_SQL
    + """, linked AS (SELECT doc1_id AS a, doc2_id AS b FROM alike WHERE similarity_score > 0.35 UNION ALL SELECT doc2_id, doc1_id FROM alike WHERE similarity_score > 0.35),
reach AS (SELECT a, a AS b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS cluster_id FROM reach GROUP BY a)
SELECT doc_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size FROM least""",
)
def document_clusters(chunk_vectors: DataFrame) -> DataFrame:
    return similarity.clusters(_pairs(chunk_vectors), 0.35)


ORACLE_SQL["document_clusters"] = ORACLE_SQL["document_clusters"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "chunk_vectors",
    sql=(_vector_sql("round(1 - list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 12)") + f"s AS (SELECT query_id, id, base AS score FROM b), {_RANKED} 3")
    .strip()
    .replace("SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM r", "SELECT query_id, CAST(rank AS INT) AS rank, r.id, c.label, round(1 - score, 6) AS distance FROM r JOIN v c USING (id)"),
)
def search_included(chunk_vectors: DataFrame) -> DataFrame:
    """Metadata and distances of a search, without texts."""
    rows = chunk_vectors.withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))
    found = retrieval.search(_vector_queries(chunk_vectors), rows, 3, include=("metadatas", "distances"))
    return found.select("query_id", "rank", "id", F.col("metadata")["label"].cast("int").alias("label"), F.round("distance", 6).alias("distance"))


# Collection -----------------------------------------------------------------------------------------


def _rows(files: DataFrame) -> DataFrame:
    return files.select("id", "text", "source", "category", F.lit(AS_OF).cast("timestamp").alias("indexed_at"), F.create_map(F.lit("category"), F.col("category")).alias("metadata"))


@query("files", sql="SELECT id, source, category FROM files WHERE CAST(id AS BIGINT) % 3 <> 1 UNION ALL SELECT id, source, category FROM files WHERE CAST(id AS BIGINT) % 3 = 1")
def collection_add(files: DataFrame) -> DataFrame:
    rows = _rows(files)
    return collection.add(rows.filter(F.col("id").cast("long") % 3 != 1), rows.filter(F.col("id").cast("long") % 3 != 0), AS_OF).select("id", "source", "category")


@query("files", sql="SELECT id, category FROM files WHERE CAST(id AS BIGINT) % 4 = 0")
def collection_get(files: DataFrame) -> DataFrame:
    return collection.get(files, files.filter(F.col("id").cast("long") % 4 == 0)).select("id", "category")


@query("files", sql="SELECT id, category FROM files WHERE CAST(id AS BIGINT) % 4 <> 0")
def collection_delete(files: DataFrame) -> DataFrame:
    return collection.delete(files, files.filter(F.col("id").cast("long") % 4 == 0)).select("id", "category")


@query("files", sql="SELECT id, source FROM files WHERE source IS NULL OR NOT (source IN ('src1', 'src2') OR category = 'fr')")
def collection_delete_where(files: DataFrame) -> DataFrame:
    return collection.delete_where(files.filter("category is not null"), {"$or": [{"source": {"$in": ["src1", "src2"]}}, {"category": "fr"}]}).select("id", "source")


ORACLE_SQL["collection_delete_where"] = _with("files") + " SELECT id, source FROM files WHERE NOT coalesce(source IN ('src1', 'src2') OR category = 'fr', FALSE)"


@query(
    "files",
    sql="""SELECT id, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 'new' ELSE category END AS category, CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN 'yes' END AS checked,
  CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN '2024-01-31' END AS updated FROM files""",
)
def collection_update(files: DataFrame) -> DataFrame:
    new = files.filter(F.col("id").cast("long") % 10 == 0).select("id", F.create_map(F.lit("category"), F.lit("new"), F.lit("checked"), F.lit("yes")).alias("metadata"))
    rows = collection.update_metadata(_rows(files), new, AS_OF)
    return rows.select("id", F.try_element_at("metadata", F.lit("category")).alias("category"), F.try_element_at("metadata", F.lit("checked")).alias("checked"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("files", sql="SELECT id, filename FROM files WHERE category = 'de' AND source >= 'src1' ORDER BY id LIMIT 10")
def collection_search(files: DataFrame) -> DataFrame:
    return collection.search_metadata(files, {"$and": [{"category": "de"}, {"source": {"$gte": "src1"}}]}).select("id", "filename")


@query("files", sql="SELECT id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS preview FROM files WHERE category <> 'fr' ORDER BY id LIMIT 100 OFFSET 30")
def collection_page(files: DataFrame) -> DataFrame:
    return collection.list_rows(_rows(files), {"category": {"$ne": "fr"}}, 30).select("id", "preview")


@query("files", sql="SELECT id, filename, upload_date, category, coalesce(source, 'Unknown') AS source FROM files")
def document_listing(files: DataFrame) -> DataFrame:
    return collection.listing(files)


@query("files", sql="SELECT count(*) AS total FROM files")
def document_listing_total(files: DataFrame) -> DataFrame:
    return collection.listing_total(files)


@query("files", sql="SELECT 'files' AS name, count(*) AS document_count, 'active' AS status FROM files")
def collection_stats(files: DataFrame) -> DataFrame:
    return collection.stats(files, "files")


@query("files", sql="SELECT id, filename, category FROM files WHERE contains(lower(filename), 'file1') OR contains(lower(category), 'file1') OR contains(lower(source), 'file1')")
def file_search(files: DataFrame) -> DataFrame:
    return collection.search_files(files, "File1").select("id", "filename", "category")


@query("files", sql="SELECT category, count(*) AS n_files FROM files GROUP BY category")
def files_by_category(files: DataFrame) -> DataFrame:
    return collection.files_by_category(files)


@query("documents", sql="SELECT min(doc_id) AS doc_id, md5(text) AS document_hash, count(*) AS n_copies FROM documents GROUP BY md5(text)")
def exact_deduplication(documents: DataFrame) -> DataFrame:
    return collection.deduplicate(documents).select("doc_id", "document_hash", "n_copies")


@query(
    "repeated",
    sql="""more r AS (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id NULLS LAST, lang, source, n_chars) AS n, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS n_copies FROM repeated)
SELECT coalesce(doc_id, -1) AS doc_id, coalesce(text, 'none') AS text, md5(coalesce(text, '')) AS document_hash, n_copies FROM r WHERE n = 1""",
)
def repeated_deduplication(repeated: DataFrame) -> DataFrame:
    """Deduplication of a table with repeated ids, repeated rows, null ids and null texts."""
    rows = collection.deduplicate(repeated)
    return rows.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.coalesce("text", F.lit("none")).alias("text"), "document_hash", "n_copies")


@query(
    "conversations",
    sql="""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user')
SELECT conv_id, turn, role, substring(text, 1, 80) || '...' AS preview FROM r WHERE n <= 3""",
)
def chat_history(conversations: DataFrame) -> DataFrame:
    return collection.last_messages(conversations, 3, "user")


# Usage ----------------------------------------------------------------------------------------------

_SINCE = "timestamp >= TIMESTAMP '2024-01-01 00:00:00'"


def _mean(column: str, digits: int) -> str:
    return f"round_even(coalesce(avg({column}), 0), {digits})"


@query("query_analytics", sql="SELECT query_id, avg_similarity_score, avg_similarity_score AS max_similarity_score, processing_time FROM query_analytics")
def query_log(query_analytics: DataFrame) -> DataFrame:
    rows = query_analytics.withColumn("scores", F.array("avg_similarity_score")).drop("avg_similarity_score")
    older = rows.withColumns({"seq": F.lit(-1).cast("long"), "processing_time": F.lit(-1.0)})
    return analytics.query_log(rows.unionByName(older)).select("query_id", "avg_similarity_score", "max_similarity_score", "processing_time")


@query("document_analytics", sql="SELECT document_id, file_size, CAST(0 AS BIGINT) AS query_count FROM document_analytics")
def document_log(document_analytics: DataFrame) -> DataFrame:
    rows = document_analytics.withColumn("seq", F.lit(1))
    return analytics.document_log(rows.unionByName(rows.withColumns({"seq": F.lit(0), "file_size": F.lit(0).cast("long")}))).select("document_id", "file_size", "query_count")


@query("user_activity", sql="SELECT user_id, activity_type, '{\"k\":\"' || regexp_extract(activity_data, '([0-9]+)', 1) || '\"}' AS activity_data, count(*) AS n FROM user_activity GROUP BY ALL")
def activity_log(user_activity: DataFrame) -> DataFrame:
    rows = user_activity.withColumn("payload", F.from_json("activity_data", "map<string,string>")).drop("activity_data")
    return analytics.activity_rows(rows, "payload").groupBy("user_id", "activity_type", "activity_data").agg(F.count(F.lit(1)).alias("n"))


@query("system_performance", sql="SELECT timestamp, cpu_usage, error_rate, 0.0E0 AS storage_usage FROM system_performance")
def performance_log(system_performance: DataFrame) -> DataFrame:
    metrics = F.create_map(F.lit("cpu_usage"), F.col("cpu_usage"), F.lit("error_rate"), F.col("error_rate"))
    return analytics.performance_rows(system_performance.select("timestamp", metrics.alias("metrics"))).select("timestamp", "cpu_usage", "error_rate", "storage_usage")


@query(
    "query_analytics",
    sql=f"SELECT count(*) AS total_queries, {_mean('processing_time', 3)} AS avg_processing_time, {_mean('avg_similarity_score', 3)} AS avg_similarity_score, count(DISTINCT user_id) AS unique_users FROM query_analytics WHERE {_SINCE}",
)
def query_stats(query_analytics: DataFrame) -> DataFrame:
    return analytics.query_stats(query_analytics, AS_OF)


@query(
    "document_analytics",
    sql=f"""SELECT count(*) AS total_documents, {_mean('file_size', 0)} AS avg_file_size, {_mean('chunks_created', 1)} AS avg_chunks, {_mean('processing_time', 3)} AS avg_processing_time,
  {_mean('legal_complexity', 3)} AS avg_complexity FROM document_analytics WHERE upload_{_SINCE}""",
)
def document_stats(document_analytics: DataFrame) -> DataFrame:
    return analytics.document_stats(document_analytics, AS_OF)


@query("query_analytics", sql=f"SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM query_analytics WHERE {_SINCE} GROUP BY 1")
def daily_queries(query_analytics: DataFrame) -> DataFrame:
    return analytics.daily_queries(query_analytics, AS_OF)


@query("query_analytics", sql=f"SELECT query_type, count(*) AS n FROM query_analytics WHERE {_SINCE} GROUP BY 1 ORDER BY n DESC, query_type LIMIT 10")
def top_query_types(query_analytics: DataFrame) -> DataFrame:
    return analytics.top_query_types(query_analytics, AS_OF)


@query("system_performance", sql=f"SELECT {_mean('avg_response_time', 3)} AS avg_response_time, {_mean('error_rate', 3)} AS avg_error_rate, {_mean('query_throughput', 2)} AS avg_throughput FROM system_performance WHERE {_SINCE}")
def system_averages(system_performance: DataFrame) -> DataFrame:
    return analytics.system_averages(system_performance, AS_OF)


_LATENCY = "CASE WHEN processing_time < 0.1 THEN 'very_fast' WHEN processing_time < 0.5 THEN 'fast' WHEN processing_time < 1.0 THEN 'moderate' WHEN processing_time < 2.0 THEN 'slow' ELSE 'very_slow' END"
_QUALITY = "CASE WHEN avg_similarity_score >= 0.8 THEN 'excellent' WHEN avg_similarity_score >= 0.6 THEN 'good' WHEN avg_similarity_score >= 0.4 THEN 'fair' WHEN avg_similarity_score >= 0.2 THEN 'poor' ELSE 'very_poor' END"


@query("query_analytics", sql=f"SELECT {_LATENCY} AS category, count(*) AS n, round_even(avg(processing_time), 3) AS avg_time FROM query_analytics GROUP BY 1")
def latency_distribution(query_analytics: DataFrame) -> DataFrame:
    return analytics.latency_distribution(query_analytics)


@query(
    "query_analytics",
    sql="""SELECT query_id, CASE WHEN length(query_text) > 100 THEN substring(query_text, 1, 100) || '...' ELSE query_text END AS query, round_even(processing_time, 3) AS processing_time,
  round_even(coalesce(avg_similarity_score, 0), 3) AS similarity_score FROM query_analytics q ORDER BY q.processing_time DESC, query_id LIMIT 10""",
)
def slowest_queries(query_analytics: DataFrame) -> DataFrame:
    return analytics.slowest_queries(query_analytics)


@query("query_analytics", sql=f"SELECT {_QUALITY} AS category, count(*) AS n FROM query_analytics WHERE avg_similarity_score IS NOT NULL GROUP BY 1")
def quality_distribution(query_analytics: DataFrame) -> DataFrame:
    return analytics.quality_distribution(query_analytics)


@query(
    "query_analytics",
    sql="""more a AS (SELECT count(*) FILTER (processing_time >= 1.0) * 100.0E0 / count(*) AS slow, count(*) FILTER (avg_similarity_score < 0.4) * 100.0E0 / nullif(count(avg_similarity_score), 0) AS poor,
  least(count(*), 10) AS listed FROM query_analytics),
t AS (SELECT list_filter([CASE WHEN slow > 20 THEN 'Consider optimizing query processing - over 20% of queries are slow' END, CASE WHEN slow > 10 THEN 'Review document chunking strategy to improve retrieval speed' END,
  CASE WHEN poor > 30 THEN 'Improve document preprocessing to enhance similarity matching' END, CASE WHEN poor > 15 THEN 'Consider expanding legal vocabulary for better semantic understanding' END,
  CASE WHEN listed > 5 THEN 'Implement query caching for frequently asked questions' END, CASE WHEN listed > 5 THEN 'Consider pre-computing embeddings for common query patterns' END], lambda x: x IS NOT NULL) AS told FROM a)
SELECT CASE WHEN len(told) > 0 THEN array_to_string(told, '; ') ELSE 'System performance is good - consider adding more documents for better coverage; Monitor user feedback to identify areas for improvement' END AS suggestions FROM t""",
)
def optimisation_advice(query_analytics: DataFrame) -> DataFrame:
    return analytics.suggestions(query_analytics).select(F.array_join("suggestions", "; ").alias("suggestions"))


@query("user_activity", sql=f"SELECT count(DISTINCT user_id) AS active_users FROM user_activity WHERE {_SINCE}")
def active_users(user_activity: DataFrame) -> DataFrame:
    return analytics.active_users(user_activity, AS_OF)


@query("user_activity", sql=f"SELECT activity_type, count(*) AS n FROM user_activity WHERE {_SINCE} GROUP BY 1")
def activity_types(user_activity: DataFrame) -> DataFrame:
    return analytics.activity_types(user_activity, AS_OF)


@query("user_activity", sql=f"SELECT lpad(CAST(hour(timestamp) AS VARCHAR), 2, '0') || ':00' AS hour, count(*) AS n FROM user_activity WHERE {_SINCE} GROUP BY 1")
def hourly_profile(user_activity: DataFrame) -> DataFrame:
    return analytics.hourly_profile(user_activity, AS_OF)


@query("user_activity", sql=f"SELECT user_id, count(*) AS n FROM user_activity WHERE {_SINCE} GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_users(user_activity: DataFrame) -> DataFrame:
    return analytics.top_users(user_activity, AS_OF)


@query(
    "document_analytics",
    "query_analytics",
    sql="""more live AS (SELECT document_id, upload_timestamp AS a, lead(upload_timestamp, 3) OVER (ORDER BY upload_timestamp, document_id) AS b FROM document_analytics)
SELECT document_id, count(*) AS query_count, round(sum(avg_similarity_score), 6) AS total_similarity_score, max(timestamp) AS last_queried,
  round(avg(avg_similarity_score), 6) AS avg_similarity_score
FROM live JOIN query_analytics ON timestamp >= a AND (b IS NULL OR timestamp < b) GROUP BY document_id""",
)
def document_usage(document_analytics: DataFrame, query_analytics: DataFrame) -> DataFrame:
    used = analytics.document_usage(document_analytics, query_analytics.withColumn("score", F.col("avg_similarity_score")))
    rounded = {c: F.round(c, 6) for c in ("total_similarity_score", "avg_similarity_score")}
    return used.withColumns(rounded)


@query(
    "system_performance",
    sql="""SELECT round_even(coalesce(avg(cpu_usage), 0), 2) AS avg_cpu_usage, round_even(coalesce(avg(memory_usage), 0), 2) AS avg_memory_usage, round_even(coalesce(avg(error_rate), 0), 4) AS avg_error_rate,
  CASE WHEN coalesce(avg(cpu_usage), 0) < 80 AND coalesce(avg(error_rate), 0) < 0.05 THEN 'healthy' ELSE 'warning' END AS status
FROM system_performance WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00'""",
)
def system_health(system_performance: DataFrame) -> DataFrame:
    return analytics.health(system_performance, AS_OF)


@query("query_analytics", "user_activity", sql="SELECT 'queries' AS \"table\", count(*) FILTER (timestamp < TIMESTAMP '2024-01-16 00:00:00') AS deleted FROM query_analytics UNION ALL SELECT 'activity', count(*) FILTER (timestamp < TIMESTAMP '2024-01-16 00:00:00') FROM user_activity")
def retention(query_analytics: DataFrame, user_activity: DataFrame) -> DataFrame:
    return analytics.retired_counts({"queries": query_analytics, "activity": user_activity}, AS_OF, 15)


@query("user_activity", sql="SELECT user_id, count(*) FILTER (activity_type = 'view') AS queries, count(*) FILTER (activity_type = 'purchase') AS documents_uploaded, max(timestamp) AS last_active FROM user_activity GROUP BY user_id")
def user_summary(user_activity: DataFrame) -> DataFrame:
    return analytics.user_summary(user_activity, ("view",), ("purchase",))


@query(
    "user_activity",
    sql="""more s AS (SELECT session_id, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 60e6 AS m, count(*) FILTER (activity_type = 'view') AS q FROM user_activity GROUP BY session_id)
SELECT count(*) AS sessions, round_even(avg(m), 2) AS avg_session_minutes, round_even(avg(q), 3) AS avg_queries_per_session FROM s""",
)
def session_engagement(user_activity: DataFrame) -> DataFrame:
    return analytics.engagement(user_activity, ("view",))


@query(
    "user_activity",
    sql="""more h AS (SELECT 'hour' AS kind, lpad(CAST(hour(timestamp) AS VARCHAR), 2, '0') || ':00' AS label, count(*) AS n FROM user_activity GROUP BY ALL
  UNION ALL SELECT 'weekday', dayname(timestamp), count(*) FROM user_activity GROUP BY ALL),
r AS (SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) AS rank, label, n FROM h)
SELECT kind, CAST(rank AS INT) AS rank, label, n FROM r WHERE rank <= 3""",
)
def peak_times(user_activity: DataFrame) -> DataFrame:
    return analytics.peak_times(user_activity)


@query("query_analytics", sql="SELECT lpad(CAST(CAST(floor(hour(timestamp) / 6) * 6 AS INT) AS VARCHAR), 2, '0') || ':00' AS slot, count(*) AS n, round_even(avg(processing_time), 3) AS avg_time FROM query_analytics GROUP BY 1")
def day_slots(query_analytics: DataFrame) -> DataFrame:
    return analytics.slots(query_analytics)


@query("documents", sql=f"more {CHUNKS_SQL} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks, round_even(count(*) / count(DISTINCT doc_id), 2) AS chunks_per_document FROM named")
def corpus_totals(documents: DataFrame) -> DataFrame:
    return analytics.corpus_totals(_chunks(documents))


@query(
    "query_analytics",
    "document_analytics",
    "user_activity",
    "system_performance",
    "chunk_vectors",
    sql=f"""{PAIRS_SQL}, w AS (SELECT * FROM query_analytics WHERE {_SINCE}), u AS (SELECT * FROM user_activity WHERE {_SINCE})
SELECT (SELECT count(*) FROM w) AS total_queries, (SELECT count(DISTINCT user_id) FROM w) AS unique_users, (SELECT count(*) FROM document_analytics WHERE upload_{_SINCE}) AS total_documents,
  CAST((SELECT count(DISTINCT CAST(timestamp AS DATE)) FROM w) AS INT) AS days, CAST((SELECT least(count(DISTINCT query_type), 10) FROM w) AS INT) AS query_types,
  (SELECT {_mean('avg_response_time', 3)} FROM system_performance WHERE {_SINCE}) AS avg_response_time, CAST((SELECT count(DISTINCT {_LATENCY}) FROM query_analytics) AS INT) AS latencies,
  (SELECT query_id FROM (SELECT query_id, processing_time FROM query_analytics ORDER BY processing_time DESC, query_id LIMIT 10) ORDER BY round_even(processing_time, 3) DESC, query_id LIMIT 1) AS slowest, CAST((SELECT count(DISTINCT {_QUALITY}) FROM query_analytics WHERE avg_similarity_score IS NOT NULL) AS INT) AS qualities,
  (SELECT count(*) FROM pairs) AS total_comparisons, CAST((SELECT least(count(*), 20) FROM alike WHERE similarity_score > 0.7) AS INT) AS similar_pairs, (SELECT count(DISTINCT user_id) FROM u) AS active_users,
  CAST((SELECT count(DISTINCT activity_type) FROM u) AS INT) AS activity_types, CAST((SELECT count(DISTINCT hour(timestamp)) FROM u) AS INT) AS hours, CAST((SELECT least(count(DISTINCT user_id), 10) FROM u) AS INT) AS top_users,
  (SELECT CASE WHEN coalesce(avg(cpu_usage), 0) < 80 AND coalesce(avg(error_rate), 0) < 0.05 THEN 'healthy' ELSE 'warning' END FROM system_performance WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00') AS status""",
)
def analytics_report(queries: DataFrame, documents: DataFrame, activity: DataFrame, performance: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """What the parts of the report say, read back from their JSON."""
    docs = _centroids(chunk_vectors)
    report = analytics.report(queries, documents, activity, performance, docs, settle(similarity.similar_documents(docs, 0.25), "pairs"), AS_OF)
    told = lambda part, key, kind: F.get_json_object(part, f"$.{key}").cast(kind)
    size = F.json_array_length
    slowest = F.array_min(F.transform(F.from_json("slowest", "array<struct<query_id:string,processing_time:double>>"), lambda x: F.struct((-x["processing_time"]).alias("t"), x["query_id"].alias("q"))))
    return report.select(
        told("query_stats", "total_queries", "long").alias("total_queries"), told("query_stats", "unique_users", "long").alias("unique_users"), told("document_stats", "total_documents", "long").alias("total_documents"),
        size("daily_queries").alias("days"), size("query_types").alias("query_types"), told("system", "avg_response_time", "double").alias("avg_response_time"), size("latency").alias("latencies"),
        slowest["q"].alias("slowest"),
        size("quality").alias("qualities"), told("similarity", "total_comparisons", "long").alias("total_comparisons"), size("similar_pairs").alias("similar_pairs"), told("active_users", "active_users", "long").alias("active_users"),
        size("activity_types").alias("activity_types"), size("hours").alias("hours"), size("top_users").alias("top_users"), told("health", "status", "string").alias("status"),
    )
