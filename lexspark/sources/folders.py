"""Documents from folders of files, and from tables of extracted pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.text import strip

#: Content types by file ending (fixed values).
TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain",
}
OLD_WORD = "application/msword"


def content_type(path: Column, declared: Column | None = None) -> Column:
    """The type by the file's ending, else the declared one."""
    out = declared if declared is not None else F.lit("application/octet-stream")
    for end, kind in TYPES.items():
        out = F.when(F.lower(path).endswith(end), kind).otherwise(out)
    return F.when(F.lower(path).endswith(".doc"), OLD_WORD).otherwise(out) if declared is None else out


def sort_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of files with path, content and perhaps a declared type; rejected has a reason."""
    declared = F.col("declared_type") if "declared_type" in files.columns else None
    rows = files.withColumn("content_type", content_type(F.col("path"), declared))
    reason = F.when(F.col("content_type") == OLD_WORD, "Legacy DOC format not yet supported. Please convert to DOCX or PDF.").when(
        ~F.col("content_type").isin(*TYPES.values()), F.concat(F.lit("Unsupported file type: "), F.col("content_type"))
    )
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").drop("content")


def read_folder(spark: SparkSession, path: str, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files of a folder, by path, modificationTime, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return sort_files(files)


def decode_texts(files: DataFrame) -> DataFrame:
    """files with text and encoding_used: UTF-8 where the bytes are valid, else latin-1."""
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.withColumns({"text": text, "encoding_used": F.when(utf8, "utf-8").otherwise("latin-1")})


def assemble_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, text, page_count) of pages (doc_id, page, text): blank pages count but are left out.

    A document's pages meet in one row, as its text does.
    """
    per = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("p"), F.count(F.lit(1)).alias("page_count"))
    kept = F.filter("p", lambda x: strip(F.coalesce(x["text"], F.lit(""))) != "")
    told = F.transform(kept, lambda x: F.concat(F.lit("[Page "), x["page"].cast("string"), F.lit("]\n"), x["text"]))
    return per.select("doc_id", F.array_join(told, "\n\n").alias("text"), "page_count")


def check_extraction(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad texts are still raw PDF; good ones say whether they are too short (too_short)."""
    raw = F.coalesce(F.col("text").startswith("%PDF"), F.lit(False))
    short = F.length(strip(F.coalesce("text", F.lit("")))) < 10
    return docs.filter(~raw).withColumn("too_short", short), docs.filter(raw).withColumn("reason", F.lit("text is raw PDF data"))
