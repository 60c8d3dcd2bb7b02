"""Page text of documents: sufficiency, extraction status, page furniture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions.text import meaningful_chars

#: A page with fewer ASCII letters and digits than this needs OCR.
LEAST_CHARS = 60


def text_sufficiency(page_text: DataFrame) -> DataFrame:
    """document_id, page_number, meaningful, needs_ocr."""
    m = meaningful_chars(F.coalesce("text", F.lit("")))
    return page_text.select("document_id", "page_number", m.alias("meaningful"), (m < LEAST_CHARS).alias("needs_ocr"))


def extraction_status(page_text: DataFrame) -> DataFrame:
    """document_id, pages, chars, method, status of each document."""
    p = page_text.withColumn("m", meaningful_chars(F.coalesce("text", F.lit(""))))
    g = p.groupBy("document_id").agg(F.count("*").alias("pages"), F.sum(F.length("text")).alias("chars"), F.bool_or(F.col("m") < LEAST_CHARS).alias("ocr"), F.sum("m").alias("m"))
    status = F.when(F.col("ocr") & (F.col("m") > 0), "OCR_USED").when(F.col("ocr"), "OCR_FAILED").when(F.col("m") > 0, "TEXT_FOUND").otherwise("NO_TEXT")
    return g.select("document_id", "pages", "chars", F.when(F.col("ocr"), "ocr").otherwise("text").alias("method"), status.alias("status"))


def page_furniture(page_text: DataFrame) -> DataFrame:
    """document_id, pages, repeats_header, numbers_pages.

    A header repeats when at least half of the later pages open with the first page's line; pages are numbered when at
    least seven in ten end with a number.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = page_text.select("document_id", "page_number", F.get(lines, 0).alias("head"), F.try_element_at(lines, F.lit(-1)).alias("foot"))
    first = p.where("page_number = 1").select(F.col("document_id").alias("d"), F.col("head").alias("header"))
    g = p.join(first, F.col("document_id") == F.col("d")).groupBy("document_id").agg(
        F.count("*").alias("pages"),
        F.avg(F.when(F.col("page_number") > 1, F.coalesce(F.col("head") == F.col("header"), F.lit(False)).cast("int"))).alias("same"),
        F.avg(F.coalesce(F.col("foot").rlike(r"\d+$"), F.lit(False)).cast("int")).alias("numbered"),
    )
    return g.select("document_id", "pages", F.coalesce(F.col("same") >= 0.5, F.lit(False)).alias("repeats_header"), (F.col("numbered") >= 0.7).alias("numbers_pages"))
