"""Corpus store: reading, writing, validation, upsert and deletion as table operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronlake.functions.text import canonical_scope

#: What follows one another in a structured document; other columns of the file are not read.
ELEMENT_SCHEMA = "document_id string, pages array<struct<page_number int, width double, height double>>, elements array<struct<element_id string, page_number int, type string, text string, heading_level int, bbox array<double>, heading_path array<string>, meta map<string,string>>>"


def read_structured_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(elements in reading order, pages) of JSON documents; elements without text go unless they are pictures."""
    docs = spark.read.schema(ELEMENT_SCHEMA).option("multiLine", True).json(path)
    elements = docs.select("document_id", F.posexplode("elements").alias("ord", "e")).select("document_id", "ord", "e.*")
    elements = elements.where((F.trim(F.coalesce("text", F.lit(""))) != "") | (F.col("type") == "picture"))
    pages = docs.select("document_id", F.explode("pages").alias("p")).select("document_id", "p.*")
    return elements, pages


def complete_pages(page_text: DataFrame) -> DataFrame:
    """document_id, page_number, text for pages 1..last of each document; a missing page is empty."""
    last = page_text.groupBy("document_id").agg(F.max("page_number").alias("n"))
    grid = last.select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("page_number"))
    return grid.join(page_text.select("document_id", "page_number", "text"), ["document_id", "page_number"], "left").select("document_id", "page_number", F.coalesce("text", F.lit("")).alias("text"))


def scoped(chunks: DataFrame, class_: str, subject: str, unit: str | None = None, corpus: str = "syllabus") -> DataFrame:
    """Rows of one scope, without vectors. Class and subject are compared in canonical form, the unit exactly."""
    rows = chunks.where((F.col("corpus") == corpus) & (canonical_scope(F.col("class")) == canonical_scope(F.lit(class_))) & (canonical_scope(F.col("subject")) == canonical_scope(F.lit(subject))))
    return (rows if unit is None else rows.where(F.col("unit") == unit)).drop("embedding")


def write_corpus(df: DataFrame, path: str) -> None:
    """Partitioned by scope; sorted within files so that unit and hash filters skip row groups."""
    df.repartition("corpus", "class", "subject").sortWithinPartitions("unit", "source_hash").write.partitionBy("corpus", "class", "subject").mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def validate_points(df: DataFrame, dimension: int | None = None) -> DataFrame:
    """``df`` with reason: null if valid, else the first of empty_text, empty_vector, non_finite, dimension_mismatch.

    The batch's dimension is that of its first otherwise valid row by chunk_index; if a collection ``dimension`` is given
    and differs, the batch is refused with an error.
    """
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text").when(v.isNull() | (F.size(v) == 0), "empty_vector").when(~finite, "non_finite")
    first = df.withColumn("_r", base).where("_r IS NULL").agg(F.min_by(F.size("embedding"), "chunk_index").alias("dim"))
    if dimension is not None:
        wrong = F.col("dim") != dimension
        first = first.select(F.when(wrong, F.raise_error(F.lit("vector dimension differs from the collection's"))).otherwise(F.col("dim")).alias("dim"))
    # one row
    return df.crossJoin(F.broadcast(first)).withColumn("reason", F.coalesce(base, F.when(F.size(v) != F.col("dim"), "dimension_mismatch"))).drop("dim")


def upsert(base: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both by ``key``; a new row replaces an old one, and of new rows the latest by ``order`` wins.

    Of equally late ones it is the greatest by the other columns of ``base`` in turn; maps, which have no order, do not count.
    """
    both = base.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    rest = [f.name for f in base.schema.fields if f.name not in (*key, order) and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    w = Window.partitionBy(*key).orderBy(F.desc("_src"), F.desc(order), *[F.desc(c) for c in rest])
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_src", "_k")


def skip_already_ingested(incoming: DataFrame, corpus: DataFrame, by: list[str]) -> DataFrame:
    """``incoming`` with reused, existing_id and existing_chunks: whether its hash is stored under the same ``by``."""
    have = corpus.groupBy(*by).agg(F.min("document_id").alias("existing_id"), F.count("*").alias("existing_chunks"))
    return incoming.join(have, by, "left").withColumn("reused", F.col("existing_chunks").isNotNull()).withColumn("existing_chunks", F.coalesce("existing_chunks", F.lit(0)))


def delete_document(df: DataFrame, document_id: str, source_hash: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with removed): rows whose provenance names the document or has its hash go."""
    gone = F.col("source_document_id") == document_id
    if source_hash is not None:
        gone = gone | (F.col("source_hash") == source_hash)
    gone = F.coalesce(gone, F.lit(False))
    return df.where(~gone), df.agg(F.count_if(gone).alias("removed"))


def canonicalize_stored_scopes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with canonical class and subject, one row with scanned and rewritten)."""
    c, s = canonical_scope(F.col("class")), canonical_scope(F.col("subject"))
    changed = ~(c.eqNullSafe(F.col("class")) & s.eqNullSafe(F.col("subject")))
    return df.withColumn("class", c).withColumn("subject", s), df.agg(F.count("*").alias("scanned"), F.count_if(changed).alias("rewritten"))


def freshness_keys(chunks: DataFrame) -> DataFrame:
    """class, subject, cache_key: the sorted distinct source hashes of each scope."""
    return chunks.groupBy("class", "subject").agg(F.array_join(F.sort_array(F.collect_set("source_hash")), ",").alias("cache_key"))


def stale_scopes(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Scopes whose key is not the stored one."""
    return freshness_keys(chunks).join(stored, ["class", "subject", "cache_key"], "left_anti").select("class", "subject")


def write_json_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
