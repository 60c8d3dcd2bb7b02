"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A pattern of the text itself cuts it into chunks, so that the cuts move with the content. Each document becomes an
ordered list of chunk identifiers; documents are equal when the lists are. One scan reads the texts; from then on only
identifiers move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.shared import ascii_lower, free_name, join_skewed, numbered, stage

#: A chunk ends after a blank that follows one of n, r, s, t or a mark, from the 1,024th character on; at 8,192 at the latest.
CHUNK = r"(?s).{1024,8191}?[nrst.,;:!?]\s|.{1,8192}"


def recipes(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, chunks: array of (id, sha, size). ``id`` is short; ``sha`` and ``size`` verify it."""
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("norm"))
    cut = F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))
    return norm.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform(cut, lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("sha"), F.octet_length(c).alias("size"))).alias("chunks"),
    )


def verified_ids(listed: DataFrame) -> DataFrame:
    """Replace ``chunks`` by ``recipe``: an ordered list of identifiers that each stand for one content.

    The dictionary holds each content once. Where a short identifier stands for two contents, the identifier of every
    content that shares it is lengthened by the digest, so lists never agree by a collision.
    """
    seen = listed.select(F.explode("chunks").alias("c")).select("c.id", "c.sha", "c.size").distinct()
    clash = seen.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if clash.isEmpty():
        return listed.select("doc_id", "text_sha256", F.transform("chunks", lambda c: F.struct(c["id"].alias("id"), F.lit(None).cast("binary").alias("sha"))).alias("recipe"))
    touched = listed.select("doc_id", "text_sha256", F.posexplode("chunks").alias("pos", "c")).select("doc_id", "text_sha256", "pos", "c.*")
    marked = touched.join(clash.withColumn("clash", F.lit(True)), "id", "left")
    ident = F.struct("pos", F.struct("id", F.when(F.col("clash"), F.col("sha")).alias("sha")).alias("ident"))
    lists = marked.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(ident)).alias("l"))
    lists = lists.select("doc_id", "text_sha256", F.transform("l", lambda x: x["ident"]).alias("recipe"))
    empty = listed.where(F.size("chunks") == 0).select("doc_id", "text_sha256", F.array().cast(lists.schema["recipe"].dataType).alias("recipe"))
    return lists.unionByName(empty)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Null text counts as empty; the row with the largest doc_id of equal texts stays (null ids sort first). Rows that
    repeat a doc_id are members of their groups; of repeats of the kept id all are marked kept. Empty in, empty out.
    """
    listed = verified_ids(stage(recipes(docs), "recipes"))
    sized = stage(listed.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    member = join_skewed(listed, sized, "recipe", "group_size")
    return member.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each distinct text, all columns kept: the one with the largest doc_id, of repeats any one.

    Null text counts as empty; a row without doc_id stays only where no row of its text has one. Empty in, empty out.
    """
    row = free_name(docs, "_row")
    rows = numbered(docs, row, nulls_first=True)
    kept = groups(rows.select(F.col(row).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias(free_name(docs, "_kept")))
    return rows.join(kept, F.col(row) == F.col(free_name(docs, "_kept")), "left_semi").drop(row)
