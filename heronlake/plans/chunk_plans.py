"""Queries of sectioning and chunking (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import chunking as C
from heronlake.plans.base import query
from heronlake.plans.tables import table


def _docs(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")


def _elements(spark, sf):
    """Lines as elements: every sixth a heading of level 1 to 3, and runs of list items."""
    e = _docs(spark, sf).select("document_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    kind = F.when(F.col("ord") % 6 == 1, "heading").when(F.col("ord") % 6 > 3, "list_item").otherwise("paragraph")
    return e.select("document_id", "ord", kind.alias("type"), F.when(kind == "heading", F.concat(F.lit("H"), F.col("ord").cast("string"))).otherwise(F.col("line")).alias("text"), F.when(kind == "heading", (F.col("ord") % 3 + 1).cast("int")).alias("heading_level"), (F.floor(F.col("ord") / 10) + 1).cast("int").alias("page_number"))


_EL = "el AS (SELECT doc_id AS document_id, CAST(u.i - 1 AS INTEGER) AS ord, CASE WHEN (u.i - 1) % 6 = 1 THEN 'heading' WHEN (u.i - 1) % 6 > 3 THEN 'list_item' ELSE 'paragraph' END AS type, CASE WHEN (u.i - 1) % 6 = 1 THEN 'H' || (u.i - 1) ELSE l[u.i] END AS text, CASE WHEN (u.i - 1) % 6 = 1 THEN (u.i - 1) % 3 + 1 END AS level, CAST((u.i - 1) // 10 + 1 AS INTEGER) AS page_number FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)), se AS (SELECT *, CAST(sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ord) AS BIGINT) AS section_id FROM el)"
_BL = ", bk AS (SELECT *, CAST(sum(n) OVER (PARTITION BY document_id ORDER BY ord) AS BIGINT) AS block FROM (SELECT *, CASE WHEN type = 'list_item' AND coalesce(lag(type) OVER (PARTITION BY document_id ORDER BY ord) = 'list_item', false) THEN 0 ELSE 1 END AS n FROM se)), bl AS (SELECT document_id, section_id, block, min(type) AS type, min(page_number) AS page_number, string_agg(CASE WHEN type = 'list_item' THEN '- ' || text ELSE text END, chr(10) ORDER BY ord) AS text FROM bk WHERE type <> 'heading' GROUP BY ALL)"


_HEAD = r"^\s*(?:(?i:chapter|lesson|unit|section|topic|module|part)\s+[0-9ivxlcIVXLC]+\b.*|[0-9]+(?:\.[0-9]+)+\s+\p{L}.*|\p{Lu}[\p{Lu}0-9 ,:''&-]{6,80})\s*$"


@query("c01_detect_heading", sql=f"SELECT doc_id AS document_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '{_HEAD}'))[1][1:120] AS heading FROM documents")
def c01(spark, sf):
    return _docs(spark, sf).select("document_id", C.detect_heading(F.col("text")).alias("heading"))


@query("c02_chunk_notes")
def c02(spark, sf):
    return C.chunk_notes(_docs(spark, sf))


@query("c05_plain_text_to_elements")
def c05(spark, sf):
    return C.plain_text_to_elements(_docs(spark, sf))


@query("c06_build_sections", sql=f"WITH {_EL} SELECT document_id, section_id, max(CASE WHEN type = 'heading' THEN text END) AS title, count(*) FILTER (type <> 'heading') AS elements FROM se GROUP BY ALL HAVING count(*) FILTER (type <> 'heading') > 0")
def c06(spark, sf):
    return C.build_sections(_elements(spark, sf))


@query("c07_section_blocks", sql=f"WITH {_EL}{_BL} SELECT * FROM bl")
def c07(spark, sf):
    return C.section_blocks(_elements(spark, sf))


@query("c08_parent_runs")
def c08(spark, sf):
    return C.parent_runs(C.section_blocks(_elements(spark, sf)), 120).select("document_id", "section_id", "block", "run", "n")


@query("c09_child_parts")
def c09(spark, sf):
    return C.child_parts(C.parent_runs(C.section_blocks(_elements(spark, sf)), 240), 60, 15, 20)


@query("c11_emit_parent_child")
def c11(spark, sf):
    return C.emit_parent_child(_elements(spark, sf), 240)


@query("c12_number_chunks", sql="SELECT l_orderkey AS document_id, l_linenumber AS section_id, chunk_type, run, part, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY chunk_type DESC, run, part) - 1 AS chunk_index FROM (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'parent' ELSE 'child' END AS chunk_type, l_partkey AS run, l_suppkey AS part FROM lineitem)")
def c12(spark, sf):
    l = table(spark, sf, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("section_id"), F.when(F.col("l_partkey") % 3 == 0, "parent").otherwise("child").alias("chunk_type"), F.col("l_partkey").alias("run"), F.col("l_suppkey").alias("part")).distinct()
    return C.number_chunks(rows)


@query("c14_heading_path", sql=f"WITH {_EL}, hh AS (SELECT document_id, ord, level, text FROM el WHERE type = 'heading'), pr AS (SELECT e.document_id, e.ord, h.level, h.text, h.ord AS ho FROM el e JOIN hh h ON h.document_id = e.document_id AND h.ord < e.ord WHERE e.level IS NULL OR h.level < e.level), kp AS (SELECT * FROM pr p WHERE NOT EXISTS (SELECT 1 FROM hh q WHERE q.document_id = p.document_id AND q.ord > p.ho AND q.ord < p.ord AND q.level <= p.level)) SELECT e.document_id, e.ord, coalesce(list(k.text ORDER BY k.ho) FILTER (k.text IS NOT NULL), []) AS path FROM el e LEFT JOIN kp k ON k.document_id = e.document_id AND k.ord = e.ord GROUP BY ALL")
def c14(spark, sf):
    return C.heading_path(_elements(spark, sf)).select("document_id", "ord", "path")
