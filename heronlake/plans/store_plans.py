"""Queries of the corpus store (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.sources import store as S
from heronlake.sources.staging import shared_path as _scratch
from heronlake.plans.base import query
from heronlake.plans.tables import chunks, edges, library, nodes, page_text, table, with_tables


@query("s01_read_structured_documents", sql="""
    SELECT 'd' || doc_id AS document_id, CAST(u.i - 1 AS INTEGER) AS ord, CASE WHEN u.i = 1 THEN 'picture' ELSE 'paragraph' END AS type, CASE WHEN u.i = 1 THEN '' ELSE l[u.i] END AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i) WHERE u.i = 1 OR trim(l[u.i]) <> ''""")
def s01(spark, sf):
    lines = F.split("text", "\n")
    e = F.transform(lines, lambda x, i: F.struct(i.cast("string").alias("element_id"), F.lit(1).alias("page_number"), F.when(i == 0, "picture").otherwise("paragraph").alias("type"), F.when(i == 0, "").otherwise(x).alias("text")))
    path = _scratch(spark, "structured")
    table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), F.array(F.struct(F.lit(1).alias("page_number"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))).alias("pages"), e.alias("elements")).write.json(path)
    docs = spark.read.schema(S.ELEMENT_SCHEMA).json(path)
    elements = docs.select("document_id", F.posexplode("elements").alias("ord", "e")).select("document_id", "ord", "e.type", "e.text")
    return elements.where((F.trim("text") != "") | (F.col("type") == "picture"))


@query("s02_read_page_text", sql=with_tables("page_text", then="SELECT document_id, page_number, CASE WHEN page_number % 3 = 2 AND page_number < max(page_number) OVER (PARTITION BY document_id) THEN '' ELSE text END AS text FROM page_text"))
def s02(spark, sf):
    p = page_text(spark, sf)
    last = p.groupBy("document_id").agg(F.max("page_number").alias("n"))
    holes = p.join(last, "document_id").where("page_number % 3 <> 2 OR page_number = n").select("document_id", "page_number", "text")
    return S.complete_pages(holes)


@query("s03_read_corpus_scope", sql=with_tables("chunks", then="SELECT chunk_id, unit, source_hash, text FROM chunks WHERE corpus = 'syllabus' AND class = 'en' AND subject = 'src3' AND unit = 'U4'"))
def s03(spark, sf):
    return S.scoped(chunks(spark, sf), " EN ", "Src3", "U4").select("chunk_id", "unit", "source_hash", "text")


@query("s04_write_corpus", sql=with_tables("chunks", then="SELECT class, subject, count(*) AS n, count(DISTINCT source_hash) AS hashes, count(embedding) AS vectors FROM chunks GROUP BY class, subject"))
def s04(spark, sf):
    path = _scratch(spark, "corpus")
    S.write_corpus(chunks(spark, sf), path)
    return S.read_corpus(spark, path).groupBy("class", "subject").agg(F.count("*").alias("n"), F.countDistinct("source_hash").alias("hashes"), F.count("embedding").alias("vectors"))


@query("s05_validate_points", sql=with_tables("chunks", then="""
    SELECT chunk_id, CASE WHEN doc_id % 13 = 0 THEN 'empty_text' WHEN embedding IS NULL OR doc_id % 11 = 0 THEN 'empty_vector' WHEN doc_id % 7 = 0 THEN 'non_finite' WHEN doc_id % 5 = 0 THEN 'dimension_mismatch' END AS reason FROM chunks"""))
def s05(spark, sf):
    i = F.col("doc_id")
    broken = chunks(spark, sf).withColumn("text", F.when(i % 13 == 0, "  ").otherwise(F.col("text")))
    v = F.when(i % 11 == 0, F.array().cast("array<float>")).when(i % 7 == 0, F.transform("embedding", lambda x, k: F.when(k == 3, F.lit(float("nan")).cast("float")).otherwise(x))).when(i % 5 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    return S.validate_points(broken.withColumn("embedding", v)).select("chunk_id", "reason")


@query("s07_upsert", sql="""
    WITH b AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_shipdate) AS d FROM lineitem GROUP BY ALL),
    s AS (SELECT l_orderkey + CASE WHEN l_orderkey % 13 = 0 THEN 1000000 ELSE 0 END AS l_orderkey, l_linenumber, q + 100 AS q, d FROM b WHERE l_orderkey % 7 = 0 OR l_orderkey % 13 = 0),
    n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY d DESC NULLS LAST, q DESC NULLS LAST) = 1)
    SELECT coalesce(n.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(n.l_linenumber, b.l_linenumber) AS l_linenumber, coalesce(n.q, b.q) AS q FROM b FULL JOIN n ON b.l_orderkey = n.l_orderkey AND b.l_linenumber = n.l_linenumber""")
def s07(spark, sf):
    base = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_shipdate").alias("d"))
    shifted = F.col("l_orderkey") + F.when(F.col("l_orderkey") % 13 == 0, 1000000).otherwise(0)
    new = base.where("l_orderkey % 7 = 0 OR l_orderkey % 13 = 0").withColumn("l_orderkey", shifted).withColumn("q", F.col("q") + 100)
    return S.upsert(base, new.union(new), ["l_orderkey", "l_linenumber"], "d").select("l_orderkey", "l_linenumber", "q")


@query("s08_skip_already_ingested", sql=with_tables("chunks", then="""
    , h AS (SELECT source_hash, class, subject, unit, min(chunk_id) AS existing_id, count(*) AS existing_chunks FROM chunks WHERE doc_id % 3 <> 0 GROUP BY ALL),
    i AS (SELECT DISTINCT source_hash, class, subject, unit FROM chunks)
    SELECT i.*, h.existing_id IS NOT NULL AS reused, h.existing_id, coalesce(h.existing_chunks, 0) AS existing_chunks FROM i LEFT JOIN h USING (source_hash, class, subject, unit)"""))
def s08(spark, sf):
    c = chunks(spark, sf)
    by = ["source_hash", "class", "subject", "unit"]
    return S.skip_already_ingested(c.select(*by).distinct(), c.where("doc_id % 3 <> 0").withColumnRenamed("chunk_id", "document_id"), by).select(*by, "reused", "existing_id", "existing_chunks")


@query("s09_delete_document", sql=with_tables("nodes", "edges", then="""
    SELECT (SELECT count(*) FROM nodes WHERE source_document_id <> 'r1') AS nodes_left, (SELECT count(*) FROM nodes WHERE source_document_id = 'r1') AS nodes_removed,
      (SELECT count(*) FROM edges WHERE source_document_id <> 'r1') AS edges_left, (SELECT count(*) FROM edges WHERE source_document_id = 'r1') AS edges_removed"""))
def s09(spark, sf):
    out = None
    for name, df in (("nodes", nodes(spark, sf)), ("edges", edges(spark, sf))):
        left, gone = S.delete_document(df, "r1")
        row = left.agg(F.count("*").alias(f"{name}_left")).crossJoin(gone.withColumnRenamed("removed", f"{name}_removed"))  # one row each
        out = row if out is None else out.crossJoin(row)
    return out


@query("s10_canonicalize_scopes", sql="SELECT count(*) AS scanned, count(*) AS rewritten, 0 AS rewritten_again, count(DISTINCT lower(trim(c_mktsegment))) AS subjects FROM customer")
def s10(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("class"), F.concat("c_mktsegment", F.lit(" ")).alias("subject"))
    once, stats = S.canonicalize_stored_scopes(c)
    _, again = S.canonicalize_stored_scopes(once)
    return stats.crossJoin(again.select(F.col("rewritten").alias("rewritten_again"))).crossJoin(once.agg(F.countDistinct("subject").alias("subjects")))  # one row each


@query("s11_index_freshness", sql=with_tables("chunks", then="""
    , a AS (SELECT class, subject, string_agg(DISTINCT source_hash, ',' ORDER BY source_hash) AS k FROM chunks GROUP BY ALL),
    b AS (SELECT class, subject, string_agg(DISTINCT source_hash, ',' ORDER BY source_hash) AS k FROM chunks WHERE doc_id % 100 <> 7 GROUP BY ALL)
    SELECT a.class, a.subject FROM a LEFT JOIN b USING (class, subject, k) WHERE b.class IS NULL"""))
def s11(spark, sf):
    c = chunks(spark, sf)
    return S.stale_scopes(c, S.freshness_keys(c.where("doc_id % 100 <> 7")))


@query("s12_json_tables", sql=with_tables("library", then="SELECT id, title, class, subject, total_marks, status FROM library"))
def s12(spark, sf):
    df = library(spark, sf).select("id", "title", "class", "subject", "total_marks", "status")
    path = _scratch(spark, "library")
    S.write_json_table(df, path)
    return S.read_json_table(spark, path, df.schema)
