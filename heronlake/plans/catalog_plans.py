"""Queries of the corpus catalog and paper library (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import catalog as K
from heronlake.plans.base import query
from heronlake.plans.tables import chunks, library, table, with_tables


@query("k01_list_documents", sql=with_tables("chunks", then="""
    , u AS (SELECT source_hash, unit, min(doc_id) AS f, count(*) AS n, arg_min(source_filename, doc_id) AS title, arg_min(class, doc_id) AS class, arg_min(subject, doc_id) AS subject, max(ingested_at) AS mat FROM chunks GROUP BY ALL)
    SELECT source_hash, arg_min(title, f) AS title, arg_min(class, f) AS class, arg_min(subject, f) AS subject, CAST(sum(n) AS BIGINT) AS chunks, max(mat) AS ingested_at, list(unit || ':' || n ORDER BY f) AS units FROM u GROUP BY source_hash"""))
def k01(spark, sf):
    return K.list_documents(chunks(spark, sf))


@query("k02_list_units", sql=with_tables("chunks", then="SELECT class, subject, unit, count(*) AS chunks FROM chunks GROUP BY ALL"))
def k02(spark, sf):
    return K.list_units(chunks(spark, sf))


@query("k03_list_topics", sql=with_tables("chunks", then="SELECT class, subject, coalesce(chapter, section) AS topic, count(*) AS chunks FROM chunks GROUP BY ALL"))
def k03(spark, sf):
    return K.list_topics(chunks(spark, sf))


@query("k04_unit_has_notes", sql=with_tables("chunks", then="SELECT n_nationkey, EXISTS (SELECT 1 FROM chunks WHERE class = 'en' AND subject = 'src' || n_nationkey AND unit = 'U' || (n_nationkey % 6)) AS has_notes FROM nation"))
def k04(spark, sf):
    k = F.col("n_nationkey")
    pairs = table(spark, sf, "nation").select("n_nationkey", F.lit(" EN").alias("class"), F.concat(F.lit("SRC"), k.cast("string")).alias("subject"), F.concat(F.lit("U"), (k % 6).cast("string")).alias("unit"))
    return K.unit_has_notes(pairs, chunks(spark, sf)).select("n_nationkey", "has_notes")


@query("k05_search_documents", sql=with_tables("chunks", then="""
    , u AS (SELECT source_hash, arg_min(source_filename, doc_id) AS title FROM chunks WHERE class = 'en' GROUP BY source_hash) SELECT source_hash, title FROM u WHERE contains(title, 'src1')"""))
def k05(spark, sf):
    docs = K.list_documents(chunks(spark, sf).where("class = 'en'"))
    return K.search_documents(docs.withColumn("units", F.array().cast("array<string>")), " SRC1", "EN").select("source_hash", "title")


@query("k06_merge_units", sql="SELECT * FROM (SELECT 'Unit ' || n_nationkey AS unit, 'document' AS source FROM nation WHERE n_nationkey BETWEEN 1 AND 12 UNION ALL SELECT 'UNIT ' || n_nationkey, 'session' FROM nation WHERE n_nationkey > 12 UNION ALL SELECT 'UNIT 0', 'session')")
def k06(spark, sf):
    n = table(spark, sf, "nation")
    label = lambda p: F.concat(F.lit(p), F.col("n_nationkey").cast("string")).alias("unit")
    doc = n.where("n_nationkey BETWEEN 1 AND 12").select(label("Unit "))
    session = n.select(label("UNIT ")).union(n.where("n_nationkey = 4").select(F.lit("unit  IV")))
    return K.merge_units(doc, session)


def _elements(spark, sf):
    """Documents' lines as elements: every ninth a heading, every seventh a picture."""
    e = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    kind = F.when(F.col("ord") % 9 == 0, "heading").when(F.col("ord") % 7 == 0, "picture").otherwise("paragraph")
    return e.select("document_id", "ord", kind.alias("type"), F.when(kind == "heading", F.concat(F.lit("Head "), (F.col("document_id") % 4).cast("string"), F.lit("."), F.col("ord").cast("string"))).when(kind == "picture", "").otherwise(F.substring("line", 1, 20)).alias("text"))


_ELEMENTS = "el AS (SELECT doc_id AS document_id, CAST(u.i - 1 AS INTEGER) AS ord, CASE WHEN (u.i - 1) % 9 = 0 THEN 'heading' WHEN (u.i - 1) % 7 = 0 THEN 'picture' ELSE 'paragraph' END AS type, CASE WHEN (u.i - 1) % 9 = 0 THEN 'Head ' || (doc_id % 4) || '.' || (u.i - 1) WHEN (u.i - 1) % 7 = 0 THEN '' ELSE l[u.i][1:20] END AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"
_CATALOG = f"WITH {_ELEMENTS}, c AS (SELECT *, last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER w AS topic, concat_ws(' ', string_agg(CASE WHEN type <> 'picture' THEN text END, ' ') OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), string_agg(CASE WHEN type <> 'picture' THEN text END, ' ') OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS context FROM el WINDOW w AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), cat AS (SELECT document_id, ord, topic AS section, topic, context FROM c WHERE type = 'picture')"


@query("k07_picture_catalog", sql=_CATALOG + " SELECT * FROM cat")
def k07(spark, sf):
    return K.picture_catalog(_elements(spark, sf)).drop("image_type")


@query("k08_picture_concepts")
def k08(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.picture_concepts(F.col("text")).alias("concepts"))


@query("k09_picture_search", sql=_CATALOG + ", hit AS (SELECT * FROM cat WHERE contains(lower(topic), 'head 1')) SELECT document_id, ord, topic, (SELECT count(*) FROM hit) AS total, CAST(ceil((SELECT count(*) FROM hit) / 20.0) AS BIGINT) AS pages FROM (SELECT *, row_number() OVER (ORDER BY document_id, ord) AS k FROM hit) WHERE k BETWEEN 21 AND 40")
def k09(spark, sf):
    return K.picture_search(K.picture_catalog(_elements(spark, sf)), "Head 1", None, 2, 20).select("document_id", "ord", "topic", "total", "pages")


@query("k09_topic_counts", sql=_CATALOG + " SELECT topic, count(*) AS pictures FROM cat GROUP BY topic")
def k09b(spark, sf):
    return K.topic_counts(K.picture_catalog(_elements(spark, sf)))


@query("k10_library_list", sql=with_tables("library", then="SELECT id, title, total_marks, status FROM library WHERE contains(lower(title || ' ' || subject), 'cust3') AND class = '2' AND status = 'generated' ORDER BY total_marks DESC, id LIMIT 50"))
def k10(spark, sf):
    return K.library_list(library(spark, sf), "CUST3", "2", None, "generated", "marks", 50).select("id", "title", "total_marks", "status")


@query("k11_library_facets", sql=with_tables("library", then="SELECT 'class' AS facet, class AS value, row_number() OVER (ORDER BY TRY_CAST(class AS INTEGER), class) AS ord FROM (SELECT DISTINCT class FROM library) UNION ALL SELECT 'subject', subject, row_number() OVER (ORDER BY subject) FROM (SELECT DISTINCT subject FROM library)"))
def k11(spark, sf):
    return K.library_facets(library(spark, sf))


@query("k12_library_stats", sql=with_tables("library", then="SELECT class, status, count(*) AS n FROM library GROUP BY CUBE (class, status)"))
def k12(spark, sf):
    return K.library_stats(library(spark, sf))
