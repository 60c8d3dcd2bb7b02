"""Virtual tables of the engine's data model over the test tables, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronlake.sources.staging import dealt, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_tables(*names: str, then: str) -> str:
    """SQL with the named virtual tables in front."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + then


SQL: dict[str, str] = {}

SQL["chunks"] = """
    SELECT d.doc_id, 'c-' || d.doc_id AS chunk_id, 'syllabus' AS corpus, 'syllabus_notes' AS source_type, d.lang AS class, d.source AS subject,
      'U' || (d.doc_id % 4 + 1) AS unit, CASE WHEN d.doc_id % 10 = 0 THEN 'parent' ELSE 'child' END AS chunk_type,
      CASE WHEN d.doc_id % 10 <> 0 THEN 'c-' || (d.doc_id - d.doc_id % 10) END AS parent_chunk_id,
      sha256(d.source || (d.doc_id // 50)) AS source_hash, d.source || '.txt' AS source_filename,
      TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(d.doc_id AS INTEGER)) AS ingested_at,
      'Section ' || (d.doc_id % 3) AS section, CASE WHEN d.doc_id % 5 <> 0 THEN 'Chapter ' || (d.doc_id % 5) END AS chapter,
      'topic' || (d.doc_id % 7) AS topic, d.doc_id AS chunk_index, d.text, e.embedding
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id"""


def chunks(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Documents as chunks with their vectors. Without ``vectors`` the same rows lack that column, and texts meet no table of vectors.

    A vector id that occurs n times gives n rows either way; such ids are counted first, so the texts move only if they are many.
    """
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    i = F.col("doc_id")
    text = lambda x: x.cast("string")
    if vectors:
        d = d.join(e, i == F.col("vec_id"), "left")
    else:
        again = written(e.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.count("*").cast("int").alias("times")).where("times > 1"), "repeated-vectors")
        if not again.isEmpty():
            d = d.join(again, i == F.col("vec_id"), "left").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.coalesce("times", F.lit(1)))))
    return d.select(
        "doc_id",
        F.concat(F.lit("c-"), text(i)).alias("chunk_id"),
        F.lit("syllabus").alias("corpus"),
        F.lit("syllabus_notes").alias("source_type"),
        F.col("lang").alias("class"),
        F.col("source").alias("subject"),
        F.concat(F.lit("U"), text(i % 4 + 1)).alias("unit"),
        F.when(i % 10 == 0, "parent").otherwise("child").alias("chunk_type"),
        F.when(i % 10 != 0, F.concat(F.lit("c-"), text(i - i % 10))).alias("parent_chunk_id"),
        F.sha2(F.concat("source", text(F.floor(i / 50))), 256).alias("source_hash"),
        F.concat("source", F.lit(".txt")).alias("source_filename"),
        F.timestamp_seconds(F.lit(1704067200) + i * 60).alias("ingested_at"),
        F.concat(F.lit("Section "), text(i % 3)).alias("section"),
        F.when(i % 5 != 0, F.concat(F.lit("Chapter "), text(i % 5))).alias("chapter"),
        F.concat(F.lit("topic"), text(i % 7)).alias("topic"),
        i.alias("chunk_index"),
        "text",
        *(["embedding"] if vectors else []),
    )


SQL["queries"] = """
    SELECT b.item_id AS query_id, array_to_string(string_split_regex(trim(b.text), '\\s+')[1:12], ' ') AS query, e.embedding AS query_vec,
      'en' AS class, 'src' || (b.item_id % 20) AS subject, b.text
    FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``benchmark``: searches by the first twelve words of an item, and by its vector."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    words = F.slice(F.split(F.trim("text"), r"\s+"), 1, 12)
    return b.join(e, F.col("item_id") == F.col("vec_id"), "left").select(
        F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"), "query_vec", F.lit("en").alias("class"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("subject"), "text"
    )


SQL["past_items"] = """
    SELECT b.item_id, 'Q' || b.item_id AS question_number, b.text, e.embedding, 'en' AS class, 'src' || (b.item_id % 20) AS subject, CAST(b.item_id % 5 + 1 AS DOUBLE) AS marks
    FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id"""


def past_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    i = F.col("item_id")
    return b.join(e, i == F.col("vec_id")).select("item_id", F.concat(F.lit("Q"), i.cast("string")).alias("question_number"), "text", "embedding", F.lit("en").alias("class"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("subject"), (i % 5 + 1).cast("double").alias("marks"))


SQL["candidates"] = """
    SELECT conv_id || ':' || turn AS question_id, conv_id AS paper_id, turn AS slot_index, c.text,
      CASE turn % 5 WHEN 0 THEN 'MCQ' WHEN 1 THEN 'SHORT_ANSWER' WHEN 2 THEN 'LONG_ANSWER' WHEN 3 THEN 'TRUE_FALSE' ELSE 'FILL_IN_THE_BLANK' END AS type,
      CAST(turn % 4 + 1 AS DOUBLE) AS marks, turn % 4 AS attempts, e.embedding
    FROM conversations c JOIN embeddings e ON e.vec_id = (conv_id * 7 + turn) % (SELECT count(*) FROM embeddings) WHERE role = 'assistant'"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    t = F.col("turn")
    kind = F.when(t % 5 == 0, "MCQ").when(t % 5 == 1, "SHORT_ANSWER").when(t % 5 == 2, "LONG_ANSWER").when(t % 5 == 3, "TRUE_FALSE").otherwise("FILL_IN_THE_BLANK")
    return c.join(e, (F.col("conv_id") * 7 + t) % e.count() == F.col("vec_id")).select(
        F.concat_ws(":", "conv_id", "turn").alias("question_id"), F.col("conv_id").alias("paper_id"), t.alias("slot_index"), "text", kind.alias("type"), (t % 4 + 1).cast("double").alias("marks"), (t % 4).alias("attempts"), "embedding"
    )


SQL["ref_items"] = """SELECT conv_id AS paper_id, turn + 1 AS slot_index, text AS reference_text FROM conversations WHERE role = 'user'"""


def ref_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns: the reference of the assistant turn after them."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("paper_id"), (F.col("turn") + 1).alias("slot_index"), F.col("text").alias("reference_text"))


_TYPE = "CASE l_returnflag WHEN 'A' THEN 'MCQ' WHEN 'N' THEN 'SHORT_ANSWER' ELSE 'LONG_ANSWER' END"
SQL["slot_items"] = f"""
    SELECT o_custkey AS paper_id, o_orderkey AS slot_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item_index,
      l_linenumber AS number, l_quantity AS marks, l_partkey AS part_id, {_TYPE} AS type, 'part ' || l_partkey AS reference_text, l_extendedprice AS price
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""


def item_rows(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "lineitem").count()


def by_slot(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """``df`` dealt by slot_id as ``slot_items`` is, so that the two meet where the items lie."""
    return dealt(df, item_rows(spark, sf_dir), "slot_id")


def slot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items, dealt by their order to as many tasks as they need."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    kind = F.when(F.col("l_returnflag") == "A", "MCQ").when(F.col("l_returnflag") == "N", "SHORT_ANSWER").otherwise("LONG_ANSWER")
    numbered = dealt(l, l.count(), "l_orderkey").withColumn("item_index", F.row_number().over(w).cast("long"))
    return numbered.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("slot_id"), "item_index", F.col("l_linenumber").alias("number"), F.col("l_quantity").alias("marks"), F.col("l_partkey").alias("part_id"), kind.alias("type"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("reference_text"), F.col("l_extendedprice").alias("price")
    )


SQL["slots"] = """
    SELECT o_custkey AS paper_id, o_orderkey AS slot_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slot_index,
      substr(o_orderpriority, 1, 1) AS section, round(o_totalprice / 1000) AS total_marks, CAST(o_orderkey % 9 AS INTEGER) AS declared_items,
      o_orderstatus AS status, o_orderkey % 11 = 0 AS locked
    FROM orders"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("slot_id"), F.row_number().over(w).cast("long").alias("slot_index"), F.substring("o_orderpriority", 1, 1).alias("section"),
        F.round(F.col("o_totalprice") / 1000).alias("total_marks"), (F.col("o_orderkey") % 9).cast("int").alias("declared_items"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 11 == 0).alias("locked"),
    )


SQL["papers"] = """SELECT c_custkey AS paper_id, c_name AS title, c_mktsegment AS subject, CAST(c_nationkey AS VARCHAR) AS class, round(c_acctbal / 10) AS declared_total FROM customer"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("subject"), F.col("c_nationkey").cast("string").alias("class"), F.round(F.col("c_acctbal") / 10).alias("declared_total"))


SQL["units"] = """SELECT DISTINCT p_brand AS unit FROM part"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("unit")).distinct()


SQL["nodes"] = """
    SELECT 'r' || r_regionkey AS id, 'UNIT' AS type, r_name AS name, 1.0 AS confidence, 'r' || r_regionkey AS source_document_id, 'r' || r_regionkey AS chunk_id FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'TOPIC', n_name, 0.5 + (n_nationkey % 50) / 100.0, 'r' || n_regionkey, 'n' || n_nationkey FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'CONCEPT', s_name, 0.5 + (s_suppkey % 50) / 100.0, 'r' || n_regionkey, 'n' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey"""
SQL["edges"] = """
    SELECT 'r' || n_regionkey AS source, 'CONTAINS' AS relation, 'n' || n_nationkey AS target, 0.5 + (n_nationkey % 50) / 100.0 AS confidence, 'r' || n_regionkey AS source_document_id, 'n' || n_nationkey AS chunk_id FROM nation
    UNION ALL SELECT 'n' || s_nationkey, 'CONTAINS', 's' || s_suppkey, 0.5 + (s_suppkey % 50) / 100.0, 'r' || n_regionkey, 'n' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


def _key(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    placed = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    conf = lambda c: (F.lit(0.5) + (F.col(c) % 50) / 100.0).alias("confidence")
    a = r.select(_key("r", "r_regionkey").alias("id"), F.lit("UNIT").alias("type"), F.col("r_name").alias("name"), F.lit(1.0).alias("confidence"), _key("r", "r_regionkey").alias("source_document_id"), _key("r", "r_regionkey").alias("chunk_id"))
    b = n.select(_key("n", "n_nationkey"), F.lit("TOPIC"), "n_name", conf("n_nationkey"), _key("r", "n_regionkey"), _key("n", "n_nationkey"))
    c = placed.select(_key("s", "s_suppkey"), F.lit("CONCEPT"), "s_name", conf("s_suppkey"), _key("r", "n_regionkey"), _key("n", "s_nationkey"))
    return a.union(b).union(c)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    placed = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    conf = lambda c: (F.lit(0.5) + (F.col(c) % 50) / 100.0).alias("confidence")
    a = n.select(_key("r", "n_regionkey").alias("source"), F.lit("CONTAINS").alias("relation"), _key("n", "n_nationkey").alias("target"), conf("n_nationkey"), _key("r", "n_regionkey").alias("source_document_id"), _key("n", "n_nationkey").alias("chunk_id"))
    return a.union(placed.select(_key("n", "s_nationkey"), F.lit("CONTAINS"), _key("s", "s_suppkey"), conf("s_suppkey"), _key("r", "n_regionkey"), _key("n", "s_nationkey")))


SQL["library"] = """
    SELECT o_orderkey AS id, 'Paper ' || o_orderkey AS title, substr(o_orderpriority, 1, 1) AS class, 'cust' || (o_custkey % 10) AS subject, o_totalprice AS total_marks,
      CASE o_orderstatus WHEN 'F' THEN 'generated' WHEN 'O' THEN 'in_progress' ELSE 'draft' END AS status, o_orderdate AS created_at
    FROM orders"""


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "generated").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("draft")
    return o.select(F.col("o_orderkey").alias("id"), _key("Paper ", "o_orderkey").alias("title"), F.substring("o_orderpriority", 1, 1).alias("class"), F.concat(F.lit("cust"), (F.col("o_custkey") % 10).cast("string")).alias("subject"), F.col("o_totalprice").alias("total_marks"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


SQL["job_events"] = """
    SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' ELSE 'stage' END AS type,
      CASE event_type WHEN 'view' THEN 'blueprint_verification' WHEN 'click' THEN 'rag_retrieval' WHEN 'signup' THEN 'slot_generation' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS stage,
      CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS slot, value AS ms, event_type
    FROM events"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_job_events(table(spark, sf_dir, "events"))


def as_job_events(e: DataFrame) -> DataFrame:
    t = F.col("event_type")
    stage = F.when(t == "view", "blueprint_verification").when(t == "click", "rag_retrieval").when(t == "signup", "slot_generation").when(t == "purchase", "completed").when(t == "error", "failed")
    kind = F.when(t == "purchase", "complete").when(t == "error", "error").otherwise("stage")
    return e.select(F.col("user_id").alias("job_id"), "event_id", "ts", kind.alias("type"), stage.alias("stage"), (F.get_json_object("props", "$.k").cast("int") % 10).alias("slot"), F.col("value").alias("ms"), "event_type")


SQL["page_text"] = """
    SELECT d.doc_id AS document_id, p.page_number, CASE WHEN d.doc_id % 17 = 0 AND p.page_number = 1 THEN '' ELSE array_to_string(l[(p.page_number - 1) * 20 + 1 : p.page_number * 20], chr(10)) END AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, unnest(range(1, CAST(ceil(len(l) / 20.0) AS BIGINT) + 1)) AS p(page_number)"""


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pages of 20 lines; the first page of every seventeenth is blank."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    p = d.select("doc_id", "l", F.explode(F.sequence(F.lit(1), F.ceil(F.size("l") / 20).cast("long"))).alias("page_number"))
    text = F.array_join(F.slice("l", ((F.col("page_number") - 1) * 20 + 1).cast("int"), F.lit(20)), "\n")
    return p.select(F.col("doc_id").alias("document_id"), "page_number", F.when((F.col("doc_id") % 17 == 0) & (F.col("page_number") == 1), "").otherwise(text).alias("text"))
