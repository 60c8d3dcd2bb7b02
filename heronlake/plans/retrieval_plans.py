"""Queries of retrieval and evidence fusion (R, E)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from heronlake.functions.text import SEARCH_STOPWORDS
from heronlake.operators import fusion as E
from heronlake.operators import retrieval as R
from heronlake.plans.base import query
from heronlake.plans.text_plans import terms_sql
from heronlake.sources.lexical_index import open_index, refresh
from heronlake.sources.staging import shared_base
from heronlake.plans.tables import SQL, by_slot, candidates, chunks, edges, item_rows, nodes, queries, slot_items, slots, table, with_tables

_STOP = "[" + ", ".join(f"'{w}'" for w in SEARCH_STOPWORDS) + "]"


def _tok(col: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({col}, '')), '[^a-z0-9'']+'), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


_COS = f"round({_dot('q.query_vec', 'c.embedding')} / (sqrt({_dot('q.query_vec', 'q.query_vec')}) * sqrt({_dot('c.embedding', 'c.embedding')})), 6)"

_BM25 = f"""
    toks AS (SELECT class, subject, chunk_id, chunk_type, {_tok("concat_ws(' ', text, chapter, section)")} AS t FROM chunks),
    lens AS (SELECT class, subject, chunk_id, chunk_type, t, greatest(len(t), 1) AS dl FROM toks),
    posts AS (SELECT class, subject, chunk_id, chunk_type, dl, term, count(*) AS tf FROM (SELECT * EXCLUDE (t), unnest(t) AS term FROM lens) GROUP BY ALL),
    dfs AS (SELECT class, subject, term, count(*) AS df FROM posts GROUP BY ALL),
    stats AS (SELECT class, subject, count(*) AS docs, avg(dl) AS avgdl FROM lens GROUP BY ALL),
    terms AS (SELECT DISTINCT query_id, class, subject, unnest({_tok('query')}) AS term FROM queries),
    lex AS (SELECT query_id, chunk_id, chunk_type, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
      FROM posts JOIN terms USING (class, subject, term) JOIN dfs USING (class, subject, term) JOIN stats USING (class, subject) GROUP BY ALL),
    lexical AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex WHERE score > 0 AND chunk_type <> 'parent' QUALIFY rank <= 10)"""
_DENSE = f"""
    dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT q.query_id, c.chunk_id, {_COS} AS score FROM queries q JOIN chunks c ON q.class = c.class WHERE c.embedding IS NOT NULL AND q.query_vec IS NOT NULL) QUALIFY rank <= 10)"""
_FUSED = """
    rrf AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id, d.score AS dense_score, d.rank AS dense_rank, b.score AS bm25_score, b.rank AS bm25_rank,
        round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 5) AS score FROM dense d FULL JOIN lexical b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM rrf QUALIFY rank <= 20)"""


def _pairs(t: str) -> str:
    return f"list_distinct(list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def _share(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}), 0)::DOUBLE, 0)"


_RERANKED = f"""
    base AS (SELECT f.query_id, f.chunk_id, f.rank AS fused_rank, count(*) OVER (PARTITION BY f.query_id) AS n, list_distinct({_tok('q.query')}) AS qt, {_tok('q.query')} AS ql, {_tok('c.text')} AS ct, {_tok("concat_ws(' ', c.chapter, c.section)")} AS ht
      FROM fused f JOIN queries q USING (query_id) JOIN chunks c ON c.chunk_id = f.chunk_id),
    marked AS (SELECT query_id, chunk_id, fused_rank, round(0.4 * {_share('qt', 'ct')} + 0.25 * {_share(_pairs('ql'), _pairs('ct'))} + 0.15 * {_share('qt', 'ht')} + 0.2 * CASE WHEN n > 1 THEN 1 - (fused_rank - 1) / (n - 1)::DOUBLE ELSE 1.0 END, 4) AS score FROM base),
    reranked AS (SELECT query_id, chunk_id, score, fused_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fused_rank) AS rank FROM marked QUALIFY rank <= 5)"""


def _sql(ctes: list[str], then: str) -> str:
    return "WITH " + ", ".join([f"{n} AS ({SQL[n]})" for n in ("chunks", "queries")] + ctes) + " " + then


def _index(spark, sf, c=None):
    """The kept index over the chunks of ``sf``: the first query of a cluster's shared folder builds it, later ones find it fresh."""
    path = f"{shared_base(spark)}/lexical-lists-{hashlib.md5(sf.encode()).hexdigest()}"
    refresh(chunks(spark, sf, vectors=False) if c is None else c, path)
    return open_index(spark, path)


@query("r02_bm25_index", sql=_sql([_BM25], "SELECT class, subject, term, count(*) AS df, sum(tf) AS tf, max(dl) AS longest FROM posts GROUP BY ALL"))
def r02(spark, sf):
    index = _index(spark, sf)
    terms = index["postings"].groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"), F.max("len").alias("longest"))
    scopes = index["stats"].where("docs > 0").select("scope", "class", "subject")
    return terms.join(scopes, "scope").select("class", "subject", "term", "df", "tf", "longest")


@query("r03_bm25_search", sql=_sql([_BM25], "SELECT * FROM lexical"))
def r03(spark, sf):
    c = chunks(spark, sf, vectors=False)
    return R.bm25_search(queries(spark, sf), c, index=_index(spark, sf, c))


@query("r04_embed")
def r04(spark, sf):
    return R.embed(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", F.size("embedding").alias("dims"), F.round(R.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query("r05_embed_missing", sql="SELECT count(*) FILTER (doc_id % 2 = 0 OR k IN (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) FROM documents WHERE doc_id % 2 = 0)) AS hits, count(*) FILTER (NOT (doc_id % 2 = 0 OR k IN (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) FROM documents WHERE doc_id % 2 = 0))) AS misses, count(DISTINCT k) AS cached FROM (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS k FROM documents)")
def r05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    key = F.sha2(F.concat_ws("|", R.norm_text(F.col("text")), F.lit("bag64")), 256)
    cache = R.embed(d.where("doc_id % 2 = 0"), "text").select(key.alias("key"), "embedding").dropDuplicates(["key"])
    filled, counts = R.embed_missing(d, cache, "bag64")
    return counts.crossJoin(filled.agg(F.countDistinct("key").alias("cached")))  # one row each


@query("r06_cosine", sql=f"SELECT a.vec_id, b.vec_id AS other_id, round({_dot('a.embedding', 'b.embedding')} / (sqrt({_dot('a.embedding', 'a.embedding')}) * sqrt({_dot('b.embedding', 'b.embedding')})), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def r06(spark, sf):
    a = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("v"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("e"))
    return a.join(b, F.col("vec_id") == F.col("v")).select("vec_id", "other_id", F.round(R.cosine(F.col("embedding"), F.col("e")), 6).alias("cosine"))


@query("r07_dense_search", sql=_sql([_DENSE], "SELECT * FROM dense"))
def r07(spark, sf):
    return R.dense_search(queries(spark, sf), chunks(spark, sf), 10, ["class"])


@query("r08_dense_search_approx")
def r08(spark, sf):
    return R.dense_search_approx(queries(spark, sf), chunks(spark, sf), 10)


@query("r09_rrf_fuse", sql=_sql([_BM25, _DENSE, _FUSED], "SELECT * FROM fused"))
def r09(spark, sf):
    q, c = queries(spark, sf), chunks(spark, sf)
    return R.rrf_fuse(R.dense_search(q, c, 10, ["class"]), R.bm25_search(q, c, index=_index(spark, sf)))


@query("r10_rerank", sql=_sql([_BM25, _DENSE, _FUSED, _RERANKED], "SELECT * FROM reranked"))
def r10(spark, sf):
    q, c = queries(spark, sf), chunks(spark, sf)
    return R.rerank(q, R.rrf_fuse(R.dense_search(q, c, 10, ["class"]), R.bm25_search(q, c, index=_index(spark, sf))), chunks(spark, sf, vectors=False))


@query("r11_metadata_gate", sql=_sql([_BM25, _DENSE], "SELECT query_id, chunk_id, list_filter([CASE WHEN c.subject <> q.subject THEN 'subject' END, CASE WHEN c.unit <> 'U1' THEN 'unit' END], lambda x: x IS NOT NULL) AS reasons FROM dense JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id)"))
def r11(spark, sf):
    q, c = queries(spark, sf), chunks(spark, sf)
    hits = R.dense_search(q, c, 10, ["class"]).join(c.select("chunk_id", "class", "subject", "unit", "corpus", "source_type"), "chunk_id")
    return R.metadata_gate(hits, q.withColumn("unit", F.lit("U1"))).select("query_id", "chunk_id", "reasons")


@query("r12_restore_parents", sql=_sql([_DENSE], "SELECT d.query_id, d.chunk_id, coalesce(p.n <= 300, false) AS from_parent, CASE WHEN p.n <= 300 THEN p.text ELSE c.text END AS context_text FROM dense d JOIN chunks c USING (chunk_id) LEFT JOIN (SELECT chunk_id, text, len(string_split_regex(trim(text), '\\s+')) AS n FROM chunks WHERE chunk_type = 'parent') p ON p.chunk_id = c.parent_chunk_id"))
def r12(spark, sf):
    q, c = queries(spark, sf), chunks(spark, sf)
    return R.restore_parents(R.dense_search(q, c, 10, ["class"]), c).select("query_id", "chunk_id", "from_parent", "context_text")


@query("r13_compress_context")
def r13(spark, sf):
    q, c = queries(spark, sf), chunks(spark, sf)
    return R.compress_context(q, R.restore_parents(R.dense_search(q, c, 5, ["class"]), c))


@query("r14_hybrid_search", sql=_sql([_BM25, _DENSE, _FUSED, _RERANKED], "SELECT r.* FROM reranked r JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id) WHERE c.class = q.class AND c.subject = q.subject"))
def r14(spark, sf):
    texts = chunks(spark, sf, vectors=False)
    return R.hybrid_search(queries(spark, sf), chunks(spark, sf), ["class"], index=_index(spark, sf, texts), texts=texts)


@query("r15_retrieval_trace", sql=_sql([_BM25, _DENSE, _FUSED, _RERANKED], "SELECT query_id, 'dense' AS stage, count(*) AS hits, max(score) AS best FROM dense GROUP BY ALL UNION ALL SELECT query_id, 'bm25', count(*), max(score) FROM lexical GROUP BY ALL UNION ALL SELECT query_id, 'fused', count(*), max(score) FROM fused GROUP BY ALL UNION ALL SELECT query_id, 'reranked', count(*), max(score) FROM reranked GROUP BY ALL"))
def r15(spark, sf):
    q, c = queries(spark, sf), chunks(spark, sf)
    dense, lexical = R.dense_search(q, c, 10, ["class"]), R.bm25_search(q, c, index=_index(spark, sf))
    fused = R.rrf_fuse(dense, lexical)
    out = None
    for name, df in (("dense", dense), ("bm25", lexical), ("fused", fused), ("reranked", R.rerank(q, fused, chunks(spark, sf, vectors=False)))):
        one = df.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("best")).withColumn("stage", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _build_slots(spark, sf):
    c = chunks(spark, sf)
    types = F.array(*[F.lit(t) for t in ("MCQ", "SHORT_ANSWER", "LONG_ANSWER")])
    return c.select(F.col("doc_id").alias("slot_id"), "class", "subject", F.array("topic", "unit").alias("anchors"), F.concat(F.lit("What is the ____ of "), "topic", F.lit("?")).alias("stem"), F.get(types, (F.col("doc_id") % 3).cast("int")).alias("type"), "topic", F.lit("Easy").alias("difficulty"))


@query("r16_build_queries", sql=with_tables("chunks", then="SELECT doc_id AS slot_id, 'Class ' || class || ' ' || subject || ': ' || topic || '; ' || unit AS slot_query, 'the of ' || topic || ' ' || ['facts options', 'explanation', 'detailed explanation'][doc_id % 3 + 1] AS content_query, 'Class ' || class || ' ' || subject || ' ' || topic || ' Easy level questions' AS free_query, topic AS concept FROM chunks"))
def r16(spark, sf):
    return R.build_queries(_build_slots(spark, sf))


@query("r17_query_ladder", sql=with_tables("chunks", then=", r AS (SELECT doc_id AS task_id, 0 AS rung, 'CONCEPT' AS strategy, CASE WHEN doc_id % 3 = 0 THEN '' ELSE topic END AS query FROM chunks UNION ALL SELECT doc_id, 1, 'TOPIC_UNIT', CASE WHEN doc_id % 2 = 0 THEN topic ELSE topic || ' ' || unit END FROM chunks UNION ALL SELECT doc_id, 2, 'UNIT_FALLBACK', unit FROM chunks), f AS (SELECT *, lag(query) OVER (PARTITION BY task_id ORDER BY rung) AS b FROM r WHERE query <> '') SELECT task_id, rung, strategy, query, row_number() OVER (PARTITION BY task_id ORDER BY rung) AS attempt FROM f WHERE b IS NULL OR b <> query"))
def r17(spark, sf):
    i = F.col("doc_id")
    t = chunks(spark, sf).select(i.alias("task_id"), F.when(i % 3 == 0, "").otherwise(F.col("topic")).alias("concept"), F.when(i % 2 == 0, F.col("topic")).otherwise(F.concat_ws(" ", "topic", "unit")).alias("topic"), "unit")
    return R.query_ladder(t)


_RUNGS = (("CONCEPT", 1, 6, 0), ("TOPIC_UNIT", 4, 9, 101), ("UNIT_FALLBACK", 1, 12, 202))
_ROUND = """
    o{n} AS (SELECT task_id, query, concept, query_vec FROM ladder WHERE attempt = {n}{left}),
    h{n} AS (SELECT task_id, chunk_id, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, chunk_id) AS rank
      FROM (SELECT q.task_id, c.chunk_id, {cos} AS score FROM o{n} q JOIN chunks c ON c.class = 'en' WHERE c.embedding IS NOT NULL AND q.query_vec IS NOT NULL) QUALIFY rank <= 5),
    k{n} AS (SELECT DISTINCT task_id, unnest({terms}) AS w FROM h{n} JOIN chunks USING (chunk_id)),
    w{n} AS (SELECT task_id, unnest(list_distinct({wanted})) AS w FROM o{n}),
    s{n} AS (SELECT o.task_id, coalesce(m >= least(2, t) AND m / t::DOUBLE >= 0.5, FALSE) AS ok FROM o{n} o LEFT JOIN (SELECT w.task_id, count(*) AS t, count(k.w) AS m FROM w{n} w LEFT JOIN k{n} k ON k.task_id = w.task_id AND k.w = w.w GROUP BY 1) g ON g.task_id = o.task_id)"""


def _ladder_sql() -> str:
    rounds = [_ROUND.format(n=n, cos=_COS, terms=terms_sql("text"), wanted=terms_sql("coalesce(nullif(trim(concept), ''), query)"), left="" if n == 1 else f" AND task_id IN (SELECT task_id FROM s{n - 1} WHERE NOT ok)") for n in (1, 2, 3)]
    parts = " UNION ALL ".join(
        f"SELECT item_id AS task_id, {k} AS rung, '{name}' AS strategy, array_to_string(w[{a}:{b}], ' ') AS query, array_to_string(w[1:6], ' ') AS concept, (SELECT embedding FROM embeddings WHERE vec_id = (item_id + {off}) % (SELECT count(*) FROM embeddings)) AS query_vec FROM tasks" for k, (name, a, b, off) in enumerate(_RUNGS)
    )
    tried = " UNION ALL ".join(f"SELECT task_id, {n} AS attempts, ok FROM s{n}" for n in (1, 2, 3))
    hits = " UNION ALL ".join(f"SELECT task_id, {n} AS attempts, chunk_id FROM h{n}" for n in (1, 2, 3))
    return with_tables("chunks", then=f""", tasks AS (SELECT item_id, string_split_regex(trim(text), '\\s+') AS w FROM benchmark), parts AS ({parts}),
    kept AS (SELECT *, lag(query) OVER (PARTITION BY task_id ORDER BY rung) AS before FROM parts WHERE trim(query) <> ''),
    ladder AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY rung) AS attempt FROM kept WHERE before IS NULL OR before <> query), {", ".join(rounds)},
    tried AS ({tried}), hits AS ({hits}), last AS (SELECT task_id, max(attempts) AS attempts, arg_max(ok, attempts) AS sufficient FROM tried GROUP BY 1)
    SELECT l.task_id, d.strategy, l.attempts, l.sufficient, (SELECT string_agg(chunk_id, ',' ORDER BY chunk_id) FROM hits h WHERE h.task_id = l.task_id AND h.attempts = l.attempts) AS evidence FROM last l JOIN ladder d ON d.task_id = l.task_id AND d.attempt = l.attempts""")


@query("r18_ladder_retrieve", sql=_ladder_sql())
def r18(spark, sf):
    """Items of ``benchmark`` as tasks: rungs are parts of their wording, each with a vector of its own, over the English chunks."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("query_vec"))
    n = e.count()
    w = F.split(F.trim("text"), r"\s+")
    words = lambda a, b: F.array_join(F.slice(w, a, b - a + 1), " ")
    tasks = table(spark, sf, "benchmark").select(F.col("item_id").alias("task_id"), *[words(a, b).alias(c) for c, (_, a, b, _) in zip(("concept", "topic", "unit"), _RUNGS)])
    offset = F.get(F.array(*[F.lit(r[3]) for r in _RUNGS]), F.col("rung"))
    rungs = R.query_ladder(tasks).join(tasks.select("task_id", "concept"), "task_id").withColumns({"vec_id": (F.col("task_id") + offset) % n, "class": F.lit("en")})
    report, hits = R.ladder_retrieve(rungs.join(e, "vec_id", "left"), chunks(spark, sf), 5, ["class"], texts=chunks(spark, sf, vectors=False))
    evidence = hits.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_list("chunk_id")), ",").alias("evidence"))  # five a task
    return report.join(evidence, "task_id", "left")


@query("r19_expand_tasks", sql=with_tables("slots", "slot_items", then="""
    , a AS (SELECT slot_id, NULL::BIGINT AS item_index, 'U' || (slot_id % 4) AS unit FROM slots WHERE slot_id % 10 <> 0 UNION ALL SELECT slot_id, item_index, 'V' || item_index FROM slot_items WHERE slot_id % 9 = 0),
    s AS (SELECT paper_id, slot_id, (SELECT max(unit) FROM a WHERE a.slot_id = s.slot_id AND item_index IS NULL) AS su, slot_id IN (SELECT slot_id FROM a WHERE item_index IS NOT NULL) OR slot_id IN (SELECT slot_id FROM slot_items GROUP BY 1 HAVING count(DISTINCT reference_text) > 1) AS split FROM slots s)
    SELECT s.paper_id, s.slot_id, i.item_index, coalesce(a.unit, su) AS unit FROM s JOIN slot_items i USING (slot_id) LEFT JOIN a ON a.slot_id = s.slot_id AND a.item_index = i.item_index WHERE split UNION ALL SELECT paper_id, slot_id, NULL, su FROM s WHERE NOT split"""))
def r19(spark, sf):
    s, i = slots(spark, sf), slot_items(spark, sf)
    whole = s.where("slot_id % 10 <> 0").select("slot_id", F.lit(None).cast("long").alias("item_index"), F.concat(F.lit("U"), (F.col("slot_id") % 4).cast("string")).alias("unit"))
    split = i.where("slot_id % 9 = 0").select("slot_id", "item_index", F.concat(F.lit("V"), F.col("item_index").cast("string")).alias("unit"))
    return R.expand_tasks(by_slot(spark, sf, s.select("paper_id", "slot_id")), i, by_slot(spark, sf, whole.union(split)), item_rows(spark, sf))


@query("r20_dedupe_hits", sql="WITH k AS (SELECT conv_id AS paper_id, turn AS slot_index, 1 AS rank, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS key FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY paper_id, key ORDER BY slot_index, rank) AS b FROM k) SELECT paper_id, slot_index, row_number() OVER (PARTITION BY paper_id ORDER BY slot_index, rank, key) AS paper_rank FROM f WHERE b = 1 QUALIFY paper_rank <= 14")
def r20(spark, sf):
    hits = table(spark, sf, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("slot_index"), F.lit(1).alias("rank"), "text")
    return R.dedupe_hits(hits).select("paper_id", "slot_index", "paper_rank")


@query("r21_assemble_slot_context", sql=with_tables("slot_items", then="SELECT slot_id, max(number) AS attempts, bool_and(marks > 10) AS sufficient, CAST(sum(part_id) AS BIGINT) AS tokens, list_sort(list_distinct(list('e' || part_id % 50))) AS evidence, count(*) AS labels FROM slot_items GROUP BY slot_id"))
def r21(spark, sf):
    i = slot_items(spark, sf)
    r = i.select("slot_id", F.col("item_index").cast("string").alias("label"), F.lit("CONCEPT").alias("strategy"), F.col("number").alias("attempts"), (F.col("marks") > 10).alias("sufficient"), F.col("part_id").alias("tokens"), F.array(F.concat(F.lit("e"), (F.col("part_id") % 50).cast("string"))).alias("evidence"))
    return R.assemble_slot_context(r).select("slot_id", "attempts", "sufficient", "tokens", "evidence", F.size("items").alias("labels"))


@query("r23_retrieve_evidence", sql=_sql([_BM25, _DENSE], ", d AS (SELECT query_id, count(*) AS n FROM dense GROUP BY 1), l AS (SELECT query_id, count(*) AS n FROM lexical GROUP BY 1) SELECT q.query_id, coalesce(d.n, 0) AS n_dense, coalesce(l.n, 0) AS n_lexical, CASE WHEN q.query_id % 2 = 0 THEN 1 ELSE 0 END AS n_graph, CASE WHEN d.n IS NULL AND l.n IS NULL THEN 'RETRIEVAL_FAILURE' WHEN q.query_id % 2 = 1 THEN 'GRAPH_UNAVAILABLE' WHEN d.n IS NULL OR l.n IS NULL THEN 'DEGRADED' ELSE 'OK' END AS status FROM queries q LEFT JOIN d USING (query_id) LEFT JOIN l USING (query_id)"))
def r23(spark, sf):
    q, c = queries(spark, sf), chunks(spark, sf)
    return R.retrieve_evidence(q, R.dense_search(q, c, 10, ["class"]), R.bm25_search(q, c, index=_index(spark, sf)), q.where("query_id % 2 = 0").select("query_id"))


@query("r25_topic_coverage", sql=_sql([_DENSE], ", t AS (SELECT query_id, count(*) FILTER (score >= 0.3) AS n, max(score) AS best FROM dense WHERE rank <= 8 GROUP BY 1) SELECT q.query_id, coalesce(n, 0) > 0 AS matched, coalesce(n, 0) AS chunk_count, coalesce(best, 0.0) AS top_score FROM queries q LEFT JOIN t USING (query_id)"))
def r25(spark, sf):
    return R.topic_coverage(queries(spark, sf), chunks(spark, sf), 0.3, 8, ["class"])


@query("e01_edge_evidence", sql=with_tables("nodes", "edges", then="SELECT e.source || '|' || e.relation || '|' || e.target AS id, 'relationship' AS type, a.name || ' --' || relation || '--> ' || b.name AS text, round(e.confidence, 6) AS confidence, e.source_document_id, e.chunk_id FROM edges e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target"))
def e01(spark, sf):
    return E.edge_evidence(edges(spark, sf), nodes(spark, sf)).withColumn("confidence", F.round("confidence", 6))


def _evidence(spark, sf):
    """All chunks, dealt to all queries as evidence, with metadata missing here and there."""
    i, n = F.col("doc_id"), table(spark, sf, "benchmark").count()
    return chunks(spark, sf).select(
        (i % n).alias("query_id"), F.col("chunk_id").alias("id"), "text", "topic", "class", "subject", F.when(i % 6 != 0, F.col("unit")).alias("unit"), F.when(i % 4 != 0, F.col("source_hash")).alias("source_hash"),
        F.when(i % 3 != 0, F.col("source_filename")).alias("source_filename"), "chunk_id", "section", F.when(i % 5 != 0, F.col("subject")).alias("source_document_id"), ((i % 11) / 10.0).alias("vector_score"), ((i % 7) / 7.0).alias("graph_score"),
    )


def _target(spark, sf):
    q = queries(spark, sf)
    k = F.col("query_id").cast("string")
    return q.select("query_id", F.lit("the").alias("concept"), F.concat(F.lit("topic"), (F.col("query_id") % 7).cast("string")).alias("topic"), "class", F.concat(F.lit("src"), k).alias("subject"), F.lit("U1").alias("unit"))


_N = "(SELECT count(*) FROM benchmark)"
_EV = f"ev AS (SELECT doc_id % {_N} AS query_id, chunk_id AS id, text, topic, class, subject, CASE WHEN doc_id % 6 <> 0 THEN unit END AS unit, (CASE WHEN doc_id % 4 <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 <> 0 THEN 1 ELSE 0 END + 2) / 5.0 AS provenance, (doc_id % 11) / 10.0 AS vs, (doc_id % 7) / 7.0 AS gs, CASE WHEN contains(lower(text), 'the') THEN 1.0 ELSE 0.0 END AS concept_match, CASE WHEN topic = 'topic' || (doc_id % {_N} % 7) THEN 1.0 ELSE 0.0 END AS topic_match, chunk_id, CASE WHEN doc_id % 5 <> 0 THEN subject END AS sd FROM chunks WHERE doc_id % {_N} IN (SELECT item_id FROM benchmark))"
_SCORED = _EV + ", scored AS (SELECT *, round(0.5 * vs + 0.1 * gs + 0.15 * concept_match + 0.15 * topic_match + 0.1 * provenance, 5) AS fused FROM ev)"


@query("e03_evidence_features", sql=with_tables("chunks", then=f", {_EV} SELECT query_id, id, concept_match, topic_match, CAST(provenance AS DOUBLE) AS provenance, class = 'en' AS class_ok, subject = 'src' || query_id AS subject_ok, unit = 'U1' AS unit_ok FROM ev"))
def e03(spark, sf):
    return E.features(_evidence(spark, sf), _target(spark, sf)).select("query_id", "id", "concept_match", "topic_match", "provenance", "class_ok", "subject_ok", "unit_ok")


@query("e05_scope_gate", sql=with_tables("chunks", then=f", {_EV} SELECT query_id, CASE WHEN class <> 'en' THEN 'class' WHEN subject <> 'src' || query_id THEN 'subject' WHEN unit <> 'U1' THEN 'unit' END AS drop_reason, count(*) AS n FROM ev GROUP BY ALL"))
def e05(spark, sf):
    return E.scope_gate(E.features(_evidence(spark, sf), _target(spark, sf))).groupBy("query_id", "drop_reason").agg(F.count("*").alias("n"))


@query("e06_score_evidence", sql=with_tables("chunks", then=f", {_SCORED} SELECT query_id, id, fused FROM scored"))
def e06(spark, sf):
    return E.score_evidence(E.features(_evidence(spark, sf), _target(spark, sf))).select("query_id", "id", "fused")


_BLANKS = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


@query("e07_drop_restating_edges", sql=f"""
    WITH e AS (SELECT doc_id // 2 % {_N} AS query_id, 'e' || doc_id AS id, {_BLANKS} AS norm FROM documents UNION ALL SELECT item_id, 'b' || item_id, {_BLANKS} FROM benchmark),
    h AS (SELECT doc_id % {_N} AS query_id, {_BLANKS} AS hit FROM documents)
    SELECT query_id, min(id) AS id FROM e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = e.query_id AND norm <> '' AND (hit = norm OR length(hit) >= 12 AND length(norm) >= 12 AND (contains(hit, norm) OR contains(norm, hit)))) GROUP BY query_id, norm""")
def e07(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    n = b.count()
    # whole texts, dealt to all queries once as edges' sources and once as hits
    e = d.select((F.floor(F.col("doc_id") / 2) % n).alias("query_id"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("source_text"))
    e = e.union(b.select("item_id", F.concat(F.lit("b"), F.col("item_id").cast("string")), "text"))
    return E.drop_restating_edges(e, d.select((F.col("doc_id") % n).alias("query_id"), "text")).select("query_id", "id")


@query("e08_fuse_evidence", sql=with_tables("chunks", then=f", {_SCORED}, best AS (SELECT query_id, id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM scored QUALIFY rank <= 8) SELECT b.query_id, b.id, b.fused, b.rank, (SELECT count(DISTINCT concat_ws('::', sd, chunk_id)) FROM scored s WHERE s.query_id = b.query_id) AS sources FROM best b"))
def e08(spark, sf):
    best, provenance, _ = E.fuse_evidence(E.score_evidence(E.features(_evidence(spark, sf), _target(spark, sf))), 8)
    n = provenance.groupBy("query_id").agg(F.count("*").alias("sources"))
    return best.join(n, "query_id").select("query_id", "id", "fused", "rank", "sources")
