"""Queries of duplicates, novelty and overlap (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions.text import content_terms, norm_text, overlap_min
from heronlake.operators import novelty as N
from heronlake.plans.base import query
from heronlake.plans.tables import candidates, past_items, ref_items, table, with_tables
from heronlake.plans.text_plans import _case, _TRIGGER, terms_sql
from heronlake.functions import text as X


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"round({_dot(a, b)} / (sqrt({_dot(a, a)}) * sqrt({_dot(b, b)})), 6)"


def _items(spark, sf):
    return candidates(spark, sf).withColumns({"class": F.lit("en"), "subject": F.concat(F.lit("src"), (F.col("paper_id") % 20).cast("string"))})


_D01 = with_tables("candidates", "past_items", then=f", s AS (SELECT c.question_id, p.question_number, {_cos('c.embedding', 'p.embedding')} AS max_similarity FROM candidates c JOIN past_items p ON p.subject = 'src' || (c.paper_id % 20)) SELECT question_id, max_similarity, question_number, max_similarity >= 0.1 AS duplicate FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY max_similarity DESC, question_number) AS k FROM s) WHERE k = 1")


@query("d01_source_similarity", sql=_D01)
def d01(spark, sf):
    return N.source_similarity(_items(spark, sf), past_items(spark, sf), 0.1)


@query("d02_peer_duplicates", sql=with_tables("candidates", then=f", s AS (SELECT b.question_id, a.question_id AS peer_id, {_cos('a.embedding', 'b.embedding')} AS similarity FROM candidates a JOIN candidates b ON a.paper_id = b.paper_id AND a.slot_index < b.slot_index) SELECT question_id, peer_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, peer_id) AS k FROM s WHERE similarity >= 0.1) WHERE k = 1"))
def d02(spark, sf):
    return N.peer_duplicates(candidates(spark, sf), 0.1)


@query("d03_exact_duplicates", sql=r"SELECT doc_id, min(doc_id) OVER (PARTITION BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS duplicate FROM documents")
def d03(spark, sf):
    return N.exact_duplicates(table(spark, sf, "documents"), "doc_id")


def _pairs(spark, sf):
    """Assistant turns with the user turn before them; every third repeats it, with words dropped."""
    p = N.F
    c = candidates(spark, sf).select("question_id", "paper_id", "slot_index", "text", "type", "embedding")
    r = ref_items(spark, sf)
    j = c.join(r, ["paper_id", "slot_index"])
    k = p.col("paper_id") % 4
    words = p.split("reference_text", " ")
    text = p.when(k == 0, p.col("reference_text")).when(k == 1, p.array_join(p.filter(words, lambda w, i: i % 9 != 8), " ")).when(k == 2, p.array_join(p.filter(words, lambda w, i: i % 3 != 2), " ")).otherwise(p.col("text"))
    return j.withColumn("text", text)


_PAIRS = "pairs AS (SELECT c.question_id, c.paper_id, c.slot_index, c.type, c.embedding, r.reference_text, CASE c.paper_id % 4 WHEN 0 THEN r.reference_text WHEN 1 THEN array_to_string(list_filter(string_split(r.reference_text, ' '), lambda w, i: (i - 1) % 9 <> 8), ' ') WHEN 2 THEN array_to_string(list_filter(string_split(r.reference_text, ' '), lambda w, i: (i - 1) % 3 <> 2), ' ') ELSE c.text END AS text FROM candidates c JOIN ref_items r USING (paper_id, slot_index))"
_T = ", t AS (SELECT *, " + terms_sql("text") + " AS x, " + terms_sql("reference_text") + " AS y FROM pairs)"
_SHARED = "coalesce(len(list_intersect(x, y)) / nullif(least(len(x), len(y)), 0)::DOUBLE, 0)"


def _over(then: str) -> str:
    return with_tables("candidates", "ref_items", then=", " + _PAIRS + _T + " " + then)


@query("d05_overlap", sql=_over(f"SELECT question_id, round({_SHARED}, 6) AS by_min, round(coalesce(len(list_intersect(x, y)) / nullif(greatest(len(x), len(y)), 0)::DOUBLE, 0), 6) AS by_max FROM t"))
def d05(spark, sf):
    return N.overlaps(_pairs(spark, sf), "text", "reference_text").select("question_id", "by_min", "by_max")


def _demand(col: str) -> str:
    return _case(X.DEMANDS, "'UNKNOWN'").replace("trim(stem)", f"trim({col})")


_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


@query("d08_novelty_verdict", sql=_over(f"""SELECT question_id, round(o, 6) AS overlap, CASE WHEN {_NORM.format('text')} = {_NORM.format('reference_text')} THEN 'EXACT_COPY'
    WHEN {_TRIGGER.replace('stem', 'text')} IS NOT NULL AND {_TRIGGER.replace('stem', 'reference_text')} IS NOT NULL THEN 'SAME_DEMAND_SHAPE'
    WHEN one AND o >= CASE type WHEN 'SHORT_ANSWER' THEN 0.85 WHEN 'LONG_ANSWER' THEN 0.9 ELSE 0.8 END THEN 'NEAR_PARAPHRASE'
    WHEN one AND o >= CASE type WHEN 'SHORT_ANSWER' THEN 0.65 WHEN 'LONG_ANSWER' THEN 0.7 ELSE 0.55 END THEN 'SAME_INFORMATION_DEMAND' ELSE 'NOVEL' END AS verdict
    FROM (SELECT *, {_SHARED} AS o, {_demand('text')} = {_demand('reference_text')} AS one FROM t)"""))
def d08(spark, sf):
    return N.novelty_verdict(_pairs(spark, sf)).select("question_id", "overlap", "verdict")


@query("d10_parameter_swap")
def d10(spark, sf):
    return N.parameter_swap(_pairs(spark, sf)).select("question_id", "skeleton_overlap", "swapped")


@query("d11_embedding_backstop", sql=_over(f"""
    , v AS (SELECT p.*, {_SHARED} AS o, CASE WHEN paper_id % 2 = 0 THEN p.embedding ELSE e.embedding END AS rv FROM t p JOIN embeddings e ON e.vec_id = (p.paper_id * 7 + p.slot_index + 1) % (SELECT count(*) FROM embeddings)),
    s AS (SELECT *, {_cos('embedding', 'rv')} AS s FROM v), b AS (SELECT *, s >= 0.93 AND (type NOT IN ('MCQ', 'TRUE_FALSE', 'FILL_IN_THE_BLANK') OR o >= 0.55) AS bad FROM s)
    SELECT paper_id, count(*) FILTER (NOT bad) AS passed, count(*) FILTER (bad) AS failed, min(slot_index) FILTER (bad) AS first_position, arg_min(s, slot_index) FILTER (bad) AS first_similarity FROM b GROUP BY paper_id"""))
def d11(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("other"))
    p = _pairs(spark, sf)
    p = p.join(e, (F.col("paper_id") * 7 + F.col("slot_index") + 1) % e.count() == F.col("vec_id"))
    shared = overlap_min(content_terms(F.col("text")), content_terms(F.col("reference_text")))
    rows = p.select("paper_id", F.col("slot_index").alias("position"), "type", F.col("embedding").alias("vec"), F.when(F.col("paper_id") % 2 == 0, F.col("embedding")).otherwise(F.col("other")).alias("ref_vec"), shared.alias("overlap"))
    return N.embedding_backstop(rows)


@query("d12_topic_fidelity", sql=_over("""
    , w AS (SELECT question_id AS id, unnest(x) AS w FROM t), a AS (SELECT question_id AS id, unnest(y) AS a FROM t),
    hit AS (SELECT a.id, count(DISTINCT a) AS hit FROM a JOIN w ON a.id = w.id AND (a = w OR least(length(a), length(w)) >= 4 AND a[1:greatest(4, least(length(a), length(w)) - 1)] = w[1:greatest(4, least(length(a), length(w)) - 1)]) GROUP BY a.id)
    SELECT question_id AS id, round(coalesce(coalesce(hit, 0) / nullif(len(y), 0)::DOUBLE, 1.0), 6) AS coverage, round(coalesce(coalesce(hit, 0) / nullif(len(y), 0)::DOUBLE, 1.0), 6) >= 0.25 AS passes FROM t LEFT JOIN hit ON hit.id = question_id"""))
def d12(spark, sf):
    return N.topic_fidelity(_pairs(spark, sf).select(F.col("question_id").alias("id"), "text", F.col("reference_text").alias("anchor")))


@query("d13_pool_diversity", sql=with_tables("candidates", then=f", t AS (SELECT paper_id AS pool_id, question_id AS id, {terms_sql('text')} AS t FROM candidates), m AS (SELECT a.pool_id, a.id, avg(coalesce(len(list_intersect(a.t, b.t)) / nullif(greatest(len(a.t), len(b.t)), 0)::DOUBLE, 0)) AS m FROM t a JOIN t b ON a.pool_id = b.pool_id AND a.id <> b.id GROUP BY ALL) SELECT pool_id, id, round(CASE WHEN len(t) = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - coalesce(m, 0))) END, 6) AS diversity FROM t LEFT JOIN m USING (pool_id, id)"))
def d13(spark, sf):
    return N.pool_diversity(candidates(spark, sf).select(F.col("paper_id").alias("pool_id"), F.col("question_id").alias("id"), "text"))


_W = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("d14_longest_shared_phrase", sql=_over(f"""
    , w AS (SELECT question_id AS id, {_W.format('text')} AS a, {_W.format('reference_text')} AS b FROM pairs),
    pa AS (SELECT id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS word FROM w), pb AS (SELECT id, unnest(range(1, len(b) + 1)) AS j, unnest(b) AS word FROM w),
    same AS (SELECT id, i, j, word FROM pa JOIN pb USING (id, word)),
    grown AS (WITH RECURSIVE g AS (SELECT id, i, j, 1 AS n FROM same s WHERE NOT EXISTS (SELECT 1 FROM same t WHERE t.id = s.id AND t.i = s.i - 1 AND t.j = s.j - 1)
      UNION ALL SELECT g.id, g.i, g.j, n + 1 FROM g JOIN same s ON s.id = g.id AND s.i = g.i + n AND s.j = g.j + n) SELECT id, i, max(n) AS n FROM g GROUP BY id, i),
    k AS (SELECT id, arg_max(i, n * 100000 - i) AS i, max(n) AS n FROM grown GROUP BY id)
    SELECT w.id, CASE WHEN n >= 3 THEN n END AS words, CASE WHEN n >= 3 THEN array_to_string(a[i : i + n - 1], ' ') END AS phrase FROM w LEFT JOIN k USING (id)"""))
def d14(spark, sf):
    return N.longest_shared_phrase(_pairs(spark, sf).select(F.col("question_id").alias("id"), F.col("text").alias("a"), F.col("reference_text").alias("b")))


_GRAMS = r"(SELECT {id}, list_distinct(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i : i + 7], ' '))) AS r FROM (SELECT {id}, list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM {t}))"


@query("d16_corpus_contamination", sql=f"""
    WITH i AS (SELECT item_id, len(r) AS runs, unnest(r) AS h FROM {_GRAMS.format(id='item_id', t='benchmark')}), d AS (SELECT doc_id, unnest(r) AS h FROM {_GRAMS.format(id='doc_id', t='documents')})
    SELECT doc_id, item_id, count(*) AS shared, round(count(*) / runs::DOUBLE, 6) AS coverage FROM d JOIN i USING (h) GROUP BY doc_id, item_id, runs HAVING round(count(*) / runs::DOUBLE, 6) >= 0.5""")
def d16(spark, sf):
    return N.corpus_contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


_SAID = r"""(SELECT DISTINCT {id}, t, array_to_string(t, ' ') AS k FROM (SELECT {id}, {terms} AS t FROM (SELECT {id}, unnest(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '([^.!?]+(?:[.!?]+["'')\]]*|$))', 1)) AS s FROM {table})) WHERE len(t) >= 3)"""


@query("d16_corpus_restatements", sql=f"""
    WITH d AS {_SAID.format(id='doc_id', terms=terms_sql('s'), table='documents')}, i AS {_SAID.format(id='item_id', terms=terms_sql('s'), table='benchmark')},
    dt AS (SELECT k, len(t) AS n, unnest(t) AS term FROM (SELECT DISTINCT k, t FROM d)), it AS (SELECT k, len(t) AS n, unnest(t) AS term FROM (SELECT DISTINCT k, t FROM i)),
    same AS (SELECT dt.k AS dk, it.k AS ik FROM dt JOIN it USING (term) GROUP BY dt.k, it.k, dt.n, it.n HAVING 100 * count(*) >= 70 * greatest(dt.n, it.n)),
    hit AS (SELECT DISTINCT doc_id, ik FROM d JOIN same ON dk = d.k), own AS (SELECT DISTINCT item_id, k FROM i), n AS (SELECT item_id, count(*) AS n FROM own GROUP BY 1)
    SELECT doc_id, item_id, count(*) AS restated, round(count(*) / n::DOUBLE, 6) AS coverage FROM hit JOIN own ON k = ik JOIN n USING (item_id) GROUP BY doc_id, item_id, n HAVING round(count(*) / n::DOUBLE, 6) >= 0.5""")
def d16_restatements(spark, sf):
    return N.corpus_restatements(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
