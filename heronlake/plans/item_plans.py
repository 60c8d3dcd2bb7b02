"""Queries of item extraction (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import items as Q
from heronlake.plans.base import query
from heronlake.plans.tables import page_text, table, with_tables


def _pages(spark, sf):
    """Documents' lines dressed as papers: section headers, mains, lettered subs, options and lone marks by place."""
    p = page_text(spark, sf)
    dressed = F.transform(F.split("text", "\n"), lambda x, i: _dress(x, i))
    return p.select("document_id", "page_number", F.array_join(dressed, "\n").alias("text"))


def _dress(x, i):
    n = (F.floor(i / 8) + 1).cast("string")
    k = i % 8
    return F.when(k == 0, F.concat(F.lit("Section "), F.char((F.floor(i / 8) % 3 + 65).cast("int")))).when(k == 1, F.concat(F.lit("Q"), n, F.lit(". "), x, F.lit(" [5]"))).when(k == 2, F.concat(F.lit("(a) "), x)).when(k == 3, "(a) red (b) blue (c) green").when(k == 4, F.concat(F.lit("(b) "), x)).when(k == 5, "5 marks").otherwise(x)


_LINES = """pg AS (SELECT document_id, page_number, list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 8 WHEN 0 THEN 'Section ' || chr(CAST((i - 1) // 8 % 3 + 65 AS INTEGER)) WHEN 1 THEN 'Q' || ((i - 1) // 8 + 1) || '. ' || x || ' [5]' WHEN 2 THEN '(a) ' || x WHEN 3 THEN '(a) red (b) blue (c) green' WHEN 4 THEN '(b) ' || x WHEN 5 THEN '5 marks' ELSE x END) AS l FROM page_text),
    ln AS (SELECT document_id, page_number * 100000 + u.i - 1 AS ord, page_number, u.i - 1 AS i, l[u.i] AS line FROM pg, unnest(range(1, len(l) + 1)) AS u(i))"""
#: The classes once more, as their definition in words has them, for the check.
_KIND = r"""CASE WHEN regexp_matches(line, '(?i)^\s*(section|part)\s*[-:]?\s*[A-Z]\b') THEN 'section'
    WHEN regexp_matches(line, '(?i)^\s*(general\s+)?instructions?\b') OR regexp_matches(line, '(?i)^\s*(all questions are compulsory|attempt all|time\s*:|maximum marks)') THEN 'instruction'
    WHEN regexp_matches(line, '(?i)^\s*[\[(]?\s*(marks?\s*[=:]?\s*)?[0-9]{1,2}\s*(marks?)?\s*[\])]?\s*$') THEN 'marks'
    WHEN regexp_matches(line, '^\s*\(?[a-d][).]\s*\S+.*\s\(?[b-d][).]\s*\S+') THEN 'option_row'
    WHEN regexp_matches(line, '(?i)^\s*Q\s*\.?\s*[0-9]+\s*[.:)]?\s*\S') THEN 'main' WHEN regexp_matches(line, '^\s*[0-9]{1,2}[.)]\s+\S') THEN 'number'
    WHEN regexp_matches(line, '^\s*\([a-z]\)\s*\S') THEN 'sub' WHEN regexp_matches(line, '^\s*[a-d][.)]\s+\S') THEN 'option'
    WHEN regexp_matches(line, '(?i)^\s*\(?[ivx]+[.)]\s+\S') THEN 'roman' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END"""


@query("q01_classify_lines", sql=with_tables("page_text", then=f", {_LINES} SELECT document_id, ord, {_KIND} AS kind FROM ln"))
def q01(spark, sf):
    return Q.classify_lines(_pages(spark, sf)).select("document_id", "ord", "kind")


@query("q02_carry_section", sql=with_tables("page_text", then=f", {_LINES} SELECT document_id, ord, last_value(CASE WHEN kind = 'section' THEN upper(regexp_extract(line, '(?i)(section|part)\\s*[-:]?\\s*([A-Z])\\b', 2)) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord) AS section FROM (SELECT *, {_KIND} AS kind FROM ln)"))
def q02(spark, sf):
    return Q.carry_section(Q.classify_lines(_pages(spark, sf))).select("document_id", "ord", "section")


def _questions(spark, sf):
    q = Q.segment_questions(Q.carry_section(Q.classify_lines(_pages(spark, sf))))
    marks, text = Q.parse_marks(F.col("text"))
    return q.withColumn("marks", marks).withColumn("text", text)


@query("q04_split_inline")
def q04(spark, sf):
    lines = Q.classify_lines(_pages(spark, sf))
    return lines.select("document_id", "ord", Q.split_option_row(F.col("line")).alias("options"), Q.split_inline_items(F.col("line")).alias("items"))


_MARK = r"(?i)(?:\[\s*([0-9]{1,2}(?:\.[0-9])?)\s*(?:marks?)?\s*\]|\(\s*([0-9]{1,2}(?:\.[0-9])?)\s*marks?\s*\)|marks?\s*=\s*([0-9]{1,2}(?:\.[0-9])?))\s*$"


_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_OPTION = _BARE.format(r"regexp_replace(line, '^\s*\(?\w+[.)]\s*', '')")


@query("q03_segment_questions", sql=with_tables("page_text", then=rf""", {_LINES},
    kd AS (SELECT document_id, ord, line, {_KIND} AS kind FROM ln),
    mn AS (SELECT *, last_value(CASE WHEN kind = 'section' THEN upper(regexp_extract(line, '(?i)(section|part)\s*[-:]?\s*([A-Z])\b', 2)) END IGNORE NULLS) OVER w AS section,
      last_value(CASE WHEN kind IN ('main', 'number') THEN 'Q' || regexp_extract(line, '[0-9]+') END IGNORE NULLS) OVER w AS main FROM kd WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
    op AS (SELECT *, kind IN ('main', 'number') OR kind = 'sub' AND main IS NOT NULL AS opens FROM mn),
    it AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER w AS item, last_value(CASE WHEN opens THEN 1 WHEN kind = 'section' THEN 0 END IGNORE NULLS) OVER w AS live FROM op WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
    li AS (SELECT *, CASE WHEN kind = 'sub' THEN regexp_extract(line, '^\s*\([a-z]\)\s*(.*)$', 1) WHEN opens THEN regexp_extract(line, '(?i)^\s*Q?\s*\.?\s*[0-9]+\s*[.:)]?\s*(.*)$', 1) ELSE {_BARE.format('line')} END AS words,
      CASE WHEN kind IN ('option', 'roman') THEN [{_OPTION}] WHEN kind = 'option_row' THEN list_filter(list_transform(string_split_regex(line, '\s*\(?\b[a-d][).]\s*'), lambda x: {_BARE.format('x')}), lambda x: x <> '') END AS options
      FROM it WHERE live = 1 AND (opens OR kind NOT IN ('section', 'instruction', 'blank'))),
    qs AS (SELECT document_id, item, max(CASE WHEN opens THEN CASE WHEN kind = 'sub' THEN main || '(' || regexp_extract(line, '\(([a-z])\)', 1) || ')' ELSE main END END) AS question_number,
      max(CASE WHEN opens AND kind = 'sub' THEN main END) AS parent_question_number, max(CASE WHEN opens THEN section END) AS section,
      CASE WHEN count(*) FILTER (NOT opens AND options IS NULL) = 0 THEN max(CASE WHEN opens THEN words END) ELSE {_BARE.format("string_agg(words, ' ' ORDER BY ord) FILTER (options IS NULL)")} END AS words,
      coalesce(flatten(list(options ORDER BY ord) FILTER (options IS NOT NULL)), []) AS options FROM li GROUP BY ALL),
    n AS (SELECT *, try_cast(coalesce({", ".join(f"nullif(regexp_extract(words, '{_MARK}', {k}), '')" for k in (1, 2, 3))}) AS DOUBLE) AS n FROM qs),
    k AS (SELECT *, coalesce(n > 0 AND n <= 20 AND NOT regexp_matches(words, '[xX×*=]\s*[\[(]\s*[0-9]+\s*[\])]\s*$'), false) AS ok FROM n)
    SELECT document_id, CAST(item - 1 AS INTEGER) AS ord, question_number, parent_question_number, CASE WHEN ok THEN trim(regexp_replace(words, '{_MARK}', ''), ' ') ELSE words END AS text, options, section, CASE WHEN ok THEN n END AS marks FROM k"""))
def q03(spark, sf):
    return _questions(spark, sf)


@query("q05_parse_marks", sql=with_tables("page_text", then=f""", {_LINES}, m AS (SELECT *, try_cast(coalesce({", ".join(f"nullif(regexp_extract(line, '{_MARK}', {k}), '')" for k in (1, 2, 3))}) AS DOUBLE) AS n FROM ln),
    k AS (SELECT *, coalesce(n > 0 AND n <= 20 AND NOT regexp_matches(line, '[xX×*=]\\s*[\\[(]\\s*[0-9]+\\s*[\\])]\\s*$'), false) AS ok FROM m) SELECT document_id, ord, CASE WHEN ok THEN n END AS marks, CASE WHEN ok THEN trim(regexp_replace(line, '{_MARK}', ''), ' ') ELSE line END AS text FROM k"""))
def q05(spark, sf):
    marks, text = Q.parse_marks(F.col("line"))
    return Q.classify_lines(_pages(spark, sf)).select("document_id", "ord", marks.alias("marks"), text.alias("text"))


@query("q06_repair_orphan_marks", sql="SELECT o_custkey AS document_id, o_orderkey AS ord, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 7 + 1 AS DOUBLE) END AS marks FROM orders")
def q06(spark, sf):
    o = table(spark, sf, "orders")
    q = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("ord"), F.lit(None).cast("string").alias("parent_question_number"), F.lit(None).cast("double").alias("marks"))
    lone = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 7 + 1).cast("double").alias("marks"))
    more = lone.where("document_id % 2 = 1").withColumn("ord", F.col("ord") + 10**9)
    return Q.repair_orphan_marks(q, lone.union(more)).select("document_id", "ord", "marks")


@query("q07_classify_item_type", sql="SELECT l_orderkey, l_linenumber, count(*) AS n, max(CASE WHEN l_linenumber % 4 >= 2 THEN 'MCQ' WHEN l_linenumber = 5 THEN 'TRUE_FALSE' WHEN l_linenumber = 4 THEN 'FILL_IN_THE_BLANK' WHEN l_quantity >= 4 THEN 'LONG_ANSWER' ELSE 'SHORT_ANSWER' END) AS type FROM lineitem GROUP BY ALL")
def q07(spark, sf):
    n = F.col("l_linenumber")
    text = F.when(n == 5, "State True or False").when(n == 4, "The ____ is red").otherwise("Name it")
    kind = Q.classify_item_type(n % 4, text, F.col("l_quantity"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.max(kind).alias("type"))


@query("q08_dedupe_items", sql="WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents) SELECT doc_id AS document_id, min(ord) AS ord FROM l WHERE length(trim(text, ' ')) >= 5 GROUP BY doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g')")
def q08(spark, sf):
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    return Q.dedupe_items(q).select("document_id", "ord")


@query("q09_locate_page", sql=with_tables("page_text", then=", q AS (SELECT document_id, page_number AS ord, text FROM page_text WHERE text <> ''), n AS (SELECT document_id, count(*) AS n FROM page_text GROUP BY 1) SELECT q.document_id, q.ord, CASE WHEN n = 1 THEN 1 ELSE (SELECT min(p.page_number) FROM page_text p WHERE p.document_id = q.document_id AND contains(lower(p.text), lower(q.text[1:30]))) END AS page_number FROM q JOIN n USING (document_id)"))
def q09(spark, sf):
    p = page_text(spark, sf)
    q = p.where("text <> ''").select("document_id", F.col("page_number").alias("ord"), "text")
    return Q.locate_page(q, p).select("document_id", "ord", "page_number")
