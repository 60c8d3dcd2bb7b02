"""Queries of text cleaning, keys and item wording (T, C03-C04, D04-D10, V05-V06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions import text as X
from heronlake.plans.base import query
from heronlake.plans.tables import candidates, page_text, table, with_tables
from heronlake.operators import documents as D

_LINES = r"array_to_string(list_transform(string_split(regexp_replace({t}, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), chr(10))"


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query("t01_clean_text", sql=r"SELECT doc_id, regexp_replace(regexp_replace(" + _LINES.format(t=r"regexp_replace(regexp_replace(regexp_replace(text || chr(13) || chr(10) || chr(10) || chr(10) || ' end ', '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g')") + r", '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def t01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_text(F.concat("text", F.lit("\r\n\n\n end "))).alias("clean"))


@query("t02_drop_page_markers", sql=r"""
    SELECT doc_id, array_to_string(list_filter(string_split('Page ' || doc_id || ' of 4' || chr(10) || text || chr(10) || '-- 1 of 2 --' || chr(10) || '1 / 4', chr(10)),
      lambda x: NOT regexp_matches(x, '(?i)^\s*(?:page\s+\d+(?:\s+of\s+\d+)?|-+\s*\d+\s+of\s+\d+\s*-+|\d+\s*/\s*\d+)\s*$')), chr(10)) AS body FROM documents""")
def t02(spark, sf):
    marked = F.concat(F.lit("Page "), F.col("doc_id").cast("string"), F.lit(" of 4\n"), "text", F.lit("\n-- 1 of 2 --\n1 / 4"))
    return table(spark, sf, "documents").select("doc_id", X.drop_page_markers(marked).alias("body"))


@query("t03_strip_exam_metadata", sql=r"""
    SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace('1.2.3 (iv) ' || text || ' [5] CO1 BL2 (3)', '\[\d+\]|\(\d+\)|\((?:i{1,3}|iv|v|vi{0,3}|ix|x)\)', ' ', 'g'),
      '\b(?:CO|BL|PO|PS|BT|K)\d+\b|\b\d+(?:\.\d+)+\b', ' ', 'g'), '\s+', ' ', 'g')) AS stem FROM benchmark""")
def t03(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.strip_exam_metadata(F.concat(F.lit("1.2.3 (iv) "), "text", F.lit(" [5] CO1 BL2 (3)"))).alias("stem"))


@query("t04_drop_ocr_noise")
def t04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.drop_ocr_noise(F.col("text")).alias("body"))


@query("t05_text_sufficiency", sql=with_tables("page_text", then="SELECT document_id, page_number, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS meaningful, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) < 60 AS needs_ocr FROM page_text"))
def t05(spark, sf):
    return D.text_sufficiency(page_text(spark, sf))


@query("t06_extraction_status", sql=with_tables("page_text", then="""
    SELECT document_id, count(*) AS pages, sum(length(text)) AS chars, CASE WHEN bool_or(m < 60) THEN 'ocr' ELSE 'text' END AS method,
      CASE WHEN bool_or(m < 60) AND sum(m) > 0 THEN 'OCR_USED' WHEN bool_or(m < 60) THEN 'OCR_FAILED' WHEN sum(m) > 0 THEN 'TEXT_FOUND' ELSE 'NO_TEXT' END AS status
    FROM (SELECT *, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS m FROM page_text) GROUP BY document_id"""))
def t06(spark, sf):
    return D.extraction_status(page_text(spark, sf))


@query("t07_redact", sql=r"""
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || ' sk-' || repeat('a', 24) || ' C:\Users\x.txt', 'sk-[A-Za-z0-9_-]{20,}', '[REDACTED_SECRET]', 'g'), 'AIza[A-Za-z0-9_-]{30,}', '[REDACTED_SECRET]', 'g'), 'eyJ[A-Za-z0-9_.-]{30,}', '[REDACTED_SECRET]', 'g'), '[A-Za-z]:\\[^\s"'']+', '[REDACTED_PATH]', 'g') AS text FROM documents""")
def t07(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.redact(F.concat("text", F.lit(" sk-" + "a" * 24 + " C:\\Users\\x.txt"))).alias("text"))


@query("t08_norm_text", sql=r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS duplicate_key, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS novelty_key, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS stem_key FROM documents")
def t08(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.norm_text(t).alias("duplicate_key"), X.novelty_key(t).alias("novelty_key"), X.stem_key(t).alias("stem_key"))


@query("t09_stable_id", sql="""
    SELECT doc_id, h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point_id, 'c-' || h[1:16] AS chunk_id
    FROM (SELECT doc_id, sha256(lang || '::' || source || '::' || doc_id) AS h FROM documents)""")
def t09(spark, sf):
    cols = [F.col("lang"), F.col("source"), F.col("doc_id").cast("string")]
    return table(spark, sf, "documents").select("doc_id", X.stable_uuid(*cols).alias("point_id"), X.stable_id("c-", 16, *cols).alias("chunk_id"))


@query("t10_canonical_scope", sql=r"SELECT c_custkey, nullif(trim(regexp_replace(lower('  ' || c_mktsegment || '  A ' || c_name), '\s+', ' ', 'g')), '') AS scope, nullif(trim(repeat(' ', CAST(c_nationkey AS INTEGER))), '') AS blank FROM customer")
def t10(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", X.canonical_scope(F.concat(F.lit("  "), "c_mktsegment", F.lit("  A "), "c_name")).alias("scope"), X.canonical_scope(F.repeat(F.lit(" "), F.col("c_nationkey").cast("int"))).alias("blank"))


_ROMAN = {1: "I", 2: "II", 3: "III", 4: "IV", 5: "V", 6: "VI", 7: "VII", 8: "VIII", 9: "IX", 10: "X", 14: "XIV", 19: "XIX", 40: "XL", 44: "XLIV", 90: "XC"}


@query("t11_normalize_unit_label", sql="SELECT n_nationkey, CASE " + " ".join(f"WHEN n_nationkey = {k} THEN 'unit {k}'" for k in _ROMAN) + " ELSE 'unit ' || n_nationkey END AS unit FROM nation")
def t11(spark, sf):
    key = F.col("n_nationkey")
    label = F
    for k, v in _ROMAN.items():
        label = label.when(key == k, F.lit(f"Unit  {v}"))
    return table(spark, sf, "nation").select("n_nationkey", X.normalize_unit_label(label.otherwise(F.concat(F.lit(" UNIT "), key.cast("string")))).alias("unit"))


@query("t12_parse_model_json", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'a } b' AS s FROM events")
def t12(spark, sf):
    raw = F.concat(F.lit('Here it is: ```json\n{"s": "a } b", "in": '), "props", F.lit("} ``` and {more}"))
    got = X.parse_model_json(raw, "s string, in struct<k long>")
    parsed = table(spark, sf, "events").select("event_id", got.alias("got"))  # a column of its own, so that no field parses again
    return parsed.select("event_id", F.col("got.in.k").alias("k"), F.col("got.s").alias("s"))


@query("t13_degenerate_text", sql=r"SELECT doc_id, regexp_matches(t, 'SyntaxError|TypeError|ReferenceError|JSON\.parse|Unexpected token') OR regexp_matches(t, '(?:^|\W)(?:undefined|null|\[object Object\])(?:\W|$)') AS degenerate FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'undefined ' || text WHEN 1 THEN text || ' [object Object]' WHEN 2 THEN 'at JSON.parse ' || text ELSE text END AS t FROM documents)")
def t13(spark, sf):
    k = F.col("doc_id") % 5
    t = F.when(k == 0, F.concat(F.lit("undefined "), "text")).when(k == 1, F.concat("text", F.lit(" [object Object]"))).when(k == 2, F.concat(F.lit("at JSON.parse "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", X.degenerate(t).alias("degenerate"))


@query("r01_tokenize", sql=f"SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9'']+'), lambda w: length(w) > 1 AND NOT list_contains({_sql_list(X.SEARCH_STOPWORDS)}, w)) AS tokens FROM documents")
def r01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.search_tokens(F.col("text")).alias("tokens"))


@query("c03_split_sentences", sql=r"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(trim(regexp_replace(text, '\s+', ' ', 'g')), '([^.!?]+(?:[.!?]+["'')\]]*|$))', 1), lambda s: trim(s)), lambda s: s <> '') AS sentences FROM documents""")
def c03(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sentences(F.col("text")).alias("sentences"))


@query("c04_token_count", sql=r"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS tokens FROM documents")
def c04(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


_SINGULAR = "CASE WHEN length(w) <= 3 THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%es' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"


def terms_sql(col: str) -> str:
    """Distinct content words in order, for oracles."""
    words = f"list_filter(list_transform(regexp_extract_all(lower({col}), '[a-z0-9]+'), lambda w: {_SINGULAR}), lambda w: length(w) >= 3 AND NOT list_contains({_sql_list(X.CONTENT_STOPWORDS)}, w))"
    return f"list_sort(list_distinct({words}))"


@query("d04_content_terms", sql=f"SELECT item_id, {terms_sql('text')} AS terms FROM benchmark")
def d04(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.sort_array(X.content_terms(F.col("text"))).alias("terms"))


_STEMS = ["Why is the ", "Explain how the ", "What is a ", "Compare the ", "Give an example of ", "Predict the ", "Identify the ", "Which ", "State whether ", "How would you ", "What lesson does it ", "Write a program to ", "What can we learn from ", ""]


def _wording(spark, sf):
    """Items with fourteen wordings of question in front."""
    k = (F.col("item_id") % len(_STEMS)).cast("int")
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.get(F.array(*[F.lit(s) for s in _STEMS]), k), F.lower("text")).alias("stem"))


_WORDING = f"(SELECT item_id, {_sql_list(_STEMS)}[item_id % {len(_STEMS)} + 1] || lower(text) AS stem FROM benchmark)"


def _case(rules, default) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(trim(stem), '{p}') THEN '{v}'" for p, v in rules) + f" ELSE {default} END"


@query("d06_information_demand", sql=f"SELECT item_id, {_case(X.DEMANDS, repr('UNKNOWN'))} AS demand FROM {_WORDING}")
def d06(spark, sf):
    return _wording(spark, sf).select("item_id", X.information_demand(F.col("stem")).alias("demand"))


@query("d07_cognitive_operation", sql=f"SELECT item_id, {_case(X.OPERATIONS, repr('FACT'))} AS operation FROM {_WORDING}")
def d07(spark, sf):
    return _wording(spark, sf).select("item_id", X.cognitive_operation(F.col("stem")).alias("operation"))


_TRIGGER = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(lower(stem), '{p}', 1)), '')" for p in [rf"\b({'|'.join(X.SUMMARY_WORDS)})\b", r"(\bwhat (?:can|do|does|should|could) (?:we|you|students|readers|children|people)?\s*learn\b)", r"(\bwhat (?:do|does) .*\bteach us\b)", r"(\bwhat does .*\bteach\b)"]) + ")"


@query("d09_broad_summary", sql=f"SELECT item_id, {_TRIGGER} AS trigger_words, {_TRIGGER} IS NOT NULL AS broad FROM {_WORDING}")
def d09(spark, sf):
    t = X.summary_trigger(F.col("stem"))
    return _wording(spark, sf).select("item_id", t.alias("trigger_words"), t.isNotNull().alias("broad"))


_DEMAND = "CASE WHEN regexp_matches(stem, '{c}') THEN 'PROCEDURAL' ELSE coalesce({m}, {v}, 'RECALL') END".format(
    c=X.CODING, m="CASE " + _case(X.OPERATIONS, repr("FACT")) + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.DEMAND_OF_OPERATION.items()) + " END", v=_case(X.DEMAND_VERBS, "NULL")
)


@query("v05_cognitive_demand", sql=f"SELECT item_id, {_DEMAND} AS demand FROM {_WORDING}")
def v05(spark, sf):
    return _wording(spark, sf).select("item_id", X.cognitive_demand(F.col("stem")).alias("demand"))


@query("v06_demand_fidelity", sql=f"""
    WITH r AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in X.DEMAND_RANK.items())}) t(demand, rank)),
    p AS (SELECT item_id, {_DEMAND} AS generated, ['RECALL', 'UNDERSTANDING', 'APPLICATION', 'ANALYSIS', 'PROCEDURAL'][item_id % 5 + 1] AS intended FROM {_WORDING})
    SELECT item_id, intended, generated, coalesce(g.rank >= i.rank, true) AS passes FROM p LEFT JOIN r g ON g.demand = generated LEFT JOIN r i ON i.demand = intended""")
def v06(spark, sf):
    wanted = F.get(F.array(*[F.lit(x) for x in ("RECALL", "UNDERSTANDING", "APPLICATION", "ANALYSIS", "PROCEDURAL")]), (F.col("item_id") % 5).cast("int"))
    p = _wording(spark, sf).select("item_id", wanted.alias("intended"), X.cognitive_demand(F.col("stem")).alias("generated"))
    return p.withColumn("passes", F.coalesce(X.demand_rank(F.col("generated")) >= X.demand_rank(F.col("intended")), F.lit(True)))
