"""Queries of paper structure (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import documents as D
from heronlake.operators import spec as B
from heronlake.plans.base import query
from heronlake.plans.tables import SQL, by_slot, item_rows, page_text, papers, slot_items, slots, table, units, with_tables

_S, _I = "slots", "slot_items"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_STEMS = ["What is the 2x5=10", "Match the following 4+1", "State whether true or false 5", "Fill in the blanks ____ 3x3=9", "Explain the water cycle (any two)", "Draw a diagram of a leaf attempt any 5", "Name the parts 12 marks", "Differentiate between a and b", "Ordinary statement 2024", ""]


def _stems(spark, sf):
    n = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.get(F.array(*[F.lit(s) for s in _STEMS]), (n % len(_STEMS)).cast("int")).alias("stem"), F.when(n % 3 == 0, (n % 7).cast("double")).alias("per"), (n % 9).cast("double").alias("total"))


_STEM = f"(SELECT p_partkey, {_list(_STEMS)}[p_partkey % {len(_STEMS)} + 1] AS stem, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 7 AS DOUBLE) END AS per, CAST(p_partkey % 9 AS DOUBLE) AS total FROM part)"
_KIND = "CASE WHEN trim(stem) = '' THEN 'UNKNOWN' " + " ".join(f"WHEN regexp_matches(trim(stem), '{p}') THEN '{t}'" for p, t in B.SLOT_PATTERNS) + " WHEN regexp_matches(trim(stem), '(?i)^(?:what|which|why|how|who|when|where|name|give|list|state|write|mention)\\b|answer the following|describe|narrate') THEN CASE WHEN coalesce(per >= 4, total >= 5, false) THEN 'LONG_ANSWER' ELSE 'SHORT_ANSWER' END ELSE 'UNKNOWN' END"


@query("b03_classify_slot_type", sql=f"SELECT p_partkey, {_KIND} AS type FROM {_STEM}")
def b03(spark, sf):
    return _stems(spark, sf).select("p_partkey", B.classify_slot_type(F.col("stem"), F.col("per"), F.col("total")).alias("type"))


@query("b04_answer_form", sql=f"SELECT p_partkey, CASE {_KIND} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.ANSWER_FORMS.items()) + f" ELSE 'SENTENCES' END AS form FROM {_STEM}")
def b04(spark, sf):
    return _stems(spark, sf).select("p_partkey", B.answer_form(B.classify_slot_type(F.col("stem"), F.col("per"), F.col("total"))).alias("form"))


_EXPR = r"""SELECT p_partkey, CASE WHEN a[1] > 0 AND a[2] > 0 AND a[3] > 0 THEN a WHEN p > 0 THEN [p, 1, p] WHEN b BETWEEN 1 AND 25 THEN [b, 1, b] END AS m FROM (SELECT p_partkey,
    [TRY_CAST(regexp_extract(stem, '(\d+(?:\.\d+)?)\s*[xX×*]\s*(\d+)\s*=\s*(\d+)', 1) AS DOUBLE), TRY_CAST(regexp_extract(stem, '(\d+(?:\.\d+)?)\s*[xX×*]\s*(\d+)\s*=\s*(\d+)', 2) AS DOUBLE), TRY_CAST(regexp_extract(stem, '(\d+(?:\.\d+)?)\s*[xX×*]\s*(\d+)\s*=\s*(\d+)', 3) AS DOUBLE)] AS a,
    TRY_CAST(regexp_extract(stem, '(\d+)\s*\+\s*(\d+)', 1) AS DOUBLE) + TRY_CAST(regexp_extract(stem, '(\d+)\s*\+\s*(\d+)', 2) AS DOUBLE) AS p, TRY_CAST(regexp_extract(stem, '(?i)(?:^|\s)(\d{1,2})(?:\s*marks?)?\s*$', 1) AS DOUBLE) AS b FROM """ + _STEM + ")"


@query("b06_parse_marks_expression", sql=f"SELECT p_partkey, m[1] AS per, m[2] AS count, m[3] AS total FROM ({_EXPR})")
def b06(spark, sf):
    return _stems(spark, sf).select("p_partkey", B.parse_marks_expression(F.col("stem")).alias("m")).select("p_partkey", "m.per", "m.count", "m.total")


@query("b07_parse_optional_rule", sql=f"SELECT p_partkey, CASE WHEN contains(stem, 'any two') THEN 2 WHEN contains(stem, 'any 5') THEN 5 END AS n FROM {_STEM}")
def b07(spark, sf):
    return _stems(spark, sf).select("p_partkey", B.parse_optional_rule(F.col("stem")).alias("n"))


@query("b05_group_slots", sql=with_tables(_I, then="""
    , q AS (SELECT paper_id, slot_id * 100 + item_index AS ord, 'Q' || number AS parent, item_index % 3 = 0 AS sub, reference_text AS text, CASE WHEN item_index % 2 = 0 THEN 'A' END AS section, marks > 25 AS has_marks, part_id % 3 AS n_parts FROM slot_items),
    m AS (SELECT *, round(CASE WHEN has_marks THEN 2.0 ELSE 0 END + CASE WHEN n_parts > 0 THEN 1.0 ELSE 0 END + CASE WHEN section IS NOT NULL THEN 1.0 ELSE 0 END + least(length(text) / 60.0, 0.5), 6) AS richness FROM q WHERE NOT sub),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY paper_id, parent ORDER BY richness DESC, ord) = 1), i AS (SELECT paper_id, parent, count(*) AS n FROM q WHERE sub GROUP BY ALL)
    SELECT coalesce(b.paper_id, i.paper_id) AS paper_id, coalesce(b.parent, i.parent) AS parent, row_number() OVER (PARTITION BY coalesce(b.paper_id, i.paper_id) ORDER BY CAST(substr(coalesce(b.parent, i.parent), 2) AS BIGINT)) AS position, b.text, b.section, b.richness, coalesce(i.n, 0) AS n_items, b.ord IS NULL AS made FROM b FULL JOIN i ON b.paper_id = i.paper_id AND b.parent = i.parent"""))
def b05(spark, sf):
    i = slot_items(spark, sf)
    n = F.concat(F.lit("Q"), F.col("number").cast("string"))
    q = i.select("paper_id", (F.col("slot_id") * 100 + F.col("item_index")).alias("ord"), F.when(F.col("item_index") % 3 == 0, F.concat(n, F.lit("(a)"))).otherwise(n).alias("question_number"), F.col("reference_text").alias("text"), F.when(F.col("item_index") % 2 == 0, "A").alias("section"), (F.col("marks") > 25).alias("has_marks"), (F.col("part_id") % 3).alias("n_parts"))
    return B.group_slots(q)


_ITEMS_NULL = "it AS (SELECT paper_id, slot_id, item_index, number, CASE WHEN part_id % 10 <> 0 THEN marks END AS marks, part_id % 3 AS option_count FROM slot_items)"


def _items_null(spark, sf):
    return slot_items(spark, sf).select("paper_id", "slot_id", "item_index", "number", F.when(F.col("part_id") % 10 != 0, F.col("marks")).alias("marks"), (F.col("part_id") % 3).alias("option_count"))


@query("b08_slot_marks", sql=with_tables(_S, _I, then=f", {_ITEMS_NULL}, g AS (SELECT slot_id, sum(marks) AS s, count(*) AS n, min(marks) AS lo, max(marks) AS hi, count(*) - count(marks) AS u FROM it GROUP BY 1), t AS (SELECT slot_id, coalesce(CASE WHEN slot_id % 5 = 0 THEN 30.0 END, CASE WHEN u = 0 THEN s END, total_marks) AS total, n, lo, hi FROM slots LEFT JOIN g USING (slot_id)) SELECT slot_id, round(total, 1) AS total, round(CASE WHEN lo = hi THEN lo WHEN n IS NOT NULL AND total % n = 0 THEN total / n END, 4) AS per_item, coalesce(n, 0) AS n_items FROM t"))
def b08(spark, sf):
    return B.slot_marks(slots(spark, sf).withColumn("expression_total", F.when(F.col("slot_id") % 5 == 0, 30.0)), _items_null(spark, sf))


@query("b09_derive_mixed_type", sql=with_tables(_I, then=", t AS (SELECT slot_id, CASE WHEN part_id % 4 = 0 THEN 'UNKNOWN' ELSE type END AS type FROM slot_items) SELECT slot_id, CASE count(DISTINCT type) FILTER (type <> 'UNKNOWN') WHEN 0 THEN NULL WHEN 1 THEN any_value(type) FILTER (type <> 'UNKNOWN') ELSE 'MIXED' END AS type FROM t GROUP BY slot_id"))
def b09(spark, sf):
    return B.derive_mixed_type(slot_items(spark, sf).withColumn("type", F.when(F.col("part_id") % 4 == 0, "UNKNOWN").otherwise(F.col("type"))))


_LABELS = ["mcq", " Multiple choice ", "true or false", "Fill in the blank type", "match", "VSA", "Long answer", "differentiate", "Draw a diagram", "story-writing", "choose any", "???", "map work"]
_MEANT = ["MCQ", "MCQ", "TRUE_FALSE", "FILL_IN_THE_BLANK", "MATCH_THE_FOLLOWING", "VERY_SHORT_ANSWER", "LONG_ANSWER", "DIFFERENTIATE", "DIAGRAM", "CREATIVE_WRITING", "INTERNAL_CHOICE", "UNKNOWN", "MAP"]


@query("b10_normalize_type", sql=f"SELECT p_partkey, {_list(_MEANT)}[p_partkey % {len(_LABELS)} + 1] AS type FROM part")
def b10(spark, sf):
    label = F.get(F.array(*[F.lit(s) for s in _LABELS]), (F.col("p_partkey") % len(_LABELS)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", B.normalize_type(label).alias("type"))


@query("b11_build_sections", sql=with_tables(_S, then="SELECT paper_id, section, min(slot_index) AS first_slot, count(*) AS n, sum(total_marks) AS marks, row_number() OVER (PARTITION BY paper_id ORDER BY min(slot_index)) AS ord FROM slots GROUP BY paper_id, section"))
def b11(spark, sf):
    return B.build_sections(slots(spark, sf))


@query("b12_normalize_slots", sql=with_tables(_S, then="SELECT slot_id, CASE WHEN slot_id % 3 = 0 THEN NULL ELSE total_marks END AS total_marks, least(slot_id % 40, 26) AS items, CASE WHEN slot_id % 40 > 0 THEN chr(CAST(96 + least(slot_id % 40, 26) AS INTEGER)) END AS last_label FROM slots WHERE NOT (slot_id % 3 = 0 AND slot_id % 2 = 0)"))
def b12(spark, sf):
    i = F.col("slot_id")
    raw = slots(spark, sf).withColumns({"type": F.when(i % 2 == 0, "UNKNOWN").otherwise("MCQ"), "stem": F.when(i % 3 == 0, " ").otherwise("Name it"), "total_marks": F.when(i % 3 != 0, F.col("total_marks"))})
    raw = raw.withColumn("items", F.when(i % 40 == 0, F.array().cast("array<struct<text string, marks double>>")).otherwise(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), i % 40)), lambda k: F.struct(F.repeat(F.lit("x"), 300).alias("text"), (k / 3.0).alias("marks")))))
    return B.normalize_slots(raw).select("slot_id", "total_marks", F.size("items").cast("long").alias("items"), F.try_element_at("items", F.lit(-1))["label"].alias("last_label"))


_DIAG = f"""
    {_ITEMS_NULL}, sl AS (SELECT paper_id, slot_id, section, slot_index, declared_items, CASE WHEN slot_id % 6 <> 0 THEN total_marks END AS total_marks FROM slots),
    g AS (SELECT slot_id, count(*) AS n, round(sum(marks), 1) AS s, count(marks) AS known, count(DISTINCT option_count) AS opts FROM it GROUP BY 1),
    s AS (SELECT sl.*, coalesce(g.n, 0) AS n, g.s, coalesce(g.known, 0) AS known, g.opts FROM sl LEFT JOIN g USING (slot_id)),
    steps AS (SELECT *, lag(number) OVER (PARTITION BY slot_id ORDER BY number) AS b FROM (SELECT DISTINCT paper_id, slot_id, number FROM it)),
    per AS (SELECT paper_id, round(sum(total_marks), 1) AS s, count(*) AS n FROM sl GROUP BY 1),
    diag AS (
      SELECT paper_id, slot_id, 'DECLARED_ITEMS_MISMATCH' AS code, 'warning' AS severity, CAST(declared_items AS DOUBLE) AS expected, CAST(n AS DOUBLE) AS found FROM s WHERE declared_items > 0 AND n < declared_items
      UNION ALL SELECT paper_id, slot_id, 'RECOVERED_ITEMS_EXCEED_DECLARED', 'warning', declared_items, n FROM s WHERE declared_items > 0 AND n > declared_items
      UNION ALL SELECT paper_id, slot_id, 'ITEM_MARKS_SUM_MISMATCH', 'error', total_marks, s FROM s WHERE known = n AND n > 0 AND s <> total_marks
      UNION ALL SELECT paper_id, slot_id, 'PER_ITEM_MARKS_PARTIAL', 'warning', n, known FROM s WHERE known > 0 AND known < n
      UNION ALL SELECT paper_id, slot_id, 'MARKS_UNKNOWN', 'warning', NULL, NULL FROM s WHERE total_marks IS NULL AND known = 0
      UNION ALL SELECT paper_id, slot_id, 'OPTION_COUNT_INCONSISTENT', 'warning', 1, opts FROM s WHERE opts > 1
      UNION ALL SELECT paper_id, slot_id, 'NUMBERING_GAP', 'warning', b + 1, number FROM steps WHERE number - b > 1
      UNION ALL SELECT paper_id, slot_id, 'DUPLICATE_QUESTION_NUMBER', 'error', 1, count(*) FROM it GROUP BY paper_id, slot_id, number HAVING count(*) > 1
      UNION ALL SELECT p.paper_id, NULL, 'PAPER_MARKS_TOTAL_MISMATCH', 'error', declared_total, s FROM papers p JOIN per USING (paper_id) WHERE declared_total <> s
      UNION ALL SELECT p.paper_id, NULL, 'NO_QUESTIONS_EXTRACTED', 'error', NULL, 0 FROM papers p LEFT JOIN per USING (paper_id) WHERE per.n IS NULL)"""


def _diag_slots(spark, sf):
    return slots(spark, sf).withColumn("total_marks", F.when(F.col("slot_id") % 6 != 0, F.col("total_marks")))


def _diagnostics(spark, sf):
    return B.reconcile(papers(spark, sf), _diag_slots(spark, sf), _items_null(spark, sf))


@query("b13_reconcile", sql=with_tables("papers", _S, _I, then=f", {_DIAG} SELECT * FROM diag"))
def b13(spark, sf):
    return _diagnostics(spark, sf)


@query("b14_pad_missing_items", sql=with_tables(_S, _I, then=", w AS (SELECT slot_id, unnest(range(1, declared_items + 1)) AS item_index FROM slots WHERE declared_items > 0) SELECT coalesce(w.slot_id, i.slot_id) AS slot_id, coalesce(w.item_index, i.item_index) AS item_index, i.reference_text, i.slot_id IS NOT NULL AS recovered FROM w FULL JOIN slot_items i ON i.slot_id = w.slot_id AND i.item_index = w.item_index"))
def b14(spark, sf):
    return B.pad_missing_items(by_slot(spark, sf, slots(spark, sf)), slot_items(spark, sf), item_rows(spark, sf))


_CONF = ", d AS (SELECT paper_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w FROM diag GROUP BY 1), n AS (SELECT paper_id, count(*) AS n, count(*) - count(total_marks) AS u FROM sl GROUP BY 1)"


@query("b15_confidence", sql=with_tables("papers", _S, _I, then=f", {_DIAG}{_CONF} SELECT paper_id, CASE WHEN coalesce(n, 0) = 0 OR coalesce(e, 0) > 0 THEN 'low' WHEN coalesce(w, 0) > 0 OR u > 0 THEN 'medium' ELSE 'high' END AS confidence, coalesce(e, 0) AS errors, coalesce(w, 0) AS warnings FROM papers LEFT JOIN n USING (paper_id) LEFT JOIN d USING (paper_id)"))
def b15(spark, sf):
    return B.confidence(papers(spark, sf), _diag_slots(spark, sf), _diagnostics(spark, sf))


@query("b16_detect_unit_topic", sql=with_tables(_S, then="SELECT slot_id, CASE WHEN slot_id % 5 = 0 THEN 'unit 9' WHEN slot_id % 3 = 0 THEN 'chapter ' || (slot_id % 7) WHEN locked THEN 'unit 2' END AS unit, CASE WHEN slot_id % 3 = 0 THEN 'From Chapter ' || (slot_id % 7) || ' name it' WHEN slot_id % 4 <> 0 THEN 'Name it' END AS topic, CASE WHEN slot_id % 5 = 0 OR slot_id % 3 = 0 THEN 'HIGH' WHEN locked OR slot_id % 4 <> 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, slot_id % 5 <> 0 AND slot_id % 3 <> 0 AND NOT locked AND slot_id % 4 = 0 AND slot_id % 2 = 0 AS review FROM slots"))
def b16(spark, sf):
    i = F.col("slot_id")
    s = slots(spark, sf).select("slot_id", "locked", F.when(i % 5 == 0, "unit 9").alias("explicit_unit"), F.when(i % 3 == 0, F.concat(F.lit("From Chapter "), (i % 7).cast("string"), F.lit(" name it"))).when(i % 4 != 0, "Name it").alias("text"), F.lit("Paper on Unit 2").alias("paper_text"), (i % 2 == 0).alias("image"))
    return B.detect_unit_topic(s)


@query("b18_paper_summary", sql=with_tables("papers", _S, _I, then=f", {_DIAG} SELECT paper_id, count(DISTINCT section) AS sections, count(*) AS slots, (SELECT count(*) FROM diag d WHERE d.paper_id = sl.paper_id AND severity = 'error') AS errors, (SELECT count(*) FROM diag d WHERE d.paper_id = sl.paper_id AND severity = 'warning') AS warnings FROM sl GROUP BY paper_id"))
def b18(spark, sf):
    return B.paper_summary(_diag_slots(spark, sf), _diagnostics(spark, sf))


_AS = "am AS (SELECT slot_id AS asset_id, paper_id AS document_id, CAST(slot_id % 3 + 1 AS INTEGER) AS page_number, CAST(slot_id * 37 % 800 AS DOUBLE) AS mid_y FROM slots WHERE slot_id % 4 = 0), mk AS (SELECT slot_id, paper_id AS document_id, CAST(slot_id % 3 + 1 AS INTEGER) AS page_number, CAST(slot_id * 53 % 800 AS DOUBLE) AS mid_y FROM slots)"


def _assets(spark, sf):
    i = F.col("slot_id")
    page = (i % 3 + 1).cast("int").alias("page_number")
    s = slots(spark, sf)
    a = s.where(i % 4 == 0).select(i.alias("asset_id"), F.col("paper_id").alias("document_id"), page, (i * 37 % 800).cast("double").alias("mid_y"), F.lit(800.0).alias("height"))
    return a, s.select("slot_id", F.col("paper_id").alias("document_id"), page, (i * 53 % 800).cast("double").alias("mid_y"))


@query("b19_associate_assets", sql=with_tables(_S, then=f""", {_AS}, met AS (SELECT asset_id, slot_id, round((a.mid_y - m.mid_y) / 800, 6) AS distance FROM am a JOIN mk m USING (document_id, page_number) WHERE m.mid_y <= a.mid_y AND round((a.mid_y - m.mid_y) / 800, 6) <= 0.55),
    b AS (SELECT *, lead(distance) OVER w AS nx, row_number() OVER w AS k FROM met WINDOW w AS (PARTITION BY asset_id ORDER BY distance, slot_id))
    SELECT a.asset_id, b.slot_id, b.distance, CASE WHEN b.asset_id IS NULL THEN 'UNASSOCIATED' WHEN coalesce(nx - distance < 0.12, false) THEN 'LOW' WHEN distance <= 0.2 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM am a LEFT JOIN b ON a.asset_id = b.asset_id AND k = 1"""))
def b19(spark, sf):
    return B.associate_assets(*_assets(spark, sf))


@query("b20_image_layout", sql="SELECT l_orderkey AS asset_id, l_linenumber AS n, (w * h) < 0.005 * 600 * 800 OR y1 < 48 OR y0 > 752 AS decorative, CASE WHEN (x0 + x1) / 2 / 600 < 0.38 THEN 'left' WHEN (x0 + x1) / 2 / 600 > 0.62 THEN 'right' ELSE 'center' END AS alignment, round(greatest(0.1, least(1.0, w / 600)), 4) AS width_ratio FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM (SELECT l_orderkey, l_linenumber, l_suppkey * 4.0 AS x0, l_suppkey * 4.0 + l_quantity * 4 AS x1, CAST(l_partkey % 780 AS DOUBLE) AS y0, l_partkey % 780 + l_quantity AS y1 FROM lineitem))")
def b20(spark, sf):
    l = table(spark, sf, "lineitem")
    x0, y0 = F.col("l_suppkey") * 4.0, (F.col("l_partkey") % 780).cast("double")
    a = l.select(F.struct("l_orderkey", "l_linenumber").alias("asset_id"), x0.alias("x0"), (x0 + F.col("l_quantity") * 4).alias("x1"), y0.alias("y0"), (y0 + F.col("l_quantity")).alias("y1"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return B.image_layout(a).select(F.col("asset_id.l_orderkey").alias("asset_id"), F.col("asset_id.l_linenumber").alias("n"), "decorative", "alignment", "width_ratio")


@query("b21_validate_assets", sql=with_tables(_S, then=", a AS (SELECT paper_id AS document_id, CAST(slot_id % 5 AS INTEGER) AS page_number, slot_id % 50 AS ord FROM slots) SELECT DISTINCT document_id, 'page_out_of_range' AS issue FROM a WHERE page_number < 1 OR page_number > 3 UNION ALL SELECT document_id, 'order_not_unique' FROM a GROUP BY 1 HAVING count(*) <> count(DISTINCT ord)"))
def b21(spark, sf):
    i = F.col("slot_id")
    a = slots(spark, sf).select(F.col("paper_id").alias("document_id"), (i % 5).cast("int").alias("page_number"), (i % 50).alias("ord"))
    pages = a.select("document_id").distinct().withColumn("page_number", F.lit(3))
    return B.validate_assets(a, pages)


@query("b22_dominant_style", sql=with_tables(_I, then=""", l AS (SELECT paper_id, CASE part_id % 4 WHEN 0 THEN 'Q' || number WHEN 1 THEN number || '.' WHEN 2 THEN '(' || number || ')' ELSE 'note' END AS label, CASE part_id % 4 WHEN 0 THEN 'Q_NUMBER' WHEN 1 THEN 'NUMBER_DOT' WHEN 2 THEN 'PARENTHESES' END AS style FROM slot_items),
    g AS (SELECT paper_id, style, count(*) AS n, min(label) AS sample FROM l WHERE style IS NOT NULL GROUP BY ALL) SELECT paper_id, style, sample, round(n / sum(n) OVER (PARTITION BY paper_id), 6) AS confidence FROM g QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, style) = 1"""))
def b22(spark, sf):
    n, k = F.col("number").cast("string"), F.col("part_id") % 4
    label = F.when(k == 0, F.concat(F.lit("Q"), n)).when(k == 1, F.concat(n, F.lit("."))).when(k == 2, F.concat(F.lit("("), n, F.lit(")"))).otherwise("note")
    return B.dominant_style(slot_items(spark, sf).select("paper_id", label.alias("label")))


@query("b23_page_furniture", sql=with_tables("page_text", then=r""", p AS (SELECT document_id, page_number, 'Head ' || document_id AS head, CASE WHEN page_number % 4 <> 0 THEN true ELSE false END AS foot FROM page_text) SELECT document_id, count(*) AS pages, count(*) > 1 AS repeats_header, avg(CASE WHEN foot THEN 1 ELSE 0 END) >= 0.7 AS numbers_pages FROM p GROUP BY document_id"""))
def b23(spark, sf):
    n = F.col("page_number")
    foot = F.when(n % 4 != 0, F.concat(F.lit("\nPage "), n.cast("string"))).otherwise("\nend")
    p = page_text(spark, sf).withColumn("text", F.concat(F.lit("Head "), F.col("document_id").cast("string"), F.lit("\n"), "text", foot))
    return D.page_furniture(p)


@query("b25_validate_spec", sql=with_tables(_S, _I, then=""", sec AS (SELECT DISTINCT paper_id, section FROM slots WHERE section <> '5' UNION ALL SELECT DISTINCT paper_id, 'Z' FROM slots WHERE paper_id % 10 = 0), g AS (SELECT slot_id, count(*) AS n, round(sum(marks), 1) AS s FROM slot_items GROUP BY 1), s AS (SELECT slots.*, n, s FROM slots LEFT JOIN g USING (slot_id))
    SELECT paper_id, slot_id, 'empty' AS issue FROM s WHERE n IS NULL UNION ALL SELECT paper_id, slot_id, 'item_count' FROM s WHERE declared_items > 0 AND coalesce(n, 0) <> declared_items UNION ALL SELECT paper_id, slot_id, 'item_sum' FROM s WHERE n > 0 AND s <> total_marks
    UNION ALL SELECT paper_id, slot_id, 'unknown_section' FROM slots WHERE section = '5' UNION ALL SELECT DISTINCT paper_id, NULL, 'orphan_section' FROM slots WHERE paper_id % 10 = 0"""))
def b25(spark, sf):
    s = slots(spark, sf)
    sec = s.where("section <> '5'").select("paper_id", "section").distinct().union(s.where("paper_id % 10 = 0").select("paper_id", F.lit("Z")).distinct())
    return B.validate_spec(s, slot_items(spark, sf), sec)


_ASSIGN = "a AS (SELECT slot_id, NULL::BIGINT AS item_index, CASE WHEN slot_id % 25 = 0 THEN ' ' ELSE 'Brand#' || (slot_id % 20 + 1) END AS unit FROM slots WHERE slot_id % 10 <> 0 UNION ALL SELECT slot_id, item_index, 'Brand#' || (item_index % 3 + 1) FROM slot_items WHERE slot_id % 9 = 0 UNION ALL SELECT 9999999, NULL, 'Brand#1' UNION ALL SELECT slot_id, 99, 'Brand#1' FROM slots WHERE slot_id % 90 = 0)"


def _assignments(spark, sf):
    s, i = slots(spark, sf), slot_items(spark, sf)
    none = F.lit(None).cast("long")
    a = s.where("slot_id % 10 <> 0").select("slot_id", none.alias("item_index"), F.when(F.col("slot_id") % 25 == 0, " ").otherwise(F.concat(F.lit("Brand#"), (F.col("slot_id") % 20 + 1).cast("string"))).alias("unit"))
    a = a.union(i.where("slot_id % 9 = 0").select("slot_id", "item_index", F.concat(F.lit("Brand#"), (F.col("item_index") % 3 + 1).cast("string"))))
    a = a.union(s.limit(1).select(F.lit(9999999).cast("long"), none, F.lit("Brand#1")))
    return by_slot(spark, sf, a.union(s.where("slot_id % 90 = 0").select("slot_id", F.lit(99).cast("long"), F.lit("Brand#1"))))


@query("b26_validate_assignments", sql=with_tables(_S, _I, "units", then=f""", {_ASSIGN}, g AS (SELECT slot_id, count(*) FILTER (item_index IS NULL) AS w, count(item_index) AS sp, count(*) FILTER (trim(unit) = '') AS bl FROM a GROUP BY 1), j AS (SELECT coalesce(s.slot_id, g.slot_id) AS slot_id, locked, w, sp, bl FROM slots s FULL JOIN g ON g.slot_id = s.slot_id)
    SELECT slot_id, 'unknown_slot' AS issue FROM j WHERE locked IS NULL UNION ALL SELECT slot_id, 'missing_slot' FROM j WHERE w IS NULL UNION ALL SELECT slot_id, 'unit_or_items' FROM j WHERE w IS NOT NULL AND (w > 0) = (sp > 0) UNION ALL SELECT slot_id, 'locked_split' FROM j WHERE locked AND sp > 0 UNION ALL SELECT slot_id, 'blank_unit' FROM j WHERE bl > 0
    UNION ALL SELECT slot_id, 'unknown_item' FROM a WHERE item_index = 99 UNION ALL SELECT DISTINCT slot_id, 'unit_without_notes' FROM a WHERE trim(unit) <> '' AND unit NOT IN (SELECT unit FROM units WHERE unit <> 'Brand#7')"""))
def b26(spark, sf):
    return B.validate_assignments(by_slot(spark, sf, slots(spark, sf)), slot_items(spark, sf), _assignments(spark, sf), units(spark, sf).where("unit <> 'Brand#7'"), item_rows(spark, sf))


@query("b27_default_assign", sql=with_tables(_S, "units", then=", p AS (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS k, count(*) OVER () AS n FROM units), f AS (SELECT paper_id, slot_id, row_number() OVER (PARTITION BY paper_id ORDER BY slot_index) - 1 AS i FROM slots WHERE slot_id % 6 <> 0) SELECT paper_id, slot_id, unit FROM f JOIN p ON i % n = k UNION ALL SELECT paper_id, slot_id, 'Brand#' || (slot_id % 20 + 1) FROM slots WHERE slot_id % 6 = 0"))
def b27(spark, sf):
    s = slots(spark, sf).withColumn("own_unit", F.when(F.col("slot_id") % 6 == 0, F.concat(F.lit(" BRAND#"), (F.col("slot_id") % 20 + 1).cast("string"))).otherwise("Brand#99"))
    return B.default_assign(s, units(spark, sf))


@query("b28_slot_unit_map", sql=with_tables(_S, _I, then=f", {_ASSIGN} SELECT slot_id, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS unit, CASE WHEN count(DISTINCT unit) > 1 THEN count(*) END AS n FROM a GROUP BY slot_id"))
def b28(spark, sf):
    return B.slot_unit_map(_assignments(spark, sf)).select("slot_id", "unit", F.when(F.col("items").isNotNull(), F.size("items")).alias("n"))


@query("b29_marks_per_unit", sql=with_tables(_S, _I, "units", then=f", {_ITEMS_NULL}, {_ASSIGN}, o AS (SELECT slot_id, item_index, unit AS iu FROM a WHERE item_index IS NOT NULL), w AS (SELECT slot_id, unit AS su FROM a WHERE item_index IS NULL), g AS (SELECT coalesce(iu, su) AS unit, round(sum(marks), 1) AS marks, count(*) - count(marks) AS unknown FROM it LEFT JOIN o USING (slot_id, item_index) LEFT JOIN w USING (slot_id) GROUP BY 1) SELECT * FROM g UNION ALL SELECT unit, 0.0, 0 FROM units WHERE unit NOT IN (SELECT unit FROM g WHERE unit IS NOT NULL)"))
def b29(spark, sf):
    return B.marks_per_unit(_items_null(spark, sf), _assignments(spark, sf), units(spark, sf), item_rows(spark, sf))


@query("b30_total_drift", sql=with_tables("papers", _S, _I, then=f", {_ITEMS_NULL}, g AS (SELECT slot_id, CASE WHEN count(marks) = count(*) THEN sum(marks) END AS s FROM it GROUP BY 1), t AS (SELECT paper_id, round(sum(coalesce(s, total_marks)), 1) AS total FROM slots LEFT JOIN g USING (slot_id) GROUP BY 1) SELECT paper_id, declared_total, total, declared_total <> total AS drifted FROM papers JOIN t USING (paper_id)"))
def b30(spark, sf):
    return B.total_drift(papers(spark, sf), slots(spark, sf), _items_null(spark, sf))


def _head(spark, sf):
    i = F.col("doc_id").cast("string")
    head = F.concat(F.lit("Green School "), i, F.lit("\nClass: 8 Session 2023-24\nSubject: Science\nTime: 3 hours  Maximum Marks: "), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("\nGeneral Instructions:\nAnswer all.\nWrite neatly.\n\nNo books.\nSection A\nAfter.\n"), "text")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), head.alias("text"))


@query("b01_paper_header", sql="SELECT doc_id AS document_id, '8' AS class, 'Science' AS subject, '3 hours  Maximum Marks: ' || (doc_id % 90 + 10) AS duration, CAST(doc_id % 90 + 10 AS INTEGER) AS maximum_marks, '2023-24' AS session, 'Green School ' || doc_id AS school FROM documents")
def b01(spark, sf):
    return B.paper_header(_head(spark, sf))


@query("b02_paper_instructions", sql="SELECT doc_id AS document_id, i AS ord, ['Answer all.', 'Write neatly.', 'No books.'][i] AS line FROM documents, range(1, 4) r(i)")
def b02(spark, sf):
    return B.paper_instructions(_head(spark, sf))


_FORM = "f AS (SELECT o_orderkey AS slot_id, o_orderkey % 4 AS n, CASE WHEN o_orderkey % 7 = 0 THEN 'strange' WHEN o_orderkey % 2 = 0 THEN 'mcq' ELSE 'short answer' END AS type, o_orderkey % 3 AS oc, o_orderkey % 5 = 0 AS per, o_orderkey % 6 AS total FROM orders)"


def _form(spark, sf):
    i = F.col("o_orderkey")
    kind = F.when(i % 7 == 0, "strange").when(i % 2 == 0, "mcq").otherwise("short answer")
    return table(spark, sf, "orders").select(i.alias("slot_id"), kind.alias("type"), (i % 4).cast("int").alias("item_count"), (i % 3).cast("int").alias("option_count"), F.lit("Easy").alias("difficulty"), F.when(i % 5 == 0, "perItem").otherwise("whole").alias("mode"), F.array(F.lit(1.0), F.lit(2.0)).alias("values"), (i % 6).cast("double").alias("total"))


@query("b31_build_from_form", sql=f"WITH {_FORM} SELECT slot_id, CASE WHEN slot_id % 7 = 0 THEN 'UNKNOWN' WHEN slot_id % 2 = 0 THEN 'MCQ' ELSE 'SHORT_ANSWER' END AS type, n AS items, CASE WHEN per THEN 1.0 WHEN total % n = 0 THEN total / n::DOUBLE END AS first_marks, CASE WHEN per THEN 3.0 ELSE total END AS total_marks FROM f WHERE n >= 1")
def b31(spark, sf):
    made, _ = B.build_from_form(_form(spark, sf))
    return made.select("slot_id", "type", F.size("items").alias("items"), F.get("items", 0)["marks"].alias("first_marks"), "total_marks")


@query("b31_form_errors", sql=f"WITH {_FORM} SELECT slot_id, 'item_count' AS error FROM f WHERE n < 1 UNION ALL SELECT slot_id, 'type' FROM f WHERE slot_id % 7 = 0 UNION ALL SELECT slot_id, 'marks_count' FROM f WHERE per AND n <> 2 UNION ALL SELECT slot_id, 'total' FROM f WHERE NOT per AND total = 0 UNION ALL SELECT slot_id, 'options' FROM f WHERE slot_id % 7 <> 0 AND slot_id % 2 = 0 AND oc < 2")
def b31e(spark, sf):
    return B.build_from_form(_form(spark, sf))[1]
