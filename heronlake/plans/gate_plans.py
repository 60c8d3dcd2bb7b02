"""Queries of quality gates, scoring and accounting (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.functions import text as X
from heronlake.operators import gates as V
from heronlake.operators import novelty as N
from heronlake.operators.retrieval import dense_search
from heronlake.plans.base import query
from heronlake.functions.text import canonical_scope, overlap_min
from heronlake.plans.novelty_plans import _demand
from heronlake.plans.tables import candidates, chunks, past_items, ref_items, slot_items, slots, table, with_tables
from heronlake.plans.text_plans import _DEMAND, _TRIGGER, terms_sql
from heronlake.sources.staging import written

_FRAME_WORDS = "[" + ", ".join(f"'{w}'" for w in V.IMAGE_WORDS) + "]"
_NORM = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"


def _items(spark, sf):
    """Assistant turns as items, broken in many ways by their place."""
    k = F.col("paper_id") % 7
    c = candidates(spark, sf)
    text = F.when(k == 0, " ").when(k == 1, "undefined is this value here").when(k == 2, "a stem that ends,").when(k == 3, "Which of the these these things?").otherwise(F.col("text"))
    return c.withColumns({"text": text, "difficulty": F.when(F.col("slot_index") % 4 == 3, "").otherwise("Easy"), "marks": F.when(F.col("paper_id") % 5 == 0, 0.0).otherwise(F.col("marks")), "marks_unknown": F.col("paper_id") % 10 == 0, "n_options": (F.col("paper_id") % 6).cast("int"), "n_parts": (F.col("paper_id") % 3).cast("int")})


_ITEMS = "items AS (SELECT question_id, paper_id, slot_index, type, attempts, embedding, CASE paper_id % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'undefined is this value here' WHEN 2 THEN 'a stem that ends,' WHEN 3 THEN 'Which of the these these things?' ELSE text END AS text, CASE WHEN slot_index % 4 = 3 THEN '' ELSE 'Easy' END AS difficulty, CASE WHEN paper_id % 5 = 0 THEN 0.0 ELSE marks END AS marks, paper_id % 10 = 0 AS marks_unknown, paper_id % 6 AS n_options, paper_id % 3 AS n_parts FROM candidates)"


def _sql(then: str, *more: str) -> str:
    return with_tables("candidates", *more, then=f", {_ITEMS} {then}")


def _reasons(*rules: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in rules) + "], lambda x: x IS NOT NULL)"


_BASIC = _reasons(
    ("length(trim(text)) < 5", "empty"),
    (r"length(regexp_replace(trim(text), '\W', '', 'g')) < 10 AND type NOT IN ('MCQ', 'TRUE_FALSE', 'FILL_IN_THE_BLANK')", "too_short"),
    (r"regexp_matches(trim(text), 'SyntaxError|TypeError|ReferenceError|JSON\.parse|Unexpected token') OR regexp_matches(trim(text), '(?:^|\W)(?:undefined|null|\[object Object\])(?:\W|$)')", "placeholder"),
    (r"regexp_matches(trim(text), '[,;:\-]$')", "abrupt_end"),
    ("NOT marks > 0 AND NOT marks_unknown", "marks"),
    ("difficulty = ''", "difficulty"),
    (f"question_id <> min(question_id) OVER (PARTITION BY paper_id, {_NORM})", "duplicate"),
)


@query("v01_basic_checks", sql=_sql(f"SELECT question_id, {_BASIC} AS reasons FROM items"))
def v01(spark, sf):
    return V.basic_checks(_items(spark, sf)).select("question_id", "reasons")


_FRAME = r"regexp_matches(trim(text), '(?i)\?|_{2,}|^(what|which|who|why|how|when|where|name|list|state|define|explain|describe|write|give|find|identify|choose|compare|draw|solve|calculate)\b')"


@query("v02_answerability", sql=_sql(f"SELECT question_id, {_reasons(('trim(text) = ' + chr(39) * 2, 'empty_stem'), ('type = ' + repr('MCQ') + ' AND n_options < 2', 'options'))} AS hard, {_reasons(('trim(text) <> ' + chr(39) * 2 + ' AND NOT ' + _FRAME, 'no_task_frame'), ('trim(text) <> ' + chr(39) * 2 + ' AND len(' + terms_sql('trim(text)') + ') = 0', 'no_content'))} AS soft FROM items"))
def v02(spark, sf):
    return V.answerability(_items(spark, sf))


@query("v03_grammar_flags")
def v03(spark, sf):
    # DuckDB has no back-references; tests/test_grammar.py compares it with neighbouring words
    return V.grammar_flags(_items(spark, sf)).select("question_id", F.col("doubled_word").alias("has_pair"), "extra_space", "no_capital", "no_mark")


def _parted(spark, sf):
    words = F.split("text", " ")
    part = lambda a, kind: F.struct(F.lit(kind).alias("type"), F.array_join(F.slice(words, a, 5), " ").alias("text"), F.lit("yes").alias("answer"))
    k = F.col("paper_id") % 3
    c = candidates(spark, sf)
    return c.withColumns({"type": F.when(k == 0, "MATCH_THE_FOLLOWING").otherwise(F.col("type")), "parts": F.when(k != 2, F.array(part(1, "TRUE_FALSE"), part(6, "MCQ"))), "options": F.array(F.lit("one"), F.lit("two"))})


_W5 = "array_to_string(string_split(text, ' ')[{a}:{b}], ' ')"


@query("v07_grounding_units", sql=with_tables("candidates", then=f"SELECT question_id, 'match' AS part, text || ' ' || {_W5.format(a=1, b=5)} || ' ' || {_W5.format(a=6, b=10)} AS text FROM candidates WHERE paper_id % 3 = 0 UNION ALL SELECT question_id, 'p0', {_W5.format(a=1, b=5)} FROM candidates WHERE paper_id % 3 = 1 UNION ALL SELECT question_id, 'p1', {_W5.format(a=6, b=10)} || ' yes' FROM candidates WHERE paper_id % 3 = 1 UNION ALL SELECT question_id, 'whole', text || ' one two' FROM candidates WHERE paper_id % 3 = 2"))
def v07(spark, sf):
    return V.grounding_units(_parted(spark, sf))


def _hits(spark, sf, c):
    """The five English chunks nearest to each item's own vector, as its evidence."""
    k = chunks(spark, sf).where(canonical_scope(F.col("class")) == "en")
    texts = chunks(spark, sf, vectors=False).where(canonical_scope(F.col("class")) == "en")
    hits = dense_search(c.select(F.col("question_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.lit("en").alias("class")), k, 5, ["class"])
    # written, so that their size is known: few are sent to the texts
    return written(hits, "evidence-hits").join(texts.select("chunk_id", "text"), "chunk_id").select(F.col("query_id").alias("slot_key"), "rank", "text")


def _whole(c):
    return c.select("question_id", F.lit("whole").alias("part"), "text", F.col("question_id").alias("slot_key"))


def _grounded(spark, sf, c):
    return V.grounding(_whole(c), _hits(spark, sf, c))


_COS_EC = "round({d} / (sqrt({q}) * sqrt({c})), 6)".format(**{k: "list_sum(list_transform(list_zip({}, {}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))".format(a, b) for k, a, b in (("d", "c.embedding", "k.embedding"), ("q", "c.embedding", "c.embedding"), ("c", "k.embedding", "k.embedding"))})
#: Evidence of the items of a table or CTE ``of``, by retrieval.
_KNOWN = """near{n} AS (SELECT c.question_id, k.chunk_id, row_number() OVER (PARTITION BY c.question_id ORDER BY {cos} DESC, k.chunk_id) AS rank FROM {of} c JOIN chunks k ON k.class = 'en' WHERE k.embedding IS NOT NULL QUALIFY rank <= 5),
    e{n} AS (SELECT question_id, list_distinct(flatten(list({terms}))) AS known FROM near{n} JOIN chunks USING (chunk_id) GROUP BY 1)"""
_GROUND = ", " + _KNOWN.format(n="", cos=_COS_EC, of="candidates", terms=terms_sql("text")) + f", u AS (SELECT question_id, {terms_sql('text')} AS t FROM candidates), g AS (SELECT question_id, known, coalesce(len(list_intersect(t, known)), 0) AS matched, len(t) AS terms, round(coalesce(coalesce(len(list_intersect(t, known)), 0) / nullif(len(t), 0)::DOUBLE, 0), 6) AS coverage FROM u LEFT JOIN e USING (question_id)), gr AS (SELECT *, CASE WHEN known IS NULL THEN 'no_evidence' WHEN terms = 0 THEN 'no_terms' WHEN matched < 2 THEN 'few_terms' WHEN coverage < 0.5 THEN 'low_coverage' END AS reason FROM g)"


@query("v08_grounding", sql=with_tables("candidates", "chunks", then=_GROUND + " SELECT question_id, 'whole' AS part, matched, terms, coverage, reason IS NULL AS ok, reason FROM gr"))
def v08(spark, sf):
    return _grounded(spark, sf, candidates(spark, sf))


def _want(spark, sf):
    c = candidates(spark, sf).where("paper_id % 9 <> 0")
    return c.select("paper_id", "slot_index", F.when(F.col("paper_id") % 4 == 0, "MCQ").otherwise(F.col("type")).alias("type"), (F.col("slot_index") % 4 + 1).cast("double").alias("total_marks"), F.lit(1).alias("item_count"), F.lit(4).alias("option_count"), F.lit("Hard").alias("difficulty"), F.lit(1.0).alias("part_marks"))


@query("v10_structure_check", sql=_sql(f"SELECT question_id, {_reasons(('paper_id % 9 = 0', 'no_slot'), ('paper_id % 9 <> 0 AND paper_id % 4 = 0 AND type <> ' + repr('MCQ'), 'type'), ('paper_id % 9 <> 0 AND marks <> slot_index % 4 + 1', 'marks'), ('paper_id % 9 <> 0 AND n_parts <> 1', 'item_count'), ('type = ' + repr('MCQ') + ' AND n_options <> 4', 'option_count'), ('type = ' + repr('TRUE_FALSE') + ' AND n_options > 0', 'options_on_true_false'), ('trim(text) = ' + chr(39) * 2, 'empty_text'))} AS reasons FROM items"))
def v10(spark, sf):
    return V.structure_check(_items(spark, sf), _want(spark, sf))


def _answers(spark, sf):
    o = {0: ["Cat", "Dog", "cat "], 1: ["one", "two", "three", "four"], 2: ["a", "b)", "cow"], 3: ["x y", " ", "z z"]}
    k = F.col("paper_id") % 4
    options = F.when(k == 0, F.array(*[F.lit(x) for x in o[0]])).when(k == 1, F.array(*[F.lit(x) for x in o[1]])).when(k == 2, F.array(*[F.lit(x) for x in o[2]])).otherwise(F.array(*[F.lit(x) for x in o[3]]))
    answer = F.when(F.col("paper_id") % 5 == 0, "").when(F.col("type") == "TRUE_FALSE", F.when(k == 0, "maybe").otherwise("True")).when(k == 1, "TWO").otherwise("none")
    return candidates(spark, sf).withColumns({"options": options, "answer": answer})


_ANS = "an AS (SELECT question_id, paper_id, type, ['cat|dog|cat', 'one|two|three|four', 'a|b)|cow', 'x y||z z'][paper_id % 4 + 1] AS o, CASE WHEN paper_id % 5 = 0 THEN '' WHEN type = 'TRUE_FALSE' THEN CASE WHEN paper_id % 4 = 0 THEN 'maybe' ELSE 'true' END WHEN paper_id % 4 = 1 THEN 'two' ELSE 'none' END AS a FROM candidates)"


@query("v11_answer_check", sql=with_tables("candidates", then=f", {_ANS} SELECT question_id, {_reasons(('a = ' + chr(39) * 2, 'no_answer'), ('type = ' + repr('MCQ') + ' AND a <> ' + chr(39) * 2 + ' AND NOT list_contains(string_split(o, ' + repr('|') + '), a)', 'answer_not_an_option'), ('type = ' + repr('TRUE_FALSE') + ' AND a NOT IN (' + repr('true') + ', ' + repr('false') + ')', 'not_boolean'), ('type = ' + repr('MCQ') + ' AND paper_id % 4 = 3', 'empty_option'), ('type = ' + repr('MCQ') + ' AND paper_id % 4 = 2', 'bare_letter'), ('type = ' + repr('MCQ') + ' AND paper_id % 4 = 0', 'duplicate_options'))} AS reasons FROM an"))
def v11(spark, sf):
    return V.answer_check(_answers(spark, sf))


@query("v11_answer_positions", sql=with_tables("candidates", then=f", {_ANS}, p AS (SELECT paper_id % 10 AS paper_id, list_position(string_split(o, '|'), a) AS p FROM an WHERE type = 'MCQ') SELECT paper_id, count(*) AS items, count(DISTINCT p) AS positions, count(*) >= 3 AND count(DISTINCT p) = 1 AS one_place FROM p WHERE p > 0 GROUP BY 1"))
def v11b(spark, sf):
    return V.answer_positions(_answers(spark, sf).withColumn("paper_id", F.col("paper_id") % 10))


@query("v12_marking_scheme", sql=with_tables("slot_items", then=""", g AS (SELECT slot_id, list(round(marks / 10, 1) ORDER BY item_index) AS p, slot_id % 6 + 1.0 AS marks FROM slot_items GROUP BY 1), s AS (SELECT *, list_sum(p) AS s, len(p) AS n, marks <= 1 OR (len(p) >= 2 AND abs(list_sum(p) - marks) <= 0.5) AS ok FROM g), h AS (SELECT *, list_transform(p, lambda x: round(x * coalesce(marks / nullif(s, 0), 1.0) * 2) / 2)[1:n - 1] AS hd FROM s)
    SELECT slot_id AS question_id, ok, round(list_sum(CASE WHEN ok THEN p WHEN marks - coalesce(list_sum(hd), 0) > 0 THEN list_concat(hd, [marks - coalesce(list_sum(hd), 0)]) ELSE list_transform(p, lambda x: round(marks / n, 4)) END), 3) AS total FROM h"""))
def v12(spark, sf):
    g = slot_items(spark, sf).groupBy("slot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_index", F.round(F.col("marks") / 10, 1).alias("m")))), lambda x: x["m"]).alias("points"))
    r = V.marking_scheme(g.select(F.col("slot_id").alias("question_id"), "points", (F.col("slot_id") % 6 + 1.0).alias("marks")))
    return r.select("question_id", "ok", F.round(F.aggregate("repaired", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("v13_validate_paper", sql=with_tables("slots", then=", i AS (SELECT * FROM slots WHERE slot_id % 7 <> 0), g AS (SELECT paper_id, count(*) AS items, list_sort(list(DISTINCT section)) AS got FROM i GROUP BY 1), w AS (SELECT paper_id, list_sort(list(DISTINCT section)) AS want FROM slots GROUP BY 1) SELECT paper_id, items, (SELECT count(*) FROM slots s WHERE s.paper_id = g.paper_id AND s.slot_id % 7 = 0) AS missing_slots, list_filter(want, lambda x: NOT list_contains(got, x)) AS section_diff FROM g JOIN w USING (paper_id)"))
def v13(spark, sf):
    s = slots(spark, sf)
    return V.validate_paper(s.where("slot_id % 7 <> 0"), s, s.select("paper_id", "section").distinct())


@query("v14_merge_verdicts", sql="WITH i AS (SELECT doc_id AS id, doc_id // 5 AS b, CASE WHEN quality IS NOT NULL THEN quality = 1 AND toxic = 0 END AS v FROM documents LEFT JOIN labels USING (doc_id)) SELECT id, CASE WHEN v THEN 'accepted' WHEN NOT v THEN 'rejected' WHEN count(v) OVER (PARTITION BY b) > 0 THEN 'accepted' ELSE 'rejected' END AS verdict, CASE WHEN v IS NULL THEN CASE WHEN count(v) OVER (PARTITION BY b) > 0 THEN 'no_verdict' ELSE 'batch_without_verdicts' END END AS note FROM i")
def v14(spark, sf):
    i = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 5).alias("batch"))
    v = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("valid"))
    return V.merge_verdicts(i, v, "batch")


#: Floors of the cascade's query, low enough for the test texts that every gate has items to judge.
_FLOORS = {"topic": 0.05, "coverage": 0.1, "peer": 0.2, "source": 0.3}


def _cascade_items(spark, sf):
    """Items with their reference; a fifth of the papers repeat it."""
    i = _items(spark, sf).join(ref_items(spark, sf), ["paper_id", "slot_index"], "left")
    return i.withColumn("text", F.when((F.col("paper_id") % 7 > 3) & (F.col("paper_id") % 5 == 1), F.coalesce("reference_text", "text")).otherwise(F.col("text")))


def _cascade_sql() -> str:
    items = f"{_ITEMS}, s0 AS (SELECT i.* EXCLUDE (text), reference_text, CASE WHEN paper_id % 7 > 3 AND paper_id % 5 == 1 THEN coalesce(reference_text, text) ELSE text END AS text FROM items i LEFT JOIN ref_items USING (paper_id, slot_index))"
    x, y = terms_sql("text"), terms_sql("reference_text")
    shared = "coalesce(len(list_intersect(x, y)) / nullif(least(len(x), len(y)), 0)::DOUBLE, 0)"
    two = f"(SELECT *, {x} AS x, {y} AS y FROM {{s}} WHERE reference_text IS NOT NULL)"
    prefix = "least(length(a), length(w)) >= 4 AND a[1:greatest(4, least(length(a), length(w)) - 1)] = w[1:greatest(4, least(length(a), length(w)) - 1)]"
    cos = _COS_EC
    gates = [
        ("basic", f"SELECT question_id, {_BASIC} AS reasons FROM {{s}}"),
        ("topic", f"""SELECT question_id, ['topic'] AS reasons FROM (SELECT t.question_id, len(y) AS n, count(DISTINCT a) FILTER (a = w OR {prefix}) AS hit FROM (SELECT question_id, y, unnest(y) AS a FROM {two}) t
            LEFT JOIN (SELECT question_id, unnest(x) AS w FROM {two}) u USING (question_id) GROUP BY ALL) WHERE hit / n::DOUBLE < {_FLOORS['topic']}"""),
        ("novelty", f"""SELECT question_id, [verdict] AS reasons FROM (SELECT question_id, CASE WHEN {_NORM} = {_NORM.replace('text', 'reference_text')} THEN 'EXACT_COPY'
            WHEN {_TRIGGER.replace('stem', 'text')} IS NOT NULL AND {_TRIGGER.replace('stem', 'reference_text')} IS NOT NULL THEN 'SAME_DEMAND_SHAPE'
            WHEN one AND o >= CASE type WHEN 'SHORT_ANSWER' THEN 0.85 WHEN 'LONG_ANSWER' THEN 0.9 ELSE 0.8 END THEN 'NEAR_PARAPHRASE'
            WHEN one AND o >= CASE type WHEN 'SHORT_ANSWER' THEN 0.65 WHEN 'LONG_ANSWER' THEN 0.7 ELSE 0.55 END THEN 'SAME_INFORMATION_DEMAND' END AS verdict
            FROM (SELECT *, {shared} AS o, {_demand('text')} = {_demand('reference_text')} AS one FROM {two})) WHERE verdict IS NOT NULL"""),
        ("embedding", f"""SELECT question_id, ['embedding'] AS reasons FROM (SELECT c.*, {shared} AS o, {cos} AS cs FROM (SELECT *, CASE WHEN paper_id % 11 = 0 THEN embedding END AS own FROM {two}) c
            JOIN (SELECT vec_id, embedding FROM embeddings) v ON v.vec_id = (c.paper_id * 7 + c.slot_index + 1) % (SELECT count(*) FROM embeddings), LATERAL (SELECT coalesce(c.own, v.embedding) AS embedding) k)
            WHERE cs >= 0.93 AND (type NOT IN ('MCQ', 'TRUE_FALSE', 'FILL_IN_THE_BLANK') OR o >= 0.55)"""),
        ("demand", f"""SELECT question_id, ['demand'] AS reasons FROM (SELECT question_id, {_DEMAND.replace('stem', 'text')} AS generated, CASE WHEN paper_id % 6 = 2 THEN 'UNDERSTANDING' ELSE 'RECALL' END AS intended FROM {{s}})
            JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in X.DEMAND_RANK.items())}) g(generated, rank) USING (generated) JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in X.DEMAND_RANK.items())}) i(intended, wanted) USING (intended) WHERE rank < wanted"""),
        ("grounding", f"""SELECT question_id, [CASE WHEN known IS NULL THEN 'no_evidence' WHEN len(t) = 0 THEN 'no_terms' WHEN len(list_intersect(t, known)) < 2 THEN 'few_terms' ELSE 'low_coverage' END] AS reasons
            FROM (SELECT question_id, {x} AS t FROM {{s}}) LEFT JOIN e USING (question_id) WHERE NOT coalesce(len(list_intersect(t, known)) >= 2 AND round(len(list_intersect(t, known)) / len(t)::DOUBLE, 6) >= {_FLOORS['coverage']}, FALSE)"""),
        ("image", f"""SELECT question_id, ['image'] AS reasons FROM (SELECT question_id, list_filter({x}, lambda w: NOT list_contains({_FRAME_WORDS}, w)) AS t, b.seen FROM {{s}} JOIN (SELECT item_id, {x} AS seen FROM benchmark) b ON b.item_id = paper_id) LEFT JOIN e USING (question_id)
            WHERE len(list_filter(t, lambda w: list_contains(coalesce(known, []), w) OR list_contains(seen, w))) < 2"""),
        ("peer", f"SELECT DISTINCT c.question_id, ['peer'] AS reasons FROM {{s}} c JOIN {{s}} k ON k.paper_id = c.paper_id AND k.slot_index < c.slot_index WHERE {cos} >= {_FLOORS['peer']}"),
        ("source", f"SELECT c.question_id, ['source'] AS reasons FROM {{s}} c JOIN past_items k ON k.subject = 'src' || (c.paper_id % 20) GROUP BY 1 HAVING max({cos}) >= {_FLOORS['source']}"),
        ("verdict", """SELECT question_id, ['verdict'] AS reasons FROM (SELECT question_id, CASE WHEN quality IS NOT NULL THEN quality = 1 AND toxic = 0 ELSE count(quality) OVER (PARTITION BY paper_id) > 0 END AS ok FROM {s} LEFT JOIN labels ON doc_id = paper_id * 3 + slot_index) WHERE NOT ok"""),
    ]
    ctes, names = [], []
    for k, (name, sql) in enumerate(gates):
        ctes.append(f"f{k} AS MATERIALIZED (SELECT * FROM ({sql.replace('{s}', f's{k}')}) WHERE len(reasons) > 0), s{k + 1} AS MATERIALIZED (SELECT * FROM s{k} WHERE question_id NOT IN (SELECT question_id FROM f{k}))")
        names.append(f"SELECT question_id, '{name}' AS gate, reasons FROM f{k}")
    known = _KNOWN.format(n="", cos=cos, of="candidates", terms=terms_sql("text"))
    return with_tables("candidates", "ref_items", "chunks", "past_items", then=f", {items}, {known}, {', '.join(ctes)}, failed AS ({' UNION ALL '.join(names)}) SELECT question_id, gate, reasons FROM s0 LEFT JOIN failed USING (question_id)")


def _cascade_gates(spark, sf):
    subject = F.concat(F.lit("src"), (F.col("paper_id") % 20).cast("string"))
    one = lambda name: F.array(F.lit(name)).alias("reasons")
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("other"))
    n = e.count()
    seen = table(spark, sf, "benchmark").select(F.col("item_id").alias("paper_id"), X.content_terms(F.col("text")).alias("terms"))
    labels = table(spark, sf, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("valid"))
    known = lambda s: s.where("reference_text IS NOT NULL")

    def embedding(s):
        shared = overlap_min(X.content_terms(F.col("text")), X.content_terms(F.col("reference_text")))
        p = known(s).join(e, (F.col("paper_id") * 7 + F.col("slot_index") + 1) % n == F.col("vec_id"))
        p = p.select("question_id", "type", F.col("embedding").alias("vec"), F.when(F.col("paper_id") % 11 == 0, F.col("embedding")).otherwise(F.col("other")).alias("ref_vec"), shared.alias("overlap"))
        return N.backstop_failures(p).where("bad").select("question_id", one("embedding"))

    def demand(s):
        wanted = F.when(F.col("paper_id") % 6 == 2, "UNDERSTANDING").otherwise("RECALL")
        return s.where(X.demand_rank(X.cognitive_demand(F.col("text"))) < X.demand_rank(wanted)).select("question_id", one("demand"))

    def image(s):
        shown = s.join(seen, "paper_id")
        v = V.visual_grounding(_whole(shown), _hits(spark, sf, shown), shown.select(F.col("question_id").alias("slot_key"), "terms"))
        return v.where("NOT ok").select("question_id", one("image"))

    def verdict(s):
        i = s.select(F.col("question_id").alias("id"), F.col("paper_id").alias("batch"), (F.col("paper_id") * 3 + F.col("slot_index")).alias("doc_id"))
        v = i.join(labels, "doc_id").select("id", "valid")
        return V.merge_verdicts(i.drop("doc_id"), v, "batch").where("verdict = 'rejected'").select(F.col("id").alias("question_id"), one("verdict"))

    return {
        "basic": lambda s: V.basic_checks(s).select("question_id", "reasons"),
        "topic": lambda s: N.topic_fidelity(known(s).select(F.col("question_id").alias("id"), "text", F.col("reference_text").alias("anchor")), _FLOORS["topic"]).where("NOT passes").select(F.col("id").alias("question_id"), one("topic")),
        "novelty": lambda s: N.novelty_verdict(known(s)).where("verdict <> 'NOVEL'").select("question_id", F.array("verdict").alias("reasons")),
        "embedding": embedding,
        "demand": demand,
        "grounding": lambda s: V.grounding(_whole(s), _hits(spark, sf, s), coverage=_FLOORS["coverage"]).select("question_id", F.array_compact(F.array("reason")).alias("reasons")),
        "image": image,
        "peer": lambda s: N.peer_duplicates(s, _FLOORS["peer"]).select("question_id", one("peer")),
        "source": lambda s: N.source_similarity(s.withColumns({"class": F.lit("en"), "subject": subject}), past_items(spark, sf), _FLOORS["source"]).where("duplicate").select("question_id", one("source")),
        "verdict": verdict,
    }


@query("v15_gate_cascade", sql=_cascade_sql())
def v15(spark, sf):
    return V.gate_cascade(_cascade_items(spark, sf), _cascade_gates(spark, sf))


@query("v16_route", sql=with_tables("candidates", "ref_items", then="SELECT question_id, CASE WHEN paper_id % 2 = 0 THEN 'accepted' WHEN attempts >= CASE WHEN paper_id % 3 = 0 THEN 5 ELSE 3 END THEN 'failed' ELSE 'pending' END AS route FROM candidates JOIN ref_items USING (paper_id, slot_index)"))
def v16(spark, sf):
    j = candidates(spark, sf).join(ref_items(spark, sf), ["paper_id", "slot_index"])
    j = j.withColumn("reference_text", F.when(F.col("paper_id") % 3 == 0, "What is the moral of it?").otherwise("Name it")).withColumn("reasons", F.when(F.col("paper_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"))))
    return V.route(j)


@query("v17_slot_accounting", sql=with_tables("slots", then="SELECT paper_id, slot_index, CASE WHEN slot_id % 3 = 0 THEN 'accepted' WHEN slot_id % 4 = 0 THEN 'failed' ELSE 'silent' END AS outcome, CASE WHEN slot_id % 3 = 0 THEN slot_id % 5 WHEN slot_id % 4 = 0 THEN slot_id % 5 + 1 ELSE 0 END AS attempts FROM slots"))
def v17(spark, sf):
    s = slots(spark, sf).withColumn("attempts", F.col("slot_id") % 5)
    failed = s.where("slot_id % 4 = 0")
    return V.slot_accounting(s, s.where("slot_id % 3 = 0"), failed.union(failed.withColumn("attempts", F.col("attempts") + 1)))


def _pool(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("paper_id"), (F.col("l_linenumber") % 2).alias("slot_index"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("question_id"), (F.col("l_quantity") > 5).cast("int").alias("structural_ok"), (F.col("l_partkey") % 3).alias("n_reasons"), F.lit(0).alias("n_hard"),
        (F.col("l_discount") * 5).alias("overlap"), (F.col("l_tax") * 10).alias("similarity"), (F.col("l_quantity") / 50).alias("coverage"), (F.col("l_suppkey") % 3 - 1).alias("difficulty_fit"), F.lit(0).alias("transformed"), F.lit(1).alias("coding"), (F.col("l_suppkey") % 2).alias("n_soft"), F.lit(0).alias("n_grammar"), (F.col("l_discount") * 10).alias("diversity"), F.lit(1).alias("graph"), F.lit(None).cast("int").alias("image"),
    )


_POOL = "pool AS (SELECT l_orderkey AS paper_id, l_linenumber % 2 AS slot_index, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS question_id, CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END AS structural_ok, l_discount * 5 AS overlap, round(1000 * CASE WHEN l_quantity > 5 THEN 1 ELSE 0 END - 100 * (l_partkey % 3) - 40 * l_discount * 5 - 100 * greatest(0.0, l_tax * 10 - 0.75) + 20 * l_quantity / 50 + 10 * (l_suppkey % 3 - 1) + 5 - 5 * (l_suppkey % 2) - 10 * (1 - l_discount * 10) + 5, 4) AS score FROM lineitem)"


@query("v18_candidate_score", sql=f"WITH {_POOL} SELECT paper_id, slot_index, count(*) AS n, round(sum(score), 2) AS total, max(score) AS best FROM pool GROUP BY ALL")
def v18(spark, sf):
    return V.candidate_score(_pool(spark, sf)).groupBy("paper_id", "slot_index").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"), F.max("score").alias("best"))


@query("v19_best_candidate", sql=f"WITH {_POOL} SELECT paper_id, slot_index, structural_ok, score FROM pool QUALIFY row_number() OVER (PARTITION BY paper_id, slot_index ORDER BY structural_ok DESC, score DESC, overlap, question_id) = 1")
def v19(spark, sf):
    return V.best_candidate(V.candidate_score(_pool(spark, sf))).select("paper_id", "slot_index", "structural_ok", "score")


_ALLOW = "CASE type " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(d) for d in v)}]" for k, v in V.ALLOWED_DEMANDS.items()) + " END"


@query("v20_demand_targets", sql=with_tables("candidates", then=f", a AS (SELECT question_id, slot_index, {_ALLOW} AS al FROM candidates), f AS (SELECT *, list_filter(al, lambda d: d <> 'RECALL') AS fr FROM a) SELECT question_id AS slot_id, CASE WHEN len(fr) > 0 THEN fr[slot_index % len(fr) + 1] ELSE al[slot_index % len(al) + 1] END AS target FROM f"))
def v20(spark, sf):
    c = candidates(spark, sf).select(F.col("question_id").alias("slot_id"), "slot_index", "type", F.array(F.lit("RECALL")).alias("used"), F.lit("RECALL").alias("reference_demand"))
    return V.demand_targets(c)


@query("v21_ledger", sql=with_tables("candidates", then=f", c AS (SELECT paper_id, type, {_DEMAND.replace('stem', 'text')} AS demand FROM candidates) SELECT paper_id, count(*) AS items, list_sort(list(DISTINCT demand)) AS demands, list_sort(list(DISTINCT type)) AS types FROM c GROUP BY 1"))
def v21(spark, sf):
    return V.ledger(candidates(spark, sf))


@query("v22_plan_targets", sql=with_tables("slots", then=""", t AS (SELECT slot_id, CASE WHEN slot_id % 3 = 0 THEN 'item' END AS a, CASE WHEN slot_id % 5 = 0 THEN 'anchor' END AS b, CASE WHEN slot_id % 2 = 0 THEN 'ev' END AS c, CASE WHEN slot_id % 7 = 0 THEN 'graph' END AS d, CASE WHEN slot_id % 11 = 0 THEN 'unit' END AS e FROM slots),
    r AS (SELECT *, coalesce(a, b, c, d, e, 'subject') AS topic, CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 WHEN d IS NOT NULL THEN 4 WHEN e IS NOT NULL THEN 5 ELSE 7 END AS level, CASE WHEN a IS NULL THEN 0 ELSE 0.3 END + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END + CASE WHEN c IS NULL THEN 0 ELSE 0.3 END + CASE WHEN d IS NULL THEN 0 ELSE 0.15 END + CASE WHEN e IS NULL THEN 0 ELSE 0.05 END AS raw FROM t)
    SELECT slot_id, topic, level, round(CASE WHEN level > 3 THEN raw * 0.6 ELSE raw END::DOUBLE, 6) AS confidence, round(CASE WHEN level > 3 THEN raw * 0.6 ELSE raw END::DOUBLE, 6) < 0.3 AS review FROM r"""))
def v22(spark, sf):
    i = F.col("slot_id")
    pick = lambda n, v: F.when(i % n == 0, v)
    s = slots(spark, sf).select("slot_id", pick(3, "item").alias("item_topic"), pick(5, "anchor").alias("anchor"), pick(2, "ev").alias("evidence_topic"), pick(7, "graph").alias("graph_topic"), pick(11, "unit").alias("unit_topic"), F.lit(" ").alias("paper_topic"), F.lit("subject").alias("subject"))
    return V.plan_targets(s)


@query("v23_validate_plans", sql=with_tables("slots", then=f"SELECT slot_id, {_reasons(('slot_id % 5 = 0', 'demand'), ('slot_id % 3 = 0', 'difficulty'), ('slot_id % 4 = 0', 'marks'), ('slot_id % 7 = 0', 'item_count'), ('slot_id % 2 = 0 AND slot_id % 9 = 0', 'unit'))} AS reasons FROM slots"))
def v23(spark, sf):
    i = F.col("slot_id")
    s = slots(spark, sf).select("slot_id", "total_marks", F.lit("Difficult").alias("difficulty"), F.lit("U1").alias("unit"), F.col("declared_items").alias("item_count"))
    p = s.select("slot_id", F.when(i % 5 == 0, "GUESS").otherwise("RECALL").alias("demand"), F.when(i % 3 == 0, "Easy").otherwise("Hard").alias("difficulty"), F.when(i % 4 == 0, F.col("total_marks") + 1).otherwise(F.col("total_marks")).alias("marks"), F.when(i % 7 == 0, F.col("item_count") + 1).otherwise(F.col("item_count")).alias("item_count"), F.when(i % 2 == 0, F.when(i % 9 == 0, "U2").otherwise("U1")).alias("evidence_unit"))
    return V.validate_plans(p, s)


@query("v24_item_dependency", sql=with_tables("slot_items", then="SELECT slot_id, item_index, CASE WHEN part_id % 3 = 0 OR NOT bool_or(part_id % 3 = 0) OVER (PARTITION BY slot_id) THEN 'IMAGE_DEPENDENT' ELSE 'IMAGE_CONTEXTUAL' END AS dependency FROM slot_items"))
def v24(spark, sf):
    i = slot_items(spark, sf)
    return V.item_dependency(i.withColumn("reference_text", F.when(F.col("part_id") % 3 == 0, "Look at the Picture").otherwise("Name it")))


@query("v25_image_alignment", sql="""WITH im AS (SELECT item_id AS image_id, item_id AS slot_key, unnest(['the', 'nation_1', 'zzz']) AS concept, 'and' AS topic FROM benchmark), n AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS slot_key, lower(string_agg(text, ' ' ORDER BY text)) AS al, count(*) AS n FROM documents GROUP BY 1),
    p AS (SELECT image_id, round(avg(CASE WHEN contains(al, concept) THEN 1.0 WHEN concept = 'nation_1' THEN 0.7 ELSE 0 END), 6) AS c, any_value(n) AS n, any_value(al) AS al, any_value(topic) AS topic FROM im LEFT JOIN n USING (slot_key) GROUP BY 1)
    SELECT image_id, c AS concept_score, CASE WHEN contains(al, topic) THEN 1.0 ELSE 0.0 END AS topic_score, least(1.0, round(0.4 * c + 0.3 * CASE WHEN contains(al, topic) THEN 1.0 ELSE 0.0 END + 0.3 * least(1.0, coalesce(n, 0) / 3.0) + 0.05, 6)) AS confidence, round(0.4 * c + 0.3 * CASE WHEN contains(al, topic) THEN 1.0 ELSE 0.0 END + 0.3 * least(1.0, coalesce(n, 0) / 3.0) + 0.05, 6) >= 0.25 AS aligned FROM p""")
def v25(spark, sf):
    b = table(spark, sf, "benchmark")
    im = b.select(F.col("item_id").alias("image_id"), F.col("item_id").alias("slot_key"), F.array(F.lit("The"), F.lit("NATION_1"), F.lit("zzz")).alias("concepts"), F.lit("and").alias("topic"))
    notes = table(spark, sf, "documents").select((F.col("doc_id") % b.count()).alias("slot_key"), "text")
    return V.image_alignment(im, notes, table(spark, sf, "nation").select(F.col("n_name").alias("name")))


@query("v26_visual_fidelity", sql=f"WITH t AS (SELECT item_id, text, {terms_sql('text')} AS t FROM benchmark) SELECT item_id AS question_id, {_reasons(('NOT list_contains(t, ' + repr('tion') + ')', 'no_shared_term'), ('item_id % 2 = 0 AND NOT coalesce(regexp_matches(text, ' + chr(39) + V.VISUAL_CUE + chr(39) + '), false)', 'no_visual_cue'), ('len(list_filter(t, lambda x: x <> ' + repr('tion') + ')) >= 3 AND NOT list_contains(t, ' + repr('tion') + ')', 'unsupported_claims'))} AS reasons FROM t")
def v26(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.array(F.lit("tion")).alias("image_terms"), (F.col("item_id") % 2 == 0).alias("dependent"))
    return V.visual_fidelity(b)


_WHY = ["reuse of it", "topic drift", "image missing", "option format", "parameter swap", "ambiguous stem", "wrong demand", "not grounded", "else"]
_CLS = ["REUSE", "DRIFT", "IMAGE", "FORMAT", "SWAP", "AMBIGUITY", "DEMAND", "GROUNDING", "OTHER"]


@query("v27_reason_stats", sql=f"WITH h AS (SELECT user_id AS slot_id, [{', '.join(repr(w) for w in _WHY)}][event_id % 9 + 1] || ' ' || (event_id % 4) AS reason, [{', '.join(repr(w) for w in _CLS)}][event_id % 9 + 1] AS class, event_id FROM events), d AS (SELECT slot_id, reason, class, max(event_id) AS at_ FROM h GROUP BY ALL), r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY slot_id ORDER BY at_ DESC, reason) <= 12) SELECT slot_id, class, count(*) AS n, count(*) > 1 AS recurring FROM r GROUP BY ALL")
def v27(spark, sf):
    k = F.get(F.array(*[F.lit(w) for w in _WHY]), (F.col("event_id") % 9).cast("int"))
    h = table(spark, sf, "events").select(F.col("user_id").alias("slot_id"), F.concat_ws(" ", k, (F.col("event_id") % 4).cast("string")).alias("reason"), F.col("event_id").alias("at"))
    return V.reason_stats(h)


@query("v28_normalize_candidate", sql=with_tables("candidates", then="SELECT question_id, CASE WHEN paper_id % 9 <> 0 AND paper_id % 4 = 0 THEN 'MCQ' ELSE type END AS type, CASE WHEN paper_id % 9 <> 0 THEN slot_index % 4 + 1.0 ELSE marks END AS marks, CASE WHEN paper_id % 9 <> 0 THEN 'Hard' ELSE 'Easy' END AS difficulty, 2 AS n_parts, length(trim(text)[1:2000] || chr(10) || 'first part' || chr(10) || 'second') AS chars FROM candidates"))
def v28(spark, sf):
    raw = candidates(spark, sf).withColumn("difficulty", F.lit("Easy")).withColumn("parts", F.array(F.lit(" first part "), F.lit("x"), F.lit(" "), F.lit("second")))
    out = V.normalize_candidate(raw, _want(spark, sf))
    return out.select("question_id", "type", "marks", "difficulty", F.size("parts").alias("n_parts"), F.length("full_text").alias("chars"))


@query("v29_structure_signature", sql=with_tables("slots", then="SELECT paper_id, 2 AS runs, CASE WHEN bool_or(slot_id % 50 = 0) THEN 2 ELSE 1 END AS signatures, NOT bool_or(slot_id % 50 = 0) AS invariant FROM slots GROUP BY 1"))
def v29(spark, sf):
    s = slots(spark, sf).select("paper_id", "slot_id", "slot_index", F.lit("MCQ").alias("type"), F.col("total_marks").alias("marks"), F.lit(1).alias("n_parts"))
    hard = s.withColumn("n_parts", F.when(F.col("slot_id") % 50 == 0, 2).otherwise(1))
    return V.structure_signature(s.withColumn("run", F.lit("Easy")).unionByName(hard.withColumn("run", F.lit("Hard"))))




@query("v09_visual_grounding", sql=with_tables("candidates", "chunks", then=", " + _KNOWN.format(n="", cos=_COS_EC, of="candidates", terms=terms_sql("text")) + f", u AS (SELECT question_id, paper_id AS slot_key, list_filter({terms_sql('text')}, lambda w: NOT list_contains({_FRAME_WORDS}, w)) AS t FROM candidates), v AS (SELECT item_id AS slot_key, {terms_sql('text')} AS seen FROM benchmark), g AS (SELECT question_id, len(list_intersect(t, coalesce(known, []))) AS a, len(list_filter(t, lambda w: NOT list_contains(coalesce(known, []), w) AND list_contains(coalesce(seen, []), w))) AS b FROM u LEFT JOIN e USING (question_id) LEFT JOIN v USING (slot_key)) SELECT question_id, 'whole' AS part, a AS from_notes, b AS from_image, a + b >= 2 AS ok FROM g"))
def v09(spark, sf):
    """Whole items against their retrieved chunks; items of a paper that ``benchmark`` numbers also have its words as their image's."""
    c = candidates(spark, sf)
    seen = table(spark, sf, "benchmark").select(F.col("item_id").alias("paper_id"), X.content_terms(F.col("text")).alias("terms"))
    return V.visual_grounding(_whole(c), _hits(spark, sf, c), c.join(seen, "paper_id").select(F.col("question_id").alias("slot_key"), "terms"))
