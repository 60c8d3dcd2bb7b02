"""Hand-computed cases for operators whose test data has few hits."""

from pyspark.sql import functions as F

from heronlake.functions import text as X
from heronlake.operators import chunking as C
from heronlake.operators import graph as G
from heronlake.operators import items as Q
from heronlake.operators import novelty as N
from heronlake.operators import retrieval as R
from heronlake.operators import spec as B
from heronlake.registry import QUERIES
from heronlake.sources import store as S


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, X.clean_text, " a\r\n\r\n\r\n\r\nb  c\x07 ") == "a\n\nb c"
    assert one(spark, X.drop_page_markers, "a\nPage 1 of 4\n-- 1 of 2 --\n1 / 4\nsee page 12") == "a\nsee page 12"
    assert one(spark, X.strip_exam_metadata, "1.2 What is (iv) it? [5] CO1") == "What is it?"
    assert one(spark, X.drop_ocr_noise, "(a) ~~ The xq leaf ooo is NASA green |") == "(a) The leaf is NASA green"
    assert one(spark, X.drop_ocr_noise, "~~ ||") == "~~ ||"
    assert one(spark, X.normalize_unit_label, " Unit  IV") == "unit 4"
    assert one(spark, X.normalize_unit_label, "Unit 12") == "unit 12"
    assert one(spark, lambda c: X.balanced_json(c), 'x {"a": "}", "b": {"c": 1}} y {') == '{"a": "}", "b": {"c": 1}}'
    assert one(spark, X.sentences, 'He said "no." Then? Yes') == ['He said "no."', "Then?", "Yes"]
    assert one(spark, X.redact, "key sk-" + "a" * 22 + " at C:\\tmp\\x") == "key [REDACTED_SECRET] at [REDACTED_PATH]"
    assert one(spark, X.information_demand, "Explain why it rains") == "REASON"
    assert one(spark, X.summary_trigger, "What lesson does it teach?") == "lesson"


def test_connectors(spark):
    df = spark.createDataFrame([("c1", "The heart is a part of the body. A mammal (warm-blooded) is a kind of animal, often large. Nothing here.")], "chunk_id string, text string")
    got = sorted((r.source_name, r.relation, r.target_name) for r in G.connector_triples(df).collect())
    assert got == [("heart", "PART_OF", "body"), ("mammal", "IS_A", "animal")]


def test_connectors_need_whole_words(spark, sf):
    text = "An unlikely phase of the hash produces heat. A phase of the unlikely hash. Bats, UNLIKE birds, have fur. Clay (which has lime) contains sand. The owl has eyes that produces fear."
    df = spark.createDataFrame([("c1", text), ("c2", None)], "chunk_id string, text string")
    got = sorted((r.source_name, r.relation, r.target_name) for r in G.connector_triples(df).collect())
    assert got == [("Clay", "CONTAINS", "sand"), ("owl has eyes", "PRODUCES", "fear"), ("phase hash", "PRODUCES", "heat")]
    # texts are read where they lie: without vectors to fetch they meet no other table
    plan = QUERIES["g04_connector_triples"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_marks(spark):
    cases = {"1x5=5": (1, 5, 5), "4X2=8": (4, 2, 8), "draw 4+1": (5, 1, 5), "name it 5": (5, 1, 5), "in 1999": None, "x": None}
    for t, want in cases.items():
        got = one(spark, B.parse_marks_expression, t)
        assert (got and (got["per"], got["count"], got["total"])) == want
    assert [one(spark, B.parse_optional_rule, t) for t in ("(Any four)", "Attempt any 5", "any", "any 40")] == [4, 5, None, None]


def test_upsert_twice_is_once(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, v string, t long")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "id long, v string, t long")
    once = S.upsert(base, new, ["id"], "t")
    twice = S.upsert(once, new, ["id"], "t")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.8, 2)], "query_id long, chunk_id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 3.0, 1), (1, "z", 2.0, 2)], "query_id long, chunk_id string, score double, rank int")
    pick = lambda df: [(r.chunk_id, r.score, r.rank) for r in df.orderBy("rank").collect()]
    assert pick(R.rrf_fuse(a, b)) == pick(R.rrf_fuse(b, a))
    assert pick(R.rrf_fuse(a, b))[0] == ("y", round(1 / 61 + 1 / 62, 5), 1)


def test_approximate_search_recall(spark, sf):
    from heronlake.plans.tables import chunks, queries

    q, c = queries(spark, sf).withColumn("class", F.lit("all")), chunks(spark, sf).withColumn("class", F.lit("all"))
    exact = {(r.query_id, r.chunk_id) for r in R.dense_search(q, c, 10, ["class"]).collect()}
    near = {(r.query_id, r.chunk_id) for r in R.dense_search_approx(q, c, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_scope_filter_is_pushed_down(spark, sf):
    plan = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[-1]


def test_slot_wordings(spark):
    cases = {
        "Write T/F": "TRUE_FALSE", "Story writing: a rainy day": "CREATIVE_WRITING", "Make a story using the given words": "CREATIVE_WRITING", "Identify the object picture below": "IMAGE_BASED",
        "Study the following image": "IMAGE_BASED", "Now draw the leaf": "DRAWING", "Fill in the missing letters": "FILL_IN_THE_BLANK", "Draft a notice": "NOTICE", "Distinguish between a and b": "DIFFERENTIATE",
        "Tick the correct word": "MCQ", "Match the items": "MATCH_THE_FOLLOWING", "": "UNKNOWN", "Name three": "SHORT_ANSWER",
    }
    df = spark.createDataFrame([(k,) for k in cases], "stem string")
    got = {r.stem: r.kind for r in df.select("stem", B.classify_slot_type(F.col("stem"), F.lit(1.0), F.lit(None).cast("double")).alias("kind")).collect()}
    assert got == cases


def test_parameter_swap(spark):
    rows = [(1, "Write a program to print 3 times", "Write a program to display 7 times"), (2, "Write a program to print 3 times read", "Write a program to display 7 times"), (3, "Name the parts of a leaf", "Write a program to display 7 times")]
    got = N.parameter_swap(spark.createDataFrame(rows, "k int, text string, reference_text string"))
    assert {r.k: r.swapped for r in got.collect()} == {1: True, 2: False, 3: False}


def test_rows_of_options_and_items(spark):
    rows = ["(a) red (b) blue (c) green", "(a) red only", "1. name it 2. draw it", "1. name it"]
    df = spark.createDataFrame([(r,) for r in rows], "line string").select("line", Q.split_option_row(F.col("line")).alias("o"), Q.split_inline_items(F.col("line")).alias("i"))
    got = {r.line: (r.o, r.i) for r in df.collect()}
    assert [got[r] for r in rows] == [(["red", "blue", "green"], None), (None, None), (None, ["name it", "draw it"]), (None, None)]


def test_segments_of_a_paper(spark):
    text = "Section A\nQ1. Name the part [5]\nof a leaf\n(a) its stem\n(a) red (b) blue (c) green\nQ.2 Why?\na) one\nb) two\n3. Where"
    pages = spark.createDataFrame([(1, 1, text)], "document_id int, page_number int, text string")
    got = [(r.question_number, r.parent_question_number, r.text, r.options, r.section) for r in Q.segment_questions(Q.carry_section(Q.classify_lines(pages))).orderBy("ord").collect()]
    assert got == [("Q1", None, "Name the part [5] of a leaf", [], "A"), ("Q1(a)", "Q1", "its stem", ["red", "blue", "green"], "A"), ("Q2", None, "Why?", ["one", "two"], "A"), ("Q3", None, "Where", [], "A")]


def test_headings(spark):
    heads = {"x\nChapter 3 The heart": "Chapter 3 The heart", "3.1 Photosynthesis": "3.1 Photosynthesis", "a\nWATER AND AIR": "WATER AND AIR", "plain words": None}
    df = spark.createDataFrame([(k,) for k in heads], "t string")
    assert {r.t: r.h for r in df.select("t", C.detect_heading(F.col("t")).alias("h")).collect()} == heads


def test_balanced_json_with_escapes_quotes_and_no_end(spark):
    cases = {
        'say "hi { {"a": 1} then': None, '\\"{"a": "\\"}"} }': '{"a": "\\"}"}', "{\n}x": "{\n}", "}{}": "{}", '{"a': None, "none": None, "": None, '{"a": "\\\\"}}': '{"a": "\\\\"}', '{"k": "\U0001f600{"} z': '{"k": "\U0001f600{"}', "{" + "x" * 9000 + "}": "{" + "x" * 9000 + "}",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", X.balanced_json(F.col("t")).alias("j"))
    assert [r.j for r in sorted(rows.collect())] == list(cases.values())
    parsed = spark.createDataFrame([('x {"s": "y"} z',)], "t string").select(X.parse_model_json(F.col("t"), "s string").alias("g"))
    assert parsed.select("g.s").first().s == "y" and parsed._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
