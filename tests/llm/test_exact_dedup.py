import hashlib
import string

from pyspark.sql import functions as F

from heronlake.llm import exact_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    by = {}
    for d, t in rows:
        by.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for t, ids in by.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        out += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, recipe string, chunks string")
    assert sorted((tuple(r) for r in exact_dedup.groups(docs).collect()), key=str) == brute(rows)
    return docs


def test_small_cases(spark):
    docs = check(spark, [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (None, "ab"), (8, "long text. " * 5000), (9, "LONG text. " * 5000), (10, "x" * 50_000), (11, "x" * 50_001), (11, "x" * 50_001)])
    assert sorted(r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()) == [2, 4, 5, 6, 9, 10, 11]
    rows = [(5, "x"), (9, "X"), (5, "y"), (7, "same"), (7, "same"), (None, "n"), (None, "n"), (None, "x")]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, _kept string, _row long")
    assert sorted((tuple(r) for r in exact_dedup.drop_duplicates(docs).collect()), key=str) == [(5, "y", "k", 1), (7, "same", "k", 1), (9, "X", "k", 1), (None, "n", "k", 1)]
    check(spark, [])


def test_test_data(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_chunks_join_to_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cut = docs.withColumn("c", F.regexp_extract_all("text", F.lit(exact_dedup.CHUNK), F.lit(0)))
    assert cut.where(F.array_join("c", "") != F.col("text")).count() == 0
    assert cut.agg(F.max(F.size("c"))).first()[0] > 1


def test_colliding_identifiers_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "")], "doc_id long, text string")
    listed = exact_dedup.recipes(docs).withColumn("chunks", F.transform("chunks", lambda c: F.struct(F.lit(7).cast("long").alias("id"), c["sha"].alias("sha"), c["size"].alias("size"))))
    got = {r.doc_id: str(r.recipe) for r in exact_dedup.verified_ids(listed).collect()}
    assert got[1] == got[3] != got[2] and got[4] == "[]"


def test_plan_has_no_python(spark, sf):
    plan = exact_dedup.groups(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
