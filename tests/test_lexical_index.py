"""The kept lexical index: only stale scopes are rebuilt, and searches through it equal searches without it."""

import os
import tempfile

from pyspark.sql import functions as F

from heronlake.operators import retrieval
from heronlake.sources.lexical_index import open_index, refresh

_SCHEMA = "chunk_id string, chunk_type string, class string, subject string, text string, chapter string, section string, source_hash string"


def _chunks(spark, changed="rivers"):
    rows = [(f"{c}{s}{k}", "parent" if k == 4 else "child", c, s, f"{changed if (c, s) == ('a', 'x') else 'leaves'} carry water {'water ' * k} number{k}", None, "s", "h") for c in "ab" for s in "xy" for k in range(5)]
    rows += [("empty", "child", "", "x", "leaves", "", None, None), ("null", "child", None, "x", "leaves", None, None, None), ("bare", "child", "a", "y", None, None, None, "h")]
    return spark.createDataFrame(rows, _SCHEMA)


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_changed_scope_alone_is_rebuilt_and_a_lost_one_is_met_no_more(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    q = spark.createDataFrame([(1, "a", "x", "water rivers"), (2, "b", "y", "leaves"), (3, None, "x", "leaves"), (4, "", "x", "leaves"), (5, "a", "y", "the"), (6, "zz", "x", "water")], "query_id long, class string, subject string, query string")
    assert open_index(spark, path)["stats"].count() == 0
    assert refresh(_chunks(spark), path).count() == 6
    assert refresh(_chunks(spark), path).count() == 0
    before = _files(f"{path}/postings")
    assert _rows(retrieval.bm25_search(q, _chunks(spark), 3, index=open_index(spark, path))) == _rows(retrieval.bm25_search(q, _chunks(spark), 3))

    new = _chunks(spark, "streams")
    assert [(r["class"], r["subject"]) for r in refresh(new, path).collect()] == [("a", "x")]
    after = _files(f"{path}/postings")
    touched = {f.split("/")[-2] for f in before.keys() ^ after.keys()}
    assert len(touched) == 1 and all(after[f] == t for f, t in before.items() if f in after)
    assert _rows(retrieval.bm25_search(q, new, 3, index=open_index(spark, path))) == _rows(retrieval.bm25_search(q, new, 3))

    left = new.where(~F.col("class").eqNullSafe(F.lit("b")))
    assert refresh(left, path).count() == 0
    found = retrieval.bm25_search(q, left, 3, index=open_index(spark, path))
    assert _rows(found) == _rows(retrieval.bm25_search(q, left, 3)) and found.where("query_id = 2").count() == 0
    assert refresh(new, path).count() == 2 and retrieval.bm25_search(q, new, 3, index=open_index(spark, path)).where("query_id = 2").count() == 3


def test_search_reads_the_scopes_of_the_queries_only(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    refresh(_chunks(spark), path)
    q = spark.createDataFrame([(1, "a", "x", "water")], "query_id long, class string, subject string, query string")
    plan = retrieval.bm25_search(q, _chunks(spark), 3, index=open_index(spark, path))._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_empty_chunks_give_an_empty_index(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    assert refresh(spark.createDataFrame([], _SCHEMA), path).count() == 0 and open_index(spark, path)["postings"].count() == 0


def test_repeated_chunks_count_together_and_postings_stay_where_they_are(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    rows = [("a1", "child", "a", "x", "Water's water, THE river \u0130 a", None, "s", "h"), ("a1", "child", "a", "x", "rivers water water s", None, None, "h"), ("a1", "parent", "a", "x", "water", None, "s", "h"), (None, "child", "a", "x", "water", None, None, "h"), (None, "child", "a", "x", "water", None, None, "h"), ("a2", "child", "a", "x", "", None, None, "h"), ("a3", "child", "a", "x", "water rivers", None, "s", "h")]
    c = spark.createDataFrame(rows, _SCHEMA)
    q = spark.createDataFrame([(1, "a", "x", "water rivers water's"), (2, "a", "x", "rivers")], "query_id long, class string, subject string, query string")
    refresh(c, path)
    index = open_index(spark, path)
    postings, _, stats = retrieval.bm25_index(c)
    assert _rows(index["postings"].select("term", F.coalesce("chunk_id", F.lit("-")), "chunk_type", "len", "tf")) == _rows(postings.select("term", F.coalesce("chunk_id", F.lit("-")), "chunk_type", "len", "tf"))
    assert _rows(index["stats"].select("docs", "avgdl")) == _rows(stats.select("docs", "avgdl"))
    found = retrieval.bm25_search(q, c, 5, index=index)
    assert _rows(found.na.fill({"chunk_id": "-"})) == _rows(retrieval.bm25_search(q, c, 5).na.fill({"chunk_id": "-"}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(scope" not in plan
