"""Restated benchmark items against a comparison of all sentences."""

import re

from pyspark.sql import functions as F

from heronlake.functions.text import content_terms, sentences
from heronlake.operators import novelty as N


def brute(spark, docs, items, percent=70, least=0.5):
    def said(rows):
        df = spark.createDataFrame(rows, "id long, text string").select("id", F.explode(sentences(F.col("text"))).alias("s")).select("id", content_terms(F.col("s")).alias("t"))
        out = {}
        for r in df.collect():
            if len(r.t) >= 3:
                out.setdefault(r.id, set()).add(frozenset(r.t))
        return out

    found = []
    for d, ds in said(docs).items():
        for i, its in said(items).items():
            n = sum(any(100 * len(x & y) >= percent * max(len(x), len(y)) for x in ds) for y in its)
            if n and n / len(its) >= least:
                found.append((d, i, n, round(n / len(its), 6)))
    return sorted(found, key=repr)


def pick(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_restatements_equal_all_pairs(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i, text in items:
        words = re.split(r" ", text)
        # every sixth word goes, or the words turn round within their sentence's half
        docs.append((10_000 + i, " ".join(w for k, w in enumerate(words) if k % 6 or w[-1] in ".?!")))
        docs.append((20_000 + i, ". ".join(" ".join(reversed(s.split())) for s in re.split(r"[.?!]\s*", text))))
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(8)
    got = pick(N.corpus_restatements(frame(docs, "doc_id"), frame(items, "item_id")))
    assert got == brute(spark, docs, items)
    copies = {(d, i) for d, i, _, _ in got}
    assert sum((20_000 + i, i) in copies for i, _ in items) >= 0.9 * len(items)


def test_restatements_of_odd_rows(spark):
    items = [(1, "Plants turn sunlight into sugar. Roots drink water below ground."), (1, "Plants turn sunlight into sugar. Roots drink water below ground."), (2, None), (3, ""), (4, "Go on."), (None, "Rivers carry sand towards seas.")]
    docs = [(1, "Sugar, plants turn sunlight into!"), (1, "Sugar, plants turn sunlight into!"), (2, None), (3, ""), (4, "word " * 50_000 + ". Roots drink cold water below ground."), (5, "Plants like sunlight."), (None, "Towards seas rivers carry sand. Rivers carry sand towards seas.")]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string").repartition(4).withColumns({"key": F.lit("x"), "terms": F.lit(1), "_item": F.lit(2)})
    d, i = frame(docs, "doc_id"), frame(items, "item_id")
    assert pick(N.corpus_restatements(d, i)) == sorted([(1, 1, 1, 0.5), (4, 1, 1, 0.5), (None, None, 1, 1.0)], key=repr)
    assert N.corpus_restatements(d.limit(0), i).count() == N.corpus_restatements(d, i.limit(0)).count() == 0


def test_texts_are_parsed_once(spark):
    d = spark.createDataFrame([(1, "Plants turn sunlight into sugar. Go on.")], "doc_id long, text string")
    found = N.corpus_restatements(d, d.withColumnRenamed("doc_id", "item_id"))
    # its sets are read from files, not found again for each use
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert pick(found) == [(1, 1, 1, 1.0)]
