"""Duplicates, novelty and overlap of items."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.config import DEFAULT
from heronlake.functions.text import content_terms, information_demand, norm_text, overlap_max, overlap_min, sentences, summary_trigger
from heronlake.operators.retrieval import cosine, dense_search, dot, normalized, top
from heronlake.sources.staging import written


def source_similarity(items: DataFrame, past: DataFrame, threshold: float = DEFAULT.similarity, on: list[str] | None = None) -> DataFrame:
    """question_id, max_similarity (6 digits), question_number, duplicate: the nearest past item of the same scope."""
    on = on or ["class", "subject"]
    best = dense_search(items.select(F.col("question_id").alias("query_id"), *on, F.col("embedding").alias("query_vec")), past.select(*on, F.col("question_number").alias("chunk_id"), "embedding"), 1, on)
    return best.select(F.col("query_id").alias("question_id"), F.col("score").alias("max_similarity"), F.col("chunk_id").alias("question_number"), (F.col("score") >= threshold).alias("duplicate"))


def peer_duplicates(batch: DataFrame, threshold: float = DEFAULT.similarity, group: str = "paper_id") -> DataFrame:
    """question_id, peer_id, similarity: the later item of each close pair of a batch, with its best earlier peer.

    Pairs meet within a group only; a group is one paper's batch of items.
    """
    v = batch.select(group, "question_id", "slot_index", normalized(F.col("embedding")).alias("v"))
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.slot_index") < F.col("b.slot_index")))
    close = pairs.select(F.col("b.question_id").alias("question_id"), F.col("a.question_id").alias("peer_id"), F.round(dot(F.col("a.v"), F.col("b.v")), 6).alias("similarity")).where(F.col("similarity") >= threshold)
    return top(close, ["question_id"], [F.desc("similarity"), F.asc("peer_id")], 1).drop("rank")


def exact_duplicates(items: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, first_id, duplicate: the first row by id of each normalised text stays. Minima are pre-aggregated, so a hot text is no hot task."""
    key = F.sha2(norm_text(F.coalesce(F.col(text_col), F.lit(""))), 256)
    keyed = items.select(id_col, key.alias("key"))
    first = keyed.groupBy("key").agg(F.min(id_col).alias("first_id"))
    return keyed.join(first, "key").select(id_col, "first_id", (F.col(id_col) != F.col("first_id")).alias("duplicate"))


def overlaps(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with by_min and by_max overlap of content terms, and whether one restates the other's stem."""
    x, y = content_terms(F.col(a)), content_terms(F.col(b))
    words = lambda c: F.array_distinct(F.filter(F.split(norm_text(F.col(c)), r"[^a-z0-9]+"), lambda w: F.length(w) > 2))
    restated = (F.size(words(a)) >= 3) & (F.size(words(b)) >= 3) & (overlap_min(words(a), words(b)) >= 0.7)
    return pairs.withColumns({"by_min": F.round(overlap_min(x, y), 6), "by_max": F.round(overlap_max(x, y), 6), "restated": restated})


#: Novelty thresholds (near paraphrase, same demand) by type; others use the last.
TYPE_THRESHOLDS = {"SHORT_ANSWER": (0.85, 0.65), "LONG_ANSWER": (0.9, 0.7)}
OTHER_THRESHOLDS = (0.8, 0.55)


def novelty_verdict(pairs: DataFrame) -> DataFrame:
    """``pairs`` (text, reference_text, type) with overlap, verdict.

    EXACT_COPY of the normalised text; SAME_DEMAND_SHAPE where both ask for the whole's summary; with one information
    demand, NEAR_PARAPHRASE or SAME_INFORMATION_DEMAND by overlap. A type's thresholds only ever lower a verdict.
    """
    shared = overlap_min(content_terms(F.col("text")), content_terms(F.col("reference_text")))
    near = F.lit(OTHER_THRESHOLDS[0])
    same = F.lit(OTHER_THRESHOLDS[1])
    for t, (n, s) in TYPE_THRESHOLDS.items():
        near, same = F.when(F.col("type") == t, n).otherwise(near), F.when(F.col("type") == t, s).otherwise(same)
    one_demand = information_demand(F.col("text")) == information_demand(F.col("reference_text"))
    p = pairs.withColumns({"overlap": shared, "_near": F.greatest(near, F.lit(OTHER_THRESHOLDS[0])), "_same": F.greatest(same, F.lit(OTHER_THRESHOLDS[1])), "_one": one_demand})
    verdict = (
        F.when(norm_text(F.col("text")) == norm_text(F.col("reference_text")), "EXACT_COPY")
        .when(summary_trigger(F.col("text")).isNotNull() & summary_trigger(F.col("reference_text")).isNotNull(), "SAME_DEMAND_SHAPE")
        .when(F.col("_one") & (F.col("overlap") >= F.col("_near")), "NEAR_PARAPHRASE")
        .when(F.col("_one") & (F.col("overlap") >= F.col("_same")), "SAME_INFORMATION_DEMAND")
        .otherwise("NOVEL")
    )
    return p.withColumn("verdict", verdict).withColumn("overlap", F.round("overlap", 6)).drop("_near", "_same", "_one")


def parameter_swap(pairs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``pairs`` with skeleton overlap and swapped: a coding task that only changes the reference's numbers or names."""
    coding = r"(?i)\b(write|implement|develop|create)\b[^.?!]{0,60}\b(program|function|method|code|script|class|algorithm)\b"
    dynamic = r"(?i)\b(user input|input from|accept|read|scanner|enter)\b"
    skeleton = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(F.col(c)), r"\b(display|output|show)\b", "print"), r"\d+", "#"), r"[^a-z#]+"), lambda w: w != ""))
    shared = F.round(overlap_min(skeleton("text"), skeleton("reference_text")), 6)
    is_task = F.col("text").rlike(coding) & F.col("reference_text").rlike(coding) & ~F.col("text").rlike(dynamic)
    return pairs.withColumn("skeleton_overlap", shared).withColumn("swapped", is_task & (shared >= threshold))


def backstop_failures(pairs: DataFrame, threshold: float = DEFAULT.embedding_novelty) -> DataFrame:
    """``pairs`` with s (cosine, 6 digits) and bad."""
    narrow = F.col("type").isin("MCQ", "TRUE_FALSE", "FILL_IN_THE_BLANK")
    p = pairs.withColumn("s", F.round(cosine(F.col("vec"), F.col("ref_vec")), 6))
    return p.withColumn("bad", (F.col("s") >= threshold) & (~narrow | (F.col("overlap") >= OTHER_THRESHOLDS[1])))


def embedding_backstop(pairs: DataFrame, threshold: float = DEFAULT.embedding_novelty) -> DataFrame:
    """paper_id, passed, failed, first_position, first_similarity over positional pairs (vec, ref_vec, type, overlap).

    A pair fails at the threshold; narrow types fail only if their overlap also reaches the demand floor.
    """
    p = backstop_failures(pairs, threshold)
    first = F.min(F.when(F.col("bad"), F.struct("position", "s")))
    g = p.groupBy("paper_id").agg(F.count_if(~F.col("bad")).alias("passed"), F.count_if("bad").alias("failed"), first.alias("f"))
    return g.select("paper_id", "passed", "failed", F.col("f.position").alias("first_position"), F.col("f.s").alias("first_similarity"))


def topic_fidelity(pairs: DataFrame, least: float = 0.25) -> DataFrame:
    """id, coverage, passes: the share of the anchor's terms that the text has, equal or by a long common prefix.

    Terms meet on their first four characters, so no pair of term lists is compared in full.
    """
    t = pairs.select("id", F.explode(content_terms(F.col("text"))).alias("w")).withColumn("p", F.substring("w", 1, 4))
    a = pairs.select("id", F.explode(content_terms(F.col("anchor"))).alias("a")).withColumn("p", F.substring("a", 1, 4))
    n = F.greatest(F.lit(4), F.least(F.length("a"), F.length("w")) - 1)
    met = a.join(t, ["id", "p"]).where((F.col("a") == F.col("w")) | (F.substring(F.col("a"), F.lit(1), n) == F.substring(F.col("w"), F.lit(1), n)) & (F.least(F.length("a"), F.length("w")) >= 4))
    hit = met.groupBy("id").agg(F.countDistinct("a").alias("hit"))
    out = pairs.select("id", F.size(content_terms(F.col("anchor"))).alias("terms")).join(hit, "id", "left")
    cover = F.round(F.coalesce(F.try_divide(F.coalesce("hit", F.lit(0)), F.col("terms")), F.lit(1.0)), 6)
    return out.select("id", cover.alias("coverage"), (cover >= least).alias("passes"))


def pool_diversity(pool: DataFrame) -> DataFrame:
    """pool_id, id, diversity: one less the mean overlap with the pool's other members; 1 if alone or without terms."""
    t = pool.select("pool_id", "id", content_terms(F.col("text")).alias("t"))
    a, b = t.alias("a"), t.alias("b")
    met = a.join(b, (F.col("a.pool_id") == F.col("b.pool_id")) & (F.col("a.id") != F.col("b.id")))
    mean = met.groupBy(F.col("a.pool_id").alias("pool_id"), F.col("a.id").alias("id")).agg(F.avg(overlap_max(F.col("a.t"), F.col("b.t"))).alias("m"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.coalesce("m", F.lit(0.0))))
    return t.join(mean, ["pool_id", "id"], "left").select("pool_id", "id", F.round(F.when(F.size("t") == 0, 1.0).otherwise(value), 6).alias("diversity"))


def longest_run(a: list[str], b: list[str]) -> tuple[int, int]:
    """(start in ``a``, length) of the longest run of words that ``b`` has too, the first of equal ones.

    A suffix automaton of ``b`` reads ``a`` once: linear in both, however long the run.
    """
    step, link, size, last = [{}], [-1], [0], 0
    for word in b:
        new, at = len(step), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at >= 0:
            to = step[at][word]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(step)
                step.append(dict(step[to]))
                link.append(link[to])
                size.append(size[at] + 1)
                while at >= 0 and step[at].get(word) == to:
                    step[at][word] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    state = run = best = start = 0
    for i, word in enumerate(a):
        while state and word not in step[state]:
            state = link[state]
            run = size[state]
        if word in step[state]:
            state, run = step[state][word], run + 1
        if run > best:
            best, start = run, i + 1 - run
    return start, best


def longest_shared_phrase(pairs: DataFrame, least: int = 3) -> DataFrame:
    """id, words, phrase: the longest run of words that both texts have, of equal ones the first in ``a``; null below ``least`` words.

    A pair's two texts are read in one place, as they stand in one row; null texts have no words.
    """

    @F.pandas_udf("struct<words int, phrase string>")
    def shared(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x = [] if x is None else list(x)
            start, n = longest_run(x, [] if y is None else list(y))
            rows.append((n, " ".join(x[start : start + n])) if n >= least else (None, None))
        return pd.DataFrame(rows, columns=["words", "phrase"]).astype({"words": "Int32"})

    w = lambda c: F.filter(F.split(norm_text(F.regexp_replace(F.lower(F.col(c)), r"[^a-z0-9\s]", " ")), " "), lambda x: x != "")
    return pairs.select("id", shared(w("a"), w("b")).alias("m")).select("id", "m.words", "m.phrase")


def corpus_contamination(corpus: DataFrame, benchmark: DataFrame, n: int = 8, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, shared, coverage of documents that hold at least ``least`` of an item's distinct n-word runs.

    The corpus side is cut to the items' own runs by an equi join; runs are pre-aggregated per document before it.
    """
    w = F.filter(F.split(norm_text(F.col("text")), " "), lambda x: x != "")
    runs = F.array_distinct(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i + n - 1 <= F.size("w")), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "))))
    items = benchmark.withColumn("w", w).select("item_id", runs.alias("r")).withColumn("runs", F.size("r"))
    docs = corpus.withColumn("w", w).select("doc_id", F.explode(runs).alias("h"))
    met = docs.join(items.select("item_id", "runs", F.explode("r").alias("h")), "h").groupBy("doc_id", "item_id", "runs").agg(F.count("*").alias("shared"))
    return met.select("doc_id", "item_id", "shared", F.round(F.col("shared") / F.col("runs"), 6).alias("coverage")).where(F.col("coverage") >= least)


def corpus_restatements(corpus: DataFrame, benchmark: DataFrame, percent: int = 70, least: float = 0.5, shortest: int = 3) -> DataFrame:
    """doc_id, item_id, restated, coverage of documents that restate at least ``least`` of an item's sentences.

    A sentence restates another where they share ``percent`` of the content terms of the longer; sentences of fewer than
    ``shortest`` terms say too little. No pair at the bound is lost: of n terms a partner shares n * percent / 100
    rounded up, so both have one of the others plus one that are rarest in the benchmark, and sentences meet at these
    alone. A document's terms that no item has come first in that order and meet nothing, so most sentences leave with
    the terms' equi join. Equal term sets are compared once however often they stand in the corpus; shared terms are
    counted exactly. Null or empty texts restate nothing; repeated rows and sentences count once; rows of a null id
    are one document or item; other columns are ignored.
    """

    def said(rows: DataFrame, id_col: str) -> DataFrame:
        # terms are found and counted before they become rows, so a filter does not find them again
        sets = F.transform(F.array_distinct(sentences(F.col("text"))), lambda s: F.array_sort(content_terms(s)))
        one = rows.select(id_col, F.explode(F.array_distinct(F.filter(sets, lambda t: F.size(t) >= shortest))).alias("terms"))
        return one.withColumn("key", F.unhex(F.sha2(F.array_join("terms", " "), 256)))

    def rarest(sets: DataFrame, counts: DataFrame) -> DataFrame:
        known = sets.select("key", F.size("terms").alias("n"), F.explode("terms").alias("term")).join(counts, "term")
        place = known.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("held", "term"))).alias("ts"))
        # unknown terms, n - size(ts) of them, stand before all others; the first n - shared + 1 places are kept
        free = F.size("ts") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
        return place.where(free > 0).select("key", "n", F.explode(F.transform(F.slice("ts", 1, free), lambda x: x["term"])).alias("term"))

    # texts are parsed once: the sets are read three times
    docs, items = written(said(corpus, "doc_id"), "sentence-terms"), written(said(benchmark, "item_id"), "item-terms")
    doc_sets, item_sets = (x.select("key", "terms").dropDuplicates(["key"]) for x in (docs, items))
    counts = item_sets.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("held"))
    a = rarest(doc_sets, counts).select("term", F.col("key").alias("d"), F.col("n").alias("dn"))
    b = rarest(item_sets, counts).select("term", F.col("key").alias("i"), F.col("n").alias("bn"))
    fits = F.least("dn", "bn") * 100 >= F.greatest("dn", "bn") * percent
    met = a.join(b, "term").where(fits).select("d", "i").distinct()
    held = met.join(doc_sets.select(F.col("key").alias("d"), F.col("terms").alias("x")), "d").join(item_sets.select(F.col("key").alias("i"), F.col("terms").alias("y")), "i")
    same = held.where(F.size(F.array_intersect("x", "y")) * 100 >= F.greatest(F.size("x"), F.size("y")) * percent).select("d", "i")
    in_items = items.select("item_id", F.col("key").alias("i")).distinct()
    total = in_items.groupBy("item_id").agg(F.count("*").alias("said"))
    # an item's sentence counts once for a document, whichever of the document's sentences restate it
    hits = docs.select("doc_id", F.col("key").alias("d")).distinct().join(same, "d").select("doc_id", "i").distinct().join(in_items, "i")
    found = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("restated")).join(total.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item")))
    return found.select("doc_id", "item_id", "restated", F.round(F.col("restated") / F.col("said"), 6).alias("coverage")).where(F.col("coverage") >= least)
