"""Corpus catalog, picture catalog and paper library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.text import canonical_scope, normalize_unit_label


def list_documents(chunks: DataFrame) -> DataFrame:
    """source_hash, title, class, subject, chunks, ingested_at, units: documents by hash, units in first-seen order with counts."""
    per_unit = chunks.where("source_hash IS NOT NULL").groupBy("source_hash", "unit").agg(
        F.min("chunk_index").alias("first"), F.count("*").alias("n"), F.min_by("source_filename", "chunk_index").alias("title"), F.min_by("class", "chunk_index").alias("class"), F.min_by("subject", "chunk_index").alias("subject"), F.max("ingested_at").alias("at")
    )
    units = F.transform(F.array_sort(F.collect_list(F.when(F.col("unit").isNotNull(), F.struct("first", "unit", "n")))), lambda u: F.concat(u["unit"], F.lit(":"), u["n"].cast("string")))
    return per_unit.groupBy("source_hash").agg(F.min_by("title", "first").alias("title"), F.min_by("class", "first").alias("class"), F.min_by("subject", "first").alias("subject"), F.sum("n").alias("chunks"), F.max("at").alias("ingested_at"), units.alias("units"))


def list_units(chunks: DataFrame) -> DataFrame:
    return chunks.where("unit IS NOT NULL").groupBy("class", "subject", "unit").agg(F.count("*").alias("chunks"))


def list_topics(chunks: DataFrame, heading: str = "section") -> DataFrame:
    """class, subject, topic, chunks: the chapter, else the heading; blank ones are skipped."""
    topic = F.coalesce(F.nullif(F.trim("chapter"), F.lit("")), F.nullif(F.trim(heading), F.lit("")))
    return chunks.select("class", "subject", topic.alias("topic")).where("topic IS NOT NULL").groupBy("class", "subject", "topic").agg(F.count("*").alias("chunks"))


def unit_has_notes(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``pairs`` (class, subject, unit) with has_notes; class and subject in canonical form, the unit exactly."""
    key = lambda df: df.withColumns({"_c": canonical_scope(F.col("class")), "_s": canonical_scope(F.col("subject"))})
    have = key(chunks).select("_c", "_s", "unit").distinct().withColumn("has_notes", F.lit(True))
    return key(pairs).join(have, ["_c", "_s", "unit"], "left").withColumn("has_notes", F.coalesce("has_notes", F.lit(False))).drop("_c", "_s")


def search_documents(documents: DataFrame, text: str | None = None, class_: str | None = None, subject: str | None = None) -> DataFrame:
    """Documents of a scope whose title, class, subject or units contain the text."""
    out = documents
    for c, v in (("class", class_), ("subject", subject)):
        if v:
            out = out.where(canonical_scope(F.col(c)) == canonical_scope(F.lit(v)))
    if text and text.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "title", "class", "subject", F.array_join("units", " "))), F.lit(text.strip().lower())))
    return out


def merge_units(document_units: DataFrame, session_units: DataFrame) -> DataFrame:
    """unit, source: document units first, then session units, one for each normalised label."""
    both = document_units.select("unit", F.lit("document").alias("source"), F.lit(0).alias("_s")).unionByName(session_units.select("unit", F.lit("session").alias("source"), F.lit(1).alias("_s")))
    g = both.groupBy(normalize_unit_label(F.col("unit")).alias("label")).agg(F.min(F.struct("_s", "unit", "source")).alias("m"))
    return g.select("m.unit", "m.source")


def picture_catalog(elements: DataFrame) -> DataFrame:
    """document_id, ord, section, topic, context, image_type of pictures: the last headings carried forward, three elements either side."""
    w = Window.partitionBy("document_id").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    generic = F.lower(F.trim("text")).isin("introduction", "summary", "activity", "exercise", "examples", "example")
    h = F.col("type") == "heading"
    section = F.last(F.when(h & ~generic, F.col("text")), ignorenulls=True).over(upto)
    topic = F.last(F.when(h, F.when(generic, F.concat_ws(" - ", F.col("section"), "text")).otherwise(F.col("text"))), ignorenulls=True).over(upto)
    text = F.when(F.col("type") != "picture", F.col("text"))
    around = F.concat(F.collect_list(text).over(w.rowsBetween(-3, -1)), F.collect_list(text).over(w.rowsBetween(1, 3)))
    rows = elements.withColumn("section", section).withColumn("topic", topic).withColumn("context", F.array_join(around, " "))
    low = F.lower(F.concat_ws(" ", "topic", "context"))
    kind = F.when(low.rlike(r"\bmap\b"), "map").when(low.rlike(r"\b(graph|chart)\b"), "chart").when(low.rlike(r"\b(diagram|cycle|structure)\b"), "diagram").when(low.rlike(r"\btable\b"), "table").otherwise("picture")
    return rows.where("type = 'picture'").select("document_id", "ord", "section", "topic", "context", kind.alias("image_type"))


def picture_concepts(context, most: int = 8):
    """Distinct capitalised phrases of a text, first ``most``, without common openers."""
    stop = ["The", "This", "That", "These", "Those", "It", "In", "On", "A", "An", "And", "But", "When", "What", "Why", "How", "Of", "To", "Is", "Are", "By", "For", "As", "At"]
    phrases = F.regexp_extract_all(context, F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(phrases, lambda p: ~p.isin(stop))), 1, most)


def picture_search(catalog: DataFrame, topic: str | None, image_type: str | None, page: int, limit: int) -> DataFrame:
    """One page of pictures by document and place, with the total and the number of pages."""
    rows = catalog
    if topic:
        rows = rows.where(F.contains(F.lower("topic"), F.lit(topic.lower())))
    if image_type:
        rows = rows.where(F.col("image_type") == image_type)
    total = rows.agg(F.count("*").alias("total"))
    first = rows.orderBy("document_id", "ord").limit(page * limit)  # a page's rows only: the sort keeps that many per task
    shown = first.withColumn("k", F.row_number().over(Window.orderBy("document_id", "ord"))).where(F.col("k") > (page - 1) * limit)
    return shown.crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / limit))  # one row


def topic_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("topic").agg(F.count("*").alias("pictures"))


#: Sort orders of the library; the id breaks ties.
SORTS = {"recent": F.desc, "oldest": F.asc, "updated": F.desc, "title": F.asc, "marks": F.desc}
SORT_COLUMNS = {"recent": "created_at", "oldest": "created_at", "updated": "updated_at", "title": "title", "marks": "total_marks"}


def library_list(library: DataFrame, text: str | None = None, class_: str | None = None, subject: str | None = None, status: str | None = None, sort: str = "recent", limit: int | None = None) -> DataFrame:
    """Records by filters in sort order, without heavy columns."""
    out = library
    if text:
        out = out.where(F.contains(F.lower(F.concat_ws(" ", "title", "subject")), F.lit(text.lower())))
    for c, v in (("class", class_), ("subject", subject), ("status", status)):
        if v:
            out = out.where(F.col(c) == v)
    out = out.orderBy(SORTS[sort](SORT_COLUMNS[sort]), F.asc("id"))
    return (out.limit(limit) if limit else out).drop("content", "answer_key")


def library_facets(library: DataFrame) -> DataFrame:
    """facet, value, ord: distinct classes, numbers first, and subjects."""
    n = F.try_to_number(F.col("value"), F.lit("999999"))
    c = library.select(F.lit("class").alias("facet"), F.col("class").alias("value")).distinct()
    s = library.select(F.lit("subject").alias("facet"), F.col("subject").alias("value")).distinct()
    w = Window.partitionBy("facet").orderBy(F.when(F.col("facet") == "class", n).asc_nulls_last(), "value")
    return c.union(s).withColumn("ord", F.row_number().over(w))


def library_stats(library: DataFrame) -> DataFrame:
    """class, status, n, and totals over either or both."""
    return library.cube("class", "status").agg(F.count("*").alias("n"))
