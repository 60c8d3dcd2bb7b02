"""Items from paper text: line classes, sections, segmentation, marks, types and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.text import first_match, stem_key
from heronlake.operators.retrieval import top

#: What a line is, by its opening; the first that matches.
LINE_CLASSES = [
    (r"(?i)^\s*(?:section|part)\s*[-:]?\s*[A-Z]\b", "section"),
    (r"(?i)^\s*(?:general\s+)?instructions?\b|^\s*(?:all questions are compulsory|attempt all|time\s*:|maximum marks)", "instruction"),
    (r"(?i)^\s*[\[(]?\s*(?:marks?\s*[=:]?\s*)?\d{1,2}\s*(?:marks?)?\s*[\])]?\s*$", "marks"),
    (r"^\s*\(?[a-d][).]\s*\S+.*\s\(?[b-d][).]\s*\S+", "option_row"),
    (r"(?i)^\s*Q\s*\.?\s*\d+\s*[.:)]?\s*\S", "main"),
    (r"^\s*\d{1,2}[.)]\s+\S", "number"),
    (r"^\s*\([a-z]\)\s*\S", "sub"),
    (r"^\s*[a-d][.)]\s+\S", "option"),
    (r"(?i)^\s*\(?[ivx]+[.)]\s+\S", "roman"),
    (r"^\s*$", "blank"),
]


def classify_lines(page_text: DataFrame) -> DataFrame:
    """document_id, ord, page_number, line, kind of each line; what fits no class continues the open item."""
    lines = page_text.select("document_id", "page_number", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.select("document_id", (F.col("page_number") * 100000 + F.col("i")).alias("ord"), "page_number", "line", first_match(F.col("line"), LINE_CLASSES, "text").alias("kind"))


def carry_section(lines: DataFrame) -> DataFrame:
    """Lines with section: a header's letter holds until the next."""
    w = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    letter = F.when(F.col("kind") == "section", F.upper(F.regexp_extract("line", r"(?i)(?:section|part)\s*[-:]?\s*([A-Z])\b", 1)))
    return lines.withColumn("section", F.last(letter, ignorenulls=True).over(w))


def segment_questions(lines: DataFrame) -> DataFrame:
    """document_id, ord (from 0), question_number, parent_question_number, text, options, section.

    A main opens an item, a lettered sub opens one under the last main; until the next opener or section header, options
    attach to the open item and other lines continue its text. A segmented scan: running counts and last values over a
    document's lines tell each line its item, and items are put together from their own lines. Lines before the first
    opener belong to no item, a sub without a main is no item; null lines count as blank, rows of a null document_id
    are one document.
    """
    rows = lines.select("document_id", "ord", "kind", "section", F.coalesce("line", F.lit("")).alias("line"))
    upto = Window.partitionBy("document_id").orderBy("ord", "line").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    is_main = kind.isin("main", "number")
    body = r"(?is)^\s*Q?\s*\.?\s*(\d+)\s*[.:)]?\s*(.*)$"
    rows = rows.withColumn("main", F.last(F.when(is_main, F.concat(F.lit("Q"), F.regexp_extract("line", body, 1))), ignorenulls=True).over(upto))
    opens = F.coalesce(is_main | ((kind == "sub") & F.col("main").isNotNull()), F.lit(False))
    rows = rows.withColumn("opens", opens)
    live = F.last(F.when(F.col("opens"), True).when(kind == "section", False), ignorenulls=True).over(upto)
    rows = rows.withColumns({"item": F.sum(F.col("opens").cast("int")).over(upto), "live": live})
    rows = rows.where("live AND (opens OR kind NOT IN ('section', 'instruction', 'blank'))")

    letter = F.concat("main", F.lit("("), F.regexp_extract("line", r"^\s*\(([a-z])\)", 1), F.lit(")"))
    sub_text = F.regexp_extract("line", r"(?s)^\s*\([a-z]\)\s*(.*)$", 1)
    first = F.struct(F.when(is_main, F.col("main")).otherwise(letter).alias("question_number"), F.when(~is_main, F.col("main")).alias("parent"), F.when(is_main, F.regexp_extract("line", body, 2)).otherwise(sub_text).alias("text"), "section")
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    row_options = F.filter(F.transform(F.split("line", r"\s*\(?\b[a-d][).]\s*"), trimmed), lambda x: x != "")
    option = F.when(kind.isin("option", "roman"), F.array(trimmed(F.regexp_replace("line", r"^\s*\(?\w+[.)]\s*", "")))).when(kind == "option_row", row_options)
    more = ~F.col("opens") & ~F.coalesce(kind.isin("option", "roman", "option_row"), F.lit(False))
    in_order = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", F.col("line").alias("l"), value.alias("v"))))), lambda x: x["v"])
    g = rows.groupBy("document_id", "item").agg(
        F.max(F.when(F.col("opens"), first)).alias("q"),
        in_order(more, trimmed(F.col("line"))).alias("more"),
        F.flatten(in_order(~F.col("opens") & option.isNotNull(), option)).alias("options"),
    )
    text = F.when(F.size("more") == 0, F.col("q.text")).otherwise(trimmed(F.array_join(F.concat(F.array("q.text"), F.col("more")), " ")))
    return g.select("document_id", (F.col("item") - 1).cast("int").alias("ord"), "q.question_number", F.col("q.parent").alias("parent_question_number"), text.alias("text"), "options", "q.section")


def split_option_row(text: Column) -> Column:
    """Two or more options printed on one line, ``(a) x (b) y``; null if there are fewer."""
    found = F.regexp_extract_all(text, F.lit(r"\(?\b[a-d][).]\s*([^()]+?)\s*(?=\(?\b[b-e][).]|$)"), F.lit(1))
    return F.when(F.size(found) >= 2, F.transform(found, lambda x: F.trim(x)))


def split_inline_items(text: Column, most: int = 10) -> Column:
    """Items printed on one line, ``1. … 2. …``; null if there are fewer than two or more than ``most``."""
    found = F.regexp_extract_all(text, F.lit(r"(?:^|\s)\d{1,2}[.)]\s+(.+?)(?=\s\d{1,2}[.)]\s|$)"), F.lit(1))
    return F.when(F.size(found).between(2, most), F.transform(found, lambda x: F.trim(x)))


MARKS = r"(?i)(?:\[\s*(\d{1,2}(?:\.\d)?)\s*(?:marks?)?\s*\]|\(\s*(\d{1,2}(?:\.\d)?)\s*marks?\s*\)|marks?\s*=\s*(\d{1,2}(?:\.\d)?))\s*$"


def parse_marks(text: Column) -> tuple[Column, Column]:
    """(marks, text without them) of a mark at the end, above 0 and up to 20; an operand of a product is not one."""
    n = F.coalesce(*[F.nullif(F.regexp_extract(text, MARKS, k), F.lit("")) for k in (1, 2, 3)]).try_cast("double")
    ok = (n > 0) & (n <= 20) & ~text.rlike(r"[xX×*=]\s*[\[(]\s*\d+\s*[\])]\s*$")
    return F.when(ok, n), F.when(ok, F.trim(F.regexp_replace(text, MARKS, ""))).otherwise(text)


def repair_orphan_marks(questions: DataFrame, orphans: DataFrame) -> DataFrame:
    """Questions with marks: unmarked mains take the document's lone mark lines by place, if there are as many of each."""
    w = Window.partitionBy("document_id").orderBy("ord")
    all_ = Window.partitionBy("document_id")
    bare = questions.where("marks IS NULL AND parent_question_number IS NULL").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(all_))
    lone = orphans.withColumn("k", F.row_number().over(w)).withColumn("m", F.count("*").over(all_)).select("document_id", "k", "m", F.col("marks").alias("lone"))
    fixed = bare.join(lone, ["document_id", "k"]).where("n = m").select("document_id", "ord", "lone")
    return questions.join(fixed, ["document_id", "ord"], "left").withColumn("marks", F.coalesce("marks", "lone")).drop("lone")


def classify_item_type(n_options: Column, text: Column, marks: Column) -> Column:
    return F.when(n_options >= 2, "MCQ").when(text.rlike(r"(?i)true\s*(?:or|/)\s*false"), "TRUE_FALSE").when(text.rlike(r"_{3,}"), "FILL_IN_THE_BLANK").when(marks >= 4, "LONG_ANSWER").otherwise("SHORT_ANSWER")


def dedupe_items(questions: DataFrame) -> DataFrame:
    """Without texts under five characters; the first of each stem in a document."""
    q = questions.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= 5).withColumn("_key", stem_key(F.col("text")))
    return top(q, ["document_id", "_key"], [F.asc("ord")], 1, "_k").drop("_key", "_k")


def locate_page(questions: DataFrame, page_text: DataFrame) -> DataFrame:
    """Questions with page_number: the first page of their document that holds their first 30 characters; the only page is 1."""
    p = page_text.select("document_id", F.col("page_number").alias("p"), F.lower("text").alias("page"))
    pages = page_text.groupBy("document_id").agg(F.count("*").alias("pages"))
    met = questions.select("document_id", "ord", F.lower(F.substring("text", 1, 30)).alias("t")).join(p, "document_id").where(F.contains("page", F.col("t")))
    first = met.groupBy("document_id", "ord").agg(F.min("p").alias("found"))
    j = questions.join(first, ["document_id", "ord"], "left").join(pages, "document_id", "left")
    return j.withColumn("page_number", F.when(F.col("pages") == 1, F.lit(1).cast("long")).otherwise(F.col("found").cast("long"))).drop("found", "pages")
