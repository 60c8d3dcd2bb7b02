"""Sectioning and chunking of documents. Only steps that carry state from line to line fold; all folds stay inside one document."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.text import sentences, stable_id, token_count

LEAST_BODY, MOST_BLOCK, LEAST_CHUNK = 200, 1200, 200
CHUNK_MIN, CHUNK_MAX, CHUNK_OVERLAP = 60, 350, 40
#: A line that opens a section: a named part, a numbered title, or capitals throughout.
HEADING = r"^\s*(?:(?i:chapter|lesson|unit|section|topic|module|part)\s+[\divxlcIVXLC]+\b.*|\d+(?:\.\d+)+\s+\p{L}.*|\p{Lu}[\p{Lu}\d ,:'&-]{6,80})\s*$"
HEADING_STRICT = r"^\s*(?:(?:chapter|lesson|unit|section|topic|UNIT|CHAPTER)\s+[\divxlcIVXLC]+\b.*|\d+(?:\.\d+)+\s+\p{L}.*|\p{Lu}[\p{Lu}\d ,:'&-]{6,80})\s*$"


def detect_heading(text: Column, strict_case: bool = False) -> Column:
    """The first line that opens a section, cut at 120 characters; null if there is none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x))
    found = F.filter(lines, lambda x: x.rlike(HEADING_STRICT if strict_case else HEADING))
    return F.substring(F.get(found, 0), 1, 120)


def _notes(text: str) -> list[tuple[int, str]]:
    """A document's chunks: break at a heading once there is body, split long blocks at blank lines, join short ones to the one before."""
    heading = re.compile(HEADING.replace(r"\p{Lu}", "A-ZÀ-Þ").replace("A-ZÀ-Þ[A-ZÀ-Þ", "[A-ZÀ-Þ][A-ZÀ-Þ").replace(r"\p{L}", r"[^\W\d_]"))
    blocks, own = [], []
    for line in text.split("\n"):
        if heading.match(line) and len(re.sub(r"\s", "", "".join(own))) >= LEAST_BODY:
            blocks.append("\n".join(own))
            own = []
        own.append(line)
    blocks.append("\n".join(own))
    parts: list[str] = []
    for b in blocks:
        held = ""
        for p in re.split(r"\n\s*\n", b) if len(b) > MOST_BLOCK else [b]:
            if held and len(held) + len(p) > MOST_BLOCK:
                parts.append(held)
                held = ""
            held = f"{held}\n\n{p}" if held else p
        parts.append(held)
    out: list[str] = []
    for p in (x.strip() for x in parts):
        if p and out and len(p) < LEAST_CHUNK:
            out[-1] += "\n" + p
        elif p:
            out.append(p)
    return list(enumerate(out))


def chunk_notes(docs: DataFrame) -> DataFrame:
    """document_id, chunk_index, text. A document is one row and its chunks come from it alone; no shuffle."""

    @F.pandas_udf("array<struct<chunk_index int, text string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"chunk_index": i, "text": c} for i, c in _notes(t)] if isinstance(t, str) else [])

    return docs.select("document_id", F.explode(run("text")).alias("c")).select("document_id", "c.*")


def plain_text_to_elements(docs: DataFrame, most: int = CHUNK_MAX) -> DataFrame:
    """document_id, ord, page_number, type, text: lines joined to paragraphs; page marks, headings and bullets break.

    Blank lines do not break a paragraph, but it ends once it holds twice ``most`` tokens.
    """
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    page = F.regexp_extract("line", r"(?i)^\W*page\s+(\d+)(?:\s+of\s+\d+)?\W*$", 1).try_cast("int")
    bullet = F.col("line").rlike(r"^[-*•]\s+")
    kind = F.when(page.isNotNull(), "page").when(F.col("line").rlike(HEADING), "heading").when(bullet, "list_item").when(F.col("line") == "", "blank").otherwise("text")
    w = Window.partitionBy("document_id").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("kind", kind).withColumn("page_number", F.coalesce(F.last(page, ignorenulls=True).over(upto), F.lit(1)))
    rows = rows.where("kind NOT IN ('page', 'blank')").withColumn("n", token_count(F.col("line")))
    starts = F.when((F.col("kind") != "text") | (F.lag("kind").over(w) != "text") | (F.lag("page_number").over(w) != F.col("page_number")), 1).otherwise(0)
    rows = rows.withColumn("para", F.sum(starts).over(upto))
    part = Window.partitionBy("document_id", "para").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("piece", F.floor(F.coalesce(F.sum("n").over(part), F.lit(0)) / (2 * most)))
    g = rows.groupBy("document_id", "para", "piece").agg(F.min("i").alias("i"), F.min("page_number").alias("page_number"), F.min("kind").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ").alias("text"))
    named = F.when(F.col("kind") == "text", "paragraph").otherwise(F.col("kind"))
    return g.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("i")).alias("ord"), "page_number", named.alias("type"), F.when(F.col("kind") == "list_item", F.regexp_replace("text", r"^[-*•]\s+", "")).otherwise(F.col("text")).alias("text"))


HEADING_LEVELS = 9


def heading_path(elements: DataFrame, levels: int = HEADING_LEVELS) -> DataFrame:
    """Elements with path: the open headings above each, outermost first; a heading carries its parents' path.

    A heading closes those of its own level and deeper. So the open one of a level is the last before the element,
    unless a shallower one came after it: one running maximum for each level, over one window. Null levels are 1;
    levels beyond ``levels`` (office formats end at 9) count as ``levels``, those below 1 as 1. Headings at one place
    (equal ord) are read by level, at one level the greatest text stays, and none is above another. Rows of a null
    document_id are one document.
    """
    before = Window.partitionBy("document_id").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1)
    heading = F.col("type").eqNullSafe(F.lit("heading"))
    level = F.greatest(F.lit(1), F.least(F.lit(levels), F.coalesce("heading_level", F.lit(1))))
    rows = elements.select("document_id", "ord", "text", F.when(heading, level).alias("level"), F.struct("*").alias("element"))
    last = F.array(*[F.max(F.when(F.col("level") == k, F.struct("ord", "text"))).over(before) for k in range(1, levels + 1)])
    rows = rows.select("element", "level", last.alias("last"))
    shallower = lambda k: F.array_max(F.transform(F.slice("last", 1, k), lambda y: y["ord"]))
    open_ = F.filter("last", lambda x, k: x.isNotNull() & (F.col("level").isNull() | (k + 1 < F.col("level"))) & F.coalesce(x["ord"] >= shallower(k), F.lit(True)))
    rows = rows.select("element", F.transform(open_, lambda x: x["text"]).alias("path"))
    return rows.select(*[F.col(f"element.`{c}`") for c in elements.columns if c != "path"], "path")


def build_sections(elements: DataFrame) -> DataFrame:
    """document_id, section_id, title, elements: a heading opens a section; sections of a heading alone vanish."""
    w = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    e = elements.withColumn("section_id", F.sum((F.col("type") == "heading").cast("int")).over(w))
    g = e.groupBy("document_id", "section_id").agg(F.max(F.when(F.col("type") == "heading", F.col("text"))).alias("title"), F.count_if(F.col("type") != "heading").alias("elements"))
    return g.where("elements > 0")


def section_blocks(elements: DataFrame) -> DataFrame:
    """document_id, section_id, block, type, page_number, text: neighbouring list items form one block; headings are left out."""
    return _titled_blocks(elements).drop("title")


def _titled_blocks(elements: DataFrame) -> DataFrame:
    """Blocks of sections with the section's title. A document moves once, by its id; all further groups lie inside it."""
    w = Window.partitionBy("document_id").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = elements.withColumn("section_id", F.sum((F.col("type") == "heading").cast("int")).over(upto))
    new = F.when((F.col("type") == "list_item") & F.coalesce(F.lag("type").over(w) == "list_item", F.lit(False)), 0).otherwise(1)
    e = e.withColumn("block", F.sum(new).over(upto))
    e = e.withColumn("title", F.max(F.when(F.col("type") == "heading", F.col("text"))).over(Window.partitionBy("document_id", "section_id"))).where("type <> 'heading'")
    line = F.when(F.col("type") == "list_item", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n")
    return e.groupBy("document_id", "section_id", "block").agg(F.min("type").alias("type"), F.min("page_number").alias("page_number"), text.alias("text"), F.min("title").alias("title"))


def parent_runs(blocks: DataFrame, most: int = CHUNK_MAX) -> DataFrame:
    """Blocks with run: greedy runs of at most ``most`` tokens within a section; a longer block is a run of its own.

    A section's blocks stay with their numbers while these are folded, so that they are not joined to them again.
    """
    b = blocks.withColumn("n", token_count(F.col("text")))
    rest = [c for c in b.columns if c not in ("document_id", "section_id", "block")]
    g = b.groupBy("document_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("block", *rest))).alias("bs"))

    def step(a: Column, n: Column) -> Column:
        new = (a["held"] > 0) & (a["held"] + n > most)
        run = F.when(new, a["run"] + 1).otherwise(a["run"])
        return F.struct(F.when(new, n).otherwise(a["held"] + n).alias("held"), run.alias("run"), F.concat(a["out"], F.array(run)).alias("out"))

    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("run"), F.array().cast("array<int>").alias("out"))
    runs = g.withColumn("runs", F.aggregate(F.transform("bs", lambda x: x["n"]), start, step)["out"])
    rows = runs.select("document_id", "section_id", F.explode(F.arrays_zip("bs", "runs")).alias("r"))
    return rows.select("document_id", "section_id", "r.bs.block", *[F.col(f"r.bs.`{c}`") for c in rest], F.col("r.runs").alias("run"))


def _parts(blocks: list[str], most: int, overlap: int, least: int) -> list[str]:
    """Greedy parts of a run; a long block is cut between sentences, each piece opening with whole sentences of the last."""
    n = lambda s: len(s.split())
    pieces: list[str] = []
    for b in blocks:
        if n(b) <= most:
            pieces.append(b)
            continue
        held: list[str] = []
        for s in re.findall(r"[^.!?]+(?:[.!?]+[\"')\]]*|$)", " ".join(b.split())):
            s = s.strip()
            if held and n(" ".join(held)) + n(s) > most:
                pieces.append(" ".join(held))
                back: list[str] = []
                while held and n(" ".join([held[-1], *back])) <= overlap:
                    back.insert(0, held.pop())
                held = back
            held.append(s)
        if held:
            pieces.append(" ".join(held))
    out: list[str] = []
    for p in pieces:
        if out and (n(out[-1]) + n(p) <= most or n(p) < min(least, 20)):
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def _cut_runs(runs: DataFrame, most: int, overlap: int, least: int) -> DataFrame:
    """A row per run with its blocks' texts, parts, page_number and any title. Python gets few runs at a time, whatever their number."""

    @F.udf("array<string>", useArrow=False)
    def cut(blocks):
        return _parts(blocks, most, overlap, least)

    own = [F.min("title").alias("title")] if "title" in runs.columns else []
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    g = runs.groupBy("document_id", "section_id", "run").agg(blocks.alias("blocks"), F.min("page_number").alias("page_number"), *own)
    return g.withColumn("parts", cut("blocks"))


def child_parts(runs: DataFrame, most: int = CHUNK_MAX, overlap: int = CHUNK_OVERLAP, least: int = CHUNK_MIN) -> DataFrame:
    """document_id, section_id, run, part, text: the children of each parent run."""
    return _cut_runs(runs, most, overlap, least).select("document_id", "section_id", "run", "page_number", F.posexplode("parts").alias("part", "text"))


def emit_parent_child(elements: DataFrame, most: int = 2 * CHUNK_MAX) -> DataFrame:
    """document_id, section_id, chunk_id, parent_chunk_id, chunk_type, chunk_index, page_number, text.

    A parent is its heading and blocks; children get the heading in front where there are several. Ids come from the
    text; parents are numbered before children, from 0 in each section. A run's parent and children come from its one row.
    """
    runs = _cut_runs(parent_runs(_titled_blocks(elements), most), CHUNK_MAX, CHUNK_OVERLAP, CHUNK_MIN)
    runs = runs.withColumn("parent", F.concat_ws("\n", "title", F.array_join("blocks", "\n\n"))).drop("blocks")
    runs = runs.withColumn("parent_id", stable_id("p-", 16, F.col("document_id").cast("string"), F.col("parent")))

    def titled(text: Column) -> Column:
        prefix = (F.size("parts") > 1) & F.col("title").isNotNull() & ~F.startswith(text, F.col("title"))
        return F.when(prefix, F.concat_ws("\n", "title", text)).otherwise(text)

    own = F.struct(F.lit(-1).alias("part"), F.lit("parent").alias("chunk_type"), F.col("parent").alias("text"))
    kids = F.transform("parts", lambda t, k: F.struct(k.alias("part"), F.lit("child").alias("chunk_type"), titled(t).alias("text")))
    rows = runs.select("document_id", "section_id", "run", "page_number", "parent_id", F.explode(F.concat(F.array(own), kids)).alias("c"))
    rows = rows.select("document_id", "section_id", "run", "page_number", "parent_id", "c.*")
    child = F.col("chunk_type") == "child"
    chunk_id = F.when(child, stable_id("c-", 16, F.col("parent_id"), F.col("part").cast("string"), F.col("text"))).otherwise(F.col("parent_id"))
    rows = rows.select("document_id", "section_id", "run", "part", chunk_id.alias("chunk_id"), F.when(child, F.col("parent_id")).alias("parent_chunk_id"), "chunk_type", "page_number", "text")
    return number_chunks(rows).drop("run", "part")


def number_chunks(rows: DataFrame) -> DataFrame:
    """Rows with chunk_index: parents first, then children, from 0 in each section."""
    w = Window.partitionBy("document_id", "section_id").orderBy(F.desc("chunk_type"), "run", "part")
    return rows.withColumn("chunk_index", F.row_number().over(w) - 1)


def sentence_rows(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", F.posexplode(sentences(F.col("text"))).alias("ord", "sentence"))
