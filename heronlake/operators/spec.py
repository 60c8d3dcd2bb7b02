"""Paper structure: slots, items, marks, sections, reconciliation and unit assignment."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.text import NUMBER_WORDS, first_match, normalize_unit_label
from heronlake.sources.staging import dealt

# --- fixed values -----------------------------------------------------------------------------------------------------
TYPES = (
    "MCQ",
    "TRUE_FALSE",
    "FILL_IN_THE_BLANK",
    "SHORT_ANSWER",
    "LONG_ANSWER",
    "IMAGE_BASED",
    "MIXED",
    "VERY_SHORT_ANSWER",
    "ESSAY",
    "EXPLAIN",
    "DIFFERENTIATE",
    "COMPARE",
    "MATCH_THE_FOLLOWING",
    "DEFINITION",
    "MAP",
    "DIAGRAM",
    "DRAWING",
    "PASSAGE",
    "COMPREHENSION",
    "CASE_BASED",
    "GRAMMAR",
    "CREATIVE_WRITING",
    "LETTER",
    "NOTICE",
    "NUMERICAL",
    "PROBLEM_SOLVING",
    "PROOF",
    "APPLICATION",
    "INTERNAL_CHOICE",
    "UNKNOWN",
)
#: Labels that mean a type, by prefix; types and labels in order.
ALIASES = {
    "IMAGE_BASED": ("IMAGE_BASED", "PICTURE_BASED", "IMAGE", "PICTURE", "VISUAL", "DIAGRAM_BASED", "FIGURE_BASED", "IMAGE_QUESTION",),
    "MIXED": ("MIXED", "MIXED_TYPE", "HETEROGENEOUS", "COMBINED", "COMPOSITE",),
    "MCQ": ("MCQ", "MULTIPLE_CHOICE", "MULTIPLE_CHOICE_QUESTION", "CHOOSE_THE_CORRECT_OPTION", "CHOOSE_THE_CORRECT",),
    "TRUE_FALSE": ("TRUE_FALSE", "TRUE_OR_FALSE", "TRUE/FALSE", "TRUE_FALSE_TYPE",),
    "FILL_IN_THE_BLANK": ("FILL_IN_THE_BLANK", "FILL_IN_THE_BLANKS", "FILL_IN_THE_BLANKS_TYPE",),
    "MATCH_THE_FOLLOWING": ("MATCH_THE_FOLLOWING", "MATCH",),
    "SHORT_ANSWER": ("SHORT_ANSWER", "SHORT", "SA",),
    "VERY_SHORT_ANSWER": ("VERY_SHORT_ANSWER", "VSA", "VERY_SHORT",),
    "LONG_ANSWER": ("LONG_ANSWER", "LONG", "LA",),
    "ESSAY": ("ESSAY", "ESSAY_TYPE",),
    "EXPLAIN": ("EXPLAIN",),
    "DIFFERENTIATE": ("DIFFERENTIATE", "DIFFERENTIATION",),
    "COMPARE": ("COMPARE", "COMPARISON",),
    "DEFINITION": ("DEFINITION", "DEFINE",),
    "MAP": ("MAP", "MAP_WORK", "MAP_POINTING",),
    "DIAGRAM": ("DIAGRAM", "LABELLED_DIAGRAM", "DRAW_A_DIAGRAM",),
    "DRAWING": ("DRAWING", "DRAW", "DRAW_AND_LABEL",),
    "PASSAGE": ("PASSAGE", "READING_COMPREHENSION",),
    "COMPREHENSION": ("COMPREHENSION",),
    "CASE_BASED": ("CASE_BASED", "CASE_STUDY",),
    "GRAMMAR": ("GRAMMAR",),
    "CREATIVE_WRITING": ("CREATIVE_WRITING", "WRITING", "STORY_WRITING", "PARAGRAPH_WRITING",),
    "LETTER": ("LETTER", "LETTER_WRITING", "FORMAL_LETTER", "INFORMAL_LETTER",),
    "NOTICE": ("NOTICE", "NOTICE_WRITING",),
    "NUMERICAL": ("NUMERICAL", "NUMERICALS",),
    "PROBLEM_SOLVING": ("PROBLEM_SOLVING", "PROBLEM",),
    "PROOF": ("PROOF", "PROVE",),
    "APPLICATION": ("APPLICATION",),
    "INTERNAL_CHOICE": ("INTERNAL_CHOICE", "CHOICE", "CHOOSE_ANY", "OR_TYPE",),
    "UNKNOWN": ("UNKNOWN", "CUSTOM",),
}
# --- fixed values: wordings of a type, the first that matches; they must stay as they are for equal results ------------
SLOT_PATTERNS = [
    (r"(?i)(?:look at|study|observe|identify the (?:object|picture|diagram)|refer to)\s+(?:the\s+)?(?:picture|image|diagram|figure|illustration|given picture|(?:following|above|below)\s+(?:image|picture|diagram|figure|map)|following(?:\s+\w+){0,2}?\s*(?:image|picture|diagram|figure))", "IMAGE_BASED"),
    (r"(?i)\bmap\b|mark the following|locate(?: and label)? on|point out on", "MAP"),
    (r"(?i)draw a (?:labelled|labeled|neat)?\s*diagram|label the (?:given )?(?:diagram|figure)|diagram of", "DIAGRAM"),
    (r"(?i)^draw\b|draw and label|draw the\b", "DRAWING"),
    (r"(?i)match the (?:following|columns?)|match the items|match column", "MATCH_THE_FOLLOWING"),
    (r"(?i)true or false|true\/false|state whether|write t\s*\/\s*f", "TRUE_FALSE"),
    (r"(?i)choose the correct|tick the correct|select the correct|multiple choice|\bmcq\b", "MCQ"),
    (r"(?i)write (?:a|an|the|your)?\s*(?:short )?(?:story|essay|paragraph|composition)|compose|create a story|story using the given|story writing|creative writing", "CREATIVE_WRITING"),
    (r"(?i)fill in the blanks?|fill in the missing|___+|complete the (?:following )?(?:sentences?|words?|passage)", "FILL_IN_THE_BLANK"),
    (r"(?i)\b(?:grammar|conjunction|preposition|tense|noun|pronoun|adjective|adverb|verb|article|punctuat|sentence)\b", "GRAMMAR"),
    (r"(?i)^define\b|define the following|give the (?:meaning|definition)", "DEFINITION"),
    (r"(?i)write a (?:formal|informal|letter|letter to)|letter to the (?:editor|principal)", "LETTER"),
    (r"(?i)write a notice|notice writing|draft a notice", "NOTICE"),
    (r"(?i)read the (?:given )?(?:passage|following)|reference to the context|comprehension", "PASSAGE"),
    (r"(?i)case(?: |-)?(?:study|based)", "CASE_BASED"),
    (r"(?i)^prove\b|prove that", "PROOF"),
    (r"(?i)^solve\b|solve the (?:following|given)|calculate|find the (?:value|area|perimeter|volume)|evaluate", "NUMERICAL"),
    (r"(?i)word problem|problem based|story sum", "PROBLEM_SOLVING"),
    (r"(?i)^explain\b|explain (?:the|why|how)", "EXPLAIN"),
    (r"(?i)differentiate between|distinguish between|difference between", "DIFFERENTIATE"),
    (r"(?i)compare(?: and contrast)?\b", "COMPARE"),
    (r"(?i)essay on|write an essay|in about \d+ words", "ESSAY"),
    (r"(?i)application for|write an application", "APPLICATION"),
    (r"(?i)very short answer|answer in (?:one|a few) (?:word|sentence)|one-word answer", "VERY_SHORT_ANSWER"),
]


def classify_slot_type(stem: Column, per_item: Column, total: Column) -> Column:
    """By wording, else short or long by marks per item, or by total marks where those are unknown."""
    s = F.trim(F.coalesce(stem, F.lit("")))
    by_marks = F.when(F.coalesce(per_item >= 4, total >= 5, F.lit(False)), "LONG_ANSWER").otherwise("SHORT_ANSWER")
    asks = s.rlike(r"(?i)^(?:what|which|why|how|who|when|where|name|give|list|state|write|mention)\b|answer the following|describe|narrate")
    return F.when(s == "", "UNKNOWN").otherwise(F.coalesce(first_match(s, SLOT_PATTERNS, None), F.when(asks, by_marks), F.lit("UNKNOWN")))


#: What an answer to a type looks like.
ANSWER_FORMS = {"MCQ": "OPTION", "TRUE_FALSE": "BOOLEAN", "FILL_IN_THE_BLANK": "WORD", "MATCH_THE_FOLLOWING": "PAIRS", "NUMERICAL": "NUMBER", "DRAWING": "DRAWING", "DIAGRAM": "DRAWING", "MAP": "DRAWING", "ESSAY": "TEXT", "LETTER": "TEXT"}


def answer_form(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ANSWER_FORMS.items() for x in kv]), kind), F.lit("SENTENCES"))


def normalize_type(label: Column) -> Column:
    """A type from a messy label: exact, then by alias prefix, then by word."""
    v = F.regexp_replace(F.regexp_replace(F.upper(F.trim(F.coalesce(label, F.lit("")))), r"[\s-]+", "_"), r"[^A-Z0-9_/]", "")
    out = F.when(v == "", "UNKNOWN").when(v.isin(*TYPES), v)
    for kind, names in ALIASES.items():
        out = out.when(reduce(or_, [v.startswith(n) for n in names]), kind)
    has = v.contains
    return out.when(has("TRUE") & has("FALSE"), "TRUE_FALSE").when(has("FILL") & has("BLANK"), "FILL_IN_THE_BLANK").when(has("MATCH"), "MATCH_THE_FOLLOWING").when(has("CHOOSE") | has("MCQ"), "MCQ").otherwise("UNKNOWN")


def parse_marks_expression(text: Column) -> Column:
    """struct(per, count, total): ``2x5=10``, ``4+1``, or a bare number up to 25 at the end; null if there is none."""
    num = lambda p, g: F.regexp_extract(text, p, g).try_cast("double")
    product, plus, bare = r"(\d+(?:\.\d+)?)\s*[xX×*]\s*(\d+)\s*=\s*(\d+)", r"(\d+)\s*\+\s*(\d+)", r"(?i)(?:^|\s)(\d{1,2})(?:\s*marks?)?\s*$"
    made = lambda a, b, c: F.struct(a.alias("per"), b.alias("count"), c.alias("total"))
    one = F.lit(1.0)
    whole = (num(product, 1) > 0) & (num(product, 2) > 0) & (num(product, 3) > 0)
    both = num(plus, 1) + num(plus, 2)
    return F.when(whole, made(num(product, 1), num(product, 2), num(product, 3))).when(both > 0, made(both, one, both)).when((num(bare, 1) > 0) & (num(bare, 1) <= 25), made(num(bare, 1), one, num(bare, 1)))


def parse_optional_rule(text: Column) -> Column:
    """How many items a rule such as ``any two`` or ``attempt any 5`` asks for, 1 to 25, else null."""
    w = F.lower(F.regexp_extract(text, r"(?i)\b(?:attempt\s+)?any\s+(\d{1,2}|one|two|three|four|five|six|seven|eight|nine|ten)\b", 1))
    n = F.coalesce(w.try_cast("int"), F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), w))
    return F.when(n.between(1, 25), n)


def group_slots(questions: DataFrame) -> DataFrame:
    """paper_id, parent, position, richness, items: the richest row of each main number, with its sub-items; a missing main is made.

    (paper_id, ord, question_number, text, section, has_marks, n_parts): ``Q5(a)`` is an item of ``Q5``. A row is richer for
    marks (2), parts of its own (1), a section (1) and text (up to a half); of equal ones the first stays. ``position`` is
    the main's place in its paper by number, mains without one last.
    """
    q = questions.withColumn("parent", F.regexp_extract("question_number", r"^(Q?\d+)", 1)).withColumn("label", F.regexp_extract("question_number", r"\(([a-z0-9]+)\)$", 1))
    items = q.where("label <> ''").groupBy("paper_id", "parent").agg(F.array_sort(F.collect_list(F.struct("label", "ord", "text"))).alias("items"))
    rich = F.when(F.col("has_marks"), 2.0).otherwise(0.0) + F.when(F.col("n_parts") > 0, 1.0).otherwise(0.0) + F.when(F.col("section").isNotNull(), 1.0).otherwise(0.0) + F.least(F.length("text") / 60, F.lit(0.5))
    mains = q.where("label = ''").withColumn("richness", F.round(rich, 6))
    best = mains.groupBy("paper_id", "parent").agg(F.max(F.struct("richness", (-F.col("ord")).alias("o"), "text", "section")).alias("m"))
    j = best.join(items, ["paper_id", "parent"], "full_outer")
    j = j.withColumn("numeric", F.regexp_extract("parent", r"(\d+)", 1).try_cast("long"))
    order = Window.partitionBy("paper_id").orderBy(F.asc_nulls_last("numeric"), "parent")
    return j.select("paper_id", "parent", F.row_number().over(order).alias("position"), F.col("m.text").alias("text"), F.col("m.section").alias("section"), F.col("m.richness").alias("richness"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.col("m").isNull().alias("made"))


def slot_marks(slots: DataFrame, items: DataFrame) -> DataFrame:
    """slot_id, total, per_item, n_items: total from the expression, else the items' sum, else the slot; per item only if even."""
    g = items.groupBy("slot_id").agg(F.sum("marks").alias("s"), F.count("*").alias("n"), F.min("marks").alias("lo"), F.max("marks").alias("hi"), F.count_if(F.col("marks").isNull()).alias("unknown"))
    j = slots.join(g, "slot_id", "left")
    total = F.coalesce(F.col("expression_total"), F.when(F.col("unknown") == 0, F.col("s")), F.col("total_marks"))
    per = F.when(F.col("lo") == F.col("hi"), F.col("lo")).when(F.col("n").isNotNull() & (total % F.col("n") == 0), total / F.col("n"))
    return j.select("slot_id", F.round(total, 1).alias("total"), F.round(per, 4).alias("per_item"), F.coalesce("n", F.lit(0)).alias("n_items"))


def derive_mixed_type(items: DataFrame) -> DataFrame:
    """slot_id, type: the items' one known type, MIXED if several, null if none."""
    known = F.collect_set(F.when(F.col("type") != "UNKNOWN", F.col("type")))
    return items.groupBy("slot_id").agg(known.alias("t")).select("slot_id", F.when(F.size("t") == 1, F.get("t", 0)).when(F.size("t") > 1, "MIXED").alias("type"))


def build_sections(slots: DataFrame) -> DataFrame:
    """paper_id, section, ord, first_slot, n, slots: sections in first-seen order."""
    g = slots.groupBy("paper_id", "section").agg(F.min("slot_index").alias("first_slot"), F.count("*").alias("n"), F.sum("total_marks").alias("marks"))
    return g.withColumn("ord", F.row_number().over(Window.partitionBy("paper_id").orderBy("first_slot")))


def normalize_slots(slots: DataFrame) -> DataFrame:
    """Slots with capped, labelled items and rounded marks; unknown rows without stem and marks go.

    ``items`` is an array of (text, marks): 26 at most, 220 characters of text, labels a, b, c by place.
    """
    items = F.transform(F.slice("items", 1, 26), lambda x, i: F.struct(F.char(i + 97).alias("label"), F.substring(x["text"], 1, 220).alias("text"), F.round(x["marks"], 1).alias("marks")))
    keep = ~((F.col("type") == "UNKNOWN") & (F.trim(F.coalesce("stem", F.lit(""))) == "") & F.col("total_marks").isNull())
    return slots.where(keep).withColumn("items", items).withColumn("total_marks", F.round("total_marks", 1))


def paper_totals(slots: DataFrame) -> DataFrame:
    """paper_id, total: known only if every slot's marks are."""
    return slots.groupBy("paper_id").agg(F.when(F.count("total_marks") == F.count("*"), F.round(F.sum("total_marks"), 1)).alias("total"))


def reconcile(papers: DataFrame, slots: DataFrame, items: DataFrame) -> DataFrame:
    """paper_id, code, severity, slot_id, expected, found: what does not add up in extracted papers.

    One select per code over totals that are taken once per slot.
    """
    g = items.groupBy("slot_id").agg(F.count("*").alias("n"), F.round(F.sum("marks"), 1).alias("s"), F.count("marks").alias("known"), F.countDistinct("option_count").alias("opts"))
    s = slots.join(g, "slot_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "known": F.coalesce("known", F.lit(0))})
    row = lambda code, sev, exp, got: (F.lit(code).alias("code"), F.lit(sev).alias("severity"), exp.cast("double").alias("expected"), got.cast("double").alias("found"))
    of = lambda cond, *r: s.where(cond).select("paper_id", "slot_id", *row(*r))
    none = F.lit(None)
    out = [
        of((F.col("declared_items") > 0) & (F.col("n") < F.col("declared_items")), "DECLARED_ITEMS_MISMATCH", "warning", F.col("declared_items"), F.col("n")),
        of((F.col("declared_items") > 0) & (F.col("n") > F.col("declared_items")), "RECOVERED_ITEMS_EXCEED_DECLARED", "warning", F.col("declared_items"), F.col("n")),
        of((F.col("known") == F.col("n")) & (F.col("n") > 0) & (F.col("s") != F.col("total_marks")), "ITEM_MARKS_SUM_MISMATCH", "error", F.col("total_marks"), F.col("s")),
        of((F.col("known") > 0) & (F.col("known") < F.col("n")), "PER_ITEM_MARKS_PARTIAL", "warning", F.col("n"), F.col("known")),
        of(F.col("total_marks").isNull() & (F.col("known") == 0), "MARKS_UNKNOWN", "warning", none, none),
        of(F.col("opts") > 1, "OPTION_COUNT_INCONSISTENT", "warning", F.lit(1), F.col("opts")),
    ]
    w = Window.partitionBy("paper_id", "slot_id").orderBy("number")
    steps = items.select("paper_id", "slot_id", "number").distinct().withColumn("before", F.lag("number").over(w)).where(F.col("number") - F.col("before") > 1)
    out.append(steps.select("paper_id", "slot_id", *row("NUMBERING_GAP", "warning", F.col("before") + 1, F.col("number"))))
    twice = items.groupBy("paper_id", "slot_id", "number").agg(F.count("*").alias("n")).where("n > 1")
    out.append(twice.select("paper_id", "slot_id", *row("DUPLICATE_QUESTION_NUMBER", "error", F.lit(1), F.col("n"))))
    per = slots.groupBy("paper_id").agg(F.round(F.sum("total_marks"), 1).alias("s"), F.count("*").alias("n"))
    p = papers.join(per, "paper_id", "left").withColumn("slot_id", F.lit(None).cast("long"))
    out.append(p.where("n > 0 AND declared_total <> s").select("paper_id", "slot_id", *row("PAPER_MARKS_TOTAL_MISMATCH", "error", F.col("declared_total"), F.col("s"))))
    out.append(p.where("n IS NULL").select("paper_id", "slot_id", *row("NO_QUESTIONS_EXTRACTED", "error", none, F.lit(0))))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows


def pad_missing_items(slots: DataFrame, items: DataFrame, rows: int = 0) -> DataFrame:
    """paper_id, slot_id, item_index, reference_text, recovered: declared items that were not found become empty ones.

    Joins by item are dealt for ``rows`` items, here and below; 0 leaves that to the session.
    """
    have = items.select("slot_id", "item_index", "reference_text", F.lit(True).alias("recovered"))
    want = slots.where("declared_items > 0").select("slot_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("declared_items").cast("long"))).alias("item_index"))
    want, have = (dealt(x, rows, "slot_id", "item_index") for x in (want, have))
    return want.join(have, ["slot_id", "item_index"], "full_outer").select("slot_id", "item_index", "reference_text", F.coalesce("recovered", F.lit(False)).alias("recovered"))


def confidence(papers: DataFrame, slots: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """paper_id, confidence: low without slots or with an error, medium with a warning or unknown marks, else high."""
    d = diagnostics.groupBy("paper_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    s = slots.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(F.col("total_marks").isNull()).alias("unknown"))
    j = papers.select("paper_id").join(s, "paper_id", "left").join(d, "paper_id", "left").fillna(0)
    level = F.when((F.col("n") == 0) | (F.col("errors") > 0), "low").when((F.col("warnings") > 0) | (F.col("unknown") > 0), "medium").otherwise("high")
    return j.select("paper_id", level.alias("confidence"), "errors", "warnings")


def paper_summary(slots: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """paper_id, sections, slots, errors, warnings."""
    s = slots.groupBy("paper_id").agg(F.countDistinct("section").alias("sections"), F.count("*").alias("slots"))
    d = diagnostics.groupBy("paper_id").pivot("severity", ["error", "warning"]).agg(F.count(F.lit(1)))
    return s.join(d, "paper_id", "left").select("paper_id", "sections", "slots", F.coalesce("error", F.lit(0)).alias("errors"), F.coalesce("warning", F.lit(0)).alias("warnings"))


def validate_spec(slots: DataFrame, items: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id, slot_id, issue of slots that break the structure's rules.

    Slots are counted, and meet their sections in as many tasks as they need.
    """
    n = slots.count()
    placed, named = (dealt(x, n, "paper_id", "section") for x in (slots, sections))
    g = items.groupBy("slot_id").agg(F.count("*").alias("n"), F.round(F.sum("marks"), 1).alias("s"))
    s = slots.join(g, "slot_id", "left")
    pick = lambda df, issue: df.select("paper_id", "slot_id", F.lit(issue).alias("issue"))
    rows = [
        pick(s.where("n IS NULL"), "empty"),
        pick(s.where("declared_items > 0 AND coalesce(n, 0) <> declared_items"), "item_count"),
        pick(s.where("n > 0 AND s <> total_marks"), "item_sum"),
        pick(placed.join(named, ["paper_id", "section"], "left_anti"), "unknown_section"),
        named.join(placed, ["paper_id", "section"], "left_anti").select("paper_id", F.lit(None).cast("long").alias("slot_id"), F.lit("orphan_section").alias("issue")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def validate_assignments(slots: DataFrame, items: DataFrame, assignments: DataFrame, known_units: DataFrame, rows: int = 0) -> DataFrame:
    """slot_id, issue: unknown or missing slots, both or neither of unit and items, locked slots, unknown items, units without notes."""
    a = assignments.groupBy("slot_id").agg(F.count_if(F.col("item_index").isNull()).alias("whole"), F.count("item_index").alias("split"), F.count_if(F.trim("unit") == "").alias("blank"))
    j = slots.select("slot_id", "locked").join(a, "slot_id", "full_outer")
    pick = lambda df, issue: df.select("slot_id", F.lit(issue).alias("issue"))
    have = F.col("whole").isNotNull()
    split = assignments.where("item_index IS NOT NULL")
    split, items = (dealt(x.select("slot_id", "item_index"), rows, "slot_id", "item_index") for x in (split, items))
    picked = [
        pick(j.where(F.col("locked").isNull()), "unknown_slot"),
        pick(j.where(~have), "missing_slot"),
        pick(j.where(have & ((F.col("whole") > 0) == (F.col("split") > 0))), "unit_or_items"),
        pick(j.where(F.col("locked") & (F.col("split") > 0)), "locked_split"),
        pick(j.where(F.col("blank") > 0), "blank_unit"),
        pick(split.join(items, ["slot_id", "item_index"], "left_anti").join(slots, "slot_id", "left_semi"), "unknown_item"),
        pick(assignments.where("trim(unit) <> ''").join(known_units, "unit", "left_anti").select("slot_id").distinct(), "unit_without_notes"),
    ]
    out = picked[0]
    for r in picked[1:]:
        out = out.unionByName(r)
    return out


def default_assign(slots: DataFrame, units: DataFrame) -> DataFrame:
    """paper_id, slot_id, unit: a slot's own unit if the pool has it, else the pool in turn, counting free slots only."""
    pool = units.select("unit", normalize_unit_label(F.col("unit")).alias("key")).groupBy("key").agg(F.min("unit").alias("unit"))
    n_pool = pool.agg(F.count("*").alias("n"))
    indexed = pool.withColumn("k", F.row_number().over(Window.orderBy("unit")) - 1)  # the pool is one paper's list of units
    s = slots.withColumn("key", normalize_unit_label(F.col("own_unit"))).join(F.broadcast(pool.select("key", F.col("unit").alias("mine"))), "key", "left")
    own = s.where("mine IS NOT NULL").select("paper_id", "slot_id", F.col("mine").alias("unit"))
    free = s.where("mine IS NULL").withColumn("i", F.row_number().over(Window.partitionBy("paper_id").orderBy("slot_index")) - 1)
    turn = free.crossJoin(F.broadcast(n_pool)).withColumn("k", (F.col("i") % F.col("n")).cast("int"))  # one row
    return own.unionByName(turn.join(F.broadcast(indexed), "k").select("paper_id", "slot_id", "unit"))


def slot_unit_map(assignments: DataFrame) -> DataFrame:
    """slot_id, unit, items: a unit for the slot, or a map by item only where units really differ."""
    g = assignments.groupBy("slot_id").agg(F.countDistinct("unit").alias("n"), F.min("unit").alias("u"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("item_index").cast("string"), F.lit("*")), "unit")))).alias("m"))
    return g.select("slot_id", F.when(F.col("n") == 1, F.col("u")).alias("unit"), F.when(F.col("n") > 1, F.col("m")).alias("items"))


def marks_per_unit(items: DataFrame, assignments: DataFrame, units: DataFrame, rows: int = 0) -> DataFrame:
    """unit, marks, unknown: sums of item marks by unit, zero rows kept, unassigned items under a null unit."""
    own = assignments.where("item_index IS NOT NULL").select("slot_id", "item_index", F.col("unit").alias("iu"))
    whole = assignments.where("item_index IS NULL").select("slot_id", F.col("unit").alias("su"))
    items, own = (dealt(x, rows, "slot_id", "item_index") for x in (items, own))
    j = items.join(own, ["slot_id", "item_index"], "left").join(dealt(whole, rows, "slot_id"), "slot_id", "left").withColumn("unit", F.coalesce("iu", "su"))
    g = j.groupBy("unit").agg(F.round(F.sum("marks"), 1).alias("marks"), F.count_if(F.col("marks").isNull()).alias("unknown"))
    zero = units.select("unit").distinct().join(g, "unit", "left_anti").select("unit", F.lit(0.0).alias("marks"), F.lit(0).cast("long").alias("unknown"))
    return g.unionByName(zero)


def total_drift(papers: DataFrame, slots: DataFrame, items: DataFrame) -> DataFrame:
    """paper_id, declared_total, total, drifted: items' sum where all are marked, else the slot's total."""
    g = items.groupBy("slot_id").agg(F.when(F.count("marks") == F.count("*"), F.sum("marks")).alias("s"))
    t = slots.join(g, "slot_id", "left").groupBy("paper_id").agg(F.round(F.sum(F.coalesce("s", "total_marks")), 1).alias("total"))
    return papers.join(t, "paper_id").select("paper_id", "declared_total", "total", (~F.col("declared_total").eqNullSafe(F.col("total"))).alias("drifted"))


def dominant_style(labels: DataFrame) -> DataFrame:
    """paper_id, style, sample, confidence: the most frequent numbering style and its share of the known ones."""
    l = F.col("label")
    style = F.when(l.rlike(r"^Q\.?\s*\d+"), "Q_NUMBER").when(l.rlike(r"^\d+\."), "NUMBER_DOT").when(l.rlike(r"^\d+\)"), "NUMBER_PAREN").when(l.rlike(r"^\(\d+\)"), "PARENTHESES").when(l.rlike(r"^[ivx]+[.)]"), "ROMAN")
    g = labels.withColumn("style", style).where("style IS NOT NULL").groupBy("paper_id", "style").agg(F.count("*").alias("n"), F.min("label").alias("sample"))
    w = Window.partitionBy("paper_id")
    ranked = g.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), F.asc("style"))))
    return ranked.where("k = 1").select("paper_id", "style", "sample", F.col("share").alias("confidence"))


def associate_assets(assets: DataFrame, markers: DataFrame, most: float = 0.55, close: float = 0.12) -> DataFrame:
    """asset_id, slot_id, distance, confidence: the nearest marker above an asset on its page, by share of the page's height.

    (document_id, page_number, mid_y, height): no marker within reach leaves it unassociated; a second one nearly as near
    makes it ambiguous.
    """
    m = markers.select("document_id", "page_number", "slot_id", F.col("mid_y").alias("marker_y"))
    d = (F.col("mid_y") - F.col("marker_y")) / F.col("height")
    met = assets.join(m, ["document_id", "page_number"]).where(F.col("marker_y") <= F.col("mid_y")).withColumn("distance", F.round(d, 6)).where(F.col("distance") <= most)
    w = Window.partitionBy("asset_id").orderBy("distance", "slot_id")
    best = met.withColumn("next", F.lead("distance").over(w)).withColumn("k", F.row_number().over(w)).where("k = 1")
    ambiguous = F.coalesce(F.col("next") - F.col("distance") < close, F.lit(False))
    level = F.when(ambiguous, "LOW").when(F.col("distance") <= 0.2, "HIGH").otherwise("MEDIUM")
    found = best.select("asset_id", "slot_id", "distance", level.alias("confidence"))
    return assets.select("asset_id").join(found, "asset_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit("UNASSOCIATED")))


def image_layout(assets: DataFrame) -> DataFrame:
    """asset_id, decorative, alignment, width_ratio of (x0, y0, x1, y1, page_width, page_height)."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    mid = (F.col("x0") + F.col("x1")) / 2 / F.col("page_width")
    small = (w * h) < 0.005 * F.col("page_width") * F.col("page_height")
    band = (F.col("y1") < 0.06 * F.col("page_height")) | (F.col("y0") > 0.94 * F.col("page_height"))
    align = F.when(mid < 0.38, "left").when(mid > 0.62, "right").otherwise("center")
    return assets.select("asset_id", (small | band).alias("decorative"), align.alias("alignment"), F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), w / F.col("page_width"))), 4).alias("width_ratio"))


def validate_assets(assets: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, issue: pages out of range, and element places used twice."""
    last = pages.groupBy("document_id").agg(F.max("page_number").alias("n"))
    out = assets.join(last, "document_id", "left").where((F.col("page_number") < 1) | (F.col("page_number") > F.coalesce("n", F.lit(0)))).select("document_id", F.lit("page_out_of_range").alias("issue")).distinct()
    twice = assets.groupBy("document_id").agg(F.count("ord").alias("a"), F.countDistinct("ord").alias("b")).where("a <> b").select("document_id", F.lit("order_not_unique").alias("issue"))
    return out.unionByName(twice)


def detect_unit_topic(slots: DataFrame) -> DataFrame:
    """slot_id, unit, topic, confidence, review from (explicit_unit, text, paper_text, locked, image)."""
    pattern = r"(?i)\b((?:unit|chapter)\s+\d+)\b"
    seen = lambda c: F.nullif(F.lower(F.regexp_extract(c, pattern, 1)), F.lit(""))
    text = F.coalesce("text", F.lit(""))
    from_paper = F.when(F.col("locked"), seen(F.substring(F.coalesce("paper_text", F.lit("")), 1, 600)))
    unit = F.coalesce("explicit_unit", seen(text), from_paper)
    topic = F.nullif(F.trim(F.substring(text, 1, 60)), F.lit(""))
    level = F.when(F.col("explicit_unit").isNotNull() | seen(text).isNotNull(), "HIGH").when(from_paper.isNotNull(), "MEDIUM").when(topic.isNotNull(), "MEDIUM").otherwise("LOW")
    return slots.select("slot_id", unit.alias("unit"), topic.alias("topic"), level.alias("confidence"), ((level == "LOW") & F.col("image")).alias("review"))


def paper_header(docs: DataFrame) -> DataFrame:
    """document_id, class, subject, duration, maximum_marks, session, school of a paper's first lines."""
    t = F.coalesce("text", F.lit(""))
    pick = lambda p: F.nullif(F.trim(F.regexp_extract(t, p, 1)), F.lit(""))
    lines = F.filter(F.slice(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), 1, 14), lambda x: x.rlike(r"(?i)\b(school|academy|college|vidyalaya|institute)\b") & (F.length(x) <= 80))
    return docs.select(
        "document_id",
        pick(r"(?i)\bclass\s*[:\-]?\s*([ivxlc]+|\d{1,2})\b").alias("class"),
        pick(r"(?i)\bsubject\s*[:\-]\s*([^\n]{2,40})").alias("subject"),
        pick(r"(?i)\b(?:time|duration)\s*(?:allowed)?\s*[:\-]\s*([^\n]{2,30})").alias("duration"),
        pick(r"(?i)\b(?:maximum|max\.?|total)\s*marks\s*[:\-]?\s*(\d{1,3})").try_cast("int").alias("maximum_marks"),
        pick(r"(\b20\d{2}\s*[-–/]\s*(?:20)?\d{2}\b)").alias("session"),
        F.get(lines, 0).alias("school"),
    )


def paper_instructions(docs: DataFrame, most: int = 8) -> DataFrame:
    """document_id, ord, line: the first lines after an instructions heading, up to a section, a question or a marks expression."""
    l = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    start = F.col("line").rlike(r"(?i)^(?:general\s+)?instructions?\s*:?$")
    stop = F.col("line").rlike(r"(?i)^(?:section|part)\s+[A-Z]\b|^Q\s*\.?\s*\d+|\d+\s*[xX×]\s*\d+\s*=\s*\d+")
    w = Window.partitionBy("document_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(start, F.col("i"))).over(w)
    rows = l.withColumn("first", first)
    rows = rows.withColumn("ended", F.max(F.when(stop & (F.col("i") > F.col("first")), 1).otherwise(0)).over(w))
    rows = rows.where("i > first AND ended = 0 AND line <> ''")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("document_id").orderBy("i"))).where(F.col("ord") <= most).select("document_id", "ord", "line")


def build_from_form(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slots with items, errors) of form rows (slot_id, type, item_count, option_count, difficulty, mode, values, total).

    Marks per item come from the values, or from the total where it divides evenly.
    """
    per = F.when(F.col("mode") == "perItem", F.transform(F.sequence(F.lit(1), F.greatest("item_count", F.lit(1))), lambda i: F.get("values", i - 1)))
    whole = F.transform(F.sequence(F.lit(1), F.greatest("item_count", F.lit(1))), lambda _: F.when(F.col("total") % F.col("item_count") == 0, F.col("total") / F.col("item_count")))
    marks = F.coalesce(per, whole)
    items = F.transform(marks, lambda m, i: F.struct(F.char(i + 97).alias("label"), m.alias("marks")))
    total = F.when(F.col("mode") == "perItem", F.aggregate(F.filter("values", lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)).otherwise(F.col("total"))
    slots = rows.where("item_count >= 1").select("slot_id", normalize_type(F.col("type")).alias("type"), items.alias("items"), total.alias("total_marks"), "difficulty")
    rules = [
        (F.col("item_count") < 1, "item_count"),
        (normalize_type(F.col("type")) == "UNKNOWN", "type"),
        ((F.col("mode") == "perItem") & (F.size("values") != F.col("item_count")), "marks_count"),
        ((F.col("mode") == "whole") & ~(F.col("total") > 0), "total"),
        ((normalize_type(F.col("type")) == "MCQ") & (F.coalesce("option_count", F.lit(0)) < 2), "options"),
        (~F.col("difficulty").isin("Easy", "Medium", "Difficult", "Hard"), "difficulty"),
    ]
    errors = rows.select("slot_id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in rules]))).alias("error"))
    return slots, errors
