"""Quality gates over candidate items: checks, grounding, scoring, selection and full accounting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.config import DEFAULT
from heronlake.functions.text import cognitive_demand, content_terms, degenerate, norm_text, summary_trigger
from heronlake.operators.retrieval import top

TYPES = ("MCQ", "TRUE_FALSE", "FILL_IN_THE_BLANK", "SHORT_ANSWER", "LONG_ANSWER")
#: Types whose texts may be short.
SHORT_TYPES = ("MCQ", "TRUE_FALSE", "FILL_IN_THE_BLANK")


def reasons(rules: list[tuple[Column, str]]) -> Column:
    """The names of the rules that hold; a rule that cannot be decided holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in rules]))


def basic_checks(items: DataFrame) -> DataFrame:
    """Items with reasons from text, marks, type, difficulty and exact duplicates within their paper (the first by id stays)."""
    t = F.trim(F.coalesce("text", F.lit("")))
    key = F.sha2(norm_text(t), 256)
    first = items.groupBy("paper_id", key.alias("_key")).agg(F.min("question_id").alias("_first"))
    j = items.withColumn("_key", key).join(first, ["paper_id", "_key"])
    rules = [
        (F.length(t) < 5, "empty"),
        ((F.length(F.regexp_replace(t, r"\W", "")) < 10) & ~F.col("type").isin(*SHORT_TYPES), "too_short"),
        (degenerate(t), "placeholder"),
        (t.rlike(r"[,;:\-]$"), "abrupt_end"),
        (~(F.col("marks") > 0) & ~F.coalesce(F.col("marks_unknown"), F.lit(False)), "marks"),
        (~F.col("type").isin(*TYPES), "type"),
        (F.trim(F.coalesce("difficulty", F.lit(""))) == "", "difficulty"),
        (F.col("question_id") != F.col("_first"), "duplicate"),
    ]
    return j.withColumn("reasons", reasons(rules)).drop("_key", "_first")


def answerability(items: DataFrame) -> DataFrame:
    """question_id, hard, soft: an empty stem or too few options are hard; no task frame or content are soft."""
    t = F.trim(F.coalesce("text", F.lit("")))
    frame = t.rlike(r"(?i)\?|_{2,}|^(what|which|who|why|how|when|where|name|list|state|define|explain|describe|write|give|find|identify|choose|compare|draw|solve|calculate)\b")
    hard = reasons([(t == "", "empty_stem"), ((F.col("type") == "MCQ") & (F.coalesce("n_options", F.lit(0)) < 2), "options")])
    soft = reasons([((t != "") & ~frame, "no_task_frame"), ((t != "") & (F.size(content_terms(t)) == 0), "no_content")])
    return items.select("question_id", hard.alias("hard"), soft.alias("soft"))


def grammar_flags(items: DataFrame) -> DataFrame:
    """question_id and flags: a word twice, a double space, no capital, a question without its mark."""
    t = F.trim(F.coalesce("text", F.lit("")))
    return items.select(
        "question_id",
        t.rlike(r"(?i)\b(\w+)\s+\1\b").alias("doubled_word"),
        F.col("text").rlike(r"\S {2,}\S").alias("extra_space"),
        t.rlike(r"^\p{Ll}").alias("no_capital"),
        (t.rlike(r"(?i)^(what|which|who|why|how|when|where)\b") & ~t.rlike(r"\?$")).alias("no_mark"),
    )


def grounding_units(items: DataFrame) -> DataFrame:
    """question_id, part, text: what must be grounded; a match is one unit, choices and parts one each, else the item with its options.

    ``parts`` is an array of (type, text, answer).
    """
    whole = F.array(F.struct(F.lit("whole").alias("part"), F.concat_ws(" ", "text", F.array_join(F.coalesce("options", F.array().cast("array<string>")), " ")).alias("text")))
    match = F.array(F.struct(F.lit("match").alias("part"), F.concat_ws(" ", "text", F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("text")))
    each = F.transform("parts", lambda p, i: F.struct(F.concat(F.lit("p"), i.cast("string")).alias("part"), F.when(p["type"] == "TRUE_FALSE", p["text"]).otherwise(F.concat_ws(" ", p["text"], p["answer"])).alias("text")))
    units = F.when(F.col("type") == "MATCH_THE_FOLLOWING", match).when(F.coalesce(F.size("parts"), F.lit(0)) > 0, each).otherwise(whole)
    return items.select("question_id", F.explode(units).alias("u")).select("question_id", "u.part", "u.text")


def grounding(units: DataFrame, evidence: DataFrame, terms: int = DEFAULT.evidence_terms, coverage: float = DEFAULT.evidence_coverage, depth: int = 5) -> DataFrame:
    """question_id, part, matched, terms, coverage, ok, reason: a unit's terms against those of its slot's first chunks.

    ``evidence`` (slot_key, rank, text) gives at most ``depth`` chunks to a slot, so its term sets are bounded.
    """
    e = evidence.where(F.col("rank") <= depth).groupBy("slot_key").agg(F.array_distinct(F.flatten(F.collect_list(content_terms(F.col("text"))))).alias("known"))
    j = units.withColumn("t", content_terms(F.col("text"))).join(e, "slot_key", "left")
    matched = F.coalesce(F.size(F.array_intersect("t", "known")), F.lit(0))
    j = j.withColumn("matched", matched).withColumn("n", F.size("t")).withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("matched"), F.col("n")), F.lit(0.0)), 6))
    reason = F.when(F.col("known").isNull(), "no_evidence").when(F.col("n") == 0, "no_terms").when(F.col("matched") < terms, "few_terms").when(F.col("coverage") < coverage, "low_coverage")
    return j.select("question_id", "part", "matched", F.col("n").alias("terms"), "coverage", reason.isNull().alias("ok"), reason.alias("reason"))


def structure_check(items: DataFrame, slots: DataFrame) -> DataFrame:
    """question_id, reasons of items that differ from their slot in type, marks, count or options."""
    s = slots.select("paper_id", "slot_index", F.col("type").alias("want_type"), F.col("total_marks").alias("want_marks"), F.col("item_count").alias("want_count"), F.col("option_count").alias("want_options"))
    j = items.join(s, ["paper_id", "slot_index"], "left")
    n = F.coalesce(F.col("n_options"), F.lit(0))
    rules = [
        (F.col("want_type").isNull(), "no_slot"),
        (F.col("want_type").isNotNull() & (F.col("type") != F.col("want_type")), "type"),
        (F.col("want_marks").isNotNull() & (F.col("marks") != F.col("want_marks")), "marks"),
        (F.col("want_count").isNotNull() & (F.col("n_parts") != F.col("want_count")), "item_count"),
        ((F.col("type") == "MCQ") & (n != F.coalesce("want_options", F.lit(4))), "option_count"),
        ((F.col("type") == "TRUE_FALSE") & (n > 0), "options_on_true_false"),
        (F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text"),
    ]
    return j.select("question_id", reasons([(F.coalesce(c, F.lit(False)), r) for c, r in rules]).alias("reasons"))


def answer_check(items: DataFrame) -> DataFrame:
    """question_id, reasons: the answer among the options, boolean where it must be, options filled, named and distinct."""
    o = F.coalesce("options", F.array().cast("array<string>"))
    low = F.transform(o, lambda x: F.lower(F.trim(x)))
    a = F.lower(F.trim(F.coalesce("answer", F.lit(""))))
    mcq = F.col("type") == "MCQ"
    rules = [
        (a == "", "no_answer"),
        (mcq & (a != "") & ~F.array_contains(low, a), "answer_not_an_option"),
        ((F.col("type") == "TRUE_FALSE") & ~a.isin("true", "false"), "not_boolean"),
        (mcq & F.exists(low, lambda x: x == ""), "empty_option"),
        (mcq & F.exists(low, lambda x: x.rlike(r"^[a-e][.)]?$")), "bare_letter"),
        (mcq & (F.size(F.array_distinct(low)) < F.size(low)), "duplicate_options"),
    ]
    return items.select("question_id", reasons(rules).alias("reasons"))


def answer_positions(items: DataFrame, least: int = 3) -> DataFrame:
    """paper_id, items, positions, one_place: whether all right options of a paper stand at one place."""
    p = F.array_position(F.transform("options", lambda x: F.lower(F.trim(x))), F.lower(F.trim("answer")))
    g = items.where("type = 'MCQ'").withColumn("p", p).where("p > 0").groupBy("paper_id").agg(F.count("*").alias("items"), F.countDistinct("p").alias("positions"))
    return g.withColumn("one_place", (F.col("items") >= least) & (F.col("positions") == 1))


def marking_scheme(items: DataFrame) -> DataFrame:
    """question_id, ok, repaired: points of an item worth more than one mark number two at least and sum to its marks.

    A repair scales to halves and gives the drift to the last; if that is not positive the marks are split evenly.
    """
    s = F.aggregate("points", F.lit(0.0), lambda a, x: a + x)
    n = F.size("points")
    ok = (F.col("marks") <= 1) | ((n >= 2) & (F.abs(s - F.col("marks")) <= 0.5))
    scaled = F.transform("points", lambda x: F.round(x * F.coalesce(F.try_divide(F.col("marks"), s), F.lit(1.0)) * 2) / 2)
    head = F.slice(scaled, F.lit(1), F.greatest(n - 1, F.lit(0)))
    last = F.col("marks") - F.aggregate(head, F.lit(0.0), lambda a, x: a + x)
    even = F.transform("points", lambda _: F.round(F.col("marks") / n, 4))
    return items.select("question_id", ok.alias("ok"), F.when(ok, F.col("points")).when(last > 0, F.concat(head, F.array(last))).otherwise(even).alias("repaired"))


def validate_paper(items: DataFrame, slots: DataFrame, sections: DataFrame) -> DataFrame:
    """paper_id, items, missing_slots, section_diff: items by slot, and sections that only one side has."""
    i = items.groupBy("paper_id").agg(F.count("*").alias("items"), F.collect_set("section").alias("got"))
    m = slots.join(items.select("paper_id", "slot_index"), ["paper_id", "slot_index"], "left_anti").groupBy("paper_id").agg(F.count("*").alias("missing_slots"))
    s = sections.groupBy("paper_id").agg(F.collect_set("section").alias("want"))
    j = i.join(m, "paper_id", "left").join(s, "paper_id", "left")
    want = F.coalesce("want", F.array().cast("array<string>"))
    return j.select("paper_id", "items", F.coalesce("missing_slots", F.lit(0)).alias("missing_slots"), F.sort_array(F.array_union(F.array_except("got", want), F.array_except(want, F.col("got")))).alias("section_diff"))


def merge_verdicts(items: DataFrame, verdicts: DataFrame, batch: str) -> DataFrame:
    """id, verdict, note: an item without a verdict is accepted if its batch has any, else rejected."""
    any_ = items.join(verdicts, "id").groupBy(batch).agg(F.count("*").alias("n"))
    j = items.join(verdicts, "id", "left").join(any_, batch, "left")
    some = F.coalesce("n", F.lit(0)) > 0
    return j.select("id", F.when(F.col("valid").isNotNull(), F.when(F.col("valid"), "accepted").otherwise("rejected")).when(some, "accepted").otherwise("rejected").alias("verdict"), F.when(F.col("valid").isNull(), F.when(some, "no_verdict").otherwise("batch_without_verdicts")).alias("note"))


#: Gates from cheap to costly; an item stops at its first failing one.
GATE_ORDER = ("basic", "topic", "novelty", "embedding", "demand", "grounding", "image", "peer", "source", "verdict")


def gate_cascade(items: DataFrame, gates: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """question_id, gate, reasons: one row per item; null gate where it passes every gate.

    A gate is given the items that are left and returns (question_id, reasons) of any of them; rows with reasons fail and
    later gates never see them, so a gate may compare items with each other (peers) or be costly. Gates run in
    ``GATE_ORDER``. What fails is written after each gate; items repeat a question_id only if they fail together.
    """
    from heronlake.sources.staging import written

    left, failed = items, None
    for name in sorted(gates, key=GATE_ORDER.index):
        bad = written(gates[name](left).where(F.size("reasons") > 0).select("question_id", F.lit(name).alias("gate"), "reasons"), f"gate-{name}")
        failed = bad if failed is None else failed.unionByName(bad)
        left = left.join(bad.select("question_id"), "question_id", "left_anti")
    return items.select("question_id").join(failed, "question_id", "left")


def route(items: DataFrame, most: int = DEFAULT.max_retries) -> DataFrame:
    """question_id, route: accepted without reasons, failed after the allowed attempts (two more for summary items), else pending."""
    allowed = F.lit(most) + F.when(summary_trigger(F.col("reference_text")).isNotNull(), 2).otherwise(0)
    return items.select("question_id", F.when(F.size("reasons") == 0, "accepted").when(F.col("attempts") >= allowed, "failed").otherwise("pending").alias("route"))


def slot_accounting(slots: DataFrame, accepted: DataFrame, failed: DataFrame) -> DataFrame:
    """paper_id, slot_index, outcome, attempts: every slot once; an accepted item wins, a silent slot is an explicit failure."""
    a = accepted.groupBy("paper_id", "slot_index").agg(F.max("attempts").alias("a"))
    f = failed.groupBy("paper_id", "slot_index").agg(F.max("attempts").alias("f"))
    j = slots.select("paper_id", "slot_index").join(a, ["paper_id", "slot_index"], "left").join(f, ["paper_id", "slot_index"], "left")
    outcome = F.when(F.col("a").isNotNull(), "accepted").when(F.col("f").isNotNull(), "failed").otherwise("silent")
    return j.select("paper_id", "slot_index", outcome.alias("outcome"), F.coalesce("a", "f", F.lit(0)).alias("attempts"))


def candidate_score(c: DataFrame) -> DataFrame:
    """``c`` with score (4 digits), from structural_ok, n_reasons, n_hard, overlap, similarity, coverage, difficulty_fit, transformed, coding, n_soft, n_grammar, diversity, graph, image."""
    n = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0))
    score = (
        1000 * n("structural_ok") - 100 * n("n_reasons") - 100 * n("n_hard") - 40 * n("overlap") - 100 * F.greatest(F.lit(0.0), n("similarity") - 0.75) + 20 * n("coverage") + 10 * n("difficulty_fit")
        + 5 * n("transformed") + 5 * n("coding") - 5 * n("n_soft") - 5 * n("n_grammar") - 10 * (1 - n("diversity")) + 5 * n("graph") + 8 * n("image")
    )
    return c.withColumn("score", F.round(score, 4))


def best_candidate(pool: DataFrame) -> DataFrame:
    """The one winner of each slot: structure first, then score, then least overlap, then id."""
    return top(pool, ["paper_id", "slot_index"], [F.desc("structural_ok"), F.desc("score"), F.asc("overlap"), F.asc("question_id")], 1, "_k").drop("_k")


ALLOWED_DEMANDS = {
    "MCQ": ["RECALL", "UNDERSTANDING", "APPLICATION"],
    "TRUE_FALSE": ["RECALL", "UNDERSTANDING"],
    "FILL_IN_THE_BLANK": ["RECALL"],
    "SHORT_ANSWER": ["RECALL", "UNDERSTANDING", "APPLICATION", "REASONING"],
    "LONG_ANSWER": ["UNDERSTANDING", "APPLICATION", "ANALYSIS", "REASONING", "EVALUATION"],
}


def demand_targets(slots: DataFrame) -> DataFrame:
    """slot_id, target: of the type's demands those not used, else those other than the reference's, else all, in turn by slot."""
    allowed = F.create_map(*[x for k, v in ALLOWED_DEMANDS.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))])
    every = F.array(*[F.lit(d) for d in ("RECALL", "UNDERSTANDING", "APPLICATION", "ANALYSIS", "REASONING", "EVALUATION")])
    a = F.coalesce(F.try_element_at(allowed, F.col("type")), every)
    free = F.array_except(a, F.coalesce("used", F.array().cast("array<string>")))
    other = F.filter(a, lambda d: d != F.col("reference_demand"))
    pool = F.when(F.size(free) > 0, free).when(F.size(other) > 0, other).otherwise(a)
    return slots.withColumn("_p", pool).select("slot_id", F.get("_p", F.pmod("slot_index", F.size("_p")).cast("int")).alias("target"))


def ledger(accepted: DataFrame) -> DataFrame:
    """paper_id, items, demands, types: what a paper's accepted items already use."""
    d = accepted.withColumn("demand", cognitive_demand(F.col("text")))
    return d.groupBy("paper_id").agg(F.count("*").alias("items"), F.sort_array(F.collect_set("demand")).alias("demands"), F.sort_array(F.collect_set("type")).alias("types"))


def plan_targets(slots: DataFrame) -> DataFrame:
    """slot_id, topic, level, confidence, review: the topic from the first known of seven sources, and how sure it is."""
    sources = ["item_topic", "anchor", "evidence_topic", "graph_topic", "unit_topic", "paper_topic", "subject"]
    blankless = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in sources]
    level = F.coalesce(*[F.when(c.isNotNull(), F.lit(k + 1)) for k, c in enumerate(blankless)])
    has = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    raw = 0.3 * has("item_topic") + 0.2 * has("anchor") + 0.3 * has("evidence_topic") + 0.15 * has("graph_topic") + 0.05 * has("unit_topic")
    conf = F.round(F.when(level > 3, raw * 0.6).otherwise(raw), 6)
    return slots.select("slot_id", F.coalesce(*blankless).alias("topic"), level.alias("level"), conf.alias("confidence"), (F.coalesce(conf, F.lit(0.0)) < 0.3).alias("review"))


def validate_plans(plans: DataFrame, slots: DataFrame) -> DataFrame:
    """slot_id, reasons of plans that change what their slot fixes, or break unit isolation."""
    s = slots.select("slot_id", F.col("total_marks").alias("want_marks"), F.col("difficulty").alias("want_difficulty"), F.col("unit").alias("want_unit"), F.col("item_count").alias("want_count"))
    level = lambda c: F.when(F.col(c) == "Hard", "Difficult").otherwise(F.col(c))
    j = plans.join(s, "slot_id")
    rules = [
        (~F.coalesce(F.col("demand").isin("RECALL", "UNDERSTANDING", "APPLICATION", "ANALYSIS", "REASONING", "EVALUATION", "CREATION", "PROCEDURAL", "UNKNOWN"), F.lit(False)), "demand"),
        (~level("difficulty").eqNullSafe(level("want_difficulty")), "difficulty"),
        (~F.col("marks").eqNullSafe(F.col("want_marks")), "marks"),
        (~F.col("item_count").eqNullSafe(F.col("want_count")), "item_count"),
        (F.col("evidence_unit").isNotNull() & ~F.col("evidence_unit").eqNullSafe(F.col("want_unit")), "unit"),
    ]
    return j.select("slot_id", reasons(rules).alias("reasons"))


VISUAL_CUE = r"(?i)\b(picture|image|diagram|figure|shown|map|graph|chart|illustration|observe)\b"


def item_dependency(items: DataFrame) -> DataFrame:
    """slot_id, item_index, dependency: items with a visual cue depend on the image; if none has one, all do."""
    cue = F.col("reference_text").rlike(VISUAL_CUE)
    some = F.bool_or(cue).over(Window.partitionBy("slot_id"))
    return items.select("slot_id", "item_index", F.when(cue | ~some, "IMAGE_DEPENDENT").otherwise("IMAGE_CONTEXTUAL").alias("dependency"))


def image_alignment(images: DataFrame, notes: DataFrame, graph_names: DataFrame) -> DataFrame:
    """image_id, concept_score, topic_score, confidence, aligned: an image's concepts in its notes by text, or in the graph."""
    c = images.select("image_id", "slot_key", F.explode("concepts").alias("concept"))
    text = notes.groupBy("slot_key").agg(F.lower(F.array_join(F.array_sort(F.collect_list("text")), " ")).alias("all"), F.count("*").alias("n"))
    g = graph_names.select(F.lower("name").alias("gname")).distinct()
    j = c.join(text, "slot_key", "left").join(g, F.lower("concept") == F.col("gname"), "left")
    score = F.when(F.contains("all", F.lower("concept")), 1.0).when(F.col("gname").isNotNull(), 0.7).otherwise(0.0)
    per = j.groupBy("image_id").agg(F.round(F.avg(score), 6).alias("concept_score"), F.first("n").alias("n"), F.first("all").alias("all"))
    t = images.select("image_id", "topic").join(per, "image_id", "left")
    topic = F.when(F.contains("all", F.lower("topic")), 1.0).otherwise(0.0)
    conf = F.round(0.4 * F.coalesce("concept_score", F.lit(0.0)) + 0.3 * F.coalesce(topic, F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / 3) + 0.05, 6)
    return t.select("image_id", F.coalesce("concept_score", F.lit(0.0)).alias("concept_score"), F.coalesce(topic, F.lit(0.0)).alias("topic_score"), F.least(F.lit(1.0), conf).alias("confidence"), (conf >= 0.25).alias("aligned"))


def visual_fidelity(items: DataFrame) -> DataFrame:
    """question_id, reasons of (text, image_terms, dependent): a part shares a term with its image; a dependent one also shows so."""
    t = content_terms(F.col("text"))
    shared = F.size(F.array_intersect(t, F.col("image_terms")))
    unsupported = F.size(F.array_except(t, F.col("image_terms")))
    return items.select("question_id", reasons([(shared == 0, "no_shared_term"), (F.col("dependent") & ~F.col("text").rlike(VISUAL_CUE), "no_visual_cue"), ((unsupported >= 3) & (shared == 0), "unsupported_claims")]).alias("reasons"))


REASON_CLASSES = [(r"(?i)reuse|copy|duplicate", "REUSE"), (r"(?i)drift|topic", "DRIFT"), (r"(?i)image|visual", "IMAGE"), (r"(?i)format|structure|option", "FORMAT"), (r"(?i)swap|parameter", "SWAP"), (r"(?i)ambigu", "AMBIGUITY"), (r"(?i)demand", "DEMAND"), (r"(?i)ground|evidence", "GROUNDING")]


def reason_stats(history: DataFrame, last: int = 12) -> DataFrame:
    """slot_id, class, n, recurring: classes of the last distinct reasons of each slot."""
    cls = F
    for p, c in REASON_CLASSES:
        cls = cls.when(F.col("reason").rlike(p), c)
    distinct = history.groupBy("slot_id", "reason").agg(F.max("at").alias("at"))
    recent = top(distinct, ["slot_id"], [F.desc("at"), F.asc("reason")], last, "_k")
    return recent.withColumn("class", cls.otherwise("OTHER")).groupBy("slot_id", "class").agg(F.count("*").alias("n")).withColumn("recurring", F.col("n") > 1)


def normalize_candidate(raw: DataFrame, slots: DataFrame) -> DataFrame:
    """Candidates in their slot's shape: its type, marks and difficulty, capped lengths, blank parts gone, the text joined."""
    s = slots.select("paper_id", "slot_index", F.col("type").alias("st"), F.col("total_marks").alias("sm"), F.col("difficulty").alias("sd"), F.col("part_marks").alias("pm"))
    j = raw.join(s, ["paper_id", "slot_index"], "left")
    parts = F.slice(F.filter(F.transform("parts", lambda p: F.trim(F.substring(p, 1, 500))), lambda p: F.length(p) >= 3), 1, 26)
    stamped = F.transform(parts, lambda p: F.struct(p.alias("text"), F.col("pm").alias("marks")))
    return j.select("question_id", "paper_id", "slot_index", F.coalesce("st", "type").alias("type"), F.coalesce("sm", "marks").alias("marks"), F.coalesce("sd", "difficulty").alias("difficulty"), stamped.alias("parts"), F.concat_ws("\n", F.substring(F.trim("text"), 1, 2000), F.array_join(parts, "\n")).alias("full_text"))


def structure_signature(items: DataFrame) -> DataFrame:
    """paper_id, runs, signatures, invariant: whether runs of different difficulty have one structure."""
    sig = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("slot_index", "type", "marks", "n_parts"))), lambda x: F.struct(x["slot_index"], x["type"], x["marks"], x["n_parts"])))
    per = items.groupBy("paper_id", "run").agg(sig.alias("s"))
    return per.groupBy("paper_id").agg(F.count("*").alias("runs"), F.countDistinct("s").alias("signatures")).withColumn("invariant", F.col("signatures") == 1)


#: Words that frame an image question and claim nothing.
IMAGE_WORDS = (
    "observe", "look", "identify", "examine", "study", "notice", "locate", "view", "see", "find",
    "read", "picture", "image", "diagram", "illustration", "figure", "photo", "photograph", "scene", "shown",
    "show", "depicted", "given", "provided", "displayed", "refer", "reference", "carefully", "closely", "clearly",
    "mention", "describe", "explain", "tell", "answer", "write", "point", "foreground", "background", "left",
    "right", "top", "bottom", "middle", "center", "above", "below", "behind", "front", "beside",
    "next", "side", "corner", "position",
)


def visual_grounding(units: DataFrame, evidence: DataFrame, image_terms: DataFrame, terms: int = DEFAULT.evidence_terms) -> DataFrame:
    """question_id, part, from_notes, from_image, ok: terms of image items, framing words aside, in the notes or else in the image."""
    e = evidence.where("rank <= 5").groupBy("slot_key").agg(F.array_distinct(F.flatten(F.collect_list(content_terms(F.col("text"))))).alias("known"))
    v = image_terms.groupBy("slot_key").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("seen"))
    empty = F.array().cast("array<string>")
    j = units.withColumn("t", F.filter(content_terms(F.col("text")), lambda w: ~w.isin(*IMAGE_WORDS))).join(e, "slot_key", "left").join(v, "slot_key", "left")
    notes = F.array_intersect("t", F.coalesce("known", empty))
    image = F.array_intersect(F.array_except("t", F.coalesce("known", empty)), F.coalesce("seen", empty))
    return j.select("question_id", "part", F.size(notes).alias("from_notes"), F.size(image).alias("from_image"), (F.size(notes) + F.size(image) >= terms).alias("ok"))
