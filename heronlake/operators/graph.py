"""Knowledge graph as node and edge tables: checks, extraction, aliases and bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions.text import sentences
from heronlake.operators.retrieval import top

# --- fixed values -----------------------------------------------------------------------------------------------------
NODE_TYPES = ("UNIT", "TOPIC", "SUBTOPIC", "CONCEPT", "TERM", "FACT", "EXAMPLE", "PERSON", "EVENT", "PROCESS", "OBJECT", "SKILL")
RELATIONS = ("CONTAINS", "PART_OF", "RELATED_TO", "IS_A", "HAS_PROPERTY", "CAUSES", "RESULTS_IN", "USED_FOR", "EXAMPLE_OF", "DEPENDS_ON", "COMPARED_WITH", "DIFFERENT_FROM", "CONSISTS_OF", "PRODUCES", "ENABLES", "PRECEDES", "PROVIDES")
#: Phrases that join two terms, with the relation they state.
PHRASES = [
    ("is a type of", "IS_A"),
    ("is a kind of", "IS_A"),
    ("is an example of", "IS_A"),
    ("for example", "EXAMPLE_OF"),
    ("such as", "EXAMPLE_OF"),
    ("consists of", "CONSISTS_OF"),
    ("is made up of", "CONSISTS_OF"),
    ("is composed of", "CONSISTS_OF"),
    ("is a part of", "PART_OF"),
    ("is part of", "PART_OF"),
    ("contains", "CONTAINS"),
    ("includes", "CONTAINS"),
    ("depends on", "DEPENDS_ON"),
    ("results in", "RESULTS_IN"),
    ("leads to", "CAUSES"),
    ("causes", "CAUSES"),
    ("produces", "PRODUCES"),
    ("generates", "PRODUCES"),
    ("enables", "ENABLES"),
    ("allows", "ENABLES"),
    ("is used for", "USED_FOR"),
    ("is used to", "USED_FOR"),
    ("provides", "PROVIDES"),
    ("offers", "PROVIDES"),
    ("comes before", "PRECEDES"),
    ("precedes", "PRECEDES"),
    ("compared with", "COMPARED_WITH"),
    ("compared to", "COMPARED_WITH"),
    ("is different from", "DIFFERENT_FROM"),
    ("unlike", "DIFFERENT_FROM"),
    ("is an", "IS_A"),
    ("is a", "IS_A"),
    ("is related to", "RELATED_TO"),
    ("related to", "RELATED_TO"),
    ("associated with", "RELATED_TO"),
    ("has", "HAS_PROPERTY"),
]


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _problems(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in rules]))


def validate_nodes(nodes: DataFrame) -> DataFrame:
    bad = ~F.col("confidence").between(0, 1) | F.isnan("confidence")
    return nodes.withColumn("errors", _problems([(~F.col("type").isin(*NODE_TYPES), "type"), (_blank("name"), "name"), (bad, "confidence"), (_blank("source_document_id"), "provenance_document"), (_blank("chunk_id"), "provenance_chunk")]))


def validate_edges(edges: DataFrame) -> DataFrame:
    bad = ~F.col("confidence").between(0, 1) | F.isnan("confidence")
    return edges.withColumn("errors", _problems([(~F.col("relation").isin(*RELATIONS), "relation"), (_blank("source"), "source"), (_blank("target"), "target"), (bad, "confidence"), (_blank("source_document_id"), "provenance_document"), (_blank("chunk_id"), "provenance_chunk")]))


def node_id(*parts: Column) -> Column:
    """Class, subject and name are folded; the unit and type keep their form."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    cls, subject, unit, kind, name = parts
    return F.concat(F.lit("n_"), F.substring(F.sha2(F.concat_ws("::", fold(cls), fold(subject), F.coalesce(unit, F.lit("")), kind, fold(name)), 256), 1, 40))


def hierarchy_triples(chunks: DataFrame) -> DataFrame:
    """source, relation, target, confidence: unit contains topic contains subtopic, from metadata; a missing level is left out."""
    at = lambda kind, name: node_id(F.col("class"), F.col("subject"), F.col("unit"), F.lit(kind), F.col(name))
    unit, topic, sub = at("UNIT", "unit"), at("TOPIC", "topic"), at("SUBTOPIC", "section")
    pairs = F.array_compact(F.array(F.when(F.col("topic").isNotNull(), F.struct(unit.alias("source"), topic.alias("target"))), F.when(F.col("section").isNotNull(), F.struct(F.when(F.col("topic").isNotNull(), topic).otherwise(unit).alias("source"), sub.alias("target")))))
    rows = chunks.where("unit IS NOT NULL").select(F.explode(pairs).alias("p"))
    return rows.select("p.source", F.lit("CONTAINS").alias("relation"), "p.target", F.lit(1.0).alias("confidence")).distinct()


def _term(words: Column) -> Column:
    filler = ["the", "a", "an", "this", "that", "these", "those", "very", "also", "mainly", "usually", "often", "generally", "it", "they", "and", "or", "to", "of"]
    kept = F.filter(F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: (w != "") & ~F.lower(w).isin(filler))
    return F.array_join(kept, " ")


def connector_triples(chunks: DataFrame) -> DataFrame:
    """chunk_id, source_name, relation, target_name, sentence: terms either side of a sentence's first longest phrase.

    The phrases are tried longest first in one pattern, so a sentence is read once and joined with nothing. Most sentences
    have no phrase even as plain letters, and leave before a pattern is tried.
    """
    order = sorted(PHRASES, key=lambda p: -len(p[0]))
    pattern = r"(?i)^(.*?)\b(" + "|".join(p for p, _ in order) + r")\b(.*)$"
    relation = F.create_map(*[F.lit(x) for p, r in PHRASES for x in (p, r)])
    both = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), F.lower(s).alias("low")))
    s = chunks.select("chunk_id", F.explode(both).alias("s")).select("chunk_id", "s.sentence", "s.low")
    # the longest phrase that occurs anywhere decides, then its first place
    found = F.coalesce(*[F.when(F.col("low").contains(p) & F.col("low").rlike(rf"\b{p}\b"), F.lit(p)) for p, _ in order])
    s = s.withColumn("bare", F.trim(F.regexp_replace("sentence", r"\([^)]*\)", " "))).withColumn("phrase", found).where(F.col("phrase").isNotNull() & F.col("bare").rlike(pattern))
    place = F.position(F.col("phrase"), F.lower("bare"))
    left, right = F.substring(F.col("bare"), F.lit(1), place - 1), F.substring(F.col("bare"), place + F.length("phrase"), F.length("bare"))
    last = F.element_at(F.split(left, r"[,;:]"), -1)
    first = F.element_at(F.split(right, r"[,;:.]"), 1)
    lw, rw = F.split(F.trim(last), r"\s+"), F.split(F.trim(first), r"\s+")
    out = s.select("chunk_id", _term(F.slice(lw, -4, 4)).alias("l4"), _term(F.slice(lw, 1, 4)).alias("l0"), (F.size(lw) >= 4).alias("long"), F.element_at(relation, F.col("phrase")).alias("relation"), _term(F.slice(rw, 1, 6)).alias("target_name"), "sentence")
    return out.select("chunk_id", F.when(F.col("long"), F.col("l4")).otherwise(F.col("l0")).alias("source_name"), "relation", "target_name", "sentence").where("source_name <> '' AND target_name <> ''")


def term_confidence(name: Column, text: Column) -> tuple[Column, Column]:
    """(confidence, type) of a term in its chunk: more if capitalised, more if mentioned again; acronyms are terms."""
    acronym = name.rlike(r"^[A-Z]{2,6}$")
    mentions = F.size(F.split(F.lower(text), F.concat(F.lit(r"\Q"), F.lower(name), F.lit(r"\E")))) - 1
    value = F.lit(0.55) + F.when(acronym | name.rlike(r"^\p{Lu}"), 0.15).otherwise(0.0) + F.when(mentions > 1, 0.1).otherwise(0.0)
    return F.round(F.least(value, F.lit(0.9)), 6), F.when(acronym, "TERM").otherwise("CONCEPT")


def merge_by_id(rows: DataFrame, id_col: str = "id", tie: str = "chunk_id") -> DataFrame:
    """The most confident row of each id; ties by chunk."""
    return top(rows, [id_col], [F.desc("confidence"), F.asc(tie)], 1, "_k").drop("_k")


ACRONYM = r"^[A-Z]{2,6}$"


def acronym_aliases(nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """id, canonical_id: an acronym joins the names whose initials it is, within one scope and type.

    An equi join on initials, not a comparison of pairs. A name has one key (its initials, or itself if it is an
    acronym), so the names that links connect are those of one key, and no rounds over links are needed. The longest
    name is canonical, then the most confident, then the first by name. Nodes below ``least``, or without a name,
    confidence or initials, are in no group; a null scope is a scope of its own.
    """
    scope = ["scope", "type"]
    words = F.filter(F.split(F.trim("name"), r"\s+"), lambda w: w != "")
    initials = F.when(F.size(words) >= 2, F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")))
    short = F.col("name").rlike(ACRONYM)
    n = nodes.where(F.col("confidence") >= least).select("id", *scope, "name", "confidence", F.coalesce(initials, F.when(short, F.col("name"))).alias("key"), short.alias("short")).where("key IS NOT NULL")
    order = F.struct((-F.length("name")).alias("a"), (-F.col("confidence")).alias("b"), "name", "id")
    g = n.groupBy(*scope, "key").agg(F.bool_or("short").alias("has_short"), F.count_if(~F.col("short")).alias("long"), F.min(order).alias("m")).where("has_short AND long > 0")
    g = g.select(*[F.col(c).alias(f"_{c}") for c in scope], F.col("key").alias("_key"), F.col("m.id").alias("canonical_id"))
    met = F.col("key") == F.col("_key")
    for c in scope:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return n.join(g, met).select("id", "canonical_id")


def merged_nodes(nodes: DataFrame, id_map: DataFrame) -> DataFrame:
    """``nodes`` (id, name, confidence, aliases) with one row for each group of ``id_map``: the canonical node's.

    It has the greatest confidence of its members, and as aliases, sorted, all their aliases and the other members'
    names but its own name. Nodes outside the map stay as they are. Labels are made distinct before they are gathered,
    so a row holds what its node holds. Null aliases count as none; other columns are the canonical node's.
    """
    m = id_map.select("id", "canonical_id").distinct()
    members = nodes.select("id", "name", "confidence", "aliases").join(m, "id")
    labels = members.select("canonical_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("name"))).alias("label")).where("label IS NOT NULL").distinct()
    gathered = labels.groupBy("canonical_id").agg(F.sort_array(F.collect_list("label")).alias("_labels"))
    best = members.groupBy("canonical_id").agg(F.max("confidence").alias("_best"))
    merged = best.join(gathered, "canonical_id", "left").withColumnRenamed("canonical_id", "id")
    rows = nodes.select("id", F.struct("*").alias("node")).join(m.where("id <> canonical_id").select("id"), "id", "left_anti").join(merged, "id", "left")
    own = F.coalesce(F.filter("_labels", lambda x: ~x.eqNullSafe(F.col("node.name"))), F.array().cast("array<string>"))
    changed = {"aliases": F.when(F.col("_best").isNotNull(), own).otherwise(F.col("node.aliases")), "confidence": F.coalesce("_best", "node.confidence")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"node.`{c}`") for c in nodes.columns])


def merges(nodes: DataFrame, id_map: DataFrame) -> DataFrame:
    """from_id, to_id, alias: each node that went into another, with the name it had."""
    m = id_map.where("id <> canonical_id").select(F.col("id").alias("from_id"), F.col("canonical_id").alias("to_id")).distinct()
    return m.join(nodes.select(F.col("id").alias("from_id"), F.col("name").alias("alias")), "from_id").select("from_id", "to_id", "alias")


def remap_edges(edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Edges between canonical ids, the most confident of each; loops that arise are dropped."""
    m = id_map.select(F.col("id"), "canonical_id")
    e = edges.join(m.select(F.col("id").alias("source"), F.col("canonical_id").alias("s")), "source", "left").join(m.select(F.col("id").alias("target"), F.col("canonical_id").alias("t")), "target", "left")
    e = e.withColumns({"source": F.coalesce("s", "source"), "target": F.coalesce("t", "target")}).drop("s", "t").where("source <> target")
    return e.groupBy("source", "relation", "target").agg(F.max("confidence").alias("confidence"))


def find_by_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, id: for each (query_id, name) the first node that has it as name or alias, in any case."""
    labels = nodes.select("id", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("label"))
    met = names.join(labels, F.lower(F.trim(names["name"])) == F.lower(F.trim(labels["label"])))
    return met.groupBy("query_id").agg(F.min("id").alias("id"))


def neighbors(edges: DataFrame, starts: DataFrame, direction: str = "both", relation: str | None = None, least: float = 0.0) -> DataFrame:
    """start, relation, neighbor, confidence, one hop away."""
    e = edges.where(F.col("confidence") >= least)
    e = e if relation is None else e.where(F.col("relation") == relation)
    out = e.select(F.col("source").alias("start"), "relation", F.col("target").alias("neighbor"), "confidence")
    back = e.select(F.col("target").alias("start"), "relation", F.col("source").alias("neighbor"), "confidence")
    rows = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return rows.join(starts.select(F.col("id").alias("start")), "start", "left_semi")


#: Rows of one step that a task makes distinct.
STEP_ROWS = 1 << 21


def subgraph(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """start, id, hops: nodes within ``depth`` (0..5) edges of each start, either way, each visited once.

    A step's rows are counted by degree before they are made and dealt by start and node to as many tasks as they need,
    so a task holds about ``STEP_ROWS`` of them, whatever hubs there are. Steps but the last are written.
    """
    from heronlake.sources.staging import written

    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    least, last = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(0, min(5, depth))
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct()
    front = seen
    for hop in range(1, last + 1):
        rows = front.groupBy("id").agg(F.count("*").alias("m")).join(degree, F.col("id") == F.col("a")).agg(F.sum(F.col("m") * F.col("n"))).first()[0] or 0
        parts = max(least, -(-rows // STEP_ROWS))
        step = front.join(both, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).repartition(parts, "start", "id").distinct()
        front = step.join(seen, ["start", "id"], "left_anti").withColumn("hops", F.lit(hop))
        front = written(front, "subgraph-step") if hop < last else front
        seen = seen.unionByName(front)
    return seen


def nearest_nodes(edges: DataFrame, starts: DataFrame, depth: int, limit: int) -> DataFrame:
    """start, id, hops: of ``subgraph`` at least the first ``limit`` nodes of each start by hops and id.

    A start with ``limit`` nodes goes no further. Of a node's neighbours the 2 ``limit`` first by id suffice: fewer than
    ``limit`` are seen already, so the others fill the rest. So a start has at most ``limit`` rows a hop, however large its hubs.
    """
    from heronlake.sources.staging import written

    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    both = written(top(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), ["a"], [F.asc("b")], 2 * limit).select("a", "b"), "near-ends")
    seen = front = written(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct(), "near-starts")
    for hop in range(1, max(0, min(5, depth)) + 1):
        open_ = seen.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") < limit).select("start")
        step = front.join(open_, "start", "left_semi").join(both, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        new = step.join(seen, ["start", "id"], "left_anti").withColumn("hops", F.lit(hop))
        front = written(top(new, ["start"], [F.asc("id")], limit, "_k").drop("_k"), "near-front")
        seen = seen.unionByName(front)
    return seen


def graph_evidence(nodes: DataFrame, edges: DataFrame, queries: DataFrame, depth: int = 2, limit: int = 20) -> DataFrame:
    """query_id, nodes, edges, sources, confidence: the neighbourhood of each query's concept, or of its topic's nodes, or of the units.

    Only the first ``limit`` nodes by hops and id stay, and the edges between them.
    """
    from heronlake.sources.staging import written

    by_name = queries.join(nodes.select("id", F.lower("name").alias("n")), F.lower("concept") == F.col("n")).select("query_id", "id", F.lit(0).alias("level"))
    by_topic = queries.join(nodes.where("type = 'TOPIC'").select("id", F.lower("name").alias("n")), F.lower("topic") == F.col("n")).select("query_id", "id", F.lit(1).alias("level"))
    # units stand in only for queries without a hit; one row holds all their ids
    lost = queries.select("query_id").join(by_name.unionByName(by_topic).select("query_id").distinct(), "query_id", "left_anti")
    units = nodes.where("type = 'UNIT'").agg(F.collect_set("id").alias("ids"))
    by_unit = lost.join(F.broadcast(units)).select("query_id", F.explode("ids").alias("id"), F.lit(2).alias("level"))
    level = Window.partitionBy("query_id")
    starts = by_name.unionByName(by_topic).unionByName(by_unit).withColumn("best", F.min("level").over(level)).where("level = best").select("query_id", "id")
    starts = written(starts, "evidence-starts")
    near = nearest_nodes(edges, starts.select("id"), depth, limit)
    reached = starts.withColumnRenamed("id", "start").join(near, "start").groupBy("query_id", "id").agg(F.min("hops").alias("hops"))
    kept = top(reached, ["query_id"], [F.asc("hops"), F.asc("id")], limit).select("query_id", "id")
    kept = written(kept, "evidence-nodes").join(nodes.select("id", F.col("confidence").alias("c"), "source_document_id"), "id")
    # an edge meets the queries of its end with fewer edges first, so a hub's edges do not meet all queries that keep the hub
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    e = edges
    for end in ("source", "target"):
        e = e.join(degree.select(F.col("id").alias(end), F.col("n").alias(f"_{end}")), end)
    low = F.col("_source") <= F.col("_target")
    e = e.select(F.when(low, F.col("source")).otherwise(F.col("target")).alias("low"), F.when(low, F.col("target")).otherwise(F.col("source")).alias("high"), F.col("confidence").alias("c"), "source_document_id")
    a, b = (kept.select("query_id", F.col("id").alias(k)) for k in ("low", "high"))
    inner = e.join(a, "low").join(b, ["query_id", "high"]).select("query_id", "c", "source_document_id")
    n = kept.select("query_id", "c", "source_document_id", F.lit(1).alias("node")).unionByName(inner.withColumn("node", F.lit(0)))
    return n.groupBy("query_id").agg(F.sum("node").alias("nodes"), F.count_if(F.col("node") == 0).alias("edges"), F.countDistinct("source_document_id").alias("sources"), F.round(F.avg("c"), 6).alias("confidence"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, type, n: nodes by type and edges by relation, with totals."""
    n = nodes.rollup("type").agg(F.count("*").alias("n")).withColumn("kind", F.lit("node"))
    e = edges.rollup(F.col("relation").alias("type")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    return n.unionByName(e)
