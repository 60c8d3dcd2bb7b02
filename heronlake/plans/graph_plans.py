"""Queries of the knowledge graph (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from heronlake.operators import graph as G
from heronlake.plans.base import query
from heronlake.plans.tables import chunks, edges, nodes, table, with_tables


@query("g01_validate_graph", sql=with_tables("nodes", "edges", then="SELECT id, list_filter([CASE WHEN id LIKE 's1%' THEN 'type' END, CASE WHEN id LIKE '%7' THEN 'name' END, CASE WHEN id LIKE 'n%' THEN 'confidence' END], lambda x: x IS NOT NULL) AS errors FROM nodes UNION ALL SELECT source || target, CASE WHEN source = 'r0' THEN ['relation'] ELSE [] END FROM edges"))
def g01(spark, sf):
    i = F.col("id")
    n = nodes(spark, sf).withColumns({"type": F.when(i.startswith("s1"), "THING").otherwise(F.col("type")), "name": F.when(i.endswith("7"), " ").otherwise(F.col("name")), "confidence": F.when(i.startswith("n"), 1.5).otherwise(F.col("confidence"))})
    e = edges(spark, sf).withColumn("relation", F.when(F.col("source") == "r0", "HOLDS").otherwise(F.col("relation")))
    return G.validate_nodes(n).select("id", "errors").union(G.validate_edges(e).select(F.concat("source", "target"), "errors"))


_ID = "'n_' || sha256(concat_ws('::', lower(class), lower(subject), unit, '{k}', lower({n})))[1:40]"


@query("g03_hierarchy_triples", sql=with_tables("chunks", then=f"SELECT DISTINCT {_ID.format(k='UNIT', n='unit')} AS source, 'CONTAINS' AS relation, {_ID.format(k='TOPIC', n='topic')} AS target, 1.0 AS confidence FROM chunks UNION SELECT DISTINCT {_ID.format(k='TOPIC', n='topic')}, 'CONTAINS', {_ID.format(k='SUBTOPIC', n='section')}, 1.0 FROM chunks"))
def g03(spark, sf):
    return G.hierarchy_triples(chunks(spark, sf))


@query("g04_connector_triples")
def g04(spark, sf):
    return G.connector_triples(chunks(spark, sf, vectors=False))


@query("g05_term_confidence", sql="SELECT doc_id, w AS name, round(least(0.9, 0.55 + CASE WHEN regexp_matches(w, '^\\p{Lu}') THEN 0.15 ELSE 0 END + CASE WHEN len(string_split(lower(text), lower(w))) - 1 > 1 THEN 0.1 ELSE 0 END), 6) AS confidence, CASE WHEN regexp_matches(w, '^[A-Z]{2,6}$') THEN 'TERM' ELSE 'CONCEPT' END AS type FROM (SELECT doc_id, text, string_split(text, ' ')[2] AS w FROM documents) WHERE w <> '' AND w IS NOT NULL")
def g05(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", "text", F.get(F.split("text", " "), 1).alias("name")).where("name <> ''")
    value, kind = G.term_confidence(F.col("name"), F.col("text"))
    return w.select("doc_id", "name", value.alias("confidence"), kind.alias("type"))


@query("g06_merge_by_id", sql="SELECT id, confidence, chunk_id FROM (SELECT l_partkey AS id, l_discount AS confidence, l_orderkey * 100000 + l_suppkey AS chunk_id FROM lineitem) QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, chunk_id) = 1")
def g06(spark, sf):
    return G.merge_by_id(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("confidence"), (F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("chunk_id")))


def _names(spark, sf):
    """Parts by two-word name, and the acronyms of some."""
    p = table(spark, sf, "part")
    full = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("scope"), F.lit("CONCEPT").alias("type"), F.col("p_name").alias("name"), (F.lit(0.4) + (F.col("p_partkey") % 50) / 100.0).alias("confidence"))
    short = p.where("p_partkey % 3 = 0").groupBy("p_brand").agg(F.min("p_partkey").alias("k"), F.min_by("p_name", "p_partkey").alias("n"))
    initials = F.upper(F.array_join(F.transform(F.split("n", " "), lambda w: F.substring(w, 1, 1)), ""))
    return full.union(short.select(F.concat(F.lit("a"), F.col("k").cast("string")), "p_brand", F.lit("CONCEPT"), initials, F.lit(0.9)))


_ALIAS = """
    nm AS (SELECT 'p' || p_partkey AS id, p_brand AS scope, p_name AS name, 0.4 + (p_partkey % 50) / 100.0 AS confidence FROM part
      UNION ALL SELECT 'a' || k, p_brand, upper(string_split(n, ' ')[1][1:1] || string_split(n, ' ')[2][1:1]), 0.9 FROM (SELECT p_brand, min(p_partkey) AS k, arg_min(p_name, p_partkey) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY p_brand)),
    k AS (SELECT *, CASE WHEN contains(name, ' ') THEN upper(string_split(name, ' ')[1][1:1] || string_split(name, ' ')[2][1:1]) ELSE name END AS key, NOT contains(name, ' ') AS short FROM nm WHERE confidence >= 0.5),
    g AS (SELECT scope, key, first(id ORDER BY length(name) DESC, confidence DESC, name, id) AS canonical_id FROM k GROUP BY ALL HAVING bool_or(short) AND count(*) FILTER (NOT short) > 0),
    al AS (SELECT id, canonical_id FROM k JOIN g USING (scope, key))"""


@query("g07_acronym_aliases", sql=f"WITH {_ALIAS} SELECT * FROM al")
def g07(spark, sf):
    return G.acronym_aliases(_names(spark, sf))


def _labelled(spark, sf):
    """The names, each with its upper-case form as alias; every fifth with none."""
    n = _names(spark, sf)
    return n.withColumn("aliases", F.when(F.length("name") % 5 != 0, F.array(F.upper("name"))))


_LABELS = f"""WITH {_ALIAS}, nl AS (SELECT *, CASE WHEN length(name) % 5 <> 0 THEN [upper(name)] END AS aliases FROM nm),
    mem AS (SELECT canonical_id, nl.* FROM nl JOIN al USING (id)),
    lab AS (SELECT DISTINCT canonical_id, unnest(list_append(coalesce(aliases, []), name)) AS label FROM mem),
    gat AS (SELECT canonical_id, list(label ORDER BY label) AS labels FROM lab GROUP BY 1), best AS (SELECT canonical_id, max(confidence) AS best FROM mem GROUP BY 1)"""


@query("g07_merged_nodes", sql=f"{_LABELS} SELECT nl.id, scope, 'CONCEPT' AS type, name, coalesce(best, confidence) AS confidence, CASE WHEN best IS NOT NULL THEN list_filter(labels, lambda x: x <> name) ELSE aliases END AS aliases FROM nl LEFT JOIN best b ON b.canonical_id = nl.id LEFT JOIN gat g ON g.canonical_id = nl.id WHERE nl.id NOT IN (SELECT id FROM al WHERE id <> canonical_id)")
def g07_merged(spark, sf):
    n = _labelled(spark, sf)
    return G.merged_nodes(n, G.acronym_aliases(n))


@query("g07_merges", sql=f"WITH {_ALIAS} SELECT id AS from_id, canonical_id AS to_id, name AS alias FROM al JOIN nm USING (id) WHERE id <> canonical_id")
def g07_merges(spark, sf):
    n = _names(spark, sf)
    return G.merges(n, G.acronym_aliases(n))


def _part_edges(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.lit("RELATED_TO").alias("relation"), F.concat(F.lit("p"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 2000).cast("string")).alias("target"), F.col("l_discount").alias("confidence"))


@query("g08_remap_edges", sql=f"WITH {_ALIAS}, e AS (SELECT 'p' || l_partkey AS source, 'p' || ((l_partkey * 7 + l_suppkey) % 2000) AS target, l_discount AS confidence FROM lineitem), r AS (SELECT coalesce(s.canonical_id, source) AS source, coalesce(t.canonical_id, target) AS target, confidence FROM e LEFT JOIN al s ON s.id = source LEFT JOIN al t ON t.id = target) SELECT source, 'RELATED_TO' AS relation, target, max(confidence) AS confidence FROM r WHERE source <> target GROUP BY source, target")
def g08(spark, sf):
    return G.remap_edges(_part_edges(spark, sf), G.acronym_aliases(_names(spark, sf)))


@query("g09_find_nodes", sql=with_tables("nodes", then="SELECT s_suppkey AS query_id, min(n.id) AS id FROM supplier JOIN nodes n ON lower(n.name) = CASE WHEN s_suppkey % 2 = 0 THEN lower(s_name) ELSE 'nation_' || (s_suppkey % 25) END GROUP BY 1"))
def g09(spark, sf):
    s = table(spark, sf, "supplier")
    names = s.select(F.col("s_suppkey").alias("query_id"), F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.concat(F.lit(" Alias "), (F.col("s_suppkey") % 25).cast("string"))).alias("name"))
    n = nodes(spark, sf).withColumn("aliases", F.when(F.col("type") == "TOPIC", F.array(F.concat(F.lit("alias "), F.regexp_extract("name", r"(\d+)$", 1)))))
    return G.find_by_name(n, names)


@query("g10_neighbors", sql=with_tables("edges", then="SELECT start, relation, neighbor, round(confidence, 6) AS confidence FROM (SELECT source AS start, relation, target AS neighbor, confidence FROM edges UNION ALL SELECT target, relation, source, confidence FROM edges) WHERE confidence >= 0.6 AND start LIKE 'n%'"))
def g10(spark, sf):
    starts = nodes(spark, sf).where("id LIKE 'n%'").select("id")
    return G.neighbors(edges(spark, sf), starts, "both", None, 0.6).withColumn("confidence", F.round("confidence", 6))


_WALK = "both_ AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), h1 AS (SELECT s.id AS start, b AS id FROM st s JOIN both_ ON a = s.id), h2 AS (SELECT start, b AS id FROM h1 JOIN both_ ON a = h1.id), w AS (SELECT start, id, min(hops) AS hops FROM (SELECT id AS start, id, 0 AS hops FROM st UNION ALL SELECT start, id, 1 FROM h1 UNION ALL SELECT start, id, 2 FROM h2) GROUP BY ALL)"


@query("g11_subgraph", sql=with_tables("nodes", "edges", then=f", st AS (SELECT id FROM nodes WHERE id LIKE 's1%'), {_WALK} SELECT * FROM w"))
def g11(spark, sf):
    return G.subgraph(edges(spark, sf), nodes(spark, sf).where("id LIKE 's1%'").select("id"))


@query("g12_graph_evidence", sql=with_tables("nodes", "edges", then=f"""
    , q AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'none' END AS concept, CASE WHEN s_suppkey % 3 = 1 THEN 'nation_' || (s_suppkey % 25) ELSE 'none' END AS topic FROM supplier),
    s0 AS (SELECT query_id, id FROM q JOIN nodes ON lower(name) = lower(concept)), s1 AS (SELECT query_id, id FROM q JOIN nodes ON lower(name) = lower(topic) AND type = 'TOPIC' WHERE query_id NOT IN (SELECT query_id FROM s0)),
    s2 AS (SELECT query_id, id FROM q, nodes WHERE type = 'UNIT' AND query_id NOT IN (SELECT query_id FROM s0 UNION SELECT query_id FROM s1)), qs AS (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2), st AS (SELECT DISTINCT id FROM qs), {_WALK},
    r AS (SELECT query_id, w.id, min(hops) AS hops FROM qs JOIN w ON w.start = qs.id GROUP BY ALL), kept AS (SELECT query_id, id FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hops, id) <= 20),
    al AS (SELECT query_id, confidence AS c, source_document_id AS d, 1 AS node FROM kept JOIN nodes USING (id) UNION ALL SELECT a.query_id, confidence, source_document_id, 0 FROM edges JOIN kept a ON a.id = source JOIN kept b ON b.id = target AND a.query_id = b.query_id)
    SELECT query_id, CAST(sum(node) AS BIGINT) AS nodes, count(*) FILTER (node = 0) AS edges, count(DISTINCT d) AS sources, round(avg(c), 6) AS confidence FROM al GROUP BY query_id"""))
def g12(spark, sf):
    k = F.col("s_suppkey")
    q = table(spark, sf, "supplier").select(k.alias("query_id"), F.when(k % 3 == 0, F.col("s_name")).otherwise("none").alias("concept"), F.when(k % 3 == 1, F.concat(F.lit("nation_"), (k % 25).cast("string"))).otherwise("none").alias("topic"))
    return G.graph_evidence(nodes(spark, sf), edges(spark, sf), q)


@query("g13_graph_stats", sql=with_tables("nodes", "edges", then="SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY ROLLUP (relation)"))
def g13(spark, sf):
    return G.graph_stats(nodes(spark, sf), edges(spark, sf))
