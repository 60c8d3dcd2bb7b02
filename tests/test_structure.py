"""Structure operators against plain twins that read one document at a time."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from heronlake.operators import chunking as C
from heronlake.operators import graph as G
from heronlake.operators import items as Q
from heronlake.plans import chunk_plans, item_plans


def items_of(rows):
    """Items of one document from (line, kind, section) in order."""
    out, main, now = [], None, None
    for line, kind, section in rows:
        if kind == "section":
            now = None
        elif kind in ("main", "number"):
            m = re.match(r"(?i)\s*Q?\s*\.?\s*(\d+)\s*[.:)]?\s*(.*)", line)
            main = f"Q{m[1]}"
            now = {"n": main, "p": None, "text": m[2], "options": [], "section": section}
            out.append(now)
        elif kind == "sub" and main:
            m = re.match(r"\s*(\([a-z]\))\s*(.*)", line)
            now = {"n": main + m[1], "p": main, "text": m[2], "options": [], "section": section}
            out.append(now)
        elif now and kind in ("option", "roman"):
            now["options"].append(re.sub(r"^\s*\(?\w+[.)]\s*", "", line).strip())
        elif now and kind == "option_row":
            now["options"] += [x.strip() for x in re.split(r"\s*\(?\b[a-d][).]\s*", line) if x.strip()]
        elif now and kind not in ("blank", "instruction"):
            now["text"] = f"{now['text']} {line.strip()}".strip()
    return [(i, q["n"], q["p"], q["text"], q["options"], q["section"]) for i, q in enumerate(out)]


def assert_items(lines):
    by_doc = defaultdict(list)
    for r in sorted(lines.collect(), key=lambda r: r.ord):
        by_doc[r.document_id].append((r.line, r.kind, r.section))
    want = sorted(((d, *q) for d, rows in by_doc.items() for q in items_of(rows)), key=repr)
    got = sorted(((r.document_id, r.ord, r.question_number, r.parent_question_number, r.text, r.options, r.section) for r in Q.segment_questions(lines).collect()), key=repr)
    assert got == want
    return got


def test_items_equal_a_fold_over_lines(spark, sf):
    lines = Q.carry_section(Q.classify_lines(item_plans._pages(spark, sf)))
    assert len(assert_items(lines)) > 200
    plan = Q.segment_questions(lines)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_items_of_odd_papers(spark):
    text = "before\n(a) no main yet\nSection A\nQ1. Name it [2]\nand more\n\n  (b) part \n(a) x (b) y\na) one\nii) two\nInstructions: none\nSection B\nlost\n12. Next  \n[5]\n3) Last"
    pages = spark.createDataFrame([("d", 1, text), (None, 1, text), ("e", 1, ""), ("f", 1, None), ("g", 1, "Q2. " + "long " * 50_000)], "document_id string, page_number int, text string")
    got = assert_items(Q.carry_section(Q.classify_lines(pages)))
    mine = [g[1:] for g in got if g[0] == "d"]
    assert mine == [
        (0, "Q1", None, "Name it [2] and more", [], "A"),
        (1, "Q1(b)", "Q1", "part ", ["x", "y", "one", "two"], "A"),
        (2, "Q12", None, "Next   [5]", [], "B"),
        (3, "Q3", None, "Last", [], "B"),
    ]
    assert Q.segment_questions(Q.carry_section(Q.classify_lines(pages.limit(0)))).count() == 0


def paths_of(rows):
    """Path of each (ord, type, level, text) of one document, by a stack."""
    out, stack = [], []
    for at, kind, level, text in rows:
        level = 1 if level is None else level
        if kind == "heading":
            stack = [s for s in stack if s[0] < level]
        out.append((at, [t for _, t in stack]))
        if kind == "heading":
            stack.append((level, text))
    return out


def test_heading_paths_equal_a_stack(spark, sf):
    e = chunk_plans._elements(spark, sf)
    deep = e.withColumn("heading_level", F.when(F.col("type") == "heading", (F.xxhash64("document_id", "ord") % 5 + 5).cast("int")))
    for elements in (e, deep):
        by_doc = defaultdict(list)
        for r in sorted(elements.collect(), key=lambda r: r.ord):
            by_doc[r.document_id].append((r.ord, r.type, r.heading_level, r.text))
        want = sorted((d, *p) for d, rows in by_doc.items() for p in paths_of(rows))
        assert sorted((r.document_id, r.ord, r.path) for r in C.heading_path(elements).collect()) == want
    plan = C.heading_path(e)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_heading_paths_of_odd_rows(spark):
    rows = [
        ("d", 1, "heading", 2, "B"),
        ("d", 2, "heading", None, "A"),
        ("d", 3, "heading", 2, None),
        ("d", 3, "heading", 1, "A2"),
        ("d", 4, None, None, "x"),
        ("d", 5, "heading", 99, "deep"),
        ("d", 6, "text", 1, "y"),
        (None, 1, "heading", 1, "N"),
        (None, 2, "text", None, "z"),
    ]
    df = spark.createDataFrame(rows, "document_id string, ord int, type string, heading_level int, text string").withColumns({"level": F.lit(1), "last": F.lit(2)})
    got = [(r.document_id, r.ord, r.text, r.path) for r in C.heading_path(df).orderBy("document_id", "ord", "heading_level").collect()]
    assert got == [
        (None, 1, "N", []),
        (None, 2, "z", ["N"]),
        ("d", 1, "B", []),
        ("d", 2, "A", []),
        ("d", 3, "A2", []),
        ("d", 3, None, ["A"]),
        ("d", 4, "x", ["A2", None]),
        ("d", 5, "deep", ["A2", None]),
        ("d", 6, "y", ["A2", None, "deep"]),
    ]
    assert C.heading_path(df.limit(0)).columns == [*df.columns, "path"]


def test_merged_nodes(spark):
    rows = [
        ("j", "s", "TERM", "JVM", 0.9, ["jvm"]),
        ("v", "s", "TERM", "Java Virtual Machine", 0.6, None),
        ("w", "s", "TERM", "Joint Venture Model", 0.7, ["Joint", "JVM"]),
        ("x", "s", "TERM", "Just Very Mild", 0.4, ["low"]),
        ("o", "t", "TERM", "Java Virtual Machine", 0.8, None),
        ("n", None, "TERM", "CPU", 0.5, None),
        ("m", None, "TERM", "Central Processing Unit", 0.5, []),
        ("z", "s", None, None, None, None),
    ]
    nodes = spark.createDataFrame(rows, "id string, scope string, type string, name string, confidence double, aliases array<string>").withColumns({"_labels": F.lit(1), "_best": F.lit(2)})
    links = G.acronym_aliases(nodes)
    assert sorted(map(tuple, links.collect())) == [("j", "v"), ("m", "m"), ("n", "m"), ("v", "v"), ("w", "v")]
    got = {r.id: (r.name, r.confidence, r.aliases) for r in G.merged_nodes(nodes, links).collect()}
    assert got == {
        "v": ("Java Virtual Machine", 0.9, ["JVM", "Joint", "Joint Venture Model", "jvm"]),
        "x": ("Just Very Mild", 0.4, ["low"]),
        "o": ("Java Virtual Machine", 0.8, None),
        "m": ("Central Processing Unit", 0.5, ["CPU"]),
        "z": (None, None, None),
    }
    assert sorted(map(tuple, G.merges(nodes, links).collect())) == [("j", "v", "JVM"), ("n", "m", "CPU"), ("w", "v", "Joint Venture Model")]
    assert G.merged_nodes(nodes.limit(0), links.limit(0)).count() == 0


def test_nearest_nodes_are_the_first_of_the_subgraph_and_few(spark):
    import random

    from heronlake.operators import graph

    rnd = random.Random(2)
    pairs = [(f"h{k % 3}", f"s{k:03}") for k in range(90)] + [(f"s{rnd.randint(0, 89):03}", f"s{rnd.randint(0, 89):03}") for _ in range(25)] + [("r", "h0"), ("r", "h1"), ("lone", "pair")]
    edges = spark.createDataFrame(pairs, "source string, target string")
    starts = spark.createDataFrame([("s001",), ("s050",), ("h2",), ("r",), ("lone",), ("alone",)], "id string")
    first = lambda df: {(s, i, h) for s in {r.start for r in df} for _, h, i in [(None, r.hops, r.id) for r in sorted((r for r in df if r.start == s), key=lambda r: (r.hops, r.id))[:7]]}
    for depth in (0, 1, 2, 3):
        got = graph.nearest_nodes(edges, starts, depth, 7).collect()
        assert first(got) == first(graph.subgraph(edges, starts, depth).collect())
        assert len(got) <= 6 * (1 + 7 * depth)


def test_graph_evidence_keeps_no_more_rows_of_a_hub_than_asked_for(spark, monkeypatch):
    from heronlake.operators import graph
    from heronlake.sources import staging

    nodes = spark.createDataFrame([(f"s{k:03}", "CONCEPT", f"name {k}", 0.5, f"d{k % 3}") for k in range(80)] + [("hub", "TOPIC", "hub", 0.9, "d")], "id string, type string, name string, confidence double, source_document_id string")
    edges = spark.createDataFrame([("hub", f"s{k:03}", 0.5, "d") for k in range(80)], "source string, target string, confidence double, source_document_id string")
    queries = spark.createDataFrame([(k, f"name {k}", "none") for k in range(80)], "query_id int, concept string, topic string")
    rows, plain = [], staging.written
    monkeypatch.setattr(staging, "written", lambda df, name: rows.append(plain(df, name)) or rows[-1])
    got = graph.graph_evidence(nodes, edges, queries, 2, 5).collect()
    assert {(r.nodes, r.edges) for r in got} == {(5, 4)} and len(got) == 80
    assert rows and max(df.count() for df in rows) <= 80 * 5


def test_upsert_takes_the_greatest_of_equally_late_rows(spark):
    from heronlake.sources import store

    base = spark.createDataFrame([(1, 5, "a")], "k int, at int, v string")
    for order in (("b", "c"), ("c", "b")):
        new = spark.createDataFrame([(1, 3, v) for v in order], "k int, at int, v string").coalesce(1)
        assert store.upsert(base, new, ["k"], "at").first().v == "c"


def test_sql_of_upsert_and_fidelity_states_the_rule_of_the_query(spark, tmp_path):
    import datetime

    import duckdb

    import heronlake.plans.gate_plans  # noqa: F401
    import heronlake.plans.store_plans  # noqa: F401
    from heronlake.registry import ORACLE_SQL, QUERIES

    day = lambda k: datetime.date(2024, 1, k)
    # shifted keys of multiples of 13 meet keys of the table that are multiples of 7
    lines = [(k, 1, q, day(d)) for k, q, d in ((91, 2.0, 1), (1000091, 3.0, 2), (13, 1.0, 1), (1000013, 9.0, 3), (7, 4.0, 1), (39, 8.0, 4), (1000039, 1.0, 4))]
    lines += [(13 * k, 1, 5.0, day(1)) for k in range(20, 40)] + [(1000000 + 13 * k, 1, 6.0, day(1)) for k in range(20, 40)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    texts = [(2, "Observe the thing with care"), (4, "some words of the lesson"), (5, "another thing with more of it"), (6, "nation station motion")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("s07_upsert", "v26_visual_fidelity"):
        df = QUERIES[name](spark, str(tmp_path))
        cur = con.execute(ORACLE_SQL[name])
        at = [[d[0] for d in cur.description].index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall()), name


def test_subgraph_deals_a_step_to_as_many_tasks_as_its_rows_need(spark, monkeypatch):
    from heronlake.operators import graph

    monkeypatch.setattr(graph, "STEP_ROWS", 10)
    edges = spark.createDataFrame([("hub", f"s{k}") for k in range(20)] + [("s0", "far")], "source string, target string")
    starts = spark.createDataFrame([("s0",), ("s1",)], "id string")
    got = graph.subgraph(edges, starts)
    want = [("s0", "s0", 0), ("s0", "hub", 1), ("s0", "far", 1), ("s1", "s1", 0), ("s1", "hub", 1)]
    want += [(s, f"s{k}", 2) for s in ("s0", "s1") for k in range(20) if s != f"s{k}"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # the number of tasks follows the rows, and is not the session's setting
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_items_and_what_meets_them_are_dealt_to_as_many_tasks_as_they_need(spark, sf, monkeypatch):
    import re

    from heronlake.registry import QUERIES
    from heronlake.sources import staging

    names = ("b13_reconcile", "b15_confidence", "b18_paper_summary", "b25_validate_spec", "b26_validate_assignments", "r19_expand_tasks")
    rows = lambda name: sorted(map(repr, QUERIES[name](spark, sf).collect()))
    want = {name: rows(name) for name in names}
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr(staging, "TASK_ROWS", -(-n // 11))  # 11 tasks; the session says 8
    for name in names:
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        # items are dealt by their rows, and no join or group deals them again by the session's number; for b26 the
        # planner alone does so, with the items numbered 99
        assert re.search(r"hashpartitioning\(l_orderkey#\d+L?, 11\), REPARTITION_BY_NUM", plan), name
        assert name[:3] == "b26" or not re.search(r"hashpartitioning\((?:slot_id|l_orderkey|o_orderkey)[^()]*, 8\)", plan), name
        assert sorted(map(repr, df.collect())) == want[name], name


def test_parents_and_children_move_a_document_once_by_its_id(spark, sf):
    from heronlake.operators import chunking as C
    from heronlake.registry import QUERIES

    plan = QUERIES["c11_emit_parent_child"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning(document_id") <= 2  # for the elements, and for the numbers
    line = lambda o, t, kind="paragraph": (1, o, kind, t, 1)
    elements = [line(0, "before any heading"), line(1, "Title", "heading"), line(2, "one two three."), line(3, "item", "list_item"), line(4, "next", "list_item")]
    elements += [line(5, "Alone", "heading"), line(6, "Long", "heading")] + [line(7 + k, " ".join(f"w{k}x{j}" for j in range(300)) + ".") for k in range(3)]
    df = spark.createDataFrame(elements, "document_id long, ord int, type string, text string, page_number int")
    got = sorted(C.emit_parent_child(df, 700).collect(), key=lambda r: (r.section_id, r.chunk_index))
    body = [e[3] for e in elements[7:]]
    assert [(r.section_id, r.chunk_type, r.chunk_index, r.text) for r in got] == [
        (0, "parent", 0, "before any heading"), (0, "child", 1, "before any heading"),
        (1, "parent", 0, "Title\none two three.\n\n- item\n- next"), (1, "child", 1, "one two three.\n- item\n- next"),
        (3, "parent", 0, "Long\n" + "\n\n".join(body[:2])), (3, "parent", 1, "Long\n" + body[2]),
        (3, "child", 2, "Long\n" + body[0]), (3, "child", 3, "Long\n" + body[1]), (3, "child", 4, body[2]),
    ]
    ids = {r.chunk_id for r in got if r.chunk_type == "parent"}
    assert {r.parent_chunk_id for r in got if r.chunk_type == "child"} == ids


def test_children_reach_python_in_small_batches(spark, sf):
    from heronlake.registry import QUERIES

    plan = QUERIES["c09_child_parts"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan
