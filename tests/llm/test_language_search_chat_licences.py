import numpy as np
from pyspark.sql import functions as F

from heronlake.llm import chat as H
from heronlake.llm import collision_search as A
from heronlake.llm import language_id as L
from heronlake.llm import licences as I


def test_languages_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs.where(L.remainder("doc_id") != 2), rows=200)
    got = L.predict(docs.where(L.remainder("doc_id") == 2), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)] + [(99, "x", None), (98, None, "en")], "doc_id long, text string, lang string")
    model = L.fit(train)
    assert model.languages == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !"), (4, "the dog"), (4, "the dog"), (5, "katze " * 50_000)]
    got = [(r.doc_id, r.lang_pred) for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")), model).collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "de")]
    assert L.predict(train.limit(0), model).count() == 0
    assert L.fit(train.limit(0)).languages == []


def test_fitted_filter_holds_every_gram_of_the_rows(spark):
    train = spark.createDataFrame([("hapax eins", "de"), ("one word", "en"), ("two", "en")], "text string, lang string")
    model = L.fit(train)
    built = L.build_filter({"de": L.gram_hashes(["hapax", "eins"])[0], "en": L.gram_hashes(["one", "word", "two"])[0]})
    for b, words in enumerate((["hapax", "eins"], ["one", "word", "two"])):
        long = L.gram_hashes(words)[0][-3:]  # n-grams of four, which the other language lacks
        assert ((model.lookup(long) >> b) & 1 == 1).all() and ((built.lookup(long) >> b) & 1 == 1).all()


def test_filter_returns_every_language(spark):
    a, b = L.gram_hashes(["eins", "zwei"])[0], L.gram_hashes(["one", "zwei"])[0]
    f = L.build_filter({"de": a, "en": b})
    assert ((f.lookup(a) & 1) == 1).all() and ((f.lookup(b) & 2) == 2).all()
    hit = f.lookup(L.gram_hashes(["one"])[0]) & 1
    assert hit.mean() < 0.5


def brute(rows, queries, k):
    out = {}
    for qi, q in queries:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum())), i) for i, v in rows if i != qi)
        out[qi] = d[:k]
    return out


def test_search_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = A.search(rows, rows.where("vec_id % 20 = 0"), 10, shard_rows=128).collect()
    data = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect()]
    want = brute(data, [x for x in data if x[0] % 20 == 0], 10)
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(i, j): float(np.sqrt(((a - b) ** 2).sum())) for i, a in data if i % 20 == 0 for j, b in data}
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in got)


def test_search_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "a"), (3, None, "a"), (4, [0.0, 0.0], "a"), (5, [float("nan"), 1.0], "a"), (6, [None, 1.0], "a"), (7, [1.0, 0.0], "a"), (8, [1.0, 2.0, 3.0], "a"), (None, [1.0, 0.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string")
    got = [(r.query_id, r.rank, r.vec_id) for r in A.search(df, df.where("vec_id IN (0, 3, 8)"), 10).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 7), (0, 3, 2)]
    assert A.search(df.limit(0), df.limit(0), 3).count() == 0


def test_search_ends_for_components_of_any_size(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.standard_normal(8) * 10.0 ** (307, 200, 0, -200)[i % 4]).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = A.search(df, df.where("vec_id % 10 = 0"), 3, shard_rows=40).collect()
    assert len(got) == 8 * 3 and all(np.isfinite(r.score) for r in got)
    vec = dict(rows)
    for r in got:
        diff = np.array(vec[r.query_id]) - np.array(vec[r.vec_id])
        top = np.abs(diff).max()
        assert abs(r.score / (np.sqrt(((diff / top) ** 2).sum()) * top) - 1) < 1e-12


def test_distances_are_plain_ones_in_the_usual_range():
    rnd = np.random.default_rng(4)
    v, q = rnd.standard_normal((500, 64)), rnd.standard_normal(64)
    assert (A.distances(v, q) == np.sqrt(((v - q) ** 2).sum(axis=1))).all()
    assert A.distances(np.array([[1.7e308]]), np.array([-1.7e308]))[0] == np.inf


def chat_accuracy(spark, conv):
    """Of held-out conversations: share of lines with the right role, precision and recall of turn openers."""
    lines = H.as_transcripts(conv)
    model = H.fit(lines.where(~H.held_out(F.col("conv_id"))))
    asked = lines.where(H.held_out(F.col("conv_id")))
    want, got = {}, {}
    for r in asked.orderBy("conv_id", "turn", "idx").collect():
        said = r.line.strip() != ""
        before = want.setdefault(r.conv_id, [])
        opened = any(t == r.turn and o for _, t, o, _ in before)
        before.append((r.role, r.turn, said and not opened, said))
    for r in H.parse(asked.drop("role"), model, ["turn", "idx"]).orderBy("conv_id", "part", "block", "k").collect():
        got.setdefault(r.conv_id, []).append(H.STATES[r.state])
    assert {k: len(v) for k, v in want.items()} == {k: len(v) for k, v in got.items()}
    pairs = [(w, g) for k in want for w, g in zip(want[k], got[k]) if w[3]]
    role = sum(w[0] == g[0] for w, g in pairs) / len(pairs)
    hit = sum(w[2] and g[1] == H.OPENS for w, g in pairs)
    return role, hit / sum(g[1] == H.OPENS for _, g in pairs), hit / sum(w[2] for w, _ in pairs)


def test_chat_roles_and_turns_are_recovered_in_held_out_conversations(spark, sf):
    role, precision, recall = chat_accuracy(spark, spark.read.parquet(f"{sf.replace('0.001', '0.01')}/conversations.parquet"))
    print(role, precision, recall)
    assert role >= 0.9 and precision >= 0.9 and recall >= 0.85


def test_chat_turns_are_rendered(spark, sf):
    lines = H.as_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    out = H.render(H.parse(lines.drop("role"), H.fit(lines), ["turn", "idx"])).collect()
    assert sum(r.n_lines for r in out) == lines.count()
    assert all(r.text.startswith(f"<|{r.role}|>\n") and r.text.endswith("\n<|end|>") for r in out)


def test_chat_without_markers_on_every_turn(spark, sf):
    model = H.fit(H.as_transcripts(spark.read.parquet(f"{sf}/conversations.parquet")))
    text = "Human: What is it?\n\nAI: It is this.\n\nAnd a second paragraph of the answer.\nHuman: And that?\nTool: 42"
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "conv_id long, idx long, line string")
    got = [(r.turn, r.role, r.text) for r in H.render(H.parse(lines, model, ["idx"])).orderBy("turn").collect()]
    assert got == [
        (0, "user", "<|user|>\nWhat is it?\n<|end|>"),
        (1, "assistant", "<|assistant|>\nIt is this.\n\nAnd a second paragraph of the answer.\n<|end|>"),
        (2, "user", "<|user|>\nAnd that?\n<|end|>"),
        (3, "other", "<|other|>\n42\n<|end|>"),
    ]


def test_blocks_equal_whole_viterbi():
    rnd = np.random.default_rng(1)
    n = len(H.STATES)
    model = H.Model(*(np.log(rnd.dirichlet(np.ones(k), size=s if s else None)) for k, s in ((n, 0), (n, n), (H.N_OBS, n))))
    obs = rnd.integers(0, H.N_OBS, 500)
    whole = H.viterbi(model, obs, model.start)
    cuts = [obs[i : i + 90] for i in range(0, 500, 90)]
    edges = H.edge_states(model, [H.block_matrix(model, o) for o in cuts])
    got = []
    for o, (a, b) in zip(cuts, edges):
        first, last = np.full(n, -np.inf), np.full(n, -np.inf)
        first[a] = last[b] = 0
        got += H.viterbi(model, o, first, last).tolist()
    assert got == whole.tolist()


def test_chat_odd_rows(spark, sf, monkeypatch):
    lines = H.as_transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    model = H.fit(lines)
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, None, None, None), (2, 0, "tool", "x"), (3, 0, "user", "long " * 30_000)]
    odd = H.as_transcripts(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit("x")))
    parsed = H.parse(odd.drop("role"), model, ["turn", "idx"])
    assert parsed.count() == odd.count()
    monkeypatch.setattr(H, "BLOCK_LINES", 3)
    long = spark.createDataFrame([(9, t, "user" if t % 2 == 0 else "assistant", f"line {t}\nand more") for t in range(40)], "conv_id long, turn long, role string, text string")
    many = H.as_transcripts(long)
    out = H.render(H.parse(many.drop("role"), model, ["turn", "idx"])).collect()
    assert sum(r.n_lines for r in out) == many.count() >= 80
    assert H.parse(odd.drop("role").limit(0), model, ["turn", "idx"]).count() == 0


def test_licences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fitted = I.fit(spark, docs)
    text = "Plain words.\nReleased under the MIT License.\nHer driving licence was renewed.\nThis work is licensed under the Foo Bar Secret License, version 9."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "word " * 50_000 + "\nLicensed under CC BY-NC 4.0."), (5, "Licensed under the Apache License, Version 2.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("probability", F.lit("x"))
    got = sorted((r.doc_id, r.paragraph, r.family) for r in I.classify(df, fitted).collect() if r.confirmed)
    assert got == [(1, 1, "mit"), (1, 1, "mit"), (4, 1, "cc-by-nc"), (5, 0, "apache-2.0")]
    assert I.classify(df.limit(0), fitted).count() == 0
    plan = I.classify(docs, fitted)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_line_and_paragraph_is_classified(spark, sf):
    fitted = I.fit(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    wrapped = next(t for t in I.TEMPLATES["mit"] if t.startswith("Permission")).replace("any person ", "any person\n").replace("to deal ", "to deal\n").replace("limitation the rights ", "limitation the rights\n").replace("publish, ", "publish,\n")
    rows = [(1, "Words.\nAll rights reserved.\nMore words."), (2, "Distributed under Apache 2.0"), (3, "BSD 3-Clause"), (4, f"Plain.\n\n{wrapped}\n \nMore plain words."), (5, "Nothing here.\n\n\nNor here.")]
    got = I.classify(spark.createDataFrame(rows, "doc_id long, text string"), fitted).orderBy("doc_id").collect()
    assert [(r.doc_id, r.paragraph, r.family, r.confirmed) for r in got if r.confirmed] == [(1, 1, "proprietary", True), (2, 0, "apache-2.0", True), (3, 0, "bsd", True), (4, 2, "mit", True)]
    assert [r.statement for r in got if r.doc_id == 4 and r.confirmed] == [wrapped] and 5 not in {r.doc_id for r in got}
    assert not {t for t in got if t.family == "unknown" and t.doc_id == 4}
    both = spark.createDataFrame([(1, "a\nb\n\n\t\nc\n"), (2, ""), (3, None)], "doc_id long, text string")
    every = I.LineModel([0.0] * I.LINE_FEATURES, 0.0)
    assert sorted(tuple(r) for r in I.units(both, every).collect()) == [(1, 0, 0, False, "a\nb"), (1, 0, 0, True, "a"), (1, 0, 1, True, "b"), (1, 4, 4, True, "c")]


def test_statements_without_a_version_take_their_neighbours(spark, sf):
    fitted = I.fit(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    three, two = (next(t for t in I.TEMPLATES[k] if t.startswith("This program")) for k in ("gpl-3.0", "gpl-2.0"))
    hope, got_copy = next(t for t in I.TEMPLATES["gpl"] if "hope" in t), I.TEMPLATES["gpl"][-1]
    rows = [(1, f"{three}\n\n{hope}\n\n{got_copy}"), (2, hope), (3, f"{two}\n\n{hope}\n\nWords."), (4, f"{hope}\n\n{three}"), (4, f"{hope}\n\n{three}"), (None, hope), (5, f"{hope}\n\nReleased under the MIT License.")]
    out = I.classify(spark.createDataFrame(rows, "doc_id long, text string"), fitted).collect()
    assert sorted((r.doc_id or 0, r.paragraph, r.family, r.confirmed) for r in out) == [
        (0, 0, "gpl", True),
        *[(1, k, "gpl-3.0", True) for k in (0, 2, 4)],
        (2, 0, "gpl", True),
        *[(3, k, "gpl-2.0", True) for k in (0, 2)],
        *[(4, k, "gpl-3.0", True) for k in (0, 0, 2, 2)],
        (5, 0, "gpl", True),
        (5, 2, "mit", True),
    ]
