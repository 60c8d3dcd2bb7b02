import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from heronlake.llm import phrases
from heronlake.llm.queries import ORACLE_SQL


def _brute(rows, top, least=10):
    counts, total = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(100 * f[q] >= 50 * a and f[q] >= least for q in longer(f, p)):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def longer(f, p, index={}):  # noqa: B006
    if index.get("of") is not f:
        index.clear()
        index |= {"of": f, "by": defaultdict(list)}
        for q in f:
            if len(q) == 3:
                index["by"][q[:2]].append(q)
                index["by"][q[1:]].append(q)
    return index["by"][p]


def _mined(docs, **kw):
    return sorted(tuple(r) for r in phrases.mine(docs, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def _random(seed, n, vocabulary=40):
    rnd = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(vocabulary)] + ["É", "Été", "B\x1fx", "ﬀ"])
    weights = 1 / np.arange(1, len(words) + 1)
    rows = []
    for k in range(n):
        text = " ".join(rnd.choice(words, 60, p=weights / weights.sum()))
        text = text.replace("w3 w1", "new york city").replace("w5", "Hong  kong.").replace("w7 ", "a\tb\n")
        rows.append(([None, "en", "und", "fr"][k % 4], text))
    return rows


def test_equals_brute_force_over_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = _brute([(r.lang, r.text) for r in docs.collect()], phrases.TOP)
    assert _mined(docs) == want


def test_bars_ties_and_odd_rows(spark):
    rows = _random(1, 400) + [("en", None), ("en", ""), ("en", "..  ;\t"), ("xx", "only once"), ("en", "z y " * 30_000)] + [("en", "tie one. tie two")] * 10
    docs = spark.createDataFrame([(*r, 1, "h", "a") for r in rows], "lang string, text string, n int, h string, a string").repartition(5)
    for top in (1, 7, 2000):
        want = _brute(rows, top)
        assert _mined(docs, top=top, first=1) == want, top
    assert _mined(docs.limit(0)) == []


def test_blocks_add_up(spark, monkeypatch):
    rows = _random(2, 120)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 500)
    assert _mined(docs, top=50) == _brute(rows, 50)


def test_score_beyond_64_bits(spark):
    a, left, right = 10**14 + 7, 10**14 + 9, 3 * 10**14 + 1
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_filter_has_every_key(spark):
    hashes = spark.range(5000).selectExpr("xxhash64(id) AS h")
    found = phrases.Filter(phrases.key_filter(hashes))
    own = np.array([r.h for r in hashes.collect()], np.int64).astype(np.uint64)
    other = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    assert found(own).all() and found(other).mean() < 0.05


def test_sql_says_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = con.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLE_SQL['op11_phrase_mining']})").fetchall()
    assert sorted(rows) == _mined(spark.read.parquet(f"{sf}/documents.parquet"))
