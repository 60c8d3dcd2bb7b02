import random

import numpy as np
import pytest

from heronlake.llm import jaccard_join as J
from heronlake.llm.components import components


def brute(rows):
    """doc_id -> (set size, component) by comparing every pair."""
    import re
    import string

    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for own in by.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    n = len(sets[i] & sets[j])
                    if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                        root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, node string, n long")
    return sorted((tuple(r) for r in J.linked_groups(docs).collect()), key=str)


def test_test_data(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "lorem ipsum dolor sit amet consectetur " * 20_000
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "a b c d e f"), (None, "A b c d e f"), (9, "a b c d e f"), (7, "q w e r t y u i"), (7, "other words entirely here now"), (10, long), (11, long + "x"), (12, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    near = " ".join(f"w{k}" for k in range(60))
    rows = [(5, near), (5, near + " x"), (3, near + " y"), (3, "other words than those of the rest"), (None, near), (None, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, _kept string, _row long")
    assert sorted((r.doc_id or 0, (r.text or "")[-6:]) for r in J.drop_linked(docs).collect()) == sorted([(3, " w59 y"), (3, "e rest"), (0, ""), (4, ""), (4, "")])


def near_copies(n, seed, words=120, change=0.02):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocab) for _ in range(words)]
    return [" ".join(rnd.choice(vocab) if rnd.random() < change else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("change", [0.01, 0.03, 0.05])
def test_border_groups(spark, change, monkeypatch):
    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "GROUP_PAIRS", 16)
    monkeypatch.setattr(J, "BATCH", 64)
    monkeypatch.setattr(J, "BLOCK", 2000)
    monkeypatch.setattr(J, "BUCKET", 5000)
    texts = near_copies(150, 1, change=change) + near_copies(60, 2, words=300, change=change) + [" ".join(random.Random(9).choices("abcdefghij", k=40))]
    rows = list(enumerate(texts))
    assert got(spark, rows) == brute(rows)


def test_one_word_edits_without_their_base(spark):
    """Pairs at exactly 0.75 and just below: 35 shingles each, 30 common."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for n in (34, 38, 39, 40, 44):
        for k in range(60):
            words = base[:n]
            words[2 + k % (n - 4)] = f"x{n}-{k}"
            rows.append((len(rows), " ".join(words)))
    assert got(spark, rows) == brute(rows)


def test_forest_keeps_every_link():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 900, dtype=np.uint64)
    sets = []
    for k in range(240):
        own = base[: rnd.integers(300, 900)] if k % 2 else rnd.integers(0, 2**63, rnd.integers(5, 900), dtype=np.uint64)
        sets.append(np.unique(np.where(rnd.random(len(own)) < 0.05, rnd.integers(0, 2**63, len(own), dtype=np.uint64), own)))
    sizes, cell = np.array([len(s) for s in sets]), np.repeat([0, 1, 2, 3], [100, 1, 19, 120])
    forest = J.Forest(cell, sizes, sizes, sizes, np.stack([J.bitmap(s) for s in sets]), np.arange(240))
    found = {(min(a, b), max(a, b)) for i, j, _ in forest.pairs() for a, b in zip(i.tolist(), j.tolist())}
    want = {(i, j) for j in range(240) for i in range(j) if cell[i] == cell[j] and J.linked(len(np.intersect1d(sets[i], sets[j])), sizes[i], sizes[j])}
    assert want <= found and all(cell[i] == cell[j] for i, j in found)
    assert len(found) < 240 * 239 / 8


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert out == {x: find(x) for e in edges for x in e if e[0] != e[1]}
