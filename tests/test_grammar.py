"""v03's doubled words against neighbouring words compared one by one."""

import re

from heronlake.operators import gates as V
from heronlake.plans import gate_plans
from heronlake.registry import QUERIES


def doubled(text: str) -> bool:
    """Whether two neighbouring runs of ASCII word characters, with only blanks between them, are equal."""
    words = list(re.finditer(r"[0-9A-Za-z_]+", text or ""))
    return any(a[0].lower() == b[0].lower() and re.fullmatch(r"[ \t\n\x0b\f\r]+", text[a.end() : b.start()]) is not None for a, b in zip(words, words[1:]))


def test_doubled_words_of_all_items(spark, sf):
    texts = {r.question_id: r.text for r in gate_plans._items(spark, sf).collect()}
    got = {r.question_id: bool(r.has_pair) for r in QUERIES["v03_grammar_flags"](spark, sf).collect()}
    assert got == {k: doubled(t) for k, t in texts.items()}
    assert any(v and "these these" not in texts[k] for k, v in got.items())


def test_doubled_words(spark):
    rows = [(1, "a cat cat sat"), (2, "a cat sat"), (3, "The the end"), (4, "cat, cat"), (5, "the then"), (6, "bathe the"), (7, "one\\n one")]
    df = spark.createDataFrame([(k, t.replace("\\n", "\n")) for k, t in rows], "question_id long, text string")
    got = {r.question_id: r.doubled_word for r in V.grammar_flags(df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}
