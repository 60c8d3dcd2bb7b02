import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_jaccard import brute as linked

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs, sf).collect()}
    assert len(rows) >= 0.98 * docs.count()
    last = {}
    for i in sorted(rows):
        last[rows[i].text.translate(UPPER)] = i
    kept = [(i, rows[i].text) for i in sorted(last.values())]
    stay = sorted(d for d, _, c in linked(kept) if d == c)
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted({r.doc_id for r in out}) == stay
    from heronlake.llm.pii import Feistel, pseudonymise

    tok, f = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Feistel(b"repeatable-example-key")
    n = {i: len(tok.encode(pseudonymise(rows[i].text, f), add_special_tokens=False).ids) + 1 for i in stay}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == n


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, sf).columns == docs.columns
        assert step(spark, docs.limit(0), sf).count() == 0
