import itertools
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from heronlake.llm import sentencepiece_lattice as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  two  blanks ", "\n\n a\tb", "émoji 🙂 漢字", "x" * 300, "ab " * 5000, "pneumonoultramicroscopicsilicovolcanoconiosis" * 3, "▁ literal", "3.14159,2653", "naïve café—dash"]


def test_ids_equal_the_library(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10**6 + k, t) for k, t in enumerate(ODD)] + [(None, None), (5, "again")]
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(d, t, "u", 1) for d, t in docs], "doc_id long, text string, unit string, ids int")
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in S.encode_documents(df, PATH).collect())
    assert got == sorted((str(d), sp.encode(t or "")) for d, t in docs)
    assert all(r.round_trip for r in S.encode_documents(df, PATH).select("round_trip").collect())
    assert S.encode_documents(df.limit(0), PATH).count() == 0


def test_decoding_restores_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(ODD) if "▁" not in t] + [(10**6, "")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.text) for r in S.decode_documents(S.encode_documents(docs, PATH), PATH).collect())
    assert got == sorted((r.doc_id, r.text) for r in docs.collect())


def test_viterbi_is_the_best_path(spark):
    pieces = {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -2.2, "c": -3.0, "bc": -1.1, "ca": -1.0}
    table = spark.createDataFrame([(p, k, s) for k, (p, s) in enumerate(pieces.items())], "piece string, id int, score double")
    words = ["".join(w) for n in (1, 2, 3, 5) for w in itertools.product("abc", repeat=n)]
    got = S.viterbi_path(S.edges(spark.createDataFrame([(w,) for w in words], "unit string"), table, 3)).collect()

    def best(w):
        return max((pieces[w[:k]] + (best(w[k:]) if w[k:] else 0) for k in range(1, 4) if w[:k] in pieces and len(w) >= k), default=-1e9)

    names = list(pieces)
    for r in got:
        assert "".join(names[p.id] for p in r.path) == r.unit
        assert abs(sum(pieces[names[p.id]] for p in r.path) - best(r.unit)) < 1e-9


def _message(*fields):
    """A protocol buffer message of (number, int | float | bytes)."""
    out = b""
    for k, v in fields:
        if isinstance(v, int):
            out += bytes([k << 3, v])
        elif isinstance(v, float):
            out += bytes([k << 3 | 5]) + struct.pack("<f", v)
        else:
            out += bytes([k << 3 | 2, len(v)]) + v
    return out


def _model(kind, pieces, **normal):
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows = [(1, _message((1, p.encode()), (2, s), (3, t))) for p, s, t in special + [(p, s, 1) for p, s in pieces]]
    return _message(*rows, (2, _message((3, kind))), (3, _message((1, b"identity"), (3, normal.get("prefix", 1)), (4, normal.get("strip", 0)))))


@pytest.mark.parametrize("prefix", [0, 1])
def test_unigram_ids_equal_the_library(spark, tmp_path, prefix):
    rnd = random.Random(4)
    names = {"▁", *"abcde", *("".join(rnd.choices("abcde", k=k)) for k in (2, 2, 3, 4) for _ in range(12)), "▁a", "▁ab", "▁cde"}
    path = tmp_path / "unigram.model"
    path.write_bytes(_model(1, [(p, -rnd.uniform(1, 9) - 2.0 * (len(p) == 1)) for p in sorted(names)], prefix=prefix))
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["", " ", "abc", "a  b", "xyz", "ab xx\nyy cd", "e" * 90, " lead tail "] + ["".join(rnd.choices("abcde abcde x", k=rnd.randint(1, 80))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.round_trip) for r in S.encode_documents(docs, str(path)).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (sp.encode(t), not set(t) - set("abcde "))


def test_models_that_rewrite_texts_are_an_error(spark, tmp_path):
    path = tmp_path / "strip.model"
    path.write_bytes(_model(2, [("▁", -1.0), ("a", -2.0)], strip=1))
    with pytest.raises(ValueError, match="rewrite"):
        S.piece_table(spark, str(path))
