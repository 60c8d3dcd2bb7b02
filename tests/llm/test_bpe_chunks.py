import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heronlake.llm import bpe_chunks

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _want(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())


def _run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string, digest int").repartition(3)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.encode_documents(docs, PATH).collect())


def test_every_document_equals_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_chunks.encode_documents(docs, PATH).collect()}
    assert got == {r.doc_id: _want(tok, r.text) for r in docs.select("doc_id", "text").collect()}


def test_shared_passages_and_odd_rows(spark):
    rnd = np.random.default_rng(5)
    words = np.array(["alpha", "don't", " beta", "été", "x\n\n", "12345", "<|endoftext|>", "日本語", "a\xa0b", "\t\tq", "—", "word's  "])
    passage = " ".join(rnd.choice(words, 900))
    solid = "".join(rnd.choice(["ab", "é", "9", "日"], 6000))  # no blank at all
    texts = [passage, "intro " + passage, passage + "tail", passage[7:], solid, "z" + solid, solid + " " + passage, "", None, " ", "\n" * 9000, "ha " * 40_000, passage]
    rows = [(k, t, "r", 1) for k, t in enumerate(texts)]
    rows += [(None, passage, None, None), (None, "x", None, None), (3, "again", None, None), (3, "again", None, None), (2**53 + 1, "big", None, None)]
    tok = Tokenizer.from_file(PATH)
    assert _run(spark, rows) == sorted((-1 if d is None else d, *_want(tok, t)) for d, t, _, _ in rows)
    assert _run(spark, []) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab .\n\t\r\x0b\xa0 '1é<|endoftext>s")), max_size=25), max_size=6))
def test_any_cut_is_repaired(chunks):
    tok = test_any_cut_is_repaired.__dict__.setdefault("tok", Tokenizer.from_file(PATH))
    ids = bpe_chunks.join_parts([bpe_chunks.split_safe(c, PATH) for c in chunks], PATH)
    assert np.frombuffer(ids, "<u4").tolist() == tok.encode("".join(chunks), add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_decoding_any_ids(ids):
    tok = test_any_cut_is_repaired.__dict__.setdefault("tok", Tokenizer.from_file(PATH))
    assert bpe_chunks.decode_ids(np.array(ids, "<u4").tobytes(), PATH).decode() == tok.decode(ids, skip_special_tokens=False)


def test_cuts_move_with_content_and_keep_characters():
    rnd = np.random.default_rng(1)
    raw = "".join(rnd.choice(list("abcdefgh éß日\n"), 200_000)).encode()
    a, b = bpe_chunks.cut_points(raw), bpe_chunks.cut_points(b"front " + raw)
    assert len({x + 6 for x in a} & set(b)) > 0.9 * len(a)
    assert a[-1] == len(raw) and max(y - x for x, y in zip([0, *a], a)) <= bpe_chunks.MOST
    for x, y in zip([0, *a], a):
        raw[x:y].decode()
    assert bpe_chunks.cut_points("日".encode() * 9000)[-1] == 27_000
    assert bpe_chunks.cut_points(b"") == []


def test_a_shared_chunk_is_encoded_once(spark):
    rnd = np.random.default_rng(2)
    passage = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "rho"], 4000))
    docs = spark.createDataFrame([(k, f"{k} " + passage) for k in range(6)] + [(9, "nothing shared " * 3)], "doc_id long, text string")
    bitmap, mask = bpe_chunks.shared_filter(docs.select("text"))
    bits = np.frombuffer(bitmap, "<u4")
    hit = lambda c: bool(bits[(h := int.from_bytes(bpe_chunks._digest(c)[:8], "little") & mask) >> 5] >> (h & 31) & 1)
    chunks = bpe_chunks._chunks("0 " + passage)
    assert sum(map(hit, chunks)) >= len(chunks) - 2
    assert len(bitmap) * 8 <= bpe_chunks.MOST_FILTER_BITS


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe_chunks._tables(public_tokenizers.path("word_bpe_49k.json"))
