import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heronlake.llm import chunk_store, packing
from heronlake.llm.tokens import SegmentEncoder

ODD = ["", " ", "\n\n", "a  b\t\tc", "x  y z ", "foo <|endoftext|>bar", "é̈ ñ", " lead", "tail \n", "don't we'll", "\x1c\x1d a\x1fb", "Ünï  𝒳 ​", "a\r\n\r\nb"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_segment_encoding_equals_whole_text(name, spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    plain = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
    got = SegmentEncoder(public_tokenizers.path(name)).encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [e.ids for e in plain]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .\n\t\r\x0b\xa0 '1é")), max_size=30))
def test_segment_encoding_any_spaces(text):
    name = public_tokenizers.path("byte_bpe_50k.json")
    enc = test_segment_encoding_any_spaces.__dict__.setdefault("enc", SegmentEncoder(name))
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_encoding_equals_whole_text():
    name = public_tokenizers.path("word_bpe_49k.json")
    texts = ["a <|ENDOFTEXT|> b", "x<|EndOfText|>y 漢字", "a<|endoftext|>B", "İstanbul ''s don'T ½² ǅ a_b", "l'l'll 12é4 ª", "A\x1cb\x85C\xa0'D", "ɏɐ'LL\tß"]
    plain = Tokenizer.from_file(name).encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(b, "<u4").tolist() for b in SegmentEncoder(name).encode(texts)] == [e.ids for e in plain]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_places_every_piece_once(counts):
    capacity, bins, ranks = 60, {}, {}
    for length, first, end, sequence, offset in packing.plan(counts, capacity):
        for k in range(first, end):
            ranks.setdefault(length, []).append(k)
            bins.setdefault(sequence + k - first, []).append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    first_fit = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        k = next((k for k, used in enumerate(first_fit) if used + n <= capacity), None)
        if k is None:
            first_fit.append(n)
        else:
            first_fit[k] += n
    assert len(bins) <= 1.2 * len(first_fit) + 1


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, length string")


def test_pack_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(docs, path).collect()
    tok, want = Tokenizer.from_file(path), {}
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_pack_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(_docs(spark, [(None, "a", "p", "q"), (None, "a", "p", "q"), (1, None, None, None), (2, "", "", ""), (3, "ha " * 9000, "", "")]), path).collect()
    assert len([r for r in rows if r.doc_id is None]) == 2
    assert {(r.doc_id, r.length) for r in rows if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    assert sum(r.length for r in rows if r.doc_id == 3) == len(Tokenizer.from_file(path).encode("ha " * 9000).ids) + 1
    assert packing.pack_documents(_docs(spark, []), path).count() == 0


def test_sequences_hold_the_ids(spark, sf):
    pieces = packing.token_pieces(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    out = packing.sequences(packing.place(pieces)).collect()
    assert sum(len(r.ids) for r in out) == 4 * pieces.agg({"length": "sum"}).first()[0]
    assert max(len(r.ids) for r in out) <= 4 * 2048


def test_store_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = public_tokenizers.path("word_bpe_49k.json")
    store = chunk_store.write_store(docs, path, 1)
    got = {r.doc_id: r for r in chunk_store.read_documents(spark, store).collect()}
    tok, start = Tokenizer.from_file(path), 0
    for r in docs.orderBy("doc_id").collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    chunks = spark.read.parquet(f"{store}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_store_odd_rows(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    store = chunk_store.write_store(_docs(spark, [(None, "a", "", ""), (5, None, "", ""), (5, None, "", ""), (7, "word " * 30000, "", "")]), path, 1)
    got = sorted((r.doc_id or -1, r.start, r.n_tokens) for r in chunk_store.read_documents(spark, store).collect())
    assert got == [(-1, 0, 2), (5, 2, 1), (5, 3, 1), (7, 4, 30001)]
    assert chunk_store.read_documents(spark, chunk_store.write_store(_docs(spark, []), path, 1)).count() == 0


def test_cut_points_move_with_content():
    ids = np.random.default_rng(0).integers(0, 49000, 60_000).astype("<u4")
    a = chunk_store.cut_points(ids)
    b = chunk_store.cut_points(np.concatenate([ids[:5], ids]))
    assert len({x + 5 for x in a} & set(b)) > 0.9 * len(a)
    assert a[-1] == len(ids)
    assert all(y - x <= chunk_store.MOST for x, y in zip([0, *a], a))


def _changed(spark, path, rows):
    table = spark.read.schema(chunk_store._CHUNK if path.endswith("chunks") else chunk_store._DOCUMENT).parquet(path)
    kept = spark.createDataFrame(rows(table.collect()), table.schema).write.mode("overwrite")
    (kept.partitionBy("shared") if path.endswith("chunks") else kept).parquet(path)


def test_damaged_store_is_an_error(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["one two three", "four", "word " * 9000]
    docs = _docs(spark, [(k, t, "", "") for k, t in enumerate(texts)])
    for table, change, said in [
        ("chunks", lambda rows: [r.asDict() | {"ids": b"xx"} for r in rows], "digest"),
        ("chunks", lambda rows: sorted(rows, key=lambda r: -len(r.ids))[1:], "Merkle|as long"),
        ("documents", lambda rows: rows[1:], "manifest"),
        ("documents", lambda rows: [r.asDict() | {"n_tokens": r.n_tokens + 1} for r in rows], "manifest"),
    ]:
        store = chunk_store.write_store(docs, path, 1)
        _changed(spark, f"{store}/{table}", change)
        with pytest.raises(Exception, match=said):
            chunk_store.read_documents(spark, store).collect()


def test_store_of_wide_ids_and_shared_chunks(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rnd = np.random.default_rng(1)
    body = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"], 20_000))
    texts = [body, "front " + body, body + " back", body, ""]
    store = chunk_store.write_store(_docs(spark, [(k, t, "", "") for k, t in enumerate(texts)]).repartition(5), path, 70_000)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in chunk_store.read_documents(spark, store).collect()}
    tok = Tokenizer.from_file(path)
    for k, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 70_000], "<u4")
        assert got[k] == (len(ids), zlib.crc32(ids.tobytes()))
    stored = sum(len(r.ids) for r in spark.read.parquet(f"{store}/chunks").collect())
    assert stored < 1.6 * 4 * got[0][0]
