"""Ids that floating point cannot hold, beside a null, in the operators that send rows to Python."""

import public_tokenizers

from heronlake.llm import chat, chunk_store, packing

BIG = 2**53 + 1


def test_packing_and_store_keep_large_ids(spark):
    rows = [(BIG, "one", "s", 1, 2), (None, "two", "s", 1, 2), (BIG + 1, None, "s", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _salt string, _base int, _rank int").coalesce(1)
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id for r in packed.collect()} == {BIG, None, BIG + 1}
    store = chunk_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    assert {r.doc_id for r in chunk_store.read_documents(spark, store).collect()} == {BIG, None, BIG + 1}


def test_place_keeps_columns_of_any_name(spark):
    rows = [(k, 0, 0, 700 + k, 5, "salt", "base", "rank", "first") for k in range(6)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, _salt string, _base string, _rank string, _first string")
    out = packing.place(pieces).collect()
    assert len(out) == 6 and all((r["_salt"], r["_base"], r["_rank"], r["_first"]) == ("salt", "base", "rank", "first") for r in out)


def test_chat_keeps_large_ids(spark):
    rows = [(c, t, i, line) for c in (BIG, None, BIG + 1) for t, i, line in ((0, 0, "User: hi"), (1, 0, "Assistant: yes"))]
    lines = spark.createDataFrame(rows, "conv_id long, turn int, idx int, line string").coalesce(1)
    conversations = spark.createDataFrame([(k, t, r, x) for k in range(30) for t, (r, x) in enumerate((("user", "What is it?"), ("assistant", "It is so.")))], "conv_id long, turn long, role string, text string")
    turns = chat.render(chat.parse(lines, chat.fit(chat.as_transcripts(conversations)), ["turn", "idx"])).collect()
    assert {r.conv_id for r in turns} == {BIG, None, BIG + 1}
