import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heronlake.llm import alignment, bpe_chunks

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _brute(rows):
    """Straight from the two libraries, one document after the other."""
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    table = bpe_chunks._tables(A)[0]
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if b"".join(table[i] for i in a) != (" " + text).encode() or b"".join(map(piece, b)) != (" " + text).encode():
                a, b = [], []
        at = {}
        end = 0
        for k, i in enumerate(a):
            end += len(table[i])
            at[end] = k + 1
        end = s = t = 0
        for k, i in enumerate(b):
            end += len(piece(i))
            if end in at:
                groups.append(",".join(map(str, a[s : at[end]])) + "|" + ",".join(map(str, b[t : k + 1])))
                s, t = at[end], k + 1
                links.append((a[s - 1], i))
        counts.update(links)
        docs.append((doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out, counts


def _key(row):
    return tuple(-1 if x is None else x for x in row)


def test_every_document_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, _ = _brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(map(tuple, alignment.align_documents(docs, A, B).collect())) == sorted(want)


def test_odd_rows(spark):
    texts = ["hello world", "hello world", None, "", " ", "a▁b", "<|endoftext|> <s> x", "tab\tand\nline  ends \n", "\nfirst", "odd\xa0space here", "日本語 text 🙂", "ha " * 30_000, "don't  stop", "x" * 3000, "f() {\r\n  g();\r\n}\r"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "hello"), (None, "hello"), (3, "again"), (2**53 + 1, "hello world")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, row int, bucket int, packed int").repartition(4)
    want, counts = _brute(rows)
    assert sorted(map(_key, alignment.align_documents(docs, A, B).collect())) == sorted(map(_key, want))
    assert alignment.align_documents(docs.limit(0), A, B).count() == 0
    pairs = alignment.Aligned(docs, A, B).pairs().collect()
    assert {(r.a, r.b): r.links for r in pairs} == dict(counts)
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    hello = next(r for r in pairs if (r.a, r.b) == (tok.encode(" hello").ids[0], sp.encode("hello")[-1]))
    assert (hello.documents, hello.links) == (5, 5)


def test_dense_containers_and_planes():
    rnd = np.random.default_rng(0)
    lows = np.concatenate([np.arange(60_000), np.arange(60_000)[::3], rnd.integers(0, 65_536, 500)])
    links = np.concatenate([np.full(80_000, 7 << 32 | 5), np.full(500, 9 << 32 | 1)]).astype(np.uint64)
    made = alignment.Postings.of_links(links, lows)
    back = alignment.Postings.unpack(made.pack())
    for k in ("pairs", "planes", "sizes", "lows"):
        assert getattr(made, k).tolist() == getattr(back, k).tolist()
    assert len(made.pack()) < 25_000
    pairs, documents, total = back.counts()
    assert (documents.tolist(), total.tolist()) == ([60_000, len(set(lows[80_000:].tolist()))], [80_000, 500])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 65_535)), min_size=1, max_size=60), st.integers(1, 59))
def test_or_merge_of_parts_is_the_whole(links, cut):
    links.sort(key=lambda x: x[1])
    pairs, lows = np.array([x[0] for x in links], np.uint64), np.array([x[1] for x in links])
    cut = int(np.searchsorted(lows, lows[min(cut, len(lows) - 1)]))  # a document lies on one side
    whole = alignment.Postings.of_links(pairs, lows)
    sides = [alignment.Postings.of_links(pairs[s], lows[s]) for s in (slice(0, cut), slice(cut, None)) if len(lows[s])]
    merged = alignment.Postings.merged([*sides, sides[0]])  # a part met twice changes nothing
    assert all(getattr(whole, k).tolist() == getattr(merged, k).tolist() for k in ("pairs", "planes", "sizes", "lows"))
