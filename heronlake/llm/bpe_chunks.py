"""Byte-level BPE over content-defined chunks: what documents share is encoded once.

A rolling hash cuts each text into chunks. Chunks met in one place only are encoded where they lie. Those met in more
travel to a dictionary, are encoded once and come back by an equi-join. A cut may fall anywhere, so the ids beside it are
repaired: each chunk's encoding is split at its first and last *safe place*, a blank after a character that is none, where
no merge and no pre-token crosses; what lies between the safe places on both sides of a cut is encoded again as one text.
The window grows over the next chunk until the ids' byte lengths agree with the safe places, so the ids are the whole text's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm.shared import bitmap, fresh_path, release, stage, unstage

#: Bytes: of the rolling window, of a chunk at least, at most, and (as a power of two) on average beyond the least.
WINDOW, LEAST, MOST, MASK_BITS = 16, 128, 8192, 9
#: The filter of shared chunks has 16 bits for each, and this many bits at most (8 MB); beyond, more chunks travel.
MOST_FILTER_BITS = 1 << 26
#: Digests and roots that a task remembers; beyond, it may send a chunk again, which the dictionary drops.
MOST_SEEN = 500_000
_SAFE = re.compile("(?<=[^\\s\x1c-\x1f\x85\u180e\u200b\ufeff])[ \t\r\n]")
_TABLES: dict[str, tuple[list[bytes], object]] = {}


def cut_points(raw: bytes) -> list[int]:
    """Ends of the content-defined chunks of UTF-8 bytes: where a hash of the last WINDOW bytes has MASK_BITS zero bits
    and a character begins. A chunk has LEAST to MOST bytes (up to three fewer where a character would be cut)."""
    import numpy as np

    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    codes = np.frombuffer(raw, "u1")
    mixed = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    total = np.zeros(n + 1, np.uint32)
    np.cumsum(mixed * np.uint32(0x85EBCA77), dtype=np.uint32, out=total[1:])
    rolled = (total[WINDOW:] - total[:-WINDOW]) * np.uint32(0xC2B2AE3D)
    hits = np.flatnonzero(rolled >> np.uint32(32 - MASK_BITS) == 0) + WINDOW
    ends, last = [], 0
    for h in [*hits.tolist(), n]:
        while h - last > MOST:
            last += MOST
            while codes[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if h < n and h - last >= LEAST and codes[h] & 0xC0 != 0x80:
            ends.append(h)
            last = h
    if last < n:
        ends.append(n)
    return ends


def _tables(path: str) -> tuple[list[bytes], object]:
    """Bytes of each id, and their lengths; one for each worker and vocabulary. A vocabulary that is not lossless is an error."""
    import numpy as np

    from heronlake.llm.tokens import encoder

    if path not in _TABLES:
        enc = encoder(path)
        if not enc.keeps_spaces:
            raise ValueError("only byte-level BPE that keeps blanks can be cut at any byte")
        back = {c: b for b, c in enc.letters.items()}
        names = [enc.tokenizer.id_to_token(i) or "" for i in range(len(enc.id_bytes))]
        # as the library: a name with any other character stands for its own UTF-8 bytes
        table = [bytes(back[c] for c in name) if all(c in back for c in name) else name.encode() for name in names]
        _TABLES[path] = table, np.array([len(t) for t in table], np.int64)
    return _TABLES[path]


def split_safe(text: str, path: str) -> tuple[str, bytes | None, str]:
    """(head, middle, tail): ``middle`` are the ids between the first and the last safe place, final in any context.

    Without a safe place, or where the ids do not end at it, all of the text is the head and the middle is None.
    """
    import numpy as np

    from heronlake.llm.tokens import encoder

    first = _SAFE.search(text)
    if first is None:
        return text, None, ""
    begin = first.start()
    end = last_safe(text)
    ids = encoder(path).encode([text])[0]
    ends = np.cumsum(_tables(path)[1][np.frombuffer(ids, "<u4")])
    a, b = len(text[:begin].encode()), len(text[:end].encode())
    i, j = int(np.searchsorted(ends, a, "left")), int(np.searchsorted(ends, b, "left"))
    if (i < len(ends) and ends[i] == a or a == 0) and j < len(ends) and ends[j] == b:
        return text[:begin], ids[4 * (i + 1 if a else 0) : 4 * (j + 1)], text[end:]
    return text, None, ""


def last_safe(text: str) -> int:
    """Start of the last safe place; the text must have one. Searched from the end in growing stretches."""
    size = 64
    while True:
        found = list(_SAFE.finditer(text, max(0, len(text) - size)))
        if found:
            return found[-1].start()
        if size > len(text):
            raise ValueError("no safe place")
        size *= 4


def join_parts(parts: list[tuple[str, bytes | None, str]], path: str) -> bytes:
    """Ids of the whole text from its chunks' (head, middle, tail): open ends meet and are encoded as one text."""
    from heronlake.llm.tokens import encoder

    encode, out, pending = encoder(path).encode, [], ""
    for head, middle, tail in parts:
        if middle is None:
            pending += head
            continue
        out += [encode([pending + head])[0], middle]
        pending = tail
    return b"".join([*out, encode([pending])[0]])


def decode_ids(ids: bytes, path: str) -> bytes:
    """UTF-8 of the text of little-endian unsigned 32-bit ids, special tokens included; broken characters become U+FFFD."""
    import numpy as np

    raw = b"".join(map(_tables(path)[0].__getitem__, np.frombuffer(ids, "<u4").tolist()))
    return raw.decode("utf-8", "replace").encode()


def _digest(chunk: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(chunk, digest_size=16).digest()


def _chunks(text: str) -> list[bytes]:
    raw = text.encode()
    ends = cut_points(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """h, n: the places of each chunk by the first 8 bytes of its digest, summed up within the task."""
    import numpy as np

    def summed(hashes: list[bytes]) -> pd.DataFrame:
        h, n = np.unique(np.frombuffer(b"".join(hashes), "<i8"), return_counts=True)
        return pd.DataFrame({"h": h, "n": n.astype("int64")})

    held: list[bytes] = []
    for pdf in batches:
        for text in pdf["text"]:
            if isinstance(text, str):
                held += [_digest(c)[:8] for c in _chunks(text)]
        if len(held) > 1_000_000:
            yield summed(held)
            held = []
    yield summed(held)
    release()


def shared_filter(texts: DataFrame) -> tuple[bytes, int]:
    """(bitmap, number of bits less one) of chunks met in more than one place: all of them, and by chance a few others.

    Spark puts the bytes together; the driver gets at most MOST_FILTER_BITS / 8 of them, however many chunks there are.
    """
    places = texts.mapInPandas(_met, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    places = stage(places, "shared-chunks")
    bits = 1 << 12
    while bits < min(MOST_FILTER_BITS, 16 * places.count()):
        bits *= 2
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    out = bitmap(places.select(slot.alias("slot")), bits)
    unstage(places)
    return out, bits - 1


_ENTRY = "kind string, doc_id string, root binary, seq int, digest binary, head string, middle binary, tail string, n_tokens long, ids_sha256 string, decoded_sha256 string"
_COLUMNS = [c.split()[0] for c in _ENTRY.split(", ")]


def _hashes(ids: bytes, path: str) -> tuple[int, str, str]:
    import hashlib

    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decode_ids(ids, path)).hexdigest()


def _narrow(ids: bytes | None, path: str) -> bytes | None:
    """Ids as they travel: in 16 bits where the vocabulary allows it."""
    import numpy as np

    return ids if ids is None or len(_tables(path)[0]) > 65536 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes | None, path: str) -> bytes | None:
    import numpy as np

    return ids if ids is None or len(_tables(path)[0]) > 65536 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _entries(path: str, shared):
    """Per document: its result where it shares no chunk, else its recipe; and each shared chunk that the task first meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        from heronlake.llm.tokens import encoder

        bitmap, mask = shared.value
        words, enc, seen = np.frombuffer(bitmap, "<u4"), encoder(path), set()
        for pdf in batches:
            rows: list[dict] = []
            held = 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                text = text if isinstance(text, str) else ""
                chunks = _chunks(text)
                digests = [_digest(c) for c in chunks]
                h = np.frombuffer(b"".join(d[:8] for d in digests), "<i8")
                travels = ((words[(h & mask) >> 5] >> (h & 31).astype("<u4")) & 1).astype(bool)
                if not travels.any():
                    rows.append({"kind": "done", "doc_id": doc_id} | dict(zip(_COLUMNS[-3:], _hashes(enc.encode([text])[0], path))))
                else:
                    root = _digest(b"".join(digests))
                    rows.append({"kind": "open", "doc_id": doc_id, "root": root})
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    if root not in seen:
                        seen.add(root)
                        edges = [0, *(np.flatnonzero(np.diff(travels)) + 1).tolist(), len(chunks)]
                        for a, b in zip(edges, edges[1:]):
                            if not travels[a]:  # a stretch of chunks of its own is one text
                                head, middle, tail = split_safe(b"".join(chunks[a:b]).decode(), path)
                                rows.append({"kind": "part", "root": root, "seq": a, "head": head, "middle": _narrow(middle, path), "tail": tail})
                                continue
                            for k in range(a, b):
                                rows.append({"kind": "part", "root": root, "seq": k, "digest": digests[k]})
                                if digests[k] not in seen:
                                    seen.add(digests[k])
                                    rows.append({"kind": "chunk", "digest": digests[k], "head": chunks[k].decode()})
                held += len(text)
                if held > 2_000_000:
                    yield _frame(rows)
                    rows, held = [], 0
            if rows:
                yield _frame(rows)
        release()

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object).astype({"seq": "Int32", "n_tokens": "Int64"})


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256, for every row of ``docs``.

    Null text counts as empty and has no tokens. Rows that repeat a doc_id, or have none, stay rows; equal texts are put
    together once. A very long text is only more chunks, whose ids meet in one row. Other columns, whatever their names,
    are ignored. Empty in, empty out. Reads ``docs`` twice; the pieces between lie in the shared folder.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(shared_filter(texts.select("text")))  # of bounded size
    path = fresh_path(spark, "bpe-entries")
    texts.mapInPandas(_entries(tokenizer, shared), _ENTRY).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    entries = spark.read.schema(_ENTRY).parquet(path)
    part = "root binary, seq int, head string, middle binary, tail string"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            split = [split_safe(t, tokenizer) for t in pdf["text"]]
            yield pd.DataFrame({"digest": pdf["digest"], "head": [s[0] for s in split], "middle": [_narrow(s[1], tokenizer) for s in split], "tail": [s[2] for s in split]})
        release()

    def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for root, parts in zip(pdf["root"], pdf["parts"]):
                once = {p["seq"]: p for p in parts}.values()
                ids = join_parts([(p["head"], _wide(p["middle"], tokenizer), p["tail"]) for p in once], tokenizer)
                rows.append((root, *_hashes(ids, tokenizer)))
            yield pd.DataFrame(rows, columns=["root", *_COLUMNS[-3:]])
        release()

    chunks = entries.where("kind = 'chunk'").groupBy("digest").agg(F.first("head").alias("text"))
    coded = chunks.mapInPandas(encode, "digest binary, head string, middle binary, tail string")
    listed = entries.where("kind = 'part'").select("root", "seq", "digest", "head", "middle", "tail")
    own = listed.where("digest IS NULL").drop("digest")  # the same from each task that met the root
    other = listed.where("digest IS NOT NULL").select("root", "seq", "digest").distinct().join(coded, "digest")
    whole = own.unionByName(other.select(own.columns)).groupBy("root").agg(F.array_sort(F.collect_set(F.struct("seq", "head", "middle", "tail"))).alias("parts"))
    sums = whole.mapInPandas(put_together, "root binary, n_tokens long, ids_sha256 string, decoded_sha256 string")
    done = entries.where("kind = 'done'").select("doc_id", *_COLUMNS[-3:])
    opened = entries.where("kind = 'open'").select("doc_id", "root").join(sums, "root").drop("root")
    return done.unionByName(opened).withColumn("doc_id", F.col("doc_id").cast("long"))
