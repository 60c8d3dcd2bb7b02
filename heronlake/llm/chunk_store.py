"""Content-addressed store of token ids.

A rolling hash over the ids cuts each document's stream into chunks. A chunk is named by the SHA-256 of its bytes
and stored once; a recipe lists a document's chunks; the Merkle root over the list names the recipe, so copies share
one. A chunk lies beside the place (root, seq) where it was met first; so reading joins only the chunks that other places
use too, and everything else goes to its sequence in one shuffle. Both hashes are checked.

Files under the store's path: ``chunks`` (digest, root, seq, ids, by shared or not), ``recipes`` (root, seq, digest),
``documents`` (doc_id, start, n_tokens, root; range-partitioned and sorted by doc_id) and ``manifest`` (one row: width of
an id in bytes, counts, and the root over BUCKETS sums of document rows, so that a lost or changed file is noticed).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm.shared import fresh_path, release, remove, running_start

WINDOW, MASK_BITS, LEAST, MOST = 8, 10, 256, 8192  # ids
#: Digests that a task remembers.
MOST_SEEN = 500_000
#: Parts of the documents table that the manifest sums up.
BUCKETS = 256


def cut_points(ids) -> list[int]:
    """Ends of the content-defined chunks of an id array: where a hash of the last WINDOW ids has MASK_BITS zero bits."""
    import numpy as np

    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    rolled = (total[WINDOW:] - total[:-WINDOW]) * np.uint64(0xBF58476D1CE4E5B9)
    hits = (np.flatnonzero(rolled >> np.uint64(64 - MASK_BITS) == 0) + WINDOW).tolist()
    ends, last = [], 0
    for h in hits:
        while h - last > MOST:
            last += MOST
            ends.append(last)
        if h - last >= LEAST:
            ends.append(h)
            last = h
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def merkle_root(digests: list[bytes]) -> bytes:
    """SHA-256 tree over chunk digests; leaves and inner nodes are told apart by a first byte."""
    import hashlib

    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def _width(enc, end_id: int) -> int:
    return 2 if max(enc.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 65536 else 4


def _entries(tokenizer: str, end_id: int):
    """Per task: a document row each, and its chunks and recipes where the task meets them first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import numpy as np

        from heronlake.llm.tokens import encoder, groups_of

        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        kind = f"<u{_width(enc, end_id)}"
        seen: set[bytes] = set()
        for pdf in batches:
            doc_ids, texts = pdf["doc_id"].tolist(), [t if isinstance(t, str) else "" for t in pdf["text"].tolist()]
            for part in groups_of(texts):
                rows = []
                for doc_id, data in zip(doc_ids[part], enc.encode(texts[part])):
                    ids = np.frombuffer(data + end, dtype="<u4")
                    stored = ids.astype(kind)
                    chunks, last = [], 0
                    for at in cut_points(ids):
                        chunk = stored[last:at].tobytes()
                        chunks.append((hashlib.sha256(chunk).digest(), chunk))
                        last = at
                    root = merkle_root([d for d, _ in chunks])
                    rows.append(("document", doc_id, len(ids), root, None, None, None))
                    if root in seen:
                        continue
                    if len(seen) > MOST_SEEN:
                        seen.clear()  # what is then sent again is dropped where chunks meet
                    seen.add(root)
                    for k, (d, chunk) in enumerate(chunks):
                        rows.append(("recipe", None, None, root, k, d, None))
                        if d not in seen:
                            seen.add(d)
                            rows.append(("chunk", None, None, root, k, d, chunk))
                out = pd.DataFrame(rows, columns=["kind", "doc_id", "n_tokens", "root", "seq", "digest", "ids"])
                yield out.astype({"doc_id": object, "n_tokens": "Int64", "seq": "Int32"})
        release()

    return run


_ENTRY = "kind string, doc_id long, n_tokens long, root binary, seq int, digest binary, ids binary"


def _summed(documents: DataFrame) -> tuple[int, int, bytes]:
    """Rows, tokens, and the Merkle root over BUCKETS sums of row digests. Its bucket rows are a fixed number."""
    import hashlib

    digest = F.sha2(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "start", "n_tokens", F.hex("root")), 256)
    # four sums of 60 bits each: rows may repeat, so digests are added, not XOR-ed
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(4)]
    bucket = F.pmod(F.xxhash64("doc_id", "root"), F.lit(BUCKETS)).alias("bucket")
    rows = sorted(documents.groupBy(bucket).agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"), *parts).collect())
    return sum(r["rows"] for r in rows), sum(r["tokens"] for r in rows), merkle_root([hashlib.sha256(repr(tuple(r)).encode()).digest() for r in rows])


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> str:
    """Encode whole texts and write the store; returns its path.

    Null text counts as empty and has the end id alone. Rows that repeat a doc_id, or lack one, stay rows of
    ``documents``, in order of doc_id and then of content, null ids first; copies share a recipe. Very long texts are
    encoded whole and become many chunks. An empty table gives a store without rows; other columns are ignored.
    """
    from heronlake.llm.tokens import encoder

    spark = docs.sparkSession
    path = path or fresh_path(spark, "chunk-store")
    loose = fresh_path(spark, "loose")
    # ids travel as strings: beside a null, pandas would turn them to floating point
    source = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = source.mapInPandas(_entries(tokenizer, end_id), _ENTRY.replace("doc_id long", "doc_id string"))
    met.withColumn("doc_id", F.col("doc_id").cast("long")).write.partitionBy("kind").option("compression", "zstd").parquet(loose)
    entries = spark.read.schema(_ENTRY).parquet(loose)
    recipes = entries.where("kind = 'recipe'").select("root", "seq", "digest").distinct()
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    recipes = spark.read.schema(recipes.schema).parquet(f"{path}/recipes")
    uses = recipes.groupBy("digest").agg((F.count("*") > 1).alias("shared"))
    chunks = entries.where("kind = 'chunk'").groupBy("digest").agg(F.first(F.struct("root", "seq", "ids")).alias("own"))
    chunks = chunks.join(uses, "digest").select("digest", "own.root", "own.seq", "own.ids", "shared")
    chunks.write.partitionBy("shared").option("compression", "zstd").parquet(f"{path}/chunks")
    documents = running_start(entries.where("kind = 'document'").select("doc_id", "n_tokens", "root"), ["doc_id", "root"], "n_tokens", "start")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    documents = documents.select("doc_id", "start", "n_tokens", "root").repartitionByRange(parts, "doc_id", "root")
    documents.sortWithinPartitions("doc_id", "root").write.parquet(f"{path}/documents")
    rows, tokens, root = _summed(spark.read.schema(_DOCUMENT).parquet(f"{path}/documents"))
    spark.createDataFrame([(_width(encoder(tokenizer), end_id), rows, tokens, bytearray(root))], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    remove(spark, loose)
    return path


_DOCUMENT = "doc_id long, start long, n_tokens long, root binary"
_MANIFEST = "width int, documents long, tokens long, root binary"
_CHUNK = "digest binary, root binary, seq int, ids binary, shared boolean"


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """root, ids (little-endian unsigned 32-bit), n_tokens: each distinct sequence, put together and verified.

    A chunk that does not match its digest, or a recipe that does not match its root for want of a chunk, is an error (a
    sequence that lost all its chunks has no row, which ``read_documents`` notices). The width of stored ids comes from
    the manifest.
    """
    kind = f"<u{spark.read.schema(_MANIFEST).parquet(f'{path}/manifest').first()['width']}"
    recipes = spark.read.schema("root binary, seq int, digest binary").parquet(f"{path}/recipes")
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/chunks")
    part = F.struct("seq", "digest", "ids").alias("part")
    used = recipes.alias("r").join(chunks.where("shared").alias("c"), "digest").where("NOT (r.root = c.root AND r.seq = c.seq)")
    parts = chunks.select("root", part).unionByName(used.select(F.col("r.root").alias("root"), F.struct(F.col("r.seq").alias("seq"), F.col("digest"), F.col("c.ids").alias("ids")).alias("part")))
    parts = parts.groupBy("root").agg(F.array_sort(F.collect_list("part")).alias("parts"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import numpy as np

        for pdf in batches:
            out = []
            for root, own in zip(pdf["root"], pdf["parts"]):
                bodies = [bytes(p["ids"]) for p in own]
                digests = [hashlib.sha256(b).digest() for b in bodies]
                if any(d != bytes(p["digest"]) for d, p in zip(digests, own)):
                    raise ValueError("chunk does not match its digest")
                if merkle_root(digests) != bytes(root):
                    raise ValueError("recipe does not match its Merkle root")
                ids = np.frombuffer(b"".join(bodies), dtype=kind).astype("<u4")
                out.append((root, ids.tobytes(), len(ids)))
            yield pd.DataFrame(out, columns=["root", "ids", "n_tokens"])
        release()

    return parts.mapInPandas(join, "root binary, ids binary, n_tokens long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the store's files.

    A documents table that does not match the manifest, or a sequence that is not as long as its document says, is an
    error. An empty store has no rows.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").first()
    documents = spark.read.schema(_DOCUMENT).parquet(f"{path}/documents")
    if _summed(documents) != (manifest["documents"], manifest["tokens"], bytes(manifest["root"])):
        raise ValueError("documents do not match the manifest")
    sums = read_sequences(spark, path).select("root", F.col("n_tokens").alias("found"), F.crc32("ids").alias("ids_crc32"))
    same = F.when(F.col("found").eqNullSafe(F.col("n_tokens")), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document is not as long as it was")))
    return documents.join(sums, "root", "left").select("doc_id", "start", same.cast("long").alias("n_tokens"), "ids_crc32")
