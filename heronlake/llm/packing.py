"""Best-fit packing of token sequences by large-item matching.

Only the histogram of piece lengths (at most ``capacity`` rows) is planned on the driver. Lengths above a third
of the capacity meet at most twice in a bin, by greedy matching; shorter ones best-fit the gaps, longest first.
Spark ranks the pieces of each length in salted groups and joins them to the planned rank intervals.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.shared import free_name

CAPACITY = 2048
#: Pieces of one length and salt that meet in one window group, about.
GROUP_ROWS = 20_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): token ids of each whole text and the end id, cut to pieces.

    A null text counts as empty and gives the end id alone. Longer documents are cut so that the first piece
    takes the remainder. Repeated rows and null doc_ids give pieces like any other row; other columns are ignored.
    ``keep_words`` leaves encoded words to the worker's next task; without it each task ends with empty caches.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        from heronlake.llm.shared import release
        from heronlake.llm.tokens import encoder, groups_of

        enc, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), [t if isinstance(t, str) else "" for t in pdf["text"].tolist()]
            for part in groups_of(texts):
                rows = []
                for doc_id, data in zip(ids[part], enc.encode(texts[part])):
                    data += end
                    n = len(data) // 4
                    at, k = 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        own = data[4 * at : 4 * (at + size)]
                        rows.append((doc_id, k, at, size, zlib.crc32(own)) + ((own,) if with_ids else ()))
                        at, k, size = at + size, k + 1, capacity
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids).astype({"doc_id": object})
                yield out
        if not keep_words:
            enc.forget()
        release()

    # ids travel as strings: beside a null, pandas would turn them to floating point
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(cut, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) intervals that place every piece once.

    Work and result depend on the number of distinct lengths, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("piece lengths must lie in 1..capacity")
    used: dict[int, int] = dict.fromkeys(left, 0)
    gaps: list[int] = []  # sorted distinct gaps that have bins
    bins: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}  # gap -> [(bins, [(length, offset, first rank)])]

    def take(length: int, n: int) -> int:
        at = used[length]
        used[length] += n
        left[length] -= n
        return at

    def put(gap: int, n: int, slots: list[tuple[int, int, int]]) -> None:
        if gap not in bins:
            bins[gap] = []
            bisect.insort(gaps, gap)
        bins[gap].append((n, slots))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            fits = [b for b in large[: bisect.bisect_right(large, capacity - a)] if left[b] and (b != a or left[a] > 1)]
            if not fits:
                n = left[a]
                put(capacity - a, n, [(a, 0, take(a, n))])
            elif (b := fits[-1]) == a:
                n = left[a] // 2
                put(capacity - 2 * a, n, [(a, 0, take(a, n)), (a, a, take(a, n))])
            else:
                n = min(left[a], left[b])
                put(capacity - a - b, n, [(a, 0, take(a, n)), (b, a, take(b, n))])
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            i = bisect.bisect_left(gaps, s)
            if i == len(gaps):
                each = capacity // s
                n, rest = divmod(left[s], each)
                for m, k in ((n, each), (1 if rest else 0, rest)):
                    if m:
                        put(capacity - k * s, m, [(s, j * s, take(s, m)) for j in range(k)])
                continue
            gap = gaps[i]
            m, slots = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[i]
            n = min(m, left[s])
            if n < m:  # the bins beyond n keep this gap; their ranks begin n later
                put(gap, m - n, [(length, offset, first + n) for length, offset, first in slots])
            put(gap - s, n, [*slots, (s, capacity - gap, take(s, n))])
    out, sequence = [], 0
    for gap in gaps:
        for n, slots in bins[gap]:
            out += [(length, first, first + n, sequence, offset) for length, offset, first in slots]
            sequence += n
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...). Empty in, empty out.

    Extra columns, whatever their names, are kept as they are. Null ids sort first; which of two equal rows comes first
    does not matter, as they are of one length. A very long text is pieces like any others.
    """
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    salts = max(1, sum(hist.values()) // GROUP_ROWS)
    rows = plan(hist, capacity)
    by = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    salt, rank, first = (free_name(pieces, n) for n in ("_salt", "_rank", "_first"))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in by]), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", salt, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(first))
    within = Window.partitionBy("length", salt).orderBy(*[F.col(c).asc_nulls_first() for c in by])
    ranked = salted.join(bases, ["length", salt]).withColumn(rank, F.col(first) + F.row_number().over(within) - 1)
    schema = "length long, _first long, _end long, _sequence long, _offset long"
    intervals = F.broadcast(spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], schema))  # bounded by the capacity
    kept = [F.col(f"r.{c}").alias(c) for c in pieces.columns]
    return (
        ranked.alias("r")
        .join(intervals.alias("i"), (F.col("r.length") == F.col("i.length")) & (F.col(f"r.{rank}") >= F.col("i._first")) & (F.col(f"r.{rank}") < F.col("i._end")))
        .select(*kept, (F.col("i._sequence") + F.col(f"r.{rank}") - F.col("i._first")).alias("sequence_id"), F.col("i._offset").alias("offset"))
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_words: bool = True) -> DataFrame:
    """All documents in as few sequences of at most ``capacity`` tokens as the matching finds."""
    from heronlake.llm.shared import stage

    return place(stage(token_pieces(docs, tokenizer, capacity, end_id, keep_words=keep_words), "pieces"), capacity)


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed token ids of each sequence, from rows that carry ``ids`` (token_pieces(with_ids=True))."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed_with_ids.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
