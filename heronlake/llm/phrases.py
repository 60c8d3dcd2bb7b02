"""Phrases of two and three words that stand together more often than their parts would, for each language.

Phrases grow from prefixes. A longer phrase is never more frequent than a part of it, so the counts of prefixes and
suffixes bound what growth can reach: from ``w1 w2`` no score above ``f(w1 w2) / f(w1)``, into ``w2 w3`` none above
``f(w2 w3) / f(w3)``. The frontier is opened from the best bound down: each round lowers every open language's bar, grows
only what can reach the bar (or could displace a pair that does), and scores it exactly. A language is settled when as many
surviving phrases as asked for reach its bar: whatever is still closed scores less, ties included. At bar 0 all is open.

Tasks count within blocks of words and Spark adds the blocks up. What may grow is told to the tasks by filters of hashes
of bounded size, which let a few others through; exact counts leave those out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.shared import bitmap, release, stage, unstage

LEAST_COUNT, LEAST_COVER, TOP, SCALE = 10, 50, 2000, 1_000_000
#: Words a task holds before it counts them; bits of a filter for each key, and at most (8 MB).
BLOCK_WORDS, KEY_BITS, MOST_FILTER_BITS = 2_000_000, 16, 1 << 26
#: Candidates of two words that reach the first bar, in multiples of TOP; each round has this many times more.
FIRST, WIDER = 2, 8
_BREAK = 0xFF  # no byte of UTF-8
_MARKS = bytes(_BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def word_hash(lang: str, word: str) -> Column:
    return F.xxhash64(F.col(lang), F.col(word))


def chained(left: Column, right: Column) -> Column:
    """Hash of a sequence from the hash of its front and that of its last word; ``_Block`` has the same with numpy."""
    return left.bitwiseXOR(F.shiftleft(right, 23).bitwiseOR(F.shiftrightunsigned(right, 41)))


def key_filter(hashes: DataFrame) -> bytes:
    """A Bloom filter of the distinct column ``h`` with two probes. Spark ORs and packs the bits; the driver gets MOST_FILTER_BITS / 8 bytes at most."""
    bits = 1 << 12
    count = hashes.count()
    while bits < min(MOST_FILTER_BITS, KEY_BITS * count):
        bits *= 2
    slots = [F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))]
    probes = hashes.select(F.explode(F.array(*slots)).alias("slot"))
    return bitmap(probes, bits)


class Filter:
    def __init__(self, raw: bytes):
        import numpy as np

        self.words = np.frombuffer(raw, "<u4")
        self.mask = np.uint64(32 * len(self.words) - 1)

    def __call__(self, hashes):
        import numpy as np

        found = np.ones(len(hashes), bool)
        for slot in (hashes & self.mask, (hashes >> np.uint64(32)) & self.mask):
            found &= ((self.words[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype("<u4")) & 1).astype(bool)
        return found


class _Block:
    """Words of many texts as numbers; 0 is a break between pieces. Languages have numbers of their own."""

    def __init__(self):
        self.words: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self.hashes: list[int] = [0]
        self.known: dict[str, dict[bytes, int]] = {}
        self.texts: list = []
        self.held = 0

    def add(self, lang: str, text: str) -> None:
        import numpy as np
        import xxhash

        words = text.encode().lower().translate(_MARKS).replace(b"\xff", b" \xff ").split()
        if lang not in self.known:
            block, seed = self, xxhash.xxh64_intdigest(lang.encode(), seed=42)

            class Numbers(dict):
                def __missing__(self, word):
                    number = self[word] = len(block.words)
                    block.words.append(word)
                    block.langs.append(lang)
                    block.hashes.append(xxhash.xxh64_intdigest(word, seed=seed))
                    return number

            self.known[lang] = Numbers({b"\xff": 0})
        self.texts.append(np.fromiter(map(self.known[lang].__getitem__, chain(words, (b"\xff",))), np.int32, len(words) + 1))
        self.held += len(words) + 1

    def numbers(self):
        import numpy as np

        numbers = np.concatenate(self.texts) if self.texts else np.zeros(0, np.int32)
        self.texts = []
        return numbers, np.array(self.hashes, np.uint64)


def _turned(h):
    import numpy as np

    return (h << np.uint64(23)) | (h >> np.uint64(41))


def _grams(block: _Block, size: int, may):
    """(number of the words, count) of the phrases of ``size`` words that ``may`` lets through, as columns of numbers and counts.

    ``may`` is given the hashes of words (size 1 and 2) or of pairs, and answers for each.
    """
    import numpy as np

    numbers, hashes = block.numbers()
    if size == 1:
        counts = np.bincount(numbers, minlength=len(block.words))
        counts[0] = 0
        own = np.flatnonzero(counts)
        return (own,), counts[own], hashes[own]
    wide = np.int64(len(block.words))
    if size == 2:
        numbers = np.where(may["word"](hashes)[numbers], numbers, 0)  # words too rare for any phrase
        left, right = numbers[:-1], numbers[1:]
        both = (left != 0) & (right != 0)
        pairs, counts = np.unique(left[both] * wide + right[both], return_counts=True)  # ``wide`` makes it 64 bits
        left, right = pairs // wide, pairs % wide
        h = hashes[left] ^ _turned(hashes[right])
        if "pair" in may:
            kept = may["pair"](h)
            left, right, counts, h = left[kept], right[kept], counts[kept], h[kept]
        return (left, right), counts, h
    left, right = numbers[:-1], numbers[1:]
    both = np.flatnonzero((left != 0) & (right != 0))
    pairs, place = np.unique(left[both] * wide + right[both], return_inverse=True)
    h = hashes[pairs // wide] ^ _turned(hashes[pairs % wide])
    flags = np.full(len(numbers), -1, np.int32)  # of the pair that begins at each word
    flags[both] = place
    known, front, back, near = (may[k](h) for k in ("pair", "front", "back", "near"))
    first, second = flags[:-1], flags[1:]
    real = np.flatnonzero((first >= 0) & (second >= 0))
    first, second = first[real], second[real]
    opened = known[first] & known[second] & ((front[first] & back[second]) | near[first] | near[second])
    first, second = first[opened], second[opened]
    triples, counts = np.unique(first * np.int64(len(pairs)) + second, return_counts=True)
    first, second = triples // np.int64(max(1, len(pairs))), triples % np.int64(max(1, len(pairs)))
    return (pairs[first] // wide, pairs[first] % wide, pairs[second] % wide), counts, None


def counted(texts: DataFrame, size: int, filters: dict | None = None, hashed: bool = False) -> DataFrame:
    """lang, w1 .. w``size``, n: occurrences in ``texts`` (lang, text), added up for each phrase; or h, n with ``hashed``.

    Equal sums whatever the blocks; ``filters`` has broadcast filters by name.
    """
    names = [f"w{k + 1}" for k in range(size)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        may = {k: Filter(v.value) for k, v in (filters or {}).items()}

        def table(block: _Block):
            columns, counts, h = _grams(block, size, may)
            if hashed:
                return pa.RecordBatch.from_arrays([pa.array(h.astype("int64")), pa.array(counts, pa.int64())], ["h", "n"])
            words, langs = pa.array(block.words, pa.binary()).cast(pa.string()), pa.array(block.langs, pa.string())
            arrays = [langs.take(pa.array(columns[0])), *[words.take(pa.array(c)) for c in columns], pa.array(counts, pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["lang", *names, "n"])

        def sliced(batch) -> Iterator:
            for at in range(0, batch.num_rows, 100_000):
                yield batch.slice(at, 100_000)

        block = _Block()
        for batch in batches:
            for part in (batch.slice(at, 200) for at in range(0, batch.num_rows, 200)):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    block.add(lang, text)
                if block.held >= BLOCK_WORDS:
                    yield from sliced(table(block))
                    block = _Block()
        yield from sliced(table(block))
        del block
        release()

    schema = "h long, n long" if hashed else "lang string, " + ", ".join(f"{w} string" for w in names) + ", n long"
    keys = ["h"] if hashed else ["lang", *names]
    return texts.mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE a a / (l r)), exact: at most 38 digits while counts stay below 10^15."""
    big = lambda c: F.col(c).cast("decimal(18,0)")
    return F.call_function("div", big(a) * big(a) * F.lit(SCALE).cast("decimal(7,0)"), big(left) * big(right)).cast("long")


def _pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """lang, w1, w2, a, l, r, score: pairs (lang, w1, w2, a) with the counts of their words."""
    first = words.select("lang", F.col("w1"), F.col("n").alias("l"))
    second = words.select("lang", F.col("w1").alias("w2"), F.col("n").alias("r"))
    return pairs.join(first, ["lang", "w1"]).join(second, ["lang", "w2"]).select("lang", "w1", "w2", "a", "l", "r", _score("a", "l", "r").alias("score"))


def _triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, w1, w2, w3, a, l, r, score of the lowest-scoring cut, of equal ones the first."""
    front = pairs.select("lang", "w1", "w2", F.col("a").alias("l2"), F.col("l").alias("l1"))
    back = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    both = triples.join(front, ["lang", "w1", "w2"]).join(back, ["lang", "w2", "w3"])
    both = both.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return both.select("lang", "w1", "w2", "w3", "a", pick("l1", "l2").alias("l"), pick("r1", "r2").alias("r"), F.least("s1", "s2").alias("score"))


def _bars(scored: DataFrame, most: int) -> DataFrame:
    """lang, bar: the score that ``most`` candidates of two words reach, 0 where a language has fewer. One row a language."""
    at = scored.groupBy("lang", "score").agg(F.count("*").alias("n"))
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    reach = at.withColumn("reach", F.sum("n").over(down)).where(F.col("reach") >= most)
    return scored.select("lang").distinct().join(reach.groupBy("lang").agg(F.max("score").alias("bar")), "lang", "left").select("lang", F.coalesce("bar", F.lit(0)).alias("bar"))


def mine(docs: DataFrame, top: int = TOP, least: int = LEAST_COUNT, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, words, a, l, r, n, score: each language's first ``top`` phrases.

    Null lang is ``und`` and counts with rows that say so; null and empty texts have no words. Every row counts, repeated
    rows and ids too; doc_id and other columns are ignored. A very long text is cut into words like any other. Phrases of
    equal score and count rank in byte order. Empty in, or no candidate: no rows.
    """
    spark = docs.sparkSession
    share = lambda df: spark.sparkContext.broadcast(key_filter(df))  # noqa: E731  of bounded size
    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = stage(counted(texts, 1), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    words = words.where(F.col("n") >= least)
    may = {"word": share(words.select(word_hash("lang", "w1").alias("h")))}
    frequent = stage(counted(texts, 2, may, hashed=True).where(F.col("n") >= least).select("h"), "frequent")
    may["pair"] = share(frequent)
    unstage(frequent)
    pairs = counted(texts, 2, may).where(F.col("n") >= least).withColumnRenamed("n", "a")
    pairs = stage(_pairs(pairs, words).withColumn("h", chained(word_hash("lang", "w1"), word_hash("lang", "w2"))), "pairs")
    done, opened, width = None, pairs.select("lang").distinct(), first
    while True:
        bars = stage(_bars(pairs.join(opened, "lang", "left_semi"), width * top), "bars")
        reach = pairs.join(bars, "lang")
        grows = lambda part: (F.col("a").cast("decimal(20,0)") * SCALE) >= F.col("bar").cast("decimal(20,0)") * F.col(part)
        may |= {"front": share(reach.where(grows("l")).select("h")), "back": share(reach.where(grows("r")).select("h")), "near": share(reach.where(F.col("score") >= F.col("bar")).select("h"))}
        # languages that are settled have no key in the filters
        triples = counted(texts.join(opened, "lang", "left_semi"), 3, may).where(F.col("n") >= least).withColumnRenamed("n", "a")
        triples = stage(triples, "triples")
        covers = triples.select("lang", F.explode(F.array(F.struct(F.col("w1"), F.col("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
        covers = covers.groupBy("lang", F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.max("a").alias("most"))
        standing = reach.where(F.col("score") >= F.col("bar")).join(covers, ["lang", "w1", "w2"], "left").where(F.coalesce(100 * F.col("most") < LEAST_COVER * F.col("a"), F.lit(True)))
        phrase = lambda n: [F.concat_ws(" ", *[f"w{k + 1}" for k in range(n)]).alias("phrase"), F.lit(n).alias("words"), "a", "l", "r", "score"]
        found = standing.select("lang", *phrase(2)).unionByName(_triples(triples, pairs).join(bars, "lang").where(F.col("score") >= F.col("bar")).select("lang", *phrase(3)))
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = stage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "found")
        full = found.groupBy("lang").agg((F.max("rank") >= top).alias("full"))
        settled = stage(bars.join(full, "lang", "left").select("lang", (F.coalesce("full", F.lit(False)) | (F.col("bar") <= 0)).alias("settled")), "settled")
        keep = found.join(settled.where("settled"), "lang", "left_semi")
        done = keep if done is None else done.unionByName(keep)
        opened, width = settled.where("NOT settled").select("lang"), width * WIDER
        if opened.isEmpty():
            return done.join(totals.withColumnRenamed("total", "n"), "lang").withColumn("rank", F.col("rank").cast("long"))
