"""Language identification by a bit-sliced Bloom filter over character n-grams.

Each filter position holds one bit per language. Looking an n-gram up at all hash positions and AND-ing what lies there
returns every language that contains it. A text's hits are counted per language bit, corrected for that language's
false-positive rate, and the largest corrected share decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.shared import free_name, release, stage
from heronlake.llm.tokens import groups_of

ORDERS = (1, 2, 3, 4)
HASHES = 3
#: Bits of a hash that name a filter position, so positions at most 1 << BITS; HASHES of them lie side by side in a hash.
BITS = 21
#: Labelled rows per language that the filter is fitted on, about; an n-gram is a language's from this share of its best rate.
FIT_ROWS, LEAST_SHARE = 2_000, 0.2
MOST_LANGUAGES = 63
UNKNOWN = "und"


def _number_signs() -> str:
    r"""Ranges of the characters that \w takes and \d does not, yet are no letters, such as a superscript two."""
    out, first = [], None
    for code in range(0x80, 0x110001):
        c = chr(code) if code < 0x110000 else "a"
        if c.isalnum() and not c.isalpha() and not c.isdecimal():
            first = code if first is None else first
        elif first is not None:
            out.append(f"{chr(first)}-{chr(code - 1)}")
            first = None
    return "".join(out)


_WORD = re.compile(rf"[^\W\d_{_number_signs()}]+")


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word index) of every n-gram of the words, each word set between blanks."""
    codes = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    blank = codes == 32
    word = np.cumsum(blank) - 1
    hashes, owners = [], []
    for n in ORDERS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        h = np.full(size, 0xCBF29CE484222325 + n, dtype=np.uint64)
        ok = ~(blank[:size] & (word[:size] == len(words)))
        for k in range(n):
            h = (h ^ codes[k : k + size]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(31)
            if n == 1 or 0 < k < n - 1:
                ok &= ~blank[k : k + size]
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        hashes.append(h[ok])
        owners.append(word[:size][ok])
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class BitmaskFilter:
    """``masks[p]`` holds a bit for each of ``languages``; ``false_rate`` is each language's false-positive rate."""

    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The bitmask of languages that contain each n-gram (or seem to)."""
        at, out = np.uint64(len(self.masks) - 1), None
        for k in range(HASHES):
            m = self.masks[((hashes >> np.uint64(BITS * k)) & at).astype(np.int64)]
            out = m if out is None else out & m
        return out

    def word_hits(self, words: list[str]) -> np.ndarray:
        """A row per word: hits per language, then the number of n-grams."""
        hashes, owner = gram_hashes(words)
        found, n = self.lookup(hashes), len(words)
        cols = [np.bincount(owner[(found >> self.masks.dtype.type(b)) & self.masks.dtype.type(1) == 1], minlength=n) for b in range(len(self.languages))]
        return np.stack([*cols, np.bincount(owner, minlength=n)], axis=1)

    def corrected(self, hits: np.ndarray) -> np.ndarray:
        """Shares of n-grams truly contained, from rows of word_hits sums."""
        total = np.maximum(hits[:, -1:], 1)
        return np.clip((hits[:, :-1] - total * self.false_rate) / (1 - self.false_rate) / total, 0.0, 1.0)


def positions(n_grams: int) -> int:
    """Positions of a filter: about ten for each n-gram of a language, a power of two."""
    return 1 << min(BITS, max(10, int(np.ceil(np.log2(10 * max(1, n_grams))))))


def as_filter(languages: list[str], masks: np.ndarray) -> BitmaskFilter:
    """A filter of these masks, in the narrowest type; false-positive rates follow from each language's share of set bits."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= len(languages))
    masks = masks.astype(kind)
    fill = np.array([np.count_nonzero(masks & kind(1 << b)) / len(masks) for b in range(len(languages))])
    return BitmaskFilter(languages, masks, np.minimum(fill**HASHES, 0.95))


def build_filter(grams: dict[str, np.ndarray]) -> BitmaskFilter:
    """A filter over each language's n-gram hashes, where they are at hand."""
    names = sorted(grams)
    masks = np.zeros(positions(sum(map(len, grams.values()))), dtype=np.uint64)
    for b, name in enumerate(names):
        for k in range(HASHES):
            masks[((grams[name].astype(np.uint64) >> np.uint64(BITS * k)) & np.uint64(len(masks) - 1)).astype(np.int64)] |= np.uint64(1 << b)
    return as_filter(names, masks)


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> BitmaskFilter:
    """Fit on (text, lang); null texts and languages are left out, other columns ignored. Empty in, a filter of no language.

    About ``rows`` whole texts of each language are read, chosen by a hash of the text, and every n-gram of theirs counts:
    one is a language's if its rate there is at least LEAST_SHARE of its best rate anywhere. The masks are put together by
    Spark, so the driver gets at most 1 << BITS numbers, however many n-grams there are.
    """
    labelled = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return BitmaskFilter([], np.zeros(1024, np.uint8), np.zeros(0))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, rows / n))) for k, n in sizes.items()])
    chosen = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                words: dict[str, int] = {}
                for t in texts:
                    for w in _WORD.findall(t.lower()):
                        words[w] = words.get(w, 0) + 1
                if words:
                    h, owner = gram_hashes(list(words))
                    keys, at = np.unique(h, return_inverse=True)
                    n = np.bincount(at, weights=np.fromiter(words.values(), float)[owner])
                    yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n.astype(np.int64)})

    counted = chosen.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language, at most MOST_LANGUAGES
    rated = counted.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("total"))
    names = sorted(sizes)
    bit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(1 << b)) for b, k in enumerate(names)]).cast("long")
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("rate", bit.alias("bit"))).alias("at"))
    owners = F.aggregate("at", F.lit(0).cast("long"), lambda acc, x: F.when(x["rate"] >= LEAST_SHARE * F.col("best"), acc.bitwiseOR(x["bit"])).otherwise(acc))
    own = stage(best.select("gram", owners.alias("mask")), "language-grams")
    size = positions(own.agg(F.sum(F.bit_count("mask"))).first()[0] or 0)
    places = F.explode(F.array(*[F.shiftrightunsigned("gram", BITS * k).bitwiseAND(F.lit(size - 1)) for k in range(HASHES)]))
    got = own.select(places.alias("place"), "mask").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    masks = np.zeros(size, dtype=np.uint64)
    masks[got["place"].to_numpy()] = got["mask"].to_numpy().astype(np.uint64)
    return as_filter(names, masks)


def predict(docs: DataFrame, model: BitmaskFilter) -> DataFrame:
    """``docs`` with lang_pred and score added (columns of these names are replaced); rows are independent, no shuffle.

    Null text or text without a letter gives ``und`` with score 0; otherwise always a learned language, ties going to
    the first by name. Very long texts are read whole. Repeated rows each get a row; empty in, empty out.
    """

    @F.pandas_udf("struct<lang_pred string, score double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        at: dict[str, int] = {}
        hits = np.zeros((0, len(model.languages) + 1), dtype=np.int64)
        for series in batches:
            texts, out = [t if isinstance(t, str) else "" for t in series.tolist()], []
            for part in groups_of(texts, 2_000_000):
                words = [_WORD.findall(t.lower()) for t in texts[part]]
                if len(at) > 300_000:
                    at, hits = {}, hits[:0]
                new = list({w for ws in words for w in ws if w not in at})
                if new:
                    at.update(zip(new, range(len(at), len(at) + len(new))))
                    hits = np.concatenate([hits, model.word_hits(new)])
                for ws in words:
                    if not ws or not model.languages:
                        out.append((UNKNOWN, 0.0))
                        continue
                    sums = hits[np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))].sum(axis=0, keepdims=True)
                    shares = model.corrected(sums)[0]
                    best = int(np.argmax(shares))
                    out.append((model.languages[best], float(shares[best])))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])
        release()

    name = free_name(docs, "_made")
    # else a filter on what it gives would have Spark run it once for the filter and once for the columns
    made = docs.withColumn(name, run.asNondeterministic()(F.col("text").cast("string")))
    return made.withColumn("lang_pred", F.col(f"{name}.lang_pred")).withColumn("score", F.col(f"{name}.score")).drop(name)


def remainder(col) -> "F.Column":
    """crc32 of an id as text, modulo 4; 2 marks the held-out rows."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(4))
