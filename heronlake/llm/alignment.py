"""Alignment of two tokenizers' tokens, scored by how often their ids are linked in the whole corpus.

Each text's tokens of A (byte-level BPE) and B (SentencePiece BPE) are laid over the same bytes; where both end, they are
linked. For each pair of ids, an inverted list keeps the documents that link it as compressed bitmaps: a container for each
65,536 document numbers, a sorted array while it has at most 4,096 of them and a bit for each beyond. Plane 0, 1, 2 ... of
a pair hold the documents whose number of such links has bit 0, 1, 2 ... set. Containers of the same place are merged by OR;
popcounts of the planes' union give document counts, popcounts weighted by 2^plane give link counts. The same postings carry
the pairs' scores back to the documents.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.llm.shared import fresh_path, release, stage
from heronlake.llm.tokens import _ODD_ASCII, _ODD_SPACE

#: Buckets of pairs: the vocabularies bound the pairs of a bucket. Links gathered before a task packs them.
BUCKETS, HELD_LINKS = 64, 2_000_000
#: Documents of a container's range, and the most that it lists one by one.
RANGE, ARRAY_MOST = 1 << 16, 4096
CACHE_SEGMENTS = 400_000
_SEGMENT = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+\Z")
#: The same, cut also between a letter and a mark, where byte-level BPE never merges.
_FINER = re.compile(r"[ \t\n]*[^ \t\n.,;:!?]*[^\W\d_](?=[.,;:!?])|" + _SEGMENT.pattern)
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Tokens, groups and links of segments that neither vocabulary's merges leave; of whole texts with other blanks than spaces, tabs and line feeds."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        from heronlake.llm.bpe_chunks import _tables
        from heronlake.llm.sentencepiece_lattice import BLANK
        from heronlake.llm.tokens import SegmentEncoder

        self.lengths_a = _tables(path_a)[1]
        self.a = SegmentEncoder(path_a)
        self.a.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(r"[\t\n]|[^▁]▁", p) for p in names) or self.b.encode("  a ", out_type=str)[-1] != BLANK:
            raise ValueError("pieces across blanks, or removed blanks, are not supported")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        self.blank = self.b.piece_to_id(BLANK)
        self.letter = self.b.piece_to_id(BLANK + "a")
        finer = not any(re.search(r"[^\W\d_][.,;:!?]", p) for p in names)
        self.parts = (_FINER if finer else _SEGMENT).findall
        self.size_a, self.size_b = self.lengths_a.tolist(), [len(x) for x in self.bytes_b]
        self.name_a, self.name_b = list(map(str, range(len(self.size_a)))), list(map(str, range(len(names))))
        self.cache: dict[str, tuple | None] = {}

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, whose first blank, if it begins with one, stands for the blank that the model adds."""
        # a letter before a mark is a token by itself
        out = self.b.encode([t[1:] if t[0] == " " else "a" + t if t[0] in ".,;:!?" else t for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            if t == " ":
                out[k] = [self.blank]
            elif t[0] != " ":  # before a tab or line feed, the added blank is a token by itself
                if out[k][:1] != ([self.letter] if t[0] in ".,;:!?" else [self.blank]):
                    raise ValueError("a segment must begin with a blank")
                del out[k][0]
        return out

    def _align(self, text: str, ids_a: bytes, b: list[int]) -> tuple | None:
        """(tokens of A, tokens of B, groups, their text, linked pairs), or None where B's bytes are not the text's."""
        a = memoryview(ids_a).cast("I").tolist()
        raw = text.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        size_a, size_b, name_a, name_b = self.size_a, self.size_b, self.name_a, self.name_b
        shown, links, i, j, s, t, end_a, end_b = [], [], 0, 0, 0, 0, 0, 0
        n, m = len(a), len(b)
        while i < n and j < m:
            if end_a <= end_b:
                end_a += size_a[a[i]]
                i += 1
            while j < m and end_b < end_a:
                end_b += size_b[b[j]]
                j += 1
            if end_a == end_b:
                shown.append(f"{name_a[a[s]] if i == s + 1 else ','.join(map(name_a.__getitem__, a[s:i]))}|{name_b[b[t]] if j == t + 1 else ','.join(map(name_b.__getitem__, b[t:j]))}")
                links.append(a[i - 1] << 32 | b[j - 1])
                s, t = i, j
        while i < n and end_a < end_b:
            end_a += size_a[a[i]]
            i += 1
            if i == n and end_a == end_b:
                shown.append(",".join(map(name_a.__getitem__, a[s:i])) + "|" + ",".join(map(name_b.__getitem__, b[t:j])))
                links.append(a[i - 1] << 32 | b[j - 1])
        return n, m, len(links), ";".join(shown).encode(), array("Q", links).tobytes()

    def texts(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """For each text the parts of space and text, in order; None for a text without tokens."""
        cut, whole_texts = [], set()
        for text in texts:
            if not isinstance(text, str) or not text:
                cut.append([])
                continue
            whole = " " + text
            # B has pieces that end in a carriage return
            if "\r" in whole or (_ODD_ASCII if whole.isascii() else _ODD_SPACE).search(whole):
                whole_texts.add(whole)
                cut.append([whole])
            else:
                cut.append(self.parts(whole))
        known = self.cache
        new = list({s for parts in cut for s in parts if s not in known})
        if len(known) + len(new) > CACHE_SEGMENTS:
            known.clear()
            new = list({s for parts in cut for s in parts})
        for s, b in zip(new, self._ids_b(new)):
            known[s] = self._align(s, self.a._whole(s) if s in whole_texts else self.a._segment(s), b)
        out = []
        for parts in cut:
            got = list(map(known.__getitem__, parts))
            out.append(None if not got or None in got else got)
        return out


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each Python worker and pair of vocabularies."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


class Postings:
    """Compressed bitmaps of one document range: for each (pair, plane) the low 16 bits of its documents."""

    def __init__(self, pairs, planes, sizes, lows):
        """``lows`` lists the documents of each container after those of the one before; all are numpy arrays."""
        self.pairs, self.planes, self.sizes, self.lows = pairs, planes, sizes, lows

    @classmethod
    def of_links(cls, links, lows):
        """From one (pair, low document number) for each link."""
        import numpy as np

        pairs, number = np.unique(links, return_inverse=True)
        keys, times = np.unique((number.astype(np.int64) << 16) | lows, return_counts=True)
        found = []
        for plane in range(int(times.max(initial=0)).bit_length()):
            own = keys[(times >> plane) & 1 == 1]
            found.append(((own >> 16) << 8 | plane) << 16 | own & 0xFFFF)
        return cls._from_keys(pairs, np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64))

    @classmethod
    def _from_keys(cls, pairs, keys):
        import numpy as np

        place = keys >> 16  # sorted
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        places, sizes = place[begin], np.diff(begin, append=len(place))
        return cls(pairs[places >> 8], (places & 0xFF).astype("u1"), sizes.astype("<i8"), (keys & 0xFFFF).astype("<u2"))

    @classmethod
    def merged(cls, many: list[Postings]) -> Postings:
        """OR of containers of the same pair and plane; a document set twice counts once."""
        import numpy as np

        pairs, number = np.unique(np.concatenate([p.pairs for p in many]), return_inverse=True)
        planes, sizes = np.concatenate([p.planes for p in many]), np.concatenate([p.sizes for p in many])
        place = (number.astype(np.int64) << 8) | planes
        keys = (np.repeat(place, sizes) << 16) | np.concatenate([p.lows for p in many])
        keys.sort(kind="stable")  # runs that are sorted already are merged
        return cls._from_keys(pairs, keys[np.diff(keys, prepend=-1) > 0])

    def counts(self):
        """(pairs, documents, links): popcount of the planes' union, and popcounts weighted by the planes."""
        import numpy as np

        begin = np.diff(self.pairs, prepend=~self.pairs[:1]) != 0  # pairs are sorted
        pairs, number = self.pairs[begin], np.cumsum(begin) - 1
        weighted = np.bincount(number, self.sizes << self.planes.astype(np.int64), len(pairs)).astype(np.int64)
        union = np.unique((np.repeat(number.astype(np.int64), self.sizes) << 16) | self.lows)
        return pairs, np.bincount(union >> 16, minlength=len(pairs)), weighted

    def pack(self) -> bytes:
        """Bytes: arrays of the containers, dense ones as bitsets, compressed."""
        import numpy as np

        dense = self.sizes > ARRAY_MOST
        member = np.repeat(dense, self.sizes)
        bits = np.zeros((int(dense.sum()), RANGE), bool)
        bits[np.repeat(np.arange(len(bits)), self.sizes[dense]), self.lows[member]] = True
        # lists of document numbers are kept as steps, which are small
        lows = self.lows[~member].astype("<u2")
        steps = np.diff(lows, prepend=np.zeros(1, "<u2")).astype("<u2")
        body = [self.pairs.astype("<u8"), self.planes.astype("u1"), self.sizes.astype("<u4"), steps, np.packbits(bits)]
        head = np.array([len(self.pairs), len(lows)], "<u4").tobytes()
        split = [x.view("u1").reshape(len(x), -1).T.tobytes() if len(x) else b"" for x in body]
        return zlib.compress(head + b"".join(split), 1)

    @classmethod
    def unpack(cls, raw: bytes) -> Postings:
        import numpy as np

        raw, at = zlib.decompress(raw), 8
        n, m = np.frombuffer(raw[:8], "<u4").tolist()

        def take(count: int, kind: str):
            nonlocal at
            width = np.dtype(kind).itemsize
            out = np.frombuffer(np.frombuffer(raw, "u1", count * width, at).reshape(width, count).T.tobytes(), kind)
            at += count * width
            return out

        pairs, planes, sizes, steps = take(n, "<u8"), take(n, "u1"), take(n, "<u4").astype("<i8"), take(m, "<u2")
        dense = sizes > ARRAY_MOST
        lows, member = np.zeros(int(sizes.sum()), "<u2"), np.repeat(dense, sizes)
        lows[~member] = np.cumsum(steps, dtype="<u2")
        bits = np.unpackbits(np.frombuffer(raw, "u1", offset=at)).reshape(-1, RANGE)
        lows[member] = np.nonzero(bits)[1].astype("<u2")
        return cls(pairs, planes, sizes, lows)

    def where(self, keep) -> Postings:
        import numpy as np

        return Postings(self.pairs[keep], self.planes[keep], self.sizes[keep], self.lows[np.repeat(keep, self.sizes)])


def bucket_of(a, b):
    """Of numpy arrays or columns of ids: the same bucket for the same pair."""
    mixed = a * 7919 + b * 104729
    return F.shiftright(mixed, 5).bitwiseAND(F.lit(BUCKETS - 1)) if isinstance(mixed, Column) else (mixed >> 5) & (BUCKETS - 1)


_ENTRY = "kind string, doc_id string, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket long, span long, packed binary"
_COLUMNS = [c.split()[0] for c in _ENTRY.split(", ")]
_DOC = _COLUMNS[1:8]


def _entries(path_a: str, path_b: str):
    """Each document's own figures, and postings of the task's documents, packed by bucket of pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gc
        import hashlib

        import numpy as np

        from heronlake.llm.tokens import groups_of

        made = aligner(path_a, path_b)
        gc.disable()  # the cache's many small tuples hold no cycles

        def postings(links: list[bytes], rows: list[int]) -> list[dict]:
            pairs = np.frombuffer(b"".join(links), "<u8")
            numbers = np.repeat(np.array(rows, np.int64), [len(x) // 8 for x in links])
            out = []
            for span in np.unique(numbers >> 16).tolist():
                own = numbers >> 16 == span
                found = Postings.of_links(pairs[own], numbers[own] & 0xFFFF)
                buckets = bucket_of((found.pairs >> np.uint64(32)).astype(np.int64), (found.pairs & np.uint64(0xFFFFFFFF)).astype(np.int64))
                out += [{"kind": "posting", "bucket": b, "span": span, "packed": found.where(buckets == b).pack()} for b in np.unique(buckets).tolist()]
            return out

        links, rows, held = [], [], 0
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for part in groups_of(texts, 2_000_000):  # the segments of a whole batch would be many small objects
                out: list[dict] = []
                for doc_id, row, parts in zip(pdf["doc_id"].iloc[part], pdf["row"].iloc[part], made.texts(texts[part])):
                    doc = {"kind": "doc", "doc_id": doc_id, "row": row, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}
                    if parts:
                        a, b, groups, shown, linked = zip(*parts)
                        n = sum(groups)
                        doc |= {"n_a": sum(a), "n_b": sum(b), "n_groups": n, "n_links": n, "groups_sha256": hashlib.sha256(b";".join(shown)).hexdigest()}
                        links.append(b"".join(linked))
                        rows.append(row)
                        held += n
                    out.append(doc)
                    if held > HELD_LINKS:
                        out += postings(links, rows)
                        links, rows, held = [], [], 0
                yield _frame(out)
        if links:
            yield _frame(postings(links, rows))
        gc.enable()
        release()

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object).astype(dict.fromkeys(["row", "n_a", "n_b", "n_groups", "n_links", "bucket", "span"], "Int64"))


def _merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """All postings of a bucket and a document range: at most RANGE documents."""
    packed = Postings.merged([Postings.unpack(x) for x in pdf["packed"]]).pack()
    release()
    return pd.DataFrame({"bucket": [key[0]], "span": [key[1]], "packed": [packed]})


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    for pdf in batches:
        for packed in pdf["packed"]:
            pairs, documents, links = Postings.unpack(packed).counts()
            yield pd.DataFrame({"a": (pairs >> np.uint64(32)).astype("int64"), "b": (pairs & np.uint64(0xFFFFFFFF)).astype("int64"), "documents": documents, "links": links})
    release()


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a posting and its bucket's scores: for each document the sums over its links in this bucket."""
    import numpy as np

    for pdf in batches:
        for span, packed, scores in zip(pdf["span"], pdf["packed"], pdf["scores"]):
            found = Postings.unpack(packed)
            known, count, best = (np.frombuffer(zlib.decompress(scores), "<i8").reshape(3, -1)[k] for k in range(3))
            at = np.searchsorted(known, found.pairs.astype(np.int64))
            times = np.int64(1) << found.planes.astype(np.int64)
            docs, number = np.unique(found.lows, return_inverse=True)
            sums, bests = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
            np.add.at(sums, number, np.repeat(times * count[at], found.sizes))
            np.add.at(bests, number, np.repeat(times * best[at], found.sizes))
            yield pd.DataFrame({"row": (span << 16) | docs.astype("int64"), "count_sum": sums, "n_best": bests})
    release()


def _pack_scores(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's pairs with count and best flag, sorted; its size is bounded by the vocabularies."""
    import numpy as np

    pair = (pdf["a"].to_numpy() << 32) | pdf["b"].to_numpy()
    order = np.argsort(pair)
    packed = np.stack([pair[order], pdf["links"].to_numpy()[order], pdf["best"].to_numpy()[order].astype("int64")]).astype("<i8")
    return pd.DataFrame({"bucket": [key[0]], "scores": [zlib.compress(packed.tobytes(), 1)]})


class Aligned:
    """What one pass over the texts leaves: ``documents`` (own figures by row) and ``postings`` (bucket, span, packed)."""

    def __init__(self, docs: DataFrame, path_a: str, path_b: str):
        texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
        path = fresh_path(docs.sparkSession, "alignment")
        texts.mapInPandas(_entries(path_a, path_b), _ENTRY).write.partitionBy("kind").option("compression", "zstd").parquet(path)
        entries = docs.sparkSession.read.schema(_ENTRY).parquet(path)
        self.documents = entries.where("kind = 'doc'").select(*_DOC)
        loose = entries.where("kind = 'posting'").select("bucket", "span", "packed")
        self.postings = stage(loose.groupBy("bucket", "span").applyInPandas(_merge, "bucket long, span long, packed binary"), "postings")

    def pairs(self) -> DataFrame:
        """a, b, documents, links, best: every linked pair of ids; best where no other a has more links with b."""
        counted = self.postings.mapInPandas(_count, "a long, b long, documents long, links long")
        counted = stage(counted.groupBy("a", "b").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links")), "pair-counts")
        most = counted.groupBy("b").agg(F.max("links").alias("most"))
        return counted.join(most, "b").select("a", "b", "documents", "links", (F.col("links") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``.

    Texts that are null or empty, or that B does not spell byte by byte (such as those with U+2581), have zeros and an
    empty groups_sha256. Rows that repeat a doc_id, or have none, are documents of their own; equal counts all are best.
    A very long text is one document of the postings. Other columns are ignored. Empty in, empty out.
    """
    aligned = Aligned(docs, path_a, path_b)
    scores = aligned.pairs().withColumn("bucket", bucket_of(F.col("a"), F.col("b"))).groupBy("bucket").applyInPandas(_pack_scores, "bucket long, scores binary")
    returned = aligned.postings.join(scores, "bucket").select("span", "packed", "scores").mapInPandas(_score, "row long, count_sum long, n_best long")
    sums = returned.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    own = [F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links"]
    return aligned.documents.join(sums, "row", "left").select(*own, zero("n_best"), zero("count_sum"), "groups_sha256")
