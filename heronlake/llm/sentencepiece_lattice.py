"""SentencePiece encoding and decoding over a relational lattice.

Words are cut to units that no piece spans. Each distinct unit's bounded-length substrings are exploded and equi-joined
to the piece table; the edges are grouped by unit and a higher-order ``aggregate`` folds them to one path: Viterbi for a
unigram model. A BPE model is not defined by the best sum of scores, so for it the fold applies the merges in order of
their scores over the same edges.

Texts are read once. Blocks of documents become sequences of block-local unit numbers, which stay where they are written;
only each block's distinct units travel to the lattice and back, packed by a hash of the unit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.llm.shared import release, stage, stage_bucketed

BLANK = "▁"
#: Longest unit whose boundaries fit the bits of a long; characters of text in a block, about; words held at once.
MOST_BITS, BLOCK_CHARS, HELD_WORDS = 60, 24_000_000, 300_000
#: Distinct units of one lattice task, about; bytes of text for each bucket of units.
LATTICE_ROWS, BUCKET_BYTES = 50_000, 8_000_000
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
UNIGRAM, BPE = 1, 2
#: Fixed values of the model format: piece types.
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        tag = number()
        size = {0: 0, 1: 8, 5: 4}.get(tag & 7)
        if size == 0:
            yield tag >> 3, number()
            continue
        size = number() if size is None else size
        yield tag >> 3, raw[at : at + size]
        at += size


def piece_table(spark: SparkSession, model_file: str) -> tuple[DataFrame, dict]:
    """(piece, id, score) of the ordinary pieces, and what else encoding needs. Its size is that of the vocabulary.

    A model that rewrites texts (a normaliser, removed blanks, blanks after words), or has pieces that pre-empt the
    search, is an error, since its ids would not be the lattice's.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    top = list(_fields(sp.serialized_model_proto()))
    trainer = dict(_fields(next((v for k, v in top if k == 2), b"")))
    normal = dict(_fields(next((v for k, v in top if k == 3), b"")))
    kinds = [dict(_fields(v)).get(3, NORMAL) for k, v in top if k == 1]
    # the format's defaults: unigram, a blank before the text, extra blanks removed
    kind, prefix = trainer.get(3, UNIGRAM), bool(normal.get(3, 1))
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or USER_DEFINED in kinds:
        raise ValueError("models that rewrite texts or have pieces defined by the user are not supported")
    rows, first_byte = [], None
    for i in range(sp.get_piece_size()):
        if kinds[i] == BYTE:
            first_byte = i if first_byte is None else first_byte
        elif kinds[i] == NORMAL:
            rows.append((sp.id_to_piece(i), i, float(sp.get_score(i))))
    names = [r[0] for r in rows]
    if any(BLANK in p.lstrip(BLANK) for p in names):
        raise ValueError("pieces with a blank after a letter are not supported")
    info = {
        "kind": kind,
        "prefix": prefix,
        "most": max(map(len, names)),
        "first_byte": first_byte,
        "unk": sp.unk_id(),
        # a character without a piece costs ten more than the worst piece
        "unknown": min(r[2] for r in rows) - 10.0,
        "inside": frozenset(pair for p in names for pair in zip(p, p[1:])),
    }
    return spark.createDataFrame(rows, "piece string, id int, score double"), info


def units_of(word: str, inside: frozenset) -> list[str]:
    """Cut a word wherever no piece holds the two neighbouring characters; no merge can cross there."""
    odd = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in inside]
    if not odd:
        return [word]
    cuts = [0, *odd, len(word)]
    return [word[a:b] for a, b in zip(cuts, cuts[1:])]


def edges(units: DataFrame, pieces: DataFrame, most: int) -> DataFrame:
    """unit, n, edges: the lattice of each distinct unit. Single characters without a piece are edges without an id."""
    own = units.select("unit").distinct().withColumn("n", F.char_length("unit"))
    spans = own.select("unit", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    spans = spans.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("n") - F.col("start")))).alias("len"))
    spans = spans.withColumn("piece", F.substring(F.col("unit"), F.col("start") + 1, F.col("len")))
    # the piece table is as large as the vocabulary and no larger, so it is broadcast
    met = spans.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR len = 1")
    return met.groupBy("unit", "n").agg(F.collect_list(F.struct("start", "len", "score", "id")).alias("edges"))


def _bits(e: Column) -> tuple[Column, Column, Column]:
    one = F.lit(1).cast("long")
    left = F.call_function("shiftleft", one, e["start"])
    right = F.call_function("shiftleft", one, e["start"] + e["len"])
    inner = F.call_function("shiftleft", F.call_function("shiftleft", one, e["len"] - 1) - 1, e["start"] + 1)
    return left, right, inner


def merge_path(lattice: DataFrame) -> DataFrame:
    """unit, path (start, len, id): BPE merges by falling score, leftmost first, folded over each unit's edges.

    The state is a bit for each boundary that still stands; a merge clears the one boundary inside its edge.
    """
    marked = lattice.withColumn("edges", F.transform("edges", lambda e: F.struct((-e["score"]).alias("cost"), e["start"].alias("start"), e["len"].alias("len"), e["id"].alias("id"), *[b.alias(k) for b, k in zip(_bits(e), "lri")])))
    marked = marked.withColumn("merges", F.array_sort(F.filter("edges", lambda e: e["len"] > 1)))

    def merge(mask: Column, _: Column) -> Column:
        can = F.filter("merges", lambda e: (mask.bitwiseAND(e["l"]) != 0) & (mask.bitwiseAND(e["r"]) != 0) & (F.bit_count(mask.bitwiseAND(e["i"])) == 1))
        return F.coalesce(mask - mask.bitwiseAND(F.get(can, F.lit(0))["i"]), mask)

    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n") + 1) - 1
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n") - 1, F.size("merges"))))
    folded = marked.withColumn("mask", F.aggregate(steps, full, merge))
    mask = F.col("mask")
    stand = F.filter("edges", lambda e: (mask.bitwiseAND(e["l"]) != 0) & (mask.bitwiseAND(e["r"]) != 0) & (mask.bitwiseAND(e["i"]) == 0))
    return folded.select("unit", F.array_sort(F.transform(stand, lambda e: F.struct(e["start"].alias("start"), e["len"].alias("len"), e["id"].alias("id")))).alias("path"))


def viterbi_path(lattice: DataFrame, unknown: float = -1e6) -> DataFrame:
    """unit, path (start, len, id): the path of greatest total score; edges are folded in order of their ends."""
    ordered = lattice.withColumn("edges", F.array_sort(F.transform("edges", lambda e: F.struct((e["start"] + e["len"]).alias("end"), e["start"].alias("start"), e["len"].alias("len"), F.coalesce(e["score"], F.lit(unknown)).alias("score"), e["id"].alias("id")))))
    step = "array<struct<start int, len int, id int>>"
    none = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast(step).alias("path"))
    begin = F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.when(i == 0, F.struct(F.lit(0.0).alias("score"), F.array().cast(step).alias("path"))).otherwise(none))

    def relax(best: Column, e: Column) -> Column:
        came = F.get(best, e["start"])
        total = came["score"] + e["score"]
        new = F.struct(total.alias("score"), F.concat(came["path"], F.array(F.struct(e["start"].alias("start"), e["len"].alias("len"), e["id"].alias("id")))).alias("path"))
        return F.transform(best, lambda x, i: F.when((i == e["end"]) & total.isNotNull() & (x["score"].isNull() | (total > x["score"])), new).otherwise(x))

    return ordered.select("unit", F.get(F.aggregate("edges", begin, relax), F.col("n"))["path"].alias("path"))


def path_ids(paths: DataFrame, info: dict) -> DataFrame:
    """unit, ids: little-endian unsigned 32-bit ids; characters without a piece become their UTF-8 bytes' ids, or unk."""
    text = F.col("unit")

    def hex_id(i: Column) -> Column:
        h = F.lpad(F.hex(i), 8, "0")
        return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])

    def one(p: Column) -> Column:
        raw = F.hex(F.encode(F.substring(text, p["start"] + 1, F.lit(1)), "utf-8"))
        if info["first_byte"] is None:
            return hex_id(F.coalesce(p["id"], F.lit(info["unk"])))
        number = lambda k: F.conv(F.substring(raw, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + info["first_byte"]
        spelled = F.array_join(F.transform(F.sequence(F.lit(1), (F.length(raw) / 2).cast("int")), lambda k: hex_id(number(k))), "")
        return F.when(p["id"].isNull(), spelled).otherwise(hex_id(p["id"]))

    return paths.select("unit", F.unhex(F.array_join(F.transform("path", one), "")).alias("ids"))


def merged_long(unit: str, rank: dict[str, tuple[float, int]], info: dict) -> bytes:
    """The same merges for a unit too long for a bit mask, with a heap."""
    import heapq

    n = len(unit)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live, heap = [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (hit := rank.get(unit[i : end[j]])):
            heapq.heappush(heap, (-hit[0], i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = after[i]
        if not live[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        live[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out = []
    for i in range(n):
        if live[i]:
            hit = rank.get(unit[i : end[i]])
            raw = [] if hit else unit[i : end[i]].encode("utf-8", "surrogatepass")
            out += [hit[1]] if hit else [info["first_byte"] + b for b in raw] if info["first_byte"] is not None else [info["unk"]]
    return b"".join(i.to_bytes(4, "little") for i in out)


def encode_units(units: DataFrame, pieces: DataFrame, info: dict) -> DataFrame:
    """unit, ids for every distinct unit. Only BPE units beyond MOST_BITS characters leave the lattice, for a heap."""
    if info["kind"] == UNIGRAM:
        return path_ids(viterbi_path(edges(units, pieces, info["most"]), info["unknown"]), info)
    short = units.where(F.char_length("unit") <= MOST_BITS)
    long = units.where(F.char_length("unit") > MOST_BITS).distinct()
    rank = {r["piece"]: (r["score"], r["id"]) for r in pieces.collect()}  # the vocabulary

    @F.pandas_udf("binary")
    def fold(col: pd.Series) -> pd.Series:
        return col.map(lambda u: merged_long(u, rank, info))

    return path_ids(merge_path(edges(short, pieces, info["most"])), info).unionByName(long.select("unit", fold("unit").alias("ids")))


_BLOCK = "kind string, block long, bucket long, at binary, sizes binary, packed binary, doc_id long, crc long"
_LISTED = "kind string, bucket long, block long, at binary, numbers binary, unit string"
_RETURNED = "of long, at binary, sizes binary, packed binary"


def _pack(numbers) -> bytes:
    """Unsigned 32-bit numbers, their first bytes before their second ones, compressed."""
    import numpy as np

    return zlib.compress(np.asarray(numbers, "<u4").view("u1").reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes):
    import numpy as np

    return np.frombuffer(np.frombuffer(zlib.decompress(packed), "u1").reshape(4, -1).T.tobytes(), "<u4")


def _cut(whole, sizes) -> list:
    """``whole``, a text or bytes, cut into pieces of ``sizes``."""
    ends = sizes.astype("int64").cumsum().tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


class _Block:
    """Documents of a task as sequences of unit numbers."""

    def __init__(self, info: dict, buckets: int):
        self.info, self.buckets, self.unit_at, self.words, self.rows, self.chars = info, buckets, {}, {}, [], 0

    def word(self, word: str) -> bytes:
        at = self.unit_at
        return b"".join(at.setdefault(u, len(at)).to_bytes(4, "little") for u in units_of(word, self.info["inside"]))

    def add(self, doc_id: int | None, text: str) -> None:
        prefix, own = self.info["prefix"], b""
        plain = prefix and "  " not in text and BLANK not in text and text[:1] != " " and text[-1:] != " "
        if plain and text:
            parts, known = text.split(" "), self.words
            if len(known) > HELD_WORDS:
                known.clear()
            for w in set(parts).difference(known):
                known[w] = self.word(BLANK + w)
            own = b"".join(map(known.__getitem__, parts))
        elif text:
            marked = (BLANK if prefix else "") + text.replace(" ", BLANK)
            own = b"".join(map(self.word, _WORD.findall(marked)))
        raw = text.encode("utf-8", "surrogatepass")
        # what decoding gives back: a mark in the text itself comes back as a blank
        self.rows.append((doc_id, own, zlib.crc32(raw.replace(BLANK.encode(), b" ") if BLANK in text else raw)))
        self.chars += len(text)

    def frames(self, block: int) -> Iterator[pd.DataFrame]:
        """Units are numbered by falling frequency, so that numbers pack well, and packed with their numbers by bucket."""
        import numpy as np

        n, units = len(self.unit_at), list(self.unit_at)
        ids, owns, crcs = zip(*self.rows)
        counts = np.bincount(np.frombuffer(b"".join(owns), "<u4"), minlength=n)
        order = np.argsort(-counts[:n], kind="stable")
        rank = np.empty(n, "<u4")
        rank[order] = np.arange(n)
        buckets = np.array([zlib.crc32(units[i].encode()) % self.buckets for i in order.tolist()], "int64")
        rows, by = [], np.argsort(buckets, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(buckets[by])) + 1) if n else []:
            own = [units[i] for i in order[at].tolist()]
            rows.append((int(buckets[at[0]]), _pack(np.diff(at, prepend=0)), _pack([len(u) for u in own]), zlib.compress("".join(own).encode())))
        if rows:
            bucket, at, sizes, packed = zip(*rows)
            yield pd.DataFrame({"kind": "unit", "block": block, "bucket": pd.array(bucket, "Int64"), "at": at, "sizes": sizes, "packed": packed, "doc_id": pd.array([None] * len(rows), "Int64"), "crc": pd.array([None] * len(rows), "Int64")})
        codes, empty = [_pack(rank[np.frombuffer(own, "<u4")]) for own in owns], pd.array([None] * len(ids), "Int64")
        yield pd.DataFrame({"kind": "document", "block": block, "bucket": empty, "at": None, "sizes": None, "packed": codes, "doc_id": pd.array(ids, "Int64"), "crc": pd.array(crcs, "Int64")})


def _blocks(info: dict, buckets: int):
    """Per block of documents, rows of its distinct units, packed by bucket, and of its documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 24, _Block(info, buckets)
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                block.add(None if pd.isna(doc_id) else int(doc_id), text if isinstance(text, str) else "")
                if block.chars >= BLOCK_CHARS:
                    yield from block.frames(number)
                    number, block = number + 1, _Block(info, buckets)
        if block.rows:
            yield from block.frames(number)
        release()

    return run


def _listed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: its distinct units, and for each block the places of its units in their sorted list."""
    owns = [_cut(zlib.decompress(p).decode(), _unpack(n)) for p, n in zip(pdf["packed"], pdf["sizes"])]
    units = sorted(set().union(*owns))
    place = {u: k for k, u in enumerate(units)}
    use = pd.DataFrame({"kind": "use", "bucket": pdf["bucket"], "block": pdf["block"], "at": pdf["at"], "numbers": [_pack([place[u] for u in own]) for own in owns], "unit": None})
    own = pd.DataFrame({"kind": "unit", "bucket": pdf["bucket"].iloc[0], "block": 0, "at": None, "numbers": None, "unit": units})
    return pd.concat([use, own], ignore_index=True)


def _returned(use: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each block the ids of its units."""
    import numpy as np

    ids = [i for _, i in sorted(zip(coded["unit"].tolist(), coded["ids"].tolist()))]
    out = []
    for block, at, numbers in zip(use["block"].tolist(), use["at"], use["numbers"]):
        own = [ids[k] for k in _unpack(numbers).tolist()]
        out.append((block, at, _pack([len(i) for i in own]), _pack(np.frombuffer(b"".join(own), "<u4"))))
    return pd.DataFrame(out, columns=["of", "at", "sizes", "packed"])


def _piece_bytes(pieces: DataFrame, info: dict) -> dict[int, bytes]:
    """What each id stands for; the size of the vocabulary."""
    out = {r["id"]: r["piece"].replace(BLANK, " ").encode("utf-8", "surrogatepass") for r in pieces.collect()}
    if info["first_byte"] is not None:
        out |= {info["first_byte"] + b: bytes([b]) for b in range(256)}
    return out


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, round_trip for every row: the ids of each whole text, without marks.

    ``round_trip`` tells whether the ids, decoded, give the text again (a character without a piece or bytes does not).
    Null counts as empty, which has no ids. Repeated rows and null doc_ids are rows like any other; other columns are
    ignored. Of paths with one score the first found stays. Very long words are merged with a heap. Empty in, empty out.
    """
    import numpy as np

    spark = docs.sparkSession
    pieces, info = piece_table(spark, model_file)
    raw = _piece_bytes(pieces, info)
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.withColumn("doc_id", F.col("doc_id").cast("long").cast("string"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, tasks = max(1, size // BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bucketed by block, the documents are not moved again to meet their units
    read = stage_bucketed(source.mapInPandas(_blocks(info, buckets), _BLOCK), "blocks", "block", tasks)
    rows = read.where("kind = 'document'").select("block", "doc_id", "packed", "crc")
    packed = read.where("kind = 'unit'").select("bucket", "block", "at", "sizes", "packed")
    listed = stage(packed.groupBy("bucket").applyInPandas(_listed, _LISTED), "listed", ("kind",))
    units = listed.where("kind = 'unit'").select("unit")
    parts = max(tasks, units.count() // LATTICE_ROWS)
    coded = stage(encode_units(units.repartition(parts, "unit"), pieces, info), "units")
    coded = coded.withColumn("bucket", F.crc32(F.encode("unit", "utf-8")) % buckets)
    use = listed.where("kind = 'use'").select("bucket", "block", "at", "numbers")
    known = use.groupBy("bucket").cogroup(coded.groupBy("bucket")).applyInPandas(_returned, _RETURNED)
    unk = int(info["unk"]).to_bytes(4, "little") if info["first_byte"] is None and info["kind"] == UNIGRAM else None

    def single(ids: bytes) -> bytes:
        """Unknown characters in a row are one unknown piece to a unigram model."""
        codes = [ids[k : k + 4] for k in range(0, len(ids), 4)]
        return b"".join(c for c, before in zip(codes, [None, *codes]) if c != unk or before != unk)

    def put(key, own: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        ats = [_unpack(at).cumsum() for at in table["at"]]
        by, text_by = [b""] * sum(map(len, ats)), [b""] * sum(map(len, ats))
        for at, sizes, packed in zip(ats, table["sizes"], table["packed"]):
            for k, ids in zip(at.tolist(), _cut(_unpack(packed).tobytes(), _unpack(sizes))):
                by[k] = ids
                text_by[k] = b"".join(raw.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist())
        out, same = [], []
        for codes, crc in zip(own["packed"].tolist(), own["crc"].tolist()):
            at = _unpack(codes).tolist()
            ids = b"".join(map(by.__getitem__, at))
            out.append(ids if unk is None else single(ids))
            text = b"".join(map(text_by.__getitem__, at))
            same.append(zlib.crc32(text[1:] if info["prefix"] else text) == crc)
        return pd.DataFrame({"doc_id": own["doc_id"].astype("Int64"), "ids": out, "n_tokens": [len(x) // 4 for x in out], "round_trip": same})

    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(put, "doc_id long, ids binary, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids): pieces joined in order, byte pieces as UTF-8, blanks for their mark.

    Ids outside the vocabulary are an error; bytes that are not UTF-8 become the replacement character.
    """
    spark = encoded.sparkSession
    pieces, info = piece_table(spark, model_file)
    table = pieces.select("id", F.hex(F.encode("piece", "utf-8")).alias("raw"))
    if info["first_byte"] is not None:
        table = table.unionByName(spark.range(256).select((F.col("id") + info["first_byte"]).cast("int").alias("id"), F.lpad(F.hex("id"), 2, "0").alias("raw")))
    raw = F.hex("ids")
    quad = lambda k: F.concat(*[F.substring(raw, 8 * k + j, F.lit(2)) for j in (7, 5, 3, 1)])
    n = (F.octet_length("ids") / 4).cast("int")
    listed = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.conv(quad(k), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = stage(encoded.select("doc_id", F.xxhash64("doc_id", "ids").alias("row"), listed.alias("listed")), "to-decode")
    met = rows.select("doc_id", "row", F.posexplode("listed").alias("pos", "id")).join(F.broadcast(table), "id", "left")
    met = met.withColumn("raw", F.when(F.col("raw").isNull(), F.raise_error(F.lit("id outside the vocabulary"))).otherwise(F.col("raw")))
    # a repeated row has the same pieces at the same places, so each place is taken once
    joined = met.select("doc_id", "row", "pos", "raw").distinct().groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("own"))
    text = F.replace(F.decode(F.unhex(F.array_join(F.transform("own", lambda x: x["raw"]), "")), "utf-8"), F.lit(BLANK), F.lit(" "))
    text = F.substring(text, 2, 2**31 - 1) if info["prefix"] else text
    texts = joined.select(F.col("row").alias("r"), F.col("doc_id").alias("d"), text.alias("text"))
    return rows.join(texts, F.expr("row = r AND doc_id <=> d"), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
