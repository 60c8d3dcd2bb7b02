"""Exact similarity join on word shingles with signature trees.

Documents with the same word sequence form one node; a shingle is known by its 64-bit hash. Two exchanges of packed
hashes tell each node which of its shingles any other node has, and how many: first over all documents, then over the
nodes that are left. A node less than three quarters of whose shingles occur elsewhere can be linked with nothing.

The others order their shingles by (nodes that have it, hash). Of two nodes linked at 0.75, the first n // 4 + 1 shingles
in that order have one in common, so nodes meet in a cell for each of these; no pair is lost. The rows of a cell form a
signature tree: inner nodes hold OR-combined shingle bitmaps, size ranges and the most shingles that can still be common
after the cell's own. A dual traversal of all trees of a batch drops pairs of tree nodes whose greatest possible overlap
is too small, or that are in one component already. What remains is verified on the nodes' whole shingle sets.

A first pass links each node to its cell's node of fewest shingles of its own, so that a group of n near copies takes
about n verifications; cells whose nodes are all in one component then hold no work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.components import components
from heronlake.llm.shared import free_name, join_skewed, numbered, release, stage, unstage

WORDS, LEAD_KEYS = 5, 3
#: Shingles and distinct nodes of one block of the exchange; shingles of one bucket, about.
BLOCK, BLOCK_NODES, BUCKET = 500_000, 60_000, 1_500_000
#: Rows of one tile of a cell; rows traversed at once, about; pairs of one verifying group, about; bits of a bitmap.
TILE, BATCH, GROUP_PAIRS, BITS = 2048, 16_384, 256, 1024
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BYTE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)


def normal_words(text: str) -> bytes:
    """The words of a text with A-Z lower-cased, joined by single blanks."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split())


def _node(words: bytes) -> bytes:
    import hashlib

    return hashlib.blake2b(words, digest_size=16).digest()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of P and of its inverse modulo 2**64, at least n of them."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _POWERS:
        if len(_POWERS) > 4:
            _POWERS.clear()
        out = []
        for p in (_P, pow(_P, -1, 2**64)):
            a = np.full(size, p, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[size] = tuple(out)
    return _POWERS[size]


def shingles(words: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; shorter texts are one shingle, empty ones none."""
    if not words:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(words, np.uint8)
    blanks = np.flatnonzero(raw == 32)
    starts = np.concatenate([[0], blanks + 1])
    ends = np.concatenate([blanks, [len(raw)]])
    if len(starts) >= WORDS:
        starts, ends = starts[: len(starts) - WORDS + 1], ends[WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
    h = (total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(h ^ (h >> np.uint64(31)))


def linked(shared: int, a: int, b: int) -> bool:
    """Jaccard similarity of at least 0.75."""
    return 100 * shared >= 75 * (a + b - shared)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """One of BITS bits for each shingle, as 64-bit words."""
    bits = np.zeros(BITS, np.uint8)
    bits[((hashes >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


# --- which shingles do other nodes have? ------------------------------------------------------------------------------

_PACKED = "bucket int, block binary, hashes binary, at binary, ids binary, missing binary, own binary, nodes binary, sizes binary"
_SHARED = "block binary, at binary, hashes binary, counts binary, ids binary, missing binary, own binary, nodes binary, sizes binary"


class _Block:
    """Rows of a task whose nodes' hashes are sent out together. Its name follows from its place and its nodes."""

    def __init__(self, number: int):
        self.number, self.at, self.sets, self.ids, self.own, self.held = number, {}, [], [], [], 0

    def add(self, doc_id, node: bytes, hashes) -> None:
        k = self.at.get(node)
        if k is None:
            k = self.at[node] = len(self.at)
            self.sets.append(hashes())
            self.held += len(self.sets[-1])
        self.ids.append(doc_id)
        self.own.append(k)

    def full(self) -> bool:
        return self.held >= BLOCK or len(self.ids) >= BLOCK_NODES

    def rows(self, bits: int, whole: bool) -> pd.DataFrame:
        from pyspark import TaskContext

        context = TaskContext.get()
        nodes, sizes = b"".join(self.at), np.array([len(s) for s in self.sets], "<i4")
        name = _node(f"{context.partitionId() if context else 0}/{self.number}/".encode() + nodes)
        every = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sizes), dtype="<u2"), sizes)
        bucket = (every >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32) if bits else np.zeros(len(every), np.uint16)
        order = np.argsort(bucket, kind="stable")
        every, owner, bucket = every[order], owner[order], bucket[order]
        # for counts 32 bits beyond the bucket's do: should two hashes agree in them, both count as shared
        every = every.astype("<u8") if whole else ((every << np.uint64(bits)) >> np.uint64(32)).astype("<u4")
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        names = bucket[np.concatenate([[0], cuts])].tolist() if len(every) else []
        out = [(b, name, h.tobytes(), o.tobytes(), None, None, None, None, None) for b, h, o in zip(names, np.split(every, cuts), np.split(owner, cuts))]
        ids = np.array([0 if x is None else x for x in self.ids], "<i8").tobytes()
        missing = np.array([x is None for x in self.ids], np.uint8).tobytes()
        out.append((int.from_bytes(name[:2], "little") & ((1 << bits) - 1), name, None, None, ids, missing, np.array(self.own, "<u2").tobytes(), nodes, sizes.tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PACKED.split(", ")])


def _blocks(rows: Iterator[tuple], bits: int, whole: bool) -> Iterator[pd.DataFrame]:
    block = _Block(0)
    for row in rows:
        block.add(*row)
        if block.full():
            yield block.rows(bits, whole)
            block = _Block(block.number + 1)
    if block.ids:
        yield block.rows(bits, whole)


def _find_shared(whole: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one bucket: by block, the nodes with hashes that another node has too, and the hashes if ``whole``."""
        packed = pdf["hashes"].notna().to_numpy()
        kind = "<u8" if whole else "<u4"
        parts = [np.frombuffer(h, kind) for h in pdf["hashes"][packed]]
        every = np.sort(np.concatenate([*parts, np.zeros(0, kind)]))
        again = every[1:][every[1:] == every[:-1]]
        twice, times = np.unique(again, return_counts=True)
        out = []
        for row, hashes in zip(pdf[packed].itertuples(), parts):
            owner = np.frombuffer(row.at, "<u2")
            if not len(twice):
                continue
            at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
            hit = twice[at] == hashes
            if not hit.any():
                continue
            if whole:
                out.append((row.block, owner[hit].tobytes(), hashes[hit].tobytes(), (times[at[hit]] + 1).astype("<u4").tobytes()))
            else:
                who, n = np.unique(owner[hit], return_counts=True)
                out.append((row.block, who.astype("<u2").tobytes(), None, n.astype("<u4").tobytes()))
        out = [(*r, None, None, None, None, None) for r in out]
        out += [(r.block, None, None, None, r.ids, r.missing, r.own, r.nodes, r.sizes) for r in pdf[~packed].itertuples()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SHARED.split(", ")])

    return run


def _table(pdf: pd.DataFrame) -> tuple[pd.Series, list[bytes], np.ndarray, pd.DataFrame]:
    head = pdf[pdf["nodes"].notna()].iloc[0]
    raw = head["nodes"]
    return head, [raw[k : k + 16] for k in range(0, len(raw), 16)], np.frombuffer(head["sizes"], "<i4"), pdf[pdf["at"].notna()]


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block: doc_id, node, n, and how many of its n hashes other nodes have."""
    head, nodes, sizes, rest = _table(pdf)
    total = np.zeros(len(nodes), np.int64)
    for at, counts in zip(rest["at"], rest["counts"]):
        total[np.frombuffer(at, "<u2")] += np.frombuffer(counts, "<u4")
    own = np.frombuffer(head["own"], "<u2")
    ids = pd.array(np.frombuffer(head["ids"], "<i8"), dtype="Int64")
    ids[np.frombuffer(head["missing"], np.uint8) == 1] = pd.NA
    return pd.DataFrame({"doc_id": ids, "node": [nodes[k] for k in own], "n": sizes[own].astype(np.int64), "shared": total[own]})


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one block: each node that can be linked, its first shingles in the common order, and its bitmap."""
    _, nodes, sizes, rest = _table(pdf)
    join = lambda c, kind: np.concatenate([*(np.frombuffer(x, kind) for x in rest[c]), np.zeros(0, kind)])
    at, hashes, counts = join("at", "<u2"), join("hashes", "<u8"), join("counts", "<u4")
    order = np.lexsort((hashes, counts, at))
    hashes, starts = hashes[order], np.searchsorted(at[order], np.arange(len(nodes) + 1))
    out = []
    for k, node in enumerate(nodes):
        own, n = hashes[starts[k] : starts[k + 1]], int(sizes[k])
        if 4 * len(own) >= 3 * n:
            first = n // 4 + 1 - (n - len(own))  # the shingles of no other node come first of all
            out.append((node, n, len(own), own[:first].view("<i8"), np.sort(own)[:LEAD_KEYS].view("<i8"), bitmap(own).tobytes()))
    return pd.DataFrame(out, columns=["node", "n", "shared", "keys", "lead", "bits"])


def _exchange(packed: DataFrame, whole: bool, then, schema: str) -> DataFrame:
    found = packed.groupBy("bucket").applyInPandas(_find_shared(whole), _SHARED)
    return found.groupBy("block").applyInPandas(then, schema)


def _bucket_bits(hashes: int) -> int:
    return min(24, max(0, int(hashes // BUCKET).bit_length()))


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the word sequence), n (set size), shared (how many of them other nodes have), every row."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = _bucket_bits(chars // 6)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for pdf in batches:
                for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                    words = normal_words(text) if isinstance(text, str) else b""
                    yield None if pd.isna(doc_id) else int(doc_id), _node(words), lambda words=words: shingles(words)

        yield from _blocks(rows(), bits, False)
        release()

    # ids keep all their digits: null ones are told apart before pandas would make them floats
    safe = source.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return _exchange(safe.mapInPandas(pack, _PACKED), False, _counted, "doc_id long, node binary, n long, shared long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, hashes (binary) of each node that ``wanted`` (doc_id, node) names, once."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # few and narrow beside the texts: where Spark finds their files small enough it sends them to the texts, else both move
    ids = stage(wanted.select(F.col("doc_id").alias("wanted_id")).distinct(), "wanted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = normal_words(text) if isinstance(text, str) else b""
                h = shingles(words)
                rows.append((_node(words), len(h), h.astype("<u8").tobytes()))
            if rows:
                yield pd.DataFrame(rows, columns=["node", "n", "hashes"])
        release()

    texts = source.join(ids, F.expr("doc_id <=> wanted_id"), "left_semi").select("text")
    found = texts.mapInPandas(run, "node binary, n int, hashes binary")
    # a repeated or missing doc_id may have brought other texts too
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def ordered(sets: DataFrame) -> DataFrame:
    """node, n, shared, keys (first shingles), lead (smallest shared shingles), bits, of nodes that can be linked."""
    bits = _bucket_bits(sets.agg(F.sum("n")).first()[0] or 0)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((None, bytes(n), lambda h=h: np.frombuffer(bytes(h), "<u8")) for pdf in batches for n, h in zip(pdf["node"], pdf["hashes"]))
        yield from _blocks(rows, bits, True)
        release()

    return _exchange(sets.select("node", "hashes").mapInPandas(pack, _PACKED), True, _ordered, "node binary, n int, shared int, keys array<long>, lead array<long>, bits binary")


# --- signature trees --------------------------------------------------------------------------------------------------


class Forest:
    """The signature trees of several cells. Level 0 holds the rows; each level above joins up to four of a tree.

    Each level: bits, least and greatest size, most spare shingles beyond the bits, most common shingles that can still
    follow, component (or -1 if mixed), and the range of children.
    """

    def __init__(self, cell: np.ndarray, sizes: np.ndarray, shared: np.ndarray, remain: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        self.order = order = np.lexsort((bits[:, 1], bits[:, 0], sizes, cell))
        bits, sizes, comp, cell = bits[order], sizes[order], comp[order], cell[order]
        slack = shared[order] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, slack, remain[order], comp, None)]
        while len(cell) > len(np.unique(cell)):
            begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            place = np.arange(len(cell)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(cell)]])))
            cut = np.flatnonzero(place % 4 == 0)
            bits, low, high, slack, remain, comp, _ = self.levels[-1]
            least, most = np.minimum.reduceat(comp, cut), np.maximum.reduceat(comp, cut)
            self.levels.append((
                np.bitwise_or.reduceat(bits, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut),
                np.maximum.reduceat(remain, cut), np.where(least == most, least, -1), np.stack([cut, np.concatenate([cut[1:], [len(cell)]])], axis=1),
            ))
            cell = cell[cut]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, most common shingles) of pairs that could be linked and are not in one component."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        todo = [(top, roots, roots)]
        while todo:
            level, i, j = todo.pop()
            if len(i) > 8192:
                todo += [(level, i[k : k + 8192], j[k : k + 8192]) for k in range(0, len(i), 8192)]
                continue
            bits, low, high, slack, remain, comp, kids = self.levels[level]
            keep = (4 * high[i] >= 3 * low[j]) & (4 * high[j] >= 3 * low[i]) & ((comp[i] != comp[j]) | (comp[i] < 0))
            if level == 0:
                keep &= i < j
            need = 3 * (low[i] + low[j])
            keep &= 7 * np.minimum(remain[i], remain[j]) >= need
            i, j, need = i[keep], j[keep], need[keep]
            if not len(i):
                continue
            most = np.minimum(slack[i], slack[j]) + np.bitwise_count(bits[i] & bits[j]).sum(axis=1, dtype=np.int64)
            most = np.minimum(most, np.minimum(remain[i], remain[j]))
            keep = 7 * most >= need
            i, j, most = i[keep], j[keep], most[keep]
            if not len(i):
                continue
            if level == 0:
                yield self.order[i], self.order[j], most
                continue
            step = np.arange(4)
            ci = (kids[i, 0][:, None, None] + step[None, :, None]) + np.zeros((1, 1, 4), np.int64)
            cj = (kids[j, 0][:, None, None] + step[None, None, :]) + np.zeros((1, 4, 1), np.int64)
            ok = (ci < kids[i, 1][:, None, None]) & (cj < kids[j, 1][:, None, None]) & (ci <= cj)
            todo.append((level - 1, ci[ok], cj[ok]))


def _cell_rows(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """key, i, j, node, label, n, shared, remain, bits of cells (or pairs of a large cell's tiles) with several components."""
    rows = nodes.select("node", "n", "shared", F.posexplode("keys").alias("k", "key"))
    rows = rows.select("key", "node", (F.col("shared") - F.col("k")).alias("remain"))
    if labels is None:
        rows = rows.withColumn("label", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = rows.groupBy("key").agg(F.count("*").alias("g"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "g")
    rows = stage(rows.join(held, "key"), "live")
    small = rows.where(F.col("g") <= TILE).select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "node", "label", "remain")
    # a large cell: its large components get tiles of their own, the others share tiles; tiles of one component do not meet
    large = rows.where(F.col("g") > TILE)
    own = large.groupBy("key", "label").agg(F.count("*").alias("c"), F.first("g").alias("g"))
    own = own.select("key", "label", (F.col("c") > TILE // 4).alias("alone"), F.ceil(F.when(F.col("c") > TILE // 4, F.col("c")).otherwise(F.col("g")) / TILE).alias("parts"))
    alone = F.pmod(F.xxhash64("label"), F.lit(1 << 40)) * (1 << 20) + F.pmod(F.xxhash64("node"), F.col("parts"))
    tile = F.when(F.col("alone"), alone).otherwise(-1 - F.pmod(F.xxhash64("label"), F.col("parts")))
    large = large.join(own, ["key", "label"]).withColumn("tile", tile)
    tiles = large.groupBy("key", "tile").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = tiles.alias("x"), tiles.alias("y")
    same = F.expr("x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo")
    met = x.join(y, F.expr("x.key = y.key AND x.tile <= y.tile")).where(~same).select(F.col("x.key").alias("key"), F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    sides = met.select("key", "i", "j", F.col("i").alias("tile")).unionByName(met.where("i <> j").select("key", "i", "j", F.col("j").alias("tile")))
    large = large.join(sides, ["key", "tile"]).select("key", "i", "j", "node", "label", "remain")
    return small.unionByName(large).join(nodes.select("node", "n", "shared", "bits"), "node")


def _candidates(nodes: DataFrame, labels: DataFrame | None, best: bool) -> DataFrame:
    """a, b: pairs of nodes that the trees leave; if ``best``, only each node's likeliest partner of each component."""
    cells = _cell_rows(nodes, labels).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def look(held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(held, ignore_index=True)
        cell = pdf.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
        comp, names = pd.factorize(pdf["label"])[0].astype(np.int64), pdf["node"].to_numpy()
        bits = np.frombuffer(b"".join(pdf["bits"]), "<u8").reshape(len(pdf), -1)
        forest = Forest(cell, pdf["n"].to_numpy(np.int64), pdf["shared"].to_numpy(np.int64), pdf["remain"].to_numpy(np.int64), bits, comp)
        kept, waiting = np.zeros((0, 4), np.int64), []

        def reduce() -> np.ndarray:
            every = np.concatenate([kept, *waiting])
            every = every[np.lexsort((every[:, 1], -every[:, 3], every[:, 2], every[:, 0]))]
            first = np.ones(len(every), bool)
            first[1:] = (every[1:, 0] != every[:-1, 0]) | (every[1:, 2] != every[:-1, 2])
            return every[first]

        def frame(i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
            a, b = names[i], names[j]
            swap = a > b
            return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b)})

        for i, j, most in forest.pairs():
            if not best:
                yield frame(i, j)
                continue
            waiting += [np.stack([i, j, comp[j], most], axis=1), np.stack([j, i, comp[i], most], axis=1)]
            if sum(map(len, waiting)) > 200_000:
                kept, waiting = reduce(), []
        if best and (len(kept) or waiting):
            kept = reduce()
            yield frame(kept[:, 0], kept[:, 1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < BATCH:
                continue
            every = pd.concat(held, ignore_index=True)
            last = every.iloc[-1]
            open_ = ((every["key"] == last["key"]) & (every["i"] == last["i"]) & (every["j"] == last["j"])).to_numpy()
            if open_.all():
                held = [every]
                continue
            yield from look([every[~open_]])
            held = [every[open_]]
            size = int(open_.sum())
        if held:
            yield from look(held)
        release()

    return cells.mapInPandas(run, "a binary, b binary").distinct()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, linked: the exact similarity of the two nodes' shingle sets, staged."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("d"))
    groups = max(1, pairs.count() // GROUP_PAIRS)
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / GROUP_PAIRS))
    dealt = stage(pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("a", salt), F.lit(groups)).alias("grp")), "pairs")
    wanted = dealt.select("grp", F.col("a").alias("node")).unionByName(dealt.select("grp", F.col("b").alias("node"))).distinct()

    known = wanted.withColumnRenamed("grp", "of").join(sets.select("node", "hashes"), "node")

    def compare(key, pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        have = {bytes(n): np.frombuffer(bytes(h), "<u8") for n, h in zip(own["node"], own["hashes"])}
        out = []
        for a, b in zip(pdf["a"], pdf["b"]):
            x, y = have[bytes(a)], have[bytes(b)]
            out.append((a, b, linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        return pd.DataFrame(out, columns=["a", "b", "linked"])

    found = stage(dealt.groupBy("grp").cogroup(known.groupBy("of")).applyInPandas(compare, "a binary, b binary, linked boolean"), "verified")
    unstage(dealt)
    return found


def _lead_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: each node with the one of fewest shingles of its own among those that share a smallest shared shingle."""
    rows = nodes.select("node", "n", ((F.col("n") - F.col("shared")) / F.col("n")).alias("own"), F.explode("lead").alias("key"))
    hubs = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("own", "node", "n")).alias("hub")).where("c > 1")
    met = join_skewed(rows, stage(hubs, "hubs"), "key", "c").where("node <> hub.node AND 4 * n >= 3 * hub.n AND 4 * hub.n >= 3 * n")
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, label after new links: only the labels that they connect are worked on."""
    if labels is None:
        return stage(components(links), "labels")
    end = lambda c: F.coalesce(F.col(f"{c}_label"), F.col(c)).alias(c)
    mapped = links
    for c in ("a", "b"):
        mapped = mapped.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
    moved = stage(components(mapped.select(end("a"), end("b")).where("a <> b")), "moved").withColumnRenamed("label", "to")
    old = labels.join(moved.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = moved.select("node", F.col("to").alias("label")).join(labels.select("node"), "node", "left_anti")
    return stage(old.unionByName(fresh), "labels")


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, n, label for every row: rows of linked texts share a label, wordless ones have none."""
    meta = stage(counted(docs), "counted")
    wanted = stage(meta.where("n > 0 AND 4 * shared >= 3 * n").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "owners")
    sets = stage(_sets(docs, wanted), "sets")
    nodes = stage(ordered(sets), "nodes")
    labels = tested = None
    for find in (_lead_pairs(nodes), True, False):
        pairs = find if isinstance(find, DataFrame) else _candidates(nodes, labels, best=find)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "candidates")
        if pairs.isEmpty():
            continue
        found = _verify(pairs, sets)
        labels = _joined(labels, found.where("linked").select("a", "b"))
        unstage(pairs)
        done = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tested = done if tested is None else tested.unionByName(done)
    unstage(sets, nodes)
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "node binary, label binary")
    sized = meta.where("n > 0").groupBy("node").agg(F.count("*").alias("c"), F.min("n").alias("n"))
    named = sized.select("node", "c").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = join_skewed(meta.where("n > 0"), stage(named, "named"), "node", "c").select("doc_id", "node", "n", "label")
    return member.unionByName(meta.where("n = 0").select("doc_id", "node", "n", F.lit(None).cast("binary").alias("label")))


def linked_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Null or wordless text has an empty set and is linked with nothing: its component is its own doc_id. Rows of one word
    sequence are linked; rows that repeat a doc_id, or lack one, are members like any other, and a component without any
    doc_id has none. Very long texts are read whole. Empty in, empty out; other columns are ignored.
    """
    member = stage(components_of(docs), "members")
    least = member.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    joined = join_skewed(member.where("label IS NOT NULL"), stage(least, "least"), "label", "c").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return joined.unionByName(member.where("label IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def drop_linked(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group of linked texts, all columns kept: the one with the smallest doc_id.

    Rows without doc_id come after all others. Wordless texts are linked with nothing and all stay. Empty in, empty out.
    """
    row, kept = free_name(docs, "_row"), free_name(docs, "_kept")
    rows = numbered(docs, row, nulls_first=False)
    groups = linked_groups(rows.select(F.col(row).alias("doc_id"), "text"))
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias(kept))
    return rows.join(stay, F.col(row) == F.col(kept), "left_semi").drop(row)
