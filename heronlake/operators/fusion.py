"""Evidence: one schema for chunk and graph hits, features, gates and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.config import DEFAULT
from heronlake.functions.text import norm_text
from heronlake.operators.retrieval import top


def edge_evidence(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, type, text ``A --REL--> B`` and provenance of edges; a nameless end shows 24 characters of its id."""
    n = nodes.select("id", "name")
    named = edges.join(n.select(F.col("id").alias("source"), F.col("name").alias("a")), "source", "left").join(n.select(F.col("id").alias("target"), F.col("name").alias("b")), "target", "left")
    show = lambda name, i: F.coalesce(F.nullif(F.trim(name), F.lit("")), F.substring(F.col(i), 1, 24))
    return named.select(
        F.concat_ws("|", "source", "relation", "target").alias("id"),
        F.lit("relationship").alias("type"),
        F.concat(show("a", "source"), F.lit(" --"), "relation", F.lit("--> "), show("b", "target")).alias("text"),
        "confidence",
        "source_document_id",
        "chunk_id",
    )


def fill_scope(evidence: DataFrame, scope: DataFrame, cols: list[str]) -> DataFrame:
    """Null or blank scope columns filled from the request's; present values are never overwritten."""
    s = scope.select("query_id", *[F.col(c).alias(f"_{c}") for c in cols])
    e = evidence.join(s, "query_id", "left")
    for c in cols:
        e = e.withColumn(c, F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col(f"_{c}")))
    return e.drop(*[f"_{c}" for c in cols])


PROVENANCE = ["source_document_id", "source_filename", "source_hash", "chunk_id", "section"]


def features(evidence: DataFrame, target: DataFrame) -> DataFrame:
    """Evidence with concept_match, topic_match (0 or 1; 0 where absent), provenance share and tri-state scope flags."""
    t = target.select("query_id", *[F.col(c).alias(f"want_{c}") for c in ("concept", "topic", "class", "subject", "unit")])
    e = evidence.join(t, "query_id")
    low = lambda c: F.lower(F.trim(F.col(c)))
    concept = F.coalesce(F.contains(F.lower("text"), low("want_concept")), F.lit(False)).cast("double")
    topic = F.coalesce((low("topic") == low("want_topic")) | F.contains(low("topic"), low("want_topic")), F.lit(False)).cast("double")
    present = sum((F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)).cast("int") for c in PROVENANCE[1:]), F.coalesce(F.trim(F.col(PROVENANCE[0]).cast("string")) != "", F.lit(False)).cast("int"))
    e = e.withColumns({"concept_match": concept, "topic_match": topic, "provenance": present / 5.0})
    for c in ("class", "subject", "unit"):
        e = e.withColumn(f"{c}_ok", F.col(c) == F.col(f"want_{c}"))
    return e


def scope_gate(evidence: DataFrame) -> DataFrame:
    """Evidence with drop_reason: a wrong class, subject or unit; a missing one passes."""
    wrong = lambda c: F.coalesce(~F.col(f"{c}_ok"), F.lit(False))
    return evidence.withColumn("drop_reason", F.when(wrong("class"), "class").when(wrong("subject"), "subject").when(wrong("unit"), "unit"))


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def score_evidence(evidence: DataFrame, weights: dict | None = None) -> DataFrame:
    """Evidence with fused: the weighted sum of clamped vector, graph, concept, topic and provenance shares (5 digits)."""
    w = weights or DEFAULT.fusion
    parts = {"vector": "vector_score", "graph": "graph_score", "concept": "concept_match", "topic": "topic_match", "provenance": "provenance"}
    total = F.lit(0.0)
    for k, c in parts.items():
        total = total + F.lit(w[k]) * _clamp(F.col(c))
    return evidence.withColumn("fused", F.round(total, 5))


#: Bits of the filter of wanted pieces, as a power of two: 8 MB in 16 parts of equal size, one for each kind of piece. Bytes of
#: text hashed at once in a task. Bytes beside a piece that are compared, the most of these that the smaller text has. Runs among
#: which a text's piece is chosen, and runs of many texts that are known when it is. Letters of an end word that a piece may have.
_FILTER, _KINDS, _SLICE, _BESIDE, _CHOICE, _COMMON, _ENDS = 26, 4, 1 << 19, tuple(1 << k for k in range(12)), 4, 1 << 18, (1, 2, 4)


class _Texts:
    """Lower-case texts of a slice, blanks collapsed, as one array of bytes, with hashes of any stretch of them."""

    base, powers, inverses = 0x9E3779B97F4A7C15, None, None

    def __init__(self, data, ends):
        import numpy as np

        blank = np.isin(data, np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
        again = np.concatenate([[True], blank[:-1]])
        again[ends[:-1][ends[:-1] < len(data)]] = True
        keep = ~(blank & again)
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        data = np.where(blank, np.uint8(32), data)[keep]
        last = ends[1:][ends[1:] > ends[:-1]] - 1
        last = last[data[last] == 32]
        if len(last):
            ends, data = ends - np.searchsorted(last, ends), np.delete(data, last)
        self.data, self.ends, self.size = data, ends, np.diff(ends)
        self.letters = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends])
        if _Texts.powers is None or len(_Texts.powers) <= len(data):
            n = max(_SLICE, len(data)) + 1
            grown = lambda x: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]))
            _Texts.powers, _Texts.inverses = grown(self.base), grown(pow(self.base, -1, 1 << 64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * self.powers[: len(data)], dtype=np.uint64)])
        self.blanks = np.flatnonzero(data == 32)
        self.of = np.searchsorted(ends, self.blanks, "right") - 1
        self.count = np.bincount(self.of, minlength=len(self.size))

    def hashed(self, start, end):
        return _mixed((self.sums[end] - self.sums[start]) * self.inverses[start])

    def runs(self, k):
        """(text, first blank, last blank) of all stretches with ``k`` blanks between their ends."""
        n = max(0, len(self.blanks) - k)
        own = self.of[:n] == self.of[k:]
        return self.of[:n][own], self.blanks[:n][own], self.blanks[k:][own]

    def inside(self, least):
        """(text, start) of all stretches of ``least`` bytes within a word."""
        import numpy as np

        start = np.sort(np.concatenate([self.ends[:-1], self.blanks + 1]))
        size = np.sort(np.concatenate([self.ends[1:], self.blanks])) - start
        start, size = start[size >= least], size[size >= least] - least + 1
        at = np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.searchsorted(self.ends, at, "right") - 1, at


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _rarity(x):
    """Kinds 5 to 15 of runs: by leading zeros of their hash, so that a kind has half the runs of the one before."""
    import numpy as np

    return 5 + np.clip(64 - np.frexp(x.astype(np.float64))[1], 0, 10)


def _slices(batch):
    """(first row, texts) of a batch's ``low`` in slices of about ``_SLICE`` bytes."""
    import numpy as np

    low = batch.column(batch.schema.get_field_index("low"))
    wide = "large" in str(low.type)
    ends = np.frombuffer(low.buffers()[1], np.int64 if wide else np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)
    cut = np.flatnonzero(np.diff((ends[:-1] - ends[0]) // _SLICE)) + 1
    for a, b in zip([0, *cut], [*cut, len(low)]):
        if b > a:
            yield a, _Texts(data[ends[a] : ends[b]], ends[a : b + 1] - ends[a])


def _beside(t, point, before, rest):
    """For each side of ``point``: the number of the longest stretch of ``_BESIDE`` that a text has there, 0 if none, and its hash."""
    import numpy as np

    out = []
    for room, left in ((before, True), (rest, False)):
        level = np.searchsorted(_BESIDE, room, "right")
        c = np.array([0, *_BESIDE])[level]
        h = t.hashed(point - c, point) if left else t.hashed(point, point + c)
        out += [level.astype(np.int32), h.astype(np.uint32).view(np.int32)]
    return out


def _needed_pieces(least: int):
    """For mapInArrow: each text's key and the pieces, as lists, of which whatever contains it must hold every one.

    A contained text's blanks and what lies between them are in its container. Up to four blanks, the piece goes from the first
    to the last one with the nearest letters beyond, the most of ``_ENDS`` that there are (and one each as hash ``y``); of more
    blanks, pieces are the ``_CHOICE`` runs of five whose hashes are least; a single word gives its first ``least`` bytes.
    """

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at, t in _slices(batch):
                first = np.cumsum(t.count) - t.count
                long = np.flatnonzero(t.letters >= least)
                one, few = long[t.count[long] == 0], long[(t.count[long] > 0) & (t.count[long] < 5)]
                a, b = t.blanks[first[few]], t.blanks[first[few] + t.count[few] - 1]
                beside = lambda size: np.array(_ENDS)[np.searchsorted(_ENDS, size, "right") - 1]
                ends = t.hashed(a - beside(a - t.ends[few]), b + 1 + beside(t.ends[few + 1] - b - 1))
                near = np.zeros(len(t.size), np.uint64)
                near[few] = t.hashed(a - 1, b + 2)
                of, runs, last = t.runs(4)
                g, heads = t.hashed(runs, last + 1), np.flatnonzero(np.diff(of, prepend=-1))
                each = np.diff([*heads, len(of)])
                # about so many of the least hashes of each text, and the least one
                bound = np.minimum(2.0**64 * 3 * _CHOICE / np.maximum(each, 1), 2.0**64)
                low = np.flatnonzero((g < np.repeat(bound, each)) | (g == np.repeat(np.minimum.reduceat(g, heads), each))) if len(of) else of
                low = low[np.lexsort((runs[low], g[low], of[low]))]
                low = low[(np.diff(of[low], prepend=-1) != 0) | (np.diff(g[low], prepend=np.uint64(0)) != 0)]
                new = np.flatnonzero(np.diff(of[low], prepend=-1))
                low = low[np.arange(len(low)) - np.repeat(new, np.diff([*new, len(low)])) < _CHOICE]
                low = low[t.letters[of[low]] >= least]
                text = np.concatenate([one, few, of[low]])
                x = np.concatenate([t.hashed(t.ends[one], t.ends[one] + least), ends, g[low]])
                point = np.concatenate([t.ends[one], a, runs[low]])
                kind = np.concatenate([t.count[one], t.count[few], _rarity(g[low])])
                order = np.argsort(text, kind="stable")
                text, x, point, kind = text[order], x[order], point[order], kind[order]
                before = point - t.ends[text]
                own, data = np.flatnonzero(t.size > 0), t.data.tobytes()
                keys = [hashlib.sha256(data[t.ends[i] : t.ends[i + 1]]).digest() for i in own]
                starts = pa.array(np.concatenate([np.searchsorted(text, own), [len(text)]]).astype(np.int32))
                listed = [kind.astype(np.int32), x.view(np.int64), before, *_beside(t, point, before, t.ends[text + 1] - point)]
                rows = [batch.column(batch.schema.get_field_index(c)).slice(at, len(t.size)).take(pa.array(own)) for c in ("query_id", "side", "raw")]
                rows += [pa.array(keys, pa.binary()), pa.array(t.size[own]), pa.array(near[own].view(np.int64))]
                rows += [pa.ListArray.from_arrays(starts, pa.array(v)) for v in listed]
                yield pa.RecordBatch.from_arrays(rows, names=["query_id", "side", "raw", "key", "size", "y", "kind", "x", "before", "n_left", "left", "n_right", "right"])

    return run


def _chosen_pieces(common):
    """For mapInArrow: of each text's pieces the one that fewest texts offer, by the counts of the ``common`` ones, as hash ``g`` of its place."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        many, times = common.value
        names = ["kind", "x", "before", "n_left", "left", "n_right", "right"]
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            starts = column("x").offsets.to_numpy()
            each = np.diff(starts)
            own, heads = np.flatnonzero(each), starts[:-1][each > 0] - starts[0]
            if not len(own):
                continue
            lists = {c: column(c).flatten().to_numpy() for c in names}
            at = np.minimum(np.searchsorted(many, lists["x"]), max(0, len(many) - 1))
            score = np.where(many[at] == lists["x"], times[at], 0) if len(many) else np.zeros(len(lists["x"]), np.int64)
            rank = np.arange(len(score)) - np.repeat(heads, each[own])
            pick = heads + np.minimum.reduceat(score * 64 + rank, heads) % 64
            lists = {c: v[pick] for c, v in lists.items()}
            place, y = (column(c).to_numpy()[own] for c in ("place", "y"))
            near = np.where((lists["kind"] > 0) & (lists["kind"] < 5), y, lists["x"])
            g, near = (_mixed((x ^ place).view(np.uint64)).view(np.int64) for x in (lists["x"], near))
            rows = [column(c).take(pa.array(own)) for c in ("query_id", "side", "raw")]
            rows += [pa.array(v) for v in (g, near, column("size").to_numpy()[own] - lists["before"])]
            rows += [pa.array(lists[c]) for c in names if c != "x"]
            yield pa.RecordBatch.from_arrays(rows, names=["query_id", "side", "raw", "g", "near", "rest", *[c for c in names if c != "x"]])

    return run


def _held_pieces(least: int, wanted):
    """For mapInArrow: the pieces of texts that the filter ``wanted`` lets through, with hashes of what lies beside them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(wanted.value, np.uint8)
        part = _FILTER - _KINDS
        some = [bits[k << part - 3 : k + 1 << part - 3].any() for k in range(1 << _KINDS)]

        def passed(kind, g, shift):
            slot = (kind << part) + ((g >> np.uint64(shift)) & np.uint64((1 << part) - 1)).astype(np.int64)
            return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

        for batch in batches:
            places = batch.column(batch.schema.get_field_index("place")).to_numpy().view(np.uint64)
            for at, t in _slices(batch):
                n, found = len(t.size), []

                def look(kind, of, point, start, end, first=True, last=True):
                    x = t.hashed(start, end)
                    kind = _rarity(x) if kind is None else np.full(len(x), kind, np.int64)
                    g = _mixed(x ^ place[of])
                    own = np.flatnonzero(passed(kind, g, 64 - part)) if first else np.arange(len(g))
                    own = own[passed(kind[own], g[own], 64 - 2 * part)] if last else own
                    if last:
                        found.append((of[own], point[own], g[own]))
                    return own

                place = places[at : at + n]
                if some[0]:
                    of, start = t.inside(least)
                    look(0, of, start, start, start + least)
                for k in range(1, 5):
                    if some[k]:
                        of, a, b = t.runs(k - 1)
                        own = look(k, of, a, a - 1, b + 2, last=False)
                        of, a, b = of[own], a[own], b[own]
                        for left in _ENDS:
                            for right in _ENDS:
                                fit = np.flatnonzero((a - left >= t.ends[of]) & (b + 1 + right <= t.ends[of + 1]))
                                look(k, of[fit], a[fit], a[fit] - left, b[fit] + 1 + right, first=False)
                if any(some[5:]):
                    of, a, b = t.runs(4)
                    look(None, of, a, a, b + 1)
                if not found:
                    continue
                of, point, g = (np.concatenate(v) for v in zip(*found))
                before, rest = point - t.ends[of], t.ends[of + 1] - point
                beside = []
                for room, left in ((before, True), (rest, False)):
                    for c in _BESIDE:
                        c = np.where(room >= c, c, 0)
                        h = t.hashed(point - c, point) if left else t.hashed(point, point + c)
                        beside.append(pa.array(h.astype(np.uint32).view(np.int32)))
                rows = [batch.column(batch.schema.get_field_index(c)).slice(at, n).take(pa.array(of)) for c in ("query_id", "side", "raw")]
                rows += [pa.array(v) for v in (g.view(np.int64), before, rest)] + beside
                yield pa.RecordBatch.from_arrays(rows, names=["query_id", "side", "raw", "g", "before", "rest", *[f"l{c}" for c in _BESIDE], *[f"r{c}" for c in _BESIDE]])

    return run


def _common(pieces: DataFrame):
    """(hashes in order, their counts) of the ``_COMMON`` pieces that most texts offer, of those that more than four do."""
    import numpy as np

    counts = pieces.select(F.explode("x").alias("x")).groupBy("x").agg(F.count("*").alias("n")).where("n > 4")
    rows = sorted(counts.orderBy(F.desc("n"), "x").limit(_COMMON).collect())
    return np.array([r.x for r in rows], np.int64), np.array([r.n for r in rows], np.int64)


def _piece_filter(pieces: DataFrame) -> bytes:
    """A bit for each hash ``near`` and one for each ``g`` in its kind's part; the driver gets at most 2,048 rows of 4 KB, packed by tasks."""
    part = _FILTER - _KINDS
    bit = lambda c, shift: F.col("kind").cast("long") * (1 << part) + F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << part) - 1)) + 1
    slots = pieces.select(F.explode(F.array(bit("near", 64 - part), bit("g", 64 - 2 * part))).alias("s"))
    packed = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = bytearray(1 << (_FILTER - 3))
    for r in packed:
        out[(r["b"] - 1) * len(r["bits"]) : r["b"] * len(r["bits"])] = r["bits"]
    return bytes(out)


#: Texts that met, up to which their hashes go to the tasks that read texts, instead of the texts to them.
_FEW_MET = 1 << 19


def drop_restating_edges(edges: DataFrame, hits: DataFrame, least: int = 12) -> DataFrame:
    """Edges of each query whose source text neither restates a vector hit's text nor repeats an earlier edge.

    Texts compare in lower case with blanks collapsed. Equal texts restate each other, and so does containment either way
    of texts of at least ``least`` characters. A text meets only those of the other side that hold one piece of it
    (``_needed_pieces``) and agree with it in what lies beside. Pieces that no text wants go in the task that reads their text, by a
    filter of 8 MB. No text is written or moved but those that met, once for the exact comparison; the others are read again. Null
    and blank texts restate nothing; blank edges of a query count as one. Copies are compared once.
    """
    from heronlake.sources.staging import written

    norm = lambda c: norm_text(F.coalesce(c, F.lit("")))
    hashed = lambda c: F.unhex(F.sha2(norm(c), 256))
    own = lambda df, c, side: df.where(F.col(c).isNotNull()).select("query_id", F.lit(side).alias("side"), F.col(c).alias("text"), F.xxhash64(c).alias("raw"))
    texts = own(edges, "source_text", "edge").unionByName(own(hits, "text", "hit"))
    other = F.when(F.col("side") == "edge", "hit").otherwise("edge")
    read = lambda side: texts.select("query_id", side.alias("side"), "raw", F.xxhash64("query_id", side).alias("place"), F.lower("text").alias("low"))
    ids = f"query_id {texts.schema['query_id'].dataType.simpleString()}, side string, raw long, "
    lists = "kind array<int>, x array<long>, before array<long>, n_left array<int>, left array<int>, n_right array<int>, right array<int>"
    pieces = written(read(other).mapInArrow(_needed_pieces(least), f"{ids}key binary, size long, y long, {lists}"), "restating-pieces")
    equal = pieces.groupBy("query_id", "key").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a <> b").select("query_id", "key")
    send = texts.sparkSession.sparkContext.broadcast
    placed = pieces.drop("key").withColumn("place", F.xxhash64("query_id", "side"))
    chosen = _chosen_pieces(send(_common(pieces)))
    small = written(placed.mapInArrow(chosen, ids + "g long, near long, rest long, kind int, before long, n_left int, left int, n_right int, right int"), "restating-small")
    wanted = send(_piece_filter(small))
    beside = ", ".join(f"{s}{c} int" for s in "lr" for c in _BESIDE)
    held = read(F.col("side")).mapInArrow(_held_pieces(least, wanted), ids + "g long, before long, rest long, " + beside)
    by = ["query_id", "side", "g"]
    s = small.drop("kind", "near").repartition(*by).distinct().alias("s")
    h = held.repartition(*by).distinct().alias("h")
    agree = lambda n, x, side: F.coalesce(F.get(F.array(*[f"h.{side}{c}" for c in _BESIDE]), F.col(f"s.{n}") - 1) == F.col(f"s.{x}"), F.lit(True))
    fits = F.expr("h.before >= s.before AND h.rest >= s.rest AND h.before + h.rest > s.before + s.rest") & agree("n_left", "left", "l") & agree("n_right", "right", "r")
    met = h.join(s, by).where(fits).select("query_id", "side", F.col("s.raw").alias("small"), F.col("h.raw").alias("large")).distinct()
    met = written(met, "restating-met")
    sides = met.select("query_id", other.alias("side"), F.col("small").alias("raw")).unionByName(met.select("query_id", "side", F.col("large").alias("raw"))).distinct()
    sides = written(sides, "restating-sides")
    few = sides.count() <= _FEW_MET
    bodies = texts.join(F.broadcast(sides) if few else sides, ["query_id", "side", "raw"], "left_semi").select("query_id", "side", "raw", norm("text").alias("norm"))
    bodies = written(bodies.dropDuplicates(["query_id", "side", "raw", "norm"]), "restating-bodies")
    body = lambda name, side: bodies.select("query_id", side.alias("side"), F.col("raw").alias(name), F.col("norm").alias(f"{name}_norm"))
    inside = met.join(body("small", other), ["query_id", "side", "small"]).join(body("large", F.col("side")), ["query_id", "side", "large"]).where(F.contains("large_norm", "small_norm"))
    restated = inside.select("query_id", hashed(F.when(F.col("side") == "hit", F.col("small_norm")).otherwise(F.col("large_norm"))).alias("key")).unionByName(equal).distinct()
    left = edges.withColumn("key", hashed("source_text")).join(restated, ["query_id", "key"], "left_anti")
    return top(left, ["query_id", "key"], [F.asc("id")], 1, "_k").drop("_k", "key")


def fuse_evidence(evidence: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(best evidence by fused score, unique provenance taken before the limit, counts per query)."""
    best = top(evidence, ["query_id"], [F.desc("fused"), F.asc("id")], limit)
    provenance = evidence.select("query_id", F.concat_ws("::", "source_document_id", "chunk_id").alias("provenance")).distinct()
    counts = evidence.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("fused"), 5).alias("best"))
    return best, provenance, counts
