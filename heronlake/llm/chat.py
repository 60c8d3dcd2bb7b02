"""Chat formatting: transcripts to canonical turns by a hidden Markov model over lines.

A line's features are its speaker marker, its length (a blank line is a length of its own) and its opening. Hidden states
are (role, opens a turn, goes on, or a gap in it). Viterbi recovers the states; a turn is a run of lines that one opener
starts. Nothing but the lines' own text and order tells where a turn begins: a blank line may part turns or paragraphs.

Lines are sorted across the cluster and cut into blocks of at most BLOCK_LINES. A conversation inside one block is
decoded there. For a longer one each block gives only its max-plus matrix, the few matrices of the conversation settle
the states at the block edges, and the blocks are decoded between fixed edges, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.shared import stage

ROLES = ("system", "user", "assistant", "other")
OPENS, GOES_ON, GAP = "opens", "goes on", "gap"
STATES = [(r, kind) for r in ROLES for kind in (OPENS, GOES_ON, GAP)]
BLOCK_LINES = 4096
#: How transcripts name speakers.
MARKERS = {
    "system": ("system", "instructions"),
    "user": ("user", "human", "question", "customer", "q"),
    "assistant": ("assistant", "ai", "bot", "answer", "agent", "a"),
    "other": ("other", "tool", "function", "observation"),
}
_NAMES = "|".join(n for ns in MARKERS.values() for n in ns)
MARKER = rf"(?i)^\s*(?:\*\*|\[|<\|?|###? ?)?({_NAMES})(?:\*\*|\]|\|?>)?\s*(?:[:>\-](?:\*\*)?\s*|$|(?<=[\]>])\s*)"
N_OBS = (len(ROLES) + 1) * 4 * 2


def is_gap(line: Column) -> Column:
    """Whether a line is blank."""
    return ~line.rlike(r"\S")


def observe(line: Column) -> Column:
    """The feature code of a line: marker role (or none), length class (blank is one), opens with a capital."""
    name = F.lower(F.regexp_extract(line, MARKER, 1))
    role = F.lit(0)
    for k, r in enumerate(ROLES):
        role = F.when(name.isin(*MARKERS[r]), F.lit(k + 1)).otherwise(role)
    size = F.when(is_gap(line), 0).when(F.length(line) < 40, 1).when(F.length(line) < 200, 2).otherwise(3)
    capital = line.rlike(r"^\s*\p{Lu}").cast("int")
    return ((role * 4 + size) * 2 + capital).cast("int")


def body(line: Column) -> Column:
    """A line without its speaker marker."""
    return F.regexp_replace(line, MARKER, "")


@dataclass
class Model:
    """Log probabilities: first state, state after state, feature code in state."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def fit(lines: DataFrame) -> Model:
    """Count (conv_id, turn, idx, role, line) with known roles; only the counts, of fixed size, are collected.

    Null lines count as blank, rows of other roles are left out, other columns are ignored. An empty table gives the
    prior alone.
    """
    order = Window.partitionBy("conv_id", "turn").orderBy("idx", "line")
    text = F.coalesce(F.col("line").cast("string"), F.lit(""))
    own = lines.where(F.col("role").isin(*ROLES)).select("conv_id", "turn", "idx", "role", text.alias("line"))
    said = F.sum((~is_gap(F.col("line"))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("kind", F.when(is_gap(F.col("line")), GAP).when(said == 1, OPENS).otherwise(GOES_ON))
    state = F.coalesce(*[F.when((F.col("role") == r) & (F.col("kind") == kind), F.lit(i)) for i, (r, kind) in enumerate(STATES)])
    own = own.select("conv_id", "turn", "idx", state.alias("s"), observe(F.col("line")).alias("obs"), F.lead(state).over(order).alias("next"))
    own = stage(own, "chat-states")  # read by each count below
    n = len(STATES)
    emit, step, start = np.ones((n, N_OBS)) * 0.1, np.ones((n, n)) * 0.01, np.ones(n) * 0.1
    for i, (r, kind) in enumerate(STATES):  # a named speaker opens a turn of that role, were there no examples
        if kind == OPENS:
            emit[i, (ROLES.index(r) + 1) * 8 : (ROLES.index(r) + 2) * 8] += 1
            step[:, i] = 0.5
        else:
            emit[i, 8:] = 0.001
    for r in own.groupBy("s", "obs").count().collect():
        emit[r["s"], r["obs"]] += r["count"]
    for r in own.where("next IS NOT NULL").groupBy("s", "next").count().collect():
        step[r["s"], r["next"]] += r["count"]
    # what follows a turn: pairs of neighbouring turns, joined on the turn number so that no conversation is held whole
    turns = own.groupBy("conv_id", "turn").agg(F.min_by("s", "idx").alias("first"), F.max_by("s", "idx").alias("last"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("first").alias("next"))
    for r in turns.join(after, ["conv_id", "turn"]).groupBy("last", "next").count().collect():
        step[r["last"], r["next"]] += r["count"]
    for r in turns.where("turn = 0").groupBy("first").count().collect():
        start[r["first"]] += r["count"]
    for i, (r, kind) in enumerate(STATES):  # a line that goes on, or a gap, belongs to the role before it
        for j, (q, other) in enumerate(STATES):
            if other != OPENS and q != r:
                step[i, j] = 0
        if kind != OPENS:
            start[i] = 0
    with np.errstate(divide="ignore"):
        return Model(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), np.log(emit / emit.sum(axis=1, keepdims=True)))


def viterbi(model: Model, obs: np.ndarray, first: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """The likeliest states of a block, given a log weight of each first state and, if there is one, of each last state."""
    n, score = len(obs), first + model.emit[:, obs[0]]
    back = np.zeros((n, len(score)), np.int8)
    for t in range(1, n):
        ways = score[:, None] + model.step
        back[t] = ways.argmax(axis=0)
        score = ways.max(axis=0) + model.emit[:, obs[t]]
    path = np.zeros(n, np.int8)
    path[-1] = int(np.argmax(score if last is None else score + last))
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def block_matrix(model: Model, obs: np.ndarray) -> np.ndarray:
    """Max-plus product over a block: best log weight from each state on its first line to each on its last."""
    s = len(model.start)
    m = np.full((s, s), -np.inf)
    np.fill_diagonal(m, model.emit[:, obs[0]])
    for o in obs[1:]:
        m = (m[:, :, None] + model.step[None, :, :]).max(axis=1) + model.emit[:, o][None, :]
    return m


def edge_states(model: Model, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(first state, last state) of each block of one conversation, from the blocks' matrices alone."""
    score, ways = model.start, []
    for k, m in enumerate(matrices):
        into = score if k == 0 else (score[:, None] + model.step)
        entry = into if k == 0 else into.max(axis=0)
        came = None if k == 0 else into.argmax(axis=0)
        total = entry[:, None] + m
        ways.append((came, total.argmax(axis=0)))
        score = total.max(axis=0)
    out, end = [], int(np.argmax(score))
    for came, entry in reversed(ways):
        begin = int(entry[end])
        out.append((begin, end))
        end = int(came[begin]) if came is not None else 0
    return out[::-1]


# ids travel as strings: beside a null, pandas would turn them to floating point
_BLOCK = "conv_id string, part int, block int, whole boolean, turns array<int>, obs array<int>, lines array<string>, roles array<int>, matrix array<double>"


def parse(lines: DataFrame, model: Model, order: list[str]) -> DataFrame:
    """conv_id, part, block, k, line, state: the state of every line of every conversation.

    ``lines`` has conv_id, line and the columns of ``order``; others are ignored. A null line counts as blank. Lines that
    tie in ``order`` are ordered by their text. A null conv_id is a conversation of its own. Empty in, empty out.
    """
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("line").cast("string"), F.lit(""))
    coded = lines.select("conv_id", *order, text.alias("line"), observe(text).alias("obs"))
    keys = ["conv_id", *order, "line", "_salt"]
    coded = coded.withColumn("_salt", F.xxhash64("line", F.rand(11)))  # equal rows may part between tasks
    ranged = coded.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at, block, first = [], None, 0, True

        def row(ids, part, block, whole):
            obs = np.array([x[1] for x in held], np.int64)
            if whole:
                roles, matrix = viterbi(model, obs, model.start).tolist(), None
            else:
                roles, matrix = None, block_matrix(model, obs).ravel().tolist()
            return (ids, part, block, whole, None, obs.tolist(), [x[0] for x in held], roles, matrix)

        names = ["conv_id", "part", "block", "whole", "turns", "obs", "lines", "roles", "matrix"]
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"conv_id": object})
        part = 0
        for pdf in batches:
            rows = []
            for conv, line, obs, part in zip(pdf["conv_id"], pdf["line"], pdf["obs"], pdf["part"]):
                conv = None if pd.isna(conv) else conv
                if held and conv != at:
                    rows.append(row(at, part, block, block == 0 and not first))  # the task's first may go on from before
                    held, block, first = [], 0, False
                elif len(held) == BLOCK_LINES:
                    rows.append(row(at, part, block, False))
                    held, block = [], block + 1
                at = conv
                held.append((line, obs))
            if rows:
                yield frame(rows)
        if held:
            yield frame([row(at, part, block, False)])

    blocks = stage(ranged.select(F.col("conv_id").cast("string").alias("conv_id"), "line", "obs", "part").mapInPandas(cut, _BLOCK), "chat-blocks")

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "block"])
        s = len(model.start)
        got = edge_states(model, [np.array(m, float).reshape(s, s) for m in pdf["matrix"]])
        return pd.DataFrame({"conv_id": pdf["conv_id"], "part": pdf["part"], "block": pdf["block"], "begin": [a for a, _ in got], "end": [b for _, b in got]})

    # a conversation's matrices number its lines / BLOCK_LINES; those of a third of 10^9 lines are 80,000 small rows
    settled = blocks.where("NOT whole").select("conv_id", "part", "block", "matrix").groupBy("conv_id").applyInPandas(edges, "conv_id string, part int, block int, begin int, end int")

    @F.pandas_udf("array<int>")
    def decode(obs: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for o, a, b in zip(obs, begin, end):
            first, last = (np.full(len(model.start), -np.inf) for _ in range(2))
            first[int(a)] = last[int(b)] = 0.0
            out.append(viterbi(model, np.array(o, np.int64), first, last).tolist())
        return pd.Series(out)

    open_ = blocks.where("NOT whole").alias("b").join(settled.alias("s"), F.expr("b.conv_id <=> s.conv_id AND b.part = s.part AND b.block = s.block"))
    open_ = open_.select("b.conv_id", "b.part", "b.block", "b.lines", decode("b.obs", "s.begin", "s.end").alias("roles"))
    done = blocks.where("whole").select("conv_id", "part", "block", "lines", "roles").unionByName(open_)
    done = done.withColumn("conv_id", F.col("conv_id").cast(lines.schema["conv_id"].dataType))
    return done.select("conv_id", "part", "block", F.posexplode(F.arrays_zip("lines", "roles")).alias("k", "x")).select("conv_id", "part", "block", "k", F.col("x.lines").alias("line"), F.col("x.roles").alias("state"))


def render(parsed: DataFrame) -> DataFrame:
    """conv_id, turn (from 0), role, n_lines, text: canonical turns as ``<|role|>`` line, body, ``<|end|>``.

    Turns are counted within each block and the blocks' counts summed, so only one row per block meets in a conversation.
    Blank lines inside a turn stay, those at its ends go. Lines before any opener are turn -1. Columns other than those of
    ``parse`` are ignored; empty in, empty out.
    """
    w = Window.partitionBy("conv_id", "part", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.array(*[F.lit(int(kind == OPENS)) for _, kind in STATES])
    names = F.array(*[F.lit(r) for r, _ in STATES])
    numbered = parsed.withColumn("own", F.sum(F.get(opens, F.col("state"))).over(w))
    counts = parsed.groupBy("conv_id", "part", "block").agg(F.sum(F.get(opens, F.col("state"))).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part", "block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = numbered.join(bases, F.expr("conv_id <=> c AND part = p AND block = b")).withColumn("turn", F.col("base") + F.col("own") - 1)
    said = F.struct("part", "block", "k", body(F.col("line")).alias("line"))
    turns = placed.groupBy("conv_id", "turn").agg(F.min(F.get(names, F.col("state"))).alias("role"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(said)).alias("lines"))
    text = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    return turns.select("conv_id", "turn", "role", "n_lines", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("text"))


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, idx, role, line: transcript lines of (conv_id, turn, role, text), as people write them down.

    Each conversation has one of five marker styles. One turn in eight has lost its marker, one line break in three inside
    a turn is a paragraph break with a blank line, and in three of the styles a blank line follows four turns in five, so
    neither a marker nor a blank line tells where a turn begins. Null turns come first, a null role counts as user, roles
    that are none of ROLES as other; null text is a blank line.
    """
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(-1))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    role = F.coalesce(F.lower(F.col("role").cast("string")), F.lit("user"))
    role = F.when(role.isin(*ROLES), role).otherwise(F.lit("other"))
    style = F.pmod(F.xxhash64(conv), F.lit(5))
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").when(role == "other", "Tool").otherwise("Instructions")
    short = F.when(role == "user", "Q").when(role == "assistant", "A").when(role == "other", "Tool").otherwise("System")
    named = F.initcap(role)
    mark = (
        F.when(style == 0, F.concat(named, F.lit(": ")))
        .when(style == 1, F.concat(human, F.lit(" - ")))
        .when(style == 2, F.concat(F.lit("["), role, F.lit("] ")))
        .when(style == 3, F.concat(F.lit("**"), named, F.lit(":** ")))
        .otherwise(F.concat(short, F.lit(": ")))
    )
    lost = F.pmod(F.xxhash64(conv, turn), F.lit(8)) == 0
    parted = (style < 3) & (F.pmod(F.xxhash64(turn, conv), F.lit(5)) != 0)
    paragraphs = F.transform(
        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"),
        lambda x, i: F.when((i > 0) & (F.pmod(F.xxhash64(conv, turn, i), F.lit(3)) == 0), F.concat(F.lit("\n"), x)).otherwise(x),
    )
    said = F.concat(F.when(lost, F.lit("")).otherwise(mark), F.array_join(paragraphs, "\n"), F.when(parted, F.lit("\n")).otherwise(F.lit("")))
    written = conversations.select(F.col("conv_id").cast("long").alias("c"), turn.alias("t"), role.alias("r"), F.split(said, "\n").alias("said"))
    return written.select(F.col("c").alias("conv_id"), F.col("t").alias("turn"), F.col("r").alias("role"), F.posexplode("said").alias("idx", "line"))


def held_out(conv_id: Column) -> Column:
    """Conversations that a model is tested on: crc32 of the id as text, modulo 4, is 2. A null id is not among them."""
    return F.coalesce(F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
