"""Repair of conversation structure: the cheapest edits that make a conversation's roles alternate.

A conversation should have an optional system turn and then pairs of a user's and an assistant's turn, or
nothing. Each turn is kept (0), given the role user or assistant (1) or deleted (2, which blank and repeated
turns must be); empty turns may be inserted (5), and a truncated turn that isn't deleted costs 5 more. Of
the cheapest edit sequences the one whose audit (initials K, R, D, I in order) is least in ASCII is taken.

An edit of a turn with the insertions before it is one step; steps are a prefix-free code, so that audits
compare step by step. A node is a turn and the state before it (nothing, system, user, assistant). First the
cost of the rest is found for each node, then optimal arcs are ranked: nodes are ranked by their least audits
of one step, of two, of four and so on, a node's rank for twice the length being the least pair of its own
rank and that of the node it leads to. With these ranks each node has one next node, and the path from the
start is followed through pointers that double. Costs, ranks and pointers are compositions of 4 x 4 tables,
which are doubled within blocks of turns by arrays and between blocks by joins on the next block, so that
no conversation has to fit in a task: turns are dealt in ranges of (conversation, turn), and blocks are the
stretches of a conversation in them.

Order within a conversation: turn (nulls first), then role, then the digest of the text; repeated rows are
turns of their own, and the second one is a duplicate. Null roles and texts count as one space. A null
conv_id is a conversation. Conversations without turns, and empty tables, give no rows here; extra columns
are ignored. The digest of a conversation and its audit are one value each, so that one task gathers them:
the digest reads turns one after another in little memory.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetsieve.llm.common import crc32_sql, materialise, prepare

ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: The state that a turn's initial leads to, by the state before it: 0 nothing, 1 system, 2 user, 3 assistant.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
RELABEL, DELETE, INSERT, CUT = 1, 2, 5, 5
INITIALS, KINDS = "suao", "kdt"
FAR = 1 << 40
NONE = 1 << 20
#: log2 of the turns of a block, and turns whose tables are in memory together.
BLOCK_BITS, GROUP_ROWS = 10, 16_384


def _insertions(state: int) -> Iterator[tuple[str, int]]:
    """Roles inserted in a state and the state after them; more than two never pay."""
    yield "", state
    for size in (1, 2):
        for roles in product("ua", repeat=size):
            now: int | None = state
            for r in roles:
                now = AFTER[r].get(now)
            if now is not None:
                yield "".join(roles), now


def _moves(initial: str, kind: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(edits, next state, cost) of one turn: inserted roles, then K, D, or U and A for a new role."""
    for roles, now in _insertions(state):
        paid = INSERT * len(roles)
        yield roles + "D", now, paid + DELETE
        if kind != "d":
            paid += CUT if kind == "t" else 0
            if now in AFTER.get(initial, {}):
                yield roles + "K", AFTER[initial][now], paid
            for r in "ua":
                if now in AFTER[r]:
                    yield roles + r.upper(), AFTER[r][now], paid + RELABEL


def audit_of(edits: str) -> str:
    return edits.translate({ord("u"): "I", ord("a"): "I", ord("U"): "R", ord("A"): "R"})


STEPS = sorted({audit_of(e) for i, k, s in product(INITIALS, KINDS, range(4)) for e, _, _ in _moves(i, k, s)})


def _tables() -> tuple[np.ndarray, dict[tuple[int, int, int, int], str]]:
    """Costs by (class of turn, state, step, next state), and the edits that each stands for."""
    cost, edits = np.full((len(INITIALS) * len(KINDS), 4, len(STEPS), 4), FAR, np.int64), {}
    for c, (initial, kind) in enumerate(product(INITIALS, KINDS)):
        for state in range(4):
            for e, after, paid in _moves(initial, kind, state):
                at = (c, state, STEPS.index(audit_of(e)), after)
                cost[at], edits[at] = paid, e
    return cost, edits


COST, EDITS = _tables()
#: By state at the end of a conversation: what is inserted, its cost and its rank among these.
TAIL = [min((r for r, now in _insertions(s) if now in ENDS), key=len) for s in range(4)]
END_COST = np.array([INSERT * len(r) for r in TAIL], np.int64)
END_RANK = np.array([len(r) for r in TAIL], np.int64)


def dense(x: np.ndarray) -> np.ndarray:
    """Ranks from 0 within each row, equal values alike; absent ones stay absent."""
    order = np.argsort(x, axis=1)
    held = np.take_along_axis(x, order, 1)
    up = np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(held[:, 1:] != held[:, :-1], axis=1)], axis=1)
    out = np.empty_like(x)
    np.put_along_axis(out, order, up, 1)
    return np.where(x >= NONE, NONE, out)


def join_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(2), FAR)


def join_ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of audits twice as long: the least pair of ranks over the nodes between."""
    pairs = (a[:, :, :, None] * 32 + b[:, None, :, :]).min(2)
    return dense(pairs.reshape(-1, 16)).reshape(-1, 4, 4)


def join_pointers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.take_along_axis(b, a, 1)


def _suffixes(step: np.ndarray, end: np.ndarray, join: Callable) -> np.ndarray:
    """Each turn's composition up to the end of its block, in lengths that double."""
    out, at, width = step.copy(), np.arange(len(step)), 1
    while len(i := np.flatnonzero(at + width < end)):
        out[i] = join(out[i], out[i + width])
        width *= 2
    return out


def _prefixes(step: np.ndarray, begin: np.ndarray, join: Callable) -> np.ndarray:
    out, at, width = step.copy(), np.arange(len(step)), 1
    while len(i := np.flatnonzero(at - width >= begin)):
        out[i] = join(out[i - width], out[i])
        width *= 2
    return out


class Blocks:
    """Some blocks of turns with their tables; codes hold an initial and a kind for each turn."""

    def __init__(self, codes: list[str]):
        sizes = np.array([len(c) // 2 for c in codes])
        signs = np.frombuffer("".join(codes).encode(), np.uint8).reshape(-1, 2)
        initial = np.select([signs[:, 0] == ord(x) for x in INITIALS], range(len(INITIALS)))
        kind = np.select([signs[:, 1] == ord(x) for x in KINDS], range(len(KINDS)))
        self.kind = initial * len(KINDS) + kind
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.block = np.repeat(np.arange(len(codes)), sizes)
        self.costs = _suffixes(COST.min(2)[self.kind], self.stop[self.block], join_costs)

    def _shift(self, values: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The values of each turn's next turn; those after the block for its last one."""
        out = np.empty_like(values)
        out[:-1] = values[1:]
        out[self.stop - 1] = after
        return out

    def rank(self, cost_after: np.ndarray) -> None:
        """Ranks of least audits from each turn to the end of its block, along optimal arcs."""
        rest = (self.costs + cost_after[self.block][:, None, :]).min(2)
        after = self._shift(rest, cost_after)
        optimal = COST[self.kind] + after[:, None, None, :] == rest[:, :, None, None]
        self.steps = np.where(optimal, np.arange(len(STEPS))[None, None, :, None], NONE).min(2)
        self.ranks = _suffixes(self.steps, self.stop[self.block], join_ranks)

    def point(self, rank_after: np.ndarray) -> None:
        """Each node's next state by step and rank, and the pointers from a block's start through each turn."""
        rest = dense((self.ranks * 32 + rank_after[self.block][:, None, :]).min(2))
        chosen = self.steps * 32 + self._shift(rest, rank_after)[:, None, :]
        self.next = chosen.argmin(2)
        self.through = _prefixes(self.next, self.start[self.block], join_pointers)

    def edits(self, entry: np.ndarray) -> list[list[str]]:
        """The edits of each turn of each block that is entered in a given state."""
        state = np.empty(len(self.kind), np.int64)
        state[1:] = self.through[np.arange(len(state) - 1), entry[self.block[1:]]]
        state[self.start] = entry
        at = np.arange(len(state))
        after = self.next[at, state]
        step = self.steps[at, state, after]
        flat = [EDITS[x] for x in zip(self.kind.tolist(), state.tolist(), step.tolist(), after.tolist())]
        return [flat[a:b] for a, b in zip(self.start.tolist(), self.stop.tolist())]

    def left(self, entry: np.ndarray) -> np.ndarray:
        """The state after each block."""
        return self.through[self.stop - 1, entry]


def _grouped(codes: pd.Series) -> Iterator[slice]:
    first, size = 0, 0
    for i, c in enumerate(codes):
        if size and size + len(c) // 2 > GROUP_ROWS:
            yield slice(first, i)
            first, size = i, 0
        size += len(c) // 2
    if len(codes):
        yield slice(first, len(codes))


def _close(cost: list | None) -> np.ndarray:
    """Cost of the rest by state where a block starts, from its table up to the end of the conversation."""
    return END_COST if cost is None else (np.asarray(cost, np.int64).reshape(4, 4) + END_COST).min(1)


def _close_rank(rank: list | None) -> np.ndarray:
    return END_RANK if rank is None else dense((np.asarray(rank, np.int64).reshape(4, 4) * 32 + END_RANK).min(1)[None])[0]


def _over(codes: pd.Series, *after: pd.Series) -> Iterator[tuple[slice, Blocks]]:
    """Blocks with their costs, and as far as given with ranks and pointers for what follows them."""
    for part in _grouped(codes):
        blocks = Blocks(codes[part].tolist())
        if after:
            blocks.rank(np.stack([_close(x) for x in after[0][part]]))
        if len(after) > 1:
            blocks.point(np.stack([_close_rank(x) for x in after[1][part]]))
        yield part, blocks


@F.pandas_udf(T.ArrayType(T.LongType()))
def block_costs(codes: pd.Series) -> pd.Series:
    return pd.Series([x.ravel() for _, b in _over(codes) for x in b.costs[b.start]], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def block_ranks(codes: pd.Series, cost_after: pd.Series) -> pd.Series:
    return pd.Series([x.ravel() for _, b in _over(codes, cost_after) for x in b.ranks[b.start]], dtype=object)


@F.pandas_udf(T.ArrayType(T.LongType()))
def block_pointers(codes: pd.Series, cost_after: pd.Series, rank_after: pd.Series) -> pd.Series:
    return pd.Series([x for _, b in _over(codes, cost_after, rank_after) for x in b.through[b.stop - 1]], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def block_edits(codes: pd.Series, cost_after: pd.Series, rank_after: pd.Series, before: pd.Series, last: pd.Series) -> pd.Series:
    """Edits of each turn; those of a conversation's last one end with a stroke and the roles inserted after it."""
    out = []
    for part, blocks in _over(codes, cost_after, rank_after):
        entry = np.array([0 if x is None else x[0] for x in before[part]], np.int64)
        made = blocks.edits(entry)
        for edits, state, ends in zip(made, blocks.left(entry).tolist(), last[part]):
            if ends:
                edits[-1] += "|" + TAIL[state]
        out += made
    return pd.Series(out, dtype=object)


def _composed(join: Callable, shape: tuple[int, ...]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def both(a: pd.Series, b: pd.Series) -> pd.Series:
        out, two = a.tolist(), [i for i, x in enumerate(b) if x is not None]
        if two:
            tables = lambda s: np.stack([np.asarray(s[i], np.int64).reshape(shape) for i in two])
            for i, x in zip(two, join(tables(out), tables(b.tolist()))):
                out[i] = x.ravel()
        return pd.Series(out, dtype=object)

    return both


def _doubled(blocks: DataFrame, both: Callable[[Column, Column], Column], pointer: str, rounds: int) -> DataFrame:
    """(block, value) composed along a pointer to another block, over lengths that double."""
    now = blocks
    for _ in range(rounds):
        other = now.select(F.col("block").alias("__block"), F.col(pointer).alias("__pointer"), F.col("value").alias("__value"))
        value = both(F.col("value"), F.col("__value"))
        now = materialise(now.join(other, F.col(pointer) == F.col("__block"), "left").select("block", F.col("__pointer").alias(pointer), value.alias("value")), "doubled")
    return now.select("block", "value")


@dataclass
class Repaired:
    """turns: conv_id, place, nth, role, text of repaired turns in order; report: one row a conversation."""

    turns: DataFrame
    report: DataFrame


def ordered(turns: DataFrame) -> DataFrame:
    """Turns with pos, which grows along (conv_id, turn, role, digest), written in ranges of these."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(" "))
    kept = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"))
    by = ["conv_id", "turn", "role", "digest", "row"]  # row only deals equal turns to several ranges
    cut = kept.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return materialise(cut.drop("row").withColumn("pos", F.monotonically_increasing_id()), "turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """pos, conv_id, part, initial and each turn's first fault: blank, duplicate, truncated or null."""
    first = turns.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    end = F.expr("right(rtrim(' \\t\\n\\u000b\\f\\r', text), 1)")
    told = turns.select("pos", "conv_id", F.substring("role", 1, 1).alias("role"), end.alias("end")).join(first, "pos", "left")
    fault = F.when(F.col("end") == "", "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    initial = F.when(F.col("role").isin("s", "u", "a"), F.col("role")).otherwise("o")
    return told.select("pos", "conv_id", F.shiftright("pos", 33).alias("part"), initial.alias("initial"), fault.alias("fault"))


def _blocks(faults: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """Blocks of turns (named by their first pos) with the next one, and the doublings that reach the last one."""
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("k")
    code = F.struct("pos", F.concat("initial", kind).alias("code"))
    counts = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    blocks = faults.groupBy("conv_id", "part", F.shiftright("pos", bits).alias("chunk")).agg(F.min("pos").alias("block"), F.max("pos").alias("last"), F.array_sort(F.collect_list(code)).alias("codes"), *counts)
    blocks = materialise(blocks.withColumn("codes", F.array_join(F.transform("codes", lambda c: c["code"]), "")), "blocks")
    # one row a conversation and range
    spans = blocks.groupBy("conv_id", "part").agg(F.max("block").alias("final"), F.min("block").alias("first"), F.count("*").alias("n"))
    along = Window.partitionBy("conv_id").orderBy("part")
    spans = spans.select("final", F.lead("first").over(along).alias("beyond"), F.sum("n").over(along).alias("n"))
    spans = materialise(spans, "spans")
    most = spans.agg(F.max("n")).first()[0] or 1
    finals = spans.select(F.col("final"), "beyond")
    joined = blocks.join(finals, F.col("block") == F.col("final"), "left")
    following = F.when(F.col("final").isNull(), F.shiftleft(F.col("chunk") + 1, bits)).otherwise(F.col("beyond"))
    return materialise(joined.select("block", "conv_id", "codes", "blank", "duplicate", "truncated", following.alias("after")), "blocks"), math.ceil(math.log2(most))


def repair(turns: DataFrame, bits: int = BLOCK_BITS) -> Repaired:
    """Repairs conversations (conv_id, turn, role, text); blocks have 2 ** bits turns at most."""
    prepare(turns.sparkSession)
    rows = ordered(turns)
    blocks, rounds = _blocks(with_faults(rows), bits)

    def beyond(table: DataFrame, values: DataFrame, pointer: str, name: str) -> DataFrame:
        other = values.select(F.col("block").alias("__block"), F.col("value").alias(name))
        return table.join(other, F.col(pointer) == F.col("__block"), "left").drop("__block")

    before = blocks.where("after IS NOT NULL").select(F.col("after").alias("__block"), F.col("block").alias("before"))
    blocks = blocks.join(before, F.col("block") == F.col("__block"), "left").drop("__block")
    costs = _doubled(materialise(blocks.select("block", "after", block_costs("codes").alias("value")), "costs"), _composed(join_costs, (4, 4)), "after", rounds)
    costed = beyond(blocks, costs, "after", "cost_after")
    ranks = _doubled(materialise(costed.select("block", "after", block_ranks("codes", "cost_after").alias("value")), "ranks"), _composed(join_ranks, (4, 4)), "after", rounds)
    ranked = materialise(beyond(costed, ranks, "after", "rank_after"), "ranked")
    through = ranked.select("block", "before", block_pointers("codes", "cost_after", "rank_after").alias("value"))
    pointers = _doubled(materialise(through, "pointers"), _composed(lambda a, b: join_pointers(b, a), (4,)), "before", rounds)
    edited = beyond(ranked, pointers, "before", "entered")
    edits = block_edits("codes", "cost_after", "rank_after", "entered", F.col("after").isNull())
    edited = materialise(edited.select("block", "conv_id", "codes", "after", "before", "blank", "duplicate", "truncated", edits.alias("edits")), "edits")

    end = F.array(*[F.lit(int(x)) for x in END_COST])
    whole = F.array_min(F.zip_with(F.slice("value", 1, 4), end, lambda a, b: a + b))
    initials = F.regexp_replace("codes", "(.).", "$1")
    first = edited.select(F.col("block").alias("__block"), F.substring("codes", 1, 1).alias("__next"))
    lines = edited.join(first, F.col("after") == F.col("__block"), "left").join(costs.select("block", whole.alias("whole")), "block", "left")
    chain = F.concat(initials, F.coalesce("__next", F.lit("")))
    legal = F.regexp_count(chain, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    audit = F.translate(F.array_join("edits", ""), "uaUA|", "IIRR")
    lines = lines.select("conv_id", "block", "blank", "duplicate", "truncated", (F.char_length(chain) - 1 - legal).alias("illegal"), F.when(F.col("before").isNull(), F.col("whole")).alias("cost"), audit.alias("audit"))
    told = lines.groupBy("conv_id").agg(
        *[F.sum(x).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    numbers = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("n")).groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    report = told.join(numbers.withColumnRenamed("conv_id", "__conv"), F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")

    each = edited.select(F.col("block").alias("__block"), F.posexplode("edits").alias("__nth", "edit")).select((F.col("__block") + F.col("__nth")).alias("pos"), "edit")
    joined = rows.select("pos", "conv_id", "role", "text").join(each, "pos")
    inserted = lambda signs: F.transform(F.array_remove(F.split(signs, ""), ""), lambda x: F.struct(F.when(x == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text")))
    sign = F.regexp_extract("edit", "[KDUA]", 0)
    role = F.when(sign == "K", F.col("role")).when(sign == "U", F.lit("user")).otherwise(F.lit("assistant"))
    own = F.when(sign == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"))))
    kept = F.concat(inserted(F.regexp_extract("edit", "^[ua]*", 0)), own, inserted(F.regexp_extract("edit", "[|]([ua]*)$", 1)))
    repaired = joined.select("conv_id", F.col("pos").alias("place"), F.posexplode(kept).alias("nth", "turn")).select("conv_id", "place", "nth", "turn.role", "turn.text")
    return Repaired(repaired, report)


def digests(turns: DataFrame) -> DataFrame:
    """sha256 of role:text of a conversation's turns, joined by newlines; the hash is all that is held of one."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for key, line in zip(batch["key"].tolist(), batch["line"].tolist()):
                if state is not None and key == now:
                    state.update(b"\n" + line.encode())
                    continue
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(line.encode())
            yield pd.DataFrame(done, columns=["key", "sha256"])
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["key", "sha256"])

    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    lines = turns.select(key.alias("key"), "place", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("key").sortWithinPartitions("key", "place", "nth").select("key", "line")
    found = dealt.mapInPandas(run, "key string, sha256 string")
    return found.select(F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind).alias("conv_id"), "sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with faults put in by crc32(conv_id:turn) % 20: 0 drops one, 1 empties it, 2 takes its full stops, 3 repeats it, 4 makes it a user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    picked = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return picked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def report(conversations: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row for each conv_id: faults after damage, the cost and audit of its repair and the digest of what comes out."""
    found = repair(damaged(conversations), bits)
    told = found.report.withColumnRenamed("conv_id", "__conv")
    shas = digests(found.turns).withColumnRenamed("conv_id", "__other")
    out = conversations.select("conv_id").distinct()
    out = out.join(told, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("__other")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    classes = list(product(INITIALS, KINDS))
    moves = ", ".join(f"('{classes[c][0]}', '{classes[c][1]}', {s}, '{e}', '{audit_of(e)}', {y}, {COST[c, s, t, y]})" for (c, s, t, y), e in EDITS.items())
    ends = ", ".join(f"({s}, {END_COST[s]}, '{TAIL[s]}')" for s in range(4))
    lines = lambda roles: f"list_transform(list_filter(string_split({roles}, ''), lambda c: c IN ('u', 'a')), lambda c: if(c = 'u', 'user:', 'assistant:'))"
    return f"""
WITH RECURSIVE moves(initial, kind, s, edits, audit, y, paid) AS (VALUES {moves}), ends(s, cost, roles) AS (VALUES {ends}),
keyed AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
damaged AS (SELECT k, turn, if(h = 4, 'user', role) AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(if(h = 3, [0, 1], [0])) AS time FROM keyed WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again FROM placed),
told AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, if(role[1] IN ('s', 'u', 'a'), role[1], 'o') AS initial FROM seen),
coded AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN 't' ELSE 'k' END AS kind, lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair FROM told),
best AS (SELECT k, max(i) + 1 AS i, s, cost, repeat('I', length(roles)) AS audit, {lines("roles")} AS lines FROM coded, ends GROUP BY k, s, cost, roles
    UNION ALL
    SELECT c.k, c.i, m.s, min(m.paid + b.cost), arg_min(m.audit || b.audit, {{'c': m.paid + b.cost, 'a': m.audit || b.audit}}),
        arg_min({lines("m.edits")} || CASE right(m.edits, 1) WHEN 'D' THEN [] WHEN 'K' THEN [c.role || ':' || c.text] WHEN 'U' THEN ['user:' || c.text] ELSE ['assistant:' || c.text] END || b.lines, {{'c': m.paid + b.cost, 'a': m.audit || b.audit}})
    FROM best b JOIN coded c ON c.k = b.k AND c.i = b.i - 1 JOIN moves m ON m.initial = c.initial AND m.kind = c.kind AND m.y = b.s GROUP BY c.k, c.i, m.s),
counts AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY k)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM keyed) o LEFT JOIN counts USING (k) LEFT JOIN best b ON b.k = o.k AND b.i = 1 AND b.s = 0
"""


#: The same result in SQL, turn by turn from the end.
SQL = _sql()
