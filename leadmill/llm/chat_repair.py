"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns by turns, beginning with user.
Each turn may keep its role, take another one (relabel), be joined to the turn before (merge), or have empty
turns put before it (insert); dynamic programming over the automaton of legal turns finds the cheapest repair,
and the repaired sequence is rendered turn by turn.

A turn is a matrix of costs from the role before to the role after it, and matrices are combined by (min, +), which
is associative. So a conversation of any length is cut into blocks of ``BLOCK`` rows that are summed up apart,
blocks are combined in groups of ``FAN`` level by level, the states at the cuts are handed down again, and each
block is traced back by itself: no task holds a whole conversation.

Roles are matched without case and outer space; null and unknown roles must be relabelled, at ``UNKNOWN``. Null
texts are empty. Equal turn numbers are ordered by role and a hash of the text; repeated rows are turns of their own; rows with a
null conv_id form one conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import Cuts, arrow_schema

#: States: before any turn, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("system", "user", "assistant")
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
ENDS = (USER, ASSISTANT)
# Costs. Equal costs are settled by the smaller state.
MERGE, INSERT, RELABEL, UNKNOWN = 2, 3, 4, 2
NEVER = 1 << 40
BLOCK = 4096
FAN = 1024
ACTIONS = ("keep", "merge", "insert", "relabel", "relabel+merge", "relabel+insert")


def _moves() -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, ...]]]:
    """Cost of the step from state to state without relabelling, and the empty turns put in on the way."""
    cost = np.full((4, 4), NEVER, np.int64)
    inserted: dict[tuple[int, int], tuple[int, ...]] = {}
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            ways = [(0, ())] if (s, t) in LEGAL else []
            if s == t:
                ways.append((MERGE, None))
            frontier = [(m,) for m in (SYSTEM, USER, ASSISTANT) if (s, m) in LEGAL and m != SYSTEM]
            for _ in range(2):
                ways += [(INSERT * len(p), p) for p in frontier if (p[-1], t) in LEGAL]
                frontier = [(*p, m) for p in frontier for m in (USER, ASSISTANT) if (p[-1], m) in LEGAL]
            if ways:
                cost[s, t], inserted[s, t] = min(ways, key=lambda w: (w[0], len(w[1] or ())))
    return cost, inserted


MOVE, INSERTED = _moves()


def turn_costs(role: int) -> np.ndarray:
    """Cost from state to state of a turn whose role is ``role`` (0: unknown)."""
    label = np.array([NEVER] + [0 if t == role else UNKNOWN if not role else RELABEL for t in (SYSTEM, USER, ASSISTANT)], np.int64)
    return np.minimum(MOVE + label[None], NEVER)


TURNS = [turn_costs(r) for r in range(4)]


def chain(matrices: list[np.ndarray]) -> np.ndarray:
    """The (min, +) product."""
    out = matrices[0]
    for m in matrices[1:]:
        out = np.minimum((out[:, :, None] + m[None]).min(axis=1), NEVER)
    return out


def path(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The states after each step of a cheapest way from ``entry`` to ``leave``; smaller states on ties."""
    cost = [np.where(np.arange(4) == entry, 0, NEVER)]
    for m in matrices:
        cost.append(np.minimum((cost[-1][:, None] + m).min(axis=0), NEVER))
    states = [leave]
    for m, c in zip(reversed(matrices[1:]), reversed(cost[1:-1])):
        states.append(int(np.argmin(c + m[:, states[-1]])))
    return states[::-1]


def best_end(matrix: np.ndarray) -> int:
    return min(ENDS, key=lambda t: (matrix[START, t], t))


def repair(roles: list[int]) -> list[int]:
    """Repaired roles of a short conversation, given as codes."""
    matrices = [TURNS[r] for r in roles]
    return path(matrices, START, best_end(chain(matrices))) if roles else []


def action(role: int, before: int, after: int) -> tuple[str, tuple[int, ...]]:
    """What is done to a turn, and the roles of the empty turns before it."""
    put = INSERTED[before, after]
    kind = "merge" if put is None else "insert" if put else ""
    if role == after:
        return kind or "keep", put or ()
    return "relabel" + ("+" + kind if kind else ""), put or ()


def _code(role: Column) -> Column:
    name = F.lower(F.trim(role))
    return F.coalesce(*(F.when(name == r, F.lit(i + 1)) for i, r in enumerate(ROLES)), F.lit(0)).cast("int")


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` turns one row (a dict) into tuples of ``schema``."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for batch in batches:
            made = [x for row in batch.to_pylist() for x in fn(row)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), target, strict=True)], schema=target)

    return df.mapInArrow(run, schema)


def _matrix(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(4, 4)


def plan(turns: DataFrame, cuts: Cuts) -> DataFrame:
    """seq, state before and state after of each turn of ``turns`` (conv, seq, code); ``seq`` is the global order."""
    listed = lambda df, keys, cols: df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items"))
    blocks = cuts.write(
        listed(turns.withColumn("block", F.floor(F.col("seq") / BLOCK).cast("bigint")), ["conv", "block"], ["seq", "code"])
        .select("conv", "block", F.col("items.seq").alias("seqs"), F.col("items.code").alias("codes")),
        "blocks",
    )
    sums = lambda row, key: chain([TURNS[c] for c in row[key]]).tobytes()
    level = cuts.write(_map(blocks, lambda r: [(r["conv"], r["block"], sums(r, "codes"))], "conv bigint, block bigint, costs binary"), "level-0")
    levels = []
    while not level.groupBy("conv").count().where("count > 1").isEmpty():
        parents = listed(level.withColumn("parent", F.floor(F.col("block") / FAN).cast("bigint")), ["conv", "parent"], ["block", "costs"])
        parents = cuts.write(parents.select("conv", F.col("parent").alias("block"), F.col("items.block").alias("blocks"), F.col("items.costs").alias("each")), f"children-{len(levels)}")
        levels.append(parents)
        up = lambda r: [(r["conv"], r["block"], chain([_matrix(x) for x in r["each"]]).tobytes())]
        level = cuts.write(_map(parents, up, "conv bigint, block bigint, costs binary"), f"level-{len(levels)}")
    ends = _map(level, lambda r: [(r["conv"], r["block"], START, best_end(_matrix(r["costs"])))], "conv bigint, block bigint, entry int, leave int")
    for parents in reversed(levels):
        def down(r):
            states = path([_matrix(x) for x in r["each"]], r["entry"], r["leave"])
            return [(r["conv"], b, e, l) for b, e, l in zip(r["blocks"], [r["entry"], *states], states)]

        ends = _map(_meet(parents, ends), down, "conv bigint, block bigint, entry int, leave int")

    def trace(r):
        states = path([TURNS[c] for c in r["codes"]], r["entry"], r["leave"])
        return list(zip(r["seqs"], [r["entry"], *states], states))

    return _map(_meet(blocks, ends), trace, "seq bigint, before int, after int")


def _meet(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    ends = ends.select(F.col("conv").alias("c2"), F.col("block").alias("b2"), "entry", "leave")
    return blocks.join(ends, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("block") == F.col("b2"))).drop("c2", "b2")


def format_chats(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", opening: str = "<|{}|>\n", closing: str = "\n"
) -> DataFrame:
    """One row per turn: conv_id, turn, seq (global order), role, new_role, action, n_inserted, rendered.

    The rendered pieces of a conversation, in order of ``seq``, are its repaired sequence.
    """
    cuts = Cuts(rows.sparkSession, "chat")
    picked = rows.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
        F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    ordered = cuts.write(
        picked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "ordered"
    )
    states = plan(ordered.select(F.col("conv_id").alias("conv"), "seq", _code(F.col("role")).alias("code")), cuts)
    known = [(b, a, r) for b, a in INSERTED for r in range(4)]
    facts = {x: action(x[2], x[0], x[1]) for x in known}
    code = F.col("before") * 100 + F.col("after") * 10 + _code(F.col("role"))
    pick = lambda value: F.element_at(F.create_map(*(F.lit(y) for (b, a, r), f in facts.items() for y in (b * 100 + a * 10 + r, value(f)))), code)
    head = lambda s: opening.format(ROLES[s - 1])
    # a merged turn goes on in the turn before it; any other opens its own, after the empty ones put in
    lead = F.element_at(F.create_map(*(
        F.lit(y) for (b, a, r) in known
        for y in (b * 100 + a * 10 + r, "" if INSERTED[b, a] is None else "".join(head(s) + closing for s in INSERTED[b, a]) + head(a))
    )), code)
    names = F.array(*map(F.lit, ("", *ROLES)))
    return ordered.join(states, "seq").select(
        "conv_id", "turn", "seq", "role", names[F.col("after")].alias("new_role"), pick(lambda f: f[0]).alias("action"),
        pick(lambda f: len(f[1])).alias("n_inserted"), F.concat(lead, F.col("text"), F.lit(closing)).alias("rendered"),
    )
