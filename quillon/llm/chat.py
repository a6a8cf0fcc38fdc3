"""Chat formatting by minimum-cost role repair.

A conversation is legal if its roles are walked by a small automaton: an optional system turn,
then user and assistant in turn. Dynamic programming over the automaton finds the cheapest way
to make it so: keep a turn, relabel it, merge it into the turn before, or insert an empty turn.

The programme is a product of small min-plus matrices, so a long conversation is cut into
segments: each segment's matrix is found on its own, the few matrices of a
conversation give the states at the cuts, and then each segment is repaired on its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, runs, stored

ROLES = ("system", "user", "assistant")
START = 3
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
LAST = (1, 2)
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 10**9


def _moves(role: str | None) -> list[tuple[int, int, int, str, int]]:
    """(from, to, cost, action, inserted) for a turn of this role; inserted is -1 for none. The
    order settles ties: keep, merge, relabel, then insertions."""
    own = ROLES.index(role) if role in ROLES else -1
    out = []
    for s in range(4):
        if s != START:
            out.append((s, s, MERGE + (RELABEL if s != own else 0), "merge", -1))
        for t in NEXT[s]:
            out.append((s, t, 0 if t == own else RELABEL, "keep" if t == own else "relabel", -1))
        for mid in NEXT[s]:
            for t in NEXT[mid]:
                out.append((s, t, INSERT + (0 if t == own else RELABEL), "keep" if t == own else "relabel", mid))
    return sorted(out, key=lambda m: (m[2], m[4] >= 0, ("keep", "merge", "relabel").index(m[3]), m[0], m[1], m[4]))


MOVES = {role: _moves(role) for role in (*ROLES, None)}


def _moves_of(role) -> list:
    return MOVES.get(role if isinstance(role, str) else None, MOVES[None])


def _table(roles, entry: int) -> tuple[list[list[int]], list[list[tuple]]]:
    """Least cost of each state after each turn from the entry state, and the last move."""
    cost = [FAR] * 4
    cost[entry] = 0
    costs, links = [cost], []
    for role in roles:
        new, link = [FAR] * 4, [None] * 4
        for move in _moves_of(role):
            c = cost[move[0]] + move[2]
            if c < new[move[1]]:
                new[move[1]], link[move[1]] = c, move
        cost = new
        costs.append(cost)
        links.append(link)
    return costs, links


def repair(roles, entry: int, leave: int) -> list[tuple]:
    """The cheapest moves, one per turn, from the entry state to the leave state."""
    _, links = _table(roles, entry)
    out, at = [], leave
    for link in reversed(links):
        out.append(link[at])
        at = link[at][0]
    return out[::-1]


def end_cost(state: int) -> int:
    return 0 if state in LAST else INSERT if state != START else FAR


def _matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for group in runs(frames, ["conv_key", "segment"]):
        roles = group["role"].tolist()
        matrix = [c for s in range(4) for c in _table(roles, s)[0][-1]]
        rows.append((group["conv_key"].iat[0], group["segment"].iat[0], matrix))
    yield pd.DataFrame(rows, columns=["conv_key", "segment", "matrix"])


def _cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States before and after each segment on the cheapest way through a conversation."""
    rows = []
    for group in runs(frames, ["conv_key"]):
        cost, links = [FAR] * START + [0], []
        for m in group["matrix"]:
            m = np.asarray(m).reshape(4, 4)
            link = [min(range(4), key=lambda s: (cost[s] + m[s][t], s)) for t in range(4)]  # noqa: B023
            cost = [int(cost[s] + m[s][t]) for t, s in enumerate(link)]
            links.append(link)
        at = min(range(4), key=lambda s: (cost[s] + end_cost(s), s))
        total = int(cost[at] + end_cost(at))
        last = len(links) - 1
        for i, (segment, link) in enumerate(zip(reversed(group["segment"].tolist()), reversed(links), strict=True)):
            rows.append((group["conv_key"].iat[0], segment, link[at], at, i == 0, last == i, total))
            at = link[at]
    yield pd.DataFrame(rows, columns=["conv_key", "segment", "entry", "leave", "is_last", "is_first", "repair_cost"])


def _render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for some in _batches(runs(frames, ["conv_key", "segment"])):
        lots = []
        for group in some:
            moves = repair(group["role"].tolist(), group["entry"].iat[0], group["leave"].iat[0])
            text, chunks = group["text"].tolist(), []
            for i, (s, t, _, action, mid) in enumerate(moves):
                body = text[i] if isinstance(text[i], str) else ""
                if action == "merge":
                    chunks.append("\n" + body)
                    continue
                head = "" if s == START else "<|end|>\n"
                if mid >= 0:
                    head += f"<|{ROLES[mid]}|>\n<|end|>\n"
                chunks.append(f"{head}<|{ROLES[t]}|>\n{body}")
            if group["is_last"].iat[0]:
                at = moves[-1][1]
                chunks[-1] += "<|end|>\n" if at in LAST else "<|end|>\n<|user|>\n<|end|>\n"
            lots.append(group[["conv_key", "turn_text", "repair_cost", "place"]].assign(action=[m[3] for m in moves], out_role=[ROLES[m[1]] for m in moves], inserted=[ROLES[m[4]] if m[4] >= 0 else None for m in moves], rendered=chunks))
        out = pd.concat(lots)
        yield out[["conv_key", "turn_text", "place", "action", "out_role", "inserted", "rendered", "repair_cost"]]


def _batches(groups: Iterator[pd.DataFrame], rows: int = 5000) -> Iterator[list[pd.DataFrame]]:
    held, n = [], 0
    for g in groups:
        held.append(g)
        n += len(g)
        if n >= rows:
            yield held
            held, n = [], 0
    if held:
        yield held


def repair_chats(turns: DataFrame, segment_turns: int = 1024) -> DataFrame:
    """Repair and render conversations, turns (conv_id, turn, role, text).

    One row per input row: conv_id, turn, place (which orders a conversation), action (keep,
    relabel, merge), out_role, inserted (role of an empty turn put before it, or null), rendered (its part of the conversation's text, to be
    joined in order; the last part closes it), repair_cost (of the whole conversation: merge 1,
    relabel 2, insertion 3 each). Turns are ordered by turn (nulls last), role, text. Unknown and
    null roles are relabelled; null texts are empty; rows with a null conv_id form one
    conversation; repeated rows are turns of their own. A conversation must end with a user or
    assistant turn. Further columns are ignored; an empty table gives an empty result.

    Rows are numbered by range partitions, and segments of about segment_turns rows are cut by
    number: a conversation of any length, equal or null turn numbers included, is many tasks' work.
    """
    keyed = turns.select("turn", "role", "text", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")).alias("conv_key"))
    n, order = parts(turns), [F.col("conv_key"), F.asc_nulls_last("turn"), F.col("role"), F.col("text")]
    ranged = stored(keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    keyed = ranged.withColumn("part", part).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "before", "at")
    keyed = keyed.withColumn("segment", F.floor(F.col("place") / segment_turns))
    order = ["conv_key", "segment", "place"]
    dealt = keyed.select("conv_key", "segment", "place", "role").repartition(n, "conv_key", "segment").sortWithinPartitions(*order)
    matrices = dealt.mapInPandas(_matrices, "conv_key string, segment long, matrix array<long>")
    cuts = matrices.repartition(n, "conv_key").sortWithinPartitions("conv_key", "segment").mapInPandas(_cuts, "conv_key string, segment long, entry int, leave int, is_last boolean, is_first boolean, repair_cost long")
    types = dict(turns.dtypes)
    schema = "conv_key string, turn_text string, place long, action string, out_role string, inserted string, rendered string, repair_cost long"
    joined = keyed.join(cuts, ["conv_key", "segment"]).repartition(n, "conv_key", "segment").sortWithinPartitions(*order)
    sent = joined.select("conv_key", "segment", "place", F.col("turn").cast("string").alias("turn_text"), "role", "text", "entry", "is_last", "leave", "repair_cost")
    out = sent.mapInPandas(_render, schema)
    conv = F.when(F.col("conv_key") != "n", F.substring("conv_key", 2, 1 << 30)).cast(types["conv_id"])
    return out.select(conv.alias("conv_id"), F.col("turn_text").cast(types["turn"]).alias("turn"), *out.columns[2:])


def whole_chats(rendered: DataFrame) -> DataFrame:
    """Each conversation's text as one row: conv_id, text, n_turns, repair_cost. The rendered parts
    meet in one value, so a conversation must fit into a string."""
    part = F.struct(F.col("turn").isNull().alias("late"), "turn", "place", "rendered")
    return rendered.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("repair_cost").alias("repair_cost")).select("conv_id", F.concat_ws("", F.col("parts.rendered")).alias("text"), F.size("parts").alias("n_turns"), "repair_cost")
