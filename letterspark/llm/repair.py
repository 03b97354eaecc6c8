"""Repair of the structure of conversations by depth-first branch-and-bound.

Turns are edited so that role initials read ``(s?(ua)+)?``: keep (K, 0), give the role user
or assistant (R, 3), delete (D, 4; needed for blank and duplicate turns), insert an empty
user or assistant turn (I, 3); a truncated turn that stays adds 3. Of the cheapest edits
those win whose initials, in order, are least as ASCII.

``search`` keeps its nodes on an explicit stack: (turn, state of the role pattern), cost and
edits so far. A suffix bound, the cost of the remaining turns if they might stop in any
state, and the incumbent (cost, edits) cut branches off; a table for each node keeps the
least (cost, edits) that reached it and cuts off worse prefixes. Branches go by bound, then
by initial; the search ends when the stack is empty, so the incumbent is proved best.

No task holds a whole conversation: turns are sorted into contiguous ranges over all
conversations, and a range solves each conversation in blocks of at most ``BLOCK`` turns.
A conversation that lies in one block is solved at once. For the others each block is
solved between all states of the pattern (sixteen searches at most); a second search over
these few numbers (costs, and ranks of the edits) picks each block's pair of states.

Defined results: a null role or text is one space; null turns come first; turns of equal
number go by role, then text, as UTF-8 bytes. Rows equal in all four are counted before
they are sorted, so that many copies are one row on the way. A null conversation is one of
its own. Other columns are ignored. Texts are compared by SHA-256. A conversation without
turns left has zeros and no edits; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from letterspark.llm.common import bound_batches, publish
from letterspark.plans.prefix import join_on, ranged

BLOCK = 512
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: States of the role pattern: nothing yet, behind the system turn, behind a user, behind an assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (NONE, ASSISTANT)
_KEEP = {("s", NONE): SYSTEM, ("u", NONE): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}

#: A turn as the search sees it: its role's initial (empty: it must go) and what it costs to leave it.
Turn = tuple[str, int]
Best = tuple[int, str]


def next_state(state: int) -> int:
    """The state behind the one role that may be inserted or given."""
    return ASSISTANT if state == USER else USER


@cache
def branches(initial: str, cut: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """Edits of one turn in a state: (initial of the edit, cost, state behind it)."""
    out = [("D", DELETE, state)]
    if initial:
        kept = _KEEP.get((initial, state))
        out.append(("K", cut, kept) if kept is not None else ("R", REROLE + cut, next_state(state)))
    return tuple(out)


def bounds(turns: list[Turn], finals: tuple[int, ...] = FINAL) -> list[list[float]]:
    """For each turn and state, the least cost from there on, if a conversation that must stop behind a user or assistant might stop behind either."""
    ends = {e for f in finals for e in ((USER, ASSISTANT) if f in (USER, ASSISTANT) else (f,))}
    out = [[0.0 if s in ends else inf for s in range(4)]]
    for initial, cut in reversed(turns):
        edit = [min(cost + out[-1][to] for _, cost, to in branches(initial, cut, s)) for s in range(4)]
        out.append([min(edit[s], INSERT + edit[next_state(s)], 2 * INSERT + edit[next_state(next_state(s))]) for s in range(4)])
    return out[::-1]


def explore(root: tuple, empty, final: Callable[[tuple], bool], children: Callable[[tuple], list[tuple]], bound: Callable[[tuple], float]) -> tuple | None:
    """Depth-first branch-and-bound: the least (cost, edits) from ``root`` to a final node.

    ``children(node)``: (edit, cost, node). Edits are strings or tuples, from ``empty`` on, and are compared in order.
    """
    incumbent: tuple | None = None
    table: dict[tuple, tuple] = {}
    stack = [(root, 0, empty)]
    while stack:
        node, cost, edits = stack.pop()
        least = cost + bound(node)
        if least == inf or incumbent is not None and (least > incumbent[0] or least == incumbent[0] and edits > incumbent[1][: len(edits)]):
            continue
        if node in table and table[node] <= (cost, edits):
            continue
        table[node] = cost, edits
        if final(node) and (incumbent is None or (cost, edits) < incumbent):
            incumbent = cost, edits
        found = [(cost + c + bound(to), e, cost + c, to) for e, c, to in children(node)]
        for _, e, c, to in sorted(found, reverse=True):  # the least bound, then the least initial, is popped first
            stack.append((to, c, edits + e))
    return incumbent


def search(turns: list[Turn], start: int = NONE, finals: tuple[int, ...] = FINAL, last: bool = True) -> Best | None:
    """The cheapest edits of ``turns`` from a state to one of ``finals``, with least initials; inserts behind the last turn only if ``last``."""
    n, suffix = len(turns), bounds(turns, finals)

    def children(node: tuple) -> list[tuple]:
        at, state, inserted = node
        out = [("I", INSERT, (at, next_state(state), inserted + 1))] if inserted < 2 and (at < n or last) else []
        return out + ([(e, cost, (at + 1, to, 0)) for e, cost, to in branches(*turns[at], state)] if at < n else [])

    return explore((0, start, 0), "", lambda node: node[0] == n and node[1] in finals, children, lambda node: suffix[node[0]][node[1]])


Choice = dict  # start, end, cost, rank


def choices(turns: list[Turn]) -> list[dict]:
    """The best edits of a block between each two states, and their rank among all."""
    found = [(s, e, best) for s in range(4) for e in range(4) if (best := search(turns, s, (e,), False))]
    ranks = {audit: k for k, audit in enumerate(sorted({best[1] for _, _, best in found}))}
    return [{"start": s, "end": e, "cost": best[0], "rank": ranks[best[1]], "audit": best[1]} for s, e, best in found]


#: Inserts behind the last block, by state: initials and cost.
_TAIL = {NONE: ("", 0), SYSTEM: ("II", 2 * INSERT), USER: ("I", INSERT), ASSISTANT: ("", 0)}


def chain(blocks: list[list[Choice]]) -> list[tuple[int, int]]:
    """The pair of states of each block on the best way through all."""
    n = len(blocks)
    suffix = [[0.0] * 4]
    for block in reversed(blocks):
        suffix.append([min((c["cost"] + suffix[-1][c["end"]] for c in block if c["start"] == s), default=inf) for s in range(4)])
    suffix.reverse()

    def children(node: tuple) -> list[tuple]:
        at, state, _ = node
        if at < n:
            return [(((c["rank"], state, c["end"]),), c["cost"], (at + 1, c["end"], 0)) for c in blocks[at] if c["start"] == state]
        tail, cost = _TAIL[state]
        return [(((len(tail), state, state),), cost, (n + 1, state, 0))] if at == n else []

    best = explore((0, NONE, 0), (), lambda node: node[0] == n + 1, children, lambda node: suffix[min(node[0], n)][node[1]])
    return [(s, e) for _, s, e in best[1][:-1]]


def apply_edits(turns: list[tuple[str, str]], audit: str, state: int) -> tuple[list[dict], int]:
    """The turns (role, text) after the edits, and the state behind them."""
    out, k = [], 0
    for edit in audit:
        given = "assistant" if state == USER else "user"
        if edit == "I":
            out.append({"role": given, "text": ""})
            state = next_state(state)
            continue
        role, text = turns[k]
        k += 1
        if edit == "K":
            out.append({"role": role, "text": text})
            state = _KEEP[role[:1], state]
        elif edit == "R":
            out.append({"role": given, "text": text})
            state = next_state(state)
    return out, state


_TURNS = "array<struct<role: string, text: string>>"
_CHOICES = "array<struct<start: int, end: int, cost: long, rank: int, audit: string>>"
_FAULTS = "blank long, duplicate long, truncated long, illegal long, first string, last string"
_LEGAL = ("su", "ua", "au")


class _Block:
    """Turns of one conversation that stand together, and its row of the result."""

    def __init__(self, number: int):
        self.number, self.turns, self.codes, self.faults = number, [], [], []

    def add(self, role: str, text: str, fault: str) -> None:
        self.turns.append((role, text))
        self.codes.append(("" if fault in ("blank", "duplicate") else role[:1] or "?", CUT if fault == "truncated" else 0))
        self.faults.append(fault)

    def row(self, conv, whole: bool) -> dict:
        initials = [role[:1] for role, _ in self.turns]
        out = {"conv": conv, "block": self.number, "whole": whole, "first": initials[0], "last": initials[-1], **{f: self.faults.count(f) for f in ("blank", "duplicate", "truncated")}}
        out["illegal"] = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        if not whole:
            return out | {"turns": [{"role": r, "text": t} for r, t in self.turns], "choices": choices(self.codes)}
        cost, audit = search(self.codes)
        return out | {"cost": cost, "audit": audit, "turns": apply_edits(self.turns, audit, NONE)[0]}


def faults(df: DataFrame, conv: Column, turn: Column, role: Column, text: Column) -> DataFrame:
    """Distinct rows ``(conv, turn, role, text, n, fault)``: how often each occurs, and the first fault of its first occurrence ('' for none)."""
    space = F.lit(" ")
    rows = df.select(conv.alias("conv"), turn.alias("turn"), F.coalesce(role, space).alias("role"), F.coalesce(text, space).alias("text")).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("_sha", F.sha2("text", 256)).withColumn("_order", F.struct(F.col("turn").isNotNull(), F.col("turn")))
    first = rows.groupBy("conv", "role", "_sha").agg(F.min("_order").alias("_first"))
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(bare == "", "blank").when(F.col("_order") > F.col("_first"), "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return join_on(rows, first, ["conv", "role", "_sha"]).select("conv", "turn", "role", "text", "n", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """Rows ``(conv, block, cost, audit, turns, blank, duplicate, truncated, illegal, first, last)`` from those of ``faults``.

    Blocks of a conversation are ascending; what they hold, in order, is the conversation's. ``illegal`` counts inside a
    block, ``first`` and ``last`` are the initials at its ends before the edits.
    """
    bound_batches(rows)
    kind = rows.schema["conv"].dataType.simpleString()
    head = F.left("text", F.lit(64))  # keys of ranges are sampled: no whole texts
    ordered, number = ranged(rows.withColumn("_head", head), "conv", "turn", "role", "_head")
    ordered = ordered.withColumn("_range", number.cast("long")).sortWithinPartitions("_range", "conv", "turn", "role", "text")
    schema = f"conv {kind}, block long, whole boolean, cost long, audit string, turns {_TURNS}, choices {_CHOICES}, {_FAULTS}"
    limit = BLOCK

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple]:
            """(conversation, block, whether the conversation begins and ends with it in this range)."""
            now, block, begins, after = None, None, False, 0
            for batch in batches:
                for r in batch.to_pylist():
                    key = r["_range"], r["conv"]
                    if block is not None and key != now:
                        yield now, block, begins, key[0] == now[0]
                        begins, after = key[0] == now[0], after + 1 if key[0] == now[0] else 0
                        block = None
                    now = key
                    for k in range(r["n"]):
                        if block is not None and len(block.turns) == limit:
                            yield now, block, False, False
                            block, begins, after = None, False, after + 1
                        block = block or _Block((key[0] << 32) + after)
                        block.add(r["role"], r["text"], r["fault"] if not k or r["fault"] == "blank" else "duplicate")
            if block is not None:
                yield now, block, begins, False

        held, size = [], 0
        for (_, conv), block, begins, ends in blocks():
            held.append(block.row(conv, begins and ends))
            size += sum(len(t) for _, t in block.turns)
            if size > 1 << 20 or len(held) == 1000:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    solved = publish(ordered.mapInArrow(solve, schema))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        pairs = chain(table.column("choices").to_pylist())
        last = [False] * (len(pairs) - 1) + [True]
        return pa.table([table.column("block"), pa.array([s for s, _ in pairs], pa.int32()), pa.array([e for _, e in pairs], pa.int32()), pa.array(last)], ["block", "start", "end", "ending"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                best = next(c for c in r["choices"] if (c["start"], c["end"]) == (r["start"], r["end"]))
                tail, cost = _TAIL[r["end"]] if r["ending"] else ("", 0)
                audit = best["audit"] + tail
                turns, _ = apply_edits([(t["role"], t["text"]) for t in r["turns"]], audit, r["start"])
                out.append(r | {"cost": best["cost"] + cost, "audit": audit, "turns": turns})
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in done.names} for r in out], schema=done)

    names = f"conv {kind}, block long, cost long, audit string, turns {_TURNS}, {_FAULTS}"
    done = to_arrow_schema(StructType.fromDDL(names))
    parts = solved.where("not whole")
    pairs = parts.select("conv", "block", F.transform("choices", lambda c: c.dropFields("audit")).alias("choices")).groupBy("conv").applyInArrow(link, "block long, start int, end int, ending boolean")
    return solved.where("whole").select(done.names).unionByName(parts.join(pairs, "block").mapInArrow(finish, names))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with the faults of the contract: by the CRC-32 of ``conv_id:turn`` modulo 20."""
    space = F.lit(" ")
    key = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce("text", space)
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(key == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(key == 1, "").when(key == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(key == 3, 2).otherwise(1).alias("copies"),
        key.alias("key"),
    ).where("key <> 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("conv_id", "turn", "role", "text")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Faults, cost and edits of every conversation (the contract of ``op12``)."""
    rows = publish(faults(damaged(conversations), *map(F.col, ("conv_id", "turn", "role", "text"))))
    turns = rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    line = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    part = F.struct("block", "audit", F.when(F.size("turns") > 0, line).alias("lines"), "first", "last")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    each = repair(rows).groupBy("conv").agg(*sums, F.sort_array(F.collect_list(part)).alias("parts"))
    between = F.transform(F.sequence(F.lit(1), F.size("parts") - 1), lambda k: F.concat(F.get("parts", k - 1)["last"], F.get("parts", k)["first"]))
    broken = F.when(F.size("parts") > 1, F.size(F.filter(between, lambda p: ~p.isin(*_LEGAL)))).otherwise(0)
    joined = lambda field, by: F.array_join(F.transform("parts", lambda p: p[field]), by)
    each = each.select("conv", *("blank", "duplicate", "truncated"), (F.col("illegal") + broken).alias("illegal"), "cost", joined("audit", "").alias("audit"), F.sha2(joined("lines", "\n"), 256).alias("repaired_sha256"))
    all_ids = conversations.select(F.col("conv_id").alias("conv")).distinct()
    out = join_on(join_on(all_ids, turns, ["conv"], "left"), each, ["conv"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same rows by dynamic programming over states, with the CRC-32 of the keys from its table.
SQL = r"""
with recursive bits as (select b, b as v, 0 as k from range(256) as bs(b) union all select b, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8),
crc as (select list(v order by b) as t from bits where k = 8),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
keyed as (select conv_id, turn, role, text,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)), lambda a, c: xor(a // 256, t[xor(a % 256, c) + 1])), 4294967295) % 20 as k from named, crc),
damaged as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(case when k = 3 then 2 else 1 end)) as copy from keyed where k <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, rtrim(text, E' \t\n\x0b\x0c\r') as bare from damaged),
marked as (select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(role[1]) over (partition by conv_id order by i) || role[1] as pair from placed),
counts as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from marked group by all),
moves(s, e, initial, t) as (values (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3),
    (0, 'R', 'user', 2), (1, 'R', 'user', 2), (3, 'R', 'user', 2), (2, 'R', 'assistant', 3), (0, 'D', '', 0), (1, 'D', '', 1), (2, 'D', '', 2), (3, 'D', '', 3)),
inserts(s, n, t, edits, lines) as (values (0, 0, 0, '', ''), (1, 0, 1, '', ''), (2, 0, 2, '', ''), (3, 0, 3, '', ''), (0, 1, 2, 'I', E'\nuser:'), (1, 1, 2, 'I', E'\nuser:'), (3, 1, 2, 'I', E'\nuser:'), (2, 1, 3, 'I', E'\nassistant:'),
    (0, 2, 3, 'II', E'\nuser:\nassistant:'), (1, 2, 3, 'II', E'\nuser:\nassistant:'), (3, 2, 3, 'II', E'\nuser:\nassistant:'), (2, 2, 2, 'II', E'\nassistant:\nuser:')),
ways(conv_id, i, s, cost, audit, lines) as (
  select conv_id, 0::bigint, 0, 0, '', '' from counts
  union all
  (select * from (select w.conv_id, m.i, v.t, w.cost + 3 * x.n + case v.e when 'D' then 4 when 'R' then 3 else 0 end + case when v.e <> 'D' and m.fault = 'truncated' then 3 else 0 end as all_cost,
     w.audit || x.edits || v.e as edits, w.lines || x.lines || case v.e when 'D' then '' when 'K' then E'\n' || m.role || ':' || m.text else E'\n' || v.initial || ':' || m.text end as lines
   from ways w join marked m on m.conv_id is not distinct from w.conv_id and m.i = w.i + 1 join inserts x on x.s = w.s
   join moves v on v.s = x.t and (v.e <> 'K' or v.initial = m.role[1]) and (v.e = 'D' or m.fault not in ('blank', 'duplicate')))
   qualify row_number() over (partition by conv_id, t order by all_cost, edits) = 1)),
best as (select w.conv_id, w.cost + 3 * x.n as cost, w.audit || x.edits as audit, w.lines || x.lines as lines from ways w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.i join inserts x on x.s = w.s
  where x.t in (0, 3) qualify row_number() over (partition by w.conv_id order by w.cost + 3 * x.n, w.audit || x.edits) = 1)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(lines[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join best b on b.conv_id is not distinct from o.conv_id
"""
