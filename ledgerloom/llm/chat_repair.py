"""Repair of conversation structure by the cheapest edits, with Four-Russians tables.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Its
rows may be kept (cost 0), given the role user or assistant (1) or deleted (2),
messages without text may be inserted (5), and a truncated row that stays costs 5
more; blank rows and duplicates must be deleted. Wanted are the cheapest edits, of
equally cheap ones those whose initials D, I, K, R are least as a string.

``cost[s]`` is what the rest of a conversation costs from state s (nothing yet, after
system, after user, after assistant). Less its minimum, this vector takes a few dozen
values, so the step of every vector over every block of four row symbols is
precomputed: normalised vector and symbols to normalised vector and added cost.
Blocks are looked up from the last to the first; then each block is expanded
backward symbol by symbol, and a second table of (vector, symbol, state) gives the
least edit that lies on a cheapest path, which makes the trace safe for ties.

How it is spread: equal rows are folded with a count, rows are range-partitioned in
conversation order and cut into pieces of at most 8,192, so a conversation of any
length is many tasks. A piece becomes a 4 x 4 table of costs (entry state to exit
state); per conversation only these tables meet, to give each piece the vector
after it and the entry states on a cheapest path. Pieces are then traced on their
own, and the traces are linked from state to state.

Defined results: a null role or text is one space; rows are ordered by turn (null
first), ties by role, then text; a null conversation key is a conversation of its
own; no rows, no conversation. Other columns take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What follows each state when a user or assistant message is added.
ADDED = (USER, USER, ASSISTANT, USER)
#: What a kept row of class s, u, a, other leads to; None if it may not stand there.
KEPT = {START: (SYSTEM, USER, None, None), SYSTEM: (None, USER, None, None),
        USER: (None, None, ASSISTANT, None), ASSISTANT: (None, USER, None, None)}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Symbols: 0 must go; 1 + 2 * class + truncated.
SYMBOLS, BLOCK, PIECE_BITS = 9, 4, 13
NEVER = 10**12

#: Messages of a row's token: kept, reroled and inserted user and assistant. Deleted: -.
EDIT = str.maketrans("kuaUA-", "KRRIID")
BLANKS = " \t\n\x0b\x0c\r"


def closed(costs: list[int]) -> list[int]:
    """The vector when messages may be inserted first."""
    costs = list(costs)
    for _ in range(3):
        costs = [min(c, INSERT + costs[ADDED[s]], NEVER) for s, c in enumerate(costs)]
    return costs


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(token, cost, next state) of every edit of a row, least initial first."""
    found = [("-", DELETE, state)]
    if symbol:
        kind, cut = divmod(symbol - 1, 2)
        if KEPT[state][kind] is not None:
            found.append(("k", KEEP + TRUNCATED * cut, KEPT[state][kind]))
        to = ADDED[state]
        found.append(("u" if to == USER else "a", REROLE + TRUNCATED * cut, to))
    return found


def before(symbol: int, after: list[int]) -> list[int]:
    """The vector before a row, given the one after it."""
    return closed([min(cost + after[to] for _, cost, to in options(symbol, s)) for s in range(4)])


def final() -> list[int]:
    return closed([0, NEVER, NEVER, 0])


def unit(state: int) -> list[int]:
    return [0 if s == state else NEVER for s in range(4)]


def _normal(costs: list[int]) -> tuple[int, tuple[int, ...]]:
    least = min(costs)
    return least, tuple(NEVER if c >= NEVER // 2 else c - least for c in costs)


class Tables(NamedTuple):
    vectors: list[tuple[int, ...]]
    number: dict[tuple[int, ...], int]
    step: list[list[int]]        # [vector][symbol] -> vector
    block: list[list[int]]       # [vector][symbols of a block] -> vector
    block_cost: list[list[int]]
    step_cost: list[list[int]]
    choice: list[list[list[tuple[str, int]]]]  # [vector][symbol][state] -> token, next state


@cache
def tables() -> Tables:
    """All normalised vectors that can come up, and their transitions."""
    vectors = [_normal(v)[1] for v in (final(), *(unit(s) for s in range(4)))]
    vectors = list(dict.fromkeys(vectors))
    number = {v: n for n, v in enumerate(vectors)}
    step, step_cost, choice = [], [], []
    for after in vectors:  # grows while it is walked
        step.append([])
        step_cost.append([])
        choice.append([])
        for symbol in range(SYMBOLS):
            here = before(symbol, list(after))
            added, vector = _normal(here)
            if vector not in number:
                number[vector] = len(vectors)
                vectors.append(vector)
            step[-1].append(number[vector])
            step_cost[-1].append(added)
            choice[-1].append([_least_edit(symbol, state, here, after) for state in range(4)])
    one, one_cost = np.array(step), np.array(step_cost)
    block, cost = one, one_cost
    for _ in range(BLOCK - 1):  # one more symbol in front
        cost = (cost[:, None, :] + one_cost[block].transpose(0, 2, 1)).reshape(len(vectors), -1)
        block = one[block].transpose(0, 2, 1).reshape(len(vectors), -1)
    return Tables(vectors, number, step, block.tolist(), cost.tolist(), step_cost, choice)


def _least_edit(symbol: int, state: int, here: list[int], after: tuple[int, ...]) -> tuple[str, int]:
    """Messages inserted before a row and its edit: the least on a cheapest path."""
    token = ""
    while here[state] < NEVER // 2:
        found = {t: to for t, cost, to in options(symbol, state) if cost + after[to] == here[state]}
        if "-" in found:
            return token + "-", state
        to = ADDED[state]
        if INSERT + here[to] == here[state]:
            token, state = token + ("U" if to == USER else "A"), to
            continue
        edit, to = next(iter(found.items()))
        return token + edit, to
    return "", state


def closing(state: int) -> str:
    """Messages that end a conversation after its last row."""
    return {START: "", SYSTEM: "UA", USER: "A", ASSISTANT: ""}[state]


def _blocks(symbols: list[int]) -> tuple[list[int], list[int]]:
    """The first symbols, fewer than a block, and the blocks after them as numbers."""
    lead = len(symbols) % BLOCK
    numbers = []
    for i in range(lead, len(symbols), BLOCK):
        n = 0
        for symbol in symbols[i:i + BLOCK]:
            n = n * SYMBOLS + symbol
        numbers.append(n)
    return symbols[:lead], numbers


def cost_table(symbols: list[int]) -> list[int]:
    """Least costs from entry state to exit state (16 numbers) by block lookup."""
    t, columns = tables(), []
    lead, numbers = _blocks(symbols)
    for exit_state in range(4):
        v, cost = t.number[tuple(unit(exit_state))], 0
        for n in reversed(numbers):
            cost += t.block_cost[v][n]
            v = t.block[v][n]
        for symbol in reversed(lead):
            cost += t.step_cost[v][symbol]
            v = t.step[v][symbol]
        columns.append([min(cost + c, NEVER) for c in t.vectors[v]])
    return [columns[x][s] for s in range(4) for x in range(4)]


def trace(symbols: list[int], end: tuple[int, ...], entries: list[int]) -> list[tuple[list[str], int]]:
    """Tokens per row and exit state, from each entry state: blocks by lookup, each
    block then expanded backward from the vector after it."""
    t = tables()
    lead, numbers = _blocks(symbols)
    v = t.number[_normal(list(end))[1]]
    after_block = []
    for n in reversed(numbers):
        after_block.append(v)
        v = t.block[v][n]
    parts = [(symbols[len(lead) + k * BLOCK:len(lead) + (k + 1) * BLOCK], a) for k, a in enumerate(reversed(after_block))]
    after: list[int] = []
    for own, v in ([(lead, v)] if lead else []) + parts:
        inner = []
        for symbol in reversed(own):
            inner.append(v)
            v = t.step[v][symbol]
        after += reversed(inner)
    out = []
    for state in entries:
        tokens = []
        for symbol, v in zip(symbols, after, strict=True):
            token, state = t.choice[v][symbol][state]
            tokens.append(token)
        out.append((tokens, state))
    return out


def link(tables_: list[list[int]]) -> tuple[int, list[tuple[list[int], list[int]]]]:
    """Cost of a conversation, and for each piece the vector after it and the entry
    states that lie on a cheapest path."""
    ends, vector = [], final()
    for own in reversed(tables_):
        ends.append(vector)
        vector = [min(own[4 * s + x] + vector[x] for x in range(4)) for s in range(4)]
        vector = [min(c, NEVER) for c in vector]
    total, arriving, out = vector[START], unit(START), []
    for own, end in zip(tables_, reversed(ends), strict=True):
        here = [min(own[4 * s + x] + end[x] for x in range(4)) for s in range(4)]
        out.append((end, [s for s in range(4) if arriving[s] + here[s] == total]))
        arriving = [min(min(arriving[s] + own[4 * s + x] for s in range(4)), NEVER) for x in range(4)]
    return total, out


# ---------------------------------------------------------------- Spark

_ROW = "array<struct<seq: bigint, sym: int, n: bigint>>"


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _ordered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct rows with their count, numbered in the order of conversations."""
    folded = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                         F.coalesce(F.col(text), F.lit(" ")).alias("text")).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    order = ["conv", "turn", "role", "text"]
    return written(folded.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order)
                   .withColumn("seq", F.monotonically_increasing_id()), "chat-rows")


def _marked(ordered: DataFrame) -> DataFrame:
    """Rows without their texts: role class, and which fault counts."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    rows = ordered.select("conv", "turn", "seq", "n", _initial(F.col("role")).alias("kind"), "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
                          (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    first = rows.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(1).alias("first"))
    rows = rows.drop("role", "digest").join(first, "seq", "left").withColumn("first", F.coalesce("first", F.lit(0)))
    stays = ~F.col("blank") & (F.col("first") == 1)
    return rows.select("conv", "turn", "seq", "n",
                       (F.col("kind") * 3 + F.when(~stays, 2).when(F.col("cut"), 1).otherwise(0)).alias("sym"),
                       F.when(F.col("blank"), F.col("n")).otherwise(0).alias("blank"),
                       F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first")).alias("duplicate"),
                       F.when(stays & F.col("cut"), 1).otherwise(0).alias("truncated"))


def _symbol(sym: int) -> int:
    kind, fault = divmod(sym, 3)
    return 0 if fault == 2 else 1 + 2 * kind + fault


def _illegal(kinds: list[int], counts: list[int]) -> int:
    return sum(n - 1 for n in counts) + sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece: its table of costs, pairs of roles that may not meet, its outer roles."""
    for b in batches:
        costs, illegal, outer = [], [], []
        for rows in b.column("rows").to_pylist():
            syms, counts = [r["sym"] for r in rows], [r["n"] for r in rows]
            copies = DELETE * (sum(counts) - len(counts))
            costs.append([min(c + copies, NEVER) for c in cost_table([_symbol(s) for s in syms])])
            kinds = [s // 3 for s in syms]
            illegal.append(_illegal(kinds, counts))
            outer.append([kinds[0], kinds[-1]])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(illegal, pa.int64()), pa.array(outer, pa.list_(pa.int64()))],
                                         [*b.schema.names, "costs", "illegal", "outer"])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: its figures, and what each of its pieces must know."""
    for b in batches:
        figures = {name: [] for name in ("gaps", "illegal", "cost", "known")}
        for pieces in b.column("pieces").to_pylist():
            cost, known = link([p["costs"] for p in pieces])
            joints = list(zip(pieces, pieces[1:], strict=False))
            turns = sum(p["turns"] for p in pieces) - sum(x["high"] is not None and x["high"] == y["low"] for x, y in joints)
            lows, highs = [p["low"] for p in pieces if p["low"] is not None], [p["high"] for p in pieces if p["high"] is not None]
            figures["gaps"].append(max(highs) - min(lows) + 1 - turns if lows else 0)
            figures["illegal"].append(sum(p["illegal"] for p in pieces) + sum((x["outer"][1], y["outer"][0]) not in LEGAL for x, y in joints))
            figures["cost"].append(cost)
            figures["known"].append([{"head": p["head"], "end": end, "entries": entries, "last": k == len(pieces) - 1}
                                     for k, (p, (end, entries)) in enumerate(zip(pieces, known, strict=True))])
        kinds = (pa.int64(), pa.int64(), pa.int64(), _KNOWN)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kind) for v, kind in zip(figures.values(), kinds, strict=True))], ["conv", *figures])


_KNOWN = pa.list_(pa.struct([("head", pa.int64()), ("end", pa.list_(pa.int64())), ("entries", pa.list_(pa.int64())), ("last", pa.bool_())]))


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece and entry state on a cheapest path: audit, exit state, messages per row."""
    for b in batches:
        out: dict[str, list] = {name: [] for name in ("row", "entry", "exit", "audit", "seqs", "said")}
        for k, (rows, end, entries, last) in enumerate(zip(*(b.column(c).to_pylist() for c in ("rows", "end", "entries", "last")), strict=True)):
            traces = trace([_symbol(r["sym"]) for r in rows], tuple(end), entries)
            for entry, (tokens, state) in zip(entries, traces, strict=True):
                copies = ["-" * (r["n"] - 1) for r in rows]
                tail = closing(state) if last else ""
                edits = "".join(t + c for t, c in zip(tokens, copies, strict=True)) + tail
                said = [t.replace("-", "") for t in tokens]
                said[-1] += tail
                heard = [i for i, t in enumerate(said) if t]
                for name, v in zip(out, (k, entry, state, edits.translate(EDIT), [rows[i]["seq"] for i in heard], [said[i] for i in heard]), strict=True):
                    out[name].append(v)
        at = pa.array(out["row"], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("conv").take(at), b.column("head").take(at), pa.array(out["entry"], pa.int64()), pa.array(out["exit"], pa.int64()), pa.array(out["audit"], pa.string()),
             pa.array(out["seqs"], pa.list_(pa.int64())), pa.array(out["said"], pa.list_(pa.string()))], ["conv", "head", "entry", "exit", "audit", "seqs", "said"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation: the trace of each piece that begins where the one before ended."""
    for b in batches:
        audits, ways = [], []
        for traces in b.column("traces").to_pylist():
            state, head, parts, way = START, None, [], []
            by_place = {(t["head"], t["entry"]): t for t in traces}
            for head in sorted({t["head"] for t in traces}):
                t = by_place[head, state]
                way.append({"head": head, "entry": state})
                parts.append(t["audit"])
                state = t["exit"]
            audits.append("".join(parts))
            ways.append(way)
        yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(audits, pa.string()), pa.array(ways, pa.list_(pa.struct([("head", pa.int64()), ("entry", pa.int64())])))],
                                         ["conv", "audit", "way"])


class Repaired(NamedTuple):
    """``summary``: key, gaps, blank, duplicate, truncated, illegal, cost, audit, one row per
    conversation. ``messages``: key, place, part, role, text of the repaired ones, in
    the order of place and part; a conversation of which nothing is left has none."""

    summary: DataFrame
    messages: DataFrame


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repaired:
    ordered = _ordered(rows, conv, turn, role, text)
    kind = ordered.schema["conv"].dataType.simpleString()
    piece = _marked(ordered).groupBy("conv", F.shiftright("seq", PIECE_BITS).alias("piece")).agg(
        F.min("seq").alias("head"), F.sort_array(F.collect_list(F.struct("seq", "sym", "n"))).cast(_ROW).alias("rows"),
        F.min("turn").cast("long").alias("low"), F.max("turn").cast("long").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"),
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")))
    pieces = written(piece.drop("piece").mapInArrow(
        _measure, f"conv {kind}, head long, rows {_ROW}, low long, high long, turns long, blank long, duplicate long, truncated long, "
                  "costs array<bigint>, illegal long, outer array<bigint>"), "chat-pieces")

    whole = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("head", "costs", "low", "high", "turns", "illegal", "outer"))).alias("pieces"))
    linked = written(whole.mapInArrow(_link, f"conv {kind}, gaps long, illegal long, cost long, "
                                             "known array<struct<head: bigint, end: array<bigint>, entries: array<bigint>, last: boolean>>"), "chat-links")
    known = linked.select(F.explode("known").alias("k")).select("k.*")
    traced = written(pieces.select("conv", "head", "rows").join(known, "head").mapInArrow(
        _trace, f"conv {kind}, head long, entry long, exit long, audit string, seqs array<bigint>, said array<string>"), "chat-traces")
    chosen = written(traced.groupBy("conv").agg(F.collect_list(F.struct("head", "entry", "exit", "audit")).alias("traces")).mapInArrow(
        _choose, f"conv {kind}, audit string, way array<struct<head: bigint, entry: bigint>>"), "chat-audits")

    faults = pieces.groupBy("conv").agg(*(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")))
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"])
    summary = (linked.join(faults, same(linked, faults)).join(chosen, same(linked, chosen))
               .select(linked["conv"].alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    way = chosen.select(F.explode("way").alias("w")).select("w.head", "w.entry")
    said = traced.join(way, ["head", "entry"]).select(F.explode(F.arrays_zip("seqs", "said")).alias("x")).select(F.col("x.seqs").alias("seq"), F.col("x.said").alias("said"))
    messages = ordered.join(said, "seq").select("conv", "seq", "role", "text", F.posexplode(F.split("said", "")).alias("part", "edit")).where("edit <> ''")
    added = F.col("edit").isin("U", "A")
    return Repaired(summary, messages.select(
        F.col("conv").alias(conv), F.col("seq").alias("place"), "part",
        F.when(F.lower("edit") == "u", "user").when(F.lower("edit") == "a", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(added, "").otherwise(F.col("text")).alias("text")))


def digests(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(key, sha256) of each conversation's ``role:text`` lines. A digest is made from
    first to last, so a conversation's messages pass through one task, in sorted
    order and a batch at a time; none is held whole."""
    lines = messages.select(F.col(conv).alias("conv"), "place", "part", F.concat("role", F.lit(":"), "text").alias("line"))
    kind = lines.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, current, digest = None, None, None
        for b in batches:
            done: list[tuple] = []
            schema = b.schema.field("conv").type
            for key, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist(), strict=True):
                if digest is None or key != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = key, sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield _digest_rows(done, schema)
        if digest is not None:
            yield _digest_rows([(current, digest.hexdigest())], schema)

    return (lines.repartition("conv").sortWithinPartitions("conv", "place", "part").select("conv", "line")
            .mapInArrow(run, f"conv {kind}, sha256 string").withColumnRenamed("conv", conv))


def _digest_rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([d for _, d in done], pa.string())], ["conv", "sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the crc32 of ``conv_id:turn`` modulo 20: 0
    drops the row, 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4 sets
    its role to user. Nulls: one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(text_of("role")).alias("role"),
                      F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text")).alias("text"),
                      copies.alias("copies"))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


#: One row of all conversations at a time, with four states each; of equally cheap
#: ways to a state the least audit stays.
ORACLE_SQL = r"""
WITH RECURSIVE hashed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
        list_concat([4294967295::BIGINT], list_transform(
            string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
        lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                 lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))) % 20 AS fault
    FROM conversations
), repeated AS (
    SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
        CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed
), placed_rows AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM repeated
), marked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body
    FROM placed_rows
), sorted AS (
    SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, body = '' AS blank, body <> '' AND again AS duplicate,
        body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
    FROM marked
), inserts(state, added, said, reached, cost) AS (
    VALUES ('0', '', '', '0', 0), ('0', 'I', 'u', 'u', 5), ('0', 'II', 'ua', 'a', 10), ('s', '', '', 's', 0), ('s', 'I', 'u', 'u', 5), ('s', 'II', 'ua', 'a', 10),
           ('u', '', '', 'u', 0), ('u', 'I', 'a', 'a', 5), ('a', '', '', 'a', 0), ('a', 'I', 'u', 'u', 5)
), edits(state, edit, initial, said, reached, cost) AS (
    VALUES ('0', 'D', NULL, '-', '0', 2), ('s', 'D', NULL, '-', 's', 2), ('u', 'D', NULL, '-', 'u', 2), ('a', 'D', NULL, '-', 'a', 2),
           ('0', 'K', 's', 's', 's', 0), ('0', 'K', 'u', 'u', 'u', 0), ('s', 'K', 'u', 'u', 'u', 0), ('a', 'K', 'u', 'u', 'u', 0), ('u', 'K', 'a', 'a', 'a', 0),
           ('0', 'R', NULL, 'u', 'u', 1), ('s', 'R', NULL, 'u', 'u', 1), ('a', 'R', NULL, 'u', 'u', 1), ('u', 'R', NULL, 'a', 'a', 1)
), steps AS (
    SELECT conv_id, 0::BIGINT AS i, '0' AS state, {'cost': 0, 'audit': '', 'said': ''} AS best FROM (SELECT DISTINCT conv_id FROM sorted)
    UNION ALL
    SELECT w.conv_id, w.i + 1, e.reached, min({
        'cost': (w.best).cost + n.cost + e.cost + CASE WHEN r.truncated AND e.edit <> 'D' THEN 5 ELSE 0 END,
        'audit': (w.best).audit || n.added || e.edit, 'said': (w.best).said || n.said || e.said})
    FROM steps w JOIN sorted r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    JOIN inserts n ON n.state = w.state JOIN edits e ON e.state = n.reached
    WHERE (e.initial IS NULL OR e.initial = r.initial) AND (e.edit = 'D' OR NOT (r.blank OR r.duplicate))
    GROUP BY w.conv_id, w.i, e.reached
), ended AS (
    SELECT s.conv_id, min({'cost': (best).cost + n.cost, 'audit': (best).audit || n.added, 'said': (best).said || n.said}) AS best
    FROM steps s JOIN (SELECT conv_id, max(i) AS n FROM sorted GROUP BY conv_id) z ON s.conv_id IS NOT DISTINCT FROM z.conv_id AND s.i = z.n
    JOIN inserts n ON n.state = s.state WHERE n.reached IN ('0', 'a') GROUP BY s.conv_id
), letters AS (
    SELECT conv_id, unnest(range(1, length((best).audit) + 1)) AS p, (best).audit AS audit, (best).said AS said FROM ended
), placed AS (
    SELECT conv_id, p, audit[p] AS edit, said[p] AS said, length(replace(audit[1:p], 'I', '')) AS i FROM letters
), repaired AS (
    SELECT p.conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN r.role ELSE CASE said WHEN 'u' THEN 'user' ELSE 'assistant' END END || ':'
        || CASE edit WHEN 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p)) AS digest
    FROM placed p LEFT JOIN sorted r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE edit <> 'D' GROUP BY p.conv_id
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
        count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
        count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM sorted GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce((best).cost, 0)::BIGINT AS cost, coalesce((best).audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
