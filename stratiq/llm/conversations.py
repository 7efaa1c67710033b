"""Conversation structure repair: cheapest edits by a bidirectional graph of tight arcs.

A conversation is its rows by turn.  The first fault of a row counts: blank (no
word), duplicate (role and text seen earlier in the conversation), truncated (the
last character that is no white space does not end a sentence).  The repaired
conversation has role initials ``(s?(ua)+)?``.  Edits, by their initials: Keep costs
0, Rerole to user or assistant 1, Delete 2 (blank and duplicate rows must go),
Insert an empty row of user or assistant 5; a truncated row that stays adds 5.

A node of the graph is a place between rows and what the initials so far allow
next; D, K and R lead over a row, I stays at a place.  Minimum costs from the start
and to the end, one pass each way, tell which arcs lie on a cheapest way (costs
before, of the arc and behind add up to the total).  Then a set of nodes, at first
the start alone, moves along the least letter among the tight arcs out of it, which
spells the least of all cheapest strings of edits.

Rows are range-partitioned by conversation and turn and sorted; each task packs
consecutive rows of a conversation into blocks of bounded rows and bytes.  Most
conversations are one block inside a partition and are settled in one step
without another shuffle.  The others, large ones and those that a splitter cuts,
are settled block by block: a block is a 4 x 4 matrix of costs; the matrices of a
conversation, 16 numbers for ``MOST_ROWS`` rows, give each block its costs before
and behind; each block then spells its edits for every entry state, and one walk
over the blocks' exits picks the state.  No step holds a conversation whole.
(Only the digest of the repaired conversation must read it in order: it streams.)

Defined results
---------------
* Null roles and texts count as one space, so such texts are blank.
* Null turns come first.  Rows of one turn are ordered by role, then by the 64-bit
  hash of their text.  Turns are whole numbers.
* Roles count by their first character; other than s, u and a can't be kept.
* Rows with a null id are one conversation.  Repeated rows are duplicates.
* A conversation none of whose rows is ``present`` has zeros, no edits and the
  digest of the empty string.  An empty table gives an empty result.
* Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, shuffle_parts

#: A block ends at so many rows, or characters.
MOST_ROWS, MOST_CHARS = 2048, 4_000_000
INF = 1 << 60
KEEP_TRUNCATED, REROLE, DELETE, INSERT = 5, 1, 2, 5
#: From a state (nothing yet, system, user, assistant) by a role's initial to the next.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that may come next, and the state behind it, where a row is reroled or inserted.
NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
WORD = re.compile(r"[^\x20\x09-\x0D]")
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with faults put in by crc32(``conv:turn``) % 20: 0 drops (``present`` becomes false), 1 empties, 2 takes the ends of sentences, 3 repeats, 4 makes the role user."""
    shown = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(shown(conv_col), F.lit(":"), shown(turn_col)), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown(text_col), ".!?", "")).otherwise(shown(text_col))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias(conv_col), F.col(f"`{turn_col}`").alias(turn_col), F.when(kind == 4, "user").otherwise(shown(role_col)).alias(role_col), text.alias(text_col),
        (kind != 0).alias("present"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


# Costs within a block.  ``initials`` and ``faults`` have a character for each row.


def _arcs(state: int, initial: str, fault: str) -> Iterator[tuple[str, int, int]]:
    """Letter, cost, next state of the ways over a row."""
    yield "D", DELETE, state
    if fault in "-t":
        extra = KEEP_TRUNCATED if fault == "t" else 0
        if initial in STEPS[state]:
            yield "K", extra, STEPS[state][initial]
        yield "R", extra + REROLE, NEXT[state][0]


#: All ways over a row by its initial and fault: for each state (letter, cost, next state).
WAYS = {(i, f): [list(_arcs(s, i, f)) for s in range(4)] for i in "suax" for f in "-tbd"}


def _inserted(cost: list[int]) -> list[int]:
    """Costs from the start at one place, with rows inserted there."""
    user = min(cost[2], cost[0] + INSERT, cost[1] + INSERT, cost[3] + INSERT)
    return [cost[0], cost[1], user, min(cost[3], user + INSERT)]


def _inserted_behind(cost: list[int]) -> list[int]:
    """Costs to the end at one place, with rows inserted there."""
    user = min(cost[2], cost[3] + INSERT)
    return [min(cost[0], user + INSERT), min(cost[1], user + INSERT), user, min(cost[3], user + INSERT)]


def forward(initials: str, faults: str, cost: list[int]) -> list[list[int]]:
    """Costs from the start at each place of a block, inserts of the last place left out; ``cost``: those at its first place."""
    out = []
    for key in zip(initials, faults, strict=True):
        cost = _inserted(cost)
        out.append(cost)
        after = [INF] * 4
        for s, ways in enumerate(WAYS[key]):
            for _, c, t in ways:
                after[t] = min(after[t], cost[s] + c)
        cost = after
    return [*out, cost]


def backward(initials: str, faults: str, cost: list[int]) -> list[list[int]]:
    """Costs to the end at each place of a block; ``cost``: those at its last place, inserts there included."""
    out = [cost]
    for key in zip(reversed(initials), reversed(faults), strict=True):
        cost = _inserted_behind([min(c + cost[t] for _, c, t in ways) for ways in WAYS[key]])
        out.append(cost)
    return out[::-1]


#: Costs to the end behind the last row.
AT_END = _inserted_behind([0, INF, INF, 0])


def spelled(initials: str, faults: str, before: list[list[int]], behind: list[list[int]], state: int, last: bool) -> tuple[str, int]:
    """The least string of edits along tight arcs through a block, entered in ``state``, and the state behind it.

    ``last``: rows may be inserted behind the block.
    """
    end, frontier, letters = len(initials), {(0, state)}, []
    total = min(f + b for f, b in zip(before[0], behind[0], strict=True))
    while True:
        ways: dict[str, set[tuple[int, int]]] = {}
        for i, s in frontier:
            if i < end:
                for letter, c, t in WAYS[initials[i], faults[i]][s]:
                    if before[i][s] + c + behind[i + 1][t] == total:
                        ways.setdefault(letter, set()).add((i + 1, t))
            if (i < end or last) and before[i][s] + INSERT + behind[i][NEXT[s][0]] == total:
                ways.setdefault("I", set()).add((i, NEXT[s][0]))
        if not ways:
            return "".join(letters), next(iter(frontier))[1]
        letters.append(min(ways))
        frontier = ways[letters[-1]]


def applied(audit: str, roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str, str]]:
    """Letter, role and text of the rows that the edits leave."""
    at = 0
    for letter in audit:
        if letter == "K":
            yield letter, roles[at], texts[at]
            state = STEPS[state][initial_of(roles[at])]
        elif letter != "D":
            yield letter, NEXT[state][1], texts[at] if letter == "R" else ""
            state = NEXT[state][0]
        at += letter != "I"


def initial_of(role: str) -> str:
    return role[0] if role and role[0] in "sua" else "x"


def fault_of(text: str) -> str:
    """Blank, truncated or none."""
    if not WORD.search(text):
        return "b"
    return "-" if text.rstrip(BLANKS)[-1] in ".!?" else "t"


def _illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def settled(roles: list[str], texts: list[str], initials: str, faults: str) -> tuple[int, str]:
    """Cost and edits of a conversation of one block."""
    behind = backward(initials, faults, AT_END)
    before = forward(initials, faults, [0, INF, INF, INF])
    before[-1] = _inserted(before[-1])
    return behind[0][0], spelled(initials, faults, before, behind, 0, True)[0]


# Blocks.


def _blocks(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    """A row for each block: _conv, _block (ascending in order), _edge (the conversation may have more blocks), _roles, _texts, _initials, _faults, _low, _high, _turns (distinct)."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("_conv"), F.col(f"`{turn_col}`").cast("long").alias("_turn"), text(role_col).alias("_role"), text(text_col).alias("_text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("_present"), F.monotonically_increasing_id().alias("_row"),
    )
    # The row's number only spreads rows that are equal in all else, so that they need not fill one partition.
    order = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), "_role", F.xxhash64("_text"), "_row"]
    rows = rows.repartitionByRange(shuffle_parts(turns.sparkSession), *order).sortWithinPartitions(*order).drop("_row")
    conv = T.StructField("_conv", rows.schema["_conv"].dataType)
    schema = T.StructType([conv, *T._parse_datatype_string("_block long, _edge boolean, _roles array<string>, _texts array<string>, _initials string, _faults string, _low long, _high long, _turns long").fields])
    kinds = {"_block": pa.int64(), "_edge": pa.bool_(), "_roles": pa.list_(pa.string()), "_texts": pa.list_(pa.string()), "_initials": pa.string(), "_faults": pa.string(), "_low": pa.int64(), "_high": pa.int64(), "_turns": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        held, kind = None, None  # the block at hand: conversation, turns, roles, texts
        chars, edge = 0, True  # the partition's first conversation may have begun before it

        def packed(edge: bool) -> tuple:
            nonlocal number
            name, times, roles, texts = held
            seen: set[tuple[str, str]] = set()
            faults = []
            for pair in zip(roles, texts, strict=True):
                fault = fault_of(pair[1])
                faults.append("d" if fault != "b" and pair in seen else fault)
                seen.add(pair)
            known = [x for x in times if x is not None]
            number += 1
            return name, number, edge, roles, texts, "".join(map(initial_of, roles)), "".join(faults), known[0] if known else None, known[-1] if known else None, len(set(known))

        def emitted() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            out = [pa.array(columns[0], kind), *(pa.array(c, k) for c, k in zip(columns[1:], kinds.values(), strict=True))]
            done.clear()
            return pa.RecordBatch.from_arrays(out, names=["_conv", *kinds])

        size = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for name, time, role, body, there in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = held is not None and (len(held[2]) >= MOST_ROWS or chars >= MOST_CHARS)
                if held is not None and (name != held[0] or full):
                    done.append(packed(edge or name == held[0]))
                    size += chars
                    edge = name == held[0]
                    held = None
                    if size > MOST_CHARS or len(done) >= MOST_ROWS:
                        yield emitted()
                        size = 0
                if held is None:
                    held, chars = (name, [], [], []), 0
                if there:
                    for part, value in zip(held[1:], (time, role, body), strict=True):
                        part.append(value)
                    chars += len(body)
        if held is not None:  # may go on in the next partition
            done.append(packed(True))
            yield emitted()

    return saved(rows.mapInArrow(run, schema), "conversation-blocks")


def _list(values: list, kind: str) -> pa.Array:
    return pa.array(values, {"long": pa.int64(), "string": pa.string(), "longs": pa.list_(pa.int64()), "strings": pa.list_(pa.string())}[kind])


def _added(df: DataFrame, columns: str, kinds: list[str], make, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns to drop, with further columns that ``make`` finds from each row's values."""
    names, new = df.columns, T._parse_datatype_string(columns).fields
    kept = [i for i, c in enumerate(names) if c not in drop]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [make(**dict(zip(names, x, strict=True))) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            out = [_list([x[k] for x in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *out], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def _matrix(_initials: str, _faults: str, _again: list[int] | None, **_) -> tuple[str, list[int]]:
    """Faults with the duplicates of earlier blocks, and the costs from each entry state to each exit state."""
    faults = list(_faults)
    for at in _again or ():
        faults[at] = "d"
    _faults = "".join(faults)
    rows = [forward(_initials, _faults, [0 if s == t else INF for t in range(4)])[-1] for s in range(4)]
    return _faults, [min(c, INF) for row in rows for c in row]


def _bounds(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of each block of a conversation: costs before and behind, and which is the last."""
    pdf = pdf.sort_values("_block")
    matrices = [np.array(m, np.int64).reshape(4, 4) for m in pdf["_costs"]]
    before, behind = [np.array([0, INF, INF, INF])], [np.array(AT_END)]
    for m in matrices[:-1]:
        before.append(np.minimum((before[-1][:, None] + m).min(axis=0), INF))
    for m in reversed(matrices[1:]):
        behind.append(np.minimum((m + behind[-1][None, :]).min(axis=1), INF))
    # Behind a block the next one may insert in front of its first row: its matrix includes that.
    return pd.DataFrame({"_block": pdf["_block"], "_before": [x.tolist() for x in before], "_behind": [x.tolist() for x in behind[::-1]], "_last": np.arange(len(pdf)) == len(pdf) - 1})


def _choices(_initials: str, _faults: str, _before: list[int], _behind: list[int], _last: bool, **_) -> tuple:
    """For each entry state that lies on a cheapest way: edits, exit state, rows left; and the total."""
    behind = backward(_initials, _faults, _behind)
    before = forward(_initials, _faults, _before)
    if _last:
        before[-1] = _inserted(before[-1])
    total = min(f + b for f, b in zip(before[0], behind[0], strict=True))
    audits: list[str | None] = [None] * 4
    exits, left = [-1] * 4, [0] * 4
    for s in range(4):
        if before[0][s] + behind[0][s] == total:
            audits[s], exits[s] = spelled(_initials, _faults, before, behind, s, _last)
            left[s] = len(audits[s]) - audits[s].count("D")
    return audits, exits, left, total


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """The entry state of each block, and the rows that are left before it."""
    state, place, starts, places = 0, 0, [], []
    pdf = pdf.sort_values("_block")
    for exits, left in zip(pdf["_exits"], pdf["_left"], strict=True):
        starts.append(state)
        places.append(place)
        place, state = place + int(left[state]), int(exits[state])
    return pd.DataFrame({"_block": pdf["_block"], "_state": starts, "_place": places})


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Gaps and illegal pairs of a conversation from its blocks' ends."""
    pdf = pdf.sort_values("_block")
    low = high = None
    last, distinct, illegal = "", 0, 0
    for lo, hi, n, first, end, inside in zip(*(pdf[c] for c in ("_low", "_high", "_turns", "_begin", "_end", "_inside")), strict=True):
        if n:
            distinct += int(n) - (high is not None and int(lo) == high)
            low, high = int(lo) if low is None else low, int(hi)
        if first:
            illegal += int(inside) + bool(last and last + first not in LEGAL)
            last = end
    return pd.DataFrame({"_head": pdf["_block"].iloc[:1], "gaps": [_gaps(low, high, distinct)], "illegal": [illegal]})


def _large(blocks: DataFrame) -> DataFrame:
    """Of conversations that may have several blocks: _conv, _block, _state, _place, _audit, _total, _faults and what ``blocks`` has but the texts."""
    rows = blocks.select("_conv", "_block", "_faults", F.posexplode(F.arrays_zip("_roles", "_texts")).alias("_at", "_turn"))
    text = F.concat(F.length("_turn._roles").cast("string"), F.lit(":"), F.col("_turn._roles"), F.col("_turn._texts"))
    rows = rows.filter(F.substring("_faults", F.col("_at") + 1, F.lit(1)).isin("-", "t")).select("_conv", "_block", "_at", F.sha2(F.encode(text, "UTF-8"), 256).alias("_key"))
    seen = rows.groupBy(F.col("_conv").alias("_c"), F.col("_key").alias("_k")).agg(F.min("_block").alias("_first"), F.max("_block").alias("_latest")).filter("_latest > _first")
    again = rows.join(seen, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_key") == F.col("_k")) & (F.col("_block") > F.col("_first")))
    again = again.groupBy(F.col("_block").alias("_b")).agg(F.collect_list(F.col("_at").cast("long")).alias("_again"))
    slim = blocks.select("_conv", "_block", "_initials", "_faults", "_low", "_high", "_turns").join(again, F.col("_block") == F.col("_b"), "left").drop("_b")
    slim = _added(slim, "_judged string, _costs array<long>", ["string", "longs"], _matrix).drop("_faults", "_again").withColumnRenamed("_judged", "_faults")
    slim = saved(slim, "conversation-costs")
    bounds = slim.select("_conv", "_block", "_costs").groupBy("_conv").applyInPandas(_bounds, "_block long, _before array<long>, _behind array<long>, _last boolean")
    found = _added(slim.drop("_costs").join(bounds, "_block"), "_audits array<string>, _exits array<long>, _left array<long>, _total long", ["strings", "longs", "longs", "long"], _choices)
    found = saved(found.drop("_before", "_behind", "_last"), "conversation-choices")
    walks = found.select("_conv", "_block", "_exits", "_left").groupBy("_conv").applyInPandas(_walk, "_block long, _state int, _place long")
    return saved(found.join(walks, "_block").withColumn("_audit", F.element_at("_audits", F.col("_state") + 1)).drop("_audits", "_exits", "_left"), "conversation-edits")


def _digests(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """_conv, _sha: the repaired conversations' digests; each streams through one task, a block at a time."""
    texts = blocks.select("_block", "_roles", "_texts").join(edits.select("_conv", "_block", "_audit", "_state"), "_block")

    def joined(_audit: str, _roles: list[str], _texts: list[str], _state: int, **_) -> tuple:
        lines = [f"{role}:{text}" for _, role, text in applied(_audit, _roles, _texts, _state)]
        return ("\n".join(lines) if lines else None,)

    texts = _added(texts, "_body string", ["string"], joined).select("_conv", "_block", "_body")
    texts = texts.repartition("_conv").sortWithinPartitions(F.col("_conv").asc_nulls_first(), "_block")
    schema = T.StructType([texts.schema["_conv"], T.StructField("_sha", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_, name, kind, state, begun, done = False, None, None, None, False, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], kind), pa.array([x for _, x in done], pa.string())], names=["_conv", "_sha"])
        for batch in batches:
            kind = batch.schema.field(0).type
            for i in range(batch.num_rows):
                conv, body = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if not any_ or conv != name:
                    if any_:
                        done.append((name, state.hexdigest()))
                    any_, name, state, begun = True, conv, hashlib.sha256(), False
                if body is not None:
                    state.update((b"\n" if begun else b"") + body.encode("utf-8"))
                    begun = True
            if len(done) >= MOST_ROWS:
                yield out()
                done = []
        if any_:
            done.append((name, state.hexdigest()))
            yield out()

    return texts.mapInArrow(run, schema)


def _report(_roles: list[str], _texts: list[str], _initials: str, _faults: str, _low: int | None, _high: int | None, _turns: int, **_) -> tuple:
    cost, audit = settled(_roles, _texts, _initials, _faults)
    body = "\n".join(f"{role}:{text}" for _, role, text in applied(audit, _roles, _texts, 0))
    counts = [_faults.count(x) for x in "bdt"]
    return _gaps(_low, _high, _turns), *counts, _illegal(_initials), cost, audit, hashlib.sha256(body.encode("utf-8")).hexdigest()


KINDS = ["long"] * 6 + ["string"] * 2
TEXTS = ("_roles", "_texts", "_initials", "_faults", "_low", "_high", "_turns")


def audit(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """One row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows for which ``present`` is not true only name their conversation.
    """
    blocks = _blocks(turns, conv_col, turn_col, role_col, text_col, present)
    names = [f.name for f in T._parse_datatype_string(OUT).fields]
    few = _added(blocks.filter("not _edge").drop("_edge", "_block"), OUT, KINDS, _report, TEXTS)
    edges = blocks.filter("_edge")
    edits = _large(edges)
    held = lambda x: F.sum(F.length("_faults") - F.length(F.translate("_faults", x, ""))).cast("long")
    stats = edits.select("_conv", "_block", "_initials", F.coalesce("_low", F.lit(0)).alias("_low"), F.coalesce("_high", F.lit(0)).alias("_high"), "_turns")
    stats = _added(stats, "_inside long", ["long"], lambda _initials, **_: (_illegal(_initials),))
    stats = stats.select("_conv", "_block", "_low", "_high", "_turns", "_inside", F.substring("_initials", 1, 1).alias("_begin"), F.substring("_initials", -1, 1).alias("_end"))
    ends = stats.groupBy("_conv").applyInPandas(_summed, "_head long, gaps long, illegal long")
    totals = edits.groupBy("_conv").agg(
        F.min("_block").alias("_head"), held("b").alias("blank"), held("d").alias("duplicate"), held("t").alias("truncated"), F.min("_total").alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_audit"))), lambda x: x["_audit"]), "").alias("audit"),
    )
    digests = _digests(edges, edits).withColumnsRenamed({"_conv": "_other", "_sha": "repaired_sha256"})
    many = totals.join(ends, "_head").join(digests, F.col("_conv").eqNullSafe(F.col("_other"))).select("_conv", *names)
    return few.unionByName(many).withColumnRenamed("_conv", conv_col)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None) -> DataFrame:
    """The repaired conversations, one row per turn: id, place (from 0), edit (K, R or I), role, text."""
    blocks = _blocks(turns, conv_col, turn_col, role_col, text_col, present)

    def edits_of(_roles: list[str], _texts: list[str], _initials: str, _faults: str, **_) -> tuple:
        return (settled(_roles, _texts, _initials, _faults)[1],)

    few = _added(blocks.filter("not _edge").select("_conv", "_roles", "_texts", "_initials", "_faults"), "_audit string", ["string"], edits_of)
    few = few.select("_conv", "_roles", "_texts", "_audit", F.lit(0).alias("_state"), F.lit(0).cast("long").alias("_place"))
    edges = blocks.filter("_edge")
    many = edges.select("_block", "_roles", "_texts").join(_large(edges).select("_conv", "_block", "_audit", "_state", "_place"), "_block").select(*few.columns)

    def rows_of(_audit: str, _roles: list[str], _texts: list[str], _state: int, **_) -> tuple:
        found = list(applied(_audit, _roles, _texts, _state))
        return tuple([x[k] for x in found] for k in range(3))

    found = _added(few.unionByName(many), "_edits array<string>, _new_roles array<string>, _new_texts array<string>", ["strings"] * 3, rows_of)
    found = found.select("_conv", "_place", F.posexplode(F.arrays_zip("_edits", "_new_roles", "_new_texts")).alias("_at", "_turn"))
    return found.select(F.col("_conv").alias(conv_col), (F.col("_place") + F.col("_at")).alias("place"), F.col("_turn._edits").alias("edit"), F.col("_turn._new_roles").alias(role_col), F.col("_turn._new_texts").alias(text_col))
