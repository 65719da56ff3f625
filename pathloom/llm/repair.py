"""Cheapest repair of damaged conversations by iterative-deepening A*.

Rows are ordered by (conversation, turn, role, text) over range partitions and cut into pieces: the rows that one
conversation has in one partition, ``PIECE_ROWS`` of them at most. A search runs over the rows of a piece, depth first in the
ASCII order of the edits (Delete, Insert, Keep, Rerole) under a cost bound that rises by one. A state is the number of
rows passed and what the last role was; the table of failed states holds the largest budget with which each was left
without success. The first path that is accepted is the cheapest and, among those, the ASCII-least. The costs
that the remaining rows have in any case are the estimate that cuts paths off.

Most conversations are one piece. For one that is cut, each piece gives the cheapest edits from every state it may be
entered in to every state it may be left in; one pass over these small summaries picks the states at the cuts, the least
edits among equal costs. An Insert belongs to the row behind it, so edits of the same rows are never prefixes of each
other and the first piece that differs decides.

Equal rows are folded to one with a number of copies before anything is ordered, and a text said before is found by a
join on digests with the first turn of each, so neither a long conversation nor a repeated row lies in one task; only
the hash over a cut conversation is a stream through one task, piece by piece.

Defined results: a null id or turn is a space in the key of the damage and else stays null (turns: first); null
roles and texts become one space. Rows of one turn follow each other by role, then text; equal rows side by side. The
initial of an empty role is empty and cannot be kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.common import staged

PIECE_ROWS = 64
PIECE_CHARS = 4 << 20  # of text, at which a piece ends too
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
LEGAL = ("su", "ua", "au")
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)

START, SYSTEM, USER, ASSISTANT = range(4)  # what the last kept or inserted role was
ACCEPT = 4  # as a goal: the conversation ends here
_NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
_KEEP = {(START, "s"): SYSTEM, **{(q, "u"): USER for q in (START, SYSTEM, ASSISTANT)}, (USER, "a"): ASSISTANT}


# ---- damage and faults: columns only

def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows damaged by the checksum of their key; a row that is dropped
    leaves a row of no copies, so that its conversation stays known."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    how = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = (F.when(how == 1, "").when(how == 2, F.regexp_replace(spaced(text_col), "[.!?]", ""))
            .otherwise(spaced(text_col)))
    gone = how == 0
    return rows.select(
        F.col(conv_col).alias("conv_id"), F.when(~gone, F.col(turn_col).cast("long")).alias("turn"),
        F.when(gone, "").when(how == 4, "user").otherwise(spaced(role_col)).alias("role"),
        F.when(gone, "").otherwise(text).alias("text"),
        F.when(gone, 0).when(how == 3, 2).otherwise(1).cast("long").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Distinct rows with their ``copies`` and the ``fault`` of the first of them."""
    def sized(c: Column) -> Column:
        return F.concat(F.char_length(c).cast("string"), F.lit(":"), c)

    conv = F.col("conv_id").cast("string")
    said = F.md5(F.concat(F.coalesce(sized(conv), F.lit("-")), sized(F.col("role")), F.col("text")).cast("binary"))
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("said", said)
    first = folded.where("copies > 0").groupBy("said").agg(F.min(F.struct("turn")).alias("first"))
    found = folded.join(first, "said", "left")
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    fault = (F.when(trimmed == "", BLANK)
             .when(F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")), DUPLICATE)
             .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(SOUND))
    return found.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


# ---- the search

@lru_cache(maxsize=1 << 16)
def repaired(rows: tuple, entry: int, goal: int):
    """Least cost and edits that lead over ``rows``, each (initial, fault, copies), from one state to another; None if
    nothing does. Only with the goal ACCEPT may inserts follow the last row."""
    n = len(rows)
    doomed = [fault in (BLANK, DUPLICATE) for _, fault, _ in rows]
    repeats = [DELETE * (copies - 1) for *_, copies in rows]
    least = [0] * (n + 1)  # what rows from i on cost in any case
    for i in reversed(range(n)):
        least[i] = least[i + 1] + repeats[i] + (DELETE if doomed[i] or rows[i][1] == CUT_OFF else 0)
    failed: dict[tuple[int, int], int] = {}

    def edits(i: int, state: int):
        """(letter, cost, next row, next state) in ASCII order."""
        if i < n:
            yield "D", DELETE + repeats[i], i + 1, state
        if i < n or goal == ACCEPT:
            yield "I", INSERT, i, _NEXT[state][0]
        if i < n and not doomed[i]:
            cost = repeats[i] + (TRUNCATED if rows[i][1] == CUT_OFF else 0)
            if (state, rows[i][0]) in _KEEP:
                yield "K", cost, i + 1, _KEEP[state, rows[i][0]]
            yield "R", cost + REROLE, i + 1, _NEXT[state][0]

    def search(i: int, state: int, budget: int):
        if budget < least[i] or budget <= failed.get((i, state), -1):
            return None
        if i == n and (state == goal or goal == ACCEPT and state in (START, ASSISTANT)):
            return []
        for letter, cost, to, then in edits(i, state):
            if cost <= budget and (path := search(to, then, budget - cost)) is not None:
                path.append(letter + "D" * (rows[i][2] - 1) if to > i else letter)
                return path
        failed[i, state] = budget
        return None

    for bound in range(least[0], least[0] + sum(DELETE for _ in rows) + 2 * INSERT + 1):
        path = search(0, entry, bound)
        if path is not None:
            return bound, "".join(reversed(path))
    return None


def applied(audit: str, roles: list[str], texts: list[str], copies: list[int], state: int) -> list[tuple[str, str]]:
    """(role, text) of what the edits leave."""
    out, at = [], 0
    letters = iter(audit)
    for letter in letters:
        if letter == "I":
            state, role = _NEXT[state]
            out.append((role, ""))
            continue
        if letter == "K":
            state = _KEEP[state, roles[at][:1]]
            out.append((roles[at], texts[at]))
        elif letter == "R":
            state, role = _NEXT[state]
            out.append((role, texts[at]))
        for _ in range(copies[at] - 1):
            next(letters)
        at += 1
    return out


# ---- pieces

def _piece_fields(conv: T.DataType) -> T.StructType:
    rest = T._parse_datatype_string("part int, seq int, closed boolean, turns array<bigint>, roles array<string>, "
                                    "texts array<string>, faults array<int>, copies array<bigint>")
    return T.StructType([T.StructField("conv_id", conv), *rest.fields])


def cut_into_pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Rows in order, as pieces. ``closed``: the piece is a whole conversation."""
    ordered = rows.select("conv_id", "turn", "role", "text", "fault", "copies").repartitionByRange(
        "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = _piece_fields(rows.schema["conv_id"].dataType)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, kind, out, ready = TaskContext.get().partitionId(), None, [], 0
        own, seq, size, begun, first = [], 0, 0, False, True  # ``seq`` numbers the pieces of a partition

        def piece(closed: bool):
            conv = own[0][0]
            real = [r for r in own if r[5]]
            turns, roles, texts, faults, copies = ([r[i] for r in real] for i in range(1, 6))
            return conv, part, seq, closed, turns, roles, texts, faults, copies

        def batch_of(rows_out):
            columns = list(zip(*rows_out))
            types = [kind, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()),
                     pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if own and (row[0] != own[0][0] or len(own) >= piece_rows or size >= PIECE_CHARS):
                    ends = row[0] != own[0][0]
                    out.append(piece(ends and not begun and not first))
                    ready += size
                    begun, first = not ends, first and not ends
                    own, seq, size = [], seq + 1, 0
                    if len(out) >= 4096 or ready >= PIECE_CHARS:
                        yield batch_of(out)
                        out, ready = [], 0
                own.append((row[0], row[1], row[2], row[3], row[4], row[5]))
                size += len(row[3])
        if own:
            yield batch_of([*out, piece(False)])

    return ordered.mapInArrow(run, schema)


def _key(piece: dict) -> tuple:
    return tuple(zip((r[:1] for r in piece["roles"]), piece["faults"], piece["copies"]))


_SUMMARY = "part int, seq int, costs array<bigint>, audits array<string>"
_PATH = "part int, seq int, entry int, goal int, total bigint"


def summaries(pieces: DataFrame) -> DataFrame:
    """For each piece and each pair of state it is entered in and goal: least cost (null: no way) and edits."""
    schema = T.StructType([pieces.schema["conv_id"], *T._parse_datatype_string(_SUMMARY).fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p in batch.to_pylist():
                key = _key(p)
                found = [repaired(key, entry, goal) or (None, None) for entry in range(4) for goal in range(5)]
                costs, audits = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["conv_id"]], batch.schema.field("conv_id").type), pa.array([p["part"]], pa.int32()),
                     pa.array([p["seq"]], pa.int32()), pa.array([costs], pa.list_(pa.int64())),
                     pa.array([audits], pa.list_(pa.string()))], names=schema.names)

    return pieces.mapInArrow(run, schema)


def chosen_states(summary: DataFrame) -> DataFrame:
    """The state each piece of a cut conversation is entered in and its goal, and the cost of the whole."""

    def run(table):
        import pyarrow as pa

        rows = sorted(table.select(["part", "seq", "costs", "audits"]).to_pylist(), key=lambda r: (r["part"], r["seq"]))
        def ways(c: int, entry: int):
            goals = [ACCEPT] if c == len(rows) - 1 else range(4)
            for g in goals:
                cost = rows[c]["costs"][5 * entry + g]
                if cost is not None and after[c + 1][g] is not None:
                    yield cost + after[c + 1][g], rows[c]["audits"][5 * entry + g], g

        after = [[None] * 5 for _ in rows] + [[0] * 5]
        for c in reversed(range(len(rows))):
            for entry in range(4):
                after[c][entry] = min((w[0] for w in ways(c, entry)), default=None)
        out, state = [], START
        for c, r in enumerate(rows):
            *_, goal = min(ways(c, state))
            out.append((r["part"], r["seq"], state, goal, after[0][START]))
            state = goal
        names, columns = ["part", "seq", "entry", "goal", "total"], list(zip(*out))
        kinds = [pa.int32()] * 4 + [pa.int64()]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)})

    return summary.groupBy("conv_id").applyInArrow(run, _PATH)


_MENDED = ("part int, seq int, closed boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
           "illegal bigint, cost bigint, audit string, repaired_sha256 string, turns array<bigint>, "
           "initials array<string>, repaired array<struct<role:string,text:string>>")


def _adjacent(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else min(last - first + 1 - distinct, 2**63 - 1)


def _joined(repaired_rows) -> str:
    return "\n".join(f"{role}:{text}" for role, text in repaired_rows)


def mended(pieces: DataFrame) -> DataFrame:
    """Counts, edits and repaired rows of each piece, by the columns ``entry``, ``goal`` and ``total``. ``turns`` are the
    first and last turn and the number of distinct ones, ``initials`` the first and last."""
    schema = T.StructType([pieces.schema["conv_id"], *T._parse_datatype_string(_MENDED).fields])

    def run(batches):
        import pyarrow as pa

        row_type = pa.struct([("role", pa.string()), ("text", pa.string())])
        kinds = [pa.int32(), pa.int32(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.int64()),
                 pa.list_(pa.string()), pa.list_(row_type)]
        for batch in batches:
            conv, out = batch.schema.field("conv_id").type, []
            for p in batch.to_pylist():
                faults, copies, initials = p["faults"], p["copies"], [r[:1] for r in p["roles"]]
                cost, audit = repaired(_key(p), p["entry"], p["goal"])
                rows = applied(audit, p["roles"], p["texts"], copies, p["entry"])
                turns = [t for t in p["turns"] if t is not None]
                span = [turns[0], turns[-1], len(set(turns))] if turns else [None, None, 0]
                blank = sum(c for f, c in zip(faults, copies) if f == BLANK)
                twice = sum(c if f == DUPLICATE else c - 1 for f, c in zip(faults, copies) if f != BLANK)
                out.append((
                    p["conv_id"], p["part"], p["seq"], p["closed"], _gaps(*span), blank, twice, faults.count(CUT_OFF),
                    _adjacent(initials) + sum(c - 1 for c in copies), cost if p["total"] is None else p["total"], audit,
                    hashlib.sha256(_joined(rows).encode()).hexdigest(), span,
                    [initials[0], initials[-1]] if initials else [], [{"role": r, "text": t} for r, t in rows]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [conv, *kinds])],
                                                 names=schema.names)

    return pieces.mapInArrow(run, schema)


VERDICT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def merged(pieces: DataFrame) -> DataFrame:
    """One verdict for each cut conversation from its mended pieces, which come in order, one at a time."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    schema = T.StructType([pieces.schema[c] for c in VERDICT])

    def run(batches):
        import pyarrow as pa

        kind = None

        def each():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                for i in range(batch.num_rows):
                    yield batch.slice(i, 1).to_pylist()[0]

        for conv, own in groupby(each(), key=lambda p: p["conv_id"]):
            counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            digest, audit, cost, begun, last = hashlib.sha256(), [], 0, False, None
            low = high = None
            distinct = 0
            for p in own:
                for c in counts:
                    counts[c] += p[c]
                if p["initials"]:
                    counts["illegal"] += last is not None and last + p["initials"][0] not in LEGAL
                    last = p["initials"][1]
                first, end, n = p["turns"]
                if first is not None:
                    distinct += n - (first == high)
                    low, high = first if low is None else low, end
                if p["repaired"]:
                    digest.update(("\n" * begun + _joined((r["role"], r["text"]) for r in p["repaired"])).encode())
                    begun = True
                audit.append(p["audit"])
                cost = p["cost"]
            row = (conv, _gaps(low, high, distinct), *counts.values(), cost, "".join(audit), digest.hexdigest())
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=VERDICT)

    return ordered.mapInArrow(run, schema)


class Repair(NamedTuple):
    """``verdicts``: one row per conversation. ``turns``: what the repair leaves, one row per turn; a conversation's
    turns follow each other by ``part, seq, place``."""

    verdicts: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> Repair:
    """Cheapest repair of every conversation in ``conv_id, turn, role, text, copies`` (see ``damaged``)."""
    pieces = staged(cut_into_pieces(with_faults(rows), piece_rows), "conversation_pieces")
    whole = pieces.where("closed").withColumns(
        {"entry": F.lit(START), "goal": F.lit(ACCEPT), "total": F.lit(None).cast("long")})
    parts = pieces.where("NOT closed")
    path = chosen_states(summaries(parts))
    cut = staged(mended(parts.join(path, ["part", "seq"])), "conversation_parts")
    whole = mended(whole)
    verdicts = whole.select(*VERDICT).unionByName(merged(cut))
    turns = whole.unionByName(cut).select("conv_id", "part", "seq", F.posexplode("repaired").alias("place", "row")).select(
        "conv_id", "part", "seq", "place", "row.role", "row.text")
    return Repair(verdicts, turns)
