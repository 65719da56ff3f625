import hashlib
import heapq
import random
import re
import zlib

import pytest

from pathloom.llm import queries, repair
from tests.llm.cases import clashing

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
ACCEPTED = re.compile("(s?(ua)+)?")
OPEN = re.compile("(s?(ua)*u?)?")  # what can still become accepted


def damage(rows):
    """Rows of one conversation after damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        role = "user" if how == 4 else role
        out += [(turn, role, text)] * (2 if how == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else
                   "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Least (cost, audit) by trying the cheaper and ASCII-lesser path first, with what it leaves."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, kept = heapq.heappop(heap)
        # the last initials and whether a system row came decide what may follow; of equal ones the first is the best
        state = (i, initials[-1:], len(initials) > 1)
        if i == len(rows) and ACCEPTED.fullmatch(initials):
            return cost, audit, kept
        if state in done:
            continue
        done.add(state)

        def put(c, letter, to, role, text):
            if role is None:
                heapq.heappush(heap, (cost + c, audit + letter, to, initials, kept))
            elif OPEN.fullmatch(initials + role[:1]) and role:
                heapq.heappush(heap, (cost + c, audit + letter, to, initials + role[:1], (*kept, (role, text))))

        for role in ("user", "assistant"):
            put(5, "I", i, role, "")
        if i < len(rows):
            _, role, text = rows[i]
            put(2, "D", i + 1, None, None)
            if marks[i] not in ("blank", "duplicate"):
                more = 5 * (marks[i] == "truncated")
                put(more, "K", i + 1, role, text)
                for other in ("user", "assistant"):
                    put(1 + more, "R", i + 1, other, text)
    raise AssertionError


def brute(table):
    out = []
    for conv in {r[0] for r in table}:
        rows = damage([r for r in table if r[0] == conv])
        marks = faults(rows)
        turns = [r[0] for r in rows if r[0] is not None]
        cost, audit, kept = cheapest(rows, marks)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, marks.count("blank"),
                    marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return sorted(out, key=str)


def verdicts(df, **how):
    found = repair.repair(repair.damaged(df), **how).verdicts
    assert found.columns == repair.VERDICT
    return sorted((tuple(r) for r in found.collect()), key=str)


def conversations(seed, n=150, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \n", "Long one. And", "Well. \n", "ok"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "umpire"]
    return [(c, t if rng.random() > 0.1 else None, rng.choice(roles), rng.choice([*texts, f"Line {t}.", None]))
            for c in range(n) for t in range(rng.randrange(1, longest))]


def alternating(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        roles = (["system"] if rng.random() < 0.4 else []) + ["user", "assistant"] * rng.randrange(1, 6)
        for t, role in enumerate(roles):
            if rng.random() > 0.1:
                rows.append((c, t, role if rng.random() > 0.1 else rng.choice(roles), f"Said {t} in {c}."))
    return rows


@pytest.mark.parametrize("rows", [conversations(1), conversations(2), alternating(3)], ids=["wild", "wild2", "tame"])
def test_equals_brute_force(make, rows):
    want = brute(rows)
    assert verdicts(make(TURNS, rows)) == want
    assert verdicts(make(TURNS, rows), piece_rows=2) == want  # nearly every conversation is cut
    assert verdicts(make(TURNS, rows), piece_rows=1) == want


def test_search_equals_all_paths():
    rng = random.Random(6)
    for _ in range(400):
        rows = tuple((rng.choice("usa t"), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([1, 1, 1, 3]))
                     for _ in range(rng.randrange(7)))
        spread, marks = [], []
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        for initial, fault, copies in rows:
            spread += [(None, initial, "x")] * copies
            marks += [names[fault]] + [names[fault] if fault in (1, 2) else "duplicate"] * (copies - 1)
        cost, audit, _ = cheapest(spread, marks)
        assert repair.repaired(rows, repair.START, repair.ACCEPT) == (cost, audit)


def test_odd_rows(make):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (None, 1, "user", "A."), (1, None, "user", None),
            (1, 5, "assistant", "x" * 300_000 + "."), (1, 5, "assistant", "y" * 50), (2, -2**63, "user", "Q?"),
            (2, 2**63 - 1, "assistant", "A!"), (3, 0, "", ""), (4, 0, "system", "Only."), (5, 0, "user", "tab.\t"),
            *[(6, 3, "user", "Same.")] * 7, *[(7, t, "assistant", "Same.") for t in range(9)],
            (8, 0, "s\u00e9", "\u00e9."), (8, 1, "\U0001f600", "\U0001f600"), (8, 2, "user", "\u3000")]
    want = [(r[0], min(r[1], 2**63 - 1), *r[2:]) for r in brute(rows)]
    df = make(TURNS, rows)
    clash = clashing(df)
    for c in ("copies", "fault", "said", "first", "part", "seq", "closed", "entry", "goal", "total", "audit"):
        clash = clash.withColumn(c, clash.text)
    for table in (df, clash):
        for size in (64, 2):
            assert verdicts(table, piece_rows=size) == sorted(want, key=str)
    assert verdicts(make(TURNS, [])) == []
    assert verdicts(make(TURNS, [(9, None, "user", "x")])) == sorted(brute([(9, None, "user", "x")]), key=str)


def test_one_conversation_holds_most_rows(make):
    rng = random.Random(11)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]),
             rng.choice(["Yes.", f"Turn {t}.", "cut", f"open {t}"])) for t in range(900)] + alternating(12, 40)[20:]
    rows = [r if r[0] == 1 and i < 900 else (r[0] + 10, *r[1:]) for i, r in enumerate(rows)]
    found = repair.repair(repair.damaged(make(TURNS, rows)))
    assert sorted((tuple(r) for r in found.verdicts.collect()), key=str) == brute(rows)
    left = found.turns.where("conv_id = 1").orderBy("part", "seq", "place").collect()
    text = "\n".join(f"{r.role}:{r.text}" for r in left)
    assert hashlib.sha256(text.encode()).hexdigest() == next(r[-1] for r in brute(rows) if r[0] == 1)
    pieces = repair.cut_into_pieces(repair.with_faults(repair.damaged(make(TURNS, rows)))).where("conv_id = 1")
    assert pieces.count() > 10


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = queries.op13_conversations(spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)
