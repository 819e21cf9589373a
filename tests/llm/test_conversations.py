"""Conversation repair against all edits in order of cost, and blocks against whole ones."""

import hashlib
import heapq
import random

import pytest
from helpers import frame

from tracemill.llm import conversation_repair as repair
from tracemill.llm.queries import damaged

SPACES = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


def accepted(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or rest != "" and rest == "ua" * (len(rest) // 2)


def faults(messages):
    out = []
    for i, (role, text) in enumerate(messages):
        solid = text.strip(SPACES)
        if not solid:
            out.append("blank")
        elif (role, text) in messages[:i]:
            out.append("duplicate")
        else:
            out.append("fine" if solid[-1] in ".!?" else "truncated")
    return out


def cheapest(messages):
    """Cost, audit and messages by trying edits in order of cost and letters."""
    kinds = faults(messages)
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        initials = "".join(role[:1] for role, _ in out)
        if i == len(messages) and accepted(initials):
            return cost, audit, out
        # Two ways to the same rest of rows and last role have the same ways on.
        key = (i, initials[-1:], len(initials) > 0)
        if (key, cost, audit) in seen or not can_go_on(initials):
            continue
        seen.add((key, cost, audit))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, (*out, (role, ""))))
        if i < len(messages):
            role, text = messages[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, out))
            if kinds[i] in ("fine", "truncated"):
                more = 3 if kinds[i] == "truncated" else 0
                if role:  # without a first letter there is nothing to keep to the rules
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, (*out, (new, text))))


def can_go_on(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return rest == ("ua" * len(rest))[: len(rest)]


def conversation(pick, size):
    roles = pick.choices(["user", "assistant", "system", "tool", ""], [8, 8, 2, 1, 1], k=size)
    return [(r, pick.choice(["One.", "Two!", "Three?", "cut", " ", "", "a. \n", "b c"])) for r in roles]


def test_search_finds_the_cheapest_first_edits():
    pick = random.Random(3)
    for _ in range(400):
        messages = conversation(pick, pick.randint(0, 5))
        kinds = [repair._kind(None if x == "fine" else x) for x in faults(messages)]
        initials = [role[:1] for role, _ in messages]
        cost, audit, out = cheapest(messages)
        assert repair.cheapest_edits(initials, kinds) == (cost, audit)
        assert tuple(repair.edited(messages, audit)) == out


def digest(messages):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()


def expected(rows):
    """(id, counts, cost, audit, digest) of rows (id, turn, role, text) by plain Python."""
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by_conv.items():
        own.sort()
        turns = {turn for known, turn, *_ in own if known}
        messages = [row[2:] for row in own]
        kinds = faults(messages)
        initials = [role[:1] for role, _ in messages]
        whole = repair.cheapest_edits(initials, [repair._kind(None if x == "fine" else x) for x in kinds])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            kinds.count("blank"),
            kinds.count("duplicate"),
            kinds.count("truncated"),
            sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            *whole,
            digest(repair.edited(messages, whole[1])),
        )
    return out


def found(pieces):
    rows = repair.conversation_digests(pieces).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[name] for name in names) for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rows_each, bytes_each", [(1, 1 << 20), (3, 1 << 20), (500, 1 << 20), (500, 6)])
def test_blocks_give_what_whole_conversations_give(spark, rows_each, bytes_each):
    """One conversation holds a third of all rows, and one turn many of its rows."""
    pick = random.Random(rows_each)
    rows = []
    for conv in [None, *range(20)]:
        for role, text in conversation(pick, pick.choice([1, 2, 7, 30])):
            rows.append((conv, pick.choice([None, 1, 2, 3, 4, 9]), role or None, text or None))
    rows += [(7, pick.choice([5, 6, 8, 40]), *m) for m in conversation(pick, len(rows) // 2)]
    blocks = {"block_rows": rows_each, "block_bytes": bytes_each}
    pieces = repair.repair_conversations(frame(spark, rows, SCHEMA), **blocks)
    assert found(pieces) == expected(rows)
    assert pieces.where("size(messages) > 2 * length(audit)").count() == 0


def test_long_conversations_take_few_looks():
    """Rows against the rules everywhere: the bound rises seldom, as much is known before."""
    pick = random.Random(1)
    initials = pick.choices("suax", [1, 5, 5, 1], k=500)
    kinds = pick.choices(["fine", "truncated", "gone"], [6, 1, 1], k=500)
    cost, letters = repair.cheapest_edits(initials, kinds)
    whole = repair._needs(initials, kinds, True)
    assert whole[0] <= cost and len(letters) >= 500
    # What suffixes need at least is never more than what they cost.
    for i in range(470, 500):
        assert whole[i] <= min(repair.cheapest_edits(initials[i:], kinds[i:], s)[0] for s in repair.STATES)


def test_edge_cases(spark):
    long = "x" * 3_000_000
    rows = [
        (1, None, None, None), (2, 0, "system", "Alone."), (3, 5, "user", long), (3, 6, "user", long),
        (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (4, 0, "assistant", " \n"),
        (5, 0, "user", "Gut."), (5, 1, "assistant", "Ünï 語。"), (5, 3, "assistant", "Ende!"),
    ]
    assert found(repair.repair_conversations(frame(spark, rows, SCHEMA))) == expected(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(none).count() == 0
    made = repair.all_conversations(found_frame(repair.repair_conversations(none)), frame(spark, rows, SCHEMA))
    empty = {tuple(r)[1:] for r in made.collect()}
    assert empty == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and made.count() == 6
    assert {r.copy for r in damaged(frame(spark, rows, SCHEMA)).collect()} <= {0}


def found_frame(pieces):
    return repair.conversation_digests(pieces)
