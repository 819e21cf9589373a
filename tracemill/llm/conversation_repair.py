"""Cheapest repair of conversations, so that their roles alternate as they should.

A repaired conversation is empty, or has a system message or none, and then user and
assistant in turns. Messages may be kept (K), get another role (R), or be deleted (D),
and empty ones may be inserted (I). Of all cheapest edits the first in ASCII order is
taken. It is found by iterative-deepening A*: a depth-first search tries the edits in
ASCII order and gives up a branch whose cost, with what it needs at least, is over the
bound; a table keeps for every failed state what it was found to need, and the bound
rises to what the start needs. The first path that is accepted is the answer.

A conversation of ordinary size is repaired in one piece. One of more rows or bytes is
cut into blocks: the search runs over each block for every state it may begin and end
in, the blocks' costs are put together by parts and by conversation, and each block
takes the edits between the states that the whole conversation gives it. An edit is one
letter and a letter leads to one state, so edits between two states of a block differ
in a letter, and blocks can be compared one after the other.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.stored import bounded, same, stored, texts_of

# A conversation of more is cut into blocks of at most so many rows and bytes (a
# longer text is a block of its own).
BLOCK_ROWS = 500
BLOCK_BYTES = 4 << 20

# Costs of edits, what is no content, and what ends a message.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"

# Where a conversation may stand: before its first message, or after one of these.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_AFTER = {
    (START, "s"): SYSTEM,
    (START, "u"): USER,
    (SYSTEM, "u"): USER,
    (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
# The state after an inserted message, or one that gets the role it has to have.
_NEXT = (USER, USER, ASSISTANT, USER)
# Inserts that complete a conversation.
_TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_LEGAL = {"su", "ua", "au"}
NEVER = float("inf")

FINE, CUT, GONE = "fine", "truncated", "gone"


def fault_of(text: str, seen: bool) -> str | None:
    """The first fault of a message: ``blank``, ``duplicate``, ``truncated`` or none."""
    solid = text.rstrip(SPACES)
    if not solid:
        return "blank"
    if seen:
        return "duplicate"
    return None if solid[-1] in ENDS else CUT


def _kind(fault: str | None) -> str:
    return GONE if fault in ("blank", "duplicate") else fault or FINE


def _needs(initials: Sequence[str], kinds: Sequence[str], whole: bool) -> list[int]:
    """What the rows from each place on cost at least, whatever the state.

    Each row has its own least cost. Two rows that would follow one another against the
    rules need an edit more, to one of them or between them; such pairs are counted
    where they have no row in common, so no edit is counted twice.
    """
    total = 0
    needs = [0] * (len(initials) + 1)
    right = ("", FINE) if whole else None  # the end wants an assistant before it
    for i in range(len(initials) - 1, -1, -1):
        first, kind = initials[i], kinds[i]
        if kind == GONE:
            total += DELETE
        elif first not in ("s", "u", "a"):
            total += min(DELETE, REROLE + (TRUNCATED if kind == CUT else 0))
            right = None
        else:
            total += TRUNCATED if kind == CUT else 0
            if right is None:
                right = (first, kind)
            else:
                ok = first + right[0] in _LEGAL if right[0] else first == "a"
                if ok:
                    right = (first, kind)
                else:
                    # A truncated row is one more than it costs anyway, if it goes.
                    total += DELETE - TRUNCATED if CUT in (kind, right[1]) else REROLE
                    right = None
        needs[i] = total
    return needs


def _edits(
    place: int, state: int, initials: Sequence[str], kinds: Sequence[str], whole: bool
) -> Iterator[tuple[str, int, int, int]]:
    """Edits in ASCII order: letter, cost, and the place and state after it."""
    inside = place < len(initials)
    if inside:
        yield "D", DELETE, place + 1, state
    if inside or whole:
        yield "I", INSERT, place, _NEXT[state]
    if inside and kinds[place] != GONE:
        more = TRUNCATED if kinds[place] == CUT else 0
        kept = _AFTER.get((state, initials[place]))
        if kept is not None:
            yield "K", KEEP + more, place + 1, kept
        yield "R", REROLE + more, place + 1, _NEXT[state]


def cheapest_edits(
    initials: Sequence[str], kinds: Sequence[str], entry: int = START, goal: int | None = None
) -> tuple[int, str] | None:
    """Cost and letters of the cheapest edits, of equals the first in ASCII order.

    ``goal`` is the state after the last row; without one, the conversation has to be
    complete, and messages may also be inserted at its end. ``None``: there is no way.
    """
    whole, size = goal is None, len(initials)
    if not whole and not _reachable(initials, kinds, entry, goal):
        return None
    goals = (START, ASSISTANT) if whole else (goal,)
    if not size and entry in goals:
        return 0, ""
    needs = _needs(initials, kinds, whole)
    # What each state was found to need at least; a search that fails raises it.
    least: list[list[float]] = [[need] * len(STATES) for need in needs]
    for state in STATES:
        least[size][state] = len(_TAIL[state]) * INSERT if whole else 0 if state in goals else NEVER
    while True:
        bound = least[0][entry]
        letters: list[str] = []
        frames: list[list] = [[0, entry, 0, _edits(0, entry, initials, kinds, whole), NEVER]]
        while frames:
            frame = frames[-1]
            place, state, spent, edits, best = frame
            step = next(edits, None)
            if step is None:  # failed within this bound
                least[place][state] = max(least[place][state], best)
                frames.pop()
                if frames:
                    letters.pop()
                    above = frames[-1]
                    above[4] = min(above[4], spent - above[2] + least[place][state])
                continue
            letter, cost, then, after = step
            need = cost + least[then][after]
            if spent + need > bound:
                frame[4] = min(best, need)
                continue
            letters.append(letter)
            if then == size and after in goals:
                return int(bound), "".join(letters)
            frames.append([then, after, spent + cost, _edits(then, after, initials, kinds, whole), NEVER])


def _reachable(initials: Sequence[str], kinds: Sequence[str], entry: int, goal: int) -> bool:
    """Whether any edits lead over these rows from one state to the other."""
    if goal == START:
        return entry == START
    if goal == SYSTEM:
        kept = any(x == "s" and kind != GONE for x, kind in zip(initials, kinds))
        return entry == SYSTEM or entry == START and kept
    return len(initials) > 0 or entry == goal


def edited(
    messages: Sequence[tuple[str, str]], letters: str, entry: int = START
) -> list[tuple[str, str]]:
    """The messages (role, text) after their edits."""
    out, state, rows = [], entry, iter(messages)
    for letter in letters:
        if letter == "I":
            state = _NEXT[state]
            out.append((ROLES[state], ""))
            continue
        role, text = next(rows)
        if letter == "K":
            state = _AFTER[state, role[:1]]
            out.append((role, text))
        elif letter == "R":
            state = _NEXT[state]
            out.append((ROLES[state], text))
    return out


_COUNTS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_MESSAGES = "messages array<struct<role: string, text: string>>"


def repair_conversations(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Repaired conversations, in one piece each unless they are very long.

    ``conv_id`` as given; ``piece``, a number that rises over the pieces of a
    conversation; ``split``, whether it has several; ``gaps``, the turns missing between
    its first and last one, on its first piece, else 0; ``blank``, ``duplicate``,
    ``truncated``, counts by each row's first fault; ``illegal``, pairs of neighbours
    other than system-user, user-assistant and assistant-user by their first letters,
    counted with the later one; ``cost``, ``audit`` (the letters of the edits) and
    ``messages``. A conversation's counts are the sums over its pieces, its audit and
    messages theirs in order.

    Rows are taken by turn, null turns first, rows of the same turn by role and text.
    A null id is an id like others. A null text is blank, a null role has no first
    letter: such a row may get a role or go. Repeated rows are duplicates. Other columns
    are ignored, whatever their names; a table without rows gives none.
    """
    asked = texts_of(
        rows,
        F.col(conv_id).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    kind = asked.schema["conv"].dataType.simpleString()
    sizes = asked.groupBy("conv").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")
    )
    long = stored(sizes.where((F.col("n") > block_rows) | (F.col("bytes") > block_bytes)), "long")
    count = long.count()
    short = asked
    if count:
            short = asked.join(bounded(long.select("conv"), 64), asked["conv"].eqNullSafe(long["conv"]), "left_anti")
    pieces = (
        short.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .mapInArrow(_repair_short, f"conv {kind}, piece long, gaps long, {_COUNTS}, {_MESSAGES}")
        .withColumn("split", F.lit(False))
    )
    if count:
        pieces = pieces.unionByName(_repair_long(asked, long, block_rows, block_bytes))
    return pieces.select(
        F.col("conv").alias(conv_id), "piece", "split", "gaps", "blank", "duplicate", "truncated",
        "illegal", "cost", "audit", "messages",
    )


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversations of rows that are sorted by them: id, turns, messages."""
    held, turns, messages = None, [], []
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(4))
        for conv, turn, role, text in zip(*columns):
            if turns and conv != held:
                yield held, turns, messages
                turns, messages = [], []
            held = conv
            turns.append(turn)
            messages.append((role, text))
    if turns:
        yield held, turns, messages


def _faults(messages: Sequence[tuple[str, str]], copies: Sequence[bool] | None = None) -> list:
    if copies is None:
        seen: set = set()
        copies = [message in seen or seen.add(message) is not None for message in messages]
    return [fault_of(text, copy) for (_, text), copy in zip(messages, copies)]


def _illegal(initials: Sequence[str], before: str | None = None) -> int:
    pairs = zip([before, *initials], initials) if before is not None else zip(initials, initials[1:])
    return sum(a + b not in _LEGAL for a, b in pairs)


def _repair_short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    held, schema = 0, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema)

    first = None
    for first in batches:
        schema = _piece_schema(first.schema.field(0).type)
        break
    if first is None:
        return

    def whole():
        yield first
        yield from batches

    for conv, turns, messages in _conversations(whole()):
        initials = [role[:1] for role, _ in messages]
        faults = _faults(messages)
        cost, letters = cheapest_edits(initials, [_kind(x) for x in faults])
        known = {x for x in turns if x is not None}
        repaired = edited(messages, letters)
        out.append(
            {
                "conv": conv,
                "piece": 0,
                "gaps": max(known) - min(known) + 1 - len(known) if known else 0,
                "blank": faults.count("blank"),
                "duplicate": faults.count("duplicate"),
                "truncated": faults.count(CUT),
                "illegal": _illegal(initials),
                "cost": cost,
                "audit": letters,
                "messages": [{"role": r, "text": t} for r, t in repaired],
            }
        )
        held += sum(len(t) for _, t in repaired)
        if len(out) >= 1000 or held > BLOCK_BYTES:
            yield made()
            out, held = [], 0
    if out:
        yield made()


def _piece_schema(conv: pa.DataType) -> pa.Schema:
    message = pa.struct([("role", pa.string()), ("text", pa.string())])
    longs = ("piece", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return pa.schema(
        [
            ("conv", conv),
            *((name, pa.int64()) for name in longs),
            ("audit", pa.string()),
            ("messages", pa.list_(message)),
        ]
    )


# Long conversations. ``number`` stands for one of them, ``part`` for a task's share of
# all rows in order, ``block`` for a block in it; ``place`` numbers the rows.

_PLACED = "number long, turn long, role string, text string, part int, block int, place long"
_TABLED = (
    "number long, part int, block int, ways string, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long"
)
_PLANNED = (
    "number long, part int, block int, entry int, blank long, duplicate long, truncated long, "
    "illegal long, cost long, audit string"
)


def _repair_long(asked: DataFrame, long: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Pieces of the conversations in ``long``."""
    named = stored(
        long.select(F.col("conv").alias("id"), F.monotonically_increasing_id().alias("number")), "named"
    )
    rows = asked.join(bounded(named, 64), asked["conv"].eqNullSafe(named["id"]))
    rows = stored(rows.select("number", "turn", "role", "text", F.monotonically_increasing_id().alias("uid")), "rows")
    order = ("number", "turn", "role", "text", "uid")
    cut = partial(_place, most_rows=block_rows, most_bytes=block_bytes)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, _PLACED)
    placed = stored(placed, "placed")
    # The first row of every message, by its place: joins by place have one row a key.
    message = F.sha2(F.concat(F.octet_length("role"), F.lit(":"), F.col("role"), F.col("text")), 256)
    firsts = placed.groupBy("number", message.alias("message")).agg(F.min("place").alias("first"))
    marked = placed.join(firsts.select("first"), placed["place"] == F.col("first"), "left").select(
        "number", "part", "block", "place", "role", "text", F.col("first").isNull().alias("copy")
    )
    marked = stored(marked, "marked")
    keys = ["number", "part", "block"]
    blocks = stored(marked.groupBy(*keys).applyInPandas(_block_ways, _TABLED), "blocks")
    parts = blocks.groupBy("number", "part").applyInPandas(_part_ways, _TABLED)
    plans = stored(parts.groupBy("number").applyInPandas(_plan_parts, _PLANNED + ", goal int, before string"), "plans")
    plans = plans.select(*["number", "part"], F.col("entry").alias("into"), "goal", "before", F.col("audit").alias("tail"))
    planned = (
        blocks.join(plans, ["number", "part"])
        .groupBy("number", "part")
        .applyInPandas(_plan_blocks, _PLANNED)
    )
    made = (
        marked.groupBy(*keys)
        .cogroup(planned.groupBy(*keys))
        .applyInPandas(_edit_block, f"number long, piece long, {_COUNTS}, {_MESSAGES}")
    )
    turns = rows.where("turn is not null").groupBy("number", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("number").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("missing"))
    starts = placed.groupBy("number").agg(F.min(_piece_number()).alias("piece"))
    known = starts.join(gaps, "number", "left").join(named, "number")
    known = known.select(F.col("number").alias("no"), F.col("piece").alias("start"), "missing", "id")
    joined = made.join(known, made["number"] == known["no"])
    first = F.when(F.col("piece") == F.col("start"), F.coalesce("missing", F.lit(0))).otherwise(0)
    return joined.select(
        F.col("id").alias("conv"), "piece", first.cast("long").alias("gaps"), "blank", "duplicate",
        "truncated", "illegal", "cost", "audit", "messages", F.lit(True).alias("split"),
    )


def _piece_number():
    return F.shiftleft(F.col("part").cast("long"), 32) + F.col("block")


def _place(
    batches: Iterable[pa.RecordBatch], most_rows: int, most_bytes: int
) -> Iterator[pa.RecordBatch]:
    """Number the rows of a part and cut them into blocks."""
    part = TaskContext.get().partitionId()
    place, block, rows, size, held = part << 40, -1, 0, 0, None
    for batch in batches:
        numbers = batch.column(0).to_pylist()
        lengths = [len(x) if x else 0 for x in batch.column(3).to_pylist()]
        blocks = []
        for number, length in zip(numbers, lengths):
            if number != held or rows >= most_rows or size + length > most_bytes:
                held, block, rows, size = number, block + 1, 0, 0
            rows, size = rows + 1, size + length
            blocks.append(block)
        count = len(numbers)
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(i) for i in range(4)),
                pa.array([part] * count, pa.int32()),
                pa.array(blocks, pa.int32()),
                pa.array(range(place, place + count), pa.int64()),
            ],
            ["number", "turn", "role", "text", "part", "block", "place"],
        )
        place += count


def _block_ways(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The cheapest edits of a block for every state before and after it."""
    rows = rows.sort_values("place")
    messages = list(zip(rows["role"], rows["text"]))
    initials = [role[:1] for role, _ in messages]
    faults = _faults(messages, rows["copy"].tolist())
    kinds = [_kind(x) for x in faults]
    ways = {}
    for entry in STATES:
        found = {goal: cheapest_edits(initials, kinds, entry, goal) for goal in STATES}
        found = {goal: way for goal, way in found.items() if way}
        order = sorted(found, key=lambda goal: found[goal][1])
        for goal, (cost, letters) in found.items():
            ways[f"{entry}{goal}"] = (cost, order.index(goal), letters)
    counts = [faults.count("blank"), faults.count("duplicate"), faults.count(CUT), _illegal(initials)]
    row = [*key, json.dumps(ways), initials[0], initials[-1], *counts]
    return pd.DataFrame([row], columns=_names(_TABLED))


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(",")]


def _ways(text: str) -> dict[tuple[int, int], tuple]:
    return {(int(k[0]), int(k[1])): tuple(way) for k, way in json.loads(text).items()}


def _joined(left: dict, right: dict) -> dict:
    """Ways over two neighbours: costs, and the order of the ways from each state."""
    out = {}
    for entry in STATES:
        found = {}
        for goal in STATES:
            options = [
                (left[entry, via][0] + right[via, goal][0], left[entry, via][1], right[via, goal][1])
                for via in STATES
                if (entry, via) in left and (via, goal) in right
            ]
            if options:
                found[goal] = min(options)
        order = sorted(found, key=lambda goal: found[goal][1:])
        for goal, (cost, *_) in found.items():
            out[entry, goal] = (cost, order.index(goal))
    return out


def _part_ways(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Ways over all blocks of a part; there are as many as its rows make."""
    rows = rows.sort_values("block")
    total = None
    for text in rows["ways"]:
        total = _ways(text) if total is None else _joined(total, _ways(text))
    ways = json.dumps({f"{a}{b}": way[:2] for (a, b), way in total.items()})
    sums = rows[["blank", "duplicate", "truncated", "illegal"]].sum().tolist()
    row = [*key, 0, ways, rows["first"].iloc[0], rows["last"].iloc[-1], *sums]
    return pd.DataFrame([row], columns=_names(_TABLED))


def _route(tables: Sequence[dict], entry: int, after: dict[int, float]) -> list[tuple[int, int]]:
    """States before and after each table on the cheapest way; ``after`` is what the end costs."""
    rest = [after]
    for table in reversed(tables):
        rest.append(
            {
                a: min((table[a, b][0] + rest[-1].get(b, NEVER) for b in STATES if (a, b) in table), default=NEVER)
                for a in STATES
            }
        )
    rest.reverse()
    route = []
    for table, then in zip(tables, rest[1:]):
        goal = min(
            (b for b in STATES if (entry, b) in table),
            key=lambda b: (table[entry, b][0] + then.get(b, NEVER), table[entry, b][1]),
        )
        route.append((entry, goal))
        entry = goal
    return route


def _plan_parts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """States around each part of a conversation, of which it has as many as there are tasks."""
    rows = rows.sort_values("part")
    tables = [_ways(text) for text in rows["ways"]]
    route = _route(tables, START, {s: len(_TAIL[s]) * INSERT for s in STATES})
    before = [None, *rows["last"].tolist()[:-1]]
    tails = [""] * (len(route) - 1) + [_TAIL[route[-1][1]]]
    plan = [
        [*key, part, 0, entry, 0, 0, 0, 0, 0, tail, goal, last]
        for part, (entry, goal), tail, last in zip(rows["part"], route, tails, before)
    ]
    return pd.DataFrame(plan, columns=[*_names(_PLANNED), "goal", "before"])


def _plan_blocks(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The edits of every block of a part, given the states around the part."""
    rows = rows.sort_values("block")
    tables = [_ways(text) for text in rows["ways"]]
    route = _route(tables, int(rows["into"].iloc[0]), {int(rows["goal"].iloc[0]): 0})
    before = rows["before"].iloc[0]
    plan = []
    for i, (row, table, (entry, goal)) in enumerate(zip(rows.itertuples(), tables, route)):
        cost, _, letters = table[entry, goal]
        if i == len(route) - 1:
            letters, cost = letters + row.tail, cost + len(row.tail) * INSERT
        illegal = row.illegal
        if isinstance(before, str) and before + row.first not in _LEGAL:
            illegal += 1
        before = row.last
        counts = [row.blank, row.duplicate, row.truncated, illegal, cost]
        plan.append([*key, row.block, entry, *counts, letters])
    return pd.DataFrame(plan, columns=_names(_PLANNED))


def _edit_block(rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
    rows, way = rows.sort_values("place"), plan.iloc[0]
    messages = edited(list(zip(rows["role"], rows["text"])), way["audit"], int(way["entry"]))
    piece = (int(way["part"]) << 32) + int(way["block"])
    counts = [int(way[name]) for name in ("blank", "duplicate", "truncated", "illegal", "cost")]
    row = [way["number"], piece, *counts, way["audit"], [{"role": r, "text": t} for r, t in messages]]
    names = ["number", "piece", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "messages"]
    return pd.DataFrame([row], columns=names)


def conversation_digests(pieces: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation: its counts, ``audit`` and ``repaired_sha256``.

    The digest is of ``role:text`` of all messages, joined by newlines. It is one hash
    over a whole conversation, so the pieces of a long one come sorted to one task,
    which reads them as a stream and holds one at a time.
    """
    kind = pieces.schema[conv_id].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    joined = pieces.withColumn("body", F.array_join(line, "\n"))
    whole = joined.where("not split").select(
        conv_id, *counts, "audit", F.sha2("body", 256).alias("repaired_sha256")
    )
    names = [conv_id, *counts, "audit", "body", "empty"]
    streamed = (
        joined.where("split")
        .withColumn("empty", F.size("messages") == 0)
        .repartition(conv_id)
        .sortWithinPartitions(conv_id, "piece")
        .select(*names)
        .mapInArrow(
            _digest_stream,
            f"`{conv_id}` {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string",
        )
    )
    return whole.unionByName(streamed)


def _digest_stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    conv, sums, audits, digest, schema = None, None, [], None, None

    def row() -> pa.RecordBatch:
        values = [conv, *sums, "".join(audits), digest.hexdigest()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], field.type) for v, field in zip(values, schema)], schema=schema
        )

    for batch in batches:
        if schema is None:
            fields = [batch.schema.field(i) for i in range(8)]
            schema = pa.schema([*fields, pa.field("repaired_sha256", pa.string())])
        for values in zip(*(column.to_pylist() for column in batch.columns)):
            if sums is None or values[0] != conv:
                if sums is not None:
                    yield row()
                conv, sums, audits, digest, filled = values[0], [0] * 6, [], hashlib.sha256(), False
            sums = [a + b for a, b in zip(sums, values[1:7])]
            audits.append(values[7])
            if not values[9]:
                digest.update(("\n" if filled else "").encode() + values[8].encode())
                filled = True
    if sums is not None:
        yield row()


def all_conversations(found: DataFrame, ids: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``found`` with a row also for those of ``ids`` that have none: zeros, empty texts."""
    names = ids.select(conv_id).distinct().select(F.col(conv_id).alias("__conv"))
    own = found.withColumnRenamed(conv_id, "__own")
    own = own.withColumn("__conv", F.col("__own"))
    joined = names.join(own, same(names, own, ["__conv"]), "left").drop(own["__conv"])
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    filled = [
        F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c)
        for c in found.columns
        if c != conv_id
    ]
    return joined.select(F.col("__conv").alias(conv_id), *filled)
