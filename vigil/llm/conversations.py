"""Repair of conversation structure: backward cost-to-go over rows and grammar state, then a greedy walk forward.

A conversation should be an optional system turn and pairs of a user and an assistant turn, or nothing. Each of its rows
is kept (K, 0), given the role that the grammar wants (R, 2) or deleted (D, 3; blank and repeated rows must be); empty
turns may be inserted (I, 2); a truncated row that stays costs 1 more. The grammar's state before a row is one of
four: nothing yet, after the system turn, after a user's, after an assistant's. It fixes the role that an insertion or
a new role gets, so an edit's initial names the edit.

``before`` takes the cost-to-go of the four states after a row to that before it; the least cost of a whole
conversation is that of "nothing yet" before its first row. Forward from there, each step takes the ASCII-least
edit among those that lose nothing of the cost-to-go, so of all cheapest repairs the walk gives the ASCII-least.

No conversation is gathered. Equal rows are counted before any shuffle, the first turn of each (role, text) is found
over salted groups, and rows are then dealt by *ranges* of (conversation, turn, ...), which cut a long conversation
over many tasks. A task settles the conversations that lie whole within it; of the others it leaves pieces of at most
``PIECE_ROWS`` rows or about ``PIECE_CHARS`` characters with the 4 x 4 costs between the states at their ends (steps
backward are linear in the algebra of minimum and sum, so pieces combine). The pieces of a conversation are then
passed twice in order with a fixed memory: backward over the 16 numbers of each, forward over their rows to walk and to
feed the digest. Only that last pass, as a digest of the whole text demands, is one stream per conversation.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.runtime import drop_stored, ship, stored
from vigil.llm.textcore import tidied

PIECE_ROWS = 1 << 15
PIECE_CHARS = 1 << 22
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or renamed turn leads to, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept row of an initial leads from each state it may stand in.
KEEP = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
INITIAL = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 50
#: Cost-to-go after the last row: nothing, or what must be inserted to end after an assistant's turn.
DONE = (0, 4, 2, 0)
MUST_GO = 0


def code(initial: str, truncated: bool) -> int:
    """A row that may stay: its initial (another: none of s, u, a) and whether it is truncated."""
    return 1 + 2 * INITIAL.get(initial, 3) + truncated


@lru_cache(maxsize=1 << 16)
def _step(row: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    edits = []
    for state in range(4):
        options = {"D": 3 + after[state]}
        if row != MUST_GO:
            initial, cut = divmod(row - 1, 2)
            options["R"] = 2 + cut + after[NEXT[state]]
            if state in KEEP[initial]:
                options["K"] = cut + after[KEEP[initial][state]]
        edits.append(options)
    least = [min(o.values()) for o in edits]
    out, choice = [], ""
    for state, options in enumerate(edits):  # two insertions reach every role, more only return
        one, two = NEXT[state], NEXT[NEXT[state]]
        out.append(min(least[state], 2 + least[one], 4 + least[two], FAR))
    for state, options in enumerate(edits):
        options["I"] = 2 + out[NEXT[state]]
        choice += min(e for e, c in options.items() if c == out[state]) if out[state] < FAR else "D"
    return tuple(out), choice


def before(row: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Cost-to-go of each state before a row, and the ASCII-least cost-tight edit there."""
    low = min(after)
    cost, choice = _step(row, tuple(min(c - low, FAR) for c in after))
    return tuple(c + low if c < FAR else FAR for c in cost), choice


def backward(rows: bytes, after: tuple[int, ...]) -> tuple[tuple[int, ...], list[str]]:
    """Cost-to-go before the first of ``rows`` (codes), and the choices at each."""
    choices = [""] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        after, choices[i] = before(rows[i], after)
    return after, choices


def forward(rows: bytes, choices: list[str], state: int) -> tuple[str, int]:
    """Edits of the walk over ``rows`` from a state, and the state after it."""
    out = []
    for row, choice in zip(rows, choices):
        while (edit := choice[state]) == "I":
            out.append(edit)
            state = NEXT[state]
        out.append(edit)
        if edit == "K":
            state = KEEP[(row - 1) // 2][state]
        elif edit == "R":
            state = NEXT[state]
    return "".join(out), state


def ending(state: int) -> str:
    """Insertions that end a conversation from a state."""
    return "I" * (DONE[state] // 2)


def plan(rows: bytes) -> tuple[int, str]:
    """Least cost and edits of a whole conversation given by codes."""
    return _short_plan(rows) if len(rows) <= 32 else _plan(rows)


def _plan(rows: bytes) -> tuple[int, str]:
    cost, choices = backward(rows, DONE)
    edits, state = forward(rows, choices, START)
    return cost[START], edits + ending(state)


_short_plan = lru_cache(maxsize=1 << 14)(_plan)


def transfer(rows: bytes) -> list[int]:
    """Cost-to-go before ``rows`` for each state at their end (row by row, 4 x 4)."""
    return [c for end in range(4) for c in backward(rows, tuple(0 if s == end else FAR for s in range(4)))[0]]


def through(matrix: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(after[end] + matrix[4 * end + s] for end in range(4)) for s in range(4))


def turns(edits: str, rows: bytes, roles: list[str], texts: list[str], state: int = START) -> list[tuple[str, str]]:
    """(role, text) of the turns that ``edits`` leave of ``rows``."""
    out, i = [], 0
    for edit in edits:
        if edit == "I":
            state = NEXT[state]
            out.append((ROLE[state], ""))
            continue
        if edit == "K":
            state = KEEP[(rows[i] - 1) // 2][state]
            out.append((roles[i], texts[i]))
        elif edit == "R":
            state = NEXT[state]
            out.append((ROLE[state], texts[i]))
        i += 1
    return out


def with_copies(edits: str, times: list[int]) -> str:
    """``edits`` of distinct rows with a D after a row for each further copy of it."""
    if all(t == 1 for t in times):
        return edits
    out, i = [], 0
    for edit in edits:
        out.append(edit)
        if edit != "I":
            out.append("D" * (times[i] - 1))
            i += 1
    return "".join(out)


class Facts:
    """What a run of rows of one conversation says: codes, counts of faults, turns and the initials at its ends."""

    def __init__(self):
        self.codes, self.times, self.roles, self.texts = bytearray(), [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.chars = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, role: str, text: str, times: int, repeated: bool) -> None:
        solid, initial = text.strip(WHITE), role[:1]
        if not solid:
            self.blank += times
            self.codes.append(MUST_GO)
        elif repeated:
            self.duplicate += times
            self.codes.append(MUST_GO)
        else:
            cut = solid[-1] not in ".!?"
            self.duplicate += times - 1
            self.truncated += cut
            self.codes.append(code(initial, cut))
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.illegal += times - 1
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.times.append(times)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def copies(self) -> int:
        return sum(self.times) - len(self.times)


def _gaps(low, high, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "place long, codes binary, times array<long>, roles array<string>, texts array<string>, matrix array<long>, turns long, low long, high long, first string, last string"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields], [n for n, _ in fields])


def _closed(conv, x: Facts) -> dict:
    cost, edits = plan(bytes(x.codes))
    text = "\n".join(f"{role}:{text}" for role, text in turns(edits, x.codes, x.roles, x.texts))
    return {
        "conv_id": conv, "open": False, "gaps": _gaps(x.low, x.high, x.turns), **{c: getattr(x, c) for c in _COUNTS},
        "cost": cost + 3 * x.copies(), "audit": with_copies(edits, x.times), "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def _open(conv, x: Facts, place: int) -> dict:
    codes = bytes(x.codes)
    return {
        "conv_id": conv, "open": True, "place": place, "codes": codes, "times": x.times, "roles": x.roles, "texts": x.texts, "matrix": transfer(codes),
        **{c: getattr(x, c) for c in [*_COUNTS, "turns", "low", "high", "first", "last"]},
    }


def _settle(schema: str, piece_rows: int, piece_chars: int):
    """Rows in order -> results of conversations that lie whole within the partition, pieces of the others."""

    def run(batches):
        from pyspark import TaskContext

        place, first = TaskContext.get().partitionId() << 32, True
        conv, x, broken, out, size = None, None, False, [], 0

        def finish(last: bool):
            """End the run of rows at hand: the partition's first and last may go on in its neighbours."""
            nonlocal place, size
            if broken or first or last:
                out.append(_open(conv, x, place))
                place += 1
            else:
                out.append(_closed(conv, x))
            size += x.chars

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for c, turn, role, text, times, repeated in zip(*columns):
                if x is None:
                    conv, x = c, Facts()
                elif c != conv:
                    finish(False)
                    conv, x, broken, first = c, Facts(), False, False
                elif len(x.codes) >= piece_rows or x.chars >= piece_chars:
                    broken = True
                    finish(False)
                    x = Facts()
                if times:
                    x.add(turn, role, text, times, repeated)
                if len(out) >= 1024 or size >= piece_chars:
                    yield _batch(out, schema)
                    out, size = [], 0
        if x is not None:
            finish(True)
        if out:
            yield _batch(out, schema)

    return tidied(run)


def _ends(batches):
    """(conv_id, place, matrix), places falling -> place and the cost-to-go at the piece's end."""
    conv, after, begun = None, DONE, False
    for batch in batches:
        out = []
        for c, place, matrix in zip(*(x.to_pylist() for x in batch.columns)):
            if not begun or c != conv:
                conv, after, begun = c, DONE, True
            out.append({"place": place, "after": list(after)})
            after = through(matrix, after)
        yield _batch(out, "place long, after array<long>")


def _joined(schema: str):
    """Pieces in order with the cost-to-go at their ends -> the results of their conversations."""

    def run(batches):
        conv, state = None, None

        def result():
            edits = ending(state["at"])
            for role, text in turns(edits, b"", [], [], state["at"]):
                line(role, text)
            return {
                "conv_id": conv, "gaps": _gaps(state["low"], state["high"], state["turns"]), **{c: state[c] for c in _COUNTS}, "cost": state["cost"],
                "audit": "".join([*state["audit"], edits]), "repaired_sha256": state["sha"].hexdigest(),
            }

        def line(role, text):
            state["sha"].update((f"\n{role}:{text}" if state["lines"] else f"{role}:{text}").encode())
            state["lines"] += 1

        for batch in batches:
            out = []
            for p in batch.to_pylist():
                if state is None or p["conv_id"] != conv:
                    if state is not None:
                        out.append(result())
                    conv = p["conv_id"]
                    state = dict.fromkeys([*_COUNTS, "turns", "lines", "cost", "at"], 0) | {"low": None, "high": None, "last": None, "audit": [], "sha": hashlib.sha256(), "new": True}
                cost, choices = backward(p["codes"], tuple(p["after"]))
                if state["new"]:
                    state["cost"], state["new"] = cost[START], False
                edits, at = forward(p["codes"], choices, state["at"])
                for role, text in turns(edits, p["codes"], p["roles"], p["texts"], state["at"]):
                    line(role, text)
                state["audit"].append(with_copies(edits, p["times"]))
                state["cost"] += 3 * (sum(p["times"]) - len(p["times"]))
                state["at"] = at
                for c in _COUNTS:
                    state[c] += p[c]
                if p["first"] is not None:
                    state["illegal"] += state["last"] is not None and state["last"] + p["first"] not in LEGAL
                    state["last"] = p["last"]
                if p["low"] is not None:
                    state["turns"] += p["turns"] - (p["low"] == state["high"])
                    state["low"] = p["low"] if state["low"] is None else state["low"]
                    state["high"] = p["high"]
            if out:
                yield _batch(out, schema)
        if state is not None:
            yield _batch([result()], schema)

    return tidied(run)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by crc32(``conv_id:turn``) % 20, and ``times``.

    0 drops the row (times 0), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it (times 2), 4 makes its role
    user. A null counts as one space in the key, the role and the text.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fault.isin(0, 1), "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def repair(conversations: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 (see the module).

    Rows are taken by turn, nulls first; rows of one turn, which a table does not order, by role, the first 64
    characters of the text and its digest. ``times``, if the table has it, is the number of copies of a row; with 0 only its conversation counts. Null roles and texts are
    one space. A row is blank, else a repetition (role and text stood before), else truncated, or sound. A null conv_id
    is a conversation too. One without rows has zeros, no edits and the digest of nothing; an empty table gives an empty one.
    """
    ship(conversations.sparkSession)
    salts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = F.col("times") if "times" in conversations.columns else F.lit(1)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"), times.cast("long").alias("times"),
    )
    mark = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"))
    rows = rows.withColumns({"mark": mark, "salt": F.pmod(F.xxhash64("turn"), F.lit(salts)).cast("int")})
    once = rows.groupBy("conv_id", "turn", "role", "text", "mark", "salt").agg(F.sum("times").alias("times"))
    # The first turn of each (role, text) that stands twice, over as many salted groups as it has.
    some = rows.where("times > 0").groupBy("conv_id", "mark", "salt").agg(F.min("turn").alias("lo"), F.bool_or(F.col("turn").isNull()).alias("none"), F.count("*").alias("n"))
    firsts = some.groupBy("conv_id", "mark").agg(F.min("lo").alias("lo"), F.bool_or("none").alias("none"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), F.explode("salts").alias("s"), "lo", "none")
    repeated = F.coalesce(F.when(F.col("none"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("lo")), F.lit(False))
    marked = once.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")) & (F.col("salt") == F.col("s")), "left").withColumn("repeated", repeated)
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), "mark"]  # short keys: Spark samples them for the ranges
    dealt = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "times", "repeated")
    result = f"conv_id long, {_RESULT}"
    settled = f"{result}, open boolean, {_PIECE}"
    table = stored(dealt.mapInArrow(_settle(settled, piece_rows, piece_chars), settled), "settled")
    pieces = table.where("open")
    ends = pieces.select("conv_id", "place", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("place")).mapInArrow(_ends, "place long, after array<long>")
    steps = ["conv_id", "place", "codes", "times", "roles", "texts", *_COUNTS, "turns", "low", "high", "first", "last", "after"]
    walked = pieces.join(ends, "place").select(*steps).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_joined(result), result)
    out = stored(table.where("not open").select(*walked.columns).unionByName(walked), "repaired")
    drop_stored(table)
    return out
