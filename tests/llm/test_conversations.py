"""Repair of conversations against the least of all edit sequences, found by plain recursion."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vigil.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def damaged(rows):
    """(conv_id, turn, role, text) after damage."""
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub(r"[.!?]", "", text) if k == 2 else text)
        out += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def order(row):
    _, t, role, text = row
    return (t is not None, t or 0, role.encode(), text[:64].encode(), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())


def brute(rows):
    """The result of one conversation's rows after damage."""
    rows = sorted(rows, key=order)
    if not rows:
        return EMPTY
    seen, kinds = set(), []
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    start = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, at):
        """Least (cost, edits) from row i on, after a kept turn of initial ``at``; two insertions in a row at most are of use."""
        return least(i, at, 3)

    @functools.cache
    def least(i, at, room):
        options = []
        if i == len(rows) and at in ("", "a"):
            options.append((0, "", ()))
        want = "user" if at != "u" else "assistant"
        if room:
            c, e, t = least(i, want[0], room - 1)
            options.append((2 + c, "I" + e, (f"{want}:", *t)))
        if i < len(rows):
            c, e, t = best(i + 1, at)
            options.append((3 + c, "D" + e, t))
            if kinds[i] not in ("blank", "duplicate"):
                extra = kinds[i] == "truncated"
                if rows[i][2][:1] and rows[i][2][0] in start[at]:
                    c, e, t = best(i + 1, rows[i][2][0])
                    options.append((extra + c, "K" + e, (f"{rows[i][2]}:{rows[i][3]}", *t)))
                c, e, t = best(i + 1, want[0])
                options.append((2 + extra + c, "R" + e, (f"{want}:{rows[i][3]}", *t)))
        return min(options, key=lambda o: o[:2]) if options else (10**9, "", ())

    for i in range(len(rows), -1, -1):  # fills the cache from the end, so that the recursion stays shallow
        for at in ("", "s", "u", "a"):
            best(i, at)
    cost, edits, lines = best(0, "")
    turns = [t for _, t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows):
    groups = {c: [] for c, *_ in rows}
    for r in damaged(rows):
        groups[r[0]].append(r)
    return {c: brute(g) for c, g in groups.items()}


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def some_rows(rng, conversations_, longest):
    rows = []
    for c in range(conversations_):
        for t in range(rng.randrange(1, longest)):
            turn = t if rng.random() < 0.8 else rng.choice([None, t + 1, t + 7, -3, rng.randrange(longest)])
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.5 else ["user", "assistant"][t % 2] if rng.random() < 0.8 else rng.choice(["system", "tool", None, "", "User", "s", "û"])
            text = rng.choice(["Yes.", "No", "Why?", "  ", "", None, "a\nb!\n", "é. ", "Hm.\t\x0b", "end."]) if rng.random() < 0.4 else f"text {rng.randrange(10**6)}" + rng.choice([".", "", "!"])
            rows += [(c if c else None, turn, role, text)] * (1 if rng.random() < 0.95 else 3)
    return rows


@pytest.mark.parametrize("piece", [1 << 15, 3])
@pytest.mark.parametrize("parts", [1, 5])
def test_repair_equals_the_least_of_all_edits(spark, parts, piece):
    rows = some_rows(random.Random(parts + piece), 120, 14) + some_rows(random.Random(9), 1, 2) + [(500 + i, 0, "user", "gone") for i in range(60)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = found(conversations.repair(conversations.damage(spark.createDataFrame(rows, SCHEMA)), piece_rows=piece))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = expected(rows)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], (c, sorted([r for r in damaged(rows) if r[0] == c], key=order))
    assert sum(v == EMPTY for v in want.values()) >= 1


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(4)
    rows = [(7, t if rng.random() < 0.98 else None, rng.choice(["user", "assistant", "system"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2], rng.choice(["same text.", "cut", ""]) if rng.random() < 0.3 else f"t{t}.") for t in range(900)]
    rows += [(7, 3, "user", "copied.")] * 200 + [(8, 0, "user", "a."), (8, 1, "assistant", "b."), (6, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    whole = found(conversations.repair(conversations.damage(df), piece_rows=50))
    assert whole == found(conversations.repair(conversations.damage(df), piece_chars=200)) == expected(rows)


def test_edges(spark):
    rows = [(1, 5, "user", "x" * 3_000_000 + "."), (1, 6, "assistant", "y" * 3_000_000), (2, None, None, None), (None, None, "user", "Hi."), (3, 1, "user", "A."), (3, 1, "user", "A."), (3, -5, "assistant", "B.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("mark", "salt", "lo", "none", "n", "c", "m", "s", "open", "place", "repeated")})
    assert found(conversations.repair(df)).keys() == {None, 1, 2, 3}
    got = {r.conv_id: r for r in conversations.repair(df).collect()}
    assert (got[3].gaps, got[3].duplicate, got[3].audit) == (5, 1, "IKKDI") and got[2].blank == 1 and got[2].audit == "D"
    assert got[None].audit == "D" or got[None].cost == 2
    assert found(conversations.repair(conversations.damage(df))) == expected(rows)
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_query(spark, size):
    folder = f"/root/testdata/sf{size}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_conversations(spark, folder)) == expected(rows)
