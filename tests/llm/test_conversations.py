"""Conversation repair against an exhaustive search, and its odd inputs."""

import hashlib
import random
import zlib
from functools import cache

from chronoweave.llm.conversations import FAR, SYSTEM, Repair, _Walk, repair_conversations, repair_damaged
from chronoweave.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        how = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if how == 1 else "".join(c for c in text if c not in ".!?") if how == 2 else text
        out.setdefault(conv, [])
        out[conv] += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def repaired(rows):
    """The digest of one conversation, from all edits of every row."""
    seen, faults = set(), []
    for _, role, text in rows:
        content = text.rstrip(SPACE)
        faults.append("blank" if not content else "duplicate" if (role, text) in seen else "truncated" if content[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, last, left=3):  # (cost, initials, rows) from row i on, after a row with that initial, with at most left insertions before row i
        ways = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        goes = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        name = {"u": "user", "a": "assistant"}[goes]
        if i < len(rows):
            _, role, text = rows[i]
            c, e, o = best(i + 1, last)
            ways.append((c + 2, "D" + e, o))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] == goes or (last == "" and role[:1] == "s"):
                    c, e, o = best(i + 1, role[:1])
                    ways.append((c + more, "K" + e, (f"{role}:{text}", *o)))
                c, e, o = best(i + 1, goes)
                ways.append((c + more + 1, "R" + e, (f"{name}:{text}", *o)))
        if left:
            c, e, o = best(i, goes, left - 1)
            ways.append((c + 5, "I" + e, (f"{name}:", *o)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, out = best(0, "") if rows else (0, "", ())
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def check(spark, rows):
    got = {r[0]: tuple(r)[1:] for r in repair_damaged(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {c: repaired(v) for c, v in damage(rows).items()}
    assert got == want
    return got


def test_random_conversations(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "and then", "", " \n", "Good. \t", "so.so", None, "Ünïcode…", "a"]
    rows = []
    for conv in [*range(400), None]:
        for turn in range(rng.randint(1, 9)):
            at = None if rng.random() < 0.05 else turn + rng.randint(0, 2) + (2**60 if conv == 7 else 0)
            rows.append((conv, at, rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "u"]), rng.choice(texts)))
    rng.shuffle(rows)
    got = check(spark, rows)
    assert any("R" in v[6] for v in got.values()) and any("D" in v[6] for v in got.values())


def test_insertions():
    """No conversation's cheapest repair inserts at these costs, but the automaton prices insertions."""
    assert Repair.closed([0, FAR, FAR, 0]) == [0, 10, 5, 0]
    repair = Repair()
    walk = _Walk(1)
    walk.state = SYSTEM
    assert [r[2:4] for r in walk.close()] == [("I", "user"), ("I", "assistant")] and walk.cost == 10
    must = repair.kind("user", "blank")
    assert repair.costs(must, repair.end) == [2, 12, 7, 2] and repair.forth(must, repair.end, SYSTEM) == ("D", SYSTEM, 2)


def test_system_turns(spark):
    rows = [(1, 5, "system", "Be kind."), (2, 5, "user", "Hello."), (2, 6, "user", "Again."), (3, 3, "assistant", "Hi."), (4, None, None, None), (5, 2, "system", "A."), (5, 3, "system", "B."), (5, 4, "user", "C."), (5, 5, "assistant", "D.")]
    rows += [(2, 6, "user", "Again."), (9, 1, "user", "x" * 100_000)]
    check(spark, rows)


def test_all_turns_gone_and_empty_table(spark):
    rows = [(c, t, "user", "Hi.") for c in range(60) for t in range(1)]
    gone = [r for r in rows if zlib.crc32(f"{r[0]}:{r[1]}".encode()) % 20 == 0]
    assert gone
    got = check(spark, rows)
    assert got[gone[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", False, "x", 3), (1, 1, "user", "Ho.", False, "y", 4)], "conv_id long, turn long, role string, text string, gone boolean, place string, follow int")
    rows = [tuple(r) for r in repair_conversations(df, with_turns=True).orderBy("place").collect()]
    assert rows == [(1, 1, "K", "user", "Hi."), (1, 2, "R", "assistant", "Ho.")]


def test_one_giant_conversation_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rng = random.Random(2)
        rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "", f"C{t}."])) for t in range(700)] + [(2, 0, "user", "Q?")]
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op11_conversation_repair(spark, d).collect()}
    assert got == {c: repaired(v) for c, v in damage(rows).items()}
