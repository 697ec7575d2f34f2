"""Cheapest repair of conversations whose turns are damaged, streamed in order of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters that don't count as content.
SPACE = " \t\n\x0b\x0c\r"
#: Costs of the edits, and what a truncated turn that isn't deleted adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 10**6

DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, place long, edit string, role string, text string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns (conv_id, turn, role, text, gone), damaged by crc32 of "conv_id:turn" mod 20.

    0 drops a turn (it is kept with gone set, so that its conversation isn't forgotten), 1 empties its text, 2 takes
    out ``.!?``, 3 repeats it, 4 makes it the user's. A null is one space, in the hashed string too.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), how.alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(0), (F.col("how") == 3).cast("int"))).alias("copy")
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), copies).drop("copy")


def _with_faults(turns: DataFrame) -> DataFrame:
    """Each turn's place in its conversation and first fault; a conversation stays in one partition, and only sorts follow its one exchange."""
    content = F.rtrim("text", F.lit(SPACE))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    seen = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "text").orderBy("place"))
    fault: Column = F.when(content == "", "blank").when(F.col("seen") > 1, "duplicate").when(~F.substring(content, -1, 1).isin(".", "!", "?"), "truncated")
    placed = turns.repartition("conv_id").withColumn("place", place).withColumn("seen", seen)
    return placed.select("conv_id", "turn", "role", "text", "gone", F.col("place").cast("long").alias("place"), F.coalesce(fault, F.lit("")).alias("fault"))


class Repair:
    """The edit automaton: costs to go of the four states, row by row, as a small number.

    ``back`` takes a turn and the costs that follow it to the costs before it. Costs
    are kept less the least of them, five bits a state, so that the number of
    different ones is small, one number a turn is all that has to be kept as its
    backpointers, and both directions are table look-ups. ``forth`` reads them again:
    of the edits that keep to the least cost it takes the one whose initial is least.
    """

    def __init__(self):
        self.before: dict[tuple, int] = {}
        self.moves: dict[tuple, tuple[str, int, int]] = {}
        self.end = self.pack(self.closed([0, FAR, FAR, 0]))

    @staticmethod
    def kind(role: str, fault: str) -> tuple[str, str]:
        return role[:1] if role[:1] in ("s", "u", "a") else "", "must" if fault in ("blank", "duplicate") else fault

    @staticmethod
    def closed(v: list[int]) -> list[int]:
        """Costs that may begin with inserted turns."""
        for _ in range(3):
            v = [min(v[s], INSERT + v[NEXT[s]]) for s in range(4)]
        return v

    @staticmethod
    def pack(v: list[int]) -> int:
        low = min(v)
        return sum((x - low) << 5 * s for s, x in enumerate(v))

    @staticmethod
    def unpack(code: int) -> list[int]:
        return [code >> 5 * s & 31 for s in range(4)]

    @staticmethod
    def edits(kind: tuple[str, str], state: int, after: list[int]) -> list[tuple[int, str, int, int]]:
        """(cost to the end, initial, next state, own cost) of each way to use up a turn, insertions aside."""
        initial, fault = kind
        out = [(DELETE + after[state], "D", state, DELETE)]
        if fault != "must":
            more = TRUNCATED if fault == "truncated" else 0
            keep = {"s": SYSTEM if state == START else None, "u": USER if state != USER else None, "a": ASSISTANT if state == USER else None}.get(initial)
            if keep is not None:
                out.append((more + after[keep], "K", keep, more))
            out.append((REROLE + more + after[NEXT[state]], "R", NEXT[state], REROLE + more))
        return out

    def costs(self, kind: tuple[str, str], code: int) -> list[int]:
        after = self.unpack(code)
        return self.closed([min(e[0] for e in self.edits(kind, s, after)) for s in range(4)])

    def back(self, kind: tuple[str, str], code: int) -> int:
        key = (kind, code)
        if key not in self.before:
            self.before[key] = self.pack(self.costs(kind, code))
        return self.before[key]

    def forth(self, kind: tuple[str, str], code: int, state: int) -> tuple[str, int, int]:
        """Initials of the edits for a turn, the last of which uses it up; the next state; their cost."""
        key = (kind, code, state)
        if key not in self.moves:
            v, after, done, paid = self.costs(kind, code), self.unpack(code), "", 0
            while True:
                ways = [(c, s, own) for total, c, s, own in self.edits(kind, state, after) if total == v[state]]
                if INSERT + v[NEXT[state]] == v[state]:
                    ways.append(("I", NEXT[state], INSERT))
                c, state, own = min(ways)
                done, paid = done + c, paid + own
                if c != "I":
                    break
            self.moves[key] = done, state, paid
        return self.moves[key]


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Turns from last to first: each gets the costs that follow it; only one number is carried on."""
    repair, conv, code = Repair(), object(), 0
    for pdf in batches:
        follow = []
        for c, role, fault, gone in zip(pdf["conv_id"], pdf["role"], pdf["fault"], pdf["gone"]):
            if c != conv:
                conv, code = c, repair.end
            follow.append(code)
            if not gone:
                code = repair.back(repair.kind(role, fault), code)
        yield pdf.assign(follow=follow)


class _Walk:
    """One conversation from its first turn on: counts, the edits chosen, and the repaired turns as they come."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.any, self.place = conv, START, 0, False, 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.last, self.first_turn, self.last_turn, self.turns = 0, None, None, None, 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def put(self, edit: str, role: str, text: str) -> tuple:
        if edit != "D":
            self.hash.update(("\n" * self.any + f"{role}:{text}").encode(errors="surrogatepass"))
            self.any = True
        self.place += 1
        return self.conv, self.place, edit, role, text

    def turn(self, repair: Repair, turn: int | None, role: str, text: str, fault: str, follow: int) -> list[tuple]:
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn, self.last_turn = turn if self.first_turn is None else self.first_turn, turn
        if self.last is not None:
            self.illegal += self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        if fault:
            self.counts[fault] += 1
        done, state, paid = repair.forth(repair.kind(role, fault), follow, self.state)
        self.cost += paid
        self.audit.append(done)
        out = []
        for c in done:
            if c in "IR":
                self.state = NEXT[self.state]
            out.append(self.put(c, *((NAMES[self.state], "") if c == "I" else (NAMES[self.state] if c == "R" else role, text))))
        self.state = state
        return out

    def close(self) -> list[tuple]:
        out = []
        while self.state not in (START, ASSISTANT):
            self.state, self.cost = NEXT[self.state], self.cost + INSERT
            self.audit.append("I")
            out.append(self.put("I", NAMES[self.state], ""))
        return out

    def digest(self) -> tuple:
        gaps = min(self.last_turn - self.first_turn + 1 - self.turns, 2**63 - 1) if self.turns else 0
        return self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _forward(with_turns: bool, block: int = 4096):
    names = [f.split()[0] for f in (TURNS if with_turns else DIGEST).split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.array(c, "Int64") if isinstance(next((x for x in c if x is not None), 0), int) else list(c) for n, c in zip(names, zip(*rows))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair, walk, out = Repair(), None, []
        for pdf in batches:
            for c, t, *rest, gone in zip(pdf["conv_id"], pdf["turn"], pdf["role"], pdf["text"], pdf["fault"], pdf["follow"], pdf["gone"]):
                c = None if c is None else int(c)
                if walk is None or c != walk.conv:
                    if walk is not None:
                        closing = walk.close()
                        out += closing if with_turns else [walk.digest()]
                    walk = _Walk(c)
                if not gone:
                    done = walk.turn(repair, None if t is None else int(t), *rest)
                    out += done if with_turns else []
                if len(out) >= block:
                    yield frame(out)
                    out = []
        if walk is not None:
            closing = walk.close()
            out += closing if with_turns else [walk.digest()]
        if out:
            yield frame(out)

    return run


def repair_conversations(turns: DataFrame, with_turns: bool = False) -> DataFrame:
    """The cheapest repair of each conversation of turns (conv_id, turn, role, text, gone).

    Turns follow one another by turn (nulls first), those of one turn by role and text. Keeping a turn costs
    nothing, giving it to the user or the assistant 1, deleting it 2 (blank turns and those seen earlier in
    the conversation must be deleted), inserting an empty turn of either 5, and a truncated turn that stays 5; what is left reads
    (s?(ua)+)? by the roles' initials. Of repairs that cost the same, the one whose edits' initials are least in ASCII order is taken.

    Returns a digest per conversation, or, with_turns, the edited turns (conv_id, place, edit, role, text), deleted ones included.
    One exchange brings a conversation's turns together. Sorted from the last turn to the first, they stream
    through a task that carries the costs to go across Arrow batches and leaves one
    number with each turn, its backpointers; sorted the other way, they stream again,
    and the edits are chosen, counted and hashed as they come. Between the two Spark's sort holds
    turns and numbers, and spills them, so that a conversation of any length costs memory only for its
    audit string. A null conv_id is a conversation of its own; null roles and texts are one space; conversations
    all of whose turns are gone give zeros, an empty audit and the hash of an empty string; repeated turns are
    duplicates; no rows give no rows; other columns are left behind.
    """
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone")
    faulty = _with_faults(turns)
    exact = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]  # as text, since pandas turns longs with nulls into floats
    schema = "conv_id string, turn string, role string, text string, gone boolean, place long, fault string, follow int"
    back = faulty.select(*exact, "role", "text", "gone", "place", "fault").sortWithinPartitions("conv_id", F.desc("place")).mapInPandas(_backward, schema)
    return back.sortWithinPartitions("conv_id", "place").mapInPandas(_forward(with_turns), TURNS if with_turns else DIGEST)


def repair_damaged(conversations: DataFrame, with_turns: bool = False) -> DataFrame:
    """repair_conversations() of damaged() conversations."""
    return repair_conversations(damaged(conversations), with_turns)
