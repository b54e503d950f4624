"""Conversation structure repair: cheapest edits to the grammar ``(system? (user assistant)+)?``.

Dijkstra on the implicit lattice of (turns read, grammar state). An edit keeps a turn (0),
gives it another role (3), deletes it (4) or inserts an empty turn (3); a truncated turn that
stays costs 3 more, a blank or repeated one must go. The priority is (cost, audit), the audit
being the edits' initials; the first accepting end popped is the answer. Two audits of one
node and cost are never prefixes of each other (each insertion costs), so the smaller audit
stays smaller whatever follows, and pieces of a conversation can be solved apart.

Spark sorts the turns by ranges of (conversation, turn), so that a hot conversation is spread
over many tasks. Each task cuts its rows into blocks of ``BLOCK`` turns. A conversation that
lies inside one task and block is repaired there. Of all others each block is solved from
each state to each state; the tables are joined, neighbours first, within the task and
then by Spark in rounds of ``FAN`` tasks, and the chosen audit goes back to its block. No
task holds more than one block's texts and one range's audits.

Turns are taken in order of ``turn`` (nulls first), rows of one turn by role and then by MD5
of the text. A role counts by its first character. Edge cases: nulls in role and text read
as one space, which is blank; rows without ``conv_id`` form a conversation of their own;
repeated rows are duplicates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, materialise, small_side

#: The grammar: state (last role kept) and role give the next state.
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
STATES, ENDS = ("", "s", "u", "a"), ("", "a")
NAMES = {"u": "user", "a": "assistant"}
RIGHT_PAIRS = ("su", "ua", "au")
REROLE, DELETE, INSERT, TRUNCATED_STAYS = 3, 4, 3, 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Turns of a block and tasks joined in a round.
BLOCK, FAN = 256, 64


class Repaired(NamedTuple):
    #: conv_id, block, place, role, text, edit (K, R or I), in the order of block and place.
    rows: DataFrame
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    conversations: DataFrame


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with one fault in every fifth row or so, by a checksum of its place."""
    plain = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(place.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return plain.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy"),
    ).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """Rows with ``fault`` (the first of blank, duplicate, truncated), ``first``: whether no turn before has the same role and text."""
    plain = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    plain = plain.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    key = ("conv_id", "role", "digest")
    again = plain.groupBy(*key).agg(F.count("*").alias("times"), F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("since"))
    again = again.filter("times > 1").select(*(F.col(c).alias(f"{c}_2") for c in key), "since")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_2")) for c in key]
    met = plain.join(small_side(again, 500_000), same[0] & same[1] & same[2], "left")
    repeated = F.when(F.col("since").isNotNull(), F.when(F.col("since.turn").eqNullSafe(F.col("turn")), 1).otherwise(2))
    blank = ~F.col("text").rlike(f"[^{WS}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{WS}]*\z")
    fault = F.when(blank, BLANK).when(truncated, TRUNCATED).otherwise(FINE)
    # 0: once in its conversation; 1: again, but this is its first turn; 2: seen before.
    return met.select("conv_id", "turn", "role", "text", "digest", fault.alias("fault"), F.coalesce(repeated, F.lit(0)).alias("repeated"))


def cheapest(rows: list[tuple[str, int]], start: str, ends: Iterable[str] = ()) -> dict[str, tuple[int, str]]:
    """Dijkstra over turns ``(initial, fault)`` from ``start``: the least (cost, audit) by end state.

    With ``ends`` it stops at the first of them that is popped at the last turn.
    """
    heap: list[tuple[int, str, int, str]] = [(0, "", 0, start)]
    done, out = set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows):
            out[state] = (cost, audit)
            if state in ends:
                return {state: out[state]}
        moves = [(state, x, STEP[state, x]) for x in NAMES if (state, x) in STEP]
        for _, _, to in moves:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, to))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if fault in (FINE, TRUNCATED):
                cost += TRUNCATED_STAYS * (fault == TRUNCATED)
                if (state, initial) in STEP:
                    heapq.heappush(heap, (cost, audit + "K", i + 1, STEP[state, initial]))
                for _, _, to in moves:
                    heapq.heappush(heap, (cost + REROLE, audit + "R", i + 1, to))
    return out


def applied(rows: list[tuple[str, str]], audit: str, state: str) -> Iterator[tuple[str, str, str]]:
    """``(role, text, edit)`` of what stays of turns ``(role, text)``, and of what is inserted."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit in "IR":
            role = NAMES[next(x for x in NAMES if (state, x) in STEP)]
        state = STEP[state, role[:1]]
        yield role, text, edit


# A table of a stretch: {(from, to): (cost, [(block, from, audit), ...])}.
Moves = dict[tuple[str, str], tuple[int, list]]


def joined(left: Moves, right: Moves) -> Moves:
    out: Moves = {}
    for (a, b), (cost, audits) in left.items():
        for (c, d), (more, next_audits) in right.items():
            if b != c:
                continue
            old, new = out.get((a, d)), (cost + more, audits + next_audits)
            if old is None or new[0] < old[0] or new[0] == old[0] and "".join(x[2] for x in new[1]) < "".join(x[2] for x in old[1]):
                out[a, d] = new
    return out


def all_joined(tables: list[Moves]) -> Moves:
    """By halves, so that an audit is copied as often as the number of tables has bits."""
    if len(tables) == 1:
        return tables[0]
    return joined(all_joined(tables[: len(tables) // 2]), all_joined(tables[len(tables) // 2 :]))


def summed(left: dict, right: dict) -> dict:
    """Counts of two neighbouring stretches of one conversation."""
    turns = left["turns"] + right["turns"] - (left["last"] is not None and left["last"] == right["first"])
    out = {k: left[k] + right[k] for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += left["end"] + right["begin"] not in RIGHT_PAIRS
    low, high = ([x for x in (left[k], right[k]) if x is not None] for k in ("low", "high"))
    return out | {
        "turns": turns, "low": min(low, default=None), "high": max(high, default=None),
        "first": left["first"], "last": right["last"], "begin": left["begin"], "end": right["end"],
    }


def counted(turn: int | None, role: str, fault: int) -> dict:
    known = turn is not None
    return {
        "blank": int(fault == BLANK), "duplicate": int(fault == DUPLICATE), "truncated": int(fault == TRUNCATED), "illegal": 0,
        "turns": int(known), "low": turn, "high": turn, "first": turn, "last": turn, "begin": role[:1], "end": role[:1],
    }


def answer(counts: dict, table: Moves) -> dict:
    """Counts, cost and audits of a whole conversation."""
    cost, audits = min((table["", e] for e in ENDS if ("", e) in table), key=lambda x: (x[0], "".join(a[2] for a in x[1])))
    gaps = 0 if counts["low"] is None else counts["high"] - counts["low"] + 1 - counts["turns"]
    return {k: counts[k] for k in ("blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audits": audits}


def moves_json(table: Moves) -> list:
    return [[a, b, cost, audits] for (a, b), (cost, audits) in table.items()]


def moves_of(found: list) -> Moves:
    return {(a, b): (cost, audits) for a, b, cost, audits in found}


class Cutter:
    """The rows of one task, sorted, one conversation after the other."""

    def __init__(self, part: int, size: int) -> None:
        self.block, self.size = part << 32, size
        self.part, self.conv, self.open, self.leads = part, None, False, True
        self.out: list[tuple] = []

    def begin(self, conv: object) -> None:
        self.conv, self.open = conv, True
        self.counts, self.tables, self.rows, self.before = None, [], [], None

    def row(self, turn: int | None, role: str, text: str, digest: bytes, fault: int, repeated: int) -> None:
        if fault != BLANK and (repeated == 2 or repeated == 1 and self.before == (turn, role, digest)):
            fault = DUPLICATE
        self.before = (turn, role, digest)
        mine = counted(turn, role, fault)
        self.counts = mine if self.counts is None else summed(self.counts, mine)
        self.rows.append((role, text, fault))
        if len(self.rows) == self.size:
            self.solve()

    def solve(self) -> None:
        """A full block: its table, and its rows for later."""
        turns = [(role[:1], fault) for role, _, fault in self.rows]
        table = {}
        for start in STATES:
            for end, (cost, audit) in cheapest(turns, start).items():
                table[start, end] = (cost, [(self.block, start, audit)])
        self.tables.append(table)
        self.out += [("row", self.conv, self.block, k, role, text, None, None) for k, (role, text, _) in enumerate(self.rows)]
        self.rows = []
        self.block += 1

    def end(self, last: bool) -> None:
        """``last``: the task's last conversation, which may go on in the next task, as its first may have begun before."""
        if not self.tables and not last and not self.leads:
            turns = [(role[:1], fault) for role, _, fault in self.rows]
            ((state, (cost, audit)),) = cheapest(turns, "", ENDS).items()
            found = answer(self.counts, {("", state): (cost, [(self.block, "", audit)])})
            stay = applied([(role, text) for role, text, _ in self.rows], audit, "")
            self.out += [("kept", self.conv, self.block, k, role, text, edit, None) for k, (role, text, edit) in enumerate(stay)]
            self.out.append(("whole", self.conv, self.block, 0, None, None, None, json.dumps(found)))
        else:
            if self.rows:
                self.solve()
            found = {"counts": self.counts, "moves": moves_json(all_joined(self.tables))}
            self.out.append(("part", self.conv, self.part, 0, None, None, None, json.dumps(found)))
        self.block += 1
        self.leads = self.open = False


COLUMNS = ["kind", "conv_id", "block", "place", "role", "text", "edit", "data"]


def batches(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=COLUMNS, dtype=object)


def cut(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Rows of one range in order: repaired rows of conversations inside it, blocks and tables of the others."""
    cutter = Cutter(TaskContext.get().partitionId(), size)
    for frame in frames:
        for conv, turn, *rest in zip(*(frame[c].tolist() for c in ("conv_id", "turn", "role", "text", "digest", "fault", "repeated")), strict=True):
            if not cutter.open or conv != cutter.conv:
                if cutter.open:
                    cutter.end(False)
                cutter.begin(conv)
            cutter.row(None if turn is None else int(turn), *rest)
        if cutter.out:
            yield batches(cutter.out)
            cutter.out = []
    if cutter.open:
        cutter.end(True)
        yield batches(cutter.out)


def stretch(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring parts of one conversation as one."""
    frame = frame.sort_values("block")
    parts = [json.loads(x) for x in frame["data"]]
    counts = parts[0]["counts"]
    for x in parts[1:]:
        counts = summed(counts, x["counts"])
    found = {"counts": counts, "moves": moves_json(all_joined([moves_of(x["moves"]) for x in parts]))}
    return pd.DataFrame({"conv_id": [frame["conv_id"].iloc[0]], "block": [int(frame["block"].iloc[0])], "data": [json.dumps(found)]})


def closed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [json.loads(x) for x in frame["data"]]
        yield frame.assign(data=[json.dumps(answer(x["counts"], moves_of(x["moves"]))) for x in found])


def of_block(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of a block under the audit chosen for it."""
    frame = frame.sort_values("place")
    rows = list(zip(frame["role"], frame["text"], strict=True))
    # A block whose rows all go keeps none; one of insertions alone cannot be, since blocks have rows.
    stay = list(applied(rows, frame["audit"].iloc[0], frame["state"].iloc[0]))
    out = pd.DataFrame(stay, columns=["role", "text", "edit"], dtype=object)
    out.insert(0, "conv_id", frame["conv_id"].iloc[0])
    out.insert(1, "block", frame["block"].iloc[0])
    out.insert(2, "place", range(len(out)))
    return out


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> Repaired:
    """Repaired turns and what was found, of ``rows (conv_id, turn, role, text)``."""
    # Identifiers travel as text, since pandas would make numbers with nulls inexact.
    conv, kind = "conv_id string", rows.schema["conv_id"].dataType
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]
    ranged = judged(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    schema = f"kind string, {conv}, block long, place int, role string, text string, edit string, data string"
    # Written once: a range exchange planned twice would sample its bounds twice.
    pieces = materialise(ranged.mapInPandas(lambda frames: cut(frames, block), schema), "turns")
    parts = materialise(pieces.filter("kind = 'part'").select("conv_id", "block", "data"), "parts")
    tasks = (parts.agg(F.max("block")).first()[0] or 0) + 1
    while tasks > 1:
        parts = parts.groupBy("conv_id", F.floor(F.col("block") / fan).alias("to")).applyInPandas(stretch, f"{conv}, block long, data string")
        parts = parts.withColumn("block", F.floor(F.col("block") / fan))
        tasks = -(-tasks // fan)
    parts = materialise(parts.mapInPandas(closed, f"{conv}, block long, data string"), "audits")
    # Triples are JSON arrays, which are read as arrays of strings.
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audits array<array<string>>"
    whole = pieces.filter("kind = 'whole'").select("conv_id", "data")

    def opened(df: DataFrame) -> DataFrame:
        return df.select("conv_id", F.from_json("data", fields).alias("found")).select("conv_id", "found.*")

    def told(df: DataFrame) -> DataFrame:
        audit = F.array_join(F.transform("audits", lambda x: x[2]), "")
        return opened(df).withColumn("audit", audit).drop("audits")

    chosen = opened(parts).select("conv_id", F.explode("audits").alias("a"))
    chosen = chosen.select(F.col("a")[0].cast("long").alias("block"), F.col("a")[1].alias("state"), F.col("a")[2].alias("audit"))
    # Block numbers are unique over all tasks.
    later = pieces.filter("kind = 'row'").join(chosen, "block").select("conv_id", "block", "place", "role", "text", "state", "audit")
    later = later.groupBy("block").applyInPandas(of_block, f"{conv}, block long, place int, role string, text string, edit string")
    kept = pieces.filter("kind = 'kept'").select("conv_id", "block", "place", "role", "text", "edit")
    both = kept.unionByName(later), told(whole).unionByName(told(parts))
    return Repaired(*(df.withColumn("conv_id", F.col("conv_id").cast(kind)) for df in both))


def digests(rows: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``role:text`` lines in order, hashed as they stream by: no conversation is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, hasher = None, None
        for frame in frames:
            out = []
            for at, role, text in zip(frame["conv_id"].tolist(), frame["role"], frame["text"], strict=True):
                if hasher is None or at != conv:
                    if hasher is not None:
                        out.append((conv, hasher.hexdigest()))
                    conv, hasher = at, hashlib.sha256()
                else:
                    hasher.update(b"\n")
                hasher.update(f"{role}:{text}".encode())
            yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"], dtype=object)
        if hasher is not None:
            yield pd.DataFrame([(conv, hasher.hexdigest())], columns=["conv_id", "repaired_sha256"], dtype=object)

    kind = rows.schema["conv_id"].dataType
    lines = rows.withColumn("conv_id", F.col("conv_id").cast("string")).select("conv_id", "block", "place", "role", "text")
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "block", "place")
    return lines.mapInPandas(run, "conv_id string, repaired_sha256 string").withColumn("conv_id", F.col("conv_id").cast(kind))


def repaired_summary(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``everyone``: counts, cost, audit and the digest of what was repaired."""
    found = repair(rows)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ids = everyone.select("conv_id").distinct()
    told = found.conversations.withColumnRenamed("conv_id", "told_id")
    hashed = digests(found.rows).withColumnRenamed("conv_id", "hashed_id")
    out = ids.join(told, F.col("conv_id").eqNullSafe(F.col("told_id")), "left")
    out = out.join(hashed, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"),
    )
