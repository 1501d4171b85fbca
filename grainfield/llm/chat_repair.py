"""Conversations repaired by the cheapest edits, found by a Viterbi search that emits what all its survivors agree on.

The roles of a repaired conversation read s?(ua)+ (a system turn or none, then pairs of user and assistant) or nothing. A state
per place in that pattern keeps its cheapest way so far. Ways hang in a tree of backpointers that knows each node's children:
a node without any is cut off, and as long as the root has one child, all survivors share it, so its edits are given out and
it becomes the root. Memory is thus what is still open, not the conversation. A way that costs more than another one and the
edits that lead from there to the same place can't win any more and ends, too; else deleting everything would stay open forever.

Ties are broken by the edits' letters, compared over the whole open part. Ways to different states never read the same: they
end with the letter of the same row, and equal letters lead to equal states. So the survivors have a strict order that later
letters can't change, and it is enough to keep their ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r "
START, SYSTEM, USER, PAIR = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
ROLE_INTO = {USER: "user", PAIR: "assistant"}
#: Where insertions lead from each state: the states after none, one and two of them; more never pay.
INSERTED = {START: (START, USER, PAIR), SYSTEM: (SYSTEM, USER, PAIR), USER: (USER, PAIR), PAIR: (PAIR, USER)}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5


class _Way:
    """A node of the tree: the edits of one row on a way, after those of its parent."""

    __slots__ = ("parent", "kids", "row", "inserts", "letter", "role")

    def __init__(self, parent: _Way | None, row: tuple, inserts: list[str], letter: str, role: str | None):
        self.parent, self.kids, self.row, self.inserts, self.letter, self.role = parent, [], row, inserts, letter, role
        if parent is not None:
            parent.kids.append(self)


class Repair:
    """One conversation: rows go in by add(), edits come out as soon as they are certain, and the rest by end()."""

    def __init__(self):
        self.root = _Way(None, (), [], "", None)
        self.survivors = {START: (0, 0, self.root)}  # cost, rank, way

    def _before(self) -> Iterator[tuple[int, int, int, _Way, list[str]]]:
        """Every state that can be reached before the next row: state, cost, rank, way, roles inserted after the way."""
        for state, (cost, rank, way) in self.survivors.items():
            for m, reached in enumerate(INSERTED[state]):
                yield reached, cost + INSERT * m, rank, way, [ROLE_INTO[s] for s in INSERTED[state][1 : m + 1]]

    def add(self, row: tuple, initial: str, fault: str | None) -> Iterator[tuple]:
        best: dict[int, tuple] = {}
        kept, burden = fault not in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0
        for state, cost, rank, way, inserts in self._before():
            steps = [(state, DELETE, "D", None)]
            if kept:
                if (to := NEXT.get((state, initial))) is not None:
                    steps.append((to, burden, "K", None))
                to = PAIR if state == USER else USER
                steps.append((to, burden + REROLE, "R", ROLE_INTO[to]))
            for to, price, letter, role in steps:
                found = (cost + price, rank, "I" * len(inserts) + letter, way, inserts, letter, role)
                if to not in best or found[:3] < best[to][:3]:
                    best[to] = found
        cost = {to: best[to][0] if to in best else float("inf") for to in range(4)}
        pair = min(cost[PAIR], cost[USER] + INSERT)  # what goes on after a pair can do all that others can: at worst it deletes a system turn
        most = {START: pair + DELETE, SYSTEM: pair, USER: min(cost[PAIR], cost[START], cost[SYSTEM]) + INSERT, PAIR: cost[USER] + INSERT}
        best = {to: f for to, f in best.items() if f[0] <= most[to]}
        ranks = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        old = [way for _, _, way in self.survivors.values()]
        self.survivors = {to: (f[0], ranks[to], _Way(f[3], row, *f[4:])) for to, f in best.items()}
        for way in old:
            while not way.kids and way is not self.root:
                way.parent.kids.remove(way)
                way = way.parent
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield from self._edits(self.root)

    @staticmethod
    def _edits(way: _Way) -> Iterator[tuple]:
        """(letter, row or none, new role or none) of a node."""
        yield from (("I", None, role) for role in way.inserts)
        yield way.letter, way.row, way.role

    def end(self) -> Iterator[tuple]:
        _, _, _, way, inserts = min((x for x in self._before() if x[0] in (START, PAIR)), key=lambda x: (x[1], x[2], len(x[4])))
        path = []
        while way is not self.root:
            path.append(way)
            way = way.parent
        for way in reversed(path):
            yield from self._edits(way)
        yield from (("I", None, role) for role in inserts)


def fault_of(text: str, again: bool) -> str | None:
    """The first fault that a row has: blank, duplicate, truncated."""
    end = text.rstrip(SPACES)[-1:]
    return "blank" if not end else "duplicate" if again else "truncated" if end not in ".!?" else None


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, was, fault, edit, role, text: the edits of every conversation, in order, sorted within its task.

    edit is K (kept), R (given another role: role), D (deleted: role and text null) or I (inserted: an empty text; turn, was and
    fault null). Rows are taken in order of turn (null first), then role and text. Null roles and texts count as one space, so
    they are blank; an empty role fits no place; a null conversation is one of its own; of repeated rows all but the first are
    duplicates; an empty table gives an empty one; other columns are left out, whatever their names.

    One shuffle by conversation. What occurred before is a window over the rows as they lie, sorted with spilling, and the search
    streams over them: a conversation of any length takes the memory of its open part and of no set of its texts. It stays in one
    task, as its order is what is repaired.
    """
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text")).repartition("conv")
    same = Window.partitionBy("conv", F.xxhash64("role", "text"), "role", "text").orderBy("turn")
    told = told.withColumn("again", F.row_number().over(same) > 1).sortWithinPartitions("conv", "turn", "role", "text")
    told = told.select(F.col("conv").cast("string"), F.col("turn").cast("string"), "role", "text", "again")
    names = ["conv", "turn", "was", "fault", "edit", "role", "text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, search = None, None

        def given(one: str | None, edits: Iterator[tuple]) -> Iterator[tuple]:
            for letter, row, role in edits:
                if row is None:
                    yield one, None, None, None, letter, role, ""
                else:
                    turn, was, text, fault = row
                    yield one, turn, was, fault, letter, *((None, None) if letter == "D" else (role or was, text))

        for frame in frames:
            out: list[tuple] = []
            for one, turn, was, text, again in zip(*(frame[c] for c in frame.columns)):
                if search is None or one != last:
                    out += given(last, search.end()) if search else []
                    last, search = one, Repair()
                fault = fault_of(text, again)
                out += given(one, search.add((turn, was, text, fault), was[:1], fault))
            if out:
                yield pd.DataFrame(out, columns=names)
        if search and (out := list(given(last, search.end()))):
            yield pd.DataFrame(out, columns=names)

    edits = told.mapInPandas(run, "conv string, turn string, was string, fault string, edit string, role string, text string")
    kind, number = rows.schema[conv].dataType, rows.schema[turn].dataType
    return edits.select(F.col("conv").cast(kind).alias(conv), F.col("turn").cast(number).alias(turn), "was", "fault", "edit", "role", "text")


def repair_digests(edits: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation of repair_conversations(), in its order: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Edits are read one after the other with a running digest. gaps are whole turns missing between the least and the greatest;
    illegal are neighbouring rows whose roles' initials are not su, ua or au; the digest is of role:text of the repaired rows.
    """
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict | None = None
        price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

        def closed(d: dict) -> tuple:
            gaps = d["high"] - d["low"] + 1 - d["turns"] if d["turns"] else 0
            return (d["conv"], gaps, *(d[c] for c in counts[1:]), "".join(d["audit"]), d["sha"].hexdigest())

        def shown(done: list[dict]) -> Iterator[pd.DataFrame]:
            if done:
                yield pd.DataFrame(map(closed, done), columns=["conv", *counts, "audit", "repaired_sha256"])

        for frame in frames:
            done = []
            for one, at, was, fault, edit, role, text in zip(*(frame[c] for c in frame.columns)):
                if now is None or one != now["conv"]:
                    done += [now] if now else []
                    now = dict.fromkeys(counts, 0) | {"conv": one, "low": None, "high": None, "turns": 0, "last": None, "audit": [], "sha": hashlib.sha256(), "rows": 0}
                now["audit"].append(edit)
                now["cost"] += price[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                if edit != "D":
                    now["sha"].update(f"{chr(10) if now['rows'] else ''}{role}:{text}".encode())
                    now["rows"] += 1
                if edit != "I":
                    if fault:
                        now[fault] += 1
                    now["illegal"] += now["last"] is not None and now["last"] + was[:1] not in ("su", "ua", "au")
                    now["last"] = was[:1]
                    if at is not None and (now["high"] is None or int(at) != now["high"]):
                        now["high"], now["turns"] = int(at), now["turns"] + 1
                        now["low"] = now["high"] if now["low"] is None else now["low"]
            yield from shown(done)
        yield from shown([now] if now else [])

    rows = edits.select(F.col(conv).cast("string").alias("conv"), F.col(turn).cast("string").alias("turn"), "was", "fault", "edit", "role", "text")
    out = rows.mapInPandas(run, "conv string, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string")
    return out.select(F.col("conv").cast(edits.schema[conv].dataType).alias(conv), *out.columns[1:])
