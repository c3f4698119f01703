"""Conversation structure repair: cheapest edits that make the roles read ``(s?(ua)+)?``, one sorted stream per conversation.

Rows are repartitioned by conversation and sorted by turn (NULLs first; ties by role and text).  ``mapInPandas`` reads the
stream and carries the state of a dynamic programme from one Arrow batch to the next: for each of four places in the
pattern (nothing yet, after system, after user, after assistant) the least cost so far and the order of the four least audits.
Costs above the least one by more than some edits' worth can never win and are dropped, so only finitely many states exist; each
(state, kind of row) is worked out once per task and then looked up.

Per row one 4-byte back-pointer is kept (which transition was taken), and the row itself until its conversation ends.
Both go to a file of the task once they exceed ``SPILL`` bytes, so a conversation of any length needs bounded memory, but for
its audit: one byte a row, which is the result.

    Keep 0, Rerole 1 (to user or assistant), Delete 2 (the only edit of blank and duplicate rows),
    Insert 5 (an empty user or assistant turn); a truncated row that is not deleted costs 5 more.

These are the default ``costs``; with them two deletions are cheaper than any insertion.

Of audits of equal cost the ASCII-least is taken.  That is a local choice: an audit without its last insertions has one letter of
D, K, R per row, so of two audits over the same rows neither begins with the other, and their order stays whatever follows.

A row is blank without ``[^\\x20\\x09-\\x0D]``, else a duplicate if role and text occur earlier in its conversation, else truncated if
the last such character is none of ``.!?``.  Earlier copies are found before the stream: rows are hashed (128 bits), the first turn of each
(conversation, hash) is counted with partial sums, and marks for later turns are sorted in front of the rows they concern.

Defined results: NULL role or text is one space; NULL turns come first and are left out of ``gaps``; rows with a NULL conversation are one
conversation; rows that are not ``present`` only name their conversation; a conversation without rows has zeros, an empty audit and
the hash of no bytes; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPILL = 16_000_000  # bytes held per conversation before its rows go to a file
COSTS = {"rerole": 1, "delete": 2, "insert": 5, "cut": 5}
_WHITE = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)  # the turn that may be inserted or reroled to
_ENDING = {_START: "", _SYSTEM: "II", _USER: "I", _ASSISTANT: ""}
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_FINE, _GONE, _CUT = range(3)
_LEGAL = {"su", "ua", "au"}


def kept_as(place: int, initial: str) -> int | None:
    """Place after a row with this role initial is kept, if it may be."""
    if initial == "s":
        return _SYSTEM if place == _START else None
    if initial == "u":
        return _USER if place != _USER else None
    return _ASSISTANT if initial == "a" and place == _USER else None


class Automaton:
    """States ``((cost, order) or None per place)`` and their transitions, built when first met."""

    def __init__(self, costs: dict[str, int] = COSTS):
        self._costs = costs
        # from any place two insertions at most reach any other, where a row kept there can be deleted
        self._behind = 2 * costs["insert"] + 2 * costs["delete"] + 2 * costs["rerole"] + costs["cut"]
        first = ((0, 0), None, None, None)
        self.states, self._number = [first], {first: 0}
        self._known: dict[tuple[int, str, int], tuple[int, int, int]] = {}
        self.back: list[tuple] = []  # per transition and place: (place before, edits)

    def step(self, state: int, initial: str, fault: int) -> tuple[int, int, int]:
        """``(state, cost added, transition)`` after one more row."""
        initial = initial if initial in ("s", "u", "a") else "?"
        found = self._known.get((state, initial, fault))
        if found is None:
            found = self._known[state, initial, fault] = self._build(self.states[state], initial, fault)
        return found

    def _build(self, state: tuple, initial: str, fault: int) -> tuple[int, int, int]:
        best: dict[int, tuple] = {}

        def offer(to: int | None, cost: int, order: int, edits: str, place: int) -> None:
            if to is not None and (to not in best or (cost, order, edits) < best[to][:3]):
                best[to] = (cost, order, edits, place)

        rerole, delete, insert = (self._costs[c] for c in ("rerole", "delete", "insert"))
        extra = self._costs["cut"] if fault == _CUT else 0
        for place, known in enumerate(state):
            if known is None:
                continue
            cost, order = known
            offer(place, cost + delete, order, "D", place)
            if fault != _GONE:
                # two insertions before a row lead nowhere that none does not
                for before, at, paid in (("", place, cost), ("I", _NEXT[place], cost + insert)):
                    offer(kept_as(at, initial), paid + extra, order, before + "K", place)
                    offer(_NEXT[at], paid + extra + rerole, order, before + "R", place)
        least = min(b[0] for b in best.values())
        alive = {p: b for p, b in best.items() if b[0] - least <= self._behind}
        ranks = {p: r for r, p in enumerate(sorted(alive, key=lambda p: alive[p][1:3]))}
        after = tuple((alive[p][0] - least, ranks[p]) if p in alive else None for p in range(4))
        if after not in self._number:
            self._number[after] = len(self.states)
            self.states.append(after)
        self.back.append(tuple((alive[p][3], alive[p][2]) if p in alive else None for p in range(4)))
        return self._number[after], least, len(self.back) - 1

    def finish(self, state: int) -> tuple[int, int]:
        """``(cost added, last place)`` of the cheapest end."""
        ends = [(known[0] + self._costs["insert"] * len(_ENDING[p]), known[1], p) for p, known in enumerate(self.states[state]) if known]
        cost, _, place = min(ends)
        return cost, place


class Conversation:
    """What the stream carries about the conversation it is in."""

    def __init__(self, key: str, automaton: Automaton):
        self.key, self._auto = key, automaton
        self.state = self.cost = self.n = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self._turns, self._first_turn, self._turn = 0, 0, None
        self._last = self._initial = None
        self.marks: set[tuple[int, int]] = set()
        self._back, self._back_file = array("I"), None
        self._rows: list[tuple[str, str]] = []
        self._held, self._row_file = 0, None

    def mark(self, turn: int, key: tuple[int, int]) -> None:
        """The rows of this turn with this hash have occurred in an earlier turn."""
        if turn != self._turn:
            self._enter(turn)
        self.marks.add(key)

    def _enter(self, turn: int) -> None:
        if not self._turns:
            self._first_turn = turn
        self._turns += 1
        self._turn = turn
        self.marks.clear()
        self._last = None

    def row(self, turn: int | None, role: str, text: str, key: tuple[int, int]) -> None:
        if turn is not None and turn != self._turn:
            self._enter(turn)
        bare = text.rstrip(_WHITE)
        fault = _FINE
        if not bare:
            self.blank, fault = self.blank + 1, _GONE
        elif key in self.marks or self._last == (role, text):
            self.duplicate, fault = self.duplicate + 1, _GONE
        elif bare[-1] not in ".!?":
            self.truncated, fault = self.truncated + 1, _CUT
        initial = role[:1]
        if self._initial is not None and self._initial + initial not in _LEGAL:
            self.illegal += 1
        self._initial, self._last = initial, (role, text)
        self.state, added, via = self._auto.step(self.state, initial, fault)
        self.cost += added
        self.n += 1
        self._back.append(via)
        self._rows.append((role, text))
        self._held += len(role) + len(text) + 120
        if self._held > SPILL:
            self._spill()

    def _spill(self) -> None:
        if self._row_file is None:
            self._row_file, self._back_file = tempfile.TemporaryFile(), tempfile.TemporaryFile()
        pickle.dump(self._rows, self._row_file)
        self._back.tofile(self._back_file)
        self._rows, self._back, self._held = [], array("I"), 0

    def _back_from_end(self) -> Iterator[int]:
        yield from reversed(self._back)
        if self._back_file is not None:
            end = self._back_file.tell()
            while end:
                start = max(0, end - 4 * (1 << 18))
                self._back_file.seek(start)
                part = array("I")
                part.fromfile(self._back_file, (end - start) // 4)
                yield from reversed(part)
                end = start

    def _stored_rows(self) -> Iterator[tuple[str, str]]:
        if self._row_file is not None:
            end = self._row_file.tell()
            self._row_file.seek(0)
            while self._row_file.tell() < end:
                yield from pickle.load(self._row_file)
        yield from self._rows

    def edits(self) -> tuple[str, int]:
        """Audit and cost."""
        added, place = self._auto.finish(self.state)
        audit = bytearray(reversed(_ENDING[place].encode()))
        for via in self._back_from_end():
            place, edits = self._auto.back[via][place]
            audit += edits[::-1].encode()
        audit.reverse()
        return audit.decode(), self.cost + added

    def repaired(self, audit: str) -> Iterator[tuple[str, str]]:
        """The turns the audit leaves or makes."""
        place, rows = _START, self._stored_rows()
        for edit in audit:
            if edit == "D":
                next(rows)
                continue
            role, text = next(rows) if edit != "I" else ("", "")
            if edit == "K":
                place = kept_as(place, role[:1])
            else:
                place = _NEXT[place]
                role = _ROLE[place]
            yield role, text

    def summary(self, audit: str, cost: int) -> tuple:
        digest = hashlib.sha256()
        for i, (role, text) in enumerate(self.repaired(audit)):
            digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        gaps = self._turn - self._first_turn + 1 - self._turns if self._turns else 0
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest()

    def close(self) -> None:
        for file in (self._row_file, self._back_file):
            if file is not None:
                file.close()


_SUMMARY = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURNS = "key string, place bigint, role string, text string"
_MARK, _ROW, _NAME = range(3)


def _stream(turns: bool, costs: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, now, out, held = Automaton(costs), None, [], 0
        names = [c.split()[0] for c in (_TURNS if turns else _SUMMARY).split(", ")]

        def finished(conversation: Conversation) -> Iterator[tuple]:
            audit, cost = conversation.edits()
            if turns:
                for i, (role, text) in enumerate(conversation.repaired(audit)):
                    yield conversation.key, i, role, text
            else:
                yield conversation.summary(audit, cost)
            conversation.close()

        def frames(rows: Iterator[tuple], flush: int) -> Iterator[pd.DataFrame]:
            nonlocal out, held
            for r in rows:
                out.append(r)
                held += sum(len(v) for v in r if isinstance(v, str)) + 200
                if held > flush:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0

        for batch in batches:
            columns = [batch[c].tolist() for c in ("key", "kind", "timed", "turn", "role", "text", "h1", "h2")]
            for key, kind, timed, turn, role, text, h1, h2 in zip(*columns):
                if now is None or key != now.key:
                    if now is not None:
                        yield from frames(finished(now), 4_000_000)
                    now = Conversation(key, automaton)
                if kind == _ROW:
                    now.row(turn if timed else None, role, text, (h1, h2))
                elif kind == _MARK:
                    now.mark(turn, (h1, h2))
        if now is not None:
            yield from frames(finished(now), 4_000_000)
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def _sorted_stream(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key"),
        F.when(F.lit(True) if present is None else F.coalesce(present, F.lit(False)), _ROW).otherwise(_NAME).alias("kind"),
        F.col(turn_col).cast("long").alias("turn"),
        text_of(role_col).alias("role"),
        text_of(text_col).alias("text"),
    ).withColumns({"h1": F.xxhash64(F.lit(1), "role", "text"), "h2": F.xxhash64(F.lit(2), "role", "text")})
    slim = rows.where(F.col("kind") == _ROW).select("key", "turn", "h1", "h2")
    again = (
        slim.groupBy("key", "h1", "h2")
        .agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.max(F.col("turn").isNull()).alias("untimed"))
        .where("lo < hi or (untimed and lo is not null)")
    )
    marks = slim.join(again, ["key", "h1", "h2"]).where("untimed or turn > lo").where("turn is not null")
    nothing = F.lit(None).cast("string")
    marks = marks.select("key", F.lit(_MARK).alias("kind"), "turn", nothing.alias("role"), nothing.alias("text"), "h1", "h2")
    rows = rows.select("key", "kind", "turn", *[F.when(F.col("kind") == _ROW, F.col(c)).alias(c) for c in ("role", "text")], "h1", "h2")
    order = ["key", F.col("turn").asc_nulls_first(), "kind", "role", "text"]
    merged = rows.unionByName(marks).repartition("key").sortWithinPartitions(*order)
    return merged.select("key", "kind", F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "h1", "h2")


def _named(out: DataFrame, turns: DataFrame, conv_col: str) -> DataFrame:
    name = F.when(F.col("key") != "", F.expr("substring(key, 2)")).cast(turns.schema[conv_col].dataType)
    return out.select(name.alias("conv_id"), *out.columns[1:])


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, costs: dict[str, int] = COSTS) -> DataFrame:
    """One row per conversation: faults, cost, audit and the hash of the repaired text."""
    rows = _sorted_stream(turns, conv_col, turn_col, role_col, text_col, present)
    return _named(rows.mapInPandas(_stream(False, costs), _SUMMARY), turns, conv_col)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, costs: dict[str, int] = COSTS) -> DataFrame:
    """The repaired conversations: ``(conv_id, place, role, text)``, places from 0."""
    rows = _sorted_stream(turns, conv_col, turn_col, role_col, text_col, present)
    return _named(rows.mapInPandas(_stream(True, costs), _TURNS), turns, conv_col)


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` rows with faults planted by the crc32 of ``conv_id:turn``; dropped rows are not ``present``."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), dealt.alias("dealt"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("dealt") != 0).alias("present"),
        F.explode(F.when(F.col("dealt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
