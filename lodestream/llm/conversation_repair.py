"""Repair of the turn structure of conversations at least cost, by a lazily determinised weighted automaton.

Roles in a conversation should read ``(s?(ua)+)?`` by their initials: perhaps a system turn, then pairs of user and assistant. A row is
kept (0), given the other of the roles user and assistant (2), or deleted (3); an empty turn of either can be inserted anywhere (2);
rows that are kept though their text is cut off add 1, and blank rows and those whose role and text occurred before must go.

What is left to pay from each of the automaton's four states is a vector; less its least entry it is a state of the determinised
automaton. Vectors and the transitions between them are found when they are first needed and kept in a table (``Automaton``), so a
conversation is scanned from its last row to its first with one look-up a row, which gives the cost. The way back follows arcs that are
tight, of several the edit whose letter comes first: D(elete), I(nsert), K(eep), R(erole).

Rows are sorted by ranges of conversation and turn, so a conversation of any size is spread over many tasks as segments. A segment's
cost from each state to each is a 4 by 4 matrix; only the first and last conversation of a partition can go on in others, so their
matrices (two for each partition at most) are all that is put together over tasks. Texts are told apart by SHA-256 and stay where they
are until the rows that are kept are known; then they are dealt out once, by conversation.

Defined cases: null roles and texts are one space; null turns come first and are no gap; rows of one turn stand by role, then by the
digest of their text; equal rows are copies of which the first counts; rows without a conv_id are one conversation; roles with another
initial than s, u, a can't be kept, and an empty role has no initial; an empty table gives an empty result; other columns are ignored.
What one row of the result holds of a conversation (its audit) and its digest are by their nature made in one task each: a letter for
each edit, and a running digest with one batch of texts in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import durable, in_tasks, release

DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
_FAR = 1 << 50
# States: at the begin, after s, after u, after a. For each the role that user and assistant turns can have next, and where that leads.
_AFTER = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_LEGAL = ("su", "ua", "au")
#: Symbols of rows: 0 must go; else the initial's number, and 4 more where the text is cut off.
_INITIALS = "sua?"
_SPACES = " \t\n\x0b\x0c\r"
_KEY = ["conv_id", "has", "at", "role", "digest"]


def _with_inserts(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[_AFTER[q][1]]) for q, c in enumerate(costs)]
    return tuple(costs)


class Automaton:
    """Vectors of costs by number, and the table of transitions, filled as it is used."""

    #: Nothing is left: what begun pairs still need.
    END = _with_inserts([0, _FAR, _FAR, 0])

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self._numbers: dict[tuple[int, ...], int] = {}
        self._table: dict[tuple[int, int], tuple[int, int]] = {}
        self._arcs: dict[tuple[int, int, int], tuple[str, tuple[str, ...], str | None, int]] = {}

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """The number of a vector, and what was taken off it."""
        least = min(costs)
        normal = tuple(_FAR if c >= _FAR else c - least for c in costs)
        if normal not in self._numbers:
            self._numbers[normal] = len(self.vectors)
            self.vectors.append(normal)
        return self._numbers[normal], least

    def _edits(self, state: int, symbol: int, q: int) -> Iterator[tuple[int, str, str | None, int]]:
        """Cost with all that follows, letter, new role, next state, of what can be done with a row in state q."""
        after = self.vectors[state]
        yield DELETE + after[q], "D", None, q
        if symbol:
            cut = CUT if symbol > 4 else 0
            kept = _KEPT.get((q, _INITIALS[(symbol - 1) % 4]))
            if kept is not None:
                yield cut + after[kept], "K", None, kept
            role, to = _AFTER[q]
            yield REROLE + cut + after[to], "R", role, to

    def before(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row, and what its least entry grew by."""
        key = state, symbol
        if key not in self._table:
            self._table[key] = self.state(_with_inserts([min(e[0] for e in self._edits(state, symbol, q)) for q in range(4)]))
        return self._table[key]

    def arc(self, state: int, symbol: int, q: int) -> tuple[str, tuple[str, ...], str | None, int]:
        """The letters up to the edit of a row, the roles inserted before it, its new role, and the state after it."""
        key = state, symbol, q
        if key not in self._arcs:
            number, least = self.before(state, symbol)
            tight = [c + least for c in self.vectors[number]]
            letters, roles = "", []
            while True:
                found = [(e[1], e[2], e[3]) for e in self._edits(state, symbol, q) if e[0] == tight[q]]
                role, to = _AFTER[q]
                if INSERT + tight[to] == tight[q]:
                    found.append(("I", role, to))
                letter, role, q = min(found, key=lambda e: e[0])
                letters += letter
                if letter != "I":
                    break
                roles.append(role)
            self._arcs[key] = letters, tuple(roles), role, q
        return self._arcs[key]

    def scan(self, symbols: bytes, copies: list[int], end: tuple[int, ...]) -> tuple[list[int], tuple[int, ...]]:
        """The state after each row (of each run of copies), and the vector before the first. Copies after the first of a run must go."""
        now, total = self.state(end)
        after = [0] * len(symbols)
        for i in range(len(symbols) - 1, -1, -1):
            for n in (copies[i] - 1, 0):
                # Once inserts are allowed for, a row that must go changes no differences.
                for _ in range(min(n, 2)):
                    now, more = self.before(now, 0)
                    total += more
                total += max(n - 2, 0) * DELETE
                if not n:
                    break
            after[i] = now
            now, more = self.before(now, symbols[i])
            total += more
        return after, tuple(min(_FAR, c + total) for c in self.vectors[now])

    def trace(self, symbols: bytes, copies: list[int], after: list[int], q: int) -> Iterator[tuple[str, tuple[str, ...], str | None, int]]:
        """``arc`` of row after row from state q on."""
        for symbol, n, state in zip(symbols, copies, after, strict=True):
            letters, roles, role, q = self.arc(state, symbol, q)
            yield letters + "D" * (n - 1), roles, role, q

    @staticmethod
    def closing(q: int) -> tuple[str, ...]:
        """The roles inserted after the last row."""
        return ((), ("user", "assistant"), ("assistant",), ())[q]


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` with faults by the remainder of crc32(``conv_id:turn``) by 20.

    0: the row goes, 1: empty text, 2: its full stops, exclamation and question marks go, 3: two copies, 4: the role is user.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``_KEY``, in which no column but conv_id is null; turns are numbers."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    filled = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = rows.select("conv_id", F.col("turn").isNotNull().alias("has"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"), filled("role").alias("role"), filled("text").alias("text"), copies.alias("copies"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _symbol() -> Column:
    initial = F.greatest(F.coalesce(F.array_position(F.array(*map(F.lit, _INITIALS)), F.substring("role", 1, 1)), F.lit(0)), F.lit(0))
    return F.when(initial == 0, 4).otherwise(initial) + F.when(F.substring("bare", -1, 1).isin(".", "!", "?"), 0).otherwise(4)


_SEGMENT = "part int, edge boolean, symbols binary, copies array<long>, has array<boolean>, at array<long>, role array<string>, digest array<binary>, costs array<long>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"


def _pairs(roles: list[str], copies: list[int]) -> int:
    """How many neighbours' initials are not among ``_LEGAL``; copies never are."""
    return sum(n - 1 for n in copies) + sum(a[:1] + b[:1] not in _LEGAL for a, b in zip(roles, roles[1:], strict=False))


def _segments(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, part = Automaton(), TaskContext.get().partitionId()
        fields = ["symbol", "copies", "has", "at", "role", "digest", "fresh", "blank"]
        names = ["conv_id", *(f.split()[0] for f in _SEGMENT.split(", "))]
        kinds = [kind, pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.binary()), pa.list_(pa.int64()), *[pa.int64()] * 7]

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column("conv_id").to_pylist(), *(batch.column(f).to_pylist() for f in fields), strict=True)

        def segment(conv, own: list[tuple], edge: bool) -> list:
            symbol, copies, has, at, role, digest, fresh, blank = (list(x) for x in list(zip(*own, strict=True))[1:])
            symbols = bytes(s if f and not b else 0 for s, f, b in zip(symbol, fresh, blank, strict=True))
            costs: list[int] = []
            if edge:
                for to in range(4):
                    costs += automaton.scan(symbols, copies, tuple(0 if q == to else _FAR for q in range(4)))[1]
            turns = [t for h, t in zip(has, at, strict=True) if h]
            blanks = sum(n for n, b in zip(copies, blank, strict=True) if b)
            again = sum(n - (1 if f else 0) for n, f, b in zip(copies, fresh, blank, strict=True) if not b)
            return [conv, part, edge, symbols, copies, has, at, role, digest, costs, blanks, again, sum(s > 4 for s in symbols), _pairs(role, copies), len(set(turns)), min(turns, default=None), max(turns, default=None)]

        held, first, out, size = None, True, [], 0
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            if held is not None:
                out.append(segment(*held, first))
                size += len(held[1])
                first = False
                if size > 20_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out, size = [], 0
            held = conv, list(own)
        if held is not None:
            out.append(segment(*held, True))
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _suffixes(own: pd.DataFrame) -> pd.DataFrame:
    """What is left to pay after each segment of one conversation; and what its neighbours add to the counts."""
    own = own.sort_values("part").reset_index(drop=True)
    ends: list[tuple[int, ...]] = [Automaton.END]
    for costs in reversed(own["costs"].tolist()):
        ends.append(tuple(min(int(costs[4 * to + q]) + ends[-1][to] for to in range(4)) for q in range(4)))
    own["suffix"] = [list(e) for e in reversed(ends[:-1])]
    own["last"] = own.index == len(own) - 1
    before = own.shift(1)
    own["over"] = [int(i > 0 and (p or "")[:1] + r[:1] not in _LEGAL) for i, (p, r) in enumerate(zip(before["last_role"], own["first_role"], strict=True))]
    own["same"] = (before["high"] == own["low"]).astype(int)
    return own[["conv_id", "part", "suffix", "last", "over", "same"]]


def _starts(own: pd.DataFrame) -> pd.DataFrame:
    """The state in which each segment of one conversation begins."""
    own = own.sort_values("part").reset_index(drop=True)
    q, start = 0, []
    for ends in own["ends"]:
        start.append(q)
        q = int(ends[q])
    own["start"] = start
    return own[["conv_id", "part", "start"]]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton()
    for batch in batches:
        ends = []
        for symbols, copies, suffix in zip(*(batch.column(c).to_pylist() for c in ("symbols", "copies", "suffix")), strict=True):
            after, _ = automaton.scan(symbols, copies, tuple(suffix))
            own = []
            for q in range(4):
                for *_, q in automaton.trace(symbols, copies, after, q):
                    pass
                own.append(q)
            ends.append(own)
        yield pa.record_batch([batch.column("conv_id"), batch.column("part"), pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "part", "ends"])


_EDITS = "part int, audit string, cost long, has array<boolean>, at array<long>, role array<string>, digest array<binary>, step array<int>, edits array<string>, inserted array<string>"


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each segment, and its rows that are kept or come after inserted ones. ``step`` orders what has one key: 0 before its text, 2 after it."""
    automaton = Automaton()
    for batch in batches:
        fields = ["symbols", "copies", "suffix", "last", "start", "has", "at", "role", "digest"]
        out: list[list] = []
        for symbols, copies, suffix, last, start, *key in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
            after, costs = automaton.scan(symbols, copies, tuple(suffix))
            audit, rows, waiting, q = [], [], [], start
            for i, (letters, roles, role, q) in enumerate(automaton.trace(symbols, copies, after, q)):
                audit.append(letters)
                waiting += roles
                edit = letters[len(roles)]
                if edit != "D":
                    rows.append((*(k[i] for k in key), 0, role or key[2][i], ",".join(waiting)))
                    waiting = []
            cost = costs[start] - suffix[q]
            if last:
                closing = automaton.closing(q)
                audit.append("I" * len(closing))
                waiting += closing
                cost += INSERT * len(closing)
            if waiting:
                rows.append((*(k[-1] for k in key), 2, None, ",".join(waiting)))
            out.append(["".join(audit), cost, *(list(x) for x in zip(*rows, strict=True))] if rows else ["".join(audit), cost, *([] for _ in range(7))])
        kinds = [pa.string(), pa.int64(), *map(pa.list_, (pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string(), pa.string()))]
        columns = list(zip(*out, strict=True)) if out else [()] * 9
        names = [f.split()[0] for f in _EDITS.split(", ")]
        yield pa.record_batch([batch.column("conv_id"), batch.column("part"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", *names])


def _said(kind: pa.DataType, digests: bool):
    """Rows of a conversation as they come out of its texts and edits, sorted by key and step; or only their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running, place, waiting = None, None, 0, None
        for batch in batches:
            out: list[tuple] = []

            def say(role: str, text: str) -> None:
                nonlocal place
                if digests:
                    running.update(f"{chr(10) if place else ''}{role}:{text}".encode())
                else:
                    out.append((now[0], place, role, text))
                place += 1

            for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "has", "at", "role", "digest", "step", "edit", "inserted", "text")), strict=True):
                key, (step, edit, inserted, text) = row[:4], row[4:]
                if now is None or now[0] != conv:
                    if digests and now is not None:
                        out.append((now[0], running.hexdigest()))
                    now, running, place, waiting = (conv,), hashlib.sha256(), 0, None
                if step == 1:
                    if waiting is not None and waiting[0] == key:
                        say(waiting[1], text)
                        waiting = None
                    continue
                for role in inserted.split(",") if inserted else ():
                    say(role, "")
                if step == 0:
                    waiting = key, edit
            kinds = [kind, pa.string()] if digests else [kind, pa.int64(), pa.string(), pa.string()]
            names = ["conv_id", "sha256"] if digests else ["conv_id", "place", "role", "text"]
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
        if digests and now is not None:
            yield pa.record_batch([pa.array([now[0]], kind), pa.array([running.hexdigest()])], ["conv_id", "sha256"])

    return run


class Repair:
    """What ``repair`` finds: ``summary()`` of each conversation, ``rows()`` of the repaired ones, or their ``digests()``."""

    def __init__(self, keyed: DataFrame, segments: DataFrame, edits: DataFrame):
        self._keyed, self._segments, self._edits = keyed, segments, edits
        self._conv = keyed.schema["conv_id"].dataType.simpleString()

    def summary(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
        own = self._segments.select("conv_id", "part", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("over")).alias("illegal"), (F.col("turns") - F.col("same")).alias("turns"), "low", "high", F.lit(0).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"))
        zero = [F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]
        audits = self._edits.select("conv_id", "part", *zero, F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"), "cost", "audit")
        # A conversation has a row for each of its segments.
        every = own.unionByName(audits).groupBy("conv_id").agg(
            *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "cost")), F.min("low").alias("low"), F.max("high").alias("high"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit")))), lambda x: x["audit"]), "").alias("audit"),
        )
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
        return every.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _out(self, digests: bool) -> DataFrame:
        at = F.arrays_zip("has", "at", "role", "digest", "step", "edits", "inserted")
        edits = self._edits.select("conv_id", F.explode(at).alias("e")).select("conv_id", "e.has", "e.at", "e.role", "e.digest", "e.step", F.col("e.edits").alias("edit"), "e.inserted", F.lit(None).cast("string").alias("text"))
        texts = self._keyed.select(*_KEY, F.lit(1).alias("step"), F.lit(None).cast("string").alias("edit"), F.lit(None).cast("string").alias("inserted"), "text")
        rows = texts.unionByName(edits).repartition("conv_id").sortWithinPartitions(*_KEY, "step")
        schema = f"conv_id {self._conv}, " + ("sha256 string" if digests else "place long, role string, text string")
        return rows.transform(in_tasks, _said(_arrow(self._keyed), digests), schema)

    def rows(self) -> DataFrame:
        """``conv_id, place, role, text`` of the repaired conversations."""
        return self._out(False)

    def digests(self) -> DataFrame:
        """``conv_id, sha256`` of ``role:text`` of the repaired rows, joined by line ends; a conversation of which nothing is left has that of nothing."""
        return self._out(True)


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


def repair(rows: DataFrame) -> Repair:
    """The cheapest edits of ``rows(conv_id, turn, role, text)``; ``copies`` says how often a row is there, if it is a column."""
    keyed = _keyed(rows)
    conv = keyed.schema["conv_id"].dataType.simpleString()
    bare = keyed.withColumn("bare", F.rtrim("text", F.lit(_SPACES)))
    counted = bare.withColumns({"symbol": _symbol(), "blank": F.col("bare") == ""}).groupBy(*_KEY).agg(F.sum("copies").alias("copies"), F.max("symbol").alias("symbol"), F.max("blank").alias("blank"))
    # The first row of each role and text; every other is a duplicate. Joined on the whole key, so that no text of many rows is a hot key.
    first = counted.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("has", "at")).alias("m"))
    first = first.select(F.col("conv_id").alias("f_conv"), F.col("m.has").alias("f_has"), F.col("m.at").alias("f_at"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"))
    same = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("has") == F.col("f_has")) & (F.col("at") == F.col("f_at")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    flagged = counted.join(first, same, "left").select(*_KEY, "copies", "symbol", "blank", F.col("f_digest").isNotNull().alias("fresh"))
    ordered = flagged.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    table = durable(ordered.transform(in_tasks, _segments(_arrow(keyed)), f"conv_id {conv}, {_SEGMENT}"), "segments")
    # Two segments of each partition at most may go on in others: their tables below have no more rows than that.
    edges = table.where("edge").select("conv_id", "part", "costs", F.element_at("role", 1).alias("first_role"), F.element_at("role", -1).alias("last_role"), "low", "high")
    suffixes = durable(edges.groupBy("conv_id").applyInPandas(_suffixes, f"conv_id {conv}, part int, suffix array<long>, last boolean, over int, same int"), "suffixes")
    join = lambda one, two: one.join(F.broadcast(two.withColumnsRenamed({"conv_id": "c", "part": "p"})), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left").drop("c", "p")
    ends = join(table.where("edge").select("conv_id", "part", "symbols", "copies"), suffixes).transform(in_tasks, _ends, f"conv_id {conv}, part int, ends array<int>")
    starts = durable(ends.groupBy("conv_id").applyInPandas(_starts, f"conv_id {conv}, part int, start int"), "starts")
    whole = join(join(table, suffixes), starts).withColumns({
        "suffix": F.coalesce("suffix", F.array(*(F.lit(c).cast("long") for c in Automaton.END))), "last": F.coalesce("last", F.lit(True)), "start": F.coalesce("start", F.lit(0)),
        "over": F.coalesce("over", F.lit(0)), "same": F.coalesce("same", F.lit(0)),
    })
    edits = durable(whole.transform(in_tasks, _traced, f"conv_id {conv}, {_EDITS}"), "edits")
    return Repair(keyed, whole.select("conv_id", "part", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "over", "same"), edits)


def repaired_summary(conversations: DataFrame) -> DataFrame:
    """``Repair.summary`` and ``repaired_sha256`` of every conversation after ``damage``; those of which damage left no row have zeros."""
    found = repair(damage(conversations))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = F.lit(None).cast("string")
    zeros = [F.lit(0).cast("long").alias(c) for c in numbers]
    every = conversations.select("conv_id").distinct().select("conv_id", *zeros, none.alias("audit"), none.alias("sha256"))
    every = every.unionByName(found.summary().withColumn("sha256", none)).unionByName(found.digests().select("conv_id", *zeros, none.alias("audit"), "sha256"))
    out = every.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in numbers), F.max("audit").alias("audit"), F.max("sha256").alias("sha256"))
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
