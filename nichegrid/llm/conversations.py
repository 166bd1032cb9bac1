"""Repair of conversations: the cheapest edits that make turns alternate, by iterative-deepening A*.

A conversation is cut into chunks of consecutive rows. One that fits a chunk is repaired where it is read. Of the others
each chunk's costs between the states of the role pattern are combined along the conversation; with the cost of all that
follows known, the chunks are searched independently of each other, from every state they may begin in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nichegrid.llm.common import arrow, cut

#: Rows and bytes of text of a chunk; a longer row is a chunk of its own.
CHUNK_ROWS, CHUNK_BYTES = 64, 1 << 20

DELETE, INSERT, REROLE, CUT_SHORT = 4, 3, 3, 3
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
LEGAL = {"su", "ua", "au"}
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a. The state after the turn that is due, its role,
#: and what closes the pattern at least.
STATES = START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
DUE = ("user", "user", "assistant", "user")
CLOSING = (0, 2 * INSERT, INSERT, 0)
INFINITE = 1 << 60


@dataclass(frozen=True)
class Row:
    """What the search knows of a row: its role's initial, its first fault, and how many exact copies of it follow."""

    initial: str
    fault: str | None
    copies: int = 0

    @property
    def doomed(self) -> bool:
        return self.fault in (BLANK, DUPLICATE)


def after(state: int, initial: str) -> int | None:
    """The state after a row with this initial, None if the pattern doesn't allow it."""
    if state == START and initial == "s":
        return SYSTEM
    return NEXT[state] if initial == DUE[state][0] else None


def moves(rows: list[Row], i: int, state: int, last: bool) -> Iterator[tuple[str, int, int, int]]:
    """(edits, cost, next place, next state), in ASCII order of the edits. Copies of a row are deleted right after it: an
    insertion among them costs the same after them, where it is later in order."""
    if i == len(rows):
        if last:
            yield "I", INSERT, i, NEXT[state]
        return
    r = rows[i]
    copies, price = "D" * r.copies, DELETE * r.copies
    yield "D" + copies, DELETE + price, i + 1, state
    yield "I", INSERT, i, NEXT[state]
    if not r.doomed:
        price += CUT_SHORT if r.fault == TRUNCATED else 0
        if (kept := after(state, r.initial)) is not None:
            yield "K" + copies, price, i + 1, kept
        yield "R" + copies, REROLE + price, i + 1, NEXT[state]


def repair(rows: list[Row], entry: int = START, onward: list[int] | None = None) -> tuple[list[str], int, int]:
    """(edits, their cost, state after them): the cheapest edits, of equally cheap ones the first in ASCII order.

    onward: what all that follows these rows costs at least, by the state after them; None if nothing follows. A depth-first
    search tries the edits in ASCII order under a bound on the cost, which rises to the least cost that it cut off; what the
    faults of the remaining rows cost is the estimate. A state that failed goes to a table with the least cost that it is now
    known to need, which replaces the estimate. The first accepting path is the answer.
    """
    floor = [0 if onward is None else min(onward)]
    for r in reversed(rows):
        floor.append(floor[-1] + DELETE * r.copies + (DELETE if r.doomed else CUT_SHORT if r.fault else 0))
    floor.reverse()
    failed: dict[tuple[int, int], int] = {}
    path: list[tuple[str, int, int]] = []

    def search(i: int, state: int, left: int) -> bool:
        least = INFINITE
        if i == len(rows):
            least = onward[state] if onward is not None else 0 if CLOSING[state] == 0 else INFINITE
            if least <= left:
                return True
        for edits, price, j, to in moves(rows, i, state, onward is None):
            if price + failed.get((j, to), floor[j]) <= left:
                path.append((edits, price, to))
                if search(j, to, left - price):
                    return True
                path.pop()
            least = min(least, price + failed.get((j, to), floor[j]))
        failed[i, state] = least
        return False

    bound = floor[0]
    while not search(0, entry, bound):
        bound = failed[0, entry]
    return [e for e, _, _ in path], sum(p for _, p, _ in path), path[-1][2] if path else entry


def costs_before(rows: list[Row], onward: list[int]) -> list[int]:
    """What these rows and all that follows cost at least, by the state before them."""
    for r in reversed(rows):
        price = DELETE * r.copies
        kept = price + (CUT_SHORT if r.fault == TRUNCATED else 0)
        here = []
        for s in STATES:
            options = [DELETE + price + onward[s]]
            if not r.doomed:
                options.append(REROLE + kept + onward[NEXT[s]])
                if (to := after(s, r.initial)) is not None:
                    options.append(kept + onward[to])
            here.append(min(options))
        onward = [min(here[s], INSERT + here[NEXT[s]], 2 * INSERT + here[NEXT[NEXT[s]]]) for s in STATES]
    return onward


@dataclass
class Chunk:
    """Consecutive rows of one conversation: their number of faults and illegal pairs, the turns they have, and themselves."""

    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    rows: list[Row] = field(default_factory=list)
    size: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        seen = text.rstrip(SPACE)
        fault = BLANK if not seen else DUPLICATE if again else TRUNCATED if seen[-1] not in ".!?" else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if fault == BLANK:
            self.blank += copies
        else:
            self.duplicate += copies
        self.illegal += copies + (bool(self.rows) and self.rows[-1].initial + role[:1] not in LEGAL)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        self.roles.append(role)
        self.texts.append(text)
        self.rows.append(Row(role[:1], fault, copies))
        self.size += len(text)

    def repaired(self, edits: list[str], entry: int) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn after these edits."""
        i, state = 0, entry
        for e in edits:
            if e == "I":
                yield DUE[state], ""
                state = NEXT[state]
                continue
            if e[0] == "K":
                yield self.roles[i], self.texts[i]
                state = after(state, self.rows[i].initial)  # type: ignore[assignment]
            elif e[0] == "R":
                yield DUE[state], self.texts[i]
                state = NEXT[state]
            i += 1


@dataclass
class Result:
    """What chunks in order come to."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    cost: int = 0
    initial: str | None = None
    state: int = START
    audit: list[str] = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    dirty: bool = False
    turned: list[dict[str, str]] | None = None

    def add(self, c: Chunk, edits: list[str], cost: int, exit_state: int) -> None:
        for name in (BLANK, DUPLICATE, TRUNCATED, "illegal"):
            setattr(self, name, getattr(self, name) + getattr(c, name))
        if self.initial is not None:
            self.illegal += self.initial + c.rows[0].initial not in LEGAL
        self.initial = c.rows[-1].initial
        self.turns += c.turns - (c.low is not None and c.low == self.high)
        self.low = c.low if self.low is None else self.low
        self.high = self.high if c.high is None else c.high
        for role, text in c.repaired(edits, self.state):
            self.digest.update((f"\n{role}:{text}" if self.dirty else f"{role}:{text}").encode())
            self.dirty = True
            if self.turned is not None:
                self.turned.append({"role": role, "text": text})
        self.audit += edits
        self.cost += cost
        self.state = exit_state

    def row(self, conv_id: object) -> dict[str, object]:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        out = {"conv_id": conv_id, "gaps": gaps, BLANK: self.blank, DUPLICATE: self.duplicate, TRUNCATED: self.truncated, "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}
        return out | ({"repaired": self.turned} if self.turned is not None else {})


_PART = "part int, no int, matrix array<long>, roles array<string>, texts array<string>, faults array<string>, copies array<long>, b long, d long, t long, i long, turns long, low long, high long"
_PART_TYPES = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("matrix", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("faults", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())), *((n, pa.int64()) for n in ("b", "d", "t", "i", "turns", "low", "high"))])
_OUT_TYPES = pa.schema([*((n, pa.int64()) for n in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNED = pa.field("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))


def _stored(c: Chunk, part: int, no: int) -> dict[str, object]:
    matrix = [costs_before(c.rows, [0 if s == t else INFINITE for s in STATES]) for t in STATES]  # by the state after, then before
    return {"part": part, "no": no, "matrix": [min(x, INFINITE) for row in matrix for x in row], "roles": c.roles, "texts": c.texts, "faults": [r.fault for r in c.rows], "copies": [r.copies for r in c.rows], "b": c.blank, "d": c.duplicate, "t": c.truncated, "i": c.illegal, "turns": c.turns, "low": c.low, "high": c.high}


def _rebuilt(r: dict) -> Chunk:
    rows = [Row(role[:1], f, n) for role, f, n in zip(r["roles"], r["faults"], r["copies"], strict=True)]
    return Chunk(r["roles"], r["texts"], rows, 0, r["b"], r["d"], r["t"], r["i"], r["turns"], r["low"], r["high"])


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    size = 0
    for r in rows:
        held.append(r)
        size += sum(map(len, r.get("texts") or ())) + sum(len(t["text"]) for t in r.get("repaired") or ())
        if len(held) >= most or size > CHUNK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for start in range(0, b.num_rows, 256):
            yield from b.slice(start, 256).to_pylist()


def repaired(rows: DataFrame, with_turns: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256[, repaired]) of each conversation.

    Rows (conv_id, turn, role, text) of a conversation come in the order of their turns, nulls first, those of one turn by a
    hash of role and text, so that equal ones are adjacent. A null role or text counts as one space; rows whose conv_id is
    null are one conversation; ids are whole numbers or strings. An empty role has no initial. Ties between edits go to the first in ASCII order; repeated rows
    are duplicates. Texts may be of any length; an empty one is blank. Other columns, whatever their names, are not read. An
    empty table gives no rows. with_turns adds the repaired turns as one array, as long as the conversation.

    Equal rows are counted before they are sorted, and rows sorted by ranges of (conv_id, turn, hash), so that a hot
    conversation is spread over tasks. In chunks of `chunk_rows`, only its costs, its audit and the hash of its text, which is
    sequential, come together, chunk by chunk.
    """
    one = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    one = one.withColumn("h", F.xxhash64("role", "text"))
    counted = cut(one.groupBy("conv_id", "turn", "h", "role", "text").agg(F.count("*").alias("n")))
    # turns in which a role and text of an earlier turn comes again, as rows that come before those they speak of
    key = F.sha2(F.concat_ws(":", "role", "text"), 256)
    times = counted.select("conv_id", "turn", "h", key.alias("key")).groupBy("conv_id", "h", "key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("x"), "turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = counted.select("conv_id", "turn", "h", key.alias("key")).alias("c").join(times.alias("t"), F.col("c.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("c.h") == F.col("t.h")) & (F.col("c.key") == F.col("t.key")))
    again = again.where(~F.col("c.turn").eqNullSafe(F.col("t.first.turn"))).select("c.conv_id", "c.turn", "c.h", "c.key")
    both = counted.select("conv_id", "turn", "h", F.lit(1).alias("kind"), "role", "text", "n").unionByName(again.select("conv_id", "turn", "h", F.lit(0).alias("kind"), F.col("key").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("n")))
    id_type = rows.schema["conv_id"].dataType.simpleString()
    ids = pa.field("conv_id", {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type])
    out_types = pa.schema([ids, *_OUT_TYPES, *([_TURNED] if with_turns else [])])
    out = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string" + (", repaired array<struct<role: string, text: string>>" if with_turns else "")
    start = lambda: Result(turned=[] if with_turns else None)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """A result for each conversation that lies in one chunk of this partition for certain, a chunk of any other one."""
        part = TaskContext.get().partitionId()  # type: ignore[union-attr]
        no = 0
        held: tuple[object, Chunk] | None = None  # the conversation in hand
        inner = False  # whether it began here, in this chunk
        marks: set[str] = set()
        at: tuple = ()
        for r in _read(batches):
            if at != (r["conv_id"], r["turn"], r["h"]):
                at, marks = (r["conv_id"], r["turn"], r["h"]), set()
            if r["kind"] == 0:
                marks.add(r["role"])
                continue
            if held and held[0] != r["conv_id"]:
                if inner:
                    yield whole(*held)
                else:
                    yield {"conv_id": held[0]} | _stored(held[1], part, no)
                no += 1
                held, inner = (r["conv_id"], Chunk()), True
            elif held and (len(held[1].rows) >= chunk_rows or held[1].size + len(r["text"]) > CHUNK_BYTES):
                yield {"conv_id": held[0]} | _stored(held[1], part, no)
                no += 1
                held, inner = (r["conv_id"], Chunk()), False
            held = held or (r["conv_id"], Chunk())
            again = bool(marks) and hashlib.sha256(f"{r['role']}:{r['text']}".encode()).hexdigest() in marks
            held[1].add(r["turn"], r["role"], r["text"], r["n"] - 1, again)
        if held:
            yield {"conv_id": held[0]} | _stored(held[1], part, no)

    def whole(conv_id: object, c: Chunk) -> dict:
        result = start()
        result.add(c, *repair(c.rows))
        return result.row(conv_id)

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """What follows each chunk costs; the chunks of a conversation come from the last to the first."""
        for _, chunks in groupby(_read(batches), lambda r: r["conv_id"]):
            costs = list(CLOSING)
            for i, c in enumerate(chunks):
                yield {"part": c["part"], "no": c["no"], "onward": costs if i else None}
                m = c["matrix"]
                costs = [min(m[4 * t + s] + costs[t] for t in STATES) for s in STATES]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for r in _read(batches):
            rows = _rebuilt(r).rows
            found = [repair(rows, s, r["onward"]) for s in STATES]
            yield r | {"edits": [",".join(e) for e, _, _ in found], "prices": [p for _, p, _ in found], "exits": [s for _, _, s in found]}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for conv_id, chunks in groupby(_read(batches), lambda r: r["conv_id"]):
            result = start()
            for r in chunks:
                s = result.state
                result.add(_rebuilt(r), r["edits"][s].split(",") if r["edits"][s] else [], r["prices"][s], r["exits"][s])
            yield result.row(conv_id)

    def step(df: DataFrame, f: object, names: pa.Schema, schema: str) -> DataFrame:
        return arrow(df, lambda it: _batches(f(it), names), schema)  # type: ignore[operator]

    part_types = pa.schema([ids, *_PART_TYPES])
    first_types = pa.schema([*out_types, *_PART_TYPES])
    ordered = both.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h", "kind", "role", "text")
    first = cut(step(ordered, pieces, first_types, f"{out}, {_PART}"))
    chunks = first.where("no IS NOT NULL").select(*part_types.names)
    costs = step(chunks.select("conv_id", "part", "no", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("no")), onward, pa.schema([("part", pa.int32()), ("no", pa.int32()), ("onward", pa.list_(pa.int64()))]), "part int, no int, onward array<long>")
    more = pa.schema([("edits", pa.list_(pa.string())), ("prices", pa.list_(pa.int64())), ("exits", pa.list_(pa.int64()))])
    found = cut(step(chunks.join(costs, ["part", "no"]), searched, pa.schema([*part_types, *more]), f"conv_id {id_type}, {_PART}, edits array<string>, prices array<long>, exits array<long>"))
    long = step(found.drop("matrix").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no"), joined, out_types, out)
    return first.where("no IS NULL").select(*out_types.names).unionByName(long)


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a fault in a quarter of the rows, by crc32('conv_id:turn') % 20: 0 drops the row, 1
    empties its text, 2 takes its . ! ? away, 3 repeats it, 4 makes its role user. A null of the row is one space there."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    kept = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), k.alias("k")).where("k <> 0")
    changed = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return kept.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_")).drop("_")


def damaged_and_repaired(rows: DataFrame) -> DataFrame:
    """repaired() of damage(), with a row for each conv_id of `rows`: one whose rows are all dropped has zeros, no edits and the
    hash of the empty string."""
    found = repaired(damage(rows)).withColumnRenamed("conv_id", "id")
    all_ids = rows.select("conv_id").distinct()
    joined = all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
