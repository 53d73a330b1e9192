"""Repair of conversations' structure: the cheapest edits that leave turns of the form `(s?(ua)+)?`, by role initials.

The edits of a conversation are paths through a graph of places between rows and four states (nothing yet, after a
system, a user, an assistant turn). Least costs from the start and to the end tell the arcs that lie on a cheapest path;
a walk along these takes the least letter at each step. A letter leads from a node to one other node, since the state
fixes which role is inserted or set: the walk's frontier has one node.

Conversations may be of any length. Rows are sorted over all conversations and cut into blocks; a block's part of a
conversation acts on costs as a 4 x 4 matrix of least sums, and on the walk as a map of states, so that blocks of one
conversation are solved side by side. Only the checksum of a repaired conversation passes through one task, batch
by batch, as a checksum is a chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import _common

#: Rows of a block, about.
BLOCK_ROWS = 50_000
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FAR = 1 << 60
#: The state after an inserted or reroled turn, from each state: a user turn, but an assistant turn after a user.
SET_ROLE = (2, 2, 3, 2)
#: The state after a turn that keeps its role, by its initial, from each state; -1 where it can't stand.
KEEP = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
NOWHERE = (-1, -1, -1, -1)
#: Edits in ASCII order of their letters: D, I, K, R. Inserted and reroled turns are noted by the new role: u, a and U, A.
LETTER = str.maketrans("uaUA", "IIRR")
ROLE = {"u": "user", "a": "assistant", "U": "user", "A": "assistant"}
START, ACCEPTED = (0, FAR, FAR, FAR), (0, FAR, FAR, 0)
Costs = tuple[int, int, int, int]
Row = tuple[str, str, int]  #: initial, fault, copies


def with_inserts(v: Costs) -> Costs:
    """Costs to the end where turns may be inserted first."""
    a, b = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + a), min(v[1], INSERT + a), a, b


def arcs(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the ways to take a row, letters ascending; copies after the first are deleted."""
    initial, fault, copies = row
    yield "D", DELETE * copies, state
    if fault in ("", "truncated"):
        cost = DELETE * (copies - 1) + (TRUNCATED if fault else 0)
        if (kept := KEEP.get(initial, NOWHERE)[state]) >= 0:
            yield "K", cost, kept
        yield "R", cost + REROLE, SET_ROLE[state]


def costs_to_end(rows: list[Row], end: Costs) -> list[Costs]:
    """For each place from the first row to after the last: the least cost to the end, by state. ``end``: that after the last."""
    out = [end]
    for row in reversed(rows):
        after = out[-1]
        out.append(with_inserts(tuple(min(cost + after[to] for _, cost, to in arcs(row, s)) for s in range(4))))
    return out[::-1]


def costs_from_start(rows: list[Row], start: Costs) -> list[Costs]:
    """For each place: the least cost from the start, by state, inserted turns included. ``start``: that of arriving before the first row."""

    def inserted(v: list[int]) -> Costs:
        user = min(v[2], min(v[0], v[1], v[3]) + INSERT)
        return v[0], v[1], user, min(v[3], user + INSERT)

    out = [inserted(list(start))]
    for row in rows:
        new = [FAR] * 4
        for s in range(4):
            for _, cost, to in arcs(row, s):
                new[to] = min(new[to], out[-1][s] + cost)
        out.append(inserted(new))
    return out


def walk(rows: list[Row], start: Costs, end: Costs, state: int, last: bool) -> tuple[list[str], str, int]:
    """The edits of each row (with the inserts before it), those after the last row if the conversation ends here, and the last state."""
    before, after = costs_from_start(rows, start), costs_to_end(rows, end)
    least = before[0][state] + after[0][state]
    out = []

    def insert_after(i: int, state: int) -> bool:
        return before[i][state] + INSERT + after[i][SET_ROLE[state]] == least

    for i, row in enumerate(rows):
        edits = ""
        while True:
            optimal = [(letter, to) for letter, cost, to in arcs(row, state) if before[i][state] + cost + after[i + 1][to] == least]
            if insert_after(i, state) and not (optimal and optimal[0][0] == "D"):
                state = SET_ROLE[state]
                edits += "ua"[state - 2]
                continue
            letter, state = optimal[0]
            edits += "UA"[state - 2] if letter == "R" else letter
            break
        out.append(edits + "D" * (row[2] - 1))
    tail = ""
    while last and insert_after(len(rows), state):
        state = SET_ROLE[state]
        tail += "ua"[state - 2]
    return out, tail, state


def _times(matrix: list[int], v: list[int]) -> list[int]:
    return [min(FAR, *(matrix[4 * s + t] + v[t] for t in range(4))) for s in range(4)]


END = with_inserts(ACCEPTED)


def _segments(table: pa.Table) -> tuple[pa.Table, list, list[Row], list[tuple[int, int]]]:
    """The block's rows in order, their conversations, and the range of rows of each conversation."""
    table = table.sort_by("at")
    conv = table.column("conv_id").to_pylist()
    rows = list(zip(*(table.column(c).to_pylist() for c in ("initial", "fault", "copies")), strict=True))
    cuts = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]] + [len(conv)]
    return table, conv, rows, list(zip(cuts, cuts[1:], strict=False))


def _blocks(rows: DataFrame) -> DataFrame:
    """A row for each different (conversation, turn, role, text), without the text, in order and in blocks.

    Repeats of such a row, and later rows with the same role and text, are duplicates whatever their number is, so that
    they are counted before rows move.
    """
    spark = rows.sparkSession
    word = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    key = ["conv_id", "turn", "role", "digest"]
    short = rows.select("conv_id", "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), (~word).alias("blank"), (word & ~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).alias("truncated"))
    short = _common.materialize(short.groupBy(key).agg(F.count("*").alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")), "turns")
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = short.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first")).select("conv_id", F.col("first.turn").alias("turn"), "role", "digest", F.lit(0).alias("copies"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(True).alias("first"))
    marked = short.withColumn("first", F.lit(False)).unionByName(first).groupBy(key).agg(*(F.max(c).alias(c) for c in ("copies", "blank", "truncated", "first")))
    fault = F.when(F.col("blank"), "blank").when(~F.col("first"), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(short.count() / BLOCK_ROWS))
    ordered = marked.select(*key, "copies", fault.alias("fault"), F.substring("role", 1, 1).alias("initial")).repartitionByRange(parts, *key).sortWithinPartitions(*key)
    at = _common.materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "places")
    return at.withColumn("block", F.shiftright("at", 33))


def _shared_ends(blocks: DataFrame) -> DataFrame:
    """For conversations in several blocks, at most one a block's border: costs at both ends of each part, and the state that the walk enters it with.

    (conv_id, block, start, end, state, last)
    """
    spread = blocks.groupBy("conv_id").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("conv"))
    parts = _common.materialize(blocks.join(spread, F.col("conv_id").eqNullSafe(F.col("conv")), "left_semi").select("conv_id", "block", "at", "initial", "fault", "copies"), "spread")
    kind = dict(blocks.dtypes)["conv_id"]

    def matrices(table: pa.Table) -> pa.Table:
        table, conv, rows, ranges = _segments(table)
        units = [tuple(0 if s == t else FAR for s in range(4)) for t in range(4)]
        found = []
        for lo, hi in ranges:
            columns = [costs_to_end(rows[lo:hi], u)[0] for u in units]
            found.append([min(FAR, columns[t][s]) for s in range(4) for t in range(4)])
        firsts = [lo for lo, _ in ranges]
        return pa.table({"conv_id": table.column("conv_id").take(firsts), "block": table.column("block").take(firsts), "matrix": pa.array(found, pa.list_(pa.int64()))})

    def costs(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        matrix = table.column("matrix").to_pylist()
        start, end = [list(START)], [list(END)]
        for m in matrix[:-1]:
            turned = [m[4 * s + t] for t in range(4) for s in range(4)]
            start.append(_times(turned, start[-1]))
        for m in reversed(matrix[1:]):
            end.append(_times(m, end[-1]))
        longs = pa.list_(pa.int64())
        return pa.table({"conv_id": table.column("conv_id"), "block": table.column("block"), "start": pa.array(start, longs), "end": pa.array(end[::-1], longs)})

    def maps(key: tuple, table: pa.Table, ends: pa.Table) -> pa.Table:
        table, conv, rows, ranges = _segments(table)
        of = {r["conv_id"]: r for r in ends.to_pylist()}
        to = []
        for lo, hi in ranges:
            r = of[conv[lo]]
            # whatever the state it is entered with: the walk from there is cheapest from there
            to.append([walk(rows[lo:hi], tuple(0 if s == state else FAR for s in range(4)), tuple(r["end"]), state, False)[2] for state in range(4)])
        firsts = [lo for lo, _ in ranges]
        lists = pa.list_(pa.int64())
        back = lambda c: pa.array([of[conv[lo]][c] for lo in firsts], lists)
        return pa.table({"conv_id": table.column("conv_id").take(firsts), "block": table.column("block").take(firsts), "start": back("start"), "end": back("end"), "to": pa.array(to, lists)})

    def states(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        entered = [0]
        for to in table.column("to").to_pylist():
            entered.append(to[entered[-1]])
        return table.drop_columns(["to"]).append_column("state", pa.array(entered[:-1], pa.int64())).append_column("last", pa.array([i == len(entered) - 2 for i in range(len(entered) - 1)]))

    matrix = parts.groupBy("block").applyInArrow(matrices, f"conv_id {kind}, block long, matrix array<long>")
    known = _common.materialize(matrix.groupBy("conv_id").applyInArrow(costs, f"conv_id {kind}, block long, start array<long>, end array<long>"), "costs")
    mapped = parts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(maps, f"conv_id {kind}, block long, start array<long>, end array<long>, to array<long>")
    return _common.materialize(mapped.groupBy("conv_id").applyInArrow(states, f"conv_id {kind}, block long, start array<long>, end array<long>, state long, last boolean"), "ends")


def plan_repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, at, copies, fault, initial, edits, tail): a row for each different turn, in the order of ``at``.

    Rows of a conversation go by turn, nulls first; ties by role, then by the text's MD5 (``digest``). A null role or
    text counts as one space, and rows with a null conv_id are one conversation. fault is the first of: blank (no
    `[^\\x20\\x09-\\x0D]`), duplicate (role and text seen earlier), truncated (the last such character isn't `[.!?]`); else empty.
    edits has a letter for each edit: the turns inserted before (u, a), then what becomes of the row (K: kept, U or A:
    reroled, D: deleted) and of its further copies; tail: the turns inserted after the conversation's last row.
    """
    blocks = _blocks(_turns(conversations))
    ends = _shared_ends(blocks)
    kind = dict(blocks.dtypes)["conv_id"]

    def solve(key: tuple, table: pa.Table, ends: pa.Table) -> pa.Table:
        table, conv, rows, ranges = _segments(table)
        of = {r["conv_id"]: r for r in ends.to_pylist()}
        edits: list[str] = []
        tails = [""] * len(rows)
        for lo, hi in ranges:
            r = of.get(conv[lo])
            made, tails[hi - 1], _ = walk(rows[lo:hi], tuple(r["start"]), tuple(r["end"]), r["state"], r["last"]) if r else walk(rows[lo:hi], START, END, 0, True)
            edits += made
        kept = table.select(["conv_id", "turn", "role", "digest", "at", "copies", "fault", "initial"])
        return kept.append_column("edits", pa.array(edits, pa.string())).append_column("tail", pa.array(tails, pa.string()))

    schema = f"conv_id {kind}, turn long, role string, digest binary, at long, copies long, fault string, initial string, edits string, tail string"
    return blocks.groupBy("block").cogroup(ends.groupBy("block")).applyInArrow(solve, schema)


def _turns(conversations: DataFrame) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))


def _text_rows(conversations: DataFrame) -> DataFrame:
    return _turns(conversations).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))


def repaired_turns(conversations: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, at, step, role, text): the turns of the repaired conversations, ordered by (at, step)."""
    made = plan.select("*", F.posexplode(F.split(F.concat("edits", "tail"), "")).alias("step", "edit")).where("edit NOT IN ('D', '')")
    texts = _text_rows(conversations).dropDuplicates(["conv_id", "turn", "role", "digest"])
    same = [made[c].eqNullSafe(texts[c]) for c in ("conv_id", "turn", "role", "digest")]
    role = F.when(F.col("edit") == "K", made["role"]).when(F.lower("edit") == "u", "user").otherwise("assistant")
    return made.join(texts, same, "left").select(made["conv_id"], "at", "step", role.alias("role"), F.when(F.col("edit").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


class _Report:
    """The report on one conversation, from its rows in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.blank, self.duplicate, self.truncated, self.illegal, self.cost = conv, 0, 0, 0, 0, 0
        self.first = self.latest = None
        self.turns = 0
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False
        self.initial: str | None = None
        self.waiting, self.tail = "", ""

    def add(self, turn: int | None, role: str, copies: int, fault: str, initial: str, edits: str, tail: str) -> None:
        if turn is not None and turn != self.latest:
            self.first = turn if self.first is None else self.first
            self.latest, self.turns = turn, self.turns + 1
        self.blank += copies * (fault == "blank")
        self.duplicate += copies if fault == "duplicate" else (copies - 1) * (fault != "blank")
        self.truncated += fault == "truncated"
        self.illegal += (copies - 1) + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        taken = edits.rstrip("D")
        self.cost += DELETE * (len(edits) - len(taken)) + sum(0 if e == "K" else INSERT for e in taken + tail)
        self.cost += TRUNCATED * (fault == "truncated" and taken[-1:] in ("K", "U", "A"))
        self.audit.append(edits)
        own = taken[-1:] if taken[-1:] in ("K", "U", "A") else ""
        for e in taken[: len(taken) - len(own)]:
            self.write(ROLE[e], "")
        self.waiting = role if own == "K" else ROLE.get(own, "") if own else None
        self.tail = tail

    def write(self, role: str, text: str) -> None:
        self.digest.update(b"\n" * self.begun + role.encode() + b":" + text.encode())
        self.begun = True

    def text(self, text: str) -> None:
        """The text of the row last added; further copies are passed over."""
        if self.waiting is not None:
            self.write(self.waiting, text)
            self.waiting = None

    def row(self) -> tuple:
        for e in self.tail:
            self.write(ROLE[e], "")
        gaps = min(self.latest - self.first + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, ("".join(self.audit) + self.tail).translate(LETTER), self.digest.hexdigest()


def repair_report(conversations: DataFrame, plan: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``ids``.

    gaps: turn numbers missing between the least and the greatest; illegal: neighbours whose role initials aren't su, ua
    or au; audit: D, I, K, R for each edit; repaired_sha256: of the repaired turns' `role:text`, joined by newlines.
    A conversation of ``ids`` without rows has zeros, an empty audit and the checksum of nothing.
    """
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    head = ids.select("conv_id").distinct().select("conv_id", *none("long", "turn"), *none("string", "role"), *none("binary", "digest"), F.lit(0).alias("what"), *none("long", "copies"), *none("string", "fault", "initial", "edits", "tail", "text"))
    plans = plan.select("conv_id", "turn", "role", "digest", F.lit(1).alias("what"), "copies", "fault", "initial", "edits", "tail", *none("string", "text"))
    texts = _text_rows(conversations).select("conv_id", "turn", "role", "digest", F.lit(2).alias("what"), *none("long", "copies"), *none("string", "fault", "initial", "edits", "tail"), "text")
    stream = head.unionByName(plans).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "what")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = ids.select("conv_id").schema[0].dataType.simpleString()
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in names)}, audit string, repaired_sha256 string"

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Report | None = None
        done: list[tuple] = []
        types: list[pa.DataType] = []

        def packed() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *names, "audit", "repaired_sha256"])
            done.clear()
            return out

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * len(names), pa.string(), pa.string()]
            column = {c: batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "what", "copies", "fault", "initial", "edits", "tail", "text")}
            for i, what in enumerate(column["what"]):
                if what == 0:
                    done += [open_.row()] if open_ else []
                    open_ = _Report(column["conv_id"][i])
                elif what == 1:
                    open_.add(*(column[c][i] for c in ("turn", "role", "copies", "fault", "initial", "edits", "tail")))
                else:
                    open_.text(column["text"][i])
            if done:
                yield packed()
        if open_:
            done.append(open_.row())
            yield packed()

    return _common.bounded(stream).mapInArrow(report, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by the checksum of `conv_id:turn` (nulls: one space): dropped, emptied, without `[.!?]`, repeated, or given to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h: Column = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hurt = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.where(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"), hurt.alias("text"), F.when(h == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(given)
    return repair_report(rows, plan_repair(rows), given)
