"""Conversation structure repair by a DP over the turns that stay.

Rows of a conversation are kept, given another role, or deleted, and turns without text are inserted, so that the roles'
initials read `(s?(ua)+)?` at the least cost. The DP goes from one retained row to the next: a prefix sum of deletions prices
the rows between them, the pair of their roles determines what must be inserted between them, and a running minimum for each
state (the last retained role) keeps the best continuation, so that each row is looked at once. Of equally cheap edits the
ASCII-least audit wins: it is read off forwards, row by row, from the running minima.

Rows are range-partitioned by conversation and turn, so that one conversation may take any number of parts. A part prices
the piece of a conversation that it holds as a table from the role before it to the role after it; only pieces at the ends
of a part can belong to a conversation that goes on elsewhere, and the tables of those are chained. Each part then reads off
its edits, for every role that may come before it. In the end rows stream through in order, and what the digest needs is
never held: a digest of one text is one chain, so a conversation ends in one task, in memory of one part's edits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Costs of edits; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows that a part should have.
PART_ROWS = 1 << 18
NEVER = 1 << 40
#: States: no retained row yet, or the role of the last one. Retained roles: system, user, assistant.
STATES, ROLES = ("", "s", "u", "a"), ("s", "u", "a")
#: Turns that must be inserted between a state and the next retained role, and after the last one.
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
CLOSING = {"": "", "s": "ua", "u": "a", "a": ""}
NAMES = {"s": "system", "u": "user", "a": "assistant"}
GAP = np.array([[INSERT * len(BETWEEN[s, r]) if (s, r) in BETWEEN else NEVER for r in ROLES] for s in STATES])
CLOSE = np.array([INSERT * len(CLOSING[s]) for s in STATES])
#: Faults of a row, and roles by their initials (OTHER: none of the three).
FINE, BLANK, DUPLICATE, CUT, OTHER = 0, 1, 2, 3, 3
#: Cost of retaining a row of a role and fault as each of ROLES: the own role is kept, user and assistant can be given.
RETAIN = np.array([[[NEVER if f in (BLANK, DUPLICATE) or (r == 0 and own != 0) else (0 if r == own else REROLE) + TRUNCATED * (f == CUT) for r in range(3)] for f in range(4)] for own in range(4)])
#: What the edits file has for a row, in ASCII order of its letters.
EDITS = ("D", "IK", "IR", "K", "R")


def placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv_id, turn, role, text, pos: the place of each row in the order of conversation, turn, role and text, and part."""
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    spark = t.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(t.count() / PART_ROWS))
    # rows alike in all are spread by where they were read
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "at"]
    dealt = t.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = dealt.withColumn("pos", F.monotonically_increasing_id())
    return stored(numbered.select("conv_id", "turn", "role", "text", "pos", F.shiftright("pos", 33).cast("int").alias("part")))


def faults(rows: DataFrame) -> DataFrame:
    """part, conv_id, pos, turn, own (place of the role in ROLES, or OTHER) and fault of each row."""
    bare = F.rtrim("text", F.lit(BLANKS))
    own = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(OTHER)
    said = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.char_length("role"), "role", "text"), 256)
    slim = rows.select("part", "conv_id", "pos", "turn", own.cast("tinyint").alias("own"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.unhex(said).alias("said"))
    # minima are partial sums and the rest is a join, so that a text said very often is split like any skewed key
    first = slim.groupBy("said").agg(F.min("pos").alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    return stored(slim.join(first, "said").select("part", "conv_id", "pos", "turn", "own", fault.cast("tinyint").alias("fault")))


class Pieces:
    """The conversations' pieces of one part: rows in order, where each piece starts and how long it is."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pa.array(np.argsort(rows.column("pos").to_numpy())))
        self.rows, n = rows, len(rows)
        conv = rows.column("conv_id").combine_chunks()
        name = (conv if isinstance(conv, pa.Array) else conv.chunk(0)).dictionary_encode(null_encoding="encode").indices.to_numpy()
        self.own, self.fault = rows.column("own").to_numpy().astype(np.int64), rows.column("fault").to_numpy().astype(np.int64)
        self.start = np.flatnonzero(np.diff(name, prepend=name[0] - 1))
        self.n = np.diff(np.append(self.start, n))
        self.order = np.argsort(-self.n, kind="stable")
        self.deleted = DELETE * np.arange(n + 1, dtype=np.int64)  # prefix sums of deletions
        self.retain = RETAIN[self.own, self.fault]

    def minima(self, after: np.ndarray, each=None) -> np.ndarray:
        """Cheapest way from each state through a piece: after has, by piece and any number of ends, the cost of what follows
        each state. each(j, best) gets the costs from row j on of the pieces that have such a row.

        All pieces step back together, the longest first, so that one step is one operation on arrays.
        """
        end = (self.start + self.n)[self.order]
        run = self.deleted[end][:, None, None] + after[self.order]
        lengths = self.n[self.order]
        for step in range(int(lengths[0])):
            k = int(np.searchsorted(-lengths, -step, side="left"))  # pieces longer than step
            j = end[:k] - 1 - step
            rest = run[:k, :, 1:] - self.deleted[j + 1][:, None, None]
            through = self.deleted[j][:, None, None] + self.retain[j][:, None, :] + rest
            run[:k] = np.minimum(run[:k], (GAP[None, None] + through[:, :, None, :]).min(3))
            if each:
                each(j, run[:k] - self.deleted[j][:, None, None])
        out = np.zeros_like(after)
        out[self.order] = run - self.deleted[self.start[self.order]][:, None, None]
        return np.minimum(out, NEVER)

    def edits(self, after: np.ndarray, entries: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each state before a piece: the edit of every row (rows x states, places in EDITS), the state after the
        piece and the cost from its start; after: by piece, what follows each state."""
        n = len(self.own)
        best = np.empty((n, 4), np.int64)
        cost = self.minima(after[:, None, :], lambda j, b: best.__setitem__(j, b[:, 0]))[:, 0]
        made, state = np.zeros((n, entries), np.uint8), np.tile(np.arange(entries), (len(self.n), 1))
        last, lengths = self.start + self.n - 1, self.n[self.order]
        for step in range(int(lengths[0])):
            p = self.order[: int(np.searchsorted(-lengths, -step, side="left"))]
            j = self.start[p] + step
            rest = np.where((j == last[p])[:, None], after[p], best[np.minimum(j + 1, n - 1)])
            now = state[p]
            left = np.take_along_axis(best[j], now, 1)
            delete = np.take_along_axis(rest, now, 1) + DELETE == left
            gap = GAP[now]
            cheapest = gap + self.retain[j][:, None, :] + rest[:, None, 1:] == left[:, :, None]
            given = np.arange(3)[None, None] != self.own[j][:, None, None]
            rank = np.where(cheapest, np.where(gap > 0, 1, 3) + given, 9)
            role = rank.argmin(2)
            made[j] = np.where(delete, 0, np.take_along_axis(rank, role[:, :, None], 2)[:, :, 0])
            state[p] = np.where(delete, now, role + 1)
        return made, state, cost


def open_pieces(marked: DataFrame) -> DataFrame:
    """conv_id, part, through (16 costs, from each state to each) of the first and the last conversation of each part."""

    def price(key, rows):
        p = Pieces(rows)
        some = sorted({0, len(p.n) - 1})
        p.order = np.array([i for i in p.order.tolist() if i in some])
        ends = np.where(np.eye(4, dtype=bool), 0, NEVER)[None].repeat(len(p.n), 0)
        through = p.minima(ends)[some]
        return pa.table({"conv_id": p.rows.column("conv_id").take(pa.array(p.start[some])), "part": pa.array([key[0].as_py()] * len(some), pa.int32()), "through": [t.ravel().tolist() for t in through]}, schema=pa.schema([("conv_id", rows.schema.field("conv_id").type), ("part", pa.int32()), ("through", pa.list_(pa.int64()))]))

    kind = dict(marked.dtypes)["conv_id"]
    return marked.groupBy("part").applyInArrow(price, f"conv_id {kind}, part int, through array<long>")


def chained(pieces: DataFrame) -> DataFrame:
    """part, conv_id, first, last, after of each open piece: whether the conversation begins and ends in it, and what
    follows each state behind it. A conversation has a piece a part, so a group is bounded by the number of parts."""

    def chain(key, rows):
        order = np.argsort(rows.column("part").to_numpy())
        through, after, at = rows.column("through").to_pylist(), [], CLOSE
        for i in order[::-1].tolist():
            after.append(at.tolist())
            at = np.minimum((np.array(through[i]).reshape(4, 4) + at[:, None]).min(0), NEVER)
        n = len(order)
        return pa.table({"part": rows.column("part").take(pa.array(order)), "conv_id": rows.column("conv_id"), "first": [i == 0 for i in range(n)], "last": [i == n - 1 for i in range(n)], "after": after[::-1]})

    kind = dict(pieces.dtypes)["conv_id"]
    return pieces.groupBy("conv_id").applyInArrow(chain, f"part int, conv_id {kind}, first boolean, last boolean, after array<long>")


#: Figures of a piece, in this order: rows, blank, duplicate, truncated, illegal pairs, cost from its start, distinct turns.
FIGURES = ("n", "blank", "duplicate", "truncated", "illegal", "cost", "turns")


def solved(marked: DataFrame, links: DataFrame) -> DataFrame:
    """conv_id, part, pos (of the first row), edits (a byte a row, for each state before), exits (the state after), ends
    (own roles of the first and last row), low, high (turns) and figures of each piece."""
    kind = dict(marked.dtypes)["conv_id"]

    def solve(key, rows, links):
        p = Pieces(rows)
        n, after, first = len(p.n), CLOSE[None].repeat(len(p.n), 0), np.ones(len(p.n), bool)
        heads = p.rows.column("conv_id").take(pa.array(p.start)).to_pylist()
        for conv, is_first, behind in zip(links.column("conv_id").to_pylist(), links.column("first").to_pylist(), links.column("after").to_pylist()):
            at = 0 if heads[0] == conv else n - 1
            after[at], first[at] = behind, is_first
        made, state, cost = p.edits(after, 1 if first.all() else 4)
        pair = np.zeros(len(p.own), bool)  # su, ua and au may follow each other
        pair[1:] = ~np.isin(p.own[:-1] * 4 + p.own[1:], [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])
        pair[p.start] = False
        turn = p.rows.column("turn")
        known = turn.is_valid().to_numpy()
        value = turn.fill_null(0).to_numpy()
        new = known.copy()
        new[1:] &= ~known[:-1] | (value[1:] != value[:-1])
        new[p.start] = known[p.start]
        count = lambda x: np.add.reduceat(x.astype(np.int64), p.start)
        figures = np.stack([p.n, *(count(p.fault == f) for f in (BLANK, DUPLICATE, CUT)), count(pair), cost[:, 0], count(new)], axis=1)
        end = p.start + p.n
        low = [next(iter(value[a:b][known[a:b]].tolist()), None) for a, b in zip(p.start, end)]  # turns ascend, nulls first
        return pa.table({
            "conv_id": p.rows.column("conv_id").take(pa.array(p.start)), "part": pa.array([key[0].as_py()] * n, pa.int32()), "pos": p.rows.column("pos").take(pa.array(p.start)),
            "edits": pa.array([made[a:b, : 1 if f else 4].T.tobytes() for a, b, f in zip(p.start, end, first)], pa.binary()), "exits": pa.array(state[i, : 1 if f else 4].tolist() for i, f in enumerate(first)),
            "ends": pa.array([[int(p.own[a]), int(p.own[b - 1])] for a, b in zip(p.start, end)], pa.list_(pa.int64())), "low": pa.array(low, pa.int64()), "high": pa.array([int(value[b - 1]) if known[b - 1] else None for b in end], pa.int64()), "figures": pa.array(figures.tolist(), pa.list_(pa.int64())),
        })

    return marked.groupBy("part").cogroup(links.groupBy("part")).applyInArrow(solve, f"conv_id {kind}, part int, pos long, edits binary, exits array<long>, ends array<long>, low long, high long, figures array<long>")


def _in_order(rows: DataFrame, pieces: DataFrame, every: DataFrame) -> DataFrame:
    """Conversations, pieces and rows in one stream: each conversation, then each of its pieces before the piece's rows."""
    ids = every.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("pos"))
    heads, turns = pieces.withColumn("kind", F.lit(1)), rows.select("conv_id", "part", F.lit(2).alias("kind"), "pos", "role", "text")
    union = ids.unionByName(heads, True).unionByName(turns, True)
    return union.repartition("conv_id").sortWithinPartitions("conv_id", "part", "kind", "pos").select("conv_id", "kind", "role", "text", "edits", "exits", "ends", "low", "high", "figures")


class Reader:
    """Walks through the stream; says which turns stand in the repaired conversation and what its report is."""

    def __init__(self, conv):
        self.conv, self.state, self.audit = conv, "", []
        self.sums = dict.fromkeys((*FIGURES, "gaps"), 0)
        self.low = self.high = self.last = None
        self.left: Iterator[int] = iter(())

    def piece(self, edits: bytes, exits: list[int], ends: list[int], low, high, figures: list[int]) -> None:
        found = dict(zip(FIGURES, figures))
        if self.last is not None:
            found["cost"] = 0
            found["illegal"] += (self.last, ends[0]) not in ((0, 1), (1, 2), (2, 1))
            found["turns"] -= low is not None and low == self.high
        for k, v in found.items():
            self.sums[k] += v
        self.low = low if self.low is None else self.low
        self.high, self.last = self.high if high is None else high, ends[1]
        n, at = found["n"], STATES.index(self.state) if len(exits) > 1 else 0
        self.left = iter(edits[at * n : (at + 1) * n])

    def turn(self, role: str, text: str) -> list[tuple[str, str]]:
        """The turns that come of a row."""
        edit = EDITS[next(self.left)]
        self.audit.append(edit)
        if edit == "D":
            return []
        out = []
        if edit[0] == "I":  # only one role can stand in between, and then only one can follow
            between = "a" if self.state == "u" else "u"
            out.append((NAMES[between], ""))
            self.state = between
        if edit[-1] == "K":
            self.state = role[:1]
            return [*out, (role, text)]
        self.state = "a" if self.state == "u" else "u"
        return [*out, (NAMES[self.state], text)]

    def end(self) -> list[tuple[str, str]]:
        closing = CLOSING[self.state]
        self.audit.append("I" * len(closing))
        if self.low is not None:
            self.sums["gaps"] = self.high - self.low + 1 - self.sums["turns"]
        return [(NAMES[c], "") for c in closing]


def _walk(batches: Iterator[pa.RecordBatch], row, done) -> Iterator:
    """row(reader, turns) for each group of repaired turns, done(reader) after each conversation; yields after each batch."""
    reader = None
    for batch in batches:
        for conv, kind, role, text, *piece in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if reader:
                    row(reader, reader.end())
                    done(reader)
                reader = Reader(conv)
            elif kind == 1:
                reader.piece(*piece)
            else:
                row(reader, reader.turn(role, text))
        yield
    if reader:
        row(reader, reader.end())
        done(reader)
    yield


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Repair:
    """Conversations with their rows' faults found and the cheapest edits chosen.

    turns: any rows with a conversation, a number, a role and a text; null roles and texts are one space, null numbers come
    first, rows of one number go by role and text. every: conversations that shall have a result, also without rows.
    Null is a conversation like any other; an empty table has none. Columns beside the four named are not read.
    """

    def __init__(self, turns: DataFrame, every: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        self.rows = placed(turns, conv, turn, role, text)
        self.kind = dict(self.rows.dtypes)["conv_id"]
        marked = faults(self.rows)
        self.pieces = stored(solved(marked, stored(chained(stored(open_pieces(marked))))))
        self.every = (every if every is not None else turns).select(F.col(conv).alias("conv_id")).distinct()

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
        kind = _in_order(self.rows, self.pieces, self.every).schema["conv_id"].dataType

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            out, digest, lines = [], [hashlib.sha256()], [0]

            def row(reader, turns):
                for role, text in turns:
                    digest[0].update(f"{chr(10) if lines[0] else ''}{role}:{text}".encode())
                    lines[0] += 1

            def done(reader):
                out.append((reader.conv, *(reader.sums[k] for k in REPORT), "".join(reader.audit), digest[0].hexdigest()))
                digest[0], lines[0] = hashlib.sha256(), 0

            types = [to_arrow_type(kind), *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
            for _ in _walk(batches, row, done):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["conv_id", *REPORT, "audit", "repaired_sha256"])
                out.clear()

        return _in_order(self.rows, self.pieces, self.every).mapInArrow(read, f"conv_id {self.kind}, {', '.join(f'{k} long' for k in REPORT)}, audit string, repaired_sha256 string")

    def turns(self) -> DataFrame:
        """conv_id, place (from 0), role, text of the repaired conversations."""
        kind = _in_order(self.rows, self.pieces, self.every).schema["conv_id"].dataType

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            out, place = [], [0]

            def row(reader, turns):
                for role, text in turns:
                    out.append((reader.conv, place[0], role, text))
                    place[0] += 1

            for _ in _walk(batches, row, lambda reader: place.__setitem__(0, 0)):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((to_arrow_type(kind), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "place", "role", "text"])
                out.clear()

        return _in_order(self.rows, self.pieces, self.every).mapInArrow(read, f"conv_id {self.kind}, place long, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows with faults put in by a hash of conversation and turn: some are dropped, emptied,
    stripped of full stops, doubled or given to the user."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), code.alias("code")).where("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")
