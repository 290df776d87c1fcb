"""Removal of repeated byte strings by suffix arrays over the places where documents can agree.

Every string of `length` bytes holds a least anchor (the k-gram with the smallest hash), and equal strings hold the same.
Anchors of one document alone cannot repeat; the others are met by hash, each with the text around it that its strings
cover. The distinct texts around an anchor make a block; its suffix array, by linear grouping construction, brings equal
strings together, and each string learns the smallest document that it starts in. Blocks that are long because an anchor
is very common are first split by the text next to the anchor.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Powers, byte_column, mix, steps, stored
from riskweave.llm.common import _BYTE, _R, _R_INV
from riskweave.llm.suffix_groups import suffix_arrays

LENGTH, ANCHOR = 50, 32
#: Bytes that a task gathers before it hands anchors or texts on, and bytes of input for each group of a shuffle.
GATHER, PER_GROUP = 24 << 20, 4 << 20
#: Bits of the filter of repeated anchors at most, and for each anchor.
FILTER_BITS, BITS_EACH = 1 << 30, 16
#: Bytes of a block that is sorted as it is, and cells of a matrix of blocks.
BLOCK, CELLS = 1024, 1 << 19
NONE = (1 << 63) - 1  # a null doc_id counts as the largest


class Anchors:
    def __init__(self, length: int = LENGTH, anchor: int = ANCHOR):
        self.length, self.anchor, self.up, self.down = length, anchor, Powers(_R), Powers(_R_INV)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, anchor hash, anchor place, first and last string start of each run of strings with one least anchor.

        Places count from the start of data.
        """
        n, k, w = len(data), self.anchor, self.length - self.anchor + 1
        if n < self.length:
            return tuple(np.zeros(0, np.uint64 if c == 1 else np.int64) for c in range(5))
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * self.up.upto(n), out=total[1:])
        h = mix((total[k:] - total[:-k]) * self.down.upto(n)[: n - k + 1])
        # the place breaks ties of the upper bits, leftmost first, within any string alike
        low = np.uint64((1 << max(24, n.bit_length())) - 1)
        key = h & ~low | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        starts = n - self.length + 1
        key = np.minimum(key[:starts], key[w - size : w - size + starts])
        place = (key & low).astype(np.int64)
        # strings that reach into the next row don't count
        row = np.searchsorted(bounds, np.arange(starts), side="right") - 1
        inside = np.arange(starts) + self.length <= bounds[row + 1]
        place[~inside] = -1
        first = np.flatnonzero((np.diff(place, prepend=-2) != 0) & (place >= 0) | inside & (np.diff(row, prepend=-1) != 0))
        change = np.flatnonzero(np.diff(place, append=-2) != 0)
        turn = np.flatnonzero(np.diff(row, append=-1) != 0)
        ends = np.union1d(change, turn)
        last = ends[np.searchsorted(ends, first)]
        return row[first], mix(h[place[first]]), place[first], first, last  # mixed anew: least hashes are small ones


def spread(h: np.ndarray, groups: int) -> np.ndarray:
    return (h >> np.uint64(64 - int(math.log2(groups)))).astype(np.int64) if groups > 1 else np.zeros(len(h), np.int64)


def part_of(docs: np.ndarray, texts: np.ndarray, groups: int) -> np.ndarray:
    """The part of each (document, text hash)."""
    return spread(mix(texts ^ mix(docs.view(np.uint64))), groups)


def bloom_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(h & ~np.uint64(0xFFFFFFFF) | h >> np.uint64(32))
    return h & np.uint64(bits - 1), (h >> np.uint64(32) ^ h << np.uint64(7)) & np.uint64(bits - 1)


def repeated_anchors(docs: DataFrame, total: int, length: int, anchor: int) -> tuple[np.ndarray, int]:
    """A Bloom filter (bytes, bits) of the anchors that two documents at least have; by their upper 32 bits."""
    groups = 1 << max(3, math.ceil(math.log2(max(1, total / PER_GROUP / 4))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held, n = Anchors(length, anchor), [], 0

        def flush():
            every = np.sort(np.concatenate(held))
            ends = np.searchsorted(every, (np.arange(1, groups + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(groups))
            parts = [(g, p) for g, p in enumerate(np.split(every, ends[:-1])) if len(p)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in parts], pa.int32()), pa.array([np.diff(p, prepend=p.dtype.type(0)).astype("<u4").tobytes() for _, p in parts], pa.binary())], names=["part", "steps"])

        for batch in batches:
            data, bounds = byte_column(batch.column(1))
            for i, j in steps(bounds):
                row, h, _, _, _ = find(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                # once a document
                held.append((np.unique((h >> np.uint64(32)) | row.astype(np.uint64) << np.uint64(32)) & np.uint64(0xFFFFFFFF)))
                n += len(held[-1])
                if n >= GATHER // 4:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def twice(key, rows):
        every = np.sort(np.concatenate([np.cumsum(np.frombuffer(x, "<u4"), dtype=np.uint64).astype("<u4") for x in rows.column("steps").to_pylist()]))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        return pa.table({"n": [len(again)], "anchors": [again.tobytes()]}, schema=pa.schema([("n", pa.int64()), ("anchors", pa.binary())]))

    found = stored(docs.mapInArrow(gather, "part int, steps binary").groupBy("part").applyInArrow(twice, "n long, anchors binary"))
    n = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = min(FILTER_BITS, 1 << math.ceil(math.log2(max(1 << 16, BITS_EACH * n))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                at = np.unique(np.concatenate(bloom_places(np.frombuffer(x, "<u4").astype(np.uint64) << np.uint64(32), bits)))
                page, first = np.unique(at >> np.uint64(19), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(page.astype(np.int32)), pa.array([p.astype("<u4").tobytes() for p in np.split(at & np.uint64((1 << 19) - 1), first[1:])] if len(at) else [], pa.binary())], names=["page", "places"])

    def either(key, rows):
        page = np.zeros(min(bits, 1 << 19), dtype=bool)
        for x in rows.column("places").to_pylist():
            page[np.frombuffer(x, "<u4")] = True
        return pa.table({"page": [key[0].as_py()], "bits": [np.packbits(page, bitorder="little").tobytes()]}, schema=pa.schema([("page", pa.int32()), ("bits", pa.binary())]))

    bloom = np.zeros(bits // 8, dtype=np.uint8)
    marked = found.select("anchors").mapInArrow(mark, "page int, places binary").groupBy("page").applyInArrow(either, "page int, bits binary")
    for r in marked.toLocalIterator():  # FILTER_BITS at most
        page = np.frombuffer(r["bits"], np.uint8)
        bloom[r["page"] << 16 : (r["page"] << 16) + len(page)] = page
    return bloom, bits


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ranges, one after another."""
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))


def least_documents(texts: list[bytes], docs: list[int], length: int) -> list[np.ndarray]:
    """For each distinct text of one block, the smallest document of each of its strings of `length` bytes."""
    return blocks_solved([(texts, docs)], length)[0]


def blocks_solved(blocks: list[tuple[list[bytes], list[int]]], length: int) -> list[list[np.ndarray]]:
    """least_documents of many blocks, sorted together in matrices of blocks of like size."""
    solved: list = [None] * len(blocks)
    sizes = [sum(map(len, t)) + len(t) for t, _ in blocks]
    order = sorted(range(len(blocks)), key=sizes.__getitem__)
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and sizes[order[end]] * (end + 1 - at) <= CELLS:
            end += 1
        some = order[at:end]
        at = end
        m = sizes[some[-1]]
        joined = [b"\0".join(x.replace(b"\0", b"\xff") for x in blocks[b][0]) for b in some]  # \xff is in no UTF-8 text
        t = np.frombuffer(b"".join(x.ljust(m, b"\0") for x in joined), np.uint8).reshape(len(some), m)
        sa = suffix_arrays(t)
        # where strings of full length start, and their documents
        doc = np.full(t.shape, NONE, dtype=np.int64)
        full = np.zeros(t.shape, dtype=bool)
        for r, b in enumerate(some):
            p = 0
            for x, d in zip(*blocks[b]):
                full[r, p : p + len(x) - length + 1] = True
                doc[r, p : p + len(x) - length + 1] = d
                p += len(x) + 1
        r, k = np.nonzero(np.take_along_axis(full, sa, 1))
        s = sa[r, k]
        flat = t.reshape(-1)
        view = np.lib.stride_tricks.sliding_window_view(flat, length)
        place = r.astype(np.int64) * m + s
        new = np.ones(len(r), dtype=bool)
        for c in range(1, len(r), 1 << 16):
            e = min(len(r), c + (1 << 16))
            new[c:e] = (r[c:e] != r[c - 1 : e - 1]) | (view[place[c:e]] != view[place[c - 1 : e - 1]]).any(1)
        firsts = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(doc[r, s], firsts), np.diff(np.append(firsts, len(r)))) if len(r) else np.zeros(0, np.int64)
        doc[r, s] = least
        for row, b in enumerate(some):
            p, out = 0, []
            for x in blocks[b][0]:
                out.append(doc[row, p : p + len(x) - length + 1].copy())
                p += len(x) + 1
            solved[b] = out
    return solved


def split(texts: list[bytes], docs: list[int], at: list[int], core: int, length: int, numbers: list[tuple[int, int]], out: list) -> None:
    """Split a long block by the text next to its core (at `at`, `core` bytes): first that on the right, then on the left.

    Appends (texts, docs, where each belongs: its text's number and its first string's) of blocks that are short enough, or
    whose core is a whole string.
    """
    if sum(map(len, texts)) + len(texts) <= BLOCK or core >= length or len(texts) < 2:
        out.append((texts, docs, numbers))
        return
    half = -(-(length - core) // 2)
    right: dict[bytes, tuple] = {}
    left: dict[bytes, tuple] = {}
    for x, d, p, (number, first) in zip(texts, docs, at, numbers):
        # strings that hold `half` bytes right of the core start at `turn` or later
        turn = min(max(0, p + core + half - length), len(x) - length + 1)
        if turn <= len(x) - length and p + core + half <= len(x):
            g = right.setdefault(x[p + core : p + core + half], ([], [], [], []))
            for column, value in zip(g, (x[turn:], d, p - turn, (number, first + turn))):
                column.append(value)
        else:
            turn = len(x) - length + 1
        if turn > 0:
            y = x[: turn - 1 + length]
            more = length - core - half + 1  # bytes left of the core that all these strings hold
            g = left.setdefault(y[p - more : p], ([], [], [], []))
            for column, value in zip(g, (y, d, p - more, (number, first))):
                column.append(value)
    for g in right.values():
        split(g[0], g[1], g[2], core + half, length, g[3], out)
    for g in left.values():
        split(g[0], g[1], g[2], core + length - core - half + 1, length, g[3], out)


SEGMENTS = "part int, anchors binary, docs binary, texts_of binary, starts binary, ats binary, lengths binary, bytes binary"


def removals(docs: DataFrame, total: int, length: int, anchor: int) -> DataFrame:
    """part, docs, texts_of, starts, ends, packed: byte ranges that each document (id and text hash) loses, dealt by document and text hash."""
    bloom, bits = repeated_anchors(docs, total, length, anchor)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)
    groups = 1 << max(3, math.ceil(math.log2(max(1, total / PER_GROUP))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, bloom = Anchors(length, anchor), shared.value
        held, n = [], 0

        def flush():
            h, doc, of, start, at, size = (np.concatenate([x[c] for x in held]) for c in range(6))
            text = np.concatenate([x[6] for x in held])
            part = spread(h, groups)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(1, groups))
            begin = np.cumsum(size) - size
            rows = []
            for g, some in enumerate(np.split(order, ends)):
                if len(some):
                    rows.append((g, h[some].tobytes(), doc[some].tobytes(), of[some].tobytes(), start[some].tobytes(), at[some].astype("<u2").tobytes(), size[some].astype("<u2").tobytes(), text[ragged(begin[some], size[some])].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 7))], names=[x.split()[0] for x in SEGMENTS.split(", ")])

        for batch in batches:
            ids = batch.column(0).fill_null(NONE).to_numpy()
            data, bounds = byte_column(batch.column(1))
            for i, j in steps(bounds):
                part, b = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
                row, h, place, first, last = find(part, b)
                there = np.ones(len(h), dtype=bool)
                for at in bloom_places(h & ~np.uint64(0xFFFFFFFF), bits):
                    there &= (bloom[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                row, h, place, first, last = row[there], h[there], place[there], first[there], last[there]
                if not len(row):
                    continue
                of = np.array([xxhash.xxh3_64_intdigest(part[b[k] : b[k + 1]]) for k in range(j - i)], dtype=np.uint64)
                size = last - first + length
                held.append((h, ids[i:j][row], of[row], (first - b[row]).astype(np.int64), place - first, size, part[ragged(first, size)]))
                n += int(size.sum())
                if n >= GATHER:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def meet(key, rows):
        out = {"part": [], "docs": [], "texts_of": [], "starts": [], "ends": []}
        schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("docs", "texts_of", "starts", "ends"))])
        column = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()])
        h, doc, of, start, at, size = column("anchors", "<u8"), column("docs", "<i8"), column("texts_of", "<u8"), column("starts", "<i8"), column("ats", "<u2").astype(np.int64), column("lengths", "<u2").astype(np.int64)
        text = b"".join(rows.column("bytes").to_pylist())
        begin = np.cumsum(size) - size
        order = np.lexsort((doc, h))
        edge = np.flatnonzero(np.diff(h[order], prepend=h[order[:1]] ^ np.uint64(1)))
        edge = np.append(edge, len(order))
        several = np.flatnonzero((np.diff(edge) > 1) & (doc[order[edge[:-1]]] != doc[order[edge[1:] - 1]]))
        blocks, places = [], []
        sizes, least, uses, times = [], [], [], []  # per distinct text of an anchor: its strings, their smallest document, occurrences
        begins, stops, ats, ids = begin.tolist(), (begin + size).tolist(), at.tolist(), doc.tolist()
        for a, b in zip(edge[several].tolist(), edge[several + 1].tolist()):
            distinct: dict[tuple[bytes, int], list[int]] = {}
            for k in order[a:b].tolist():
                distinct.setdefault((text[begins[k] : stops[k]], ats[k]), []).append(k)
            base = len(sizes)
            for (x, _), ks in distinct.items():
                sizes.append(len(x) - length + 1)
                uses += ks
                times.append(len(ks))
            if len(distinct) == 1:
                least.append(ids[uses[-times[-1]]])  # occurrences come by document
                continue
            least += [NONE] * len(distinct)
            pieces: list = []
            split([x for x, _ in distinct], [ids[ks[0]] for ks in distinct.values()], [p for _, p in distinct], anchor, length, [(base + i, 0) for i in range(len(distinct))], pieces)
            for texts, ds, numbers in pieces:
                blocks.append((texts, ds))
                places.append(numbers)
        if not sizes:
            return pa.table(out, schema=schema)
        sizes, times = np.array(sizes), np.array(times)
        base = np.cumsum(sizes) - sizes
        smallest = np.repeat(np.array(least, dtype=np.int64), sizes)
        alike = [len(set(texts)) == 1 for texts, _ in blocks]
        for (texts, ds), numbers, one in zip(blocks, places, alike):
            if one:
                n, d = len(texts[0]) - length + 1, min(ds)
                for number, first in numbers:
                    here = smallest[base[number] + first : base[number] + first + n]
                    np.minimum(here, d, out=here)
        some = [i for i, one in enumerate(alike) if not one]
        for i, solved in zip(some, blocks_solved([blocks[i] for i in some], length)):
            for found, (number, first) in zip(solved, places[i]):
                here = smallest[base[number] + first : base[number] + first + len(found)]
                np.minimum(here, found, out=here)
        # of every occurrence, runs of lost strings as byte ranges
        k, of_text = np.array(uses), np.repeat(np.arange(len(sizes)), times)
        strings = sizes[of_text]
        at_row = np.cumsum(strings) - strings
        lost = smallest[ragged(base[of_text], strings)] < np.repeat(doc[k], strings)
        begins_row, ends_row = np.zeros(len(lost), dtype=bool), np.zeros(len(lost), dtype=bool)
        begins_row[at_row], ends_row[at_row + strings - 1] = True, True
        begins_row[1:] |= ~lost[:-1]
        ends_row[:-1] |= ~lost[1:]
        a, b = np.flatnonzero(lost & begins_row), np.flatnonzero(lost & ends_row)
        r = np.searchsorted(at_row, a, side="right") - 1
        doc, of, end, start = doc[k[r]], of[k[r]], start[k[r]] + b - at_row[r] + length, start[k[r]] + a - at_row[r]
        part = part_of(doc, of, groups)
        order = np.lexsort((start, doc, of, part))
        ends = np.searchsorted(part[order], np.arange(1, groups))
        for g, some in enumerate(np.split(order, ends)):
            if len(some):
                for c, v in zip(out, (g, doc[some].tobytes(), of[some].tobytes(), start[some].astype("<i8").tobytes(), end[some].astype("<i8").tobytes())):
                    out[c].append(v)
        return pa.table(out, schema=schema)

    return docs.mapInArrow(gather, SEGMENTS).groupBy("part").applyInArrow(meet, "part int, docs binary, texts_of binary, starts binary, ends binary")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_TYPES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) of every document.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id; strings are
    judged on the input. Null texts count as empty and lose nothing; a null id counts as the largest; rows with one id are
    one document's, so they take nothing from each other. An empty table gives no rows. Only id and text are read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups = 1 << max(3, math.ceil(math.log2(max(1, total / PER_GROUP))))
    lost = stored(removals(d, total, length, anchor))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = [xxhash.xxh3_64_intdigest(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column(0).fill_null(NONE).to_numpy(), np.array(of, np.uint64), groups), pa.int32()), pa.array(np.array(of, np.uint64).view(np.int64)), batch.column(0), batch.column(1)], names=["part", "of", "doc_id", "text"])

    def cut(key, rows, ranges):
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in ranges.to_pylist():
            for doc, of, a, b in zip(*(np.frombuffer(r[c], t).tolist() for c, t in (("docs", "<i8"), ("texts_of", "<u8"), ("starts", "<i8"), ("ends", "<i8")))):
                spans.setdefault((doc, of), []).append((a, b))
        out = []
        for doc_id, of, text in zip(rows.column("doc_id").to_pylist(), rows.column("of").to_pylist(), rows.column("text").to_pylist()):
            text = text or b""
            kept, last, gone, runs = [], 0, 0, 0
            for a, b in sorted(spans.get((NONE if doc_id is None else doc_id, of & (1 << 64) - 1), [])):
                if a > last or not runs:
                    runs += 1
                    kept.append(text[last:a])
                    gone += b - a
                    last = b
                elif b > last:
                    gone += b - last
                    last = b
            kept = b"".join([*kept, text[last:]])
            out.append((doc_id, len(text), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out) if out else [[]] * 6, _TYPES)], schema=_TYPES)

    dealt = d.mapInArrow(deal, "part int, of long, doc_id long, text binary")
    return dealt.groupBy("part").cogroup(lost.groupBy("part")).applyInArrow(cut, RESULT)
