"""Best-fit packing into sequences of fixed length by minimum bin slack.

Texts become token pieces of at most `capacity` where they are read. Which lengths go together is decided on the table of
piece lengths alone (at most `capacity` rows for any corpus): per bin, a bitset subset-sum over the lengths that are left
finds the fullest combination with the longest one, and the combination is taken as often as its lengths allow. Pieces
then find their places by rank within their length, counted per (length, salt), so no length meets in one task.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import WordHasher, byte_column, per_worker, steps, stored

CAPACITY = 4096
END_ID = 1
#: Words, and stems of new words, whose ids a worker remembers; beyond it the memory starts anew. Long words are never kept.
CACHE_WORDS, CACHE_STEMS, CACHE_LENGTH = 2_000_000, 150_000, 48
#: Rows that one part of a length should have when it is ranked, and parts of each length at most (8 bytes each in the
#: broadcast table of first ranks).
PER_PART, SALTS = 1 << 16, 1 << 11
#: Punctuation that the tokenizer always splits from a word before it.
TAIL = b".,!?*#%&$|;:"
#: Bytes of words that are encoded as they stand: of special tokens, and that lead marks (U+0300 to U+036F).
ODD = np.zeros(256, dtype=np.int64)
ODD[[0x3C, 0xCC, 0xCD]] = 1


def ends_in_letter(stem: bytes) -> bool:
    """Whether the last character of a word is letters alone after the tokenizer's normalisation, so that punctuation after it is split off."""
    if not stem or stem[-1] < 128:
        return stem[-1:].isalnum()
    return unicodedata.normalize("NFC", stem.decode()[-1]).lower().isalpha()


class WordMemory:
    """Ids of words by two hashes of theirs, as arrays: some 35 bytes a word."""

    def __init__(self):
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Entry of each word, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == keys) & (self.checks[at] == checks), at, -1)

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> None:
        """New words, by ascending key. A word with the key of another takes no place beside it."""
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.__init__()
        at = np.searchsorted(self.keys, keys)
        free = (at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), bool)
        keys, checks, ids = keys[free], checks[free], [x for x, f in zip(ids, free.tolist()) if f]
        length = np.array([len(x) // 4 for x in ids], np.int32)
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, (np.cumsum(length) - length + len(self.ids)).astype(np.int32))
        self.length, self.keys, self.checks = np.insert(self.length, at, length), np.insert(self.keys, at, keys), np.insert(self.checks, at, checks)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])


class WordTokens:
    """A text's ids as bytes (little-endian uint32), joined from those of its white-space-separated words.

    The tokenizer drops white space and never joins across it, lower-cases, and splits punctuation from letters; so words
    are encoded once and remembered, without their case. Words that may hold a special token, or letters and marks that are
    composed before they are lower-cased, are encoded as they stand, and so are very long ones.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.memory, self.stems = Tokenizer.from_file(path), WordMemory(), {}
        self.hashers = WordHasher(), WordHasher(0xC2B2AE3D27D4EB4F)
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, dtype=bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def encode(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words without oddities, put together from a stem and its punctuation."""
        if len(self.stems) > CACHE_STEMS:
            self.stems.clear()
        split = []
        for word in words:
            low = word.lower()
            stem = low.rstrip(TAIL)
            split.append((stem, low[len(stem) :]) if ends_in_letter(stem) else (low, b""))
        stems = self.stems
        new = {x for parts in split for x in parts if x and x not in stems}
        letters = [x for x in new if x.decode().isalpha()]
        if letters:  # each is one word to the tokenizer, and its last id ends a word
            ids = np.array(self.tokenizer.encode(b" ".join(letters).decode(), add_special_tokens=False).ids, dtype="<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) == len(letters):
                ids = ids.tobytes()
                stems.update(zip(letters, map(ids.__getitem__, map(slice, [0, *ends], ends))))
        for x in [x for x in new if x not in stems]:
            stems[x] = self.encode(x)
        return [stems[a] + stems[b] if b and a else stems[a or b] for a, b in split]

    def texts(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a column."""
        data, bounds = byte_column(column)
        for i, j in steps(bounds):
            part, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            keys, of = self.hashers[0](part, at)
            starts, ends = self.hashers[0].starts, self.hashers[0].ends
            checks = self.hashers[1](part, at)[0]
            marks = np.concatenate([[0], np.cumsum(ODD[part])])
            odd = (marks[ends] > marks[starts]) | (ends - starts > CACHE_LENGTH)
            usual = np.flatnonzero(~odd)
            distinct, first, inverse = np.unique(keys[usual], return_index=True, return_inverse=True)
            same = checks[usual[first]][inverse] == checks[usual] if len(usual) else np.zeros(0, bool)
            odd[usual[~same]] = True  # another word with the same key
            first, usual, inverse = usual[first], usual[same], inverse[same]
            entry = self.memory.find(distinct, checks[first])
            missed = np.flatnonzero(entry < 0)
            if len(missed):
                text = part.tobytes()
                found = self.learn([text[a:b] for a, b in zip(starts[first[missed]].tolist(), ends[first[missed]].tolist())])
                self.memory.add(distinct[missed], checks[first[missed]], found)
                entry = self.memory.find(distinct, checks[first])
            start, length = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            start[usual], length[usual] = self.memory.start[entry[inverse]], self.memory.length[entry[inverse]]
            ids = self.memory.ids
            odd[usual[entry[inverse] < 0]] = True
            lone = np.flatnonzero(odd).tolist()
            if lone:
                text = part.tobytes()
                own = [self.encode(text[starts[w] : ends[w]]) for w in lone]
                size = np.array([len(x) // 4 for x in own])
                start[lone], length[lone] = len(ids) + np.cumsum(size) - size, size
                ids = np.concatenate([ids, np.frombuffer(b"".join(own), "<u4")])
            upto = np.concatenate([[0], np.cumsum(length)])
            whole = ids[np.repeat(start - upto[:-1], length) + np.arange(upto[-1])].tobytes()
            cut = (4 * upto[of]).tolist()
            yield from (whole[a:b] for a, b in zip(cut, cut[1:]))

    def __call__(self, text: bytes) -> bytes:
        return next(self.texts(pa.array([text], pa.large_binary())))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, an array, on request) for every piece of every text and its end id."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = per_worker(f"tokens of {tokenizer_path}", lambda: WordTokens(tokenizer_path))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * with_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.texts(batch.column(1))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *[np.frombuffer(part, "<u4").astype("int64")] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES + (", ids array<long>" if with_ids else ""))


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of the fullest combination of at most `room`, by subset sums kept as bits of an integer.

    Each length is offered as often as it is there and fits, in groups of doubling size. The longest lengths come first,
    and the search stops once the room can be filled exactly.
    """
    mask, reached, taken = (1 << room + 1) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, group = min(counts[length], room // length), 1
        while left > 0:
            now = min(group, left)
            grown = reached | (reached << length * now) & mask
            taken.append((length, now, reached))
            reached, left, group = grown, left - now, group * 2
            if reached >> room & 1:
                left = 0
        if reached >> room & 1:
            break
    at, found = reached.bit_length() - 1, {}
    for length, now, before in reversed(taken):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + now
            at -= length * now
    return list(found.items())


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, times), ...]) until no piece is left; each uses up one length at least, so there are few."""
    counts, lengths, found = {k: v for k, v in counts.items() if v > 0}, sorted((k for k, v in counts.items() if v > 0), reverse=True), []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        combo = dict(fullest(lengths, counts, capacity - seed))
        counts[seed] += 1
        combo[seed] = combo.get(seed, 0) + 1
        bins = min(counts[k] // n for k, n in combo.items())
        for k, n in combo.items():
            counts[k] -= bins * n
        found.append((bins, sorted(combo.items(), reverse=True)))
        lengths = [k for k in lengths if counts[k] > 0]
    return found


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, first sequence, pieces per sequence, offset of the first), ordered by rank."""
    ranks: dict[int, int] = {}
    rows: dict[int, list] = {}
    first = 0
    for bins, combo in found:
        offset = 0
        for length, n in combo:
            rank = ranks.get(length, 0)
            rows.setdefault(length, []).append((rank, first, n, offset))
            ranks[length], offset = rank + bins * n, offset + n * length
        first += bins
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request) for every piece.

    A null or empty text is one piece with the end id alone. A long text is cut into pieces of `capacity`; its last piece
    may be shorter. Rows that repeat an id are packed each, in any order among themselves. An empty table gives no rows.
    Only the id and the text are read, so other columns may have any names.
    """
    return place(stored(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids)), capacity)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a stored table of pieces."""
    salts = min(SALTS, max(1, math.ceil(cut.count() / PER_PART)))
    salted = cut.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    base = np.zeros((capacity + 1, salts), dtype=np.int64)
    for r in salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():  # at most capacity * salts rows
        base[r["length"], r["__salt"]] = r["n"]
    counts = {length: int(n) for length, n in enumerate(base.sum(1)) if n}
    base = np.cumsum(base, axis=1) - base
    slots = cut.sparkSession.sparkContext.broadcast((base, places(patterns(counts, capacity))))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, table = slots.value
        for batch in batches:
            length, salt, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "__salt", "__rank"))
            rank = rank - 1 + base[length, salt]
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                rows = table[int(length[part[0]])]
                row = rows[np.searchsorted(rows[:, 0], rank[part], side="right") - 1]
                into = rank[part] - row[:, 0]
                sequence[part] = row[:, 1] + into // row[:, 2]
                offset[part] = row[:, 3] + into % row[:, 2] * length[part]
            names = [n for n in batch.schema.names if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")))
    fields = ", ".join(f"{n} {t}" for n, t in cut.dtypes)
    return ranked.mapInArrow(seat, f"{fields}, sequence_id long, offset long")
