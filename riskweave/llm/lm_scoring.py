"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and word pairs of every training text are merged by hash range. A pair or word with count c enters the
filter once for each level 1..1+floor(log_b c); the filter is broadcast, and a count is read back by probing levels until
one is absent. A text's probability interpolates pair and word probabilities from such probes. Where not all entries fit
the broadcast, it holds the words and pairs of the highest levels. A training text's own words and pairs occur, so that
one that the filter lacks is at the level below, if there is but one; other tokens it cannot decide travel by hash range to
filters of the lower levels, so that every word and pair counts at any size. The exact base score takes frequent words from a bounded
broadcast and all others from a join by hash range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import WordHasher, byte_column, crc_mod, mix, steps, stored

#: Bits of the broadcast filter at most (what does not fit is looked up in the stored counts), bits for each entry, hash functions, ratio of counts between levels.
FILTER_BITS, ENTRY_BITS, PROBES, LEVEL = 1 << 29, 12, 3, 1.5
#: Weight of the pair model against the word model.
PAIR_WEIGHT = 0.25
#: Words with this count are frequent, unless more than FREQUENT_WORDS are (then the count that leaves so many).
FREQUENT_COUNT, FREQUENT_WORDS = 8, 1 << 20
#: Tokens that a task gathers before it hands counts on, and tokens for each group of the merging shuffle.
GATHER, PER_GROUP = 750_000, 500_000
#: Bytes of text that are scored at a time (one longer text is taken alone).
SCORED_BYTES = 1 << 18
#: Level of a word or pair that the filter cannot decide, and the bytes of one such token: key, word, before, pair, levels.
OPEN, RECORD = 255, 35

END = np.uint64(0x51ED270B7A4E1F35)


def with_ends(hasher: WordHasher, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text and one end, as hashes, and the texts' bounds in them."""
    h, at = hasher(data, bounds)
    rows = len(at) - 1
    out = np.full(len(h) + rows, END, dtype=np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(at))] = h
    return out, at + np.arange(rows + 1)


def pairs_of(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each token and the one before it; an end stands before each text."""
    before = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
    before[at[:-1]] = END
    return mix(before * np.uint64(0x9E3779B97F4A7C15) ^ (tokens + np.uint64(0x632BE59BD9B4E019)))


def parts_of(hashes: np.ndarray, groups: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - int(math.log2(groups)))).astype(np.int64) if groups > 1 else np.zeros(len(hashes), np.int64)


def tallied(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and their summed counts."""
    if counts is None:
        return np.unique(hashes, return_counts=True)
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def planes(keys: np.ndarray) -> bytes:
    """Keys as all their lowest bytes, then all their next ones: neighbours differ in the lowest alone, the rest compresses."""
    return np.ascontiguousarray(keys.astype("<i8").view("u1").reshape(-1, 8).T).tobytes()


def keys_of(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, "u1").reshape(8, -1).T).view("<i8").ravel()


def rising(hashes: np.ndarray) -> bytes:
    """Ascending hashes by their differences, whose highest bytes are 0."""
    return planes(np.diff(hashes, prepend=np.zeros(1, np.uint64)))


def hashes_of(data: bytes) -> np.ndarray:
    return np.cumsum(keys_of(data).view("<u8"), dtype=np.uint64)


def counts_table(training: DataFrame, groups: int) -> DataFrame:
    """part, words, word_counts, pairs, pair_counts: exact counts by hash range, packed."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = WordHasher(), [], 0

        def flush():
            for kind in (0, 1):
                hashes, counts = tallied(np.concatenate([x[kind] for x in held]))
                ends = np.searchsorted(parts_of(hashes, groups), np.arange(1, groups))
                cut = [(g, h, c) for g, (h, c) in enumerate(zip(np.split(hashes, ends), np.split(counts, ends))) if len(h)]
                # those that occur once go without their counts
                rows = [(g, kind, rising(h[c == 1]), rising(h[c > 1]), c[c > 1].astype("<i8").tobytes()) for g, h, c in cut]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "kind", "once", "more", "counts"])

        for batch in batches:
            data, bounds = byte_column(batch.column(0))
            for i, j in steps(bounds):
                tokens, at = with_ends(hasher, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                held.append((tokens, pairs_of(tokens, at)))
                n += len(tokens)
                if n >= GATHER:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def merge(key, rows):
        out = {"part": [key[0].as_py()]}
        for kind, name in ((0, "word"), (1, "pair")):
            of = [r for r in rows.to_pylist() if r["kind"] == kind]
            once = [hashes_of(r["once"]) for r in of]
            more, counts = [hashes_of(r["more"]) for r in of], [np.frombuffer(r["counts"], "<i8") for r in of]
            hashes, n = tallied(np.concatenate([np.zeros(0, "<u8"), *once, *more]), np.concatenate([np.zeros(0, "<i8"), *(np.ones(len(x), "<i8") for x in once), *counts]))
            out[f"{name}s"], out[f"{name}_counts"] = [rising(hashes)], [n.astype("<i8").tobytes()]
        return pa.table(out, schema=pa.schema([("part", pa.int32()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())]))

    gathered = training.mapInArrow(gather, "part int, kind int, once binary, more binary, counts binary")
    return gathered.groupBy("part").applyInArrow(merge, "part int, words binary, word_counts binary, pairs binary, pair_counts binary")


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(LEVEL) + 1e-9).astype(np.int64)


#: Expected count at each level, the middle of the counts that share it; level 0 is absent.
EXPECTED = np.array([0.0, *(max(1.0, (LEVEL ** (q - 1) + LEVEL**q - 1) / 2) for q in range(1, 110))])


class LogBloom:
    """One bit array; every hash range has a segment of its own, so that segments are built apart."""

    def __init__(self, groups: int, segment: int, bits: np.ndarray):
        self.groups, self.segment, self.bits = groups, segment, bits

    @staticmethod
    def places(hashes: np.ndarray, level: int, segment: int) -> list[np.ndarray]:
        h = mix(hashes ^ np.uint64(level * 0x2545F4914F6CDD1D & (1 << 64) - 1))
        step = h >> np.uint64(32) | np.uint64(1)
        return [(h + np.uint64(k) * step) & np.uint64(segment - 1) for k in range(PROBES)]

    @staticmethod
    def build(hashes: np.ndarray, counts: np.ndarray, segment: int) -> bytes:
        bits = np.zeros(segment, dtype=bool)
        top = levels(counts) if len(counts) else counts
        for level in range(1, int(top.max(initial=0)) + 1):
            for at in LogBloom.places(hashes[top >= level], level, segment):
                bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each hash: probes from 1 on until one is absent."""
        found = np.zeros(len(hashes), dtype=np.int64)
        base = parts_of(hashes, self.groups).astype(np.uint64) * np.uint64(self.segment)
        left = np.arange(len(hashes))
        for level in range(1, len(EXPECTED)):
            there = np.ones(len(left), dtype=bool)
            for at in self.places(hashes[left], level, self.segment):
                at = at + base[left]
                there &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            left = left[there]
            if not len(left):
                break
            found[left] = level
        return found

    def levels_from(self, hashes: np.ndarray, least: int) -> np.ndarray:
        """Levels, looked up once for each distinct hash; OPEN where only entries from level `least` on are here."""
        distinct, back = np.unique(hashes, return_inverse=True)
        found = self.level(distinct)
        return np.where(found < least, 0 if least == 1 else OPEN, found)[back].astype(np.uint8)


def log_probability(word: np.ndarray, before: np.ndarray, pair: np.ndarray, floor: float) -> np.ndarray:
    """log10 of the interpolated probability, from levels."""
    word, before, pair = EXPECTED[word], EXPECTED[before], EXPECTED[pair]
    return np.log10(PAIR_WEIGHT * np.minimum(pair, before) / np.maximum(before, 1.0) + (1 - PAIR_WEIGHT) * (word + 0.5) / floor)


def settled(word: np.ndarray, before: np.ndarray, pair: np.ndarray) -> None:
    """A pair with an unseen word is unseen, in place; without the pair the word before it does not matter."""
    pair[(word == 0) | (before == 0)] = 0
    before[(before == OPEN) & (pair == 0)] = 0


def packed(fields: list[np.ndarray], of: slice | np.ndarray) -> bytes:
    return b"".join(planes(x[of]) if x.itemsize == 8 else x[of].tobytes() for x in fields)


def unpacked(data: bytes) -> list[np.ndarray]:
    """key, word, before, pair and their three levels of the tokens in `data`."""
    n = len(data) // RECORD
    long, short = ([data[at * n : (at + size) * n] for at in places] for size, places in ((8, (0, 8, 16, 24)), (1, (32, 33, 34))))
    return [keys_of(long[0]), *(keys_of(x).view("<u8") for x in long[1:]), *(np.frombuffer(x, "u1").copy() for x in short)]


def dispatched(fields: list[np.ndarray], groups: int, floor: float) -> pa.RecordBatch:
    """Tokens by what they lack first (stage 0 word, 1 word before, 2 pair) and its hash range; sums by key of those that lack nothing (stage 3)."""
    key, hashes, at = fields[0], fields[1:4], fields[4:]
    stage = np.select([x == OPEN for x in at], [0, 1, 2], 3)
    out = []
    for s in range(3):
        of = np.flatnonzero(stage == s)
        part = parts_of(hashes[s][of], groups)
        order = np.argsort(part, kind="stable")
        ends = np.searchsorted(part[order], np.arange(1, groups))
        out += [(s, g, packed(fields, x)) for g, x in enumerate(np.split(of[order], ends)) if len(x)]
    done = stage == 3
    if done.any():
        distinct, back = np.unique(key[done], return_inverse=True)
        p = np.bincount(back, weights=log_probability(*(x[done] for x in at), floor))
        out.append((3, 0, distinct.tobytes() + p.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.int32(), pa.binary()))], names=["stage", "part", "data"])


def open_scores(scored: DataFrame, table: DataFrame, groups: int, floor: float, least_word: int, least_pair: int) -> DataFrame:
    """key and the summed log10 probability of the tokens that the filter left open, from the stored counts.

    Entries of the least levels and above are in the broadcast filter, which never leaves them open. Those below make a
    filter of their own for each hash range, of the same kind, and meet there the tokens that ask.
    """
    words_too = least_word > 1
    schema = "stage int, part int, data binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, x) for k, x in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                n = [len(x) // (RECORD - 8) for _, x in rows]
                each = [unpacked(planes(np.full(m, k)) + x) for (k, x), m in zip(rows, n)]
                yield dispatched([np.concatenate(x) for x in zip(*each)], groups, floor)

    def visit(stage: int):
        name, least = ("pair", least_pair) if stage == 2 else ("word", least_word)

        def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    hashes, counts = hashes_of(r["hashes"]), np.frombuffer(r["counts"], "<i8")
                    at = levels(counts) if len(counts) else counts
                    segment = 1 << math.ceil(math.log2(max(64, ENTRY_BITS * int(at[at < least].sum()))))
                    yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([LogBloom.build(hashes[at < least], counts[at < least], segment)], pa.binary())], names=["part", "bits"])

        def look_up(key, rows, known):
            held = [unpacked(x) for x in rows.column("data").to_pylist()]
            if not held:
                return pa.Table.from_batches([dispatched(unpacked(b""), groups, floor)])
            fields = [np.concatenate(x) for x in zip(*held)]
            asked, back = np.unique(fields[1 + stage], return_inverse=True)
            found = np.zeros(len(asked), np.uint8)
            for bits in known.column("bits").to_pylist():  # one, or none where nothing is known
                found = LogBloom(1, 8 * len(bits), np.frombuffer(bits, "u1")).level(asked).astype(np.uint8)
            found = found[back]
            fields[4 + stage] = found
            settled(*fields[4:])
            return pa.Table.from_batches([dispatched(fields, groups, floor)])

        known = table.select("part", F.col(f"{name}s").alias("hashes"), F.col(f"{name}_counts").alias("counts"))
        return look_up, known.mapInArrow(below, "part int, bits binary")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [(x[: len(x) // 2], x[len(x) // 2 :]) for x in batch.column(0).to_pylist()]
            keys, p = b"".join(a for a, _ in both), b"".join(b for _, b in both)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(p, "<f8"))], names=["key", "p"])

    rows = scored.where("open is not null").select("key", "open").mapInArrow(deal, schema)
    for stage in (0, 1, 2) if words_too else (2,):
        rows = stored(rows) if words_too else rows
        look_up, known = visit(stage)
        mine = rows.where(F.col("stage") == stage).groupBy("part").cogroup(known.groupBy("part")).applyInArrow(look_up, schema)
        # without open words every token waits for its pair
        rows = rows.where(F.col("stage") > stage).unionByName(mine) if words_too else mine
    return rows.select("data").mapInArrow(sums, "key long, p double").groupBy("key").agg(F.sum("p").alias("rest_score"))


def train(training: DataFrame, total: int) -> tuple[DataFrame, LogBloom, tuple[int, int], tuple[np.ndarray, np.ndarray], int, int]:
    """The stored counts, the filter, the least levels of words and pairs in it, the frequent words with counts, the number of tokens and of distinct ones."""
    groups = 1 << max(0, math.ceil(math.log2(max(1, total / PER_GROUP))))
    table = stored(counts_table(training, groups))

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, pairs = np.frombuffer(r["word_counts"], "<i8"), np.frombuffer(r["pair_counts"], "<i8")
                of = np.stack([np.bincount(levels(x) if len(x) else x, minlength=len(EXPECTED)) for x in (words, pairs)])
                yield pa.RecordBatch.from_arrays([pa.array([int(words.sum())]), pa.array([len(words)]), pa.array([of.astype("<i8").tobytes()], pa.binary())], names=["tokens", "words", "levels"])

    sums = table.select("word_counts", "pair_counts").mapInArrow(histogram, "tokens long, words long, levels binary").collect()  # one short row a hash range
    tokens, distinct = sum(r["tokens"] for r in sums), sum(r["words"] for r in sums)
    by_level = sum((np.frombuffer(r["levels"], "<i8").reshape(2, -1) for r in sums), np.zeros((2, len(EXPECTED)), np.int64))
    entries = np.cumsum((by_level * np.arange(len(EXPECTED)))[:, ::-1], axis=1)[:, ::-1]
    # the lowest levels whose entries, with all above, fit: 1, that is everything, until the filter is at its largest; words go first
    least_word = next(q for q in range(1, len(EXPECTED)) if entries[0, q] * ENTRY_BITS <= FILTER_BITS)
    least_pair = next(q for q in range(least_word, len(EXPECTED)) if (entries[0, least_word] + entries[1, q]) * ENTRY_BITS <= FILTER_BITS)
    bits = min(FILTER_BITS, 1 << math.ceil(math.log2(max(64, ENTRY_BITS * int(entries[0, least_word] + entries[1, least_pair])))))
    segment = max(64, bits // groups)
    above = np.cumsum(by_level[0][::-1])[::-1]
    frequent_level = next(q for q in range(int(levels(np.array([FREQUENT_COUNT]))[0]), len(EXPECTED)) if above[q] <= FREQUENT_WORDS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, counts = hashes_of(r["words"]), np.frombuffer(r["word_counts"], "<i8")
                pairs, pair_counts = hashes_of(r["pairs"]), np.frombuffer(r["pair_counts"], "<i8")
                often = levels(counts) >= frequent_level if len(counts) else np.zeros(0, bool)
                hashes, n = np.concatenate([words, pairs]), np.concatenate([counts, pair_counts])
                enter = levels(n) >= np.repeat([least_word, least_pair], [len(words), len(pairs)]) if len(n) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (LogBloom.build(hashes[enter], n[enter], segment), words[often].tobytes(), counts[often].tobytes()))], names=["part", "bits", "words", "counts"])

    bloom = np.zeros(groups * segment // 8, dtype=np.uint8)
    words, counts = [np.zeros(0, "<u8")], [np.zeros(0, "<i8")]
    for r in table.mapInArrow(build, "part int, bits binary, words binary, counts binary").toLocalIterator():  # FILTER_BITS and FREQUENT_WORDS bound it
        bloom[r["part"] * segment // 8 : (r["part"] + 1) * segment // 8] = np.frombuffer(r["bits"], np.uint8)
        words.append(np.frombuffer(r["words"], "<u8"))
        counts.append(np.frombuffer(r["counts"], "<i8"))
    words, counts = np.concatenate(words), np.concatenate(counts)
    order = np.argsort(words)
    return table, LogBloom(groups, segment, bloom), (least_word, least_pair), (words[order], counts[order]), tokens, distinct


def lm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Counts are learnt from all rows whose crc32(id) mod folds is not held_out. A null or empty text is its end alone. A
    null id hashes as the empty text and stays null. Rows that repeat id and text are counted and scored each. Without
    training rows nothing is known, N and V are 0, and scores follow from the smoothing alone. An empty table gives no
    rows. Words are compared as 64-bit hashes; only id and text are read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = crc_mod(F.col("doc_id"), folds) == held_out
    d = d.withColumn("learnt", ~held)
    numbered = d.withColumn("key", F.monotonically_increasing_id())  # fixed once the scored rows are stored
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
    table, bloom, (least_word, least_pair), frequent, n_tokens, n_words = train(d.where(~held).select("text"), total)
    floor = n_tokens + 0.5 * (n_words + 1)
    groups = bloom.groups
    model = docs.sparkSession.sparkContext.broadcast((bloom.segment, bloom.bits, frequent))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, bits, (words, counts) = model.value
        filter_, hasher = LogBloom(groups, segment, bits), WordHasher()
        for batch in batches:
            data, bounds = byte_column(batch.column(1))
            ids, learnt, keys, found = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_pylist(), []
            for i, j in steps(bounds, SCORED_BYTES):
                part = data[bounds[i] : bounds[j]]
                tokens, at = with_ends(hasher, part, bounds[i : j + 1] - bounds[i])
                place = np.searchsorted(words, tokens)
                place[place == len(words)] = 0
                known = words[place] == tokens if len(words) else np.zeros(len(tokens), bool)
                c = np.where(known, counts[place], 0) if len(words) else np.zeros(len(tokens))
                base = np.where(known, np.log10((c + 0.5) / floor), 0.0)
                previous = np.concatenate([[END], tokens[:-1]]).astype(np.uint64)
                previous[at[:-1]] = END
                pairs = pairs_of(tokens, at)
                own = np.repeat(learnt[i:j], np.diff(at))  # tokens that the counts have
                word = filter_.levels_from(tokens, least_word)
                word[own & (word == OPEN) & (least_word == 2)] = 1
                before = np.concatenate([word[:1], word[:-1]])
                before[at[:-1]] = filter_.levels_from(np.array([END]), least_word)[0]
                pair = filter_.levels_from(pairs, least_pair)
                pair[own & (pair == OPEN) & (least_pair == 2)] = 1
                pair[(word == OPEN) | (before == OPEN)] = OPEN
                settled(word, before, pair)
                waits = (word == OPEN) | (before == OPEN) | (pair == OPEN)
                p = np.where(waits, 0.0, log_probability(*(np.where(waits, 0, x) for x in (word, before, pair)), floor))
                asked = [np.where(x == OPEN, h, np.uint64(0)) for x, h in ((word, tokens), (before, previous), (pair, pairs))]
                for k in range(j - i):
                    a, b = at[k], at[k + 1]
                    rare = tokens[a:b][~known[a:b]]
                    found.append((ids[i + k], keys[i + k], int(b - a), int(known[a:b].sum()), float(base[a:b].sum()), float(p[a:b].sum()), rare.tobytes() if len(rare) else None, packed([*asked, word, before, pair], a + np.flatnonzero(waits[a:b])) or None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*found) if found else [[]] * 8, types)], names=["doc_id", "key", "n_tokens", "known", "base", "score", "rare", "open"])

    scored = stored(numbered.mapInArrow(score, "doc_id long, key long, n_tokens long, known long, base double, score double, rare binary, open binary"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rare = batch.column(0).to_pylist(), [np.frombuffer(x, "<u8") for x in batch.column(1).to_pylist()]
            if not rare:
                continue
            of, hashes = np.repeat(np.array(keys, dtype=np.int64), [len(x) for x in rare]), np.concatenate(rare)
            part = parts_of(hashes, groups)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(1, groups))
            cut = [(g, planes(k), h.tobytes()) for g, (k, h) in enumerate(zip(np.split(of[order], ends), np.split(hashes[order], ends))) if len(k)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*cut), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "keys", "hashes"])

    def look_up(key, rows, known):
        keys = np.concatenate([np.zeros(0, "<i8"), *(keys_of(x) for x in rows.column("keys").to_pylist())])
        hashes = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist())])
        words = np.concatenate([np.zeros(0, "<u8"), *(hashes_of(x) for x in known.column("words").to_pylist())])
        counts = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(x, "<i8") for x in known.column("word_counts").to_pylist())])
        c = np.zeros(len(hashes))
        if len(words):
            at = np.searchsorted(words, hashes)
            at[at == len(words)] = 0
            c = np.where(words[at] == hashes, counts[at], 0)
        distinct, back = np.unique(keys, return_inverse=True)
        return pa.table({"key": pa.array(distinct, pa.int64()), "base": pa.array(np.bincount(back, weights=np.log10((c + 0.5) / floor), minlength=len(distinct)), pa.float64()), "known": pa.array(np.bincount(back, weights=c > 0, minlength=len(distinct)).astype(np.int64), pa.int64())})

    dealt = scored.where("rare is not null").select("key", "rare").mapInArrow(deal, "part int, keys binary, hashes binary")
    rest = dealt.groupBy("part").cogroup(table.select("part", "words", "word_counts").groupBy("part")).applyInArrow(look_up, "key long, base double, known long")
    rest = rest.groupBy("key").agg(F.sum("base").alias("rest_base"), F.sum("known").alias("rest_known"))
    whole = scored.join(rest, "key", "left")
    if least_pair > 1:
        opened = open_scores(scored, table, groups, floor, least_word, least_pair)
        whole = whole.join(opened, "key", "left").withColumn("score", F.col("score") + F.coalesce("rest_score", F.lit(0.0)))
    return whole.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"), "score")
