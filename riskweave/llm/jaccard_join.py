"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered by frequency: those outside a bounded table of frequent shingles first. Two sets whose Jaccard
similarity reaches the threshold share at least k of the first |x| - ceil(t |x|) + k shingles of each, for any k up to
their overlap. Each document takes the k with the least estimated cost (rows scanned and candidates verified). A pair must
share as many prefix shingles as its sizes ask for, given what can lie beyond the prefixes, before its sets are compared
exactly: the smaller k of the two at least, and more the closer the sizes are. The first matches are counted while pairs
are made, where the places of the shingles leave the overlap in reach; all others on the prefixes of the pairs left.

Equal sets are one node from the start. Nodes are first tried against a few leaders of each shingle's list; what these
links join needs no pair of its own any more, and only pairs between different groups are left to the exact round. So a
group of thousands of near copies costs a few pairs a member, and no link between different groups is lost. Lists of very
frequent shingles are dealt out by node, so that no task gathers them whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import WordHasher, free_name, mix, stored
from riskweave.llm.components import components
from riskweave.llm.shingles import WORDS, set_id, shingle_sets

PERCENT = 80
#: Rows of the table of frequent shingles at most (4 bytes and a 1-byte frequency each), whatever the corpus.
FREQUENT = 1 << 22
#: A shingle in fewer documents than this is never frequent.
RARE = 16
#: Most prefix shingles that a pair may have to share, the cost of a verification in rows scanned, and what a shingle
#: outside the table is taken to bring in rows.
MOST_MATCHES, VERIFY_COST, FEW = 24, 400, 0.1
#: Nodes that one part of a very frequent shingle's list should have, and bits of the filter that picks wanted sets at most.
PART_NODES, WANTED_BITS = 1 << 16, 1 << 26
#: Shared prefix shingles that are counted while pairs are made; more are counted on whole prefixes. Each one more lets a
#: list's pairs in one place later, so that rows grow while pairs shrink.
MATCHED = 2
#: Shingles that a task gathers before it hands them on, shingles for each group of the counting shuffle, and shingles of
#: whole sets in one message.
GATHER, PER_GROUP, SENT = 1_000_000, 500_000, 1 << 19
#: Pairs and bytes of sets that a part of the exact comparison should have, and one unit of a hub's pairs.
PART_PAIRS, PART_BYTES, UNIT_PAIRS, UNIT_BYTES = 512, 8 << 20, 64, 2 << 20
#: Leaders of each list in the first round: the node with the largest share of frequent shingles, then by hash.
LEADERS = 3
#: Sets with this many copies count once in frequencies, as far as COPIED of them go (16 bytes each).
COPIES, COPIED = 4, 1 << 17


def needed(n, percent: int = PERCENT):
    """ceil(percent * n / 100) in integers."""
    return -(-n * percent // 100)


def nodes_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, of (a hash of the text), n_shingles and node (the name of its set; null without words) of each row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sets = [(len(s), set_id(s) if len(s) else None) for s in shingle_sets(batch.column(1), hasher, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([n for n, _ in sets], pa.int64()), pa.array([x for _, x in sets], pa.int64())], names=["doc_id", "of", "n_shingles", "node"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), F.xxhash64(text_col).alias("of")).mapInArrow(name, "doc_id long, of long, n_shingles long, node long")


class Representatives:
    """Whether a row speaks for its set: not if the set is known to have many copies and another row is their first."""

    def __init__(self, nodes: np.ndarray, firsts: np.ndarray):
        order = np.argsort(nodes)
        self.nodes, self.firsts = nodes[order], firsts[order]

    def __call__(self, node: int, doc_id: int | None) -> bool:
        at = int(np.searchsorted(self.nodes, node))
        return at == len(self.nodes) or self.nodes[at] != node or self.firsts[at] == doc_id


def representatives(named: DataFrame) -> Representatives:
    many = named.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    rows = many.where((F.col("n") >= COPIES) & F.col("first").isNotNull()).orderBy(F.desc("n"), "node").limit(COPIED).select("node", "first").collect()
    return Representatives(np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64))


def frequent(docs: DataFrame, id_col: str, text_col: str, words: int, total: int, speak) -> tuple[np.ndarray, np.ndarray]:
    """The upper 32 bits of frequent shingles, ascending, and in how many documents each is.

    Counts cover every shingle of every document; only those over total / FREQUENT come to the driver.
    """
    groups = 1 << max(4, math.ceil(math.log2(max(1, total / PER_GROUP))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, n = WordHasher(), [], 0

        def flush():
            all_of_them = np.sort(np.concatenate(held))
            ends = np.searchsorted(all_of_them, (np.arange(1, groups + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(groups))
            parts = [(g, p) for g, p in enumerate(np.split(all_of_them, ends[:-1])) if len(p)]
            # ascending numbers travel as steps, which compress
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in parts], pa.int32()), pa.array([np.diff(p, prepend=p.dtype.type(0)).astype("<u4").tobytes() for _, p in parts], pa.binary())], names=["part", "steps"])

        for batch in batches:
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), hasher, words)):
                if not len(s) or not speak.value(set_id(s), doc_id):
                    continue
                held.append(s >> np.uint64(32))
                n += len(s)
                if n >= GATHER:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def tally(key, batches):
        every = np.sort(np.concatenate([np.cumsum(np.frombuffer(x, "<u4"), dtype=np.uint64).astype("<u4") for x in batches.column("steps").to_pylist()]))
        starts = np.flatnonzero(np.diff(every, prepend=every[:1] ^ 1))
        n = np.diff(np.append(starts, len(every)))
        often = n >= RARE
        return pa.table({"shingles": [every[starts[often]].tobytes()], "counts": [n[often].astype("<u4").tobytes()]}, schema=pa.schema([("shingles", pa.binary()), ("counts", pa.binary())]))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(x, "<u4") for x in batch.column(0).to_pylist())])
            yield pa.RecordBatch.from_arrays([pa.array([np.bincount(np.log2(np.maximum(n, 1)).astype(np.int64), minlength=33).astype("<i8").tobytes()], pa.binary())], names=["sizes"])

    tallied = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(gather, "part int, steps binary").groupBy("part").applyInArrow(tally, "shingles binary, counts binary"))
    above = np.cumsum(sum((np.frombuffer(r["sizes"], "<i8") for r in tallied.select("counts").mapInArrow(sizes, "sizes binary").collect()), np.zeros(33, np.int64))[::-1])[::-1]
    least = max(RARE, 1 << next((q for q in range(33) if above[q] <= FREQUENT), 32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shingles, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = np.frombuffer(n, "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(shingles, "<u4")[n >= least].tobytes()], pa.binary()), pa.array([n[n >= least].tobytes()], pa.binary())], names=["shingles", "counts"])

    parts = tallied.mapInArrow(cut, "shingles binary, counts binary").collect()  # FREQUENT entries at most
    shingles = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r["shingles"], "<u4") for r in parts)])
    counts = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r["counts"], "<u4") for r in parts)])
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def lookup(s: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many documents have each shingle, 0 if it is not in the table."""
    upper = (s >> np.uint64(32)).astype(np.uint32)
    if not len(shingles):
        return np.zeros(len(s), np.uint32)
    at = np.searchsorted(shingles, upper)
    at[at == len(shingles)] = 0
    return np.where(shingles[at] == upper, counts[at], 0)


def prefix(s: np.ndarray, shingles: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """The prefix of a set under the global order, how many of its shingles a partner must share, and the set's share
    of frequent shingles, in thousandths."""
    n = len(s)
    base = n - needed(n, percent) + 1
    most = min(MOST_MATCHES, needed(n, percent))
    often = lookup(s, shingles, counts)
    order = np.lexsort((s, often))[: base + most - 1] if often.any() else np.arange(min(n, base + most - 1))
    scanned = np.cumsum(np.maximum(often[order], FEW))
    k = np.arange(1, most + 1)
    cost = scanned[base - 1 : base - 1 + most] * (1 + VERIFY_COST / k)
    best = int(np.argmin(cost)) + 1
    return s[order[: base + best - 1]], best, 1000 * int(np.count_nonzero(often)) // n


def prefix_lists(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, table: tuple[np.ndarray, np.ndarray], total: int, speak) -> DataFrame:
    """shingle, node, n, matches, place: prefix shingles that two nodes at least have, each with the nodes that have it and
    its place in their order."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    groups = 1 << max(4, math.ceil(math.log2(max(1, total / 4 / PER_GROUP))))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, (shingles, counts) = WordHasher(), shared.value
        held, n, seen = [], 0, set()

        def flush():
            tokens = np.concatenate([p for p, _, _, _ in held])
            times = [len(p) for p, _, _, _ in held]
            nodes = np.repeat(np.array([x for _, x, _, _ in held], dtype=np.int64), times)
            sizes = np.repeat(np.array([size for _, _, size, _ in held], dtype=np.int64), times)  # size, share, matches
            seats = np.concatenate([np.arange(n, dtype="<u4") for n in times])
            # a list of very many nodes is dealt to several parts
            salts = lookup(tokens, shingles, counts).astype(np.uint64) // np.uint64(PART_NODES) + np.uint64(1)
            part = ((tokens + nodes.view(np.uint64) % salts) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(1, groups))
            cut = [[x.tobytes() for x in np.split(column[order], ends)] for column in (tokens, nodes, sizes, seats)]
            some = [g for g in range(groups) if cut[0][g]]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array([c[g] for g in some], pa.binary()) for c in cut)], names=["part", "tokens", "nodes", "sizes", "seats"])

        for batch in batches:
            for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), hasher, words)):
                if not len(s) or (node := set_id(s)) in seen or not speak.value(node, doc_id):  # equal sets are one node
                    continue
                seen.add(node)
                first, k, share = prefix(s, shingles, counts, percent)
                held.append((first, node, len(s) | share << 40 | k << 56, k))
                n += len(first)
                if n >= GATHER // 2:
                    yield from flush()
                    held, n, seen = [], 0, set()
        if n:
            yield from flush()

    def meet(key, batches):
        tokens, nodes, sizes, seats = (np.concatenate([np.frombuffer(x, t) for x in batches.column(c).to_pylist()]) for c, t in (("tokens", np.uint64), ("nodes", np.int64), ("sizes", np.int64), ("seats", "<u4")))
        order = np.lexsort((nodes, tokens))
        tokens, nodes, sizes, seats = tokens[order], nodes[order], sizes[order], seats[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
        tokens, nodes, sizes, seats = tokens[new], nodes[new], sizes[new], seats[new]
        same = np.zeros(len(tokens) + 1, dtype=bool)
        same[1:-1] = tokens[1:] == tokens[:-1]
        keep = same[1:] | same[:-1] | (lookup(tokens, shared.value[0], shared.value[1]) >= PART_NODES)
        tokens, nodes, sizes, seats = tokens[keep], nodes[keep], sizes[keep], seats[keep]
        n, share, matches = sizes & ((1 << 40) - 1), (sizes >> 40 & 0xFFFF).astype(np.uint64), (sizes >> 56).astype(np.int32)
        leads = {}
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(tokens)))
        for i in range(LEADERS):  # the node with the least number leads; nodes of other sizes than could be similar have none
            h = mix(nodes.view(np.uint64) ^ np.uint64(i + 1))
            h = h if i else (np.uint64(1000) - share) << np.uint64(48) | h >> np.uint64(16)
            lowest = np.repeat(np.minimum.reduceat(h, first), times) if len(first) else h
            at = np.minimum.reduceat(np.where(h == lowest, np.arange(len(h)), len(h)), first) if len(first) else first
            lead, size = np.repeat(nodes[at], times), np.repeat(n[at], times)
            fit = (lead != nodes) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size))
            leads[f"lead{i}"] = pa.array(lead, mask=~fit)
        return pa.table({"shingle": tokens.view(np.int64), "node": nodes, "n": n, "matches": matches, "place": seats.astype(np.int32), **leads})

    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(gather, "part int, tokens binary, nodes binary, sizes binary, seats binary")
    return packed.groupBy("part").applyInArrow(meet, "shingle long, node long, n long, matches int, place int" + "".join(f", lead{i} long" for i in range(LEADERS)))


def bloom_places(node: np.ndarray, doc_id: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(node.view(np.uint64) ^ mix(doc_id.view(np.uint64)))
    return [h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node and shingles (8 bytes each, ascending) of the wanted (node, doc_id), and of a few others.

    A Bloom filter of bounded size tells wanted texts where they are read, so that other texts never travel.
    """
    bits = min(WANTED_BITS, 1 << math.ceil(math.log2(max(1 << 16, 16 * wanted.count()))))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(bloom_places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 16, pa.int32()), pa.array(at & 0xFFFF, pa.int32())], names=["page", "bit"])

    def page(key, rows):
        bits = np.zeros(1 << 16, dtype=bool)
        bits[rows.column("bit").to_numpy()] = True
        return pa.table({"page": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, schema=pa.schema([("page", pa.int32()), ("bits", pa.binary())]))

    marked = wanted.select("node", "doc_id").mapInArrow(mark, "page int, bit int").dropDuplicates().groupBy("page").applyInArrow(page, "page int, bits binary")
    bloom = np.zeros(bits // 8, dtype=np.uint8)
    for r in marked.toLocalIterator():  # WANTED_BITS in all
        bloom[r["page"] << 13 : (r["page"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bloom)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bloom = WordHasher(), shared.value
        for batch in batches:
            ids, found, held = batch.column(0).fill_null(0).to_numpy(), [], 0
            for k, s in enumerate(shingle_sets(batch.column(1), hasher, words)):
                if len(s):
                    node = set_id(s)
                    if all(bloom[int(at[0]) >> 3] >> (int(at[0]) & 7) & 1 for at in bloom_places(np.array([node]), ids[k : k + 1], bits)):
                        found.append((node, s.tobytes()))
                        held += len(s)
                if held > SENT:
                    yield packed_sets(found)
                    found, held = [], 0
            yield packed_sets(found)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])


def packed_sets(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["node", "shingles"])


def units(pairs: DataFrame) -> DataFrame:
    """part, a, b: pairs dealt to parts of bounded size.

    Of a pair, the node with more pairs is the hub. A hub's pairs are dealt by their other node to as many units as their
    number and the size of their sets ask for; units are dealt to parts. So a group of any size is spread, and a part
    needs each of its sets once.
    """
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    degree = stored(ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    da, db = degree.select(F.col("node").alias("a"), F.col("degree").alias("da")), degree.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    a_leads = F.col("da") >= F.col("db")
    led = pairs.join(da, "a").join(db, "b").withColumns({"hub": F.when(a_leads, F.col("a")).otherwise(F.col("b")), "other": F.when(a_leads, F.col("b")).otherwise(F.col("a")), "pairs": F.greatest("da", "db"), "bytes": 8 * (F.col("na") + F.col("nb"))})
    led = stored(led.select("a", "b", "hub", "other", "pairs", "bytes"))
    n, total = led.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = max(16, math.ceil(n / PART_PAIRS), math.ceil(total / PART_BYTES))
    # sizes within a hub are alike, since only sets of like size can be similar
    salts = F.ceil(F.greatest(F.col("pairs") / UNIT_PAIRS, F.col("pairs") * F.col("bytes") / UNIT_BYTES)).cast("long")
    salt = F.pmod(F.xxhash64("other"), salts)
    return led.select(F.pmod(F.xxhash64("hub", salt, F.lit(1)), F.lit(parts)).cast("int").alias("part"), "a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b (with set sizes na, nb) whose sets reach the threshold, by exact intersection.

    Pairs travel as ids; each part is sent each set that it needs once.
    """
    dealt = stored(units(pairs))
    needs = dealt.select(F.col("part").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct()
    needed_sets = needs.join(sets, "node").select("to", "node", "shingles")

    def check(key, pairs, sets):
        of = {node: np.frombuffer(x, np.uint64) for node, x in zip(sets.column("node").to_pylist(), sets.column("shingles").to_pylist())}
        keep = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            small, large = sorted((of[a], of[b]), key=len)
            at = np.searchsorted(large, small)
            at[at == len(large)] = 0
            both = int(np.count_nonzero(large[at] == small))
            keep.append(100 * both >= percent * (len(small) + len(large) - both))
        return pairs.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return dealt.groupBy("part").cogroup(needed_sets.groupBy("to")).applyInArrow(check, "a long, b long")


def classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """doc_id, of, n_shingles, component_id of every row."""
    named = stored(nodes_of(docs, id_col, text_col, words))
    nodes = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"))
    total = named.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    speak = docs.sparkSession.sparkContext.broadcast(representatives(named))
    table = frequent(docs, id_col, text_col, words, total, speak)
    lists = stored(prefix_lists(docs, id_col, text_col, words, percent, table, total, speak))

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) that reach the threshold."""
        pairs = stored(pairs)
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", F.coalesce("first", F.lit(0)).alias("doc_id")))
        return stored(verified(pairs, sets_of(docs, wanted, id_col, text_col, words), percent))

    led = lists.select("node", "n", "matches", F.explode(F.array_distinct(F.array(*[f"lead{i}" for i in range(LEADERS)]))).alias("lead")).where("lead is not null")
    led = led.groupBy(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.min("matches").alias("least"), F.max("n").alias("na"))
    links = linked(led.where("2 * shared >= least").select("a", "b", "na", F.col("na").alias("nb")))
    groups = components(links)

    placed = stored(lists.select("shingle", "node", "n", "matches", "place").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    met = stored(candidates(placed, percent))
    # of the set whose prefix ends first, what the prefixes don't show lies beyond its prefix: needed(n) - matches at most
    sides = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = placed.join(sides, "node", "left_semi").groupBy("node").agg(F.collect_list("shingle").alias("prefix"), F.first(F.expr(f"(n * {percent} + 99) div 100") - F.col("matches")).alias("beyond"))
    whole = stored(whole)
    p, q = (whole.select(*[F.col(c).alias(f"{c}_{k}") for c in whole.columns]) for k in "ab")
    across = met.join(p, met["a"] == p["node_a"]).join(q, met["b"] == q["node_b"])
    across = across.where((F.size(F.array_intersect("prefix_a", "prefix_b")) + F.greatest("beyond_a", "beyond_b")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    merged = components(links.unionByName(linked(across.select("a", "b", "na", "nb"))))

    labelled = nodes.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = labelled.join(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("node", "component_id")
    every = named.join(labelled, "node", "left")
    return every.select("doc_id", "of", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def candidates(placed: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb of pairs in different components that share several prefix shingles, as far as MATCHED counts them.

    Of the shingles that a similar pair shares, in order, the i-th has enough of either set after it to reach, with the
    i - 1 before it, the overlap that the sizes ask for. So the first k of them stand where k - 1 less is enough, which
    keeps late shingles of long lists out, and the very first where the whole overlap is.
    """
    open_lists = placed.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("shingle")
    open_ = placed.join(open_lists, "shingle")
    x, y = (open_.select("shingle", F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("matches").alias(f"k{k}"), (F.col("n") - F.col("place")).alias(f"r{k}"), F.col("component").alias(f"c{k}")) for k in "ab")
    left, k, sizes = F.least("ra", "rb"), F.least("ka", "kb", F.lit(MATCHED)), (F.col("na") + F.col("nb")) * percent
    met = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((left + k - 1) * (100 + percent) >= sizes))
    met = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(left).alias("left"), F.first(k).alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return met.where((F.col("shared") >= F.col("k")) & (F.col("left") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)).select("a", "b", "na", "nb")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links of similarity percent / 100 or more reach.

    These are classes, not links: pairs whose ends are in one component already are skipped, so neither the links nor how
    many a row has are in the result.

    Words are runs of other than ASCII white space, A-Z lower-cased. A text of fewer than `words` words has one shingle,
    its whole sequence; texts that are null, empty or white space have none and link with nothing. Rows that repeat an id
    keep a row each. A null id is larger than any other: alone, its component is null. An empty table gives no rows.
    Shingles and sets are compared as 64-bit hashes. Only id and text are read, so other columns may have any names.
    """
    return classes(docs, id_col, text_col, words, percent).drop("of")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay when each group of near duplicates keeps the one with the smallest id.

    Rows go by id and text: of rows that repeat an id with other texts each is judged by its own, a null id goes where its
    group has another id, and rows that repeat id and text stay alike. Dropped rows alone are sent to be found again.
    """
    of = free_name(docs, "digest")
    gone = classes(docs, id_col, text_col, WORDS, PERCENT).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone_id"), F.col("of").alias("gone_of")).distinct()
    d = docs.withColumn(of, F.xxhash64(text_col))
    return d.join(gone, d[id_col].eqNullSafe(gone["gone_id"]) & (d[of] == gone["gone_of"]), "left_anti").drop(of)
