"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A sketch has one coordinate for each bin. In each round every shingle of a set falls into one bin by a hash of its own for
that round; a bin keeps the least hash of the first round that reaches it. Once as many rounds have passed as there are bins,
bin i takes the least hash of all shingles, so that every coordinate is filled, whatever the size of the set. Coordinates of
two sets agree with the probability of their similarity and are concentrated about it.

Bands of ROWS coordinates are keys. At the threshold of 85 % a pair has ROWS equal coordinates with probability 0.27, so none
of BANDS keys in common with 1.5e-9, and less the more alike the sets are. Equal sets are one node. Each key's list is led by
its most central node, the one that meets most others in all its lists; nodes are first compared with their leaders, on their
full sets. What these links join needs no pair of its own any more. The most central of a node's leaders is its pivot: what
two nodes share lies in their pivot, at most as much as the smaller of their known overlaps with it, or outside. So of one
pivot's nodes, pairs that would need a shared shingle outside the pivot are found by such shingles, and never by their lists;
a group of thousands of copies with edits of their own makes few pairs. All other pairs of different groups come from the
lists. Every pair is compared on its full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import WordHasher, mix, stored
from riskweave.llm.components import components
from riskweave.llm.jaccard_join import sets_of, units
from riskweave.llm.shingles import set_id, shingle_sets

WORDS, PERCENT = 3, 85
ROWS, BANDS = 8, 64
#: Keys that a node and a leader must share to be compared in the first round if it isn't the pivot; others come in the second.
FIRST_SHARED = 6
#: Sets of which a task remembers that it has sketched them, and bits of a hash that are kept within a round.
REMEMBERED, BITS = 1 << 16, 54
_ROUND = mix(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_PLACE = mix(np.arange(7001, 7001 + ROWS, dtype=np.uint64)) | np.uint64(1)


def sketch(s: np.ndarray, bins: int = ROWS * BANDS) -> np.ndarray:
    """The coordinates of a set of 64-bit shingles, one a bin, all filled."""
    out, open_, low = np.zeros(bins, np.uint64), np.ones(bins, bool), np.uint64((1 << BITS) - 1)
    done = 0
    while done < bins and open_.any():
        rounds = min(bins - done, 1 << (63 - BITS), max(1, 3 * bins // len(s)))
        h = mix(s[None] + _ROUND[done : done + rounds, None])
        at = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        value = h & low | np.arange(rounds, dtype=np.uint64)[:, None] << np.uint64(BITS)
        least = np.full(bins, np.iinfo(np.uint64).max)
        np.minimum.at(least, at.ravel(), value.ravel())
        filled = open_ & (least != np.iinfo(np.uint64).max)
        out[filled] = least[filled] + (np.uint64(done) << np.uint64(BITS))
        open_ &= ~filled
        done += rounds
    for i in np.flatnonzero(open_).tolist():
        out[i] = mix(s + _ROUND[bins + i]).min()
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a set's sketch."""
    whole = (mix(sketch(s)).reshape(BANDS, ROWS) * _PLACE).sum(1, dtype=np.uint64)
    return mix(whole + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def sketched(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, n_shingles, node (the name of the set; null without words) and keys (null where the task had the set before)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            sizes, nodes, keys = [], [], []
            for s in shingle_sets(batch.column(1), hasher, words):
                node = set_id(s) if len(s) else None
                sizes.append(len(s))
                nodes.append(node)
                keys.append(None if node is None or node in seen else band_keys(s).tobytes())
                if node is not None and len(seen) < REMEMBERED:
                    seen.add(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "n_shingles", "node", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(name, "doc_id long, n_shingles long, node long, keys binary")


def listed(named: DataFrame) -> DataFrame:
    """key, node, n of every node, once a band."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.repeat(batch.column(1).to_numpy(), BANDS))], names=["key", "node", "n"])

    return named.where("keys is not null").select("node", F.col("n_shingles").alias("n"), "keys").dropDuplicates(["node"]).mapInArrow(spread, "key long, node long, n long")


def alike(a: str, b: str, percent: int):
    """Sizes that sets of the similarity can have."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, both (shingles in common), linked, and outside: the shingles of a that b has not, if b has half of a's.

    Pairs (a, b, na, nb) travel as ids; each part is sent each set that it needs once.
    """
    dealt = stored(units(pairs))
    needs = dealt.select(F.col("part").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct()

    def compare(key, pairs, sets):
        of = {node: np.frombuffer(x, np.uint64) for node, x in zip(sets.column("node").to_pylist(), sets.column("shingles").to_pylist())}
        both, linked, outside = [], [], []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist()):
            x, y = of[a], of[b]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            shared = y[at] == x
            n = int(np.count_nonzero(shared))
            both.append(n)
            linked.append(100 * n >= percent * (len(x) + len(y) - n))
            outside.append(x[~shared].view(np.int64) if 2 * n >= len(x) else None)
        return pa.table({"a": pairs.column("a"), "b": pairs.column("b"), "both": pa.array(both, pa.int64()), "linked": pa.array(linked, pa.bool_()), "outside": pa.array(outside, pa.list_(pa.int64()))})

    return dealt.groupBy("part").cogroup(needs.join(sets, "node").select("to", "node", "shingles").groupBy("to")).applyInArrow(compare, "a long, b long, both long, linked boolean, outside array<long>")


def minhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links of similarity percent / 100 or more reach), kept.

    Words are runs of other than ASCII white space, A-Z lower-cased. A text of fewer than `words` words has one shingle,
    its whole sequence; texts that are null, empty or white space have none and link with nothing. Rows that repeat an id
    keep a row each. A null id is larger than any other: alone, its component is null and it is kept. An empty table gives
    no rows. Shingles and sets are compared as 64-bit hashes. Only id and text are read, so other columns may have any names.
    A link is missed with probability 1.5e-9 at most, at the threshold; none that is not one is made.
    """
    named = stored(sketched(docs, id_col, text_col, words))
    nodes = named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    lists = listed(named)
    # all minima, maxima and counts are partial sums, and the rest is joins, so that no list is gathered
    many = lists.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    lists = stored(lists.join(many, "key"))
    ranked = lists.join(lists.groupBy("node").agg(F.sum("members").alias("centre")), "node").withColumn("rank", F.struct("centre", F.xxhash64("node").alias("h"), "node", "n"))
    led = lists.join(ranked.groupBy("key").agg(F.max("rank").alias("lead")), "key")
    led = stored(led.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")))
    pivots = led.groupBy("node").agg(F.max("lead").alias("pivot"))

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs)
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", F.coalesce("first", F.lit(0)).alias("doc_id")))
        return stored(overlaps(pairs, sets_of(docs, wanted, id_col, text_col, words), percent))

    first = led.join(pivots, "node").where(F.col("node") != F.col("lead.node"))
    first = first.where((F.col("lead") == F.col("pivot")) | (F.col("shared") >= FIRST_SHARED) & alike("n", "lead.n", percent))
    first = compared(first.select(F.col("node").alias("a"), F.col("lead.node").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb")))
    links = stored(first.where("linked").select("a", "b"))
    groups = components(links)

    # overlap of each node with its pivot, and what it has outside; a pivot of its own has all of itself inside
    own = pivots.where(F.col("node") == F.col("pivot.node")).select("node", F.col("node").alias("pivot"), F.col("pivot.n").alias("inside"), F.array().cast("array<long>").alias("outside"))
    known = first.where("outside is not null").join(pivots, (F.col("a") == F.col("node")) & (F.col("b") == F.col("pivot.node"))).select("node", F.col("pivot.node").alias("pivot"), F.col("both").alias("inside"), "outside")
    known = stored(known.unionByName(own))
    grouped = lists.select("node", "n").distinct().join(groups, "node", "left").join(known.drop("outside"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = stored(grouped)
    apart = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & alike("na", "nb", percent)
    # sets that are similar would share more than lies in the pivot
    beyond = (F.col("na") + F.col("nb")) * percent > F.least("ia", "ib") * (100 + percent)
    side = lambda df, k, *keys: df.select(*keys, F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("component").alias(f"c{k}"), F.col("pivot").alias(f"p{k}"), F.col("inside").alias(f"i{k}"))

    def of_two_groups(rows: DataFrame, *keys: str) -> DataFrame:
        """Rows of keys with nodes of two components at least, on both sides of a join."""
        open_ = rows.groupBy(*keys).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(*keys)
        rows = rows.join(open_, list(keys))
        return side(rows, "a", *keys).join(side(rows, "b", *keys), list(keys)).where(apart)

    by_list = of_two_groups(lists.select("key", "node").join(grouped, "node"), "key").where(~F.coalesce((F.col("pa") == F.col("pb")) & beyond, F.lit(False)))
    by_list = by_list.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    outside = known.select("node", F.col("pivot").alias("at"), F.explode("outside").alias("shingle")).join(grouped, "node")
    by_shingle = of_two_groups(outside, "at", "shingle").where(beyond).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("na", "nb", "ia", "ib")])
    by_shingle = by_shingle.where((F.col("shared") + F.least("ia", "ib")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b", "na", "nb")
    rest = compared(by_list.unionByName(by_shingle))
    merged = components(links.unionByName(rest.where("linked").select("a", "b")))

    labelled = nodes.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = labelled.join(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("node", "component_id")
    found = named.join(labelled, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
