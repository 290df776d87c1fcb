"""Boosted trees for a binary label, grown on histograms, and exact explanations of them.

Features are binned once. For each level of a tree every task adds up the gradients of its rows by (node, feature, bin), Spark
adds these up by partial sums, and the driver chooses splits on sums whose number depends on the model alone. Gradients are
summed as whole numbers, so a tree doesn't depend on the order in which rows come. A missing value (null or NaN) stays
missing: each split learns the side on which it goes. Binned rows are kept in blocks, a feature's bytes side by side, that
several models can grow from; margins are kept with them and written anew every few trees. Growth stops early on the average
precision of validation rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Generator, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.sources.sinks import kept

#: Bins of a feature, the number of the bin of missing values, and trees after which margins are written.
BINS, MISSING, REWRITE = 64, 255, 8
#: Rows of a block of binned rows; Parquet holds at least 100 blocks in memory.
BLOCK = 1 << 14
#: Values of a summary while it grows (each counts twice as much as one of the summary before), and of one that a task hands on.
SUMMARY, HANDED = 1 << 15, 1 << 13
#: Setting of the rows of an Arrow batch, and blocks in one.
BATCH_CONF, BATCH_BLOCKS = "spark.sql.execution.arrow.maxRecordsPerBatch", 4
#: A gradient of the weightiest row is this many units; a sum over 2**40 rows stays within 64 bits.
UNIT = 1 << 20
#: Bins of validation margins, from -EDGE to EDGE, in which average precision counts ties.
MARGINS, EDGE = 1 << 16, 16.0


@dataclass
class Tree:
    """Nodes as arrays: feature (-1: leaf), bin and cut (at most that goes left), missing (whether a missing value goes
    left), children, value, and cover (sum of second derivatives)."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    missing: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for column, x in zip((self.feature, self.bin, self.cut, self.missing, self.left, self.right, self.value, self.cover), (-1, 0, 0.0, False, -1, -1, value, cover)):
            column.append(x)
        return len(self.feature) - 1

    def nodes(self, goes_left, rows: int) -> np.ndarray:
        """The leaf of each row; goes_left(feature, bin, cut, missing) says which rows go left at a node."""
        kind = np.min_scalar_type(len(self.feature))
        at: list = list(np.arange(len(self.feature), dtype=kind))
        for i in range(len(self.feature) - 1, -1, -1):  # children come after their parents
            if self.feature[i] >= 0:
                left, right = at[self.left[i]], at[self.right[i]]
                sides = np.negative(goes_left(self.feature[i], self.bin[i], self.cut[i], self.missing[i]).astype(kind))  # all bits, or none
                at[i] = right ^ (left ^ right) & sides
        return np.broadcast_to(at[0], rows)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Of x [feature, row]."""
        return self.nodes(lambda f, b, c, m: (x[f] <= b) | (x[f] == MISSING) if m else x[f] <= b, x.shape[1])  # MISSING is beyond all bins

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Of x [row, feature]."""
        return self.nodes(lambda f, b, c, m: (x[:, f] <= c) | np.isnan(x[:, f]) if m else x[:, f] <= c, len(x))


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    validation: list[float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows of raw features, NaN where missing."""
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.raw(x)]
        return out

    def expected(self) -> float:
        """Mean margin over what the trees were grown on, by cover."""
        return self.base + sum(_means(t)[0] for t in self.trees)


def _means(t: Tree) -> list[float]:
    """Cover-weighted mean of the leaves below each node."""
    out = list(t.value)
    for i in range(len(out) - 1, -1, -1):
        if t.feature[i] >= 0:
            a, b = t.left[i], t.right[i]
            out[i] = (t.cover[a] * out[a] + t.cover[b] * out[b]) / (t.cover[a] + t.cover[b])
    return out


def packed(features: list[str]) -> Column:
    """Features of any numeric or boolean type as one array of doubles, null as NaN: a column that reaches Python faster."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(math.nan)) for f in features])


def matrix(column: pa.Array, n: int) -> np.ndarray:
    """[row, feature] of n packed features."""
    return column.flatten().to_numpy().reshape(-1, n)


class Summary:
    """Quantiles of a stream in bounded state: full buffers are sorted, two of the same weight become one of double weight by
    every other value, the first and the second by turns. Of n values up to SUMMARY none is lost; of more, a rank is off by at
    most n * log2(n / SUMMARY) / (2 * SUMMARY)."""

    def __init__(self):
        self.waiting, self.n, self.levels, self.turn = [], 0, [], 0

    def add(self, x: np.ndarray) -> None:
        self.waiting.append(x)
        self.n += len(x)
        while self.n >= SUMMARY:
            x = np.concatenate(self.waiting)
            self.waiting, self.n = [x[SUMMARY:]], self.n - SUMMARY
            x, level = np.sort(x[:SUMMARY]), 0
            while level < len(self.levels) and self.levels[level] is not None:
                x, self.turn = np.sort(np.concatenate([self.levels[level], x]))[self.turn :: 2], 1 - self.turn
                self.levels[level] = None
                level += 1
            self.levels += [None] * (level + 1 - len(self.levels))
            self.levels[level] = x

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct values and how many each stands for; of more than HANDED, values at so many equal shares."""
        parts = [(x, np.int64(1 << k)) for k, x in enumerate(self.levels) if x is not None] + [(x, np.int64(1)) for x in self.waiting]
        if not parts:
            return np.zeros(0), np.zeros(0, np.int64)
        values, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.full(len(x), w) for x, w in parts]), len(values)).astype(np.int64)
        if len(values) > HANDED:
            upto = np.cumsum(n)
            ends = upto[-1] * np.arange(1, HANDED + 1) // HANDED
            place, first = np.unique(np.searchsorted(upto, (ends + np.append(0, ends[:-1]) + 1) // 2), return_index=True)
            values, n = values[place], np.add.reduceat(np.diff(ends, prepend=0), first)
        return values, n


def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Up to bins - 1 ascending cuts of each feature, by approximate quantiles of bounded state: values of the rows whose
    ranks are those wanted, exact for tables of up to HANDED rows a task."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Summary() for _ in features]
        for batch in batches:
            for s, x in zip(found, np.ascontiguousarray(matrix(batch.column(0), len(features)).T)):
                s.add(x[~np.isnan(x)])
        for i, s in enumerate(found):
            values, n = s.weighted()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i)), pa.array(values), pa.array(n)], names=["i", "value", "n"])

    def cut(table: pa.Table) -> pa.Table:  # at most HANDED rows a task
        value, n = table["value"].to_numpy(), table["n"].to_numpy()
        order = np.argsort(value)
        upto = np.cumsum(n[order])
        wanted = np.unique(value[order][np.searchsorted(upto, np.ceil(upto[-1] * np.arange(1, bins) / bins))])
        return pa.table({"i": table["i"][:1], "cuts": [wanted.tolist()]}, pa.schema([("i", pa.int64()), ("cuts", pa.list_(pa.float64()))]))

    each = rows.select(packed(features).alias("x")).mapInArrow(summed, "i long, value double, n long")
    found = {r["i"]: r["cuts"] for r in each.groupBy("i").applyInArrow(cut, "i long, cuts array<double>").collect()}
    return [np.array(found.get(i) or [], dtype=float) for i in range(len(features))]


@dataclass
class Prepared:
    """What models of one label grow from: blocks of binned rows, the cuts, and how many training rows have label 0 and 1."""

    features: list[str]
    edges: list[np.ndarray]
    blocks: DataFrame | None
    neg: int
    pos: int


def prepared(rows: DataFrame, features: list[str], label: str, validation: str, bins: int = BINS) -> Prepared:
    """Rows binned for `grow`, by cuts of those where the boolean column `validation` is false."""
    learnt = rows.where(~F.col(validation))
    neg, pos = learnt.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
    edges = cut_points(learnt, features, bins)
    return Prepared(features, edges, _state(rows, features, label, validation, edges) if neg and pos else None, neg, pos)


#: Blocks: bins of each feature one after the other (a byte each), labels with 2 added to those of validation rows (a byte
#: each), and margins (doubles, of one model after the other; none while all are 0).
STATE = "x binary, y binary, margin binary"


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())


@contextmanager
def _few_blocks(spark: SparkSession):
    """Meanwhile Arrow batches have BATCH_BLOCKS rows at most."""
    before = spark.conf.get(BATCH_CONF)
    spark.conf.set(BATCH_CONF, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_CONF, before)


def _state(rows: DataFrame, features: list[str], label: str, validation: str, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of the rows, with margins 0."""

    def binned(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        raw = np.ascontiguousarray(matrix(batch.column(1), len(features)).T)
        x = np.stack([np.searchsorted(e, r) for e, r in zip(edges, raw)]).astype(np.uint8)
        x[np.isnan(raw)] = MISSING
        return x, batch.column(0).to_numpy().astype(np.uint8)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and len(batch):
                waiting.append(binned(batch))
                n += len(batch)
            while n >= BLOCK or n and batch is None:
                x, y = (np.concatenate([w[k] for w in waiting], axis=-1) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([_binary([x[:, :BLOCK]]), _binary([y[:BLOCK]]), _binary([np.zeros(0)])], names=["x", "y", "margin"])
                waiting, n = [(x[:, BLOCK:], y[BLOCK:])], max(0, n - BLOCK)

    y = F.col(label).cast("int") + 2 * F.col(validation).cast("boolean").cast("int")
    return kept(rows.select(y.alias("y"), packed(features).alias("x")).mapInArrow(take, STATE))


@dataclass
class Pass:
    """What a model asks of a pass over the blocks: sums of the training rows in the counted nodes of a tree, of the features
    in use, given trees that are not in the margins yet; on request also how validation rows fare."""

    columns: list[int]
    pending: list[Tree]
    tree: Tree
    counted: list[int]
    used: list[int]
    weight: float
    with_margins: bool

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((2, len(self.counted), len(self.columns), MISSING + 1), np.int64), np.zeros(2 * MARGINS, np.int64)

    def add(self, x: np.ndarray, y: np.ndarray, margin: np.ndarray | None, sums: np.ndarray, margins: np.ndarray) -> None:
        """Adds a block to the sums, and to the counts of validation rows [margin, label]."""
        unit, bins = UNIT / max(1.0, self.weight), MISSING + 1
        slot = np.full(len(self.tree.feature), -1)
        slot[self.counted] = np.arange(len(self.counted))
        x = x if self.columns == list(range(len(x))) else x[self.columns]
        node, val, y = slot.take(self.tree.binned(x)), y > 1, y & 1
        use = np.flatnonzero(~val & (node >= 0))
        if self.with_margins:  # of all rows
            margin = _margin(x, margin, self.pending)
            at = ((np.clip(margin[val], -EDGE, EDGE) + EDGE) * ((MARGINS - 1) / (2 * EDGE))).astype(np.int64)
            np.add.at(margins, 2 * at + y[val], 1)
            x, margin = x.take(use, axis=1), margin.take(use)
        else:
            x = x.take(use, axis=1)
            margin = _margin(x, None if margin is None else margin.take(use), self.pending)
        first, p, w = node.take(use) * bins, 1 / (1 + np.exp(-margin)), np.where(y.take(use) == 1, self.weight, 1.0)
        g, h = np.rint(unit * w * (p - y.take(use))), np.rint(unit * w * p * (1 - p))
        for f in self.used:
            at = first + x[f]
            for k, d in enumerate((g, h)):  # whole numbers below 2**53 in a block: sums of doubles are exact
                sums[k, :, f] += np.bincount(at, d, len(self.counted) * bins).astype(np.int64).reshape(-1, bins)


def _margin(x: np.ndarray, margin: np.ndarray | None, trees: list[Tree]) -> np.ndarray:
    out = np.zeros(x.shape[1]) if margin is None else margin.copy()
    for t in trees:
        out += np.array(t.value).take(t.binned(x))
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """x [feature, row], y and margins [model, row] of each block; None for margins that are all 0."""
    for x, y, margin in zip(*(batch.column(k) for k in range(3))):
        y = np.frombuffer(y.as_buffer(), np.uint8)
        shaped = lambda b, kind: np.frombuffer(b.as_buffer(), kind).reshape(-1, len(y))  # noqa: B023, E731
        yield shaped(x, np.uint8), y, shaped(margin, float) if len(margin.as_buffer()) else None


def _passed(state: DataFrame, passes: list[Pass | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each pass asks for, of one reading of the blocks; passes stand in the order of the margins, None for a model that
    asks for nothing."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [p and p.empty() for p in passes]
        for x, y, margins in itertools.chain.from_iterable(map(_blocks, batches)):
            for i, p in enumerate(passes):
                if p:
                    p.add(x, y, None if margins is None else margins[i], *found[i])
        for i, p in enumerate(passes):
            if p:
                sums, margins = found[i]
                sums = sums.reshape(2, -1)
                at = np.flatnonzero((sums != 0).any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["i", "at", "g", "h"])
                at = np.flatnonzero(margins)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(-1 - at), pa.array(margins[at]), pa.array(np.zeros(len(at), np.int64))], names=["i", "at", "g", "h"])

    with _few_blocks(state.sparkSession):
        found = state.mapInArrow(add, "i long, at long, g long, h long").groupBy("i", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # nodes x features x bins
    which, at, g, h = (found[c].to_numpy(np.int64) for c in ("i", "at", "g", "h"))
    out = []
    for i, p in enumerate(passes):
        if p:
            sums, margins = p.empty()
            inner, outer = (which == i) & (at >= 0), (which == i) & (at < 0)
            for k, d in enumerate((g, h)):
                sums[k].reshape(-1)[at[inner]] = d[inner]
            margins[-1 - at[outer]] = g[outer]
            out.append((np.moveaxis(sums, 0, -1), margins.reshape(MARGINS, 2)))
        else:
            out.append(None)
    return out


def _histograms(state: DataFrame, columns: list[int], pending: list[Tree], tree: Tree, counted: list[int], used: list[int], weight: float, with_margins: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number sums of first and second derivatives [counted node, feature, bin, 2] over training rows, of the features
    in use (0 for others), and, on request, counts of validation rows [margin, label]."""
    return _passed(state, [Pass(columns, pending, tree, counted, used, weight, with_margins)])[0]


def best_split(sums: np.ndarray, cuts: list[int], allowed: list[int], penalty: float, least: float) -> tuple[float, int, int, bool] | None:
    """gain, feature, bin and whether missing goes left, of the best split of a node with sums [feature, bin, 2]; the first at
    a tie. cuts: how many cuts each feature has."""
    best = None
    whole = sums[0].sum(0)
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + penalty)
    for f in allowed:
        lost = sums[f, MISSING]
        below = np.cumsum(sums[f, : cuts[f]], axis=0)
        for missing_left in (False, True):
            left = below + lost if missing_left else below
            right = whole - left
            ok = (left[:, 1] >= least) & (right[:, 1] >= least)
            gain = np.where(ok, score(left) + score(right) - score(whole), -np.inf)
            if len(gain) and gain.max() > (best[0] if best else 1e-9):
                best = (float(gain.max()), f, int(gain.argmax()), missing_left)
            if not lost.any():
                break
    return best


def average_precision(counts: np.ndarray) -> float:
    """Of counts [score, label] by ascending score: sum of recall steps times precision, ties in one step."""
    down = np.cumsum(counts[::-1], axis=0).astype(float)
    if not len(down) or not down[-1, 1]:
        return 0.0
    return float((counts[::-1, 1] / down[-1, 1] * down[:, 1] / np.maximum(1, down.sum(1))).sum())


def grow(rows: DataFrame, features: list[str], label: str, validation: str, rounds: int = 600, depth: int = 6, rate: float = 0.1, patience: int = 40, share: float = 0.8, penalty: float = 1.0, least: float = 1.0, bins: int = BINS, seed: int = 42) -> Model:
    """A model of the rows where the boolean column `validation` is false; the others say when to stop.

    The positive class weighs as much as the negative one. Each tree sees a share of the features. Of all rounds those up to
    the best average precision on validation rows are kept. Without validation rows all rounds are grown; without rows of
    both labels the model is a constant.
    """
    return grow_each(prepared(rows, features, label, validation, bins), [features], rounds=rounds, depth=depth, rate=rate, patience=patience, share=share, penalty=penalty, least=least, seed=seed)[0]


def grow_each(ready: Prepared, variants: list[list[str]], **growth) -> list[Model]:
    """What `grow` makes of each list of features; the models grow side by side, so that a pass over the rows serves all."""
    growths = [_growth(ready, features, **growth) for features in variants]
    models: list = [None] * len(growths)
    asked: list = [None] * len(growths)
    state, answers = ready.blocks, [None] * len(growths)
    while True:
        for i, growing in enumerate(growths):
            if models[i] is None:
                try:
                    asked[i] = growing.send(answers[i])
                except StopIteration as end:
                    asked[i], models[i] = None, end.value
        if not any(asked):
            return models
        waiting = [p.pending if p else [] for p in asked]
        if any(len(trees) >= REWRITE for trees in waiting):
            state = _rewritten(state, [p.columns if p else [] for p in asked], waiting)
            for trees in waiting:
                trees.clear()
        answers = [_histograms(state, p.columns, p.pending, p.tree, p.counted, p.used, p.weight, with_margins=p.with_margins) for p in asked] if len(asked) == 1 else _passed(state, asked)


def _growth(ready: Prepared, features: list[str], rounds: int = 600, depth: int = 6, rate: float = 0.1, patience: int = 40, share: float = 0.8, penalty: float = 1.0, least: float = 1.0, seed: int = 42) -> Generator[Pass, tuple[np.ndarray, np.ndarray], Model]:
    """Asks for one pass after the other and returns the model. Who drives it may clear the pending trees of a pass once they
    are in the margins."""
    columns = [ready.features.index(f) for f in features]
    model = Model(features, [ready.edges[c] for c in columns], 0.0, [], [])
    if ready.blocks is None:
        return model
    weight, n, r = ready.neg / ready.pos, len(features), np.random.default_rng(seed)
    cuts = [len(e) for e in model.edges]
    pending: list[Tree] = []
    for round_ in range(rounds + 1):
        tree = Tree()
        tree.add(0.0, 0.0)
        allowed, open_ = sorted(r.choice(n, max(1, round(share * n)), replace=False).tolist()), [0]
        used, whole, pairs, unit = sorted({0, *allowed}), {}, [], UNIT / max(1.0, weight)
        for level in range(depth):
            # of two siblings the one of less cover is counted; the other one is what is left of their parent
            counted = [a if tree.cover[a] <= tree.cover[b] else b for _, a, b in pairs] or open_
            units, margins = yield Pass(columns, pending, tree, counted, used, weight, with_margins=level == 0)
            known = dict(zip(counted, units))
            for parent, a, b in pairs:
                few, many = (a, b) if a in known else (b, a)
                known[many] = whole[parent] - known[few]
            whole, pairs, sums = known, [], [known[i] / unit for i in open_]
            if level == 0:  # the same pass says how good the model is so far
                checked = bool(margins.any())
                if round_:
                    model.validation.append(average_precision(margins))
                if round_ == rounds or round_ and checked and round_ - 1 - int(np.argmax(model.validation)) >= patience:
                    open_ = []
                    break
                tree.value[0], tree.cover[0] = _leaf(sums[0][0].sum(0), rate, penalty)
            later = []
            for s, node in zip(sums, open_):
                if found := best_split(s, cuts, allowed, penalty, least):
                    _, f, b, missing_left = found
                    left = s[f, : b + 1].sum(0) + s[f, MISSING] * missing_left
                    sides = [tree.add(*_leaf(x, rate, penalty)) for x in (left, s[f].sum(0) - left)]
                    tree.feature[node], tree.bin[node], tree.cut[node], tree.missing[node], tree.left[node], tree.right[node] = f, b, float(model.edges[f][b]), missing_left, *sides
                    later += sides
                    pairs.append((node, *sides))
            open_ = later
            if not open_:
                break
        if len(tree.feature) == 1:  # enough, or nothing to split
            break
        model.trees.append(tree)
        pending.append(tree)
    if model.validation and checked:
        model.trees = model.trees[: int(np.argmax(model.validation)) + 1]
    return model


def _leaf(sums: np.ndarray, rate: float, penalty: float) -> tuple[float, float]:
    return -rate * float(sums[0]) / (float(sums[1]) + penalty), float(sums[1])


def _rewritten(state: DataFrame, columns: list[list[int]], pending: list[list[Tree]]) -> DataFrame:
    """The blocks with the pending trees of each model in its margins."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.stack([_margin(x[c], None if margins is None else margins[i], trees) for i, (c, trees) in enumerate(zip(columns, pending))]) for x, _, margins in _blocks(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _binary(made)], names=["x", "y", "margin"])

    with _few_blocks(state.sparkSession):
        return kept(state.mapInArrow(add, STATE))


def scores(rows: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Rows with the probability of label 1; features that are null or NaN go where each split has learnt."""
    shared, n = rows.sparkSession.sparkContext.broadcast(model), len(model.features)

    @F.arrow_udf("double")
    def probability(x: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-shared.value.margin(matrix(x, n)))))

    return rows.withColumn(out, probability(packed(model.features)))


class Explainer:
    """Shapley values of a model's margin, path by path.

    Given a set of known features, a tree's leaf counts by the share of its cover that agrees with each unknown feature of
    its path, and in full or not at all for a known one. A path has at most as many features as the tree is deep, so its
    values are tabled for every pattern of features that let a row through: weights of subsets by size come from the product
    of (share + passes * t) over the other features. Paths that have at most TOGETHER nodes in all are summed into one table,
    for every pattern of sides at these nodes.
    """

    TOGETHER = 8

    def __init__(self, model: Model):
        self.model, self.tables = model, []
        for t in model.trees:
            found: list = []
            self._gather(t, 0, [], found)
            self.tables.append(found)

    def _gather(self, t: Tree, i: int, steps: list[tuple[int, bool]], found: list) -> None:
        """Adds (nodes, features, table [feature, pattern]) of the leaves below a node; bit k of a pattern: left at node k."""
        paths: list = []
        self._walk(t, i, steps, paths)
        nodes = sorted({n for path, *_ in paths for n, _ in path})
        if len(nodes) > self.TOGETHER and t.feature[i] >= 0:
            for child, left in ((t.left[i], True), (t.right[i], False)):
                self._gather(t, child, [*steps, (i, left)], found)
            return
        features = sorted({t.feature[n] for n in nodes})
        left = np.arange(1 << len(nodes))[:, None] >> np.arange(len(nodes)) & 1 == 1
        table = np.zeros((len(features), len(left)))
        for path, of, values in paths:
            passes = np.ones((len(of), len(left)), bool)
            for n, goes_left in path:
                passes[of.index(t.feature[n])] &= left[:, nodes.index(n)] == goes_left
            table[[features.index(f) for f in of]] += values[passes.T @ (1 << np.arange(len(of)))].T
        if features:
            found.append((nodes, features, table))

    def _walk(self, t: Tree, i: int, steps: list[tuple[int, bool]], found: list) -> None:
        if t.feature[i] >= 0:
            for child, left in ((t.left[i], True), (t.right[i], False)):
                self._walk(t, child, [*steps, (i, left)], found)
            return
        features = sorted({t.feature[n] for n, _ in steps})
        share = dict.fromkeys(features, 1.0)
        for n, left in steps:
            share[t.feature[n]] *= t.cover[t.left[n] if left else t.right[n]] / (t.cover[t.left[n]] + t.cover[t.right[n]])
        m = len(features)
        weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
        passes = np.arange(1 << m)[:, None] >> np.arange(m) & 1
        table = np.zeros((1 << m, m))
        for k, f in enumerate(features):
            size = np.ones((1 << m, 1))
            for q, other in enumerate(features):
                if q != k:
                    size = np.pad(size * share[other], ((0, 0), (0, 1))) + np.pad(size * passes[:, q : q + 1], ((0, 0), (1, 0)))
            table[:, k] = t.value[i] * (passes[:, k] - share[f]) * (size @ np.array(weight))
        found.append((steps, features, table))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """phi [row, feature] of raw features, NaN where missing; with the model's mean they add up to the margin."""
        phi = np.zeros(x.shape[::-1])
        for t, tables in zip(self.model.trees, self.tables):
            left = {i: (x[:, f] <= t.cut[i]) | np.isnan(x[:, f]) & t.missing[i] for i, f in enumerate(t.feature) if f >= 0}
            for nodes, features, table in tables:
                pattern = np.zeros(len(x), np.int64)
                for k, n in enumerate(nodes):
                    pattern += left[n] * np.int64(1 << k)
                for f, values in zip(features, table):
                    phi[f] += values.take(pattern)
        return np.ascontiguousarray(phi.T)


def explained(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """key, margin and phi (a value a feature, in the model's order) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(Explainer(model))
    n, kind = len(model.features), dict(rows.dtypes)[key]

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            x = matrix(batch.column(1), n)
            phi = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(x) + 1, n), pa.int32()), pa.array(of(x).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of.model.margin(x)), phi], names=[key, "margin", "phi"])

    return rows.select(key, packed(model.features).alias("x")).mapInArrow(explain, f"{key} {kind}, margin double, phi array<double>")


def importance(phis: DataFrame, features: list[str]) -> DataFrame:
    """feature and the mean size of its phi, the largest first in place; by name at a tie. One row a feature."""
    names = F.array(*[F.lit(f) for f in features])
    each = phis.select(F.posexplode("phi").alias("i", "phi")).groupBy("i").agg(F.avg(F.abs("phi")).alias("importance"))
    return each.select(F.element_at(names, F.col("i") + 1).alias("feature"), "importance")
