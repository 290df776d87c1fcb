"""Toxicity by weak supervision.

Many lexicon voters (groups of words and word beginnings) and pattern voters (shouting, masking, repetition) vote on
training rows. A lexicon comes from the labels of other rows than those it votes on, so no vote knows its row's own label.
A generative model of the unknown truth sees the votes alone and estimates how accurate each voter is and which voters
depend on each other, as a tree over the voters, by expectation maximisation. Linear classifiers then learn from the
posterior labels, each with a part of the sample left out, and their average scores every whole text. Given labels choose the lexicon entries, tell the share of toxic rows that
the estimation starts from, and calibrate: the posterior by two numbers, the score on rows left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Powers, byte_column, crc_mod, mix, steps
from riskweave.llm.common import _BYTE, _LOWER, _R, _R_INV
from riskweave.llm.fitting import logistic, platt, sigmoid, training_rows

#: Labelled rows that are fitted on, at most; buckets of hashed features; lexicon entries and the voters that share them.
SAMPLE, BUCKETS, ENTRIES, LEXICONS = 9_000, 1 << 20, 96, 24
#: A lexicon entry's toxic share less one standard error is at least this; parts of the sample, each left out once. ENTRIES,
#: SURE and CLEAR have the largest AUC on left-out parts of training rows alone, of 96 to 384, 0.35 to 0.8 and 2 to 4.
SURE, PARTS = 0.35, 5
#: Bytes of word beginnings that count as features beside whole words.
STARTS = (4, 5, 6)
#: A feature in fewer training documents is not used; standard errors from the base rate that make one clear.
LEAST, CLEAR = 5, 2.0
THRESHOLD = 0.7

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS = mix(np.arange(1, 8, dtype=np.uint64) * np.uint64(77))
PATTERNS = 8


class TextFeatures:
    """Distinct hashed words and word beginnings of each text, and what the pattern voters see of it."""

    def __init__(self, buckets: int = BUCKETS):
        self.up, self.down, self.buckets = Powers(_R), Powers(_R_INV), buckets

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per step: row of each distinct (row, bucket), its bucket, and the rows' pattern votes."""
        data, bounds = byte_column(column)
        for i, j in steps(bounds):
            part, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            n, rows = len(part), j - i
            if not n:
                yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((rows, PATTERNS), np.int8)
                continue
            word = _ALNUM[part]
            cut = np.zeros(n + 1, dtype=bool)
            cut[at] = True
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1] | cut[1:n]
            last[:-1] &= ~word[1:] | cut[1:n]
            s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE[_LOWER[part]] * self.up.upto(n), out=total[1:])
            down = self.down.upto(n)[s]
            row = (np.searchsorted(at, s, side="right") - 1).astype(np.uint64)
            keys = [(mix((total[e] - total[s]) * down ^ _KINDS[0]) % np.uint64(self.buckets)) | row << np.uint64(32)]
            for k, size in enumerate(STARTS):
                long = e - s > size
                keys.append((mix((total[s[long] + size] - total[s[long]]) * down[long] ^ _KINDS[k + 1]) % np.uint64(self.buckets)) | row[long] << np.uint64(32))
            keys = np.unique(np.concatenate(keys))
            yield (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), self.patterns(part, at, s, e)

    @staticmethod
    def patterns(part: np.ndarray, at: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """1 where a pattern is there, else 0, for each row: shares of byte classes and of odd words."""
        size = np.maximum(1, np.diff(at))

        def share(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[at]) / size

        at_words = np.searchsorted(s, at)
        words = np.maximum(1, np.diff(at_words))
        of = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at_words]) / words
        upper, lower = share((part >= 65) & (part <= 90)), share((part >= 97) & (part <= 122))
        same = np.zeros(len(part), dtype=bool)
        same[2:] = (part[2:] == part[1:-1]) & (part[1:-1] == part[:-2]) & _ALNUM[part[2:]]
        seen = [upper > lower, share(part == 33) > 0.005, share(part == 42) > 0.01, share((part == 35) | (part == 36) | (part == 37) | (part == 38)) > 0.02, share(same) > 0.001, of(e - s > 25) > 0.01, np.diff(at_words) < 15, share((part == 64) | (part == 63)) > 0.003]
        return np.stack(seen, 1).astype(np.int8)


class LabelModel:
    """P(truth) and P(vote | truth, parent's vote) of three-valued votes, parents forming a tree; fitted by EM."""

    def __init__(self, votes: np.ndarray, start: np.ndarray, rounds: int = 15):
        self.parent = np.full(votes.shape[1], -1)
        q = start
        for k in range(2):
            for _ in range(rounds):
                self.maximise(votes, q)
                q = self.posterior(votes)
            if not k:
                self.parent = self.tree(votes, q)
        self.maximise(votes, q)

    def maximise(self, votes: np.ndarray, q: np.ndarray) -> None:
        self.prior = np.clip(np.array([1 - q.mean(), q.mean()]), 1e-4, 1)
        self.tables = []
        for j, p in enumerate(self.parent):
            t = np.full((2, 3, 3), 0.2)
            of = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=int)
            for y, w in ((0, 1 - q), (1, q)):
                t[y] += np.bincount(of * 3 + votes[:, j], weights=w, minlength=9).reshape(3, 3)
            self.tables.append(np.log(t / t.sum(2, keepdims=True)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        like = np.log(self.prior)[None, :].repeat(len(votes), 0)
        for j, p in enumerate(self.parent):
            of = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=int)
            like += self.tables[j][:, of, votes[:, j]].T
        return sigmoid(like[:, 1] - like[:, 0])

    @staticmethod
    def tree(votes: np.ndarray, q: np.ndarray, least: float = 2e-3) -> np.ndarray:
        """Each voter's parent in the tree of greatest dependence given the truth; -1 where dependence is slight."""
        m = votes.shape[1]
        info = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                for w in (1 - q, q):
                    joint = np.bincount(votes[:, i] * 3 + votes[:, j], weights=w, minlength=9).reshape(3, 3) + 1e-6
                    joint, share = joint / joint.sum(), w.mean()
                    info[i, j] += share * (joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum()
                info[j, i] = info[i, j]
        parent, inside = np.full(m, -1), {0} if m else set()
        while len(inside) < m:
            i, j = max(((i, j) for i in range(m) if i not in inside for j in inside), key=lambda x: info[x])
            parent[i] = j if info[i, j] > least else -1
            inside.add(i)
        return parent


def lexicon(column: np.ndarray, label: np.ndarray, share: float, buckets: int) -> np.ndarray:
    """Voter of each bucket, -1 where none, from pairs of a bucket in a row and that row's label.

    Entries are the features that the labels make surest; they are dealt to the voters by rank, so voters are alike.
    """
    held, toxic = np.bincount(column, minlength=buckets), np.bincount(column, weights=label, minlength=buckets)
    clear = (held >= LEAST) & (toxic - held * share > 3.0 * np.sqrt(held * share * (1 - share)))
    p = (toxic + share) / (held + 1)
    sure = np.where(clear, p - np.sqrt(p * (1 - p) / (held + 1)), 0.0)
    entries = np.argsort(-sure, kind="stable")[:ENTRIES]
    entries = entries[sure[entries] >= SURE]
    voter = np.full(buckets, -1)
    voter[entries] = np.arange(len(entries)) % LEXICONS
    return voter


def cast_votes(row: np.ndarray, column: np.ndarray, patterns: np.ndarray, y: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    """Votes on each row (0 abstains, 1 toxic, 2 clean) by lexicons of the other parts but the first, and by patterns.

    The last voter says clean where no lexicon voter says anything.
    """
    n = len(y)
    votes = np.zeros((n, LEXICONS + PATTERNS + 1), dtype=np.int64)
    for k in range(1, PARTS):
        others = (part != k) & (part != 0)
        mine = others[row]
        voter = lexicon(column[mine], y[row[mine]], y[others].mean() if others.any() else 0.5, buckets)
        hit = (part == k)[row] & (voter[column] >= 0)
        votes[row[hit], voter[column[hit]]] = 1
    votes[:, LEXICONS : LEXICONS + PATTERNS] = patterns
    votes[:, -1] = np.where(votes[:, :LEXICONS].any(1), 0, 2)
    return votes


def taught(row: np.ndarray, column: np.ndarray, patterns: np.ndarray, y: np.ndarray, part: np.ndarray, buckets: int) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear classifier of the posterior labels of all parts but the first."""
    learn = part != 0
    inside, number, n = learn[row], np.cumsum(learn) - 1, int(learn.sum())
    votes = cast_votes(row, column, patterns, y, part, buckets)[learn]
    # the estimation starts from the rows with most lexicon votes, about as many as labels say are toxic
    said = votes[:, :LEXICONS].sum(1)
    model = LabelModel(votes, np.where(said >= max(1.0, np.quantile(said, 1 - y[learn].mean())), 0.9, 0.1))
    found = model.posterior(votes)
    odds = np.log(np.clip(found, 1e-9, 1) / np.clip(1 - found, 1e-9, 1))
    slope, shift = platt(odds, y[learn])  # two numbers set the posterior's level; its order is the label model's
    posterior = sigmoid(slope * odds + shift)
    # the linear classifier sees the features whose posterior share stands clear of the base rate, either way
    held = np.bincount(column[inside], minlength=buckets)
    mass = np.bincount(column[inside], weights=posterior[number[row[inside]]], minlength=buckets)
    base = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
    clear = (held >= LEAST) & (np.abs(mass - held * base) > CLEAR * np.sqrt(held * base * (1 - base)))
    used, code = inside & clear[column], np.cumsum(clear) - 1
    w = np.zeros(buckets)
    w[clear], b = logistic(number[row[used]], code[column[used]], n, int(clear.sum()), posterior, np.ones(n))
    return w, b


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS) -> tuple[np.ndarray, float, tuple[float, float]]:
    """Weights, intercept and calibration from (buckets, patterns, label) of the sample.

    Each part is left out once; the classifiers are averaged and calibrated on the scores of the parts that each left out.
    """
    y = np.array([r[2] for r in rows], dtype=float)
    if len(y) < 20 or y.min() == y.max():
        return np.zeros(buckets), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))), (1.0, 0.0)
    n, patterns = len(rows), np.stack([r[1] for r in rows])
    row, column = np.repeat(np.arange(n), [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows])
    weights, intercept, raw = np.zeros(buckets), 0.0, np.zeros(n)
    for k in range(PARTS):
        part = (np.arange(n) + k) % PARTS
        w, b = taught(row, column, patterns, y, part, buckets)
        out = part == 0
        raw[out] = (np.bincount(row, weights=w[column], minlength=n) + b)[out]
        weights, intercept = weights + w / PARTS, intercept + b / PARTS
    return weights, intercept, platt(raw, y)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (calibrated, 0 to 1), predicted (score >= 0.7) of every document.

    Labels are learnt only from rows whose crc32(id) mod folds is not held_out, at most `sample` of them, picked by a hash
    of the id. A null or empty text has no features and is scored by the intercept; a null id hashes as the empty text and
    stays null. Without labels of both classes every score is the share of label 1 (0.5 if none). Rows that repeat an id
    are scored each; an empty table gives no rows.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = TextFeatures()
        for batch in batches:
            buckets, patterns = [], []
            for row, column, seen in features(batch.column(0)):
                buckets += [x.tobytes() for x in np.split(column.astype("<u4"), np.searchsorted(row, np.arange(1, len(seen))))]
                patterns += [x.tobytes() for x in seen]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.binary()), pa.array(patterns, pa.binary()), batch.column(1)], names=["buckets", "patterns", "y"])

    found = training_rows(docs, labels, "toxic", folds, held_out, sample, id_col, text_col).mapInArrow(gather, "buckets binary, patterns binary, y int").collect()
    found.sort(key=lambda r: (bytes(r["buckets"]), r["y"]))  # the same model whatever the order of rows
    order = np.random.default_rng(5).permutation(len(found))
    weights, intercept, curve = fit([(np.frombuffer(found[i]["buckets"], "<u4").astype(np.int64), np.frombuffer(found[i]["patterns"], np.int8), found[i]["y"]) for i in order])
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), intercept, curve))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, (w, b, (slope, shift)) = TextFeatures(), model.value
        for batch in batches:
            raw = [np.bincount(row, weights=w[column], minlength=len(seen))[: len(seen)] for row, column, seen in features(batch.column(1))]
            p = sigmoid(slope * (np.concatenate([np.zeros(0), *raw]) + b) + shift)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "predicted")
