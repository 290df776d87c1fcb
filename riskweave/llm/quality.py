"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its word and byte statistics and hashed words; gated
attention, learnt from document labels alone, weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import WordHasher, _WS, byte_column, crc_mod, steps
from riskweave.llm.fitting import platt, sigmoid, training_rows

#: Words of a passage; hashed-word features; width of the encoding and of the attention; labelled rows fitted on, at most
#: (each with all its passages).
PASSAGE, HASHED, WIDTH, GATE, SAMPLE = 64, 32, 24, 16, 8_000
THRESHOLD = 0.7
STATISTICS = 14


def byte_classes() -> np.ndarray:
    """Class of each byte: white space, lower case, upper case, digit, sentence mark, other mark, beyond ASCII."""
    c = np.full(256, 5)
    c[_WS] = 0
    c[97:123], c[65:91], c[48:58], c[128:] = 1, 2, 3, 6
    c[[ord(x) for x in ".,;:'()-"]] = 4
    return c


_CLASS = byte_classes()


class Passages:
    """Feature rows of the passages of texts."""

    def __init__(self):
        self.hasher = WordHasher()

    def __call__(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per step: features (passages by STATISTICS + HASHED) and the passages' bounds for each text."""
        data, bounds = byte_column(column)
        for i, j in steps(bounds):
            part, at = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            h, words_at = self.hasher(part, at)
            counts = -(-np.diff(words_at) // PASSAGE)
            passages_at = np.concatenate([[0], np.cumsum(counts)])
            if not len(h):
                yield np.zeros((0, STATISTICS + HASHED), np.float32), passages_at
                continue
            doc = np.repeat(np.arange(len(counts)), np.diff(words_at))
            within = np.arange(len(h)) - words_at[doc]
            passage = passages_at[doc] + within // PASSAGE
            first = np.searchsorted(passage, np.arange(passages_at[-1]))
            n = np.diff(np.append(first, len(h))).astype(np.float32)
            black = ~_WS[part]
            starts = black.copy()
            cut = np.zeros(len(part) + 1, dtype=bool)
            cut[at] = True
            starts[1:] &= ~black[:-1] | cut[1 : len(part)]
            s = np.flatnonzero(starts)
            byte_first = s[first]
            # a row's last word and passage end where the row ends, so that a text's features are its own
            row_end = at[1:][doc]
            size = (np.minimum(np.append(byte_first[1:], len(part)), row_end[first]) - byte_first).astype(np.float32)
            classes = _CLASS[part]
            shares = [np.add.reduceat((classes == k).astype(np.float32), byte_first) / size for k in range(1, 7)]
            length = (np.minimum(np.append(s[1:], len(part)), row_end) - s).astype(np.float32)
            mean = np.add.reduceat(length, first) / n
            spread = np.sqrt(np.maximum(0, np.add.reduceat(length * length, first) / n - mean * mean))
            # words that the text has had before, in this passage or an earlier one, and words equal to the one before
            _, firsts = np.unique(h ^ (doc.astype(np.uint64) << np.uint64(40)), return_index=True)
            again = np.ones(len(h), dtype=np.float32)
            again[firsts] = 0
            same = np.zeros(len(h), dtype=np.float32)
            same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            short = (length <= 4).astype(np.float32)
            seen = [np.add.reduceat(x, first) / n for x in (again, same, short)]
            hashed = np.bincount(passage * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=len(n) * HASHED).reshape(-1, HASHED) / n[:, None]
            rank = (np.arange(len(n)) - np.repeat(passages_at[:-1], counts)).astype(np.float32)
            yield np.column_stack([*shares, np.log1p(mean), np.log1p(spread), *seen, np.log(n), np.log1p(rank), np.log1p(size), hashed]).astype(np.float32), passages_at


class GatedAttention:
    """Encoder, gated attention and scorer, as arrays; trained by Adam on bags with weights written out by hand."""

    def __init__(self, width: int, seed: int = 3):
        r = np.random.default_rng(seed)
        make = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.p = {"W": make(width, WIDTH), "b": np.zeros(WIDTH), "V": make(WIDTH, GATE), "U": make(WIDTH, GATE), "w": make(GATE, 1)[:, 0], "c": make(WIDTH, 1)[:, 0], "d": np.zeros(1)}
        self.curve, self.fitted = (1.0, 0.0), False

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int):
        p = self.p
        e = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(e @ p["V"]), sigmoid(e @ p["U"])
        a = (t * g) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, a)
        a = np.exp(a - top[bag])
        a = a / np.bincount(bag, weights=a, minlength=bags)[bag]
        z = np.zeros((bags, e.shape[1]))
        np.add.at(z, bag, a[:, None] * e)
        return e, t, g, a, z, z @ p["c"] + p["d"][0]

    def raw(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores of bags with bounds `at`; an empty bag has the representation zero."""
        bags = len(at) - 1
        bag = np.repeat(np.arange(bags), np.diff(at))
        return self.forward(x, bag, bags)[5]

    def train(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, rate: float = 0.01, batch: int = 128, seed: int = 4) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        r, m, v, t_ = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        sizes = np.diff(at)
        for _ in range(rounds):
            order = r.permutation(len(y))
            for k in range(0, len(y), batch):
                some = order[k : k + batch]
                n = sizes[some]
                rows = np.repeat(at[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                bag, xs = np.repeat(np.arange(len(some)), n), x[rows]
                p = self.p
                e, t, g, a, z, out = self.forward(xs, bag, len(some))
                d = (sigmoid(out) - y[some]) * weight[some] / len(some)
                dz = d[:, None] * p["c"]
                da = (dz[bag] * e).sum(1)
                ds = a * (da - np.bincount(bag, weights=a * da, minlength=len(some))[bag])
                dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
                de = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
                dh = de * (1 - e * e)
                grads = {"W": ((xs - self.mean) / self.scale).T @ dh, "b": dh.sum(0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "d": np.array([d.sum()])}
                t_ += 1
                for q, grad in grads.items():
                    grad = grad + 1e-4 * p[q]
                    m[q] = 0.9 * m[q] + 0.1 * grad
                    v[q] = 0.999 * v[q] + 0.001 * grad * grad
                    p[q] = p[q] - rate * (m[q] / (1 - 0.9**t_)) / (np.sqrt(v[q] / (1 - 0.999**t_)) + 1e-8)


def fit(rows: list[tuple[np.ndarray, int]]) -> GatedAttention:
    """A model from (passages, label) of the sample; a fifth is kept to calibrate on."""
    y = np.array([r[1] for r in rows], dtype=float)
    model = GatedAttention(STATISTICS + HASHED)
    if len(y) < 20 or y.min() == y.max() or not any(len(r[0]) for r in rows):
        model.p = {k: v * 0 for k, v in model.p.items()}
        model.p["d"] = np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
        return model
    held = np.arange(len(y)) % 5 == 0

    def bags(which: np.ndarray):
        chosen = [rows[i][0] for i in np.flatnonzero(which)]
        return np.concatenate(chosen).astype(float), np.concatenate([[0], np.cumsum([len(c) for c in chosen])])

    x, at = bags(~held)
    share = y[~held].mean()
    model.train(x, at, y[~held], np.where(y[~held] > 0.5, 0.5 / share, 0.5 / (1 - share)))
    model.curve, model.fitted = platt(model.raw(*bags(held)), y[held]), True
    return model


def learnt(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, sample: int, id_col: str, text_col: str) -> GatedAttention:
    """The model of at most `sample` labelled rows outside the held-out fold; the same whatever the order of rows."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages()
        for batch in batches:
            out = []
            for x, at in passages(batch.column(0)):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    out.append(x[a:b].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["x", "y"])

    found = training_rows(docs, labels, "quality", folds, held_out, sample, id_col, text_col).mapInArrow(gather, "x binary, y int").collect()
    found.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    order = np.random.default_rng(6).permutation(len(found))
    return fit([(np.frombuffer(found[i]["x"], "<f4").reshape(-1, STATISTICS + HASHED), found[i]["y"]) for i in order])


def probabilities(passages: Passages, model: GatedAttention, column: pa.Array) -> np.ndarray:
    slope, shift = model.curve
    raw = np.concatenate([np.zeros(0), *(model.raw(x, at) for x, at in passages(column))])
    return sigmoid(slope * raw + shift)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (calibrated, 0 to 1), predicted (score >= 0.7) of every document.

    Labels are learnt only from rows whose crc32(id) mod folds is not held_out, at most `sample` of them, picked by a hash
    of the id. A text without words is an empty bag, in training too, and is scored by the intercept; a null id hashes as
    the empty text and stays null. Without labels of both classes every score is the share of label 1 (0.5 if none). Rows
    that repeat an id are scored each, by their own texts alone; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, folds, held_out, sample, id_col, text_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages()
        for batch in batches:
            p = probabilities(passages, model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the classifier does not reject, with all their columns, decided row by row where they are read.

    Rows that repeat an id, or have none, are judged each by their own text. Labels that cannot be learnt from (fewer than
    20, or one class) reject nothing.
    """
    model = docs.sparkSession.sparkContext.broadcast(learnt(docs, labels, folds, held_out, sample, id_col, text_col))

    @F.arrow_udf("boolean")
    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        passages = Passages()
        for column in texts:
            yield pa.array((probabilities(passages, model.value, column) >= THRESHOLD) | (not model.value.fitted))

    return docs.where(good(text_col))  # the text alone goes to Python
