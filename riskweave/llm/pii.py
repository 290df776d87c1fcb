"""Personal data: candidate spans from high-recall generators, scored by gradient-boosted trees, cut at calibrated thresholds.

Spans of the base formats always stay. The generators also propose disguised or loosely formatted spans (an address with
"(at)" and "dot", a number without its plus sign, a card with odd separators, an IP with bracketed dots), which overlap
freely. Boosted trees judge each by its format and what stands around it; a calibrated probability over the kind's
threshold selects it. No table has labelled spans, so the trees learn from examples that are written by rule.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their order, and their base formats.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Examples of each class and kind that the trees learn from, and the precision that a threshold must reach on others.
EXAMPLES, PRECISION, SEED = 400, 0.99, 11

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses; the part before @ is found backwards, so long runs without @ cost nothing."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            before = text[free:at]
            n = len(before) - len(before.rstrip(LOCAL))
            if n:
                found.append((at - n, m.end()))
                at = free = m.end()
                at = text.find("@", at)
                continue
        free = at + 1
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the base formats, failing ones dropped without another try."""
    found = {"email": emails(text), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
            found["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                found["phone"].append(m.span())
    return found


AT = r"[\x20\t]{0,3}(?:[\[({<][\x20]?at[\x20]?[\])}>]|[\x20]at[\x20])[\x20\t]{0,3}"
DOT = r"[\x20\t]{0,3}(?:[\[({<][\x20]?dot[\x20]?[\])}>]|[\x20]dot[\x20]|\.)[\x20\t]{0,3}"
#: kind, what a text must hold for the generator to be run, and the generator.
GENERATORS = (
    ("email", re.compile(r"(?i)\bat\b"), re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,63}}){{1,3}}")),
    ("ip", re.compile(r"[0-9]\s?[\[({]"), re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\s?(?:[\[({]\s?(?:\.|dot)\s?[\])}]|\.)\s?[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"[0-9]{4}"), re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"[0-9]{3}"), re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"[0-9]{9}"), re.compile(r"(?<![0-9A-Za-z+])[0-9]{9,13}(?![0-9A-Za-z])")),
)
# Words that announce a kind.
HINTS = {
    "email": re.compile(r"(?i)(?:e-?mail|mail|contact|write|reach)\W{1,3}(?:\w+\W){0,3}$"),
    "ip": re.compile(r"(?i)(?:ip|host|server|address|addr|login)\W{1,3}(?:\w+\W){0,2}$"),
    "card": re.compile(r"(?i)(?:card|visa|mastercard|amex|credit|debit|cc)\W{1,3}(?:\w+\W){0,2}$"),
    "phone": re.compile(r"(?i)(?:tel|phone|call|fax|mobile|cell|whatsapp|number)\W{1,3}(?:\w+\W){0,2}$"),
}
ELSE = re.compile(r"(?i)(?:version|release|order|invoice|isbn|id|ref|no|page|section|date|part|serial|v)\W{0,3}$")


def candidates(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, gate, generator in GENERATORS if gate.search(text) for m in generator.finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    s, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 12]
    digits = only_digits(s)
    groups = [len(x) for x in re.findall(r"[0-9]+", s)]
    return [
        float(KINDS.index(kind)), float(len(s)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(13 <= len(digits) <= 19 and luhn(digits)), float(kind == "ip" and all(int(x) <= 255 for x in re.findall(r"[0-9]{1,3}", s))),
        float(bool(HINTS[kind].search(before))), float(bool(ELSE.search(before))), float(any(h.search(before) for k, h in HINTS.items() if k != kind)),
        float(s.startswith("0")), float("(" in s or "[" in s or "{" in s or "<" in s), float(len(set(re.findall(r"[^0-9A-Za-z]+", s)))),
        float(s.count(".")), float(s.count("-")), float(s.count("/")), float(s.count(" ")), float(bool(re.search(r"(?i)\bdot\b", s))),
        float(after[:1].isalnum()), float(before[-1:].isalnum()), float(after[:1] in "%$"), float(before[-1:] in "#$\"'=/"),
        float(len(re.findall(r"[A-Za-z]{2,4}$", s))), float(bool(groups) and len(set(groups)) == 1), float(groups[-1:] == [4] and groups[-2:-1] == [3]),
    ]


def examples(n: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """text, kind, start, end, label: written by rule, positives and look-alikes of each kind in turn."""
    r = random.Random(seed)
    word = lambda a=2, b=9: "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(a, b)))
    number = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = r.choice("3456") + number(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def unlike(k: int) -> str:
        while luhn(d := number(k)):
            pass
        return d

    in_fours = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, 16, 4))
    out = []
    for _ in range(n):
        octets = lambda top=255: [str(r.randint(1, top)) for _ in range(4)]
        at, dot = r.choice((" [at] ", " (at) ", "(at)", "[at]", " {at} ")), r.choice((" [dot] ", " (dot) ", ".", "(dot)", " dot "))
        area, three, four = number(3), number(3), number(4)
        made = {
            ("email", 1): [f"{word()}{r.choice(('.', '_', ''))}{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'io', 'de'))}", f"{word()} at {word()} dot {r.choice(('com', 'org', 'net'))}"],
            ("email", 0): [f"{word()} at {word()}. {word().title()}", f"{word()} at {word()}.{word(2, 4)}", f"{word()} at {r.randint(1, 12)}.{number(2)}"],
            ("ip", 1): [r.choice(("[.]", "(.)", "[dot]")).join(octets())],
            ("ip", 0): ["[.]".join(str(r.randint(256, 999)) for _ in range(4)), " . ".join(octets(20)), f"{r.randint(1, 9)} (. {r.randint(1, 9)}"],
            ("card", 1): [in_fours(card(), r.choice((".", "_", "/", "  ", " - ")))],
            ("card", 0): [in_fours(unlike(16), r.choice((".", "_", "/", "  ", " ", "-")))],
            ("phone", 1): [f"({area}) {three}-{four}", f"{area}-{three}-{four}", f"{area}.{three}.{four}", f"00{number(2)} {area} {three} {four}", number(10)],
            ("phone", 0): [f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(1900, 2030)}", f"{number(3)} {number(3)} {number(3)}", number(r.randint(9, 13)), f"{number(2)}-{number(5)}-{number(3)}", f"{number(4)} {number(4)} {number(4)} {number(4)}", f"{area} {three} {four}"],
        }
        hint = {"email": ("email: ", "contact ", "mail "), "ip": ("host ", "ip: ", "server "), "card": ("card ", "visa: "), "phone": ("tel: ", "phone ", "call ", "mobile: ")}
        for (kind, label), texts in made.items():
            s = r.choice(texts)
            bare = kind == "phone" and not (s.startswith("(") or "-" in s and len(s) == 12)
            told = r.random() < (1.0 if bare and label else 0.5 if label else 0.0)
            lead = r.choice(hint[kind]) if told else r.choice(("version ", "order ", "isbn ", "id: ", "no. ")) if not label and r.random() < 0.3 else word() + " "
            head = " ".join(word() for _ in range(r.randint(1, 5))) + " " + lead
            text = f"{head}{s}{r.choice((' ', '. ', ', ', ''))}{' '.join(word() for _ in range(r.randint(0, 4)))}"
            out += [(text, kind, a, b, label) for k, a, b in candidates(text) if k == kind and b > len(head) and a < len(head) + len(s)]
    return out


class BoostedTrees:
    """Logistic gradient boosting of small trees over a few features, with isotonic-like calibration in bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3):
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees, self.rate = [], rate
        score = np.full(len(y), self.bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            tree = self.grow(x, y - p, p * (1 - p), np.arange(len(y)), depth)
            self.trees.append(tree)
            score += rate * self.walk(tree, x)

    def grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        value = g[rows].sum() / (h[rows].sum() + 1.0)
        best = (1e-6, None, None)
        if depth and len(rows) >= 20:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
            for f in range(x.shape[1]):
                v = x[rows, f]
                for cut in np.unique(v)[:-1][:40]:
                    left = v <= cut
                    gl, hl, gr, hr = g[rows][left].sum(), h[rows][left].sum(), g[rows][~left].sum(), h[rows][~left].sum()
                    gain = gl**2 / (hl + 1.0) + gr**2 / (hr + 1.0) - whole
                    if gain > best[0]:
                        best = (gain, f, cut)
        if best[1] is None:
            return value
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self.grow(x, g, h, rows[left], depth - 1), self.grow(x, g, h, rows[~left], depth - 1)

    def walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, left, right = tree
        return np.where(x[:, f] <= cut, self.walk(left, x), self.walk(right, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum(self.walk(t, x) for t in self.trees)


def train(n: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION) -> tuple[BoostedTrees, tuple[float, float], dict[str, float]]:
    """The trees, the calibration (slope and intercept of a logistic curve, fitted on other examples), a threshold a kind."""
    learn, hold = examples(n, seed), examples(n, seed + 1)
    matrix = lambda rows: np.array([features(*r[:4]) for r in rows])
    label = lambda rows: np.array([r[4] for r in rows], dtype=float)
    model = BoostedTrees(matrix(learn), label(learn))
    raw, y = model.raw(matrix(hold)), label(hold)
    a, b = 1.0, 0.0
    for _ in range(300):  # Platt scaling by gradient descent
        p = 1 / (1 + np.exp(-(a * raw + b)))
        a, b = a - 0.5 * float(((p - y) * raw).mean()) / max(1.0, float((raw**2).mean())), b - 0.5 * float((p - y).mean())
    p = 1 / (1 + np.exp(-(a * raw + b)))
    kinds, cuts = np.array([r[1] for r in hold]), {}
    for kind in KINDS:
        of = kinds == kind
        good = [t for t in np.round(np.arange(0.5, 1.0, 0.01), 2) if (chosen := of & (p >= t)).any() and y[chosen].mean() >= precision]
        cuts[kind] = float(good[0]) if good else 1.0
    return model, (a, b), cuts


class Covered:
    """What base spans cover, as ascending ranges that don't overlap; a span is looked up by bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


def selected(text: str, base: dict[str, list[Span]], model: BoostedTrees, curve: tuple[float, float], cuts: dict[str, float]) -> dict[str, list[Span]]:
    """Candidates over their thresholds that overlap no base span and no better candidate."""
    covered = Covered([s for spans in base.values() for s in spans])
    proposed = [c for c in candidates(text) if not covered.meets(c[1], c[2])]
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not proposed:
        return found
    raw = model.raw(np.array([features(text, *c) for c in proposed]))
    p = 1 / (1 + np.exp(-(curve[0] * raw + curve[1])))
    taken: list[Span] = []  # ascending; none overlaps another
    for i in np.lexsort((np.arange(len(p)), -p)):
        kind, start, end = proposed[i]
        if p[i] >= cuts[kind]:
            at = bisect_left(taken, (end, end))
            if not at or taken[at - 1][1] <= start:
                insort(taken, (start, end))
                found[kind].append((start, end))
    return found


def rendered(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples_per_class: int = EXAMPLES, seed: int = SEED) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, kind:start:end in code points), redacted.

    redacted is the text with every span as its kind in angle brackets. A null or empty text has no spans and an empty
    redacted text. Rows that repeat an id keep a row each; a null id stays null; an empty table gives no rows. Other
    columns are not read.
    """
    learnt = docs.sparkSession.sparkContext.broadcast(train(examples_per_class, seed))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, curve, cuts = learnt.value
        digit = re.compile("[0-9]")
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text) if "@" in text or digit.search(text) else {k: [] for k in KINDS}
                more = selected(text, base, model, curve, cuts)
                every = {k: base[k] + more[k] for k in KINDS}
                clean, last = [], 0
                for a, b, k in sorted((a, b, k) for k in KINDS for a, b in every[k]):
                    if a >= last:
                        clean += [text[last:a], f"<{k}>"]
                    last = max(last, b)
                clean.append(text[last:])
                rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(every), "".join(clean)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
