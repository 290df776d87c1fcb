"""Plain single-process versions of the corpus operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def crc_mod(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(lowered(text))


def shingles(text, k=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near_duplicates(rows, k=5, percent=80):
    """doc_id: (n_shingles, component_id) of rows (doc_id, text) with distinct ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(rows, length=50):
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256) of rows (doc_id, text) with distinct ids."""
    first = {}
    data = {i: (t or "").encode() for i, t in rows}
    for i in sorted(data):
        for p in range(len(data[i]) - length + 1):
            first.setdefault(data[i][p : p + length], i)
    out = {}
    for i, x in data.items():
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if first[x[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out[i] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def base_scores(rows, folds=5, held_out=1):
    """doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)."""
    tokens = {i: [*words(t), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if crc_mod(i, folds) != held_out for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (crc_mod(i, folds) == held_out, len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """(kind, start, end) of the base matches."""
    text, out = text or "", []
    for kind, pattern in zip(KINDS, (EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": all(int(p[-4300:]) <= 255 and not p[:-4300].strip("0") for p in m[0].split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def auc(scores, labels):
    """Share of pairs of a 1 and a 0 that the scores order rightly."""
    order = sorted(scores)
    rank = {}
    for k, s in enumerate(order):
        rank.setdefault(s, []).append(k)
    rank = {s: sum(ks) / len(ks) for s, ks in rank.items()}
    ones = [rank[s] for s, y in zip(scores, labels) if y]
    zeros = len(labels) - len(ones)
    return (sum(ones) - len(ones) * (len(ones) - 1) / 2) / (len(ones) * zeros)


def damaged_rows(rows):
    """(conv_id, turn, role, text) after the damage that a hash of conversation and turn says."""
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of one conversation's rows (turn, role, text), by trying all edits of a row in all states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", ())}  # state: the least cost, its least audit, repaired turns

    def offer(into, state, made):
        if state not in into or made[:2] < into[state][:2]:
            into[state] = made

    def inserted(states):
        for _ in range(3):
            for s, (cost, audit, turns) in list(states.items()):
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (s, c) in follows:
                        offer(states, c, (cost + 2, audit + "I", (*turns, f"{name}:")))
        return states

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for s, (cost, audit, turns) in inserted(dict(best)).items():
            offer(new, s, (cost + 3, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (s, role[:1]) in follows:
                    offer(new, role[:1], (cost + extra, audit + "K", (*turns, f"{role}:{text}")))
                for c, name in (("u", "user"), ("a", "assistant")):
                    if (s, c) in follows:
                        offer(new, c, (cost + 2 + extra, audit + "R", (*turns, f"{name}:{text}")))
        best = new
    ends = inserted(dict(best))
    cost, audit, turns = min((ends[s] for s in ("", "a") if s in ends), key=lambda x: x[:2])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest()


def centroid_clusters(rows, k=16, rounds=3, scale=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of rows (vec_id, components), in order."""
    whole = lambda n, d: scale * n // d
    kept = [(i, [whole(*float(x).as_integer_ratio()) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: name(r[0]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n])] if n in own else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found]
