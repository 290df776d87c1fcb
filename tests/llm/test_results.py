"""Each corpus operator over a whole small table, against SQL, a plain version, or held-out labels."""

import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest

from riskweave.llm import queries as q
from riskweave.llm.common import table
from tests.llm import plain

SMALL, MORE, LABELLED = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"  # few of MORE have labels


def texts(spark, d):
    return [(r["doc_id"], r["text"]) for r in table(spark, d, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    df = q.queries()[name](spark, SMALL)
    want = con.sql(q.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name, label, folds, fold, least", [("op2_toxicity", "toxic", 3, 1, 0.95), ("op5_quality", "quality", 4, 2, 0.95)])
def test_classifier_on_held_out_labels(spark, name, label, folds, fold, least):
    rows = {r["doc_id"]: r for r in q.queries()[name](spark, LABELLED).collect()}
    assert len(rows) == table(spark, LABELLED, "documents").count()
    for i, r in rows.items():
        assert r["held_out"] == (plain.crc_mod(i, folds) == fold) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    known = [(rows[r["doc_id"]]["score"], r[label]) for r in table(spark, LABELLED, "labels").collect() if r["doc_id"] in rows and rows[r["doc_id"]]["held_out"] and r[label] is not None]
    assert plain.auc([s for s, _ in known], [y for _, y in known]) >= least


def test_pii_base(spark):
    found = {r["doc_id"]: r for r in q.op3_pii(spark, MORE).collect()}
    for i, text in texts(spark, MORE):
        spans = plain.base_spans(text)
        r = found[i]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        every = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        assert {(k, int(s), int(e)) for k, s, e in every} >= set(spans)
        for kind in plain.KINDS:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in spans)


def test_near_duplicates(spark):
    want = plain.near_duplicates(texts(spark, MORE))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op7_jaccard_join(spark, MORE).collect()} == want


def test_repeats(spark):
    want = plain.without_repeats(texts(spark, MORE))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in q.op8_suffix_dedup(spark, MORE).collect()}
    assert found == want


def test_lm_base_and_gain(spark):
    want = plain.base_scores(texts(spark, MORE))
    rows = q.op9_lm_scoring(spark, MORE).collect()
    assert {r["doc_id"] for r in rows} == set(want)
    model = base = 0.0
    for r in rows:
        held, n, known, total, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert math.isclose(r["base_score"], score, rel_tol=1e-9, abs_tol=1e-6)
        assert r["score"] <= 0 and math.isfinite(r["score"])
        if held:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base  # pairs of words tell more than words alone


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = q.op10_pack(spark, MORE).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts(spark, MORE)}
    want = {(i, p): (p * 4096, len(x[p * 4096 : (p + 1) * 4096]), zlib.crc32(np.array(x[p * 4096 : (p + 1) * 4096], "<u4").tobytes())) for i, x in ids.items() for p in range(-(-len(x) // 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(sequences) <= 1.02 * -(-sum(map(len, ids.values())) // 4096) + 1


def test_pipeline_stages(spark):
    """Each stage on its own input: decisions take effect, and rows and columns are those of documents."""
    import corpus_pipeline as p

    docs = table(spark, MORE, "documents")
    names = sorted(docs.columns)
    inputs = {}
    for name, stage in p.STAGES:
        inputs[name] = docs
        from riskweave.llm.common import stored

        docs = stored(stage(spark, docs, MORE))
        if name != "packing":
            assert sorted(docs.columns) == names
    ids = lambda d: [r[0] for r in d.select("doc_id").collect()]
    scored = {r["doc_id"]: r["predicted"] for r in q.op5_quality(spark, MORE).collect()}
    rejected = set(ids(inputs["quality"])) - set(ids(inputs["exact_dedup"]))
    assert rejected and all(not scored[i] for i in rejected)
    digests = {}
    for r in inputs["exact_dedup"].collect():
        digests.setdefault(" ".join(plain.re.split(r"[\x20\x09-\x0D]+", r["text"] or "")), []).append(r["doc_id"])
    assert sorted(ids(inputs["near_dedup"])) == sorted(min(v) for v in digests.values())
    near = plain.near_duplicates([(r["doc_id"], r["text"]) for r in inputs["near_dedup"].collect()])
    assert sorted(ids(inputs["mixing"])) == sorted(i for i, (_, c) in near.items() if i == c)
    assert set(ids(inputs["packing"])) <= set(ids(inputs["mixing"]))
    assert sum(r["piece"] == 0 for r in docs.collect()) == inputs["packing"].count()


@pytest.mark.parametrize("bits", [1 << 12, 1 << 19])  # neither words nor pairs fit the filter; words do
def test_lm_keeps_every_word_and_pair(spark, monkeypatch, bits):
    from riskweave.llm import lm_scoring as lm

    docs = texts(spark, SMALL)
    split = {i: [*plain.words(t), None] for i, t in docs}
    words, pairs = {}, {}
    for i, ws in split.items():
        if plain.crc_mod(i, 5) != 1:
            for a, b in zip([None, *ws], ws):
                words[b], pairs[a, b] = words.get(b, 0) + 1, pairs.get((a, b), 0) + 1
    near = lambda c: lm.EXPECTED[int(lm.levels(np.array([c]))[0])] if c else 0.0
    floor = sum(words.values()) + 0.5 * (len(words) + 1)
    monkeypatch.setattr(lm, "FILTER_BITS", bits)
    found = {r["doc_id"]: r["score"] for r in q.op9_lm_scoring(spark, SMALL).collect()}
    assert set(found) == set(split)
    for i, ws in split.items():
        want = 0.0
        for a, b in zip([None, *ws], ws):
            w, v, p = near(words.get(b)), near(words.get(a)), near(pairs.get((a, b)))
            want += math.log10(lm.PAIR_WEIGHT * min(p, v) / max(v, 1.0) + (1 - lm.PAIR_WEIGHT) * (w + 0.5) / floor)
        # the filter's false hits are all that may differ
        assert abs(found[i] - want) <= 0.02 * abs(want)


def test_quality_is_of_the_text_alone(spark):
    """Scores don't depend on rows beside, and training takes all passages and empty texts."""
    import pyarrow as pa

    from riskweave.llm import quality as ql

    long = " ".join(f"w{k % 977} said." for k in range(500 * ql.PASSAGE // 2))
    rows = ["alpha beta gamma delta.", " " * 500 + "one two", "\n\nthree  \n", None, "", "   ", long, "x" * 200]
    together = [x[a:b] for x, at in ql.Passages()(pa.array(rows)) for a, b in zip(at[:-1], at[1:])]
    assert [len(x) for x in together] == [1, 1, 1, 0, 0, 0, 500, 1]
    for text, x in zip(rows, together):
        alone = [y[a:b] for y, at in ql.Passages()(pa.array([text])) for a, b in zip(at[:-1], at[1:])]
        assert np.array_equal(alone[0], x)
    bags = [(x, k % 2) for k, x in enumerate(together * 4)]
    model = ql.fit(bags)
    assert model.fitted and np.isfinite(model.raw(np.zeros((0, ql.STATISTICS + ql.HASHED)), np.array([0, 0]))).all()


def test_word_tokens_equal_the_tokenizer():
    """20,000 random strings of letters, marks, capitals that lower-case to two characters, and punctuation."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from riskweave.llm.packing import WordTokens

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, ours = Tokenizer.from_file(path), WordTokens(path)
    r = random.Random(8)
    pool = "abcXYZ019éÉßİıǅﬁΣς你好ёйЙ́̇‍ـअ्๑½²Ⅷ①ªʰ😀_'’“.,!?*#%&$|;:<>()-@/\\\x00\x7f\xa0\x85 　 \t\n"
    cases = ["".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(20_000)] + ["かİ|#", "Xİ.", "</s> <unk>."]
    marks = [chr(c) for c in range(0x300, 0x370)] + ["\u0345", "\u3099", "\u0653", "\u0f71"]
    for _ in range(20_000):  # any letter of Unicode, marks behind it
        letter = chr(r.choice([r.randrange(65, 91), r.randrange(0xC0, 0x250), r.randrange(0x370, 0x2000), r.randrange(0x2000, 0xD800), r.randrange(0xE000, 0x110000)]))
        cases.append("".join(r.choice([letter, r.choice(marks), r.choice("aY J.,!")]) for _ in range(r.randint(1, 5))))
    cases += [c + chr(m) for c in "YJTHW" for m in range(0x300, 0x340)]
    wrong = [c for c in cases if ours(c.encode()) != np.array(tokenizer.encode(c, add_special_tokens=False).ids, "<u4").tobytes()]
    assert not wrong, wrong[:5]


def test_near_duplicates_of_a_large_group(spark):
    """2,000 near copies of one text, a template below the threshold, and pairs at its edge, against brute force."""
    import random

    r = random.Random(12)
    word = lambda: f"w{r.randrange(4000)}"
    copied, template = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for k in range(2000):
        w = list(copied)
        w[r.randrange(120)] = f"own{k}"
        rows.append((k, " ".join(w)))
    rows += [(3000 + k, " ".join(template + [word() for _ in range(25)])) for k in range(150)]
    for k in range(60):  # a tail of changing length: some pairs reach 80 %, some don't
        w = [word() for _ in range(100)]
        rows += [(4000 + 2 * k, " ".join(w)), (4001 + 2 * k, " ".join(w[: 80 + k % 16] + [word() for _ in range(10)]))]
    small = rows[:40] + rows[2000:]
    want = plain.near_duplicates(small)
    from riskweave.llm.jaccard_join import near_duplicates

    of = lambda x: {q["doc_id"]: (q["n_shingles"], q["component_id"]) for q in near_duplicates(spark.createDataFrame(x, "doc_id long, text string")).collect()}
    assert of(small) == want and len({c for _, c in want.values()}) > 200
    whole = of(rows)
    assert {whole[k][1] for k in range(2000)} == {0} and all(whole[i] == x for i, x in want.items())


@pytest.mark.parametrize("most", [32 << 20, 200])  # all queries in one broadcast; many rounds
def test_top_k_of_large_components_and_repeats(spark, monkeypatch, most):
    from riskweave.llm import topk

    r = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in r.normal(0, 1, 3)]) for k in range(300)] + [(1000, [1e6, 2e6, -3e6]), (1001, [1e6, -1e6, 70000.0]), (1002, []), (1050, []), (1003, []), (1100, [0.0] * 3), (1101, None), (1102, [math.inf] * 3), (7, [9.0] * 3), (7, [9.0] * 3), (50, [-9.0] * 3)]
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(map(math.isfinite, v))]
    want = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        x = min(v for i, v in ok if i == q)
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(x) == len(y))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    monkeypatch.setattr(topk, "BROADCAST_BYTES", most)
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, found)) == want
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")).collect()


def test_pii_of_long_digit_runs():
    from riskweave.llm import pii

    for text in ("0" * 5000 + "1.1.1.1", "1.1.1." + "0" * 5000 + "255", "9" * 5000 + ".1.1.1", "0" * 20_000, "1.2.3." + "0" * 6000):
        assert {(k, *s) for k, spans in pii.base_spans(text).items() for s in spans} == set(plain.base_spans(text))
        assert pii.selected(text, pii.base_spans(text), *pii.train(50, 1)) is not None


def test_repair_of_random_conversations(spark, monkeypatch):
    """Odd roles, nulls, ties, repeats and conversations that lie in several parts, against trying all edits."""
    import random

    from riskweave.llm import conversation_repair as cr

    r = random.Random(5)
    rows = []
    for conv in [*range(400), None]:
        n = r.choice([0, 1, 2, 3, 5, 8]) if conv != 7 else 700
        roles = r.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "tool", "assistant", "", None, "ugly", "System"]])
        for k in range(n):
            turn = r.choice([k, k, k, None, k // 2, 3 * k])
            rows.append((conv, turn, r.choice(roles), r.choice(["Yes.", "No! \n", "well", "so \t", "", " \n", None, f"text {k}.", f"text {k}"])))
    monkeypatch.setattr(cr, "PART_ROWS", 97)
    of = {}
    for c, t, role, text in rows:
        of.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    want = {c: plain.repair(of.get(c, [])) for c in [*range(400), None]}
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = cr.Repair(turns, spark.createDataFrame([(c,) for c in [*range(400), None]], "conv_id long"))
    assert done.pieces.where("conv_id = 7").count() > 3
    found = {x[0]: tuple(x)[1:] for x in done.report().collect()}
    assert found == want
    lines = {}
    for x in done.turns().orderBy("conv_id", "place").collect():
        lines.setdefault(x["conv_id"], []).append(f"{x['role']}:{x['text']}")
    assert all(hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == w[-1] for c, w in want.items())


def test_damage(spark):
    from riskweave.llm.conversation_repair import damaged

    rows = [(c, t, "assistant", "Is it? Yes. It is!") for c in [*range(60), None] for t in [*range(5), None]] + [(1, 2, None, None)]
    found = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain.damaged_rows(rows)))


def test_centroids_of_odd_vectors(spark):
    """Huge components, ties, repeated ids and vectors that take no part, against plain integers; few clusters are screened in."""
    from riskweave.llm import centroids as ct

    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in r.normal(0, 1, 64) + 6 * (k % 5)]) for k in range(300)]
    rows += [(7, [0.25] * 64), (7, [0.25] * 64), (None, [0.5] * 64), (400, [0.0] * 64), (401, [1.0] * 63), (402, None), (403, [math.nan] * 64), (404, [math.inf] + [0.0] * 63), (405, [-0.001] * 64)]
    for wide in ([], [(500, [1e30] * 64), (501, [-3e300] + [1.0] * 63), (502, [2.0**21] * 64), (503, [1e308] * 64), (504, [float(1 << 20)] * 64)]):
        want = plain.centroid_clusters(rows + wide)
        fits = lambda v: v if v < 1 << 63 else None
        # a sum with a distance that does not fit is null too
        lost = {n for _, n, d, *_ in want if d >= 1 << 63}
        want = [(i, n, fits(d), None if n in lost else fits(s), None if lost else fits(t), h) for i, n, d, s, t, h in want]
        found = ct.centroid_clusters(spark.createDataFrame(rows + wide, "vec_id long, embedding array<double>")).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    few = ct.centroid_clusters(spark.createDataFrame(rows[:5], "vec_id long, embedding array<double>")).collect()
    assert len({x["cluster"] for x in few}) == 5 and all(x["distance"] == 0 for x in few)
    x = np.floor(64 * np.array([v for _, v in rows[:300]])).astype(np.int64)
    near = ct.Nearest(x[:16].tolist(), 64)
    cluster, d = near.of_small(x, ct.block_norms(x).astype("<f4"))
    whole = ((x[:, None] - x[None, :16]) ** 2).sum(2)
    assert np.array_equal(cluster, whole.argmin(1)) and np.array_equal(d, whole.min(1)) and near.exact < 0.7 * whole.size


def test_minhash_duplicates(spark):
    want = plain.near_duplicates(texts(spark, MORE), 3, 85)
    found = q.op13_minhash_dedup(spark, MORE).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_minhash_of_large_groups(spark):
    """A group of near copies, a template below the threshold, sets at the edge and very small ones, against brute force."""
    import random

    from riskweave.llm.minhash_dedup import minhash_duplicates

    r = random.Random(21)
    word = lambda: f"w{r.randrange(3000)}"
    copied, template, rows = [word() for _ in range(150)], [word() for _ in range(60)], []
    for k in range(1500):
        w = list(copied)
        w[r.randrange(150)] = f"own{k}"
        rows.append((k, " ".join(w)))
    rows += [(3000 + k, " ".join(template + [word() for _ in range(25)])) for k in range(200)]
    for k in range(80):  # pairs about the threshold, long and short
        n = r.choice([9, 15, 22, 40, 90])
        w = [word() for _ in range(n)]
        rows += [(4000 + 2 * k, " ".join(w)), (4001 + 2 * k, " ".join(w[: n - r.randint(0, max(1, n // 8))] + [word() for _ in range(r.randint(0, max(1, n // 10)))]))]
    small = rows[:30] + rows[1500:]
    want = plain.near_duplicates(small, 3, 85)
    of = lambda x: {d["doc_id"]: (d["n_shingles"], d["component_id"]) for d in minhash_duplicates(spark.createDataFrame(x, "doc_id long, text string")).collect()}
    whole = of(rows)
    assert {whole[k][1] for k in range(1500)} == {0} and all(whole[i] == x for i, x in want.items())


@pytest.mark.parametrize("n", [1, 7, 60, 700, 9000])
def test_sketch_estimates_similarity(n):
    from riskweave.llm.minhash_dedup import band_keys, sketch

    r = np.random.default_rng(n)
    errors, shared = [], []
    for _ in range(30):
        base = r.integers(1, 1 << 63, n).astype(np.uint64)
        other = base.copy()
        changed = n // 13  # similarity about 0.86
        other[:changed] = r.integers(1, 1 << 63, changed).astype(np.uint64)
        a, b = sketch(np.sort(base)), sketch(np.sort(other))
        assert len(a) == 512 and (a != 0).all()
        errors.append((a == b).mean() - (n - changed) / (n + changed))
        shared.append(int((band_keys(np.sort(base)) == band_keys(np.sort(other))).sum()))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.12 and min(shared) > 0
