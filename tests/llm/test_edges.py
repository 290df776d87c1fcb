"""Nulls, empty and very long texts, ties, repeated rows, clashing column names and empty tables, for every corpus operator."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm.centroids import centroid_clusters
from riskweave.llm.conversation_repair import Repair, damaged
from riskweave.llm.exact_dedup import exact_dedup, without_copies
from riskweave.llm.jaccard_join import near_duplicates, one_of_each
from riskweave.llm.lm_scoring import lm_scores
from riskweave.llm.minhash_dedup import minhash_duplicates
from riskweave.llm.mixing import mix_sources, mixed
from riskweave.llm.packing import pack
from riskweave.llm.pii import find_pii
from riskweave.llm.quality import accepted, quality
from riskweave.llm.suffix_dedup import without_repeats
from riskweave.llm.topk import top_k
from riskweave.llm.toxicity import toxicity
from tests.llm import plain

#: Names that the operators use inside stand beside the documents' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, part int, text_sha256 string, component string, y int, toxic int, keep_id long"
LONG = " ".join(f"word{k * 7919 % 5003}" for k in range(60_000))
TEXTS = [(1, "a b c d e f g"), (2, "a b  c d e f g"), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG + " more"), (8, "ä ß 你好 A B"), (9, "a b c d e f g"), (9, "a b c d e f g"), (10, "one"), (None, "a b c d e f g"), (11, "mail x@y.org, +49 30 1234567 now")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, None if (i or 0) % 2 else "s", None, 1, 1, "x", "x", 1, 1, 1) for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, None), (6, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


TOKENS = public_tokenizers.path(corpus_pipeline.TOKENIZER)
OF_DOCS = {
    "minhash": minhash_duplicates, "exact": exact_dedup, "copies": without_copies, "near": near_duplicates, "one": one_of_each, "lm": lm_scores, "mix": mix_sources, "pack": lambda d: pack(d, TOKENS), "pii": find_pii, "repeats": without_repeats,
}


@pytest.mark.parametrize("name", sorted(OF_DOCS))
def test_empty_table(spark, docs, name):
    assert OF_DOCS[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("of", [quality, toxicity, accepted])
def test_empty_tables_of_classifiers(docs, labels, of):
    assert of(docs.limit(0), labels).collect() == []
    kept = of(docs, labels.limit(0)).collect()  # no labels: one score for all
    assert of is accepted or len(kept) == len(TEXTS) and len({r["score"] for r in kept}) == 1


def test_exact(docs):
    found = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert (found[2]["keep_id"], found[2]["group_size"], found[2]["kept"]) == (1, 5, False) and found[1]["kept"] and not found[None]["kept"]
    assert (found[4]["keep_id"], found[4]["group_size"]) == (3, 2) and found[5]["keep_id"] == 5
    assert found[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sorted(r["doc_id"] for r in without_copies(docs).collect()) == [1, 3, 5, 6, 7, 8, 10, 11]


def test_near(docs):
    found = near_duplicates(docs).collect()
    assert len(found) == len(TEXTS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert by[9] == (3, 1) and by[3] == (0, 3) and by[5] == (0, 5) and by[7][1] == 6 and by[10] == (1, 10) and by[None] == (3, 1)
    assert by[6][0] == len(plain.shingles(LONG))


def test_repeats(docs):
    found = {r["doc_id"]: r for r in without_repeats(docs).collect()}
    assert (found[3]["n_bytes"], found[3]["n_removed"]) == (0, 0) and found[6]["n_removed"] == plain.without_repeats([(6, LONG)])[6][1]
    # LONG repeats itself, so its last words with a space after them are in it too
    assert found[7]["n_removed"] == len(LONG) + 1 and found[7]["n_spans"] == 1 and found[7]["kept_sha256"] == hashlib.sha256(b"more").hexdigest()


def test_lm(docs):
    found = lm_scores(docs).collect()
    assert len(found) == len(TEXTS) and all(r["score"] <= 0 for r in found) and {r["n_tokens"] for r in found if r["doc_id"] in (3, 4, 5)} == {1}


def test_pack(docs):
    found = pack(docs, TOKENS).collect()
    assert {r["doc_id"] for r in found} == {i for i, _ in TEXTS} and [r["length"] for r in found if r["doc_id"] in (3, 4)] == [1, 1]
    assert sum(r["doc_id"] == 6 for r in found) > 10 and all(r["offset"] + r["length"] <= 4096 for r in found)


def test_pii(docs):
    found = {r["doc_id"]: r for r in find_pii(docs).collect()}
    assert (found[11]["n_email"], found[11]["n_phone"]) == (1, 1) and found[3]["spans"] == ""


def test_mix(docs):
    found = mix_sources(docs.select("doc_id", "text", "source", "node"), {"s": 1.0, None: 0.0}, total=100)
    assert {r["source"] for r in found.collect()} == {"s"}
    assert mix_sources(docs.select("doc_id", "text", "source"), {"s": 0.0, None: 0.0}).collect() == [] == mix_sources(docs.select("doc_id", "text", "source"), {}).collect()
    keys = [r["shuffle_key"] for r in found.collect()]
    assert keys == sorted(keys)


def test_top_k(spark):
    rows = [(0, [0.5, 0.5]), (50, [0.5, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.5, 0.5]), (6, [1.0, -1.0])]
    v = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int")
    found = sorted(tuple(r) for r in top_k(v).select("query_id", "rank", "vec_id", "score").collect())
    assert found[:3] == [(0, 1, 5, 32768), (0, 2, 50, 32768), (0, 3, 6, 0)] and [r[2] for r in found[3:]] == [0, 5, 6]
    assert top_k(v.limit(0)).collect() == []


def test_accepted_judges_rows_not_ids(spark):
    """Repeated and null ids go by their own texts; labels that teach nothing reject nothing."""
    good, bad = " ".join(f"The river number {k} flows to the sea, slowly." for k in range(30)), "buy buy BUY !!! $$$ " * 40
    train = spark.createDataFrame([(k, (good if k % 2 else bad) + f" {k}", k) for k in range(200)], "doc_id long, text string, of long")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(900, good, 1), (900, bad, 2), (None, bad, 3), (None, good, 4), (901, good, 5), (901, good, 6)], train.schema)
    kept = {r["of"] for r in accepted(train.unionByName(more), labels).where("doc_id is null or doc_id >= 900").collect()}
    assert kept == {1, 4, 5, 6}
    assert accepted(more, labels.limit(5)).count() == 6


def test_clashing_names(spark, docs):
    """Columns called as what the operators make or use: replaced where they make it, kept as they are elsewhere."""
    d = docs.select("doc_id", "text", "source", F.lit("mine").alias("copy"), F.lit("mine").alias("Shuffle_Key"), F.lit("mine").alias("digest"), F.lit("mine").alias("gone_id"), F.lit("mine").alias("n"), F.lit("mine").alias("row"), F.lit("mine").alias("u"))
    found = mix_sources(d).collect()
    assert found and all(isinstance(r["copy"], int) and isinstance(r["shuffle_key"], int) and {r[c] for c in ("digest", "gone_id", "n", "row", "u")} == {"mine"} for r in found)
    assert {tuple(r)[3:] for r in mixed(d).collect()} == {("mine",) * 7} and mixed(d).columns == d.columns
    for of in (without_copies, one_of_each):
        kept = of(d)
        assert kept.columns == d.columns and {tuple(r)[3:] for r in kept.collect()} == {("mine",) * 7}


def test_minhash(docs):
    found = minhash_duplicates(docs).collect()
    assert len(found) == len(TEXTS)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found}
    assert by[9] == (5, 1, False) and by[3] == (0, 3, True) and by[5] == (0, 5, True) and by[7][1] == 6 and by[10] == (1, 10, True) and by[None] == (5, 1, False)
    assert by[6][0] == len(plain.shingles(LONG, 3))


def test_new_operators_on_empty_tables_and_clashing_names(spark):
    turns = "conv_id long, turn long, role string, text string, part int, pos long, kind int, own int, at long, code long, copy int, figures string, said string"
    empty = spark.createDataFrame([], turns)
    assert Repair(damaged(empty), empty).report().collect() == [] and Repair(damaged(empty), empty).turns().collect() == []
    rows = [(1, 0, "user", "Hi.", *[1] * 7, "x", "x"), (1, 1, "assistant", "Yes.", *[1] * 7, "x", "x"), (2, None, None, None, *[1] * 7, "x", "x")]
    found = {r["conv_id"]: tuple(r)[1:-1] for r in Repair(spark.createDataFrame(rows, turns)).report().collect()}
    assert found == {1: (0, 0, 0, 0, 0, 0, "KK"), 2: (0, 1, 0, 0, 0, 3, "D")}
    vectors = "vec_id long, embedding array<float>, x int, h string, small int, wide int, norms int, cluster int, distance int"
    assert centroid_clusters(spark.createDataFrame([], vectors)).collect() == []
    assert [tuple(r)[:5] for r in centroid_clusters(spark.createDataFrame([(3, [0.5] * 64, 1, "x", 1, 1, 1, 9, 9)], vectors)).collect()] == [(3, 0, 0, 0, 0)]
