"""The pipeline's near-duplicate stage: 5-word shingles and a Jaccard index of 0.8."""

import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from lexiforge.llm import common, jaccard
from lexiforge.llm.common import materialise


def components(docs):
    return brute.components(docs, 5, 80)


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def copies():
    rng, rows = random.Random(11), []
    for n in (8, 12, 40, 120, 400, 1500):
        for _ in range(4):
            base = prose(rng, n)
            rows.append(base)
            rows.append(base + prose(rng, n // 5))  # appended
            rows.append(base[: n - n // 7])  # cut
            rows.append([f"n{rng.randrange(10**6)}" if k % 50 == 25 else w for k, w in enumerate(base)])  # edited
            rows.append([f"n{rng.randrange(10**6)}" if k % 20 == 10 else w for k, w in enumerate(base)])  # edited too much
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_stage_against_brute_force(spark):
    rows = copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = components(rows)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, root in want.items() if i == root}
    # the copies that 3 words and 0.9 leave
    assert len(kept) < sum(i == root for i, root in brute.components(rows).items())
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, jaccard.NEAR).collect()}
    assert found == want


def test_stage_on_the_provided_rows(spark):
    docs = materialise(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "test-near")
    want = components([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, root in want.items() if i == root}


@pytest.mark.parametrize("rule", [jaccard.NEAR, jaccard.OP6])
def test_linked_sets_share_a_block(rule):
    rng = np.random.default_rng(4)
    scale = jaccard.Scale(40, 4)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    levels = {}

    def blocks(found):
        key = jaccard.known_keys(found, rule, scale)
        level = np.array([levels.setdefault(k, int(rng.integers(1, 5))) for k in key.tolist()], np.uint8)
        return jaccard.posted(np.zeros(len(key), np.int64), key, level, np.array([len(found)]), rule)[1]

    for n in (1, 2, 4, 5, 7, 8, 9, 10, 11, 13, 19, 40, 137, 600, 2500):
        for _ in range(10):
            a = draw(n)
            for d in range(0, len(a) // 5 + 1, max(1, n // 40)):
                kept = np.sort(rng.permutation(a)[: len(a) - d])
                for b in (kept, np.unique(np.concatenate([kept, draw(d)])), np.unique(np.concatenate([a, draw(d)]))):
                    both = len(np.intersect1d(a, b))
                    if rule.den * both >= rule.num * (len(a) + len(b) - both):
                        assert len(np.intersect1d(blocks(a), blocks(b))), (n, d)


def test_overlaps_from_a_similar_set():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(100, 200)], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)])) for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, rng.integers(1, 30), dtype=np.uint64)) for _ in range(10)]
    both = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    size = np.array([len(a) for a in sets])
    for rule in (jaccard.OP6, jaccard.NEAR):
        assert (jaccard.linked(sets, rule) == (rule.den * both >= rule.num * (size[:, None] + size - both))).all()


def test_long_chains_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 60)] + [(5, 1059), (5000, 5001)]
    rng = random.Random(3)
    rng.shuffle(edges)
    out = {r["node"]: r["root"] for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {n: 5000 if n >= 5000 else 0 for e in edges for n in e}


def test_keys_that_hold_many_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 3 + [3, None, None, 9])], "k long, i long")
    values = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    out = sorted((r["i"], r["v"]) for r in common.attach(rows, values, ["k"], common.hot_keys(rows, ["k"], "test")).collect())
    assert out == [(i, {1: "a", 2: "b", 3: "c"}.get(k)) for i, k in enumerate([1] * 50 + [2] * 3 + [3, None, None, 9])]


def test_one_of_repeated_rows_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "x"), (1, text, "x"), (1, text, "x"), (2, text, "x"), (3, None, "x"), (4, "", "x"), (None, text, "x"), (5, text[:-4] + " zz", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep(docs, jaccard.NEAR).collect()), key=lambda x: x[0])
    assert kept == [(1, text), (3, None), (4, "")]
