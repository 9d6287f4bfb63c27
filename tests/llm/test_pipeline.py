"""The pipeline's stages on the smallest documents, each against a plain version on its own input."""

import hashlib

import brute
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from lexiforge.llm import bpe, mixing
from lexiforge.llm.common import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_keeps_what_has_letters(stages):
    before, after = texts(stages[0]), texts(stages[1])
    assert all(after[i] == before[i] for i in after)
    assert all(any(c.isalpha() for c in t) for t in after.values())
    assert len(after) >= 0.98 * len(before)


def test_quality_drops_what_fails(stages):
    before, after = texts(stages[1]), texts(stages[2])
    for i, t in before.items():
        n, _, _, _, repeats = brute.quality(t)
        if n < 50 or 100 * repeats > 50 * n:
            assert i not in after
    # no line is common here: what passes the base rules stays
    assert after == {i: t for i, t in before.items() if not (brute.quality(t)[0] < 50 or 100 * brute.quality(t)[4] > 50 * brute.quality(t)[0])}


def test_one_of_each_group_stays(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(after) == {i for i, root in brute.components(list(before.items()), 5, 80).items() if i == root}


def test_mix_takes_each_document_as_often_as_planned(stages):
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.taken(stages[3]).collect() if r["taken"]}
    assert {r["doc_id"]: r["count"] for r in stages[4].groupBy("doc_id").count().collect()} == taken


def test_encoding(stages):
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    known, rows = texts(stages[4]), stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows:
        ids = tokenizer.encode_ordinary(known[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(known[r["doc_id"]].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r["doc_id"], r["ids_sha256"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])
