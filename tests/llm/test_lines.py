"""Lines that many documents of a host share."""

import random

import pytest

from lexiforge.llm import quality


def prose(rng, n):
    return " ".join(f"w{rng.randrange(9000)}" for _ in range(n))


def boilerplate(others, hot):
    """40 documents that are mostly a menu, and ``others`` on their host or, if not ``hot``, on hosts of 500."""
    rng = random.Random(7)
    menu = "\n".join(prose(rng, 15) for _ in range(4))
    rows = [(i, f"{menu}\n{prose(rng, 8)}", "host") for i in range(40)]
    page = prose(rng, 60)  # exact copies among the others
    return rows + [(100 + i, page if i % 3 == 0 else prose(rng, 60), "host" if hot else f"h{i // 500}") for i in range(others)]


@pytest.mark.parametrize(("others", "hot"), [(500, False), (6000, False), (500, True), (6000, True)])
def test_boilerplate_is_found_at_any_size_of_its_host(spark, others, hot):
    docs = spark.createDataFrame(boilerplate(others, hot), "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert {i for i, r in out.items() if not r["kept"]} == set(range(1, 40))
    assert all(r["n_removed"] == (60 if 0 < i < 40 else 0) for i, r in out.items())


@pytest.mark.parametrize("columns", ["doc_id long, text string, source string, n_chars int", "source string, doc_id long, text string"])
def test_kept_documents_lose_the_common_lines(spark, columns):
    rng = random.Random(8)
    menu = "\n".join(prose(rng, 15) for _ in range(2))
    own = {i: f"{prose(rng, 40)}\n\n  {prose(rng, 40)}é" for i in range(60)}
    source = {i: "host" if i < 30 else None if i < 55 else "small" for i in own}
    rows = [{"doc_id": i, "text": f"{menu}\n{t}", "source": source[i], "n_chars": len(menu) + 1 + len(t)} for i, t in own.items()]
    rows += [rows[5], rows[40]]  # repeated rows
    names = [c.split()[0] for c in columns.split(", ")]
    docs = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], columns)
    whole = {0, 30, *range(55, 60)}  # the first of each host, and a host with few documents
    out = quality.keep(docs)
    assert out.columns == names and out.schema == docs.schema
    kept = out.collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in rows)
    for r in kept:
        i = r["doc_id"]
        assert r["text"] == (f"{menu}\n{own[i]}" if i in whole else own[i])
        assert "n_chars" not in names or r["n_chars"] == len(r["text"])
