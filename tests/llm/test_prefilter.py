"""The license scan's prefilter lets a matching text of every rule pass."""

import itertools
import re
from re import _parser as parser

import brute
import pytest

from lexiforge.llm import licenses


def shortest(nodes):
    """The shortest matches of a parsed pattern, one for each way through its branches."""
    ways = []
    for kind, value in nodes:
        if kind is parser.LITERAL:
            ways.append([chr(value)])
        elif kind is parser.IN:
            what, first = value[0]
            ways.append(["0" if first is parser.CATEGORY_DIGIT else "w"] if what is parser.CATEGORY else [chr(first if what is parser.LITERAL else first[0])])
        elif kind is parser.BRANCH:
            ways.append([x for branch in value[1] for x in shortest(branch)])
        elif kind is parser.SUBPATTERN:
            ways.append(shortest(value[-1]))
        elif kind is parser.MAX_REPEAT:
            ways.append(["".join(x) for x in itertools.product(shortest(value[2]), repeat=value[0])])
        else:
            raise ValueError(kind)
    return ["".join(x) for x in itertools.product(*ways)]


def test_a_match_of_each_rule_alone_is_found(spark):
    texts = sorted({t for r in licenses.rules() for t in shortest(parser.parse(r.pattern))})
    out = {r["text"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id").collect()}
    assert len(out) == len(texts)
    assert [t for t, r in out.items() if not r["labels"] or not r["score"]] == []


@pytest.mark.parametrize(("text", "label"), [("Released under BSD-3-Clause", "bsd-3-clause"), ("BSD 2-clause.", "bsd-2-clause"), ("No part of this publication may be reproduced", "proprietary")])
def test_rules_without_the_usual_words(spark, text, label):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["labels"], row["score"] > 0) == (label, True)


def plain(text):
    """labels and score: every rule over the whole text, then containment, then the rules' order."""
    norm = " ".join(re.findall(licenses.WORD, brute.ascii_lower(text or "")))
    found = []
    for nth, r in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<![^ ])(?:{r.pattern})(?![^ ])", norm, re.ASCII):
            found.append((norm[: m.start()].count(" "), -norm[: m.end()].count(" ") - 1, nth, r.label, r.weight))
    alone = [d for d in found if not any(e[0] <= d[0] and d[1] >= e[1] and e is not d and (e[0], e[1], e[2]) < (d[0], d[1], d[2]) for e in found)]
    kept = []
    for d in sorted(alone):
        if not kept or -kept[-1][1] <= d[0]:
            kept.append(d)
        elif d[2] < kept[-1][2]:
            kept[-1] = d
    base = brute.base_licenses(text)[-1]
    return ",".join(sorted({d[3] for d in kept} | set(base.split(",") if base else []))), max((d[4] for d in kept), default=0.0)


def test_against_every_rule_over_every_text(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [
        None, "", "Released under the Apache License, version 2.0 or later. All rights reserved (C) copyright 2019 copyright holder",
        "licensed under the GNU Lesser General Public License v2.1 only; GNU general public license version 3, GPLv2",
        "This work is licensed under CC BY-NC-SA 4.0, creative commons attribution share-alike 3.0", "dedicated to the public domain dedication",
        "the software is provided as is without warranty of any kind, without any warranty " * 3, "cc by cc by cc by sa 2.5",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(rows).collect()}
    assert out == {i: plain(t) for i, t in enumerate(texts)}
