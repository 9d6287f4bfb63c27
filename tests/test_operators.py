"""Operators on small constructed inputs, against restatements in Python."""

import difflib
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions import urls as U
from lexiforge.operators import ambiguity, contents, frequency, graph, hierarchy, likeness, lookups, metadata, metrics, mining, pairs, vectors
from lexiforge.sources import files
from lexiforge.streaming import metrics as running


def values(df, column):
    return [r[column] for r in df.collect()]


def test_text_edges_lose_no_pair(spark):
    names = ["machine learning", "machine-learning", "Machine Learnings", "deep learning", "deep learner", "biology", "biologys", "ab", "b", "neural nets", "neural net", "x"]
    terms = spark.createDataFrame(list(enumerate(names)), "pos int, term string")
    found = {(r["src"], r["dst"]) for r in pairs.text_edges(terms).collect()}

    def norm(t):
        return " ".join(t.lower().strip().replace("-", " ").replace("_", " ").replace("'s", "").replace("'", "").split())

    def score(a, b):
        r = difflib.SequenceMatcher(None, a, b).ratio()
        return max(r, 0.7 + 0.3 * min(len(a), len(b)) / max(len(a), len(b))) if a in b or b in a else r

    assert found == {(a, b) for a, b in itertools.combinations(names, 2) if score(norm(a), norm(b)) >= 0.85}


def test_spelling_and_plural_forms(spark):
    df = spark.createDataFrame([("behaviour studies",), ("data",), ("box",), ("",)], "t string")
    assert values(df.select(T.spelling_forms(F.col("t")).alias("v")), "v")[0] == ["behavior studies", "behaviour studies"]
    forms = values(df.select(T.plural_forms(F.col("t")).alias("v")), "v")
    assert forms[0] == ["behaviour studies", "behaviour study"]
    assert forms[1] == ["data"]
    assert forms[2] == ["box", "boxes"]
    assert forms[3] == [""]


def test_urls(spark):
    df = spark.createDataFrame([("https://www.MIT.edu/a/?utm_x=1&q=2#f",), ("ftp://x",), ("http://a.b.org",)], "u string")
    assert values(df.select(U.normalise(F.col("u")).alias("v")), "v") == ["mit.edu/a/?q=2", "ftp://x", "a.b.org"]
    assert values(df.select(U.is_academic(F.col("u")).alias("v")), "v") == [True, False, True]
    assert values(df.select(U.is_valid(F.col("u")).alias("v")), "v") == [True, False, True]


def test_frequency_keeps_duplicates_and_first_spelling(spark):
    rows = [(0, "a", "Biology"), (1, "b", "biology"), (2, "b", "BIOLOGY"), (3, "c", "Physics")]
    df = spark.createDataFrame(rows, "pos long, source string, concept string")
    out = sorted((r["pos"], r["concept"], r["frequency"]) for r in frequency.institutional(df, 0.6).collect())
    assert out == [(0, "Biology", 2), (1, "Biology", 2), (2, "Biology", 2)]
    assert frequency.venue(df).count() == 3


def test_components_and_canonical(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 2), ("e", 2)], "term string, level int")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], "a string, b string, weight double")
    assert {(r["term"], r["component"]) for r in graph.components(nodes, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")}
    assert {r["term"]: r["canonical"] for r in graph.canonical(nodes, edges).collect()} == {"a": "b", "b": "b", "c": "b", "d": "d", "e": "e"}
    loops = edges.union(spark.createDataFrame([("d", "d", 1.0)], "a string, b string, weight double"))
    assert {(r["fault"], r["item"]) for r in graph.faults(nodes, loops).collect()} == {("isolated", "e"), ("self_loop", "d")}


def test_upsert_order(spark):
    edges = spark.createDataFrame([("a", "b", 0.9, "text", 0), ("b", "a", 0.5, "compound", 1)], "src string, dst string, weight double, edge_type string, ord int")
    assert [(r["weight"], r["edge_type"]) for r in pairs.upsert(edges).collect()] == [(0.5, "compound")]
    assert [(r["weight"], r["edge_type"]) for r in pairs.upsert(edges, first_wins=True).collect()] == [(0.9, "text")]


def test_judge_is_pluggable(spark):
    df = spark.createDataFrame([("x", "x1"), ("y", "z")], "a string, b string")

    def judge(frames):
        for f in frames:
            f["duplicate"] = [b.startswith(a) for a, b in zip(f["a"], f["b"])]
            f["confidence"] = 0.9
            yield f

    assert [(r["a"], r["b"]) for r in pairs.judged(df, judge).collect()] == [("x", "x1")]


def test_dbscan_and_silhouette():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(0, 0.05, (20, 2)), rng.normal(3, 0.05, (20, 2)), [[10.0, 10.0]]])
    label = vectors.dbscan(points, 0.5, 3)
    assert label.tolist() == [0] * 20 + [1] * 20 + [-1]
    assert vectors.silhouette(points[:40], label[:40]) > 0.9
    assert vectors.silhouette(points[:20], label[:20]) == 0.0


def test_splits(spark):
    rows = spark.createDataFrame([("t", 0)] * 9 + [("t", 1)] + [("u", 0)] * 3, "term string, cluster int")
    senses = ambiguity.split_proposals(ambiguity.distribution(rows), 0.5)
    assert {(r["sense"], r["size"]) for r in senses.collect()} == {("t_1", 9), ("t_2", 1)}
    nodes = spark.createDataFrame([("t", 2), ("u", 2)], "term string, level int")
    assert sorted(values(ambiguity.apply_splits(nodes, senses), "term")) == ["t_1", "t_2", "u"]


def test_f1_edges(spark):
    df = spark.sql("select cast(array() as array<string>) g, cast(array() as array<string>) p union all select cast(array() as array<string>), array('a') union all select array('a','b'), array('a')")
    assert values(df.select(metrics.f1(F.col("g"), F.col("p")).alias("v")), "v") == [1.0, 0.0, pytest.approx(2 / 3)]


def test_mining_dedup_keeps_first(spark):
    df = spark.createDataFrame([(0, "u", "a"), (1, "u", "b"), (2, None, "c"), (3, "", "c")], "pos int, url string, content string")
    assert sorted(values(mining.deduplicate(df), "pos")) == [0, 2]


def test_definitions(spark):
    old = spark.createDataFrame([("a", " "), ("b", "kept")], "term string, definition string")
    new = spark.createDataFrame([("a", "n1"), ("b", "n2"), ("c", "n3")], "term string, definition string")
    assert {r["term"]: r["definition"] for r in metadata.fill_definitions(old, new).collect()} == {"a": "n1", "b": "kept", "c": "n3"}
    assert {r["term"]: r["definition"] for r in metadata.fill_definitions(old, new, True).collect()} == {"a": "n1", "b": "n2"}


def test_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# note\n  MIT - A - Biology \n\nPhysics\n")
    lines = files.read_lines(spark, str(tmp_path / "in.txt"), comment="#")
    assert {(r["source"], r["concept"]) for r in frequency.parse_pairs(lines).collect()} == {("MIT - A", "Biology"), ("generic", "Physics")}
    files.write_results(lines, str(tmp_path / "out"), "csv")
    assert files.read_csv(spark, str(tmp_path / "out"), "line string, pos long").count() == 2
    rows = spark.sql("select 'http://x' url, map('link', 'a', 'k', 'http://y', 'z', '1') metadata")
    assert files.redact(rows).collect()[0]["metadata"] == {"z": "1"}


def test_streaming_metrics_match_batch(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = running.windowed(running.read_events(spark, str(tmp_path / "in"), schema), "1 day", "1 hour")
    running.start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = source.groupBy(F.window("ts", "1 day")["start"].alias("start"), F.col("event_type").alias("operation")).agg(F.count("*").alias("n"))
    out = {(r["start"], r["operation"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out and out <= {(r["start"], r["operation"], r["n"]) for r in batch.collect()}


def test_compound_weights(spark):
    words = ["red bolt", "red bolts", "bolt", "red bolt set", "red gear", "blue gear", "blue gears", "gear", "big red bolt", "data base systems", "data base system"]
    terms = spark.createDataFrame(list(enumerate(words)), "pos long, term string")
    want = {}
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            x, y = set(a.split()), set(b.split())
            one = min(len(x), len(y)) == 1 and max(len(x), len(y)) > 1 and x & y
            if one or (min(len(x), len(y)) > 1 and (len(x & y) >= 2 or len(x & y) == min(len(x), len(y)))):
                want[a, b] = max(0.9, pairs.similarity(a, b))
    got = {(r["src"], r["dst"]): r["weight"] for r in pairs.compound_edges(terms).collect()}
    assert got == pytest.approx(want)
    assert max(want.values()) > 0.9


def test_hierarchy_faults_and_paths(spark):
    nodes = [("a", 0), ("b", 0), ("c", 1), ("d", 1), ("e", 2), ("f", 3), ("g", 4), ("h", 5), ("lone", 2)]
    edges = [("a", "c"), ("b", "c"), ("a", "d"), ("c", "e"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "h"), ("a", "e"), ("f", "d")]
    n, e = spark.createDataFrame(nodes, "term string, level int"), spark.createDataFrame(edges, "parent string, child string")
    assert [r["term"] for r in hierarchy.orphans(n, e).collect()] == ["lone"]
    assert {r["term"] for r in hierarchy.leaves(n, e).collect()} == {"h", "lone"}
    assert ("redundant", "e") in {(r["issue"], r["term"]) for r in hierarchy.issues(n, e).collect()}
    down = [(p, c) for p, c in edges if dict(nodes)[p] < dict(nodes)[c]]
    found = {}

    def walk(source, at, length):
        for p, c in down:
            if p == at:
                found.setdefault((source, c), []).append(length + 1)
                walk(source, c, length + 1)

    for term, level in nodes:
        if level == 0:
            walk(term, term, 0)
    want = {}
    for (_, t), lengths in found.items():
        want.setdefault(dict(nodes)[t], []).append(lengths)
    got = {r["level"]: (r["pairs"], r["paths"], r["mean_length"], r["max_length"]) for r in hierarchy.path_lengths(n, e).collect()}
    assert got == {k: (len(v), sum(map(len, v)), pytest.approx(sum(sum(x) / len(x) for x in v) / len(v)), max(map(max, v))) for k, v in want.items()}
    assert got[5][3] == 5  # a c e f g h


def test_web_presence_in_the_canonical_score(spark):
    nodes = spark.createDataFrame([("x", 1, 30, 2, 0.5), ("y", 1, 3, 0, None)], "term string, level int, urls int, contents int, relevance double")
    edges = spark.createDataFrame([], "a string, b string, weight double")
    plain = {r["term"]: r["score"] for r in graph.scores(nodes.select("term", "level"), edges).collect()}
    web = {r["term"]: r["score"] for r in graph.scores(nodes, edges).collect()}
    assert {t: web[t] - plain[t] for t in web} == {"x": 35.0, "y": 6.0}


def test_likeness_in_parent_scores(spark):
    nodes = spark.createDataFrame([("Art", 0), ("bio", 0), ("x", 1), ("y", 3)], "term string, level int")
    edges = spark.createDataFrame([("Art", "x"), ("bio", "x"), ("bio", "y")], "parent string, child string")
    sources = spark.createDataFrame([("x", "history of ART"), ("x", None)], "term string, text string")
    likeness = spark.createDataFrame([("Art", "x", 0.5), ("bio", "y", None)], "parent string, child string, likeness double")
    got = {(r["parent"], r["child"]): r["score"] for r in lookups.parent_scores(nodes, edges, sources, likeness).collect()}
    assert got == {("Art", "x"): 1 + 5 + 3 + 2 + 2, ("bio", "x"): 1 + 3 + 2, ("bio", "y"): 1 + 3 - 1}


def test_token_set_ratio():
    from lexiforge.operators.relevance import token_set_ratio

    assert token_set_ratio("bear was fuzzy", "fuzzy fuzzy was a bear") == 100
    assert token_set_ratio("", "a") == token_set_ratio(None, None) == 0
    assert token_set_ratio("abc", "abd") == pytest.approx(100 * 4 / 6)
    # common word "x": 1 - 2 / 6 by the rests "a" and "b"
    assert token_set_ratio("x a", "x b") == pytest.approx(200 / 3)


def test_relevance_of_web_contents(spark):
    from lexiforge.operators import relevance as R

    rows = [
        (1, "Plant Biology", "The plant-biology lab", "intro to plant biology", "plant biology " + "x " * 198),
        (2, "plant biology", "plant science", None, ""),
        (3, "a b", "", "b", "a a a b"),
        (4, None, "x", "y", "z"),
    ]
    df = spark.createDataFrame(rows, "i int, term string, title string, snippet string, content string")
    out = {r["i"]: r["r"] for r in df.select("i", R.relevance(*map(F.col, ("term", "title", "snippet", "content"))).alias("r")).collect()}
    # 200 words: one occurrence of each word, times 0.5 + 0.5 * 100 / 200
    fuzzy = R.token_set_ratio("plant biology", "the plant-biology lab") / 100
    assert out[1] == pytest.approx(0.5 * fuzzy + 0.3 + 0.2 * 0.75)
    assert out[2] == pytest.approx(0.5 * max(0.5, R.token_set_ratio("plant biology", "plant science") / 100))
    assert out[3] == pytest.approx(0.3 * R.token_set_ratio("a b", "b") / 100 + 0.2)


def test_siblings_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [("x (1)", ""), ("x (2)", None), ("no tag", "w1 w2"), ("x (3)", "same Words here"), ("x (4)", "here words same"), ("x (5)", "only one"), ("x (5)", "only one"), ("y (5)", "only one")]
    for i in range(60):
        base = rng.integers(0, 40, 30)
        for j in range(4):
            base[: rng.integers(0, 6)] = rng.integers(0, 40 + 60 * i, 1)
            rows.append((f"{'xyz'[i % 3]} ({100 + i * 4 + j - (j == 3)})", " ".join(f"w{k}" for k in base)))
    made = [(t, t.split("(")[0].strip(), set((c or "").lower().split())) for t, c in rows if "(" in t]
    expected = {}
    for (s, x, a), (t, y, b) in itertools.permutations(made, 2):
        if s != t and x == y and a and b and len(a & b) / len(a | b) >= 0.8:
            expected[s] = max(expected.get(s, 0), len(a & b) / len(a | b))
    out = contents.split_siblings(spark.createDataFrame(rows, "term string, content string"))
    assert {r["term"]: r["likeness"] for r in out.collect()} == expected
    assert len(set(expected.values())) > 5 and expected["x (3)"] == 1 and "x (5)" not in expected


def test_siblings_that_differ_are_not_compared(spark):
    """2,000 contents of one base with 20 words of their own and 20 common ones: no pair is listed."""
    words = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.xxhash64(F.when(k < 20, k).otherwise(F.col("id") * 100 + k)))
    sets = spark.range(2000).select(F.lit("b").alias("base"), "id", F.col("id").cast("string").alias("only"), F.array_sort(words).alias("words"))
    assert likeness.candidates(sets, 0.8).count() == 0


def test_siblings_are_moved_less_than_once(spark):
    """2,000 contents of 100 words of a common stock: the shuffles hold less than the 64-bit hashes of their words."""

    def written():
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(20000)).cast("string"))), " ")
    rows = spark.range(2000).select(F.concat(F.lit("x ("), "id", F.lit(")")).alias("term"), words.alias("content"))
    before = written()
    assert contents.split_siblings(rows).count() == 0
    time.sleep(1)  # the figures come with a delay
    assert 0 < written() - before < 2000 * 100 * 8


def test_words_are_cut_as_by_the_engine(spark):
    texts = ["a\u00a0b\u2028c\u3000d", "a\x1cb\x85c d", "\u1680x\u2003y\u202fz\u205fw ", "e\u0301\u200b f\tg\x0bh\x0c\r\ni", " ", "\ufeffq \u2060r\u180es"]
    out = values(spark.createDataFrame(enumerate(texts), "i int, t string").orderBy("i").select(T.words(F.col("t")).alias("w")), "w")
    assert [{w.decode() for w in likeness._words(t.encode())} for t in texts] == [set(w) for w in out]
