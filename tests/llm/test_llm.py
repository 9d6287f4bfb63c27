"""Each operator on awkward rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import brute
import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from lexiforge.llm import bpe, fingerprints, jaccard, langid, licenses, lm, mixing, quality, sharding, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, row string, score double, label string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def awkward():
    rng = random.Random(5)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", "   \n\t ", "a", "a b", "A B", base, base, " ".join(near), prose(rng, 400), prose(rng, 6000), "é" * 300,
        "All rights reserved.\nLicensed under CC BY-SA 4.0, all RIGHTS reserved", "GNU General Public License v3", "line one here\n" * 40, "x\0y \u0085 z  \x1c",
        base + " tail", "one two three", "ONE two three", "#*$%&|<> !!",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], 7, i, 1, "x", 0.5, "y") for i, t in enumerate(texts)]
    return [*rows, (None, "null id text", None, "s1", 1, 1, 1, "x", 0.1, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] for r in awkward() if r[0] is not None}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


OPERATORS = {
    "bpe": lambda d: bpe.digests(d, RANKS, public_tokenizers.PATTERN),
    "licenses": licenses.scan,
    "mixing": mixing.taken,
    "mix": mixing.mix,
    "lm": lm.score,
    "fingerprints": fingerprints.compare,
    "jaccard": jaccard.join,
    "jaccard_keep": jaccard.keep,
    "sharding": sharding.shard,
    "langid": langid.identify,
    "langid_keep": langid.keep,
    "quality": quality.judge,
    "quality_keep": quality.keep,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect() if r["doc_id"] is not None}


def test_bpe(docs, texts):
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    out = by_id(OPERATORS["bpe"](docs))
    assert len(out) == len(texts)
    for i, t in texts.items():
        ids = tokenizer.encode_ordinary(t or "")
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(docs.where("doc_id is not null"), RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(encoded, RANKS).collect()} == {i: (t or "").encode() for i, t in texts.items()}


def test_bpe_long_words_and_columns(spark):
    ranks = bpe.read_ranks(RANKS)
    tokenizer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for n in (1, 2, 199, 201, 3000):
        word = "".join(rng.choice("abcdeét") for _ in range(n))
        assert bpe.merge(word.encode(), ranks) == tokenizer.encode_ordinary(word)
    words = spark.createDataFrame([(w,) for w in (None, "", "é", "thndre", " hello")], "word string")
    for r in bpe.decode_words(bpe.encode_words(words, ranks), ranks).collect():
        assert r["ids"] == (None if r["word"] is None else tokenizer.encode_ordinary(r["word"]))
        assert r["bytes"] is None or bytes(r["bytes"]).decode() == r["word"]


def test_licenses(docs, texts):
    out = by_id(licenses.scan(docs))
    for i, t in texts.items():
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.base_licenses(t)
    assert out[12]["labels"] == "cc-by,cc-by-sa-4.0,reserved"
    assert out[13]["labels"] == "gpl,gpl-3"
    assert len(licenses.rules()) > 250


def test_mixing(spark, docs, texts):
    out = mixing.taken(docs).collect()
    assert len(out) == len(awkward())
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(20, 300)), None, "hot" if i % 3 else ["a", "b", None][i % 7 % 3]) for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    first, again = by_id(mixing.taken(table)), by_id(mixing.taken(table.repartition(5)))
    assert first == again
    sizes, taken, aims = {}, {}, {}
    for i, t, _, s in rows:
        r = first[i]
        assert r["size"] == len(brute.words(t)) and r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"]
        sizes[s], taken[s], aims[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
    want = brute.targets(sizes)
    for s in sizes:
        assert aims[s] == pytest.approx(want[s])
        assert taken[s] == pytest.approx(want[s], rel=0.01)
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    n = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert n == {i: r["taken"] // r["size"] for i, r in first.items() if r["taken"]}


def test_passes_of_a_block_share_a_shard(spark):
    """Texts are sent once for each shard that takes them: once, but for a block at each border."""
    rows = spark.createDataFrame([(f"s{i % 3}", i, 10) for i in range(1536)], "source string, block int, size int")
    _, draws, shards = mixing.plan(rows)
    apart = draws.groupBy("source", "block").agg(F.count("*").alias("n"), F.countDistinct("shard").alias("shards"))
    assert apart.where("n > 1").count() > 500
    assert apart.where("shards > 1").count() <= 3 * (shards - 1)


def test_split_tree_is_exact(spark):
    counts = spark.createDataFrame([(0, 100), (1, 7), (2, 0), (3, 401)], "nth int, blocks long")
    rows = mixing.split_tree(counts, 8).collect()
    total, shard = {}, {}
    for r in rows:
        total[r["nth"]] = total.get(r["nth"], 0) + r["quota"]
        shard[r["shard"]] = shard.get(r["shard"], 0) + r["quota"]
    assert total == {0: 100, 1: 7, 2: 0, 3: 401}
    assert max(shard.values()) - min(shard.values()) <= 1 and len(shard) == 8


def test_lm(docs, texts):
    out = by_id(lm.score(docs))
    assert len(out) == len(texts)
    tokens = {i: [*brute.words(brute.ascii_lower(t or "")), None] for i, t in texts.items()}
    tokens[None] = ["null", "id", "text", None]
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in tokens}
    counts: dict = {}
    for i, ts in tokens.items():
        if not held[i]:
            for t in ts:
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i in texts:
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[i], len(tokens[i]), n)
        assert r["n_known"] == sum(t in counts for t in tokens[i])
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in tokens[i]))
        assert r["score"] < 0
    # what the model has learned beats even odds on its own text
    assert out[10]["bits_per_byte"] < 4
    assert out[6]["score"] == out[7]["score"]


def test_lm_is_a_distribution():
    tables = np.stack([lm.odds(c) for c in np.random.default_rng(0).integers(0, 3, (len(lm.ORDERS), lm.CELLS), dtype=np.int32)])
    weights = np.full((8, len(lm.ORDERS)), 0.3, np.float32)
    logs, _ = lm.mix(tables, weights, [bytes([b]) for b in range(1, 256)] + [b""])
    # one byte and the end, over all bytes: what is missing is continuations
    first = [10 ** x for x in logs]
    assert sum(first) < 1
    alone, _ = lm.mix(tables, weights, [b"some text"])
    among, _ = lm.mix(tables, weights, [b"other", b"some text", b"x" * 5000])
    assert alone[0] == pytest.approx(among[1])


def plain_mix(tables, weights, text):
    """log10 probability of one text, bit by bit."""
    total, data = 0.0, bytes(lm.PAD) + text + b"\0"
    hashed = lm.contexts(np.frombuffer(data, np.uint8))
    for i in range(lm.PAD, len(data)):
        if (i - lm.PAD) % lm.SEGMENT == 0:
            w = weights.astype(float)
        for bit in range(8):
            path = (data[i] | 256) >> (8 - bit)
            s = np.array([tables[k, int(hashed[k, i]) * 256 + path] / lm.SCALE for k in range(len(lm.ORDERS))])
            p = 1 / (1 + math.exp(-min(max(w[bit] @ s, -11), 11)))
            came = data[i] >> (7 - bit) & 1
            w[bit] += lm.RATE * (came - p) * s
            total += math.log10(p if came else 1 - p)
    return total


class Counted(np.ndarray):
    calls = 0

    def take(self, *args, **kwargs):
        Counted.calls += 1
        return np.asarray(self).take(*args, **kwargs)


def test_bits_mix_like_a_plain_loop():
    """Segments, strips and ends of all lengths; a step looks up the eight decisions of its bytes at once."""
    rng = np.random.default_rng(4)
    tables = np.stack([lm.odds(c) for c in rng.integers(0, 3, (len(lm.ORDERS), lm.CELLS), dtype=np.int32)])
    weights = rng.random((8, len(lm.ORDERS)))
    texts = [b"", b"\0", b"a", b"abcdefghijklmno", b"abcdefghijklmnop", "é ü".encode() * 40, *(bytes(rng.integers(0, 256, n).tolist()) for n in (1022, 1023, 1024, 1040, 2100)), b"x" * 300]
    Counted.calls = 0
    logs, _ = lm.mix(tables.view(Counted), weights, texts)
    assert logs == pytest.approx([plain_mix(tables, weights, t) for t in texts], rel=1e-5)
    assert Counted.calls == lm.SEGMENT
    assert lm.mix(tables, weights, [])[0].size == 0


def plain_refine(logs, text, counts, tokens):
    """One text, word by word; ``logs`` has the bits' log10 probability of each byte and the end."""
    total, at, counts = sum(logs), 0, list(counts)
    words, empty = [], []  # (by the bits, by the dictionary); words before each empty one
    for word in re.split(rb"[ \t\n\v\f\r]", text):
        if word:
            letters = [chr(b) for b in word if chr(b).isascii() and chr(b).isalpha()]
            capitals = sum(x.isupper() for x in letters)
            case = 0.8 if not capitals else 0.15 if capitals == 1 and 65 <= word[0] <= 90 else 0.04 if capitals == len(letters) else 0.01 * 0.5 ** len(letters)
            words.append((10 ** sum(logs[at : at + len(word)]), counts.pop(0) / (tokens + 1) * case))
        else:
            empty.append(len(words))
        at += len(word) + 1
    assert not counts and at == len(text) + 1
    answers, share = [], lambda i: 0.5
    for _ in range(lm.ROUNDS):
        answers = [share(i) * d / (share(i) * d + (1 - share(i)) * b) for i, (b, d) in enumerate(words)]
        share = lambda i, answers=answers: (lm.FIRST_SHARE + sum(answers[:i])) / (1 + i)
    total += sum(math.log10((1 - share(i)) * b + share(i) * d) - math.log10(b) for i, (b, d) in enumerate(words))
    return total + sum(math.log10(1 - share(i)) for i in empty)


def test_dictionary_refines_like_a_plain_loop():
    rng = np.random.default_rng(3)
    texts = [b"", b" ", b"a", b"The cat  sat\n", b"ALL Caps miXed x\0y 12\t", b"\x1c z " * 40, "é à ü".encode()]
    data, start, length = lm.laid_out(texts)
    logs = np.zeros(len(data))
    for s, n in zip(start, length):
        logs[s : s + n] = -rng.random(n)
    counts = [rng.integers(0, 4, len(t.split())) for t in texts]
    with np.errstate(divide="ignore"):
        out = lm.refine(logs, data, start, length, np.log(np.concatenate(counts) / 51))
    for i, t in enumerate(texts):
        assert out[i] == pytest.approx(plain_refine(logs[start[i] : start[i] + length[i]], t, counts[i].tolist(), 50))


def test_start_weights_follow_from_all_training_texts(spark):
    """Each text that is learned moves them, and they are those of a count in one piece."""
    texts = [f"{'abcdefghij'[i % 10] * 40} number {i}".encode() for i in range(60)]
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]

    def plain(some):
        counts = np.zeros((len(lm.ORDERS), lm.CELLS), np.int32)
        lm.count(some, counts)
        return lm.start_weights(np.stack([lm.losses(c.astype(np.int64), lm.odds(c)) for c in counts]))

    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = docs.select("doc_id", (~lm.held_out()).alias("train"), "text").mapInArrow(lm._gather, lm._ROWS_DDL)
    found = lm.model(rows)[1]
    assert found == pytest.approx(plain(learned), rel=1e-5) and found.sum(1) == pytest.approx(np.full(8, lm.START), rel=1e-5)
    assert all(np.abs(plain(learned[:i] + learned[i + 1 :]) - found).max() > 1e-6 for i in range(0, len(learned), 17))
    assert lm.start_weights(np.zeros((len(lm.ORDERS), 8))) == pytest.approx(np.full((8, len(lm.ORDERS)), 0.3))


def test_short_runs_refine_like_one(monkeypatch):
    rng = np.random.default_rng(5)
    tables = np.stack([lm.odds(c) for c in rng.integers(0, 3, (len(lm.ORDERS), lm.CELLS), dtype=np.int32)])
    weights, texts = np.full((8, len(lm.ORDERS)), 0.3, np.float32), [b"One two  three", b"", b" ", b"two Two TWO " * 200, b"three"]
    known = lm.numbers()
    words = [lm.numbered(t, known) for t in texts]
    chance = np.log(np.linspace(0.01, 0.2, len(known)))
    whole = lm.score_texts(tables, weights, texts, words, chance)
    monkeypatch.setattr(lm, "REFINE_BYTES", 15)
    assert lm.score_texts(tables, weights, texts, words, chance) == pytest.approx(whole)


def test_dictionary_grows_with_the_corpus(spark):
    """Held-out texts of rare words: the more of them training texts have had, the likelier they are."""
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    learned = [i for i in range(2000) if i not in set(held)]
    rare = [f"q{zlib.crc32(str(k).encode()):x}" for k in range(3000)]
    asked = [(held[j], " ".join(rare[60 * j : 60 * j + 60])) for j in range(20)]
    filler = [(i, prose(random.Random(i), 30)) for i in learned[:100]]
    told = [(learned[200 + j], " ".join(random.Random(j).sample(rare[60 * j : 60 * j + 60], 60))) for j in range(10)]
    out = by_id(lm.score(spark.createDataFrame(filler + told + asked, "doc_id long, text string")))
    per = [out[i]["bits_per_byte"] for i, _ in asked]
    assert max(per[:10]) < min(per[10:])


def test_fingerprints(docs, texts):
    out = by_id(fingerprints.compare(docs))
    order = sorted(texts, reverse=True) + [None]
    full = texts | {None: "null id text"}
    cut = __import__("regex").compile(fingerprints.CUT).split
    parts = lambda t: {p for p in cut(t) if p}
    index = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i in texts:
        t, nxt = full[i] or "", full[order[(order.index(i) + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(index(parts(t), parts(edited)))
        assert r["near_next"] == pytest.approx(index(parts(t), parts(nxt)))
    assert out[6]["fingerprint"] == out[7]["fingerprint"]


def test_texts_are_cut_once_and_at_the_same_places(spark):
    """The next text's digests come from that text's row; the pattern cuts like the plainer one."""
    odd = ["a. b; c", "x. y", "ha!!!!! no", "ha!!!! yes", "\n\na | b |  c. d", "b? ", " a,  b", "", None]
    docs = spark.createDataFrame([(i * 700, t) for i, t in enumerate(odd)], "doc_id long, text string")
    plain = r"\n+|(?<=[A-Ha-h][.!?,;#*$%&<>]{1,4}) | \| "
    cut = lambda c: F.array_distinct(F.transform(F.filter(F.split(c, plain), lambda p: p != ""), lambda p: F.xxhash64(p)))
    rows = fingerprints.with_next(docs).select("a", "b", cut("text").alias("x"), cut("next").alias("y")).collect()
    assert len(rows) == len(odd) and all(r["a"] == r["x"] and r["b"] == r["y"] for r in rows)


def test_jaccard(docs, texts):
    out = by_id(jaccard.join(docs))
    assert {i: r["component_id"] for i, r in out.items()} == brute.components(list(texts.items()))
    kept = {r["doc_id"] for r in jaccard.keep(docs).collect()}
    assert 7 not in kept and {0, 1, 2, 6} <= kept


def test_jaccard_families_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(9)
    rows = []
    for family in range(3):
        base = prose(rng, 150, 5000).split()
        for i in range(40):
            changed = list(base)
            for _ in range(rng.randrange(0, 5)):
                changed[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows) + i, prose(rng, rng.randrange(1, 30), 12)) for i in range(120)]
    out = by_id(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in out.items()} == brute.components(rows)


def test_sharding(docs, texts):
    out = sharding.shard(docs, 4).collect()
    assert len(out) == len(awkward())
    sizes = {s: sorted(r["slot"] for r in out if r["shard"] == s) for s in range(4)}
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(v == list(range(len(v))) for v in sizes.values())
    for r in out:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


def test_ring_moves_only_the_overflow():
    counts = {p: 1 for p in range(0, sharding.POINTS, 7)}
    moves = sharding.walk(counts, 6)
    assert sum(b - a for _, a, b, _, _ in moves) == sum(counts.values())
    ring = sharding.ring(6)
    home = {p: next((s for q, s in ring if q >= p), ring[0][1]) for p in counts}
    stayed = sum(home[p] == s for p, _, _, s, _ in moves)
    natural = {s: sum(h == s for h in home.values()) for s in range(6)}
    share = sum(counts.values()) // 6
    assert stayed >= sum(min(n, share) for n in natural.values())


def test_langid(spark, docs, texts):
    out = by_id(langid.identify(docs))
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[19]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()["a"]
    assert held > 0.98
    model = langid.fit(table)
    text = "the thing with and that was here which they had " * 5 + "der die und nicht ein mit von verung einheit " * 5
    assert [x[2] for x in langid.spans(model, text)] == ["en", "de"]


def test_langid_without_labels(spark):
    rows = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(rows).first()["lang_pred"] == "und"


def test_viterbi_against_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    count = np.array([4, 0, 6, 1])
    start = np.cumsum(count) - count
    scores = rng.normal(0, 3, (11, 3)).astype(np.float32)
    path = langid.viterbi(scores, start, count, 2.0)
    for s, n in zip(start, count):
        if n:
            value = lambda p, s=s, n=n: sum(scores[s + i, p[i]] for i in range(n)) - 2.0 * sum(p[i] != p[i - 1] for i in range(1, n))
            best = max(map(value, itertools.product(range(3), repeat=int(n))))
            assert value(path[s : s + n].tolist()) == pytest.approx(best, abs=1e-4)


def test_quality(spark, docs, texts):
    out = by_id(quality.judge(docs))
    for i, t in texts.items():
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.quality(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_common_lines_go_and_copies_stay(spark):
    rng = random.Random(1)
    menu = "\n".join(prose(rng, 15) for _ in range(4))
    rows = [(i, prose(rng, 80, 9000), "host") for i in range(100)]
    rows += [(100 + i, menu + "\n" + prose(rng, 8, 9000), "host") for i in range(40)]
    page = "\n".join(prose(rng, 20, 9000) for _ in range(5))
    rows += [(200 + i, page, "host") for i in range(50)]
    out = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert {i for i, r in out.items() if not r["kept"]} == set(range(101, 140))
    assert all(out[i]["n_removed"] == (60 if i > 100 else 0) for i in range(100, 140))


def test_warc(spark, tmp_path):
    big = "x" * 150
    rows = [(3, "http://a", big), (1, "http://b", big), (2, None, "tiny"), (4, "http://c\r\nX: y", "tiny"), (5, "u", None), (None, "n", big), (6, "d", "é" * 70)]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, digest string, first string")
    bundles = warc.write(pages)
    out = {r["page_id"]: r for r in warc.read(bundles).collect()}
    assert len(out) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (out[page]["payload_bytes"], out[page]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {p: (r["record_type"], r["refers_to"]) for p, r in out.items() if r["record_type"] == "revisit"} == {3: ("revisit", 1), None: ("revisit", 1)}
    assert {r["page_id"]: bytes(r["payload"]) for r in warc.fetch(bundles, [1, 2, 6]).collect()} == {1: big.encode(), 2: b"tiny", 6: ("é" * 70).encode()}
    warc.export(bundles, str(tmp_path))
    import zstandard

    content = next(tmp_path.glob("*.zst")).read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") >= 1
    assert warc.write(pages.limit(0)).count() == 0


def test_warc_frames_and_identifiers(spark):
    rng = random.Random(4)
    rows = [(i % 90, "u", prose(rng, rng.randrange(1, 900))) for i in range(100)] + [(7, "u", "same " * 40)] * 3 + [(500, "u", "same " * 40)]
    bundles = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    found, places = warc.read(bundles).collect(), {(r["bundle"], r["frame"], r["offset"]): r["record_id"] for r in warc.index(bundles).collect()}
    assert len(found) == len(places) == len(set(places.values())) == len(rows)
    assert {(r["bundle"], r["frame"], r["offset"]) for r in found} == set(places)
    assert 1 < len({r["frame"] for r in found}) < len(rows)
    key = lambda p, t: (p, hashlib.sha256(t.encode()).hexdigest())
    assert sorted((r["page_id"], r["payload_digest"]) for r in found) == sorted(key(p, t) for p, _, t in rows)
    assert [(r["page_id"], r["refers_to"]) for r in found if r["record_type"] == "revisit"] == [(500, 7)]
    fetched = warc.fetch(bundles, [50, 7]).collect()
    assert {bytes(r["payload"]).decode() for r in fetched} == {t for p, _, t in rows if p in (50, 7)}
