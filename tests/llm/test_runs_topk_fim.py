"""Periodic runs, top-k search and fill-in-middle against brute force, with every odd case."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintline.llm import topk_search as topk
from tintline.llm.fill_middle import Bits, fill_middle, restored
from tintline.llm.periodic_runs import collapsed, periodic_runs, runs_of, strongest, word_numbers
from tintline.llm.queries import with_planted_repeats
from tintline.llm.topk_search import Index, topk_search

WHITE = r"[\x20\x09-\x0D]"


def all_runs(words, min_words=6, min_repeats=4):
    """Every period, word by word."""
    found = {}
    for p in range(1, len(words) // min_repeats + 1):
        i = 0
        while i < len(words) - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i < len(words) - p and words[i] == words[i + p]:
                i += 1
            if i + p - start >= max(min_words, min_repeats * p):
                found.setdefault((start, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (6, 3), (9, 5)])
def test_runs_are_all_runs(least):
    r = random.Random(least[0] * 10 + least[1])
    for _ in range(400):
        words = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(90))]
        for _ in range(r.randrange(4) if len(words) > 10 else 0):
            p, a = r.randrange(1, 14), r.randrange(len(words))
            for i in range(a + p, min(len(words), a + r.randrange(3 * p, 9 * p))):
                words[i] = words[i - p]
        assert runs_of(np.array(words, np.int32), *least) == all_runs(words, *least), words


def test_runs_within_runs_and_long_texts():
    inner = ["a"] * 8 + ["b"] * 7 + ["c"]
    words = ["x"] + inner * 5 + ["y"]
    found = runs_of(np.array([ord(w) for w in words], np.int32))
    assert found == all_runs(words) and (1, 80, 16) in found and len(found) == 11
    same = np.zeros(100_000, np.int32)
    assert runs_of(same) == [(0, 100_000, 1)]
    mixed = np.random.default_rng(1).integers(0, 50_000, 200_000).astype(np.int32)
    mixed[70_000:130_000] = np.tile(mixed[70_000:70_777], 78)[:60_000]
    assert runs_of(mixed) == [(70_000, 60_000, 777)]
    assert runs_of(np.array([], np.int32)) == [] and collapsed(3, []).all()


TEXTS = ["a b " * 9, "x x x x x", "x x x x x x", None, "", " \n\t", "one two three", "A a A a A a A a", "go\x1cgo " * 6, "é é é é " * 3, ("p q r " * 4 + "s ") * 4, "tick tock " * 20000, "a b " * 9]


def test_periodic_runs(spark):
    rows = [(k % 11 if k else None, t, "r", "n", None) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, runs string, collapsed int").repartition(3)
    found = periodic_runs(docs).select("row.*", F.col("n_words"), F.col("runs").alias("found"), F.col("collapsed").alias("left"), strongest(F.col("runs")).alias("best")).collect()
    assert len(found) == len(rows)
    for row in found:
        words = re.findall(rf"[^{WHITE[1:-1]}]+", row.text or "")
        runs = [(0, 40000, 2)] if len(words) > 10000 else all_runs(words)
        assert row.n_words == len(words) and [tuple(x) for x in row.found] == runs
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        assert row.left == " ".join(w for i, w in enumerate(words) if i not in gone)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        assert (row.best and tuple(row.best)) == best
    assert periodic_runs(docs.limit(0)).count() == 0
    assert strongest_of(spark, [(0, 12, 3), (20, 8, 2), (40, 4, 1)]) == (0, 12, 3)
    with pytest.raises(ValueError):
        periodic_runs(docs, min_repeats=1)


def strongest_of(spark, runs):
    frame = spark.createDataFrame([(runs,)], "runs array<struct<start:long,length:long,period:long>>")
    return tuple(frame.select(strongest(F.col("runs")).alias("x")).first().x)


def test_planted_repeats(spark):
    import zlib

    docs = spark.createDataFrame([(k, None if k == 7 else "" if k == 8 else " ".join(f"w{i}" for i in range(k % 60 + 1))) for k in range(300)] + [(None, "a b")], "doc_id long, text string")
    changed = 0
    for row in with_planted_repeats(docs).collect():
        text = docs.filter(F.col("doc_id").eqNullSafe(F.lit(row.doc_id))).first().text if row.doc_id in (None, 7, 8) else " ".join(f"w{i}" for i in range(row.doc_id % 60 + 1))
        h = zlib.crc32(str(row.doc_id).encode())
        if row.doc_id is not None and text and h % 10 == 0:
            words, g = text.split(), h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            text = " ".join(w if i < a else words[a + (i - a) % p] for i, w in enumerate(words))
            changed += 1
        assert row.text == text
    assert changed > 15


def brute_topk(vectors, queries, k):
    """(query, rank, id, score) for lists of (id, components)."""
    def usable(rows):
        return [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]

    out = []
    for q, own in usable(queries):
        scored = sorted(((-sum(a * b for a, b in zip(own, v)), i is None, i or 0, i) for i, v in usable(vectors) if q is None or i != q))
        out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(scored[:k])]
    return collections.Counter(out)


def test_topk(spark):
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 0.2) for _ in range(12)]) for k in range(700)]
    rows += [(700 + k, rows[50][1]) for k in range(200)]  # more copies than places
    rows += [(900, None), (950, [0.1, None]), (951, [float("nan")]), (952, [float("inf"), 1.0]), (953, []), (954, [0.5] * 3), (955, [0.25] * 20), (None, rows[100][1]), (100, rows[100][1]), (1000, [-0.001] * 12), (1050, [0.0] * 12)]
    schema = "vec_id long, embedding array<float>, score string, part int"
    vectors = spark.createDataFrame([(*x, "s", 1) for x in rows], schema).repartition(5)
    exact = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    asked = vectors.filter(F.col("vec_id") % 50 == 0)
    queries = [x for x in exact if x[0] is not None and x[0] % 50 == 0]
    for options in ({}, {"shard_rows": 100, "block_rows": 7}, {"k": 1}, {"k": 2000}):
        found = topk_search(vectors, asked, **options).collect()
        assert collections.Counter(map(tuple, found)) == brute_topk(exact, queries, options.get("k", 5)), options
    none = vectors.limit(0)
    assert topk_search(none, none).count() == topk_search(none, asked).count() == topk_search(vectors, none).count() == 0
    huge = spark.createDataFrame([(1, [1e30, 1.0]), (2, [2.0**18, 1.0]), (3, [2.0**18, 2.0]), (4, [-(2.0**18), 1.0])], "vec_id long, embedding array<double>")
    found = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk_search(huge, huge).collect()}
    assert len(found) == 6 and found[2, 1] == (3, 2**52 + 512 * 256) and found[2, 2] == (4, -(2**52) + 65536)


def test_search_stops_on_proof_alone():
    """Whatever the floor and the stopping point, no member is lost; and most vectors are never scored."""
    rng = np.random.default_rng(5)
    matrix = np.floor(rng.normal(size=(3000, 32)) * 45).astype(np.int16)
    matrix[1000:2000] = matrix[7]
    index, scored = Index.of(np.arange(3000), matrix), 0
    for q in range(40):
        query = matrix[q * 70].astype(np.int64)
        want = matrix.astype(np.int64) @ query
        want[5] = np.iinfo(np.int64).min
        fifth = np.sort(want)[-5]
        for floor in (-np.inf, float(fifth) - 1, float(fifth)):
            scores, rows = index.best(5, query, 5, floor)
            assert (scores == want[rows]).all() and set(np.flatnonzero(want >= fifth)) <= set(rows) and 5 not in rows
        scored += len(rows)
    assert scored < 40 * 2000
    assert topk.ROUNDS[-1] < 1


def test_bits():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 511, 512, 513, 4097):
        for share in (0.0, 0.03, 0.5, 1.0):
            bits = rng.random(n) < share
            found = Bits(bits)
            assert (found.rank(np.arange(n + 1)) == np.concatenate([[0], np.cumsum(bits)])).all()
            assert (found.select(np.arange(bits.sum())) == np.flatnonzero(bits)).all()


def brute_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(rf"{WHITE}*[^{WHITE[1:-1]}]+|{WHITE}+", text)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_middle(spark):
    r = random.Random(8)
    odd = [None, "", " ", "\n\t ", "word", " word ", "a <P> b", "a<S>", "<M>", "<P <S", "日本 語 x é y", "ends in <P", "x\x1cy \x0bz", "long " * 300_000, "ü" * 70_000 + " " + "😀 " * 9000]
    rows = [(k, "".join(r.choice("ab é日😀<PSM> \n\t ") for _ in range(r.randrange(200)))) for k in range(400)]
    rows += [(1000 + k, t) for k, t in enumerate(odd * 6)] + [(None, "some words here"), (None, None), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(*x, "r", "f", 1) for x in rows], "doc_id long, text string, row string, form string, n int").repartition(3)
    found = fill_middle(docs)
    got = found.select("row.doc_id", "row.text", F.col("n"), F.col("form"), "prefix_chars", "middle_chars", "output", restored(F.col("output"), F.col("form")).alias("again")).collect()
    assert len(got) == len(rows) and {x.form for x in got} == {"plain", "psm", "spm"}
    for x in got:
        assert tuple(x)[2:7] == brute_fim(x.doc_id, x.text) and x.again == (x.text or "")
    assert fill_middle(docs.limit(0)).count() == 0
    for markers in (("a", "a", "b"), ("", "b", "c"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fill_middle(docs, markers=markers)
    other = fill_middle(docs, seed=7, rate=100, spm_rate=0, markers=("[pre|", "{suf|", "(mid|"))
    assert other.filter(~restored(F.col("output"), F.col("form"), ("[pre|", "{suf|", "(mid|")).eqNullSafe(F.coalesce("row.text", F.lit("")))).count() == 0
    assert {x.form for x in other.select("form").distinct().collect()} == {"plain", "psm"}


def test_word_numbers():
    assert word_numbers([b"a", b"b", b"a"]).tolist() == [0, 1, 0]
