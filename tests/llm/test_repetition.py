"""Periodic runs against brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bidloom.llm import repetition
from bidloom.llm.queries import op11_periodic_runs, with_periodic_tails
from bidloom.llm.repetition import Extensions, best_run, next_distances, next_smaller, runs_of, split_words, word_runs

SF = "/root/testdata/sf0.001"


def brute_runs(w, least=6, exponent=4):
    """Every maximal stretch of every period, those whose smallest period it is."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, exponent * q) and e - s >= 2 * q and not any(w[s : e - d] == w[s + d : e] for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def fast_runs(w, least=6, exponent=4):
    words, at = split_words(pa.array([" ".join(w)]))
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return runs_of(codes, next_distances(codes, at), least, exponent)


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest(),
    )


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (1, 2), (4, 3)])
def test_runs_against_all_periods(least, exponent):
    rng = random.Random(least * 10 + exponent)
    for _ in range(800):
        n = rng.randint(0, 60)
        w = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        assert fast_runs(w, least, exponent) == brute_runs(w, least, exponent), w


@pytest.mark.parametrize("passes", [1, 2])
def test_fewer_passes_find_the_same_runs(monkeypatch, passes):
    monkeypatch.setattr(repetition, "PASSES", passes)
    rng = random.Random(passes)
    for _ in range(400):
        w = [rng.choice("abcd"[: rng.choice([2, 3, 4])]) for _ in range(rng.randint(0, 50))]
        assert fast_runs(w) == brute_runs(w) and fast_runs(w, 2, 2) == brute_runs(w, 2, 2)


def test_long_texts_take_time_in_proportion():
    assert fast_runs(["a"] * 100_000) == [(0, 100_000, 1)]
    morse = ["ab"[i.bit_count() % 2] for i in range(1 << 15)]  # polynomial hashes modulo a power of two are weakest here
    assert fast_runs(morse) == [] and fast_runs(morse[:400], 2, 2) == brute_runs(morse[:400], 2, 2)
    rng = random.Random(8)
    period = [f"w{rng.randrange(900)}" for _ in range(5000)]
    assert fast_runs(["x"] + period * 5 + ["y"]) == [(1, 25_000, 5000)]


def test_equal_hashes_of_other_words_change_nothing(monkeypatch):
    """With a hash that takes all words for equal, the direct comparison decides."""
    monkeypatch.setattr(repetition, "mix", lambda v: np.ones(len(v), np.uint64))
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.choice("ab") for _ in range(30)]
        codes = [ord(c) for c in w]
        ext = Extensions(np.array(codes))
        for falls in (False, True):
            order = [-c for c in codes] if falls else codes
            by_hand = [next((j for j in range(i + 1, 30) if order[j:] < order[i:]), 30) for i in range(30)]
            assert next_smaller(codes, ext.total.tolist(), ext.power.tolist(), falls) == by_hand


def test_words_and_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, " a\x0ba\x0ca\ra\na\ta "), (4, " a\x0ba\x0ca\ra\na\ta "), (None, "b B " * 5), (6, "a a " * 6), (7, "\x1ca " * 6 + "x" * 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("runs", F.lit("x")).withColumn("collapsed", F.lit(1)).withColumn("a.b", F.lit(2))
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in word_runs(docs).collect())
    assert got == [
        ("1", [], ""), ("2", [], ""), ("3", [], ""), ("4", [(0, 6, 1)], "a"), ("4", [(0, 6, 1)], "a"), ("6", [(0, 6, 1)], "a a"), ("7", [(0, 6, 1)], "\x1ca " + "x" * 70_000),
        ("None", [(0, 10, 2)], "b B"),
    ]
    assert word_runs(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        word_runs(docs, least_exponent=1)


def test_best_run_is_exact_and_the_first_of_equals(spark):
    from bidloom.llm.repetition import RUNS

    big = 3_000_000_000
    lists = [([(0, 8, 2), (9, 4, 1)], (0, 8, 2)), ([(0, 8, 2), (9, 9, 2)], (9, 9, 2)), ([], None), ([(5, big, big // 3), (7, big + 1, big // 3)], (7, big + 1, big // 3)), ([(3, 8, 2), (3, 12, 3)], (3, 8, 2))]
    rows = spark.createDataFrame([(i, runs) for i, (runs, _) in enumerate(lists)], f"i long, runs {RUNS}")
    got = [r.b and tuple(r.b) for r in rows.select("i", best_run(F.col("runs")).alias("b")).orderBy("i").collect()]
    assert got == [b for _, b in lists]


def test_tails_follow_the_rule(spark):
    rows = [(i, " \n".join(f"w{(7 * i + k) % 11}" for k in range(i % 23))) for i in range(400)] + [(None, "a b c"), (10, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    changed = 0
    for r, (i, text) in zip(sorted(with_periodic_tails(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text)), sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")), strict=True):
        w, h = (text or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            assert r.text.split() == [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
            changed += 1
        else:
            assert r.text == (text or "")
    assert changed > 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_against_brute_force(spark):
    # All periods of all words would take long on the longest texts: these are the documents of at most 1500 words.
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, SF).collect()}
    assert set(got) == {d for d, _ in docs}
    for d, text in docs:
        if len(text.split()) <= 1500:
            assert got[d] == expected(d, text)
