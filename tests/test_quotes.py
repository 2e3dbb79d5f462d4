"""Quoted text: alignment, lines and fragments against plain versions."""

import difflib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.operators import alignment as A
from bidloom.operators import fragments as G
from bidloom.operators import lines as L
from bidloom.operators.running import previous, ranged, running


def tokens(text):
    return [t.lower() for t in re.findall(r"[^\W_]+", text or "")]


def plain_alignment(page, snippet, floor=0.55):
    """The plain form: longest matching blocks over all words."""
    a, b = tokens(page), tokens(snippet)
    blocks = [x for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
    if not blocks:
        return None
    anchor = max(blocks, key=lambda x: x.size)
    near = [x for x in blocks if abs(x.a - anchor.a) <= max(len(b), 8)]
    matched = sum(x.size for x in near)
    fits = matched / len(b) >= floor
    return len(b), matched, min(x.a for x in near) if fits else None, max(x.a + x.size - 1 for x in near) if fits else None


def test_blocks_are_those_of_a_plain_aligner():
    rng = random.Random(2)
    for _ in range(1500):
        n, m, v = rng.randint(0, 60), rng.randint(1, 25), rng.choice([2, 5, 12, 40])
        a, b = [rng.randrange(v) for _ in range(n)], [rng.randrange(v) for _ in range(m)]
        if rng.random() < 0.5 and n > 10:
            s = rng.randrange(n - 5)
            b = a[s : s + rng.randint(2, 20)]
            b[rng.randrange(len(b))] = 99
        want = [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]
        assert A.matching_blocks(np.array(a, np.int64), np.array(b, np.int64)) == want, (a, b)


def share_a_run(a, b, k):
    a, b = tokens(a), tokens(b)
    k = min(k, len(b))
    runs = lambda t: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    return len(b) >= 2 and bool(runs(a) & runs(b))


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    pages = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 80, 300])))) for i in range(30)]
    snippets = []
    for i in range(25):
        w = rng.choice(pages)[1].split()
        s = rng.randrange(max(1, len(w) - 30))
        cut = w[s : s + rng.randint(2, 30)]
        for _ in range(rng.randint(0, 5)):
            cut[rng.randrange(len(cut))] = rng.choice(vocabulary)
        snippets.append((f"s{i}", rng.choice([" ", "-", ",\n"]).join(cut).upper()))
    snippets += [("none", None), ("blank", " .,"), ("one", "w1"), ("two", "w1 w2"), ("twin", snippets[0][1]), ("é", "Été à w3")]
    pages += [(100, None), (101, ""), (102, "w1 w2"), (103, "x été_À W3 y"), (104, "w1 w2 " * 20_000)]
    return pages, snippets


@pytest.mark.parametrize("k", [2, 3, 5])
def test_alignment_against_all_pairs(spark, k):
    pages, snippets = texts(k)
    df = spark.createDataFrame(pages, "page_id long, text string").repartition(4).withColumn("seed", F.lit(1)).withColumn("t", F.lit(2))
    got = {(r.snippet_id, r.page_id): (r.n_words, r.matched, r.first_word, r.last_word) for r in A.align(df, spark.createDataFrame(snippets, "snippet_id string, text string"), k).collect()}
    want = {(s, p): plain_alignment(page, snippet) for s, snippet in snippets for p, page in pages if p != 104 and share_a_run(page, snippet, k)}
    assert {x: v for x, v in got.items() if x[1] != 104} == want
    assert got["two", 104][:2] == (2, 2)


def test_seeds_and_runs_are_taken_from_hashes(spark):
    """Words are hashed once where they are read; runs of a page are looked up in the snippet, which is the shorter."""
    df = spark.createDataFrame([(1, "A b c a B c"), (2, "b c"), (3, ""), (4, None), (5, "x a b c")], "page_id int, text string")
    texts = df.select("page_id", A.words(F.col("text")).alias("t"))
    assert texts.schema["t"].dataType.simpleString() == "array<bigint>"
    found = {}
    for r in A.seeds(texts, "page_id", 3).collect():
        found.setdefault(r.page_id, []).append(r.seed)
    assert {i: len(v) for i, v in found.items()} == {1: 4, 5: 2} and len(set(found[1])) == 3 and set(found[1]) & set(found[5]) == {found[1][0]}
    rng = random.Random(2)
    for _ in range(60):
        page, snippet = ([rng.randrange(5) for _ in range(rng.randint(0, 30))] for _ in range(2))
        want = []
        for i, j in itertools.product(range(len(page)), range(len(snippet))):
            if page[i] == snippet[j] and not (i and j and page[i - 1] == snippet[j - 1]):
                n = 0
                while i + n < len(page) and j + n < len(snippet) and page[i + n] == snippet[j + n]:
                    n += 1
                want.append((i, j, n))
        assert sorted(zip(*A.common_runs(np.array(page, np.int64), np.array(snippet, np.int64)).tolist(), strict=True)) == want


def test_no_pair_without_a_common_run(spark):
    """One snippet in most pages, and as many pages that share none: joins are by seed and by identifier."""
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, F.lit("before the quoted words of it after")).otherwise(F.concat(F.lit("p"), "id", F.lit(" q r s t"))).alias("text"))
    snippets = spark.createDataFrame([(1, "the quoted words of it"), (2, "nothing like this")], "snippet_id int, text string")
    found = A.align(pages, snippets)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and found.count() == 2000
    assert found.select("snippet_id", "matched", "first_word", "last_word").distinct().collect() == [(1, 5, 1, 5)]
    assert A.align(pages.limit(0), snippets).count() == A.align(pages, snippets.limit(0)).count() == 0


def plain_lines(at, limit):
    out, anchor, line = [], None, -1
    for v in at:
        if anchor is None or abs(v - anchor) > limit:
            anchor, line = v, line + 1
        out.append(line)
    return out


def lines_of(rows):
    """Groups of a page's words that share a line, in order."""
    by = {}
    for r in sorted(rows, key=lambda r: r.word_no):
        by.setdefault((r.page, tuple(r.line)), []).append(r.word_no)
    return sorted((p, w) for (p, _), w in by.items())


def plain_groups(words, limit):
    out = []
    for page in {w[0] for w in words}:
        mine = sorted(w[1:] for w in words if w[0] == page)
        by = {}
        for (no, _), line in zip(mine, plain_lines([t for _, t in mine], limit), strict=True):
            by.setdefault(line, []).append(no)
        out += [(page, w) for w in by.values()]
    return sorted(out)


@pytest.mark.parametrize("rising", [False, True])
def test_lines_against_a_plain_fold(spark, rising):
    rng = random.Random(5)
    words = []
    for page in range(12):
        top = 0.0
        for no in range(rng.choice([1, 2, 40])):
            top += rng.choice([0, 0.5, 1, 2.9, 3, 3.1, 8]) * (1 if rising or rng.random() < 0.6 else -1)
            words.append((page, no, top))
    df = spark.createDataFrame(words, "page int, word_no int, top double").repartition(4)
    assert lines_of(L.with_lines(df, ["page"], ["word_no"], "top", 3.0, rising).collect()) == plain_groups(words, 3.0)
    assert L.with_lines(df.limit(0), ["page"], ["word_no"], "top").count() == 0


def test_lines_of_one_page_with_most_words(spark):
    """A third of all rows of one page, some of them without a certain cut for long."""
    rng = random.Random(6)
    words, top = [], 0.0
    for no in range(4000):
        top += rng.choice([0.2, 0.5]) if no % 1000 else 50
        words.append((1, no, top))
    words += [(page, no, float(no)) for page in range(2, 802) for no in range(10)]
    df = spark.createDataFrame(words, "page int, word_no int, top double").repartition(8)
    assert lines_of(L.with_lines(df, ["page"], ["word_no"], "top", 3.0).collect()) == plain_groups(words, 3.0)


def test_highlight_has_a_box_per_line(spark):
    words = [(1, i, 10.0 * (i % 4), 10.0 * (i % 4) + 8, 100.0 + 12 * (i // 4) + (i % 2), 110.0 + 12 * (i // 4)) for i in range(12)]
    page = spark.createDataFrame(words, "page_id int, word_no long, x0 double, x1 double, top double, bottom double")
    found = spark.createDataFrame([("a", 1, 2, 5), ("b", 1, None, None)], "snippet_id string, page_id int, first_word long, last_word long")
    got = sorted((r.snippet_id, r.x0, r.top, r.x1, r.bottom, r.words) for r in L.highlight_boxes(page, found, F.col("first_word"), F.col("last_word")).collect())
    assert got == [("a", 0.0, 112.0, 18.0, 122.0, 2), ("a", 20.0, 100.0, 38.0, 110.0, 2)]


def nested_loop(fragments, names):
    out = {}
    for f in {f for f in fragments if f is not None}:
        holders = sorted({n for n in names if n is not None and f.lower() in n.lower()})
        out[f] = (len(holders), holders[0] if len(holders) == 1 else None)
    return out


@pytest.mark.parametrize("q", [1, 3, 4])
def test_fragments_against_the_nested_loop(spark, q):
    rng = random.Random(q)
    names = ["".join(rng.choice("abcAB_") for _ in range(rng.randint(0, 12))) for _ in range(60)] + [None, "Ünion", "x", "x", "long " * 2000 + "needle"]
    fragments = ["".join(rng.choice("abcAB_") for _ in range(rng.randint(0, 6))) for _ in range(80)] + [None, "ÜN", "x", "zz", "zzzzz", "needle", "NEEDLE", names[0] + "a"]
    n, f = spark.createDataFrame([(x,) for x in names], "name string").withColumn("gram", F.lit(1)), spark.createDataFrame([(x,) for x in fragments], "fragment string")
    assert {r.fragment: (r.holders, r.name) for r in G.unique_holder(f, n, q).collect()} == nested_loop(fragments, names)
    assert all(r.holders == 0 for r in G.unique_holder(f, n.limit(0), q).collect()) and G.unique_holder(f.limit(0), n, q).count() == 0


def test_fragments_meet_names_by_their_grams(spark):
    names = spark.range(2000).select(F.concat(F.lit("common prefix "), "id").alias("name"))
    found = G.unique_holder(spark.createDataFrame([("prefix 77",), ("prefix 1999",), ("common",)], "fragment string"), names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.fragment: (r.holders, r.name) for r in found.collect()} == {"prefix 77": (11, None), "prefix 1999": (1, "common prefix 1999"), "common": (2000, None)}


def test_fragments_in_many_names_stay_apart(spark):
    """Every gram of these fragments is in very many names: no step may hold a row for each pair of a fragment and such a name."""
    names = spark.range(4000).select(F.format_string("Customer#%09d", "id").alias("name"))
    asked = spark.range(4000).select(F.col("id").cast("string").alias("fragment"))
    found = G.unique_holder(asked, names)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("join") == 1 and "contains(" not in plan
    got = {r.fragment: (r.holders, r.name) for r in found.collect()}
    assert len(got) == 4000 and got["3999"] == (1, "Customer#000003999") and got["12"][0] == sum("12" in f"{i:09d}" for i in range(4000))


def test_stems_take_the_file_first(spark):
    names = spark.createDataFrame([("T-100",), ("T-1001",), ("GHMC/7",)], "name string")
    exact = spark.createDataFrame([("NOTIF_100_a", "T-100")], "stem string, name string")
    stems = [("NOTIF_100_a",), ("NOTIF_100_b",), ("NOTIF_1001_x",), ("NOTIF_ghmc_2024",), ("other",), (None,)]
    got = {r.stem: r.name for r in G.resolve_stems(spark.createDataFrame(stems, "stem string"), exact, names).collect()}
    assert got == {"NOTIF_100_a": "T-100", "NOTIF_100_b": None, "NOTIF_1001_x": "T-1001", "NOTIF_ghmc_2024": "GHMC/7", "other": None, None: None}


def test_running_totals_of_a_key_with_most_rows(spark):
    """One key with a third of all rows, all of them in one hour: it fills several ranges."""
    rng = random.Random(7)
    rows = [(1 if i % 3 == 0 else i, 1000 + (i % 600), i, rng.randrange(5)) for i in range(6000)] + [(None, 5, 9000 + i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, at int, i int, v int").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one range
    try:
        cut = ranged(df, ["k"], ["at", "i"])
        got = running(df, ["k"], ["at", "i"], {"t": F.col("v")}, {"h": F.col("v")}).collect()
        before = {r.i: r.p for r in previous(cut, ["k"], ["at", "i"], "i", "p").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut.where("k = 1").select("_range").distinct().count() > 1
    total, high, at_row, last = {}, {}, {}, {}
    for k, at, i, v in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1], r[2])):
        total[k], high[k] = total.get(k, 0) + v, max(high.get(k, 0), v)
        at_row[i], last[k] = (total[k], high[k], last.get(k)), i
    assert len(got) == len(rows) and all((r.t, r.h, before[r.i]) == at_row[r.i] for r in got)
