"""Near and exact dedup, components, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from bidloom.llm.components import connected_components
from bidloom.llm import exact_dedup, near_dedup
from bidloom.llm.exact_dedup import compact, digests_of, exact_duplicates, flush_runs, lookup, shared_filter
from bidloom.llm.near_dedup import MinMaxHasher, near_duplicates
from bidloom.llm.rowfilter import MAX_BITS, filter_bits, filter_of, in_filter
from bidloom.llm.scratch import Scratch

DOC = "doc_id long, text string"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(docs, k, per_hundred):
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= per_hundred * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(14):  # near copies around the threshold
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(" ".join(copy))
        docs += [" ".join(base)] * 3 + ["\t".join(base).upper()]
    docs += ["", " \n\t", "one", "ONE", "one two", "two one", "a b c", None]
    docs += [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k, per_hundred", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, per_hundred):
    docs = corpus()
    df = spark.createDataFrame(docs, DOC).repartition(3).withColumn("source", F.lit("x")).withColumn("bucket", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, Scratch(spark), k, per_hundred).collect()}
    assert got == brute_components(docs, k, per_hundred)


def test_near_duplicates_edge_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (5, text), (5, text), (7, text + " "), (9, None), (9, "")]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_duplicates(spark.createDataFrame(rows, DOC), Scratch(spark)).collect())
    assert got == sorted([("None", 26, "None", True), ("5", 26, "5", True), ("5", 26, "5", True), ("7", 26, "5", False), ("9", 0, "9", True), ("9", 0, "9", True)])
    assert near_duplicates(spark.createDataFrame([], DOC), Scratch(spark)).count() == 0


def test_signature_values_are_unbiased():
    import numpy as np

    rng = np.random.default_rng(1)
    h = MinMaxHasher(400, 4)
    both, only = rng.integers(0, 1 << 63, 300, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    a, b = np.concatenate([both, only[:100]]), np.concatenate([both, only[100:]])
    same = h.signature(a) == h.signature(b)
    assert len(same) == 800 and abs(same.mean() - 300 / 500) < 0.06
    assert abs(same[::2].mean() - 0.6) < 0.08 and abs(same[1::2].mean() - 0.6) < 0.08  # minima and maxima


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    df = spark.createDataFrame([*chain, *star, (500, 500), (201, 200), (200, 201)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark)).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 100 for i in range(101, 130)) and got[201] == 200 and 500 not in got
    assert connected_components(df.limit(0), Scratch(spark)).count() == 0


def brute_exact(docs):
    def bare(t):
        return (t or "").encode().translate(None, b" \t\n\x0b\x0c\r")

    groups = {}
    for d, t in docs:
        groups.setdefault(bare(t), []).append((-len(t or ""), float("inf") if d is None else d))
    out = []
    for d, t in docs:
        g = groups[bare(t)]
        keep = min(g)[1]
        keep = None if keep == float("inf") else keep
        out.append((str(d), str(keep), len(g), d == keep))
    return sorted(out)


def test_exact_duplicates_against_grouping(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a b", "ab", "a\nb ", "é x", "éx", "", None, " ", "long " * 50, "unique" + str(i)])) for i in range(200)]
    docs += [(3, docs[3][1]), (None, "ab"), (None, "nobody else")]
    df = spark.createDataFrame(docs, DOC).withColumn("digest", F.lit("clash")).repartition(5)
    got = exact_duplicates(df, Scratch(spark), memtable_rows=7, fan_in=3).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == brute_exact(docs)
    assert exact_duplicates(spark.createDataFrame([], DOC), Scratch(spark)).count() == 0


def index_of(spark, rows, memtable_rows=8, tasks=1):
    digests = digests_of(spark.createDataFrame(rows, DOC).coalesce(tasks))
    scratch = Scratch(spark)
    return scratch, scratch.table(flush_runs(digests, memtable_rows), "runs")


def test_runs_are_sorted_and_numbered(spark):
    _, runs = index_of(spark, [(i, f"text {i % 30}") for i in range(40)])
    by = {}
    for r in runs.collect():
        by.setdefault(r.run, []).append(bytes(r.digest))
    assert len(by) == 5 and all(len(d) <= 8 and d == sorted(set(d)) for d in by.values())


def test_filters_of_runs_tell_what_another_run_may_hold(spark):
    """Made when runs are flushed, before any is merged: an entry that no other run has is read by no compaction."""
    scratch, runs = index_of(spark, [(i, f"text {i}") for i in range(40)] + [(50, "text 3"), (51, "x"), (52, "x")])
    found = {(r.runs, r.n) for r in exact_dedup.merged_filter(runs).collect()}
    assert found == {(1, 1), (2, 1), (1, 2)}
    words = shared_filter(runs, scratch)
    keys = [(r.doc_id, r.maybe) for r in exact_dedup.asked(digests_of(spark.createDataFrame([(3, "text 3"), (50, "te xt3"), (51, "x"), (4, "text 4"), (101, "never seen")], DOC)), words).collect()]
    assert dict(keys) == {3: True, 50: True, 51: True, 4: False, 101: False}
    hit = runs.where(exact_dedup.maybe_in(words, spark)("first", "second"))
    assert hit.count() == 3 and compact(hit, scratch).agg(F.sum("n")).first()[0] == 4
    unique, alone = index_of(spark, [(i, f"text {i}") for i in range(40)])
    assert not shared_filter(alone, unique).any()


def test_index_lookup_asks_the_filter_first(spark):
    scratch, runs = index_of(spark, [(i, f"text {i % 30}") for i in range(40)])
    words = filter_of(runs.select("first", "second"), 1 << 16)  # of all that the index has
    level = compact(runs, scratch)
    new = digests_of(spark.createDataFrame([(100, "text 7"), (101, "never seen"), (102, "text 20")], DOC))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in lookup(new, level, words).collect()} == {100: (7, 2), 101: (None, None), 102: (20, 1)}
    assert {r.doc_id: r.maybe for r in exact_dedup.asked(new, words).collect()} == {100: True, 101: False, 102: True}
    # A digest that the filter lacks meets no run, even of an index that would answer it.
    none = lookup(new, level, filter_of(runs.select("first", "second").limit(0), 1 << 16)).collect()
    assert all(r.keep_id is None for r in none)


@pytest.mark.parametrize("fan_in, range_entries", [(2, 4), (3, 1 << 20), (256, 4)])
def test_levels_are_merged(spark, fan_in, range_entries):
    """Many runs, few at a time: the same last level, each digest once, the smallest entry and all counts."""
    rng = random.Random(6)
    rows = [(i, rng.choice(["a  b", "ab", "c", f"t{i % 40}"])) for i in range(150)]
    scratch, runs = index_of(spark, rows, 4, 5)
    assert runs.select("run").distinct().count() > 10
    level = compact(runs, scratch, fan_in, range_entries).collect()
    want = {}
    for i, t in rows:
        entry = (-len(t), i)
        best, n = want.get(t.replace(" ", ""), (entry, 0))
        want[t.replace(" ", "")] = (min(best, entry), n + 1)
    assert sorted(((-r.points, r.id), r.n) for r in level) == sorted(want.values()) and len({bytes(r.digest) for r in level}) == len(level)
    one = compact(runs, scratch).collect()
    assert sorted((bytes(r.digest), r.id, r.n) for r in level) == sorted((bytes(r.digest), r.id, r.n) for r in one)


def test_merging_keeps_the_order_and_hashes_nothing(spark):
    _, runs = index_of(spark, [(1, "a"), (2, "b"), (3, "a")], 2)
    plan = exact_dedup.merged_level(runs, 4, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "SortAggregate" in plan and "HashAggregate" not in plan and "Python" not in plan and "MapInArrow" not in plan


def test_filter_has_no_false_negatives(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    keys, others = rng.integers(-(1 << 63), 1 << 63, (500, 2)), rng.integers(-(1 << 63), 1 << 63, (5000, 2))
    rows = spark.createDataFrame([tuple(map(int, k)) for k in keys], "a long, b long").repartition(5)
    for bits in (1 << 14, MAX_BITS):
        words = filter_of(rows, bits)
        assert len(words) == bits // 64 and in_filter(*keys.T, words).all() and in_filter(*others.T, words).mean() < 0.01
    assert not in_filter(*keys.T, filter_of(rows.limit(0), 1 << 16)).any()
    assert filter_bits(0) == 1 << 16 and filter_bits(10**6) == 1 << 24 and filter_bits(10**12) == MAX_BITS


CLASHING = ["id", "hash", "row", "stays", "maybe", "of_id", "times", "copy", "_copy", "digest", "node", "n_tokens", "p0", "rate"]


def clashing(df):
    """Further columns with every name that the operators use themselves."""
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(CLASHING)))


def test_one_row_of_each_keeps_rows_apart(spark):
    near_a, near_b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, near_a), (1, near_b), (2, near_a + " x"), (3, near_b + " x"), (4, "lonely words " * 3), (4, "lonely words " * 3), (None, near_a + " y"), (5, ""), (5, ""), (6, None)]
    docs = clashing(spark.createDataFrame(rows, DOC).repartition(3))
    got = near_dedup.near_duplicates(docs, Scratch(spark)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted(
        [("1", "1"), ("1", "1"), ("2", "1"), ("3", "1"), ("4", "4"), ("4", "4"), ("None", "None"), ("5", "5"), ("5", "5"), ("6", "6")]
    )
    kept = near_dedup.first_of_each(docs, Scratch(spark))
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [rows[0], rows[1], rows[4], rows[6], rows[7], rows[9]]))


def test_exact_keeps_one_row_of_each_group(spark):
    rows = [(1, "a b"), (1, "c d"), (2, "a  b"), (2, "ab"), (3, "cd"), (3, "c d"), (3, "c d"), (None, "e"), (None, "e"), (4, "e"), (5, ""), (6, None), (7, " "), (None, "only")]
    docs = clashing(spark.createDataFrame(rows, DOC).repartition(4))
    kept = exact_dedup.first_of_each(docs, Scratch(spark), memtable_rows=2)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(2, "a  b"), (1, "c d"), (4, "e"), (7, " "), (None, "only")]))
    assert exact_dedup.first_of_each(docs.limit(0), Scratch(spark)).count() == near_dedup.first_of_each(docs.limit(0), Scratch(spark)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 9000}" for i in range(150_000))
    rows = [(1, long), (2, long.replace(" ", "\n")), (3, long + " tail"), (4, "short text of six words here"), (5, "x" * 1_000_000), (6, "x" * 1_000_000 + " ")]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    assert {r.doc_id: r.keep_id for r in exact_duplicates(docs, Scratch(spark)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 6, 6: 6}
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, Scratch(spark)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_near_misses_of_a_large_family(spark):
    """A family whose members stay below the threshold: nobody links, and the pairs met stay few."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(300):
        text = list(base)
        for j in rng.sample(range(0, 100, 5), 4):
            text[j] = f"own{rng.randrange(60)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, Scratch(spark)).collect()}
    assert got == brute_components(rows, 5, 80)


def test_working_tables_need_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from bidloom import session

    class Conf(dict):
        pass

    class Fake:
        class sparkContext:  # noqa: N801
            @staticmethod
            def getConf():
                return Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Fake)
    own = Scratch(spark)
    own.table(spark.range(3), "some")
    assert own.paths[0] in session._open
    own.drop()
    assert not own.paths and not any("bidloom-some" in p for p in session._open)


def test_equal_digests_with_other_bytes_are_regrouped(spark):
    import hashlib

    docs = spark.createDataFrame([(1, "aa"), (2, "ab"), (3, "a a"), (4, "b"), (None, "ac"), (None, "a c"), (2, "ad"), (2, "ad")], DOC).repartition(3)
    weak = lambda body: hashlib.sha256(body[:1]).digest()
    got = exact_duplicates(docs, Scratch(spark), digest=weak).collect()
    want = [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True), (None, None, 2, True), (None, None, 2, True), (2, 2, 2, True), (2, 2, 2, True)]
    assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got))) == sorted(map(str, want))
    kept = exact_dedup.first_of_each(docs, Scratch(spark), digest=weak).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(3, "a a"), (2, "ab"), (4, "b"), (None, "a c"), (2, "ad")]))
