"""Classifiers, rules and mixing: held-out accuracy, optimality and edge rows."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.llm import learn, mixing, quality, rules, toxicity
from bidloom.llm.queries import QUERIES
from bidloom.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
DOC, LABEL = "doc_id long, text string", "doc_id long, quality int, toxic int"
EDGE = [(None, "good words here"), (1, None), (2, ""), (3, " \n "), (3, " \n "), (4, "word " * 30_000), (5, "\x00\x01 é 漢字")]


def toy(spark, n=240):
    rng = random.Random(4)
    clean = [f"word{i}" for i in range(80)]
    docs, labels = [], []
    for i in range(n):
        toxic, junk = i % 5 == 0, i % 7 == 0
        text = [rng.choice(clean) for _ in range(60)]
        if toxic:
            text[rng.randrange(60)] = rng.choice(["vileword", "nastyword"])
            text[rng.randrange(60)] = "nastyword"
        if junk:
            text = [w.upper() + "!!" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(docs, DOC).withColumn("score", F.lit("clash")), spark.createDataFrame(labels, LABEL)


def test_feature_slices_do_not_matter():
    texts = [b"One two, two THREE!!", b"", b"  ", "été à la mode".encode(), b"a" * 50 + b" b"]
    together, n = learn.features_of(texts)
    for t, f in zip(texts, together, strict=True):
        assert (learn.features_of([t])[0][0] == f).all()
    assert n.tolist() == [4, 0, 0, 4, 2]


@pytest.mark.parametrize("scores", [toxicity.toxicity_scores, quality.quality_scores])
def test_scorers_on_edge_rows(spark, scores):
    _, labels = toy(spark)
    docs, _ = toy(spark)
    got = scores(docs.select("doc_id", "text").union(spark.createDataFrame([(None if d is None else d + 1000, t) for d, t in EDGE], DOC)), labels)
    rows = got.collect()
    assert len(rows) == 240 + len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert scores(docs.limit(0), labels.limit(0)).count() == 0
    assert all(0 <= r.score <= 1 for r in scores(docs, labels.limit(0)).collect())


def test_scorers_separate_the_toy(spark):
    docs, labels = toy(spark)
    by = {r.doc_id: r for r in labels.collect()}
    tox = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert np.mean([tox[d].predicted == by[d].toxic for d in by if tox[d].held_out]) > 0.95
    q = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert np.mean([q[d].predicted == by[d].quality for d in by if q[d].held_out]) > 0.95


def test_held_out_labels_are_not_read(spark):
    docs, labels = toy(spark)
    flipped = labels.withColumn("toxic", F.when(learn.held_out(F.col("doc_id"), 4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, labels).collect())
    assert a == sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, flipped).collect())


@tables
@pytest.mark.parametrize("name, label, least", [("op2_nnpu_toxicity", "toxic", 0.9), ("op3_nbsvm_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    scored = QUERIES[name](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_nnpu_risk_never_rewards_memorising():
    rng = np.random.default_rng(0)
    positive = [np.array(sorted(rng.choice(500, 20, replace=False)), np.int32) for _ in range(40)]
    unlabelled = [np.array(sorted(500 + rng.choice(500, 20, replace=False)), np.int32) for _ in range(200)]
    w, b = toxicity.fit_nnpu(positive, unlabelled, 0.2, steps=60)
    assert np.isfinite(w).all() and abs(learn.sigmoid(learn.Sparse(unlabelled).scores(w) + b).mean() - 0.2) < 0.02


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    rows = [np.array(sorted(set(rng.integers(0, 40, 8))), np.int32) for _ in range(60)]
    y = np.array([int(5 in r or 7 in r) for r in rows])
    scale = np.ones(learn.SIZE)
    w, b = quality.dual_coordinate_descent(rows, y, scale, cost=0.1, rounds=400)
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.where(sign > 0, 1.0, (sign > 0).sum() / (sign < 0).sum())
    x = np.zeros((60, 41))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(len(r))
        x[i, 40] = 1

    def primal(v):
        return 0.5 * v @ v + (weight * np.maximum(0, 1 - sign * (x @ v))).sum()

    got = primal(np.append(w[:40], b))
    for _ in range(300):  # no nearby point is better
        assert primal(np.append(w[:40], b) + rng.normal(0, 0.01, 41)) >= got - 1e-3


def brute_statistics(text):
    import re

    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics_against_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab c# é| 漢".split()) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["", None, "  ", "a", "a b", "a b c a b c", "x\nx\n\n x\nx", "a a a a", "  nbsp em", "l1\r\nl1\r\n", "a b c d a b c d a b", "\x1c x \x85"]
    docs = list(enumerate(texts)) + [(None, "a b c"), (3, "a b c")]
    got = rules.text_statistics(spark.createDataFrame(docs, DOC).withColumn("w", F.lit(1)))
    rows = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got.collect())
    assert rows == sorted((str(d), *brute_statistics(t)) for d, t in docs)


def test_rules_are_learned_and_ordered(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        r = {c: rng.randint(0, 100) if not bad else 50 for c in rules.RATIOS} | {"n_symbols": 0, "n_dup_lines": 0, "n_repeat_words": 0, "n_repeats": 0, "bad": int(bad)}
        if bad:
            r["symbols_per_words" if i % 8 else "upper_per_chars"] = rng.randint(600, 900)
        rows.append(r)
    found = rules.learn_rules(rows)
    hit = [any(r.holds(x) for r in found) for x in rows]
    assert 2 <= len(found) <= 12 and np.mean([h == bool(x["bad"]) for h, x in zip(hit, rows, strict=True)]) > 0.98
    df = spark.createDataFrame(rows[:50]).select("*", rules.verdict(found).alias("rule"))
    assert [r.rule > 0 for r in df.collect()] == hit[:50]
    assert rules.learn_rules([]) == [] and rules.learn_rules([x for x in rows if not x["bad"]]) == []


def test_rules_on_edge_rows(spark):
    _, labels = toy(spark)
    docs = spark.createDataFrame(EDGE, DOC)
    got = rules.quality_rules(docs, labels, Scratch(spark)).collect()
    assert len(got) == len(EDGE) and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert rules.quality_rules(docs.limit(0), labels.limit(0), Scratch(spark)).count() == 0


@tables
def test_rules_keep_good_documents(spark):
    got = QUERIES["op5_decision_list_rules"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    r = got.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()
    kept = {x.quality: x.kept for x in r}
    assert kept[1] >= 0.99 and kept.get(0, 0) <= 0.3


def brute_rates(tokens, p, goal, steps=4000):
    """Projected gradient in plain numpy on the same objective, with small steps."""
    r = np.ones(len(tokens))
    inverse = np.linalg.pinv((tokens[:, None] * p).T @ p)
    for _ in range(steps):
        r = np.maximum(0, r - 0.5 * p @ (inverse @ ((tokens * r) @ p - goal)))
    return (tokens * r) @ p


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.3, 0.3], 300)
    tokens = rng.integers(0, 900, 300)
    df = spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    shares = np.array([0.6, 0.3, 0.1])
    steps, now, miss = mixing.fit_rates(df, shares)
    assert miss < 1e-4
    total = tokens.sum()  # the tokens there are, whichever domain is scarce
    assert abs(now - shares * total).max() / total < 1e-4
    rates = np.array([r.r for r in df.select("doc_id", mixing.rate_column(3, steps).alias("r")).orderBy("doc_id").collect()])
    assert (rates >= 0).all() and np.allclose((tokens * rates) @ p, now)
    assert np.allclose(now, brute_rates(tokens.astype(float), p, shares * total), rtol=1e-3)


def test_mixture_on_edge_rows(spark):
    docs, labels = toy(spark)
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(None if d is None else d + 1000, t) for d, t in EDGE], DOC))
    mixed, names = mixing.mixture(both, labels, Scratch(spark))
    rows = mixed.collect()
    assert len(rows) == 240 + len(EDGE) and all(r.rate >= 0 for r in rows) and names[0] == "clean"
    for j in range(len(names)):
        assert all(0 <= r[f"p{j}"] <= 1 for r in rows)
    none, names = mixing.mixture(docs, labels.limit(0), Scratch(spark))
    assert names == ["clean"] and all(abs(r.rate - 1) < 1e-9 for r in none.collect())
    assert mixing.mixture(docs.limit(0), labels, Scratch(spark))[0].count() == 0


def test_copies_have_the_rate_as_mean(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for rate in (1.4, 0.97, 0.02):
        got = df.select(mixing.copies(F.lit(rate), F.col("doc_id"), F.col("text")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
        assert abs(got[0] - rate) < 0.02 and (got[1], got[2]) == (int(rate), int(rate) + 1)


def test_rates_by_another_solver(spark):
    """Where no rate is cut at zero, the fit is the least change of the rates that meets the targets."""
    rng = np.random.default_rng(5)
    p, tokens = rng.dirichlet([3, 3, 3], 200), rng.integers(50, 900, 200).astype(float)
    df = spark.createDataFrame([(int(t), *map(float, q)) for t, q in zip(tokens, p, strict=True)], "n_tokens long, p0 double, p1 double, p2 double")
    shares, total = np.array([0.36, 0.33, 0.31]), tokens.sum()
    steps, _, _ = mixing.fit_rates(df, shares)
    # Minimise sum t (r - 1)^2 subject to p' diag(t) r = goal: Lagrange's equations, solved directly.
    a = (tokens[:, None] * p).T
    kkt = np.block([[np.diag(2 * tokens), a.T], [a, np.zeros((3, 3))]])
    want = np.linalg.solve(kkt, np.concatenate([2 * tokens, shares * total]))[:200]
    got = np.array([r[0] for r in df.select(mixing.rate_column(3, steps)).collect()])
    assert (want > 0).all() and np.allclose(np.sort(got), np.sort(want), atol=1e-4)


def test_bounds_and_scarce_domains_do_not_set_the_total(spark):
    rows = [(100, 0.98, 0.01, 0.01)] * 90 + [(100, 0.01, 0.98, 0.01)] * 9 + [(10, 0.01, 0.01, 0.98)]
    df = spark.createDataFrame(rows, "n_tokens long, p0 double, p1 double, p2 double")
    now = np.array([sum(n * r[j] for n, *r in rows) for j in range(3)])
    shares = np.array([0.9, 0.05, 0.05])
    steps, got, _ = mixing.fit_rates(df, shares, bounded=np.array([False, True, True]))
    total = now[0] / 0.9
    assert np.allclose(got, [now[0], 0.05 * total, now[2]], rtol=1e-3)
    rates = [r[0] for r in df.select(mixing.rate_column(3, steps)).collect()]
    assert min(rates[:90]) > 0.97 and max(rates[90:99]) < 0.6


def test_rates_of_one_copy_at_most(spark):
    rng = np.random.default_rng(8)
    p, tokens = rng.dirichlet([5, 0.6, 0.4], 300), rng.integers(5, 900, 300)
    df = spark.createDataFrame([(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    shares, bounded = np.array([0.95, 0.03, 0.02]), np.array([False, True, True])
    free, _, _ = mixing.fit_rates(df, shares, bounded=bounded)
    steps, now, miss = mixing.fit_rates(df, shares, bounded=bounded, most=1.0)
    rates = np.array([r.r for r in df.select("doc_id", mixing.rate_column(3, steps, 1.0).alias("r")).orderBy("doc_id").collect()])
    assert max(r[0] for r in df.select(mixing.rate_column(3, free)).collect()) > 1 >= rates.max() and rates.min() >= 0
    assert np.allclose((tokens * rates) @ p, now)
    total = (tokens @ p)[0] / 0.95  # of the clean tokens there are
    assert miss < 5e-3 and (now[1:] <= (shares[1:] + 5e-3) * total).all() and now[0] > 0.6 * (tokens @ p)[0]


def test_targets_out_of_reach_are_said(spark):
    """Every document half of each domain: no rates give nine tenths to one."""
    df = spark.createDataFrame([(100, 0.5, 0.5)] * 20, "n_tokens long, p0 double, p1 double")
    _, now, miss = mixing.fit_rates(df, np.array([0.9, 0.1]))
    assert miss > 0.3 and now[0] == now[1]
    docs, labels = toy(spark)
    with pytest.warns(UserWarning, match="rates miss the targets"):
        mixing.mixture(docs, labels, Scratch(spark), most_miss=-1.0)


def newton(positive, unlabelled, prior, size, decay=1e-4, steps=60):
    """The least of the unclipped risk, which is convex for the logistic loss, by Newton's method on dense rows."""
    dense = lambda rows: np.array([[1.0 if j in set(r.tolist()) else 0.0 for j in range(size)] + [1.0] for r in rows])
    p, u, w = dense(positive), dense(unlabelled), np.zeros(size + 1)
    ridge = np.diag([decay] * size + [1e-9])
    risk = lambda w: np.logaddexp(0, u @ w).mean() - prior * (p @ w).mean() + 0.5 * decay * (w[:-1] @ w[:-1])
    for _ in range(steps):
        s = 1 / (1 + np.exp(-(u @ w)))
        g = u.T @ s / len(u) - prior * p.mean(0) + ridge @ w
        h = (u * (s * (1 - s))[:, None]).T @ u / len(u) + ridge
        move, size_of = np.linalg.solve(h, g), 1.0
        while risk(w - size_of * move) > risk(w) and size_of > 1e-6:
            size_of /= 2
        w = w - size_of * move
    return w


def test_nnpu_reaches_the_least_risk():
    """Where the corrected part stays positive, the fit and Newton's method on the same risk score alike."""
    rng = np.random.default_rng(3)
    draw = lambda toxic: np.array(sorted({*rng.integers(0, 8, 3 if toxic else 1), *rng.integers(8, 24, 6)}), np.int32)
    positive, unlabelled = [draw(True) for _ in range(200)], [draw(i % 5 == 0) for i in range(1000)]
    w, b = toxicity.fit_nnpu(positive, unlabelled, 0.2, steps=4000, rate=0.005, decay=0.03, min_documents=1, lift=0.0)
    best = newton(positive, unlabelled, 0.2, 24, decay=0.03)
    ours, theirs = np.array([w[r].sum() for r in unlabelled]), np.array([best[r].sum() for r in unlabelled])
    spread = theirs.std()
    assert np.corrcoef(ours, theirs)[0, 1] > 0.999 and abs((ours - ours.mean()) - (theirs - theirs.mean())).max() < 0.2 * spread
    assert abs(np.mean(1 / (1 + np.exp(-(ours + b)))) - 0.2) < 1e-3


@tables
def test_toxicity_query_recomputed(spark):
    """Every row of the query from plain Python: samples, features as sets, the fitted weights summed one by one."""
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    labelled = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic IS NOT NULL").collect()}
    held = {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    features = {d: learn.features_of([(t or "").encode()], shapes=False)[0][0] for d, t in docs.items()}
    seen = sorted(d for d in docs if d in labelled and d not in held)
    positive = [features[d] for d in seen if d in toxic]
    unlabelled = [features[d] for d in sorted(docs) if d not in held]
    prior = len(positive) / len(seen)
    w, b = toxicity.fit_nnpu(positive, unlabelled, prior)
    got = {r.doc_id: r for r in QUERIES["op2_nnpu_toxicity"](spark, SF).collect()}
    assert set(got) == set(docs)
    for d, r in got.items():
        z = b
        for f in features[d].tolist():
            z += w[f]
        score = 1 / (1 + np.exp(-min(40.0, max(-40.0, z))))
        assert abs(r.score - score) < 1e-9 and r.predicted == int(score >= 0.3) and r.held_out == (d in held)


def test_sample_is_bounded_in_rows_and_bytes(spark):
    """One doc_id thousands of times is one row; features beyond the bound are not collected."""
    rows = [(7, f"text number {i}") for i in range(3000)] + [(i, " ".join(f"w{i}x{j}" for j in range(400))) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [7, *range(100, 160)]], LABEL)
    got, by = learn.labelled_sample(docs, labels, ["quality"], 1, 1, max_rows=100)
    assert len(got) == 61 and len(by["quality"]) == 61
    some, _ = learn.labelled_sample(docs, labels, ["quality"], 1, 1, max_rows=20)
    assert len(some) == 20
    most = sum(r.nbytes for r in got) // 2
    few, _ = learn.labelled_sample(docs, labels, ["quality"], 1, 1, max_rows=100, max_bytes=most)
    assert 20 < len(few) < 40 and sum(r.nbytes for r in few) <= most
    again, _ = learn.labelled_sample(docs.repartition(2), labels, ["quality"], 1, 1, max_rows=100, max_bytes=most)
    assert all((a == b).all() for a, b in zip(few, again, strict=True))


def brute_risk(w, b, positive, unlabelled, prior):
    """The non-negative risk in plain Python."""
    import math

    def loss(rows, sign):
        return sum(math.log1p(math.exp(-sign * (b + sum(w[f] for f in r)))) for r in rows) / len(rows)

    return prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - prior * loss(positive, -1))


def test_nnpu_against_its_risk():
    """The fit lowers the risk of plain Python far below that of the start and of the bias alone."""
    rng = np.random.default_rng(6)
    positive = [np.array(sorted({*rng.integers(0, 6, 2), *rng.integers(20, 60, 6)}), np.int32) for _ in range(60)]
    unlabelled = positive[:20] + [np.array(sorted({*rng.integers(20, 60, 8)}), np.int32) for _ in range(180)]
    w, b = toxicity.fit_nnpu(positive, unlabelled, 0.1)
    got = brute_risk(w, b, positive, unlabelled, 0.1)
    alone = min(brute_risk(np.zeros(60), x, positive, unlabelled, 0.1) for x in np.linspace(-5, 1, 61))
    assert got < 0.5 * alone
    hit = [learn.sigmoid(b + w[r].sum()) >= 0.3 for r in unlabelled]
    assert np.mean(hit[:20]) > 0.9 and np.mean(hit[20:]) < 0.05


def test_quality_scores_recomputed(spark):
    """Scores of the query's operator against a plain recomputation from the fitted model."""
    docs, labels = toy(spark, 120)
    rows, by = learn.labelled_sample(docs, labels, ["quality"], 5, 0, 8000)
    scale, weights, bias, (slope, shift) = quality.quality_model(rows, by["quality"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality_scores(docs, labels).collect():
        f = learn.features_of([texts[r.doc_id].encode()])[0][0]
        z = sum(scale[j] * weights[j] for j in f) / np.sqrt(sum(scale[j] ** 2 for j in f) + 1e-12) + bias
        assert abs(r.score - 1 / (1 + np.exp(-(slope * z + shift)))) < 1e-9
    good, bad = [t for t, y in zip(rows, by["quality"], strict=True) if y == 1], [t for t, y in zip(rows, by["quality"], strict=True) if y != 1]
    ratio = quality.log_count_ratio(rows, by["quality"])
    p, q = 1 + learn.document_counts(good), 1 + learn.document_counts(bad)
    assert np.allclose(ratio, np.log((p / p.sum()) / (q / q.sum())))


def test_quality_filter_on_edge_rows(spark):
    docs, labels = toy(spark)
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(None if d is None else d + 1000, t) for d, t in EDGE], DOC)).withColumn("score", F.lit("clash")).withColumn("id", F.lit(1))
    kept = quality.keep_good(some, labels)
    assert kept.columns == some.columns
    scored = {(r.doc_id, r.score >= 0.3) for r in quality.quality_scores(some, labels).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, ok in scored if ok}
    assert quality.keep_good(some, labels.limit(0)).count() == some.count() and quality.keep_good(some.limit(0), labels).count() == 0


def brute_list(rows, columns, rounds=12):
    """Sequential covering by trying every threshold of every column."""
    from math import log2

    def covered(rule, some):
        return [r for r in some if all((r[c] >= t) == up for c, up, t in rule)]

    def bad(some):
        return sum(r["bad"] for r in some)

    out, left = [], rows
    while len(out) < rounds and 0 < bad(left) < len(left):
        grow, aside = [r for i, r in enumerate(left) if i % 3], left[::3]
        rule, hit = [], grow
        while len(rule) < 4 and 0 < bad(hit) < len(hit):
            best = (1e-9, None)
            for c in columns:
                values = sorted({r[c] for r in hit})
                for a, z in zip(values, values[1:]):
                    for up in (True, False):
                        t = (a + z + 1) // 2
                        n = covered([(c, up, t)], hit)
                        if n and bad(n):
                            gain = bad(n) * (log2(bad(n) / len(n)) - log2(bad(hit) / len(hit)))
                            if gain > best[0]:
                                best = (gain, (c, up, t))
            if best[1] is None:
                break
            rule.append(best[1])
            hit = covered([best[1]], hit)
        if not rule:
            break

        def worth(some):
            n = covered(some, aside)
            return ((2 * bad(n) - len(n)) / len(n) if n else -1.0, bad(n))

        pruned = rule
        for k in range(len(rule) - 1, 0, -1):
            if worth(rule[:k]) >= worth(pruned):
                pruned = rule[:k]
        sound = [x for x in (pruned, rule) if len(covered(x, left)) >= 5 and len(covered(x, left)) - bad(covered(x, left)) <= 0.02 * len(covered(x, left))]
        if not sound:
            break
        out.append(sound[0])
        left = [r for r in left if not covered(sound[0], [r])]
    return out


def test_decision_list_against_plain_covering():
    rng = random.Random(21)
    for _ in range(4):
        rows = []
        for i in range(150):
            r = {c: rng.randint(0, 12) for c in ("symbols_per_words", "upper_per_chars", "n_symbols")}
            rows.append(r | {"bad": int(r["upper_per_chars"] >= 9 or (r["symbols_per_words"] < 3 and r["n_symbols"] > 6))})
        got = [tuple((c.column, c.at_least, c.threshold) for c in rule.conditions) for rule in rules.learn_rules(rows)]
        assert got == [tuple(r) for r in brute_list(rows, ["symbols_per_words", "upper_per_chars", "n_symbols"])]
