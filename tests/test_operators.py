"""Operators on small frames, with missing facts, ties and empty inputs."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from bidloom.operators import amendments as A
from bidloom.operators import compliance as C
from bidloom.operators import jobs as J
from bidloom.operators import pages as P
from bidloom.operators import requirements as R
from bidloom.operators import retrieval as X
from bidloom.operators import shortlist as S
from bidloom.operators import statistics as T
from bidloom.operators import storage as G


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_shortlist_keeps_ties_and_unknowns(spark):
    pool = [("A", 9.0), ("B", 6.0), ("C", 3.0), ("D", 6.0), ("N", None)]
    df = spark.createDataFrame([(1, v, e, None, 0.0, None) for v, e in pool], "pool int, vendor_id string, experience double, project_scale double, technical_approach double, pricing double")
    scored = S.score(df, {"experience": 1.0}, ["pool"])
    assert rows(S.shortlist(scored, 2, ["pool"]), "vendor_id", "tied_at_cutoff") == [("A", False), ("B", True), ("D", True)]
    assert rows(S.shortlist(scored, 5, ["pool"]), "vendor_id") == [("A",), ("B",), ("C",), ("D",), ("N",)]
    assert [r.score for r in scored.where("vendor_id = 'N'").collect()] == [None]


def test_null_facts_are_not_failures(spark):
    criteria = spark.createDataFrame(
        [(1, 1, "Annual turnover", "numeric", None, True, "4.1", Decimal("100.00"), None), (1, 2, "Experience", "numeric", "years", True, "4.2", None, 5.0), (1, 3, "Works of 13 MW", "numeric", "MW", True, None, None, 13.0), (1, 4, "Turnover", "numeric", None, True, None, None, None)],
        "tender_id int, pos int, criterion string, type string, unit string, is_mandatory boolean, clause_ref string, threshold_amount_inr decimal(18,2), threshold_number double",
    )
    facts = spark.createDataFrame(
        [(1, "a", None, None, 8.0, None, None, 0, None, False), (1, "b", 50.0, 2020, 2.0, None, None, 2, 5.0, True)],
        "tender_id int, vendor_id string, best_turnover double, best_year int, years_in_business double, liquid_assets_inr double, net_worth_inr double, project_count long, largest_project double, is_blacklisted boolean",
    )
    items = C.numeric_items(criteria, facts)
    assert rows(items.where("vendor_id = 'a'"), "pos", "status") == [(1, "not_assessable"), (2, "match"), (3, "manual_check"), (4, "not_assessable")]
    assert rows(items.where("vendor_id = 'b'"), "pos", "status", "severity") == [(1, "missing", "disqualifying"), (2, "missing", "disqualifying"), (3, "manual_check", "review"), (4, "not_assessable", "review")]
    out = C.eliminations(items, ["tender_id", "vendor_id"])
    assert rows(out, "vendor_id", "status", "clause_ref") == [("a", "pending", None), ("b", "eliminated", "4.1")]
    assert "Clause 4.2: " in out.where("vendor_id = 'b'").first()["reason"]


def test_partial_alone_is_compliant(spark):
    df = spark.createDataFrame([(1, "partial", "review", True)], "k int, status string, severity string, is_mandatory boolean")
    assert C.verdicts(df, ["k"]).first()["verdict"] == "compliant"


def test_blacklisted_fails_even_if_not_mandatory(spark):
    criteria = spark.createDataFrame([(1, 1, "not debarred", "boolean", False), (1, 2, "registered with the board", "boolean", True)], "tender_id int, pos int, criterion string, type string, is_mandatory boolean")
    facts = spark.createDataFrame([(1, "a", True), (1, "b", None)], "tender_id int, vendor_id string, is_blacklisted boolean")
    assert rows(C.boolean_items(criteria, facts), "vendor_id", "pos", "severity") == [("a", 1, "disqualifying"), ("b", 1, "review")]


def _match(spark, required, offered):
    none = F.array().cast("array<string>")
    r = spark.createDataFrame([(1, required)], "g int, label string").select("g", F.lit("k").alias("key"), "label", none.alias("aliases"))
    s = spark.createDataFrame([(1, n, i) for i, n in enumerate(offered)] or [], "g int, name string, pos int")
    return R.match_documents(r, s, ["g"]).first()


def test_matching_tiers(spark):
    assert _match(spark, "PAN Card", ["Solvency certificate", "pan card"]).method == "exact"
    assert _match(spark, "PAN Card", ["Permanent Account Number"]).method == "alias"
    assert _match(spark, "Manufacturers authorization form", ["OEM authorisation form"]).method == "lexical"
    assert _match(spark, "Bid Securing Declaration", ["Letter of Bid"]).matched is False
    assert _match(spark, "Solvency certificate", ["ISO certificate"]).matched is False
    assert _match(spark, "PAN Card", []).matched is False


def test_a_refused_winner_is_for_review(spark):
    got = _match(spark, "Annexure-IV Price Schedule", ["Annexure V Price Schedule", "Price Schedule"])
    assert (got.matched, got.name) == (False, "Price Schedule")


def test_deduplicate(spark):
    df = spark.createDataFrame(
        [(1, 3, "Power of Attorney, if applicable", None), (1, 1, "Submission of Power of Attorney", "7.1"), (1, 2, "PAN Card", None)], "tender_id int, pos int, doc_name string, clause_ref string"
    ).withColumn("aliases", F.array().cast("array<string>"))
    got = R.deduplicate(df)
    assert rows(got, "pos", "label", "applicability") == [(1, "Power of Attorney", "always"), (2, "PAN Card", "always")]


def test_sign_test_and_kappa(spark):
    p = lambda a, b: spark.range(1).select(T.sign_test(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")).alias("p")).first()["p"]
    assert abs(p(6, 0) - 0.03125) < 1e-9 and abs(p(5, 0) - 0.0625) < 1e-9 and p(0, 0) == 1.0
    k = lambda pairs: T.kappa(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()["kappa"]
    assert abs(k([(0, 0)] * 35 + [(1, 1)] * 35 + [(0, 1)] * 15 + [(1, 0)] * 15) - 0.4) < 1e-9
    assert k([(1, 1)] * 3) == 1.0 and k([]) == 0.0


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(float(i % 5),) for i in range(60)], "v double")
    r = T.bootstrap_mean(df, "v", 300).first()
    assert r["mean"] == 2.0 and 1.4 < r["low"] < 2.0 < r["high"] < 2.6 and r["p"] == 0.0
    empty = T.bootstrap_mean(df.limit(0), "v", 20).first()
    assert (empty["mean"], empty["p"]) == (0.0, 1.0)


def test_bootstrap_draws_per_distinct_value(spark):
    """A million rows of three values: the interval is that of the normal law, and p is fine-grained in the query."""
    df = spark.range(1_000_000).select((F.col("id") % 3 - 1 + F.lit(0.001)).cast("double").alias("v"))
    r = T.bootstrap_mean(df, "v", 10_000).first()
    half = 1.96 * (2 / 3) ** 0.5 / 1000
    assert abs(r.mean - 0.001) < 1e-5 and abs(r.low - (r.mean - half)) < 0.05 * half and abs(r.high - (r.mean + half)) < 0.05 * half
    assert abs(r.p - 0.2207) < 0.02
    again = T.bootstrap_mean(df.repartition(7), "v", 10_000).first()
    assert abs(r.low - again.low) < 1e-9 and r.p == again.p


def test_bootstrap_query_has_ten_thousand_resamples(spark, monkeypatch):
    from bidloom.plans import QUERIES

    asked, whole = [], T.bootstrap_mean
    monkeypatch.setattr(T, "bootstrap_mean", lambda v, c, resamples=2000, **k: asked.append(resamples) or whole(v, c, resamples, **k))
    monkeypatch.setattr("bidloom.plans.analytics.read", lambda s, d, t: s.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"))
    assert QUERIES["q51_bootstrap"](spark, "").count() == 1 and asked == [10_000]


def test_amendments_never_guess(spark):
    criteria = spark.createDataFrame([(1, 1, "turnover", "4.1", "Rs. 1 Cr"), (1, 2, "worth", "4.2", "Rs. 1 Cr")], "tender_id int, criterion_id int, criterion string, clause_ref string, threshold_raw string")
    path = "eligibility_criteria[0].threshold_amount"
    changes = spark.createDataFrame(
        [(1, 1, path, "4.1", None, "Rs. 2 Cr"), (1, 2, path, None, "rs.  1 cr", "Rs. 2 Cr"), (1, 3, path, "8", "x", "Rs. 2 Cr"), (1, 4, path, "4.2", None, None), (1, 5, "deadline", "4.1", None, "x"), (1, 6, path, "4.1", None, "soon")],
        "tender_id int, change_id int, field_path string, clause_ref string, old_value string, new_value string",
    )
    got = A.criterion_changes(changes, criteria)
    assert rows(got, "change_id", "outcome") == [(1, "applied"), (2, "ambiguous"), (3, "conflict"), (4, "applied"), (5, "unsupported"), (6, "unsupported")]
    after = A.apply_thresholds(spark.createDataFrame([(1, 5.0, True), (2, 5.0, True)], "criterion_id int, threshold double, is_mandatory boolean"), got)
    assert rows(after, "criterion_id", "threshold", "is_mandatory") == [(1, 2e7, True), (2, 5.0, False)]


def test_impact_directions(spark):
    s = "v string, status string, clause_ref string"
    before = spark.createDataFrame([("a", "eliminated", "1"), ("b", "pending", None), ("c", "eliminated", "1"), ("d", "pending", None)], s)
    after = spark.createDataFrame([("a", "pending", None), ("b", "eliminated", "1"), ("c", "eliminated", "2"), ("d", "pending", None)], s)
    assert rows(A.impact(before, after, ["v"]), "v", "direction") == [("a", "reinstated"), ("b", "newly_eliminated"), ("c", "reason_changed"), ("d", "unchanged")]


def test_split_text():
    assert P.split_text(None) == [] and P.split_text("  ") == [] and P.split_text("short") == ["short"]
    long = "A sentence here. " * 300
    pieces = P.split_text(long, 400, 50)
    assert all(len(p) <= 400 for p in pieces) and sum(p.count("sentence") for p in pieces) == 300
    assert [len(p) for p in P.split_text("x" * 1000, 400, 100)] == [400, 400, 400]


def test_tabular(spark):
    t = lambda table: spark.range(1).select(P.looks_tabular(F.array(*(F.array(*(F.lit(c) for c in r)) for r in table))).alias("x")).first()["x"]
    assert t([["a", "b"], ["1", "2"]]) and not t([["a", "b"]]) and not t([["a"], ["b"]]) and not t([["a", "", ""], ["b", "", ""]])


def test_bm25_counts_repeated_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, None)], "doc_id int, text string")
    score = lambda q: {r.doc_id: r.score for r in X.bm25(docs, spark.createDataFrame([(1, q)], "query_id int, text string")).collect()}
    one, two = score("beta"), score("beta beta")
    assert abs(two[1] - 2 * one[1]) < 1e-9 and 3 not in one


def test_upsert_and_cache(spark):
    s = "k int, v string, at int"
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], s), spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], s)
    assert rows(G.upsert(old, new, ["k"], "at"), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(G.insert_if_absent(old, new, ["k"], ["at"]), "k", "v") == [(3, "e")]
    assert rows(G.upsert(G.upsert(old, new, ["k"], "at"), new, ["k"], "at"), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]


def test_job_timeout_and_claim(spark):
    e = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0), 1, "running"), (2, datetime(2024, 1, 1, 0, 50), 2, "running"), (2, datetime(2024, 1, 1, 0, 10), 3, "queued")], "j int, ts timestamp, id int, state string")
    st = J.with_timeout(J.latest_state(e, "j", ["ts", "id"], "state"), F.lit(datetime(2024, 1, 1, 1, 0)))
    assert rows(st, "j", "state") == [(1, "failed"), (2, "running")]
    assert rows(J.claim(e.withColumn("lane", F.lit(0)), ["lane"], ["ts", "id"]), "j") == [(1,)]


def test_running_totals_by_ranges(spark):
    from bidloom.operators.running import running

    rows = [(k, i, (i * 7 + len(k)) % 5) for k in ("a", "hot") for i in range(60 if k == "hot" else 4)] + [(None, 1, 9), (None, 5, 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(5)
    got = running(df, ["k"], ["i"], {"total": F.col("v")}, {"high": F.col("v")}).collect()
    for r in got:
        before = [v for k, i, v in rows if k == r.k and i <= r.i]
        assert (r.total, r.high) == (sum(before), max(before))
    assert len(got) == len(rows) and running(df.limit(0), ["k"], ["i"], {"n": F.lit(1)}).count() == 0


def test_bm25_top_equals_scoring_everything(spark):
    import random

    from bidloom.operators import retrieval as X

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    weight = [1 / (i + 1) for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weight, k=rng.randint(0, 30)))) for i in range(200)], "doc_id int, text string")
    queries = spark.createDataFrame([(i, " ".join(rng.choices(words, weight, k=8))) for i in range(25)] + [(99, "nowhere"), (98, "")], "query_id int, text string")
    every = X.top(X.bm25(docs, queries).withColumn("score", F.round("score", 6)), 5)
    got = X.bm25_top(docs, queries, 5)
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 4)) for r in df.collect())
    assert key(got) == key(every) and X.bm25_top(docs.limit(0), queries, 5).count() == 0


def test_bm25_top_in_tiles(spark):
    """Copies, words with stops, a document in two rows, many slices and tiles: the same as scoring every pair, which are never rows."""
    import random

    from bidloom.operators import retrieval as X

    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["w1.", "w2,", "3.5%", "the", "Ü", "w3.,."]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(1000 + i, texts[i % 3]) for i in range(90)] + [(5, texts[5]), (2000, None), (2001, "THE W1.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices(words, k=7))) for i in range(20)] + [("copy", texts[0])], "query_id string, text string")
    every = X.top(X.bm25(docs, queries).withColumn("score", F.round("score", 6)), 6)
    got = X.bm25_top(docs, queries, 6, slice_=100, tile=8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan
    key = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    assert key(got) == key(every) == key(X.bm25_top(docs, queries, 6))


def test_rate_limit_against_a_bucket(spark):
    import random

    from bidloom.operators import jobs as J

    rng = random.Random(5)
    rows = [(k, float(t), rng.choice([1.0, 50.0, 400.0]), i) for k in ("x", "y") for i, t in enumerate(sorted(rng.randrange(0, 20_000) for _ in range(60)))]
    df = spark.createDataFrame(rows, "k string, at double, cost double, i int").repartition(3)
    got = {(r.k, r.i): r.wait for r in J.rate_limit(df, "k", "at", "cost", 0.5, 300.0, "i").collect()}
    for k in ("x", "y"):
        level, last = 300.0, None
        for key, at, cost, i in sorted(r for r in rows if r[0] == k):
            level = min(300.0, level + (0 if last is None else (at - last) * 0.5)) - cost
            last = at
            assert abs(got[k, i] - max(0.0, -level / 0.5)) < 1e-6


def test_stream_results_are_upserted(spark, tmp_path):
    from bidloom.streaming import ingest

    schema = "event_id long, ts timestamp, job_id long, state string"
    for n, rows in enumerate([[(1, 1, "queued"), (2, 2, "queued")], [(3, 1, "running")], [(4, 1, "failed"), (5, 3, "queued")]]):
        spark.createDataFrame([(e, j, s) for e, j, s in rows], "event_id long, job_id long, state string").withColumn("ts", F.timestamp_seconds("event_id")).select("event_id", "ts", "job_id", "state").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = ingest.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_trigger=1)
    out = ingest.run_available(ingest.job_states(events, "job_id", "ts", "state"), ["job_id"])
    assert sorted((r.job_id, r.state, r.events) for r in out.collect()) == [(1, "failed", 3), (2, "queued", 1), (3, "queued", 1)]
    assert schema


def test_recovered_jobs(spark):
    import datetime

    from bidloom.operators import jobs as J

    t = datetime.datetime(2025, 1, 1)
    rows = [(1, "running", t, 1), (2, "running", t, 3), (3, "running", None, 0), (4, "queued", t, 0), (5, "running", t + datetime.timedelta(days=2), 0)]
    got = J.recovered(spark.createDataFrame(rows, "id int, state string, lease_ends_at timestamp, attempts int"), F.lit(t + datetime.timedelta(days=1))).collect()
    assert {r.id: (r.state, r.recovered) for r in got} == {1: ("queued", True), 2: ("failed", True), 3: ("running", False), 4: ("queued", False), 5: ("running", False)}


def test_unverifiable_citations(spark):
    from bidloom.operators import pages as P
    from bidloom.operators import validation as Y

    text = "1.1  Scope of work\n (4) The contractor shall provide\n28.1 The manager will evaluate\n49.855 Crores\n0.973 is a ratio\n12\n"
    docs = spark.createDataFrame([(1, text), (2, "no numbering at all"), (3, None)], "doc_id int, text string")
    cited = [(1, "1.1 (4)"), (1, "2.8.1"), (1, "28.1"), (1, "49.855"), (1, "1.1 (5)"), (1, None), (2, "7.7"), (3, "7.7")]
    got = Y.unverifiable(spark.createDataFrame(cited, "doc_id int, clause_ref string"), P.lines_of(docs)).collect()
    assert sorted((r.doc_id, r.clause_ref, r.suggestion) for r in got) == [(1, "1.1 (5)", None), (1, "2.8.1", "28.1"), (1, "49.855", None)]


def test_point_ids_are_version_five(spark):
    import uuid

    from bidloom.operators import validation as Y

    rows = spark.createDataFrame([("doc", i) for i in range(40)] + [("é", 3)], "owner string, i int")
    for r in rows.select("owner", "i", Y.point_id(F.col("owner"), F.col("i")).alias("id")).collect():
        assert r.id == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.owner}:{r.i}"))
