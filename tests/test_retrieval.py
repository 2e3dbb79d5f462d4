"""Blocked top-k, header values, rewording and reports against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.functions import headers as H
from bidloom.functions import rewording as W
from bidloom.functions.names import normalise_name, normalised
from bidloom.operators import evidence as E
from bidloom.operators import pages as P
from bidloom.operators import retrieval as X
from bidloom.plans.base import NAMES


def plain_nearest(queries, chunks, k, scope=False):
    out = {}
    for i, q, *own in queries:
        if q is None or i is None:
            continue
        scored = sorted((-round(float(np.dot(q, v)), 9), c) for c, v, *other in chunks if v is not None and (not scope or own == other))
        out[i] = [(c, -s) for s, c in scored[:k]]
    return {i: v for i, v in out.items() if v}


def vectors(n, seed, clusters=6, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, dim))
    return [tuple(map(float, v)) for v in x / np.linalg.norm(x, axis=1)[:, None]]


def got_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 9)))
    return out


@pytest.mark.parametrize("k, tile, pivots", [(1, 16, 5), (4, 16, 12), (4, 4096, 64), (50, 7, 3)])
def test_nearest_against_all_pairs(spark, k, tile, pivots):
    x = vectors(150, k)
    chunks = [(i, list(v)) for i, v in enumerate(x)] + [(200 + i, list(x[0])) for i in range(30)] + [(400, None)]  # thirty copies of one
    queries = [(i, list(v)) for i, v in enumerate(vectors(20, 9))] + [(50, list(x[0])), (51, None)]
    q, c = spark.createDataFrame(queries, "query_id int, q array<double>"), spark.createDataFrame(chunks, "chunk_id int, embedding array<double>").repartition(3)
    found = X.nearest(q, c, k, pivots=pivots, tile=tile)
    assert {i: [x for x, _ in v] for i, v in got_of(found).items()} == {i: [x for x, _ in v] for i, v in plain_nearest(queries, chunks, k).items()}
    assert X.nearest(q, c.limit(0), k).count() == X.nearest(q.limit(0), c, k).count() == 0


def test_nearest_within_a_scope(spark):
    x = vectors(90, 3)
    chunks = [(i, list(v), i % 4 if i % 9 else None) for i, v in enumerate(x)]
    c = spark.createDataFrame(chunks, "chunk_id int, embedding array<float>, scope int")
    q = c.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"), "scope")
    plain = [(i, list(np.float32(v).astype(float)), s) for i, v, s in chunks]
    want = plain_nearest([r for r in plain if r[0] % 5 == 0 and r[2] is not None], [r for r in plain if r[2] is not None], 3, True)
    assert {i: [x for x, _ in v] for i, v in got_of(X.nearest(q, c, 3, ["scope"], tile=5)).items()} == {i: [x for x, _ in v] for i, v in want.items()}


def test_blocks_out_of_reach_are_skipped(spark):
    """Well-separated blocks: a question meets a part of the vectors, and far fewer rows than pairs are formed."""
    x = vectors(400, 4, clusters=8)
    c = spark.createDataFrame([(i, list(v)) for i, v in enumerate(x)], "chunk_id int, embedding array<double>")
    q = c.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    centres = np.array(x[:40])
    dealt = X._dealt(c, centres, ["chunk_id", "embedding"])
    radii = {r["block"]: r["far"] for r in dealt.groupBy("block").agg(F.max("far").alias("far")).collect()}
    seeds = X._ranked(X._tiles(X._asking(q, centres, radii, True), dealt, ["block"], 5, 64), 5)
    floors = seeds.where("rank = 5").select("query_id", F.col("score").alias("floor"))
    rest = X._asking(q.join(floors, "query_id", "left"), centres, radii, False).count()
    assert rest < 400 * len(radii) / 2
    assert got_of(X.nearest(q, c, 5, pivots=40)) == got_of(X.nearest(q, c, 5, pivots=1))


LINES = {
    "submission_deadline": ["Last Date and Time for uploading of e-Bids", "BID SUBMISSION END DATE & TIME", "Last date of online submission", "Due date and time for submission", "Closing date for the tender", "End date of bid submission"],
    "pre_bid_query_deadline": ["Last Date and Time for receipt of Queries", "Pre-bid conference (hall 2) date", "Last date for seeking clarifications"],
    "emd_amount": ["Earnest Money Deposit (EMD)", "the EMD", "Bid Security amount"],
}


def test_a_line_for_each_label(spark):
    pages, want = [], {}
    for field, lines in LINES.items():
        assert len(lines) == len(H.FIELDS[field][0])
        for rank, line in enumerate(lines):
            for here in (True, False):
                value = "Rs. 31,500/-" if field == "emd_amount" else "22 August 2026"
                pages.append((len(pages), 1, f"prose\n{line}: {value}" if here else f"{line}\n {value} and more"))
                want[len(pages) - 1] = (field, value, rank)
    df = spark.createDataFrame(pages, "doc_id int, page_number int, text string")
    got = {r.doc_id: (r.field, r.value) for r in P.header_values(df).collect()}
    assert got == {i: (f, v) for i, (f, v, _) in want.items()}
    ranks = df.select("doc_id", *(H.labelled(H.page_lines(F.col("text")), f)["rank"].alias(f) for f in H.FIELDS)).collect()
    assert all(r[want[r.doc_id][0]] == want[r.doc_id][2] for r in ranks)


def test_ranks_pages_and_what_must_not_count(spark):
    day = "22.08.2026"
    pages = [
        (1, 2, f"End date of bid submission {day}\nLast date for upload of bids 23.08.2026"), (1, 3, "Last date for upload of bids 24.08.2026"),  # label before line, page before label
        (2, 1, f"Last date of submission of EMD {day}"), (2, 2, f"Bid submission date ........ {day}"), (2, 3, "Bid submission date 31.02.2026"), (2, 4, f"Bid submission date {day}"),
        (3, 1, "EMD 1% of the ECV\nbut later Rs. 5,000"), (4, 1, "EMD as per Form 4 Rs. 5,000"), (5, 1, None),
        (6, 1, "x\nTender of the Corporation\n Greater  Hyderabad\tMunicipal Corporation \nIndian Institute of Technology"), (7, 1, "Board"), (7, 2, "12345 67890 1234 Board 99"), (7, 3, "Jal Board of the town"),
        (8, 1, "\n".join(["a"] * 8 + ["Municipal Corporation of X"])), (8, 2, "Municipal Corporation of X\r\nEMD Rs 1,00,000\r\n"),
    ]
    got = sorted((r.doc_id, r.field, r.value, r.page_number) for r in P.header_values(spark.createDataFrame(pages, "doc_id int, page_number int, text string")).collect())
    assert got == [
        (1, "submission_deadline", "23.08.2026", 2), (2, "submission_deadline", day, 4), (3, "emd_amount", "Rs. 5,000", 1), (6, "issuing_authority", "Greater Hyderabad Municipal Corporation", 1),
        (8, "emd_amount", "Rs 1,00,000", 2), (8, "issuing_authority", "Municipal Corporation of X", 2),
    ]


def test_renaming_keeps_references_to_forms(spark):
    """Any name that quotes a numbered form comes through as it is, or as another name of the document from the table."""
    forms = ["Form F-13", "annexure IV", "Appendix: 2", "Schedule no. 7/a", "PROFORMA-B", "Format 9"]
    names = [n for n in NAMES if not re.search(W.FORM_REFERENCE, n)]
    rows = [(f"{a} {f} {b}".strip(), s) for f in forms for a in ["", *names] for b in ("", "of Experience") for s in W.STYLES]
    got = spark.createDataFrame(rows, "name string, style string").withColumn("to", W.renamed(F.col("name"), F.col("style"))).collect()
    said = {x for names in W.other_names().values() for _, x in names}
    assert all(r.to == r.name or r.to in said for r in got)


def test_renaming_changes_what_matching_sees(spark):
    names = [*NAMES, "Certificate of the Bank", "Work Orders and work orders", "", None, "Proof of Registration", "nothing to change"]
    rows = spark.createDataFrame([(n, s) for n in names for s in W.STYLES], "name string, style string")
    got = rows.select("name", "style", W.renamed(F.col("name"), F.col("style")).alias("to"), normalise_name(F.col("name")).alias("a"), normalise_name(W.renamed(F.col("name"), F.col("style"))).alias("b")).collect()
    assert all(r.to == r.name for r in got if r.style == "as_printed")
    assert all(r.to == r.name or r.a != r.b for r in got)
    by = {(r.name, r.style): r.to for r in got}
    assert by["PAN Card", "alias"] == "Permanent Account Number" and by["Permanent Account Number", "alias"] == "PAN Card"
    assert by["Work Orders and work orders", "reworded"] == "purchase orders placed on us and work orders"
    assert by["Certificate of the Bank", "reworded"] == "Bank Certificate" and by["nothing to change", "alias"] == "nothing to change"
    assert by["Proof of Registration", "reworded"] == "documentary evidence of Registration"
    assert len(W.SUBSTITUTIONS) == 30 and all(normalised(p) for names in W.other_names().values() for p, _ in names)


def test_extraction_report_and_truth(spark):
    rows = [("m", "bare", "d1", "emd", "31,500", "Rs. 31,500/-", 2.5), ("m", "bare", "d1", "day", "2026-08-22", "23 August 2026", 2.5), ("m", "bare", "d1", "other", "x", "x", 2.5), ("m", "bare", "d2", "emd", "5", None, 1.0)]
    results = spark.createDataFrame(rows, "model string, prompt string, document string, field string, expected string, actual string, seconds double")
    got = sorted(tuple(r) for r in E.extraction_report(results, ["emd", "day"]).collect())
    assert got == [("m", "bare", "d1", "1/2", 1, "OK", "WRONG", 2.5), ("m", "bare", "d2", "0/1", 0, "--", None, 1.0)]
    truth = spark.createDataFrame([("d1", "emd", "31,500|x", 5), ("d1", "day", "2026-08-22", 4), ("d1", "name", "Mines|School", 1), ("d2", "emd", "5", 1)], "document string, field string, value string, page int")
    selected = spark.createDataFrame([("d1", 4, "nothing"), ("d1", 7, "Rs. 31,500 of the school")], "document string, page int, text string")
    assert {(r.document, r.field): r.present for r in E.truth_in_selection(truth, selected).collect()} == {("d1", "emd"): True, ("d1", "day"): True, ("d1", "name"): False, ("d2", "emd"): False}


def test_nearest_enclosures_by_tiles(spark):
    """A group with most enclosures, among them many copies: tiles, no row for each pair, and the first of the copies."""
    from bidloom.operators import requirements as R

    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:400] = x[100]
    x[500:520] = np.float32(0.5)
    vectors = [(str(i), v.tolist()) for i, v in enumerate(x)] + [("none", None)]
    group = ["few" if i % 9 == 0 else "hot" for i in range(900)]
    asked = [(group[i], 10_000 + i, str(i)) for i in range(0, 900, 5)] + [("hot", 1, "none"), ("hot", 2, "unknown"), ("empty", 3, "7")]
    offered = [(g, str(i), i) for i, g in enumerate(group)] + [("hot", "none", 5000)]
    frame = lambda rows, names: spark.createDataFrame(rows, names).repartition(3)
    found = R.match_by_embedding(frame(asked, "g string, key long, label string"), frame(offered, "g string, name string, pos long"), frame(vectors, "name string, embedding array<float>"), ["g"])
    assert "FlatMapCoGroups" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for g, key, label in asked[:-3]:
        scores = [(sum(float(a) * float(b) for a, b in zip(x[int(label)], x[i], strict=True)), -i) for i in range(900) if group[i] == g and str(i) != label]
        s, i = max(scores)
        want[key] = (g, str(-i), round(s, 4))
    assert {r.key: (r.g, r.name, round(r.score, 4)) for r in found.collect()} == want


def test_questions_leave_in_small_batches():
    """Every question asks every other block: their vectors are handed on some at a time, not all at once."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    q, centres = rng.normal(size=(3000, 8)).astype(np.float32), rng.normal(size=(64, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(q.tolist(), pa.list_(pa.float32())), pa.array([None] * 3000, pa.float64())], ["query_id", "q", "floor"])
    got = list(X._asks(batch, centres, np.full(64, 9.0), np.arange(64), False))
    assert max(b.num_rows for b in got) <= X.TILE and sum(b.num_rows for b in got) == 3000 * 63
    assert [b.num_rows for b in X._asks(batch, centres, np.full(64, 9.0), np.arange(64), True)][0] == X.TILE // 64
    with pytest.raises(ValueError):
        X._matrix(pa.array([[1.0], [1.0, 2.0]]))
