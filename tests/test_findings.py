"""Clauses, action lines, findings, stamps, chunks of documents and answers, on cases written out."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bidloom.functions import clauses as L
from bidloom.operators import amendments as A
from bidloom.operators import compliance as C
from bidloom.operators import evidence as E
from bidloom.operators import pages as P
from bidloom.operators import statistics as T
from bidloom.operators import validation as Y

LINES = {
    "28.1 The manager will evaluate": "28.1", "  • 4.2 Scope": "4.2", "11.I.(a) Experience": "11.i.(a)", "11.II(a) Experience": "11.ii(a)", "1.1 (4) The contractor": "1.1(4)", "28.1(vi)": "28.1(vi)", "3.2.": "3.2", "12": None, "12 of 40": None,
    "0.973 is the factor": None, "49.855 Crores in total": None, "7 days after the award": None, "15 per cent of value": None, "20 sq. m of floor": None, "5km of road works": None, "5 kmh of road works": "5", "2 | 3 | 4": None, "9 (a) Payment terms": "9(a)",
    "prose 28.1 in the middle": None, "4 Months": None, "4 Monthly statements": "4", "6.a.b.3 Terms apply": "6.a.b", "7.12a of terms": "7.12", "8 - 9 - 10": None, "8.1 ***": "8.1", "": None, "3.IX Terms of payment": "3.ix", "3.IXth Terms": "3",
}


def test_line_references(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string").select("line", L.line_reference(F.col("line")).alias("r"))
    assert {r.line: r.r for r in df.collect()} == LINES


def plain_reference(line):
    """The rule with one expression over the whole line."""
    m = re.match(r"(?i)^[\s•·*\-–—|]*([1-9]\d*(?:\.\d+)*(?:\.(?:[ivxlc]+|[a-z])(?![a-z]))*(?:\s*\.?\s*\([a-z0-9]+\))*)(.*)$", line)
    if not m:
        return None
    ref, tail = m.groups()
    units = "|".join(re.escape(u).replace(r"\.", r"\.?\s*").replace(r"\ ", r"\s*") for u in sorted(L.UNITS, key=len, reverse=True))
    if re.match(rf"(?i)^\s*(?:%(?![0-9_])|(?:{units})(?![a-z0-9_]))", tail):
        return None
    if not re.search(r"[^\W_]", tail):
        return re.sub(r"\s", "", ref.lower()) if "." in ref or "(" in ref else None
    return re.sub(r"\s", "", ref.lower()) if re.search("[A-Za-z]{3}", tail) else None


def test_line_references_against_one_expression(spark):
    rng = random.Random(3)
    pieces = ["1", "0", "28", ".", ".1", " ", "(a)", "(", ")", "iv", ".ii", "b", "cr", "days", "the bid", "%", "sq.m", " per cent", "-", "•", "Rs.", "|", "x1"]
    lines = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))) for _ in range(1500)]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", L.line_reference(F.col("line")).alias("r")).collect()
    assert {r.line: r.r for r in got} == {x: plain_reference(x) for x in lines}


def test_clause_matches(spark):
    cases = [
        ("1.1(4)", ["1.1 (4)"], True), ("1.1", ["1.1(4)"], False), ("1.1(4)", ["1.1(4)(a)"], False), ("7", ["7 Manufacturer authorization"], True), ("2.8", ["12.8", "See 2 . 8 below"], True), ("2.8", ["2.81"], False), ("—", ["1"], None), ("", [], None),
        ("clauses 4.1, 4.2 and 5", ["4.1", "5", "4.2"], True), ("clauses 4.1, 4.2 and 5", ["4.1", "5"], False), ("NIT clause 4.1", ["as 4.1 says"], True), ("clause on payment", ["the Clause on  payment"], True), ("clause on payment", ["payment"], False), ("5", [], False),
    ]
    df = spark.createDataFrame([(i, e, a) for i, (e, a, _) in enumerate(cases)], "i int, e string, a array<string>")
    got = {r.i: r.ok for r in df.select("i", L.clause_matches(F.col("e"), F.col("a")).alias("ok")).collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(cases)}


def test_action_lines(spark):
    rows = [
        ("upload", "document", "missing", "Submit PAN", "PAN card", None, None, "Upload PAN card"), ("upload", "document", "missing", "Submit PAN", "", None, None, "Upload Submit PAN"), ("hard_fail", "numeric", "missing", "Turnover", "1", None, None, "why"),
        ("clarify", "numeric", "not_assessable", "Turnover", None, None, None, "State clearly in your bid: Turnover"), ("verify", "document", "not_assessable", "Submit PAN", None, "x", "c", "Review the relevant section of your bid against: Submit PAN"),
        ("verify", "document", "partial", "Submit the JV deed", None, "JV deed", "you bid jointly", "Only if you bid jointly: confirm “JV deed” satisfies submit the JV deed. Otherwise this does not apply to you."),
        ("verify", "document", "manual_check", "Submit the JV deed", None, "", "you bid jointly", "Only if you bid jointly: submit the JV deed. Otherwise this does not apply to you."), ("verify", "document", "manual_check", "JV", None, None, "c", "Only if c: JV. Otherwise this does not apply to you."),
        ("verify", "document", "partial", "Submit PAN", None, "pan", None, "Confirm “pan” satisfies: Submit PAN"), ("verify", "boolean", "partial", "Submit PAN", None, "", None, "Check yourself: Submit PAN"), ("verify", "boolean", "manual_check", "x", None, "found", None, "Check yourself: x"),
    ]
    df = spark.createDataFrame([(i, *r[:3], *r[3:7], "why") for i, r in enumerate(rows)], "i int, action_group string, kind string, status string, requirement string, required_value string, found_value string, conditional_on string, explanation string")
    assert {r.i: r.a for r in df.select("i", C.action_text().alias("a")).collect()} == {i: r[7] for i, r in enumerate(rows)}


def test_evidence_and_emptiness(spark):
    facts = spark.createDataFrame([(1, "criterion", 1, 5, "q"), (1, "criterion", 2, 0, "q"), (1, "document", 1, 9, " "), (1, "document", 2, None, None), (1, "document", 3, None, "q"), (2, "criterion", 1, 99, "q"), (3, "criterion", 1, 99, "q")], "tender_id int, part string, pos int, source_page int, snippet string")
    documents = spark.createDataFrame([(1, 8), (2, 0)], "tender_id int, page_count int")
    got = sorted(tuple(r) for r in Y.evidence_findings(facts, documents).collect())
    assert got == [
        (1, "criterion 2", "error", "cites a page that is not there"), (1, "document 1", "error", "cites a page that is not there"), (1, "document 1", "warning", "no quote"), (1, "document 2", "warning", "no page and no quote"), (1, "document 3", "warning", "no page"),
    ]
    notices = spark.createDataFrame([(1,), (2,), (9,)], "tender_id int")
    assert sorted((r.tender_id, r.field) for r in Y.empty_findings(notices, facts).collect()) == [(2, "documents"), (9, "criterions"), (9, "documents")]
    lines = spark.createDataFrame([(1, 0, "28.1 Scope of work"), (1, 1, "12.2 Other terms")], "doc_id int, line_no int, line string")
    cited = spark.createDataFrame([(1, "28.1"), (1, "2.81"), (1, "5"), (2, "5")], "doc_id int, clause_ref string")
    assert sorted((r.field, r.message) for r in Y.citation_findings(cited, lines).collect()) == [("clause 2.81", "not printed; 28.1 is"), ("clause 5", "not printed")]


def test_warnings_of_a_corrigendum_with_most_changes(spark):
    corrigenda = spark.createDataFrame([(1, None, "2025-01-01"), (2, "2025-01-01", None), (3, "2025-01-01", "2025-01-01")], "corrigendum_id int, issued_date string, submission_deadline string")
    outcomes = spark.range(3000).select(F.lit(1).alias("corrigendum_id"), F.col("id").alias("change_id"), F.lit("emd_amount").alias("field_path"), F.when(F.col("id") % 2 == 0, "applied").otherwise("conflict").alias("outcome"))
    got = A.warnings(corrigenda, outcomes.union(outcomes.limit(1).withColumn("corrigendum_id", F.lit(8)).withColumn("outcome", F.lit("conflict")))).collect()
    one = sorted((r.place, r.warning) for r in got if r.corrigendum_id == 1)
    assert [p for p, _ in one] == list(range(1, 1502)) and one[0][1].startswith("no issued date") and one[1][1] == "emd_amount: conflict"
    assert [(r.place, r.warning[:13]) for r in got if r.corrigendum_id == 2] == [(1, "no submission")] and {r.corrigendum_id for r in got} == {1, 2}


def test_labels_and_stamps(spark):
    paths = ["emd_amount", "unmapped:site visit", "unmapped", "eligibility_criteria.turnover", "a_b"]
    got = [r.x for r in spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").orderBy("i").select(A.field_label(F.col("p")).alias("x")).collect()]
    assert got == ["EMD amount", "site visit", "an unidentified term", "eligibility criteria — turnover", "a b"]
    changes = spark.createDataFrame([(1, 2, "emd_amount"), (1, 1, "unmapped:x"), (1, 3, "emd_amount"), (2, 1, None)], "corrigendum_id int, change_id int, field_path string")
    assert {r.corrigendum_id: r.labels for r in A.changed_labels(changes).collect()}[1] == ["x", "EMD amount"]
    views = spark.createDataFrame([(1, 5, "generated"), (1, 9, "generated"), (1, 20, "read"), (2, 3, "generated"), (2, 7, "rechecked"), (2, 6, "rechecked"), (3, 1, "read"), (4, 2, "rechecked")], "bid_id int, at int, kind string")
    assert {r.bid_id: r.last_report_at for r in A.report_stamps(views).collect()} == {1: 5, 2: 7, 4: 2}
    assert spark.range(1).select(A.rendered(F.lit("2025-03-05").cast("date")).alias("d")).first().d == "2025-03-05"


def test_no_bid_meets_a_corrigendum(spark):
    """A tender with most bids and corrigenda: what is newer is counted in passing, never as pairs."""
    bids = [("hot", v, v % 40) for v in range(300)] + [("hot", 7, 39), ("cold", 1, 3), ("cold", 2, None), (None, 3, 1), ("alone", 4, 1)]
    came = [("hot", c, (c * 7) % 50) for c in range(400)] + [("cold", 900, 3), ("cold", 902, 4), ("cold", 901, 4), ("cold", 903, None), (None, 904, 9), ("other", 905, 9)]
    found = A.stale(spark.createDataFrame(bids, "tender_id string, vendor_id int, last_report_at int").repartition(3), spark.createDataFrame(came, "tender_id string, corrigendum_id int, created_at int").repartition(3))
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert all("_range" in line for line in joins)
    want = {}
    for t, v, seen in bids:
        for u, c, at in came:
            if None not in (t, seen, at) and t == u and at > seen:
                n, best = want.get((t, v), (0, (-1, -1)))
                want[t, v] = n + 1, max(best, (at, c))
    assert {(r.tender_id, r.vendor_id): (r.newer, r.newest) for r in found.collect()} == {k: (n, best[1]) for k, (n, best) in want.items()}


def plain_chunks(pages, size, overlap, longest):
    out, index = [], 0
    clause = re.compile(r"^\s*((?:\d+\.)+\d*|[A-Z]\.|\(?[ivxlIVXL]+\))\s+")
    ref = lambda t: m.group(1).rstrip(".") if (m := clause.match(t)) else None
    for number, text, tables in pages:
        for piece in P.split_text(text, size, overlap):
            out.append((number, index, piece, ref(piece)))
            index += 1
        for table in tables or []:
            rows = [r for r in table if any(c and c.strip() for c in r)]
            line = lambda r: " | ".join((c or "").strip().replace("\n", " ") for c in r).strip(" |")
            header = line(rows[0]) if len(rows) >= 3 and len([c for c in rows[0] if c and c.strip()]) >= 2 and not any(ch.isdigit() for c in rows[0] for ch in c or "") else None
            for r in rows[1:] if header else rows:
                if not line(r):
                    continue
                prefix = f"[table on page {number}]"
                whole = f"{prefix} {header}\n{line(r)}" if header else f"{prefix} {line(r)}"
                for piece in [whole] if len(whole) <= longest else [f"{prefix} {x}" for x in P.split_text(line(r), size - len(prefix) - 1, overlap)]:
                    out.append((number, index, piece, ref(line(r))))
                    index += 1
    return out


def test_document_chunks_against_a_plain_version(spark):
    rng = random.Random(4)
    docs = {}
    for d in range(6):
        pages = []
        for n in range(1, rng.randint(1, 4)):
            words = [rng.choice(["4.2", "word", "ends.", "so;", "\n\n", "x" * 90]) for _ in range(rng.choice([0, 5, 60]))]
            tables = [[[rng.choice(["Item", "", None, "17 August", "long " * 40, "A. x", " | "]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(0, 2))]
            pages.append((n, rng.choice([None, " ".join(words)]), rng.choice([None, tables])))
        docs[d] = pages
    rows = [(d, *p) for d, pages in docs.items() for p in pages]
    df = spark.createDataFrame(rows, "doc_id int, page_number int, text string, tables array<array<array<string>>>").repartition(3)
    got = {}
    for r in sorted(P.document_chunks(df, 120, 20, 100).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        got.setdefault(r.doc_id, []).append((r.page_number, r.chunk_index, r.text, r.clause_ref))
    assert got == {d: c for d, pages in docs.items() if (c := plain_chunks(pages, 120, 20, 100))}


def test_ruled_tables_come_first(spark):
    kind = "i int, ruled array<array<array<string>>>, aligned array<array<array<string>>>"
    wide, prose = [["a", "b"], ["c", "d"]], [["x" * 100, "y" * 90], ["z" * 100, "w" * 90]]
    rows = [(1, [wide, [["a"]], [["a", "b"]]], [wide]), (2, [[["a"], ["b"]]], [wide, prose]), (3, None, [prose]), (4, [], None), (5, [[["a", None], [" ", ""], ["b", "c"]]], None)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, kind).select("i", P.page_tables(F.col("ruled"), F.col("aligned")).alias("t")).collect()}
    assert got == {1: [wide], 2: [wide], 3: [], 4: [], 5: [[["a", None], [" ", ""], ["b", "c"]]]}


def test_significance_in_words(spark):
    row = spark.range(1).select(T.sign_test_text(F.lit(6), F.lit(0), F.lit(11)).alias("a"), T.sign_test_text(F.lit(1), F.lit(1), F.lit(0)).alias("b"), T.p_text(F.lit(0.00001), 10_000).alias("c"), T.p_text(F.lit(0.5), 10_000).alias("d"), T.significance(F.lit(0.02), 0.01).alias("e")).first()
    assert tuple(row) == ("6 improved / 0 regressed / 11 tied, p=0.0312, significant at 0.05", "1 improved / 1 regressed, p=1.0000, NOT significant at 0.05", "p<0.0001", "p=0.5000", "NOT significant at 0.01")
    keys = spark.createDataFrame([("a", "n", "f.pdf", "pass", None), ("b", "n", "g.pdf", "eliminate", "criteria")], "vendor_id string, notification_id string, file_name string, intended_status string, intended_ground string")
    assert [tuple(r) for r in T.label_units(keys, "ground").collect()] == [("b", "n", "g.pdf", "")] and T.label_units(keys, "status").count() == 2
    assert sorted(tuple(r) for r in T.committed_labels(keys, "status").collect()) == [("a", "pass"), ("b", "eliminate")] and [tuple(r) for r in T.committed_labels(keys, "ground").collect()] == [("b", "criteria")]


def test_pool_answers_and_citations(spark):
    questions = spark.createDataFrame([(1, "t", "why was Acme rejected"), (2, "t", "describe the approach"), (3, "t", "turnover and approach"), (4, "u", "describe the approach"), (5, "t", "how many")], "question_id int, tender_id string, question string")
    hits = spark.createDataFrame([(q, r, None if r == 2 else f"V{r}", 3, None, f" text {r} " + "x" * 600) for q in (1, 2, 3) for r in range(1, 11)], "question_id int, rank int, vendor_id string, source_page int, clause_ref string, text string")
    facts = spark.createDataFrame([("t", "2 bids")], "tender_id string, answer string")
    got = {r.question_id: (r.route, r.answer) for r in E.pool_answers(questions, hits, facts).collect()}
    assert got[1] == ("audit", "2 bids") and got[5] == ("structured", "2 bids") and got[4] == ("qualitative", E.NO_NARRATIVE)
    assert got[2][1].startswith("V1 records: text 1 x") and " Submission records: text 2" in got[2][1] and "V5" not in got[2][1] and len(got[2][1].split(" records: ")) == 5
    assert got[3][1].startswith("Recorded facts: 2 bids\n\nNarrative evidence: V1 records")
    decisions = spark.createDataFrame([("t", "7", "ACME", "low turnover", 4, "4.1", None), ("t", "8", "Other", "late", 4, None, "q"), ("u", "9", "Acme", "x", 1, None, None), ("t", "10", "acme ltd", "", 1, None, None)], "tender_id string, vendor_id string, vendor_name string, reason string, source_page int, clause_ref string, snippet string")
    cited = E.pool_citations(questions, hits, decisions).collect()
    assert sorted(r.question_id for r in cited) == [1] + [2] * 8 + [3] * 8 and [(r.vendor_id, r.snippet) for r in cited if r.question_id == 1] == [("7", "low turnover")]
    assert max(len(r.snippet) for r in cited) == 500
    shown = E.hit_fields(spark.createDataFrame([(None, None, 0.123456)], "text string, doc_kind string, score double")).first()
    assert tuple(shown) == ("", "unknown", 0.1235)
