"""Table-driven cases of the column functions."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bidloom.functions import money as M
from bidloom.functions import names as N
from bidloom.functions import questions as Q


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, rupees",
    [
        ("5,00,00,000", "50000000.00"),
        ("Rs. 5 Cr", "50000000.00"),
        ("500 lakh", "50000000.00"),
        ("2.1cr", "21000000.00"),
        ("At least 2, Rs. 2 Cr each", "20000000.00"),
        ("Rs.3, 00, 00,000/- (Rupees Three Crore only)", "30000000.00"),
        ("EMD @ 1% of the ECV", None),
        ("30 per cent", None),
        ("1% of Rs. 5 lakh", "500000.00"),
        ("no figure", None),
        ("", None),
        (None, None),
        ("0.125", "0.12"),
    ],
)
def test_money(spark, text, rupees):
    assert one(spark, text, M.money_inr) == (Decimal(rupees) if rupees else None)


@pytest.mark.parametrize("amount, shown", [("498550000", "₹49.855 Cr"), ("250000", "₹2.5 Lakh"), ("99999.5", "₹99999.5"), ("10000000", "₹1 Cr"), (None, None)])
def test_format_inr(spark, amount, shown):
    assert one(spark, Decimal(amount) if amount else None, M.format_inr, "decimal(18,2)") == shown


@pytest.mark.parametrize(
    "text, day", [("2024-09-05", date(2024, 9, 5)), ("5/9/2024", date(2024, 9, 5)), ("05.09.2024", date(2024, 9, 5)), ("5 sep 2024", date(2024, 9, 5)), ("September 5, 2024", date(2024, 9, 5)), ("soon", None), (None, None)]
)
def test_dates(spark, text, day):
    assert one(spark, text, M.parse_date) == day


@pytest.mark.parametrize("text, share", [("30% of the estimated cost", 30.0), ("80% marks", None), ("estimated cost", None), (None, None)])
def test_relative_share(spark, text, share):
    assert one(spark, text, M.relative_share) == share


def test_years_are_not_rupees(spark):
    row = spark.createDataFrame([("5 (five) years", "years")], "t string, u string").select(M.threshold(F.col("t"), F.col("u"), F.lit(None).cast("decimal(18,2)")).alias("x")).first()["x"]
    assert row["amount"] is None and row["number"] == 5.0


@pytest.mark.parametrize(
    "name, normal",
    [("Copies of GST Certificates", "gst certificate"), ("OEM Authorization Form", "oem authorisation form"), ("Labour Licence", "labour license"), ("Status of address", "status address"), ("Crédit!", "crédit"), ("", ""), (None, "")],
)
def test_normalise_name(spark, name, normal):
    assert one(spark, name, N.normalise_name) == normal


@pytest.mark.parametrize("a, b", [("Power of Attorney", "Submission of Power of Attorney"), ("Power of Attorney", "Copy of Power of Attorney duly attested"), ("PAN Card", "Permanent Account Number")])
def test_canonical_keys_meet(spark, a, b):
    assert one(spark, a, N.canonical_key) == one(spark, b, N.canonical_key)


def test_numbered_forms_differ(spark):
    assert one(spark, "Annexure-IV undertaking", N.canonical_key) != one(spark, "Annexure-V undertaking", N.canonical_key)


def test_synonyms_meet(spark):
    vocabulary = lambda c: N.canonical_vocabulary(N.normalise_name(c))
    assert one(spark, "Manufacturers authorization form", vocabulary) == one(spark, "OEM authorisation form", vocabulary)


@pytest.mark.parametrize(
    "question, route",
    [("Why was Vendor A eliminated?", "audit"), ("Compare shortlisted vendors on experience and approach", "hybrid"), ("Rank vendors side by side", "comparative"), ("Describe the methodology", "qualitative"), ("turnover of B", "structured")],
)
def test_router(spark, question, route):
    assert one(spark, question, Q.route) == route


def test_expansion(spark):
    assert one(spark, "What is the EMD?", Q.expand) == "What is the EMD? earnest money deposit earnest money bid security"
    assert one(spark, "expansion plans", Q.expand) == "expansion plans"  # "pan" is not a word here


@pytest.mark.parametrize(
    "answer, kept", [("<think>x</think>Yes.", "Yes."), ("a</think> b", "b"), ("plain", "plain"), ("<think>only</think>", "<think>only</think>")]
)
def test_strip_thinking(spark, answer, kept):
    assert one(spark, answer, Q.strip_thinking) == kept


def test_references(spark):
    printed = Q.references(F.lit("clause 28.1(vi), 1.1 (4) and 28.2"))
    row = spark.range(1).select(Q.present(F.lit("28.1"), printed).alias("a"), Q.suggestion(F.lit("2.82"), printed).alias("b"), Q.suggestion(F.lit("9.9"), printed).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, "28.2", None)


def test_sentences_of_an_answer_are_looked_at_once(spark):
    texts = {
        "Okay. So let me check. It is Rs. 5 Cr. Fine.": "It is Rs. 5 Cr. Fine.", "First, looking at source [1]. So 7 days.": "So 7 days.", "Okay. Well, now.": "Okay. Well, now.",
        "<think>Hmm. 5</think> Let me see! Yes.": "Yes.", "x </THINK> So. Done": "Done", "a </b> c": "a </b> c", "": "", "  ": "", None: None, "<think>all</think>": "<think>all</think>",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", Q.strip_preamble(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == texts
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
