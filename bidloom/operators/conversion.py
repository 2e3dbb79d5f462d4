"""Raw records, all text, to typed notices and bids. What cannot be read stays null; nothing is guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_inr, parse_date, threshold, year_of


def _stated(value: Column, otherwise: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(value, F.lit("")), otherwise))


def typed_notices(headers: DataFrame) -> DataFrame:
    """``headers(source_name, tender_id, title, issuing_authority, submission_deadline, pre_bid_query_deadline,
    emd_raw, estimate_raw)`` with dates and rupees; a notice without an identifier or a title has its source's name."""
    return headers.select(
        "source_name",
        _stated(F.col("tender_id"), F.col("source_name")).alias("tender_id"),
        _stated(F.col("title"), F.col("source_name")).alias("title"),
        "issuing_authority",
        parse_date(F.col("submission_deadline")).alias("submission_deadline"),
        parse_date(F.col("pre_bid_query_deadline")).alias("pre_bid_query_deadline"),
        money_inr(F.col("emd_raw")).alias("emd_inr"),
        money_inr(F.col("estimate_raw")).alias("estimate_inr"),
    )


def typed_criteria(criteria: DataFrame, notices: DataFrame) -> DataFrame:
    """``criteria(tender_id, pos, criterion, type, threshold_raw, unit, is_mandatory, clause_ref)`` with
    ``threshold_inr`` or ``threshold_number``; shares are taken of the typed notice's estimate."""
    known = criteria.join(notices.select("tender_id", "estimate_inr"), "tender_id", "left")
    numeric = F.col("type") == "numeric"
    t = threshold(F.col("threshold_raw"), F.col("unit"), F.col("estimate_inr"))
    return known.withColumn("t", t).select(*criteria.columns, F.when(numeric, F.col("t.amount")).alias("threshold_inr"), F.when(numeric, F.col("t.number")).alias("threshold_number"))


def typed_turnover(raw: DataFrame, key: list[str]) -> DataFrame:
    """``raw(*key, year, amount_raw)`` to one figure per year: ``(*key, year, amount_inr, conflicting)``.

    One year is one fact, however often it is printed; figures that differ are a conflict without an
    amount, and a row without a year is left out.
    """
    read = raw.select(*key, year_of(F.col("year")).alias("year"), money_inr(F.col("amount_raw")).alias("amount")).where("year IS NOT NULL")
    differ = (F.count_distinct("amount") + F.max(F.col("amount").isNull().cast("int"))) > 1
    return read.groupBy(*key, "year").agg(F.when(~differ, F.max("amount")).alias("amount_inr"), differ.alias("conflicting"))
