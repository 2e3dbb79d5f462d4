"""Amounts in Indian notation and dates as printed in tenders, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of an amount and what they multiply by.
UNITS: dict[str, int] = {
    "thousand": 1_000,
    "billion": 1_000_000_000,
    "million": 1_000_000,
    "crores": 10_000_000,
    "crore": 10_000_000,
    "cr": 10_000_000,
    "lakhs": 100_000,
    "lakh": 100_000,
    "lacs": 100_000,
    "lac": 100_000,
    "mn": 1_000_000,
    "bn": 1_000_000_000,
    "k": 1_000,
    "l": 100_000,
}

# Fixed value: currency marks and filler that carry no amount.
NOISE = r"(?i)(?:₹|rs\.?|inr|rupees?|only|/-|\bapprox(?:imately)?\b|\bupto\b|\bup\s+to\b)"
NUMERAL = r"\d+(?:,\s*\d{2,3})*(?:\.\d+)?"
_AFTER = r"\s*(?:%|(?:per\s*cent|percent)\b)|\s*\.*\s*(?:" + "|".join(UNITS) + r")\b"
AMOUNT = rf"(?i)({NUMERAL})({_AFTER})?"


def money_inr(text: Column) -> Column:
    """Rupees named by a text, as decimal(18,2); null where it names none.

    The first numeral with a unit wins, else the first numeral; percentages are no amounts.
    Rounding is half-even.
    """
    clean = F.regexp_replace(text, NOISE, " ")
    factor = F.create_map(*(F.lit(x) for unit, by in UNITS.items() for x in (unit, by)))

    def read(match: Column) -> Column:
        unit = F.lower(F.regexp_replace(F.regexp_extract(match, AMOUNT, 2), r"[\s.]", ""))
        return F.struct(
            F.regexp_replace(F.regexp_extract(match, AMOUNT, 1), r"[,\s]", "").cast("decimal(24,4)").alias("value"),
            unit.alias("unit"),
            F.coalesce(F.try_element_at(factor, unit), F.lit(1)).alias("by"),
        )

    named = F.transform(F.regexp_extract_all(clean, F.lit(AMOUNT), 0), read)
    absolute = F.filter(named, lambda p: ~p["unit"].rlike(r"^(%|percent)"))
    chosen = let(absolute, lambda a: F.coalesce(F.get(F.filter(a, lambda p: p["by"] > 1), 0), F.get(a, 0)))
    return let(chosen, lambda c: F.bround(c["value"] * c["by"].cast("decimal(12,0)"), 2).cast("decimal(18,2)"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _trimmed(value: Column) -> Column:
    """At most three places, without trailing zeros."""
    text = F.bround(value, 3).cast("decimal(24,3)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def format_inr(amount: Column) -> Column:
    """Crores from one crore on, lakhs from one lakh on, rupees below."""
    value = amount.cast("decimal(24,6)")
    return (
        F.when(value >= 10_000_000, F.concat(F.lit("₹"), _trimmed(value / 10_000_000), F.lit(" Cr")))
        .when(value >= 100_000, F.concat(F.lit("₹"), _trimmed(value / 100_000), F.lit(" Lakh")))
        .when(value.isNotNull(), F.concat(F.lit("₹"), _trimmed(value)))
    )


# Fixed value: the date forms, day first, in the order they are tried.
DATE_FORMS = ["yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "d-M-yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy"]


def parse_date(text: Column) -> Column:
    """The date a text states in one of the known forms, else null: never a guess."""
    return F.coalesce(*(F.try_to_date(F.trim(text), f) for f in DATE_FORMS))


def year_of(text: Column) -> Column:
    """The first year 19xx or 20xx in forms such as 2023-24 or FY2023."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(19|20)\d{2}", 0), F.lit("")), F.lit("9999")).cast("int")


def first_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


# What makes a threshold monetary, and what makes it a share of the estimate.
MONETARY = r"(?i)(?:₹|\b(?:inr|rs|rupees?|cr|crores?|lakhs?|lacs?)\b)"
SHARE = r"(?i)(\d+(?:\.\d+)?)\s*(?:%|per\s*cent|percent)"
ESTIMATE = r"(?i)estimated\s+cost|ecpt|estimated\s+value|put\s+to\s+tender|contract\s+value"


def looks_monetary(text: Column, unit: Column) -> Column:
    return F.concat_ws(" ", text, unit).rlike(MONETARY)


def relative_share(text: Column) -> Column:
    """The percentage of a threshold that is stated as a share of the estimated cost."""
    return F.when(text.rlike(SHARE) & text.rlike(ESTIMATE), F.regexp_extract(text, SHARE, 1).try_cast("double"))


def threshold(text: Column, unit: Column, contract_value: Column) -> Column:
    """``struct(amount, number)`` of a numeric criterion's printed threshold.

    A share of the estimate is an amount where the estimate is known; a monetary text is an
    amount; anything else is a plain number. What cannot be read stays null.
    """
    share = relative_share(text)
    by_share = F.bround(contract_value.cast("decimal(24,4)") * share.cast("decimal(12,4)") / 100, 2).cast("decimal(18,2)")
    return F.struct(
        F.when(share.isNotNull(), by_share).when(looks_monetary(text, unit), money_inr(text)).alias("amount"),
        F.when(share.isNull() & ~looks_monetary(text, unit), first_number(text)).alias("number"),
    )
