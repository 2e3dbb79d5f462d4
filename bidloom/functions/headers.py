"""Header values by their printed labels, and the issuer from a letterhead."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import money_inr, parse_date

# The labels of each field, the most specific first; a looser one would claim lines of another field.
DEADLINE_LABELS = [
    r"last date (?:and time )?for (?:uploading|upload|submission) of (?:e-?)?bids?",
    r"bid submission (?:end )?date(?: ?& ?time)?",
    r"last date (?:and time )?(?:for|of) (?:online )?submission(?! of emd)",
    r"due date (?:and time )?for submission",
    r"closing date (?:and time )?(?:of|for) (?:the )?(?:bid|tender)",
    r"end date (?:and time )?(?:for|of) bid submission",
]
PREBID_LABELS = [
    r"last date (?:and time )?for receipt of (?:queries|clarifications?)",
    r"pre[\s-]?bid (?:meeting|conference|query|queries|clarification)[^:\n]{0,30}date",
    r"last date (?:and time )?for (?:seeking )?clarifications?",
]
EMD_LABELS = [
    r"earnest money(?: deposit)?(?: \(emd\))?",
    r"\bemd\b(?: amount)?",
    r"bid security(?: amount)?",
]
# How dates and rupee amounts are printed; a bare number is no amount.
DATE_VALUE = (
    r"(\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|"
    r"\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{4})"
)
MONEY_VALUE = r"((?:rs\.?|inr|₹)\s*[\d,][\d,\s]*(?:\.\d+)?(?:\s*/-)?|\b\d{1,3}(?:,\d{2})+,\d{3}(?:\.\d+)?\b)"
# Lines that no value is taken from.
NOISE_LINES = [r"\.{4,}", r"page \d+ of \d+", r"as per (?:form|annexure)"]
# Words of a line that names an institution.
ORGANISATIONS = [
    "municipal corporation", "nagar nigam", "municipality", "panchayat", "zilla parishad", "development authority", "improvement trust", "smart city",
    "public works", "jal board", "electricity board", "power distribution", "transmission corporation", "metro rail", "port trust", "airport authority",
    "institute of", "university", "college", "vidyalaya", "hospital", "corporation", "nigam", "limited", r"ltd\.?", "pvt", "board", "department",
    "directorate", "ministry", "commission", "council", "authority", "undertaking", "bhavan", "sansthan", "government of", r"govt\.? of", "office of the",
]
# How lines begin that name something else than the issuer.
NO_ISSUER = [
    "name of (?:the )?work", "sub", "subject", "ref", "tender", "bid", "nit", "e-?tender", "notice", "phone", "tel", "fax", "email", "e-mail", "website",
    "www", "page", "annexure", "form", "section", "clause", "date", "last date", "estimated", "earnest", "contract", "scope", "for and on behalf",
]
# The head of a page, the pages that have a letterhead, and the bounds of its line.
HEAD_LINES, HEAD_PAGES, SHORTEST_NAME, LONGEST_NAME, LETTERS = 8, 2, 8, 120, 0.6

FIELDS: dict[str, tuple[list[str], str]] = {
    "submission_deadline": (DEADLINE_LABELS, DATE_VALUE),
    "pre_bid_query_deadline": (PREBID_LABELS, DATE_VALUE),
    "emd_amount": (EMD_LABELS, MONEY_VALUE),
}


def noisy(line: Column) -> Column:
    return line.rlike("(?i)" + "|".join(NOISE_LINES))


def page_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r")


def labelled(lines: Column, field: str) -> Column:
    """``struct(rank, line_no, value, line)`` of the best labelled value among a page's lines, or null.

    The most specific label wins, then the first line. The value is the first of the line, or else of the next.
    """
    labels, value = FIELDS[field]
    any_label = "(?i)" + "|".join(labels)

    def hit(line: Column, i: Column) -> Column:
        rank = F.lit(len(labels))
        for n, label in reversed(list(enumerate(labels))):
            rank = F.when(line.rlike("(?i)" + label), n).otherwise(rank)
        here = F.regexp_extract(line, "(?i)" + value, 1)
        after = F.regexp_extract(F.coalesce(F.get(lines, i + 1), F.lit("")), "(?i)" + value, 1)
        found = F.trim(F.coalesce(F.nullif(here, F.lit("")), after))
        # The long alternation of all labels is asked once a line; only lines that pass it are ranked.
        return F.when(line.rlike(any_label) & ~noisy(line) & (found != ""), F.struct(rank.alias("rank"), i.alias("line_no"), found.alias("value"), squeezed(line).alias("line")))

    return F.array_min(F.transform(lines, hit))


def squeezed(line: Column, longest: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(line, r"\s+", " ")), 1, longest)


def issuer(lines: Column) -> Column:
    """The first line at the head of a page that names an institution, or null."""
    flat = F.transform(F.slice(lines, 1, HEAD_LINES), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))

    def names_one(line: Column) -> Column:
        letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
        size = F.length(line)
        return (
            size.between(SHORTEST_NAME, LONGEST_NAME) & ~line.rlike(r"(?i)^(?:" + "|".join(NO_ISSUER) + r")\b") & ~noisy(line)
            & line.rlike(r"(?i)\b(?:" + "|".join(ORGANISATIONS) + r")\b") & (letters >= size * LETTERS)
        )

    return F.get(F.filter(flat, names_one), 0)


def holds_value(field: str, value: Column) -> Column:
    """Whether a printed value can be read: a day, or an amount."""
    return (money_inr(value) if field == "emd_amount" else parse_date(value)).isNotNull()
