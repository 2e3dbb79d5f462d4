"""Clause numbering as documents print it: line by line, headings with their sub-items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import let
from .questions import squash

# Marks that may stand before a line's number, and units that make a number a quantity.
MARKS = " \t•·*-–—|"
UNITS = [
    "cr", "crs", "crore", "crores", "lakh", "lakhs", "lac", "lacs", "%", "percent", "per cent", "no", "nos", "kg", "km", "mtr", "metre", "metres", "m", "sqm", "sq.m",
    "day", "days", "month", "months", "year", "years", "hr", "hrs", "hour", "hours", "rs", "inr", "usd",
]
LEADING_ITEM = rf"(?i)^[{MARKS.replace('-', '')}-]*\(?([ivxlc]+|[a-z]|\d{{1,2}})\)(?:[\s.:]|$)"
# A reference is printed in steps: numbers first, then letters or roman numerals after a stop, then brackets.
_STEP = r"(?i)\G(\.?\d+|\.(?:[ivxlc]+|[a-z])(?![a-z])|\s*\.?\s*\([a-z0-9]+\))"
_ONE_WORD = [u for u in UNITS if u.isalpha() or u == "%"]
_TWO_WORDS = [u.replace(".", "").replace(" ", "") for u in UNITS if not (u.isalpha() or u == "%")]


def _kind(step: Column) -> Column:
    return F.when(step.contains("("), 2).when(step.rlike("[A-Za-z]"), 1).otherwise(0)


def led(line: Column) -> Column:
    """``struct(steps, tail)`` of the numbering a line leads with: its steps, as far as they go from numbers to brackets, and what follows."""
    body = F.ltrim(line, F.lit(MARKS))

    def cut(steps: Column) -> Column:
        turns = F.array_position(F.transform(steps, lambda s, i: F.when(i > 0, _kind(s) < _kind(F.get(steps, i - 1))).otherwise(False)), True).cast("int")
        return F.when(turns == 0, steps).otherwise(F.slice(steps, F.lit(1), F.greatest(turns - 1, F.lit(0))))

    steps = F.when(body.rlike("^[1-9]"), let(F.regexp_extract_all(body, F.lit(_STEP), 1), cut)).otherwise(F.array().cast("array<string>"))
    return let(steps, lambda s: F.struct(s.alias("steps"), F.substring(body, F.length(F.array_join(s, "")) + 1, F.length(body)).alias("tail")))


def _of_unit(tail: Column) -> Column:
    """Whether what follows a number begins with a unit, in one word or two."""
    low = F.lower(tail)
    pair = F.regexp_replace(F.regexp_extract(low, r"^\s*([a-z]++[.\s]*[a-z]++)(?![0-9_])", 1), r"[.\s]", "")
    return F.regexp_extract(low, r"^\s*([a-z]++|%)(?![0-9_])", 1).isin(*_ONE_WORD) | pair.isin(*_TWO_WORDS)


def _says(tail: Column) -> Column:
    """Whether words follow: three letters in a row."""
    return tail.rlike("[A-Za-z]{3}")


def line_reference(line: Column) -> Column:
    """The clause reference that leads a line, or null where the line is no clause.

    A number that begins with zero is a ratio, one before a unit a quantity, one before other numbers a cell.
    A whole number with nothing after it is a page or a row; a number of several steps may stand alone.
    """

    def judged(found: Column) -> Column:
        alone = ~found["tail"].rlike(r"[\p{L}\p{N}]")
        clause = F.when(alone, F.size(found["steps"]) > 1).otherwise(_says(found["tail"]))
        return F.when((F.size(found["steps"]) > 0) & ~_of_unit(found["tail"]) & clause, squash(F.array_join(found["steps"], "")))

    return let(led(line), judged)


def line_heading(line: Column) -> Column:
    """The reference of a line that opens a section: one with words of its own."""
    return F.when(_says(led(line)["tail"]), line_reference(line))


def line_item(line: Column) -> Column:
    """The sub-item that a line opens, such as ``(4)``, ``vi)`` or ``(a)``, or null."""
    return F.nullif(F.lower(F.regexp_extract(line, LEADING_ITEM, 1)), F.lit(""))


def structural_references(text: Column) -> Column:
    """Distinct references that lead a line of the text."""
    return F.array_distinct(F.array_compact(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\n|\r"), line_reference)))


def section_of(reference: Column) -> Column:
    """``struct(section, item)`` of a composed reference such as ``1.1 (4)``; item null for a plain one."""
    composed = r"^([\d.]+?)\(?([ivxlc]+|[a-z]|\d{1,2})\)$"
    whole = squash(reference)
    item = F.nullif(F.regexp_extract(whole, composed, 2), F.lit(""))
    return F.struct(F.when(item.isNotNull(), F.rtrim(F.regexp_extract(whole, composed, 1), F.lit("."))).otherwise(whole).alias("section"), item.alias("item"))


# The forms of a chunk's leading clause number.
CHUNK_CLAUSE = r"^\s*((?:\d+\.)+\d*|[A-Z]\.|\(?[ivxlIVXL]+\))\s+"


def chunk_clause(text: Column) -> Column:
    """The clause number a chunk begins with, without a final stop; null without one."""
    return F.nullif(F.rtrim(F.regexp_extract(text, CHUNK_CLAUSE, 1), F.lit(".")), F.lit(""))


# A reference in an answer key, and how a list of them begins.
KEY_REFERENCE = r"\d+(?:\.\d+)*(?:\([a-z0-9]+\))*"
LISTS = ["nit clause ", "nit clauses ", "clause ", "clauses "]


def _tokens(text: Column) -> Column:
    """Words and single signs, lower case; blanks only part them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"), 0)


def _holds(printed: Column, wanted: Column) -> Column:
    """Whether the tokens ``wanted`` stand in ``printed`` as a whole reference: no stop before them, no stop or bracket after."""
    n = F.size(wanted)
    starts = F.when(F.size(printed) >= n, F.sequence(F.lit(0), F.size(printed) - n)).otherwise(F.array().cast("array<int>"))
    before, after = (lambda i: F.coalesce(F.get(printed, i - 1), F.lit(""))), (lambda i: F.coalesce(F.get(printed, i + n), F.lit("")))
    return F.exists(starts, lambda i: (F.slice(printed, i + 1, n) == wanted) & (before(i) != ".") & ~after(i).isin(".", "("))


def clause_matches(expected: Column, actual: Column) -> Column:
    """Whether one of the ``actual`` references prints the ``expected`` one; null where none is expected.

    References are compared token by token, so blanks within one do not count and a heading may follow;
    a longer reference is another one. A list ("clauses 4.1, 4.2 and 5") asks for each of its members.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(expected, F.lit(""))), r"\s+", " "))
    begins = F.coalesce(*(F.when(plain.startswith(w), F.lit(len(w))) for w in LISTS), F.lit(0))
    listed = F.split(F.substring(plain, begins + 1, F.length(plain)), r" ?, ?and | ?, ?| and ")
    tight = F.transform(listed, lambda m: F.regexp_replace(m, r" ?([.()]) ?", "$1"))
    members = F.when((begins > 0) & F.forall(tight, lambda m: m.rlike(f"^{KEY_REFERENCE}$")), listed).otherwise(F.array(plain))
    printed = F.transform(actual, _tokens)
    return F.when(~plain.isin("", "-", "—"), let(printed, lambda p: F.forall(members, lambda m: F.exists(p, lambda a: _holds(a, _tokens(m))))))
