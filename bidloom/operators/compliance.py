"""Gap items, verdicts, eliminations and actions of bids against tenders.

The order of items is data: a block (documents, criteria, format rules) and a place within it.
A fact that is missing is never a failure and never zero: it makes an item not assessable.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.money import format_inr
from ..functions.names import mentions


def unit_is(unit: Column, allowed: list[str]) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(unit, F.lit("")))), r"\.+$", "").isin(*allowed)


def bid_facts(turnover: DataFrame, projects: DataFrame, submissions: DataFrame) -> DataFrame:
    """Each bid with its best yearly turnover (and year), largest project and numbers of projects."""
    key = ["tender_id", "vendor_id"]
    best = turnover.where("amount_inr IS NOT NULL").groupBy(*key).agg(
        F.max("amount_inr").alias("best_turnover"), F.max_by("year", F.struct("amount_inr", -F.col("year"))).alias("best_year")
    )
    work = projects.groupBy(*key).agg(F.max("value_inr").alias("largest_project"), F.count("*").alias("project_count"), F.count("value_inr").alias("valued_projects"))
    return submissions.join(best, key, "left").join(work, key, "left").fillna(0, ["project_count", "valued_projects"])


def numeric_items(criteria: DataFrame, facts: DataFrame) -> DataFrame:
    """Numeric criteria against the facts of every bid of the tender.

    Adds ``status``, ``severity``, ``required_value``, ``found_value`` and ``explanation``.
    """
    pairs = criteria.where("type = 'numeric'").join(facts, "tender_id")
    text, amount, number = F.col("criterion"), F.col("threshold_amount_inr"), F.col("threshold_number")
    fact = (
        F.when(mentions(text, V.TURNOVER_HINTS), F.lit("turnover"))
        .when(mentions(text, V.LIQUIDITY_HINTS), F.lit("liquid assets and credit facilities"))
        .when(mentions(text, V.NET_WORTH_HINTS), F.lit("net worth"))
        .when(mentions(text, V.PROJECT_HINTS), F.lit("project value"))
    )
    by_number = F.when(mentions(text, V.EXPERIENCE_HINTS) & unit_is(F.col("unit"), V.YEAR_UNITS), F.lit("experience")).when(
        mentions(text, V.PROJECT_HINTS) & unit_is(F.col("unit"), V.COUNT_UNITS), F.lit("project count")
    )
    pairs = pairs.withColumn("fact", F.when(amount.isNotNull(), fact).when(number.isNotNull(), by_number))
    held = (
        F.when(F.col("fact") == "turnover", F.col("best_turnover").cast("double"))
        .when(F.col("fact") == "liquid assets and credit facilities", F.col("liquid_assets_inr").cast("double"))
        .when(F.col("fact") == "net worth", F.col("net_worth_inr").cast("double"))
        .when(F.col("fact") == "project value", F.col("largest_project").cast("double"))
        .when(F.col("fact") == "experience", F.col("years_in_business").cast("double"))
        .when(F.col("fact") == "project count", F.col("project_count").cast("double"))
    )
    floor = F.coalesce(amount.cast("double"), number)
    status = (
        F.when(floor.isNull(), "not_assessable")
        .when(F.col("fact").isNull(), "manual_check")
        .when(held.isNull(), "not_assessable")
        .when(held >= floor, "match")
        .otherwise("missing")
    )
    failed = F.when(F.col("is_mandatory"), "disqualifying").otherwise("review")
    shown = lambda v, c: F.when(amount.isNotNull(), format_inr(v)).otherwise(F.regexp_replace(F.round(c, 2).cast("string"), r"\.0$", ""))
    out = pairs.withColumns({"held": held, "floor": floor, "status": status})
    out = out.withColumns(
        {
            "severity": F.when(F.col("status") == "match", "info").when(F.col("status") == "missing", failed).otherwise("review"),
            "required_value": shown(amount, F.col("floor")),
            "found_value": shown(F.col("held"), F.col("held")),
        }
    )
    explanation = (
        F.when(F.col("status") == "match", F.concat(F.lit("Your "), F.col("fact"), F.lit(" of "), F.col("found_value"), F.lit(" meets the requirement of "), F.col("required_value"), F.lit(".")))
        .when(F.col("status") == "missing", F.concat(F.lit("Your "), F.col("fact"), F.lit(" is "), F.col("found_value"), F.lit(", below the required "), F.col("required_value"), F.lit(".")))
        .when(F.col("status") == "manual_check", F.lit("No figure of the bid can be compared with this requirement; check it yourself."))
        .otherwise(F.lit("The figure could not be read; that is not the same as failing it."))
    )
    return out.withColumn("explanation", explanation).withColumn("kind", F.lit("numeric")).withColumn("block", F.lit(1))


def boolean_items(criteria: DataFrame, facts: DataFrame) -> DataFrame:
    """Yes-or-no criteria: a barred bidder fails, everything else is for a person to check."""
    pairs = criteria.where(F.col("type") == "boolean")
    text = F.col("criterion")
    credential = F.col("is_mandatory") & mentions(text, V.CREDENTIAL_HINTS) & ~mentions(text, V.NEGATIVE_HINTS)
    pairs = pairs.where(~credential).join(facts, "tender_id")
    barred = mentions(text, V.BARRED_WORDS)
    out = F.coalesce(F.col("is_blacklisted"), F.lit(False)) & barred
    return pairs.withColumns(
        {
            "status": F.when(out, "missing").otherwise("manual_check"),
            "severity": F.when(out, "disqualifying").otherwise("review"),
            "required_value": F.when(barred, "Not blacklisted or debarred").otherwise("Yes"),
            "found_value": F.when(out, "Flagged as blacklisted").when(barred, "No blacklist flag recorded"),
            "explanation": F.when(out, "The bidder is flagged as blacklisted or debarred, which disqualifies.").otherwise("A person has to check this condition."),
            "kind": F.lit("boolean"),
            "block": F.lit(1),
        }
    )


def document_items(required: DataFrame, matches: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """Document requirements (of ``deduplicate``, with tender and vendor) with their matches.

    Order of the rules: marked absent, found, review candidate, conditional, not verifiable,
    narrative content, missing.
    """
    key = ["tender_id", "vendor_id", "key"]
    rows = required.join(matches, key, "left")
    if absent is None:
        rows = rows.withColumn("declared_absent", F.lit(False))
    else:
        rows = rows.join(absent.select(*key, F.lit(True).alias("declared_absent")), key, "left").fillna(False, ["declared_absent"])
    gone = F.col("declared_absent")
    narrative = F.col("label").rlike(V.NARRATIVE) & ~F.col("label").rlike(V.FORMAL)
    found = F.coalesce(F.col("matched"), F.lit(False)) & ~gone
    status = (
        F.when(found, "match")
        .when(F.col("name").isNotNull() & ~gone, "partial")
        .when(F.col("applicability") != "always", "manual_check")
        .when(~F.col("verifiable") & ~gone, "not_assessable")
        .when(narrative & ~gone, "not_assessable")
        .otherwise("missing")
    )
    rows = rows.withColumn("status", status)
    severity = F.when(F.col("status") == "match", "info").when(F.col("status") == "missing", "disqualifying").otherwise("review")
    return rows.withColumns({"severity": severity, "kind": F.lit("document"), "block": F.lit(0), "required_value": F.col("label"), "found_value": F.when(F.col("status").isin("match", "partial"), F.col("name"))})


def verdicts(items: DataFrame, key: list[str]) -> DataFrame:
    """Counts by status (all five), completion, blockers and the verdict of each bid."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in V.CHECK_STATUS]
    blocked = F.bool_or(F.col("severity") == "disqualifying")
    open_ = F.bool_or(F.col("status").isin("manual_check", "not_assessable"))
    return items.groupBy(*key).agg(
        *counts,
        F.count_if(F.col("is_mandatory")).alias("mandatory"),
        F.count_if(F.col("is_mandatory") & (F.col("status") == "match")).alias("satisfied"),
        F.count_if(F.col("is_mandatory") & F.col("status").isin("manual_check", "not_assessable", "partial")).alias("undetermined"),
        F.count_if(F.col("severity") == "disqualifying").alias("blockers"),
        F.when(F.count("*") == 0, "not_checked").when(blocked, "not_compliant").when(open_, "needs_review").otherwise("compliant").alias("verdict"),
    )


def eliminations(items: DataFrame, key: list[str]) -> DataFrame:
    """Status, ground, reason and first clause of each bid; criteria come before documents."""
    blocker = F.when(
        F.col("severity") == "disqualifying",
        F.struct(
            (F.col("kind") == "document").alias("is_document"),
            F.col("block"),
            F.col("pos"),
            F.coalesce(F.concat(F.lit("Clause "), F.col("clause_ref"), F.lit(": ")), F.lit("Tender requirement: ")).alias("where"),
            F.col("explanation"),
            F.col("clause_ref"),
        ),
    )
    grouped = items.groupBy(*key).agg(F.array_sort(F.collect_list(blocker)).alias("b"))
    first = F.get(F.col("b"), 0)
    return grouped.select(
        *key,
        F.when(F.size("b") > 0, "eliminated").otherwise("pending").alias("status"),
        F.when(F.size("b") > 0, F.when(first["is_document"], "document").otherwise("criteria")).alias("ground"),
        F.when(F.size("b") > 0, F.array_join(F.transform("b", lambda x: F.concat(x["where"], x["explanation"])), "; ")).alias("reason"),
        first["clause_ref"].alias("clause_ref"),
    )


def action_group() -> Column:
    status, kind = F.col("status"), F.col("kind")
    return (
        F.when((status == "not_assessable") & (kind != "document"), "clarify")
        .when(status.isin("not_assessable", "manual_check", "partial"), "verify")
        .when(kind == "document", "upload")
        .otherwise("hard_fail")
    )


def actions(items: DataFrame) -> DataFrame:
    """Items that ask something of the vendor, with group and sort key."""
    out = items.where("status <> 'match'").withColumn("action_group", action_group())
    rank = lambda c, values: F.array_position(F.array(*(F.lit(v) for v in values)), c)
    return out.withColumn("action_rank", F.struct(rank(F.col("severity"), V.SEVERITY).alias("s"), rank(F.col("action_group"), V.ACTION_GROUP).alias("g"), F.col("block"), F.col("pos")))


def score_preview(factors: DataFrame, items: DataFrame, key: list[str]) -> DataFrame:
    """Published factors with the status of the item of the same name (the last one), and weights.

    ``factors(tender_id, factor, weight)``; a factor without a weight is left out, one without an
    item is for manual check.
    """
    last = items.groupBy(*key, F.lower("requirement").alias("name")).agg(F.max_by("status", F.struct("block", "pos")).alias("found"))
    bids = items.select(*key).distinct()
    named = bids.join(factors.where("weight IS NOT NULL"), "tender_id").withColumn("name", F.lower("factor"))
    return named.join(last, [*key, "name"], "left").select(*key, "factor", "weight", F.coalesce("found", F.lit("manual_check")).alias("status"))


# What an open item asks, with the requirement {need}, what was found {found} and the condition {condition}.
ACTION_TEXTS = {
    "upload": "Upload {need}",
    "clarify": "State clearly in your bid: {need}",
    "review": "Review the relevant section of your bid against: {need}",
    "conditional_found": "Only if {condition}: confirm “{found}” satisfies {need}. Otherwise this does not apply to you.",
    "conditional": "Only if {condition}: {need}. Otherwise this does not apply to you.",
    "confirm": "Confirm “{found}” satisfies: {need}",
    "check": "Check yourself: {need}",
}


def worded(kind: str, **parts: Column) -> Column:
    """One of ``ACTION_TEXTS`` with its parts put in; null where a part is."""
    pieces = [(text, name) for text, name, _, _ in Formatter().parse(ACTION_TEXTS[kind])]
    return F.concat(*(c for text, name in pieces for c in ([F.lit(text)] if text else []) + ([parts[name]] if name else [])))


def instruction(requirement: Column) -> Column:
    """A requirement as it reads within a sentence: several words begin with a small letter."""
    text = F.trim(requirement)
    first = F.substring(text, 1, 1)
    return F.when(text.contains(" ") & (first != F.lower(first)), F.concat(F.lower(first), F.substring(text, F.lit(2), F.length(text)))).otherwise(text)


def action_text() -> Column:
    """What an open item (with ``action_group``, ``kind`` and ``conditional_on``) asks of the vendor, in one line.

    A document that could not be assessed is for its section to be reviewed; a conditional item names its
    condition first, and what was found if anything was; a partly met one names what was found.
    """
    group, need, found, condition = F.col("action_group"), F.col("requirement"), F.nullif("found_value", F.lit("")), F.col("conditional_on")
    inner = instruction(need)
    return (
        F.when(group == "upload", worded("upload", need=F.coalesce(F.nullif("required_value", F.lit("")), need)))
        .when(group == "hard_fail", F.col("explanation"))
        .when(group == "clarify", worded("clarify", need=need))
        .when((F.col("status") == "not_assessable") & (F.col("kind") == "document"), worded("review", need=need))
        .when(condition.isNotNull() & found.isNotNull(), worded("conditional_found", condition=condition, found=found, need=inner))
        .when(condition.isNotNull(), worded("conditional", condition=condition, need=inner))
        .when((F.col("status") == "partial") & found.isNotNull(), worded("confirm", found=found, need=need))
        .otherwise(worded("check", need=need))
    )


def completion_text(satisfied: Column, mandatory: Column) -> Column:
    """The count of met requirements in words: a count, not a score."""
    # Fixed value: the wording.
    return F.concat(satisfied.cast("string"), F.lit(" of "), mandatory.cast("string"), F.lit(" mandatory requirements satisfied"))


# Conditions under which a requirement binds.
CONDITIONS = {
    "joint_venture": "you are bidding as a joint venture or consortium",
    "concession": "you are claiming an MSME, startup or similar concession",
    "conditional": "this clause applies to your bid",
}


def condition_text(applicability: Column) -> Column:
    """The condition of a requirement in words; null where it always binds."""
    return F.coalesce(*(F.when(applicability == k, v) for k, v in CONDITIONS.items()))
