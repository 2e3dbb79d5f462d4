"""Findings on extracted notices and bids, certificates, citations against the printed numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clauses import line_heading, line_item, line_reference, section_of
from ..functions.questions import digits, squash

# Fixed value: the longest time in business, in years, that is no misread date.
MAX_YEARS = 150


def _findings(rows: DataFrame, key: list[str], rules: list[tuple[Column, str, str, Column]]) -> DataFrame:
    """``(*key, field, severity, message)`` of the rules ``(field, severity, message, holds)`` of each row, from one scan."""
    made = [F.when(F.coalesce(holds, F.lit(False)), F.struct(field.alias("field"), F.lit(severity).alias("severity"), F.lit(message).alias("message"))) for field, severity, message, holds in rules]
    return rows.select(*key, F.explode(F.array_compact(F.array(*made))).alias("f")).select(*key, "f.*")


def notice_findings(notices: DataFrame, criteria: DataFrame, today: Column) -> DataFrame:
    """Findings on ``notices(tender_id, submission_deadline, pre_bid_query_deadline, issuing_authority,
    emd_inr, estimate_inr)`` and the thresholds of ``criteria(tender_id, pos, threshold_inr)``."""
    c = F.col
    empty = lambda name: F.trim(F.coalesce(c(name).cast("string"), F.lit(""))) == ""
    rules = [(F.lit(name), "warning", "missing", empty(name)) for name in ("submission_deadline", "issuing_authority", "emd_inr")]
    rules += [
        (F.lit("submission_deadline"), "warning", "has passed", c("submission_deadline") < today),
        (F.lit("pre_bid_query_deadline"), "error", "after the bids are due", c("pre_bid_query_deadline") > c("submission_deadline")),
        (F.lit("emd_inr"), "error", "not an amount", c("emd_inr") <= 0),
        (F.lit("estimate_inr"), "error", "not an amount", c("estimate_inr") <= 0),
        (F.lit("emd_inr"), "error", "above the estimate", c("emd_inr") > c("estimate_inr")),
    ]
    named = F.concat(F.lit("criterion "), c("pos").cast("string"))
    return _findings(notices, ["tender_id"], rules).unionByName(_findings(criteria, ["tender_id"], [(named, "error", "not an amount", c("threshold_inr") <= 0)]))


def evidence_findings(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Findings on what the ``facts(tender_id, part, pos, source_page, snippet)`` of notices rest on.

    ``documents(tender_id, page_count)``: a cited page has to exist, and a fact without page or quote cannot be
    checked. A document of no known pages says nothing about pages.
    """
    c = F.col
    field = F.concat_ws(" ", "part", c("pos").cast("string"))
    page, quote = c("source_page").isNull(), F.trim(F.coalesce("snippet", F.lit(""))) == ""
    rules = [
        (field, "error", "cites a page that is not there", (c("page_count") > 0) & ((c("source_page") < 1) | (c("source_page") > c("page_count")))),
        (field, "warning", "no page and no quote", page & quote),
        (field, "warning", "no page", page & ~quote),
        (field, "warning", "no quote", ~page & quote),
    ]
    return _findings(facts.join(documents, "tender_id", "left"), ["tender_id"], rules)


# The parts of a notice that may not be empty.
PARTS = ["criterion", "document"]


def empty_findings(notices: DataFrame, facts: DataFrame) -> DataFrame:
    """A warning for every notice of ``notices(tender_id)`` and part of which ``facts(tender_id, part, ...)`` has nothing.

    Without criteria a bid would pass with no threshold tested.
    """
    there = facts.groupBy("tender_id").agg(F.collect_set("part").alias("parts"))  # as many as there are parts
    known = F.coalesce("parts", F.array().cast("array<string>"))
    missing = F.filter(F.array(*(F.lit(p) for p in PARTS)), lambda p: ~F.array_contains(known, p))
    lacking = notices.select("tender_id").join(there, "tender_id", "left").select("tender_id", F.explode(missing).alias("part"))
    return lacking.select("tender_id", F.concat("part", F.lit("s")).alias("field"), F.lit("warning").alias("severity"), F.lit("none read").alias("message"))


def citation_findings(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """A warning for each of ``citations(doc_id, clause_ref)`` that its document's numbering does not print, with the one it may mean."""
    open_ = unverifiable(citations, lines)
    meant = F.concat(F.lit("not printed; "), F.col("suggestion"), F.lit(" is"))
    return open_.select(F.col("doc_id").alias("tender_id"), F.concat(F.lit("clause "), "clause_ref").alias("field"), F.lit("warning").alias("severity"), F.coalesce(meant, F.lit("not printed")).alias("message"))


def bid_findings(bids: DataFrame, turnover: DataFrame, enclosures: DataFrame) -> DataFrame:
    """Findings on ``bids(bid_id, quoted_inr, liquid_inr, years_in_business)``, their ``turnover(bid_id,
    year, amount_inr)`` and ``enclosures(bid_id, name)``.

    Net worth may be negative; a price, liquid assets and a turnover may not be nothing.
    """
    c = F.col
    counted = bids.join(turnover.groupBy("bid_id").agg(F.count("*").alias("figures")), "bid_id", "left").join(enclosures.groupBy("bid_id").agg(F.count("*").alias("names")), "bid_id", "left")
    rules = [
        (F.lit("quoted_inr"), "error", "not an amount", c("quoted_inr") <= 0),
        (F.lit("liquid_inr"), "error", "not an amount", c("liquid_inr") <= 0),
        (F.lit("years_in_business"), "error", "not plausible", (c("years_in_business") < 0) | (c("years_in_business") > MAX_YEARS)),
        (F.lit("turnover"), "warning", "missing", c("figures").isNull()),
        (F.lit("enclosures"), "warning", "missing", c("names").isNull()),
    ]
    named = F.concat(F.lit("turnover "), F.coalesce(c("year").cast("string"), F.lit("?")))
    return _findings(counted, ["bid_id"], rules).unionByName(_findings(turnover, ["bid_id"], [(named, "error", "not an amount", c("amount_inr") <= 0)]))


def certificate_valid(present: Column, valid_till: Column, when: Column) -> Column:
    """Whether a certificate is enclosed and in force on a day; null where its end is not known."""
    return F.when(~F.coalesce(present, F.lit(False)), F.lit(False)).when(valid_till.isNotNull(), valid_till >= when)


def latest_turnover(turnover: DataFrame, key: list[str]) -> DataFrame:
    """The figure of the last year whose amount is known: ``(*key, year, amount_inr)``; the larger one of two of a year."""
    known = turnover.where("amount_inr IS NOT NULL")
    return known.groupBy(*key).agg(F.max(F.struct("year", "amount_inr")).alias("t")).select(*key, "t.*")


def format_items(rules: DataFrame) -> DataFrame:
    """Format rules of a notice as items of every bid's check: always for a person, after documents and criteria.

    ``rules(tender_id, pos, rule, clause_ref)``.
    """
    return rules.select(
        "tender_id", "pos", F.col("rule").alias("requirement"), F.lit("format_rule").alias("kind"), F.lit("manual_check").alias("status"), F.lit("review").alias("severity"),
        F.lit(2).alias("block"), F.lit(False).alias("is_mandatory"), "clause_ref", F.lit("What a page looks like cannot be read from its text; check this yourself.").alias("explanation"),
    )


def numbering(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The printed numbering of ``lines(doc_id, line_no, line)``: ``(doc_id, reference)`` and ``(doc_id, section, item)``.

    A sub-item belongs to the last heading above it. A heading counts from its line to the next one:
    the lines of a document meet in a window only as far as they lead with a number. That is bounded by the
    numbered lines of one document, not of a table.
    """
    from .pages import section_scope

    read = lines.select("doc_id", "line_no", line_reference(F.col("line")).alias("reference"), line_heading(F.col("line")).alias("section"), line_item(F.col("line")).alias("item"))
    led = read.where("reference IS NOT NULL OR item IS NOT NULL")
    items = section_scope(led, F.col("section")).where("section IS NULL AND item IS NOT NULL AND heading IS NOT NULL")
    return led.where("reference IS NOT NULL").select("doc_id", "reference").distinct(), items.select("doc_id", F.col("heading").alias("section"), "item").distinct()


def unverifiable(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """Citations that a document prints neither as they are nor as a heading with that sub-item under it.

    ``citations(doc_id, clause_ref)`` to ``(doc_id, clause_ref, suggestion)``: the one printed reference with
    the same digits, if there is one. A document without readable numbering proves nothing against a citation.
    """
    references, items = numbering(lines)
    asked = citations.where("trim(coalesce(clause_ref, '')) <> ''").distinct()
    asked = asked.withColumns({"needle": squash(F.col("clause_ref")), "spine": digits(F.col("clause_ref")), "parts": section_of(F.col("clause_ref"))})
    numbered = references.groupBy("doc_id").agg(F.count("*").alias("printed"))
    met = asked.join(references, "doc_id").groupBy("doc_id", "clause_ref").agg(
        F.bool_or(F.startswith("reference", "needle")).alias("verbatim"),
        F.count_if((digits(F.col("reference")) == F.col("spine")) & (F.col("reference") != F.col("needle")) & (F.col("spine") != "")).alias("alike"),
        F.min(F.when((digits(F.col("reference")) == F.col("spine")) & (F.col("reference") != F.col("needle")), F.col("reference"))).alias("near"),
    )
    composed = asked.where("parts.item IS NOT NULL").join(items, "doc_id").where((F.col("item") == F.col("parts.item")) & F.startswith("section", "parts.section"))
    open_ = met.join(numbered, "doc_id").where("NOT verbatim").join(composed.select("doc_id", "clause_ref").distinct(), ["doc_id", "clause_ref"], "left_anti")
    return open_.select("doc_id", "clause_ref", F.when(F.col("alike") == 1, F.col("near")).alias("suggestion"))


def retag(chunks: DataFrame, statuses: DataFrame) -> DataFrame:
    """Chunks with the status that their bid has now; a chunk whose bid is not listed keeps its own.

    ``chunks(chunk_id, bid_id, status, ...)``, ``statuses(bid_id, status)`` with the last row of a bid by ``changed_at``.
    """
    now = statuses.groupBy("bid_id").agg(F.max_by("status", "changed_at").alias("now"))
    return chunks.join(now, "bid_id", "left").withColumn("status", F.coalesce("now", "status")).select(*chunks.columns)


def point_id(owner: Column, index: Column) -> Column:
    """The identifier of a chunk: a version-5 UUID of ``owner:index`` in the URL name space, the same on every run."""
    space = F.lit("6ba7b8119dad11d180b400c04fd430c8")
    h = F.substring(F.sha1(F.concat(F.unhex(space), F.encode(F.concat_ws(":", owner.cast("string"), index.cast("string")), "UTF-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def blocked_stages(stages: DataFrame, needs: DataFrame, available: DataFrame) -> DataFrame:
    """What each stage of an evaluation waits for: ``(stage, blocked, missing)``.

    ``stages(stage)``, ``needs(stage, resource)``, ``available(resource)``.
    """
    lacking = needs.distinct().join(available.select("resource").distinct(), "resource", "left_anti").groupBy("stage").agg(F.array_sort(F.collect_list("resource")).alias("missing"))
    return stages.join(lacking, "stage", "left").select("stage", F.col("missing").isNotNull().alias("blocked"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))
