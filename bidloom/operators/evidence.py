"""Where facts come from, how they are shown and how failures are told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import first_number, money_inr, parse_date
from ..functions.names import canonical_form, normalise_name
from ..functions.questions import route


def source_provenance(matched: DataFrame, documents: DataFrame, certificates: DataFrame, group: list[str]) -> DataFrame:
    """The page on which a matched name stands in the bid: documents before certificates, first place first.

    ``matched(*group, key, name)``; both sources ``(*group, name, pos, source_page)``.
    """
    every = documents.select(*group, "name", "pos", "source_page", F.lit(0).alias("part")).unionByName(certificates.select(*group, "name", "pos", "source_page", F.lit(1).alias("part")))
    first = every.groupBy(*group, "name").agg(F.min_by("source_page", F.struct("part", "pos")).alias("source_page"), F.min(F.struct("part", "pos")).alias("at"))
    return matched.join(first, [*group, "name"], "left").select(*group, "key", "name", "source_page", F.col("at.part").alias("part"))


def declared_absent(required: DataFrame, absent: DataFrame, group: list[str]) -> DataFrame:
    """Requirements that a bid itself marks as not enclosed, by normal form or canonical name.

    ``required(*group, key, label)``, ``absent(*group, name)``.
    """
    n = normalise_name
    r = required.select(*group, "key", n(F.col("label")).alias("n")).withColumn("f", F.explode(F.array_compact(F.array(F.col("n"), canonical_form(F.col("n"))))))
    a = absent.select(*group, n(F.col("name")).alias("n")).withColumn("f", F.explode(F.array_compact(F.array(F.col("n"), canonical_form(F.col("n"))))))
    return r.join(a.select(*group, "f").distinct(), [*group, "f"], "left_semi").select(*group, "key").distinct()


def subsequence_rank(word: Column, text: Column) -> Column:
    """How well a typed word fits a label: 100 less a hundredth of its place when it is contained, else
    1 / (gaps + 1) when its letters occur in order, else 0. ``word`` is not empty."""
    low, hay = F.lower(word), F.lower(text)
    at = F.position(low, hay)
    letters = F.split(low, "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gaps"), F.lit(True).alias("ok"))

    def step(s: Column, c: Column) -> Column:
        rest = F.substr(hay, s["at"] + 1)
        place = F.when(s["ok"], F.position(c, rest)).otherwise(0)
        return F.struct(
            (s["at"] + place).cast("int").alias("at"),
            (s["gaps"] + F.when((place > 0) & (s["at"] > 0), place - 1).otherwise(0)).cast("int").alias("gaps"),
            (s["ok"] & (place > 0)).alias("ok"),
        )

    fold = F.aggregate(letters, start, step)
    return F.when(at > 0, 100 - (at - 1) / 100.0).when(fold["ok"], 1.0 / (fold["gaps"] + 1)).otherwise(0.0)


def citation_label(file: Column, page: Column, clause: Column) -> Column:
    """file, page n, clause c; what is unknown is left out."""
    return F.concat_ws(", ", file, F.concat(F.lit("page "), page.cast("string")), F.concat(F.lit("clause "), clause))


def numbered_sources(chunks: DataFrame, key: list[str], order: str) -> DataFrame:
    """The sources of an answer as numbered blocks, in order."""
    rows = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "label", "text"))).alias("s"))
    block = F.transform("s", lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["label"], F.lit("\n"), s["text"]))
    return rows.select(*key, F.array_join(block, "\n\n").alias("sources"))


# Signs of failures that pass, and of a quota that is spent for the day.
TRANSIENT = r"(?i)429|500|502|503|504|timeout|timed out|rate.?limit|overloaded|temporarily|connection (?:reset|refused|aborted)"
DAILY = r"(?i)per.?day|daily|PerDay"


def failure_kind(message: Column) -> Column:
    """quota (for the day), transient or permanent."""
    return F.when(message.rlike(DAILY), "quota").when(message.rlike(TRANSIENT), "transient").otherwise("permanent")


def first_answer(*tiers: Column) -> Column:
    """The first tier that answered, with its number from 1."""
    number = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tiers, 1))):
        number = F.when(t.isNotNull(), i).otherwise(number)
    return F.struct(F.coalesce(*tiers).alias("answer"), number.alias("tier"))


def summary(counts: DataFrame, key: list[str], kind: str, order: list[str]) -> DataFrame:
    """Counts per kind as one line, in the order of the closed set, absent kinds left out."""
    place = F.array_position(F.array(*(F.lit(o) for o in order)), F.col(kind))
    rows = counts.groupBy(*key, kind).agg(F.count("*").alias("n"))
    rows = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(place.alias("at"), F.col(kind).alias("k"), "n"))).alias("s"))
    return rows.select(*key, F.array_join(F.transform("s", lambda s: F.concat(s["n"].cast("string"), F.lit(" "), s["k"])), ", ").alias("summary"))


# ---------------------------------------------------------------- comparison rules


def squash(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]", "")


def compare(rule: Column, truth: Column, found: Column) -> Column:
    """Whether a found value is right under a rule: id_core, tokens, number, date or expected_null."""
    words = F.filter(F.split(F.lower(F.coalesce(truth, F.lit(""))), r"\W+"), lambda w: w != "")
    return (
        F.when(rule == "expected_null", F.coalesce(F.trim(found), F.lit("")) == "")
        .when(rule == "id_core", (squash(truth) != "") & F.contains(squash(found), squash(truth)))
        .when(rule == "tokens", F.forall(words, lambda w: F.contains(F.lower(F.coalesce(found, F.lit(""))), w)))
        .when(rule == "number", F.coalesce(first_number(truth) == first_number(found), F.lit(False)))
        .when(rule == "date", F.coalesce(parse_date(truth) == parse_date(found), F.lit(False)))
    )


def benchmark_match(expected: Column, actual: Column) -> Column:
    """Whether a value carries what is expected of it.

    A figure is compared in rupees, an ISO date as a day, and of names divided by ``|`` one has to be
    contained. Words for nothing are no value.
    """
    text = F.trim(F.coalesce(actual, F.lit("")))
    nothing = F.lower(text).isin("", "none", "null", "n/a", "not stated")
    named = F.exists(F.split(expected, r"\|"), lambda p: F.contains(F.lower(text), F.lower(p)))
    right = F.when(expected.rlike(r"^[\d,]+$"), money_inr(text) == money_inr(expected)).when(expected.rlike(r"^\d{4}-\d{2}-\d{2}$"), parse_date(text) == expected.try_cast("date")).otherwise(named)
    return ~nothing & F.coalesce(right, F.lit(False))


def extraction_report(results: DataFrame, fields: list[str]) -> DataFrame:
    """A row per model, prompt and document with a cell per field: OK, WRONG, or -- where nothing came back.

    ``results(model, prompt, document, field, expected, actual, seconds)`` has a row per field asked for; the
    seconds are those of the whole document. ``fields`` fixes the columns, so the report takes one pass; a
    field that a document is not asked for is null.
    """
    right = benchmark_match(F.col("expected"), F.col("actual"))
    cell = F.when(F.col("actual").isNull(), "--").when(right, "OK").otherwise("WRONG")
    rows = results.select("model", "prompt", "document", "field", cell.alias("cell"), "seconds").where(F.col("field").isin(*fields))
    wide = rows.groupBy("model", "prompt", "document").agg(
        F.count_if(F.col("cell") == "OK").alias("correct"), F.count("*").alias("asked"), F.max("seconds").alias("seconds"), *(F.max(F.when(F.col("field") == f, F.col("cell"))).alias(f) for f in fields)
    )
    return wide.select("model", "prompt", "document", F.concat(F.col("correct").cast("string"), F.lit("/"), F.col("asked").cast("string")).alias("score"), "correct", *fields, "seconds")


def truth_in_selection(truth: DataFrame, selected: DataFrame) -> DataFrame:
    """``truth(document, field, value, page)`` with ``present``: whether the selected pages could have given the value.

    ``selected(document, page, text)``. A day is printed in other forms, so its page has to be among them; of
    any other value the first alternative has to stand on one of the pages. Tells a value that a model
    missed from one that it was never shown.
    """
    day = F.col("value").rlike(r"^\d{4}-\d{2}-\d{2}$")
    needle = F.lower(F.substring_index("value", "|", 1))
    asked = truth.withColumn("_day", day).withColumn("_needle", needle)
    met = asked.join(selected.select("document", F.col("page").alias("_page"), F.lower("text").alias("_text")), "document")
    there = met.groupBy("document", "field").agg(F.bool_or(F.when(F.col("_day"), F.col("_page") == F.col("page")).otherwise(F.contains("_text", "_needle"))).alias("present"))
    return truth.join(there, ["document", "field"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


# How answers about a pool of bids are composed.
NO_NARRATIVE = "No sufficiently relevant narrative evidence was found."
NARRATIVE_SECTIONS = ["technical_approach", "past_performance"]
TOLD, TOLD_CHARS, SNIPPET_CHARS, MOST_CITED = 4, 240, 500, 8


def pool_answers(questions: DataFrame, hits: DataFrame, facts: DataFrame) -> DataFrame:
    """``(question_id, route, answer)`` of ``questions(question_id, tender_id, question)``.

    Narrative questions are told by the first of their ``hits(question_id, rank, vendor_id, text)``, others by
    the recorded ``facts(tender_id, answer)``, hybrid ones by both.
    """
    asked = questions.withColumn("route", route(F.col("question")))
    who = F.coalesce("vendor_id", F.lit("Submission"))
    line = F.concat(who, F.lit(" records: "), F.trim(F.substring("text", 1, TOLD_CHARS)))
    told = hits.where(F.col("rank") <= TOLD).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    joined = asked.join(told, "question_id", "left").join(facts, "tender_id", "left")
    narrative = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), " "), F.lit(NO_NARRATIVE))
    both = F.concat(F.lit("Recorded facts: "), F.coalesce("answer", F.lit("")), F.lit("\n\nNarrative evidence: "), narrative)
    said = F.when(F.col("route") == "hybrid", both).when(F.col("route") == "qualitative", narrative).otherwise(F.coalesce("answer", F.lit("")))
    return joined.select("question_id", "route", said.alias("answer"))


def pool_citations(questions: DataFrame, hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """``(question_id, vendor_id, source_page, clause_ref, snippet)`` of the same questions.

    Narrative and hybrid questions cite their hits; a question about the audit cites the
    ``decisions(tender_id, vendor_id, vendor_name, reason, source_page, clause_ref, snippet)`` of the bids it names.
    """
    asked = questions.withColumn("route", route(F.col("question")))
    told = asked.where("route IN ('qualitative', 'hybrid')").join(hits.where(F.col("rank") <= MOST_CITED), "question_id")
    told = told.select("question_id", "vendor_id", "source_page", "clause_ref", F.substring("text", 1, SNIPPET_CHARS).alias("snippet"))
    low = F.lower("question")
    named = F.contains(low, F.lower("vendor_name")) | F.contains(low, F.lower("vendor_id"))
    audit = asked.where("route = 'audit'").select("question_id", "tender_id", "question").join(decisions.where("reason <> ''"), "tender_id").where(named)
    return told.unionByName(audit.select("question_id", "vendor_id", "source_page", "clause_ref", F.coalesce("snippet", "reason").alias("snippet")))


def hit_fields(hits: DataFrame) -> DataFrame:
    """Hits as an answer shows them: defaults for what a payload lacks, scores to four places."""
    return hits.withColumns({"text": F.coalesce("text", F.lit("")), "doc_kind": F.coalesce("doc_kind", F.lit("unknown")), "score": F.round("score", 4)})
