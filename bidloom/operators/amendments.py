"""Amendments of tenders: differences, application and impact, as pure functions of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import first_number, let, money_inr, parse_date
from .running import running

# What a stated change is about, in the order in which it is tried.
SUBJECTS: list[tuple[str, str]] = [
    (r"(?i)pre[\s-]*bid|clarification|query", "pre_bid_query_deadline"),
    (r"(?i)last date|due date|closing|submission of bids?|bid submission|deadline", "submission_deadline"),
    (r"(?i)\bemd\b|earnest money|bid security", "emd_amount"),
    (r"(?i)estimated cost|contract value|ecv|estimated value", "contract_value_estimate"),
    (r"(?i)turnover|revenue", "eligibility_criteria.turnover"),
    (r"(?i)experience|similar work|completed work", "eligibility_criteria.experience"),
    (r"(?i)net worth|solvency|liquid|working capital", "eligibility_criteria.financial"),
    (r"(?i)document|certificate|annexure|form\b", "mandatory_documents"),
]
# What the fields of a notice are called.
FIELD_LABELS = {
    "submission_deadline": "bid submission deadline",
    "pre_bid_query_deadline": "pre-bid query deadline",
    "emd_amount": "EMD amount",
    "contract_value_estimate": "estimated contract value",
}
DATES, AMOUNTS = ["pre_bid_query_deadline", "submission_deadline"], ["emd_amount", "contract_value_estimate"]


def classify(subject: Column, new_value: Column) -> Column:
    """The field a stated change is about; ``unmapped`` when nothing fits or the value has the wrong shape."""
    path = F.lit(None).cast("string")
    for pattern, field in reversed(SUBJECTS):
        path = F.when(F.coalesce(subject, F.lit("")).rlike(pattern), field).otherwise(path)
    # The value is read only where the path asks for a day or an amount, and the path is worked out once.
    shaped = lambda p: F.when(p.isin(*DATES), parse_date(new_value).isNotNull()).when(p.isin(*AMOUNTS), money_inr(new_value).isNotNull()).otherwise(p.isNotNull())
    return let(path, lambda p: F.when(shaped(p), p).otherwise("unmapped"))


def restated(parents: DataFrame, headers: DataFrame) -> DataFrame:
    """Header fields that a corrigendum reprints with another value than the tender's.

    Both inputs hold ``tender_id``, the two dates as printed or dates, and the two amounts as printed; a null
    or unreadable new value is no change, and neither is an amount that only looks different.
    """
    both = headers.alias("h").join(parents.alias("p"), "tender_id")
    found = []
    for f in DATES:
        found.append(_changed_date(f, F.col(f"h.{f}"), F.col(f"p.{f}").cast("date")))
    for f in AMOUNTS:
        new, old = F.col(f"h.{f}"), F.col(f"p.{f}")
        # Printed alike is alike; amounts are read only where the print differs, and once.
        differs = (F.coalesce(new, F.lit("")) != "") & (F.trim(new) != F.trim(F.coalesce(old, F.lit(""))))
        unlike = let(F.struct(money_inr(new).alias("a"), money_inr(old).alias("b")), lambda m: m["a"].isNull() | m["b"].isNull() | (m["a"] != m["b"]))
        found.append(F.when(F.when(differs, unlike).otherwise(False), _change(f, old, new)))
    changes = F.explode(F.array_compact(F.array(*found))).alias("c")
    return both.select("corrigendum_id", "tender_id", changes).select("corrigendum_id", "tender_id", "c.*")


def _changed_date(field: str, printed: Column, old: Column) -> Column:
    return let(parse_date(printed), lambda new: F.when(new.isNotNull() & ~new.eqNullSafe(old), _change(field, old.cast("string"), new.cast("string"))))


def _change(field: str, old: Column, new: Column) -> Column:
    return F.struct(F.lit(field).alias("field_path"), old.alias("old_value"), new.alias("new_value"))


def diff(restated_fields: DataFrame, stated: DataFrame) -> DataFrame:
    """Restated fields and the stated changes of other fields.

    ``stated(corrigendum_id, tender_id, subject, old_value, new_value)``.
    """
    placed = stated.withColumn("path", classify(F.col("subject"), F.col("new_value")))
    rest = placed.join(restated_fields.select("corrigendum_id", F.col("field_path").alias("path")).distinct(), ["corrigendum_id", "path"], "left_anti")
    path = F.when(F.col("path") == "unmapped", F.concat(F.lit("unmapped:"), F.substring("subject", 1, 80))).otherwise(F.col("path"))
    columns = ["corrigendum_id", "tender_id", "field_path", "old_value", "new_value"]
    return restated_fields.select(*columns).unionByName(rest.withColumn("field_path", path).select(*columns))


def fold(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"\s+", " "))


PATH = r"^(eligibility_criteria|mandatory_documents)(?:\[(?:\d+|\+)\])?(?:\.(\w+))?$"


def criterion_changes(changes: DataFrame, criteria: DataFrame) -> DataFrame:
    """The outcome of each change of a criterion: applied, conflict, ambiguous or unsupported.

    Candidates come by clause, else by old value (``changes(tender_id, change_id, field_path,
    clause_ref, old_value, new_value)``). An applied change names its criterion and its new threshold or that
    it is withdrawn.
    """
    parsed = changes.withColumn("attribute", F.regexp_extract("field_path", PATH, 2)).withColumn("known", F.regexp_extract("field_path", PATH, 1) == "eligibility_criteria")
    pairs = parsed.where("known").join(criteria.select("tender_id", "criterion_id", "criterion", F.col("clause_ref").alias("own_clause"), "threshold_raw"), "tender_id")
    by_clause = (fold(F.col("clause_ref")) != "") & (fold(F.col("own_clause")) == fold(F.col("clause_ref")))
    old = fold(F.col("old_value"))
    by_value = (old != "") & ((fold(F.col("threshold_raw")) == old) | fold(F.col("criterion")).contains(old))
    how = F.when(by_clause, 0).when(by_value, 1)
    ranked = pairs.withColumn("how", how).where("how IS NOT NULL")
    best = ranked.groupBy("change_id").agg(F.min("how").alias("how"))
    found = ranked.join(best, ["change_id", "how"]).groupBy("change_id").agg(F.count("*").alias("candidates"), F.min("criterion_id").alias("criterion_id"))
    out = parsed.join(found, "change_id", "left").fillna(0, ["candidates"])
    new, attribute = F.coalesce(F.trim("new_value"), F.lit("")), F.col("attribute")
    amount_path = attribute.isin("", "threshold_amount", "threshold_amount_inr", "threshold_raw")
    number_path = attribute.isin("threshold_number", "experience_years")
    outcome = (
        F.when(~F.col("known"), "unsupported")
        .when(F.col("candidates") == 0, "conflict")
        .when(F.col("candidates") > 1, "ambiguous")
        .when(new == "", "applied")
        .when(amount_path, F.when(money_inr(new).isNotNull(), "applied").otherwise("unsupported"))
        .when(number_path, F.when(first_number(new).isNotNull(), "applied").otherwise("unsupported"))
        .when(attribute == "is_mandatory", "applied")
        .otherwise("unsupported")
    )
    out = out.withColumn("outcome", outcome)
    applied = F.col("outcome") == "applied"
    return out.select(
        "tender_id", "change_id", "outcome", "candidates",
        F.when(applied, F.col("criterion_id")).alias("criterion_id"),
        F.when(applied & (new == ""), True).otherwise(False).alias("withdrawn"),
        F.when(applied & amount_path & (new != ""), money_inr(new).cast("double")).when(applied & number_path & (new != ""), first_number(new)).alias("new_threshold"),
    )


def apply_thresholds(criteria: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Criteria after the applied changes: of several for one criterion the last change stands."""
    last = outcomes.where("outcome = 'applied'").groupBy("criterion_id").agg(
        F.max_by("new_threshold", "change_id").alias("new_threshold"), F.max_by("withdrawn", "change_id").alias("withdrawn")
    )
    joined = criteria.join(last, "criterion_id", "left")
    return joined.withColumns(
        {
            "threshold": F.coalesce("new_threshold", "threshold"),
            "is_mandatory": F.col("is_mandatory") & ~F.coalesce("withdrawn", F.lit(False)),
        }
    ).drop("new_threshold", "withdrawn")


def impact(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """How decisions ``(*key, status, clause_ref)`` changed."""
    b = before.select(*key, F.col("status").alias("was"), F.col("clause_ref").alias("was_clause"))
    a = after.select(*key, F.col("status").alias("is"), F.col("clause_ref").alias("is_clause"))
    both = b.join(a, key, "full_outer")
    was_out, is_out = F.coalesce(F.col("was") == "eliminated", F.lit(False)), F.coalesce(F.col("is") == "eliminated", F.lit(False))
    direction = (
        F.when(was_out & ~is_out, "reinstated")
        .when(is_out & ~was_out, "newly_eliminated")
        .when(is_out & was_out & ~F.col("was_clause").eqNullSafe(F.col("is_clause")), "reason_changed")
        .otherwise("unchanged")
    )
    return both.withColumn("direction", direction)


def needs_review(issued: Column, deadline: Column, newly_eliminated: Column) -> Column:
    """An amendment issued after the deadline that newly eliminates a bid is not applied."""
    return F.coalesce(issued > deadline, F.lit(False)) & newly_eliminated


def stale(bids: DataFrame, corrigenda: DataFrame) -> DataFrame:
    """Bids whose last report is older than a corrigendum of their tender, with the newest one.

    ``bids(tender_id, vendor_id, last_report_at)``, ``corrigenda(tender_id, corrigendum_id, created_at)``. Both
    stand in one row of time, where newer ones are counted as they pass: no bid meets a corrigendum.
    """
    known = ["tender_id", "created_at"]
    came = corrigenda.where("tender_id IS NOT NULL AND created_at IS NOT NULL").select(*known, F.lit(1).alias("part"), F.struct("created_at", "corrigendum_id").alias("one"))
    seen = bids.where("tender_id IS NOT NULL AND last_report_at IS NOT NULL").select("tender_id", F.col("last_report_at").alias("created_at"), F.lit(0).alias("part"), "vendor_id")
    # Backwards in time, and a report before a corrigendum of its instant: what has gone by is newer.
    back = [F.col("created_at").desc(), "part"]
    passed = running(came.unionByName(seen, allowMissingColumns=True), ["tender_id"], back, {"newer": F.col("part")}, {"newest": F.col("one")})
    return passed.where("part = 0 AND newer > 0").groupBy("tender_id", "vendor_id").agg(F.sum("newer").alias("newer"), F.max("newest.corrigendum_id").alias("newest"))


def warnings(corrigenda: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(corrigendum_id, place, warning)``: missing dates, then the changes that were not applied, in order of change_id.

    ``corrigenda(corrigendum_id, issued_date, submission_deadline)`` and ``outcomes(corrigendum_id,
    change_id, field_path, outcome)``. Without a date an amendment counts as in time, so its lack is said. A
    row each, numbered from 1, so a corrigendum may leave any number of changes open.
    """
    texts = [(F.col("issued_date"), "no issued date: whether it came late is not known"), (F.col("submission_deadline"), "no submission deadline: whether it came late is not known")]
    said = F.array(*(F.struct(F.lit(0).alias("part"), F.lit(n).cast("long").alias("change_id"), F.when(d.isNull(), t).alias("warning")) for n, (d, t) in enumerate(texts)))
    dates = corrigenda.select("corrigendum_id", F.explode(said).alias("w")).select("corrigendum_id", "w.*").where("warning IS NOT NULL")
    open_ = outcomes.where("outcome <> 'applied'").select("corrigendum_id", F.lit(1).alias("part"), F.col("change_id").cast("long").alias("change_id"), F.concat("field_path", F.lit(": "), "outcome").alias("warning"))
    every = dates.unionByName(open_.join(corrigenda.select("corrigendum_id"), "corrigendum_id", "left_semi"))
    return running(every, ["corrigendum_id"], ["part", "change_id", "warning"], {"place": F.lit(1)}).select("corrigendum_id", F.col("place").cast("long").alias("place"), "warning")


def report_stamps(views: DataFrame) -> DataFrame:
    """``(bid_id, last_report_at)``: when each bid's report was last put in front of someone who acts on it.

    ``views(bid_id, at, kind)``: the first ``generated`` view and every ``rechecked`` one stamp; a ``read`` one never
    does, as it would clear the banner that it shows.
    """
    stamps = views.where("kind IN ('generated', 'rechecked')").groupBy("bid_id").agg(
        F.min(F.when(F.col("kind") == "generated", F.col("at"))).alias("first"), F.max(F.when(F.col("kind") == "rechecked", F.col("at"))).alias("again")
    )
    return stamps.select("bid_id", F.greatest("first", "again").alias("last_report_at"))


def impact_text(was: Column, now: Column, was_clause: Column, now_clause: Column, direction: Column) -> Column:
    """One line on what an amendment does to a bid."""
    # The wording of the outcomes.
    clause = lambda c: F.coalesce(c, F.lit("—"))
    return (
        F.when(direction == "unchanged", "unaffected")
        .when(direction == "reason_changed", F.concat(F.lit("still eliminated, clause "), clause(was_clause), F.lit(" -> "), clause(now_clause)))
        .otherwise(F.concat(was, F.lit(" -> "), now))
    )


def field_label(path: Column) -> Column:
    """What a reader calls a field: its label, what an unmapped one was stated to be, or its path in words."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for pair in FIELD_LABELS.items() for x in pair)), path)
    stated = F.when(path.startswith("unmapped:"), F.substring(path, F.lit(len("unmapped:") + 1), F.length(path))).when(path == "unmapped", F.lit("an unidentified term"))
    return F.coalesce(stated, label, F.replace(F.replace(path, F.lit("_"), F.lit(" ")), F.lit("."), F.lit(" — ")))


def rendered(value: Column) -> Column:
    """A value as text: dates in ISO form, null stays null."""
    return value.cast("string")


def changed_labels(changes: DataFrame) -> DataFrame:
    """``(corrigendum_id, labels)``: the distinct labels of ``changes(corrigendum_id, change_id, field_path)``, in order of first mention.

    Labels are counted per corrigendum before they are collected: fields are few, changes may be many.
    """
    first = changes.groupBy("corrigendum_id", field_label(F.col("field_path")).alias("label")).agg(F.min("change_id").alias("at"))
    return first.groupBy("corrigendum_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"))


def stale_banner(issued: Column, fields: Column) -> Column:
    """What a reader of an outdated report is told; ``fields`` are labels of what changed."""
    # The wording of the banner.
    when = F.coalesce(F.date_format(issued, "dd MMMM yyyy"), F.lit("recently"))
    when = F.when(issued.isNotNull(), F.concat(F.lit("on "), when)).otherwise(when)
    changed = F.when(F.size(fields) > 0, F.concat(F.lit(" Changed: "), F.array_join(fields, ", "), F.lit("."))).otherwise("")
    return F.concat(F.lit("This tender was updated "), when, F.lit("; check your compliance again."), changed)
