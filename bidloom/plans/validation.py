"""Findings, citations, texts and repairs over the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import clauses as L
from ..functions import questions as Q
from ..operators import amendments as A
from ..operators import compliance as C
from ..operators import conversion as K
from ..operators import evidence as E
from ..operators import jobs as J
from ..operators import pages as P
from ..operators import validation as Y
from .base import pick, pick_sql, query, quoted, read
from .tenders import ITEMS_SQL, items

_NOTICES = (
    "n AS (SELECT o_orderkey AS tender_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 - 5 AS INTEGER) END AS deadline, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 17 AS INTEGER) AS pre_bid, "
    "CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE o_orderpriority END AS authority, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * 0.02 * (1 + o_orderkey % 60) END AS emd, o_totalprice - 50000 AS estimate FROM orders)"
)


@query(
    "q54_validation",
    f"WITH {_NOTICES} SELECT tender_id, 'submission_deadline' AS field, 'warning' AS severity, 'missing' AS message FROM n WHERE deadline IS NULL UNION ALL SELECT tender_id, 'issuing_authority', 'warning', 'missing' FROM n WHERE trim(authority) = '' "
    "UNION ALL SELECT tender_id, 'emd_inr', 'warning', 'missing' FROM n WHERE emd IS NULL UNION ALL SELECT tender_id, 'submission_deadline', 'warning', 'has passed' FROM n WHERE deadline < DATE '1995-01-01' "
    "UNION ALL SELECT tender_id, 'pre_bid_query_deadline', 'error', 'after the bids are due' FROM n WHERE pre_bid > deadline UNION ALL SELECT tender_id, 'emd_inr', 'error', 'not an amount' FROM n WHERE emd <= 0 "
    "UNION ALL SELECT tender_id, 'estimate_inr', 'error', 'not an amount' FROM n WHERE estimate <= 0 UNION ALL SELECT tender_id, 'emd_inr', 'error', 'above the estimate' FROM n WHERE emd > estimate "
    "UNION ALL SELECT l_orderkey, 'criterion ' || l_linenumber, 'error', 'not an amount' FROM lineitem WHERE l_extendedprice <= 20000",
)
def validation(spark, d):
    """Findings on notices and their thresholds, one row each."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    notices = read(spark, d, "orders").select(
        k.alias("tender_id"), F.when(k % 11 != 0, F.date_add(day, (k % 40 - 5).cast("int"))).alias("submission_deadline"), F.date_add(day, (k % 17).cast("int")).alias("pre_bid_query_deadline"),
        F.when(k % 13 == 0, " ").otherwise(F.col("o_orderpriority")).alias("issuing_authority"), F.when(k % 7 != 0, F.col("o_totalprice") * 0.02 * (1 + k % 60)).alias("emd_inr"), (F.col("o_totalprice") - 50000).alias("estimate_inr"),
    )
    criteria = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("pos"), (F.col("l_extendedprice") - 20000).alias("threshold_inr"))
    return Y.notice_findings(notices, criteria, F.lit(datetime.date(1995, 1, 1)))


@query(
    "q89_bid_findings",
    "WITH t AS (SELECT o_custkey AS bid_id, year(o_orderdate) AS year, o_totalprice - 30000 AS amount FROM orders), e AS (SELECT o_custkey AS bid_id FROM orders WHERE o_orderstatus = 'F') "
    "SELECT c_custkey AS bid_id, 'quoted_inr' AS field, 'error' AS severity, 'not an amount' AS message FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT c_custkey, 'liquid_inr', 'error', 'not an amount' FROM customer WHERE c_custkey % 4 <> 0 AND c_acctbal <= -500 "
    "UNION ALL SELECT c_custkey, 'years_in_business', 'error', 'not plausible' FROM customer WHERE c_custkey % 170 - 5 < 0 OR c_custkey % 170 - 5 > 150 UNION ALL SELECT c_custkey, 'turnover', 'warning', 'missing' FROM customer WHERE c_custkey NOT IN (SELECT bid_id FROM t) "
    "UNION ALL SELECT c_custkey, 'enclosures', 'warning', 'missing' FROM customer WHERE c_custkey NOT IN (SELECT bid_id FROM e) UNION ALL SELECT bid_id, 'turnover ' || year, 'error', 'not an amount' FROM t WHERE amount <= 0",
)
def bid_findings(spark, d):
    """Findings on bids, their turnovers and enclosures, one row each."""
    k = F.col("c_custkey")
    bids = read(spark, d, "customer").select(k.alias("bid_id"), F.col("c_acctbal").alias("quoted_inr"), F.when(k % 4 != 0, F.col("c_acctbal") + 500).alias("liquid_inr"), (k % 170 - 5).alias("years_in_business"))
    o = read(spark, d, "orders")
    turnover = o.select(F.col("o_custkey").alias("bid_id"), F.year("o_orderdate").alias("year"), (F.col("o_totalprice") - 30000).alias("amount_inr"))
    return Y.bid_findings(bids, turnover, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("bid_id"), F.col("o_orderpriority").alias("name")))


@query(
    "q90_certificates",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN false WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' END AS valid FROM lineitem",
)
def certificates(spark, d):
    """Whether each certificate is in force on a day; unknown without an end."""
    till = F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("date"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", Y.certificate_valid(F.col("l_returnflag") != "R", till, F.lit(datetime.date(1996, 1, 1))).alias("valid"))


@query(
    "q91_latest_turnover",
    "WITH t AS (SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS year, o_totalprice AS amount FROM orders WHERE o_orderkey % 13 <> 0), l AS (SELECT o_custkey, max(year) AS year FROM t GROUP BY ALL) SELECT o_custkey, year, max(amount) AS amount_inr FROM t JOIN l USING (o_custkey, year) GROUP BY ALL",
)
def latest_turnover(spark, d):
    """The turnover of each bidder's last year with a readable figure."""
    t = read(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")).alias("amount_inr"))
    return Y.latest_turnover(t, ["o_custkey"])


RULE_TEXTS = ["Two sealed envelopes", "Number every page", "Sign and stamp each page", "Bind the bid in one volume"]


@query("q92_format_items", f"SELECT p_brand AS tender_id, p_partkey AS pos, {pick_sql(RULE_TEXTS, 'p_partkey')} AS requirement, 'format_rule' AS kind, 'manual_check' AS status, 'review' AS severity, 2 AS block FROM part")
def format_items(spark, d):
    """Format rules as items that a person has to check."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("tender_id"), F.col("p_partkey").alias("pos"), pick(RULE_TEXTS, F.col("p_partkey")).alias("rule"), F.lit(None).cast("string").alias("clause_ref"))
    return Y.format_items(p).select("tender_id", "pos", "requirement", "kind", "status", "severity", "block")


PRINTED = [
    "28.1 The manager will evaluate each tenderer", "  vi)  Liquid assets of not less than Rs.49.855", "49.855 Crores in total", "0.973 is the factor", "12", "1.1 Scope of work", " (4) The contractor shall provide",
    "3.2.", "• 9 (a) Payment terms", "plain prose 28.1 in the middle", "2 | 3 | 4", "7 days after the award",
]
CITED = ["2.8.1", "1.1 (4)", "28.1", "28.1(vi)", "9", "", "3.2", "12", "11"]
# The numbering as one expression, for the DuckDB form.
_REF = r"[1-9]\d*(?:\.\d+)*(?:\.(?:[ivxlc]+|[a-z])\b)*(?:\s*\.?\s*\([a-z0-9]+\))*"
_LEAD = rf"(?i)^[ \t•·*\-–—|]*({_REF})(.*)$"
_UNIT = r"(?i)^\s*(?:" + "|".join(u.replace(".", r"\.\s*").replace(" ", r"\s*") for u in sorted(L.UNITS, key=len, reverse=True)) + r")\.?(?:\W|$)"
_COMPOSED = r"^([\d.]+?)\(?([ivxlc]+|[a-z]|\d{1,2})\)$"


@query(
    "q93_unverifiable",
    f"WITH t AS (SELECT p_partkey AS doc_id, CAST(i AS INTEGER) AS line_no, {pick_sql(PRINTED, 'p_partkey * (i + 1) + i * 5')} AS line FROM part, range(0, 6) r(i)), "
    f"c AS (SELECT DISTINCT p_partkey AS doc_id, {pick_sql(CITED, 'p_partkey + i * 4')} AS clause_ref FROM part, range(0, 3) r(i)), "
    f"x AS (SELECT *, regexp_extract(line, {quoted(_LEAD)}, 1) AS num, regexp_extract(line, {quoted(_LEAD)}, 2) AS tail, nullif(lower(regexp_extract(line, {quoted(L.LEADING_ITEM)}, 1)), '') AS item FROM t), "
    f"y AS (SELECT *, CASE WHEN num <> '' AND NOT regexp_matches(tail, {quoted(_UNIT)}) AND (CASE WHEN trim(tail, ' .:)–—-|' || chr(9)) = '' THEN contains(num, '.') OR contains(num, '(') ELSE regexp_matches(tail, '[A-Za-z]{{3}}') END) THEN regexp_replace(lower(num), '\\s+', '', 'g') END AS ref FROM x), "
    "z AS (SELECT *, CASE WHEN regexp_matches(tail, '[A-Za-z]{3}') THEN ref END AS section FROM y), w AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading FROM z), "
    "refs AS (SELECT DISTINCT doc_id, ref FROM w WHERE ref IS NOT NULL), its AS (SELECT DISTINCT doc_id, heading, item FROM w WHERE section IS NULL AND item IS NOT NULL AND heading IS NOT NULL), "
    "q AS (SELECT *, regexp_replace(lower(clause_ref), '\\s+', '', 'g') AS needle, regexp_replace(clause_ref, '[^0-9]', '', 'g') AS spine FROM c WHERE clause_ref <> ''), "
    f"s AS (SELECT *, nullif(regexp_extract(needle, {quoted(_COMPOSED)}, 2), '') AS part_item, rtrim(regexp_extract(needle, {quoted(_COMPOSED)}, 1), '.') AS part_section FROM q) "
    "SELECT doc_id, clause_ref, CASE WHEN alike = 1 THEN near END AS suggestion FROM (SELECT s.doc_id, s.clause_ref, bool_or(starts_with(ref, needle)) AS verbatim, count(*) FILTER (regexp_replace(ref, '[^0-9]', '', 'g') = spine AND ref <> needle) AS alike, "
    "min(ref) FILTER (regexp_replace(ref, '[^0-9]', '', 'g') = spine AND ref <> needle) AS near, any_value(part_item) AS part_item, any_value(part_section) AS part_section FROM s JOIN refs USING (doc_id) GROUP BY s.doc_id, s.clause_ref) m "
    "WHERE NOT verbatim AND NOT EXISTS (SELECT 1 FROM its WHERE its.doc_id = m.doc_id AND its.item = m.part_item AND starts_with(its.heading, m.part_section))",
)
def unverifiable(spark, d):
    """Citations that the printed numbering does not bear out, with the one they may have meant."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    text = F.array_join(F.array(*(pick(PRINTED, k * (i + 1) + i * 5) for i in range(6))), "\n")
    lines = P.lines_of(p.select(k.alias("doc_id"), text.alias("text")))
    cited = p.select(k.alias("doc_id"), F.explode(F.array(*(pick(CITED, k + i * 4) for i in range(3)))).alias("clause_ref"))
    return Y.unverifiable(cited, lines)


_ACTION_ITEMS = (
    "i0 AS (SELECT *, pos = 7 AS doc FROM it), i1 AS (SELECT tender_id, vendor_id, pos, requirement, severity, required_value, explanation, CASE WHEN doc THEN 'document' ELSE kind END AS kind, "
    "CASE WHEN doc THEN (['not_assessable', 'partial', 'missing', 'manual_check'])[1 + vendor_id % 4] ELSE status END AS status, CASE WHEN doc THEN CASE WHEN vendor_id % 3 = 0 THEN 'Letter ' || vendor_id END ELSE found_value END AS found_value, "
    "CASE WHEN (pos = 6 AND vendor_id % 2 = 0) OR (doc AND vendor_id % 5 < 2) THEN 'this clause applies to your bid' END AS cond FROM i0), "
    "g AS (SELECT *, CASE WHEN status = 'not_assessable' AND kind <> 'document' THEN 'clarify' WHEN status IN ('not_assessable', 'manual_check', 'partial') THEN 'verify' WHEN kind = 'document' THEN 'upload' ELSE 'hard_fail' END AS grp, "
    "CASE WHEN contains(trim(requirement), ' ') THEN lower(left(trim(requirement), 1)) || substr(trim(requirement), 2) ELSE trim(requirement) END AS inner_need FROM i1 WHERE status <> 'match')"
)


@query(
    "q94_action_texts",
    f"WITH {ITEMS_SQL}, {_ACTION_ITEMS} "
    "SELECT tender_id, vendor_id, pos, CASE WHEN grp = 'upload' THEN 'Upload ' || coalesce(nullif(required_value, ''), requirement) WHEN grp = 'hard_fail' THEN explanation WHEN grp = 'clarify' THEN 'State clearly in your bid: ' || requirement "
    "WHEN status = 'not_assessable' THEN 'Review the relevant section of your bid against: ' || requirement WHEN cond IS NOT NULL AND found_value <> '' THEN 'Only if ' || cond || ': confirm “' || found_value || '” satisfies ' || inner_need || '. Otherwise this does not apply to you.' "
    "WHEN cond IS NOT NULL THEN 'Only if ' || cond || ': ' || inner_need || '. Otherwise this does not apply to you.' WHEN status = 'partial' AND found_value <> '' THEN 'Confirm “' || found_value || '” satisfies: ' || requirement ELSE 'Check yourself: ' || requirement END AS action FROM g",
)
def action_texts(spark, d):
    """What every open item asks of the vendor: documents and conditions among them."""
    i, v, doc = items(spark, d), F.col("vendor_id"), F.col("pos") == 7
    i = i.withColumns({
        "kind": F.when(doc, "document").otherwise(F.col("kind")), "status": F.when(doc, pick(["not_assessable", "partial", "missing", "manual_check"], v)).otherwise(F.col("status")),
        "found_value": F.when(doc, F.when(v % 3 == 0, F.concat(F.lit("Letter "), v.cast("string")))).otherwise(F.col("found_value")),
    })
    condition = F.when(((F.col("pos") == 6) & (v % 2 == 0)) | (doc & (v % 5 < 2)), C.condition_text(F.lit("conditional")))
    return C.actions(i).withColumn("conditional_on", condition).select("tender_id", "vendor_id", "pos", C.action_text().alias("action"))


@query(
    "q95_completion_texts",
    f"WITH {ITEMS_SQL} SELECT tender_id, vendor_id, count(*) FILTER (is_mandatory AND status = 'match') || ' of ' || count(*) FILTER (is_mandatory) || ' mandatory requirements satisfied' AS completion FROM it GROUP BY ALL",
)
def completion_texts(spark, d):
    """The count of met requirements of every bid, in words."""
    return C.verdicts(items(spark, d), ["tender_id", "vendor_id"]).select("tender_id", "vendor_id", C.completion_text(F.col("satisfied"), F.col("mandatory")).alias("completion"))


OUTCOMES = ["applied", "conflict", "ambiguous"]


_PATHS = ["emd_amount", "eligibility_criteria.turnover", "unmapped:site visit", "submission_deadline", "unmapped"]
_LABELS = ["EMD amount", "eligibility criteria — turnover", "site visit", "bid submission deadline", "an unidentified term"]


@query(
    "q96_amendment_warnings",
    f"WITH c AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, {pick_sql(_PATHS, 'l_partkey')} AS path, {pick_sql(_LABELS, 'l_partkey')} AS label, {pick_sql(OUTCOMES, 'l_linenumber')} AS outcome FROM lineitem), "
    "w AS (SELECT o_orderkey AS id, 0 AS part, 0 AS n, 'no issued date: whether it came late is not known' AS warning FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 0, 1, 'no submission deadline: whether it came late is not known' FROM orders WHERE o_orderkey % 7 = 0 "
    "UNION ALL SELECT id, 1, n, path || ': ' || outcome FROM c WHERE outcome <> 'applied'), x AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY part, n, warning) AS place, warning FROM w), "
    "f AS (SELECT id, label, min(n) AS n FROM c GROUP BY ALL), l AS (SELECT id, string_agg(label, ', ' ORDER BY n, label) AS labels FROM f GROUP BY id) "
    "SELECT o_orderkey, place, warning, 'This tender was updated ' || CASE WHEN o_orderkey % 5 = 0 THEN 'recently' ELSE 'on ' || strftime(CAST(o_orderdate AS DATE), '%d %B %Y') END || '; check your compliance again.' || coalesce(' Changed: ' || labels || '.', '') AS banner "
    "FROM orders LEFT JOIN x ON x.id = o_orderkey LEFT JOIN l ON l.id = o_orderkey",
)
def amendment_warnings(spark, d):
    """What has to be said with an amendment, a row each: missing dates and open changes; and the banner of outdated reports."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    issued = F.when(k % 5 != 0, F.col("o_orderdate").cast("date"))
    c = o.select(k.alias("corrigendum_id"), issued.alias("issued_date"), F.when(k % 7 != 0, F.col("o_orderdate").cast("date")).alias("submission_deadline"))
    changes = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("corrigendum_id"), F.col("l_linenumber").alias("change_id"), pick(_PATHS, F.col("l_partkey")).alias("field_path"), pick(OUTCOMES, F.col("l_linenumber")).alias("outcome"))
    said = A.warnings(c, changes)
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    banners = c.join(A.changed_labels(changes), "corrigendum_id", "left").select("corrigendum_id", A.stale_banner(F.col("issued_date"), labels).alias("banner"))
    return banners.join(said, "corrigendum_id", "left").select(F.col("corrigendum_id").alias("o_orderkey"), "place", "warning", "banner")


EXPECTED = ["1.1(4)", "7", "clauses 4.1, 4.2 and 5", "—", "2.8", "NIT clause 4.1", "1.1"]
ACTUAL = ["1.1 (4)", "7 Manufacturer authorization", "4.1", "4.2 (a)", "5", "1.1(4)(a)", "12.8", "See 2 . 8 below"]


_ONE = L.KEY_REFERENCE
_LISTED = rf"(nit )?clauses? {_ONE}(( ?, ?(and )?| and ){_ONE})*"


def _tight_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), '\s*([.(])\s*', '\1', 'g'), '\s*\)', ')', 'g')"


@query(
    "q97_clause_match",
    f"WITH s AS (SELECT p_partkey, {_tight_sql(pick_sql(EXPECTED, 'p_partkey'))} AS e, [{_tight_sql(pick_sql(ACTUAL, 'p_partkey // 7'))}, {_tight_sql(pick_sql(ACTUAL, 'p_partkey // 56'))}, {_tight_sql('p_name')}] AS a FROM part), "
    f"m AS (SELECT *, CASE WHEN regexp_full_match(e, {quoted(_LISTED)}) THEN regexp_extract_all(e, {quoted(_ONE)}) ELSE [e] END AS members FROM s), "
    r"u AS (SELECT p_partkey, e, a, unnest(members) AS m FROM m), f AS (SELECT p_partkey, e, len(list_filter(a, lambda x: regexp_matches(x, '(^|[^\w.])' || regexp_escape(m) || '($|[^\w.(])'))) > 0 AS ok FROM u) "
    "SELECT p_partkey, CASE WHEN e NOT IN ('', '-', '—') THEN bool_and(ok) END AS ok FROM f GROUP BY p_partkey, e",
)
def clause_match(spark, d):
    """Whether an answer names the clause that the key asks for."""
    k = F.col("p_partkey")
    actual = F.array(pick(ACTUAL, F.floor(k / 7).cast("long")), pick(ACTUAL, F.floor(k / 56).cast("long")), F.col("p_name"))
    return read(spark, d, "part").select(k, L.clause_matches(pick(EXPECTED, k), actual).alias("ok"))


PREAMBLES = ["First, looking at source [1]. ", "Okay. So let me check. ", "So it is Rs. 5 Cr [1]. ", "", "The user asks a lot! Well, now. "]
_SENTENCES = "string_split(regexp_replace(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), '(?i)\\b(" + "|".join(Q.ABBREVIATIONS) + ")[.]' || chr(1), '\\1. ', 'g'), chr(1))"
_OPENS = "(?i)^\\s*(?:" + "|".join(o.replace("'", "''") for o in Q.OPENERS) + ")\\b"


@query(
    "q98_strip_preamble",
    f"WITH c AS (SELECT conv_id, turn, trim({pick_sql(PREAMBLES, 'conv_id + turn')} || trim(regexp_replace(replace(replace(text, '<', ''), '>', ''), '\\s+', ' ', 'g'))) AS t FROM conversations), s AS (SELECT *, {_SENTENCES} AS s FROM c), "
    f"n AS (SELECT *, list_position(list_transform(s, lambda x: regexp_matches(x, '{_OPENS}') AND NOT regexp_matches(regexp_replace(x, '\\[\\d+\\]', '', 'g'), '\\d')), false) AS p FROM s) "
    "SELECT conv_id, turn, CASE WHEN coalesce(p, 0) = 0 THEN t ELSE trim(array_to_string(s[p:], ' ')) END AS answer FROM n",
)
def strip_preamble(spark, d):
    """Answers from their first sentence that says something."""
    c = read(spark, d, "conversations")
    plain = F.trim(F.regexp_replace(F.translate("text", "<>", ""), r"\s+", " "))
    return c.select("conv_id", "turn", Q.strip_preamble(F.concat(pick(PREAMBLES, F.col("conv_id") + F.col("turn")), plain)).alias("answer"))


@query(
    "q99_job_recovery",
    f"WITH j AS (SELECT o_orderkey, {pick_sql(['queued', 'running', 'succeeded', 'running'], 'o_orderkey')} AS state, o_orderdate AS due, o_orderkey % 5 AS attempts FROM orders) "
    "SELECT o_orderkey, CASE WHEN state = 'running' AND due <= TIMESTAMP '1995-06-01' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE state END AS state, state = 'running' AND due <= TIMESTAMP '1995-06-01' AS recovered FROM j",
)
def job_recovery(spark, d):
    """Jobs whose lease has ended are queued again, or fail when they have no attempt left."""
    k = F.col("o_orderkey")
    jobs = read(spark, d, "orders").select(k, pick(["queued", "running", "succeeded", "running"], k).alias("state"), F.col("o_orderdate").alias("lease_ends_at"), (k % 5).alias("attempts"))
    return J.recovered(jobs, F.lit("1995-06-01").cast("timestamp_ntz")).select("o_orderkey", "state", "recovered")


@query(
    "q100_retag_chunks",
    f"WITH s AS (SELECT s_suppkey % 40 AS bid_id, arg_max({pick_sql(['pending', 'eliminated', 'shortlisted'], 's_suppkey')}, s_suppkey) AS now FROM supplier GROUP BY ALL) "
    "SELECT l_orderkey * 10 + l_linenumber AS chunk_id, coalesce(now, l_linestatus) AS status FROM lineitem LEFT JOIN s ON bid_id = l_suppkey",
)
def retag_chunks(spark, d):
    """Chunks with the status that their bid has now."""
    s = read(spark, d, "supplier").select((F.col("s_suppkey") % 40).alias("bid_id"), pick(["pending", "eliminated", "shortlisted"], F.col("s_suppkey")).alias("status"), F.col("s_suppkey").alias("changed_at"))
    c = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_suppkey").alias("bid_id"), F.col("l_linestatus").alias("status"))
    return Y.retag(c, s).select("chunk_id", "status")


@query(
    "q101_point_ids",
    "WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc' || doc_id || ':' || doc_id % 7)) AS h FROM documents) SELECT doc_id, left(h, 8) || '-' || h[9:12] || '-5' || h[14:16] || '-' || (['8', '9', 'a', 'b'])[1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4] || h[18:20] || '-' || h[21:32] AS point_id FROM h",
)
def point_ids(spark, d):
    """Identifiers of chunks that are the same on every run."""
    return read(spark, d, "documents").select("doc_id", Y.point_id(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("doc_id") % 7).alias("point_id"))


STAGE_NEEDS = ["database", "vectors", "model", "answer key"]


@query(
    "q102_blocked_stages",
    f"WITH n AS (SELECT DISTINCT event_type AS stage, {pick_sql(STAGE_NEEDS, 'user_id')} AS resource FROM events), m AS (SELECT stage, string_agg(resource, ', ' ORDER BY resource) AS missing FROM n WHERE resource NOT IN (SELECT {pick_sql(STAGE_NEEDS, 'n_nationkey * 2')} FROM nation) GROUP BY stage) "
    "SELECT stage, m.missing IS NOT NULL AS blocked, coalesce(m.missing, '') AS missing FROM (SELECT DISTINCT event_type AS stage FROM events) LEFT JOIN m USING (stage)",
)
def blocked_stages(spark, d):
    """What each stage of an evaluation waits for."""
    e = read(spark, d, "events")
    needs = e.select(F.col("event_type").alias("stage"), pick(STAGE_NEEDS, F.col("user_id")).alias("resource"))
    have = read(spark, d, "nation").select(pick(STAGE_NEEDS, F.col("n_nationkey") * 2).alias("resource"))
    return Y.blocked_stages(e.select(F.col("event_type").alias("stage")).distinct(), needs, have).select("stage", "blocked", F.array_join("missing", ", ").alias("missing"))


# Expected values of three kinds from each part's key, and answers that carry them, carry others or nothing.
_N = "(1 + p_partkey % 9000) * 10"
_WANTED_SQL = (
    f"CASE p_partkey % 3 WHEN 0 THEN format('{{:,}}', {_N}) WHEN 1 THEN CAST(DATE '2025-01-01' + CAST(p_partkey % 700 AS INTEGER) AS VARCHAR) ELSE 'Body ' || p_partkey || '|PWD ' || p_size END"
)
_GOT_SQL = (
    "CASE g WHEN 5 THEN (['none', 'N/A', '  ', 'not stated', NULL])[1 + p_partkey % 5] ELSE CASE p_partkey % 3 "
    f"WHEN 0 THEN CASE g WHEN 0 THEN 'Rs. ' || format('{{:,}}', {_N}) || '/-' WHEN 1 THEN CAST(CAST({_N} / 100000.0 AS DECIMAL(12, 4)) AS VARCHAR) || ' Lakh' WHEN 2 THEN 'Rs. ' || format('{{:,}}', {_N} + 10) WHEN 3 THEN 'INR ' || {_N} || ' only' ELSE 'five thousand' END "
    "WHEN 1 THEN CASE WHEN g % 2 = 0 THEN strftime(DATE '2025-01-01' + CAST(p_partkey % 700 + CASE WHEN g IN (2, 4) THEN 1 ELSE 0 END AS INTEGER), '%-d %B %Y') ELSE strftime(DATE '2025-01-01' + CAST(p_partkey % 700 AS INTEGER), '%d.%m.%Y') END "
    "ELSE CASE g WHEN 0 THEN 'the BODY ' || p_partkey || ' of works' WHEN 1 THEN 'pwd ' || p_size WHEN 2 THEN 'Body ' || (p_partkey + 1) || ' only' WHEN 3 THEN 'of the PWD ' || p_size || ', ' || p_brand ELSE p_name END END END"
)


@query(
    "q103_benchmark_match",
    f"WITH s AS (SELECT p_partkey, p_partkey // 3 % 6 AS g, p_size, p_brand, p_name FROM part), t AS (SELECT p_partkey, {_WANTED_SQL} AS w, trim(coalesce({_GOT_SQL}, '')) AS got FROM s), "
    "u AS (SELECT *, CASE WHEN got ILIKE '% lakh' THEN TRY_CAST(regexp_extract(got, '([0-9.]+)', 1) AS DOUBLE) * 100000 ELSE TRY_CAST(replace(regexp_extract(got, '([0-9][0-9,]*)', 1), ',', '') AS DOUBLE) END AS inr, "
    "coalesce(TRY_CAST(try_strptime(got, '%d %B %Y') AS DATE), TRY_CAST(try_strptime(got, '%d.%m.%Y') AS DATE)) AS day FROM t) "
    "SELECT p_partkey, w AS expected, CASE WHEN lower(got) IN ('', 'none', 'null', 'n/a', 'not stated') THEN FALSE WHEN regexp_full_match(w, '[0-9,]+') THEN coalesce(abs(inr - CAST(replace(w, ',', '') AS DOUBLE)) < 0.001, FALSE) "
    "WHEN regexp_full_match(w, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN coalesce(CAST(day AS VARCHAR) = w, FALSE) ELSE len(list_filter(string_split(w, '|'), lambda x: contains(lower(got), lower(x)))) > 0 END AS ok FROM u",
)
def benchmark_match(spark, d):
    """Whether an extracted value carries what a benchmark expects: amounts by rupees, dates by day, names by a part."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    g, n = F.floor(k / 3) % 6, (1 + k % 9000) * 10
    day = lambda more: F.date_add(F.lit("2025-01-01").cast("date"), (k % 700 + more).cast("int"))
    named = F.format_number(n, 0)
    expected = F.when(k % 3 == 0, named).when(k % 3 == 1, day(0).cast("string")).otherwise(F.concat(F.lit("Body "), k.cast("string"), F.lit("|PWD "), F.col("p_size").cast("string")))
    printed = day(F.when(g.isin(2, 4), 1).otherwise(0))
    found = (
        F.when(g == 5, F.element_at(F.array(F.lit("none"), F.lit("N/A"), F.lit("  "), F.lit("not stated"), F.lit(None)), (k % 5 + 1).cast("int")))
        .when((k % 3 == 0) & (g == 0), F.concat(F.lit("Rs. "), named, F.lit("/-"))).when((k % 3 == 0) & (g == 1), F.concat((n / 100000).cast("decimal(12,4)").cast("string"), F.lit(" Lakh")))
        .when((k % 3 == 0) & (g == 2), F.concat(F.lit("Rs. "), F.format_number(n + 10, 0))).when((k % 3 == 0) & (g == 3), F.concat(F.lit("INR "), n.cast("string"), F.lit(" only"))).when(k % 3 == 0, "five thousand")
        .when(k % 3 == 1, F.when(g % 2 == 0, F.date_format(printed, "d MMMM yyyy")).otherwise(F.date_format(printed, "dd.MM.yyyy")))
        .when(g == 0, F.concat(F.lit("the BODY "), k.cast("string"), F.lit(" of works"))).when(g == 1, F.concat(F.lit("pwd "), F.col("p_size").cast("string"))).when(g == 2, F.concat(F.lit("Body "), (k + 1).cast("string"), F.lit(" only")))
        .when(g == 3, F.concat(F.lit("of the PWD "), F.col("p_size").cast("string"), F.lit(", "), F.col("p_brand"))).otherwise(F.col("p_name"))
    )
    return p.select(k, expected.alias("expected"), E.benchmark_match(expected, found).alias("ok"))


@query(
    "q104_chunk_clauses",
    r"SELECT p_partkey, nullif(rtrim(regexp_extract(txt, '^\s*((?:\d+\.)+\d*|[A-Z]\.|\(?[ivxlIVXL]+\))\s+', 1), '.'), '') AS clause_ref FROM (SELECT p_partkey, "
    + pick_sql([*PRINTED, "A. General terms", "(iv) Experience", "4. Payment"], "p_partkey") + " AS txt FROM part)",
)
def chunk_clauses(spark, d):
    """The clause number a chunk begins with."""
    return read(spark, d, "part").select("p_partkey", L.chunk_clause(pick([*PRINTED, "A. General terms", "(iv) Experience", "4. Payment"], F.col("p_partkey"))).alias("clause_ref"))


DATES_RAW, DATES_READ = ["15.03.2025", "1 April 2025", "soon", ""], ["2025-03-15", "2025-04-01", "", ""]
SUMS_RAW, SUMS_READ = ["Rs. 2 Lakh", "₹1.5 Cr", "nil", "Rs. 12,34,567"], ["200000", "15000000", "", "1234567"]


@query(
    "q105_typed_notices",
    f"SELECT 'file' || o_orderkey AS source_name, CASE WHEN o_orderkey % 5 = 0 THEN 'file' || o_orderkey ELSE 'NIT ' || o_orderkey END AS tender_id, o_orderpriority AS title, nullif({pick_sql(DATES_READ, 'o_orderkey')}, '') AS submission_deadline, "
    f"CAST(nullif({pick_sql(SUMS_READ, 'o_orderkey')}, '') AS DOUBLE) AS emd_inr, CAST(nullif({pick_sql(SUMS_READ, 'o_orderkey // 4')}, '') AS DOUBLE) AS estimate_inr FROM orders",
)
def typed_notices(spark, d):
    """Raw notices with dates and rupees read."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    headers = o.select(
        F.concat(F.lit("file"), k.cast("string")).alias("source_name"), F.when(k % 5 != 0, F.concat(F.lit(" NIT "), k.cast("string"))).otherwise("").alias("tender_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("issuing_authority"),
        pick(DATES_RAW, k).alias("submission_deadline"), F.lit(None).cast("string").alias("pre_bid_query_deadline"), pick(SUMS_RAW, k).alias("emd_raw"), pick(SUMS_RAW, F.floor(k / 4).cast("long")).alias("estimate_raw"),
    )
    n = K.typed_notices(headers)
    return n.select("source_name", "tender_id", "title", F.col("submission_deadline").cast("string").alias("submission_deadline"), F.col("emd_inr").cast("double").alias("emd_inr"), F.col("estimate_inr").cast("double").alias("estimate_inr"))


@query(
    "q106_typed_turnover",
    f"WITH r AS (SELECT o_custkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS BIGINT) END AS year, CAST(nullif({pick_sql(SUMS_READ, 'o_custkey + o_orderkey // 64')}, '') AS DOUBLE) AS amount FROM orders) "
    "SELECT o_custkey, year, CASE WHEN count(DISTINCT coalesce(amount, -1)) = 1 THEN max(amount) END AS amount_inr, count(DISTINCT coalesce(amount, -1)) > 1 AS conflicting FROM r WHERE year IS NOT NULL GROUP BY ALL",
)
def typed_turnover(spark, d):
    """Raw turnover statements, one figure per year or a conflict."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    raw = o.select("o_custkey", F.when(k % 9 == 0, "undated").otherwise(F.concat(F.lit("FY"), F.year("o_orderdate").cast("string"))).alias("year"), pick(SUMS_RAW, F.col("o_custkey") + F.floor(k / 64).cast("long")).alias("amount_raw"))
    t = K.typed_turnover(raw, ["o_custkey"])
    return t.select("o_custkey", F.col("year").cast("long").alias("year"), F.col("amount_inr").cast("double").alias("amount_inr"), "conflicting")


_SIZE, _OVERLAP = 700, 100
# One sentence without paragraphs is cut by size alone: a piece of the size after each step, and the rest.
_FLAT = r"regexp_replace(trim(regexp_replace({x}, '[.;:\n]', ' ', 'g')), '\s+', ' ', 'g')"
_PIECES = "CASE WHEN length({t}) = 0 THEN 0 WHEN length({t}) <= {size} THEN 1 ELSE 1 + CAST(ceil((length({t}) - ({size})) / CAST(({size}) - " + str(_OVERLAP) + " AS DOUBLE)) AS BIGINT) END"
_PIECE = "substr({t}, 1 + i * (({size}) - " + str(_OVERLAP) + "), {size})"


def _flat(text):
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"[.;:\n]", " ")), r"\s+", " ")


@query(
    "q107_page_chunks",
    f"WITH c AS (SELECT source, doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN '4.2 ' ELSE '' END || {_FLAT.format(x='text')}) AS t FROM documents), p AS (SELECT *, unnest(range({_PIECES.format(t='t', size=_SIZE)})) AS i FROM c) "
    f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS chunk_index, {_PIECE.format(t='t', size=_SIZE)} AS text, CASE WHEN doc_id % 3 = 0 AND i = 0 THEN '4.2' END AS clause_ref FROM p",
)
def page_chunks(spark, d):
    """Pages cut by size alone, most of them several times, with their leading clause numbers; a source is a document."""
    text = F.trim(F.concat(F.when(F.col("doc_id") % 3 == 0, "4.2 ").otherwise(""), _flat("text")))
    pages = read(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), text.alias("text"))
    found = P.page_chunks(pages, size=_SIZE, overlap=_OVERLAP)
    return found.select(F.col("doc_id").alias("source"), F.col("page_number").alias("doc_id"), "chunk_index", "text", "clause_ref")


_ROW_SIZE = "(700 - length(prefix) - 1)"


@query(
    "q121_document_chunks",
    f"WITH d0 AS (SELECT doc_id // 4 AS doc, doc_id % 4 + 1 AS page, doc_id, {_FLAT.format(x='text')} AS t, '[table on page ' || (doc_id % 4 + 1) || ']' AS prefix FROM documents), "
    f"a AS (SELECT doc, page, 0 AS part, 0 AS row_no, unnest(range({_PIECES.format(t='t', size=_SIZE)})) AS i, t, prefix, NULL AS header FROM d0), "
    "r AS (SELECT doc, page, 1 AS part, n AS row_no, CASE n WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'Work | Amount in lakh' ELSE '1.2 | 17 August' END WHEN 1 THEN 'Road ' || doc_id || ' | 5' WHEN 2 THEN left(t, 900) ELSE 'Last | ' || doc_id END AS rendered, CASE WHEN doc_id % 3 = 0 THEN 'Work | Amount in lakh' END AS header, prefix "
    "FROM d0, range(0, 4) q(n) WHERE doc_id % 2 = 0), s AS (SELECT *, prefix || ' ' || coalesce(header || chr(10), '') || trim(rendered, ' |') AS whole, trim(rendered, ' |') AS one FROM r WHERE trim(rendered, ' |') <> '' AND (header IS NULL OR row_no > 0)), "
    f"b AS (SELECT *, unnest(range(CASE WHEN length(whole) <= 600 THEN 1 ELSE {_PIECES.format(t='one', size=_ROW_SIZE)} END)) AS i FROM s), "
    f"e AS (SELECT doc, page, part, row_no, i, {_PIECE.format(t='t', size=_SIZE)} AS text, NULL AS clause_ref FROM a UNION ALL SELECT doc, page, part, row_no, i, CASE WHEN length(whole) <= 600 THEN whole ELSE prefix || ' ' || {_PIECE.format(t='one', size=_ROW_SIZE)} END, CASE WHEN one = '1.2 | 17 August' THEN '1.2' END FROM b) "
    "SELECT doc, CAST(page AS INT) AS page, row_number() OVER (PARTITION BY doc ORDER BY page, part, row_no, i) - 1 AS chunk_index, text, clause_ref FROM e",
)
def document_chunks(spark, d):
    """Documents of four pages, prose first and then the rows of their tables, on one running index; long rows are cut."""
    k, t = F.col("doc_id"), _flat("text")
    header = F.when(k % 3 == 0, F.array(F.lit("Work"), F.lit("Amount in lakh"))).otherwise(F.array(F.lit("1.2"), F.lit("17 August")))
    rows = F.array(header, F.array(F.concat(F.lit("Road "), k.cast("string")), F.lit("5")), F.array(F.substring(t, 1, 900), F.lit("")), F.array(F.lit("Last"), k.cast("string")))
    pages = read(spark, d, "documents").select(F.floor(k / 4).alias("doc_id"), (k % 4 + 1).cast("int").alias("page_number"), t.alias("text"), F.when(k % 2 == 0, F.array(rows)).alias("tables"))
    found = P.document_chunks(pages, _SIZE, _OVERLAP)
    return found.select(F.col("doc_id").alias("doc"), F.col("page_number").alias("page"), "chunk_index", "text", "clause_ref")


@query(
    "q119_report_stamps",
    "WITH v AS (SELECT user_id AS bid, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'generated' WHEN 'purchase' THEN 'rechecked' END AS kind FROM events), "
    "s AS (SELECT bid, greatest(coalesce(min(ts) FILTER (kind = 'generated'), max(ts) FILTER (kind = 'rechecked')), coalesce(max(ts) FILTER (kind = 'rechecked'), min(ts) FILTER (kind = 'generated'))) AS last FROM v WHERE kind IN ('generated', 'rechecked') GROUP BY bid), "
    "c AS (SELECT user_id % 7 AS tender, event_id, ts FROM events WHERE event_type = 'error') SELECT bid, count(*) AS newer, arg_max(event_id, (c.ts, event_id)) AS newest FROM s JOIN c ON c.tender = bid % 7 AND c.ts > s.last GROUP BY bid",
)
def report_stamps(spark, d):
    """Bids whose report was stamped before a corrigendum of their tender came: reading a report stamps nothing."""
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "generated").when(F.col("event_type") == "purchase", "rechecked")
    stamps = A.report_stamps(e.select(F.col("user_id").alias("bid_id"), F.col("ts").alias("at"), kind.alias("kind")))
    bids = stamps.select((F.col("bid_id") % 7).alias("tender_id"), F.col("bid_id").alias("vendor_id"), "last_report_at")
    corrigenda = e.where("event_type = 'error'").select((F.col("user_id") % 7).alias("tender_id"), F.col("event_id").alias("corrigendum_id"), F.col("ts").alias("created_at"))
    return A.stale(bids, corrigenda).select(F.col("vendor_id").alias("bid"), "newer", "newest")


@query(
    "q120_evidence_findings",
    "WITH f AS (SELECT l_orderkey AS tender_id, CASE l_returnflag WHEN 'N' THEN 'document' ELSE 'criterion' END AS part, l_linenumber AS pos, CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_quantity AS BIGINT) - 2 END AS page, CASE WHEN l_partkey % 6 = 0 THEN ' ' WHEN l_partkey % 6 <> 1 THEN l_linestatus END AS quote FROM lineitem), "
    "d AS (SELECT o_orderkey AS tender_id, CASE WHEN o_orderkey % 9 <> 0 THEN 10 + o_orderkey % 40 ELSE 0 END AS pages FROM orders WHERE o_orderkey % 4 <> 3), j AS (SELECT f.*, pages, part || ' ' || pos AS field, trim(coalesce(quote, '')) = '' AS q FROM f LEFT JOIN d USING (tender_id)) "
    "SELECT tender_id, field, 'error' AS severity, 'cites a page that is not there' AS message FROM j WHERE pages > 0 AND (page < 1 OR page > pages) UNION ALL SELECT tender_id, field, 'warning', CASE WHEN page IS NULL AND q THEN 'no page and no quote' WHEN page IS NULL THEN 'no page' ELSE 'no quote' END FROM j WHERE page IS NULL OR q "
    "UNION ALL SELECT o_orderkey, x.p || 's', 'warning', 'none read' FROM orders, (VALUES ('criterion'), ('document')) x(p) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.tender_id = o_orderkey AND f.part = x.p)",
)
def evidence_findings(spark, d):
    """What the facts of notices rest on: pages that are not there, facts without page or quote, notices without any."""
    li, k = read(spark, d, "lineitem"), F.col("o_orderkey")
    quote = F.when(F.col("l_partkey") % 6 == 0, " ").when(F.col("l_partkey") % 6 != 1, F.col("l_linestatus"))
    facts = li.select(
        F.col("l_orderkey").alias("tender_id"), F.when(F.col("l_returnflag") == "N", "document").otherwise("criterion").alias("part"), F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity").cast("long") - 2).alias("source_page"), quote.alias("snippet"),
    )
    o = read(spark, d, "orders")
    documents = o.where("o_orderkey % 4 <> 3").select(k.alias("tender_id"), F.when(k % 9 != 0, 10 + k % 40).otherwise(0).alias("page_count"))
    return Y.evidence_findings(facts, documents).unionByName(Y.empty_findings(o.select(k.alias("tender_id")), facts))
