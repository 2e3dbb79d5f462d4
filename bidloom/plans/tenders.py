"""Requirement matching, compliance, shortlists and amendments over the driver's tables.

A nation is a tender, its suppliers are the bidders, their shipped revenue by year is the turnover
and their line items are past projects. Thresholds are printed amounts that are read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import names as N
from ..functions import vocabulary as V
from ..operators import amendments as A
from ..operators import compliance as C
from ..operators import requirements as R
from ..operators import shortlist as S
from ..operators.running import running
from .base import NAMES, canonical_sql, distinctive_sql, identifiers_sql, normalised_sql, pick, pick_sql, query, quoted, read, vocabulary_sql

# ------------------------------------------------------------ frames of a tender


def facts(spark, d):
    """``bid_facts`` of every supplier, in its nation's tender."""
    s = read(spark, d, "supplier").select(
        F.col("s_nationkey").cast("long").alias("tender_id"),
        F.col("s_suppkey").alias("vendor_id"),
        F.col("s_name").alias("vendor_name"),
        F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_suppkey") % 12).cast("double")).alias("years_in_business"),
        F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("net_worth_inr"),
        F.lit(None).cast("double").alias("liquid_assets_inr"),
        (F.col("s_suppkey") % 11 == 0).alias("is_blacklisted"),
    )
    items = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("vendor_id"), F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("value_inr"))
    turnover = items.groupBy("vendor_id", "year").agg(F.round(F.sum("value_inr"), 2).alias("amount_inr"))
    home = s.select("vendor_id", "tender_id")
    return C.bid_facts(turnover.join(home, "vendor_id"), items.join(home, "vendor_id"), s)


CRITERIA = [
    (1, "Average annual turnover", "numeric", None, True, "4.1"),
    (2, "Experience in years", "numeric", "years", True, "4.2"),
    (3, "Net worth of the bidder", "numeric", None, False, None),
    (4, "Largest similar work completed", "numeric", None, True, "4.4"),
    (5, "Similar works of capacity", "numeric", "MW", True, "4.5"),
    (6, "Firm shall not be blacklisted", "boolean", None, True, "5.1"),
    (7, "Bidder operates in the state", "boolean", None, True, None),
]


def criteria(spark, d):
    n = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("tender_id"))
    rows = spark.createDataFrame(CRITERIA, "pos int, criterion string, type string, unit string, is_mandatory boolean, clause_ref string")
    k = F.col("tender_id")
    printed = (
        F.when(F.col("pos") == 1, F.concat(F.lit("Rs. "), (20 + k % 40).cast("string"), F.lit(" lakh")))
        .when(F.col("pos") == 2, F.concat((k % 8).cast("string"), F.lit(" (n) years")))
        .when(F.col("pos") == 3, F.when(k % 6 == 0, "as stated").otherwise(F.concat(F.lit("INR "), (1 + k % 7).cast("string"), F.lit(",000"))))
        .when(F.col("pos") == 4, F.concat(F.lit("₹"), F.format_string("%.2f", 0.85 + (k % 5) / 100.0), F.lit(" lakh")))
        .when(F.col("pos") == 5, F.concat((k % 20).cast("string"), F.lit(" MW")))
    )
    rows = n.join(F.broadcast(rows)).withColumn("threshold_raw", printed)
    t = M.threshold(F.col("threshold_raw"), F.col("unit"), F.lit(None).cast("decimal(18,2)"))
    return rows.withColumn("t", t).select("*", F.col("t.amount").alias("threshold_amount_inr"), F.col("t.number").alias("threshold_number")).drop("t")


def items(spark, d):
    c, f = criteria(spark, d), facts(spark, d)
    columns = ["tender_id", "vendor_id", "block", "pos", "criterion", "kind", "status", "severity", "required_value", "found_value", "explanation", "is_mandatory", "clause_ref"]
    return C.numeric_items(c, f).select(*columns).unionByName(C.boolean_items(c, f).select(*columns)).withColumnRenamed("criterion", "requirement")


def _inr_sql(x: str) -> str:
    trim = "regexp_replace(regexp_replace(CAST(CAST(round_even({}, 3) AS DECIMAL(24,3)) AS VARCHAR), '0+$', ''), '[.]$', '')"
    a = f"CAST({x} AS DECIMAL(24,6))"
    return f"CASE WHEN {x} >= 10000000 THEN '₹' || {trim.format(f'CAST({a} / 10000000 AS DECIMAL(24,9))')} || ' Cr' WHEN {x} >= 100000 THEN '₹' || {trim.format(f'CAST({a} / 100000 AS DECIMAL(24,9))')} || ' Lakh' ELSE '₹' || {trim.format(a)} END"


ITEMS_SQL = rf"""
tv AS (SELECT l_suppkey, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS a FROM lineitem GROUP BY ALL),
bt AS (SELECT l_suppkey, max(a) AS best_turnover FROM tv GROUP BY ALL),
pj AS (SELECT l_suppkey, max(l_extendedprice) AS largest FROM lineitem GROUP BY ALL),
f AS (SELECT CAST(s_nationkey AS BIGINT) AS tender_id, s_suppkey AS vendor_id, s_name AS vendor_name, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey % 12 AS DOUBLE) END AS years,
      CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS worth, s_suppkey % 11 = 0 AS barred, best_turnover, largest
      FROM supplier LEFT JOIN bt ON s_suppkey = bt.l_suppkey LEFT JOIN pj ON s_suppkey = pj.l_suppkey),
c AS (
  SELECT CAST(n_nationkey AS BIGINT) AS tender_id, 1 AS pos, 'Average annual turnover' AS requirement, 'numeric' AS kind, 'turnover' AS fact, (20 + n_nationkey % 40) * 100000.0 AS amount, NULL::DOUBLE AS number, true AS is_mandatory, '4.1' AS clause_ref FROM nation
  UNION ALL SELECT n_nationkey, 2, 'Experience in years', 'numeric', 'experience', NULL, n_nationkey % 8, true, '4.2' FROM nation
  UNION ALL SELECT n_nationkey, 3, 'Net worth of the bidder', 'numeric', 'net worth', CASE WHEN n_nationkey % 6 <> 0 THEN (1 + n_nationkey % 7) * 1000.0 END, NULL, false, NULL FROM nation
  UNION ALL SELECT n_nationkey, 4, 'Largest similar work completed', 'numeric', 'project value', (85 + n_nationkey % 5) * 1000.0, NULL, true, '4.4' FROM nation
  UNION ALL SELECT n_nationkey, 5, 'Similar works of capacity', 'numeric', NULL, NULL, n_nationkey % 20, true, '4.5' FROM nation
  UNION ALL SELECT n_nationkey, 6, 'Firm shall not be blacklisted', 'boolean', NULL, NULL, NULL, true, '5.1' FROM nation
  UNION ALL SELECT n_nationkey, 7, 'Bidder operates in the state', 'boolean', NULL, NULL, NULL, true, NULL FROM nation),
j AS (SELECT c.*, f.vendor_id, f.vendor_name, f.barred, coalesce(amount, number) AS floor_,
      CASE fact WHEN 'turnover' THEN best_turnover WHEN 'experience' THEN years WHEN 'net worth' THEN worth WHEN 'project value' THEN largest END AS held FROM c JOIN f USING (tender_id)),
st AS (SELECT *, CASE WHEN kind = 'boolean' THEN CASE WHEN pos = 6 AND barred THEN 'missing' ELSE 'manual_check' END WHEN floor_ IS NULL THEN 'not_assessable' WHEN fact IS NULL THEN 'manual_check'
       WHEN held IS NULL THEN 'not_assessable' WHEN held >= floor_ THEN 'match' ELSE 'missing' END AS status FROM j),
sv AS (SELECT *, CASE status WHEN 'match' THEN 'info' WHEN 'missing' THEN CASE WHEN is_mandatory THEN 'disqualifying' ELSE 'review' END ELSE 'review' END AS severity,
       CASE WHEN kind = 'boolean' THEN CASE WHEN pos = 6 THEN 'Not blacklisted or debarred' ELSE 'Yes' END WHEN amount IS NOT NULL THEN {_inr_sql('amount')} ELSE regexp_replace(CAST(round(floor_, 2) AS VARCHAR), '[.]0$', '') END AS required_value,
       CASE WHEN kind = 'boolean' THEN CASE WHEN pos = 6 THEN CASE WHEN barred THEN 'Flagged as blacklisted' ELSE 'No blacklist flag recorded' END END WHEN held IS NULL OR floor_ IS NULL THEN NULL WHEN amount IS NOT NULL THEN {_inr_sql('held')} ELSE regexp_replace(CAST(round(held, 2) AS VARCHAR), '[.]0$', '') END AS found_value FROM st),
it AS (SELECT *, CASE WHEN kind = 'boolean' THEN CASE WHEN status = 'missing' THEN 'The bidder is flagged as blacklisted or debarred, which disqualifies.' ELSE 'A person has to check this condition.' END
       WHEN status = 'match' THEN 'Your ' || fact || ' of ' || found_value || ' meets the requirement of ' || required_value || '.'
       WHEN status = 'missing' THEN 'Your ' || fact || ' is ' || found_value || ', below the required ' || required_value || '.'
       WHEN status = 'manual_check' THEN 'No figure of the bid can be compared with this requirement; check it yourself.'
       ELSE 'The figure could not be read; that is not the same as failing it.' END AS explanation FROM sv)"""


@query("q13_gap_items", f"WITH {ITEMS_SQL} SELECT tender_id, vendor_id, pos, requirement, kind, status, severity, required_value, found_value, explanation FROM it")
def gap_items(spark, d):
    """Every criterion of every tender against every bid."""
    return items(spark, d).select("tender_id", "vendor_id", "pos", "requirement", "kind", "status", "severity", "required_value", "found_value", "explanation")


@query(
    "q12_elimination",
    f"WITH {ITEMS_SQL}, b AS (SELECT tender_id, vendor_id, string_agg('Clause ' || coalesce(clause_ref, '?') || ': ' || explanation, '; ' ORDER BY pos) AS reason, min_by(clause_ref, pos) AS clause_ref, count(*) AS n FROM it WHERE severity = 'disqualifying' GROUP BY ALL) "
    "SELECT tender_id, vendor_id, CASE WHEN n > 0 THEN 'eliminated' ELSE 'pending' END AS status, CASE WHEN n > 0 THEN 'criteria' END AS ground, reason, clause_ref FROM (SELECT DISTINCT tender_id, vendor_id FROM it) LEFT JOIN b USING (tender_id, vendor_id)",
)
def elimination(spark, d):
    """Which bids are eliminated, on which ground, with every reason and its clause."""
    return C.eliminations(items(spark, d), ["tender_id", "vendor_id"])


@query(
    "q14_verdicts",
    f"WITH {ITEMS_SQL} SELECT tender_id, vendor_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS n_{s}" for s in V.CHECK_STATUS) + ", count(*) FILTER (is_mandatory) AS mandatory, count(*) FILTER (is_mandatory AND status = 'match') AS satisfied, "
    "count(*) FILTER (is_mandatory AND status IN ('manual_check', 'not_assessable', 'partial')) AS undetermined, count(*) FILTER (severity = 'disqualifying') AS blockers, "
    "CASE WHEN bool_or(severity = 'disqualifying') THEN 'not_compliant' WHEN bool_or(status IN ('manual_check', 'not_assessable')) THEN 'needs_review' ELSE 'compliant' END AS verdict FROM it GROUP BY ALL",
)
def verdicts(spark, d):
    """Counts by status, completion and verdict of every bid."""
    return C.verdicts(items(spark, d), ["tender_id", "vendor_id"])


@query(
    "q15_actions",
    f"WITH {ITEMS_SQL}, g AS (SELECT *, CASE WHEN status = 'not_assessable' THEN 'clarify' WHEN status IN ('manual_check', 'partial') THEN 'verify' ELSE 'hard_fail' END AS action_group FROM it WHERE status <> 'match') "
    "SELECT tender_id, vendor_id, requirement, action_group, row_number() OVER (PARTITION BY tender_id, vendor_id ORDER BY list_position(['disqualifying', 'action_needed', 'review', 'info'], severity), list_position(['hard_fail', 'upload', 'clarify', 'verify'], action_group), pos) AS place FROM g",
)
def actions(spark, d):
    """What each vendor has to do, in order."""
    from pyspark.sql import Window

    a = C.actions(items(spark, d))
    order = Window.partitionBy("tender_id", "vendor_id").orderBy("action_rank")
    return a.select("tender_id", "vendor_id", "requirement", "action_group", F.row_number().over(order).cast("long").alias("place"))


@query(
    "q20_pool_facts",
    f"WITH {ITEMS_SQL} SELECT tender_id, row_number() OVER (PARTITION BY tender_id ORDER BY vendor_id) AS place, vendor_name || ': experience ' || CASE WHEN years IS NULL THEN 'not stated' ELSE CAST(CAST(years AS BIGINT) AS VARCHAR) || ' years' END || CASE WHEN largest IS NULL THEN '' ELSE ', largest recorded project ' || {_inr_sql('largest')} END AS answer FROM f",
)
def pool_facts(spark, d):
    """One sentence of facts per vendor, a row each with its place in the tender's answer."""
    f = facts(spark, d)
    years = F.when(F.col("years_in_business").isNull(), "not stated").otherwise(F.concat(F.col("years_in_business").cast("long").cast("string"), F.lit(" years")))
    text = F.concat(F.col("vendor_name"), F.lit(": experience "), years, F.coalesce(F.concat(F.lit(", largest recorded project "), M.format_inr(F.col("largest_project"))), F.lit("")))
    rows = running(f.select("tender_id", "vendor_id", text.alias("answer")), ["tender_id"], ["vendor_id"], {"place": F.lit(1)})
    return rows.select("tender_id", F.col("place").cast("long").alias("place"), "answer")


# ------------------------------------------------------------ documents


def _required(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_brand").alias("tender_id"), F.col("p_partkey").alias("pos"), pick(NAMES, F.col("p_partkey") + F.floor(F.col("p_partkey") / 30).cast("long")).alias("doc_name"), F.array().cast("array<string>").alias("aliases"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("c."), F.col("p_size").cast("string"))).alias("clause_ref"))


_REQ = f"rq AS (SELECT p_brand AS tender_id, p_partkey AS pos, {pick_sql(NAMES, 'p_partkey + p_partkey // 30')} AS doc_name, CASE WHEN p_size % 2 = 0 THEN 'c.' || p_size END AS clause_ref FROM part)"
_STRIP = f"regexp_replace(regexp_replace(trim(doc_name), {quoted(N.LEADING)}, ''), {quoted(N.TRAILING)}, '', 'g')"
_KEY = (
    f"k0 AS (SELECT *, {_STRIP} AS stripped FROM rq), k1 AS (SELECT *, {normalised_sql('stripped')} AS n FROM k0), "
    f"k2 AS (SELECT *, coalesce({canonical_sql('n')}, array_to_string(regexp_extract_all(n, '[a-z0-9]+')[1:8], ' ')) || array_to_string(list_transform({identifiers_sql('doc_name')}, lambda i: ' | ' || i), '') AS key FROM k1)"
)


@query(
    "q10_dedup_requirements",
    f"WITH {_REQ}, {_KEY} SELECT tender_id, key, min(pos) AS pos, arg_min(doc_name, (clause_ref IS NULL, length(doc_name), pos)) AS primary, arg_min(coalesce(clause_ref, '-'), (clause_ref IS NULL, length(doc_name), pos)) AS clause_ref, count(*) AS statements, array_to_string(list_sort(list(DISTINCT doc_name)), '; ') AS aliases FROM k2 GROUP BY tender_id, key",
)
def dedup_requirements(spark, d):
    """Requirements of each tender, restatements merged."""
    r = R.deduplicate(_required(spark, d))
    return r.select("tender_id", "key", "pos", "primary", F.coalesce("clause_ref", F.lit("-")).alias("clause_ref"), "statements", F.array_join("aliases", "; ").alias("aliases"))


def _offered(spark, d):
    p = read(spark, d, "part")
    return p.select(F.col("p_brand").alias("tender_id"), F.col("p_partkey").alias("pos"), pick(NAMES, F.col("p_partkey") * 7 + 3).alias("name"))


_OFF = f"of_ AS (SELECT p_brand AS tender_id, p_partkey AS pos, {pick_sql(NAMES, 'p_partkey * 7 + 3')} AS name FROM part)"
_DIFF = "list_concat(list_filter(a.ids, lambda e: NOT list_contains(b.ids, e)), list_filter(b.ids, lambda e: NOT list_contains(a.ids, e)))"
_BOTH = "list_intersect(list_transform(a.ids, lambda f: split_part(f, ':', 1)), list_transform(b.ids, lambda f: split_part(f, ':', 1)))"


@query(
    "q09_match_documents",
    f"WITH {_REQ}, {_OFF}, a0 AS (SELECT tender_id, pos, doc_name AS name, {normalised_sql('doc_name')} AS n, {identifiers_sql('doc_name')} AS ids FROM rq), a1 AS (SELECT *, {canonical_sql('n')} AS c, {vocabulary_sql('n')} AS w FROM a0), a AS (SELECT *, {distinctive_sql('w')} AS t FROM a1), "
    f"b0 AS (SELECT tender_id, pos, name, {normalised_sql('name')} AS n, {identifiers_sql('name')} AS ids FROM of_), b1 AS (SELECT *, {canonical_sql('n')} AS c, {vocabulary_sql('n')} AS w FROM b0), b AS (SELECT *, {distinctive_sql('w')} AS t FROM b1), "
    f"p AS (SELECT a.tender_id, a.pos AS key, b.pos AS pos, b.name, a.ids AS x, b.ids AS y, a.w = b.w AS same, len(list_intersect(a.t, b.t)) AS shared, least(len(a.t), len(b.t)) AS least_, a.n = b.n AS e, a.c = b.c AS al, len(a.t) AS na, len(b.t) AS nb FROM a JOIN b USING (tender_id) WHERE len(list_filter({_DIFF}, lambda e: list_contains({_BOTH}, split_part(e, ':', 1)))) = 0), "
    "q AS (SELECT *, CASE WHEN e THEN 1 WHEN al THEN 2 WHEN na > 0 AND (same OR (least_ > 0 AND shared >= 0.8 * least_ AND (shared >= 2 OR (shared > 0 AND na = nb AND shared = na)))) THEN 3 END AS tier FROM p), "
    "r AS (SELECT *, CASE WHEN tier < 3 OR same THEN 1.0 ELSE round(shared / least_, 4) END AS score, row_number() OVER (PARTITION BY tender_id, key ORDER BY tier, pos) AS rn FROM q WHERE tier IS NOT NULL), "
    "s AS (SELECT *, len(list_filter(x, lambda e: NOT list_contains(y, e))) = 0 AS sure FROM r WHERE rn = 1) "
    "SELECT rq.tender_id, rq.pos AS key, CASE WHEN sure THEN (['exact', 'alias', 'lexical'])[tier] END AS method, CAST(score AS DOUBLE) AS score, coalesce(sure, false) AS matched, s.name FROM rq LEFT JOIN s ON rq.tender_id = s.tender_id AND rq.pos = s.key",
)
def match_documents(spark, d):
    """The best enclosure for each requirement, by tiers, and whether it is confirmed."""
    r = _required(spark, d).select("tender_id", F.col("pos").alias("key"), F.col("doc_name").alias("label"), "aliases")
    return R.match_documents(r, _offered(spark, d), ["tender_id"])


@query(
    "q25_present_documents",
    f"WITH e AS (SELECT p_brand, {pick_sql(NAMES, 'p_partkey * 3')} AS name, p_size % 4 <> 0 AS present FROM part), k AS (SELECT *, {normalised_sql('name')} AS n0 FROM e), n AS (SELECT *, coalesce({canonical_sql('n0')}, n0) AS n FROM k) "
    "SELECT DISTINCT p_brand, name FROM n WHERE present AND NOT EXISTS (SELECT 1 FROM n x WHERE x.p_brand = n.p_brand AND x.n = n.n AND NOT x.present)",
)
def present_documents(spark, d):
    """Names that a bid encloses and nowhere marks as absent."""
    p = read(spark, d, "part").select("p_brand", "p_partkey", pick(NAMES, F.col("p_partkey") * 3).alias("name"), (F.col("p_size") % 4 != 0).alias("present"))
    return R.present_documents(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), ["p_brand"])


# ------------------------------------------------------------ shortlist


def _pool(spark, d):
    f = facts(spark, d).join(read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("tender_id"), F.col("n_regionkey").alias("pool")), "tender_id")
    return f.select(
        "pool", "vendor_id", F.col("years_in_business").alias("experience"), F.floor(F.col("largest_project") / 10000).alias("project_scale"), (F.col("vendor_id") % 2).cast("double").alias("technical_approach"),
        F.when(F.col("vendor_id") % 4 != 0, F.floor(F.coalesce("net_worth_inr", F.lit(5000.0)) / 1000)).alias("pricing"),
    )


_POOL = f"{ITEMS_SQL}, po AS (SELECT n_regionkey AS pool, vendor_id, years AS experience, CAST(floor(largest / 10000) AS BIGINT) AS project_scale, CAST(vendor_id % 2 AS DOUBLE) AS technical_approach, CASE WHEN vendor_id % 4 <> 0 THEN CAST(floor(coalesce(worth, 5000.0) / 1000) AS BIGINT) END AS pricing FROM f JOIN nation ON n_nationkey = tender_id)"


def _rank_sql(c: str, low: bool = False) -> str:
    place = f"(dense_rank() OVER (PARTITION BY pool, {c} IS NULL ORDER BY {c}) - 1)"
    last = f"((SELECT count(DISTINCT z.{c}) FROM po z WHERE z.pool = po.pool) - 1)"
    scaled = f"CAST({place} AS DOUBLE) / nullif({last}, 0)"
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {last} = 0 THEN 1.0 ELSE {'1 - ' if low else ''}{scaled} END"


@query("q16_rank_normalise", f"WITH {_POOL} SELECT pool, vendor_id, round({_rank_sql('experience')}, 6) AS up, round({_rank_sql('pricing', True)}, 6) AS down FROM po")
def rank_normalise(spark, d):
    """Experience (more is better) and price (less is better) as ranks in [0, 1] within a region."""
    p = _pool(spark, d)
    up = S.rank_normalise(p, ["pool"], "experience").withColumnRenamed("signal", "up")
    down = S.rank_normalise(p, ["pool"], "pricing", True).withColumnRenamed("signal", "down")
    out = p.join(up, ["pool", "experience"], "left").join(down, ["pool", "pricing"], "left")
    return out.select("pool", "vendor_id", F.round("up", 6).alias("up"), F.round("down", 6).alias("down"))


WEIGHTS = {"experience": 2.0, "project_scale": 1.0, "pricing": 1.0}


@query(
    "q17_shortlist",
    f"WITH {_POOL}, sg AS (SELECT pool, vendor_id, {_rank_sql('experience')} AS a, {_rank_sql('project_scale')} AS b, {_rank_sql('pricing', True)} AS c FROM po), "
    "sc AS (SELECT *, round((coalesce(2 * a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CASE WHEN a IS NULL THEN 0 ELSE 2 END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END, 0), 9) AS s FROM sg), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY s DESC NULLS LAST, vendor_id) AS n, rank() OVER (PARTITION BY pool ORDER BY s DESC NULLS LAST) AS r FROM sc), "
    "ct AS (SELECT pool, max(s) FILTER (n = 5) AS cut FROM rk GROUP BY pool), kp AS (SELECT rk.*, cut FROM rk JOIN ct USING (pool) WHERE n <= 5 OR (s IS NOT NULL AND r <= 5)), mo AS (SELECT pool, max(n) > 5 AS more FROM kp GROUP BY pool) "
    "SELECT pool, vendor_id, round(s, 6) AS score, coalesce(more AND s = cut, false) AS tied_at_cutoff FROM kp JOIN mo USING (pool)",
)
def shortlist(spark, d):
    """The best five of each region and those that tie with the fifth."""
    scored = S.score(_pool(spark, d), WEIGHTS, ["pool"])
    return S.shortlist(scored, 5, ["pool"]).select("pool", "vendor_id", F.round("score", 6).alias("score"), "tied_at_cutoff")


@query(
    "q18_project_value",
    "SELECT l_suppkey AS vendor_id, count(*) AS projects, count(*) FILTER (l_extendedprice >= 50000) AS reaching, max(l_extendedprice) AS largest, arg_max(l_orderkey * 10 + l_linenumber, (l_extendedprice, -(l_orderkey * 10 + l_linenumber))) AS largest_id FROM lineitem GROUP BY ALL",
)
def project_value(spark, d):
    """Past projects of each vendor: how many, how many reach a value, and the largest."""
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("vendor_id")).agg(
        F.count("*").alias("projects"), F.count_if(F.col("l_extendedprice") >= 50000).alias("reaching"), F.max("l_extendedprice").alias("largest"), F.max_by(line, F.struct("l_extendedprice", -line)).alias("largest_id")
    )


@query(
    "q19_turnover_merge",
    "WITH r AS (SELECT o_custkey, year(o_orderdate) AS year, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE floor(o_totalprice / 250000) END AS inr FROM orders) "
    "SELECT o_custkey, year, CASE WHEN count(DISTINCT coalesce(inr, -1)) = 1 THEN max(inr) END AS inr, count(DISTINCT coalesce(inr, -1)) > 1 AS conflicting, count(*) AS statements FROM r GROUP BY ALL",
)
def turnover_merge(spark, d):
    """One figure per customer and year; statements that differ, or are unreadable, are unresolved."""
    r = read(spark, d, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("year"), F.when(F.col("o_orderkey") % 13 != 0, F.floor(F.col("o_totalprice") / 250000).cast("double")).alias("inr"))
    kinds = F.count_distinct(F.coalesce("inr", F.lit(-1.0)))
    return r.groupBy("o_custkey", "year").agg(F.when(kinds == 1, F.max("inr")).alias("inr"), (kinds > 1).alias("conflicting"), F.count("*").alias("statements"))


# ------------------------------------------------------------ amendments

SUBJECT_TEXTS = ["Last date of bid submission", "Pre-bid meeting query date", "EMD amount", "Estimated cost put to tender", "Average annual turnover", "Similar work experience", "Annexure II form", "Site visit"]
NEW_TEXTS = ["15.03.2025", "Rs. 2 Lakh", "7 years", "", "1 April 2025"]


@query(
    "q27_amendment_diff",
    f"WITH s AS (SELECT o_orderkey, {pick_sql(SUBJECT_TEXTS, 'o_orderkey')} AS subject, {pick_sql(NEW_TEXTS, 'o_orderkey // 8')} AS nv FROM orders), "
    "v AS (SELECT *, nv IN ('15.03.2025', '1 April 2025') AS is_date, nv <> '' AS is_amount FROM s), "
    "p AS (SELECT *, CASE subject WHEN 'Last date of bid submission' THEN CASE WHEN is_date THEN 'submission_deadline' ELSE 'unmapped' END WHEN 'Pre-bid meeting query date' THEN CASE WHEN is_date THEN 'pre_bid_query_deadline' ELSE 'unmapped' END "
    "WHEN 'EMD amount' THEN CASE WHEN is_amount THEN 'emd_amount' ELSE 'unmapped' END WHEN 'Estimated cost put to tender' THEN CASE WHEN is_amount THEN 'contract_value_estimate' ELSE 'unmapped' END WHEN 'Average annual turnover' THEN 'eligibility_criteria.turnover' "
    "WHEN 'Similar work experience' THEN 'eligibility_criteria.experience' WHEN 'Annexure II form' THEN 'mandatory_documents' ELSE 'unmapped' END AS path FROM v), "
    "h AS (SELECT o_orderkey, 'emd_amount' AS field_path, 'Rs. 2,00,000' AS old_value, CASE WHEN o_orderkey % 3 = 0 THEN 'Rs. 2 Lakh' ELSE 'Rs. 3 Lakh' END AS new_value FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) "
    "SELECT o_orderkey, field_path, old_value, new_value FROM h UNION ALL SELECT p.o_orderkey, CASE WHEN path = 'unmapped' THEN 'unmapped:' || subject ELSE path END, 'old', nv FROM p WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.o_orderkey = p.o_orderkey AND h.field_path = p.path)",
)
def amendment_diff(spark, d):
    """Changes of each corrigendum: restated fields, then stated changes of other fields."""
    o = read(spark, d, "orders")
    none = F.lit(None).cast("string")
    key = F.col("o_orderkey")
    parents = o.select(key.alias("tender_id"), none.alias("submission_deadline"), none.alias("pre_bid_query_deadline"), F.lit("Rs. 2,00,000").alias("emd_amount"), none.alias("contract_value_estimate"))
    headers = o.where(key % 2 == 0).select(
        key.alias("tender_id"), key.alias("corrigendum_id"), none.alias("submission_deadline"), none.alias("pre_bid_query_deadline"), F.when(key % 3 == 0, "Rs. 2 Lakh").otherwise("Rs. 3 Lakh").alias("emd_amount"), none.alias("contract_value_estimate")
    )
    stated = o.select(key.alias("corrigendum_id"), key.alias("tender_id"), pick(SUBJECT_TEXTS, key).alias("subject"), F.lit("old").alias("old_value"), pick(NEW_TEXTS, F.floor(key / 8).cast("long")).alias("new_value"))
    out = A.diff(A.restated(parents, headers), stated)
    return out.select(F.col("corrigendum_id").alias("o_orderkey"), "field_path", "old_value", "new_value")


def _changes(spark, d):
    n = read(spark, d, "nation")
    k = F.col("n_nationkey").cast("long")
    return n.select(
        k.alias("tender_id"), k.alias("change_id"), F.when(k % 6 == 5, "submission_deadline").otherwise("eligibility_criteria[0].threshold_amount").alias("field_path"),
        F.when(k % 6 == 0, "4.1").when(k % 6 == 4, "9.9").alias("clause_ref"),
        F.when(k % 6 == 1, F.concat(F.lit("rs. "), (20 + k % 40).cast("string"), F.lit("  LAKH"))).when(k % 6 == 2, "r").alias("old_value"),
        F.when(k % 6 == 3, "").when(k % 12 == 0, "no amount").otherwise(F.concat(F.lit("Rs. "), (40 + k).cast("string"), F.lit(" lakh"))).alias("new_value"),
    )


_OUTCOME = (
    "chg AS (SELECT CAST(n_nationkey AS BIGINT) AS tender_id, n_nationkey % 6 <> 5 AS known, CASE n_nationkey % 6 WHEN 0 THEN '4.1' WHEN 4 THEN '9.9' ELSE '' END AS clause, "
    "CASE n_nationkey % 6 WHEN 1 THEN 'rs. ' || (20 + n_nationkey % 40) || ' lakh' WHEN 2 THEN 'r' ELSE '' END AS old_value, CASE WHEN n_nationkey % 6 = 3 THEN '' WHEN n_nationkey % 12 = 0 THEN 'no amount' ELSE 'Rs. ' || (40 + n_nationkey) || ' lakh' END AS new_value FROM nation), "
    "crt AS (SELECT tender_id, pos, lower(requirement) AS name, coalesce(clause_ref, '') AS own, CASE pos WHEN 1 THEN 'rs. ' || (20 + tender_id % 40) || ' lakh' WHEN 2 THEN (tender_id % 8) || ' (n) years' "
    "WHEN 3 THEN CASE WHEN tender_id % 6 = 0 THEN 'as stated' ELSE 'inr ' || (1 + tender_id % 7) || ',000' END WHEN 4 THEN printf('₹%.2f lakh', 0.85 + (tender_id % 5) / 100.0) WHEN 5 THEN (tender_id % 20) || ' mw' ELSE '' END AS printed FROM c), "
    "hit AS (SELECT tender_id, pos, CASE WHEN clause <> '' AND own = clause THEN 0 WHEN old_value <> '' AND (printed = old_value OR contains(name, old_value)) THEN 1 END AS how FROM chg JOIN crt USING (tender_id) WHERE known), "
    "best AS (SELECT tender_id, min(how) AS how FROM hit WHERE how IS NOT NULL GROUP BY tender_id), cnt AS (SELECT tender_id, count(*) AS candidates, min(pos) AS pos FROM hit JOIN best USING (tender_id, how) GROUP BY tender_id), "
    "chx AS (SELECT tender_id, coalesce(candidates, 0) AS candidates, pos, new_value, CASE WHEN NOT known THEN 'unsupported' WHEN coalesce(candidates, 0) = 0 THEN 'conflict' WHEN candidates > 1 THEN 'ambiguous' WHEN new_value = '' OR regexp_matches(new_value, '[0-9]') THEN 'applied' ELSE 'unsupported' END AS outcome FROM chg LEFT JOIN cnt USING (tender_id)), "
    "ch AS (SELECT *, outcome = 'applied' AND new_value = '' AS withdrawn, CASE WHEN outcome = 'applied' AND new_value <> '' THEN CAST(regexp_extract(new_value, '[0-9]+') AS DOUBLE) * 100000.0 END AS new_threshold FROM chx)"
)


def _outcomes(spark, d):
    c = criteria(spark, d).withColumn("criterion_id", F.col("tender_id") * 10 + F.col("pos"))
    return A.criterion_changes(_changes(spark, d), c), c


@query("q28_amendment_outcomes", f"WITH {ITEMS_SQL}, {_OUTCOME} SELECT tender_id, outcome, CAST(candidates AS BIGINT) AS candidates, new_threshold FROM ch")
def amendment_outcomes(spark, d):
    """Whether each change applies, conflicts, is ambiguous or not supported."""
    out, _ = _outcomes(spark, d)
    return out.select("tender_id", "outcome", "candidates", "new_threshold")


@query(
    "q29_amendment_impact",
    f"WITH {ITEMS_SQL}, {_OUTCOME}, t AS (SELECT tender_id, vendor_id, coalesce(best_turnover < (20 + tender_id % 40) * 100000.0, false) AS was, coalesce(best_turnover < coalesce(CASE WHEN pos = 1 THEN new_threshold END, (20 + tender_id % 40) * 100000.0) AND NOT (withdrawn AND pos = 1), false) AS is_ FROM f JOIN ch USING (tender_id)) "
    "SELECT tender_id, vendor_id, CASE WHEN was AND NOT is_ THEN 'reinstated' WHEN is_ AND NOT was THEN 'newly_eliminated' ELSE 'unchanged' END AS direction, tender_id % 2 = 0 AND is_ AND NOT was AS needs_review FROM t",
)
def amendment_impact(spark, d):
    """Turnover decisions before and after the applied amendments."""
    outcomes, c = _outcomes(spark, d)
    turnover = c.where("pos = 1").withColumn("threshold", F.col("threshold_amount_inr").cast("double"))
    after = A.apply_thresholds(turnover.select("criterion_id", "tender_id", "threshold", "is_mandatory", "clause_ref"), outcomes)
    f = facts(spark, d).select("tender_id", "vendor_id", "best_turnover")

    def decided(rules):
        out = F.coalesce((F.col("best_turnover") < F.col("threshold")) & F.col("is_mandatory"), F.lit(False))
        return f.join(rules, "tender_id").select("tender_id", "vendor_id", F.when(out, "eliminated").otherwise("pending").alias("status"), F.when(out, F.col("clause_ref")).alias("clause_ref"))

    changed = A.impact(decided(turnover), decided(after), ["tender_id", "vendor_id"])
    late = A.needs_review(F.when(F.col("tender_id") % 2 == 0, F.to_date(F.lit("2025-02-01"))), F.to_date(F.lit("2025-01-01")), F.col("direction") == "newly_eliminated")
    return changed.select("tender_id", "vendor_id", "direction", late.alias("needs_review"))


@query(
    "q30_staleness",
    "WITH l AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS last_report_at FROM events GROUP BY user_id), c AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup') "
    "SELECT l.user_id AS tender_id, count(*) AS newer, arg_max(event_id, (ts, event_id)) AS newest FROM l JOIN c ON l.user_id = c.user_id AND c.ts > l.last_report_at GROUP BY ALL",
)
def staleness(spark, d):
    """Reports older than a later corrigendum, with the newest one."""
    e = read(spark, d, "events")
    bids = e.groupBy(F.col("user_id").alias("tender_id")).agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("last_report_at")).withColumn("vendor_id", F.col("tender_id"))
    c = e.where("event_type = 'signup'").select(F.col("user_id").alias("tender_id"), F.col("event_id").alias("corrigendum_id"), F.col("ts").alias("created_at"))
    return A.stale(bids, c).select("tender_id", "newer", "newest")


@query(
    "q59_committee",
    f"WITH {ITEMS_SQL}, b AS (SELECT tender_id, vendor_id, min_by('Clause ' || coalesce(clause_ref, '?') || ': ' || explanation, pos) AS first FROM it WHERE severity = 'disqualifying' GROUP BY ALL), x AS (SELECT tender_id, vendor_id, vendor_name, CASE WHEN first IS NULL THEN 'pending' ELSE 'eliminated' END AS status, coalesce(first, 'Awaiting evaluation') AS reason FROM f LEFT JOIN b USING (tender_id, vendor_id)) "
    "SELECT tender_id, vendor_name, status, reason, row_number() OVER (PARTITION BY tender_id ORDER BY status, lower(vendor_name)) AS place FROM x",
)
def committee(spark, d):
    """The committee's list: by status and name, with the first reason."""
    from pyspark.sql import Window

    e = C.eliminations(items(spark, d), ["tender_id", "vendor_id"]).join(facts(spark, d).select("tender_id", "vendor_id", "vendor_name"), ["tender_id", "vendor_id"])
    order = Window.partitionBy("tender_id").orderBy("status", F.lower("vendor_name"))
    reason = F.coalesce(F.substring_index("reason", "; ", 1), F.lit("Awaiting evaluation"))
    return e.select("tender_id", "vendor_name", "status", reason.alias("reason"), F.row_number().over(order).cast("long").alias("place"))
