"""Scalar operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import names as N
from ..functions import questions as Q
from ..functions import vocabulary as V
from .base import NAMES, any_word_sql, canonical_sql, distinctive_sql, identifiers_sql, money_ctes, normalised_sql, pick, pick_sql, query, quoted, read, vocabulary_sql

AMOUNT_FORMS = ["Rs. ", "INR ", "₹", "at least 2 works of Rs. ", "EMD @ 2% of value, Rs. "]
UNIT_FORMS = [" only", " Cr", " lakh", " crores each", " Lacs/-", "% of the ECV", " per cent", ""]


def _amount_text():
    k = F.col("o_orderkey")
    figure = F.format_string("%d.%02d", F.floor(F.col("o_totalprice") / 1000).cast("long"), F.pmod(k, F.lit(100)))
    return F.concat(pick(AMOUNT_FORMS, k), figure, pick(UNIT_FORMS, F.floor(k / 5).cast("long")))


_AMOUNT_SQL = (
    f"{pick_sql(AMOUNT_FORMS, 'o_orderkey')} || printf('%d.%02d', CAST(floor(o_totalprice / 1000) AS BIGINT), o_orderkey % 100) || {pick_sql(UNIT_FORMS, 'o_orderkey // 5')}"
)


@query("q01_money_normalise", f"WITH s AS (SELECT o_orderkey, {_AMOUNT_SQL} AS txt FROM orders), {money_ctes('s', 'o_orderkey')} SELECT o_orderkey, txt, round(inr, 2) AS inr FROM m3")
def money_normalise(spark, d):
    """Rupees of printed amounts in several notations."""
    rows = read(spark, d, "orders").select("o_orderkey", _amount_text().alias("txt"))
    return rows.select("o_orderkey", "txt", F.round(M.money_inr(F.col("txt")).cast("double"), 2).alias("inr"))


_TRIM3 = "regexp_replace(regexp_replace(CAST(CAST(round_even({x}, 3) AS DECIMAL(24,3)) AS VARCHAR), '0+$', ''), '[.]$', '')"


@query(
    "q02_format_inr",
    "WITH s AS (SELECT o_orderkey, CAST(CAST(o_totalprice * ([1, 10, 100, 1000])[1 + o_orderkey % 4] AS DECIMAL(18,2)) AS DECIMAL(24,6)) AS a FROM orders) "
    f"SELECT o_orderkey, CASE WHEN a >= 10000000 THEN '₹' || {_TRIM3.format(x='CAST(a / 10000000 AS DECIMAL(24,9))')} || ' Cr' "
    f"WHEN a >= 100000 THEN '₹' || {_TRIM3.format(x='CAST(a / 100000 AS DECIMAL(24,9))')} || ' Lakh' ELSE '₹' || {_TRIM3.format(x='a')} END AS shown FROM s",
)
def format_inr(spark, d):
    """Amounts as crores, lakhs or rupees."""
    scale = F.element_at(F.array(*(F.lit(x) for x in (1, 10, 100, 1000))), (F.pmod("o_orderkey", F.lit(4)) + 1).cast("int"))
    rows = read(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") * scale).cast("decimal(18,2)").alias("a"))
    return rows.select("o_orderkey", M.format_inr(F.col("a")).alias("shown"))


DATE_PRINTS = ["yyyy-MM-dd", "d.M.yyyy", "d/M/yyyy", "dd-MM-yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "yyyy"]


@query("q03_parse_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders")
def parse_date(spark, d):
    """Dates printed in several forms, and texts that are none."""
    rows = read(spark, d, "orders")
    n = F.pmod("o_orderkey", F.lit(8))
    printed = F.lit(None).cast("string")
    for i, form in enumerate(DATE_PRINTS):
        printed = F.when(n == i, F.date_format("o_orderdate", form)).otherwise(printed)
    return rows.select("o_orderkey", M.parse_date(printed).cast("string").alias("parsed"))


THRESHOLDS = ["30% of the estimated cost", "Rs. 5 Cr", "5 (five) years", "80% marks", "at least 3 projects", "25 per cent of contract value", "as stated"]
_T = pick_sql(THRESHOLDS, "c_custkey")


@query(
    "q04_threshold",
    f"WITH s AS (SELECT c_custkey, {_T} AS txt, c_acctbal FROM customer), {money_ctes('s', 'c_custkey, c_acctbal')} "
    f"SELECT c_custkey, txt, CASE WHEN regexp_matches(txt, {quoted(M.SHARE)}) AND regexp_matches(txt, {quoted(M.ESTIMATE)}) THEN "
    f"CAST(round_even(CAST(c_acctbal AS DECIMAL(18,2)) * CAST(regexp_extract(txt, {quoted(M.SHARE)}, 1) AS DECIMAL(6,2)) * CAST(0.01 AS DECIMAL(3,2)), 2) AS DOUBLE) "
    f"WHEN regexp_matches(txt, {quoted(M.MONETARY)}) THEN inr END AS amount, "
    f"CASE WHEN NOT (regexp_matches(txt, {quoted(M.SHARE)}) AND regexp_matches(txt, {quoted(M.ESTIMATE)})) AND NOT regexp_matches(txt, {quoted(M.MONETARY)}) "
    "THEN TRY_CAST(nullif(regexp_extract(txt, '(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE) END AS number FROM m3",
)
def threshold(spark, d):
    """Printed thresholds as an amount, a share of the estimate, or a number."""
    rows = read(spark, d, "customer").select("c_custkey", "c_acctbal", pick(THRESHOLDS, F.col("c_custkey")).alias("txt"))
    t = M.threshold(F.col("txt"), F.lit(None).cast("string"), F.col("c_acctbal").cast("decimal(18,2)"))
    out = rows.select("c_custkey", "txt", t.alias("t"))
    return out.select("c_custkey", "txt", F.col("t.amount").cast("double").alias("amount"), F.col("t.number").alias("number"))


def _named(spark, d):
    return read(spark, d, "part").select("p_partkey", pick(NAMES, F.col("p_partkey")).alias("name"))


_NAMED = f"(SELECT p_partkey, {pick_sql(NAMES, 'p_partkey')} AS name FROM part)"


@query("q05_normalise_name", f"SELECT p_partkey, {normalised_sql('name')} AS normalised FROM {_NAMED}")
def normalise_name(spark, d):
    """Document names in normal form."""
    return _named(spark, d).select("p_partkey", N.normalise_name(F.col("name")).alias("normalised"))


@query("q06_canonical_vocabulary", f"WITH n AS (SELECT p_partkey, {normalised_sql('name')} AS n FROM {_NAMED}) SELECT p_partkey, {canonical_sql('n')} AS canonical, {vocabulary_sql('n')} AS words FROM n")
def canonical_vocabulary(spark, d):
    """Canonical names, and names with synonyms rewritten."""
    n = _named(spark, d).select("p_partkey", N.normalise_name(F.col("name")).alias("n"))
    return n.select("p_partkey", N.canonical_form(F.col("n")).alias("canonical"), N.canonical_vocabulary(F.col("n")).alias("words"))


_SETS = f"n AS (SELECT p_partkey, p_brand, {normalised_sql('name')} AS n FROM (SELECT p_partkey, p_brand, {pick_sql(NAMES, 'p_partkey')} AS name FROM part)), v AS (SELECT p_partkey, p_brand, {vocabulary_sql('n')} AS w FROM n), s AS (SELECT p_partkey, p_brand, w, {distinctive_sql('w')} AS t FROM v)"


@query(
    "q07_token_containment",
    f"WITH {_SETS}, u AS (SELECT DISTINCT p_brand, w, t FROM s) "
    "SELECT a.p_brand, a.w AS required, b.w AS offered, CAST(len(list_intersect(a.t, b.t)) AS BIGINT) AS shared, "
    "round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 4) AS containment "
    "FROM u a JOIN u b ON a.p_brand = b.p_brand AND a.w < b.w WHERE len(a.t) > 0 AND len(b.t) > 0 AND len(list_intersect(a.t, b.t)) > 0",
)
def token_containment(spark, d):
    """Shared identifying words of the distinct names within a brand."""
    rows = read(spark, d, "part").select("p_brand", N.canonical_vocabulary(N.normalise_name(pick(NAMES, F.col("p_partkey")))).alias("w")).distinct()
    rows = rows.withColumn("t", N.distinctive(F.col("w")))
    a, b = rows.select("p_brand", F.col("w").alias("required"), F.col("t").alias("x")), rows.select("p_brand", F.col("w").alias("offered"), F.col("t").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    pairs = a.join(b, "p_brand").where("required < offered").where((F.size("x") > 0) & (F.size("y") > 0) & (shared > 0))
    return pairs.select("p_brand", "required", "offered", shared.cast("long").alias("shared"), F.round(shared / F.least(F.size("x"), F.size("y")), 4).alias("containment"))


FORMS = ["Annexure-", "Form ", "Appendix: ", "Annexure IV and Form "]


@query(
    "q08_identifiers",
    f"WITH s AS (SELECT p_partkey, p_name || ' ' || {pick_sql(FORMS, 'p_partkey')} || p_size AS a, p_name || ' ' || {pick_sql(FORMS, 'p_partkey // 2')} || (p_size % 7) AS b FROM part), "
    f"i AS (SELECT p_partkey, {identifiers_sql('a')} AS x, {identifiers_sql('b')} AS y FROM s) "
    "SELECT p_partkey, array_to_string(x, ',') AS wanted, array_to_string(y, ',') AS offered, "
    "len(list_filter(list_concat(list_filter(x, lambda e: NOT list_contains(y, e)), list_filter(y, lambda e: NOT list_contains(x, e))), "
    "lambda e: list_contains(list_intersect(list_transform(x, lambda f: split_part(f, ':', 1)), list_transform(y, lambda f: split_part(f, ':', 1))), split_part(e, ':', 1)))) > 0 AS conflict FROM i",
)
def form_identifiers(spark, d):
    """Numbered forms in names, and whether two names contradict each other."""
    p = read(spark, d, "part")
    a = F.concat(F.col("p_name"), F.lit(" "), pick(FORMS, F.col("p_partkey")), F.col("p_size").cast("string"))
    b = F.concat(F.col("p_name"), F.lit(" "), pick(FORMS, F.floor(F.col("p_partkey") / 2).cast("long")), (F.col("p_size") % 7).cast("string"))
    i = p.select("p_partkey", N.identifiers(a).alias("x"), N.identifiers(b).alias("y"))
    return i.select("p_partkey", F.array_join("x", ",").alias("wanted"), F.array_join("y", ",").alias("offered"), N.conflicting(F.col("x"), F.col("y")).alias("conflict"))


def _jv_sql(x: str) -> str:
    words = "|".join(f" {w}|{w} " for w in (m.replace(".", r"\.") for m in V.JV))
    return f"regexp_matches(' ' || lower({x}) || ' ', {quoted(words)})"


@query(
    "q11_classify_requirement",
    f"SELECT p_partkey, CASE WHEN {any_word_sql(chr(39) + ' ' + chr(39) + ' || name || ' + chr(39) + ' ' + chr(39), V.CONCESSION)} THEN 'concession' WHEN {_jv_sql('name')} AND NOT regexp_matches(name, {quoted(V.JV_YET_ALWAYS)}) THEN 'joint_venture' "
    f"WHEN {any_word_sql('name', V.CONDITIONAL)} THEN 'conditional' ELSE 'always' END AS applicability, "
    f"NOT (trim(name) = '' OR {any_word_sql('name', V.NOT_A_DOCUMENT)} OR {any_word_sql('name', V.CATCH_ALL)} OR (regexp_matches(lower(name), '\\betc\\b') AND NOT {any_word_sql('name', V.DOCUMENT_NOUNS)}) "
    f"OR {any_word_sql('name', V.INSTRUCTION)} OR {any_word_sql('name', V.CONDITION)} OR regexp_matches(name, {quoted(V.OPTIONS)})) AS verifiable FROM {_NAMED}",
)
def classify_requirement(spark, d):
    """When a requirement binds, and whether its absence proves anything."""
    n = F.col("name")
    return _named(spark, d).select("p_partkey", N.applicability(n).alias("applicability"), N.verifiable(n).alias("verifiable"))


QUESTIONS = [
    "Why was Vendor A eliminated?", "Compare shortlisted vendors on experience and approach", "What is the EMD and the annual turnover?", "Describe the methodology",
    "Rank vendors side by side", "How many are pending?", "List the bank guarantee and BOQ terms", "Is a joint venture or JV allowed?", "Debarred firms and GST",
]
_ASK = f"(SELECT conv_id, turn, {pick_sql(QUESTIONS, 'conv_id + turn')} || ' ' || text AS question FROM conversations)"


def _asked(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", F.concat(pick(QUESTIONS, F.col("conv_id") + F.col("turn")), F.lit(" "), F.col("text")).alias("question"))


_HAS = {k: any_word_sql("question", w) for k, w in (("a", V.AUDIT), ("q", V.QUALITATIVE), ("s", V.STRUCTURED), ("c", V.COMPARATIVE))}


@query(
    "q21_router",
    f"WITH r AS (SELECT CASE WHEN {_HAS['a']} THEN 'audit' WHEN {_HAS['q']} AND ({_HAS['s']} OR {_HAS['c']}) THEN 'hybrid' WHEN {_HAS['c']} THEN 'comparative' WHEN {_HAS['q']} THEN 'qualitative' ELSE 'structured' END AS route, conv_id % 2 AS split FROM {_ASK}) "
    "SELECT route, split, count(*) AS n FROM r GROUP BY ROLLUP (route, split)",
)
def router(spark, d):
    """Routes of questions, with subtotals."""
    r = _asked(spark, d).select(Q.route(F.col("question")).alias("route"), (F.col("conv_id") % 2).alias("split"))
    return r.rollup("route", "split").agg(F.count("*").alias("n"))


def _expand_sql(x: str) -> str:
    import re

    def has(term: str) -> str:
        return f"regexp_matches(lower({x}), {quoted('(^|[^a-z0-9])' + re.escape(term) + '([^a-z0-9]|$)')})"

    ranked = sorted(((t, g) for g in V.EQUIVALENTS for t in g), key=lambda p: -len(p[0]))
    parts = []
    for rank, (term, group) in enumerate(ranked):
        first = " AND ".join([has(term), *(f"NOT {has(t)}" for t, g in ranked[:rank] if g is group)])
        others = ", ".join(f"CASE WHEN NOT {has(o)} THEN {quoted(o)} END" for o in group if o != term)
        parts.append(f"CASE WHEN {first} THEN [{others}] ELSE [] END")
    return f"list_filter(flatten([{', '.join(parts)}]), lambda e: e IS NOT NULL)"


@query("q22_expand_query", f"WITH e AS (SELECT conv_id, turn, question, {_expand_sql('question')} AS added FROM {_ASK}) SELECT conv_id, turn, CASE WHEN len(added) > 0 THEN question || ' ' || array_to_string(added[1:4], ' ') ELSE question END AS expanded FROM e")
def expand_query(spark, d):
    """Questions with equivalent terms appended."""
    return _asked(spark, d).select("conv_id", "turn", Q.expand(F.col("question")).alias("expanded"))


@query(
    "q37_citations",
    r"WITH a AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(text || ' [' || (turn + 1) || '] and [' || (conv_id % 9) || '] [x] [' || (turn + 1) || ']', '\[(\d{1,9})\]', 1), lambda n: CAST(n AS INTEGER)))) AS cited, range(1, 5) AS retrieved FROM conversations) "
    "SELECT conv_id, turn, array_to_string(list_filter(cited, lambda c: NOT list_contains(retrieved, c)), ',') AS invented, array_to_string(list_filter(cited, lambda c: list_contains(retrieved, c)), ',') AS used, "
    "len(list_filter(cited, lambda c: NOT list_contains(retrieved, c))) = 0 AND len(cited) > 0 AS grounded FROM a",
)
def citations(spark, d):
    """Citations of answers against the four sources that were retrieved."""
    c = read(spark, d, "conversations")
    text = F.concat(F.col("text"), F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] and ["), (F.col("conv_id") % 9).cast("string"), F.lit("] [x] ["), (F.col("turn") + 1).cast("string"), F.lit("]"))
    a = c.select("conv_id", "turn", Q.cited_numbers(text).alias("cited"), F.array(*(F.lit(i) for i in range(1, 5))).alias("got"))
    bad, used = F.array_sort(F.array_except("cited", "got")), F.array_sort(F.array_intersect("cited", "got"))
    return a.select("conv_id", "turn", F.array_join(bad, ",").alias("invented"), F.array_join(used, ",").alias("used"), ((F.size(bad) == 0) & (F.size("cited") > 0)).alias("grounded"))


@query(
    "q38_strip_thinking",
    "SELECT conv_id, turn, CASE WHEN conv_id % 3 = 2 AND trim(text) <> '' THEN trim(text) WHEN conv_id % 3 = 1 THEN 'Answer.' ELSE trim(text) END AS answer FROM "
    "(SELECT conv_id, turn, regexp_replace(text, '[<>]', '', 'g') AS text FROM conversations)",
)
def strip_thinking(spark, d):
    """Answers without reasoning blocks, paired or with a stray end."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[<>]", "").alias("text"))
    kind = F.col("conv_id") % 3
    raw = F.when(kind == 0, F.concat(F.lit("<think>let me see\n</think>"), "text")).when(kind == 1, F.concat(F.col("text"), F.lit("</think> Answer."))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", Q.strip_thinking(raw).alias("answer"))


CLAUSES = ["as per clause 4.2 and 28.1(vi).", "see 1.1 (4) and 2.8", "Section 11 applies", "no clause here", "clauses 3.1.2, 3.1.2 and 9(a)"]
CITES = ["2.8.1", "28.1", "4.2", "3.12", "9"]


@query(
    "q39_clause_references",
    f"WITH s AS (SELECT p_partkey, {pick_sql(CLAUSES, 'p_partkey')} AS txt, {pick_sql(CITES, 'p_partkey // 5')} AS cite FROM part), "
    r"r AS (SELECT *, list_distinct(list_transform(regexp_extract_all(txt, '\b\d+(?:\.\d+)*(?:\.(?:[ivxlcIVXLC]+|[A-Za-z])\b)*(?:\s*\.?\s*\([a-zA-Z0-9]+\))*', 0), lambda e: regexp_replace(lower(e), '\s+', '', 'g'))) AS printed FROM s), "
    "p AS (SELECT *, len(list_filter(printed, lambda e: starts_with(e, cite))) > 0 AS present, list_filter(printed, lambda e: regexp_replace(e, '[^0-9]', '', 'g') = regexp_replace(cite, '[^0-9]', '', 'g') AND e <> cite) AS near FROM r) "
    "SELECT p_partkey, array_to_string(list_sort(printed), ' ') AS printed, present, CASE WHEN NOT present AND len(near) = 1 THEN near[1] END AS suggestion FROM p",
)
def clause_references(spark, d):
    """Whether a cited clause is printed, and the one it may have meant."""
    p = read(spark, d, "part").select("p_partkey", Q.references(pick(CLAUSES, F.col("p_partkey"))).alias("printed"), pick(CITES, F.floor(F.col("p_partkey") / 5).cast("long")).alias("cite"))
    c, printed = F.col("cite"), F.col("printed")
    return p.select("p_partkey", F.array_join(F.array_sort(printed), " ").alias("printed"), Q.present(c, printed).alias("present"), Q.suggestion(c, printed).alias("suggestion"))
