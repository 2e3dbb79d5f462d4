"""Provenance, labels, failures and comparisons over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rewording as W
from ..operators import evidence as E
from ..operators import pages as P
from ..operators import retrieval as X
from ..operators import statistics as T
from .base import NAMES, canonical_sql, normalised_sql, pick, pick_sql, query, quoted, read


@query(
    "q78_source_provenance",
    "WITH m AS (SELECT p_brand, p_partkey AS key, p_name AS name FROM part WHERE p_size > 25), s AS (SELECT p_brand, p_name AS name, p_partkey AS pos, p_size AS page, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS part FROM part WHERE p_size <= 25), "
    "f AS (SELECT p_brand, name, arg_min(page, (part, pos)) AS source_page, CAST(min(part) AS BIGINT) AS part FROM s GROUP BY ALL) SELECT m.p_brand, key, m.name, source_page, part FROM m LEFT JOIN f USING (p_brand, name)",
)
def source_provenance(spark, d):
    """The page of the bid on which a matched name stands."""
    p = read(spark, d, "part").select("p_brand", F.col("p_name").alias("name"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("source_page"))
    some = p.where("source_page <= 25")
    matched = p.where("source_page > 25").select("p_brand", F.col("pos").alias("key"), "name")
    return E.source_provenance(matched, some.where("pos % 2 = 0"), some.where("pos % 2 = 1"), ["p_brand"]).withColumn("part", F.col("part").cast("long"))


@query(
    "q79_declared_absent",
    f"WITH r0 AS (SELECT p_brand, p_partkey AS key, {pick_sql(NAMES, 'p_partkey')} AS name FROM part WHERE p_partkey % 2 = 0), r AS (SELECT *, {normalised_sql('name')} AS n FROM r0), "
    f"a0 AS (SELECT p_brand, {pick_sql(NAMES, 'p_partkey * 11 + 1')} AS name FROM part WHERE p_partkey % 2 = 1), a AS (SELECT *, {normalised_sql('name')} AS n FROM a0) "
    f"SELECT DISTINCT r.p_brand, r.key FROM r JOIN a ON r.p_brand = a.p_brand AND (r.n = a.n OR {canonical_sql('r.n')} = {canonical_sql('a.n')} OR r.n = {canonical_sql('a.n')} OR {canonical_sql('r.n')} = a.n)",
)
def declared_absent(spark, d):
    """Requirements that a bid marks as not enclosed, under any of their names."""
    p = read(spark, d, "part")
    required = p.where("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").alias("key"), pick(NAMES, F.col("p_partkey")).alias("label"))
    return E.declared_absent(required, p.where("p_partkey % 2 = 1").select("p_brand", pick(NAMES, F.col("p_partkey") * 11 + 1).alias("name")), ["p_brand"])


LABELS = ["Gap report", "Go to tenders", "Bid review", "Corrigendum impact", "Level one"]
TYPED = ["gap", "gt", "brv", "zz", "impact", "lvl"]


def _rank(word: str, label: str) -> float:
    low, hay = word.lower(), label.lower()
    if low in hay:
        return 100 - hay.index(low) / 100
    at, gaps = 0, 0
    for c in low:
        place = hay.find(c, at)
        if place < 0:
            return 0.0
        gaps += place - at if at else 0
        at = place + 1
    return 1 / (gaps + 1)


@query(
    "q80_palette_rank",
    f"WITH r(word, label, rank) AS (VALUES {', '.join(f'({quoted(w)}, {quoted(x)}, {_rank(w, x)!r}::DOUBLE)' for w in TYPED for x in LABELS)}) SELECT s_suppkey, w AS word, l AS label, round(rank, 6) AS rank FROM (SELECT s_suppkey, {pick_sql(TYPED, 's_suppkey')} AS w, {pick_sql(LABELS, 's_suppkey // 6')} AS l FROM supplier) JOIN r ON r.word = w AND r.label = l",
)
def palette_rank(spark, d):
    """How well typed words fit labels, contained or as a subsequence."""
    s = read(spark, d, "supplier").select("s_suppkey", pick(TYPED, F.col("s_suppkey")).alias("word"), pick(LABELS, F.floor(F.col("s_suppkey") / 6).cast("long")).alias("label"))
    return s.withColumn("rank", F.round(E.subsequence_rank(F.col("word"), F.col("label")), 6))


@query(
    "q81_numbered_sources",
    "WITH c AS (SELECT conv_id, turn, concat_ws(', ', CASE WHEN turn % 2 = 0 THEN role END, 'page ' || turn, CASE WHEN conv_id % 3 = 0 THEN 'clause ' || conv_id END) AS label, text AS t FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM c) "
    "SELECT conv_id, string_agg('[' || i || '] ' || label || chr(10) || t, chr(10) || chr(10) ORDER BY i) AS sources FROM n GROUP BY conv_id",
)
def numbered_sources(spark, d):
    """Sources as numbered blocks under their labels."""
    c = read(spark, d, "conversations")
    label = E.citation_label(F.when(F.col("turn") % 2 == 0, F.col("role")), F.col("turn"), F.when(F.col("conv_id") % 3 == 0, F.col("conv_id").cast("string")))
    return E.numbered_sources(c.select("conv_id", "turn", label.alias("label"), "text"), ["conv_id"], "turn")


ERRORS = ["HTTP 429 Too Many Requests", "quota exceeded per day", "model not found", "Connection reset by peer", "read timed out", "invalid key"]


@query(
    "q83_failure_kinds",
    f"SELECT event_id, CASE {pick_sql(ERRORS, 'event_id')} WHEN 'quota exceeded per day' THEN 'quota' WHEN 'model not found' THEN 'permanent' WHEN 'invalid key' THEN 'permanent' ELSE 'transient' END AS kind, "
    "CASE WHEN event_id % 3 = 0 THEN 'a' WHEN event_id % 2 = 0 THEN 'b' WHEN event_id % 5 = 0 THEN 'c' END AS answer, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 2 WHEN event_id % 5 = 0 THEN 3 END AS tier FROM events",
)
def failure_kinds(spark, d):
    """Which failures may be tried again, and the first tier that answered."""
    e, k = read(spark, d, "events"), F.col("event_id")
    tiers = E.first_answer(F.when(k % 3 == 0, "a"), F.when(k % 2 == 0, "b"), F.when(k % 5 == 0, "c"))
    return e.select("event_id", E.failure_kind(pick(ERRORS, k)).alias("kind"), tiers.alias("t")).select("event_id", "kind", "t.*")


DIRECTIONS = ["newly_eliminated", "reinstated", "reason_changed", "unchanged"]


@query(
    "q84_impact_summary",
    f"WITH c AS (SELECT c_nationkey, {pick_sql(DIRECTIONS, 'c_custkey // 3')} AS dir, count(*) AS n FROM customer GROUP BY ALL) SELECT c_nationkey, string_agg(n || ' ' || dir, ', ' ORDER BY list_position([{', '.join(map(quoted, DIRECTIONS))}], dir)) AS summary FROM c GROUP BY c_nationkey",
)
def impact_summary(spark, d):
    """One line of counts per tender, in the order of the directions."""
    c = read(spark, d, "customer").select("c_nationkey", pick(DIRECTIONS, F.floor(F.col("c_custkey") / 3).cast("long")).alias("dir"))
    return E.summary(c, ["c_nationkey"], "dir", DIRECTIONS)


RULES = ["id_core", "tokens", "number", "date", "expected_null"]
TRUTHS = ["NIT/2024-25/07", "Public Works", "Rs. 12.5", "05.03.2025", ""]
FOUND = ["Ref: NIT 2024-25 / 07 (rev)", "department of public works", "12.50 lakh", "5 March 2025", "", "other 99"]


@query(
    "q85_field_accuracy",
    f"SELECT rule, count(*) AS fields, count(*) FILTER (ok) AS correct FROM (SELECT {pick_sql(RULES, 'p_partkey')} AS rule, (p_partkey // 5) % 6 = p_partkey % 5 AS ok FROM part) GROUP BY rule",
)
def field_accuracy(spark, d):
    """Extracted fields that are right under their comparison rules."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    rows = p.select(pick(RULES, k).alias("rule"), pick(TRUTHS, k).alias("truth"), pick(FOUND, F.floor(k / 5).cast("long")).alias("found"))
    return rows.groupBy("rule").agg(F.count("*").alias("fields"), F.count_if(E.compare(F.col("rule"), F.col("truth"), F.col("found"))).alias("correct"))


@query(
    "q86_paired_arms",
    "WITH a AS (SELECT doc_id, quality AS x, toxic AS y FROM labels) SELECT count(*) FILTER (y > x) AS improved, count(*) FILTER (y < x) AS regressed, count(*) FILTER (y = x) AS tied FROM a",
)
def paired_arms(spark, d):
    """Two arms' results on the same units."""
    labels = read(spark, d, "labels")
    pairs = labels.select("doc_id", F.col("quality").alias("x")).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id")
    return T.paired_counts(pairs, "x", "y")


@query("q87_stage_medians", "SELECT event_type, round(median(value), 6) AS median_s, round(quantile_cont(value, 0.99), 6) AS p99_s, count(*) AS runs FROM events GROUP BY event_type")
def stage_medians(spark, d):
    """Median and 99th percentile of each stage."""
    e = read(spark, d, "events").groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.99))).alias("q"), F.count("*").alias("runs"))
    return e.select("event_type", F.round(F.get("q", 0), 6).alias("median_s"), F.round(F.get("q", 1), 6).alias("p99_s"), "runs")


@query(
    "q88_combined_text",
    "SELECT o_orderkey, 'text ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || '[TABLES ON PAGE 3]' || chr(10) || 'Item | ' || o_orderstatus ELSE '' END AS combined, o_orderkey % 2 = 0 AND false AS tabular FROM orders",
)
def combined_text(spark, d):
    """A page's text with its tables, and whether a table passes the strict test."""
    o = read(spark, d, "orders")
    blank = F.array(F.lit(""), F.lit(None).cast("string"))
    table = F.array(F.array(F.lit("Item"), F.col("o_orderstatus")), blank)
    tables = F.when(F.col("o_orderkey") % 2 == 0, F.array(table)).otherwise(F.array().cast("array<array<array<string>>>"))
    text = P.combined_text(F.concat(F.lit("text "), F.col("o_orderpriority")), tables, F.lit(3))
    return o.select("o_orderkey", text.alias("combined"), F.coalesce(P.looks_tabular(F.get(tables, 0)), F.lit(False)).alias("tabular"))


_STYLE_SQL = pick_sql(W.STYLES, "p_partkey // 2")
_TRIES_SQL = ", ".join(f"CASE WHEN regexp_matches(name, {quoted('(?i)' + said)}) THEN regexp_replace(name, {quoted('(?is)^(.*?)' + said)}, {quoted(chr(92) + '1' + meant)}) END" for said, meant in W.SUBSTITUTIONS)
_FLIP_SQL = f"CASE WHEN regexp_matches(trim(name), {quoted(W.OF_PHRASE)}) THEN trim(regexp_extract(trim(name), {quoted(W.OF_PHRASE)}, 2)) || ' ' || trim(regexp_extract(trim(name), {quoted(W.OF_PHRASE)}, 1)) END"
_OTHERS_SQL = "MAP {" + ", ".join(f"{quoted(c)}: [{', '.join('{' + chr(39) + 'plain' + chr(39) + ': ' + quoted(p) + ', ' + chr(39) + 'said' + chr(39) + ': ' + quoted(x) + '}' for p, x in names)}]" for c, names in W.other_names().items()) + "}"


@query(
    "q116_paraphrase",
    f"WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {pick_sql(NAMES, 'p_partkey')} ELSE {pick_sql(NAMES, 'p_partkey')} || ' of the ' || p_name END AS name, {_STYLE_SQL} AS style FROM part), "
    f"m AS (SELECT *, {normalised_sql('name')} AS plain FROM n), c AS (SELECT *, {canonical_sql('plain')} AS canonical, [{_TRIES_SQL}, {_FLIP_SQL}] AS tries FROM m), "
    f"w AS (SELECT *, CASE WHEN NOT regexp_matches(name, {quoted(W.FORM_REFERENCE)}) THEN list_filter(tries, lambda t: t IS NOT NULL AND {normalised_sql('t')} <> plain)[1] END AS reworded, list_filter(({_OTHERS_SQL})[canonical], lambda a: a.plain <> plain)[1].said AS alias FROM c) "
    "SELECT p_partkey, name, style, CASE style WHEN 'alias' THEN coalesce(alias, reworded, name) WHEN 'reworded' THEN coalesce(reworded, alias, name) ELSE name END AS renamed FROM w",
)
def paraphrase(spark, d):
    """Document names as bids of three styles print them."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    name = F.when(k % 3 == 0, pick(NAMES, k)).otherwise(F.concat(pick(NAMES, k), F.lit(" of the "), F.col("p_name")))
    rows = p.select("p_partkey", name.alias("name"), pick(W.STYLES, F.floor(k / 2).cast("long")).alias("style"))
    return rows.withColumn("renamed", W.renamed(F.col("name"), F.col("style")))


_BENCH_FIELDS = ["emd_amount", "submission_deadline", "issuing_authority", "tender_id"]


@query(
    "q117_extraction_report",
    "WITH r AS (SELECT p_size % 3 AS m, p_size % 2 AS v, p_brand AS document, p_partkey % 4 AS f, p_retailprice AS seconds, CASE WHEN p_partkey % 7 = 2 THEN '--' WHEN p_partkey % 5 = 0 THEN 'WRONG' ELSE 'OK' END AS cell, p_partkey FROM part), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY m, v, document, f ORDER BY p_partkey) AS n FROM r) "
    "SELECT 'model-' || m AS model, CASE v WHEN 0 THEN 'bare' ELSE 'fewshot' END AS prompt, document, count(*) FILTER (cell = 'OK') || '/' || count(*) AS score, count(*) FILTER (cell = 'OK') AS correct, "
    + ", ".join(f"max(cell) FILTER (f = {i}) AS {f}" for i, f in enumerate(_BENCH_FIELDS))
    + ", max(seconds) AS seconds FROM o WHERE n = 1 GROUP BY m, v, document",
)
def extraction_report(spark, d):
    """A benchmark of models and prompts: a row per document, a cell per field."""
    p, k = read(spark, d, "part"), F.col("p_partkey")
    first = p.groupBy((F.col("p_size") % 3).alias("m"), (F.col("p_size") % 2).alias("v"), F.col("p_brand").alias("document"), (k % 4).alias("f")).agg(F.min_by(F.struct("p_partkey", "p_retailprice"), "p_partkey").alias("r"))
    first = first.select("m", "v", "document", "f", "r.*")
    thousands = F.concat((k % 90 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"))
    day = F.date_add(F.lit("2026-01-01").cast("date"), (k % 360).cast("int"))
    wrong = k % 5 == 0
    expected = F.when(F.col("f") == 0, thousands).when(F.col("f") == 1, day.cast("string")).when(F.col("f") == 2, F.concat(F.lit("Municipal Corporation|Body "), k.cast("string"))).otherwise(F.concat(F.lit("T/"), k.cast("string"), F.lit("/2026")))
    printed = (
        F.when(F.col("f") == 0, F.concat(F.lit("Rs. "), F.when(wrong, F.concat(F.lit("9"), thousands)).otherwise(thousands), F.lit("/-")))
        .when(F.col("f") == 1, F.date_format(F.when(wrong, F.date_add(day, 1)).otherwise(day), "d MMMM yyyy"))
        .when(F.col("f") == 2, F.when(wrong, "Not Stated").otherwise(F.concat(F.lit("the BODY "), k.cast("string"), F.lit(" of works"))))
        .otherwise(F.concat(F.lit("No. t/"), k.cast("string"), F.when(wrong, "/2025").otherwise("/2026")))
    )
    results = first.select(
        F.concat(F.lit("model-"), F.col("m").cast("string")).alias("model"), F.when(F.col("v") == 0, "bare").otherwise("fewshot").alias("prompt"), "document",
        F.element_at(F.array(*(F.lit(f) for f in _BENCH_FIELDS)), (F.col("f") + 1).cast("int")).alias("field"), expected.alias("expected"), F.when(k % 7 != 2, printed).alias("actual"), F.col("p_retailprice").alias("seconds"),
    )
    return E.extraction_report(results, _BENCH_FIELDS)


_POOL = [
    "Why was Bidder 3 eliminated?", "How many bids have a turnover above the threshold?", "Describe the approach and staffing", "Which bidder has the lowest price and a credible plan?", "Compare the bids", "why were BIDDER 4 and Bidder 14 excluded",
]
_ROUTES = ["audit", "structured", "qualitative", "hybrid", "comparative", "audit"]
_SECTIONS = ["technical_approach", "past_performance", "general"]
_POOL_SQL = (
    f"q AS (SELECT vec_id AS question_id, label AS tender_id, {pick_sql(_POOL, 'vec_id // 50')} AS question, {pick_sql(_ROUTES, 'vec_id // 50')} AS route, embedding FROM embeddings WHERE vec_id % 50 = 0), "
    f"c AS (SELECT vec_id, label, embedding, {pick_sql(_SECTIONS, 'vec_id')} AS section, coalesce(text, '') AS text FROM embeddings LEFT JOIN documents ON doc_id = vec_id), "
    "s AS (SELECT question_id, vec_id, text, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM q JOIN c ON c.label = q.tender_id AND section <> 'general'), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 8), "
    "f AS (SELECT label AS tender_id, count(*) || ' bids recorded' AS answer FROM embeddings GROUP BY label)"
)


def _pool(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("tender_id"), "embedding", pick(_SECTIONS, F.col("vec_id")).alias("section"))
    asked = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"), "tender_id")
    questions = asked.select(F.col("query_id").alias("question_id"), "tender_id", pick(_POOL, F.floor(F.col("query_id") / 50).cast("long")).alias("question"))
    found = X.nearest(asked, X.scoped(v, sections=E.NARRATIVE_SECTIONS), E.MOST_CITED, ["tender_id"])
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = found.join(texts, "chunk_id", "left").select(
        F.col("query_id").alias("question_id"), "rank", F.when(F.col("chunk_id") % 4 != 0, F.concat(F.lit("Bidder "), F.col("chunk_id").cast("string"))).alias("vendor_id"), F.coalesce("text", F.lit("")).alias("text"),
        (F.col("chunk_id") % 30).alias("source_page"), F.lit(None).cast("string").alias("clause_ref"),
    )
    facts = v.groupBy("tender_id").agg(F.concat(F.count("*").cast("string"), F.lit(" bids recorded")).alias("answer"))
    return questions, hits, facts, v


@query(
    "q122_pool_answers",
    f"WITH {_POOL_SQL}, t AS (SELECT question_id, string_agg(CASE WHEN vec_id % 4 <> 0 THEN 'Bidder ' || vec_id ELSE 'Submission' END || ' records: ' || trim(left(text, 240), ' '), ' ' ORDER BY rank) AS told FROM h WHERE rank <= 4 GROUP BY question_id) "
    "SELECT question_id, route, CASE route WHEN 'hybrid' THEN 'Recorded facts: ' || answer || chr(10) || chr(10) || 'Narrative evidence: ' || coalesce(told, 'No sufficiently relevant narrative evidence was found.') WHEN 'qualitative' THEN coalesce(told, 'No sufficiently relevant narrative evidence was found.') ELSE answer END AS answer "
    "FROM q LEFT JOIN f USING (tender_id) LEFT JOIN t USING (question_id)",
)
def pool_answers(spark, d):
    """Questions about the pool of bids: routed to facts, narrative or both; every 50th vector asks."""
    questions, hits, facts, _ = _pool(spark, d)
    return E.pool_answers(questions, hits, facts)


@query(
    "q124_pool_citations",
    f"WITH {_POOL_SQL}, d AS (SELECT vec_id, label AS tender_id, 'V' || vec_id AS vendor_id, 'Bidder ' || vec_id % 20 AS vendor_name, CASE WHEN vec_id % 3 <> 0 THEN 'reason ' || vec_id ELSE '' END AS reason FROM embeddings) "
    "SELECT question_id, CASE WHEN vec_id % 4 <> 0 THEN 'Bidder ' || vec_id END AS vendor_id, CAST(vec_id % 30 AS BIGINT) AS source_page, left(text, 500) AS snippet FROM h JOIN q USING (question_id) WHERE route IN ('qualitative', 'hybrid') "
    "UNION ALL SELECT question_id, d.vendor_id, CAST(vec_id % 9 AS BIGINT), CASE WHEN vec_id % 2 = 0 THEN 'quoted ' || vec_id ELSE reason END FROM q JOIN d USING (tender_id) WHERE route = 'audit' AND reason <> '' AND (contains(lower(question), lower(vendor_name)) OR contains(lower(question), lower(d.vendor_id)))",
)
def pool_citations(spark, d):
    """What the same answers cite: their hits, or for the audit the decisions on the bids that are named."""
    questions, hits, _, v = _pool(spark, d)
    k = F.col("chunk_id")
    decisions = v.select(
        "tender_id", F.concat(F.lit("V"), k.cast("string")).alias("vendor_id"), F.concat(F.lit("Bidder "), (k % 20).cast("string")).alias("vendor_name"), F.when(k % 3 != 0, F.concat(F.lit("reason "), k.cast("string"))).otherwise("").alias("reason"),
        (k % 9).alias("source_page"), F.lit(None).cast("string").alias("clause_ref"), F.when(k % 2 == 0, F.concat(F.lit("quoted "), k.cast("string"))).alias("snippet"),
    )
    return E.pool_citations(questions, hits, decisions).select("question_id", "vendor_id", F.col("source_page").cast("long").alias("source_page"), "snippet")
