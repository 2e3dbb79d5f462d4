"""Further operators over the driver's tables: documents against bids, reports, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vocabulary as V
from ..operators import compliance as C
from ..operators import jobs as J
from ..operators import pages as P
from ..operators import requirements as R
from ..operators import retrieval as X
from ..operators.running import running
from .analytics import _DOT, _STATE
from .base import NAMES, any_word_sql, pick, pick_sql, query, quoted, read
from .tenders import ITEMS_SQL, items

FACTORS = [("average annual TURNOVER", 40.0), ("Experience in years", 25.0), ("Presentation", 35.0), ("Price", None)]


@query(
    "q65_score_preview",
    f"WITH {ITEMS_SQL}, fa(factor, weight) AS (VALUES ('average annual TURNOVER', 40.0), ('Experience in years', 25.0), ('Presentation', 35.0)), b AS (SELECT DISTINCT tender_id, vendor_id FROM it) "
    "SELECT b.tender_id, b.vendor_id, factor, CAST(weight AS DOUBLE) AS weight, coalesce(it.status, 'manual_check') AS status FROM b CROSS JOIN fa LEFT JOIN it ON it.tender_id = b.tender_id AND it.vendor_id = b.vendor_id AND lower(it.requirement) = lower(factor)",
)
def score_preview(spark, d):
    """Published factors with the status of the requirement of the same name."""
    tenders = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("tender_id"))
    factors = tenders.join(F.broadcast(spark.createDataFrame(FACTORS, "factor string, weight double")))
    return C.score_preview(factors, items(spark, d), ["tender_id", "vendor_id"]).select("tender_id", "vendor_id", "factor", "weight", "status")




@query(
    "q66_document_items",
    f"WITH r AS (SELECT p_partkey AS key, p_brand AS tender_id, {pick_sql(NAMES, 'p_partkey')} AS label, p_size % 3 AS v, p_size % 7 = 0 AS absent FROM part), "
    f"c AS (SELECT *, CASE WHEN {any_word_sql('label', V.CONCESSION)} THEN 'x' WHEN regexp_matches(lower(label), 'joint venture') THEN 'x' WHEN {any_word_sql('label', V.CONDITIONAL)} THEN 'x' ELSE 'always' END AS binds, "
    f"NOT ({any_word_sql('label', V.NOT_A_DOCUMENT)} OR {any_word_sql('label', V.CATCH_ALL)} OR {any_word_sql('label', V.INSTRUCTION)} OR {any_word_sql('label', V.CONDITION)}) AS can, regexp_matches(label, {quoted(V.NARRATIVE)}) AND NOT regexp_matches(label, {quoted(V.FORMAL)}) AS narrative FROM r) "
    "SELECT key, status, CASE status WHEN 'match' THEN 'info' WHEN 'missing' THEN 'disqualifying' ELSE 'review' END AS severity FROM (SELECT key, CASE WHEN v = 0 AND NOT absent THEN 'match' WHEN v = 1 AND NOT absent THEN 'partial' WHEN binds <> 'always' THEN 'manual_check' "
    "WHEN NOT can AND NOT absent THEN 'not_assessable' WHEN narrative AND NOT absent THEN 'not_assessable' ELSE 'missing' END AS status FROM c)",
)
def document_items(spark, d):
    """Document requirements with given matches, some declared absent."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("tender_id"), F.lit(1).alias("vendor_id"), pick(NAMES, F.col("p_partkey")).alias("label"), (F.col("p_size") % 3).alias("v"), (F.col("p_size") % 7 == 0).alias("gone"))
    jv = F.lower("label").contains("joint venture")
    required = p.select("tender_id", "vendor_id", "key", "label", F.when(jv, "joint_venture").otherwise(N.applicability(F.when(jv, F.lit("")).otherwise(F.col("label")))).alias("applicability"), N.verifiable(F.col("label")).alias("verifiable"))
    matches = p.where("v < 2").select("tender_id", "vendor_id", "key", (F.col("v") == 0).alias("matched"), F.col("label").alias("name"))
    return C.document_items(required, matches, p.where("gone").select("tender_id", "vendor_id", "key")).select("key", "status", "severity")


@query(
    "q67_collect_requirements",
    f"SELECT p_brand AS tender_id, 0 AS part, p_partkey AS pos, {pick_sql(NAMES, 'p_partkey')} AS doc_name FROM part WHERE p_partkey % 2 = 0 UNION ALL "
    "SELECT p_brand, 1, p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'Registered with the board' ELSE 'Not blacklisted, certified' END FROM part WHERE p_partkey % 2 = 1 AND (p_size % 3 = 0 OR (p_size % 3 = 1 AND p_partkey % 4 = 1))",
)
def collect_requirements(spark, d):
    """Documents, document criteria and mandatory credential criteria as one list."""
    p = read(spark, d, "part")
    none = F.lit(None).cast("string")
    docs = p.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("tender_id"), F.col("p_partkey").alias("pos"), pick(NAMES, F.col("p_partkey")).alias("doc_name"), F.array().cast("array<string>").alias("aliases"), none.alias("clause_ref"))
    kind = F.when(F.col("p_size") % 3 == 0, "document").when(F.col("p_size") % 3 == 1, "boolean").otherwise("numeric")
    text = F.when(F.col("p_partkey") % 4 == 1, "Registered with the board").otherwise("Not blacklisted, certified")
    criteria = p.where("p_partkey % 2 = 1").select(F.col("p_brand").alias("tender_id"), F.col("p_partkey").alias("pos"), text.alias("criterion"), kind.alias("type"), F.lit(True).alias("is_mandatory"), none.alias("clause_ref"))
    return R.collect_requirements(docs, criteria).select("tender_id", F.col("pos.part").alias("part"), F.col("pos.pos").alias("pos"), "doc_name")


@query(
    "q68_document_text",
    "SELECT conv_id, string_agg(CASE WHEN trim(text) <> '' THEN '[PAGE ' || turn || ']' || chr(10) || text END, chr(10) || chr(10) ORDER BY turn) AS full_text, count(*) AS page_count, CAST(sum(length(trim(text))) AS BIGINT) AS total_chars, count(*) FILTER (role = 'assistant') AS ocr_pages, count(*) FILTER (role = 'assistant') * 2 > count(*) AS is_scanned FROM conversations GROUP BY conv_id",
)
def document_text(spark, d):
    """Pages joined with marks, and a document's properties."""
    pages = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text", F.when(F.col("role") == "assistant", "ocr").otherwise("native").alias("method"))
    return P.document_text(pages).select(F.col("doc_id").alias("conv_id"), "full_text", "page_count", "total_chars", "ocr_pages", "is_scanned")


_FOLD = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


@query(
    "q69_citation_truth",
    f"WITH p AS (SELECT doc_id, {_FOLD.format(x='text')} AS t FROM documents), c AS (SELECT doc_id, doc_id + doc_id % 3 AS page, left(t, 80) AS fragment FROM p) SELECT c.doc_id, contains(p.t, c.fragment) AS truthful FROM c LEFT JOIN p ON p.doc_id = c.page",
)
def citation_truth(spark, d):
    """Whether the opening of a citation stands on the page it names; null when there is no such page."""
    folded = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    p = read(spark, d, "documents").select(F.col("doc_id").alias("page"), folded.alias("t"))
    c = p.select(F.col("page").alias("doc_id"), (F.col("page") + F.col("page") % 3).alias("page"), F.substring("t", 1, 80).alias("fragment"))
    return c.join(p, "page", "left").select("doc_id", F.contains("t", "fragment").alias("truthful"))


@query(
    "q70_annotators",
    "SELECT l.doc_id, l.quality AS a, 1 - l.toxic AS b, l.quality = 1 - l.toxic AS agree FROM labels l WHERE l.doc_id % 4 <> 0 UNION ALL SELECT l.doc_id, l.quality, NULL, NULL FROM labels l WHERE l.doc_id % 4 = 0",
)
def annotators(spark, d):
    """Two raters' labels side by side, units without a second label marked."""
    labels = read(spark, d, "labels")
    second = labels.where("doc_id % 4 <> 0").select("doc_id", (1 - F.col("toxic")).alias("b"))
    both = labels.select("doc_id", F.col("quality").alias("a"))
    found = both.join(second, "doc_id").select("doc_id", "a", "b", (F.col("a") == F.col("b")).alias("agree"))
    missing = both.join(second, "doc_id", "left_anti").select("doc_id", "a", F.lit(None).cast("int").alias("b"), F.lit(None).cast("boolean").alias("agree"))
    return found.unionByName(missing)


@query("q71_stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Hourly counts by kind, as a stream with a watermark over what is there."""
    from ..streaming import ingest

    events = ingest.read_stream(spark, f"{d}/events.parquet*", read(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.run_available(ingest.windowed_counts(events, "ts", "event_type"), ["window", "event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("q72_truth_and_prediction", "SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'pass' WHEN 0 THEN 'eliminate' END, 'SKIP') AS outcome FROM documents d LEFT JOIN labels l USING (doc_id)")
def truth_and_prediction(spark, d):
    """The answer key with predictions, SKIP where there is none."""
    labels = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "pass").otherwise("eliminate").alias("p"))
    return read(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("p", F.lit("SKIP")).alias("outcome"))


@query(
    "q73_chunk_index",
    "WITH c AS (SELECT source AS owner, 0 AS part, doc_id AS pos, 'page' AS section FROM documents UNION ALL SELECT source, 1, doc_id, 'narrative' FROM documents WHERE doc_id % 3 = 0) SELECT owner, section, pos, row_number() OVER (PARTITION BY owner ORDER BY part, pos) - 1 AS chunk_index FROM c",
)
def chunk_index(spark, d):
    """Chunks of several sources of an owner, numbered on."""
    docs = read(spark, d, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("pos"))
    both = docs.withColumns({"part": F.lit(0), "section": F.lit("page")}).unionByName(docs.where("pos % 3 = 0").withColumns({"part": F.lit(1), "section": F.lit("narrative")}))
    numbered = running(both, ["owner"], ["part", "pos"], {"n": F.lit(1)})
    return numbered.select("owner", "section", "pos", (F.col("n") - 1).cast("long").alias("chunk_index"))


@query(
    "q74_progress_retention",
    f"WITH j AS (SELECT user_id, arg_max({_STATE}, (ts, event_id)) AS state, max(ts) AS changed_at, count(*) AS done FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events) "
    "SELECT user_id, state, CASE WHEN state IN ('succeeded', 'partial', 'failed') THEN 1.0::DOUBLE ELSE least(0.99, done / 100.0::DOUBLE) END AS progress FROM j, n WHERE state NOT IN ('succeeded', 'partial', 'failed') OR changed_at > now - INTERVAL 1 DAY",
)
def progress_retention(spark, d):
    """Progress of the jobs that are open or younger than a day."""
    from .analytics import _jobs

    e = _jobs(spark, d)
    states = J.latest_state(e, "job_id", ["ts", "event_id"], "state").crossJoin(e.agg(F.max("ts").alias("now")))
    kept = J.retained(states, F.col("now"), 1)
    return kept.select(F.col("job_id").alias("user_id"), "state", J.progress(F.col("events"), F.lit(100), F.col("state")).alias("progress"))


@query(
    "q75_embedding_tier",
    f"WITH a AS (SELECT q.vec_id AS key, e.vec_id AS pos, {_DOT.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0), b AS (SELECT key, arg_max(pos, (s, -pos)) AS best, max(s) AS s FROM a GROUP BY key) "
    "SELECT key, CAST(best AS VARCHAR) AS name, round(s, 4) AS score, CASE WHEN s >= 0.9 THEN 'match' WHEN s >= 0.86 THEN 'uncertain' WHEN s >= 0.72 THEN 'review' ELSE 'none' END AS state FROM b",
)
def embedding_tier(spark, d):
    """The nearest name of what the other tiers left open, and what its score allows."""
    v = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("name"), "embedding", "vec_id", F.col("label").alias("g"))
    asked = v.where("vec_id % 50 = 0").select("g", F.col("vec_id").alias("key"), F.col("name").alias("label"))
    out = R.match_by_embedding(asked, v.select("g", "name", F.col("vec_id").alias("pos")), v.select("name", "embedding"), ["g"])
    return out.select("key", "name", "score", "state")


@query("q76_manifest", "SELECT source, count(*) AS files, count(DISTINCT sha256(text)) AS distinct_files, min(sha256(text)) AS first_digest, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def manifest(spark, d):
    """A manifest of the corpus: files, distinct digests and sizes per source."""
    docs = read(spark, d, "documents").select("source", F.sha2("text", 256).alias("h"), "n_chars")
    each = docs.groupBy("source", "h").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return each.groupBy("source").agg(F.sum("n").alias("files"), F.count("*").alias("distinct_files"), F.min("h").alias("first_digest"), F.sum("c").alias("chars"))


@query(
    "q77_mrr_by_label",
    f"WITH a AS (SELECT q.vec_id AS query_id, q.label AS own, e.vec_id AS chunk_id, q.label = e.label AS relevant, {_DOT.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM a), "
    "m AS (SELECT query_id, own, coalesce(1.0 / CAST(min(rank) FILTER (relevant) AS DOUBLE), 0.0) AS rr FROM r WHERE rank <= 5 GROUP BY ALL) SELECT own, count(*) AS questions, round(avg(rr), 6) AS mrr FROM m GROUP BY ROLLUP (own)",
)
def mrr_by_label(spark, d):
    """Mean reciprocal rank by kind of question, with the total."""
    from .analytics import _top5

    found = _top5(spark, d)
    rr = X.metrics(found, [5]).join(found.select("query_id", "own").distinct(), "query_id")
    return rr.rollup("own").agg(F.count("*").alias("questions"), F.round(F.avg("rr"), 6).alias("mrr"))
