"""Queries of what keeps tables up to date: the index by versions, chained streams, broken files, retained originals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import index as I
from ..operators import pages as P
from ..operators import statistics as T
from ..session import opened, shared_folder
from ..sources import quarantine as Z
from ..sources import retained as B
from ..streaming import ingest
from .base import query, read


def _folder(spark, name: str) -> str:
    return opened(spark, f"{shared_folder(spark)}/bidloom-{name}-{uuid.uuid4().hex}")


def _letters(texts: DataFrame) -> DataFrame:
    """A stand-in for an embedding: shares of five letters in each distinct text, and its length."""
    count = lambda c: (F.length("text") - F.length(F.replace(F.lower("text"), F.lit(c), F.lit("")))).cast("double")
    return texts.select("digest", F.array(*(F.round(count(c) / F.greatest(F.length("text"), F.lit(1)), 6) for c in "aeiou"), F.length("text").cast("double")).alias("vector"))


@query(
    "q111_versioned_index",
    "WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, text FROM conversations WHERE trim(coalesce(text, '')) <> ''), "
    "s AS (SELECT conv_id AS owner, i, CASE WHEN conv_id % 3 = 0 THEN text || ' as changed' ELSE text END AS text FROM c WHERE conv_id % 5 <> 0 UNION ALL SELECT conv_id + 1000000, i, text FROM c WHERE conv_id % 7 = 0) "
    "SELECT 'conv:' || owner AS owner_key, i AS chunk_index, sha256(text) AS digest, CAST(length(text) AS DOUBLE) AS size, round(round((length(text) - length(replace(lower(text), 'e', ''))) / CAST(length(text) AS DOUBLE), 6), 6) AS e_share, 2 AS versions FROM s",
)
def versioned_index(spark, d):
    """An index after three runs: all conversations; a third of them changed, a fifth gone, new ones; and the same once more."""
    turns = read(spark, d, "conversations")
    own = lambda c: F.concat(F.lit("conv:"), c.cast("string"))
    base = turns.select("conv_id", F.lit("turn").alias("section"), F.lit(1).alias("page_number"), F.struct("turn", "role", "text").alias("place"), "text")
    first = I.numbered_chunks([base.withColumn("owner_key", own(F.col("conv_id")))])
    kept = base.where("conv_id % 5 <> 0").withColumn("owner_key", own(F.col("conv_id"))).withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" as changed"))).otherwise(F.col("text")))
    added = base.where("conv_id % 7 = 0").withColumn("owner_key", own(F.col("conv_id") + 1_000_000))
    second = I.numbered_chunks([kept.unionByName(added)])
    owners = turns.select(own(F.col("conv_id")).alias("owner_key")).distinct()
    path = _folder(spark, "index")
    versions = [v for v in (I.replace_owners(c, path, _letters, o) for c, o in ((first, None), (second, owners), (second, owners))) if v]
    found = I.read_index(spark, path)
    return found.select("owner_key", "chunk_index", F.sha2("text", 256).alias("digest"), F.get("vector", 5).alias("size"), F.get("vector", 1).alias("e_share"), F.lit(len(versions)).alias("versions"))


_STATES = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'partial' END"


@query(
    "q112_deferred_index",
    f"WITH j AS (SELECT user_id AS job_id, arg_max({_STATES}, (ts, event_id)) AS state FROM events GROUP BY ALL), "
    "c AS (SELECT doc_id % 160 AS job_id, count(*) AS n, count(*) FILTER (doc_id % 320 = 5) AS blank FROM documents GROUP BY ALL) "
    "SELECT job_id, state, CASE WHEN state = 'succeeded' THEN CASE WHEN blank > 0 THEN 'failed' ELSE 'ready' END END AS index_state, CASE WHEN state = 'succeeded' AND coalesce(blank, 0) = 0 THEN coalesce(n, 0) END AS chunks_indexed FROM j LEFT JOIN c USING (job_id)",
)
def deferred_index(spark, d):
    """Jobs with the index that a second stream built once they were decided."""
    folder = _folder(spark, "deferred")
    names = F.create_map(*(F.lit(x) for p in {"view": "queued", "click": "running", "purchase": "succeeded", "error": "failed", "signup": "partial"}.items() for x in p))
    events = ingest.read_stream(spark, f"{d}/events.parquet*", read(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs = events.select("event_id", "ts", F.col("user_id").alias("job_id"), names[F.col("event_type")].alias("state"))
    states = ingest.job_states(jobs, "job_id", "ts", "state")
    chunks = read(spark, d, "documents").select((F.col("doc_id") % 160).alias("job_id"), F.when(F.col("doc_id") % 320 != 5, F.lit("chunk")).alias("text"))
    ingest.run_epochs(states, f"{folder}/states")
    ingest.index_decided(spark, f"{folder}/states", states.schema, "job_id", chunks, f"{folder}/indexed")
    latest = ingest.latest_versions(spark, f"{folder}/states/epochs", states.schema, ["job_id"])
    out = ingest.patched(latest, ingest.index_results(spark, f"{folder}/indexed", "job_id long"), "job_id")
    return out.select("job_id", "state", "index_state", "chunks_indexed")


_KINDS = ["malformed", "wrong type", "missing", "no markup"]


@query(
    "q113_batch_ingest",
    "WITH p AS (SELECT page_id, page_id % 16 AS f, CASE WHEN page_id % 16 = 13 OR page_id % 7 = 3 THEN 'malformed' WHEN page_id % 11 = 5 THEN 'wrong type' WHEN page_id % 13 = 2 THEN 'missing' WHEN page_id % 17 = 1 THEN 'no markup' END AS kind FROM pages) "
    "SELECT 'part=' || f AS file, count(*) AS rows, count(*) FILTER (kind IS NULL) AS good, count(*) FILTER (kind = 'malformed') AS malformed, count(*) FILTER (kind = 'wrong type') AS wrong_type, count(*) FILTER (kind = 'missing') AS missing, "
    "count(*) FILTER (kind = 'no markup') AS no_markup, CASE WHEN count(kind) = 0 THEN 'ok' WHEN count(kind) < count(*) THEN 'partial' ELSE 'failed' END AS status, CAST(coalesce(sum(CASE WHEN kind IS NULL THEN length(html) END), 0) AS BIGINT) AS chars FROM p JOIN pages USING (page_id) GROUP BY f",
)
def batch_ingest(spark, d):
    """All pages as files of JSON lines in which lines are broken by rule, read back with a report for each file."""
    pages = read(spark, d, "pages")
    k = F.col("page_id")
    broken = (k % 16 == 13) | (k % 7 == 3)
    fields = F.to_json(F.struct(k, F.when(~((k % 13 == 2) & (k % 11 != 5)), F.col("url")).alias("url"), F.when((k % 17 == 1) & (k % 13 != 2) & (k % 11 != 5), F.lit("plain")).otherwise(F.col("html")).alias("html")))
    line = F.when(broken, F.concat(F.lit('{"page_id": '), k.cast("string"), F.lit(', "url": "http'))).when(k % 11 == 5, F.replace(fields, F.concat(F.lit('"page_id":'), k.cast("string")), F.lit('"page_id":"x"'))).otherwise(fields)
    folder = _folder(spark, "batch")
    pages.select(line.alias("value"), (k % 16).alias("part")).repartition("part").write.partitionBy("part").text(folder)
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("page_id", LongType()), StructField("url", StringType()), StructField("html", StringType())])
    lines = Z.lines_of_files(spark, folder)
    rows = Z.parsed(lines, schema, ["page_id", "url", "html"], {"no markup": F.col("record.html").contains("<")})
    part = F.substring_index("file", "/", 1).alias("file")  # a folder stands for the file: how many parts a writer makes is its own affair
    rows = rows.withColumn("file", part)
    files = Z.files_of(spark, folder).groupBy(part).agg(F.sum("bytes").alias("bytes"))
    chars = Z.good_rows(rows).groupBy("file").agg(F.sum(F.length("html")).alias("chars"))
    found = Z.report(rows, lines.withColumn("file", part), files, _KINDS).join(chars, "file", "left")
    return found.select("file", "rows", "good", "malformed", "wrong_type", "missing", "no_markup", "status", F.coalesce("chars", F.lit(0)).alias("chars"))


@query(
    "q114_backfill",
    "SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'already' WHEN f.doc_id IS NOT NULL THEN 'stored' ELSE 'missing' END AS outcome, CASE WHEN d.doc_id % 3 = 0 THEN 'old' ELSE sha256(f.text) END AS content_hash, "
    "(SELECT count(DISTINCT sha256(coalesce(g.text, ''))) FROM documents g JOIN documents h ON h.doc_id // 2 * 2 = g.doc_id WHERE h.doc_id % 3 <> 0 AND g.doc_id % 4 = 0) AS stored, 1 AS versions "
    "FROM documents d LEFT JOIN documents f ON f.doc_id = d.doc_id // 2 * 2 AND f.doc_id % 4 = 0",
)
def backfill(spark, d):
    """Two runs of the backfill, of which the second writes nothing: outcome and digest of each row, and what is stored."""
    docs = read(spark, d, "documents")
    name = lambda c: F.concat(F.lit("in/"), c.cast("string"), F.lit(".txt"))
    rows = docs.select(F.col("doc_id").alias("name"), name(F.floor(F.col("doc_id") / 2) * 2).alias("source_file"), F.when(F.col("doc_id") % 3 == 0, "old").alias("content_hash"))
    files = docs.where("doc_id % 4 = 0").select(name(F.col("doc_id")).alias("source_file"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    path = _folder(spark, "store")
    B.backfill(rows, files, path)
    again = B.backfill(rows, files, path)
    kept = B.stored_digests(spark, path)
    stored = kept.agg(F.count("*").alias("stored"), F.countDistinct("version").cast("int").alias("versions"))
    return again.crossJoin(F.broadcast(stored)).select(F.col("name").alias("doc_id"), "outcome", "content_hash", "stored", "versions")


@query(
    "q125_page_tables",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey // 3 % 4 IN (0, 3) THEN 1 ELSE 0 END AS tables, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey // 3 % 4 IN (0, 3) THEN o_orderpriority END AS first_cell FROM orders",
)
def page_tables(spark, d):
    """Tables of pages: ruled ones if two rows and columns have lines, else aligned ones that are dense, even and short."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    grid = lambda a, b, c, e: F.array(F.array(a, b), F.array(c, e))
    blank = F.lit(None).cast("string")
    ruled = F.when(k % 3 == 0, F.array(grid(F.col("o_orderstatus"), blank, F.lit(""), F.lit("5")), F.array(F.array(F.lit("alone"))), grid(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))).when(k % 3 == 1, F.array(F.array(F.array(F.lit("one")), F.array(F.lit("column")))))
    which = F.floor(k / 3) % 4
    dense = grid(F.col("o_orderpriority"), F.lit("1"), F.lit("x"), F.lit("2"))
    aligned = F.when(which == 0, F.array(dense)).when(which == 1, F.array(grid(F.lit("a"), blank, F.lit(""), F.lit("b")))).when(which == 2, F.array(grid(F.repeat(F.lit("x"), 90), F.repeat(F.lit("y"), 90), F.lit("long prose " * 9), F.lit("cells " * 15)))).otherwise(F.array(dense))
    found = o.select("o_orderkey", P.page_tables(ruled, aligned).alias("t"))
    return found.select("o_orderkey", F.size("t").alias("tables"), F.get(F.get(F.get("t", 0), 0), 0).alias("first_cell"))


@query(
    "q126_label_units",
    "WITH k AS (SELECT s_suppkey, s_nationkey, s_name, CASE WHEN s_acctbal < 2000 THEN 'eliminate' ELSE 'pass' END AS status, CASE WHEN s_acctbal < 2000 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'criteria' ELSE 'document' END END AS ground FROM supplier) "
    "SELECT 'status' AS dimension, s_suppkey AS id, s_nationkey AS notification_id, s_name AS open_this, '' AS label, status AS committed FROM k UNION ALL SELECT 'ground', s_suppkey, s_nationkey, s_name, '', ground FROM k WHERE status = 'eliminate'",
)
def label_units(spark, d):
    """What a second rater is given in each dimension, beside the labels that are committed."""
    out, s = F.col("s_acctbal") < 2000, read(spark, d, "supplier")
    keys = s.select(
        F.col("s_suppkey").alias("vendor_id"), F.col("s_nationkey").alias("notification_id"), F.col("s_name").alias("file_name"), F.when(out, "eliminate").otherwise("pass").alias("intended_status"),
        F.when(out, F.when(F.col("s_suppkey") % 2 == 0, "criteria").otherwise("document")).alias("intended_ground"),
    )
    both = None
    for dimension in ("status", "ground"):
        units = T.label_units(keys, dimension).join(T.committed_labels(keys, dimension).withColumnRenamed("label", "committed"), "id")
        units = units.select(F.lit(dimension).alias("dimension"), "id", "notification_id", "open_this", "label", "committed")
        both = units if both is None else both.unionByName(units)
    return both


@query(
    "q127_payloads",
    "SELECT vec_id, '{\"chunk_id\":' || vec_id || CASE WHEN vec_id % 3 <> 0 THEN ',\"page\":' || vec_id % 40 ELSE '' END || CASE WHEN vec_id % 4 <> 0 THEN ',\"doc_kind\":\"bid\"' ELSE '' END || '}' AS payload, CASE WHEN vec_id % 4 <> 0 THEN 'bid' ELSE 'unknown' END AS doc_kind, "
    "CASE WHEN vec_id % 5 <> 0 THEN 'text ' || vec_id ELSE '' END AS text, round(vec_id / 7.0::DOUBLE, 4) AS score FROM embeddings",
)
def payloads(spark, d):
    """Stored payloads without empty fields, and hits with defaults for what a payload lacks."""
    k = F.col("vec_id")
    v = read(spark, d, "embeddings").select(
        k, k.alias("chunk_id"), F.when(k % 3 != 0, k % 40).alias("page"), F.when(k % 4 != 0, "bid").alias("doc_kind"), F.when(k % 5 != 0, F.concat(F.lit("text "), k.cast("string"))).alias("text"), (k / 7.0).alias("score")
    )
    stored = I.payload(v, ["chunk_id", "page", "doc_kind"])
    return E.hit_fields(stored).select("vec_id", "payload", "doc_kind", "text", "score")
