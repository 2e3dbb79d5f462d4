"""Storage, retrieval, statistics, pages and jobs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import vocabulary as V
from ..operators import jobs as J
from ..operators import pages as P
from ..operators import retrieval as X
from ..operators import statistics as T
from ..operators import storage as G
from .base import pick, pick_sql, query, quoted, read

# ------------------------------------------------------------ scans, joins, counts


@query(
    "q23_submission_counts",
    "WITH c AS (SELECT c_nationkey, count(*) AS submissions FROM customer GROUP BY ALL) SELECT n_nationkey, n_name, coalesce(submissions, 0) AS submissions, (SELECT count(*) FROM nation) AS total FROM nation LEFT JOIN c ON n_nationkey = c_nationkey ORDER BY n_name LIMIT 10 OFFSET 5",
)
def submission_counts(spark, d):
    """A page of tenders with their numbers of submissions and the total (a paged list)."""
    n, c = read(spark, d, "nation"), read(spark, d, "customer")
    total = n.agg(F.count("*").alias("total"))
    page = n.orderBy("n_name").offset(5).limit(10)
    counts = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("submissions"))
    return page.join(counts, "n_nationkey", "left").crossJoin(total).select("n_nationkey", "n_name", F.coalesce("submissions", F.lit(0)).alias("submissions"), "total")


@query(
    "q24_nested_children",
    "WITH l AS (SELECT l_orderkey, count(*) AS lines, string_agg(l_linenumber || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS children FROM lineitem GROUP BY ALL) "
    "SELECT c_name, o_orderkey, coalesce(lines, 0) AS lines, coalesce(children, '') AS children FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'",
)
def nested_children(spark, d):
    """Parents with their children in order, none being an empty list."""
    kids = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("kids")
    )
    parents = read(spark, d, "orders").where("o_orderstatus = 'F'").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    text = F.array_join(F.transform("kids", lambda k: F.concat(k["l_linenumber"].cast("string"), F.lit(":"), k["l_quantity"].cast("bigint").cast("string"))), ",")
    return parents.join(kids, "o_orderkey", "left").select("c_name", "o_orderkey", F.coalesce(F.size("kids"), F.lit(0)).cast("long").alias("lines"), F.coalesce(text, F.lit("")).alias("children"))


@query(
    "q26_scope_filter",
    "SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND d.source IN ('src1', 'src2', 'src3') AND (l.toxic = 0 OR d.doc_id % 2 = 0)",
)
def scope_filter(spark, d):
    """Rows that a role may see: own rows, or any for a reviewer; scoped by equality and membership."""
    rows = read(spark, d, "documents").select("doc_id", "source", "lang").join(read(spark, d, "labels"), "doc_id")
    rows = X.scoped(rows, lang="en").where(F.col("source").isin("src1", "src2", "src3"))
    return rows.where((F.col("toxic") == 0) | (F.col("doc_id") % 2 == 0)).select("doc_id", "source")


@query("q57_missing_units", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_units(spark, d):
    """Documents that were expected to be labelled and are not."""
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left_anti")


@query("q56_once_per_text", "SELECT d.doc_id, sha256(d.text) AS digest, count(*) OVER (PARTITION BY d.text) AS shared_by FROM documents d")
def once_per_text(spark, d):
    """Each distinct text once for an expensive function, and its result back on every row."""
    docs = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    once = docs.groupBy("digest").agg(F.count("*").alias("shared_by"))
    return docs.join(once, "digest").select("doc_id", "digest", "shared_by")


@query(
    "q58_cache_upsert",
    "WITH r AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT key, min(doc_id) AS owner FROM r WHERE doc_id % 3 = 0 GROUP BY key), n AS (SELECT key, min(doc_id) AS owner FROM r WHERE key NOT IN (SELECT key FROM c) GROUP BY key) "
    "SELECT r.doc_id, c.key IS NOT NULL AS hit, coalesce(c.owner, n.owner) AS owner FROM r LEFT JOIN c USING (key) LEFT JOIN n USING (key)",
)
def cache_upsert(spark, d):
    """Lookups in a cache of a third of the documents, and the rows that misses add to it."""
    r = read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    cache = G.insert_if_absent(r.limit(0).select("key"), r.where("doc_id % 3 = 0"), ["key"], ["doc_id"]).withColumnRenamed("doc_id", "payload")
    added = G.insert_if_absent(cache.select("key"), r, ["key"], ["doc_id"]).withColumnRenamed("doc_id", "first")
    looked = G.cache_lookup(r, cache, ["key"]).join(added, "key", "left")
    return looked.select("doc_id", "hit", F.coalesce("payload", "first").alias("owner"))


@query(
    "q61_upsert",
    "WITH o AS (SELECT o_custkey, min_by(o_totalprice, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400)) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), n AS (SELECT o_custkey, max_by(o_totalprice, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400)) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) "
    "SELECT o_custkey, coalesce(n.v, o.v) AS value FROM o FULL JOIN n USING (o_custkey)",
)
def upsert(spark, d):
    """Stored rows replaced by the newest new row of the same key."""
    at = F.expr("o_orderdate + make_interval(0, 0, 0, 0, 0, 0, o_orderkey % 86400)")
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("value"), at.alias("at"))
    columns = ["o_custkey", "value", "at"]
    return G.upsert(o.where("o_orderkey % 2 = 0").select(*columns), o.where("o_orderkey % 2 = 1").select(*columns), ["o_custkey"], "at").select("o_custkey", "value")


@query(
    "q62_tracking_merge",
    "WITH o AS (SELECT doc_id, lang, 'old' AS note, doc_id % 4 = 0 AS owned FROM documents), n AS (SELECT doc_id, quality FROM labels) "
    "SELECT doc_id, lang, note, NULL AS quality FROM o WHERE NOT owned AND doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT n.doc_id, NULL, o.note, n.quality FROM n LEFT JOIN o USING (doc_id)",
)
def tracking_merge(spark, d):
    """A tracking table merged: owned rows replaced, others kept, columns united."""
    docs = read(spark, d, "documents").select("doc_id", "lang", F.lit("old").alias("note"))
    new = read(spark, d, "labels").select("doc_id", "quality")
    return G.merge_tracking(docs, new, "doc_id", F.col("doc_id") % 4 == 0, ["note"])


@query("q63_renormalise", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3")
def renormalise(spark, d):
    """Rows whose stored amount no longer is what their printed text says."""
    from ..functions.money import money_inr

    o = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Rs. "), (F.col("o_orderkey") % 50).cast("string"), F.lit(" lakh")).alias("raw"))
    stored = ((F.col("o_orderkey") % 50) * 100000 + F.when(F.col("o_orderkey") % 10 == 3, 1).otherwise(0)).cast("decimal(18,2)")
    return G.changed(o.withColumn("stored", stored), F.col("stored"), money_inr(F.col("raw"))).select("o_orderkey")


# ------------------------------------------------------------ retrieval

_DOT = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
_ALL = f"SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {_DOT.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@query(
    "q31_vector_topk",
    f"WITH a AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {_DOT.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM a) "
    "SELECT query_id, chunk_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10 AND s >= 0.05",
)
def vector_topk(spark, d):
    """The ten chunks nearest to each question (a top-k report) with a least score; every 50th vector asks."""
    v = _vectors(spark, d).select("chunk_id", "embedding")
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    found = X.nearest(q, v, 10, min_score=0.05)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(
    "q32_vector_scoped",
    f"WITH a AS ({_ALL} AND q.label = e.label WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM a) SELECT query_id, chunk_id, rank FROM r WHERE rank <= 5",
)
def vector_scoped(spark, d):
    """The five nearest chunks within each question's scope; every 50th vector asks."""
    v = _vectors(spark, d)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    found = X.nearest(q, v, 6, ["label"]).where("query_id <> chunk_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5").select("query_id", "chunk_id", "rank")


@query(
    "q33_vector_pair",
    f"WITH a AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, e.label AS side, {_DOT.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q JOIN embeddings e ON e.label IN (0, 1) WHERE q.vec_id % 50 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id, side ORDER BY s DESC, chunk_id) AS n FROM a), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, side, n) AS place FROM r WHERE n <= 3) SELECT query_id, chunk_id, CAST(side AS BIGINT) AS side, place FROM h WHERE place <= 6",
)
def vector_pair(spark, d):
    """Half of the answer from notices, half from bids, merged by score."""
    v = _vectors(spark, d)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    sides = [X.nearest(q, v.where(F.col("label") == side).select("chunk_id", "embedding"), 6) for side in (0, 1)]
    return X.nearest_of_pair(*sides, 6).select("query_id", "chunk_id", F.col("side").cast("long").alias("side"), F.col("place").cast("long").alias("place"))


@query(
    "q118_nearest_of_all",
    f"WITH a AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {_DOT.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM a) "
    "SELECT query_id, chunk_id, rank, round(s, 6) AS score FROM r WHERE rank <= 5",
)
def nearest_of_all(spark, d):
    """The five nearest others of every vector (a top-k report): every vector asks."""
    v = _vectors(spark, d).select("chunk_id", "embedding")
    found = X.nearest(v.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q")), v, 6).where("query_id <> chunk_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    found = found.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 5")
    return found.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_STOP = ", ".join(quoted(w) for w in V.BM25_STOPWORDS)
_TOKENS = "list_filter(list_transform(regexp_extract_all(lower(coalesce({x}, '')), " + quoted(Q.TOKEN) + "), lambda t: trim(t, '.,')), lambda t: t <> '' AND t NOT IN (" + _STOP + "))"


@query(
    "q34_bm25",
    f"WITH dt AS (SELECT doc_id, {_TOKENS.format(x='text')} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM dt), q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format(x='text')}) AS term FROM benchmark) GROUP BY ALL), "
    "c AS (SELECT doc_id, len(t) AS length, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM dt) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM c GROUP BY ALL), "
    "s AS (SELECT query_id, doc_id, sum(times * greatest(1e-9, ln(1 + (n - df + 0.5) / (df + 0.5))) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS s FROM c JOIN df USING (term) JOIN q USING (term), n GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank, round(s, 6) AS score FROM r WHERE rank <= 10",
)
def bm25(spark, d):
    """The ten best documents for every benchmark passage (a top-k report)."""
    queries = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = X.bm25_top(read(spark, d, "documents"), queries, 10)
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), "score")


_TOP5 = f"a AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, q.label = e.label AS relevant, {_DOT.format(a='q.embedding', b='e.embedding')} AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM a)"


def _top5(spark, d):
    v = _vectors(spark, d)
    q = v.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    found = X.nearest(q, v.select("chunk_id", "embedding"), 6).where("query_id <> chunk_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    found = found.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    labels = v.select("chunk_id", "label")
    return found.join(labels, "chunk_id").join(labels.select(F.col("chunk_id").alias("query_id"), F.col("label").alias("own")), "query_id").withColumn("relevant", F.col("label") == F.col("own"))


@query(
    "q35_retrieval_metrics",
    f"WITH {_TOP5} SELECT query_id, CAST(bool_or(rank <= 1 AND relevant) AS INTEGER) AS hit_1, CAST(bool_or(rank <= 3 AND relevant) AS INTEGER) AS hit_3, CAST(bool_or(relevant) AS INTEGER) AS hit_5, avg(CAST(relevant AS INTEGER)) AS precision, coalesce(1.0 / CAST(min(rank) FILTER (relevant) AS DOUBLE), 0.0) AS rr FROM r WHERE rank <= 5 GROUP BY query_id",
)
def retrieval_metrics(spark, d):
    """Hits, precision and reciprocal rank of questions, labels being relevance."""
    return X.metrics(_top5(spark, d), [1, 3, 5])


@query(
    "q36_confidence",
    f"WITH {_TOP5}, b AS (SELECT query_id, max(s) AS best FROM r GROUP BY query_id) SELECT query_id, CASE WHEN best >= 0.62 THEN 'high' WHEN best >= 0.45 THEN 'low' ELSE 'none' END AS confidence, round(best, 6) AS best FROM b",
)
def confidence(spark, d):
    """How sure an answer may be, from its best score."""
    best = _top5(spark, d).groupBy("query_id").agg(F.max("score").alias("best"))
    return best.select("query_id", Q.confidence(F.col("best")).alias("confidence"), F.round("best", 6).alias("best"))


# ------------------------------------------------------------ statistics


@query(
    "q48_wilson",
    "WITH g AS (SELECT doc_id % 10 AS g, sum(quality) AS k, CAST(count(*) AS DOUBLE) AS n FROM labels GROUP BY ALL), w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g) "
    "SELECT g, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS high FROM w",
)
def wilson(spark, d):
    """Shares of good documents with their intervals."""
    g = read(spark, d, "labels").groupBy((F.col("doc_id") % 10).alias("g")).agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    w = g.withColumn("w", T.wilson(F.col("k"), F.col("n")))
    return w.select("g", "k", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(
    "q49_sign_test",
    "WITH c AS (SELECT doc_id % 20 AS g, count(*) FILTER (toxic > quality) AS b, count(*) FILTER (toxic < quality) AS w, count(*) FILTER (toxic = quality) AS tied FROM labels GROUP BY ALL), "
    "p AS (SELECT g, b, w, tied, i, exp(lgamma(b + w + 1) - lgamma(i + 1) - lgamma(b + w - i + 1) - (b + w) * ln(2)) AS m FROM c, range(0, 100000) r(i) WHERE i <= least(b, w)) "
    "SELECT g, b AS improved, w AS regressed, tied, round(CASE WHEN b + w = 0 THEN 1.0 ELSE least(1.0, 2 * sum(m)) END, 6) AS p FROM p GROUP BY g, b, w, tied",
)
def sign_test(spark, d):
    """Paired counts and exact p, toxic against quality, in twenty groups."""
    g = read(spark, d, "labels").groupBy((F.col("doc_id") % 20).alias("g")).agg(
        F.count_if(F.col("toxic") > F.col("quality")).alias("improved"), F.count_if(F.col("toxic") < F.col("quality")).alias("regressed"), F.count_if(F.col("toxic") == F.col("quality")).alias("tied")
    )
    return g.withColumn("p", F.round(T.sign_test(F.col("improved"), F.col("regressed")), 6))


@query(
    "q123_sign_test_texts",
    "WITH c AS (SELECT doc_id % 20 AS g, count(*) FILTER (toxic > quality) AS b, count(*) FILTER (toxic < quality) AS w, count(*) FILTER (toxic = quality) AS t FROM labels GROUP BY ALL), "
    "p AS (SELECT g, b, w, t, CASE WHEN b + w = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(b + w + 1) - lgamma(i + 1) - lgamma(b + w - i + 1) - (b + w) * ln(2)))) END AS p FROM c, range(0, 100000) r(i) WHERE i <= least(b, w) GROUP BY g, b, w, t) "
    "SELECT g, b || ' improved / ' || w || ' regressed' || CASE WHEN t > 0 THEN ' / ' || t || ' tied' ELSE '' END || ', p=' || printf('%.4f', round_even(round(p, 12), 4)) || ', ' || CASE WHEN p < 0.05 THEN 'significant at 0.05' ELSE 'NOT significant at 0.05' END AS said, CASE WHEN p < 0.01 THEN 'p<0.0100' ELSE 'p=' || printf('%.4f', round_even(round(p, 12), 4)) END AS of_resamples FROM p",
)
def sign_test_texts(spark, d):
    """The same comparison in words, and as a hundred resamples could tell it."""
    g = read(spark, d, "labels").groupBy((F.col("doc_id") % 20).alias("g")).agg(
        F.count_if(F.col("toxic") > F.col("quality")).alias("b"), F.count_if(F.col("toxic") < F.col("quality")).alias("w"), F.count_if(F.col("toxic") == F.col("quality")).alias("t")
    )
    return g.select("g", T.sign_test_text(F.col("b"), F.col("w"), F.col("t")).alias("said"), T.p_text(T.sign_test(F.col("b"), F.col("w")), 100).alias("of_resamples"))


@query(
    "q50_kappa",
    "WITH x AS (SELECT quality AS a, 1 - toxic AS b FROM labels), n AS (SELECT count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po FROM x), e AS (SELECT sum(r.c * s.c) / CAST((SELECT n * n FROM n) AS DOUBLE) AS pe FROM (SELECT a, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY a) r JOIN (SELECT b, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY b) s ON r.a = s.b) "
    "SELECT n, round(po, 6) AS observed, round(pe, 6) AS expected, round(CASE WHEN pe >= 1 THEN CAST(po >= 1 AS INTEGER) ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM n, e",
)
def kappa(spark, d):
    """Agreement of two raters beyond chance."""
    k = T.kappa(read(spark, d, "labels").withColumn("b", 1 - F.col("toxic")), "quality", "b")
    return k.select("n", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


@query("q51_bootstrap")
def bootstrap(spark, d):
    """Mean of quality less toxicity with a bootstrap interval."""
    v = read(spark, d, "labels").select((F.col("quality") - F.col("toxic")).cast("double").alias("v"))
    return T.bootstrap_mean(v, "v", resamples=10_000)


@query(
    "q52_confusion",
    "WITH c AS (SELECT lang, count(*) FILTER (quality = 0 AND n_chars < 1000) AS tp, count(*) FILTER (quality = 1 AND n_chars >= 1000) AS tn, count(*) FILTER (quality = 1 AND n_chars < 1000) AS fp, count(*) FILTER (quality = 0 AND n_chars >= 1000) AS fn FROM documents JOIN labels USING (doc_id) GROUP BY lang), "
    "p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall FROM c) "
    "SELECT lang, tp, tn, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS accuracy FROM p",
)
def confusion(spark, d):
    """How well short length predicts bad quality, per language."""
    rows = read(spark, d, "documents").select("doc_id", "lang", "n_chars").join(read(spark, d, "labels"), "doc_id")
    rows = rows.select("lang", (F.col("quality") == 0).alias("actual"), (F.col("n_chars") < 1000).alias("predicted"))
    c = T.confusion(rows, "actual", "predicted", ["lang"])
    return c.select("lang", "tp", "tn", "fp", "fn", *(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "accuracy")))


# ------------------------------------------------------------ jobs

_STATE = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'partial' END"


def _jobs(spark, d):
    e = read(spark, d, "events")
    names = F.create_map(*(F.lit(x) for p in {"view": "queued", "click": "running", "purchase": "succeeded", "error": "failed", "signup": "partial"}.items() for x in p))
    return e.select("event_id", "ts", F.col("user_id").alias("job_id"), names[F.col("event_type")].alias("state"), "value")


@query(
    "q45_perf_pulse",
    "WITH r AS (SELECT value AS s, CAST(json_extract(props, '$.k') AS BIGINT) < 30 AS cached FROM events WHERE event_type IN ('purchase', 'error') ORDER BY ts DESC, event_id DESC LIMIT 200) "
    "SELECT count(*) AS jobs, count(s) AS measured, round(quantile_cont(s, 0.5), 6) AS median_s, round(quantile_cont(s, 0.95), 6) AS p95_s, round(avg(CAST(cached AS INTEGER)), 6) AS cached FROM r",
)
def perf_pulse(spark, d):
    """Speed of the last 200 finished jobs (a report over the latest)."""
    e = read(spark, d, "events").where("event_type IN ('purchase', 'error')")
    rows = e.select("ts", "event_id", "value", (F.get_json_object("props", "$.k").cast("long") < 30).alias("from_cache"))
    p = J.pulse(rows, "value", ["ts", "event_id"])
    return p.select("jobs", "measured", F.round("median_s", 6).alias("median_s"), F.round("p95_s", 6).alias("p95_s"), F.round("cached", 6).alias("cached"))


@query("q46_fifo_claim", f"WITH j AS (SELECT event_id, ts, user_id % 8 AS lane FROM events WHERE {_STATE} = 'queued') SELECT lane, arg_min(event_id, (ts, event_id)) AS event_id FROM j GROUP BY lane")
def fifo_claim(spark, d):
    """The oldest queued job of each lane."""
    q = _jobs(spark, d).where("state = 'queued'").select("event_id", "ts", (F.col("job_id") % 8).alias("lane"))
    return J.claim(q, ["lane"], ["ts", "event_id"]).select("lane", "event_id")


_JOBSTATE = f"WITH l AS (SELECT user_id AS job_id, arg_max({_STATE}, (ts, event_id)) AS state, count(*) AS events, max(ts) AS changed_at FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events) SELECT job_id, CASE WHEN state = 'running' AND changed_at <= now - INTERVAL 20 MINUTE THEN 'failed' ELSE state END AS state, state = 'running' AND changed_at <= now - INTERVAL 20 MINUTE AS timed_out, events FROM l, n"


@query("q47_job_state", _JOBSTATE)
def job_state(spark, d):
    """The state of each job, those running for too long counted as failed."""
    e = _jobs(spark, d)
    states = J.latest_state(e, "job_id", ["ts", "event_id"], "state").crossJoin(e.agg(F.max("ts").alias("now")))
    return J.with_timeout(states, F.col("now")).select("job_id", "state", "timed_out", "events")


@query("q60_stream_states", f"SELECT user_id AS job_id, arg_max({_STATE}, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY ALL")
def stream_states(spark, d):
    """Job states as a stream over the event files, run over what is there."""
    from ..streaming import ingest

    events = ingest.read_stream(spark, f"{d}/events.parquet*", read(spark, d, "events").schema)
    names = F.create_map(*(F.lit(x) for p in {"view": "queued", "click": "running", "purchase": "succeeded", "error": "failed", "signup": "partial"}.items() for x in p))
    jobs = events.select("event_id", "ts", F.col("user_id").alias("job_id"), names[F.col("event_type")].alias("state"))
    return ingest.run_available(ingest.job_states(jobs, "job_id", "ts", "state"), ["job_id"]).select("job_id", "state", "events")


@query(
    "q64_rate_limit",
    "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "b AS (SELECT user_id, event_id, t, n, CAST(500.0 AS DOUBLE) AS level FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.t, o.n, least(2000.0, b.level + (o.t - b.t) * 0.1) - 1500.0 FROM b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1) "
    "SELECT event_id, round(greatest(0.0, -level / 0.1), 1) AS wait FROM b",
)
def rate_limit(spark, d):
    """How long requests of a key wait on a token bucket that may go into debt."""
    e = read(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.lit(1500.0).alias("cost"))
    return J.rate_limit(e, "user_id", "at", "cost", 0.1, 2000.0, "event_id").select("event_id", F.round("wait", 1).alias("wait"))


@query(
    "q53_quality_rollup",
    "WITH f AS (SELECT doc_id AS subject, 'fresh' AS source, 'n_chars' AS field, 'short' AS message, n_chars < 300 AS affects, 'error' AS severity FROM documents WHERE n_chars < 600 UNION ALL SELECT doc_id, 'stored', 'quality', 'junk', true, 'warning' FROM labels WHERE quality = 0) "
    "SELECT subject, count(*) AS findings, count(*) FILTER (affects AND severity = 'error') AS errors, count(*) FILTER (affects AND severity = 'warning') AS warnings, bool_or(affects) AS affects_confidence FROM f GROUP BY subject",
)
def quality_rollup(spark, d):
    """Findings per document from a fresh check and from stored labels."""
    fresh = read(spark, d, "documents").where("n_chars < 600").select(F.col("doc_id").alias("subject"), F.lit("n_chars").alias("field"), F.lit("short").alias("message"), (F.col("n_chars") < 300).alias("affects"), F.lit("error").alias("severity"))
    stored = read(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("subject"), F.lit("quality").alias("field"), F.lit("junk").alias("message"), F.lit(True).alias("affects"), F.lit("warning").alias("severity"))
    return J.quality_rollup(fresh, stored)


# ------------------------------------------------------------ pages


@query(
    "q40_section_scope",
    r"WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents), "
    "h AS (SELECT *, CASE WHEN length(line) < 60 AND ends_with(line, '.') THEN line END AS head FROM l), s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading FROM h) SELECT doc_id, coalesce(heading, '-') AS heading, count(*) AS lines FROM s GROUP BY ALL",
)
def section_scope(spark, d):
    """How many lines stand under each heading of each document."""
    lines = P.lines_of(read(spark, d, "documents"))
    head = F.when((F.length("line") < 60) & F.col("line").endswith("."), F.col("line"))
    return P.section_scope(lines, head).groupBy("doc_id", F.coalesce("heading", F.lit("-")).alias("heading")).agg(F.count("*").alias("lines"))


@query(
    "q41_labelled_values",
    r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_line FROM l) "
    r"SELECT doc_id, line_no, coalesce(nullif(trim(regexp_extract(line, '(?i)licensed under\s*[:\-–]?\s*(.*)$', 1)), ''), trim(next_line)) AS value FROM n WHERE regexp_matches(line, '(?i)licensed under')",
)
def labelled_values(spark, d):
    """Values after a label, or on the next line."""
    found = P.labelled_values(P.lines_of(read(spark, d, "documents")), "licensed under")
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "value")


_CUES = ["the", "tion", "nicht"]
_HITS = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) / {len(c)}.0" for c in _CUES)


@query(
    "q42_page_select",
    f"WITH p AS (SELECT source AS doc, doc_id AS page_number, length(text) AS chars, lower(text) AS t FROM documents), s AS (SELECT *, round(sqrt({_HITS}) / sqrt(greatest(length(t) / 1000.0, 1.0)), 9) AS score, sum(chars) OVER (PARTITION BY doc) AS total, row_number() OVER (PARTITION BY doc ORDER BY page_number) AS place FROM p), "
    "b AS (SELECT *, max(score) OVER (PARTITION BY doc) AS best FROM s), w AS (SELECT * FROM b WHERE total <= 12000 OR (best > 0 AND score > 0 AND score >= best * 0.25) OR place <= 2 OR (best = 0 AND place <= 10)), "
    "u AS (SELECT *, sum(chars) OVER (PARTITION BY doc ORDER BY page_number) AS used, row_number() OVER (PARTITION BY doc ORDER BY page_number) AS n FROM w) SELECT doc, page_number, CAST(used AS BIGINT) AS used FROM u WHERE used <= 12000 OR n = 1",
)
def page_select(spark, d):
    """Pages of each source that speak of the cues, under a budget."""
    pages = read(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text")
    return P.select_pages(pages, _CUES, 12_000, first=2).select(F.col("doc_id").alias("doc"), "page_number", "used")


@query("q43_chunk_text")
def chunk_text(spark, d):
    """Chunks of all documents."""
    return P.chunks(read(spark, d, "documents"))


_CELLS = ["Item", "Qty", "17 August 2026", "", "Rate", "Amount due"]


@query(
    "q44_table_rows",
    f"WITH r AS (SELECT o_orderkey, unnest(range(0, 4)) AS i FROM orders), c AS (SELECT o_orderkey, i, {pick_sql(_CELLS, 'o_orderkey + i')} AS a, {pick_sql(_CELLS, 'o_orderkey // 5 + 2 * i')} AS b FROM r), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1 AS row_no, count(*) OVER (PARTITION BY o_orderkey) AS n, trim(a || ' | ' || b, ' |') AS rendered FROM c WHERE a <> '' OR b <> ''), "
    "h AS (SELECT *, max(CASE WHEN row_no = 0 AND n >= 3 AND a <> '' AND b <> '' AND NOT regexp_matches(a || b, '[0-9]') THEN rendered END) OVER (PARTITION BY o_orderkey) AS header FROM f) "
    "SELECT CAST(o_orderkey AS BIGINT) AS doc_id, row_no, '[table on page 1] ' || CASE WHEN header IS NOT NULL THEN header || chr(10) || rendered ELSE rendered END AS text FROM h WHERE header IS NULL OR row_no > 0",
)
def table_rows(spark, d):
    """One chunk per table row, headers repeated."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders")
    rows = F.array(*(F.array(pick(_CELLS, k + i), pick(_CELLS, F.floor(k / 5).cast("long") + 2 * i)) for i in range(4)))
    pages = o.select(k.alias("doc_id"), F.lit(1).alias("page_number"), F.array(rows).alias("tables"))
    return P.table_row_chunks(pages).select("doc_id", F.col("row_no").cast("long").alias("row_no"), "text")


@query(
    "q55_facets",
    "SELECT s_suppkey, CASE WHEN contains(lower(s_name), '12') THEN 100 - (strpos(lower(s_name), '12') - 1) / 100.0 ELSE 0 END AS rank FROM supplier WHERE s_acctbal > 1000 AND contains(lower(s_name || ' ' || s_nationkey), '1')",
)
def facets(spark, d):
    """A facet with a search word, and the palette rank of another."""
    s = read(spark, d, "supplier").where("s_acctbal > 1000").where(F.lower(F.concat_ws(" ", "s_name", F.col("s_nationkey").cast("string"))).contains("1"))
    at = F.instr(F.lower("s_name"), "12")
    return s.select("s_suppkey", F.when(at > 0, 100 - (at - 1) / 100.0).otherwise(0.0).alias("rank"))
