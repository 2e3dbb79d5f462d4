"""The opN queries over the driver's tables, and their DuckDB forms where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import licences
from .audit import filter_audit
from .chat import maximal_conversations
from .exact_dedup import exact_duplicates
from .language import language_scores
from .licences import known_table, licence_scan
from .mixing import DOMAINS, mixture
from .near_dedup import near_duplicates
from .pieces import default_model, encode_documents
from .quality import quality_scores
from .repetition import best_run, word_runs
from .rules import quality_rules
from .scratch import Scratch
from .toxicity import toxicity_scores
from .warc import pages_through_archives


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked at 3-word shingle similarity 0.85 or more."""
    return near_duplicates(_read(spark, sf_dir, "documents"), Scratch(spark), shingle_words=3, per_hundred=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
                      WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p WHERE 100 * c >= 85 * (nx + ny - c)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, u.y FROM r JOIN u ON r.other = u.x)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    ship(spark)
    return toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    ship(spark)
    return quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens (as digests) and scores of the four best segmentations, and whether decoding each gives the text."""
    ship(spark)
    found = encode_documents(_read(spark, sf_dir, "documents"), default_model(), n=4, digest=True)
    return found.select("doc_id", "n_tokens", "token_digest", "path_digests", "scores", F.size("scores").alias("n_best"), "decoded")


def op5_decision_list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the learned decision list's verdict on all documents."""
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), Scratch(spark))


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC and WARC archives and back."""
    return pages_through_archives(_read(spark, sf_dir, "pages"), Scratch(spark))


def op7_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of entire texts and of lines, for all documents."""
    found = licence_scan(_read(spark, sf_dir, "documents"), known_table(spark))
    return found.select("doc_id", "text_digest", "licence", F.array_join("line_licences", ", ").alias("line_licences"))


def _canonical_lines_sql(text: str) -> str:
    out = f"lower(regexp_replace(coalesce({text}, ''), '(?im){licences.COPYRIGHT}', '', 'g'))"
    for said, meant in licences.SPELLINGS:
        out = f"replace({out}, '{said}', '{meant}')"
    return rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"


def _canonical_sql(lines: str) -> str:
    return rf"regexp_replace(trim(regexp_replace({lines}, '[ \n]+', ' ', 'g')), '{licences.BEFORE}', '')"


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


OP7_SQL = f"""
WITH n(licence, body) AS (VALUES {_values(licences.NOTICES)}),
k AS (
  SELECT digest, min(licence) AS licence
  FROM (SELECT licence, sha256({_canonical_sql(_canonical_lines_sql('body'))}) AS digest FROM n
        UNION ALL SELECT licence, digest FROM (VALUES {_values(licences.DIGESTS)}) d(licence, digest))
  GROUP BY digest),
d AS (SELECT doc_id, row_number() OVER () AS r, {_canonical_lines_sql('text')} AS lines FROM documents),
l AS (
  SELECT r, string_agg(DISTINCT k.licence, ', ' ORDER BY k.licence) AS found
  FROM (SELECT r, unnest(string_split(lines, chr(10))) AS line FROM d) x JOIN k ON k.digest = sha256(trim(line))
  GROUP BY r),
w AS (SELECT doc_id, r, sha256({_canonical_sql('lines')}) AS text_digest FROM d)
SELECT doc_id, text_digest, licence, coalesce(found, '') AS line_licences
FROM w LEFT JOIN k ON k.digest = w.text_digest LEFT JOIN l USING (r)
"""


def op8_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts are equal without white space."""
    return exact_duplicates(_read(spark, sf_dir, "documents"), Scratch(spark))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and fitted rates of all documents."""
    mixed, names = mixture(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), Scratch(spark))
    share = [(F.round(f"p{names.index(n)}", 6) if n in names else F.lit(0.0)).alias(f"p_{n}") for n in DOMAINS.values()]
    return mixed.select("doc_id", "n_tokens", *share, F.round("rate", 6).alias("rate"))


def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of the maximal conversations."""
    kept = maximal_conversations(_read(spark, sf_dir, "conversations"), Scratch(spark))
    return kept.select("conv_id", "place", "turns", "rendered", "starts_at")


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS place, coalesce(role, '') AS role, coalesce(text, '') AS text,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (
  SELECT *, string_agg(len(role) || ':' || role || len(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS turns,
         sum(length(rendered)) OVER (PARTITION BY conv_id ORDER BY place) - length(rendered) AS starts_at
  FROM t),
e AS (SELECT prefix, turns, min(conv_id) AS conv_id FROM p WHERE place = turns GROUP BY prefix, turns),
k AS (SELECT conv_id FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = e.prefix AND p.place = e.turns AND p.turns > p.place))
SELECT p.conv_id, p.place, p.turns, p.rendered, CAST(p.starts_at AS BIGINT) AS starts_at FROM p JOIN k USING (conv_id)
"""

_WHITE = r"[\x20\x09-\x0D]+"


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the words of one document in ten repeated from some word on.

    Let h be crc32 of doc_id as text, and g = floor(h / 10). Where h is divisible by 10 and the text has n > 0 words,
    each word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    body, h = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")), F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("w").cast("long")
    some = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when((h % 10 == 0) & (body != ""), F.split(body, _WHITE)).alias("w"), g.alias("g"))
    some = some.withColumn("a", F.col("g") % n)
    some = some.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return some.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(changed).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, one in ten with a periodic tail, and their texts without the repetitions."""
    ship(spark)
    found = word_runs(with_periodic_tails(_read(spark, sf_dir, "documents"))).withColumn("best", best_run(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    ship(spark)
    return language_scores(_read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and lose in every order, by language."""
    return filter_audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), Scratch(spark))


OP13_SQL = r"""
WITH known AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY body) AS least FROM t),
f AS (
  SELECT doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w),
m AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN known USING (doc_id) GROUP BY part, fails),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
h AS (
  SELECT *, coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda x: x <> ''), lambda x: instr(filter_order, x))), 9) AS falls
  FROM m, o),
s AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS x, sum(CASE WHEN falls > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN falls = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN falls < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN falls = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN falls = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, range(1, 6) r(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM s
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_nnpu_toxicity": op2_nnpu_toxicity,
    "op3_nbsvm_quality": op3_nbsvm_quality,
    "op4_sentencepiece_nbest": op4_sentencepiece_nbest,
    "op5_decision_list_rules": op5_decision_list_rules,
    "op6_arc_to_warc": op6_arc_to_warc,
    "op7_licence_digests": op7_licence_digests,
    "op8_lsm_exact_dedup": op8_lsm_exact_dedup,
    "op9_soft_mixing": op9_soft_mixing,
    "op10_snapshot_collapse": op10_snapshot_collapse,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_string_kernel_language": op12_string_kernel_language,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op7_licence_digests": OP7_SQL,
    "op8_lsm_exact_dedup": OP8_SQL,
    "op10_snapshot_collapse": OP10_SQL,
    "op13_filter_audit": OP13_SQL,
}
