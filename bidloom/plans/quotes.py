"""Queries of quoted text: where snippets stand, lines of words, names by a fragment, values of headers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import headers as H
from ..operators import alignment as A
from ..operators import fragments as G
from ..operators import lines as L
from ..operators import pages as P
from .base import pick, pick_sql, query, quoted, read


def _words_sql(text: str) -> str:
    return rf"list_transform(regexp_extract_all(coalesce({text}, ''), '[\p{{L}}\p{{N}}]+'), lambda x: lower(x))"


def _seeds_sql(t: str) -> str:
    return f"CASE WHEN len({t}) >= 3 THEN list_transform(range(1, len({t}) - 1), lambda i: {t}[i] || ' ' || {t}[i + 1] || ' ' || {t}[i + 2]) ELSE [] END"


# The alignment as a recursion over regions: the longest run of equal words in a region, then what lies left and right of it.
_ALIGN_SQL = f"""
WITH RECURSIVE s AS (SELECT item_id, {_words_sql('text')} AS t FROM benchmark), p AS (SELECT doc_id, {_words_sql('text')} AS t FROM documents),
pairs AS (
  SELECT DISTINCT item_id, doc_id
  FROM (SELECT item_id, unnest({_seeds_sql('t')}) AS g FROM s) x JOIN (SELECT doc_id, unnest({_seeds_sql('t')}) AS g FROM p) y USING (g)),
pw AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i FROM p WHERE doc_id IN (SELECT doc_id FROM pairs)),
sw AS (SELECT item_id, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS j FROM s),
m AS (
  SELECT item_id, doc_id, i, j, i - row_number() OVER (PARTITION BY item_id, doc_id, i - j ORDER BY i) AS island
  FROM pairs JOIN pw USING (doc_id) JOIN sw USING (item_id) WHERE pw.w = sw.w),
runs AS (SELECT item_id, doc_id, min(i) AS a, min(j) AS b, count(*) AS n FROM m GROUP BY item_id, doc_id, i - j, island),
rec AS (
  SELECT item_id, doc_id, 0::BIGINT AS pf, 1000000000::BIGINT AS pt, 0::BIGINT AS sf, 1000000000::BIGINT AS st, min([-n, a, b]) AS best FROM runs GROUP BY item_id, doc_id
  UNION ALL
  SELECT item_id, doc_id, pf, pt, sf, st, min([-n, a, b]) AS best
  FROM (
    SELECT c.*, r.a + d AS a, r.b + d AS b, least(r.n - d, pt - r.a - d, st - r.b - d) AS n
    FROM (
      SELECT item_id, doc_id, CASE side WHEN 0 THEN pf ELSE best[2] - best[1] END AS pf, CASE side WHEN 0 THEN best[2] ELSE pt END AS pt,
             CASE side WHEN 0 THEN sf ELSE best[3] - best[1] END AS sf, CASE side WHEN 0 THEN best[3] ELSE st END AS st
      FROM rec, (VALUES (0), (1)) v(side)) c
    JOIN runs r USING (item_id, doc_id), LATERAL (SELECT greatest(0, pf - r.a, sf - r.b) AS d) l) k
  WHERE n > 0 GROUP BY item_id, doc_id, pf, pt, sf, st),
b0 AS (SELECT item_id, doc_id, best[2] AS a, best[3] AS b, -best[1] AS n FROM rec),
b1 AS (SELECT *, CASE WHEN lag(a + n) OVER w = a AND lag(b + n) OVER w = b THEN 0 ELSE 1 END AS starts FROM b0 WINDOW w AS (PARTITION BY item_id, doc_id ORDER BY a, b)),
b2 AS (SELECT *, sum(starts) OVER (PARTITION BY item_id, doc_id ORDER BY a, b) AS block FROM b1),
blocks AS (SELECT item_id, doc_id, min(a) AS a, sum(n) AS n FROM b2 GROUP BY item_id, doc_id, block),
anchors AS (SELECT item_id, doc_id, min([-n, a])[2] AS mid FROM blocks GROUP BY ALL),
f AS (
  SELECT item_id, doc_id, len(s.t) AS n_words, CAST(sum(n) AS BIGINT) AS matched, min(a) AS first_word, max(a + n - 1) AS last_word
  FROM blocks JOIN anchors USING (item_id, doc_id) JOIN s USING (item_id) WHERE abs(a - mid) <= greatest(len(s.t), 8) GROUP BY item_id, doc_id, s.t)
SELECT item_id, doc_id, n_words, matched, round(matched / CAST(n_words AS DOUBLE), 6) AS ratio, CASE WHEN matched / CAST(n_words AS DOUBLE) >= 0.55 THEN CAST(first_word AS BIGINT) END AS first_word,
  CASE WHEN matched / CAST(n_words AS DOUBLE) >= 0.55 THEN CAST(last_word AS BIGINT) END AS last_word FROM f
"""


@query("q108_highlight_align", _ALIGN_SQL)
def highlight_align(spark, d):
    """Where benchmark passages stand in documents: every pair that shares three words in a row."""
    snippets = read(spark, d, "benchmark").select(F.col("item_id").alias("snippet_id"), "text")
    pages = read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    found = A.align(pages, snippets)
    return found.select(F.col("snippet_id").alias("item_id"), F.col("page_id").alias("doc_id"), "n_words", "matched", F.round("ratio", 6).alias("ratio"), "first_word", "last_word")


_LINE_HOURS = 6


@query(
    "q109_line_groups",
    "WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    f"r AS (SELECT user_id, event_id, t, n, t AS anchor, event_id AS first_event FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.t, o.n, CASE WHEN o.t - r.anchor > {_LINE_HOURS * 3600} THEN o.t ELSE r.anchor END, "
    f"CASE WHEN o.t - r.anchor > {_LINE_HOURS * 3600} THEN o.event_id ELSE r.first_event END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1) "
    "SELECT user_id, first_event, count(*) AS words, round(max(t) - min(t), 3) AS width FROM r GROUP BY user_id, first_event",
)
def line_groups(spark, d):
    """Events as words in reading order: a line holds what lies within six hours of its first."""
    e = read(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    found = L.with_lines(e, ["user_id"], ["t", "event_id"], "t", _LINE_HOURS * 3600.0, rising=True)
    lines = found.groupBy("user_id", "line").agg(F.min_by("event_id", F.struct("t", "event_id")).alias("first_event"), F.count("*").alias("words"), F.round(F.max("t") - F.min("t"), 3).alias("width"))
    return lines.select("user_id", "first_event", "words", "width")


@query(
    "q110_tender_stems",
    "WITH s AS (SELECT o_orderkey, 'NOTIF_' || CASE WHEN o_orderkey % 4 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE CAST(o_custkey AS VARCHAR) END || '_' || o_orderkey AS stem FROM orders), "
    "x AS (SELECT 'NOTIF_' || c_custkey || '_' || c_custkey AS stem, min(c_name) AS name FROM customer GROUP BY ALL), "
    "h AS (SELECT o_orderkey, x.name AS exact, split_part(replace(stem, 'NOTIF_', ''), '_', 1) AS hint FROM s LEFT JOIN x USING (stem)), "
    "u AS (SELECT hint, count(DISTINCT c_name) AS holders, min(c_name) AS name FROM (SELECT DISTINCT hint FROM h WHERE exact IS NULL) JOIN customer ON contains(lower(c_name), lower(hint)) GROUP BY hint) "
    "SELECT o_orderkey, coalesce(exact, CASE WHEN holders = 1 THEN u.name END) AS tender_id FROM h LEFT JOIN u USING (hint)",
)
def tender_stems(spark, d):
    """The tender of each labelled stem: that of the file of this name, or else the only one whose name holds its hint."""
    k = F.col("o_custkey").cast("string")
    hint = F.when(F.col("o_orderkey") % 4 == 0, F.lpad(k, 6, "0")).otherwise(k)
    stems = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("NOTIF_"), hint, F.lit("_"), F.col("o_orderkey").cast("string")).alias("stem"))
    names = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat_ws("_", F.lit("NOTIF"), "c_custkey", "c_custkey").alias("stem"))
    exact = names.groupBy("stem").agg(F.min("name").alias("name"))
    return G.resolve_stems(stems, exact, names.select("name")).select("o_orderkey", F.col("name").alias("tender_id"))


# Lines as notices print them, one or more for each label, and lines that must not count.
_LABEL_LINES = [
    "Last Date and Time for uploading of Bids", "Bid Submission End Date & Time: {d}", "Last date for online submission {d}", "Last date of submission of EMD {d}", "Due date for submission - {d}",
    "Closing date of the tender {d}", "End date for bid submission {d}", "Last Date for receipt of Queries {d}", "Pre-bid meeting (online) date: {d}", "Last date for seeking clarifications {d}",
    "Earnest Money Deposit (EMD) {m}", "EMD amount: {m}", "Bid security", "EMD ............ {m}", "Bid security as per Form 4 {m}", "nothing of this kind",
]
_HEAD_LINES = ["Greater Hyderabad Municipal Corporation", "Tender Notice of the Corporation", "Office of the Engineer 12345 67890 12345 67890", "  Indian   Institute of Technology ", "Board", "Some prose of no body", "Name of Work: college"]
_DATES = ["22.08.2026", "3 September 2026", "31-02-2026", "05/11/2026", "in due course"]
_SUMS = ["Rs. 31,500/-", "12,56,561", "1% of the ECV", "₹ 2,98,720"]
_PAGES_SQL = f"""
t AS (
  SELECT doc_id // 3 AS doc, doc_id % 3 + 1 AS page, {pick_sql(_HEAD_LINES, 'doc_id')} || chr(10) || coalesce(text, '') || chr(10)
    || replace(replace({pick_sql(_LABEL_LINES, 'doc_id // 2')}, '{{d}}', {pick_sql(_DATES, 'doc_id')}), '{{m}}', {pick_sql(_SUMS, 'doc_id')}) || chr(10)
    || {pick_sql(_DATES, 'doc_id // 7')} || ' ' || {pick_sql(_SUMS, 'doc_id // 5')} || chr(10) || replace(replace({pick_sql(_LABEL_LINES, 'doc_id // 11')}, '{{d}}', {pick_sql(_DATES, 'doc_id // 3')}), '{{m}}', {pick_sql(_SUMS, 'doc_id // 3')}) AS body
  FROM documents)"""


def _label_sql(label: str) -> str:
    """RE2 has no look-ahead: what must not follow is taken out first."""
    plain = label.replace("(?! of emd)", "")
    line = "line" if plain == label else f"regexp_replace(line, {quoted('(?i)' + plain + ' of emd')}, '', 'g')"
    return f"regexp_matches({line}, {quoted('(?i)' + plain)})"


def _field_sql(field: str) -> str:
    labels, value = H.FIELDS[field]
    rank = "CASE " + " ".join(f"WHEN {_label_sql(x)} THEN {n}" for n, x in enumerate(labels)) + " END"
    return (
        f"SELECT doc, page, line_no, {quoted(field)} AS field, {rank} AS rank, trim(coalesce(nullif(regexp_extract(line, {quoted('(?i)' + value)}, 1), ''), regexp_extract(coalesce(after, ''), {quoted('(?i)' + value)}, 1))) AS value, "
        f"left(trim(regexp_replace(line, '\\s+', ' ', 'g')), 160) AS line FROM n WHERE NOT noisy"
    )


_READ_DATE = " ".join(f"WHEN {quoted(v)} THEN {'FALSE' if v == '31-02-2026' else 'TRUE'}" for v in _DATES)
_HEADER_SQL = f"""
WITH {_PAGES_SQL},
l AS (SELECT doc, page, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no FROM t),
n AS (SELECT *, lead(line) OVER (PARTITION BY doc, page ORDER BY line_no) AS after, regexp_matches(line, {quoted('(?i)' + '|'.join(H.NOISE_LINES))}) AS noisy FROM l),
h AS ({' UNION ALL '.join(_field_sql(f) for f in H.FIELDS)}),
b AS (SELECT doc, page, field, arg_min(value, (rank, line_no)) AS value, arg_min(line, (rank, line_no)) AS line FROM h WHERE rank IS NOT NULL AND value <> '' GROUP BY ALL),
o AS (SELECT doc, page, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line, noisy FROM n WHERE page <= {H.HEAD_PAGES} AND line_no < {H.HEAD_LINES}),
i AS (
  SELECT doc, page, 'issuing_authority' AS field, arg_min(line, line_no) AS value, arg_min(line, line_no) AS line FROM o
  WHERE length(line) BETWEEN {H.SHORTEST_NAME} AND {H.LONGEST_NAME} AND NOT noisy AND NOT regexp_matches(line, {quoted('(?i)^(?:' + '|'.join(H.NO_ISSUER) + ')' + chr(92) + 'b')})
    AND regexp_matches(line, {quoted('(?i)' + chr(92) + 'b(?:' + '|'.join(H.ORGANISATIONS) + ')' + chr(92) + 'b')}) AND length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) >= length(line) * {H.LETTERS}
  GROUP BY doc, page),
a AS (SELECT * FROM b WHERE field = 'emd_amount' OR CASE value {_READ_DATE} ELSE FALSE END UNION ALL SELECT * FROM i)
SELECT doc, field, arg_min(value, page) AS value, CAST(min(page) AS INT) AS page, arg_min(line, page) AS line FROM a GROUP BY doc, field
"""


@query("q115_header_patterns", _HEADER_SQL.replace(chr(92) * 2, chr(92)))
def header_patterns(spark, d):
    """Header fields of notices, three pages each: labels by rank, earliest page first, the issuer from the head."""
    k = F.col("doc_id")
    at = lambda n: F.floor(k / n).cast("long")
    label = lambda n, m: F.replace(F.replace(pick(_LABEL_LINES, at(n)), F.lit("{d}"), pick(_DATES, at(m))), F.lit("{m}"), pick(_SUMS, at(m)))
    body = F.concat_ws("\n", pick(_HEAD_LINES, k), F.coalesce("text", F.lit("")), label(2, 1), F.concat_ws(" ", pick(_DATES, at(7)), pick(_SUMS, at(5))), label(11, 3))
    pages = read(spark, d, "documents").select(at(3).alias("doc_id"), (k % 3 + 1).cast("int").alias("page_number"), body.alias("text"))
    return P.header_values(pages).select(F.col("doc_id").alias("doc"), "field", "value", F.col("page_number").alias("page"), "line")
