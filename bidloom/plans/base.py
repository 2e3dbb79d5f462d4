"""Registry of queries over the driver's tables, and SQL pieces shared by their DuckDB forms."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money as M
from ..functions import names as N
from ..functions import vocabulary as V
from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pick(texts: list[str], index):
    """The text at ``index`` modulo the number of texts."""
    return F.element_at(F.array(*(F.lit(t) for t in texts)), (F.pmod(index, F.lit(len(texts))) + 1).cast("int"))


def pick_sql(texts: list[str], index: str) -> str:
    return f"([{', '.join(quoted(t) for t in texts)}])[1 + ({index}) % {len(texts)}]"


def any_word_sql(text: str, words: list[str]) -> str:
    return f"regexp_matches(lower({text}), {quoted('|'.join(re.escape(w) for w in words))})"


def money_ctes(source: str, keep: str, text: str = "txt") -> str:
    """CTEs m0 .. m3 over a relation; m3 has the ``keep`` columns and ``inr`` (double)."""
    cases = " ".join(f"WHEN {quoted(u)} THEN {x}" for u, x in M.UNITS.items())
    return rf"""
m0 AS (SELECT {keep}, {text} AS txt, regexp_replace({text}, {quoted(M.NOISE)}, ' ', 'g') AS clean FROM {source}),
m1 AS (SELECT *, regexp_extract_all(clean, {quoted(M.AMOUNT)}, 1) AS d, regexp_extract_all(clean, {quoted(M.AMOUNT)}, 2) AS u FROM m0),
m2 AS (SELECT *, list_filter(list_transform(range(1, len(d) + 1), lambda i: struct_pack(v := CAST(regexp_replace(d[i], '[,\s]', '', 'g') AS DOUBLE), u := lower(regexp_replace(coalesce(u[i], ''), '[\s.]', '', 'g')))),
              lambda p: NOT regexp_matches(p.u, '^(%|percent)')) AS p FROM m1),
m2b AS (SELECT *, list_transform(p, lambda q: q.v * CASE q.u {cases} ELSE 1 END) AS amounts, list_transform(p, lambda q: CASE q.u {cases} ELSE 1 END) AS factors FROM m2),
m3 AS (SELECT {keep}, txt, CASE WHEN len(amounts) = 0 THEN NULL
       WHEN list_max(factors) > 1 THEN amounts[list_position(list_transform(factors, lambda f: f > 1), true)] ELSE amounts[1] END AS inr FROM m2b)"""


def normalised_sql(name: str) -> str:
    word = "w"
    for ending, meant in V.SPELLINGS:
        word = f"regexp_replace({word}, '{ending}$', '{meant}')"
    stop = ", ".join(quoted(w) for w in V.STOPWORDS)
    plural = f"CASE WHEN length({word}) > 3 AND ends_with({word}, 's') AND NOT regexp_matches({word}, '(ss|us|is)$') THEN left({word}, length({word}) - 1) ELSE {word} END"
    plain = rf"regexp_replace(lower(coalesce({name}, '')), '[^\w\s]', ' ', 'g')"
    return rf"array_to_string(list_transform(list_filter(regexp_split_to_array({plain}, '\s+'), lambda w: w <> '' AND w NOT IN ({stop})), lambda w: {plural}), ' ')"


def canonical_sql(normalised: str) -> str:
    table = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in N.alias_table().items()) + "}"
    return f"({table})[{normalised}]"


def vocabulary_sql(normalised: str) -> str:
    for _ in range(2):
        for said, meant in N.synonym_pairs():
            normalised = rf"regexp_replace({normalised}, '\b{re.escape(said)}\b', '{meant}', 'g')"
    return normalised


def distinctive_sql(words: str) -> str:
    generic = ", ".join(quoted(w) for w in V.GENERIC)
    return f"list_distinct(list_filter(string_split({words}, ' '), lambda w: w <> '' AND w NOT IN ({generic})))"


def identifiers_sql(name: str) -> str:
    pattern = quoted(N.IDENTIFIER)
    return f"list_sort(list_distinct(list_transform(range(1, len(regexp_extract_all({name}, {pattern}, 1)) + 1), lambda i: lower(regexp_extract_all({name}, {pattern}, 1)[i] || ':' || regexp_extract_all({name}, {pattern}, 2)[i]))))"


#: Names of documents as tenders and bids print them, for queries that need such texts.
NAMES = [
    "GST Registration Certificate",
    "Copy of GST certificate",
    "PAN Card",
    "Permanent Account Number",
    "Audited Balance Sheet",
    "Audited financial statements",
    "Earnest Money Deposit",
    "EMD proof",
    "ISO 9001:2015 certificate",
    "Power of Attorney, if applicable",
    "Submission of Power of Attorney",
    "Work experience certificates",
    "Certificate from the chartered accountant",
    "Certificate of statutory auditors",
    "Manufacturers authorization form",
    "OEM authorisation form",
    "Annexure-IV Undertaking of non blacklisting",
    "Annexure V Undertaking of non blacklisting",
    "Undertaking of non blacklisting",
    "Solvency certificate from banks etc.",
    "relevant documents (copy of Work order, Completion certificate etc.)",
    "MSME certificate for exemption",
    "Joint venture agreement",
    "Firm Registration certificate of each bidder / JV",
    "Turnover of not less than 80% of Estimated Cost",
    "Pass-Phrase",
    "Bid Securing Declaration",
    "Letter of Bid",
    "Labour licence",
    "Method statement",
]
