"""Pages of documents: selection under a budget, sections, labelled values and chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headers as H
from ..functions.clauses import chunk_clause
from .running import running

# Cues of the header field group, and the share of the best page's score that keeps a page.
HEADER_CUES = [
    "tender no", "tender reference", "nit no", "e-tender", "etender", "name of work", "name of the work", "notice inviting", "issued by",
    "last date", "due date", "bid submission", "pre-bid", "pre bid", "earnest money", "emd", "estimated cost", "contract value",
    "bid validity", "tender fee",
]
RELATIVE_KEEP = 0.25


def table_text(tables: Column, page: Column) -> Column:
    """Tables of a page as lines of cells, under a heading."""
    row = lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")
    lines = F.array_join(F.flatten(F.transform(tables, lambda t: F.transform(clean_rows(t), row))), "\n")
    return F.when(F.coalesce(F.size(tables), F.lit(0)) > 0, F.concat(F.lit("[TABLES ON PAGE "), page.cast("string"), F.lit("]\n"), lines))


def combined_text(text: Column, tables: Column, page: Column) -> Column:
    return F.concat_ws("\n", F.nullif(text, F.lit("")), table_text(tables, page))


def clean_rows(table: Column) -> Column:
    """Rows with a cell that is not blank."""
    return F.filter(table, lambda r: F.exists(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))


def looks_tabular(table: Column) -> Column:
    """Strict form: two rows and columns, even rows, dense and short cells."""
    rows = clean_rows(table)
    filled = F.transform(rows, lambda r: F.size(F.filter(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")).cast("double"))
    cells = F.filter(F.transform(F.flatten(rows), lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    n = F.size(rows)
    mean = total(filled) / n
    variance = total(F.transform(filled, lambda v: (v - mean) * (v - mean))) / n
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    every = total(F.transform(rows, lambda r: F.size(r).cast("double")))
    chars = total(F.transform(cells, lambda c: F.length(c).cast("double"))) / F.size(cells)
    return F.coalesce((n >= 2) & (wide >= 2) & (variance <= 1.0) & (F.size(cells) / every >= 0.8) & (chars < 80), F.lit(False))


def document_text(pages: DataFrame) -> DataFrame:
    """Each document's pages joined with page marks, empty pages left out, and its properties."""
    marked = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.struct("page_number", F.concat(F.lit("[PAGE "), F.col("page_number").cast("string"), F.lit("]\n"), F.col("text")).alias("t")))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(marked)), lambda p: p["t"]), "\n\n").alias("full_text"),
        F.count("*").alias("page_count"),
        F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("total_chars"),
        F.count_if(F.col("method") == "ocr").alias("ocr_pages"),
        (F.count_if(F.col("method") == "ocr") * 2 > F.count("*")).alias("is_scanned"),
    )


def cue_score(text: Column, cues: list[str]) -> Column:
    """Damped density of cues: root of the hits over the root of the length in thousands."""
    lowered = F.lower(text)
    hits = sum((((F.length(lowered) - F.length(F.replace(lowered, F.lit(c), F.lit("")))) / len(c)) for c in cues), F.lit(0.0))
    return F.sqrt(hits) / F.sqrt(F.greatest(F.length(lowered) / 1000.0, F.lit(1.0)))


def select_pages(pages: DataFrame, cues: list[str], budget: int, first: int = 0) -> DataFrame:
    """``(doc_id, page_number, chars, score, used)`` of the pages of each document that speak of the
    cues, in order, under a budget of characters.

    A document within the budget keeps all pages; otherwise pages of a quarter of the best score and
    the ``first`` pages, cut at the first that would overflow (the very first one always stays). Texts
    are scored where they are read; from there on only numbers move, totals are aggregated and running
    sums taken range by range, so a document may have any number of pages, under whatever numbers.
    """
    scored = pages.select("doc_id", "page_number", F.length("text").alias("chars"), cue_score(F.col("text"), cues).alias("score"))
    totals = scored.groupBy("doc_id").agg(F.max("score").alias("best"), F.sum("chars").alias("total"))
    order = Window.partitionBy("doc_id").orderBy("page_number")
    early = scored.select("doc_id", "page_number").withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(first, 10))
    rated = scored.join(totals, "doc_id").join(early, ["doc_id", "page_number"], "left")
    wanted = (F.col("total") <= budget) | ((F.col("best") > 0) & (F.col("score") > 0) & (F.col("score") >= F.col("best") * RELATIVE_KEEP)) | F.coalesce(F.col("place") <= first, F.lit(False))
    wanted = wanted | ((F.col("best") == 0) & F.col("place").isNotNull())
    kept = rated.where(wanted).select("doc_id", "page_number", "chars", "score")
    used = running(kept, ["doc_id"], ["page_number"], {"used": F.col("chars"), "n": F.lit(1)})
    return used.where((F.col("used") <= budget) | (F.col("n") == 1)).drop("n")


def lines_of(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, line_no, line)``, numbered from 0."""
    return docs.select(doc, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def section_scope(lines: DataFrame, heading: Column, doc: str = "doc_id") -> DataFrame:
    """Lines with the last heading at or above them in their document."""
    up = Window.partitionBy(doc).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("heading", F.last(heading, ignorenulls=True).over(up))


def labelled_values(lines: DataFrame, label: str, doc: str = "doc_id") -> DataFrame:
    """The value after a label on its line, or else the next line."""
    w = Window.partitionBy(doc).orderBy("line_no")
    after = F.trim(F.regexp_extract("line", rf"(?i){label}\s*[:\-–]?\s*(.*)$", 1))
    found = lines.withColumn("next_line", F.lead("line").over(w)).where(F.col("line").rlike(rf"(?i){label}"))
    return found.select(doc, "line_no", F.coalesce(F.nullif(after, F.lit("")), F.trim("next_line")).alias("value"))


def header_values(pages: DataFrame) -> DataFrame:
    """``(doc_id, field, value, page_number, line)``: the header fields that ``pages(doc_id, page_number, text)`` print.

    A page offers its best labelled value of a field, which counts if it can be read; the earliest such page
    wins. The issuer comes from the head of the first pages. Each page is judged where it is read, and only what it found is
    aggregated.
    """
    read = pages.select("doc_id", "page_number", H.page_lines(F.col("text")).alias("lines"))
    found = [F.struct(F.lit(f).alias("field"), h["value"].alias("value"), h["line"].alias("line")) for f, h in ((f, H.labelled(F.col("lines"), f)) for f in H.FIELDS)]
    issuer = F.when(F.col("page_number") <= H.HEAD_PAGES, H.issuer(F.col("lines")))
    found.append(F.struct(F.lit("issuing_authority").alias("field"), F.substring(issuer, 1, 200).alias("value"), F.substring(issuer, 1, 160).alias("line")))
    hits = read.select("doc_id", "page_number", F.explode(F.array(*found)).alias("h")).select("doc_id", "page_number", "h.*").where("value IS NOT NULL")
    good = F.lit(True)
    for f in H.FIELDS:
        good = F.when(F.col("field") == f, H.holds_value(f, F.col("value"))).otherwise(good)
    first = hits.where(good).groupBy("doc_id", "field").agg(F.min(F.struct("page_number", "value", "line")).alias("first"))
    return first.select("doc_id", "field", "first.value", "first.page_number", "first.line")


def rendered_rows(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_number, table_no, row_no, header, rendered)``: the rows of ``pages(doc_id, page_number, tables)`` that are not blank.

    A first row of labels (two cells or more, no digits, over two rows or more) is the header of the others.
    """
    tables = pages.select("doc_id", "page_number", F.posexplode("tables").alias("table_no", "table")).withColumn("rows", clean_rows(F.col("table")))
    first = F.get("rows", 0)
    cells = F.filter(first, lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    header = (F.size("rows") >= 3) & (F.size(cells) >= 2) & ~F.exists(cells, lambda c: c.rlike(r"\d"))
    body = tables.withColumn("header", F.when(header, render_row(first))).select("doc_id", "page_number", "table_no", "header", F.posexplode("rows").alias("row_no", "row"))
    return body.where(F.col("header").isNull() | (F.col("row_no") > 0)).withColumn("rendered", render_row(F.col("row"))).drop("row").where("rendered <> ''")


def _row_prefix() -> Column:
    return F.concat(F.lit("[table on page "), F.col("page_number").cast("string"), F.lit("]"))


def _row_text() -> Column:
    return F.concat(_row_prefix(), F.lit(" "), F.coalesce(F.concat("header", F.lit("\n")), F.lit("")), F.col("rendered"))


def table_row_chunks(pages: DataFrame, longest: int = 600) -> DataFrame:
    """One chunk per table row, with the header repeated where the first row is one; ``document_chunks`` cuts those longer than ``longest``."""
    rows = rendered_rows(pages).withColumn("text", _row_text())
    return rows.select("doc_id", "page_number", "table_no", "row_no", "text", (F.length("text") > longest).alias("long"))


def page_tables(ruled: Column, aligned: Column) -> Column:
    """The tables of a page: those with ruled lines of two rows and columns, or where there are none the aligned ones that pass the strict form."""
    two = F.filter(ruled, lambda t: (F.size(clean_rows(t)) >= 2) & (F.array_max(F.transform(clean_rows(t), lambda r: F.size(r))) >= 2))
    none = F.array().cast("array<array<array<string>>>")
    return F.when(F.size(F.coalesce(two, none)) > 0, two).otherwise(F.coalesce(F.filter(aligned, looks_tabular), none))


def render_row(row: Column) -> Column:
    joined = F.array_join(F.transform(row, lambda c: F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))), " | ")
    return F.btrim(joined, F.lit(" |"))


def split_text(text: str | None, size: int = 1600, overlap: int = 200) -> list[str]:
    """Pieces of at most ``size`` characters at the largest breaks that fit, small neighbours joined."""
    text = (text or "").strip()
    if len(text) <= size:
        return [text] if text else []
    pieces: list[str] = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        held = ""
        for sentence in [paragraph] if len(paragraph) <= size else re.split(r"(?<=[.;:])\s+", paragraph):
            if len(held) + 1 + len(sentence) <= size:
                held = f"{held} {sentence}".strip()
                continue
            if held:
                pieces.append(held)
            cut = 0
            while len(sentence) - cut > size:
                pieces.append(sentence[cut : cut + size])
                cut += size - overlap
            held = sentence[cut:]
        if held:
            pieces.append(held)
    out: list[str] = []
    for p in pieces:
        if out and len(out[-1]) + 2 + len(p) <= size:
            out[-1] += "\n\n" + p
        else:
            out.append(p)
    return out


def _cut(overlap: int):
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([split_text(t, int(n), overlap) for t, n in zip(texts, sizes, strict=True)])

    return cut


def chunks(docs: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """``(doc_id, chunk_index, text)`` of ``docs(doc_id, text)``; pieces are cut in batches."""
    return docs.select("doc_id", F.posexplode(_cut(overlap)("text", F.lit(size))).alias("chunk_index", "text"))


def document_chunks(pages: DataFrame, size: int = 1600, overlap: int = 200, longest_row: int = 600) -> DataFrame:
    """``(doc_id, page_number, chunk_index, text, clause_ref)`` of ``pages(doc_id, page_number, text, tables)``.

    Page by page, prose first and then a chunk for every row of its tables, numbered on through the
    document from 0. A row longer than ``longest_row`` with its heading is cut, and each piece says its page again.
    """
    cut = _cut(overlap)
    prose = pages.select("doc_id", "page_number", F.posexplode(cut("text", F.lit(size))).alias("piece", "text"))
    prose = prose.select("doc_id", "page_number", F.lit(0).alias("part"), F.lit(0).alias("table_no"), F.lit(0).alias("row_no"), "piece", "text", chunk_clause(F.col("text")).alias("clause_ref"))
    rows = rendered_rows(pages).withColumn("whole", _row_text())
    short = F.length("whole") <= longest_row
    pieces = F.when(short, F.array("whole")).otherwise(F.transform(cut(F.when(~short, F.col("rendered")), size - F.length(_row_prefix()) - 1), lambda t: F.concat(_row_prefix(), F.lit(" "), t)))
    rows = rows.withColumn("clause_ref", chunk_clause(F.col("rendered"))).select("doc_id", "page_number", "table_no", "row_no", "clause_ref", F.posexplode(pieces).alias("piece", "text"))
    every = prose.unionByName(rows.withColumn("part", F.lit(1)))
    numbered = running(every, ["doc_id"], ["page_number", "part", "table_no", "row_no", "piece"], {"n": F.lit(1)})
    return numbered.select("doc_id", "page_number", (F.col("n") - 1).cast("long").alias("chunk_index"), "text", "clause_ref")


def page_chunks(pages: DataFrame, size: int = 1600, overlap: int = 200) -> DataFrame:
    """``(doc_id, page_number, chunk_index, text, clause_ref)``: each page's text cut by size alone, numbered on through the document.

    The plain arm of a comparison: prose and tables are one stream, and only a leading clause number is read.
    """

    cut_up = pages.select("doc_id", "page_number", F.posexplode(_cut(overlap)("text", F.lit(size))).alias("piece", "text"))
    numbered = running(cut_up, ["doc_id"], ["page_number", "piece"], {"n": F.lit(1)})
    return numbered.select("doc_id", "page_number", (F.col("n") - 1).cast("long").alias("chunk_index"), "text", chunk_clause(F.col("text")).alias("clause_ref"))
