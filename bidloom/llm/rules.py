"""Quality rules: statistics of texts and a learned decision list over them.

``text_statistics`` is one pass of built-in expressions. ``learn_rules`` is sequential covering: it
grows a conjunction of thresholds on labelled statistics, adding the condition with the best FOIL
gain until no bad text is covered by chance, prunes it on rows kept aside, takes the rows it covers
out and starts anew. The list is emitted as one ordered Spark conditional expression; a text that no
rule covers is kept.

Only DataFrame functions run on the executors. The learner reads a bounded table of labelled
statistics (``max_rows`` rows of small integers) on the driver.

Cases. Null and empty texts have no words and fail the base rule. Repeated rows come back once
each. Without labels, or with labels of one class, the list is empty. A null doc_id keeps its row.
A very long text is one row: its windows are sorted, so time grows as n log n. Ties: of conditions with equal
gain the first stands, by column (ratios first, by name), then threshold, then "at least" before "below"; of
repeated labels of a doc_id the largest counts. An empty table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_SPACE = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"


def text_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each whole text of ``docs(doc_id, text)``, all long.

    ``n_words``, ``word_chars`` (code points in words), ``n_symbols`` (of ``#*$%&|<>``),
    ``n_dup_lines`` (lines with a word that equal an earlier line), ``n_repeat_words`` (words in a
    window of three words that the text holds twice or more), ``n_lines`` (lines with a word),
    ``n_repeats`` (words equal to the word before), ``n_upper`` (A-Z) and ``n_distinct`` words.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select("doc_id", text.alias("text"), F.btrim(text, F.lit(_BLANKS)).alias("trimmed"))
    words = words.select("doc_id", "text", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", _SPACE)).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    # Hash and place of every window, sorted: equal windows are neighbours.
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    with_hashes = words.select("doc_id", "text", "w", lines.alias("lines"), hashed.alias("h"))
    n = F.size("h")
    window = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.struct(F.xxhash64(F.get("h", i - 1), F.get("h", i), F.get("h", i + 1)).alias("x"), i.alias("i")))
    with_windows = with_hashes.select(
        "doc_id", "text", "w", "lines", "h", F.when(n < 3, F.array().cast("array<struct<x:bigint,i:int>>")).otherwise(F.sort_array(window)).alias("s")
    )
    repeated = F.filter("s", lambda e, j: (F.get("s", j - 1)["x"] == e["x"]) | (F.get("s", j + 1)["x"] == e["x"]))
    places = F.sort_array(F.transform(repeated, lambda e: e["i"]))
    with_places = with_windows.select("doc_id", "text", "w", "lines", "h", places.alias("p"))
    # A window covers three words, less those the next repeated window covers as well.
    covered = F.aggregate(
        F.transform("p", lambda e, j: F.least(F.lit(3), F.coalesce(F.get("p", j + 1) - e, F.lit(3)))), F.lit(0).cast("long"), lambda total, v: total + v
    )
    adjacent = F.size(F.filter("h", lambda e, j: F.coalesce(F.get("h", j - 1) == e, F.lit(False))))
    return with_places.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        adjacent.cast("long").alias("n_repeats"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.size(F.array_distinct("h")).cast("long").alias("n_distinct"),
    )


#: Ratios the rules may test, in parts of 1000 of the second count, so that they stay integers.
RATIOS: dict[str, tuple[str, str]] = {
    "symbols_per_words": ("n_symbols", "n_words"),
    "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_per_lines": ("n_dup_lines", "n_lines"),
    "repeat_words_per_words": ("n_repeat_words", "n_words"),
    "repeats_per_words": ("n_repeats", "n_words"),
    "upper_per_chars": ("n_upper", "word_chars"),
    "distinct_per_words": ("n_distinct", "n_words"),
}


def with_ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns({name: F.expr(f"CAST(floor(1000 * {a} / greatest({b}, 1)) AS BIGINT)") for name, (a, b) in RATIOS.items()})


@dataclass(frozen=True)
class Condition:
    column: str
    at_least: bool
    threshold: int

    def holds(self, row: dict[str, int]) -> bool:
        return row[self.column] >= self.threshold if self.at_least else row[self.column] < self.threshold

    def expression(self) -> Column:
        c = F.col(self.column)
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.column} {'>=' if self.at_least else '<'} {self.threshold}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, row: dict[str, int]) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def expression(self) -> Column:
        out = self.conditions[0].expression()
        for c in self.conditions[1:]:
            out = out & c.expression()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _best_condition(covered: list[dict[str, int]], columns: list[str]) -> Condition | None:
    """The condition with the best FOIL gain, over every threshold of every column."""
    total, bad = len(covered), sum(r["bad"] for r in covered)
    start, best = log2(bad / total), (1e-9, None)
    for c in columns:
        ranked = sorted((r[c], r["bad"]) for r in covered)
        below = below_bad = 0
        for i, (v, is_bad) in enumerate(ranked):
            if i and v != ranked[i - 1][0]:
                middle = (ranked[i - 1][0] + v + 1) // 2
                for at_least, n, b in ((True, total - below, bad - below_bad), (False, below, below_bad)):
                    if b and (gain := b * (log2(b / n) - start)) > best[0]:
                        best = (gain, Condition(c, at_least, middle))
            below += 1
            below_bad += is_bad
    return best[1]


def _grow(rows: list[dict[str, int]], columns: list[str], max_conditions: int) -> Rule | None:
    covered, chosen = rows, []
    while len(chosen) < max_conditions and 0 < sum(r["bad"] for r in covered) < len(covered):
        if (c := _best_condition(covered, columns)) is None:
            break
        chosen.append(c)
        covered = [r for r in covered if c.holds(r)]
    return Rule(tuple(chosen)) if chosen else None


def _worth(rule: Rule, rows: list[dict[str, int]]) -> tuple[float, int]:
    hit = [r["bad"] for r in rows if rule.holds(r)]
    return ((2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0, sum(hit))


def _prune(rule: Rule, rows: list[dict[str, int]]) -> Rule:
    """Drop final conditions while the rows kept aside do not speak for them."""
    best = rule
    for n in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:n])
        if _worth(shorter, rows) >= _worth(best, rows):
            best = shorter
    return best


def _sound(rule: Rule, rows: list[dict[str, int]], false_share: float, least: int = 5) -> bool:
    hit = [r["bad"] for r in rows if rule.holds(r)]
    return len(hit) >= least and len(hit) - sum(hit) <= false_share * len(hit)


def learn_rules(rows: list[dict[str, int]], max_rules: int = 12, max_conditions: int = 4, false_share: float = 0.02) -> list[Rule]:
    """Ordered rules that name bad texts, from rows with the statistics and ``bad`` (0 or 1).

    A third of the rows is kept aside for pruning. Of all rows left that a rule covers, five at
    least, no more than ``false_share`` may be good; a pruned rule that covers more is taken
    unpruned, and if that covers more too, the search ends.
    """
    # Ratios come first, so that of equal gains one that does not depend on a text's length wins.
    columns = [c for c in [*sorted(RATIOS), "n_dup_lines", "n_repeat_words", "n_repeats", "n_symbols"] if c in rows[0]] if rows else []
    rules: list[Rule] = []
    left = rows
    while len(rules) < max_rules and 0 < sum(r["bad"] for r in left) < len(left):
        grow, aside = [r for i, r in enumerate(left) if i % 3], left[::3]
        rule = _grow(grow, columns, max_conditions)
        if rule is None:
            break
        rule = next((r for r in (_prune(rule, aside), rule) if _sound(r, left, false_share)), None)
        if rule is None:
            break
        rules.append(rule)
        left = [r for r in left if not rule.holds(r)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1; 0 where none does."""
    out = None
    for n, r in enumerate(rules, 1):
        out = F.when(r.expression(), n) if out is None else out.when(r.expression(), n)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = 6000) -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` and ``kept`` for every row of ``docs(doc_id, text)``."""
    stats = scratch.table(text_statistics(docs), "statistics")
    seen = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).dropna()
    n = seen.count()
    if n > max_rows:
        seen = seen.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rated = with_ratios(stats)
    sample = rated.join(seen, "doc_id").where(~base).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_rows)
    rows = [r.asDict() | {"bad": int(r["quality"] != 1)} for r in sample.collect()]
    rules = learn_rules(rows)
    judged = rated.withColumn("base_failed", base).withColumn("rule", verdict(rules))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )
