"""The audit of filters against brute force over all documents, orders and steps."""

import os
import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from bidloom.llm.audit import filter_audit, mask_counts, order_steps, subset_survivors
from bidloom.llm.queries import OP13_SQL, op13_filter_audit
from bidloom.llm.scratch import Scratch

from ..test_queries import SF, duck, plain

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails_of(docs):
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    out = []
    for d, text, part in docs:
        t = text or ""
        w = t.encode().split()
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        fails["E"] = d is not None and least[t] < d
        out.append((d, part or "", {f for f, x in fails.items() if x}))
    return out


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows, shapley = {}, Counter()
    judged = fails_of(docs)
    for part in {p for _, p, _ in judged}:
        mine = [(d, f) for d, p, f in judged if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                out = [d for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[part, x] += len(out)
                all_failing = sum(x in f for _, f in mine)
                rows[part, "".join(order), step] = [len(left), len(out), all_failing - len(out), sum(f == {x} for _, f in mine), sum(d in good for d in out), sum(d in toxic for d in out)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items())


def made(seed, n=120):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.3:
            text = rng.choice(docs)[1]
        else:
            words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 99, 100, 130]))]
            if rng.random() < 0.3:
                words = words[: max(1, len(words) * 4 // 5)] + words[: len(words) - len(words) * 4 // 5]
            if rng.random() < 0.3:
                words = [w.upper() + "ABC" for w in words]
            text = rng.choice([" ", "\n", "\x0b"]).join(words) + rng.choice(["", " |", " #"])
        docs.append((rng.choice([i, i + 500]), text, rng.choice(["en", "de", None])))
    docs += [(None, docs[0][1], "en"), (None, None, None), (2000, None, "en"), (2001, "", "fr"), (2001, "", "fr"), (2002, docs[0][1], "en"), (2002, "other", "en"), (2003, "x " * 30_000, "en")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in docs if rng.random() < 0.7] + [(docs[1][0], 1, 1), (docs[1][0], 0, 0), (99_999, 1, 1)]
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).withColumn("mask", F.lit("x")).withColumn("w", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("part", F.lit(3))
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("y"))


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_all_orders(spark, seed):
    docs, labels = made(seed)
    found = filter_audit(*frames(spark, docs, labels), Scratch(spark))
    assert found.columns == COLUMNS
    got = sorted(tuple(r) for r in found.collect())
    assert got == brute(docs, labels)
    assert len({r[0] for r in got}) * 600 == len(got)


def test_survivors_of_every_subset(spark):
    rng = random.Random(4)
    rows = [("p", m, rng.randrange(9), rng.randrange(5), rng.randrange(5)) for m in rng.sample(range(8), 5)]
    got = subset_survivors(spark.createDataFrame(rows, "part string, mask int, n long, good long, toxic long"), 3).first().survivors
    assert [tuple(x) for x in got] == [tuple(sum(r[k] for r in rows if r[1] & s == 0) for k in (2, 3, 4)) for s in range(8)]


def test_empty_tables(spark):
    d, labels = frames(spark, [(1, "a", "en")], [(1, 1, 1)])
    assert filter_audit(d.where("false"), labels, Scratch(spark)).collect() == []
    got = filter_audit(d, labels.where("false"), Scratch(spark)).collect()
    assert len(got) == 600 and {r.good_lost for r in got} == {0}
    with pytest.raises(ValueError):
        order_steps(d, "")


def test_a_text_in_most_rows_spreads(spark):
    """Copies of one text leave the scan as masks and meet their least doc_id by (digest, doc_id)."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("en").alias("lang"))
    got = [r for r in filter_audit(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int"), Scratch(spark)).collect() if r.filter_order == "EABCD" and r.step == 1]
    assert [(r.kept, r.removed, r.unique_fails) for r in got] == [(1001, 1999, 0)]


def test_masks_are_counted_with_their_labels(spark):
    masks = spark.createDataFrame([(1, "p", 0), (1, "p", 0), (2, "p", 3), (None, "q", 3)], "doc_id long, part string, mask int")
    labels = spark.createDataFrame([(1, 1, None), (1, None, 0), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, mask_counts(masks, labels).collect())) == [("p", 0, 2, 2, 0), ("p", 3, 1, 0, 1), ("q", 3, 1, 0, 0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_query_against_sql_and_brute_force(spark):
    df = op13_filter_audit(spark, SF)
    columns = sorted(df.columns)
    rows = df.collect()
    assert (columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows)) == duck(OP13_SQL)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r) for r in rows) == brute(docs, labels)
