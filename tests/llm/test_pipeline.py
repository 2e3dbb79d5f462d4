"""The pipeline's stages against plain versions on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bidloom.llm.queries import QUERIES, SQL
from tests.llm.test_dedup import brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(200):
        text = [rng.choice(vocabulary) for _ in range(80)]
        junk, toxic = i % 9 == 0, i % 6 == 1
        if junk:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            text[10] = text[40] = "slurword"
        docs.append((i, " ".join(text), "en", f"src{i % 4}", 0))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(300 + i, docs[i][1].replace(" ", "  ") if i % 2 else docs[i][1], "en", "x", 0) for i in range(1, 12)]
    docs += [(400 + i, docs[i][1] + " tail words", "en", "x", 0) for i in range(20, 30)]
    docs += [(5, docs[5][1], "en", "src1", 0), (None, "null id text " * 20, "en", "x", 0), (600, None, None, None, None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[k] = (before, docs)
        if k < 4:
            assert docs.columns == columns
    junk = {i for i in range(200) if i % 9 == 0}
    kept = {r.doc_id for r in seen[0][1].select("doc_id").collect()}
    assert not kept & junk and set(range(200)) - junk <= kept
    exact = [r.doc_id for r in seen[1][1].select("doc_id").collect()]
    bare = lambda df: df.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "").alias("t")).distinct().count()
    assert len(exact) == bare(seen[1][1]) == bare(seen[1][0])
    rows = [(r.doc_id, r.text) for r in seen[2][0].where("doc_id IS NOT NULL").collect()]
    want = {d for d, (_, c) in brute_components(rows, 5, 80).items() if c == d}
    assert {r.doc_id for r in seen[2][1].where("doc_id IS NOT NULL").collect()} == want
    mixed = {r.doc_id for r in seen[3][1].select("doc_id").collect()}
    clean = {d for d in want if not (d < 200 and d % 6 == 1)}
    assert len(clean - mixed) <= 0.02 * len(clean)  # clean documents stay
    out = seen[4][1]
    assert out.count() == seen[4][0].count() and out.where("NOT decoded").isEmpty()


@pytest.mark.parametrize("survivors", [1, 4, 5, 7, 10])
def test_little_junk_leaves_clean_documents(spark, tmp_path, survivors):
    """Labelled junk that reads like clean text passes the first stage; clean documents stay all the same."""
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(vocabulary) for _ in range(60)]
        junk, toxic = i % 9 == 0, i % 6 == 1
        if junk:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            text[10] = text[40] = "slurword"
        docs.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, int(not junk), int(toxic)))
    for i in range(1000, 1000 + survivors):
        docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(6)), "en", "s", 0))
        labels.append((i, 0, 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    corpus_pipeline.quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).write.parquet(f"{tmp_path}/passed")
    passed = spark.read.parquet(f"{tmp_path}/passed")
    before = [r.doc_id for r in passed.select("doc_id").collect()]
    assert len([d for d in before if d >= 1000]) == survivors
    after = [r.doc_id for r in corpus_pipeline.mixing(spark, passed, str(tmp_path)).select("doc_id").collect()]
    clean = {d for d in before if d < 1000 and d % 6 != 1}
    assert len(clean) > 250 and len(clean - set(after)) <= 0.02 * len(clean)
    toxic = {d for d in before if d < 1000 and d % 6 == 1}
    assert len(toxic & set(after)) < 0.6 * len(toxic)


def test_last_stage_searches_for_more_than_the_best_path(spark, folder, monkeypatch):
    asked, whole = [], corpus_pipeline.encode_documents
    monkeypatch.setattr(corpus_pipeline, "encode_documents", lambda docs, model, n: asked.append(n) or whole(docs, model, n=n))
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 20")
    found = {r.doc_id: r for r in corpus_pipeline.pieces(spark, docs, folder).collect()}
    best = {r.doc_id: r for r in whole(docs, corpus_pipeline.default_model(), n=1).collect()}
    assert asked[0] > 1 and all(found[d].tokens == r.tokens and (r.scores is None or found[d].score == r.scores[0]) for d, r in best.items())


def test_empty_documents_through_all_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(f"{tmp_path}/{k - 1}" if k else f"{tmp_path}/documents.parquet"), str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        assert spark.read.parquet(f"{tmp_path}/{k}").count() == 0
        if k < 4:
            assert spark.read.parquet(f"{tmp_path}/{k}").schema == docs.schema
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_through_all_stages(spark, folder, tmp_path):
    """Columns with the names that operators use come through every stage, with the values of their rows."""
    names = ["row", "id", "hash", "stays", "maybe", "rate", "copy", "n_tokens", "p0", "score", "digest", "features", "a.b", "quality"]
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.select("*", *(F.concat_ws(":", F.lit(n), F.col("doc_id").cast("string"), F.substring("text", 1, 9)).alias(n) for n in names))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").withColumn("text", F.lit("x")).write.parquet(f"{tmp_path}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, spark.read.parquet(f"{tmp_path}/{k - 1}" if k else f"{tmp_path}/documents.parquet"), str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        if k < 4:
            got = spark.read.parquet(f"{tmp_path}/{k}")
            assert got.columns == docs.columns
            for r in got.collect():
                assert all(r[n] == ":".join(x for x in (n, None if r.doc_id is None else str(r.doc_id), None if r.text is None else r.text[:9]) if x is not None) for n in names)
    with_clash = sorted(str(r.doc_id) for r in spark.read.parquet(f"{tmp_path}/4").collect())
    assert with_clash == sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_entry_without_the_subpackage(tmp_path):
    """The entry point works when the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "bidloom", tmp_path / "bidloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] and set(SQL) <= set(QUERIES)
