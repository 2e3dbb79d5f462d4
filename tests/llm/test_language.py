"""String kernels, ridge regression and language prediction against plain versions."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.llm import language
from bidloom.llm.language import gram_rows, has_letter, kernel, language_scores, plain_bytes, predictions, ridge_model
from bidloom.llm.queries import op12_string_kernel_language

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": ["ka", "ro", "min"], "bb": ["ét", "eau", "ou"], "cc": ["sch", "ung", "är"]}


def plain(text):
    out, was = b" ", True
    for b in text:
        letter = b >= 128 or chr(b).isalpha()
        if letter:
            out += bytes([b]).lower() if b < 128 else bytes([b])
        elif not was:
            out += b" "
        was = not letter
    return out if was else out + b" "


def gram_set(text, most=5):
    p = plain(text)
    return {p[i : i + n] for n in range(1, most + 1) for i in range(len(p) - n + 1)}


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.choice([3, 30]))]
        docs.append((i, " ".join(words).capitalize() + rng.choice([".", " 12!", ""]), lang))
    return docs


def test_grams_of_a_slice_are_those_of_each_text():
    texts = [b"", b"Ab, c", b"ab c", b"  12 ", "Été !ab".encode(), b"a", b"x" * 5000, b"ab\ncd" * 40]
    numbers, at = gram_rows(texts)
    for k, t in enumerate(texts):
        alone = gram_rows([t])[0]
        assert numbers[at[k] : at[k + 1]].tolist() == alone.tolist() == sorted(set(alone.tolist()))
        data, _ = plain_bytes([t])
        assert data.tobytes() == plain(t)
        assert len(alone) == len(gram_set(t))  # no two of these n-grams share a number
    assert gram_rows([b"Ab, c"])[0].tolist() == gram_rows([b"aB c"])[0].tolist() != gram_rows([b"abc"])[0].tolist()
    assert gram_rows([])[1].tolist() == [0]


def test_kernel_is_the_share_of_common_grams():
    texts = [d[1].encode() for d in corpus(40)]
    numbers, at = gram_rows(texts)
    rows = [numbers[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
    got = kernel(rows, rows[:9], block=4, most_rows=300)
    sets = [gram_set(t) for t in texts]
    by_hand = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets[:9]] for a in sets]
    assert np.allclose(got, by_hand, atol=2e-2)  # hashed n-grams: now and then two share a number
    assert np.allclose(np.diag(got[:9]), 1)


@pytest.mark.parametrize("landmarks", [12, 60])
def test_model_is_kernel_ridge_regression_on_nystroem_features(landmarks):
    docs = corpus(60)
    texts, langs = [d[1].encode() for d in docs], [d[2] for d in docs]
    numbers, at = gram_rows(texts)
    rows = [numbers[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
    names, weights, middle = ridge_model(rows, langs, landmarks, ridge=0.3)
    got = predictions([d[1].encode() for d in corpus(25, 9)], weights, middle)
    # In the dual form, with the approximate kernel K = C W+ C': K(x, X) (K + ridge)^-1 (Y - mean) + mean.
    per = {n: [i for i, x in enumerate(langs) if x == n] for n in names}
    order = [per[n][k] for k in range(60) for n in names if k < len(per[n])][:landmarks]
    marks = [rows[i] for i in sorted(order)]
    inverse = np.linalg.pinv(kernel(marks, marks), rcond=1e-8, hermitian=True)
    c = kernel(rows, marks)
    goal = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    dual = np.linalg.solve(c @ inverse @ c.T + 0.3 * np.eye(len(rows)), goal - goal.mean(0))
    new_numbers, new_at = gram_rows([d[1].encode() for d in corpus(25, 9)])
    new = kernel([new_numbers[a:z] for a, z in zip(new_at[:-1], new_at[1:], strict=True)], marks)
    assert np.allclose(got, new @ inverse @ c.T @ dual + goal.mean(0), atol=1e-6)


def test_letters_of_any_script():
    assert [has_letter(t.encode()) for t in ["", " 1!", "a", "é", "中", "٣", "—", "9Ж"]] == [False, False, True, True, True, False, False, True]


def test_rows_and_cases(spark):
    docs = corpus(120)
    docs = [(i, t, None if i % 10 == 7 else lang) for i, t, lang in docs]
    extra = [(900, None, "aa"), (901, "", None), (902, " 12 —!", "bb"), (None, "karomin karo", "cc"), (903, "sch" * 60_000, None), (904, "min", None), (904, "min", None), (905, "中", None)]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string").repartition(3).withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("count", F.lit(3))
    found = language_scores(df, landmarks=40)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == 128 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r for r in rows}
    assert [(by[i].lang_pred, by[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert (by[None].lang_pred, by[None].held_out) == ("aa", False) and by[903].lang_pred == "cc" and by[904].lang_pred == "aa" and by[905].lang_pred in SYLLABLES
    assert sum(r.doc_id == 904 for r in rows) == 2
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(by[i].lang_pred == lang for i, _, lang in docs if lang)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, language_scores(df, landmarks=40).collect()), key=str)


def test_held_out_languages_change_nothing(spark):
    docs = corpus(80)
    held = {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    schema = "doc_id long, text string, lang string"
    a = language_scores(spark.createDataFrame(docs, schema)).collect()
    b = language_scores(spark.createDataFrame([(i, t, "zz" if i in held else lang) for i, t, lang in docs], schema)).collect()
    assert held and sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_no_one_and_empty(spark):
    schema = "doc_id long, text string, lang string"
    none = language_scores(spark.createDataFrame([(1, "abc", None), (2, "", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 2
    one = {r.doc_id: r.lang_pred for r in language_scores(spark.createDataFrame([(1, "abc", "en"), (2, "xyz", "en"), (4, "7", None), (5, "q", None)], schema)).collect()}
    assert one == {1: "en", 2: "en", 4: "und", 5: "en"}
    assert language_scores(spark.createDataFrame([], schema)).collect() == []


def test_sample_is_bounded_and_shared_out(spark):
    docs = [(i, f"text {i}", "aa" if i % 50 else "bb") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = language.sampled_grams(df, F.lit(True), 200, 1 << 20)
    assert len(got) <= 200 and {r["lang"] for r in got} == {"aa", "bb"} and sum(r["lang"] == "bb" for r in got) >= 20
    small = language.sampled_grams(df, F.lit(True), 200, 2000)
    assert 0 < sum(len(r["grams"]) for r in small) <= 2000


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op12_string_kernel_language(spark, SF).join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
