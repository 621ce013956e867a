"""Language identification: accuracy on held-out rows, and rows without a language."""

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentigrade.llm import langid

FOLDER = "/root/testdata/sf0.01"


def test_families():
    assert langid.family_of("de") == langid.family_of("en-GB") == "germanic"
    assert langid.family_of("fr") == langid.family_of("ES") == "romance"
    assert langid.family_of("tlh") == "tlh"


@pytest.fixture(scope="module")
def small(spark):
    words = {"en": "the and with that this", "de": "der und mit nicht eine", "fr": "le et avec pas une", "es": "el y con una los", "xx": "zuq qaz qox zyz"}
    rows = [
        (k, " ".join(text.split()[(k * 7 + j * j) % len(text.split())] for j in range(4 + k % 9)), lang)
        for k, (lang, text) in enumerate(list(words.items()) * 60)
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_learns_families_and_languages(spark, small):
    model = langid.learn(small, per_language=40)
    assert model.languages == ["de", "en", "es", "fr", "xx"]
    assert ("de", "en") in model.pairs and ("es", "fr") in model.pairs and len(model.families) == 3
    found = langid.predict(small, model)
    assert found.where(F.col("lang") != F.col("lang_pred")).count() == 0
    assert found.where(~F.col("score").between(0.5, 1)).count() == 0
    again = langid.predict(small.repartition(7), langid.learn(small.repartition(5), per_language=40))
    assert found.exceptAll(again.select(*found.columns)).count() == 0


def test_rows_without_language(spark, small):
    model = langid.learn(small, per_language=40)
    rows = [(1, None), (2, ""), (3, "12 %$ \n"), (4, "the " * 50_000), (None, "der und"), (4, "é")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    got = {(r.doc_id, r.text and r.text[:9]): (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert all(got[k] == ("und", 0.0) for k in ((1, None), (2, ""), (3, "12 %$ \n")))
    assert got[4, "the the t"][0] == "en" and got[None, "der und"][0] == "de"
    kept = langid.keep_known(odd, model)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {"mine"}
    assert langid.keep_known(odd.limit(0), model).count() == 0


def test_nothing_or_one_language_to_learn(spark, small):
    none = langid.learn(small.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in langid.predict(small, none).collect()} == {("und", 0.0)}
    one = langid.learn(small.where("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in langid.predict(small, one).collect()} == {("en", 1.0)}


def test_held_out(spark):
    rows = spark.range(50).select("id", langid.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_accuracy_on_held_out_documents(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = langid.predict(documents, langid.learn(documents)).where(langid.held_out(F.col("doc_id")))
    total, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert total > 100 and right / total > 0.97


def test_an_id_on_many_rows_and_many_codes(spark):
    rng = random.Random(7)

    def text(letters):
        return " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(8))

    rows = [(1, text("abcde"), "en") for _ in range(2000)] + [(1, text("vwxyz"), "es") for _ in range(2000)] + [(1, rows_text, "en") for rows_text in ["same text here"] * 1500]
    rows += [(k, text("klmno"), f"x{k % 90}") for k in range(180)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.learn(df, per_language=50, most_languages=5)
    assert len(model.languages) == 5 and {"en", "es"} <= set(model.languages) and len(model.biases) <= 10
    guessed, _ = model.predict([text("abcde"), text("vwxyz"), ""])
    assert guessed == ["en", "es", "und"]


def test_predictions_equal_plain_votes():
    rng = np.random.default_rng(1)
    names = ["a", "b", "c", "d"]
    duels = {pair: rng.normal(size=40) for pair in itertools.combinations(names, 2)}
    best, least = langid.Model.champion(names, duels, 40)
    for k in range(40):
        votes = {n: [m[k] if n == a else -m[k] for (a, b), m in duels.items() if n in (a, b)] for n in names}
        want = max(names, key=lambda n: (sum(v > 0 for v in votes[n]), sum(np.tanh(v) for v in votes[n])))
        assert names[best[k]] == want and least[k] == min(votes[want])
