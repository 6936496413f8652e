import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marquee.llm import language_id as L
from marquee.llm import queries as Q


def test_held_out_accuracy(spark, sf001):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    got = Q.QUERIES["op7_language_id"](spark, sf001).collect()
    assert len(got) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 150 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_dirty_rows(spark, dirty):
    got = {(r.doc_id, r.lang_pred) for r in L.predict_language(dirty).collect()}
    rows = dirty.collect()
    assert {d for d, _ in got} == {r.doc_id for r in rows}
    for r in rows:
        letterless = not any(c.isalpha() for c in r.text or "")
        if r.doc_id is not None:
            assert ((r.doc_id, "und") in got) == letterless
    assert L.predict_language(dirty).count() == len(rows)


def test_nothing_to_learn_from(spark, no_docs, dirty):
    assert L.predict_language(no_docs).collect() == []
    got = L.predict_language(dirty.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in got} == {"und"} and {r.score for r in got} == {0.0}
    assert L.keep_known_languages(no_docs).collect() == []


def test_held_out_rows_are_not_learned_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = spark.createDataFrame([(i, "zz qq", "xx") if i in held else (i, "some words", "en") for i in range(200)],
                                 "doc_id long, text string, lang string")
    assert set(L.training_sample(docs).lang) == {"en"}


def test_kernel_weights_equal_the_kernel_machine():
    """The collapsed weights give what kernel ridge regression on all landmarks gives."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde "), 40)) for _ in range(20)] + ["".join(rng.choice(list("defgh "), 40)) for _ in range(20)]
    sample = pd.DataFrame({"lang": ["x"] * 20 + ["y"] * 20, "doc_id": range(40), "text": texts})
    model = L.fit(sample, landmarks=40, ridge=0.1)
    sets = [{int(c) for code in model.grams(t) for c in code} & set(model.codes.tolist()) for t in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.array([[1, 0]] * 20 + [[0, 1]] * 20, float)
    direct = kernel @ np.linalg.solve(kernel + 0.1 * np.eye(40), y)
    assert np.abs(model.presence(texts) @ model.weights - direct).max() < 1e-2


def test_whole_texts_count(spark):
    """A text's language is that of most of it, not of its beginning."""
    words = {"aa": "taka mano felu siro", "bb": "xwyz qurq vrix jork"}
    rows = [(i, " ".join([words[k]] * 5), k) for i, k in enumerate(["aa", "bb"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learned(docs)
    text = words["aa"] + " " + " ".join([words["bb"]] * 5000)
    assert model.predict([text]).lang_pred[0] == "bb"


def test_filter_keeps_clean_documents(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    kept = L.keep_known_languages(docs)
    assert kept.dtypes == docs.dtypes and kept.count() >= 0.98 * docs.count()
