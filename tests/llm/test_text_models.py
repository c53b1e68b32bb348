import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakeloom.llm import langid, quality
from lakeloom.llm.langid import Model, SuffixAutomaton
from lakeloom.llm.queries import QUERIES
from tests.llm.conftest import A, B

SMALL = "/root/testdata/sf0.001"


def plain_phrases(model, text):
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in model:
            size += 1
        count, at = count + 1, at + size
    return count


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", max_size=40), st.text("abcd ", max_size=30))
def test_phrases_are_longest_matches(model, text):
    assert SuffixAutomaton(model).phrases(text) == plain_phrases(model, text)


def test_languages_of_odd_documents(odd_docs):
    model = Model({"en": [A], "de": [B]}, 10_000)
    found = langid.predict(odd_docs, model, F.col("doc_id") == 7).collect()
    assert len(found) == odd_docs.count() and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r for r in found}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7, 9)] == ["en", "en", "und", "und", "und", "und", "de", "de"]
    assert by_id[7].held_out and not by_id[1].held_out and by_id[None].held_out is False


def test_language_of_a_very_long_word():
    model = Model({"en": [A], "de": [B]}, 10_000).prepared()
    word = "".join(B.split()) * 6000
    assert min(a.phrases(f" {word} ") for a in model.automata) > 65_535
    assert model.predict(word)[0] == "de" and model.predict("".join(A.split()) * 6000)[0] == "en"


def test_accepted_documents(odd_docs):
    model = Model({"en": [A], "de": [B]}, 10_000)
    kept = langid.accepted(odd_docs, model)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 7, 9, 11} and not {r.doc_id for r in kept.collect()} & {3, 4, 5, 6}
    wrong = odd_docs.filter("doc_id = 7").withColumn("lang", F.lit("en"))
    assert langid.accepted(wrong, model).count() == 0


def test_no_labelled_rows(odd_docs, no_docs):
    model = langid.train(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, model, F.lit(False)).collect()} == {"und"}
    assert langid.predict(no_docs, model, F.lit(False)).count() == 0
    assert {r.doc_id for r in langid.accepted(odd_docs, model).collect()} >= {1, 7, 8}


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op6_language_id"](spark, SMALL).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0


def test_linear_time_equals_all_pairs():
    import numpy as np

    features = quality.Features()
    samples = [(*features(text, len(text)), label) for text, label in [(A, 1), (B, 1), ("!!! ### !!!", 0), ("x x x x", 0)] * 5]
    machine = quality.fit(samples, epochs=3)
    where, values = features(A, 10)
    x = machine.scaled(values)
    total = machine.bias + machine.linear[where] @ x
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            total += machine.factors[where[i]] @ machine.factors[where[j]] * x[i] * x[j]
    assert np.isclose(machine.score(where, values), 1 / (1 + np.exp(-total)))


def test_quality_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (6, 0, 0), (8, None, 0), (None, 1, 0), (99, 0, 1)],
                                   "doc_id bigint, quality int, toxic int")
    machine = quality.train(odd_docs, labels, F.lit(True))
    found = quality.score(odd_docs, machine, F.col("doc_id") == 1).collect()
    assert len(found) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert quality.score(no_docs, quality.train(no_docs, labels, F.lit(True)), F.lit(False)).count() == 0


def test_held_out_quality(spark):
    small = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = QUERIES["op4_quality"](spark, small).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.quality == r.predicted for r in rows) >= 0.97 * len(rows) > 0


def test_inputs_of_scores():
    """Labels, language, source and id are in no feature."""
    import inspect

    assert not re.search(r"lang|source|doc_id", inspect.getsource(quality.Features) + inspect.getsource(quality.structure))
