"""Held-out accuracy and awkward input of the two trained operators."""

import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from relyard.llm import language_id, rule_ensemble
from relyard.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, DOC_SCHEMA, doc_table, prose

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_classifier_on_held_out(spark):
    rows = QUERIES["op1_rule_ensemble"].build(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == held_out(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    tested = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert len(tested) > 50 and sum(tested) / len(tested) > 0.95


LANGS = {"en": "the and of with this", "de": "der und von mit diese", "fr": "le et de avec cette", "xx": "zzq qzz zqz qqz zzz"}


def sentences(lang, seed):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(LANGS[lang].split(), 30))


def test_classifier_awkward(spark):
    texts = list(enumerate([prose(k, 80) for k in range(40)] + ["x*** " * 60] * 40)) + [(200 + k, t) for k, t in enumerate(AWKWARD)] + [(None, prose(1, 80)), (0, prose(0, 80))]
    docs = doc_table(spark, texts).selectExpr("*", "1 AS score", "2 AS label", "3 AS n_words")
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)] + [(3, None, 0), (None, 1, 0), (5, 0, 0), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = rule_ensemble.score(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r for r in rows}
    right = [by_id[k].predicted == int(k < 40) for k in range(80)]
    assert sum(right) >= 78 and by_id[None].predicted == 1 and not by_id[None].held_out
    none = rule_ensemble.score(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert all(r.predicted == 1 for r in rule_ensemble.score(docs, labels.where("quality = 1")).collect())
    assert rule_ensemble.score(spark.createDataFrame([], DOC_SCHEMA), labels).count() == 0


def test_labels_of_held_out_documents_are_not_used(spark):
    docs = doc_table(spark, list(enumerate([prose(k, 80) for k in range(60)] + ["x*** " * 60] * 60)))
    honest = [(k, int(k < 60), 0) for k in range(120)]
    lying = [(k, 1 - q if held_out(k) else q, 0) for k, q, _ in honest]
    scores = [sorted(map(tuple, rule_ensemble.score(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")).collect())) for x in (honest, lying)]
    assert scores[0] == scores[1]


def test_rules_of_trees_match_the_trees(spark):
    text = """
  Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 1 <= -1.0E-4)
      Predict: 0.0
     Else (feature 1 > -1.0E-4)
      Predict: 1.0
    Else (feature 0 > 2.5)
     If (feature 0 <= 9.0)
      Predict: 1.0
     Else (feature 0 > 9.0)
      Predict: 0.0
"""
    low, high = (0, "<=", 2.5), (0, ">", 2.5)
    assert rule_ensemble.tree_rules(text) == {(low,), (low, (1, "<=", -1e-4)), (low, (1, ">", -1e-4)), (high,), ((0, "<=", 9.0), high), ((0, ">", 9.0),)}


def test_language_on_held_out(spark):
    rows = QUERIES["op9_language"].build(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in table(spark, "documents").collect()}
    assert len(rows) == 1000 and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(tested) / len(tested) > 0.97


def test_language_awkward(spark):
    rows = [(k, sentences(lang, k), lang, "s", 1) for k, lang in enumerate(list(LANGS) * 25)]
    rows += [(500 + k, t, "en", "s", 1) for k, t in enumerate([None, "", " \n", "12 34 !?", "日本"])] + [(600, sentences("de", 1), None, "s", 1), (None, sentences("fr", 2), " ", "s", 1)]
    rows += [(0, rows[0][1], "en", "s", 1), (700, "the " * 20000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA).selectExpr("*", "1 AS score", "2 AS x")
    got = language_id.predict(docs, per_language=10).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[500 + k].lang_pred == "und" and by_id[500 + k].score == 0 for k in range(4)) and by_id[504].lang_pred != "und"
    assert all(by_id[k].lang_pred == lang for k, lang in enumerate(list(LANGS) * 25))
    assert by_id[600].lang_pred == "de" and by_id[None].lang_pred == "fr" and by_id[700].lang_pred == "en"
    assert {r.lang_pred for r in language_id.predict(docs.withColumn("lang", docs.lang.substr(9, 1))).collect()} == {"und"}
    single = language_id.predict(docs.where("lang = 'de'")).collect()
    assert {(r.lang_pred, r.score) for r in single} == {("de", 1.0)}
    assert language_id.predict(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def slow_features(text):
    codes = [b if b > 127 or chr(b).isalpha() else 32 for b in text.lower().encode("utf-8", "surrogatepass")]
    codes = [32] + [b for k, b in enumerate(codes) if b != 32 or k == 0 or codes[k - 1] != 32] + [32]
    out = np.zeros(language_id.BINS)
    for n in (1, 2, 3):
        for k in range(len(codes) - n + 1):
            gram = int.from_bytes(bytes(codes[k : k + n]), "big")
            out[(gram + (n << 28)) * 2654435761 % 2**32 >> 20] += 1
    out = np.sqrt(out)
    return out / np.linalg.norm(out)


@given(st.text(max_size=60))
@settings(max_examples=80, deadline=None)
def test_features(text):
    assert np.allclose(language_id.features(text), slow_features(text), atol=1e-5)


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    sign = np.where(x[:, 0] - 2 * x[:, 3] > 0.2, 1.0, -1.0)
    w = language_id.train_svm(x, sign, cost=100)
    assert (np.sign(x @ w[:-1] + w[-1]) == sign).mean() > 0.97
