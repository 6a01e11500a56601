"""Bloom filters, and the counts that rest on them."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, prose
from threatloom.llm import bloom, quality_rules
from threatloom.llm.bloom import Bloom


def test_every_key_passes_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).toDF("k")
    others = spark.range(-20_001, 20_001, 2).toDF("k")
    both = keys.unionAll(others).unionAll(spark.createDataFrame([(None,)], "k bigint"))
    made = Bloom.of(keys.unionAll(keys), "k")
    passed, rest = made.split(both, "k")
    assert passed.count() + rest.count() == both.count()
    assert passed.where("k % 2 = 0").count() == keys.count()
    assert passed.where("k IS NULL").isEmpty()
    assert passed.where("k % 2 <> 0").count() < 0.04 * others.count()
    hashes = keys.select(bloom.key_hash("k").alias("h")).toArrow().column(0).to_numpy()
    assert bloom.may_hold(made.words, hashes).all()
    none = Bloom.of(keys.where("k < 0"), "k")
    assert none.split(both, "k")[0].isEmpty()


def test_a_key_of_several_columns(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "n bigint, t string")
    made = Bloom.of(rows, "n", "t")
    assert made.split(rows, "n", "t")[0].count() == 2


def test_ngrams_of_wrongly_trusted_documents_are_taken_off(spark, monkeypatch):
    texts = [" ".join(prose(i, 30)) for i in range(200)]
    docs = documents(spark, [*enumerate(texts), (None, "no id"), (3, "the same id again")]).select("doc_id", "text")
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id int")
    params = quality_rules.QualityParams(buckets=512)

    def counted():
        return sorted(map(tuple, quality_rules.ngram_counts(docs, trusted, params).collect()))

    raw, target = np.zeros(512, np.int64), np.zeros(512, np.int64)
    for row in docs.collect():
        grams = quality_rules.hashed_ngrams(row.text.encode(), (3,), 512)
        np.add.at(raw, grams, 1)
        if row.doc_id is not None and row.doc_id < 60 and row.doc_id % 3 == 0:
            np.add.at(target, grams, 1)
    wanted = [(i, raw[i], target[i]) for i in range(512) if raw[i]]
    assert counted() == wanted
    # a filter of one word is soon full: many documents pass that must be taken off again
    monkeypatch.setattr(bloom, "MAX_WORDS", 1)
    full = Bloom.of(trusted.select(F.col("doc_id").cast("bigint")), "doc_id")
    assert full.split(docs, "doc_id")[0].count() > 2 * trusted.count()
    assert counted() == wanted
