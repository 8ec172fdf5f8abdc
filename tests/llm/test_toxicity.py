import numpy as np
from pyspark.sql import functions as F

from wayloom.llm import toxicity
from wayloom.llm.langid import held_out

RNG = np.random.default_rng(3)


def test_label_model_finds_accuracies():
    y = (RNG.random(4000) < 0.3).astype(int)
    votes = np.zeros((4000, 4), np.int8)
    for j, (cover, right) in enumerate([(0.7, 0.95), (0.6, 0.8), (0.9, 0.65)]):
        said = np.where(RNG.random(4000) < right, y, 1 - y)
        votes[:, j] = np.where(RNG.random(4000) < cover, 2 * said - 1, 0)
    votes[:, 3] = votes[:, 1]  # a copy
    known = np.where(RNG.random(4000) < 0.1, y, -1)
    post, right, corr = toxicity.label_model(votes, known, gold=True)  # with labels that vote
    assert ((post > 0.5) == y).mean() > 0.85
    silent, theirs, _ = toxicity.label_model(votes, known)  # and without: the order of the voters, and how right they are together
    assert ((silent > 0.5) == y).mean() > 0.85 and theirs[:2].min() > 0.8 > theirs[2]
    assert np.allclose(right[:3], [0.95, 0.8, 0.65], atol=0.08)
    assert corr[1, 3] > 0.95 > abs(corr[0, 2]) + 0.5


def test_words():
    assert "idiot" in toxicity.words_of("1d10t!!")
    assert toxicity.words_of("don't") == ["don", "t"]
    assert "abcd" in toxicity.words_of("a-b-c-d")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("toxic", "predicted").toPandas()
    assert (scored["toxic"] == scored["predicted"]).mean() > 0.97
    assert scored[scored["toxic"] == 1]["predicted"].mean() > 0.75


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (6, 0, 1), (7, None, 0), (None, 0, 1), (8, 1, None), (8, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd_docs, labels)
    got = toxicity.score(odd_docs, model)
    assert got.count() == odd_docs.count() and set(odd_docs.columns) | {"predicted"} == set(got.columns)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = toxicity.train(odd_docs, labels.limit(0))
    assert toxicity.score(odd_docs, none).where("score is null").count() == 0
    assert toxicity.score(no_docs, model).count() == 0


def test_label_model_discounts_a_voter_that_the_others_contradict():
    """A voter whose words stand in toxic and clean rows alike, though the first labels speak for it."""
    y = (RNG.random(6000) < 0.2).astype(int)
    votes = np.stack([(RNG.random(6000) < np.where(y, 0.4, 0.002)) for _ in range(6)] + [RNG.random(6000) < 0.05], axis=1).astype(np.int8)
    known = np.where((RNG.random(6000) < 0.1) & (votes[:, 6] == 0) | (votes[:, 6] * y == 1), y, -1)
    post, right, _ = toxicity.label_model(votes, known)
    assert right[:6].min() > 0.95 and right[6] < 0.6
    assert ((post > 0.5) == y).mean() > 0.95


def test_features_of_the_same_rows_share_a_lexicon():
    rows = [np.array(x, int) for x in ([0, 1, 5], [0, 1], [0, 1, 2], [2, 3], [2], [3, 5], [3], [])] * 5
    lexicon = toxicity.dealt(rows, np.array([0, 1, 2, 3]), 3)
    assert lexicon[0] == lexicon[1] and len({lexicon[0], lexicon[2], lexicon[3]}) == 3


def test_labels_of_other_documents_are_a_prior_only(spark, odd_docs):
    labels = spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(900, 990)], "doc_id long, quality int, toxic int")
    scores = {r["score"] for r in toxicity.score(odd_docs, toxicity.train(odd_docs, labels)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
