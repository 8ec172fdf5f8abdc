import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wayloom.llm import langid


def _kneser_ney(words):
    """Interpolated Kneser-Ney by dicts: p(context, symbol)."""
    pad, order = chr(langid.START) * (langid.ORDER - 1), langid.ORDER
    counts = Counter()
    for w in words:
        row = pad + w + chr(langid.END)
        counts.update(row[i : i + order] for i in range(len(row) - order + 1))
    alphabet, levels = len({g[-1] for g in counts}) + 1, []
    for _ in range(order):
        once, twice = (sum(v == k for v in counts.values()) for k in (1, 2))
        d = once / (once + 2 * twice) if once and twice else 0.5
        total, kinds = Counter(), Counter()
        for g, v in counts.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        levels.append((counts, d, total, kinds))
        counts = Counter(g[1:] for g in counts)

    def p(context, symbol):
        out = 1 / alphabet
        for n in range(1, order + 1):
            counts, d, total, kinds = levels[order - n]
            ctx = context[len(context) - n + 1 :]
            if total[ctx]:
                out = out * d * kinds[ctx] / total[ctx] + max(counts[ctx + symbol] - d, 0) / total[ctx]
        return out

    return p


def test_is_kneser_ney():
    rng = random.Random(3)
    spoken = [["".join(rng.choices("abcd", w, k=rng.randint(1, 7))) for _ in range(60)] for w in ([4, 3, 2, 1], [1, 1, 5, 2])]
    parts = [np.unique(langid._events(words)[0], axis=0, return_counts=True) for words in spoken]
    who = np.repeat([0, 1], [len(x) for x, _ in parts])
    model = langid.build(["x", "y"], who, np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts]))
    alphabet = "abcd" + chr(langid.END)
    contexts = ["".join(rng.choices("abcd", k=4)) for _ in range(60)] + [chr(1) * 4, chr(1) * 3 + "a", chr(1) * 2 + "ab", "zzzz"]
    rows = np.array([[*map(ord, c), ord(s)] for c in contexts for s in alphabet + "é"], np.uint64)
    got = np.exp(model.log_probability(rows)).reshape(len(contexts), 6, 2)
    for k, words in enumerate(spoken):
        p = _kneser_ney(words)
        # the floor is that of both languages' letters together, which here are the same
        want = np.array([[p(c, s) for s in alphabet + "é"] for c in contexts])
        assert np.allclose(got[:, :, k], want, rtol=1e-4, atol=1e-7)
        assert np.allclose(got[:, :, k].sum(axis=1), 1, atol=1e-5)  # with one symbol for all that are unseen


def test_foreign_texts_are_rejected(spark):
    foreign = ["Это предложение написано на русском языке и должно быть отклонено здесь", "これは日本語の文章なのでここでは拒否されるはずです", "sdkfjh qwpeoriu zxmcnvb qqpwoeiruty lkjhgfd mnbvcxz qazwsx plokij"]
    for path in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        model = langid.train(docs)
        assert np.isfinite(model.bound).all()
        got = langid.identify(spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string"), model).collect()
        assert all(r["rejected"] for r in got)
        assert langid.identify(docs, model).where("rejected and text rlike '[A-Za-z]{20}'").count() <= 2


def test_samples_of_huge_tables_are_not_empty(spark):
    rows = spark.range(200_000)
    assert rows.where(langid.sampled("id", 1, 1.0)).count() == 200_000
    assert abs(rows.where(langid.sampled("id", 1, 0.01)).count() - 2000) < 200
    text = str(rows.where(langid.sampled("id", 1, 12_000 / 1e13))._jdf.queryExecution().logical())
    assert str(int(1.2e-9 * 2**62) + 1) in text


def test_letter_runs_and_blocks():
    assert langid.letter_runs("L'été2x") == ["l", "été", "x"] and langid.letter_runs("½²") == []
    text = "ab " * 1_000_000
    assert "".join(langid.blocks(text)) == text and max(map(len, langid.blocks(text))) < 1 << 21


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs.drop("source"), langid.train(docs)).where(langid.held_out(F.col("doc_id"))).select("lang", "lang_pred", "rejected").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98 and got["rejected"].mean() < 0.01


def test_odd_rows(odd_docs, no_docs):
    model = langid.train(odd_docs)
    got = langid.identify(odd_docs, model)
    assert got.count() == odd_docs.count()
    for r in got.collect():
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (3, 4, 5, 12):
            assert r["lang_pred"] == "und" and r["rejected"]
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.train(no_docs)).collect()} == {"und"}
    assert langid.identify(no_docs, model).count() == 0
