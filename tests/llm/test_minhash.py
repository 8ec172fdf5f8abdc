import random

import numpy as np

from wayloom.llm import minhash
from wayloom.llm.minhash import near_duplicates
from wayloom.plans import lineage


def _sets(text, width):
    words = text.encode().lower().split() if text else []
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def _brute(rows, width, percent):
    sets = [(i, _sets(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def _check(spark, rows, width, percent):
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _brute(rows, width, percent)


def test_equals_brute_force_on_groups(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(12):  # chains of edits: members near their base, less so one another
        base = rng.choices(vocab, k=rng.randint(30, 200))
        for _ in range(rng.choice([1, 2, 15])):
            text = list(base)
            for _ in range(rng.randint(0, len(text) // 25)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 1, rng.choice([" ", "\n", "\t "]).join(text).replace("w1", "W1")))
    rows += [(1000, "a b"), (1001, "A  b"), (1002, "a b c"), (1003, "")]
    _check(spark, rows, 3, 85)


def test_tiles_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(70):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"x{k}_{rng.randrange(99)}"
        rows.append((k, " ".join(text)))
    _check(spark, rows, 3, 85)


def test_odd_rows(odd_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [(r["component_id"], r["kept"]) for r in by[1]] == [(1, True)] * 2
    assert by[2][0]["component_id"] == by[11][0]["component_id"] == 1
    assert by[7][0]["component_id"] == 6 and by[9][0]["component_id"] == 8
    for k in (3, 4, 5):
        assert (by[k][0]["n_shingles"], by[k][0]["component_id"], by[k][0]["kept"]) == (0, k, True)
    assert all(r["component_id"] is None and r["kept"] for r in by[None])


def test_empty(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_rows_that_repeat_an_id_each_keep_their_links(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, "c d e f g"), (4, "h i j k l"), (5, "h i j k l"), (4, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (4, 4), (5, 4)]


def test_a_third_of_all_rows_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(lineage, "HOT_KEYS", 7)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(base)) for k in range(40)]
    for k in range(40, 90):
        text = list(base)
        text[rng.randrange(80)] = f"x{k}"
        rows.append((k, " ".join(text)))
    rows += [(k, " ".join(f"y{k}_{j}" for j in range(30))) for k in range(90, 200)]
    _check(spark, rows, 3, 85)


def test_sketch_limit_is_the_exact_tail():
    rng = np.random.default_rng(8)
    for threshold, samples, bits, miss in ((0.8, 128, 512, 0.01), (0.85, 64, 128, 0.02)):
        limit = minhash.least_passing_distance(threshold, samples, bits, miss)
        far = []
        for _ in range(20_000):
            differ = rng.binomial(samples, 1 - threshold)
            far.append((np.bincount(rng.integers(0, bits, 2 * differ), minlength=bits) & 1).sum())
        share = [(np.array(far) > k).mean() for k in (limit, limit - 2)]  # the population count is even
        assert share[0] < miss * 1.4 and share[1] > miss * 0.7


def test_small_tables_stand_in_few_files(spark, monkeypatch):
    """However many partitions a shuffle has, a table of a few rows is no file for each of them."""
    files = []

    def counted(df, name, *rows, real=lineage.written, **known):
        out = real(df, name, *rows, **known)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(lineage, "written", counted)
    monkeypatch.setattr(minhash, "written", counted)
    long = [" ".join(f"w{d}x{k}" for k in range(60)) for d in range(30)]
    texts = [*long, *[f"{t} more" for t in long], *[f"{t} and so on" for t in long]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {k: k % 30 for k in range(90)}
    assert max(files) <= 4 and sum(files) < 3 * len(files)
