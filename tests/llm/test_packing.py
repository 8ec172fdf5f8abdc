from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayloom.llm import packing


def test_pack_fills_and_shrinks():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 32769, 2000)
    where, at, size = packing.pack(n)
    for k in range(where.max() + 1):
        own = np.flatnonzero(where == k)
        end = np.sort(at[own] + n[own])
        assert at[own].min() == 0 and (np.sort(at[own])[1:] == end[:-1]).all()
        assert size[own[0]] == min(s for s in packing.SIZES if s >= end[-1])
    assert n.sum() / sum(dict(zip(where.tolist(), size.tolist(), strict=True)).values()) > 0.95


def test_best_fit_is_taken():
    where, _, size = packing.pack(np.array([600, 900, 400, 100]), (1000,))
    assert where[1] == where[3] and where[0] == where[2] and set(size) == {1000}


def test_every_row_is_placed_whole(odd_docs, no_docs):
    got = packing.pack_documents(odd_docs, group_pieces=4).collect()
    want = defaultdict(list)
    for r in odd_docs.select("doc_id", packing.byte_length(F.col("text")).alias("n")).collect():
        want[r["doc_id"]].append(r["n"])
    total, bins = defaultdict(int), defaultdict(list)
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        bins[r["sequence_id"], r["sequence_size"]].append((r["sequence_start"], r["n_tokens"]))
        assert r["piece_start"] == r["piece"] * max(packing.SIZES)
    assert dict(total) == {k: sum(v) for k, v in want.items()}
    for (_, size), parts in bins.items():
        assert sum(n for _, n in parts) <= size
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
    assert packing.pack_documents(no_docs).count() == 0


def test_many_equal_rows_are_dealt(spark):
    df = spark.range(1000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 99).alias("text"))
    got = packing.pack_documents(df, group_pieces=100).collect()
    assert len(got) == 1000 and len({r["sequence_id"] >> 32 for r in got}) > 3


def _optimum(lengths, sizes):
    """Least cost over all ways to part the lengths into sequences."""
    least = [float("inf")]

    def deal(k, held):
        if k == len(lengths):
            least[0] = min(least[0], packing.total_cost(held, sizes))
            return
        for j in range(len(held)):
            if held[j] + lengths[k] <= max(sizes):
                deal(k + 1, [*held[:j], held[j] + lengths[k], *held[j + 1 :]])
        deal(k + 1, [*held, lengths[k]])

    deal(0, [])
    return least[0]


def _cost(lengths, sizes, opening=None):
    where, _, size = packing.pack(lengths, sizes, opening)
    return sum(packing.sequence_cost(s) for s in dict(zip(where.tolist(), size.tolist(), strict=True)).values())


def test_near_the_optimum_of_small_groups():
    rng, sizes, ratio = np.random.default_rng(3), [1024, 2048, 4096], []
    for _ in range(60):
        n = rng.integers(1, 4097, rng.integers(1, 8))
        n = np.where(rng.random(len(n)) < 0.5, n // 4 + 1, n)
        cost, least = _cost(n, sizes), _optimum(n.tolist(), sizes)
        assert least <= cost + 1e-9 and cost <= _cost(n, sizes, sizes) + 1e-9
        ratio.append(cost / least)
    assert max(ratio) < 1.5 and np.mean(ratio) < 1.06


def test_sizes_are_chosen_together():
    sizes, n = [1000, 4000], np.array([700] * 25)  # five in a long sequence waste less than one in each short one
    opening, cost = packing.best_openings(n, sizes)
    assert opening[0] == 4000 and cost < 0.85 * _cost(n, sizes, sizes)
    assert cost == _cost(n, sizes) == 5 * packing.sequence_cost(4000)
    assert packing.best_openings(np.array([1000] * 9), sizes)[0] == [1000, 4000]
    rng = np.random.default_rng(4)
    n = rng.integers(1, 4001, 300)
    assert packing.best_openings(n, sizes)[1] <= min(_cost(n, sizes, o) for o in ([1000, 4000], [4000, 4000])) + 1e-9


def test_lengths_are_the_librarys(odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted((r["doc_id"] or 0, len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in odd_docs.collect())
    assert sorted((r["doc_id"] or 0, r["length"]) for r in packing.token_lengths(odd_docs, path).collect()) == want
    assert packing.token_lengths(no_docs, path).count() == 0
