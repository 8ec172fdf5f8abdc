"""Token counts and merge-dropout against the library itself."""

import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.sp_model import as_unigram
from wayloom.llm import mergedropout, tokencount
from wayloom.llm.pieces import LITERAL, chunks_of, whole

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rng = random.Random(1)
    odd = ["", "a", " ", "  ", "   x  y ", "日本語 テスト", "\n\n a", "ﬁ Å é", "x" * 3000, "the  the   the", "😀 ok", "\x00\x01", "a ", " a"]
    odd += ["".join(rng.choice("ab  éthe日\n") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    return odd + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(100).collect()]


def test_counts_are_the_librarys(texts):
    unigram, counter = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(PATH)), tokencount.ViterbiCounter(PATH)
    for t in [*texts, "a▁b ▁"]:
        assert counter(t)[0] == len(unigram.encode(t))


def test_very_long_text_is_counted_in_blocks():
    counter = tokencount.ViterbiCounter(PATH)
    one = counter(" ".join(["alpha beta"] * 10))[0]
    assert counter(" ".join(["alpha beta"] * 300_000))[0] == one * 30_000
    for t in ("a  b c   d e f  " * 9, "   x y", "x y   ", "ab " * 20):
        for size in (1, 3, 10):
            assert sum(counter.best("".join(f"▁{c}" if c[:1] != "▁" else c for c in chunks_of(p)))[0] for p in tokencount._word_blocks(t, size) if p) == counter(t)[0]
            assert " ".join(tokencount._word_blocks(t, size)) == t


def test_without_dropout_ids_are_the_librarys(texts):
    bpe, encoder = sentencepiece.SentencePieceProcessor(model_file=PATH), mergedropout.DropoutEncoder(PATH, 0.0, 1)
    for t in texts:
        assert encoder(1, t).tolist() == bpe.encode(t)


def test_dropout_varies_repeats_and_decodes(texts):
    encoder = mergedropout.DropoutEncoder(PATH, 0.2, 1)
    again = mergedropout.DropoutEncoder(PATH, 0.2, 1)
    for k, t in enumerate([*texts, "a▁b ▁", "﻿ x"]):
        ids = encoder(k, t)
        assert mergedropout.decode(ids, encoder.table.raw) == t
        assert (ids == again(k, t)).all()
    word = " ".join(["information"] * 200)
    seen = encoder(1, word).tolist()
    assert len(seen) > 200 and seen != encoder(2, word).tolist() != mergedropout.DropoutEncoder(PATH, 0.2, 2)(1, word).tolist()
    every = mergedropout.DropoutEncoder(PATH, 1.0, 1)
    assert len(every(1, "abc")) == 4


def test_each_occurrence_draws_its_own_skips(texts):
    encoder = mergedropout.DropoutEncoder(PATH, 0.1, 1)
    ids = encoder(1, " ".join(["information"] * 20_000))
    words, raw = [], encoder.table.raw
    for i in ids.tolist():
        if raw[i].startswith(b" "):
            words.append([])
        words[-1].append(i)
    kinds = Counter(map(tuple, words))
    plain = tuple(mergedropout.DropoutEncoder(PATH, 0.0, 1)(1, "information").tolist())
    met = []
    encoder.merge("▁information", 0, lambda c: met.append(c) or False)
    assert len(words) == 20_000 and len(kinds) > 20 and kinds[plain] / 20_000 >= 0.9 ** len(met) - 0.02
    assert sum(n for k, n in kinds.items() if k != plain) > 1000
    assert len({tuple(encoder(k, "of information").tolist()) for k in range(200)}) > 4


def _by_scanning(encoder, chunk, key):
    """The agenda by brute force: the best pair of all is looked for anew at each step."""
    symbols, place, skipped = list(chunk), list(range(len(chunk))), set()
    draw = encoder._drawn(key)
    while True:
        pairs = [(encoder.rank[a + b], i, a + b, place[i]) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in encoder.rank]
        pairs = [p for p in pairs if p[2:] not in skipped]
        if not pairs:
            break
        _, i, pair, at = min(pairs)
        if draw((encoder.table.normal[pair] * mergedropout._A + at * mergedropout._C) & mergedropout._M):
            skipped.add((pair, at))
        else:
            symbols[i : i + 2], place[i : i + 2] = [pair], [at]
    out = []
    for x in symbols:
        known = encoder.table.normal.get(x)
        out += [known] if known is not None else [encoder.table.byte_id[b] for b in ("▁" if x == LITERAL else x).encode("utf-8", "surrogatepass")]
    return out


def _by_chunks(encoder, k, t, merged):
    parts = chunks_of(t.replace("▁", LITERAL)) if t else []
    return [i for c, key in zip(parts, encoder.keys([k], [len(parts)]), strict=True) for i in merged(whole(c), int(key))]


def test_agendas_side_by_side_equal_one_by_one(texts):
    texts = [*texts, "a▁b ▁", "日本語テスト" * 200, "\ufeff x"]
    for dropout in (0.1, 0.5, 1.0):
        encoder = mergedropout.DropoutEncoder(PATH, dropout, 3)
        docs = list(range(len(texts)))
        for k, t, ids in zip(docs, texts, encoder.many(docs, texts), strict=True):
            assert ids.tolist() == _by_chunks(encoder, k, t, encoder.merge)
            if len(t) < 2000:
                assert ids.tolist() == _by_chunks(encoder, k, t, lambda c, key, e=encoder: _by_scanning(e, c, key))


def test_long_texts_in_parts_equal_the_whole(texts, monkeypatch):
    encoder = mergedropout.DropoutEncoder(PATH, 0.2, 3)
    long = "   ".join(texts[-20:]) + " " + "no blank here"
    want = encoder(5, long).tolist()
    for most in (7, 100, 1000):
        monkeypatch.setattr(mergedropout, "TOGETHER", most)
        assert encoder(5, long).tolist() == want
        got = encoder.many([1, 5, 2], ["a b", long, ""])
        assert got[1].tolist() == want and got[0].tolist() == encoder(1, "a b").tolist() and not len(got[2])


def test_bytes_are_those_of_the_pieces(texts):
    encoder = mergedropout.DropoutEncoder(PATH, 0.3, 4)
    decoder = mergedropout.Decoder(encoder.table.raw)
    for k, t in enumerate(texts):
        ids = encoder(k, t)
        assert decoder.bytes_of(ids).decode() == mergedropout.decode(ids, encoder.table.raw) == t


def test_frames(odd_docs, no_docs):
    n = odd_docs.count()
    counts = tokencount.count_tokens(odd_docs, PATH).collect()
    assert len(counts) == n and {r["n_tokens"] for r in counts if r["doc_id"] in (3, 4)} == {0}
    trip = mergedropout.round_trip(odd_docs, PATH).collect()
    assert len(trip) == n and all(r["lossless"] for r in trip)
    encoded = mergedropout.encode_documents(odd_docs, PATH)
    back = mergedropout.decode_documents(encoded, PATH).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect())
    assert tokencount.count_tokens(no_docs, PATH).count() == mergedropout.round_trip(no_docs, PATH).count() == 0
