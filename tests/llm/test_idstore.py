import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wayloom.llm import idstore

PATH = public_tokenizers.path("byte_bpe_50k.json")


def _expected(docs):
    library = Tokenizer.from_file(PATH)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_round_trip(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = str(tmp_path / "store")
    idstore.write_store(docs, PATH, path)
    want = _expected(docs)
    assert sorted(map(tuple, idstore.read_sums(spark, path).collect())) == [w[:4] for w in want]
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in idstore.read_ids(spark, path).collect()) == [(*w[:3], w[4]) for w in want]
    chunks = idstore._chunk_rows(spark, path)
    assert chunks.count() == chunks.select("key").distinct().count()


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    idstore.write_store(odd_docs, PATH, str(tmp_path / "odd"))
    got = idstore.read_sums(spark, str(tmp_path / "odd")).orderBy("start").collect()
    want = _expected(odd_docs)
    assert [r["doc_id"] for r in got] == [w[0] for w in want]
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((w[0] or 0, w[2], w[3]) for w in want)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    idstore.write_store(no_docs, PATH, str(tmp_path / "none"))
    assert idstore.read_sums(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_found(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    path = str(tmp_path / "store")
    idstore.write_store(docs, PATH, path)
    whole = idstore._chunk_rows(spark, path)
    first = whole.orderBy("key").first()["key"]
    kept = spark.createDataFrame([("chunk", r["key"], r["ids"][:-2] + b"\1\1" if r["key"] == first else r["ids"], None, None, None) for r in whole.collect()], "kind string, key binary, ids binary, doc_id long, n_tokens long, leaves binary")
    kept.write.mode("overwrite").parquet(f"{path}/rows")
    with pytest.raises(Exception, match="digest"):
        idstore.read_sums(spark, path).collect()


def test_manifest_states_the_whole(spark, sf_dir, tmp_path, monkeypatch):
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "store")
    monkeypatch.setattr(idstore, "FAN", 8)  # three levels above 200 documents
    idstore.write_store(docs, PATH, path)
    stated = {r["part"]: r for r in spark.read.parquet(f"{path}/manifest").collect()}
    whole = stated.pop(idstore.WHOLE)
    want = _expected(docs)
    assert (whole["docs"], whole["ids"]) == (len(want), sum(w[2] for w in want)) == (sum(r["docs"] for r in stated.values()), sum(r["ids"] for r in stated.values()))
    by_part = {}
    for r in idstore._recipes(spark, path).orderBy("part", "place").collect():
        by_part.setdefault(r["part"], []).append(r["root"].hex().upper())
    for part, level in by_part.items():
        for _ in range(idstore.LEVELS):
            level = [hashlib.sha256("".join(level[k : k + 8]).encode()).hexdigest() for k in range(0, len(level), 8)]
        assert level == [stated[part]["root"]]
    other = [(r["part"], r["docs"], r["ids"], r["root"]) for r in stated.values()]
    false = (idstore.WHOLE, whole["docs"], whole["ids"], "0" * 32)
    spark.createDataFrame([false, *other], idstore._MANIFEST).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(ValueError, match="manifest"):
        idstore.read_sums(spark, path)


def test_encoder_is_the_library_on_random_texts():
    """Whatever stands round a space, the pieces' ids are those of the whole text."""
    library, rng = Tokenizer.from_file(PATH), random.Random(5)
    letters = ["a", "b", "the", "ing", "Ä", "é", "ß", "日本", "́", "٣", "7", "42", ".", ",", "'s", "'", "!!", "$", "\n", "\t", "\r", "\u00a0", "\u2003", "\u3000", "\x0b", "\x1c", "\x85", "\u200b", "😀", " ", " ", " ", "  ", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters, [*[4] * (len(letters) - 1), 0.1], k=rng.randint(0, 30))) for _ in range(30_000)]
    encoder = idstore.Encoder(PATH)
    for size in (1, 3000):
        for k in range(0, len(texts) if size > 1 else 300, size):
            part = [None, *texts[k : k + size], ""]
            want = [x.ids for x in library.encode_batch_fast([t or "" for t in part], add_special_tokens=False)]
            assert [np.frombuffer(x, "<u2").tolist() for x in encoder(part)] == want


def test_cuts_of_a_stream_are_those_of_each_text():
    rng = np.random.default_rng(2)
    n = np.array([0, 1, 15, 16, 17, 64, 3000, 0, 70_000, 2049, 5])
    ids, ends = rng.integers(0, 40, n.sum()).astype("<u2"), np.cumsum(n)
    for own, begin, end in zip(idstore.cuts_of(ids, ends), ends - n, ends, strict=True):
        assert [c - begin for c in own] == idstore.cuts(ids[begin:end])
    assert idstore.cuts_of(np.zeros(0, "<u2"), np.zeros(0, int)) == []


def test_crc_of_joined_parts_and_cuts():
    rng = np.random.default_rng(1)
    a, b = rng.bytes(1000), rng.bytes(777)
    got = idstore.crc_join(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([777]))
    assert got[0] == zlib.crc32(a + b)
    ids = rng.integers(0, 50_000, 20_000).astype("<u2")
    ends = idstore.cuts(ids)
    assert ends[-1] == len(ids) and max(np.diff([0, *ends])) <= idstore.MOST
    moved = [e - 5 for e in idstore.cuts(np.concatenate([ids[:5], ids]))]
    assert len(set(moved) & set(ends)) > 0.9 * len(ends)
